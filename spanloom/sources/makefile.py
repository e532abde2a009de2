"""Makefiles: variables, continued lines, bounded expansion, sources, include folders and preprocessor flags.

A Makefile is one small file; its parse runs on the driver or in a task, not as a distributed plan.
"""

from __future__ import annotations

import re

ASSIGN = re.compile(r"^\s*(?:export\s+)?([A-Za-z_][\w.-]*)\s*(:=|\?=|\+=|::=|=)\s*(.*)$")
REFERENCE = re.compile(r"\$[({]([A-Za-z_][\w.-]*)(?::([^=)}]*)=([^)}]*))?[)}]")
FLAG_VARIABLES = ("CFLAGS", "CPPFLAGS", "DEFINES", "DEFS", "EXTRA_CFLAGS", "UNDEFS")


def logical_lines(text: str) -> list[str]:
    """Lines with continuations joined and comments cut."""
    joined = re.sub(r"\\\r?\n[ \t]*", " ", text)
    return [re.sub(r"(?<!\\)#.*", "", line).rstrip() for line in joined.splitlines()]


def variables(text: str, given: dict[str, str] | None = None, files: dict[str, str] | None = None, depth: int = 16) -> dict[str, str]:
    """Variables after all assignments; ``include`` lines take texts from ``files``. ``?=`` keeps what is set, ``+=`` appends, ``:=`` expands at once."""
    out = dict(given or {})
    for line in logical_lines(text):
        if line.startswith("\t"):
            continue
        if m := re.match(r"^-?include\s+(.*)$", line):
            for name in m[1].split():
                if depth and files and name in files:
                    out = variables(files[name], out, files, depth - 1)
            continue
        if m := ASSIGN.match(line):
            name, op, value = m[1], m[2], m[3].strip()
            if op == "?=":
                out.setdefault(name, value)
            elif op == "+=":
                out[name] = f"{out[name]} {value}".strip() if name in out else value
            else:
                out[name] = expand(value, out) if op in (":=", "::=") else value
    return out


def expand(value: str, names: dict[str, str], rounds: int = 10) -> str:
    """``value`` with references replaced, in a bounded number of rounds; unknown ones become empty."""

    def one(m: re.Match) -> str:
        found = names.get(m[1], "")
        if m[2] is not None:
            found = " ".join(w[: len(w) - len(m[2])] + m[3] if m[2] and w.endswith(m[2]) else w for w in found.split())
        return found

    for _ in range(rounds):
        new = REFERENCE.sub(one, value)
        if new == value:
            break
        value = new
    return value


def build_inputs(text: str, files: dict[str, str] | None = None) -> dict[str, list[str]]:
    """``sources``, ``include_dirs``, ``library_dirs``, ``defines`` and ``undefines`` of a Makefile, in order, each once."""
    names = variables(text, files=files)
    words = [w for v in names for w in expand(names[v], names).split()]
    objects = [re.sub(r"\.o$", ".c", w) for w in words if w.endswith(".o")]
    flags = [w for v in FLAG_VARIABLES if v in names for w in expand(names[v], names).split()]
    once = lambda xs: list(dict.fromkeys(x for x in xs if x))
    return {
        "sources": once([w for w in words if w.endswith(".c")] + objects),
        "include_dirs": once(w[2:] for w in words if w.startswith("-I")),
        "library_dirs": once(w[2:] for w in words if w.startswith("-L")),
        "defines": once(f[2:].split("=")[0] for f in flags if f.startswith("-D")),
        "undefines": once(f[2:] for f in flags if f.startswith("-U")),
    }
