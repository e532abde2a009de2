"""C enumerations and placeholder texts."""

from __future__ import annotations

import re

from spanloom.functions.cexpr import evaluate

ENUM = re.compile(r"\benum\b\s*[A-Za-z_]*\w*\s*\{([^{}]*)\}")


def enum_values(text: str, known: dict[str, int] | None = None) -> dict[str, int]:
    """Constants of the enumerations in ``text`` (without comments); names with two different values are left out."""
    names: dict[str, int] = dict(known or {})
    out: dict[str, int | None] = {}
    for m in ENUM.finditer(text):
        last: int | None = -1
        for part in m[1].split(","):
            name, _, formula = part.strip().partition("=")
            name = name.strip()
            if not name:
                continue
            last = evaluate(formula.strip(), names) if formula.strip() else None if last is None else last + 1
            if name in out and out[name] != last:
                out[name] = None
            else:
                out[name] = last
            if last is not None:
                names[name] = last
    return {n: v for n, v in out.items() if v is not None}


def fill(text: str, values: dict[int, str]) -> str:
    """``text`` with ``$n`` replaced at once, so that what is put in is not replaced again; unknown ones stay."""
    return re.sub(r"\$(\d+)", lambda m: values.get(int(m[1]), m[0]), text)
