"""Scans of C sources: includes, macros, function definitions with their lines, and calls.

Comments and literals are blanked with their offsets kept; then definitions are found at bracket
depth 0. One narrow pass per file, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIDDEN = re.compile(r"""//(?:\\\n|[^\n])*|/\*.*?(?:\*/|\Z)|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'""", re.S)
DIRECTIVE = re.compile(r"^[ \t]*#(?:\\\n|[^\n])*", re.M)
INCLUDE = re.compile(r"""^[ \t]*#[ \t]*include[ \t]*([<"])([^>"\n]+)[>"]""", re.M)
MACRO = re.compile(r"^[ \t]*#[ \t]*define[ \t]+([A-Za-z_]\w*)(\([^)\n]*\))?[ \t]*((?:\\\n|[^\n])*)", re.M)
HEAD = re.compile(r"([A-Za-z_]\w*)\s*\(")
NOT_CALLS = frozenset("if for while switch return sizeof do else case defined _Alignof __attribute__".split())


def blanked(text: str) -> str:
    """``text`` with comments and literals as spaces; line ends stay."""
    return HIDDEN.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def plain(text: str) -> str:
    return text.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n")


def scan(text: str) -> list[tuple[str, str, int, int, str]]:
    """(what, name, line, end line, detail) of includes, macros, definitions and calls (detail: the function around)."""
    text = plain(text)
    seen = HIDDEN.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][0] == "/" else m[0], text)
    rows = [("include", m[2], text.count("\n", 0, m.start()) + 1, 0, m[1]) for m in INCLUDE.finditer(seen)]
    rows += [("macro", m[1], text.count("\n", 0, m.start()) + 1, 0, ("()" if m[2] else "") + " ".join(m[3].replace("\\\n", " ").split())) for m in MACRO.finditer(seen)]
    code = DIRECTIVE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), blanked(text))
    depth, start, name, body = 0, 0, None, 0
    for m in re.finditer(r"[{};]", code):
        c = m[0]
        if c == "{":
            if not depth:
                head = code[start : m.start()]
                h = HEAD.search(head)
                name = h[1] if h and "=" not in head[: h.start()] and h[1] not in NOT_CALLS and not re.search(r"\b(?:struct|union|enum)\s*$", head[: h.start()]) else None
                lead = len(head) - len(head.lstrip())
                body = start + lead
            depth += 1
        elif c == "}":
            depth = max(0, depth - 1)
            if not depth:
                if name:
                    a, b = text.count("\n", 0, body) + 1, text.count("\n", 0, m.start()) + 1
                    rows.append(("function", name, a, b, "static" if re.match(r"\s*static\b", code[body:]) else ""))
                    inner = code.find("{", body)
                    for call in HEAD.finditer(code, inner, m.start()):
                        if call[1] not in NOT_CALLS:
                            rows.append(("call", call[1], text.count("\n", 0, call.start()) + 1, 0, name))
                start, name = m.end(), None
        elif not depth:
            start = m.end()
    return rows


def scanned(files: DataFrame) -> DataFrame:
    """``path, what, name, line, end_line, detail`` of all C files; null contents have no rows, repeated files repeated ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *r) for p, t in zip(b["path"], b["content"]) for r in scan(t)]
            yield pd.DataFrame(rows, columns=["path", "what", "name", "line", "end_line", "detail"])

    c = files.where("content is not null").where(F.lower("path").rlike(r"\.[ch]$")).select("path", "content")
    return c.mapInPandas(run, "path string, what string, name string, line int, end_line int, detail string")


def line_states(text: str, dead: frozenset[str] = frozenset({"NOP"})) -> list[str]:
    """The class of each line: directive, blank, comment, if0 (under ``#if 0``), off (under ``#ifdef`` of a ``dead`` symbol) or live.

    ``#else`` turns a dead branch live and the branch before it dead; inner conditions don't revive.
    """
    text = plain(text)
    shown = blanked(text).split("\n")
    out: list[str] = []
    stack: list[str] = []  # what a branch makes of its lines: live, if0 or off
    for raw, code in zip(text.split("\n"), shown):
        m = re.match(r"\s*#\s*(ifdef|ifndef|if|elif|else|endif)\b\s*(\S*)", code)
        if m:
            word, cond = m[1], m[2]
            if word in ("if", "ifdef", "ifndef"):
                stack.append("if0" if word == "if" and cond == "0" else "off" if word == "ifdef" and cond in dead else "if1" if word == "if" and cond == "1" else "on" if word == "ifndef" and cond in dead else "live")
            elif word in ("else", "elif") and stack:
                stack[-1] = {"if0": "if1", "if1": "if0", "off": "on", "on": "off"}.get(stack[-1], "live")
            elif word == "endif" and stack:
                stack.pop()
        if re.match(r"\s*#", code):
            out.append("directive")
        elif not raw.strip():
            out.append("blank")
        else:
            gone = next((s for s in stack if s in ("if0", "off")), None)
            out.append(gone or ("live" if code.strip() else "comment"))
    return out


def classified_lines(files: DataFrame) -> DataFrame:
    """``path, line, state`` of every line of all C files (:func:`line_states`)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, i + 1, s) for p, t in zip(b["path"], b["content"]) for i, s in enumerate(line_states(t))]
            yield pd.DataFrame(rows, columns=["path", "line", "state"])

    c = files.where("content is not null").where(F.lower("path").rlike(r"\.[ch]$")).select("path", "content").distinct()
    return c.mapInPandas(run, "path string, line int, state string")


TYPES = frozenset("int char void long short unsigned signed float double struct union enum const static extern inline".split())


def occurrences(text: str) -> list[tuple[str, str, int]]:
    """(name, kind, line) of each name before a parenthesis: ``definition`` if a body follows, ``prototype`` if a semicolon does at depth 0, else ``call``."""
    text = plain(text)
    code = DIRECTIVE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), blanked(text))
    rows, depth, at = [], 0, 0
    for m in HEAD.finditer(code):
        depth += code.count("{", at, m.start()) - code.count("}", at, m.start())
        at = m.start()
        if m[1] in NOT_CALLS or m[1] in TYPES:
            continue
        kind = "call"
        if depth <= 0:
            end, level = m.end(), 1
            while level and end < len(code):
                level += (code[end] == "(") - (code[end] == ")")
                end += 1
            after = code[end:].lstrip()[:1]
            kind = "definition" if after == "{" else "prototype" if after == ";" else "other"
        rows.append((m[1], kind, code.count("\n", 0, m.start()) + 1))
    return rows


STATIC = re.compile(r"(?:^|[;}])\s*static\s+(?!inline\b)((?:[A-Za-z_]\w*[\s*]+)+)([A-Za-z_]\w*)\s*(\[[^\]]*\]\s*)*(?=[=;,])")


def file_statics(text: str) -> list[tuple[str, str, int]]:
    """(name, type, line) of the static variables of a file, outside of functions."""
    text = plain(text)
    code = DIRECTIVE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), blanked(text))
    depth, flat = 0, []
    for c in code:  # bodies are left out, their place stays
        depth -= c == "}"
        flat.append(c if depth <= 0 or c == "\n" else " ")
        depth += c == "{"
    flat_code = "".join(flat)
    return [(m[2], " ".join(m[1].split()), flat_code.count("\n", 0, m.start(2)) + 1) for m in STATIC.finditer(flat_code)]


def _per_file(files: DataFrame, rows_of, columns: list[str], schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *r) for p, t in zip(b["path"], b["content"]) for r in rows_of(t)]
            yield pd.DataFrame(rows, columns=["path", *columns])

    c = files.where("content is not null").where(F.lower("path").rlike(r"\.[ch]$")).select("path", "content")
    return c.mapInPandas(run, schema)


def scanned_occurrences(files: DataFrame) -> DataFrame:
    """``path, name, kind, line`` of the :func:`occurrences` in all C files."""
    return _per_file(files, occurrences, ["name", "kind", "line"], "path string, name string, kind string, line int")


def static_variables(files: DataFrame) -> DataFrame:
    """``path, name, type, line`` of the :func:`file_statics` of all C files."""
    return _per_file(files, file_statics, ["name", "type", "line"], "path string, name string, type string, line int")
