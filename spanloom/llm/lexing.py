"""Lexers of C, Python and JSON that start in any state, and their state maps.

A text is cut into chunks after line ends (never after a backslash before one). For each chunk, the
state map says in which state it ends for every state it may start in, and with what codes; maps
compose associatively, so chunks are mapped without knowing what stands before them, and their start
states follow by a prefix product.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

CODE = 0
#: C: in a block comment that began after code, in a directive line, or with nothing before it on its line.
C_BLOCK, C_BLOCK_DIRECTIVE, C_BLOCK_FRESH = 1, 2, 3
#: Python: in a triple-quoted string of either quote, plain or raw.
PY_SINGLE, PY_DOUBLE = 1, 2
#: JSON: in a string.
JSON_STRING = 1
STATES = {"c": 4, "py": 3, "json": 2}


def unify(text: str) -> str:
    """Without a leading byte order mark, with ``\\n`` as the only line end."""
    if text[:1] == "﻿":
        text = text[1:]
    return text.replace("\r\n", "\n").replace("\r", "\n")


def chunks(text: str, size: int) -> list[str]:
    """``text`` in pieces of about ``size`` characters, cut after line ends that no backslash precedes."""
    out, start, n = [], 0, len(text)
    while n - start > size:
        end = text.find("\n", start + size)
        while end > 0 and text[end - 1] == "\\":
            end = text.find("\n", end + 1)
        if end < 0:
            break
        out.append(text[start : end + 1])
        start = end + 1
    out.append(text[start:])
    return out


C_TOKEN = re.compile(
    r"""[ \t\f\v]*+(?:(?P<nl>\n)|(?P<line>//[^\n]*)|(?P<block>/\*.*?\*/)|(?P<open>/\*)
    |(?P<str>(?:u8|[uUL])?"(?:[^"\\\n]|\\.)*")|(?P<chr>[uUL]?'(?:[^'\\\n]|\\.)+')
    |(?P<num>\.?[0-9](?:[eEpP][+-]|[\w.])*)|(?P<id>[^\W\d][\w$]*|\$[\w$]*)
    |(?P<punct>\.\.\.|<<=|>>=|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=|[-+*/%&|^~!=<>?:;,.(){}\[\]])|(?P<hash>\#\#?)|(?P<bad>.))""",
    re.S | re.X,
)
C_NUMBER = re.compile(
    r"(?:0[xX][0-9a-fA-F]+|0[bB][01]+|0[0-7]*|[1-9][0-9]*)(?:[uU](?:ll|LL|[lL])?|(?:ll|LL|[lL])[uU]?)?$"
    r"|(?:[0-9]+\.[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|[0-9]+[eE][+-]?[0-9]+|0[xX](?:[0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?[0-9]+)[fFlL]?$"
)
C_KEYWORDS = frozenset(
    "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof"
    " static struct switch typedef union unsigned void volatile while _Alignas _Alignof _Atomic _Bool _Complex _Generic _Imaginary _Noreturn"
    " _Static_assert _Thread_local __attribute__ __extension__ __inline __inline__ __restrict __const __volatile__ __asm__ asm typeof __typeof__".split()
)
C_SKIP = re.compile(r"""//[^\n]*|/\*|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)+'""", re.S)


def splice(text: str) -> str:
    """C text with continued lines joined."""
    return text.replace("\\\n", "") if "\\\n" in text else text


def c_end_state(chunk: str, state: int) -> int:
    """The state in which ``chunk`` ends."""
    text, at = splice(chunk), 0
    before = {CODE: "", C_BLOCK: "x", C_BLOCK_DIRECTIVE: "#", C_BLOCK_FRESH: ""}[state]  # of the line, without comments
    if state:
        at = text.find("*/")
        if at < 0:
            return state
        at += 2
    while m := C_SKIP.search(text, at):
        gap = text[at : m.start()]
        nl = gap.rfind("\n")
        before = gap[nl + 1 :] if nl >= 0 else before + gap
        if len(before) > 99:
            before = before.lstrip()[:1] or " "
        at = m.end()
        if m[0] == "/*":
            end = text.find("*/", at)
            if end < 0:
                head = before.lstrip()[:1]
                return C_BLOCK_FRESH if not head else C_BLOCK_DIRECTIVE if head == "#" else C_BLOCK
            at = end + 2
        elif m[0][:2] != "//":
            before += "x"
    return CODE


PY_SKIP = re.compile(r"""\#[^\n]*|'{3}|"{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'""", re.S)
PY_CLOSE = {PY_SINGLE: re.compile(r"(?:[^\\']|\\.|'(?!''))*?'''", re.S), PY_DOUBLE: re.compile(r'(?:[^\\"]|\\.|"(?!""))*?"""', re.S)}


def py_end_state(chunk: str, state: int) -> int:
    """The state in which ``chunk`` ends."""
    at = 0
    while True:
        if state:
            m = PY_CLOSE[state].match(chunk, at)
            if not m:
                return state
            at = m.end()
        m = PY_SKIP.search(chunk, at)
        while m and len(m[0]) != 3 or m and m[0] not in ("'''", '"""'):
            m = PY_SKIP.search(chunk, m.end())
        if not m:
            return CODE
        at, state = m.end(), PY_SINGLE if m[0][0] == "'" else PY_DOUBLE


def state_map(lang: str, chunk: str) -> tuple[int, ...]:
    """The end state of ``chunk`` for each state it may start in."""
    if lang == "json":
        return tuple(end for end, _ in json_map(chunk))
    end = c_end_state if lang == "c" else py_end_state
    if (lang == "c" and "*/" not in chunk) or (lang == "py" and "'''" not in chunk and '"""' not in chunk):
        return (end(chunk, CODE), *range(1, STATES[lang]))
    return tuple(end(chunk, s) for s in range(STATES[lang]))


def compose(first: tuple[int, ...], second: tuple[int, ...]) -> tuple[int, ...]:
    """The map of two chunks, one after the other; associative."""
    return tuple(second[s] for s in first)


def start_states(maps: list[tuple[int, ...]]) -> list[int]:
    """The state each chunk starts in, the first in code: the exclusive prefix product of the maps."""
    out, so_far = [], None
    for m in maps:
        out.append(so_far[CODE] if so_far else CODE)
        so_far = compose(so_far, m) if so_far else m
    return out


OPENERS, CLOSERS = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
BRACKETS = OPENERS.keys() | CLOSERS.keys()


def bracket_summary(tokens: list[str]) -> tuple[str, str] | None:
    """(closers, openers) that stay unmatched within ``tokens``; None if two brackets inside it clash."""
    closed, opened = [], []
    for t in [t for t in tokens if t in BRACKETS]:
        if t in OPENERS:
            opened.append(t)
        else:
            if not opened:
                closed.append(t)
            elif opened.pop() != CLOSERS[t]:
                return None
    return "".join(closed), "".join(opened)


def join_summaries(a: tuple[str, str] | None, b: tuple[str, str] | None) -> tuple[str, str] | None:
    """The summary of two stretches, one after the other; associative."""
    if a is None or b is None:
        return None
    n = min(len(a[1]), len(b[0]))
    if any(OPENERS[a[1][-1 - i]] != b[0][i] for i in range(n)):
        return None
    return a[0] + b[0][n:], a[1][: len(a[1]) - n] + b[1]


DEFINED = re.compile(r"(!?)\s*defined\s*(?:\(\s*([A-Za-z_]\w*)\s*\)|([A-Za-z_]\w*))$")
DIRECTIVE = re.compile(r"[ \t]*([A-Za-z_]\w*)?[ \t]*")


def _directive(line: str) -> str | None:
    """A directive's mark in the token stream: ``#`` and if, elif, else, endif with its condition; None if it only goes."""
    m = DIRECTIVE.match(line)
    word, rest = m[1], line[m.end() :].strip()
    name = rest.split()[0] if rest.split() else ""
    if word == "ifdef":
        return f"#i+{name}"
    if word == "ifndef":
        return f"#i-{name}"
    if word in ("if", "elif"):
        d = DEFINED.match(rest)
        return f"#{word[0]}{'-' if d[1] else '+'}{d[2] or d[3]}" if d else f"#{word[0]}?"
    return {"else": "#l", "endif": "#x"}.get(word or "")


def _directive_line(text: str, at: int) -> tuple[str, int, bool]:
    """(the directive's text from ``at`` on without comments, where its line ends, whether a comment in it doesn't end)."""
    parts = []
    while True:
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        b = C_SKIP.search(text, at, end)
        while b and b[0] != "/*" and b[0][:2] != "//":
            b = C_SKIP.search(text, b.end(), end)
        if not b:
            parts.append(text[at:end])
            return "".join(parts), end, False
        parts.append(text[at : b.start()])
        if b[0] != "/*":
            return "".join(parts), end, False
        close = text.find("*/", b.end())
        if close < 0:
            return "".join(parts), len(text), True
        parts.append(" ")
        at = close + 2


#: Marks of a directive that a comment carries over the end of a chunk: it begins, goes on, ends. Its text follows, without blanks.
BEGINS, GOES_ON, ENDS = "#<", "#=", "#>"


def _carried(mark: str, text: str) -> str:
    return mark + re.sub(r"[ \t\f\v]", "\x1f", text)


def settled(tokens: Iterable[str]) -> Iterator[str]:
    """Tokens with the directives that chunks share put together."""
    text = ""
    for t in tokens:
        mark = t[:2]
        if mark == BEGINS:
            text = t[2:]
        elif mark == GOES_ON:
            text += "\x1f" + t[2:]
        elif mark == ENDS:
            if whole := _directive((text + "\x1f" + t[2:]).replace("\x1f", " ")):
                yield whole
        else:
            yield t


def _c_lex(text: str, at: int, fresh: bool, out: list[str]) -> tuple[int, tuple[int, int] | None]:
    """Append the codes of ``text`` from ``at`` on; (end state, (where the first block comment ends, codes up to there)).

    ``fresh``: nothing stands before on the line, so that # begins a directive.
    """
    first, restart = None, True
    while restart:
        restart = False
        for m in C_TOKEN.finditer(text, at):
            kind = m.lastgroup
            if kind == "id":
                t = m["id"]
                out.append(t if t in C_KEYWORDS else "i")
            elif kind == "punct":
                out.append(m["punct"])
            elif kind == "nl":
                fresh = True
                continue
            elif kind == "line":
                continue
            elif kind == "block":
                first = first or (m.end(), len(out))
                continue
            elif kind == "num":
                out.append("n" if C_NUMBER.match(m["num"]) else "X")
            elif kind == "str":
                out.append("s")
            elif kind == "chr":
                out.append("c")
            elif kind == "open":
                return C_BLOCK_FRESH if fresh else C_BLOCK, first
            elif kind == "hash" and fresh:
                line, at, open_ = _directive_line(text, m.end())
                if m["hash"] == "##":
                    out.append("X")
                    line = "##"
                if open_:
                    out.append(_carried(BEGINS, line))
                    return C_BLOCK_DIRECTIVE, first
                if mark := _directive(line):
                    out.append(mark)
                restart = True
                break
            else:
                out.append("X")
            fresh = False
    return CODE, first


def c_map(chunk: str) -> list[tuple[int, list[str]]]:
    """For each state ``chunk`` may start in: (end state, codes).

    Codes: i identifier, n number, s string, c character, X no token, ``#...`` conditional
    directives, else the token itself. What follows the first end of a comment is the same for all
    states but the rest of its line, so it is read once.
    """
    text = splice(chunk)
    close = text.find("*/") + 2
    code: list[str] = []
    end, first = _c_lex(text, 0, True, code)
    if close < 2:
        return [(end, code), *((s, []) for s in (C_BLOCK, C_BLOCK_DIRECTIVE, C_BLOCK_FRESH))]
    directive = BLANKS.match(text, close).end()
    directive = text[directive : directive + 1] == "#"
    if first and first[0] == close and not directive:
        block = (end, code[first[1] :])
    else:
        rest: list[str] = []
        block = (_c_lex(text, close, False, rest)[0], rest)
    line, at, open_ = _directive_line(text, close)
    if open_:
        inside = (C_BLOCK_DIRECTIVE, [_carried(GOES_ON, line)])
    elif not line.strip():
        inside = (block[0], [_carried(ENDS, line), *block[1]])
    else:
        rest = [_carried(ENDS, line)]
        inside = (_c_lex(text, at, False, rest)[0], rest)
    fresh = block
    if directive:
        rest = []
        fresh = (_c_lex(text, close, True, rest)[0], rest)
    return [(end, code), block, inside, fresh]


def c_tokens(chunk: str, state: int = CODE) -> tuple[list[str], int]:
    """(codes, end state) of ``chunk`` from ``state`` on (see :func:`c_map`)."""
    end, codes = c_map(chunk)[state]
    return codes, end


JSON_CUT = re.compile(r"[,:\[\]{}\n]")
JSON_TOKEN = re.compile(r"""[ \t\n\r]*(?:(?P<q>")|(?P<v>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)|(?P<p>[\[\]{},:]))""")
JSON_REST = re.compile(r"""(?:[^"\\\x00-\x1f]+|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*""")
JSON_BLANK = re.compile(r"[ \t\n\r]*\Z")
JSON_LIST, JSON_PAIRS = re.compile(r"(?:[sv](?:,[sv])*)?"), re.compile(r"(?:s:[sv](?:,s:[sv])*)?")
BLANKS = re.compile(r"[ \t\f\v]*")


def json_chunks(text: str, size: int) -> list[str]:
    """``text`` in pieces of about ``size`` characters, cut after line ends and signs, so that only strings are cut in two."""
    out, start, n = [], 0, len(text)
    while n - start > size and (m := JSON_CUT.search(text, start + size)):
        out.append(text[start : m.end()])
        start = m.end()
    out.append(text[start:])
    return out


def json_join(tokens: str) -> str:
    """JSON codes (s string, v other value, X no token, signs) with each whole list and object as v: the local grammar.

    Joining is associative: what is left of a stretch are closers and openers without their partner
    and what stands between them. X stands for any stretch that is in no valid text.
    """
    out: list[str] = []
    opened: list[int] = []
    for t in tokens:
        if t == "X":
            return "X"
        if t in "[{":
            opened.append(len(out))
        elif t in "]}" and opened:
            k = opened.pop()
            inner = "".join(out[k + 1 :])
            if out[k] + t not in ("[]", "{}") or not (JSON_LIST if t == "]" else JSON_PAIRS).fullmatch(inner):
                return "X"
            del out[k:]
            t = "v"
        out.append(t)
    return "".join(out)


def json_map(chunk: str) -> list[tuple[int, str]]:
    """For a chunk that starts outside and one that starts inside a string: (end state, joined codes)."""

    def lex(at: int, inside: bool) -> tuple[int, str]:
        out: list[str] = []
        while True:
            if inside:
                at = JSON_REST.match(chunk, at).end()
                if at == len(chunk):
                    return JSON_STRING, json_join("".join(out))
                if chunk[at] != '"':
                    return CODE, "X"
                out.append("s")
                at, inside = at + 1, False
            if JSON_BLANK.match(chunk, at):
                return CODE, json_join("".join(out))
            m = JSON_TOKEN.match(chunk, at)
            if not m:
                return CODE, "X"
            at = m.end()
            if m["q"]:
                inside = True
            else:
                out.append(m["p"] or "v")

    return [lex(0, False), lex(0, True)]


PY_SCAN = re.compile(r"""\#[^\n]*|'{3}|"{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|[()\[\]{}]|\\\n|\n(?=[^\s#])""", re.S)
#: Closers and openers without their partner in a stretch of Python, and where lines begin at column 0: (offset, closers, openers up to there).
Depths = tuple[int, int, list[tuple[int, int, int]]]


def py_map(chunk: str) -> list[tuple[int, Depths]]:
    """For each state ``chunk`` may start in: (end state, its bracket summary with the lines that may begin a statement)."""

    def scan(state: int) -> tuple[int, Depths]:
        at = closed = opened = 0
        lines: list[tuple[int, int, int]] = []
        if state == CODE and chunk[:1].strip() and chunk[0] != "#":
            lines.append((0, 0, 0))
        while True:
            if state:
                m = PY_CLOSE[state].match(chunk, at)
                if not m:
                    return state, (closed, opened, lines)
                at, state = m.end(), CODE
            m = PY_SCAN.search(chunk, at)
            if not m:
                return CODE, (closed, opened, lines)
            x, at = m[0], m.end()
            if x in ("'''", '"""'):
                state = PY_SINGLE if x[0] == "'" else PY_DOUBLE
            elif x in "([{":
                opened += 1
            elif x in ")]}":
                if opened:
                    opened -= 1
                else:
                    closed += 1
            elif x == "\n":
                lines.append((at, closed, opened))

    if "'''" not in chunk and '"""' not in chunk:  # a string goes on through it
        return [scan(CODE), (PY_SINGLE, (0, 0, [])), (PY_DOUBLE, (0, 0, []))]
    return [scan(s) for s in range(STATES["py"])]


def join_depths(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
    """The (closers, openers) of two stretches of Python, one after the other; kinds of brackets are left to the parser."""
    closed, opened = a
    return (closed, opened - b[0] + b[1]) if opened >= b[0] else (closed + b[0] - opened, b[1])


C_SPAN = re.compile(r"""(?P<line>//(?:\\\n|[^\n])*)|(?P<block>/\*.*?(?:\*/|\Z))|(?P<str>(?:\b(?:u8|[uUL]))?"(?:[^"\\\n]|\\.)*"?)|(?P<chr>'(?:[^'\\\n]|\\.)*'?)""", re.S)
PY_SPAN = re.compile(
    r"""(?P<line>\#[^\n]*)|(?P<str>(?:\b[rRbBuUfF]{1,2})?(?:'{3}(?:[^\\']|\\.|'(?!''))*(?:'{3}|\Z)|"{3}(?:[^\\"]|\\.|"(?!""))*(?:"{3}|\Z)|"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?))""",
    re.S,
)
JSON_SPAN = re.compile(r"""(?P<str>"(?:[^"\\\n]|\\.)*"?)""", re.S)
SPANS = {"c": C_SPAN, "py": PY_SPAN, "json": JSON_SPAN}


def spans(lang: str, text: str, state: int = CODE) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the comments (line, block), string literals (str) and characters (chr) of ``text``.

    A chunk that starts inside a comment or string begins with the rest of it.
    """
    out, at = [], 0
    if state:
        if lang == "c":
            end = text.find("*/")
            at = len(text) if end < 0 else end + 2
            out.append(("block", 0, at))
        else:
            m = PY_CLOSE[state].match(text)
            at = m.end() if m else len(text)
            out.append(("str", 0, at))
    for m in SPANS[lang].finditer(text, at):
        out.append((m.lastgroup, m.start(), m.end()))
    return out
