"""Recognisers of balanced statements: C declarations and statements, Python blocks.

They say whether a token stream is valid, nothing more; names are not looked up. An identifier is
taken as a type name wherever a declaration needs one.
"""

from __future__ import annotations

import ast
import hashlib
import re
import sys
import warnings
from collections.abc import Iterable

from spanloom.llm.lexing import BRACKETS

sys.setrecursionlimit(max(sys.getrecursionlimit(), 200_000))

TYPE_WORDS = frozenset("void char short int long float double signed unsigned _Bool _Complex _Imaginary".split())
STORAGE = frozenset("typedef extern static auto register inline _Thread_local _Noreturn __inline __inline__ __extension__".split())
QUALIFIERS = frozenset("const volatile restrict _Atomic __restrict __const __volatile__".split())
TAGS = frozenset(("struct", "union", "enum"))
TYPEOF = frozenset(("typeof", "__typeof__", "_Alignas"))
DECLARES = TYPE_WORDS | STORAGE | QUALIFIERS | TAGS | TYPEOF | {"__attribute__"}
PREFIX = frozenset(("++", "--", "&", "*", "+", "-", "~", "!", "__extension__"))
BINARY = frozenset("* / % + - << >> < > <= >= == != & ^ | && || = *= /= %= += -= <<= >>= &= ^= |=".split())
OPERAND = frozenset(("i", "n", "s", "c", "~", "!", "sizeof", "_Alignof"))
END = "\x00"
#: So many verdicts on statements are kept in a task.
KNOWN = 200_000


class Fault(Exception):
    """The tokens are not valid."""


class CParser:
    """A recogniser of C (C11, old-style parameter lists, common attributes) over token codes."""

    def __init__(self, tokens: list[str]):
        self.t = [*tokens, END, END, END]
        self.i = 0

    def unit(self) -> bool:
        """Whether the tokens are a translation unit: balanced external declarations one after another."""
        try:
            while self.t[self.i] != END:
                self.external()
            return True
        except Fault:
            return False

    def need(self, token: str) -> None:
        if self.t[self.i] != token:
            raise Fault
        self.i += 1

    def skip_balanced(self) -> None:
        self.need("(")
        depth = 1
        while depth:
            x = self.t[self.i]
            if x == END:
                raise Fault
            depth += (x in "([{") - (x in ")]}") if len(x) == 1 else 0
            self.i += 1

    def attributes(self) -> None:
        while self.t[self.i] in ("__attribute__", "__asm__", "asm"):
            self.i += 1
            self.skip_balanced()

    def external(self) -> None:
        t = self.t
        if t[self.i] == ";":
            self.i += 1
            return
        if t[self.i] in ("asm", "__asm__"):
            self.attributes()
            self.need(";")
            return
        if t[self.i] == "_Static_assert":
            self.static_assert()
            return
        self.declaration(outer=True)

    def static_assert(self) -> None:
        self.i += 1
        self.skip_balanced()
        self.need(";")

    def declaration(self, outer: bool = False) -> None:
        """A declaration with its semicolon, or, if ``outer``, a function with its body."""
        t = self.t
        typed = self.specifiers()
        if t[self.i] == ";":
            if not typed:
                raise Fault
            self.i += 1
            return
        if not typed and not (outer and t[self.i] == "i" and t[self.i + 1] == "("):
            raise Fault
        first = True
        while True:
            function, names_only = self.declarator(named=True)
            self.attributes()
            if first and outer and function:
                if t[self.i] == "{":
                    self.block()
                    return
                if names_only and t[self.i] not in (";", ",", "=", END):
                    while t[self.i] != "{":  # old-style parameters
                        if t[self.i] not in DECLARES and t[self.i] != "i":
                            raise Fault
                        self.declaration()
                    self.block()
                    return
            first = False
            if t[self.i] == "=":
                self.i += 1
                self.initializer()
            if t[self.i] == ",":
                self.i += 1
                continue
            self.need(";")
            return

    def specifiers(self) -> bool:
        """Skip declaration specifiers; whether there was a type or storage word."""
        t = self.t
        any_, typed = False, False
        while True:
            x = t[self.i]
            if x in TYPE_WORDS:
                typed = any_ = True
                self.i += 1
            elif x in STORAGE or x in QUALIFIERS:
                any_ = True
                self.i += 1
                if x == "_Atomic" and t[self.i] == "(":
                    self.i += 1
                    self.type_name()
                    self.need(")")
                    typed = True
            elif x == "__attribute__":
                self.attributes()
            elif x in TAGS:
                self.tagged()
                typed = any_ = True
            elif x in TYPEOF:
                self.i += 1
                self.skip_balanced()
                typed = typed or x != "_Alignas"
                any_ = True
            elif x == "i" and not typed:
                # a type name if something that it can declare, or nothing, follows
                nxt = t[self.i + 1]
                if nxt in ("i", "*") or nxt in DECLARES and nxt not in TYPE_WORDS and nxt not in TAGS:
                    pass
                elif any_ and nxt in (";", ",", "=", "[", "(", ":") or not any_ and nxt in ("(", ";", "=", "[", ":"):
                    return any_
                elif nxt not in (")", ",", "["):
                    return any_
                typed = any_ = True
                self.i += 1
            else:
                return any_

    def tagged(self) -> None:
        t = self.t
        enum = t[self.i] == "enum"
        self.i += 1
        self.attributes()
        named = t[self.i] == "i"
        self.i += named
        if t[self.i] != "{":
            if not named:
                raise Fault
            return
        self.i += 1
        if enum:
            while True:
                self.need("i")
                self.attributes()
                if t[self.i] == "=":
                    self.i += 1
                    self.assignment()
                if t[self.i] == ",":
                    self.i += 1
                    if t[self.i] == "}":
                        break
                    continue
                break
            self.need("}")
        else:
            while t[self.i] != "}":
                self.member()
            self.i += 1
        self.attributes()

    def member(self) -> None:
        t = self.t
        if t[self.i] == "_Static_assert":
            self.static_assert()
            return
        if t[self.i] == ";":
            self.i += 1
            return
        if not self.specifiers():
            raise Fault
        while t[self.i] != ";":
            if t[self.i] != ":":
                self.declarator(named=True)
            if t[self.i] == ":":
                self.i += 1
                self.assignment()
            self.attributes()
            if t[self.i] != ",":
                break
            self.i += 1
        self.need(";")

    def declarator(self, named: bool | None) -> tuple[bool, bool]:
        """Skip a declarator; (it is a function's, its parameters are bare names). ``named``: True must, False must not, None may have a name."""
        t = self.t
        while t[self.i] == "*" or t[self.i] in QUALIFIERS or t[self.i] == "__attribute__":
            if t[self.i] == "__attribute__":
                self.attributes()
            else:
                self.i += 1
        function = names = False
        if t[self.i] == "i" and named is not False:
            self.i += 1
        elif t[self.i] == "(" and (named or t[self.i + 1] in ("*", "(", "[", "__attribute__") or named is None and t[self.i + 1] == "i" and t[self.i + 2] in (")", "[")):
            mark = self.i
            try:
                self.i += 1
                self.attributes()
                self.declarator(named)
                self.need(")")
            except Fault:
                if named:
                    raise
                self.i = mark
        elif named:
            raise Fault
        while True:
            if t[self.i] == "[":
                self.i += 1
                while t[self.i] in QUALIFIERS or t[self.i] == "static":
                    self.i += 1
                if t[self.i] == "*" and t[self.i + 1] == "]":
                    self.i += 1
                if t[self.i] != "]":
                    self.assignment()
                self.need("]")
            elif t[self.i] == "(":
                names = self.parameters()
                function = True
            else:
                return function, names

    def parameters(self) -> bool:
        """Skip a parameter list; whether it may be a list of bare names."""
        t = self.t
        self.need("(")
        if t[self.i] == ")":
            self.i += 1
            return True
        names = True
        while True:
            if t[self.i] == "...":
                self.i += 1
                self.need(")")
                return False
            if t[self.i] == "i" and t[self.i + 1] in (",", ")"):
                self.i += 1
            else:
                names = False
                if not self.specifiers():
                    raise Fault
                self.declarator(named=None)
                self.attributes()
            if t[self.i] == ",":
                self.i += 1
                continue
            self.need(")")
            return names

    def type_name(self) -> None:
        if not self.specifiers():
            raise Fault
        self.declarator(named=False)

    def initializer(self) -> None:
        t = self.t
        if t[self.i] != "{":
            self.assignment()
            return
        self.i += 1
        while t[self.i] != "}":
            designated = False
            while t[self.i] in (".", "["):
                designated = True
                if t[self.i] == ".":
                    self.i += 1
                    self.need("i")
                else:
                    self.i += 1
                    self.assignment()
                    if t[self.i] == "...":
                        self.i += 1
                        self.assignment()
                    self.need("]")
            if designated:
                self.need("=")
            self.initializer()
            if t[self.i] != ",":
                break
            self.i += 1
        self.need("}")

    def block(self) -> None:
        t = self.t
        self.need("{")
        while t[self.i] != "}":
            if t[self.i] == END:
                raise Fault
            self.item()
        self.i += 1

    def item(self) -> None:
        """A declaration or statement in a block."""
        t = self.t
        x = t[self.i]
        if x == "_Static_assert":
            self.static_assert()
        elif x in DECLARES and not (x == "__extension__" and t[self.i + 1] == "("):
            self.declaration()
        elif x == "i" and t[self.i + 1] == "i":
            self.declaration()
        elif x == "i" and t[self.i + 1] == "*":
            mark = self.i
            try:
                self.declaration()
            except Fault:
                self.i = mark
                self.statement()
        else:
            self.statement()

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def statement(self) -> None:
        t = self.t
        while True:  # labels, and the tails of if, while, for and switch, without recursion
            x = t[self.i]
            if x == "i" and t[self.i + 1] == ":":
                self.i += 2
                if t[self.i] == "}":
                    return
                if t[self.i] in DECLARES:
                    self.declaration()
                    return
                continue
            if x == "case":
                self.i += 1
                self.assignment()
                if t[self.i] == "...":
                    self.i += 1
                    self.assignment()
                self.need(":")
                if t[self.i] == "}":
                    return
                if t[self.i] in DECLARES:
                    self.declaration()
                    return
                continue
            if x == "default":
                self.i += 1
                self.need(":")
                if t[self.i] == "}":
                    return
                if t[self.i] in DECLARES:
                    self.declaration()
                    return
                continue
            if x == "if":
                self.i += 1
                self.condition()
                self.statement()
                if t[self.i] == "else":
                    self.i += 1
                    continue
                return
            if x == "while" or x == "switch":
                self.i += 1
                self.condition()
                continue
            if x == "for":
                self.i += 1
                self.need("(")
                if t[self.i] in DECLARES or t[self.i] == "i" and t[self.i + 1] == "i":
                    self.declaration()
                else:
                    if t[self.i] != ";":
                        self.expression()
                    self.need(";")
                if t[self.i] != ";":
                    self.expression()
                self.need(";")
                if t[self.i] != ")":
                    self.expression()
                self.need(")")
                continue
            break
        if x == "{":
            self.block()
        elif x == ";":
            self.i += 1
        elif x == "do":
            self.i += 1
            self.statement()
            self.need("while")
            self.condition()
            self.need(";")
        elif x == "goto":
            self.i += 1
            if t[self.i] == "*":
                self.expression()
            else:
                self.need("i")
            self.need(";")
        elif x in ("continue", "break"):
            self.i += 1
            self.need(";")
        elif x == "return":
            self.i += 1
            if t[self.i] != ";":
                self.expression()
            self.need(";")
        elif x in ("asm", "__asm__"):
            self.i += 1
            while t[self.i] in QUALIFIERS or t[self.i] == "goto":
                self.i += 1
            self.skip_balanced()
            self.need(";")
        else:
            self.expression()
            self.need(";")

    def expression(self) -> None:
        self.assignment()
        while self.t[self.i] == ",":
            self.i += 1
            self.assignment()

    def assignment(self) -> None:
        t = self.t
        while True:
            self.unary()
            x = t[self.i]
            if x in BINARY:
                self.i += 1
            elif x == "?":
                self.i += 1
                if t[self.i] != ":":
                    self.expression()
                self.need(":")
            else:
                return

    def is_type(self) -> bool:
        """Whether the parenthesis here encloses a type name rather than an expression."""
        t, j = self.t, self.i + 1
        if t[j] in DECLARES and t[j] != "__extension__":
            return True
        if t[j] != "i":
            return False
        j += 1
        stars = False
        while t[j] == "*" or t[j] in QUALIFIERS:
            stars = True
            j += 1
        if t[j] != ")":
            return False
        return stars or t[j + 1] in OPERAND

    def unary(self) -> None:
        t = self.t
        while True:
            x = t[self.i]
            if x in PREFIX:
                self.i += 1
            elif x == "sizeof" or x == "_Alignof":
                self.i += 1
                if t[self.i] == "(" and self.is_type():
                    self.i += 1
                    self.type_name()
                    self.need(")")
                    if t[self.i] != "{":
                        return
                    self.initializer()
                    break
            elif x == "&&" and t[self.i + 1] == "i":  # a label's address
                self.i += 1
            elif x == "(" and self.is_type():
                self.i += 1
                self.type_name()
                self.need(")")
                if t[self.i] == "{":
                    self.initializer()
                    break
            else:
                self.primary()
                break
        while True:
            x = t[self.i]
            if x == "(":
                self.i += 1
                if t[self.i] != ")":
                    while True:
                        if t[self.i] in DECLARES:
                            self.type_name()
                        else:
                            self.assignment()
                        if t[self.i] != ",":
                            break
                        self.i += 1
                self.need(")")
            elif x == "[":
                self.i += 1
                self.expression()
                self.need("]")
            elif x == "." or x == "->":
                self.i += 1
                self.need("i")
            elif x == "++" or x == "--":
                self.i += 1
            else:
                return

    def primary(self) -> None:
        t = self.t
        x = t[self.i]
        if x == "i" or x == "n" or x == "c":
            self.i += 1
        elif x == "s":
            while t[self.i] == "s":
                self.i += 1
        elif x == "(":
            self.i += 1
            if t[self.i] == "{":
                self.block()
            else:
                self.expression()
            self.need(")")
        elif x == "_Generic":
            self.i += 1
            self.skip_balanced()
        else:
            raise Fault


#: A function's body can't be followed by these; after anything else it ends its declaration.
CONTINUES = frozenset((";", ",", "=", "(", ")", "[", "]", ".", "->", "?", ":", "}"))


def c_statements(tokens: list[str]) -> list[list[str]]:
    """Balanced C tokens cut into statements: after each body of a function at depth 0.

    A brace at depth 0 opens a body if it follows ``)``, but not an attribute's, or the ``;`` of an
    old-style parameter, and what follows it can't go on with an expression. Other declarations stay
    with the body after them.
    """
    out, start, depth, body, n = [], 0, 0, False, len(tokens)
    opened: list[int] = []
    before: int | None = None  # where the parenthesis closed last at depth 0 began
    for k in [k for k, t in enumerate(tokens) if t in BRACKETS]:
        t = tokens[k]
        if t in "([{":
            if not depth and t == "{":
                last = tokens[k - 1] if k > start else ""
                body = last == ";" or last == ")" and before is not None and (before == 0 or tokens[before - 1] != "__attribute__")
            opened.append(k)
            depth += 1
        else:
            depth -= 1
            if not opened:
                return [tokens]
            k0 = opened.pop()
            if not depth:
                before = k0 if t == ")" else None
                if t == "}" and body and (k + 1 == n or tokens[k + 1] not in CONTINUES):
                    out.append(tokens[start : k + 1])
                    start = k + 1
    if start < n:
        out.append(tokens[start:])
    return out


def c_valid(tokens: list[str], known: dict[bytes, bool] | None = None) -> bool:
    """Whether balanced tokens are a translation unit, each statement parsed by itself. ``known`` keeps verdicts, as functions repeat."""
    for piece in c_statements(tokens):
        if known is None:
            ok = CParser(piece).unit()
        else:
            key = hashlib.blake2b(" ".join(piece).encode(), digest_size=16).digest()
            ok = known.get(key)
            if ok is None:
                if len(known) >= KNOWN:
                    known.clear()
                ok = known[key] = CParser(piece).unit()
        if not ok:
            return False
    return True


PY_GOES_ON = re.compile(r"(?:else|elif|except|finally|case)\b|[)\]}]")


def py_statements(text: str, lines: Iterable[tuple[int, int]]) -> list[str]:
    """Python text cut into its top-level statements: before those of ``lines`` (offset, depth) that have depth 0.

    Lines that go on with a compound statement stay with it, decorators with what they decorate.
    """
    cuts, decorated = [0], text[:1] == "@"
    for at, depth in lines:
        if at and not depth:
            if not decorated and not PY_GOES_ON.match(text, at):
                cuts.append(at)
            decorated = text[at] == "@"
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


def py_parses(text: str) -> bool:
    """Whether the Python grammar takes ``text``. What only the compiler rejects, as a return outside a function, is no fault of syntax here."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False
    return True


def py_valid(text: str, lines: Iterable[tuple[int, int]]) -> bool:
    """Whether ``text`` is valid Python 3: each statement by itself, and the whole where one fails, as strings may nest in ways the lexer doesn't follow."""
    return all(py_parses(s) for s in py_statements(text, lines)) or py_parses(text)
