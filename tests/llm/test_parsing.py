import ast
import json
import random

import pytest

from spanloom.llm import grammars, lexing, parsing

GOOD_C = [
    "", "// only a comment", "/* a */ int x; ", "int f(a, b)\nint a;\nchar *b;\n{ return a; }", "typedef struct { int a : 3; char t[16]; } cell_t; cell_t *g(cell_t c) { return (cell_t *)&c; }",
    "#define X(a) do { \\\n a; } while (0)\nint f(void) { for (int i = 0; i < 3; i++) if (i) break; else continue; do ; while (1); return sizeof(int) + (int)3.5e1f; }",
    "enum e { A, B = 2, };\nint a[] = { [0] = 1, 2, };\nstruct s { union { int x; }; } v = { .x = 1 };",
    "int f(int n) { switch (n) { case 1: case 2: n = '\\''; break; default: n = n ? 1 : 2; } l: goto l; }", 'char *s = "a" "b\\"" L"c";', "int (*fp)(int, char *) = 0; void (*sig(int, void (*)(int)))(int);",
    "unsigned long long x = 0x1FULL; static inline int f() { return (x)(1), (foo_t)x; }", "extern int printf(const char *, ...);", "a_t b; a_t *c, d[3]; int f(a_t, b_t *);", "main() { }", "int f() { x * y; x *z = 0; return *p++; }",
    '#include <x.h>\n#error don\'t\nint a;', "int a; /* x\n#endif */ int b;",
]
BAD_C = [
    "int f( {", "int f(int n)) { }", "int a[3 = {1};", "int f() { return 1 }", "int f() { if (1 { } }", "<<<<<<< HEAD\nint a;\n=======\nint b;\n>>>>>>> x\n", "int f() {", "}", "/* open", 'char *s = "open;\n', "class A { public: int x; };",
    "def f(n):\n    return n\n", "int f() { else x; }", "int a b;", "int f() { int g() { } }", "int x = 08;", "int f() { x = ; }", "#ifdef A\nint x;", "int x;\n#endif", "int f() { case }", "int `;", "import os",
]


@pytest.mark.parametrize("size", [1, 5, 30, 5000])
def test_c_of_any_chunk_size(monkeypatch, size):
    monkeypatch.setattr(parsing, "CHUNK_CHARS", size)
    assert [t for t in GOOD_C if not parsing.text_valid("c", t)] == []
    assert [t for t in BAD_C if parsing.text_valid("c", t)] == []


@pytest.mark.parametrize("size", [1, 5, 30, 5000])
def test_directive_over_a_cut(monkeypatch, size):
    monkeypatch.setattr(parsing, "CHUNK_CHARS", size)
    text = "int a;\n#ifdef /* x\n y\n z */ NOPE\nint f( {\n#endif\nint b;\n"
    assert parsing.text_valid("c", text, undefines=["NOPE"]) and not parsing.text_valid("c", text, defines=["NOPE"]) and not parsing.text_valid("c", text)


def test_c_statements_agree_with_the_whole():
    rng = random.Random(8)
    bits = ["int i ( ) { i = ( i ) { n } ; }", "int i [ n ] = { n , n } ;", "struct { int i ; } i ;", "struct __attribute__ ( ( i ) ) { int i ; } i ;", "int i ( i ) int i ; { return i ; }", "i = ( i ) { n }", "int i ( ) __attribute__ ( ( i ) ) { }", "}", "{", ";", "int", "i", "( i )", "enum i { i }", "typedef int i ;"]
    for _ in range(4000):
        tokens = " ".join(rng.choice(bits) for _ in range(rng.randrange(1, 6))).split()
        if lexing.bracket_summary(tokens) == ("", ""):
            assert grammars.c_valid(tokens) == grammars.CParser(tokens).unit(), " ".join(tokens)


def test_product_is_associative():
    rng = random.Random(6)
    bits = {"c": ["/*", "*/", "//", "\n", "#if A\n", "#endif /*", "{", "}", "x ", '"', "#ifdef "], "py": ["'''", '"""', "#", "\n", "(", ")", "x", "\nx"], "json": ["[", "]", "{", "}", '"', ",", ":", "1", "\n"]}
    for lang, some in bits.items():
        for _ in range(300):
            a, b, c = (parsing.Digest.of(lang, "".join(rng.choice(some) for _ in range(9)) + "\n") for _ in range(3))
            one, two = (a * b) * c, a * (b * c)
            assert one.by_state == two.by_state and one.text == two.text
            assert parsing.applied([a, b, c]).by_state[0] == one.by_state[0]
            assert parsing.Digest.unpacked(lang, one.packed(), one.text).by_state == one.by_state


def test_branches_follow_symbols_and_fallback():
    text = "#if defined(KR)\nint f(a)\nint a;\n{\n#else\nint f(int a)\n{\n#endif\nreturn a; }\n"
    assert not parsing.text_valid("c", text)
    assert parsing.text_valid("c", text, defines=["KR"]) and parsing.text_valid("c", text, undefines=["KR"])
    assert parsing.text_valid("c", text, fallback=["KR"])
    broken = "#ifndef KR\nint f( {\n#endif\n"
    assert parsing.text_valid("c", broken, defines=["KR"], fallback=["KR"]) and not parsing.text_valid("c", broken, undefines=["KR"])


def test_byte_order_mark_and_line_ends():
    for end in ("\n", "\r\n", "\r"):
        text = "﻿" + end.join(["int f(void)", "{ // it's", "return 1; }", ""])
        assert parsing.text_valid("c", text)
        assert parsing.text_valid("py", "﻿def f():" + end + "    return 1" + end)


@pytest.mark.parametrize("text", ["", "{}", "[1, 2.5e3, null]", '{"a": [true, {"b": "\\u00e9"}]}', "[1,]", '{"a" 1}', "{'a': 1}", "NaN", '"\n"', "[1] 2", '{"a": 1,}', "01", "[", "]", '{"a":}', " 1 ", "-", '"\\x"'])
def test_json_as_the_library(text):
    def strict(x):
        raise ValueError(x)

    try:
        json.loads(text, parse_constant=strict)
        ok = True
    except ValueError:
        ok = False
    assert parsing.text_valid("json", text) == ok


def test_json_of_any_depth():
    assert parsing.text_valid("json", "[" * 100_000 + "]" * 100_000)


JSON_TEXT = '{"a": [1, -2.5e3, "x,y]", {"b\\"": [], "c": {}}, null], "long": "' + "é{:" * 9 + '", "t": true}'


def test_json_in_pieces_as_the_library(monkeypatch):
    monkeypatch.setattr(parsing, "CHUNK_CHARS", 7)
    rng = random.Random(9)
    for _ in range(800):
        chars = list(JSON_TEXT)
        for _ in range(rng.randrange(3)):
            chars[rng.randrange(len(chars))] = rng.choice(["", ",", "]", "}", '"', "\n", "1", "\\", ":"])
        text = "".join(chars)
        try:
            json.loads(text)
            ok = True
        except ValueError:
            ok = False
        assert parsing.text_valid("json", text) == ok, text


PYTHON = 'import os\n\n@d\n@e(1)\ndef f(a,\n  b):\n    """x\ny = (\n"""\n    return {\n1: "#"}\n\nx = [\n1,\n]\nif x:\n    pass\nelif y:\n    pass\nelse:\n    pass\ntry:\n    f()\nexcept E:\n    pass\nfinally:\n    g()\n# c\nclass A:\n    s = \'\'\'\nq\n\'\'\'\n'


def test_python_statements_agree_with_the_whole_text(monkeypatch):
    rng = random.Random(3)
    for _ in range(300):
        chars = list(PYTHON)
        for _ in range(rng.randrange(3)):
            chars[rng.randrange(len(chars))] = rng.choice(["", "\n", "(", '"', "'''", " ", ":"])
        text = "".join(chars)
        try:
            ast.parse(text)
            ok = True
        except (SyntaxError, ValueError):
            ok = False
        for size in (5, 60, 10_000):
            monkeypatch.setattr(parsing, "CHUNK_CHARS", size)
            assert parsing.text_valid("py", text) == ok, text


def test_state_maps_compose_to_the_whole():
    rng = random.Random(1)
    for lang, bits in (("c", ['"a', '"', "/*", "*/", "//", "\n", "x ", "'", "\\\n", "#if ", "#define A "]), ("py", ["'''", '"""', '"', "'", "#", "\n", "x ", "\\\n", "\\'"])):
        for _ in range(300):
            text = "".join(rng.choice(bits) for _ in range(40)) + "\n"
            pieces = lexing.chunks(text, 5)
            assert "".join(pieces) == text
            for s in range(lexing.STATES[lang]):
                end = s
                for p in pieces:
                    end = lexing.state_map(lang, p)[end]
                assert end == lexing.state_map(lang, text)[s]
            if lang == "c":
                joined = [t for p, s in zip(pieces, lexing.start_states([lexing.state_map("c", p) for p in pieces])) for t in lexing.c_tokens(p, s)[0]]
                assert list(lexing.settled(joined)) == list(lexing.settled(lexing.c_tokens(text)[0]))


def test_bracket_summaries_are_associative():
    rng = random.Random(2)
    for _ in range(300):
        parts = [[rng.choice("(){}i") for _ in range(4)] for _ in range(3)]
        a, b, c = map(lexing.bracket_summary, parts)
        join = lexing.join_summaries
        assert join(join(a, b), c) == join(a, join(b, c)) == lexing.bracket_summary(sum(parts, []))


def files(spark, rows):
    return spark.createDataFrame(rows, "file_id bigint, repository string, process_name string, path string, content string, key int, valid string")


def test_operator_and_its_spread_form_agree(spark):
    bad = "int a;\n" * 3000 + "int f( {\n"
    rows = [(1, "r", "p", "a.c", "int x;", 0, ""), (1, "r", "p", "a.c", "int x;", 0, ""), (2, "r", "p", "a.c", bad, 0, ""), (3, "r", "p", "a.c", "int a;\n" * 9000, 0, ""), (4, "r", None, "a.py", "x =", 0, ""), (5, "r", "q", "b.json", "", 0, ""), (6, "r", "p", "b.h", None, 0, ""), (7, "r", "p", None, "x", 0, ""), (8, "r", "p", "x.txt", "x", 0, ""), (9, "r", "p", "x.c", "/*" + "\n" * 40_000, 0, "")]
    configs = spark.createDataFrame([("p", [" -DA=1 ", "", None], None, ["B"])], "process_name string, defines array<string>, undefines array<string>, fallback_undefines array<string>")
    for spread in (1_000_000, 1000):
        assert {r[0] for r in parsing.invalid_files(files(spark, rows), configs, spread).collect()} == {2, 4, 5, 9}
    assert parsing.invalid_files(files(spark, []), configs).count() == 0
    rates = {(r["lang"], r["files"], r["invalid"]) for r in parsing.invalid_rates(files(spark, rows), configs).collect()}
    assert rates == {("c", 4, 2), ("py", 1, 1), ("json", 1, 1)}
