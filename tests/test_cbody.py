"""Reaching definitions, guards, handles, tables and selectors inside C functions."""

from spanloom.operators import cbody as B


def reaching(text, argument):
    return {(r[6], r[7]) for r in B.argument_rows(text) if r[4] == argument and r[2] == "use"}


def f(body, params="int a"):
    return f"int f({params}) {{ {body} }}"


def test_branches_are_merged_and_a_missing_else_keeps_what_was():
    assert reaching(f("int x = 1; use(x);"), "x") == {("definition", "1")}
    assert reaching(f("int x = 1; if (a) x = 2; else x = 3; use(x);"), "x") == {("definition", "2"), ("definition", "3")}
    assert reaching(f("int x = 1; if (a) x = 2; use(x);"), "x") == {("definition", "1"), ("definition", "2")}
    assert reaching(f("int x = 1; if (a) x = 2; else if (b) x = 3; else { x = 4; } use(x);"), "x") == {("definition", "2"), ("definition", "3"), ("definition", "4")}
    assert reaching(f("int x = 1; if (a) { x = 2; return 0; } use(x);"), "x") == {("definition", "1")}
    assert reaching(f("int x; if (a) x = 2; use(x);"), "x") == {("definition", "2"), ("undefined", "")}
    assert reaching(f("use(a); a = 4; use(a);"), "a") == {("parameter", "a"), ("definition", "4")}


def test_switches():
    cases = "int x = 0; switch (a) { case 1: x = 1; break; case 2: x = 2; case 3: x += 1; break; %s } use(x);"
    assert reaching(f(cases % ""), "x") == {("definition", "1"), ("update", "x += 1"), ("definition", "0")}
    assert reaching(f(cases % "default: x = 9;"), "x") == {("definition", "1"), ("update", "x += 1"), ("definition", "9")}
    assert reaching(f(cases % "default: return 1;"), "x") == {("definition", "1"), ("update", "x += 1")}


def test_loops():
    assert reaching(f("int x = 1; while (a) { use(x); x = 2; }"), "x") == {("definition", "1"), ("definition", "2")}
    assert reaching(f("int x = 1; while (a) { x = 2; if (b) break; x = 3; } use(x);"), "x") == {("definition", "1"), ("definition", "2"), ("definition", "3")}
    assert reaching(f("int x = 1; do { x = 2; } while (a); use(x);"), "x") == {("definition", "2")}
    assert reaching(f("int i; for (i = 0; i < 3; i++) use(i);"), "i") == {("range", "0:3:1")}


def test_outputs_and_strings():
    text = f('int x = 1; char name[9]; get(2, &x); use(x); strcpy(name, "Q 1"); use(name); if (get(1, &x)) use(x);')
    assert reaching(text, "x") == {("output", "get#2")} and reaching(text, "name") == {("string", '"Q 1"')}
    assert reaching(f("int x = 1; x++; use(x); *p = 3; s.x = 4; use(x);"), "x") == {("update", "x++")}


def test_calls_with_use_and_guards():
    text = f('if (a > 1) { v = use(1); } else use(2); while (use(3)) ; return use(4) + w(use(5)); ') + "\nint g(void) { switch (use(6)) { case 7: use(8); } }"
    got = {r[1:3] + r[4:] for r in B.call_rows(text) if r[2] == "use"}
    assert {(1, "use", "assigned", "a > 1"), (1, "use", "ignored", "!(a > 1)"), (1, "use", "condition", ""), (1, "use", "returned", ""), (1, "use", "argument", ""), (2, "use", "condition", ""), (2, "use", "ignored", "use(6) == 7")} == got


def test_handles():
    text = f("int h = rtx_open(1); use(h); rtx_close(h); use(h); h = rtx_open(2);\n if (a) { rtx_close(h); return 1; }\n use(h); if (a) h = rtx_open(3);\n use(h); use(a);")
    assert {(r[1], r[3], r[4], r[5]) for r in B.handle_rows(text) if r[2] == "use"} == {(1, "h", 1, "OPEN"), (1, "h", None, "CLOSED"), (3, "h", 1, "OPEN"), (4, "h", None, "AMBIGUOUS"), (4, "a", None, "PARAMETER")}


def test_tables_and_selectors():
    text = "static const int tab[3] = { 10, 0x14, N };\nint other[] = {1, 2,};\n" + f("int i, k = 1; for (i = 0; i <= 1; i++) use(tab[i]); use(tab[k]); use(tab[2]); use(tab[7]); use(other[a]); use(none[k]);")
    assert B.table_rows(text) == [("tab", 0, "10", 10), ("tab", 1, "0x14", 20), ("tab", 2, "N", None), ("other", 0, "1", 1), ("other", 1, "2", 2)]
    got = {r[5:] for r in B.selected_rows(text)}
    assert got == {("tab", 0, 10), ("tab", 1, 20), ("tab", 2, None), ("tab", None, None), ("other", None, None)}
    assert B.selected_rows("int t[1] = {1};" + f("int i; for (i = 0; i < 99; i++) use(t[i]);"))[0][6:] == (None, None)


def test_safe_parameters():
    text = "int f(int a, int b, char *c, int d) { int x = a; b = 1; d++; use(&c); return x; }"
    assert [(p, ok) for _, p, ok, _ in B.safe_rows(text)] == [("a", True), ("b", False), ("c", False), ("d", False)]


def test_what_does_not_parse_is_left_out(spark):
    for text in ("", "int f(int a) { if (a { use(a); }", "int f( {", "}}}", "int f() { case }"):
        B.argument_rows(text), B.call_rows(text), B.handle_rows(text), B.selected_rows(text)
    files = spark.createDataFrame([("p", "a.c", f("use(a);")), ("p", "a.c", f("use(a);")), ("p", "b.c", None), (None, "c.h", ""), ("p", "d.py", "x")], "process_name string, path string, content string")
    assert B.over_files(files, B.call_rows, "function string, line int, callee string, arguments int, use string, guards string").count() == 1


def test_settled_arguments(spark):
    text = "#define QUE 0x10\nstatic int tab[2] = { 5, 6 };\n" + f(
        'int i, v = 3, w, x; char s[9]; if (a) v = 4; use(7, "t", QUE, v, a); get(&w); use(w); strcpy(s, "Q"); use(s); for (i = 0; i < 2; i++) use(tab[i]); use(x + a); use(NONE);'
    )
    files = spark.createDataFrame([("p", "a.c", text), (None, "b.c", "int g(int n) { use(n); return 0; }")], "process_name string, path string, content string")
    macros = spark.createDataFrame([("a.c", "QUE", "0x10")], "path string, name string, value string")
    got = {(r["path"], r["argument"], r["position"]): (r["rule"], r["values"]) for r in B.settled_arguments(files, macros, spark.createDataFrame([("use",)], "name string")).collect()}
    assert got == {
        ("a.c", "7", 1): ("LITERAL", ["7"]), ("a.c", '"t"', 2): ("LITERAL", ['"t"']), ("a.c", "QUE", 3): ("MACRO", ["16"]), ("a.c", "v", 4): ("LOCAL", ["3", "4"]), ("a.c", "a", 5): ("PARAMETER", None),
        ("a.c", "w", 1): ("OUTPUT", None), ("a.c", "s", 1): ("STRING", ['"Q"']), ("a.c", "tab[i]", 1): ("TABLE", ["5", "6"]), ("a.c", "x + a", 1): ("UNRESOLVED", None), ("a.c", "NONE", 1): ("UNRESOLVED", None), ("b.c", "n", 1): ("PARAMETER", None),
    }
