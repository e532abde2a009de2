"""C scans, formulas, value flow, sources, sinks, streams and layering of the package."""

import ast
import pathlib

import pytest
from pyspark.sql import functions as F

from spanloom.functions.cexpr import evaluate, strip_parens
from spanloom.operators.csource import scan
from spanloom.operators.flow import argument_values, flow_rows, scanned_flow
from spanloom.operators.graph import components
from spanloom.session import shared_folder
from spanloom.sources import snapshots as S
from spanloom.streaming.incremental import latest_by_stream

SOURCE = """#include <stdio.h>
#define QUE 0x10
#define PAIR(a, b) do { \\
    f(a); } while (0)
/* int hidden(void) { } */
static int tab[] = { 1, 2 };
static int
leaf(int n, const char *tag)
{
    rtx_open(n, "a, (b", QUE);
    return n;
}
int top(void) { if (leaf(7, "x")) { leaf(QUE, 0); } return 0; }
"""


@pytest.mark.parametrize(
    "text,value",
    [("1 + 2 * 3", 7), ("-7 / 2", -3), ("-7 % 2", -1), ("(1 << 4) | 0x0F", 31), ("010", 8), ("1 ? 2 : 3", 2), ("0 && 1 / 0", 0), ("1 || 1 / 0", 1), ("1 / 0", None), ("x + 1", None), ("", None), (None, None), ("1 +", None), ("2147483648", None), ("~0 == -1", 1), ("08", None), ("3 > 2 > 1", 0)],
)
def test_formulas(text, value):
    assert evaluate(text) == value


def test_formula_names_and_parens():
    assert evaluate("n * 2", {"n": 21}) == 42
    assert [strip_parens(x) for x in ("((a))", "(a)(b)", "(a", None, "()")] == ["a", "(a)(b)", "(a", None, ""]


def test_scan_of_c():
    rows = scan(SOURCE)
    assert ("include", "stdio.h", 1, 0, "<") in rows and ("macro", "QUE", 2, 0, "0x10") in rows
    assert [(n, a, b) for w, n, a, b, _ in rows if w == "function"] == [("leaf", 7, 12), ("top", 13, 13)]
    assert [(n, d) for w, n, _, _, d in rows if w == "call"] == [("rtx_open", "leaf"), ("leaf", "top"), ("leaf", "top")]
    assert scan("") == [] and scan("int a;\n") == []


def test_flow_rows():
    rows = flow_rows(SOURCE)
    assert [(f, p, t) for w, f, _, _, p, t in rows if w == "param"] == [("leaf", 1, "n"), ("leaf", 2, "tag")]
    assert [(c, p, t) for w, f, c, _, p, t in rows if w == "arg" and f == "leaf"] == [("rtx_open", 1, "n"), ("rtx_open", 2, '"a, (b"'), ("rtx_open", 3, "QUE")]


def test_values_reach_arguments_through_parameters(spark):
    extra = "int lone(int q) { rtx_open(q, q + 1, 5); return 0; }\nint loop(int r) { loop(r); rtx_open(r, 1, 2); }"
    other = "int leaf(int n, int m) { rtx_open(n); return 0; }\nvoid go(void) { leaf(99, 0); }"  # another process has a leaf of its own
    rows = [("p", "a.c", SOURCE), ("p", "b.c", extra), ("p", "c.py", "x"), ("p", "d.c", None), ("q", "e.c", other), (None, "f.c", "int x(int n) { rtx_open(n); }")]
    files = spark.createDataFrame(rows, "process_name string, path string, content string")
    macros = spark.createDataFrame([("a.c", "QUE", "0x10")], "path string, name string, value string")
    targets = spark.createDataFrame([("rtx_open",)], "name string")
    got = {(r["path"], r["position"], r["text"], r["kind"], r["value"]) for r in argument_values(scanned_flow(files), macros, targets).collect()}
    assert {("a.c", 1, "n", "PARAM", 7), ("a.c", 1, "n", "PARAM", 16), ("a.c", 3, "QUE", "MACRO", 16), ("a.c", 2, '"a, (b"', "UNRESOLVED", None)} <= got
    assert {x for x in got if x[0] == "e.c"} == {("e.c", 1, "n", "PARAM", 99)} and ("f.c", 1, "n", "EXTERNAL_ENTRY", None) in got and ("a.c", 1, "n", "PARAM", 99) not in got
    assert {("b.c", 1, "q", "EXTERNAL_ENTRY", None), ("b.c", 2, "q + 1", "UNRESOLVED", None), ("b.c", 3, "5", "CONST", 5), ("b.c", 1, "r", "UNRESOLVED", None)} <= got


@pytest.mark.parametrize("limit", [0, 3, 10**6])
def test_components(spark, monkeypatch, limit):
    import spanloom.operators.graph as G

    monkeypatch.setattr(G, "ONE_TASK_EDGES", limit)
    e = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("x", "a"), ("e", "y"), ("z", "z"), ("p", "q")]
    got = {(r["node"], r["component"]) for r in components(spark.createDataFrame(e, "s string, t string"), "s", "t").collect()}
    assert got == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("z", "z")}


def test_snapshots_and_csv_round_trips(spark):
    df = spark.createDataFrame([("p", 'a "q", b\nc', 1), ("q", None, None)], "process string, text string, n int")
    path = shared_folder(spark, "t")
    S.write_snapshots(df, path, "process")
    assert {tuple(r) for r in S.read_snapshots(spark, path, "text string, process string").collect()} == {('a "q", b\nc', "p"), (None, "q")}
    with pytest.raises(Exception):
        S.write_snapshots(df, path, "process")
    path = shared_folder(spark, "t")
    S.write_csv(df, path)
    assert {tuple(r) for r in S.read_csv(spark, path, ["process", "text", "n", "more"]).collect()} == {("p", 'a "q", b\nc', "1", ""), ("q", "", "", "")}


def test_grouped_index_round_trip(spark):
    df = spark.createDataFrame([("v", "a", 1), ("v", "a", 1), ("v", "b", 2), ("w", None, 3)], "value string, path string, line int")
    back = S.flattened_index(S.grouped_index(df, "value", ["path", "line"]), "value", "path string, line int")
    assert {tuple(r) for r in back.collect()} == {("v", "a", 1), ("v", "b", 2), ("w", None, 3)}


def test_stream_keeps_the_latest(spark):
    df = spark.createDataFrame([(k, t, f"{k}{t}") for t in range(6) for k in range(3)], "k int, t int, v string")
    path = shared_folder(spark, "t")
    df.repartition(5).write.parquet(path)
    got = latest_by_stream(spark, path, df.schema, ["k"], ["t"], files_per_batch=2)
    assert {tuple(r) for r in got.select("k", "t", "v").collect()} == {(k, 5, f"{k}5") for k in range(3)}


def test_nothing_else_imports_the_subpackage():
    root = pathlib.Path(__file__).parent.parent / "spanloom"
    for p in root.rglob("*.py"):
        if root / "llm" in p.parents:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("spanloom.llm") for n in names), p


def test_no_local_checkpoint():
    root = pathlib.Path(__file__).parent.parent / "spanloom"
    assert not any("localCheckpoint" in p.read_text() for p in root.rglob("*.py"))
    assert F is not None


def test_makefiles():
    from spanloom.sources.makefile import build_inputs, variables

    text = "SRC = a.c \\\n  b.c\nOBJ := $(SRC:.c=.o) d.o\nCFLAGS ?= -DA=1 -UB\nCFLAGS += -DC -Iinc # note\ninclude more.mk\nDIR = $(ROOT)/x\nall:\n\tcc -DNOT $(SRC)\n"
    got = build_inputs(text, {"more.mk": "ROOT = /r\nLIBS = -Llib -lm\n"})
    assert got == {"sources": ["a.c", "b.c", "d.c"], "include_dirs": ["inc"], "library_dirs": ["lib"], "defines": ["A", "C"], "undefines": ["B"]}
    assert variables("A = $(B)\nB = 1\nA ?= 2\n")["A"] == "$(B)"
    assert build_inputs("")["sources"] == []


def test_enums_and_placeholders():
    from spanloom.functions.enums import enum_values, fill

    assert enum_values("enum e { A, B = 5, C, D = B * 2, E = X, F };") == {"A": 0, "B": 5, "C": 6, "D": 10}
    assert enum_values("enum { A = 1 }; enum { A = 2, G = 3 };") == {"G": 3}
    assert fill("$1 + $2 $9", {1: "$2", 2: "x"}) == "$2 + x $9"


def test_line_states():
    from spanloom.operators.csource import line_states

    text = "int a;\n\n/* x\n y */\n#if 0\nint b;\n#else\nint c;\n#endif\n#ifdef NOP\nint d;\n#ifdef Z\nint e;\n#endif\n#else\nint f; // g\n#endif\n"
    want = ["live", "blank", "comment", "comment", "directive", "if0", "directive", "live", "directive", "directive", "off", "directive", "off", "directive", "directive", "live", "directive", "blank"]
    assert line_states(text) == want


def test_fingerprints_change_upward_only(spark):
    from spanloom.operators.graph import fingerprints

    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "d"), ("x", "y"), ("y", "x")], "s string, t string")

    def of(c, y="9"):
        own = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", c), ("d", None), ("y", y)], "node string, digest string")
        return {r["node"]: r["fingerprint"] for r in fingerprints(e, "s", "t", own).collect()}

    one, two = of("3"), of("4")
    assert set(one) == {"a", "b", "c", "d", "x", "y"} and {n for n in one if one[n] != two[n]} == {"a", "c"}
    three = of("3", "8")  # both ends of a cycle change with either
    assert {n for n in one if one[n] != three[n]} == {"x", "y"}


def test_stream_goes_on_after_a_kill(spark, tmp_path, monkeypatch):
    import spanloom.streaming.incremental as I

    source, folder = tmp_path / "in", f"file:{tmp_path}/state"
    source.mkdir()
    write = lambda n, rows: spark.createDataFrame(rows, "k bigint, at bigint").coalesce(1).write.mode("append").parquet(f"{source}")
    write(0, [(1, 1), (2, 1)])
    schema = spark.read.parquet(str(source)).schema
    run = lambda: {tuple(r) for r in latest_by_stream(spark, str(source), schema, ["k"], ["at"], 1, folder).collect()}
    assert run() == {(1, 1), (2, 1)}
    write(1, [(2, 2), (3, 2)])
    whole = I._generations
    calls = []

    def killed(*args):
        calls.append(1)
        raise RuntimeError("killed")

    monkeypatch.setattr(I, "_generations", killed)  # the batch fails before its state is whole
    with pytest.raises(Exception):
        run()
    monkeypatch.setattr(I, "_generations", whole)
    assert calls and run() == {(1, 1), (2, 2), (3, 2)}
    write(2, [(1, 9)])
    assert run() == {(1, 9), (2, 2), (3, 2)} == run()
    assert len(whole(spark, folder)) == 2


def test_catalog_reads_new_files_only(spark, tmp_path):
    from spanloom.streaming.incremental import fresh_files

    source, folder = str(tmp_path / "in"), f"file:{tmp_path}/state"
    spark.range(3).coalesce(1).write.parquet(source)
    schema = spark.read.parquet(source).schema
    first = fresh_files(spark, source, schema, folder=folder).collect()
    spark.range(4).coalesce(1).write.mode("append").parquet(source)
    then = fresh_files(spark, source, schema, folder=folder).collect()
    assert [r["n_rows"] for r in first] == [3] and sorted(r["n_rows"] for r in then) == [3, 4] and {r["path"] for r in first} < {r["path"] for r in then}
