"""Includes by rule, what files see, searches that carry a label."""

from spanloom.operators import includes as I
from spanloom.operators.graph import carried_search, layers, paired_reach

FILES = [
    ("p", "r/app/main.c", '#include "near.h"\n#include "sub/deep.h"\n#include "only.h"\n#include "x/twice.h"\n#include "twice.h"\n#include <none.h>\n#include "../lib/up.h"\n#include "./near.h"\n'),
    ("p", "r/app/near.h", '#include "only.h"\n#define A 1\n#define A 2\n'),
    ("p", "r/inc/sub/deep.h", '#define B 3\n#include "main.c"\n'),
    ("p", "r/inc/k.c", ""),
    ("p", "r/other/only.h", "#define A 9\n#define C 4\n"),
    ("p", "r/one/x/twice.h", ""), ("p", "r/two/twice.h", ""), ("p", "r/lib/up.h", None),
    ("q", "s/none.h", ""), ("q", "s/a.c", '#include "none.h"\n#include "only.h"\n'), (None, "t/b.c", '#include "b.h"\n'), (None, "t/b.h", ""),
]


def files(spark):
    return spark.createDataFrame(FILES, "process_name string, path string, content string")


def test_include_rules(spark):
    got = {(r["path"], r["included"]): r["target"] for r in I.resolved_includes(files(spark)).collect()}
    main = {k[1]: v for k, v in got.items() if k[0] == "r/app/main.c"}
    assert main == {
        "near.h": "r/app/near.h", "./near.h": "r/app/near.h", "../lib/up.h": "r/lib/up.h",  # relative to the file
        "sub/deep.h": "r/inc/sub/deep.h",  # below a folder of the process
        "only.h": "r/other/only.h",  # the only one of its name
        "x/twice.h": "r/one/x/twice.h", "twice.h": "r/one/x/twice.h", "none.h": None,
    }
    assert got["s/a.c", "none.h"] == "s/none.h" and got["s/a.c", "only.h"] is None and got["t/b.c", "b.h"] is None
    assert I.resolved_includes(files(spark).limit(0)).count() == 0


def test_visible_files_and_macros(spark):
    seen = I.visible_files(files(spark))
    rows = {(r["visible"], r["depth"]) for r in seen.where("path = 'r/app/near.h'").collect()}
    assert rows == {("r/app/near.h", 0), ("r/other/only.h", 1)}
    main = {r["visible"]: r["depth"] for r in seen.where("path = 'r/app/main.c'").collect()}
    assert main == {"r/app/main.c": 0, "r/app/near.h": 1, "r/inc/sub/deep.h": 1, "r/other/only.h": 1, "r/one/x/twice.h": 1, "r/lib/up.h": 1}
    macros = spark.createDataFrame([("r/app/near.h", "A", 3, "2"), ("r/app/near.h", "A", 2, "1"), ("r/other/only.h", "A", 1, "9"), ("r/other/only.h", "C", 2, "4")], "path string, name string, line int, detail string")
    got = {(r["path"], r["name"]): (r["value"], r["from_path"]) for r in I.visible_macros(macros, seen).collect()}
    assert got["r/app/near.h", "A"] == ("1", "r/app/near.h") and got["r/app/near.h", "C"] == ("4", "r/other/only.h") and got["r/app/main.c", "A"] == ("1", "r/app/near.h")


def test_carried_search(spark):
    e = [("a", "b", None), ("b", "c", "x"), ("a", "z", "y"), ("z", "c", None), ("c", "d", None), ("d", "a", "w"), ("d", "e", "v"), *[(f"e{i}" if i else "e", f"e{i + 1}", None) for i in range(12)]]
    df = spark.createDataFrame(e, "s string, t string, said string")
    got = {r["node"]: (r["depth"], r["path"], r["label"]) for r in carried_search(df, "s", "t", spark.createDataFrame([("a",)], "node string"), "said").collect()}
    assert got["c"] == (2, "a/b/c", "x") and got["e"] == (4, "a/b/c/d/e", "v") and got["a"] == (0, "a", "") and got["e12"][0] == 16
    pairs = {(r["seed"], r["node"], r["depth"]) for r in paired_reach(df, "s", "t", spark.createDataFrame([("d",), ("e11",)], "node string")).where("depth < 3").collect()}
    assert pairs == {("d", "d", 0), ("d", "a", 1), ("d", "e", 1), ("d", "b", 2), ("d", "z", 2), ("d", "e1", 2), ("e11", "e11", 0), ("e11", "e12", 1)}


def test_layers_of_a_graph_with_several_parents_and_a_cycle(spark):
    e = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("b", "c"), ("r", "s"), ("s", "r"), ("s", "b"), ("t", "r"), ("d", "d")]
    got = {r["node"]: (r["component"], r["layer"]) for r in layers(spark.createDataFrame(e, "s string, t string"), "s", "t").collect()}
    assert got == {"d": ("d", 0), "c": ("c", 1), "b": ("b", 2), "a": ("a", 3), "r": ("r", 3), "s": ("r", 3), "t": ("t", 4)}


def test_backward_states_say_where_they_were_cut(spark):
    from spanloom.operators.graph import backward_states

    e = [(f"u{i}", "s") for i in range(8)] + [("top", f"u{i}") for i in range(8)] + [(f"c{i + 1}", f"c{i}") for i in range(6)] + [("c0", "c3"), (None, "s"), ("s", "s")]
    df = spark.createDataFrame(e, "s string, t string")
    seeds = spark.createDataFrame([("s",), ("c0",), ("top",), ("s",), (None,)], "node string")
    run = lambda **b: {r["seed"]: (r["states"], r["depth"], r["status"]) for r in backward_states(df, "s", "t", seeds, **b).collect()}
    assert run() == {"s": (10, 2, "COMPLETE"), "c0": (7, 6, "COMPLETE"), "top": (1, 0, "COMPLETE")}
    assert run(most_states=9) == {"s": (9, 1, "INCOMPLETE"), "c0": (7, 6, "COMPLETE"), "top": (1, 0, "COMPLETE")}
    assert run(most_depth=3)["c0"] == (4, 3, "INCOMPLETE")


def test_paired_queries_of_dense_search(spark):
    from spanloom.operators.retrieval import dense_topk

    vectors = [(i, [float((i * 7) % 11), float(i % 5), 1.0]) for i in range(60)] + [(99, None)]
    df = spark.createDataFrame(vectors, "k bigint, v array<float>")
    asked = df.where("k % 4 = 0").withColumnRenamed("k", "q")
    got = {(r["q"], r["rank"]): (r["k"], r["score"]) for r in dense_topk(df, "k", "v", asked, "q", 3, block=4, slab=7).collect()}
    by = dict(vectors)
    for q in range(0, 60, 4):
        best = sorted(((-round(sum(a * b for a, b in zip(by[q], by[k])), 6), k) for k in range(60) if k != q))[:3]
        assert [got[q, n + 1] for n in range(3)] == [(k, -s) for s, k in best]
    assert len(got) == 45
