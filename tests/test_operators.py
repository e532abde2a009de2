"""Reference operators on small tables."""

from pyspark.sql import functions as F

from spanloom.functions import values as V
from spanloom.operators import aggregates as A
from spanloom.operators import graph as G
from spanloom.operators import joins as J


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_fallback_only_where_unique(spark):
    left = spark.createDataFrame([("f", 1, 1), ("f", 1, 3), ("g", 2, 9)], "t string, l int, a int")
    right = spark.createDataFrame([("f", 1, 1, "x"), ("f", 1, 2, "y"), ("g", 2, 1, "z")], "t string, l int, a int, v string")
    assert rows(J.fallback_join(left, right, ["t", "l", "a"], ["t", "l"], "v", "out").select("t", "a", "out")) == [("f", 1, "x"), ("f", 3, None), ("g", 9, "z")]


def test_longest_prefix_needs_whole_folders(spark):
    p = spark.createDataFrame([("/r/a/b/x.c",), ("/r/ab/x.c",), ("/q",)], "p string")
    r = spark.createDataFrame([("/r",), ("/r/a",), ("/r/a/b",)], "r string")
    assert rows(J.longest_prefix(p, "p", r, "r", "o")) == [("/q", None), ("/r/a/b/x.c", "/r/a/b"), ("/r/ab/x.c", "/r")]


def test_containing_across_buckets(spark):
    p = spark.createDataFrame([("f", 64), ("f", 200), ("f", 1000)], "k string, at int")
    i = spark.createDataFrame([("f", 1, 300, "big"), ("f", 64, 64, "dot"), ("f", 9, 3, "none")], "k string, a int, b int, n string")
    assert rows(J.containing(p, i, "k", "at", "a", "b").select("at", "n")) == [(200, "big"), (64, "big"), (64, "dot")]


def test_as_of_takes_last_before_or_at(spark):
    left = spark.createDataFrame([("h", 5), ("h", 1), ("g", 5)], "k string, at int")
    right = spark.createDataFrame([("h", 2, "a"), ("h", 5, "b"), ("h", 6, "c"), ("h", 4, None)], "k string, r int, v string")
    assert rows(J.as_of(left, right, ["k"], "at", "r", "v", "out")) == [("g", 5, None), ("h", 1, None), ("h", 5, "b")]


def test_c_integers(spark):
    texts = ["10", "0x1F", "-0x10", "017", "0b101", "12UL", "08", "x", "", None, "0", "99999999999999999999"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(V.c_int(F.col("t")))
    assert [r[0] for r in df.collect()] == [10, 31, -16, 15, 5, 12, None, None, None, None, 0, None]


def test_mode_prefers_first_on_ties_and_relations(spark):
    df = spark.createDataFrame([("k", "b", 1), ("k", "a", 2), ("k", "a", 3), ("k", "b", 4), ("k", None, 0)], "k string, v string, p int")
    assert rows(A.mode_first(df, ["k"], "v", "p")) == [("k", "b", 2)]
    sets = spark.createDataFrame([(["a"], ["a"]), (["a"], ["a", "b"]), (["a", "b"], ["a"]), (["a", "b"], ["b", "c"]), (["a"], ["c"]), (None, None)], "a array<string>, b array<string>")
    assert [r[0] for r in sets.select(A.set_relation(F.col("a"), F.col("b"))).collect()] == ["equal", "subset", "superset", "overlap", "disjoint", "equal"]


def test_reachability_ends_on_cycles_and_is_shortest(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), *[(f"n{i}", f"n{i + 1}") for i in range(11)], ("c", "n0"), (None, "x")], "s string, t string")
    got = dict(rows(G.reachable(e, "s", "t", spark.createDataFrame([("a",)], "node string"))))
    assert got["c"] == 1 and got["n11"] == 13 and len(got) == 15
    assert len(rows(G.reachable(e, "s", "t", spark.createDataFrame([("a",)], "node string"), 6))) == 8


def test_layers_paths_and_goals(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("x", "y"), ("y", "x"), ("z", "x"), ("a", "a")], "s string, t string")
    # the cycle x, y is one component, and z stands above it
    assert dict(rows(G.layers(e, "s", "t").select("node", "layer"))) == {"e": 0, "d": 1, "b": 2, "c": 2, "a": 3, "x": 0, "y": 0, "z": 1}
    start, end = spark.createDataFrame([("a",)], "node string"), spark.createDataFrame([("e",)], "node string")
    assert [r["path"] for r in G.simple_paths(e, "s", "t", start, end, 5).orderBy("path").collect()] == ["a/b/d/e", "a/c/d/e"]
    assert dict(rows(G.walk_counts(e.where("s <> t"), "s", "t", start, 4)))["e"] == 2
    facts = spark.createDataFrame([("e", "1"), ("x", "2")], "goal string, value string")
    assert rows(G.goal_values(e, "s", "t", facts)) == [("a", "1"), ("b", "1"), ("c", "1"), ("d", "1"), ("e", "1"), ("x", "2"), ("y", "2"), ("z", "2")]
