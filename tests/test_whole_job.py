"""Queries over small tables that reach beyond what they were once cut at."""

import os
from collections import Counter
from datetime import datetime
from math import log

import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry
from spanloom.operators import graph as G


def run(spark, root, name):
    df = entry.queries()[name](spark, str(root))
    return sorted(map(tuple, df.collect()), key=str)


def calls(spark, root, edges):
    spark.createDataFrame(edges, "source string, target string, kind string").write.parquet(f"{root}/graph_calls.parquet")


def chain(name, n, kind="direct"):
    return [(f"{name}{i}", f"{name}{i + 1}", kind) for i in range(n)]


def test_reachability_classes_of_deep_functions(spark, tmp_path):
    # d20 is direct by 20 edges and a callback by 2; c15 is a callback by 15
    calls(spark, tmp_path, [*chain("d", 20), ("d1", "d20", "callback"), ("d0", "c0", "callback"), *chain("c", 14, "callback")])
    functions = [("d20", "p"), ("c14", "p"), ("away", "p"), ("d20x", None)]
    spark.createDataFrame(functions, "id string, process_name string").write.parquet(f"{tmp_path}/graph_functions.parquet")
    assert run(spark, tmp_path, "g3_callback_only") == sorted((f"c{i}",) for i in range(15))
    want = [("away", "UNREACHABLE_IN_PROCESS"), ("c14", "CALLBACK"), ("d20", "DIRECT_ROOT"), ("d20x", "OUT_OF_PROCESS_SCOPE")]
    assert run(spark, tmp_path, "g4_reachability_label") == sorted(want, key=str)


def test_reachability_of_deep_functions(spark, tmp_path):
    calls(spark, tmp_path, [*chain("d", 17), ("d17", "d3", "direct")])
    assert run(spark, tmp_path, "g2_reachability") == sorted(((f"d{i}", i) for i in range(18)), key=str)


def test_nearest_ancestor_far_above(spark, tmp_path):
    calls(spark, tmp_path, [*chain("d", 30), ("d0", "x", "callback"), ("d14", "y", "callback"), ("d30", "d0", "direct")])
    want = [(f"d{i}", "d0" if i < 14 else "d14", i if i < 14 else i - 14) for i in range(31)]
    assert run(spark, tmp_path, "g20_nearest_ancestor") == sorted(want, key=str)


def test_paths_of_thirteen_nodes(spark, tmp_path):
    edges = [*chain("a", 12), *chain("b", 13), ("a12", "end", "external_call"), ("a1", "end", "direct"), ("b12", "end", "external_call"), ("a11", "end", "direct")]
    calls(spark, tmp_path, edges)
    spark.createDataFrame([("end", "rtx_open", True)], "id string, name string, is_library_api boolean").write.parquet(f"{tmp_path}/graph_functions.parquet")
    got = [(r[0], r[3]) for r in run(spark, tmp_path, "g5_simple_paths")]
    # by a12 and by b12 a path has 14 nodes
    assert sorted(got) == [("a0", 2), ("a0", 12)]


def test_path_counts_over_long_paths_without_cycle_edges(spark, tmp_path):
    # the cycle x > y > z > x is entered at x; its edge z > x is ignored, x > z is not
    cycle = [("d20", "x", "direct"), ("x", "y", "direct"), ("y", "z", "direct"), ("x", "z", "direct"), ("z", "x", "callback"), ("z", "z", "direct"), ("z", "end", "direct")]
    calls(spark, tmp_path, [*chain("d", 20), ("d0", "d10", "direct"), *cycle])
    want = [*((f"d{i}", 1 if i < 10 else 2) for i in range(21)), ("x", 2), ("y", 2), ("z", 4), ("end", 4)]
    assert run(spark, tmp_path, "g18_path_counts") == sorted(want, key=str)


TOKENS = {
    1: ("tank_level alarm", ["tank_level", "tank", "level", "alarm"]),
    2: ("ＡＬＡＲＭ queue ４２", ["alarm", "queue", "42"]),
    3: ("readTank2Level(__x__, HTTPServer)", ["readtank2level", "read", "tank2", "level", "x", "httpserver"]),
    4: ("ﾎﾟﾝﾌﾟ停止 水 level", ["level", "ポン", "ンプ", "プ停", "停止", "水"]),
    5: ("alarmQueue alarm", ["alarmqueue", "alarm", "queue", "alarm"]),
    6: ("Unknown __ ?", ["unknown"]),
}


def test_retrieval_over_whole_tokens(spark, tmp_path):
    docs = [*((k, text) for k, (text, _) in TOKENS.items()), (7, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    bags = {k: Counter(ts) for k, (_, ts) in TOKENS.items()}
    df, cf = Counter(t for b in bags.values() for t in b), sum(bags.values(), Counter())
    assert run(spark, tmp_path, "r2_document_frequency") == sorted(((t, df[t], cf[t]) for t in df), key=str)

    mean = sum(cf.values()) / len(bags)
    want = []
    for query, asked in (("q1", ("alarm", "queue")), ("q2", ("tank", "level", "unknown"))):
        scores = {}
        for k, bag in bags.items():
            for t in asked:
                if bag[t]:
                    idf = log(1 + (len(bags) - df[t] + 0.5) / (df[t] + 0.5))
                    scores[k] = scores.get(k, 0) + idf * bag[t] * 2.4 / (bag[t] + 1.4 * (0.28 + 0.72 * bag.total() / mean))
        best = sorted(scores, key=lambda k: (-round(scores[k], 6), k))
        want += [(query, k, round(scores[k], 6), i) for i, k in enumerate(best, 1)]
    got = {(r["query"], r["doc_id"]): (r["score"], r["rank"]) for r in entry.queries()["r3_bm25_topk"](spark, str(tmp_path)).collect()}
    assert got.keys() == {(q, k) for q, k, _, _ in want}
    assert all(abs(got[q, k][0] - s) < 2e-6 and got[q, k][1] == i for q, k, s, i in want)
    fused = entry.queries()["r6_rank_fusion"](spark, str(tmp_path))
    assert {(r["query"], r["doc_id"]) for r in fused.collect()} == {(q, k) for q, k, _, _ in want}


def test_event_windows_of_rows_in_late_files(spark, tmp_path):
    # micro batches of 64, 64 and 1 files: the last file is 20 days older than the others, and has a row of their hour too
    old, new = datetime(2024, 1, 1, 5), datetime(2024, 1, 21, 5)
    files = [[(new.replace(minute=i % 60), "a")] for i in range(128)] + [[(old, "a"), (old, "a"), (old, "b"), (new, "a")]]
    path = tmp_path / "events.parquet"
    path.mkdir()
    for i, rows in enumerate(files):
        times, kinds = zip(*rows, strict=True)
        pq.write_table(pa.table({"ts": pa.array(times, pa.timestamp("us", "UTC")), "event_type": list(kinds)}), path / f"{i}.parquet")
        os.utime(path / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    assert run(spark, tmp_path, "t5_event_windows") == sorted([(old, "a", 2), (old, "b", 1), (new, "a", 129)], key=str)


def test_products_are_whole_or_unknown(spark, tmp_path):
    a, b = [f"D{i}" for i in range(9)], [f"U{i}" for i in range(5)]
    rows = [("wide", a, b[:2]), ("deep", a[:6], b), ("bound", a[:8], b[:4]), ("over", a, b[:4]), ("none", a, None)]
    spark.createDataFrame(rows, "process_name string, defines array<string>, undefines array<string>").write.parquet(f"{tmp_path}/preprocessor_configs.parquet")
    want = [(k, f"{x}|{y}") for k, xs, ys in rows[:3] for x in xs for y in ys]
    assert run(spark, tmp_path, "j15_bounded_product") == sorted([*want, ("over", None)], key=str)


def jobs_of(spark, group, f):
    spark.sparkContext.setJobGroup(group, group)
    try:
        return f(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_path_counts_need_no_round_for_each_level(spark, tmp_path):
    # 60 diamonds in a row: 120 levels, 2 ** 60 paths
    edges = [(f"n{i}", to, "direct") for i in range(60) for to in (f"a{i}", f"b{i}")] + [(f"{s}{i}", f"n{i + 1}", "direct") for i in range(60) for s in "ab"]
    calls(spark, tmp_path, edges)
    got, jobs = jobs_of(spark, "g18", lambda: dict(run(spark, tmp_path, "g18_path_counts")))
    assert got == {f"n{i}": 2**i for i in range(61)} | {f"{s}{i}": 2**i for i in range(60) for s in "ab"}
    assert jobs < 12


def test_path_counts_by_parts_and_level_are_those_of_one_task(spark, monkeypatch):
    # parts of 13, 6, 2 and 1 edges, one of them without a root, a lone start; 8 edges are too many for a task
    cycle = [("b", "c"), ("c", "d"), ("d", "b"), ("b", "d"), ("c", "c"), ("d", "e"), ("z", "b")]
    edges = [*[(f"m{i}", f"m{i + 1}") for i in range(11)], ("m0", "m5"), ("m7", "m6"), *cycle, ("x", "y"), ("y", "x"), ("p", "q"), ("q", None), (None, "q")]
    df = spark.createDataFrame(edges, "s string, t string")
    starts = spark.createDataFrame([("m0",), ("z",), ("p",), ("lone",), ("p",), (None,)], "node string")
    want = [*((f"m{i}", 1 if i < 5 else 2) for i in range(12)), ("z", 1), ("b", 1), ("c", 1), ("d", 2), ("e", 2), ("p", 1), ("q", 1), ("lone", 1)]
    for most in (G.ONE_TASK_EDGES, 8):
        monkeypatch.setattr(G, "ONE_TASK_EDGES", most)
        assert sorted(map(tuple, G.path_counts(df, "s", "t", starts).collect())) == sorted(want)


def test_weak_parts_of_long_ways(spark):
    # ways whose order is that of their ids, against it and mixed, in tasks of few edges; a ring, a self-edge
    ids = [f"k{i * 37 % 101:03}" for i in range(101)]
    edges = [*[(f"u{i:03}", f"u{i + 1:03}") for i in range(100)], *[(f"v{i + 1:03}", f"v{i:03}") for i in range(100)], *zip(ids, ids[1:]), ("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("self", "self"), (None, "u000")]
    got = sorted(map(tuple, G.weak_parts(spark.createDataFrame(edges, "s string, t string").repartition(40), "s", "t").collect()))
    assert got == sorted([*((f"{x}{i:03}", f"{x}000") for x in "uvk" for i in range(101)), ("r1", "r1"), ("r2", "r1"), ("r3", "r1")])


def test_backward_states_need_no_round_for_each_level(spark, tmp_path):
    calls(spark, tmp_path, [*chain("d", 100), *((f"d{i}", "api", "external_call") for i in (0, 40, 100)), ("away", "api", "external_call")])
    got, jobs = jobs_of(spark, "v19", lambda: run(spark, tmp_path, "v19_backward_states"))
    assert got == sorted([("away", 1, 0, "COMPLETE"), *((f"d{i}", i + 1, i, "COMPLETE") for i in (0, 40, 100))], key=str)
    assert jobs < 12


def test_backward_states_by_parts_and_level_are_those_of_one_task(spark, monkeypatch):
    # parts of 9, 4 and 2 edges; 8 edges are too many for a task
    edges = [*[(f"m{i + 1}", f"m{i}") for i in range(7)], ("m0", "m4"), ("n", "m1"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "c"), ("x", "c"), ("p", "q"), ("r", "q"), (None, "q")]
    df = spark.createDataFrame(edges, "s string, t string")
    seeds = spark.createDataFrame([("m0",), ("m7",), ("b",), ("q",), ("q",), ("lone",), (None,)], "node string")
    want = [("b", 4, 3, "COMPLETE"), ("lone", 1, 0, "COMPLETE"), ("m0", 6, 4, "INCOMPLETE"), ("m7", 1, 0, "COMPLETE"), ("q", 3, 1, "COMPLETE")]
    for most in (G.ONE_TASK_EDGES, 8):
        monkeypatch.setattr(G, "ONE_TASK_EDGES", most)
        assert sorted(map(tuple, G.backward_states(df, "s", "t", seeds, most_depth=4).collect())) == want
