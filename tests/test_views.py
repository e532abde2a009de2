"""Scans of C, caches, sinks and questions of the views."""

from pyspark.sql import functions as F

from spanloom.functions import questions as Q
from spanloom.operators.csource import file_statics, occurrences
from spanloom.sources import cache as C

CODE = """#define f(x) x
int f(int a);
static int used = 1, *more;
static const char *names[2] = { "a", "b" };
static inline int g(void);
/* h(1) */
int f(int a)
{
    static int inner = 2;
    return g() + (int)sizeof(a);
}
int (*table[1])(int) = { f };
"""


def test_occurrences():
    assert occurrences(CODE) == [("f", "prototype", 2), ("g", "prototype", 5), ("f", "definition", 7), ("g", "call", 10)]
    assert occurrences("") == []


def test_file_statics():
    assert file_statics(CODE) == [("used", "int", 3), ("names", "const char *", 4)]


def test_cache_is_built_once_and_anew_after_a_change(spark, tmp_path):
    source, folder, built = str(tmp_path / "in"), f"file:{tmp_path}/cache", []

    def build():
        built.append(1)
        return spark.read.parquet(source).groupBy("k").count()

    spark.createDataFrame([(1,), (1,)], "k int").write.parquet(source)
    get = lambda **p: {tuple(r) for r in C.cached(spark, "t", [f"file:{source}"], build, folder, **p).collect()}
    assert get() == {(1, 2)} == get() and len(built) == 1
    assert get(kind="other") == {(1, 2)} and len(built) == 2
    spark.createDataFrame([(2,)], "k int").write.mode("append").parquet(source)
    assert get() == {(1, 2), (2, 1)} and len(built) == 3


def test_whole_writes_and_sections(spark, tmp_path):
    path = f"file:{tmp_path}/r.txt"
    C.write_whole(spark, path, "one")
    C.write_whole(spark, path, "two é")
    assert (tmp_path / "r.txt").read_text() == "two é" and not (tmp_path / "r.txt.staged").exists()
    text = C.with_section("# Report\n", "rates", "| a |")
    assert not C.is_stale(text, "rates", "| a |") and C.is_stale(text, "rates", "| b |")
    then = C.with_section(text + "tail\n", "rates", "| b |")
    assert "| b |" in then and "| a |" not in then and then.endswith("tail\n")


def test_intents(spark):
    rows = [("Who writes to Q_1?", 0, 1, "resource_writers"), ("who calls abc", 1, 0, "callers"), ("abc とは", 1, 0, "define"), ("how does a reach b", 2, 0, "reach"), ("how does main reach b", 1, 0, "from_entry"), ("Q_1", 0, 1, "resource"), ("hello", 0, 0, None), ("abc", 1, 0, None), (None, 1, 1, None)]
    df = spark.createDataFrame(rows, "q string, f int, r int, want string")
    assert df.select("want", Q.intent(F.col("q"), F.col("f"), F.col("r")).alias("got")).where("not (want <=> got)").count() == 0


def test_run_folders_are_never_taken_twice(spark, tmp_path):
    root = f"file:{tmp_path}/runs"
    assert [C.fresh_run_folder(spark, root, "r").rpartition("/")[2] for _ in range(3)] == ["r", "r-2", "r-3"]


def test_vectors(spark):
    from spanloom.functions.vectors import cosine, l2_norm, normalised

    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = df.select(l2_norm(F.col("a")).alias("n"), cosine(F.col("a"), F.col("b")).alias("c"), normalised(F.col("a")).alias("u")).collect()
    assert [(r["n"], round(r["c"], 9), r["u"]) for r in got] == [(5.0, 0.96, [0.6, 0.8]), (1.0, 0.0, [0.0, 0.0])]


def test_table_functions_in_sql(spark):
    from spanloom.functions.udtfs import register

    register(spark)
    spark.createDataFrame([(1, "int f(int a) { g(a, 2); return 0; }"), (2, None)], "k int, t string").createOrReplaceTempView("_c")
    rows = lambda q: sorted(map(tuple, spark.sql(q).collect()))
    assert rows("SELECT k, s.what, s.name FROM _c, LATERAL c_scan(t) s") == [(1, "call", "g"), (1, "function", "f")]
    assert rows("SELECT k, s.callee, s.position, s.argument FROM _c, LATERAL c_arguments(t) s") == [(1, "g", 1, "a"), (1, "g", 2, "2")]
    assert rows("SELECT * FROM retrieval_tokens('tank_level 水位計')") == [(1, "tank_level"), (2, "tank"), (3, "level"), (4, "水位"), (5, "位計")]
    assert ("sources", "a.c") in rows("SELECT * FROM make_inputs('OBJS = a.o')")
