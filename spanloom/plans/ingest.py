"""Queries of the sources, sinks, C scans, formulas and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.cexpr import c_formula, without_parens
from spanloom.operators.csource import scanned
from spanloom.session import shared_folder
from spanloom.sources import snapshots as S
from spanloom.sources.tables import table
from spanloom.streaming import incremental as I

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


@query("s1_processes", "SELECT process_name, count(DISTINCT path) AS files, count(DISTINCT repository) AS repositories FROM source_files GROUP BY ALL")
def s1_processes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").groupBy("process_name").agg(F.countDistinct("path").alias("files"), F.countDistinct("repository").alias("repositories"))


@query("s3_collision_safe_names", """
WITH p AS (SELECT DISTINCT path, regexp_extract(path, '[^/]+$') AS base FROM source_files)
SELECT path, CASE WHEN count(*) OVER (PARTITION BY base) = 1 THEN base ELSE replace(path, '/', '__') END AS name FROM p
""")
def s3_collision_safe_names(spark, d):
    p = table(spark, d, "source_files").select("path").distinct().withColumn("base", F.regexp_extract("path", "([^/]+)$", 1))
    lone = p.groupBy("base").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("base", F.lit(True).alias("lone"))
    return p.join(lone, "base", "left").select("path", F.when(F.col("lone"), F.col("base")).otherwise(F.replace("path", F.lit("/"), F.lit("__"))).alias("name"))


@query("s6_build_flags", """
WITH f AS (SELECT process_name, 'D' AS flag, unnest(defines) AS x FROM preprocessor_configs UNION ALL SELECT process_name, 'U', unnest(undefines) FROM preprocessor_configs UNION ALL SELECT process_name, 'F', unnest(fallback_undefines) FROM preprocessor_configs),
n AS (SELECT DISTINCT process_name, flag, trim(split_part(regexp_replace(trim(x), '^-[DU]', ''), '=', 1)) AS symbol FROM f)
SELECT process_name, flag, symbol FROM n WHERE symbol <> '' AND NOT (flag = 'F' AND EXISTS (SELECT 1 FROM n o WHERE o.process_name = n.process_name AND o.flag = 'D' AND o.symbol = n.symbol))
""")
def s6_build_flags(spark, d):
    c = table(spark, d, "preprocessor_configs")
    one = lambda col, flag: c.select("process_name", F.lit(flag).alias("flag"), F.explode(col).alias("x"))
    rows = one("defines", "D").unionByName(one("undefines", "U")).unionByName(one("fallback_undefines", "F"))
    n = rows.select("process_name", "flag", F.trim(F.split_part(F.regexp_replace(F.trim("x"), "^-[DU]", ""), F.lit("="), F.lit(1))).alias("symbol")).where("symbol <> ''").distinct()
    # an explicit define beats a fallback undefine
    beaten = n.where("flag = 'D'").select("process_name", "symbol", F.lit("F").alias("flag"))
    return n.join(beaten, ["process_name", "symbol", "flag"], "left_anti").select("process_name", "flag", "symbol")


@query("s13_includes", r"""
WITH l AS (SELECT path, unnest(string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS line FROM (SELECT DISTINCT path, ltrim(content, chr(65279)) AS content FROM source_files WHERE content IS NOT NULL AND regexp_matches(path, '\.[ch]$')))
SELECT regexp_extract(line, '#[ \t]*include[ \t]*[<"]([^>"]+)[>"]', 1) AS included, count(DISTINCT path) AS files FROM l WHERE regexp_matches(line, '^[ \t]*#[ \t]*include[ \t]*[<"][^>"]+[>"]') GROUP BY ALL
""")
def s13_includes(spark, d):
    f = table(spark, d, "source_files").where(F.col("content").isNotNull() & F.col("path").rlike(r"\.[ch]$")).select("path", "content").distinct()
    names = F.regexp_extract_all(F.regexp_replace("content", "\r\n?", "\n"), F.lit(r'(?m)^\x{FEFF}?[ \t]*#[ \t]*include[ \t]*[<"]([^>"\n]+)[>"]'), F.lit(1))
    return f.select("path", F.explode(F.array_distinct(names)).alias("included")).groupBy("included").agg(F.countDistinct("path").alias("files"))


@query("s12_macros")
def s12_macros(spark, d):
    return scanned(table(spark, d, "source_files")).where("what = 'macro'").select("path", "name", "line", "detail").distinct()


@query("s14_functions")
def s14_functions(spark, d):
    return scanned(table(spark, d, "source_files")).where("what = 'function'").select("path", "name", F.col("line").alias("start_line"), "end_line").distinct()


@query("g1_call_scan")
def g1_call_scan(spark, d):
    return scanned(table(spark, d, "source_files")).where("what = 'call'").select("path", F.col("detail").alias("caller"), F.col("name").alias("callee"), "line").distinct()


@query("s15_snapshot_roundtrip", "SELECT process_name, count(*) AS functions, count(summary) AS with_summary FROM (SELECT DISTINCT process_name, id, summary FROM graph_functions WHERE process_name IS NOT NULL) GROUP BY ALL")
def s15_snapshot_roundtrip(spark, d):
    path = shared_folder(spark, "snapshots")
    S.write_snapshots(table(spark, d, "graph_functions").where("process_name is not null").distinct().repartition("process_name"), path, "process_name")
    read = S.read_snapshots(spark, path, "id string, summary string, process_name string")
    return read.select("process_name", "id", "summary").distinct().groupBy("process_name").agg(F.count(F.lit(1)).alias("functions"), F.count("summary").alias("with_summary"))


@query("s18_csv_roundtrip", "SELECT process_name, run_id, coalesce(CAST(function_count AS VARCHAR), '') AS function_count, '' AS lacking FROM (SELECT DISTINCT * FROM graph_runs)")
def s18_csv_roundtrip(spark, d):
    path = shared_folder(spark, "csv")
    S.write_csv(table(spark, d, "graph_runs").distinct(), path)
    return S.read_csv(spark, path, ["process_name", "run_id", "function_count", "lacking"])


@query("s19_grouped_index", "SELECT value, path, line FROM (SELECT DISTINCT value, path, line FROM discovery_records WHERE value IS NOT NULL)")
def s19_grouped_index(spark, d):
    r = table(spark, d, "discovery_records").where("value is not null").select("value", "path", "line")
    return S.flattened_index(S.grouped_index(r, "value", ["path", "line"]), "value", "path string, line int")


@query("v8_c_formulas", """
WITH n AS (SELECT DISTINCT TRY_CAST(resolved_value AS BIGINT) AS v FROM discovery_facts WHERE regexp_full_match(resolved_value, '[1-9][0-9]{0,8}'))
SELECT v, (v + 6) // 7 * 3 - 1 AS a, -((v) // 7) AS b, -(v % 7) AS c, CASE WHEN v > 5000 THEN v & 255 ELSE v << 2 END AS d FROM n
""")
def v8_c_formulas(spark, d):
    n = table(spark, d, "discovery_facts").where(F.col("resolved_value").rlike("^[1-9][0-9]{0,8}$")).select(F.col("resolved_value").cast("bigint").alias("v")).distinct()
    f = lambda form: c_formula(F.replace(F.lit(form), F.lit("v"), F.col("v").cast("string")))
    return n.select("v", f("(v + 6) / 7 * 3 - 1").alias("a"), f("-v / 7").alias("b"), f("-v % 7").alias("c"), f("v > 5000 ? v & 0xff : v << 2").alias("d"))


@query("pr6_bare_expressions", "SELECT DISTINCT arg_expression AS written, arg_expression AS bare FROM target_sites")
def pr6_bare_expressions(spark, d):
    e = table(spark, d, "target_sites").select(F.col("arg_expression").alias("written")).distinct()
    return e.select("written", without_parens(F.concat(F.lit("(("), F.col("written"), F.lit(") )"))).alias("bare"))


@query("t4_stream_upsert", """
SELECT held_by, record_id, loaded_at, path, line FROM (SELECT *, row_number() OVER (PARTITION BY held_by, record_id ORDER BY loaded_at DESC, path DESC NULLS LAST, line DESC NULLS LAST) AS rn FROM discovery_records) WHERE rn = 1
""")
def t4_stream_upsert(spark, d):
    full = table(spark, d, "discovery_records").schema
    schema = type(full)([f for f in full if f.name in ("held_by", "record_id", "loaded_at", "path", "line")])
    rows = I.latest_by_stream(spark, f"{d}/discovery_records.parquet", schema, ["held_by", "record_id"], ["loaded_at", "path", "line"])
    return rows.select("held_by", "record_id", "loaded_at", "path", "line")


@query("t5_event_windows", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def t5_event_windows(spark, d):
    full = table(spark, d, "events").schema
    return I.windowed_counts(spark, f"{d}/events.parquet", full, "ts", "event_type")


@query("t5_catalog_freshness", "SELECT count(*) AS n_rows FROM discovery_facts")
def t5_catalog_freshness(spark, d):
    """Rows of the files that a catalog has seen, each file once."""
    full = table(spark, d, "discovery_facts").schema
    return I.fresh_files(spark, f"{d}/discovery_facts.parquet", full).agg(F.sum("n_rows").alias("n_rows"))
