"""The general data problems (pN_) of the core and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.text import plain_path, plain_value
from spanloom.operators.copies import copy_differences
from spanloom.operators.hierarchy import hierarchy, several_parents
from spanloom.operators.orphans import orphan_references
from spanloom.operators.snapshots import snapshot_changes
from spanloom.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    fields = {"path": plain_path(F.col("path")), "line": F.col("line"), "operation": F.col("operation"), "value": plain_value(F.col("value"))}
    return copy_differences(table(spark, d, "discovery_records"), "record_id", "held_by", ("scan", "flow"), "loaded_at", fields)


def p2_by_process(spark: SparkSession, d: str) -> DataFrame:
    """Differences counted per kind."""
    return p2_found(spark, d).groupBy("difference").agg(F.count(F.lit(1)).alias("records"))


def _direct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "graph_calls").where("kind = 'direct'").select("source", "target")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(_direct(spark, d), "source", "target").select(F.col("node").alias("function_id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"))


def p3_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Each function's full path, depth and root, and its descendants as a nested-set range."""
    h = hierarchy(_direct(spark, d), "source", "target", paths=True)
    return h.select(
        F.col("node").alias("function_id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"),
        F.array_join("path", "/").alias("path"), "pre", "last", (F.col("size") - 1).alias("n_descendants"),
    )


def p3_several_parents(spark: SparkSession, d: str) -> DataFrame:
    """Links that the hierarchy leaves out, as their function hangs below another parent."""
    return several_parents(_direct(spark, d), "source", "target").select(F.col("node").alias("function_id"), F.col("kept").alias("kept_parent"), F.col("dropped").alias("dropped_parent"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "discovery_facts").select("fact_id", "target_site_file", "target_site_line", "recorded_at")
    sites = table(spark, d, "target_sites").select("site_file", "site_line", "first_seen_at", "deleted_at")
    return orphan_references(
        facts, sites,
        {"file": plain_path(F.col("target_site_file")), "line": F.col("target_site_line").cast("int")},
        {"file": plain_path(F.col("site_file")), "line": F.col("site_line").cast("int")},
        "recorded_at", "first_seen_at", "deleted_at", "target_sites",
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("fact_id", "reason").distinct()


def p6_by_month(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per parent table, month of recording and reason; exact copies count once."""
    rows = _orphans(spark, d).select("parent_table", "fact_id", F.date_format("recorded_at", "yyyy-MM").alias("month"), "reason").distinct()
    return rows.groupBy("parent_table", "month", "reason").agg(F.count(F.lit(1)).alias("orphans"))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(
        table(spark, d, "graph_runs"), table(spark, d, "run_functions"), ["results_set", "process_name"], "run_id", "generated_at",
        "function_count", "function_id", ["name", "file", "start_line", "end_line", "source_sha256"],
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d).drop("fields")


def p7_fields(spark: SparkSession, d: str) -> DataFrame:
    """The fields that differ of each changed record."""
    return _changes(spark, d).select("results_set", "process_name", "run_id", "function_id", F.explode("fields").alias("field"))


def p7_by_run(spark: SparkSession, d: str) -> DataFrame:
    """Changes counted per run and kind."""
    return p7_found(spark, d).groupBy("results_set", "process_name", "run_id", "change").agg(F.count(F.lit(1)).alias("functions"))


PATH = r"regexp_replace(replace({0}, '\', '/'), '^\.//?', '')"

P2 = r"""
WITH last AS (
  SELECT * FROM (
    SELECT held_by, record_id, regexp_replace(replace(path, '\', '/'), '^\.//?', '') AS path, line, operation, nullif(trim(value), '') AS value,
           row_number() OVER (PARTITION BY held_by, record_id ORDER BY loaded_at DESC NULLS LAST, path DESC, line DESC, operation DESC, value DESC) AS rn
    FROM discovery_records WHERE held_by IN ('scan', 'flow')) WHERE rn = 1),
s AS (SELECT * FROM last WHERE held_by = 'scan'),
f AS (SELECT * FROM last WHERE held_by = 'flow'),
j AS (
  SELECT coalesce(s.record_id, f.record_id) AS record_id, s.held_by AS hs, f.held_by AS hf,
         s.path AS p1, f.path AS p2, s.line AS l1, f.line AS l2, s.operation AS o1, f.operation AS o2, s.value AS v1, f.value AS v2
  FROM s FULL JOIN f ON s.record_id IS NOT DISTINCT FROM f.record_id)
SELECT record_id, 'only_scan' AS difference FROM j WHERE hf IS NULL
UNION ALL SELECT record_id, 'only_flow' FROM j WHERE hs IS NULL
UNION ALL SELECT record_id, 'path' FROM j WHERE hs IS NOT NULL AND hf IS NOT NULL AND p1 IS DISTINCT FROM p2
UNION ALL SELECT record_id, 'line' FROM j WHERE hs IS NOT NULL AND hf IS NOT NULL AND l1 IS DISTINCT FROM l2
UNION ALL SELECT record_id, 'operation' FROM j WHERE hs IS NOT NULL AND hf IS NOT NULL AND o1 IS DISTINCT FROM o2
UNION ALL SELECT record_id, 'value' FROM j WHERE hs IS NOT NULL AND hf IS NOT NULL AND v1 IS DISTINCT FROM v2
"""

P3_CORE = """
WITH RECURSIVE e AS (
  SELECT DISTINCT source AS p, target AS c FROM graph_calls WHERE kind = 'direct' AND source IS NOT NULL AND target IS NOT NULL),
nodes AS (SELECT p AS n FROM e UNION SELECT c FROM e),
looped AS (SELECT c AS n FROM e WHERE p = c),
par AS (SELECT c AS n, min(p) AS up FROM e WHERE p <> c AND c NOT IN (SELECT n FROM looped) GROUP BY c),
walk AS (
  SELECT n AS root_id, n AS function_id, 0 AS depth, n AS path FROM nodes WHERE n NOT IN (SELECT c FROM e)
  UNION ALL SELECT w.root_id, par.n, w.depth + 1, w.path || '/' || par.n FROM walk w JOIN par ON par.up = w.function_id),
stuck AS (SELECT n FROM nodes WHERE n NOT IN (SELECT function_id FROM walk)),
ring AS (
  SELECT n AS start, n AS cur, 0 AS hop FROM stuck
  UNION ALL SELECT r.start, par.up, r.hop + 1 FROM ring r JOIN par ON par.n = r.cur WHERE r.hop < 200 AND (r.hop = 0 OR r.cur <> r.start)),
on_cycle AS (
  SELECT n AS start, n AS low FROM looped
  UNION ALL SELECT start, min(cur) FROM ring WHERE start IN (SELECT start FROM ring WHERE hop > 0 AND cur = start) AND start NOT IN (SELECT n FROM looped) GROUP BY start),
below AS (
  SELECT r.start, arg_min(o.low, r.hop) AS low FROM ring r JOIN on_cycle o ON o.start = r.cur
  WHERE r.start NOT IN (SELECT start FROM on_cycle) GROUP BY r.start)
"""

P3 = P3_CORE + """
SELECT function_id, root_id, depth FROM walk
UNION ALL SELECT start, low, -1 FROM on_cycle
UNION ALL SELECT start, low, -2 FROM below
"""

P3_HIERARCHY = P3_CORE + """,
above AS (SELECT function_id AS n, function_id AS a FROM walk UNION ALL SELECT above.n, par.up FROM above JOIN par ON par.n = above.a),
sized AS (SELECT a AS n, count(*) AS size FROM above GROUP BY ALL),
off AS (
  SELECT par.n, par.up, 1 + coalesce(sum(size) OVER (PARTITION BY par.up ORDER BY md5(par.n), par.n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM par JOIN sized ON sized.n = par.n),
placed AS (
  SELECT function_id AS n, 0::HUGEINT AS pre FROM walk WHERE depth = 0
  UNION ALL SELECT off.n, placed.pre + off.off FROM placed JOIN off ON off.up = placed.n)
SELECT w.function_id, w.root_id, w.depth, w.path, p.pre::BIGINT AS pre, (p.pre + s.size - 1)::BIGINT AS last, s.size - 1 AS n_descendants
FROM walk w JOIN placed p ON p.n = w.function_id JOIN sized s ON s.n = w.function_id
UNION ALL SELECT start, low, -1, NULL, NULL, NULL, NULL FROM on_cycle
UNION ALL SELECT start, low, -2, NULL, NULL, NULL, NULL FROM below
"""

P3_SEVERAL = """
WITH e AS (SELECT DISTINCT source AS p, target AS c FROM graph_calls WHERE kind = 'direct' AND source IS NOT NULL AND target IS NOT NULL),
k AS (SELECT c, CASE WHEN bool_or(p = c) THEN c ELSE min(p) END AS kept FROM e GROUP BY c)
SELECT e.c AS function_id, k.kept AS kept_parent, e.p AS dropped_parent FROM e JOIN k ON k.c = e.c WHERE e.p <> k.kept
"""

P6_CORE = r"""
WITH s AS (
  SELECT regexp_replace(replace(site_file, '\', '/'), '^\.//?', '') AS file, site_line AS line, min(coalesce(first_seen_at, '-infinity'::TIMESTAMP)) AS first,
         max(coalesce(deleted_at, 'infinity'::TIMESTAMP)) AS last
  FROM target_sites WHERE site_file IS NOT NULL AND site_line IS NOT NULL GROUP BY ALL),
f AS (
  SELECT DISTINCT fact_id, recorded_at, regexp_replace(replace(target_site_file, '\', '/'), '^\.//?', '') AS file, target_site_line AS line
  FROM discovery_facts WHERE target_site_file IS NOT NULL AND target_site_line IS NOT NULL),
o AS (
  SELECT fact_id, recorded_at, CASE WHEN s.file IS NULL THEN 'missing' WHEN s.first > recorded_at THEN 'later' WHEN s.last <= recorded_at THEN 'deleted' END AS reason
  FROM f LEFT JOIN s ON s.file = f.file AND s.line = f.line)
"""

P7 = """
WITH m AS (SELECT results_set, process_name, run_id, max(generated_at) AS made, max(function_count) AS n FROM graph_runs GROUP BY ALL),
r AS (SELECT DISTINCT * FROM run_functions),
c AS (SELECT results_set, process_name, run_id, count(DISTINCT function_id) AS n FROM r GROUP BY ALL),
w AS (
  SELECT m.*, lag(m.run_id) OVER (PARTITION BY m.results_set, m.process_name ORDER BY made, m.run_id) AS prev
  FROM m JOIN c USING (results_set, process_name, run_id) WHERE m.n = c.n),
cur AS (SELECT w.results_set, w.process_name, w.run_id AS run, r.* EXCLUDE (results_set, process_name) FROM w JOIN r USING (results_set, process_name, run_id) WHERE w.prev IS NOT NULL),
old AS (SELECT w.results_set, w.process_name, w.run_id AS run, r.* EXCLUDE (results_set, process_name)
        FROM w JOIN r ON r.results_set = w.results_set AND r.process_name = w.process_name AND r.run_id = w.prev),
j AS (
  SELECT coalesce(cur.results_set, old.results_set) AS results_set, coalesce(cur.process_name, old.process_name) AS process_name,
         coalesce(cur.run, old.run) AS run_id, coalesce(cur.function_id, old.function_id) AS function_id,
         CASE WHEN old.run IS NULL THEN 'added' WHEN cur.run IS NULL THEN 'removed'
              WHEN cur.name IS DISTINCT FROM old.name OR cur.file IS DISTINCT FROM old.file OR cur.start_line IS DISTINCT FROM old.start_line
                OR cur.end_line IS DISTINCT FROM old.end_line OR cur.source_sha256 IS DISTINCT FROM old.source_sha256 THEN 'changed' END AS change
  FROM cur FULL JOIN old ON cur.results_set = old.results_set AND cur.process_name = old.process_name AND cur.run = old.run AND cur.function_id = old.function_id)
"""

QUERIES = {
    "p2_found": (p2_found, P2),
    "p2_by_kind": (p2_by_process, f"SELECT difference, count(*) AS records FROM ({P2}) GROUP BY ALL"),
    "p3_found": (p3_found, P3),
    "p3_hierarchy": (p3_hierarchy, P3_HIERARCHY),
    "p3_several_parents": (p3_several_parents, P3_SEVERAL),
    "p6_found": (p6_found, P6_CORE + "SELECT DISTINCT fact_id, reason FROM o WHERE reason IS NOT NULL"),
    "p6_by_month": (
        p6_by_month,
        P6_CORE + "SELECT 'target_sites' AS parent_table, strftime(recorded_at, '%Y-%m') AS month, reason, count(DISTINCT fact_id) AS orphans FROM o WHERE reason IS NOT NULL GROUP BY ALL",
    ),
    "p7_found": (p7_found, P7 + "SELECT results_set, process_name, run_id, function_id, change FROM j WHERE change IS NOT NULL"),
    "p7_fields": (
        p7_fields,
        P7.rstrip().removesuffix(")").rstrip() + """),
x AS (
  SELECT cur.results_set, cur.process_name, cur.run AS run_id, cur.function_id, unnest([
    CASE WHEN cur.name IS DISTINCT FROM old.name THEN 'name' END, CASE WHEN cur.file IS DISTINCT FROM old.file THEN 'file' END,
    CASE WHEN cur.start_line IS DISTINCT FROM old.start_line THEN 'start_line' END, CASE WHEN cur.end_line IS DISTINCT FROM old.end_line THEN 'end_line' END,
    CASE WHEN cur.source_sha256 IS DISTINCT FROM old.source_sha256 THEN 'source_sha256' END]) AS field
  FROM cur JOIN old ON cur.results_set = old.results_set AND cur.process_name = old.process_name AND cur.run = old.run AND cur.function_id = old.function_id)
SELECT * FROM x WHERE field IS NOT NULL""",
    ),
    "p7_by_run": (p7_by_run, P7 + "SELECT results_set, process_name, run_id, change, count(*) AS functions FROM j WHERE change IS NOT NULL GROUP BY ALL"),
}
