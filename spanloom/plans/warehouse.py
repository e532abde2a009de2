"""Queries of the code-graph warehouse: indexes, comparisons, corpora, graphs, retrieval; each with its SQL.

Exact copies of rows count once, as everywhere in this project.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import values as V
from spanloom.functions.text import plain_path, plain_value, stable_id
from spanloom.operators import aggregates as A
from spanloom.operators import graph as G
from spanloom.operators import joins as J
from spanloom.operators import retrieval as R
from spanloom.sources.tables import table

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def once(df: DataFrame) -> DataFrame:
    """Exact copies of rows once, told by 128 bits of hashes over all columns and where they are null.

    Unlike a distinct over all columns it shuffles only these hashes and the columns that are used later.
    """
    marks = [x for c in df.columns for x in (F.col(c), F.col(c).isNull())]
    keyed = df.withColumns({"_h": F.xxhash64(*marks), "_g": F.xxhash64(F.lit(7), *marks)})
    return keyed.dropDuplicates(["_h", "_g"]).drop("_h", "_g")


def _with_site(f):
    return f.withColumns({"file": plain_path(F.col("target_site_file")), "line": F.col("target_site_line")})


def _facts(spark, d):
    return _with_site(once(table(spark, d, "discovery_facts")))


def _all_facts(spark, d):
    """The facts with their exact copies, where these change nothing."""
    return _with_site(table(spark, d, "discovery_facts"))


def _all_sites(spark, d):
    return table(spark, d, "target_sites").withColumns({"file": plain_path(F.col("site_file")), "line": F.col("site_line")})


def _sites(spark, d):
    return once(table(spark, d, "target_sites")).withColumns({"file": plain_path(F.col("site_file")), "line": F.col("site_line")})


def _all_records(spark, d):
    return table(spark, d, "discovery_records").withColumns({"path": plain_path(F.col("path")), "value": plain_value(F.col("value"))})


def _records(spark, d):
    return once(table(spark, d, "discovery_records")).withColumns({"path": plain_path(F.col("path")), "value": plain_value(F.col("value"))})


def _functions(spark, d):
    return once(table(spark, d, "graph_functions"))


def _calls(spark, d):
    return once(table(spark, d, "graph_calls"))


FACTS = r"(SELECT *, regexp_replace(replace(target_site_file, '\', '/'), '^\.//?', '') AS file, target_site_line AS line FROM (SELECT DISTINCT * FROM discovery_facts))"
SITES = r"(SELECT *, regexp_replace(replace(site_file, '\', '/'), '^\.//?', '') AS file, site_line AS line FROM (SELECT DISTINCT * FROM target_sites))"
RECORDS = r"(SELECT * REPLACE (regexp_replace(replace(path, '\', '/'), '^\.//?', '') AS path, nullif(trim(value), '') AS value) FROM (SELECT DISTINCT * FROM discovery_records))"
FUNCTIONS = "(SELECT DISTINCT * FROM graph_functions)"
CALLS = "(SELECT DISTINCT * FROM graph_calls)"


# ---- joins


@query("j1_fallback_join", f"""
WITH f AS (SELECT * FROM {FACTS}), s AS (SELECT * FROM {SITES}),
e AS (SELECT target_function, file, line, arg_index, min(arg_expression) AS x FROM s GROUP BY ALL),
l AS (SELECT target_function, file, line, min(arg_expression) AS x FROM s GROUP BY ALL HAVING count(*) = 1)
SELECT f.fact_id, f.target_function, coalesce(e.x, l.x) AS site_expression
FROM f LEFT JOIN e USING (target_function, file, line, arg_index) LEFT JOIN l ON l.target_function = f.target_function AND l.file = f.file AND l.line = f.line
""")
def j1_fallback_join(spark: SparkSession, d: str) -> DataFrame:
    full, short = ["target_function", "file", "line", "arg_index"], ["target_function", "file", "line"]
    return J.fallback_join(_facts(spark, d), _sites(spark, d), full, short, "arg_expression", "site_expression").select("fact_id", "target_function", "site_expression")


@query("j2_anti_completion", f"""
WITH f AS (SELECT DISTINCT target_function, file, line, status FROM {FACTS} WHERE file IS NOT NULL AND line IS NOT NULL),
s AS (SELECT DISTINCT target_function, file, line FROM {SITES})
SELECT target_function, status, count(*) AS sites FROM (
  SELECT target_function, status FROM f
  UNION ALL SELECT target_function, 'UNREACHABLE' FROM s WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.target_function = s.target_function AND f.file = s.file AND f.line = s.line))
GROUP BY ALL
""")
def j2_anti_completion(spark, d):
    keys = ["target_function", "file", "line"]
    facts = _all_facts(spark, d).where("file is not null and line is not null").select(*keys, "status").distinct()
    rows = J.completed(facts, _all_sites(spark, d).select(*keys).distinct(), keys, status=F.lit("UNREACHABLE"))
    return rows.groupBy("target_function", "status").agg(F.count(F.lit(1)).alias("sites"))


@query("j3_shared_resources", f"""
SELECT resource, value, count(DISTINCT process_name) AS processes, count(*) AS interactions, string_agg(DISTINCT operation, ',' ORDER BY operation) AS operations, count(DISTINCT process_name) > 1 AS is_cross_process
FROM {RECORDS} WHERE value IS NOT NULL GROUP BY resource, value
""")
def j3_shared_resources(spark, d):
    r = _records(spark, d).where("value is not null")
    return r.groupBy("resource", "value").agg(
        F.countDistinct("process_name").alias("processes"), F.count(F.lit(1)).alias("interactions"), F.array_join(F.array_sort(F.collect_set("operation")), ",").alias("operations")
    ).withColumn("is_cross_process", F.col("processes") > 1)


@query("j4_prefix_owner", f"""
WITH roots AS (SELECT DISTINCT 'cells/' || replace(process_name, 'proc_', '') AS root FROM source_files
               UNION SELECT DISTINCT 'cells/' || replace(process_name, 'proc_', '') || '/lib' FROM source_files),
p AS (SELECT DISTINCT file FROM {SITES} WHERE file IS NOT NULL),
m AS (SELECT p.file, r.root, row_number() OVER (PARTITION BY p.file ORDER BY length(r.root) DESC NULLS LAST) AS rn
      FROM p LEFT JOIN roots r ON p.file = r.root OR starts_with(p.file, r.root || '/'))
SELECT root AS owner, count(*) AS files FROM m WHERE rn = 1 GROUP BY ALL
""")
def j4_prefix_owner(spark, d):
    base = F.concat(F.lit("cells/"), F.regexp_replace("process_name", "proc_", ""))
    names = table(spark, d, "source_files").select(base.alias("root")).distinct()
    roots = names.unionByName(names.select(F.concat("root", F.lit("/lib")).alias("root")))
    paths = _all_sites(spark, d).select("file").where("file is not null").distinct()
    return J.longest_prefix(paths, "file", roots, "root", "owner").groupBy("owner").agg(F.count(F.lit(1)).alias("files"))


@query("j5_owner_status", f"""
WITH o AS (SELECT file, line, arg_index, CASE WHEN bool_or(status = 'EXACT') THEN 'resolved' ELSE 'present' END AS owner_status FROM {FACTS} WHERE resolver = 'VALUE_FLOW' AND file IS NOT NULL GROUP BY ALL)
SELECT coalesce(o.owner_status, 'absent') AS owner_status, s.target_function, count(*) AS sites
FROM (SELECT DISTINCT target_function, file, line, arg_index FROM {SITES}) s LEFT JOIN o USING (file, line, arg_index) GROUP BY ALL
""")
def j5_owner_status(spark, d):
    keys = ["file", "line", "arg_index"]
    owner = _facts(spark, d).where("resolver = 'VALUE_FLOW' and file is not null").groupBy(*keys).agg(F.when(F.bool_or(F.col("status") == "EXACT"), "resolved").otherwise("present").alias("owner_status"))
    sites = _all_sites(spark, d).select("target_function", *keys).distinct()
    return sites.join(owner, keys, "left").groupBy(F.coalesce("owner_status", F.lit("absent")).alias("owner_status"), "target_function").agg(F.count(F.lit(1)).alias("sites"))


@query("j6_containment", f"""
SELECT s.file, s.line, s.target_function, f.id AS function_id
FROM (SELECT DISTINCT file, line, target_function FROM {SITES}) s JOIN (SELECT DISTINCT id, file, start_line, end_line FROM graph_functions WHERE start_line > 0) f ON f.file = s.file AND s.line BETWEEN f.start_line AND f.end_line
""")
def j6_containment(spark, d):
    sites = _all_sites(spark, d).select("file", "line", "target_function").distinct()
    spans = table(spark, d, "graph_functions").where("start_line > 0").select(F.col("id").alias("function_id"), "file", "start_line", "end_line").distinct()
    return J.containing(sites, spans, "file", "line", "start_line", "end_line").select("file", "line", "target_function", "function_id")


@query("j7_asof_previous_run", """
WITH r AS (SELECT DISTINCT * FROM graph_runs), f AS (SELECT DISTINCT process_name, loaded_at, record_id, held_by FROM discovery_records)
SELECT f.held_by, f.record_id, f.loaded_at, r.run AS latest_run FROM f ASOF LEFT JOIN (SELECT process_name, generated_at, max(run_id) AS run FROM r GROUP BY ALL) r ON f.process_name = r.process_name AND f.loaded_at >= r.generated_at
""")
def j7_asof_previous_run(spark, d):
    runs = table(spark, d, "graph_runs").groupBy("process_name", "generated_at").agg(F.max("run_id").alias("run"))
    rows = table(spark, d, "discovery_records").select("process_name", "loaded_at", "record_id", "held_by").distinct()
    return J.as_of(rows, runs, ["process_name"], "loaded_at", "generated_at", "run", "latest_run").select("held_by", "record_id", "loaded_at", "latest_run")


@query("j9_callers_callees", f"""
SELECT c.kind, a.name AS caller, coalesce(b.name, c.target) AS callee, count(DISTINCT c.line) AS lines
FROM {CALLS} c JOIN (SELECT DISTINCT id, name FROM graph_functions) a ON a.id = c.source LEFT JOIN (SELECT DISTINCT id, name FROM graph_functions) b ON b.id = c.target
WHERE c.target IS NOT NULL GROUP BY ALL
""")
def j9_callers_callees(spark, d):
    names = table(spark, d, "graph_functions").select("id", "name").distinct()
    c = _calls(spark, d).where("target is not null")
    rows = c.join(names.select(F.col("id").alias("source"), F.col("name").alias("caller")), "source").join(names.select(F.col("id").alias("target"), F.col("name").alias("to")), "target", "left")
    return rows.groupBy("kind", "caller", F.coalesce("to", "target").alias("callee")).agg(F.countDistinct("line").alias("lines"))


@query("j10_ranked_function_lookup", f"""
WITH f AS (SELECT DISTINCT id, name, file, start_line, process_name FROM graph_functions WHERE file IS NOT NULL),
r AS (SELECT DISTINCT name, file, start_line, process_name FROM run_functions)
SELECT r.name, r.file, r.start_line, r.process_name, coalesce(a.id, b.id, c.id) AS function_id FROM r
LEFT JOIN (SELECT name, file, start_line, min(id) AS id FROM f GROUP BY ALL) a USING (name, file, start_line)
LEFT JOIN (SELECT name, file, min(id) AS id FROM f GROUP BY ALL) b ON b.name = r.name AND b.file = r.file
LEFT JOIN (SELECT name, process_name, min(id) AS id FROM f GROUP BY ALL) c ON c.name = r.name AND c.process_name = r.process_name
""")
def j10_ranked_function_lookup(spark, d):
    f = table(spark, d, "graph_functions").where("file is not null").select(F.col("id"), "name", "file", "start_line", "process_name").distinct()
    r = table(spark, d, "run_functions").select("name", "file", "start_line", "process_name").distinct()
    return J.ranked_match(r, "name", [(f, ["name", "file", "start_line"]), (f, ["name", "file"]), (f, ["name", "process_name"])], "id", "function_id").select("name", "file", "start_line", "process_name", "function_id")


@query("j14_correlated_product", f"""
WITH f AS (SELECT DISTINCT file, line, arg_index, resolved_value FROM {FACTS} WHERE file IS NOT NULL AND line IS NOT NULL AND nullif(resolved_value, '') IS NOT NULL)
SELECT a.file, a.line, a.resolved_value AS first_value, b.resolved_value AS second_value FROM f a JOIN f b ON a.file = b.file AND a.line = b.line WHERE a.arg_index = 1 AND b.arg_index = 2
""")
def j14_correlated_product(spark, d):
    f = _all_facts(spark, d).where("file is not null and line is not null and nullif(resolved_value, '') is not null").select("file", "line", "arg_index", "resolved_value").distinct()
    a = f.where("arg_index = 1").select("file", "line", F.col("resolved_value").alias("first_value"))
    return a.join(f.where("arg_index = 2").select("file", "line", F.col("resolved_value").alias("second_value")), ["file", "line"])


@query("j15_bounded_product", """
WITH x AS (SELECT process_name, list_sort(list_distinct([trim(v) FOR v IN coalesce(defines, []) IF trim(v) <> ''])) AS a, list_sort(list_distinct([trim(v) FOR v IN coalesce(undefines, []) IF trim(v) <> ''])) AS b FROM preprocessor_configs)
SELECT process_name, p || '|' || q AS pair FROM (SELECT process_name, unnest(a) AS p, b FROM x WHERE len(a) * len(b) <= 32), unnest(b) AS t(q) UNION ALL SELECT process_name, NULL FROM x WHERE len(a) * len(b) > 32
""")
def j15_bounded_product(spark, d):
    clean = lambda c: F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")))
    x = table(spark, d, "preprocessor_configs").select("process_name", clean(F.col("defines")).alias("a"), clean(F.col("undefines")).alias("b"))
    pairs = F.flatten(F.transform("a", lambda p: F.transform(F.col("b"), lambda q: F.concat(p, F.lit("|"), q))))
    # a product of more than 32 is unknown, one row without a pair; it is never cut
    unknown = F.array(F.lit(None).cast("string"))
    return x.select("process_name", F.explode(F.when(F.size("a") * F.size("b") > 32, unknown).otherwise(pairs)).alias("pair"))


SCAN_FLOW = f"""
WITH s AS (SELECT path, line, list_sort(list(DISTINCT value) FILTER (value IS NOT NULL)) AS v FROM {RECORDS} WHERE held_by = 'scan' GROUP BY ALL),
f AS (SELECT path, line, list_sort(list(DISTINCT value) FILTER (value IS NOT NULL)) AS v FROM {RECORDS} WHERE held_by = 'flow' GROUP BY ALL),
j AS (SELECT coalesce(s.path, f.path) AS path, coalesce(s.line, f.line) AS line, coalesce(s.v, []) AS a, coalesce(f.v, []) AS b, s.path IS NOT NULL AS in_scan, f.path IS NOT NULL AS in_flow
      FROM s FULL JOIN f ON s.path = f.path AND s.line = f.line)
"""


def _scan_flow(spark, d):
    r = _records(spark, d)
    side = lambda who, v: r.where(F.col("held_by") == who).groupBy("path", "line").agg(F.collect_set("value").alias(v), F.lit(True).alias(f"in_{who}"))
    j = side("scan", "a").join(side("flow", "b"), ["path", "line"], "full_outer")
    none = F.array().cast("array<string>")
    return j.withColumns({"a": F.coalesce("a", none), "b": F.coalesce("b", none), "in_scan": F.coalesce("in_scan", F.lit(False)), "in_flow": F.coalesce("in_flow", F.lit(False))})


@query("j16_index_full_outer", SCAN_FLOW + "SELECT path, line, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS only_scan, len(list_filter(b, lambda x: NOT list_contains(a, x))) AS only_flow, len(list_filter(a, lambda x: list_contains(b, x))) AS shared FROM j")
def j16_index_full_outer(spark, d):
    j = _scan_flow(spark, d)
    size = lambda c: F.size(c).cast("bigint")
    return j.select("path", "line", size(F.array_except("a", "b")).alias("only_scan"), size(F.array_except("b", "a")).alias("only_flow"), size(F.array_intersect("a", "b")).alias("shared"))


@query("j17_raw_disagreement", f"""
WITH x AS (SELECT record_id, held_by, string_agg(DISTINCT coalesce(raw, ''), '|' ORDER BY coalesce(raw, '')) AS raws FROM {RECORDS} GROUP BY ALL)
SELECT a.record_id, a.raws AS scan_raw, b.raws AS flow_raw FROM x a JOIN x b USING (record_id) WHERE a.held_by = 'scan' AND b.held_by = 'flow' AND a.raws <> b.raws
""")
def j17_raw_disagreement(spark, d):
    raws = F.array_join(F.array_sort(F.collect_set(F.coalesce("raw", F.lit("")))), "|")
    x = _records(spark, d).groupBy("record_id").agg(
        *[F.array_join(F.array_sort(F.collect_set(F.when(F.col("held_by") == who, F.coalesce("raw", F.lit(""))))), "|").alias(f"{who}_raw") for who in ("scan", "flow")],
        *[F.bool_or(F.col("held_by") == who).alias(f"in_{who}") for who in ("scan", "flow")],
    )
    del raws
    return x.where("in_scan and in_flow and scan_raw <> flow_raw").select("record_id", "scan_raw", "flow_raw")


@query("j18_semi_members", f"SELECT target_function, count(*) AS sites FROM (SELECT DISTINCT target_function, file, line FROM {SITES}) s WHERE (file, line) IN (SELECT file, line FROM {FACTS} WHERE file IS NOT NULL AND line IS NOT NULL) GROUP BY ALL")
def j18_semi_members(spark, d):
    s = _all_sites(spark, d).select("target_function", "file", "line").distinct()
    return s.join(_all_facts(spark, d).select("file", "line").distinct(), ["file", "line"], "left_semi").groupBy("target_function").agg(F.count(F.lit(1)).alias("sites"))


@query("j23_inventory_difference", f"""
WITH f AS (SELECT DISTINCT target_function, file, line FROM {FACTS} WHERE file IS NOT NULL AND line IS NOT NULL), s AS (SELECT DISTINCT target_function, file, line FROM {SITES})
SELECT 'inventory_only' AS side, count(*) AS sites FROM (SELECT * FROM s EXCEPT SELECT * FROM f) UNION ALL SELECT 'facts_only', count(*) FROM (SELECT * FROM f EXCEPT SELECT * FROM s)
""")
def j23_inventory_difference(spark, d):
    keys = ["target_function", "file", "line"]
    f = _all_facts(spark, d).where("file is not null and line is not null").select(*keys).distinct()
    s = _all_sites(spark, d).select(*keys).distinct()
    both = s.withColumn("n", F.lit(1)).unionByName(f.withColumn("n", F.lit(-1))).groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")
    sides = both.agg(F.count_if(F.col("n") > 0).alias("a"), F.count_if(F.col("n") < 0).alias("b"))
    return sides.select(F.explode(F.array(F.struct(F.lit("inventory_only").alias("side"), F.col("a").alias("sites")), F.struct(F.lit("facts_only").alias("side"), F.col("b").alias("sites")))).alias("x")).select("x.*")


# ---- aggregations


@query("a1_access_union", f"SELECT value, count(*) AS entries, string_agg(path || ':' || line, ',' ORDER BY path || ':' || line) AS at FROM (SELECT DISTINCT value, path, line FROM {RECORDS} WHERE value IS NOT NULL) GROUP BY ALL")
def a1_access_union(spark, d):
    r = _all_records(spark, d).where("value is not null").select("value", F.concat("path", F.lit(":"), F.col("line").cast("string")).alias("at")).distinct()
    return r.groupBy("value").agg(F.count(F.lit(1)).alias("entries"), F.array_join(F.array_sort(F.collect_list("at")), ",").alias("at"))


@query("a2_forkproc_callers", f"SELECT value, string_agg(DISTINCT process_name, ',' ORDER BY process_name) AS callers FROM {RECORDS} WHERE operation = 'FORKPROC' AND value IS NOT NULL GROUP BY ALL")
def a2_forkproc_callers(spark, d):
    r = _records(spark, d).where("operation = 'FORKPROC' and value is not null")
    return r.groupBy("value").agg(F.array_join(F.array_sort(F.collect_set("process_name")), ",").alias("callers"))


@query("a5_evidence_rows", "SELECT evidence_process, resolver, count(*) AS facts, count(DISTINCT fact_id) AS ids FROM (SELECT DISTINCT * FROM discovery_facts) GROUP BY ALL")
def a5_evidence_rows(spark, d):
    return once(table(spark, d, "discovery_facts")).groupBy("evidence_process", "resolver").agg(F.count(F.lit(1)).alias("facts"), F.countDistinct("fact_id").alias("ids"))


@query("a6_collisions", f"SELECT resolved_value, count(DISTINCT base) AS bases FROM (SELECT resolved_value, regexp_replace(trim(target_expression), '\\s*[+-]\\s*[0-9]+$', '') AS base FROM {FACTS} WHERE resolved_value <> '' AND target_expression IS NOT NULL) GROUP BY ALL HAVING count(DISTINCT base) >= 2")
def a6_collisions(spark, d):
    f = _facts(spark, d).where("resolved_value <> ''")
    return A.collisions(f, "resolved_value", V.base_expression(F.col("target_expression")))


@query("a7_status_fold", f"SELECT file, line, CASE WHEN bool_or(status = 'EXACT' AND reachability IN ('DIRECT_ROOT', 'CALLBACK')) THEN 'resolved' ELSE 'present' END AS owner_status FROM {FACTS} WHERE file IS NOT NULL AND line IS NOT NULL GROUP BY ALL")
def a7_status_fold(spark, d):
    proven = (F.col("status") == "EXACT") & F.col("reachability").isin("DIRECT_ROOT", "CALLBACK")
    return _facts(spark, d).where("file is not null and line is not null").groupBy("file", "line").agg(F.when(F.bool_or(proven), "resolved").otherwise("present").alias("owner_status"))


@query("a8_fact_fold", f"""
SELECT target_function, file, line, arg_index, resolved_value, CAST(sum(path_count) AS BIGINT) AS path_count, arg_min(link_method, fact_id) AS link_method
FROM (SELECT *, row_number() OVER (PARTITION BY target_function, file, line, arg_index, resolved_value, fact_id ORDER BY link_method) AS k FROM {FACTS}) GROUP BY target_function, file, line, arg_index, resolved_value
""")
def a8_fact_fold(spark, d):
    f = _facts(spark, d).withColumn("path_count", F.col("path_count").cast("bigint"))
    return A.folded(f, ["target_function", "file", "line", "arg_index", "resolved_value"], "path_count", ["link_method"], ["fact_id"])


@query("a9_value_set_status", f"""
WITH g AS (SELECT target_function, file, line, arg_index, list(DISTINCT nullif(resolution_status, '')) FILTER (nullif(resolution_status, '') IS NOT NULL) AS kinds, count(DISTINCT nullif(resolved_value, '')) AS n FROM {FACTS} WHERE file IS NOT NULL GROUP BY ALL)
SELECT CASE WHEN len(coalesce(kinds, [])) = 0 THEN 'NO_TARGET' WHEN kinds = ['EXTERNAL'] THEN 'EXTERNAL' WHEN n = 1 AND kinds = ['RESOLVED'] THEN 'RESOLVED'
            WHEN n = 1 AND list_contains(kinds, 'RESOLVED') AND NOT list_contains(kinds, 'RUNTIME') AND NOT list_contains(kinds, 'UNRESOLVED') THEN 'RESOLVED'
            WHEN n > 1 OR list_contains(kinds, 'RUNTIME') THEN 'RUNTIME' ELSE 'UNRESOLVED' END AS site_status, count(*) AS arguments
FROM g GROUP BY ALL
""")
def a9_value_set_status(spark, d):
    g = _facts(spark, d).where("file is not null").groupBy("target_function", "file", "line", "arg_index").agg(
        F.collect_set(F.nullif("resolution_status", F.lit(""))).alias("kinds"), F.countDistinct(F.nullif("resolved_value", F.lit(""))).alias("n")
    )
    return g.groupBy(A.value_set_status(F.col("kinds"), F.col("n")).alias("site_status")).agg(F.count(F.lit(1)).alias("arguments"))


@query("a10_conditional_counts", f"""
SELECT evidence_process, count(*) AS facts, count(*) FILTER (status = 'EXACT') AS exact, count(*) FILTER (status = 'UNRESOLVED') AS unresolved, count(*) FILTER (reachability = 'DIRECT_ROOT') AS direct,
       count(*) FILTER (resolved_by = 'LLM') AS by_model, count(DISTINCT file || ':' || line) AS sites FROM {FACTS} GROUP BY ALL
""")
def a10_conditional_counts(spark, d):
    return _facts(spark, d).groupBy("evidence_process").agg(
        F.count(F.lit(1)).alias("facts"), F.count_if(F.col("status") == "EXACT").alias("exact"), F.count_if(F.col("status") == "UNRESOLVED").alias("unresolved"),
        F.count_if(F.col("reachability") == "DIRECT_ROOT").alias("direct"), F.count_if(F.col("resolved_by") == "LLM").alias("by_model"), F.countDistinct(F.concat("file", F.lit(":"), F.col("line").cast("string"))).alias("sites"),
    )


@query("a12_mode_first_tie", f"""
WITH c AS (SELECT target_function, operation, count(*) AS n, min(fact_id) AS p FROM {FACTS} WHERE operation <> '' GROUP BY ALL)
SELECT target_function, operation, n FROM (SELECT *, row_number() OVER (PARTITION BY target_function ORDER BY n DESC, p) AS rn FROM c) WHERE rn = 1
""")
def a12_mode_first_tie(spark, d):
    return A.mode_first(_facts(spark, d).where("operation <> ''"), ["target_function"], "operation", "fact_id")


@query("a14_manifest_totals", "SELECT count(*) AS runs, CAST(sum(function_count) AS BIGINT) AS functions, CAST(sum(resource_count) AS BIGINT) AS resources, CAST(sum(interaction_count) AS BIGINT) AS interactions, count(*) FILTER (interaction_count > 0) AS with_interactions FROM (SELECT DISTINCT * FROM graph_runs)")
def a14_manifest_totals(spark, d):
    r = once(table(spark, d, "graph_runs"))
    total = lambda c, n: F.sum(F.col(c).cast("bigint")).alias(n)
    return r.agg(F.count(F.lit(1)).alias("runs"), total("function_count", "functions"), total("resource_count", "resources"), total("interaction_count", "interactions"), F.count_if(F.col("interaction_count") > 0).alias("with_interactions"))


DIRECTION = "CASE WHEN operation IN ('ADDQUE', 'WRITE', 'WRITEREC', 'UPDATEREC', 'FWRITE') THEN 'producer' WHEN operation IN ('DELQUE', 'READ', 'GETREC') THEN 'consumer' ELSE 'both' END"


@query("a15_direction_merge", f"""
SELECT process_name, resource, value, count(*) AS n, CASE WHEN count(DISTINCT {DIRECTION}) > 1 THEN 'both' ELSE min({DIRECTION}) END AS direction, string_agg(DISTINCT operation, ',' ORDER BY operation) AS operations
FROM {RECORDS} WHERE value IS NOT NULL GROUP BY process_name, resource, value
""")
def a15_direction_merge(spark, d):
    r = _records(spark, d).where("value is not null").withColumn("dir", V.direction(F.col("operation")))
    return r.groupBy("process_name", "resource", "value").agg(
        F.count(F.lit(1)).alias("n"), F.when(F.countDistinct("dir") > 1, "both").otherwise(F.min("dir")).alias("direction"), F.array_join(F.array_sort(F.collect_set("operation")), ",").alias("operations")
    )


@query("a16_resolved_and_or", f"SELECT resource, operation, bool_and(value IS NOT NULL) AS all_resolved, bool_or(value IS NOT NULL) AS any_resolved FROM {RECORDS} GROUP BY ALL")
def a16_resolved_and_or(spark, d):
    has = F.col("value").isNotNull()
    return _records(spark, d).groupBy("resource", "operation").agg(F.bool_and(has).alias("all_resolved"), F.bool_or(has).alias("any_resolved"))


@query("a17_function_merge", """
SELECT function_id, count(DISTINCT process_name) AS processes, count(DISTINCT results_set) AS sets, max(end_line) AS last_line, arg_min(name, results_set || run_id) AS name, min(source_sha256) AS sha
FROM (SELECT DISTINCT * FROM run_functions) GROUP BY ALL
""")
def a17_function_merge(spark, d):
    r = once(table(spark, d, "run_functions"))
    return r.groupBy("function_id").agg(
        F.countDistinct("process_name").alias("processes"), F.countDistinct("results_set").alias("sets"), F.max("end_line").alias("last_line"),
        F.min_by("name", F.concat("results_set", "run_id")).alias("name"), F.min("source_sha256").alias("sha"),
    )


@query("a19_producers_consumers", f"SELECT resource, {DIRECTION} AS side, count(*) AS users FROM (SELECT DISTINCT resource, process_name, path, operation FROM {RECORDS}) GROUP BY ALL")
def a19_producers_consumers(spark, d):
    r = _all_records(spark, d).select("resource", "process_name", "path", "operation").distinct()
    return r.groupBy("resource", V.direction(F.col("operation")).alias("side")).agg(F.count(F.lit(1)).alias("users"))


@query("a20_operation_counts", f"""
WITH e AS (SELECT process_name, resource, count(*) AS n, list(DISTINCT operation) AS ops FROM {RECORDS} GROUP BY ALL)
SELECT resource, op AS operation, CAST(sum(n) AS BIGINT) AS n FROM (SELECT resource, n, unnest(ops) AS op FROM e) GROUP BY ALL
""")
def a20_operation_counts(spark, d):
    e = _records(spark, d).groupBy("process_name", "resource").agg(F.count(F.lit(1)).alias("n"), F.collect_set("operation").alias("ops"))
    return e.select("resource", "n", F.explode("ops").alias("operation")).groupBy("resource", "operation").agg(F.sum("n").alias("n"))


@query("a22_histogram", f"SELECT n_values, count(*) AS n_keys FROM (SELECT path, line, count(DISTINCT value) AS n_values FROM {RECORDS} GROUP BY ALL) GROUP BY ALL")
def a22_histogram(spark, d):
    return A.histogram(_records(spark, d), ["path", "line"], "value")


@query("a23_rates", f"SELECT process_name, count(*) AS records, round(coalesce(count(value)::DOUBLE / nullif(count(*), 0), 0), 6) AS resolved_rate, round(coalesce(count(*) FILTER (operation = 'FORKPROC')::DOUBLE / nullif(count(*) FILTER (resource = 'forkproc'), 0), 0), 6) AS fork_rate FROM {RECORDS} GROUP BY ALL")
def a23_rates(spark, d):
    n = F.count(F.lit(1))
    return _records(spark, d).groupBy("process_name").agg(n.alias("records"), A.rate(F.count("value"), n).alias("resolved_rate"), A.rate(F.count_if(F.col("operation") == "FORKPROC"), F.count_if(F.col("resource") == "forkproc")).alias("fork_rate"))


@query("a24_site_density", f"""
WITH v AS (SELECT target_function, file, line, resolved_value FROM {FACTS} WHERE file IS NOT NULL AND line IS NOT NULL AND resolved_value <> '' GROUP BY ALL)
SELECT target_function, count(DISTINCT (file, line)) AS sites, count(*) AS site_values, count(DISTINCT resolved_value) AS unique_values, round(count(*)::DOUBLE / count(DISTINCT (file, line)), 6) AS density FROM v GROUP BY ALL
""")
def a24_site_density(spark, d):
    v = _all_facts(spark, d).where("file is not null and line is not null and resolved_value <> ''").select("target_function", "file", "line", "resolved_value").distinct()
    per = v.groupBy("target_function", "file", "line").agg(F.count(F.lit(1)).alias("n"))
    one = per.groupBy("target_function").agg(F.count(F.lit(1)).alias("sites"), F.sum("n").alias("site_values"))
    two = v.groupBy("target_function").agg(F.countDistinct("resolved_value").alias("unique_values"))
    return one.join(two, "target_function").withColumn("density", A.rate(F.col("site_values"), F.col("sites")))


@query("a25_site_category", f"""
WITH g AS (SELECT file, line, bool_or(status = 'EXACT' AND resolved_by = 'SYNTAX') AS ed, bool_or(status = 'EXACT') AS et, bool_or(status = 'DYNAMIC') AS dy, bool_or(status = 'EXTERNAL') AS ex, bool_or(status = 'UNREACHABLE') AS un FROM {FACTS} WHERE file IS NOT NULL AND line IS NOT NULL GROUP BY ALL)
SELECT CASE WHEN ed THEN 'exact_direct' WHEN et THEN 'exact_traced' WHEN dy THEN 'dynamic' WHEN ex THEN 'external' WHEN un THEN 'unreachable' ELSE 'unresolved' END AS category, count(*) AS sites FROM g GROUP BY ALL
""")
def a25_site_category(spark, d):
    is_ = lambda s: F.bool_or(F.col("status") == s)
    g = _facts(spark, d).where("file is not null and line is not null").groupBy("file", "line").agg(
        F.bool_or((F.col("status") == "EXACT") & (F.col("resolved_by") == "SYNTAX")).alias("ed"), is_("EXACT").alias("et"), is_("DYNAMIC").alias("dy"), is_("EXTERNAL").alias("ex"), is_("UNREACHABLE").alias("un")
    )
    c = F.when(F.col("ed"), "exact_direct").when(F.col("et"), "exact_traced").when(F.col("dy"), "dynamic").when(F.col("ex"), "external").when(F.col("un"), "unreachable").otherwise("unresolved")
    return g.groupBy(c.alias("category")).agg(F.count(F.lit(1)).alias("sites"))


@query("a27_set_relation", SCAN_FLOW + """
SELECT CASE WHEN len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AND len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 THEN 'equal' WHEN len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 THEN 'subset'
       WHEN len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 THEN 'superset' WHEN list_has_any(a, b) THEN 'overlap' ELSE 'disjoint' END AS relation, count(*) AS sites FROM j WHERE in_scan AND in_flow GROUP BY ALL
""")
def a27_set_relation(spark, d):
    return _scan_flow(spark, d).where("in_scan and in_flow").groupBy(A.set_relation(F.col("a"), F.col("b")).alias("relation")).agg(F.count(F.lit(1)).alias("sites"))


@query("a32_graph_stats", "SELECT kind, 'node' AS what, count(DISTINCT id) AS n FROM graph_functions GROUP BY ALL UNION ALL SELECT kind, 'edge', count(DISTINCT (id, source, target, line)) FROM graph_calls GROUP BY ALL")
def a32_graph_stats(spark, d):
    nodes = table(spark, d, "graph_functions").select("kind", "id").distinct().groupBy("kind").agg(F.count("id").alias("n")).select("kind", F.lit("node").alias("what"), "n")
    edges = table(spark, d, "graph_calls").select("kind", "id", "source", "target", "line").distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select("kind", F.lit("edge").alias("what"), "n")
    return nodes.unionByName(edges)


@query("a33_first_concrete", f"SELECT target_function, file, line, coalesce(arg_min(resolved_value, fact_id) FILTER (nullif(resolved_value, '') IS NOT NULL), min(target_expression)) AS value FROM {FACTS} WHERE file IS NOT NULL AND line IS NOT NULL GROUP BY ALL")
def a33_first_concrete(spark, d):
    good = F.when(F.nullif("resolved_value", F.lit("")).isNotNull(), F.struct("fact_id", "resolved_value"))
    return _facts(spark, d).where("file is not null and line is not null").groupBy("target_function", "file", "line").agg(F.coalesce(F.min(good)["resolved_value"], F.min("target_expression")).alias("value"))


@query("a35_path_counts", f"SELECT target_function, CAST(sum(path_count) AS BIGINT) AS paths, count(DISTINCT path_count) AS distinct_counts, count(DISTINCT (source_file, source_line)) AS sources FROM {FACTS} WHERE source_file IS NOT NULL AND source_line IS NOT NULL GROUP BY ALL")
def a35_path_counts(spark, d):
    f = _facts(spark, d).where("source_file is not null and source_line is not null")
    return f.groupBy("target_function").agg(F.sum(F.col("path_count").cast("bigint")).alias("paths"), F.countDistinct("path_count").alias("distinct_counts"), F.countDistinct("source_file", "source_line").alias("sources"))


# ---- windows, order, sets


@query("wn1_latest_run_policy", """
SELECT process_name, run_id, interaction_count FROM (
  SELECT *, row_number() OVER (PARTITION BY process_name ORDER BY interaction_count > 0 DESC, generated_at DESC, run_id DESC, results_set DESC) AS rn FROM (SELECT DISTINCT * FROM graph_runs)) WHERE rn = 1
""")
def wn1_latest_run_policy(spark, d):
    r = once(table(spark, d, "graph_runs"))
    has = F.coalesce(F.col("interaction_count") > 0, F.lit(False))
    # one row per process by a partial maximum: no process's runs are sorted in one task
    return r.groupBy("process_name").agg(F.max(F.struct(has.alias("has"), "generated_at", "run_id", "results_set", "interaction_count")).alias("m")).select("process_name", "m.run_id", "m.interaction_count")


@query("wn4_lane_rank", "SELECT process_name, operation, n, row_number() OVER (PARTITION BY process_name ORDER BY n DESC, operation) AS rank FROM (SELECT process_name, operation, count(*) AS n FROM (SELECT DISTINCT * FROM discovery_records) GROUP BY ALL)")
def wn4_lane_rank(spark, d):
    c = once(table(spark, d, "discovery_records")).groupBy("process_name", "operation").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("process_name").orderBy(F.desc("n"), "operation")))


@query("wn5_chunk_frames", f"""
WITH s AS (SELECT id, len(string_split(source, chr(10))) AS n FROM {FUNCTIONS} WHERE source IS NOT NULL)
SELECT id AS function_id, o + 1 AS first_line, least(o + 45, n) AS last_line FROM (SELECT id, n, unnest(generate_series(0, greatest(n - 1, 0), 37)) AS o FROM s WHERE n > 0) WHERE o = 0 OR o - 37 + 45 < n
""")
def wn5_chunk_frames(spark, d):
    s = _functions(spark, d).where("source is not null").select(F.col("id").alias("function_id"), F.size(F.split("source", "\n")).alias("n"))
    o = F.filter(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(37)), lambda x: (x == 0) | (x - 37 + 45 < F.col("n")))
    return s.select("function_id", "n", F.explode(o).alias("o")).select("function_id", (F.col("o") + 1).cast("bigint").alias("first_line"), F.least(F.col("o") + 45, F.col("n")).cast("bigint").alias("last_line"))


@query("wn6_path_positions", "WITH p AS (SELECT DISTINCT path, string_split(path, '/') AS s FROM source_files) SELECT path, i AS position, s[i] AS part FROM (SELECT path, s, unnest(generate_series(1, len(s))) AS i FROM p)")
def wn6_path_positions(spark, d):
    p = table(spark, d, "source_files").select("path").distinct()
    return p.select("path", F.posexplode(F.split("path", "/")).alias("i", "part")).select("path", (F.col("i") + 1).cast("bigint").alias("position"), "part")


@query("wn7_previous_run", "SELECT results_set, process_name, run_id, lag(run_id) OVER (PARTITION BY results_set, process_name ORDER BY generated_at, run_id) AS previous FROM (SELECT DISTINCT * FROM graph_runs)")
def wn7_previous_run(spark, d):
    w = Window.partitionBy("results_set", "process_name").orderBy("generated_at", "run_id")
    return once(table(spark, d, "graph_runs")).select("results_set", "process_name", "run_id", F.lag("run_id").over(w).alias("previous"))


@query("wn9_evidence_cap", f"SELECT file, fact_id, rn AS position FROM (SELECT file, fact_id, row_number() OVER (PARTITION BY file ORDER BY path_count DESC, fact_id) AS rn FROM {FACTS} WHERE file IS NOT NULL) WHERE rn <= 3")
def wn9_evidence_cap(spark, d):
    f = _facts(spark, d).where("file is not null")
    return R.top(f.select("file", "fact_id", "path_count"), ["file"], [F.desc("path_count"), F.col("fact_id")], 3).select("file", "fact_id", F.col("rank").alias("position"))


@query("wn11_top_longest", f"SELECT id AS function_id, end_line - start_line + 1 AS lines FROM {FUNCTIONS} WHERE start_line > 0 ORDER BY lines DESC, id LIMIT 25")
def wn11_top_longest(spark, d):
    f = _functions(spark, d).where("start_line > 0").select(F.col("id").alias("function_id"), (F.col("end_line") - F.col("start_line") + 1).alias("lines"))
    return f.orderBy(F.desc("lines"), "function_id").limit(25)


@query("o2_numeric_text_order", f"""
SELECT value, process_name, resource, row_number() OVER (PARTITION BY process_name, resource ORDER BY CASE WHEN regexp_full_match(value, '[0-9]+') THEN 0 ELSE 1 END, TRY_CAST(CASE WHEN regexp_full_match(value, '[0-9]+') THEN value END AS BIGINT), value) AS position
FROM (SELECT DISTINCT process_name, resource, value FROM {RECORDS} WHERE value IS NOT NULL)
""")
def o2_numeric_text_order(spark, d):
    v = _all_records(spark, d).where("value is not null").select("process_name", "resource", "value").distinct()
    number = F.col("value").rlike(r"^[0-9]+$")
    w = Window.partitionBy("process_name", "resource").orderBy(F.when(number, 0).otherwise(1), F.when(number, F.col("value")).try_cast("bigint"), "value")
    return v.withColumn("position", F.row_number().over(w))


@query("u1_record_sets", f"""
WITH a AS (SELECT DISTINCT path, line, operation, value FROM {RECORDS} WHERE held_by = 'scan'), b AS (SELECT DISTINCT path, line, operation, value FROM {RECORDS} WHERE held_by = 'flow')
SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'scan_only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'flow_only', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
""")
def u1_record_sets(spark, d):
    r = _records(spark, d).groupBy("path", "line", "operation", "value").agg(F.bool_or(F.col("held_by") == "scan").alias("s"), F.bool_or(F.col("held_by") == "flow").alias("f"))
    n = r.agg(F.count_if(F.col("s") & F.col("f")).alias("both"), F.count_if(F.col("s") & ~F.col("f")).alias("scan_only"), F.count_if(~F.col("s") & F.col("f")).alias("flow_only"))
    return n.select(F.explode(F.array(*[F.struct(F.lit(x).alias("part"), F.col(x).alias("n")) for x in ("both", "scan_only", "flow_only")])).alias("x")).select("x.*")


@query("u2_jaccard", f"""
WITH x AS (SELECT process_name, path, line, bool_or(held_by = 'scan') AS s, bool_or(held_by = 'flow') AS f FROM {RECORDS} GROUP BY ALL)
SELECT process_name, count(*) FILTER (s AND f) AS shared, count(*) AS total, round(count(*) FILTER (s AND f)::DOUBLE / count(*), 6) AS jaccard FROM x GROUP BY ALL
""")
def u2_jaccard(spark, d):
    x = _records(spark, d).groupBy("process_name", "path", "line").agg(F.bool_or(F.col("held_by") == "scan").alias("s"), F.bool_or(F.col("held_by") == "flow").alias("f"))
    both = F.count_if(F.col("s") & F.col("f"))
    return x.groupBy("process_name").agg(both.alias("shared"), F.count(F.lit(1)).alias("total"), A.rate(both, F.count(F.lit(1))).alias("jaccard"))


@query("u3_union_processes", f"SELECT process_name, count(*) AS sites FROM (SELECT process_name, path, line FROM {RECORDS} UNION SELECT evidence_process, file, line FROM {FACTS}) GROUP BY ALL")
def u3_union_processes(spark, d):
    a = _all_records(spark, d).select("process_name", "path", "line")
    b = _all_facts(spark, d).select(F.col("evidence_process").alias("process_name"), F.col("file").alias("path"), "line")
    return a.unionByName(b).distinct().groupBy("process_name").agg(F.count(F.lit(1)).alias("sites"))


# ---- scalar transforms and filters


@query("pr3_path_normal", r"SELECT DISTINCT target_site_file AS raw, regexp_replace(replace(target_site_file, '\', '/'), '^\.//?', '') AS path FROM discovery_facts")
def pr3_path_normal(spark, d):
    return table(spark, d, "discovery_facts").select(F.col("target_site_file").alias("raw")).distinct().withColumn("path", plain_path(F.col("raw")))


@query("pr5_c_integers", """
WITH n AS (SELECT DISTINCT TRY_CAST(resolved_value AS BIGINT) AS v FROM discovery_facts WHERE regexp_full_match(resolved_value, '[1-9][0-9]*'))
SELECT v AS value, v AS from_decimal, v AS from_hex, -v AS from_negative, v AS from_suffix FROM n
""")
def pr5_c_integers(spark, d):
    n = table(spark, d, "discovery_facts").where(F.col("resolved_value").rlike("^[1-9][0-9]*$")).select(F.col("resolved_value").cast("bigint").alias("v")).distinct()
    t = F.col("v").cast("string")
    return n.select(
        F.col("v").alias("value"), V.c_int(t).alias("from_decimal"), V.c_int(F.concat(F.lit("0x"), F.hex("v"))).alias("from_hex"),
        V.c_int(F.concat(F.lit("-"), t)).alias("from_negative"), V.c_int(F.concat(t, F.lit("UL"))).alias("from_suffix"),
    )


@query("pr9_confidence", r"""
SELECT CASE WHEN target_expression IS NULL OR trim(target_expression) = '' THEN 'none' WHEN regexp_full_match(trim(target_expression), '[+-]?(0|[1-9][0-9]*|0x[0-9a-fA-F]+|0[0-7]+)') THEN 'literal'
  WHEN regexp_full_match(trim(target_expression), '[A-Z_][A-Z0-9_]*') THEN 'macro' WHEN regexp_matches(target_expression, '->|\[|\w\.\w') THEN 'dynamic' ELSE 'expression' END AS confidence, count(*) AS facts
FROM (SELECT DISTINCT * FROM discovery_facts) GROUP BY ALL
""")
def pr9_confidence(spark, d):
    return once(table(spark, d, "discovery_facts")).groupBy(V.confidence(F.col("target_expression")).alias("confidence")).agg(F.count(F.lit(1)).alias("facts"))


@query("pr11_resource_kind", "SELECT operation, CASE WHEN operation LIKE '%QUE%' THEN 'queue' WHEN operation LIKE '%PROC%' THEN 'process' WHEN operation LIKE '%REC%' THEN 'record_file' WHEN operation IN ('READ', 'WRITE', 'FWRITE') THEN 'file' ELSE 'other' END AS kind, count(*) AS n FROM (SELECT DISTINCT * FROM discovery_records) GROUP BY ALL")
def pr11_resource_kind(spark, d):
    return once(table(spark, d, "discovery_records")).groupBy("operation", V.resource_kind(F.col("operation")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("pr13_library_component", "WITH f AS (SELECT DISTINCT id, string_split(file, '/') AS s FROM graph_functions WHERE file IS NOT NULL) SELECT list_filter(s, lambda x: starts_with(lower(x), 'lib'))[1] AS component, count(*) AS functions FROM f GROUP BY ALL")
def pr13_library_component(spark, d):
    f = table(spark, d, "graph_functions").where("file is not null").select("id", "file").distinct()
    parts = F.filter(F.split("file", "/"), lambda x: F.lower(x).startswith("lib"))
    return f.groupBy(F.when(F.size(parts) > 0, F.get(parts, F.lit(0))).alias("component")).agg(F.count(F.lit(1)).alias("functions"))


@query("pr15_stable_ids", f"SELECT id, substring(sha1(coalesce(process_name, '') || chr(31) || coalesce(file, '') || chr(31) || coalesce(name, '') || chr(31) || coalesce(CAST(start_line AS VARCHAR), '')), 1, 16) AS stable_id FROM {FUNCTIONS}")
def pr15_stable_ids(spark, d):
    return _functions(spark, d).select("id", stable_id(F.col("process_name"), F.col("file"), F.col("name"), F.col("start_line")).alias("stable_id"))


@query("pr18_numbered_source", f"SELECT id, list_aggregate(list_transform(string_split(source, chr(10)), lambda x, i: lpad(CAST(i AS VARCHAR), 5, ' ') || ' ' || x), 'string_agg', chr(10)) AS numbered FROM {FUNCTIONS} WHERE source IS NOT NULL")
def pr18_numbered_source(spark, d):
    return _functions(spark, d).where("source is not null").select("id", V.numbered(F.col("source")).alias("numbered"))


@query("pr19_signature", f"SELECT id, trim(list_filter(string_split(source, chr(10)), lambda x: trim(x) <> '' AND NOT regexp_matches(trim(x), '^(//|/\\*|\\*|#)'))[1]) AS signature FROM {FUNCTIONS} WHERE source IS NOT NULL")
def pr19_signature(spark, d):
    return _functions(spark, d).where("source is not null").select("id", V.signature(F.col("source")).alias("signature"))


@query("pr22_metadata_json", "SELECT json_extract_string(metadata, '$.arm') AS arm, count(*) AS facts, count(json_extract_string(metadata, '$.guard')) AS guarded FROM (SELECT DISTINCT * FROM discovery_facts) GROUP BY ALL")
def pr22_metadata_json(spark, d):
    f = once(table(spark, d, "discovery_facts"))
    return f.groupBy(F.get_json_object("metadata", "$.arm").alias("arm")).agg(F.count(F.lit(1)).alias("facts"), F.count(F.get_json_object("metadata", "$.guard")).alias("guarded"))


@query("fl1_in_process", f"SELECT process_name, count(*) AS records, count(*) FILTER (starts_with(path, 'cells/' || replace(process_name, 'proc_', '') || '/')) AS inside FROM {RECORDS} GROUP BY ALL")
def fl1_in_process(spark, d):
    prefix = F.concat(F.lit("cells/"), F.regexp_replace("process_name", "proc_", ""))
    return _records(spark, d).groupBy("process_name").agg(F.count(F.lit(1)).alias("records"), F.count_if(V.in_process(F.col("path"), prefix)).alias("inside"))


@query("fl2_promotion_gate", f"SELECT fact_id, reachability FROM {FACTS} WHERE status = 'EXACT' AND owner_kind = 'SELF' AND (reachability IN ('DIRECT_ROOT', 'CALLBACK', 'UNKNOWN') OR (reachability = 'LOCAL_BACKWALK' AND resolution_status = 'RESOLVED'))")
def fl2_promotion_gate(spark, d):
    ok = F.col("reachability").isin("DIRECT_ROOT", "CALLBACK", "UNKNOWN") | ((F.col("reachability") == "LOCAL_BACKWALK") & (F.col("resolution_status") == "RESOLVED"))
    return _facts(spark, d).where((F.col("status") == "EXACT") & (F.col("owner_kind") == "SELF") & ok).select("fact_id", "reachability")


@query("v11_discovery_status", f"""
SELECT fact_id, CASE WHEN coalesce(resolution_status, '') = '' THEN 'NO_TARGET' WHEN resolution_status = 'EXTERNAL' THEN 'EXTERNAL' WHEN resolution_status = 'RUNTIME' THEN 'DYNAMIC'
  WHEN resolution_status = 'RESOLVED' AND nullif(resolved_value, '') IS NOT NULL THEN 'EXACT' ELSE 'UNRESOLVED' END AS discovery_status FROM {FACTS}
""")
def v11_discovery_status(spark, d):
    r = F.coalesce("resolution_status", F.lit(""))
    s = F.when(r == "", "NO_TARGET").when(r == "EXTERNAL", "EXTERNAL").when(r == "RUNTIME", "DYNAMIC").when((r == "RESOLVED") & F.nullif("resolved_value", F.lit("")).isNotNull(), "EXACT").otherwise("UNRESOLVED")
    return _facts(spark, d).select("fact_id", s.alias("discovery_status"))


@query("v26_cross_process_rows", f"""
WITH s AS (SELECT DISTINCT file, line, arg_index, status FROM {FACTS} WHERE owner_kind = 'SELF' AND file IS NOT NULL)
SELECT f.evidence_process, f.owner_process, coalesce(max(o.st), 'absent') AS owner_status, count(*) AS n
FROM {FACTS} f LEFT JOIN (SELECT file, line, arg_index, CASE WHEN bool_or(status = 'EXACT') THEN 'resolved' ELSE 'present' END AS st FROM s GROUP BY ALL) o USING (file, line, arg_index)
WHERE f.owner_kind = 'SHARED' GROUP BY f.evidence_process, f.owner_process, o.st
""")
def v26_cross_process_rows(spark, d):
    f, keys = _facts(spark, d), ["file", "line", "arg_index"]
    own = f.where("owner_kind = 'SELF' and file is not null").groupBy(*keys).agg(F.when(F.bool_or(F.col("status") == "EXACT"), "resolved").otherwise("present").alias("st"))
    return f.where("owner_kind = 'SHARED'").join(own, keys, "left").groupBy("evidence_process", "owner_process", F.coalesce("st", F.lit("absent")).alias("owner_status")).agg(F.count(F.lit(1)).alias("n"))


# ---- graphs

TRAVERSABLE = ("direct", "indirect", "callback", "macro_expansion")


def _edges(spark, d, kinds=TRAVERSABLE):
    c = table(spark, d, "graph_calls").where(F.col("kind").isin(*kinds) & F.col("source").isNotNull() & F.col("target").isNotNull())
    return c.select("source", "target").distinct()


EDGES = "(SELECT DISTINCT source, target FROM graph_calls WHERE kind IN ('direct', 'indirect', 'callback', 'macro_expansion') AND source IS NOT NULL AND target IS NOT NULL)"
DIRECT = "(SELECT DISTINCT source, target FROM graph_calls WHERE kind = 'direct' AND source IS NOT NULL AND target IS NOT NULL)"
ROOTS = "(SELECT DISTINCT source AS node FROM {0} WHERE source NOT IN (SELECT target FROM {0} WHERE source <> target))"


@query("g2_reachability", f"WITH RECURSIVE e AS (SELECT * FROM {EDGES}), w(node, depth) USING KEY (node) AS (SELECT node, 0 FROM {ROOTS.format('e')} UNION SELECT e.target, min(w.depth) + 1 FROM w JOIN e ON e.source = w.node WHERE e.target NOT IN (SELECT node FROM recurring.w) GROUP BY e.target) SELECT node, depth FROM w")
def g2_reachability(spark, d):
    e = _edges(spark, d)
    return G.reachable(e, "source", "target", G.roots(e, "source", "target"))


@query("g3_callback_only", f"""
WITH RECURSIVE d AS (SELECT * FROM {DIRECT}), e AS (SELECT * FROM {EDGES}), r AS (SELECT node FROM {ROOTS.format('d')}),
a AS (SELECT node FROM r UNION SELECT d.target FROM a JOIN d ON d.source = a.node),
b AS (SELECT node FROM r UNION SELECT e.target FROM b JOIN e ON e.source = b.node)
SELECT DISTINCT node FROM b WHERE node NOT IN (SELECT node FROM a)
""")
def g3_callback_only(spark, d):
    direct, every = _edges(spark, d, ("direct",)), _edges(spark, d)
    seeds = G.roots(direct, "source", "target")
    return G.reachable(every, "source", "target", seeds).select("node").join(G.reachable(direct, "source", "target", seeds).select("node"), "node", "left_anti")


@query("g5_simple_paths", f"""
WITH RECURSIVE e AS (SELECT DISTINCT source, target FROM graph_calls WHERE kind IN ('direct', 'external_call') AND source IS NOT NULL AND target IS NOT NULL),
g AS (SELECT DISTINCT id FROM graph_functions WHERE is_library_api AND name = 'rtx_open'),
w AS (SELECT node AS start, node AS at_node, [node] AS p FROM {ROOTS.format('e')} UNION ALL SELECT w.start, e.target, list_append(w.p, e.target) FROM w JOIN e ON e.source = w.at_node WHERE len(w.p) < 13 AND NOT list_contains(w.p, e.target) AND w.at_node NOT IN (SELECT id FROM g))
SELECT start, at_node AS "end", array_to_string(p, '/') AS path, len(p) - 1 AS length FROM w WHERE at_node IN (SELECT id FROM g) AND len(p) > 1
""")
def g5_simple_paths(spark, d):
    e = _edges(spark, d, ("direct", "external_call"))
    ends = table(spark, d, "graph_functions").where("is_library_api and name = 'rtx_open'").select(F.col("id").alias("node"))
    return G.simple_paths(e, "source", "target", G.roots(e, "source", "target"), ends, 13).withColumn("length", F.col("length").cast("bigint"))


CONDENSED = """
e AS (SELECT source AS s, target AS t FROM {0} WHERE source <> target),
reach(a, b) AS (SELECT s, t FROM e UNION SELECT r.a, e.t FROM reach r JOIN e ON e.s = r.b),
comp AS (SELECT r.a AS node, min(r.b) AS component FROM reach r JOIN reach q ON q.a = r.b AND q.b = r.a GROUP BY r.a),
m AS (SELECT n.node, coalesce(comp.component, n.node) AS c FROM (SELECT s AS node FROM e UNION SELECT t FROM e) n LEFT JOIN comp ON comp.node = n.node),
ce AS (SELECT DISTINCT a.c AS s, b.c AS t FROM e JOIN m a ON a.node = e.s JOIN m b ON b.node = e.t WHERE a.c <> b.c)
"""
LAYERS = CONDENSED + """,
f(c, k) AS (SELECT DISTINCT c, 0 FROM m WHERE c NOT IN (SELECT {1} FROM ce) UNION SELECT ce.{1}, f.k + 1 FROM f JOIN ce ON ce.{2} = f.c),
layered AS (SELECT m.node, m.c, max(f.k) AS layer FROM m JOIN f ON f.c = m.c GROUP BY ALL)
"""


@query("g10_layers", "WITH RECURSIVE " + LAYERS.format(DIRECT, "s", "t") + "SELECT node, layer FROM layered")
def g10_layers(spark, d):
    return G.layers(_edges(spark, d, ("direct",)), "source", "target").select("node", "layer")


@query("g10_layers_all_kinds", "WITH RECURSIVE " + LAYERS.format(EDGES, "s", "t") + "SELECT c AS component, count(*) AS nodes, any_value(layer) AS layer FROM layered GROUP BY ALL")
def g10_layers_all_kinds(spark, d):
    """Layers of the components over all traversable edges, where nodes have several parents."""
    return G.layers(_edges(spark, d), "source", "target").groupBy("component").agg(F.count(F.lit(1)).alias("nodes"), F.max("layer").alias("layer"))


@query("g11_fingerprints", "WITH RECURSIVE " + LAYERS.format(DIRECT, "s", "t") + """,
own AS (SELECT id AS node, max(source_sha256) AS digest FROM graph_functions GROUP BY ALL),
i AS (SELECT l.node, l.c, l.layer, coalesce(own.digest, '') AS digest FROM layered l LEFT JOIN own ON own.node = l.node),
peer AS (SELECT a.node, coalesce(string_agg(b.digest, ',' ORDER BY b.node), '') AS peers FROM i a LEFT JOIN i b ON b.c = a.c AND b.node <> a.node GROUP BY ALL),
out_ AS (SELECT e.s, e.t FROM e JOIN m a ON a.node = e.s JOIN m b ON b.node = e.t WHERE a.c <> b.c),
fp(node, fingerprint, k) USING KEY (node) AS (
  SELECT i.node, sha256(i.digest || '||' || p.peers), 0 FROM i JOIN peer p ON p.node = i.node WHERE i.layer = 0
  UNION SELECT i.node, sha256(i.digest || '|' || coalesce(u.under, '') || '|' || p.peers), i.layer FROM i JOIN peer p ON p.node = i.node
    LEFT JOIN (SELECT o.s, string_agg(f.fingerprint, ',' ORDER BY o.t) AS under FROM out_ o JOIN recurring.fp f ON f.node = o.t GROUP BY ALL) u ON u.s = i.node
    WHERE i.layer = (SELECT max(k) + 1 FROM fp))
SELECT node, fingerprint FROM fp
""")
def g11_fingerprints(spark, d):
    """Fingerprints over the dependencies, layer by layer."""
    own = table(spark, d, "graph_functions").select(F.col("id").alias("node"), F.col("source_sha256").alias("digest"))
    return G.fingerprints(_edges(spark, d, ("direct",)), "source", "target", own)


@query("g13_merged_edges", f"SELECT source, target, count(*) AS n_calls, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, source = target AS recursive FROM {CALLS} WHERE source IS NOT NULL AND target IS NOT NULL GROUP BY ALL")
def g13_merged_edges(spark, d):
    return G.merged_edges(_calls(spark, d).where("source is not null and target is not null"), "source", "target", "kind")


@query("g14_roots_leaves", f"WITH e AS (SELECT * FROM {DIRECT}) SELECT node, 'root' AS role FROM {ROOTS.format('e')} UNION ALL SELECT DISTINCT target, 'leaf' FROM e WHERE target NOT IN (SELECT source FROM e WHERE source <> target)")
def g14_roots_leaves(spark, d):
    e = _edges(spark, d, ("direct",))
    return G.roots(e, "source", "target").withColumn("role", F.lit("root")).unionByName(G.leaves(e, "source", "target").withColumn("role", F.lit("leaf")))


@query("g15_unreached_shelf", "SELECT file, count(*) AS functions FROM (SELECT DISTINCT id, file FROM graph_functions WHERE file IS NOT NULL) WHERE id NOT IN (SELECT target FROM graph_calls WHERE target IS NOT NULL) GROUP BY ALL")
def g15_unreached_shelf(spark, d):
    f = table(spark, d, "graph_functions").where("file is not null").select("id", "file").distinct()
    called = table(spark, d, "graph_calls").select(F.col("target").alias("id")).where("id is not null").distinct()
    return f.join(called, "id", "left_anti").groupBy("file").agg(F.count(F.lit(1)).alias("functions"))


@query("g18_path_counts")
def g18_path_counts(spark, d):
    """No SQL: which edges close a cycle follows a depth-first search; see the test by brute force."""
    e = _edges(spark, d)
    return G.path_counts(e, "source", "target", G.roots(e, "source", "target"))


@query("g20_nearest_ancestor", f"""
WITH RECURSIVE e AS (SELECT * FROM {DIRECT}), m AS (SELECT DISTINCT source AS node FROM graph_calls WHERE kind = 'callback' AND source IS NOT NULL),
w(node, ancestor, depth) USING KEY (node) AS (SELECT node, node, 0 FROM m UNION SELECT e.target, min(w.ancestor), min(w.depth) + 1 FROM w JOIN e ON e.source = w.node WHERE e.target NOT IN (SELECT node FROM recurring.w) GROUP BY e.target)
SELECT node, ancestor, depth FROM w
""")
def g20_nearest_ancestor(spark, d):
    marked = table(spark, d, "graph_calls").where("kind = 'callback' and source is not null").select(F.col("source").alias("node"))
    return G.nearest_ancestor(_edges(spark, d, ("direct",)), "source", "target", marked)


@query("v2_goal_values", f"""
WITH RECURSIVE e AS (SELECT * FROM {DIRECT}),
k AS (SELECT DISTINCT source AS goal, target AS value FROM graph_calls WHERE kind = 'external_call' AND source IS NOT NULL AND target IS NOT NULL UNION SELECT e.source, k.value FROM k JOIN e ON e.target = k.goal)
SELECT goal, count(*) AS n_values FROM k GROUP BY ALL
""")
def v2_goal_values(spark, d):
    facts = table(spark, d, "graph_calls").where("kind = 'external_call'").select(F.col("source").alias("goal"), F.col("target").alias("value"))
    return G.goal_values(_edges(spark, d, ("direct",)), "source", "target", facts).groupBy("goal").agg(F.count(F.lit(1)).alias("n_values"))


@query("v4_parameter_fanout", f"""
WITH s AS (SELECT DISTINCT s.file, s.line, f.id FROM {SITES} s JOIN (SELECT DISTINCT id, file, start_line, end_line FROM graph_functions WHERE start_line > 0) f ON f.file = s.file AND s.line BETWEEN f.start_line AND f.end_line)
SELECT s.id AS goal, c.source AS caller, CASE WHEN c.source IS NULL THEN 'EXTERNAL_ENTRY' ELSE 'ARG' END AS kind, count(*) AS n
FROM s LEFT JOIN {DIRECT} c ON c.target = s.id GROUP BY ALL
""")
def v4_parameter_fanout(spark, d):
    s = j6_containment(spark, d).select("file", "line", F.col("function_id").alias("goal")).distinct()
    c = _edges(spark, d, ("direct",)).select(F.col("target").alias("goal"), F.col("source").alias("caller"))
    return s.join(c, "goal", "left").groupBy("goal", "caller", F.when(F.col("caller").isNull(), "EXTERNAL_ENTRY").otherwise("ARG").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# ---- retrieval over the documents


def _compatible() -> str:
    """SQL rows (character, its compatible form) of all characters that NFKC changes and NFC does not: a rule over the Unicode database."""
    rows = []
    for code in range(128, sys.maxunicode + 1):
        ch = chr(code)
        if unicodedata.decomposition(ch).startswith("<") or unicodedata.normalize("NFKD", ch) != unicodedata.normalize("NFD", ch):
            plain = unicodedata.normalize("NFKD", ch).replace("'", "''")
            rows.append(f"({code}, '{plain}')")
    return ", ".join(rows)


POSTS = rf"""
compatible(code, form) AS (VALUES {_compatible()}),
x AS (SELECT doc_id, unnest(c) AS ch, generate_subscripts(c, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '(?s).') AS c FROM documents WHERE regexp_matches(text, '[^\x00-\x7F]'))),
plain AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[^\x00-\x7F]')
          UNION ALL SELECT doc_id, nfc_normalize(string_agg(coalesce(compatible.form, x.ch), '' ORDER BY i)) FROM x LEFT JOIN compatible ON compatible.code = unicode(x.ch) GROUP BY doc_id),
w AS (SELECT doc_id, trim(unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+')), '_') AS word FROM plain),
v AS (SELECT doc_id, word, list_filter(string_split(regexp_replace(replace(word, '_', ' '), '([a-z0-9])([A-Z])', '\1 \2', 'g'), ' '), lambda y: y <> '') AS parts FROM w WHERE word <> ''),
r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\x{{3040}}-\x{{30ff}}\x{{3400}}-\x{{4dbf}}\x{{4e00}}-\x{{9fff}}\x{{ff66}}-\x{{ff9f}}]+')) AS run FROM plain),
t AS (SELECT doc_id, lower(word) AS token FROM v UNION ALL SELECT doc_id, lower(unnest(parts)) FROM v WHERE len(parts) > 1
      UNION ALL SELECT doc_id, run[y:y + 1] FROM (SELECT doc_id, run, unnest(generate_series(1, greatest(length(run) - 1, 1))) AS y FROM r)),
n AS (SELECT doc_id, count(*) AS doc_len FROM t GROUP BY ALL),
p AS (SELECT doc_id, token, count(*) AS tf, any_value(doc_len) AS doc_len FROM t JOIN n USING (doc_id) GROUP BY ALL)
"""
ASKED = (("q1", "alarm"), ("q1", "queue"), ("q2", "tank"), ("q2", "level"), ("q2", "unknown"), ("q3", "puffer"), ("q3", "messwert"))
ASKED_SQL = "q(query, token) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in ASKED) + ")"


def _tokens(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", V.tokens(F.col("text")).alias("tokens"))


def _hits(spark, d):
    """(the postings of the asked tokens, number of documents, mean length)."""
    return R.asked_postings(_tokens(spark, d), "doc_id", "tokens", _asked(spark))


def _asked(spark):
    return spark.createDataFrame(list(ASKED), "query string, token string")


@query("r2_document_frequency", f"WITH {POSTS} SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM p GROUP BY ALL")
def r2_document_frequency(spark, d):
    return R.postings(_tokens(spark, d), "doc_id", F.col("tokens")).groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


BM25_SQL = f"""
WITH {POSTS}, {ASKED_SQL}, z AS (SELECT count(*) AS n, avg(l) AS avg_len FROM (SELECT doc_id, max(doc_len) AS l FROM p GROUP BY ALL)), f AS (SELECT token, count(*) AS df FROM p GROUP BY ALL),
s AS (SELECT q.query, p.doc_id, round(sum(ln(1 + (z.n - f.df + 0.5) / (f.df + 0.5)) * p.tf * 2.4 / (p.tf + 1.4 * (1 - 0.72 + 0.72 * p.doc_len / z.avg_len))), 6) AS score FROM q JOIN f USING (token) JOIN p USING (token) CROSS JOIN z GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM s)
"""


def _bm25(spark, hits, n, mean):
    return R.bm25(hits, n, mean, "doc_id", _asked(spark)).withColumn("score", F.round("score", 6))


@query("r3_bm25_topk", BM25_SQL + "SELECT query, doc_id, score, rank FROM k WHERE rank <= 20")
def r3_bm25_topk(spark, d):
    return R.top(_bm25(spark, *_hits(spark, d)), ["query"], [F.desc("score"), F.col("doc_id")], 20)


DENSE_SQL = """
WITH a AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT a.q AS query_id, b.vec_id, round(list_dot_product(a.e::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM a CROSS JOIN embeddings b WHERE a.q <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
"""


@query("r4_dense_topk", DENSE_SQL + "SELECT query_id, vec_id, score, rank FROM k WHERE rank <= 10")
def r4_dense_topk(spark, d):
    v = table(spark, d, "embeddings")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.dense_topk(v, "vec_id", "embedding", asked, "query_id", 10)


@query("r5_exact_name", f"SELECT n.name, f.id AS function_id FROM (SELECT DISTINCT lower(name) AS name FROM run_functions) n JOIN (SELECT DISTINCT id, lower(name) AS name FROM graph_functions) f USING (name)")
def r5_exact_name(spark, d):
    n = table(spark, d, "run_functions").select(F.lower("name").alias("name")).distinct()
    return n.join(table(spark, d, "graph_functions").select(F.col("id").alias("function_id"), F.lower("name").alias("name")).distinct(), "name")


@query("r6_rank_fusion", BM25_SQL + """,
l AS (SELECT q.query, p.doc_id, row_number() OVER (PARTITION BY q.query ORDER BY sum(p.tf) DESC, p.doc_id) AS rank FROM q JOIN p USING (token) GROUP BY q.query, p.doc_id)
SELECT query, doc_id, round(sum(w), 9) AS score, count(*) AS lanes FROM (SELECT query, doc_id, 1.0 / (60 + rank) AS w FROM k WHERE rank <= 50 UNION ALL SELECT query, doc_id, 0.5 / (60 + rank) FROM l WHERE rank <= 50) GROUP BY ALL
""")
def r6_rank_fusion(spark, d):
    hits, n, mean = _hits(spark, d)
    one = R.top(_bm25(spark, hits, n, mean), ["query"], [F.desc("score"), F.col("doc_id")], 50)
    tf = hits.join(_asked(spark), "token").groupBy("query", "doc_id").agg(F.sum("tf").alias("tf"))
    two = R.top(tf, ["query"], [F.desc("tf"), F.col("doc_id")], 50)
    return R.fused([(one, 1.0), (two, 0.5)], ["query", "doc_id"]).withColumn("score", F.round("score", 9))


@query("r8_rerank_blend", BM25_SQL + "SELECT query, doc_id, round(1.0 / rank + 0.25 * score / max(score) OVER (PARTITION BY query), 6) AS blended FROM k WHERE rank <= 20")
def r8_rerank_blend(spark, d):
    k = r3_bm25_topk(spark, d)
    best = F.max("score").over(Window.partitionBy("query"))
    return k.select("query", "doc_id", F.round(F.lit(1.0) / F.col("rank") + 0.25 * F.col("score") / best, 6).alias("blended"))
