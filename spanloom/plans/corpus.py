"""More queries of the warehouse: corpora, labels, filters, aliases, value flow, library views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import values as V
from spanloom.functions.text import plain_path
from spanloom.operators import graph as G
from spanloom.operators import joins as J
from spanloom.operators.csource import scanned
from spanloom.operators.flow import argument_values, scanned_flow
from spanloom.operators.hierarchy import hierarchy
from spanloom.plans.core_problems import P3_CORE
from spanloom.plans.warehouse import CALLS, DIRECT, EDGES, FACTS, FUNCTIONS, RECORDS, SITES, _calls, _edges, _facts, _functions, _records, _sites, once
from spanloom.sources.tables import table

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


# ---- graphs


@query("g9_components", f"""WITH RECURSIVE e AS (SELECT source AS s, target AS t FROM {DIRECT}),
reach(a, b) AS (SELECT s, t FROM e UNION SELECT r.a, e.t FROM reach r JOIN e ON e.s = r.b)
SELECT r.a AS node, min(r.b) AS component FROM reach r JOIN reach q ON q.a = r.b AND q.b = r.a GROUP BY r.a
""")
def g9_components(spark: SparkSession, d: str) -> DataFrame:
    return G.components(_edges(spark, d, ("direct",)), "source", "target")


@query("g9_components_all_kinds", f"""WITH RECURSIVE e AS (SELECT source AS s, target AS t FROM {EDGES}),
reach(a, b) AS (SELECT s, t FROM e UNION SELECT r.a, e.t FROM reach r JOIN e ON e.s = r.b)
SELECT r.a AS node, min(r.b) AS component FROM reach r JOIN reach q ON q.a = r.b AND q.b = r.a GROUP BY r.a
""")
def g9_components_all_kinds(spark, d):
    """Components over all traversable edges, where cycles share nodes and nodes have several parents."""
    return G.components(_edges(spark, d), "source", "target")


@query("g8_top_caller", P3_CORE + "SELECT function_id AS node, root_id AS top, depth FROM walk")
def g8_top_caller(spark, d):
    h = hierarchy(_edges(spark, d, ("direct",)), "source", "target").where("depth >= 0")
    return h.select("node", F.col("root").alias("top"), F.col("depth").cast("int").alias("depth"))


@query("g22_macro_alias_chain", """
WITH RECURSIVE e AS (SELECT source AS n, min(target) AS up FROM graph_calls WHERE kind = 'macro_expansion' AND source IS NOT NULL AND target IS NOT NULL AND source <> target GROUP BY ALL),
w AS (SELECT n AS node, up AS cur, 1 AS k FROM e UNION ALL SELECT w.node, e.up, w.k + 1 FROM w JOIN e ON e.n = w.cur WHERE w.k < 100)
SELECT node, arg_max(cur, k) AS canonical, max(k) AS steps FROM w GROUP BY ALL HAVING max(k) < 100
""")
def g22_macro_alias_chain(spark, d):
    e = _edges(spark, d, ("macro_expansion",)).where("source <> target")
    return hierarchy(e, "target", "source").where("depth > 0").select("node", F.col("root").alias("canonical"), F.col("depth").cast("int").alias("steps"))


@query("g24_library_entries", f"""
WITH f AS (SELECT DISTINCT id, file FROM graph_functions WHERE file LIKE '%/lib/%'), c AS (SELECT * FROM {DIRECT})
SELECT id, file FROM f WHERE id NOT IN (SELECT c.target FROM c JOIN f g ON g.id = c.source WHERE c.source <> c.target)
""")
def g24_library_entries(spark, d):
    f = table(spark, d, "graph_functions").where("file like '%/lib/%'").select("id", "file").distinct()
    inner = _edges(spark, d, ("direct",)).where("source <> target").join(f.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id")).distinct()
    return f.join(inner, "id", "left_anti")


@query("g25_domain_graph", f"""
SELECT 'PROCESS' AS part, process_name AS a, '' AS b, count(*) AS n FROM {RECORDS} GROUP BY ALL
UNION ALL SELECT CASE WHEN resource = 'mfs_queue' THEN 'MFS_QUEUE' ELSE 'MFS_FILE' END, value, '', count(*) FROM {RECORDS} WHERE value IS NOT NULL AND resource IN ('mfs_queue', 'mfs_file') GROUP BY ALL
UNION ALL SELECT CASE operation WHEN 'ADDQUE' THEN 'ADDQUE' WHEN 'DELQUE' THEN 'DELQUE' WHEN 'FORKPROC' THEN 'FORKPROC' WHEN 'READ' THEN 'READ_FILE' WHEN 'GETREC' THEN 'READ_FILE' ELSE 'WRITE_FILE' END, process_name, value, count(*)
  FROM {RECORDS} WHERE value IS NOT NULL AND operation <> 'CLEAR' GROUP BY ALL
""")
def g25_domain_graph(spark, d):
    r = _records(spark, d)
    n = F.count(F.lit(1)).alias("n")
    processes = r.groupBy(F.lit("PROCESS").alias("part"), F.col("process_name").alias("a"), F.lit("").alias("b")).agg(n)
    kind = F.when(F.col("resource") == "mfs_queue", "MFS_QUEUE").otherwise("MFS_FILE")
    resources = r.where("value is not null and resource in ('mfs_queue', 'mfs_file')").groupBy(kind.alias("part"), F.col("value").alias("a"), F.lit("").alias("b")).agg(n)
    edge = F.when(F.col("operation").isin("ADDQUE", "DELQUE", "FORKPROC"), F.col("operation")).when(F.col("operation").isin("READ", "GETREC"), "READ_FILE").otherwise("WRITE_FILE")
    edges = r.where("value is not null and operation <> 'CLEAR'").groupBy(edge.alias("part"), F.col("process_name").alias("a"), F.col("value").alias("b")).agg(n)
    return processes.unionByName(resources).unionByName(edges)


# ---- value flow


def _flow(spark, d):
    files = table(spark, d, "source_files")
    macros = scanned(files).where("what = 'macro' and not startswith(detail, '()')").groupBy(F.col("path"), F.col("name")).agg(F.min_by("detail", F.struct("line", "detail")).alias("value"))
    targets = table(spark, d, "graph_functions").where("is_library_api").select("name")
    return argument_values(scanned_flow(files), macros, targets)


@query("v3_argument_values")
def v3_argument_values(spark, d):
    return _flow(spark, d)


@query("v10_argument_status")
def v10_argument_status(spark, d):
    g = _flow(spark, d).groupBy("path", "line", "callee", "position").agg(F.collect_set("kind").alias("kinds"), F.countDistinct("value").alias("n"))
    known = F.exists("kinds", lambda k: k.isin("CONST", "MACRO", "PARAM"))
    status = (
        F.when(known & (F.col("n") > 1), "RUNTIME").when(F.array_contains("kinds", "UNRESOLVED"), "UNRESOLVED")
        .when(~known, "EXTERNAL").when(F.array_contains("kinds", "EXTERNAL_ENTRY"), "RUNTIME").otherwise("RESOLVED")
    )
    return g.select("path", "line", "callee", "position", status.alias("status"))


@query("v1_seeds", f"""
SELECT s.target_function, s.file, s.line, s.arg_index, s.in_process, f.reachability FROM (SELECT DISTINCT target_function, file, line, arg_index, in_process FROM {SITES}) s
JOIN (SELECT DISTINCT file, line, arg_index, reachability FROM {FACTS} WHERE file IS NOT NULL AND line IS NOT NULL) f USING (file, line, arg_index)
WHERE f.reachability IN ('DIRECT_ROOT', 'CALLBACK') OR (f.reachability = 'LOCAL_BACKWALK' AND s.in_process)
""")
def v1_seeds(spark, d):
    keys = ["file", "line", "arg_index"]
    s = _sites(spark, d).select("target_function", *keys, "in_process").distinct()
    f = _facts(spark, d).where("file is not null and line is not null").select(*keys, "reachability").distinct()
    return s.join(f, keys).where("reachability in ('DIRECT_ROOT', 'CALLBACK') or (reachability = 'LOCAL_BACKWALK' and in_process)").select("target_function", *keys, "in_process", "reachability")


@query("v12_lock_resolution", f"""
WITH locks AS (SELECT file, line, min(aux_lock) AS lock FROM {SITES} WHERE aux_lock <> '' GROUP BY ALL)
SELECT f.fact_id, coalesce(l.lock, 'NO_LOCK') AS lock FROM {FACTS} f LEFT JOIN locks l ON l.file = f.file AND l.line = f.line
""")
def v12_lock_resolution(spark, d):
    locks = _sites(spark, d).where("aux_lock <> ''").groupBy("file", "line").agg(F.min("aux_lock").alias("lock"))
    return _facts(spark, d).select("fact_id", "file", "line").join(locks, ["file", "line"], "left").select("fact_id", F.coalesce("lock", F.lit("NO_LOCK")).alias("lock"))


@query("v18_macro_arguments", f"SELECT target_function, macro_name IS NOT NULL AS through_macro, unmapped_args, count(*) AS sites FROM {SITES} GROUP BY ALL")
def v18_macro_arguments(spark, d):
    return _sites(spark, d).groupBy("target_function", F.col("macro_name").isNotNull().alias("through_macro"), "unmapped_args").agg(F.count(F.lit(1)).alias("sites"))


@query("v24_callback_edges", f"SELECT source, target, count(DISTINCT coalesce(via, '')) AS vias, min(line) AS first_line FROM {CALLS} WHERE kind = 'callback' AND source IS NOT NULL AND target IS NOT NULL GROUP BY ALL")
def v24_callback_edges(spark, d):
    c = _calls(spark, d).where("kind = 'callback' and source is not null and target is not null")
    return c.groupBy("source", "target").agg(F.countDistinct(F.coalesce("via", F.lit(""))).alias("vias"), F.min("line").alias("first_line"))


@query("v28_complete_bundles", f"SELECT target_function, file, line, string_agg(DISTINCT CAST(arg_index AS VARCHAR), ',' ORDER BY CAST(arg_index AS VARCHAR)) AS arguments FROM {FACTS} WHERE file IS NOT NULL AND line IS NOT NULL AND arg_index IS NOT NULL GROUP BY ALL HAVING max(arg_index) = count(DISTINCT arg_index)")
def v28_complete_bundles(spark, d):
    g = _facts(spark, d).where("file is not null and line is not null and arg_index is not null").groupBy("target_function", "file", "line").agg(F.array_sort(F.collect_set(F.col("arg_index").cast("string"))).alias("a"), F.max("arg_index").alias("m"))
    return g.where("m = size(a)").select("target_function", "file", "line", F.array_join("a", ",").alias("arguments"))


# ---- joins and corpora


@query("j8_reaching_value", f"""
WITH f AS (SELECT source_file, source_line, min(resolved_value) AS v FROM {FACTS} WHERE resolved_value <> '' AND source_file IS NOT NULL AND source_line IS NOT NULL GROUP BY ALL),
s AS (SELECT DISTINCT file, line FROM {SITES} WHERE file IS NOT NULL AND line IS NOT NULL)
SELECT s.file, s.line, f.v AS reaching FROM s ASOF LEFT JOIN f ON f.source_file = s.file AND s.line >= f.source_line
""")
def j8_reaching_value(spark, d):
    f = _facts(spark, d).where("resolved_value <> '' and source_file is not null and source_line is not null").groupBy(F.col("source_file").alias("file"), F.col("source_line").alias("at")).agg(F.min("resolved_value").alias("v"))
    s = _sites(spark, d).select("file", "line").where("file is not null and line is not null").distinct()
    return J.as_of(s, f, ["file"], "line", "at", "v", "reaching")


@query("j12_interaction_caller", f"""
WITH f AS (SELECT DISTINCT id, file, start_line, end_line FROM graph_functions WHERE file IS NOT NULL AND start_line > 0),
r AS (SELECT DISTINCT path, line FROM {RECORDS} WHERE path IS NOT NULL AND line IS NOT NULL),
e AS (SELECT r.path, r.line, min(f.id) AS id FROM r JOIN f ON f.file = r.path AND r.line BETWEEN f.start_line AND f.end_line GROUP BY ALL),
b AS (SELECT file, min(id) AS id FROM f GROUP BY ALL)
SELECT r.path, r.line, coalesce(e.id, b.id) AS function_id, CASE WHEN e.id IS NOT NULL THEN 'exact' WHEN b.id IS NOT NULL THEN 'file' ELSE 'none' END AS rule FROM r LEFT JOIN e USING (path, line) LEFT JOIN b ON b.file = r.path
""")
def j12_interaction_caller(spark, d):
    f = table(spark, d, "graph_functions").where("file is not null and start_line > 0").select("id", F.col("file").alias("path"), "start_line", "end_line").distinct()
    r = _records(spark, d).where("path is not null and line is not null").select("path", "line").distinct()
    e = J.containing(r, f, "path", "line", "start_line", "end_line").groupBy("path", "line").agg(F.min("id").alias("e"))
    b = f.groupBy("path").agg(F.min("id").alias("b"))
    rule = F.when(F.col("e").isNotNull(), "exact").when(F.col("b").isNotNull(), "file").otherwise("none")
    return r.join(e, ["path", "line"], "left").join(b, "path", "left").select("path", "line", F.coalesce("e", "b").alias("function_id"), rule.alias("rule"))


@query("j13_value_origins", f"SELECT target_function, file, line, arg_index, string_agg(DISTINCT origin_kind, ',' ORDER BY origin_kind) AS origins, count(DISTINCT source_file) AS source_files FROM {FACTS} WHERE file IS NOT NULL GROUP BY ALL")
def j13_value_origins(spark, d):
    return _facts(spark, d).where("file is not null").groupBy("target_function", "file", "line", "arg_index").agg(F.array_join(F.array_sort(F.collect_set("origin_kind")), ",").alias("origins"), F.countDistinct("source_file").alias("source_files"))


@query("j19_process_scoped_edges", f"""
SELECT c.process_name, count(*) AS edges, count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) AS inside
FROM (SELECT DISTINCT process_name, source, target FROM graph_calls WHERE kind = 'direct' AND source IS NOT NULL AND target IS NOT NULL) c
LEFT JOIN (SELECT DISTINCT process_name, id FROM graph_functions) a ON a.process_name = c.process_name AND a.id = c.source LEFT JOIN (SELECT DISTINCT process_name, id FROM graph_functions) b ON b.process_name = c.process_name AND b.id = c.target GROUP BY ALL
""")
def j19_process_scoped_edges(spark, d):
    c = table(spark, d, "graph_calls").where("kind = 'direct' and source is not null and target is not null").select("process_name", "source", "target").distinct()
    f = table(spark, d, "graph_functions").select("process_name", "id").distinct()
    side = lambda col: f.select("process_name", F.col("id").alias(col), F.lit(1).alias(f"has_{col}"))
    j = c.join(side("source"), ["process_name", "source"], "left").join(side("target"), ["process_name", "target"], "left")
    return j.groupBy("process_name").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("has_source").isNotNull() & F.col("has_target").isNotNull()).alias("inside"))


@query("j22_alias_resources", f"""
WITH p AS (SELECT DISTINCT process_name FROM source_files)
SELECT r.process_name, r.value, p.process_name AS alias, count(*) AS n FROM {RECORDS} r JOIN p ON 'proc_' || regexp_extract(r.value, '^[a-z]+') = p.process_name WHERE p.process_name <> r.process_name GROUP BY ALL
""")
def j22_alias_resources(spark, d):
    p = table(spark, d, "source_files").select(F.col("process_name").alias("alias")).distinct()
    r = _records(spark, d).withColumn("alias", F.concat(F.lit("proc_"), F.regexp_extract("value", "^([a-z]+)", 1)))
    return r.join(p, "alias").where("alias <> process_name").groupBy("process_name", "value", "alias").agg(F.count(F.lit(1)).alias("n"))


@query("a3_fork_targets", f"SELECT process_name, string_agg(DISTINCT lpad(CAST(line AS VARCHAR), 6, '0') || ':' || value, ',' ORDER BY lpad(CAST(line AS VARCHAR), 6, '0') || ':' || value) AS targets FROM {RECORDS} WHERE operation = 'FORKPROC' AND value IS NOT NULL AND line IS NOT NULL GROUP BY ALL")
def a3_fork_targets(spark, d):
    at = F.concat(F.lpad(F.col("line").cast("string"), 6, "0"), F.lit(":"), F.col("value"))
    return _records(spark, d).where("operation = 'FORKPROC' and value is not null and line is not null").groupBy("process_name").agg(F.array_join(F.array_sort(F.collect_set(at)), ",").alias("targets"))


@query("a4_dynamic_expressions", f"SELECT evidence_process, count(DISTINCT target_expression) AS expressions FROM {FACTS} WHERE regexp_matches(target_expression, '->|\\[') GROUP BY ALL")
def a4_dynamic_expressions(spark, d):
    return _facts(spark, d).where(V.is_dynamic(F.col("target_expression"))).groupBy("evidence_process").agg(F.countDistinct("target_expression").alias("expressions"))


@query("a18_function_resources", f"""
WITH f AS (SELECT DISTINCT id, file, start_line, end_line FROM graph_functions WHERE start_line > 0)
SELECT f.id AS function_id, count(DISTINCT r.value) AS n_values, string_agg(DISTINCT r.resource, ',' ORDER BY r.resource) AS resources FROM f JOIN {RECORDS} r ON r.path = f.file AND r.line BETWEEN f.start_line AND f.end_line GROUP BY ALL
""")
def a18_function_resources(spark, d):
    f = table(spark, d, "graph_functions").where("start_line > 0").select(F.col("id").alias("function_id"), F.col("file").alias("path"), "start_line", "end_line").distinct()
    j = J.containing(_records(spark, d).select("path", "line", "value", "resource"), f, "path", "line", "start_line", "end_line")
    return j.groupBy("function_id").agg(F.countDistinct("value").alias("n_values"), F.array_join(F.array_sort(F.collect_set("resource")), ",").alias("resources"))


@query("a21_comparison_counts", f"SELECT held_by, operation, count(*) AS records, count(DISTINCT path) AS files, count(DISTINCT value) AS n_values FROM {RECORDS} GROUP BY ALL")
def a21_comparison_counts(spark, d):
    return _records(spark, d).groupBy("held_by", "operation").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("path").alias("files"), F.countDistinct("value").alias("n_values"))


@query("a26_unresolved_reason", f"""
WITH g AS (SELECT file, line, bool_or(link_method = 'LLM') AS m, bool_or(status = 'CYCLE') AS c, bool_or(reachability = 'NO_PROCESS_ROOT') AS r, bool_or(origin_kind = 'CONST_TABLE') AS t FROM {FACTS} WHERE file IS NOT NULL AND line IS NOT NULL AND status <> 'EXACT' GROUP BY ALL)
SELECT CASE WHEN c THEN 'cycle' WHEN r THEN 'no_root' WHEN m THEN 'model_only' WHEN t THEN 'table' ELSE 'other' END AS reason, count(*) AS sites FROM g GROUP BY ALL
""")
def a26_unresolved_reason(spark, d):
    any_ = lambda c, v: F.bool_or(F.col(c) == v)
    g = _facts(spark, d).where("file is not null and line is not null and status <> 'EXACT'").groupBy("file", "line").agg(
        any_("link_method", "LLM").alias("m"), any_("status", "CYCLE").alias("c"), any_("reachability", "NO_PROCESS_ROOT").alias("r"), any_("origin_kind", "CONST_TABLE").alias("t")
    )
    return g.groupBy(F.when(F.col("c"), "cycle").when(F.col("r"), "no_root").when(F.col("m"), "model_only").when(F.col("t"), "table").otherwise("other").alias("reason")).agg(F.count(F.lit(1)).alias("sites"))


@query("a29_run_rollup", "SELECT results_set, count(*) AS runs, count(DISTINCT process_name) AS processes, max(generated_at) AS latest, CAST(sum(function_count) AS BIGINT) AS functions FROM (SELECT DISTINCT * FROM graph_runs) GROUP BY ALL")
def a29_run_rollup(spark, d):
    r = once(table(spark, d, "graph_runs"))
    return r.groupBy("results_set").agg(F.count(F.lit(1)).alias("runs"), F.countDistinct("process_name").alias("processes"), F.max("generated_at").alias("latest"), F.sum(F.col("function_count").cast("bigint")).alias("functions"))


@query("a30_capped_paths", f"SELECT target_function, resolved_value, CAST(sum(path_count) AS BIGINT) AS paths, least(CAST(sum(path_count) AS BIGINT), 64) AS kept, sum(path_count) > 64 AS truncated FROM {FACTS} WHERE resolved_value <> '' GROUP BY ALL")
def a30_capped_paths(spark, d):
    g = _facts(spark, d).where("resolved_value <> ''").groupBy("target_function", "resolved_value").agg(F.sum(F.col("path_count").cast("bigint")).alias("paths"))
    return g.select("*", F.least("paths", F.lit(64).cast("bigint")).alias("kept"), (F.col("paths") > 64).alias("truncated"))


@query("a31_library_groups", f"""
WITH f AS (SELECT DISTINCT id, CASE WHEN file LIKE '%/lib/%' THEN split_part(file, '/', 2) END AS component FROM graph_functions WHERE file IS NOT NULL)
SELECT a.component AS source_component, b.component AS target_component, a.component IS NOT DISTINCT FROM b.component AS same, count(*) AS calls FROM {DIRECT} c JOIN f a ON a.id = c.source JOIN f b ON b.id = c.target GROUP BY ALL
""")
def a31_library_groups(spark, d):
    comp = F.when(F.col("file").contains("/lib/"), F.split_part("file", F.lit("/"), F.lit(2)))
    f = table(spark, d, "graph_functions").where("file is not null").select("id", comp.alias("component")).distinct()
    j = _edges(spark, d, ("direct",)).join(f.select(F.col("id").alias("source"), F.col("component").alias("source_component")), "source").join(f.select(F.col("id").alias("target"), F.col("component").alias("target_component")), "target")
    return j.groupBy("source_component", "target_component", F.col("source_component").eqNullSafe(F.col("target_component")).alias("same")).agg(F.count(F.lit(1)).alias("calls"))


@query("wn2_latest_argmax", "SELECT results_set, process_name, arg_max(run_id, (generated_at, run_id)) AS run_id, max(generated_at) AS generated_at FROM (SELECT DISTINCT * FROM graph_runs) GROUP BY ALL")
def wn2_latest_argmax(spark, d):
    return table(spark, d, "graph_runs").groupBy("results_set", "process_name").agg(F.max_by("run_id", F.struct("generated_at", "run_id")).alias("run_id"), F.max("generated_at").alias("generated_at"))


@query("wn8_last_close_before_use", f"""
WITH e AS (SELECT file, line, bool_or(target_function = 'rtx_close') AS closes FROM {SITES} WHERE file IS NOT NULL AND line IS NOT NULL GROUP BY ALL)
SELECT file, line, max(CASE WHEN closes THEN line END) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_close FROM e
""")
def wn8_last_close_before_use(spark, d):
    e = _sites(spark, d).where("file is not null and line is not null").groupBy("file", "line").agg(F.bool_or(F.col("target_function") == "rtx_close").alias("closes"))
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return e.select("file", "line", F.max(F.when(F.col("closes"), F.col("line"))).over(w).alias("last_close"))


@query("wn10_running_budget", f"SELECT target_function, fact_id, path_count, sum(path_count) OVER (PARTITION BY target_function, file ORDER BY fact_id, path_count) <= 20 AS within FROM {FACTS} WHERE file IS NOT NULL")
def wn10_running_budget(spark, d):
    w = Window.partitionBy("target_function", "file").orderBy("fact_id", "path_count")
    return _facts(spark, d).where("file is not null").select("target_function", "fact_id", "path_count", (F.sum("path_count").over(w) <= 20).alias("within"))


@query("o3_text_order", f"SELECT evidence_process, fact_id, row_number() OVER (PARTITION BY evidence_process, file ORDER BY CAST(line AS VARCHAR), fact_id) AS position FROM {FACTS} WHERE file IS NOT NULL AND line IS NOT NULL")
def o3_text_order(spark, d):
    w = Window.partitionBy("evidence_process", "file").orderBy(F.col("line").cast("string"), "fact_id")
    return _facts(spark, d).where("file is not null and line is not null").select("evidence_process", "fact_id", F.row_number().over(w).alias("position"))


@query("o8_best_definition", f"""
SELECT name, id FROM (SELECT name, id, row_number() OVER (PARTITION BY name ORDER BY is_external, source IS NULL, end_line - start_line DESC NULLS LAST, id) AS rn FROM {FUNCTIONS}) WHERE rn = 1
""")
def o8_best_definition(spark, d):
    span = F.coalesce(F.col("end_line") - F.col("start_line"), F.lit(-1))
    return _functions(spark, d).groupBy("name").agg(F.min_by("id", F.struct("is_external", F.col("source").isNull(), -span, "id")).alias("id"))


@query("u4_value_difference", f"""
WITH x AS (SELECT path, line, list_sort(list(DISTINCT value) FILTER (held_by = 'scan' AND value IS NOT NULL)) AS a, list_sort(list(DISTINCT value) FILTER (held_by = 'flow' AND value IS NOT NULL)) AS b FROM {RECORDS} GROUP BY ALL)
SELECT path, line, array_to_string([v FOR v IN coalesce(a, []) IF NOT list_contains(coalesce(b, []), v)], ',') AS lost, array_to_string([v FOR v IN coalesce(b, []) IF NOT list_contains(coalesce(a, []), v)], ',') AS gained FROM x WHERE coalesce(a, []) <> coalesce(b, [])
""")
def u4_value_difference(spark, d):
    pick = lambda who: F.array_sort(F.collect_set(F.when(F.col("held_by") == who, F.col("value"))))
    x = _records(spark, d).groupBy("path", "line").agg(pick("scan").alias("a"), pick("flow").alias("b")).where("a <> b")
    return x.select("path", "line", F.array_join(F.array_except("a", "b"), ",").alias("lost"), F.array_join(F.array_except("b", "a"), ",").alias("gained"))


@query("u6_equality_samples", f"""
WITH a AS (SELECT DISTINCT file, line FROM {SITES}), b AS (SELECT DISTINCT file, line FROM {FACTS} WHERE file IS NOT NULL AND line IS NOT NULL)
SELECT 'sites' AS side, file, line FROM (SELECT * FROM a EXCEPT SELECT * FROM b ORDER BY file, line LIMIT 5) UNION ALL SELECT 'facts', file, line FROM (SELECT * FROM b EXCEPT SELECT * FROM a ORDER BY file, line LIMIT 5)
""")
def u6_equality_samples(spark, d):
    s = _sites(spark, d).select("file", "line").distinct().withColumn("n", F.lit(1))
    f = _facts(spark, d).where("file is not null and line is not null").select("file", "line").distinct().withColumn("n", F.lit(-1))
    diff = s.unionByName(f).groupBy("file", "line").agg(F.sum("n").alias("n")).where("n <> 0")
    one = lambda cond, side: diff.where(cond).orderBy("file", "line").limit(5).select(F.lit(side).alias("side"), "file", "line")
    return one("n > 0", "sites").unionByName(one("n < 0", "facts"))


# ---- labels, filters, cleanups

LABEL = "'[' || coalesce(f.file, '') || ':' || f.start_line || '-' || f.end_line || ']' || f.name"


@query("pr24_label_parse", f"""
WITH l AS (SELECT DISTINCT id, name, file, start_line, end_line FROM graph_functions WHERE start_line > 0)
SELECT id, file, start_line, end_line, name FROM l
""")
def pr24_label_parse(spark, d):
    f = table(spark, d, "graph_functions").where("start_line > 0").select("id", F.format_string("[%s:%d-%d]%s", F.coalesce("file", F.lit("")), "start_line", "end_line", "name").alias("label")).distinct()
    part = lambda i: F.regexp_extract("label", r"^\[(.*):(\d+)-(\d+)\](.*)$", i)
    return f.select("id", F.nullif(part(1), F.lit("")).alias("file"), part(2).cast("int").alias("start_line"), part(3).cast("int").alias("end_line"), part(4).alias("name"))


@query("pr25_arrow_split", """
WITH e AS (SELECT DISTINCT source, target FROM graph_calls WHERE kind = 'direct' AND source IS NOT NULL AND target IS NOT NULL)
SELECT source, target, 1 AS position, '[a->b]' || source AS label FROM e UNION ALL SELECT source, target, 2, '[c]' || target FROM e
""")
def pr25_arrow_split(spark, d):
    e = _edges(spark, d, ("direct",)).withColumn("trail", F.concat(F.lit("[a->b]"), "source", F.lit("->[c]"), "target"))
    return e.select("source", "target", F.posexplode(F.split("trail", r"->(?=\[)")).alias("p", "label")).select("source", "target", (F.col("p") + 1).alias("position"), "label")


@query("pr17_safe_names", "SELECT DISTINCT path, coalesce(nullif(trim(regexp_replace(path, '[^A-Za-z0-9._-]+', '_', 'g'), '_'), ''), 'unnamed') AS safe FROM source_files")
def pr17_safe_names(spark, d):
    return table(spark, d, "source_files").select("path", F.coalesce(F.nullif(F.btrim(F.regexp_replace("path", "[^A-Za-z0-9._-]+", "_"), F.lit("_")), F.lit("")), F.lit("unnamed")).alias("safe")).distinct()


@query("pr20_rendered_status", f"""
SELECT fact_id, CASE status WHEN 'EXACT' THEN coalesce(nullif(resolved_value, ''), '?') WHEN 'DYNAMIC' THEN '<runtime>' WHEN 'EXTERNAL' THEN '<external>' WHEN 'NO_TARGET' THEN 'NA' ELSE '<' || lower(status) || '>' END AS answer FROM {FACTS}
""")
def pr20_rendered_status(spark, d):
    s = F.col("status")
    a = F.when(s == "EXACT", F.coalesce(F.nullif("resolved_value", F.lit("")), F.lit("?"))).when(s == "DYNAMIC", "<runtime>").when(s == "EXTERNAL", "<external>").when(s == "NO_TARGET", "NA").otherwise(F.concat(F.lit("<"), F.lower(s), F.lit(">")))
    return _facts(spark, d).select("fact_id", a.alias("answer"))


@query("fl3_sources_only", "SELECT process_name, count(DISTINCT path) AS sources FROM source_files WHERE NOT path LIKE '%.h' GROUP BY ALL")
def fl3_sources_only(spark, d):
    return table(spark, d, "source_files").where("not endswith(path, '.h')").groupBy("process_name").agg(F.countDistinct("path").alias("sources"))


@query("fl6_handle_operations", f"SELECT operation IN ('READ', 'WRITE', 'GETREC', 'WRITEREC', 'UPDATEREC', 'FWRITE') AS handle_operation, count(*) AS records FROM {RECORDS} GROUP BY ALL")
def fl6_handle_operations(spark, d):
    return _records(spark, d).groupBy(F.col("operation").isin("READ", "WRITE", "GETREC", "WRITEREC", "UPDATEREC", "FWRITE").alias("handle_operation")).agg(F.count(F.lit(1)).alias("records"))


@query("fl8_library_owned", f"SELECT target_function, file, line FROM {FACTS} WHERE file IS NOT NULL AND line IS NOT NULL GROUP BY ALL HAVING bool_and(file LIKE '%/lib/%') AND bool_and(source_file LIKE '%/lib/%')")
def fl8_library_owned(spark, d):
    lib = lambda c: F.bool_and(F.col(c).contains("/lib/"))
    return _facts(spark, d).where("file is not null and line is not null").groupBy("target_function", "file", "line").agg(lib("file").alias("a"), lib("source_file").alias("b")).where("a and b").drop("a", "b")


@query("fl9_guard_contradiction", """
WITH g AS (SELECT DISTINCT fact_id, file AS f, line AS l, regexp_extract(json_extract_string(metadata, '$.guard'), '> (\\d+)', 1)::INT AS v, json_extract_string(metadata, '$.arm') AS arm FROM """ + FACTS + """ WHERE json_extract_string(metadata, '$.guard') IS NOT NULL)
SELECT a.fact_id AS fact_a, b.fact_id AS fact_b FROM g a JOIN g b ON a.f = b.f AND a.l = b.l AND a.arm <> b.arm AND a.v = b.v WHERE a.fact_id < b.fact_id
""")
def fl9_guard_contradiction(spark, d):
    guard = F.get_json_object("metadata", "$.guard")
    g = table(spark, d, "discovery_facts").where(guard.isNotNull()).select("fact_id", plain_path(F.col("target_site_file")).alias("f"), F.col("target_site_line").alias("l"), F.regexp_extract(guard, r"> (\d+)", 1).try_cast("int").alias("v"), F.get_json_object("metadata", "$.arm").alias("arm")).distinct()
    b = g.select(F.col("fact_id").alias("fact_b"), "f", "l", "v", F.col("arm").alias("arm_b"))
    return g.join(b, ["f", "l", "v"]).where("arm <> arm_b and fact_id < fact_b").select(F.col("fact_id").alias("fact_a"), "fact_b")


@query("r1_retrieval_documents", f"SELECT id AS ref_id, 'summary' AS lane, coalesce(summary, name) AS text FROM {FUNCTIONS} UNION ALL SELECT DISTINCT resource || ' ' || value, 'resource', resource || ' ' || value FROM {RECORDS} WHERE value IS NOT NULL")
def r1_retrieval_documents(spark, d):
    s = _functions(spark, d).select(F.col("id").alias("ref_id"), F.lit("summary").alias("lane"), F.coalesce("summary", "name").alias("text"))
    key = F.concat_ws(" ", "resource", "value")
    r = _records(spark, d).where("value is not null").select(key.alias("ref_id"), F.lit("resource").alias("lane"), key.alias("text")).distinct()
    return s.unionByName(r)


@query("x13_root_scoring", f"""
WITH r AS (SELECT DISTINCT function_id FROM run_functions), f AS (SELECT DISTINCT id, source IS NOT NULL AS has FROM graph_functions)
SELECT CASE WHEN f.id IS NULL THEN 'missing' WHEN f.has THEN 'found' ELSE 'prototype_only' END AS score, count(*) AS functions FROM r LEFT JOIN f ON f.id = r.function_id GROUP BY ALL
""")
def x13_root_scoring(spark, d):
    r = table(spark, d, "run_functions").select(F.col("function_id").alias("id")).distinct()
    f = table(spark, d, "graph_functions").select("id", F.col("source").isNotNull().alias("has")).distinct()
    return r.join(f, "id", "left").groupBy(F.when(F.col("has").isNull(), "missing").when(F.col("has"), "found").otherwise("prototype_only").alias("score")).agg(F.count(F.lit(1)).alias("functions"))


@query("x45_source_digests", "SELECT file_id, sha256(content) AS sha256, len(string_split(content, chr(10))) AS lines FROM (SELECT DISTINCT file_id, content FROM source_files WHERE content IS NOT NULL)")
def x45_source_digests(spark, d):
    f = table(spark, d, "source_files").where("content is not null").select("file_id", "content").distinct()
    return f.select("file_id", F.sha2("content", 256).alias("sha256"), F.size(F.split("content", "\n")).cast("bigint").alias("lines"))
