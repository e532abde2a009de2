"""Catalogs, specifications, manifests and reports of the warehouse, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import values as V
from spanloom.operators import aggregates as A
from spanloom.operators import graph as G
from spanloom.operators import joins as J
from spanloom.operators import retrieval as R
from spanloom.operators.csource import classified_lines, scanned
from spanloom.plans.warehouse import CALLS, DIRECT, EDGES, FACTS, FUNCTIONS, LAYERS, RECORDS, ROOTS, SITES, _calls, _edges, _facts, _functions, _records, _sites, once, r3_bm25_topk
from spanloom.plans.warehouse import BM25_SQL
from spanloom.sources.tables import table

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


# ---- sources and sinks


@query("s2_validated_paths", "SELECT path, count(DISTINCT file_id) AS ids, bool_or(content IS NOT NULL) AS readable FROM source_files WHERE path IS NOT NULL AND path <> '' GROUP BY ALL")
def s2_validated_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").where("path is not null and path <> ''").groupBy("path").agg(F.countDistinct("file_id").alias("ids"), F.bool_or(F.col("content").isNotNull()).alias("readable"))


@query("s7_project_files", """
WITH f AS (SELECT DISTINCT process_name, path, regexp_extract(path, '[^/]+$') AS base FROM source_files)
SELECT process_name, CASE WHEN row_number() OVER (PARTITION BY process_name, base ORDER BY path) = 1 THEN base ELSE path END AS key, path FROM f
""")
def s7_project_files(spark, d):
    f = table(spark, d, "source_files").select("process_name", "path").distinct().withColumn("base", F.regexp_extract("path", "([^/]+)$", 1))
    w = Window.partitionBy("process_name", "base").orderBy("path")
    return f.select("process_name", F.when(F.row_number().over(w) == 1, F.col("base")).otherwise(F.col("path")).alias("key"), "path")


SPEC = "cell string, targets array<struct<name: string, type: string, indices: array<int>, handle_index: int, note: string>>, discovery struct<resource: string, lock_arg: int>"


def _specs(spark, d):
    f = table(spark, d, "source_files").where("endswith(path, '.json') and content is not null").select("file_id", "content").distinct()
    return f.withColumn("s", F.from_json(F.ltrim("content"), SPEC, {"mode": "PERMISSIVE"}))


@query("s20_target_specs", """
WITH j AS (SELECT DISTINCT file_id, content FROM source_files WHERE path LIKE '%.json' AND content IS NOT NULL AND json_valid(content)),
t AS (SELECT file_id, unnest(from_json(json_extract(content, '$.targets'), '["JSON"]')) AS x FROM j)
SELECT json_extract_string(x, '$.type') AS type, count(*) AS targets, count(json_extract_string(x, '$.handle_index')) AS with_handle, CAST(sum(json_array_length(x, '$.indices')) AS BIGINT) AS indices FROM t GROUP BY ALL
""")
def s20_target_specs(spark, d):
    whole = F.expr("try_parse_json(content)").isNotNull()
    t = _specs(spark, d).where(whole).select(F.explode("s.targets").alias("x"))
    return t.groupBy("x.type").agg(F.count(F.lit(1)).alias("targets"), F.count("x.handle_index").alias("with_handle"), F.sum(F.size("x.indices")).alias("indices"))


@query("s22_config_merge", f"""
WITH a AS (SELECT id, max(nullif(name, '')) AS name, max(nullif(file, '')) AS file FROM {FUNCTIONS} GROUP BY ALL), b AS (SELECT function_id AS id, max(nullif(name, '')) AS name, max(nullif(file, '')) AS file FROM run_functions GROUP BY ALL)
SELECT coalesce(a.id, b.id) AS id, coalesce(a.name, b.name) AS name, coalesce(a.file, b.file) AS file FROM a FULL JOIN b ON a.id = b.id
""")
def s22_config_merge(spark, d):
    best = lambda c: F.max(F.nullif(c, F.lit(""))).alias(c)
    a = _functions(spark, d).groupBy("id").agg(best("name"), best("file"))
    b = table(spark, d, "run_functions").groupBy(F.col("function_id").alias("id")).agg(best("name"), best("file"))
    return a.alias("a").join(b.alias("b"), "id", "full_outer").select("id", F.coalesce("a.name", "b.name").alias("name"), F.coalesce("a.file", "b.file").alias("file"))


@query("k4_flat_structs", """
WITH j AS (SELECT DISTINCT file_id, content FROM source_files WHERE path LIKE '%.json' AND content IS NOT NULL AND json_valid(content))
SELECT file_id, json_extract_string(content, '$.cell') AS cell, json_extract_string(content, '$.discovery.resource') AS "discovery->resource", CAST(json_extract_string(content, '$.discovery.lock_arg') AS INT) AS "discovery->lock_arg" FROM j
""")
def k4_flat_structs(spark, d):
    s = _specs(spark, d).where(F.expr("try_parse_json(content)").isNotNull())
    return s.select("file_id", "s.cell", F.col("s.discovery.resource").alias("discovery->resource"), F.col("s.discovery.lock_arg").alias("discovery->lock_arg"))


@query("k6_compact_json", "SELECT DISTINCT results_set, run_id, '{\"process\":\"' || process_name || '\",\"functions\":' || function_count || '}' AS record FROM graph_runs WHERE process_name IS NOT NULL AND function_count IS NOT NULL")
def k6_compact_json(spark, d):
    r = table(spark, d, "graph_runs").where("process_name is not null and function_count is not null").distinct()
    return r.select("results_set", "run_id", F.to_json(F.struct(F.col("process_name").alias("process"), F.col("function_count").alias("functions"))).alias("record")).distinct()


@query("k7_manifest_upsert", """
WITH r AS (SELECT DISTINCT * FROM graph_runs), n AS (SELECT * FROM r WHERE results_set >= (SELECT max(results_set) FROM r)), o AS (SELECT * FROM r WHERE results_set < (SELECT max(results_set) FROM r))
SELECT process_name, run_id, results_set FROM n UNION ALL SELECT process_name, run_id, results_set FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.process_name = o.process_name AND n.run_id = o.run_id)
""")
def k7_manifest_upsert(spark, d):
    r = once(table(spark, d, "graph_runs"))
    newest = r.agg(F.max("results_set")).first()[0]
    marked = r.withColumn("new", F.col("results_set") == F.lit(newest))
    new, old = marked.where("new"), marked.where("not new")
    kept = old.join(new.select("process_name", "run_id").distinct(), ["process_name", "run_id"], "left_anti")
    cols = ["process_name", "run_id", "results_set"]
    return new.select(*cols).unionByName(kept.select(*cols))


@query("k8_edge_text", f"SELECT process_name, md5(string_agg(DISTINCT source || '-->' || target, chr(10) ORDER BY source || '-->' || target)) AS digest, count(DISTINCT source || '-->' || target) AS edges FROM {CALLS} WHERE kind = 'callback' AND source IS NOT NULL AND target IS NOT NULL GROUP BY ALL")
def k8_edge_text(spark, d):
    e = _calls(spark, d).where("kind = 'callback' and source is not null and target is not null").select("process_name", F.concat("source", F.lit("-->"), "target").alias("e")).distinct()
    return e.groupBy("process_name").agg(F.md5(F.array_join(F.array_sort(F.collect_list("e")), "\n")).alias("digest"), F.count(F.lit(1)).alias("edges"))


# ---- scalar transforms and filters


@query("pr2_compact_interactions", f"SELECT record_id, held_by, resource || ':' || coalesce(value, '') AS resource, CASE WHEN operation IN ('ADDQUE', 'WRITE', 'WRITEREC', 'UPDATEREC', 'FWRITE') THEN 'producer' WHEN operation IN ('DELQUE', 'READ', 'GETREC') THEN 'consumer' ELSE 'both' END AS direction FROM {RECORDS} GROUP BY ALL")
def pr2_compact_interactions(spark, d):
    return _records(spark, d).select("record_id", "held_by", F.concat("resource", F.lit(":"), F.coalesce("value", F.lit(""))).alias("resource"), V.direction(F.col("operation")).alias("direction")).distinct()


@query("pr7_package_name", f"SELECT value, CASE WHEN regexp_full_match(value, '[A-Za-z_][A-Za-z0-9_]*') THEN value END AS package FROM (SELECT DISTINCT value FROM {RECORDS})")
def pr7_package_name(spark, d):
    v = _records(spark, d).select("value").distinct()
    bare = F.regexp_replace("value", '^"(.*)"$', "$1")
    return v.select("value", F.when(bare.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), bare).alias("package"))


@query("pr10_handle_normal", f"SELECT arg_expression, regexp_replace(regexp_replace(trim(arg_expression), '^\\((.*)\\)$', '\\1'), '^&', '') AS handle, count(*) AS sites FROM {SITES} GROUP BY ALL")
def pr10_handle_normal(spark, d):
    h = F.regexp_replace(F.regexp_replace(F.trim("arg_expression"), r"^\((.*)\)$", "$1"), "^&", "")
    return _sites(spark, d).groupBy("arg_expression", h.alias("handle")).agg(F.count(F.lit(1)).alias("sites"))


@query("pr14_canonical_value", f"SELECT DISTINCT operation, value, CASE WHEN operation = 'FORKPROC' THEN trim(value, '\"') ELSE value END AS canonical FROM {RECORDS}")
def pr14_canonical_value(spark, d):
    return _records(spark, d).select("operation", "value", F.when(F.col("operation") == "FORKPROC", F.btrim("value", F.lit('"'))).otherwise(F.col("value")).alias("canonical")).distinct()


@query("pr16_path_head", "SELECT DISTINCT path, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) END AS head FROM source_files")
def pr16_path_head(spark, d):
    return table(spark, d, "source_files").select("path", F.when(F.contains("path", F.lit("/")), F.split_part("path", F.lit("/"), F.lit(1))).alias("head")).distinct()


@query("pr21_status_map", f"SELECT fact_id, CASE status WHEN 'EXACT' THEN 'RESOLVED' WHEN 'DYNAMIC' THEN 'RUNTIME' WHEN 'EXTERNAL' THEN 'EXTERNAL' WHEN 'NO_TARGET' THEN 'NO TARGET' ELSE 'UNRESOLVED' END AS mapped FROM {FACTS}")
def pr21_status_map(spark, d):
    pairs = {"EXACT": "RESOLVED", "DYNAMIC": "RUNTIME", "EXTERNAL": "EXTERNAL", "NO_TARGET": "NO TARGET"}
    m = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return _facts(spark, d).select("fact_id", F.coalesce(F.try_element_at(m, F.col("status")), F.lit("UNRESOLVED")).alias("mapped"))


@query("pr23_sort_keys", f"SELECT value, regexp_full_match(value, '[0-9]+') AS numeric, TRY_CAST(CASE WHEN regexp_full_match(value, '[0-9]+') THEN value END AS BIGINT) AS number FROM (SELECT DISTINCT value FROM {RECORDS} WHERE value IS NOT NULL)")
def pr23_sort_keys(spark, d):
    n = F.col("value").rlike("^[0-9]+$")
    return _records(spark, d).where("value is not null").select("value").distinct().select("value", n.alias("numeric"), F.when(n, F.col("value")).try_cast("bigint").alias("number"))


@query("fl4_traversable_edges", f"SELECT kind, count(*) AS edges FROM {CALLS} WHERE kind IN ('direct', 'indirect', 'callback', 'macro_expansion') GROUP BY ALL")
def fl4_traversable_edges(spark, d):
    return _calls(spark, d).where(F.col("kind").isin("direct", "indirect", "callback", "macro_expansion")).groupBy("kind").agg(F.count(F.lit(1)).alias("edges"))


@query("fl5_targets_without_facts", "SELECT DISTINCT target_function, operation FROM target_sites s WHERE NOT EXISTS (SELECT 1 FROM discovery_facts f WHERE f.target_function = s.target_function AND f.operation = s.operation)")
def fl5_targets_without_facts(spark, d):
    keys = ["target_function", "operation"]
    return table(spark, d, "target_sites").select(*keys).distinct().join(table(spark, d, "discovery_facts").select(*keys).distinct(), keys, "left_anti")


@query("fl7_group_members", "SELECT results_set, process_name, run_id FROM (SELECT DISTINCT results_set, process_name, run_id FROM run_functions) r WHERE (results_set, process_name, run_id) IN (SELECT results_set, process_name, run_id FROM graph_runs WHERE interaction_count > 0)")
def fl7_group_members(spark, d):
    keys = ["results_set", "process_name", "run_id"]
    return table(spark, d, "run_functions").select(*keys).distinct().join(table(spark, d, "graph_runs").where("interaction_count > 0").select(*keys), keys, "left_semi")


@query("fl12_entry_points", "SELECT DISTINCT id, name FROM graph_functions WHERE regexp_matches(name, '_(open|arm|load)_') AND file IN (SELECT path FROM source_files WHERE path LIKE '%.c')")
def fl12_entry_points(spark, d):
    f = table(spark, d, "graph_functions").where(F.col("name").rlike("_(open|arm|load)_")).select("id", "name", F.col("file").alias("path")).distinct()
    return f.join(table(spark, d, "source_files").where("endswith(path, '.c')").select("path").distinct(), "path", "left_semi").select("id", "name").distinct()


@query("fl13_selection", "SELECT DISTINCT results_set, process_name FROM graph_runs WHERE results_set <> '' AND process_name <> ''")
def fl13_selection(spark, d):
    return table(spark, d, "graph_runs").where("results_set <> '' and process_name <> ''").select("results_set", "process_name").distinct()


@query("fl14_mention_counts", """
WITH f AS (SELECT DISTINCT lower(name) AS name FROM graph_functions), t AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'))) AS name FROM documents WHERE text IS NOT NULL)
SELECT f.name, count(*) AS documents FROM f JOIN t USING (name) GROUP BY ALL
""")
def fl14_mention_counts(spark, d):
    f = table(spark, d, "graph_functions").select(F.lower("name").alias("name")).distinct()
    words = F.transform(F.regexp_extract_all("text", F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)), lambda x: F.lower(x))
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.array_distinct(words)).alias("name"))
    return t.join(f, "name").groupBy("name").agg(F.countDistinct("doc_id").alias("documents"))


# ---- joins, aggregations, order


@query("j11_attribution", f"""
SELECT c.id AS call_id, coalesce(a.name, c.source) AS function_name, b.name AS api FROM (SELECT DISTINCT id, source, target FROM graph_calls WHERE kind = 'external_call' AND source IS NOT NULL) c
JOIN (SELECT DISTINCT id, name FROM graph_functions WHERE is_library_api) b ON b.id = c.target LEFT JOIN (SELECT DISTINCT id, name FROM graph_functions WHERE NOT is_external) a ON a.id = c.source
""")
def j11_attribution(spark, d):
    f = table(spark, d, "graph_functions").select("id", "name", "is_library_api", "is_external").distinct()
    c = table(spark, d, "graph_calls").where("kind = 'external_call' and source is not null").select(F.col("id").alias("call_id"), "source", "target").distinct()
    api = f.where("is_library_api").select(F.col("id").alias("target"), F.col("name").alias("api"))
    own = f.where("not is_external").select(F.col("id").alias("source"), F.col("name").alias("own"))
    return c.join(api, "target").join(own, "source", "left").select("call_id", F.coalesce("own", "source").alias("function_name"), "api")


@query("j20_macro_targets", f"SELECT coalesce(nullif(macro_name, ''), target_function) AS called, target_function, count(*) AS sites FROM {SITES} GROUP BY ALL")
def j20_macro_targets(spark, d):
    return _sites(spark, d).groupBy(F.coalesce(F.nullif("macro_name", F.lit("")), "target_function").alias("called"), "target_function").agg(F.count(F.lit(1)).alias("sites"))


@query("j24_wrapper_coverage", f"""
WITH w AS (SELECT DISTINCT target_function, operation, resolved_value FROM {FACTS} WHERE link_method = 'MACRO_EXPANSION' AND resolved_value <> '')
SELECT f.fact_id, CASE WHEN w.target_function IS NOT NULL THEN 'ALIAS_INTERNAL' ELSE f.status END AS status FROM {FACTS} f LEFT JOIN w ON w.target_function = f.target_function AND w.operation = f.operation AND w.resolved_value = f.resolved_value AND f.link_method = 'VARTRACE'
""")
def j24_wrapper_coverage(spark, d):
    f = _facts(spark, d)
    keys = ["target_function", "operation", "resolved_value", "link_method"]
    w = f.where("link_method = 'MACRO_EXPANSION' and resolved_value <> ''").select(*keys[:3]).distinct().withColumns({"link_method": F.lit("VARTRACE"), "covered": F.lit(True)})
    return f.join(w, keys, "left").select("fact_id", F.when(F.col("covered"), "ALIAS_INTERNAL").otherwise(F.col("status")).alias("status"))


@query("a11_best_variant", f"SELECT name, arg_min(id, (CASE WHEN source IS NULL THEN 1 ELSE 0 END, CASE WHEN is_static THEN 1 ELSE 0 END, start_line, id)) AS id FROM {FUNCTIONS} GROUP BY ALL")
def a11_best_variant(spark, d):
    flag = lambda c: F.when(c, 1).otherwise(0)
    return _functions(spark, d).groupBy("name").agg(F.min_by("id", F.struct(flag(F.col("source").isNull()), flag(F.col("is_static")), "start_line", "id")).alias("id"))


@query("a28_runtime_summary", f"SELECT target_function, count(*) AS n_rows, count(DISTINCT (file, line)) AS sites, count(DISTINCT value_set_id) AS value_sets FROM {FACTS} WHERE resolution_status = 'RUNTIME' AND file IS NOT NULL AND line IS NOT NULL GROUP BY ALL")
def a28_runtime_summary(spark, d):
    f = _facts(spark, d).where("resolution_status = 'RUNTIME' and file is not null and line is not null")
    return f.groupBy("target_function").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("file", "line").alias("sites"), F.countDistinct("value_set_id").alias("value_sets"))


@query("a34_totals", f"SELECT resolver, CAST(sum(path_count) AS BIGINT) AS paths, count(*) AS facts FROM {FACTS} GROUP BY ALL")
def a34_totals(spark, d):
    return _facts(spark, d).groupBy("resolver").agg(F.sum(F.col("path_count").cast("bigint")).alias("paths"), F.count(F.lit(1)).alias("facts"))


@query("wn3_latest_set", "SELECT process_name, max(results_set) AS results_set FROM graph_runs GROUP BY ALL")
def wn3_latest_set(spark, d):
    return table(spark, d, "graph_runs").groupBy("process_name").agg(F.max("results_set").alias("results_set"))


@query("o5_distinct_traces", f"SELECT target_function, link_method, fact_id FROM (SELECT target_function, link_method, fact_id, row_number() OVER (PARTITION BY target_function ORDER BY fact_id) AS k FROM (SELECT target_function, link_method, min(fact_id) AS fact_id FROM {FACTS} GROUP BY ALL)) WHERE k <= 3")
def o5_distinct_traces(spark, d):
    t = _facts(spark, d).groupBy("target_function", "link_method").agg(F.min("fact_id").alias("fact_id"))
    return R.top(t, ["target_function"], [F.col("fact_id")], 3).select("target_function", "link_method", "fact_id")


@query("o6_longest_roots", "SELECT path, length(path) AS n FROM (SELECT DISTINCT path FROM source_files) ORDER BY n DESC, path LIMIT 50")
def o6_longest_roots(spark, d):
    return table(spark, d, "source_files").select("path", F.length("path").cast("bigint").alias("n")).distinct().orderBy(F.desc("n"), "path").limit(50)


@query("o9_newest_runs", "SELECT results_set, process_name, run_id FROM (SELECT DISTINCT * FROM graph_runs) ORDER BY generated_at DESC, process_name DESC, run_id DESC LIMIT 40")
def o9_newest_runs(spark, d):
    return once(table(spark, d, "graph_runs")).orderBy(F.desc("generated_at"), F.desc("process_name"), F.desc("run_id")).limit(40).select("results_set", "process_name", "run_id")


@query("u5_ordered_distinct", f"WITH x AS (SELECT target_function, link_method, min(fact_id) AS p FROM {FACTS} GROUP BY ALL) SELECT target_function, string_agg(link_method, ',' ORDER BY p) AS methods FROM x GROUP BY ALL")
def u5_ordered_distinct(spark, d):
    x = _facts(spark, d).where("link_method is not null").groupBy("target_function", "link_method").agg(F.min("fact_id").alias("p"))
    return x.groupBy("target_function").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "link_method"))), lambda s: s["link_method"]), ",").alias("methods"))


# ---- graphs


@query("g4_reachability_label", f"""
WITH RECURSIVE d AS (SELECT * FROM {DIRECT}), e AS (SELECT * FROM {EDGES}), r AS (SELECT node FROM {ROOTS.format('d')}),
a AS (SELECT node FROM r UNION SELECT d.target FROM a JOIN d ON d.source = a.node),
b AS (SELECT node FROM r UNION SELECT e.target FROM b JOIN e ON e.source = b.node)
SELECT id, CASE WHEN process_name IS NULL THEN 'OUT_OF_PROCESS_SCOPE' WHEN id IN (SELECT node FROM a) THEN 'DIRECT_ROOT' WHEN id IN (SELECT node FROM b) THEN 'CALLBACK' ELSE 'UNREACHABLE_IN_PROCESS' END AS reachability FROM (SELECT DISTINCT id, process_name FROM graph_functions)
""")
def g4_reachability_label(spark, d):
    direct, every = _edges(spark, d, ("direct",)), _edges(spark, d)
    seeds = G.roots(direct, "source", "target")
    a = G.reachable(direct, "source", "target", seeds).select(F.col("node").alias("id"), F.lit(True).alias("a"))
    b = G.reachable(every, "source", "target", seeds).select(F.col("node").alias("id"), F.lit(True).alias("b"))
    f = table(spark, d, "graph_functions").select("id", "process_name").distinct()
    label = F.when(F.col("process_name").isNull(), "OUT_OF_PROCESS_SCOPE").when(F.col("a"), "DIRECT_ROOT").when(F.col("b"), "CALLBACK").otherwise("UNREACHABLE_IN_PROCESS")
    return f.join(a, "id", "left").join(b, "id", "left").select("id", label.alias("reachability"))


@query("g12_dag_depth", "WITH RECURSIVE " + LAYERS.format(DIRECT, "t", "s") + "SELECT node, layer FROM layered")
def g12_dag_depth(spark, d):
    return G.layers(_edges(spark, d, ("direct",)), "target", "source").select("node", "layer")


@query("g26_edge_kinds", f"""
SELECT 'call' AS edge, source, target FROM {CALLS} WHERE kind IN ('direct', 'indirect', 'external_call') AND source IS NOT NULL AND target IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'macro', source, target FROM {CALLS} WHERE kind IN ('macro_call', 'macro_expansion') AND source IS NOT NULL AND target IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'callback', via, target FROM {CALLS} WHERE kind = 'callback' AND via IS NOT NULL AND target IS NOT NULL GROUP BY ALL
""")
def g26_edge_kinds(spark, d):
    c = _calls(spark, d).where("target is not null")
    kind = F.when(F.col("kind").isin("direct", "indirect", "external_call"), "call").when(F.col("kind").isin("macro_call", "macro_expansion"), "macro").otherwise("callback")
    return c.select(kind.alias("edge"), F.when(kind == "callback", F.col("via")).otherwise(F.col("source")).alias("source"), "target").where("source is not null").distinct()


# ---- value flow and reports


@query("wn8_last_open_before_use", f"""
WITH e AS (SELECT file, line, bool_or(target_function = 'rtx_open') AS opens, bool_or(target_function = 'rtx_close') AS closes FROM {SITES} WHERE file IS NOT NULL AND line IS NOT NULL GROUP BY ALL),
w AS (SELECT file, line, opens, closes, max(CASE WHEN opens THEN line END) OVER p AS last_open, max(CASE WHEN closes THEN line END) OVER p AS last_close FROM e WINDOW p AS (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT file, line, CASE WHEN last_open > coalesce(last_close, -1) THEN last_open END AS opened_at FROM w WHERE NOT opens AND NOT closes
""")
def wn8_last_open_before_use(spark, d):
    is_ = lambda n: F.bool_or(F.col("target_function") == n)
    e = _sites(spark, d).where("file is not null and line is not null").groupBy("file", "line").agg(is_("rtx_open").alias("opens"), is_("rtx_close").alias("closes"))
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.max(F.when(F.col(c), F.col("line"))).over(w)
    m = e.withColumns({"last_open": last("opens"), "last_close": last("closes")}).where("not opens and not closes")
    return m.select("file", "line", F.when(F.col("last_open") > F.coalesce("last_close", F.lit(-1)), F.col("last_open")).alias("opened_at"))


@query("v25_call_index")
def v25_call_index(spark, d):
    """Scanned calls of library functions with the id of the function around them."""
    calls = scanned(table(spark, d, "source_files")).where("what = 'call'").select("path", F.col("name").alias("callee"), "line", F.col("detail").alias("caller")).distinct()
    apis = table(spark, d, "graph_functions").where("is_library_api").select(F.col("name").alias("callee"), F.col("id").alias("callee_id")).distinct()
    own = table(spark, d, "graph_functions").where("file is not null").groupBy(F.col("file").alias("path"), F.col("name").alias("caller")).agg(F.min("id").alias("caller_id"))
    return calls.join(apis, "callee").join(own, ["path", "caller"], "left").select("path", "line", "caller", "caller_id", "callee", "callee_id")


@query("x2_fact_counters", f"SELECT status, count(*) AS n_rows, count(DISTINCT (file, line)) FILTER (file IS NOT NULL AND line IS NOT NULL) AS sites, count(DISTINCT resolved_value) FILTER (resolution_status = 'RUNTIME') AS runtime_values FROM {FACTS} GROUP BY ALL")
def x2_fact_counters(spark, d):
    site = F.when(F.col("file").isNotNull() & F.col("line").isNotNull(), F.struct("file", "line"))
    return _facts(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(site).alias("sites"), F.countDistinct(F.when(F.col("resolution_status") == "RUNTIME", F.col("resolved_value"))).alias("runtime_values"))


@query("x3_value_sets", f"SELECT file, line, string_agg(DISTINCT operation || '=' || resolved_value, ',' ORDER BY operation || '=' || resolved_value) AS value_set FROM {FACTS} WHERE status IN ('EXACT', 'DYNAMIC') AND resolved_value <> '' AND file IS NOT NULL AND line IS NOT NULL GROUP BY ALL")
def x3_value_sets(spark, d):
    f = _facts(spark, d).where("status in ('EXACT', 'DYNAMIC') and resolved_value <> '' and file is not null and line is not null")
    return f.groupBy("file", "line").agg(F.array_join(F.array_sort(F.collect_set(F.concat("operation", F.lit("="), "resolved_value"))), ",").alias("value_set"))


@query("x5_site_snapshots", f"""
SELECT target_function, file, line, string_agg(DISTINCT status, ',' ORDER BY status) AS statuses, string_agg(DISTINCT origin_kind, ',' ORDER BY origin_kind) AS origins, string_agg(DISTINCT link_method, ',' ORDER BY link_method) AS methods FROM {FACTS} WHERE file IS NOT NULL AND line IS NOT NULL GROUP BY ALL
""")
def x5_site_snapshots(spark, d):
    s = lambda c, n: F.array_join(F.array_sort(F.collect_set(c)), ",").alias(n)
    return _facts(spark, d).where("file is not null and line is not null").groupBy("target_function", "file", "line").agg(s("status", "statuses"), s("origin_kind", "origins"), s("link_method", "methods"))


@query("x23_call_names")
def x23_call_names(spark, d):
    calls = scanned(table(spark, d, "source_files")).where("what = 'call'").select("path", "name").distinct()
    return calls.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


@query("r7_filter_after_rank", BM25_SQL + "SELECT k.query, k.doc_id, k.rank FROM k JOIN documents d USING (doc_id) WHERE rank <= 20 AND (d.process_name IS NULL OR d.process_name <> 'proc_quarrybelt')")
def r7_filter_after_rank(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "process_name")
    return r3_bm25_topk(spark, d).join(docs, "doc_id").where("process_name is null or process_name <> 'proc_quarrybelt'").select("query", "doc_id", "rank")


@query("r9_embedding_cache", "SELECT sha1(text) AS key, count(*) AS uses FROM documents WHERE text <> '' GROUP BY ALL HAVING count(*) FILTER (written_at IS NULL) > 0")
def r9_embedding_cache(spark, d):
    """Texts to embed once: keys by content, here those with an undated use."""
    t = table(spark, d, "documents").where("text <> ''").groupBy(F.sha1("text").alias("key")).agg(F.count(F.lit(1)).alias("uses"), F.count_if(F.col("written_at").isNull()).alias("undated"))
    return t.where("undated > 0").select("key", "uses")


@query("r11_answer_payload", BM25_SQL + "SELECT query, '{\"doc_id\":' || doc_id || ',\"rank\":' || rank || '}' AS payload FROM k WHERE rank <= 20")
def r11_answer_payload(spark, d):
    return r3_bm25_topk(spark, d).select("query", F.to_json(F.struct("doc_id", "rank")).alias("payload"))


@query("a36_density_rates", f"SELECT evidence_process, count(*) AS facts, round(count(*) FILTER (status = 'EXACT')::DOUBLE / count(*), 6) AS exact_rate FROM {FACTS} GROUP BY ALL")
def a36_density_rates(spark, d):
    return _facts(spark, d).groupBy("evidence_process").agg(F.count(F.lit(1)).alias("facts"), A.rate(F.count_if(F.col("status") == "EXACT"), F.count(F.lit(1))).alias("exact_rate"))


@query("x1_line_states")
def x1_line_states(spark, d):
    """Lines per process and class: live, comment, blank, directive or switched off."""
    lines = classified_lines(table(spark, d, "source_files"))
    owner = table(spark, d, "source_files").select("path", "process_name").distinct()
    return lines.groupBy("path", "state").agg(F.count(F.lit(1)).alias("n")).join(owner, "path").groupBy("process_name", "state").agg(F.sum("n").alias("lines"))
