"""Queries of views, reports, sinks, caches and questions, each with its SQL."""

from __future__ import annotations

import json
import textwrap

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, MapType, StringType, StructField, StructType

from spanloom.functions import enums
from spanloom.functions import questions as Q
from spanloom.functions import values as V
from spanloom.functions.cexpr import c_formula
from spanloom.operators import retrieval as R
from spanloom.operators.csource import scanned_occurrences, static_variables
from spanloom.operators.flow import scanned_flow
from spanloom.plans.catalog import _specs
from spanloom.plans.routes import STEPS, _steps
from spanloom.plans.warehouse import (
    ASKED_SQL, CALLS, DIRECT, FACTS, FUNCTIONS, POSTS, RECORDS, SCAN_FLOW, SITES, _all_sites, _asked, _calls, _edges, _facts, _functions, _hits, _records, _scan_flow, once,
)
from spanloom.session import shared_folder
from spanloom.sources import cache as C
from spanloom.sources import makefile as M
from spanloom.sources import snapshots as S
from spanloom.sources.tables import table

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


# ---- sources

MAKE_SQL = """
f AS (SELECT DISTINCT process_name, path FROM source_files WHERE path LIKE '%.c' AND process_name IS NOT NULL),
n AS (SELECT DISTINCT process_name, trim(split_part(regexp_replace(trim(x), '^-[DU]', ''), '=', 1)) AS symbol FROM (SELECT process_name, unnest(defines) AS x FROM preprocessor_configs)),
g AS (SELECT * FROM n WHERE symbol <> '')
"""


@F.pandas_udf(ArrayType(StructType([StructField("what", StringType()), StructField("value", StringType())])))
def _make_inputs(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [(what, v) for what, vs in M.build_inputs(t).items() for v in vs])


def _makefiles(spark, d):
    """A Makefile of each process: continued lines, appended and expanded variables."""
    f = table(spark, d, "source_files").where("endswith(path, '.c') and process_name is not null").groupBy("process_name").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    c = table(spark, d, "preprocessor_configs").select("process_name", F.explode("defines").alias("x"))
    c = c.select("process_name", F.trim(F.split_part(F.regexp_replace(F.trim("x"), "^-[DU]", ""), F.lit("="), F.lit(1))).alias("s")).where("s <> ''").groupBy("process_name").agg(F.array_sort(F.collect_set("s")).alias("symbols"))
    head = F.concat(F.lit("# built\nDEFS := -DBASE\nSRCS = \\\n  "), F.array_join("paths", " \\\n  "), F.lit("\nOBJS = $(SRCS:.c=.o)\nCFLAGS += -Iinc $(DEFS)\n"))
    return f.join(c, "process_name", "left").select("process_name", F.concat(head, F.coalesce(F.array_join(F.transform("symbols", lambda s: F.concat(F.lit("CFLAGS += -D"), s, F.lit("=1"))), "\n"), F.lit(""))).alias("text"))


@F.pandas_udf(MapType(StringType(), IntegerType()))
def _make_words(texts: pd.Series) -> pd.Series:
    def one(text: str) -> dict[str, int]:
        names = M.variables(text)
        return {n: len(M.expand(v, names).split()) for n, v in names.items()}

    return texts.map(one)


@query("s4_makefile_variables", "WITH " + MAKE_SQL + """, c AS (SELECT process_name, count(*)::INT AS n FROM f GROUP BY ALL)
SELECT process_name, 'DEFS' AS name, 1 AS words FROM c UNION ALL SELECT process_name, 'SRCS', n FROM c UNION ALL SELECT process_name, 'OBJS', n FROM c
UNION ALL SELECT process_name, 'CFLAGS', 2 + (SELECT count(*) FROM g WHERE g.process_name = c.process_name)::INT FROM c
""")
def s4_makefile_variables(spark, d):
    """The variables of Makefiles, which are made from the tables, and how many words each expands to."""
    return _makefiles(spark, d).select("process_name", F.explode(_make_words("text")).alias("name", "words"))


@query("s5_makefile_inputs", "WITH " + MAKE_SQL + "SELECT process_name, 'sources' AS what, path AS value FROM f UNION ALL SELECT DISTINCT process_name, 'include_dirs', 'inc' FROM f UNION ALL SELECT DISTINCT process_name, 'defines', 'BASE' FROM f UNION ALL SELECT process_name, 'defines', symbol FROM g WHERE symbol <> 'BASE' AND process_name IN (SELECT process_name FROM f)")
def s5_makefile_inputs(spark, d):
    """Sources, folders and flags that Makefiles name, after expansion of their variables."""
    return _makefiles(spark, d).select("process_name", F.explode(_make_inputs("text")).alias("x")).select("process_name", "x.what", "x.value")


@query("s11_root_candidates")
def s11_root_candidates(spark, d):
    """Definitions, prototypes and calls of the functions that nobody calls, in all C files."""
    called = table(spark, d, "graph_calls").select(F.col("target").alias("id")).where("id is not null").distinct()
    names = table(spark, d, "graph_functions").where("not is_external").select("id", "name").distinct().join(called, "id", "left_anti").select("name").distinct()
    return scanned_occurrences(table(spark, d, "source_files")).join(names, "name", "left_semi").select("path", "name", "kind", "line").distinct()


@query("x14_candidate_kinds")
def x14_candidate_kinds(spark, d):
    return scanned_occurrences(table(spark, d, "source_files")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("x24_function_parameters")
def x24_function_parameters(spark, d):
    """Parameters of all C functions in declaration order."""
    rows = scanned_flow(table(spark, d, "source_files")).where("what = 'param'")
    return rows.select("process", "path", "function", "position", F.col("text").alias("parameter")).distinct()


@query("x25_static_variables")
def x25_static_variables(spark, d):
    return static_variables(table(spark, d, "source_files")).distinct()


@query("s16_projected_snapshots", "SELECT process_name, results_set, run_id, count(*) AS functions FROM (SELECT DISTINCT results_set, process_name, run_id, function_id FROM run_functions) GROUP BY ALL")
def s16_projected_snapshots(spark, d):
    """Counts from JSON snapshots of which the long texts are not parsed."""
    path = shared_folder(spark, "projected")
    r = table(spark, d, "run_functions").select("results_set", "process_name", "run_id", "function_id", "file", "source_sha256").distinct()
    one = r.groupBy("results_set", "process_name", "run_id").agg(F.collect_set(F.struct("function_id")).alias("functions"), F.array_join(F.collect_list(F.concat("file", "source_sha256")), "\n").alias("source_files"))
    one.write.json(path)
    read = S.read_snapshots(spark, path, "results_set string, process_name string, run_id string, functions array<struct<function_id: string>>")
    return read.select("process_name", "results_set", "run_id", F.size("functions").cast("bigint").alias("functions"))


@query("s17_tolerant_scan", "SELECT process_name, count(*) FILTER (json_valid(content)) AS read, count(*) FILTER (NOT json_valid(content)) AS recorded FROM (SELECT DISTINCT process_name, file_id, content FROM source_files WHERE path LIKE '%.json' AND content IS NOT NULL) GROUP BY ALL")
def s17_tolerant_scan(spark, d):
    """Specifications that could be read, and those that were recorded as unreadable."""
    f = table(spark, d, "source_files").where("endswith(path, '.json') and content is not null").select("process_name", "file_id", "content").distinct()
    ok = F.expr("try_parse_json(content)").isNotNull()
    return f.groupBy("process_name").agg(F.count_if(ok).alias("read"), F.count_if(~ok).alias("recorded"))


SPEC_SQL = """
WITH j AS (SELECT DISTINCT file_id, content FROM source_files WHERE path LIKE '%.json' AND content IS NOT NULL AND json_valid(content)),
t AS (SELECT file_id, unnest(from_json(json_extract(content, '$.targets'), '["JSON"]')) AS x FROM j),
v AS (SELECT file_id, json_extract_string(x, '$.type') AS type, coalesce(json_array_length(x, '$.indices'), 0) AS n, CAST(json_extract_string(x, '$.handle_index') AS INT) AS handle,
      list_contains(CAST(json_extract(x, '$.indices') AS INT[]), CAST(json_extract_string(x, '$.handle_index') AS INT)) AS inside FROM t)
"""


@query("s21_spec_validation", SPEC_SQL + """
SELECT fault, count(*) AS targets, count(DISTINCT file_id) AS files FROM (SELECT file_id, unnest([CASE WHEN type IS NULL OR type NOT IN ('OPENF', 'RECF', 'QUEF', 'CLOSEF') THEN 'unexpected_type' END, CASE WHEN n = 0 THEN 'no_index' END,
  CASE WHEN handle < 1 THEN 'bad_handle' END, CASE WHEN coalesce(NOT inside, false) THEN 'handle_not_indexed' END]) AS fault FROM v) WHERE fault IS NOT NULL GROUP BY ALL
""")
def s21_spec_validation(spark, d):
    """Faults of target specifications by kind: types beyond the expected ones, no or bad argument positions."""
    t = _specs(spark, d).where(F.expr("try_parse_json(content)").isNotNull()).select("file_id", F.explode("s.targets").alias("x")).select("file_id", "x.*")
    n = F.coalesce(F.size("indices"), F.lit(0))
    faults = F.array(
        F.when(F.col("type").isNull() | ~F.col("type").isin("OPENF", "RECF", "QUEF", "CLOSEF"), "unexpected_type"), F.when(n <= 0, "no_index"),
        F.when(F.col("handle_index") < 1, "bad_handle"), F.when(~F.array_contains("indices", F.col("handle_index")), "handle_not_indexed"),
    )
    rows = t.select("file_id", F.explode(faults).alias("fault")).where("fault is not null")
    return rows.groupBy("fault").agg(F.count(F.lit(1)).alias("targets"), F.countDistinct("file_id").alias("files"))


@query("v27_cached_query", "SELECT process_name, count(DISTINCT id) AS functions FROM graph_functions GROUP BY ALL")
def v27_cached_query(spark, d):
    """A result kept under the fingerprint of its input files; the second reading builds nothing."""
    build = lambda: table(spark, d, "graph_functions").groupBy("process_name").agg(F.countDistinct("id").alias("functions"))
    for _ in range(2):
        out = C.cached(spark, "functions", [f"{d}/graph_functions.parquet"], build)
    return out


# ---- sinks


@query("k1_atomic_json", "SELECT count(*) AS runs, CAST(sum(function_count) AS BIGINT) AS functions FROM (SELECT DISTINCT * FROM graph_runs)")
def k1_atomic_json(spark, d):
    """A report of two numbers, replaced as a whole and read again."""
    r = once(table(spark, d, "graph_runs")).agg(F.count(F.lit(1)).alias("runs"), F.sum(F.col("function_count").cast("bigint")).alias("functions")).first()
    path = f"{shared_folder(spark, 'report')}.json"
    C.write_whole(spark, path, "{}")
    C.write_whole(spark, path, json.dumps(r.asDict()))
    return spark.read.schema("runs bigint, functions bigint").json(path)


@query("k2_fixed_csv", f"SELECT CAST(fact_id AS VARCHAR) AS fact_id, coalesce(status, '') AS status, coalesce(resolved_value, '') AS resolved_value FROM {FACTS}")
def k2_fixed_csv(spark, d):
    """A table with fixed columns as text; other columns are left out."""
    path = shared_folder(spark, "fixed")
    S.write_csv(_facts(spark, d).select("fact_id", "status", "resolved_value"), path)
    return S.read_csv(spark, path, ["fact_id", "status", "resolved_value"])


@query("k3_appended_csv", "SELECT DISTINCT process_name, coalesce(CAST(run_id AS VARCHAR), '') AS run_id FROM graph_runs WHERE process_name IS NOT NULL")
def k3_appended_csv(spark, d):
    """Two appends with a row twice; what is read is normalised in the plan."""
    path = shared_folder(spark, "appended")
    r = table(spark, d, "graph_runs").where("process_name is not null").select("process_name", "run_id")
    for part in (r.where("results_set < 'results_0000005'"), r):
        part.write.mode("append").option("header", True).csv(path)
    return spark.read.option("header", True).schema("process_name string, run_id string").csv(path).select("process_name", F.coalesce("run_id", F.lit("")).alias("run_id")).distinct()


@query("k9_report_rows", f"SELECT '| ' || coalesce(evidence_process, '?') || ' | ' || count(*) || ' | ' || count(*) FILTER (status = 'EXACT') || ' |' AS line FROM {FACTS} GROUP BY evidence_process")
def k9_report_rows(spark, d):
    """The lines of a report's section; :func:`spanloom.sources.cache.with_section` puts them between its markers."""
    g = _facts(spark, d).groupBy("evidence_process").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "EXACT").alias("e"))
    return g.select(F.concat(F.lit("| "), F.coalesce("evidence_process", F.lit("?")), F.lit(" | "), F.col("n").cast("string"), F.lit(" | "), F.col("e").cast("string"), F.lit(" |")).alias("line"))


# ---- projections and filters


@query("pr1_plane_columns", f"""
SELECT f.id, f.kind, f.name, f.file_name, f.start_line, f.end_line, f.is_external, f.is_library_api, f.is_static, f.summary_status, coalesce(c.calls, 0) AS call_count, coalesce(c.outside, 0) AS external_call_count
FROM (SELECT DISTINCT id, kind, name, file_name, start_line, end_line, is_external, is_library_api, is_static, summary_status FROM graph_functions) f
LEFT JOIN (SELECT source, count(*) AS calls, count(*) FILTER (kind = 'external_call') AS outside FROM {CALLS} GROUP BY ALL) c ON c.source = f.id
""")
def pr1_plane_columns(spark, d):
    """The columns of functions that a map of them needs; texts are read elsewhere."""
    keys = ["id", "kind", "name", "file_name", "start_line", "end_line", "is_external", "is_library_api", "is_static", "summary_status"]
    c = _calls(spark, d).groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("kind") == "external_call").alias("outside"))
    zero = lambda x, n: F.coalesce(x, F.lit(0).cast("bigint")).alias(n)
    return table(spark, d, "graph_functions").select(*keys).distinct().join(c, "id", "left").select(*keys, zero("calls", "call_count"), zero("outside", "external_call_count"))


API_DIRECTION = {"rtx_on_signal": "in", "rtx_arm_timer": "out", "rtx_launch": "out", "rtx_open": "both", "rtx_close": "both"}


@query("pr12_direction", f"""
SELECT target_function, operation, CASE {' '.join(f"WHEN target_function = '{k}' THEN '{v}'" for k, v in API_DIRECTION.items())}
  WHEN operation IN ('ADDQUE', 'WRITE', 'WRITEREC', 'UPDATEREC', 'FWRITE') THEN 'out' WHEN operation IN ('DELQUE', 'READ', 'GETREC') THEN 'in' ELSE 'both' END AS direction, count(*) AS facts FROM {FACTS} GROUP BY ALL
""")
def pr12_direction(spark, d):
    """Direction of interactions: by the function where it tells, else by the operation."""
    by_api = F.create_map(*[F.lit(x) for kv in API_DIRECTION.items() for x in kv])
    by_op = V.direction(F.col("operation"))
    way = F.coalesce(F.try_element_at(by_api, F.col("target_function")), F.when(by_op == "producer", "out").when(by_op == "consumer", "in").otherwise("both"))
    return _facts(spark, d).groupBy("target_function", "operation", way.alias("direction")).agg(F.count(F.lit(1)).alias("facts"))


@query("pr4_source_roots", r"""
WITH p AS (SELECT DISTINCT 'w/' || CASE WHEN length(process_name) % 2 = 0 THEN 't-' ELSE 'x-' END || process_name || '/src/' || process_name AS root FROM source_files WHERE process_name IS NOT NULL)
SELECT root, CASE WHEN regexp_full_match(root, '(.*)/t-[^/]+/src/[^/]+') THEN regexp_extract(root, '^(.*)/t-[^/]+/src/[^/]+$', 1) ELSE root END AS source_root FROM p
""")
def pr4_source_roots(spark, d):
    """The root that paths are relative to: above ``t-*/src/<process>``, else the process's own folder."""
    kind = F.when(F.length("process_name") % 2 == 0, "t-").otherwise("x-")
    p = table(spark, d, "source_files").where("process_name is not null").select(F.concat(F.lit("w/"), kind, "process_name", F.lit("/src/"), "process_name").alias("root")).distinct()
    return p.select("root", V.source_root(F.col("root")).alias("source_root"))


@F.pandas_udf(StringType())
def _dedented(texts: pd.Series) -> pd.Series:
    return texts.map(textwrap.dedent)


@query("pr26_dedented", """
WITH f AS (SELECT DISTINCT id, string_split(source, chr(10)) AS l FROM graph_functions WHERE source IS NOT NULL),
t AS (SELECT id, list_transform(l, lambda x: CASE WHEN trim(x, ' ' || chr(9)) = '' THEN '' ELSE '    ' || x END) AS l FROM f)
SELECT id, array_to_string(list_transform(l, lambda x: CASE WHEN x = '' THEN '' ELSE substring(x, 5) END), chr(10)) AS code FROM t WHERE list_contains(list_transform(l, lambda x: x <> '' AND NOT starts_with(x, '     ') AND NOT starts_with(x, '    ' || chr(9))), true)
""")
def pr26_dedented(spark, d):
    """Sources shifted to the right and put back to the margin, where they begin there."""
    f = table(spark, d, "graph_functions").where("source is not null").select("id", "source").distinct()
    shifted = F.array_join(F.transform(F.split("source", "\n"), lambda x: F.concat(F.lit("    "), x)), "\n")
    at_margin = F.exists(F.split("source", "\n"), lambda x: (F.btrim(x, F.lit(" \t")) != "") & ~x.startswith(" ") & ~x.startswith("\t"))
    return f.where(at_margin).select("id", _dedented(shifted).alias("code"))


@F.pandas_udf(StringType())
def _filled(forms: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([enums.fill(f, {1: x, 2: y}) for f, x, y in zip(forms, a, b)])


@query("pr27_placeholders", f"SELECT DISTINCT '$2:' || arg_expression AS a, operation AS b, 'f(' || operation || ', $2:' || arg_expression || ', $3)' AS filled FROM {SITES} WHERE arg_expression IS NOT NULL AND operation IS NOT NULL")
def pr27_placeholders(spark, d):
    """Placeholders filled at once: a value that looks like one is not filled again."""
    s = _all_sites(spark, d).where("arg_expression is not null and operation is not null").select(F.concat(F.lit("$2:"), "arg_expression").alias("a"), F.col("operation").alias("b")).distinct()
    return s.select("a", "b", _filled(F.lit("f($2, $1, $3)"), "a", "b").alias("filled"))


@query("pr8_dynamic", f"SELECT target_expression, regexp_matches(target_expression, '->|\\[|\\w\\.\\w') AS dynamic, count(*) AS facts FROM {FACTS} WHERE target_expression IS NOT NULL GROUP BY ALL")
def pr8_dynamic(spark, d):
    return _facts(spark, d).where("target_expression is not null").groupBy("target_expression", V.is_dynamic(F.col("target_expression")).alias("dynamic")).agg(F.count(F.lit(1)).alias("facts"))


@query("v9_enum_values", """
WITH n AS (SELECT DISTINCT process_name, name FROM graph_functions WHERE process_name IS NOT NULL AND regexp_full_match(name, '[a-z]\\w*')),
o AS (SELECT process_name, upper(name) AS name, row_number() OVER (PARTITION BY process_name ORDER BY name) AS i FROM n)
SELECT process_name, name, CASE WHEN i = 1 THEN 10 ELSE (SELECT CASE WHEN o.i >= 4 THEN 48 + (o.i - 4) * 1 ELSE 10 + o.i - 1 END) END AS value FROM o
""")
def v9_enum_values(spark, d):
    """Constants of an enumeration per process: a formula first, then counted up, with a second formula at the fourth."""
    n = table(spark, d, "graph_functions").where("process_name is not null").where(F.col("name").rlike(r"^[a-z]\w*$")).groupBy("process_name").agg(F.array_sort(F.collect_set("name")).alias("names"))
    item = F.transform("names", lambda x, i: F.concat(F.upper(x), F.when(i == 0, " = 4 * 2 + 2").when(i == 3, " = 0x30").otherwise("")))
    text = F.concat(F.lit("enum all { "), F.array_join(item, ", "), F.lit(" };"))
    return n.select("process_name", F.explode(_enum_map(text)).alias("name", "value"))


@F.pandas_udf(MapType(StringType(), LongType()))
def _enum_map(texts: pd.Series) -> pd.Series:
    return texts.map(enums.enum_values)


@query("fl10_guarded_arms", f"""
SELECT fact_id FROM (SELECT fact_id, CAST(json_extract_string(metadata, '$.arm') AS BIGINT) AS arm, CAST(nullif(regexp_extract(json_extract_string(metadata, '$.guard'), '^n > (\\d+)$', 1), '') AS BIGINT) AS k FROM {FACTS})
WHERE NOT coalesce(arm <= k, false)
""")
def fl10_guarded_arms(spark, d):
    """Facts without the arms whose guard is proven 0 by the arm's value; what can't be told stays."""
    guard, arm = F.get_json_object("metadata", "$.guard"), F.get_json_object("metadata", "$.arm")
    f = _facts(spark, d).withColumn("formula", F.regexp_replace(guard, r"\bn\b", arm))
    # few formulas are distinct: each is evaluated once
    zero = f.where("formula is not null").select("formula").distinct().withColumn("v", c_formula(F.col("formula"))).where("v = 0").select("formula", F.lit(True).alias("dead"))
    return f.join(zero, "formula", "left").where("dead is null").select("fact_id")


@query("fl11_selected_starts", STEPS + ", own AS (SELECT id, min(process_name) AS p FROM graph_functions GROUP BY ALL) SELECT n.node, own.p AS process_name FROM s n JOIN own ON own.id = n.id WHERE n.position = 1 AND own.p IN ('proc_tidegate', 'proc_glassline', 'proc_slipway')")
def fl11_selected_starts(spark, d):
    """Routes that start in one of the selected processes."""
    own = table(spark, d, "graph_functions").groupBy("id").agg(F.min("process_name").alias("process_name")).where(F.col("process_name").isin("proc_tidegate", "proc_glassline", "proc_slipway"))
    return _steps_ids(spark, d).where("position = 0").join(own, "id").select("node", "process_name")


def _steps_ids(spark, d):
    from spanloom.plans.routes import _search

    called = table(spark, d, "graph_calls").where("kind = 'callback' and target is not null").select(F.col("target").alias("node")).distinct()
    return _search(spark, d).join(called, "node", "left_semi").select("node", F.posexplode(F.split("path", "/")).alias("position", "id"))


NEEDLES = ("mfs_queue", "41", "fork", "99")


@query("fl15_resource_search", f"""
WITH k AS (SELECT DISTINCT resource, value, resource || ':' || value AS key FROM {RECORDS} WHERE value IS NOT NULL), n(needle) AS (VALUES {', '.join(f"('{x}')" for x in NEEDLES)})
SELECT needle, key, rank FROM (SELECT needle, key, row_number() OVER (PARTITION BY needle ORDER BY CASE WHEN lower(value) = needle OR lower(key) = needle THEN 0 ELSE 1 END, key) AS rank FROM n JOIN k ON contains(lower(key), needle)) WHERE rank <= 8
""")
def fl15_resource_search(spark, d):
    """Resources by a piece of their name, exact ones first, eight each; the few needles are held against every resource once."""
    k = _records(spark, d).where("value is not null").select("value", F.concat("resource", F.lit(":"), "value").alias("key")).distinct()
    hits = k.select("value", "key", F.explode(F.array(*[F.when(F.contains(F.lower("key"), F.lit(n)), F.lit(n)) for n in NEEDLES])).alias("needle")).where("needle is not null")
    exact = F.when((F.lower("value") == F.col("needle")) | (F.lower("key") == F.col("needle")), 0).otherwise(1)
    return R.top(hits.distinct(), ["needle"], [exact, F.col("key")], 8).select("needle", "key", "rank")


# ---- joins and aggregations

COMPONENT = "CASE WHEN file LIKE '%/lib/%' THEN split_part(file, '/', 2) END"


@query("j25_library_endpoints", f"""
WITH f AS (SELECT DISTINCT id, {COMPONENT} AS component FROM graph_functions WHERE file IS NOT NULL)
SELECT c.source, c.target, a.component AS source_component, b.component AS target_component,
  CASE WHEN a.component IS NULL AND b.component IS NULL THEN 'outside' WHEN a.component IS NULL THEN 'into' WHEN b.component IS NULL THEN 'out_of' WHEN a.component = b.component THEN 'within' ELSE 'across' END AS relation
FROM {DIRECT} c JOIN f a ON a.id = c.source JOIN f b ON b.id = c.target
""")
def j25_library_endpoints(spark, d):
    comp = F.when(F.col("file").contains("/lib/"), F.split_part("file", F.lit("/"), F.lit(2)))
    f = table(spark, d, "graph_functions").where("file is not null").select("id", comp.alias("component")).distinct()
    side = lambda x: f.select(F.col("id").alias(x), F.col("component").alias(f"{x}_component"))
    a, b = F.col("source_component"), F.col("target_component")
    relation = F.when(a.isNull() & b.isNull(), "outside").when(a.isNull(), "into").when(b.isNull(), "out_of").when(a == b, "within").otherwise("across")
    return _edges(spark, d, ("direct",)).join(side("source"), "source").join(side("target"), "target").select("source", "target", "source_component", "target_component", relation.alias("relation"))


@query("j26_query_postings", f"WITH {POSTS}, {ASKED_SQL} SELECT q.query, p.token, p.doc_id, p.tf FROM q JOIN p USING (token)")
def j26_query_postings(spark, d):
    return _hits(spark, d)[0].join(_asked(spark), "token").select("query", "token", "doc_id", "tf")


@query("a13_resource_rollup", f"SELECT resource, value, count(DISTINCT process_name) AS processes, string_agg(DISTINCT process_name, ',' ORDER BY process_name) AS names, count(DISTINCT operation) AS operations FROM {RECORDS} WHERE value IS NOT NULL GROUP BY ALL HAVING count(DISTINCT process_name) > 1")
def a13_resource_rollup(spark, d):
    """Resources that several processes share."""
    g = _records(spark, d).where("value is not null").groupBy("resource", "value").agg(F.array_sort(F.collect_set("process_name")).alias("n"), F.countDistinct("operation").alias("operations"))
    return g.where("size(n) > 1").select("resource", "value", F.size("n").cast("bigint").alias("processes"), F.array_join("n", ",").alias("names"), "operations")


@query("o1_sorted_rows", f"SELECT evidence_process, fact_id, row_number() OVER (PARTITION BY evidence_process ORDER BY target_function, file, line, arg_index, fact_id) AS position FROM {FACTS} WHERE file IS NOT NULL AND line IS NOT NULL")
def o1_sorted_rows(spark, d):
    """Facts of each process in the order of a report: by function, file, line, argument, id."""
    w = Window.partitionBy("evidence_process").orderBy("target_function", "file", "line", "arg_index", "fact_id")
    return _facts(spark, d).where("file is not null and line is not null").select("evidence_process", "fact_id", F.row_number().over(w).alias("position"))


@query("o4_topk_pool", f"SELECT resource, value, n FROM (SELECT resource, value, count(*) AS n FROM {RECORDS} WHERE value IS NOT NULL GROUP BY ALL) ORDER BY n DESC, resource, value LIMIT 40")
def o4_topk_pool(spark, d):
    return _records(spark, d).where("value is not null").groupBy("resource", "value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "resource", "value").limit(40)


# ---- state


@query("t2_inflight_dedupe", "SELECT date_trunc('minute', ts) AS minute, count(*) AS asked, count(DISTINCT (user_id, event_type)) AS computed FROM events GROUP BY ALL")
def t2_inflight_dedupe(spark, d):
    """Requests and what is computed of them if equal ones of a minute share one answer."""
    e = table(spark, d, "events").groupBy(F.date_trunc("minute", "ts").alias("minute"), "user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return e.groupBy("minute").agg(F.sum("n").alias("asked"), F.count(F.lit(1)).alias("computed"))


@query("t6_ttl_hits", "SELECT event_type, count(*) AS requests, count(*) FILTER (ts - before <= INTERVAL 6 HOUR) AS hits FROM (SELECT event_type, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY ALL")
def t6_ttl_hits(spark, d):
    """Requests that a cache with a life of six hours after the last use would answer."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("event_type", "ts", F.lag("ts").over(w).alias("before"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("ts") - F.col("before") <= F.expr("INTERVAL 6 HOURS")).alias("hits"))


# ---- reports, labels, questions


@query("x6_comparison_report", SCAN_FLOW + "SELECT split_part(path, '/', 2) AS cell, count(*) AS sites, count(*) FILTER (in_scan AND in_flow) AS shared, count(*) FILTER (NOT in_flow) AS only_scan, count(*) FILTER (NOT in_scan) AS only_flow, count(*) FILTER (in_scan AND in_flow AND (len(list_filter(a, lambda x: NOT list_contains(b, x))) > 0 OR len(list_filter(b, lambda x: NOT list_contains(a, x))) > 0)) AS different FROM j WHERE starts_with(path, 'cells/') GROUP BY ALL")
def x6_comparison_report(spark, d):
    """How the sites of two indexes differ, per cell."""
    j = _scan_flow(spark, d).where("startswith(path, 'cells/')")
    both, apart = F.col("in_scan") & F.col("in_flow"), (F.size(F.array_except("a", "b")) > 0) | (F.size(F.array_except("b", "a")) > 0)
    return j.groupBy(F.split_part("path", F.lit("/"), F.lit(2)).alias("cell")).agg(
        F.count(F.lit(1)).alias("sites"), F.count_if(both).alias("shared"), F.count_if(~F.col("in_flow")).alias("only_scan"), F.count_if(~F.col("in_scan")).alias("only_flow"), F.count_if(both & apart).alias("different")
    )


@query("x7_stat_extraction", "SELECT process_name, CAST(sum(function_count) AS BIGINT) AS functions, max(resource_count) AS most_resources FROM (SELECT DISTINCT process_name, function_count, resource_count, run_id, results_set FROM graph_runs) GROUP BY ALL")
def x7_stat_extraction(spark, d):
    """Numbers out of the JSON texts of run statistics."""
    r = table(spark, d, "graph_runs").select("process_name", "run_id", "results_set", F.to_json(F.struct(F.struct("function_count", "resource_count").alias("stats"))).alias("j")).distinct()
    part = lambda n: F.get_json_object("j", f"$.stats.{n}")
    return r.groupBy("process_name").agg(F.sum(part("function_count").cast("bigint")).alias("functions"), F.max(part("resource_count").cast("int")).alias("most_resources"))


@query("x12_lifecycle_entries", "SELECT DISTINCT id, name FROM graph_functions WHERE split_part(name, '_', 2) IN ('open', 'arm', 'load', 'start', 'stop', 'close')")
def x12_lifecycle_entries(spark, d):
    verb = F.split_part("name", F.lit("_"), F.lit(2))
    return table(spark, d, "graph_functions").where(verb.isin("open", "arm", "load", "start", "stop", "close")).select("id", "name").distinct()


@query("x15_effective_undefines", """
WITH f AS (SELECT process_name, 'D' AS flag, unnest(defines) AS x FROM preprocessor_configs UNION ALL SELECT process_name, 'U', unnest(undefines) FROM preprocessor_configs UNION ALL SELECT process_name, 'F', unnest(fallback_undefines) FROM preprocessor_configs),
n AS (SELECT DISTINCT process_name, flag, trim(split_part(regexp_replace(trim(x), '^-[DU]', ''), '=', 1)) AS s FROM f),
u AS (SELECT DISTINCT process_name, s FROM n WHERE s <> '' AND (flag = 'U' OR flag = 'F' AND NOT EXISTS (SELECT 1 FROM n o WHERE o.process_name = n.process_name AND o.flag = 'D' AND o.s = n.s)))
SELECT process_name, string_agg(s, ',' ORDER BY s) AS undefines FROM u GROUP BY ALL
""")
def x15_effective_undefines(spark, d):
    """Undefines of each process with its fallback ones, which an explicit define beats."""
    none = F.array().cast("array<string>")
    bare = lambda c: F.filter(F.transform(F.coalesce(c, none), lambda x: F.trim(F.split_part(F.regexp_replace(F.trim(x), "^-[DU]", ""), F.lit("="), F.lit(1)))), lambda x: x != "")
    u = F.array_sort(F.array_distinct(F.concat(bare(F.col("undefines")), F.array_except(bare(F.col("fallback_undefines")), bare(F.col("defines"))))))
    return table(spark, d, "preprocessor_configs").select("process_name", u.alias("u")).where("size(u) > 0").select("process_name", F.array_join("u", ",").alias("undefines"))


@query("x17_label_blocks", STEPS + "SELECT DISTINCT regexp_extract(label, '^\\[([^\\]]*)\\]', 1) AS file, regexp_extract(label, '^\\[[^\\]]*\\](.*)$', 1) AS function FROM named")
def x17_label_blocks(spark, d):
    """File and function of the labels of all routes."""
    part = lambda i: F.regexp_extract("label", r"^\[([^\]]*)\](.*)$", i)
    return _steps(spark, d).select("label").distinct().select(part(1).alias("file"), part(2).alias("function")).distinct()


@query("x21_source_windows", f"""
WITH s AS (SELECT DISTINCT file, line FROM {SITES} WHERE file IS NOT NULL AND line > 0), c AS (SELECT path, max(string_split(content, chr(10))) AS l FROM source_files WHERE content IS NOT NULL GROUP BY ALL)
SELECT s.file, s.line, greatest(1, s.line - 10)::BIGINT AS first_line, array_to_string(l[greatest(1, s.line - 10):s.line + 10], chr(10)) AS code FROM s JOIN c ON c.path = s.file WHERE s.line <= len(l)
""")
def x21_source_windows(spark, d):
    """Ten lines to either side of each site."""
    s = _all_sites(spark, d).select("file", "line").where("file is not null and line > 0").distinct()
    c = table(spark, d, "source_files").where("content is not null").groupBy(F.col("path").alias("file")).agg(F.max(F.split("content", "\n")).alias("l"))
    first = F.greatest(F.lit(1), F.col("line") - 10)
    code = F.slice("l", first, F.col("line") + 11 - first)
    return s.join(c, "file").where("line <= size(l)").select("file", "line", first.cast("bigint").alias("first_line"), F.array_join(code, "\n").alias("code"))


@query("x39_record_timing", f"SELECT target_function, file, line, count(*) AS records, count(json_extract_string(metadata, '$.guard')) AS guarded, CAST(sum(date_diff('microsecond', recorded_at, loaded_at)) AS BIGINT) AS micros FROM {FACTS} WHERE file IS NOT NULL AND line IS NOT NULL GROUP BY ALL")
def x39_record_timing(spark, d):
    """Records of a site put together, with their guards and the sum of their times."""
    f = _facts(spark, d).where("file is not null and line is not null")
    return f.groupBy("target_function", "file", "line").agg(
        F.count(F.lit(1)).alias("records"), F.count(F.get_json_object("metadata", "$.guard")).alias("guarded"), F.sum(F.expr("timestampdiff(MICROSECOND, recorded_at, loaded_at)")).alias("micros")
    )


@query("x43_constructed_facts", f"SELECT DISTINCT file, line, arg_index, CASE WHEN regexp_full_match(arg_expression, '[0-9]+') THEN 'SOURCE' ELSE 'UNRESOLVED' END AS kind, CASE WHEN regexp_full_match(arg_expression, '[0-9]+') THEN arg_expression ELSE '' END AS value, CASE WHEN macro_name IS NOT NULL THEN 'macro' WHEN arg_expression IS NULL THEN 'no_argument' ELSE 'none' END AS reason FROM {SITES}")
def x43_constructed_facts(spark, d):
    """A fact of each argument as it is made without any tracing."""
    number = F.coalesce(F.col("arg_expression").rlike("^[0-9]+$"), F.lit(False))
    reason = F.when(F.col("macro_name").isNotNull(), "macro").when(F.col("arg_expression").isNull(), "no_argument").otherwise("none")
    return _all_sites(spark, d).select("file", "line", "arg_index", F.when(number, "SOURCE").otherwise("UNRESOLVED").alias("kind"), F.when(number, F.col("arg_expression")).otherwise("").alias("value"), reason.alias("reason")).distinct()


@query("x46_summary_fallback", f"SELECT id, coalesce(nullif(trim(summary), ''), 'Function ' || name || coalesce(' of ' || file_name, '') || '.') AS summary FROM {FUNCTIONS}")
def x46_summary_fallback(spark, d):
    said = F.concat(F.lit("Function "), "name", F.coalesce(F.concat(F.lit(" of "), "file_name"), F.lit("")), F.lit("."))
    return _functions(spark, d).select("id", F.coalesce(F.nullif(F.trim("summary"), F.lit("")), said).alias("summary"))


@query("x47_file_metadata", "SELECT s.path, max(strlen(s.content)) AS bytes, max(len(string_split(s.content, chr(10)))) AS lines, coalesce(max(f.n), 0) AS functions FROM source_files s LEFT JOIN (SELECT file, count(DISTINCT id) AS n FROM graph_functions GROUP BY ALL) f ON f.file = s.path WHERE s.content IS NOT NULL GROUP BY ALL")
def x47_file_metadata(spark, d):
    n = table(spark, d, "graph_functions").groupBy(F.col("file").alias("path")).agg(F.countDistinct("id").alias("n"))
    s = table(spark, d, "source_files").where("content is not null").groupBy("path").agg(F.max(F.octet_length("content")).cast("bigint").alias("bytes"), F.max(F.size(F.split("content", "\n"))).cast("bigint").alias("lines"))
    return s.join(n, "path", "left").select("path", "bytes", "lines", F.coalesce("n", F.lit(0).cast("bigint")).alias("functions"))


CALLERS = f"SELECT c.target AS id, count(DISTINCT a.name) AS n, string_agg(DISTINCT a.name, ', ' ORDER BY a.name) AS names FROM {DIRECT} c JOIN (SELECT DISTINCT id, name FROM graph_functions) a ON a.id = c.source GROUP BY ALL"


@query("x51_caller_answers", f"SELECT f.id, f.name || ' is called by ' || coalesce(c.n, 0) || ' functions' || coalesce(': ' || c.names, '') AS answer FROM (SELECT DISTINCT id, name FROM graph_functions) f LEFT JOIN ({CALLERS}) c ON c.id = f.id")
def x51_caller_answers(spark, d):
    """Who calls each function, as a sentence."""
    f = table(spark, d, "graph_functions").select("id", "name").distinct()
    c = _edges(spark, d, ("direct",)).join(f.select(F.col("id").alias("source"), F.col("name").alias("caller")), "source").groupBy(F.col("target").alias("id")).agg(F.array_sort(F.collect_set("caller")).alias("callers"))
    n = F.coalesce(F.size("callers"), F.lit(0))
    said = F.concat("name", F.lit(" is called by "), F.when(F.col("callers").isNull(), 0).otherwise(n).cast("string"), F.lit(" functions"), F.coalesce(F.concat(F.lit(": "), F.array_join("callers", ", ")), F.lit("")))
    return f.join(c, "id", "left").select("id", said.alias("answer"))


@query("x53_retrieval_stats", f"WITH {POSTS} SELECT count(DISTINCT doc_id) AS documents, count(DISTINCT token) AS tokens, CAST(sum(tf) AS BIGINT) AS occurrences, max(doc_len) AS longest FROM p")
def x53_retrieval_stats(spark, d):
    from spanloom.plans.warehouse import _tokens

    t = _tokens(spark, d)
    docs = t.select(F.size("tokens").cast("bigint").alias("n")).agg(F.count_if(F.col("n") > 0), F.max("n")).first()
    per = t.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("cf"))
    sums = per.agg(F.count(F.lit(1)).alias("tokens"), F.sum("cf").alias("occurrences"))
    return sums.select(F.lit(docs[0]).cast("bigint").alias("documents"), "tokens", "occurrences", F.lit(docs[1]).cast("bigint").alias("longest"))


FORMS = (
    ("who calls {0}?", 1, 0), ("{0} を呼ぶ関数は？", 1, 0), ("what does {0} call", 1, 0), ("{0} が呼ぶ関数", 1, 0), ("Where is {0} defined", 1, 0), ("How does {0} get there", 1, 0),
    ("path from {0} to {0}_2", 2, 0), ("who writes to {0}", 0, 1), ("{0} から読むのは", 0, 1), ("{0}", 0, 1), ("{0} please", 1, 0), ("tell me something of {0}", 0, 0), ("{0} from main", 1, 0),
)


def _cue_sql(name: str) -> str:
    return "(" + " OR ".join(f"contains(lower(question), '{c.lower()}')" for c in Q.CUES[name]) + ")"


@query("r10_question_router", f"""
WITH n AS (SELECT DISTINCT name FROM graph_functions), f(form, functions, resources) AS (VALUES {', '.join(f"('{a}', {b}, {c})" for a, b, c in FORMS)}),
q AS (SELECT name, form, functions, resources, replace(form, '{{0}}', name) AS question FROM n, f)
SELECT name, form, CASE WHEN resources > 0 AND {_cue_sql('resource_writers')} THEN 'resource_writers' WHEN resources > 0 AND {_cue_sql('resource_readers')} THEN 'resource_readers'
  WHEN resources = 1 AND functions = 0 THEN 'resource' WHEN functions = 0 THEN NULL WHEN functions >= 2 AND {_cue_sql('reach')} THEN 'reach' WHEN {_cue_sql('from_entry')} OR {_cue_sql('reach')} AND functions = 1 THEN 'from_entry'
  WHEN {_cue_sql('callers')} THEN 'callers' WHEN {_cue_sql('callees')} THEN 'callees' WHEN {_cue_sql('define')} AND functions = 1 THEN 'define' END AS intent FROM q
""")
def r10_question_router(spark, d):
    """The intent of questions of several forms about every function's name."""
    forms = F.array(*[F.struct(F.lit(a).alias("form"), F.lit(b).alias("functions"), F.lit(c).alias("resources")) for a, b, c in FORMS])
    q = table(spark, d, "graph_functions").select("name").distinct().select("name", F.explode(forms).alias("x")).select("name", "x.*")
    return q.select("name", "form", Q.intent(F.replace("form", F.lit("{0}"), "name"), F.col("functions"), F.col("resources")).alias("intent"))


@query("r12_tool_answers", f"""
WITH c AS (SELECT target AS id, source AS other, 'callers' AS tool FROM {DIRECT} UNION ALL SELECT source, target, 'callees' FROM {DIRECT})
SELECT id, tool, other, rank FROM (SELECT *, row_number() OVER (PARTITION BY id, tool ORDER BY other) AS rank FROM c) WHERE rank <= 20
""")
def r12_tool_answers(spark, d):
    """What the tools of a research agent answer on each function: twenty callers and callees at most."""
    e = _edges(spark, d, ("direct",))
    c = e.select(F.col("target").alias("id"), F.col("source").alias("other"), F.lit("callers").alias("tool")).unionByName(e.select(F.col("source").alias("id"), F.col("target").alias("other"), F.lit("callees").alias("tool")))
    return R.top(c, ["id", "tool"], [F.col("other")], 20).select("id", "tool", "other", "rank")
