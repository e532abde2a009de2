"""More queries: vectors and text forms, table functions, backward searches, witnesses, call resolution, labels, runs; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import udtfs
from spanloom.functions import values as V
from spanloom.functions.cexpr import c_formula, without_parens
from spanloom.functions.vectors import cosine, l2_norm
from spanloom.operators import graph as G
from spanloom.operators import joins as J
from spanloom.plans.routes import SEARCH, _search
from spanloom.plans.warehouse import CALLS, DIRECT, FACTS, FUNCTIONS, POSTS, RECORDS, SITES, _all_facts, _all_records, _all_sites, _calls, _edges, _facts, _functions, j6_containment
from spanloom.session import shared_folder
from spanloom.sources import cache as C
from spanloom.sources.tables import table

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


# ---- functions


@query("fn_l2_norm", "SELECT vec_id, round(CASE WHEN n = 0 THEN 1 ELSE n END, 6) AS norm FROM (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings WHERE embedding IS NOT NULL)")
def fn_l2_norm(spark, d):
    return table(spark, d, "embeddings").where("embedding is not null").select("vec_id", F.round(l2_norm(F.col("embedding")), 6).alias("norm"))


@query("fn_cosine", "WITH c AS (SELECT label, list_transform(generate_series(1, 64), lambda i: 1.0 / i) AS axis FROM (SELECT DISTINCT label FROM embeddings)) SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], c.axis::DOUBLE[]), 6) AS cosine FROM embeddings e JOIN c USING (label) WHERE e.embedding IS NOT NULL")
def fn_cosine(spark, d):
    """The cosine of each vector with one fixed direction."""
    axis = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.lit(1.0) / i)
    return table(spark, d, "embeddings").where("embedding is not null and label is not null").select("vec_id", F.round(cosine(F.col("embedding"), axis), 6).alias("cosine"))


@query("fn_nfkc", f"WITH {POSTS} SELECT doc_id, md5(text) AS digest FROM plain")
def fn_nfkc(spark, d):
    """Digests of the texts in compatibility form."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(V.nfkc(F.col("text"))).alias("digest"))


@query("fn_cjk_bigrams", f"WITH {POSTS} SELECT y AS bigram, count(*) AS n FROM (SELECT run[i:i + 1] AS y FROM (SELECT run, unnest(generate_series(1, greatest(length(run) - 1, 1))) AS i FROM r)) GROUP BY ALL")
def fn_cjk_bigrams(spark, d):
    t = table(spark, d, "documents").where("text is not null").select(F.explode(V.tokens(F.col("text"))).alias("bigram"))
    return t.where(F.col("bigram").rlike("^[\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\uff66-\\uff9f]{1,2}$")).groupBy("bigram").agg(F.count(F.lit(1)).alias("n"))


@query("pr5_c_literals", """
WITH n AS (SELECT DISTINCT TRY_CAST(resolved_value AS BIGINT) AS v FROM discovery_facts WHERE regexp_full_match(resolved_value, '[1-9][0-9]{0,8}'))
SELECT v AS value, v AS from_octal, v AS from_binary, v AS from_upper_hex, -v AS from_spaced_minus, v AS from_suffixes, NULL::BIGINT AS from_bad_octal, NULL::BIGINT AS from_name FROM n
""")
def pr5_c_literals(spark, d):
    """Octal, binary, hexadecimal and suffixed spellings of numbers, and what is none."""
    n = table(spark, d, "discovery_facts").where(F.col("resolved_value").rlike("^[1-9][0-9]{0,8}$")).select(F.col("resolved_value").cast("bigint").alias("v")).distinct()
    t = F.col("v").cast("string")
    spelled = {
        "from_octal": F.concat(F.lit("0"), F.conv(t, 10, 8)), "from_binary": F.concat(F.lit("0b"), F.conv(t, 10, 2)), "from_upper_hex": F.concat(F.lit("0X"), F.upper(F.hex("v"))), "from_spaced_minus": F.concat(F.lit(" - "), t),
        "from_suffixes": F.concat(t, F.lit("ull")), "from_bad_octal": F.concat(F.lit("0"), t, F.lit("9")), "from_name": F.concat(F.lit("N"), t),
    }
    return n.select(F.col("v").alias("value"), *[V.c_int(x).alias(k) for k, x in spelled.items()])


@query("pr6_to_decimal", f"SELECT DISTINCT arg_expression AS written, TRY_CAST(CASE WHEN regexp_full_match(arg_expression, '0|[1-9][0-9]*') THEN arg_expression END AS BIGINT) AS value FROM {SITES} WHERE arg_expression IS NOT NULL")
def pr6_to_decimal(spark, d):
    """Numbers within balanced parentheses, as integers; other expressions have none."""
    e = _all_sites(spark, d).where("arg_expression is not null").select(F.col("arg_expression").alias("written")).distinct()
    return e.select("written", V.c_int(without_parens(F.concat(F.lit("(( "), "written", F.lit(" ) )")))).alias("value"))


@query("udtf_tokens", f"WITH {POSTS} SELECT token, count(*) AS n FROM t GROUP BY ALL")
def udtf_tokens(spark, d):
    """Tokens by the table function of SQL."""
    udtfs.register(spark)
    table(spark, d, "documents").createOrReplaceTempView("_udtf_documents")
    return spark.sql("SELECT t.token, count(*) AS n FROM _udtf_documents d, LATERAL retrieval_tokens(d.text) t WHERE d.text IS NOT NULL GROUP BY t.token")


@query("udtf_c_scan")
def udtf_c_scan(spark, d):
    """What the table function finds in C files, counted."""
    udtfs.register(spark)
    table(spark, d, "source_files").where("content is not null").where(F.lower("path").rlike(r"\.[ch]$")).createOrReplaceTempView("_udtf_files")
    return spark.sql("SELECT s.what, count(*) AS n FROM _udtf_files f, LATERAL c_scan(f.content) s GROUP BY s.what")


# ---- searches and witnesses


@query("v19_backward_states", f"""
WITH RECURSIVE e AS (SELECT source, target FROM {DIRECT} WHERE source <> target), s AS (SELECT DISTINCT source AS node FROM graph_calls WHERE kind = 'external_call' AND source IS NOT NULL),
w(seed, node, depth) USING KEY (seed, node) AS (SELECT node, node, 0 FROM s UNION SELECT w.seed, e.source, min(w.depth) + 1 FROM w JOIN e ON e.target = w.node WHERE NOT EXISTS (SELECT 1 FROM recurring.w z WHERE z.seed = w.seed AND z.node = e.source) GROUP BY w.seed, e.source)
SELECT seed, count(*) AS states, max(depth) AS depth, 'COMPLETE' AS status FROM w GROUP BY ALL
""")
def v19_backward_states(spark, d):
    """The search up the callers of each function that calls a library function, with its bounds on states and depth."""
    seeds = table(spark, d, "graph_calls").where("kind = 'external_call' and source is not null").select(F.col("source").alias("node"))
    return G.backward_states(_edges(spark, d, ("direct",)), "source", "target", seeds)


CONTAINED = f"SELECT DISTINCT s.file, s.line, f.id FROM (SELECT DISTINCT file, line FROM {SITES}) s JOIN (SELECT DISTINCT id, file, start_line, end_line FROM graph_functions WHERE start_line > 0) f ON f.file = s.file AND s.line BETWEEN f.start_line AND f.end_line"


@query("v23_witness_routes", SEARCH + f", c AS ({CONTAINED}) SELECT c.file, c.line, c.id AS function_id, w.path AS route FROM c LEFT JOIN w ON w.node = c.id")
def v23_witness_routes(spark, d):
    """Of each site the function around it and one route to it from a root, null where none leads there."""
    c = j6_containment(spark, d).select("file", "line", "function_id").distinct()
    return c.join(_search(spark, d).select(F.col("node").alias("function_id"), F.col("path").alias("route")), "function_id", "left").select("file", "line", "function_id", "route")


@query("v20_correlation_ids", f"SELECT DISTINCT fact_id, sha1(coalesce(target_expression, '') || chr(31) || coalesce(resolved_value, '') || chr(31) || coalesce(json_extract_string(metadata, '$.guard'), '')) AS correlation FROM {FACTS}")
def v20_correlation_ids(spark, d):
    """An id of each fact's binding and guard, so that values of one route stay together."""
    none = lambda c: F.coalesce(c, F.lit(""))
    parts = F.concat_ws("\x1f", none(F.col("target_expression")), none(F.col("resolved_value")), none(F.get_json_object("metadata", "$.guard")))
    return _all_facts(spark, d).select("fact_id", F.sha1(parts).alias("correlation")).distinct()


@query("x31_seed_dispatch", f"""
WITH s AS (SELECT DISTINCT target_function, file, line, arg_index, in_process FROM {SITES}), f AS (SELECT DISTINCT file, line, arg_index FROM {FACTS} WHERE file IS NOT NULL AND line IS NOT NULL)
SELECT s.target_function, CASE WHEN f.file IS NULL THEN 'NO TARGET' WHEN s.in_process THEN 'resolve' ELSE 'other_process' END AS dispatch, count(*) AS arguments FROM s LEFT JOIN f USING (file, line, arg_index) GROUP BY ALL
""")
def x31_seed_dispatch(spark, d):
    """What becomes of each argument of a site; those without any fact get a row of their own kind."""
    keys = ["file", "line", "arg_index"]
    s = _all_sites(spark, d).select("target_function", *keys, "in_process").distinct()
    f = _all_facts(spark, d).where("file is not null and line is not null").select(*keys).distinct().withColumn("has", F.lit(True))
    kind = F.when(F.col("has").isNull(), "NO TARGET").when(F.col("in_process"), "resolve").otherwise("other_process")
    return s.join(f, keys, "left").groupBy("target_function", kind.alias("dispatch")).agg(F.count(F.lit(1)).alias("arguments"))


@query("x27_unmapped_arguments", f"SELECT DISTINCT target_function, macro_name, file, line, arg_index, CASE WHEN macro_name IS NOT NULL AND unmapped_args THEN 'UNKNOWN' ELSE 'MAPPED' END AS argument FROM {SITES}")
def x27_unmapped_arguments(spark, d):
    """Arguments behind a macro that can't be mapped are unknown, never taken by position."""
    s = _all_sites(spark, d)
    return s.select("target_function", "macro_name", "file", "line", "arg_index", F.when(F.col("macro_name").isNotNull() & F.col("unmapped_args"), "UNKNOWN").otherwise("MAPPED").alias("argument")).distinct()


@query("x37_terminal_marks", f"""
WITH n AS (SELECT DISTINCT process_name, name FROM graph_functions WHERE NOT is_external)
SELECT f.fact_id, CASE WHEN f.status <> 'EXTERNAL' THEN 'none' WHEN n.name IS NOT NULL THEN 'unknown' ELSE 'external' END AS mark FROM {FACTS} f LEFT JOIN n ON n.process_name = f.evidence_process AND n.name = f.target_function
""")
def x37_terminal_marks(spark, d):
    """Facts that end outside: a function of the process itself can't be external and is unknown."""
    n = table(spark, d, "graph_functions").where("not is_external").select(F.col("process_name").alias("evidence_process"), F.col("name").alias("target_function"), F.lit(True).alias("own")).distinct()
    mark = F.when(F.col("status") != "EXTERNAL", "none").when(F.col("status").isNull(), F.when(F.col("own"), "unknown").otherwise("external")).when(F.col("own"), "unknown").otherwise("external")
    return _facts(spark, d).join(n, ["evidence_process", "target_function"], "left").select("fact_id", mark.alias("mark"))


# ---- call resolution


@query("x8_callee_resolution", f"""
WITH f AS (SELECT id, min(name) AS name, min(file) AS file, min(process_name) AS p, bool_or(is_static) AS st, bool_or(is_library_api) AS api FROM graph_functions GROUP BY ALL),
c AS (SELECT DISTINCT a.p, a.file, b.name FROM (SELECT DISTINCT source, target FROM graph_calls WHERE kind IN ('direct', 'external_call')) k JOIN f a ON a.id = k.source JOIN f b ON b.id = k.target)
SELECT c.p AS process_name, c.file, c.name, coalesce(
  (SELECT min(id) FROM f WHERE f.file = c.file AND f.name = c.name), (SELECT min(id) FROM f WHERE f.p = c.p AND f.name = c.name AND NOT f.st), (SELECT min(id) FROM f WHERE f.api AND f.name = c.name)) AS callee FROM c
""")
def x8_callee_resolution(spark, d):
    """The callee of each name called in a file: the file's own function, the process's, else the library's."""
    f = table(spark, d, "graph_functions").groupBy("id").agg(F.min("name").alias("name"), F.min("file").alias("file"), F.min("process_name").alias("process_name"), F.bool_or("is_static").alias("static"), F.bool_or("is_library_api").alias("api"))
    k = table(spark, d, "graph_calls").where("kind in ('direct', 'external_call')").select("source", "target").distinct()
    c = k.join(f.select(F.col("id").alias("source"), "process_name", "file"), "source").join(f.select(F.col("id").alias("target"), "name"), "target").select("process_name", "file", "name").distinct()
    rules = [(f, ["file", "name"]), (f.where("not static"), ["process_name", "name"]), (f.where("api"), ["name"])]
    return J.ranked_match(c, "name", rules, "id", "callee").select("process_name", "file", "name", "callee")


@query("x9_declared_names", f"SELECT id, '*(' || name || ')(int (*cb)(void), char *p)' AS declarator, name FROM {FUNCTIONS} WHERE regexp_full_match(name, '[A-Za-z_]\\w*')")
def x9_declared_names(spark, d):
    """The name in a nested declarator."""
    n = _functions(spark, d).where(F.col("name").rlike(r"^[A-Za-z_]\w*$")).select("id", F.concat(F.lit("*("), "name", F.lit(")(int (*cb)(void), char *p)")).alias("declarator"))
    return n.select("id", "declarator", F.regexp_extract("declarator", r"^[\s*(]*([A-Za-z_]\w*)", 1).alias("name"))


@query("x10_callback_names", f"SELECT DISTINCT name AS callback, '(handler_t) ( &' || name || ' )' AS argument FROM {FUNCTIONS} WHERE regexp_full_match(name, '[a-z_]\\w*')")
def x10_callback_names(spark, d):
    """The function in a callback argument without its casts, parentheses and address."""
    n = table(spark, d, "graph_functions").where(F.col("name").rlike(r"^[a-z_]\w*$")).select(F.concat(F.lit("(handler_t) ( &"), "name", F.lit(" )")).alias("argument")).distinct()
    bare = F.regexp_replace("argument", r"^\s*\(\s*\w+(\s*\*)*\s*\)\s*", "")
    return n.select(F.regexp_extract(bare, r"^[\s(&]*([A-Za-z_]\w*)[\s)]*$", 1).alias("callback"), "argument")


# ---- sources, sinks, retrieval


@query("s1_discovered_roots", """
WITH p AS (SELECT DISTINCT process_name AS n FROM source_files WHERE process_name IS NOT NULL)
SELECT DISTINCT 'w/' || n AS root FROM p WHERE length(n) % 3 <> 0 ORDER BY root
""")
def s1_discovered_roots(spark, d):
    """Folders with a Makefile, those below an ignored folder left out; of a folder in another the outer one too."""
    p = table(spark, d, "source_files").where("process_name is not null").select("process_name").distinct()
    files = p.select(F.explode(F.array(
        F.concat(F.lit("w/"), F.when(F.length("process_name") % 3 == 0, ".git/").otherwise(""), "process_name", F.lit("/Makefile")), F.concat(F.lit("w/build/"), "process_name", F.lit("/Makefile")), F.concat(F.lit("w/"), "process_name", F.lit("/a.c")),
    )).alias("path"))
    return files.where(F.col("path").rlike("(^|/)Makefile$") & ~F.col("path").rlike(r"(^|/)(\.git|build|node_modules|\.svn)/")).select(F.regexp_replace("path", "/Makefile$", "").alias("root")).distinct()


@query("k7_run_folders", "SELECT * FROM (VALUES ('20310101_000000'), ('20310101_000000-2'), ('20310101_000000-3')) t(folder)")
def k7_run_folders(spark, d):
    """Three runs of one second: each has a folder of its own."""
    root = shared_folder(spark, "runs")
    return spark.createDataFrame([(C.fresh_run_folder(spark, root, "20310101_000000").rpartition("/")[2],) for _ in range(3)], "folder string")


@query("k8_mermaid_lines", f"SELECT DISTINCT c.process_name, c.source || '[\"' || coalesce(a.name, c.source) || '\"] --> ' || c.target || '[\"' || coalesce(b.name, c.target) || '\"]' AS line FROM {CALLS} c LEFT JOIN (SELECT id, min(name) AS name FROM graph_functions GROUP BY ALL) a ON a.id = c.source LEFT JOIN (SELECT id, min(name) AS name FROM graph_functions GROUP BY ALL) b ON b.id = c.target WHERE c.kind = 'callback' AND c.source IS NOT NULL AND c.target IS NOT NULL")
def k8_mermaid_lines(spark, d):
    """The lines of a graph's text."""
    f = table(spark, d, "graph_functions").groupBy("id").agg(F.min("name").alias("name"))
    c = _calls(spark, d).where("kind = 'callback' and source is not null and target is not null")
    j = c.join(f.select(F.col("id").alias("source"), F.col("name").alias("a")), "source", "left").join(f.select(F.col("id").alias("target"), F.col("name").alias("b")), "target", "left")
    box = lambda i, n: F.concat(F.col(i), F.lit('["'), F.coalesce(n, i), F.lit('"]'))
    return j.select("process_name", F.concat(box("source", "a"), F.lit(" --> "), box("target", "b")).alias("line")).distinct()


@query("r1_chunk_documents", f"""
WITH s AS (SELECT DISTINCT id, name, file_name, greatest(1, start_line) AS st, string_split(source, chr(10)) AS l FROM graph_functions WHERE source IS NOT NULL AND source <> ''),
c AS (SELECT *, unnest(generate_series(0, len(l) - 1, 37)) AS o FROM s)
SELECT 'source:' || id || ':' || (o // 37) AS doc_id, name || ' (' || coalesce(file_name, '?') || ':' || (st + o) || '-' || (st + least(o + 45, len(l)) - 1) || ')' || chr(10) || array_to_string(l[o + 1:o + 45], chr(10)) AS text FROM c WHERE o = 0 OR o - 37 + 45 < len(l)
""")
def r1_chunk_documents(spark, d):
    """Source chunks of 45 lines, each 37 lines after the last, with a header of name, file and lines."""
    s = table(spark, d, "graph_functions").where("source <> ''").select("id", "name", "file_name", F.greatest(F.lit(1), "start_line").alias("st"), F.split("source", "\n").alias("l")).distinct()
    o = F.filter(F.sequence(F.lit(0), F.size("l") - 1, F.lit(37)), lambda x: (x == 0) | (x - 37 + 45 < F.size("l")))
    c = s.select("*", F.explode(o).alias("o"))
    n = lambda x: x.cast("string")
    head = F.concat("name", F.lit(" ("), F.coalesce("file_name", F.lit("?")), F.lit(":"), n(F.col("st") + F.col("o")), F.lit("-"), n(F.col("st") + F.least(F.col("o") + 45, F.size("l")) - 1), F.lit(")\n"))
    return c.select(F.concat(F.lit("source:"), "id", F.lit(":"), n(F.floor(F.col("o") / 37))).alias("doc_id"), F.concat(head, F.array_join(F.slice("l", F.col("o") + 1, F.lit(45)), "\n")).alias("text"))


@query("r1_resource_documents", f"""
WITH r AS (SELECT DISTINCT resource, value, process_name, operation, path FROM {RECORDS} WHERE value IS NOT NULL),
t AS (SELECT resource, value, string_agg(path, ', ' ORDER BY path) AS touched FROM (SELECT DISTINCT resource, value, path, dense_rank() OVER (PARTITION BY resource, value ORDER BY path) AS k FROM r WHERE path IS NOT NULL) WHERE k <= 24 GROUP BY ALL)
SELECT r.resource || ' ' || r.value || chr(10) || 'processes: ' || string_agg(DISTINCT r.process_name, ', ' ORDER BY r.process_name) || chr(10) || 'operations: ' || string_agg(DISTINCT r.operation, ', ' ORDER BY r.operation) || chr(10) || 'touched by: ' || coalesce(any_value(t.touched), '') AS text
FROM r LEFT JOIN t ON t.resource = r.resource AND t.value = r.value GROUP BY r.resource, r.value
""")
def r1_resource_documents(spark, d):
    """One document a resource: its processes, operations and the first 24 files that touch it."""
    r = _all_records(spark, d).where("value is not null").select("resource", "value", "process_name", "operation", "path").distinct()
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
    g = r.groupBy("resource", "value").agg(names("process_name").alias("p"), names("operation").alias("o"), F.array_join(F.slice(F.array_sort(F.collect_set("path")), 1, 24), ", ").alias("t"))
    return g.select(F.concat("resource", F.lit(" "), "value", F.lit("\nprocesses: "), "p", F.lit("\noperations: "), "o", F.lit("\ntouched by: "), "t").alias("text"))


@query("v8_distinct_formulas", "WITH n AS (SELECT DISTINCT TRY_CAST(resolved_value AS BIGINT) AS v FROM discovery_facts WHERE regexp_full_match(resolved_value, '[1-9][0-9]{0,8}')) SELECT v, v % 7 AS a, CASE WHEN v > 100 AND v % 2 = 0 THEN 1 ELSE 0 END AS b FROM n")
def v8_distinct_formulas(spark, d):
    """Formulas that are evaluated once each, however many facts have them."""
    f = table(spark, d, "discovery_facts").where(F.col("resolved_value").rlike("^[1-9][0-9]{0,8}$")).select(F.col("resolved_value").alias("t")).distinct()
    return f.select(F.col("t").cast("bigint").alias("v"), c_formula(F.concat("t", F.lit(" % 7"))).alias("a"), c_formula(F.concat("t", F.lit(" > 100 && !("), "t", F.lit(" % 2)"))).alias("b"))
