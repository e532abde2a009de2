"""Queries of searches, chains, paths and includes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.operators import graph as G
from spanloom.operators import includes as I
from spanloom.operators import retrieval as R
from spanloom.operators.csource import scanned
from spanloom.operators.hierarchy import hierarchy
from spanloom.plans.core_problems import P3_HIERARCHY
from spanloom.plans.warehouse import DIRECT, EDGES, ROOTS, TRAVERSABLE, _edges
from spanloom.sources.tables import table

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


LABELLED = "(SELECT source, target, min(CASE WHEN kind = 'callback' THEN coalesce(via, target) END) AS said FROM graph_calls WHERE kind IN ('direct', 'indirect', 'callback', 'macro_expansion') AND source IS NOT NULL AND target IS NOT NULL GROUP BY ALL)"
SEARCH = f"""WITH RECURSIVE l AS (SELECT * FROM {LABELLED}),
w(node, depth, path, label) USING KEY (node) AS (
  SELECT node, 0, node, '' FROM {ROOTS.format('l')}
  UNION SELECT target, depth, p, said FROM (
    SELECT l.target, w.depth + 1 AS depth, min(w.path || '/' || l.target) AS p, arg_min(coalesce(l.said, w.label), w.path || '/' || l.target) AS said
    FROM w JOIN l ON l.source = w.node WHERE l.target NOT IN (SELECT node FROM recurring.w) GROUP BY l.target, w.depth))
"""


def _search(spark, d):
    c = table(spark, d, "graph_calls").where(F.col("kind").isin(*TRAVERSABLE) & F.col("source").isNotNull() & F.col("target").isNotNull())
    c = c.select("source", "target", F.when(F.col("kind") == "callback", F.coalesce("via", "target")).alias("said"))
    return G.carried_search(c, "source", "target", G.roots(c, "source", "target"), "said")


@query("g2_search_tree", SEARCH + "SELECT node, depth, split_part(path, '/', 1) AS root, nullif(split_part(path, '/', -2), '') AS predecessor FROM w")
def g2_search_tree(spark, d):
    """Reachable nodes with their root and predecessor."""
    parts = F.split("path", "/")
    return _search(spark, d).select("node", "depth", F.get(parts, F.lit(0)).alias("root"), F.when(F.col("depth") > 0, F.get(parts, F.size(parts) - 2)).alias("predecessor"))


@query("g19_shortest_chains", SEARCH + "SELECT node, path FROM w")
def g19_shortest_chains(spark, d):
    return _search(spark, d).select("node", "path")


@query("g21_launch_metadata", SEARCH + "SELECT node, CASE WHEN label = '' THEN 'FORK' ELSE label END AS launch FROM w")
def g21_launch_metadata(spark, d):
    """How each function is launched: by the last callback on its first path, else with its process."""
    return _search(spark, d).select("node", F.when(F.col("label") == "", "FORK").otherwise(F.col("label")).alias("launch"))


STEPS = SEARCH + """, f AS (SELECT id, min(name) AS name, min(file_name) AS file FROM graph_functions GROUP BY ALL),
c AS (SELECT node, string_split(path, '/') AS ids FROM w WHERE node IN (SELECT target FROM graph_calls WHERE kind = 'callback')),
s AS (SELECT node, i AS position, ids[i] AS id FROM (SELECT node, ids, unnest(generate_series(1, len(ids))) AS i FROM c)),
named AS (SELECT s.node, s.position, coalesce(f.name, s.id) AS name, '[' || coalesce(f.file, '?') || ']' || coalesce(f.name, s.id) AS label FROM s LEFT JOIN f ON f.id = s.id)
"""


def _steps(spark, d):
    called = table(spark, d, "graph_calls").where("kind = 'callback' and target is not null").select(F.col("target").alias("node")).distinct()
    f = table(spark, d, "graph_functions").groupBy("id").agg(F.min("name").alias("name"), F.min("file_name").alias("file"))
    s = _search(spark, d).join(called, "node", "left_semi").select("node", F.posexplode(F.split("path", "/")).alias("position", "id"))
    name = F.coalesce("name", "id")
    return s.join(f, "id", "left").select("node", (F.col("position") + 1).cast("bigint").alias("position"), name.alias("name"), F.concat(F.lit("["), F.coalesce("file", F.lit("?")), F.lit("]"), name).alias("label"))


@query("g23_trace_steps", STEPS + "SELECT node, position, label, lag(name) OVER (PARTITION BY node ORDER BY position) AS caller FROM named")
def g23_trace_steps(spark, d):
    """The steps of the path to each callback handler, resolved to names, with who hands control over."""
    w = Window.partitionBy("node").orderBy("position")
    return _steps(spark, d).select("node", "position", "label", F.lag("name").over(w).alias("caller"))


@query("x40_route_labels", STEPS + "SELECT DISTINCT string_agg(label, ' -> ' ORDER BY position) AS label FROM named GROUP BY node")
def x40_route_labels(spark, d):
    """Routes as one label each; routes that read alike count once."""
    s = _steps(spark, d).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("position", "label"))).alias("s"))
    return s.select(F.array_join(F.transform("s", lambda x: x["label"]), " -> ").alias("label")).distinct()


PATHS = """WITH RECURSIVE e AS (SELECT DISTINCT source, target FROM graph_calls WHERE kind IN ({kinds}) AND source IS NOT NULL AND target IS NOT NULL),
g AS (SELECT DISTINCT id FROM graph_functions WHERE {ends}),
w AS (SELECT node AS start, node AS at_node, [node] AS p FROM {starts}
      UNION ALL SELECT w.start, e.target, list_append(w.p, e.target) FROM w JOIN e ON e.source = w.at_node WHERE len(w.p) < 13 AND NOT list_contains(w.p, e.target) AND w.at_node NOT IN (SELECT id FROM g)),
r AS (SELECT start, at_node AS "end", array_to_string(p, '/') AS path, len(p) - 1 AS length FROM w WHERE at_node IN (SELECT id FROM g) AND len(p) > 1)
"""
OWN = "'direct', 'external_call'"


def _paths(spark, d, kinds, names, starts=None, bound=13):
    e = _edges(spark, d, kinds)
    ends = table(spark, d, "graph_functions").where(F.col("is_library_api") & F.col("name").isin(*names)).select(F.col("id").alias("node"))
    return G.simple_paths(e, "source", "target", starts if starts is not None else G.roots(e, "source", "target"), ends, bound)


@query("g5_shortest_paths", PATHS.format(kinds=OWN, ends="is_library_api AND name IN ('rtx_open', 'rtx_launch')", starts=ROOTS.format("e")) + """
SELECT start, "end", path, length, rank FROM (SELECT *, row_number() OVER (PARTITION BY start, "end" ORDER BY length, path) AS rank FROM r) WHERE rank <= 4
""")
def g5_shortest_paths(spark, d):
    """The four shortest paths from each root to either of two functions, shortest first, ties by the path."""
    p = _paths(spark, d, ("direct", "external_call"), ("rtx_open", "rtx_launch"))
    return R.top(p, ["start", "end"], [F.col("length"), F.col("path")], 4).select("start", "end", "path", F.col("length").cast("bigint").alias("length"), "rank")


ENTRIES = "(SELECT process_name, min(id) AS node FROM graph_functions WHERE process_name IS NOT NULL AND id IN (SELECT node FROM " + ROOTS.format("e") + ") GROUP BY ALL)"


@query("g6_paths_from_entry", PATHS.format(kinds=OWN, ends="is_library_api", starts=ENTRIES) + """
SELECT process_name, "end", path, rank FROM (SELECT x.process_name, r."end", r.path, row_number() OVER (PARTITION BY x.process_name, r."end" ORDER BY r.length, r.path) AS rank FROM r JOIN """ + ENTRIES + """ x ON x.node = r.start) WHERE rank <= 3
""")
def g6_paths_from_entry(spark, d):
    """How the entry function of each process (its least root) reaches the library functions, three paths each."""
    e = _edges(spark, d, ("direct", "external_call"))
    f = table(spark, d, "graph_functions")
    own = f.where("process_name is not null").select("process_name", F.col("id").alias("node")).join(G.roots(e, "source", "target"), "node", "left_semi")
    entries = own.groupBy("process_name").agg(F.min("node").alias("node"))
    ends = f.where("is_library_api").select(F.col("id").alias("node"))
    p = G.simple_paths(e, "source", "target", entries, ends, 13).join(entries.withColumnRenamed("node", "start"), "start")
    return R.top(p, ["process_name", "end"], [F.col("length"), F.col("path")], 3).select("process_name", "end", "path", "rank")


@query("o7_shortest_first", PATHS.format(kinds=OWN, ends="is_library_api AND name = 'rtx_close'", starts=ROOTS.format("e")) + 'SELECT path, length, row_number() OVER (ORDER BY length, path) AS position FROM r ORDER BY length, path LIMIT 200')
def o7_shortest_first(spark, d):
    """The 200 shortest paths over all processes: a budget shared by all, shortest first."""
    p = _paths(spark, d, ("direct", "external_call"), ("rtx_close",)).orderBy("length", "path").limit(200)
    return p.select("path", F.col("length").cast("bigint").alias("length"), F.row_number().over(Window.orderBy("length", "path")).alias("position"))


@query("g27_value_routes", PATHS.format(kinds="'direct', 'indirect', 'external_call'", ends="is_library_api AND name = 'rtx_enqueue'", starts=ROOTS.format("e")) + 'SELECT start, path, length FROM r')
def g27_value_routes(spark, d):
    """All routes on which values get from a root to a queue's end."""
    return _paths(spark, d, ("direct", "indirect", "external_call"), ("rtx_enqueue",)).select("start", "path", F.col("length").cast("bigint").alias("length"))


@query("g7_call_tree_paths", "SELECT root_id, path, depth FROM (" + P3_HIERARCHY + ") WHERE n_descendants = 0")
def g7_call_tree_paths(spark, d):
    """All ways from a root down the call tree to a leaf."""
    h = hierarchy(_edges(spark, d, ("direct",)), "source", "target", paths=True).where("size = 1")
    return h.select(F.col("root").alias("root_id"), F.array_join("path", "/").alias("path"), F.col("depth").cast("int").alias("depth"))


# ---- includes

INCLUDES = r"""
i AS (SELECT DISTINCT process_name, path, regexp_extract(line, '#[ \t]*include[ \t]*[<"]([^>"]+)[>"]', 1) AS included FROM (
  SELECT process_name, path, unnest(string_split(replace(replace(ltrim(content, chr(65279)), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS line FROM source_files WHERE content IS NOT NULL AND regexp_matches(path, '\.[ch]$'))
  WHERE regexp_matches(line, '^[ \t]*#[ \t]*include[ \t]*[<"][^>"]+[>"]')),
own AS (SELECT DISTINCT process_name, path, regexp_extract(path, '[^/]+$') AS base, regexp_replace(path, '/[^/]+$', '') AS folder FROM source_files WHERE path IS NOT NULL AND process_name IS NOT NULL),
under AS (SELECT o.process_name, o.path, h.folder FROM own o JOIN (SELECT DISTINCT process_name, folder FROM own) h ON h.process_name = o.process_name AND starts_with(o.path, h.folder || '/')),
t AS (SELECT i.*, coalesce(
  (SELECT min(o.path) FROM own o WHERE o.process_name = i.process_name AND o.path = regexp_replace(i.path, '[^/]+$', '') || i.included),
  (SELECT min(u.path) FROM under u WHERE u.process_name = i.process_name AND u.path = u.folder || '/' || i.included),
  (SELECT CASE WHEN count(*) = 1 THEN min(o.path) END FROM own o WHERE o.process_name = i.process_name AND o.base = regexp_extract(i.included, '[^/]+$')),
  (SELECT min(o.path) FROM own o WHERE o.process_name = i.process_name AND o.base = regexp_extract(i.included, '[^/]+$') AND ends_with(o.path, i.included)),
  (SELECT min(o.path) FROM own o WHERE o.process_name = i.process_name AND o.base = regexp_extract(i.included, '[^/]+$'))) AS target FROM i)
"""
VISIBLE = INCLUDES + r""",
v(path, visible, depth) USING KEY (path, visible) AS (
  SELECT DISTINCT path, path, 0 FROM source_files WHERE regexp_matches(path, '\.[ch]$')
  UNION SELECT v.path, t.target, min(v.depth) + 1 FROM v JOIN t ON t.path = v.visible WHERE t.target IS NOT NULL AND NOT EXISTS (SELECT 1 FROM recurring.v z WHERE z.path = v.path AND z.visible = t.target) GROUP BY v.path, t.target)
"""


@query("s8_include_lookup", "WITH " + INCLUDES + "SELECT path, included, target AS resolved FROM t")
def s8_include_lookup(spark, d):
    """Each include by five ranked rules; unresolved ones stay with null."""
    return I.resolved_includes(table(spark, d, "source_files")).select("path", "included", F.col("target").alias("resolved"))


@query("j21_include_resolution", "WITH " + INCLUDES + "SELECT process_name, count(*) AS includes, count(target) AS resolved FROM t GROUP BY ALL")
def j21_include_resolution(spark, d):
    return I.resolved_includes(table(spark, d, "source_files")).groupBy("process_name").agg(F.count(F.lit(1)).alias("includes"), F.count("target").alias("resolved"))


@query("x41_unresolved_includes", "WITH " + INCLUDES + "SELECT included, count(*) AS files, min(path) AS first_file FROM t WHERE target IS NULL GROUP BY ALL")
def x41_unresolved_includes(spark, d):
    return I.resolved_includes(table(spark, d, "source_files")).where("target is null").groupBy("included").agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("first_file"))


@query("s9_include_closure", "WITH RECURSIVE " + VISIBLE + "SELECT path, count(*) - 1 AS included, max(depth) AS depth FROM v GROUP BY ALL")
def s9_include_closure(spark, d):
    """How many files each C file includes directly or through others, and how deep."""
    return I.visible_files(table(spark, d, "source_files")).groupBy("path").agg((F.count(F.lit(1)) - 1).alias("included"), F.max("depth").alias("depth"))


@query("g17_visible_files", "WITH RECURSIVE " + VISIBLE + "SELECT path, visible, depth FROM v")
def g17_visible_files(spark, d):
    return I.visible_files(table(spark, d, "source_files"))


@query("v17_visible_macros")
def v17_visible_macros(spark, d):
    """Macros that each file sees, the nearest definition of each name."""
    files = table(spark, d, "source_files")
    return I.visible_macros(scanned(files).where("what = 'macro'"), I.visible_files(files))
