"""Queries on what happens inside C functions. SQL can't express them; they are tested on functions written for it."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import cbody as B
from spanloom.operators.csource import scanned
from spanloom.operators.includes import visible_files, visible_macros
from spanloom.plans.warehouse import _all_sites
from spanloom.sources.tables import table

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = (f, None)
    return f


def _files(spark, d):
    return table(spark, d, "source_files")


def _reaching(spark, d):
    return B.over_files(_files(spark, d), B.argument_rows, B.REACHING)


def _calls(spark, d):
    return B.over_files(_files(spark, d), B.call_rows, B.CALLS)


@query
def v5_handle_openings(spark, d):
    """The opening that each use of a handle has, by the definitions that reach it; several are ambiguous, never the nearest."""
    return B.over_files(_files(spark, d), B.handle_rows, B.HANDLES)


@query
def v6_return_uses(spark, d):
    """What is done with the results of library calls: how often each is assigned, tested, returned, passed on or ignored."""
    apis = table(spark, d, "graph_functions").where("is_library_api").select(F.col("name").alias("callee")).distinct()
    return _calls(spark, d).join(apis, "callee").groupBy("callee", "use").agg(F.count(F.lit(1)).alias("calls"))


@query
def v7_reaching_definitions(spark, d):
    """The definitions that reach each argument, over if, else, switch and loops."""
    return _reaching(spark, d)


@query
def v13_constant_tables(spark, d):
    return B.over_files(_files(spark, d), B.table_rows, B.TABLES)


@query
def v14_selected_elements(spark, d):
    return B.over_files(_files(spark, d), B.selected_rows, B.SELECTED)


@query
def v15_wrapper_outputs(spark, d):
    """Arguments that an earlier call wrote by their address."""
    return _reaching(spark, d).where("kind = 'output'").select("process_name", "path", "function", "line", "callee", "position", "argument", F.col("definition").alias("written_by"), "defined_at")


@query
def v16_string_flow(spark, d):
    """Arguments that a string was copied to."""
    return _reaching(spark, d).where("kind = 'string'").select("process_name", "path", "function", "line", "callee", "position", "argument", F.col("definition").alias("text"), "defined_at")


def _settled(spark, d):
    files = _files(spark, d)
    macros = visible_macros(scanned(files).where("what = 'macro' and not startswith(detail, '()')"), visible_files(files)).select("path", "name", "value")
    return B.settled_arguments(files, macros, table(spark, d, "graph_functions").where("is_library_api").select("name"))


@query
def v3_local_rules(spark, d):
    """Each argument of a library call by the first rule that settles it within its function, else unresolved."""
    return _settled(spark, d)


@query
def x32_initial_arms(spark, d):
    """Arms of each library call: the product of its arguments' values, unknown (null) beyond 32 or where a value is open."""
    n = F.coalesce(F.size("values"), F.lit(0))
    g = _settled(spark, d).groupBy("process_name", "path", "function", "line", "callee").agg(F.collect_list(F.when(F.col("values").isNull(), 0).otherwise(n)).alias("sizes"))
    product = F.aggregate("sizes", F.lit(1).cast("bigint"), lambda a, x: F.when(a > 32, a).otherwise(a * x))
    return g.select("process_name", "path", "function", "line", "callee", F.when((product > 0) & (product <= 32), product).alias("arms"))


@query
def x33_settled_shares(spark, d):
    """How many arguments of each function each rule settles."""
    return _settled(spark, d).groupBy("callee", "position", "rule").agg(F.count(F.lit(1)).alias("arguments"))


@query
def x26_site_calls(spark, d):
    """Recorded sites and whether the call is found in the source: on its line, elsewhere in the file, or not."""
    sites = _all_sites(spark, d).select("target_function", "file", "line").where("file is not null and line is not null").distinct()
    c = _calls(spark, d).select(F.col("path").alias("file"), F.col("callee").alias("target_function"), "line").distinct()
    here = c.withColumn("here", F.lit(True))
    near = c.select("file", "target_function").distinct().withColumn("near", F.lit(True))
    found = F.when(F.col("here"), "line").when(F.col("near"), "file").otherwise("none")
    return sites.join(here, ["file", "target_function", "line"], "left").join(near, ["file", "target_function"], "left").groupBy("target_function", found.alias("found")).agg(F.count(F.lit(1)).alias("sites"))


@query
def x28_handle_positions(spark, d):
    """The position at which each function takes a handle: the only one at which an opened handle is passed, 0 for several."""
    opened = _reaching(spark, d).where("kind = 'definition' and startswith(definition, 'rtx_open')").where("argument = name")
    return opened.groupBy("callee").agg(F.when(F.countDistinct("position") == 1, F.min("position")).otherwise(0).alias("position"), F.count(F.lit(1)).alias("uses"))


@query
def x30_local_provability(spark, d):
    """Whether all definitions that reach an argument are constants."""
    r = _reaching(spark, d).where("argument = name")
    constant = F.col("definition").rlike(r"^[-+(]*\s*(0[xX][0-9a-fA-F]+|[0-9]+)[uUlL]*\)*$")
    return r.groupBy("process_name", "path", "function", "line", "callee", "position").agg(F.bool_and((F.col("kind") == "definition") & constant).alias("provable"), F.count(F.lit(1)).alias("definitions"))


@query
def x35_call_guards(spark, d):
    """The conditions that each call is under, those of else arms negated."""
    return _calls(spark, d).where("guards <> ''").select("process_name", "path", "function", "line", "callee", "guards")


@query
def x42_safe_parameters(spark, d):
    """Parameters that are never assigned, updated or lent by their address."""
    return B.over_files(_files(spark, d), B.safe_rows, B.SAFE)
