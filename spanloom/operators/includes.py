"""Includes of C files: their lines, the ranked lookup of their targets, what a file sees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.graph import paired_reach
from spanloom.operators.joins import ranked_match

INCLUDE = r'(?m)^\x{FEFF}?[ \t]*#[ \t]*include[ \t]*[<"]([^>"\n]+)[>"]'


def include_lines(files: DataFrame) -> DataFrame:
    """``process_name``, ``path``, ``included``: the distinct includes of the C files."""
    c = files.where(F.col("content").isNotNull() & F.col("path").rlike(r"\.[ch]$")).select("process_name", "path", "content")
    names = F.regexp_extract_all(F.regexp_replace("content", "\r\n?", "\n"), F.lit(INCLUDE), F.lit(1))
    return c.select("process_name", "path", F.explode(F.array_distinct(names)).alias("included")).distinct()


def _folder(path: str):
    return F.regexp_replace(path, "[^/]+$", "")


def _base(path: str):
    return F.regexp_extract(path, "([^/]+)$", 1)


def without_dots(path):
    """A path without ``./`` and, four levels deep at most, without ``x/../``."""
    out = F.regexp_replace(path, r"(^|/)(\./)+", "$1")
    for _ in range(4):
        out = F.regexp_replace(out, r"(^|/)(?!\.\./)[^/]+/\.\./", "$1")
    return out


def resolved_includes(files: DataFrame) -> DataFrame:
    """``process_name``, ``path``, ``included``, ``target`` (null if unresolved): each include by the first rule that finds a file of the process.

    The rules: relative to the file's folder; the path below one of the process's folders; the only
    file of that name; one of several whose path ends with the include; the first of several. Where a
    rule finds several files the least path counts. Null processes meet nothing.
    """
    lines = include_lines(files)
    own = files.select("process_name", F.col("path").alias("target")).where("target is not null and process_name is not null").distinct()
    asked = lines.withColumns({"near": without_dots(F.concat(_folder("path"), F.col("included"))), "base": _base("included")})
    folders = own.select("process_name", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(F.split("target", "/")) - 1), lambda i: F.array_join(F.slice(F.split("target", "/"), 1, i), "/")))).alias("folder"))
    holds = own.select("process_name", F.regexp_replace(_folder("target"), "/$", "").alias("folder")).distinct()
    below = own.select("process_name", "target", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("target", "/")) - 1), lambda i: F.array_join(F.slice(F.split("target", "/"), 1, i), "/"))).alias("folder")).join(
        holds.join(folders.distinct(), ["process_name", "folder"], "left_semi"), ["process_name", "folder"]
    )
    below = below.select("process_name", F.expr("substring(target, length(folder) + 2)").alias("included"), "target")
    bases = own.withColumn("base", _base("target"))
    alone = bases.groupBy("process_name", "base").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("target")).where("n = 1")
    ending = asked.select("process_name", "included", "base").distinct().join(bases, ["process_name", "base"]).where(F.col("target").endswith(F.col("included"))).select("process_name", "included", "target")
    rules = [
        (own.withColumn("near", F.col("target")), ["process_name", "near"]), (below, ["process_name", "included"]), (alone, ["process_name", "base"]),
        (ending, ["process_name", "included"]), (bases, ["process_name", "base"]),
    ]
    return ranked_match(asked, "included", rules, "target", "found").select("process_name", "path", "included", F.col("found").alias("target"))


def visible_files(files: DataFrame) -> DataFrame:
    """``path``, ``visible``, ``depth``: every C file, itself at 0, with the files that it includes directly or through others."""
    edges = resolved_includes(files).where("target is not null")
    seeds = files.where(F.col("path").rlike(r"\.[ch]$")).select(F.col("path").alias("node"))
    return paired_reach(edges, "path", "target", seeds).select(F.col("seed").alias("path"), F.col("node").alias("visible"), "depth")


def visible_macros(macros: DataFrame, seen: DataFrame) -> DataFrame:
    """``path``, ``name``, ``value``, ``from_path``: for each file the macros it sees, of several definitions the one of the nearest file (ties: least path, first line).

    ``macros`` has path, name, line, detail; ``seen`` is of :func:`visible_files`.
    """
    first = macros.groupBy(F.col("path").alias("visible"), "name").agg(F.min_by("detail", F.struct("line", "detail")).alias("value"))
    best = seen.join(first, "visible").groupBy("path", "name").agg(F.min(F.struct("depth", "visible", "value")).alias("m"))
    return best.select("path", "name", "m.value", F.col("m.visible").alias("from_path"))
