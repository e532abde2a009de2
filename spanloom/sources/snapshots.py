"""Snapshot and index files: JSON snapshots read with a projected schema, CSV with a byte order mark, grouped indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "﻿"


def write_snapshots(df: DataFrame, path: str, by: str) -> None:
    """JSON lines in one folder per value of ``by``; a folder that exists is an error (snapshots are immutable)."""
    df.write.partitionBy(by).mode("errorifexists").json(path)


def read_snapshots(spark: SparkSession, path: str, schema: str, corrupt: str = "keep") -> DataFrame:
    """Snapshots with only the columns of ``schema`` parsed; unreadable rows kept as nulls, dropped or fatal."""
    mode = {"keep": "PERMISSIVE", "drop": "DROPMALFORMED", "fail": "FAILFAST"}[corrupt]
    return spark.read.schema(schema).option("mode", mode).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """All columns as text with a header whose first name carries a byte order mark; null is an empty field."""
    first = df.columns[0]
    df.select([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(BOM + c if c == first else c) for c in df.columns]).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The text ``columns`` of CSV files with or without a byte order mark; missing columns and empty fields are empty."""
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    raw = raw.toDF(*[c.lstrip(BOM) for c in raw.columns])
    return raw.select([F.coalesce(F.col(c), F.lit("")).alias(c) if c in raw.columns else F.lit("").alias(c) for c in columns])


def grouped_index(df: DataFrame, value: str, fields: list[str]) -> DataFrame:
    """One JSON text per value: its sorted distinct entries."""
    return df.groupBy(value).agg(F.to_json(F.array_sort(F.collect_set(F.struct(*fields)))).alias("entries"))


def flattened_index(df: DataFrame, value: str, entry: str) -> DataFrame:
    """The rows of a grouped index; ``entry`` is the schema of an entry."""
    return df.select(value, F.explode(F.from_json("entries", f"array<struct<{entry}>>")).alias("e")).select(value, "e.*")
