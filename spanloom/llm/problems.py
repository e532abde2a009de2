"""The problems on source text and documents (pN_). SQL can't express them; tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import docpairs, language, lookalikes, mixing, parsing, tokens
from spanloom.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return parsing.invalid_files(table(spark, d, "source_files"), table(spark, d, "preprocessor_configs"))


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates per repository and language."""
    return parsing.invalid_rates(table(spark, d, "source_files"), table(spark, d, "preprocessor_configs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.descriptions(table(spark, d, "graph_functions"), table(spark, d, "source_files")).select(F.col("id").alias("function_id"))


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of code and description."""
    pairs = docpairs.documented(table(spark, d, "graph_functions"), table(spark, d, "source_files"))
    return pairs.select(F.col("id").alias("function_id"), F.col("source").alias("code"), "description", "origin")


def _spans(spark: SparkSession, d: str) -> DataFrame:
    weights = language.fit(language.training_samples(table(spark, d, "documents")))
    return language.language_spans(table(spark, d, "graph_functions"), weights)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).select(F.col("id").alias("function_id"), "lang").distinct()


def _file_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").groupBy("process_name", F.col("path").alias("file")).agg(F.max(F.length("content")).alias("file_chars"))


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    """Share of each language's text in its function's and its file's text, in characters."""
    rows = _spans(spark, d).join(_file_sizes(spark, d), ["process_name", "file"], "left")
    return rows.select(
        F.col("id").alias("function_id"), "lang", "chars", (F.col("chars") / F.col("source_chars")).alias("function_share"),
        F.when(F.col("file_chars") > 0, F.col("chars") / F.col("file_chars")).alias("file_share"),
    )


def p5_file_shares(spark: SparkSession, d: str) -> DataFrame:
    """Share of each language's text in all functions of a file in the file's text."""
    sums = _spans(spark, d).where("file is not null").groupBy("process_name", "file", "lang").agg(F.sum("chars").alias("chars"), F.countDistinct("id").alias("functions"))
    return sums.join(_file_sizes(spark, d), ["process_name", "file"], "left").select(
        "process_name", "file", "lang", "functions", "chars", F.when(F.col("file_chars") > 0, F.col("chars") / F.col("file_chars")).alias("file_share")
    )


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_column(table(spark, d, "documents"), "doc_id", "text")


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", "source", "text").where("source is not null")
    sized = docs.select(F.struct("doc_id", "source").alias("key"), "text")
    counts = tokens.encode_column(sized, "key", "text", count_only=True)
    return mixing.mix(counts.select(F.col("key.doc_id").alias("id"), F.col("key.source").alias("source"), "tokens"), table(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mixture and how often each is in it."""
    return _mix(spark, d)[0].withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached."""
    return _mix(spark, d)[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.lookalike_pairs(table(spark, d, "documents"), "doc_id", "text")


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each document's class of texts that look the same."""
    return lookalikes.lookalike_classes(table(spark, d, "documents"), "doc_id", "text")


def p10_forms(spark: SparkSession, d: str) -> DataFrame:
    """Each document's text in its one form."""
    return lookalikes.unified(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {
    "p1_found": (p1_found, None),
    "p1_rates": (p1_rates, None),
    "p4_found": (p4_found, None),
    "p4_pairs": (p4_pairs, None),
    "p5_found": (p5_found, None),
    "p5_shares": (p5_shares, None),
    "p5_file_shares": (p5_file_shares, None),
    "p8_ids": (p8_ids, None),
    "p9_mix": (p9_mix, None),
    "p9_shares": (p9_shares, None),
    "p10_found": (p10_found, None),
    "p10_forms": (p10_forms, None),
    "p10_classes": (p10_classes, None),
}
