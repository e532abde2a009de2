"""Incremental upkeep: new files of a growing table are folded into keyed state by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanloom.session import shared_folder


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int) -> DataFrame:
    """The Parquet files under ``path``, or the one file it names, as a stream."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile():
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def _generations(spark: SparkSession, root: str) -> dict[int, str]:
    """The whole generations of state under ``root``, by the number of their micro batch."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, "state-*/_SUCCESS"))
    return {int(s.getPath().getParent().getName().removeprefix("state-")): s.getPath().getParent().toString() for s in done or []}


def folded_stream(
    spark: SparkSession, stream: DataFrame, reduced: Callable[[DataFrame], DataFrame], merged: Callable[[DataFrame], DataFrame], folder: str,
) -> DataFrame:
    """The state that micro batches of ``stream`` are folded into until none is left.

    A batch is ``reduced``, put together with the newest whole generation of an earlier batch under
    ``folder``, ``merged`` and written as the batch's generation. What is whole is seen on disk, not
    remembered: a stream that is started again on its ``folder``, also after a failure at any point,
    goes on where it ended, and a batch that is run again starts from the same generation.
    """

    def fold(batch: DataFrame, number: int) -> None:
        rows = reduced(batch)
        whole = _generations(spark, folder)
        before = max((n for n in whole if n < number), default=None)
        if before is not None:
            rows = merged(spark.read.parquet(whole[before]).select(*rows.columns).unionByName(rows))
        rows.write.mode("overwrite").parquet(f"{folder}/state-{number}")
        for n, path in whole.items():  # the one before stays, in case this batch is run again
            if before is not None and n < before:
                old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    q = stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    whole = _generations(spark, folder)
    return spark.read.parquet(whole[max(whole)]) if whole else reduced(spark.createDataFrame([], stream.schema))


def latest_by_stream(
    spark: SparkSession, path: str, schema: StructType, keys: list[str], order: list[str], files_per_batch: int = 64, folder: str | None = None,
) -> DataFrame:
    """The latest row per key of the files under ``path``, read as a stream until none is left (:func:`folded_stream`)."""

    def newest(df: DataFrame) -> DataFrame:
        row = F.struct(*order, *[c for c in df.columns if c not in keys and c not in order])
        return df.groupBy(*keys).agg(F.max(row).alias("_r")).select(*keys, "_r.*")

    return folded_stream(spark, file_stream(spark, path, schema, files_per_batch), newest, newest, folder or shared_folder(spark, "stream"))


def windowed_counts(
    spark: SparkSession, path: str, schema: StructType, at: str, group: str, width: str = "1 hour", files_per_batch: int = 64, folder: str | None = None,
) -> DataFrame:
    """Rows per tumbling window and group of the files under ``path``, read as a stream until none is left; an extension for event tables.

    The table is finite, so no watermark drops late rows: the counts of each micro batch are added to
    those of the batches before it (:func:`folded_stream`).
    """

    def counted(df: DataFrame) -> DataFrame:
        rows = df.groupBy(F.window(F.col(at).cast("timestamp"), width), group).agg(F.count(F.lit(1)).alias("n"))
        return rows.select(F.col("window.start").alias("window_start"), group, "n")

    def added(df: DataFrame) -> DataFrame:
        return df.groupBy("window_start", group).agg(F.sum("n").alias("n"))

    return folded_stream(spark, file_stream(spark, path, schema, files_per_batch), counted, added, folder or shared_folder(spark, "windows"))


def fresh_files(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 64, folder: str | None = None) -> DataFrame:
    """``path``, ``length``, ``modified`` and ``n_rows`` of the files of a catalog, each file read once: on a later call with the same ``folder`` only new files are read."""
    stream = file_stream(spark, path, schema, files_per_batch).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")

    def seen(df: DataFrame) -> DataFrame:
        names = F.col("file_path").alias("path"), F.col("file_size").alias("length"), F.col("file_modification_time").alias("modified")
        return df.groupBy(*names).agg(F.count(F.lit(1)).alias("n_rows"))

    def newest(df: DataFrame) -> DataFrame:
        return df.groupBy("path").agg(F.max(F.struct("modified", "length", "n_rows")).alias("x")).select("path", "x.length", "x.modified", "x.n_rows")

    return folded_stream(spark, stream, seen, newest, folder or shared_folder(spark, "catalog"))
