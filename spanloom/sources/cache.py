"""Results kept by a fingerprint of all their inputs, and files written as a whole."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.session import ensure_checkpoint_dir


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def input_fingerprint(spark: SparkSession, inputs: list[str], **parameters) -> str:
    """A digest of the names, lengths and times of all files under ``inputs`` and of ``parameters``."""
    seen = []
    for root in inputs:
        p, fs = _path(spark, root)
        files = fs.listFiles(p, True)
        while files.hasNext():
            f = files.next()
            seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(json.dumps([sorted(seen), parameters], sort_keys=True).encode()).hexdigest()


def cached(spark: SparkSession, name: str, inputs: list[str], build: Callable[[], DataFrame], folder: str | None = None, **parameters) -> DataFrame:
    """The table of ``build``, kept as Parquet under the fingerprint of its inputs and ``parameters``: built once, anew when a file changes.

    A table that was not written whole is not used. Tables stay in ``folder``, by default in the shared checkpoint folder.
    """
    folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/cache"
    at = f"{folder}/{name}-{input_fingerprint(spark, inputs, **parameters)}"
    done, fs = _path(spark, f"{at}/_SUCCESS")
    if not fs.exists(done):
        build().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def write_whole(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, replaced as a whole: written beside ``path`` and renamed over it, so that a reader never sees a part."""
    staged, fs = _path(spark, f"{path}.staged")
    out = fs.create(staged, True)
    out.write(bytearray(text.encode()))
    out.close()
    target, _ = _path(spark, path)
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(staged, target, options)


BEGIN, END = "<!-- begin {0} -->", "<!-- end {0} -->"


def with_section(text: str, name: str, body: str) -> str:
    """``text`` with ``body`` between the markers of ``name``; appended where there are none."""
    begin, end = BEGIN.format(name), END.format(name)
    head, found, rest = text.partition(begin)
    if not found or end not in rest:
        return f"{text.rstrip()}\n\n{begin}\n{body}\n{end}\n".lstrip()
    return f"{head}{begin}\n{body}\n{end}{rest.partition(end)[2]}"


def is_stale(text: str, name: str, body: str) -> bool:
    """Whether the section of ``name`` in ``text`` is not ``body``."""
    return with_section(text, name, body) != text


def fresh_run_folder(spark: SparkSession, root: str, stamp: str) -> str:
    """A new folder of a run under ``root``: ``stamp``, or with the first free number where it is taken. A run's folder is never written again."""
    n = 1
    while True:
        at, fs = _path(spark, f"{root}/{stamp}" if n == 1 else f"{root}/{stamp}-{n}")
        if not fs.exists(at) and fs.mkdirs(at):
            return at.toString()
        n += 1
