"""Session and checkpoint helpers shared by every operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Folders of written rounds by session, for :func:`release`.
_FOLDERS: dict[str, list[str]] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the cluster's setting; one of our own only on a local master without it, as in tests.

    Elsewhere a folder of one machine would lose rounds, so a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: iterative operators need a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spanloom-checkpoint-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    sc.setCheckpointDir(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint folder; :func:`release` removes it."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _FOLDERS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> None:
    """Remove all that operators of this application have written; their results can't be read afterwards."""
    for path in _FOLDERS.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


class Rounds:
    """Tables of an iterative operator, written to the shared checkpoint folder to cut lineage.

    A lost executor then costs a re-read, not a re-run of earlier rounds. A table that a later one
    replaces is removed as soon as the later one is whole; :meth:`only` ends an operator by removing
    all tables but those that its result reads, which stay until :func:`release`.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = shared_folder(spark, "rounds")
        self.n = 0
        self.live: list[str] = []

    def cut(self, df: DataFrame, replaces: DataFrame | None = None, **measures: Column) -> DataFrame:
        """``df`` written and read again; ``measured`` of the result has the ``measures``, aggregates taken in passing."""
        path = f"{self.root}/{self.n}"
        self.n += 1
        seen = Observation() if measures else None
        (df.observe(seen, *[c.alias(n) for n, c in measures.items()]) if seen else df).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._round_path = path
        out.measured = seen.get if seen else {}
        self.live.append(path)
        self.drop(replaces)
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_round_path", None) if df is not None else None
        if path in self.live:
            self.live.remove(path)
            _delete(self.spark, path)

    def only(self, *tables: DataFrame) -> None:
        """Remove every table of these rounds but ``tables``."""
        kept = {getattr(t, "_round_path", None) for t in tables}
        for path in [p for p in self.live if p not in kept]:
            self.live.remove(path)
            _delete(self.spark, path)


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("spanloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.extraJavaOptions", "-Xss8m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark
