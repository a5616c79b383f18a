"""Session defaults and the shared folder in which multi-pass jobs keep their intermediate tables."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession

_staged: list[str] = []


def session(app: str = "cohortry", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. In local mode with none set, one beside the warehouse, which is shared too."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    context.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return context.getCheckpointDir()


def stage(df: DataFrame, label: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors, prunes columns."""
    spark = df.sparkSession
    path = folder(spark, label)
    df.write.partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted with the staged tables."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _staged.append(path)
    return path


def discard(spark: SparkSession, what: DataFrame | str | None) -> None:
    """Delete what ``stage`` wrote for a table, or a ``folder``; nothing that reads it may be computed afterwards."""
    path = what if isinstance(what, str) else getattr(what, "staged_path", None)
    if path in _staged:
        _staged.remove(path)
        _delete(spark, path)


def released(df: DataFrame) -> bool:
    """Whether the table that ``stage`` wrote for ``df`` has been deleted."""
    path = getattr(df, "staged_path", None)
    return path is not None and path not in _staged


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving what was staged inside; only results that were written elsewhere stay readable."""
    before = len(_staged)
    try:
        yield
    finally:
        release(spark, before)


def release(spark: SparkSession, keep: int = 0) -> int:
    """Delete the tables staged by this process but for the first ``keep``; returns how many there were."""
    gone = _staged[keep:]
    del _staged[keep:]
    for path in gone:
        _delete(spark, path)
    return len(gone)
