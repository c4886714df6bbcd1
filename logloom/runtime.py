"""Session settings and materialised tables in the shared folder.

Iterative operators cut their lineage with ``materialize``: the rows are
written once as Parquet below ``spark.checkpoint.dir`` (which the cluster
names) and read back, so a lost executor costs nothing but a re-read.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

_written: dict[str, SparkSession] = {}


def build_session(app: str = "logloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with this engine's defaults, for the CLI, bench and tests."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in (DEFAULTS | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local master may do without one."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    global _local
    if not _local or not os.path.isdir(_local):
        _local = tempfile.mkdtemp(prefix="logloom-")
    return "file://" + _local


_local = ""


def materialize(df: DataFrame, label: str = "t", partition_by: list[str] | None = None, counts: dict[str, Column] | None = None) -> DataFrame:
    """Write df below the shared folder and read it back (lineage ends here).

    counts are aggregates that the write observes on its way, so that asking
    for them takes no job of its own; the result has them as ``_logloom_counts``.
    """
    spark = df.sparkSession
    seen = Observation() if counts else None
    if seen:
        df = df.observe(seen, *[c.alias(k) for k, c in counts.items()])
    path = scratch_path(spark, label)
    w = df.write.mode("error").option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    schema = df.schema
    w.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._logloom_path = path
    out._logloom_counts = seen.get if seen else {}
    return out


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one, deleted at the end of scratch() or of the driver."""
    path = f"{shared_dir(spark).rstrip('/')}/logloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


@contextmanager
def scratch() -> Iterator[None]:
    """Everything materialised inside is deleted at the end: for long sessions that run many queries."""
    before = set(_written)
    try:
        yield
    finally:
        for path in set(_written) - before:
            _delete(_written.pop(path), path)


def release(*dfs: DataFrame) -> None:
    """Delete materialised tables that no later plan reads."""
    for df in dfs:
        path = getattr(df, "_logloom_path", None)
        if path and path in _written:
            _delete(_written.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone, or the folder is
        pass


def _cleanup() -> None:
    global _local
    for path, spark in list(_written.items()):
        _written.pop(path, None)
        if path.startswith("file://"):
            import shutil

            shutil.rmtree(path[len("file://"):], ignore_errors=True)
        else:
            _delete(spark, path)
    if _local:
        import shutil

        shutil.rmtree(_local, ignore_errors=True)


atexit.register(_cleanup)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
