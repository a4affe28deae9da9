"""Session settings, and the one way this library cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def build_session(
    app: str = "ripplepanel", master: str | None = None, shuffle_partitions: int | None = None
) -> SparkSession:
    """A session with adaptive execution on and timestamps pinned to UTC.

    On a cluster pass neither ``master`` nor ``shuffle_partitions``: both come
    from the submit command, and AQE coalesces or splits shuffle partitions.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        builder = builder.config("spark.driver.memory", "12g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may
    fall back to a folder on this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    app = spark.sparkContext.applicationId
    if named:
        return f"{named.rstrip('/')}/ripplepanel-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="ripplepanel-", dir=os.environ.get("TMPDIR"))
    return _LOCAL_ROOTS[app]


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, tag: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table.

    Cuts the lineage in one pass over the data, survives lost executors, and
    gives the optimizer a real size to decide broadcasts on.
    """
    return cut_at(df, tag)[0]


def cut_at(df: DataFrame, tag: str = "cut") -> tuple[DataFrame, str]:
    """``cut``, with the folder of the written table, for callers that delete it once it is no longer read."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that ``cut_at`` wrote."""
    gone = spark._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
