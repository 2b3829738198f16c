"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folder: dict[str, str] = {}


def build_session(app: str = "regionloom", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings this library relies on (UTC, AQE with skew handling)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # some stages compute much on few bytes: do not merge them into one task
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


# a task should have at least about this much input before more tasks pay
SMALL_TASK_BYTES = 1 << 20


def spread(df: DataFrame) -> DataFrame:
    """Spread a small input of a compute-heavy step over all cores. Size is the optimizer's estimate: anything above
    a few megabytes per core already comes in enough splits and is left as it is, without a shuffle."""
    if not hasattr(df, "_jdf"):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * 16 * SMALL_TASK_BYTES else df


def staging_folder(spark: SparkSession) -> str:
    """The application's part of the shared folder of the cluster (``spark.checkpoint.dir``).

    Where that is unset, a session whose driver is its only executor gets a temporary folder; on a cluster the executors
    would each write to a disk of their own, so that is an error.
    """
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    alone = context.master == "local" or context.master.startswith("local[")
    if not shared:
        if not alone:
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if context.applicationId not in _local_folder:
            _local_folder[context.applicationId] = tempfile.mkdtemp(prefix="regionloom-")
        shared = _local_folder[context.applicationId]
    return f"{shared.rstrip('/')}/{context.applicationId}"


def clear_stages(spark: SparkSession) -> None:
    """Remove all tables that this application has staged. Call it when no result of theirs is needed any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staging_folder(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the staging folder and read it back.

    Cuts the lineage of iterative jobs, and fixes values that a re-run could change (partition numbers after
    a range shuffle). The table survives the loss of executors.
    """
    spark = df.sparkSession
    path = f"{staging_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "lz4").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Remove a table that ``stage`` has written and that nothing reads any more."""
    context = df.sparkSession.sparkContext
    own = f"{staging_folder(df.sparkSession).rstrip('/')}/stage-".split(":", 1)[-1]
    for name in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if own.lstrip("/") in name:
            folder = context._jvm.org.apache.hadoop.fs.Path(name)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
