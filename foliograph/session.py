"""Session settings, scratch storage and the two helpers that cut or ship a plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

# A side is broadcast only after it has been measured to stay below both bounds.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 * 1024 * 1024

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # many small shuffle blocks, put together to tasks of the advisory size: what one task holds does not grow with the input
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "600",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    # JSON objects with a repeated key keep the last value, map building likewise.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # state of streams on disk, with lists and timers
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime options the operators rely on; safe to call repeatedly."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("foliograph")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # few small partitions are better not merged into fewer while cores are idle
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_scratch: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; ``release`` deletes what is there."""
    path = f"{shared_dir(spark).rstrip('/')}/foliograph/{label}-{uuid.uuid4().hex}"
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete all tables and folders this application has written below the shared folder so far.

    Call it between jobs, when no result that was built from them is read any more. Returns their number.
    """
    gone = _scratch.pop(spark.sparkContext.applicationId, [])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in gone:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    return len(gone)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there.

    Cuts the lineage like a checkpoint, survives lost executors, and the reader gets column
    pruning, the true size for its join choices and no inherited partitioning: a side that is
    shuffled for the join at hand is one the skew join can split.
    """
    spark = df.sparkSession
    folder = scratch_path(spark, "step")
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def settle_counting(df: DataFrame, flag: Column) -> tuple[DataFrame, int]:
    """``settle`` that also tells how many rows satisfy ``flag``, without a second job.

    A repeated stage may count rows twice, so only compare the number with zero.
    """
    seen = Observation()
    watched = df.withColumn("_flag", flag).observe(seen, F.count(F.when(F.col("_flag"), 1)).alias("n"))
    return settle(watched.drop("_flag")), seen.get["n"]


def per_key(df: DataFrame, keys: list[str], *values: Column) -> DataFrame:
    """Aggregate per keys for a join on these keys.

    Grouped by a struct of the keys, the result is shuffled once more for the join. It is
    small, and only sides that come straight out of a shuffle let the skew join split the
    hot keys of the other side.
    """
    grouped = df.groupBy(F.struct(*keys).alias("_k")).agg(*values)
    return grouped.select("_k.*", *[c for c in grouped.columns if c != "_k"])


def widen(df: DataFrame) -> DataFrame:
    """Spread ``df`` over all cores when its input has fewer splits than there are cores.

    For costly work per row on a few large splits; a no-op on inputs of many splits.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` when it has been measured to be small, else leave the join to AQE.

    A table that is nothing but literals, as those of the catalog are, has its known size in the plan and
    is on the driver anyway, so it is not measured. The measure reads at most ``max_rows + 1`` rows; above either bound the join shuffles
    and Spark's skew join splits hot keys.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    if plan.getClass().getSimpleName() == "LocalRelation":
        return F.broadcast(df) if int(str(plan.stats().sizeInBytes())) <= max_bytes else df
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(width)).first()
    return F.broadcast(df) if rows <= max_rows and (size or 0) <= max_bytes else df
