"""Plan plumbing shared by the operators: materialisation, bounded broadcast and hot-key handling.

Nothing here keeps state on one machine. Lineage is cut with ``checkpoint()`` in the
folder the cluster names in ``spark.checkpoint.dir``; only a session that names none
(unit tests) gets a temporary folder.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast after it was counted. Rows here are keys and counters, about 100 bytes each.
MAX_BROADCAST_ROWS = 50_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; only a session on a single machine may go without one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="loam-checkpoint-"))


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and continue from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory (a file or a folder of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_small(left: DataFrame, small: DataFrame, on: list[str], how: str, salt: Column | None = None, fanout: int = 16) -> DataFrame:
    """Join with a side that is usually tiny: broadcast when its counted size allows it, else shuffle.

    The shuffled form spreads a hot key of ``left`` over ``fanout`` tasks with ``salt`` and
    replicates ``small`` as often, so that one key with a third of all rows stays balanced.
    """
    if small.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        return left.join(F.broadcast(small), on, how)
    if salt is None:
        return left.join(small, on, how)
    slots = F.array([F.lit(i) for i in range(fanout)])
    salted = left.withColumn("_salt", F.pmod(salt, F.lit(fanout)).cast("int"))
    return salted.join(small.withColumn("_salt", F.explode(slots)), [*on, "_salt"], how).drop("_salt")


def hot_keys(df: DataFrame, key: str, rows_per_slot: int) -> DataFrame:
    """(key, _slots) of the keys with more than ``rows_per_slot`` rows, counted once and written; usually a few or none."""
    hot = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_slot)
    return materialize(hot.select(key, F.ceil(F.col("_n") / rows_per_slot).cast("int").alias("_slots")))


def place(df: DataFrame, hot: DataFrame, key: str, spread: str) -> DataFrame:
    """Add ``_slots`` (how many tasks share the key) and ``_slot`` (this row's one), given the hot keys.

    Rows of a hot key are assigned by the hash of ``spread``, so equal ``spread`` values stay together.
    """
    out = join_small(df, hot, [key], "left", salt=F.xxhash64(spread))
    out = out.withColumn("_slots", F.coalesce("_slots", F.lit(1)))
    return out.withColumn("_slot", F.pmod(F.xxhash64(spread), F.col("_slots").cast("long")).cast("int"))


def with_slots(df: DataFrame, key: str, spread: str, rows_per_slot: int) -> DataFrame:
    """``place`` with the hot keys of ``df`` itself."""
    return place(df, hot_keys(df, key, rows_per_slot), key, spread)


#: Bytes of input that may be dealt out over the cores; a larger input has enough partitions of its own or is left as it is.
MOST_DEALT = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for costly row-wise work on an input of few partitions.

    Only an input that the optimiser knows to be below ``MOST_DEALT`` bytes is dealt out, so what moves is bounded whatever
    the number of cores; one that comes out of a shuffle is left alone, which asking for its partitions would already run.
    """
    plan = df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString() or int(str(plan.optimizedPlan().stats().sizeInBytes())) > MOST_DEALT:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
