"""One ranking from several differently scaled scores: robust rank aggregation.

Every score is replaced by its rank inside the group, divided by the group's size, so ranges
and distributions no longer matter. For an item with sorted normalised ranks r(1) <= ... <= r(m)
the probability that the k-th smallest of m uniform ranks is as small as r(k) is the beta
order-statistic tail P(Binomial(m, r(k)) >= k). The smallest of these, times m (the correction
for choosing it), is the item's significance; small comes first.

Distribution. A group up to ``ROWS_PER_SLOT`` rows is ranked in one task. For a larger group the
ranks are cumulative counts over its distinct values: values are counted first, range-partitioned
by (group, score, value), summed inside each partition and shifted by the totals of the partitions
before it, so no task ever sees the whole group.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.topn import complete_groups, current_rows, group_numbers
from loam.plans.runtime import hot_keys, join_small, materialize, place

#: Most rows of one group that one task ranks by itself.
ROWS_PER_SLOT = 50_000
#: A value that more rows of a hot group share is looked up apart, so that no task gets all of its rows.
COMMON_VALUE = 10_000

_LOWEST = -1.7976931348623157e308


def mean_ranks(group: np.ndarray, values: np.ndarray) -> np.ndarray:
    """1-based ranks inside each group, highest value first, equal values sharing their mean rank."""
    order = np.lexsort((-values, group))
    g, v = group[order], values[order]
    n = len(order)
    at = np.arange(n)
    new_group = np.ones(n, bool)
    new_group[1:] = g[1:] != g[:-1]
    new_value = new_group.copy()
    new_value[1:] |= v[1:] != v[:-1]
    starts = np.flatnonzero(new_value)
    ends = np.append(starts[1:], n)
    base = at[new_group][np.cumsum(new_group) - 1]
    rank = np.empty(n)
    rank[order] = np.repeat((starts + ends + 1) / 2.0, ends - starts) - base
    return rank


def significance(normalised: np.ndarray) -> np.ndarray:
    """Corrected minimum of the beta order-statistic probabilities of each row's normalised ranks."""
    m = normalised.shape[1]
    r = np.sort(normalised, axis=1)
    tail = [sum(comb(m, j) * r[:, k] ** j * (1 - r[:, k]) ** (m - j) for j in range(k + 1, m + 1)) for k in range(m)]
    return np.min(tail, axis=0) * m


def significance_column(normalised: list[Column]) -> Column:
    """The same as a Catalyst expression."""
    m = len(normalised)
    r = F.array_sort(F.array(*normalised))
    tails = []
    for k in range(m):
        x = r[k]
        tails.append(sum((F.lit(float(comb(m, j))) * F.pow(x, F.lit(j)) * F.pow(1 - x, F.lit(m - j)) for j in range(k + 1, m + 1)), F.lit(0.0)))
    return F.array_min(F.array(*tails)) * m


def _rank_groups(scores: list[str], dedup_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in complete_groups(batches, ["group_id", "_slot"]):
            group = group_numbers(part, ["group_id", "_slot"])
            ident = part.column("item_id").to_numpy()
            keep = current_rows(group, ident, [part.column("version").to_numpy(), part.column("tiebreak").to_numpy()])
            part = part.take(pa.array(keep))
            if dedup_only:
                yield from part.to_batches()
                continue
            g = group[keep]
            size = np.bincount(g)[g]
            ranks = np.column_stack([mean_ranks(g, part.column(c).to_numpy()) for c in scores])
            out = {
                "group_id": part.column("group_id"),
                "item_id": part.column("item_id"),
                "significance": significance(ranks / size[:, None]),
                "mean_rank": ranks.mean(axis=1),
                "group_size": size.astype(np.int64),
            }
            yield from pa.table(out).to_batches()

    return run


def _rank_hot(hot: DataFrame, scores: list[str]) -> DataFrame:
    """Ranks of groups that no single task could hold; ``hot`` has one row per (group, item)."""
    hot = materialize(hot)
    long = hot.select("group_id", "item_id", F.explode(F.array(*[F.struct(F.lit(i).alias("field"), F.col(c).alias("value")) for i, c in enumerate(scores)])).alias("s")).select("group_id", "item_id", "s.*")
    counted = long.groupBy("group_id", "field", "value").agg(F.count(F.lit(1)).alias("n"))
    placed = counted.repartitionByRange(F.col("group_id"), F.col("field"), F.col("value").desc()).withColumn("part", F.spark_partition_id())
    placed = materialize(placed)
    totals = placed.groupBy("group_id", "field", "part").agg(F.sum("n").alias("total"))
    before = Window.partitionBy("group_id", "field").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("group_id", "field", "part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    running = Window.partitionBy("group_id", "field", "part").orderBy(F.col("value").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = placed.withColumn("upto", F.sum("n").over(running)).join(offsets, ["group_id", "field", "part"])
    ranked = ranked.select("group_id", "field", "value", "n", (F.col("offset") + F.col("upto") - (F.col("n") - 1) / 2).alias("rank"))
    ranked = materialize(ranked)
    key = ["group_id", "field", "value"]
    common = ranked.filter(F.col("n") > COMMON_VALUE).select(*key, F.col("rank").alias("common_rank"))
    looked_up = join_small(long, common, key, "left", salt=F.xxhash64("item_id"))
    rare = looked_up.filter("common_rank IS NULL").drop("common_rank").join(ranked.filter(F.col("n") <= COMMON_VALUE).drop("n"), key)
    wide = looked_up.filter("common_rank IS NOT NULL").withColumnRenamed("common_rank", "rank").unionByName(rare)
    per_item = wide.groupBy("group_id", "item_id").agg(*[F.max(F.when(F.col("field") == i, F.col("rank"))).alias(f"r{i}") for i in range(len(scores))])
    sizes = hot.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size"))
    per_item = join_small(per_item, sizes, ["group_id"], "inner", salt=F.xxhash64("item_id"))
    ranks = [F.col(f"r{i}") for i in range(len(scores))]
    return per_item.select(
        "group_id",
        "item_id",
        significance_column([r / F.col("group_size") for r in ranks]).alias("significance"),
        (sum(ranks[1:], ranks[0]) / len(ranks)).alias("mean_rank"),
        "group_size",
    )


def aggregate_ranks(df: DataFrame, group: str, item: str, scores: list[Column], version: str, rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """Significance of every current item of every group: (group, item, significance, mean_rank, group_size).

    Higher scores are better; a missing or NaN score shares the last ranks of its group. Of several
    rows of one (group, item) the one with the greatest ``version`` counts, equal versions being
    decided by a hash of the scores. Rows whose group or item is null are left out, an empty input
    gives an empty result, and other columns of the input are ignored. Order a group by
    (significance, mean_rank, item) for a complete, reproducible ranking.
    """
    names = [f"s{i}" for i in range(len(scores))]
    clean = [F.when(s.cast("double").isNull() | F.isnan(s.cast("double")), F.lit(_LOWEST)).when(s.cast("double") == 0.0, F.lit(0.0)).otherwise(s.cast("double")) for s in scores]
    rows = df.filter(F.col(group).isNotNull() & F.col(item).isNotNull()).select(
        F.col(group).alias("group_id"),
        F.col(item).cast("long").alias("item_id"),
        *[c.alias(n) for c, n in zip(clean, names, strict=True)],
        F.coalesce(F.unix_micros(F.col(version).cast("timestamp")), F.lit(-(2**63))).alias("version"),
    )
    rows = rows.withColumn("tiebreak", F.xxhash64(*names))
    hot_groups = hot_keys(rows, "group_id", rows_per_slot)
    placed = place(rows, hot_groups, "group_id", "item_id")
    by_slot = lambda part: part.repartition("group_id", "_slot").sortWithinPartitions("group_id", "_slot")
    shape = "group_id string, item_id long, significance double, mean_rank double, group_size long"
    shape = shape.replace("group_id string", f"group_id {rows.schema['group_id'].dataType.simpleString()}")
    small = by_slot(placed.filter("_slots = 1")).mapInArrow(_rank_groups(names, False), shape)
    if not hot_groups.isEmpty():
        hot = by_slot(placed.filter("_slots > 1")).mapInArrow(_rank_groups(names, True), placed.schema).select("group_id", "item_id", *names)
        small = small.unionByName(_rank_hot(hot, names).select("group_id", "item_id", "significance", "mean_rank", "group_size"))
    return small.withColumnsRenamed({"group_id": group, "item_id": item})


def first_of_group(ranked: DataFrame, group: str, item: str) -> DataFrame:
    """The most significant item of every group; equal ones by mean rank, then by the smaller identifier."""
    best = F.min(F.struct(F.round("significance", 12).alias("a"), F.round("mean_rank", 6).alias("b"), F.col(item).alias("c"))).alias("best")
    return ranked.groupBy(group).agg(best).select(group, F.col("best.c").alias(item))
