"""Top N rows of every group by simultaneous per-group bisection.

A row's rank inside its group is decided by an order-preserving code: the score, then the
tie score, then the complement of the identifier, each mapped to an unsigned 64-bit integer
whose order is the wanted one. All groups are bisected at once: each keeps an interval of
codes, every step counts the rows above the midpoints, and a group is finished when exactly
N rows lie above its cutoff. The identifier is part of the code, so a cutoff that holds
exactly N always exists.

Distribution. A group normally lives in one task. A group above ``ROWS_PER_SLOT`` rows is
spread over several tasks by the hash of its identifier; each finds its own N, and a second
bisection over those few survivors finishes the group. Repeated recordings of an identifier
meet in the same task, so superseding needs no shuffle of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.plans.runtime import hot_keys, place

#: Most rows of one group that one task handles at a time.
ROWS_PER_SLOT = 50_000

_TOP = np.uint64(1 << 63)


def order_code(values: np.ndarray) -> np.ndarray:
    """Map doubles to uint64 so that codes order like the numbers; NaN (missing) gets 0, below everything."""
    values = np.where(values == 0.0, 0.0, values)
    bits = values.view(np.uint64)
    code = np.where(bits & _TOP, ~bits, bits | _TOP)
    return np.where(np.isnan(values), np.uint64(0), code)


def _cutoff(group: np.ndarray, code: np.ndarray, need: np.ndarray) -> np.ndarray:
    """For each group the largest code c with at least ``need`` rows >= c (0 where there are fewer rows)."""
    groups = len(need)
    hi = np.zeros(groups, np.uint64)
    np.maximum.at(hi, group, code)
    lo = np.full(groups, np.iinfo(np.uint64).max)
    np.minimum.at(lo, group, code)
    live = np.ones(len(code), bool)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = lo + (hi - lo) // np.uint64(2) + np.uint64(1)
        live &= open_[group]
        rows, g = code[live], group[live]
        above = np.bincount(g[rows >= mid[g]], minlength=groups)
        enough = above >= need
        lo = np.where(open_ & enough, mid, lo)
        hi = np.where(open_ & ~enough, mid - np.uint64(1), hi)


def bisect_top(group: np.ndarray, codes: list[np.ndarray], n: int) -> np.ndarray:
    """Mask of the ``n`` highest rows of each group (all of a smaller group) by lexicographic ``codes``.

    The first component is bisected for all groups; rows above the cutoff are in, and the places
    left are decided among the rows equal to it by the next component.
    """
    chosen = np.zeros(len(group), bool)
    size = np.bincount(group)
    chosen |= size[group] <= n
    rest = np.flatnonzero(~chosen)
    need_by_group = np.full(len(size), n, np.int64)
    for code in codes:
        if not len(rest):
            break
        ids, g = np.unique(group[rest], return_inverse=True)
        c = code[rest]
        cut = _cutoff(g, c, need_by_group[ids])
        over, equal = c > cut[g], c == cut[g]
        chosen[rest[over]] = True
        need_by_group[ids] -= np.bincount(g[over], minlength=len(ids))
        fits = np.bincount(g[equal], minlength=len(ids)) == need_by_group[ids]
        chosen[rest[equal & fits[g]]] = True
        rest = rest[equal & ~fits[g]]
    return chosen


def complete_groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Re-cut a stream sorted by ``key`` so that no group straddles two tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        n = batch.num_rows
        last = [batch.column(k)[n - 1] for k in key]
        same = np.ones(n, bool)
        for k, value in zip(key, last, strict=True):
            column = batch.column(k)
            if value.as_py() is None:
                same &= column.is_null().to_numpy(zero_copy_only=False)
            else:
                same &= pc.fill_null(pc.equal(column, value), False).to_numpy(zero_copy_only=False)
        first = int(np.argmax(same))
        if first:
            yield pa.Table.from_batches([*held, batch.slice(0, first)])
            held = [batch.slice(first)]
        elif held and not all(held[-1].column(k)[0].equals(batch.column(k)[0]) for k in key):
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def group_numbers(table: pa.Table, key: list[str]) -> np.ndarray:
    """Dense group numbers of a table whose equal keys are adjacent."""
    change = np.zeros(table.num_rows, bool)
    for k in key:
        codes = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(change)


def current_rows(group: np.ndarray, ident: np.ndarray, when: list[np.ndarray]) -> np.ndarray:
    """Positions of the latest row of every (group, ident); ``when`` orders from most to least significant."""
    order = np.lexsort([*reversed(when), ident, group])
    g, i = group[order], ident[order]
    last = np.ones(len(order), bool)
    last[:-1] = (g[1:] != g[:-1]) | (i[1:] != i[:-1])
    return order[last]


def _selector(n: int, dedup: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in complete_groups(batches, ["group_id", "_slot"]):
            group = group_numbers(part, ["group_id", "_slot"])
            get = lambda c: part.column(c).to_numpy()  # noqa: E731, B023
            ident = get("item_id")
            if dedup:
                keep = current_rows(group, ident, [get("version"), get("tiebreak")])
            else:
                keep = np.arange(len(group))
            codes = [order_code(np.ascontiguousarray(get(c), np.float64)[keep]) for c in ("score", "tie_score")]
            codes.append(~(ident[keep].view(np.uint64) ^ _TOP))
            take = keep[bisect_top(np.unique(group[keep], return_inverse=True)[1], codes, n)]
            yield from part.take(pa.array(np.sort(take))).to_batches()

    return run


def top_n(df: DataFrame, group: str, item: str, score: str, tie_score: str, version: str, n: int, rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """The ``n`` best current rows of every group: (group, item, score, tie_score).

    ``item`` is a BIGINT identifier. Of several rows of one (group, item) the one with the
    greatest ``version`` (timestamp; missing is earliest) counts; equal versions are decided by a
    hash of the values, so the result does not depend on row order. A missing or NaN score comes
    after every value; equal scores go to the higher ``tie_score``, then to the smaller
    identifier. Rows whose group or item is null are left out; an empty input gives an empty
    result; other columns of the input, whatever their names, are ignored.
    """
    rows = df.filter(F.col(group).isNotNull() & F.col(item).isNotNull()).select(
        F.col(group).alias("group_id"),
        F.col(item).cast("long").alias("item_id"),
        F.coalesce(F.col(score).cast("double"), F.lit(float("nan"))).alias("score"),
        F.coalesce(F.col(tie_score).cast("double"), F.lit(float("nan"))).alias("tie_score"),
        F.coalesce(F.unix_micros(F.col(version).cast("timestamp")), F.lit(-(2**63))).alias("version"),
    )
    rows = rows.withColumn("tiebreak", F.xxhash64("score", "tie_score"))
    hot = hot_keys(rows, "group_id", rows_per_slot)
    placed = place(rows, hot, "group_id", "item_id")
    # rows of ordinary and of hot groups go through exchanges of their own, each row through one
    by_slot = lambda part: part.repartition("group_id", "_slot").sortWithinPartitions("group_id", "_slot").mapInArrow(_selector(n, True), placed.schema)
    best = by_slot(placed.filter("_slots = 1"))
    if not hot.isEmpty():
        survivors = by_slot(placed.filter("_slots > 1")).withColumn("_slot", F.lit(0))
        best = best.unionByName(survivors.repartition("group_id").sortWithinPartitions("group_id", "_slot").mapInArrow(_selector(n, False), placed.schema))
    clean = lambda c: F.when(~F.isnan(c), F.col(c))
    return best.select(F.col("group_id").alias(group), F.col("item_id").alias(item), clean("score").alias("score"), clean("tie_score").alias("tie_score"))
