import datetime
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from loam.llm import rankagg, topn

T0 = datetime.datetime(2025, 1, 1)


def rows_of(seed: int, n: int = 900):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        q = "hot" if i % 3 == 0 else f"q{rng.randint(0, 60)}"
        val = lambda p: None if rng.random() < p else rng.choice([0.0, -0.0, 0.25, 0.5, 1.0, -2.0, float("nan")])
        out.append((q, rng.randint(-300, 300), val(0.2), val(0.1), T0 + datetime.timedelta(seconds=rng.randint(0, 5)) if rng.random() < 0.9 else None))
    return out + out[:40] + [(None, 1, 0.5, 0.5, T0), ("q1", None, 0.5, 0.5, T0)]


SCHEMA = "query_id string, chunk_id long, score double, tie double, at timestamp"


def clean(x):
    return None if x is None or x != x else x + 0.0


def current(df):
    version = F.coalesce(F.unix_micros("at"), F.lit(-(2**63)))
    rows = df.filter("query_id IS NOT NULL AND chunk_id IS NOT NULL").select("*", version.alias("v"), F.xxhash64(F.coalesce("score", F.lit(float("nan"))), F.coalesce("tie", F.lit(float("nan")))).alias("h")).collect()
    best = {}
    for r in rows:
        k = (r.query_id, r.chunk_id)
        if k not in best or (r.v, r.h) > (best[k].v, best[k].h):
            best[k] = r
    return best


def test_top_n_equals_brute_force(spark):
    df = spark.createDataFrame(rows_of(1), SCHEMA).withColumn("group_id", F.lit("clash")).withColumn("_slot", F.lit(7))
    groups = defaultdict(list)
    for (q, c), r in current(df).items():
        s, t = clean(r.score), clean(r.tie)
        groups[q].append((s is None, -(s or 0), t is None, -(t or 0), c))
    for slots in (10_000, 40):
        got = defaultdict(list)
        for r in topn.top_n(df, "query_id", "chunk_id", "score", "tie", "at", 5, slots).collect():
            got[r.query_id].append(r.chunk_id)
        assert {q: sorted(x[-1] for x in sorted(v)[:5]) for q, v in groups.items()} == {q: sorted(v) for q, v in got.items()}


def test_bisection_on_equal_codes():
    group = np.zeros(10, np.int64)
    codes = [np.full(10, 7, np.uint64), np.array([1, 1, 2, 2, 2, 3, 3, 3, 3, 0], np.uint64), np.arange(10, dtype=np.uint64)]
    assert topn.bisect_top(group, codes, 3).nonzero()[0].tolist() == [6, 7, 8] and topn.bisect_top(group, codes, 20).all()
    values = np.array([-np.inf, -1.5, -0.0, 0.0, 2.0, np.inf])
    assert (np.diff(topn.order_code(values).astype(object)) >= 0).all() and topn.order_code(np.array([np.nan]))[0] == 0


def test_hot_groups_rank_like_small_ones(spark, monkeypatch):
    df = spark.createDataFrame(rows_of(2), SCHEMA).withColumn("third", F.col("chunk_id") % 7).withColumn("item_id", F.lit(1))
    scores = [F.col("score"), F.col("tie"), F.col("third")]
    small = {(r.query_id, r.chunk_id): (round(r.significance, 9), round(r.mean_rank, 9), r.group_size) for r in rankagg.aggregate_ranks(df, "query_id", "chunk_id", scores, "at").collect()}
    spread = {(r.query_id, r.chunk_id): (round(r.significance, 9), round(r.mean_rank, 9), r.group_size) for r in rankagg.aggregate_ranks(df, "query_id", "chunk_id", scores, "at", 50).collect()}
    assert small == spread and len(small) == len(current(df))
    monkeypatch.setattr(rankagg, "COMMON_VALUE", 20)
    common = {(r.query_id, r.chunk_id): (round(r.significance, 9), round(r.mean_rank, 9), r.group_size) for r in rankagg.aggregate_ranks(df, "query_id", "chunk_id", scores, "at", 50).collect()}
    assert small == common


def test_ranges_do_not_matter_and_empty_input(spark):
    rows = [("q", i, float(i), 1000.0 * i, T0) for i in range(6)]
    df = spark.createDataFrame(rows, SCHEMA)
    ranked = rankagg.aggregate_ranks(df, "query_id", "chunk_id", [F.col("score"), F.col("tie")], "at")
    assert rankagg.first_of_group(ranked, "query_id", "chunk_id").first().chunk_id == 5
    assert rankagg.aggregate_ranks(df.limit(0), "query_id", "chunk_id", [F.col("score")], "at").count() == 0
    assert topn.top_n(df.limit(0), "query_id", "chunk_id", "score", "tie", "at", 5).count() == 0
    assert rankagg.mean_ranks(np.array([0, 0, 0, 1]), np.array([1.0, 3.0, 1.0, 9.0])).tolist() == [2.5, 1.0, 2.5, 1.0]
