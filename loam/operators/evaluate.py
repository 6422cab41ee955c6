"""Offline evaluation of ranking systems on recorded candidates.

Inputs are tables: ``ranked`` (query_id, rank, unit ...) and ``qrels`` (query_id, unit, gain). Every
metric is an aggregation per query over at most k rows each, then one over queries.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.text import evidence_form

GRAM = 5
LEAST_GRAMS = 0.6


#: Quotations that travel with the tasks together; more are taken in blocks of this size.
QUOTATION_BLOCK = 20_000


class _Quotations:
    """A block of quotations in evidence form, with the five-word sequences of each."""

    def __init__(self, forms: list[str]) -> None:
        self.forms = forms
        self.of_gram: dict[str, list[int]] = {}
        self.grams = []
        for i, form in enumerate(forms):
            grams = grams_of(form)
            self.grams.append(len(grams))
            for g in grams:
                self.of_gram.setdefault(g, []).append(i)

    def finder(self) -> Callable[[str], Iterator[int]]:
        """Tells which quotations a text contains."""
        try:
            import ahocorasick
        except ImportError:
            return lambda text: (i for i, form in enumerate(self.forms) if form in text)
        found = ahocorasick.Automaton()
        for i, form in enumerate(self.forms):
            found.add_word(form, i)
        found.make_automaton()
        return lambda text: (i for _, i in found.iter(text))

    def matches(self, form: str, contained: Callable[[str], Iterator[int]]) -> set[int]:
        hits = Counter(i for g in grams_of(form) for i in self.of_gram.get(g, ()))
        return set(contained(form)) | {i for i, n in hits.items() if n >= LEAST_GRAMS * self.grams[i]}


def grams_of(form: str, n: int = GRAM) -> set[str]:
    """Distinct sequences of ``n`` words."""
    words = form.split()
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


def evidence_match(evidence: DataFrame, passages: DataFrame, evidence_id: str, passage_id: str) -> DataFrame:
    """(evidence_id, passage_id): the passage contains the quotation, or 60 % of its distinct five-word sequences.

    Containment is that of evidence forms, without regard to where words begin. Quotations are a stated set:
    they travel in blocks of ``QUOTATION_BLOCK`` distinct forms, passages are mapped and never shuffled, and only
    hits leave the tasks. Inputs have a ``text`` column; empty quotations match nothing.
    """
    spark = evidence.sparkSession
    e = evidence.select(evidence_id, evidence_form(F.col("text")).alias("e_form")).filter("e_form <> ''")
    p = passages.filter("text IS NOT NULL").select(passage_id, evidence_form(F.col("text")).alias("p_form"))
    forms = [r.e_form for r in e.select("e_form").distinct().orderBy("e_form").collect()]
    shape = f"{passage_id} {p.schema[passage_id].dataType.simpleString()}, e_form string"
    found = spark.createDataFrame([], shape)
    for start in range(0, len(forms), QUOTATION_BLOCK):
        block = _Quotations(forms[start : start + QUOTATION_BLOCK])

        def run(batches: Iterator[pa.RecordBatch], block: _Quotations = block) -> Iterator[pa.RecordBatch]:
            contained = block.finder()
            for batch in batches:
                picks, hits = [], []
                for row, form in enumerate(batch.column("p_form").to_pylist()):
                    for i in block.matches(form, contained):
                        picks.append(row)
                        hits.append(block.forms[i])
                yield pa.record_batch([batch.column(passage_id).take(pa.array(picks, pa.int64())), pa.array(hits, pa.string())], names=[passage_id, "e_form"])

        found = found.unionByName(p.mapInArrow(run, shape))
    return found.join(e, "e_form").select(evidence_id, passage_id).distinct()


def query_metrics(ranked: DataFrame, qrels: DataFrame, k: int = 10, returned: DataFrame | None = None) -> DataFrame:
    """Per labelled query: recall, any_hit, hit_at_1, mrr and ndcg at ``k``.

    A unit counts once, at its first place; gains are discounted by log2(rank + 1); nDCG is at most 1.
    ``ranked`` has one row per (query_id, rank, unit); queries without any row score 0.
    """
    hits = ranked.filter(F.col("rank") <= k).join(qrels, ["query_id", "unit"]).groupBy("query_id", "unit").agg(F.min("rank").alias("rank"), F.max("gain").alias("gain"))
    got = hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("seen"), F.min("rank").alias("first"), F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("dcg")
    )
    ideal_order = Window.partitionBy("query_id").orderBy(F.desc("gain"), "unit")
    ideal = qrels.withColumn("i", F.row_number().over(ideal_order))
    ideal = ideal.groupBy("query_id").agg(F.count(F.lit(1)).alias("units"), F.sum(F.when(F.col("i") <= k, F.col("gain") / F.log2(F.col("i") + 1))).alias("idcg"))
    j = ideal.join(got, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return j.select(
        "query_id",
        zero(F.col("seen") / F.col("units")).alias("recall"),
        F.when(F.col("seen") > 0, 1.0).otherwise(0.0).alias("any_hit"),
        F.when(F.col("first") == 1, 1.0).otherwise(0.0).alias("hit_at_1"),
        zero(1 / F.col("first")).alias("mrr"),
        F.when(F.col("idcg") > 0, F.least(zero(F.col("dcg") / F.col("idcg")), F.lit(1.0))).otherwise(0.0).alias("ndcg"),
    )


def summarise(per_query: DataFrame, by: list[str]) -> DataFrame:
    """Means to four places per system: metrics over answerable queries, abstentions by kind."""
    mean = lambda c, cond: F.round(F.avg(F.when(cond, F.col(c).cast("double"))), 4)
    yes, no = F.col("answerable"), ~F.col("answerable")
    metrics = [mean(c, yes).alias(c) for c in ("recall", "any_hit", "hit_at_1", "mrr", "ndcg")]
    return per_query.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *metrics,
        F.round(F.avg("returned"), 4).alias("returned"),
        F.round(F.avg("tokens"), 4).alias("tokens"),
        mean("abstain", yes).alias("false_abstain"),
        mean("abstain", no).alias("true_abstain"),
    )


def bars(token_cut: Column, recall_drop: Column) -> Column:
    """Does a system cut the tokens by 40 % and lose at most two points of recall?"""
    return (token_cut >= 0.40) & (recall_drop <= 0.02)


def nearest_rank(values: Column, q: float) -> Column:
    """The value at position floor(q n) of the sorted values, the last one at most."""
    ordered = F.sort_array(values)
    n = F.size(ordered)
    return F.when(n > 0, F.get(ordered, F.least(F.floor(F.lit(q) * n).cast("int"), n - 1)))


def nearest_rank_by(df: DataFrame, by: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Nearest-rank quantiles of unbounded groups: counts of distinct values, never a list of them."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy(*by).orderBy(value)
    run = counted.withColumn("upto", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    out = []
    for name, q in quantiles.items():
        place = F.least(F.floor(F.lit(q) * F.col("n")), F.col("n") - 1)
        out.append(F.min(F.when(F.col("upto") > place, F.col(value))).alias(name))
    return run.groupBy(*by).agg(F.max("n").alias("n"), *out)


def paired_bootstrap(differences: list[float], resamples: int = 2000, seed: int = 0) -> dict[str, float]:
    """Mean difference with a 95 % interval from resampled means; the differences are one number per query."""
    if not differences:
        return {"delta": 0.0, "lo": 0.0, "hi": 0.0, "n": 0}
    rng = random.Random(seed)
    n = len(differences)
    means = sorted(sum(rng.choice(differences) for _ in range(n)) / n for _ in range(resamples))
    return {"delta": round(sum(differences) / n, 4), "lo": round(means[int(0.025 * resamples)], 4), "hi": round(means[int(0.975 * resamples)], 4), "n": n}


def bootstrap_table(differences: DataFrame, resamples: int = 2000, seed: int = 0) -> DataFrame:
    """Distributed form: one Poisson-weighted mean per resample, then nearest-rank bounds.

    Each task weighs its own rows for every resample and ships sums only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        total, weight = np.zeros(resamples), np.zeros(resamples)
        for batch in batches:
            for key, diff in zip(batch.column("key").to_pylist(), batch.column("diff").to_pylist(), strict=True):
                w = np.random.default_rng([seed, key & 0xFFFFFFFF, key >> 32 & 0xFFFFFFFF]).poisson(1.0, resamples)
                total += w * diff
                weight += w
        yield pa.record_batch([pa.array(range(resamples), pa.int64()), pa.array(total), pa.array(weight)], names=["resample", "total", "weight"])

    rows = differences.select(F.xxhash64("query_id").alias("key"), F.col("diff").cast("double").alias("diff")).filter("diff IS NOT NULL")
    means = rows.mapInArrow(run, "resample long, total double, weight double").groupBy("resample").agg((F.sum("total") / F.sum("weight")).alias("m"))
    bounds = means.filter("m IS NOT NULL").agg(F.collect_list("m").alias("ms"))
    return bounds.select(F.round(nearest_rank(F.col("ms"), 0.025), 4).alias("lo"), F.round(nearest_rank(F.col("ms"), 0.975), 4).alias("hi"))


def longest_common_share(evidence: str, passage: str) -> float:
    """Longest contiguous match of a quotation in a passage, as a share of the quotation."""
    from difflib import SequenceMatcher

    if not evidence:
        return 0.0
    return SequenceMatcher(None, evidence, passage, autojunk=False).find_longest_match().size / len(evidence)


# ---------------------------------------------------------------- choosing thresholds

# The grid that is searched.
MIN_RELEVANT = (0.2, 0.35, 0.5, 0.65)
MIN_EVIDENCE = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6)
MAX_PASSAGES = (3, 5, 8, 10)


def threshold_grid(candidates: DataFrame, qrels: DataFrame, queries: DataFrame, k: int = 10, baseline: int = 8, drop: float = 0.02, conflict: float = 0.6, instructs: float = 0.7) -> DataFrame:
    """Every setting of the grid with (recall, tokens, ndcg, floor, ok) over ``queries`` (query_id, answerable).

    Candidates are ranked once per least relevance: those above a least evidence are the first of that order, so
    the other two settings are conditions on place and evidence. ``floor`` is the recall of the first ``baseline``
    candidates by vector less ``drop``. Recall and nDCG are means over answerable queries, tokens over all.
    """
    r = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4)
    gains = qrels.select("query_id", F.col("unit").alias("id"), "gain")
    rows = candidates.join(gains, ["query_id", "id"], "left")
    scored = F.coalesce("is_relevant", "contains_answer_evidence", "contradicts_query_premise", "instructs_ai").isNotNull()
    usable = ~scored | ((r(F.col("instructs_ai")) < instructs) & (r(F.col("contradicts_query_premise")) < conflict))
    each = rows.withColumn("min_relevant", F.explode(F.array(*[F.lit(x) for x in MIN_RELEVANT]))).filter(usable & (~scored | (r(F.col("is_relevant")) >= F.col("min_relevant"))))
    order = Window.partitionBy("query_id", "min_relevant").orderBy(F.coalesce(F.round("contains_answer_evidence", 4), F.lit(-1.0)).desc(), F.col("vector_score").desc_nulls_last(), "rank")
    each = each.withColumns({"place": F.row_number().over(order), "evidence": F.when(scored, r(F.col("contains_answer_evidence")))})
    cells = [(e, n) for e in MIN_EVIDENCE for n in MAX_PASSAGES]
    sums = []
    for i, (e, n) in enumerate(cells):
        taken = (F.col("place") <= n) & F.coalesce(F.col("evidence") >= e, F.lit(True))
        hit = taken & (F.col("place") <= k) & F.col("gain").isNotNull()
        sums += [F.count(F.when(hit, 1)).alias(f"h{i}"), F.sum(F.when(taken, F.col("tokens"))).alias(f"t{i}"), F.sum(F.when(hit, F.col("gain") / F.log2(F.col("place") + 1))).alias(f"d{i}")]
    per = each.groupBy("query_id", "min_relevant").agg(*sums)
    ideal_order = Window.partitionBy("query_id").orderBy(F.desc("gain"), "unit")
    ideal = qrels.withColumn("i", F.row_number().over(ideal_order)).groupBy("query_id").agg(F.count(F.lit(1)).alias("units"), F.sum(F.when(F.col("i") <= k, F.col("gain") / F.log2(F.col("i") + 1))).alias("idcg"))
    known = queries.select("query_id", "answerable").join(ideal, "query_id", "left")
    first = rows.filter(F.col("rank") <= baseline).groupBy("query_id").agg(F.count("gain").alias("hits"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    yes = F.col("answerable")
    floor = known.join(first, "query_id", "left").agg((F.round(zero(F.avg(F.when(yes, zero(F.col("hits") / F.col("units"))))), 4) - drop).alias("floor"))
    full = known.withColumn("min_relevant", F.explode(F.array(*[F.lit(x) for x in MIN_RELEVANT]))).join(per, ["query_id", "min_relevant"], "left")
    means = []
    for i in range(len(cells)):
        means += [
            F.round(F.avg(F.when(yes, zero(F.col(f"h{i}") / F.col("units")))), 4).alias(f"h{i}"),
            F.round(F.avg(F.coalesce(f"t{i}", F.lit(0))), 4).alias(f"t{i}"),
            F.round(F.avg(F.when(yes, F.when(F.col("idcg") > 0, F.least(zero(F.col(f"d{i}") / F.col("idcg")), F.lit(1.0))).otherwise(0.0))), 4).alias(f"d{i}"),
        ]
    listed = [F.struct(F.lit(e).alias("min_evidence"), F.lit(n).alias("max_passages"), F.col(f"h{i}").alias("recall"), F.col(f"t{i}").alias("tokens"), F.col(f"d{i}").alias("ndcg")) for i, (e, n) in enumerate(cells)]
    grid = full.groupBy("min_relevant").agg(*means).select("min_relevant", F.inline(F.array(*listed)))
    return grid.join(F.broadcast(floor)).withColumn("ok", zero(F.col("recall")) >= F.col("floor"))


def best_thresholds(grid: DataFrame) -> DataFrame:
    """The allowed setting with the fewest tokens, of equal ones that with the higher nDCG, then the first of the grid; no row if none is allowed."""
    return grid.filter("ok").orderBy("tokens", F.desc("ndcg"), "min_relevant", "min_evidence", "max_passages").limit(1)


def best_gate(curve: DataFrame, most_false: float = 0.05) -> DataFrame:
    """Of a curve (threshold, false_abstain, true_abstain) the point with most right abstentions among those with few wrong ones."""
    return curve.filter(F.col("false_abstain") <= most_false).orderBy(F.desc("true_abstain"), "false_abstain", "threshold").limit(1)


def query_units(ranked: DataFrame, qrels: DataFrame, matches: DataFrame | None = None, level: str = "doc") -> DataFrame:
    """(query_id, rank, unit, gain): the labelled units that ranked passages hold.

    By document ``ranked`` (query_id, rank, doc_id) is matched with ``qrels`` of documents; by evidence with
    ``matches`` (query_id, unit, id) of passages that contain a quotation, each with gain 1.
    """
    if level == "doc":
        return ranked.join(qrels.filter("gain > 0").withColumnRenamed("unit", "doc_id"), ["query_id", "doc_id"]).select("query_id", "rank", F.col("doc_id").alias("unit"), "gain")
    if matches is None:
        raise ValueError("evidence needs the passages that match it")
    return ranked.join(matches, ["query_id", "id"]).select("query_id", "rank", "unit", F.lit(1).alias("gain"))
