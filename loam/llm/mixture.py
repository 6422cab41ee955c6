"""Mixing sources to target weights by entropy balancing.

Sizes are tokens of a public tokenizer. With base rate 1 for every document, the rates closest to it
in relative entropy that give each source its token target are exponentially tilted in the
document's length: rate = exp(lambda * tokens / mean tokens), never above the source's repeats. The
one multiplier per source is found by Newton steps on the convex dual. Where the dual has no
maximum, its multiplier grows until every document of the source is at its repeats: such a source
cannot reach its target, and that is how infeasible sources are found. The sums a step needs are
distributed aggregations over (source, length) counts; only the plan, a dozen rows, is on the driver.
Rates are then rounded to whole copies, the fraction being decided by a hash of the document, so
the result is reproducible and needs no ordering.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.tokens import with_tokens
from loam.plans.runtime import materialize

#: Rows a plan may have; it is held on the driver and broadcast.
MAX_PLAN = 10_000
MAX_STEPS = 200
TOLERANCE = 1e-9
#: What a multiplier may exceed the one that puts the shortest document at its repeats, so that rounding leaves none below.
BEYOND = 1.001


def source_key(column: str) -> Column:
    """Names that differ only in case or outer blanks are one source."""
    return F.lower(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""))


@dataclass
class Target:
    """One source of the plan and the state of its multiplier."""

    source: str
    key: str
    weight: float
    repeats: int
    tokens: int = 0
    docs: int = 0
    shortest: int = 0
    want: float = 0.0
    multiplier: float = 0.0
    low: float = -math.inf
    high: float = math.inf
    feasible: bool = True
    done: bool = False

    @property
    def mean(self) -> float:
        return self.tokens / self.docs if self.docs else 1.0


def _plan(plan: DataFrame) -> list[Target]:
    """Sources of the plan; rows of one source are one: their weights add up, the most repeats count."""
    rows = plan.filter("source IS NOT NULL").select("source", source_key("source").alias("key"), "target_weight", "max_repeats").limit(MAX_PLAN + 1).collect()
    if len(rows) > MAX_PLAN:
        raise ValueError(f"a plan has at most {MAX_PLAN} sources")
    out: dict[str, Target] = {}
    for r in sorted(rows, key=lambda r: r.source):
        one = out.setdefault(r.key, Target(r.source, r.key, 0.0, 0))
        one.weight += float(r.target_weight or 0.0)
        one.repeats = max(one.repeats, int(r.max_repeats or 0))
    return list(out.values())


def document_tokens(documents: DataFrame) -> DataFrame:
    """(doc_id, key, tokens) of every document; a missing source has a null key."""
    keyed = documents.withColumn("key", source_key("source"))
    return with_tokens(keyed, "text", ["doc_id", "key"])


def _lengths(tokens: DataFrame) -> DataFrame:
    """(key, tokens, n): how many documents of a source have a length. Written once; every step of the dual reads it."""
    return materialize(tokens.filter("tokens > 0").groupBy("key", "tokens").agg(F.count(F.lit(1)).alias("n")))


def _rate() -> Column:
    return F.when(F.col("cap") <= 0, 0.0).otherwise(F.least(F.exp(F.least(F.col("lam") * F.col("tokens") / F.col("mean"), F.lit(700.0))), F.col("cap")))


def solve(lengths: DataFrame, plan: DataFrame) -> list[Target]:
    """Multipliers of all sources at once, by Newton steps on the dual that are kept inside a bracket.

    The first step asks for the multiplier at which even the shortest document is at its repeats. A source
    that stays below its target there has an unbounded dual: it is infeasible and keeps that multiplier.
    """
    spark = lengths.sparkSession
    targets = _plan(plan)
    everything = int(lengths.agg(F.sum(F.col("tokens") * F.col("n"))).first()[0] or 0)
    known = lengths.filter(F.col("key").isin([t.key for t in targets])).groupBy("key").agg(F.sum(F.col("tokens") * F.col("n")).alias("t"), F.sum("n").alias("n"), F.min("tokens").alias("least"))
    stats = {r.key: r for r in known.collect()}
    for t in targets:
        t.want = t.weight * everything
        if found := stats.get(t.key):
            t.tokens, t.docs, t.shortest = int(found.t), int(found.n), int(found.least)
        if not t.docs or t.repeats <= 0:
            t.feasible, t.done = t.want <= 0, True
        else:
            t.multiplier = max(math.log(t.repeats), 1e-6) * t.mean / t.shortest * BEYOND
    for step in range(MAX_STEPS):
        active = [t for t in targets if not t.done]
        if not active:
            break
        current = F.broadcast(spark.createDataFrame([(t.key, t.multiplier, t.mean, float(t.repeats)) for t in active], "key string, lam double, mean double, cap double"))
        slope = F.when(_rate() < F.col("cap"), _rate() * F.col("tokens") / F.col("mean")).otherwise(0.0)
        sums = lengths.join(current, "key").groupBy("key").agg(F.sum(F.col("n") * F.col("tokens") * _rate()).alias("f"), F.sum(F.col("n") * F.col("tokens") * slope).alias("df"))
        reached = {r.key: r for r in sums.collect()}
        for t in active:
            gap = reached[t.key].f - t.want
            if step == 0 and gap < 0:
                t.feasible, t.done = False, True
                continue
            if abs(gap) <= TOLERANCE * max(t.want, 1.0):
                t.done = True
                continue
            t.low, t.high = (t.multiplier, t.high) if gap < 0 else (t.low, t.multiplier)
            newton = t.multiplier - gap / reached[t.key].df if reached[t.key].df > 0 else math.nan
            if not t.low < newton < t.high:
                newton = (t.low + t.high) / 2 if math.isfinite(t.low) else min(-1.0, 2 * t.high)
            t.done = abs(newton - t.multiplier) < 1e-13 or newton * t.shortest / t.mean < -700
            t.multiplier = newton
    return targets


def feasibility(documents: DataFrame, plan: DataFrame) -> DataFrame:
    """Per planned source: (source, tokens, target_tokens, max_repeats, multiplier, feasible), as the dual of the balancing finds them.

    The target is the weight times the tokens of all documents, planned or not. A source without
    documents has 0 tokens; null or empty texts count 0; missing weights or repeats are 0; an empty
    plan gives an empty result.
    """
    solved = solve(_lengths(document_tokens(documents)), plan)
    rows = [(t.source, t.tokens, t.want, t.repeats, t.multiplier, t.feasible) for t in solved]
    return documents.sparkSession.createDataFrame(rows, "source string, tokens long, target_tokens double, max_repeats int, multiplier double, feasible boolean")


def mix(documents: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(copies, shares) of the balanced mixture.

    ``copies``: (doc_id, source, tokens, copies) of every document of a planned source with at least
    one copy. ``shares``: (source, target_weight, max_repeats, tokens, mixed_tokens, share, feasible).
    A source that cannot reach its target takes every document ``max_repeats`` times; the shares
    reached are those of the mixture as it is. Documents without tokens take no copies.
    """
    spark = documents.sparkSession
    docs = materialize(document_tokens(documents).filter("doc_id IS NOT NULL"))
    solved = solve(_lengths(docs), plan)
    wanted = [(t.key, t.source, t.multiplier, t.mean, float(t.repeats if t.want > 0 else 0)) for t in solved]
    params = F.broadcast(spark.createDataFrame(wanted, "key string, source string, lam double, mean double, cap double"))
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    copies = (
        docs.filter("tokens > 0")
        .join(params, "key")
        .withColumn("rate", _rate())
        .withColumn("copies", (F.floor("rate") + F.when(F.col("rate") - F.floor("rate") > unit, 1).otherwise(0)).cast("int"))
        .filter("copies > 0")
        .select("doc_id", "source", "tokens", "copies")
    )
    reached = {r.source: r.m for r in copies.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("m")).collect()}
    total = sum(reached.values()) or 1
    share_rows = [(t.source, t.weight, t.repeats, t.tokens, int(reached.get(t.source, 0)), reached.get(t.source, 0) / total, t.feasible) for t in solved]
    shares = spark.createDataFrame(share_rows, "source string, target_weight double, max_repeats int, tokens long, mixed_tokens long, share double, feasible boolean")
    return copies, shares
