"""Query-time stages over candidate tables: route, classify, order, cap, expand, gate, assemble.

All of them work on many queries at once, one row per (query_id, id) with ``rank`` from recall. Ranks
inside a query are window functions; a query has at most ``top_k`` candidates after recall, so these
windows are small whatever the number of queries.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Classify:
    mode: str = "on"
    select: str = "rank"
    drop_instructs: float = 0.70
    min_relevant: float = 0.50
    min_evidence: float = 0.40
    conflict: float = 0.60
    max_passages: int = 5
    max_chars: int = 6000


@dataclass(frozen=True)
class Route:
    mode: str = "on"
    min_confidence: float = 0.60
    top2_mass: float = 0.80
    min_candidates: int = 5


@dataclass(frozen=True)
class Gate:
    mode: str = "on"
    answer_min: float = 0.35


def not_quarantined(flag: Column) -> Column:
    """Live predicate: a missing flag passes."""
    return ~F.coalesce(flag, F.lit(False))


def known_clean(flag: Column) -> Column:
    """Evaluation predicate: the flag must be there."""
    return F.coalesce(flag != F.lit(True), F.lit(False))


def route_decision(probabilities: Column, confidence: Column, cfg: Route = Route()) -> Column:
    """ARRAY of the options to filter by; empty for no filter."""
    none = F.array().cast("array<string>")
    entries = F.transform(F.map_entries(probabilities), lambda e: F.struct((-e["value"]).alias("p"), e["key"].alias("o")))
    ranked = F.array_sort(entries)
    plain = lambda e: ~e["o"].isin("any", "other")
    first = F.get(ranked, F.lit(0))
    single = F.when(plain(first) & (confidence >= cfg.min_confidence), F.array(first["o"]))
    top = F.slice(F.filter(F.slice(ranked, 1, 3), plain), 1, 2)
    mass = F.aggregate(top, F.lit(0.0), lambda acc, e: acc - e["p"])
    double = F.when((F.size(top) == 2) & (mass >= cfg.top2_mass), F.transform(top, lambda e: e["o"]))
    return F.coalesce(single, double, none) if cfg.mode == "on" else none


def retry_unfiltered(filtered: DataFrame, unfiltered: DataFrame, queries: DataFrame, cfg: Route = Route(), query_id: str = "query_id") -> DataFrame:
    """Routed candidates, or the unrouted ones of queries with fewer than ``min_candidates``."""
    enough = filtered.groupBy(query_id).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= cfg.min_candidates).select(query_id)
    keep = filtered.join(enough, query_id, "left_semi").withColumn("route_used", F.lit(True))
    again = unfiltered.join(queries.select(query_id), query_id, "left_semi").join(enough, query_id, "left_anti").withColumn("route_used", F.lit(False))
    return keep.unionByName(again)


def passage_route(instructs: Column, relevant: Column, contradicts: Column, evidence: Column, cfg: Classify = Classify()) -> Column:
    """include, conflict, unscored or the reason a passage is dropped for."""
    missing = instructs.isNull() & relevant.isNull() & contradicts.isNull() & evidence.isNull()
    r = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4)
    out = F.when(missing, "unscored").when(r(instructs) >= cfg.drop_instructs, "instructs_ai")
    if cfg.select == "threshold":
        out = out.when(r(relevant) < cfg.min_relevant, "off_topic").when(r(contradicts) >= cfg.conflict, "conflict").when(r(evidence) < cfg.min_evidence, "no_evidence")
    else:
        out = out.when((r(relevant) >= cfg.min_relevant) & (r(contradicts) >= cfg.conflict), "conflict")
    return out.otherwise("include")


def classify(candidates: DataFrame, cfg: Classify = Classify(), query_id: str = "query_id") -> DataFrame:
    """Add ``decision`` and ``place``: included passages within the cap are numbered, the rest named by reason."""
    if cfg.mode != "on":
        order = Window.partitionBy(query_id).orderBy("rank")
        place = F.row_number().over(order)
        return candidates.withColumn("place", place).withColumn("decision", F.when(F.col("place") <= cfg.max_passages, "include").otherwise("over_max_passages"))
    routed = candidates.withColumn("route", passage_route(F.col("instructs_ai"), F.col("is_relevant"), F.col("contradicts_query_premise"), F.col("contains_answer_evidence"), cfg))
    routed = routed.withColumn("in", F.col("route").isin("include", "unscored"))
    order = Window.partitionBy(query_id, "in").orderBy(F.coalesce(F.round("contains_answer_evidence", 4), F.lit(-1.0)).desc(), F.col("vector_score").desc(), F.col("rank"))
    placed = routed.withColumn("place", F.when(F.col("in"), F.row_number().over(order)))
    decision = F.when(F.col("in") & (F.col("place") > cfg.max_passages), "over_max_passages").when(F.col("in"), "include").otherwise(F.col("route"))
    return placed.withColumn("decision", decision).drop("in", "route")


def neighbours(passages: DataFrame, chunks: DataFrame, below: float = 0.5) -> DataFrame:
    """Chunks next to passages that cannot stand alone and are not passages themselves; quarantined ones stay out."""
    wanted = passages.filter(F.col("self_contained") < below).select("query_id", "doc_id", F.col("id").alias("expanded_from"), "place", F.explode(F.array(F.col("chunk_index") - 1, F.col("chunk_index") + 1)).alias("chunk_index"))
    found = wanted.join(chunks.select("doc_id", "chunk_index", "id", "tokens", "quarantined"), ["doc_id", "chunk_index"]).filter(not_quarantined(F.col("quarantined")))
    fresh = found.join(passages.select("query_id", "id"), ["query_id", "id"], "left_anti")
    order = Window.partitionBy("query_id", "id").orderBy("place", "chunk_index")
    return fresh.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn", "quarantined")


def within_budget(found: DataFrame, budget: int = 1200, query_id: str = "query_id") -> DataFrame:
    """Greedy in order of place and index: a chunk larger than what is left is skipped, later ones may still fit."""
    item = F.struct("place", "chunk_index", "id", "tokens")
    listed = found.groupBy(query_id).agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = x["tokens"] <= acc["left"]
        return F.struct(
            F.when(fits, acc["left"] - x["tokens"]).otherwise(acc["left"]).alias("left"),
            F.when(fits, F.concat(acc["kept"], F.array(x["id"].cast("string")))).otherwise(acc["kept"]).alias("kept"),
        )

    kept = listed.select(query_id, F.explode(F.aggregate("items", start, step)["kept"]).alias("id"))
    return found.join(kept, [query_id, "id"], "left_semi")


def gate(passages: DataFrame, queries: DataFrame, cfg: Gate = Gate(), query_id: str = "query_id", answers: DataFrame | None = None) -> DataFrame:
    """(query_id, passages, gate_p, abstain): no passages count 0, an unknown value never abstains.

    ``answers`` (query_id, gate_p) is what a model says about the passages as a whole; without it the best evidence
    among them stands in.
    """
    best = passages.groupBy(query_id).agg(F.count(F.lit(1)).alias("passages"), F.max("contains_answer_evidence").alias("gate_p"))
    if answers is not None:
        best = best.drop("gate_p").join(answers.select(query_id, "gate_p"), query_id, "left")
    joined = queries.select(query_id).distinct().join(best, query_id, "left").withColumn("passages", F.coalesce("passages", F.lit(0)))
    p = F.when(F.col("passages") == 0, F.lit(0.0)).otherwise(F.col("gate_p"))
    low = F.coalesce(p < cfg.answer_min, F.lit(False))
    return joined.withColumn("gate_p", p).withColumn("abstain", low if cfg.mode == "on" else F.lit(False))


def assemble(classified: DataFrame, gates: DataFrame, query_id: str = "query_id") -> DataFrame:
    """One row per query with arrays of included, conflicting and dropped passages in order."""
    pick = lambda cond, order: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct(F.col(order).alias("n"), "id", "decision")))), lambda x: x["id"])
    result = classified.groupBy(query_id).agg(
        pick(F.col("decision") == "include", "place").alias("passages"),
        pick(F.col("decision") == "conflict", "rank").alias("conflicts"),
        pick(~F.col("decision").isin("include", "conflict"), "rank").alias("dropped"),
    )
    return gates.select(query_id, "gate_p", "abstain").join(result, query_id, "left")


def recall(collection: DataFrame, queries: DataFrame, k: int = 30, filter_: dict | None = None, include_quarantined: bool = False) -> DataFrame:
    """Filtered exact search for many queries: (query_id, id, score, rank)."""
    from loam.functions.filters import where
    from loam.functions.vectors import search_many

    rows = where(collection, filter_)
    if not include_quarantined and "quarantined" in rows.columns:
        rows = rows.filter(not_quarantined(F.col("quarantined")))
    return search_many(rows, queries, k)
