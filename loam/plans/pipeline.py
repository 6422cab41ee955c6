"""Ingest, retrieve and evaluate as one facade over the operators.

Scores come from a ``Scorer``: a function that adds score columns to a DataFrame. The rule scorer is the
default; a table of precomputed answers or the remote client fit the same place.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam import __version__
from loam.functions import text as tx
from loam.functions import vectors
from loam.functions.filters import Filter, conjunction
from loam.operators import chunking, collection, enrich, retrieval, screening
from loam.plans.config import Config
from loam.plans.runtime import materialize
from loam.sources import files

Scorer = Callable[[DataFrame], DataFrame]


def rule_scorer(chunks: DataFrame) -> DataFrame:
    return chunks.withColumns(enrich.rule_scores(F.col("text")))


def overlap_scorer(pairs: DataFrame) -> DataFrame:
    """Scores of (query_text, text) pairs by shared words."""
    share = enrich.overlap_score(F.col("query_text"), F.col("text"))
    return pairs.withColumns(
        {"is_relevant": share, "contains_answer_evidence": share, "contradicts_query_premise": F.lit(0.0), "instructs_ai": enrich.rule_scores(F.col("text"))["instructs_ai"]}
    )


class Pipeline:
    """A configured pipeline on a session; collections live under ``config.store``."""

    def __init__(self, spark: SparkSession, config: Config = Config(), scorer: Scorer = rule_scorer, query_scorer: Scorer = overlap_scorer, gap_costs: Scorer | None = None, router: Scorer | None = None) -> None:
        """``scorer`` judges chunks, ``query_scorer`` pairs; the defaults are rules that stand in for a model. ``router`` adds
        ``<field>_probabilities`` (MAP<STRING, DOUBLE>) to queries for every routable field of the taxonomy. ``gap_costs`` adds the column ``costs`` to documents (see ``chunking.chunk``); the method ``model`` needs it."""
        self.spark, self.config, self.scorer, self.query_scorer, self.gap_costs = spark, config, scorer, query_scorer, gap_costs
        if config.chunking.method == "model" and chunking.needs_costs(config.chunking) and gap_costs is None:
            raise ValueError("chunking method 'model' needs gap_costs, the model's answers about gaps")
        self.router = router
        self.routable = [f.name for f in config.taxonomy.fields if f.route]
        if self.routable and config.retrieve.route.mode != "off" and router is None:
            raise ValueError(f"the taxonomy routes by {self.routable}: Pipeline needs a router, or retrieve.route.mode off")
        self.embed = vectors.embedder(config.embedder)
        self.dim = int(config.embedder.partition(":")[2] or 256)

    def collection(self, name: str) -> collection.Collection:
        return collection.Collection(self.spark, self.config.store, tx_safe(name))

    def documents(self, sources: DataFrame | list[str]) -> DataFrame:
        """Given documents or the files below paths, with resolved ids and digests."""
        docs = files.read_documents(self.spark, *sources) if isinstance(sources, list) else sources
        for name in ("doc_id", "title", "source_uri", "format"):
            if name not in docs.columns:
                docs = docs.withColumn(name, F.lit(None).cast("string"))
        if "metadata" not in docs.columns:
            docs = docs.withColumn("metadata", F.lit(None).cast("map<string,string>"))
        docs = docs.filter("length(trim(text)) > 0")
        docs = docs.withColumn("doc_id", tx.resolved_id(F.col("doc_id").cast("string"), F.col("source_uri"), F.col("text")))
        docs = docs.withColumns({"format": F.coalesce("format", F.lit("markdown")), "doc_hash": tx.doc_hash(F.col("text"), F.col("title"))})
        return collection.latest(docs, ["doc_id"], ["doc_hash"])

    def _divided(self, documents: DataFrame) -> DataFrame:
        cfg = self.config.chunking
        if not chunking.needs_costs(cfg):
            return chunking.chunk(documents, cfg, carry=tuple(c for c in ("title", "source_uri") if c in documents.columns))
        priced = self.gap_costs(documents) if self.gap_costs else chunking.embedding_costs(documents, self.embed, cfg.max_tokens)
        return chunking.chunk(priced, cfg, "costs")

    def chunk(self, documents: DataFrame) -> DataFrame:
        """Screened, chunked, deduplicated and enriched chunks; dropped ones are marked, not removed."""
        made, cut = screening.screened_chunks(documents, self.scorer, self._divided, self.config.enrich)
        first = collection.exact_duplicates_removed(chunking.finish_chunks(made, documents), ["doc_id"], "content_hash", ["chunk_index"])
        done = enrich.enrich(self.scorer(first), self.config.enrich, taxonomy=self.config.taxonomy)
        return done if cut is None else done.unionByName(cut, allowMissingColumns=True)

    def ingest(self, sources: DataFrame | list[str], name: str, dry_run: bool = False, limit: int | None = None, force: bool = False) -> DataFrame:
        """Store new and changed documents, remove what they no longer have; a report per document.

        ``limit`` takes the first documents by id; ``force`` ingests unchanged ones again. Records keep their document's
        ``metadata``, which filters address as ``m_<key>``, and the tags of the taxonomy.
        """
        target = self.collection(name)
        found = self.documents(sources)
        docs = materialize(found if limit is None else found.orderBy("doc_id").limit(limit))
        if dry_run:
            return chunking.request_estimate(docs)
        target.check(self.config.embedder, self.dim, create=True, metric=self.config.metric, chunker=self.config.chunking.method, pipeline_version=__version__)
        stored = target.read() if target.exists() else None
        if stored is not None and not force:
            docs = docs.join(collection.unchanged(docs, stored).select("doc_id"), "doc_id", "left_anti")
        chunks = materialize(self.chunk(docs))
        now = datetime.datetime.now(datetime.UTC).isoformat()
        keep = chunks.filter("dropped_reason IS NULL").join(docs.select("doc_id", "doc_hash", "metadata"), "doc_id")
        tags = [F.col(c) for f in self.config.taxonomy.fields for c in (f"tag_{f.name}", f"tag_{f.name}_p")]
        records = keep.select(
            "id", self.embed(F.col("embed_text")).alias("vector"), "text", "doc_id", "source_uri", "title", F.array_join("section_path", " > ").alias("section_path"), "chunk_index", "char_start", "char_end",
            "tokens", "content_hash", "doc_hash", "quarantined", "chunker", "self_contained", F.lit(__version__).alias("pipeline_version"), F.lit(now).alias("ingested_at"), "metadata", *tags,
        )
        records = materialize(collection.latest(records, ["id"], ["chunk_index"]))
        if stored is None:
            target.replace(records)
        else:
            target.change(collection.stale_of(stored, docs, records).select("id"), records)
        counts = chunks.groupBy("doc_id").agg(
            F.count(F.lit(1)).alias("chunks"), F.count(F.when(F.col("quarantined"), 1)).alias("quarantined"), F.count("dropped_reason").alias("dropped")
        )
        return docs.select("doc_id").join(counts, "doc_id", "left").fillna(0)

    def _recalled(self, rows: DataFrame, asked: DataFrame, filter_: Filter | None, routed: bool) -> DataFrame:
        """Candidates with ``route_used``: those inside a query's routed tags, or all where these are too few.

        Queries are taken together by what they are routed to; the taxonomy bounds how many such sets there are.
        """
        cfg = self.config.retrieve
        plain = lambda some: retrieval.recall(rows, some, cfg.top_k, conjunction(filter_), cfg.include_quarantined)
        if not routed:
            return plain(asked).withColumn("route_used", F.lit(False))
        options = [retrieval.route_decision(F.col(f"{f}_probabilities"), tx.confidence(F.col(f"{f}_probabilities")), cfg.route).alias(f) for f in self.routable]
        decided = materialize(self.router(asked).select("query_id", "query_vector", F.struct(*options).alias("route")))
        within = None
        for r in decided.select("route").distinct().collect():
            chosen = {f"tag_{f}": list(r.route[f]) for f in self.routable if r.route[f]}
            if chosen:
                same = [F.col(f"route.{f}") == F.array(*[F.lit(o) for o in r.route[f]]).cast("array<string>") for f in self.routable]
                some = decided.filter(reduce(lambda a, b: a & b, same)).select("query_id", "query_vector")
                part = retrieval.recall(rows, some, cfg.top_k, conjunction(filter_, {"in": chosen}), cfg.include_quarantined)
                within = part if within is None else within.unionByName(part)
        if within is None:
            return plain(asked).withColumn("route_used", F.lit(False))
        return retrieval.retry_unfiltered(materialize(within), plain(asked), asked, cfg.route)

    def retrieve(self, queries: DataFrame, name: str, filter_: Filter | None = None, retrieve_only: bool = False, route: bool = True) -> DataFrame:
        """One result per query (query_id, text): ordered passages, conflicts, dropped, gate, abstention, degraded, route_used.

        A query is routed only where no filter is given. It is degraded if a passage of it has no scores.
        """
        cfg = self.config.retrieve
        target = self.collection(name)
        if not retrieve_only:
            target.check(self.config.embedder, self.dim, create=False)
        rows = target.read()
        asked = materialize(queries.select("query_id", "text", self.embed(F.col("text")).alias("query_vector")))
        routed = route and not filter_ and bool(self.routable) and self.router is not None and cfg.route.mode == "on"
        found = self._recalled(rows, asked, filter_, routed)
        pairs = found.join(rows.drop("vector"), "id").join(asked.select("query_id", F.col("text").alias("query_text")), "query_id").withColumnRenamed("score", "vector_score")
        placed = materialize(retrieval.classify(self.query_scorer(pairs.withColumn("text", F.left("text", F.lit(cfg.classify.max_chars)))), cfg.classify))
        kept = placed.filter("decision IN ('include', 'conflict')")
        result = retrieval.assemble(placed, retrieval.gate(kept, asked, cfg.gate))
        unscored = F.coalesce("is_relevant", "contains_answer_evidence", "contradicts_query_premise", "instructs_ai").isNull()
        state = placed.groupBy("query_id").agg(F.bool_or(unscored).alias("degraded"), F.bool_or("route_used").alias("route_used"))
        result = result.join(state, "query_id", "left").fillna(False, ["degraded", "route_used"])
        if cfg.expand_neighbours:
            near = retrieval.within_budget(retrieval.neighbours(placed.filter("decision = 'include'"), rows, cfg.expand_below_self_contained), cfg.expand_max_tokens)
            result = result.join(near.groupBy("query_id").agg(F.array_sort(F.collect_list("id")).alias("expanded")), "query_id", "left")
        return result

    def prompts(self, results: DataFrame, name: str) -> DataFrame:
        """(query_id, prompt): the passages of every result as numbered, cited blocks; null where it abstains."""
        rows = self.collection(name).read().select("id", "doc_id", "title", "source_uri", "section_path", "text")
        each = results.filter("NOT abstain").select("query_id", F.posexplode(F.concat(F.coalesce("passages", F.array().cast("array<string>")), F.coalesce("conflicts", F.array().cast("array<string>")))).alias("i", "id")).join(rows, "id")
        source = tx.citation(F.col("title"), F.col("doc_id"), F.col("source_uri"), F.split("section_path", " > "))
        block = F.struct("i", tx.passage_block(F.col("i") + 1, source, F.col("text")).alias("b"))
        made = each.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["b"]), "\n").alias("prompt"))
        return results.select("query_id").join(made, "query_id", "left")

    def delete_document(self, name: str, doc_id: str) -> None:
        self.collection(name).delete(filter_={"doc_id": doc_id})


def tx_safe(name: str) -> str:
    """``text.safe_name`` for one string."""
    import re

    return (re.sub("[^A-Za-z0-9_]", "_", name).strip("_").lower() or "default")[:48]
