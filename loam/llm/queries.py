"""Queries over the training-data operators, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import boilerplate, leakage, markup, mixture, neighbours, rankagg, residue, sentences, splitting, topn
from loam.plans.runtime import join_small, table

Query = Callable[[SparkSession, str], DataFrame]

FUSED = ["vector_score", "scores.is_relevant", "scores.contains_answer_evidence", "scores.llm", "scores.lexical"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence of every plain-text document."""
    notes = table(spark, d, "documents").filter("kind = 'note'").select("doc_id", "text", "lang")
    return sentences.sentence_units(notes)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The candidate that comes first when five scores weigh equally, per query not marked unanswerable."""
    marked = table(spark, d, "evalqueries").filter("answerable = false").select("query_id").distinct()
    asked = join_small(table(spark, d, "passages"), marked, ["query_id"], "left_anti", salt=F.xxhash64("chunk_id"))
    ranked = rankagg.aggregate_ranks(asked, "query_id", "chunk_id", [F.col(c) for c in FUSED], "recorded_at")
    return rankagg.first_of_group(ranked, "query_id", "chunk_id")


def p2_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Significance and mean rank of every current candidate of every query."""
    return rankagg.aggregate_ranks(table(spark, d, "passages"), "query_id", "chunk_id", [F.col(c) for c in FUSED], "recorded_at").withColumns(
        {"significance": F.round("significance", 6), "mean_rank": F.round("mean_rank", 4)}
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every page that lies outside the main body."""
    pages = table(spark, d, "documents").filter("kind = 'page'")
    return boilerplate.furniture_lines(pages, "doc_id", "text", "title")


def p4_main_text(spark: SparkSession, d: str) -> DataFrame:
    """The main body of every page."""
    return boilerplate.main_texts(table(spark, d, "documents").filter("kind = 'page'"), "doc_id", "text", "title")


def p4_chunk_text(spark: SparkSession, d: str) -> DataFrame:
    """The main body of every current chunk cut from a page."""
    whole = table(spark, d, "documents").filter("kind = 'page'")
    pages = whole.select("doc_id", "title", "site")
    chunks = table(spark, d, "chunks")
    last = chunks.groupBy("chunk_id").agg(F.max("ingested_at").alias("ingested_at"))
    current = chunks.join(last, ["chunk_id", "ingested_at"], "left_semi").join(pages, "doc_id").dropDuplicates(["chunk_id"])
    return boilerplate.main_texts(current, "chunk_id", "text", "title", model=boilerplate.line_model(whole))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of records of which one is among the other's five most similar, from a cosine of 0.9."""
    return neighbours.similar_pairs(neighbours.nearest(table(spark, d, "records"), 5, 0.9))


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar records of every record, however far."""
    out = neighbours.nearest(table(spark, d, "records"), 5, -1.0, probes=neighbours.PROBES_ANY)
    return out.withColumn("similarity", F.round("similarity", 6))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Headings, list items, code blocks and formulas of every exported document."""
    return markup.elements(table(spark, d, "documents").filter("kind = 'export'"))


def p6_clean_text(spark: SparkSession, d: str) -> DataFrame:
    """The readable text of every exported document."""
    return markup.cleaned(table(spark, d, "documents").filter("kind = 'export'"))


def _evidence_top(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "passages").select("query_id", "chunk_id", F.col("scores.contains_answer_evidence").alias("evidence"), "vector_score", "recorded_at")
    return topn.top_n(rows, "query_id", "chunk_id", "evidence", "vector_score", "recorded_at", 5)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The five best current candidates of every query by evidence, then vector score, then chunk_id."""
    return _evidence_top(spark, d).select("query_id", "chunk_id")


def p3_top_scores(spark: SparkSession, d: str) -> DataFrame:
    """The same rows with the scores that decided."""
    return _evidence_top(spark, d).select("query_id", "chunk_id", F.col("score").alias("evidence"), F.col("tie_score").alias("vector_score"))


def _current_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Current chunks larger than their limit; only those carry their text through the join."""
    chunks = splitting.with_limits(table(spark, d, "chunks").filter("chunk_id IS NOT NULL"), table(spark, d, "chunkconfigs"))
    at = F.coalesce(F.unix_micros(F.col("ingested_at").cast("timestamp")), F.lit(-(2**63)))
    chunks = chunks.withColumns({"_at": at, "_tie": F.xxhash64("text", "max_tokens")})
    # only the keys of repeated chunks are compared; texts stay where they are
    latest = chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.max("_at").alias("_last")).filter("n > 1").select("chunk_id", "_last")
    large = splitting.oversized(chunks)
    checked = join_small(large, latest, ["chunk_id"], "left", salt=F.col("_tie"))
    current = checked.filter(F.col("_last").isNull() | (F.col("_at") == F.col("_last")))
    columns = ["doc_id", "text", "section_path", "max_tokens", "overlap_tokens"]
    # of recordings of one moment, repeated or not, one counts; only oversized chunks meet here
    one = current.groupBy("chunk_id").agg(F.min_by(F.struct(*columns), F.struct("_tie", "doc_id")).alias("c"))
    return one.select(F.col("chunk_id").alias("id"), *[F.col(f"c.{c}").alias(c) for c in columns])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks too large for their configuration: those the splitter cuts."""
    rows = _current_chunks(spark, d).withColumn("lang", F.lit(None).cast("string"))
    return splitting.pieces(rows, checked=True).filter("piece_index = 1").select(F.col("id").alias("chunk_id")).distinct()


def p7_chunk_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every oversized chunk, cut by the rules of its document's language."""
    langs = table(spark, d, "documents").filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("lang").alias("lang"))
    rows = _current_chunks(spark, d).join(langs, "doc_id", "left")
    return splitting.pieces(rows, checked=True).withColumnRenamed("id", "chunk_id")


def p7_limits_kept(spark: SparkSession, d: str) -> DataFrame:
    """Per oversized chunk: pieces over the limit, that overlap too much, or that do not follow their neighbour."""
    from pyspark.sql import Window

    limits = _current_chunks(spark, d).select(F.col("id").alias("chunk_id"), "max_tokens", "overlap_tokens", "text")
    order = Window.partitionBy("chunk_id").orderBy("piece_index")
    made = p7_chunk_pieces(spark, d).withColumns({"before_end": F.lag("piece_end").over(order), "before_start": F.lag("piece_start").over(order)}).join(limits, "chunk_id")
    shared = F.substring("text", F.col("piece_start") + 1, F.greatest(F.col("before_end") - F.col("piece_start"), F.lit(0)))
    count = lambda wrong: F.count(F.when(wrong, 1))
    return made.groupBy("chunk_id").agg(
        count((F.col("piece_tokens") > F.col("max_tokens")) & F.col("piece_text").rlike(r"\s")).alias("too_large"),
        count(splitting.estimated_tokens(shared) > F.col("overlap_tokens")).alias("shared_too_much"),
        count(F.col("piece_start") <= F.col("before_start")).alias("out_of_order"),
        count(F.substring("text", F.col("piece_start") + 1, F.col("piece_end") - F.col("piece_start")) != F.col("piece_text")).alias("wrong_text"),
        count(F.length(F.regexp_replace(F.substring("text", F.col("before_end") + 1, F.greatest(F.col("piece_start") - F.col("before_end"), F.lit(0))), r"[\s\p{Z}\x85]+", "")) > 0).alias("left_out"),
    )


def p7_document_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every document larger than the default configuration allows."""
    rows = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), "text", "lang", F.when(F.length("title") > 0, F.array("title")).alias("section_path"), F.lit(None).cast("int").alias("config_id")
    )
    return splitting.pieces(splitting.with_limits(rows, table(spark, d, "chunkconfigs"))).withColumnRenamed("id", "doc_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold at least half of a held-out passage."""
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "testitems")).filter("item_id < doc_id").select("item_id", "doc_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Per held-out item the number of documents that leak it and the best alignment."""
    found = leakage.leaked(table(spark, d, "documents"), table(spark, d, "testitems"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("docs"), F.round(F.max("covered"), 4).alias("covered"), F.round(F.max("identity"), 4).alias("identity"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Planned sources that cannot reach their share within their repeats."""
    return mixture.feasibility(table(spark, d, "documents"), table(spark, d, "mixplan")).filter("NOT feasible").select("source")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached shares of every planned source."""
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mixplan"))[1]


def p9_copies(spark: SparkSession, d: str) -> DataFrame:
    """How often every document of a planned source is taken."""
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mixplan"))[0]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold template residue or nothing but notices."""
    return residue.residue(table(spark, d, "documents")).select("doc_id")


def p10_messages(spark: SparkSession, d: str) -> DataFrame:
    """The distinct messages concerned, with the documents and sources they occur in."""
    documents = table(spark, d, "documents")
    words = residue.filler_words(documents)
    return residue.recurring(residue.scan(documents, words), words).select("class", "message", "docs", "sources")


_P3 = """
WITH cur AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY recorded_at DESC NULLS LAST) AS rn FROM passages
), top AS (
  SELECT query_id, chunk_id, scores.contains_answer_evidence AS evidence, vector_score,
         row_number() OVER (PARTITION BY query_id ORDER BY scores.contains_answer_evidence DESC NULLS LAST,
                            vector_score DESC NULLS LAST, chunk_id) AS k
  FROM cur WHERE rn = 1
)
SELECT {cols} FROM top WHERE k <= 5"""

_P2_RANKS = """
WITH cur AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY recorded_at DESC NULLS LAST) AS rn FROM passages {where}
), vals AS (
  SELECT query_id, chunk_id, count(*) OVER (PARTITION BY query_id) AS group_size,
         unnest([coalesce(vector_score, -1e300), coalesce(scores.is_relevant, -1e300), coalesce(scores.contains_answer_evidence, -1e300),
                 coalesce(scores.llm, -1e300), coalesce(scores.lexical, -1e300)]) AS v, unnest([1, 2, 3, 4, 5]) AS f
  FROM cur WHERE rn = 1
), r AS (
  SELECT query_id, chunk_id, group_size,
         rank() OVER (PARTITION BY query_id, f ORDER BY v DESC) + (count(*) OVER (PARTITION BY query_id, f, v) - 1) / 2.0 AS rnk
  FROM vals
), items AS (
  SELECT query_id, chunk_id, any_value(group_size) AS group_size, avg(rnk) AS mean_rank,
         list_sort(list(rnk / group_size)) AS x
  FROM r GROUP BY query_id, chunk_id
), sig AS (
  SELECT query_id, chunk_id, group_size, mean_rank, 5 * least(
    1 - pow(1 - x[1], 5),
    10 * pow(x[2], 2) * pow(1 - x[2], 3) + 10 * pow(x[2], 3) * pow(1 - x[2], 2) + 5 * pow(x[2], 4) * (1 - x[2]) + pow(x[2], 5),
    10 * pow(x[3], 3) * pow(1 - x[3], 2) + 5 * pow(x[3], 4) * (1 - x[3]) + pow(x[3], 5),
    5 * pow(x[4], 4) * (1 - x[4]) + pow(x[4], 5),
    pow(x[5], 5)) AS significance
  FROM items
)
"""

_ORACLES = {
    "p7_found": """
WITH d AS (SELECT max_tokens FROM chunkconfigs WHERE is_default),
cur AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST) AS rn FROM chunks),
s AS (
  SELECT chunk_id, coalesce(c.max_tokens, (SELECT max_tokens FROM d)) AS cap,
         regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS runs,
         regexp_extract_all(text, '[^\\p{L}\\p{N}_\\s\\p{Z}]') AS others
  FROM cur LEFT JOIN chunkconfigs c USING (config_id) WHERE rn = 1
)
SELECT chunk_id FROM s
WHERE len(runs) + len(others) + (len(list_filter(runs, lambda x: length(x) > 8)) // 2) > cap""",
    "p7_limits_kept": """
WITH d AS (SELECT max_tokens FROM chunkconfigs WHERE is_default),
cur AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST) AS rn FROM chunks),
s AS (
  SELECT chunk_id, coalesce(c.max_tokens, (SELECT max_tokens FROM d)) AS cap,
         regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS runs,
         regexp_extract_all(text, '[^\\p{L}\\p{N}_\\s\\p{Z}]') AS others
  FROM cur LEFT JOIN chunkconfigs c USING (config_id) WHERE rn = 1
)
SELECT chunk_id, 0 AS too_large, 0 AS shared_too_much, 0 AS out_of_order, 0 AS wrong_text, 0 AS left_out FROM s
WHERE len(runs) + len(others) + (len(list_filter(runs, lambda x: length(x) > 8)) // 2) > cap""",
    "p2_found": _P2_RANKS.format(where="WHERE query_id NOT IN (SELECT query_id FROM evalqueries WHERE answerable = false AND query_id IS NOT NULL)")
    + "SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(significance, 12), round(mean_rank, 6), chunk_id) AS k FROM sig) WHERE k = 1",
    "p2_ranking": _P2_RANKS.format(where="") + "SELECT query_id, chunk_id, round(significance, 6) AS significance, round(mean_rank, 4) AS mean_rank, group_size FROM sig",
    "p3_found": _P3.format(cols="query_id, chunk_id"),
    "p3_top_scores": _P3.format(cols="query_id, chunk_id, evidence, vector_score"),
}


def queries() -> dict[str, Query]:
    """All pN_ queries by name."""
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
