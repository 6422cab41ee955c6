"""Paragraph screening before chunking: what is cut out of a document, and what is left to chunk.

A planted instruction or a banner among good paragraphs is judged on its own, so that the chunk around it is
neither hidden nor dropped. Cut spans become blanks, so every offset into the original text stays exact.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions import text as tx
from loam.operators import chunking
from loam.operators.enrich import Thresholds, screen_action
from loam.plans.runtime import join_small, materialize

#: Headings and code are never screened.
SCREENED = ("paragraph", "list_item", "table", "quote")
#: A scorer sees this much of a paragraph; what is cut is the whole paragraph.
MAX_CHARS = 1500

PARAGRAPHS = "doc_id string, paragraph_index int, char_start int, char_end int, section_path array<string>, tokens int, text string"


def paragraphs(documents: DataFrame) -> DataFrame:
    """Screenable blocks that hold a letter or digit, one row each; see ``PARAGRAPHS``. No shuffle."""

    def one(text: str, form: str | None) -> list[tuple]:
        found = ((b, text[b.start : b.end]) for b in chunking.parse_blocks(text, form) if b.kind in SCREENED)
        return [(b.start, b.end, list(b.path), chunking.count_tokens(body), body) for b, body in found if any(c.isalnum() for c in body)]

    names = ["doc_id", "paragraph_index", "char_start", "char_end", "section_path", "tokens", "text"]
    types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.string()]
    return chunking._texts(documents).mapInArrow(chunking._exploder(one, names, types), PARAGRAPHS)


def decisions(documents: DataFrame, scorer: Callable[[DataFrame], DataFrame], t: Thresholds = Thresholds()) -> DataFrame:
    """Every paragraph with its scores and ``screened``: quarantine, drop or keep."""
    found = paragraphs(documents).withColumn("content_hash", tx.content_hash(F.col("text")))
    found = found.withColumns({"id": tx.record_id(F.col("doc_id"), F.col("content_hash")), "_body": F.col("text"), "text": F.left("text", F.lit(MAX_CHARS))})
    scored = scorer(found).withColumn("text", F.col("_body")).drop("_body")
    return scored.withColumn("screened", screen_action(F.col("instructs_ai"), F.col("boilerplate"), t))


def blanked(documents: DataFrame, cut: DataFrame) -> DataFrame:
    """Documents (of distinct ids) with the spans of ``cut`` (doc_id, char_start, char_end) replaced by as many blanks."""
    spans = cut.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("char_start").alias("a"), F.col("char_end").alias("b"))).alias("_spans"))
    joined = join_small(documents.withColumn("doc_id", F.col("doc_id").cast("string")), spans, ["doc_id"], "left")
    left = F.aggregate("_spans", F.col("text"), lambda acc, s: tx.blank_out(acc, s["a"], s["b"]))
    return joined.withColumn("text", F.when(F.col("_spans").isNotNull(), left).otherwise(F.col("text"))).drop("_spans")


def tidy(text: Column) -> Column:
    """Collapse the blank lines that cut paragraphs leave inside a chunk."""
    return F.regexp_replace(text, r"\n[ \t]*\n(?:[ \t]*\n)+", "\n\n")


def screened_chunks(documents: DataFrame, scorer: Callable[[DataFrame], DataFrame], chunk: Callable[[DataFrame], DataFrame], t: Thresholds = Thresholds()) -> tuple[DataFrame, DataFrame | None]:
    """Chunks of what is left, and the paragraphs cut out as chunks of their own (none when nothing is cut).

    Quarantined paragraphs are numbered behind the chunks of their document; dropped ones have no
    number, their reason, and are for reports only.
    """
    if t.mode != "on" or t.screen_paragraphs != "on":
        return chunk(documents), None
    cut = materialize(decisions(documents, scorer, t).filter("screened <> 'keep'"))
    if cut.isEmpty():
        return chunk(documents), None
    rest = blanked(documents, cut)
    touched = cut.select("doc_id").distinct().withColumn("_cut", F.lit(True))
    made = join_small(chunk(rest), touched, ["doc_id"], "left", salt=F.col("chunk_index"))
    made = made.withColumn("text", F.when(F.col("_cut"), tidy(F.col("text"))).otherwise(F.col("text"))).drop("_cut")

    hidden = cut.filter("screened = 'quarantine'")
    numbered = chunk(join_small(rest, hidden.select("doc_id").distinct(), ["doc_id"], "left_semi"))
    counts = numbered.groupBy("doc_id").agg((F.max("chunk_index") + 1).alias("_n"))
    behind = F.size(F.filter("_before", lambda i: i < F.col("paragraph_index")))
    places = hidden.groupBy("doc_id").agg(F.collect_list("paragraph_index").alias("_before"))
    own = hidden.join(places, "doc_id").join(counts, "doc_id", "left").withColumn("chunk_index", (F.coalesce("_n", F.lit(0)) + behind).cast("int")).drop("_n", "_before")
    own = own.unionByName(cut.filter("screened = 'drop'").withColumn("chunk_index", F.lit(None).cast("int")))
    own = chunking.finish_chunks(own.drop("id", "content_hash").withColumn("chunker", F.lit("screen")), documents).withColumn("embed_text", F.col("text"))
    actions = {
        "action": F.when(F.col("screened") == "drop", "drop_boilerplate").otherwise("quarantine"), "quarantined": F.col("screened") == "quarantine",
        "dropped_reason": F.when(F.col("screened") == "drop", "boilerplate"), "needs_reenrich": F.lit(False),
    }
    return made, own.withColumns(actions).drop("screened", "paragraph_index")
