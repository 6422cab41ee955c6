"""Evaluation datasets and recordings as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CORPUS = "id string, _id string, title string, text string, format string"
RECORDING = (
    "id string, answerable boolean, scope string, type string, error string, gate_top int, "
    "cands array<struct<id:string,doc_id:string,vs:double,tokens:int,units:map<string,int>,"
    "jev:struct<is_relevant:double,contains_answer_evidence:double,contradicts_query_premise:double,instructs_ai:double>,llm:double>>, "
    "gate map<string,double>, ms map<string,double>"
)


@dataclass
class EvalSet:
    """docs (doc_id, title, text), queries (query_id, text, answerable, scope, evidence), qrels (query_id, unit, gain)."""

    docs: DataFrame
    queries: DataFrame
    qrels: DataFrame
    level: str = "doc"


def sample_by_hash(df: DataFrame, key: str, n: int | None, seed: int = 0) -> DataFrame:
    """A reproducible sample of ``n`` rows; all rows for no ``n``."""
    return df if n is None else df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def beir(spark: SparkSession, path: str, split: str = "test", max_queries: int | None = None, distractors: int | None = None, seed: int = 0) -> EvalSet:
    """corpus.jsonl, queries.jsonl and qrels/<split>.tsv; grades of 0 count for nothing, empty texts are left out."""
    qrels = spark.read.csv(f"{path}/qrels/{split}.tsv", sep="\t", schema="query_id string, unit string, grade string")
    qrels = qrels.withColumn("gain", F.col("grade").try_cast("int")).filter("gain > 0").select("query_id", "unit", "gain")
    queries = spark.read.schema("_id string, text string").json(f"{path}/queries.jsonl").select(F.col("_id").alias("query_id"), "text")
    queries = sample_by_hash(queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi"), "query_id", max_queries, seed)
    qrels = qrels.join(queries.select("query_id"), "query_id", "left_semi")
    docs = spark.read.schema(CORPUS).json(f"{path}/corpus.jsonl").filter("length(trim(text)) > 0").select(F.col("_id").alias("doc_id"), "title", "text", F.lit("text").alias("format"))
    if distractors is not None:
        needed = docs.join(qrels.select(F.col("unit").alias("doc_id")), "doc_id", "left_semi")
        others = docs.join(qrels.select(F.col("unit").alias("doc_id")), "doc_id", "left_anti")
        docs = needed.unionByName(sample_by_hash(others, "doc_id", distractors, seed))
    queries = queries.withColumns({"answerable": F.lit(True), "scope": F.lit(None).cast("string"), "evidence": F.array().cast("array<string>")})
    return EvalSet(docs, queries, qrels)


_QASPER = (
    "map<string,struct<title:string,abstract:string,full_text:array<struct<section_name:string,paragraphs:array<string>>>,"
    "qas:array<struct<question:string,question_id:string,answers:array<struct<answer:struct<unanswerable:boolean,extractive_spans:array<string>,yes_no:boolean,free_form_answer:string,evidence:array<string>>>>>>>>"
)


#: Evidence that points at a figure or a table; their texts are not in the paper's.
FLOATS = r"(?i)^(FLOAT SELECTED|TABLE|FIGURE)"


def _section(s: Column) -> Column:
    """A section's heading, if it has a name, and its paragraphs that hold anything."""
    name, paragraphs = F.trim(F.coalesce(s["section_name"], F.lit(""))), F.coalesce(s["paragraphs"], F.array().cast("array<string>"))
    filled = F.filter(F.transform(paragraphs, lambda p: F.trim(p)), lambda p: p != "")
    return F.array_join(F.concat(F.when(name != "", F.array(F.concat(F.lit("## "), name))).otherwise(F.array().cast("array<string>")), filled), "\n\n")


def qasper(spark: SparkSession, path: str, max_papers: int | None = None, seed: int = 0) -> EvalSet:
    """Papers as Markdown; the first annotator's answer; figures and tables are no evidence; scope is the paper."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", _QASPER)).alias("doc_id", "paper"))
    papers = sample_by_hash(whole, "doc_id", max_papers, seed)
    title, abstract = F.coalesce("paper.title", F.lit("")), F.coalesce("paper.abstract", F.lit(""))
    sections = F.filter(F.transform(F.coalesce("paper.full_text", F.array().cast("array<struct<section_name:string,paragraphs:array<string>>>")), _section), lambda t: t != "")
    text = F.array_join(F.concat(F.array(F.concat(F.lit("# "), title), F.lit("## Abstract"), abstract), sections), "\n\n")
    docs = papers.select("doc_id", title.alias("title"), text.alias("text"), F.lit("markdown").alias("format"))
    asked = papers.select("doc_id", F.explode("paper.qas").alias("q")).withColumn("a", F.get(F.col("q.answers"), 0)["answer"])
    listed = F.transform(F.coalesce("a.evidence", F.array().cast("array<string>")), lambda e: F.trim(e))
    evidence = F.filter(listed, lambda e: e.isNotNull() & (e != "") & ~e.rlike(FLOATS))
    kind = F.when(F.col("a.unanswerable"), "unanswerable").when(F.col("a.yes_no").isNotNull(), "yes_no").when(F.size("a.extractive_spans") > 0, "extractive").otherwise("free_form")
    queries = asked.select(
        F.col("q.question_id").alias("query_id"), F.col("q.question").alias("text"), (~F.coalesce("a.unanswerable", F.lit(False))).alias("answerable"), F.col("doc_id").alias("scope"), evidence.alias("evidence"), kind.alias("type")
    ).filter("NOT answerable OR size(evidence) > 0")
    qrels = queries.select("query_id", F.posexplode("evidence").alias("i", "e")).select("query_id", F.concat(F.lit("e"), F.col("i").cast("string")).alias("unit"), F.lit(1).alias("gain"))
    return EvalSet(docs, queries, qrels, "evidence")


def jsonl(spark: SparkSession, queries_path: str, corpus_path: str, split: str | None = None) -> EvalSet:
    """A corpus and queries in JSON lines; ``relevant`` is a list or a map of grades; evidence sets the level."""
    docs = spark.read.schema(CORPUS).json(corpus_path).select(F.col("id").alias("doc_id"), "title", "text", F.coalesce("format", F.lit("markdown")).alias("format"))
    raw = spark.read.text(queries_path).filter("length(trim(value)) > 0")
    shape = "id string, query string, text string, answerable boolean, scope string, split string, type string, evidence array<string>"
    q = raw.select(F.from_json("value", shape).alias("q"), F.get_json_object("value", "$.relevant").alias("relevant"))
    rows = q.select(
        F.coalesce("q.id", F.concat(F.lit("q"), F.xxhash64("q.query", "q.text").cast("string"))).alias("query_id"), F.coalesce("q.query", "q.text").alias("text"),
        F.coalesce("q.answerable", F.lit(True)).alias("answerable"), F.col("q.scope").alias("scope"), F.coalesce("q.evidence", F.array().cast("array<string>")).alias("evidence"), "q.split", "relevant",
    )
    if split is not None:
        rows = rows.filter(F.coalesce("split", F.lit(split)) == split)
    listed = F.from_json("relevant", "array<string>")
    graded = F.coalesce(F.from_json("relevant", "map<string,int>"), F.map_from_arrays(listed, F.transform(listed, lambda _: F.lit(1))))
    qrels = rows.filter("relevant IS NOT NULL").select("query_id", F.explode(graded).alias("unit", "gain")).filter("gain > 0")
    level = "evidence" if not rows.filter("size(evidence) > 0").isEmpty() else "doc"
    return EvalSet(docs, rows.drop("relevant", "split"), qrels, level)


def load(spark: SparkSession, spec: str, **options: object) -> EvalSet:
    """``beir:<folder>``, ``qasper:<file>`` or ``jsonl:<queries>,<corpus>``."""
    kind, _, where = spec.partition(":")
    if kind == "beir":
        return beir(spark, where, **options)
    if kind == "qasper":
        return qasper(spark, where, **options)
    if kind == "jsonl":
        return jsonl(spark, *where.split(",", 1), **options)
    raise ValueError(f"unknown dataset {spec!r}")


def recording(spark: SparkSession, path: str) -> DataFrame:
    """Latest row without an error of every query of an append-only recording; unreadable lines are skipped."""
    lines = spark.read.text(path).select("value", "_metadata.file_modification_time", "_metadata.file_block_start", F.monotonically_increasing_id().alias("seq"))
    rows = lines.select("*", F.from_json("value", RECORDING).alias("r")).filter("r.id IS NOT NULL AND r.error IS NULL")
    last = Window.partitionBy("r.id").orderBy(F.desc("file_modification_time"), F.desc("seq"))
    return rows.withColumn("n", F.row_number().over(last)).filter("n = 1").select("r.*")


def append_recording(rows: DataFrame, path: str) -> None:
    """Add queries that are not recorded yet."""
    spark = rows.sparkSession
    try:
        done = recording(spark, path).select("id")
        rows = rows.join(done, "id", "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows.write.mode("append").json(path)


def candidate_rows(recorded: DataFrame) -> DataFrame:
    """One row per candidate of a recording, ranked as recorded."""
    c = recorded.select(F.col("id").alias("query_id"), "answerable", F.posexplode("cands").alias("i", "c"))
    return c.select(
        "query_id", "answerable", (F.col("i") + 1).alias("rank"), F.col("c.id").alias("id"), F.col("c.doc_id").alias("doc_id"), F.col("c.vs").alias("vector_score"), F.col("c.tokens").alias("tokens"), F.col("c.units").alias("units"),
        F.col("c.jev.is_relevant").alias("is_relevant"), F.col("c.jev.contains_answer_evidence").alias("contains_answer_evidence"), F.col("c.jev.contradicts_query_premise").alias("contradicts_query_premise"), F.col("c.jev.instructs_ai").alias("instructs_ai"), F.col("c.llm").alias("llm"),
    )
