"""Queries over the driver tables, one or more per operator, with the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import filters, text as tx, vectors
from loam.operators import chunking, collection, enrich, evaluate, retrieval, screening
from loam.plans.catalogue import register
from loam.plans.runtime import table

Spark = SparkSession

# ---------------------------------------------------------------- identity and text

_NORM = (
    "regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), "
    "'[ \\t\\f\\x0B\\x1c-\\x1f\\x85\\p{Z}]+(\\n|\\z)', '\\1', 'g'), '^\\n+|\\n+\\z', '', 'g')"
)
_SHA = f"sha256({_NORM})"
_RESOLVED = f"coalesce(nullif(source_uri, ''), 'sha256:' || left({_SHA}, 32))"


@register("normalised_text", f"SELECT doc_id, {_NORM} AS normalised FROM documents WHERE text IS NOT NULL")
def normalised_text(spark: Spark, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", tx.normalise_text(F.col("text")).alias("normalised"))


@register("content_hash", f"SELECT doc_id, {_SHA} AS content_hash FROM documents WHERE text IS NOT NULL")
def content_hash(spark: Spark, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"))


@register("resolved_doc_id", f"SELECT doc_id, {_RESOLVED} AS resolved FROM documents WHERE text IS NOT NULL")
def resolved_doc_id(spark: Spark, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", tx.resolved_id(F.lit(None).cast("string"), F.col("source_uri"), F.col("text")).alias("resolved"))


@register("doc_hash", f"SELECT doc_id, left(sha256({_NORM} || chr(31) || coalesce(title, '')), 32) AS doc_hash FROM documents WHERE text IS NOT NULL")
def doc_hash(spark: Spark, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", tx.doc_hash(F.col("text"), F.col("title")).alias("doc_hash"))


@register(
    "record_id_uuid5",
    f"""WITH h AS (SELECT chunk_id, sha1(unhex('{tx.RECORD_NAMESPACE}') || encode(doc_id::VARCHAR || chr(31) || {_SHA})) AS s FROM chunks WHERE text IS NOT NULL)
SELECT DISTINCT chunk_id, s[1:8] || '-' || s[9:12] || '-5' || s[14:16] || '-' || translate(s[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || s[18:20] || '-' || s[21:32] AS record_id FROM h""",
)
def record_id_uuid5(spark: Spark, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").filter("text IS NOT NULL")
    return chunks.select("chunk_id", tx.record_id(F.col("doc_id").cast("string"), tx.content_hash(F.col("text"))).alias("record_id")).distinct()


_RUNS = "regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}_]+')"
_OTHERS = "regexp_extract_all({c}, '[^\\p{{L}}\\p{{N}}_\\s\\x0B\\x1c-\\x1f\\x85\\p{{Z}}]')"
_EST = "len(" + _RUNS + ") + len(" + _OTHERS + ") + len(list_filter(" + _RUNS + ", lambda x: length(x) > 8)) // 2"


@register("token_estimate", f"SELECT doc_id, ({_EST.format(c='text')})::BIGINT AS tokens FROM documents WHERE text IS NOT NULL")
def token_estimate(spark: Spark, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@register("stale_token_counts", f"SELECT chunk_id, ingested_at, tokens, ({_EST.format(c='text')})::BIGINT AS recounted FROM chunks WHERE text IS NOT NULL AND tokens IS DISTINCT FROM {_EST.format(c='text')}", times=("ingested_at",))
def stale_token_counts(spark: Spark, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").filter("text IS NOT NULL").withColumn("recounted", tx.token_estimate(F.col("text")))
    return chunks.filter(~F.col("tokens").eqNullSafe(F.col("recounted"))).select("chunk_id", "ingested_at", "tokens", "recounted")


@register("request_token_estimate", "SELECT query_id, created_at, (length(text) // 3 + 8)::BIGINT AS tokens FROM evalqueries WHERE text IS NOT NULL", times=("created_at",))
def request_token_estimate(spark: Spark, d: str) -> DataFrame:
    rows = table(spark, d, "evalqueries").filter("text IS NOT NULL")
    return rows.select("query_id", "created_at", tx.request_token_estimate(F.col("text")).alias("tokens"))


@register("dedup_exact_within", f"SELECT doc_id, content_hash, chunk_id FROM (SELECT *, {_SHA} AS content_hash, row_number() OVER (PARTITION BY doc_id, {_SHA} ORDER BY chunk_index, chunk_id, ingested_at) AS rn FROM chunks WHERE text IS NOT NULL) WHERE rn = 1")
def dedup_exact_within(spark: Spark, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").filter("text IS NOT NULL").select("doc_id", "chunk_id", "chunk_index", "ingested_at", tx.content_hash(F.col("text")).alias("content_hash"))
    return collection.exact_duplicates_removed(chunks, ["doc_id"], "content_hash", ["chunk_index", "chunk_id", "ingested_at"]).select("doc_id", "content_hash", "chunk_id")


@register("dedup_exact_corpus", f"SELECT {_SHA} AS content_hash, count(*) AS copies, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1")
def dedup_exact_corpus(spark: Spark, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("doc_id"))


@register(
    "line_offsets",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, n AS line_no, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) - length(line) - 1)::BIGINT AS char_start, length(line)::BIGINT AS n_chars FROM l""",
)
def line_offsets(spark: Spark, d: str) -> DataFrame:
    # a running sum inside each document's own array: no shuffle of the lines
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.split("text", "\n").alias("lines"))
    size = F.transform("lines", lambda x: F.length(x).cast("long"))
    start = F.aggregate(
        size,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<s:bigint,n:bigint>>").alias("out")),
        lambda acc, n: F.struct((acc["at"] + n + 1).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("s"), n.alias("n")))).alias("out")),
    )["out"]
    short = docs.filter(F.size("lines") <= 200).select("doc_id", F.posexplode(start).alias("i", "x"))
    short = short.select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), F.col("x.s").alias("char_start"), F.col("x.n").alias("n_chars"))
    from pyspark.sql import Window

    lines = docs.filter(F.size("lines") > 200).select("doc_id", F.posexplode("lines").alias("i", "line")).withColumn("n_chars", F.length("line").cast("long"))
    run = F.sum(F.col("n_chars") + 1).over(Window.partitionBy("doc_id").orderBy("i"))
    long_ = lines.select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), (run - F.col("n_chars") - 1).alias("char_start"), "n_chars")
    return short.unionByName(long_)


_PATHLESS = "coalesce(section_path, []::VARCHAR[])"
_SAME = "coalesce(lower(trim(section_path[1])) = lower(trim(title)), false)"
_TRAIL = f"array_to_string(list_filter(CASE WHEN coalesce(title, '') <> '' AND NOT {_SAME} THEN [title] ELSE []::VARCHAR[] END || {_PATHLESS}, lambda p: p <> ''), ' > ')"


@register("embed_text_prefix", f"WITH j AS (SELECT c.chunk_id, c.ingested_at, c.text, c.section_path, d.title FROM chunks c JOIN documents d USING (doc_id)) SELECT chunk_id, ingested_at, CASE WHEN {_TRAIL} <> '' THEN {_TRAIL} || chr(10) || chr(10) || text ELSE text END AS embed_text FROM j", times=("ingested_at",))
def embed_text_prefix(spark: Spark, d: str) -> DataFrame:
    titles = table(spark, d, "documents").select("doc_id", "title")
    chunks = table(spark, d, "chunks").join(titles, "doc_id")
    return chunks.select("chunk_id", "ingested_at", tx.embed_text(F.col("title"), F.col("section_path"), F.col("text")).alias("embed_text"))


_NAME = "coalesce(nullif(title, ''), doc_id::VARCHAR)"
_CITED = f"""{_NAME} || CASE WHEN w <> '' THEN ' > ' || w ELSE '' END || ' (' || coalesce(nullif(source_uri, ''), doc_id::VARCHAR) || ')'"""
_CITE_CTE = f"""WITH j AS (SELECT c.chunk_id, c.ingested_at, c.doc_id, c.text, c.tokens, {_PATHLESS.replace('section_path', 'c.section_path')} AS path, d.title, d.source_uri FROM chunks c JOIN documents d USING (doc_id)),
k AS (SELECT *, array_to_string(CASE WHEN coalesce(lower(trim(path[1])) = lower(trim({_NAME})), false) THEN path[2:] ELSE path END, ' > ') AS w FROM j)"""


@register("citation", f"{_CITE_CTE} SELECT chunk_id, ingested_at, {_CITED} AS citation FROM k", times=("ingested_at",))
def citation(spark: Spark, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "title", "source_uri")
    chunks = table(spark, d, "chunks").join(docs, "doc_id")
    return chunks.select("chunk_id", "ingested_at", tx.citation(F.col("title"), F.col("doc_id").cast("string"), F.col("source_uri"), F.col("section_path")).alias("citation"))


@register(
    "prompt_render",
    f"""{_CITE_CTE}, r AS (SELECT chunk_id, ingested_at, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id, ingested_at) AS n, text, replace(replace(replace({_CITED}, '&', '&amp;'), '"', '&quot;'), '<', '&lt;') AS src FROM k)
SELECT chunk_id, ingested_at, '<passage id="' || n || '" source="' || src || '">' || chr(10) || left(text, 4000) || chr(10) || '</passage>' AS block FROM r""", times=("ingested_at",))
def prompt_render(spark: Spark, d: str) -> DataFrame:
    from pyspark.sql import Window

    docs = table(spark, d, "documents").select("doc_id", "title", "source_uri")
    chunks = table(spark, d, "chunks").join(docs, "doc_id")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_id", "ingested_at"))
    source = tx.citation(F.col("title"), F.col("doc_id").cast("string"), F.col("source_uri"), F.col("section_path"))
    return chunks.select("chunk_id", "ingested_at", tx.passage_block(number, source, F.col("text")).alias("block"))


@register("safe_names", "SELECT doc_id, left(coalesce(nullif(lower(regexp_replace(regexp_replace(site, '[^A-Za-z0-9_]', '_', 'g'), '^_+|_+\\z', '', 'g')), ''), 'default'), 48) AS name FROM documents WHERE site IS NOT NULL")
def safe_names(spark: Spark, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("site IS NOT NULL").select("doc_id", tx.safe_name(F.col("site")).alias("name"))


_EV = "trim(regexp_replace(lower({c}), '[^0-9a-z]+', ' ', 'g'))"


@register("evidence_form", f"SELECT item_id, {_EV.format(c='passage')} AS form FROM testitems WHERE passage IS NOT NULL")
def evidence_form(spark: Spark, d: str) -> DataFrame:
    return table(spark, d, "testitems").filter("passage IS NOT NULL").select("item_id", tx.evidence_form(F.col("passage")).alias("form"))


@register("loose_form", "SELECT doc_id, lower(trim(regexp_replace(translate(title, '‘’“”–—', '''''\"\"--'), '[\\s\\x0B\\x1c-\\x1f\\x85\\p{Z}]+', ' ', 'g'))) AS form FROM documents WHERE title IS NOT NULL")
def loose_form(spark: Spark, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("title IS NOT NULL").select("doc_id", tx.loose_form(F.col("title")).alias("form"))


@register("tidy_text", "SELECT doc_id, regexp_replace(regexp_replace(text, '\\n[ \\t]*\\n(?:[ \\t]*\\n)+', chr(10) || chr(10), 'g'), '^[\\s\\x0B\\x1c-\\x1f\\x85\\p{Z}]+|[\\s\\x0B\\x1c-\\x1f\\x85\\p{Z}]+\\z', '', 'g') AS tidy FROM documents WHERE text IS NOT NULL")
def tidy_text(spark: Spark, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", tx.collapse_blank_lines(F.col("text")).alias("tidy"))


@register("markup_only_chunks", "SELECT chunk_id, ingested_at FROM chunks WHERE text IS NOT NULL AND NOT regexp_matches(text, '[\\p{L}\\p{N}]')", times=("ingested_at",))
def markup_only_chunks(spark: Spark, d: str) -> DataFrame:
    return table(spark, d, "chunks").filter("text IS NOT NULL").filter(~tx.has_prose(F.col("text"))).select("chunk_id", "ingested_at")


@register("blanked_spans", "SELECT doc_id, left(text, 10) || repeat(' ', least(20, length(text) - 10)::INT) || text[31:] AS blanked FROM documents WHERE length(text) > 10")
def blanked_spans(spark: Spark, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("length(text) > 10")
    return docs.select("doc_id", tx.blank_out(F.col("text"), F.lit(10), F.least(F.lit(30), F.length("text"))).alias("blanked"))


@register("text_caps", "SELECT doc_id, left(text, 1200) AS boundary, left(text, 1500) AS screen, left(text, 6000) AS classify, left(text, 3000) AS gate, left(text, 160) AS report FROM documents")
def text_caps(spark: Spark, d: str) -> DataFrame:
    caps = {"boundary": 1200, "screen": 1500, "classify": 6000, "gate": 3000, "report": 160}
    return table(spark, d, "documents").select("doc_id", *[F.left("text", F.lit(n)).alias(c) for c, n in caps.items()])


@register("metadata_prefixed", "SELECT doc_id, unnest(map_entries(metadata)).key AS k, 'm_' || unnest(map_entries(metadata)).key AS field, unnest(map_entries(metadata)).value AS value FROM documents WHERE metadata IS NOT NULL")
def metadata_prefixed(spark: Spark, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("metadata IS NOT NULL")
    return docs.select("doc_id", F.explode("metadata").alias("k", "value")).select("doc_id", "k", F.concat(F.lit("m_"), "k").alias("field"), "value")


# ---------------------------------------------------------------- filters

_FILTERS: dict[str, tuple[dict, str]] = {
    "filter_eq": ({"eq": {"tag": "billing"}}, "tag = 'billing'"),
    "filter_ne": ({"ne": {"tag": "billing"}}, "coalesce(tag <> 'billing', false)"),
    "filter_in": ({"in": {"tag": ["auth", "api"]}}, "tag IN ('auth', 'api')"),
    "filter_nin": ({"nin": {"tag": ["auth", "api"]}}, "coalesce(tag NOT IN ('auth', 'api'), false)"),
    "filter_range": ({"gte": {"score": 0.25}, "lt": {"score": 0.75}}, "score >= 0.25 AND score < 0.75"),
    "filter_gt": ({"gt": {"score": 0.5}}, "score > 0.5"),
    "filter_lte": ({"lte": {"chunk_index": 1}}, "chunk_index <= 1"),
    "filter_exists": ({"exists": "flag"}, "flag IS NOT NULL"),
    "filter_not": ({"not": {"eq": {"flag": True}}}, "NOT coalesce(flag, false)"),
    "filter_not_exists": ({"not": {"exists": "tag"}}, "tag IS NULL"),
    "filter_or": ({"or": [{"eq": {"tag": "api"}}, {"eq": {"flag": False}}]}, "coalesce(tag = 'api', false) OR coalesce(NOT flag, false)"),
    "filter_not_or": ({"not": {"or": [{"eq": {"tag": "api"}}, {"lt": {"score": 0.3}}]}}, "NOT (coalesce(tag = 'api', false) OR coalesce(score < 0.3, false))"),
    "filter_implicit_and": ({"eq": {"chunk_index": 0}, "gte": {"score": 0.6}}, "chunk_index = 0 AND score >= 0.6"),
    "filter_type_guard": ({"flag": {"eq": 1}}, "false"),
    "filter_type_guard_ne": ({"ne": {"flag": 1}}, "flag IS NOT NULL"),
    "filter_type_guard_nin": ({"nin": {"chunk_index": [True, 0]}}, "coalesce(chunk_index <> 0, false)"),
    "filter_fields_below_one_operator": ({"eq": {"chunk_index": 0, "flag": True}}, "chunk_index = 0 AND flag"),
    "filter_short_form": ({"tag": {"in": ["api"]}, "score": {"gte": 0.2}}, "tag = 'api' AND score >= 0.2"),
    "filter_missing_field": ({"not": {"no_such_field": "x"}}, "true"),
    "filter_quarantine_live": ({"not": {"flag": True}}, "NOT coalesce(flag, false)"),
}


def _filter_query(rule: dict):
    def run(spark: Spark, d: str) -> DataFrame:
        return filters.where(table(spark, d, "records"), rule).select("id", "tag", "score", "flag", "ingested_at")

    return run


for _name, (_rule, _sql) in _FILTERS.items():
    register(_name, f"SELECT id, tag, score, flag, ingested_at FROM records WHERE {_sql}", times=("ingested_at",))(_filter_query(_rule))


@register("filter_eval_predicate", "SELECT chunk_id, ingested_at FROM chunks WHERE coalesce(quarantined <> true, false)", times=("ingested_at",))
def filter_eval_predicate(spark: Spark, d: str) -> DataFrame:
    return table(spark, d, "chunks").filter(retrieval.known_clean(F.col("quarantined"))).select("chunk_id", "ingested_at")


@register("filter_dynamic_metadata", "SELECT event_id, user_id FROM events WHERE coalesce((props->>'k')::INT >= 50, false)")
def filter_dynamic_metadata(spark: Spark, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("k", F.variant_get(F.try_parse_json("props"), "$.k", "int"))
    return filters.where(events, {"k": {"gte": 50}}).select("event_id", "user_id")


@register("filter_own_metadata", "SELECT doc_id FROM documents WHERE metadata IS NOT NULL AND map_extract_value(metadata, (SELECT min(k) FROM (SELECT unnest(map_keys(metadata)) AS k FROM documents))) IS NOT NULL")
def filter_own_metadata(spark: Spark, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    key = docs.select(F.explode(F.map_keys("metadata")).alias("k")).agg(F.min("k")).first()[0]
    return filters.where(docs, {"exists": f"m_{key}"}).select("doc_id")


@register("filter_quarantined_chunks", "SELECT chunk_id, ingested_at FROM chunks WHERE coalesce(quarantined = false, false) OR quarantined IS NULL", times=("ingested_at",))
def filter_quarantined_chunks(spark: Spark, d: str) -> DataFrame:
    live = {"or": [{"eq": {"quarantined": False}}, {"not": {"exists": "quarantined"}}]}
    return filters.where(table(spark, d, "chunks"), live).select("chunk_id", "ingested_at")


@register("filter_lineitem_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.05 AND l_quantity < 10")
def filter_lineitem_scan(spark: Spark, d: str) -> DataFrame:
    rule = {"l_returnflag": "R", "l_discount": {"gte": 0.05}, "l_quantity": {"lt": 10}}
    return filters.where(table(spark, d, "lineitem"), rule).select("l_orderkey", "l_linenumber", "l_quantity")


# ---------------------------------------------------------------- vectors

_PROBE = "(SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"


def _probe(spark: Spark, d: str) -> list[float]:
    return table(spark, d, "embeddings").orderBy("vec_id").limit(1).collect()[0]["embedding"]


def _topk(metric: str, rule: dict | None = None):
    def run(spark: Spark, d: str) -> DataFrame:
        rows = vectors.search(table(spark, d, "embeddings"), _probe(spark, d), 30, metric, rule, "vec_id", "embedding")
        return rows.select("vec_id", "label", F.round("score", 4).alias("score"))

    return run


_MEASURE = {"cosine": "list_cosine_similarity", "dot": "list_inner_product", "l2": "list_distance"}


def _topk_sql(metric: str, where: str = "true") -> str:
    raw = f"{_MEASURE[metric]}(embedding::DOUBLE[], {_PROBE}::DOUBLE[])"
    score = f"1 / (1 + {raw})" if metric == "l2" else f"least(greatest({raw}, 0), 1)"
    return f"SELECT vec_id, label, round(s, 4) AS score FROM (SELECT vec_id, label, {score} AS s FROM embeddings WHERE {where}) ORDER BY s DESC, vec_id LIMIT 30"


for _metric in _MEASURE:
    register(f"vector_topk_{_metric}", _topk_sql(_metric))(_topk(_metric))
register("vector_topk_filtered", _topk_sql("cosine", "label IN (1, 2, 3)"))(_topk("cosine", {"label": {"in": [1, 2, 3]}}))

_RECALL = """q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]) AS raw FROM embeddings, q),
recalled AS (SELECT query_id, id, least(greatest(raw, 0), 1) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(least(greatest(raw, 0), 1), 9) DESC, id) AS rank FROM s QUALIFY rank <= 30)"""


def _recalled(spark: Spark, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    asked = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return vectors.search_many(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), asked, 30)


@register("recall_batch", f"WITH {_RECALL} SELECT query_id, id, round(score, 4) AS score, rank FROM recalled")
def recall_batch(spark: Spark, d: str) -> DataFrame:
    return _recalled(spark, d).select("query_id", "id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@register("hash_embedding", times=("created_at",))
def hash_embedding(spark: Spark, d: str) -> DataFrame:
    return table(spark, d, "evalqueries").select("query_id", "created_at", vectors.embedder("hash:128")(F.col("text")).alias("vector"))


@register("adjacent_costs", "WITH v AS (SELECT doc_id, chunk_index, id, vector, lag(vector) OVER w AS p, row_number() OVER w AS n FROM records WHERE len(vector) = 64 AND list_sum(list_transform(vector, lambda x: x * x)) > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index, id, ingested_at)) SELECT doc_id, chunk_index, id, round(least(greatest(list_cosine_similarity(vector::DOUBLE[], p::DOUBLE[]), 0), 1) * CASE WHEN chunk_index = 0 THEN 0.7 ELSE 1 END, 4) AS cost FROM v WHERE n > 1")
def adjacent_costs(spark: Spark, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = table(spark, d, "records").filter("size(vector) = 64").filter(vectors.norm(F.col("vector")) > 0)
    w = Window.partitionBy("doc_id").orderBy("chunk_index", "id", "ingested_at")
    rows = rows.withColumn("p", F.lag("vector").over(w)).filter("p IS NOT NULL")
    return rows.select("doc_id", "chunk_index", "id", F.round(chunking.adjacent_cost(F.col("p"), F.col("vector"), F.col("chunk_index") == 0), 4).alias("cost"))


@register("boundary_costs", "SELECT query_id, chunk_id, recorded_at, loaded_at, round(least(greatest((0.6 * scores.is_relevant + 0.4 * scores.contradicts_query_premise) * CASE WHEN chunk_index = 0 THEN 0.7 ELSE 1 END, 0), 1), 6) AS cost, coalesce(scores.contradicts_query_premise >= 0.5, false) AS protected FROM passages WHERE scores.is_relevant IS NOT NULL AND scores.contradicts_query_premise IS NOT NULL AND chunk_index IS NOT NULL", times=("recorded_at", "loaded_at"))
def boundary_costs(spark: Spark, d: str) -> DataFrame:
    s = table(spark, d, "passages").filter("scores.is_relevant IS NOT NULL AND scores.contradicts_query_premise IS NOT NULL AND chunk_index IS NOT NULL")
    cost = chunking.boundary_cost(F.col("scores.is_relevant"), F.col("scores.contradicts_query_premise"), F.col("chunk_index") == 0)
    return s.select("query_id", "chunk_id", "recorded_at", "loaded_at", F.round(cost, 6).alias("cost"), chunking.protected_gap(F.col("scores.contradicts_query_premise")).alias("protected"))


# ---------------------------------------------------------------- collections

_CUR = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) AS rn FROM records) WHERE rn = 1)"


@register("current_records", f"SELECT id, doc_id, chunk_index, score, ingested_at FROM {_CUR}", times=("ingested_at",))
def current_records(spark: Spark, d: str) -> DataFrame:
    rows = table(spark, d, "records").select("id", "doc_id", "chunk_index", "score", "ingested_at")
    return collection.latest(rows, ["id"], ["ingested_at"])


@register("upsert_replace", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'O' UNION ALL SELECT o_orderkey, 'U', o_totalprice * 2 FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT -1 - o_orderkey, 'N', o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def upsert_replace(spark: Spark, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changed = orders.filter("o_orderstatus = 'O'").select("o_orderkey", F.lit("U").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    added = orders.filter("o_orderstatus = 'F'").select((-1 - F.col("o_orderkey")).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), "o_totalprice")
    return collection.upsert(orders, changed.unionByName(added), "o_orderkey")


@register("delete_where", "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT coalesce(o_orderstatus = 'F' AND o_totalprice > 100000, false)")
def delete_where(spark: Spark, d: str) -> DataFrame:
    rule = {"o_orderstatus": "F", "o_totalprice": {"gt": 100000}}
    return collection.delete(table(spark, d, "orders"), filter_=rule).select("o_orderkey", "o_orderstatus")


@register("delete_ids", "SELECT id FROM records WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE kind = 'page') GROUP BY id")
def delete_ids(spark: Spark, d: str) -> DataFrame:
    pages = table(spark, d, "documents").filter("kind = 'page'").select("doc_id")
    return collection.delete(table(spark, d, "records"), pages, key="doc_id").select("id").distinct()


@register("get_by_id", "SELECT id, tag FROM records WHERE id IN (SELECT id FROM records WHERE flag) GROUP BY id, tag")
def get_by_id(spark: Spark, d: str) -> DataFrame:
    rows = table(spark, d, "records")
    return collection.get(rows, rows.filter("flag").select("id")).select("id", "tag").distinct()


@register("list_ids", "SELECT id FROM records WHERE tag = 'api' ORDER BY id LIMIT 50")
def list_ids(spark: Spark, d: str) -> DataFrame:
    return collection.list_ids(table(spark, d, "records"), {"tag": "api"}, 50)


@register("stale_delete", "SELECT DISTINCT r.chunk_id FROM chunks r WHERE r.doc_id IN (SELECT doc_id FROM passages) AND r.chunk_id NOT IN (SELECT chunk_id FROM passages)")
def stale_delete(spark: Spark, d: str) -> DataFrame:
    fresh = table(spark, d, "passages").select("doc_id", "chunk_id")
    return collection.stale(table(spark, d, "chunks"), fresh, "doc_id", "chunk_id").select("chunk_id").distinct()


@register("stale_after_change", "SELECT DISTINCT r.chunk_id FROM chunks r WHERE r.doc_id IN (SELECT doc_id FROM documents WHERE kind = 'note') AND r.chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE chunk_index > 0 AND chunk_id IS NOT NULL)")
def stale_after_change(spark: Spark, d: str) -> DataFrame:
    """Notes come again without their first chunk; some then have none at all."""
    chunks, notes = table(spark, d, "chunks"), table(spark, d, "documents").filter("kind = 'note'")
    return collection.stale_of(chunks, notes, chunks.filter("chunk_index > 0"), "doc_id", "chunk_id").select("chunk_id").distinct()


_DH = f"left(sha256({_NORM} || chr(31) || coalesce(title, '')), 32)"


@register("skip_unchanged", f"WITH d AS (SELECT doc_id, kind, {_DH} AS h FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, CASE WHEN kind = 'page' THEN 'changed' ELSE h END AS h FROM d) SELECT d.doc_id, d.h AS doc_hash FROM d JOIN s ON d.doc_id = s.doc_id AND d.h = s.h")
def skip_unchanged(spark: Spark, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "kind", tx.doc_hash(F.col("text"), F.col("title")).alias("doc_hash"))
    stored = docs.select("doc_id", F.when(F.col("kind") == "page", "changed").otherwise(F.col("doc_hash")).alias("doc_hash"))
    return collection.unchanged(docs.drop("kind"), stored)


@register("collection_inspect", "SELECT doc_id, chunk_index, chunk_id, quarantined FROM chunks WHERE quarantined ORDER BY doc_id, chunk_index")
def collection_inspect(spark: Spark, d: str) -> DataFrame:
    return table(spark, d, "chunks").filter("quarantined").select("doc_id", "chunk_index", "chunk_id", "quarantined").orderBy("doc_id", "chunk_index")


@register("ingest_report", "SELECT doc_id, count(*) AS chunks, count(*) FILTER (quarantined) AS quarantined, count(dropped_reason) AS dropped, sum(tokens)::BIGINT AS tokens FROM chunks GROUP BY doc_id")
def ingest_report(spark: Spark, d: str) -> DataFrame:
    return table(spark, d, "chunks").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.count(F.when(F.col("quarantined"), 1)).alias("quarantined"), F.count("dropped_reason").alias("dropped"), F.sum("tokens").alias("tokens")
    )


@register("cache_misses", "SELECT DISTINCT sha256(text) AS k FROM evalqueries WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(question) FROM testitems WHERE question IS NOT NULL)")
def cache_misses(spark: Spark, d: str) -> DataFrame:
    asked = table(spark, d, "evalqueries").filter("text IS NOT NULL").select(F.sha2("text", 256).alias("k")).distinct()
    cached = table(spark, d, "testitems").filter("question IS NOT NULL").select(F.sha2("question", 256).alias("k"))
    return asked.join(cached, "k", "left_anti")


@register("sources_in_order", "SELECT 'document' AS origin, doc_id AS id FROM documents UNION ALL SELECT 'chunk', chunk_id FROM chunks")
def sources_in_order(spark: Spark, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.lit("document").alias("origin"), F.col("doc_id").alias("id"))
    return docs.unionByName(table(spark, d, "chunks").select(F.lit("chunk").alias("origin"), F.col("chunk_id").alias("id")))


# ---------------------------------------------------------------- parsing and chunking

def _documents(spark: Spark, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "text", F.coalesce("format", F.lit("markdown")).alias("format"), "title", "source_uri")


@register("document_blocks")
def document_blocks(spark: Spark, d: str) -> DataFrame:
    return chunking.blocks(_documents(spark, d))


@register("document_units")
def document_units(spark: Spark, d: str) -> DataFrame:
    return chunking.units(_documents(spark, d))


@register("chunks_structural")
def chunks_structural(spark: Spark, d: str) -> DataFrame:
    return chunking.chunk(_documents(spark, d))


@register("chunks_small_overlap")
def chunks_small_overlap(spark: Spark, d: str) -> DataFrame:
    return chunking.chunk(_documents(spark, d), chunking.Config(min_tokens=24, target_tokens=90, max_tokens=160, overlap_tokens=16))


@register("chunks_fixed")
def chunks_fixed(spark: Spark, d: str) -> DataFrame:
    return chunking.chunk(_documents(spark, d), chunking.Config(method="fixed", target_tokens=160, max_tokens=256, overlap_tokens=40))


@register("chunks_semantic")
def chunks_semantic(spark: Spark, d: str) -> DataFrame:
    priced = chunking.embedding_costs(_documents(spark, d), vectors.embedder("hash:256"))
    return chunking.chunk(priced, chunking.Config(method="semantic-embedding"), "costs")


def _invariants(cfg: chunking.Config) -> Callable[[Spark, str], DataFrame]:
    def run(spark: Spark, d: str) -> DataFrame:
        """Per document: chunks whose text, size or order is not what the document says, and chunks over the maximum that hold several units."""
        from pyspark.sql import Window

        docs = _documents(spark, d).filter(tx.has_prose(F.col("text"))).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("whole"))
        order = Window.partitionBy("doc_id").orderBy("chunk_index")
        made = chunking.chunk(_documents(spark, d), cfg).withColumns({"before": F.lag("char_start").over(order), "place": F.row_number().over(order) - 1})
        one = F.regexp_count(F.trim("text"), F.lit(r"\S+\s+")) == 0
        # sizes of units are rounded one by one, and the rule below a heading belongs to no unit: only the count of the other
        # runs and marks is sure to stay below the maximum
        ruled = F.regexp_replace("text", r"\n(=+|-+)[ \t]*(?=\n|\z)", "\n")
        marks = F.regexp_count(ruled, F.lit(tx.WORD_RUN)) + F.regexp_count(ruled, F.lit(tx.OTHER_MARK))
        rows = docs.join(made, "doc_id", "left").groupBy("doc_id").agg(
            F.count(F.when(F.substring("whole", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) != F.col("text"), 1)).alias("wrong_text"),
            F.count(F.when(tx.token_estimate(F.col("text")) != F.col("tokens"), 1)).alias("wrong_size"),
            F.count(F.when((F.col("place") != F.col("chunk_index")) | (F.col("char_start") <= F.col("before")), 1)).alias("wrong_order"),
            F.count(F.when((marks > cfg.max_tokens) & ~one, 1)).alias("too_large"),
            F.count(F.when(~tx.has_prose(F.col("text")), 1)).alias("without_prose"),
        )
        return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "wrong_text", "wrong_size", "wrong_order", "too_large", "without_prose")

    return run


for _name, _cfg in {
    "chunk_invariants_structural": chunking.Config(), "chunk_invariants_small": chunking.Config(min_tokens=24, target_tokens=90, max_tokens=160, overlap_tokens=0),
    "chunk_invariants_fixed": chunking.Config(method="fixed", target_tokens=160, max_tokens=256, overlap_tokens=40),
}.items():
    register(_name, "SELECT doc_id, 0 AS wrong_text, 0 AS wrong_size, 0 AS wrong_order, 0 AS too_large, 0 AS without_prose FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '[\\p{L}\\p{N}]')")(_invariants(_cfg))


@register("heading_sections", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL AND NOT contains(text, '```') AND NOT contains(text, '~~~')) SELECT doc_id, count(*) AS headings FROM l WHERE regexp_full_match(line, '#{1,6}[ \\t]+.*') GROUP BY 1")
def heading_sections(spark: Spark, d: str) -> DataFrame:
    notes = table(spark, d, "documents").filter("text IS NOT NULL AND NOT contains(text, '```') AND NOT contains(text, '~~~')").select("doc_id", "text", F.lit("markdown").alias("format"))
    heads = chunking.blocks(notes).filter("kind = 'heading'").join(notes.select(F.col("doc_id").cast("string").alias("doc_id"), "text"), "doc_id")
    marked = heads.filter(F.substring("text", F.col("char_start") + 1, F.lit(1)) == "#")
    return marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("headings"))


@register("chunk_records")
def chunk_records(spark: Spark, d: str) -> DataFrame:
    docs = _documents(spark, d)
    return chunking.finish_chunks(chunking.chunk(docs), docs).drop("text")


@register("boundary_requests")
def boundary_requests(spark: Spark, d: str) -> DataFrame:
    return chunking.request_estimate(_documents(spark, d))


# ---------------------------------------------------------------- screening and enrichment

_RULES = """CASE WHEN len(regexp_extract_all(text, '[A-Za-z0-9]+')) < 4 THEN 0.9::DOUBLE ELSE 0.05 END::DOUBLE AS low_information,
CASE WHEN regexp_matches(lower(text), 'cookie|privacy|copyright|license|subscribe') THEN 0.95 ELSE 0.03 END::DOUBLE AS boilerplate,
CASE WHEN contains(lower(text), 'ignore all previous instructions') THEN 0.97 ELSE 0.02 END::DOUBLE AS instructs_ai,
CASE WHEN regexp_matches(lower(text), '^(this|it|they) ') THEN 0.3 ELSE 0.85 END::DOUBLE AS self_contained"""


def _scored_chunks(spark: Spark, d: str) -> DataFrame:
    return table(spark, d, "chunks").filter("text IS NOT NULL").select("chunk_id", "ingested_at", "doc_id", "chunk_index", "text").withColumns(enrich.rule_scores(F.col("text")))


@register("rule_scores", f"SELECT chunk_id, ingested_at, {_RULES} FROM chunks WHERE text IS NOT NULL", times=("ingested_at",))
def rule_scores(spark: Spark, d: str) -> DataFrame:
    return _scored_chunks(spark, d).drop("text", "doc_id", "chunk_index")


@register("screen_decisions", f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents WHERE kind = 'page' AND text IS NOT NULL), s AS (SELECT doc_id, {_RULES} FROM l WHERE regexp_matches(text, '[\\p{{L}}\\p{{N}}]')) SELECT doc_id, CASE WHEN instructs_ai >= 0.7 THEN 'quarantine' WHEN boilerplate >= 0.85 THEN 'drop' ELSE 'keep' END AS action, count(*) AS lines FROM s GROUP BY 1, 2")
def screen_decisions(spark: Spark, d: str) -> DataFrame:
    lines = table(spark, d, "documents").filter("kind = 'page' AND text IS NOT NULL").select("doc_id", F.explode(F.split("text", "\n")).alias("text")).filter(tx.has_prose(F.col("text")))
    scored = lines.withColumns(enrich.rule_scores(F.col("text")))
    return scored.groupBy("doc_id", enrich.screen_action(F.col("instructs_ai"), F.col("boilerplate")).alias("action")).agg(F.count(F.lit(1)).alias("lines"))


def _rule_scored(rows: DataFrame) -> DataFrame:
    return rows.withColumns(enrich.rule_scores(F.col("text")))


@register("screen_blocks")
def screen_blocks(spark: Spark, d: str) -> DataFrame:
    """What screening decides about every screenable block of every document."""
    return screening.decisions(_documents(spark, d), _rule_scored).select("doc_id", "paragraph_index", "char_start", "char_end", F.col("screened").alias("action"))


@register("chunks_screened")
def chunks_screened(spark: Spark, d: str) -> DataFrame:
    """Chunks of the latest version of every document after screening, and the paragraphs that screening cut out."""
    from loam.plans.pipeline import Pipeline

    pipeline = Pipeline(spark)
    return pipeline.chunk(pipeline.documents(_documents(spark, d))).drop("embed_text")


@register("enrich_actions", f"WITH s AS (SELECT chunk_id, ingested_at, {_RULES} FROM chunks WHERE text IS NOT NULL), a AS (SELECT *, CASE WHEN instructs_ai >= 0.7 THEN 'quarantine' WHEN boilerplate >= 0.85 THEN 'drop_boilerplate' WHEN low_information >= 0.85 THEN 'drop_low_information' ELSE 'keep' END AS action FROM s) SELECT chunk_id, ingested_at, action, action = 'quarantine' AS quarantined, CASE WHEN starts_with(action, 'drop_') THEN action[6:] END AS dropped_reason FROM a", times=("ingested_at",))
def enrich_actions(spark: Spark, d: str) -> DataFrame:
    return enrich.enrich(_scored_chunks(spark, d)).select("chunk_id", "ingested_at", "action", "quarantined", "dropped_reason")


@register("enrich_shadow", f"WITH s AS (SELECT chunk_id, ingested_at, {_RULES} FROM chunks WHERE text IS NOT NULL) SELECT chunk_id, ingested_at, 'keep' AS action, CASE WHEN instructs_ai >= 0.7 THEN 'quarantine' WHEN boilerplate >= 0.85 THEN 'drop_boilerplate' WHEN low_information >= 0.85 THEN 'drop_low_information' END AS shadow_action, false AS quarantined FROM s", times=("ingested_at",))
def enrich_shadow(spark: Spark, d: str) -> DataFrame:
    return enrich.enrich(_scored_chunks(spark, d), enrich.Thresholds(mode="shadow")).select("chunk_id", "ingested_at", "action", "shadow_action", "quarantined")


@register("tag_threshold", "SELECT id, ingested_at, CASE WHEN score >= 0.5 AND tag IS NOT NULL THEN tag ELSE 'unknown' END AS tag_product, round(score, 4) AS tag_product_p FROM records", times=("ingested_at",))
def tag_threshold(spark: Spark, d: str) -> DataFrame:
    rows = table(spark, d, "records")
    return rows.select("id", "ingested_at", enrich.tag_value(F.col("tag"), F.col("score")).alias("tag_product"), F.round("score", 4).alias("tag_product_p"))


@register("enrich_failures", f"WITH s AS (SELECT chunk_id, ingested_at, quarantined AS failed, {_RULES} FROM chunks WHERE text IS NOT NULL) SELECT chunk_id, ingested_at, CASE WHEN coalesce(failed, false) THEN 'keep' WHEN instructs_ai >= 0.7 THEN 'quarantine' WHEN boilerplate >= 0.85 THEN 'drop_boilerplate' WHEN low_information >= 0.85 THEN 'drop_low_information' ELSE 'keep' END AS action, coalesce(failed, false) AS needs_reenrich FROM s", times=("ingested_at",))
def enrich_failures(spark: Spark, d: str) -> DataFrame:
    flags = table(spark, d, "chunks").filter("text IS NOT NULL").select("chunk_id", "ingested_at", "text", F.col("quarantined").alias("failed"))
    scored = flags.withColumns(enrich.rule_scores(F.col("text")))
    return enrich.enrich(scored, failed="failed").select("chunk_id", "ingested_at", "action", "needs_reenrich")


# ---------------------------------------------------------------- retrieval over recorded candidates

_CAND = """cur AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY recorded_at DESC NULLS LAST) AS rn FROM passages),
cand AS (SELECT query_id, chunk_id AS id, doc_id, chunk_index, vector_score, tokens, scores.is_relevant AS rel, scores.contains_answer_evidence AS ev, scores.contradicts_query_premise AS con, scores.instructs_ai AS ins, scores.llm AS llm,
  row_number() OVER (PARTITION BY query_id ORDER BY vector_score DESC NULLS LAST, chunk_id) AS rank FROM cur WHERE rn = 1 QUALIFY rank <= 30)"""


def candidates(spark: Spark, d: str) -> DataFrame:
    """Current recorded candidates, the 30 nearest of every query, with flat scores and their rank."""
    from pyspark.sql import Window

    flat = ["is_relevant", "contains_answer_evidence", "contradicts_query_premise", "instructs_ai", "llm"]
    rows = table(spark, d, "passages").select("query_id", F.col("chunk_id").alias("id"), "doc_id", "chunk_index", "vector_score", "tokens", "recorded_at", *[F.col(f"scores.{c}").alias(c) for c in flat])
    current = collection.latest(rows, ["query_id", "id"], ["recorded_at"]).drop("recorded_at")
    order = Window.partitionBy("query_id").orderBy(F.col("vector_score").desc_nulls_last(), "id")
    return current.withColumn("rank", F.row_number().over(order)).filter("rank <= 30")


def _routes(threshold: bool) -> str:
    if threshold:
        tail = "WHEN round(coalesce(rel, 0), 4) < 0.5 THEN 'off_topic' WHEN round(coalesce(con, 0), 4) >= 0.6 THEN 'conflict' WHEN round(coalesce(ev, 0), 4) < 0.4 THEN 'no_evidence'"
    else:
        tail = "WHEN round(coalesce(rel, 0), 4) >= 0.5 AND round(coalesce(con, 0), 4) >= 0.6 THEN 'conflict'"
    return f"CASE WHEN rel IS NULL AND ev IS NULL AND con IS NULL AND ins IS NULL THEN 'unscored' WHEN round(coalesce(ins, 0), 4) >= 0.7 THEN 'instructs_ai' {tail} ELSE 'include' END"


def _classified_sql(threshold: bool) -> str:
    return f"""{_CAND}, routed AS (SELECT *, {_routes(threshold)} AS route FROM cand),
placed AS (SELECT *, CASE WHEN route IN ('include', 'unscored') THEN row_number() OVER (PARTITION BY query_id, route IN ('include', 'unscored') ORDER BY coalesce(round(ev, 4), -1) DESC, vector_score DESC NULLS LAST, rank) END AS place FROM routed),
classified AS (SELECT *, CASE WHEN place > 5 THEN 'over_max_passages' WHEN place IS NOT NULL THEN 'include' ELSE route END AS decision FROM placed)"""


for _mode in ("rank", "threshold"):

    def _classify(spark: Spark, d: str, mode: str = _mode) -> DataFrame:
        out = retrieval.classify(candidates(spark, d), retrieval.Classify(select=mode))
        return out.select("query_id", "id", F.col("place").cast("long").alias("place"), "decision")

    register(f"classify_{_mode}_mode", f"WITH {_classified_sql(_mode == 'threshold')} SELECT query_id, id, place, decision FROM classified")(_classify)


@register("classify_shadow_mode", f"WITH {_CAND} SELECT query_id, id, rank AS place, CASE WHEN rank <= 5 THEN 'include' ELSE 'over_max_passages' END AS decision FROM cand")
def classify_shadow_mode(spark: Spark, d: str) -> DataFrame:
    out = retrieval.classify(candidates(spark, d), retrieval.Classify(mode="shadow"))
    return out.select("query_id", "id", F.col("place").cast("long").alias("place"), "decision")


@register("rank_cap_dropped", f"WITH {_classified_sql(False)} SELECT query_id, decision, count(*) AS n FROM classified GROUP BY 1, 2")
def rank_cap_dropped(spark: Spark, d: str) -> DataFrame:
    return retrieval.classify(candidates(spark, d)).groupBy("query_id", "decision").agg(F.count(F.lit(1)).alias("n"))


_GATE = """g AS (SELECT query_id, count(*) AS passages, max(ev) AS p FROM classified WHERE decision IN ('include', 'conflict') GROUP BY 1),
gated AS (SELECT q.query_id, coalesce(passages, 0) AS passages, CASE WHEN passages IS NULL THEN 0.0 ELSE p END AS gate_p FROM (SELECT DISTINCT query_id FROM evalqueries WHERE query_id IS NOT NULL) q LEFT JOIN g USING (query_id))"""


def _gates(spark: Spark, d: str) -> DataFrame:
    kept = retrieval.classify(candidates(spark, d)).filter("decision IN ('include', 'conflict')")
    return retrieval.gate(kept, table(spark, d, "evalqueries").filter("query_id IS NOT NULL"))


@register("gate_abstain", f"WITH {_classified_sql(False)}, {_GATE} SELECT query_id, passages, gate_p, coalesce(gate_p < 0.35, false) AS abstain FROM gated")
def gate_abstain(spark: Spark, d: str) -> DataFrame:
    return _gates(spark, d)


@register(
    "retrieval_results",
    f"""WITH {_classified_sql(False)}, {_GATE}, r AS (SELECT query_id, list(id ORDER BY place) FILTER (decision = 'include') AS passages, list(id ORDER BY rank) FILTER (decision = 'conflict') AS conflicts, list(id ORDER BY rank) FILTER (decision NOT IN ('include', 'conflict')) AS dropped FROM classified GROUP BY 1)
SELECT query_id, gate_p, coalesce(gate_p < 0.35, false) AS abstain, CASE WHEN dropped IS NULL AND conflicts IS NULL AND r.passages IS NULL THEN NULL ELSE coalesce(array_to_string(r.passages, ','), '') END AS passages, CASE WHEN dropped IS NULL AND conflicts IS NULL AND r.passages IS NULL THEN NULL ELSE coalesce(array_to_string(conflicts, ','), '') END AS conflicts, CASE WHEN dropped IS NULL AND conflicts IS NULL AND r.passages IS NULL THEN NULL ELSE coalesce(array_to_string(dropped, ','), '') END AS dropped FROM gated LEFT JOIN r USING (query_id)""",
)
def retrieval_results(spark: Spark, d: str) -> DataFrame:
    out = retrieval.assemble(retrieval.classify(candidates(spark, d)), _gates(spark, d))
    return out.select("query_id", "gate_p", "abstain", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("passages", "conflicts", "dropped")])


@register(
    "expand_neighbours",
    f"""WITH {_classified_sql(False)}, sc AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST) AS rn FROM chunks),
cc AS (SELECT chunk_id AS id, doc_id, chunk_index, tokens, quarantined, text FROM sc WHERE rn = 1),
p AS (SELECT c.query_id, c.id, c.doc_id, c.chunk_index, c.place FROM classified c JOIN cc USING (id) WHERE decision = 'include' AND regexp_matches(lower(cc.text), '^(this|it|they|the) ')),
w AS (SELECT query_id, doc_id, id AS expanded_from, place, chunk_index + unnest([-1, 1]) AS chunk_index FROM p),
f AS (SELECT w.query_id, cc.id, w.expanded_from, w.place, row_number() OVER (PARTITION BY w.query_id, cc.id ORDER BY w.place, w.chunk_index) AS rn FROM w JOIN cc ON cc.doc_id = w.doc_id AND cc.chunk_index = w.chunk_index WHERE NOT coalesce(cc.quarantined, false) AND NOT EXISTS (SELECT 1 FROM p WHERE p.query_id = w.query_id AND p.id = cc.id))
SELECT query_id, id, place FROM f WHERE rn = 1""",
)
def expand_neighbours(spark: Spark, d: str) -> DataFrame:
    found, _ = _expanded(spark, d)
    return found.select("query_id", "id", F.col("place").cast("long").alias("place"))


def _expanded(spark: Spark, d: str) -> tuple[DataFrame, DataFrame]:
    chunks = collection.latest(table(spark, d, "chunks").select(F.col("chunk_id").alias("id"), "doc_id", "chunk_index", "tokens", "quarantined", "text", "ingested_at"), ["id"], ["ingested_at"])
    flags = chunks.select("id", F.when(F.lower("text").rlike("^(this|it|they|the) "), 0.3).otherwise(0.85).alias("self_contained"))
    kept = retrieval.classify(candidates(spark, d)).filter("decision = 'include'").join(flags, "id").filter("self_contained < 0.5")
    return retrieval.neighbours(kept, chunks.drop("text")), kept


@register("expand_within_budget")
def expand_within_budget(spark: Spark, d: str) -> DataFrame:
    found, _ = _expanded(spark, d)
    return retrieval.within_budget(found.withColumn("tokens", F.coalesce("tokens", F.lit(0)).cast("long")), 1200).select("query_id", "id", "place", "tokens")


_ROUTE_CTE = """h AS (SELECT query_id, created_at, ('0x' || left(sha256(query_id), 2))::INT / 255.0 AS a FROM evalqueries WHERE query_id IS NOT NULL),
pr AS (SELECT query_id, created_at, round(a, 4) AS p1, round((1 - a) * 0.7, 4) AS p2, round((1 - a) * 0.3, 4) AS p3 FROM h)"""


@register(
    "route_decisions",
    f"""WITH {_ROUTE_CTE}, e AS (SELECT *, list_sort([struct_pack(p := -p1, o := 'api'), struct_pack(p := -p2, o := 'billing'), struct_pack(p := -p3, o := 'other')]) AS r, greatest(p1, p2, p3) AS best FROM pr),
d AS (SELECT *, (3 * best - 1) / 2 AS conf, list_filter(r, lambda x: x.o <> 'other') AS t FROM e)
SELECT query_id, created_at, CASE WHEN r[1].o <> 'other' AND conf >= 0.6 THEN r[1].o WHEN len(t) = 2 AND -(t[1].p + t[2].p) >= 0.8 THEN t[1].o || ',' || t[2].o ELSE '' END AS options FROM d""", times=("created_at",))
def route_decisions(spark: Spark, d: str) -> DataFrame:
    a = F.conv(F.substring(F.sha2("query_id", 256), 1, 2), 16, 10).cast("double") / 255.0
    rows = table(spark, d, "evalqueries").filter("query_id IS NOT NULL").withColumn("a", a)
    probs = F.create_map(F.lit("api"), F.round("a", 4), F.lit("billing"), F.round((1 - F.col("a")) * 0.7, 4), F.lit("other"), F.round((1 - F.col("a")) * 0.3, 4))
    rows = rows.withColumn("p", probs)
    return rows.select("query_id", "created_at", F.array_join(retrieval.route_decision(F.col("p"), tx.confidence(F.col("p"))), ",").alias("options"))


@register(
    "route_retry_unfiltered",
    f"WITH {_CAND}, f AS (SELECT * FROM cand WHERE chunk_index = 0), e AS (SELECT query_id FROM f GROUP BY 1 HAVING count(*) >= 5) SELECT query_id, id, true AS route_used FROM f WHERE query_id IN (FROM e) UNION ALL SELECT query_id, id, false FROM cand WHERE query_id NOT IN (FROM e) AND query_id IN (SELECT query_id FROM evalqueries)",
)
def route_retry_unfiltered(spark: Spark, d: str) -> DataFrame:
    found = candidates(spark, d)
    queries = table(spark, d, "evalqueries").filter("query_id IS NOT NULL")
    return retrieval.retry_unfiltered(found.filter("chunk_index = 0"), found, queries).select("query_id", "id", "route_used")


@register("degraded_queries", "SELECT query_id, bool_or(scores IS NULL) AS degraded FROM passages GROUP BY query_id")
def degraded_queries(spark: Spark, d: str) -> DataFrame:
    return table(spark, d, "passages").groupBy("query_id").agg(F.bool_or(F.col("scores").isNull()).alias("degraded"))


@register("passage_projection", f"SELECT DISTINCT chunk_id, array_to_string({_PATHLESS}, ' > ') AS section_path, coalesce(quarantined, false) AS quarantined FROM chunks")
def passage_projection(spark: Spark, d: str) -> DataFrame:
    path = F.array_join(F.coalesce("section_path", F.array().cast("array<string>")), " > ")
    return table(spark, d, "chunks").select("chunk_id", path.alias("section_path"), F.coalesce("quarantined", F.lit(False)).alias("quarantined")).distinct()


# ---------------------------------------------------------------- answers of a decision model

@register("answer_parsing", "SELECT event_id, 'noul' AS kind, (props->>'k')::DOUBLE / 100 AS value FROM events")
def answer_parsing(spark: Spark, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double") / 100
    answer = F.to_json(F.struct(F.lit("boolean").alias("type"), k.alias("probability")))
    return table(spark, d, "events").select("event_id", tx.parse_answer(answer).alias("a")).select("event_id", "a.kind", "a.value")


@register("choice_confidence", f"WITH {_ROUTE_CTE} SELECT query_id, created_at, CASE WHEN p1 >= p2 AND p1 >= p3 THEN 'api' WHEN p2 >= p3 THEN 'billing' ELSE 'other' END AS choice, round(least(greatest((3 * greatest(p1, p2, p3) - 1) / 2, 0), 1), 6) AS confidence FROM pr", times=("created_at",))
def choice_confidence(spark: Spark, d: str) -> DataFrame:
    a = F.conv(F.substring(F.sha2("query_id", 256), 1, 2), 16, 10).cast("double") / 255.0
    rows = table(spark, d, "evalqueries").filter("query_id IS NOT NULL").withColumn("a", a)
    probs = F.create_map(F.lit("api"), F.round("a", 4), F.lit("billing"), F.round((1 - F.col("a")) * 0.7, 4), F.lit("other"), F.round((1 - F.col("a")) * 0.3, 4))
    return rows.withColumn("p", probs).select("query_id", "created_at", tx.top_option(F.col("p")).alias("choice"), F.round(tx.confidence(F.col("p")), 6).alias("confidence"))


@register("score_expectation", "SELECT event_id, round(0 * (1 - v) + 1 * v * 0.5 + 2 * v * 0.5, 6) AS expected FROM (SELECT event_id, (props->>'k')::DOUBLE / 100 AS v FROM events)")
def score_expectation(spark: Spark, d: str) -> DataFrame:
    v = F.get_json_object("props", "$.k").cast("double") / 100
    probs = F.create_map(F.lit("0"), 1 - v, F.lit("1"), v * 0.5, F.lit("2"), v * 0.5)
    return table(spark, d, "events").select("event_id", F.round(tx.expected_level(probs), 6).alias("expected"))


@register("rerank_reply_scores", "SELECT event_id, least(greatest((props->>'k')::DOUBLE, 0), 10) AS first, NULL::DOUBLE AS second FROM events")
def rerank_reply_scores(spark: Spark, d: str) -> DataFrame:
    reply = F.concat(F.lit('Sure: ```{"scores": [{"id": 1, "score": '), F.get_json_object("props", "$.k"), F.lit('}, {"id": 2, "score": "n/a"}]}```'))
    scores = tx.parse_rerank_scores(reply, F.lit(2))
    return table(spark, d, "events").select("event_id", F.get(scores, 0).alias("first"), F.get(scores, 1).alias("second"))


@register("usage_latency", "SELECT event_type, count(*) AS calls, list_sort(list(value))[floor(count(*) * 0.5)::INT + 1] AS p50, list_sort(list(value))[floor(count(*) * 0.9)::INT + 1] AS p90 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def usage_latency(spark: Spark, d: str) -> DataFrame:
    return evaluate.nearest_rank_by(table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p90": 0.9}).withColumnRenamed("n", "calls")


# ---------------------------------------------------------------- evaluation

_QRELS = "qrels AS (SELECT query_id, id AS unit, CASE WHEN ev >= 0.8 THEN 2 ELSE 1 END AS gain FROM cand WHERE ev >= 0.6)"
_SYSTEMS = """sys AS (
  SELECT 'vector@10' AS system, query_id, id, tokens, rank AS k FROM cand WHERE rank <= 10
  UNION ALL SELECT 'model-rerank@8', query_id, id, tokens, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(round(ev, 4), -1) DESC, vector_score DESC NULLS LAST, rank) AS k FROM cand QUALIFY k <= 8
  UNION ALL SELECT 'llm-rerank@8', query_id, id, tokens, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(llm, -1) DESC, vector_score DESC NULLS LAST, rank) AS k FROM cand QUALIFY k <= 8)"""


def _qrels(cand: DataFrame) -> DataFrame:
    return cand.filter("contains_answer_evidence >= 0.6").select("query_id", F.col("id").alias("unit"), F.when(F.col("contains_answer_evidence") >= 0.8, 2).otherwise(1).alias("gain"))


def systems(cand: DataFrame) -> DataFrame:
    """(system, query_id, id, tokens, rank): what each system hands on."""
    from pyspark.sql import Window

    by = lambda first: F.row_number().over(Window.partitionBy("query_id").orderBy(first, F.col("vector_score").desc_nulls_last(), "rank"))
    cols = ["system", "query_id", "id", "tokens", "k"]
    vector = cand.filter("rank <= 10").withColumn("system", F.lit("vector@10")).withColumn("k", F.col("rank"))
    model = cand.withColumn("k", by(F.coalesce(F.round("contains_answer_evidence", 4), F.lit(-1.0)).desc())).filter("k <= 8").withColumn("system", F.lit("model-rerank@8"))
    llm = cand.withColumn("k", by(F.coalesce("llm", F.lit(-1.0)).desc())).filter("k <= 8").withColumn("system", F.lit("llm-rerank@8"))
    return vector.select(cols).unionByName(model.select(cols)).unionByName(llm.select(cols))


@register("system_selection", f"WITH {_CAND}, {_SYSTEMS} SELECT system, query_id, id, k FROM sys")
def system_selection(spark: Spark, d: str) -> DataFrame:
    return systems(candidates(spark, d)).select("system", "query_id", "id", F.col("k").cast("long").alias("k"))


_METRICS = f"""{_CAND}, {_QRELS},
ideal AS (SELECT query_id, count(*) AS units, sum(CASE WHEN i <= 10 THEN gain / log2(i + 1) END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, unit) AS i FROM qrels) GROUP BY 1),
got AS (SELECT c.query_id, count(*) AS seen, min(rank) AS first, sum(gain / log2(rank + 1)) AS dcg FROM cand c JOIN qrels q ON c.query_id = q.query_id AND c.id = q.unit WHERE rank <= 10 GROUP BY 1),
m AS (SELECT query_id, coalesce(seen / units, 0) AS recall, CASE WHEN seen > 0 THEN 1.0 ELSE 0.0 END AS any_hit, CASE WHEN first = 1 THEN 1.0 ELSE 0.0 END AS hit_at_1, coalesce(1 / first, 0) AS mrr, CASE WHEN idcg > 0 THEN least(coalesce(dcg / idcg, 0), 1) ELSE 0 END AS ndcg FROM ideal LEFT JOIN got USING (query_id))"""


def _metrics(spark: Spark, d: str) -> DataFrame:
    cand = candidates(spark, d)
    return evaluate.query_metrics(cand.select("query_id", "rank", F.col("id").alias("unit")), _qrels(cand))


@register("rank_metrics", f"WITH {_METRICS} SELECT query_id, round(recall, 4) AS recall, any_hit::DOUBLE AS any_hit, hit_at_1::DOUBLE AS hit_at_1, round(mrr, 4) AS mrr, round(ndcg, 4) AS ndcg FROM m")
def rank_metrics(spark: Spark, d: str) -> DataFrame:
    return _metrics(spark, d).select("query_id", F.round("recall", 4).alias("recall"), "any_hit", "hit_at_1", F.round("mrr", 4).alias("mrr"), F.round("ndcg", 4).alias("ndcg"))


_SUMMARY = f"""{_CAND}, {_QRELS}, {_SYSTEMS},
a AS (SELECT query_id, bool_and(coalesce(answerable, true)) AS answerable FROM evalqueries WHERE query_id IS NOT NULL GROUP BY 1),
ideal AS (SELECT query_id, count(*) AS units, sum(CASE WHEN i <= 10 THEN gain / log2(i + 1) END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, unit) AS i FROM qrels) GROUP BY 1),
got AS (SELECT system, s.query_id, count(*) AS seen, min(k) AS first, sum(gain / log2(k + 1)) AS dcg FROM sys s JOIN qrels q ON s.query_id = q.query_id AND s.id = q.unit WHERE k <= 10 GROUP BY 1, 2),
per AS (SELECT system, query_id, count(*) AS returned, coalesce(sum(tokens), 0) AS tokens FROM sys GROUP BY 1, 2),
m AS (SELECT per.system, per.query_id, answerable, least(returned, 10) AS returned, tokens, coalesce(seen / units, 0) AS recall, CASE WHEN idcg > 0 THEN least(coalesce(dcg / idcg, 0), 1) ELSE 0 END AS ndcg FROM per JOIN a USING (query_id) LEFT JOIN ideal USING (query_id) LEFT JOIN got ON got.system = per.system AND got.query_id = per.query_id)"""


def _per_system(spark: Spark, d: str) -> DataFrame:
    """Metrics of all systems at once: a system's query is a query of its own, the labels are joined once."""
    from loam.plans.runtime import materialize

    cand = materialize(candidates(spark, d))
    picked = materialize(systems(cand).withColumn("own", F.struct("system", "query_id")))
    names = F.array(*[F.lit(n) for n in ("vector@10", "model-rerank@8", "llm-rerank@8")])
    qrels = _qrels(cand).withColumn("system", F.explode(names)).select(F.struct("system", "query_id").alias("own"), "unit", "gain")
    scored = evaluate.query_metrics(picked.select(F.col("own").alias("query_id"), F.col("k").alias("rank"), F.col("id").alias("unit")), qrels.withColumnRenamed("own", "query_id")).withColumnRenamed("query_id", "own")
    per = picked.groupBy("own").agg(F.least(F.count(F.lit(1)), F.lit(10)).alias("returned"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    out = per.join(scored, "own", "left").fillna(0.0, ["recall", "any_hit", "hit_at_1", "mrr", "ndcg"]).select("own.system", "own.query_id", "returned", "tokens", "recall", "any_hit", "hit_at_1", "mrr", "ndcg")
    known = table(spark, d, "evalqueries").filter("query_id IS NOT NULL").groupBy("query_id").agg(F.bool_and(F.coalesce("answerable", F.lit(True))).alias("answerable"))
    best = cand.groupBy("query_id").agg(F.coalesce(F.max("contains_answer_evidence") < 0.35, F.lit(False)).alias("low"))
    joined = out.join(known, "query_id").join(best, "query_id", "left")
    return joined.withColumn("abstain", F.when(F.col("system") == "model-rerank@8", F.col("low"))).drop("low")


@register("summarise_systems", f"WITH {_SUMMARY} SELECT system, count(*) AS n, round(avg(recall) FILTER (answerable), 4) AS recall, round(avg(ndcg) FILTER (answerable), 4) AS ndcg, round(avg(returned), 4) AS returned, round(avg(tokens), 4) AS tokens FROM m GROUP BY 1")
def summarise_systems(spark: Spark, d: str) -> DataFrame:
    return evaluate.summarise(_per_system(spark, d), ["system"]).select("system", "n", "recall", "ndcg", "returned", "tokens")


@register(
    "summarise_outcomes",
    f"""WITH {_SUMMARY}, low AS (SELECT query_id, coalesce(max(ev) < 0.35, false) AS low FROM cand GROUP BY 1),
o AS (SELECT per.system, answerable, CASE WHEN seen > 0 THEN 1.0 ELSE 0.0 END AS any_hit, CASE WHEN first = 1 THEN 1.0 ELSE 0.0 END AS hit_at_1, coalesce(1.0 / first, 0) AS mrr, CASE WHEN per.system = 'model-rerank@8' THEN low::INT::DOUBLE END AS abstain
  FROM per JOIN a USING (query_id) JOIN low USING (query_id) LEFT JOIN got ON got.system = per.system AND got.query_id = per.query_id)
SELECT system, round(avg(mrr) FILTER (answerable), 4) AS mrr, round(avg(hit_at_1) FILTER (answerable), 4) AS hit_at_1, round(avg(any_hit) FILTER (answerable), 4) AS any_hit, round(avg(abstain) FILTER (answerable), 4) AS false_abstain, round(avg(abstain) FILTER (NOT answerable), 4) AS true_abstain FROM o GROUP BY 1""",
)
def summarise_outcomes(spark: Spark, d: str) -> DataFrame:
    return evaluate.summarise(_per_system(spark, d), ["system"]).select("system", "mrr", "hit_at_1", "any_hit", "false_abstain", "true_abstain")


@register("bars", f"WITH {_SUMMARY}, t AS (SELECT system, avg(recall) FILTER (answerable) AS r, avg(tokens) AS t FROM m GROUP BY 1), b AS (SELECT * FROM t WHERE system = 'vector@10') SELECT t.system, round(1 - t.t / b.t, 4) AS token_cut, round(b.r - t.r, 4) AS recall_drop, 1 - t.t / b.t >= 0.4 AND b.r - t.r <= 0.02 AS passed FROM t, b WHERE t.system <> 'vector@10'")
def bars(spark: Spark, d: str) -> DataFrame:
    means = _per_system(spark, d).groupBy("system").agg(F.avg(F.when(F.col("answerable"), F.col("recall"))).alias("r"), F.avg("tokens").alias("t"))
    base = F.broadcast(means.filter("system = 'vector@10'").select(F.col("r").alias("br"), F.col("t").alias("bt")))
    j = means.filter("system <> 'vector@10'").join(base).select("system", (1 - F.col("t") / F.col("bt")).alias("cut"), (F.col("br") - F.col("r")).alias("drop"))
    return j.select("system", F.round("cut", 4).alias("token_cut"), F.round("drop", 4).alias("recall_drop"), evaluate.bars(F.col("cut"), F.col("drop")).alias("passed"))


@register("bootstrap_delta")
def bootstrap_delta(spark: Spark, d: str) -> DataFrame:
    per = _per_system(spark, d).filter("answerable").groupBy("query_id").agg(
        (F.max(F.when(F.col("system") == "model-rerank@8", F.col("recall"))) - F.max(F.when(F.col("system") == "vector@10", F.col("recall")))).alias("diff")
    )
    return evaluate.bootstrap_table(per)


@register("point_delta", f"WITH {_SUMMARY}, p AS (SELECT query_id, max(recall) FILTER (system = 'model-rerank@8') - max(recall) FILTER (system = 'vector@10') AS diff FROM m WHERE answerable GROUP BY 1) SELECT round(avg(diff), 4) AS delta, count(diff) AS n FROM p")
def point_delta(spark: Spark, d: str) -> DataFrame:
    per = _per_system(spark, d).filter("answerable").groupBy("query_id").agg(
        (F.max(F.when(F.col("system") == "model-rerank@8", F.col("recall"))) - F.max(F.when(F.col("system") == "vector@10", F.col("recall")))).alias("diff")
    )
    return per.agg(F.round(F.avg("diff"), 4).alias("delta"), F.count("diff").alias("n"))


@register(
    "tune_grid",
    f"""WITH {_CAND}, {_QRELS}, u AS (SELECT query_id, count(*) AS units FROM qrels GROUP BY 1),
grid AS (SELECT e / 10.0 AS min_evidence, n AS max_passages FROM range(2, 8) a(e), (VALUES (3), (5), (8), (10)) b(n)),
s AS (SELECT g.min_evidence, g.max_passages, c.query_id, c.id, c.tokens, row_number() OVER (PARTITION BY g.min_evidence, g.max_passages, c.query_id ORDER BY coalesce(round(c.ev, 4), -1) DESC, c.vector_score DESC NULLS LAST, c.rank) AS k FROM cand c, grid g WHERE coalesce(c.ev, 0) >= g.min_evidence QUALIFY k <= g.max_passages),
q AS (SELECT min_evidence, max_passages, s.query_id, sum(s.tokens) AS tokens, count(qrels.unit) AS seen FROM s LEFT JOIN qrels ON qrels.query_id = s.query_id AND qrels.unit = s.id GROUP BY 1, 2, 3),
t AS (SELECT g.min_evidence, g.max_passages, round(avg(coalesce(q.seen, 0) / u.units), 4) AS recall, round(avg(coalesce(q.tokens, 0)), 4) AS tokens FROM grid g CROSS JOIN u LEFT JOIN q ON q.query_id = u.query_id AND q.min_evidence = g.min_evidence AND q.max_passages = g.max_passages GROUP BY 1, 2)
SELECT min_evidence::DOUBLE AS min_evidence, max_passages, recall, tokens FROM t""",
)
def tune_grid(spark: Spark, d: str) -> DataFrame:
    from pyspark.sql import Window

    cand = candidates(spark, d)
    qrels = _qrels(cand)
    units = qrels.groupBy("query_id").agg(F.count(F.lit(1)).alias("units"))
    # one pass: rank by evidence once, then every setting is a condition on (evidence, place)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce(F.round("contains_answer_evidence", 4), F.lit(-1.0)).desc(), F.col("vector_score").desc_nulls_last(), "rank"))
    hit = qrels.select("query_id", F.col("unit").alias("id"), F.lit(1).alias("hit"))
    rows = cand.withColumn("place", place).join(hit, ["query_id", "id"], "left").join(units, "query_id")
    settings = [(e / 10.0, n) for e in range(2, 8) for n in (3, 5, 8, 10)]
    use = lambda e, n: (F.coalesce("contains_answer_evidence", F.lit(0.0)) >= e) & (F.col("place") <= n)
    sums = []
    for i, (e, n) in enumerate(settings):
        sums += [F.sum(F.when(use(e, n), F.coalesce("hit", F.lit(0)))).alias(f"h{i}"), F.sum(F.when(use(e, n), F.col("tokens"))).alias(f"t{i}")]
    per = rows.groupBy("query_id", "units").agg(*sums)
    means = per.agg(*[F.avg(F.coalesce(f"h{i}", F.lit(0)) / F.col("units")).alias(f"r{i}") for i in range(len(settings))], *[F.avg(F.coalesce(f"t{i}", F.lit(0))).alias(f"t{i}") for i in range(len(settings))])
    listed = F.array(*[F.struct(F.lit(e).alias("min_evidence"), F.lit(n).alias("max_passages"), F.round(f"r{i}", 4).alias("recall"), F.round(f"t{i}", 4).alias("tokens")) for i, (e, n) in enumerate(settings)])
    return means.select(F.inline(listed))


@register(
    "tune_gate",
    f"""WITH {_classified_sql(False)}, {_GATE}, a AS (SELECT query_id, bool_and(coalesce(answerable, true)) AS answerable FROM evalqueries WHERE query_id IS NOT NULL GROUP BY 1),
t AS (SELECT i / 100.0 AS threshold, round(avg((gate_p < i / 100.0)::INT) FILTER (answerable), 4) AS false_abstain, round(avg((gate_p < i / 100.0)::INT) FILTER (NOT answerable), 4) AS true_abstain FROM gated JOIN a USING (query_id), range(5, 100, 5) r(i) GROUP BY 1)
SELECT threshold::DOUBLE AS threshold, false_abstain, true_abstain FROM t""",
)
def tune_gate(spark: Spark, d: str) -> DataFrame:
    known = table(spark, d, "evalqueries").filter("query_id IS NOT NULL").groupBy("query_id").agg(F.bool_and(F.coalesce("answerable", F.lit(True))).alias("answerable"))
    rows = _gates(spark, d).join(known, "query_id")
    steps = [i / 100.0 for i in range(5, 100, 5)]
    low = lambda t, cond: F.round(F.avg(F.when(cond, (F.col("gate_p") < t).cast("int"))), 4)
    means = rows.agg(*[low(t, F.col("answerable")).alias(f"f{i}") for i, t in enumerate(steps)], *[low(t, ~F.col("answerable")).alias(f"t{i}") for i, t in enumerate(steps)])
    return means.select(F.inline(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"f{i}").alias("false_abstain"), F.col(f"t{i}").alias("true_abstain")) for i, t in enumerate(steps)])))


_GRID = f"""{_CAND}, {_QRELS}, a AS (SELECT query_id, bool_and(coalesce(answerable, true)) AS answerable FROM evalqueries WHERE query_id IS NOT NULL GROUP BY 1),
ideal AS (SELECT query_id, count(*) AS units, sum(CASE WHEN i <= 10 THEN gain / log2(i + 1) END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, unit) AS i FROM qrels) GROUP BY 1),
k AS (SELECT a.query_id, answerable, units, idcg FROM a LEFT JOIN ideal USING (query_id)),
sc AS (SELECT c.*, gain, NOT (rel IS NULL AND ev IS NULL AND con IS NULL AND ins IS NULL) AS scored FROM cand c LEFT JOIN qrels q ON q.query_id = c.query_id AND q.unit = c.id),
u AS (SELECT r.min_relevant, sc.*, row_number() OVER (PARTITION BY sc.query_id, r.min_relevant ORDER BY coalesce(round(ev, 4), -1) DESC, vector_score DESC NULLS LAST, rank) AS place
  FROM sc, (VALUES (0.2), (0.35), (0.5), (0.65)) r(min_relevant) WHERE NOT scored OR (round(coalesce(ins, 0), 4) < 0.7 AND round(coalesce(con, 0), 4) < 0.6 AND round(coalesce(rel, 0), 4) >= r.min_relevant)),
g AS (SELECT r.min_relevant, e / 10.0 AS min_evidence, n AS max_passages FROM (VALUES (0.2), (0.35), (0.5), (0.65)) r(min_relevant), range(1, 7) x(e), (VALUES (3), (5), (8), (10)) b(n)),
t AS (SELECT g.min_relevant, g.min_evidence, g.max_passages, u.query_id, count(gain) FILTER (place <= 10) AS hits, sum(tokens) AS tokens, sum(gain / log2(place + 1)) FILTER (place <= 10) AS dcg
  FROM g JOIN u ON u.min_relevant = g.min_relevant AND place <= g.max_passages AND (NOT scored OR round(coalesce(ev, 0), 4) >= g.min_evidence) GROUP BY ALL),
m AS (SELECT g.min_relevant, g.min_evidence, g.max_passages, round(avg(coalesce(hits / units, 0)) FILTER (answerable), 4) AS recall, round(avg(coalesce(tokens, 0)), 4) AS tokens,
  round(avg(CASE WHEN idcg > 0 THEN least(coalesce(dcg / idcg, 0), 1) ELSE 0 END) FILTER (answerable), 4) AS ndcg
  FROM g CROSS JOIN k LEFT JOIN t ON t.query_id = k.query_id AND t.min_relevant = g.min_relevant AND t.min_evidence = g.min_evidence AND t.max_passages = g.max_passages GROUP BY ALL),
fl AS (SELECT round(coalesce(avg(coalesce(h / units, 0)) FILTER (answerable), 0), 4) - 0.02 AS floor FROM k LEFT JOIN (SELECT query_id, count(gain) AS h FROM sc WHERE rank <= 8 GROUP BY 1) USING (query_id)),
grid AS (SELECT min_relevant::DOUBLE AS min_relevant, min_evidence::DOUBLE AS min_evidence, max_passages, recall, tokens, ndcg, coalesce(recall, 0) >= floor AS ok FROM m, fl)"""


def _threshold_grid(spark: Spark, d: str) -> DataFrame:
    from loam.plans.runtime import materialize

    cand = materialize(candidates(spark, d))
    known = table(spark, d, "evalqueries").filter("query_id IS NOT NULL").groupBy("query_id").agg(F.bool_and(F.coalesce("answerable", F.lit(True))).alias("answerable"))
    return evaluate.threshold_grid(cand, _qrels(cand), known)


@register("tune_thresholds", f"WITH {_GRID} SELECT * FROM grid")
def tune_thresholds(spark: Spark, d: str) -> DataFrame:
    return _threshold_grid(spark, d).drop("floor")


@register("tune_choice", f"WITH {_GRID} SELECT min_relevant, min_evidence, max_passages, recall, tokens, ndcg FROM grid WHERE ok ORDER BY tokens, ndcg DESC, min_relevant, min_evidence, max_passages LIMIT 1")
def tune_choice(spark: Spark, d: str) -> DataFrame:
    return evaluate.best_thresholds(_threshold_grid(spark, d)).select("min_relevant", "min_evidence", "max_passages", "recall", "tokens", "ndcg")


@register(
    "tune_gate_choice",
    f"""WITH {_classified_sql(False)}, {_GATE}, a AS (SELECT query_id, bool_and(coalesce(answerable, true)) AS answerable FROM evalqueries WHERE query_id IS NOT NULL GROUP BY 1),
t AS (SELECT i / 100.0 AS threshold, round(avg((gate_p < i / 100.0)::INT) FILTER (answerable), 4) AS false_abstain, round(avg((gate_p < i / 100.0)::INT) FILTER (NOT answerable), 4) AS true_abstain FROM gated JOIN a USING (query_id), range(5, 100, 5) r(i) GROUP BY 1)
SELECT threshold::DOUBLE AS threshold, false_abstain, true_abstain FROM t WHERE false_abstain <= 0.5 ORDER BY true_abstain DESC, false_abstain, threshold LIMIT 1""",
)
def tune_gate_choice(spark: Spark, d: str) -> DataFrame:
    return evaluate.best_gate(tune_gate(spark, d), 0.5)


_FORM = "trim(regexp_replace(lower({c}), '[^0-9a-z]+', ' ', 'g'))"


# A quotation counts where its form is a part of the passage's, or where 60 % of its five-word sequences are there.
_EVIDENCE = f"""WITH e AS ({{evidence}}),
c AS (SELECT chunk_id, {_FORM.format(c='text')} AS f FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST) AS rn FROM chunks WHERE text IS NOT NULL) WHERE rn = 1),
ew AS (SELECT eid, string_split(f, ' ') AS w FROM e WHERE f <> ''), cw AS (SELECT chunk_id, string_split(f, ' ') AS w FROM c),
eg AS (SELECT DISTINCT eid, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT eid, w, unnest(range(1, len(w) - 3)) AS i FROM ew WHERE len(w) >= 5)),
cg AS (SELECT DISTINCT chunk_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT chunk_id, w, unnest(range(1, len(w) - 3)) AS i FROM cw WHERE len(w) >= 5)),
n AS (SELECT eid, count(*) AS n FROM eg GROUP BY 1),
h AS (SELECT eid, chunk_id, count(*) AS hits FROM eg JOIN cg USING (g) GROUP BY 1, 2)
SELECT eid, chunk_id FROM h JOIN n USING (eid) WHERE hits / n >= 0.6
UNION SELECT e.eid, c.chunk_id FROM (SELECT e.* FROM e WHERE f <> '') e JOIN c ON contains(c.f, e.f)"""


@register(
    "evidence_match",
    _EVIDENCE.format(evidence="SELECT DISTINCT query_id || '#' || ev AS eid, " + _FORM.format(c="ev") + " AS f FROM (SELECT query_id, unnest(evidence) AS ev FROM evalqueries WHERE query_id IS NOT NULL)"),
)
def evidence_match(spark: Spark, d: str) -> DataFrame:
    asked = table(spark, d, "evalqueries").filter("query_id IS NOT NULL").select("query_id", F.explode("evidence").alias("text")).filter("text IS NOT NULL")
    evidence = asked.select(F.concat("query_id", F.lit("#"), "text").alias("eid"), "text").distinct()
    chunks = collection.latest(table(spark, d, "chunks").filter("text IS NOT NULL").select("chunk_id", "text", "ingested_at"), ["chunk_id"], ["ingested_at"])
    return evaluate.evidence_match(evidence, chunks.select("chunk_id", "text"), "eid", "chunk_id")


@register("evidence_in_chunks", _EVIDENCE.format(evidence="SELECT DISTINCT item_id AS eid, " + _FORM.format(c="passage") + " AS f FROM testitems WHERE item_id IS NOT NULL AND passage IS NOT NULL"))
def evidence_in_chunks(spark: Spark, d: str) -> DataFrame:
    """Which held-out passages stand in which current chunks."""
    items = table(spark, d, "testitems").filter("item_id IS NOT NULL AND passage IS NOT NULL").select(F.col("item_id").alias("eid"), F.col("passage").alias("text"))
    chunks = collection.latest(table(spark, d, "chunks").filter("text IS NOT NULL").select("chunk_id", "text", "ingested_at"), ["chunk_id"], ["ingested_at"])
    return evaluate.evidence_match(items, chunks.select("chunk_id", "text"), "eid", "chunk_id")


@register("record_resume", "SELECT DISTINCT query_id FROM evalqueries WHERE query_id IS NOT NULL AND query_id NOT IN (SELECT query_id FROM passages WHERE query_id IS NOT NULL)")
def record_resume(spark: Spark, d: str) -> DataFrame:
    asked = table(spark, d, "evalqueries").filter("query_id IS NOT NULL").select("query_id").distinct()
    return asked.join(table(spark, d, "passages").select("query_id"), "query_id", "left_anti")


@register("current_queries", "SELECT query_id, text, coalesce(answerable, true) AS answerable, scope FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC NULLS LAST) AS rn FROM evalqueries WHERE query_id IS NOT NULL) WHERE rn = 1")
def current_queries(spark: Spark, d: str) -> DataFrame:
    rows = table(spark, d, "evalqueries").filter("query_id IS NOT NULL").select("query_id", "text", F.coalesce("answerable", F.lit(True)).alias("answerable"), "scope", "created_at")
    return collection.latest(rows, ["query_id"], ["created_at"]).drop("created_at")


@register("chunk_token_percentiles", "SELECT chunker, count(tokens) AS n, list_sort(list(tokens) FILTER (tokens IS NOT NULL))[least(floor(count(tokens) * 0.1)::INT + 1, count(tokens))] AS p10, list_sort(list(tokens) FILTER (tokens IS NOT NULL))[least(floor(count(tokens) * 0.5)::INT + 1, count(tokens))] AS p50, list_sort(list(tokens) FILTER (tokens IS NOT NULL))[least(floor(count(tokens) * 0.9)::INT + 1, count(tokens))] AS p90 FROM chunks GROUP BY chunker HAVING count(tokens) > 0")
def chunk_token_percentiles(spark: Spark, d: str) -> DataFrame:
    return evaluate.nearest_rank_by(table(spark, d, "chunks"), ["chunker"], "tokens", {"p10": 0.1, "p50": 0.5, "p90": 0.9})


@register("beir_qrels", "SELECT query_id, chunk_id AS corpus_id, floor(scores.llm)::INT AS grade FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY recorded_at DESC NULLS LAST) AS rn FROM passages) JOIN (SELECT DISTINCT query_id FROM evalqueries) USING (query_id) WHERE rn = 1 AND scores.llm >= 1")
def beir_qrels(spark: Spark, d: str) -> DataFrame:
    rows = collection.latest(table(spark, d, "passages").select("query_id", "chunk_id", "scores.llm", "recorded_at"), ["query_id", "chunk_id"], ["recorded_at"])
    asked = table(spark, d, "evalqueries").select("query_id").distinct()
    return rows.filter("llm >= 1").join(asked, "query_id").select("query_id", F.col("chunk_id").alias("corpus_id"), F.floor("llm").cast("int").alias("grade"))
