"""Scalar text functions as Catalyst expressions: identity, hashing, sizes, rendering.

Every function takes and returns Columns and stays inside generated code; none needs Python workers.
White space means the Unicode white space that Python strips, spelt out because Java's ``\\s`` is ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The namespace of record ids, the separator inside names, white-space classes.
RECORD_NAMESPACE = "5b0f3a528f0e4b8e9d2a6a1e2c7b9f40"
UNIT_SEPARATOR = "\x1f"
BLANKS = r"[\s\x0B\x1c-\x1f\x85\p{Z}]"
LINE_BLANKS = r"[ \t\f\x0B\x1c-\x1f\x85\p{Z}]"
WORD_RUN = r"[\p{L}\p{N}_]+"
OTHER_MARK = r"[^\p{L}\p{N}_\s\x0B\x1c-\x1f\x85\p{Z}]"
LONG_RUN = r"[\p{L}\p{N}_]{9,}"


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.regexp_replace(text, rf"^{BLANKS}+|{BLANKS}+\z", "")


def normalise_text(text: Column) -> Column:
    """Line feeds only, no blanks at line ends, no empty lines at either end."""
    unix = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    bare = F.regexp_replace(unix, rf"{LINE_BLANKS}+(\n|\z)", "$1")
    return F.regexp_replace(bare, r"^\n+|\n+\z", "")


def content_hash(text: Column) -> Column:
    return F.sha2(normalise_text(text), 256)


def blank_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def resolved_id(doc_id: Column, source_uri: Column, text: Column) -> Column:
    """The given id, else the address, else a digest of the text."""
    digest = F.concat(F.lit("sha256:"), F.substring(content_hash(text), 1, 32))
    return F.coalesce(blank_to_null(doc_id), blank_to_null(source_uri), digest)


def doc_hash(text: Column, title: Column) -> Column:
    """Changes when text or title change; decides whether a document is ingested again."""
    return F.substring(F.sha2(F.concat(normalise_text(text), F.lit(UNIT_SEPARATOR), F.coalesce(title, F.lit(""))), 256), 1, 32)


def uuid5(name: Column, namespace_hex: str = RECORD_NAMESPACE) -> Column:
    """Version-5 UUID of a name in a namespace, as the canonical string."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(digest, a, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def record_id(doc_id: Column, text_hash: Column) -> Column:
    return uuid5(F.concat(doc_id, F.lit(UNIT_SEPARATOR), text_hash))


def token_estimate(text: Column) -> Column:
    """Word runs and other marks, plus half of the runs longer than eight characters, rounded down."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    return (count(WORD_RUN) + count(OTHER_MARK) + F.floor(count(LONG_RUN) / 2)).cast("long")


def request_token_estimate(text: Column) -> Column:
    return (F.floor(F.length(text) / 3) + 8).cast("long")


def has_prose(text: Column) -> Column:
    """Is there any letter or digit?"""
    return text.rlike(r"[\p{L}\p{N}]")


def heading_trail(title: Column, path: Column) -> Column:
    """``title > section > ...``; the title is not repeated where the path starts with it."""
    same = F.lower(strip(F.get(path, F.lit(0)))) == F.lower(strip(title))
    lead = F.when((F.coalesce(title, F.lit("")) != "") & ~F.coalesce(same, F.lit(False)), F.array(title)).otherwise(F.array().cast("array<string>"))
    parts = F.concat(lead, F.coalesce(path, F.array().cast("array<string>")))
    return F.array_join(F.filter(parts, lambda p: p != ""), " > ")


def embed_text(title: Column, path: Column, body: Column) -> Column:
    trail = heading_trail(title, path)
    return F.when(trail != "", F.concat(trail, F.lit("\n\n"), body)).otherwise(body)


def citation(title: Column, doc_id: Column, source_uri: Column, path: Column) -> Column:
    """``title > section (source)`` without repeating the title."""
    name = F.coalesce(blank_to_null(title), doc_id)
    path = F.coalesce(path, F.array().cast("array<string>"))
    same = F.coalesce(F.lower(strip(F.get(path, F.lit(0)))) == F.lower(strip(name)), F.lit(False))
    rest = F.when(same, F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(1)))).otherwise(path)
    where = F.array_join(rest, " > ")
    return F.concat(name, F.when(where != "", F.concat(F.lit(" > "), where)).otherwise(""), F.lit(" ("), F.coalesce(blank_to_null(source_uri), doc_id), F.lit(")"))


def attribute_escape(text: Column) -> Column:
    for mark, by in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;")):
        text = F.replace(text, F.lit(mark), F.lit(by))
    return text


def passage_block(number: Column, source: Column, text: Column, most_chars: int = 4000) -> Column:
    """One numbered, cited passage as the model is shown it."""
    return F.concat(F.lit('<passage id="'), number.cast("string"), F.lit('" source="'), attribute_escape(source), F.lit('">\n'), F.left(text, F.lit(most_chars)), F.lit("\n</passage>"))


def collapse_blank_lines(text: Column) -> Column:
    """Runs of two or more empty lines become one; the ends are stripped."""
    return strip(F.regexp_replace(text, r"\n[ \t]*\n(?:[ \t]*\n)+", "\n\n"))


def blank_out(text: Column, start: Column, end: Column) -> Column:
    """Put as many blanks in place of [start, end), so that offsets stay valid."""
    return F.overlay(text, F.repeat(F.lit(" "), (end - start).cast("int")), start + 1, end - start)


def safe_name(name: Column, most_chars: int = 48) -> Column:
    bare = F.lower(F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9_]", "_"), r"^_+|_+\z", ""))
    return F.left(F.coalesce(blank_to_null(bare), F.lit("default")), F.lit(most_chars))


def evidence_form(text: Column) -> Column:
    """Lower case, everything but a-z and 0-9 becomes one blank."""
    return F.trim(F.regexp_replace(F.lower(text), "[^0-9a-z]+", " "))


def loose_form(text: Column) -> Column:
    """Lower case, curly quotes and dashes folded, white space collapsed."""
    plain = F.translate(text, "‘’“”–—", "''\"\"--")
    return F.lower(F.trim(F.regexp_replace(plain, f"{BLANKS}+", " ")))


def similarity(raw: Column, metric: str, is_distance: bool = False) -> Column:
    """A score in [0, 1]: 1 / (1 + d) for Euclidean distance, else the clamped similarity; NaN is 0."""
    value = raw.cast("double")
    if metric == "l2":
        score = 1 / (1 + F.greatest(value, F.lit(0.0)))
    else:
        score = F.least(F.greatest(1 - value if is_distance else value, F.lit(0.0)), F.lit(1.0))
    return F.when(F.isnan(value) | value.isNull(), F.lit(0.0)).otherwise(score)


# ---------------------------------------------------------------- answers of the decision model

def top_option(probabilities: Column) -> Column:
    """The most probable option of a map; of equal ones the first in the alphabet."""
    entries = F.map_entries(probabilities)
    best = F.array_max(F.transform(entries, lambda e: e["value"]))
    return F.array_min(F.transform(F.filter(entries, lambda e: e["value"] == best), lambda e: e["key"]))


def confidence(probabilities: Column) -> Column:
    """(n * p - 1) / (n - 1) of the largest probability, in [0, 1]; a single option is certain."""
    n = F.size(probabilities)
    p = F.array_max(F.map_values(probabilities))
    return F.when(n < 2, F.lit(1.0)).otherwise(F.least(F.greatest((n * p - 1) / (n - 1), F.lit(0.0)), F.lit(1.0)))


def expected_level(probabilities: Column) -> Column:
    """Sum of level times probability."""
    return F.aggregate(F.map_entries(probabilities), F.lit(0.0), lambda acc, e: acc + e["key"].cast("double") * e["value"])


def parse_answer(answer: Column) -> Column:
    """STRUCT<kind, value, choice, probabilities, confidence> of one JSON answer; both spellings of a yes/no answer."""
    shape = "type string, noul double, probability double, choice string, score double, confidence double, probabilities map<string,double>"
    parsed = F.from_json(answer, shape)
    levels = parsed["probabilities"]
    return F.struct(
        F.when(parsed["type"] == "boolean", "noul").otherwise(parsed["type"]).alias("kind"),
        F.coalesce(parsed["noul"], parsed["probability"], parsed["score"], F.when(parsed["type"] == "score", expected_level(levels))).alias("value"),
        F.coalesce(parsed["choice"], F.when(parsed["type"] == "choice", top_option(levels))).alias("choice"),
        levels.alias("probabilities"),
        F.coalesce(parsed["confidence"], F.when(F.size(levels) > 0, confidence(levels))).alias("confidence"),
    )


def parse_rerank_scores(reply: Column, n: Column) -> Column:
    """Scores 0..10 by position out of a model's reply; missing or unreadable ones are null."""
    body = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    items = F.from_json(body, "scores array<struct<id: string, score: string>>")["scores"]
    place = lambda i: F.filter(items, lambda x: x["id"].try_cast("double").cast("int") == i)
    at = lambda i: F.get(place(i), F.size(place(i)) - 1)["score"].try_cast("double")
    clamp = lambda s: F.when(s.isNotNull(), F.least(F.greatest(s, F.lit(0.0)), F.lit(10.0)))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: clamp(at(i)))).otherwise(F.array().cast("array<double>"))
