"""Cutting oversized texts at natural boundaries.

Every gap between two tokens has a strength: section heading above paragraph above line above
sentence above clause above word. A sparse table answers in constant time where the strongest gap of
a range is, the rightmost of equal ones. From the start of a piece the range of permissible ends is
known from running sizes, so each cut is one query; the next piece starts ``overlap`` tokens before
the cut, or at the strongest end of a sentence or more that a second query finds in the later half of the overlap. Sizes are those of the token estimate: runs of
letters, digits and underscores, other non-blank characters, and half the long runs, rounded down.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.sentences import sentences

#: Runs longer than this count one half more.
LONG_RUN = 8
#: The least share of the limit a piece should fill before a boundary may end it.
LEAST_FILL = 0.5

_PIECE = re.compile(r"\w+|[^\w\s]")
_STRENGTH = {"section": 6, "paragraph": 5, "line": 4, "sentence": 3, "clause": 2, "word": 1}
_HEADING = re.compile(r"^(?:#{1,6} \S|={1,6}[^=\n]+={1,6}\s*$|\\(?:sub)*section\b|<h[1-6]\b)", re.M | re.I)


def estimated_tokens(text: Column) -> Column:
    """The size of a text as a Catalyst expression; a missing text has size 0."""
    runs = F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+"))
    others = F.regexp_count(text, F.lit(r"[^\p{L}\p{N}_\s\p{Z}\x85]"))
    long_runs = F.regexp_count(text, F.lit(rf"[\p{{L}}\p{{N}}_]{{{LONG_RUN + 1},}}"))
    return F.coalesce(runs + others + F.floor(long_runs / 2), F.lit(0)).cast("long")


_RUNS = re.compile(r"[^\W]+")


def size(text: str) -> int:
    """The same for one Python string. Combining marks are not part of a run."""
    tokens = _tokens(text)
    return len(tokens) + sum(t[2] for t in tokens) // 2


def _tokens(text: str) -> list[tuple[int, int, int]]:
    """(start, end, is it a long run) of every counted token."""
    return [(m.start(), m.end(), int(m.end() - m.start() > LONG_RUN and (m[0][0].isalnum() or m[0][0] == "_"))) for m in _PIECE.finditer(text)]


class RangeMaximum:
    """Sparse table: the place of the largest value in [a, b), the rightmost of equal ones."""

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        self.values = values
        self.levels = [np.arange(n)]
        width = 1
        while 2 * width <= n:
            left, right = self.levels[-1][: n - 2 * width + 1], self.levels[-1][width : n - width + 1]
            self.levels.append(np.where(values[left] > values[right], left, right))
            width *= 2

    def place(self, a: int, b: int) -> int:
        level = (b - a).bit_length() - 1
        left, right = self.levels[level][a], self.levels[level][b - (1 << level)]
        return int(left if self.values[left] > self.values[right] else right)


def boundary_strengths(text: str, tokens: list[tuple[int, int, int]], lang: str | None = None) -> np.ndarray:
    """Strength of the gap before each token (index 0 to n); the ends of the text are sections."""
    n = len(tokens)
    strength = np.ones(n + 1, np.int8)
    strength[0] = strength[n] = _STRENGTH["section"]
    starts = np.array([t[0] for t in tokens])
    for _, end in sentences(text, lang):
        i = int(np.searchsorted(starts, end))
        if i < n:
            strength[i] = max(strength[i], _STRENGTH["sentence"])
    headings = {m.start() for m in _HEADING.finditer(text)}
    for i in range(1, n):
        gap = text[tokens[i - 1][1] : tokens[i][0]]
        if not gap:
            strength[i] = 0 if strength[i] < _STRENGTH["sentence"] else strength[i]
        if "\n" in gap:
            strength[i] = _STRENGTH["paragraph"] if gap.count("\n") > 1 else max(strength[i], _STRENGTH["line"])
            if tokens[i][0] in headings:
                strength[i] = _STRENGTH["section"]
        elif strength[i] < _STRENGTH["clause"] and text[tokens[i - 1][0]] in ",;:—–，；：、،":
            strength[i] = _STRENGTH["clause"]
    return strength


def cut(text: str, limit: int, overlap: int = 0, lang: str | None = None) -> list[tuple[int, int]]:
    """Pieces of a text as (start, end) offsets, each of at most ``limit`` tokens.

    A text within the limit is one piece without its outer blanks; an empty one gives none. Neighbours share
    at most ``overlap`` tokens, and at least half as many; an overlap that leaves no room for a piece of its own is
    one token less than the limit. A single token is never cut.
    """
    tokens = _tokens(text)
    n = len(tokens)
    if not n:
        return []
    limit = max(int(limit), 1)
    overlap = max(0, min(int(overlap), limit - 1))
    longs = np.concatenate([[0], np.cumsum([t[2] for t in tokens])])
    halves = 2 * np.arange(n + 1) + longs  # twice the size, but for the rounding
    fits = lambda a: int(np.searchsorted(halves, halves[a] + 2 * limit + 1, side="right")) - 1
    if fits(0) >= n:
        return [(tokens[0][0], tokens[-1][1])]
    strength = boundary_strengths(text, tokens, lang)
    table = RangeMaximum(strength)
    filled = 2 * max(limit * LEAST_FILL, overlap + 1)
    out, a = [], 0
    while True:
        last = max(fits(a), a + 1)
        if last >= n:
            out.append((tokens[a][0], tokens[-1][1]))
            return out
        least = int(np.searchsorted(halves, halves[a] + filled))
        b = table.place(min(max(least, a + 1), last), last + 1)
        out.append((tokens[a][0], tokens[b - 1][1]))
        start = b
        if overlap:
            start = min(int(np.searchsorted(halves, halves[b] - 2 * overlap)), b)
            later = min(int(np.searchsorted(halves, halves[b] - overlap)), b - 1)
            if start < later and strength[best := table.place(start, later + 1)] >= _STRENGTH["sentence"]:
                start = best
        a = max(start, a + 1)


_TITLES = re.compile(r"^(?:(#{1,6})[ \t]+(.*?)[ \t]*#*|(={1,6})[ \t]*([^=\n]+?)[ \t]*=+)[ \t]*$", re.M)


def paths(text: str, starts: list[int], path: list[str] | None) -> list[list[str] | None]:
    """Section path of every piece: the given one, then the headings of the text that its start lies below.

    A heading that the given path ends with is not repeated. Without headings, and for a piece in front of the first
    of them, the given path is kept as it is, also where it is missing.
    """
    found = [(m.start(), len(m[1] or m[3]), (m[2] or m[4] or "").strip()) for m in _TITLES.finditer(text)]
    out: list[list[str] | None] = []
    trail: list[tuple[int, str]] = []
    at = 0
    for start in starts:
        while at < len(found) and found[at][0] <= start:
            level, title = found[at][1:]
            trail = [t for t in trail if t[0] < level] + [(level, title)]
            at += 1
        titles = [t for _, t in trail if t]
        if titles and path and path[-1] == titles[0]:
            titles = titles[1:]
        out.append([*(path or []), *titles] if titles else path)
    return out


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "piece_index", "piece_start", "piece_end", "piece_tokens", "section_path", "piece_text"]
    for batch in batches:
        picks, index, starts, ends, sizes, sections, texts = [], [], [], [], [], [], []
        columns = [batch.column(c).to_pylist() for c in ("text", "max_tokens", "overlap_tokens", "lang", "section_path")]
        for row, (text, limit, overlap, lang, path) in enumerate(zip(*columns, strict=True)):
            made = cut(text, limit, overlap, lang)
            sections.extend(paths(text, [a for a, _ in made], path))
            for k, (a, b) in enumerate(made):
                picks.append(row)
                index.append(k)
                starts.append(a)
                ends.append(b)
                texts.append(text[a:b])
                sizes.append(size(texts[-1]))
        arrays = [batch.column("id").take(pa.array(picks, pa.int64())), pa.array(index, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(sizes, pa.int64())]
        yield pa.record_batch([*arrays, pa.array(sections, pa.list_(pa.string())), pa.array(texts, pa.string())], names=names)


PIECES = "id long, piece_index int, piece_start long, piece_end long, piece_tokens long, section_path array<string>, piece_text string"


#: Configurations there may be; the table is broadcast.
MAX_CONFIGS = 10_000


def with_limits(rows: DataFrame, configs: DataFrame) -> DataFrame:
    """Add ``max_tokens`` and ``overlap_tokens``; a missing or unknown config_id means the default configuration.

    Of several defaults the one with the smallest id counts; without a default such rows have no limit.
    """
    listed = configs.filter("config_id IS NOT NULL").select("config_id", "max_tokens", "overlap_tokens", "is_default").limit(MAX_CONFIGS + 1).collect()
    if len(listed) > MAX_CONFIGS:
        raise ValueError(f"at most {MAX_CONFIGS} configurations")
    default = min((r for r in listed if r.is_default), key=lambda r: r.config_id, default=None)
    known = {r.config_id: (r.config_id, r.max_tokens, r.overlap_tokens) for r in sorted(listed, key=lambda r: (r.max_tokens is None, r.max_tokens or 0), reverse=True)}
    small = F.broadcast(rows.sparkSession.createDataFrame(list(known.values()), "config_id int, max_tokens int, overlap_tokens int"))
    fallback = lambda c: F.lit(getattr(default, c) if default else None).cast("int")
    return rows.join(small, "config_id", "left").withColumns(
        {"max_tokens": F.coalesce("max_tokens", fallback("max_tokens")), "overlap_tokens": F.coalesce("overlap_tokens", fallback("overlap_tokens"), F.lit(0))}
    )


def oversized(rows: DataFrame) -> DataFrame:
    """Rows (id, text, max_tokens, ...) whose text is larger than their limit; a missing text or limit is not."""
    return rows.filter(estimated_tokens(F.col("text")) > F.col("max_tokens"))


def pieces(rows: DataFrame, checked: bool = False) -> DataFrame:
    """Pieces of oversized rows (id, text, lang, section_path, max_tokens, overlap_tokens); see ``PIECES``.

    Only oversized rows are sent to Python; the others give no pieces. ``checked`` rows are known to be oversized. No shuffle.
    """
    large = rows if checked else oversized(rows)
    return large.select("id", "text", "lang", "section_path", "max_tokens", "overlap_tokens").mapInArrow(_cut_rows, PIECES)
