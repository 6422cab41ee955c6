"""Held-out items that leak into documents: rare n-gram seeds, then Smith-Waterman alignment.

Texts are sequences of folded words; scripts without spaces give one token per character. The first
pass over the documents counts in how many of them each five-token sequence of the items occurs.
An item's seeds are its rare sequences, and in every stretch of ``STRETCH`` sequences the rarest
few in any case, so an item that leaked everywhere still has seeds. The second pass looks the
seeds up in every document and aligns the item with the part of the document around them. A
document holds an item if the best local alignment covers at least ``LEAST_COVER`` of the item's
tokens and at least ``LEAST_IDENTITY`` of the covered tokens are equal.

The items are a stated query set: they are taken in blocks of ``BLOCK`` and shipped with the tasks;
documents are never shuffled, and only counts of item sequences travel.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.plans.runtime import spread

GRAM = 5
BLOCK = 2_000
#: A sequence in at most this share of the documents (and always one in at most ``FEW`` documents) is rare.
RARE_SHARE = 0.0005
FEW = 20
STRETCH = 6
IN_STRETCH = 3
#: Least share of an item's sequences that must lie near one diagonal of a document before they are aligned.
LEAST_SHARED = 0.14
#: Least stretch of the item between the first and the last of them, as a share of its tokens.
LEAST_SPAN = 0.34
#: Tokens at the ends of a covered part that need not belong to a whole sequence.
LOOSE_ENDS = 12
#: Diagonals that count as near: words put in or left out between two sequences.
BAND = 24
LEAST_COVER = 0.47
LEAST_IDENTITY = 0.84
MATCH, MISMATCH, GAP = 1.0, -2.0, -2.0

_UNSPACED = "฀-๿຀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ"
_TOKEN = re.compile(rf"[{_UNSPACED}]|[^\W_{_UNSPACED}]+")
_PLAIN = re.compile(r"[^\W_]+")
_HAS_UNSPACED = re.compile(rf"[{_UNSPACED}]")
# Markup that would stand between the words of a passage.
_MARKUP = re.compile(
    r"<ref\b[^>]*>.*?</ref>|</?[A-Za-z][^<>]*>|!\[[^\]]*\]\([^)]*\)|\]\([^)\s]*\)|\[\[[^\]|]*\||\[https?://\S+ |\\(?:cite|label|ref)\{[^}]*\}|\\href\{[^}]*\}|\\[A-Za-z]+\*?|&(?:[a-z]+|#\d+);",
    re.S,
)


def tokens(text: str) -> list[str]:
    """Folded words, or characters of scripts without spaces; punctuation and spacing are dropped."""
    low = text.lower().replace("ß", "ss")
    return _TOKEN.findall(low) if _HAS_UNSPACED.search(low) else _PLAIN.findall(low)


class Items:
    """A block of distinct passages with their token numbers and hashed sequences."""

    def __init__(self, passages: list[str]) -> None:
        self.words: dict[str, int] = {}
        self.seqs = [np.array([self.words.setdefault(w, len(self.words) + 1) for w in tokens(p)], np.int64) for p in passages]
        hashes, owners, places = [], [], []
        for i, seq in enumerate(self.seqs):
            h = sequence_hashes(seq)
            hashes.append(h)
            owners.append(np.full(len(h), i))
            places.append(np.arange(len(h)))
        cat = lambda xs, t: np.concatenate(xs).astype(t) if xs else np.zeros(0, t)
        self.hash, self.owner, self.place = cat(hashes, np.int64), cat(owners, np.int64), cat(places, np.int64)
        self.grams = np.unique(self.hash)
        self.short = [i for i, seq in enumerate(self.seqs) if 0 < len(seq) < GRAM]

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.words.get, words, repeat(0)), np.int64, len(words))


def sequence_hashes(numbers: np.ndarray) -> np.ndarray:
    """Hashes of all runs of ``GRAM`` token numbers."""
    n = len(numbers) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(GRAM):
            h = (h ^ numbers[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _lookup(items: Items, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Known sequences of a batch: (text number, place in its text, gram number) and every text's numbers."""
    seqs = [items.numbers(tokens(_MARKUP.sub(" ", t) if any(c in t for c in "<[\\&") else t)) for t in texts]
    sizes = np.array([len(s) + GRAM for s in seqs])
    flat = np.zeros(int(sizes.sum()), np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for start, seq in zip(starts, seqs, strict=True):
        flat[start : start + len(seq)] = seq
    known = flat > 0
    run = known[: len(known) - GRAM + 1].copy()
    for k in range(1, GRAM):
        run &= known[k : len(known) - GRAM + 1 + k]
    at = np.flatnonzero(run)
    if not len(at) or not len(items.grams):
        none = np.zeros(0, np.int64)
        return none, none, none, seqs
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(GRAM):
            h = (h ^ flat[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    h = h.view(np.int64)
    g = np.minimum(np.searchsorted(items.grams, h), len(items.grams) - 1)
    hit = items.grams[g] == h
    at, g = at[hit], g[hit]
    row = np.searchsorted(starts, at, side="right") - 1
    return row, at - starts[row], g, seqs


def _whole(items: Items, seqs: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """(text number, item) of every passage too short for seeds that a text holds as consecutive tokens."""
    for o in items.short:
        item = items.seqs[o]
        for r, seq in enumerate(seqs):
            n = len(seq) - len(item) + 1
            if n > 0 and np.logical_and.reduce([seq[k : k + n] == token for k, token in enumerate(item)]).any():
                yield r, o


def _count_sequences(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(items.grams), np.int64)
        docs = 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            docs += len(texts)
            row, _, g, _ = _lookup(items, texts)
            pairs = np.unique(row * len(items.grams) + g)
            seen += np.bincount(pairs % max(len(items.grams), 1), minlength=len(items.grams))
        some = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(np.append(some, -1), pa.int64()), pa.array(np.append(seen[some], docs), pa.int64())], names=["gram", "docs"])

    return run


def choose_seeds(items: Items, seen: np.ndarray, docs: int) -> np.ndarray:
    """Mask over the items' sequences: the rare ones, and the rarest of every stretch."""
    index = np.searchsorted(items.grams, items.hash)
    df = seen[index]
    seed = df <= max(FEW, RARE_SHARE * docs)
    stretch = items.owner * 1_000_003 + items.place // STRETCH
    order = np.lexsort((df, stretch))
    s = stretch[order]
    first = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    rank = np.arange(len(s)) - np.maximum.accumulate(np.where(first, np.arange(len(s)), 0)) if len(s) else np.zeros(0, int)
    seed[order[rank < IN_STRETCH]] = True
    return seed


def align(item: np.ndarray, doc: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: (covered tokens of the item, equal tokens, first covered token)."""
    n = len(doc)
    if not n or not len(item):
        return 0, 0, 0
    ramp = np.arange(n + 1) * -GAP
    score = np.zeros(n + 1)
    begin = np.full(n + 1, 0)
    equal = np.zeros(n + 1, np.int64)
    best, found = 0.0, (0, 0, 0)
    for i, token in enumerate(item):
        same = doc == token
        diag = score[:-1] + np.where(same, MATCH, MISMATCH)
        up = score[1:] + GAP
        new = np.zeros(n + 1)
        use_up = up > diag
        step = np.where(use_up, up, diag)
        new_begin = np.empty(n + 1, np.int64)
        new_equal = np.zeros(n + 1, np.int64)
        fresh = step <= 0
        new[1:] = np.where(fresh, 0.0, step)
        new_begin[0] = i + 1
        source = np.where(use_up, begin[1:], begin[:-1])
        gained = np.where(use_up, equal[1:], equal[:-1] + same)
        new_begin[1:] = np.where(fresh, i + 1, source)
        new_equal[1:] = np.where(fresh, 0, gained)
        # gaps along the document: the best cell to the left, less its distance
        lifted = new + ramp
        reach = np.maximum.accumulate(lifted)
        origin = np.maximum.accumulate(np.where(lifted >= reach, np.arange(n + 1), 0))
        slid = reach - ramp
        moved = slid > new + 1e-9
        new = np.where(moved, slid, new)
        new_begin = np.where(moved, new_begin[origin], new_begin)
        new_equal = np.where(moved, new_equal[origin], new_equal)
        score, begin, equal = new, new_begin, new_equal
        top = int(np.argmax(score))
        if score[top] > best:
            best = float(score[top])
            found = (i + 1 - int(begin[top]), int(equal[top]), int(begin[top]))
    return found


def align_straight(item: np.ndarray, doc: np.ndarray, diagonal: int) -> tuple[int, int]:
    """(covered, equal) of the best local alignment without gaps on one diagonal."""
    first = max(0, -diagonal)
    n = min(len(item), len(doc) - diagonal) - first
    if n <= 0:
        return 0, 0
    same = item[first : first + n] == doc[diagonal + first : diagonal + first + n]
    total = np.concatenate([[0.0], np.cumsum(np.where(same, MATCH, MISMATCH))])
    least = np.minimum.accumulate(total)
    end = int(np.argmax(total - least))
    start = int(np.argmin(total[: end + 1]))
    return end - start, int(same[start:end].sum())


def _find(items: Items, seed: np.ndarray):
    gram_of = np.searchsorted(items.grams, items.hash)
    order = np.argsort(gram_of, kind="stable")
    use_owner, use_place, use_seed = items.owner[order], items.place[order], seed[order]
    use_count = np.bincount(gram_of, minlength=len(items.grams))
    use_start = np.concatenate([[0], np.cumsum(use_count)[:-1]]) if len(use_count) else np.zeros(0, np.int64)
    lengths = np.array([len(s) for s in items.seqs], np.int64)

    def candidates(row: np.ndarray, place: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, item, diagonal) of every place where enough sequences of an item lie near one diagonal, one of them a seed."""
        times = use_count[g]
        hit = np.repeat(np.arange(len(g)), times)
        use = np.repeat(use_start[g], times) + np.arange(len(hit)) - np.repeat(np.cumsum(times) - times, times)
        pair = row[hit] * len(lengths) + use_owner[use]
        _, back, often = np.unique(pair, return_inverse=True, return_counts=True)
        seeded_pair = np.bincount(back, weights=use_seed[use]) > 0
        likely = seeded_pair[back] & (often[back] >= LEAST_SHARED * (lengths[use_owner[use]] - GRAM + 1))
        hit, use = hit[likely], use[likely]
        owner, diagonal = use_owner[use], place[hit] - use_place[use]
        found = []
        for shift in (0, BAND // 2):
            band = (diagonal + shift + (1 << 40)) // BAND
            key = np.lexsort((use_place[use], band, owner, row[hit]))
            r, o, b, p, s, d = row[hit][key], owner[key], band[key], use_place[use][key], use_seed[use][key], diagonal[key]
            new = np.ones(len(key), bool)
            new[1:] = (r[1:] != r[:-1]) | (o[1:] != o[:-1]) | (b[1:] != b[:-1])
            fresh = new.copy()
            fresh[1:] |= p[1:] != p[:-1]
            group = np.cumsum(new) - 1
            distinct = np.bincount(group, weights=fresh)
            seeded = np.bincount(group, weights=s) > 0
            heads = np.flatnonzero(new)
            mean = np.bincount(group, weights=d) / np.maximum(np.bincount(group), 1)
            tails = np.append(heads[1:], len(key)) - 1
            span = p[tails] - p[heads] + GRAM
            ok = seeded & (span >= np.maximum(LEAST_SPAN * lengths[o[heads]], LEAST_COVER * lengths[o[heads]] - LOOSE_ENDS)) & (distinct >= np.maximum(1, LEAST_SHARED * (lengths[o[heads]] - GRAM + 1)))
            found.append((r[heads][ok], o[heads][ok], mean[ok].astype(np.int64), d[heads][ok]))
        r, o, d, exact = (np.concatenate(x) for x in zip(*found, strict=True))
        key = np.lexsort((d, o, r))
        r, o, d, exact = r[key], o[key], d[key], exact[key]
        keep = np.ones(len(r), bool)
        keep[1:] = (r[1:] != r[:-1]) | (o[1:] != o[:-1]) | (d[1:] - d[:-1] > BAND // 2)
        return r[keep], o[keep], d[keep], exact[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, place, g, seqs = _lookup(items, batch.column("text").to_pylist())
            best: dict[tuple[int, int], tuple[float, float]] = dict.fromkeys(_whole(items, seqs), (1.0, 1.0))
            if len(row):
                for r, o, d, exact in zip(*(x.tolist() for x in candidates(row, place, g)), strict=True):
                    item = items.seqs[o]
                    if best.get((r, o), (0.0, 0.0))[0] >= 1.0:
                        continue
                    covered, equal = align_straight(item, seqs[r], exact)
                    if covered < LEAST_COVER * len(item):  # words put in or left out: gaps are needed
                        slack = BAND + len(item) // 8
                        covered, equal, _ = align(item, seqs[r][max(0, d - slack) : max(0, d + len(item) + slack)])
                    share, same = covered / len(item), equal / max(covered, 1)
                    if share >= LEAST_COVER and same >= LEAST_IDENTITY:
                        best[r, o] = max(best.get((r, o), (0.0, 0.0)), (share, same))
            rows, hits = [k[0] for k in best], [k[1] for k in best]
            arrays = [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(hits, pa.int64())]
            arrays += [pa.array([v[i] for v in best.values()], pa.float64()) for i in (0, 1)]
            yield pa.record_batch(arrays, names=["doc_id", "passage_no", "covered", "identity"])

    return run


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id, covered, identity): documents that hold at least half of an item's passage.

    Null or empty passages and texts give no rows; equal passages under several items are aligned
    once and reported for each. A passage of fewer than five tokens has no seeds: it is searched for as a whole.
    ``covered`` and ``identity`` are those of the best alignment. Further columns are ignored.
    """
    spark = documents.sparkSession
    rows = items.filter("item_id IS NOT NULL AND length(passage) > 0").select("item_id", "passage").distinct()
    texts = documents.filter("doc_id IS NOT NULL AND length(text) > 0").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = spread(texts)
    shape = "item_id long, doc_id long, covered double, identity double"
    out = None
    # items are a stated query set: one block of passages at a time is on the driver
    distinct = rows.select("passage").distinct().orderBy("passage").toLocalIterator()
    while part := [r.passage for r in islice(distinct, BLOCK)]:
        block = Items(part)
        counts = texts.select("text").mapInArrow(_count_sequences(block), "gram long, docs long").groupBy("gram").agg(F.sum("docs").alias("docs")).collect()
        seen = np.zeros(len(block.grams), np.int64)
        docs = 0
        for r in counts:
            if r.gram < 0:
                docs = r.docs
            else:
                seen[r.gram] = r.docs
        found = texts.mapInArrow(_find(block, choose_seeds(block, seen, docs)), "doc_id long, passage_no long, covered double, identity double")
        numbers = F.broadcast(spark.createDataFrame(list(enumerate(part)), "passage_no long, passage string"))
        named = found.join(numbers, "passage_no").join(rows, "passage")
        named = named.select(F.col("item_id").cast("long").alias("item_id"), "doc_id", "covered", "identity")
        out = named if out is None else out.unionByName(named)
    return spark.createDataFrame([], shape) if out is None else out
