"""Exact token counts of a public byte-level BPE vocabulary, fast enough for whole corpora.

The vocabulary's pre-tokeniser never joins what stands before a white-space run with what follows
it, so a text may be cut before every single space and the parts counted on their own: the sum is
the count of the whole text. The parts are words of natural language, which recur; their counts are
remembered in a bounded table, and only new parts go through the merges.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.plans.runtime import spread

#: Folder of the vocabulary files; they are not part of this repository.
TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of the table of remembered parts; it starts afresh when full, which changes no count.
REMEMBERED = 300_000


class Counter(dict):
    """Token counts of text parts; a part not seen yet is tokenised on access."""

    def __init__(self, folder: str, vocabulary: str) -> None:
        import tiktoken

        lines = (Path(folder) / vocabulary).read_bytes().splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encode = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, part: str) -> int:
        n = len(self._encode(part))
        if len(part) <= 40:
            if len(self) >= REMEMBERED:
                self.clear()
            self[part] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        first, *rest = text.split(" ")
        total = self[first] if first else 0
        get = self.__getitem__
        return total + sum(map(get, [" " + x for x in rest]))


_COUNTERS: dict[tuple[str, str], Counter] = {}


def counter(folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> Counter:
    """The process-wide counter of a vocabulary."""
    key = (folder, vocabulary)
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(folder, vocabulary)
    return _COUNTERS[key]


def with_tokens(df: DataFrame, text: str, keep: list[str], folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` columns and ``tokens`` (BIGINT); a missing text has 0. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(folder, vocabulary).count
        for batch in batches:
            tokens = [count(t) for t in batch.column("_text").to_pylist()]
            kept = [batch.column(c) for c in keep]
            yield pa.record_batch([*kept, pa.array(tokens, pa.int64())], names=[*keep, "tokens"])

    rows = df.select(*keep, F.col(text).alias("_text"))
    shape = rows.drop("_text").schema.add("tokens", "long")
    return spread(rows).mapInArrow(run, shape)
