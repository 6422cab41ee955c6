"""Sentence boundaries across languages and scripts.

The rules follow the Unicode sentence-break properties: a run of sentence terminals (STerm or
ATerm) with its closing marks is a candidate, an ATerm needs white space and something that can
start a sentence after it, an East Asian terminal needs neither. On top of them come

* suppression of abbreviations, initials, ordinals and numbered references, by language;
* quotations and brackets: a boundary inside a pair counts only where the pair closes, and only
  if the pair opens the sentence or something starts a new sentence behind it;
* scripts that write no full stop (Thai, Lao, Khmer, Myanmar): a space between two clauses of the
  script ends a sentence, a space next to a number or a foreign word does not.

Empty lines end a sentence, single line feeds do not; pipe tables and fenced code are skipped.
Offsets are code points, end exclusive, without surrounding white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.plans.runtime import spread

# Abbreviations that are always followed by the rest of their sentence, by language.
ALWAYS = {
    "en": "mr mrs ms dr prof st rev gen e.g i.e cf vs approx v fig figs sec ch pp vol nos eq ver al capt lt sgt hon",
    "de": "dr prof hr fr nr z b d h ca vgl bzw abb kap art bd evtl ggf inkl z.b d.h u.a sog",
    "fr": "m mm mme mmes mlle dr pr p pp art fig env cf ch vol n no éd",
    "es": "sr sra srta dr dra p pp pág págs art núm aprox ej ee fig cap vol ud uds",
    "hi": "डॉ श्री प्रो",
    "ar": "",
    "ja": "",
    "zh": "",
    "ko": "",
    "th": "",
}
# Abbreviations that only a number follows, and those that may end a sentence or not.
BEFORE_NUMBER = {"no", "nr", "p", "pp", "s", "art", "abs", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec"}
EITHER = {"etc", "usw", "inc", "ltd", "co", "corp", "std", "dept", "approx", "a.m", "p.m", "u.s", "u.k", "e.u", "jr", "min", "max", "bzw", "ff", "et", "al"}
GERMAN_MONTHS = {"januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember"}
DATE_LEADS = {"am", "vom", "zum", "bis", "ab", "seit", "der", "den", "dem"}

_ALWAYS = {lang: frozenset(words.split()) for lang, words in ALWAYS.items()}
_ALL = frozenset().union(*_ALWAYS.values())

OPEN = "“„‟«‹「『（([【《〈［｛{"
CLOSE = "”»›」』）)]】》〉］｝}"
PAIRS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "《": "》", "〈": "〉", "［": "］"}

_MARK = regex.compile(r"[“”„«»‹›「」『』（）()\[\]【】《》〈〉［］\"]")
_TERMS = regex.compile(r"[\p{SB=ST}\p{SB=AT}…]+")
_WIDE = frozenset("。！？｡．‼⁇⁈⁉")
_UNSPACED = r"\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
_UNSPACED_GAP = regex.compile(rf"(?<=[{_UNSPACED}])\s+(?=[{_UNSPACED}])")
_HAS_UNSPACED = regex.compile(rf"[{_UNSPACED}]")
_NO_CLAUSE = regex.compile(r"^[ๆฯ]")
_BLANK = regex.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_CLOSERS = "\"'”’»›)]}」』）】》〉］"
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}_]+")
_JA_QUOTING = ("と", "って", "という")
#: Fewest characters of a clause of a script without full stops.
LEAST_CLAUSE = 6


def text_segments(text: str) -> list[tuple[int, int]]:
    """Stretches of running text between empty lines, tables and code, as offsets."""
    if "|" not in text and "```" not in text and "~~~" not in text:
        out, at = [], 0
        for gap in _BLANK.finditer(text):
            out.append((at, gap.start()))
            at = gap.end()
        out.append((at, len(text)))
        return out
    out, at, start, fence = [], 0, None, None
    for line in text.split("\n"):
        bare = line.strip()
        code = bare[:3] in ("```", "~~~")
        table = len(bare) > 1 and bare[0] == "|" == bare[-1]
        if fence or code or table or not bare:
            if start is not None:
                out.append((start, at))
                start = None
            if fence:
                fence = None if bare[:3] == fence else fence
            elif code:
                fence = bare[:3]
        elif start is None:
            start = at
        at += len(line) + 1
    if start is not None:
        out.append((start, len(text)))
    return out


def quoted_spans(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Outermost pairs of quotes or brackets: (place of the opening mark, place of the closing one)."""
    stack: list[tuple[str, int]] = []
    out: list[tuple[int, int]] = []
    for found in _MARK.finditer(text, start, end):
        mark, at = found[0], found.start()
        if mark == '"':
            closing = bool(stack) and stack[-1][0] == '"'
            if not closing and at > start and (text[at - 1].isalnum() or text[at - 1] in ".!?,"):
                continue
        else:
            closing = bool(stack) and mark in PAIRS.get(stack[-1][0], "")
        if closing:
            opened = stack.pop()[1]
            if not stack:
                out.append((opened, at))
        elif mark in PAIRS or mark == '"':
            stack.append((mark, at))
    if stack:  # an opening mark without its partner does not hold the rest together
        first = stack[0][1]
        inner = quoted_spans(text, first + 1, end)
        out = [s for s in out if s[1] < first] + inner
    return out


def _starts_sentence(text: str, at: int) -> bool:
    """Can a sentence start here? Lower case can not, save for names like iPhone."""
    c = text[at]
    if c.islower():
        word = _WORD.match(text, at)
        return bool(word) and any(x.isupper() for x in word[0][1:])
    return True


def _abbreviated(text: str, start: int, dot: int, after: int, end: int, words: frozenset[str]) -> bool:
    """Is the full stop at ``dot`` part of an abbreviation, initial, ordinal or numbered reference?"""
    left = dot
    while left > start and not text[left - 1].isspace():
        left -= 1
    token = text[left:dot].lstrip("([{\"'“„«‘¿¡*_<")
    word = token.lower()
    if not word:
        return False
    follows = text[after] if after < end else ""
    if word in EITHER:
        return False
    if word in BEFORE_NUMBER and follows.isdigit():
        return True
    if word in words and not (word == "no" and token == "no"):
        return True
    if len(token) == 1 and token.isalpha() and token.isupper() and not regex.match(r"[\p{Han}\p{Kana}\p{Hira}]", token):
        return True
    if token.isdigit() and len(token) <= 2:
        nxt = _WORD.match(text, after)
        if nxt and nxt[0].lower() in GERMAN_MONTHS:
            return True
        before = text[start:left].rstrip().rpartition(" ")[2].lower()
        return before in DATE_LEADS and not follows.isspace() and before in {"am", "vom", "zum"}
    return False


def _split(text: str, start: int, end: int, words: frozenset[str]) -> Iterator[tuple[int, int]]:
    spans = quoted_spans(text, start, end)
    span_at, cut = 0, start
    while cut < end and text[cut].isspace():
        cut += 1
    for found in _TERMS.finditer(text, start, end):
        at, stop, terms = found.start(), found.end(), found[0]
        if stop <= cut:
            continue
        while span_at < len(spans) and spans[span_at][1] < at:
            span_at += 1
        closed = None
        if span_at < len(spans) and spans[span_at][0] < at < spans[span_at][1]:
            closed = spans[span_at]
            if text[stop : closed[1]].strip(_CLOSERS + "   "):
                continue
            stop = closed[1] + 1
        while stop < end and text[stop] in _CLOSERS:
            stop += 1
        nxt = stop
        while nxt < end and text[nxt].isspace():
            nxt += 1
        if nxt >= end:
            break
        whole = closed is not None and closed[0] == cut
        if terms[-1] in _WIDE:
            if closed is not None and (not whole or text.startswith(_JA_QUOTING, nxt)):
                continue
        elif nxt == stop:
            if not (closed is None and terms[-1] in "।॥۔"):
                continue
        elif text[nxt] in ",;:،；：!?.…" and not (text[nxt] == "." and text[nxt + 1 : nxt + 2].isdigit()):
            continue
        elif not _starts_sentence(text, nxt):
            lone = terms == "." and closed is None
            left = at
            while left > cut and text[left - 1].isalpha():
                left -= 1
            word = text[left:at].lower()
            plain = left > cut and text[left - 1].isspace()
            if lone:  # running text set in lower case throughout
                if len(word) < 3 or not plain or word in words or word in EITHER or word in _ALL:
                    continue
            elif closed is not None or terms[-1] in ".…":
                continue
        elif terms == "." and closed is None and _abbreviated(text, cut, at, nxt, end, words):
            continue
        yield cut, stop
        cut = nxt
    last = end
    while last > cut and text[last - 1].isspace():
        last -= 1
    if last > cut:
        yield cut, last


def _split_unspaced(text: str, start: int, end: int) -> list[int]:
    """Boundaries at spaces between two clauses of a script that has no full stop."""
    out, cut = [], start
    for gap in _UNSPACED_GAP.finditer(text, start, end):
        nxt = _UNSPACED_GAP.search(text, gap.end(), end)
        right = text[gap.end() : nxt.start() if nxt else end].strip()
        if gap.start() - cut < LEAST_CLAUSE or len(right) < LEAST_CLAUSE or _NO_CLAUSE.match(right):
            continue
        out.append(gap.end())
        cut = gap.end()
    return out


def language(lang: str | None) -> str | None:
    """``EN``, ``en-XX`` and ``en`` are one language; missing and undetermined are none."""
    code = (lang or "").strip().lower().replace("_", "-").partition("-")[0]
    return code if code in ALWAYS else None


def each_sentence(text: str | None, lang: str | None = None) -> Iterator[tuple[int, int]]:
    """Sentences of a text in order, one at a time; see ``sentences``."""
    if not text:
        return
    words = _ALWAYS.get(language(lang), _ALL)
    for start, end in text_segments(text):
        if start >= end:
            continue
        pieces = [start]
        if _HAS_UNSPACED.search(text, start, end):
            pieces += _split_unspaced(text, start, end)
        for a, b in zip(pieces, [*pieces[1:], end], strict=True):
            yield from _split(text, a, b, words)


def sentences(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """Sentences of a text as (start, end) in code points; none for a missing or empty text.

    ``lang`` chooses the abbreviations; an unknown language uses those of all languages.
    """
    return list(each_sentence(text, lang))


def _batches(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, ends, picks = batch.column("doc_id"), [], [], []
            for row, (text, lang) in enumerate(zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True)):
                for a, b in sentences(text, lang):
                    picks.append(row)
                    starts.append(a)
                    ends.append(b)
            yield pa.record_batch([ids.take(pa.array(picks, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=columns)

    return run


def sentence_units(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per sentence: (doc_id, char_start, char_end). A narrow transformation, no shuffle.

    Null and empty texts give no rows, a missing language uses the abbreviations of all, repeated
    rows give repeated sentences, and further columns of the input are ignored.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter("length(text) > 0")
    return spread(rows).mapInArrow(_batches(["doc_id", "char_start", "char_end"]), "doc_id long, char_start long, char_end long")
