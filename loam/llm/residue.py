"""Template residue, filler and error-page text.

Every document is reduced to the messages of its main body: pages lose their furniture, exports
their markup, notes their tables and code. In a message the fields left open are marked, and
numbers, status codes, addresses, identifiers and dates are masked; what is left is folded and
hashed. Equal hashes are grouped over all documents and sources, and each distinct message is then
classified once, from its shape and from how widely it recurs:

* ``placeholder``, ``stub`` and ``filler`` wherever they occur;
* ``error`` and ``scripts`` for messages that are unmistakable by themselves, and for any message
  with a word of failure or of scripts that recurs in ``LEAST_DOCS`` documents of ``LEAST_SOURCES`` sources.

A document comes out for a single message of the first three classes, or when, its title aside,
all of its messages are of the last two. Code and code spans describe things and are no case.

Only messages that some rule might concern are sent to the grouping: the tests for that
(``_STUB_HINT``, ``_TERM``, the filler words) hold whatever the rules accept, so no message is lost.
The words of filler passages are counted in the corpus: those of passages that open with the
well-known two, if they recur widely.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm import boilerplate, markup
from loam.llm.sentences import each_sentence, sentences, text_segments
from loam.plans.runtime import join_small, materialize, spread

LEAST_DOCS = 5
LEAST_SOURCES = 2
#: Words of filler passages that are kept, the most frequent first; parameter of the fitted word list.
FILLER_WORDS = 20_000
#: Least share of a sentence's words that are filler words.
FILLER_SHARE = 0.7

_NAME = r"[A-Za-z][A-Za-z0-9_.\\]*"
_CAPS = r"[A-Z](?:\\?_|[A-Z0-9]){2,}"
# Shapes of fields left open. Letters of other scripts may stand directly beside them.
_FIELD_SHAPES = [
    rf"\\?\{{\\?\{{\s*{_NAME}\s*\\?\}}\\?\}}",
    rf"\\?\$\\?\{{\s*{_NAME}\s*\\?\}}",
    r"\[(?:INSERT|Insert|insert)[ _\n][^\]]{1,60}\]",
    r"\[(?:Your|YOUR|your)\s[\w \n]{1,40}\](?!\()",
    r"(?<![A-Za-z0-9_])X{3,}(?![A-Za-z0-9_])",
    rf"\\?#{_CAPS}\\?#",
    rf"(?:<<|&lt;&lt;){_NAME}(?:>>|&gt;&gt;)",
    rf"\\?\{{\\?%\s*{_NAME}\s*\\?%\\?\}}",
    r"(?<![A-Za-z0-9_`])(?:\\?_){2}[A-Z](?:[A-Z0-9]|\\?_(?!\\?_))*(?:\\?_){2}(?![A-Za-z0-9_])",
    rf"@@{_NAME}@@",
    r"\*\|[A-Z](?:\\?_|[A-Z])*\|\*",
    r"(?<![A-Za-z0-9_%`\\])(?:\\?%){1,2}[A-Z](?:\\?_|[A-Z0-9]){2,}(?:\\?%){1,2}(?![A-Za-z0-9_`])",
    r"(?<![A-Za-z0-9_`$\\])\\?\$[A-Z](?:\\?_|[A-Z0-9]){2,}(?![A-Za-z0-9_`$({])",
]
_LINKED = rf"\[\[{_NAME}\]\](?!\()"  # a link in wiki notation
_LINKED_NAME = r"\[\[(?:[A-Za-z][A-Za-z0-9]*(?:[_.][A-Za-z0-9]+)+|[a-z]+[A-Z][A-Za-z]*)\]\]"  # hardly the title of a page
_BRACED = r"(?<![A-Za-z0-9_$`{}\\^])\{[A-Za-z][A-Za-z0-9_.]*\}(?![}`{])"  # an argument in TeX
# Of the signs of each shape, links last, a text that holds it has one.
_FIELD_SIGNS = [
    ("{{", "{\\{"), ("${", "$\\{"), ("[INSERT", "[Insert", "[insert"), ("[Your", "[YOUR", "[your"), ("XXX",), ("#",), (">>", "&gt;&gt;"),
    ("{%", "{\\%"), ("__", "_\\_"), ("@@",), ("*|",), ("%",), ("$",), ("]]",),
]
_FIELD_SHOWN = re.compile("|".join([*_FIELD_SHAPES, _LINKED, _BRACED]))
# The first two signs of every shape: a text without them has no field.
_OPENING = re.compile(r"\{\{|\{\\|\{%|\$\{|\$\\|\$[A-Z]|\[\[|\[I|\[i|\[Y|\[y|XXX|#[A-Z]|<<|&lt;&lt;|__|_\\|@@|\*\||%[A-Z]")
_OPENING_SHOWN = re.compile(_OPENING.pattern + r"|\{[A-Za-z]")
_MARK = "\ue000"
_SHOWN = "<field>"

# What authors leave where text is still missing.
_STUB = re.compile(
    r"\b(?:todo|fixme|tbd|tba)\b\s*:|\(\s*(?:tbd|tba|todo|fixme)\s*\)"
    r"|\btext to be (?:supplied|written|added|provided)\b|^(?:content|section|text) (?:to follow|to come|goes here)\b"
    r"|^(?:replace|insert|add|put) (?:this|your|the) (?:paragraph|text|content|section)\b.*\bwith\b|^replace this (?:paragraph|text|sentence|section)\b"
    r"|^(?:write|put|add) your \w+ here\b|\b(?:lorem|your) text here\b"
)
# Words of which every stub holds one.
_STUB_HINTS = (
    "todo", "fixme", "tbd", "tba", "text to be ", "to follow", "to come", "goes here", "text here", "paragraph",
    *(f"{a} {b}" for a in ("this", "your", "the") for b in ("text", "content", "section", "sentence")),
)
_YOURS = re.compile(r"your \w+ here")
# The passage printers use, its words and the words programmers use for nothing in particular.
_LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur".split()
)
_AMBIGUOUS = frozenset("in et ad ex do ut ea eu sit sed".split())  # words of other languages too
_NOTHING = frozenset("blah foo bar baz qux dummy sample text test asdf qwerty placeholder filler".split())
_PASSAGE = re.compile(r"\blorem ipsum\b[^.!?。！？]*", re.I)
# Common words of the languages, which no filler passage is made of.
_COMMON = frozenset(
    "a an and are as at be by for from has have is it its not of on or such that the this to was we with you der die das den dem des ein eine ist und nicht mit von zu auf für "
    "le la les un une des est et ne pas que qui du de au el los las una es y no por con del se".split()
) - _LATIN

_STATUS = "<status>"
_THING = r"(?:page|article|document|record|entry|item|link|content|file|folder|site|reader|app|application|view|resource|address|service|server)s?"
# Error messages and demands for scripts, each for a whole masked sentence.
_ERROR = re.compile(
    r"(?:(?:http|error|status|code|fatal|server)\W{0,3})?<status>\s*(?:[-–—:,]|error)?\s*\(?[\w ,'’-]*\)?[.!]?"
    r"|(?:http|error|status|code)\b[ #:]*<(?:status|n|id)>.*"
    r"|(?:erreur|code|état|statut|error|código|estado|status|fehler)\s*:?\s*<status>.*"
    r"|(?:错误|状态|代码|エラー|오류)\s*<status>.*"
    r"|.*\b(?:access denied|request blocked|permission denied|not authori[sz]ed|forbidden)\b.*"
    r"|(?:your|the|this) (?:session|link|login|account|token|ticket|request)\b.{0,20}\b(?:has|have|is|was|lacks|needs|could|did)\b.*"
    r"|you (?:do not have|don't have|need|lack|are not allowed)\b.{0,30}\b(?:to|for)\b.*"
    rf"|(?:this|the) {_THING}\b.*\b(?:moved|deleted|removed|not (?:be )?found|unavailable|not exist|no longer|gone|over capacity|not available|cannot be)\b.*"
    r"|.*\b(?:is|are) (?:over capacity|not responding|temporarily unavailable|down for maintenance|unavailable)\b.*"
    r"|.*\b(?:connection|lookup|request|login|handshake|transfer) (?:refused|failed|aborted|timed out|closed|reset|lost)\b.*"
    r"|.*, please (?:reload|try|come back|request|sign in|log in|start over|wait|return|contact)\b.*"
    r"|.*\b(?:is|are) (?:briefly|currently|temporarily|no longer|not) (?:unavailable|available|reachable|responding)\b.*"
    r"|(?:could|can) ?not (?:connect|reach|load|open|find|be reached)\b.*"
    r"|(?:an? )?(?:unknown client|unusual traffic|suspicious traffic|too many requests|strange traffic|automated traffic)\b.*"
    r"|.*\b(?:exception|error|reference|fault|failure|failed|stack overflow|timeout)\b.*\bin [\w.]+(?:\(\))? (?:at|on) line <\w+>.*"
    r"|(?:service|server|gateway|database|upstream) (?:error|timed out|timeout|unavailable)\b.*"
    r"|(?:page|seite|página|article|document) (?:not found|nicht gefunden|no encontrada|introuvable)[.!]?"
    r"|(?:this|diese|cette|la|das|der|die|le|les|l’|el|los|las|esta|este|ihre|ihr|votre|su|dieser|dieses|lien|ce)\b ?.*(?:wurde nicht gefunden|existiert nicht(?: mehr)?|ist (?:derzeit )?nicht (?:erreichbar|verfügbar)|ist (?:ungültig|abgelaufen|gesperrt)|wurde (?:verschoben|gelöscht|entfernt))[.!]?"
    r"|(?:votre session|le lien|l[’']article|la page|le document|le serveur|ce lien)\b.{0,20}(?:n[’']existe plus|est introuvable|a été (?:déplacée?|supprimée?)|est (?:bloquée?|expirée?|invalide|indisponible|inaccessible)|n[’']est pas disponible|ne répond pas).*"
    r"|(?:su sesión|el enlace|el artículo|la página|el documento|el servidor|este enlace)\b.{0,12}(?:no está disponible|ya no existe|no se encuentra|ha (?:caducado|fallado|terminado|sido (?:eliminad|movid)[oa])|fue (?:eliminad|movid)[oa]|no responde|no es válid[oa]|está bloquead[oa]).*"
    r"|(?:该文档|此链接|您访问的页面|该页面|本页面|此页面|您的会话|会话|服务器)(?:不存在|已被删除|暂时无法打开|没有响应|已过期|已失效|已被移动|无效|已结束|被锁定).*"
)
_SCRIPTS = re.compile(
    r".*\b(?:requires?|needs?|relies on|rely on|turn on|switch on|enable|activate|allow)\b.{0,12}\b(?:javascript|scripting|scripts?)\b.*"
    r"|.*\b(?:javascript|scripting|scripts)\b.{0,20}\b(?:is|are|has been|was|were)\b.{0,10}\b(?:off|disabled|blocked|not allowed|required|needed|turned off|not supported)\b.*"
    r"|no script support was found.*|your browser (?:is too old|is not supported|does not support)\b.*"
    r"|(?:checking|verifying|confirming)\b.{0,12}\b(?:your browser|that you are (?:a )?human|you are (?:a )?human)\b.*"
    r"|(?:just )?(?:one|a) moment\b.*"
    r"|(?:bitte )?(?:aktivieren|schalten) sie (?:javascript|skripte|die skripte)\b.*|ihr browser (?:blockiert|unterstützt)\b.*"
    r"|veuillez (?:activer|autoriser)\b.{0,20}(?:javascript|les scripts)\b.*|(?:votre|ce) navigateur (?:bloque|ne prend pas en charge|n[’']autorise pas)\b.*"
    r"|(?:active|habilite|permita|activa|habilita)\b.{0,12}(?:javascript|los scripts)\b.*|(?:su|este) navegador (?:bloquea|no admite|no permite|ha bloqueado)\b.*"
    r"|请启用\s*javascript.*|.{0,8}浏览器.{0,4}(?:禁用|不支持|阻止|屏蔽).*|.{0,10}javascript.{0,10}(?:有効|必要).*"
)
# Stems of failure and of scripts in several languages; every notice holds one of them.
_TERMS = (
    "<status>|http|error|status|denied|blocked|forbidden|permission|authori|session|link|login|account|token|ticket|request|"
    "you do not|you don't|you need|you lack|you are not|moved|deleted|removed|found|unavailable|exist|no longer|gone|capacity|available|cannot|responding|reachable|maintenance|"
    "please|could not|couldnot|can not|cannot|client|traffic|exception|reference|fault|fail|overflow|timeout|timed out|refused|aborted|closed|reset|lost|"
    "javascript|scripting|script|browser|human|moment|captcha|erreur|statut|état|código|estado|code|fehler|gefunden|existiert|erreichbar|verfügbar|ungültig|"
    "abgelaufen|gesperrt|verschoben|gelöscht|entfernt|introuvable|existe|déplacé|supprimé|bloqu|expiré|invalide|disponible|inaccessible|répond|"
    "encuentra|caducado|fallado|terminado|eliminad|movid|responde|válid|navegador|navigateur|skripte|错误|状态|代码|不存在|删除|无法|响应|过期|失效|移动|无效|结束|锁定|浏览器|エラー|有効|必要|오류|"
    "geweigerd|verlopen|niet gevonden|non trovat|negato|scadut|não encontrad|negado|expirad"
)


def _any_of(words: Iterable[str]) -> str:
    """A pattern for any of the words, by shared beginnings: much faster to search for than one after the other."""
    by_first: dict[str, set[str]] = {}
    for w in words:
        by_first.setdefault(w[:1], set()).add(w[1:])
    if "" in by_first:
        return ""  # the shortest one is enough
    branches = [re.escape(first) + _any_of(sorted(rests)) for first, rests in sorted(by_first.items())]
    return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"


_TERM = re.compile(_any_of(_TERMS.split("|")))
# A word of failure or of scripts that makes a widely recurring message a notice.
_WEAK = re.compile(
    r"\b(?:access|request|server|page|site|session|service|connection|link)\b.*\b(?:denied|unavailable|timed out|not found|refused|captcha|expired|failed)\b|\bcaptcha\b"
    r"|\bjavascript\b.*\b(?:inschakelen|abilitare|ative|ativar|włącz|включите)\b|\b(?:toegang geweigerd|sessie is verlopen|pagina niet gevonden|pagina non trovata|accesso negato|página não encontrada|sessão expirada)\b"
)

_MASKS = [
    (re.compile(r"https?://\S+|www\.\S+"), "<url>"),
    (re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"), "<mail>"),
    (re.compile(r"\b\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}\b"), "<date>"),
    (re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b", re.I), "<id>"),
    (re.compile(r"(?<![\d.,:])[1-5]\d\d(?!\d|[.,:]\d)"), _STATUS),
    (re.compile(r"\d+(?:[.,:]\d+)*"), "<n>"),
]
_DIGIT = re.compile(r"[0-9@]|://|www\.")
_CODE_SPAN = re.compile(r"(`+)[^`]*\1")
_WORD = re.compile(r"[^\W\d_]+")
_QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|„[^“”]*[“”]|«[^»]*»|「[^」]*」")


def normalise(message: str) -> str:
    """Mask what varies from one copy of a message to the next; fold case and spacing."""
    if _DIGIT.search(message):
        for pattern, by in _MASKS:
            message = pattern.sub(by, message)
    return " ".join(message.replace(_MARK, _SHOWN).lower().split())


def _filler(message: str, latin: frozenset[str]) -> bool:
    words = _WORD.findall(message.lower())
    if len(words) < 3:
        return False
    if words[:2] == ["lorem", "ipsum"] and _COMMON.isdisjoint(words):
        return True
    known = [w for w in words if w in latin]
    return len(known) >= FILLER_SHARE * len(words) and not _AMBIGUOUS.issuperset(known) or sum(w in _NOTHING for w in words) >= 0.8 * len(words)


def _may_be_stub(low: str) -> bool:
    return any(h in low for h in _STUB_HINTS) or " here" in low and bool(_YOURS.search(low))


def _may_be_filler(words: list[str], latin: frozenset[str]) -> bool:
    """Could these words, whatever stands between them, hold a filler sentence?"""
    return not latin.isdisjoint(words) or not _NOTHING.isdisjoint(words) and sum(w in _NOTHING for w in words) >= 3


@lru_cache(maxsize=4)
def _vocabulary(latin: frozenset[str]) -> tuple[frozenset[str], frozenset[str]]:
    """Words that count towards a filler sentence; those of the passages of which it needs one."""
    return latin | _NOTHING, latin - _AMBIGUOUS


def _has_filler_run(low: str, latin: frozenset[str]) -> bool:
    """Could a sentence of this running text be filler?

    ``FILLER_SHARE``, over two thirds, of such a sentence's words are known, and it has three at least; then
    three of some four neighbours are. Or it opens with the well-known two, whatever follows.
    """
    known = bytes(map(_vocabulary(latin)[0].__contains__, _WORD.findall(low)))
    return b"\1\1\1" in known or b"\1\1\0\1" in known or b"\1\0\1\1" in known or "lorem" in low


def _runs_on(text: str, kind: str | None) -> bool:
    """Are the words of every block of the main body neighbours in the text, too? No markup or code spans are taken out and no lines joined."""
    if kind == "export" or "`" in text:
        return False
    return kind != "page" or "<" not in text and not any(x[:1].islower() for x in text.split("\n"))


def classify(message: str, docs: int, sources: int, latin: frozenset[str] = _LATIN) -> str | None:
    """The class of one distinct normalised message, from its shape and its recurrence; None for none."""
    if _SHOWN in message:
        return "placeholder"
    if _STUB.search(message):
        return "stub"
    if _filler(message, latin):
        return "filler"
    if _QUOTED.search(message) and len(_WORD.findall(_QUOTED.sub(" ", message))) > 2 or message[:1] in "\"“«„「":
        return None  # it speaks of a message
    if _SCRIPTS.fullmatch(message):
        return "scripts"
    if _ERROR.fullmatch(message):
        return "error"
    if docs >= LEAST_DOCS and sources >= LEAST_SOURCES and _WEAK.search(message):
        return "error"
    return None


@lru_cache(maxsize=1024)
def _fields_of(shapes: tuple[str, ...]) -> re.Pattern[str]:
    return re.compile("|".join(shapes))


def _mark_fields(text: str, form: str | None) -> str:
    """Fields left open become one mark, before any grammar takes their signs for markup."""
    if not _OPENING.search(text):
        return text
    # only shapes whose signs the text has; in one order, as one shape may begin where another does
    shapes = tuple(shape for shape, signs in zip([*_FIELD_SHAPES, _LINKED_NAME if form == "wiki" else _LINKED], _FIELD_SIGNS, strict=True) if any(x in text for x in signs))
    return _fields_of(shapes).sub(_MARK, text) if shapes else text


def main_blocks(text: str, kind: str | None, title: str | None, form: str | None = None) -> Iterator[str]:
    """Running text of the main body in blocks, without furniture, tables and code; ``form`` is an export's notation if known."""
    if kind == "export":
        yield from (body for what, body in markup.blocks(text, True, form) if what in ("paragraph", "list_item", "heading"))
    elif kind == "page":
        kept = list(_page_body(text, title))
        yield from _unwrapped(kept) if len(kept) > 1 and all(len(x) < 75 for x in kept) else kept
    else:
        yield from (" ".join(text[a:b].split()) for a, b in text_segments(text) if text[a:b].strip())


def _page_body(text: str, title: str | None) -> Iterator[str]:
    lines, _, chrome = boilerplate.page_lines(text)
    return (lines[n - 1] for n, outside in boilerplate.walk_lines(lines, title, chrome=chrome) if not outside)


def _unwrapped(lines: list[str]) -> list[str]:
    out: list[str] = []
    for line in lines:
        if out and len(out[-1]) >= 40 and out[-1].rstrip()[-1:] not in ".!?:…" and line[:1].islower():
            out[-1] += " " + line.strip()
        else:
            out.append(line.strip())
    return out


def _title_aside(blocks: list[str], kind: str | None, title: str | None) -> Iterator[str]:
    plain_title = " ".join((title or "").split()).lower()
    for n, b in enumerate(blocks):
        if " ".join(b.split()).lower() == plain_title:
            continue
        if n == 0 and kind != "note" and len(blocks) > 1 and len(b) < 80 and b.rstrip()[-1:] not in ".!?。！？" and classify(normalise(b), 0, 0) is None:
            continue
        yield b


def _opens_otherwise(parts: Iterator[str]) -> bool:
    """Does the body open with a sentence that no notice can be? Looks no farther than the first line or block that ends a sentence.

    A notice has a word of ``_TERM`` in every sentence; so has all up to the first end of one.
    """
    for part in parts:
        if _TERM.search(part.lower()) or "5" in part and _TERM.search(normalise(part)):
            return False
        if part.rstrip()[-1:] in ".!?。！？":
            return True
    return False


def messages(text: str | None, kind: str | None, title: str | None, lang: str | None, latin: frozenset[str] = _LATIN) -> tuple[list[str], list[str]]:
    """(residue, notices): normalised messages that may be residue, and, if all of the body may be notices, all of it.

    A superset of what ``classify`` accepts, whatever the text's length.
    """
    if not text or not text.strip():
        return [], []
    found: dict[str, None] = {}
    form = markup.notation(text) if kind == "export" else None
    opened = bool(_OPENING_SHOWN.search(text))
    if opened:
        text = _mark_fields(text, form)
        opened = _MARK in text or bool(_OPENING_SHOWN.search(text))
    else:
        opened = _MARK in text
    low = text.lower()
    stub = _may_be_stub(low)
    if kind == "export":
        filler = True  # markup may part words; the blocks decide
    else:
        filler = _has_filler_run(low, latin) if not opened and _runs_on(text, kind) else _may_be_filler(_WORD.findall(low), _vocabulary(latin)[1])
    blocks: list[str] | None = None
    if stub or filler or opened:
        blocks = list(main_blocks(text, kind, title, form))
        for block in blocks:
            plain = _CODE_SPAN.sub(" ", block) if "`" in block else block
            if _OPENING_SHOWN.search(plain):
                plain = _FIELD_SHOWN.sub(_MARK, plain)
            small = plain.lower()
            may_fill = filler and _has_filler_run(small, latin)
            if not (may_fill or _MARK in plain or stub and _may_be_stub(small)):
                continue
            for a, b in sentences(plain, lang):
                message = plain[a:b]
                if _MARK in message or stub and _STUB.search(normalise(message)) or may_fill and _filler(message, latin):
                    found[normalise(message)] = None
    if blocks is None and kind == "page":
        parts = (x for x in _page_body(text, title))
    else:
        if blocks is None and kind == "export":
            blocks = list(main_blocks(text, kind, title, form))
        parts = iter(blocks) if blocks is not None else main_blocks(text, kind, title)
    if _opens_otherwise(x for n, x in enumerate(parts) if n or kind == "note"):
        return list(found), []
    if blocks is None:
        blocks = list(main_blocks(text, kind, title))
    notices: dict[str, None] = {}
    for block in _title_aside(blocks, kind, title):
        for a, b in each_sentence(block, lang):
            message = normalise(block[a:b])
            if kind != "note" and boilerplate.title_like(block[a:b]) and classify(message, 0, 0) is None:
                continue  # a heading without a text of its own
            if not _TERM.search(message):
                return list(found), []
            notices[message] = None
    return list(found), list(notices)


def _scan(latin: frozenset[str]):
    names = ["doc_id", "source", "hash", "message", "notice", "n"]
    types = [pa.int64(), pa.string(), pa.binary(), pa.string(), pa.bool_(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "source", "text", "kind", "title", "lang")]
            rows: list[tuple] = []
            for doc, source, *about in zip(*columns, strict=True):
                for notice, found in enumerate(messages(*about, latin)):
                    rows.extend((doc, source, blake2b(m.encode(), digest_size=16).digest(), m, bool(notice), len(found)) for m in found)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names=names)

    return run


def _rows(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.trim("source")).alias("source"), "text", "kind", "title", "lang").filter("length(text) > 0")


def filler_words(df: DataFrame) -> frozenset[str]:
    """Words of filler passages: those of the well-known one and those that follow its first two words all over the corpus.

    Counted over all documents; only texts that hold such a passage go through Python, and of the counted
    words the ``FILLER_WORDS`` most frequent are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for n, (source, text, kind, title) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("source", "text", "kind", "title")), strict=True)):
                for block in main_blocks(text, kind, title):
                    for passage in _PASSAGE.findall(block):
                        words = set(_WORD.findall(passage.lower()))
                        if words.isdisjoint(_COMMON):
                            rows.update((source, w, n) for w in words)
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["source", "word"])

    seeded = _rows(df).filter(F.lower("text").contains("lorem") & F.lower("text").contains("ipsum")).select("source", "text", "kind", "title")
    counted = seeded.mapInArrow(run, "source string, word string").groupBy("word", "source").agg(F.count(F.lit(1)).alias("docs"))
    wide = counted.groupBy("word").agg(F.sum("docs").alias("docs"), F.count("source").alias("sources")).filter((F.col("docs") >= LEAST_DOCS) & (F.col("sources") >= LEAST_SOURCES))
    return _LATIN | {r.word for r in wide.orderBy(F.desc("docs"), "word").limit(FILLER_WORDS).collect()}


def scan(df: DataFrame, latin: Iterable[str] | None = None) -> DataFrame:
    """Messages that some rule might concern, per document: (doc_id, source, hash, message, notice, n). No shuffle of texts.

    ``n`` is the number of the document's messages of that kind; ``notice`` rows are there only if all of the body may be notices.
    """
    words = filler_words(df) if latin is None else frozenset(latin)
    return spread(_rows(df)).mapInArrow(_scan(words), "doc_id long, source string, hash binary, message string, notice boolean, n int")


def recurring(found: DataFrame, latin: frozenset[str] = _LATIN) -> DataFrame:
    """Each distinct message with its class and the documents and sources it occurs in: (hash, class, message, docs, sources)."""
    by_source = found.groupBy("hash", "source").agg(F.count_distinct("doc_id").alias("docs"), F.min("message").alias("message"))
    grouped = by_source.groupBy("hash").agg(F.min("message").alias("message"), F.sum("docs").alias("docs"), F.count("source").alias("sources"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            what = [classify(*row, latin) for row in zip(*(batch.column(c).to_pylist() for c in ("message", "docs", "sources")), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(what, pa.string())], names=[*batch.schema.names, "class"])

    classed = grouped.mapInArrow(run, "hash binary, message string, docs long, sources long, class string")
    return classed.filter("class IS NOT NULL").select("hash", "class", "message", "docs", "sources")


def residue(df: DataFrame) -> DataFrame:
    """Documents to exclude: (doc_id, reason), one row each; the reason is the first class in alphabetical order.

    Null and empty texts are no cases; a missing kind is treated as plain text; further columns are ignored.
    """
    latin = filler_words(df)
    found = materialize(scan(df, latin))
    accepted = materialize(recurring(found, latin).select("hash", "class"))
    hashed = found.select("doc_id", "notice", "n", "hash")
    kept = join_small(hashed, accepted, ["hash"], "inner", salt=F.xxhash64("doc_id"))
    kept = kept.filter(F.col("notice") == F.col("class").isin("error", "scripts"))
    per_doc = kept.groupBy("doc_id", "notice").agg(F.count_distinct("hash").alias("good"), F.max("n").alias("n"), F.min("class").alias("reason"))
    cases = per_doc.filter(~F.col("notice") | (F.col("good") >= F.col("n")))
    return cases.groupBy("doc_id").agg(F.min("reason").alias("reason"))
