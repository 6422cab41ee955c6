"""Clean text from HTML, Markdown, wiki and LaTeX markup, with headings, lists, code and formulas kept.

The declared format is not trusted: the notation is recognised from its own marks. Each notation
has a small grammar that yields typed blocks in reading order: ``heading``, ``list_item``, ``code``,
``formula`` and ``paragraph``. HTML goes through a tree-less builder with implied end tags.

Before a grammar reads a text, ``content_region`` bounds it: words score positive and tags negative,
with weights fitted on exports that mark their body themselves, and a linear scan finds the
contiguous run with the largest sum. A grammar needs whole blocks, so the region is widened over the
blocks around it up to the head, preamble or closing part, which it leaves out. A bare region cannot
tell element types apart; these come from the grammars.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.plans.runtime import spread

Block = tuple[str, str]

ELEMENTS = ("heading", "list_item", "code", "formula")

# ---------------------------------------------------------------- recognition

_SIGNS = {
    "latex": [(3, re.compile(r"\\documentclass|\\begin\{|\\(?:sub)*section\*?\{|\\item\b|\\chapter\*?\{|\\(?:emph|textbf|texttt|href|cite)\{"))],
    "html": [(2, re.compile(r"<!DOCTYPE|<(?:html|body|head|h[1-6]|p|div|ul|ol|li|table|pre)\b[^<>]*>", re.I))],
    "wiki": [
        (6, re.compile(r"^={1,6}[^=\n]+={1,6}\s*$", re.M)),
        (3, re.compile(r"\[\[[^\]\n]+\]\]|'''[^'\n]+'''|^\{\||\{\{[A-Z]\w+[^{}]*\||<(?:syntaxhighlight|ref|math)\b|\[https?://\S+ [^\]\n]+\]", re.M)),
    ],
    "markdown": [
        (1, re.compile(r"^#{1,6} \S|^[-+] \S|^\d+[.)] \S|^> ", re.M)),
        (3, re.compile(r"^(?:```|~~~)|^[=-]{4,}\s*$|\]\([^)\s]+\)|\*\*\S|~~\S|\$\$|^\|[ :|-]+\|\s*$", re.M)),
    ],
}


def notation(text: str) -> str:
    """html, markdown, wiki or latex, whichever marks weigh most; ties and no marks at all are markdown."""
    scores = {name: sum(weight * len(sign.findall(text)) for weight, sign in signs) for name, signs in _SIGNS.items()}
    return max(("markdown", "wiki", "html", "latex"), key=lambda n: scores[n])


def _squeeze(text: str) -> str:
    """Every run of white space is one space; none at the ends."""
    return " ".join(text.split())


# ---------------------------------------------------------------- HTML

_HTML_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(script|style|template|noscript|head)\b[^>]*>.*?(?:</\1\s*>|\Z)|</?[a-zA-Z][^<>]*>|[^<]+|<",
    re.S | re.I,
)
_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
_INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup tt u var wbr math mi mo mn".split())
_HIDDEN = re.compile(r"\shidden(?:[\s=>/]|$)|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_HTML_MATH = re.compile(r"\\\((.+?)\\\)|\\\[(.+?)\\\]|\$\$(.+?)\$\$", re.S)


def html_blocks(text: str, keep_code_marks: bool = False) -> list[Block]:
    out: list[Block] = []
    buffer: list[str] = []
    kind = "paragraph"
    items: list[bool] = []
    pre: list[str] | None = None
    math: list[str] | None = None
    hidden, hidden_tag = 0, ""

    def flush(next_kind: str = "paragraph") -> None:
        nonlocal kind
        body = _squeeze("".join(buffer))
        buffer.clear()
        if body:
            out.extend(("formula", _squeeze(next(x for x in m if x))) for m in _HTML_MATH.findall(body))
            out.append((kind, body))
        kind = next_kind

    for found in _HTML_TOKEN.finditer(text):
        token = found[0]
        if token[0] != "<" or token == "<":
            if hidden:
                continue
            if pre is not None:
                pre.append(html.unescape(token))
            elif math is not None:
                math.append(html.unescape(token))
            else:
                buffer.append(html.unescape(token) if "&" in token else token)
            continue
        tag = _TAG.match(token)
        if found[1] or tag is None:
            continue
        name, closing = tag[1].lower(), token[1] == "/"
        if hidden:
            if name == hidden_tag:
                hidden += -1 if closing else 1
            continue
        if not closing and _HIDDEN.search(token) and not token.endswith("/>") and name not in ("br", "img", "input", "hr"):
            hidden, hidden_tag = 1, name
            continue
        if pre is not None:
            if name == "pre" and closing:
                if body := _squeeze("".join(pre)):
                    out.append(("code", body))
                pre = None
                kind = "list_item" if items and items[-1] else "paragraph"
            continue
        if name == "math":
            if closing and math is not None:
                if body := _squeeze("".join(math)):
                    out.append(("formula", body))
                math = None
            elif not closing:
                math = []
        elif math is not None:
            continue
        elif name == "code" and keep_code_marks:
            buffer.append("`")
        elif name in _INLINE:
            continue
        elif name == "br":
            buffer.append(" ")
        elif name == "img":
            continue
        elif name == "pre":
            flush()
            pre = [] if not closing else None
        elif len(name) == 2 and name[0] == "h" and name[1] in "123456":
            flush("paragraph" if closing else "heading")
        elif name in ("ul", "ol", "menu"):
            flush()
            if closing:
                if items:
                    items.pop()
            else:
                items.append(False)
        elif name == "li":
            flush("paragraph" if closing else "list_item")
            if items:
                items[-1] = not closing
        elif kind == "list_item" and name in ("p", "div"):
            buffer.append(" ")
        else:
            flush()
    if pre is not None and (body := _squeeze("".join(pre))):
        out.append(("code", body))
    flush()
    return out


# ---------------------------------------------------------------- Markdown

_MD_FENCE = re.compile(r"^\s{0,3}(`{3,}|~{3,})[^\n`]*$")
_MD_HEADING = re.compile(r"^\s{0,3}(#{1,6})(?:\s+(.*?))?(?:\s+#+)?\s*$")
_MD_ITEM = re.compile(r"^(\s*)(?:[-*+]|\d{1,9}[.)])\s+(.*)$")
_MD_RULE = re.compile(r"^\s{0,3}(?:(?:\*\s*){3,}|(?:-\s*){3,}|(?:_\s*){3,})$")
_MD_SETEXT = re.compile(r"^\s{0,3}(=+|-+)\s*$")
_MD_CODE_SPAN = re.compile(r"(`+)(.+?)(?<!`)\1(?!`)", re.S)
_MD_MATH = re.compile(r"\$\$(.+?)\$\$|\\\[(.+?)\\\]|\\\((.+?)\\\)|(?<![\\$\w])\$(?=[^\s$])((?:[^$\\]|\\.)+?)(?<=[^\s\\])\$(?![\d$])", re.S)
_MD_INLINE = [
    ("![", re.compile(r"!\[[^\]]*\]\([^)]*\)"), ""),
    ("](", re.compile(r"\[([^\]]*)\]\([^)]*\)"), r"\1"),
    ("][", re.compile(r"\[([^\]]+)\]\[[^\]]*\]"), r"\1"),
    ("<http", re.compile(r"<(https?://[^>\s]+)>"), r"\1"),
    ("<", re.compile(r"</?[a-zA-Z][^<>]*>"), ""),
    ("***", re.compile(r"\*\*\*(\S(?:.*?\S)?)\*\*\*", re.S), r"\1"),
    ("**", re.compile(r"\*\*(\S(?:.*?\S)?)\*\*", re.S), r"\1"),
    ("__", re.compile(r"(?<!\w)__(\S(?:.*?\S)?)__(?!\w)", re.S), r"\1"),
    ("*", re.compile(r"(?<![\w*\\])\*([^\s*](?:[^*]*[^\s*])?)\*(?!\*)"), r"\1"),
    ("_", re.compile(r"(?<![\w\\])_([^\s_](?:[^_]*[^\s_])?)_(?!\w)"), r"\1"),
    ("~~", re.compile(r"~~(\S(?:.*?\S)?)~~", re.S), r"\1"),
]
_MD_ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)


def _md_inline(text: str, keep_code_marks: bool) -> str:
    spans: list[str] = []

    def hide(m: re.Match[str]) -> str:
        spans.append(f"`{m[2]}`" if keep_code_marks else m[2].strip())
        return f"\x00{len(spans) - 1}\x01"

    if "`" in text:
        text = _MD_CODE_SPAN.sub(hide, text)
    for sign, pattern, by in _MD_INLINE:
        if sign in text:
            text = pattern.sub(by, text)
    if "\\" in text:
        text = _MD_ESCAPE.sub(r"\1", text)
    if "&" in text:
        text = html.unescape(text)
    if spans:
        text = re.sub("\x00(\\d+)\x01", lambda m: spans[int(m[1])], text)
    return _squeeze(text)


def markdown_blocks(text: str, keep_code_marks: bool = False) -> list[Block]:
    out: list[Block] = []
    lines = text.expandtabs(4).split("\n")
    para: list[str] = []
    kind = "paragraph"

    def flush() -> None:
        nonlocal kind
        if para:
            raw = "\n".join(para)
            if "$" in raw or "\\" in raw:
                bare = _MD_CODE_SPAN.sub(" ", raw) if "`" in raw else raw
                out.extend(("formula", _squeeze(next(x for x in m if x))) for m in _MD_MATH.findall(bare))
            if body := _md_inline(raw, keep_code_marks):
                out.append((kind, body))
            para.clear()
        kind = "paragraph"

    at, n = 0, len(lines)
    while at < n:
        line = lines[at]
        bare = line.strip()
        if not bare:
            flush()
            at += 1
            continue
        if "<!--" in line and (spot := line.index("<!--")) >= 0 and "`" not in line[:spot]:
            rest = "\n".join(lines[at:])
            lines = lines[:at] + _COMMENT.sub("", rest, count=1).split("\n")
            n = len(lines)
            continue
        if fence := _MD_FENCE.match(line):
            flush()
            mark, end = fence[1], at + 1
            while end < n and not (lines[end].strip().startswith(mark) and not lines[end].strip().strip(mark[0])):
                end += 1
            if body := _squeeze("\n".join(lines[at + 1 : end])):
                out.append(("code", body))
            at = end + 1
            continue
        if line.startswith("    ") and not para:
            end = at
            while end < n and (lines[end].startswith("    ") or not lines[end].strip()):
                end += 1
            out.append(("code", _squeeze("\n".join(lines[at:end]))))
            at = end
            continue
        if bare == "$$" or (bare.startswith("$$") and "$$" not in bare[2:]):
            end = at + 1
            while end < n and "$$" not in lines[end]:
                end += 1
            if end < n:
                flush()
                out.append(("formula", _squeeze(bare[2:] + "\n" + "\n".join(lines[at + 1 : end]) + "\n" + lines[end].split("$$")[0])))
                at = end + 1
                continue
        if heading := _MD_HEADING.match(line):
            flush()
            if body := _md_inline(heading[2] or "", keep_code_marks):
                out.append(("heading", body))
            at += 1
            continue
        if para and kind == "paragraph" and _MD_SETEXT.match(line):
            kind = "heading"
            flush()
            at += 1
            continue
        if _MD_RULE.match(line):
            flush()
            at += 1
            continue
        if bare[0] == ">":
            flush()
            end = at
            while end < n and lines[end].strip().startswith(">"):
                end += 1
            out.extend(markdown_blocks("\n".join(re.sub(r"^\s*> ?", "", x) for x in lines[at:end]), keep_code_marks))
            at = end
            continue
        if item := _MD_ITEM.match(line):
            flush()
            kind = "list_item"
            para.append(re.sub(r"^\[[ xX]\]\s+", "", item[2]))
            at += 1
            continue
        if bare[0] == "|" == bare[-1] and len(bare) > 1:
            flush()
            if not re.fullmatch(r"[\s|:-]+", bare):
                para.append(bare.strip("|").replace("|", "  "))
                flush()
            at += 1
            continue
        para.append(line)
        at += 1
    flush()
    return out


# ---------------------------------------------------------------- wiki

_WIKI_SPECIAL = re.compile(
    r"<!--.*?(?:-->|\Z)|<ref\b[^>]*/>|<ref\b[^>]*>.*?</ref>|<(pre|syntaxhighlight|source)\b[^>]*>(.*?)</\1>|<math\b[^>]*>(.*?)</math>|<nowiki>(.*?)</nowiki>",
    re.S | re.I,
)
_WIKI_TABLE = re.compile(r"^\{\|.*?^\|\}", re.S | re.M)
_WIKI_TEMPLATE = re.compile(r"\{\{[^{}]*\|[^{}]*\}\}", re.S)
_WIKI_HEADING = re.compile(r"^(={1,6})\s*(.+?)\s*\1\s*$")
_WIKI_ITEM = re.compile(r"^[:;]*[*#][*#:;]*\s*(.*)$")
_WIKI_INLINE = [
    (re.compile(r"\[\[(?:Category|File|Image|Kategorie|Datei|Catégorie|Fichier|Categoría|Archivo):[^\]]*\]\]", re.I), ""),
    (re.compile(r"\[\[[^\]|]*\|([^\]]*)\]\]"), r"\1"),
    (re.compile(r"\[\[([^\]]*)\]\]"), r"\1"),
    (re.compile(r"\[(?:https?:)?//\S+\s+([^\]]*)\]"), r"\1"),
    (re.compile(r"\[https?://\S+\]"), ""),
    (re.compile(r"'{2,5}"), ""),
]
_ANY_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_CODE_TAG = re.compile(r"</?(?:code|tt|kbd|samp)\b[^<>]*>", re.I)


def _wiki_inline(text: str, keep_code_marks: bool) -> str:
    for pattern, by in _WIKI_INLINE if "[" in text or "''" in text else ():
        text = pattern.sub(by, text)
    if "<" in text:
        if keep_code_marks:
            text = _CODE_TAG.sub("`", text)
        text = _ANY_TAG.sub("", text)
    return _squeeze(html.unescape(text) if "&" in text else text)


def wiki_blocks(text: str, keep_code_marks: bool = False) -> list[Block]:
    kept: list[Block] = []

    def special(m: re.Match[str]) -> str:
        if m[2] is not None:
            kept.append(("code", _squeeze(html.unescape(m[2]))))
            return f"\n\x00{len(kept) - 1}\x01\n"
        if m[3] is not None:
            kept.append(("formula", _squeeze(html.unescape(m[3]))))
            return f"\x00{len(kept) - 1}\x01"
        return m[4] or ""

    text = _WIKI_TABLE.sub("", _WIKI_SPECIAL.sub(special, text))
    while True:
        text, changed = _WIKI_TEMPLATE.subn("", text)
        if not changed:
            break
    out: list[Block] = []
    para: list[str] = []

    def emit(kind: str, raw: str) -> None:
        for i in re.findall("\x00(\\d+)\x01", raw):
            if kept[int(i)][1]:
                out.append(kept[int(i)])
        raw = re.sub("\x00(\\d+)\x01", lambda m: kept[int(m[1])][1] if kept[int(m[1])][0] == "formula" else "", raw)
        if body := _wiki_inline(raw, keep_code_marks):
            out.append((kind, body))

    def flush() -> None:
        if para:
            emit("paragraph", "\n".join(para))
            para.clear()

    for line in text.split("\n"):
        if not line.strip():
            flush()
        elif heading := _WIKI_HEADING.match(line):
            flush()
            emit("heading", heading[2])
        elif item := _WIKI_ITEM.match(line):
            flush()
            emit("list_item", item[1])
        else:
            para.append(line.lstrip(":;"))
    flush()
    return out


# ---------------------------------------------------------------- LaTeX

_TEX_CODE = re.compile(r"\\begin\{(verbatim\*?|lstlisting|minted|Verbatim|alltt)\}(?:\[[^\]]*\])?(?:\{[^}]*\})?[^\S\n]*\n?(.*?)\\end\{\1\}", re.S)
_TEX_COMMENT = re.compile(r"(?<!\\)%.*")
_TEX_MATH = re.compile(
    r"\\begin\{(equation|align|gather|multline|displaymath|eqnarray|math)(\*?)\}(.*?)\\end\{\1\2\}|\\\[(.+?)\\\]|(?<!\\)\$\$(.+?)(?<!\\)\$\$|\\\((.+?)\\\)|(?<!\\)\$((?:[^$\\]|\\.)+?)\$",
    re.S,
)
_TEX_HEAD = re.compile(r"\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?(?:\[[^\]]*\])?\{")
_TEX_SPLIT = re.compile(r"\\item\b(?:\[[^\]]*\])?|\\(begin|end)\{(?:itemize|enumerate|description)\}(?:\[[^\]]*\])?|\n\s*\n|\x02")
_TEX_DROP = re.compile(r"~?\\(?:cite[tp]?|label|ref|eqref|pageref|footnote|index|vspace|hspace|includegraphics|bibliography|bibliographystyle|usepackage|documentclass|pagestyle|input|begin|end)\*?(?:\[[^\]]*\])*\{[^{}]*\}")
_TEX_LINK = re.compile(r"\\href\{[^{}]*\}\{([^{}]*)\}")
_TEX_CODE_CMD = re.compile(r"\\(?:texttt|lstinline|code)\{([^{}]*)\}|\\verb\*?([^\sA-Za-z])(.+?)\2")
_TEX_CMD = re.compile(r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}")
_TEX_BARE = re.compile(r"\\(?:maketitle|noindent|par|newpage|clearpage|tableofcontents|centering|hline|quad|qquad|bigskip|medskip|smallskip|ldots|dots|textbackslash)\b")
_TEX_ESCAPE = re.compile(r"\\([%$#&_{}])")


def _tex_inline(text: str, keep_code_marks: bool) -> str:
    text = _TEX_DROP.sub("", text)
    text = _TEX_ESCAPE.sub(lambda m: "\x03" + "%$#&_{}".index(m[1]).__str__(), text)
    for _ in range(6):
        before = text
        text = _TEX_LINK.sub(r"\1", text)
        text = _TEX_CODE_CMD.sub(lambda m: f"`{m[1] or m[3] or ''}`" if keep_code_marks else (m[1] or m[3] or ""), text)
        text = _TEX_CMD.sub(r"\1", text)
        if text == before:
            break
    text = _TEX_BARE.sub("", text).replace("\\\\", " ").replace("~", " ").replace("``", "“").replace("''", "”")
    text = text.replace("{", "").replace("}", "")
    return _squeeze(re.sub("\x03(\\d)", lambda m: "%$#&_{}"[int(m[1])], text))


def latex_blocks(text: str, keep_code_marks: bool = False) -> list[Block]:
    start = text.find("\\begin{document}")
    if start >= 0:
        text = text[start + len("\\begin{document}") :]
    end = text.find("\\end{document}")
    if end >= 0:
        text = text[:end]
    kept: list[Block] = []

    def code(m: re.Match[str]) -> str:
        kept.append(("code", _squeeze(m[2])))
        return f"\n\n\x00{len(kept) - 1}\x01\n\n"

    def formula(m: re.Match[str]) -> str:
        body = next(x for x in (m[3], m[4], m[5], m[6], m[7]) if x is not None)
        kept.append(("formula", _squeeze(_TEX_DROP.sub("", body))))
        return f"\x00{len(kept) - 1}\x01"

    text = _TEX_MATH.sub(formula, _TEX_COMMENT.sub("", _TEX_CODE.sub(code, text)))
    out: list[Block] = []

    def emit(kind: str, raw: str) -> None:
        for i in re.findall("\x00(\\d+)\x01", raw):
            if kept[int(i)][1]:
                out.append(kept[int(i)])
        raw = re.sub("\x00(\\d+)\x01", lambda m: "\x04" + m[1] + "\x05" if kept[int(m[1])][0] == "formula" else "", raw)
        body = _tex_inline(raw, keep_code_marks)
        body = re.sub("\x04(\\d+)\x05", lambda m: kept[int(m[1])][1], body)
        if body:
            out.append((kind, body))

    def run(piece: str) -> None:
        kind, at = "paragraph", 0
        depth = 0
        for cut in _TEX_SPLIT.finditer(piece):
            emit(kind, piece[at : cut.start()])
            at = cut.end()
            if cut[0].startswith("\\item"):
                kind = "list_item"
            else:
                depth += {"begin": 1, "end": -1}.get(cut[1] or "", 0)
                kind = "paragraph"
        emit(kind, piece[at:])

    at = 0
    for head in _TEX_HEAD.finditer(text):
        if head.start() < at:
            continue
        run(text[at : head.start()])
        depth, close = 1, head.end()
        while close < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[close], 0) if text[close - 1] != "\\" else 0
            close += 1
        emit("heading", text[head.end() : close - 1])
        at = close
    run(text[at:])
    return out


_GRAMMARS = {"html": html_blocks, "markdown": markdown_blocks, "wiki": wiki_blocks, "latex": latex_blocks}


def blocks(text: str | None, keep_code_marks: bool = False, form: str | None = None) -> list[Block]:
    """Typed blocks of a marked-up text in reading order; none for a missing or empty text. ``form`` is its notation if known."""
    if not text or not text.strip():
        return []
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\x00", "")
    return _GRAMMARS[form or notation(text)](text, keep_code_marks)


def clean_text(text: str | None, weights: tuple[float, float] | None = None) -> str:
    """Readable text: headings, list items, code and formulas keep a plain mark of what they are."""
    shape = {"heading": "# {}", "list_item": "- {}", "code": "```\n{}\n```", "formula": "$ {} $", "paragraph": "{}"}
    return "\n".join(shape[k].format(v) for k, v in region_blocks(text, weights or PLAIN_WEIGHTS))


# ---------------------------------------------------------------- maximum-scoring region

#: Exports that mark their own body and that the weights are fitted on, at most.
LABELLED = 500
#: (word, tag) weights where no labelled export is there.
PLAIN_WEIGHTS = (1.0, -1.0)

# Parts without content, marks of a body, tags and commands, and words, in the order in which they are tried.
_SCANNED = re.compile(
    r"(?P<dead><!--.*?(?:-->|\Z)|<(?P<name>script|style|template|noscript|head)\b[^>]*>.*?(?:</(?P=name)\s*>|\Z)|\\(?:documentclass|usepackage|newcommand|author|date|bibliography(?:style)?)\b[^\n]*)"
    r"|(?P<bound></?(?:html|body)\b[^<>]*>|<![^<>]*>|\\(?:begin|end)\{document\})"
    r"|(?P<tag></?[a-zA-Z][^<>]*>|\\[a-zA-Z]+\*?|\{\||\|\}|\{\{|\}\}|\[\[|\]\]|'{2,3}|={2,}|\*{1,3}|[#`~|]+)|(?P<word>\w+)",
    re.S | re.I,
)


def scan_tokens(text: str) -> list[tuple[str, int, int]]:
    """(dead | bound | tag | word, start, end) of every token of a marked-up text."""
    return [(m.lastgroup, m.start(), m.end()) for m in _SCANNED.finditer(text)]


def fit_weights(pages: list[tuple[list[bool], list[bool]]]) -> tuple[float, float]:
    """(word, tag) weights from labelled pages: per page which tokens are tags and which lie in the content.

    Log of how much likelier a word, or a tag, is inside than outside, with add-one smoothing; at most the pages given are read.
    """
    return weights_of(Counter(pair for tags, inside in pages for pair in zip(tags, inside, strict=True)))


def weights_of(seen: dict[tuple[bool, bool], int]) -> tuple[float, float]:
    """(word, tag) weights from counts by (is it a tag?, is it inside?)."""
    count = [[1 + seen.get((tag, side), 0) for side in (False, True)] for tag in (False, True)]
    total = [count[0][side] + count[1][side] for side in (0, 1)]
    word, tag = (math.log(c[1] / total[1] * total[0] / c[0]) for c in count)
    return max(word, 1e-6), min(tag, -1e-6)


def label(text: str) -> tuple[list[bool], list[bool]] | None:
    """Which tokens are tags and which lie in the body, for a text that marks its body; None for others."""
    opened = re.search(r"<body\b[^<>]*>|\\begin\{document\}", text, re.I)
    if not opened:
        return None
    closed = re.compile(r"</body\s*>|\\end\{document\}", re.I).search(text, opened.end())
    last = closed.start() if closed else len(text)
    found = [(m["word"] is None, opened.end() <= m.start() < last) for m in re.finditer(r"</?[a-zA-Z!][^<>]*>|\\[a-zA-Z]+|(?P<word>\w+)", text)]
    return [t for t, _ in found], [i for _, i in found]


def content_region(scores: list[float]) -> tuple[int, int]:
    """Bounds [a, b) of the contiguous run with the largest sum; the first of equal ones, (0, 0) if none is positive."""
    if not len(scores):
        return 0, 0
    upto = np.concatenate([[0.0], np.cumsum(scores)])
    gain = upto - np.minimum.accumulate(upto)
    end = int(np.argmax(gain))
    if gain[end] <= 0:
        return 0, 0
    before = upto[:end]
    return end - 1 - int(np.argmin(before[::-1])), end


def content_bounds(text: str, weights: tuple[float, float] = PLAIN_WEIGHTS) -> tuple[int, int]:
    """The stretch of a marked-up text that holds its content: the best region, widened to whole blocks.

    Widening stops at the marks of a body, and leaves out parts without content in front of the first
    live token or behind the last; a comment between two blocks does not stop it. A text without words is taken whole.
    """
    tokens = scan_tokens(text)
    value = {"word": weights[0], "tag": weights[1], "dead": 4 * weights[1], "bound": 4 * weights[1]}
    a, b = content_region([value[kind] for kind, _, _ in tokens])
    if a == b:
        return 0, len(text)
    first, i = a, a - 1
    while i >= 0 and tokens[i][0] != "bound":
        first = i if tokens[i][0] != "dead" else first
        i -= 1
    last, i = b, b
    while i < len(tokens) and tokens[i][0] != "bound":
        last = i + 1 if tokens[i][0] != "dead" else last
        i += 1
    return (tokens[first - 1][2] if first else 0), (tokens[last][1] if last < len(tokens) else len(text))


def fitted_weights(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[float, float]:
    """Weights fitted on about ``LABELLED`` exports that mark their own body, those with the smallest hashes of their ids.

    The texts stay in the tasks; hashes and then four counts are all that comes to the driver.
    """
    marked = df.filter(F.col(text).rlike(r"(?i)<body\b|\\begin\{document\}")).select(F.col(text).alias("text"), F.xxhash64(doc_id).alias("h"))
    chosen = marked.select("h").orderBy("h").limit(LABELLED).agg(F.max("h")).first()[0]
    if chosen is None:
        return PLAIN_WEIGHTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = Counter()
            for body in batch.column("text").to_pylist():
                if found := label(body):
                    pairs.update(zip(*found, strict=True))
            keys = list(pairs)
            yield pa.record_batch([pa.array([k[0] for k in keys], pa.bool_()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([pairs[k] for k in keys], pa.int64())], names=["tag", "inside", "n"])

    counted = marked.filter(F.col("h") <= chosen).select("text").mapInArrow(run, "tag boolean, inside boolean, n long").groupBy("tag", "inside").agg(F.sum("n").alias("n")).collect()
    return weights_of({(r.tag, r.inside): r.n for r in counted})


def region_blocks(text: str | None, weights: tuple[float, float] = PLAIN_WEIGHTS, keep_code_marks: bool = False) -> list[Block]:
    """Typed blocks of the content region of a marked-up text."""
    if not text or not text.strip():
        return []
    form = notation(text)
    a, b = content_bounds(text, weights)
    return blocks(text[a:b], keep_code_marks, form)


# ---------------------------------------------------------------- operator

def elements(df: DataFrame, doc_id: str = "doc_id", text: str = "text", weights: tuple[float, float] | None = None) -> DataFrame:
    """Distinct structural elements of every marked-up text: (doc_id, element, content). No shuffle.

    Null, empty and unmarked texts give no rows; further columns are ignored; an element that a
    document repeats word for word is given once per input row. Without ``weights`` they are fitted on the input.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("length(text) > 0")
    fitted = fitted_weights(rows) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picks, kinds, bodies = [], [], []
            for row, body in enumerate(batch.column("text").to_pylist()):
                for kind, content in dict.fromkeys(b for b in region_blocks(body, fitted) if b[0] != "paragraph"):
                    picks.append(row)
                    kinds.append(kind)
                    bodies.append(content)
            yield pa.record_batch([batch.column("doc_id").take(pa.array(picks, pa.int64())), pa.array(kinds, pa.string()), pa.array(bodies, pa.string())], names=["doc_id", "element", "content"])

    return spread(rows).mapInArrow(run, "doc_id long, element string, content string")


def cleaned(df: DataFrame, doc_id: str = "doc_id", text: str = "text", weights: tuple[float, float] | None = None) -> DataFrame:
    """Every row's readable text: (doc_id, clean_text); a missing text gives an empty one. Without ``weights`` they are fitted on the input."""
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    fitted = fitted_weights(rows) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [clean_text(t, fitted) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "clean_text"])

    return spread(rows).mapInArrow(run, "doc_id long, clean_text string")
