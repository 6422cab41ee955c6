"""Main body of web pages: layout-aware rendering, then lines outside of it.

A page that still holds tags is rendered first. A builder turns its tags into a balanced tree: void
elements, implied ends (of paragraphs, list items, rows, cells ...) and ends without a beginning are
resolved; hidden parts and scripts are left out. The layout gives every block its own line, keeps the
space between blocks, puts bullets before list items and aligns the cells of a table; every line
knows the line of the source it comes from and whether it stands in navigation, a form or a footer.

Rendering emits all visible text, and pages may have been rendered before, so lines are then told
apart by what the pages of a collection have in common (``line_model``): a line, its numbers and its
site's name masked, that recurs on many pages of several sites and stands above the title or at the
end of the page more often than an article's line does, is site furniture; one that is nearly
always followed by titles is the caption of a list of other pages. What is too rare to be learnt is
decided by the purpose it names (consent, subscription, sharing ...), and by the shape of menus,
breadcrumbs, tag and paging lines. The rest is the article, and so is what stands in its place.
"""

from __future__ import annotations

import html
import re
import struct
from bisect import bisect_right
from collections import ChainMap
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.plans.runtime import materialize, spread

#: A learnt line recurs on so many pages of so many sites.
LEAST_PAGES = 20
LEAST_SITES = 2
#: Least share of its occurrences above the title or at the end of a page.
LEAST_MARGIN = 0.12
#: Share of a caption's occurrences that a title of another page follows.
CAPTION_SHARE = 0.85
#: Learnt lines that are shipped with the tasks, the most frequent first; pages look up all others by a join.
MODEL_LINES = 50_000
FURNITURE, CAPTION = 1, 2

# Labels of menus, first crumbs of breadcrumbs, openings of tag, paging and language lines.
LABELS = """
Home, About us, Products, Solutions, Pricing, Docs, Documentation, Blog, Support, Contact, Careers, Community, Partners, Status, Security, Sign in, Log in,
Sign up, Start free trial, Help, News, FAQ, Forum, Startseite, Über uns, Produkte, Lösungen, Preise, Doku, Hilfe, Kontakt, Karriere, Partner, Neuigkeiten,
Anmelden, Accueil, À propos, Produits, Solutions, Tarifs, Assistance, Carrières, Partenaires, Actualités, Connexion, Inicio, Acerca de, Productos,
Soluciones, Precios, Documentación, Ayuda, Contacto, Empleo, Socios, Noticias, Entrar, Over ons, Producten, Prijzen, Nieuws, Inloggen, Prodotti, Prezzi, Chi siamo, Accedi
"""
CRUMBS = "Home|Startseite|Accueil|Inicio|Hoofdpagina|Start"
PREFIXED = "Tags|Tagged|Topics|Schlagwörter|Mots-clés|Etiquetas|Trefwoorden|Tag|Follow us|Folgen Sie uns|Suivez-nous|Síganos|Volg ons|Share|Change language|Language|Sprache|Langue|Idioma|Taal|Lingua"
NEIGHBOURS = "Previous|Next|Zurück|Weiter|Précédent|Suivant|Anterior|Siguiente|Vorige|Volgende|Precedente|Successivo"
PAGING = r"(?:Page|Seite|Página|Pagina) \d+ (?:of|von|sur|de|van|di) \d+|(?:[«‹<] *)?(?:\d+ +){2,}(?:… *\d+ *)?(?:[»›>])?"
# Purposes of site furniture in several languages: words of which a line holds one, and the shape of the whole line.
PURPOSES = [
    ("cookie cookies small kleine", r"(?:we|this (?:web)?site|our (?:partners|site)|wir|diese (?:website|seite)|nous|ce site|este sitio|usamos|utilizamos|wij|deze (?:website|site)|questo sito)\b[^.]*\b(?:use|uses|store|stores|verwende[nt]|nutz(?:en|t)|utilis(?:e|ons)|utiliza|usa|gebruik(?:en|t)?|utilizza|speichert)\b[^.]*\b(?:cookies?|small files|kleine dateien)\b.*"),
    ("cookie cookies", r"(?:by (?:browsing|continuing|using)|mit der nutzung|en (?:poursuivant|continuant)|al (?:continuar|navegar)|door verder te gaan)\b.*\bcookies?\b.*"),
    ("cookie cookies", r".*\b(?:choose|select|manage|wählen|choisissez|elija)\b.*\bcookies?\b.*|.*\bcookies?\b.*\b(?:accept|agree|consent|akzeptieren|accepter|aceptar|accepteren|accettare)\b.*"),
    ("accept reject allow decline necessary consent preferences settings choix preferencias verwalten einstellungen instellingen", r"(?:accept|reject|allow|decline)(?: all| only)?(?: (?:cookies?|necessary|optional))*(?: ones)?|only necessary(?: ones| cookies)?|(?:manage|gérer|gestionar|einwilligung|cookie)\b.{0,20}\b(?:consent|preferences|settings|choix|preferencias|verwalten|einstellungen|instellingen)"),
    ("sell", r"(?:do not|don.t) sell (?:or share )?my (?:data|(?:personal )?information)"),
    ("newsletter mailing updates mail email lettre boletín abonnieren nieuwsbrief list", r"(?:subscribe|sign up|join|newsletter|abonnez-vous|suscríbase|suscríbete|inscrivez-vous|meld je aan|schrijf je in|iscriviti|abonnieren)\b.{0,60}\b(?:newsletter|mailing list|updates|e-?mail|lettre|boletín|abonnieren|nieuwsbrief|list)\b.{0,20}|.{0,20}\b(?:newsletter) (?:abonnieren|bestellen)"),
    ("mail email", r"(?:enter|your|type|ihre|votre|su|uw)\b.{0,12}\be-?mail(?:[ -]address|-adresse|adres)?"),
    ("search suche suchen rechercher buscar zoeken cerca durchsuchen", r"(?:search|suche[n]?|rechercher|buscar|zoeken|cerca)(?: (?:this|our|the) (?:site|website|docs)| …|\.\.\.)?|(?:diese seite|ce site|este sitio) (?:durchsuchen|rechercher|buscar)"),
    ("content navigation inhalt contenu inhoud", r"(?:skip|jump) to (?:the )?(?:main )?(?:content|navigation)|zum inhalt springen|aller au contenu|ir al contenido|naar (?:de )?inhoud|vai al contenuto"),
    ("top oben haut arriba boven torna", r"(?:back|return|go) to (?:the )?top|nach oben|haut de page|volver arriba|naar boven|torna su"),
    ("log sign leave post loading", r"(?:log|sign) in to (?:leave|post|write|add|comment|reply)\b.{0,40}|(?:leave|post) a (?:comment|reply)|loading (?:comments?|more)\b.{0,10}"),
    ("helpful useful hilfreich aidé útil nuttig rate", r"(?:was|is|war|cette|le|hat|¿le) .{0,40}\b(?:helpful|useful|hilfreich|aidé|útil|nuttig)\b.{0,30}|rate this (?:page|article)\b.{0,20}"),
    ("share teilen partager compartir delen condividi drucken", r"(?:share|teilen|partager|compartir|delen|condividi)(?: (?:this|on|via|auf|sur|en)\b.{0,30})?(?: *[|·•] *.{1,30})*|(?:seite|artikel) (?:teilen|drucken)(?: *[|·•] *.{1,30})*"),
    ("advertisement sponsored anzeige publicité publicidad advertentie pubblicità", r"advertisement|sponsored(?: (?:content|post))?|anzeige|publicité|publicidad|advertentie|pubblicità"),
    ("navigation menu sidebar talk speak free", r"(?:toggle|open|close|show|hide) (?:navigation|menu|sidebar)|menu|(?:talk|speak) to (?:sales|us|an expert)|(?:download|get) (?:our|the) free \w+"),
    ("© c copyright rights rechte droits derechos diritti rechten", r"(?:©|\(c\)|copyright ©?)\s*(?:\d{4}(?:\s*[-–]\s*\d{4})?)\b.{0,80}|.{0,60}\b(?:all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados|alle rechten voorbehouden|tutti i diritti riservati)\.?"),
    ("mark marks trademark trademarks made powered", r".{1,60} (?:is|are) (?:a )?registered (?:trade)?marks? of .{1,60}|made with (?:care|love|♥|❤).{0,40}|powered by .{1,40}"),
    ("comment comments view views shares likes replies", r".{0,200}\b\d+ (?:comments?|views?|shares?|likes?|replies)(?: *[|·•] *\d+ (?:comments?|views?|shares?|likes?|replies))*"),
    ("javascript", r"(?:some|parts|einige|certaines|algunas)\b.{0,30}\b(?:features|parts|functions|funktionen|fonctions|funciones)\b.{0,30}\bjavascript\.?"),
    ("privacy cookie terms imprint impressum datenschutz agb sitemap accessibility legal confidentialité plan privacidad mapa contact colofon privacybeleid voorwaarden", r"(?:(?:privacy|cookie)(?: policy| notice)?|terms(?: of (?:use|service))?|imprint|impressum|datenschutz|agb|sitemap|accessibility|legal(?: notice)?|mentions légales|confidentialité|plan du site|aviso legal|privacidad|mapa del sitio|contact|colofon|privacybeleid|voorwaarden)(?: *[|·•–] *(?:[\w ]{2,30}))*"),
]
# Captions of lists of other pages.
CAPTIONS = [
    r"recommended(?: for you| reading| articles)?|(?:in|from) this series|(?:you may|you might) also like|popular (?:this week|now|articles|posts)|most (?:read|popular)|(?:related|similar|further|latest|recent) (?:articles?|posts?|pages?|reading|topics)|read next|see also|up next|more (?:from|about|on) .{1,60}|more articles",
    r"das könnte (?:sie|dich) auch interessieren|ähnliche (?:beiträge|artikel)|mehr (?:von|zu|aus) .{1,60}|weitere (?:beiträge|artikel)|meistgelesen",
    r"à lire aussi|articles? (?:liés|similaires|connexes)|voir aussi|plus de .{1,60}|les plus lus",
    r"artículos relacionados|también (?:le|te) puede interesar|más (?:de|sobre) .{1,60}|lo más leído|lees ook|gerelateerde artikelen|meer van .{1,60}|articoli correlati|leggi anche",
]
# Verbs that open the steps of an article.
STEP_VERBS = frozenset(
    "add adjust apply archive ask assign build call cancel change check choose clean clear close collect compare configure copy count create delete disable download edit empty enable "
    "enter export fetch fill find fix import inspect install invite keep label link list load lock log mark mask merge move open pause pick prune publish purge rank read rebuild "
    "reload remove rename repair repeat replace request reset restart restore review rotate run save schedule select send set sign sort split start stop store switch sync tag test turn "
    "unlock update upload validate verify view wait write".split()
)

_LABEL = frozenset(x.strip().lower() for x in LABELS.replace("\n", " ").split(",") if x.strip())
_PURPOSE = [(frozenset(words.split()), re.compile(shape)) for words, shape in PURPOSES]
_PURPOSE_WORDS = frozenset().union(*(words for words, _ in _PURPOSE))
_PURPOSE_BY_WORD = {word: [shape for words, shape in _PURPOSE if word in words] for word in _PURPOSE_WORDS}
_WORD = re.compile(r"[^\W\d_]+|©")
_CAPTION = re.compile("|".join(f"(?:{p})" for p in CAPTIONS))
_SHAPE = re.compile(rf"(?:{CRUMBS}) *[>»›/] .+|(?:{PREFIXED}) ?: .+|(?:{NEIGHBOURS}) ?: .+|{PAGING}")
_CRUMB = re.compile(rf"(?:{CRUMBS}) *([>»›/]) ")
_MENU = re.compile(r"\s+[|·•]\s+|\s{2,}|\t+")
_MENU_MARKS = ("|", "·", "•", "  ", "\t")
_TERMINAL = re.compile(r"[.!?…:;。！？।؟][\"”»“’)\]]*$")
_DIGITS = re.compile(r"\d+")
_NUMBER = struct.Struct("<q")
_HOST = re.compile(r"([a-z]+)\d*\.[a-z]+$")


@dataclass(frozen=True)
class LineModel:
    """Masked lines (as hashes) that pages of a collection share, and what each is.

    ``kinds`` are shipped with the tasks; ``rest`` (key, kind) has the lines beyond ``MODEL_LINES`` if there are any.
    """

    kinds: Mapping[int, int]
    rest: DataFrame | None = None

    def kind(self, line: str, host: str | None) -> int:
        return self.kinds.get(_key(line, host), 0) if self.kinds else 0


NOTHING_LEARNT = LineModel({})


def _host(site: str | None) -> str | None:
    """The name inside a site's address."""
    found = _HOST.search(site) if site else None
    return found[1] if found else None


def _key(line: str, host: str | None) -> int:
    """Hash of a line with its numbers and its site's name masked, case and spacing folded."""
    masked = " ".join(_DIGITS.sub("0", line.lower()).split())
    if host and host in masked:
        masked = masked.replace(host, "<s>")
    return _NUMBER.unpack(blake2b(masked.encode(), digest_size=8).digest())[0]


def _has_purpose(low: str) -> bool:
    return any(shape.fullmatch(low) for word in _PURPOSE_WORDS.intersection(_WORD.findall(low)) for shape in _PURPOSE_BY_WORD[word])


def _parts(line: str) -> list[str]:
    """Entries of a menu line; a line that is no menu has one."""
    return _MENU.split(line) if any(mark in line for mark in _MENU_MARKS) else [line]


def _label(part: str, host: str | None, model: LineModel) -> bool:
    return part.lower() in _LABEL or model.kind(part, host) == FURNITURE


def line_kind(line: str, host: str | None = None, model: LineModel = NOTHING_LEARNT) -> int:
    """What a line is by itself: ``FURNITURE``, the ``CAPTION`` of a list of other pages, or 0."""
    learnt = model.kind(line, host)
    if learnt:
        return learnt
    low = line.lower()
    if low in _LABEL or _SHAPE.fullmatch(line) or _has_purpose(low):
        return FURNITURE
    if _CAPTION.fullmatch(low):
        return CAPTION
    parts = _parts(line)
    return FURNITURE if len(parts) > 1 and sum(_label(p.strip(), host, model) for p in parts) * 2 >= len(parts) else 0


def title_like(line: str) -> bool:
    """Could this line be the title of another page? It is no sentence, menu or step."""
    words = line.split()
    if len(words) < 2 or line[0].islower() or _TERMINAL.search(line) or ". " in line:
        return False
    return not (len(words) <= 4 and words[0].lower() in STEP_VERBS and all(w.islower() or w.isupper() for w in words[1:]))


def _titles(bare: list[str], title: str | None) -> set[str]:
    """The page's title as given and as the last crumb of its breadcrumb."""
    titles = {title.strip()} if title and title.strip() else set()
    for line in bare:
        if crumb := _CRUMB.match(line):
            titles.add(line.rpartition(f" {crumb[1]} ")[2].strip())
            break
    return titles


def walk_lines(lines: list[str], title: str | None = None, site: str | None = None, model: LineModel = NOTHING_LEARNT, chrome: list[bool] | None = None) -> Iterator[tuple[int, bool]]:
    """(number from 1, is it outside the main body?) of every line that is not empty, in order; ``chrome`` marks lines the layout sets apart.

    A line is looked at only when its turn comes, but for the entries of a list of other pages.
    """
    bare = [x.strip() for x in lines]
    titles = _titles(bare, title)
    filled = [i for i, line in enumerate(bare) if line]
    host = _host(site)
    known: dict[int, int] = {}

    def kind(k: int) -> int:
        if k not in known:
            known[k] = line_kind(bare[filled[k]], host, model)
        return known[k]

    seen_title = started = False
    k = 0
    while k < len(filled):
        i = filled[k]
        k += 1
        if bare[i] in titles and not seen_title:
            seen_title = started = True
            yield i + 1, False
        elif chrome and chrome[i]:
            yield i + 1, True
        elif kind(k - 1) == CAPTION:
            yield i + 1, True
            run: list[int] = []
            while k < len(filled):
                nxt = bare[filled[k]]
                if (nxt in titles and not seen_title) or kind(k) or not title_like(nxt):
                    break
                run.append(filled[k])
                k += 1
            # without a known title the last of several titles before an article is its own
            ends_at_title = k < len(filled) and bare[filled[k]] in titles and not seen_title
            own = len(run) > 1 and not titles and not started and k < len(filled) and not kind(k) and not ends_at_title
            if own:
                seen_title = started = True
            for n, j in enumerate(run):
                yield j + 1, not (own and n + 1 == len(run))
        else:
            started = started or not kind(k - 1)
            yield i + 1, kind(k - 1) == FURNITURE


def outside_lines(lines: list[str], title: str | None = None, site: str | None = None, model: LineModel = NOTHING_LEARNT, chrome: list[bool] | None = None) -> list[int]:
    """Numbers (from 1) of the non-empty lines outside the main body."""
    return [n for n, outside in walk_lines(lines, title, site, model, chrome) if outside]


# ---------------------------------------------------------------- what pages have in common

def _observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, site, marks) of every line and menu label; bits of marks: above the title, last line, before a title, the title."""
    for batch in batches:
        keys, sites, marks = [], [], []
        for text, title, site in zip(*(batch.column(c).to_pylist() for c in ("text", "title", "site")), strict=True):
            filled = [y for x in page_lines(text)[0] if (y := x.strip())]
            titles, host = _titles(filled, title), _host(site)
            at = next((n for n, x in enumerate(filled) if x in titles), 0)
            opens = [x not in titles and title_like(x) for x in filled[1:]] + [False]
            for n, line in enumerate(filled):
                mark = (n < at) + 2 * (n + 1 == len(filled))
                keys.append(_key(line, host))
                marks.append(mark + 4 * opens[n] + 8 * (line in titles))
                parts = _parts(line)
                if len(parts) > 1:
                    keys.extend(_key(p, host) for p in parts)
                    marks.extend([mark] * len(parts))
            sites.extend([site or ""] * (len(keys) - len(sites)))
        yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(sites, pa.string()), pa.array(marks, pa.int8())], names=["key", "site", "marks"])


def line_model(df: DataFrame, text: str = "text", title: str = "title", site: str = "site") -> LineModel:
    """The lines that pages share, counted over all pages; only hashes and counts are shuffled.

    All lines that recur often enough are kept: the ``MODEL_LINES`` most frequent come to the driver, the others stay
    in the checkpoint folder. A null site counts as one site.
    """
    rows = df.select(*[(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(n) for c, n in ((text, "text"), (title, "title"), (site, "site"))])
    seen = spread(rows.filter("length(text) > 0")).mapInArrow(_observed, "key long, site string, marks byte")
    one = lambda bit, name: F.sum(F.getbit("marks", F.lit(bit)).cast("int")).alias(name)
    by_site = seen.groupBy("key", F.xxhash64("site").alias("site")).agg(F.count(F.lit(1)).alias("pages"), *[one(bit, name) for bit, name in enumerate(("above", "last", "opens", "titled"))])
    by_line = by_site.groupBy("key").agg(F.count(F.lit(1)).alias("sites"), *[F.sum(c).alias(c) for c in ("pages", "above", "last", "opens", "titled")])
    often = by_line.filter((F.col("pages") >= LEAST_PAGES) & (F.col("sites") >= LEAST_SITES) & (F.col("titled") < 0.02 * F.col("pages")) & (F.col("above") + F.col("last") >= F.greatest(LEAST_MARGIN * F.col("pages"), F.lit(5))))
    kind = F.when(F.col("opens") >= CAPTION_SHARE * F.col("pages"), CAPTION).otherwise(FURNITURE).alias("kind")
    learnt = materialize(often.select("key", "pages", kind))
    first = learnt.orderBy(F.desc("pages"), "key").limit(MODEL_LINES + 1).collect()
    kinds = {r.key: r.kind for r in first[:MODEL_LINES]}
    if len(first) <= MODEL_LINES:
        return LineModel(kinds)
    after = first[MODEL_LINES]
    return LineModel(kinds, learnt.filter((F.col("pages") < after.pages) | (F.col("pages") == after.pages) & (F.col("key") >= after.key)).select("key", "kind"))


def _line_keys(text: str, site: str | None) -> set[int]:
    """Keys of all that ``line_kind`` may look up for the lines of a page."""
    host = _host(site)
    return {_key(part, host) for x in page_lines(text)[0] if (line := x.strip()) for part in (line, *_parts(line))}


def _with_learnt(rows: DataFrame, model: LineModel) -> DataFrame:
    """Add what the lines of every page are by ``model.rest``: the keys (furniture, captions), null for none.

    Keys meet the learnt lines in a join; those of the hottest lines are shipped and need none. Pages are then joined with
    their keys by a hash; pages of equal hashes share their keys, which is no harm, as a page looks up only its own lines.
    """
    if model.rest is None:
        none = F.lit(None).cast("array<long>")
        return rows.withColumns({"furniture": none, "captions": none})
    shipped = model.kinds

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, keys = [], []
            for page, text, site in zip(*(batch.column(c).to_pylist() for c in ("page", "text", "site")), strict=True):
                own = [key for key in _line_keys(text, site) if key not in shipped]
                pages.extend([page] * len(own))
                keys.extend(own)
            yield pa.record_batch([pa.array(pages, pa.int64()), pa.array(keys, pa.int64())], names=["page", "key"])

    hashed = rows.withColumn("page", F.xxhash64("id", "text", "title", "site"))
    if "Exchange" in hashed._jdf.queryExecution().executedPlan().toString():
        hashed = materialize(hashed)  # what comes out of a shuffle may choose other rows when it runs again
    asked = spread(hashed.filter("length(text) > 0").select("page", "text", "site")).mapInArrow(ask, "page long, key long")
    of = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("key")))
    known = asked.join(model.rest, "key").groupBy("page").agg(of(FURNITURE).alias("furniture"), of(CAPTION).alias("captions"))
    return hashed.join(known, "page", "left").drop("page")


def _walked(batch: pa.RecordBatch, shipped: dict[int, int]) -> Iterator[tuple[str | None, str | None, str | None, LineModel]]:
    """(text, title, site, model) of every row of ``_with_learnt``."""
    common = LineModel(shipped)
    for text, title, site, furniture, captions in zip(*(batch.column(c).to_pylist() for c in ("text", "title", "site", "furniture", "captions")), strict=True):
        own = dict.fromkeys(furniture or (), FURNITURE) | dict.fromkeys(captions or (), CAPTION)
        yield text, title, site, LineModel(ChainMap(own, shipped)) if own else common


# ---------------------------------------------------------------- rendering

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(script|style|template|noscript|head|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|</?[a-zA-Z][^<>]*>|[^<]+|<", re.S | re.I)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
_HIDDEN = re.compile(r"\shidden(?:[\s=>/]|$)|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CHROME_ROLE = re.compile(r"\brole\s*=\s*[\"']?(?:navigation|banner|contentinfo|search|complementary|dialog)\b", re.I)
_LOOKS_HTML = re.compile(r"<(?:html|body|div|p|h[1-6]|ul|table|nav|section|article)\b[^<>]*>", re.I)
# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure".split())
BLOCK = SPACED | frozenset("address article aside body dd details dialog div dt fieldset figcaption footer form header hr html li main menu nav section summary tr caption thead tbody tfoot".split())
CHROME = frozenset("nav footer aside form button select".split())
# What the beginning of an element ends, and where the search for it stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}


def tree_events(text: str) -> Iterator[tuple[str, str, str, int]]:
    """The balanced tree of a page as (open | text | close, element, its tag or the text, offset), every open element closed."""
    stack: list[str] = []

    def unwind(to: int, at: int) -> Iterator[tuple[str, str, str, int]]:
        while len(stack) > to:
            yield "close", stack.pop(), "", at

    for found in _TOKEN.finditer(text):
        token, at = found[0], found.start()
        if token[0] != "<" or token == "<":
            yield "text", stack[-1] if stack else "", html.unescape(token) if "&" in token else token, at
            continue
        name_match = _NAME.match(token)
        if found[1] or name_match is None:
            continue
        name = name_match[1].lower()
        if token[1] == "/":
            if name in stack:
                yield from unwind(len(stack) - 1 - stack[::-1].index(name), at)
            continue
        if name in ENDS or name in BLOCK:
            ended, fence = ENDS.get(name, (set(), {"table", "ul", "ol", "dl", "td", "th", "li", "dd"}))
            ended = ended | ({"p"} if name in BLOCK else set())
            low = len(stack)
            for n in range(len(stack) - 1, -1, -1):
                if stack[n] in ended:
                    low = n
                elif stack[n] in fence:
                    break
            yield from unwind(low, at)
        yield "open", name, token, at
        if name in VOID or token.endswith("/>"):
            yield "close", name, "", at
        else:
            stack.append(name)
    yield from unwind(0, len(text))


def render(text: str) -> list[tuple[str, int, bool]]:
    """(line, number of its source line from 1, does it stand in navigation, a form or a footer?) of the visible text."""
    breaks = [m.start() for m in re.finditer("\n", text)]
    lines: list[tuple[str, int, bool]] = []
    words: list[str] = []
    first = 0
    hidden = chrome = pre = 0
    marks: list[tuple[bool, bool]] = []
    tables: list[list[list[str]]] = []
    bullet = ""

    def put(line: str, at: int) -> None:
        lines.append((line, bisect_right(breaks, at - 1) + 1 if at else 1, chrome > 0))

    def flush() -> None:
        nonlocal bullet
        body = " ".join("".join(words).split())
        words.clear()
        if not body:
            return
        if tables:
            rows = tables[-1]
            if not rows:
                rows.append([])
            if not rows[-1]:
                rows[-1].append("")
            rows[-1][-1] = f"{rows[-1][-1]} {body}".strip()
        else:
            put(bullet + body, first)
            bullet = ""

    def space() -> None:
        if lines and lines[-1][0] and not tables:
            put("", 0)

    for what, name, value, at in tree_events(text):
        if what == "text":
            if hidden:
                continue
            if pre and not tables:
                for n, part in enumerate(value.strip("\n").split("\n")):
                    put(part, at + n)
            else:
                if not words or not "".join(words).strip():
                    first = at + len(value) - len(value.lstrip())
                words.append(value)
            continue
        if what == "open":
            off = bool(_HIDDEN.search(value)) and name not in VOID
            mine = name in CHROME or bool(_CHROME_ROLE.search(value))
            if name not in VOID:
                marks.append((off, mine))
            if name == "br":
                words.append("\n") if tables else flush()
            elif name in BLOCK or name in ("td", "th"):
                flush()
            hidden += off
            chrome += mine
            if hidden:
                continue
            if name in SPACED:
                space()
            if name == "table":
                tables.append([])
                table_at = at
            elif name == "tr" and tables:
                tables[-1].append([])
            elif name in ("td", "th") and tables:
                if not tables[-1]:
                    tables[-1].append([])
                tables[-1][-1].append("")
            elif name == "li":
                bullet = "- "
            elif name == "pre":
                pre += 1
            continue
        if name in VOID:
            continue
        off, mine = marks.pop() if marks else (False, False)
        if not hidden and (name in BLOCK or name in ("td", "th")):
            flush()
        if not hidden:
            if name == "table" and tables:
                rows = tables.pop()
                width = [max((len(r[c]) for r in rows if c < len(r)), default=0) for c in range(max(map(len, rows), default=0))]
                made = ["  ".join(cell.ljust(width[c]) for c, cell in enumerate(r)).rstrip() for r in rows if any(r)]
                if tables:
                    words.extend(f" {x} " for x in made)
                else:
                    for x in made:
                        put(x, table_at)
            elif name == "pre":
                pre = max(0, pre - 1)
            elif name == "li":
                bullet = ""
            if name in SPACED:
                space()
        hidden -= off
        chrome -= mine
    flush()
    while lines and not lines[-1][0]:
        lines.pop()
    return lines


def page_lines(text: str) -> tuple[list[str], list[int] | None, list[bool] | None]:
    """Lines of a page, rendered first if it still holds tags; then also their source lines and whether the layout sets them apart."""
    if "<" not in text or not _LOOKS_HTML.search(text):
        return text.split("\n"), None, None
    rendered = render(text)
    return [x[0] for x in rendered], [x[1] for x in rendered], [x[2] for x in rendered]


def furniture_numbers(text: str, title: str | None, site: str | None = None, model: LineModel = NOTHING_LEARNT) -> list[int]:
    """Numbers of the lines of the text as it is that lie outside the main body: all that is rendered from them does."""
    lines, numbers, chrome = page_lines(text)
    out = outside_lines(lines, title, site, model, chrome)
    if numbers is None:
        return out
    drop = set(out)
    kept = {numbers[n - 1] for n, line in enumerate(lines, 1) if line.strip() and n not in drop}
    return sorted({numbers[n - 1] for n in out} - kept)


def main_body(text: str | None, title: str | None = None, site: str | None = None, model: LineModel = NOTHING_LEARNT) -> str:
    """The page without its furniture; empty for a missing text."""
    if not text:
        return ""
    lines, _, chrome = page_lines(text)
    drop = set(outside_lines(lines, title, site, model, chrome))
    return "\n".join(x for n, x in enumerate(lines, 1) if n not in drop).strip("\n")


def _selected(df: DataFrame, key: str, text: str, title: str, site: str) -> DataFrame:
    have = F.col(site) if site in df.columns else F.lit(None).cast("string")
    return df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.col(title).alias("title"), have.alias("site"))


def furniture_lines(df: DataFrame, key: str, text: str, title: str, site: str = "site", model: LineModel | None = None) -> DataFrame:
    """Lines outside the main body, numbered from 1: (key, line_no). Texts are shuffled only if more lines are learnt than are shipped.

    Without a ``model`` it is fitted on the given pages. Null and empty texts give no rows; empty lines are
    counted but never reported; a missing title is taken from the breadcrumb if there is one; further columns are ignored.
    """
    rows = _selected(df, key, text, title, site).filter("length(text) > 0")
    fitted = line_model(rows) if model is None else model
    shipped = fitted.kinds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picks, numbers = [], []
            for row, values in enumerate(_walked(batch, shipped)):
                hits = furniture_numbers(*values)
                picks.extend([row] * len(hits))
                numbers.extend(hits)
            yield pa.record_batch([batch.column("id").take(pa.array(picks, pa.int64())), pa.array(numbers, pa.int64())], names=["id", "line_no"])

    return spread(_with_learnt(rows, fitted)).mapInArrow(run, "id long, line_no long").withColumnRenamed("id", key)


def main_texts(df: DataFrame, key: str, text: str, title: str, site: str = "site", model: LineModel | None = None) -> DataFrame:
    """The main body of every row: (key, main_text); a missing text gives an empty one. Without a ``model`` it is fitted on these rows."""
    rows = _selected(df, key, text, title, site)
    fitted = line_model(rows) if model is None else model
    shipped = fitted.kinds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [main_body(*values) for values in _walked(batch, shipped)]
            yield pa.record_batch([batch.column("id"), pa.array(bodies, pa.string())], names=["id", "main_text"])

    return spread(_with_learnt(rows, fitted)).mapInArrow(run, "id long, main_text string").withColumnRenamed("id", key)
