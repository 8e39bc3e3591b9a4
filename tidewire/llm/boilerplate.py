"""Main content of pages: which lines belong to the report (problem 2).

A page is a tree: for markup its DOM (elements, and the texts in them), for plain text the page, its regions (the runs of
paragraphs, of lines with marks of furniture and of other short lines) and their lines. A tree-structured graphical model gives each
node a hidden state, content or furniture: line potentials come from a logistic model over line features, element potentials from tags
and class names, parent-child potentials connect every node with the one above, and how the page was read (fetch_method) gives the
root's. Sum-product message passing upward and downward, level by level over the trees of many pages at once, gives the exact marginal of each line.

The model is trained from pages labelled by hand (`labelled_pages`) and refitted, with the marginals of the tree in place of missing
labels, together with a bounded sample of the corpus's own pages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .labelled_pages import HTML_PAGES, PAGES
from .repeats import normal_line
from .residue import fold, is_residue

#: Bound of the unlabelled part of the training: so many pages, the smallest by a hash of the id.
SAMPLE_PAGES = 3000
#: What a worker remembers of lines that come again: so many lines of so many sources, about 100 MB; it changes no result.
REMEMBERED_LINES = 1500
REMEMBERED_SOURCES = 100
#: A line labelled by hand counts as so many of the sample.
LABEL_WEIGHT = 20.0
#: A short line counts as known furniture when it stands in so many sample pages of one source.
FREQUENT = 4
#: So many keys of frequent lines, about 40 MB in a worker, are broadcast at most; beyond, each page gets its own by a join.
BROADCAST_LINES = 500_000
PARAGRAPH_WORDS = 14
MAX_PHRASE_LINE = 45

# Phrases in lower case that mark furniture, by kind.
PHRASES = {
    "legal": "©|(c) 20|all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados|tutti i diritti riservati|wszelkie prawa zastrzeżone|усі права захищено|все права защищены|no part of this text|may be copied or redistributed|jede weitergabe dieses textes|schriftlichen zustimmung von|toute reproduction de ce texte|accord écrit de|queda prohibida la copia|prohibida la copia|permiso escrito de|è vietata la copia|vietata la riproduzione|consenso scritto di|kopiowanie tego tekstu|bez pisemnej zgody|передрук цього тексту|без письмової згоди|перепечатка этого текста|без письменного согласия|press complaints board|den regeln des presserats|adhère au conseil de la presse|pertenece al consejo de prensa|aderisce al consiglio della stampa|należy do rady prasowej|входить до ради преси|входит в совет прессы|terms of use|privacy policy|impressum|mentions légales|aviso legal|note legali|regulamin serwisu",
    "cookie": "use of cookies|uses cookies|store cookies|cookies to measure|cookie preferences|cookie settings|accept all|nutzt cookies|verwendung von cookies|speichern cookies|alle akzeptieren|datenschutz-einstellungen|cookie-einstellungen|utilise des cookies|enregistrons des cookies|utilisation des cookies|utilisation de cookies|usage des cookies|gérer mes cookies|tout accepter|uso de cookies descrito|usa cookies|guardamos cookies|configurar cookies|aceptar todo|uso dei cookie|usa cookie|salviamo cookie|preferenze sui cookie|accetta tutto|używa plików cookie|zapisujemy pliki cookie|zgadzasz się na pliki cookie|akceptuj wszystko|ustawienia prywatności|використовує файли cookie|зберігаємо файли cookie|погоджуєтеся на файли cookie|прийняти все|налаштування приватності|использует файлы cookie|сохраняем файлы cookie|соглашаетесь на файлы cookie|принять все|настройки приватности|our privacy notice",
    "subscribe": "already a subscriber|log in|free articles left|sign up for|subscribe to|subscribe now|morning letter|morning briefing|bereits abonnent|anmelden|freie artikel|jetzt abonnieren|morgenbrief|déjà abonné|se connecter|articles gratuits|inscrivez-vous|lettre du matin|abonnez-vous|ya es suscriptor|inicie sesión|artículos gratis|suscríbase|carta de la mañana|già abbonato|acceda|articoli gratuiti|iscriviti|si iscriva|lettera del mattino|abbonati|masz już abonament|zaloguj się|darmowych tekstów|zapisz się|poranny list|уже маєте передплату|увійти|безкоштовних статей|підпишіться|ранковий лист|уже есть подписка|войти|бесплатных статей|подпишитесь|утреннее письмо",
    "share": "share this story|share this article|copy link|send by e-mail|follow us|on your favourite network|artikel teilen|link kopieren|per e-mail senden|in den netzwerken|mal geteilt|partager cet article|partager l'article|copier le lien|envoyer par courriel|sur les réseaux|compartir (|copiar enlace|enviar por correo|en las redes|veces compartido|condividi (|copia il link|invia per posta|sui social|sulle reti|udostępnij artykuł|kopiuj link|wyślij e-mailem|w sieciach|поширити статтю|копіювати посилання|у мережах|поделиться статьёй|поделиться статьей|поделиться (|копировать ссылку|в сетях",
    "ad": "continues below advertisement|weiter nach der anzeige|text geht unter der anzeige|article se poursuit après la publicité|suite après la publicité|la noticia sigue tras la publicidad|sigue tras el anuncio|continua dopo la pubblicità|część artykułu pod reklamą|продовжується після реклами|продолжение после рекламы|продолжается после рекламы",
    "heading": "you may also like|most read|in this section|related stories|more from|das könnte sie interessieren|meistgelesen|aus dem ressort|vous aimerez aussi|les plus lus|dans la même rubrique|le puede interesar|lo más leído|en esta sección|potrebbe interessarle|i più letti|in questa sezione|może cię zainteresować|najczęściej czytane|w tym dziale|вас може зацікавити|найчитаніше|у цьому розділі|в цьому розділі|вам может быть интересно|самое читаемое|в этом разделе",
    "credit": "contributed to this report|from the newsroom|reporting by|, correspondent|korrespondent von|correspondant de|corresponsal de|corrispondente di|korespondent |кореспондент |корреспондент |bericht der redaktion|la rédaction de|redacción de|la redazione di|redazione di|opracowanie: redakcja|opracowanie:|підготувала редакція|подготовила редакция|mitarbeit:|con información de|ha collaborato|współpraca:|za udziału|за участі:|при участии:|photo:|photograph:|foto:|zdjęcie:|fot.:|фото:",
}
# Openings of furniture lines, lower case, each an alternative of one pattern.
OPENINGS = {
    "teaser": r"(?:read more|related|see also|more on this|more|mehr dazu|lesen sie auch|siehe auch|à lire|lire aussi|voir aussi|lea también|más información|vea también|leggi anche|approfondisci|vedi anche|czytaj także|zobacz też|czytaj też|читайте також|дивіться ще|див\. також|читайте также|смотрите ещё|см\. также)\s?:",
    "listed": r"(?:»|›|>>|→|▶|►)\s?\S|\d{1,2}[.)]\s",
    "published": r"(?:published|updated|last updated|veröffentlicht|aktualisiert|stand|publié|publié le|mis à jour|publicado|actualizado|pubblicato|aggiornato|opublikowano|aktualizacja|опубліковано|оновлено|опубликовано|обновлено)\s?(?:on|am|le|el|il)?\s?:?\s?\d",
    "byline": r"(?:by|von|par|por|di|autor|author|auteur|autore|autorka|автор|текст|avec|with|mit)\s?:?\s(?=\p{L})",
    "follow": r"(?:follow|folgen sie|suivez|siga a|síganos en|siga|segui|segua|obserwuj|читайте|стежте за|следите за)\s.*",
    "counter": r"[\d.,  ]+\s?(?:shares?|partages?|condivisioni|udostępnień|udostępnienia|mal geteilt|veces compartido|поширень|репостов|comments?|kommentare|commentaires?|comentarios?|commenti|komentarzy)\W*$|(?:репостов|поширень|shares?|comments?|udostępnień)\s?:\s?\d+\W*$",
    "tags": r"(?:#[\p{L}\d_]+[\s,]*)+$|(?:tags?|schlagwörter|themen|mots-clés|sujets|etiquetas|temas|temi|argomenti|tagi|tematy|теми|теги|темы)\s?:",
    "adlabel": r"(?:advertisement|advertising|sponsored|ad|anzeige|werbung|publicité|publicidad|anuncio|pubblicità|annuncio|reklama|реклама)\W*$",
}
KINDS = (*PHRASES, *OPENINGS)
_SPACES = re.compile(r"\s+")
_ENDS = tuple(".!?…。！？")
_CLOSERS = "”»\"')’“"
_PIECES = re.compile(r"\s{2,}|[|·•/,]")
_BLANKS = re.compile(r"\n{3,}")
_CRUMB = re.compile(r"^\S(?:.{0,28}\S)? [/>›»|→] \S")
FEATURES = (
    [f"words{k}" for k in range(7)] + [
        "ends",
        "capitals",
        "bullet",
        "frequent",
        "menu",
        "names",
        "crumb",
        "title",
        "source",
        "separators",
        "colon",
        "pos_before",
        "pos_after",
        "pos_between"
    ] + [f"is_{k}" for k in KINDS] + ["bylined", "any", "listed_short", "titled_crumb", "between_paragraphs", "followed", "bias"]
)
_AT = {name: k for k, name in enumerate(FEATURES)}
_MARKS = [_AT[f] for f in ("any", "frequent", "menu", "names", "listed_short", "bylined", "followed", "crumb")]


@lru_cache(maxsize=1)
def _machine():
    import ahocorasick

    machine = ahocorasick.Automaton()
    for kind, block in PHRASES.items():
        for phrase in block.split("|"):
            machine.add_word(fold(phrase), kind)
    machine.make_automaton()
    return machine


@lru_cache(maxsize=1)
def _openings():
    import regex

    return [(kind, regex.compile(fold(pattern))) for kind, pattern in OPENINGS.items()]


def _kinds(low: str, words: int, source: str) -> set[str]:
    """The kinds of furniture whose phrases or openings a line has; those that prose uses too need a short line."""
    found = set()
    if words <= MAX_PHRASE_LINE:
        for _, kind in _machine().iter(low):
            if kind in ("legal", "cookie") or words < PARAGRAPH_WORDS or (kind == "subscribe" and words < 26 and source and source in low):
                found.add(kind)
    if words < 20:
        for kind, pattern in _openings():
            if pattern.match(low):
                if kind == "byline" and not (words <= 9 and ((source and source in low) or words <= 5)):
                    continue
                if kind == "follow" and not (source and source in low and words < PARAGRAPH_WORDS):
                    continue
                if kind == "counter" and words > 4:
                    continue
                found.add(kind)
    return found


def line_key(source: str | None, line: str) -> int:
    """Hash of a source and a normalised line."""
    return xxhash.xxh64_intdigest(line, xxhash.xxh64_intdigest(source or "")) - (1 << 63)


def short_lines(body: str, source: str | None) -> dict[int, str]:
    """The distinct normalised lines of a page that are shorter than a paragraph, by their keys."""
    lines = {normal_line(x) for x in body.split("\n") if x.strip()}
    return {line_key(source, x): x for x in lines if x and len(x.split()) < PARAGRAPH_WORDS}


#: How a page was read: whole pages hold more furniture than what a feed or an interface gives.
WHOLE_PAGES = ("HTTP_HTML", "BROWSER")
_MARKUP = re.compile(r"<(?:html|body|div|p|article|section|main|nav|ul|table)\b[^<>]*>", re.IGNORECASE)
# Elements and words of class names that tell furniture from content, elements without text of their own.
FURNITURE_TAGS = frozenset("nav footer aside header form menu button".split())
CONTENT_TAGS = frozenset("article main blockquote".split())
FURNITURE_CLASSES = re.compile(r"nav|menu|cookie|consent|share|social|related|sidebar|footer|comment|advert|promo|breadcrumb|newsletter|teaser|login", re.IGNORECASE)
CONTENT_CLASSES = re.compile(r"article|content|story|main|body-?text|post-?body", re.IGNORECASE)
SKIPPED_TAGS = frozenset("script style noscript template svg canvas head".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE_TAGS = frozenset("a abbr b bdi cite code em font i label mark q s small span strong sub sup time u".split())


def fetch_kind(method: str | None) -> str:
    return "whole" if method in WHOLE_PAGES else "feed" if method else ""


class _Dom(HTMLParser):
    """Elements with their parents and tag classes, and the runs of text in them with the line each begins in."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.parents, self.classes, self.texts, self.owners, self.lines = [-1], [0], [], [], []
        self._open: list[tuple[str, int]] = [("", 0)]
        self._skip = 0
        self._run: list[str] = []
        self._at = (0, 0)
        self.feed(html)
        self.close()
        self._flush()

    def _flush(self) -> None:
        text = " ".join("".join(self._run).split())
        if text:
            self.texts.append(text)
            self.owners.append(self._at[0])
            self.lines.append(self._at[1])
        self._run = []

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED_TAGS:
            self._skip += 1
        if tag in VOID_TAGS or tag in INLINE_TAGS or self._skip:
            if tag == "br":
                self._flush()
            return
        self._flush()
        names = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
        kind = 1 if tag in FURNITURE_TAGS or FURNITURE_CLASSES.search(names) else 2 if tag in CONTENT_TAGS or CONTENT_CLASSES.search(names) else 0
        self.parents.append(self._open[-1][1])
        self.classes.append(kind)
        self._open.append((tag, len(self.parents) - 1))

    def handle_endtag(self, tag):
        if tag in SKIPPED_TAGS and self._skip:
            self._skip -= 1
        if any(t == tag for t, _ in self._open[1:]):
            self._flush()
            while self._open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not self._skip:
            if not self._run and data.strip():
                lead = len(data) - len(data.lstrip())
                self._at = (self._open[-1][1], self.getpos()[0] + data[:lead].count("\n"))
            if self._run or data.strip():
                self._run.append(data)


class Page:
    """Lines of a page with their features; `region` is the inner node each hangs on, `parents` that of each inner node (-1: the page itself)."""

    __slots__ = ("numbers", "features", "region", "regions", "parents", "classes", "seed", "kind")

    def __init__(
        self,
        texts: list[str],
        numbers: list[int],
        owners: list[int] | None,
        parents: list[int] | None,
        classes: list[int] | None,
        title: str,
        facts: LineFacts,
        kind: str,
        seed: list[int] | None = None
    ):
        n = len(texts)
        rows: list[int] = []
        cols: list[int] = []
        known = [facts.of(t) for t in texts]
        long = [x.long for x in known]
        first = next((k for k in range(n) if long[k]), n)
        last = next((k for k in range(n - 1, -1, -1) if long[k]), -1)
        title = _SPACES.sub(" ", title or "").strip().lower()
        bare_title = title.rstrip(" .,:;!?…")
        for k, x in enumerate(known):
            cols += x.columns
            extra = [_AT["pos_before" if k < first else "pos_after" if k > last else "pos_between"]]
            if title:
                if x.crumb and title[:24] in x.low and not x.low.startswith(title[:24]):
                    extra.append(_AT["titled_crumb"])
                if x.words < 40 and x.low.rstrip(" .,:;!?…") == bare_title:
                    extra.append(_AT["title"])
            if 0 < k < n - 1 and long[k - 1] and long[k + 1] and 3 <= x.words < PARAGRAPH_WORDS and not x.kinds and not x.crumb and x.capital:
                extra.append(_AT["between_paragraphs"])
            if k and "heading" in known[k - 1].kinds:
                extra.append(_AT["followed"])
            cols += extra
            rows += [k] * (len(x.columns) + len(extra))
        self.features = np.zeros((n, len(FEATURES)), np.float32)
        self.features[rows, cols] = 1
        if owners is None:
            marked = (self.features[:, _MARKS].sum(axis=1) > 0).tolist()
            region, regions = np.zeros(n, np.int64), 0
            for k in range(n):
                if k and (long[k] != long[k - 1] or (marked[k] != marked[k - 1] and not long[k])):
                    regions += 1
                region[k] = regions
            self.region, self.regions = region, regions + (n > 0)
            self.parents, self.classes = np.full(self.regions, -1), np.zeros(self.regions, np.int64)
        else:
            self.region, self.regions = np.array(owners, np.int64), len(parents)
            self.parents, self.classes = np.array(parents), np.array(classes, np.int64)
        self.numbers = np.array(numbers, np.int32)
        self.seed = np.array(seed, np.int8) if seed is not None else np.full(n, -1, np.int8)
        self.kind = kind


class Line:
    """What a line's text tells, whatever page it stands on."""

    __slots__ = ("columns", "words", "long", "kinds", "low", "crumb", "capital")


class LineFacts:
    """Facts of the lines of one source; those of short lines, which often come again, are remembered."""

    def __init__(self, source: str, source_key: str, frequent: frozenset, menu: frozenset):
        self.source = _SPACES.sub(" ", source or "").strip().lower()
        self.folded, self.source_key, self.frequent, self.menu = fold(self.source), source_key, frequent, menu
        self.memo: dict[str, Line] = {}

    def of(self, line: str) -> Line:
        x = self.memo.get(line)
        if x is None:
            x = self._read(line)
            if x.words < PARAGRAPH_WORDS:
                if len(self.memo) > REMEMBERED_LINES:
                    self.memo.clear()
                self.memo[line] = x
        return x

    def _read(self, line: str) -> Line:
        text = _SPACES.sub(" ", line).strip()
        x = Line()
        words, low = text.count(" ") + 1, text.lower()
        kinds = _kinds(fold(low), words, self.folded)
        bare = text.rstrip(_CLOSERS)
        ends = bare.endswith(_ENDS)
        bucket = 0 if words == 1 else 1 if words <= 3 else 2 if words <= 7 else 3 if words < PARAGRAPH_WORDS else 4 if words < 20 else 5 if words < 40 else 6
        names = []
        if ends:
            names.append("ends")
        if words > 1 and text.isupper():
            names.append("capitals")
        if text[0] in "•*–—-·":
            names.append("bullet")
        if words < PARAGRAPH_WORDS and line_key(self.source_key, normal_line(text)) in self.frequent:
            names.append("frequent")
        if words >= 2:
            known = sum(w in self.menu for w in low.replace(",", " ").split())
            pieces = [p for p in _PIECES.split(line.strip().lower()) if p.strip()] if words < 30 else []
            if known >= 0.7 * words or (len(pieces) > 2 and sum(p.strip() in self.menu for p in pieces) >= 0.6 * len(pieces)):
                names.append("menu")
        listed_names = "," in text and not ends and all(0 < len(p.split()) <= 3 and p.strip()[:1].isupper() for p in text.split(","))
        if listed_names:
            names.append("names")
        x.crumb = words < 22 and bool(_CRUMB.match(text))
        if x.crumb:
            names.append("crumb")
        if self.source and self.source in low:
            names.append("source")
        if text.count("|") + text.count("·") > 1:
            names.append("separators")
        if text.endswith(":"):
            names.append("colon")
        names += [f"is_{kind}" for kind in kinds]
        if "byline" in kinds:
            names.append("bylined")
        if kinds - {"byline", "listed"}:
            names.append("any")
        if "listed" in kinds and words < PARAGRAPH_WORDS and not ends:
            names.append("listed_short")
        names.append("bias")
        x.columns = [bucket, *(_AT[name] for name in names)]
        x.words, x.kinds, x.low, x.capital = words, kinds, low if words < 40 else "", text[0].isupper()
        x.long = (words >= PARAGRAPH_WORDS or (words >= 7 and ends)) and not kinds
        return x


def _sums(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Rows of values added up by their target."""
    return np.stack([np.bincount(at, values[:, 0], size), np.bincount(at, values[:, 1], size)], axis=1)


class Forest:
    """The inner nodes of many pages as one array, each page's root first, with the nodes of each depth."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([1 + p.regions for p in pages])
        begin = np.cumsum(sizes) - sizes
        self.roots = begin
        self.size = int(sizes.sum())
        self.parent = np.full(self.size, -1)
        self.classes = np.zeros(self.size, np.int64)
        for p, at in zip(pages, begin):
            self.parent[at + 1 : at + 1 + p.regions] = np.where(p.parents < 0, at, at + 1 + p.parents)
            self.classes[at + 1 : at + 1 + p.regions] = p.classes
        self.owner = np.concatenate([p.region + at + 1 for p, at in zip(pages, begin)])
        depth = np.zeros(self.size, np.int64)
        rest = np.flatnonzero(self.parent >= 0)
        while len(rest):
            now = depth[self.parent[rest]] + 1
            rest = rest[now != depth[rest]]
            depth[rest] = depth[self.parent[rest]] + 1
        self.levels = [np.flatnonzero(depth == d) for d in range(1, depth.max() + 1)] if self.size else []
        self.lines = np.array([len(p.numbers) for p in pages])


class TreeModel:
    """Line weights, element potentials and those of the root, of inner nodes and of lines under their parents; states are 0 furniture, 1 content."""

    def __init__(self, weights: np.ndarray, root: np.ndarray, page_region: np.ndarray, region_line: np.ndarray, frequent: frozenset | None, menu: frozenset):
        # keys of lines; None where they are too many to hold, and each page comes with its own
        self.weights, self.root, self.page_region, self.region_line, self.frequent, self.menu = weights, root, page_region, region_line, frequent, menu
        # P(tag class | state); class 0, no sign, tells nothing
        self.elements = np.array([[1.0, 1.0], [0.6, 0.4], [0.4, 0.6]])
        self.roots: dict[str, np.ndarray] = {}
        self._facts: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"_facts": {}}

    def facts(self, source: str, source_key: str, own: frozenset | None) -> LineFacts:
        if own is not None:
            return LineFacts(source, source_key, own, self.menu)
        key = (source, source_key)
        if key not in self._facts:
            if len(self._facts) > REMEMBERED_SOURCES:
                self._facts.clear()
            self._facts[key] = LineFacts(source, source_key, self.frequent or frozenset(), self.menu)
        return self._facts[key]

    def page(self, body: str, title: str | None, source: str | None, source_key: str | None, own: frozenset | None = None, method: str | None = None) -> Page:
        facts = self.facts(source or "", source_key or "", own)
        if "</" in body and _MARKUP.search(body):
            dom = _Dom(body)
            if dom.texts:
                return Page(dom.texts, dom.lines, dom.owners, dom.parents, dom.classes, title or "", facts, fetch_kind(method))
        lines = [(no, line) for no, line in enumerate(body.split("\n"), 1) if line.strip()]
        return Page([t for _, t in lines], [no for no, _ in lines], None, None, None, title or "", facts, fetch_kind(method))

    def marginals_of(self, pages: list[Page], clamp: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
        """P(content) of all lines of the pages by sum-product; also the expected counts of states by root and tag class, and of state pairs. clamp: known line states, -1 where open."""
        f = Forest(pages)
        p = 1 / (1 + np.exp(-np.clip(np.concatenate([x.features for x in pages]) @ self.weights, -30, 30)))
        phi = np.stack([1 - p, p], axis=1) + 1e-9
        if clamp is not None:
            phi[clamp == 0] = [1, 1e-9]
            phi[clamp == 1] = [1e-9, 1]
        # upward: lines to their regions, then level by level to the roots
        up_line = phi @ self.region_line.T
        log = np.log(self.elements[f.classes]) + _sums(f.owner, np.log(up_line), f.size)
        log[f.roots] += np.log(np.array([self.roots.get(x.kind, self.root) for x in pages]))
        up = np.ones((f.size, 2))
        belief = np.ones((f.size, 2))

        def settle(at: np.ndarray) -> None:
            belief[at] = np.exp(log[at] - log[at].max(axis=1, keepdims=True))

        for level in reversed(f.levels):
            settle(level)
            up[level] = belief[level] @ self.page_region.T
            log += _sums(f.parent[level], np.log(up[level]), f.size)
        settle(f.roots)
        # downward: what a parent knows without the child, through the potential between them
        full = belief.copy()
        both = np.zeros((2, 2))
        for level in f.levels:
            above = full[f.parent[level]] / up[level]
            pair = above[:, :, None] * self.page_region[None] * belief[level][:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            both += pair.sum(axis=0)
            full[level] = pair.sum(axis=1)
        full /= full.sum(axis=1, keepdims=True)
        outside = full[f.owner] / np.maximum(up_line, 1e-12)
        pair = outside[:, :, None] * self.region_line[None] * phi[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        tags = np.zeros((3, 2))
        for k in (1, 2):
            tags[k] = full[f.classes == k].sum(axis=0)
        return pair[:, :, 1].sum(axis=1), (full[f.roots], both, pair.sum(axis=0), tags)

    def marginals(self, page: Page, clamp: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
        return self.marginals_of([page], clamp)

    def furniture_of(self, pages: list[Page]) -> list[np.ndarray]:
        """Line numbers of each page that aren't part of the report; of a line that holds several texts, none may be."""
        full = [p for p in pages if len(p.numbers)]
        out = {id(p): p.numbers for p in pages}
        if full:
            content = self.marginals_of(full)[0] >= 0.5
            for p, own in zip(full, np.split(content, np.cumsum([len(p.numbers) for p in full])[:-1])):
                out[id(p)] = np.setdiff1d(p.numbers, p.numbers[own])
        return [out[id(p)] for p in pages]

    def furniture(self, page: Page) -> np.ndarray:
        return self.furniture_of([page])[0]

    def reports(self, bodies: list[str], pages: list[Page]) -> list[str]:
        """The texts of each report, each on a line of its own; of plain text the lines as they are."""
        plain = [not (p.parents.max(initial=-1) >= 0 or p.classes.any()) for p in pages]
        drops = iter(self.furniture_of([p for p, x in zip(pages, plain) if x]))
        out = []
        for body, page, x in zip(bodies, pages, plain):
            if x:
                drop = set(next(drops).tolist())
                out.append(_BLANKS.sub("\n\n", "\n".join(x for no, x in enumerate(body.split("\n"), 1) if no not in drop)).strip("\n"))
            else:
                content = self.marginals(page)[0] >= 0.5 if len(page.numbers) else []
                out.append("\n".join(t for t, c in zip(_Dom(body).texts, content) if c))
        return out

    def report(self, body: str, page: Page) -> str:
        return self.reports([body], [page])[0]


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, weights: np.ndarray | None = None, rounds: int = 25, ridge: float = 0.5) -> np.ndarray:
    """Newton steps for a logistic model with soft targets y and case weights w."""
    beta = np.zeros(x.shape[1]) if weights is None else weights.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (w * (y - p)) - ridge * beta
        h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        beta += step
        if np.abs(step).max() < 1e-4:
            break
    return beta


def _menu(lines: list[str]) -> frozenset:
    """Words and wholes of frequent lines of up to three words."""
    return frozenset(w for line in lines if len(line.split()) <= 3 for w in (line, *line.split()) if len(w) > 1)


def labelled() -> tuple[list[tuple[str, str, str, list[str], list[int]]], list[tuple[str, list[int]]], frozenset, frozenset]:
    """The pages of `labelled_pages`: (source, fetch method, title, lines, labels) and (html, labels), with their frequent lines and menu words."""
    pages, often = [], {}
    for line in PAGES.strip().split("\n"):
        mark, text = line[0], line[2:]
        if mark == "@":
            source, method, title = text.split(" | ")
            pages.append((source, method, title, [], []))
        else:
            pages[-1][3].append(text)
            pages[-1][4].append(int(mark == "+"))
            if mark == "=":
                own = normal_line(text)
                often[line_key(pages[-1][0], own)] = own
    html = []
    for page in HTML_PAGES:
        labels = [int(m == "+") for m in re.findall(r">\s*([+=-])", page)]
        html.append((re.sub(r">\s*[+=-]", ">", page), labels))
    short = {k: t for k, t in often.items() if len(t.split()) < PARAGRAPH_WORDS}
    return pages, html, frozenset(short), _menu(list(short.values()))


def fit(pages: list[tuple], rounds: int = 2, frequent: frozenset | None = None, menu: frozenset | None = None) -> TreeModel:
    """Trained from the labelled pages, then refitted with `pages`: (body, title, source name, source id[, fetch method]). Frequent lines and menu words are those of the pages unless given."""
    if frequent is None or menu is None:
        seen: Counter = Counter()
        texts: dict[int, str] = {}
        for body, _, _, key, *_ in pages:
            own = short_lines(body, key)
            texts |= own
            seen.update(own.keys())
        frequent = frozenset(k for k, n in seen.items() if n >= FREQUENT)
        menu = _menu([texts[k] for k in frequent])
    model = TreeModel(np.zeros(len(FEATURES)), np.array([0.5, 0.5]), np.array([[0.55, 0.45], [0.45, 0.55]]), np.array([[0.8, 0.2], [0.15, 0.85]]), frequent, menu)
    taught, html, often, words = labelled()
    built = []
    for source, method, title, lines, labels in taught:
        built.append(Page(lines, list(range(1, len(lines) + 1)), None, None, None, title, LineFacts(source, source, often, words), fetch_kind(method), labels))
    for body, labels in html:
        dom = _Dom(body)
        built.append(Page(dom.texts, dom.lines, dom.owners, dom.parents, dom.classes, "", LineFacts("", "", often, words), "whole", labels))
    own = len(built)
    built += [p for p in (model.page(b, t, s, k, None, *rest) for b, t, s, k, *rest in pages) if len(p.numbers)]
    seed = np.concatenate([p.seed for p in built])
    hand = seed >= 0
    x = np.concatenate([p.features for p in built]).astype(np.float64)
    model.weights = _logistic(x[hand], seed[hand].astype(float), np.ones(hand.sum()))
    weight = np.where(hand, LABEL_WEIGHT, 1.0)
    share = np.array([LABEL_WEIGHT] * own + [1.0] * (len(built) - own))
    for _ in range(rounds):
        content, (roots, both, pair, tags) = model.marginals_of(built, seed)
        each = {kind: 1 + (roots * share[:, None])[[p.kind == kind for p in built]].sum(axis=0) for kind in {p.kind for p in built}}
        # the root's for pages of unknown kind is that of all pages where there are none
        root = each.pop("", sum(each.values()))
        model.root, model.roots = root / root.sum(), {kind: r / r.sum() for kind, r in each.items()}
        model.page_region, model.region_line = ((c + 1) / (c + 1).sum(axis=1, keepdims=True) for c in (both, pair))
        signs = tags[1:] + 1
        model.elements = np.concatenate([[[1.0, 1.0]], signs / signs.sum(axis=0)])
        # what the sample leaves open counts half
        model.weights = _logistic(x, content, weight * np.where(hand, 1.0, 0.5), model.weights)
    return model


def _line_rows(articles: DataFrame) -> DataFrame:
    """(id, key, text): the short lines of each page; text only for lines of up to three words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                ids, keys, texts = [], [], []
                for i, source, body in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns)):
                    if i is None or not body:
                        continue
                    for key, line in short_lines(body, source).items():
                        ids.append(i)
                        keys.append(key)
                        texts.append(line if len(line.split()) <= 3 else None)
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.string()), "key": pa.array(keys, pa.int64()), "text": pa.array(texts, pa.string())})

    return articles.select(F.col("article_id").cast("string"), F.col("source_id").cast("string"), "body").mapInArrow(run, "id string, key bigint, text string")


def frequent_lines(articles: DataFrame) -> DataFrame:
    """(key, text): short lines that stand in at least FREQUENT pages of one source, counted over all pages; repeated rows count once."""
    rows = _line_rows(articles).select(F.xxhash64("id").alias("doc"), "key", "text").dropDuplicates(["doc", "key", "text"])
    return rows.groupBy("key", "text").agg(F.count("*").alias("pages")).where(F.col("pages") >= FREQUENT).select("key", "text")


def _method(articles: DataFrame) -> list:
    return [F.col("fetch_method")] if "fetch_method" in articles.columns else [F.lit(None).cast("string").alias("fetch_method")]


def fit_model(articles: DataFrame, sample: int = SAMPLE_PAGES) -> TreeModel:
    """Weights are fitted on the labelled pages and a bounded sample of the corpus (the `sample` smallest by a hash of the id), residue left out; frequent lines and menu words are counted over all pages."""
    keys = articles.where(F.col("article_id").isNotNull()).select(F.col("article_id").alias("__id")).dropDuplicates(["__id"]).orderBy(F.xxhash64("__id"), "__id").limit(sample)
    # at most `sample` ids, so the broadcast is bounded
    rows = articles.join(F.broadcast(keys), F.col("article_id") == F.col("__id")).select(
        "__id",
        "body",
        "title",
        "source_name",
        "source_id",
        *_method(articles)
    ).dropDuplicates(["__id"]).collect()
    rows = sorted((r for r in rows if r["body"] and not is_residue(r["body"])), key=lambda r: r["__id"])
    lines = cut_lineage(frequent_lines(articles))
    # the words of menus, of the size of a vocabulary
    menu = _menu([r["text"] for r in lines.where("text is not null").select("text").distinct().collect()])
    few = lines.count() <= BROADCAST_LINES
    if few:
        known = lines
    else:
        own = sorted({k for r in rows for k in short_lines(r["body"], r["source_id"])})
        known = lines.join(F.broadcast(articles.sparkSession.createDataFrame(pa.table({"key": pa.array(own, pa.int64())}))), "key", "left_semi")
    frequent = frozenset(known.select("key").toArrow()["key"].to_pylist())
    model = fit([(r["body"], r["title"], r["source_name"], r["source_id"], r["fetch_method"]) for r in rows], frequent=frequent, menu=menu)
    model.frequent = frequent if few else None
    return model


def _pages(articles: DataFrame, model: TreeModel) -> DataFrame:
    """The columns a page needs, with the keys of its own frequent lines where the model doesn't hold them all."""
    rows = articles.select(F.col("article_id").cast("string").alias("article_id"), "body", "title", "source_name", "source_id", *_method(articles))
    if model.frequent is not None:
        return rows.withColumn("own", F.lit(None).cast("array<bigint>"))
    own = _line_rows(articles).select("id", "key").join(frequent_lines(articles).select("key"), "key", "left_semi").groupBy("id").agg(F.collect_set("key").alias("own"))
    return rows.join(own, rows["article_id"] == own["id"], "left").drop("id").withColumn("own", F.coalesce("own", F.array().cast("array<bigint>")))


def _read_pages(articles: DataFrame, model: TreeModel, schema: str, emit) -> DataFrame:
    """emit: from a slice's ids, bodies and pages (None where the body is null, empty or residue) to a batch."""
    shared = articles.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, bodies, titles, names, keys, methods, owns = (c.to_pylist() for c in batch.slice(at, 256).columns)
                pages = [
                    own_model.page(b, t, s, k, None if o is None else frozenset(o), m) if i is not None and b and not is_residue(b) else None
                    for i, b, t, s, k, m, o in zip(ids, bodies, titles, names, keys, methods, owns)
                ]
                yield emit(own_model, ids, bodies, pages)

    return _pages(articles, model).mapInArrow(run, schema)


def furniture_lines(articles: DataFrame, model: TreeModel) -> DataFrame:
    """(article_id, line_no) of each non-blank line that isn't part of the report.

    Residue (problem 5), null ids and null or blank bodies give no row; repeated rows count once; a null title, source or fetch method tells nothing.
    In markup a line is furniture when every text that begins in it is.
    """

    def emit(model, ids, bodies, pages):
        kept = [(i, p) for i, p in zip(ids, pages) if p is not None]
        found = model.furniture_of([p for _, p in kept])
        names = [i for (i, _), own in zip(kept, found) for _ in range(len(own))]
        return pa.RecordBatch.from_pydict({"article_id": pa.array(names, pa.string()), "line_no": pa.array(np.concatenate(found) if found else [], pa.int32())})

    return _read_pages(articles, model, "article_id string, line_no int", emit).dropDuplicates(["article_id", "line_no"])


def main_bodies(articles: DataFrame, model: TreeModel) -> DataFrame:
    """article_id and `report`, the body's own lines (of markup its own texts); one row per article. Null bodies stay null; residue has an empty report."""

    def emit(model, ids, bodies, pages):
        kept = [(b, p) for b, p in zip(bodies, pages) if p is not None]
        reports = iter(model.reports([b for b, _ in kept], [p for _, p in kept]))
        rows = [(i, next(reports) if p is not None else None if b is None else "") for i, b, p in zip(ids, bodies, pages) if i is not None]
        return pa.RecordBatch.from_pydict({"article_id": pa.array([i for i, _ in rows], pa.string()), "report": pa.array([r for _, r in rows], pa.string())})

    return _read_pages(articles, model, "article_id string, report string", emit).dropDuplicates(["article_id"])
