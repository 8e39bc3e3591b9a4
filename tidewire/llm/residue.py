"""Template residue, stubs, filler and error-page text (problem 5).

A multi-pattern automaton (Aho-Corasick) runs once over each lower-cased body. Phrases of
three kinds are counted by the characters they cover: `error` (failing pages, scripts,
cookies, permission, human checks, ad blockers, program output), `filler` (dummy text) and
`furniture` (what stands around any page). A body is a case when error and filler text
covers as much of it as real prose, furniture left aside, or when nothing but furniture and short
scraps is left. Placeholders and editors' notes count wherever they stand, unless quoted.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases in lower case, by kind. Digits are written as in texts, "#" stands for none of them.
ERROR_PHRASES = """
404 not found|page not found|could not be located on this server|503 service unavailable|service unavailable|502 bad gateway|bad gateway|gateway timeout|internal server error|scheduled maintenance|down for maintenance|under maintenance|temporarily unavailable
access denied|you don't have permission|permission to access|403 forbidden|something went wrong|please try again in|try again later|we can't seem to find|may have been moved or deleted|page you requested|page you are looking for
checking that you are not a robot|checking your browser|verify you are human|verifying you are human|confirm you are human|not a robot|unusual traffic|complete the captcha|this may take a few seconds|just a moment
enable javascript|javascript is disabled|javascript is required|requires javascript|turn on javascript|enable cookies|cookies in your browser|turn off your ad blocker|disable your ad blocker|ad blocker to view|ad blocker detected|whitelist our site
error establishing a database connection|upstream request timeout|upstream connect error|connection timed out|traceback (most recent call last)|keyerror:|typeerror:|valueerror:|nullpointerexception|render.py|fatal error:|warning: undefined variable|warning: undefined|.php on line|in /srv/|in /var/www|undefined index|stack trace|nosuchkey|specified key does not exist|<error>|nginx/|"error":|at news.render|exception in thread|segmentation fault|sqlstate[
seite nicht gefunden|nicht gefunden (fehler|gewünschte inhalt wurde verschoben|interner serverfehler|versuchen sie es in|wartungsarbeiten|derzeit nicht erreichbar|zugriff verweigert|aktivieren sie javascript|javascript aktivieren|bitte aktivieren sie|ob sie ein mensch sind|kein roboter sind|schalten sie ihren werbeblocker|werbeblocker ab|werbeblocker aus
page demandée est introuvable|page introuvable|erreur interne est survenue|merci de réessayer|indisponible pour maintenance|momentanément indisponible|accès refusé|activer javascript|activez javascript|n'êtes pas un robot|que vous êtes humain|désactiver votre bloqueur|désactivez votre bloqueur|bloqueur de publicité
no hemos encontrado la página|página no encontrada|la página que busca|se ha producido un error interno|vuelva a intentarlo|no disponible por mantenimiento|acceso denegado|active javascript|activar javascript|habilite javascript|que no es un robot|que es humano|desactive su bloqueador|bloqueador de anuncios
pagina richiesta non esiste|pagina non trovata|si è verificato un errore interno|riprovi tra|non disponibile per manutenzione|accesso negato|abilitare javascript|attivare javascript|attivi javascript|che lei non sia un robot|di essere umano|disattivi il blocco|blocco degli annunci|blocco della pubblicità
nie znaleziono strony|strony, której szukasz|artykuł został usunięty lub przeniesiony|wróć na stronę główną|wystąpił błąd serwera|spróbuj ponownie za|przerwa techniczna|chwilowo niedostępny|brak dostępu|odmowa dostępu|włącz obsługę javascript|włącz javascript|czy nie jesteś robotem|że jesteś człowiekiem|wyłącz adblocka|wyłącz blokowanie reklam|wyłącz wtyczkę blokującą
сторінку не знайдено|сталася внутрішня помилка|спробуйте ще раз через|технічні роботи|тимчасово недоступний|доступ заборонено|увімкніть javascript|що ви не робот|що ви людина|вимкніть блокувальник|блокувальник реклами
страница не найдена|внутренняя ошибка сервера|повторите попытку через|технические работы|временно недоступен|доступ запрещён|доступ запрещен|включите javascript|что вы не робот|что вы человек|отключите блокировщик|блокировщик рекламы
"""
FILLER_PHRASES = """
lorem ipsum|dolor sit amet|consectetur adipiscing elit|consectetur|sed do eiusmod|tempor incididunt|ut labore et dolore|ut labore|et dolore|magna aliqua|ut enim ad minim|minim veniam|quis nostrud|exercitation ullamco|ullamco laboris|nisi ut aliquip|ea commodo|duis aute irure|duis aute|in reprehenderit|velit esse cillum|velit esse|fugiat nulla pariatur|nulla pariatur|excepteur sint|occaecat cupidatat|non proident|sunt in culpa|qui officia|deserunt|mollit anim|id est laborum
placeholder text|dummy text|filler text|body copy goes here|text goes here|content goes here|replace this paragraph|replace this text|with the story|test test test|the quick brown fox
blindtext|platzhaltertext|hier steht später|bitte text einfügen|hier kommt der text|hier folgt der text
texte de remplissage|faux texte|texte de l'article viendra ici|le texte viendra ici|essai essai essai
texto de relleno|texto de prueba|aquí irá el cuerpo|aquí irá el texto|aquí va el texto|prueba prueba prueba
testo segnaposto|testo di prova|testo riempitivo|qui andrà il testo|prova prova prova
tekst zastępczy|to jest tekst zastępczy|tutaj pojawi się treść|tu będzie treść|tu będzie tekst|tekst próbny
текст-заповнювач|тут буде текст|тестовий текст|тест тест тест
текст-заполнитель|здесь будет текст|текст-рыба|рыбный текст|тестовый текст|проба проба проба
"""
FURNITURE_PHRASES = """
cookie|cookies|all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados|tutti i diritti riservati|wszelkie prawa zastrzeżone|усі права захищено|все права защищены|©|written consent|zustimmung von|accord écrit|permiso escrito|consenso scritto|bez pisemnej zgody|письмової згоди|письменного согласия|press complaints|presserats|conseil de la presse|consejo de prensa|consiglio della stampa|rady prasowej|ради преси|совет прессы|newsletter|free articles|darmowych tekstów|articles gratuits|freie artikel|artículos gratis|articoli gratuiti|безкоштовних|бесплатных|morning letter|morgenbrief|lettre du matin|carta de la mañana|lettera del mattino|poranny list|ранковий лист|утреннее письмо
"""
# Stems of editors' notes that something is still missing, looked for inside brackets.
NOTE_STEMS = r"to come|to follow|tk\b|tbd|tbc|to be (?:added|filled|supplied|confirmed)|insert|goes here|\bhere$|add (?:quote|photo|caption|name)|folgt\b|einfügen|einsetzen|ergänzen|nachtragen|à venir|à compléter|à insérer|insérer|a completar|por completar|pendiente|insertar|a insertar|da inserire|da completare|inserire|wstawić|wstaw\b|uzupełni|do dodania|вставити|додати|доповнити|вставить|добавить|дополнить|autor\?|author\?|auteur\?|name\?"
# Notes that are whole sentences, in any place.
NOTE_SENTENCES = r"tekst do uzupełnienia|do uzupełnienia przez redakcję|text (?:is )?to be (?:added|supplied) by|текст (?:буде )?доповнить редакція|дополнить редакции|text wird nachgereicht|texte à compléter par|testo da completare|texto pendiente de"
PLACEHOLDER = re.compile(
    r"\{\{\{?[^{}\n]+\}\}\}?|\{%[^%{}\n]+%\}|\$\{[\w.\- ]+\}|#\{[\w.\- ]+\}|<%[=\-]?[^%<>\n]+%>|\[\[[^\[\]\n]+\]\]|%%\w+%%|@@\w+@@|__[A-Za-z]\w*__|<<\w+>>"
    r"|\bTK(?: TK)+\b|\bTKTK\b|(?<!\w)(?:XXXX+|xxxx+)(?!\w)|(?<!\w)(?:TBD|TODO|FIXME)(?!\w)"
    r"|\[(?:INSERT|ADD|INS) [\w ]+\]|\[[\w ]+ HERE\]"
    rf"|(?i:{NOTE_SENTENCES})"
)
_BRACKETS = re.compile(r"[\[(<]([^\[\]()<>\n]+)[\])>]")
_NOTE = re.compile(rf"(?i){NOTE_STEMS}")
#: A bracket is an editor's note if stems of notes are at least this share of its words: a longer aside only happens to use one.
NOTE_SHARE = 1 / 16
# Any placeholder holds one of these; notes are announced by the automaton.
_HINTS = ("{{", "{%", "${", "#{", "<%", "[", "%%", "@@", "__", "<<", "TK", "XXX", "xxx", "TBD", "TODO", "FIXME")
_QUOTED = re.compile(r"“[^“”\n]+”|„[^„“”\n]+[“”]|«[^«»\n]+»|»[^«»\n]+«|\"[^\"\n]+\"|‘[^‘’\n]+’|‹[^‹›\n]+›")
_COMBINING = re.compile("[\u0300-\u036f]")
_SPACES = re.compile(r"[^\S\n]+")
MIN_PROSE_WORDS = 8
#: A line is a notice if furniture phrases cover this share of it; a report on cookie banners names them in each paragraph, but covers little with it.
NOTICE_SHARE = 0.08
#: Up to so many words of prose of unknown kind may stand beside error or filler text.
SPARE_WORDS = 30


def _plain(stem: str) -> str:
    return re.sub(r"\\b|\$", "", re.sub(r"\(\?:[^)]*\)", "", stem)).replace("\\?", "?").strip().lower()


# Bracketed notes by stems too short to be looked for in plain text.
_SHORT_NOTE = re.compile(
    r"(?i)[(<][^\[\]()<>\n]*?(?:" + "|".join(
        x for x in re.findall(r"(?:\(\?:[^)]*\)|[^|])+", NOTE_STEMS) if len(_plain(x)) <= 4
    ).replace(r"\bhere$", "here") + ")"
)


def note_hints() -> list[str]:
    """Plain strings one of which stands in every note that brackets or NOTE_SENTENCES can match, short stems (_SHORT_NOTE) aside."""
    plain = [re.sub(r"\\b|\$", "", x).replace("\\?", "?") for x in re.sub(r"\(\?:[^)]*\)", "", NOTE_STEMS).split("|")]
    sentences = "do uzupełnienia|to be |text is|текст доповнить|текст буде доповнить|доповнить редакція|дополнить редакции|wird nachgereicht|à compléter par|da completare|pendiente de"
    return [x.strip().lower() for x in [*plain, *sentences.split("|")] if len(x.strip()) > 4]


def fold(text: str) -> str:
    """Without diacritics, as some publishers drop them; ASCII texts unchanged."""
    if text.isascii():
        return text
    return _COMBINING.sub("", unicodedata.normalize("NFD", text)).replace("ł", "l")


@lru_cache(maxsize=1)
def automaton():
    """The automaton over all phrases; built once in each worker."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for kind, block in ((1, ERROR_PHRASES), (2, FILLER_PHRASES), (3, FURNITURE_PHRASES), (4, "|".join(note_hints()))):
        for phrase in filter(None, (p.strip() for line in block.split("\n") for p in line.split("|"))):
            phrase = fold(phrase)
            if phrase not in machine:
                machine.add_word(phrase, (kind, len(phrase)))
    machine.make_automaton()
    return machine


def has_placeholder(body: str) -> bool:
    """An unfilled placeholder or editor's note that isn't inside a quotation on its line."""
    notes = (m for m in _BRACKETS.finditer(body) if len(_NOTE.findall(m.group(1))) >= NOTE_SHARE * len(m.group(1).split()) and _NOTE.search(m.group(1)))
    for found in (PLACEHOLDER.finditer(body), notes):
        for m in found:
            start = body.rfind("\n", 0, m.start()) + 1
            end = body.find("\n", m.end())
            at = m.start() - start
            if not any(q.start() < at and at + len(m.group()) <= q.end() for q in _QUOTED.finditer(body[start : end if end >= 0 else len(body)])):
                return True
    return False


def is_residue(body: str | None) -> bool:
    """Whether a body holds no report but residue. Null and blank bodies are no case."""
    if body is None or not body.strip():
        return False
    low = fold(body.lower())
    if "  " in low or "\xa0" in low or "\t" in low:
        low = _SPACES.sub(" ", low)
    hits = [(end - n + 1, end + 1, kind) for end, (kind, n) in automaton().iter(low)]
    kinds = {kind for _, _, kind in hits}
    if (4 in kinds or any(h in body for h in _HINTS) or (("(" in body or "<" in body) and _SHORT_NOTE.search(body))) and has_placeholder(body):
        return True
    marked = 1 in kinds or 2 in kinds
    if not marked and 3 not in kinds and any(len(line) > 100 for line in low.split("\n")):
        return False
    prose = covered = 0
    start, k, hits = 0, 0, sorted(hits)
    for line in low.split("\n"):
        end = start + len(line)
        bad = known = 0
        reach = seen = start
        while k < len(hits) and hits[k][0] < end:
            a, b, kind = hits[k]
            if kind == 3:
                if b > seen:
                    known += b - max(a, seen)
                    seen = b
            elif kind < 3 and b > reach:
                bad += b - max(a, reach)
                reach = b
            k += 1
        words = len(line.split())
        if bad and bad >= 0.25 * len(line.strip()):
            covered += words
        elif words >= MIN_PROSE_WORDS and (not known or (not marked and known < NOTICE_SHARE * len(line))):
            prose += words
        start = end + 1
    return prose == 0 or (covered > 0 and prose <= max(covered, SPARE_WORDS))


def keep_reports(bodies: list) -> list[bool]:
    return [not is_residue(b) for b in bodies]


def residue_articles(articles: DataFrame, id_col: str = "article_id", body_col: str = "body") -> DataFrame:
    """One column, the id of each article whose body is a case. Repeated rows count once; null ids are left out."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            yield pa.RecordBatch.from_pydict({id_col: pa.array([i for i, b in zip(ids, bodies) if i is not None and is_residue(b)], pa.string())})

    rows = articles.select(F.col(id_col).cast("string").alias(id_col), F.col(body_col).alias("__body"))
    return rows.mapInArrow(scan, f"{id_col} string").dropDuplicates([id_col])
