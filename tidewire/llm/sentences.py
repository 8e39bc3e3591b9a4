"""Sentence boundaries across languages and scripts (problem 10).

A pushdown automaton runs over the marks of each block (text between blank lines): opening and
closing quotation marks and brackets and the levels of lists move its stacks, and a terminator ends a sentence only at the
ground level, after the list or dateline entry it may open with, and if neither the abbreviation before it, which a trie walked
backwards from the terminator finds, nor the text behind it speaks against that. When a quotation or bracket closes to the ground
level with a terminator inside, what follows decides: an attribution goes on, anything else begins
anew. Offsets count Unicode characters; the work is linear in the text, however deep it nests.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations (last dotted part, case as written or lower) that never end a sentence.
NEVER = frozenset(
    """Mr Mrs Ms Dr Prof Lt Col Gen Sgt Capt Cpl Rev Hon Sen Rep Gov St Mt Messrs approx vs fig Sec No Nos pp cf i.e e.g U.S U.K Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec
    Nr Abs Art art Mio Mrd Bd Hr Fr Frl Dipl Ing ing Str bzw bspw ca evtl ggf inkl sog z d.h z.B vgl Jg Kap
    M MM Mme Mlle env c.-à-d al chap éd av apr
    Sr Sra Srta D Dña Dn Ud Uds aprox pág págs núm Lic EE
    sig sigg dott prof avv geom rag pag pagg
    inż mgr dr hab gen płk mjr kpt por św ul al pl os tzn tj np ok godz ust pkt poz nr im tys mec woj pow gm
    проф акад інж инж доц ген полк вул просп пл обл ім им ул пр-т тыс тис млн млрд гр гл см рис ст п напр др
    श्री डॉ प्रो सुश्री कु पं د أ م.م ดร นพ พล จ""".split()
)
# Abbreviations that end a sentence only before a capital (or a letter without case): what else has a dot is a plain word.
# A number behind these belongs to them.
BEFORE_NUMBER = frozenset(
    "h p s c o r ca No Nr Art art Abs al n pag pág pkt ust godz ok env approx Sec st ст п Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec vol fig tel".split()
)
# One letter: initials when capital; these small ones stand before a name or a part of the same abbreviation, unless a number precedes.
SMALL_NEVER = frozenset("z d c м г с т и د".split())
MONTHS = frozenset(
    """Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember stycznia lutego marca kwietnia maja czerwca lipca sierpnia września października listopada grudnia""".split()
)
COMPANY = regex.compile(r"(?:KG|KGaA|OHG|AG|SE|mbH)\b")
# Verbs of saying that close an attribution in scripts without letter case.
SAYING = regex.compile(r"(?:说|说道|问|问道|道|回答|答道|表示|称|指出|喊道|補充|补充|कहा|पूछा|बोला|बोली|बोले|बताया|दिया|قال|سأل|أجاب|أضاف|قالت)\s*$")
#: Attributions that letter case doesn't tell from a new sentence: among capitals, and a name before its verb.
ATTRIBUTION = regex.compile(
    r"(?:ASKED|SAID|REPLIED|ANSWERED|ADDED|A DEMANDÉ|A DIT|A RÉPONDU)\b|\p{Lu}[\p{L}'’-]*(?: \p{Lu}[\p{L}'’-]*){0,2} (?:asked|said|replied|answered|added)\b"
)
_GOES_ON = frozenset("とっはがをもにでのとか")
_TERMINATORS = ".!?…。！？｡।॥؟۔"
_HARD = "。！？｡"
#: Among capitals the case of the next word says nothing: these then go on, the ones of time, firms and amounts before a small word.
CAPS_NEVER = frozenset("tj tzn tys o.o ok im ust art godz ul inż gen lt p.m.a u.s i.e e.g a.m s.p.a ca mio млрд тис тыс proc bm c.-à-d uu mln approx aprox cía cie env".split())
# Small words and currencies that go on after an amount, a time or a firm.
_LINK = regex.compile(
    r"(?:AND|OR|ON|OF|IN|AT|BY|TO|FOR|FROM|MET|UND|IM|AM|FÜR|VON|ET|EN|DE|DU|LE|LA|E|Y|O|DI|IL|DESDE|HASTA|W|I|Z|NA|OD|DO|В|И|У|Й|НА|З|С|KG|USD|EUR|PLN|ZŁ|ГРН|РУБ)\b"
)
_BLOCK = regex.compile(r"\n[^\S\n]*\n\s*")
_MARKS = regex.compile(r"[“”„«»‹›\"「」『』()（）\[\]【】]")
_ENDS = regex.compile(rf"[{_TERMINATORS}]+")
_BEFORE_WORD = frozenset(" \t\n\r\u00a0\u202f\u2009\u3000“”„«»\"(（[—–'’")
_ENTRY = regex.compile(r"\s*[(\[]?\d{1,3}$")
_LETTERED = regex.compile(r"\s*[(\[]?[a-zа-я]$")
_DASHED = regex.compile(r"(?<!\S)—(?=\S)")
_BACK = regex.compile(r"\s—(?=\p{Ll})|\s—(?=[¿¡\p{Lu}])")
_THAI = regex.compile(r"[฀-๿]")
_GAP = regex.compile(r"\s+")
_PAIR = {"“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›", '"': '"', "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】"}
_OPENERS = {c: "".join(o for o, own in _PAIR.items() if c in own) for c in set("".join(_PAIR.values()))}


class AbbreviationTrie:
    """Abbreviations by their letters from the last to the first, lower case; a leaf has the kinds of each written form."""

    def __init__(self, kinds: dict[str, frozenset]):
        self.root: dict = {}
        for kind, words in kinds.items():
            for word in words:
                node = self.root
                for c in reversed(word.lower()):
                    node = node.setdefault(c, {})
                node.setdefault(None, {}).setdefault(kind, set()).add(word)

    def before(self, text: str, end: int, start: int) -> tuple[str, dict]:
        """The word that ends at `end`, and the kinds of the abbreviation it is; the walk stops where the word or the trie does."""
        node, at = self.root, end
        while at > start and node is not None and text[at - 1] not in _BEFORE_WORD and not text[at - 1].isspace():
            at -= 1
            c = text[at]
            node = node.get(c) or node.get(c.lower())
        if node is None:
            # no abbreviation: the word is as long as it is
            while at > start and text[at - 1] not in _BEFORE_WORD and not text[at - 1].isspace():
                at -= 1
        return text[at:end], (node or {}).get(None, {})


TRIE = AbbreviationTrie({"never": NEVER, "number": BEFORE_NUMBER, "capitals": CAPS_NEVER})


def _ordinal(letter: str) -> int:
    return ord(letter) - ord("а" if "а" <= letter <= "я" else "a") + 1


class Levels:
    """The open levels of a list, outermost first: kind of enumerator and its last ordinal."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = []

    def follows(self, text: str, at: int) -> bool:
        """Whether a small letter with a dot stands here that comes next on an open level, or opens one within an entry."""
        c = text[at]
        return bool(self.stack) and (c in "aа" or ("letter", _ordinal(c) - 1) in self.stack) and c.islower() and text[at + 1 : at + 2] == "." and text[at + 2 : at + 3].isspace()

    def entry(self, mark: str) -> bool:
        """Whether a mark at a sentence's begin enumerates an entry: any number does, a small letter if it opens a level or comes next on an open one."""
        kind, ordinal = ("number", int(mark)) if mark.isdecimal() else ("letter", _ordinal(mark))
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth] == (kind, ordinal - 1):
                del self.stack[depth:]
                self.stack.append((kind, ordinal))
                return True
        if kind == "number" or ordinal == 1:
            if not self.stack or self.stack[-1][0] != kind:
                self.stack.append((kind, ordinal))
            else:
                self.stack[-1] = (kind, ordinal)
            return True
        return False


def _nested(text: str) -> list[tuple[int, int]]:
    """The outermost matched quotations and brackets of a block as (first mark, behind last mark)."""
    stack: list[tuple[str, int]] = []
    pairs: list[tuple[int, int]] = []
    # depths at which each opening mark stands on the stack, so that a closing one finds its own at once
    depths: dict[str, list[int]] = {c: [] for c in _PAIR}
    n = len(text)
    for m in _MARKS.finditer(text):
        c, at = m.group(), m.start()
        closes = max((depths[o][-1] for o in _OPENERS.get(c, "") if depths[o]), default=None)
        before, behind = text[at - 1] if at else " ", text[at + 1] if at + 1 < n else " "
        if c == '"' and closes is not None and before.isspace() and not behind.isspace():
            closes = None
        if closes is not None and not (c == "“" and stack[closes][0] != "„"):
            pairs.append((stack[closes][1], at + 1))
            for o, _ in stack[closes:]:
                depths[o].pop()
            del stack[closes:]
        elif c in _PAIR and not (c in '"»' and (behind.isspace() or not (before.isspace() or before in "([—–"))):
            depths[c].append(len(stack))
            stack.append((c, at))
    pairs.sort()
    outer: list[tuple[int, int]] = []
    for a, b in pairs:
        if not outer or a >= outer[-1][1]:
            outer.append((a, b))
    return outer


def _dash_quotes(text: str) -> list[tuple[int, int]]:
    """Speech opened by a dash without a blank, up to the dash that leads on to who said it."""
    out: list[tuple[int, int]] = []
    backs = [(m.start(), m.end()) for m in _BACK.finditer(text)]
    k = 0
    for m in _DASHED.finditer(text):
        while k < len(backs) and backs[k][0] < m.end():
            k += 1
        if k == len(backs):
            break
        start, end = backs[k]
        if text[end : end + 1].islower():
            out.append((m.start(), start))
    return out


def _next(text: str, at: int) -> int:
    m = _GAP.match(text, at)
    return m.end() if m else at


def _begins(text: str, at: int) -> bool:
    """Whether a sentence can begin at this character (behind white space)."""
    c = text[at]
    if c in "—–-•*":
        k = _next(text, at + 1)
        return k < len(text) and (k == at + 1 or c in "•*" or not text[k].islower())
    if c in ",;:)]»”’|/":
        return c == "»" and at + 1 < len(text) and text[at + 1].isalpha()
    if c in "“„«‹\"「『([（¿¡‘'":
        k = at + 1
        while k < len(text) and not text[k].isalnum() and text[k] not in "\n":
            k += 1
        return True if c != "(" and c != "[" else k >= len(text) or not text[k].islower()
    return not c.islower()


def _capitals(text: str, start: int, a: int, at: int) -> bool:
    """Whether the text around stands in capitals, so that letter case tells nothing."""
    around = text[max(start, a - 30) : a] + text[at : at + 12]
    return around.upper() == around and sum(map(str.isalpha, around)) > 6 and around.lower() != around


def _ends_sentence(text: str, start: int, a: int, b: int, levels: Levels) -> bool:
    """Whether the terminators text[a:b], at ground level in the sentence that began at start, end it."""
    run, n = text[a:b], len(text)
    if b >= n:
        return True
    if any(c in _HARD for c in run):
        return text[b] not in "，、,；;"
    if not text[b].isspace():
        return run[-1] in "!?।؟۔" and text[b] in "“„«\"「" and b + 1 < n
    at = _next(text, b)
    if at >= n:
        return True
    if run[0] != "." or len(run) > 1:
        return _begins(text, at) and not (run[0] in "….," and _capitals(text, start, a, at))
    if not _begins(text, at) and not levels.follows(text, at):
        return False
    caps = _capitals(text, start, a, at)
    word, kinds = TRIE.before(text, a, start)
    digit = text[at].isdigit()
    if word.isdigit():
        if _ENTRY.fullmatch(text, start, a):
            levels.entry(word)
            return False
        follows = regex.match(r"\p{L}+", text[at : at + 14])
        return not (len(word) <= 2 and follows and follows.group() in MONTHS)
    if len(word) == 1 and _LETTERED.fullmatch(text, start, a) and levels.entry(word):
        return False
    number = kinds.get("number", ())
    if digit and (word in number or word.lower() in number):
        ahead = regex.match(r"\d+", text[at : at + 6]).group()
        return word in ("h", "p", "r", "c", "o", "s") and len(ahead) > 2
    number_before = bool(regex.search(r"\d\s*$", text[max(start, a - len(word) - 3) : a - len(word)]))
    if len(word) == 1 and word.isalpha():
        if word == "م":
            return False
        if word in ("г", "р", "r", "h") or (caps and word in "ГРRH"):
            return number_before
        if caps and word == "Д":
            return bool(regex.search(r"\b[ТИ]\.?\s*$", text[max(start, a - 5) : a - 1]))
        if word.isupper():
            # initials; B. of "z. B." too
            return False
        if word == "д":
            return True
        return word not in SMALL_NEVER
    never = kinds.get("never", ())
    if word in never or (word[:1].isupper() and word.lower() in never):
        return False
    if caps and (
        word.title() in never or word.lower() in kinds.get("capitals", ()) or (
            word.lower() in ("a.m", "p.m", "co", "cía", "cie", "mln", "млрд", "proc", "bm", "aprox") and _LINK.match(text, at)
        )
    ):
        return False
    if word == "Co" and COMPANY.match(text, at):
        return False
    return True


def _after_nested(text: str, start: int, a: int, b: int) -> bool:
    """Whether a sentence ends with the nested part text[a:b] that closes to ground level."""
    inner = text[a : b - 1].rstrip("   ")
    if not inner or inner[-1] not in _TERMINATORS:
        return False
    n = len(text)
    if b >= n:
        return True
    if inner[-1] == "." and text[b - 1] in ")]）":
        # a bracket inside a sentence may end in an abbreviation; one that is a sentence of its own began it
        if text[start:a].strip():
            return False
    c = text[b]
    if c in _TERMINATORS or c in ",;:，、；：":
        return False
    if c in _GOES_ON and text[b - 1] in "」』":
        return False
    at = _next(text, b)
    if at >= n:
        return True
    if text[at] in "—–-":
        return at + 1 < n and not text[at + 1].isspace() and not text[at + 1].islower()
    if at == b and c.isalnum() and c.isascii():
        return False
    if not _begins(text, at) or ATTRIBUTION.match(text, at):
        return False
    if not (text[at].isupper() or text[at].isdigit()) and text[at].isalpha() and not text[start:a].strip():
        # no letter case: an attribution ends in a verb of saying before the next terminator or quotation
        stop = regex.compile(rf"[{_TERMINATORS}“「«]").search(text, at)
        clause = text[at : stop.start()] if stop else text[at:]
        if SAYING.search(clause):
            return False
    return True


def _thai_cuts(text: str, nested: list[tuple[int, int]]) -> list[int]:
    cuts, k = [], 0
    for m in _GAP.finditer(text):
        a, b = m.span()
        while k < len(nested) and nested[k][1] <= a:
            k += 1
        if a == 0 or b >= len(text) or (k < len(nested) and nested[k][0] < a):
            continue
        left, right = text[a - 1], text[b]
        if left.isdigit() or right.isdigit() or not (_THAI.match(left) or left in "”\"»)!?…") or not (_THAI.match(right) or right in "“\"«"):
            continue
        if "\n" in m.group():
            continue
        cuts.append(a)
    return cuts


def block_sentences(text: str) -> list[tuple[int, int]]:
    """Sentences of one block (no blank line in it) as offsets within it."""
    nested = _nested(text)
    if "—" in text:
        # speech that only overlaps a quotation gives way to it, as its mark came later
        nested = sorted(nested + _dash_quotes(text))
        merged: list[tuple[int, int]] = []
        for p in nested:
            if not merged or p[0] >= merged[-1][1]:
                merged.append(p)
        nested = merged
    events = [(m.start(), m.end(), 0) for m in _ENDS.finditer(text)]
    if nested:
        kept, k = [], 0
        for e in events:
            while k < len(nested) and nested[k][1] <= e[0]:
                k += 1
            if k == len(nested) or e[0] < nested[k][0]:
                kept.append(e)
        events = sorted(kept + [(b, a, 1) for a, b in nested])
    thai = len(_THAI.findall(text)) * 3 > len(text)
    if thai:
        events = sorted(events + [(a, a, 2) for a in _thai_cuts(text, nested)])
    out, levels = [], Levels()
    start = _next(text, 0)
    for x, y, kind in events:
        if x < start:
            continue
        if kind == 0:
            end = y if _ends_sentence(text, start, x, y, levels) else 0
        elif kind == 1:
            end = x if _after_nested(text, start, y, x) else 0
        else:
            end = x
        if end > start:
            out.append((start, end))
            start = _next(text, end)
    stop = len(text.rstrip())
    if stop > start:
        out.append((start, stop))
    return out


def sentence_offsets(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence of a text, in order; blank texts have none."""
    out, at = [], 0
    for m in _BLOCK.finditer(text):
        if m.start() > at:
            block = text[at : m.start()]
            out += [(at + a, at + b) for a, b in block_sentences(block)]
        at = m.end()
    if at < len(text):
        out += [(at + a, at + b) for a, b in block_sentences(text[at:])]
    return out


def sentence_rows(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_pos, end_pos) for each sentence. Null ids or texts and blank texts give no row; each row of the input is cut on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                ids, starts, ends = [], [], []
                for i, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    if i is None or not text:
                        continue
                    for a, b in sentence_offsets(text):
                        ids.append(i)
                        starts.append(a)
                        ends.append(b)
                yield pa.RecordBatch.from_pydict(
                    {id_col: pa.array(ids, batch.schema.field(0).type), "start_pos": pa.array(starts, pa.int32()), "end_pos": pa.array(ends, pa.int32())}
                )

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"{id_col} {kind}, start_pos int, end_pos int")
