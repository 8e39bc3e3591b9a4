"""Language of documents and of their segments (problem 1).

Multinomial naive Bayes over hashed character n-grams. The model is a log-probability
matrix (hash bucket x language) of fixed size, fitted on a bounded sample of labelled rows and
sent to the workers once; scoring runs in numpy over whole Arrow batches: the segments of a
batch are one array of code points, so hashing, table look-up and summing by segment are
array operations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .residue import is_residue

LANGUAGES = ("de", "en", "es", "fr", "it", "pl", "ru", "uk")
# Names by which a label may call a language (ISO codes, English, the language itself).
LABEL_NAMES = {
    "en": "en eng english", "de": "de deu ger german deutsch", "fr": "fr fra fre french français francais", "es": "es spa spanish español espanol castellano",
    "it": "it ita italian italiano", "pl": "pl pol polish polski", "uk": "uk ukr ukrainian українська", "ru": "ru rus russian русский",
}
_BY_NAME = {name: code for code, names in LABEL_NAMES.items() for name in names.split()}
_LABEL_PARTS = re.compile(r"[/,;|+&]|\band\b")
BUCKET_BITS = 15
ORDERS = (2, 3, 4)
#: Bound of the training sample: so many labelled rows for each language at most, the smallest by a hash of the id.
SAMPLE_PER_LANGUAGE = 250
MIN_WORDS = 8
#: ISO 639-2's code for an undetermined language.
UNKNOWN = "und"
# Letters that are neither Latin nor Cyrillic.
_OTHER_SCRIPT = re.compile("[\u0370-\u03ff\u0530-\u1cff\u2c00-\u2ddf\u2e80-\ua63f\uaa00-\ufaff\ufb1d-\uffdc\U00010000-\U0003ffff]")
_MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917, 668265263], dtype=np.uint32)
_CHUNK = 400_000


def label_languages(label: str | None) -> set[str]:
    """The languages a label names: `ru/en` both, `pl-PL` and `Polski` pl; null, empty and unspecific ones none."""
    named = set()
    for part in _LABEL_PARTS.split((label or "").casefold()):
        part = part.strip()
        code = _BY_NAME.get(part) or _BY_NAME.get(re.split(r"[-_ (]", part, maxsplit=1)[0])
        if code:
            named.add(code)
    return named


def numbered_segments(body: str) -> list[tuple[int, str]]:
    """The paragraphs of a body, lines of at least MIN_WORDS words, each with its line number."""
    return [(no, line) for no, line in enumerate(body.split("\n"), 1) if len(line.split()) >= MIN_WORDS]


def all_segments(body: str) -> list[tuple[int, int, int, str]]:
    """(line number, start, end, text) of the paragraphs and, between them, of each run of shorter lines; texts without a letter are none. Offsets count characters of the body."""
    out: list[tuple[int, int, int, str]] = []
    run: list[tuple[int, int, int]] = []

    def flush() -> None:
        if run:
            no, begin, end = run[0][0], run[0][1], run[-1][2]
            text = body[begin:end]
            if any(map(str.isalpha, text)):
                out.append((no, begin, end, text))
            run.clear()

    at = 0
    for no, line in enumerate(body.split("\n"), 1):
        bare = line.strip()
        if bare:
            begin = at + len(line) - len(line.lstrip())
            if len(bare.split()) >= MIN_WORDS:
                flush()
                if any(map(str.isalpha, bare)):
                    out.append((no, begin, begin + len(bare), bare))
            else:
                run.append((no, begin, begin + len(bare)))
        at += len(line) + 1
    flush()
    return out


def segments(body: str) -> list[str]:
    return [line for _, line in numbered_segments(body)]


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each preceded by a blank; the start of each."""
    joined = " " + " ".join(texts).lower() + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return codes, starts


def _hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each position; digits and signs count as blanks."""
    n = len(codes) - order + 1
    h = np.full(max(n, 0), order * 97, dtype=np.uint32)
    for k in range(order):
        h = (h ^ codes[k : k + n]) * _MULTIPLIERS[k]
    h ^= h >> np.uint32(15)
    return (h * np.uint32(2246822519)) >> np.uint32(32 - BUCKET_BITS)


def _clean(codes: np.ndarray) -> np.ndarray:
    letter = (codes > 0xBF) | ((codes >= 97) & (codes <= 122)) | (codes == 39)
    return np.where(letter, codes, np.uint32(32)).astype(np.uint32)


class NaiveBayes:
    """log P(n-gram | language), flat prior; float32 of shape (2**BUCKET_BITS, languages)."""

    def __init__(self, table: np.ndarray, languages: tuple[str, ...]):
        self.table, self.languages = table.astype(np.float32), languages

    @classmethod
    def fit(cls, texts: list[str], labels: list[str], languages: tuple[str, ...] = LANGUAGES) -> NaiveBayes:
        counts = np.full((1 << BUCKET_BITS, len(languages)), 0.05)
        for j, language in enumerate(languages):
            own = [t for t, x in zip(texts, labels) if x == language]
            if own:
                codes = _clean(_codes(own)[0])
                for order in ORDERS:
                    counts[:, j] += np.bincount(_hashes(codes, order), minlength=1 << BUCKET_BITS)
        return cls(np.log(counts / counts.sum(axis=0)), languages)

    def score(self, texts: list[str]) -> np.ndarray:
        """Mean log-probability of an n-gram, by text and language."""
        out, at = [], 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size + len(texts[end]) < _CHUNK):
                size += len(texts[end]) + 1
                end += 1
            codes, starts = _codes(texts[at:end])
            codes = _clean(codes)
            total = np.zeros((len(starts), len(self.languages)), dtype=np.float32)
            for order in ORDERS:
                h = _hashes(codes, order)
                total += np.add.reduceat(self.table[h], np.minimum(starts, len(h) - 1), axis=0)
            out.append(total / (np.diff(np.append(starts, len(codes))) * len(ORDERS))[:, None])
            at = end
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)), np.float32)

    def classify(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Best language and its confidence: the posterior, tempered to as many independent n-grams as a text has words.

        A text most of whose letters are of a script that no language of the model is written in is UNKNOWN, with that share as confidence.
        """
        if not texts:
            return [], np.zeros(0)
        s = self.score(texts)
        words = np.fromiter((1 + t.count(" ") for t in texts), dtype=np.float32, count=len(texts))
        p = np.exp((s - s.max(axis=1, keepdims=True)) * words[:, None])
        said, sure = [self.languages[i] for i in s.argmax(axis=1)], p.max(axis=1) / p.sum(axis=1)
        for k, text in enumerate(texts):
            if not text.isascii():
                foreign = len(_OTHER_SCRIPT.findall(text))
                if foreign and (letters := sum(map(str.isalpha, text))) and foreign > 0.5 * letters:
                    said[k], sure[k] = UNKNOWN, foreign / letters
        return said, sure


def fit_model(articles: DataFrame, id_col: str = "article_id", label_col: str = "original_language", text_col: str = "body", per_language: int = SAMPLE_PER_LANGUAGE) -> NaiveBayes:
    """Fits on at most `per_language` rows for each language a label names first (a bounded sample of labelled rows).

    Labels are partly wrong: a first model relabels the sample's paragraphs, and those on which model and
    label disagree are left out of the second. A language without any labelled row is never assigned.
    """
    spark = articles.sparkSession
    names = [(n, c) for n, c in _BY_NAME.items()]
    mapping = F.create_map(*[x for n, c in names for x in (F.lit(n), F.lit(c))])
    first = F.regexp_extract(F.lower(F.trim(F.col(label_col))), r"^(\p{L}+)", 1)
    keys = articles.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("__id"),
        F.element_at(mapping, first).alias("__lang")
    ).where("__lang is not null").dropDuplicates(["__id"])
    ranked = keys.withColumn("__k", F.row_number().over(Window.partitionBy("__lang").orderBy(F.xxhash64("__id"), "__id"))).where(F.col("__k") <= per_language)
    # at most len(LANGUAGES) * per_language rows, so the ids are known to be few
    sample = F.broadcast(ranked.select("__id", "__lang"))
    rows = articles.join(sample, F.col(id_col) == F.col("__id")).select("__id", "__lang", F.col(text_col).alias("__text")).dropDuplicates(["__id"]).collect()
    texts, labels = [], []
    for r in sorted(rows, key=lambda r: r["__id"]):
        for line in segments(r["__text"] or ""):
            texts.append(line)
            labels.append(r["__lang"])
    present = tuple(x for x in LANGUAGES if x in set(labels)) or LANGUAGES
    model = NaiveBayes.fit(texts, labels, present)
    if texts:
        said, _ = model.classify(texts)
        kept = [(t, x) for t, x, y in zip(texts, labels, said) if x == y]
        model = NaiveBayes.fit([t for t, _ in kept], [x for _, x in kept], present)
    return model


def _scan(articles: DataFrame, model: NaiveBayes, schema: str, emit, id_col: str, label_col: str, text_col: str, whole: bool = False) -> DataFrame:
    """whole: a body with letters but without paragraphs is one segment, numbered 0, and residue is kept."""
    shared = articles.sparkSession.sparkContext.broadcast((model.table, model.languages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = NaiveBayes(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                ids, labels, bodies = (c.to_pylist() for c in batch.slice(at, 512).columns)
                lines, owner, numbers = [], [], []
                for k, body in enumerate(bodies):
                    if ids[k] is not None and body and (whole or not is_residue(body)):
                        found = numbered_segments(body)
                        if whole and not found and any(map(str.isalpha, body)):
                            found = [(0, " ".join(body.split()))]
                        numbers += [no for no, _ in found]
                        lines += [line for _, line in found]
                        owner += [k] * len(found)
                languages, confidence = own.classify(lines)
                yield emit(ids, labels, lines, owner, numbers, languages, confidence)

    return articles.select(F.col(id_col).cast("string"), F.col(label_col), F.col(text_col)).mapInArrow(run, schema)


def missing_languages(articles: DataFrame, model: NaiveBayes, id_col: str = "article_id", label_col: str = "original_language", text_col: str = "body") -> DataFrame:
    """(article_id, language) for each language in which a body has a paragraph and which the label doesn't name.

    Residue (problem 5) and rows with a null id or a null or blank body give no row; repeated rows count once.
    """

    def emit(ids, labels, lines, owner, numbers, languages, confidence):
        pairs = sorted({(k, x) for k, x in zip(owner, languages)})
        named = {k: label_languages(labels[k]) for k in {k for k, _ in pairs}}
        out = [(ids[k], x) for k, x in pairs if x not in named[k] and x != UNKNOWN]
        return pa.RecordBatch.from_pydict({id_col: pa.array([a for a, _ in out], pa.string()), "language": pa.array([b for _, b in out], pa.string())})

    return _scan(articles, model, f"{id_col} string, language string", emit, id_col, label_col, text_col).dropDuplicates([id_col, "language"])


def segment_languages(articles: DataFrame, model: NaiveBayes, id_col: str = "article_id", label_col: str = "original_language", text_col: str = "body") -> DataFrame:
    """(article_id, line_no, start_pos, end_pos, language, confidence) of each segment: a paragraph, or a run of shorter lines between paragraphs.

    Lines are numbered from 1 with blank ones included, positions from 0; a run has the number of its first line. Rows
    with a null id or a null or blank body give no row, nor does text without a letter; residue (problem 5) is read as any other text; repeated rows count once.
    """
    shared = articles.sparkSession.sparkContext.broadcast((model.table, model.languages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = NaiveBayes(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                ids, bodies = (c.to_pylist() for c in batch.slice(at, 512).columns)
                found = [(i, *x) for i, body in zip(ids, bodies) if i is not None and body for x in all_segments(body)]
                languages, confidence = own.classify([x[4] for x in found])
                columns = [
                    pa.array([x[0] for x in found], pa.string()),
                    *(pa.array([x[k] for x in found], pa.int32()) for k in (1, 2, 3)),
                    pa.array(languages, pa.string()),
                    pa.array(np.round(np.asarray(confidence, np.float64), 6))
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "line_no", "start_pos", "end_pos", "language", "confidence"])

    rows = articles.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(
        run,
        f"{id_col} string, line_no int, start_pos int, end_pos int, language string, confidence double"
    )
    return rows.dropDuplicates([id_col, "line_no"])


def paragraph_languages(articles: DataFrame, model: NaiveBayes, id_col: str = "article_id", label_col: str = "original_language", text_col: str = "body") -> DataFrame:
    """One row for each article: its main language (most characters) and confidence, and a map of each language's share of characters.

    A body without paragraphs is scored as a whole, residue (problem 5) as any other; bodies without letters and null ids give no row.
    """

    def emit(ids, labels, lines, owner, numbers, languages, confidence):
        share: dict = {}
        for k, line, x, c in zip(owner, lines, languages, confidence):
            a = share.setdefault(k, {}).setdefault(x, [0, 0.0])
            a[0] += len(line)
            a[1] += len(line) * float(c)
        rows = []
        for k, by in share.items():
            best = max(sorted(by), key=lambda x: by[x][0])
            total = sum(n for n, _ in by.values())
            rows.append((ids[k], best, round(by[best][1] / by[best][0], 6), sorted((x, round(n / total, 6)) for x, (n, _) in by.items())))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.string()),
                pa.array([r[1] for r in rows], pa.string()),
                pa.array([r[2] for r in rows], pa.float64()),
                pa.array([r[3] for r in rows], pa.map_(pa.string(), pa.float64()))
            ],
            names=[id_col, "language", "confidence", "shares"]
        )

    return _scan(
        articles,
        model,
        f"{id_col} string, language string, confidence double, shares map<string,double>",
        emit,
        id_col,
        label_col,
        text_col,
        whole=True
    ).dropDuplicates([id_col])
