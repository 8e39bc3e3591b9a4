"""Lines repeated across one source's documents (problem 3).

Each body is parsed once: lines are normalised and hashed, and one row a document with the hashes of its lines is kept. Distinct documents are
counted by source and hash in a partial aggregation, so a line that stands in a third of all rows is reduced before any shuffle by its
key; hashes over the threshold of documents and of the source's share are joined back to mark occurrences or to rebuild the bodies without them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .residue import is_residue

MIN_DOCUMENTS = 5
#: So many keys, about 40 MB in a worker, are broadcast at most; beyond, the marks are joined to the bodies.
BROADCAST_KEYS = 500_000
_DIGITS = re.compile(r"\d+")
_CLOSING = " .,:;!?…"


def normal_line(line: str) -> str:
    """Letter case, spacing (no-break spaces too), closing punctuation and the digits of numbers don't tell lines apart."""
    return _DIGITS.sub("0", " ".join(line.split())).casefold().rstrip(_CLOSING)


def line_keys(source: str | None, body: str) -> list[tuple[int, int]]:
    """(line number, hash of source and normalised line) of each line that isn't blank."""
    h = xxhash.xxh64_intdigest
    seed = h(source or "")
    return [(no, h(line, seed) - (1 << 63)) for no, line in enumerate(map(normal_line, body.split("\n")), 1) if line]


def parsed_lines(articles: DataFrame, id_col: str = "article_id", source_col: str = "source_id", text_col: str = "body", skip_residue: bool = True) -> DataFrame:
    """(id, source, line_no array, key array), a row a document. Null ids, blank bodies and (if asked) residue have none; repeated rows count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                ids, sources, numbers, keys = [], [], [], []
                for i, source, body in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns)):
                    if i is None or not body or (skip_residue and is_residue(body)):
                        continue
                    own = line_keys(source, body)
                    if own:
                        ids.append(i)
                        sources.append(source or "")
                        numbers.append([no for no, _ in own])
                        keys.append([key for _, key in own])
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": pa.array(ids, pa.string()),
                        "source": pa.array(sources, pa.string()),
                        "line_no": pa.array(numbers, pa.list_(pa.int32())),
                        "key": pa.array(keys, pa.list_(pa.int64()))
                    }
                )

    rows = articles.select(F.col(id_col).cast("string"), F.col(source_col).cast("string"), F.col(text_col))
    return rows.mapInArrow(run, "id string, source string, line_no array<int>, key array<bigint>").dropDuplicates(["id"])


def frequent_keys(lines: DataFrame, least: int = MIN_DOCUMENTS, share: float = 0.0) -> DataFrame:
    """(key, documents): hashes of lines that stand in at least `least` documents of a source and in at least `share` of all its documents.

    lines: rows of `parsed_lines`.
    """
    counted = lines.select(
        "source",
        F.explode(F.array_distinct("key")).alias("key")
    ).groupBy("source", "key").agg(F.count("*").alias("documents")).where(F.col("documents") >= least)
    if share > 0:
        # a row a source
        totals = lines.groupBy("source").agg(F.count("*").alias("all"))
        counted = counted.join(totals, "source").where(F.col("documents") >= F.lit(share) * F.col("all"))
    return counted.select("key", "documents")


def repeated_lines(
    articles: DataFrame,
    id_col: str = "article_id",
    source_col: str = "source_id",
    text_col: str = "body",
    least: int = MIN_DOCUMENTS,
    share: float = 0.0,
    skip_residue: bool = True
) -> DataFrame:
    """(id, line_no) of each occurrence of a frequent line. Null sources form one source; null ids and blank bodies give no row; repeated rows count once."""
    lines = cut_lineage(parsed_lines(articles, id_col, source_col, text_col, skip_residue))
    each = lines.select("id", F.explode(F.arrays_zip("line_no", "key")).alias("x")).select("id", F.col("x.line_no").alias("line_no"), F.col("x.key").alias("key"))
    return each.join(frequent_keys(lines, least, share).select("key"), "key", "left_semi").select(F.col("id").alias(id_col), "line_no")


def without_repeated_lines(
    articles: DataFrame,
    id_col: str = "article_id",
    source_col: str = "source_id",
    text_col: str = "body",
    least: int = MIN_DOCUMENTS,
    share: float = 0.0,
    skip_residue: bool = True
) -> DataFrame:
    """All columns of the articles, `text_col` without the lines `repeated_lines` finds with the same settings; one row per id, nulls stay null, residue and rows without an id as they are."""
    lines = cut_lineage(parsed_lines(articles, id_col, source_col, text_col, skip_residue))
    frequent = cut_lineage(frequent_keys(lines, least, share).select("key"))
    if frequent.count() > BROADCAST_KEYS:
        each = lines.select("id", F.explode(F.arrays_zip("line_no", "key")).alias("x")).select("id", F.col("x.line_no").alias("no"), F.col("x.key").alias("key"))
        marks = each.join(frequent, "key", "left_semi").groupBy(F.col("id").alias("__id")).agg(F.collect_list("no").alias("__drop"))
        joined = articles.dropDuplicates([id_col]).join(marks, F.col(id_col).cast("string") == F.col("__id"), "left")
        kept = F.expr(f"array_join(filter(split(`{text_col}`, '\\n'), (x, i) -> not array_contains(__drop, i + 1)), '\\n')")
        return joined.withColumn(text_col, F.when(F.col("__drop").isNull(), F.col(text_col)).otherwise(kept)).drop("__drop", "__id")
    shared = articles.sparkSession.sparkContext.broadcast(frozenset(frequent.toArrow()["key"].to_pylist()))
    others = [c for c in articles.columns if c != text_col]
    kinds = dict(articles.dtypes)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named, sources, bodies = (c.to_pylist() for c in batch.columns[-3:])
            out = []
            for own, source, body in zip(named, sources, bodies):
                if own and body and not (skip_residue and is_residue(body)):
                    drop = {no for no, key in line_keys(source, body) if key in shared.value}
                    body = "\n".join(x for no, x in enumerate(body.split("\n"), 1) if no not in drop) if drop else body
                out.append(body)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(out, pa.string())], names=[*others, text_col])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*others, text_col])
    return articles.select(
        *others,
        F.col(id_col).isNotNull().alias("__named"),
        F.col(source_col).cast("string").alias("__source"),
        F.col(text_col)
    ).mapInArrow(clean, schema).select(*articles.columns).dropDuplicates([id_col])
