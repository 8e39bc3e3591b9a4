"""Token counts of documents by a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default vocabulary file; never part of this repository.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the public pre-tokenisation pattern that belongs to the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines()) if token}
    return tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(rows: DataFrame, text_col: str, keep: list[str], vocabulary: str = VOCABULARY, out: str = "tokens") -> DataFrame:
    """The columns `keep` and `out`, the number of tokens of the whole text; 0 for null and empty texts."""
    # one vocabulary, about a megabyte, read here so that workers need no file
    with open(vocabulary, "rb") as f:
        shared = rows.sparkSession.sparkContext.broadcast(f.read())
    kept = rows.select(*keep)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields] + [f"`{out}` bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            coder = coder or encoding(shared.value)
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                texts = piece.column(piece.num_columns - 1).to_pylist()
                counts = [len(coder.encode_ordinary(t)) if t else 0 for t in texts]
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(counts, pa.int64())], names=[*keep, out])

    return rows.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)
