"""Similar pairs: lexical edges through an inverted index, and the cosine join in blocks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut_lineage

BLOCK = 2048


def normalized(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): unit vectors as doubles. Null, empty, zero and non-finite vectors are left out."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = vectors.where(F.col(id_col).isNotNull() & (F.size(F.coalesce(F.col(vec_col), F.array().cast("array<float>"))) > 0)).select(F.col(id_col).alias("id"), v.alias("v"))
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    rows = rows.withColumn("n", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).where("n > 0")
    return rows.select("id", F.transform("v", lambda x: x / F.col("n")).alias("v"))


def _packed(rows: DataFrame, blocks: int, kind: str) -> DataFrame:
    """(k, width, ids, m): the vectors of a block as one row and one binary matrix, so that pairing blocks moves matrices, not vectors."""

    def pack(part: pa.Table) -> pa.Table:
        out = {"k": [], "width": [], "ids": [], "m": []}
        widths = np.array(part.column("width").to_pylist())
        for w in np.unique(widths):
            own = part.filter(pa.array(widths == w))
            flat = own.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            out["k"].append(part.column("k")[0].as_py())
            out["width"].append(int(w))
            out["ids"].append(own.column("id").to_pylist())
            out["m"].append(np.ascontiguousarray(flat, np.float64).tobytes())
        return pa.table(
            {
                "k": pa.array(out["k"], pa.int32()),
                "width": pa.array(out["width"], pa.int32()),
                "ids": pa.array(out["ids"], pa.list_(part.schema.field("id").type)),
                "m": pa.array(out["m"], pa.binary())
            }
        )

    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("k"), F.size("v").alias("width"), "id", "v")
    return dealt.groupBy("k").applyInArrow(pack, f"k int, width int, ids array<{kind}>, m binary")


def cosine_pairs(vectors: DataFrame, threshold: float, id_col: str = "vec_id", vec_col: str = "embedding", focus: DataFrame | None = None, blocks: int | None = None) -> DataFrame:
    """(a, b, similarity), a < b, of all pairs with at least the threshold (inclusive); with focus, only pairs that touch it.

    Vectors are dealt to blocks by a hash of the id and packed to one matrix a block; a pair of blocks is one row that multiplies two matrices,
    so memory is bounded by the block size whatever the number of vectors, and no pair is met twice. With focus only its blocks are
    the left side, so the work is that of focus times all. Without a number of blocks each has about BLOCK vectors. Vectors of other lengths than their partner's have similarity 0.
    """
    rows = normalized(vectors, id_col, vec_col)
    kind = dict(vectors.dtypes)[id_col]
    right = _packed(rows, blocks or max(1, -(-rows.count() // BLOCK)), kind).select(F.col("k").alias("y"), "width", F.col("ids").alias("right_ids"), F.col("m").alias("right_m"))
    if focus is None:
        right = cut_lineage(right)
        left = right.select(F.col("y").alias("x"), "width", F.col("right_ids").alias("left_ids"), F.col("right_m").alias("left_m"))
        pairs = left.join(right, "width").where("x <= y")
    else:
        marked = rows.join(focus.select(F.col(id_col).alias("id")).dropDuplicates(["id"]), "id", "left_semi")
        left = _packed(marked, blocks or max(1, -(-marked.count() // BLOCK)), kind).select(
            F.col("k").alias("x"),
            "width",
            F.col("ids").alias("left_ids"),
            F.col("m").alias("left_m")
        )
        pairs = left.join(right, "width")
    whole = focus is None

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(name)[r].as_py() for name in ("x", "y", "width", "left_ids", "left_m", "right_ids", "right_m")}
                left_m, right_m = (np.frombuffer(row[name]).reshape(-1, row["width"]) for name in ("left_m", "right_m"))
                s = left_m @ right_m.T
                i, j = np.nonzero(s >= threshold - 1e-12)
                ids, others = np.array(row["left_ids"]), np.array(row["right_ids"])
                a, b = ids[i], others[j]
                keep = a != b
                if whole and row["x"] == row["y"]:
                    keep = a < b
                elif not whole:
                    # two of the focus meet from either side
                    keep &= ~(np.isin(b, ids) & (a > b))
                yield pa.RecordBatch.from_pydict(
                    {
                        "a": pa.array(np.minimum(a, b)[keep].tolist(), batch.schema.field("left_ids").type.value_type),
                        "b": pa.array(np.maximum(a, b)[keep].tolist(), batch.schema.field("left_ids").type.value_type),
                        "similarity": pa.array(np.round(s[i, j][keep], 12))
                    }
                )

    out = pairs.select("x", "y", "width", "left_ids", "left_m", "right_ids", "right_m").mapInArrow(multiply, f"a {kind}, b {kind}, similarity double")
    # pairs within the focus may meet in two pairs of blocks
    return out if whole else out.dropDuplicates(["a", "b"])


def lexical_edges(items: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """(a, b, stems, phrases, exact, score) of items with three shared rare stems or a shared rare two-word phrase.

    Tokens in more than max(8, min(30, n // 5)) items and phrases in more than max(5, min(20, n // 10)) are no evidence, which is part
    of the result's definition and bounds each posting list. Null ids and texts give nothing.
    """
    rows = items.where(F.col(id_col).isNotNull())
    total = rows.agg(F.count_distinct(id_col)).first()[0]
    stem_cut, phrase_cut = max(8, min(30, total // 5 or 1)), max(5, min(20, total // 10 or 1))
    n = len(text_cols)
    # one projection after the other, so that no step is computed once for each of its uses
    per = rows.select(F.col(id_col).alias("id"), *[T.bases(F.col(c)).alias(f"e{k}") for k, c in enumerate(text_cols)])
    per = per.select("*", *[F.transform(f"e{k}", T.stem).alias(f"s{k}") for k in range(n)])
    named = lambda kind, values: F.transform(values, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("t")))
    parts = [named("s", F.array_distinct(F.concat(*[F.col(f"s{k}") for k in range(n)]))), named("e", F.array_distinct(F.concat(*[F.col(f"e{k}") for k in range(n)])))]
    parts.append(named("p", F.array_distinct(F.concat(*[T.phrases(F.col(f"s{k}")) for k in range(n)]))))
    # kept, as the counts, the postings and the exact tokens are all read from it
    tokens = cut_lineage(per.select("id", F.explode(F.concat(*parts)).alias("x")).select("id", "x.kind", "x.t").dropDuplicates(["kind", "t", "id"]))
    often = tokens.where("kind <> 'e'").groupBy("kind", "t").agg(F.count("*").alias("df")).where(
        (F.col("df") > 1) & (F.col("df") <= F.when(F.col("kind") == "s", stem_cut).otherwise(phrase_cut))
    )
    rare = tokens.join(often.select("kind", "t"), ["kind", "t"])
    met = rare.alias("x").join(rare.alias("y"), ["kind", "t"]).where("x.id < y.id").groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(
        F.count(F.when(F.col("kind") == "s", 1)).alias("stems"),
        F.count(F.when(F.col("kind") == "p", 1)).alias("phrases")
    )
    edges = met.where("stems >= 3 or phrases >= 1")
    # exact tokens count without a cut, but only for pairs that are edges already
    e = tokens.where("kind = 'e'").groupBy("id").agg(F.collect_set("t").alias("e"))
    both = edges.join(e.select(F.col("id").alias("a"), F.col("e").alias("ea")), "a").join(e.select(F.col("id").alias("b"), F.col("e").alias("eb")), "b")
    exact = F.size(F.array_intersect("ea", "eb"))
    return both.select("a", "b", "stems", "phrases", exact.cast("bigint").alias("exact"), (F.col("stems") + 2.0 * F.col("phrases") + 0.25 * exact).alias("score"))


def token_set_links(items: DataFrame, id_col: str, tokens_col: str, least: int = 2, block: int = BLOCK) -> DataFrame:
    """(id, class_id, links): items of equal token sets are one class, named by its smallest id; links counts the other items that share `least` tokens or more.

    Classes are packed to blocks, and each pair of blocks counts on incidence matrices, so a token that a third of all items hold makes no
    pairs of rows: a block gives one count a class. Items with fewer tokens have no links; null ids are left out.
    """
    kind = dict(items.dtypes)[id_col]
    rows = items.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"),
        F.array_sort(F.array_distinct(F.coalesce(tokens_col, F.array().cast("array<string>")))).alias("t")
    ).dropDuplicates(["id"])
    classes = cut_lineage(rows.groupBy("t").agg(F.min("id").alias("class_id"), F.count("*").alias("n")))
    full = classes.where(F.size("t") >= least)
    blocks = max(1, -(-full.count() // block))
    packed = full.groupBy(F.pmod(F.xxhash64("class_id"), F.lit(blocks)).cast("int").alias("k")).agg(F.collect_list(F.struct("class_id", "n", "t")).alias("c"))  # a block of bounded size
    packed = cut_lineage(packed)
    pairs = packed.select(F.col("k").alias("x"), F.col("c").alias("l")).crossJoin(packed.select(F.col("k").alias("y"), F.col("c").alias("r"))).where("x <= y")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y, left, right = (batch.column(k)[i].as_py() for k in range(4))
                # what only one class holds is shared with none
                seen = Counter(w for c in (left if x == y else (*left, *right)) for w in c["t"])
                words = {w: k for k, w in enumerate(w for w, n in seen.items() if n > 1)}

                def matrix(side: list) -> np.ndarray:
                    m = np.zeros((len(side), len(words)), np.float32)
                    for k, c in enumerate(side):
                        m[k, [words[w] for w in c["t"] if w in words]] = 1
                    return m

                def sums(met: np.ndarray, side: list) -> list:
                    return (met.astype(np.float32) @ np.array([c["n"] for c in side], np.float64)).astype(np.int64).tolist()

                met = (matrix(left) @ matrix(right).T) >= least
                if x == y:
                    np.fill_diagonal(met, False)
                ids, links = [c["class_id"] for c in left], sums(met, right)
                if x != y:
                    ids += [c["class_id"] for c in right]
                    links += sums(met.T, left)
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(2).type.value_type.field("class_id").type), pa.array(links, pa.int64())], names=["class_id", "links"])

    counted = pairs.select("x", "y", "l", "r").mapInArrow(count, f"class_id {kind}, links bigint").groupBy("class_id").agg(F.sum("links").alias("links"))
    # copies within a class share all their tokens
    own = classes.join(counted, "class_id", "left").select(
        "t",
        "class_id",
        (F.coalesce("links", F.lit(0)) + F.when(F.size("t") >= least, F.col("n") - 1).otherwise(0)).alias("links")
    )
    return rows.join(own, "t").select("id", "class_id", "links")
