"""Deduplicating new batches against all history (problem 6).

Exact keys (normalised address, content hash) and hashed pieces of the normalised text lie in bucketed tables (`History`). A batch
is matched by bucket-local semi-joins of its own keys with these tables, the coverage of shared pieces decides which pairs are
held against the exact piece sets, and what is accepted is appended. Whole lines as pieces would lose records with an edit in every
paragraph, so a piece is five successive words, and of a text's n pieces the first n - ceil(0.6 n) + 1 in one order of all pieces are stored.
Two sets with three fifths of their union in common have a piece among these of both (prefix filter): otherwise the set whose
prefix ends first in the order would lack all of its own prefix in the other. That holds for every order as long as it is the same
for all texts. The order puts often used pieces last; how often is counted over all texts in a table of fixed size, so it only decides
how much is joined, never what is found.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir

THRESHOLD = 0.6
PIECE = 5
#: The table of how often pieces are used: 2**22 counters, 4 MB where they are sent, whatever the number of texts.
COUNTER_BITS = 22
_CHUNKS = 64
BUCKETS = 64
#: A load that would write more files than this is shuffled into its buckets first; it changes the layout only.
MOST_FILES = 4096
#: So many ids, about 12 MB, are broadcast at most.
BROADCAST_IDS = 200_000
# Digests of the empty text (SHA-256, SHA-1, MD5, SHA-512, SHA-384, SHA-224).
EMPTY_HASHES = (
    "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", "da39a3ee5e6b4b0d3255bfef95601890afd80709", "d41d8cd98f00b204e9800998ecf8427e",
    "cf83e1357eefb8bdf1542850d66d8007d620e4050b5715dc83f4a921d36ce9ce47d0d13c5d85f2b0ff8318d2877eec2f63b931bd47417a81a538327af927da3e",
    "38b060a751ac96384cd9327eb1b1e36a21fdb71114be07434c0cc7bf63f6e1da274edebfe76f65fbd51ad2f14898b95b", "d14a028c2a3a2bc9476102bb288234c415a2b01f828ea62ac5b3e42f",
)
_GAPS = re.compile(r"\W+")
_TEXTS = 128


def normal_address(c: Column) -> Column:
    """Scheme, leading www., host case, default port, trailing slash, fragment, tracking parameters, order and repetition of parameters don't matter."""
    text = F.regexp_replace(F.trim(c), r"#.*$", "")
    rest = F.regexp_replace(text, r"(?i)^[a-z][a-z0-9+.\-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_sort(F.array_distinct(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(r"^(utm_[^=]*|fbclid|gclid)(=|$)"))))
    return F.when(text != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def normal_hash(c: Column) -> Column:
    """Letter case and a leading algorithm name don't matter; the hash of an empty text is none."""
    bare = F.regexp_replace(F.lower(F.trim(c)), r"^(sha-?\d+|sha3-?\d+|md5|blake2[bs]?|blake3|xxh\d*)\s*[:=\-_/ ]\s*|^(?:sha256|sha1|sha512|md5)(?=[0-9a-f]{32,}$)", "")
    return F.when(~bare.isin(*EMPTY_HASHES) & (bare != ""), bare)


_P = 0x9E3779B97F4A7C15
_INV = pow(_P, -1, 1 << 64)
_WEIGHTS = np.array([0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0xA0761D6478BD642F], np.uint64)
_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    if not _tables or len(_tables[0]) < n:
        size = max(n, 1 << 19)
        _tables[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, np.uint64(x), np.uint64)])) for x in (_P, _INV)]
    return _tables[0][:n], _tables[1][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_pieces(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(content keys, owner, pieces) of some texts: the distinct pieces of each, ascending, and the text each belongs to.

    Letter case, punctuation and line ends don't count. The content key is a hash of all words; 0 for texts of under five words, which have no piece.
    All texts are one array of bytes: words are hashed from prefix sums, pieces from the hashes of five words.
    """
    plain = [_GAPS.sub(" ", t.lower()).strip() for t in texts]
    data = np.frombuffer(("\n".join(plain) + "\n").encode("utf-8", "replace"), np.uint8)
    line = data == 10
    ends = np.flatnonzero(line | (data == 32))
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    owner = np.cumsum(line)[ends] - line[ends]
    full = ends > starts
    starts, ends, owner = starts[full], ends[full], owner[full]
    none = np.zeros(len(texts), np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(starts) < PIECE:
        return none
    power, inverse = _powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])
    words = _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    n = len(words) - PIECE + 1
    whole = np.flatnonzero(owner[:n] == owner[PIECE - 1 :])
    if not len(whole):
        return none
    h = np.zeros(len(whole), np.uint64)
    for k in range(PIECE):
        h += words[whole + k] * _WEIGHTS[k]
    h, owner = _mix(h), owner[whole]
    first = np.argsort(h)
    order = first[np.argsort(owner[first].astype(np.uint16), kind="stable")]
    h, owner = h[order], owner[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])
    h, owner = h[new], owner[new]
    keys = np.zeros(len(texts), np.int64)
    for k in np.unique(owner).tolist():
        keys[k] = xxhash.xxh64_intdigest(plain[k]) - (1 << 63) or 1
    return keys, owner, h


def kept(owner: np.ndarray, pieces: np.ndarray, often: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, pieces, sizes) of the pieces to store: the first n - ceil(0.6 n) + 1 of each text by (often, piece); sizes has n."""
    if often is not None:
        rank = (owner << 8 | often[(pieces >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]).astype(np.uint16)
        order = np.argsort(rank, kind="stable")
        pieces = pieces[order]
    counts = np.bincount(owner)
    begin = np.cumsum(counts) - counts
    size = counts[owner]
    keep = np.arange(len(owner)) - begin[owner] < size - np.ceil(THRESHOLD * size - 1e-9) + 1
    return owner[keep], pieces[keep], size[keep].astype(np.int32)


def jaccard(a: str | None, b: str | None) -> float:
    _, owner, h = text_pieces([a or "", b or ""])
    x, y = h[owner == 0], h[owner == 1]
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if both else 0.0


def piece_order(texts: DataFrame, text_col: str = "body") -> np.ndarray:
    """How often the pieces of each counter are used in all texts, on a scale of 256 steps; any table gives the same duplicates."""
    width = (1 << COUNTER_BITS) // _CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(1 << COUNTER_BITS, np.uint32)
        waiting, held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                h = text_pieces([t for t in batch.column(0).slice(at, _TEXTS).to_pylist() if t])[2]
                waiting.append((h >> np.uint64(64 - COUNTER_BITS)).astype(np.int32))
                held += len(h)
                if held > 2_000_000:
                    total += np.bincount(np.concatenate(waiting), minlength=len(total)).astype(np.uint32)
                    waiting, held = [], 0
        if held:
            total += np.bincount(np.concatenate(waiting), minlength=len(total)).astype(np.uint32)
        parts = [(k, total[k * width : (k + 1) * width]) for k in range(_CHUNKS)]
        parts = [(k, zlib.compress(p.tobytes(), 1)) for k, p in parts if p.any()]
        task = TaskContext.get().partitionId() // 256
        yield pa.RecordBatch.from_pydict(
            {
                "chunk": pa.array([k for k, _ in parts], pa.int32()),
                "task": pa.array([task] * len(parts), pa.int32()),
                "counts": pa.array([p for _, p in parts], pa.binary())
            }
        )

    def add(part: pa.Table) -> pa.Table:
        total = np.zeros(width, np.uint64)
        for x in part.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(x), np.uint32)
        counts = np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32)
        return pa.table({"chunk": part.column("chunk").slice(0, 1), "task": pa.array([0], pa.int32()), "counts": pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())})

    def scaled(part: pa.Table) -> pa.Table:
        whole = add(part)
        counts = np.frombuffer(zlib.decompress(whole.column("counts")[0].as_py()), np.uint32)
        steps = np.minimum(255, np.round(8 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)
        return whole.set_column(2, "counts", pa.array([steps.tobytes()], pa.binary()))

    schema = "chunk int, task int, counts binary"
    # at most 256 tasks' counters meet in a group, then one row for 256 tasks
    summed = texts.select(text_col).mapInArrow(count, schema).groupBy("chunk", "task").applyInArrow(add, schema)
    often = np.zeros(1 << COUNTER_BITS, np.uint8)
    # _CHUNKS rows of a byte a counter, 4 MB in all: the driver never holds the counts
    for row in summed.groupBy("chunk").applyInArrow(scaled, schema).collect():
        often[row["chunk"] * width : (row["chunk"] + 1) * width] = np.frombuffer(row["counts"], np.uint8)
    return often


PIECE_ROWS = "key bigint, text_key bigint, size int, id string"


def piece_rows(records: DataFrame, often: np.ndarray | None, id_col: str = "id", text_col: str = "body") -> DataFrame:
    """Rows (key, text_key, size, id): for each text its stored pieces, with the number of all its pieces, and a row of size 0 whose key is the content key and which has the id."""
    shared = records.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                ids, texts = (c.to_pylist() for c in batch.slice(at, _TEXTS).columns)
                whole, owner, h = text_pieces([t or "" for t in texts])
                named = [k for k, (i, x) in enumerate(zip(ids, whole.tolist())) if x and i is not None]
                own = [whole[k] for k in named]
                if not named:
                    continue
                owner, h, size = kept(owner, h, shared.value)
                if len(named) < len(ids):
                    mine = np.isin(owner, named)
                    owner, h, size = owner[mine], h[mine], size[mine]
                empty = np.zeros(len(named), np.int32)
                arrays = [np.concatenate([h.view(np.int64), own]), np.concatenate([whole[owner], own]), np.concatenate([size, empty])]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, arrays), pa.concat_arrays([pa.nulls(len(h), pa.string()), pa.array([ids[k] for k in named], pa.string())])],
                    names=["key", "text_key", "size", "id"]
                )

    return records.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(run, PIECE_ROWS)


def _verified(pairs: DataFrame) -> DataFrame:
    """Of rows (a, text_a, b, text_b) the (a, b) whose piece sets have THRESHOLD of their union in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS // 2):
                left, xs, right, ys = (c.to_pylist() for c in batch.slice(at, _TEXTS // 2).columns)
                _, owner, h = text_pieces([t or "" for t in (*xs, *ys)])
                ends = np.searchsorted(owner, np.arange(len(xs) + len(ys) + 1))
                out = []
                for k, (i, o) in enumerate(zip(left, right)):
                    a, b = h[ends[k] : ends[k + 1]], h[ends[len(xs) + k] : ends[len(xs) + k + 1]]
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    if both and both >= THRESHOLD * (len(a) + len(b) - both):
                        out.append((i, o))
                yield pa.RecordBatch.from_pydict({"a": pa.array([p for p, _ in out], pa.int64()), "b": pa.array([q for _, q in out], pa.int64())})

    return pairs.select("a", "text_a", "b", "text_b").mapInArrow(run, "a bigint, b bigint")


def _plain_keys(records: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """(key, id): address and hash keys of records (id, source_id, canonical_url, content_hash)."""
    source = F.coalesce(F.col("source_id"), F.lit(""))
    address = records.select(
        F.xxhash64(F.lit("a"), source, normal_address(F.col("canonical_url"))).alias("key"),
        "id",
        normal_address(F.col("canonical_url")).isNotNull().alias("__ok")
    )
    digest = records.select(F.xxhash64(F.lit("h"), normal_hash(F.col("content_hash"))).alias("key"), "id", normal_hash(F.col("content_hash")).isNotNull().alias("__ok"))
    keys = address.unionByName(digest)
    if aliases is not None:
        other = normal_address(F.col("candidate_url"))
        keys = keys.unionByName(
            aliases.select(
                F.xxhash64(F.lit("a"), F.coalesce(F.col("source_id"), F.lit("")), other).alias("key"),
                F.col("duplicate_of_article_id").alias("id"),
                other.isNotNull().alias("__ok")
            )
        )
    return keys.where("__ok and id is not null").select("key", "id").dropDuplicates(["key", "id"])


def free_driver(spark: SparkSession) -> None:
    """Lets go of what finished steps left on the driver (plans, broadcasts) and, through it, of their shuffle files; else they stay until its heap happens to fill."""
    spark._jvm.System.gc()


def at_home(keys: DataFrame, buckets: int) -> DataFrame:
    """Distinct keys in as many partitions as a table has buckets, so that a join with it moves nothing of the table, whatever the session's shuffle partitions."""
    return keys.select("key").repartition(buckets, "key").dropDuplicates(["key"]).hint("shuffle_hash")


def _text_matches(own: DataFrame, old: DataFrame, new_texts: DataFrame, old_texts: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of contents: (text_key, other) with the smallest old record that repeats a new content, and (a, b) of new ones.

    own and old are piece_rows in one order; old may be a bucketed table, whose rows then stay where they are until they have met one of
    the new keys. Equal contents are one: copies, however many, are never paired with each other.
    """
    mine = cut_lineage(own.where("size > 0").select("key", "text_key", "size").dropDuplicates(["text_key", "key"]))
    # of a bucketed table only rows of wanted keys leave their bucket
    met_old = old.where("size > 0").select("key", "text_key", "size").join(at_home(mine, buckets), "key", "left_semi")
    met = met_old.unionByName(mine.select("key", "text_key", "size")).dropDuplicates(["text_key", "key"]).select("key", F.col("text_key").alias("b"), F.col("size").alias("n_b"))
    met = mine.select("key", F.col("text_key").alias("a"), F.col("size").alias("n_a")).join(met, "key").where("a <> b")
    # what two prefixes share is all that lies before the first end of them, so the rest adds at most what is left of that set
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    least = F.lit(THRESHOLD / (1 + THRESHOLD)) * (small + large) - F.lit(1e-6)
    left_over = F.ceil(F.lit(THRESHOLD) * large - F.lit(1e-9)) - 1
    shared = met.where(small >= F.lit(THRESHOLD) * large - F.lit(1e-6)).groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("shared"))
    pairs = cut_lineage(shared.where(F.col("shared") + F.least(left_over, small) >= least).select("a", "b"))
    contents = own.where("size = 0").select("text_key", "id")
    same = contents.select(F.col("text_key").alias("b")).dropDuplicates(["b"])
    sides = pairs.select("b").union(same).withColumnRenamed("b", "key")
    old_first = old.where("size = 0").select("key", "id").join(at_home(sides, buckets), "key", "left_semi").groupBy("key").agg(F.min("id").alias("id"))
    old_first = cut_lineage(old_first.withColumnRenamed("key", "text_key"))
    new_first = contents.groupBy("text_key").agg(F.min("id").alias("id"))
    paired = pairs.select(F.col("b").alias("text_key")).dropDuplicates(["text_key"])
    wanted_old = old_first.join(paired, "text_key", "left_semi")
    # few texts of history are needed: their ids are broadcast if they are few by count, else the join shuffles
    if old_first.count() <= BROADCAST_IDS:
        wanted_old = F.broadcast(wanted_old)
    # a repeated row is dropped where the join has put it, by id, so no text moves again
    body = lambda first, texts: texts.join(first, "id").select("id", "text_key", "body").dropDuplicates(["id", "text_key"]).select("text_key", "body")
    old_bodies = body(wanted_old, old_texts)
    new_bodies = body(new_first.join(pairs.select(F.col("a").alias("text_key")).union(paired).dropDuplicates(["text_key"]), "text_key", "left_semi"), new_texts)
    # a content of both sides is read from history
    others = old_bodies.unionByName(new_bodies.join(paired, "text_key", "left_semi").join(old_first.select("text_key"), "text_key", "left_anti"))
    left = pairs.join(new_bodies.select(F.col("text_key").alias("a"), F.col("body").alias("text_a")), "a")
    near = cut_lineage(_verified(left.join(others.select(F.col("text_key").alias("b"), F.col("body").alias("text_b")), "b")))
    equal = same.select(F.col("b").alias("a"), "b")
    to_old = near.unionByName(equal).join(old_first.select(F.col("text_key").alias("b"), F.col("id").alias("other")), "b")
    to_old = to_old.groupBy(F.col("a").alias("text_key")).agg(F.min("other").alias("other"))
    among = near.join(same, "b", "left_semi").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).dropDuplicates(["a", "b"])
    return to_old, among


def _resolve(first: DataFrame, groups: DataFrame, among: DataFrame) -> DataFrame:
    """(id, duplicate_of) of all cases, in order of arrival (the order of ids).

    first: cases (id, duplicate_of) that repeat a record accepted before; groups: (key, id), new records of one key repeat
    each other; among: pairs (a, b) of keys whose records repeat each other. A group is led by its first record that is no case:
    once that is accepted, the others are cases, and while it is open nothing else can decide them, so a round needs only the
    leaders, never all pairs of a group. A leader that waits for no earlier one is accepted; the smallest always is, so every round settles some.
    """
    cases = cut_lineage(first)
    # checkpoints keep their data in the shared folder; only open groups are carried on
    groups = cut_lineage(groups.join(cases.select("id"), "id", "left_anti"))
    out = [cases]
    while True:
        free_driver(groups.sparkSession)
        # read three times below
        lead = cut_lineage(groups.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("n")))
        inside = groups.join(lead.where("n > 1").select("key", "lead"), "key").where("id <> lead").select("id", F.col("lead").alias("other"))
        ends = among.join(lead.select(F.col("key").alias("a"), F.col("lead").alias("x")), "a").join(lead.select(F.col("key").alias("b"), F.col("lead").alias("y")), "b")
        across = ends.where("x <> y").select(F.greatest("x", "y").alias("id"), F.least("x", "y").alias("other"))
        links = cut_lineage(inside.unionByName(across).dropDuplicates(["id", "other"]))
        if links.isEmpty():
            break
        accepted = links.select("other").dropDuplicates(["other"]).join(links.select(F.col("id").alias("other")).dropDuplicates(["other"]), "other", "left_anti")
        found = cut_lineage(links.join(accepted, "other", "left_semi").groupBy("id").agg(F.min("other").alias("duplicate_of")))
        out.append(found)
        groups = cut_lineage(groups.join(found.select("id"), "id", "left_anti"))
    rows = out[0]
    for part in out[1:]:
        rows = rows.unionByName(part)
    return rows


def _match(new: DataFrame, old_keys: DataFrame, own: DataFrame, old: DataFrame, old_texts: DataFrame, buckets: int) -> DataFrame:
    new_keys = cut_lineage(_plain_keys(new, None))
    to_old, among = _text_matches(own, old, new.select("id", "body"), old_texts, buckets)
    contents = own.where("size = 0").select("text_key", "id").dropDuplicates(["text_key", "id"])
    by_text = contents.join(to_old, "text_key").select("id", "other", F.lit(1).alias("rank"))
    first_old = old_keys.join(at_home(new_keys, buckets), "key", "left_semi").groupBy("key").agg(F.min("id").alias("other"))
    by_key = new_keys.join(first_old, "key").select("id", "other", F.lit(0).alias("rank"))
    first = by_key.unionByName(by_text).groupBy("id").agg(F.min(F.struct("rank", "other")).alias("__m")).select("id", F.col("__m.other").alias("duplicate_of"))
    # a content's key is told from the others by its own hash
    text_id = F.xxhash64(F.lit("t"), F.col("text_key"))
    groups = new_keys.select("key", "id").unionByName(contents.select(text_id.alias("key"), "id"))
    pairs = among.select(F.xxhash64(F.lit("t"), "a").alias("a"), F.xxhash64(F.lit("t"), "b").alias("b"))
    return _resolve(first, groups, cut_lineage(pairs))


class History:
    """Keys of all accepted records in bucketed tables, so that a batch never meets the full history again.

    `match` finds a batch's duplicates by joins on the bucketed keys; `append` adds the keys of what was accepted. The tables `keys` (addresses and
    hashes), `pieces` and, unless the texts are kept elsewhere, `texts` lie in the shared folder and are named by a prefix. The order of pieces is that of
    the first records appended and stays, as all keys have to be in one order. Records: (id, source_id, canonical_url, content_hash, body), each id once.
    """

    def __init__(self, spark: SparkSession, prefix: str, buckets: int = BUCKETS, keep_texts: bool = True):
        self.spark, self.prefix, self.buckets, self.keep_texts = spark, prefix, buckets, keep_texts
        self.folder = f"{ensure_checkpoint_dir(spark)}/{prefix}"

    def _write(self, df: DataFrame, name: str, by: str, tasks: int) -> None:
        # each task writes a file a bucket; many tasks are shuffled into the buckets first
        if tasks * self.buckets > MOST_FILES:
            df = df.repartition(self.buckets, by)
        writer = df.write.mode("append").format("parquet").option("path", f"{self.folder}/{name}").option("compression", "zstd")
        writer.bucketBy(self.buckets, by).sortBy(by).saveAsTable(f"{self.prefix}_{name}")

    def table(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.prefix}_{name}")

    def _order(self, records: DataFrame) -> np.ndarray:
        name = f"{self.prefix}_order"
        if not self.spark.catalog.tableExists(name):
            often = piece_order(records)
            rows = pa.table({"at": pa.array(range(_CHUNKS), pa.int32()), "often": pa.array([x.tobytes() for x in np.split(often, _CHUNKS)], pa.binary())})
            self.spark.createDataFrame(rows).write.format("parquet").option("path", f"{self.folder}/order").saveAsTable(name)
            return often
        # _CHUNKS rows of fixed size
        return np.frombuffer(b"".join(r["often"] for r in self.spark.table(name).orderBy("at").collect()), np.uint8)

    def append(self, records: DataFrame, aliases: DataFrame | None = None) -> None:
        tasks = records.rdd.getNumPartitions()
        # these come out of a shuffle of any width, and are few bytes each
        self._write(_plain_keys(records, aliases), "keys", "key", MOST_FILES)
        self._write(piece_rows(records, self._order(records)), "pieces", "key", tasks)
        if self.keep_texts:
            self._write(records.select("id", "body"), "texts", "id", tasks)

    def match(self, batch: DataFrame, texts: DataFrame | None = None) -> DataFrame:
        """(id, duplicate_of) for the records of the batch (columns as for append) that repeat an accepted record or an earlier accepted one of the batch.

        texts: (id, body) of the accepted records where this history doesn't keep them.
        """
        own = cut_lineage(piece_rows(batch, self._order(batch)))
        return _match(batch, self.table("keys"), own, self.table("pieces"), self.table("texts") if texts is None else texts.select("id", "body"), self.buckets)

    def drop(self) -> None:
        """Removes the tables and their files."""
        for name in ("keys", "pieces", "texts", "order"):
            self.spark.sql(f"drop table if exists {self.prefix}_{name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def duplicates(incoming: DataFrame, articles: DataFrame, aliases: DataFrame | None, buckets: int | None = None) -> DataFrame:
    """(incoming_id, duplicate_of) of each incoming record that repeats an accepted one, in order of incoming_id.

    The articles are appended once to a History of its own, and the incoming records matched as one batch, which gives the same rows as batch after batch
    with what was accepted appended in between. Where a record repeats several accepted ones, equal addresses and hashes go before similar contents, then
    the smallest id. Repeated rows of either table count once; records with a null id are left out; null or empty bodies, hashes and
    addresses give no key. Extra columns are ignored. Without a number of buckets it is that of the session's shuffle partitions, BUCKETS at most.
    """
    fields = ("source_id", "canonical_url", "content_hash", "body")
    new = incoming.where(F.col("incoming_id").isNotNull()).select(F.col("incoming_id").cast("string").alias("id"), *fields)
    old = articles.where(F.col("article_id").isNotNull()).select(F.col("article_id").cast("string").alias("id"), *fields)
    spark = incoming.sparkSession
    history = History(spark, f"history_{uuid.uuid4().hex[:12]}", buckets or min(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions"))), keep_texts=False)
    history.append(old, aliases)
    free_driver(spark)
    found = history.match(new, old).select(F.col("id").alias("incoming_id"), "duplicate_of")
    # the rows are kept by checkpoints, so the tables may go
    history.drop()
    return found
