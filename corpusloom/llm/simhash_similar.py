"""Near-duplicate groups by SimHash fingerprints, verified by the Jaccard similarity of word shingles.

Two texts are linked if their sets of ``size``-word shingles have a Jaccard similarity of ``similarity``
or more. Candidates come from two kinds of fingerprints of the same shingles:

* the SimHash of all shingles, matched within three bits by ball hashing (:mod:`simhash`);
* because at a similarity of 0.8 two 64-bit SimHashes differ in about nine bits, which no ball of a
  feasible radius covers, the SimHashes of ``TABLES`` consistent samples of the shingles (the four with
  the least hashes under each of ``TABLES`` permutations), matched at radius zero. A pair with
  similarity s agrees in one table with probability s**4, so at 0.8 it is missed with 0.59**TABLES.

Every candidate pair is verified on the whole shingle sets. Copies collapse before all that by a 128-bit
hash of the text, and buckets that have the same members count once. The pairs of a bucket of up to
``SMALL`` members are rows, which meet across tables. A larger bucket is dealt into blocks of bounded size;
a task has the sets of two blocks and tests all their pairs at once. Of a bucket with more than one block the
first block meets all others; only if these pairs leave the bucket unconnected, the other blocks meet too. So each
pair that shares a bucket is tested, unless it is connected without.

Defined results: texts without a word are copies of one another; rows with a null doc_id take no part and
always stay; rows that share a doc_id are one document; ties need no rule, groups are named by their
smallest doc_id, and that document is the one that stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._text import fresh, held, released, slices, stored
from corpusloom.llm.components import components
from corpusloom.llm.simhash import RADIUS, fingerprint, linked, shingle_digests

SHINGLE = 5
SIMILARITY = 0.8
TABLES = 20
#: Ids of 8 bytes.
MOST_BROADCAST = 1_000_000
#: Members of a bucket whose pairs are rows; members and shingles of a block.
SMALL = 16
BLOCK = 256
BLOCK_SHINGLES = 1 << 20
_ODD = np.random.default_rng(42).integers(1 << 62, size=TABLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _stored(df: DataFrame, name: str) -> DataFrame:
    """The table, and the driver's memory given back: the plans before it are many and none is needed again."""
    table = stored(df, name)
    released(df.sparkSession)
    return table


def sample_fingerprints(digests: np.ndarray) -> np.ndarray:
    """One SimHash per table, of the four shingles that come first in its order; a bit needs three of the four."""
    own = np.unique(digests)
    if not len(own):
        return np.zeros(TABLES, np.uint64)
    mixed = own[None, :] * _ODD[:, None]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    if len(own) > 4:
        at = np.argpartition(mixed, 3, axis=1)[:, :4]
        order = np.take_along_axis(at, np.argsort(np.take_along_axis(mixed, at, 1), axis=1), 1)
    else:
        order = np.resize(np.argsort(mixed, axis=1), (TABLES, len(own)))[:, np.arange(4) % len(own)]
    a, b, c, d = own[order].T
    return (a & b & c) | (a & b & d) | (a & c & d) | (b & c & d)


def sketches(docs: DataFrame, size: int = SHINGLE, text: str = "text") -> DataFrame:
    """doc_id, content (128-bit hash of the text), n (distinct shingles), fp and subs (array of sample fingerprints)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("sketches")
        for b in slices(batches):
            content, n, fp, subs = [], [], [], []
            for t in b.column("_text").to_pylist():
                digests = shingle_digests(t, size)
                content.append(xxhash.xxh3_128_digest((t or "").encode("utf-8", "surrogatepass")) if len(digests) else b"")
                n.append(len(np.unique(digests >> np.uint64(32))))
                fp.append(fingerprint(digests))
                subs.append(sample_fingerprints(digests))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(fp) + 1, dtype=np.int32) * TABLES), pa.array(np.concatenate([np.empty(0, np.uint64), *subs]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(content, pa.binary()), pa.array(n, pa.int64()), pa.array(np.array(fp, np.uint64).view(np.int64)), lists], ["doc_id", "content", "n", "fp", "subs"])

    chosen = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("_text"))
    return chosen.mapInArrow(run, "doc_id bigint, content binary, n bigint, fp bigint, subs array<bigint>")


def _shingle_sets(rows: DataFrame, size: int) -> DataFrame:
    """id and set (sorted 32-bit hashes of the distinct shingles) of rows (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("sets")
        for b in slices(batches):
            sets = [np.unique(shingle_digests(t, size) >> np.uint64(32)).astype("<u4").tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sets, pa.binary())], ["id", "set"])

    return rows.mapInArrow(run, "id bigint, set binary")


def jaccard(a: bytes, b: bytes) -> float:
    """Similarity of two sorted sets of 32-bit numbers; two empty sets are equal."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = np.sort(np.concatenate([x, y]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def _few(ids: DataFrame) -> DataFrame:
    """Stored ids, to be broadcast while they are counted to be few; beyond that the join shuffles the texts."""
    return F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids


def member_sets(crowd: DataFrame, docs: DataFrame, size: int, text: str = "text") -> DataFrame:
    """id and set, stored, of every document of ``crowd`` (doc_id)."""
    ids = _few(_stored(crowd.select(F.col("doc_id").alias("_id")).distinct(), "member-ids"))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col(text).alias("text")).join(ids, F.col("id") == F.col("_id"), "left_semi")
    # Rows that share a doc_id would multiply the pairs.
    return _stored(_shingle_sets(rows, size).groupBy("id").agg(F.max("set").alias("set")), "shingle-sets")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of doc_ids whose texts are similar."""
    of_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    both = of_a.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("pairs")
        for t in slices(batches, 1024):
            near = [jaccard(x, y) >= similarity for x, y in zip(t.column("sa").to_pylist(), t.column("sb").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def buckets(reps: DataFrame) -> DataFrame:
    """t, s, doc_id and n: the members of every bucket (t, s) of ``reps`` (doc_id, n, fp, subs).

    Table ``TABLES`` is that of the balls: its buckets are the classes of :func:`linked` by their smallest
    fingerprint, so any two documents within ``RADIUS`` share one.
    """
    own = reps.select("doc_id", "n", "fp")
    sampled = reps.select(F.posexplode("subs").alias("t", "s"), "doc_id", "n")
    distinct = own.select("fp").distinct()
    classes = _stored(linked(distinct), "balls").select(F.col("a").alias("fp"), F.col("b").alias("s"))
    balls = own.join(classes.union(distinct.select("fp", F.col("fp").alias("s"))), "fp")
    return sampled.union(balls.select(F.lit(TABLES).alias("t"), "s", "doc_id", "n"))


def crowds(members: DataFrame) -> DataFrame:
    """The rows of ``members`` in buckets of two or more, one bucket for each set of members, with m (members) and blocks."""
    own = F.xxhash64("doc_id", F.lit(5)).cast("decimal(38,0)"), F.xxhash64("doc_id", F.lit(6)).cast("decimal(38,0)")
    sizes = members.groupBy("t", "s").agg(F.count("*").alias("m"), F.sum("n").alias("size"), F.sum(own[0]).alias("h1"), F.sum(own[1]).alias("h2")).where("m > 1")
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("size") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    one = sizes.groupBy("m", "size", "h1", "h2").agg(F.min(F.struct("t", "s")).alias("b")).select("b.t", "b.s", "m", blocks)
    return members.join(one, ["t", "s"]).select("t", "s", "doc_id", "n", "m", "blocks")


def small_pairs(crowd: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b), a > b, of the members of small buckets, but those whose sizes rule the similarity out."""
    y = crowd.where(f"m <= {SMALL}").select("t", "s", "doc_id", "n")
    x = y.select("t", "s", F.col("doc_id").alias("a"), F.col("n").alias("an"))
    sized = F.least("n", "an") / F.greatest("n", "an") >= similarity
    return x.join(y, ["t", "s"]).where((F.col("a") > F.col("doc_id")) & sized).select("a", F.col("doc_id").alias("b")).distinct()


def similar_in_block(sets: list[bytes], left: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of places that connect what similar pairs of a ``left`` and another set connect."""
    tokens = [np.frombuffer(x, "<u4") for x in sets]
    size = np.array([len(x) for x in tokens], np.int64)
    _, at = np.unique(np.concatenate([np.empty(0, "<u4"), *tokens]), return_inverse=True)
    ends = np.concatenate([[0], np.cumsum(size)])
    mark, label, edges = np.zeros(int(at.max(initial=-1)) + 1, np.int64), np.arange(len(sets)), []
    for i in np.flatnonzero(left & (size > 0)).tolist():
        own = at[ends[i] : ends[i + 1]]
        mark[own] = 1
        common = np.diff(np.concatenate([[0], np.cumsum(mark[at])])[ends])
        mark[own] = 0
        near = np.flatnonzero(common / (size[i] + size - common) >= similarity)
        for root in np.unique(label[near]).tolist():
            if root != label[i]:
                edges.append((i, int(near[label[near] == root][0])))
                label[label == root] = label[i]
    return edges


def block_edges(blocks: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """t, s and edges (a, b) from rows (t, s, i, j, is_left, doc_id): the members of the blocks i and j of a bucket.

    Those of a task are one less than its members if they connect them, else fewer.
    """

    def run(table: pa.Table) -> pa.Table:
        held("blocks")
        ids = table.column("doc_id").to_numpy()
        found = similar_in_block(table.column("set").to_pylist(), table.column("is_left").to_numpy(), similarity)
        a, b = (ids[[e[k] for e in found]] if found else np.empty(0, np.int64) for k in (0, 1))
        bucket = [pa.array([table.column(c)[0].as_py()] * len(a), kind) for c, kind in (("t", pa.int32()), ("s", pa.int64()))]
        return pa.table([*bucket, pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["t", "s", "a", "b"])

    rows = blocks.join(sets, F.col("doc_id") == F.col("id")).select("t", "s", "i", "j", "is_left", "doc_id", "set")
    return rows.groupBy("t", "s", "i", "j").applyInArrow(run, "t int, s bigint, a bigint, b bigint")


def _dealt(crowd: DataFrame) -> DataFrame:
    return crowd.where(f"m > {SMALL}").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.col("blocks")).cast("int"))


def first_blocks(crowd: DataFrame) -> DataFrame:
    """Rows for :func:`block_edges`: the first block of every large bucket with itself and each other."""
    dealt = _dealt(crowd)
    lead = dealt.where("block = 0").select("t", "s", F.lit(0).alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(True).alias("is_left"), "doc_id")
    rest = dealt.where("block > 0").select("t", "s", F.lit(0).alias("i"), F.col("block").alias("j"), F.lit(False).alias("is_left"), "doc_id")
    return lead.union(rest)


def other_blocks(crowd: DataFrame, found: DataFrame) -> DataFrame:
    """Rows for :func:`block_edges`: the other blocks with one another, where those ``found`` with the first do not connect a bucket."""
    dealt = _dealt(crowd.where("blocks > 1"))
    # The first block is in every task.
    needed = dealt.groupBy("t", "s").agg((F.count("*") + F.sum((F.col("block") == 0).cast("int")) * (F.first("blocks") - 1) - F.first("blocks")).alias("needed"))
    edges = found.groupBy("t", "s").agg(F.count("*").alias("edges"))
    apart = needed.join(edges, ["t", "s"], "left").where("coalesce(edges, 0) < needed")
    live = dealt.join(apart.select("t", "s"), ["t", "s"]).where("block > 0")
    i, j = F.least("block", "other"), F.greatest("block", "other")
    met = live.withColumn("other", F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)))
    return met.select("t", "s", i.alias("i"), j.alias("j"), (F.col("block") == i).alias("is_left"), "doc_id")


def connected(reps: DataFrame, docs: DataFrame, size: int, similarity: float, text: str = "text") -> DataFrame:
    """node and root of the components of all similar pairs that share a bucket."""
    crowd = _stored(crowds(buckets(reps)), "buckets")
    sets = member_sets(crowd, docs, size, text)
    edges = verified(small_pairs(crowd, similarity), sets, similarity)
    if crowd.where(f"m > {SMALL}").limit(1).count():
        found = _stored(block_edges(first_blocks(crowd), sets, similarity), "first-blocks")
        edges = edges.union(found.select("a", "b")).union(block_edges(other_blocks(crowd, found), sets, similarity).select("a", "b"))
    return components(edges)


def groups(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, text: str = "text") -> DataFrame:
    """doc_id and group_id (smallest doc_id of the group) of every document with a doc_id."""
    marked = _stored(sketches(docs, size, text), "sketches")
    first = marked.groupBy("content").agg(F.min(F.struct("doc_id", "n", "fp", "subs")).alias("r"))
    reps = _stored(first.select("content", "r.*"), "representatives")
    roots = connected(reps, docs, size, similarity, text)
    of_rep = reps.join(roots, F.col("doc_id") == F.col("node"), "left").select("content", F.coalesce("root", "doc_id").alias("group_id"))
    return marked.join(of_rep, "content").groupBy("doc_id").agg(F.min("group_id").alias("group_id"))


def keep_one(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, text: str = "text") -> DataFrame:
    """``docs`` without the documents that are in a group but not its smallest doc_id."""
    own = fresh(docs, "_id")
    gone = _stored(groups(docs, size, similarity, text).where("doc_id <> group_id").select(F.col("doc_id").alias(own)), "gone-ids")
    return docs.join(_few(gone), docs["doc_id"] == F.col(own), "left_anti")
