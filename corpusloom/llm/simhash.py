"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints that differ in three bits at most must be linked. Half that radius is one, and two balls
of radius one meet only at distance two, so the odd bit is taken by a dropped block: the 64 bits are
cut into three blocks, of three differing bits one lies in the dropped block for some choice of it, and
on the other bits two balls of radius one meet. Every distinct fingerprint so emits 131 keys, whatever
the data; keys are shuffled, and within a key the fingerprints are verified by their real distance.

Equal fingerprints meet before that, in a count per fingerprint. Within one key all fingerprints that
agree on the dropped block are within two bits of each other, so they are linked in a row; the values
of the dropped block (2**22 at most) are then linked by looking up their neighbours, never pair by pair.

Defined results: texts without a word have fingerprint zero and are linked like any other; null texts
likewise; a null doc_id is an ordinary row, and never the smallest id of a group that has another.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._text import held, slices, stored
from corpusloom.llm.components import components

SEED = 42
RADIUS = 3
#: (lowest bit, bits) of the blocks of which one is dropped.
BLOCKS = ((0, 22), (22, 21), (43, 21))

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def shingle_digests(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every ``size``-word shingle, repeats included, as uint64; fewer words give one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(size, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in spans]), ">u8").astype(np.uint64)


def fingerprint(digests: np.ndarray) -> int:
    """The 64-bit SimHash: a bit is set if it is set in over half of the digests."""
    if not len(digests):
        return 0
    octets = digests.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.bincount((octets + np.arange(0, 2048, 256, dtype=np.int64)).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits(2 * counts.ravel() > len(digests), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3, text: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed bigint) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("simhash")
        for b in slices(batches):
            fp = np.array([fingerprint(shingle_digests(t, size)) for t in b.column("_text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("_text")).mapInArrow(run, "doc_id bigint, fp bigint")


def ball_keys(fp: np.ndarray, part: int) -> np.ndarray:
    """Rows of keys, one row per fingerprint: the bits outside block ``part``, and each variant with one bit flipped."""
    low, bits = BLOCKS[part]
    rest = (fp & np.uint64((1 << low) - 1)) | ((fp >> np.uint64(low + bits)) << np.uint64(low))
    flips = np.array([0, *(1 << k for k in range(64 - bits))], np.uint64)
    return (rest[:, None] ^ flips[None, :]) | np.uint64(part << 44)


def emit(distinct: DataFrame) -> DataFrame:
    """key and fp for every variant of every row of ``distinct`` (fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for part in range(len(BLOCKS)):
                keys = ball_keys(fps, part)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(fps, keys.shape[1]).view(np.int64))], ["key", "fp"])

    return distinct.select("fp").mapInArrow(run, "key bigint, fp bigint")


@lru_cache
def _masks(bits: int) -> tuple[tuple[int, int], ...]:
    return tuple((n, sum(1 << k for k in c)) for n in range(1, RADIUS + 1) for c in combinations(range(bits), n))


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        np.minimum.at(parent, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        parent = _roots(parent)


def link_key(key: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fp, smallest fp of its class) among the distinct sorted ``fps`` under one key; classes join all that lie within RADIUS."""
    n = len(fps)
    if n <= 256:
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= RADIUS
        label = np.arange(n)
        while True:
            least = np.where(near, label[None, :], n).min(1)
            if (least == label).all():
                break
            label = least
        far = label != np.arange(n)
        return fps[far], fps[label[far]]
    part = key >> 44
    low, bits = BLOCKS[part]
    value = ((fps >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64)
    rest = (fps & np.uint64((1 << low) - 1)) | ((fps >> np.uint64(low + bits)) << np.uint64(low))
    off = rest ^ np.uint64(key & ((1 << 44) - 1))  # zero or the one bit that this fingerprint flipped
    values, at = np.unique(value, return_inverse=True)
    flipped = np.zeros(len(values), np.uint64)  # bit 0: unflipped; bit k + 1: bit k flipped
    np.bitwise_or.at(flipped, at, np.where(off == 0, np.uint64(1), off << np.uint64(1)))
    whole = (flipped & np.uint64(1)) != 0
    place = np.full(1 << bits, -1, np.int32)
    place[values] = np.arange(len(values))
    parent = np.arange(len(values))
    for apart, mask in _masks(bits):
        other = place[values ^ mask]
        a = np.flatnonzero(other > np.arange(len(values)))
        b = other[a]
        if apart == 2:  # the flips may differ in one bit
            ok = ((flipped[a] & flipped[b]) != 0) | whole[a] | whole[b]
        elif apart == 3:  # the flips must be equal
            ok = (flipped[a] & flipped[b]) != 0
        else:
            ok = np.ones(len(a), bool)
        parent = _unite(parent, a[ok], b[ok])
    root = parent[at]
    first = np.full(len(values), n)
    np.minimum.at(first, root, np.arange(n))
    head = fps[first[root]]
    far = head != fps
    return fps[far], head[far]


def link_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) from rows (key, fp) that come sorted by key. Only the keys at the edge of a batch are carried over."""
    names = ["a", "b"]

    def edges(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch | None:
        cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        size = np.diff(cut)
        heads = cut[:-1]
        out_a, out_b = [], []
        two = heads[size == 2]
        if len(two):
            x, y = fps[two], fps[two + 1]
            near = np.bitwise_count(x ^ y) <= RADIUS
            out_a.append(np.maximum(x, y)[near])
            out_b.append(np.minimum(x, y)[near])
        for h, n in zip(heads[size > 2], size[size > 2], strict=True):
            a, b = link_key(int(keys[h]), np.unique(fps[h : h + n]))
            out_a.append(a)
            out_b.append(b)
        if not out_a or not sum(map(len, out_a)):
            return None
        pairs = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, k].copy().view(np.int64)) for k in (0, 1)], names)

    held_k: list[np.ndarray] = []
    held_f: list[np.ndarray] = []
    for b in batches:
        k, f = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "fp"))
        if not len(k):
            continue
        if held_k and held_k[0][0] == k[-1]:  # one key fills the batch
            held_k.append(k)
            held_f.append(f)
            continue
        k, f = np.concatenate([*held_k, k]), np.concatenate([*held_f, f])
        last = int(np.searchsorted(k, k[-1]))
        held_k, held_f = [k[last:]], [f[last:]]
        if last and (out := edges(k[:last], f[:last].view(np.uint64))) is not None:
            yield out
    if held_k and (out := edges(np.concatenate(held_k), np.concatenate(held_f).view(np.uint64))) is not None:
        yield out


def linked(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between fingerprints of ``distinct`` (fp, no repeats); they connect all that lie within RADIUS."""
    return emit(distinct).repartition("key").sortWithinPartitions("key").mapInArrow(link_sorted, "a bigint, b bigint").distinct()


def groups(docs: DataFrame, size: int = 3, text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    component_id is the smallest doc_id that links reach, the row's own included.
    """
    marked = stored(fingerprints(docs, size, text), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    # The edges order fingerprints as signed numbers, like the components.
    roots = components(linked(distinct)).select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(smallest, "root").select("fp", "component_id")
    found = marked.join(of_fp, "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
