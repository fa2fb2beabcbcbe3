"""MinHash near-dedup with fast similarity sketching, banding and exact verification.

*Sketch.* A document's set of 5-word shingles fills ``COORDS`` bins. In round r every shingle is thrown into one
hashed bin with the value (r, hash) and a bin keeps its least value; from round ``COORDS`` on all shingles go to
bin r - COORDS, so after 2 * COORDS rounds every bin is full, and most documents stop after a few. A bin of two
sketches agrees with the sets' Jaccard similarity, with concentration as of independent bins.

*Banding.* ``BANDS`` bands of ``ROWS`` bins: two sets of similarity 0.85 miss all bands with probability
(1 - 0.85^6)^32, 3e-7; documents that share a band meet in its bucket.

*Exact verification without all pairs.* Documents with equal sets are one class, and only its smallest document
goes on. First each bucket's smallest document meets the others: at most a pair a member, which connects groups of
near copies. Then only members of different components can still add anything. Buckets where such are left are
compared in blocks inside tasks, of about ``BLOCK`` members or ``BLOCK_SHINGLES`` shingles at most: 16-bit sketches
rule out pairs more than ``SIGMAS`` standard deviations below the threshold, and what is left is verified there on the
full sets. Of the links found, a task sends those that join two components which none before them joined, so it sends
no more rows than it has members. No pair of two components that share a bucket is passed over, and no task holds
more than two blocks.

Defined results: null or empty texts, and texts without words, have an empty set, link with nothing and are
kept; fewer than five words are one shingle; ties go to the smallest doc_id. Rows are texts of their own: where a
doc_id has several, each has its links, its component and its verdict; ``one_of_each`` drops a row by doc_id and text,
so both of two equal rows of the smallest doc_id stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

SHINGLE = 5
BANDS, ROWS = 32, 6
COORDS = BANDS * ROWS
#: Members of a bucket that are compared at a time, and how far below the threshold a sketch may lie.
BLOCK, BLOCK_SHINGLES, SIGMAS = 512, 2_000_000, 6
#: Ids that may be broadcast, some 60 bytes each, so 15 MB; more are joined by a shuffle, to the same result.
BROADCAST_IDS = 250_000
_PROFILE = "doc_id long, text_hash long, n_shingles long, digest binary, bands array<long>, sketch binary"


def shingle_sets(h: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Each document's sorted distinct shingle hashes, flat, and their offsets."""
    n_docs, length = len(offsets) - 1, np.diff(offsets)
    at = np.flatnonzero(C.starts(offsets, k, len(h)))
    value = C.grams(h, k)[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((length > 0) & (length < k))
    whole = np.zeros(len(short), np.uint64)
    for j in range(k - 1):  # fewer words: the whole sequence, told from longer ones by its length
        has = length[short] > j
        whole[has] = whole[has] * C.POLY + h[offsets[short][has] + j]
    value = np.concatenate([value, C.mix(whole + length[short].astype(np.uint64))])
    size = np.where(length >= k, length - k + 1, length > 0)
    first = np.concatenate([[0], np.cumsum(np.where(length >= k, size, 0))])
    alone = dict(zip(short.tolist(), range(len(at), len(value))))
    sets = [np.unique(value[alone[d] : alone[d] + 1] if d in alone else value[first[d] : first[d + 1]]) for d in range(n_docs)]
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.concatenate([[0], np.cumsum([len(x) for x in sets], dtype=np.int64)])


def sketches(value: np.ndarray, offsets: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """A row of ``coords`` filled bins for each document; all ones for an empty set."""
    n_docs = len(offsets) - 1
    bins = np.full(n_docs * coords, np.iinfo(np.uint64).max, np.uint64)
    doc = np.repeat(np.arange(n_docs), np.diff(offsets))
    for r in range(2 * coords):  # under 512, so 9 bits hold it
        if not len(value):
            break
        x = C.mix(value + C.mix(np.array([r + 1], np.uint64) * C.POLY))
        to = (x % np.uint64(coords)).astype(np.int64) if r < coords else r - coords
        np.minimum.at(bins, doc * coords + to, (np.uint64(r) << np.uint64(55)) | (x >> np.uint64(9)))
        full = (bins.reshape(n_docs, coords) != np.iinfo(np.uint64).max).all(1)
        go = ~full[doc]
        value, doc = value[go], doc[go]
    return bins.reshape(n_docs, coords)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        value, offsets = shingle_sets(*C.ragged(b.column("h")))
        n = len(offsets) - 1
        bins = sketches(value, offsets)
        parts = bins.reshape(n, BANDS, ROWS)
        keys = np.zeros((n, BANDS), np.uint64)
        for j in range(ROWS):
            keys = C.mix(keys * C.POLY + parts[:, :, j])
        keys = C.mix(keys + np.arange(1, BANDS + 1, dtype=np.uint64) * C.POLY)
        bands = pa.ListArray.from_arrays(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32), pa.array(keys.reshape(-1).view(np.int64)))
        sketch = pa.array([x.tobytes() for x in bins.astype(np.uint16)], pa.binary())
        arrays = [b.column("doc_id"), b.column("text_hash"), pa.array(np.diff(offsets)), _digests(value, offsets), bands, sketch]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_hash", "n_shingles", "digest", "bands", "sketch"])


def _digests(value: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.array([hashlib.blake2b(value[a:z].tobytes(), digest_size=16).digest() for a, z in zip(offsets[:-1], offsets[1:])], pa.binary())


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        value, offsets = shingle_sets(*C.ragged(b.column("h")))
        yield pa.RecordBatch.from_arrays([_digests(value, offsets), pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(value.view(np.int64)))], names=["digest", "set"])


def _verified(share: int):
    """Of the pairs, those with 100 * intersection >= share * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (av, ao), (bv, bo) = (C.ragged(b.column(c)) for c in ("sa", "sb"))
            rows = np.arange(len(ao) - 1)
            both = np.concatenate([av, bv])
            pair = np.concatenate([np.repeat(rows, np.diff(ao)), np.repeat(rows, np.diff(bo))])
            order = np.lexsort((both, pair))
            both, pair = both[order], pair[order]
            inter = np.bincount(pair[1:][(both[1:] == both[:-1]) & (pair[1:] == pair[:-1])], minlength=len(rows))
            union = np.diff(ao) + np.diff(bo) - inter
            yield b.select(["a", "b"]).filter(pa.array((100 * inter >= share * union) & (union > 0)))

    return run


def _close(n, node, component, block, sketch, cross: bool, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of pairs of different components whose sketches don't rule out a link; with ``cross`` only of different blocks."""
    p = share / 100
    least = COORDS * p - SIGMAS * np.sqrt(COORDS * p * (1 - p))
    a, b = [], []
    for s in range(0, len(node), 64):
        e = min(s + 64, len(node))
        near = (sketch[s:e, None] == sketch[None]).sum(2) >= least
        near &= (component[s:e, None] != component[None]) & (node[s:e, None] < node[None])
        near &= 100 * np.minimum(n[s:e, None], n[None]) >= share * np.maximum(n[s:e, None], n[None])
        if cross:
            near &= block[s:e, None] != block[None]
        i, j = np.nonzero(near)
        a.append(s + i)
        b.append(j)
    return np.concatenate(a), np.concatenate(b)


def _true_links(a: np.ndarray, b: np.ndarray, value: np.ndarray, offsets: np.ndarray, share: int) -> np.ndarray:
    """Which of the pairs (a, b; sorted by a) of sets, given flat, have 100 * intersection >= share * union."""
    _, value = np.unique(value, return_inverse=True)
    size, ok = np.diff(offsets), np.zeros(len(a), bool)
    mark = np.zeros(int(value.max(initial=0)) + 1, bool)
    first, _ = C.runs(a)
    for s, e in zip(first.tolist(), [*first[1:].tolist(), len(a)]):
        own, others = value[offsets[a[s]] : offsets[a[s] + 1]], b[s:e]
        mark[own] = True
        inter = np.add.reduceat(mark[value[C.gathered(offsets[others], size[others])]], np.cumsum(size[others]) - size[others], dtype=np.int64)
        mark[own] = False
        ok[s:e] = 100 * inter >= share * (len(own) + size[others] - inter)
    return ok


def _joining(links: list[tuple[int, int]]) -> list[bool]:
    """Which of the links between components join two that no link before joined."""
    up: dict[int, int] = {}

    def top(c: int) -> int:
        while up.get(c, c) != c:
            up[c] = up.get(up[c], up[c])
            c = up[c]
        return c

    out = []
    for a, b in links:
        a, b = top(a), top(b)
        out.append(a != b)
        up[max(a, b)] = min(a, b)
    return out


def _block_links(share: int):
    """Rows sorted by (band, i, j): the links between the members of blocks i and j of each bucket."""

    def compared(rows: pa.Table) -> pa.RecordBatch:
        node, n, component, block, i, j = (rows.column(c).to_numpy() for c in ("node", "n", "component", "block", "i", "j"))
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint16).reshape(len(node), COORDS)
        a, b = _close(n, node, component, block, sketch, i[0] != j[0], share)
        value, offsets = C.ragged(rows.column("set"))
        true = _true_links(a, b, value, offsets, share)
        a, b = a[true], b[true]
        new = np.array(_joining(list(zip(component[a].tolist(), component[b].tolist()))), bool)
        return pa.RecordBatch.from_arrays([pa.array(node[x[new]], pa.int64()) for x in (a, b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in ("band", "i", "j")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for s, e in zip(cuts[:-1], cuts[1:]):
                key = tuple(keys[s]) if e > s else last
                if held and key != last:
                    yield compared(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(s, e - s))
                last = key
        if held and sum(x.num_rows for x in held):
            yield compared(pa.Table.from_batches(held))

    return run


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, component) after joining the components that ``links`` (a, b) connect."""
    a, b = labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    merged = components(links.join(a, "a").join(b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    merged = merged.select(F.col("node").alias("component"), F.col("component").alias("new"))
    return C.saved(labels.join(merged, "component", "left").select("node", F.coalesce("new", "component").alias("component")))


def near_duplicates(docs: DataFrame, share: int = 85, more_columns: Sequence[str] = ()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): components of documents with 100 * inter >= share * union; on demand
    also ``text_hash``."""
    C.small_batches(docs.sparkSession)
    hashed = C.documents(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), C.word_hashes(C.ascii_lower(F.col("text"))).alias("h"))
    profiles = C.work_table(hashed.mapInArrow(_profiles, _PROFILE), "profiles")
    # a class of equal sets is a node, numbered by its digest, so texts that share a doc_id are nodes of their own
    classes = profiles.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep")).withColumn("node", F.xxhash64("digest"))
    heads = profiles.join(classes.select(F.col("rep").alias("doc_id"), "digest", "node"), ["doc_id", "digest"]).dropDuplicates(["node"])
    banded = heads.select(F.explode("bands").alias("band"), "node", F.col("n_shingles").alias("n"))
    buckets = banded.groupBy("band").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"), F.min("node").alias("hub")).where("size > 1")
    members = C.work_table(banded.join(buckets, "band"), "members")
    nodes = members.select("node").distinct()
    labels = C.saved(nodes.select("node", F.col("node").alias("component")))
    within = labels.join(classes, "node").select(F.col("rep").alias("doc_id")).distinct()
    within = F.broadcast(within) if labels.count() <= BROADCAST_IDS else within
    sets = hashed.join(within, "doc_id", "left_semi").mapInArrow(_sets, "digest binary, set array<long>").withColumn("node", F.xxhash64("digest"))
    sets = C.work_table(sets.select("node", "set").dropDuplicates(["node"]), "sets")
    side = lambda x: sets.select(F.col("node").alias(x), F.col("set").alias(f"s{x}"))

    stars = C.saved(members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    both = stars.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sa", "sb")
    labels = _relabelled(labels, C.work_table(both.mapInArrow(_verified(share), "a long, b long"), "stars"))

    more = members.where("size > 2").join(labels, "node")
    spread = more.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band")
    more = more.join(spread, "band").join(heads.select("node", "sketch"), "node").join(sets, "node")
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    dealt = more.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "component", "sketch", "set")
    dealt = dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "node")
    labels = _relabelled(labels, C.work_table(dealt.mapInArrow(_block_links(share), "a long, b long"), "rest"))

    own = classes.join(labels, "node", "left").select("digest", "rep", F.coalesce("component", "node").alias("component"))
    least = own.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = own.join(least, "component").select("digest", "component_id")
    return (
        profiles.join(named, "digest", "left")
        .select("doc_id", *more_columns, "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )


def one_of_each(docs: DataFrame, share: int = 85) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component; rows without a doc_id stay."""
    names, own = docs.columns, C.unused("own", docs.columns)
    gone = C.saved(near_duplicates(docs, share, ["text_hash"]).where("NOT kept").select("doc_id", F.col("text_hash").alias(own)).distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.withColumn(own, F.xxhash64(F.coalesce("text", F.lit("")))).join(gone, ["doc_id", own], "left_anti").select(*names)


def op6_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents"))
