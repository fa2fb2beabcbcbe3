"""SimHash near-dedup: tiled exact comparison of fingerprints with exclusive-or and bit counts.

*Fingerprint.* The 64-bit hashes (XXH64, seed 42) of a text's 3-word shingles, repeats included, are made in the JVM; a
bit of the fingerprint is set where it is set in over half of them.

*Tiles.* Only distinct fingerprints are compared. Their population counts, one for each of ``PARTS`` equal parts of the
64 bits, are a cell; fingerprints sorted by cell are cut into tiles of one cell and at most ``TILE`` members. Two
fingerprints that differ in r bits lie in cells whose counts differ by r in sum at most, so a tile meets the tiles of
its own cell and of those within the radius, and every other pair of tiles is skipped. What meets is compared whole,
with numpy, so no pair within the radius is missed. A cell of any size becomes more tiles, which are dealt over all
tasks; a tile pair sends no more links than join groups that its earlier links didn't.

*Components* are found over fingerprints, so a group of copies is one node.

Defined results: a text without words (null and empty ones too) has fingerprint zero and is linked like any other; one or
two words are one shingle. Rows without a doc_id are left out. Rows are texts of their own: of a doc_id with several
texts each has its fingerprint and component. ``component_id`` is the smallest doc_id of the component.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

SHINGLE, RADIUS = 3, 2
#: Parts whose population counts make a cell. Of random fingerprints, 3 pairs in 10,000 are then left to compare.
PARTS = 8
#: Fingerprints in a tile (8 bytes each), and pairs that are compared at a time.
TILE, PAIRS = 1 << 14, 1 << 20


def shingle_hashes(text: Column, k: int = SHINGLE) -> Column:
    """XXH64 of each ``k`` consecutive words joined by a space, A-Z lower-cased; fewer words are one shingle."""

    def of(words: Column) -> Column:
        joined = lambda w, i: F.xxhash64(F.concat_ws(" ", w, *[F.get(words, i + j) for j in range(1, k)]))
        firsts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (k - 1), F.least(F.size(words), F.lit(1))))
        return F.transform(firsts, joined)

    return C.let(C.words(C.ascii_lower(text)), of)


def majority(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each list of hashes, the bits set in over half of them; zero for an empty list."""
    n = np.diff(offsets)
    out, some = np.zeros(len(n), np.uint64), np.flatnonzero(n)
    if len(some):
        for bit in range(64):
            ones = np.add.reduceat(((h >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), offsets[some])
            out[some] |= (2 * ones > n[some]).astype(np.uint64) << np.uint64(bit)
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bits = pa.array(majority(*C.ragged(b.column("h"))).view(np.int64))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), bits], names=["doc_id", "bits"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, bits) of every row; ``bits`` is the fingerprint as a signed long."""
    C.small_batches(docs.sparkSession)
    return C.documents(docs).select("doc_id", shingle_hashes(F.col("text")).alias("h")).mapInArrow(_fingerprints, "doc_id long, bits long")


def cell(bits: Column, parts: int = PARTS) -> Column:
    """The parts' population counts, seven bits each, so that a step below 0 leads to no cell; at most 8 parts."""
    width = 64 // parts
    part = lambda p: F.shiftrightunsigned(bits, p * width).bitwiseAND((1 << width) - 1) if parts > 1 else bits
    count = lambda p: F.bit_count(part(p)).cast("long")
    return sum((F.shiftleft(count(p), 7 * p) for p in range(1, parts)), count(0))


def steps(radius: int = RADIUS, parts: int = PARTS) -> list[int]:
    """What leads from a cell to itself and, of each two cells within the radius, from one to the other: once a pair."""
    return sorted(d for v in _near(radius, parts) if (d := sum(x << (7 * p) for p, x in enumerate(v))) >= 0)


def _near(radius: int, parts: int) -> Iterator[list[int]]:
    """Vectors of whole numbers whose absolute values sum to the radius at most."""
    if parts == 0:
        yield []
        return
    for x in range(-radius, radius + 1):
        for rest in _near(radius - abs(x), parts - 1):
            yield [x, *rest]


def _tiles(size: int):
    """Of rows sorted by cell: (cell, number, members), each of one cell; numbers are unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, cells, members = TaskContext.get().partitionId() << 32, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in itertools.chain(batches, [None]):
            if b is not None:
                cells = np.concatenate([cells, b.column("cell").to_numpy()])
                members = np.concatenate([members, b.column("bits").to_numpy()])
            if not len(cells):
                continue
            first, run_ = C.runs(cells)
            starts = np.flatnonzero((np.arange(len(cells)) - first[run_]) % size == 0)
            ends = np.append(starts[1:], len(cells))
            if b is not None:  # the last tile may go on in the next batch
                starts, ends = starts[:-1], ends[:-1]
            if len(starts):
                blobs = pa.array([members[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(cells[starts]), pa.array(np.arange(number, number + len(starts))), blobs], names=["cell", "tile", "members"])
                number += len(starts)
                cells, members = cells[ends[-1] :], members[ends[-1] :]

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The members of all tiles of a batch, and each tile's number of members."""
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), np.uint64), np.array([len(x) // 8 for x in blobs], np.int64)


def close_pairs(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within the radius of the k-th tiles of ``a`` and ``b``, all tiles of a batch together, ``PAIRS`` at a time."""
    begin = np.cumsum(lb) - lb
    partners, at = np.repeat(lb, la), np.repeat(begin, la)  # for each member of ``a``
    done = np.cumsum(partners)
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + PAIRS, side="right")))
        left, right = np.repeat(a[lo:hi], partners[lo:hi]), b[C.gathered(at[lo:hi], partners[lo:hi])]
        close = np.bitwise_count(left ^ right) <= radius
        yield left[close], right[close]
        lo = hi


def joining(a: np.ndarray, b: np.ndarray, up: dict[int, int]) -> Iterator[tuple[int, int]]:
    """The links that join what no earlier one joined; ``up`` remembers."""

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        p, q = top(x), top(y)
        if p != q:
            up[p] = q
            yield x, y


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            up: dict[int, int] = {}
            for a, b in close_pairs(*_flat(batch.column("members")), *_flat(batch.column("others")), radius):
                other = a != b
                found = np.array(list(joining(a[other], b[other], up)), np.uint64).reshape(-1, 2).view(np.int64)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return run


def links(bits: DataFrame, radius: int = RADIUS, parts: int = PARTS, tile: int = TILE) -> DataFrame:
    """(a, b) that connect the distinct fingerprints of ``bits`` as all pairs within the radius would."""
    cells = bits.select("bits", cell(F.col("bits"), parts).alias("cell"))
    tiles = C.work_table(cells.repartitionByRange("cell", "bits").sortWithinPartitions("cell", "bits").mapInArrow(_tiles(tile), "cell long, tile long, members binary"), "tiles")
    sent = tiles.withColumn("step", F.explode(F.array(*[F.lit(s) for s in steps(radius, parts)])))
    sent = sent.select((F.col("cell") + F.col("step")).alias("cell"), "tile", "step", "members")
    met = sent.join(tiles.select("cell", F.col("tile").alias("other"), F.col("members").alias("others")), "cell")
    met = met.where((F.col("step") > 0) | (F.col("tile") <= F.col("other"))).select("members", "others")
    return met.mapInArrow(_links(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, parts: int = PARTS, tile: int = TILE) -> DataFrame:
    """(doc_id, bits, component_id) of every row."""
    rows = C.work_table(fingerprints(docs), "fingerprints")
    nodes = C.work_table(rows.groupBy("bits").agg(F.min("doc_id").alias("rep")), "nodes")
    groups = components(links(nodes, radius, parts, tile))
    named = nodes.join(groups.withColumnRenamed("node", "bits"), "bits", "left").withColumn("component", F.coalesce("component", "bits"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    return rows.join(named.join(least, "component").select("bits", "component_id"), "bits").select("doc_id", "bits", "component_id")


def op11_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    df = near_duplicates(C.table(spark, sf_dir, "documents"))
    return df.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
