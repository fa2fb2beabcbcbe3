"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matching.

Tokens are maximal runs of ASCII letters, digits and non-ASCII characters, with A-Z lower-cased.

1. *Seeds.* Documents probe the sorted fingerprints of every ``MIN_MATCH`` tokens of the benchmark's items, each
   fingerprint once a document; a document and an item that share seeds are a candidate pair. Items come in blocks of
   at most ``BLOCK_TOKENS`` tokens, which pass the driver one at a time and are broadcast, so what a task holds is
   bounded by the blocks; a benchmark of B blocks probes every document B times.
2. *Tiling.* Rounds of Karp-Rabin search: fingerprints of s tokens that neither text has marked yet find matches,
   tokens are compared under each hit, and the longest is marked first; then s is halved, down to ``MIN_MATCH``. A
   match of over 2 s starts the round again with its length, so a text that repeats one word costs no more than its
   length a round. Tiles may stand in any order, so reordered passages count in full.
3. *Threshold.* Tiled tokens over the item's tokens is its coverage; a document is contaminated where one item's
   coverage is at least ``share``. Pairs whose seeds together cover less can't reach it and aren't tiled.

Defined results: null or empty texts match nothing, nor do items of under ``MIN_MATCH`` tokens or without an
item_id; items are listed by id; rows with a null doc_id are left out; every other row of documents has a row of its
own, also where a doc_id repeats with the same text or another.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

MIN_MATCH = 5
#: Tokens of the first round's matches.
FIRST_SEARCH = 64
SHARE = 0.5
#: Benchmark tokens of a block: 8 MB of hashes, as much of fingerprints and of their places.
BLOCK_TOKENS = 1_000_000
NO_TOKEN = r"[\x00-/:-@\[-`{-\x7F]+"


def tokens(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(C.ascii_lower(text), NO_TOKEN), ""), lambda w: F.xxhash64(w))


class Block:
    """Some items' tokens, and their seeds sorted by fingerprint."""

    def __init__(self, items: list[tuple[int, list[int]]]):
        self.ids = np.array([i for i, _ in items], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum([len(h) for _, h in items], dtype=np.int64)])
        self.h = np.array([x for _, h in items for x in h], np.int64).view(np.uint64)
        at = np.flatnonzero(C.starts(self.offsets, MIN_MATCH, len(self.h)))
        prints = C.grams(self.h, MIN_MATCH)[at] if len(at) else np.zeros(0, np.uint64)
        order = np.argsort(prints, kind="stable")
        self.prints, self.place = prints[order], at[order]
        self.item = np.searchsorted(self.offsets, self.place, side="right") - 1

    def seeds(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``prints`` and, for each, a seed that it hits."""
        if not len(self.prints):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lo = np.searchsorted(self.prints, prints, "left")
        at = np.flatnonzero(self.prints[np.minimum(lo, len(self.prints) - 1)] == prints)
        n = np.searchsorted(self.prints, prints[at], "right") - lo[at]
        return np.repeat(at, n), C.gathered(lo[at], n)


def _equal(doc: np.ndarray, item: np.ndarray, free_d: np.ndarray, free_i: np.ndarray, d: int, i: int) -> int:
    """How many tokens from d and i on are equal and free in both."""
    n, step = 0, 32
    while True:
        m = min(step, len(doc) - d - n, len(item) - i - n)
        a, b = slice(d + n, d + n + m), slice(i + n, i + n + m)
        same = (doc[a] == item[b]) & free_d[a] & free_i[b]
        if not same.all():
            return n + int(same.argmin())
        n += m
        if m < step:
            return n
        step *= 2


def _matches(doc: np.ndarray, item: np.ndarray, free_d: np.ndarray, free_i: np.ndarray, s: int) -> tuple[int, list[tuple[int, int, int]]]:
    """The greatest length met, and the matches (-length, d, i) of at least s free tokens that can't begin earlier.
    Fingerprints of s tokens find them, tokens are compared under each hit. One of over 2 s ends the round at once."""

    def open_windows(free: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.convolve(free, np.ones(s, np.int64), "valid") == s) if len(free) >= s else np.zeros(0, np.int64)

    at_d, at_i = open_windows(free_d), open_windows(free_i)
    if not (len(at_d) and len(at_i)):
        return 0, []
    pd, pi = C.grams(doc, s)[at_d], C.grams(item, s)[at_i]
    order = np.argsort(pi, kind="stable")
    pi, at_i = pi[order], at_i[order]
    lo, hi = np.searchsorted(pi, pd, "left"), np.searchsorted(pi, pd, "right")
    longest, found = 0, []
    for k in np.flatnonzero(hi > lo).tolist():
        d, i = int(at_d[k]), at_i[lo[k] : hi[k]]
        if d and free_d[d - 1]:  # a match that could begin earlier was met before
            i = i[(i == 0) | ~free_i[i - 1] | (item[i - 1] != doc[d - 1])]
        for x in i.tolist():
            n = _equal(doc, item, free_d, free_i, d, x)
            if n > 2 * s:
                return n, []
            if n >= s:
                longest = max(longest, n)
                found.append((-n, d, x))
    return longest, found


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (document start, item start, length): rounds of Karp-Rabin search for ever shorter matches, down to
    ``least`` tokens; in a round the longest match goes first, ties by place, and what is free of an overlapped one
    comes back in its turn."""
    free_d, free_i, found = np.ones(len(doc), bool), np.ones(len(item), bool), []
    s = max(least, min(FIRST_SEARCH, len(item)))
    while True:
        longest, matches = _matches(doc, item, free_d, free_i, s)
        if longest > 2 * s:
            s = longest
            continue
        heap = matches
        heapq.heapify(heap)
        while heap:
            length, d, i = heapq.heappop(heap)
            free = free_d[d : d - length] & free_i[i : i - length]
            if free.all():
                free_d[d : d - length] = free_i[i : i - length] = False
                found.append((d, i, -length))
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8))).tolist()
            for a, b in zip(edges[::2], edges[1::2]):
                if b - a >= s:
                    heapq.heappush(heap, (a - b, d + a, i + a))
        if s == least:
            return found
        s = max(least, s // 2)


def matched(hashes: pa.Array, block: Block, share: float) -> list[list[tuple[int, float]]]:
    """For each row of token hashes: the (item_id, coverage) of the items that contaminate it."""
    h, offsets = C.ragged(hashes)
    out: list[list[tuple[int, float]]] = [[] for _ in range(len(hashes))]
    at = np.flatnonzero(C.starts(offsets, MIN_MATCH, len(h)))
    if not len(at):
        return out
    prints = C.grams(h, MIN_MATCH)[at]
    some = np.flatnonzero(np.isin(prints, block.prints))
    if not len(some):
        return out
    row = np.searchsorted(offsets, at[some], side="right") - 1
    order = np.lexsort((prints[some], row))
    row, prints = row[order], prints[some][order]
    once = np.append(True, (row[1:] != row[:-1]) | (prints[1:] != prints[:-1]))  # each fingerprint once a row
    hit, seed = block.seeds(prints[once])
    row, item, place = row[once][hit], block.item[seed], block.place[seed]
    order = np.lexsort((place, item, row))
    row, item, place = row[order], item[order], place[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
    first = np.flatnonzero(new)
    for a, z in zip(first.tolist(), [*first[1:].tolist(), len(row)]):
        k, r = int(item[a]), int(row[a])
        own = block.h[block.offsets[k] : block.offsets[k + 1]]
        on = np.zeros(len(own), bool)
        for j in range(MIN_MATCH):
            on[place[a:z] - block.offsets[k] + j] = True
        if on.sum() < share * len(own):
            continue
        found = tiles(h[offsets[r] : offsets[r + 1]], own, MIN_MATCH)
        covered = sum(t[2] for t in found) / len(own)
        if covered >= share:
            out[r].append((int(block.ids[k]), covered))
    return [sorted(x) for x in out]


def blocks(benchmark: DataFrame) -> Iterator[Block]:
    """The items, a block at a time; no more than one block is on the driver. Their order changes no result, so they come
    in that of the table: a sort would make a job for each of its ranges."""
    hashed = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), tokens(F.col("text")))
    held, n = [], 0
    for item, h in hashed.toLocalIterator():
        held.append((item, h))
        n += len(h)
        if n >= BLOCK_TOKENS:
            yield Block(held)
            held, n = [], 0
    if held:
        yield Block(held)


def _with_items(docs: DataFrame, column: str, block: Block, share: float, keep: Callable[[pa.RecordBatch, list], pa.RecordBatch], schema) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield keep(b, matched(b.column(column), shared.value, share))

    return docs.mapInArrow(run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, contaminated, items): each document, with the (item_id, coverage) that contaminate it. Blocks follow one
    another in one pass over the documents, without a shuffle; each adds its items to the row."""
    C.small_batches(docs.sparkSession)
    schema = "doc_id long, h array<long>, items array<struct<item_id:long,coverage:double>>"
    out = C.documents(docs).select("doc_id", tokens(F.col("text")).alias("h"), F.array().cast("array<struct<item_id:long,coverage:double>>").alias("items"))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64())]))

    def listed(b: pa.RecordBatch, found: list) -> pa.RecordBatch:
        items = pa.array([[*(old or []), *({"item_id": i, "coverage": c} for i, c in x)] for old, x in zip(b.column("items").to_pylist(), found)], kind)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), items], names=["doc_id", "h", "items"])

    for block in blocks(benchmark):
        out = _with_items(out, "h", block, share, listed, schema)
    return out.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.array_sort("items").alias("items"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of ``docs``, with their columns, that no item contaminates; one map for each block, no shuffle."""
    C.small_batches(docs.sparkSession)
    names, out = docs.columns, docs
    column = C.unused("tokens", names)

    def keep(b: pa.RecordBatch, found: list) -> pa.RecordBatch:
        return b.select(names).filter(pa.array([not x for x in found], pa.bool_()))

    for block in blocks(benchmark):
        hashed = out.withColumn(column, tokens(F.coalesce("text", F.lit(""))))
        out = _with_items(hashed, column, block, share, keep, docs.schema)
    return out


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    df = contaminated(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    best = F.array_max(F.transform("items", lambda x: x["coverage"]))
    return df.select("doc_id", "contaminated", F.transform("items", lambda x: x["item_id"]).alias("item_ids"), best.alias("coverage"))
