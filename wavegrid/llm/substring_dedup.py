"""Substring dedup with prefix-partitioned suffix trees.

Every position that begins ``window`` words is a suffix. One tree of all suffixes fits no machine, so suffixes
are dealt to groups by variable-length prefixes and each group builds its own subtree:

1. *Pruning.* In each window the 8-word prefix with the least fingerprint is its sample (equal windows have the
   same sample at the same place; about two prefixes in seven are sampled). A prefix that only one document has
   leads to no node that two documents share, so its windows are leaves and go no further. This costs one
   shuffle of 32 bits of a fingerprint for two sevenths of the words; a chance hit only lets a leaf go on.
2. *Vertical partitioning.* The suffixes left go to groups by the 4-word prefix at their sample, so that all leaves
   of a deep node meet and neighbours, which mostly have one sample, travel as one segment of words. A prefix whose
   share is over the memory budget of a group is split by 8 words, or by the whole window where one 8-word prefix
   dominates. The shares come from a small sample of documents, as a range partitioner's do; they place rows and
   decide nothing.
3. *Subtrees.* A group sorts its suffixes by their words and takes the common prefix of each with its neighbour. A
   longest run of suffixes that share at least ``window`` words with the next is a deep internal node, the topmost
   of its path, so that every occurrence of the repeat is a leaf below it; its smallest document keeps the passage.
4. The windows that a document loses are merged to spans: the maximal repeats.

Hot passages: before each shuffle a task settles what it can by itself. Of a passage that several of its
documents hold it sends one occurrence of the smallest document, so a passage that a third of all documents
share costs a row for each chunk of a task, not for each document. Words are compared by 32 bits each and 32 more of the window's
fingerprint, which comes from 64-bit hashes of the words.

Defined results: a null or empty text has no words and no spans; a text shorter than the window loses nothing;
windows that repeat within one document only are kept (only a smaller doc_id counts); rows with a null doc_id
are left out; rows that repeat doc_id and text get equal result rows. Texts that share a doc_id are one document, so
none of them loses words to another; each has a row of its own (they are told apart by a 32-bit hash of the text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SAMPLE = 8
#: Words that a task works on at a time.
CHUNK_WORDS = 500_000
#: Neighbours that are compared at a time.
COMPARED = 1 << 16
#: Bytes of text for each group: about 1.5 million words.
GROUP_BYTES = 8 << 20
#: Bins of first-level prefixes, and documents that are read to size them.
BINS, SIZING_DOCS = 4096, 2000
_PACKED = "group int, docs binary, variants binary, counts binary, places binary, prints binary"
_SEGMENTS = "group int, docs binary, variants binary, counts binary, places binary, sizes binary, words binary, checks binary"
_PLACES = "doc_id long, variant int, places binary"


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins; the columns are sorted."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], 0)
    return np.flatnonzero(new)


def _pack(group: np.ndarray, doc: np.ndarray, variant: np.ndarray, place: np.ndarray, prints: np.ndarray | None = None) -> pa.RecordBatch:
    """One row for each group: its documents, how many occurrences each has, and those. Without prints: settled."""
    order = np.lexsort((place, variant, doc, group))
    group, doc, variant, place = group[order], doc[order], variant[order], place[order].astype(np.uint32)
    prints = prints[order] if prints is not None else np.zeros(0, np.uint32)
    first = _changes(group)
    cols: tuple[list, ...] = ([], [], [], [], [], [])
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(group)]):
        d = _changes(doc[a:b], variant[a:b])
        row = (int(group[a]), doc[a:b][d].tobytes(), variant[a:b][d].tobytes(), np.diff(np.append(d, b - a)).astype(np.uint32).tobytes(), place[a:b].tobytes(), prints[a:b].tobytes())
        for c, v in zip(cols, row):
            c.append(v)
    arrays = [pa.array(c, pa.binary() if k else pa.int32()) for k, c in enumerate(cols)]
    return pa.RecordBatch.from_arrays(arrays, names=["group", "docs", "variants", "counts", "places", "prints"])


def _unpack(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    get = lambda name, kind: np.frombuffer(b"".join(t.column(name).to_pylist()), kind)
    counts = get("counts", np.uint32)
    return np.repeat(get("docs", np.int64), counts), np.repeat(get("variants", np.int32), counts), get("places", np.uint32), get("prints", np.uint32)


def _merged(t: pa.Table) -> pa.Table:
    """One row for each text of a part, with all of its positions."""
    doc, variant, place, _ = _unpack(t)
    order = np.lexsort((place, variant, doc))
    doc, variant, place = doc[order], variant[order], place[order]
    first = _changes(doc, variant)
    blobs = [place[a:b].tobytes() for a, b in zip(first.tolist(), [*first[1:].tolist(), len(doc)])]
    return pa.table({"doc_id": pa.array(doc[first], pa.int64()), "variant": pa.array(variant[first], pa.int32()), "places": pa.array(blobs, pa.binary())})


def _leaves(order: np.ndarray, first: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each leaf: whether its document is the smallest of its node, and whether the node has two documents.

    ``order`` sorts the leaves by node, ``first`` tells where each node begins in it.
    """
    size = np.diff(np.append(first, len(order)))
    sorted_doc = doc[order]
    least, most = (f.reduceat(sorted_doc, first) for f in (np.minimum, np.maximum))
    smallest, shared = np.empty(len(order), bool), np.empty(len(order), bool)
    smallest[order] = sorted_doc == np.repeat(least, size)
    shared[order] = np.repeat(most != least, size)
    return smallest, shared


def _nodes(prints: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_leaves`` where equal fingerprints are a node."""
    order = np.argsort(prints)
    return _leaves(order, C.runs(prints[order])[0], doc)


def common_prefixes(suffixes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many symbols each suffix (a row) shares with the one before it in ``order``; 0 for the first."""
    lcp = np.zeros(len(order), np.int64)
    for a in range(1, len(order), COMPARED):
        rows = suffixes[order[a - 1 : a + COMPARED]]
        equal = rows[1:] == rows[:-1]
        lcp[a : a + COMPARED] = np.where(equal.all(1), rows.shape[1], equal.argmin(1))
    return lcp


def subtree(suffixes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_leaves`` of the deep internal nodes: suffixes in word order, cut where neighbours share less than a whole row."""
    order = np.argsort(suffixes.view(f"S{suffixes.shape[1] * 4}").ravel())
    return _leaves(order, np.flatnonzero(common_prefixes(suffixes, order) < suffixes.shape[1]), doc)


def _suffixes(words: np.ndarray, begin: np.ndarray, checks: np.ndarray, window: int) -> np.ndarray:
    """The first ``window`` words of each suffix and, as a last symbol, its check."""
    out = np.empty((len(begin), window + 1), np.uint32)
    for k in range(window):
        out[:, k] = words[begin + k]
    out[:, window] = checks
    return out


def _one_each(prints: np.ndarray, among: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(among)
    return at[np.unique(prints[at], return_index=True)[1]]


def _sampled(f8: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """The position of each window's sample."""
    best, where = f8[at], at.copy()
    for o in range(1, window - SAMPLE + 1):
        other = f8[at + o]
        less = other < best
        best[less], where[less] = other[less], at[less] + o
    return where


def _send_samples(groups: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.chunks(batches, "h", CHUNK_WORDS):
            h, offsets = C.ragged(t.column("h"))
            at = np.flatnonzero(C.starts(offsets, window, len(h)))
            if not len(at):
                continue
            f8 = C.grams(h, SAMPLE)
            place = np.unique(_sampled(f8, at, window))
            row = np.searchsorted(offsets, place, side="right") - 1
            doc, variant = (t.column(c).to_numpy()[row] for c in ("doc_id", "variant"))
            prints, place = f8[place], place - offsets[row]
            smallest, shared = _nodes(prints, doc)
            if shared.any():  # settled here: all of these are shared; one occurrence tells other tasks
                yield _pack(doc[shared] % groups, doc[shared], variant[shared], place[shared])
                shared[_one_each(prints, shared & smallest)] = False
            ask = ~shared
            group = (prints[ask] % np.uint64(groups)).astype(np.int64)
            yield _pack(group, doc[ask], variant[ask], place[ask], (prints[ask] >> np.uint64(32)).astype(np.uint32))

    return run


def _answers(parts: int):
    """For a group: which samples two documents share, packed by the documents' part."""

    def run(t: pa.Table) -> pa.Table:
        settled = np.array([not len(x) for x in t.column("prints").to_pylist()])
        *known, _ = _unpack(t.filter(pa.array(settled)))
        *own, prints = _unpack(t.filter(pa.array(~settled)))
        shared = _nodes(prints, own[0])[1]
        doc, variant, place = (np.concatenate([a, b[shared]]) for a, b in zip(known, own))
        return pa.Table.from_batches([_pack(doc % parts, doc, variant, place)])

    return run


def _pack_segments(group: np.ndarray, doc: np.ndarray, variant: np.ndarray, place: np.ndarray, at: np.ndarray, words: np.ndarray, checks: np.ndarray, window: int) -> pa.RecordBatch:
    """One row for each group with the segments of its suffixes: those that follow each other in a text are one."""
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | np.any([np.diff(c) != 0 for c in (group, doc, variant)], 0)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    order = np.argsort(group[first], kind="stable")  # by document and place within a group, as they came
    first, size = first[order], size[order]
    ends, all_words, all_checks = np.append(0, np.cumsum(size)), words[C.gathered(at[first], size + window - 1)], checks[C.gathered(first, size)]
    bounds = _changes(group[first])
    cols: tuple[list, ...] = ([], [], [], [], [], [], [], [])
    for a, b in zip(bounds.tolist(), [*bounds[1:].tolist(), len(first)]):
        f = first[a:b]
        d = _changes(doc[f], variant[f])
        lo, hi = int(ends[a]), int(ends[b])
        row = (
            int(group[f[0]]), doc[f][d].tobytes(), variant[f][d].tobytes(), np.diff(np.append(d, b - a)).astype(np.uint32).tobytes(),
            place[f].astype(np.uint32).tobytes(), size[a:b].astype(np.uint32).tobytes(),
            all_words[lo + a * (window - 1) : hi + b * (window - 1)].tobytes(), all_checks[lo:hi].tobytes(),
        )
        for c, v in zip(cols, row):
            c.append(v)
    return _segment_batch(cols)


def _segment_batch(cols: tuple[list, ...]) -> pa.RecordBatch:
    names = [c.split()[0] for c in _SEGMENTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k else pa.int32()) for k, c in enumerate(cols)], names=names)


def _settled(packed: pa.RecordBatch) -> pa.RecordBatch:
    """Packed occurrences among segments: rows that have no words."""
    known = [packed.column(c).to_pylist() for c in ("group", "docs", "variants", "counts", "places")]
    return _segment_batch((*known, *([b""] * packed.num_rows for _ in range(3))))


def _lost(parts: int, window: int):
    """For a group: the suffixes below a deep node that a smaller document has too, packed by the documents' part."""

    def run(t: pa.Table) -> pa.Table:
        settled = np.array([not len(x) for x in t.column("words").to_pylist()])
        ragged = lambda rows, name, kind: np.frombuffer(b"".join(rows.column(name).to_pylist()), kind)

        def items(rows: pa.Table) -> tuple[np.ndarray, ...]:
            counts = ragged(rows, "counts", np.uint32)
            return np.repeat(ragged(rows, "docs", np.int64), counts), np.repeat(ragged(rows, "variants", np.int32), counts), ragged(rows, "places", np.uint32)

        known, own = items(t.filter(pa.array(settled))), t.filter(pa.array(~settled))
        size = ragged(own, "sizes", np.uint32).astype(np.int64)
        length = size + window - 1
        begin, inside = C.gathered(np.cumsum(length) - length, size), C.gathered(np.zeros(len(size), np.int64), size)
        doc, variant, place = (np.repeat(c, size) for c in items(own))
        smallest, inner = subtree(_suffixes(ragged(own, "words", np.uint32), begin, ragged(own, "checks", np.uint32), window), doc)
        lost = inner & ~smallest
        doc, variant, place = (np.concatenate([a, b[lost]]) for a, b in zip(known, (doc, variant, place + inside)))
        return pa.Table.from_batches([_pack(doc % parts, doc, variant, place)])

    return run


class _Prefixes:
    """Groups of suffixes by prefixes of 4, 8 or ``window`` words, so that each fits a task's memory."""

    def __init__(self, share: np.ndarray, dominated: np.ndarray, groups: int):
        self.split = np.maximum(1, np.ceil(share * groups)).astype(np.int64)
        alone = self.split > 1
        small = np.where(alone, 0, share)
        packed = np.floor((np.cumsum(small) - small) * groups).astype(np.int64)
        n_packed = int(packed.max(initial=0)) + 1
        self.base = np.where(alone, n_packed + np.cumsum(np.where(alone, self.split, 0)) - self.split, packed)
        self.whole, self.groups = dominated & alone, int(n_packed + self.split[alone].sum())

    def of(self, f4: np.ndarray, f8: np.ndarray, whole: np.ndarray) -> np.ndarray:
        b = (f4 % np.uint64(BINS)).astype(np.int64)
        deep = np.where(self.whole[b], whole, f8) >> np.uint64(20)
        return self.base[b] + (deep % self.split[b].astype(np.uint64)).astype(np.int64)


def _sized_prefixes(hashed: DataFrame, n_docs: int, groups: int, window: int) -> _Prefixes:
    count, heavy = np.ones(BINS), np.zeros(BINS)
    fraction = min(1.0, SIZING_DOCS / max(1, n_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, top = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
        for t in C.chunks(batches, "h", CHUNK_WORDS):
            h, offsets = C.ragged(t.column("h"))
            at = np.flatnonzero(C.starts(offsets, window, len(h)))
            if len(at):
                f8 = C.grams(h, SAMPLE)
                at = _sampled(f8, at, window)
                bins = (C.grams(h, 4)[at] % np.uint64(BINS)).astype(np.int64)
                n += np.bincount(bins, minlength=BINS)
                value, first, times = np.unique(f8[at], return_index=True, return_counts=True)
                np.maximum.at(top, bins[first], times)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS)), pa.array(n), pa.array(top)], names=["bin", "n", "top"])

    sample = hashed.sample(fraction, seed=7).mapInArrow(run, "bin long, n long, top long")
    for b, n, top in sample.groupBy("bin").agg(F.sum("n"), F.max("top")).collect():  # BINS rows
        count[b] += n
        heavy[b] = top
    return _Prefixes(count / count.sum(), heavy > count / 2, groups)


def _send_suffixes(prefixes: _Prefixes, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.chunks(batches, "h", CHUNK_WORDS):
            h, offsets = C.ragged(t.column("h"))
            at = np.flatnonzero(C.starts(offsets, window, len(h)))
            if not len(at):
                continue
            f8, whole = C.grams(h, SAMPLE), C.grams(h, window)
            shared = np.zeros(len(h), bool)
            for k, blob in enumerate(t.column("places").to_pylist()):
                shared[offsets[k] + np.frombuffer(blob, np.uint32)] = True
            sample = _sampled(f8, at, window)
            at, sample = at[shared[sample]], sample[shared[sample]]
            if not len(at):
                continue
            row = np.searchsorted(offsets, at, side="right") - 1
            doc, variant = (t.column(c).to_numpy()[row] for c in ("doc_id", "variant"))
            place, words, checks = at - offsets[row], h.astype(np.uint32), (whole[at] >> np.uint64(32)).astype(np.uint32)
            smallest, inner = subtree(_suffixes(words, at, checks, window), doc)
            lost = inner & ~smallest
            if lost.any():  # settled here
                yield _settled(_pack(doc[lost] % prefixes.groups, doc[lost], variant[lost], place[lost]))
            ask = ~lost
            group = prefixes.of(C.grams(h, 4)[sample], f8[sample], whole[at])
            yield _pack_segments(*(c[ask] for c in (group, doc, variant, place, at)), words, checks[ask], window)

    return run


def _spans(window: int):
    """Merges the removed windows of each document to spans of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = []
            for blob in b.column("places").to_pylist():
                p = np.frombuffer(blob, np.uint32).astype(np.int64)
                new = np.flatnonzero(np.diff(p, prepend=-window - 1) > window)
                last = np.append(new[1:], len(p)) - 1
                spans.append([{"start": int(s), "end": int(e) + window} for s, e in zip(p[new], p[last])])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("variant"), pa.array(spans, kind)], names=["doc_id", "variant", "spans"])

    return run


def repeated_spans(docs: DataFrame, window: int = 13, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, variant, spans): the word spans [start, end) that a document with a smaller doc_id has too; ``variant``
    is the hash of the text that they belong to."""
    C.small_batches(docs.sparkSession)
    texts = C.documents(docs).withColumn("variant", F.hash("text"))
    n_docs, n_bytes = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    groups, parts = max(1, n_bytes // group_bytes), max(1, n_bytes // (4 * group_bytes))
    hashed = lambda df: df.withColumn("h", C.word_hashes(F.col("text"))).drop("text")
    samples = hashed(texts).mapInArrow(_send_samples(groups, window), _PACKED)
    shared = samples.groupBy("group").applyInArrow(_answers(parts), _PACKED)
    shared = shared.groupBy("group").applyInArrow(_merged, _PLACES)
    # sorted, so that a task that is run again forms the same chunks
    suffixes = hashed(texts.join(shared, ["doc_id", "variant"])).sortWithinPartitions("doc_id", "variant")
    prefixes = _sized_prefixes(hashed(texts), n_docs, groups, window)
    suffixes = suffixes.mapInArrow(_send_suffixes(prefixes, window), _SEGMENTS)
    removed = suffixes.groupBy("group").applyInArrow(_lost(parts, window), _PACKED)
    removed = removed.groupBy("group").applyInArrow(_merged, _PLACES)
    return removed.mapInArrow(_spans(window), "doc_id long, variant int, spans array<struct<start:int,end:int>>")


def _kept(words: Column, spans: Column) -> Column:
    """The words outside of the spans, which are sorted and disjoint."""
    n = F.size(spans)
    gap = lambda i: F.slice(
        words,
        F.when(i == 0, 0).otherwise(spans[i - 1]["end"]) + 1,
        F.when(i == n, F.size(words)).otherwise(spans[i]["start"]) - F.when(i == 0, 0).otherwise(spans[i - 1]["end"]),
    )
    return F.flatten(F.transform(F.sequence(F.lit(0), n), gap))


def remove_repeats(docs: DataFrame, window: int = 13, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, spans) of each document."""
    texts = C.documents(docs).withColumn("variant", F.hash("text"))
    spans = repeated_spans(docs, window, group_bytes)
    df = texts.join(spans, ["doc_id", "variant"], "left").withColumn("words", C.words(F.col("text")))
    removed = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"])), F.lit(0).cast("long"))
    kept = F.when(F.col("spans").isNull(), F.col("words")).otherwise(C.let(F.col("words"), lambda w: C.let(F.col("spans"), lambda s: _kept(w, s))))
    return df.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        removed.alias("n_removed"),
        F.array_join(kept, " ").alias("kept_text"),
        "spans",
    )


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    df = remove_repeats(C.table(spark, sf_dir, "documents"))
    return df.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
