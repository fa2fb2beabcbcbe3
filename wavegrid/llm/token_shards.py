"""Token ids as one wavelet-matrix file per shard.

Documents are range-partitioned by doc_id and sorted, so shards follow each other in ascending doc_id order. A task
encodes its documents and writes a shard file whenever ``SHARD_TOKENS`` are gathered; the files are the rows of a
Parquet table in the shared folder, written by Spark's committer, so a lost executor leaves none behind in part.

The tokenizer drops white space between words and joins nothing across it (checked when it is loaded), so a text's ids
are those of its words, split at space, tab, line feed and carriage return, one after another, and each distinct word
is encoded once by a worker. Words go to the library ``JOINED`` at a time, joined by spaces, and the tokens' places
tell whose they are. A full stop or comma is taken off a word where the tokenizer itself parts it from the letter
before it; the letters below U+0250 are tried when it is loaded, all other words go to the library as they stand.

Defined results: a null or empty text has the end id alone; rows with a null doc_id are left out; rows that repeat
a doc_id, with the same text or another, have a row each and stand together, in the order of their texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .wavelet import WaveletMatrix
from .wordcache import WordCache

#: Tokens after which a shard is closed, and bytes of text for each range of documents.
SHARD_TOKENS, RANGE_BYTES = 2_000_000, 16 << 20
END_ID = 1
#: Marks that may be taken off a word, and words that are encoded together.
MARKS, JOINED = (".", ","), 200
#: Parts of the shard table whose tokens are summed together.
PARTS = 4096
_SHARD = "part int, shard int, n_tokens long, file binary"
_workers: dict[str, WordCache] = {}


class WordEncoder:
    """The tokenizer's ids of single words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        if any(ids(f"one{space}two") != [*ids("one"), *ids("two")] for space in " \t\n\r"):
            raise ValueError("this tokenizer doesn't split texts at white space")
        self.letters = {c for c in map(chr, range(0x41, 0x250)) if c.isalpha() and all(self._parted(c, m) for m in MARKS)}

    def _parted(self, letter: str, mark: str) -> bool:
        """Whether the mark is a piece of its own after the letter."""
        t = self.tokenizer
        text = t.normalizer.normalize_str(f"a{letter}{mark}") if t.normalizer else f"a{letter}{mark}"
        pieces = t.pre_tokenizer.pre_tokenize_str(text) if t.pre_tokenizer else []
        return bool(pieces) and pieces[-1][1] == (len(text) - 1, len(text))

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, and how many each has."""
        marked = [w[-1:] in MARKS and w[-2:-1] in self.letters for w in words]
        place: dict[str, int] = {}
        number = lambda w: place.setdefault(w, len(place))
        at = np.array([x for w, m in zip(words, marked) for x in ((number(w[:-1]), number(w[-1])) if m else (number(w), -1))], np.int64)
        distinct = list(place)
        ids, count = [], []
        for s in range(0, len(distinct), JOINED):
            some = distinct[s : s + JOINED]
            e = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            begin = np.cumsum([0, *(len(w) + 1 for w in some[:-1])])
            ids.append(np.array(e.ids, np.uint32))
            count.append(np.bincount(np.searchsorted(begin, [o[0] for o in e.offsets], side="right") - 1, minlength=len(some)))
        flat, length = np.concatenate(ids), np.concatenate(count)
        start = np.cumsum(length) - length
        own = np.where(at < 0, 0, length[at])
        return flat[C.gathered(start[at], own)], own.reshape(-1, 2).sum(1)


def worker(path: str) -> WordCache:
    """The word cache of this Python worker, kept from task to task."""
    if path not in _workers:
        _workers[path] = WordCache(WordEncoder(path).encode)
    return _workers[path]


def split_words(text: str) -> list[str]:
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def write_shards(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """The table of shard files: (part, shard) is their order."""
    C.small_batches(docs.sparkSession)
    texts = C.documents(docs)
    ranges = max(1, C.text_bytes(texts) // RANGE_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache, part = worker(path), TaskContext.get().partitionId()
        ids, doc_ids, lengths, n, shard = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            file = WaveletMatrix.build(np.concatenate(ids), np.concatenate(doc_ids), np.concatenate(lengths)).to_bytes()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([n], pa.int64()), pa.array([file], pa.binary())], names=["part", "shard", "n_tokens", "file"])

        for b in batches:
            flat, size = cache.ids([split_words(t) for t in b.column("text").to_pylist()])
            ends = np.cumsum(size)
            flat = np.insert(flat, ends, end_id)
            ids.append(flat)
            doc_ids.append(b.column("doc_id").to_numpy())
            lengths.append(size + 1)
            n += len(flat)
            if n >= SHARD_TOKENS:
                yield close()
                ids, doc_ids, lengths, n, shard = [], [], [], 0, shard + 1
        if n:
            yield close()

    ordered = texts.repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", "text")
    return C.work_table(ordered.mapInArrow(run, _SHARD), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""
    # tokens before a shard: those of its block of parts, and of the blocks before it (a row for each ``PARTS`` parts)
    sizes = shards.select("part", "shard", "n_tokens", F.floor(F.col("part") / PARTS).alias("block"))
    before = lambda w, n: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    blocks = sizes.groupBy("block").agg(F.sum("n_tokens").alias("n")).select("block", before(Window.orderBy("block"), "n").alias("base"))
    inside = sizes.select("part", "shard", "block", before(Window.partitionBy("block").orderBy("part", "shard"), "n_tokens").alias("own"))
    starts = inside.join(blocks, "block").select("part", "shard", (F.col("base") + F.col("own")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, file in zip(b.column("first").to_pylist(), b.column("file")):
                w = WaveletMatrix.from_bytes(file.as_py())
                data, ends = memoryview(w.tokens().tobytes()), np.cumsum(w.lengths, dtype=np.int64)
                begin = ends - w.lengths
                crc = [zlib.crc32(data[4 * a : 4 * z]) for a, z in zip(begin.tolist(), ends.tolist())]
                arrays = [pa.array(w.doc_ids), pa.array(begin + first), pa.array(w.lengths.astype(np.int64)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.join(starts, ["part", "shard"]).select("first", "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_shards(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_shards(write_shards(C.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
