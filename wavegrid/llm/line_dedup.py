"""Line dedup: range-partitioned line hashes, sorted by document and position, give per-document keep bitmaps.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased. Of a key of at least ``min_chars``
code points that two documents hold, only the lines of the smallest doc_id stay.

1. Keys are 128-bit hashes made in the JVM. A map task settles what it can by itself: of the documents of a chunk
   that hold a key, all but the smallest lose it whatever other tasks hold. So a line of a third of all documents
   costs a row for each chunk, not for each document.
2. The rows left are range-partitioned by hash and sorted by hash, document and position; each partition streams
   past the first document of each hash and tells the rest. A hash never spans two partitions.
3. Told positions meet by document and become a zlib-compressed bitmap (bit i of byte i // 8: line i stays).
   Texts are shuffled never but for the last join that applies the bitmaps, which moves one copy; they never leave
   the JVM.

Defined results: a null or empty text is one empty line, which stays; keys under ``min_chars`` always stay, as do
lines that repeat in one document only; rows with a null doc_id are left out. Texts that share a doc_id are one
document, so none of them loses a line to another, but each has a row and a bitmap of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Lines that a task settles at a time.
CHUNK_LINES = 500_000
EDGE = " \t\n\x0b\x0c\r"
_ROWS = "doc_id long, row long, n_lines long, key binary, places binary"
_TOLD = "doc_id long, row long, n_lines long, places binary"


def _keys(text: Column, min_chars: int) -> Column:
    """The 16-byte hash of each line's key; null for a short one."""

    def key(line: Column) -> Column:
        bare = F.btrim(line, F.lit(EDGE))
        return F.when(F.length(bare) >= min_chars, F.unhex(F.md5(C.ascii_lower(bare))))

    return F.transform(F.split(text, "\n", -1), key)


def _group(key: np.ndarray | None, doc: np.ndarray, row: np.ndarray, n_lines: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """A line for each (key, document, row), or each row alone, with its positions; inputs are sorted."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])
    if key is not None:
        new[1:] |= (key[1:] != key[:-1]).any(1)
    first = np.flatnonzero(new)
    blobs = [place[a:b].astype(np.uint32).tobytes() for a, b in zip(first.tolist(), [*first[1:].tolist(), len(doc)])]
    keys = pa.array([x.tobytes() for x in key[first]], pa.binary()) if key is not None else pa.nulls(len(first), pa.binary())
    arrays = [*(pa.array(x[first], pa.int64()) for x in (doc, row, n_lines)), keys, pa.array(blobs, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "row", "n_lines", "key", "places"])


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a key ask for an answer; rows without one are settled: those lines go."""
    for t in C.chunks(batches, "keys", CHUNK_LINES):
        column = t.column("keys").combine_chunks()
        offsets = column.offsets.to_numpy().astype(np.int64)
        offsets, flat = offsets - offsets[0], column.flatten()
        has = np.flatnonzero(flat.is_valid().to_numpy(zero_copy_only=False))
        if not len(has):
            continue
        key = np.frombuffer(b"".join(flat.drop_null().to_pylist()), ">u8").reshape(-1, 2)
        at = np.searchsorted(offsets, has, side="right") - 1
        doc, row = (t.column(c).to_numpy()[at] for c in ("doc_id", "row"))
        place, n_lines = has - offsets[at], np.diff(offsets)[at]
        order = np.lexsort((place, row, doc, key[:, 1], key[:, 0]))
        key, doc, row, place, n_lines = (x[order] for x in (key, doc, row, place, n_lines))
        new = np.ones(len(doc), bool)
        new[1:] = (key[1:] != key[:-1]).any(1)
        lost = doc != doc[np.flatnonzero(new)][np.cumsum(new) - 1]  # its smallest document is the first of a key
        if lost.any():
            by_row = np.flatnonzero(lost)[np.lexsort((place[lost], row[lost], doc[lost]))]
            yield _group(None, doc[by_row], row[by_row], n_lines[by_row], place[by_row])
        yield _group(key[~lost], doc[~lost], row[~lost], n_lines[~lost], place[~lost])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by key and document: passes each key's first document, tells the others; neighbours are compared at once."""
    last_key, last_first = None, 0
    for b in batches:
        known = b.column("key").is_null().to_numpy(zero_copy_only=False)
        keys = np.frombuffer(b"".join(b.column("key").drop_null().to_pylist()), ">u8").reshape(-1, 2)
        doc, told = b.column("doc_id").to_numpy()[~known], known.copy()
        if len(keys):
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]).any(1)
            starts = np.flatnonzero(new)
            first = doc[starts]
            if last_key is not None and (keys[0] == last_key).all():
                first[0] = last_first
            told[~known] = doc != first[np.cumsum(new) - 1]
            last_key, last_first = keys[-1], first[-1]
        yield b.select(["doc_id", "row", "n_lines", "places"]).filter(pa.array(told))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        maps, lost, words = [], [], []
        for n, blobs in zip(b.column("n_lines").to_pylist(), b.column("places").to_pylist()):
            keep = np.ones(n, bool)
            keep[np.frombuffer(b"".join(blobs), np.uint32)] = False
            packed = np.packbits(keep, bitorder="little").tobytes()
            maps.append(zlib.compress(packed))
            lost.append(int(n - keep.sum()))
            words.append(np.frombuffer(packed.ljust(-(-len(packed) // 8) * 8, b"\0"), np.int64))
        arrays = [b.column("doc_id"), b.column("row"), pa.array(lost, pa.int64()), pa.array(maps, pa.binary()), pa.array(words, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "row", "n_dropped", "keep", "bits"])


def _kept_text(text: Column, bits: Column) -> Column:
    """The lines whose bit is set; the text itself where there are no bits."""
    stays = lambda _, i: F.getbit(F.get(bits, F.shiftright(i, 6)), i.bitwiseAND(63)) == 1
    return F.when(bits.isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n", -1), stays), "\n"))


def _row(text: Column) -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, row, n_dropped, keep, bits) of the texts that lose a line; ``bits`` is the bitmap in words of 64."""
    spark = docs.sparkSession
    C.small_batches(spark)
    keyed = C.documents(docs).select("doc_id", _row(F.col("text")).alias("row"), _keys(F.col("text"), min_chars).alias("keys"))
    rows = keyed.mapInArrow(_send, _ROWS)
    # keys are uniform, so equal ranges of their first four bytes need no sample; rows without a key go anywhere
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lead = F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long")
    part = F.floor(F.coalesce(lead, F.pmod(F.xxhash64("doc_id", "row"), F.lit(1 << 32))) * n / F.lit(1 << 32)).cast("int")
    told = rows.repartitionById(n, part).sortWithinPartitions("key", "doc_id", "row", "places").mapInArrow(_stream, _TOLD)
    told = told.groupBy("doc_id", "row").agg(F.max("n_lines").alias("n_lines"), F.collect_list("places").alias("places"))
    return told.mapInArrow(_bitmaps, "doc_id long, row long, n_dropped long, keep binary, bits array<long>")


def first_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text, keep) of every document; keep is null where every line stays."""
    texts = C.documents(docs).withColumn("row", _row(F.col("text"))).withColumn("n_lines", F.size(F.split("text", "\n", -1)).cast("long"))
    joined = texts.join(keep_bitmaps(docs, min_chars), ["doc_id", "row"], "left").withColumn("n_dropped", F.coalesce("n_dropped", F.lit(0).cast("long")))
    return joined.select("doc_id", "n_lines", "n_dropped", _kept_text(F.col("text"), F.col("bits")).alias("kept_text"), "keep")


def drop_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``docs`` with the same columns, its texts without the lines that go; n_chars, where there is one, follows."""
    names = docs.columns
    mark, row = C.unused("bits", names), C.unused("row", names)
    maps = keep_bitmaps(docs, min_chars).select("doc_id", F.col("row").alias(row), F.col("bits").alias(mark))
    out = docs.withColumn(row, _row(F.col("text"))).join(maps, ["doc_id", row], "left")
    out = out.withColumn("text", _kept_text(F.col("text"), F.col(mark))).select(*names)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    df = first_lines(C.table(spark, sf_dir, "documents"))
    return df.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
