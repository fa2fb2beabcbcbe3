"""SentencePiece encoding and decoding by batched numpy searches.

Of the model file only the vocabulary and its scores are read, by the library that it belongs to. The installed
model is a BPE model: its scores are merge ranks, and ids are right only if neighbours are merged in that order.
``merge_words``, which the operator uses, does so and gives the library's ids.

Words of equal length advance together, a word in each column: for each piece length, rolling hashes of all
substrings at all positions probe a hash table of the pieces of that length (hits are compared character by
character). Then each step merges, in every word at once, the neighbours that make the piece of the greatest score,
of equal ones the leftmost, until no two neighbours make a piece: a pair is one number, the rank of its score before
its place, so the least of a column is the pair to merge. A character that no piece covers is written as its UTF-8
bytes.

``encode_words`` is the Viterbi search for a unigram model's scores: the segmentation of the greatest sum, where an
uncovered character counts ``UNKNOWN_PENALTY`` under the lowest score. With a BPE model its ids are not the library's.

A space is written as U+2581 and one stands before a text; a U+2581 of the text itself is written as bytes, where
the library makes it a space, so decoding gives back every text unchanged. Words begin at each run of spaces; no
piece crosses such a start. Of equal sums, the shorter last piece wins.

Defined results: a null or empty text has no ids and decodes to an empty text; rows with a null doc_id are left
out by ``encoded`` but kept by ``add_pieces``. Long texts without spaces are one long word, searched in whole.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from . import common as C
from .wordcache import WordCache

SPACE, LITERAL = "▁", "\ud800"  # a lone surrogate stands for a U+2581 of the text: no text has one
UNKNOWN_PENALTY = 10.0
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Words of one length that advance together, and characters from which a word is searched alone.
GROUP, LONG = 20_000, 2_000
#: Above all ranks of scores.
NO_PAIR = 1 << 32
#: Words that a worker remembers; it lives on when the stage is over, so they count in later stages' memory, too.
CACHED_WORDS = 400_000


def codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)


class HashTable:
    """Pieces of one length by their hashes: a slot for each, or the next free one after it, in eight times the room."""

    def __init__(self, key: np.ndarray, ids: np.ndarray, text: np.ndarray):
        order = np.argsort(key)
        self.key, self.ids, self.text = key[order], ids[order], np.ascontiguousarray(text[order].T)
        bits = (8 * len(key)).bit_length()
        self.shift = np.uint64(64 - bits)
        number = np.arange(len(key))
        slot = np.maximum.accumulate((self.key >> self.shift).astype(np.int64) - number) + number
        self.held = np.full((1 << bits) + len(key) + 1, -1, np.int32)
        self.held[slot] = number

    def found(self, h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts (rows), words (columns) and ids of the pieces among the substrings of ``text`` with the hashes ``h``."""
        slot = (h >> self.shift).astype(np.int64)
        start, word = np.nonzero(self.held[slot] >= 0)  # most are at an end here
        h, slot = h[start, word], slot[start, word]
        k = self.held[slot]
        other = np.flatnonzero(self.key[k] != h)
        while len(other):
            slot[other] += 1
            k[other] = self.held[slot[other]]
            other = other[(k[other] >= 0) & (self.key[k[other]] != h[other])]
        same = k >= 0
        for j, own in enumerate(self.text):
            same &= text[start + j, word] == own[k]
        return start[same], word[same], self.ids[k[same]]


class Pieces:
    """A vocabulary: pieces with scores by length, and byte pieces."""

    def __init__(self, pieces: list[tuple[int, str, float]], byte_ids: dict[int, int], size: int):
        self.byte_ids = np.array([byte_ids[b] for b in range(256)], np.int64)
        self.unknown = min((s for _, _, s in pieces if s > -1e8), default=0.0) - UNKNOWN_PENALTY
        self.longest = max((len(p) for _, p, _ in pieces), default=1)
        self.table = {p: (s, i) for i, p, s in pieces}
        # by id; the last entry is what the id -1 stands for, no piece
        self.score, self.rank = np.full(size + 1, -np.inf), np.full(size + 1, NO_PAIR)
        for i, _, s in pieces:
            self.score[i] = s
        own = np.array([i for i, _, _ in pieces], np.int64)
        self.rank[own] = np.unique(-self.score[own], return_inverse=True)[1]
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in range(1, self.longest + 1):
            some = [(i, p) for i, p, _ in pieces if len(p) == n]
            if some:
                text, ids = codes([p for _, p in some]).reshape(-1, n), np.array([i for i, _ in some], np.int32)
                key = next(h for m, h in self.hashed(text.T) if m == n)[0]
                self.by_length[n] = key, ids, self.score[ids], text
        self.hash_tables = {n: HashTable(key, ids, text) for n, (key, ids, _, text) in self.by_length.items()}
        table = [b""] * size
        for i, p, _ in pieces:
            table[i] = p.replace(SPACE, " ").encode()
        for b, i in byte_ids.items():
            table[i] = bytes([b])
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.byte_length = np.array([len(x) for x in table], np.int64)
        self.byte_start = np.cumsum(self.byte_length) - self.byte_length

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
        normal = [(i, sp.id_to_piece(i), sp.get_score(i)) for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        return cls(normal, byte_ids, len(ids))

    def hashed(self, text: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each length: hashes of the substrings at each start (row) of each word (column)."""
        h = np.zeros(text.shape, np.uint64)
        for n in range(1, min(self.longest, len(text)) + 1):
            h = h[: len(text) - n + 1] * C.POLY + text[n - 1 :]
            yield n, C.mix(h)

    def probed(self, text: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each length: starts, words and ids of the pieces found, where ``text`` has a word in each column."""
        for n, h in self.hashed(text):
            if n in self.hash_tables:
                yield n, *self.hash_tables[n].found(h, text)

    def all_probed(self, text: np.ndarray) -> tuple[list[int], np.ndarray]:
        """The lengths probed, and the id of the piece by length, start and word; -1 where there is none."""
        lengths, piece = [], np.full((self.longest + 1, *text.shape), -1, np.int32)
        for n, start, word, i in self.probed(text):
            piece[n, start, word] = i
            lengths.append(n)
        return lengths, piece

    def merge(self, text: np.ndarray) -> list[np.ndarray]:
        """Ids of each row of ``text`` by merges in the order of their scores, of equal ones the leftmost first."""
        text = np.ascontiguousarray(text.T)
        length, count = text.shape
        _, piece = self.all_probed(text)
        size = np.ones((length + 1, count), np.int64)  # of the symbol that starts here; the last place is no symbol
        size[length] = self.longest + 1
        before = np.repeat(np.arange(-1, length)[:, None], count, 1)  # where the symbol before the one that starts here starts
        bits = length.bit_length()
        last = self.longest  # a made symbol of more characters is none: row 0 of ``piece`` has no ids

        def made(n: np.ndarray, at: np.ndarray, r: np.ndarray) -> np.ndarray:
            """What the two symbols that start at ``at`` and have n characters are worth, and their place."""
            return (self.rank[piece[np.where(n <= last, n, 0), at, r]] << bits) | at

        # of the symbol that starts here and the next one
        pair = np.full((length, count), NO_PAIR << bits)
        if length > 1 and last > 1:
            pair[:-1] = (self.rank[piece[2, :-1]] << bits) | np.arange(length - 1)[:, None]
        rows = np.arange(count)
        while True:
            best = pair.min(0)
            own = np.flatnonzero(best < NO_PAIR << bits)
            if not len(own):
                break
            at = best[own] & ((1 << bits) - 1)
            if 4 * len(own) < 3 * len(rows):
                rows, pair, own = rows[own], pair[:, own], np.arange(len(own))
            r = rows[own]
            gone = at + size[at, r]
            n = gone - at + size[gone, r]
            size[at, r], size[gone, r] = n, 0
            pair[gone, own] = NO_PAIR << bits
            after = at + n
            before[after, r] = at
            pair[at, own] = made(n + size[after, r], at, r)
            has = at > 0
            r, n, own = r[has], n[has], own[has]
            left = before[at[has], r]
            pair[left, own] = made(size[left, r] + n, left, r)
        row, start = np.nonzero(size[:length].T)
        ids, n = self.spelt(piece[size[start, row], start, row], text[start, row])
        ends = np.cumsum(np.bincount(row, weights=n, minlength=count).astype(np.int64)).tolist()
        return [ids[a:z] for a, z in zip([0, *ends], ends)]

    def merge_long(self, text: np.ndarray) -> np.ndarray:
        """The same merges in one long word, taken from a heap."""
        word, length = text.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), len(text)
        size, before = [1] * length, list(range(-1, length - 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(at: int) -> None:
            after = at + size[at]
            if at >= 0 and after < length and (found := self.table.get(word[at : after + size[after]])):
                heapq.heappush(heap, (-found[0], at, size[at], size[after]))

        for at in range(length):
            offer(at)
        while heap:
            _, at, n, m = heapq.heappop(heap)
            if size[at] != n or size[at + n] != m:  # one of the two has been merged since
                continue
            size[at], size[at + n] = n + m, 0
            if at + n + m < length:
                before[at + n + m] = at
            offer(at)
            if at > 0:
                offer(before[at])
        start = [at for at in range(length) if size[at]]
        ids = [self.table.get(word[at : at + size[at]], (0.0, -1))[1] for at in start]
        return self.spelt(np.array(ids), text[start])[0]

    def search(self, text: np.ndarray) -> list[np.ndarray]:
        """Ids of each row of ``text``; -1 for a character to be written as bytes."""
        count, length = text.shape
        probed, piece = self.all_probed(text.T)
        piece = piece.transpose(2, 0, 1)
        score = self.score[piece]
        score[:, 1] = np.where(np.isneginf(score[:, 1]), self.unknown, score[:, 1])
        best = np.full((count, length + 1), -np.inf)
        best[:, 0] = 0
        back = np.ones((count, length + 1), np.int32)
        lengths = sorted({1, *probed})
        for end in range(1, length + 1):
            for n in lengths:
                if n > end:
                    break
                sum_ = best[:, end - n] + score[:, n, end - n]
                more = sum_ > best[:, end]
                best[more, end], back[more, end] = sum_[more], n
        at, rows = np.full(count, length), np.arange(count)
        steps, starts = [], []
        while (at > 0).any():
            n = np.where(at > 0, back[rows, at], 0)
            at = at - n
            steps.append(np.where(n > 0, piece[rows, n, np.minimum(at, length - 1)], -2))
            starts.append(at)
        ids, start = np.stack(steps[::-1], 1), np.stack(starts[::-1], 1)
        return [self.spelt(i[i != -2], t[s[i != -2]])[0] for i, s, t in zip(ids, start, text)]

    def search_long(self, text: np.ndarray) -> np.ndarray:
        """The same search over one long word, in blocks of positions and with plain lists."""
        length = len(text)
        best, back, ids = [0.0] + [-np.inf] * length, [1] * (length + 1), [-1] * (length + 1)
        for s in range(0, length, LONG):
            part = text[s : s + LONG + self.longest - 1][:, None]
            piece = self.all_probed(part)[1][:, :LONG, 0]
            scores, pieces = self.score[piece].tolist(), piece.tolist()
            for k in range(min(LONG, length - s)):
                here = best[s + k]
                for n in range(1, min(self.longest, length - s - k) + 1):
                    v, p = scores[n][k], pieces[n][k]
                    if n == 1 and p < 0:
                        v = self.unknown
                    end = s + k + n
                    # starts come in order, so of equal sums the later start, the shorter piece, wins
                    if v > -np.inf and here + v >= best[end]:
                        best[end], back[end], ids[end] = here + v, n, p
        out, starts, at = [], [], length
        while at > 0:
            out.append(ids[at])
            at -= back[at]
            starts.append(at)
        return self.spelt(np.array(out[::-1]), text[starts[::-1]])[0]

    def spelt(self, ids: np.ndarray, characters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids, where each -1 gives way to the bytes of its character, and how many stand for each."""
        n = np.ones(len(ids), np.int64)
        at = np.flatnonzero(ids == -1)
        if not len(at):
            return ids, n
        kinds, kind = np.unique(characters[at], return_inverse=True)
        spelt = [(SPACE if chr(c) == LITERAL else chr(c)).encode() for c in kinds.tolist()]
        length = np.array([len(b) for b in spelt])
        flat = self.byte_ids[np.frombuffer(b"".join(spelt), np.uint8)]
        n[at] = length[kind]
        out = np.repeat(ids, n)
        out[C.gathered((np.cumsum(n) - n)[at], n[at])] = flat[C.gathered((np.cumsum(length) - length)[kind], n[at])]
        return out, n

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words by the greatest sum of scores, and how many each has."""
        return self.by_groups(words, self.search, self.search_long)

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words by merges, as the library gives them, and how many each has."""
        return self.by_groups(words, self.merge, self.merge_long)

    def by_groups(self, words: list[str], search: Callable[[np.ndarray], list[np.ndarray]], search_long: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(w) for w in words])
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        for n in np.unique(size).tolist():
            at = np.flatnonzero(size == n)
            step = max(1, min(GROUP, 4_000_000 // (n * (self.longest + 1))))
            for s in range(0, len(at), step):
                some = at[s : s + step]
                text = codes([words[k] for k in some]).reshape(-1, n)
                found = search(text) if n < LONG else [search_long(t) for t in text]
                for k, ids in zip(some.tolist(), found):
                    out[k] = ids
        return np.concatenate(out) if out else np.zeros(0, np.int64), np.array([len(x) for x in out], np.int64)

    def decode(self, flat: np.ndarray, lengths: np.ndarray) -> list[str]:
        n = self.byte_length[flat]
        data = self.bytes[C.gathered(self.byte_start[flat], n)].tobytes()
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(lengths)])].tolist()
        return [data[a + 1 : z].decode() if z > a else "" for a, z in zip(ends[:-1], ends[1:])]


def split_words(text: str) -> list[str]:
    return WORD.findall(SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE)) if text else []


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


_workers: dict[str, tuple[Pieces, WordCache]] = {}


def worker(path: str) -> tuple[Pieces, WordCache]:
    """The vocabulary and word cache of this Python worker, kept from task to task."""
    if path not in _workers:
        pieces = Pieces.load(path)
        _workers[path] = pieces, WordCache(pieces.merge_words, CACHED_WORDS)
    return _workers[path]


def add_pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with the columns piece_ids and decoded (the text made from the ids), named anew if they clash."""
    C.small_batches(docs.sparkSession)
    path = path or model_path()
    ids_name, text_name = C.unused("piece_ids", docs.columns), C.unused("decoded", docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, cache = worker(path)
        for b in batches:
            flat, n = cache.ids([split_words(t or "") for t in b.column("text").to_pylist()])
            flat = flat.astype(np.int32)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.array(flat))
            yield b.append_column(ids_name, lists).append_column(text_name, pa.array(pieces.decode(flat, n), pa.string()))

    schema = StructType([*docs.schema.fields, StructField(ids_name, ArrayType(IntegerType())), StructField(text_name, StringType())])
    return docs.mapInArrow(run, schema)


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    df = add_pieces(C.documents(C.table(spark, sf_dir, "documents")))
    # ids_crc32: of the ids in decimal, comma-joined
    return df.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_pieces"),
        F.crc32(F.concat_ws(",", F.transform("piece_ids", lambda i: i.cast("string")))).alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
