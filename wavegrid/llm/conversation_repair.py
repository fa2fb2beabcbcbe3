"""Conversation repair: cheapest edits by Dial's bucket queue, whose audit is a lexicographic walk along tight arcs.

A repaired conversation's role initials read ``(s?(ua)+)?``. Its graph has a node for each number of rows passed and each
state of that pattern; arcs are the edits: Keep 0, Rerole to user or assistant 1, Delete 2, Insert an empty user or
assistant text 5, and 5 more where a truncated row isn't deleted. Costs are small integers, so distances to the goal
come from a queue of buckets. From the start, the walk takes at each node the ASCII-least edit whose cost is what the
distance falls by.

*Segments.* Rows sorted by conversation and turn in ranges over all tasks are cut into segments of one conversation and at
most ``ROWS`` rows or about ``CHARS`` characters. Most are whole conversations and are repaired where they stand. Those of a
longer conversation, or at an edge of a range, are put together: each is first summed up as the least cost from every
state before it to every state after it (four queues), streams over these sums give each segment the costs that
follow it and then the state that it starts in, and the texts are repaired in segments again. Only the audit and the
hash of a conversation run through one task, as a stream.

Defined results: a null role or text, and a null conv_id or turn in the hashed key, is one space; rows without a conv_id
are one conversation, whose conv_id is null. Rows of one turn are taken by role, then text. An empty or damaged-away
conversation has zeros, an empty audit and the hash of an empty text. Repeated rows are duplicates like others. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Rows and characters of a segment.
ROWS, CHARS = 2048, 1_000_000
SPACE = " \t\n\x0b\x0c\r"
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATION = 0, 1, 2, 5, 5
#: States: nothing yet, after a system row, after a user row, after an assistant row; the pattern may end in the first and last.
STATES, FAR = 4, 1 << 40
#: The state after a row of the given role initial.
AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The state after the only role that a changed or new row can have, and that role.
TURN, ROLE = (2, 2, 3, 2), {2: "user", 3: "assistant"}
#: What an end of all rows still costs in each state: the inserts that complete the pattern.
ENDS = (0, 2 * INSERT, INSERT, 0)

_SEGMENT = "seg long, conv_id long, open boolean, turn array<long>, role array<string>, text array<string>"
_PART = "seg long, conv_id long, counts array<long>, turns array<long>, edges array<string>, audit string, text string"
_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that each row's key asks for; dropped rows stay as ``lost``."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = (F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20).alias("k")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"), k)
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("k") == 0).alias("lost"), copies.alias("copy")).drop("copy")


def _segments(rows: int, chars: int):
    """Sorted rows, whole conversations or parts of them; ``open`` where another segment may hold more of the conversation."""

    def cuts(conv: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Where segments start; ``conv`` numbers the runs of a conversation."""
        starts, n, held = [0], 0, 0
        new = np.append(False, conv[1:] != conv[:-1]).tolist()
        for i, (edge, c) in enumerate(zip(new, size.tolist())):
            if edge or n >= rows or (n and held + c > chars):
                starts.append(i)
                n = held = 0
            n, held = n + 1, held + c
        return np.array(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seg, rest, first = TaskContext.get().partitionId() << 32, None, True
        for b in itertools.chain(batches, [None]):
            t = [x for x in (rest, b) if x is not None and x.num_rows]
            if not t:
                continue
            t = pa.Table.from_batches(t).combine_chunks()
            names = t.column("conv_id").fill_null(0).to_numpy()
            null = t.column("conv_id").is_null().to_numpy()
            conv = np.cumsum(np.append(False, (null[1:] != null[:-1]) | ~null[1:] & (names[1:] != names[:-1])))
            starts = cuts(conv, t.column("size").to_numpy())
            stops = np.append(starts[1:], t.num_rows)
            inner = np.append(conv[starts][1:] == conv[starts][:-1], b is None)  # the last one of all may go on in the next range
            is_open = inner | np.append(first, inner[:-1])
            last = len(starts) - (b is not None)
            if last:
                offsets = pa.array(np.append(starts[:last], stops[last - 1]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, t.column(c).combine_chunks().slice(0, stops[last - 1])) for c in ("turn", "role", "text")]
                heads = [pa.array(np.arange(seg, seg + last)), t.column("conv_id").combine_chunks().take(pa.array(starts[:last])), pa.array(is_open[:last])]
                yield pa.RecordBatch.from_arrays([*heads, *lists], names=["seg", "conv_id", "open", "turn", "role", "text"])
                seg += last
                # what goes on keeps its flag: a segment before it may have been of its conversation
                first = bool(last < len(starts) and is_open[last])
            rest = None if b is None else t.slice(starts[-1]).to_batches()[0]

    return run


def faults(role: list[str], text: list[str], seen: set[str] | None = None) -> list[int]:
    """The first fault of each row; ``seen`` are keys of rows that earlier segments hold."""
    out, known = [], set()
    for pair in zip(role, text):
        bare = pair[1].strip(SPACE)
        if not bare:
            out.append(BLANK)
        elif pair in known or (seen and row_key(*pair) in seen):
            out.append(DUPLICATE)
        else:
            out.append(OK if bare[-1] in ".!?" else TRUNCATED)
        known.add(pair)
    return out


def row_key(role: str, text: str) -> str:
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def edits(fault: int, role: str, state: int, inserting: bool = True) -> list[tuple[str, int, int, int]]:
    """(initial, cost, rows passed, next state) of the edits of a row in a state, in the order of their initials."""
    out = [("D", DELETE, 1, state)]
    if inserting:
        out.append(("I", INSERT, 0, TURN[state]))
    if fault in (OK, TRUNCATED):
        more = TRUNCATION if fault == TRUNCATED else 0
        if role[:1] in AFTER[state]:
            out.append(("K", KEEP + more, 1, AFTER[state][role[:1]]))
        out.append(("R", REROLE + more, 1, TURN[state]))
    return out


def distances(role: list[str], fault: list[int], ends: list[int]) -> list[int]:
    """Of each node (row * STATES + state) the least cost to pass all rows and then ``ends``: Dial's algorithm, backwards."""
    n = len(role)
    arcs: list[list[tuple[int, int]]] = [[] for _ in range((n + 1) * STATES)]  # into a node: (from, cost)
    for i in range(n):
        for q in range(STATES):
            for _, cost, passed, to in edits(fault[i], role[i], q):
                arcs[(i + passed) * STATES + to].append((i * STATES + q, cost))
    dist = [FAR] * len(arcs)
    base = min(ends)
    buckets: list[list[int]] = [[] for _ in range(max(e - base for e in ends if e < FAR) + DELETE * n + 2 * INSERT + 1)]
    for q, e in enumerate(ends):
        if e < FAR:
            dist[n * STATES + q] = e
            buckets[e - base].append(n * STATES + q)
    for d, bucket in enumerate(buckets, base):
        for node in bucket:  # grows while arcs of cost 0 are followed
            if dist[node] == d:
                for before, cost in arcs[node]:
                    if d + cost < dist[before]:
                        dist[before] = d + cost
                        if d + cost - base < len(buckets):
                            buckets[d + cost - base].append(before)
    return dist


def walk(role: list[str], fault: list[int], dist: list[int], state: int) -> tuple[str, int]:
    """The ASCII-least audit among the cheapest from a state, and the state after the last row."""
    i, audit = 0, []
    while i < len(role):
        here = dist[i * STATES + state]
        for letter, cost, passed, to in edits(fault[i], role[i], state):
            if here == cost + dist[(i + passed) * STATES + to]:
                audit.append(letter)
                i, state = i + passed, to
                break
    return "".join(audit), state


def repaired(role: list[str], text: list[str], audit: str, state: int) -> list[str]:
    """The ``role:text`` rows that an audit leaves."""
    out, i = [], 0
    for letter in audit:
        if letter in "KR":
            state = AFTER[state][role[i][:1]] if letter == "K" else TURN[state]
            out.append(f"{role[i] if letter == 'K' else ROLE[state]}:{text[i]}")
        elif letter == "I":
            state = TURN[state]
            out.append(f"{ROLE[state]}:")
        i += letter != "I"
    return out


def closing(state: int) -> str:
    """The inserts that complete the pattern after all rows."""
    return "I" * (ENDS[state] // INSERT)


def illegal(role: list[str]) -> int:
    return sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(role, role[1:]))


def gap(first: int | None, last: int | None, distinct: int) -> int:
    return 0 if first is None else last - first + 1 - distinct


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of one segment."""
    for b in batches:
        out = []
        for conv, turn, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text"))):
            fault = faults(role, text)
            dist = distances(role, fault, ENDS)
            audit, state = walk(role, fault, dist, 0)
            turns = {t for t in turn if t is not None}
            lines = repaired(role, text, audit + closing(state), 0)
            gaps = gap(min(turns, default=None), max(turns, default=None), len(turns))
            out.append((conv, gaps, *map(fault.count, (BLANK, DUPLICATE, TRUNCATED)), illegal(role), dist[0], audit + closing(state), _sha("\n".join(lines))))
        yield _batch(out, _RESULT)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    names, types = zip(*(x.split(" ") for x in schema.split(", ")))
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, t in zip(columns, types)], names=list(names))


def _opened(b: pa.RecordBatch, *more: str) -> Iterator[tuple]:
    """(seg, conv_id, role, text, faults, further columns) of each segment."""
    columns = (b.column(c).to_pylist() for c in ("seg", "conv_id", "role", "text", "seen", *more))
    for seg, conv, role, text, seen, *rest in zip(*columns):
        yield seg, conv, role, text, faults(role, text, set(seen or ())), *rest


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``costs``: from each state before a segment to each state after it."""
    for b in batches:
        out = []
        for seg, conv, role, _, fault in _opened(b):
            to = [distances(role, fault, [0 if q == e else FAR for q in range(STATES)])[:STATES] for e in range(STATES)]
            out.append((seg, conv, [to[e][q] for q in range(STATES) for e in range(STATES)]))
        yield _batch(out, "seg long, conv_id long, costs array<long>")


def _following(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums sorted by conversation, last segment first: ``ends``, what follows a segment costs from each state."""
    conv, ends = object(), ENDS
    for b in batches:
        out = []
        for seg, name, costs in zip(*(b.column(c).to_pylist() for c in ("seg", "conv_id", "costs"))):
            conv, ends = (conv, ends) if name == conv else (name, list(ENDS))
            out.append((seg, ends))
            ends = [min(FAR, *(costs[q * STATES + e] + ends[e] for e in range(STATES))) for q in range(STATES)]
        yield _batch(out, "seg long, ends array<long>")


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``after``: the state in which each walk through a segment ends."""
    for b in batches:
        out = []
        for seg, conv, role, _, fault, ends in _opened(b, "ends"):
            dist = distances(role, fault, ends)
            out.append((seg, conv, [walk(role, fault, dist, q)[1] for q in range(STATES)]))
        yield _batch(out, "seg long, conv_id long, after array<long>")


def _starting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks sorted by conversation and segment: the state that each starts in."""
    conv, state = object(), 0
    for b in batches:
        out = []
        for seg, name, after in zip(*(b.column(c).to_pylist() for c in ("seg", "conv_id", "after"))):
            conv, state = (conv, state) if name == conv else (name, 0)
            out.append((seg, state))
            state = after[state]
        yield _batch(out, "seg long, state long")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for seg, conv, role, text, fault, turn, ends, state in _opened(b, "turn", "ends", "state"):
            audit, last = walk(role, fault, distances(role, fault, ends), state)
            turns = sorted({t for t in turn if t is not None})
            counts = [*map(fault.count, (BLANK, DUPLICATE, TRUNCATED)), illegal(role), _cost(audit, fault), last, len(turns)]
            lines = repaired(role, text, audit, state)
            out.append((seg, conv, counts, turns[:: max(1, len(turns) - 1)], [role[0], role[-1]], audit, "\n".join(lines) if lines else None))
        yield _batch(out, _PART)


def _cost(audit: str, fault: list[int]) -> int:
    price, i, total = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}, 0, 0
    for letter in audit:
        total += price[letter] + (TRUNCATION if letter in "KR" and fault[i] == TRUNCATED else 0)
        i += letter != "I"
    return total


class _Joined:
    """A conversation whose parts come one after another; it holds its audit and a hash in progress, no texts."""

    def __init__(self, conv: int | None):
        self.conv, self.counts, self.distinct, self.state, self.cost = conv, [0] * 4, 0, 0, 0
        self.first = self.last = self.role = None
        self.audit, self.hash, self.lines = [], hashlib.sha256(), False

    def lines_of(self, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + text).encode())
        self.lines = True

    def add(self, counts: list[int], turns: list[int], edges: list[str], audit: str, text: str | None) -> None:
        self.counts = [a + b for a, b in zip(self.counts, counts[:4])]
        self.counts[3] += self.role is not None and illegal([self.role, edges[0]])
        self.role, self.cost, self.state = edges[1], self.cost + counts[4], counts[5]
        if turns:
            self.distinct += counts[6] - (self.last == turns[0])
            self.first, self.last = turns[0] if self.first is None else self.first, turns[-1]
        self.audit.append(audit)
        if text is not None:
            self.lines_of(text)

    def row(self) -> tuple:
        for line in repaired([], [], closing(self.state), self.state):
            self.lines_of(line)
        audit = "".join(self.audit) + closing(self.state)
        return (self.conv, gap(self.first, self.last, self.distinct), *self.counts, self.cost + ENDS[self.state], audit, self.hash.hexdigest())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts sorted by conversation and segment."""
    now = None
    for b in batches:
        done = []
        for conv, *part in zip(*(b.column(c).to_pylist() for c in ("conv_id", "counts", "turns", "edges", "audit", "text"))):
            if now is None or now.conv != conv:
                done += [now.row()] if now else []
                now = _Joined(conv)
            now.add(*part)
        yield _batch(done, _RESULT)
    if now:
        yield _batch([now.row()], _RESULT)


def repaired_conversations(rows: DataFrame, segment_rows: int = ROWS, segment_chars: int = CHARS) -> DataFrame:
    """A row for each conversation of a table of damaged rows (``damaged``); see the module for its columns."""
    C.small_batches(rows.sparkSession)
    head = F.substring("text", 1, 32)  # decides between ranges; within them whole texts are compared
    kept = rows.where("NOT lost").select("conv_id", "turn", "role", "text", F.length("text").cast("long").alias("size"))
    in_order = kept.repartitionByRange("conv_id", "turn", "role", head).sortWithinPartitions("conv_id", "turn", "role", "text")
    segments = C.work_table(in_order.mapInArrow(_segments(segment_rows, segment_chars), _SEGMENT), "segments")
    whole = segments.where("NOT open").mapInArrow(_whole, _RESULT)
    return whole.union(_long_conversations(segments.where("open"))).union(_without_rows(rows))


def _without_rows(rows: DataFrame) -> DataFrame:
    lost = rows.groupBy("conv_id").agg(F.min("lost").alias("lost")).where("lost")
    return lost.select("conv_id", *[F.lit(0).cast("long")] * 6, F.lit(""), F.lit(_sha("")))


def _long_conversations(segments: DataFrame) -> DataFrame:
    key = lambda x: F.md5(F.concat(F.length(x["role"]).cast("string"), F.lit(":"), x["role"], x["text"]))
    keys = segments.select("seg", "conv_id", F.explode(F.array_distinct(F.transform(F.arrays_zip("role", "text"), key))).alias("key"))
    # a conversation's key that several segments hold is a duplicate in all but the first
    first = keys.groupBy("conv_id", "key").agg(F.min("seg").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select(F.col("conv_id").alias("conv"), F.col("key").alias("held"), "first")
    again = keys.join(first, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("key") == F.col("held"))).where("seg > first")
    seen = again.groupBy("seg").agg(F.collect_list("key").alias("seen"))
    opened = C.work_table(segments.join(seen, "seg", "left"), "open-segments")
    sums = opened.mapInArrow(_sums, "seg long, conv_id long, costs array<long>")
    by_conv = lambda df, *order: df.repartition("conv_id").sortWithinPartitions("conv_id", *order)
    ends = C.saved(by_conv(sums, F.desc("seg")).mapInArrow(_following, "seg long, ends array<long>"))
    opened = opened.join(ends, "seg")
    walks = opened.mapInArrow(_walks, "seg long, conv_id long, after array<long>")
    state = by_conv(walks, "seg").mapInArrow(_starting, "seg long, state long")
    parts = opened.join(state, "seg").mapInArrow(_parts, _PART)
    return by_conv(parts, "seg").mapInArrow(_joined, _RESULT)


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repaired_conversations(damaged(C.table(spark, sf_dir, "conversations")))
