"""SimHash near-dedup, conversation repair and whitening against plain versions and SQL."""

import itertools
import random
import zlib

import numpy as np
import plain
import pytest
import xxhash
from pyspark.sql import functions as F

from wavegrid.llm import conversation_repair as repair
from wavegrid.llm import simhash, whitening

BLANK = " \t\n\x0b\x0c\r"


# --- SimHash ---------------------------------------------------------------------------------------------------------


def fingerprint(text):
    w = plain.WORD.findall(text.translate(plain.LOWER))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(rows, radius=2):
    """(doc_id, fingerprint, component_id), by comparing all with all."""
    marks = [fingerprint(t) for _, t in rows]
    least = [d for d, _ in rows]
    near = [[j for j, y in enumerate(marks) if (x ^ y).bit_count() <= radius] for x in marks]
    while True:
        new = [min(least[j] for j in near[i]) for i in range(len(rows))]
        if new == least:
            return sorted((d, f"{m:016x}", c) for (d, _), m, c in zip(rows, marks, least))
        least = new


def shown(df):
    return sorted(map(tuple, df.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")), "component_id").collect()))


@pytest.mark.parametrize("kind", ["documents", "odd", "none", "clash"])
def test_simhash(spark, kind):
    docs = {"documents": lambda: plain.read(spark, "documents"), "odd": lambda: plain.odd_documents(spark), "none": lambda: plain.no_documents(spark), "clash": lambda: plain.clashing_documents(spark)}[kind]()
    assert shown(simhash.near_duplicates(docs)) == groups(plain.texts(docs))


def test_simhash_query(spark):
    got = simhash.op11_simhash_near_dedup(spark, plain.SF)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect())) == groups(plain.texts(plain.read(spark, "documents")))


@pytest.mark.parametrize("parts, tile", [(8, 1 << 14), (8, 3), (4, 5), (1, 7), (2, 1)])
def test_tiles_lose_no_link(spark, parts, tile):
    r = random.Random(parts * 100 + tile)
    marks = {r.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1, 1 << 63}
    for m in list(marks):
        for _ in range(3):
            marks.add(m := m ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    hot = r.getrandbits(64)
    marks |= {hot ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)}  # many of one cell
    marks = sorted(m - (1 << 64) if m >> 63 else m for m in marks)
    df = spark.createDataFrame([(m,) for m in marks], "bits long").repartition(5)
    found = [tuple(x) for x in simhash.links(df, 2, parts, tile).collect()]
    low = (1 << 64) - 1
    assert all(((a ^ b) & low).bit_count() <= 2 and a != b for a, b in found)

    def parted(links):
        up = {m: m for m in marks}

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in links:
            a, b = sorted((top(a), top(b)))
            up[b] = a
        return {m: top(m) for m in marks}

    every = [(a, b) for a, b in itertools.combinations(marks, 2) if ((a ^ b) & low).bit_count() <= 2]
    assert parted(found) == parted(every)
    assert len(found) <= 2 * len(every)


def test_steps_reach_each_pair_of_cells_once():
    cells = lambda v: sum(x << (7 * p) for p, x in enumerate(v))
    vectors = list(itertools.product(range(5), repeat=3))
    steps = set(simhash.steps(2, 3))
    for v, w in itertools.product(vectors, vectors):
        near = sum(abs(a - b) for a, b in zip(v, w)) <= 2
        assert ((cells(w) - cells(v) in steps) + (v != w and cells(v) - cells(w) in steps)) == near


# --- Conversation repair ---------------------------------------------------------------------------------------------


def damaged(rows):
    """(conv, turn, role, text), sorted, of every conversation."""
    out = {c: [] for c, *_ in rows}
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else text.translate({ord(c): None for c in ".!?"}) if k == 2 else text
        row = (turn is not None, turn or 0, "user" if k == 4 else role, text)
        out[conv] += [row] * (0 if k == 0 else 2 if k == 3 else 1)
    return {c: sorted(v) for c, v in out.items()}


def plain_repair(rows):
    """One conversation's result, by carrying the best (cost, audit) of each state forwards."""
    seen, kinds = set(), []
    for _, _, role, text in rows:
        bare = text.strip(BLANK)
        kinds.append("b" if not bare else "d" if (role, text) in seen else "." if bare[-1] in ".!?" else "t")
        seen.add((role, text))
    best = {"": (0, "", ())}  # what the initials so far may look like: "", "s", "u", "a"
    ok = {"": "su", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}

    def offer(to, state, found):
        to[state] = min(to.get(state, found), found, key=lambda x: x[:2])

    def inserted(states):
        out = dict(states)
        for _ in range(3):
            for q, (c, audit, lines) in list(out.items()):
                for x in ok[q].replace("s", ""):
                    offer(out, x, (c + 5, audit + "I", (*lines, f"{full[x]}:")))
        return out

    for (_, _, role, text), kind in zip(rows, kinds):
        new = {}
        for q, (c, audit, lines) in inserted(best).items():
            offer(new, q, (c + 2, audit + "D", lines))
            if kind in ".t":
                more = 5 * (kind == "t")
                if role[:1] and role[:1] in ok[q]:
                    offer(new, role[0], (c + more, audit + "K", (*lines, f"{role}:{text}")))
                for x in ok[q].replace("s", ""):
                    offer(new, x, (c + 1 + more, audit + "R", (*lines, f"{full[x]}:{text}")))
        best = new
    cost, audit, lines = min((v for q, v in inserted(best).items() if q in ("", "a")), key=lambda x: x[:2])
    turns = [t for has, t, _, _ in rows if has]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, kinds.count("b"), kinds.count("d"), kinds.count("t"), illegal, cost, audit, plain.sha("\n".join(lines))


def expected(rows):
    return sorted(((c, *plain_repair(v)) for c, v in damaged(rows).items()), key=str)


COLUMNS = "conv_id long, turn long, role string, text string, seg long, lost boolean, open string, copy int"


def conversations(spark, rows):
    """Other columns take names that the operator uses inside."""
    return spark.createDataFrame([(*r, 1, True, "o", 3) for r in rows], COLUMNS)


def random_rows(seed, convs=40, longest=14):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t\n", None, "a.\x85", "same. ", ".", "é\n"]
    roles = ["user", "assistant", "system", None, "", "tool", "u", "user", "assistant"]
    rows = [(c, t, roles[(t + 1) % 2] if r.random() < 0.5 else r.choice(roles), r.choice(texts)) for c in range(convs) for t in range(r.randrange(longest))]
    rows += [(None, t, "user", "x.") for t in range(5)] + [(convs + 1, None, r.choice(roles), r.choice(texts)) for _ in range(6)]
    rows += [(convs + 2, t, "user", "One. Two") for t in (7, -3, 7, 7, 20, 1 << 40)]
    return rows + r.sample(rows, 10)


def test_conversations(spark):
    rows = [tuple(x) for x in plain.read(spark, "conversations").collect()]
    got = repair.op12_conversation_repair(spark, plain.SF)
    assert got.columns == [x.split(" ")[0] for x in repair._RESULT.split(", ")]
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


@pytest.mark.parametrize("seed, rows, chars", [(1, 2048, 1_000_000), (2, 3, 1_000_000), (3, 1, 10), (4, 2, 5), (5, 7, 40)])
def test_odd_conversations(spark, seed, rows, chars):
    """Whole conversations and segments of a few rows give the same."""
    given = random_rows(seed)
    out = repair.repaired_conversations(repair.damaged(conversations(spark, given).repartition(3)), rows, chars)
    assert sorted(map(tuple, out.collect()), key=str) == expected(given)


def test_hot_conversation(spark):
    r = random.Random(9)
    given = [(7, t, r.choice(["user", "assistant", "assistant"]), r.choice(["Hello there.", f"turn {t}.", "cut"])) for t in range(1500)]
    given += [(c, 0, "user", "a" * 3000 + ".") for c in range(30)]
    out = repair.repaired_conversations(repair.damaged(conversations(spark, given).repartition(6)), 50)
    assert sorted(map(tuple, out.collect()), key=str) == expected(given)


def test_no_conversations(spark):
    assert repair.repaired_conversations(repair.damaged(conversations(spark, []))).collect() == []
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    out = repair.repaired_conversations(repair.damaged(conversations(spark, [(5, gone, "user", "x.")]))).collect()
    assert list(map(tuple, out)) == [(5, 0, 0, 0, 0, 0, 0, "", plain.sha(""))]


@pytest.mark.parametrize("seed", range(30))
def test_walks_are_cheapest_and_least(seed):
    r = random.Random(seed)
    n = r.randrange(9)
    role = [r.choice(["user", "assistant", "system", "tool", ""]) for _ in range(n)]
    fault = [r.choice([repair.OK, repair.OK, repair.BLANK, repair.TRUNCATED, repair.DUPLICATE]) for _ in range(n)]
    dist = repair.distances(role, fault, repair.ENDS)
    audit, state = repair.walk(role, fault, dist, 0)
    # the bucket queue against a relaxation of all arcs
    slow = [repair.FAR] * (n * 4) + list(repair.ENDS)
    for _ in range(4 * n + 4):
        for i, q in itertools.product(range(n), range(4)):
            slow[4 * i + q] = min(c + slow[4 * (i + p) + to] for _, c, p, to in repair.edits(fault[i], role[i], q))
    assert dist == slow
    assert repair._cost(audit, fault) + repair.ENDS[state] == dist[0]


# --- Whitening -------------------------------------------------------------------------------------------------------


def exact_whitening(rows, components=16):
    """vec_id to (n, deviation, |whitened|, explained), by the eigenvectors of the exact covariance."""
    xs = [(i, [int(np.floor(64.0 * float(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[n * c - s for c, s in zip(x, sums)] for x in fit], float) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    out = []
    for i, x in xs:
        k = [n * c - s for c, s in zip(x, sums)]
        out.append((i, n, sum(c * c for c in k), np.array(k, float) / n @ u / np.sqrt(e)))
    return out, e / np.trace(centred.T @ centred / n)


def compared(got, rows):
    wanted, explained = exact_whitening(rows)
    by_row = {}
    for r in sorted(got, key=lambda r: (str(r["vec_id"]), r["deviation"], r["component"])):
        by_row.setdefault((r["vec_id"], r["deviation"], r["component"]), []).append(r)
    assert len(got) == len(wanted) * len(explained)
    z = {}
    for i, n, dev, w in wanted:
        for k, value in enumerate(w):
            r = by_row[(i, dev, k + 1)][0]
            assert r["n"] == n and r["explained"] == pytest.approx(explained[k], rel=1e-6) and r["identity_error"] < 1e-4
            z.setdefault(k, []).append((r["whitened"], value))
    for pairs in z.values():  # either sign, the same for all rows
        a, b = np.array(pairs).T
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6 * max(1, np.abs(b).max())


def test_whitening(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in plain.read(spark, "embeddings").collect()]
    got = whitening.op13_embedding_whitening(spark, plain.SF)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compared(got.collect(), rows)


def test_whitening_of_odd_rows(spark):
    r = np.random.default_rng(3)
    vectors = [(i, v.tolist()) for i, v in enumerate(r.normal(0, 3, (40, 5)) * [5, 4, 3, 2, 1])]
    odd = [(90, None), (91, [1.0, None, 0.0, 0.0, 0.0]), (92, [float("nan")] * 5), (93, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (0, vectors[0][1]), (0, vectors[1][1]), (None, vectors[2][1])]
    rows = vectors + odd + [(200 + i, vectors[3][1]) for i in range(30)]
    df = spark.createDataFrame([(i, v, 5) for i, v in rows], "vec_id long, embedding array<double>, n int").repartition(7)
    for fanout in (2, 16):
        compared(whitening.whitened(df, fanout=fanout).collect(), rows)


def test_whitening_of_little(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whitened(make([])).collect() == []
    assert whitening.whitened(make([(1, []), (2, None)])).collect() == []
    one = whitening.whitened(make([(1, [0.5, 2.0]), (2, [0.5, 2.0])])).collect()
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in sorted(one)] == [(v, c, 1, 0, None, None) for v in (1, 2) for c in (1, 2)]
    line = whitening.whitened(make([(1, [0.0, 0.0, 0.0]), (2, [1.0, 1.0, 1.0]), (3, [4.0])])).collect()
    flat = [r for r in line if r["vec_id"] < 3]
    assert sorted(abs(r["whitened"]) for r in flat if r["component"] == 1) == pytest.approx([1, 1])
    assert {r["whitened"] for r in flat if r["component"] > 1} == {None} and {r["n"] for r in line if r["vec_id"] == 3} == {1}
    with pytest.raises(Exception, match="an entry is"):
        whitening.whitened(make([(1, [3e30])])).collect()


@pytest.mark.parametrize("seed", range(8))
def test_merged_states_are_those_of_all_rows(seed):
    r = np.random.default_rng(seed)
    d = 1 + seed
    x = (r.normal(0, 50, (3 * seed + 4, d)) * np.arange(1, d + 1)).astype(np.int64) + whitening.OFFSET + 10**9 * (seed % 2)
    parts = np.array_split(x, 4)
    states = [whitening.state_of(p) for p in parts if len(p)]
    state = whitening.merged(whitening.merged(states[0], states[1]), states[2])
    state = whitening.merged(state, states[3]) if len(states) > 3 else state
    n, sums, values, vectors = state
    assert n == len(x) and (sums == (x - whitening.OFFSET).sum(0)).all()
    centred = x - x.mean(0)
    assert np.allclose((values[:, None] * vectors).T @ (values[:, None] * vectors), centred.T @ centred, rtol=1e-9, atol=1e-5 * np.abs(centred).max() ** 2)
    assert len(values) == min(d, len(values)) and np.allclose(vectors @ vectors.T, np.eye(len(vectors)))


def test_deviation_that_does_not_fit():
    m = whitening.Model(whitening.state_of(np.array([[0, 0], [1 << 33, 5]], np.int64) + whitening.OFFSET))
    assert m.deviation(np.array([[1 << 33, 5], [0, 0]], np.int64) + whitening.OFFSET) == [None, None]
