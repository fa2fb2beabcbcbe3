"""Substring, line and near dedup and decontamination against plain versions and SQL."""

import random

import duckdb
import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from wavegrid.llm import common as C
from wavegrid.llm import decontamination, line_dedup, near_dedup, queries, substring_dedup
from wavegrid.llm.components import components

INPUTS = ["documents", "odd", "none", "clash"]


def given(spark, kind):
    return {"documents": lambda: plain.read(spark, "documents"), "odd": lambda: plain.odd_documents(spark), "none": lambda: plain.no_documents(spark), "clash": lambda: plain.clashing_documents(spark)}[kind]()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{plain.SF}/{t}.parquet'")
    got = queries.queries()[name](spark, plain.SF)
    cursor = con.execute(queries.oracle_sql()[name])
    assert [d[0] for d in cursor.description] == got.columns
    assert sorted(cursor.fetchall()) == sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("kind", INPUTS)
def test_substrings(spark, kind):
    docs = given(spark, kind)
    got = substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_text")
    assert sorted(map(tuple, got.collect())) == plain.without_repeats(plain.texts(docs))


def test_substrings_in_many_groups(spark):
    """Groups of a few words, a passage in a third of all documents, and prefixes that one passage dominates."""
    r = random.Random(1)
    common = [f"c{i}" for i in range(40)]
    rows = [(i, " ".join([f"w{r.randrange(30)}" for _ in range(60)] + (common[r.randrange(10) :] if i % 3 else []) + ["a"] * (i % 5 * 7))) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = substring_dedup.remove_repeats(docs, group_bytes=400).select("doc_id", "n_words", "n_removed", "kept_text")
    assert sorted(map(tuple, got.collect())) == plain.without_repeats(rows)


@pytest.mark.parametrize("seed", range(6))
def test_subtrees(seed, monkeypatch):
    """Common prefixes and deep nodes of sorted suffixes against all pairs of suffixes."""
    monkeypatch.setattr(substring_dedup, "COMPARED", 7)
    r = np.random.default_rng(seed)
    text, depth = r.integers(0, 3, 40 * seed + 8).astype(np.uint32), 4
    begin = np.arange(0, len(text) - depth + 1) if seed else np.zeros(0, np.int64)
    doc = r.integers(0, 5, len(begin))
    suffixes = substring_dedup._suffixes(text, begin, np.zeros(len(begin), np.uint32), depth)
    order = np.lexsort(suffixes.T[::-1])
    shared = lambda a, b: next((k for k in range(depth + 1) if a[k] != b[k]), depth + 1)
    wanted = [0, *(shared(suffixes[a], suffixes[b]) for a, b in zip(order, order[1:]))][: len(order)]
    assert substring_dedup.common_prefixes(suffixes, order).tolist() == wanted
    smallest, inner = substring_dedup.subtree(suffixes, doc)
    for i, s in enumerate(suffixes):
        leaves = {int(d) for d, o in zip(doc, suffixes) if (o == s).all()}
        assert (smallest[i], inner[i]) == (doc[i] == min(leaves), len(leaves) > 1)


@pytest.mark.parametrize("kind", INPUTS)
def test_lines(spark, kind):
    docs = given(spark, kind)
    got = line_dedup.first_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_text")
    expected = plain.without_lines(plain.texts(docs))
    assert sorted(map(tuple, got.collect())) == expected
    left = line_dedup.drop_lines(docs)
    assert left.columns == docs.columns and left.count() == docs.count()
    assert sorted((r["doc_id"], r["text"] or "") for r in left.collect() if r["doc_id"] is not None) == sorted((d, t) for d, _, _, t in expected)


def test_lines_over_many_tasks(spark):
    rows = [(i, "\n".join(["The very common line " + "x" * (i % 2), f"line of its own {i}", f"a line of ten {i // 10}"])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    got = line_dedup.first_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_text")
    assert sorted(map(tuple, got.collect())) == plain.without_lines(rows)


@pytest.mark.parametrize("kind", INPUTS)
def test_near_duplicates(spark, kind):
    docs = given(spark, kind)
    expected = plain.near_groups(plain.texts(docs))
    assert sorted(map(tuple, near_dedup.near_duplicates(docs).collect())) == expected
    left = near_dedup.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(r[0] for r in left.select("doc_id").collect() if r[0] is not None) == [d for d, _, _, k in expected if k]


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """Chains of copies that drift apart share buckets without all being linked to the first; blocks are tiny."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    r, rows = random.Random(2), []
    for family in range(3):
        words = [f"f{family}w{i}" for i in range(120)]
        for k in range(30):
            words[r.randrange(120)] = f"new{family}.{k}"
            rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame(r.sample(rows, len(rows)), "doc_id long, text string")
    assert sorted(map(tuple, near_dedup.near_duplicates(docs).collect())) == plain.near_groups(rows)


def test_sketches_fill_and_estimate():
    import numpy as np

    r = np.random.default_rng(5)
    for size, share in ((1, 1.0), (3, 1.0), (40, 0.5), (3000, 0.8)):
        value = r.integers(0, 2**63, 2 * size).astype(np.uint64)
        cut = round(2 * size * share / (1 + share)) if share < 1 else size
        a, b = (value[:size], value[:size]) if share == 1 else (value[: size], value[size - cut : 2 * size - cut])
        bins = near_dedup.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert (bins != np.iinfo(np.uint64).max).all()
        true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        assert abs((bins[0] == bins[1]).mean() - true) < 0.15


def test_components(spark):
    links = [(i, i + 1) for i in range(10, 40)] + [(100, i) for i in range(101, 160)] + [(40, 159), (7, 7), (200, 201)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: 10 for n in [*range(11, 41), *range(100, 160)]} | {201: 200}


@pytest.mark.parametrize("kind", INPUTS)
def test_decontamination(spark, kind, monkeypatch):
    docs, items = given(spark, kind), plain.read(spark, "benchmark")
    if kind == "odd":
        items = spark.createDataFrame([(1, plain.PASSAGE), (2, None), (None, plain.PASSAGE), (3, "one two"), (4, ""), (5, "same " * 9)], "item_id long, text string")
    listed = [(r["item_id"], r["text"]) for r in items.collect() if r["item_id"] is not None and r["text"]]
    if kind == "clash":
        items = spark.createDataFrame([(1, plain.PASSAGE), (2, "line number 7 of the long one xy"), (3, " ".join(plain.PASSAGE.split()[20:50]))], "item_id long, text string")
        listed = [tuple(r) for r in items.collect()]
        monkeypatch.setattr(decontamination, "BLOCK_TOKENS", 20)
    rows = plain.texts(docs)
    expected = sorted((d, plain.leaks([(d, t)], listed)[d]) for d, t in rows)
    got = decontamination.contaminated(docs, items)
    assert sorted((r["doc_id"], sorted(i["item_id"] for i in r["items"])) for r in got.collect()) == expected
    assert kind == "none" or any(x for _, x in expected)
    left = decontamination.clean_documents(docs, items)
    assert left.columns == docs.columns
    assert sorted(r[0] for r in left.select("doc_id").collect() if r[0] is not None) == [d for d, i in expected if not i]


@pytest.mark.parametrize("first", [5, 64])
def test_tiles_are_the_greedy_ones(first, monkeypatch):
    """The same coverage as the quadratic search, tiles of equal free tokens; one repeated word doesn't multiply."""
    import numpy as np

    monkeypatch.setattr(decontamination, "FIRST_SEARCH", first)
    r = random.Random(9)
    for n in range(60):
        item = [r.randrange(2 + n % 9) for _ in range(r.randrange(1, 60))]
        doc = [r.randrange(2 + n % 9) for _ in range(40)] + item[len(item) // 2 :] + item[: len(item) // 2 + 3]
        found = decontamination.tiles(np.array(doc, np.uint64), np.array(item, np.uint64), 5)
        assert sum(t[2] for t in found) == plain.tiled(doc, item)
        assert all(doc[d : d + k] == item[i : i + k] and k >= 5 for d, i, k in found)
        for at in (0, 1):
            assert len({t[at] + j for t in found for j in range(t[2])}) == sum(t[2] for t in found)
    same = np.zeros(30_000, np.uint64)
    assert decontamination.tiles(same, same[:3000], 5) == [(0, 0, 3000)]


def test_decontamination_in_passes(spark, monkeypatch):
    """Reordered passages count in full; blocks of a few items give the same as one."""
    monkeypatch.setattr(decontamination, "BLOCK_TOKENS", 30)
    r = random.Random(4)
    items = [(i, " ".join(f"t{r.randrange(12)}" for _ in range(20))) for i in range(9)]
    rows = [(d, " ".join(["x"] * d + items[d % 9][1].split()[10:] + ["y"] + items[d % 9][1].split()[:10] + items[(d + 1) % 9][1].split()[: d % 14])) for d in range(40)]
    found = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {x["doc_id"]: sorted(i["item_id"] for i in x["items"]) for x in found.collect()}
    assert got == plain.leaks(rows, items) and all(got.values())
    none = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string"))
    assert none.where("contaminated").count() == 0 and none.count() == 40


def test_work_tables_stand_in_the_named_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir", None) or C.shared_dir(spark)
    files = C.work_table(spark.range(3).where(F.col("id") > 0), "x").inputFiles()
    assert files and all(f"{folder.removeprefix('file://')}/work-x-" in f for f in files)


def test_a_folder_of_our_own_only_where_none_is_named():
    class Context:
        own, master = None, "local[2]"

        def getCheckpointDir(self):
            return self.own

        def setCheckpointDir(self, path):
            self.own = path

    class Session:
        sparkContext = Context()
        conf = {}

    Context.master = "spark://host:7077"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        C.shared_dir(Session)
    Context.master = "local[2]"
    made = C.shared_dir(Session)
    assert made.startswith("file://") and C.shared_dir(Session) == made
    Session.conf = {"spark.checkpoint.dir": "named"}
    assert C.shared_dir(Session) == "named"
