"""Toxicity by weak supervision.

*Voters.* Each term of a mined lexicon is a voter that fires where a text has it, and so are a few patterns
(several words with a term, shouting, runs of marks). A term is a word or the beginning of words (``STEMS`` letters).
Terms come from the labelled sample: forms that ``TOXIC_DOCS`` toxic documents hold and hardly any other, in at least
``CONTEXTS`` different contexts. Contexts count so that the words of one copied text are no terms.

*Label model.* A text is toxic or not, and a voter fires with a chance that depends on the class and on one more
frequent voter, the one that tells most about it within the classes; so accuracies and correlations are both
parameters. Expectation maximisation estimates them from the votes on ``TEXTS`` texts of least hash, labelled or not.
Labels give the terms and the share of toxic texts, no text's class.

*Classifier.* A ridge logistic regression on hashed text features (words, their beginnings, the patterns), fitted on
the same texts with the label model's posteriors as targets; of the ``BUCKETS`` features those that lie furthest from
the share of toxic texts, ``FEATURES`` at most, get a weight. The labelled sample calibrates the score: a logistic
curve over the margin and the logarithm of the number of distinct words, as a long text has a form or two by chance.

Everything learnt comes from at most ``labelled.LABELLED_ROWS`` labelled rows and about ``TEXTS`` texts. Scoring is a
projection with a constant list: no shuffle, no join.

Tokens are maximal runs of ASCII letters, digits and non-ASCII characters, with A-Z lower-cased.

Defined results: null and empty texts have no features and get the constant's score; with no toxic or no clean
label every score is 0; rows with a null doc_id are left out of ``op7``; ``clean_documents`` keeps them unless their
text is rejected; a doc_id with several texts gets a row, and a label, for each of them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .decontamination import NO_TOKEN
from .labelled import LABELLED_ROWS, fold, logistic, logistic_sparse, row_sums, sample

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: Terms of the lexicon at most, or one for so many labelled rows if that is more; contexts that a term needs, toxic
#: documents that it needs, and its share of clean documents at most.
TERMS, ROWS_A_TERM, CONTEXTS, TOXIC_DOCS, CLEAN_SHARE = 512, 16, 4, 3, 0.1
#: Lengths of beginnings.
STEMS = (4, 5, 6, 7)
#: Texts on which the label model and the classifier are fitted, besides the labelled ones.
TEXTS = 10_000
#: Nats that two voters must tell about each other for one to depend on the other: chance gives about 0.5 a class.
LEAST_INFORMATION = 5.0
#: Weight of the rough start (by the number of words with a term) beside the posteriors.
ANCHOR = 0.9
#: Say of a silent voter: silences of voters that never meet (of different languages, say) are not independent.
SILENCE = 0.6
BUCKETS, FEATURES, LEAST_Z, RIDGE = 1 << 18, 8192, 3.0, 1.0
#: Rows of votes that are multiplied at once.
VOTE_ROWS = 2048
PATTERNS = ("several words", "shouting", "runs of marks")
#: Forms that may be broadcast: 8 bytes each, so 8 MB.
BROADCAST_FORMS = 1_000_000


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(C.ascii_lower(text), NO_TOKEN), "")


def forms(word: Column) -> list[Column]:
    """A word and its beginnings; null for those that it is too short for."""
    return [word, *[F.when(F.length(word) > k, F.concat(F.left(word, F.lit(k)), F.lit("*"))) for k in STEMS]]


def hashed_forms(words: Column) -> Column:
    """Hashes of the forms of each word, flat; 0 for none."""
    return F.flatten(F.transform(words, lambda w: F.array(*[F.when(x.isNotNull(), F.xxhash64(x)).otherwise(F.lit(0)) for x in forms(w)])))


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_FORMS else df


def mined_terms(rows: DataFrame) -> list[str]:
    """Of (doc_id, text, label): forms with many toxic contexts and hardly any clean document; at most ``TERMS``, or one
    for each ``ROWS_A_TERM`` rows if that is more, after forms that a shorter beginning covers have gone."""
    rows = rows.dropDuplicates(["doc_id", "text"])
    held = lambda label: rows.where(F.col("label") == label).select(F.explode_outer(F.array_distinct(hashed_forms(F.array_distinct(tokens(F.col("text")))))).alias("h")).where("h <> 0")
    toxic = C.saved(held(1).groupBy("h").agg(F.count("*").alias("toxic")).where(F.col("toxic") >= TOXIC_DOCS))
    clean = held(0).join(small(toxic.select("h")), "h").groupBy("h").agg(F.count("*").alias("clean"))
    found = toxic.join(clean, "h", "left").where(F.coalesce("clean", F.lit(0)) <= CLEAN_SHARE * F.col("toxic"))
    found = C.saved(found.select("h"))
    placed = C.let(tokens(F.col("text")), lambda t: F.transform(t, lambda w, i: F.struct(w.alias("w"), F.xxhash64(F.get(t, i - 1), F.get(t, i + 1)).alias("context"))))
    placed = rows.where("label = 1").select(F.explode_outer(placed).alias("p")).select(F.explode(F.array(*forms(F.col("p.w")))).alias("w"), F.col("p.context").alias("context"))
    counted = placed.where("w IS NOT NULL").withColumn("h", F.xxhash64("w")).join(small(found), "h").select("w", "context").distinct()
    counted = counted.groupBy("w").agg(F.count("*").alias("contexts")).where(F.col("contexts") >= CONTEXTS)
    best = [r[0] for r in counted.orderBy(F.desc("contexts"), "w").select("w").collect()]
    return uncovered(best)[: max(TERMS, rows.count() // ROWS_A_TERM)]


def uncovered(found: list[str]) -> list[str]:
    """The forms that no shorter beginning among them covers: it says it all."""
    stems = {w[:-1] for w in found if w.endswith("*")}
    return [w for w in found if not any(w[:k] in stems and len(w.removesuffix("*")) > k for k in STEMS)]


def flags(text: Column) -> list[Column]:
    """Shouting and runs of marks."""
    upper = F.length(text) - F.length(F.translate(text, C.UPPER, ""))
    lower = F.length(text) - F.length(F.translate(text, C.LOWER, ""))
    return [(upper > 20) & (2 * upper > lower), F.regexp_count(text, F.lit(r"[!?*#$%&]{2}")) >= 3]


def bins(words: Column, text: Column) -> Column:
    """The features of a text, given its distinct words: bins of the words and their beginnings (a shorter word is its
    own beginning) and of the patterns; -1 for none, with repeats."""
    own = F.transform(words, lambda w: F.array(*[F.pmod(F.xxhash64(x), F.lit(BUCKETS)) for x in (w, *[F.left(w, F.lit(k)) for k in STEMS])]))
    marks = [F.when(x, F.pmod(F.xxhash64(F.lit(name), F.lit("pattern")), F.lit(BUCKETS))).otherwise(F.lit(-1)) for name, x in zip(PATTERNS[1:], flags(text))]
    return F.concat(F.flatten(own), F.array(*marks))


class Votes:
    """Which voters fire on which texts; equal rows of votes are one, with its number of texts."""

    def __init__(self, fired: list[np.ndarray], voters: int):
        index: dict[bytes, int] = {}
        self.row = np.array([index.setdefault(np.sort(f).astype(np.int32).tobytes(), len(index)) for f in fired], np.int64)
        self.count = np.bincount(self.row, minlength=len(index)).astype(np.float32)
        self.on = np.zeros((len(index), voters), bool)
        for key, r in index.items():
            self.on[r, np.frombuffer(key, np.int32)] = True

    def blocks(self, dtype: type) -> Iterator[tuple[slice, np.ndarray]]:
        """The votes as numbers, ``VOTE_ROWS`` rows at a time, so that products with them stay small."""
        for s in range(0, len(self.on), VOTE_ROWS):
            yield slice(s, s + VOTE_ROWS), self.on[s : s + VOTE_ROWS].astype(dtype)


def label_model(votes: Votes, share: float, start: np.ndarray, steps: int = 30, anchor: float = ANCHOR) -> np.ndarray:
    """Posterior of class 1 for each text, by expectation maximisation from ``start``, which keeps a weight of ``anchor``
    so that the classes keep their meaning; ``share`` is the share of class 1."""
    on, n = votes.on, votes.count
    p = rough = np.bincount(votes.row, weights=start, minlength=len(n)) / np.maximum(n, 1)
    prior = np.log(share / (1 - share))
    frequency = sum((n[s] @ b for s, b in votes.blocks(np.float64)), np.zeros(on.shape[1]))
    order = np.lexsort((np.arange(on.shape[1]), -frequency))
    earlier = np.empty(on.shape[1], np.int64)
    earlier[order] = np.arange(on.shape[1])
    allowed = earlier[None, :] < earlier[:, None]  # a voter depends on a more frequent one
    for _ in range(steps):
        chance = []
        information = np.zeros((on.shape[1],) * 2)
        belief = anchor * rough + (1 - anchor) * p
        for w in (n * belief, n * (1 - belief)):
            total = w.sum() + 1.0
            both = np.zeros((on.shape[1],) * 2)
            for s, b in votes.blocks(np.float32):
                both += (b * w[s, None].astype(np.float32)).T @ b
            alone = np.diag(both).copy()
            single = (alone + share_of_prior(frequency, n)) / total
            information += shared_information(both, alone, total)
            chance.append((total, both, alone, np.clip(single, 1e-6, 1 - 1e-6)))
        information[~allowed] = -np.inf
        parent = information.argmax(1)
        has = information[np.arange(len(parent)), parent] > LEAST_INFORMATION
        parent = np.where(has, parent, np.arange(len(parent)))
        tables = []
        for total, both, alone, single in chance:  # of firing where the voter depended on fires, and where it doesn't
            with_parent, own = both[np.arange(len(parent)), parent], alone[parent]
            given = np.where(has, (with_parent + 2 * single) / (own + 2), single)
            without = np.where(has, (alone - with_parent + 2 * single) / (np.maximum(total - own, 0) + 2), single)
            tables.append(np.clip(np.stack([given, without]), 1e-6, 1 - 1e-6))
        fires, silent = np.log(tables[0] / tables[1]), SILENCE * np.log((1 - tables[0]) / (1 - tables[1]))
        odds = np.full(len(n), prior + silent[1].sum())
        for s, b in votes.blocks(np.float64):
            beside = b[:, parent] * has
            odds[s] += beside @ (silent[0] - silent[1]) + b @ (fires[1] - silent[1]) + (b * beside) @ (fires[0] - fires[1] - silent[0] + silent[1])
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        done = np.abs(new - p).max() < 1e-4
        p = new
        if done:
            break
    return p[votes.row]


def shared_information(both: np.ndarray, alone: np.ndarray, total: float) -> np.ndarray:
    """What each two voters tell about each other, in nats over all texts, from how often both and each alone fire."""
    out = np.zeros(both.shape)
    a, b = alone[:, None], alone[None, :]
    for cell, mine, other in ((both, a, b), (a - both, a, total - b), (b - both, total - a, b), (total - a - b + both, total - a, total - b)):
        cell = np.maximum(cell, 1e-9)
        out += cell * np.log(cell * total / np.maximum(mine * other, 1e-9))
    return out


def share_of_prior(frequency: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One more text, on which a voter fires as often as over all texts: keeps chances away from 0."""
    return np.maximum(frequency, 0.5) / max(1.0, float(n.sum()))


class Model:
    """Weights of the features and a constant; ``curve`` has the score's weights of margin, log length and 1."""

    def __init__(self, terms: list[str], weights: np.ndarray, constant: float, curve: tuple[float, float, float] = (1.0, 0.0, 0.0)):
        self.terms, self.weights, self.constant, self.curve = terms, weights, constant, curve

    def score(self, text: Column) -> Column:
        if not len(self.weights):
            return F.lit(0.0)
        table = F.from_json(F.lit(json.dumps([float(f"{w:.5g}") if w else 0 for w in self.weights])), "array<double>")
        weight = lambda i: F.get(table, i.cast("int"))

        def odds(b: Column) -> Column:
            own = F.array_distinct(F.filter(b, lambda i: (i >= 0) & (weight(i) != 0.0)))
            margin = F.aggregate(own, F.lit(float(self.constant)), lambda s, i: s + weight(i))
            a, length, constant = self.curve
            return margin * a + F.log(F.size(b).cast("double")) * length + constant

        return 1.0 / (1.0 + F.exp(F.least(F.lit(50.0), -C.let(bins(F.array_distinct(tokens(text)), text), odds))))


def _fired(terms: np.ndarray):
    """(row, fired, words): the term numbers of each text and how many of its distinct words have one."""
    order = np.argsort(terms)
    sorted_terms, stride = terms[order], len(STEMS) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, offsets = C.ragged(b.column("h"))
            h = h.view(np.int64)
            at = np.minimum(np.searchsorted(sorted_terms, h), max(0, len(terms) - 1))
            hit = np.flatnonzero(sorted_terms[at] == h) if len(terms) and len(h) else np.zeros(0, np.int64)
            doc = np.searchsorted(offsets, hit, side="right") - 1
            pair = np.unique(np.stack([doc, order[at[hit]]], 1), axis=0).reshape(-1, 2) if len(hit) else np.zeros((0, 2), np.int64)
            cuts = np.searchsorted(pair[:, 0], np.arange(len(offsets)))
            words = np.bincount(doc[np.unique(hit // stride, return_index=True)[1]], minlength=len(offsets) - 1) if len(hit) else np.zeros(len(offsets) - 1)
            arrays = [b.column("row"), pa.ListArray.from_arrays(cuts.astype(np.int32), pa.array(pair[:, 1].astype(np.int32))), pa.array(words.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*arrays, *(b.column(c) for c in ("shouting", "marks", "label"))], names=["row", "fired", "words", "shouting", "marks", "label"])

    return run


def _by_row(rows: np.ndarray, values: np.ndarray, found: np.ndarray) -> np.ndarray:
    return values[np.searchsorted(rows, found)]


def _distinct_bins(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Row number in the batch and bin, each pair once."""
    x, offsets = C.ragged(b.column("bins"))
    x = x.view(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    pair = np.unique((doc * BUCKETS + x)[x >= 0])
    return pair // BUCKETS, pair % BUCKETS


def _bin_counts(rows: np.ndarray, posterior: np.ndarray):
    """(bin, n, toxic) of the texts of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for b in batches:
            doc, own = _distinct_bins(b)
            p = _by_row(rows, posterior, b.column("row").to_numpy())
            n += np.bincount(own, minlength=BUCKETS)
            toxic += np.bincount(own, weights=p[doc], minlength=BUCKETS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(toxic[at])], names=["bin", "n", "toxic"])

    return run


def _chosen_bins(chosen: np.ndarray):
    """(row, own, n): the numbers of the chosen features that a text has, and how many bins it has with repeats."""
    number = np.full(BUCKETS, -1, np.int32)
    number[chosen] = np.arange(len(chosen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, own = _distinct_bins(b)
            own = number[own]
            doc, own = doc[own >= 0], own[own >= 0]
            cuts = np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32)
            n = pa.array(np.diff(b.column("bins").offsets.to_numpy()).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.ListArray.from_arrays(cuts, pa.array(own)), n], names=["row", "own", "n"])

    return run


def texts_of_least_hash(docs: DataFrame, texts: int) -> DataFrame:
    """About ``texts`` rows (doc_id, text), picked by the hash of their doc_id, so alike for any partitioning."""
    own = C.documents(docs)
    return own.where(F.pmod(F.xxhash64("doc_id", F.lit("text")), F.lit(max(1, docs.count()))) < texts)


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT, rows: int = LABELLED_ROWS, texts: int = TEXTS) -> Model:
    C.small_batches(docs.sparkSession)
    learnt = sample(docs, labels, column, folds, held_out, rows)
    others = texts_of_least_hash(docs, texts).withColumn("label", F.lit(None).cast("int"))
    # a text is taken once, with its label if it has one; rows are known by a hash
    own = learnt.unionByName(others).withColumn("row", F.xxhash64("text")).groupBy("row").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"), F.max("label").alias("label"))
    own = C.work_table(own, "texts")
    y = dict(map(tuple, own.where("label IS NOT NULL").groupBy("label").count().collect()))
    if not (y.get(0) and y.get(1)):
        return Model([], np.zeros(0), 0.0)
    terms = mined_terms(own.where("label IS NOT NULL").select("doc_id", "text", "label"))
    shouting, marks = flags(F.col("text"))
    voted = own.select("row", hashed_forms(F.array_distinct(tokens(F.col("text")))).alias("h"), shouting.alias("shouting"), marks.alias("marks"), "label")
    hashes = docs.sparkSession.range(1).select(F.array(*[F.xxhash64(F.lit(t)) for t in terms]).cast("array<long>")).first()[0]
    voted = voted.mapInArrow(_fired(np.array(hashes, np.int64)), "row long, fired array<int>, words int, shouting boolean, marks boolean, label int").toArrow().sort_by("row")
    n_terms, words = len(terms), voted["words"].to_numpy()
    patterns = np.stack([words >= 2, voted["shouting"].to_numpy(), voted["marks"].to_numpy()], 1)
    lists = voted["fired"].combine_chunks()
    each = np.split(lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())[:-1])
    fired = [np.concatenate([f.astype(np.int64), n_terms + np.flatnonzero(x)]) for f, x in zip(each, patterns)]
    share = y[1] / (y[0] + y[1])
    posterior = label_model(Votes(fired, n_terms + len(PATTERNS)), share, np.where(words >= 2, 0.95, np.where(words == 1, share, 0.01)))

    row = voted["row"].to_numpy()
    binned = own.select("row", bins(F.array_distinct(tokens(F.col("text"))), F.col("text")).alias("bins"))
    counts = binned.mapInArrow(_bin_counts(row, posterior), "bin long, n double, toxic double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).toArrow().sort_by("bin")
    mean = min(max(posterior.mean(), 1e-3), 1 - 1e-3)
    n = counts["n"].to_numpy()
    z = (counts["toxic"].to_numpy() - n * mean) / np.sqrt(n * mean * (1 - mean) + 1e-9)
    best = np.argsort(-np.abs(z), kind="stable")[:FEATURES]
    chosen = counts["bin"].to_numpy()[np.sort(best[np.abs(z[best]) >= LEAST_Z])]
    got = binned.mapInArrow(_chosen_bins(chosen), "row long, own array<int>, n int").toArrow()
    own_bins = got.column("own").combine_chunks()
    flat, offsets = own_bins.flatten().to_numpy(), np.cumsum(np.append(0, own_bins.value_lengths().to_numpy()), dtype=np.int64)
    target = _by_row(row, posterior, got.column("row").to_numpy())
    w = logistic_sparse(flat, offsets, target, len(chosen), RIDGE)
    margin = row_sums(flat, offsets, w)
    label = _by_row(row, voted["label"].cast(pa.float64()).fill_null(np.nan).to_numpy(), got.column("row").to_numpy())
    known = ~np.isnan(label)
    x = np.stack([margin, np.log(got.column("n").to_numpy().astype(float)), np.ones(len(margin))], 1)
    weights = np.zeros(BUCKETS)
    weights[chosen] = w[:-1]
    return Model(terms, weights, float(w[-1]), tuple(logistic(x[known], label[known], 1e-3).tolist()))


def clean_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score under the threshold."""
    return docs.where(model.score(F.coalesce("text", F.lit(""))) < threshold)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    model = fit(docs, C.table(spark, sf_dir, "labels"))
    df = C.documents(docs).select("doc_id", model.score(F.col("text")).alias("score"))
    return df.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
