"""Quality rules: text statistics, then a hashed n-gram log-likelihood ratio. DataFrame functions only.

Words, pairs of neighbouring words and pairs of their shapes are hashed to ``BUCKETS`` bins, a power of 2; shapes are
there as words of a large corpus are mostly rare. A shape keeps case, punctuation and digits and shortens runs of
letters. A word that repeats the one before it counts in a bin of its own besides. Two multinomials over the bins are counted: one over every text of
the raw corpus, one over the trusted target (documents labelled quality 1). A bin's weight is log(p_target / p_raw),
where ``SMOOTHING`` occurrences at the corpus's rate are added, so that a rare word has nearly no say; a document's
score is the sum of its n-grams' weights over three times its words, so length doesn't matter. A document is kept if no base rule fails it and
its score is at least ``MARGIN``.

Counting and scoring make a row of each word, with its hashes and those of the word before: the arithmetic of n-grams
on such rows is code that Spark compiles, on arrays each of its steps would be interpreted for each word. Counting is
a map-side combined aggregation to at most a row for each bin; those few numbers, a fixed amount at any size of the
corpus, come to the driver and go out as one constant array. Scoring sums up each document's words in the task that
reads it, so one row for each document is shuffled. Counts cover every document; every document gets a verdict from
the same threshold.

Defined results: a null text has no words, is failed by the base rules (under 10 words) and has a null score; a
trusted set without texts gives weights from smoothing alone; rows with a null doc_id are left out; a doc_id
with several texts has a row for each, and all of them are in the target if it is.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bins, and the counts that draw a bin's ratio to 1.
BUCKETS, SMOOTHING = 1 << 16, 10.0
MARGIN = -0.3
#: Tell the kinds of n-grams apart (fixed values).
PAIR, SHAPE, SAME = 0x2545F491, 0x5851F42D, 0x14057B7E
#: Ids of the target that may be broadcast, some 60 bytes each, so 15 MB; more are joined by a shuffle, to the same result.
BROADCAST_IDS = 250_000
SYMBOLS = "#*$%&|<>"


def repeat_words(h: Column, k: int = 5) -> Column:
    """Of an array of word hashes: words that lie in a k-word window found twice or more in the text."""

    def marked(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

        def twice(sorted_: Column) -> Column:
            n = F.size(sorted_)
            same = lambda x, i: ((i > 0) & (F.get(sorted_, i - 1)["w"] == x["w"])) | ((i < n - 1) & (F.get(sorted_, i + 1)["w"] == x["w"]))
            return F.sort_array(F.transform(F.filter(sorted_, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"]))

        covered = lambda at: F.aggregate(
            at,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-k).alias("last")),
            lambda a, i: F.struct((a["n"] + F.least(F.lit(k), i - a["last"])).alias("n"), i.alias("last")),
            lambda a: a["n"],
        )
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(covered(C.let(pairs, twice)))

    def windows(h: Column) -> Column:
        hashed = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[h[i + j] for j in range(k)]))
        return F.when(F.size(h) >= k, C.let(hashed, marked)).otherwise(F.lit(0).cast("long"))

    return C.let(h, windows)


def without(text: Column, characters: str) -> Column:
    """``text`` without the characters; one plain search for each is much cheaper than looking every character up, and
    one for any of them spares most texts the rest."""
    bare = text
    for c in characters:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    return F.when(text.rlike("[" + "".join(f"\\x{ord(c):02x}" for c in characters) + "]"), bare).otherwise(text)


def base_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, text, h: the words' hashes, and the base statistics)."""
    df = C.documents(docs).withColumn("h", C.word_hashes(F.col("text")))
    lines = F.filter(F.split("text", "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    n, repeats = F.size("h").cast("long"), F.col("n_repeat_words")
    df = df.select(
        "doc_id",
        "text",
        "h",
        n.alias("n_words"),
        F.length(without(without(F.col("text"), "\t\x0b\x0c\r"), " \n")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        C.let(lines, lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("h")).alias("n_repeat_words"),
    )
    return df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * repeats > 20 * F.col("n_words")))


def shapes(text: Column) -> Column:
    """Hashes of the words' shapes: case, punctuation and digits stay, runs of letters shrink to one."""
    return C.word_hashes(F.regexp_replace(F.regexp_replace(text, r"\p{Ll}+", "a"), r"\p{Lu}+", "A"))


def before(values: Column) -> Column:
    """For each element the one before it, twice; 0 for the first."""
    return F.concat(F.array(F.lit(0).cast("long")), F.transform(F.slice(values, F.lit(1), F.greatest(F.size(values) - 1, F.lit(0))), lambda x: F.shiftleft(x, 1)))


def by_word(df: DataFrame) -> DataFrame:
    """A row for each word instead of the arrays ``h`` and ``s``: the word's h and s, and ``hb`` and ``sb`` as ``before``
    gives them. A document without words has one row of nulls."""
    late = lambda c: F.concat(F.array(F.lit(0).cast("long")), F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0)))).alias(c + "b")
    # the outer form, as Spark would put all of this into a filter before the other, too
    rows = df.select(*(c for c in df.columns if c not in ("h", "s")), F.inline_outer(F.arrays_zip("h", late("h"), "s", late("s"))))
    return rows.withColumns({c: F.shiftleft(c, 1) for c in ("hb", "sb")})


def word_bins(x: Column, b: Column, mask: int) -> list[Column]:
    """Bins of a word and of its pair, from its hash and what ``before`` gives. All hashes are uniform, so exclusive-or
    mixes them well enough."""
    return [x.bitwiseAND(F.lit(mask)), x.bitwiseXOR(b).bitwiseXOR(F.lit(PAIR)).bitwiseAND(F.lit(mask))]


def shape_bin(s: Column, b: Column, mask: int) -> Column:
    return s.bitwiseXOR(b).bitwiseXOR(F.lit(SHAPE)).bitwiseAND(F.lit(mask))


def same(x: Column, b: Column) -> Column:
    """Whether a word is the same as the one before it."""
    return F.shiftleft(x, 1) == b


def bins(text: Column, mask: int) -> Column:
    """The bins of all n-grams of a text."""

    def of(h: Column, hb: Column, s: Column, sb: Column) -> Column:
        own = F.flatten(F.zip_with(h, hb, lambda x, b: F.array(*word_bins(x, b, mask))))
        again = F.size(F.filter(F.zip_with(h, hb, same), lambda y: y))
        return F.concat(own, F.zip_with(s, sb, lambda x, b: shape_bin(x, b, mask)), F.array_repeat(F.lit(SAME & mask), again))

    return C.let(C.word_hashes(text), lambda h: C.let(shapes(text), lambda s: F.when(F.size(h) > 0, C.let(before(h), lambda hb: of(h, hb, s, before(s)))).otherwise(F.array().cast("array<long>"))))


def weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """Log ratio of the target's and the corpus's share of each bin; ``trusted`` has the doc_ids of the target."""
    target = C.saved(trusted.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long")).distinct().withColumn("target", F.lit(1)))
    target = F.broadcast(target) if target.count() <= BROADCAST_IDS else target
    df = C.documents(docs).join(target, "doc_id", "left")
    df = by_word(df.select("target", C.word_hashes(F.col("text")).alias("h"), shapes(F.col("text")).alias("s"))).where("h IS NOT NULL")
    mask, again = buckets - 1, F.when(same(F.col("h"), F.col("hb")), F.lit(SAME & (buckets - 1)))
    df = df.select("target", F.explode(F.array(*word_bins(F.col("h"), F.col("hb"), mask), shape_bin(F.col("s"), F.col("sb"), mask), again)).alias("bin"))
    got = df.where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"), F.count("target").alias("t")).toArrow()  # at most ``buckets`` rows
    raw, own, at = np.zeros(buckets), np.zeros(buckets), got.column("bin").to_numpy()
    raw[at], own[at] = got.column("n").to_numpy(), got.column("t").to_numpy()
    share = (own.sum() + 1) / (raw.sum() + 1)
    return np.round(np.log(own + SMOOTHING * share) - np.log((raw + SMOOTHING) * share), 6).tolist()


def scored(docs: DataFrame, table: list[float], margin: float = MARGIN) -> DataFrame:
    """The base statistics, score and verdict of every document."""
    constant = F.from_json(F.lit(json.dumps(table)), "array<double>")  # folded to one constant by the optimizer
    mask = len(table) - 1
    x, b = F.col("h"), F.col("hb")
    word, pair, shape = (constant[i] for i in (*word_bins(x, b, mask), shape_bin(F.col("s"), F.col("sb"), mask)))
    weight = word + pair + shape + F.when(same(x, b), F.lit(table[SAME & mask])).otherwise(F.lit(0.0))
    df = base_rules(docs)
    of_text = [c for c in df.columns if c not in ("text", "h")]
    # ids tell rows of one doc_id apart
    df = by_word(df.select(F.monotonically_increasing_id().alias("row"), *of_text, "h", shapes(F.col("text")).alias("s")))
    df = df.groupBy("row", *of_text).agg(F.sum(weight).alias("score")).drop("row")
    df = df.withColumn("score", F.col("score") / (3 * F.col("n_words")))
    return df.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= margin, F.lit(False)))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs, labels = C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")
    return scored(docs, weights(docs, labels.where("quality = 1")))
