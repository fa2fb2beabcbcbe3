"""Personal data by base patterns and boosted trees over loose candidates. DataFrame functions only.

*Base.* Four patterns (email, ip, card, phone), leftmost and non-overlapping per kind, with their checks. They are
written with possessive repeats and look-behinds that change no match but keep Java's matcher from recursing or
trying a long run again from each of its characters. Places come from the lengths of what lies between the matches.

*Candidates.* Three loose generators propose every word with an ``@``, every chain of at least seven digits with up to
two separators between them, and every run of 16 or more letters, digits and ``+/_-`` with both letters and digits, a
possible secret (a kind without a base pattern); candidates may overlap base spans and each other.

*Boosting.* Trees are fitted on the candidates of all documents with features of their format and, but for secrets, of
the characters around them. Candidates with the same features and target are one row with their number as its weight. No table marks personal data, so targets are what another
view says: of a secret, whether it is assigned (stands in quotes after ``=`` or ``:``), which its features don't tell;
of the other kinds, whether the strict pattern and its check accept the same span or a word for the kind names it. The
checks themselves (Luhn, parts up to 255) are no features. So a secret is found by its format where nothing names it.
For each kind the threshold is the lowest of ``THRESHOLDS`` that keeps a precision of ``PRECISION``
(``NAMED_SHARE`` for secrets) over the candidates of all documents, each scored by trees fitted on the other two of
``FOLDS`` parts of the documents; where none does, or where there is nothing to learn from, the kind adds nothing. The fitted
trees become one SQL expression, so scoring is a projection: no shuffle, no Python.

Defined results: a null or empty text has no spans; base spans are always kept; a candidate that overlaps a base
span of its kind isn't added; rows with a null doc_id are left out; a doc_id with several texts has a row for each.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

KINDS = ("email", "ip", "card", "phone")
#: A kind without a base pattern, which only the trees can add.
ALL_KINDS, SECRET = (*KINDS, "secret"), 4
#: Parts of the documents whose candidates are scored by trees of the others, for the thresholds.
FOLDS = 3
#: Rows of different features or targets that one task takes in a fit.
TASK_ROWS = 50_000
#: Share of what a threshold accepts that must be labelled; of secrets less, as one that nothing names is not a mistake.
PRECISION, NAMED_SHARE = 0.98, 0.5
THRESHOLDS = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99)
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "word": r"(?<![^\x20\x09-\x0D@])[^\x20\x09-\x0D@]++@[^\x20\x09-\x0D]++",
    "digits": r"\+?[0-9](?:[\x20().-]{0,2}+[0-9])++",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+",
}
#: What stands before a value that is named as one of a kind: an assignment, or a word for the kind.
ASSIGNED = r"[:=][\x20]?[\x22']$"
NAMED = r"(?i)(?:mail|phone|tel|fax|card|host|addr)[.:=\x20]{1,3}$"
#: A text without this has no match; a plain search is much cheaper than a pattern.
NEEDS = {"email": "@", "phone": "+", "word": "@"}
STEP = 64
SPANS = "array<struct<start:int,rank:int,end:int>>"


def sums_before(n: Column) -> Column:
    """For each element, the sum of those before it; in blocks, so long arrays stay far from quadratic."""
    zero = F.lit(0).cast("int")
    add = lambda part: F.aggregate(part, zero, lambda a, x: a + x)
    blocks = F.transform(F.sequence(zero, ((F.size(n) - 1) / STEP).cast("int")), lambda b: add(F.slice(n, b * STEP + 1, STEP)))
    bases = F.aggregate(blocks, F.array(zero), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    return C.let(bases, lambda base: F.transform(n, lambda _, i: F.get(base, (i / STEP).cast("int")) + add(F.slice(n, i - i % STEP + 1, i % STEP))))


def found(text: Column, pattern: str, needs: str = "") -> Column:
    """array<struct<start, end, text, before, after>> of the pattern's matches; code points, end exclusive."""
    empty = F.array().cast("array<struct<start:int,end:int,text:string,before:string,after:string>>")

    def placed(matches: Column, gaps: Column) -> Column:
        both = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.length(g) + F.length(m))

        def at(before: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                start = F.get(before, i) + F.length(F.get(gaps, i))
                return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("text"), F.right(F.get(gaps, i), F.lit(8)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(8)).alias("after"))

            return F.transform(matches, one)

        return C.let(C.let(both, sums_before), at)

    spans = C.let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, C.let(F.split(text, pattern, -1), lambda g: placed(m, g))).otherwise(empty))
    possible = F.contains(text, F.lit(needs)) if needs else text.rlike("[0-9]")
    return F.when(possible, spans).otherwise(empty)


def luhn(digits: Column) -> Column:
    doubled = lambda d, i: F.when((F.length(digits) - i) % 2 == 1, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(F.transform(F.transform(F.split(digits, ""), lambda c: c.cast("int")), doubled), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return match.rlike(r"^(0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.|$)){4}$")
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<start, rank, end>>: sorted by start, then kind in the listed order."""
    def of(rank: int, kind: str) -> Column:
        kept = F.filter(found(text, PATTERNS[kind], NEEDS.get(kind, "")), lambda s: valid(kind, s["text"]))
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"))).cast(SPANS)

    kinds = [of(rank, kind) for rank, kind in enumerate(KINDS)]
    return F.array_sort(F.concat(*kinds))


def _count(text: Column, characters: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{characters}]", "")).cast("double")


def candidates(text: Column) -> Column:
    """Loose spans with the kind that each would be and its features."""

    def described(s: Column) -> Column:
        m = s["text"]
        digits, dots = _count(m, "0-9"), _count(m, ".")
        at = F.contains(m, F.lit("@"))
        secret = m.rlike("[0-9]") & m.rlike("^[A-Za-z0-9+/_-]{16,}$") & m.rlike("[A-Za-z]")
        rank = F.when(at, 0).when(secret, SECRET).when(m.startswith("+"), 3).when((dots == 3) & (_count(m, " ()-") == 0), 1).otherwise(2)
        flag = lambda c: c.cast("double")
        beside = lambda c: (c & ~secret).cast("double")  # noqa: E731  a secret's context is its label, so no feature
        features = [
            rank.cast("double"), F.length(m).cast("double"), digits, dots, _count(m, " "), _count(m, "()"), _count(m, "-"),
            _count(m, "A-Za-z"), flag(m.rlike(r"@[A-Za-z0-9-]+\.[A-Za-z]{2,}$")), flag(m.rlike(r"^[A-Za-z0-9]")), flag(m.rlike(r"[^\x00-\x7F]")),
            beside(s["before"].rlike(r"[A-Za-z0-9]$")), beside(s["before"].rlike(r"[.:#$-]$")), beside(s["before"].rlike(r"[\x20\x09-\x0D]$") | (s["before"] == "")),
            beside(s["after"].rlike(r"^[A-Za-z0-9]")), beside(s["after"].rlike(r"^[.,;:!?]")), beside(s["after"].rlike(r"^[\x20\x09-\x0D]") | (s["after"] == "")),
            flag(m.rlike(r"^[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}")), _count(m, "A-Z"), flag(m.rlike("^[0-9a-f]+$")), digits / F.length(m),
        ]
        return F.struct(s["start"].alias("start"), rank.alias("rank"), s["end"].alias("end"), s["before"].rlike(ASSIGNED).alias("assigned"), s["before"].rlike(NAMED).alias("named"), F.array(*features).alias("f"))

    word = found(text, GENERATORS["word"], NEEDS["word"])
    digits = F.filter(found(text, GENERATORS["digits"]), lambda s: _count(s["text"], "0-9") >= 7)
    mixed = lambda s: s["text"].rlike("[0-9]") & s["text"].rlike("[A-Za-z]")
    secrets = F.when(text.rlike("[A-Za-z0-9+/_-]{16}"), F.filter(found(text, GENERATORS["secret"]), mixed)).otherwise(F.array())
    return F.transform(F.concat(word, digits, secrets), described)


N_FEATURES = 21


def _tree(lines: list[str], f: Column) -> Column:
    """The expression of a printed regression tree: lines of If, Else and Predict, nested by indentation."""
    head = lines.pop(0).strip()
    if head.startswith("Predict"):
        return F.lit(float(head.split(":")[1]))
    k, limit = re.fullmatch(r"If \(feature (\d+) <= (.+)\)", head).groups()
    yes = _tree(lines, f)
    lines.pop(0)  # Else
    return F.when(F.get(f, F.lit(int(k))) <= float(limit), yes).otherwise(_tree(lines, f))


class Scorer:
    """Fitted trees as an expression, and a threshold for each kind (over 1: adds nothing)."""

    def __init__(self, trees: list[tuple[float, list[str]]], thresholds: dict[int, float]):
        self.trees, self.thresholds = trees, thresholds

    def probability(self, f: Column) -> Column:
        raw = F.lit(0.0)
        for weight, lines in self.trees:
            raw = raw + F.lit(weight) * _tree(list(lines), f)
        return F.lit(1.0) / (1.0 + F.exp(-2.0 * raw))

    def accepts(self, c: Column) -> Column:
        if not self.trees:
            return F.lit(False)
        limit = F.lit(2.0)
        for rank, t in self.thresholds.items():
            limit = F.when(c["rank"] == rank, F.lit(t)).otherwise(limit)
        return self.probability(c["f"]) >= limit


def boosted(rows: DataFrame, task_rows: int = TASK_ROWS):
    """Trees fitted on (label, f), each weighing ``n`` if there is such a column.

    Rows are dealt by their content and sorted in each task, so up to ``task_rows`` of them fit alike for any layout;
    beyond that only the order in which tasks' sums are added may differ. Splits are searched for among all rows: the
    library would take a sample beyond the square of ``maxBins``.
    """
    weight = F.col("n").cast("double") if "n" in rows.columns else F.lit(1.0)
    named = rows.select("label", *[F.get("f", F.lit(k)).alias(f"f{k}") for k in range(N_FEATURES)], weight.alias("n"))
    count = named.count()
    named = named.repartition(max(1, -(-count // task_rows)), *named.columns).sortWithinPartitions(*named.columns)
    vectors = VectorAssembler(inputCols=[f"f{k}" for k in range(N_FEATURES)], outputCol="features").transform(named)
    bins = max(32, math.isqrt(count) + 1)
    return GBTClassifier(maxIter=8, maxDepth=3, stepSize=0.3, seed=5, maxBins=bins, labelCol="label", featuresCol="features", weightCol="n").fit(vectors)


def printed(model) -> list[tuple[float, list[str]]]:
    return [(w, t.toDebugString.strip().split("\n")[1:]) for w, t in zip(model.treeWeights, model.trees)]


def learned(rows: DataFrame) -> Scorer:
    """Trees of weighted rows, without thresholds; none where the rows have one target only."""
    rows = rows.groupBy("label", "f").agg(F.sum("n").alias("n"))
    if rows.select("label").distinct().count() < 2:
        return Scorer([], {})
    return Scorer(printed(boosted(rows)), {})


def fit(docs: DataFrame) -> Scorer:
    texts = C.documents(docs)
    rows = texts.select("doc_id", base_spans(F.col("text")).alias("base"), F.explode_outer(candidates(F.col("text"))).alias("c")).where("c IS NOT NULL")
    same = F.exists("base", lambda b: (b["start"] == F.col("c.start")) & (b["end"] == F.col("c.end")) & (b["rank"] == F.col("c.rank")))
    label = F.when(F.col("c.rank") == SECRET, F.col("c.assigned")).otherwise(same | F.col("c.named"))
    rows = rows.select(label.cast("double").alias("label"), F.col("c.rank").alias("rank"), F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).alias("fold"), "c.f")
    rows = C.work_table(rows.groupBy("label", "rank", "fold", "f").agg(F.count("*").alias("n")), "candidates")
    scorer = learned(rows)
    if not scorer.trees:
        return scorer
    p = F.lit(None).cast("double")
    for fold in range(FOLDS):
        others = learned(rows.where(F.col("fold") != fold))
        if others.trees:
            p = F.when(F.col("fold") == fold, others.probability(F.col("f"))).otherwise(p)
    held = rows.select("label", "rank", "n", p.alias("p"))
    counts = [F.sum(F.when(F.col("p") >= t, x * F.col("n"))).alias(f"{name}{k}") for k, t in enumerate(THRESHOLDS) for name, x in (("n", F.lit(1.0)), ("y", F.col("label")))]
    for r in held.groupBy("rank").agg(*counts).collect():  # a row for each kind
        good = [t for k, t in enumerate(THRESHOLDS) if r[f"n{k}"] and r[f"y{k}"] >= (NAMED_SHARE if r["rank"] == SECRET else PRECISION) * r[f"n{k}"]]
        scorer.thresholds[r["rank"]] = min(good, default=2.0)
    return scorer


def redactions(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """(doc_id, text, base, added): spans as array<struct<start, rank, end>>."""
    df = C.documents(docs).select("doc_id", "text", base_spans(F.col("text")).alias("base"), candidates(F.col("text")).alias("candidates"))
    clear = lambda c: ~F.exists("base", lambda b: (b["rank"] == c["rank"]) & (b["start"] < c["end"]) & (c["start"] < b["end"]))
    chosen = F.filter("candidates", lambda c: scorer.accepts(c) & clear(c))
    return df.select("doc_id", "text", "base", F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end"))).cast(SPANS).alias("added"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kind = lambda s: F.element_at(F.array(*[F.lit(k) for k in ALL_KINDS]), s["rank"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_pii(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    df = redactions(docs, fit(docs))
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return df.select(
        "doc_id",
        *[count(rank).alias(f"n_{kind}") for rank, kind in enumerate(KINDS)],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
    )
