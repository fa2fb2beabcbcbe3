"""Plain versions of the operators, and the rows that tests share."""

import hashlib
import random
import re
import struct
from collections import Counter

import xxhash

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[^\x00-/:-@\[-`{-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Other columns take names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep string, tokens string, h string, band long, piece_ids string, component long"
PASSAGE = " ".join(f"passage{i}" for i in range(60))


def odd_documents(spark):
    long = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
    texts = [
        (1, f"First {PASSAGE} end\nA line that several documents hold\n"), (2, f"Second {PASSAGE} other\n  a LINE that several documents hold \nown line here"), (3, None), (4, ""), (5, " \t\n\x0b "), (6, "word"),
        (7, "one two three four"), (8, "one two three four"), (9, long), (10, long + " more"), (10, long + " more"), (None, f"{PASSAGE} nameless"), (11, "x" * 5000), (12, "Ünïcode ▁ 漢字 \U0001f600 mail a.b@c.de, +49 (30) 1234-5678"),
        (13, "a\nshort\nshort\nA line that several documents hold"), (14, "4111 1111 1111 1111 10.0.0.1 999.1.1.1 1.2.3.4.5"), (15, (PASSAGE + " ") * 3), (16, "\n\n"), (17, "same same same same same same same same same same same same same same"),
        (18, "hello wide world\nhello wide line\nhello wide text"), (19, "hello wide world \x85\nhello wide line \u2028\nhello wide text\u2029"), (20, "a" + " " * 300_000 + "b\n" + " " * 50_000),
    ]
    return spark.createDataFrame([(d, t, None, "s", 1, "k", "t", "h", 5, "p", 7) for d, t in texts], SCHEMA)


def clashing_documents(spark):
    """Doc_ids that occur with several texts, and repeated rows."""
    r = random.Random(8)
    free = lambda n: " ".join(f"v{r.randrange(900)}" for _ in range(n))
    a, b, c = free(40), free(70), free(30)
    lines = "\n".join(f"line number {i} of the long one" for i in range(31))
    texts = [
        (2, f"{a} {PASSAGE} {b}"), (2, f"{PASSAGE} {c}"), (1, f"{b} tail"), (3, f"{c} {PASSAGE}"), (3, f"{c} {PASSAGE}"), (5, lines), (5, "line number 4 of the long one\nxy\nA line of its own here"), (4, "line number 7 of the long one\nz"),
        (6, lines), (6, f"{lines} more"), (7, b), (7, None), (7, ""), (8, f"{b} tail"), (2, "one two three"), (9, "one two three"),
    ]
    return spark.createDataFrame([(d, t, None, "s", 1, "k", "t", "h", 5, "p", 7) for d, t in texts], SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def read(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(docs):
    return sorted((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect() if r["doc_id"] is not None)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def without_repeats(rows, window=13):
    """(doc_id, n_words, n_removed, kept text)."""
    words = [(d, WORD.findall(t)) for d, t in rows]
    least = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            least.setdefault(tuple(w[i : i + window]), d)
    out = []
    for d, w in words:
        gone = {i + k for i in range(len(w) - window + 1) if least[tuple(w[i : i + window])] < d for k in range(window)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


def line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def without_lines(rows):
    """(doc_id, n_lines, n_dropped, kept text)."""
    held = {}
    for d, t in rows:
        for line in t.split("\n"):
            held.setdefault(line_key(line), d)
    out = []
    for d, t in rows:
        lines = t.split("\n")
        kept = [x for x in lines if len(line_key(x)) < 10 or held[line_key(x)] == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def shingles(text):
    w = WORD.findall(text.translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_groups(rows, share=85):
    """(doc_id, n_shingles, component_id, kept) of each row."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    where = {}
    for d, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(d)
    common = Counter((a, b) for ds in where.values() for i, a in enumerate(ds) for b in ds[i + 1 :])
    for (a, b), n in common.items():
        if 100 * n >= share * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((top(a), top(b)))
            up[b] = a
    least = {}
    for k, (d, _) in enumerate(rows):
        least[top(k)] = min(d, least.get(top(k), d))
    return sorted((d, len(sets[k]), least[top(k)], least[top(k)] == d) for k, (d, _) in enumerate(rows))


def tiled(doc, item, least=5):
    """Tokens of ``item`` that greedy tiles cover, by the quadratic search; of equal lengths the earliest in the document, then in the item."""
    free_d, free_i, covered = [True] * len(doc), [True] * len(item), 0
    while True:
        best = (least - 1, 0, 0)
        for a in range(len(doc)):
            for b in range(len(item)):
                n = 0
                while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n] and free_d[a + n] and free_i[b + n]:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < least:
            return covered
        free_d[a : a + n] = free_i[b : b + n] = [False] * n
        covered += n


def leaks(rows, items, share=0.5):
    """doc_id to the items whose tokens it covers."""
    split = [(i, TOKEN.findall(t.translate(LOWER))) for i, t in items]
    seeds = {}
    for i, w in split:
        for k in range(len(w) - 4):
            seeds.setdefault(tuple(w[k : k + 5]), set()).add(i)
    tokens, out = dict(split), {}
    for d, t in rows:
        w = TOKEN.findall(t.translate(LOWER))
        near = set().union(*(seeds.get(tuple(w[k : k + 5]), ()) for k in range(len(w) - 4)))
        out[d] = sorted(i for i in near if _covers(w, tokens[i], share))
    return out


def _covers(doc, item, share):
    """Only the neighbourhoods of shared seeds can be tiled, so the rest of a long document is left out of the search."""
    own = {tuple(item[k : k + 5]) for k in range(len(item) - 4)}
    near = set()
    for k in range(len(doc) - 4):
        if tuple(doc[k : k + 5]) in own:
            near.update(range(k, k + 5))
    kept, last = [], -1
    for k in sorted(near):
        if last >= 0 and k != last + 1:
            kept.append(None)
        kept.append(doc[k])
        last = k
    return tiled(kept, item) >= share * len(item)


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0):
                continue
            out.append((m.start(), rank, m.end()))
    return sorted(out)


def statistics(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    found = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeats = len({i + k for i in range(len(w) - 4) if found[tuple(w[i : i + 5])] > 1 for k in range(5)})
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeats, len(w) < 10 or 100 * repeats > 20 * len(w)


def _chained(*values):
    """Spark's xxhash64 of several values; nulls are skipped."""
    seed = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else struct.pack("<i", v) if isinstance(v, bool) else struct.pack("<q", v)
            seed = xxhash.xxh64_intdigest(data, seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def ngram_bins(text, buckets):
    """The bins of the words, of their pairs and of the pairs of shapes, and of words that repeat the one before."""
    import regex

    from wavegrid.llm.quality_rules import PAIR, SAME, SHAPE

    shape = regex.sub(r"\p{Lu}+", "A", regex.sub(r"\p{Ll}+", "a", text))
    s, w = [_chained(x) for x in WORD.findall(shape)], WORD.findall(text)
    h, out = [_chained(x) for x in w], []
    for i, x in enumerate(h):
        b, sb = (h[i - 1] << 1, s[i - 1] << 1) if i else (0, 0)
        out += [x % buckets, (x ^ b ^ PAIR) % buckets, (s[i] ^ sb ^ SHAPE) % buckets] + ([SAME % buckets] if i and w[i - 1] == w[i] else [])
    return out


def best_sum(word, scores, unknown, longest):
    """The greatest sum of piece scores over all segmentations of a word."""
    best = [0.0] + [float("-inf")] * len(word)
    for end in range(1, len(word) + 1):
        for n in range(1, min(longest, end) + 1):
            score = scores.get(word[end - n : end], unknown if n == 1 else float("-inf"))
            best[end] = max(best[end], best[end - n] + score)
    return best[-1]
