"""The thin queries of the operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .conversation_repair import op12_conversation_repair
from .decontamination import op9_benchmark_decontamination
from .line_dedup import op8_line_dedup
from .near_dedup import op6_minhash_near_dedup
from .pii import op4_pii
from .quality_classifier import op2_quality_classifier
from .quality_rules import op5_quality_rules
from .sentencepiece_viterbi import op3_sentencepiece
from .simhash import op11_simhash_near_dedup
from .substring_dedup import op1_substring_dedup
from .token_shards import op10_token_shards
from .toxicity import op7_toxicity
from .whitening import op13_embedding_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [
        op1_substring_dedup,
        op2_quality_classifier,
        op3_sentencepiece,
        op4_pii,
        op5_quality_rules,
        op6_minhash_near_dedup,
        op7_toxicity,
        op8_line_dedup,
        op9_benchmark_decontamination,
        op10_token_shards,
        op11_simhash_near_dedup,
        op12_conversation_repair,
        op13_embedding_whitening,
    ]
    return {f.__name__: f for f in every}


#: A text's words, as DuckDB lists.
_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def oracle_sql() -> dict[str, str]:
    op1 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
     s AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS p, w FROM d WHERE len(w) >= 13),
     k AS (SELECT doc_id, p, sha256(array_to_string(w[p:p+12], ' ')) AS h FROM s),
     m AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS least FROM k),
     r AS (SELECT DISTINCT doc_id, p + o AS q FROM m, range(13) t(o) WHERE least < doc_id),
     g AS (SELECT doc_id, list(q) AS gone, count(*) AS n FROM r GROUP BY doc_id),
     x AS (SELECT d.doc_id, unnest(range(1, len(w) + 1)) AS q, w FROM d),
     y AS (SELECT x.doc_id, string_agg(w[x.q], ' ' ORDER BY x.q) AS t FROM x ANTI JOIN r ON x.doc_id = r.doc_id AND x.q = r.q GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(y.t, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN y USING (doc_id)"""
    key = r"translate(regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    op8 = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL),
     x AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS p FROM d),
     k AS (SELECT doc_id, l, p, {key} AS key FROM x),
     m AS (SELECT doc_id, l, p, NOT (length(key) >= 10 AND min(doc_id) OVER (PARTITION BY key) < doc_id) AS keep FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT keep) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY p) FILTER (keep), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
    # crc32 by its definition: a byte at a time, eight shifts of the reflected polynomial each
    byte = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    named = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    codes = f"list_transform(string_split({named}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: {byte}), 4294967295)"
    blanks = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    op12 = rf"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS k FROM conversations),
     dam AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                    unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM src WHERE k <> 0),
     ord AS (SELECT *, coalesce(conv_id, -1) AS c, conv_id IS NULL AS nameless, trim(text, {blanks}) AS bare,
                    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
                    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS occurrence FROM dam),
     flt AS (SELECT conv_id, c, nameless, i, turn, role, text, left(role, 1) AS r, count(*) OVER (PARTITION BY conv_id) AS n,
                    CASE WHEN bare = '' THEN 'b' WHEN occurrence > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'o' END AS f FROM ord),
     pre(q, q1, cost, audit, line) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
                    (0, 2, 5, 'I', chr(10) || 'user:'), (1, 2, 5, 'I', chr(10) || 'user:'), (2, 3, 5, 'I', chr(10) || 'assistant:'), (3, 2, 5, 'I', chr(10) || 'user:')),
     act(letter, q1, r, q2, cost, role) AS (VALUES ('D', 0, NULL, 0, 2, NULL), ('D', 1, NULL, 1, 2, NULL), ('D', 2, NULL, 2, 2, NULL), ('D', 3, NULL, 3, 2, NULL),
                    ('K', 0, 's', 1, 0, NULL), ('K', 0, 'u', 2, 0, NULL), ('K', 1, 'u', 2, 0, NULL), ('K', 2, 'a', 3, 0, NULL), ('K', 3, 'u', 2, 0, NULL),
                    ('R', 0, NULL, 2, 1, 'user'), ('R', 1, NULL, 2, 1, 'user'), ('R', 2, NULL, 3, 1, 'assistant'), ('R', 3, NULL, 2, 1, 'user')),
     fin(q, cost, audit, line) AS (VALUES (0, 0, '', ''), (3, 0, '', ''), (2, 5, 'I', chr(10) || 'assistant:'), (1, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
     dp AS (SELECT c, nameless, CAST(0 AS BIGINT) AS i, 0 AS q, row(0, '', '') AS best FROM flt WHERE i = 1
       UNION ALL
       SELECT d.c, d.nameless, x.i, a.q2,
              min(row(d.best[1] + p.cost + a.cost + CASE WHEN a.letter <> 'D' AND x.f = 't' THEN 5 ELSE 0 END, d.best[2] || p.audit || a.letter,
                      d.best[3] || p.line || CASE a.letter WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || x.role || ':' || x.text ELSE chr(10) || a.role || ':' || x.text END))
       FROM dp d JOIN flt x ON x.c = d.c AND x.nameless = d.nameless AND x.i = d.i + 1 JOIN pre p ON p.q = d.q
            JOIN act a ON a.q1 = p.q1 AND (a.r IS NULL OR a.r = x.r) AND (a.letter = 'D' OR x.f IN ('o', 't'))
       GROUP BY d.c, d.nameless, x.i, a.q2),
     done AS (SELECT d.c, d.nameless, min(row(d.best[1] + f.cost, d.best[2] || f.audit, d.best[3] || f.line)) AS best
              FROM dp d JOIN fin f USING (q) JOIN (SELECT DISTINCT c, nameless, n FROM flt) z ON z.c = d.c AND z.nameless = d.nameless AND z.n = d.i GROUP BY ALL),
     pairs AS (SELECT c, nameless, lag(r) OVER (PARTITION BY c, nameless ORDER BY i) || r AS two FROM flt),
     bad AS (SELECT c, nameless, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY ALL),
     facts AS (SELECT c, nameless, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank,
                      count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated FROM flt GROUP BY ALL),
     ids AS (SELECT DISTINCT conv_id, coalesce(conv_id, -1) AS c, conv_id IS NULL AS nameless FROM conversations)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best[1], 0) AS BIGINT) AS cost,
       coalesce(best[2], '') AS audit, sha256(substr(coalesce(best[3], ''), 2)) AS repaired_sha256
FROM ids LEFT JOIN facts USING (c, nameless) LEFT JOIN bad USING (c, nameless) LEFT JOIN done USING (c, nameless)"""
    return {"op1_substring_dedup": op1, "op8_line_dedup": op8, "op12_conversation_repair": op12}
