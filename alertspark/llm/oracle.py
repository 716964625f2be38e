"""DuckDB statements for the queries that SQL can express.

They are written from the contracts, not from the operators: patterns, limits
and candidate cutoffs are stated here again.

None is given for op2 (the classes come from an iterative search), op3 (a
400-byte window at every place is too slow), op4 (parsing), op5 (alignment), op6 and op7
(the tokenizer) and op9 (the tree): tests/llm holds them against brute force.
"""

from __future__ import annotations

_SECRETS = r"""
WITH rules(rank, kind, p, g, least) AS (VALUES
  (0, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 12),
  (1, 'access', 'AKIA[A-Z0-9]+', 0, 18),
  (2, 'hex', '[0-9a-f]+', 0, 16),
  (3, 'private_key', '-----BEGIN [A-Z ]*PRIVATE KEY-----', 0, 1),
  (4, 'jwt', 'eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+', 0, 1)),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, rank, kind, least, list_transform(string_split_regex(t, p), lambda x: length(x)) AS gaps,
             list_transform(regexp_extract_all(t, p), lambda x: length(x)) AS hits,
             list_transform(regexp_extract_all(t, p, g), lambda x: length(x)) AS vals
      FROM d, rules),
e AS (SELECT doc_id, rank, kind, least, gaps, hits, vals, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0),
s AS (SELECT doc_id, rank, kind, coalesce(list_sum(gaps[1:i]), 0) + coalesce(list_sum(hits[1:i - 1]), 0) AS a, hits[i] AS n
      FROM e WHERE vals[i] >= least),
f AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
             string_agg(kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT, ',' ORDER BY a, rank) FILTER (rank < 3) AS base,
             string_agg(kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT, ',' ORDER BY a, rank) AS spans
      FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f USING (doc_id)
"""

_RULES = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '(null)') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, stratum, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) AS n
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM g WHERE n > 1) GROUP BY doc_id),
c AS (SELECT doc_id, stratum, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines,
             len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM w LEFT JOIN r USING (doc_id)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
             n_symbols * 1000 // greatest(n_words, 1) AS s1, n_dup_lines * 1000 // greatest(n_lines, 1) AS s2,
             n_repeat_words * 1000 // greatest(n_words, 1) AS s3, word_chars * 1000 // greatest(n_words, 1) AS s4 FROM c),
lab AS (SELECT doc_id, max(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
held AS (SELECT * FROM v JOIN lab USING (doc_id) WHERE NOT base_failed),
cuts(sig, cutoff) AS (VALUES (1, 50), (1, 100), (1, 200), (1, 400), (1, 800), (2, 100), (2, 200), (2, 300), (2, 400), (2, 600),
  (3, 50), (3, 80), (3, 110), (3, 140), (3, 170), (4, 7000), (4, 8000), (4, 10000), (4, 15000), (4, 25000)),
k AS (SELECT stratum, sig, cutoff, count(*) FILTER (good = 1) AS n,
             count(*) FILTER (good = 1 AND [s1, s2, s3, s4][sig] > cutoff) AS k,
             count(*) FILTER (good = 0 AND [s1, s2, s3, s4][sig] > cutoff) AS caught
      FROM held, cuts GROUP BY stratum, sig, cutoff),
p AS (SELECT *, list_sum(list_transform(range(0, k + 1), lambda i: exp(CASE WHEN n = 0 THEN 0 ELSE
             (CASE WHEN i = 0 OR i = n THEN 0 ELSE lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) END) END
             + i * ln(0.005) + (n - i) * ln(0.995)))) AS tail,
             (SELECT count(DISTINCT stratum) FROM k) * 20 AS tests FROM k),
best AS (SELECT stratum, sig, cutoff FROM p WHERE caught > k AND tail <= 0.05 / tests
         QUALIFY row_number() OVER (PARTITION BY stratum, sig ORDER BY caught - k DESC, cutoff DESC) = 1),
b AS (SELECT stratum, max(cutoff) FILTER (sig = 1) AS c1, max(cutoff) FILTER (sig = 2) AS c2, max(cutoff) FILTER (sig = 3) AS c3,
             max(cutoff) FILTER (sig = 4) AS c4 FROM best GROUP BY stratum)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(s1 > c1, false) AND NOT coalesce(s2 > c2, false) AND NOT coalesce(s3 > c3, false)
       AND NOT coalesce(s4 > c4, false) AS kept
FROM v LEFT JOIN b USING (stratum)
"""

_JOIN = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
          JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM w UNION SELECT doc_id, b FROM reach JOIN links ON a = other)
SELECT doc_id, coalesce(max(n.n), 0) AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

_MERKLE = """
WITH RECURSIVE x AS (
  SELECT doc_id, source, lang, n_chars, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
f AS (SELECT doc_id, coalesce('s' || source, 'n') AS source, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
             || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
             coalesce(strlen(text) || ':' || text, '-') AS body, coalesce(strlen(low) || ':' || low, '-') AS body2 FROM x),
-- CRC-32, a bit at a time: eight shifts for each byte of the id.
crc(doc_id, s, i, c) AS (
  SELECT doc_id, doc_id::VARCHAR, 0, 4294967295 FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL
  SELECT doc_id, s, i + 1, list_reduce([xor(c, ascii(substr(s, i + 1, 1))::BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
                                       lambda v, _: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)
  FROM crc WHERE i < length(s)),
t AS (SELECT doc_id FROM crc WHERE i = length(s) AND xor(c, 4294967295) % 5 = 0),
l AS (SELECT doc_id, source, sha256(head || body) AS leaf, CASE WHEN doc_id IN (SELECT doc_id FROM t) THEN sha256(head || body2) ELSE sha256(head || body) END AS changed FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
nodes(source, lv, pos, d) AS (
  SELECT source, 0, pos, leaf FROM p
  UNION ALL
  SELECT source, lv + 1, pos // 16, sha256(string_agg(d, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM nodes) WHERE n > 1 GROUP BY source, lv + 1, pos // 16),
height AS (SELECT source, max(lv) AS h FROM nodes GROUP BY source),
sub AS (SELECT source, d AS subroot, h, row_number() OVER (ORDER BY source) - 1 AS pos
        FROM nodes JOIN height USING (source) WHERE lv = h),
tops(lv, pos, d) AS (
  SELECT 0, pos, subroot FROM sub
  UNION ALL
  SELECT lv + 1, pos // 16, sha256(string_agg(d, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS n FROM tops) WHERE n > 1 GROUP BY lv + 1, pos // 16),
root AS (SELECT d AS root, lv AS h FROM tops ORDER BY lv DESC LIMIT 1),
-- Every level of every document's way: the run's nodes, in order, and the own place.
steps AS (
  SELECT p.doc_id, p.leaf, n.lv, n.pos, n.d, p.pos // (16 ** n.lv)::BIGINT AS own FROM p JOIN nodes n
    ON p.source = n.source AND p.pos // (16 ** (n.lv + 1))::BIGINT = n.pos // 16 JOIN sub ON sub.source = p.source AND n.lv < sub.h
  UNION ALL
  SELECT p.doc_id, p.leaf, sub.h + n.lv, n.pos, n.d, sub.pos // (16 ** n.lv)::BIGINT FROM p JOIN sub USING (source) JOIN tops n
    ON sub.pos // (16 ** (n.lv + 1))::BIGINT = n.pos // 16 JOIN root ON n.lv < root.h),
proof AS (SELECT doc_id, leaf, sha256(coalesce(string_agg(d, '' ORDER BY lv, pos) FILTER (pos <> own), '')) AS proof_sha256 FROM steps GROUP BY ALL),
runs AS (SELECT doc_id, leaf, lv, coalesce(string_agg(d, '' ORDER BY pos) FILTER (pos < own), '') AS before,
                coalesce(string_agg(d, '' ORDER BY pos) FILTER (pos > own), '') AS after FROM steps GROUP BY ALL),
fold(doc_id, leaf, lv, d) AS (
  SELECT doc_id, leaf, 0, changed FROM p
  UNION ALL
  SELECT fold.doc_id, fold.leaf, fold.lv + 1, sha256(before || d || after) FROM fold JOIN runs USING (doc_id, leaf, lv)),
last AS (SELECT doc_id, leaf, d AS folded_root FROM fold QUALIFY row_number() OVER (PARTITION BY doc_id, leaf ORDER BY lv DESC) = 1)
SELECT p.doc_id, p.leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified,
       (sub.h + root.h)::INT AS n_copied
FROM p JOIN sub USING (source) CROSS JOIN root LEFT JOIN proof USING (doc_id, leaf) JOIN last USING (doc_id, leaf)
"""

_NEGATIVES = """
WITH x AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256.0 * c::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda c: coalesce(isfinite(c), false)))),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
      FROM x a JOIN x b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 3
"""

ORACLE: dict[str, str] = {
    "op1_secret_ledger": _SECRETS,
    "op8_risk_rules": _RULES,
    "op10_partenum_join": _JOIN,
    "op11_merkle_manifest": _MERKLE,
    "op12_cover_negatives": _NEGATIVES,
}
