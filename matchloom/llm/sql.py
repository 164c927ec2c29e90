"""DuckDB statements for the registered queries that SQL can express."""

from __future__ import annotations

EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9::DOUBLE),
reach(id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT p.b, r.other FROM reach r JOIN pairs p ON p.a = r.id)
SELECT v.vec_id, coalesce(l.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM pairs GROUP BY a) l ON l.a = v.vec_id JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) c ON c.id = v.vec_id
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
meets AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
pairs AS (SELECT a, b FROM meets JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
reach(id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT p.b, r.other FROM reach r JOIN pairs p ON p.a = r.id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) c ON c.id = n.doc_id
"""

PERSONAL_DATA = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (
  SELECT doc_id, t, 0 AS rank, 'email' AS kind, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS ms, string_split_regex(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS gs FROM d
  UNION ALL SELECT doc_id, t, 1, 'ip', regexp_extract_all(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), string_split_regex(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') FROM d
  UNION ALL SELECT doc_id, t, 2, 'card', regexp_extract_all(t, '[0-9](?:[ -]?[0-9])+'), string_split_regex(t, '[0-9](?:[ -]?[0-9])+') FROM d
  UNION ALL SELECT doc_id, t, 3, 'phone', regexp_extract_all(t, '\+[0-9][ ().0-9-]+[0-9]'), string_split_regex(t, '\+[0-9][ ().0-9-]+[0-9]') FROM d),
placed AS (
  SELECT doc_id, t, rank, kind, ms[i] AS v, regexp_replace(ms[i], '[^0-9]', '', 'g') AS digits,
    list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda m: length(m))), 0) AS s
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM found WHERE len(ms) > 0)),
base AS (
  SELECT doc_id, t, rank, kind, v, CAST(s AS BIGINT) AS s, CAST(s + length(v) AS BIGINT) AS e FROM placed WHERE CASE kind
    WHEN 'ip' THEN len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST('0' || left(ltrim(p, '0'), 4) AS INTEGER) > 255)) = 0
    WHEN 'card' THEN length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda k:
      CASE WHEN k % 2 = 1 THEN CAST(substr(reverse(digits), k, 1) AS INTEGER) ELSE CAST(substr(reverse(digits), k, 1) AS INTEGER) * 2 - CASE WHEN CAST(substr(reverse(digits), k, 1) AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15 ELSE true END),
sides AS (
  SELECT doc_id, lower(v) AS entity, greatest(s - 80, 0) AS at0, substr(t, greatest(s - 80, 0) + 1, s - greatest(s - 80, 0)) AS part, true AS before FROM base
  UNION ALL SELECT doc_id, lower(v), e, substr(t, e + 1, 80), false FROM base),
trimmed AS (
  SELECT doc_id, entity, CASE WHEN before AND at0 > 0 THEN at0 + length(part) - length(regexp_replace(part, '^[\p{L}\p{M}\p{N}_]+', '')) ELSE at0 END AS at0,
    CASE WHEN before AND at0 > 0 THEN regexp_replace(part, '^[\p{L}\p{M}\p{N}_]+', '') WHEN NOT before AND length(part) = 80 THEN regexp_replace(part, '[\p{L}\p{M}\p{N}_]+$', '') ELSE part END AS part FROM sides),
cut AS (SELECT doc_id, entity, at0, regexp_extract_all(part, '[\p{L}\p{M}\p{N}_]{3,}') AS ms, string_split_regex(part, '[\p{L}\p{M}\p{N}_]{3,}') AS gs FROM trimmed),
words AS (
  SELECT DISTINCT doc_id, entity, lower(ms[i]) AS term, CAST(at0 + list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda m: length(m))), 0) AS BIGINT) AS s, length(ms[i]) AS n
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM cut WHERE len(ms) > 0)),
near AS (SELECT * FROM words w WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = w.doc_id AND b.s <= w.s + w.n AND w.s <= b.e)),
pairs AS (SELECT entity, term, count(DISTINCT doc_id) AS both_df FROM near GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3),
entity_df AS (SELECT lower(v) AS entity, count(DISTINCT doc_id) AS n FROM base GROUP BY 1),
term_df AS (SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct(string_split_regex(lower(t), '[^\p{L}\p{M}\p{N}_]+'))) AS term FROM d) WHERE term IN (SELECT term FROM pairs) GROUP BY 1),
told AS (
  SELECT p.entity, p.term FROM pairs p JOIN entity_df e USING (entity) JOIN term_df f USING (term), (SELECT count(*)::DOUBLE AS n FROM d) t
  WHERE ln(t.n / e.n) > 0 AND ln(p.both_df * t.n / (f.n::DOUBLE * e.n)) >= 0.9::DOUBLE * ln(t.n / e.n)),
spans AS (
  SELECT doc_id, s, rank, e, kind FROM base
  UNION ALL SELECT DISTINCT doc_id, s, 4, s + n, 'term' FROM near JOIN told USING (entity, term)),
digests AS (
  SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans,
    count(*) FILTER (rank = 0) AS n_email, count(*) FILTER (rank = 1) AS n_ip, count(*) FILTER (rank = 2) AS n_card, count(*) FILTER (rank = 3) AS n_phone FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, coalesce(n_email, 0) + coalesce(n_ip, 0) + coalesce(n_card, 0) + coalesce(n_phone, 0) AS n_base, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN digests USING (doc_id)
"""

REPEATED_STRINGS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 200) AS s FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 99)) AS i FROM d WHERE length(x) >= 200)),
gone AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
marked AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 100, true)::INTEGER AS opens FROM gone),
runs AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
spans AS (SELECT doc_id, min(i) AS s, max(i) + 100 AS e FROM runs GROUP BY doc_id, run),
placed AS (SELECT doc_id, s, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM spans),
cut AS (SELECT doc_id, sum(e - s) AS removed, count(*) AS n, max(e) AS last, string_agg(substr(x, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) AS head FROM placed JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

# CRC-32 (reversed polynomial 0xEDB88320) of column s of a relation named keys.
_CRC32 = """
crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
crc_bytes AS (SELECT s, list_transform(range(length(hex(encode(s))) // 2), lambda k: CAST(instr('0123456789ABCDEF', substr(hex(encode(s)), 2 * k + 1, 1)) * 16 + instr('0123456789ABCDEF', substr(hex(encode(s)), 2 * k + 2, 1)) - 17 AS BIGINT)) AS b FROM keys),
crcs AS (SELECT s, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1])), 4294967295::BIGINT) AS crc FROM crc_bytes, crc_table)
"""

RESAMPLED = rf"""
WITH texts AS (SELECT doc_id, text, true AS mine FROM documents UNION ALL SELECT item_id, text, false FROM benchmark),
split AS (SELECT doc_id, mine, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
words AS (SELECT doc_id, mine, unnest(ws) AS s FROM split),
keys AS (SELECT DISTINCT s FROM words), {_CRC32},
hashed AS (SELECT doc_id, mine, crc % 10000 AS bucket FROM words JOIN crcs USING (s)),
n AS (SELECT bucket, count(*) FILTER (mine)::DOUBLE AS s, count(*) FILTER (NOT mine)::DOUBLE AS t FROM hashed GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM n) + 10000) / ((s + 1) * ((SELECT sum(t) FROM n) + 10000)))) AS BIGINT) AS gain FROM n),
weights AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM hashed JOIN gains USING (bucket) WHERE mine GROUP BY doc_id),
scored AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 9), lambda k: CAST(instr('0123456789abcdef', substr(sha256('2024:' || doc_id), k, 1)) - 1 AS BIGINT))), lambda a, x: a * 16 + x) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM split LEFT JOIN weights USING (doc_id) WHERE mine),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS of FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * of // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""

_VALUE = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || {0}, '-')"
_ENCODED = " || ".join(_VALUE.format(c) for c in ("doc_id", "source", "lang", "{n_chars}", "text"))

MANIFEST = f"""
WITH RECURSIVE keys AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS s FROM documents), {_CRC32},
leaves AS (
  SELECT doc_id, lang, sha256({_ENCODED.format(n_chars="n_chars")}) AS leaf, sha256({_ENCODED.format(n_chars="(n_chars + (crc % 7 = 0)::INTEGER)")}) AS claimed
  FROM documents JOIN crcs ON crcs.s = CAST(doc_id AS VARCHAR)),
groups AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT lang FROM documents)),
placed AS (SELECT l.*, g, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS i FROM leaves l JOIN groups ON groups.lang IS NOT DISTINCT FROM l.lang),
nodes(g, level, i, n, h) AS (
  SELECT g, 0, i, count(*) OVER (PARTITION BY g), leaf FROM placed
  UNION ALL SELECT g, max(level) + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY g, i // 2),
subroots AS (SELECT g, h FROM nodes WHERE n = 1),
tops(level, i, n, h) AS (
  SELECT 0, g, count(*) OVER (), h FROM subroots
  UNION ALL SELECT max(level) + 1, i // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY i // 2),
depth AS (SELECT g, max(level) AS d FROM nodes GROUP BY g),
steps AS (
  SELECT p.doc_id, p.leaf, level, p.i >> level AS place, n.h FROM placed p JOIN nodes n ON n.g = p.g AND n.n > 1 AND n.i = xor(p.i >> level, 1)
  UNION ALL SELECT p.doc_id, p.leaf, d + level, p.g >> level, t.h FROM placed p JOIN depth USING (g) JOIN tops t ON t.n > 1 AND t.i = xor(p.g >> level, 1)),
proofs AS (SELECT doc_id, leaf, string_agg(h, '' ORDER BY level) AS proof FROM steps GROUP BY ALL),
folds(doc_id, leaf, g, level, h) AS (
  SELECT doc_id, leaf, g, 0, claimed FROM placed
  UNION ALL SELECT f.doc_id, f.leaf, f.g, f.level + 1, sha256(CASE WHEN s.place % 2 = 1 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END)
  FROM folds f JOIN depth USING (g) LEFT JOIN steps s ON s.doc_id = f.doc_id AND s.leaf = f.leaf AND s.level = f.level WHERE f.level < d + (SELECT max(level) FROM tops))
SELECT p.doc_id, p.leaf, r.h AS subroot, t.h AS root, sha256(coalesce(proof, '')) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM placed p JOIN subroots r USING (g) JOIN depth USING (g) LEFT JOIN proofs q ON q.doc_id = p.doc_id AND q.leaf = p.leaf
JOIN folds f ON f.doc_id = p.doc_id AND f.leaf = p.leaf, (SELECT h FROM tops WHERE n = 1) t WHERE f.level = d + (SELECT max(level) FROM tops)
"""

ORACLE: dict[str, str] = {"op2_collision_counting": EMBEDDINGS, "op4_minhash_odd_sketch": NEAR_DUPLICATES, "op7_pii_disclosure": PERSONAL_DATA, "op11_suffix_array_dedup": REPEATED_STRINGS, "op12_importance_resampling": RESAMPLED, "op13_merkle_manifest": MANIFEST}
