"""The queries that SQL can express, written from their contracts for another engine."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Checksums: the table of 256 entries by its rule, and the fold over a text's bytes.
_CRC_TABLE = """
crc_bits(n, k, c) AS (SELECT i, 0, i FROM range(256) AS t(i)
  UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY n) AS entries FROM crc_bits WHERE k = 8)
"""


def _crc(text: str) -> str:
    """Needs ``crc_table`` among the tables."""
    return f"""xor(list_reduce(
      list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::BIGINT),
      lambda c, b: xor(entries[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT)"""


def _words(table: str, key: str) -> str:
    return f"""SELECT {key}, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_WORD}'), []) AS w FROM {table}"""


OP9 = f"""
WITH d AS ({_words('documents', 'doc_id')}), b AS ({_words('benchmark', 'item_id')}),
item AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, unnest(list_transform(range(greatest(len(w) - 9, 1)), lambda i: array_to_string(w[i + 1:i + 10], ' '))) AS shingle
  FROM b WHERE len(w) > 0),
spans AS (
  SELECT doc_id, k, unnest(range(len(w) - k + 1)) AS i, w FROM d, (SELECT DISTINCT k FROM item) WHERE len(w) >= k),
hit AS (
  SELECT doc_id, item_id, i, s.k FROM (SELECT doc_id, k, i, array_to_string(w[i + 1:i + k], ' ') AS shingle FROM spans) s JOIN item USING (k, shingle)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, covered.n IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
digits AS (SELECT page_id, html, h, list_transform(range(32), lambda i:
    (('0x' || substr(h || '00', (5 * i) // 4 + 1, 3))::INTEGER >> (7 - (5 * i) % 4)) & 31) AS five FROM p),
named AS (SELECT page_id, html, strlen(html) AS payload_bytes,
    array_to_string(list_transform(five, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x + 1, 1)), '') AS payload_digest FROM digits),
first AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS chosen FROM named)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = chosen THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> chosen THEN chosen END AS refers_to FROM first
"""

OP11 = f"""
WITH RECURSIVE {_CRC_TABLE},
d AS ({_words('documents', 'doc_id')}), b AS ({_words('benchmark', 'item_id')}),
runs AS (
  SELECT doc_id AS id, 0 AS side, unnest(flatten(list_transform([1, 2, 3], lambda n: list_transform(range(greatest(len(w) - n + 1, 0)), lambda i: array_to_string(w[i + 1:i + n], ' '))))) AS f FROM d
  UNION ALL
  SELECT item_id, 1, unnest(flatten(list_transform([1, 2, 3], lambda n: list_transform(range(greatest(len(w) - n + 1, 0)), lambda i: array_to_string(w[i + 1:i + n], ' '))))) FROM b),
buckets AS (SELECT f, {_crc('f')} % 10000 AS bucket FROM (SELECT DISTINCT f FROM runs), crc_table),
counted AS (SELECT id, side, bucket, count(*) AS n FROM runs JOIN buckets USING (f) GROUP BY ALL),
sums AS (SELECT i AS bucket, coalesce(sum(n) FILTER (WHERE side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0)::DOUBLE AS t
  FROM range(10000) AS r(i) LEFT JOIN counted c ON c.bucket = i GROUP BY i),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000)) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM sums),
weights AS (SELECT id AS doc_id, sum(n * gain) AS weight, sum(n) AS n_features FROM counted JOIN gains USING (bucket) WHERE side = 0 GROUP BY id),
scored AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM d LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
    count(*) OVER (PARTITION BY n_words >= 20) AS all_rows FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= (5 * all_rows) // 100 THEN place END AS rank FROM ranked
"""

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP12 = f"""
WITH RECURSIVE {_CRC_TABLE},
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
faulty AS (SELECT *, {_crc('name')} % 20 AS fault FROM named, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM faulty WHERE fault <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, rtrim(text, {_SPACE}) AS body FROM damaged),
rows AS (
  SELECT conv_id, i, turn, role, text, substr(role, 1, 1) AS initial,
    CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN substr(body, -1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM placed),
-- Four states (0 nothing, 1 system, 2 user, 3 assistant); empty rows lead from one to another.
fills(a, b, cost, edits, put) AS (VALUES (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 3, 'I', ['user:']),
  (1, 2, 3, 'I', ['user:']), (2, 3, 3, 'I', ['assistant:']), (3, 2, 3, 'I', ['user:']), (0, 3, 6, 'II', ['user:', 'assistant:']),
  (1, 3, 6, 'II', ['user:', 'assistant:']), (2, 2, 6, 'II', ['assistant:', 'user:']), (3, 3, 6, 'II', ['user:', 'assistant:'])),
walk(conv_id, i, state, best) AS (
  SELECT conv_id, 0::BIGINT, 0, {{'cost': 0, 'audit': '', 'put': []::VARCHAR[]}} FROM (SELECT DISTINCT conv_id FROM rows)
  UNION ALL
  SELECT w.conv_id, w.i + 1, ways.state, min({{'cost': w.best.cost + f.cost + ways.cost, 'audit': w.best.audit || f.edits || ways.edit,
      'put': w.best.put || f.put || ways.put}})
  FROM walk w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1 JOIN fills f ON f.a = w.state,
    LATERAL (
      SELECT f.b AS state, 4 AS cost, 'D' AS edit, []::VARCHAR[] AS put
      UNION ALL SELECT CASE r.initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, CASE WHEN r.fault = 'truncated' THEN 3 ELSE 0 END, 'K', [r.role || ':' || r.text]
        WHERE coalesce(r.fault, 'truncated') = 'truncated' AND ((r.initial = 's' AND f.b = 0) OR (r.initial = 'u' AND f.b <> 2) OR (r.initial = 'a' AND f.b = 2))
      UNION ALL SELECT CASE WHEN f.b = 2 THEN 3 ELSE 2 END, 3 + CASE WHEN r.fault = 'truncated' THEN 3 ELSE 0 END, 'R',
          [CASE WHEN f.b = 2 THEN 'assistant:' ELSE 'user:' END || r.text]
        WHERE coalesce(r.fault, 'truncated') = 'truncated') ways
  GROUP BY w.conv_id, w.i, ways.state),
lengths AS (SELECT conv_id, count(*) AS n FROM rows GROUP BY conv_id),
ended AS (
  SELECT w.conv_id, min({{'cost': best.cost + f.cost, 'audit': best.audit || f.edits, 'put': best.put || f.put}}) AS best
  FROM walk w JOIN lengths l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.n = w.i JOIN fills f ON f.a = w.state AND f.b IN (0, 3) GROUP BY w.conv_id),
pairs AS (SELECT conv_id, initial || lead(initial) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM rows),
illegal AS (SELECT conv_id, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS n FROM pairs GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated FROM rows GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal.n, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit,
  sha256(coalesce(array_to_string(best.put, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN illegal ON illegal.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM c.conv_id
"""

ORACLES = {
    "op7_warc": OP7, "op9_decontamination": OP9, "op11_importance_resampling": OP11, "op12_conversation_repair": OP12,
}
