"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

SUFFIX_ARRAY_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
place AS (SELECT doc_id, i, hash(substr(h, CAST(2 * i + 1 AS BIGINT), 800)) AS k
          FROM (SELECT doc_id, h, unnest(range(0, CAST(n AS BIGINT) - 399)) AS i FROM d WHERE n >= 400)),
again AS (SELECT k FROM place GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM place WHERE k IN (FROM again)),
run AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hit),
span AS (SELECT doc_id, r, min(i) AS a, max(i) + 400 AS b FROM run GROUP BY doc_id, r),
gap AS (SELECT d.doc_id, coalesce(lag(b) OVER w, 0) AS a, s.a AS b FROM d JOIN span s USING (doc_id) WINDOW w AS (PARTITION BY d.doc_id ORDER BY s.a)
        UNION ALL SELECT d.doc_id, coalesce(max(b), 0), any_value(n) FROM d LEFT JOIN span USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)), '' ORDER BY a) AS t FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
total AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS gone, count(*) AS spans FROM span GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(t)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN total USING (doc_id)
"""

JACCARD_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
gram AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS g
         FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS s FROM gram GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM gram a JOIN gram b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM common JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE c >= 0.8 * (p.n + q.n - c) - 1e-9),
reach AS (SELECT x, y FROM link UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
class AS (SELECT x AS doc_id, least(x, min(y)) AS class_id FROM reach GROUP BY x),
links AS (SELECT x AS doc_id, count(*) AS n_links FROM link GROUP BY x),
same AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS set_id FROM size)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(set_id, d.doc_id) AS set_id
FROM d LEFT JOIN class USING (doc_id) LEFT JOIN links USING (doc_id) LEFT JOIN same USING (doc_id)
"""

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
place AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS k
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
first AS (SELECT k, min(doc_id) AS m FROM place GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM place JOIN first USING (k) WHERE m < doc_id),
word AS (SELECT doc_id, unnest(w) AS v, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT word.doc_id, count(gone.p) AS n, string_agg(v, ' ' ORDER BY word.p) FILTER (WHERE gone.p IS NULL) AS t
         FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

# CRC-32 byte by byte: the table of 256 follows from the polynomial
_CRC_TABLE = """crc_table AS (SELECT list(v ORDER BY b) AS crc_of FROM (SELECT b, list_reduce(range(8),
  lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, CAST(b AS BIGINT)) AS v FROM range(256) AS bytes(b)))"""


def _crc32(text: str) -> str:
    """Of a text expression, in a query that joins ``crc_table``."""
    spelled = f"hex(encode({text}))"
    numbers = f"list_transform(range(CAST(strlen({text}) AS BIGINT)), lambda i: CAST('0x' || substr({spelled}, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    step = "lambda x, b: xor(x >> 8, crc_of[CAST(xor(x & 255, b) AS BIGINT) + 1])"
    return f"CAST(xor(4294967295, list_reduce({numbers}, {step}, 4294967295)) AS BIGINT)"


SHARDING = f"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
             left(md5(coalesce(text, '')), 16) AS g, left(md5(coalesce(CAST(doc_id AS VARCHAR), '-')), 16) AS k FROM documents),
placed AS (SELECT *, sum(size) OVER (ORDER BY g, k) - size AS b, sum(size) OVER (PARTITION BY g) AS gw, sum(size) OVER () AS total FROM d),
begun AS (SELECT *, min(b) OVER (PARTITION BY g) AS gb FROM placed),
sharded AS (SELECT *, CAST((CASE WHEN gw * 16 * 100 <= total THEN 2 * gb + gw ELSE 2 * b + size END) * 16 // (2 * total) AS INTEGER) AS shard FROM begun)
SELECT doc_id, size, {_crc32('t')} AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY g, k) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM sharded, crc_table
"""

_PLAIN_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

RESAMPLING = f"""
WITH {_CRC_TABLE},
said AS (SELECT 's' AS side, doc_id, {_PLAIN_WORDS} AS w FROM documents UNION ALL SELECT 't', item_id, {_PLAIN_WORDS} FROM benchmark),
feature AS (SELECT side, doc_id, unnest(w) AS f FROM said UNION ALL SELECT side, doc_id, w[i] || ' ' || w[i + 1] FROM (SELECT *, unnest(range(1, len(w))) AS i FROM said)),
hashed AS (SELECT f, {_crc32('f')} % 10000 AS bucket FROM (SELECT DISTINCT f FROM feature), crc_table),
counted AS (SELECT side, doc_id, bucket, count(*) AS n FROM feature JOIN hashed USING (f) GROUP BY ALL),
share AS (SELECT b AS bucket, coalesce(sum(n) FILTER (WHERE side = 's'), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 't'), 0) AS t
          FROM range(10000) AS buckets(b) LEFT JOIN counted ON bucket = b GROUP BY b),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(sum(s) OVER () + 10000 AS DOUBLE)
                / (CAST(s + 1 AS DOUBLE) * CAST(sum(t) OVER () + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM share),
total AS (SELECT doc_id, sum(n) AS n, sum(n * gain) AS g FROM counted JOIN gain USING (bucket) WHERE side = 's' GROUP BY doc_id),
weighed AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features,
                   CAST(coalesce((g - ((g % n) + n) % n) // n, 0) AS BIGINT) AS weight,
                   CAST('0x' || left(sha256('7:' || CAST(doc_id AS VARCHAR)), 8) AS BIGINT) AS h
            FROM said LEFT JOIN total USING (doc_id) WHERE side = 's'),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST(h AS DOUBLE) + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM weighed),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS able FROM scored WHERE n_words >= 20)
SELECT scored.doc_id, scored.n_features, scored.weight, scored.score, CASE WHEN r <= 25 * able // 100 THEN r END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"


def _tree(name: str, base: str) -> str:
    """All levels over ``base`` (tree, pos, node, n): k counts them from 0."""
    return f"""{name} AS (SELECT 0 AS k, tree, pos, node, n FROM {base}
  UNION ALL SELECT k + 1, tree, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (n + 7) // 8 FROM {name} WHERE n > 1 GROUP BY k, tree, pos // 8, n)"""


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
MANIFEST = f"""
WITH RECURSIVE {_CRC_TABLE},
leaf AS (SELECT doc_id, lang, {_leaf('text')} AS leaf, CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {_leaf(_LOWERED)} END AS tampered,
                dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos,
                count(*) OVER (PARTITION BY lang) AS n FROM documents, crc_table),
low_base AS (SELECT tree, pos, leaf AS node, n FROM leaf),
{_tree('low', 'low_base')},
sub AS (SELECT tree, node, k AS height FROM low WHERE n = 1),
high_base AS (SELECT 0 AS tree, tree AS pos, node, count(*) OVER () AS n FROM sub),
{_tree('high', 'high_base')},
root AS (SELECT node AS root FROM high WHERE n = 1),
sibling AS (
  SELECT doc_id, low.k AS step, low.pos < leaf.pos // CAST(8 ** low.k AS BIGINT) AS before, low.pos AS pos, low.node AS node
  FROM leaf JOIN low ON low.tree = leaf.tree AND low.n > 1 AND low.pos // 8 = leaf.pos // CAST(8 ** (low.k + 1) AS BIGINT)
  WHERE low.pos <> leaf.pos // CAST(8 ** low.k AS BIGINT)
  UNION ALL
  SELECT doc_id, 1000 + high.k, high.pos < leaf.tree // CAST(8 ** high.k AS BIGINT), high.pos, high.node
  FROM leaf JOIN high ON high.n > 1 AND high.pos // 8 = leaf.tree // CAST(8 ** (high.k + 1) AS BIGINT)
  WHERE high.pos <> leaf.tree // CAST(8 ** high.k AS BIGINT)),
stage AS (SELECT DISTINCT doc_id, low.k AS step FROM leaf JOIN low ON low.tree = leaf.tree AND low.n > 1
          UNION SELECT doc_id, 1000 + high.k FROM leaf, high WHERE high.n > 1),
way AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY step) AS step,
               coalesce(string_agg(node, '' ORDER BY pos) FILTER (WHERE before), '') AS head, coalesce(string_agg(node, '' ORDER BY pos) FILTER (WHERE NOT before), '') AS tail
        FROM stage LEFT JOIN sibling USING (doc_id, step) GROUP BY doc_id, step),
fold AS (SELECT doc_id, 0 AS step, coalesce(tampered, leaf) AS node FROM leaf
         UNION ALL SELECT fold.doc_id, way.step, sha256(head || node || tail) FROM fold JOIN way ON way.doc_id = fold.doc_id AND way.step = fold.step + 1),
folded AS (SELECT doc_id, arg_max(node, step) AS folded_root FROM fold GROUP BY doc_id),
proof AS (SELECT doc_id, sha256(string_agg(head || tail, '' ORDER BY step)) AS proof_sha256 FROM way GROUP BY doc_id)
SELECT doc_id, leaf, sub.node AS subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaf JOIN sub USING (tree) JOIN folded USING (doc_id) LEFT JOIN proof USING (doc_id), root
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op7_suffix_array_dedup": SUFFIX_ARRAY_DEDUP,
        "op8_jaccard_join": JACCARD_JOIN,
        "op9_substring_dedup": SUBSTRING_DEDUP,
        "op11_sharding": SHARDING,
        "op12_resampling": RESAMPLING,
        "op13_manifest": MANIFEST,
    }
