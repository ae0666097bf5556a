"""The operators bound to their tables, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from casemeter.llm import (
    block_anchors, exact_dedup, fp_search, lattice_links, line_crf, minhash_dedup, nbest_pieces, secret_models, sharding, spaced_seeds, sparse_suffixes,
    turn_repair, warc_archive,
)
from casemeter.llm.common import table

#: A public SentencePiece model; the file is read where it lies.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SHARD_BYTES = 1 << 20


def op1_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seeds.flag(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short_items=True).drop("row")


def op2_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest_pieces.encode(table(spark, sf_dir, "documents"), MODEL)


def op3_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents")).drop("row")


def op4_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_models.scan(table(spark, sf_dir, "documents"))


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc_archive.round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_suffixes.deduplicate(table(spark, sf_dir, "documents"))


def op7_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), SHARD_BYTES).drop("row")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.classify(table(spark, sf_dir, "documents"), size=3, percent=85).drop("row", "first")


def op9_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_anchors.deduplicate(table(spark, sf_dir, "documents"))


def op10_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_crf.classify(docs, line_crf.train(docs, table(spark, sf_dir, "labels")))


def op11_lattice_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_links.classify(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op12_lightest_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(table(spark, sf_dir, "conversations"))


def op13_fp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fp_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_spaced_seeds, op2_nbest_pieces, op3_digest_index, op4_markov_secrets, op5_warc_archive, op6_sparse_suffixes, op7_extendible_shards,
        op8_minhash, op9_block_anchors, op10_line_crf, op11_lattice_links, op12_lightest_repair, op13_fp_search,
    )
}

_WINDOWS_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - {size} + 2)) AS s FROM w WHERE len(words) >= {size}),
g AS (SELECT doc_id, s, md5(array_to_string(words[s:s + {size} - 1], ' ')) AS h FROM p),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS n FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + {size})) AS pos FROM r WHERE n > 1),
k AS (SELECT doc_id, list(pos) AS gone FROM c GROUP BY doc_id),
m AS (SELECT w.doc_id, words, coalesce(gone, []) AS gone FROM w LEFT JOIN k USING (doc_id)),
f AS (
  SELECT m.doc_id, len(words) AS n_words, len(gone) AS n_removed, gone,
    sha256(array_to_string(list_filter(words, lambda x, i: NOT list_contains(gone, i)), ' ')) AS kept_sha256 FROM m),
e AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM c),
b AS (SELECT doc_id, run, min(pos) - 1 AS a, max(pos) AS z FROM e GROUP BY doc_id, run),
t AS (SELECT doc_id, string_agg(a || ':' || z, ',' ORDER BY a) AS spans FROM b GROUP BY doc_id)
SELECT f.doc_id, n_words, n_removed, kept_sha256, coalesce(spans, '') AS spans FROM f LEFT JOIN t USING (doc_id)"""

CHECKS: dict[str, str] = {
    "op3_digest_index": r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)""",
    "op5_warc_archive": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS lead FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((CAST('0x' || substr(hex, CAST(5 * (k // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> lead THEN lead END AS refers_to
FROM d""",
    "op6_sparse_suffixes": _WINDOWS_SQL.format(size=50),
    "op7_extendible_shards": f"""
WITH h AS (
  SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS hash, octet_length(encode(coalesce(text, ''))) AS bytes FROM documents),
l AS (SELECT doc_id, bytes, depth, hash >> CAST(60 - depth AS BIGINT) AS shard FROM h, range(0, 61) AS d(depth)),
s AS (SELECT *, sum(bytes) OVER g AS shard_bytes, count(*) OVER g AS shard_docs FROM l WINDOW g AS (PARTITION BY depth, shard)),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS n FROM s WHERE shard_bytes <= {SHARD_BYTES} OR depth = 60)
SELECT doc_id, bytes, depth, shard, CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_docs FROM f WHERE n = 1""",
    "op9_block_anchors": _WINDOWS_SQL.format(size=20),
    # All pairs; the operator finds 0.995 of the links at cosine 0.95 and more above it.
    "op11_lattice_links": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND len(p.e) = len(q.e)
  WHERE list_cosine_similarity(p.e, q.e) >= 0.95),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a),
c AS (SELECT a AS vec_id, min(b) AS least FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(c.least, vec_id)) AS component_id, vec_id <= coalesce(c.least, vec_id) AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)""",
    "op12_lightest_repair": r"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n)) AS t),
src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '') AS key FROM conversations),
hit AS (
  SELECT src.*, xor(list_reduce(list_transform(key, lambda x: CAST(unicode(x) AS BIGINT)),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295), 4294967295) % 20 AS d FROM src, tab),
dam AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS again FROM hit WHERE d <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), again) AS p FROM dam),
f AS (
  SELECT conv_id, turn, role, text, p, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS i,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY p) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 'd'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '-' END AS fault FROM o),
g AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (illegal) AS illegal FROM f GROUP BY conv_id),
-- The cheapest (cost, audit) of the rows from p on, in each state: nothing yet, after s, after u, after a.
best AS (
  SELECT conv_id, n + 1 AS p, {'c': 0, 'a': ''} AS z, {'c': 6, 'a': 'II'} AS s, {'c': 3, 'a': 'I'} AS u, {'c': 0, 'a': ''} AS a FROM g
  UNION ALL
  SELECT conv_id, p,
    list_min([bz, {'c': bu.c + 3, 'a': 'I' || bu.a}, {'c': ba.c + 6, 'a': 'II' || ba.a}]), list_min([bs, {'c': bu.c + 3, 'a': 'I' || bu.a}, {'c': ba.c + 6, 'a': 'II' || ba.a}]),
    list_min([bu, {'c': ba.c + 3, 'a': 'I' || ba.a}]), list_min([ba, {'c': bu.c + 3, 'a': 'I' || bu.a}])
  FROM (
    SELECT b.conv_id, f.p,
      list_min([{'c': z.c + 4, 'a': 'D' || z.a}, {'c': u.c + 3 + more, 'a': 'R' || u.a}, {'c': u.c + more + CASE WHEN i = 'u' THEN 0 ELSE 999999 END, 'a': 'K' || u.a},
        {'c': s.c + more + CASE WHEN i = 's' THEN 0 ELSE 999999 END, 'a': 'K' || s.a}]) AS bz,
      list_min([{'c': s.c + 4, 'a': 'D' || s.a}, {'c': u.c + 3 + more, 'a': 'R' || u.a}, {'c': u.c + more + CASE WHEN i = 'u' THEN 0 ELSE 999999 END, 'a': 'K' || u.a}]) AS bs,
      list_min([{'c': u.c + 4, 'a': 'D' || u.a}, {'c': b.a.c + 3 + more, 'a': 'R' || b.a.a}, {'c': b.a.c + more + CASE WHEN i = 'a' THEN 0 ELSE 999999 END, 'a': 'K' || b.a.a}]) AS bu,
      list_min([{'c': b.a.c + 4, 'a': 'D' || b.a.a}, {'c': u.c + 3 + more, 'a': 'R' || u.a}, {'c': u.c + more + CASE WHEN i = 'u' THEN 0 ELSE 999999 END, 'a': 'K' || u.a}]) AS ba
    FROM best b JOIN (SELECT *, CASE fault WHEN '-' THEN 0 WHEN 't' THEN 3 ELSE 999999 END AS more FROM f) f ON b.conv_id IS NOT DISTINCT FROM f.conv_id AND f.p = b.p - 1)),
won AS (SELECT conv_id, z.c AS cost, z.a AS audit FROM best WHERE p = 1),
e AS (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS k FROM won),
m AS (SELECT conv_id, k, audit[k] AS letter, CAST(len(replace(audit[:k], 'I', '')) AS BIGINT) AS p, len(replace(audit[:k], 'D', '')) AS j FROM e),
w AS (SELECT m.*, f.role, f.text, f.i FROM m LEFT JOIN f ON m.letter <> 'I' AND m.conv_id IS NOT DISTINCT FROM f.conv_id AND m.p = f.p),
y AS (SELECT *, CAST(max(CASE WHEN letter = 'K' AND i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS BIGINT) AS head FROM w WHERE letter <> 'D'),
t AS (
  SELECT conv_id, count(*) AS repaired_rows, string_agg(CASE WHEN letter = 'K' THEN role WHEN (j - head) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
    CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS body FROM y GROUP BY conv_id)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_rows, 0) AS repaired_rows,
  sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN g ON d.conv_id IS NOT DISTINCT FROM g.conv_id
  LEFT JOIN won ON d.conv_id IS NOT DISTINCT FROM won.conv_id LEFT JOIN t ON d.conv_id IS NOT DISTINCT FROM t.conv_id""",
    "op13_fp_search": r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
item AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT item_id, term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM item JOIN df USING (term), s),
m AS (SELECT doc_id, 50 + (50 * n * docs) // total AS m FROM n, s),
score AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM w JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM score WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM r WHERE place <= 50""",
}
