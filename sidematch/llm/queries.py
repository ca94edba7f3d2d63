"""Queries that apply each operator to its whole table, and their SQL where it has one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import decontam, jaccard_join, langid, license, line_dedup, lm_score, packing, prefix_trie, quality, rans, token_align, urls, warc

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_lm_score")
def lm_scores(spark, sf_dir):
    return lm_score.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM items a JOIN items b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(u, v) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, c.component_id
FROM sets JOIN (SELECT u, min(v) AS component_id FROM reach GROUP BY u) c ON c.u = doc_id
"""


@query("op2_ngram_jaccard_join", JACCARD_SQL)
def ngram_jaccard_join(spark, sf_dir):
    return jaccard_join.join(table(spark, sf_dir, "documents"))


@query("op3_language_id")
def language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


@query("op4_token_files")
def token_files(spark, sf_dir):
    blocks = rans.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return rans.read(spark, blocks)


def files_of(docs):
    """Documents as files: a folder per source, and most of them in one of 50 below it."""
    inside = F.when(F.col("doc_id") % 50 == 0, "").otherwise(F.concat((F.col("doc_id") % 50).cast("string"), F.lit("/")))
    return docs.select(
        F.col("doc_id").alias("file_id"), F.concat("source", F.lit("/"), inside, "doc_id", F.lit(".txt")).alias("path"), "text")


@query("op5_license_scan")
def license_scan(spark, sf_dir):
    return license.scan(files_of(table(spark, sf_dir, "documents"))).withColumnRenamed("file_id", "doc_id")


QUALITY_SQL = r"""
WITH words AS (
  SELECT doc_id, text, source,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (
  SELECT doc_id, count(DISTINCT i + o) AS n
  FROM (SELECT doc_id, i, unnest([0, 1, 2, 3, 4]) AS o FROM twice) GROUP BY doc_id),
base AS (
  SELECT w.doc_id, w.source, len(w)::BIGINT AS n_words,
         coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
         coalesce(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')), 0)::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM words w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
hosts AS (
  SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS k FROM judged GROUP BY source),
total AS (
  SELECT sum(k) / sum(n) AS mean, count(*) AS h, sum(n) AS n, sum(n * n) AS n2,
         sum(k * k / n) - sum(k) * (sum(k) / sum(n)) AS spread FROM hosts),
prior AS (
  SELECT mean, CASE WHEN h > 1 AND mean > 0 AND mean < 1 AND n * n > n2
    THEN (spread - (h - 1) * mean * (1 - mean)) / (n - n2 / n) END AS between_hosts FROM total),
weights AS (
  SELECT mean, CASE WHEN between_hosts > 0
    THEN greatest(mean * (1 - mean) / between_hosts - 1, 0) ELSE 1e12 END AS weight FROM prior),
verdict AS (
  SELECT source, (k + weight * mean) / (n + weight) >= 0.5 AS failed FROM hosts, weights)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT failed AS kept
FROM judged j JOIN verdict v ON j.source IS NOT DISTINCT FROM v.source
"""


@query("op6_quality_rules", QUALITY_SQL)
def quality_rules(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", *quality.MEASURES, "base_failed", "kept")


URL_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
parts AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path,
         translate(rest, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM split),
rules(says, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(says, length(h || p)) AS says
  FROM parts JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
urls AS (SELECT parts.*, rule, says FROM parts LEFT JOIN fits USING (page_id)),
texts AS (
  SELECT text, count(*) FILTER (says = 'allow') AS a, count(*) FILTER (says = 'block') AS b FROM urls GROUP BY text),
win AS (
  SELECT text, a, b, substr(chr(2) || chr(2) || chr(2) || text || chr(3), i, 4) AS g
  FROM (SELECT *, unnest(range(1, length(text) + 2)) AS i FROM texts)),
l4 AS (SELECT g, sum(a) AS a, sum(b) AS b FROM win GROUP BY g),
l3 AS (SELECT substr(g, 2) AS g, sum(a) AS a, sum(b) AS b FROM l4 GROUP BY 1),
l2 AS (SELECT substr(g, 2) AS g, sum(a) AS a, sum(b) AS b FROM l3 GROUP BY 1),
l1 AS (SELECT substr(g, 2) AS g, sum(a) AS a, sum(b) AS b FROM l2 GROUP BY 1),
""" + "".join(f"""
c{k} AS (SELECT *, substr(g, 1, {k - 1}) AS c, sum(a) OVER w AS na, sum(b) OVER w AS nb,
         sum((a > 0)::INT) OVER w AS ta, sum((b > 0)::INT) OVER w AS tb
  FROM l{k} WINDOW w AS (PARTITION BY substr(g, 1, {k - 1}))),
p{k} AS (
  SELECT c{k}.g, CASE WHEN na > 0 THEN (a::DOUBLE + ta::DOUBLE * {pa}) / (na + ta)::DOUBLE ELSE {pa} END AS pa,
         CASE WHEN nb > 0 THEN (b::DOUBLE + tb::DOUBLE * {pb}) / (nb + tb)::DOUBLE ELSE {pb} END AS pb
  FROM c{k} {join}),""" for k, pa, pb, join in [
    (1, "(1.0::DOUBLE / 128)", "(1.0::DOUBLE / 128)", ""),
    *((k, "p.pa", "p.pb", f"JOIN p{k - 1} p ON p.g = substr(c{k}.g, 2)") for k in (2, 3, 4))]) + r"""
scores AS (
  SELECT text, a, b, round(sum(log2(pa / pb)) / count(*), 3) AS score FROM win JOIN p4 USING (g) GROUP BY text, a, b),
steps AS (
  SELECT score, sum(a) OVER (ORDER BY score) AS upto, sum(a) OVER () AS allowed, sum(b) OVER () AS blocked
  FROM (SELECT score, sum(a) AS a, sum(b) AS b FROM scores GROUP BY score)),
threshold AS (SELECT min(score) AS t FROM steps WHERE allowed > 0 AND blocked > 0 AND upto >= 0.01 * allowed)
SELECT page_id, host, path, rule,
       coalesce(says, CASE WHEN score < t THEN 'block' ELSE 'allow' END) AS verdict
FROM urls JOIN scores USING (text), threshold
"""


@query("op7_url_filter", URL_SQL)
def url_filter(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query("op8_benchmark_decontamination")
def benchmark_decontamination(spark, sf_dir):
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
heads AS (SELECT html, max(page_id) AS head FROM p GROUP BY html)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) % 32 + 1)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = head THEN NULL ELSE head END AS refers_to
FROM p JOIN heads USING (html)
"""


@query("op9_warc", WARC_SQL)
def warc_archives(spark, sf_dir):
    files = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(spark, files, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op10_packing")
def packed(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


LINE_SQL = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
lines AS (SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS line FROM split),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT doc_id, i, line, s.key IS NOT NULL AND doc_id IS DISTINCT FROM last AS lost FROM keyed LEFT JOIN shared s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query("op13_line_dedup", LINE_SQL)
def shared_lines_dropped(spark, sf_dir):
    return line_dedup.drop_shared_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op12_token_alignment")
def token_alignment(spark, sf_dir):
    return token_align.align(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"))


TRIE_SQL = r"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i,
         sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM turns),
steps AS (
  SELECT conv_id, list_prepend(4294967295, flatten(list_transform(range(1, length(s) + 1),
    lambda p: [ascii(s[p]), -1, -1, -1, -1, -1, -1, -1, -1]))) AS l FROM ids),
convs AS (
  SELECT conv_id, xor(list_reduce(l, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x)
    ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 4 AS h FROM steps),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, i, k, words FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 AND i < h
  UNION ALL SELECT c.conv_id, 1, i, k, words FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND i >= h),
rows AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(k, '') OVER w AS path, words
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, i ROWS UNBOUNDED PRECEDING)),
paths AS (SELECT * FROM rows UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
lengths AS (SELECT conv_id, max(depth) AS n FROM paths GROUP BY conv_id),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = n), '') AS ends
  FROM paths JOIN lengths USING (conv_id) GROUP BY path, depth),
tied AS (SELECT *, left(path, 64 * (depth - 1)::INT) AS up FROM nodes),
children AS (SELECT up AS path, depth - 1 AS depth, count(*) AS n FROM tied WHERE depth > 0 GROUP BY 1, 2),
below AS (
  SELECT left(path, 64 * d::INT) AS path, d AS depth, sum((n_convs - 1) * words)::BIGINT AS saved,
         count(*) FILTER (n IS NULL) AS leaves
  FROM (SELECT t.*, c.n, unnest(range(0, t.depth + 1)) AS d FROM tied t LEFT JOIN children c USING (path, depth)) GROUP BY 1, 2)
SELECT t.conv_id, t.depth, p.conv_id AS parent_conv_id, t.n_convs, coalesce(c.n, 0) AS n_children, b.leaves AS n_leaves,
       b.saved AS saved_tokens, sha256(t.ends) AS ends_sha256
FROM tied t LEFT JOIN nodes p ON p.path = t.up AND p.depth = t.depth - 1
LEFT JOIN children c ON c.path = t.path AND c.depth = t.depth JOIN below b ON b.path = t.path AND b.depth = t.depth
"""


@query("op11_prefix_trie", TRIE_SQL)
def prefix_nodes(spark, sf_dir):
    return prefix_trie.build(table(spark, sf_dir, "conversations"))
