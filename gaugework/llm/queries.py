"""Registered queries of the corpus operators, with check SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugework.llm import (
    decontaminate, hard_negatives, html_extract, language_id, licenses, line_dedup, mixing, neighbours, pii, prefix_trie, quality,
    simhash, substring_dedup,
)

QUERIES: dict = {}
CHECK_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            CHECK_SQL[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op9_benchmark_decontamination", r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
items AS (
  SELECT item_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lengths WHERE len(w) >= n)),
found AS (SELECT doc_id, i, g.n, item_id FROM grams g JOIN windows v ON g.gram = v.gram AND g.n = v.n),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, coalesce(CAST(item_id AS VARCHAR), '') AS id FROM found) GROUP BY doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit ON words.doc_id = hit.doc_id LEFT JOIN ids ON words.doc_id = ids.doc_id
""")
def op9_benchmark_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.hit_report(decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")))


@register("op10_language_id")
def op10_language_id(spark, sf_dir):
    return language_id.language_report(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@register("op2_line_dedup", r"""
WITH lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
line AS (
  SELECT doc_id, len(l) AS n, i, l[i] AS body,
    CAST(concat('0x', substr(md5(l[i]), 1, 12)) AS BIGINT) % 2147483647 AS h
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM lines)),
rolled AS (
  SELECT *, (h * 65599 + coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0)) % 2147483647 AS r FROM line),
marked AS (
  SELECT *, CASE WHEN i = 1 OR (r < lag(r) OVER w AND r < lead(r) OVER w) THEN 1 ELSE 0 END AS s
  FROM rolled WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
placed AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM marked),
chunks AS (
  SELECT doc_id, c, min(i) AS first, count(*) AS lines_in, string_agg(body, chr(10) ORDER BY i) AS body
  FROM placed GROUP BY doc_id, c),
again AS (
  SELECT doc_id, c, lines_in FROM (
    SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, first) AS place FROM chunks
    WHERE lines_in >= 2 AND regexp_matches(body, '\S')) WHERE place > 1),
kept AS (
  SELECT p.doc_id, string_agg(p.body, chr(10) ORDER BY i) AS body
  FROM placed p LEFT JOIN again a ON p.doc_id = a.doc_id AND p.c = a.c WHERE a.c IS NULL GROUP BY p.doc_id),
gone AS (SELECT doc_id, sum(lines_in) AS n, count(*) AS chunks FROM again GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed_lines,
  CAST(coalesce(g.chunks, 0) AS BIGINT) AS n_removed_chunks, coalesce(g.n, 0) = len(l) AS emptied,
  CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(k.body, '')) END AS kept_sha256
FROM lines d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN gone g ON d.doc_id = g.doc_id
""")
def op2_line_dedup(spark, sf_dir):
    return line_dedup.removal_report(table(spark, sf_dir, "documents"))


@register("op3_source_mix")
def op3_source_mix(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


@register("op6_simhash_near_duplicates")
def op6_simhash_near_duplicates(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@register("op1_pii")
def op1_pii(spark, sf_dir):
    return pii.pii_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("op7_quality_rules")
def op7_quality_rules(spark, sf_dir):
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op4_license_scan", licenses.check_sql())
def op4_license_scan(spark, sf_dir):
    return licenses.license_report(table(spark, sf_dir, "documents"))


@register("op8_html_extraction")
def op8_html_extraction(spark, sf_dir):
    return html_extract.extracted(table(spark, sf_dir, "pages"))


@register("op5_substring_dedup", r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35)),
again AS (SELECT t FROM windows GROUP BY t HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM windows JOIN again ON windows.t = again.t),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (
  SELECT w.doc_id, string_agg(x, ' ' ORDER BY i) AS body FROM (
    SELECT doc_id, w[i] AS x, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words)) w
  LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.p WHERE g.p IS NULL GROUP BY w.doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(body, '')) AS kept_sha256
FROM words LEFT JOIN lists ON words.doc_id = lists.doc_id LEFT JOIN kept ON words.doc_id = kept.doc_id
""")
def op5_substring_dedup(spark, sf_dir):
    return substring_dedup.removal_report(table(spark, sf_dir, "documents"))


@register("op11_hard_negatives", r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM s WHERE same)
  WHERE place <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
    AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
""")
def op11_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(256 * x).cast("double"))
    rows = rows.select("vec_id", label.alias("label"), whole.alias("embedding"))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


@register("op13_nearest_neighbours")
def op13_nearest_neighbours(spark, sf_dir):
    return neighbours.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@register("op12_conversation_trie", r"""
WITH t AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, h) AS pos, count(*) OVER (PARTITION BY c) AS n FROM (
    SELECT conv_id AS c, turn, coalesce(text, '') AS text,
      sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS h
    FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (
  SELECT c, c - c % 20 AS b, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(c AS VARCHAR)[i]) AS BIGINT))),
    lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)),
      lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END))) % 4 AS f
  FROM (SELECT DISTINCT c FROM t)),
built AS (
  SELECT v.c, t.pos AS d, t.h, t.text FROM convs v JOIN t ON t.c = v.b AND t.pos <= v.f
  UNION ALL
  SELECT v.c, least(f, coalesce(s.n, 0)) + t.pos - f AS d, t.h, t.text
  FROM convs v JOIN t ON t.c = v.c AND t.pos > v.f LEFT JOIN (SELECT DISTINCT c, n FROM t) s ON s.c = v.b),
keys AS (
  SELECT c, 0 AS d, '' AS k, NULL AS above, 0 AS w FROM convs
  UNION ALL
  SELECT c, d, k, coalesce(lag(k) OVER (PARTITION BY c ORDER BY d), '') AS above, w FROM (
    SELECT c, d, string_agg(h, ',') OVER (PARTITION BY c ORDER BY d) AS k,
      len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM built)),
nodes AS (
  SELECT k, min(c) AS c, min(d) AS d, count(*) AS n, min(w) AS w, min(above) AS above FROM keys GROUP BY k),
children AS (SELECT above, count(*) AS n FROM nodes WHERE d > 0 GROUP BY above),
sums AS (
  SELECT l.k, sum(CASE WHEN ch.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((x.n - 1) * x.w) AS saved
  FROM nodes x LEFT JOIN children ch ON ch.above = x.k JOIN keys l ON l.c = x.c AND l.d <= x.d GROUP BY l.k),
ends AS (
  SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS sha
  FROM (SELECT *, max(d) OVER (PARTITION BY c) AS last FROM keys) WHERE d = last GROUP BY k)
SELECT x.c AS conv_id, CAST(x.d AS BIGINT) AS depth, p.c AS parent_conv_id, x.n AS n_convs, coalesce(ch.n, 0) AS n_children,
  CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM nodes x JOIN sums s ON s.k = x.k LEFT JOIN nodes p ON p.k = x.above LEFT JOIN children ch ON ch.above = x.k
LEFT JOIN ends e ON e.k = x.k
""")
def op12_conversation_trie(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    c = F.col("conv_id")
    forks = turns.where(c.isNotNull()).select(c.alias("c")).distinct().select(
        "c", (F.col("c") - F.col("c") % 20).alias("source"), (F.crc32(F.col("c").cast("string")) % 4).alias("h"))
    return prefix_trie.conversation_trie(turns, forks).drop("digest", "parent_digest")
