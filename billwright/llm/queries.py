"""The named queries of the operators and the SQL that some are checked by."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billwright.llm import bpe, decontaminate, exact_dedup, language, license_scan, license_texts, line_dedup, ngram_join, passages, periodic, prefix_trie, token_counts, toxicity, warc
from billwright.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), TOKENIZER, limit=1024)


@query
def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.held_out("doc_id", 4, 2)
    model = language.train(docs.where(~out))
    return language.predict(docs, model).withColumn("held_out", out)


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.held_out("doc_id", 5, 0)
    crf = toxicity.train(docs, table(spark, sf_dir, "labels").where(~out))
    return (
        toxicity.score(docs, crf)
        .withColumn("held_out", out)
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )


@query
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_duplicates(table(spark, sf_dir, "documents")).drop("row_key")


ORACLES["op7_exact_dedup"] = """
WITH folded AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY s) AS keep_id,
       count(*) OVER (PARTITION BY s) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY s) AS kept,
       sha256(s) AS text_sha256
FROM folded
"""


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLES["op4_decontamination"] = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_window AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + 9], ' ') AS s
  FROM item, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS r(i) WHERE len(w) > 0
), size AS (SELECT DISTINCT size FROM item_window),
doc_window AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS s
  FROM doc, size, unnest(range(1, len(w) - size + 2)) AS r(i)
), hit AS (
  SELECT DISTINCT d.doc_id, d.i, d.size, m.item_id FROM doc_window d JOIN item_window m USING (size, s)
), place AS (
  SELECT DISTINCT doc_id, p FROM hit, unnest(range(i, i + size)) AS r(p)
), hit_count AS (SELECT doc_id, count(*) AS n FROM place GROUP BY doc_id),
hit_item AS (
  SELECT doc_id, count(*) AS n, string_agg(k, ',' ORDER BY k) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id
)
SELECT doc.doc_id, len(w) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit_count c USING (doc_id) LEFT JOIN hit_item t USING (doc_id)
"""


@query
def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.cluster(table(spark, sf_dir, "documents"), size=4, part=85).drop("stays", "row_key")


ORACLES["op5_ngram_join"] = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s
  FROM doc, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS r(i) WHERE len(w) > 0
), size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT x, y FROM shared JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM doc UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y
)
SELECT doc.doc_id, coalesce(size.n, 0) AS n_shingles, g.component_id
FROM doc LEFT JOIN size USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) g ON g.x = doc.doc_id
"""


@query
def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_repeats(table(spark, sf_dir, "documents"), length=400)


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"), license_texts.TEMPLATES)
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"))


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "pages"), ratio=0.3)


ORACLES["op9_line_dedup"] = r"""
WITH lined AS (
  SELECT page_id,
    lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)) AS host,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      '<!--.*?(-->|\z)|<(script|style|template|noscript)[^>]*(\z|>.*?(</(script|style|template|noscript)>|\z))', '', 'gsi'),
      '</?(address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)([ /][^>]*)?(>|\z)', chr(10), 'gi'),
      '<[^>]*(>|\z)', '', 'g'), chr(10)), lambda x: regexp_replace(x, '^[ \t\r]+|[ \t\r]+$', '', 'g')), lambda x: x <> '') AS lines
  FROM pages
), host AS (SELECT host, count(*) AS pages FROM lined GROUP BY host),
boilerplate AS (
  SELECT host, line FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM lined) JOIN host USING (host)
  GROUP BY host, line, pages HAVING count(*) > pages * 0.3 AND count(*) > 1
), drop_list AS (SELECT host, list(line) AS bad FROM boilerplate GROUP BY host)
SELECT page_id, host, len(lines) AS n_lines, len(list_filter(lines, lambda x: list_contains(coalesce(bad, []), x))) AS n_dropped,
       array_to_string(list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []), x)), chr(10)) AS text
FROM lined LEFT JOIN drop_list USING (host)
"""


@query
def op11_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"), warc.archive_folder(spark), least=100)


ORACLES["op11_warc_archive"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM f
"""


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"), group=5, heads=9)


ORACLES["op12_prefix_trie"] = """
WITH turn_row AS (
  SELECT conv_id AS c, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS t,
         strlen(coalesce(text, '')) AS b,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), conv AS (
  SELECT c, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(CAST(c AS VARCHAR)) + 1),
              lambda i: [CAST(ascii(CAST(c AS VARCHAR)[i]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
            lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT c FROM turn_row)
), piece AS (
  SELECT conv.c, 0 AS part, p, t, b FROM conv JOIN turn_row r ON r.c = conv.c - conv.c % 5 AND r.p <= h
  UNION ALL SELECT conv.c, 1, p, t, b FROM conv JOIN turn_row r ON r.c = conv.c AND r.p > h
), built AS (
  SELECT conv.c, list({'t': t, 'b': b} ORDER BY part, p) FILTER (WHERE t IS NOT NULL) AS s FROM conv LEFT JOIN piece USING (c) GROUP BY conv.c
), prefix AS (
  SELECT c, d, coalesce(len(s), 0) = d AS ends, coalesce(list_transform(s[1 : d], lambda x: x.t), CAST([] AS VARCHAR[])) AS k, CASE WHEN d > 0 THEN s[d].b ELSE 0 END AS b
  FROM built, unnest(range(0, coalesce(len(s), 0) + 1)) AS r(d)
), node AS (
  SELECT d, k, min(c) AS c, count(*) AS n, any_value(b) AS b, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '') AS e
  FROM prefix GROUP BY d, k
), child AS (SELECT d - 1 AS d, k[1 : d - 1] AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
under AS (
  SELECT u AS d, node.k[1 : u] AS k, sum((node.n - 1) * node.b) AS saved, count(*) FILTER (WHERE child.n IS NULL) AS leaves
  FROM node LEFT JOIN child ON child.d = node.d AND child.k = node.k, unnest(range(0, node.d + 1)) AS r(u) GROUP BY ALL
)
SELECT node.c AS conv_id, node.d AS depth, up.c AS parent_conv_id, node.n AS n_convs, coalesce(child.n, 0) AS n_children,
       under.leaves AS n_leaves, CAST(under.saved AS BIGINT) AS saved_tokens, sha256(node.e) AS ends_sha256
FROM node JOIN under ON under.d = node.d AND under.k = node.k
LEFT JOIN child ON child.d = node.d AND child.k = node.k LEFT JOIN node up ON up.d = node.d - 1 AND up.k = node.k[1 : node.d - 1]
"""


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("checksum", F.crc32(F.col("doc_id").cast("string")))
    return periodic.collapse_runs(docs, exponent=4, least=6, loop="checksum", texts=False)
