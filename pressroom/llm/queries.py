"""Queries over the driver tables, one per operator, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.llm import chat_format, decontaminate, exact_dedup, fill_middle, jaccard_join, learned_index, line_dedup, prefix_trie, quality, sentencepiece_codec, sharding, suffix_dedup, url_filter
from pressroom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


@query("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "text_score", "page_score", "score", "keep")


@query("op2_line_dedup")
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), report=True, max_edits=2, min_chars=30, equal_chars=1)
    return done.select("doc_id", "n_lines", F.size("removed_lines").alias("n_removed"), "removed_lines", F.sha2("text", 256).alias("kept_sha256"))


@query("op3_sentencepiece")
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.encode_documents(docs).select("doc_id", "n_ids", "ids", "round_trip")


_ESCAPED = r"replace(replace(replace({}, '\', '\\'), '### ', '\### '), '</turn>', '<\/turn>')"


@query("op4_chat_format", sql=f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
n AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    4 + length(replace({_ESCAPED.format('role')}, ':', '<\\c>')) + 2 + length({_ESCAPED.format('text')}) + 8 AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS so_far FROM n)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(so_far) FILTER (WHERE role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars,
  count(*) FILTER (WHERE role = 'assistant' OR i = n) AS n_examples
FROM s GROUP BY conv_id""")
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"))
    return chat_format.conversation_digests(chat_format.expand_examples(turns.unionByName(probe)))


@query("op5_exact_dedup", sql=f"""
WITH d AS (SELECT doc_id, {LOWER.format("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256, strlen(t) AS n_bytes
FROM d WINDOW w AS (PARTITION BY t)""")
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


@query("op6_decontaminate", sql=f"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all({LOWER.format("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 'i', item_id, regexp_extract_all({LOWER.format("text")}, '[^\x20\x09-\x0D]+') FROM benchmark WHERE text IS NOT NULL),
s AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w WHERE len(w) > 0),
n AS (SELECT id, count(*) AS n FROM s WHERE kind = 'i' GROUP BY id),
m AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared FROM s d JOIN s i ON d.g = i.g AND d.kind = 'd' AND i.kind = 'i' GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n AS n_item_shingles, n_shared / n AS containment FROM m JOIN n ON n.id = m.item_id
WHERE 100 * n_shared >= 75 * n""")
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_jaccard_join")
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_components(table(spark, sf_dir, "documents"), percent=75).select("doc_id", "n_shingles", "component_id")


# The rules of the query (host, path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query("op8_url_filter", sql=f"""
WITH r(rule_host, rule_path, rule_verdict) AS (VALUES {', '.join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM u),
p AS (SELECT page_id, {LOWER.format('h')} AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM h),
m AS (SELECT p.page_id, rule_host || rule_path AS rule, rule_verdict,
  row_number() OVER (PARTITION BY p.page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS i
  FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT p.page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON m.page_id = p.page_id AND i = 1""")
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge(pages, url_filter.build(rules), default="allow")
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op9_feistel_sharding")
def op9_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=24, seed=9)


@query("op10_suffix_dedup")
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_learned_index")
def op11_learned_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned_index.nearest(table(spark, sf_dir, "embeddings"), k=10, every=100)


@query("op13_fill_middle", sql="""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || CAST(doc_id AS VARCHAR)) AS d FROM documents),
h AS (SELECT *, length(text) AS n, CAST('0x' || d[1:8] AS UBIGINT) AS h1, CAST('0x' || d[9:16] AS UBIGINT) AS h2,
  CAST('0x' || d[17:24] AS UBIGINT) AS h3, CAST('0x' || d[25:32] AS UBIGINT) AS h4 FROM t),
c AS (SELECT *, CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
       WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                   ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""")
def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"), seed=1, plain_from=90, spm_below=20)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fill_middle.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}) + 1), lambda i: CAST(ascii(substr({0}, CAST(i AS INTEGER), 1)) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT)"""


@query("op12_prefix_trie", sql=f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base FROM t),
h AS (SELECT conv_id, base, {_CRC32.format('CAST(conv_id AS VARCHAR)')} % 9 AS h FROM c),
r AS (
  SELECT h.conv_id, 0 AS part, t.i, role, text FROM h JOIN t ON t.conv_id = h.base AND t.i < h
  UNION ALL SELECT h.conv_id, 1, t.i, role, text FROM h JOIN t ON t.conv_id = h.conv_id AND t.i >= h),
s AS (SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS n_bytes,
    sha256(string_agg(sha256(role) || sha256(text), '') OVER w) AS k
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, i)),
m AS (SELECT conv_id, depth, k, n_bytes, lag(k, 1, '') OVER (PARTITION BY conv_id ORDER BY depth) AS up FROM s
  UNION ALL SELECT conv_id, 0, '', 0, NULL FROM c),
n AS (SELECT k, any_value(up) AS up, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n_bytes) AS saved FROM m GROUP BY k),
kids AS (SELECT up AS k, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY 1),
below AS (SELECT DISTINCT a.k, b.k AS d FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
sums AS (SELECT below.k, sum(n.saved) AS saved_tokens, count(*) FILTER (WHERE kids.k IS NULL) AS n_leaves
  FROM below JOIN n ON n.k = below.d LEFT JOIN kids ON kids.k = below.d GROUP BY 1),
tip AS (SELECT conv_id, arg_max(k, depth) AS k FROM m GROUP BY 1),
ends AS (SELECT k, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256 FROM tip GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM n JOIN sums ON sums.k = n.k LEFT JOIN n p ON p.k = n.up LEFT JOIN kids ON kids.k = n.k LEFT JOIN ends ON ends.k = n.k""")
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
