"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from varloom.llm import (
    chunk_dedup,
    exact_topk,
    language_id,
    merkle_log,
    minhash,
    mixing,
    page_text,
    piece_table,
    quality_rules,
    suffix_dedup,
    token_spans,
    toxicity,
    url_trie,
)
from varloom.llm.common import crc_mod

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUALITY_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], chr(32)) AS win
  FROM (SELECT doc_id, words, unnest(range(1, CAST(len(words) - 6 AS BIGINT))) AS i FROM w WHERE len(words) >= 8)),
again AS (
  SELECT doc_id, unnest(range(i, i + 8)) AS place
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM again GROUP BY doc_id),
m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(body, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(length(regexp_replace(body, '[^A-Z]+', '', 'g')) AS BIGINT) AS n_capitals
  FROM w LEFT JOIN rep USING (doc_id)),
b AS (
  SELECT *, CAST(
      CASE WHEN n_words < 20 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN 2 * word_chars < 5 * n_words OR word_chars > 14 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 100 * n_capitals > 40 * word_chars THEN 32 ELSE 0 END AS BIGINT) AS failure_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, failure_bits,
       (failure_bits & 3) <> 0 AS base_failed, failure_bits = 0 AS kept, 'standard' AS policy
FROM b
"""


@query("op6_quality_rules", QUALITY_SQL)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    entries = quality_rules.apply_policy(quality_rules.ledger(docs))
    return entries.select(
        "doc_id", *quality_rules.MEASURES, "failure_bits", "base_failed", "kept", "policy"
    )


NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 2
         THEN [words[i] || chr(32) || words[i + 1] FOR i IN range(1, CAST(len(words) AS BIGINT))]
         ELSE words END) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""


@query("op10_minhash_near_dedup", NEAR_SQL)
def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


@query("op7_chunk_dedup")
def op7_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunk_dedup.remove_repeats(docs)


MIXING_SQL = r"""
WITH RECURSIVE size AS (
  SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS n FROM documents GROUP BY source),
share AS (SELECT source, n, pow(n, 0.7) AS s FROM size WHERE n > 0),
tot AS (SELECT sum(s) AS ss, sum(n) AS nn FROM share),
r AS (SELECT source, round(s / ss * nn / n, 9) AS rate FROM share, tot),
d AS (
  SELECT doc_id, documents.source, coalesce(rate, 0.0) AS rate,
         CAST(greatest(ceil(coalesce(rate, 0.0) / 16.0), 1) AS INT) AS parts
  FROM documents LEFT JOIN r ON documents.source IS NOT DISTINCT FROM r.source),
p AS (
  SELECT doc_id, part, rate / parts AS lam,
         (CAST(CAST('0x' || substr(md5('17:' || doc_id || ':' || part), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM (SELECT *, unnest(range(parts)) AS part FROM d)),
step AS (
  SELECT doc_id, part, lam, u, exp(-lam) AS prob, exp(-lam) AS below, 0 AS n FROM p
  UNION ALL
  SELECT doc_id, part, lam, u, prob * lam / (n + 1), below + prob * lam / (n + 1), n + 1
  FROM step WHERE below < u AND n < 80),
c AS (SELECT doc_id, sum(n) AS n FROM (SELECT doc_id, part, max(n) AS n FROM step GROUP BY doc_id, part) GROUP BY doc_id),
e AS (
  SELECT doc_id, source, rate, CAST(n AS INT) AS n_copies, CAST(unnest(range(1, CAST(n AS BIGINT) + 1)) AS INT) AS copy_no
  FROM d JOIN c USING (doc_id))
SELECT doc_id, source, rate, n_copies, copy_no,
       (CAST(CAST('0x' || substr(md5('18:' || doc_id || ':' || copy_no), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS shuffle_key,
       md5(coalesce(text, '')) AS text_md5
FROM e JOIN (SELECT doc_id, text FROM documents) USING (doc_id)
"""


@query("op3_source_mixing", MIXING_SQL)
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as often as its source's rate asks for, in a global random order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.replicate(docs).select(
        "doc_id",
        "source",
        "rate",
        "n_copies",
        "copy_no",
        "shuffle_key",
        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"),
    )


@query("op4_piece_table")
def op4_piece_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_table.encode(docs, ("n_tokens", "ids_sha256", "decoded_sha256"))


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_page_text")
def op8_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract_text(table(spark, sf_dir, "pages"))


TOPK_SQL = """
WITH e AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score
  FROM e q JOIN e d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op1_exact_topk", TOPK_SQL)
def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op2_suffix_dedup")
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query("op11_token_spans")
def op11_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_spans.align_scored(docs)


#: Fixed by the contract: host, path and verdict.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

URL_SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules AS (
  SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                        ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) AS r(rule_host, rule_path, rule_verdict)),
fits AS (
  SELECT page_id, rule_host || rule_path AS rule, rule_verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS place
  FROM u JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT u.page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
FROM u LEFT JOIN fits ON fits.page_id = u.page_id AND place = 1
"""


@query("op12_url_trie", URL_SQL)
def op12_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_trie.filter_urls(pages, URL_RULES).select("page_id", *url_trie.OUTPUTS)


MERKLE_SQL = r"""
WITH RECURSIVE crc_step AS (
  SELECT i, i AS v, 0 AS k FROM range(256) AS t(i)
  UNION ALL
  SELECT i, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM crc_step WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS steps FROM crc_step WHERE k = 8),
d AS (
  SELECT *, list_reduce(
             list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
             lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])) AS flipped
  FROM documents, crc),
f AS (
  SELECT doc_id, source,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
         text, coalesce(xor(flipped, 4294967295) % 5 = 0, false) AS hit
  FROM d),
g AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(text) || ':' || CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS changed
  FROM f),
leaves AS (
  SELECT dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, *
  FROM g),
node AS (
  SELECT tree, 0 AS level, idx, leaf AS digest FROM leaves
  UNION ALL
  SELECT tree, level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM node) WHERE n > 1
  GROUP BY tree, level, idx // 16),
sub AS (SELECT tree, max(level) AS levels, arg_max(digest, level) AS subroot FROM node GROUP BY tree),
top AS (
  SELECT 0 AS level, tree - 1 AS idx, subroot AS digest FROM sub
  UNION ALL
  SELECT level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER () AS n FROM top) WHERE n > 1
  GROUP BY level, idx // 16),
peak AS (SELECT max(level) AS levels, arg_max(digest, level) AS root FROM top),
side AS (
  SELECT tree, level, idx,
         coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM node JOIN sub USING (tree) WHERE level < levels
  WINDOW w AS (PARTITION BY tree, level, idx // 16 ORDER BY idx)),
top_side AS (
  SELECT level, idx,
         coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM top, peak WHERE level < levels
  WINDOW w AS (PARTITION BY level, idx // 16 ORDER BY idx)),
inner_steps AS (
  SELECT x.tree, x.idx, list(l || '|' || r ORDER BY level) AS steps
  FROM leaves x JOIN side s ON s.tree = x.tree AND s.idx = x.idx // CAST(pow(16, s.level) AS BIGINT)
  GROUP BY x.tree, x.idx),
outer_steps AS (
  SELECT t.tree, list(l || '|' || r ORDER BY level) AS steps
  FROM sub t JOIN top_side s ON s.idx = (t.tree - 1) // CAST(pow(16, s.level) AS BIGINT)
  GROUP BY t.tree),
p AS (
  SELECT x.*, subroot, root, list_concat(coalesce(i.steps, []), coalesce(o.steps, [])) AS steps
  FROM leaves x JOIN sub USING (tree) CROSS JOIN peak
  LEFT JOIN inner_steps i ON i.tree = x.tree AND i.idx = x.idx
  LEFT JOIN outer_steps o ON o.tree = x.tree),
q AS (
  SELECT *, list_reduce(list_concat([changed], steps),
              lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2))) AS folded_root
  FROM p)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '|', '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM q
"""


@query("op13_merkle_log", MERKLE_SQL)
def op13_merkle_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    changed = F.when(tampered, F.translate("text", url_trie.UPPER, url_trie.LOWER)).otherwise(F.col("text"))
    return merkle_log.verify(docs, changes={"text": changed})
