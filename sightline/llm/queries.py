"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, htmltext, mixing, quality, secrets, simhash, sketch, toxicity, urls, vafile
from .frames import held_out, table

#: Rank file and pattern of the byte-level BPE.
RANKS = "byte_bpe_multi_50k.tiktoken"

# The url rules, host and path prefix.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "block"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents. Null and empty texts: fingerprint zero;
    repeated rows each return; an empty table gives no rows."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents. A null text is scored as an empty one; a null
    doc_id is never held out; without usable labels every score is 0.5; an empty table
    gives no rows."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all urls. A null url has empty host and path and the default verdict;
    an empty table gives no rows."""
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES) + " AS r(rule_host, rule_path, verdict)")
    return urls.judge(table(spark, sf_dir, "pages"), rules)


def op4_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts. Null text: empty; one row
    alone follows itself; an empty table gives no rows."""
    return sketch.edit_check(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents. Null and empty texts have none; repeated rows each
    return; an empty table gives no rows."""
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages. Null, empty and broken pages: what text there is, or an
    empty one; repeated rows each return; an empty table gives no rows."""
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of all documents. Null text: size 0 and nothing taken; a
    null source is one of its own, last; rows alike are interchangeable; an empty table
    gives no rows."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all vectors for those asked. Null vectors, null ids and vectors with
    null or non-finite components take no part; no candidates: no rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return vafile.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents. A null text is scored as an empty one; a null
    doc_id is never held out; without usable labels every score is 0.5; an empty table
    gives no rows."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents and what they decode to. Null and empty texts have none;
    repeated rows each return; an empty table gives no rows."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of operator 4: sizes and digests of the edited texts."""
    return op4_sketch(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of operator 5: the base spans, counted and as a digest."""
    return op5_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of operator 7: sizes and targets."""
    return op7_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


QUERIES = {f.__name__: f for f in (edited_texts, secret_base, mix_targets, op1_simhash, op2_quality, op3_urls, op4_sketch, op5_secrets, op6_main_text, op7_mixing, op8_top_k, op9_toxicity, op10_bpe)}

_OP3 = f"""
WITH parts AS (
  SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages
), named AS (
  SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), rules(rule_host, rule_path, verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}
), fit AS (
  SELECT n, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY n ORDER BY length(rule_host) + length(rule_path) DESC, length(rule_host) DESC) AS turn
  FROM named JOIN rules ON (host = rule_host OR suffix(host, '.' || rule_host)) AND prefix(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM named LEFT JOIN fit ON named.n = fit.n AND turn = 1
"""

_OP8 = """
WITH sound AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(1024.0::DOUBLE * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id AS vec_id, CASE WHEN len(q.v) = 0 THEN 0 ELSE CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) END AS score
  FROM sound q JOIN sound c ON q.n <> c.n AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

_EDITED = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents
), n AS (SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS following FROM t)
SELECT doc_id, n AS n_chars, sha256(left(text, n - n // 4) || left(following, n // 4)) AS edited_sha256 FROM n
"""

_EITHER = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else "_?" for c in w) for w in ("password", "passwd", "secret", "token", "api_key"))


def _spans(kind: str, turn: int, pattern: str, group: int, least: int) -> str:
    """SQL: the matches of a pattern with where they start, from the gaps between."""
    pattern = pattern.replace("'", "''")
    return f"""SELECT doc_id, {turn} AS turn, '{kind}' AS kind, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS low, length(found[i]) AS size
FROM (SELECT doc_id, gaps, found, parts, unnest(range(1, len(found) + 1)) AS i FROM (
  SELECT doc_id, regexp_split_to_array(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS found, regexp_extract_all(text, '{pattern}', {group}) AS parts FROM t)) WHERE length(parts[i]) >= {least}"""


_SECRETS = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS (
{_spans("assign", 0, rf"(?:{_EITHER})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6)}
UNION ALL {_spans("access", 1, "AKIA[A-Z0-9]+", 0, 20)} UNION ALL {_spans("hex", 2, "[0-9a-f]+", 0, 24)}
), d AS (SELECT doc_id, count(*) FILTER (turn = 0) AS a, count(*) FILTER (turn = 1) AS b, count(*) FILTER (turn = 2) AS c, string_agg(kind || ':' || low || ':' || (low + size), ',' ORDER BY low, turn) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM t LEFT JOIN d USING (doc_id)
"""

_TARGETS = r"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (SELECT *, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM totals
), level AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x FROM weighed WINDOW o AS (ORDER BY cap / w, source NULLS LAST)
), aims AS (SELECT source, source_size, least(cap, w * (SELECT max(x) FROM level WHERE x * w <= cap)) AS target FROM level)
SELECT doc_id, size, source_size, round(target, 4) AS target FROM sized JOIN aims ON sized.source IS NOT DISTINCT FROM aims.source
"""

ORACLE_SQL = {"op3_urls": _OP3, "op8_top_k": _OP8, "edited_texts": _EDITED, "secret_base": _SECRETS, "mix_targets": _TARGETS}
