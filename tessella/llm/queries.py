"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.sharding import shard_by_bytes

    out = shard_by_bytes(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.simhash import simhash_components

    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.pii import KINDS, digest, find_pii

    return digest(find_pii(table(spark, sf_dir, "documents")), KINDS)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.pii import digest
    from tessella.llm.secrets import KINDS, find_secrets

    return digest(find_secrets(table(spark, sf_dir, "documents")), KINDS).drop("n_format")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.neighbours import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.mixing import interleave

    return interleave(table(spark, sf_dir, "documents"))


#: The rules of the registered query.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.urls import judge, rules_frame

    return judge(table(spark, sf_dir, "pages"), rules_frame(spark, URL_RULES))


OP9_SQL = """
WITH rules(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
       ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT row_number() OVER () AS nth, page_id,
       translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
       regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (SELECT p.nth, r.host || r.path AS rule, r.verdict,
       row_number() OVER (PARTITION BY p.nth ORDER BY length(r.host || r.path) DESC) AS k
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.nth = f.nth AND f.k = 1
"""


OP8_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
g AS (SELECT vec_id, e, label, sqrt(list_inner_product(e, e)) AS norm FROM v
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach AS (SELECT vec_id AS u, vec_id AS v FROM v UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
n AS (SELECT u, count(*) AS n FROM links GROUP BY 1), c AS (SELECT u, min(v) AS c FROM reach GROUP BY 1)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, v.vec_id = c.c AS kept FROM v LEFT JOIN n ON n.u = v.vec_id JOIN c ON c.u = v.vec_id
"""


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.language import identify, not_held_out, train

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs, not_held_out()))
    return found.select("doc_id", (~not_held_out()).alias("held_out"), "lang_pred", "score")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessella.llm.bpe import encode

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out = encode(table(spark, sf_dir, "documents"), path, pattern, decoded=True)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_pii": op2_pii,
    "op4_secrets": op4_secrets,
    "op3_neighbours": op3_neighbours,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op5_mixing": op5_mixing,
    "op9_url_filter": op9_url_filter,
    "op6_language": op6_language,
    "op7_byte_bpe": op7_byte_bpe,
    "op10_simhash": op10_simhash,
}

ORACLE_SQL: dict[str, str] = {"op8_embedding_dedup": OP8_SQL, "op9_url_filter": OP9_SQL}
