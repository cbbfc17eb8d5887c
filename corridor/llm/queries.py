"""The corpus operators as queries over the whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from corridor.llm import bpe_codec, html_extraction, language_id, lloyd_codes, order_minhash, packing, pii, quality, quantised_dedup, token_counts, topk_search, url_filter, whitening
from corridor.llm.common import table

#: (verdict, host and path).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quantised_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantised_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_lloyd_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd_codes.codes(table(spark, sf_dir, "embeddings"))


def op12_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.main_texts(table(spark, sf_dir, "pages")).drop("n_repeated", "n_corrected")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def lloyd_sql(rounds: int = 6) -> str:
    """The rounds one after the other, by plain scans of all entries."""
    parts = ["""WITH w AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, part, x[part * (len(x) // 8) + 1:(part + 1) * (len(x) // 8)] AS y FROM w, range(8) g(part)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS e, y AS c FROM p WHERE r <= 16)"""]
    for k in range(rounds + 1):
        parts.append(f"""a{k} AS MATERIALIZED (SELECT r, part, arg_min(e, d * 16 + e) AS e, min(d) AS d FROM (SELECT p.r, p.part, e, list_inner_product(y, y) - 2 * list_inner_product(y, c) + list_inner_product(c, c) AS d FROM p JOIN c{k} ON p.part = c{k}.part) GROUP BY r, part)""")
        if k < rounds:
            parts.append(f"""c{k + 1} AS MATERIALIZED (SELECT o.part, o.e, coalesce(m.c, o.c) AS c FROM c{k} o LEFT JOIN (SELECT part, e, list(f ORDER BY k) AS c FROM
  (SELECT part, e, k, floor(sum(v) / count(*)) AS f FROM (SELECT a.part, a.e, unnest(p.y) AS v, generate_subscripts(p.y, 1) AS k FROM a{k} a JOIN p ON p.r = a.r AND p.part = a.part) GROUP BY part, e, k) GROUP BY part, e) m ON m.part = o.part AND m.e = o.e)""")
    return ",\n".join(parts) + f""",
s AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r),
h AS (SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY part, e, k)) AS h FROM (SELECT part, e, unnest(c) AS v, generate_subscripts(c, 1) AS k FROM c{rounds}))
SELECT w.vec_id, s.code, s.error, (sum(s.error) OVER (PARTITION BY w.label))::BIGINT AS label_error, h.h AS codebooks_sha256 FROM w JOIN s ON s.r = w.r, h"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_topk, op2_token_counts, op3_url_filter, op4_language_id, op5_quality, op6_packing, op7_pii, op8_order_minhash, op9_quantised_dedup, op10_bpe, op11_lloyd_codes, op12_host_suffix_array, op13_whitening)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)
    own = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return own | {
        "op1_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
        "op3_url_filter": f"""
WITH rules(verdict, rule, host, path) AS (VALUES {rules}),
u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
m AS (SELECT u.page_id, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict FROM u JOIN rules r
  ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY u.page_id)
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)""",
        "op11_lloyd_codes": lloyd_sql(),
        # every page of the tables has one article; of character references these occur in articles, some without their semicolon
        "op12_host_suffix_array": r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS a FROM pages),
t AS (SELECT page_id, url, regexp_replace(regexp_replace(a, '</?(p|h1|br)>', ' ', 'g'), '</?b>', '', 'g') AS t FROM a),
d AS (SELECT page_id, url, replace(regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&amp;?', chr(1), 'g'), chr(1), '&') AS t FROM t),
o AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM d) SELECT page_id, url, text, length(text) AS n_chars FROM o""",
        "op9_quantised_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))) >= 0.98),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)""",
    }
