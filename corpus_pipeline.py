"""From raw documents to packed training sequences, in stages that each work on all that the one before kept.

Null and empty texts score as the quality classifier has learnt to score texts without statistics; those that remain have no letter and go with the language
stage. Repeated rows are copies of each other for the near-duplicate stage. Texts of any length pass whole; an empty table stays empty. Columns other than those of
documents, whatever their names, are left behind by the first stage. A stage's own tables and those of the stage before are deleted once its result is written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corridor.llm import language_id, order_minhash, packing, pii, quality
from corridor.llm.common import drop_written, mark, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents of a lower quality score go; so do those whose language is ``und`` or less likely than this.
QUALITY, LANGUAGE = 0.3, 0.5


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model, *COLUMNS).where(F.col("score") >= QUALITY).select(*COLUMNS)


def in_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = language_id.identify(docs, language_id.train(docs), *COLUMNS)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LANGUAGE)).select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return order_minhash.deduplicated(docs).select(*COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality", good), ("language", in_language), ("near-duplicates", distinct), ("pii", private), ("packing", packed)]
#: The stages train models and segment texts; SQL expresses none of that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        drop_written(spark, since, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
