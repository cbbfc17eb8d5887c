"""The pipeline's stages against the operators they call, and the corpus queries against their SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corridor.llm import language_id, order_minhash, pii, quality
from corridor.llm import queries as corpus
from corridor.llm.common import table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(corpus.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(corpus.oracle_sql()[name])
    got = corpus.queries()[name](spark, DATA).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, DATA).cache()
        assert kept.columns == list(corpus_pipeline.COLUMNS)
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        if name == "quality":
            scores = quality.scored(before, quality.train(before, table(spark, DATA, "labels")), "doc_id")
            assert ids == {r.doc_id for r in scores.where("score >= 0.3").collect()}
        elif name == "language":
            found = language_id.languages(before)
            assert ids == {r.doc_id for r in found.where("lang_pred <> 'und' AND score >= 0.5").collect()}
        elif name == "near-duplicates":
            assert ids == {r.doc_id for r in order_minhash.near_duplicates(before).where("kept").collect()}
        else:
            assert ids == {r.doc_id for r in before.collect()}
            assert sum(r.n_email + r.n_ip + r.n_card for r in pii.personal_data(kept).collect()) == 0
    pieces = corpus_pipeline.run(spark, DATA)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == ids
    assert pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).where("n <> m").count() == 0


def test_empty_input(spark):
    docs = table(spark, DATA, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


def test_odd_rows_pass_through_all_stages(spark):
    good = [r.text for r in table(spark, DATA, "documents").where("lang = 'en'").orderBy("doc_id").limit(60).collect()]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(good)] + [(900, None, None, None, None), (901, "", "en", "s", 0), (902, "  \n", "en", None, 3), (None, good[5] + " and more to say", "en", "s", 1), (903, good[7] * 200, "en", "s", 1), (1, good[1], "en", "s", len(good[1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("clash") for c in ("score", "node", "key", "lang_pred", "_hash", "part", "x", "y")})
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, DATA).cache()
        assert after.count() <= before.count() or name == "packing"
        before = after
    assert {901, 902, 900}.isdisjoint({r.doc_id for r in before.collect()})
    assert before.where("doc_id = 1 AND start = 0").count() <= 1
