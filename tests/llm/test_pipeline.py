"""The pipeline's stages against the operators' own decisions."""

from pyspark.sql import functions as F

import corpus_pipeline
from parlance.llm import mixing, ngram_join, secrets, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    first = corpus_pipeline.drop_toxic(spark, documents, SF)
    scores = toxicity.score_toxicity(documents, toxicity.fit(documents, labels)).where("predicted = 0")
    assert first.columns == documents.columns
    assert sorted(r["doc_id"] for r in first.collect()) == sorted(r["doc_id"] for r in scores.collect())

    second = corpus_pipeline.drop_near_duplicates(spark, documents, SF)
    found = ngram_join.components_by_ngrams(documents).collect()
    assert second.columns == documents.columns
    assert sorted(r["doc_id"] for r in second.collect()) == sorted(
        r["doc_id"] for r in found if r["doc_id"] == r["component_id"])

    third = corpus_pipeline.mask_secrets(spark, documents, SF)
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert third.columns == documents.columns
    for r in third.collect():
        assert r["text"] == secrets.redacted(texts[r["doc_id"]], "[SECRET]") and r["n_chars"] == len(r["text"])

    fourth = corpus_pipeline.mix_sources(spark, documents, SF)
    chosen = mixing.weigh(documents).where("selected")
    assert fourth.columns == documents.columns
    assert sorted(r["doc_id"] for r in fourth.collect()) == sorted(r["doc_id"] for r in chosen.collect())


def test_run_is_the_stages_in_order(spark, documents):
    docs = documents
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    got = corpus_pipeline.run(spark, SF)
    assert sorted(got.collect(), key=str) == sorted(docs.collect(), key=str)
    assert 0 < got.count() < documents.count()


def test_odd_and_empty_tables(spark, odd, empty):
    clash = {c: F.lit(7) for c in ("_sid", "_kept_sid", "_kept_id", "_many", "_toxicity", "_weight", "_probability",
                                   "_topic", "_cell_source", "row", "id", "score", "sid", "topic", "probability")}
    for frame in (odd, odd.withColumns(clash), empty):
        docs = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == frame.columns
            assert all(r[c] == 7 for r in docs.collect() for c in set(clash) & set(docs.columns))
        corpus_pipeline.encode(spark, docs, SF).count()
