import hashlib
import re

import corpus_pipeline
from tests.llm import fixture
from tests.llm.test_ngram_join import brute as groups_of
from tidings.llm import bpe, quality_rules


def test_stages_follow_one_another(spark, tmp_path):
    sf = fixture.table(spark, tmp_path)
    rows = {r[0]: r for r in fixture.rows()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, sf)
    verdict = {r["doc_id"]: r["kept"] for r in quality_rules.query(spark, sf).collect()}
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {k for k, v in verdict.items() if v} and ids
    alone = corpus_pipeline.near_copies(spark, kept, sf)
    label = groups_of([rows[k] for k in ids])
    assert alone.columns == docs.columns and {r["doc_id"] for r in alone.collect()} == {k for k, (_, c) in label.items() if k == c}
    clean = corpus_pipeline.passages(spark, alone, sf)
    assert clean.columns == docs.columns and clean.count() == alone.count()
    mixed = corpus_pipeline.mixture(spark, clean, sf)
    assert mixed.columns == docs.columns
    coded = corpus_pipeline.encoding(spark, mixed, sf).collect()
    text = {r["doc_id"]: r["text"] for r in mixed.collect()}
    m = bpe.model(bpe.vocabulary_path())
    assert len(coded) == mixed.count()
    for r in coded:
        assert r["ids"] == list(map(int, m.encode(text[r["doc_id"]] or "").split(","))) if r["ids"] else r["n_tokens"] == 0
        assert r["decoded_sha256"] == hashlib.sha256((text[r["doc_id"]] or "").encode()).hexdigest()


def test_run_over_testdata(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.count() > 50 and set(got.columns) >= {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_run_over_nothing(spark, tmp_path):
    assert corpus_pipeline.run(spark, fixture.table(spark, tmp_path, [])).count() == 0


def test_stage_list():
    assert [re.sub("_.*", "", n) for n, _ in corpus_pipeline.STAGES] == ["quality", "near", "repeats", "source", "bpe"] and corpus_pipeline.ORACLE_SQL is None
