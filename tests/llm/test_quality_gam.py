import numpy as np

from tests.llm import fixture
from tidings.llm import quality_gam as g


def auc(s, y):
    s, y = np.asarray(s), np.asarray(y)
    pos, neg = s[y == 1], s[y == 0]
    return float((pos[:, None] > neg[None]).mean() + 0.5 * (pos[:, None] == neg[None]).mean())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect()}
    rows = [r for r in g.query(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    y = [labels[r["doc_id"]] for r in rows]
    assert auc([r["score"] for r in rows], y) > 0.9
    assert np.mean([r["predicted"] == v for r, v in zip(rows, y, strict=True)]) > 0.9


def test_interactions_are_learnt():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (4000, len(g.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = g.train(x, y)
    assert m.pairs[0] == (0, 1) and auc(m.score(x), y) > 0.95


def test_edges(spark, tmp_path):
    docs = fixture.docs(spark).withColumnRenamed("lang", "x").withColumnRenamed("source", "score")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, 0), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    got = g.classify(spark, docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in g.classify(spark, docs, labels.limit(0)).collect()} == {0.5}
    assert g.classify(spark, docs.limit(0), labels).count() == 0


def test_scores_equal_a_plain_sum_of_look_ups(spark):
    """The model fitted again from the tables row by row, and each score by looking bins up one at a time."""
    from bisect import bisect_right
    from math import exp
    from zlib import crc32

    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect() if r[1] is not None}
    learn = [(k, t) for k, t in docs if k in labels and crc32(str(k).encode()) % 5 != 0]
    m = g.train(np.array([g.statistics(t or "") for _, t in learn]), np.array([float(labels[k] > 0) for k, _ in learn]))
    got = {r["doc_id"]: r for r in g.query(spark, sf).collect()}
    assert len(got) == len(docs)
    for k, t in docs:
        x = g.statistics(t or "")
        z = m.intercept + sum(table[bisect_right(cut.tolist(), x[f])] for f, (cut, table) in enumerate(zip(m.cuts, m.tables, strict=True)))
        z += sum(table[bisect_right(m.pair_cuts[a].tolist(), x[a]), bisect_right(m.pair_cuts[b].tolist(), x[b])] for (a, b), table in zip(m.pairs, m.pair_tables, strict=True))
        s = 1 / (1 + exp(-min(30.0, max(-30.0, z))))
        assert abs(got[k]["score"] - s) < 1e-6 and got[k]["held_out"] == (crc32(str(k).encode()) % 5 == 0) and got[k]["predicted"] == int(got[k]["score"] >= 0.3)


def test_repeated_rows_score_alike(spark):
    docs = fixture.docs(spark)
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    rows = g.classify(spark, docs.unionByName(docs), labels).groupBy("doc_id").agg({"score": "min", "*": "count"}).collect()
    more = g.classify(spark, docs.unionByName(docs), labels).groupBy("doc_id").agg({"score": "max"}).collect()
    assert {r["doc_id"]: r["min(score)"] for r in rows} == {r["doc_id"]: r["max(score)"] for r in more} and {r["count(1)"] for r in rows} == {2}
