import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidings.llm import top_k


def brute(data, k=5):
    v = {i: [math.floor(256 * x) for x in e] for i, e in data if e is not None and all(x is not None and math.isfinite(x) for x in e)}
    out = set()
    for q in (i for i in v if i % 50 == 0):
        s = sorted((-sum(a * b for a, b in zip(v[q], v[c], strict=True)), c) for c in v if c != q)
        out |= {(q, r + 1, c, -n) for r, (n, c) in enumerate(s[:k])}
    return out


def test_against_brute_force_with_ties_and_bad_vectors(spark):
    rng = random.Random(3)
    data = [(i, [float(f"{rng.uniform(-1, 1):.3f}") for _ in range(8)]) for i in range(240)]
    data += [(240 + i, data[i][1]) for i in range(30)]
    data += [(300, None), (350, [0.1] * 7 + [None]), (400, [float("nan")] * 8), (450, [float("inf")] + [0.0] * 7), (500, [0.0] * 8)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    got = {tuple(r) for r in top_k.top_k(spark, df, df.where("vec_id % 50 = 0"), block=3).collect()}
    assert got == brute(data)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_k.top_k(spark, df, df.where("vec_id % 50 = 0")).collect()] == [(0, 1, 1, 256 * 128 + 512 * 128)]
    assert top_k.top_k(spark, df.limit(0), df.limit(0)).count() == 0
    extra = df.withColumn("score", F.lit("x")).withColumn("v", F.lit(1))
    assert top_k.top_k(spark, extra, extra).count() == 2


def test_bounds_spare_exact_reads():
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.floor(256 * rng.normal(0, 0.15, (4000, 64)))
    *_, read = top_k.scan(np.arange(4000), x, np.arange(40), x[:40], 5)
    assert read < 0.05 * 40 * 4000


def test_chunks_bound_one_another_and_lengths_stay_apart(spark):
    """Many vectors in one task, of two lengths, with ties, repeated rows and empty vectors, against all scores."""
    rng = np.random.default_rng(8)
    rows = [(k, [float(x) for x in rng.integers(-3, 4, 6 if k % 3 else 4) / 4]) for k in range(600)]
    rows += [rows[7], rows[7], (601, []), (602, None), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).coalesce(1)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in top_k.top_k(spark, df, df.where("vec_id % 50 = 0")).collect()}
    whole = [(k, [int(np.floor(256 * x)) for x in v]) for k, v in rows if k is not None and v]
    for q, qv in {k: v for k, v in whole if k % 50 == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(qv, v, strict=True)), k) for k, v in whole if k != q and len(v) == len(qv))[:5]
        assert [got[q, i + 1] for i in range(5)] == [(k, -s) for s, k in best]


def test_known_scores_drop_nothing_that_counts():
    rng = np.random.default_rng(9)
    exact, q = rng.integers(-50, 50, (500, 8)).astype(float), rng.integers(-50, 50, (9, 8)).astype(float)
    ids, qi = np.arange(500), np.arange(1000, 1009)
    parts = [top_k.scan(ids[a : a + 100], exact[a : a + 100], qi, q, 5)[:3] for a in range(0, 500, 100)]
    whole = top_k.best_of(*(np.concatenate(x) for x in zip(*parts, strict=True)), 5)
    kth = whole[2][4::5]
    again = top_k.scan(ids, exact, qi, q, 5, kth)
    assert all(np.array_equal(a, b) for a, b in zip(top_k.best_of(*again[:3], 5), whole, strict=True))
    assert again[3] <= top_k.scan(ids, exact, qi, q, 5)[3]
