"""Clusters over sweeps: the same as in one go, whatever the order; clusters without news keep their representative."""

import random

import pytest
from pyspark.sql import functions as F

from tidings.operators import graph


def whole(n, edges):
    label = list(range(n))
    for _ in range(n):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("seed,sweeps", [(1, 1), (2, 3), (3, 5)])
def test_sweeps_equal_one_run(spark, seed, sweeps):
    rng = random.Random(seed)
    n = 60
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(45)] + [(k, k + 1) for k in range(40, 50)]
    when = [rng.randrange(sweeps) for _ in range(n)]
    members = spark.createDataFrame([(k, (k * 37) % 5) for k in range(n)], "id long, trust int")
    state = None
    for s in range(sweeps):
        pending = members.where(F.col("id").isin([k for k in range(n) if when[k] == s] or [-1]))
        seen = [(a, b) for a, b in edges if max(when[a], when[b]) == s]
        state = graph.sweep(state, members, "id", pending, spark.createDataFrame(seen, "a long, b long"), "a", "b", F.col("trust"), F.col("id"))
    got = {r["id"]: (r["label"], r["is_rep"]) for r in state.collect()}
    label = whole(n, edges)
    reps = {min((k for k in range(n) if label[k] == c), key=lambda k: ((k * 37) % 5, k)) for c in set(label)}
    assert got == {k: (label[k], k in reps) for k in range(n)}


def test_only_touched_clusters_change(spark):
    members = spark.createDataFrame([(k, 0) for k in range(6)], "id long, trust int")
    first = graph.sweep(None, members, "id", members.where("id < 4"), spark.createDataFrame([(0, 1), (2, 3)], "a long, b long"), "a", "b", F.desc("id"))
    # the stored representative of 0 and 1 is altered by hand: a sweep that does not touch them must leave it
    marked = first.withColumn("is_rep", F.when(F.col("label") == 0, F.col("id") == 0).otherwise(F.col("is_rep")))
    state = graph.sweep(marked, members, "id", members.where("id = 4"), spark.createDataFrame([(3, 4)], "a long, b long"), "a", "b", F.desc("id"))
    assert sorted(map(tuple, state.collect())) == [(0, 0, True), (1, 0, False), (2, 2, False), (3, 2, False), (4, 2, True)]
    changed = graph.merge_labels(state, "id", members.where("id = 5"), spark.createDataFrame([(5, 0), (5, 2)], "a long, b long"), "a", "b")
    assert sorted(map(tuple, changed.collect())) == [(2, 0), (3, 0), (4, 0), (5, 0)]


def test_pairs_of_pending_rows(spark):
    at = lambda k: F.timestamp_seconds(F.lit(k * 60))
    rows = spark.range(40).select(F.col("id"), F.array((F.col("id") % 3).cast("int"), (F.col("id") % 5).cast("int") + 10).alias("p"), F.timestamp_seconds(F.col("id") * 60).alias("at"))
    every = {tuple(r) for r in graph.place_time_pairs(rows, "id", "p", "at", 600).collect()}
    got = {tuple(r) for r in graph.new_pairs(rows.where("id % 4 = 1"), rows.where("id % 4 = 0"), "id", "p", "at", 600).collect()}
    assert got == {(a, b) for a, b in every if {a % 4, b % 4} <= {0, 1} and 1 in (a % 4, b % 4)} and got
