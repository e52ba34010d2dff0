"""Greedy windows as a stream: equal to the batch form over many batches, with state that stays flat."""

import datetime
import random

from pyspark.sql import functions as F

from tidings.operators import folds
from tidings.streaming import streams

SCHEMA = "k string, id long, at timestamp, who long, sure boolean"
T0 = datetime.datetime(2024, 1, 1)


def naive(rows, window):
    """Each row against all kept ones."""
    kept, out = [], []
    for id_, at, owner, sure in rows:
        hit = next((k for k, t, o in kept if o != owner and abs(at - t) <= window), None) if sure else None
        if sure and hit is None:
            kept.append((id_, at, owner))
        out.append((id_, hit))
    return out


def test_buckets_equal_all_pairs():
    for seed in range(60):
        rng = random.Random(seed)
        rows = [(k, rng.randrange(0, 3000), rng.randrange(3), rng.random() < 0.8) for k in range(200)]
        window = rng.choice([0, 1, 20, 150, 5000])
        assert folds.greedy_window(rows, window) == naive(rows, window)
    assert folds.greedy_window([(1, None, 1, True), (2, 5, None, True), (3, 5, 2, True), (4, 5, float("nan"), True)], 10) == [(1, None), (2, None), (3, 2), (4, None)]


def test_stream_equals_batch_and_state_stays_flat(spark, tmp_path):
    rng = random.Random(1)
    data = [(rng.choice("abc"), k, T0 + datetime.timedelta(seconds=60 * k + rng.randrange(300)), rng.randrange(3), rng.random() < 0.9) for k in range(1600)]
    data += [("quiet", 5000 + k, T0 + datetime.timedelta(seconds=k), k % 2, True) for k in range(3)]
    for n in range(16):
        part = data[100 * n : 100 * n + 100] + (data[1600:] if n == 0 else [])
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{n:02d}")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    df = streams.greedy(source, ["k"], "id", "at", "who", "sure", 600, "20 minutes")
    sizes = []

    def sink(batch, number):
        batch.write.mode("overwrite").parquet(f"{tmp_path}/out/{number}")

    q = df.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    sizes = [o.numRowsTotal for p in q.recentProgress for o in p.stateOperators]
    got = {(r["k"], r["id"]): r["original_id"] for n in range(16) for r in spark.read.parquet(f"{tmp_path}/out/{n}").collect()}
    whole = folds.dedup_in_windows(spark.createDataFrame(data, SCHEMA), ["k"], "id", "at", "who", "sure", 600)
    assert got == {(r["k"], r["id"]): r["original_id"] for r in whole.collect()} and len([v for v in got.values() if v is not None]) > 100
    assert len(sizes) >= 16 and max(sizes[8:]) <= max(sizes[:8]) + 8 and max(sizes) < 120


def test_lockout_as_a_stream_of_rows(spark):
    rng = random.Random(2)
    rows = [(k, rng.randrange(4), T0 + datetime.timedelta(seconds=rng.randrange(4000)) if rng.random() < 0.97 else None, rng.random() < 0.3) for k in range(600)]
    want = {}
    for user in range(4):
        failures, until = 0, None
        for at, k, good in sorted(((r[2], r[0], r[3]) for r in rows if r[1] == user), key=lambda r: (r[0] is not None, r[0] or T0, r[1])):
            if until is not None and at is not None and at >= until:
                failures, until = 0, None
            locked = until is not None
            if not locked:
                failures = 0 if good else failures + 1
                until = at + datetime.timedelta(seconds=300) if failures >= 3 and at is not None else None
            want[k] = (failures, locked)
    df = spark.createDataFrame(rows, "id long, who long, at timestamp, good boolean")
    got = {r["id"]: (r["failures"], r["locked"]) for r in folds.lockout(df, ["who"], "at", "good", "id").collect()}
    assert got == want and {x for _, x in got.values()} == {True, False}
    assert folds.lockout(df.where(F.lit(False)), ["who"], "at", "good", "id").count() == 0


def test_keys_share_their_state(spark, tmp_path):
    """Many keys, also null texts, rows without an owner or a time: equal to the batch form, with a state entry a slice and bucket, not a key."""
    rng = random.Random(3)
    schema = "k string, n long, id long, at timestamp, who long, sure boolean"
    data = [
        (rng.choice([None, "a", "b"]), rng.randrange(100), k, None if k % 50 == 7 and k < 1500 else T0 + datetime.timedelta(seconds=k), rng.choice([None, 1, 2]), rng.choice([None, True, True, False]))
        for k in range(3000)
    ]
    for n in range(2):
        spark.createDataFrame(data[1500 * n : 1500 * n + 1500], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    df = streams.greedy(source, ["k", "n"], "id", "at", "who", "sure", 600, "20 minutes", slices=4)
    q = df.writeStream.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/{number}")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert max(o.numRowsTotal for p in q.recentProgress for o in p.stateOperators) < 100
    got = {(r["k"], r["n"], r["id"]): r["original_id"] for r in spark.read.parquet(f"{tmp_path}/out/*").collect()}
    whole = folds.dedup_in_windows(spark.createDataFrame(data, schema), ["k", "n"], "id", "at", "who", "sure", 600)
    assert got == {(r["k"], r["n"], r["id"]): r["original_id"] for r in whole.collect()} and any(v is not None for v in got.values())
