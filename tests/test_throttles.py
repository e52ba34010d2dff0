"""Throttling by several keys and parked steps against plain loops."""

import random

from pyspark.sql import functions as F

from tidings.operators import throttles

KINDS = ("ip", "device", "account")


def plain(rows, limit, seconds):
    """Attempts (id, at, result, ip, device, account) in order, one at a time."""
    state, out = {}, {}
    for id_, at, result, *names in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])):
        keys = [(k, n) for k, n in zip(KINDS, names, strict=True) if n is not None]
        if names[2] is None and result == "ok":
            result = "failed"
        for k in keys:
            n, until = state.get(k, (0, None))
            state[k] = (0, None) if until is not None and at is not None and at >= until else (n, until)
        stop = next(((k[0], state[k][1]) for k in keys if state[k][1] is not None), None)
        if stop:
            out[id_] = ("blocked", stop[0], stop[1] - at + 1)
            continue
        for k in keys:
            n = {"ok": 0, "failed": state[k][0] + 1}.get(result, state[k][0])
            state[k] = (n, at + seconds if result == "failed" and n >= limit and at is not None else None)
        hit = next((k[0] for k in keys if result == "failed" and state[k][0] >= limit and at is not None), None)
        out[id_] = ("locked", hit, seconds) if hit else (result, None, None)
    return out


def test_throttle_over_chains_of_keys_and_a_hot_address(spark):
    r = random.Random(3)
    rows = []
    for i in range(600):
        ip = "hot" if r.random() < 0.35 else f"a{r.randrange(12)}"
        rows.append((i, None if r.random() < 0.02 else r.randrange(4000), r.choice(["failed", "failed", "ok", "inactive"]), None if r.random() < 0.05 else ip, f"d{r.randrange(15)}", None if r.random() < 0.1 else f"u{r.randrange(20)}"))
    df = spark.createDataFrame(rows, "id long, at long, result string, ip string, device string, account string").withColumn("ts", F.timestamp_seconds("at"))
    got = {x["id"]: (x["outcome"], x["by"], x["retry_after"]) for x in throttles.throttle(df, "id", "ts", "result", {k: F.col(k) for k in KINDS}, "account", 3, 60).collect()}
    want = plain(rows, 3, 60)
    assert got == want and {o for o, *_ in want.values()} == {"blocked", "locked", "failed", "ok", "inactive"}


def test_short_chains_are_folded_once_and_long_ones_in_rounds(spark, monkeypatch):
    """Forty chains, of which only those beyond the limit go in rounds; the results are the same."""
    r, folds, fold = random.Random(5), [], throttles._fold
    rows = [(i, r.randrange(3000), r.choice(["failed", "failed", "ok"]), f"a{c}.{r.randrange(3)}", f"d{c}.{r.randrange(4)}", f"u{c}.{r.randrange(6)}") for i in range(1200) for c in [i % 40 if i % 3 else 0]]
    df = spark.createDataFrame(rows, "id long, at long, result string, ip string, device string, account string").withColumn("ts", F.timestamp_seconds("at"))
    monkeypatch.setattr(throttles, "_fold", lambda x, *more: folds.append(x.count()) or fold(x, *more))
    want = plain(rows, 3, 60)
    for whole, most in ((throttles.WHOLE, 0), ((100, 100), 3 * 500)):
        folds.clear()
        got = throttles.throttle(df, "id", "ts", "result", {k: F.col(k) for k in KINDS}, "account", 3, 60, whole).collect()
        assert {x["id"]: (x["outcome"], x["by"], x["retry_after"]) for x in got} == want
        assert max(folds, default=0) <= most and bool(folds) == bool(most)


def test_throttle_without_rows_or_keys(spark):
    df = spark.createDataFrame([(1, None, None, None)], "id long, ts timestamp, result string, k string")
    keys = {"ip": F.col("k"), "account": F.col("k")}
    assert [tuple(x) for x in throttles.throttle(df, "id", "ts", "result", keys, "account").collect()] == [(1, "failed", None, None)]
    assert throttles.throttle(df.where(F.lit(False)), "id", "ts", "result", keys, "account").count() == 0


def test_parked_messages_return_until_retries_are_used_up(spark):
    m = spark.createDataFrame([(i, "parsed", n, None) for i, n in ((1, 0), (2, 2), (3, 0), (4, 0), (5, 1))], "id long, status string, retries long, error string")
    f = spark.createDataFrame([(1, "ReadTimeout", None, 1), (2, "ReadTimeout", "late", 1), (3, "ValueError", "bad json", 2), (3, "ReadTimeout", "", 1), (4, "OSError", "Connection refused", 1), (9, "ReadTimeout", "", 1)], "id long, kind string, said string, n long")
    parked = throttles.park(m, f, "id", "kind", "said", ["n"], 3)
    assert {r["id"]: (r["status"], r["retries"], r["error"]) for r in parked.collect()} == {
        1: ("error", 1, "ReadTimeout: timed out"),
        2: ("error", 3, "extraction: exceeded max retries (3) — last error: ReadTimeout: late"),
        3: ("error", 1, "bad json"),
        4: ("error", 1, "OSError: Connection refused"),
        5: ("parsed", 1, None),
    }
    again = {r["id"]: (r["status"], r["error"]) for r in throttles.queue_again(parked, F.lit(False), 3).collect()}
    assert again[1] == ("parsed", None) and again[4] == ("error", "OSError: Connection refused") and again[2][1].startswith("extraction: exceeded max retries (3) — last error: ReadTimeout")
    spent = spark.createDataFrame([(1, "error", 5, "ReadTimeout: timed out"), (2, "error", 1, "timed out")], "id long, status string, retries long, error string")
    out = {r["id"]: r["error"] for r in throttles.queue_again(spent, F.col("id") == 2, 3).collect()}
    assert out == {1: "extraction: exceeded max retries (5) — last error: RuntimeError: ReadTimeout: timed out", 2: "timed out"}
