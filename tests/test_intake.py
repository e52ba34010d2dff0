"""The push feed's outcomes and counters, and the client seam: failures stay with their own rows."""

import json

import pytest
from pyspark.sql import functions as F

from tidings.operators import relevance
from tidings.sources import push

GOOD = {"external_message_id": "x:1", "message_datetime": "2024-01-01T00:00:00+02:00", "source_name": "n"}


def received(spark, bodies, blocked=(), existing=None):
    df = spark.createDataFrame(list(enumerate(bodies)), "id long, body string")
    old = None if existing is None else spark.createDataFrame([(e,) for e in existing], "external_message_id string")
    return push.receive(df, "id", "body", spark.createDataFrame(list(blocked), "source_platform string, origin_account string"), old)


def test_every_post_has_an_outcome(spark):
    post = lambda **k: json.dumps({f: v for f, v in (GOOD | k).items() if v is not None})
    bodies = [
        None, "", "{oops", "7", '"x"', "null", "[]", "{}", f"[{post()}, 5, null, {post(external_message_id='x:2')}]", post(external_message_id=7, source_platform="P"), post(message_datetime="x"), post(message_datetime=None),
        post(source_name=""), post(source_name=None), post(external_message_id=None), post(external_message_id="y:9", include=False), post(external_message_id="y:9"), post(external_message_id="b:1"), post(external_message_id="b:2", origin_account="other"),
        post(external_message_id="old"), post(external_message_id=":z", raw_text="text", extra={"a": [1]}, reason="r"), post()[:-1], f" {post(external_message_id='w')} ",
    ]
    got = {(r["id"], r["place"]): (r["outcome"], r["reason"], r["source_platform"], r["flagged"]) for r in received(spark, bodies, [("b", "n"), ("b", "n"), ("P", "zz")], ["old", None]).collect()}
    bad = ("failed", "malformed body", None, False)
    want = {(k, 0): bad for k in (0, 1, 2, 3, 4, 5, 21)} | {(8, 1): ("failed", "no object", None, False), (8, 2): ("failed", "no object", None, False)}
    want |= {(7, 0): ("failed", "external_message_id", None, False), (8, 0): ("parsed", None, "x", False), (8, 3): ("parsed", None, "x", False), (9, 0): ("parsed", None, "P", False)}
    want |= {(10, 0): ("failed", "message_datetime", "x", False), (11, 0): ("failed", "message_datetime", "x", False), (12, 0): ("failed", "source_name", "x", False), (13, 0): ("failed", "source_name", "x", False)}
    want |= {(14, 0): ("failed", "external_message_id", None, False), (15, 0): ("parsed", None, "y", True), (16, 0): ("duplicate", None, "y", False), (17, 0): ("blocked", None, "b", False), (18, 0): ("parsed", None, "b", False)}
    want |= {(19, 0): ("duplicate", None, None, False), (20, 0): ("parsed", None, None, False), (22, 0): ("parsed", None, None, False)}
    assert got == want


def test_counters_and_observed_counts_agree(spark, tmp_path):
    bodies = [json.dumps(GOOD | {"external_message_id": f"a:{k % 7}", "include": k % 2 == 0}) for k in range(20)] + ["{", json.dumps(GOOD | {"external_message_id": "b:1"})]
    rows, seen = push.observed(received(spark, bodies, [("b", "n")]))
    rows.write.parquet(f"{tmp_path}/o")
    assert seen.get == {"fetched": 22, "flagged": 10, "parsed": 7, "blocked": 1, "duplicate": 13, "failed": 1}
    got = {r["platform"]: (r["fetched"], r["parsed"], r["duplicate"], r["blocked"], r["failed"]) for r in push.counters(spark.read.parquet(f"{tmp_path}/o")).collect()}
    assert got == {"a": (20, 7, 13, 0, 0), "b": (1, 0, 0, 1, 0), "unknown": (1, 0, 0, 0, 1)}


class Client:
    def __init__(self):
        self.failed = False

    def __call__(self, rows):
        assert len(rows) <= 3 and rows == sorted(rows)
        first = rows[0][0]
        if first >= 100 or (first == 30 and not self.failed):
            self.failed = True
            raise ValueError(f"broken at {first}")
        return [("relevant" if said else "what", 0.5 if k != 31 else 2) for k, said in rows] + ([("relevant", 1.0)] if first == 40 else [])


@pytest.mark.parametrize("parts", [1, 5])
def test_failures_stay_with_their_batch(spark, parts):
    rows = [(k, k // 10, "x" if k % 2 else None) for k in (10, 11, 12, 13, 20, 30, 31, 40, 41, 100, 101, 102, 103)]
    df = spark.createDataFrame(rows, "id long, b long, said string").repartition(parts)
    got = {r["id"]: (r["verdict"], r["confidence"], r["error"], r["calls"]) for r in relevance.classify(df, "id", "said", "b", Client, size=3).collect()}
    no, yes = ("uncertain", 0.0, None), ("relevant", 0.5, None)
    want = {10: (*no, 1), 11: (*yes, 0), 12: (*no, 0), 13: (*yes, 1), 20: (*no, 1), 30: (*no, 2), 31: (*no, 0)}
    want |= {k: (None, None, "RuntimeError: 3 answers for 2 messages", 2 if k == 40 else 0) for k in (40, 41)}
    want |= {k: (None, None, f"ValueError: broken at {100 if k < 103 else 103}", 2 if k in (100, 103) else 0) for k in (100, 101, 102, 103)}
    assert got == want
    assert relevance.classify(df.where(F.lit(False)), "id", "said", "b", Client).count() == 0


def test_bodies_are_read_once(spark, sf):
    """One reading of the posts for their outcome and one for the first of each id, each of which parses a body once."""
    from tidings.plans import QUERIES

    plan = QUERIES["push_counters"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("map<string,string>") <= 2 and plan.count("posexplode") == 2, plan
    assert plan.lower().count("parse_json") + plan.lower().count("parsejson") <= 2
