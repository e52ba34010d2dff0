"""Materialization and near copies on small tables: nulls, empty tables, ties, other lengths; against plain Python."""

import datetime
import random

from pyspark.sql import functions as F

from tidings.functions.similarity import word_similarity_of
from tidings.operators import incidents, joins
from tidings.operators.resolution import alert_kind

DAY = datetime.datetime(2024, 5, 1)
MESSAGES = "id long, at timestamp, action int, status string, places array<struct<id:int,status:string>>, text string"


def fast(spark, rows):
    df = incidents.fast_materialize(spark.createDataFrame(rows, MESSAGES), "id", "at", "action", "status", "places", F.concat_ws("|", "text", "place", F.to_date("at")))
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_fast_materialize(spark):
    sure, low, none = [(1, "matched")], [(1, "matched_low_confidence")], [(None, "matched"), (2, "unmatched")]
    hour = lambda h: DAY + datetime.timedelta(hours=h)
    rows = [
        (1, hour(1), 12, "matched", sure, "a"),
        (2, hour(3), 12, "matched", sure, "b"),  # within two hours of 1
        (3, hour(3), 12, "matched", low, "c"),  # not sure, so an incident of its own
        (4, hour(4), 12, "matched", [(1, "matched"), (1, "matched"), (5, "matched")], None),  # place 1 is a duplicate of 3, place 5 is new
        (5, hour(9), 12, "matched", low, "a"),  # the text of 1 on the same day
        (6, hour(33), 12, "matched", low, "a"),  # and on the next
        (7, hour(1), 35, "matched", sure, "a"),
        (8, hour(1), None, "matched", sure, "a"),
        (9, hour(1), 12, None, sure, "a"),
        (10, hour(1), 12, "matched", none, "a"),
        (11, hour(1), 12, "matched", None, "a"),
        (12, None, 12, "matched", sure, "a"),
    ]
    assert fast(spark, rows) == {
        1: ("parsed", None, None, 1), 2: ("duplicate", None, 1, 0), 3: ("parsed", None, None, 1), 4: ("parsed", None, None, 1), 5: ("error", "exact_hash", None, 0), 6: ("parsed", None, None, 1),
        7: ("error", "second_fact", None, 0), 8: ("error", "unmatched_condition", None, 0), 9: ("error", "unmatched_condition", None, 0), 10: ("error", "no_place", None, 0), 11: ("error", "no_place", None, 0), 12: ("error", "no_time", None, 0),
    }
    assert fast(spark, []) == {}


def test_scored_decisions(spark):
    rows = [
        (1, 1, 0, 12, [1.0, 0.0], "a"),
        (1, 2, 1, 12, [1.0, 0.0], "b"),  # 0.35 + 0.45 + 0.2 * 2 / 3 with 1
        (1, 3, 1, 14, [1.0, 0.0], "c"),  # 0.45 + 0.2 * 2 / 3
        (1, 4, 5, 12, [1.0, 0.0], "d"),  # beyond three days
        (1, 5, 5, 12, None, "e"),
        (1, 6, 5, 14, [0.0, 0.0], "f"),  # 0.2 with 4
        (1, 7, 5, 12, [1.0, 0.0, 0.0], "d"),  # 0.55 with 4, but its hash exists
        (2, 8, 1, 12, [1.0, 0.0], None),
        (2, 9, 40, 12, [1.0, 0.0], None),
        (None, 10, 1, 12, [1.0, 0.0], None),
    ]
    df = spark.createDataFrame(rows, "place int, id long, day long, action int, v array<double>, h string")
    got = {r.id: (r.outcome, r.original, r.score and round(r.score, 4)) for r in incidents.scored_decisions(df, "place", "id", "day", "action", "v", hash_="h").collect()}
    plain = ("inserted", None, None)
    assert got == {1: plain, 2: ("merged", 1, 0.9333), 3: ("flagged", 1, 0.5833), 4: plain, 5: plain, 6: plain, 7: ("same_hash", None, None), 8: plain, 9: plain, 10: plain}
    assert incidents.scored_decisions(df.limit(0), "place", "id", "day", "action", "v").count() == 0


def test_near_copies(spark):
    rnd = random.Random(3)
    words = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel", "india", "juliet"]
    rows = []
    for k in range(80):
        said = " ".join(rnd.sample(words, 3)) if k < 30 else rnd.choice(rows[:30])[1] + rnd.choice(["", " x", "s", " kilo lima"])
        rows.append((k, said, DAY + datetime.timedelta(hours=rnd.randrange(150))))
    rows += [(90, None, DAY), (91, "alpha", None), (92, "", DAY), (93, "...", DAY)]
    found = {tuple(r) for r in joins.near_copies(spark.createDataFrame(rows, "id long, said string, at timestamp"), "id", "said", "at").select("id", "original").collect()}
    want = set()
    for k, said, at in rows[:80]:
        near = [(-word_similarity_of(b, said), j) for j, b, s in rows[:80] if j != k and abs(s - at) <= datetime.timedelta(hours=48)]
        if near and -min(near)[0] >= 0.92 and min(near)[1] < k:
            want.add((k, min(near)[1]))
    assert found == want and len(want) > 10


def test_alert_cards(spark):
    texts = ["redalert.com.lb حيطة وحذر", "redalert.com.lb خبطة وحذر", "redalert.com.lb حذر", "حيطة وحذر", "redalert.com.lb حيطة وحذر apache", "معمر سر", "كوترية", "Tawasulra bot apache", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, s string").select("id", alert_kind(F.col("s")))
    assert [k for _, k in sorted(df.collect())] == [36, 36, None, None, 38, 36, 38, None, None]
