"""The second fact's rows and their upsert, case by case."""

import datetime

from pyspark.sql import functions as F

from tidings.operators import second_fact

AT = datetime.datetime(2026, 3, 31, 23, 30)
MESSAGES = [
    (1, 7, "Over Tyre \U0001f600\n\n  now", AT, '{"note":"n","url":"u"}'),
    (2, 7, "tyre and SIDON", AT, None),
    (3, 7, "xtyre", AT, '{"ocr_text":"x"}'),
    (4, 7, None, None, '{"ocr_text":"x"}'),
    (5, 7, "unknown place", AT, None),
    (6, 7, "no alert", AT, None),
    (7, 7, "no match", AT, None),
    (8, 7, "a b", AT, '{"link":"","post_url":"p","ocr_text":"x"}'),
]
MATCHES = [(1, 35, [None, 2, 1]), (2, 36, [None]), (3, 38, [1]), (4, 38, []), (5, 35, [9, 1]), (6, 12, [1]), (8, 45, None)]


def made(spark):
    m = spark.createDataFrame(MESSAGES, "message_id long, source_id long, text string, at timestamp, payload string")
    x = spark.createDataFrame(MATCHES, "message_id long, condition_id int, places array<long>")
    p = spark.createDataFrame([(1, "A", "Tyre"), (2, "B", "Sidon"), (3, "C", "abc")], "place_id long, place string, region string")
    return second_fact.rows_of(m, x, p, spark.createDataFrame([(38, "act")], "condition_id int, action string"), "+03:00")


def test_rows(spark):
    got = {r["message_id"]: tuple(r)[1:] for r in made(spark).collect()}
    assert got == {
        1: (35, 7, "Tyre", "April", "2026-04-01", "02:30:00", "Over Tyre\nnow", "n", None, "u"),
        2: (36, 7, "Multiple regions", "April", "2026-04-01", "02:30:00", "tyre and SIDON", None, None, None),
        3: (38, 7, "Tyre", "April", "2026-04-01", "02:30:00", "act فوق A في قضاء Tyre", None, None, None),
        4: (38, 7, None, None, None, None, "act - الموقع بحاجة إلى التحقق", None, None, None),
        8: (45, 7, None, "April", "2026-04-01", "02:30:00", "a b", None, None, "p"),
    }


def test_upsert_overwrites_discards_and_keeps(spark):
    new = made(spark)
    old = spark.createDataFrame([(1, "old", "note"), (2, "old", None), (50, "old", None), (None, "typed", None), (None, "typed", None)], "message_id long, news string, note_2 string")
    old = old.select(*(F.col(c) if c in old.columns else F.lit(None).cast(t).alias(c) for c, t in new.dtypes))
    gone = spark.createDataFrame([(2,), (2,), (3,), (None,), (77,)], "message_id long")
    got = sorted((r["message_id"] or 0, r["news"], r["note_2"], r["change"]) for r in second_fact.upsert(old, new, gone).collect())
    assert got == [(0, "typed", None, "kept"), (0, "typed", None, "kept"), (1, "Over Tyre\nnow", None, "updated"), (2, "old", None, "discarded"), (4, "act - الموقع بحاجة إلى التحقق", None, "inserted"), (8, "a b", None, "inserted"), (50, "old", None, "kept")]
    assert second_fact.upsert(old, new.where("false"), gone.where("false")).where("change <> 'kept'").count() == 0
