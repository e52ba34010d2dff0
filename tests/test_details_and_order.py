"""Tiers of details, fields filled in, a run's log, and the order of letters."""

import pytest
from pyspark.sql import functions as F

from tidings.operators import details, paging, runs

CASE = f"id long, c {details.CATEGORIES}, root struct<" + ", ".join(f"{c}: int" for c in details.COUNTS) + ">"
ANSWER = f"id long, key string, detail {details.CATEGORY}, error string"


def test_failures_and_empty_details_leave_the_others(spark):
    one = lambda **k: {"did": None, "name": None, "casualties": None, "vehicles": None} | k
    rows = [(1, {"press": one(name="old"), "unifil": one(did="D")}, {"deaths": 2}), (2, None, None), (3, {}, {"deaths": None}), (4, {"casualty_demographics": one(name="own")}, {"injuries": 1})]
    answers = [
        (1, "press", one(name="new"), None), (1, "unifil", None, "timeout"), (1, "hospital", one(casualties={"deaths": 0}), None), (1, "vehicles", one(vehicles={"car": False}), None), (1, "road_bridge", one(casualties={}), None),
        (2, "vehicles", one(vehicles={"moto_d": 0}), None), (2, "hospital", None, None), (9, "press", one(name="x"), None),
    ]
    df = spark.createDataFrame(rows, CASE)
    got = {r["id"]: r for r in details.assemble(df, "id", "c", "root", spark.createDataFrame(answers, ANSWER), "key", "detail", "error").collect()}
    assert {k: sorted(r["categories"]) for k, r in got.items()} == {1: ["casualty_demographics", "hospital", "press", "unifil"], 2: ["vehicles"], 3: [], 4: ["casualty_demographics"]}
    assert got[1]["categories"]["press"]["name"] == "new" and got[1]["categories"]["casualty_demographics"]["casualties"]["deaths"] == 2 and got[4]["categories"]["casualty_demographics"]["name"] == "own"
    assert (got[1]["failed"], got[1]["empty"], got[2]["empty"], got[3]["failed"]) == (["unifil"], ["road_bridge", "vehicles"], ["hospital"], [])
    assert details.assemble(df, "id", "c", "root", spark.createDataFrame([], ANSWER), "key", "detail", "error").count() == 4


def test_fill(spark):
    kind = "k int, n int, f boolean, s string, only string"
    stored = spark.createDataFrame([(1, 3, False, None, "a"), (2, None, None, "x", "b"), (3, 1, True, "y", "c")], kind)
    incoming = spark.createDataFrame([(1, 2, None, "new", 7), (2, 5, False, "z", 7), (9, 1, True, "q", 7)], "k int, n int, f boolean, s string, more int")
    got = [tuple(r) for r in details.fill(stored, incoming, ["k"]).orderBy("k").collect()]
    assert got == [(1, 3, False, "new", "a"), (2, 5, False, "x", "b"), (3, 1, True, "y", "c")]


def test_run_log(spark, tmp_path):
    log = runs.RunLog(spark, f"file://{tmp_path}/log")
    rows = spark.range(10)
    out = log.stage("a", "even", rows, lambda x: x.where("id % 2 = 0"), f"{tmp_path}/even", largest=F.max("id"))
    assert out.count() == 5 and log.stage("a", "bad", out, lambda x: x.select(F.raise_error(F.lit("no")).cast("int")), f"{tmp_path}/bad") is None
    log.stage("a", "even", rows.limit(4), lambda x: x, f"{tmp_path}/even", largest=F.max("id"))
    got = {r["stage"]: (r["n_in"], r["n_out"], r["extra"], r["failed"]) for r in log.table.read().collect()}
    assert got == {"even": (4, 4, {"largest": "3"}, False), "bad": (5, 0, {}, True)} and "no" in log.table.read().where("failed").first()["error"]


@pytest.mark.parametrize("locale,want", [(None, ["apple", "Zoo", "Äpfel", "БАНК", "аист", None]), ("UNICODE_CI", ["Äpfel", "apple", "Zoo", "аист", "БАНК", None]), ("sv_CI", ["apple", "Zoo", "Äpfel", "аист", "БАНК", None])])
def test_order_of_letters(spark, locale, want):
    df = spark.createDataFrame([(n,) for n in ("Zoo", "аист", None, "apple", "БАНК", "Äpfel")], "name string")
    got = [r[0] for r in df.orderBy(paging.sort_key(df, "name", locale=locale)).collect()]
    assert got == want if locale else got[-1] is None and got[:2] == want[:2]


def test_names_without_regard_to_case(spark):
    dim = spark.createDataFrame([(1, "Straße"), (2, " ÉCLAIR"), (3, "éclair"), (4, "ΣΟΦΟΣ")], "id int, label string")
    rows = spark.createDataFrame([("STRASSE",), ("éclair ",), ("σοφος",), ("eclair",), (None,)], "said string")
    got = {r["said"]: r["of"] for r in paging.resolve_names(rows, "said", dim, "label", "id", "of", locale="UNICODE_CI").collect()}
    assert got == {"STRASSE": None, "éclair ": 2, "σοφος": 4, "eclair": None, None: None}


def test_details_are_assembled_once(spark, sf):
    """Answers meet their messages in one join and stored rows in another; a task sorts for no more."""
    from tidings.plans import QUERIES

    plan = QUERIES["tiered_details"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and plan.count("Aggregate ") == 1
