"""Edits over a whole wide row."""

from pyspark.sql import functions as F

from tidings.operators import details, edits

GOOD = {"hosp": "1", "hos_did": "Direct", "hos_m_d": "2", "hos_f_d": " 1 ", "hos_n": "\U0001f600 Main ", "car": "yes", "car_c_i": "4", "con_veh": "1", "excavator": "true", "bobcat": "1"}
CASES = [
    (1, GOOD, []),
    (2, {}, ["no field"]),
    (3, {"car_d": "1", "nonsense": "2"}, ["computed field: car_d"]),
    (4, {"hosd": "1", "press_m_d": "1"}, ["unknown field: hosd"]),
    (5, {"press": "maybe", "press_did": "X", "press_m_d": "1.5"}, ["press is no flag", "press_did is no mark", "press_m_d is no count"]),
    (6, {"school": "1"}, ["school needs sch_did"]),
    (7, {"school": "0", "school_name": "North", "sch_did": None}, ["sch_did needs school", "school is cleared, not school_name"]),
    (8, {"press_m_d": "99999999999"}, ["press_m_d is no count"]),
    (9, None, []),
    (10, {"hos_n": " "}, []),
]


def wide(spark):
    base = spark.createDataFrame([(i,) for i, *_ in CASES] + [(11,)], "id long")
    root = F.struct(F.lit(5).alias("deaths"), F.lit(None).cast("int").alias("injuries"))
    x = base.select("id", F.create_map().cast(details.CATEGORIES).alias("c"), root.alias("root"))
    return details.widen(x, "id", "c", "root").withColumns({"deaths": F.lit(5), "injuries": F.lit(None).cast("int")})


def test_steps_sums_totals_and_changes(spark):
    rows = wide(spark)
    asked = spark.createDataFrame([(i, e) for i, e, _ in CASES] + [(99, {"la": "0"})], "id long, edit map<string,string>")
    got = {r["id"]: r for r in edits.apply_edits(rows, asked, "id", "edit").collect()}
    assert {i: list(got[i]["errors"]) for i, *_ in CASES} == {i: e for i, _, e in CASES} and set(got) == set(range(1, 12))
    r = got[1]
    assert (r["hosp"], r["hos_did"], r["hosm_d"], r["hosf_d"], r["hosd"], r["hos_n"]) == (True, "D", 2, 1, 3, "Main")
    assert (r["cari"], r["card"], r["total_con"], r["total_deaths"], r["total_injuries"]) == (4, None, 2, 8, 4)
    assert r["old_values"] == dict.fromkeys(r["new_values"]) | {"total_deaths": "5"}
    assert r["new_values"] == {"hosp": "1", "hos_did": "D", "hos_m_d": "2", "hos_f_d": "1", "hos_n": "Main", "car": "1", "car_c_i": "4", "con_veh": "1", "excavator": "1", "bobcat": "1", "car_i": "4", "total_con": "2", "total_deaths": "8", "total_injuries": "4"}
    stored = {x["id"]: x for x in rows.collect()}
    for i in range(2, 12):
        assert got[i]["old_values"] == got[i]["new_values"] == {} and [got[i][c] for c in rows.columns] == list(stored[i])


def test_no_rows(spark):
    none = spark.createDataFrame([], "id long, edit map<string,string>")
    assert edits.apply_edits(wide(spark).where("id < 0"), none, "id", "edit").count() == 0
