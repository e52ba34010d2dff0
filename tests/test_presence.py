"""The gate of present categories against the rules written out, text by text."""

import json
import random

from tidings.operators import presence
from tidings.operators.presence import BUILDINGS, CATEGORIES, TERMS


def scene(category, span, post):
    """Whether evidence only sets the scene: every rule with plain containment."""
    whole = span + "\n" + post
    has = lambda s, g: any(w in s for w in TERMS[g])
    if category in BUILDINGS:
        if has(whole, "unharmed"):
            return True
        if has(span, "near"):
            return not has(span, "harm")
    if category == "road_bridge" and has(span, "road") and not has(span, "road_harm"):
        return True
    if category == "lebanese_army" and has(whole, "escort"):
        return not has(whole, "army_harm")
    if category == "emergency_civil_defense" and has(whole, "ward") and not has(whole, "rescuer"):
        return True
    if category == "municipality":
        shown = span or post
        if has(shown, "locality") and has(shown, "attack") and not has(shown, "town_hall"):
            return True
        if not has(whole, "town_hall") and has(span, "locality"):
            return True
    if category == "vehicles" and not has(whole, "vehicle"):
        return True
    return category == "hospital" and has(whole, "admission") and not has(whole, "harm")


def plain(post, raw):
    post = post or ""
    try:
        answer = json.loads(raw)
        keys, proofs = answer.get("categories_present", []), answer.get("category_evidence", [])
        assert isinstance(keys, list) and isinstance(proofs, list) and all(e.get("category_key") is not None for e in proofs)
    except (TypeError, ValueError, AttributeError, AssertionError):
        return "malformed", []
    out = []
    for key in dict.fromkeys(k for k in keys if k in CATEGORIES):
        span = next(((e.get("evidence_span") or "").strip() for e in proofs if e["category_key"] == key), "")
        if not scene(key, span, post):
            out.append((key, span))
    if "emergency_civil_defense" not in dict(out):
        for w in TERMS["organization"]:
            at = post.find(w)
            if at >= 0:
                out.append(("emergency_civil_defense", post[max(0, at - 20) : at + len(w) + 40].strip()))
                break
    return "ok", out


def run(spark, rows):
    got = presence.gate(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id long, post string, raw string"), "id", "post", "raw").collect()
    assert all(r["categories"] == [e["category_key"] for e in r["evidence"]] for r in got)
    return [(r["status"], [tuple(e) for e in r["evidence"]]) for r in sorted(got)]


def test_each_rule(spark):
    """Categories, evidence and messages of random terms: every rule holds and fails somewhere."""
    rng = random.Random(2)
    terms = [w for g in TERMS.values() for w in g]
    rows = []
    for _ in range(1500):
        group = lambda: rng.choice(list(TERMS.values()))
        said = lambda n: " ".join(rng.choice(rng.choice([terms, group(), ["ميس", "x"]])) for _ in range(rng.randint(0, n)))
        keys = [rng.choice(CATEGORIES) for _ in range(rng.randint(0, 3))]
        proofs = [{"category_key": rng.choice(keys + ["press", "nothing"]), "evidence_span": rng.choice(["", " "]) + said(3)} for _ in range(rng.randint(0, 3))]
        rows.append((said(5), json.dumps({"categories_present": keys, "category_evidence": proofs}, ensure_ascii=rng.random() < 0.5)))
    want = [plain(*r) for r in rows]
    assert run(spark, rows) == want
    for key in (*BUILDINGS, "road_bridge", "lebanese_army", "emergency_civil_defense", "vehicles"):
        asked = [(w, r) for w, r in zip(want, rows, strict=True) if key in json.loads(r[1])["categories_present"]]
        assert {key in dict(w[1]) for w, _ in asked} == {True, False}


def test_malformed_null_and_empty(spark):
    rows = [
        (None, '{"categories_present": ["press"]}'), ("", "{}"), ("x", None), ("x", "{oops"), ("x", "[]"), ("x", "null"), ("x", '{"categories_present": "press"}'), ("x", '{"category_evidence": [{"evidence_span": "y"}]}'),
        ("x", '{"categories_present": ["press", "press", "nothing"], "category_evidence": [{"category_key": "press"}], "more": 1}'), ("مسعف " * 200_000, "{}"), ("x", '{"categories_present": null}'),
    ]
    got = run(spark, rows)
    assert [s for s, _ in got] == ["ok", "ok", "malformed", "malformed", "malformed", "malformed", "malformed", "malformed", "ok", "ok", "ok"]
    assert got[0][1] == [("press", "")] and got[8][1] == [("press", "")] and got[9][1][0][0] == "emergency_civil_defense"
    assert run(spark, []) == []


def test_messages_of_the_field(spark):
    """A statement of a rescue organization, shelling of a bare village, of a neighbourhood without vehicles."""
    proof = lambda k, s: json.dumps({"categories_present": [k], "category_evidence": [{"category_key": k, "evidence_span": s}]})
    shelled, near = "قصف مدفعيّ يستهدف بلدة ميس", "قصف مدفعي معادي يستهدف دوحة كفر"
    got = run(spark, [("الدفاع المدني في بيان: انتشال جثمان من أحد المباني", "{}"), (shelled, proof("municipality", shelled)), (near, proof("vehicles", near)), ("دمرت سيارة", proof("vehicles", "سيارة"))])
    assert [[k for k, _ in e] for _, e in got] == [["emergency_civil_defense"], [], [], ["vehicles"]] and "الدفاع المدني" in got[0][1][0][1]
