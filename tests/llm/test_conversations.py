import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from tests.oracle import compare
from tidings.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string"
INITIAL = {"s": c.SYSTEM, "u": c.USER, "a": c.ASSISTANT}


def damage(rows):
    """Rows of one conversation after damage, in order."""
    out = []
    rows = [(t, r or ("" if r == "" else " "), x if x is not None else " ", k) for k, t, r, x in rows]
    for turn, role, text, key in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64].encode(), hashlib.sha256(r[2].encode()).digest())):
        d = zlib.crc32(f"{' ' if key is None else key}:{' ' if turn is None else turn}".encode()) % 20
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain(rows, kinds):
    """(cost, edits, text) by trying every edit of every row with up to two inserts before it, from the last row to the first."""
    ok = re.compile(r"(s?(ua)+)?")
    best = None
    inserts = ["", "u", "a", "ua", "au"]
    for plan in itertools.product(itertools.product(inserts, "KRrD"), repeat=len(rows)):
        for tail in inserts:
            cost, initials, edits, said = 0, "", "", []
            for (ins, e), (_, role, text), fault in zip(plan, rows, kinds, strict=True):
                for i in ins:
                    said.append(f"{'user' if i == 'u' else 'assistant'}:")
                initials, edits, cost = initials + ins, edits + "I" * len(ins), cost + 2 * len(ins)
                if e == "D":
                    cost, edits = cost + 3, edits + "D"
                    continue
                if fault in ("blank", "duplicate"):
                    cost = 99
                    break
                new = {"K": role, "R": "user", "r": "assistant"}[e]
                cost, edits, initials = cost + (0 if e == "K" else 2) + (fault == "truncated"), edits + e.upper(), initials + (new[:1] or " ")
                said.append(f"{new}:{text}")
            cost, edits, initials = cost + 2 * len(tail), edits + "I" * len(tail), initials + tail
            said += [f"{'user' if i == 'u' else 'assistant'}:" for i in tail]
            if cost < 99 and ok.fullmatch(initials) and (best is None or (cost, edits) < best[:2]):
                best = (cost, edits, "\n".join(said))
    return best


def coded(rows, kinds):
    value = {"blank": c.BLANK, "duplicate": c.DUPLICATE, "truncated": c.TRUNCATED, "": 0}
    return [INITIAL.get(r[1][:1], c.OTHER) + value[k] for r, k in zip(rows, kinds, strict=True)]


def some_rows(rng, n):
    return [(k, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", "No.", "cut", "", f"Text {k}!"])) for k in range(n)]


@pytest.mark.parametrize("seed", range(40))
def test_shortest_path_equals_all_edits(seed):
    rng = random.Random(seed)
    rows = some_rows(rng, rng.randint(0, 3))
    kinds = faults(rows)
    got = c.finish(c.advance({c.START: (0, "")}, coded(rows, kinds)))
    assert got == plain(rows, kinds)[:2]


@pytest.mark.parametrize("seed", range(30))
def test_chained_segments_equal_one_pass(seed):
    """Costs and ranks of segments are enough: the same cost and the same string as over the whole."""
    rng = random.Random(seed)
    rows = some_rows(rng, rng.randint(8, 60))
    codes, size = coded(rows, faults(rows)), rng.randint(1, 9)
    parts = [codes[k : k + size] for k in range(0, len(codes), size)]
    sums = [c.summary(p, k == len(parts) - 1) for k, p in enumerate(parts)]
    states = c.chain(np.array([s[0] for s in sums]), np.array([s[1] for s in sums])).tolist()
    cost, edits = 0, ""
    for k, p in enumerate(parts):
        ends = c.advance({states[k]: (0, "")}, p)
        more, text = c.finish(ends) if k == len(parts) - 1 else ends[states[k + 1]]
        cost, edits = cost + more, edits + text
    assert (cost, edits) == c.finish(c.advance({c.START: (0, "")}, codes))


def brute(rows):
    out = {}
    for key in {r[0] for r in rows}:
        after = damage([r for r in rows if r[0] == key])
        kinds = faults(after)
        turns = {r[0] for r in after} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[1][:1] or " " for r in after]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        codes = coded(after, kinds)
        cost, edits = c.finish(c.advance({c.START: (0, "")}, codes))
        plan, tail, _ = c.replay(c.START, edits, codes)
        said = []
        for (before, role, stays), (_, own, text) in zip(plan, after, strict=True):
            said += [f"{c.ROLES[r]}:" for r in before]
            if stays:
                said.append(f"{own if role is None else c.ROLES[role]}:{text}")
        said += [f"{c.ROLES[r]}:" for r in tail]
        out[key] = (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, edits, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def run(spark, path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(f"{path}/conversations.parquet")
    got = c.query(spark, str(path)).collect()
    assert len(got) == len({r["conv_id"] for r in got})
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in got}


def test_replayed_text_equals_all_edits():
    for seed in range(20):
        rows = some_rows(random.Random(100 + seed), 3)
        kinds = faults(rows)
        cost, edits, text = plain(rows, kinds)
        plan, tail, _ = c.replay(c.START, edits, coded(rows, kinds))
        said = [f"{c.ROLES[r]}:" for p in plan for r in p[0]]
        assert len(said) + len(tail) == edits.count("I") and text.count("\n") + bool(text) == sum(p[2] for p in plan) + edits.count("I")


def test_awkward_rows(spark, tmp_path):
    """Nulls in any column, ties of turns, repeated rows, blank and very long texts, odd roles, one dropped conversation."""
    rng = random.Random(5)
    rows = [(k, t, rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(["Yes.", "no", " \t", "", None, "é!", "中。"])) for k in range(60) for t in range(rng.randint(1, 9))]
    rows += [(100, None, None, None), (None, None, "user", "Hi."), (None, 1, "assistant", "Yo."), (None, 1, "assistant", "Yo."), (101, 5, "user", "a."), (101, 5, "user", "b."), (101, 9, "assistant", "c.")]
    rows += [(102, 0, "user", "w " * 1_500_000 + "."), (102, 1, "assistant", "x" * 3_000_000), (103, 0, "user", "a"), (103, 2**62, "user", "b")]
    rows += [(200 + k, 0, "user", "One. Two") for k in range(80)]
    got = run(spark, tmp_path, rows)
    assert got == brute(rows) and any(not v[6] for v in got.values())


def test_one_long_conversation(spark, tmp_path):
    """More than half of all rows in one conversation: three segments and a rest, chained."""
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice([f"Text {t}.", f"cut {t}", "Same.", ""])) for t in range(3500)]
    rows += [(2 + k, t, ["user", "assistant"][t % 2], f"T {t}.") for k in range(300) for t in range(6)]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_long_texts_come_in_pieces(spark, tmp_path):
    rows = [(1, t, ["user", "assistant"][t % 2], f"{t}" + "y" * 1_300_000 + ".") for t in range(12)]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_repaired_texts(spark):
    """The texts themselves, in pieces, hash to the digests of the query's way."""
    rng = random.Random(3)
    rows = [(k, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "no", "", f"Text {t}."])) for k in range(30) for t in range(rng.randint(1, 9))] + [(99, t, "user", f"{t}.") for t in range(1100)]
    df = c.damaged(spark.createDataFrame(rows, SCHEMA))
    got = [c.digests(spark, c.repair(spark, df, c.TIES, texts=x)[1]).collect() for x in (True, False)]
    assert sorted(map(tuple, got[0])) == sorted(map(tuple, got[1]))
    pieces = c.repair(spark, df, c.TIES)[1].where("grp = ':99'").orderBy("seg", "piece").collect()
    assert hashlib.sha256(b"".join(r["body"] for r in pieces)[1:]).hexdigest() == brute(rows)[99][7] and len(pieces) == 2


def test_empty_and_clashing_columns(spark, tmp_path):
    assert run(spark, tmp_path, []) == {}
    rows = [(1, t, "user", f"T {t}.") for t in range(4)]
    wide = [(*r, 1, "x", "y") for r in rows]
    assert run(spark, tmp_path, wide, SCHEMA + ", i int, seg string, grp string") == brute(rows)


def test_turns_beyond_64_bits_give_null_gaps(spark, tmp_path):
    got = run(spark, tmp_path, [(k, t, "user", "a.") for k in range(20) for t in (-(2**63), 2**63 - 1)])
    assert None in {v[0] for v in got.values()}


def test_equals_sql(spark, sf):
    assert compare(spark, sf, c.query, c.ORACLE) is None
