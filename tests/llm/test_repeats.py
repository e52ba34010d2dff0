import hashlib
import random

import numpy as np

from tests.llm import fixture
from tidings.llm import repeats


def brute(rows, length=200):
    seen = {}
    raw = [(r[1] or "").encode() for r in rows]
    for d, b in enumerate(raw):
        for i in range(len(b) - length + 1):
            seen.setdefault(b[i : i + length], []).append((d, i))
    gone = [np.zeros(len(b), bool) for b in raw]
    for at in seen.values():
        if len(at) > 1:
            for d, i in at:
                gone[d][i : i + length] = True
    out = []
    for r, b, g in zip(rows, raw, gone, strict=True):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], g.astype(np.int8)])) == 1)
        kept = bytes(np.frombuffer(b, np.uint8)[~g])
        out.append((r[0], len(b), int(g.sum()), len(edge), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check(spark, tmp_path, rows):
    got = sorted(tuple(r) for r in repeats.query(spark, fixture.table(spark, tmp_path, rows)).collect())
    assert got == brute(rows)


def test_against_brute_force(spark, tmp_path):
    check(spark, tmp_path, fixture.rows(n=70))


def test_passages_at_edges_periods_and_exact_lengths(spark, tmp_path):
    rng = random.Random(5)
    rand = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    p, q = rand(200), rand(199)
    texts = [p, rand(50) + p, p + rand(70), rand(300) + q, q + rand(300), "ab" * 150, "x" * 199, "y" * 200, "z" * 201, rand(90) + p[:150] + p[20:] + rand(10)]
    base = rand(900)
    for _ in range(25):
        i, j = sorted(rng.randrange(900) for _ in range(2))
        texts.append(base[:i] + rand(rng.randrange(30)) + base[j:])
    texts += ["é" * 99 + p + "ß" * 90, "é" * 99 + p + "ö" * 90]
    check(spark, tmp_path, [(i, t, None, None, None) for i, t in enumerate(texts)])


def test_interval_tree_groups_all_occurrences():
    text = "abracadabra"
    order = sorted(range(len(text)), key=lambda i: text[i:])
    lcp = [repeats._common(text[a:].encode(), text[b:].encode()) for a, b in zip(order, order[1:], strict=False)]
    got = {(d, tuple(sorted(order[i : j + 1]))) for i, j, d in repeats.intervals(lcp)}
    assert got == {(1, (0, 3, 5, 7, 10)), (4, (0, 7)), (3, (1, 8)), (2, (2, 9))}


def test_groups_hold_all_occurrences(spark):
    rng = random.Random(9)
    p = "".join(rng.choice("abcdef ") for _ in range(260))
    texts = [f"{i} " * 30 + p + f" {i}" * 30 for i in range(6)]
    rows = repeats.repeat_groups(spark, spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert max(sum(r["repeat"] == x for r in rows) for x in {r["repeat"] for r in rows}) == 6


def test_stage_keeps_columns_characters_and_nulls(spark):
    p = "é" * 120
    df = spark.createDataFrame([(1, "a" + p, "q", 121), (2, "b" + p + "c", "r", 122), (3, None, None, None), (None, "", "s", 0)], "doc_id long, text string, cls string, n_chars long")
    got = {r["doc_id"]: r for r in repeats.remove_repeats(spark, df).collect()}
    assert got[1]["text"] == "a" and got[1]["n_chars"] == 1 and got[2]["text"] == "bc" and got[3]["text"] is None and got[None]["text"] == ""
    assert repeats.remove_repeats(spark, df.limit(0)).count() == 0


def test_reach_is_that_of_the_maximal_repeats():
    rng = random.Random(4)
    for _ in range(60):
        entries = {}
        for _ in range(rng.randrange(2, 14)):
            key = bytes(rng.choice(b"ab") for _ in range(rng.randrange(6))), b"c" + bytes(rng.choice(b"ab") for _ in range(rng.randrange(6)))
            entries[key] = entries.get(key, 0) + 1
        entries = [(*k, n) for k, n in entries.items()]
        cover = lambda rows: {k: {(p, q) for _, a, b in [r for r in rows if r[0] == k] for p in range(a + 1) for q in range(b + 1)} for k in range(len(entries))}
        want = cover([(k, a, b) for a, b, who in repeats.maximal_repeats(entries, 5) for k in who])
        assert cover(list(zip(*(y.tolist() for y in repeats.reach(entries, 5)), strict=True))) == want
