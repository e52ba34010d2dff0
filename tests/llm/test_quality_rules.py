import re

from tests.llm import fixture
from tidings.llm import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text or "")
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    rep = {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(rep)


def test_statistics(spark, tmp_path):
    expected = {r[0]: brute(r[1]) for r in fixture.rows()}
    got = {r["doc_id"]: r for r in quality_rules.query(spark, fixture.table(spark, tmp_path)).collect()}
    assert {k: tuple(v[n] for n in quality_rules.STATS) for k, v in got.items()} == expected
    for k, v in got.items():
        n, rep = expected[k][0], expected[k][4]
        assert v["base_failed"] == (n < 10 or 100 * rep > 20 * n)
        assert not (v["base_failed"] and v["kept"])


def test_estimates_find_the_accurate_rule():
    # three rules; the third votes at random
    patterns = {}
    for good in (0, 1):
        for noise in (0, 1):
            p = (good, good, noise)
            patterns[p] = patterns.get(p, 0) + (800 if good else 200)
    m = quality_rules.estimate(patterns)
    assert m["odds"][0][1][1] > 0.95 and abs(m["odds"][2][1][1] - 0.5) < 0.05


def test_separates_junk_by_labels(spark, sf):
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect()}
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.query(spark, sf).collect()}
    good = [kept[k] for k, q in labels.items() if q == 1]
    bad = [kept[k] for k, q in labels.items() if q == 0]
    assert sum(good) >= 0.9 * len(good) and sum(bad) <= 0.3 * len(bad)


def test_keep_good_keeps_columns_and_empty_tables(spark):
    df = fixture.docs(spark).withColumnRenamed("lang", "n_words").withColumnRenamed("source", "kept")
    assert quality_rules.keep_good(spark, df).columns == df.columns
    assert quality_rules.keep_good(spark, df.limit(0)).count() == 0


def test_plan_is_native(spark, sf):
    df = quality_rules.with_stats(spark.read.parquet(f"{sf}/documents.parquet"))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_verdicts_equal_estimation_row_by_row(spark, tmp_path):
    """kept and the posterior again: every row's votes in plain Python, expectation-maximisation over rows and not over vote patterns."""
    import math

    def votes(text):
        n, chars, sym, dup, rep = brute(text)
        lines = len([x for x in (text or "").split("\n") if WORD.search(x)])
        upper = len(re.findall("[A-Z]", text or ""))
        pick = lambda bad, good: 0 if bad else 1 if good else 2
        return (
            pick(n < 10, False), pick(rep > 0.2 * n, rep <= 0.02 * n), pick(sym > 0.05 * chars, sym <= 0.005 * chars), pick(sym > 0.3 * n, sym <= 0.05 * n),
            pick(dup > 0.3 * lines, False), pick(upper > 0.5 * chars, False),
            pick(rep > 0.1 * n or sym > 0.1 * n or upper > 0.3 * chars, n >= 10 and rep <= 0.02 * n and sym <= 0.05 * n and upper <= 0.3 * chars),
        )

    rows = fixture.rows()
    said = {r[0]: votes(r[1]) for r in rows}
    post = {k: (0.5 + v.count(1)) / (1 + sum(x != 2 for x in v)) for k, v in said.items()}
    for _ in range(50):
        good = sum(post.values())
        prior = (good + 1) / (len(rows) + 2)
        odds = []
        for r in range(7):
            seen = [[1.0] * 3, [1.0] * 3]
            for k, v in said.items():
                seen[1][v[r]] += post[k]
                seen[0][v[r]] += 1 - post[k]
            odds.append([[x / sum(row) for x in row] for row in seen])
        post = {k: 1 / (1 + (1 - prior) / prior * math.prod(odds[r][0][x] / odds[r][1][x] for r, x in enumerate(v))) for k, v in said.items()}
    got = {r["doc_id"]: r for r in quality_rules.query(spark, fixture.table(spark, tmp_path)).collect()}
    for r in rows:
        n, *_, rep = brute(r[1])
        failed = n < 10 or 100 * rep > 20 * n
        assert abs(got[r[0]]["p_good"] - post[r[0]]) < 1e-6
        assert got[r[0]]["kept"] == (not failed and post[r[0]] >= 0.5)
