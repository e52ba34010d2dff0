import re

from tests.llm import fixture
from tidings.llm import ngram_join


def brute(rows):
    sets = {}
    for doc_id, text, *_ in rows:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {k: k for k in sets}
    while True:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    m = min(label[a], label[b])
                    if label[a] != m or label[b] != m:
                        label[a] = label[b] = m
                        changed = True
        if not changed:
            return {k: (len(sets[k]), label[k]) for k in sets}


def check(spark, tmp_path, rows):
    got = {r[0]: (r[1], r[2]) for r in ngram_join.query(spark, fixture.table(spark, tmp_path, rows)).collect()}
    assert got == brute(rows)


def test_against_brute_force(spark, tmp_path):
    check(spark, tmp_path, fixture.rows(n=80))


def test_large_groups_in_chains(spark, tmp_path):
    """More near copies than SMALL that share n-grams, in chains whose ends are not similar, beside others with the same passage."""
    word = lambda i: f"w{i}"
    base = [word(i) for i in range(60)]
    rows = []
    for k in range(40):
        t = list(base)
        for j in range(k // 8):
            t[5 + 9 * j] = f"x{j}"
        rows.append((k, " ".join(t[: 60 - k % 3]), None, None, None))
    rows += [(100 + k, " ".join([*base[:20], *(f"y{k}z{i}" for i in range(30))]), None, None, None) for k in range(25)]
    rows += [(200 + k, " ".join(base[:22]), None, None, None) for k in range(30)]
    check(spark, tmp_path, rows)


def test_nulls_empty_and_extra_columns(spark, tmp_path):
    assert ngram_join.query(spark, fixture.table(spark, tmp_path, [])).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f", 1), (3, "a b c d e f", 2), (2, "A b c d e f", 3), (5, None, 4)], "doc_id long, text string, cls int")
    rows, _ = ngram_join.join(spark, df)
    assert {(r["doc_id"], r["component_id"]) for r in rows.collect()} == {(None, None), (3, 2), (2, 2), (5, 5)}
    kept = ngram_join.drop_near_copies(spark, df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {None, 2, 5}


def test_keys_that_repeat_lose_no_text(spark):
    """One row of each component of rows stays, also if a key has two texts or repeats with the same one."""
    a, b, c = "a b c d e f", "p q r s t u", "v w x y z zz"
    df = spark.createDataFrame([(3, b), (5, a), (5, b), (9, a), (7, c), (7, c), (8, None), (8, None)], "doc_id long, text string")
    kept = ngram_join.drop_near_copies(spark, df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.where("text is not null").collect())) == [(3, b), (5, a), (7, c)]
    assert kept.where("text is null").count() == 2


def components_of(spark, rows, **how):
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(spark, df, **how)[0].collect()}


def test_blocks_cells_and_hot_grams(spark):
    """With tiny limits every group goes through heads, blocks and cells, and the common n-grams are dealt by class; the result is that of brute force."""
    rows = fixture.rows(seed=3, n=60)
    base = [f"w{i}" for i in range(40)]
    for k in range(24):
        t = list(base)
        for j in range(k // 4):
            t[4 + 6 * j] = f"x{j}"
        rows.append((200 + k, " ".join(t[: 40 - k % 4]), None, None, None))
    assert components_of(spark, rows, heavy=1 << 12, small=1, hot=3, block=3) == brute(rows)


def test_thousands_of_unlike_sets_share_their_ngrams(spark):
    """Texts put together from few passages: each n-gram is in hundreds of unlike sets; the same passages in another order are near copies."""
    import itertools
    import random

    rng = random.Random(6)
    passages = [" ".join(f"p{i}q{j}" for j in range(60)) for i in range(12)]
    rows, first = [], {}
    for k, own in enumerate(rng.sample([p for c in itertools.combinations(range(12), 4) for p in itertools.permutations(c)], 3000)):
        rows.append((k, " ".join(passages[i] for i in own)))
        first.setdefault(frozenset(own), k)
    got = components_of(spark, rows)
    assert got == {k: (236, first[frozenset(int(w[1:].split("q")[0]) for w in t.split())]) for k, t in rows}
