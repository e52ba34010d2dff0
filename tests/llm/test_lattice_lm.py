import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm import fixture
from tidings.llm import lattice_lm as m

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))


def brute_word(word, pieces, log_p):
    p, raw = dict(zip(pieces, log_p, strict=False)), m.START + word.encode()
    a = [1.0] + [0.0] * len(raw)
    for e in range(1, len(raw) + 1):
        a[e] = sum(a[s] * math.exp(p[raw[s:e]]) for s in range(e) if raw[s:e] in p)
    return math.log10(a[-1])


def test_base_scores_and_counts(spark, tmp_path):
    rows = fixture.rows()
    held = lambda k: zlib.crc32(str(k).encode()) % 10 == 0
    c = Counter()
    for k, t, *_ in rows:
        if not held(k):
            c.update([*tokens(t), None])
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in m.query(spark, fixture.table(spark, tmp_path)).collect()}
    assert len(got) == len(rows)
    for k, t, *_ in rows:
        ts, r = [*tokens(t), None], got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(k), len(ts), sum(c[x] > 0 for x in ts), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in ts), abs=1e-6)
        assert r["score"] < 0


def test_forward_sums_all_segmentations():
    pieces = m.vocabulary(m.vocabulary_path())
    log_p = m.prior(pieces)
    words = ["the", "onstation", "é中x", "a", "zzzzqqqq"]
    raw = [w.encode() for w in words]
    got = m.Lattice(pieces, log_p).log10(np.frombuffer(b"".join(raw), np.uint8), np.array([len(b) for b in raw]))
    assert got == pytest.approx([brute_word(w, pieces, log_p) for w in words])
    long = ("ab" * 3000).encode()
    assert np.isfinite(m.Lattice(pieces, log_p).log10(np.frombuffer(long, np.uint8), np.array([len(long)])))[0]


def test_expected_counts_cover_the_words():
    pieces = m.vocabulary(m.vocabulary_path())
    lat, out = m.Lattice(pieces, m.prior(pieces)), np.zeros(len(pieces) + 1)
    raw = b"onstation" + b"the"
    with np.errstate(divide="ignore", invalid="ignore"):
        for rows, arcs in lat.groups(np.frombuffer(raw, np.uint8), np.array([9, 3])):
            lat.expected(arcs, np.array([2.0, 5.0])[rows], out)
    covered = sum(x * len(p) for x, p in zip(out, pieces, strict=False))
    assert covered == pytest.approx(2 * 12 + 5 * 6)


def test_learning_raises_held_out_likelihood_and_shuffled_letters_lower_it(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    total = lambda rounds: sum(r["score"] for r in m.score(spark, docs, m.vocabulary_path(), rounds=rounds).collect() if r["held_out"])
    assert total(1) > total(0)


def test_empty_and_null_keys(spark, tmp_path):
    assert m.query(spark, fixture.table(spark, tmp_path, [])).count() == 0
    df = spark.createDataFrame([(None, "a b", 1), (4, None, 2)], "doc_id long, text string, n long")
    got = sorted(m.score(spark, df, m.vocabulary_path()).collect(), key=lambda r: r["n_tokens"])
    assert [r["n_tokens"] for r in got] == [1, 3] and all(np.isfinite(r["score"]) for r in got)


def test_long_words_by_stretches_equal_whole_ones(monkeypatch):
    monkeypatch.setattr(m, "LONG", 37)
    pieces = m.vocabulary(m.vocabulary_path())
    lat = m.Lattice(pieces, m.prior(pieces))
    word = np.frombuffer(m.START + b"onstationtheabcdefghij" * 9, np.uint8)
    arcs = lat.arcs(word, 1, len(word))
    assert lat.long_forward(word) == pytest.approx(lat.forward(lat._weights(arcs))[0])
    one, two = np.zeros(len(pieces) + 1), np.zeros(len(pieces) + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        lat.expected(arcs, np.array([3.0]), one)
        lat.long_expected(word, 3.0, two)
    assert two == pytest.approx(one)


def test_very_long_words_are_scored_in_seconds():
    """A word of 2 MB: no underflow, the same sum over lengths as a short one's doubled, and less than twenty seconds for all."""
    import time

    pieces = m.vocabulary(m.vocabulary_path())
    lat = m.Lattice(pieces, m.prior(pieces))
    word = np.frombuffer(m.START + (b"onstationtheabcdefghij\xff\xe4" * 84_000)[:2_000_000], np.uint8)
    began = time.time()
    alpha, out = lat.long_forward(word), np.zeros(len(pieces) + 1)
    lat.long_expected(word, 1.0, out)
    assert time.time() - began < 40 and np.isfinite(alpha).all()
    a, b = alpha[1_000_003], alpha[2_000_003]
    assert b == pytest.approx(2 * a, rel=1e-4) and out.sum() > 2_000_000 / lat.longest and np.isfinite(out).all()


def test_scores_equal_a_plain_recursion(spark, tmp_path):
    """score again: piece weights re-estimated word by word, each text's score as the sum of its words' and the end's."""
    rows = [(k, t, None, None, None) for k, t in enumerate(["the cat onstation", "The dog the cat", None, "", "é中x cat", "dog dog zz", "a the", "onstation the a", "a", "cat zz the", "the the cat", "dog a é中x"])]
    held = lambda k: zlib.crc32(str(k).encode()) % 10 == 0
    pieces = m.vocabulary(m.vocabulary_path())
    log_p = m.prior(pieces)
    p = dict(zip(pieces, np.exp(log_p), strict=False))
    count, n_docs = Counter(), 0
    for k, t, *_ in rows:
        if not held(k):
            count.update(tokens(t))
            n_docs += 1
    got = Counter()
    for word, c in count.items():
        raw = m.START + word.encode()
        n = len(raw)
        a, b = [1.0] + [0.0] * n, [0.0] * n + [1.0]
        for e in range(1, n + 1):
            a[e] = sum(a[s] * p.get(raw[s:e], 0.0) for s in range(e))
        for s in range(n - 1, -1, -1):
            b[s] = sum(b[e] * p.get(raw[s:e], 0.0) for e in range(s + 1, n + 1))
        for s in range(n):
            for e in range(s + 1, n + 1):
                if raw[s:e] in p:
                    got[raw[s:e]] += c * a[s] * p[raw[s:e]] * b[e] / a[n]
    weight = np.array([got[x] for x in pieces] + [n_docs]) + 0.5
    log_q = np.log(weight / weight.sum())
    out = {r["doc_id"]: r["score"] for r in m.query(spark, fixture.table(spark, tmp_path, rows)).collect()}
    for k, t, *_ in rows:
        expected = sum(brute_word(w, pieces, log_q) for w in tokens(t)) + log_q[-1] / math.log(10)
        assert out[k] == pytest.approx(expected, abs=1e-6)
