import re
from collections import defaultdict

import pytest

from tests.llm import fixture
from tidings.llm import source_mix


def water(sizes):
    """Targets by repeated resharing of the excess."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, total = set(), 1.5 * sum(sizes.values())
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        target = {s: 2 * sizes[s] if s in full else left * weight[s] / open_ for s in names}
        over = {s for s in names if s not in full and target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


def test_targets_and_taken(spark, tmp_path):
    got = source_mix.query(spark, fixture.table(spark, tmp_path)).collect()
    words = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in fixture.rows()}
    source = {r[0]: r[3] for r in fixture.rows()}
    sizes = defaultdict(int)
    for k, n in words.items():
        sizes[source[k]] += n
    target, taken = water(sizes), defaultdict(int)
    assert len(got) == len(words)
    for r in got:
        assert r["size"] == words[r["doc_id"]] and r["source_size"] == sizes[source[r["doc_id"]]]
        assert r["target"] == pytest.approx(target[source[r["doc_id"]]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    for s, n in taken.items():
        largest = max(w for k, w in words.items() if source[k] == s)
        assert abs(n - target[s]) <= largest / 2 + 1e-6


def test_reruns_and_partitions_agree(spark, sf):
    a = {r["doc_id"]: r["taken"] for r in source_mix.query(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(7)
    rows = source_mix.mix(spark, docs).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in rows if a[r["doc_id"]]} == {r["doc_id"]: r["count"] for r in rows}
    total = sum(a.values())
    assert abs(total - 1.5 * sum(r["size"] for r in source_mix.query(spark, sf).collect())) < 0.05 * total


def test_edge_tables(spark, tmp_path):
    assert source_mix.query(spark, fixture.table(spark, tmp_path, [])).count() == 0
    same = [(None, "a b c", None, "s", None)] * 3 + [(1, None, None, None, None), (1, " ", None, "t", None)]
    got = source_mix.query(spark, fixture.table(spark, tmp_path, same)).collect()
    assert len(got) == 5
    df = spark.createDataFrame(same, fixture.SCHEMA).withColumnRenamed("lang", "passes").withColumnRenamed("n_chars", "last")
    assert source_mix.mix(spark, df).columns == df.columns


def test_documents_of_no_words_are_never_taken_more_often_than_twice(spark):
    """A source whose target is twice its size has no budget left for empty documents."""
    rows = [(k, "a b" if k == 0 else " ", None, "a", None) for k in range(101)] + [(1000 + k, "w " * 50, None, "b", None) for k in range(40)]
    got = source_mix.mix(spark, spark.createDataFrame(rows, fixture.SCHEMA)).groupBy("doc_id").count().collect()
    assert max(r["count"] for r in got) <= 2 and {r["doc_id"]: r["count"] for r in got}[0] == 2
