import hashlib
import zlib

import pytest

from tests.llm import fixture
from tests.oracle import compare
from tidings.llm import merkle


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text=False) -> str:
    doc_id, body, lang, source, n = row
    if text and body is not None:
        body = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in body)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, body)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 8])) for k in range(0, len(out[-1]), 8)])
    return out


def climb(tree, i, h):
    """(siblings, root) from a leaf's place and its hash."""
    sibs = []
    for nodes in tree[:-1]:
        run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
        sibs += run[: i % 8] + run[i % 8 + 1 :]
        h = sha("".join(run[: i % 8] + [h] + run[i % 8 + 1 :]))
        i //= 8
    return sibs, h


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    trees, members = {}, {}
    for g in langs:
        members[g] = sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = levels([leaf(r) for r in members[g]])
    top = levels([trees[g][-1][0] for g in langs])
    out = []
    for at, g in enumerate(langs):
        for i, r in enumerate(members[g]):
            found = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0)
            a, h = climb(trees[g], i, found)
            b, h = climb(top, at, h)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], sha("".join(a + b)), h, h == top[-1][0]))
    return sorted(out, key=str)


def check(spark, tmp_path, rows):
    got = merkle.query(spark, fixture.table(spark, tmp_path, rows)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_awkward_rows(spark, tmp_path):
    """Nulls in any column, ties, repeated rows, an empty group name, texts of all kinds."""
    rows = fixture.rows() + [(None, None, None, None, None)] * 3 + [(7, "Tie", "en", "a", 1), (7, "TIE", "en", "a", 1), (9, "B", "", "a", None), (9, "B", "zz", None, 0)] * 2
    check(spark, tmp_path, rows)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 513])
def test_sizes_of_groups(spark, tmp_path, n):
    check(spark, tmp_path, [(k, f"Text {k}", "en", "s", k) for k in range(n)] + [(9999, "Lone", "fr", "s", 1)])


def test_one_group_and_more_strides_than_one(spark, tmp_path):
    """5,000 leaves are five levels: coordinates come from two strides; one group's root is the root."""
    check(spark, tmp_path, [(k * 3, f"T{k % 50}", "en", "s", None) for k in range(5000)])


def test_many_groups_and_a_hot_one(spark, tmp_path):
    check(spark, tmp_path, [(k, "x", f"l{k % 700}" if k % 3 else "hot", "s", None) for k in range(2100)])


def test_empty_and_clashing_columns(spark, tmp_path):
    assert merkle.query(spark, fixture.table(spark, tmp_path, [])).count() == 0
    more = spark.createDataFrame(fixture.rows(), fixture.SCHEMA).selectExpr("*", "1 AS grp", "2 AS hash", "3 AS i", "4 AS part", "5 AS leaf")
    more.write.parquet(f"{tmp_path}/more/documents.parquet")
    got = merkle.query(spark, f"{tmp_path}/more").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(fixture.rows())


def test_long_text_and_tampering_by_case_only(spark, tmp_path):
    rows = [(k, "A" * 3_000_000 if k == 1 else "lower only", "en", "s", None) for k in range(12)]
    check(spark, tmp_path, rows)
    got = {r["doc_id"]: r["verified"] for r in merkle.query(spark, str(tmp_path)).collect()}
    assert all(v for k, v in got.items() if k != 1)


def test_equals_sql(spark, sf):
    assert compare(spark, sf, merkle.query, merkle.ORACLE) is None


def test_no_window_over_a_group(spark, tmp_path):
    """Indexes come from ranges: no window sorts a language's rows."""
    plan = merkle.query(spark, fixture.table(spark, tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan and "Window" not in plan
