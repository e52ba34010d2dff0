"""Exact repeated passages across a corpus, by an enhanced suffix array over anchored suffixes.

Texts are bytes. Of the ANCHOR-byte strings in each window, the one with the least hash is an anchor, so equal strings of
LENGTH bytes have an anchor at the same place. Anchors that occur once in the corpus are dropped by a bit map; the
others travel with LENGTH bytes to their right and what lies to their left within reach, to the task of their hash: a bucket
of the suffix array. There the suffixes are sorted and their common prefixes stacked to the interval tree; within each
interval the members stand in the order of their reversed left contexts, whose own interval tree tells where left extensions
differ: each of its intervals is a maximal repeat with all its occurrences, not just neighbours, kept as a stretch of that
order. What the groups of LENGTH bytes or more cover is the result (`tree`, on the path of the query, of the stage and of
`repeat_groups`, which writes the groups out).

Texts that are whole copies are one class and meet the others once; equal contexts of a bucket are one entry with a number
of occurrences, so a passage that very many documents share is sorted once for each way it is embedded.

Edge cases: null and empty texts have no bytes and no repeats; a text shorter than LENGTH bytes has none; very long texts
are read whole, one at a time, in memory in proportion to their bytes; repeated rows are copies and are removed whole from
LENGTH bytes on; equal anchor hashes within a window are all anchors; rows with null keys are treated like others; extra
columns are ignored by the query and kept by the stage (working names start with two underscores); an empty table gives an
empty result. Texts are told apart, and anchors found, by 64-bit hashes; contexts are compared byte by byte.
"""

import hashlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.kernels import buffers, mix
from tidings.llm.work import Workspace, bitmap, by_part, chunks, n_parts, packed, record, unpacked

LENGTH, ANCHOR = 200, 100
UNIT = 8
_BASE = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(11))
_COUNT = np.dtype([("h", "<u8"), ("n", "u1")])
_ENTRY = np.dtype([("h", "<u8"), ("c", "<i8"), ("p", "<i4"), ("l", "<u2"), ("r", "<u2")])
_powers: list[np.ndarray] = []


def _pow(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 17)
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 2**64))]
    return _powers


def _slide(x: np.ndarray, width: int, least) -> np.ndarray:
    """least of each `width` values in a row."""
    n, now, m = len(x) - width + 1, 1, x
    while 2 * now <= width:
        m = least(m[:-now], m[now:])
        now *= 2
    return least(m[:n], m[width - now : width - now + n])


def anchors(text: np.ndarray, length: int = LENGTH, size: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of a text's anchors: any string of `length` bytes holds one, at a place that its own bytes tell."""
    n = len(text)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = _pow(n + 1)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[text] * up[:n], out=run[1:])
    h = mix((run[size:] - run[:-size]) * down[: n - size + 1]) | np.uint64(1)
    width = length - size + 1
    low = np.zeros(len(h) + width - 1, np.uint64)
    low[width - 1 : len(h)] = _slide(h, width, np.minimum)
    at = np.flatnonzero(_slide(low, width, np.maximum) == h)
    return at, h[at]


def _part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(8)) % np.uint64(parts)).astype(np.int32)


def _texts(batches):
    """(class, bytes) of each text that is long enough, once a task."""
    seen: set[int] = set()
    for table in chunks(batches):
        data, off = buffers(table.column("text"))
        for c, a, b in zip(table.column("cls").to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
            if b - a >= LENGTH and c not in seen:
                seen.add(c)
                yield c, data[a:b]


def _count_anchors(parts: int):
    def run(batches):
        held, size = [], 0

        def flush():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            out = np.zeros(len(h), _COUNT)
            out["h"], out["n"] = h, np.minimum(n, 2)
            return packed(out, _part_of(h, parts))

        for _, text in _texts(batches):
            held.append(anchors(text)[1])
            size += len(held[-1])
            if size > 400_000:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return run


def _several(part, table):
    x = unpacked(table, _COUNT)
    h, at = np.unique(x["h"], return_inverse=True)
    yield record(h=h[np.bincount(at, x["n"], len(h)) > 1].view(np.int64))


def _contexts(parts: int, wanted):
    def run(batches):
        held, ctx, size = [], [], 0

        def flush():
            x, part = np.concatenate(held), _part_of(np.concatenate(held)["h"], parts)
            order = np.argsort(part, kind="stable")
            cut = np.flatnonzero(np.diff(part[order])) + 1
            for rows in np.split(order, cut):
                yield record(part=part[rows[:1]], blob=[x[rows].tobytes()], ctx=[b"".join([ctx[i] for i in rows.tolist()])])

        for c, text in _texts(batches):
            at, h = anchors(text)
            keep = wanted.value.has(h.view(np.int64))
            at, h = at[keep], h[keep]
            if not len(at):
                continue
            x = np.zeros(len(at), _ENTRY)
            x["h"], x["c"], x["p"] = h, c, at
            x["l"], x["r"] = np.minimum(at, LENGTH - ANCHOR), np.minimum(len(text) - at, LENGTH)
            raw = text.tobytes()
            ctx += [raw[p - a : p + b] for p, a, b in zip(at.tolist(), x["l"].tolist(), x["r"].tolist(), strict=True)]
            held.append(x)
            size += len(at)
            if size > 60_000:
                yield from flush()
                held, ctx, size = [], [], 0
        if held:
            yield from flush()

    return run


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def intervals(lcp: list[int]):
    """The intervals of an enhanced suffix array: (first, last, common prefix) of each group of suffixes that no wider group shares as long a prefix with, by one scan with a stack. lcp[i] is that of suffixes i and i + 1."""
    stack: list[tuple[int, int]] = []
    for i, v in enumerate([*lcp, 0]):
        left = i
        while stack and stack[-1][1] > v:
            left, depth = stack.pop()
            yield left, i, depth
        if v and (not stack or stack[-1][1] < v):
            stack.append((left, v))


def _least(values: np.ndarray) -> list[np.ndarray]:
    """Minima of all stretches of 1, 2, 4, ... values."""
    out, n = [values], 1
    while 2 * n <= len(values):
        out.append(np.minimum(out[-1][:-n], out[-1][n:]))
        n *= 2
    return out


def tree(entries: list[tuple[bytes, bytes, int]], length: int = LENGTH, best: np.ndarray | None = None):
    """A bucket's maximal repeats around its anchor: (right, members, groups) for each interval of the suffix order, longest common prefix first on each path; members are the interval's entries in the order of their reversed left contexts, and each group (first, last, left) says that those members, and no others, share `left` bytes before the anchor and `right` from it on, left + right >= length, and that their left extensions differ beyond. Groups are stretches of the members, so none is written out. entries: distinct (reversed left context, right context, number of occurrences); an entry that occurs several times is a group of its own.

    With best, an array of how many left bytes of each entry are covered so far, intervals whose groups reach no further left for any member are passed over."""
    m = len(entries)
    for k, (before, after, n) in enumerate(entries):
        if n > 1 and len(before) + len(after) >= length:
            yield len(after), np.array([k]), [(0, 0, len(before))]
    order = sorted(range(m), key=lambda k: entries[k][1])
    lcp = [_common(entries[a][1], entries[b][1]) for a, b in pairwise(order)]
    side = sorted(range(m), key=lambda k: entries[k][0])
    minima = _least(np.array([_common(entries[a][0], entries[b][0]) for a, b in pairwise(side)], np.int64))
    rank = np.empty(m, np.int64)
    rank[side] = np.arange(m)
    by_rank, order = np.array(side), np.array(order)
    for first, last, right in intervals(lcp):
        r = np.sort(rank[order[first : last + 1]])
        # common left bytes of neighbours in the left order: the least of the stretch between their ranks
        gap = np.diff(r)
        level = np.frexp(gap.astype(np.float64))[1] - 1
        near = np.empty(len(gap), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            near[at] = np.minimum(minima[k][r[at]], minima[k][r[at + 1] - (1 << k)])
        members, need = by_rank[r], length - right
        deepest = np.maximum(np.append(near, 0), np.concatenate([[0], near]))
        if not (deepest >= need).any() or best is not None and not ((deepest >= need) & (deepest > best[members])).any():
            continue
        # the left tree's intervals are where left extensions differ: deeper than `need`, each with all its members
        groups = list(intervals(np.where(near >= max(1, need), near, 0).tolist()))
        if need <= 0 and near.min() == 0:
            groups.append((0, len(members) - 1, 0))
        yield right, members, groups


def maximal_repeats(entries: list[tuple[bytes, bytes, int]], length: int = LENGTH):
    """Maximal repeats over the anchor of a bucket, written out: (left, right, members)."""
    for right, members, groups in tree(entries, length):
        for first, last, left in groups:
            yield left, right, members[first : last + 1].tolist()


def reach(entries: list[tuple[bytes, bytes, int]], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How far a bucket's maximal repeats reach around its anchor: (entry, left, right), of each interval's groups the one with most left bytes for each of its members. Groups that an entry's groups of longer `right` cover are left out."""
    best = np.full(len(entries), -1, np.int64)
    out = [np.zeros((0, 3), np.int64)]
    for right, members, groups in tree(entries, length, best):
        left = np.full(len(members), -1, np.int64)
        for first, last, depth in reversed(groups):  # a group comes after the narrower ones in it
            left[first : last + 1] = depth
        keep = left > best[members]
        who, left = members[keep], left[keep]
        best[who] = left
        out.append(np.stack([who, left, np.full(len(who), right)], axis=1))
    return tuple(np.concatenate(out).T)


def forms(x: np.ndarray, ctx: list[bytes]) -> tuple[list[tuple[bytes, bytes, int]], list[list[int]]]:
    """A bucket's distinct contexts as entries, and the occurrences of each."""
    found: dict[tuple[int, bytes], list[int]] = {}
    for i, (n, c) in enumerate(zip(x["l"].tolist(), ctx, strict=True)):
        found.setdefault((n, c), []).append(i)
    return [(c[:n][::-1], c[n:], len(own)) for (n, c), own in found.items()], list(found.values())


def bucket(x: np.ndarray, ctx: list[bytes], length: int = LENGTH):
    """Of a bucket's occurrences: (left, right, occurrences) of its maximal repeats."""
    entries, own = forms(x, ctx)
    for left, right, members in maximal_repeats(entries, length):
        yield left, right, [i for k in members for i in own[k]]


def _buckets(table):
    """(occurrences, contexts) of each bucket of a part that holds several."""
    x = unpacked(table, _ENTRY)
    whole = b"".join(table.column("ctx").to_pylist())
    size = x["l"].astype(np.int64) + x["r"]
    start = np.cumsum(size) - size
    order = np.lexsort((x["p"], x["c"], x["h"]))
    y = x[order]
    keep = np.concatenate([[True], (y["h"][1:] != y["h"][:-1]) | (y["c"][1:] != y["c"][:-1]) | (y["p"][1:] != y["p"][:-1])])
    order, y = order[keep], y[keep]
    first = np.flatnonzero(np.concatenate([[True], y["h"][1:] != y["h"][:-1]]))
    for s, e in zip(first.tolist(), [*first[1:].tolist(), len(y)], strict=True):
        if e - s > 1:
            yield y[s:e], [whole[a : a + n] for a, n in zip(start[order[s:e]].tolist(), size[order[s:e]].tolist(), strict=True)]


def merged(c: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans by class, with those that touch joined."""
    order = np.lexsort((e, s, c))
    c, s, e = c[order], s[order], e[order]
    out_c, out_s, out_e = [], [], []
    for k, a, b in zip(c.tolist(), s.tolist(), e.tolist(), strict=True):
        if out_c and out_c[-1] == k and a <= out_e[-1]:
            out_e[-1] = max(out_e[-1], b)
        else:
            out_c.append(k)
            out_s.append(a)
            out_e.append(b)
    return np.array(out_c, np.int64), np.array(out_s, np.int64), np.array(out_e, np.int64)


def _spans(part, table):
    """Where a part's maximal repeats occur."""
    c, s, e = [], [], []
    for x, ctx in _buckets(table):
        if len(ctx) == 2:
            # the tree of two suffixes: one interval, one group
            (n, m), (a, b) = x["l"].tolist(), ctx
            left, right = _common(a[:n][::-1], b[:m][::-1]), _common(a[n:], b[m:])
            if left + right >= LENGTH:
                c.append(x["c"])
                s.append(x["p"].astype(np.int64) - left)
                e.append(x["p"].astype(np.int64) + right)
            continue
        entries, own = forms(x, ctx)
        who, left, right = reach(entries)
        size = np.array([len(o) for o in own])
        first = np.cumsum(size) - size
        n = size[who]
        at = np.repeat(first[who] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        i = np.fromiter((k for o in own for k in o), np.int64, size.sum())[at]
        c.append(x["c"][i])
        s.append(x["p"][i].astype(np.int64) - np.repeat(left, n))
        e.append(x["p"][i].astype(np.int64) + np.repeat(right, n))
    if c:
        c, s, e = merged(np.concatenate(c), np.concatenate(s), np.concatenate(e))
        if len(c):
            yield record(cls=c, s=s, e=e)


def _groups(part, table):
    for x, ctx in _buckets(table):
        for left, right, members in bucket(x, ctx):
            i = members[0]
            name = hashlib.sha256(ctx[i][int(x["l"][i]) - left : int(x["l"][i]) + right]).hexdigest()
            yield record(repeat=[name] * len(members), length=np.full(len(members), left + right), cls=x["c"][members], start=x["p"][members].astype(np.int64) - left)


def _classed(docs: DataFrame, text: str) -> DataFrame:
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.xxhash64(whole).alias("cls"), whole.alias("text"))


def _located(ws: Workspace, docs: DataFrame, fn, schema: str) -> DataFrame:
    spark = docs.sparkSession
    parts = n_parts(spark)
    counts = docs.mapInArrow(_count_anchors(parts), "part int, blob binary")
    several = ws.stage(by_part(counts, _several, "h long"), "anchors")
    wanted = spark.sparkContext.broadcast(bitmap(several))
    found = docs.mapInArrow(_contexts(parts, wanted), "part int, blob binary, ctx binary")
    return by_part(found, fn, schema)


def repeat_groups(spark, docs: DataFrame, text: str = "text") -> DataFrame:
    """(repeat, length, cls, start): all occurrences of the maximal repeats of LENGTH bytes or more among distinct texts; repeat is the sha256 of the passage as far as the context reaches, cls is xxhash64 of the text it is in."""
    ws = Workspace(spark, "repeats")
    return ws.stage(_located(ws, _classed(docs, text), _groups, "repeat string, length long, cls long, start long").distinct(), "groups")


def spans(spark, docs: DataFrame, text: str = "text") -> DataFrame:
    """(cls, spans): for each distinct text with repeats, the runs of bytes that repeats cover, in order."""
    ws = Workspace(spark, "repeats")
    named = _classed(docs, text)
    found = _located(ws, named, _spans, "cls long, s long, e long")
    copies = named.select("cls", F.octet_length("text").cast("long").alias("n")).where(F.col("n") >= LENGTH)
    copies = copies.groupBy("cls").agg(F.count("*").alias("k"), F.max("n").alias("e")).where("k > 1").select("cls", F.lit(0).cast("long").alias("s"), "e")
    all_ = found.unionByName(copies).groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))
    return ws.stage(all_, "spans")


def _runs(spans_) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x in spans_ or ():
        if out and x["s"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], x["e"]))
        else:
            out.append((x["s"], x["e"]))
    return out


def _kept(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for s, e in runs:
        out.append(raw[at:s])
        at = e
    return b"".join([*out, raw[at:]])


def _with_spans(docs: DataFrame, found: DataFrame, text: str) -> DataFrame:
    found = found.select(F.col("cls").alias("__cls"), F.col("spans").alias("__spans"))
    return docs.join(found, F.xxhash64(F.coalesce(docs[f"`{text}`"], F.lit(""))) == found["__cls"], "left")


def remove_repeats(spark, docs: DataFrame, text: str = "text", size: str | None = "n_chars") -> DataFrame:
    """docs with the repeated bytes taken out of the text and, where there is such a column, its number of characters anew. A character that a run holds only a part of is kept. Null texts stay null."""
    joined = _with_spans(docs, spans(spark, docs, text), text)

    def run(batches):
        for table in chunks(batches):
            raw, found, out = table.column(text).to_pylist(), table.column("__spans").to_pylist(), []
            for t, x in zip(raw, found, strict=True):
                if x and t is not None:
                    b, runs = t.encode(), []
                    for s, e in _runs(x):
                        while s < e and s < len(b) and b[s] & 0xC0 == 0x80:
                            s += 1
                        while e > s and e < len(b) and b[e] & 0xC0 == 0x80:
                            e -= 1
                        runs.append((s, e))
                    t = _kept(b, runs).decode()
                out.append(t)
            table = table.drop_columns(["__cls", "__spans"])
            table = table.set_column(table.schema.get_field_index(text), text, pa.array(out, pa.string()))
            if size in table.schema.names:
                n = [len(t) if x and t is not None else old for t, x, old in zip(out, found, table.column(size).to_pylist(), strict=True)]
                table = table.set_column(table.schema.get_field_index(size), size, pa.array(n, pa.int64()))
            yield from table.to_batches()

    return joined.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: what is removed from every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def run(batches):
        for table in chunks(batches):
            rows = []
            for k, t, x in zip(*(table.column(c).to_pylist() for c in ("doc_id", "text", "__spans")), strict=True):
                b, runs = (t or "").encode(), _runs(x)
                rows.append((k, len(b), sum(e - s for s, e in runs), len(runs), hashlib.sha256(_kept(b, runs)).hexdigest()))
            k, n, gone, m, sha = zip(*rows, strict=True) if rows else ((),) * 5
            yield record(doc_id=pa.array(k, pa.int64()), n_bytes=pa.array(n, pa.int64()), n_removed=pa.array(gone, pa.int64()), n_spans=pa.array(m, pa.int64()), kept_sha256=pa.array(sha, pa.string()))

    joined = _with_spans(docs, spans(spark, docs), "text")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
