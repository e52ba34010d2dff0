"""N-gram Jaccard self-join by vertical partitioning, and the groups that its links make.

A document is the set of its distinct word 5-grams; equal sets are one class, so copies never meet each other. All n-grams
have one global order: those that a single class holds, then those that several hold, by hash, then the HEAVY most frequent
ones by count, the most frequent last. Two sets with Jaccard similarity t or more share an n-gram in their first
n - ceil(t n) + 1 of that order (prefix). N-grams of a single class take places there but match nothing, so a set with more
than a fifth of such n-grams is done at once; the prefixes of the others find the candidate pairs.

The global order is cut into FRAGMENTS pieces, and a wanted class has one segment in each. Pairs meet the segments of their
two ends by equi-joins on class and fragment; a segment join counts the partial overlap of its fragment only, and the
partial counts are summed for each pair and held against the threshold. No task holds all pairs, or all of a long text.

A prefix n-gram that up to SMALL classes share yields all their pairs. Larger groups are kept as rows; n-grams known to be
in more than HOT classes are dealt by class from the start, so no task gathers one. Each class of such a group is first
paired with the least class of its size range and of the range below (a partial aggregate). Then the groups that still lie
in several components are cut into blocks of about BLOCK members: within blocks, pairs that parity maps of the sets call
likely are tried, one for each two components that would join, until a turn finds few; last, every two blocks of a group meet in a task of their own
and give all pairs of different components whose sizes, places and parity maps allow a link. So a group of near copies costs
a number of pairs in proportion to its size, and no link between components is lost: what is left out lies within one.
Pairs, segments and labels stay in tables; the driver sees the HEAVY list and bit maps of bounded size (128 MB at most),
which only steer the search: where they are full, more sets are compared and the result is the same.

Edge cases: null and blank texts have no n-grams and link with nothing; texts of fewer than five words are one n-gram; very
long texts are whole sets, whose segments are rows of their own; rows with a null doc_id take no part and get a null
component; rows that share a doc_id are judged by their texts; ties of counts are ordered by hash; extra columns are ignored
by the query and kept by the stage, whose working names start with two underscores; an empty table gives an empty result.
Sets are told apart by 64-bit hashes.
"""

from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.llm.kernels import mix, shingles
from tidings.llm.work import Workspace, bitmap, by_part, chunks, components, joined_components, n_parts, packed, record, unpacked

HEAVY = 1 << 17
HOT = 4096
SMALL = 16
BLOCK = 1024
FRAGMENTS = 8
BITS = 512
MAP_BITS = 30  # the bit map of n-grams in several classes has 2 ** MAP_BITS bits at most
UNIT = 4  # chunks whose n-grams are counted or dealt together
_MORE = np.dtype([("r", "<u4"), ("n", "<u4")])
_PREFIX = np.dtype([("t", "<u8"), ("c", "<i8"), ("n", "<i4"), ("p", "<i4")])
_PAIR = np.dtype([("a", "<i8"), ("b", "<i8"), ("na", "<i4"), ("nb", "<i4")])
_MEMBER = np.dtype([("t", "<i8"), ("g", "<i4"), ("blk", "<i4"), ("oth", "<i4"), ("c", "<i8"), ("n", "<i4"), ("p", "<i4"), ("k", "<i4"), ("l", "<i8")])
_PAIRS = "a long, b long, na int, nb int"


def class_of(grams: np.ndarray) -> int:
    """A set's class: a hash of its members and size."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(grams ^ np.uint64(0x5851F42D4C957F2D)).sum() + np.uint64(len(grams))], np.uint64)).view(np.int64)[0])


def parity(grams: np.ndarray) -> np.ndarray:
    """A set's parity map: BITS bits, each flipped by the members that hash to it. Two maps differ in no more bits than the sets have members that are not shared."""
    n = np.bincount((mix(grams ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64), minlength=BITS)
    return np.packbits((n & 1).astype(bool)).view(np.int64)


def _part_of(values: np.ndarray, parts: int) -> np.ndarray:
    return (mix(values + np.uint64(77)) % np.uint64(parts)).astype(np.int32)


def _units(batches):
    """Lists of UNIT chunks."""
    held = []
    for table in chunks(batches):
        held.append(table)
        if len(held) == UNIT:
            yield held
            held = []
    if held:
        yield held


def _need(n, percent: int):
    """The least overlap of a set of n with a set that is similar enough."""
    return (percent * n + 99) // 100


def size_range(n: np.ndarray, percent: int) -> np.ndarray:
    """The number of a set's size range; similar sets lie in the same or in neighbouring ones."""
    return np.floor(np.log(n) / (log(100 / percent) + 1e-9 if percent < 100 else 1.0)).astype(np.int32)


def _first_pass(batches):
    """Each row's set size, class and parity map."""
    for table in chunks(batches):
        sets = shingles(table.column("text"))
        cls = [class_of(s) if len(s) else None for s in sets]
        maps = [parity(s) if len(s) else None for s in sets]
        yield record(doc_id=table.column("doc_id").combine_chunks(), n=pa.array([len(s) for s in sets], pa.int64()), cls=pa.array(cls, pa.int64()), map=pa.array(maps, pa.list_(pa.int64())))


def _sets_of(unit, reps) -> list[tuple[int, np.ndarray]]:
    """(class, n-grams) of a unit's rows that may stand for their class, each class once."""
    seen, out = set(), []
    for table in unit:
        table = table.filter(table.column("doc_id").is_valid())
        table = table.filter(pa.array(reps.has(table.column("doc_id").to_numpy())))
        for s in shingles(table.column("text")):
            if len(s) and (c := class_of(s)) not in seen:
                seen.add(c)
                out.append((c, s))
    return out


def _presence(reps, low: int):
    """The n-grams of a stretch of classes, dealt out by their first `low` bits; of each the next 32 bits, and how many more classes of the stretch hold it."""

    def run(batches):
        for unit in _units(batches):
            sets = _sets_of(unit, reps.value)
            if not sets:
                continue
            t, n = np.unique(np.concatenate([s for _, s in sets]), return_counts=True)
            del sets
            cut = np.searchsorted(t >> np.uint64(64 - low), np.arange((1 << low) + 1, dtype=np.uint64))
            r = (t >> np.uint64(32 - low)).astype(np.uint32)
            for part in np.flatnonzero(np.diff(cut)).tolist():
                own = slice(cut[part], cut[part + 1])
                several = n[own] > 1
                more = np.zeros(several.sum(), _MORE)
                more["r"], more["n"] = r[own][several], n[own][several] - 1
                yield record(part=np.array([part], np.int32), blob=[r[own].tobytes()], more=[more.tobytes()])

    return run


def _several(low: int, top: int):
    """Of a part: how many n-grams several classes hold, their places in the bit map, and its `top` most frequent ones."""

    def run(part, table):
        r, more = unpacked(table, np.dtype("<u4")), unpacked(table, _MORE, "more")
        r, n = np.unique(r, return_counts=True)
        n = n + np.bincount(np.searchsorted(r, more["r"]), more["n"], len(r)).astype(np.int64)
        u = (np.uint64(part) << np.uint64(32)) | r.astype(np.uint64)
        place = np.unique((u[n > 1] >> np.uint64(32 + low - MAP_BITS)).astype(np.uint32))
        high = np.flatnonzero(n > 3)
        high = high[np.lexsort((u[high], -n[high]))[:top]]
        yield record(part=np.array([part], np.int32), m=np.array([(n > 1).sum()]), place=[place.tobytes()], t=[u[high].tobytes()], n=[n[high].astype(np.int64).tobytes()])

    return run


class Order:
    """The global order of n-grams, cut into fragments: a bit map of those in several classes, and the heavy ones with their counts (known by their first bits)."""

    def __init__(self, t: np.ndarray, n: np.ndarray, shift: int, bits: int, data: np.ndarray, hot: int = HOT, fragments: int = FRAGMENTS):
        by_count = np.lexsort((t, n))
        rank = np.empty(len(t), np.int64)
        rank[by_count] = np.arange(len(t))
        by_hash = np.argsort(t)
        self.t, self.rank, self.count, self.half = t[by_hash], rank[by_hash], n[by_hash], max(1, fragments // 2)
        self.shift, self.bits, self.data, self.most = np.uint64(shift), bits, data, hot
        # heavy fragments hold about as many occurrences each
        upto = np.cumsum(n[by_count])
        self.cut = np.searchsorted(upto, upto[-1] * np.arange(1, self.half) / self.half) if len(t) else np.zeros(0, np.int64)

    def _at(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.t):
            return np.zeros(len(grams), np.int64), np.zeros(len(grams), bool)
        u = grams >> self.shift
        at = np.minimum(np.searchsorted(self.t, u), len(self.t) - 1)
        return at, self.t[at] == u

    def ranks(self, grams: np.ndarray) -> np.ndarray:
        """The heavy rank of each n-gram, or -1."""
        at, hit = self._at(grams)
        return np.where(hit, self.rank[at], -1) if len(self.t) else np.full(len(grams), -1, np.int64)

    def hot(self, grams: np.ndarray) -> np.ndarray:
        """Whether an n-gram is known to be in so many classes that no task should gather them."""
        at, hit = self._at(grams)
        return hit & (self.count[at] > self.most) if len(self.t) else np.zeros(len(grams), bool)

    def shared(self, grams: np.ndarray) -> np.ndarray:
        """Whether several classes may hold an n-gram."""
        at = (grams >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def prefix(self, grams: np.ndarray, shared: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the first `size` n-grams in the order those that are shared, and their places."""
        some = grams[shared]
        alone = len(grams) - len(some)
        rank = self.ranks(some)
        light, heavy = some[rank < 0], np.flatnonzero(rank >= 0)
        heavy = heavy[np.lexsort((some[heavy], rank[heavy]))]
        some = np.concatenate([light, some[heavy]])[: size - alone]
        return some, alone + np.arange(len(some))

    def fragment(self, grams: np.ndarray) -> np.ndarray:
        rank = self.ranks(grams)
        light = ((grams >> np.uint64(32)) * np.uint64(self.half) >> np.uint64(32)).astype(np.int32)
        return np.where(rank < 0, light, self.half + np.searchsorted(self.cut, rank, side="right")).astype(np.int32)


def global_order(ws: Workspace, docs: DataFrame, reps, heavy: int, hot: int) -> Order:
    """The order of all n-grams of the rows in reps. An exchange of four bytes for each n-gram of a class."""
    spark = docs.sparkSession
    low = min(24, n_parts(spark).bit_length() - 1)
    found = by_part(docs.mapInArrow(_presence(reps, low), "part int, blob binary, more binary"), _several(low, max(1, heavy >> low)), "part int, m long, place binary, t binary, n binary")
    found = ws.stage(found, "several")
    members = found.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    bits = min(MAP_BITS, max(low + 3, 16, (16 * members).bit_length()))

    def slices(batches):
        for batch in batches:
            for part, place in zip(batch.column("part").to_pylist(), batch.column("place").to_pylist(), strict=True):
                at = (np.frombuffer(place, "<u4") >> np.uint32(MAP_BITS - bits)).astype(np.int64) - (part << (bits - low))
                on = np.zeros(1 << (bits - low), np.uint8)
                on[at] = 1
                yield record(part=np.array([part], np.int32), on=[np.packbits(on, bitorder="little").tobytes()])

    data = np.zeros(1 << (bits - 3), np.uint8)
    for r in found.select("part", "place").mapInArrow(slices, "part int, on binary").toLocalIterator():
        data[r["part"] << (bits - low - 3) : (r["part"] + 1) << (bits - low - 3)] = np.frombuffer(r["on"], np.uint8)
    top = found.select("t", "n").collect()
    t = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["t"], np.uint64) for r in top)])
    n = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["n"], np.int64) for r in top)])
    ws.drop("several")
    return Order(t, n, 32 - low, bits, data, hot)


def _prefixes(order, reps, parts: int, percent: int):
    def run(batches):
        for unit in _units(batches):
            sets = _sets_of(unit, reps.value)
            if not sets:
                continue
            size = np.array([len(s) for _, s in sets])
            shared = order.value.shared(np.concatenate([s for _, s in sets]))
            start = np.cumsum(size) - size
            first = size - _need(size, percent) + 1
            tokens, places, own = [], [], np.flatnonzero(size - np.add.reduceat(shared, start, dtype=np.int64) < first)
            for i in own.tolist():
                t, p = order.value.prefix(sets[i][1], shared[start[i] : start[i] + size[i]], int(first[i]))
                tokens.append(t)
                places.append(p)
            if tokens:
                rows = np.zeros(sum(map(len, tokens)), _PREFIX)
                n = [len(t) for t in tokens]
                rows["t"], rows["p"] = np.concatenate(tokens), np.concatenate(places)
                rows["c"], rows["n"] = np.repeat([sets[i][0] for i in own.tolist()], n), np.repeat(size[own], n)
                # an n-gram of very many classes is spread over the parts by class
                key = np.where(order.value.hot(rows["t"]), rows["t"] ^ mix(rows["c"].view(np.uint64)), rows["t"])
                yield packed(rows, _part_of(key, parts))

    return run


def _fit(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs x, y (n of x not above n of y) can be similar enough, by their sizes and the place of the shared n-gram."""
    bound = 1 + np.minimum(x["n"] - x["p"] - 1, y["n"] - y["p"] - 1).astype(np.int64)
    return (100 * x["n"].astype(np.int64) >= percent * y["n"].astype(np.int64)) & ((100 + percent) * bound >= percent * (x["n"].astype(np.int64) + y["n"]))


def _pairs_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), _PAIR)
    out["a"], out["b"], out["na"], out["nb"] = x["c"], y["c"], x["n"], y["n"]
    back = out["a"] > out["b"]
    for one, two in (("a", "b"), ("na", "nb")):
        out[one][back], out[two][back] = out[two][back], out[one][back]
    return out


def _distinct(pairs: list[np.ndarray]) -> np.ndarray:
    x = np.concatenate(pairs) if pairs else np.zeros(0, _PAIR)
    if len(x):
        x = x[np.lexsort((x["b"], x["a"]))]
        x = x[np.concatenate([[True], (x["a"][1:] != x["a"][:-1]) | (x["b"][1:] != x["b"][:-1])])]
    return x


def _batch(pairs: np.ndarray) -> pa.RecordBatch:
    return record(**{k: pairs[k] for k in _PAIR.names})


def _candidates(order, percent: int, small: int):
    """Of a part's prefixes: the pairs of small groups, and the rows of groups that have more than `small` classes."""

    def run(part, table):
        x = unpacked(table, _PREFIX)
        if not len(x):
            return
        x = x[np.lexsort((x["c"], x["n"], x["t"]))]
        x = x[np.concatenate([[True], (x["t"][1:] != x["t"][:-1]) | (x["c"][1:] != x["c"][:-1])])]
        start = np.flatnonzero(np.concatenate([[True], x["t"][1:] != x["t"][:-1]]))
        size = np.diff(np.append(start, len(x)))
        large = np.repeat((size > small) | order.value.hot(x["t"][start]), size)
        low, out = x[~large & (np.repeat(size, size) > 1)], []
        for d in range(1, small):
            if d >= len(low):
                break
            same = np.flatnonzero(low["t"][d:] == low["t"][:-d])
            a, b = low[same], low[same + d]
            ok = _fit(a, b, percent)
            out.append(_pairs_of(a[ok], b[ok]))
        got, big = _distinct(out), x[large]
        none = lambda n, names: {k: pa.nulls(n, pa.int64() if k in "abtc" else pa.int32()) for k in names}
        names = ("t", "c", "n", "p", "k")
        if len(got):
            yield record(**{k: got[k] for k in _PAIR.names}, **none(len(got), names))
        for a in range(0, len(big), 100_000):
            y = big[a : a + 100_000]
            yield record(**none(len(y), _PAIR.names), t=y["t"].view(np.int64), c=y["c"], n=y["n"], p=y["p"], k=size_range(y["n"], percent))

    return run


def _head_pairs(ws: Workspace, big: DataFrame, percent: int) -> DataFrame:
    """Each class of a large group with the least one of its size range, and of the range below, that it can be similar to."""
    heads = big.groupBy("t", "k").agg(F.min(F.struct("n", "c", "p")).alias("h")).select("t", F.explode(F.array("k", F.col("k") + 1)).alias("k"), "h")
    heads = ws.stage(heads, "heads")
    n, p, m, q = (F.col(c).cast("long") for c in ("n", "p", "h.n", "h.p"))
    less, more = F.least(n, m), F.greatest(n, m)
    fits = (100 * less >= percent * more) & ((100 + percent) * F.least(n - p, m - q) >= percent * (n + m))
    both = big.join(heads, ["t", "k"]).where((F.col("c") != F.col("h.c")) & fits)
    first = F.col("c") < F.col("h.c")
    return both.select(F.least("c", "h.c").alias("a"), F.greatest("c", "h.c").alias("b"), F.when(first, F.col("n")).otherwise(F.col("h.n")).alias("na"), F.when(first, F.col("h.n")).otherwise(F.col("n")).alias("nb"))


def _apart(x: str, y: str) -> Column:
    """The bits in which two maps differ."""
    return F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, n: s + n)


def _may_link(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs whose parity maps allow a link."""
    both = pairs.join(maps.select(F.col("cls").alias("a"), F.col("map").alias("x")), "a").join(maps.select(F.col("cls").alias("b"), F.col("map").alias("y")), "b")
    return both.where((100 + percent) * _apart("x", "y") <= (100 - percent) * (F.col("na").cast("long") + F.col("nb"))).select("a", "b", "na", "nb")


def _members(table):
    """The cells of a part's open groups, in order of size: rows and parity maps."""
    x = np.zeros(table.num_rows, [*_MEMBER.descr, ("row", "<i8")])
    for k in _MEMBER.names:
        x[k] = table.column(k).to_numpy()
    x["row"] = np.arange(len(x))
    maps = table.column("map").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, BITS // 64)
    x = x[np.lexsort((x["c"], x["n"], x["oth"], np.minimum(x["blk"], x["oth"]), x["g"], x["t"]))]
    cell = np.stack([x["t"], x["g"], np.minimum(x["blk"], x["oth"]), np.maximum(x["blk"], x["oth"])])
    order = np.lexsort((x["c"], x["n"], *cell[::-1]))
    x, cell = x[order], cell[:, order]
    start = np.flatnonzero(np.concatenate([[True], (cell[:, 1:] != cell[:, :-1]).any(axis=0)])) if len(x) else np.zeros(0, np.int64)
    for s, e in zip(start.tolist(), [*start[1:].tolist(), len(x)], strict=True):
        yield x[s:e], maps[x["row"][s:e]]


def _near(group: np.ndarray, maps: np.ndarray, i: int, label: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The group's rows after i, of other components, that can be similar enough to row i, by sizes, places and parity maps; and whether by the maps' likely difference they are. Of two rows one is of the group's own size range, and in a cell of two blocks they are of different ones."""
    end = int(np.searchsorted(group["n"], 100 * int(group["n"][i]) // percent, side="right"))
    others = np.arange(i + 1, end)
    b = group[i + 1 : end]
    me = group[i]
    ok = (label[i + 1 : end] != label[i]) & (np.maximum(b["k"], me["k"]) == me["g"])
    if me["blk"] != me["oth"]:
        ok &= b["blk"] != me["blk"]
    others, b = others[ok], b[ok]
    ok = _fit(np.repeat(group[i : i + 1], len(b)), b, percent)
    others, b = others[ok], b[ok]
    both = me["n"].astype(np.int64) + b["n"]
    apart = np.bitwise_count(maps[others] ^ maps[i]).sum(axis=1).astype(np.int64)
    most = (100 - percent) * both  # (100 + percent) times the members that may differ
    ok = (100 + percent) * apart <= most
    # so many members that differ would flip `apart` bits on average
    likely = -0.5 * BITS * np.log(np.maximum(1 - 2 * apart / BITS, 1e-3))
    return others[ok], ((100 + percent) * likely <= most)[ok]


def _spanning(percent: int):
    """Of each block a few pairs a member that would make its likely links' components: at most one pair for each two of them that join."""

    def run(part, table):
        out = []
        for group, maps in _members(table):
            _, label = np.unique(group["l"], return_inverse=True)
            for i in range(len(group) - 1):
                others, likely = _near(group, maps, i, label, percent)
                others = others[likely]
                _, first = np.unique(label[others], return_index=True)
                if len(first):
                    others = others[first]
                    out.append(_pairs_of(np.repeat(group[i : i + 1], len(others)), group[others]))
                    label[np.isin(label, label[others])] = label[i]
        if len(got := _distinct(out)):
            yield _batch(got)

    return run


def _rest(percent: int):
    """Of two blocks: all pairs that can be similar enough and lie in different components."""

    def run(part, table):
        out, held = [], 0
        for group, maps in _members(table):
            for i in range(len(group) - 1):
                others, _ = _near(group, maps, i, group["l"], percent)
                if len(others):
                    out.append(_pairs_of(np.repeat(group[i : i + 1], len(others)), group[others]))
                    held += len(others)
                if held > 200_000:
                    yield _batch(_distinct(out))
                    out, held = [], 0
        if held:
            yield _batch(_distinct(out))

    return run


def _open(ws: Workspace, big: DataFrame, label: DataFrame, block: int, turn: int) -> DataFrame:
    """The members of the large groups that lie in several components, with the number of blocks that their group is cut into. A group is an n-gram and a size range; the range below is in it too."""
    now = big.join(label, big["c"] == label["node"], "left").select("t", "c", "n", "p", "k", F.coalesce("label", "c").alias("l"))
    now = now.withColumn("g", F.explode(F.array("k", F.col("k") + 1)))
    mixed = now.groupBy("t", "g").agg(F.min("l").alias("x"), F.max("l").alias("y"), F.max("k").alias("top"), F.count("*").alias("m")).where("x <> y and top = g")
    # written first: where it is small, the members need not be dealt by group to meet it
    mixed = ws.stage(mixed.select("t", "g", F.ceil(F.col("m") / block).cast("int").alias("blocks")), f"mixed-{turn}")
    return ws.stage(now.join(mixed, ["t", "g"]), f"open-{turn}")


def _cells(open_: DataFrame, maps: DataFrame, parts: int, turn: int, all_: bool) -> DataFrame:
    """Members dealt to their blocks, anew each turn; with all_, to the cells of every two blocks."""
    x = open_.withColumn("blk", F.pmod(F.xxhash64(F.lit(turn), "c"), F.col("blocks")).cast("int"))
    x = x.withColumn("oth", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)) if all_ else F.col("blk"))
    cell = F.xxhash64("t", "g", F.least("blk", "oth"), F.greatest("blk", "oth"))
    return x.join(maps.select(F.col("cls").alias("c"), "map"), "c").withColumn("part", F.pmod(cell, F.lit(parts)).cast("int"))


def _segments(order, reps, classes_wanted):
    """The wanted classes' n-grams by fragment: class, fragment, n-grams."""

    def run(batches):
        for table in chunks(batches):
            sets = [(c, s) for c, s in _sets_of([table], reps.value) if classes_wanted.value.has(np.array([c]))[0]]
            if not sets:
                continue
            size = [len(s) for _, s in sets]
            grams = np.concatenate([s for _, s in sets])
            of = np.repeat(np.arange(len(sets)), size) * FRAGMENTS + order.value.fragment(grams)
            by = np.argsort(of, kind="stable")
            grams, of = grams[by], of[by]
            start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            cls = np.array([c for c, _ in sets])[of[start] // FRAGMENTS]
            off = pa.py_buffer(np.append(start, len(grams)).astype(np.int32) * 8)
            blob = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, off, pa.py_buffer(grams.tobytes())])
            yield record(cls=cls, f=(of[start] % FRAGMENTS).astype(np.int32), grams=blob)

    return run


def _partial(batches):
    """Partial overlaps: of each pair of segments how many n-grams both hold."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, rows = [], []
        for name in ("ga", "gb"):
            data, off = _bytes_of(batch.column(name))
            size = np.diff(off) // 8
            row = np.repeat(np.arange(batch.num_rows), size)
            with np.errstate(over="ignore"):
                keys.append(mix(np.frombuffer(data, np.uint64) + mix(row.astype(np.uint64) + np.uint64(1))))
            rows.append(row)
        hit = np.isin(keys[0], keys[1])
        n = np.bincount(rows[0][hit], minlength=batch.num_rows)
        yield record(**{k: batch.column(k) for k in ("a", "b", "na", "nb", "f")}, overlap=n.astype(np.int64))


def _bytes_of(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """A binary column's bytes end to end, and where each row starts."""
    wide = column.cast(pa.large_binary())
    off = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    return wide.buffers()[2].slice(off[0], off[-1] - off[0]).to_pybytes(), off - off[0]


def links(ws: Workspace, pairs: DataFrame, segments: DataFrame, percent: int, name: str) -> DataFrame:
    """The pairs that are similar enough, by their overlaps in all fragments: a, b, na, nb, overlap."""
    one = segments.select(F.col("cls").alias("a"), "f", F.col("grams").alias("ga"))
    two = segments.select(F.col("cls").alias("b"), "f", F.col("grams").alias("gb"))
    met = pairs.join(one, "a").join(two, ["b", "f"]).select("a", "b", "na", "nb", "f", "ga", "gb")
    counts = met.mapInArrow(_partial, f"{_PAIRS}, f int, overlap long")
    # a class whose row comes twice has the same segment twice
    counts = counts.groupBy("a", "b", "na", "nb", "f").agg(F.max("overlap").alias("overlap"))
    total = counts.groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("overlap"))
    return ws.stage(total.where((100 + percent) * F.col("overlap") >= percent * (F.col("na").cast("long") + F.col("nb"))), name)


def join(spark, docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80, heavy: int = HEAVY, small: int = SMALL, hot: int = HOT, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows, links): for each row of docs doc_id, n_shingles, cls (its class) and component_id; and the verified links between classes that tie the components. The last four only move work about, never the result."""
    ws = Workspace(spark, "ngrams")
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    parts, sent = n_parts(spark), []

    def send(value):
        sent.append(spark.sparkContext.broadcast(value))
        return sent[-1]

    first = ws.stage(docs.mapInArrow(_first_pass, "doc_id long, n long, cls long, map array<long>"), "first")
    rows = first.select("doc_id", F.col("n").alias("n_shingles"), "cls")
    classes = first.where("cls is not null and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("map").alias("map"))
    classes = ws.stage(classes, "classes")
    reps = send(bitmap(classes.select("rep")))
    order = send(global_order(ws, docs, reps, heavy, hot))
    found = by_part(docs.mapInArrow(_prefixes(order, reps, parts, percent), "part int, blob binary"), _candidates(order, percent, small), f"{_PAIRS}, t long, c long, n int, p int, k int")
    found = ws.stage(found, "found")
    big = found.where("t is not null").select("t", "c", "n", "p", "k")
    pairs = found.where("a is not null").select("a", "b", "na", "nb").unionByName(_head_pairs(ws, big, percent)).distinct()
    tried = pairs = ws.stage(_may_link(pairs, classes, percent), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).unionByName(big.select(F.col("c").alias("cls"))).distinct()
    wanted = ws.stage(classes.join(wanted, "cls", "left_semi"), "wanted")
    some = send(bitmap(wanted.select("rep"))), send(bitmap(wanted.select("cls")))
    segments = ws.stage(docs.mapInArrow(_segments(order, *some), "cls long, f int, grams binary"), "segments")
    for b in sent:
        b.unpersist()
    linked = links(ws, pairs, segments, percent, "links")
    label = components(ws, linked, "components")
    # first pairs that make the likely components, until a turn finds few; then all that is left between components
    step, turn = _spanning, 0
    while step:
        open_ = _open(ws, big, label, block, turn)
        members = open_.count()
        if not members:
            break
        cells = _cells(open_, wanted, parts, turn, step is _rest)
        more = by_part(cells, step(percent), _PAIRS).distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti")
        more = ws.stage(more, f"more-{turn}")
        found_now = more.count()
        if found_now:
            tried = tried.unionByName(more)
            new = links(ws, more, segments, percent, f"links-{turn}")
            linked = linked.unionByName(new)
            label = joined_components(ws, label, new, f"components-{turn}")
        ws.drop(f"open-{turn}", f"mixed-{turn}")
        step, turn = None if step is _rest else _spanning if 10 * found_now > members else _rest, turn + 1
    named = classes.join(label, classes["cls"] == label["node"], "left").select("cls", "rep", F.coalesce("label", "cls").alias("l"))
    least = named.groupBy("l").agg(F.min("rep").alias("component_id"))
    named = ws.stage(named.join(least, "l").select(F.col("cls").alias("of"), "component_id"), "named")
    ws.drop("found", "segments", "wanted")
    out = rows.join(named, rows["cls"] == named["of"], "left")
    out = out.select("doc_id", "n_shingles", "cls", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out, linked


def drop_near_copies(spark, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each component's rows one with its smallest key; documents without words and rows without a key stay. If keys repeat, rows are numbered in key order first, in a written copy, and one row stays of each component of rows."""
    k = docs[f"`{key}`"].cast("long")
    if not docs.select(k.alias("k")).where("k is not null").groupBy("k").count().where("count > 1").isEmpty():
        # a random second key deals rows that repeat a key over the tasks
        numbered = docs.withColumn("__k", k).withColumn("__r", F.rand(0)).orderBy("__k", "__r")
        numbered = numbered.withColumn("__row", F.when(F.col("__k").isNotNull(), F.monotonically_increasing_id())).drop("__k", "__r")
        docs, key = Workspace(spark, "rows").stage(numbered, "numbered"), "__row"
    rows, _ = join(spark, docs, key, text)
    go = rows.where("doc_id <> component_id").select(F.col("doc_id").alias("__go"))
    return docs.join(go, docs[f"`{key}`"].cast("long") == go["__go"], "left_anti").drop("__row")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: every document's component."""
    rows, _ = join(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_shingles", "component_id")
