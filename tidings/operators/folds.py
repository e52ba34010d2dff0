"""Order-dependent decisions, folded over each key's rows in order."""

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.functions.similarity import word_similarity_of


@dataclass
class Bucket:
    """Kept rows (place, id, time) of one stretch of time as wide as the window. They lie within the window of each other, so all have one owner, or the later would be duplicates."""

    owner: Any
    rows: list = field(default_factory=list)

    def __post_init__(self):
        self.low, self.high = min((t for _, _, t in self.rows), default=None), max((t for _, _, t in self.rows), default=None)

    def add(self, place: int, id_: Any, at: float) -> None:
        self.rows.append((place, id_, at))
        self.low, self.high = (at, at) if self.low is None else (min(self.low, at), max(self.high, at))


class Kept:
    """The kept rows of one key, by time bucket: a row looks at its own bucket and its neighbours only."""

    def __init__(self, window: float, n: int = 0):
        self.window, self.n = max(window, 1), n
        self.buckets: dict[int, Bucket] = {}
        self.changed: set[int] = set()

    def original(self, at: float, owner: Any, window: float) -> Any:
        """The first kept row of another owner within the window."""
        best, here = None, int(at // self.window)
        for k in (here - 1, here, here + 1):
            b = self.buckets.get(k)
            if b is None or b.owner == owner or at - b.high > window or b.low - at > window:
                continue
            first = next((r for r in b.rows if abs(at - r[2]) <= window), None)
            best = first if best is None or first is not None and first[0] < best[0] else best
        return None if best is None else best[1]

    def add(self, id_: Any, at: float, owner: Any) -> None:
        k = int(at // self.window)
        self.buckets.setdefault(k, Bucket(owner)).add(self.n, id_, at)
        self.changed.add(k)
        self.n += 1


def greedy_window(rows: Iterable[tuple[Any, float, Any, bool]], window: float, kept: Kept | None = None) -> list[tuple[Any, Any]]:
    """(id, original or None) for rows (id, time, owner, confident) in order. A confident row is a duplicate of the earliest kept confident row within the window that another owner has; every other row is kept. Rows without a time are kept and are no originals; no owner is an owner of its own. `kept` carries the confident rows that were kept between calls; others can be no original."""
    kept = Kept(window) if kept is None else kept
    out = []
    for id_, at, owner, confident in rows:
        owner = owner if owner == owner else None
        timed = confident and at is not None and at == at
        hit = kept.original(at, owner, window) if timed else None
        if hit is None and timed:
            kept.add(id_, at, owner)
        out.append((id_, hit))
    return out


def dedup_in_windows(df: DataFrame, keys: list[str], id_: str, time: str, owner: str, confident: str, seconds: int) -> DataFrame:
    """(keys, id, original_id): greedy window dedup of each key's rows in id order. Only the columns of the decision travel. Within a key, chains cannot be cut because each decision depends on the ones before, except at gaps wider than the window: rows are dealt out and folded by (key, stretch without such a gap)."""
    from pyspark.sql import Window as W

    at = F.unix_micros(F.col(time).cast("timestamp"))
    gap = at - F.lag(at).over(W.partitionBy(*keys).orderBy(at, id_)) > seconds * 1_000_000
    stretch = F.sum(F.coalesce(gap.cast("int"), F.lit(0))).over(W.partitionBy(*keys).orderBy(at, id_).rowsBetween(W.unboundedPreceding, 0))
    x = df.select(*keys, id_, F.col(owner).alias("_o"), F.col(confident).alias("_c"), at.alias("_t"), stretch.alias("_s"))
    kinds = dict(df.dtypes)

    def fold(batches):
        # rows come sorted, so one pass keeps the state of the current stretch only
        now, kept = None, []
        for pdf in batches:
            hits = []
            for row in pdf[[*keys, "_s", id_, "_t", "_o", "_c"]].itertuples(index=False, name=None):
                if row[:-4] != now:
                    now, kept = row[:-4], Kept(seconds * 1_000_000)
                hits += greedy_window([row[-4:]], seconds * 1_000_000, kept)
            out = pdf[[*keys, id_]].copy()
            out["original_id"] = pd.array([h for _, h in hits], dtype="Int64")
            yield out

    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, id_]) + ", original_id long"
    return x.repartition(*keys, "_s").sortWithinPartitions(*keys, "_s", id_).mapInPandas(fold, schema)


@lru_cache(1 << 16)
def _alike_memo(a: str, b: str) -> float:
    return word_similarity_of(a, b) or 0.0


def _alike(a: str | None, b: str | None) -> float:
    """Word similarity, kept by a worker over blocks for texts of 1,000 characters at most together, which bounds the memo."""
    if a is None or b is None:
        return 0.0
    return _alike_memo(a, b) if len(a) + len(b) <= 1000 else word_similarity_of(a, b) or 0.0


def sequential_near_copies(rows: list[tuple[int, str, float]], threshold: float, window: float) -> dict[int, int]:
    """Exact form of near-copy marking for one block of rows (id, text, time) in id order: each row looks at the best other row within the window that is not marked (word similarity of the stored text in the new one, ties to the lower id); if that passes and has the lower id, the row is its duplicate.

    Texts are compared once however many rows bear them; a text's rows that are not marked wait in id order, of which the first within the window is taken."""
    rows = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or "", r[2]))  # of one id the last row decides
    waiting: dict[str, list] = {}
    texts: dict[int, set] = {}
    for id_, text, at in rows:
        waiting.setdefault(text, []).append((id_, at))
        texts.setdefault(id_, set()).add(text)
    near: dict[str, list] = {}
    marked: dict[int, int] = {}
    for id_, text, at in rows:
        if text not in near:
            scored = ((_alike(t, text), t) for t in waiting)
            near[text] = sorted(((s, t) for s, t in scored if s >= threshold), key=lambda x: -x[0])
        best = None
        for score, t in near[text]:
            if best is not None and score < best[0]:
                break
            first = next((k for k, s in waiting[t] if k != id_ and abs(s - at) <= window), None)
            if first is not None and (best is None or first < best[1]):
                best = score, first
        if best is not None and best[1] < id_:
            marked[id_] = best[1]
            for t in texts.pop(id_, ()):
                waiting[t] = [r for r in waiting[t] if r[0] != id_]
    return marked


def near_copies_in_windows(df: DataFrame, key: str, id_: str, text: str, time: str, threshold: float, seconds: int) -> DataFrame:
    """(id, original): near-copy marking of each key's rows in id order. A key's rows are cut exactly at time gaps wider than the window, as no row looks across one; rows that repeat an id are marked together, so no cut parts them."""
    from pyspark.sql import Window as W

    at = F.unix_micros(F.col(time).cast("timestamp"))
    x = df.select(F.col(key).alias("_k"), F.col(id_).alias("id"), F.col(text).alias("_x"), at.alias("_t"))
    x = x.withColumn("_last", F.max("_t").over(W.partitionBy("_k", "id")))
    order = W.partitionBy("_k").orderBy("_t", "id")
    gap = F.col("_t") - F.max("_last").over(order.rowsBetween(W.unboundedPreceding, -1)) > seconds * 1_000_000
    x = x.withColumn("_g", F.coalesce(gap.cast("int"), F.lit(0)))
    x = x.withColumn("_s", F.sum("_g").over(order.rowsBetween(W.unboundedPreceding, 0)))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        got = sequential_near_copies(list(zip(pdf["id"].tolist(), pdf["_x"], pdf["_t"].tolist(), strict=True)), threshold, seconds * 1e6)
        return pd.DataFrame({"id": list(got), "original": list(got.values())}, dtype="int64")

    return x.select("_k", "_s", "id", "_x", "_t").groupBy("_k", "_s").applyInPandas(fold, "id long, original long")


def lockout(events: DataFrame, keys: list[str], time: str, ok: str, order: str, limit: int = 3, seconds: int = 300) -> DataFrame:
    """(keys, order, failures, locked): consecutive failures of a key before each attempt counts, and whether the attempt falls within a lock that `limit` failures set; a lock that ends, or a success, starts the count anew. Attempts during a lock count for nothing; those without a time come first and set no lock. A key's attempts pass one task in order, as a stream: each decision depends on the one before."""
    kinds = dict(events.dtypes)
    x = events.select(*keys, order, F.unix_micros(F.col(time).cast("timestamp")).alias("_t"), F.coalesce(ok, F.lit(False)).alias("_ok"))

    def fold(batches):
        now, failures, until = None, 0, None
        for pdf in batches:
            out = []
            for *key, _, at, good in pdf[[*keys, order, "_t", "_ok"]].itertuples(index=False, name=None):
                if key != now:
                    now, failures, until = key, 0, None
                if until is not None and at >= until:
                    failures, until = 0, None
                locked = until is not None
                if not locked:
                    failures = 0 if good else failures + 1
                    if failures >= limit and at == at:
                        until = at + seconds * 1_000_000
                out.append((failures, locked))
            got = pdf[[*keys, order]].copy()
            got["failures"], got["locked"] = [f for f, _ in out], [x for _, x in out]
            yield got

    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, order]) + ", failures long, locked boolean"
    return x.repartition(*keys).sortWithinPartitions(*keys, "_t", order).mapInPandas(fold, schema)
