"""From matched messages to incidents: fast and full materialization, the check after late details, alerts to the second fact."""

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidings.functions.text import fold_alert
from tidings.operators.names import ALIASES, match_places, named_in
from tidings.operators.resolution import folded_alert_kind
from tidings.sources.shared import run_folder

# Statuses that count as a match, the surer one first; codes that belong to the second fact; reasons.
MATCHED = ("matched", "matched_low_confidence")
SECOND_FACT = (35, 36, 38)
NO_CONDITION, ROUTED, NO_PLACE = "unmatched_condition", "second_fact", "no_place"
SAME_HASH = "exact_hash"


def reason(condition: Column, status: Column, places: Column) -> Column:
    """Why a message can never become an incident; null if it can. places: list of structs (id, status)."""
    usable = F.exists(places, lambda p: p["status"].isin(*MATCHED) & p["id"].isNotNull())
    return (
        F.when(~F.coalesce(status.isin(*MATCHED), F.lit(False)) | condition.isNull(), NO_CONDITION)
        .when(condition.isin(*SECOND_FACT), ROUTED)
        .when(~F.coalesce(usable, F.lit(False)), NO_PLACE)
    )


def _stretches(df: DataFrame, keys: list[str], at: str, order: list[str], far: Column) -> DataFrame:
    """df with a stretch number: a key's rows in time order, cut where the row before is too far for any decision to look across."""
    w = W.partitionBy(*keys).orderBy(at, *order)
    cut = F.coalesce(far.cast("int"), F.lit(0))
    return df.withColumn("_cut", cut).withColumn("_s", F.sum("_cut").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_cut")


def fast_decisions(rows: DataFrame, keys: list[str], id_: str, at: str, sure: str, hash_: str, seconds: int) -> DataFrame:
    """(keys, id, outcome, original) of a message's place and action, in id order: a sure row is a `duplicate` of the first incident of the same keys within the window that another message made; else its hash may exist (`same_hash`); else it is `inserted`. Hashes must differ between days. A key's rows are cut at gaps wider than the window between two days and each stretch is folded in one pass."""
    t, window = F.unix_micros(F.col(at).cast("timestamp")), seconds * 1_000_000
    x = rows.select(*keys, F.col(id_), t.alias("_t"), F.col(sure).alias("_sure"), F.col(hash_).alias("_h"))
    before = F.lag("_t").over(W.partitionBy(*keys).orderBy("_t", id_))
    day = 86_400_000_000
    x = _stretches(x, keys, "_t", [id_], (F.col("_t") - before > window) & (F.floor(F.col("_t") / day) != F.floor(before / day)))
    kinds = dict(rows.dtypes)

    def fold(batches):
        now, seen, hashes = None, [], set()
        for pdf in batches:
            outcomes, originals = [], []
            for row in pdf[[*keys, "_s", id_, "_t", "_sure", "_h"]].itertuples(index=False, name=None):
                (*key, k, at_, sure_, h) = row
                if key != now:
                    now, seen, hashes = key, [], set()
                hit = None
                if sure_:
                    lo, hi = bisect_left(seen, (at_ - window,)), bisect_left(seen, (at_ + window + 1,))
                    hit = min(((n, o) for _, n, o in seen[lo:hi] if o != k), default=(0, None))[1]
                outcomes.append("duplicate" if hit is not None else "same_hash" if h in hashes else "inserted")
                originals.append(hit)
                if outcomes[-1] == "inserted":
                    hashes.add(h)
                    insort(seen, (at_, len(seen), k))
            out = pdf[[*keys, id_]].copy()
            out["outcome"], out["original"] = outcomes, pd.array(originals, dtype="Int64")
            yield out

    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, id_]) + ", outcome string, original long"
    return x.repartition(*keys, "_s").sortWithinPartitions(*keys, "_s", id_).mapInPandas(fold, schema)


def fast_materialize(messages: DataFrame, id_: str, at: str, condition: str, status: str, places: str, text_hash: Column, seconds: int = 7200) -> DataFrame:
    """(id, status, reason, duplicate_of, n_inserted) for each message: one incident for each usable place. A message all of whose places are duplicates becomes a duplicate itself, one without any incident an error with its reason. text_hash may use the column `place`. A place that a message names twice counts once; a message without a time is an error."""
    why = F.coalesce(reason(F.col(condition), F.col(status), F.col(places)), F.when(F.col(at).isNull(), "no_time"))
    m = messages.select(id_, at, condition, status, places, *[c for c in messages.columns if c not in (id_, at, condition, status, places)]).withColumn("_why", why)
    usable = F.filter(F.array_distinct(places), lambda p: p["status"].isin(*MATCHED) & p["id"].isNotNull())
    one = m.where("_why is null").withColumn("_p", F.explode(usable)).withColumn("place", F.col("_p.id"))
    sure = (F.col(status) == MATCHED[0]) & (F.col("_p.status") == MATCHED[0])
    one = one.select(id_, at, "place", F.col(condition).alias("action"), sure.alias("_sure"), text_hash.alias("_h"))
    one = one.groupBy(id_, at, "place", "action", "_h").agg(F.max("_sure").alias("_sure"))
    got = fast_decisions(one, ["place", "action"], id_, at, "_sure", "_h", seconds)
    n = got.groupBy(id_).agg(
        F.count_if(F.col("outcome") == "inserted").alias("n_inserted"),
        F.count_if(F.col("outcome") == "same_hash").alias("_same"),
        F.max_by("original", F.when(F.col("outcome") == "duplicate", F.col("place"))).alias("_original"),
    )
    x = m.select(id_, "_why").join(n, id_, "left")
    whole = (F.col("n_inserted") == 0) & (F.col("_same") == 0)
    return x.select(
        id_,
        F.when(F.col("_why").isNotNull(), "error").when(F.col("n_inserted") > 0, "parsed").when(whole, "duplicate").otherwise("error").alias("status"),
        F.when(F.col("_why").isNotNull(), F.col("_why")).when((F.col("n_inserted") == 0) & (F.col("_same") > 0), SAME_HASH).alias("reason"),
        F.when(whole, F.col("_original")).alias("duplicate_of"),
        F.coalesce("n_inserted", F.lit(0)).cast("long").alias("n_inserted"),
    )


def scored_decisions(rows: DataFrame, key: str, id_: str, day: str, action: str, vector: str, settled: str | None = None, hash_: str | None = None, days: int = 3, high: float = 0.80, low: float = 0.50) -> DataFrame:
    """(key, id, outcome, original, score): each place's rows in id order against the incidents of the place so far within so many days. The best score (0.35 same action, 0.45 cosine, 0.20 closeness in days; ties to the first) decides: `merged` into that incident and no incident itself, `flagged`, or `inserted`; a row whose hash exists is `same_hash`. Rows that are settled come first and are incidents as they are. A row without a vector, or with one of another length or of norm 0, has cosine 0; without a vector it is neither compared nor found. Stretches end at gaps wider than the window; only incidents of the window's days are compared."""
    x = rows.select(F.col(key), F.col(id_), F.col(day).cast("long").alias("_d"), F.col(action).alias("_a"), F.col(vector).cast("array<double>").alias("_v"), (F.col(settled) if settled else F.lit(False)).alias("_set"), (F.col(hash_) if hash_ else F.lit(None).cast("string")).alias("_h"))
    before = F.lag("_d").over(W.partitionBy(key).orderBy("_d", id_))
    x = _stretches(x, [key], "_d", [id_], F.col("_d") - before > days)
    kinds = dict(rows.dtypes)

    def cosine(a, na, b, nb):
        return float(a @ b) / (na * nb) if len(a) == len(b) and na and nb else 0.0

    def fold(batches):
        now, by_day, hashes = None, {}, set()
        for pdf in batches:
            outcomes = []
            for row in pdf[[key, "_s", id_, "_d", "_a", "_v", "_set", "_h"]].itertuples(index=False, name=None):
                *place, k, d, a, v, fixed, h = row
                if place != now:
                    now, by_day, hashes = place, {}, set()
                v = None if v is None else np.asarray(v, dtype="float64")
                norm = 0.0 if v is None else float(np.sqrt(v @ v))
                best = (0.0, 0, None)
                if v is not None and not fixed:
                    for e in range(d - days, d + days + 1):
                        near = 0.20 * max(0.0, 1 - abs(e - d) / days)
                        for n, k2, a2, v2, norm2 in by_day.get(e, ()):
                            best = max(best, (0.35 * (a == a2) + 0.45 * cosine(v, norm, v2, norm2) + near, -n, k2), key=lambda b: b[:2])
                score, _, other = best
                if other is not None and score >= high:
                    outcomes.append(("merged", other, score))
                    continue
                if h is not None and h in hashes:
                    outcomes.append(("same_hash", None, None))
                    continue
                outcomes.append(("flagged", other, score) if other is not None and score >= low else ("inserted", None, None))
                hashes.add(h)
                if v is not None:
                    by_day.setdefault(d, []).append((1 + sum(map(len, by_day.values())), k, a, v, norm))
            out = pdf[[key, id_]].copy()
            out["outcome"] = [o for o, _, _ in outcomes]
            out["original"] = pd.array([o for _, o, _ in outcomes], dtype="Int64")
            out["score"] = pd.array([s for _, _, s in outcomes], dtype="Float64")
            yield out

    schema = f"{key} {kinds[key]}, {id_} {kinds[id_]}, outcome string, original long, score double"
    return x.repartition(key, "_s").sortWithinPartitions(key, "_s", F.desc("_set"), id_).mapInPandas(fold, schema)


def merged(decisions: DataFrame, rows: DataFrame, key: str, id_: str, fields: list[str]) -> DataFrame:
    """(key, id, fields, n_messages, flagged) for each incident: every field the largest value that is not null of the row itself and of what was merged into it."""
    x = decisions.where("outcome <> 'same_hash'").join(rows.select(key, id_, *fields), [key, id_])
    x = x.withColumn("_to", F.when(F.col("outcome") == "merged", F.col("original")).otherwise(F.col(id_)))
    got = x.groupBy(key, "_to").agg(*(F.max(f).alias(f) for f in fields), F.count("*").alias("n_messages"), F.bool_or(F.col("outcome") == "flagged").alias("flagged"))
    return got.withColumnRenamed("_to", id_)


def said_regions(messages: DataFrame, id_: str, text: str, places: DataFrame, region: str) -> DataFrame:
    """(id, _n, _one): how many regions a text names (of four characters at least, in any case), and the first of them; texts that name none are left out."""
    known = places.select(F.col(region).alias("_region"), F.lower(region).alias("_low")).where(F.length("_low") >= 4).distinct()
    return named_in(messages, id_, F.lower(text), known, "_low").groupBy(id_).agg(F.count_distinct("_region").alias("_n"), F.min("_region").alias("_one"))


def region_label() -> Column:
    """`Multiple regions`, or the one that was said, or the place's own (_n, _one, _own)."""
    return F.when(F.col("_n") > 1, "Multiple regions").otherwise(F.coalesce("_one", "_own"))


def route_alerts(messages: DataFrame, id_: str, text: str, at: str, places: DataFrame, place_id: str, local: list[str], latin: list[str], region: str, zone: str, code: str | None = None, aliases=ALIASES, after: str | None = None) -> DataFrame:
    """(id, status, reason, kind, place_id, how, region, month, day, clock) for each message: alert kind, then its place by match_places(). Without either it is rejected, else it goes to the second fact with local time and a region: the one region whose name (of four characters at least, in any case) the text holds, `Multiple regions` if it holds more, the place's own if none. Ids of messages and places are unique."""
    spark = messages.sparkSession
    m = messages.select(id_, at, text, fold_alert(F.col(text)).alias("_folded")).withColumn("kind", folded_alert_kind(F.col("_folded")))
    # folding is most of the work and its result is read thrice, so it is written
    path = f"{run_folder(spark, 'alerts')}/messages"
    m.write.parquet(path)
    m = spark.read.schema(m.schema).parquet(path)
    alerts = m.where("kind is not null")
    place = match_places(alerts, id_, F.col(text), places, place_id, place_id, local, latin, code, aliases, after=after, folded=None if after else F.col("_folded"))
    own = places.select(F.col(place_id).cast("long").alias("place_id"), F.col(region).alias("_own"))
    said = said_regions(alerts, id_, text, places, region)
    local_time = F.from_utc_timestamp(at, zone)
    ok = F.col("place_id").isNotNull()
    x = m.join(place.join(own, "place_id", "left"), id_, "left").join(said, id_, "left")
    return x.select(
        id_,
        F.when(ok, "routed").otherwise("rejected").alias("status"),
        F.when(F.col("kind").isNull(), "no alert word").when(~ok, "no place").alias("reason"),
        "kind",
        "place_id",
        "how",
        F.when(ok, region_label()).alias("region"),
        F.when(ok, F.date_format(local_time, "MMMM")).alias("month"),
        F.when(ok, F.date_format(local_time, "yyyy-MM-dd")).alias("day"),
        F.when(ok, F.date_format(local_time, "HH:mm")).alias("clock"),
    )
