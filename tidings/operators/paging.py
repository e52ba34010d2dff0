"""Bounded and ordered reads: keyset pages, restricted reads, caps of a stage, sorts by any column."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyset(df: DataFrame, id_: str, after, n: int) -> DataFrame:
    """The n rows after a cursor in id order. The filter reaches the scan and the limit is taken in each task first."""
    return df.where(F.col(id_) > F.lit(after)).orderBy(id_).limit(n)


def restrict(df: DataFrame, id_: str, time: str, after_id=None, since: str | None = None) -> DataFrame:
    """Only rows above an id or, where no id is given, from an event time on; rows without that value are left out; without either all rows."""
    if after_id is not None:
        return df.where(F.col(id_) > F.lit(after_id))
    return df if since is None else df.where(F.col(time) >= F.lit(since).cast("timestamp"))


def capped(df: DataFrame, id_: str, asked: int | None, default: int) -> DataFrame:
    """At most so many of the oldest rows for one run of a stage: what is asked for, or the default. The rest waits for the next run."""
    return df.orderBy(id_).limit(default if asked is None else min(asked, default))


LOCALE = "UNICODE_CI"  # the root order of all scripts, without regard to case; a language's own as in "sv_CI"


def sort_key(df: DataFrame, column: str, descending: bool = False, locale: str | None = None) -> Column:
    """The order of a table by any column: numbers and times by value, strings without regard to case, by code points or in the order of a locale's letters, nulls last."""
    c = F.col(column) if dict(df.dtypes)[column] != "string" else F.collate(column, locale) if locale else F.lower(column)
    return c.desc_nulls_last() if descending else c.asc_nulls_last()


def flag_state(events: DataFrame, keys: list[str], time: str, order: str, on: Column) -> DataFrame:
    """(keys, flag, set_at, cleared_at): each key's flag after its latest event; set_at is that event's time if the flag is on, cleared_at if it is off."""
    last = events.withColumn("_on", on).groupBy(*keys).agg(F.max_by(F.struct(F.col(time).alias("at"), F.col("_on").alias("flag")), F.struct(time, order)).alias("x"))
    flag, at = F.col("x.flag"), F.col("x.at")
    return last.select(*keys, flag.alias("flag"), F.when(flag, at).alias("set_at"), F.when(~flag, at).alias("cleared_at"))


def resolve_names(rows: DataFrame, name: str, dim: DataFrame, dim_name: str, dim_id: str, out: str, locale: str | None = None) -> DataFrame:
    """rows with the id of the entry whose name is theirs but for case (by code points, or as a locale compares) and outer blanks, least id first; null where there is none."""
    key = (lambda c: F.collate(F.trim(c), locale)) if locale else (lambda c: F.lower(F.trim(c)))
    ids = dim.groupBy(key(dim_name).alias("_n")).agg(F.min(dim_id).alias(out))
    return rows.join(ids, key(name) == ids["_n"], "left").drop("_n")


def failures_since_success(events: DataFrame, keys: list[str], order: str, ok: str) -> DataFrame:
    """(keys, failures): how many attempts failed after a key's last success. Two partial aggregates, no window over a key's whole history."""
    last = events.groupBy(*keys).agg(F.max(F.when(F.col(ok), F.col(order))).alias("_last"))
    late = events.where(~F.col(ok)).join(last, keys).where(F.col("_last").isNull() | (F.col(order) > F.col("_last")))
    return last.join(late.groupBy(*keys).agg(F.count("*").alias("failures")), keys, "left").select(*keys, F.coalesce("failures", F.lit(0)).cast("long").alias("failures"))
