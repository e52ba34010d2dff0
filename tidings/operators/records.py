"""Uniqueness, dimensions, upserts, soft deletes and change logs: state as tables, never updates."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def unique(rows: DataFrame, keys: list[str], order: list[Column], existing: DataFrame | None = None) -> DataFrame:
    """The first row of each key that does not exist yet. A null in a key never collides, so such rows all stay."""
    if existing is not None:
        rows = rows.join(existing.select(*keys).distinct(), keys, "left_anti")
    whole = rows.dropna(subset=keys)
    loose = rows.where(" or ".join(f"{k} is null" for k in keys))
    first = whole.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    return first.unionByName(loose)


def get_or_create(dim: DataFrame, id_: str, keys: list[str], wanted: DataFrame) -> DataFrame:
    """dim with a row for each new key combination that is not null or blank, numbered on from the largest id in key order."""
    new = wanted.select(*keys).dropna().where(" and ".join(f"{k} <> ''" for k in keys)).distinct().join(dim, keys, "left_anti")
    top = dim.agg(F.coalesce(F.max(id_), F.lit(0)).alias("_top"))
    numbered = new.withColumn(id_, F.row_number().over(W.orderBy(*keys)))
    return dim.select(id_, *keys).unionByName(numbered.join(top).select((F.col(id_) + F.col("_top")).cast(dim.schema[id_].dataType).alias(id_), *keys))


def latest(rows: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The newest version of each key: an upsert that overwrites all fields."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_r"))
    return picked.select(*keys, "_r.*")


def live(rows: DataFrame, tombstones: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that no tombstone names."""
    return rows.join(tombstones.select(*keys).distinct(), keys, "left_anti")


def diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, field, old_value, new_value) of every field that changed, null-safely."""
    fields = [c for c in new.columns if c != key]
    o = old.select(key, F.explode(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(F.col(c).cast("string") for c in fields)))).alias("field", "old_value"))
    n = new.select(key, F.explode(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(F.col(c).cast("string") for c in fields)))).alias("field", "new_value"))
    return n.join(o, [key, "field"], "left").where(~F.col("old_value").eqNullSafe(F.col("new_value"))).select(key, "field", "old_value", "new_value")


def missing(requested: DataFrame, found: DataFrame, key: str) -> list:
    """Requested keys that were not found, for an error message; at most 100 are named."""
    return [r[0] for r in requested.select(key).exceptAll(found.select(key)).orderBy(key).limit(100).collect()]
