"""Table scans: parquet tables of a folder, JSON reference files, sheets as text, schema checks."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, or an error that lists the columns it lacks in order."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    return df


def unique_headers(names: list[str | None]) -> list[str]:
    """Header cells as unique names: a repeated X is X__2, a blank one Column_n."""
    seen: dict[str, int] = {}
    out = []
    for n, name in enumerate(names, 1):
        base = (name or "").strip() or f"Column_{n}"
        seen[base] = seen.get(base, 0) + 1
        out.append(base if seen[base] == 1 else f"{base}__{seen[base]}")
    return out


def sheet(spark: SparkSession, path: str) -> DataFrame:
    """A sheet saved as CSV, all cells text: unique headers, blank rows dropped, row_number as in the sheet (data from 2)."""
    raw = spark.read.csv(path, header=False, multiLine=True)
    first = raw.withColumn("_id", F.monotonically_increasing_id())
    head = first.orderBy("_id").first()
    names = unique_headers([head[c] for c in raw.columns])
    rows = first.withColumn("row_number", F.row_number().over(W.orderBy("_id"))).where("row_number > 1").drop("_id")
    rows = rows.toDF(*names, "row_number")
    some = F.coalesce(*(F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in names))
    return rows.where(some.isNotNull())


def reference(spark: SparkSession, path: str, key: str, schema: str, existing: DataFrame | None = None) -> DataFrame:
    """A JSON array of reference records: the first of each key in file order, without keys that exist."""
    rows = spark.read.schema(schema).json(path, multiLine=True).withColumn("_id", F.monotonically_increasing_id())
    first = rows.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy("_id"))).where("_n = 1").drop("_n", "_id")
    return first if existing is None else first.join(existing.select(key), key, "left_anti")


def write_csv(df: DataFrame, path: str, zone: str = "UTC") -> None:
    """Times as local ISO strings, null as empty, with a header."""
    cols = [F.date_format(F.from_utc_timestamp(F.col(c).cast("timestamp"), zone), "yyyy-MM-dd'T'HH:mm:ss").alias(c) if t.startswith("timestamp") else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")
