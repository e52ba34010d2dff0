"""A log of runs: what each stage read, wrote and counted, or that it failed."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidings.sources.snapshots import SnapshotTable

SCHEMA = "run string, stage string, n_in long, n_out long, extra map<string,string>, failed boolean, error string"


class RunLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, SnapshotTable(spark, path, SCHEMA, ["run", "stage"], buckets=1)

    def stage(self, run: str, name: str, rows: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, **measures: Column) -> DataFrame | None:
        """Writes work(rows) to path and logs the stage; its table, or None if it failed. Rows in and out and the measures (aggregates of the rows out) are observed as they pass; only the input of a failed stage is counted anew. A stage that is repeated replaces its entry."""
        seen, made, error = Observation(), Observation(), None
        try:
            out = work(rows.observe(seen, F.count(F.lit(1)).alias("n")))
            out.observe(made, F.count(F.lit(1)).alias("n"), *(c.cast("string").alias(m) for m, c in measures.items())).write.mode("overwrite").parquet(path)
        except Exception as e:  # the log says so, whatever it was
            error = f"{type(e).__name__}: {e}".split("\n")[0][:500]
        got = made.get if error is None else {"n": 0}
        n_in = seen.get["n"] if error is None else rows.count()
        entry = (run, name, n_in, got["n"], {m: got.get(m) for m in measures}, error is not None, error)
        self.table.upsert(self.spark.createDataFrame([entry], SCHEMA))
        return self.spark.read.schema(out.schema).parquet(path) if error is None else None
