"""The batch semantics as streams: cut-off of late rows, unique keys, latest version, exactly-once ingestion, greedy windows."""

import logging
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidings.operators.folds import Bucket, Kept, greedy_window
from tidings.sources.shared import run_folder
from tidings.sources.snapshots import SnapshotTable

log = logging.getLogger(__name__)


def folder(spark: SparkSession) -> str:
    """A new folder for a stream's checkpoint and output, shared by driver and executors."""
    return run_folder(spark, "stream")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder as a file stream, its times with a zone."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    df = spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")
    return df.select(*(F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else c for c, t in df.dtypes))


def drain(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all there is, to parquet files with the stream's checkpoint beside them; the files as a table."""
    spark, path = df.sparkSession, folder(df.sparkSession)
    df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def late_cutoff(df: DataFrame, time: str, cutoff: str) -> DataFrame:
    """Rows from the cut-off on; rows without a time are late."""
    return df.where(F.col(time) >= F.lit(cutoff).cast("timestamp"))


def unique_keys(df: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def upsert(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The newest version of each key after all batches: each batch's newest rows are written under the batch's number, so a repeated batch overwrites itself; reading takes the newest over batches."""
    from tidings.operators.records import latest

    spark, path = df.sparkSession, folder(df.sparkSession)

    def sink(batch: DataFrame, number: int) -> None:
        latest(batch, keys, version).write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    df.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return latest(spark.read.schema(df.schema).parquet(f"{path}/out/*"), keys, version)


def ingest(df: DataFrame, table: SnapshotTable, name: str, order: list[Column], checkpoint: str, time: str | None = None, cutoff: str | None = None, blocked: Column | None = None) -> None:
    """Runs a stream into a snapshot table, exactly once, over all there is: each batch is one version, which holds the batch's number, so a batch that is repeated after a failure changes nothing or is written anew as a whole. Rows before the cut-off or without a time, and blocked ones, stay out; of equal keys the first row stays. Each version's notes count fetched, late, blocked and inserted rows and duplicates."""
    late = ~F.coalesce(F.col(time) >= F.lit(cutoff).cast("timestamp"), F.lit(False)) if time and cutoff else F.lit(False)
    barred = F.coalesce(blocked, F.lit(False)) if blocked is not None else F.lit(False)

    def sink(batch: DataFrame, number: int) -> None:
        marked = batch.withColumns({"_late": late, "_barred": barred})
        fetched, n_late, n_barred = marked.agg(F.count("*"), F.count_if("_late"), F.count_if(~F.col("_late") & F.col("_barred"))).first()
        kept = marked.where("not _late and not _barred").drop("_late", "_barred")
        version = table.insert(kept, order, (name, number), {"fetched": fetched, "late": n_late, "blocked": n_barred, "wanted": fetched - n_late - n_barred})
        log.info("batch %s of %s: %s", number, name, table.manifest(version)["notes"])

    df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


SLICES = 1024  # groups of keys with one state each: a state call costs as much as many rows, so keys share them


class _Greedy(StatefulProcessor):
    """The kept rows of a slice's keys by time bucket (operators.folds.Kept), as map state: a bucket's rows of all keys are one value. Buckets that neither a row within the delay nor the window can reach go when the watermark passes them."""

    def __init__(self, width: int, window: int):
        self.keys, self.window = [f"k{n}" for n in range(width)], max(window, 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        keys = "".join(f"{k} array<string>, " for k in self.keys)
        self.state = handle.getMapState("kept", "bucket long", keys + "owners array<long>, ids array<long>, places array<long>, times array<long>")
        self.count = handle.getValueState("count", "n long")

    def _gone(self, bucket: int) -> int:
        """The watermark, in milliseconds, from which a bucket can meet no more rows."""
        return -(-((bucket + 2) * self.window) // 1000)

    def _purge(self, mark: int) -> None:
        for (b,) in list(self.state.keys()):
            if self._gone(b) <= mark:
                self.state.removeKey((b,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        kept: dict[tuple, Kept] = defaultdict(lambda: Kept(self.window, n))
        if n:
            self._purge(timerValues.getCurrentWatermarkInMs())
            for (b,), (*keys, owners, ids, places, times) in self.state.iterator():
                for k, owner, *held in zip(zip(*keys, strict=True), owners, places, ids, times, strict=True):
                    kept[k].buckets.setdefault(b, Bucket(owner)).add(*held)
        pdf = pd.concat(list(rows), ignore_index=True).sort_values("id", kind="stable")
        columns = (zip(*(pdf[c].tolist() for c in self.keys), strict=True), *(pdf[c].tolist() for c in ("id", "at", "owner", "owned", "sure")))
        hits = []
        for k, id_, at, owner, owned, sure in zip(*columns, strict=True):
            hits += greedy_window([(id_, at, owner if owned else None, True)], self.window, kept[k]) if sure else [(id_, None)]
        out = pdf[[*self.keys, "id"]].copy()
        out["original_id"] = pd.array([hit for _, hit in hits], dtype="Int64")
        yield out
        changed: dict[int, list] = {b: [] for x in kept.values() for b in x.changed}
        for k, x in kept.items():
            for b, bucket in x.buckets.items():
                if b in changed:
                    changed[b] += [(*k, bucket.owner, i, p, t) for p, i, t in bucket.rows]
        for b, held in changed.items():
            self.state.updateValue((b,), tuple(map(list, zip(*held, strict=True))))
        if changed:
            self.handle.registerTimer(self._gone(max(changed)) + 1)
            self.count.update((n + len(pdf),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._purge(timerValues.getCurrentWatermarkInMs())
        if not list(self.state.keys()):
            self.count.clear()
        return iter(())

    def close(self) -> None:
        pass


def greedy(df: DataFrame, keys: list[str], id_: str, time: str, owner: str, confident: str, seconds: int, delay: str = "1 day", slices: int = SLICES) -> DataFrame:
    """(keys, id, original_id): greedy window dedup with the kept rows as state. Equal to the batch form while ids arrive in order within each key and no row is later than the delay; later ones are left out. State is bounded: a kept row goes once the watermark is two windows past its bucket, so a key holds the kept rows of three windows and the delay at most. Keys are dealt by hash to slices that share their state calls; a slice's rows of one batch are in memory together. Needs the RocksDB state store, which is set for the session."""
    kinds = dict(df.dtypes)
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    t, who, sure = F.unix_micros(time), F.col(owner).cast("long"), F.col(confident) & F.col(time).isNotNull()
    # keys travel as text and nulls as flags, since whole numbers with nulls would come as floats
    x = df.withWatermark(time, delay).select(
        F.pmod(F.xxhash64(*keys), F.lit(slices)).alias("slice"), *(F.col(c).cast("string").alias(f"k{n}") for n, c in enumerate(keys)), F.col(id_).alias("id"), F.col(time).alias("time"),
        F.coalesce(t, F.lit(0)).alias("at"), F.coalesce(who, F.lit(0)).alias("owner"), who.isNotNull().alias("owned"), F.coalesce(sure, F.lit(False)).alias("sure"),
    )
    schema = "".join(f"k{n} string, " for n in range(len(keys))) + f"id {kinds[id_]}, original_id long"
    got = x.groupBy("slice").transformWithStateInPandas(_Greedy(len(keys), seconds * 1_000_000), schema, "append", "EventTime")
    return got.select(*(F.col(f"k{n}").cast(kinds[c]).alias(c) for n, c in enumerate(keys)), F.col("id").alias(id_), "original_id")
