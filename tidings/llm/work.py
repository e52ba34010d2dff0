"""Shared folder, staged tables and the keyed exchange of packed arrays that the corpus operators use."""

import ctypes
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidings.llm.kernels import mix

TEXT_CHUNK = 2 << 20
BATCH = "4m"  # bytes of an Arrow batch between Spark and a worker
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a folder of our own, in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        own = spark.sparkContext
        if not own.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = _own_dirs.get(own.applicationId) or _own_dirs.setdefault(own.applicationId, "file://" + tempfile.mkdtemp(prefix="tidings-"))
    return path.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of at most BATCH bytes while a table is written: both ends of the exchange hold a batch in memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    if before is None:
        yield
        return
    spark.conf.set(name, BATCH)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """A worker outlives its task: memory that nothing uses any more goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Workspace:
    """Tables that one run of an operator writes to the shared folder, so that a lost executor costs no recomputation of earlier steps. They go when the driver ends; a driver that is killed leaves them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        with small_batches(self.spark):
            df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def n_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_parts(spark: SparkSession) -> int:
    """Hash ranges of an exchange: several for each task, so that their sizes even out."""
    return 4 * n_tasks(spark)


def chunks(batches, size: int = TEXT_CHUNK):
    """Arrow batches cut or joined to tables of about so many bytes (one row at least)."""
    held, total = [], 0
    for batch in batches:
        rows = max(1, int(size * batch.num_rows / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            piece = batch.slice(at, rows)
            held.append(piece)
            total += batch.nbytes * piece.num_rows // max(1, batch.num_rows)
            if total >= size:
                yield pa.Table.from_batches(held).combine_chunks()
                held, total = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
        held = []
    give_back()


def by_part(rows: DataFrame, fn, schema: str) -> DataFrame:
    """Rows with an int column part, dealt out by it; fn(part, table of that part's rows) yields record batches. A part is a hash range: its size falls as tasks are added."""

    def run(batches):
        held, now = [], None
        for batch in batches:
            parts, at = batch.column("part").to_pylist(), 0
            while at < len(parts):
                end = at
                while end < len(parts) and parts[end] == parts[at]:
                    end += 1
                if now is not None and parts[at] != now:
                    yield from fn(now, pa.Table.from_batches(held))
                    held = []
                now = parts[at]
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield from fn(now, pa.Table.from_batches(held))
        held = []
        give_back()

    return rows.repartition(n_tasks(rows.sparkSession), F.col("part")).sortWithinPartitions("part").mapInArrow(run, schema)


def numbered(ws: Workspace, rows: DataFrame, group: str, order: list, name: str, write_first: bool = True) -> DataFrame:
    """rows with i, the place (from 0) among the rows of equal group, and n, their number. group may not hold nulls; rows that tie in order come in any order, fixed once written. Rows are dealt out by ranges of (group, order, tie), so a group with most rows is spread over tasks; only counts by range and group are summed. Rows that are dear to compute are written first, as finding the ranges reads them too. The working columns tie, part and at must be free."""
    keys = [group, *order, "tie"]
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    rows = ws.stage(rows, f"{name}-rows") if write_first else rows
    ranged = rows.repartitionByRange(n_tasks(ws.spark), *keys).sortWithinPartitions(*keys)
    ranged = ws.stage(ranged.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}).drop("tie"), f"{name}-ranges")
    if write_first:
        ws.drop(f"{name}-rows")
    starts = ranged.groupBy("part", group).agg(F.min("at").alias("first"), F.count("*").alias("c"))
    by_range = W.partitionBy(group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.withColumns({"before": F.coalesce(F.sum("c").over(by_range), F.lit(0)) - F.col("first"), "n": F.sum("c").over(W.partitionBy(group))})
    starts = ws.stage(starts.select("part", group, "before", "n"), f"{name}-starts")
    return ranged.join(starts, ["part", group]).withColumn("i", F.col("before") + F.col("at")).drop("part", "at", "before")


def record(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def components(ws: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """Connected components of edges (a, b): node, label = smallest node, for all nodes but the smallest ones. Each round is a large-star and a small-star step, written to the shared folder, until nothing changes; rounds grow with the logarithm of the longest chain. A hub's edges are reduced by partial aggregation and never gathered."""
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs, k, last = ws.stage(pairs, f"{name}-0"), 0, None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = ws.stage(large, f"{name}-large-{k}")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small = small.where("u <> v").distinct()
        k += 1
        pairs = ws.stage(small, f"{name}-{k}")
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        ws.drop(f"{name}-large-{k - 1}", f"{name}-{k - 1}")
        if tuple(state) == last:
            break
        last = tuple(state)
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label"))


def joined_components(ws: Workspace, label: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Components after more edges (a, b), from those before: only the edges between components are followed."""
    of = lambda c: label.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    ends = edges.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    ends = ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    more = components(ws, ends, f"{name}-between")
    up = more.select(F.col("node").alias("label"), F.col("label").alias("top"))
    old = label.join(up, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    return ws.stage(old.unionByName(more), name)


class Bitmap:
    """A set of 64-bit values, kept as one bit for each hash prefix: no member is missed, a few others pass. About 16 bits a member, at most 2 ** 30 bits (128 MB); beyond that more others pass, which costs work and no results."""

    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.data = bits, data

    def has(self, values: np.ndarray) -> np.ndarray:
        at = _places(values, self.bits)
        return (self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _places(values: np.ndarray, bits: int) -> np.ndarray:
    return (mix(values.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def bitmap(values: DataFrame, most: int = 30) -> Bitmap:
    """The Bitmap of a DataFrame's one column of longs. Tasks set the bits; what comes to the driver is the map's slices."""
    n = values.count()
    bits = min(most, max(16, (16 * n).bit_length()))
    low = max(13, bits - 8)  # each slice holds 2 ** low bits

    def run(batches):
        own = {}
        for batch in batches:
            at = _places(batch.column(0).to_numpy(zero_copy_only=False), bits)
            for k in np.unique(at >> low).tolist():
                bytes_ = own.setdefault(k, np.zeros(1 << (low - 3), np.uint8))
                inside = at[at >> low == k] & ((1 << low) - 1)
                np.bitwise_or.at(bytes_, inside >> 3, (1 << (inside & 7)).astype(np.uint8))
        for k, b in own.items():
            yield record(part=np.array([k], np.int32), slice=[b.tobytes()])

    def join(part, table):
        out = np.zeros(1 << (low - 3), np.uint8)
        for b in table.column("slice").to_pylist():
            out |= np.frombuffer(b, np.uint8)
        yield record(part=np.array([part], np.int32), slice=[out.tobytes()])

    data = np.zeros(1 << (bits - 3), np.uint8)
    for r in by_part(values.mapInArrow(run, "part int, slice binary"), join, "part int, slice binary").collect():
        data[r["part"] << (low - 3) : (r["part"] + 1) << (low - 3)] = np.frombuffer(r["slice"], np.uint8)
    return Bitmap(bits, data)


def dealt(table: np.ndarray, parts: np.ndarray):
    """A structured array's rows by part: (part, bytes) for each part that has some."""
    order = np.argsort(parts, kind="stable")
    table, parts = table[order], parts[order]
    cut = np.flatnonzero(np.diff(parts)) + 1
    ends = [*cut.tolist(), len(parts)]
    for a, b in zip([0, *cut.tolist()], ends, strict=True):
        if b > a:
            yield int(parts[a]), table[a:b].tobytes()


def packed(table: np.ndarray, parts: np.ndarray) -> pa.RecordBatch:
    got = list(dealt(table, parts))
    return record(part=np.array([p for p, _ in got], np.int32), blob=pa.array([b for _, b in got], pa.binary()))


def unpacked(table: pa.Table, dtype, column: str = "blob") -> np.ndarray:
    got = [np.frombuffer(b, dtype) for b in table.column(column).to_pylist() if b]
    return np.concatenate(got) if got else np.zeros(0, dtype)
