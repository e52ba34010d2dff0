"""Keyed tables as snapshots: data folders by hash bucket, and a manifest a version that names them.

A change writes new folders for the buckets that it touches and then one manifest, put in place by a rename that fails if that
version exists. So a change is there as a whole or not at all, readers keep the version they began with, and of two writers
of one version one gets an error. A bucket's rows hash alike, so a hot value of another column is spread over all buckets.
"""

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidings.operators.records import unique

BUCKETS, FOLDERS, NAMED = 64, 16, 100
_BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer made the version first; read again and repeat the change."""


class SnapshotTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = spark.createDataFrame([], schema).schema

    # files, through the file system that Spark uses

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self, name: str) -> list[str]:
        fs, at = self._fs(), self._at(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _put(self, version: int, manifest: dict) -> None:
        """The manifest in place, or Conflict."""
        jvm, temp, final = self.spark.sparkContext._jvm, self._at(f"_temp/{uuid.uuid4().hex}"), self._at(f"_manifests/{version:012d}.json")
        fs = self._fs()
        fs.mkdirs(final.getParent())
        out = fs.create(temp, True)
        out.write(json.dumps(manifest).encode())
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()) if "://" in self.path else jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.spark.sparkContext._jsc.hadoopConfiguration())
        never = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(temp, final, never)
        except Exception as e:
            if fs.exists(final):
                raise Conflict(f"version {version} exists") from e
            raise

    # versions

    def version(self) -> int:
        """The newest version, 0 for a table that nothing was written to."""
        return max((int(n.removesuffix(".json")) for n in self._listed("_manifests")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """A version's folders by bucket, the last batch of each stream, and notes."""
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "buckets": {}, "batches": {}, "notes": {}}
        stream = self._fs().open(self._at(f"_manifests/{version:012d}.json"))
        text = self.spark.sparkContext._jvm.java.util.Scanner(stream, "UTF-8").useDelimiter("\\A").next()
        stream.close()
        return json.loads(text)

    def read(self, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of a version, on demand of some buckets only."""
        return self._rows(self.manifest(version), buckets)

    def _rows(self, manifest: dict, buckets: Iterable[int] | None = None) -> DataFrame:
        of = manifest["buckets"]
        folders = [f"{self.path}/{f}" for b in (of if buckets is None else map(str, buckets)) for f in of.get(b, ())]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    # changes

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(self.bucket()).distinct().collect()]

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Rows to a new folder; its folder by bucket."""
        name = f"data/{uuid.uuid4().hex}"
        rows = rows.select(*(F.col(f.name).cast(f.dataType) for f in self.schema.fields)).withColumn(_BUCKET, self.bucket())
        rows.repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/{name}")
        return {n.split("=", 1)[1]: f"{name}/{n}" for n in self._listed(name) if n.startswith(f"{_BUCKET}=")}

    def _commit(self, base: dict, buckets: dict[str, list[str]], batch: tuple[str, int] | None, notes: dict | None) -> int:
        version = base["version"] + 1
        batches = base["batches"] | ({batch[0]: batch[1]} if batch else {})
        self._put(version, {"version": version, "buckets": {b: f for b, f in (base["buckets"] | buckets).items() if f}, "batches": batches, "notes": notes or {}})
        return version

    def insert(self, rows: DataFrame, order: list[Column], batch: tuple[str, int] | None = None, notes: dict | None = None) -> int:
        """Adds the first row (by order) of each key that the table lacks; a null in a key never collides. A batch (stream, number) that a version already holds changes nothing. The version after."""
        base = self.manifest()
        if batch and base["batches"].get(batch[0], -1) >= batch[1]:
            return base["version"]
        touched = self._touched(rows)
        fresh = unique(rows.select(*self.schema.names), self.keys, order, self._rows(base, touched))
        seen = Observation()
        folders = self._write(fresh.observe(seen, F.count(F.lit(1)).alias("inserted")))
        lists = {b: [*base["buckets"].get(b, ()), f] for b, f in folders.items()}
        return self._commit(base, lists, batch, (notes or {}) | seen.get)

    def upsert(self, rows: DataFrame, base: dict | None = None, notes: dict | None = None) -> int:
        """Puts rows, one a key, in place of those with their keys. Only the buckets of these keys are written anew."""
        base = base or self.manifest()
        touched = self._touched(rows)
        rest = self._rows(base, touched).join(rows.select(*self.keys), self.keys, "left_anti")
        folders = self._write(rest.unionByName(rows.select(*self.schema.names)))
        return self._commit(base, {str(b): [folders[str(b)]] if str(b) in folders else [] for b in touched}, None, notes)

    def change(self, wanted: DataFrame, values: dict[str, Column]) -> int:
        """Sets columns of the rows whose keys `wanted` names; values may use its other columns as `w`.column. If a key is not there nothing is changed and the error names such keys, 100 at most."""
        base = self.manifest()
        wanted = wanted.dropDuplicates(self.keys)
        old = self._rows(base, self._touched(wanted)).alias("t")
        lost = wanted.join(old.select(*self.keys), self.keys, "left_anti").select(*self.keys)
        missing = [tuple(r) for r in lost.orderBy(*self.keys).limit(NAMED).collect()]
        if missing:
            raise ValueError("not found: " + ", ".join(str(k[0] if len(k) == 1 else k) for k in missing))
        new = old.join(wanted.alias("w"), self.keys)
        return self.upsert(new.select(*((values[c] if c in values else F.col(c if c in self.keys else f"t.{c}")).alias(c) for c in self.schema.names)), base)

    def compact(self, folders: int = FOLDERS) -> int:
        """Buckets of more than so many folders written as one; the rows stay."""
        base = self.manifest()
        full = [int(b) for b, f in base["buckets"].items() if len(f) > folders]
        if not full:
            return base["version"]
        new = self._write(self._rows(base, full))
        return self._commit(base, {str(b): [new[str(b)]] for b in full}, None, base["notes"])

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all but the last versions, and folders that none of those names; how many folders went. No change and no older reader may be at work."""
        last = self.version()
        kept = [self.manifest(v) for v in range(max(1, last - keep + 1), last + 1)]
        named, fs, gone = {f for m in kept for fs_ in m["buckets"].values() for f in fs_}, self._fs(), 0
        for folder in self._listed("data"):
            for part in self._listed(f"data/{folder}"):
                if part.startswith(_BUCKET) and f"data/{folder}/{part}" not in named:
                    gone += fs.delete(self._at(f"data/{folder}/{part}"), True)
        for name in self._listed("_manifests"):
            if int(name.removesuffix(".json")) <= last - keep:
                fs.delete(self._at(f"_manifests/{name}"), False)
        return gone
