"""Exact top-k search with a vector-approximation file.

Vectors are whole numbers floor(scale * x). The approximation file keeps for each vector one byte a dimension, the number
of a cell of fixed width; a query's score against a cell is bounded from both sides. Each task scans the cells of its
vectors for a block of queries, chunk by chunk, then reads exact vectors in order of upper bound, best first, until the kth
exact score of a query is above every remaining bound. The k best of a query so far bound the later chunks of the task from
the start; what leaves a task is k rows a query, which are merged by rank.

Queries go to the tasks in blocks of a fixed number of rows (BLOCK, so the broadcast is BLOCK * dimensions * 8 bytes at
most); the vectors are scanned once a block. Edge cases: null vectors, vectors with null or non-finite components and rows
with a null vec_id take no part; queries meet vectors of their own length only, and empty vectors none; rows with a query's
own vec_id are not its candidates; repeated candidate rows count as rows; repeated query rows count once; ties go to the
smaller vec_id; with fewer than k candidates all are returned; an empty table gives an empty result; extra columns, whatever
their names, are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidings.llm.work import Workspace, chunks, record

BLOCK = 16384
CELLS = 64


def whole_vectors(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, v): whole-number vectors of the rows that take part."""
    x = F.col(f"`{vector}`")
    fine = x.isNotNull() & F.col(f"`{key}`").isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return df.where(F.coalesce(fine, F.lit(False))).select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def _matrix(column, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have so many dimensions, and their vectors."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(arr.offsets.to_numpy())
    rows = np.flatnonzero(size == dims)
    if not len(rows):
        return rows, np.zeros((0, dims))
    flat = arr.values.to_numpy(zero_copy_only=False).astype(np.float64)
    return rows, flat[arr.offsets.to_numpy()[rows][:, None] + np.arange(dims)]


def best_of(q: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (query, vector, score) the k best of each query, in order of query and rank."""
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < k
    return q[keep], v[keep], s[keep]


def scan(ids: np.ndarray, exact: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, known: np.ndarray | None = None):
    """The k best (query, vector, score) among these vectors, and how many exact vectors were read. known: a score for each query below which its vectors do not count."""
    known = np.full(len(queries), -np.inf) if known is None else known
    low, high = exact.min(0), exact.max(0)
    width = np.maximum((high - low) / CELLS, 1e-9)
    cells = np.minimum((exact - low) // width, CELLS - 1).astype(np.uint8)
    # single precision for the scan: a slack above its rounding error keeps the bounds true
    middle = (low + (cells + 0.5) * width).astype(np.float32)
    slack = 1 + np.abs(queries) @ (np.maximum(np.abs(low), np.abs(high)) * 1e-4)
    radius = np.abs(queries) @ (width / 2) + slack
    out_q, out_v, out_s, read = [], [], [], 0
    for a in range(0, len(queries), 256):
        near = queries[a : a + 256].astype(np.float32) @ middle.T
        near[query_ids[a : a + 256, None] == ids[None, :]] = -np.inf
        best = min(k, len(ids))
        floor = np.partition(near, len(ids) - best, axis=1)[:, len(ids) - best]
        for i in range(len(near)):
            q, r = queries[a + i], radius[a + i]
            todo = np.flatnonzero(near[i] >= max(floor[i] - 2 * r, known[a + i] - r))
            todo = todo[np.isfinite(near[i][todo])]
            todo = todo[np.argsort(-near[i][todo], kind="stable")]
            got = np.zeros(0)
            at = 0
            while at < len(todo):
                step = todo[at : at + 4 * k]
                if len(got) >= k and near[i][step[0]] + r < np.partition(got, len(got) - k)[len(got) - k]:
                    break
                got = np.concatenate([got, exact[step] @ q])
                at += len(step)
            todo, read = todo[:at], read + at
            top = np.lexsort((ids[todo], -got))[:k]
            out_q.append(np.full(len(top), query_ids[a + i]))
            out_v.append(ids[todo[top]])
            out_s.append(got[top])
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s), read


def top_k(spark, vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query, ties to the smaller vec_id."""
    ws = Workspace(spark, "va")
    base = whole_vectors(vectors, key, vector, scale)
    asked = ws.stage(whole_vectors(queries, key, vector, scale).dropDuplicates(["vec_id"]), "queries")
    n = max(1, -(-asked.count() // block))
    found = None
    for b in range(n):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == b).collect()  # a block: about `block` rows, whatever the table
        by_dims: dict[int, list] = {}
        for r in rows:
            by_dims.setdefault(len(r["v"]), []).append(r)
        sent = spark.sparkContext.broadcast([(d, np.array([r["vec_id"] for r in g]), np.array([r["v"] for r in g], np.float64).reshape(len(g), d)) for d, g in sorted(by_dims.items())])

        def run(batches, sent=sent):
            held = {dims: (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) for dims, _, _ in sent.value if dims}
            known = {dims: np.full(len(qi), -np.inf) for dims, qi, _ in sent.value}
            for table in chunks(batches, 8 << 20):
                ids = table.column("vec_id").to_numpy()
                for dims, qi, q in sent.value:
                    at, exact = _matrix(table.column("v"), dims)
                    if len(at) and dims:
                        new = scan(ids[at], exact, qi, q, k, known[dims])[:3]
                        held[dims] = best_of(*(np.concatenate(x) for x in zip(held[dims], new, strict=True)), k)
                        # the kth best so far, of queries that have k
                        kth = held[dims][0][k - 1 :] == held[dims][0][: len(held[dims][0]) - k + 1]
                        place = {x: n for n, x in enumerate(qi.tolist())}
                        full = np.array([place[x] for x in held[dims][0][k - 1 :][kth].tolist()], np.int64)
                        known[dims][full] = held[dims][2][k - 1 :][kth]
            for a, v, s in held.values():
                if len(a):
                    yield record(query_id=a.astype(np.int64), vec_id=v.astype(np.int64), score=s.astype(np.int64))

        part = ws.stage(base.mapInArrow(run, "query_id long, vec_id long, score long"), f"found-{b}")
        found = part if found is None else found.unionByName(part)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: for each vector whose id is divisible by 50, its five best others."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(spark, table, table.where("vec_id % 50 = 0"))


ORACLE = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, x -> CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), z -> z[1] * z[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
