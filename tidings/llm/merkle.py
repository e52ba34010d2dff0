"""A Merkle manifest of a dataset, and a proof for each of its rows by coordinate look-up.

Rows are leaves, grouped (by language) into trees of eight children a node; the groups' roots are the leaves of one more tree.
The node table is materialised: one row a run of up to eight siblings, at coordinate (group, level, run). A proof needs no
walk from leaf to root: the coordinates of all its siblings follow from the leaf's index and the group's size alone. They are
exploded, joined with the node table, put in order, concatenated and folded.

At scale: the leaves of a run share all coordinates above their own, so a run explodes them once, STRIDE levels at a time; a
node that is that much higher does so for the levels above, and its answer is joined below. No coordinate is then asked for
more than 8 ** STRIDE times: neither the root's run nor a group with a third of all rows is a hot key, nothing is broadcast by
hand, and exploded rows are less than half the leaves. Indexes come from a range partition (work.numbered), not from a window
over a group. Every level is a written table. What reaches the driver is the depth and the root.

Edge cases: null and empty values differ in the leaf (`-` against `0:`); texts of any length are hashed whole; rows without a
key come first in their group and count as not tampered; rows that repeat are leaves of their own (ties by leaf, so equal rows
are interchangeable); a group of one row is its own root; an empty table has no rows and a null root. Extra columns are never
read, whatever their names.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.llm.work import Workspace, numbered

BITS = 3  # eight children a node
STRIDE = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(x: Column) -> Column:
    return F.sha2(x, 256)


def leaf(values: list[Column]) -> Column:
    """Hash of the values, each `-` if null, else its bytes' number, a colon and itself."""
    texts = [v.cast("string") for v in values]
    return digest(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)))


def _join(hashes: Column) -> Column:
    return digest(F.array_join(hashes, ""))


def siblings(path: Column) -> Column:
    """All sibling hashes of a path, level by level and left to right."""
    return F.flatten(F.transform(path, lambda p: F.concat(F.slice(p["hashes"], F.lit(1), p["pos"]), F.slice(p["hashes"], p["pos"] + 2, F.lit(1 << BITS)))))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""

    def up(h, p):
        return _join(F.concat(F.slice(p["hashes"], F.lit(1), p["pos"]), F.array(h), F.slice(p["hashes"], p["pos"] + 2, F.lit(1 << BITS))))

    return F.aggregate(path, start, up)


class Tree(NamedTuple):
    low: DataFrame  # grp, depth, run, nodes (hash and the leaves' own columns), hash
    levels: list[DataFrame]  # for each level above: grp, depth, level, run, hashes, hash
    roots: DataFrame  # grp, depth, hash


def grow(ws: Workspace, leaves: DataFrame, name: str) -> Tree:
    """The trees of leaves (grp, i, n, hash, more), one for each grp. depth: levels of a group, 0 for a lone leaf."""
    depth = F.size(F.filter(F.array(*(F.lit(1 << BITS * k) for k in range(21))), lambda p: p < F.col("n")))
    more = [c for c in leaves.columns if c not in ("grp", "i", "n", "hash")]
    low = leaves.groupBy("grp", depth.alias("depth"), F.shiftright("i", BITS).alias("run")).agg(F.sort_array(F.collect_list(F.struct("i", "hash", *more))).alias("nodes"))
    low = ws.stage(low.withColumn("hash", _join(F.col("nodes.hash"))), f"{name}-0")
    most = low.agg(F.max("depth")).first()[0] or 0
    roots = [low.where("depth = 0").select("grp", "depth", F.col("nodes")[0]["hash"].alias("hash"))]
    levels, last = [], low
    for level in range(1, most + 1):
        roots.append(last.where(F.col("depth") == level).select("grp", "depth", "hash"))
        if level < most:
            runs = last.where(F.col("depth") > level).groupBy("grp", "depth", F.shiftright("run", BITS).alias("up")).agg(F.sort_array(F.collect_list(F.struct("run", "hash"))).alias("nodes"))
            runs = runs.select("grp", "depth", F.lit(level).alias("level"), F.col("up").alias("run"), F.col("nodes.hash").alias("hashes"), _join(F.col("nodes.hash")).alias("hash"))
            last = ws.stage(runs, f"{name}-{level}")
            levels.append(last)
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return Tree(low, levels, ws.stage(out, f"{name}-roots"))


def look_up(ws: Workspace, tree: Tree, base: DataFrame, name: str) -> DataFrame:
    """The leaves of a tree, each with its path: (grp, pos, node, path, more). base: (grp, depth, path, more), the path from each group's root on."""
    more = [c for c in base.columns if c not in ("grp", "depth", "path")]
    roots = known = base.select("grp", F.col("depth").alias("level"), F.lit(0).cast("long").alias("node_i"), "path", *more)
    table = None
    for t in tree.levels:
        t = t.select("grp", "level", "run", "hashes")
        table = t if table is None else table.unionByName(t)
    asking = range(1, len(tree.levels) + 1, STRIDE)
    for a in reversed(asking):
        asker = tree.low if a == 1 else tree.levels[a - 2]
        asker = asker.where(F.col("depth") > a).select("grp", "depth", F.col("run").alias("i"))
        level = F.explode(F.sequence(F.lit(a), F.least(F.lit(a + STRIDE - 1), F.col("depth") - 1)))
        asked = asker.withColumn("level", level)
        asked = asked.withColumns({"run": F.expr(f"shiftright(i, {BITS} * (level - {a} + 1))"), "pos": F.expr(f"int(shiftright(i, {BITS} * (level - {a})) & {(1 << BITS) - 1})")})
        part = asked.join(table, ["grp", "level", "run"]).groupBy("grp", "depth", "i").agg(F.sort_array(F.collect_list(F.struct("level", "pos", "hashes"))).alias("part"))
        part = part.withColumn("level", F.least(F.lit(a + STRIDE), F.col("depth")))
        part = part.withColumn("node_i", F.expr(f"shiftright(i, {BITS} * (level - {a}))"))
        own = F.transform("part", lambda p: F.struct(p["pos"].alias("pos"), p["hashes"].alias("hashes")))
        part = part.join(known, ["grp", "level", "node_i"]).select("grp", F.lit(a).alias("level"), F.col("i").alias("node_i"), F.concat(own, F.col("path")).alias("path"), *more)
        known = roots.unionByName(ws.stage(part, f"{name}-paths-{a}"))
    low = tree.low.drop("hash").withColumns({"level": F.least(F.lit(1), F.col("depth")), "node_i": F.col("run")})
    low = low.join(known, ["grp", "level", "node_i"])
    low = low.select("grp", "depth", F.col("nodes.hash").alias("hashes"), F.posexplode("nodes").alias("pos", "node"), "path", *more)
    path = F.when(F.col("depth") > 0, F.concat(F.array(F.struct("pos", "hashes")), F.col("path"))).otherwise(F.col("path"))
    return low.select("grp", "pos", "node", path.alias("path"), *more)


def prove(spark: SparkSession, leaves: DataFrame, ws: Workspace | None = None) -> tuple[DataFrame, str | None]:
    """From leaves (grp, key, hash, more): every leaf as node, with its path and its group's subroot; and the root. grp is a string, null for a group of its own that comes first; groups are in order of their bytes."""
    ws = ws or Workspace(spark, "merkle")
    named = leaves.withColumn("grp", F.coalesce(F.concat(F.lit(":"), F.col("grp")), F.lit("")))
    tree = grow(ws, numbered(ws, named, "grp", ["key", "hash"], "leaves"), "tree")
    heads = tree.roots.select(F.lit("").alias("grp"), F.col("grp").alias("of"), "hash", "depth")
    top = grow(ws, numbered(ws, heads, "grp", ["of"], "heads").withColumnRenamed("depth", "own_depth"), "top")
    root = top.roots.first()
    none = F.array().cast("array<struct<pos: int, hashes: array<string>>>")
    above = look_up(ws, top, top.roots.select("grp", "depth", none.alias("path")), "top")
    base = above.select(F.col("node.of").alias("grp"), F.col("node.own_depth").alias("depth"), "path", F.col("node.hash").alias("subroot"))
    return look_up(ws, tree, ws.stage(base, "above"), "tree"), root["hash"] if root else None


def tampered_key(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 3 == 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: leaf, roots and proof of every document, and whether the tampered ones are found out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    altered = [F.translate("text", upper, lower) if c == "text" else F.col(c) for c in FIELDS]
    leaves = docs.select(F.col("lang").alias("grp"), F.col("doc_id").alias("key"), leaf([F.col(c) for c in FIELDS]).alias("hash"), F.when(tampered_key(F.col("doc_id")), leaf(altered)).alias("found"))
    proofs, root = prove(spark, leaves)
    folded = fold(F.coalesce("node.found", "node.hash"), F.col("path"))
    out = proofs.select(F.col("node.key").alias("doc_id"), F.col("node.hash").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), _join(siblings(F.col("path"))).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


# leaves, then each level from the one below; runs of up to eight hashes as lists; each leaf walks up them, once as it is and once as found
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda p: ascii(substr(doc_id::VARCHAR, p::INT, 1))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT)"


def _leaf_sql(text: str) -> str:
    part = lambda x: f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')"
    return "sha256(" + " || ".join(part(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


ORACLE = f"""
WITH RECURSIVE l AS (SELECT doc_id, coalesce(':' || lang, '') AS g, {_leaf_sql("text")} AS leaf,
  CASE WHEN {_CRC} % 3 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS found FROM documents),
d AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM l),
t(g, lv, i, n, h) AS (SELECT g, 0, i, n, leaf FROM d
  UNION ALL SELECT g, lv + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY g, lv, i // 8, n),
s AS MATERIALIZED (SELECT g, h AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u(lv, i, n, h) AS (SELECT 0, i, n, subroot FROM s UNION ALL SELECT lv + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY lv, i // 8, n),
r AS MATERIALIZED (SELECT g, lv, i // 8 AS run, n, list(h ORDER BY i) AS hs FROM t WHERE n > 1 GROUP BY ALL
  UNION ALL SELECT NULL, lv, i // 8, n, list(h ORDER BY i) FROM u WHERE n > 1 GROUP BY ALL),
w(key, g, part, lv, i, h, proof) AS (SELECT row(doc_id, g, d.i), g, 0, 0, i, coalesce(found, leaf), '' FROM d
  UNION ALL SELECT w.key, w.g, CASE WHEN r.hs IS NULL THEN 1 + w.part ELSE w.part END, CASE WHEN r.hs IS NULL THEN 0 ELSE w.lv + 1 END, CASE WHEN r.hs IS NULL THEN s.i ELSE w.i // 8 END,
   CASE WHEN r.hs IS NULL THEN w.h ELSE sha256(array_to_string(list_concat(r.hs[1:w.i % 8], [w.h], r.hs[w.i % 8 + 2:8]), '')) END,
   CASE WHEN r.hs IS NULL THEN w.proof ELSE w.proof || array_to_string(list_concat(r.hs[1:w.i % 8], r.hs[w.i % 8 + 2:8]), '') END
  FROM w JOIN s ON s.g = w.g LEFT JOIN r ON r.lv = w.lv AND r.run = w.i // 8 AND (w.part = 0 AND r.g = w.g OR w.part = 1 AND r.g IS NULL) WHERE w.part < 2)
SELECT d.doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, w.h AS folded_root, w.h = root AS verified
FROM d JOIN s USING (g) CROSS JOIN (SELECT h AS root FROM u WHERE n = 1) JOIN w ON w.key = row(d.doc_id, d.g, d.i) AND w.part = 2
"""
