"""Mixing sources to target weights by hash-threshold histograms, in DataFrame functions only.

A document's place in its source's queue is a hash of its id. Tokens are summed by source and hash bucket; running sums
over that histogram (at most BUCKETS rows a source) give, for the source's budget, the bucket that the budget cuts; only
documents of that bucket are summed again, by the rest of the hash, to find the exact threshold. Documents under the
threshold are taken by a filter: nothing is sorted, and a source with a third of all rows is pre-aggregated by bucket on the
map side. A source's budget above its size repeats all its documents once and takes the rest by threshold; budgets are
nested: a larger one keeps all that a smaller one took.

Edge cases: null and empty texts count 0 words; very long texts are counted whole; documents of no words go with their
place, never more often than the source's passes allow; a null source is a source of its own, last in order; a null doc_id
hashes as such; rows with the same doc_id share a place (a tie) and are taken together; an empty table gives an empty result;
a source without words takes nothing. Extra columns are kept and may have any name but those that start with __mix_.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidings.llm.work import Workspace

WEIGHTS = (5, 2, 1)
BUCKETS = 1024
_KEY, _H, _N = "__mix_source", "__mix_h", "__mix_size"


def n_words(text: Column) -> Column:
    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(core == "", F.lit(0)).otherwise(F.size(F.split(core, r"[\x20\x09-\x0D]+"))).cast("long")


def place(key: Column) -> Column:
    """A document's place: a non-negative hash of its id."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("mix"), key), 1)


def budgets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """From (source, size): targets that share `share` of all sizes by weight, none above cap times its source's size, the excess reshared by weight. The level x of the final shares min(cap * size, x * weight) is found from running sums over the sources in order of the level at which each is full. One row a source."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*(F.lit(float(x)) for x in weights))
    ranked = sizes.withColumn("weight", F.get(w, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))))
    full = W.orderBy(F.col("full_at"), F.col("source").asc_nulls_last())
    whole = W.partitionBy(F.lit(0))
    x = ranked.withColumn("full_at", cap * F.col("size") / F.col("weight"))
    x = x.withColumns(
        {
            "below": F.coalesce(F.sum(cap * F.col("size")).over(full.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
            "open": F.sum("weight").over(full.rowsBetween(0, W.unboundedFollowing)),
            "total": share * F.sum("size").over(whole),
        }
    )
    x = x.withColumn("level", (F.col("total") - F.col("below")) / F.col("open"))
    # the first source, in that order, that is not full at the level left for it and those after it
    x = x.withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "below", "level"))).over(whole)["level"])
    return x.select("source", "size", "weight", F.least(cap * F.col("size"), F.coalesce(F.col("level"), F.col("full_at")) * F.col("weight")).alias("target"))


def thresholds(sized: DataFrame, ws: Workspace, **how) -> DataFrame:
    """From (__mix_source, __mix_size, __mix_h): for each source its size, target, number of whole passes and the place below which documents are taken once more."""
    hist = ws.stage(sized.groupBy(_KEY, F.shiftright(_H, 53).alias("bucket")).agg(F.sum(_N).alias("n")), "histogram")
    goal = budgets(hist.groupBy(F.col(_KEY).alias("source")).agg(F.sum("n").alias("size")), **how)
    goal = goal.withColumn("passes", F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(F.lit(0)).cast("long"))
    goal = ws.stage(goal.withColumn("budget", F.col("target") - F.col("passes") * F.col("size")), "goals")
    same = hist[_KEY].eqNullSafe(goal["source"])
    run = W.partitionBy(_KEY).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    ran = hist.withColumn("upto", F.sum("n").over(run)).join(goal, same).where(F.col("upto") > F.col("budget"))
    edge = ran.groupBy(_KEY).agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"), "budget"), "bucket").alias("e")).select(F.col(_KEY).alias("source"), "e.*")
    edge = ws.stage(edge, "edges")
    fine = sized.join(edge, sized[_KEY].eqNullSafe(edge["source"]) & (F.shiftright(_H, 53) == F.col("bucket"))).groupBy(_KEY, _H, "before", "budget").agg(F.sum(_N).alias("n"))
    fine = fine.withColumn("upto", F.col("before") + F.sum("n").over(W.partitionBy(_KEY).orderBy(_H).rowsBetween(W.unboundedPreceding, 0)))
    # the document that the budget cuts is taken if that brings the sum nearer
    taken = F.col("upto") - F.col("budget") <= F.col("budget") - (F.col("upto") - F.col("n"))
    cut = fine.where(taken).groupBy(F.col(_KEY).alias("c")).agg(F.max(_H).alias("last"))
    cut = edge.join(cut, edge["source"].eqNullSafe(cut["c"]), "left").select(F.col("source").alias("c"), F.coalesce(F.col("last"), F.shiftleft("bucket", 53) - 1).alias("last"))
    out = goal.join(cut, goal["source"].eqNullSafe(cut["c"]), "left")
    # no budget left: none once more, not even documents of no words
    every = F.lit(2**63 - 1)
    return ws.stage(out.select(F.col("source").alias("__mix_of"), F.col("size").alias("__mix_source_size"), F.col("target").alias("__mix_target"), F.col("passes").alias("__mix_passes"), F.when(F.col("budget") > 0, F.coalesce("last", every)).otherwise(F.lit(-1)).alias("__mix_last")), "thresholds")


def _sized(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{source}`").alias(_KEY), n_words(F.col(f"`{text}`")).alias(_N), place(F.col(f"`{key}`")).alias(_H))


def times() -> Column:
    return (F.col("__mix_passes") + F.when(F.col(_H) <= F.col("__mix_last"), 1).otherwise(0)).cast("long")


def mix(spark, docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix: rows of docs, each as often as it is taken."""
    ws = Workspace(spark, "mix")
    sized = ws.stage(_sized(docs, key, text, source), "sizes")
    t = thresholds(sized, ws, **how)
    out = docs.withColumn(_H, place(F.col(f"`{key}`"))).join(t, F.col(f"`{source}`").eqNullSafe(t["__mix_of"])).withColumn("__mix_n", times())
    out = out.where("__mix_n > 0").withColumn("__mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_n"))))
    return out.select(*(docs[f"`{c}`"] for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: how much of every document the mix takes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ws = Workspace(spark, "op8")
    sized = ws.stage(_sized(docs, "doc_id", "text", "source"), "sizes")
    t = thresholds(sized, ws)
    out = sized.join(t, sized[_KEY].eqNullSafe(t["__mix_of"]))
    return out.select("doc_id", F.col(_N).alias("size"), F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"), (times() * F.col(_N)).alias("taken"))
