"""Connected components and representatives of clusters."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidings.sources.shared import run_folder


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: computed once, its lineage ends, and a lost executor loses nothing."""
    path = run_folder(df.sparkSession, "cut") + "/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(nodes: DataFrame, id_: str, edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, label): the smallest id that a node is linked to over any path; nodes without edges are their own. Labels spread to neighbours and jump to their label's label until none changes."""
    both = cut(edges.select(F.col(a).alias("_u"), F.col(b).alias("_v")).unionByName(edges.select(F.col(b).alias("_u"), F.col(a).alias("_v"))).distinct())
    label = cut(nodes.select(id_, F.col(id_).alias("label")))
    while True:
        near = both.join(label.withColumnRenamed(id_, "_v"), "_v").groupBy("_u").agg(F.min("label").alias("_m"))
        new = label.join(near, label[id_] == near["_u"], "left").select(id_, F.least("label", "_m").alias("label"))
        jump = new.select(F.col(id_).alias("_j"), F.col("label").alias("_l"))
        new = cut(new.join(jump, new["label"] == jump["_j"], "left").select(id_, F.least("label", "_l").alias("label")))
        if new.join(label.withColumnRenamed("label", "_old"), id_).where("label <> _old").isEmpty():
            return new
        label = new


def representatives(members: DataFrame, cluster: str, *order: Column) -> DataFrame:
    """Members with is_rep: the first of each cluster in this order."""
    return members.withColumn("is_rep", F.row_number().over(W.partitionBy(cluster).orderBy(*order)) == 1)


def place_time_pairs(rows: DataFrame, id_: str, places: str, time: str, seconds: int) -> DataFrame:
    """(a, b), a < b: rows that share a place and lie within the time window. Places are exploded and joined with their time buckets; nothing is compared across places or far buckets."""
    from tidings.operators.joins import interval_join

    x = rows.select(F.col(id_).alias("a"), F.explode(places).alias("_p"), F.col(time).alias("_ta"))
    y = rows.select(F.col(id_).alias("b"), F.explode(places).alias("_p"), F.col(time).alias("_tb"))
    return interval_join(x, y, ["_p"], "_ta", "_tb", seconds).where("a < b").select("a", "b").distinct()


def application(members: DataFrame, cluster: str, id_: str, places: str) -> DataFrame:
    """What happens to each member when its cluster's representative stands: `duplicate` if its places are all the representative's, `partial` with the shared places if some are, `keep` if none is."""
    rep = members.where("is_rep").select(F.col(cluster).alias("_c"), F.col(places).alias("_rp"), F.col(id_).alias("rep_id"))
    out = members.join(rep, members[cluster] == rep["_c"]).drop("_c")
    shared = F.array_intersect(places, "_rp")
    action = F.when(F.col("is_rep"), "representative").when(F.size(shared) == 0, "keep").when(F.size(shared) == F.size(F.array_distinct(places)), "duplicate").otherwise("partial")
    return out.withColumns({"action": action, "shared": F.sort_array(shared)}).drop("_rp")


def new_pairs(pending: DataFrame, known: DataFrame, id_: str, places: str, time: str, seconds: int) -> DataFrame:
    """(a, b), a < b: place_time_pairs() of which one row at least is pending; known rows are not compared among themselves."""
    from tidings.operators.joins import interval_join

    x = pending.select(F.col(id_).alias("_p"), F.explode(places).alias("_place"), F.col(time).alias("_ta"))
    y = known.unionByName(pending).select(F.col(id_).alias("_q"), F.explode(places).alias("_place"), F.col(time).alias("_tb"))
    near = interval_join(x, y, ["_place"], "_ta", "_tb", seconds).where("_p <> _q")
    return near.select(F.least("_p", "_q").alias("a"), F.greatest("_p", "_q").alias("b")).distinct()


def merge_labels(state: DataFrame, id_: str, nodes: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, label) of the rows whose label is new or changes, from stored labels (id, label), new nodes and edges that have a new node: labels are merged by the edges between them alone, and the members of a label that does not change are not read again but for the look-up of edges' ends. The same as components() over all."""
    labels = state.select(id_, "label").unionByName(nodes.select(id_, F.col(id_).alias("label")))
    of = lambda c: labels.select(F.col(id_).alias(c), F.col("label").alias(f"_{c}"))
    ends = cut(edges.join(of(a), a).join(of(b), b).where(F.col(f"_{a}") != F.col(f"_{b}")).select(F.col(f"_{a}").alias("_u"), F.col(f"_{b}").alias("_v")).distinct())
    meeting = ends.select(F.col("_u").alias("_group")).unionByName(ends.select(F.col("_v").alias("_group"))).distinct()
    top = components(meeting, "_group", ends, "_u", "_v").withColumnRenamed("label", "_top")
    moved = labels.join(top, labels["label"] == top["_group"], "left").withColumn("_new", F.coalesce("_top", "label"))
    fresh = nodes.select(F.col(id_).alias("_n"), F.lit(True).alias("_fresh")).distinct()
    out = moved.join(fresh, moved[id_] == fresh["_n"], "left").where(F.col("_fresh") | (F.col("_new") != F.col("label")))
    return out.select(id_, F.col("_new").alias("label"))


def sweep(state: DataFrame | None, members: DataFrame, id_: str, pending: DataFrame, edges: DataFrame, a: str, b: str, *order: Column) -> DataFrame:
    """(id, label, is_rep) after a sweep. state: the same of the sweeps before; pending: their rows are members too; edges have a pending end. Representatives (the first in this order) are chosen anew in clusters that gained or lost members only."""
    old = pending.limit(0).select(id_, F.col(id_).alias("label"), F.lit(True).alias("is_rep")) if state is None else state
    changed = cut(merge_labels(old, id_, pending, edges, a, b))
    left = old.select(F.col(id_).alias("_n"), F.col("label").alias("_was")).join(changed, F.col("_n") == changed[id_]).select(F.col("_was").alias("label"))
    touched = changed.select("label").unionByName(left).distinct()
    now = old.join(changed.select(id_), id_, "left_anti").select(id_, "label", "is_rep").unionByName(changed.withColumn("is_rep", F.lit(None).cast("boolean")))
    again = now.join(touched, "label", "left_semi").select(id_, "label")
    chosen = representatives(again.join(members.drop("label", "is_rep"), id_), "label", *order).select(id_, "label", "is_rep")
    return cut(now.join(touched, "label", "left_anti").select(id_, "label", "is_rep").unionByName(chosen))
