"""Bounded reads, flags, name look-ups and small array work over the tables."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidings.operators import joins, paging
from tidings.plans.registry import query
from tidings.sources.tables import table as t


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 50")
def keyset_page(spark, sf):
    return paging.keyset(t(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 1000, 50)


@query("SELECT 'id' AS kind, event_id FROM events WHERE event_id > 700 UNION ALL SELECT 'time', event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' UNION ALL SELECT 'all', event_id FROM events")
def restricted_reads(spark, sf):
    e = t(spark, sf, "events").select("event_id", "ts")
    both = {"id": {"after_id": 700, "since": "2024-01-20"}, "time": {"since": "2024-01-10"}, "all": {}}
    out = None
    for kind, how in both.items():
        part = paging.restrict(e, "event_id", "ts", **how).select(F.lit(kind).alias("kind"), "event_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT o_orderkey FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY 1 LIMIT 100)")
def capped_stage(spark, sf):
    return paging.capped(t(spark, sf, "orders").where("o_orderstatus = 'O'").select("o_orderkey"), "o_orderkey", 500, 100)


@query("""SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC NULLS LAST, s_suppkey) AS by_balance, row_number() OVER (PARTITION BY s_nationkey ORDER BY lower(s_name) ASC NULLS LAST, s_suppkey) AS by_name
 FROM supplier""")
def column_sort(spark, sf):
    """Lists by any of their columns: the places of every nation's suppliers, names in the order of their letters."""
    s = t(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_name", "s_acctbal")
    place = lambda c, down: F.row_number().over(W.partitionBy("s_nationkey").orderBy(paging.sort_key(s, c, down), "s_suppkey")).cast("long")
    return s.select("s_suppkey", place("s_acctbal", True).alias("by_balance"), place("s_name", False).alias("by_name"))


_NAMES = ("Zoo", "apple", "Äpfel", "zebra", "éclair", "Eclipse", "БАНК", "аист")  # in order: Äpfel apple éclair Eclipse zebra Zoo аист БАНК


@query("SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY [6, 2, 1, 5, 3, 4, 8, 7][s_suppkey % 8 + 1], s_suppkey) AS place FROM supplier")
def locale_sort(spark, sf):
    """Places of names of several scripts in the order of their letters, not of code points."""
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("s_suppkey") % 8 + 1).cast("int"))
    s = t(spark, sf, "supplier").select("s_suppkey", "s_nationkey", name.alias("name"))
    place = F.row_number().over(W.partitionBy("s_nationkey").orderBy(paging.sort_key(s, "name", locale=paging.LOCALE), "s_suppkey"))
    return s.select("s_suppkey", place.cast("long").alias("place"))


@query("SELECT count(*) > 0 AS found FROM (SELECT 1 FROM customer WHERE c_name = 'Customer#000000007' LIMIT 1)")
def existence_lookup(spark, sf):
    return t(spark, sf, "customer").where("c_name = 'Customer#000000007'").limit(1).agg((F.count("*") > 0).alias("found"))


@query("""SELECT user_id, flag, CASE WHEN flag THEN ts END AS set_at, CASE WHEN NOT flag THEN ts END AS cleared_at
 FROM (SELECT user_id, ts, event_type <> 'error' AS flag, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def flag_upsert(spark, sf):
    e = t(spark, sf, "events")
    return paging.flag_state(e, ["user_id"], "ts", "event_id", F.col("event_type") != "error")


@query("""WITH said AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'nowhere' WHEN c_custkey % 2 = 0 THEN lower(n_name) || ' ' ELSE n_name END AS place FROM customer JOIN nation ON c_nationkey = n_nationkey)
 SELECT c_custkey, n_nationkey AS place_id, CASE WHEN n_nationkey IS NULL THEN 'unknown place' END AS error FROM said LEFT JOIN nation ON lower(trim(place)) = lower(trim(n_name))""")
def validated_insert(spark, sf):
    """Hand-made rows with the ids of the places they name; rows of unknown places carry an error."""
    c, n = t(spark, sf, "customer"), t(spark, sf, "nation")
    k = F.col("c_custkey")
    said = c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", F.when(k % 5 == 0, "nowhere").when(k % 2 == 0, F.concat(F.lower("n_name"), F.lit(" "))).otherwise(F.col("n_name")).alias("place"))
    out = paging.resolve_names(said, "place", n, "n_name", "n_nationkey", "place_id")
    return out.select("c_custkey", "place_id", F.when(F.col("place_id").isNull(), "unknown place").alias("error"))


@query("""WITH m AS (SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN NULL ELSE label % 30 END AS first_id FROM embeddings)
 SELECT vec_id, coalesce(n_name, 'as written') AS label FROM m LEFT JOIN nation ON first_id = n_nationkey""")
def label_enrichment(spark, sf):
    """The label of the first match only, null or unknown matches fall back on the text even if a later match is known."""
    e, n = t(spark, sf, "embeddings"), t(spark, sf, "nation")
    matches = F.array(F.struct(F.when(F.col("vec_id") % 4 != 0, F.col("label") % 30).alias("id")), F.struct(F.lit(1).alias("id")))
    x = e.select("vec_id", F.get(matches, 0)["id"].alias("first_id"))
    return x.join(n, x["first_id"] == n["n_nationkey"], "left").select("vec_id", F.coalesce("n_name", F.lit("as written")).alias("label"))


@query("""SELECT user_id, count(*) FILTER (WHERE event_type = 'error' AND (last_ok IS NULL OR event_id > last_ok)) AS failures
 FROM (SELECT *, max(CASE WHEN event_type <> 'error' THEN event_id END) OVER (PARTITION BY user_id) AS last_ok FROM events) GROUP BY 1""")
def failures_after_last_success(spark, sf):
    e = t(spark, sf, "events").select("user_id", "event_id", (F.col("event_type") != "error").alias("ok"))
    return paging.failures_since_success(e, ["user_id"], "event_id", "ok")


@query("""WITH w AS (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda s: s <> '') AS l FROM conversations)
 SELECT conv_id, turn, array_to_string(list_filter(l, lambda s, i: list_position(l, s) = i)[1:8], '|') AS firsts FROM w""")
def array_ops(spark, sf):
    """The first eight distinct words of every turn, in order."""
    words = F.filter(F.split("text", " "), lambda s: s != "")
    return t(spark, sf, "conversations").select("conv_id", "turn", F.array_join(F.slice(F.array_distinct(words), 1, 8), "|").alias("firsts"))


_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


@query(f"""SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM
 (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round({_DOT.format("a.embedding", "b.embedding")} / (sqrt({_DOT.format("a.embedding", "a.embedding")}) * sqrt({_DOT.format("b.embedding", "b.embedding")})), 5) AS score
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)) WHERE rank <= 3""")
def cosine_topk(spark, sf):
    """The three nearest vectors of the same kind, for each vector whose id is divisible by 50."""
    e = t(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    return joins.nearest_vectors(e, "label", "vec_id", "embedding", F.col("vec_id") % 50 == 0, 3, 5).select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))
