"""The second fact from matched messages."""

from pyspark.sql import functions as F

from tidings.operators import second_fact
from tidings.plans.registry import query
from tidings.sources.tables import table as t

_ACTIONS = {35: "تحليق", 36: "غارة", 38: "قصف"}


@query("""WITH s AS (SELECT o_orderkey AS k, o_custkey, o_orderdate, [35, 36, 38, 45, 12][o_orderkey % 5 + 1] AS c, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey // 5 % 28 END AS p FROM orders),
 n AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey), a AS (SELECT unnest([35, 36, 38]) AS c, unnest(['تحليق', 'غارة', 'قصف']) AS action),
 new AS (SELECT k, s.c, o_custkey AS source_id, CASE k % 6 WHEN 1 THEN 'ASIA' WHEN 2 THEN 'Multiple regions' ELSE r_name END AS region, strftime(o_orderdate + INTERVAL 2 HOUR, '%B') AS month, strftime(o_orderdate + INTERVAL 2 HOUR, '%Y-%m-%d') AS day, strftime(o_orderdate + INTERVAL 2 HOUR, '%H:%M:%S') AS clock,
  CASE WHEN k % 10 = 4 AND action IS NOT NULL THEN action || CASE WHEN p IS NULL THEN ' - الموقع بحاجة إلى التحقق' ELSE ' فوق ' || n_name || ' في قضاء ' || r_name || CASE WHEN k % 6 = 3 THEN ' - حيطة وحذر' ELSE '' END END
   ELSE 'report ' || k || ['', ' over Asia', ' over asia, Europe', ' حيطة وحذر', '', ''][k % 6 + 1] END AS news, CASE k % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS note_1, CASE WHEN k % 9 = 0 THEN 'z' END AS note_2, CASE k % 3 WHEN 0 THEN 'u' || k WHEN 1 THEN 'v' || k END AS link
  FROM s LEFT JOIN n ON n_nationkey = p LEFT JOIN a ON a.c = s.c WHERE s.c <> 12 AND (p IS NULL OR n_name IS NOT NULL)),
 old AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 8 < 3)
 SELECT k AS message_id, coalesce(new.c, 45) AS condition_id, CASE WHEN new.k IS NULL THEN -1 ELSE source_id END AS source_id, CASE WHEN new.k IS NULL THEN 'before' ELSE region END AS region, month, day, clock, CASE WHEN new.k IS NULL THEN 'old' ELSE news END AS news, note_1, note_2, CASE WHEN new.k IS NULL THEN 'w' ELSE link END AS link,
  CASE WHEN old.k IS NULL THEN 'inserted' WHEN new.k IS NULL THEN 'kept' ELSE 'updated' END AS change FROM new FULL JOIN old USING (k) WHERE k % 11 <> 0
 UNION ALL SELECT k, 45, -1, 'before', NULL, NULL, NULL, 'old', NULL, NULL, 'w', 'discarded' FROM old WHERE k % 11 = 0
 UNION ALL SELECT NULL, 45, -1, 'before', NULL, NULL, NULL, 'typed ' || p_partkey, NULL, NULL, 'w', 'kept' FROM part""")
def second_fact_upsert(spark, sf):
    """Matched messages put into the second fact, over rows of earlier runs and beside rows typed in by hand; one message in eleven is no longer one."""
    k = F.col("o_orderkey")
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (n + 1).cast("int"))
    orders = t(spark, sf, "orders")
    payload = F.to_json(
        F.struct(
            F.when(k % 10 == 4, "read").alias("ocr_text"),
            F.when(k % 4 == 0, "a").when(k % 8 == 1, "").alias("note_1"),
            F.when(k % 4 == 1, "b").alias("note"),
            F.when(k % 9 == 0, "z").alias("note_2"),
            F.when(k % 3 == 0, F.concat(F.lit("u"), k.cast("string"))).otherwise("").alias("link"),
            F.when(k % 3 == 1, F.concat(F.lit("v"), k.cast("string"))).alias("post_url"),
        )
    )
    said = pick(("", " over  Asia", " over asia, Europe", " حيطة  وحذر \U0001f600", "", "\n"), k % 6)
    messages = orders.select(k.alias("message_id"), F.col("o_custkey").alias("source_id"), F.concat(F.lit("report "), k.cast("string"), said).alias("text"), F.col("o_orderdate").alias("at"), payload.alias("payload"))
    place = F.floor(k / 5).cast("long") % 28
    matches = orders.select(k.alias("message_id"), pick((35, 36, 38, 45, 12), k % 5).alias("condition_id"), F.array(F.lit(None).cast("long"), F.when(k % 7 != 0, place), F.when(k % 7 != 0, place + 1)).alias("places"))
    n, r = t(spark, sf, "nation"), t(spark, sf, "region")
    places = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").cast("long").alias("place_id"), F.col("n_name").alias("place"), F.col("r_name").alias("region"))
    actions = spark.createDataFrame(list(_ACTIONS.items()), "condition_id int, action string")
    new = second_fact.rows_of(messages, matches, places, actions, "+02:00")
    kinds = dict(new.dtypes)
    values = {"condition_id": 45, "source_id": -1, "region": "before", "month": None, "day": None, "clock": None, "news": "old", "note_1": None, "note_2": None, "link": "w"}
    before = orders.where(k % 8 < 3).select(k.alias("message_id"), *(F.lit(v).cast(kinds[c]).alias(c) for c, v in values.items()))
    values.pop("news")
    typed = t(spark, sf, "part").select(F.lit(None).cast("long").alias("message_id"), F.concat(F.lit("typed "), F.col("p_partkey").cast("string")).alias("news"), *(F.lit(v).cast(kinds[c]).alias(c) for c, v in values.items()))
    return second_fact.upsert(before.unionByName(typed), new, orders.where(k % 11 == 0).select(k.alias("message_id")))
