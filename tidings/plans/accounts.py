"""Sign-in throttling and parked steps."""

from pyspark.sql import functions as F

from tidings.operators import throttles
from tidings.plans.registry import query
from tidings.sources.tables import table as t


@query("""WITH RECURSIVE x AS (SELECT event_id, user_id // 10 AS c, epoch_us(ts) AS t, CASE WHEN event_type IN ('error', 'view') OR user_id % 10 = 9 THEN 'failed' WHEN event_type = 'signup' THEN 'inactive' ELSE 'ok' END AS result,
  list_filter(['ip:' || (user_id // 10 * 3 + event_id % 3), 'device:' || (user_id // 10 * 4 + event_id // 3 % 4), CASE WHEN user_id % 10 <> 9 THEN 'account:' || user_id END], lambda k: k IS NOT NULL) AS ks,
  row_number() OVER (PARTITION BY user_id // 10 ORDER BY ts, event_id) AS n FROM events),
 r AS (SELECT DISTINCT c, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS VARCHAR) AS by_, CAST(NULL AS BIGINT) AS retry_after, CAST(MAP {} AS MAP(VARCHAR, STRUCT(f BIGINT, u BIGINT))) AS m FROM x
  UNION ALL SELECT c, n, event_id, CASE WHEN stop IS NOT NULL THEN 'blocked' WHEN lock IS NOT NULL THEN 'locked' ELSE result END, split_part(coalesce(stop.k, lock.k), ':', 1),
   CASE WHEN stop IS NOT NULL THEN greatest(1, CAST(floor((stop.u - t) / 1e6) AS BIGINT) + 1) WHEN lock IS NOT NULL THEN 14400 END,
   CASE WHEN stop IS NOT NULL THEN m ELSE map_concat(m, map_from_entries(list_transform(after, lambda a: (a.k, {'f': a.f, 'u': a.u})))) END FROM
  (SELECT *, list_filter(before, lambda b: b.u IS NOT NULL)[1] AS stop, list_filter(after, lambda a: result = 'failed' AND a.f >= 3)[1] AS lock FROM
  (SELECT *, list_transform(before, lambda b: {'k': b.k, 'f': CASE result WHEN 'ok' THEN 0 WHEN 'failed' THEN b.f + 1 ELSE b.f END, 'u': CASE WHEN result = 'failed' AND b.f + 1 >= 3 THEN t + 14400000000 END}) AS after FROM
  (SELECT x.*, r.m, list_transform(x.ks, lambda k: {'k': k, 'f': CASE WHEN r.m[k].u <= x.t THEN 0 ELSE coalesce(r.m[k].f, 0) END, 'u': CASE WHEN r.m[k].u > x.t THEN r.m[k].u END}) AS before FROM r JOIN x ON x.c = r.c AND x.n = r.n + 1))))
 SELECT event_id, outcome, by_ AS "by", retry_after FROM r WHERE n > 0""")
def login_throttle(spark, sf):
    """Attempts that address, device and account throttle together: three failures in a row lock each of them for four hours; one account in ten is unknown."""
    user, event = F.col("user_id"), F.col("event_id")
    group = F.floor(user / 10).cast("long")
    keys = {"ip": group * 3 + event % 3, "device": group * 4 + F.floor(event / 3).cast("long") % 4, "account": F.when(user % 10 != 9, user)}
    result = F.when(F.col("event_type").isin("error", "view") | (user % 10 == 9), "failed").when(F.col("event_type") == "signup", "inactive").otherwise("ok")
    return throttles.throttle(t(spark, sf, "events").withColumn("result", result), "event_id", "ts", "result", keys, "account", 3, 14400)


_KINDS, _SAID = ("ReadTimeout", "RuntimeError", "ValueError"), ("", "timed out", "bad json", "HTTP 503", "Connection reset by peer")


@query(f"""WITH f AS (SELECT *, ['ReadTimeout', 'RuntimeError', 'ValueError'][l_linenumber % 3 + 1] AS kind, {list(_SAID)}[l_partkey % 5 + 1] AS said FROM lineitem WHERE l_returnflag <> 'N'),
 g AS (SELECT *, kind = 'ReadTimeout' OR said IN ('timed out', 'HTTP 503', 'Connection reset by peer') AS soft, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) AS n FROM f),
 h AS (SELECT l_orderkey, count(*) FILTER (WHERE soft) AS more, max(soft) FILTER (WHERE n = 1) AS soft, max(kind) FILTER (WHERE n = 1) AS kind, max(said) FILTER (WHERE n = 1) AS said FROM g GROUP BY 1),
 p AS (SELECT o_orderkey, o_orderkey % 2 + coalesce(more, 0) AS retries, kind IS NOT NULL AS parked, o_orderkey % 7 = 0 AS done, CASE WHEN kind IS NULL THEN NULL WHEN NOT soft THEN CASE said WHEN '' THEN kind ELSE said END
  WHEN o_orderkey % 2 + more >= 3 THEN 'extraction: exceeded max retries (' || (o_orderkey % 2 + more) || ') — last error: ' || kind || CASE said WHEN '' THEN ' (no message)' ELSE ': ' || said END
  ELSE kind || ': ' || CASE said WHEN '' THEN 'timed out' ELSE said END END AS error FROM orders LEFT JOIN h ON l_orderkey = o_orderkey),
 d AS (SELECT *, coalesce(parked AND NOT done AND regexp_matches(error, 'readtimeout|connecttimeout|timeoutexception|timed out', 'i'), false) AS due FROM p)
 SELECT o_orderkey, CASE WHEN parked AND NOT (due AND retries < 3) THEN 'error' ELSE 'parsed' END AS status, retries, CASE WHEN due AND retries < 3 THEN NULL WHEN due AND NOT starts_with(error, 'extraction: exceeded max retries')
  THEN 'extraction: exceeded max retries (' || retries || ') — last error: RuntimeError: ' || error ELSE error END AS error FROM d""")
def retry_parking(spark, sf):
    """Messages parked after failed steps and queued again by a later sweep, three retries at most; returned lines are the failures, and one message in seven has its result already."""
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (n + 1).cast("int"))
    m = t(spark, sf, "orders").select("o_orderkey", F.lit("parsed").alias("status"), (F.col("o_orderkey") % 2).alias("retries"), F.lit(None).cast("string").alias("error"))
    f = t(spark, sf, "lineitem").where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", pick(_KINDS, F.col("l_linenumber") % 3).alias("kind"), pick(_SAID, F.col("l_partkey") % 5).alias("said"))
    parked = throttles.park(m, f, "o_orderkey", "kind", "said", ["l_linenumber", "l_partkey"], 3)
    return throttles.queue_again(parked, F.col("o_orderkey") % 7 == 0, 3)
