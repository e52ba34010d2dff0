"""Incidents out of messages: materialization by rules and by scores, and alerts to the second fact."""

from pyspark.sql import functions as F

from tidings.functions.text import content_hash
from tidings.operators import incidents, joins
from tidings.plans.joining import _BOUNDARY, _DOT, _SAID, addresses
from tidings.plans.registry import query
from tidings.sources.tables import table as t


def _matched_orders(spark, sf):
    """Orders as messages: two places each, a condition, and how sure each match is."""
    k = F.col("o_orderkey")
    status = F.when(k % 13 == 0, "unmatched").when(k % 7 == 0, "matched_low_confidence").otherwise("matched")
    second = F.struct(F.when(k % 40 < 25, (k % 40).cast("int")).alias("id"), F.when(k % 3 == 0, "unmatched").otherwise("matched").alias("status"))
    first = F.struct((F.col("o_custkey") % 25).cast("int").alias("id"), F.when(k % 17 == 0, "unmatched").otherwise("matched").alias("status"))
    condition = F.element_at(F.array(*map(F.lit, (12, 14, 35, 12))), (k % 4 + 1).cast("int"))
    at = F.col("o_orderdate") + F.make_dt_interval(hours=(k % 24).cast("int"))
    return t(spark, sf, "orders").select("o_orderkey", at.alias("at"), condition.alias("condition"), status.alias("status"), F.array(first, second).alias("places"), "o_orderpriority")


_ORDERS = """m AS (SELECT o_orderkey, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS tm, [12, 14, 35, 12][o_orderkey % 4 + 1] AS condition,
 CASE WHEN o_orderkey % 13 = 0 THEN 'unmatched' WHEN o_orderkey % 7 = 0 THEN 'low' ELSE 'matched' END AS status, o_custkey % 25 AS p1, o_orderkey % 17 <> 0 AS u1,
 o_orderkey % 40 AS p2, o_orderkey % 40 < 25 AND o_orderkey % 3 <> 0 AS u2, o_orderpriority AS text FROM orders),
 w AS (SELECT *, CASE WHEN status = 'unmatched' THEN 'unmatched_condition' WHEN condition = 35 THEN 'second_fact' WHEN NOT u1 AND NOT u2 THEN 'no_place' END AS why FROM m),
 x AS (SELECT *, row_number() OVER (PARTITION BY place, condition ORDER BY o_orderkey) AS n FROM (SELECT o_orderkey, epoch_us(tm) AS tm, condition, status = 'matched' AS sure, p1 AS place, text || CAST(tm AS DATE) AS h FROM w WHERE why IS NULL AND u1
  UNION SELECT o_orderkey, epoch_us(tm), condition, status = 'matched', p2, text || CAST(tm AS DATE) FROM w WHERE why IS NULL AND u2)),
 r AS (SELECT place, condition, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS o_orderkey, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS BIGINT) AS original, CAST([] AS STRUCT(k BIGINT, t BIGINT, h VARCHAR)[]) AS kept FROM x WHERE n = 1
  UNION ALL SELECT place, condition, n, o_orderkey, CASE WHEN hit IS NOT NULL THEN 'duplicate' WHEN old THEN 'same_hash' ELSE 'inserted' END, hit, CASE WHEN hit IS NULL AND NOT old THEN list_append(kept, {'k': o_orderkey, 't': tm, 'h': h}) ELSE kept END FROM
  (SELECT x.*, r.kept, CASE WHEN x.sure THEN list_filter(r.kept, lambda y: y.k <> x.o_orderkey AND abs(y.t - x.tm) <= 7200000000)[1].k END AS hit, len(list_filter(r.kept, lambda y: y.h = x.h)) > 0 AS old FROM r JOIN x ON x.place = r.place AND x.condition = r.condition AND x.n = r.n + 1)),
 g AS (SELECT o_orderkey, count(*) FILTER (WHERE outcome = 'inserted') AS ins, count(*) FILTER (WHERE outcome = 'same_hash') AS same, max_by(original, place) FILTER (WHERE outcome = 'duplicate') AS original FROM r WHERE n > 0 GROUP BY 1)"""


@query(f"""WITH RECURSIVE {_ORDERS} SELECT o_orderkey, CASE WHEN why IS NOT NULL THEN 'error' WHEN ins > 0 THEN 'parsed' WHEN same = 0 THEN 'duplicate' ELSE 'error' END AS status,
 CASE WHEN why IS NOT NULL THEN why WHEN ins = 0 AND same > 0 THEN 'exact_hash' END AS reason, CASE WHEN ins = 0 AND same = 0 THEN original END AS duplicate_of, coalesce(ins, 0) AS n_inserted FROM w LEFT JOIN g USING (o_orderkey)""")
def fast_materialization(spark, sf):
    """Each message's incidents by place, action and time, and what becomes of the message."""
    h = content_hash(F.col("o_orderpriority"), F.col("place"), F.col("condition"), F.col("at").cast("date"))
    return incidents.fast_materialize(_matched_orders(spark, sf), "o_orderkey", "at", "condition", "status", "places", h)


def _reports(spark, sf):
    """Vectors as reports: a place, a day, an action, figures; some without a vector, some with the text of others."""
    k = F.col("vec_id")
    return t(spark, sf, "embeddings").select(
        "vec_id", F.col("label").alias("place"), F.floor(k / 8).alias("day"), F.when(k % 3 == 0, 14).otherwise(12).alias("action"),
        F.when(k % 11 != 0, F.col("embedding")).alias("v"), (k % 2 == 0).alias("settled"), F.when(k % 3 == 0, F.floor(k / 24)).otherwise(k + 1000000).cast("string").alias("h"),
        F.when(k % 5 != 0, (k % 9).cast("int")).alias("deaths"), (k % 6).cast("int").alias("injuries"),
    )


def _fold(settled: bool) -> str:
    """SQL of the scored decisions: rows of each place one by one, with the incidents so far."""
    cosine = _DOT.format("y.v", "x.v") + " / (sqrt(" + _DOT.format("y.v", "y.v") + ") * sqrt(" + _DOT.format("x.v", "x.v") + "))"
    score = f"0.35 * (y.a = x.a)::INT + 0.45 * ({cosine}) + 0.20 * greatest(0.0, 1 - abs(y.d - x.d) / 3.0)"
    fixed = "vec_id % 2 = 0" if settled else "false"
    old = "false" if settled else "len(list_filter(r.kept, lambda y: y.h = x.h)) > 0"
    return f"""x AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY fixed DESC, vec_id) AS n FROM (SELECT vec_id, label AS place, vec_id // 8 AS d, CASE WHEN vec_id % 3 = 0 THEN 14 ELSE 12 END AS a,
  CASE WHEN vec_id % 11 <> 0 THEN embedding END AS v, CASE WHEN vec_id % 3 = 0 THEN vec_id // 24 ELSE vec_id + 1000000 END AS h, {fixed} AS fixed, CASE WHEN vec_id % 5 <> 0 THEN vec_id % 9 END AS deaths, vec_id % 6 AS injuries FROM embeddings)),
 r AS (SELECT place, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS vec_id, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS BIGINT) AS original, CAST(NULL AS DOUBLE) AS score, CAST([] AS STRUCT(k BIGINT, d BIGINT, a INTEGER, v FLOAT[], h BIGINT)[]) AS kept FROM x WHERE n = 1
  UNION ALL SELECT place, n, vec_id, o, CASE WHEN o IN ('merged', 'flagged') THEN k END, CASE WHEN o IN ('merged', 'flagged') THEN s END, CASE WHEN o IN ('inserted', 'flagged') THEN list_append(kept, {{'k': vec_id, 'd': d, 'a': a, 'v': v, 'h': h}}) ELSE kept END FROM
  (SELECT *, CASE WHEN s >= 0.6 THEN 'merged' WHEN old THEN 'same_hash' WHEN s >= 0.5 THEN 'flagged' ELSE 'inserted' END AS o FROM
  (SELECT *, best.s AS s, best.k AS k FROM (SELECT x.*, r.kept, {old} AS old, CASE WHEN NOT x.fixed AND x.v IS NOT NULL THEN
   list_sort(list_transform(list_filter(r.kept, lambda y: y.v IS NOT NULL AND abs(y.d - x.d) <= 3), lambda y: {{'s': {score}, 'k': y.k}}), 'DESC')[1] END AS best FROM r JOIN x ON x.place = r.place AND x.n = r.n + 1))))"""


@query(f"WITH RECURSIVE {_fold(False)} SELECT place, vec_id, outcome, original, round(score, 6) AS score FROM r WHERE n > 0")
def scored_materialization(spark, sf):
    """Reports merged into, flagged against or added to the incidents of their place, or skipped for their hash."""
    x = incidents.scored_decisions(_reports(spark, sf), "place", "vec_id", "day", "action", "v", hash_="h", high=0.6)
    return x.withColumn("score", F.round("score", 6))


_MERGED = """SELECT place, k AS vec_id, max(deaths) AS deaths, max(injuries) AS injuries, count(*) AS n_messages, bool_or(outcome = 'flagged') AS flagged FROM
 (SELECT r.place, CASE WHEN outcome = 'merged' THEN original ELSE r.vec_id END AS k, outcome, deaths, injuries FROM r JOIN x ON x.vec_id = r.vec_id WHERE r.n > 0 AND outcome <> 'same_hash') GROUP BY 1, 2"""


@query(f"WITH RECURSIVE {_fold(False)} {_MERGED}")
def merged_incidents(spark, sf):
    """The incidents of scored materialization with the largest figures of all that was merged into them."""
    x = _reports(spark, sf)
    return incidents.merged(incidents.scored_decisions(x, "place", "vec_id", "day", "action", "v", hash_="h", high=0.6), x, "place", "vec_id", ["deaths", "injuries"])


@query(f"WITH RECURSIVE {_fold(True)} {_MERGED}")
def late_details(spark, sf):
    """Details come late for odd reports: each is held against the settled incidents and the ones before it, merged and gone, flagged, or filled in."""
    x = _reports(spark, sf)
    return incidents.merged(incidents.scored_decisions(x, "place", "vec_id", "day", "action", "v", settled="settled", high=0.6), x, "place", "vec_id", ["deaths", "injuries"])


_REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
_CALLS = ("تحليق طيران حربي", "مُسيّرة في الأجواء", "AH-64 seen", "نرجو منكم ابلاغنا فورا طيران حربي", "no alert")


@query(f"""WITH s AS (SELECT o_orderkey, [35, 36, 38, NULL, NULL][o_orderkey % 5 + 1] AS kind, o_orderkey % 12 AS m, CASE WHEN o_orderkey % 4 <> 3 THEN said ELSE '' END AS said FROM {_SAID}),
 f AS (SELECT o_orderkey, first(n_nationkey ORDER BY length(n_name) DESC, n_nationkey) AS p FROM s JOIN nation ON {_BOUNDARY} GROUP BY 1),
 g AS (SELECT s.*, CASE m WHEN 7 THEN 7 WHEN 5 THEN o_orderkey % 25 WHEN 11 THEN 0 ELSE p END AS place, CASE m WHEN 7 THEN 'alias' WHEN 5 THEN 'hashtag' WHEN 11 THEN 'latin' ELSE 'name' END AS how,
  CASE o_orderkey % 6 WHEN 1 THEN {list(_REGIONS)}[o_orderkey % 5 + 1] WHEN 2 THEN 'Multiple regions' END AS said_region FROM s LEFT JOIN f USING (o_orderkey))
 SELECT o_orderkey, CASE WHEN ok THEN 'routed' ELSE 'rejected' END AS status, CASE WHEN kind IS NULL THEN 'no alert word' WHEN NOT ok THEN 'no place' END AS reason, kind, CASE WHEN ok THEN place END AS place_id, CASE WHEN ok THEN how END AS how,
 CASE WHEN ok THEN coalesce(said_region, r) END AS region, CASE WHEN ok THEN strftime(tm, '%B') END AS month, CASE WHEN ok THEN strftime(tm, '%Y-%m-%d') END AS day, CASE WHEN ok THEN strftime(tm, '%H:%M') END AS clock
 FROM (SELECT g.*, kind IS NOT NULL AND place IS NOT NULL AS ok, r_name AS r, o_orderdate + INTERVAL 2 HOUR AS tm FROM g JOIN orders USING (o_orderkey) LEFT JOIN nation ON n_nationkey = place LEFT JOIN region ON r_regionkey = n_regionkey)""")
def alert_routing(spark, sf):
    """Alert messages with their places, to rejected rows and rows of the second fact. Places are named by an alias, a hashtag before other names, words, or letters within a word; some texts name regions, one in four no place in words."""
    k = F.col("o_orderkey")
    call = F.element_at(F.array(*map(F.lit, _CALLS)), (k % 5 + 1).cast("int"))
    region = lambda n: F.initcap(F.element_at(F.array(*map(F.lit, _REGIONS)), (n % 5 + 1).cast("int")))
    more = [
        F.when(k % 12 == 7, F.lit("the Gulf-Coast road")).when(k % 12 == 5, F.concat(F.lit("#flight #nation_"), (k % 25).cast("string"))).when(k % 12 == 11, F.lit("overnation9wards")),
        F.when(k % 6 == 1, region(k)).when(k % 6 == 2, F.concat_ws(", ", region(k), region(k + 1))),
    ]
    said = addresses(spark, sf).join(t(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey")
    m = said.select("o_orderkey", "o_orderdate", F.concat_ws(" ", call, F.when(k % 4 != 3, F.col("said")), *more).alias("text"))
    n, r = t(spark, sf, "nation"), t(spark, sf, "region")
    names = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.col("n_name").alias("name"), "r_name", (F.col("n_nationkey") + 100).alias("code"))
    return incidents.route_alerts(m, "o_orderkey", "text", "o_orderdate", names, "n_nationkey", ["name"], ["name"], "r_name", "+02:00", "code", [("gulf coast", 107)])


_GRAMS = "flatten(list_transform(list_filter(regexp_split_to_array(lower(said), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, CAST(length(w) AS BIGINT) + 2), lambda i: substr('  ' || w || ' ', i, 3))))"


@query(f"""WITH s AS (SELECT o_orderkey, concat_ws(' ', CASE WHEN o_orderkey % 3 = 0 THEN 'update' END, substr(md5('a' || o_custkey % 25), 1, 10), substr(md5('b' || o_orderkey % 12), 1, 10) || CASE WHEN o_orderkey % 7 = 0 THEN 's' ELSE '' END) AS said, CAST(o_orderdate AS DATE) AS d FROM orders), k AS (SELECT said, l, list_distinct(l) AS g FROM (SELECT DISTINCT said, {_GRAMS} AS l FROM s)),
 c AS (SELECT a.said AS old, b.said AS new, a.g, b.l FROM k a, k b WHERE len(list_intersect(a.g, b.g)) >= 0.9 * len(a.g)),
 v AS (SELECT old, new, list_max(flatten(list_transform(range(1, len(l) + 1), lambda i: list_transform(range(i + CAST(floor(0.9 * len(g)) AS BIGINT) - 1, len(l) + 1), lambda j: len(list_intersect(list_distinct(l[i:j]), g)) / CAST(len(g) + len(list_distinct(l[i:j])) - len(list_intersect(list_distinct(l[i:j]), g)) AS DOUBLE))))) AS score FROM c),
 p AS (SELECT b.o_orderkey AS id, a.o_orderkey AS original, v.score FROM s b JOIN v ON v.new = b.said AND v.score >= 0.92 JOIN s a ON a.said = v.old AND a.o_orderkey <> b.o_orderkey AND abs(a.d - b.d) <= 2)
 SELECT id, original, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, original) AS n FROM p) WHERE n = 1 AND original < id""")
def near_dup_snapshot(spark, sf):
    """Messages whose best match within 48 hours, by how well its text occurs in theirs, is an earlier message: the best of all is taken first, and then it must be the lower id."""
    k, code = F.col("o_orderkey"), lambda x, n: F.substring(F.md5(F.concat(F.lit(x), n.cast("string"))), 1, 10)
    last = F.concat(code("b", k % 12), F.when(k % 7 == 0, "s").otherwise(""))
    said = F.concat_ws(" ", F.when(k % 3 == 0, "update"), code("a", F.col("o_custkey") % 25), last)
    m = t(spark, sf, "orders").select("o_orderkey", "o_orderdate", said.alias("said"))
    return joins.near_copies(m, "o_orderkey", "said", "o_orderdate").withColumn("score", F.round("score", 6))
