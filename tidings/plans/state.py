"""Uniqueness, copies, clusters, nested documents, folds and streams."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidings.functions import similarity as sim
from tidings.functions import text as x
from tidings.functions import values as v
from tidings.operators import details, folds, graph, incidents, joins, records, relevance, resolution, runs
from tidings.plans.registry import query
from tidings.sources.snapshots import SnapshotTable
from tidings.sources.tables import table as t
from tidings.streaming import streams


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(trim(regexp_replace(text, '\\s+', ' ', 'g')))".replace("\\\\", "\\"))
def exact_dedup(spark, sf):
    return t(spark, sf, "documents").groupBy(x.content_hash(F.col("text")).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@query("""SELECT event_id FROM (SELECT event_id, k, row_number() OVER (PARTITION BY user_id, k ORDER BY event_id) AS n FROM (SELECT event_id, user_id, nullif(CAST(json_extract_string(props, '$.k') AS BIGINT) % 10, 0) AS k FROM events)) WHERE k IS NULL OR n = 1""")
def unique_key_dedup(spark, sf):
    """First row of each (user, key); rows without a key never collide."""
    k = F.nullif(F.get_json_object("props", "$.k").try_cast("bigint") % 10, F.lit(0))
    return records.unique(t(spark, sf, "events").select("event_id", "user_id", k.alias("k")), ["user_id", "k"], [F.col("event_id")]).select("event_id")


@query("""WITH d AS (SELECT DISTINCT source, lang FROM documents WHERE source IN ('src1', 'src2')), base AS (SELECT row_number() OVER (ORDER BY source, lang) AS id, source, lang FROM d),
 n AS (SELECT DISTINCT source, lang FROM documents WHERE source <> '' AND lang <> '' AND source NOT IN ('src1', 'src2'))
 SELECT id, source, lang FROM base UNION ALL SELECT row_number() OVER (ORDER BY source, lang) + (SELECT max(id) FROM base), source, lang FROM n""")
def get_or_create_dim(spark, sf):
    d = t(spark, sf, "documents").select("source", "lang")
    base = d.where("source in ('src1', 'src2')").distinct().withColumn("id", F.row_number().over(W.orderBy("source", "lang")).cast("long"))
    return records.get_or_create(base, "id", ["source", "lang"], d)


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def upsert_latest(spark, sf):
    return records.latest(t(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'P') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_tax > 0.07)")
def live_view(spark, sf):
    o, li = t(spark, sf, "orders"), t(spark, sf, "lineitem")
    hard = o.where("o_orderstatus = 'P'").select("o_orderkey")
    soft = li.where("l_returnflag = 'R' and l_tax > 0.07").select(F.col("l_orderkey").alias("o_orderkey"))
    return records.live(o, hard.unionByName(soft), ["o_orderkey"]).select("o_orderkey")


@query("""SELECT c_custkey, 'c_mktsegment' AS field, c_mktsegment AS old_value, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'NEW' END AS new_value FROM customer WHERE c_custkey % 2 = 0 AND c_mktsegment IS DISTINCT FROM (CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'NEW' END)""")
def audit_diff(spark, sf):
    old = t(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    seg = F.when(F.col("c_custkey") % 4 == 0, F.lit(None).cast("string")).when(F.col("c_custkey") % 2 == 0, "NEW").otherwise(F.col("c_mktsegment"))
    return records.diff(old, old.withColumn("c_mktsegment", seg), "c_custkey")


@query()
def near_dup_sequential(spark, sf):
    """Order-dependent near copies of each supplier's parts over the first lines of all orders; a supplier's rows are cut at time gaps wider than the window."""
    li, p = t(spark, sf, "lineitem"), t(spark, sf, "part")
    rows = li.where("l_linenumber = 1").join(p, li.l_partkey == p.p_partkey)
    return folds.near_copies_in_windows(rows, "l_suppkey", "l_orderkey", "p_name", "l_shipdate", 0.6, 400 * 86400)


def _messages(spark, sf):
    """Vectors as messages: two places each, a time, and whether the action is eligible."""
    e = t(spark, sf, "embeddings")
    return e.select("vec_id", "embedding", F.array(F.col("label"), (F.col("vec_id") % 7).cast("int") + 100).alias("places"), F.timestamp_seconds(F.col("vec_id") * 600).alias("at"), "label")


_PAIRS = "SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND (b.vec_id - a.vec_id) * 600 <= 18000 AND (a.label = b.label OR a.vec_id % 7 = b.vec_id % 7)"
_DOT = "list_sum(list_transform(list_zip({0}.embedding, {1}.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
_EDGES = f"SELECT p.a, p.b FROM ({_PAIRS}) p JOIN embeddings x ON x.vec_id = p.a JOIN embeddings y ON y.vec_id = p.b WHERE {_DOT.format('x', 'y')} / (sqrt({_DOT.format('x', 'x')}) * sqrt({_DOT.format('y', 'y')})) >= 0.3"
_LABELS = f"""WITH RECURSIVE e AS (SELECT a AS u, b AS v FROM ({_EDGES}) UNION SELECT b, a FROM ({_EDGES})), r AS (SELECT vec_id AS n, vec_id AS l FROM embeddings UNION SELECT e.v, r.l FROM r JOIN e ON e.u = r.n), c AS (SELECT n AS vec_id, min(l) AS label FROM r GROUP BY 1)"""


@query(_PAIRS)
def candidate_pairs_place_time(spark, sf):
    return graph.place_time_pairs(_messages(spark, sf), "vec_id", "places", "at", 300 * 60)


def _clusters(spark, sf):
    m = _messages(spark, sf)
    pairs = graph.place_time_pairs(m, "vec_id", "places", "at", 300 * 60)
    p = pairs.join(m.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), "a").join(m.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y")), "b")
    edges = p.where(sim.cosine(F.col("x"), F.col("y")) >= 0.3).select("a", "b")
    return m.join(graph.components(m, "vec_id", edges, "a", "b").withColumnRenamed("label", "cluster"), "vec_id")


@query(f"{_LABELS} SELECT vec_id, label AS cluster FROM c")
def cluster_components(spark, sf):
    return _clusters(spark, sf).select("vec_id", "cluster")


_REP = "SELECT vec_id, cluster, row_number() OVER (PARTITION BY cluster ORDER BY CASE vec_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 9 END, vec_id) = 1 AS is_rep FROM (SELECT vec_id, label AS cluster FROM c)"


def _represented(spark, sf):
    trust = F.when(F.col("vec_id") % 3 == 0, 0).when(F.col("vec_id") % 3 == 1, 1).otherwise(9)
    return graph.representatives(_clusters(spark, sf), "cluster", trust, F.col("at").asc_nulls_last(), F.col("vec_id"))


@query(f"{_LABELS} {_REP}")
def cluster_representative(spark, sf):
    return _represented(spark, sf).select("vec_id", "cluster", "is_rep")


@query(f"{_LABELS} {_REP}")
def cluster_sweeps(spark, sf):
    """The same clusters and representatives from three sweeps, each over its pending rows and what is stored."""
    m = _messages(spark, sf)
    trust = F.when(F.col("vec_id") % 3 == 0, 0).when(F.col("vec_id") % 3 == 1, 1).otherwise(9)
    turn, state = F.col("vec_id") * 7 % 3, None
    for n in range(3):
        known, pending = m.where(turn < n), m.where(turn == n)
        p = graph.new_pairs(pending, known, "vec_id", "places", "at", 300 * 60)
        p = p.join(m.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), "a").join(m.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y")), "b")
        edges = p.where(sim.cosine(F.col("x"), F.col("y")) >= 0.3).select("a", "b")
        state = graph.sweep(state, m, "vec_id", pending, edges, "a", "b", trust, F.col("at").asc_nulls_last(), F.col("vec_id"))
    return state.select("vec_id", F.col("label").alias("cluster"), "is_rep")


@query(f"""{_LABELS}, m AS (SELECT q.*, e.label AS p1, e.vec_id % 7 + 100 AS p2 FROM ({_REP}) q JOIN embeddings e USING (vec_id)), j AS (SELECT m.*, (m.p1 = r.p1)::INT + (m.p2 = r.p2)::INT AS k, r.vec_id AS rep FROM m JOIN m r ON r.cluster = m.cluster AND r.is_rep)
 SELECT vec_id, rep AS rep_id, CASE WHEN is_rep THEN 'representative' WHEN k = 0 THEN 'keep' WHEN k = 2 THEN 'duplicate' ELSE 'partial' END AS action FROM j""")
def cluster_subsumption(spark, sf):
    return graph.application(_represented(spark, sf), "cluster", "vec_id", "places").select("vec_id", "rep_id", "action")


@query("""WITH gone AS (SELECT event_id, user_id, event_type, ts FROM events WHERE event_id % 9 = 0), edge AS (SELECT event_id FROM gone WHERE event_id % 2 = 0),
 other AS (SELECT user_id, event_type, min(event_id) AS first_id FROM events WHERE event_id % 9 <> 0 GROUP BY ALL)
 SELECT g.event_id, coalesce(CASE WHEN g.event_id % 5 = 0 THEN g.event_id - 1 END, o.first_id) AS matched, 0.0 AS score FROM gone g LEFT JOIN other o ON o.user_id = g.user_id AND o.event_type = g.event_type WHERE g.event_id NOT IN (SELECT event_id FROM edge)""")
def representative_fallback_reconcile(spark, sf):
    """Removed rows without an edge get one: to their message's representative, else to the first other row of the same place."""
    e = t(spark, sf, "events")
    gone = e.where("event_id % 9 = 0")
    orphans = gone.join(gone.where("event_id % 2 = 0").select("event_id"), "event_id", "left_anti")
    other = e.where("event_id % 9 <> 0").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))
    link = F.when(F.col("event_id") % 5 == 0, F.col("event_id") - 1)
    return orphans.join(other, ["user_id", "event_type"], "left").select("event_id", F.coalesce(link, "first_id").alias("matched"), F.lit(0.0).alias("score"))


def _talks(spark, sf):
    c = t(spark, sf, "conversations")
    m = F.struct("turn", F.when(F.length("text") > 40, F.length("text").cast("int")).alias("matched_village_id"), F.when(F.col("role") == "user", "matched").otherwise("low_confidence").alias("village_match_status"))
    return c.groupBy("conv_id").agg(F.sort_array(F.collect_list(m)).alias("matches"))


@query("SELECT conv_id, bool_or(role = 'user' AND length(text) > 40) AS eligible FROM conversations GROUP BY 1")
def nested_exists_predicate(spark, sf):
    hit = F.exists("matches", lambda m: m["matched_village_id"].isNotNull() & (m["village_match_status"] == "matched"))
    return _talks(spark, sf).select("conv_id", hit.alias("eligible"))


@query("""SELECT conv_id, CASE WHEN conv_id % 2 = 1 THEN CASE WHEN conv_id % 3 = 0 THEN '' ELSE CAST(conv_id AS VARCHAR) END ELSE coalesce(string_agg(DISTINCT CAST(length(text) AS VARCHAR), ',' ORDER BY CAST(length(text) AS VARCHAR)) FILTER (WHERE length(text) > 40), '') END AS ids FROM conversations GROUP BY conv_id""")
def legacy_shape_upgrade(spark, sf):
    """Place ids from lists in even rows and from the older flat form in odd ones."""
    old = F.col("conv_id") % 2 == 1
    flat = F.when(old & (F.col("conv_id") % 3 != 0), F.col("conv_id").cast("int"))
    ids = resolution.place_ids(F.when(~old, F.col("matches")), flat)
    return _talks(spark, sf).select("conv_id", F.array_join(F.sort_array(F.transform(ids, lambda i: i.cast("string"))), ",").alias("ids"))


@query("SELECT conv_id, string_agg(role || ':' || length(text), ';' ORDER BY turn, length(text), role) AS mentions FROM conversations GROUP BY 1")
def explode_mentions(spark, sf):
    """Mentions opened to rows, resolved one by one and put together again in order."""
    c = t(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.length("text").alias("n"), "role"))).alias("m"))
    one = c.select("conv_id", F.posexplode_outer("m").alias("pos", "x")).select("conv_id", "pos", F.concat_ws(":", "x.role", "x.n").alias("s"))
    back = one.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("m"))
    return back.select("conv_id", F.array_join(F.transform("m", lambda y: y["s"]), ";").alias("mentions"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN 'flag=' || CAST(o_totalprice > 100000 AS INTEGER) || CASE WHEN o_orderkey % 2 = 0 THEN ',note=' || o_orderpriority ELSE '' END ELSE '' END AS section FROM orders")
def section_serialize(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", (F.col("o_orderstatus") != "O").alias("gate"), F.when(F.col("o_totalprice") > 100000, 1).otherwise(0).alias("flag"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("note"))
    m = details.sections({"a": ["flag", "note"]}, {"a": "gate"})
    return o.select("o_orderkey", F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("section"))


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'parsed' ELSE 'rejected' END AS status, quality IS NULL AS needs_review, CASE WHEN quality IS NOT NULL THEN 'upstream' WHEN contains(lower(text), 'the') THEN 'model' ELSE 'keyword' END AS route FROM documents LEFT JOIN labels USING (doc_id)")
def verdict_policy(spark, sf):
    d = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left")
    none = F.lit(None).cast("string")
    up = relevance.upstream(F.col("quality") == 1, none, none)
    p = relevance.policy(F.coalesce(up, F.lit("uncertain")))
    return d.select("doc_id", p["status"].alias("status"), p["needs_review"].alias("needs_review"), relevance.route(up, F.contains(F.lower("text"), F.lit("the"))).alias("route"))


@query("SELECT doc_id // 10 AS batch, doc_id AS id, CASE WHEN doc_id // 10 % 5 = 0 OR doc_id % 10 = 3 OR doc_id % 10 = 4 THEN 'uncertain' ELSE 'relevant' END AS verdict, CASE WHEN doc_id // 10 % 5 = 0 OR doc_id % 10 = 3 OR doc_id % 10 = 4 THEN 0.0 ELSE 0.5 END AS confidence FROM documents")
def answer_reconcile(spark, sf):
    """Batches of ten: one in five answers is malformed, item 3 is missing, item 4 has a bad verdict."""
    r = t(spark, sf, "documents").select(F.floor(F.col("doc_id") / 10).alias("batch"), F.col("doc_id").alias("id"))
    item = F.to_json(F.struct(F.col("id").alias("raw_message_id"), F.when(F.col("id") % 10 == 4, "maybe").otherwise("relevant").alias("verdict"), F.lit(0.5).alias("confidence")))
    a = r.where("id % 10 <> 3").groupBy("batch").agg(F.concat(F.lit('{"results": ['), F.array_join(F.collect_list(item), ","), F.lit("]}")).alias("raw"))
    return relevance.reconcile(r, a.withColumn("raw", F.when(F.col("batch") % 5 == 0, "{oops").otherwise(F.col("raw"))), "batch", "id", "raw")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 OR o_orderkey % 6 = 4 OR o_orderkey % 8 = 7 THEN 'unmatched_condition' WHEN o_orderkey % 8 IN (1, 3, 4) THEN 'second_fact' WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 3 OR o_orderkey % 11 = 2 THEN 'no_place' END AS reason FROM orders""")
def fast_path_reason(spark, sf):
    """Why a matched message can never become an incident. A condition that is no number is no condition; matches of low confidence count; code 45 belongs to the second fact only where messages are routed, not here; without a list the flat place counts, an empty list does not."""
    k = F.col("o_orderkey")
    status = F.when(k % 6 == 0, F.lit(None).cast("string")).when(k % 6 == 4, "unmatched").when(k % 6 == 2, "matched_low_confidence").otherwise("matched")
    condition = F.element_at(F.array(*map(F.lit, ("12", "35", "45", "36", "38", "7", "45", "x1"))), (k % 8 + 1).cast("int")).try_cast("int")
    one = F.struct(F.when(k % 5 != 0, 1).alias("id"), F.when(k % 7 == 3, "unmatched").when(k % 7 == 4, "matched_low_confidence").otherwise("matched").alias("status"))
    listed = F.when(k % 11 == 2, F.array().cast("array<struct<id: int, status: string>>")).when(k % 2 == 0, F.array(one))
    places = F.coalesce(listed, F.array(one))
    return t(spark, sf, "orders").select("o_orderkey", incidents.reason(condition, status, places).alias("reason"))


@query()
def category_wide(spark, sf):
    """Nested categories made from orders, as wide rows with totals."""
    k = F.col("o_orderkey").cast("int")
    counts = F.struct(*(((k + i) % 4).alias(c) for i, c in enumerate(details.COUNTS)))
    vehicles = F.struct(*((k % (i + 2) == 0).alias(f) for i, f in enumerate(details.VEHICLE_FLAGS)), *((k % 3).alias(c) for c in details.VEHICLE_COUNTS))
    keys = [*details.CASUALTIES, "vehicles", "emergency_civil_defense", "crossings_other", "warning_classification", *details.PLACES, "road_bridge"]
    names = F.array(*map(F.lit, ("litani bridge", "water road", "church", "school", "no_warning building", "", "olive", "mosque blocked")))
    name = lambda i: F.element_at(names, ((k + i) % 8 + 1).cast("int"))
    cats = F.map_from_entries(F.filter(F.array(*(F.when(k % (i + 2) < 2, F.struct(F.lit(c), F.struct(F.when(k % 2 == 0, "D").otherwise("I").alias("did"), name(i).alias("name"), counts.alias("casualties"), F.when(k % 3 != 0, vehicles).alias("vehicles")))) for i, c in enumerate(keys))), lambda e: e.isNotNull()))
    return details.widen(t(spark, sf, "orders").select("o_orderkey", cats.alias("c"), counts.alias("root")), "o_orderkey", "c", "root")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'la_did needs la' WHEN o_orderkey % 3 = 1 THEN 'la needs la_did,unknown field: zz' ELSE '' END AS errors FROM orders""")
def edit_validation(spark, sf):
    k = F.col("o_orderkey")
    old = F.create_map(F.lit("la"), F.lit("0"), F.lit("la_did"), F.lit(None).cast("string"))
    edit = F.when(k % 3 == 0, F.create_map(F.lit("la_did"), F.lit("D"))).when(k % 3 == 1, F.create_map(F.lit("la"), F.lit("1"), F.lit("zz"), F.lit("1"))).otherwise(F.create_map(F.lit("la"), F.lit("1"), F.lit("la_did"), F.lit("I")))
    return t(spark, sf, "orders").select("o_orderkey", F.array_join(details.edit_errors(old, edit, ["la", "la_did"], [], {"la_did": "la"}), ",").alias("errors"))


_GREEDY = """WITH RECURSIVE x AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t, event_id % 4 AS o, value >= 10 AS c, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events),
 r AS (SELECT user_id, event_type, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS original_id, CAST([] AS STRUCT(k BIGINT, t BIGINT, o BIGINT)[]) AS kept FROM x WHERE n = 1
  UNION ALL SELECT user_id, event_type, n, event_id, hit, CASE WHEN hit IS NULL AND c THEN list_append(kept, {'k': event_id, 't': t, 'o': o}) ELSE kept END FROM
  (SELECT x.user_id, x.event_type, x.n, x.event_id, x.t, x.o, x.c, r.kept, CASE WHEN x.c THEN list_filter(r.kept, lambda y: y.o <> x.o AND abs(y.t - x.t) <= 86400000000)[1].k END AS hit FROM r JOIN x ON x.user_id = r.user_id AND x.event_type = r.event_type AND x.n = r.n + 1))
 SELECT user_id, event_type, event_id, original_id FROM r WHERE n > 0"""


@query(_GREEDY)
def greedy_window_dedup(spark, sf):
    """Confident rows of another owner within a day of a kept one are its duplicates, in id order."""
    e = t(spark, sf, "events").withColumns({"o": F.col("event_id") % 4, "c": F.col("value") >= 10})
    return folds.dedup_in_windows(e, ["user_id", "event_type"], "event_id", "ts", "o", "c", 86400)


@query("""SELECT user_id, count(*) AS failures, CASE WHEN count(*) >= 5 THEN 'parked' ELSE 'retry' END AS state, count(*) FILTER (WHERE value < 5) AS requeued FROM events WHERE event_type = 'error' GROUP BY 1""")
def retry_cap_state(spark, sf):
    g = t(spark, sf, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("failures"), F.count_if(F.col("value") < 5).alias("requeued"))
    return g.select("user_id", "failures", F.when(F.col("failures") >= 5, "parked").otherwise("retry").alias("state"), "requeued")


@query("""WITH RECURSIVE x AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS failures, false AS locked, CAST(NULL AS BIGINT) AS until FROM x
  UNION ALL SELECT user_id, n, event_id, f, was IS NOT NULL, CASE WHEN was IS NOT NULL THEN was WHEN f >= 2 THEN t + 86400000000 END FROM
  (SELECT *, CASE WHEN was IS NOT NULL THEN before WHEN ok THEN 0 ELSE before + 1 END AS f FROM
  (SELECT x.*, CASE WHEN until IS NOT NULL AND x.t >= until THEN NULL ELSE until END AS was, CASE WHEN until IS NOT NULL AND x.t >= until THEN 0 ELSE failures END AS before FROM r JOIN x ON x.user_id = r.user_id AND x.n = r.n + 1)))
 SELECT user_id, event_id, failures, locked FROM r WHERE n > 0""")
def lockout_state(spark, sf):
    """Attempts of each user in order of time, with failures in a row and locks."""
    e = t(spark, sf, "events").select("user_id", "ts", (F.col("event_type") != "error").alias("ok"), "event_id")
    return folds.lockout(e, ["user_id"], "ts", "ok", "event_id", 2, 86400)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey WHEN o_orderkey % 4 = 1 THEN o_orderkey END AS n, CASE o_orderkey % 4 WHEN 2 THEN 'not a whole number: 1.5' END AS error FROM orders""")
def coerce_good_bad_rows(spark, sf):
    k = F.col("o_orderkey").cast("string")
    cell = F.when(F.col("o_orderkey") % 4 == 0, k).when(F.col("o_orderkey") % 4 == 1, F.concat(k, F.lit(".0"))).when(F.col("o_orderkey") % 4 == 2, "1.5").otherwise(" ")
    n, error = v.coerce_int(cell)
    return t(spark, sf, "orders").select("o_orderkey", n.alias("n"), error.alias("error"))


@query("""SELECT user_id, array_to_string(list_sort(list_intersect(a, b)), ',') AS both_, array_to_string(list_sort(list_filter(a, lambda y: NOT list_contains(b, y))), ',') AS only_a, len(list_distinct(list_concat(a, b))) AS n FROM
 (SELECT user_id, coalesce(list(DISTINCT event_type) FILTER (WHERE value > 30), []) AS a, coalesce(list(DISTINCT event_type) FILTER (WHERE value <= 30), []) AS b FROM events GROUP BY 1)""")
def set_algebra(spark, sf):
    g = t(spark, sf, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 30, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("value") <= 30, F.col("event_type"))).alias("b"))
    join = lambda c: F.array_join(F.sort_array(c), ",")
    return g.select("user_id", join(F.array_intersect("a", "b")).alias("both_"), join(F.array_except("a", "b")).alias("only_a"), F.size(F.array_union("a", "b")).cast("long").alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'y' ELSE o_orderstatus END AS a, 'z' AS b FROM orders")
def map_override(spark, sf):
    """Two maps where the right one wins: entries of the left that the right lacks, then the right."""
    left = F.create_map(F.lit("a"), F.col("o_orderstatus"))
    right = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("a"), F.lit("y"), F.lit("b"), F.lit("z"))).otherwise(F.create_map(F.lit("b"), F.lit("z")))
    m = F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)
    return t(spark, sf, "orders").select("o_orderkey", F.element_at(m, "a").alias("a"), F.element_at(m, "b").alias("b"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def stream_dedup(spark, sf):
    """Unique keys of a file stream, ingested exactly once into a snapshot table; of a batch's rows with one key that with the smallest id stays."""
    e = streams.read(spark, sf, "events").select("user_id", "event_type", "event_id")
    path = streams.folder(spark)
    table = SnapshotTable(spark, f"{path}/table", e.schema, ["user_id", "event_type"])
    streams.ingest(e, table, "events", [F.col("event_id")], f"{path}/checkpoint")
    return table.read()


@query("""SELECT event_id, CASE WHEN event_id > first THEN 'duplicate' ELSE 'pending' END AS status, nullif(first, event_id) AS duplicate_of FROM (SELECT event_id, min(event_id) OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE)) AS first FROM events)""")
def marked_duplicates(spark, sf):
    """Copies within a day marked in a snapshot table: all of them in one version, or none."""
    e = t(spark, sf, "events")
    table = SnapshotTable(spark, f"{streams.folder(spark)}/table", "event_id long, user_id long, event_type string, status string, duplicate_of long", ["event_id"])
    table.insert(e.select("event_id", "user_id", "event_type", F.lit("pending").alias("status"), F.lit(None).cast("long").alias("duplicate_of")), [F.col("event_id")])
    first = e.groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.min("event_id").alias("keep"))
    copies = e.withColumn("day", F.to_date("ts")).join(first, ["user_id", "event_type", "day"]).where("event_id > keep").select("event_id", "keep")
    table.change(copies, {"status": F.lit("duplicate"), "duplicate_of": F.col("w.keep")})
    return table.read().select("event_id", "status", "duplicate_of")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15'")
def stream_late_cutoff(spark, sf):
    return streams.drain(streams.late_cutoff(streams.read(spark, sf, "events"), "ts", "2024-01-15")).select("event_id")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def stream_upsert_latest(spark, sf):
    return streams.upsert(streams.read(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query(_GREEDY)
def stream_greedy(spark, sf):
    e = streams.read(spark, sf, "events").withColumns({"o": F.col("event_id") % 4, "c": F.col("value") >= 10})
    return streams.drain(streams.greedy(e, ["user_id", "event_type"], "event_id", "ts", "o", "c", 86400))


@query("""SELECT 'cut' AS stage, count(*) FILTER (WHERE value >= 1) AS n_out, count(*) AS n_in, round(sum(value) FILTER (WHERE value >= 1), 4) AS total, false AS failed FROM events
 UNION ALL SELECT 'first', count(DISTINCT user_id * 10 + CASE event_type WHEN 'view' THEN 1 WHEN 'signup' THEN 2 WHEN 'error' THEN 3 WHEN 'click' THEN 4 ELSE 5 END) FILTER (WHERE value >= 1), count(*) FILTER (WHERE value >= 1), NULL, false FROM events
 UNION ALL SELECT 'broken', 0, count(*) FILTER (WHERE value >= 1), NULL, true FROM events""")
def run_metrics(spark, sf):
    """Stages of a run, counted by observed metrics while their rows are written, and logged in a snapshot table; one stage fails and is logged as such."""
    path = streams.folder(spark)
    log = runs.RunLog(spark, f"{path}/log")
    e = t(spark, sf, "events")
    cut = log.stage("r1", "cut", e.select("user_id", "event_type", "event_id", "value"), lambda x: x.where("value >= 1"), f"{path}/cut", total=F.round(F.sum("value"), 4))
    log.stage("r1", "first", cut, lambda x: records.unique(x, ["user_id", "event_type"], [F.col("event_id")]), f"{path}/first")
    log.stage("r1", "broken", cut, lambda x: x.withColumn("bad", F.raise_error(F.concat(F.lit("row "), F.col("event_id").cast("string")))), f"{path}/broken")
    return log.table.read().select("stage", "n_in", "n_out", F.col("extra")["total"].cast("double").alias("total"), "failed")
