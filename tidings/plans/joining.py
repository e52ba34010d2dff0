"""Anti, semi, self, interval, as-of, nearest-string and name joins."""

from pyspark.sql import functions as F

from tidings.functions import similarity as sim
from tidings.operators import joins
from tidings.plans.registry import query
from tidings.sources.tables import table as t


@query("SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > 250000 WHERE o_orderkey IS NULL")
def anti_null_join(spark, sf):
    c, o = t(spark, sf, "customer"), t(spark, sf, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 250000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def anti_not_exists(spark, sf):
    return t(spark, sf, "documents").join(t(spark, sf, "labels").where("quality = 1"), "doc_id", "left_anti").select("doc_id")


@query("SELECT d.doc_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1) AS toxic FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def semi_exists(spark, sf):
    d, lab = t(spark, sf, "documents"), t(spark, sf, "labels")
    toxic = lab.where("toxic = 1").select("doc_id").distinct().withColumn("toxic", F.lit(True))
    return d.join(lab, "doc_id", "left_semi").join(toxic, "doc_id", "left").select("doc_id", F.coalesce("toxic", F.lit(False)).alias("toxic"))


def edges(spark, sf):
    """A forest of copies: a line's child is the line of the same order and part before it; the rest point at odd partners, some in pairs."""
    li = t(spark, sf, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_orderkey") * 10 + F.when(F.col("l_partkey") % 3 == 0, F.col("l_linenumber") + 1).otherwise(F.col("l_linenumber") - 1)).alias("of"), "l_returnflag")


_EDGES = "(SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey * 10 + CASE WHEN l_partkey % 3 = 0 THEN l_linenumber + 1 ELSE l_linenumber - 1 END AS of, l_returnflag FROM lineitem)"


@query(f"SELECT a.id, b.id AS original, b.l_returnflag AS flag FROM {_EDGES} a JOIN {_EDGES} b ON a.of = b.id WHERE b.l_returnflag <> 'R'")
def self_join_parent(spark, sf):
    x = edges(spark, sf)
    b = x.select(F.col("id").alias("original"), F.col("l_returnflag").alias("flag")).where("flag <> 'R'")
    return x.join(b, x["of"] == b["original"]).select("id", "original", "flag")


@query(f"SELECT a.id AS a, b.id AS b FROM {_EDGES} a JOIN {_EDGES} b ON a.of = b.id AND b.of = a.id WHERE a.id < b.id")
def two_cycle_pairs(spark, sf):
    x = edges(spark, sf)
    a, b = x.select(F.col("id").alias("a"), F.col("of").alias("b")), x.select(F.col("id").alias("b"), F.col("of").alias("a"))
    return a.join(b, ["a", "b"]).where("a < b")


@query(f"SELECT a.id FROM {_EDGES} a JOIN {_EDGES} b ON a.of = b.id WHERE b.l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = b.id // 10 AND o_orderstatus = 'F')")
def orphan_monitor(spark, sf):
    """Copies whose original never became a final order."""
    x = edges(spark, sf)
    b = x.where("l_returnflag = 'R'").select(F.col("id").alias("original"), F.floor(F.col("id") / 10).alias("o"))
    done = t(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("o"))
    return x.join(b.join(done, "o", "left_anti"), x["of"] == b["original"]).select("id")


@query("""SELECT e.event_id, strftime(max(p.ts), '%Y-%m-%d %H:%M:%S') AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') e
 LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') p ON p.user_id = e.user_id AND p.ts <= e.ts AND p.ts >= e.ts - INTERVAL 6 HOUR GROUP BY e.event_id""")
def asof_latest_in_range(spark, sf):
    e = t(spark, sf, "events")
    out = joins.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen")), "event_id", "ts", "seen", 6 * 3600, ["user_id"])
    return out.select("event_id", F.date_format("seen", "yyyy-MM-dd HH:mm:ss").alias("last_view"))


@query("""SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.event_id < b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 7200000000""")
def interval_join_window(spark, sf):
    e = t(spark, sf, "events")
    a = e.select("user_id", "event_type", F.col("event_id").alias("a"), F.col("ts").alias("ta"))
    b = e.select("user_id", "event_type", F.col("event_id").alias("b"), F.col("ts").alias("tb"))
    return joins.interval_join(a, b, ["user_id", "event_type"], "ta", "tb", 7200).where("a < b").select("a", "b")


_WORDS = ["license", "idiot", "rubbish", "apache", "trash"]


@query("SELECT doc_id, " + " OR ".join(f"contains(lower(text), '{w}')" for w in _WORDS) + " AS hit FROM documents")
def keyword_prefilter(spark, sf):
    return t(spark, sf, "documents").select("doc_id", joins.contains_any(F.lower("text"), _WORDS).alias("hit"))


def addresses(spark, sf):
    """Texts that name places, from what rows know."""
    o, c = t(spark, sf, "orders"), t(spark, sf, "customer")
    n = t(spark, sf, "nation").select("n_nationkey", F.lower("n_name").alias("place"))
    x = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    second = n.select(F.col("n_nationkey").alias("k2"), F.col("place").alias("place2"))
    x = x.withColumn("k2", (F.col("o_orderkey") % 40).cast("int")).join(second, "k2", "left")
    return x.select("o_orderkey", F.concat_ws(" ", F.lit("reported near"), "place", F.lit("and also"), F.coalesce("place2", F.lit("nowhere"))).alias("said"))


_SAID = """(SELECT o_orderkey, concat_ws(' ', 'reported near', lower(a.n_name), 'and also', coalesce(lower(b.n_name), 'nowhere')) AS said FROM orders JOIN customer ON o_custkey = c_custkey
 JOIN nation a ON c_nationkey = a.n_nationkey LEFT JOIN nation b ON b.n_nationkey = o_orderkey % 40)"""
_BOUNDARY = "regexp_matches(said, '(^|[^a-z0-9_])' || lower(n_name) || '($|[^a-z0-9_])')"


@query(f"SELECT o_orderkey, n_nationkey FROM (SELECT o_orderkey, n_nationkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY length(n_name) DESC, n_nationkey) AS r FROM {_SAID} JOIN nation ON {_BOUNDARY}) WHERE r = 1")
def boundary_longest_match(spark, sf):
    names = t(spark, sf, "nation").select("n_nationkey", F.lower("n_name").alias("name"))
    found = joins.named_in(addresses(spark, sf), "o_orderkey", F.col("said"), names, "name", longest=True)
    return joins.longest_name(found, "o_orderkey", "name", "n_nationkey").select("o_orderkey", "n_nationkey")


@query(f"""SELECT o_orderkey, CASE WHEN n IS NULL THEN 'default' WHEN n = 1 THEN one ELSE 'Multiple regions' END AS region FROM orders LEFT JOIN
 (SELECT o_orderkey AS k, count(DISTINCT r_name) AS n, min(r_name) AS one FROM {_SAID} JOIN nation ON {_BOUNDARY} JOIN region ON n_regionkey = r_regionkey WHERE length(n_name) >= 4 GROUP BY 1) ON k = o_orderkey""")
def multi_region_label(spark, sf):
    n, r = t(spark, sf, "nation"), t(spark, sf, "region")
    names = n.join(r, n.n_regionkey == r.r_regionkey).select(F.lower("n_name").alias("name"), "r_name").where("length(name) >= 4")
    found = joins.named_in(addresses(spark, sf), "o_orderkey", F.col("said"), names, "name").groupBy("o_orderkey").agg(F.count_distinct("r_name").alias("n"), F.min("r_name").alias("one"))
    label = F.when(F.col("n").isNull(), "default").when(F.col("n") == 1, F.col("one")).otherwise("Multiple regions")
    return t(spark, sf, "orders").select("o_orderkey").join(found, "o_orderkey", "left").select("o_orderkey", label.alias("region"))


@query("""WITH d AS (SELECT lower(p_brand) AS k, max(p_partkey) AS id FROM part GROUP BY 1), f AS (SELECT lower(p_type) AS k, max(p_partkey) AS id FROM part GROUP BY 1)
 SELECT l_orderkey, l_linenumber, coalesce(d.id, f.id) AS id FROM lineitem JOIN part p ON l_partkey = p_partkey LEFT JOIN d ON d.k = lower(CASE WHEN l_linenumber % 2 = 0 THEN p_type ELSE p_brand END) LEFT JOIN f ON f.k = lower(CASE WHEN l_linenumber % 2 = 0 THEN p_type ELSE p_brand END)""")
def lookup_two_keys(spark, sf):
    """A name looked up in a first and then a second column; of equal names the last wins."""
    p = t(spark, sf, "part")
    d = p.groupBy(F.lower("p_brand").alias("k")).agg(F.max("p_partkey").alias("id1"))
    f = p.groupBy(F.lower("p_type").alias("k")).agg(F.max("p_partkey").alias("id2"))
    li = t(spark, sf, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).withColumn("k", F.lower(F.when(F.col("l_linenumber") % 2 == 0, F.col("p_type")).otherwise(F.col("p_brand"))))
    return li.join(d, "k", "left").join(f, "k", "left").select("l_orderkey", "l_linenumber", F.coalesce("id1", "id2").alias("id"))


_TRI = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, CAST(length(w) AS BIGINT) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def _scored(extra: str) -> str:
    a, b = _TRI.format("n.n_name || ' ' || r.r_name"), _TRI.format("p_name")
    return f"""WITH m AS (SELECT n_nationkey, {a} AS ga FROM nation n JOIN region r ON n_regionkey = r_regionkey), d AS (SELECT p_partkey, {b} AS gb FROM part),
 s AS (SELECT n_nationkey, p_partkey, len(list_intersect(ga, gb)) AS k, len(ga) AS na, len(gb) AS nb FROM m, d),
 x AS (SELECT n_nationkey, p_partkey, k / CAST(na + nb - k AS DOUBLE) AS score FROM s WHERE k > 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY score DESC, p_partkey) AS rank FROM x) {extra}"""


def _mentions(spark, sf):
    n, r = t(spark, sf, "nation"), t(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.concat_ws(" ", "n_name", "r_name").alias("said"))


@query(_scored("SELECT n_nationkey, p_partkey, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 5"))
def trigram_similarity_topk(spark, sf):
    x = joins.nearest(_mentions(spark, sf), "n_nationkey", F.col("said"), t(spark, sf, "part"), "p_partkey", F.col("p_name"), 5)
    return x.withColumn("score", F.round("score", 6))


@query(_scored("SELECT n_nationkey, p_partkey, round(score, 6) AS score FROM r WHERE rank = 1 AND score >= 0.05"))
def trigram_top1(spark, sf):
    x = joins.nearest(_mentions(spark, sf), "n_nationkey", F.col("said"), t(spark, sf, "part"), "p_partkey", F.col("p_name"), 1, least=0.05)
    return x.select("n_nationkey", "p_partkey", F.round("score", 6).alias("score"))


@query(_scored("""SELECT m.n_nationkey, CASE WHEN score >= 0.12 THEN p_partkey END AS matched_id, round(coalesce(score, 0), 6) AS confidence,
 CASE WHEN score >= 0.2 THEN 'matched' WHEN score >= 0.12 THEN 'low_confidence' ELSE 'unmatched' END AS status FROM m LEFT JOIN (SELECT * FROM r WHERE rank = 1) q ON m.n_nationkey = q.n_nationkey"""))
def entity_resolution(spark, sf):
    from tidings.operators import resolution

    out = resolution.resolve(_mentions(spark, sf), "n_nationkey", F.col("said"), t(spark, sf, "part"), "p_partkey", F.col("p_name"), high=0.2, low=0.12)
    return out.withColumn("confidence", F.round("confidence", 6))


@query()
def word_similarity_topk(spark, sf):
    """Whole benchmark items within part names by word similarity: candidates share a trigram. Names are scored once however many parts bear them; of equal names only the five least parts can be among the best five."""
    b, p = t(spark, sf, "benchmark").select("item_id", "text"), t(spark, sf, "part").select("p_partkey", "p_name")
    names = p.select("p_name").distinct()
    pairs = joins.shared_trigrams(names, "p_name", F.col("p_name"), b, "item_id", F.col("text")).select("p_name", "item_id")
    scored = pairs.join(b, "item_id").select("item_id", "p_name", sim.word_similarity(F.col("p_name"), F.col("text")).alias("ws"), sim.coverage(F.col("p_name"), F.col("text")).alias("coverage"))
    least = joins.top_k(p, "p_name", 5, F.col("p_partkey")).drop("rank")
    scored = scored.join(least, "p_name").select("item_id", "p_partkey", "ws", "coverage")
    return joins.top_k(scored, "item_id", 5, F.desc("coverage"), F.desc("ws"), F.col("p_partkey"))


_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


@query(f"""SELECT a.vec_id AS a, b.vec_id AS b, round({_DOT.format("a.embedding", "b.embedding")} / (sqrt({_DOT.format("a.embedding", "a.embedding")}) * sqrt({_DOT.format("b.embedding", "b.embedding")})), 6) AS cosine
 FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id AND abs(a.vec_id - b.vec_id) <= 30""")
def cosine_pairs(spark, sf):
    """Cosine of vectors of the same place within a window."""
    e = t(spark, sf, "embeddings")
    a = e.select("label", F.col("vec_id").alias("a"), F.col("embedding").alias("x"), F.timestamp_seconds("vec_id").alias("ta"))
    b = e.select("label", F.col("vec_id").alias("b"), F.col("embedding").alias("y"), F.timestamp_seconds("vec_id").alias("tb"))
    return joins.interval_join(a, b, ["label"], "ta", "tb", 30).where("a < b").select("a", "b", F.round(sim.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


@query(f"""SELECT a, b, round(s, 6) AS score, CASE WHEN s >= 0.8 THEN 'merge' WHEN s >= 0.5 THEN 'flag' ELSE 'new' END AS tier FROM (
 SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM (SELECT a.vec_id AS a, b.vec_id AS b, 0.35 + 0.45 * ({_DOT.format("a.embedding", "b.embedding")} / (sqrt({_DOT.format("a.embedding", "a.embedding")}) * sqrt({_DOT.format("b.embedding", "b.embedding")})))
  + 0.2 * greatest(0.0, 1 - abs(a.vec_id // 10 - b.vec_id // 10) / 3.0) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id AND abs(a.vec_id // 10 - b.vec_id // 10) <= 3)) WHERE r = 1""")
def incident_score(spark, sf):
    """The best earlier or later event of the same place within three days, by weighted score."""
    from tidings.operators.resolution import event_score, score_tier

    e = t(spark, sf, "embeddings").withColumn("d", F.floor(F.col("vec_id") / 10))
    a = e.select("label", F.col("vec_id").alias("a"), F.col("embedding").alias("x"), F.col("d").alias("da"), F.timestamp_seconds(F.col("d") * 86400).alias("ta"))
    b = e.select("label", F.col("vec_id").alias("b"), F.col("embedding").alias("y"), F.col("d").alias("db"), F.timestamp_seconds(F.col("d") * 86400).alias("tb"))
    x = joins.interval_join(a, b, ["label"], "ta", "tb", 3 * 86400).where("a <> b")
    x = x.select("a", "b", event_score(F.lit(True), F.col("da") - F.col("db"), sim.cosine(F.col("x"), F.col("y"))).alias("s"))
    return joins.top_k(x, "a", 1, F.desc("s"), F.col("b")).select("a", "b", F.round("s", 6).alias("score"), score_tier(F.col("s")).alias("tier"))
