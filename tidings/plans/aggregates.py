"""Summaries, counters, nested aggregates, dashboards, quality measures."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidings.functions.values import age_bucket
from tidings.plans.registry import query
from tidings.sources.tables import table as t


@query("SELECT c_custkey, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def feed_summary_left_group(spark, sf):
    c, o = t(spark, sf, "customer"), t(spark, sf, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_day"), F.count("o_orderkey").alias("n"))


@query("""SELECT d.source, d.lang, coalesce(l.toxic, 0) = 1 AS blocked, count(*) AS n, max(coalesce(l.quality, -1)) AS best, min(n_chars) AS shortest
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL""")
def content_source_summary(spark, sf):
    x = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left")
    g = x.groupBy("source", "lang", (F.coalesce("toxic", F.lit(0)) == 1).alias("blocked"))
    return g.agg(F.count("*").alias("n"), F.max(F.coalesce("quality", F.lit(-1))).alias("best"), F.min("n_chars").alias("shortest"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events WHERE event_type = 'error' ORDER BY ts DESC NULLS LAST, event_id DESC LIMIT 8")
def content_source_detail_top8(spark, sf):
    x = t(spark, sf, "events").where("event_type = 'error'").orderBy(F.col("ts").desc_nulls_last(), F.desc("event_id")).limit(8)
    return x.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("""SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, count(*) FILTER (WHERE user_id % 2 = 0) AS even, count(*) AS n FROM events GROUP BY 1""")
def filter_counts(spark, sf):
    return t(spark, sf, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("high"), F.count_if(F.col("user_id") % 2 == 0).alias("even"), F.count("*").alias("n"))


@query("SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1 HAVING sum(l_linenumber) = 10")
def having_exact_batches(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum("l_linenumber").alias("s")).where("s = 10").drop("s")


@query("""SELECT day, event_type AS platform, count(*) AS fetched, count(*) FILTER (WHERE value >= 20) AS parsed, count(*) FILTER (WHERE value < 20) AS failed
 FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN event_id % 10 = 0 THEN 'unknown' ELSE lower(event_type) END AS event_type, value FROM events) GROUP BY ALL""")
def platform_breakdown_map(spark, sf):
    """Counters of each platform as one map a day, opened again to rows."""
    p = F.coalesce(F.when(F.col("event_id") % 10 != 0, F.lower("event_type")), F.lit("unknown"))
    x = t(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), p.alias("platform"))
    x = x.agg(F.struct(F.count("*").alias("fetched"), F.count_if(F.col("value") >= 20).alias("parsed"), F.count_if(F.col("value") < 20).alias("failed")).alias("v"))
    maps = x.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("platform", "v"))).alias("breakdown"))
    return maps.select("day", F.explode("breakdown").alias("platform", "v")).select("day", "platform", "v.*")


@query("SELECT user_id, string_agg(x, ',' ORDER BY x) AS kinds FROM (SELECT DISTINCT user_id, lower(event_type) AS x FROM events) GROUP BY 1")
def distinct_sorted_array(spark, sf):
    return t(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set(F.lower("event_type"))), ",").alias("kinds"))


@query("SELECT DISTINCT source, lang FROM documents")
def distinct_pairs(spark, sf):
    return t(spark, sf, "documents").select("source", "lang").distinct()


@query("""WITH x AS (SELECT event_type, ts, value FROM events), l AS (SELECT event_type, max(ts) FILTER (WHERE value >= 50) AS done FROM x GROUP BY 1)
 SELECT x.event_type, count(*) FILTER (WHERE value >= 50) AS completed, count(*) FILTER (WHERE value < 5 AND (done IS NULL OR ts > done)) AS unresolved, count(*) FILTER (WHERE value BETWEEN 5 AND 10) AS running
 FROM x JOIN l ON x.event_type = l.event_type GROUP BY 1""")
def dashboard_metrics(spark, sf):
    """Completed, still unresolved failures (later than the feed's last completion), running."""
    x = t(spark, sf, "events")
    last = x.groupBy("event_type").agg(F.max(F.when(F.col("value") >= 50, F.col("ts"))).alias("done"))
    open_ = (F.col("value") < 5) & (F.col("done").isNull() | (F.col("ts") > F.col("done")))
    return x.join(last, "event_type").groupBy("event_type").agg(F.count_if(F.col("value") >= 50).alias("completed"), F.count_if(open_).alias("unresolved"), F.count_if(F.col("value").between(5, 10)).alias("running"))


@query("""SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN h <= 24 THEN 'Live' WHEN h <= 168 THEN 'Stale' ELSE 'Offline' END AS bucket FROM
 (SELECT user_id, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts))) / 3600000000.0 AS h FROM events WHERE event_type = 'purchase' GROUP BY 1)) GROUP BY 1""")
def freshness_buckets(spark, sf):
    last = t(spark, sf, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("last"))
    bucket = age_bucket(F.col("last"), F.lit("2024-01-31").cast("timestamp_ntz"), [(24, "Live"), (168, "Stale")], "Offline")
    return last.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("""SELECT source, count(*) AS total, count(*) FILTER (WHERE n_chars > 1000) AS active, count(*) FILTER (WHERE n_chars <= 1000) AS paused, count(DISTINCT lang) AS langs FROM documents GROUP BY 1""")
def source_summary(spark, sf):
    return t(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("n_chars") > 1000).alias("active"), F.count_if(F.col("n_chars") <= 1000).alias("paused"), F.count_distinct("lang").alias("langs"))


@query("""SELECT lang, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM
 (SELECT lang, count(*) FILTER (WHERE p AND q) AS tp, count(*) FILTER (WHERE p AND NOT q) AS fp, count(*) FILTER (WHERE NOT p AND q) AS fn
  FROM (SELECT lang, n_chars > 500 AS p, quality = 1 AS q FROM documents JOIN labels USING (doc_id)) GROUP BY lang) WHERE tp + fp + fn >= 3""")
def confusion_precision_recall(spark, sf):
    x = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id").select("lang", (F.col("n_chars") > 500).alias("p"), (F.col("quality") == 1).alias("q"))
    g = x.groupBy("lang").agg(F.count_if(F.col("p") & F.col("q")).alias("tp"), F.count_if(F.col("p") & ~F.col("q")).alias("fp"), F.count_if(~F.col("p") & F.col("q")).alias("fn")).where("tp + fp + fn >= 3")
    rate = lambda d: F.round(F.try_divide(F.col("tp"), d), 6)
    return g.select("lang", "tp", "fp", "fn", rate(F.col("tp") + F.col("fp")).alias("precision"), rate(F.col("tp") + F.col("fn")).alias("recall"))


@query("""SELECT w, count(*) AS n, count(DISTINCT doc_id) AS docs, CASE WHEN count(*) >= 100 THEN 'high' WHEN count(*) >= 10 THEN 'medium' ELSE 'low' END AS risk
 FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents WHERE lang = 'en') WHERE length(w) >= 6 GROUP BY w HAVING count(*) >= 3""")
def token_counts_risk(spark, sf):
    w = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    g = t(spark, sf, "documents").where("lang = 'en'").select("doc_id", w.alias("w")).where(F.length("w") >= 6).groupBy("w").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs")).where("n >= 3")
    return g.withColumn("risk", F.when(F.col("n") >= 100, "high").when(F.col("n") >= 10, "medium").otherwise("low"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS low, max(value) AS high, round(count(*) / (date_diff('second', min(ts), max(ts)) / 60.0), 6) AS per_minute FROM events GROUP BY 1")
def latency_statistics(spark, sf):
    minutes = F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")) / 60.0 if hasattr(F, "timestamp_diff") else F.expr("timestampdiff(SECOND, min(ts), max(ts)) / 60.0D")
    return t(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", 0.5), 6).alias("median"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.count("*") / minutes, 6).alias("per_minute"))


@query("SELECT verdict, backend, count(*) AS n FROM (SELECT CASE WHEN quality = 1 THEN 'relevant' ELSE 'rejected' END AS verdict, CASE WHEN toxic = 1 THEN 'rules' ELSE 'model' END AS backend FROM labels) GROUP BY ALL")
def relevance_batch_summary(spark, sf):
    return t(spark, sf, "labels").groupBy(F.when(F.col("quality") == 1, "relevant").otherwise("rejected").alias("verdict"), F.when(F.col("toxic") == 1, "rules").otherwise("model").alias("backend")).agg(F.count("*").alias("n"))


@query("""SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)) WHERE r = 1""")
def top_group_per_key(spark, sf):
    g = t(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return g.withColumn("r", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("n"), "event_type"))).where("r = 1").drop("r")


@query("""SELECT l_orderkey, l_linenumber, (CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END) + (CASE WHEN l_quantity > 0 THEN 1 ELSE 0 END) + (CASE WHEN trim(l_linestatus) <> '' THEN 1 ELSE 0 END) AS reported FROM lineitem""")
def reported_field_count(spark, sf):
    marks = F.array(F.when(F.col("l_returnflag") != "N", 1).otherwise(0), F.when(F.col("l_quantity") > 0, 1).otherwise(0), F.when(F.trim("l_linestatus") != "", 1).otherwise(0))
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.aggregate(marks, F.lit(0), lambda a, x: a + x).alias("reported"))


@query("SELECT l_orderkey, max(l_quantity) AS l_quantity, bool_or(l_tax > 0.05) AS taxed, first(l_returnflag ORDER BY l_linenumber, l_returnflag) FILTER (WHERE l_returnflag <> 'N') AS flag FROM lineitem GROUP BY 1")
def merge_max_bool_first(spark, sf):
    from tidings.operators.details import merge

    x = t(spark, sf, "lineitem").select("l_orderkey", "l_quantity", (F.col("l_tax") > 0.05).alias("taxed"), F.nullif("l_returnflag", F.lit("N")).alias("flag"), F.col("l_linenumber").cast("string").alias("_n"))
    return merge(x, ["l_orderkey"], [F.col("_n").cast("int"), F.col("flag")]).drop("_n")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN q IS NULL AND x IS NULL THEN NULL ELSE coalesce(q, 0) + coalesce(x, 0) END AS total
 FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 20 THEN l_quantity END AS q, CASE WHEN l_returnflag = 'R' THEN 1.0 END AS x FROM lineitem)""")
def safe_sum_rollup(spark, sf):
    from tidings.functions.values import null_sum

    total = null_sum(F.when(F.col("l_quantity") > 20, F.col("l_quantity")), F.when(F.col("l_returnflag") == "R", F.lit(1.0)))
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", total.alias("total"))


@query("SELECT l_orderkey, l_linenumber, nullif(CAST(l_returnflag = 'A' AS INTEGER) + CAST(l_tax > 0.06 AS INTEGER) + CAST(l_quantity > 45 AS INTEGER), 0) AS flags FROM lineitem")
def true_flag_count(spark, sf):
    from tidings.functions.values import true_count

    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", true_count(F.col("l_returnflag") == "A", F.col("l_tax") > 0.06, F.col("l_quantity") > 45).alias("flags"))
