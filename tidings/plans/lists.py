"""List and detail views: star joins, predicates, ordering, paging."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidings.plans.registry import query
from tidings.sources.tables import table as t


def star(spark, sf):
    """Orders with what is known of their customer, nation and region."""
    o, c, n, r = (t(spark, sf, x) for x in ("orders", "customer", "nation", "region"))
    return o.join(c, o.o_custkey == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")


def listed(spark, sf):
    """The list's filter and projection."""
    rows = star(spark, sf).where("o_orderdate between timestamp_ntz'1995-01-01' and timestamp_ntz'1996-12-31'")
    rows = rows.where(F.col("c_name").ilike("%1%") | F.col("n_name").ilike("%an%") | F.col("o_orderpriority").ilike("%urgent%"))
    label = F.when(F.col("o_orderpriority").ilike("1-%"), "urgent").when(F.col("o_orderstatus") == "F", "final").when(F.col("o_orderstatus") == "O", "open")
    return rows.select("o_orderkey", F.coalesce("c_name", F.lit("unknown")).alias("customer"), F.coalesce("n_name", "r_name").alias("place"), label.alias("label"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_totalprice")


_STAR = "orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"
_FILTER = "o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31' AND (c_name ILIKE '%1%' OR n_name ILIKE '%an%' OR o_orderpriority ILIKE '%urgent%')"


@query(f"""SELECT o_orderkey, coalesce(c_name, 'unknown') AS customer, coalesce(n_name, r_name) AS place,
 CASE WHEN o_orderpriority ILIKE '1-%' THEN 'urgent' WHEN o_orderstatus = 'F' THEN 'final' WHEN o_orderstatus = 'O' THEN 'open' END AS label,
 strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice FROM {_STAR} WHERE {_FILTER}
 ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 25 OFFSET 25""")
def list_page(spark, sf):
    return listed(spark, sf).orderBy(F.col("day").desc_nulls_last(), F.desc("o_orderkey")).offset(25).limit(25)


@query(f"SELECT count(o_orderkey) AS total FROM {_STAR} WHERE {_FILTER}")
def list_total(spark, sf):
    return listed(spark, sf).agg(F.count("o_orderkey").alias("total"))


@query("SELECT strftime(max(greatest(o_orderdate, l_shipdate)), '%Y-%m-%d') AS latest FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def list_latest(spark, sf):
    o, li = t(spark, sf, "orders"), t(spark, sf, "lineitem")
    return o.join(li, o.o_orderkey == li.l_orderkey, "left").agg(F.date_format(F.max(F.greatest("o_orderdate", "l_shipdate")), "yyyy-MM-dd").alias("latest"))


@query("""SELECT event_id, CASE WHEN low THEN false ELSE true END AS matched, coalesce(low, false) AS needs_review, CASE WHEN low THEN 'possible' ELSE 'none' END AS mark
 FROM (SELECT event_id, CASE WHEN k % 7 = 0 THEN NULL ELSE k < 30 END AS low FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))""")
def list_verification_filter(spark, sf):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    low = F.when(k % 7 == 0, F.lit(None).cast("boolean")).otherwise(k < 30)
    x = t(spark, sf, "events").select("event_id", low.alias("low"))
    return x.select("event_id", F.when(F.col("low"), False).otherwise(True).alias("matched"), F.coalesce("low", F.lit(False)).alias("needs_review"), F.when(F.col("low"), "possible").otherwise("none").alias("mark"))


@query("SELECT o_orderkey, o_orderstatus, l_partkey, l_quantity FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_linenumber = 1) ON o_orderkey = l_orderkey")
def detail_view_1to1(spark, sf):
    o, first = t(spark, sf, "orders"), t(spark, sf, "lineitem").where("l_linenumber = 1")
    return o.join(first, o.o_orderkey == first.l_orderkey, "left").select("o_orderkey", "o_orderstatus", "l_partkey", "l_quantity")


@query("""SELECT l_orderkey, l_linenumber, p_name, CASE WHEN s_suppkey IS NOT NULL THEN coalesce(s_name, 'supplier') ELSE p_brand END AS origin
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey""")
def inner_inner_left_list(spark, sf):
    li, p, o, s = t(spark, sf, "lineitem"), t(spark, sf, "part"), t(spark, sf, "orders"), t(spark, sf, "supplier").where("s_acctbal > 0")
    x = li.join(p, li.l_partkey == p.p_partkey).join(o, li.l_orderkey == o.o_orderkey).join(s, li.l_suppkey == s.s_suppkey, "left")
    return x.select("l_orderkey", "l_linenumber", "p_name", F.when(F.col("s_suppkey").isNotNull(), F.coalesce("s_name", F.lit("supplier"))).otherwise(F.col("p_brand")).alias("origin"))


@query("""SELECT doc_id, CASE WHEN source ILIKE 'SRC1%' THEN 'first' WHEN source ILIKE 'src2' THEN 'second' WHEN lang = 'fr' THEN 'french' WHEN lang = 'de' THEN 'german'
 WHEN n_chars > 3000 THEN 'long' END AS label FROM documents""")
def case_source_label(spark, sf):
    s = F.col("source")
    label = F.when(s.ilike("SRC1%"), "first").when(s.ilike("src2"), "second").when(F.col("lang") == "fr", "french").when(F.col("lang") == "de", "german").when(F.col("n_chars") > 3000, "long")
    return t(spark, sf, "documents").select("doc_id", label.alias("label"))


@query("SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END, ''), nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END, ''), 'none') AS reference FROM documents")
def coalesce_nullif_reference(spark, sf):
    a = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source"))
    b = F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("lang"))
    return t(spark, sf, "documents").select("doc_id", F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")), F.lit("none")).alias("reference"))


@query("SELECT l_orderkey, l_linenumber, greatest(CASE WHEN l_quantity > 25 THEN l_quantity END, CASE WHEN l_tax > 0.04 THEN 100 * l_tax END) AS g FROM lineitem")
def greatest_ignore_null(spark, sf):
    g = F.greatest(F.when(F.col("l_quantity") > 25, F.col("l_quantity")), F.when(F.col("l_tax") > 0.04, 100 * F.col("l_tax")))
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", g.alias("g"))


@query("SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, count(*) AS n FROM lineitem GROUP BY ALL")
def least_greatest_pair(spark, sf):
    return t(spark, sf, "lineitem").groupBy(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey FROM part WHERE p_name ILIKE '%re_n%' OR p_brand ILIKE '%#3%' OR p_type ILIKE '%brass%'")
def ilike_multi(spark, sf):
    return t(spark, sf, "part").where(F.col("p_name").ilike("%re_n%") | F.col("p_brand").ilike("%#3%") | F.col("p_type").ilike("%brass%")).select("p_partkey")


@query("SELECT doc_id FROM documents WHERE text ILIKE '%license%' OR text ILIKE '%idiot%' OR text ILIKE '%| th%' OR text ILIKE '%@%'")
def ilike_any(spark, sf):
    return t(spark, sf, "documents").where("text ILIKE ANY ('%license%', '%idiot%', '%| th%', '%@%')").select("doc_id")


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('P') GROUP BY 1")
def in_not_in(spark, sf):
    x = t(spark, sf, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & ~F.col("o_orderstatus").isin("P"))
    return x.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT max(try_cast(x AS BIGINT)) AS cursor FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'x' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS x FROM orders) WHERE regexp_full_match(x, '[0-9]+')")
def digits_only_cast_max(spark, sf):
    from tidings.sources.cursor import resume_cursor

    k = F.col("o_orderkey").cast("string")
    return t(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("x"), k)).otherwise(k).alias("x")).agg(resume_cursor(F.col("x")).alias("cursor"))


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1994-03-01' AND CAST(o_orderdate AS DATE) <= DATE '1994-03-31'")
def date_closed_range(spark, sf):
    d = F.to_date("o_orderdate")
    return t(spark, sf, "orders").where((d >= F.lit("1994-03-01").cast("date")) & (d <= F.lit("1994-03-31").cast("date"))).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-08' + INTERVAL 1 DAY GROUP BY 1")
def ts_half_open_range(spark, sf):
    return t(spark, sf, "events").where("ts >= timestamp_ntz'2024-01-05' and ts < timestamp_ntz'2024-01-08' + interval 1 day").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 48 HOUR AND ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1")
def relative_window_as_of(spark, sf):
    as_of = "timestamp_ntz'2024-01-20 12:00:00'"
    return t(spark, sf, "events").where(f"ts >= {as_of} - interval 48 hours and ts <= {as_of}").groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT event_id FROM events WHERE (event_id % 11 = 0) OR NOT (event_type = 'view') OR value > 50")
def log_noise_filter(spark, sf):
    ext = F.when(F.col("event_id") % 11 != 0, F.col("event_id"))
    return t(spark, sf, "events").where(ext.isNull() | (F.col("event_type") != "view") | (F.col("value") > 50)).select("event_id")


@query("SELECT doc_id FROM documents WHERE NOT (source IN ('src1', 'src3') AND lang = 'en')")
def deny_list_two_keys(spark, sf):
    deny = spark.createDataFrame([("src1", "en"), ("src3", "en"), (None, "en")], "source string, lang string")
    return t(spark, sf, "documents").join(deny, ["source", "lang"], "left_anti").select("doc_id")


@query("SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS n FROM supplier ORDER BY n LIMIT 20 OFFSET 20")
def page_row_numbers(spark, sf):
    page, size = 2, 20
    rows = t(spark, sf, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").offset((page - 1) * size).limit(size)
    n = F.row_number().over(W.orderBy(F.desc("s_acctbal"), "s_suppkey"))
    return rows.select("s_suppkey", "s_name", (n + (page - 1) * size).cast("long").alias("n"))


@query("SELECT o_orderkey, greatest(0, CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * date_diff('day', o_orderdate, l_shipdate)) * 86400.0 AS seconds FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber = 1")
def duration_clamped(spark, sf):
    from tidings.functions.values import duration_seconds

    o, li = t(spark, sf, "orders"), t(spark, sf, "lineitem").where("l_linenumber = 1")
    x = o.join(li, o.o_orderkey == li.l_orderkey)
    ends = [F.when(F.col("o_orderkey") % 2 == 0, F.col(b)).otherwise(F.col(a)) for a, b in (("o_orderdate", "l_shipdate"), ("l_shipdate", "o_orderdate"))]
    return x.select("o_orderkey", duration_seconds(*ends).alias("seconds"))


@query("SELECT monthname(o_orderdate) AS month, count(*) AS n FROM orders GROUP BY 1")
def month_names(spark, sf):
    return t(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "MMMM").alias("month")).agg(F.count("*").alias("n"))


@query("""SELECT n_nationkey, coalesce(nullif(trim(CASE WHEN n_nationkey % 3 = 0 THEN ' ' ELSE n_name END), ''), nullif(trim(CASE WHEN n_nationkey % 6 <> 0 THEN r_name END), '')) AS label FROM nation LEFT JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 6 <> 0""")
def option_labels(spark, sf):
    n, r = t(spark, sf, "nation"), t(spark, sf, "region")
    x = n.join(r, n.n_regionkey == r.r_regionkey, "left")
    own, other = F.when(F.col("n_nationkey") % 3 == 0, F.lit(" ")).otherwise(F.col("n_name")), F.when(F.col("n_nationkey") % 6 != 0, F.col("r_name"))
    first = F.coalesce(F.nullif(F.trim(own), F.lit("")), F.nullif(F.trim(other), F.lit("")))
    return x.where(first.isNotNull()).select("n_nationkey", first.alias("label"))


@query("SELECT c_custkey, lower(c_mktsegment) = lower('Building') OR lower(c_name) = lower('CUSTOMER#000000007') AS named FROM customer")
def case_insensitive_equality(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", ((F.lower("c_mktsegment") == "building") | (F.lower("c_name") == F.lower(F.lit("CUSTOMER#000000007")))).alias("named"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 24 THEN 'day' WHEN c_acctbal < 168 THEN 'week' WHEN c_acctbal < 720 THEN 'month' ELSE 'older' END AS bucket FROM customer WHERE c_mktsegment ILIKE '%b%' AND c_nationkey = 3")
def user_filter_buckets(spark, sf):
    b = F.col("c_acctbal")
    bucket = F.when(b < 0, "debt").when(b < 24, "day").when(b < 168, "week").when(b < 720, "month").otherwise("older")
    return t(spark, sf, "customer").where(F.col("c_mktsegment").ilike("%b%") & (F.col("c_nationkey") == 3)).select("c_custkey", bucket.alias("bucket"))
