"""Normalizers and text checks over documents, pages and benchmark items."""

from pyspark.sql import functions as F

from tidings.functions import text as x
from tidings.plans.registry import query
from tidings.sources.html_cards import cards
from tidings.sources.tables import table as t


_W = r"[\t\n\x0b\f\r \x{0085}\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{3000}]"  # white space


def _sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_W}+|{_W}+$', '', 'g')"


def _sql_name(x: str, edge: str) -> str:
    """SQL of a normalized name: white space and edge signs go from the ends, runs of white space are one blank."""
    edge = edge.replace("'", "''")
    return _sql_strip(f"regexp_replace(trim({_sql_strip(x)}, '{edge}'), '{_W}+', ' ', 'g')")


@query(f"SELECT doc_id, {_sql_name('lower(text)', x.ENGLISH_EDGE)} AS s FROM documents")
def text_normalize_en(spark, sf):
    return t(spark, sf, "documents").select("doc_id", x.normalize_english(F.col("text")).alias("s"))


_MARKED = "'  ' || text || 'ًأهلآ ةـ  إلى'"


@query(f"SELECT doc_id, {_sql_name(f"translate(regexp_replace({_MARKED}, '{x.ARABIC_MARKS}', '', 'g'), '{x.ARABIC_FROM}', '{x.ARABIC_TO}')", x.ARABIC_EDGE)} AS s FROM documents")
def text_normalize_ar(spark, sf):
    return t(spark, sf, "documents").select("doc_id", x.normalize_arabic(F.concat(F.lit("  "), F.col("text"), F.lit("ًأهلآ ةـ  إلى"))).alias("s"))


@query(f"SELECT doc_id, regexp_replace(regexp_replace('a\U0001f6a8️' || text || '☀b', '{x.EMOJI}', '', 'g'), '{x.SELECTORS}', '', 'g') AS s FROM documents")
def emoji_strip(spark, sf):
    return t(spark, sf, "documents").select("doc_id", x.strip_emoji(F.concat(F.lit("a\U0001f6a8️"), F.col("text"), F.lit("☀b"))).alias("s"))


@query("SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(regexp_replace(l, '\\s+', ' ', 'g'))), lambda l: l <> ''), chr(10)) AS s FROM documents".replace("\\\\", "\\"))
def line_cleanup(spark, sf):
    return t(spark, sf, "documents").select("doc_id", x.clean_lines(F.col("text")).alias("s"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, 'Licensed under the Apache License.*$', ' ', 'gs'), '[#$%&*]{3}', ' ', 'g'), '\s+', ' ', 'g')) AS s FROM documents")
def boilerplate_strip(spark, sf):
    return t(spark, sf, "documents").select("doc_id", x.strip_boilerplate(F.col("text"), [r"(?s)Licensed under the Apache License.*$", r"[#$%&*]{3}"]).alias("s"))


@query(r"SELECT doc_id, trim(text) <> '' AND regexp_full_match(text, '[\x{0600}-\x{06FF}\x09-\x0D\x1C-\x1F\x20-\x7E]*', 's') AS valid FROM documents")
def valid_text(spark, sf):
    return t(spark, sf, "documents").select("doc_id", x.valid_text(F.col("text")).alias("valid"))


@query(r"SELECT doc_id, sha256(concat_ws('|', trim(regexp_replace(text, '\s+', ' ', 'g')), coalesce(source, ''), coalesce(lang, ''))) AS h FROM documents")
def exact_hash_key(spark, sf):
    return t(spark, sf, "documents").select("doc_id", x.content_hash(F.col("text"), F.col("source"), F.col("lang")).alias("h"))


@query("SELECT item_id, regexp_extract_all('#' || replace(text, ' th', ' #th'), '#([^\\s#]+)', 1) AS tags FROM benchmark".replace("\\\\", "\\"))
def hashtag_list(spark, sf):
    return t(spark, sf, "benchmark").select("item_id", x.hashtags(F.concat(F.lit("#"), F.replace("text", F.lit(" th"), F.lit(" #th")))).alias("tags"))


@query("SELECT doc_id, CASE WHEN strpos(text, 'Apache') > 0 THEN trim(substr(text, greatest(1, strpos(text, 'Apache') - 20), strpos(text, 'Apache') + 46 - greatest(1, strpos(text, 'Apache') - 20)), ' ' || chr(10)) END AS s FROM documents")
def window_around_hit(spark, sf):
    return t(spark, sf, "documents").select("doc_id", x.around(F.col("text"), "Apache").alias("s"))


@query("SELECT o_orderkey, CASE WHEN strpos(k, ':') > 0 THEN nullif(split_part(k, ':', 1), '') END AS prefix FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN ':' || o_orderkey WHEN o_orderkey % 3 = 1 THEN o_orderstatus || ':' || o_orderkey ELSE '7' END AS k FROM orders)")
def id_prefixes(spark, sf):
    k = F.col("o_orderkey").cast("string")
    v = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(":"), k)).when(F.col("o_orderkey") % 3 == 1, F.concat_ws(":", "o_orderstatus", k)).otherwise("7")
    return t(spark, sf, "orders").select("o_orderkey", x.id_prefix(v).alias("prefix"))


@query("SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_type || '-x' || p_brand, '[A-Za-z0-9]+|[^A-Za-z0-9]+'), lambda w: upper(w[1]) || lower(w[2:])), '') AS s FROM part")
def initcap_words(spark, sf):
    return t(spark, sf, "part").select("p_partkey", x.initcap_words(F.concat("p_type", F.lit("-x"), "p_brand")).alias("s"))


@query("SELECT doc_id, nullif(concat_ws(' | ', nullif(source, 'src1'), nullif(lang, 'en')), '') AS note FROM documents")
def note_append(spark, sf):
    return t(spark, sf, "documents").select("doc_id", x.append_note(F.nullif("source", F.lit("src1")), F.nullif("lang", F.lit("en"))).alias("note"))


@query()
def latin_place_token(spark, sf):
    return t(spark, sf, "documents").select("doc_id", x.latin_token(F.col("text")).alias("token"))


@query()
def alert_kinds(spark, sf):
    """Alert rules over whole documents that carry alert words and notices in turn before their own text."""
    from tidings.operators.resolution import alert_kind

    said = F.element_at(F.array(*map(F.lit, ("تحليق طيران حربي", "مُسيّرة في الأجواء", "AH-64 seen", "نرجو منكم ابلاغنا فورا طيران حربي", "no alert"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return t(spark, sf, "documents").select("doc_id", alert_kind(F.concat_ws(" ", said, "text")).alias("kind"))


@query("""SELECT page_id, page_id AS message_id, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(page_id % 1000 AS INTEGER)) AS message_datetime, url || chr(10) || 'page ' || page_id AS text,
 'https://example.org/c/' || page_id AS link, CASE WHEN page_id % 2 = 0 THEN ['https://example.org/' || page_id || '.png'] ELSE [] END AS image_urls FROM pages WHERE page_id % 7 <> 3 AND page_id % 11 <> 4
 UNION ALL SELECT page_id, -page_id, TIMESTAMP '2024-01-01 00:00:00', '', 'https://example.org/c/' || -page_id, [] FROM pages WHERE page_id % 5 = 1""")
def html_post_parse(spark, sf):
    """Message cards of whole pages: each page begins with a card around its own address, with a stray end tag, a second text node that does not count, and a photo on even pages; some have no number or no time and are dropped, some hold a second card without text."""
    k = F.col("page_id").cast("string")
    number = F.when(F.col("page_id") % 7 == 3, "x").otherwise(k)
    minute = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") % 1000 * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    time = F.when(F.col("page_id") % 11 == 4, F.lit("<time>now</time>")).otherwise(F.concat(F.lit('<time datetime="'), minute, F.lit('"></time>')))
    photo = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<a class='x tgme_widget_message_photo_wrap' style=\"width:9px;background-image:url('https://example.org/"), k, F.lit(".png')\"></a>"))).otherwise("")
    card = [F.lit('<div class="tgme_widget_message" data-post="c/'), number, F.lit('">'), time, F.lit('</span><div class="tgme_widget_message_text"><b>'), F.col("url"), F.lit("</b><br>page "), k]
    card += [F.lit('</div><div class="tgme_widget_message_text">not this</div>'), photo, F.lit("</div>")]
    second = F.when(F.col("page_id") % 5 == 1, F.concat(F.lit('<div class="tgme_widget_message" data-post="c/-'), k, F.lit('"><time datetime="2024-01-01T02:00:00+02:00"></time></div>'))).otherwise("")
    return cards(t(spark, sf, "pages").select("page_id", F.concat(*card, second, "html").alias("html")), "page_id", "html", "https://example.org/c")


_FEED_SQL = """
WITH e AS (SELECT event_id, event_type, value, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'user' || user_id END AS who FROM events)
SELECT CAST(event_id AS VARCHAR) AS external_message_id, event_type AS source_platform, who AS source_name, event_type AS origin_platform, who AS origin_account,
  'post ' || event_id AS raw_text, '2024-01-01T00:00:00Z' AS message_datetime, event_id % 2 = 0 AS included, CASE WHEN event_id % 3 = 0 THEN 'security' END AS event_domain,
  CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS n_kept
FROM e
"""


@query(_FEED_SQL)
def feed_records(spark, sf):
    """Records of a provider, some sent alone and some as an array, as canonical rows."""
    from tidings.sources.cursor import normalized, records

    e = t(spark, sf, "events")
    k = F.col("event_id")
    record = F.to_json(
        F.struct(
            k.alias("id"),
            F.concat(F.lit("x:"), k.cast("string")).alias("external_id"),
            F.col("event_type").alias("source_platform"),
            F.when(k % 4 != 0, F.concat(F.lit("user"), F.col("user_id").cast("string"))).alias("source_name"),
            F.concat(F.lit("post "), k.cast("string")).alias("post_text"),
            F.lit("2024-01-01T00:00:00Z").alias("post_date"),
            F.when(k % 2 == 0, F.lit(True)).alias("include"),
            F.when(k % 3 == 0, F.lit("security")).alias("event_domain"),
            F.when(k % 5 == 0, F.lit("a place")).alias("location"),
            F.lit("unknown").alias("category"),
        )
    )
    body = F.when(k % 2 == 0, record).otherwise(F.concat(F.lit(" ["), record, F.lit("]")))
    rows = normalized(records(e.select(body.alias("body")), "body"), "record")
    kept = F.col("classification")
    return rows.select(
        "external_message_id", "source_platform", "source_name", "origin_platform", "origin_account", "raw_text", "message_datetime",
        F.coalesce(kept["include"] == "true", F.lit(False)).alias("included"), kept["event_domain"].alias("event_domain"), F.coalesce(F.size(kept), F.lit(0)).alias("n_kept"),
    ).withColumn("n_kept", F.greatest("n_kept", F.lit(0)).cast("long"))
