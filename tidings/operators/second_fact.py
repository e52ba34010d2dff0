"""The second fact: rows made from matched messages, one a message, put in, overwritten or taken out."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.functions.text import clean_lines, strip_emoji
from tidings.operators.incidents import region_label, said_regions

# The conditions that go to the second fact, and the words of its news.
CONDITIONS = (35, 36, 38, 45)
OVER, IN_DISTRICT, TO_VERIFY, CAUTION = "فوق", "في قضاء", "الموقع بحاجة إلى التحقق", ("حيطة", "حذر", "حيطة وحذر")
LINKS = ("source_link", "link", "url", "post_url")


def _said(payload: Column, *names: str) -> Column:
    """The first of these fields that is not empty."""
    return F.coalesce(*(F.nullif(F.get_json_object(payload, f"$.{n}"), F.lit("")) for n in names))


def news(text: Column, payload: Column, action: Column, place: Column, district: Column) -> Column:
    """Readable news: the text without decoration; for texts read from pictures a sentence of action, place and district, or that the place is to be verified."""
    read = _said(payload, "ocr_text").isNotNull() & action.isNotNull()
    text = F.coalesce(text, F.lit(""))
    caution = F.when(F.contains(text, F.lit(CAUTION[0])) & F.contains(text, F.lit(CAUTION[1])), F.lit(f" - {CAUTION[2]}")).otherwise("")
    sentence = F.concat(action, F.lit(f" {OVER} "), place, F.lit(f" {IN_DISTRICT} "), district, caution)
    return F.when(read & place.isNull(), F.concat(action, F.lit(f" - {TO_VERIFY}"))).when(read, clean_lines(sentence)).otherwise(clean_lines(strip_emoji(text)))


def rows_of(messages: DataFrame, matches: DataFrame, places: DataFrame, actions: DataFrame, zone: str) -> DataFrame:
    """The row of each message that matches a condition of the second fact.

    messages: (message_id, source_id, text, at, payload as JSON); matches: (message_id, condition_id, places: an array with nulls for names that matched nothing), one a message; places: (place_id, place, region); actions: (condition_id, action). The first place that is not null counts; if it is unknown, the message gives no row, without any it gives one without a place. The region is the one that the text names, `Multiple regions` if it names more, else the place's own. Time is local. Null texts are empty; a null time gives null day, clock and month.
    """
    m = matches.where(F.col("condition_id").isin(*CONDITIONS)).select("message_id", "condition_id", F.get(F.filter("places", lambda p: p.isNotNull()), 0).alias("place_id"))
    known = places.select("place_id", F.col("place").alias("_place"), F.col("region").alias("_own"), F.lit(True).alias("_known"))
    x = messages.join(m, "message_id").join(known, "place_id", "left").where("place_id is null or _known").join(actions, "condition_id", "left")
    x = x.join(said_regions(x.select("message_id", "text"), "message_id", "text", places, "region"), "message_id", "left")
    local, payload = F.from_utc_timestamp("at", zone), F.col("payload")
    return x.select(
        "message_id",
        "condition_id",
        "source_id",
        region_label().alias("region"),
        F.date_format(local, "MMMM").alias("month"),
        F.date_format(local, "yyyy-MM-dd").alias("day"),
        F.date_format(local, "HH:mm:ss").alias("clock"),
        news(F.col("text"), payload, F.col("action"), F.col("_place"), F.col("_own")).alias("news"),
        _said(payload, "note_1", "note").alias("note_1"),
        F.get_json_object(payload, "$.note_2").alias("note_2"),
        _said(payload, *LINKS).alias("link"),
    )


def upsert(stored: DataFrame, new: DataFrame, discarded: DataFrame) -> DataFrame:
    """stored after new rows and discards, with `change`: `inserted`, `updated` (a row of the same message is overwritten whole, also by nulls), `discarded` or `kept`. Rows that were typed in by hand have no message and stay. One row a message on each side; a message that is both new and discarded is discarded. Only a join by message: a table of many hand-typed rows has no hot key, as these do not join."""
    fields = [c for c in stored.columns if c != "message_id"]
    gone = discarded.select("message_id").where("message_id is not null").distinct().withColumn("_gone", F.lit(True))
    old = stored.where("message_id is not null").select("message_id", F.struct(*fields).alias("_old"))
    got = old.join(new.select("message_id", F.struct(*fields).alias("_new")), "message_id", "full").join(gone, "message_id", "left")
    change = F.when(F.col("_gone"), F.when(F.col("_old").isNotNull(), "discarded")).when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "kept").otherwise("updated")
    row = F.coalesce(F.when(F.col("_gone"), F.col("_old")).otherwise(F.col("_new")), "_old")
    keyed = got.select("message_id", change.alias("change"), row.alias("_r")).where("change is not null").select("message_id", "_r.*", "change")
    return keyed.unionByName(stored.where("message_id is null").withColumn("change", F.lit("kept")))
