"""A push feed: bodies with one post or a list of posts, each accepted, turned away or set aside, none lost.

Parsing is permissive: what is no post becomes a row with a reason and the text as it came. Counters are taken while the rows
are written, by observed metrics.
"""

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidings.functions.text import id_prefix
from tidings.sources.cursor import CLASSIFICATION_KEYS

OUTCOMES = ("parsed", "blocked", "duplicate", "failed")
_FIELDS = ("external_message_id", "message_datetime", "raw_text", "source_platform", "source_name", "origin_account")


def _elements(body: Column) -> Column:
    """The texts of a body's posts; null where the body is no JSON object or list of values."""
    text = F.ltrim(body)
    listed = F.from_json(F.when(text.startswith("["), body).otherwise(F.concat(F.lit("["), body, F.lit("]"))), "array<string>")
    return F.when(F.try_parse_json(body).isNotNull() & text.rlike(r"^[\[{]"), listed)


def posts(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """(key, place, fields, classification, flagged, raw, reason): every post of every body with its place in it from 0. A missing platform is the prefix of the id, a missing account the source's name. reason tells why a row is no post: `malformed body`, `no object`, or the field that is missing or has another form."""
    def entry(raw: Column, bad: Column) -> Column:
        return F.struct(raw.alias("raw"), bad.alias("_bad"), F.when(bad.isNull(), F.from_json(raw, "map<string,string>")).alias("_all"))

    each = F.transform(_elements(F.col(body)), lambda r: entry(r, F.when(r.isNull() | ~F.ltrim(r).startswith("{"), "no object")))
    # in the generator, so that a body is read and parsed once, whatever is filtered later
    x = bodies.select(F.col(key), F.posexplode(F.coalesce(each, F.array(entry(F.col(body), F.lit("malformed body"))))).alias("place", "_e")).select(key, "place", "_e.*")
    got = {f: F.col("_all")[f] for f in _FIELDS}
    known = F.map_filter("_all", lambda k, v: k.isin(*CLASSIFICATION_KEYS))
    x = x.select(key, "place", "raw", "_bad", *(c.alias(f) for f, c in got.items()), F.when(F.size(known) > 0, known).alias("classification"))
    at = F.try_to_timestamp("message_datetime")
    reason = (
        F.when(F.col("_bad").isNotNull(), F.col("_bad"))
        .when(F.col("external_message_id").isNull(), "external_message_id")
        .when(at.isNull(), "message_datetime")
        .when(F.coalesce("source_name", F.lit("")) == "", "source_name")
    )
    platform = F.coalesce(F.nullif("source_platform", F.lit("")), id_prefix(F.col("external_message_id")))
    account = F.coalesce(F.nullif("origin_account", F.lit("")), F.col("source_name"))
    return x.select(
        key, "place", "external_message_id", at.alias("message_datetime"), "raw_text", platform.alias("source_platform"), "source_name", account.alias("origin_account"), "classification",
        F.coalesce(F.col("classification")["include"] == "false", F.lit(False)).alias("flagged"), "raw", reason.alias("reason"),
    )


def receive(bodies: DataFrame, key: str, body: str, blocked: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """posts() with an outcome: `failed` with a reason, `blocked` where (source_platform, origin_account) is listed, `duplicate` where the id exists or came before (by key and place), else `parsed`."""
    x = posts(bodies, key, body)
    bars = blocked.select("source_platform", "origin_account").distinct().withColumn("_barred", F.lit(True))
    x = x.join(bars, ["source_platform", "origin_account"], "left")
    x = x.withColumn("outcome", F.when(F.col("reason").isNotNull(), "failed").when(F.col("_barred"), "blocked")).drop("_barred")
    fresh = x.where("outcome is null").select(key, "place", "external_message_id")
    fresh = fresh if existing is None else fresh.join(existing.select("external_message_id").distinct(), "external_message_id", "left_anti")
    first = fresh.groupBy("external_message_id").agg(F.min(F.struct(key, "place")).alias("_f")).select("_f.*", F.lit(True).alias("_first"))
    x = x.join(first, [key, "place"], "left")
    return x.withColumn("outcome", F.coalesce("outcome", F.when(F.col("_first"), "parsed"), F.lit("duplicate"))).drop("_first")


def counters(received: DataFrame) -> DataFrame:
    """(platform, fetched, flagged, parsed, blocked, duplicate, failed) of received posts; without a platform `unknown`."""
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    return received.groupBy(F.lower(F.coalesce("source_platform", F.lit("unknown"))).alias("platform")).agg(F.count("*").alias("fetched"), F.count_if("flagged").alias("flagged"), *counts)


def observed(received: DataFrame, name: str = "push") -> tuple[DataFrame, Observation]:
    """The rows with an observation that counts them as they pass: read its `get` once they are written."""
    seen = Observation(name)
    return received.observe(seen, F.count(F.lit(1)).alias("fetched"), F.count_if("flagged").alias("flagged"), *(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES)), seen
