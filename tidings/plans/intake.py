"""What comes in: the push feed with what it sets aside, and relevance routing with a client that fails."""

from pyspark.sql import functions as F

from tidings.operators import relevance
from tidings.plans.registry import query
from tidings.sources import push
from tidings.sources.tables import table as t

_POSTS = """WITH e AS (SELECT event_id AS k, CASE WHEN event_id % 29 = 7 THEN NULL WHEN event_id % 13 = 5 THEN 'view:' || event_id // 2 ELSE 'm' || event_id // 2 END AS id, event_id % 23 <> 4 AS dated, event_id % 31 <> 9 AS named,
  CASE WHEN event_id % 13 = 5 THEN CASE WHEN event_id % 29 <> 7 THEN 'view' END WHEN event_id % 5 <> 1 THEN event_type END AS platform, 'user' || user_id AS name, user_id, event_id % 3 = 0 AS flagged, event_id % 37 = 11 AS broken, event_id % 41 = 6 AS odd FROM events),
 p AS (SELECT k, CASE WHEN broken OR odd THEN NULL ELSE platform END AS platform, NOT broken AND NOT odd AND flagged AS flagged, CASE WHEN broken THEN 'malformed body' WHEN odd THEN 'no object' WHEN id IS NULL THEN 'external_message_id' WHEN NOT dated THEN 'message_datetime' WHEN NOT named THEN 'source_name' END AS reason,
  id, NOT broken AND NOT odd AND platform = 'view' AND named AND user_id % 10 = 3 AS barred FROM e),
 q AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'failed' WHEN barred THEN 'blocked' WHEN row_number() OVER (PARTITION BY id, reason IS NULL AND NOT coalesce(barred, false) ORDER BY k) > 1 THEN 'duplicate' ELSE 'parsed' END AS outcome FROM p)
"""


def _bodies(spark, sf):
    """Events as pushed bodies: posts alone, in lists, broken, without fields; two events share an id, some name their platform in it only."""
    e, k = t(spark, sf, "events"), F.col("event_id")
    half = F.floor(k / 2).cast("string")
    id_ = F.when(k % 29 == 7, F.lit(None)).when(k % 13 == 5, F.concat(F.lit("view:"), half)).otherwise(F.concat(F.lit("m"), half))
    post = F.to_json(F.struct(
        id_.alias("external_message_id"), F.when(k % 23 != 4, F.lit("2024-01-01T00:00:00Z")).otherwise("soon").alias("message_datetime"), F.lit("text").alias("raw_text"),
        F.when((k % 13 != 5) & (k % 5 != 1), F.col("event_type")).alias("source_platform"), F.when(k % 31 != 9, F.concat(F.lit("user"), F.col("user_id").cast("string"))).otherwise("").alias("source_name"),
        F.when(k % 3 == 0, F.lit(False)).alias("include"), F.lit(1).alias("extra"),
    ))
    body = F.when(k % 37 == 11, F.concat(F.lit("{"), post)).when(k % 41 == 6, "[7]").when(k % 2 == 0, post).otherwise(F.concat(F.lit(" ["), post, F.lit("]")))
    blocked = e.where("user_id % 10 = 3").select(F.lit("view").alias("source_platform"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("origin_account"))
    return e.select(k, body.alias("body")), blocked


@query(_POSTS + "SELECT k AS event_id, platform AS source_platform, outcome, reason FROM q")
def push_feed(spark, sf):
    """Every pushed post with what became of it."""
    bodies, blocked = _bodies(spark, sf)
    return push.receive(bodies, "event_id", "body", blocked).select("event_id", "source_platform", "outcome", "reason")


@query(_POSTS + "SELECT k AS event_id, reason, 0 AS place FROM q WHERE outcome = 'failed'")
def push_rejected(spark, sf):
    """The posts set aside, with their reasons."""
    bodies, blocked = _bodies(spark, sf)
    return push.receive(bodies, "event_id", "body", blocked).where("outcome = 'failed'").select("event_id", "reason", "place")


@query(_POSTS + "SELECT coalesce(platform, 'unknown') AS platform, count(*) AS fetched, count(*) FILTER (WHERE flagged) AS flagged, " + ", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS {o}" for o in push.OUTCOMES) + " FROM q GROUP BY 1")
def push_counters(spark, sf):
    """What became of each platform's posts."""
    bodies, blocked = _bodies(spark, sf)
    return push.counters(push.receive(bodies, "event_id", "body", blocked))


_ROUTED = """WITH d AS (SELECT doc_id AS k, CASE WHEN doc_id % 6 = 0 THEN 'relevant' WHEN doc_id % 6 = 1 THEN 'not_relevant' END AS up, coalesce(contains(lower(text), 'the'), false) AS word, doc_id // 10 AS b FROM documents),
 s AS (SELECT *, CASE WHEN up IS NOT NULL THEN 'upstream' WHEN NOT word THEN 'keyword' ELSE 'model' END AS source FROM d),
 m AS (SELECT *, source = 'model' AND b % 7 IN (3, 6) AS failed, source = 'model' AND row_number() OVER (PARTITION BY b, source ORDER BY k) = 1 AS first, count(*) OVER (PARTITION BY b, source) AS n FROM s),
 r AS (SELECT k AS doc_id, source, CASE WHEN source = 'upstream' THEN up WHEN source = 'keyword' THEN 'not_relevant' WHEN failed THEN NULL WHEN k % 11 = 0 THEN 'uncertain' ELSE ['relevant', 'not_relevant', 'uncertain'][k % 3 + 1] END AS verdict,
  CASE WHEN source <> 'model' THEN 1.0 WHEN failed THEN NULL WHEN k % 11 = 0 THEN 0.0 ELSE k % 4 * 0.25 END AS confidence, CASE WHEN failed AND b % 7 = 3 THEN 'TimeoutError: no answer' WHEN failed THEN 'RuntimeError: ' || (n - 1) || ' answers for ' || n || ' messages' END AS error,
  CASE WHEN first THEN CASE WHEN b % 7 IN (3, 5, 6) THEN 2 ELSE 1 END ELSE 0 END AS calls FROM m)
"""


class _Client:
    """A client that fails by rule: always, at first, or with an answer too few."""

    def __init__(self):
        self.asked: set[int] = set()

    def __call__(self, rows):
        b = rows[0][0] // 10
        again = b in self.asked
        self.asked.add(b)
        if b % 7 == 3 or b % 7 == 5 and not again:
            raise TimeoutError("no answer")
        got = [("maybe" if k % 11 == 0 else relevance.VERDICTS[k % 3], k % 4 * 0.25) for k, _ in rows]
        return got[:-1] if b % 7 == 6 else got


def _routed(spark, sf):
    k = F.col("doc_id")
    d = t(spark, sf, "documents").select("doc_id", "text", F.when(k % 6 == 0, "relevant").when(k % 6 == 1, "not_relevant").alias("up"), F.contains(F.lower("text"), F.lit("the")).alias("word"), F.floor(k / 10).alias("b"))
    return relevance.routed(d, "doc_id", "text", "b", "up", "word", _Client)


@query(_ROUTED + "SELECT doc_id, source, verdict, confidence, CASE WHEN error IS NOT NULL THEN 'error' WHEN verdict = 'relevant' THEN 'parsed' ELSE 'rejected' END AS status, coalesce(verdict = 'uncertain', false) AS needs_review, error, calls FROM r")
def relevance_routing(spark, sf):
    """Documents routed to upstream's verdict, to none for lack of a keyword, or to a client in batches of ten, some of which fail."""
    return _routed(spark, sf)


@query(_ROUTED + """SELECT count(*) AS processed, count(*) FILTER (WHERE error IS NULL AND verdict = 'relevant') AS relevant, count(*) FILTER (WHERE error IS NULL AND verdict = 'not_relevant') AS rejected, count(*) FILTER (WHERE error IS NULL AND verdict = 'uncertain') AS uncertain,
 count(error) AS errored, count(*) FILTER (WHERE source = 'keyword') AS by_keyword, sum(calls) AS calls FROM r""")
def relevance_routing_summary(spark, sf):
    """What relevance routing did, calls and errors included."""
    return relevance.summary(_routed(spark, sf))
