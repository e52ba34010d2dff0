"""Relevance verdicts, their policy and routing, and checks of model answers."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANSWER = "results array<struct<raw_message_id: bigint, verdict: string, confidence: double, reasoning: string>>"
VERDICTS = ("relevant", "not_relevant", "uncertain")


def upstream(include: Column, domain: Column, subtype: Column) -> Column:
    """Verdict of upstream metadata: a given include decides, else domain and subtype both filled in mean relevant, else null."""
    filled = (F.trim(F.coalesce(domain, F.lit(""))) != "") & (F.trim(F.coalesce(subtype, F.lit(""))) != "")
    return F.when(include, "relevant").when(~include, "not_relevant").when(filled, "relevant")


def policy(verdict: Column) -> dict[str, Column]:
    """Status and review mark that a verdict gives."""
    return {"status": F.when(verdict == "relevant", "parsed").when(verdict.isin("not_relevant", "uncertain"), "rejected"), "needs_review": F.coalesce(verdict == "uncertain", F.lit(False))}


def route(upstream_verdict: Column, has_keyword: Column) -> Column:
    """Where a message's verdict comes from."""
    return F.when(upstream_verdict.isNotNull(), "upstream").when(~F.coalesce(has_keyword, F.lit(False)), "keyword").otherwise("model")


def reconcile(requests: DataFrame, answers: DataFrame, batch: str, id_: str, raw: str) -> DataFrame:
    """One verdict for each request: from its batch's JSON answer by id; missing or malformed items, and all of a malformed answer, are uncertain."""
    items = answers.select(batch, F.explode(F.from_json(raw, ANSWER)["results"]).alias("x")).select(batch, F.col("x.raw_message_id").alias(id_), "x.verdict", "x.confidence")
    fine = F.col("verdict").isin(*VERDICTS) & F.col("confidence").between(0, 1)
    first = items.where(fine).groupBy(batch, id_).agg(F.min(F.struct("verdict", "confidence")).alias("v"))
    return requests.join(first, [batch, id_], "left").select(*requests.columns, F.coalesce("v.verdict", F.lit("uncertain")).alias("verdict"), F.coalesce("v.confidence", F.lit(0.0)).alias("confidence"))


CLASSIFIED = "verdict string, confidence double, error string, calls int"


def classify(messages: DataFrame, id_: str, text: str, batch: str, connect: Callable, size: int = 10, attempts: int = 2) -> DataFrame:
    """(id, verdict, confidence, error, calls) by a client. Rows of one value of the column `batch`, in id order, go to it `size` at a time: connect() gives, once a task, a function from [(id, text)] to [(verdict, confidence)]. A call that raises, or answers another number, is tried once more; then only its own rows bear the error. Unknown verdicts and confidences beyond 0 to 1 are uncertain. calls stands with a batch's first row, 0 with the others."""
    kind = dict(messages.dtypes)[id_]

    def ask(client, rows):
        error = None
        for n in range(1, attempts + 1):
            try:
                got = list(client(rows))
                if len(got) != len(rows):
                    raise RuntimeError(f"{len(got)} answers for {len(rows)} messages")
                return n, [(v, float(c)) if v in VERDICTS and isinstance(c, (int, float)) and 0 <= c <= 1 else ("uncertain", 0.0) for v, c in got], None
            except Exception as e:  # whatever a client raises stays with its own rows
                error = f"{type(e).__name__}: {e}"
        return attempts, [(None, None)] * len(rows), error

    def run(batches):
        import pyarrow as pa

        client, held, now = connect(), [], None

        def flush():
            calls, got, error = ask(client, held)
            n = len(held)
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], ids), pa.array([v for v, _ in got], pa.string()), pa.array([c for _, c in got], pa.float64()), pa.array([error] * n, pa.string()), pa.array([calls] + [0] * (n - 1), pa.int32())], [id_, "verdict", "confidence", "error", "calls"])

        for part in batches:
            ids = part.column(id_).type
            for b, k, said in zip(part.column("_batch").to_pylist(), part.column(id_).to_pylist(), part.column("_text").to_pylist(), strict=True):
                if held and (b != now or len(held) == size):
                    yield flush()
                    held = []
                now = b
                held.append((k, said))
        if held:
            yield flush()

    x = messages.select(F.col(batch).alias("_batch"), F.col(id_), F.col(text).alias("_text"))
    return x.repartition("_batch").sortWithinPartitions("_batch", id_).mapInArrow(run, f"{id_} {kind}, {CLASSIFIED}")


def routed(messages: DataFrame, id_: str, text: str, batch: str, upstream_verdict: str, has_keyword: str, connect: Callable, size: int = 10) -> DataFrame:
    """(id, source, verdict, confidence, status, needs_review, error, calls): upstream's verdict where there is one; without a keyword not relevant; the rest from the client. Rows whose batch failed have status `error`. Ids are unique."""
    x = messages.withColumn("source", route(F.col(upstream_verdict), F.col(has_keyword)))
    settled = x.where("source <> 'model'").select(id_, "source", F.coalesce(F.when(F.col("source") == "upstream", F.col(upstream_verdict)), F.lit("not_relevant")).alias("verdict"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("calls"))
    asked = classify(x.where("source = 'model'"), id_, text, batch, connect, size).withColumn("source", F.lit("model"))
    rows = settled.unionByName(asked)
    rule = policy(F.col("verdict"))
    return rows.select(id_, "source", "verdict", "confidence", F.when(F.col("error").isNotNull(), "error").otherwise(rule["status"]).alias("status"), rule["needs_review"].alias("needs_review"), "error", "calls")


def summary(rows: DataFrame) -> DataFrame:
    """One row of counts over routed() rows."""
    is_ = lambda v: F.count_if(F.col("error").isNull() & (F.col("verdict") == v))
    return rows.agg(
        F.count("*").alias("processed"), is_("relevant").alias("relevant"), is_("not_relevant").alias("rejected"), is_("uncertain").alias("uncertain"), F.count("error").alias("errored"),
        F.count_if(F.col("source") == "keyword").alias("by_keyword"), F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"),
    )
