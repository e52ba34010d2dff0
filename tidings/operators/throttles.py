"""Sign-in attempts throttled by several keys at once, and failed steps that are parked and queued again."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidings.operators.graph import components, cut

WHOLE = (1 << 22, 1 << 17)  # attempts and keys of a chain that one task folds as a stream


def _fold(x: DataFrame, limit: int, micros: int) -> DataFrame:
    """x with the key's own part in each attempt: `stops`, the time until which its lock stops the attempt, and `failures` after it. Attempts that another key stops (`elsewhere`) count for nothing. Keys pass in order of time, as a stream."""

    def fold(batches):
        now, failures, until = None, 0, None
        for pdf in batches:
            stops, after = [], []
            for key, at, result, elsewhere in zip(pdf["key"], pdf["at"], pdf["result"], pdf["elsewhere"], strict=True):
                if key != now:
                    now, failures, until = key, 0, None
                timed = at == at and at is not None
                if until is not None and timed and at >= until:
                    failures, until = 0, None
                stops.append(until)
                if until is None and not elsewhere:
                    if result == "ok":
                        failures = 0
                    elif result == "failed":
                        failures += 1
                        if failures >= limit and timed:
                            until = int(at) + micros
                after.append(failures)
            out = pdf[["id", "rank", "key", "at", "result", "elsewhere"]].copy()
            out["at"] = out["at"].astype("Int64")
            out["stops"], out["failures"] = stops, after
            out["stops"] = out["stops"].astype("Int64")
            yield out

    schema = f"id {dict(x.dtypes)['id']}, rank int, key string, at long, result string, elsewhere boolean, stops long, failures long"
    return x.repartition("key").sortWithinPartitions("key", "at", "id").mapInPandas(fold, schema)


def _fold_chains(x: DataFrame, limit: int, micros: int) -> DataFrame:
    """(id, at, result, stop_rank, stops, lock_rank) of attempts (id, at, result, e, chain): each chain's attempts in order of time, as a stream, with the state of the chain's keys in a dict."""

    def fold(batches):
        import pyarrow as pa

        now, state = None, {}
        for batch in batches:
            out = []
            for chain, at, result, ranks, keys in zip(*(batch.column(c).to_pylist() for c in ("chain", "at", "result", "ranks", "keys")), strict=True):
                if chain != now:
                    now, state = chain, {}
                stop, lock, mine = (None, None), None, []
                for rank, key in zip(ranks, keys, strict=True):
                    held = state.setdefault(key, [0, None])
                    if held[1] is not None and at is not None and at >= held[1]:
                        held[:] = 0, None
                    if stop[0] is None and held[1] is not None:
                        stop = rank, held[1]
                    mine.append((rank, held))
                if stop[0] is None and result == "ok":
                    for _, held in mine:
                        held[0] = 0
                elif stop[0] is None and result == "failed":
                    for rank, held in mine:
                        held[0] += 1
                        if held[0] >= limit and at is not None:
                            held[1] = at + micros
                            lock = rank if lock is None else lock
                out.append((*stop, lock))
            stops = [pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 3, (pa.int32(), pa.int64(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "at", "result")), *stops], ["id", "at", "result", "stop_rank", "stops", "lock_rank"])

    schema = f"id {dict(x.dtypes)['id']}, at long, result string, stop_rank int, stops long, lock_rank int"
    rows = x.select("chain", "id", "at", "result", F.col("e.rank").alias("ranks"), F.col("e.key").alias("keys"))
    return rows.repartition("chain").sortWithinPartitions("chain", "at", "id").mapInArrow(fold, schema)


def _fold_rounds(base: DataFrame, limit: int, micros: int) -> DataFrame:
    """The same by key, for chains that are too long for one task: each round folds every key by itself with the stops that the others gave in the round before, until none changes."""
    x = base.select("id", "at", "result", F.inline("e")).withColumn("elsewhere", F.lit(False))
    stopped = F.col("stops").isNotNull().cast("int")
    while True:
        got = _fold(x, limit, micros)
        others = F.sum(stopped).over(W.partitionBy("id")) - stopped > 0
        new = cut(got.withColumn("next", others))
        if new.where("elsewhere <> next").isEmpty():
            break
        x = new.select("id", "rank", "key", "at", "result", F.col("next").alias("elsewhere"))
    lock = F.when((F.col("result") == "failed") & (F.col("failures") >= limit) & F.col("at").isNotNull(), F.col("rank"))
    by_id = new.groupBy("id").agg(F.min(F.when(F.col("stops").isNotNull(), F.struct("rank", "stops"))).alias("b"), F.min(lock).alias("lock_rank"))
    return base.join(by_id, "id", "left").select("id", "at", "result", F.col("b.rank").alias("stop_rank"), F.col("b.stops").alias("stops"), "lock_rank")


def throttle(attempts: DataFrame, id_: str, time: str, result: str, keys: dict[str, Column], account: str, limit: int = 3, seconds: int = 300, whole: tuple[int, int] = WHOLE) -> DataFrame:
    """(id, outcome, by, retry_after) of sign-in attempts that several keys throttle together, as address, device and account.

    result: `ok`, `failed`, or else no change of any count (an account that is switched off). keys: their columns by kind, in the order in which locks are looked at; a null key throttles nothing, and an attempt whose account (one of the kinds) is null fails. An attempt is `blocked` if a lock of one of its keys lasts: it counts for no key, `by` is the first such kind and retry_after its seconds left, rounded up to the next. Otherwise a failure counts for each of its keys; `limit` in a row lock a key (`locked`, by the first kind), a success clears all of the attempt's keys, and a lock that is over starts the count anew. Attempts go in order of time, ties by id; those without a time come first and set no lock. Ids are unique.

    What a key counts depends on the locks of the others, over any chain of shared keys. Chains are the components of keys that attempts share. Those of at most `whole` attempts and keys are each folded once, as a stream in order of time. Longer ones are folded key by key in rounds until no stop changes: the first n attempts of a chain are right after n rounds at the latest, and a chain, however long, is never one task. A single key's attempts pass one task in order.
    """
    kinds = list(keys)
    given = F.when(keys[account].isNull() & (F.col(result) == "ok"), "failed").otherwise(F.coalesce(result, F.lit("failed")))
    entries = F.array(*(F.when(k.isNotNull(), F.struct(F.lit(i).alias("rank"), F.concat(F.lit(f"{n}:"), k.cast("string")).alias("key"))) for i, (n, k) in enumerate(keys.items())))
    base = attempts.select(F.col(id_).alias("id"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"), given.alias("result"), F.filter(entries, lambda e: e.isNotNull()).alias("e"))
    free = base.where(F.size("e") == 0).select("id", "at", "result", F.lit(None).cast("int").alias("stop_rank"), F.lit(None).cast("long").alias("stops"), F.lit(None).cast("int").alias("lock_rank"))
    held = base.where(F.size("e") > 0).withColumn("first", F.col("e")[0]["key"])
    links = cut(held.select("first", F.explode("e.key").alias("key")).groupBy("first", "key").agg(F.count("*").alias("n")))
    chains = components(links.select("key").distinct(), "key", links.where("first <> key"), "first", "key").withColumnRenamed("label", "chain")
    own = links.where("first = key").select("key", "n")  # each attempt once, under its first key
    many = chains.join(own, "key", "left").groupBy("chain").agg(F.sum("n").alias("n"), F.count("*").alias("n_keys")).where((F.col("n") > whole[0]) | (F.col("n_keys") > whole[1]))
    long_ = cut(many.select("chain", F.lit(True).alias("long")))
    chains = chains.join(long_, "chain", "left").select(F.col("key").alias("first"), "chain", F.coalesce("long", F.lit(False)).alias("long"))
    x = held.join(chains, "first").drop("first")
    y = free.unionByName(_fold_chains(x.where("not long").drop("long"), limit, seconds * 1_000_000))
    if not long_.isEmpty():
        y = y.unionByName(_fold_rounds(x.where("long").drop("long", "chain"), limit, seconds * 1_000_000))
    name = lambda r: F.get(F.array(*map(F.lit, kinds)), F.col(r))
    blocked, locked = F.col("stops").isNotNull(), F.col("lock_rank").isNotNull()
    left = F.floor((F.col("stops") - F.col("at")) / F.lit(1e6)) + 1
    return y.select(
        F.col("id").alias(id_),
        F.when(blocked, "blocked").when(locked, "locked").otherwise(F.col("result")).alias("outcome"),
        F.coalesce(name("stop_rank"), name("lock_rank")).alias("by"),
        F.when(blocked, F.greatest(F.lit(1), left)).when(locked, F.lit(seconds)).cast("long").alias("retry_after"),
    )


# Marks of failures that may pass by themselves, and those that a later sweep queues again.
TRANSIENT = ("readtimeout", "connecttimeout", "timeouterror", "timed out", "connection reset", "connection refused", "temporarily unavailable", "503", "502", "504")
QUEUE_AGAIN = ("readtimeout", "connecttimeout", "timeoutexception", "timed out")
CAPPED = "extraction: exceeded max retries"


def _any(text: Column, marks: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(low, m))


def park(messages: DataFrame, failures: DataFrame, id_: str, kind: str, said: str, order: list[str], limit: int = 5) -> DataFrame:
    """messages (with status, retries, error) after failed steps. failures: (id, kind, said, order columns), any number a message, the last of them by order. A message with a failure is parked as `error` with its last failure as `error`; transient ones count as retries, and at `limit` of them the error says that retries are used up. Messages without a failure stay as they are; failures of unknown messages are left out; one row a message."""
    text = F.nullif(F.trim(said), F.lit(""))
    once = F.concat(F.col(kind), F.lit(": "), F.coalesce(text, F.lit("timed out")))
    full = F.concat(F.col(kind), F.coalesce(F.concat(F.lit(": "), text), F.lit(" (no message)")))
    hard = F.coalesce(text, F.col(kind))
    passing = _any(F.col(said), TRANSIENT) | _any(F.col(kind), ("timeout",))
    last = F.struct(passing.alias("soft"), once.alias("once"), full.alias("full"), hard.alias("hard"))
    got = failures.groupBy(id_).agg(F.count_if(passing).alias("_n"), F.max_by(last, F.struct(*order)).alias("_f"))
    x = messages.join(got, id_, "left")
    n = F.col("retries") + F.coalesce("_n", F.lit(0))
    capped = F.concat(F.lit(f"{CAPPED} ("), n.cast("string"), F.lit(") — last error: "), F.col("_f.full"))
    error = F.when(F.col("_f").isNull(), F.col("error")).when(~F.col("_f.soft"), F.col("_f.hard")).when(n >= limit, capped).otherwise(F.col("_f.once"))
    changed = {"status": F.when(F.col("_f").isNotNull(), "error").otherwise(F.col("status")), "retries": n, "error": error}
    return x.select(*(changed[c].alias(c) if c in changed else c for c in messages.columns))


def queue_again(messages: DataFrame, done: Column, limit: int = 5) -> DataFrame:
    """messages after a sweep: parked ones without a result (`done` is false) whose error has a mark of a timeout are `parsed` again with no error, but at `limit` retries stay parked, and their error says so once."""
    due = F.coalesce((F.col("status") == "error") & ~done & _any(F.col("error"), QUEUE_AGAIN), F.lit(False))
    spent = F.col("retries") >= limit
    text = F.concat(F.lit(f"{CAPPED} ("), F.col("retries").cast("string"), F.lit(") — last error: RuntimeError: "), F.trim("error"))
    error = F.when(due & ~spent, None).when(due & ~F.startswith("error", F.lit(CAPPED)), text).otherwise(F.col("error"))
    return messages.withColumns({"status": F.when(due & ~spent, "parsed").otherwise(F.col("status")), "error": error})
