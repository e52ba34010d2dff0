"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good, bad or abstains on a document. Expectation-maximisation over the table of vote patterns (at most
3 ** rules rows, whatever the corpus) estimates how often each rule votes good or bad on good and on bad documents,
without labels. Rules about junk abstain where they see none, as its absence says little; a document's verdict is the posterior probability that it is good. Pre-aggregation: one count for each
pattern, summed on the map side, so a hot source or group of copies costs nothing extra.

Edge cases: a null or blank text has no words and fails the base rules; very long texts are counted whole, in arrays of their
words and windows; repeated rows are judged alike; a posterior of exactly the threshold keeps the document; an empty table
gives an empty result and default accuracies; columns that clash with the working names are kept, as those have a prefix.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.llm.work import Workspace

BLANK = " \t\n\x0b\x0c\r"
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper")
_P = "__rule_"


def let(value: Column, body) -> Column:
    """Evaluates value once and hands it to body."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words in 5-word windows that occur at least twice."""

    def from_hashes(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2), F.get(h, i + 3), F.get(h, i + 4)))

    def covered(windows: Column) -> Column:
        dealt = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = let(dealt, lambda p: F.sort_array(F.transform(F.filter(p, lambda x, j: (F.get(p, j - 1)["h"] == x["h"]) | (F.get(p, j + 1)["h"] == x["h"])), lambda x: x["i"])))
        zero = F.struct(F.lit(-5).alias("at"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(starts, zero, lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(5), i - a["at"])).alias("n")), lambda a: a["n"])

    def count(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), covered(windows)).otherwise(F.lit(0).cast("long"))

    counted = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(from_hashes(h), count))
    return F.when(F.size(words) >= 6, counted).otherwise(F.lit(0).cast("long"))


def rule_stats(text: Column) -> dict[str, Column]:
    """The statistics that the rules look at, of a text's Column (null: no words)."""
    whole = F.coalesce(text, F.lit(""))
    core = F.btrim(whole, F.lit(BLANK))
    bag = F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, BLANKS))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    counted = let(
        bag,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )
    lined = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return {
        "counted": counted,
        "lined": lined,
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
        "n_upper": (F.length(whole) - F.length(F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long"),
    }


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs and, under a prefix, the statistics of each row."""
    made = docs.withColumns({_P + k: v for k, v in rule_stats(F.col(f"`{text}`")).items()})
    flat = {_P + k: F.col(f"{_P}counted.{k}") for k in ("n_words", "word_chars", "n_repeat_words")}
    flat |= {_P + k: F.col(f"{_P}lined.{k}") for k in ("n_lines", "n_dup_lines")}
    return made.withColumns(flat).drop(_P + "counted", _P + "lined")


def base_failed() -> Column:
    n, rep = F.col(_P + "n_words"), F.col(_P + "n_repeat_words")
    return (n < 10) | (100 * rep > 20 * n)


def votes() -> list[Column]:
    """Each rule's vote: 1 good, 0 bad, 2 abstains."""
    n, chars, sym, dup, rep, lines, upper = (F.col(_P + k).cast("double") for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"))

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, F.lit(0)).when(good, F.lit(1)).otherwise(F.lit(2))

    never = F.lit(False)
    return [
        vote(n < 10, never),
        vote(rep > 0.2 * n, rep <= 0.02 * n),
        vote(sym > 0.05 * chars, sym <= 0.005 * chars),
        vote(sym > 0.3 * n, sym <= 0.05 * n),
        vote(dup > 0.3 * lines, never),
        vote(upper > 0.5 * chars, never),
        vote((rep > 0.1 * n) | (sym > 0.1 * n) | (upper > 0.3 * chars), (n >= 10) & (rep <= 0.02 * n) & (sym <= 0.05 * n) & (upper <= 0.3 * chars)),
    ]


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 50) -> dict:
    """Expectation-maximisation over pattern counts: the share of good documents and, by rule and class, the odds of each vote. Starts from the majority of votes; add-one smoothing keeps unseen votes possible."""
    rules = len(next(iter(patterns), votes_default()))
    post = {p: (0.5 + sum(v == 1 for v in p)) / (1 + sum(v != 2 for v in p)) for p in patterns}
    prior, odds = 0.5, [[[1 / 3] * 3, [1 / 3] * 3] for _ in range(rules)]
    for _ in range(rounds if patterns else 0):
        total = sum(patterns.values())
        good = sum(n * post[p] for p, n in sorted(patterns.items()))
        prior = (good + 1) / (total + 2)
        for r in range(rules):
            seen = [[1.0] * 3, [1.0] * 3]
            for p, n in sorted(patterns.items()):
                seen[1][p[r]] += n * post[p]
                seen[0][p[r]] += n * (1 - post[p])
            odds[r] = [[x / sum(row) for x in row] for row in seen]
        for p in patterns:
            a, b = prior, 1 - prior
            for r, v in enumerate(p):
                a, b = a * odds[r][1][v], b * odds[r][0][v]
            post[p] = a / (a + b)
    return {"prior": prior, "odds": odds}


def votes_default() -> tuple[int, ...]:
    return (2,) * 7


def posterior(model: dict) -> Column:
    """The probability that a document is good, from its votes."""
    from math import log

    z = F.lit(log(model["prior"]) - log(1 - model["prior"]))
    for v, (bad, good) in zip(votes(), model["odds"], strict=True):
        weight = [log(g) - log(b) for g, b in zip(good, bad, strict=True)]
        z = z + F.when(v == 0, F.lit(weight[0])).when(v == 1, F.lit(weight[1])).otherwise(F.lit(weight[2]))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit(stats: DataFrame) -> dict:
    """The model, from a table of statistics. What reaches the driver is one count for each vote pattern: 2187 at most."""
    names = [f"v{k}" for k in range(len(votes()))]
    rows = stats.select(*(v.alias(n) for v, n in zip(votes(), names, strict=True))).groupBy(*names).count().collect()
    return estimate({tuple(r[n] for n in names): r["count"] for r in rows})


def judged(stats: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """Adds base_failed, p_good and kept (under the prefix)."""
    failed = base_failed()
    return stats.withColumns({_P + "base_failed": failed, _P + "p_good": posterior(model)}).withColumn(_P + "kept", ~F.col(_P + "base_failed") & (F.col(_P + "p_good") >= threshold))


def keep_good(spark, docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that the rules keep, with their columns."""
    ws = Workspace(spark, "rules")
    stats = ws.stage(with_stats(docs, text), "stats")
    return judged(stats, fit(stats), threshold).where(_P + "kept").select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the statistics and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ws = Workspace(spark, "op5")
    stats = ws.stage(with_stats(docs).drop("text"), "stats")
    out = judged(stats, fit(stats))
    return out.select("doc_id", *(F.col(_P + k).alias(k) for k in (*STATS, "base_failed", "kept", "p_good")))
