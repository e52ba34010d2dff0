"""Quality classifier: a generalised additive model with pairwise interactions.

Text statistics are cut into bins; boosting visits the features in turn, again and again, and each visit fits a shallow tree
to one feature's bins and adds a fraction of it to that feature's look-up table. Pairs whose joint table explains most of
what the single tables leave get small joint tables, boosted in the same way. A score is the logistic of a sum of look-ups:
bin numbers and vector additions.

Training reads labelled rows only, at most MAX_TRAIN of them (those with the least hash of the id, so that reruns agree);
statistics and scores cover every row and whole texts. Edge cases: null and empty texts have zero statistics and are
scored like others; labels that are null, or of ids that are missing or null, are ignored; labels of a repeated id count
once for each row; without labels, or with one class only, the score is the share of label 1 (0.5 without labels); very
long texts are measured whole; repeated rows score alike; ties of the id's hash go by id, then label; extra columns of either
table, whatever their names, are ignored; an empty table gives an empty result.
"""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.work import Workspace, chunks, record

MAX_TRAIN = 100_000
FEATURES = ("words", "chars_per_word", "symbols", "bars", "upper", "digits", "bangs", "stops", "distinct", "top_word", "repeat_5", "dup_lines", "words_per_line", "long_words", "one_letter", "next_same")
_SYMBOLS = re.compile(r"[#*$%&<>@^~=_{}\[\]\\]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGITS = re.compile(r"[0-9]")


def statistics(text: str) -> tuple[float, ...]:
    """The features of a text, all finite."""
    words, n_chars = text.split(), max(1, len(text))
    n = max(1, len(words))
    count = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    fives = Counter(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    again = sum(v for v in fives.values() if v > 1)
    return (
        float(np.log1p(len(words))),
        (len(text) - len(words)) / n,
        len(_SYMBOLS.findall(text)) / n,
        text.count("|") / n,
        len(_UPPER.findall(text)) / n_chars,
        len(_DIGITS.findall(text)) / n_chars,
        text.count("!") / n,
        sum(text.count(c) for c in ".,;:?") / n,
        len(count) / n,
        max(count.values(), default=0) / n,
        again / max(1, len(words) - 4),
        1 - len(set(lines)) / max(1, len(lines)),
        len(words) / max(1, len(lines)),
        sum(v for w, v in count.items() if len(w) > 12) / n,
        sum(v for w, v in count.items() if len(w) == 1) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
    )


class Model:
    """Bins, look-up tables and pair tables."""

    def __init__(self, cuts, intercept, tables, pairs, pair_cuts, pair_tables):
        self.cuts, self.intercept, self.tables = cuts, intercept, tables
        self.pairs, self.pair_cuts, self.pair_tables = pairs, pair_cuts, pair_tables

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for f, (cut, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            z += table[np.searchsorted(cut, x[:, f], "right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            z += table[np.searchsorted(self.pair_cuts[a], x[:, a], "right"), np.searchsorted(self.pair_cuts[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins, method="higher"))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """The step of a tree of so many leaves over ordered bins with gradient sums g and curvature sums h: greedy best splits."""
    parts, out = [(0, len(g))], np.zeros(len(g))
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1.0)
    while len(parts) < leaves:
        best = max(((gain(a, m) + gain(m, b) - gain(a, b), a, m, b) for a, b in parts for m in range(a + 1, b)), default=None)
        if best is None or best[0] <= 1e-9:
            break
        _, a, m, b = best
        parts.remove((a, b))
        parts += [(a, m), (m, b)]
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return out


def train(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.15, bins: int = 32, n_pairs: int = 4, pair_bins: int = 8) -> Model:
    """Cyclic boosting of single tables, then of the pair tables."""
    n, d = x.shape if x.ndim == 2 else (0, len(FEATURES))
    if n == 0 or y.min() == y.max():
        share = float(y.mean()) if n else 0.5
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Model([np.zeros(0)] * d, float(np.log(p / (1 - p))), [np.zeros(1)] * d, [], [], [])
    cuts = [_cuts(x[:, f], bins) for f in range(d)]
    at = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    intercept = float(np.log(y.mean() / (1 - y.mean())))
    z = np.full(n, intercept)
    for _ in range(rounds):
        for f in range(d):
            p = 1 / (1 + np.exp(-z))
            size = len(tables[f])
            step = rate * _tree(np.bincount(at[f], y - p, size), np.bincount(at[f], p * (1 - p), size))
            tables[f] += step
            z += step[at[f]]
    pair_cuts = [_cuts(x[:, f], pair_bins) for f in range(d)]
    low = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(pair_cuts)]
    p = 1 / (1 + np.exp(-z))
    gains = []
    for a in range(d):
        for b in range(a + 1, d):
            size = (len(pair_cuts[a]) + 1, len(pair_cuts[b]) + 1)
            k = low[a] * size[1] + low[b]
            g, h = np.bincount(k, y - p, size[0] * size[1]), np.bincount(k, p * (1 - p), size[0] * size[1])
            gains.append((float((g**2 / (h + 5.0)).sum()), a, b))
    pairs = [(a, b) for _, a, b in sorted(gains, reverse=True)[:n_pairs]]
    pair_tables = [np.zeros((len(pair_cuts[a]) + 1, len(pair_cuts[b]) + 1)) for a, b in pairs]
    for _ in range(rounds // 2):
        for (a, b), table in zip(pairs, pair_tables, strict=True):
            p = 1 / (1 + np.exp(-z))
            k = low[a] * table.shape[1] + low[b]
            g, h = np.bincount(k, y - p, table.size), np.bincount(k, p * (1 - p), table.size)
            step = rate * (g / (h + 5.0)).reshape(table.shape)
            table += step
            z += step[low[a], low[b]]
    return Model(cuts, intercept, tables, pairs, pair_cuts, pair_tables)


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the features of each row of (doc_id, text)."""

    def run(batches):
        for table in chunks(batches):
            flat = [v for t in table.column("text").to_pylist() for v in statistics(t or "")]
            n = table.num_rows
            x = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * len(FEATURES), pa.array(flat, pa.float64()))
            yield record(doc_id=table.column("doc_id").combine_chunks(), x=x)

    return docs.mapInArrow(run, "doc_id long, x array<double>")


def held_out(key: int | None) -> bool:
    return key is not None and zlib.crc32(str(key).encode()) % 5 == 0


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN) -> Model:
    """The model of labelled rows whose id is not held out."""
    known = labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("y")).where(f"{label} is not null and doc_id is not null")
    known = known.where(F.crc32(F.col("__id").cast("string")) % 5 != 0)
    rows = stats.join(known, stats["doc_id"] == known["__id"]).select("x", "y", F.xxhash64("doc_id").alias("h"), "doc_id")
    got = rows.orderBy("h", "doc_id", "y").limit(max_train).select("x", "y").toArrow()
    x = got.column("x").combine_chunks()
    x = x.values.to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)) if len(got) else np.zeros((0, len(FEATURES)))
    y = (got.column("y").to_numpy() > 0).astype(np.float64)
    return train(x, y)


def score(stats: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    def run(batches):
        for batch in batches:
            x = batch.column("x")
            x = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            s = model.score(x)
            ids = batch.column("doc_id")
            held = [held_out(k) for k in ids.to_pylist()]
            yield record(doc_id=ids, held_out=pa.array(held, pa.bool_()), score=s, predicted=(s >= threshold).astype(np.int32))

    return stats.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(spark, docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""
    ws = Workspace(spark, "gam")
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    stats = ws.stage(with_statistics(docs), "statistics")
    return score(stats, fit(stats, labels, label))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: the quality of every document."""
    return classify(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
