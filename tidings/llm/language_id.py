"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1; an n-gram's vector is the product of its letters' vectors, each rotated by its
place (binding of permuted vectors); a text's vector is the sum of its n-grams' vectors (bundling). A language's prototype
is the bundle of its training texts, and a text gets the language whose prototype has the largest cosine with it.

n-grams are of three characters over letters (lower-cased) and single blanks for runs of anything else, so punctuation,
digits and markup say nothing. Prototypes are sums, added up task by task; what is common to all languages is taken out by
subtracting the mean of the prototypes' directions. What reaches the driver is one vector a language.

Edge cases: null texts and texts without a letter (str.isalpha; number signs are none) are `und` with score 0; null languages
are not learnt; without learnt languages every text is `und`; ties go to the first language by code point; repeated rows
count each time and are judged alike; very long texts are counted whole, by their distinct n-grams; extra columns, whatever
their names, are ignored; an empty table gives an empty result.
"""

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.work import Workspace, chunks, record

DIMENSIONS = 1024
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_letters: dict[str, np.ndarray] = {}
_grams: dict[int, np.ndarray] = {}
BLANK = 32


def letter(code: int, dims: int = DIMENSIONS) -> np.ndarray:
    """A letter's random vector, the same in every process."""
    got = _letters.get((code, dims))
    if got is None:
        got = _letters[code, dims] = np.random.default_rng([code, 20]).integers(0, 2, dims).astype(np.int8) * 2 - 1
    return got


def gram(key: int, dims: int = DIMENSIONS) -> np.ndarray:
    """The vector of three letters: their vectors, rotated by place, bound by multiplication."""
    got = _grams.get((key, dims))
    if got is None:
        if len(_grams) > 60_000:
            _grams.clear()
        a, b, c = key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF
        got = _grams[key, dims] = np.roll(letter(a, dims), 2) * np.roll(letter(b, dims), 1) * letter(c, dims)
    return got


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct n-grams and their counts; none if it has no letter."""
    clean = _NOT_LETTERS.sub(" ", text.lower()).strip()
    if not clean.isascii():
        # number signs such as ½ or Ⅷ count as word characters, but are no letters
        signs = [c for c in set(clean) if c != " " and not c.isalpha()]
        if signs:
            clean = " ".join(clean.translate(dict.fromkeys(map(ord, signs), " ")).split())
    if not clean:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.frombuffer(f" {clean} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:], return_counts=True)


def bundle(texts: list[tuple[np.ndarray, np.ndarray]], dims: int = DIMENSIONS) -> np.ndarray:
    """The vectors of texts, given their n-grams."""
    out = np.zeros((len(texts), dims), np.float32)
    for a in range(0, len(texts), 128):
        part = texts[a : a + 128]
        keys, at = np.unique(np.concatenate([k for k, _ in part]), return_inverse=True)
        for lo in range(0, len(keys), 8192):
            base = np.stack([gram(k, dims) for k in keys[lo : lo + 8192].tolist()]).astype(np.float32)
            weight = np.zeros((len(part), len(base)), np.float32)
            row = np.repeat(np.arange(len(part)), [len(k) for k, _ in part])
            n = np.concatenate([c for _, c in part])
            in_ = (at >= lo) & (at < lo + 8192)
            weight[row[in_], at[in_] - lo] = n[in_]
            out[a : a + 128] += weight @ base
    return out


def _learn(dims: int):
    """For each task and language, the sum of its training texts' vectors, each text scaled to the square root of its length so that a few long texts don't outweigh the rest."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for table in chunks(batches):
            langs = table.column("lang").to_pylist()
            found = [grams(t or "") for t in table.column("text").to_pylist()]
            keep = [i for i, (k, _) in enumerate(found) if len(k)]
            for i, v in zip(keep, bundle([found[i] for i in keep], dims), strict=True):
                total = float(found[i][1].sum())
                sums.setdefault(langs[i], np.zeros(dims))
                sums[langs[i]] += v / np.sqrt(total)
        for lang, v in sums.items():
            yield record(lang=[lang], v=[v.astype(np.float64).tobytes()])

    return run


def _add(dims: int):
    def run(table):
        total = sum((np.frombuffer(b, np.float64) for b in table.column("v").to_pylist()), np.zeros(dims))
        return pa.table({"lang": table.column("lang")[:1], "v": pa.array([total.tobytes()], pa.binary())})

    return run


class Profiles:
    """Languages and their prototypes."""

    def __init__(self, sums: dict[str, np.ndarray], dims: int = DIMENSIONS):
        self.langs, self.dims = sorted(sums, key=lambda s: s.encode()), dims
        unit = np.array([sums[k] / max(np.linalg.norm(sums[k]), 1e-12) for k in self.langs]).reshape(-1, dims)
        self.mean = unit.mean(0) if len(unit) > 1 else np.zeros(dims)
        own = unit - self.mean
        self.own = own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        found = [grams(t or "") for t in texts]
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        keep = [i for i, (k, _) in enumerate(found) if len(k)] if self.langs else []
        if keep:
            v = bundle([found[i] for i in keep], self.dims).astype(np.float64)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            # the texts' common part goes as far as the languages share it
            cos = (v - self.mean) @ self.own.T
            cos /= np.maximum(np.linalg.norm(v - self.mean, axis=1, keepdims=True), 1e-12)
            for i, c in zip(keep, cos, strict=True):
                best = int(np.argmax(c))
                lang[i], score[i] = self.langs[best], float(min(1.0, max(0.0, c[best])))
        return lang, score


def learn(ws: Workspace, docs: DataFrame, dims: int = DIMENSIONS) -> Profiles:
    """Prototypes from (doc_id, text, lang), of the rows that are not held out."""
    rows = docs.where("lang is not null").where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 != 1, F.lit(True)))
    sums = ws.stage(rows.mapInArrow(_learn(dims), "lang string, v binary"), "sums")
    total = sums.groupBy("lang").applyInArrow(_add(dims), "lang string, v binary")
    return Profiles({r["lang"]: np.frombuffer(r["v"], np.float64) for r in total.collect()}, dims)


def held_out(key: int | None) -> bool:
    return key is not None and zlib.crc32(str(key).encode()) % 3 == 1


def identify(spark, docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", dims: int = DIMENSIONS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    ws = Workspace(spark, "languages")
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    profiles = spark.sparkContext.broadcast(learn(ws, docs, dims))

    def run(batches):
        for table in chunks(batches):
            pred, score = profiles.value.predict(table.column("text").to_pylist())
            ids = table.column("doc_id").combine_chunks()
            yield record(doc_id=ids, held_out=pa.array([held_out(k) for k in ids.to_pylist()], pa.bool_()), lang_pred=pa.array(pred, pa.string()), score=pa.array(score, pa.float64()))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: the language of every document."""
    return identify(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
