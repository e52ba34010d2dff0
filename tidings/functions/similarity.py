"""Trigram, word and vector similarity."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def trigrams(x: Column) -> Column:
    """The set of trigrams of a text's words, each in lower case with two blanks before and one after."""
    words = F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def of(w):
        padded = F.concat(F.lit("  "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, of)))


def set_similarity(a: Column, b: Column) -> Column:
    """Shared over all members of two sets; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    return set_similarity(trigrams(a), trigrams(b))


def _ordered(text: str) -> list[str]:
    import re

    out = []
    for w in re.findall(r"[^\W_]+", text.lower()):
        p = f"  {w} "
        out += [p[i : i + 3] for i in range(len(p) - 2)]
    return out


def word_similarity_of(a: str | None, b: str | None) -> float | None:
    """The best similarity of a's trigram set with the set of any run of b's ordered trigrams."""
    if a is None or b is None:
        return None
    mine, other = set(_ordered(a)), _ordered(b)
    best = 0.0
    hits = [i for i, t in enumerate(other) if t in mine]
    for s in hits:
        seen, shared = set(), 0
        for t in other[s:]:
            if t not in seen:
                seen.add(t)
                shared += t in mine
            best = max(best, shared / (len(mine) + len(seen) - shared))
            # no longer run from here can be better than all of a over what it adds
            if len(seen) - shared > len(mine) / max(best, 1e-9):
                break
    return best


@F.pandas_udf(DoubleType())
def word_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Asymmetric: how well a occurs within b."""
    return pd.Series([word_similarity_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def coverage(a: Column, b: Column) -> Column:
    """High where each text covers the other."""
    return word_similarity(a, b) * word_similarity(b, a)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 for null vectors, other lengths, or a vector of norm 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)) | (norm == 0), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(dot(a, b), norm), F.lit(0.0)))
