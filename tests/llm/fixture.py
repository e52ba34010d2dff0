"""A small awkward documents table: nulls, blanks, ties, copies, near copies, long texts, odd characters."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeoéß中") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    passage = " ".join(rng.choice(vocab) for _ in range(70))
    base = [" ".join(rng.choice(vocab) for _ in range(90)) for _ in range(4)]
    out = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(1, 120))]
        kind = i % 10
        text = " ".join(words)
        if kind == 1:
            text = base[i % 4]
        elif kind == 2:
            w = base[i % 4].split()
            w[rng.randrange(len(w))] = rng.choice(vocab)
            text = " ".join(w)
        elif kind == 3:
            text = " ".join(words[:40]) + "\n" + passage + "\n" + " ".join(words[40:])
        elif kind == 4:
            text = " ".join(words[:5] * rng.randint(1, 40))
        elif kind == 5:
            text = "A line. \nA line. \n\n  two\tthree   x　y\x0b" + text.upper() + " #*$%&|<> 's I'm 123 ½"
        out.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None]), len(text)))
    out += [(n, None, None, None, None), (n + 1, "", "en", "a", 0), (n + 2, " \n\t ", "en", "a", 4), (n + 3, "one two", "en", "b", 7), (n + 4, "One  two", "en", "b", 8)]
    out += [(n + 5, "long " * 9 + "w" * 5000 + " " + " ".join(rng.choice(vocab) for _ in range(3000)), "fr", "z", None)]
    return out


def docs(spark, seed: int = 1, n: int = 60):
    return spark.createDataFrame(rows(seed, n), SCHEMA)


def table(spark, tmp_path, data=None) -> str:
    """A folder with such a documents table; its path."""
    df = docs(spark) if data is None else spark.createDataFrame(data, SCHEMA)
    df.repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)
