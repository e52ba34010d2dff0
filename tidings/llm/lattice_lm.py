"""Language-model scoring by a subword lattice.

The pieces of an existing vocabulary are the arcs of a lattice over a word's bytes; a word's probability is the sum over
all its segmentations, found by a forward recursion in log space, and a text's that of its words and an end. A departure
from the method's wording: the scores of the vocabulary at hand are ranks (0, -1, -2, ...), not log probabilities, so they
enter as an order only (Zipf by rank), and piece probabilities are re-estimated from there on the training texts by one round
of expectation-maximisation (forward and backward over each distinct word, weighted by its count). Single bytes are pieces
too, so every text has a probability, and the probabilities of all texts sum to one.

Words are counted once for the whole corpus, in parts by hash; each distinct word is scored once, in its part. Counts and
scores go back to the texts through the HEAD most frequent words, which every task has, and an exchange by hash for all
other words. What the driver sees is that head, the piece weights and totals.

Edge cases: null and empty texts have the end token only; a null doc_id is held out from nothing and trains; repeated rows
count each time; without training texts counts are 0, N is 0 and V is 0; an empty table gives an empty result; words of any
length are scored whole, those over LONG bytes a stretch at a time; extra columns, whatever their names, are ignored. Words
are told apart by 64-bit hashes of their bytes.
"""

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.kernels import LOWER, buffers, span_hash, words
from tidings.llm.work import Workspace, by_part, chunks, n_parts, record, unpacked

HEAD = 1 << 18
ROUNDS = 1
SMALL = 1e-80  # sums below it move the common factor of a long word's recursion
LONG = 4096  # bytes of a word above which its arcs are found a stretch at a time
UNIT = 1_500_000  # words whose counts a task holds before it passes them on
_COUNT = np.dtype([("h", "<u8"), ("n", "<i8"), ("a", "<i8"), ("len", "<i4")])
_TAIL = np.dtype([("h", "<u8"), ("row", "<i8"), ("n", "<i4")])
_SUM = np.dtype([("row", "<i8"), ("lc", "<f8"), ("lp", "<f8"), ("k", "<i8")])
START = "▁".encode()  # the mark that a word's first piece begins with


def vocabulary(path: str) -> list[bytes]:
    """A sentencepiece vocabulary's pieces within words, as bytes, in the order of their scores; then the single bytes that are missing."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    own = sorted((i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))), key=lambda i: (-sp.get_score(i), i))
    pieces = dict.fromkeys(p for p in (sp.id_to_piece(i).encode() for i in own) if START not in p[1:])
    pieces |= dict.fromkeys([START], None)
    return list(pieces | dict.fromkeys(bytes((b,)) for b in range(256)))


def prior(pieces: list[bytes]) -> np.ndarray:
    """Log probabilities by rank in the vocabulary (Zipf); the last place is the end of the text."""
    w = 1.0 / (np.arange(len(pieces) + 1) + 50.0)
    return np.log(w / w.sum())


class Lattice:
    """Forward and backward recursions over many words at once."""

    def __init__(self, pieces: list[bytes], log_p: np.ndarray):
        self.pieces, self.log_p, self.longest = pieces, log_p, max(map(len, pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        end = np.cumsum([len(p) for p in pieces])
        h = span_hash(data, np.concatenate([[0], end[:-1]]), end)
        self.order = np.argsort(h)
        self.hash = h[self.order]

    def number(self, h: np.ndarray) -> np.ndarray:
        """The pieces with these hashes, -1 for none."""
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, self.order[at], -1)

    def arcs(self, data: np.ndarray, n: int, size: int) -> np.ndarray:
        """[word, end - 1, length - 1]: the piece that ends there with that length, for n words of `size` bytes laid end to end."""
        most = min(self.longest, size)
        out = np.full((n, size, most), -1, np.int32)
        base = np.arange(n)[:, None] * size
        for k in range(1, most + 1):
            ends = np.arange(k, size + 1)[None, :]
            e = (base + ends).ravel()
            out[:, k - 1 :, k - 1] = self.number(span_hash(data, e - k, e)).reshape(n, -1)
        return out

    def _weights(self, arcs: np.ndarray) -> np.ndarray:
        return np.where(arcs >= 0, self.log_p[arcs], -np.inf)

    def forward(self, w: np.ndarray) -> np.ndarray:
        """Log of the summed weight of all segmentations of each prefix, from arc weights."""
        n, size, most = w.shape
        alpha = np.full((n, size + 1), -np.inf)
        alpha[:, 0] = 0
        for e in range(1, size + 1):
            k = min(e, most)
            x = alpha[:, e - k : e][:, ::-1] + w[:, e - 1, :k]
            top = x.max(axis=1)
            alpha[:, e] = top + np.log(np.exp(x - top[:, None]).sum(axis=1))
        return alpha

    def expected(self, arcs: np.ndarray, weight: np.ndarray, out: np.ndarray) -> None:
        """Adds each piece's expected count over the segmentations of words, times the words' weights, to out."""
        w = self._weights(arcs)
        n, size, most = w.shape
        alpha = self.forward(w)
        beta = np.full((n, size + 1), -np.inf)
        beta[:, size] = 0
        for s in range(size - 1, -1, -1):
            k = min(size - s, most)
            lengths = np.arange(1, k + 1)
            x = beta[:, s + lengths] + w[:, s + lengths - 1, lengths - 1]
            top = x.max(axis=1)
            safe = np.where(np.isfinite(top), top, 0.0)
            beta[:, s] = np.log(np.exp(x - safe[:, None]).sum(axis=1)) + safe if k else -np.inf
        for k in range(1, most + 1):
            x = alpha[:, : size + 1 - k] + w[:, k - 1 :, k - 1] + beta[:, k:] - alpha[:, size :]
            p = np.exp(x) * weight[:, None]
            a = arcs[:, k - 1 :, k - 1]
            hit = a >= 0
            out += np.bincount(a[hit], p[hit], len(out))

    def groups(self, data: np.ndarray, size: np.ndarray):
        """Words by length, START put before each: (their numbers, arcs)."""
        start = np.cumsum(size) - size
        for n in np.unique(size[size <= LONG]).tolist():
            own = np.flatnonzero(size == n)
            step = max(1, 400_000 // ((n + 3) * min(self.longest, n + 3)))
            for a in range(0, len(own), step):
                rows = own[a : a + step]
                block = np.empty((len(rows), n + 3), np.uint8)
                block[:, :3] = np.frombuffer(START, np.uint8)
                block[:, 3:] = data[start[rows][:, None] + np.arange(n)]
                yield rows, self.arcs(block.ravel(), len(rows), n + 3)

    def log10(self, data: np.ndarray, size: np.ndarray) -> np.ndarray:
        """log10 of each word's marginal probability."""
        out = np.zeros(len(size))
        with np.errstate(divide="ignore"):
            for rows, arcs in self.groups(data, size):
                out[rows] = self.forward(self._weights(arcs))[:, -1] / np.log(10)
            for k, word in self.long_words(data, size):
                out[k] = self.long_forward(word)[-1] / np.log(10)
        return out

    def long_words(self, data: np.ndarray, size: np.ndarray):
        """The words over LONG bytes, one at a time, with START before them."""
        start = np.cumsum(size) - size
        for k in np.flatnonzero(size > LONG).tolist():
            yield k, np.concatenate([np.frombuffer(START, np.uint8), data[start[k] : start[k] + size[k]]])

    def _stretches(self, word: np.ndarray):
        """(first end - 1, arcs) of each stretch of a long word, in order. A stretch begins with the bytes that its first arcs reach back to."""
        for a in range(0, len(word), LONG):
            back = min(a, self.longest - 1)
            piece = word[a - back : a + LONG]
            yield a, self.arcs(piece, 1, len(piece))[0, back:]

    def _there(self, arcs: np.ndarray, first: int):
        """The arcs that are there, by end: (how many at each end, their lengths, their probabilities)."""
        w = self._weights(arcs)
        row, length = np.nonzero(np.isfinite(w) & (np.arange(1, w.shape[1] + 1) <= first + np.arange(1, len(w) + 1)[:, None]))
        return np.bincount(row, minlength=len(w)).tolist(), (length + 1).tolist(), np.exp(w[row, length]).tolist()

    def long_forward(self, word: np.ndarray) -> np.ndarray:
        """The forward recursion over one word, arc by arc: most pieces that could end at a byte are not there. Sums are probabilities over a common factor, which is moved on where they get small; besides the result only a stretch's arcs and the last sums are held."""
        alpha = np.full(len(word) + 1, -np.inf)
        alpha[0] = factor = 0.0
        held = [1.0]
        for a, arcs in self._stretches(word):
            counts, lengths, weights = self._there(arcs, a)
            i, logs = 0, []
            for n in counts:
                total = 0.0
                for k, p in zip(lengths[i : i + n], weights[i : i + n], strict=True):
                    total += held[-k] * p
                i += n
                if 0.0 < total < SMALL:
                    factor += math.log(total)
                    held = [x / total for x in held[-self.longest :]]
                    total = 1.0
                held.append(total)
                logs.append(math.log(total) + factor if total else -math.inf)
            alpha[a + 1 : a + 1 + len(logs)] = logs
            held = held[-self.longest :]
        return alpha

    def _long_backward(self, word: np.ndarray) -> np.ndarray:
        """The same from the end: log sums over the segmentations of what follows each byte."""
        n = len(word)
        beta = np.full(n + 1, -np.inf)
        ahead, factor = [1.0] + [0.0] * self.longest, 0.0  # sums of the position in hand and those before it
        for a in range((n - 1) // LONG * LONG, -1, -LONG):
            end, back = min(n, a + LONG), min(a, self.longest - 1)
            piece = word[a - back : end]
            counts, lengths, weights = self._there(self.arcs(piece, 1, len(piece))[0, back:], a)
            i, logs = len(lengths), []
            for m in reversed(counts):
                here = ahead[0]
                if 0.0 < here < SMALL:
                    factor += math.log(here)
                    ahead = [x / here for x in ahead]
                    here = 1.0
                logs.append(math.log(here) + factor if here else -math.inf)
                for k, p in zip(lengths[i - m : i], weights[i - m : i], strict=True):
                    ahead[k] += here * p
                i -= m
                del ahead[0]
                ahead.append(0.0)
            beta[a + 1 : end + 1] = logs[::-1]
        beta[0] = math.log(ahead[0]) + factor if ahead[0] else -math.inf
        return beta

    def long_expected(self, word: np.ndarray, weight: float, out: np.ndarray) -> None:
        """expected() of one long word: both recursions, then all arcs of a stretch at once."""
        alpha, beta, n = self.long_forward(word), self._long_backward(word), len(word)
        for a, arcs in self._stretches(word):
            w = self._weights(arcs)
            ends = a + 1 + np.arange(len(w))
            for k in range(1, min(w.shape[1], int(ends[-1])) + 1):
                rows = np.flatnonzero((arcs[:, k - 1] >= 0) & (ends >= k))
                p = np.exp(alpha[ends[rows] - k] + w[rows, k - 1] + beta[ends[rows]] - alpha[n]) * weight
                np.add.at(out, arcs[rows, k - 1], p)


def _held(keys: list) -> np.ndarray:
    return np.array([k is not None and zlib.crc32(str(k).encode()) % 10 == 0 for k in keys], bool)


def _part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(7)) % np.uint64(parts)).astype(np.int32)


def _spans(data: np.ndarray, s: np.ndarray, n: np.ndarray) -> bytes:
    """The bytes of spans, end to end."""
    idx = np.repeat(s - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return data[idx].tobytes()


def _count_words(parts: int):
    """Distinct words of a stretch of texts: counts in training texts and whether any text has them, dealt out by hash."""

    def flush(held):
        h = np.concatenate([x[0] for x in held])
        h, first, at = np.unique(h, return_index=True, return_inverse=True)
        n = np.bincount(at, np.concatenate([x[1] for x in held]), len(h)).astype(np.int64)
        size = np.concatenate([x[2] for x in held])
        start = np.cumsum(size) - size
        data = np.frombuffer(b"".join(x[3] for x in held), np.uint8)
        part = _part_of(h, parts)
        order = np.argsort(part, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            out = np.zeros(len(rows), _COUNT)
            out["h"], out["n"], out["len"] = h[rows], n[rows], size[first[rows]]
            yield record(part=part[rows[:1]], blob=[out.tobytes()], word=[_spans(data, start[first[rows]], size[first[rows]])])

    def run(batches):
        held, total = [], 0
        for table in chunks(batches):
            data, off = buffers(table.column("text"))
            data = LOWER[data]
            s, e, first = words(data, off)
            train = np.repeat(~_held(table.column("doc_id").to_pylist()), np.diff(first))
            h, one, at = np.unique(span_hash(data, s, e), return_index=True, return_inverse=True)
            if not len(h):
                continue
            size = (e - s)[one]
            held.append((h, np.bincount(at, train, len(h)), size, _spans(data, s[one], size)))
            total += len(h)
            if total > UNIT:
                yield from flush(held)
                held, total = [], 0
        if held:
            yield from flush(held)

    return run


def _sum_words(part, table):
    x = unpacked(table, _COUNT)
    data = np.frombuffer(b"".join(table.column("word").to_pylist()), np.uint8)
    start = np.cumsum(x["len"], dtype=np.int64) - x["len"]
    h, first, at = np.unique(x["h"], return_index=True, return_inverse=True)
    n = np.bincount(at, x["n"], len(h)).astype(np.int64)
    size = x["len"][first].astype(np.int64)
    for a in range(0, len(h), 200_000):
        own = slice(a, a + 200_000)
        word = _spans(data, start[first[own]], size[own])
        yield record(part=np.array([part], np.int32), known=np.array([(n[own] > 0).sum()]), total=np.array([n[own].sum()]), h=[h[own].tobytes()], n=[n[own].tobytes()], size=[size[own].tobytes()], word=[word])


def _rows(batch):
    """(part, hashes, counts, lengths, bytes) of each row of the words table."""
    for r in batch.to_pylist():
        yield r["part"], np.frombuffer(r["h"], np.uint64), np.frombuffer(r["n"], np.int64), np.frombuffer(r["size"], np.int64), np.frombuffer(r["word"], np.uint8)


def _expected(lattice, slices: int):
    """Expected piece counts of a task's words, cut into slices."""

    def run(batches):
        out = np.zeros(len(lattice.value.log_p))
        for batch in batches:
            for _, _, n, size, data in _rows(batch):
                train = n > 0
                kept = np.repeat(train, size)
                with np.errstate(divide="ignore", invalid="ignore"):
                    for rows, arcs in lattice.value.groups(data[kept], size[train]):
                        lattice.value.expected(arcs, n[train][rows].astype(float), out)
                    for k, word in lattice.value.long_words(data[kept], size[train]):
                        lattice.value.long_expected(word, float(n[train][k]), out)
        for k, x in enumerate(np.array_split(out, slices)):
            yield record(part=np.array([k], np.int32), blob=[x.tobytes()])

    return run


def _add(part, table):
    x = sum(np.frombuffer(b, np.float64) for b in table.column("blob").to_pylist())
    yield record(part=np.array([part], np.int32), blob=[x.tobytes()])


def learn(spark, table: DataFrame, n_docs: int, pieces: list[bytes], rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces and the end after so many rounds of expectation-maximisation over the words table; half a count is added to each."""
    log_p, slices = prior(pieces), 16
    for _ in range(rounds):
        lattice = spark.sparkContext.broadcast(Lattice(pieces, log_p))
        parts = by_part(table.mapInArrow(_expected(lattice, slices), "part int, blob binary"), _add, "part int, blob binary").collect()
        got = np.zeros(len(pieces) + 1)
        for r in parts:
            at = [0, *np.cumsum([len(x) for x in np.array_split(got, slices)]).tolist()]
            got[at[r["part"]] : at[r["part"] + 1]] = np.frombuffer(r["blob"], np.float64)
        got[-1] = n_docs
        log_p = np.log((got + 0.5) / (got + 0.5).sum())
    return log_p


def _scored(lattice, parts: int):
    """Each part's words with counts and scores: hash, count, log10 probability."""

    def run(batches):
        for batch in batches:
            for part, h, n, size, data in _rows(batch):
                lp = lattice.value.log10(data, size)
                yield record(part=np.array([part], np.int32), h=[h.tobytes()], n=[n.tobytes()], lp=[lp.tobytes()])

    return run


def _steps(n: np.ndarray) -> np.ndarray:
    """Counts as steps of a logarithmic scale."""
    return np.floor(16 * np.log2(n)).astype(np.int32)


def _count_steps(batches):
    total = np.zeros(1024, np.int64)
    for batch in batches:
        for r in batch.to_pylist():
            n = np.frombuffer(r["n"], np.int64)
            total += np.bincount(_steps(n[n > 0]), minlength=1024)
    some = np.flatnonzero(total)
    yield record(step=some.astype(np.int32), n=total[some])


def _heads(least: int):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                h, n, lp = np.frombuffer(r["h"], np.int64), np.frombuffer(r["n"], np.int64), np.frombuffer(r["lp"], np.float64)
                keep = (n > 0) & (_steps(np.maximum(n, 1)) >= least)
                yield record(h=h[keep], n=n[keep], lp=lp[keep])

    return run


def _score_texts(head, parts: int):
    """For each text its own sums over the head's words; its other words, with the row's number, dealt out by hash."""

    def run(batches):
        from pyspark import TaskContext

        at_row = TaskContext.get().partitionId() << 40
        hh, hn, hl = head.value
        held, total = [], 0

        def flush():
            x = np.concatenate(held)
            part = _part_of(x["h"], parts)
            order = np.argsort(part, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                yield record(row=pa.nulls(1, pa.int64()), doc_id=pa.nulls(1, pa.int64()), held_out=pa.nulls(1, pa.bool_()), n=pa.nulls(1, pa.int64()), k=pa.nulls(1, pa.int64()), lc=pa.nulls(1, pa.float64()), lp=pa.nulls(1, pa.float64()), part=part[rows[:1]], blob=[x[rows].tobytes()])

        for table in chunks(batches):
            data, off = buffers(table.column("text"))
            data = LOWER[data]
            s, e, first = words(data, off)
            h = span_hash(data, s, e)
            docs, n_docs = np.repeat(np.arange(len(first) - 1), np.diff(first)), len(first) - 1
            spot = np.minimum(np.searchsorted(hh, h), max(0, len(hh) - 1))
            hit = hh[spot] == h if len(hh) else np.zeros(len(h), bool)
            count = hn[spot[hit]]
            ids = table.column("doc_id").combine_chunks()
            yield record(
                row=at_row + np.arange(n_docs), doc_id=ids, held_out=_held(ids.to_pylist()), n=np.diff(first) + 1,
                k=np.bincount(docs[hit], count > 0, n_docs).astype(np.int64), lc=np.bincount(docs[hit], np.log10(count + 0.1), n_docs).astype(float), lp=np.bincount(docs[hit], hl[spot[hit]], n_docs).astype(float),
                part=pa.nulls(n_docs, pa.int32()), blob=pa.nulls(n_docs, pa.binary()),
            )
            rest = np.zeros((~hit).sum(), _TAIL)
            rest["h"], rest["row"], rest["n"] = h[~hit], at_row + docs[~hit], 1
            if len(rest):
                held.append(rest)
                total += len(rest)
            at_row += n_docs
            if total > 500_000:
                yield from flush()
                held, total = [], 0
        if held:
            yield from flush()

    return run


def _look_up(part, table):
    """A part's words of texts with their counts and scores, summed by row."""
    x = unpacked(table, _TAIL)
    if not len(x):
        return
    own = table.filter(table.column("h").is_valid()).to_pylist()
    h, n, lp = (np.concatenate([np.frombuffer(r[k], t) for r in own]) for k, t in (("h", np.uint64), ("n", np.int64), ("lp", np.float64)))
    order = np.argsort(h)
    at = order[np.searchsorted(h[order], x["h"])]
    row, to = np.unique(x["row"], return_inverse=True)
    yield record(row=row, k=np.bincount(to, (n[at] > 0) * x["n"], len(row)).astype(np.int64), lc=np.bincount(to, np.log10(n[at] + 0.1) * x["n"], len(row)), lp=np.bincount(to, lp[at] * x["n"], len(row)))


def score(spark, docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs."""
    ws, parts = Workspace(spark, "lattice"), n_parts(spark)
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    counted = by_part(docs.mapInArrow(_count_words(parts), "part int, blob binary, word binary"), _sum_words, "part int, known long, total long, h binary, n binary, size binary, word binary")
    table = ws.stage(counted, "words")
    ends = docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 != 0, F.lit(True))).count()
    known, total = table.agg(F.coalesce(F.sum("known"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    v, n = known + (ends > 0), total + ends
    pieces = vocabulary(path)
    log_p = learn(spark, table, ends, pieces, rounds)
    lattice = spark.sparkContext.broadcast(Lattice(pieces, log_p))
    scored = ws.stage(table.mapInArrow(_scored(lattice, parts), "part int, h binary, n binary, lp binary"), "scored")
    ws.drop("words")
    # the head: all words from the lowest count on that leaves no more than `head` of them
    least, upto = 1024, 0
    for r in sorted(scored.mapInArrow(_count_steps, "step int, n long").groupBy("step").agg(F.sum("n").alias("n")).collect(), reverse=True):
        upto += r["n"]
        if upto > head:
            break
        least = r["step"]
    top = scored.mapInArrow(_heads(least), "h long, n long, lp double").toArrow()
    h = top.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    sent = spark.sparkContext.broadcast((h[order], top.column("n").to_numpy()[order], top.column("lp").to_numpy()[order]))
    texts = ws.stage(docs.mapInArrow(_score_texts(sent, parts), "row long, doc_id long, held_out boolean, n long, k long, lc double, lp double, part int, blob binary"), "texts")
    none = F.lit(None).cast("binary")
    tails = texts.where("part is not null").select("part", "blob", none.alias("h"), none.alias("n"), none.alias("lp"))
    both = tails.unionByName(scored.select("part", none.alias("blob"), "h", "n", "lp"))
    rest = by_part(both, _look_up, "row long, k long, lc double, lp double").groupBy("row").agg(F.sum("k").alias("k2"), F.sum("lc").alias("lc2"), F.sum("lp").alias("lp2"))
    own = texts.where("part is null")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = own.join(rest, "row", "left")
    norm = float(np.log10(n + 0.1 * (v + 1)))
    end = float(np.log10(ends + 0.1))
    return out.select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("k") + zero("k2") + int(ends > 0)).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("lc") + zero("lc2") + end - F.col("n") * norm).alias("base_score"), (F.col("lp") + zero("lp2") + float(log_p[-1] / np.log(10))).alias("score"),
    )


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: every document's scores."""
    return score(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())
