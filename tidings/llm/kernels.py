"""Array kernels over the UTF-8 bytes of many texts at once: words, hashes of spans, word n-grams."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEP = np.zeros(256, bool)
SEP[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all."""
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column's rows end to end (null: empty), and their n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.type not in (pa.large_binary(), pa.large_string()):
        column = column.cast(pa.large_binary() if column.type == pa.binary() else pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, b"" if column.type == pa.large_binary() else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes other than 0x20, 0x09-0x0D, within a text), and each text's first word (n + 1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~SEP[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edge = off[(off > 0) & (off < len(data))]
    first[edge] = word[edge]
    last[edge - 1] = word[edge - 1]
    s = np.flatnonzero(first)
    return s, np.flatnonzero(last) + 1, np.searchsorted(s, off)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes at a time."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    left = (ends - starts).astype(np.int64)
    h = mix(left.astype(np.uint64) + np.uint64(seed) * _A + _C)
    at, own = starts.astype(np.int64), None
    while len(at):
        part = mix((h if own is None else h[own]) + (lanes[at] & _MASK[np.minimum(left, 8)]) * _A)
        if own is None:
            h = part
        else:
            h[own] = part
        more = np.flatnonzero(left > 8)
        own = more if own is None else own[more]
        at, left = at[more] + 8, left[more] - 8
    return h


def shingles(column, n: int = 5) -> list[np.ndarray]:
    """For each text, the sorted distinct hashes of its n-word shingles over A-Z lower-cased bytes; with fewer words the whole sequence is the one shingle; without words none."""
    data, off = buffers(column)
    data = LOWER[data]
    s, e, first = words(data, off)
    w = span_hash(data, s, e)
    out = []
    if len(w) >= n:
        k = len(w) - n + 1
        grams = np.zeros(k, np.uint64)
        for j in range(n):
            grams = mix(grams + w[j : j + k] * _A + np.uint64(j))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            h = np.zeros(1, np.uint64)
            for j in range(a, b):
                h = mix(h + w[j : j + 1] * _B + np.uint64(b - a))
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
