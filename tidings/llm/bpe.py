"""Byte-pair encoding as a streaming transducer with bounded look-ahead, and decoding as an incremental state machine.

A sequence of tokens is the encoding of its bytes exactly if each two neighbours are: encoding the two together gives the
two. So reading bytes from the left, the last token of each prefix's encoding follows from the last tokens of shorter
prefixes, of which only those within the longest token's reach are kept. The tokens on the way back from all states that
can still be continued meet; what lies before the meeting point is stable and is emitted. How far that point can be behind
is bounded by the merge list (`lookahead`): the longest token times the longest chain of merges of falling rank that can
undo one another. The transducer thus holds a number of states that does not depend on the text.

Texts are cut by the tokenizer's pattern first. The new short pieces of a chunk of texts go through transducers in lock step:
each step reads one byte of every piece, walks a trie of reversed tokens for the tokens that may end there, and keeps the
longest that may follow the last token before it. Longer pieces stream one by one. Encodings of the words met last are kept
in a memo of MEMO bytes at most, for one task, and answers on neighbours in a table of fixed size; both only spare work.
Decoding feeds each token's bytes to a UTF-8 state machine that holds at most three bytes.

Edge cases: null and empty texts give no tokens; strings of special tokens become their ids, as the library does; ill-formed
byte sequences decode to U+FFFD as the library does; repeated rows encode alike; very long pieces stream and stay out of the
memo; no two encodings of a text tie, as merges of equal rank go from the left; an empty table gives an empty result; extra
columns, whatever their names, are ignored by the query and dropped by the stage.
"""

import codecs
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.work import chunks, give_back, record

MEMO = 32 << 20  # bytes of words and encodings kept by a worker, about
SHORT = 64  # bytes up to which a piece is walked in one go
LOCK_STEP = 20_000  # pieces that go through the transducers together
PAIRS = 20  # the table of neighbours has 2 ** PAIRS places
ODD_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_models: dict = {}


def byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Model:
    """A byte-level BPE vocabulary with its merges, from a tokenizer.json."""

    def __init__(self, path: str):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        byte_of = {c: b for b, c in byte_letters().items()}
        raw = lambda s: bytes(byte_of[c] for c in s)
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = (raw(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.rank.setdefault((self.ids[a], self.ids[b]), (r, self.ids[a + b]))
        self.longest = max(map(len, self.ids))
        self.sizes: dict[int, list[int]] = {}  # by last byte, the lengths of tokens that end in it
        for b in self.ids:
            self.sizes.setdefault(b[-1], set()).add(len(b))  # type: ignore[arg-type]
        self.sizes = {k: sorted(v, reverse=True) for k, v in self.sizes.items()}
        # and those that fit in so many bytes
        self.within = {k: [[n for n in v if n <= room] for room in range(SHORT + 1)] for k, v in self.sizes.items()}
        self.made = {new: (a, b, r) for (a, b), (r, new) in reversed(self.rank.items())}
        self.spines: tuple[dict, dict] = ({}, {})
        self.cut = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""").findall
        self.apart = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.unit = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+").findall
        self.known: dict[str, str] = {}
        self.pieces: dict[str, str] = {}
        self.held = 0
        self.text_bytes = {str(i): b for i, b in self.bytes.items()}
        self.text_of = [str(i) for i in range(max(self.bytes) + 1)]
        self.tables = None
        self.bound = self.lookahead()

    def merge(self, tokens: list[int]) -> list[int]:
        """Merges by rank until none applies: the definition, for short inputs."""
        rank = self.rank
        while len(tokens) > 1:
            best = min(((rank[p], k) for k, p in enumerate(zip(tokens, tokens[1:], strict=False)) if p in rank), default=None)
            if best is None:
                break
            (_, new), k = best
            tokens[k : k + 2] = [new]
        return tokens

    def spine(self, token: int, side: int) -> tuple[list[int], list[float]]:
        """The parts of a token at its left (side 0) or right (1) end, smallest first, and the rank at which each goes into the next."""
        got = self.spines[side].get(token)
        if got is None:
            parts, ranks = [token], [float("inf")]
            while parts[-1] in self.made:
                left, right, rank = self.made[parts[-1]]
                parts.append(right if side else left)
                ranks.append(rank)
            got = self.spines[side][token] = parts[::-1], ranks[::-1]
        return got

    def neighbours(self, a: int, b: int) -> bool:
        """Whether b may follow a in an encoding: whether, as the two are built up side by side in order of rank, no merge across their border ever comes first (from the left on equal ranks)."""
        (left, up), (right, over) = self.spine(a, 1), self.spine(b, 0)
        i = j = 0
        while True:
            across = self.rank.get((left[i], right[j]))
            if across is not None and across[0] < up[i] and across[0] <= over[j]:
                return False
            if i == len(left) - 1 and j == len(right) - 1:
                return True
            if up[i] <= over[j]:
                i += 1
            else:
                j += 1

    def lookahead(self) -> int:
        """Bytes after which a token is surely stable: the longest token times the longest chain in which each merge's right part starts what an earlier merge would have joined."""
        depth: dict[int, int] = {}
        deepest = 1
        for (_, b), (_, new) in self.rank.items():
            depth[new] = 1 + max(depth.get(b, 0), 0)
            deepest = max(deepest, depth[new])
        return self.longest * deepest

    def encode_bytes(self, raw: bytes):
        """The transducer: yields the ids of raw's encoding, each as soon as it is stable."""
        ids, sizes, within, fits = self.ids, self.sizes, self.within, self.neighbours
        last: dict[int, int] = {}  # by end, the last token of the prefix that ends there
        done, bound = 0, self.bound
        for end in range(1, len(raw) + 1):
            room = end - done
            for n in within[raw[end - 1]][room] if room <= SHORT else sizes[raw[end - 1]]:
                if n > room:
                    continue
                t = ids.get(raw[end - n : end])
                if t is None:
                    continue
                before = end - n
                if before == 0 or (p := last.get(before)) is not None and fits(p, t):
                    last[end] = t
                    break
            if end - done > SHORT + self.longest and (end & 63 == 0 or end - done > bound):
                tokens, done = self._stable(last, done, end)
                yield from tokens
        if len(raw) > done:
            yield from self._back(last, done, len(raw))

    def _back(self, last: dict[int, int], done: int, end: int) -> list[int]:
        out = []
        while end > done:
            out.append(last[end])
            end -= len(self.bytes[last[end]])
        return out[::-1]

    def _stable(self, last: dict[int, int], done: int, end: int) -> tuple[list[int], int]:
        """Tokens before the point where the ways back from all states that can be continued meet, and that point."""
        live = {e for e in range(max(done, end - self.longest + 1), end + 1) if e == done or e in last}
        while len(live) > 1:
            far = max(live)
            live.remove(far)
            if far == done:
                break
            live.add(far - len(self.bytes[last[far]]))
        meet = max(live)
        tokens = self._back(last, done, meet)
        for e in [e for e in last if e < meet]:
            del last[e]
        return tokens, meet

    def _tables(self) -> "Tables":
        if self.tables is None:
            self.tables = Tables(self)
        return self.tables

    def lock_step(self, pieces: list[bytes]) -> list[list[int]]:
        """The transducers of many pieces of at most SHORT bytes, one byte of each at a time."""
        tables, n = self._tables(), len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, n)
        order = np.argsort(-size, kind="stable")  # longest first: the pieces that still read are the first ones
        widest = int(size.max(initial=0))
        data = np.zeros((n, widest), np.uint8)
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        start = (np.cumsum(size) - size)[order]
        size = size[order]
        data[np.arange(widest) < size[:, None]] = flat[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        last = np.full((widest + 1, n), -1, np.int32)
        for end in range(1, widest + 1):
            rows = np.arange(int(np.searchsorted(-size, -end, "right")))
            node, found = np.zeros(len(rows), np.int64), []
            for length in range(1, end + 1):
                node = tables.child(node, data[rows, end - length])
                rows, node = rows[node > 0], node[node > 0]
                if not len(rows):
                    break
                token = tables.token[node]
                some = token >= 0
                if some.any():
                    found.append((length, rows[some], token[some]))
            now = last[end]
            for length, rows, token in reversed(found):
                still = now[rows] < 0
                rows, token = rows[still], token[still]
                if length < end and len(rows):
                    fits = tables.neighbours(last[end - length][rows], token)
                    rows, token = rows[fits], token[fits]
                now[rows] = token
        out: list[list[int]] = [[] for _ in range(n)]
        rows, end = np.arange(n), size.copy()
        while len(rows):
            token = last[end, rows]
            for k, t in zip(order[rows].tolist(), token.tolist(), strict=True):
                out[k].append(t)
            end -= tables.size[token]
            rows, end = rows[end > 0], end[end > 0]
        for tokens in out:
            tokens.reverse()
        return out

    def learn(self, pieces) -> None:
        """Puts the encodings of new pieces in the memo."""
        new, text_of = list(pieces), self.text_of
        for a in range(0, len(new), LOCK_STEP):
            some = new[a : a + LOCK_STEP]
            for piece, tokens in zip(some, self.lock_step([x.encode("utf-8", "surrogatepass") for x in some]), strict=True):
                got = self.pieces[piece] = ",".join([text_of[t] for t in tokens])
                self.held += 150 + 2 * len(piece) + len(got)

    def plain(self, text: str) -> bool:
        """Whether all white space is single blanks between words and single line ends after words."""
        return text[0] not in " \n" and text[-1] != " " and "  " not in text and "\n\n" not in text and " \n" not in text and "\n " not in text and not any(c in text for c in ODD_SPACE)

    def _cut_up(self, text: str) -> list[str]:
        """A text's pieces. Between a black character and white space the pattern always cuts, so texts without odd space are cut unit by unit."""
        return [p for u in ([text] if any(c in text for c in ODD_SPACE[2:]) else self.unit(text)) for p in self.cut(u)]

    def forget(self) -> None:
        """Empties the memo."""
        self.known, self.pieces, self.held = {}, {}, 0

    def _cut_word(self, word: str) -> list[str]:
        """The pieces of a word and the blank or line end before it."""
        if word.isascii():
            if word.isalpha():
                return [" " + word]
            if word[-1] in ".,;:!?" and word[:-1].isalpha():
                return [" " + word[:-1], word[-1]]
        return self.cut(word if word[0] == "\n" else " " + word)

    def _join(self, pieces: list[str]) -> str:
        memo = self.pieces
        return ",".join([memo[p] if p in memo else ",".join(map(str, self.encode_bytes(p.encode("utf-8", "surrogatepass")))) for p in pieces])

    def encode_all(self, texts: list[str]) -> list[str]:
        """Texts' ids in decimal, joined by commas. The pieces that are not in the memo are encoded together."""
        known, jobs, words, pieces = self.known, [], set(), set()
        for text in texts:
            parts = []
            for part in self.apart.split(text) if self.apart and "<|" in text else [text]:
                if part in self.special:
                    parts.append(str(self.special[part]))
                elif part and self.plain(part):
                    # a word with the blank or line end before it can be looked up whole
                    first, *rest = part.replace("\n", " \n").split(" ")
                    own = self.cut(first)
                    pieces.update(own)
                    words.update(rest)
                    parts.append((own, rest))
                elif part:
                    own = self._cut_up(part)
                    pieces.update(own)
                    parts.append((own, []))
            jobs.append(parts)
        if self.held > MEMO:
            # words that this chunk has again stay
            for memo, own in ((known, words), (self.pieces, pieces)):
                kept = {w: memo[w] for w in own.intersection(memo)}
                memo.clear()
                memo.update(kept)
            self.held = sum(150 + 2 * len(w) + len(got) for memo in (known, self.pieces) for w, got in memo.items())
        new = {w: self._cut_word(w) for w in words.difference(known)}
        for own in new.values():
            pieces.update(own)
        self.learn(p for p in pieces.difference(self.pieces) if len(p) <= SHORT and len(p.encode("utf-8", "surrogatepass")) <= SHORT)
        long = {}
        for w, own in new.items():
            got = self._join(own)
            if len(w) <= SHORT:
                known[w] = got
                self.held += 150 + 2 * len(w) + len(got)
            else:
                long[w] = got
        get = known.__getitem__ if not long else lambda w: long[w] if w in long else known[w]
        return [",".join([x if isinstance(x, str) else ",".join([self._join(x[0]), *map(get, x[1])]) for x in parts]) for parts in jobs]

    def encode(self, text: str) -> str:
        """One text's ids in decimal, joined by commas."""
        return self.encode_all([text])[0]

    def decoder(self):
        """A function from id strings to text that keeps the bytes of an unfinished character between calls."""
        return codecs.getincrementaldecoder("utf-8")("replace")

    def decode(self, ids: str, step: int = 4096) -> str:
        """The text of ids."""
        if not ids:
            return ""
        machine, table, tokens = self.decoder(), self.text_bytes, ids.split(",")
        out = [machine.decode(b"".join([table[t] for t in tokens[a : a + step]])) for a in range(0, len(tokens), step)]
        return "".join([*out, machine.decode(b"", True)])


class Tables:
    """What the transducers in lock step look up, as arrays: the trie of reversed tokens, the merges, and how tokens are built up at either end."""

    def __init__(self, m: Model):
        n = max(m.ids.values()) + 1
        self.size = np.zeros(n, np.int64)
        child: dict[int, int] = {}
        self.token = [-1]
        for b, i in m.ids.items():
            self.size[i], node = len(b), 0
            for x in reversed(b):
                node = child.setdefault(node << 8 | x, len(child) + 1)
                if node == len(self.token):
                    self.token.append(-1)
            self.token[node] = i
        self.token = np.array(self.token, np.int32)
        self.first = np.zeros(256, np.int64)  # the root's children; those of other nodes in order of node and byte
        for x in range(256):
            self.first[x] = child.get(x, 0)
        keys = np.array(list(child), np.int64)
        order = np.argsort(keys)
        self.edge, self.to = keys[order], np.array(list(child.values()), np.int64)[order]
        self.begin = np.searchsorted(self.edge, np.arange(len(self.token) + 1, dtype=np.int64) << 8)
        pairs = np.array([a << 32 | b for a, b in m.rank], np.int64)
        order = np.argsort(pairs)
        self.pair, self.rank = pairs[order], np.array([r for r, _ in m.rank.values()], np.int64)[order]
        self.ends = [self._spines(m, side, n) for side in (1, 0)]
        self.asked, self.answer = np.full(1 << PAIRS, -1, np.int64), np.zeros(1 << PAIRS, bool)

    @staticmethod
    def _spines(m: Model, side: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start, parts, ranks = np.zeros(n + 1, np.int64), [], []
        for t in range(n):
            if t in m.bytes:
                p, r = m.spine(t, side)
                parts += p
                ranks += [1 << 40 if x == float("inf") else x for x in r]
            start[t + 1] = len(parts)
        m.spines[side].clear()
        return start, np.array(parts, np.int64), np.array(ranks, np.int64)

    def child(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The trie's next nodes, 0 for none."""
        if not len(node) or node[0] == 0:
            return self.first[byte]
        key = node << 8 | byte
        at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
        return np.where(self.edge[at] == key, self.to[at], 0)

    def neighbours(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each b may follow its a; answers found before are kept as long as no other pair takes their place."""
        key = a.astype(np.int64) << 32 | b
        place = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIRS)).astype(np.int64)
        out, open_ = self.answer[place], np.flatnonzero(self.asked[place] != key)
        if len(open_):
            new, back = np.unique(key[open_], return_inverse=True)
            ok = self._walk(new >> 32, new & 0xFFFFFFFF)
            out[open_] = ok[back]
            at = place[open_]
            self.asked[at], self.answer[at] = key[open_], out[open_]
        return out

    def _walk(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Model.neighbours for arrays of pairs."""
        (left, lp, up), (right, rp, over) = self.ends
        i, i_end, j, j_end = left[a], left[a + 1] - 1, right[b], right[b + 1] - 1
        ok, own = np.ones(len(a), bool), np.arange(len(a))
        while len(own):
            x, y = up[i], over[j]
            key = lp[i] << 32 | rp[j]
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            across = np.where(self.pair[at] == key, self.rank[at], 1 << 41)
            bad = (across < x) & (across <= y)
            ok[own[bad]] = False
            go = ~bad & ((i < i_end) | (j < j_end))
            step = (x <= y)[go]
            own, i, i_end, j, j_end = own[go], i[go] + step, i_end[go], j[go] + ~step, j_end[go]
        return ok


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row, and with with_ids its ids as an array; encoded by the transducer and decoded by the state machine."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches):
        bpe = model(path)
        for table in chunks(batches, 1 << 20):
            n, ids_sha, text_sha, ids = [], [], [], []
            for joined in bpe.encode_all([t or "" for t in table.column("text").to_pylist()]):
                n.append(joined.count(",") + 1 if joined else 0)
                ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(joined).encode("utf-8", "surrogatepass")).hexdigest())
                if with_ids:
                    ids.append(np.fromstring(joined, np.int32, sep=",") if joined else np.zeros(0, np.int32))
            more = {}
            if with_ids:
                end = np.cumsum([0, *map(len, ids)])
                more["ids"] = pa.ListArray.from_arrays(pa.array(end, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
            yield record(doc_id=table.column("doc_id").combine_chunks(), n_tokens=pa.array(n, pa.int64()), ids_sha256=pa.array(ids_sha, pa.string()), decoded_sha256=pa.array(text_sha, pa.string()), **more)
        bpe.forget()
        give_back()

    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: every document encoded and decoded."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())
