"""Token ids as raw binary shards, with a minimal perfect hash index of document keys.

A shard file: an 8-byte mark, the ids of its documents end to end as little-endian unsigned integers (2 bytes each where
the vocabulary allows it, else 4), then the index: keys and id counts in file order, the levels of the perfect hash, and
for each of its numbers a 32-bit fingerprint and the key's first record. A look-up hashes the key, compares the fingerprint
and reads the payload at one offset. Shards are ranges of the key, so ascending shards hold ascending keys; each is
written by one task as a stream under a name of the attempt and then renamed, so a retried task repeats its own work only.

Edge cases: null text is an empty document (its end id only); rows with a null key come first and are stored but not
indexed; rows with equal keys are stored one after another (ordered by a hash of the text) and a look-up returns all of
them, from each shard whose range holds the key; very long texts are encoded whole, one batch of about 4 MB or one text at a
time; an empty table writes no shard; extra columns, also ones named key, tie or shard, are ignored.
"""

import io
import json
import os
import string
import unicodedata
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm import mph
from tidings.llm.work import Workspace, chunks, n_tasks, record

MARK = b"tidtok1\n"
KNOWN = 700_000  # pieces of words kept between batches by a worker; a memo, so its size only affects speed
LONG = 64  # longer ones stay out of the memo, which bounds its bytes
RUN = 256  # words that the library's model gets at once
END_ID = 2
_encoders: dict = {}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _bytes(*groups) -> bytes:
    """A table of the 256 bytes: 1 for those in the groups."""
    held = {x for g in groups for x in g}
    return bytes(x in held for x in range(256))


def _are(data: np.ndarray, table: bytes) -> np.ndarray:
    return np.frombuffer(data.tobytes().translate(table), bool)


# Letters of Latin-1 beyond ASCII are byte 0xC3 and one of TAIL; none of them, nor an ASCII sign, joins with what is before it.
LEAD, TAIL, UPPER_TAIL = 0xC3, {*range(0x80, 0xC0)} - {0x97, 0xB7}, {*range(0x80, 0x9F)} - {0x97}
BLANKS, UPPER = _bytes(b" \n\t"), _bytes(range(65, 91))
ALNUM, TAILS, UPPER_TAILS = _bytes(string.ascii_letters.encode(), string.digits.encode()), _bytes(TAIL), _bytes(UPPER_TAIL)
PLAIN = _bytes(range(97, 123), [LEAD], TAIL - UPPER_TAIL)


class WordEncoder:
    """Ids of texts by the tokenizers library, which is asked once for each distinct piece of a word.

    Valid for tokenizers that compose (NFC), lower-case, drop white space and cut signs from letters and numbers, as
    word_bpe_49k does: a text's ids are then those of its pieces. Bytes are cut and lower-cased only where no such rule, no
    contraction ('s) and no special token reaches across. A piece of small Latin-1 letters is one word as it stands, so the
    library's model gets it in runs, and the last token of each, which its suffix tells, ends it; other pieces pass the whole
    tokenizer one by one.
    """

    def __init__(self, path: str, wide: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tool = Tokenizer.from_file(path)
        self.tool.no_truncation()
        self.tool.no_padding()
        self.words = Tokenizer(self.tool.model)
        self.words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.dtype = np.dtype("<u4" if wide or self.tool.get_vocab_size() > 1 << 16 else "<u2")
        self.last = np.zeros(self.tool.get_vocab_size(), bool)
        self.last[[i for t, i in self.tool.get_vocab(with_added_tokens=False).items() if t.endswith(self.tool.model.end_of_word_suffix)]] = True
        self.special = [t.content.encode() for t in self.tool.get_added_tokens_decoder().values()]
        signs = {*string.punctuation.encode()}.difference(*self.special)
        self.signs, self.joints = _bytes(signs), _bytes(signs - {*b"'"})
        self.known: dict[bytes, bytes] = {}

    def pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts in order, without blanks, and how many there are up to the end of each text."""
        texts = texts.fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        data = np.full(len(raw) + 2, 32, np.uint8)  # a blank before and after
        data[1:-1] = raw
        latin = np.zeros(len(data), bool)
        latin[1:] = _are(data[1:], TAILS) & (data[:-1] == LEAD)
        small = _are(data, UPPER) | (latin & _are(data, UPPER_TAILS))
        small[:-1] &= (data[1:] < 128) | (data[1:] == LEAD)
        lower = data | (small.view(np.uint8) << 5)
        if all(lower.tobytes().count(t) == raw.tobytes().count(t) for t in self.special):
            data = lower
        blank, alnum = _are(data, BLANKS), _are(data, ALNUM)
        letter, first = alnum | latin, alnum | np.roll(latin, -1)
        start = blank[:-2] | (letter[:-2] & _are(data[1:-1], self.signs)) | (_are(data[:-2], self.joints) & first[1:-1])
        start[offsets[:-1][offsets[:-1] < len(raw)]] = True
        keep = ~blank[1:-1]
        start &= keep
        bounds = np.append(np.flatnonzero(start[keep]), np.count_nonzero(keep))
        out = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data[1:-1][keep])])
        return out, np.searchsorted(np.flatnonzero(start), offsets[1:])

    def stem(self, piece: bytes) -> tuple[bytes, ...]:
        """Letters of other scripts and a last sign, which the tokenizer cuts apart itself; other pieces as they are. Some letters end with a mark once composed or lower-cased, and a sign joins with it."""
        if piece[-1] in b".,;:!?" and unicodedata.normalize("NFC", piece[:-1].decode()).lower().isalpha():
            return piece[:-1], piece[-1:]
        return (piece,)

    def codes(self, pieces: pa.Array) -> list[bytes]:
        """The ids of distinct pieces."""
        if len(self.known) > KNOWN:
            self.known = {}
        keys = pieces.to_numpy(zero_copy_only=False).tolist()
        out = list(map(self.known.get, keys))
        missing = [i for i, x in enumerate(out) if x is None]
        if not missing:
            return out
        starts, data = np.frombuffer(pieces.buffers()[1], np.int64)[: len(keys)], np.frombuffer(pieces.buffers()[2], np.uint8)
        plain = np.logical_and.reduceat(_are(data, PLAIN), starts).tolist()
        stems = {i: self.stem(keys[i]) for i in missing if not plain[i]}
        new = list({x for two in stems.values() for x in two}.difference(self.known))
        asked = self.tool.encode_batch_fast([x.decode() for x in new], add_special_tokens=False)
        got = {x: np.array(enc.ids, self.dtype).tobytes() for x, enc in zip(new, asked, strict=True)}
        for i, two in stems.items():
            out[i] = b"".join(got[x] if x in got else self.known[x] for x in two)
        words = [i for i in missing if plain[i]]
        for at in range(0, len(words), RUN):
            run = words[at : at + RUN]
            (enc,) = self.words.encode_batch_fast([[keys[i].decode() for i in run]], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(enc.ids, self.dtype)
            ends = ((np.flatnonzero(self.last[ids]) + 1) * self.dtype.itemsize).tolist()
            ids = ids.tobytes()
            for i, a, b in zip(run, [0, *ends[:-1]], ends, strict=True):
                out[i] = ids[a:b]
        got.update((keys[i], out[i]) for i in missing)
        self.known.update((x, ids) for x, ids in got.items() if len(x) <= LONG)
        return out

    def column(self, texts: pa.Array, end: int) -> tuple[pa.Buffer, np.ndarray]:
        """The ids of all texts end to end, each with the end id, and the number of each."""
        pieces, ends = self.pieces(texts)
        coded = pieces.dictionary_encode()
        codes = self.codes(coded.dictionary)
        codes.append(np.array([end], self.dtype).tobytes())
        at = np.insert(coded.indices.to_numpy(), ends, len(codes) - 1)
        out = pa.array(codes, pa.large_binary()).take(pa.array(at))
        offsets = np.frombuffer(out.buffers()[1], np.int64)[: len(at) + 1]
        to = offsets[ends + np.arange(1, len(ends) + 1)]
        return out.buffers()[2][: int(offsets[-1])], np.diff(to, prepend=0) // self.dtype.itemsize

    def __call__(self, texts: list[str], end: int) -> list[bytes]:
        data, counts = self.column(pa.array(texts, pa.large_string()), end)
        to = np.cumsum(counts * self.dtype.itemsize).tolist()
        return [data[a:b].to_pybytes() for a, b in zip([0, *to], to, strict=False)]


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_shard(uri: str, batches, encode, end: int = END_ID) -> dict | None:
    """One shard from tables (key, text) in key order; what it holds, or None for no rows."""
    where, path = _open(uri)
    keys, counts, ok, out, part = [], [], [], None, f"{path}.{uuid.uuid4().hex}.part"
    for table in batches:
        if out is None:
            where.create_dir(os.path.dirname(path), recursive=True)
            out = where.open_output_stream(part)
            out.write(MARK)
        col = table.column("key").combine_chunks()
        ids, n = encode.column(table.column("text").combine_chunks(), end)
        out.write(ids)
        counts.append(n)
        keys.append(col.fill_null(0).to_numpy().astype(np.int64))
        ok.append(col.is_valid().to_numpy(zero_copy_only=False))
    if out is None:
        return None
    keys, counts, ok = np.concatenate(keys), np.concatenate(counts), np.concatenate(ok)
    distinct, first = np.unique(keys[ok].view(np.uint64), return_index=True)
    first = np.flatnonzero(ok)[first]
    sizes, bits = mph.build(distinct)
    number = mph.Lookup(sizes, bits)(distinct)
    prints, slot = np.zeros(len(distinct), np.uint32), np.zeros(len(distinct), np.int64)
    prints[number], slot[number] = mph.fingerprint(distinct), first
    index = io.BytesIO()
    np.savez(index, keys=keys, counts=counts, ok=ok, sizes=sizes, bits=bits, prints=prints, slot=slot)
    out.write(index.getvalue())
    tail = json.dumps({"width": encode.dtype.itemsize, "index": len(index.getvalue())}).encode()
    out.write(tail + len(tail).to_bytes(8, "little"))
    out.close()
    where.move(part, path)
    return {"n_docs": len(keys), "n_ids": int(counts.sum()), "low": int(keys[ok].min()) if ok.any() else None, "high": int(keys[ok].max()) if ok.any() else None}


class Shard:
    """A shard opened for reading: keyed look-ups, or all documents in file order."""

    def __init__(self, uri: str):
        where, path = _open(uri)
        self.file = where.open_input_file(path)
        size = self.file.size()
        n = int.from_bytes(self.file.read_at(8, size - 8), "little")
        head = json.loads(self.file.read_at(n, size - 8 - n))
        parts = np.load(io.BytesIO(self.file.read_at(head["index"], size - 8 - n - head["index"])))
        self.keys, self.counts, self.ok, self.prints, self.slot = (parts[k] for k in ("keys", "counts", "ok", "prints", "slot"))
        self.dtype = np.dtype(f"<u{head['width']}")
        self.start = np.concatenate([[0], np.cumsum(self.counts)])
        self.number = mph.Lookup(parts["sizes"], parts["bits"])

    def records(self, keys: np.ndarray) -> np.ndarray:
        """First records of keys, -1 where a key is not in the shard."""
        if not len(self.slot):
            return np.full(len(keys), -1)
        bits = keys.astype(np.int64).view(np.uint64)
        n = self.number(bits)
        hit = (n >= 0) & (self.prints[n] == mph.fingerprint(bits))
        at = np.where(hit, self.slot[n], -1)
        return np.where((at >= 0) & (self.keys[at] == keys), at, -1)

    def ids(self, record_: int) -> np.ndarray:
        w = self.dtype.itemsize
        raw = self.file.read_at(int(self.counts[record_]) * w, len(MARK) + int(self.start[record_]) * w)
        return np.frombuffer(raw, self.dtype)

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of every document with this key."""
        at, out = int(self.records(np.array([key]))[0]), []
        while 0 <= at < len(self.keys) and self.ok[at] and self.keys[at] == key:
            out.append(self.ids(at))
            at += 1
        return out


def write(spark, docs: DataFrame, folder: str, path: str, key: str = "doc_id", text: str = "text", end: int = END_ID) -> DataFrame:
    """Writes all docs as shards under folder; the manifest, one row a shard: shard, uri, n_docs, n_ids, low, high, base (ids in the shards before)."""
    dealt = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = dealt.repartitionByRange(n_tasks(spark), "key", "tie").sortWithinPartitions("key", "tie").drop("tie")

    def run(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        uri = f"{folder}/shard-{shard:06d}.tok"
        if got := write_shard(uri, chunks(batches, 4 << 20), encoder(path), end):
            yield pa.RecordBatch.from_pylist([{"shard": shard, "uri": uri, **got}], schema=pa.schema([("shard", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("low", pa.int64()), ("high", pa.int64())]))

    return dealt.mapInArrow(run, "shard int, uri string, n_docs long, n_ids long, low long, high long")


def with_base(manifest: DataFrame) -> DataFrame:
    """Adds the number of ids in earlier shards. One row a shard: as many as write tasks."""
    from pyspark.sql import Window as W

    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """Every document of the shards, each found by its key through the index: doc_id, start, n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard, before = Shard(row["uri"]), None
                at = shard.records(shard.keys)
                n = len(shard.keys)
                crc = np.zeros(n, np.int64)
                for i in range(n):
                    # equal keys and null keys follow the record that the index gives
                    r = int(at[i]) if shard.ok[i] and shard.keys[i] != before else i
                    crc[r] = zlib.crc32(shard.ids(r).astype("<u4").tobytes())
                    before = shard.keys[i] if shard.ok[i] else None
                keys = pa.array(shard.keys, mask=~shard.ok)
                yield record(doc_id=keys, start=row["base"] + shard.start[:-1], n_tokens=shard.counts, ids_crc32=crc)

    spread = manifest.repartition(n_tasks(manifest.sparkSession), "shard")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: all documents written as shards and read back from them."""
    ws = Workspace(spark, "op1")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = ws.stage(write(spark, docs, ws.path("shards"), vocabulary_path("word_bpe_49k.json")), "manifest")
    return read(ws.stage(with_base(manifest), "based"))
