import random
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from tests.llm import fixture
from tidings.llm import mph, token_store
from tidings.llm.work import Workspace


def test_rows_equal_the_library(spark, tmp_path):
    sf = fixture.table(spark, tmp_path)
    tool = Tokenizer.from_file(token_store.vocabulary_path("word_bpe_49k.json"))
    start, expected = 0, {}
    for doc_id, text, *_ in sorted(fixture.rows()):
        ids = [*tool.encode(text or "", add_special_tokens=False).ids, 2]
        expected[doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r[0]: tuple(r[1:4]) for r in token_store.query(spark, sf).collect()}
    assert got == expected


def test_special_strings_and_exotic_space(spark):
    tool = Tokenizer.from_file(token_store.vocabulary_path("word_bpe_49k.json"))
    texts = ["a<|endoftext|>b <|startoftext|>", "x y \x1c z\xa0\xa0w", "İstanbul ΣΑΣ é ́x", "don't 'S can'T"]
    enc = token_store.WordEncoder(token_store.vocabulary_path("word_bpe_49k.json"))
    for t, b in zip(texts, enc(texts, 2), strict=True):
        assert np.frombuffer(b, enc.dtype).tolist() == [*tool.encode(t, add_special_tokens=False).ids, 2]


def test_keyed_access_nulls_and_repeated_keys(spark, tmp_path):
    data = [(None, "x", None, None, None), (7, "b c", None, None, None), (7, "a", None, None, None), (9, None, None, None, None), (-3, "q", None, None, None)]
    df = spark.createDataFrame(data, fixture.SCHEMA).coalesce(1)
    ws = Workspace(spark, "t")
    m = ws.stage(token_store.write(spark, df, ws.path("s"), token_store.vocabulary_path("word_bpe_49k.json")), "m")
    got = token_store.read(token_store.with_base(m)).collect()
    assert sorted((r[0] is not None, r[0] or 0) for r in got) == [(False, 0), (True, -3), (True, 7), (True, 7), (True, 9)]
    found = [x.tolist() for r in m.collect() for x in token_store.Shard(r["uri"]).get(7)]
    assert len(found) == 2 and all(x[-1] == 2 for x in found)
    assert all(token_store.Shard(r["uri"]).get(8) == [] for r in m.collect())


def test_empty_table(spark, tmp_path):
    assert token_store.query(spark, fixture.table(spark, tmp_path, [])).count() == 0


def test_perfect_hash():
    keys = np.random.default_rng(0).integers(0, 2**63, 20000).astype(np.uint64)
    keys = np.unique(keys)
    n = mph.Lookup(*mph.build(keys))(keys)
    assert sorted(n.tolist()) == list(range(len(keys)))


def test_stems_encode_like_their_words():
    tool = Tokenizer.from_file(token_store.vocabulary_path("word_bpe_49k.json"))
    enc = token_store.WordEncoder(token_store.vocabulary_path("word_bpe_49k.json"))
    for w in ("Word,", "word.", "WORD", "a.,", "it's,", "Ünter.", "x1,", ",", "..", "ﬁn!", "don't.", "'s", "S,"):
        assert np.frombuffer(enc([w], 2)[0], enc.dtype).tolist() == [*tool.encode(w, add_special_tokens=False).ids, 2]


def test_texts_of_odd_characters_encode_as_by_the_library():
    path = token_store.vocabulary_path("word_bpe_49k.json")
    tool, enc, rng = Tokenizer.from_file(path), token_store.WordEncoder(path), random.Random(3)
    odd = [*"aZsStTdDrReElLvmMWK''\u2019..,,-!<|>5\u00bd\u00e9\u00c9\u00d7\u00f7\u00df\u0130\u03a3\u017f\u212a\u00e6\u00c6\u00aa\u00b5_^`\n\t   \xa0\x1c\r\x0b\u4e2d\uac00\u0436\U0001f600", "\u0338", "\u0327", "\u0301", "\u030a"]
    odd += ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "'s", "'RE", "don't", "\u00c9\u0301", "state-of"]
    texts = ["".join(rng.choices(odd, k=rng.randint(0, 14))) for _ in range(6000)]
    for at in range(0, len(texts), 500):
        for t, b in zip(texts[at : at + 500], enc(texts[at : at + 500], 2), strict=True):
            assert np.frombuffer(b, enc.dtype).tolist() == [*tool.encode(t, add_special_tokens=False).ids, 2], ascii(t)


def test_words_of_letters_pass_no_normalizer():
    """Normalizing and cutting cost the library as much as its model: for words of letters only the model is asked, and for signs once each."""
    path = token_store.vocabulary_path("word_bpe_49k.json")
    enc, asked = token_store.WordEncoder(path), []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return whole.encode_batch_fast(texts, **options)

    whole, enc.tool = enc.tool, Counting()
    text = "The (Thonre) \u00dcber-gr\u00f6\u00dfe, caf\u00e9s! re\u00f1ir&&& and-the. state-of-the-art"
    (got,) = enc([text], 2)
    assert np.frombuffer(got, enc.dtype).tolist() == [*whole.encode(text, add_special_tokens=False).ids, 2]
    assert sorted(asked) == ["!", "&&&", "(", ")", ",", "-", "."]


def test_texts_without_words():
    enc = token_store.WordEncoder(token_store.vocabulary_path("word_bpe_49k.json"))
    stop = np.array([2], enc.dtype).tobytes()
    assert enc([], 2) == [] and enc([""], 2) == [stop] and enc(["", " \n\t", ""], 2) == [stop] * 3
    data, counts = enc.column(pa.array([None, "the", None, ""]).slice(0, 3), 2)
    assert counts.tolist() == [1, 2, 1] and data.size == 4 * enc.dtype.itemsize
