import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm import fixture
from tidings.llm import bpe

PATH = bpe.vocabulary_path()
TOOL = Tokenizer.from_file(PATH)
TOOL.no_truncation()
TOOL.no_padding()


def same(text):
    ids = TOOL.encode(text, add_special_tokens=False).ids
    m = bpe.model(PATH)
    got = m.encode(text)
    assert got == ",".join(map(str, ids))
    assert m.decode(got) == TOOL.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab e'sSt \n\t\r  　é中😀<|>endoftx1½_-"), max_size=60))
def test_equals_the_library(text):
    same(text)


def test_special_tokens_odd_space_and_long_pieces():
    for t in ("x<|endoftext|>y <|endoftext|>", "a\xa0 b\xa0\xa0  c \x1c d\x85e", "'ll 'LL I'd've", " \n\n  x  \n ", "<|endof"):
        same(t)
    rng = random.Random(0)
    same("".join(rng.choice("etaoinshr") for _ in range(4000)))
    same("a" * 3000)
    same("ab" * 1500 + "   " + "=" * 700 + "\n" * 900)
    same("é中" * 800)


def test_broken_ids_decode_like_the_library():
    m, rng = bpe.model(PATH), random.Random(2)
    for _ in range(300):
        ids = [rng.randrange(256) if rng.random() < 0.7 else rng.randrange(50257) for _ in range(12)]
        assert m.decode(",".join(map(str, ids)), 2) == TOOL.decode(ids, skip_special_tokens=False)


def test_transducer_keeps_few_states():
    m, raw = bpe.model(PATH), b"etaoinshrdlu" * 3000
    it, most = m.encode_bytes(raw), 0
    got = []
    for t in it:
        got.append(t)
        most = max(most, len(it.gi_frame.f_locals["last"]) if it.gi_frame else 0)
    assert most < 4 * (m.longest + bpe.SHORT) and b"".join(m.bytes[t] for t in got) == raw


def test_rows(spark, tmp_path):
    expected = {}
    for doc_id, text, *_ in fixture.rows():
        ids = TOOL.encode(text or "", add_special_tokens=False).ids
        expected[doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(TOOL.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r[0]: tuple(r[1:]) for r in bpe.query(spark, fixture.table(spark, tmp_path)).collect()}
    assert got == expected
    assert bpe.query(spark, fixture.table(spark, tmp_path, [])).count() == 0


def test_neighbours_by_ranks_equal_merging():
    m, rng = bpe.model(PATH), random.Random(7)
    same_letter = [i for b, i in m.ids.items() if len(set(b)) <= 2 and len(b) < 20]
    for k in range(6000):
        pool = same_letter if k % 2 else range(256, 50256)
        a, b = rng.choice(pool), rng.choice(pool)
        assert m.neighbours(a, b) == (m.merge([m.ids[bytes((x,))] for x in m.bytes[a] + m.bytes[b]]) == [a, b]), (m.bytes[a], m.bytes[b])
    assert all(m.merge([m.ids[bytes((x,))] for x in m.bytes[t]]) == [t] for t in rng.sample(range(50256), 2000))
