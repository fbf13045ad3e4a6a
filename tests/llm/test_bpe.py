"""Ids against the tiktoken library, decoding against the text."""

import hashlib

import public_tokenizers
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusdelta.llm import bpe
from corpusdelta.llm.pretokenize import Memo, split, split_many
from tests.conftest import SF_SMALL

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
PATTERN = regex.compile(public_tokenizers.PATTERN)
TEXT = st.one_of(st.text(max_size=80), st.text(alphabet="aabehst '’rlvdm\n\t\r 019.,!é中\x1c\x85　", max_size=80),
                 st.lists(st.sampled_from(["the", "aaaa", " ", "'ll", "''", "ing", "\n\n", "=-=-", "123", "x"]), max_size=60).map("".join))


@given(TEXT)
@settings(max_examples=1500, deadline=None)
def test_ids_and_pieces_equal_the_library(text):
    enc = bpe.encoder(PATH)
    assert split(text) == PATTERN.findall(text)
    ids = enc.encode(text).tolist()
    assert ids == LIBRARY.encode_ordinary(text)
    assert enc.decode(ids) == text.encode()


@given(st.lists(TEXT, max_size=8))
@settings(max_examples=1000, deadline=None)
def test_many_texts_are_split_as_each(texts):
    pieces, sizes = split_many(texts)
    assert list(sizes) == [len(split(t)) for t in texts]
    assert pieces.to_pylist() == [p for t in texts for p in split(t)]


def test_every_letter_and_number_has_the_library_class():
    enc = bpe.encoder(PATH)
    for lo in range(0, 0x3000, 64):
        for c in map(chr, range(lo, lo + 64)):
            for t in (f"a{c}a", f"1{c}1", f" {c}"):
                assert enc.encode(t).tolist() == LIBRARY.encode_ordinary(t), hex(ord(c))


def test_long_pieces_take_linear_work():
    enc = bpe.encoder(PATH)
    for text in ("ab" * 30_000, "a" * 50_000, " " * 30_000 + "x", "é" * 20_000, "=" * 20_001):
        assert enc.encode(text).tolist() == LIBRARY.encode_ordinary(text)


def test_memo_is_bounded():
    calls = []
    memo = Memo(lambda k: calls.append(k) or len(k), size=10)
    for _ in range(3):
        for i in range(100):
            memo["often"], memo[f"k{i}"]
    assert len(memo) + len(memo.older) <= 20 and calls.count("often") == 1
    assert memo["x" * 100] == 100 and "x" * 100 not in memo


def test_worker_rests_with_small_memory(spark):
    docs = spark.createDataFrame([(d, " ".join(f"q{d}x{k}z" for k in range(45_000))) for d in (1, 2)], "doc_id long, text string").coalesce(1)
    assert bpe.round_trip(docs, PATH).count() == 2

    def held(_):
        enc = bpe.encoder(PATH)
        yield len(enc.memo) + len(enc.memo.older), len(enc.pairs)

    after = spark.sparkContext.parallelize(range(8), 8).mapPartitions(held).collect()
    assert max(a for a, _ in after) <= 1 << 16 and max(b for _, b in after) <= 1 << 16
    enc = bpe._Encoder(bpe.load_ranks(PATH))
    text = " ".join(f"q{k}z" for k in range(70_000))
    before = enc.encode(text).tolist()
    enc.rest()
    assert len(enc.memo) + len(enc.memo.older) <= 1 << 16 and enc.encode(text).tolist() == before == LIBRARY.encode_ordinary(text)


def test_whole_table_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "x" * 30_000), (-3, "x" * 30_000), (None, "n")], "doc_id long, text string")
    rows = docs.union(odd).selectExpr("*", "1 AS ids", "text AS decoded")
    want = sorted((str(r.doc_id), len(i := LIBRARY.encode_ordinary(r.text or "")), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(),
                   hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows.collect())
    assert sorted((str(r[0]), *r[1:]) for r in bpe.round_trip(rows, PATH).collect()) == want
    back = bpe.decode(bpe.encode(rows, PATH), PATH).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in back) == sorted((str(r.doc_id), (r.text or "").encode()) for r in rows.collect())
    assert bpe.round_trip(rows.limit(0), PATH).count() == 0
