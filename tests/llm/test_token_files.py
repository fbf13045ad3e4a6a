"""Token files: the code, the order, and equality with the library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusdelta.llm import token_files as tf
from tests.conftest import SF_SMALL

PATH = public_tokenizers.path("byte_bpe_50k.json")


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=70))
@settings(max_examples=200, deadline=None)
def test_code_round_trip(numbers):
    control, data = tf.pack(np.array(numbers, np.uint32))
    assert len(control) == -(-len(numbers) // 4)
    assert len(data) == sum(max(1, (n.bit_length() + 7) // 8) for n in numbers)
    assert tf.unpack(control, data, len(numbers)).tolist() == numbers


def expected(rows):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    out, start = [], 0
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("block", [1 << 18, 40])
def test_files_hold_the_library_ids_in_order(spark, monkeypatch, block):
    monkeypatch.setattr(tf, "BLOCK_TOKENS", block)
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("abc thé\n'sl 中12!😀") for _ in range(rng.randint(0, 80)))) for i in range(-20, 60)]
    rows[3], rows[4], rows[5] = (rows[3][0], None), (rows[4][0], ""), (rows[5][0], "x" * 20000 + " <|endoftext|>")
    shuffled = rows[:]
    rng.shuffle(shuffled)
    df = spark.createDataFrame([(t, i, 0) for i, t in shuffled], "text string, doc_id long, n int")
    got = tf.round_trip(df, PATH)
    assert sorted(map(tuple, got.collect())) == expected(rows)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    assert sorted(map(tuple, tf.round_trip(docs, PATH).collect())) == expected(rows)


def test_repeated_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (None, "zz"), (1, "a b"), (0, None)], "doc_id long, text string")
    got = sorted(map(tuple, tf.round_trip(df, PATH).collect()), key=lambda r: r[1])
    assert got == expected([(None, "zz"), (0, None), (1, "a b"), (1, "a b")])
    assert tf.round_trip(df.limit(0), PATH).count() == 0


def test_registered_query_equals_the_plain_library(spark, tmp_path):
    from corpusdelta.llm import pretokenize, queries

    t = Tokenizer.from_file(PATH)
    newer = [chr(c) for c in np.flatnonzero(pretokenize.library_classes(t.pre_tokenizer) != pretokenize.classes()).tolist() if not 0xD800 <= c < 0xE000]
    assert "\u088f" in newer and "\u0c5c" in newer
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext", "it's <|endoftext|>'s", None, "plain"]
    texts += [f"a{c}b 1{c}2 {c}" for c in newer[::50]] + ["".join(map(chr, range(1, 0x3000)))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want, start = [], 0
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert t.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    assert sorted(map(tuple, queries.op9_token_files(spark, str(tmp_path)).collect())) == want
