"""Ids and decoded texts against the sentencepiece library."""

import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusdelta.llm import pieces, queries
from tests.conftest import SF_SMALL

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXT = st.one_of(st.text(max_size=80), st.text(alphabet="aabehst ▁'’rlvdm\n\t\r 019.,!é中\x00\x85　�", max_size=80),
                 st.lists(st.sampled_from(["the", "aaaa", " ", "     ", "'ll", "ing", "\n\n", "=-=-", "123", "<s>", "<0x41>", "𐍈"]), max_size=60).map("".join))


@given(TEXT)
@settings(max_examples=1500, deadline=None)
def test_ids_and_text_equal_the_library(text):
    enc = pieces.encoder(PATH)
    ids = enc.encode(text).tolist()
    assert ids == LIBRARY.encode(text)
    assert enc.decode(ids).decode() == LIBRARY.decode(ids)


@given(st.lists(st.one_of(st.integers(0, 31999), st.integers(0, 262), st.sampled_from([0, 1, 2, 28705])), max_size=8))
@settings(max_examples=1500, deadline=None)
def test_any_ids_decode_as_in_the_library(ids):
    assert pieces.encoder(PATH).decode(ids).decode() == LIBRARY.decode(ids)


def test_long_stretches_take_linear_work():
    enc = pieces.encoder(PATH)
    for text in ("ab" * 30_000, "a" * 50_000, " " * 30_000 + "x", "é" * 20_000, "=" * 20_001, "\r" * 5_000):
        assert enc.encode(text).tolist() == LIBRARY.encode(text)


def test_runs_of_blanks_of_every_length():
    enc = pieces.encoder(PATH)  # all pieces of blanks have one score, so only the place decides
    for n in range(120):
        for text in (" " * n, "x" + " " * n + "y"):
            assert enc.encode(text).tolist() == LIBRARY.encode(text)


def test_cuts_change_no_result():
    enc = pieces.encoder(PATH)
    for text in ("▁a▁b.c▁▁▁d", "▁un▁éon,▁le", "▁it's▁'s▁12▁3"):
        joined = [i for s in enc.stretch.findall(text) for i in enc.encode_stretch(s)]
        assert [enc.piece[i] for i in joined] == enc.remerge(text)


def test_whole_table_and_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "x" * 30_000), (-3, "x" * 30_000), (None, "n"), (-4, "   ")], "doc_id long, text string")
    rows = docs.union(odd).selectExpr("*", "1 AS ids", "text AS decoded", "2 AS _value")
    want = sorted((str(r.doc_id), len(i := LIBRARY.encode(r.text or "")), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(),
                   hashlib.sha256(LIBRARY.decode(i).encode()).hexdigest()) for r in rows.collect())
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((str(r[0]), *r[1:]) for r in queries.op12_pieces(spark, str(tmp_path)).collect()) == want
    back = pieces.decode(pieces.encode(rows, PATH), PATH).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in back) == sorted((str(r.doc_id), r.text or "") for r in rows.collect())
    assert pieces.round_trip(rows.limit(0), PATH).count() == 0


def test_other_models_are_refused(monkeypatch):
    class Changing(sentencepiece.SentencePieceProcessor):
        def normalize(self, text):
            return text.strip()

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Changing)
    with pytest.raises(ValueError):
        pieces._Encoder(PATH)
