"""Byte-level BPE against the tokenizer library, and round trips."""

from __future__ import annotations

import hashlib
import random
import struct
import unicodedata

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pairloom.llm import byte_bpe
from tests.llm.helpers import awkward, frame, plain

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Encoder(PATH)


@pytest.fixture(scope="module")
def decoder():
    return byte_bpe.Decoder(PATH)


def packed(ids) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def check(codec, decoder, library, texts):
    mine = codec.encode(texts)
    theirs = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert mine == [packed(i) for i in theirs]
    assert [decoder.decode(i) for i in mine] == [library.decode(i, skip_special_tokens=False) for i in theirs] == texts


def test_awkward_characters(codec, decoder, library):
    rng = random.Random(5)
    alphabet = [*"abcdeE 's't\n\t\r\x0b\xa0 　漢é123٣²½!?_<|>́ßж\0\x1c\x85", "\U0001f600", "<|endoftext|>", "<|endoftext", "'ll", "'S", "  "]
    alphabet += ["՘", "\U000187f9", "꟎", "�"]  # characters that some versions know and others don't
    check(codec, decoder, library, ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(5000)])


def test_words_of_every_length(codec, decoder, library):
    rng = random.Random(6)
    texts = ["a" * n for n in range(300)] + ["".join(rng.choices("abcdefgh", k=n)) for n in range(0, 300, 3)]
    check(codec, decoder, library, texts + ["ab" * 20_000, "é" * 3000, "".join(rng.choices("etaoin", k=30_000))])


def test_rows_and_single_words_agree(codec):
    rng = random.Random(7)
    words = ["".join(rng.choices("etaoinshr", k=rng.randrange(1, 65))).encode() for _ in range(300)]
    assert codec.merges.encode(words) == [codec.merges.single(w) for w in words]


def test_every_character_is_split_as_the_library_does(codec, decoder, library):
    known = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    for at in range(0, len(known), 20_000):
        text = "".join(f"a{c}1{c}! " for c in known[at : at + 20_000])
        assert [len(w) for some in codec.words(text) for w in some] == [b - a for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_long_texts_in_stretches(codec, decoder, library, monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choices(["the ", "Einfluß ", "  ", "\n", "x1", " 'll", "漢字"], k=400)) for _ in range(30)]
    monkeypatch.setattr(byte_bpe, "STRETCH", 50)
    monkeypatch.setattr(byte_bpe, "FLUSH_CHARS", 500)
    monkeypatch.setattr(byte_bpe, "CACHE_WORDS", 40)
    check(codec, decoder, library, texts)


def test_decoding_of_any_ids(codec, decoder, library):
    rng = random.Random(9)
    for _ in range(500):
        ids = [rng.randrange(50_400) for _ in range(20)]  # broken characters, ids without a piece
        assert decoder.decode(packed(ids)) == library.decode(ids, skip_special_tokens=False)


def test_frames(spark, library):
    rows = awkward()
    digest = byte_bpe.digest(frame(spark, rows, clashes=True)).collect()
    expected = []
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected.append((i, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert plain(digest) == plain(expected)
    assert byte_bpe.digest(frame(spark, [])).count() == 0


def test_other_columns_stay(spark):
    df = frame(spark, awkward()).withColumns({"ids": F.lit("old"), "row": F.lit(1), "value": F.lit(2), "a.b": F.lit(3)})
    encoded = byte_bpe.encode(df)
    assert encoded.columns == [*[c for c in df.columns if c != "ids"], "ids"]
    back = byte_bpe.decode(encoded)
    assert all(r["decoded"] == (r["text"] or "") and (r["row"], r["value"], r["a.b"]) == (1, 2, 3) for r in back.collect())
    assert byte_bpe.decode(spark.createDataFrame([(None,)], "ids binary")).first()["decoded"] == ""
