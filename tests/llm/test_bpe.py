"""BPE: the tokenizers library's ids and texts, for every kind of text."""

import hashlib
import random
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from specloom.llm import bpe

TEXTS = [None, "", " ", "  ", "a  b   c \n d", "Er<|endoftext|>x 'll it's ", " <|endoftext|> <|endoftext|>", "éà \U0001f600  z\n\n  q", "word " * 3000, "x" * 9000, "ab" * 5000 + "'s's", "same", "same", "\x1c\x1f\x85\xa0 a　 b", "it's 'tis they'llx \n's", "꟎\U0001e6c0՘ Ᲊx"]


@cache
def library_():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_tokenizer())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def library():
    return library_()


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.default_tokenizer())


def check(library, encoder, texts):
    for text, ids in zip(texts, encoder.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text[:80]
        assert encoder.decode(ids).decode() == library.decode(want, skip_special_tokens=False)


def test_random_texts(library, encoder):
    rng = random.Random(5)
    kinds = ["abcdefghij", "ABCabc019+/=", "etaoin shrdlu", "  \n\t\r'stmvrdl", "中文字符한국어日本", "éßþ\U0001f600́‍", "0123456789.,-", "aaab", "'s<|endoftext|>"]
    texts = ["".join(rng.choices(rng.choice(kinds) + rng.choice(kinds), k=rng.choice([1, 5, 40, 63, 64, 65, 200, 3000]))) for _ in range(400)]
    check(library, encoder, texts)
    check(library, encoder, texts[::-1])  # now many parts are known


def test_long_words(library, encoder):
    rng = random.Random(6)
    check(library, encoder, ["a" * 300_000, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=200_000)), "".join(rng.choices("ABCDabcd0123+/", k=100_000)), "-" * 100_001, "\n" * 5000 + "x"])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_any_text(texts):
    check(library_(), bpe.worker_encoder(bpe.default_tokenizer()), texts)


def test_kept_parts_are_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 50)
    encoder = bpe.Encoder(bpe.default_tokenizer())
    rng = random.Random(7)
    for _ in range(20):
        check(library, encoder, [" ".join("".join(rng.choices("abcd", k=4)) for _ in range(30)) for _ in range(4)])
        assert len(encoder.young) <= 50


def test_partial_characters_decode_as_the_library(library, encoder):
    rng = np.random.default_rng(8)
    for _ in range(200):
        ids = rng.integers(0, 50257, 12)
        assert encoder.decode(ids.astype("<u4").tobytes()).decode() == library.decode(ids.tolist(), skip_special_tokens=False)


def test_query(spark, library):
    rows = [(k, t, "en") for k, t in enumerate(TEXTS)] + [(None, "no id", None), (3, TEXTS[3], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = sorted((tuple(r) for r in bpe.digest(bpe.decode_documents(bpe.encode_documents(docs))).collect()), key=str)
    want = []
    for k, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert found == sorted(want, key=str)
    assert bpe.digest(bpe.decode_documents(bpe.encode_documents(docs.where("doc_id < -1")))).count() == 0


def test_other_files_are_refused(tmp_path):
    import json

    with open(bpe.default_tokenizer()) as file:
        whole = json.load(file)
    for change in ({"normalizer": {"type": "NFC"}}, {"added_tokens": [{**whole["added_tokens"][0], "lstrip": True}]}, {"model": {**whole["model"], "merges": whole["model"]["merges"][::-1]}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(whole | change))
        with pytest.raises(ValueError):
            bpe.Vocabulary(str(path))
