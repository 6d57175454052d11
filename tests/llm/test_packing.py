"""Packing: exact contents, gapless places, and few sequences."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from specloom.llm import packing

TEXTS = [None, "", " ", "a  b   c \n d", "Er<|endoftext|>x 'll it's ", "éà \U0001f600  z\n\n  q", "word " * 3000, "x" * 9000, "same text here", "same text here"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en") for k, t in enumerate(TEXTS)] + [(None, "no id", None), (8, TEXTS[8], "en"), (8, TEXTS[8], "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, length string")


def brute(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


def test_pieces_are_the_documents(docs):
    rows = packing.pack_documents(docs).collect()
    found = defaultdict(list)
    for r in rows:
        found[r["doc_id"]].append(r)
    for k, text in enumerate(TEXTS):
        ids, at = brute(text), 0
        own = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found[k]})
        for piece, start, length, crc in own:
            assert start == at and (piece == 0 or length == 1024)
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids) and [p[0] for p in own] == list(range(-(-len(ids) // 1024)))
    assert len(found[None]) == 1 and len(found[8]) == 3
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024


def test_sequences_hold_the_ids(docs):
    rows = packing.sequences(docs).collect()
    assert all(len(r["ids"]) <= 1024 for r in rows)
    assert sum(len(r["ids"]) for r in rows) == sum(len(brute(t)) for t in [*TEXTS, "no id", TEXTS[8], TEXTS[8]])
    one = next(r for r in rows if any(p["doc_id"] == 3 for p in r["pieces"]))
    p = next(p for p in one["pieces"] if p["doc_id"] == 3)
    assert one["ids"][p["offset"] : p["offset"] + p["length"]] == brute(TEXTS[3])


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "text string, doc_id long, piece string")).count() == 0


def _check(counts, capacity):
    plan = packing.make_plan(counts, capacity)
    used = defaultdict(list)
    for s, n in counts.items():
        sequence, offset = plan.places(np.full(n, s), np.arange(n))
        for q, o in zip(sequence.tolist(), offset.tolist()):
            used[q].append((o, s))
    for own in used.values():
        at = 0
        for o, s in sorted(own):
            assert o == at
            at += s
        assert at <= capacity
    assert len(used) == plan.sequences
    return plan.sequences


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_reduction_keeps_an_optimum(sizes):
    """Sequences of the fixed sets plus the optimum of the rest is the optimum of all."""

    def optimum(items, capacity=20):
        best = [len(items)]

        def go(k, rooms):
            if len(rooms) >= best[0]:
                return
            if k == len(items):
                best[0] = len(rooms)
                return
            for i in sorted({r: i for i, r in enumerate(rooms)}.values()):
                if rooms[i] >= items[k]:
                    rooms[i] -= items[k]
                    go(k + 1, rooms)
                    rooms[i] += items[k]
            go(k + 1, [*rooms, capacity - items[k]])

        items = sorted(items, reverse=True)
        go(0, [])
        return best[0]

    fixed, left = packing.reduce_instance(Counter(sizes), 20)
    rest = [s for s, n in left.items() for _ in range(n)]
    assert Counter(s for f, n in fixed for s in f * n) + Counter(rest) == Counter(sizes)
    assert sum(n for _, n in fixed) + optimum(rest) == optimum(sizes)
    _check(Counter(sizes), 20)


def test_large_instances_come_near_the_bound():
    rng = random.Random(5)
    for sizes in ([rng.randint(1, 1024) for _ in range(20000)], [min(1024, int(rng.lognormvariate(5.5, 1))) or 1 for _ in range(20000)]):
        assert _check(Counter(sizes), 1024) <= -(-sum(sizes) // 1024) * 1.01 + 1


def test_kept_words_are_bounded():
    """Neither many words nor long ones stay with a worker."""
    words = packing.Words(packing.default_tokenizer())
    texts = ["a " + "x" * 50_000 + " y", "b " + "long\n" * 900 + " z", "short words only"]
    assert [len(x) // 4 + 1 for x in words.ids(texts)] == [len(brute(t)) for t in texts]
    assert max(map(len, words.known)) <= packing.CACHED_LENGTH and "words" in words.known


def test_new_words_are_encoded_together():
    """A word costs the tokenizer no text of its own, and has the ids that it has there; odd words and long ones among them too."""
    words, encoded = packing.Words(packing.default_tokenizer()), []
    encode = words._encode
    words._encode = lambda texts: encoded.extend(texts) or encode(texts)
    odd = ["a\n b", "tab\tbed x", " lead", "end ", "", "x \nab c", "it's 12,5 \u00a0\u3000z \x1c \x85 q", "<|endoftext|> in <|endoftext|>", "\u0120 \u0120x", "y" * 70 + " y " + "z" * 70 + "\t w", "a\x00b \U0001f600\U0001f600 k"]
    texts = [*odd, " ".join(f"w{k:03d}q" for k in range(900))]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in words.ids(texts)] == [brute(t)[:-1] for t in texts]
    assert len(encoded) < 100 and len(words.pool) < 10_000


def test_repeated_words_are_looked_up_once(monkeypatch):
    """Only distinct words of a batch become Python objects; the ones met most often outlive the others; ids stay the tokenizer's."""

    class Counting(packing._Numbers):
        asked = 0

        def __getitem__(self, word):
            Counting.asked += 1
            return super().__getitem__(word)

    words = packing.Words(packing.default_tokenizer())
    words.known = Counting()
    text = "to be or not " * 5_000
    assert np.frombuffer(words.ids([text, "", text])[2], "<u4").tolist() == brute(text)[:-1]
    assert Counting.asked < 20
    monkeypatch.setattr(packing, "CACHED_WORDS", 60)
    words, encoded = packing.Words(packing.default_tokenizer()), []
    encode = words._encode
    words._encode = lambda texts: encoded.extend(texts) or encode(texts)
    for k in range(40):
        own = ["a common words " + " ".join(f"w{k}q{j}" for j in range(20)), "x common \u3000 words", "a \u00a0 b", "end common ", "c\td common\x85 words", "y" * 70 + " " + "z" * 70, ""]
        assert [np.frombuffer(x, "<u4").tolist() for x in words.ids(own)] == [words.encoder.encode(t, add_special_tokens=False).ids for t in own]
        assert len(words.known) < 120 and len(words.start) < 120
    assert sum(" common " in f"{t} " and t != own[1] for t in encoded) == 1


ODD_PARTS = ["a", "b1", " ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\u00a0", "\u3000", "'s", "\u00e9", "\U0001f600", "<|endoftext|>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ODD_PARTS), max_size=12).map("".join), max_size=6))
def test_any_white_space_gives_the_tokenizers_ids(texts):
    words = packing._worker_words(packing.default_tokenizer())
    assert [np.frombuffer(x, "<u4").tolist() for x in words.ids(texts)] == [words.encoder.encode(t, add_special_tokens=False).ids for t in texts]
