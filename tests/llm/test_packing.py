import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpora import documents, odd_rows  # noqa: F401
from logquarry.llm.packing import OpenSequences, encoder, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


def test_ids_are_those_of_tokenizers(whole):
    encode, rng = encoder(PATH), random.Random(1)
    odd = [*" \n\t\r\x1c\x1f\x85\xa0    ​　", *"aA'sé1!?.ß𝄞\x00﻿日", "<|endoftext|>", "<|endoftext|", "|>", "'ll", " word"]
    for _ in range(3000):
        text = "".join(rng.choices(odd, k=rng.randint(0, 12)))
        assert encode(text) == whole.encode(text, add_special_tokens=False).ids, repr(text)
    assert encode("<|endoftext|>") == [50256] and len(encode("a <|endoftext|><|endoftext|> b")) == 5
    long = "a" * 50_000 + " " * 50_000 + "b"
    assert encode(long) == whole.encode(long, add_special_tokens=False).ids


def test_other_tokenizer_files():
    path = public_tokenizers.path("word_bpe_49k.json")
    assert encoder(path)("Some words") == Tokenizer.from_file(path).encode("Some words", add_special_tokens=False).ids


def check(rows, docs, whole, capacity, most_docs, most_cost):
    """Every document's ids in its pieces, and every sequence within its capacities."""
    ids = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 2] for i, t in docs}
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(ids)
    longest = min(capacity, int(most_cost**0.5))
    for i, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            part = np.array(ids[i][at : at + r.length], "<u4").tobytes()
            assert r.start == at and bytes(r.ids) == part and zlib.crc32(r.ids) == zlib.crc32(part)
            at += r.length
        assert at == len(ids[i])
        assert all(r.length == longest for r in own[1:]) and (len(own) == 1 or own[0].length <= longest)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(p.length for p in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) <= capacity and len(own) <= most_docs
        assert sum(r.length**2 for r in own) <= most_cost
    return len(sequences)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    return [(i, " ".join(rng.choices(["alpha", "beta", "été", "x"], k=int(rng.expovariate(1 / 60))))) for i in range(500)]


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_all_capacities_hold(documents, corpus, whole, rule):
    rows = pack(documents(corpus), PATH, capacity=128, max_docs=3, max_attention=80**2, rule=rule, group_items=200).collect()
    check(rows, corpus, whole, 128, 3, 80**2)


def test_few_sequences(documents, corpus, whole):
    rows = pack(documents(corpus), PATH, capacity=128).collect()
    tokens = sum(r.length for r in rows)
    assert check(rows, corpus, whole, 128, 128, 128**2) <= 1.01 * -(-tokens // 128) + 1


def test_choice_by_rule():
    for rule, expected in (("norm", 0), ("dot", 1)):
        open_ = OpenSequences((10, 9, 1000), (1.0, 0.0, 0.0), rule)
        assert open_.place(7) == (0, 0) and open_.place(5) == (1, 0)
        assert open_.place(3)[0] == expected


def test_odd_rows(documents, odd_rows, whole):
    rows = pack(documents(odd_rows), PATH).collect()
    alone = [(i, t) for i, t in odd_rows if i not in (None, 5)]
    kept = [r for r in rows if r.doc_id not in (None, 5)]
    assert {r.doc_id for r in kept} == {i for i, _ in alone}
    assert sum(r.length for r in rows) == sum(len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in odd_rows)
    assert len([r for r in rows if r.doc_id == 5]) == 2 and len([r for r in rows if r.doc_id is None]) == 2
    assert [bytes(r.ids) for r in rows if r.doc_id in (1, 2)] == [b"\x02\0\0\0"] * 2
    assert pack(documents([]), PATH).collect() == []
    with pytest.raises(ValueError):
        pack(documents([]), PATH, rule="worst")
