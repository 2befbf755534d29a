"""Pairs of tokens: undoing merges says the same as replaying them. Units encoded side by side are as the library's."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from almoner.llm import sentencepiece_codec
from almoner.llm.common import Remembered
from almoner.llm.queries import tokenizer_model
from almoner.llm.sentencepiece_codec import Codec

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_pairs_of_tokens_equal_replayed_merges():
    codec, rng = Codec(tokenizer_model()), random.Random(4)
    ids = list(codec.ids.values())
    short = [i for i in ids if len(codec.pieces[i]) <= 3]
    pairs = [(rng.choice(pool), rng.choice(pool)) for pool in (ids, short) for _ in range(6000)]
    # Tokens whose texts are cut out of one piece touch along edges that merges go over.
    for i in rng.sample(ids, 3000):
        piece = codec.pieces[i]
        for k in range(1, len(piece)):
            if piece[:k] in codec.ids and piece[k:] in codec.ids:
                pairs.append((codec.ids[piece[:k]], codec.ids[piece[k:]]))
    pairs += [(i, i) for i in rng.sample(short, 300)]
    said = set()
    for a, b in pairs:
        expected = codec.merged(codec.pieces[a] + codec.pieces[b])[0] == [codec.pieces[a], codec.pieces[b]]
        assert codec._compatible(a * codec.size + b) == expected
        said.add(expected)
    assert said == {True, False}
    for i in rng.sample(ids, 2000):
        assert codec._compatible(i) == (codec.merged(codec.pieces[i])[0] == [codec.pieces[i]])


def _texts(codec, seed):
    """Words made of pieces, some with characters the model lacks, long ones, and repeated ones."""
    rng, pieces = random.Random(seed), [p.replace("▁", "") for p in codec.ids]
    words = ["".join(rng.choices(pieces, k=rng.randrange(1, 7))) for _ in range(1500)]
    words += ["😀".join(rng.choices(pieces, k=3)) + "\x00" for _ in range(50)] + ["ab" * 32, "x" * 64, "".join(rng.choices(pieces, k=60))]
    gaps = [" ", " ", " ", "  ", "\n", " ▁", ". ", ", "]
    return ["", " ", "\n", *("".join(w + rng.choice(gaps) for w in rng.choices(words, k=700)) for _ in range(6)), "a"]


def test_fresh_words_are_encoded_side_by_side(monkeypatch):
    codec = Codec(tokenizer_model())
    alone, encode = [], codec.encode_unit
    monkeypatch.setattr(codec, "encode_unit", lambda unit: alone.append(unit) or encode(unit))
    for text in _texts(codec, 1):
        ids = LIBRARY.encode(text)
        assert codec.encode(text) == ids and codec.whole(text)[1] == LIBRARY.decode(ids)
    # Alone: what is long, has a character that the model lacks, or comes among few.
    plain = [u for u in alone if len(u) <= 64 and "😀" not in u]
    assert len(alone) > 20 and len(plain) < 200


@pytest.mark.parametrize("together", [1, 7, 8192])
def test_small_tables_give_the_same_ids(monkeypatch, together):
    monkeypatch.setattr(sentencepiece_codec, "FEW", 1)
    monkeypatch.setattr(sentencepiece_codec, "TOGETHER", together)
    monkeypatch.setattr(sentencepiece_codec, "AT_ONCE", 150)
    codec = Codec(tokenizer_model())
    codec.next_states = sentencepiece_codec.Noted(codec.next_states.make, 4)
    codec.fitting = sentencepiece_codec.Noted(codec.fitting.make, 4)
    codec.units = Remembered(codec._unit, 40)
    texts = _texts(codec, 2)[: 6 if together > 1 else 4]
    expected = [LIBRARY.encode(t) for t in texts]
    found = list(codec.wholes(texts))
    assert [ids for ids, _ in found] == [",".join(map(str, ids)).encode() for ids in expected]
    assert [text for _, text in found] == [LIBRARY.decode(ids) for ids in expected]


def test_noted_numbers_of_many_keys():
    made = []
    noted = sentencepiece_codec.Noted(lambda key: made.append(key) or key % 1000, 6)
    rng = np.random.default_rng(3)
    for n in (0, 1, 20, 500, 5):
        keys = rng.integers(0, 1 << 40, n) if n != 20 else np.repeat(np.arange(4), 5)
        assert (noted[keys] == keys % 1000).all() and (noted[keys[::-1]] == keys[::-1] % 1000).all()
        assert (noted.keys >= 0).sum() <= 32
    assert sorted(made[:6])[:4] == [0, 1, 2, 3]
