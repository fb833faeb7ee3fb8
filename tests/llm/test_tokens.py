import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from feedloom.llm import tokens

PARTS = ["a", "The", "it's", "'s", "don'T", " ", "  ", "\n", "\t", "\r\n", ".", ",", "###", "é", "ñandú", "12", "<|endoftext|>"]
PARTS += [" ", "　", "é", "日本", "Σς", "İ", "ß", "\x1c", "!?", "👍", "_", "I'LL", "x" * 80]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_equals_the_library_on_whole_texts(monkeypatch, name):
    monkeypatch.setattr(tokens, "REMEMBERED", 200)
    path = public_tokenizers.path(name)
    ours, theirs, rng = tokens.Encoder(path), Tokenizer.from_file(path), random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids, repr(text)
    assert ours.encode(None) == b"" and len(ours.known) <= 220


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_word_goes_to_the_library_once_whatever_signs_follow(monkeypatch, name):
    path = public_tokenizers.path(name)
    ours, theirs, asked = tokens.Encoder(path), Tokenizer.from_file(path), []
    monkeypatch.setattr(ours, "tokenize", lambda word: (asked.append(word), theirs.model.tokenize(word))[1])
    texts = ["one anstheed anstheed, anstheed; anstheed.", "one anstheed! ñandúed (anstheed) ñandúed?"]
    want = [theirs.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in ours.encode_many(tokens.pa.array(texts))] == want
    assert sum("anstheed" in w for w in asked) == 1 == sum(w.endswith("ed") and "and" in w for w in asked)
