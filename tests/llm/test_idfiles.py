import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from feedloom.llm import idfiles, rangecoder
from feedloom.llm.storage import materialised

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 5000])
@pytest.mark.parametrize("vocabulary", [1, 3, 49408])
def test_blocks_survive(n, vocabulary):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, vocabulary, n), rng.zipf(1.3, n) % vocabulary, np.full(n, vocabulary - 1), np.arange(n) % 3 % vocabulary):
        data = rangecoder.encode_block(ids, vocabulary)
        found, end = rangecoder.decode_block(b"ab" + data + b"more", 2)
        assert found.tolist() == ids.tolist() and end == len(data) + 2


def test_contexts_pay():
    text = np.tile(np.random.default_rng(1).integers(0, 40000, 50), 2000)
    assert len(rangecoder.encode_block(text, 49408)) < len(text) * 2 / 4


def test_tables_are_made_and_coders_moved_seldom(monkeypatch):
    counted, moved, steps = [], [], rangecoder.STEPS
    recount, settled = rangecoder._Model._recount, rangecoder._settled
    monkeypatch.setattr(rangecoder._Model, "_recount", lambda self: (counted.append(1), recount(self))[1])
    monkeypatch.setattr(rangecoder, "_settled", lambda *a: (moved.append(1), settled(*a))[1])
    ids = np.random.default_rng(2).integers(0, 49408, 8 * steps)
    assert rangecoder.decode_block(rangecoder.encode_block(ids, 49408))[0].tolist() == ids.tolist()
    assert len(counted) <= 2 * 20 and len(moved) == 2 * steps


def test_damage_is_noticed():
    data = bytearray(rangecoder.encode_block(np.arange(1000), 2000))
    data[200] ^= 1
    with pytest.raises(ValueError):
        rangecoder.decode_block(bytes(data))


@pytest.mark.parametrize("block", [1 << 20, 1000])
def test_round_trip_in_order(docs, awkward, monkeypatch, block):
    monkeypatch.setattr(idfiles, "BLOCK_IDS", block)
    encode = Tokenizer.from_file(PATH).encode
    rows, _ = materialised(idfiles.round_trip(docs, PATH, ids=True), "test-ids")
    rows = sorted(rows.collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((i for i, _ in awkward), key=lambda i: (i is not None, i or 0))
    want = sorted((i is not None, i or 0, tuple(encode(t or "", add_special_tokens=False).ids) + (2,)) for i, t in awkward)
    got = [(r["doc_id"] is not None, r["doc_id"] or 0, tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in rows]
    assert sorted(got) == want
    at = 0
    for r in rows:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4 and r["ids_crc32"] == zlib.crc32(r["ids"])
        at += r["n_tokens"]


def test_empty_table(no_docs):
    assert idfiles.round_trip(no_docs, PATH).count() == 0


def test_an_id_and_its_interval_are_looked_up_together(monkeypatch):
    looked_up = []
    learn = rangecoder._Model.learn
    monkeypatch.setattr(rangecoder._Model, "learn", lambda self, ids, key: (looked_up.append((self.state, key)), learn(self, ids, key))[1])
    ids = np.random.default_rng(3).zipf(1.2, 4000) % 500
    data = rangecoder.encode_block(ids, 500)
    half = len(looked_up)
    assert rangecoder.decode_block(data)[0].tolist() == ids.tolist() and len(looked_up) == 2 * half
    for (state, key), (same_state, same_key) in zip(looked_up[:half], looked_up[half:]):
        assert (state == same_state).all() and (key == same_key).all() and (key % 64 == state).all() and key.max() < 256
