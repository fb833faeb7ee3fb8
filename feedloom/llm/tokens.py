"""Token ids from the public tokenizers, with the ids of repeated pieces kept between texts.

A text is cut at spaces into pieces whose ids do not depend on what is around them; a worker
has the tokenizers library encode each distinct piece once, until it holds a bounded number and
starts anew.
Texts in which a cut could matter go to the library whole. The path of the vocabulary file is a
parameter; every executor must have it.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words and odd pieces (or eight times as many ids) after which a worker forgets all of them.
REMEMBERED = 1 << 20
#: Bytes of text that are cut at a time.
PORTION = 1 << 24

#: White space beside a space: the byte-level pattern looks across it.
_AMBIGUOUS = re.compile(r"[\s᠎] (?:[\s᠎]|\Z)")
#: Latin letters, and the signs after them: two words of the pre-tokenizers' patterns at most.
_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_SIGNS = ".,;:!?#$%&*|()"


def _visible() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for
    themselves, the others in order from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


_VISIBLE = _visible()


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: A vocabulary with word ends drops white space, others keep it before a word.
        self.word_ends = bool(self.tokenizer.model.end_of_word_suffix)
        self._forget()
        self.tokenize = self.tokenizer.model.tokenize
        self._tail = lru_cache(maxsize=4096)(self._signs)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _shown(self, word: str) -> str | None:
        """A word in the characters of the merges, if it is of letters alone."""
        if word.isascii():
            if not word.isalpha():
                return None
            if self.word_ends:
                word = word.lower()
        elif _WORD.fullmatch(word):
            word = "".join([_VISIBLE[b] for b in (word.lower() if self.word_ends else word).encode()])
        else:
            return None
        return word if self.word_ends else "Ġ" + word

    def _signs(self, tail: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(tail)]).tobytes()

    def _learn(self, word: str) -> bytes | None:
        """The ids of a word as it stands after a space, or None if it is not of letters alone."""
        ids = self.known.get(word, b"")
        if ids == b"":
            shown = self._shown(word)
            # For words of the pre-tokenizers' patterns the merges alone decide.
            ids = None if shown is None else array("I", [t.id for t in self.tokenize(shown)]).tobytes()
            self.held += len(ids or b"") // 4
            self.known[word] = ids
        return ids

    def _odd(self, piece: str) -> bytes:
        """The ids of any other piece as it stands after a space."""
        ids = self.odd.get(piece)
        if ids is None:
            ids = self.whole(piece if self.word_ends else " " + piece) if piece or not self.word_ends else b""
            self.odd[piece] = ids
            self.held += len(ids) // 4
        return ids

    def _forget(self) -> None:
        self.known: dict[str, bytes | None] = {}
        self.odd: dict[str, bytes] = {}
        #: Ids that these hold.
        self.held = 0

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_many(pa.array([text], pa.string())))

    def encode_many(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text, in order."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(texts):
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + PORTION, "right")))
            yield from self._portion(texts[start:end])
            start = end

    def _portion(self, texts: pa.Array) -> Iterator[bytes]:
        if len(self.known) + len(self.odd) > REMEMBERED or self.held > 8 * REMEMBERED:
            self._forget()
        texts = pc.fill_null(texts, "")
        apart: dict[int, bytes] = {}
        if self.word_ends:
            texts = pc.replace_substring(texts, "\n", " ")
        else:
            for i, text in enumerate(texts.to_pylist()):
                if _AMBIGUOUS.search(text):
                    apart[i] = self.whole(text)
            if apart:
                keep = np.ones(len(texts), bool)
                keep[list(apart)] = False
                texts = pc.if_else(pa.array(keep), texts, "")
        lists = pc.split_pattern(texts, " ")
        cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        pieces = pc.dictionary_encode(lists.flatten())
        own, at = self._pieces(pieces.dictionary), pieces.indices
        if not self.word_ends:
            # Pieces stand after a space, but the first of a text.
            at = at.to_numpy().copy()
            at[cuts[:-1]] = np.arange(len(texts)) + len(own)
            at = pa.array(at)
            own += [self.whole(h) if h else b"" for h in _strings(pc.list_element(lists, 0))]
        # Each piece's ids are copied to its places as bytes.
        line = pa.array(own, pa.large_binary()).take(at)
        _, ends, ids = line.buffers()
        bounds = np.frombuffer(ends, np.int64, len(line) + 1)[cuts].tolist()
        ids = memoryview(ids) if ids else b""
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            yield apart[i] if i in apart else bytes(ids[a:b])

    def _pieces(self, pieces: pa.Array) -> list[bytes]:
        """The ids of distinct pieces: those of their words, and of the signs after them."""
        words = pc.ascii_rtrim(pieces, characters=_SIGNS)
        signs = (pc.binary_length(pieces).to_numpy() - pc.binary_length(words).to_numpy()).astype(np.int64)
        if self.word_ends:
            # Other capitals stay, so that a word of letters is one before as after.
            words = pc.ascii_lower(words)
        words = _strings(words)
        own = list(map(self.known.get, words))
        missing = [i for i, ids in enumerate(own) if ids is None]
        for i in missing:
            own[i] = self._learn(words[i])
        tailed, tail = np.flatnonzero(signs), self._tail
        for i, n, piece in zip(tailed.tolist(), signs[tailed].tolist(), _strings(pieces.take(pa.array(tailed)))):
            if own[i] is not None:
                own[i] += tail(piece[-n:])
        odd = [i for i in missing if own[i] is None]
        for i, piece in zip(odd, _strings(pieces.take(pa.array(odd, pa.int64())))):
            own[i] = self._odd(piece)
        return own


def _strings(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path)
