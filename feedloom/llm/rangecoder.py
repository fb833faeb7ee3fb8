"""A block coder for token ids: adaptive context mixing and a range coder, in numpy lanes.

A block's ids are cut into up to LANES equal runs that are coded side by side: step t codes the
t-th id of every lane, then the block's one model learns all of them. The model mixes three
predictions linearly: order 0 (counts of the block so far), order 1 (the id last seen after the
previous one) and order 2 (after the previous two), with weights learned for every pair of the
two contexts' confidences. The whole interval begins with the weight of order 2 for its id and
that of order 1 for its own (one interval if these are the same); other ids have their share of
order 0 after them. Each lane has a carry-less range coder with a 64-bit low end that
emits 32-bit words. Every block starts from an empty model and carries checksums of its bytes
and of its ids, so blocks can be read on their own.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES, STEPS = 4096, 256
#: Bits of the whole interval, of order 0's part before its weight, and of a weight unit.
TOTAL, ORDER0 = 30, 19
UNITS = 1 << (TOTAL - ORDER0)
#: Slots for order-2 contexts.
SLOTS = 1 << 19
_SHIFT = np.uint32(32 - 19)
HEAD = struct.Struct("<IIIII")

_BOTTOM, _LOW = np.uint64(1 << 32), np.uint64((1 << 32) - 1)
_32, _30, _ORDER0 = np.uint64(32), np.uint64(30), np.uint64(ORDER0)
#: Of order 1 and 2, by the place of an interval (see ``predict``): change of trust (0 to 7), and
#: bits that let the new id in after a miss that leaves no trust.
_PLACE = np.arange(256)
_SURE = [_PLACE & 7, _PLACE >> 3 & 7]
_HIT = [_PLACE >> 6 & 1, _PLACE >> 7]
_CHANGE = [(np.where(h, np.minimum(s + 1, 7), s >> 1) - s).astype(np.int32) for h, s in zip(_HIT, _SURE)]
_LET_IN = [np.where((h == 0) & (s < 2), -1, 0).astype(np.int32) for h, s in zip(_HIT, _SURE)]
#: Steps after which order 0 is counted anew.
_RECOUNTED = {0, 1, 2, 4, 8, 16, 32, *range(64, STEPS + 1, 64)}


class _Model:
    """What encoder and decoder know after the same steps."""

    def __init__(self, vocabulary: int, lanes: int):
        self.size = vocabulary
        self.counts = np.zeros(vocabulary, np.uint64)
        self.spare = np.uint64((1 << ORDER0) - vocabulary)
        self.flat = np.arange(vocabulary + 1, dtype=np.uint64)
        #: Per context the id last seen, times 8, plus how often it came true (up to 7).
        self.known = [np.zeros(vocabulary, np.int32), np.zeros(SLOTS, np.int32)]
        self.seen = np.zeros((3, 64))
        self.before = [np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)]
        self.fresh: list[np.ndarray] = []
        self.step = 0
        self.inverse: np.ndarray | None = None

    def ids_at(self, values: np.ndarray) -> np.ndarray:
        """The ids whose part of order 0 holds the values."""
        if self.inverse is None:
            # Every id has a part: the marks where they begin count the ids.
            marks = np.zeros(int(self.cumulated[-1]), np.int32)
            marks[self.cumulated[1:-1].astype(np.intp)] = 1
            self.inverse = np.cumsum(marks, dtype=np.int32)
        return self.inverse.take(values, mode="clip")

    def predict(self, lanes: int) -> None:
        """What the contexts say: ``found`` for order 1 and 2, and each lane's ``state`` of their
        trust. ``starts`` and ``widths`` are those of the whole interval by state, in rows for an
        id that neither, order 1 alone, order 2 alone or both expect; the width for neither is
        that of a unit of order 0. ``ends`` is where order 2's interval ends, alone or with both."""
        if self.step in _RECOUNTED or self.step > STEPS:
            self._recount()
        one, two = self.before[0][:lanes], self.before[1][:lanes]
        mixed = two.view(np.uint32) * np.uint32(0x9E3779B1) ^ one.view(np.uint32) * np.uint32(0x85EBCA77)
        self.at = [one.astype(np.intp), (mixed >> _SHIFT).astype(np.intp)]
        self.found = [k.take(a, mode="wrap") for k, a in zip(self.known, self.at)]
        self.state = (((self.found[1] & 7) << 3) + (self.found[0] & 7)).astype(np.intp)
        n, first, second = self.seen
        share = (UNITS - 3) / (n + 1.5)
        u1 = 1 + (share * (first + 0.25)).astype(np.uint64)
        u2 = 1 + (share * (second + 0.25)).astype(np.uint64)
        w1, w2 = u1 << _ORDER0, u2 << _ORDER0
        self.starts = np.concatenate([w1 + w2, w2, 0 * w2, 0 * w2])
        self.widths = np.concatenate([UNITS - u1 - u2, w1, w2, w1 + w2])
        self.ends = self.widths[128:]

    def _recount(self) -> None:
        if self.fresh:
            self.counts += np.bincount(np.concatenate(self.fresh), minlength=self.size).astype(np.uint64)
            self.fresh = []
        self.inverse = None
        total = max(np.uint64(1), self.counts.sum())
        self.cumulated = self.flat.copy()
        self.cumulated[1:] += np.cumsum(self.counts) * self.spare // total
        if not self.counts.any():
            self.cumulated[-1] = 1 << ORDER0

    def learn(self, ids: np.ndarray, key: np.ndarray) -> None:
        """Take in each lane's id and the place of its interval in ``starts`` and ``widths``."""
        lanes = len(ids)
        none, first, second, both = np.bincount(key, minlength=256).reshape(4, 64)
        self.seen += [none + first + second + both, first, second + both]
        moved = (ids << 3) + 1
        for k, found in enumerate(self.found):
            found += _CHANGE[k].take(key, mode="wrap")
            found ^= (found ^ moved) & _LET_IN[k].take(key, mode="wrap")
            self.known[k][self.at[k]] = found
        self.before[1][:lanes] = self.before[0][:lanes]
        self.before[0][:lanes] = ids
        self.fresh.append(ids)
        self.step += 1


def _settled(low: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coders whose span is below 32 bits, cut so that the top 32 bits of their place are certain."""
    out = np.flatnonzero(span < _BOTTOM)
    low, span = low[out], span[out]
    return out, low, np.minimum(span, _BOTTOM - (low & _LOW))


def _quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a // b`` where that is below 2^19: in doubles, which are one off at most, set right."""
    found = (a.astype(np.float64) / b.astype(np.float64)).astype(np.int64)
    left = (a - found.view(np.uint64) * b).view(np.int64)
    found -= left < 0
    found += left >= b.view(np.int64)
    return found


def _layout(n: int) -> tuple[int, int]:
    """Lanes and steps of a block of n ids."""
    lanes = min(LANES, -(-n // STEPS)) or 1
    return lanes, -(-n // lanes)


def encode_block(ids: np.ndarray, vocabulary: int) -> bytes:
    """A block of ids below ``vocabulary`` (at most 2^19)."""
    ids = np.asarray(ids, np.int32)
    n = len(ids)
    lanes, steps = _layout(n)
    model = _Model(vocabulary, lanes)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    owners, words = [], []
    grid = np.zeros(lanes * steps, np.int32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    for t in range(steps if n else 0):
        k = (n - t + steps - 1) // steps
        own = grid[t, :k]
        model.predict(k)
        cum, (one, two) = model.cumulated, model.found
        key = model.state + (one >> 3 == own) * np.intp(64)
        key += (two >> 3 == own) * np.intp(128)
        start, width = model.starts.take(key, mode="wrap"), model.widths.take(key, mode="wrap")
        at = np.flatnonzero(key < 64)
        share, rare = width.take(at, mode="wrap"), own.take(at, mode="wrap").astype(np.intp)
        below = cum.take(rare, mode="wrap")
        start[at] += share * below
        rare += 1
        width[at] = share * (cum.take(rare, mode="wrap") - below)
        unit = span[:k] >> _30
        low[:k] += unit * start
        np.multiply(unit, width, out=span[:k])
        at, a, b = _settled(low[:k], span[:k])
        owners.append(at.astype(np.uint16))
        words.append((a >> _32).astype(np.uint32))
        low[at], span[at] = a << _32, b << _32
        model.learn(own, key)
    for shift in (32, 0):
        owners.append(np.arange(lanes, dtype=np.uint16))
        words.append((low >> np.uint64(shift)).astype(np.uint32))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    sizes = np.bincount(owner, minlength=lanes).astype("<u4")
    body = sizes.tobytes() + np.concatenate(words)[order].astype("<u4").tobytes()
    return HEAD.pack(n, vocabulary, len(body), zlib.crc32(body), zlib.crc32(ids.astype("<u4").tobytes())) + body


def decode_block(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """The ids of the block that starts at a place of ``data``, and where it ends."""
    n, vocabulary, size, body_crc, ids_crc = HEAD.unpack_from(data, at)
    at += HEAD.size
    body = data[at : at + size]
    if len(body) != size or zlib.crc32(body) != body_crc:
        raise ValueError("damaged block")
    lanes, steps = _layout(n)
    sizes = np.frombuffer(body, "<u4", lanes).astype(np.int64)
    words = np.frombuffer(body, "<u4", offset=4 * lanes).astype(np.uint64)
    place = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    model = _Model(vocabulary, lanes)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    #: The code's distance from the low end.
    rest = np.zeros(lanes, np.uint64)
    for _ in range(2 if n else 0):
        rest = (rest << _32) | words[place]
        place += 1
    grid = np.empty((steps, lanes), np.int32)
    for t in range(steps if n else 0):
        k = (n - t + steps - 1) // steps
        model.predict(k)
        cum, state = model.cumulated, model.state
        one, two = (f >> 3 for f in model.found)
        unit, left = span[:k] >> _30, rest[:k]
        # Order 2's interval comes first (with order 1's if they agree), then order 1's, then the others.
        kinds = (one == two) * np.intp(64) + state
        past = left >= model.ends.take(kinds, mode="wrap") * unit
        own = two + (one - two) * past
        key = np.where(past, state, kinds + np.intp(64)) + np.intp(64)
        of = np.flatnonzero(left >= model.starts.take(state, mode="wrap") * unit)
        key[of] -= 64
        start, width = model.starts.take(key, mode="wrap"), model.widths.take(key, mode="wrap")
        share, first, own_unit = width.take(of, mode="wrap"), start.take(of, mode="wrap"), unit.take(of, mode="wrap")
        rare = model.ids_at(_quotient(left.take(of, mode="wrap") - first * own_unit, share * own_unit)).astype(np.intp)
        own[of] = rare
        below = cum.take(rare, mode="wrap")
        start[of] = first + share * below
        rare += 1
        width[of] = share * (cum.take(rare, mode="wrap") - below)
        start *= unit
        low[:k] += start
        left -= start
        np.multiply(unit, width, out=span[:k])
        grid[t, :k] = own
        lane, x, y = _settled(low[:k], span[:k])
        low[lane], span[lane] = x << _32, y << _32
        at_lane = place.take(lane)
        rest[lane] = (rest.take(lane) << _32) | words.take(at_lane, mode="clip")
        place[lane] = at_lane + 1
        model.learn(own, key)
    ids = grid.T.reshape(-1)[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("damaged ids")
    return ids, at + size
