"""Context-mixing range coder for blocks of token ids.

A block is coded by itself.  Its distinct ids, in order of first appearance,
form a dictionary, coded by a fixed prior; the block is then a sequence of
places in that dictionary, of which the next unused one means a new id.  Each
place is predicted by three models: order 2 and order 1 remember which place
last followed the two before it, or the one before it, and how sure that is;
order 0 counts the places so far.  The mixture gives weight to the two by how
often such predictions, equally sure, have been right in this block, and the
rest to order 0; it drives an arithmetic coder of 64-bit range.

All blocks of a call are coded side by side, one step of all blocks at a time,
in integers, so that the decoder repeats the same steps.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
TOTAL_BITS = 30            # all frequencies of a step add up to at most this power of two
SHARES = 64                # a step's mixture is dealt in so many shares
_Z = 1 << 24               # frequency of a share: SHARES * _Z == 1 << TOTAL_BITS
_SURE = 3                  # most that a remembered place is sure: how often in a row it was right
_SURER = np.minimum(np.arange(_SURE + 1) + 1, _SURE)
_HASH_BITS = 13            # of the table of order 2
_RATE = 5
_EVERY = 128               # steps between renewals of the order-0 frequencies


class _Writer:
    """Range coders side by side."""

    def __init__(self, lanes: int, steps: int):
        self.low = np.zeros(lanes, _U)
        self.range = np.full(lanes, 2 ** 64 - 1, _U)
        self.words = np.zeros((lanes, steps + 3), np.uint32)  # a step writes one word at most
        self.used = np.zeros(lanes, np.int64)

    def put(self, lanes: slice | np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        low, step = self.low[lanes], self.range[lanes] >> _U(TOTAL_BITS)
        add = step * start.astype(_U)
        low = low + add
        over = low < add
        if over.any():
            self._carry(np.arange(len(self.low))[lanes][over])
        span = step * size.astype(_U)
        short = np.flatnonzero(span < _U(1 << 32))
        if len(short):
            at = np.arange(len(self.low))[lanes][short]
            self.words[at, self.used[at]] = low[short] >> _U(32)
            self.used[at] += 1
            low[short] <<= _U(32)
            span[short] <<= _U(32)
        self.low[lanes], self.range[lanes] = low, span

    def _carry(self, lanes: np.ndarray) -> None:
        at = self.used[lanes] - 1
        while len(lanes):
            self.words[lanes, at] += 1
            on = self.words[lanes, at] == 0
            lanes, at = lanes[on], at[on] - 1

    def finish(self) -> list[bytes]:
        lanes = np.arange(len(self.low))
        for part in (self.low >> _U(32), self.low & _U(0xFFFFFFFF)):
            self.words[lanes, self.used] = part
            self.used += 1
        return [self.words[i, :n].astype("<u4").tobytes() for i, n in enumerate(self.used.tolist())]


class _Reader:
    def __init__(self, parts: list[bytes]):
        size = max(map(len, parts)) // 4 + 2
        self.words = np.zeros((len(parts), size), np.uint32)
        for i, p in enumerate(parts):
            self.words[i, :len(p) // 4] = np.frombuffer(p, "<u4")
        self.code = (self.words[:, 0].astype(_U) << _U(32)) | self.words[:, 1].astype(_U)
        self.range = np.full(len(parts), 2 ** 64 - 1, _U)
        self.used = np.full(len(parts), 2)
        self.last = size - 1

    def peek(self, lanes: slice) -> np.ndarray:
        self.step = self.range[lanes] >> _U(TOTAL_BITS)
        return np.minimum(self.code[lanes] // self.step, _U((1 << TOTAL_BITS) - 1)).astype(np.int64)

    def take(self, lanes: slice, start: np.ndarray, size: np.ndarray) -> None:
        code = self.code[lanes] - self.step * start.astype(_U)
        span = self.step * size.astype(_U)
        short = np.flatnonzero(span < _U(1 << 32))
        if len(short):
            code[short] = (code[short] << _U(32)) | self.words[short, np.minimum(self.used[short], self.last)].astype(_U)
            span[short] <<= _U(32)
            self.used[short] += 1
        self.code[lanes], self.range[lanes] = code, span


def _prior(vocab: int) -> np.ndarray:
    """Bounds of a fixed Zipf-like distribution over ids, in integers."""
    weight = np.int64(1 << 40) // (np.arange(vocab, dtype=np.int64) + 256)
    share = weight // (int(weight.sum()) // ((1 << TOTAL_BITS) - vocab) + 1) + 1
    return np.concatenate(([0], np.cumsum(share)))


class _Mixer:
    """The three models of blocks side by side; ``active`` blocks, the first ones, take part in a step."""

    def __init__(self, lanes: int, width: int):
        self.width = width
        self.lane = np.arange(lanes)
        self.row = self.lane * (width + 1)
        self.row2 = self.lane << _HASH_BITS
        self.state_row = self.lane * (2 * (_SURE + 1) ** 2)
        self.after1 = np.zeros(lanes * (width + 1), np.int32)   # place << 2 | how sure
        self.after2 = np.zeros(lanes << _HASH_BITS, np.int32)
        start = np.array([[0.15, 0.45, 0.65, 0.8][k2] for k2 in range(_SURE + 1) for _ in range(8)])
        self.right2 = np.tile((start * 65536).astype(np.int64), lanes)
        start = np.array([[0.08, 0.3, 0.4, 0.5][k1] for _ in range(4) for k1 in range(4) for _ in range(2)])
        self.right1 = np.tile((start * 65536).astype(np.int64), lanes)
        self.counts = np.zeros((lanes, width + 1), np.int32)
        self.flat = self.counts.reshape(-1)
        self.known = np.zeros(lanes, np.int64)                  # size of the dictionary so far
        self.before = np.zeros(lanes, np.int64)
        self.before2 = np.zeros(lanes, np.int64)
        self.steps = 0

    def renew(self, active: int, bounds: bool) -> None:
        """Order-0 frequencies from the counts so far (``bounds``: also in a form to search in)."""
        known = self.known[:active]
        most = min(self.width, int(known.max(initial=0)) + _EVERY) + 1
        self.cum_width = most
        self.cum = np.zeros((active, most + 1), np.int64)
        np.cumsum(self.counts[:active, :most], axis=1, out=self.cum[:, 1:])
        self.each = _Z // (self.steps + known + _EVERY + 64)    # frequency of a count
        self.cum *= self.each[:, None]
        self.base = self.each >> 2                              # and of a known place
        self.cum += np.arange(most + 1) * self.base[:, None]
        self.cum_row = np.arange(active) * (most + 1)
        self.cum_flat = self.cum.reshape(-1)
        if bounds:
            self.bounds = (np.minimum(self.cum, _Z) + (np.arange(active) << 25)[:, None]).reshape(-1)

    def predict(self, active: int) -> None:
        before = self.before[:active]
        self.at1 = self.row[:active] + before
        self.at2 = self.row2[:active] + (((before * 40503 + self.before2[:active] * 30011) >> 2) & ((1 << _HASH_BITS) - 1))
        self.found1, self.found2 = self.after1[self.at1], self.after2[self.at2]
        self.place1, self.place2 = self.found1 >> 2, self.found2 >> 2
        same = self.place1 == self.place2
        state = (((self.found2 & 3) << 3) | ((self.found1 & 3) << 1) | same) + self.state_row[:active]
        self.state, self.apart = state, ~same
        self.rate2, self.rate1 = self.right2[state], self.right1[state]
        self.share2 = (self.rate2 * (SHARES - 2)) >> 16
        self.share1 = ((self.rate1 * (SHARES - 2 - self.share2)) >> 16) * self.apart
        self.share0 = SHARES - self.share1 - self.share2

    def interval(self, active: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of each block's place in the mixture."""
        at = self.cum_row[:active] + place
        start = self.cum_flat[at]
        size = np.where(place == self.known[:active], _Z, self.cum_flat[at + 1]) - start
        self.hit1, self.hit2 = self.place1 == place, self.place2 == place
        start = self.share0 * start + _Z * (self.share1 * (self.place1 < place) + self.share2 * (self.place2 < place))
        return start, self.share0 * size + _Z * (self.share1 * self.hit1 + self.share2 * self.hit2)

    def search(self, active: int, value: np.ndarray) -> np.ndarray:
        """The place whose interval holds a value."""
        known, row = self.known[:active], self.cum_row[:active]
        swap = self.place1 < self.place2
        first, second = np.where(swap, self.place1, self.place2), np.where(swap, self.place2, self.place1)
        share_first = np.where(swap, self.share1, self.share2) * _Z
        share_second = np.where(swap, self.share2, self.share1) * _Z

        def edges(place):
            start = self.cum_flat[row + place]
            return start * self.share0, np.where(place == known, _Z, self.cum_flat[row + place + 1]) * self.share0

        lo, hi = edges(first)
        is_first = (value >= lo) & (value < hi + share_first)
        value = np.where(value >= hi + share_first, value - share_first, value)
        lo, hi = edges(second)
        is_second = (value >= lo) & (value < hi + share_second)
        value = np.where(value >= hi + share_second, value - share_second, value)
        key = np.minimum(value // self.share0, _Z - 1) + (np.arange(active) << 25)
        place = np.searchsorted(self.bounds, key, side="right") - 1 - row
        place = np.minimum(place, known)
        return np.where(is_first, first, np.where(is_second, second, place))

    def learn(self, active: int, place: np.ndarray) -> None:
        for at, found, hit, table in ((self.at1, self.found1, self.hit1, self.after1), (self.at2, self.found2, self.hit2, self.after2)):
            table[at] = (place << 2) + hit * _SURER[found & 3]
        state = self.state
        self.right2[state] = self.rate2 + (((self.hit2.astype(np.int64) << 16) - self.rate2) >> _RATE)
        # order 1 is judged where it differs from order 2 and that is wrong
        self.right1[state] = np.where(self.apart & ~self.hit2, self.rate1 + (((self.hit1.astype(np.int64) << 16) - self.rate1) >> _RATE), self.rate1)
        self.flat[self.row[:active] + place] += 1
        known = self.known[:active]
        known += place == known
        self.before2[:active] = self.before[:active]
        self.before[:active] = place
        self.steps += 1


def _places(blocks: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Each block's dictionary in order of first appearance, and its ids as places in it."""
    n = np.array([len(b) for b in blocks])
    block = np.repeat(np.arange(len(blocks)), n)
    ids = np.concatenate(blocks).astype(np.int64)
    keys, first, which = np.unique((block << 32) | ids, return_index=True, return_inverse=True)
    order = np.argsort(first)                      # within a block: by first appearance
    size = np.bincount(keys >> 32, minlength=len(blocks))
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys)) - np.repeat(np.cumsum(size) - size, size)
    return np.split(ids[first[order]], np.cumsum(size)[:-1]), np.split(place[which], np.cumsum(n)[:-1])


def _active(lengths: np.ndarray, step: int) -> int:
    """How many of the descending lengths are above ``step``."""
    return int(np.searchsorted(-lengths, -step, side="left"))


def encode(blocks: list[np.ndarray], vocab: int) -> list[tuple[int, bytes, bytes]]:
    """(dictionary size, coded dictionary, coded places) of each block of ids below ``vocab``; blocks are not empty."""
    prior = _prior(vocab)
    words, places = _places(blocks)
    dictionaries: list[bytes] = [b""] * len(blocks)
    bodies: list[bytes] = [b""] * len(blocks)

    def table(order: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(rows[i]) for i in order])
        out = np.zeros((int(lengths[0]), len(order)), np.int64)
        for lane, i in enumerate(order):
            out[:lengths[lane], lane] = rows[i]
        return out, lengths

    order = np.argsort([-len(w) for w in words], kind="stable")
    steps, lengths = table(order, words)
    coder = _Writer(len(order), len(steps))
    for t, ids in enumerate(steps):
        n = _active(lengths, t)
        start = prior[ids[:n]]
        coder.put(slice(0, n), start, prior[ids[:n] + 1] - start)
    for i, data in zip(order, coder.finish()):
        dictionaries[i] = data

    width = int(lengths[0])
    order = np.argsort([-len(p) for p in places], kind="stable")
    steps, lengths = table(order, places)
    coder, mixer = _Writer(len(order), len(steps)), _Mixer(len(order), width)
    for t, now in enumerate(steps):
        n = _active(lengths, t)
        now = now[:n]
        if t % _EVERY == 0:
            mixer.renew(n, bounds=False)
        mixer.predict(n)
        coder.put(slice(0, n), *mixer.interval(n, now))
        mixer.learn(n, now)
    for i, data in zip(order, coder.finish()):
        bodies[i] = data
    return [(len(w), d, b) for w, d, b in zip(words, dictionaries, bodies)]


def decode(coded: list[tuple[int, int, bytes, bytes]], vocab: int) -> list[np.ndarray]:
    """The ids of blocks given as (number of ids, dictionary size, coded dictionary, coded places)."""
    prior = _prior(vocab)
    lanes = len(coded)
    size = np.array([c[1] for c in coded])
    width = int(size.max())
    words = np.zeros((lanes, width), np.int64)
    order = np.argsort(-size, kind="stable")
    lengths = size[order]
    coder = _Reader([coded[i][2] for i in order])
    for t in range(width):
        n = _active(lengths, t)
        lane = slice(0, n)
        ids = np.searchsorted(prior, coder.peek(lane), side="right") - 1
        ids = np.minimum(ids, vocab - 1)
        coder.take(lane, prior[ids], prior[ids + 1] - prior[ids])
        words[order[:n], t] = ids

    total = np.array([c[0] for c in coded])
    order = np.argsort(-total, kind="stable")
    lengths = total[order]
    coder, mixer = _Reader([coded[i][3] for i in order]), _Mixer(lanes, width)
    places = np.zeros((int(lengths[0]), lanes), np.int64)
    for t in range(len(places)):
        n = _active(lengths, t)
        lane = slice(0, n)
        if t % _EVERY == 0:
            mixer.renew(n, bounds=True)
        mixer.predict(n)
        now = mixer.search(n, coder.peek(lane))
        coder.take(lane, *mixer.interval(n, now))
        mixer.learn(n, now)
        places[t, :n] = now
    out: list[np.ndarray] = [None] * lanes
    for lane, i in enumerate(order):
        out[i] = words[i][places[:total[i], lane]]
    return out
