"""Counting quotient filters of n-grams, without loss.

An n-gram is n word ids of ``bits`` bits.  An invertible permutation of the
packed value spreads it evenly, so its leading bits (the quotient) give the
home slot in a table and the other bits (the remainder) are stored in full:
the value can be read back, and counts are exact.  Entries with one quotient
form a run, sorted by remainder, that starts at the home slot or behind the
run before it.  Three bits tell the structure: a quotient is in use, a slot
ends a run, a slot holds a digit of the count of the entry in front of it.
Filters are built from and read as sorted arrays, so shards merge in order.
"""

from __future__ import annotations

import struct

import numpy as np

from careops.llm.common import mix64

PASSES = 2
MIN_BITS = 16   # of a word id, so that quotient and counter digits always have room
DIGIT_BITS = 8  # least width of a slot
_HEAD = struct.Struct("<HBBQQ")


def _mask(bits: int) -> np.uint64:
    return np.uint64(2 ** bits - 1)


def _stir(lane: np.ndarray, turn: int, bits: int) -> np.ndarray:
    return mix64(lane + np.uint64(turn + 1)) & _mask(bits)


def permute(lanes: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """A permutation of all tuples (two or more) of ``bits``-bit values: each lane in turn is xored with a hash of the one before."""
    out, n = [x.astype(np.uint64) for x in lanes], len(lanes)
    for turn in range(PASSES * n):
        j = (turn + 1) % n
        out[j] = out[j] ^ _stir(out[j - 1], turn, bits)
    return out


def unpermute(lanes: list[np.ndarray], bits: int) -> list[np.ndarray]:
    out, n = list(lanes), len(lanes)
    for turn in reversed(range(PASSES * n)):
        j = (turn + 1) % n
        out[j] = out[j] ^ _stir(out[j - 1], turn, bits)
    return out


def _overlaps(n: int, bits: int):
    """(lane, limb, bits to drop, width, bits below it in the limb) of each part of a lane that lies in one 64-bit limb."""
    width = n * bits
    for j in range(n):
        for i in range(-(-width // 64)):
            end = min(64 * (i + 1), width)
            lo, hi = max(j * bits, 64 * i), min((j + 1) * bits, end)
            if lo < hi:
                yield j, i, np.uint64((j + 1) * bits - hi), hi - lo, np.uint64(end - hi)


def pack(lanes: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """The lanes side by side as 64-bit limbs, the leading one first (the last one may be shorter)."""
    limbs = [np.zeros(len(lanes[0]), np.uint64) for _ in range(-(-len(lanes) * bits // 64))]
    for j, i, drop, width, below in _overlaps(len(lanes), bits):
        limbs[i] |= ((lanes[j] >> drop) & _mask(width)) << below
    return limbs


def unpack(limbs: list[np.ndarray], n: int, bits: int) -> list[np.ndarray]:
    lanes = [np.zeros(len(limbs[0]), np.uint64) for _ in range(n)]
    for j, i, drop, width, below in _overlaps(n, bits):
        lanes[j] |= ((limbs[i] >> below) & _mask(width)) << drop
    return lanes


def distinct(limbs: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Sorted distinct values, their summed counts, and each input value's place among them."""
    n = len(limbs[0])
    order = np.argsort(limbs[0], kind="stable") if len(limbs) == 1 else np.lexsort(limbs[::-1])
    ordered = [x[order] for x in limbs]
    new = np.zeros(n, bool)
    new[:1] = True
    for x in ordered:
        new[1:] |= x[1:] != x[:-1]
    firsts = np.flatnonzero(new)
    place = np.empty(n, np.int64)
    place[order] = np.cumsum(new) - 1
    if counts is None:
        sums = np.diff(np.append(firsts, n))
    else:
        sums = np.add.reduceat(counts[order], firsts) if n else counts
    return [x[firsts] for x in ordered], sums.astype(np.int64), place


def merge(parts: list[tuple[list[np.ndarray], np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Merge sorted filters' entries, adding counts; also the place of each part's entries in the result."""
    limbs = [np.concatenate(x) for x in zip(*(p[0] for p in parts))]
    return distinct(limbs, np.concatenate([p[1] for p in parts]))


def _pack_bits(values: np.ndarray, width: int) -> bytes:
    rows = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(rows[:, 64 - width:]).tobytes()


def _unpack_bits(data: bytes, n: int, width: int) -> np.ndarray:
    rows = np.zeros((n, 64), np.uint8)
    rows[:, 64 - width:] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width).reshape(n, width)
    return np.packbits(rows, axis=1).view(">u8").ravel().astype(np.uint64)


def to_bytes(limbs: list[np.ndarray], counts: np.ndarray, width: int, skip: int = 0) -> bytes:
    """The filter of sorted distinct values of ``width`` bits, all with the same ``skip`` leading bits, and their counts."""
    n, lead = len(counts), min(64, width)
    q = max(1, min(int(n).bit_length(), lead - skip - DIGIT_BITS))
    slot_bits = lead - skip - q
    quotient = ((limbs[0] >> np.uint64(slot_bits)) & _mask(q)).astype(np.int64)
    digits, rest = np.zeros(n, np.int64), (counts - 1).astype(np.uint64)
    while rest.any():
        digits += rest > 0
        rest >>= np.uint64(slot_bits)
    at = np.cumsum(digits + 1) - digits - 1          # with no slot left empty
    heads = np.flatnonzero(np.diff(quotient, prepend=-1))
    shift = np.maximum.accumulate(quotient[heads] - at[heads])
    at = at + np.repeat(shift, np.diff(np.append(heads, n)))
    slots = int(at[-1] + digits[-1] + 1)
    values, ends, counters = np.zeros(slots, np.uint64), np.zeros(slots, np.uint8), np.zeros(slots, np.uint8)
    values[at] = limbs[0] & _mask(slot_bits)
    rest, more, turn = (counts - 1).astype(np.uint64), np.flatnonzero(digits), 1
    while len(more):
        values[at[more] + turn] = rest[more] & _mask(slot_bits)
        counters[at[more] + turn] = 1
        rest[more] >>= np.uint64(slot_bits)
        more, turn = more[rest[more] > 0], turn + 1
    last = np.append(heads[1:], n) - 1
    ends[at[last] + digits[last]] = 1
    used = np.zeros(2 ** q, np.uint8)
    used[quotient[heads]] = 1
    prefix = int(limbs[0][0]) >> (lead - skip) if skip else 0
    parts = [_HEAD.pack(width, skip, q, slots, prefix), np.packbits(used).tobytes(), np.packbits(ends).tobytes(),
             np.packbits(counters).tobytes(), _pack_bits(values, slot_bits)]
    for i, x in enumerate(limbs[1:], 1):
        parts.append(_pack_bits(x, min(64, width - 64 * i)))
    return b"".join(parts)


def from_bytes(data: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    """The sorted values (as limbs) and counts of a filter."""
    width, skip, q, slots, prefix = _HEAD.unpack_from(data)
    lead, pos = min(64, width), _HEAD.size

    def take(bits: int) -> bytes:
        nonlocal pos
        pos += -(-bits // 8)
        return data[pos - (-(-bits // 8)):pos]

    def flags(n: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(take(n), np.uint8), count=n).astype(bool)

    used, ends, counters = np.flatnonzero(flags(2 ** q)), np.flatnonzero(flags(slots)), flags(slots)
    slot_bits = lead - skip - q
    values = _unpack_bits(take(slots * slot_bits), slots, slot_bits)
    starts = np.maximum(used, np.append(0, ends[:-1] + 1))
    inside = np.cumsum(np.bincount(starts, minlength=slots + 1) - np.bincount(ends + 1, minlength=slots + 1))[:slots] > 0
    at = np.flatnonzero(inside & ~counters)
    quotient = used[np.searchsorted(ends, at)].astype(np.uint64)
    first = (np.uint64(prefix) << np.uint64(lead - skip)) if skip else np.uint64(0)
    limbs = [first | (quotient << np.uint64(slot_bits)) | values[at]]
    digit = np.flatnonzero(counters)
    owner = np.searchsorted(at, digit) - 1
    counts = np.ones(len(at), np.uint64)
    np.add.at(counts, owner, values[digit] << ((digit - at[owner] - 1) * slot_bits).astype(np.uint64))
    for i in range(1, -(-width // 64)):
        size = min(64, width - 64 * i)
        limbs.append(_unpack_bits(take(len(at) * size), len(at), size))
    return limbs, counts.astype(np.int64)
