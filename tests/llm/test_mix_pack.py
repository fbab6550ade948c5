"""Source mixing and sequence packing."""

import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from careops.llm import mixing, packing
from careops.llm.queries import tokenizer_path

from .conftest import frame, long_text, odd_rows


def water_fill(sizes, weights=(5, 2, 1), most=3):
    """Targets by repeated sharing of the excess: {source: size} -> {source: target}."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = {}, Fraction(sum(sizes.values())), set(order)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if most * sizes[s] <= unit * weight[s]}
        if not full:
            return target | {s: float(unit * weight[s]) for s in open_}
        for s in full:
            target[s] = float(most * sizes[s])
            left -= most * sizes[s]
        open_ -= full
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 1, None: 50}, {"a": 0, "b": 7}, {"a": 0}, {None: 3},
    {chr(97 + i): (i * 37) % 11 for i in range(9)}])
def test_targets_match_water_filling(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(water_fill(sizes))
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


@pytest.mark.parametrize("bucket_rows", [10_000, 50])
def test_mix_comes_near_its_targets(spark, bucket_rows):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(1, 40), None, rng.choice("aaaabc"), 0) for i in range(2000)]
    got = mixing.mix(frame(spark, rows), bucket_rows=bucket_rows).collect()
    again = mixing.mix(frame(spark, rows[::-1]), bucket_rows=bucket_rows).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    taken, target = defaultdict(int), {}
    for r in got:
        assert 0 <= r.copies <= 3
        taken[r.source] += r["size"] * r.copies
        target[r.source] = r.target
    for s in target:
        assert taken[s] == pytest.approx(target[s], rel=0.1)


def test_each_source_emits_its_expected_number(spark):
    rows = [(i, "one two", None, "ab"[i % 10 == 0], 0) for i in range(1000)]
    got = mixing.mix(frame(spark, rows), bucket_rows=100).collect()
    for s in "ab":
        own = [r for r in got if r.source == s]
        rate = own[0].target / own[0].source_size
        assert abs(sum(r.copies for r in own) - rate * len(own)) <= 1
        assert {r.copies for r in own} <= {int(rate), int(rate) + 1}


def test_mix_of_odd_rows(spark):
    got = mixing.mix(frame(spark, odd_rows()))
    assert got.count() == len(odd_rows())
    sizes = defaultdict(int)
    for _, text, _, source, _ in odd_rows():
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    assert {r.source: r.source_size for r in got.collect()} == sizes
    assert mixing.mix(frame(spark, [])).count() == 0
    nothing = mixing.mix(frame(spark, [(1, None, None, None, None), (2, " ", None, "x", None)])).collect()
    assert [(r.target, r.copies) for r in nothing] == [(0.0, 0), (0.0, 0)]


def test_mix_runs_no_python(spark):
    rows = [(i, "one two", None, "ab"[i % 2], 0) for i in range(10)]
    plan = mixing.mix(frame(spark, rows))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "CartesianProduct" not in plan


# ------------------------------------------------------------------- packing

def ids_of(text):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path())
    return np.array((t.encode(text, add_special_tokens=False).ids if text else []) + [1], dtype="<u4")


def check_pieces(rows, pieces, capacity):
    """Every id in one piece, sequences gapless and full or a power of two."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    expected = defaultdict(list)
    for i, text, *_ in rows:
        expected[i].append(ids_of(text))
    assert set(by_doc) == set(expected)
    for i, texts in expected.items():
        if len(texts) == 1:
            own = sorted(by_doc[i], key=lambda p: p.start)
            assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]]
            assert b"".join(p.ids for p in own) == texts[0].tobytes()
        assert sum(p.length for p in by_doc[i]) == sum(map(len, texts))
    for p in pieces:
        assert p.length * 4 == len(p.ids) and p.length > 0 and zlib.crc32(p.ids) == p.ids_crc32
        assert p.doc_tokens in {len(x) for x in expected[p.doc_id]}
    for own in by_seq.values():
        own.sort(key=lambda p: p.offset)
        total = sum(p.length for p in own)
        assert [p.offset for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]]
        assert total <= capacity and (total & (total - 1)) == 0


@pytest.mark.parametrize("capacity,max_open", [(2048, 4096), (64, 4)])
def test_packing_round_trip(spark, capacity, max_open):
    rows = odd_rows() + [(100 + i, long_text(i * 3, seed=i), None, None, 0) for i in range(60)]
    df = frame(spark, rows)
    pieces = packing.pack(df, tokenizer_path(), capacity, max_open=max_open).collect()
    check_pieces(rows, pieces, capacity)
    full = sum(p.length for p in pieces) / capacity
    assert len({p.sequence_id for p in pieces}) <= full + (40 if max_open > 4 else 3000)
    assert packing.pack(frame(spark, []), tokenizer_path()).count() == 0


def test_sum_of_squares_places_where_the_sum_is_least():
    rng = random.Random(4)
    p = packing.Packer(16)
    closed = []
    for i in range(400):
        size = rng.randint(1, 15)
        before = p.counts.copy()
        options = {}
        for h in range(16):
            if h and not before[h] or h + size > 16:
                continue
            n = before.copy()
            if h:
                n[h] -= 1
            if h + size < 16:
                n[h + size] += 1
            options[h] = int((n ** 2).sum())
        closed += list(p.add(i, np.zeros(size, np.uint32)))
        assert int((p.counts ** 2).sum()) == min(options.values())
        assert p.counts.sum() == p.n_open == sum(map(len, p.open))
    closed += list(p.flush())
    assert p.n_open == 0 and len({c[0] for c in closed}) == 400


def test_cached_chunks_encode_like_whole_texts():
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(tokenizer_path())
    encode, rng = packing.Encoder(tokenizer_path()), random.Random(1)
    alphabet = ["a", "B", " ", "  ", "\n", "'s", " '", "1", "%", "é", "\t", "\x1c", "\u00a0", "中", "🙂", "<|endoftext|>", " b",
                " wo", "rd ", "\u2003", "\r\n", "\x85", "ß.", "²", "½x"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(6000)] + [" ", "\n", "a b\nc", long_text(500)]
    for got, text in zip(encode(texts), texts):
        assert got.tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)
