"""Token files: exact round trips, damage, and the query against the tokenizer itself."""

import random
import zlib

import numpy as np
import pytest

from careops.llm import context_coder, queries, token_files

from .conftest import SCHEMA, frame, odd_rows


def blocks(seed, n):
    rng = np.random.default_rng(seed)
    vocab = int(rng.integers(2, 60_000))
    out = []
    for _ in range(n):
        size = int(rng.integers(1, 900))
        ids = rng.integers(0, int(rng.integers(1, vocab + 1)) if rng.random() < 0.5 else min(vocab, 5), size)
        if rng.random() < 0.3:
            ids = ids[np.arange(size) % (1 + size // 7)]
        if rng.random() < 0.2:
            ids[:] = vocab - 1
        out.append(ids)
    return vocab, out


@pytest.mark.parametrize("seed", range(25))
def test_coder_round_trip(seed):
    vocab, given = blocks(seed, 1 + seed % 7)
    coded = context_coder.encode(given, vocab)
    back = context_coder.decode([(len(b), *c) for b, c in zip(given, coded)], vocab)
    assert all((a == b).all() for a, b in zip(given, back))
    # a block is coded by itself
    assert context_coder.encode(given[:1], vocab)[0][2] == coded[0][2]


def test_contexts_pay():
    rng = np.random.default_rng(1)
    free = rng.integers(0, 500, 4096)
    chain = [0, 1]
    follow = rng.integers(0, 500, (500, 2))
    while len(chain) < 4096:
        chain.append(int(follow[chain[-1], int(rng.integers(0, 10) == 0)]))
    sizes = [sum(map(len, c[1:])) for c in context_coder.encode([free, np.array(chain)], 50_000)]
    assert sizes[0] < 4096 * 11 / 8 and sizes[1] < sizes[0] / 3


def test_segment_round_trip_and_damage():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 900, 1000).astype("<u4")
    sizes = np.array([1, 0, 700, 299])
    one = token_files.write_segment([5, None, 2 ** 62, -3], sizes, ids, 1000, 7, 3, block=64)
    none = token_files.write_segment([], sizes[:0], ids[:0], 1000)
    got = list(token_files.read_segments(one + b"\n" + none + b"\n"))
    assert got[0][:3] == (7, 3, [5, None, 2 ** 62, -3]) and (got[0][3] == sizes).all() and (got[0][4] == ids).all()
    assert len(got) == 2 and len(got[1][4]) == 0
    for at in rng.integers(0, len(one), 60).tolist():
        bad = bytearray(one)
        bad[at] ^= 16
        with pytest.raises(token_files.SegmentError):
            list(token_files.read_segments(bytes(bad)))
    with pytest.raises(token_files.SegmentError):
        list(token_files.read_segments(one[:-2]))


def test_word_encoder_equals_the_tokenizer():
    encode = token_files.WordEncoder(queries.tokenizer_path(queries.WORD_TOKENIZER))
    assert encode.by_word
    rng = random.Random(4)
    parts = ["a", "Don't", "é", "é", "́", "İ", "Σ", "中文", "🙂", "12", "'s", "..", "<|endoftext|>", "<|", "\xa0", " ",
             "\x1c", "\x85", "가", "가", "\x00", "ß", " ", " ", "\n", "\t", "\x0b", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(500)]
    for _ in range(2):
        ids, sizes = encode(texts)
        for text, got in zip(texts, np.split(ids, np.cumsum(sizes)[:-1])):
            assert got.tolist() == [*encode.tokenizer.encode(text, add_special_tokens=False).ids, 1]
    other = token_files.WordEncoder(queries.tokenizer_path())
    ids, sizes = other(texts[:50])
    assert not other.by_word and sizes[0] == len(other.tokenizer.encode(texts[0], add_special_tokens=False).ids) + 1


def expected(rows, tokenizer):
    start, out = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_matches_the_tokenizer(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["of", "the", "Hospital", "x1", "é."]) for _ in range(rng.randint(0, 300))), None, None, 0)
            for i in rng.sample(range(-500, 5000), 300)]
    rows += [(7000, None, None, None, None), (7001, "", None, None, 0), (7002, odd_rows()[5][1], None, None, 0), (None, "no id", None, None, 0)]
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_token_files(spark, str(tmp_path)).collect()
    tokenizer = token_files.word_encoder(queries.tokenizer_path(queries.WORD_TOKENIZER)).tokenizer
    want = expected([r[:2] for r in rows], tokenizer)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_files_hold_the_ids(spark, tmp_path):
    rows = odd_rows()
    path = f"{tmp_path}/out"
    token_files.write_tokens(frame(spark, rows), path, queries.tokenizer_path(), block=512, segment_chars=50, file_segments=1)
    got = token_files.read_tokens(spark, path).collect()
    tokenizer = token_files.word_encoder(queries.tokenizer_path()).tokenizer
    want = {(r[0], tuple(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + (1,)) for r in rows}
    assert {(r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got} == want and len(got) == len(rows)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == [0, *np.cumsum([r.n_tokens for r in ordered])[:-1].tolist()]
    ids = [r.doc_id for r in ordered]
    assert ids == sorted(ids, key=lambda d: (d is None, d or 0))
    token_files.write_tokens(spark.createDataFrame([], SCHEMA), f"{tmp_path}/none", queries.tokenizer_path())
    assert token_files.read_tokens(spark, f"{tmp_path}/none").count() == 0
