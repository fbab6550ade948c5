"""Collocations and counting quotient filters against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from careops.llm import collocations, quotient_filter as qf

from .conftest import SCHEMA, frame, odd_rows, values

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("bits", [16, 17, 21, 32])
@pytest.mark.parametrize("n", [2, 3, 5])
def test_filters_are_lossless(bits, n):
    rng = np.random.default_rng(bits * n)
    for size, values_ in ((1, 9), (7, 2), (4000, 2 ** bits), (4000, 5)):
        lanes = [rng.integers(0, values_, size).astype(np.uint64) for _ in range(n)]
        spread = qf.permute(lanes, bits)
        assert all((a == b).all() for a, b in zip(qf.unpermute(spread, bits), lanes))
        limbs = qf.pack(spread, bits)
        assert all((a == b).all() for a, b in zip(qf.unpack(limbs, n, bits), spread))
        found, counts, place = qf.distinct(limbs)
        assert Counter(zip(*(x.tolist() for x in limbs))) == Counter(dict(zip(zip(*(x.tolist() for x in found)), counts.tolist())))
        assert all((a[place] == b).all() for a, b in zip(found, limbs))
        counts = counts * rng.integers(1, 10 ** 11, len(counts))
        for skip in (0, 3):
            lead = found[0] >> np.uint64(min(64, n * bits) - skip) if skip else np.zeros(len(counts), np.uint64)
            for value in np.unique(lead):
                here = lead == value
                part = [x[here] for x in found]
                back, sums = qf.from_bytes(qf.to_bytes(part, counts[here], n * bits, skip))
                assert all((a == b).all() for a, b in zip(back, part)) and (sums == counts[here]).all()
        both, sums, _ = qf.merge([(found, counts), (found, counts)])
        assert all((a == b).all() for a, b in zip(both, found)) and (sums == 2 * counts).all()


def brute(rows, max_words, least, top, cover):
    counts, totals = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, max_words + 1):
                counts.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    out = []
    candidates = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= least}
    for (lang, g), a in candidates.items():
        if any(other == lang and len(h) > len(g) and 100 * b >= cover * a
               and any(h[i:i + len(g)] == g for i in range(len(h) - len(g) + 1)) for (other, h), b in candidates.items()):
            continue
        n = totals[lang]
        score, _, left, right = min((1000 * a * n // (counts[lang, g[:k]] * counts[lang, g[k:]]), k, counts[lang, g[:k]],
                                     counts[lang, g[k:]]) for k in range(1, len(g)))
        out.append((lang, " ".join(g), a, left, right, n, score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    rank = Counter()
    final = []
    for lang, *rest in out:
        rank[lang] += 1
        if rank[lang] <= top:
            final.append((lang, rank[lang], *rest))
    return final


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def texts(seed, n=120):
    rng = random.Random(seed)
    stock = ["of the", "New York City", "new york", "a b c d e f", "à la carte", "of", "Of", "x", "the", "中文 字"]
    rows = []
    for i in range(n):
        words = [rng.choice(stock + [f"w{rng.randrange(60)}"]) for _ in range(rng.randint(0, 60))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "! ", "\x0b"]) for w in words)
        rows.append((i, text, rng.choice(["en", "en", "en", "fr", None, "und"]), "s", 0))
    return rows


@pytest.mark.parametrize("settings", [
    {"least": 5, "top": 2000, "cover_percent": 100}, {"least": 5, "top": 7, "cover_percent": 60},
    {"least": 9, "top": 2000, "cover_percent": 100, "max_words": 3, "batch_chars": 500, "bucket_phrases": 40}])
def test_collocations_match_brute_force(spark, settings):
    rows = texts(settings["least"])
    rows += [r for r in odd_rows() if r[0] != 4] * 3
    got = collocations.collocations(frame(spark, rows), **settings)
    want = brute(rows, settings.get("max_words", 5), settings["least"], settings["top"], settings["cover_percent"])
    assert want and values(got, *COLUMNS) == sorted(want)


def test_products_beyond_64_bits(spark):
    big = 2 ** 40
    row = spark.createDataFrame([(big, big - 1, 2 ** 42, 2 ** 53 + 1)], "a long, l long, r long, n long")
    whole = row.selectExpr(*(f"CAST({c} AS DECIMAL(19,0)) AS _{c}" for c in "alrn"))
    got = whole.selectExpr("(CAST(1000 AS DECIMAL(4,0)) * (_a * _n)) div (_l * _r) AS s").first().s
    assert got == 1000 * big * (2 ** 53 + 1) // ((big - 1) * 2 ** 42)


def test_odd_tables(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    none = spark.createDataFrame([(1, None, None, None, None), (2, " ., ", "en", None, 0)], SCHEMA)
    assert collocations.collocations(none, least=1).collect() == []
    one = spark.createDataFrame([(1, "a b. a b", "en", None, 0)], SCHEMA)
    assert [r.phrase for r in collocations.collocations(one, least=2).collect()] == ["a b"]
