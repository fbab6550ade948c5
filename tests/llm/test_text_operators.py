"""Quality rules, SimHash near-dedup, substring dedup: against brute force, and on odd rows."""

import collections
import hashlib
import random
import re

import pytest
import xxhash

from careops.llm import quality, simhash, substring
from careops.llm.components import components

from .conftest import frame, long_text, odd_rows, values

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall(text or "")


def made_documents(n=120, seed=3):
    """Texts with copies, near copies and shared passages."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    out = []
    for i in range(n):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([0, 2, 12, 13, 40, 300]))]
        if i % 5 == 0:
            at = rng.randint(0, len(text))
            text[at:at] = passage[rng.randint(0, 20):]
        if i % 7 == 3 and out:
            text = words(rng.choice(out)[1])
            if text and i % 2:
                text[rng.randrange(len(text))] = "changed"
        out.append((rng.randrange(10_000) * n + i, rng.choice([" ", "\n", "  "]).join(text), "en", "a", 0))
    return out


# ------------------------------------------------------------------- quality

def base(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    where = collections.defaultdict(list)
    for k in range(len(w) - 7):
        where[tuple(w[k:k + 8])].append(k)
    covered = {q for v in where.values() if len(v) > 1 for k in v for q in range(k, k + 8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
            len(covered), failed)


def test_base_counts_match_brute_force(spark):
    texts = [r[1] for r in odd_rows() + made_documents()]
    texts += ["a b c d e f g h a b c d e f g h i", "x\nx\n\n \n \ny\nx", "#*$ %&| <> é*", "a " * 400, "\n".join(["z"] * 50)]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    got = values(quality.cascade(frame(spark, rows), list(quality.RULES)), "doc_id", "n_words", "word_chars", "n_symbols",
                 "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == sorted((i, *base(t)) for i, t in enumerate(texts))


def test_order_does_not_change_the_verdict(spark):
    clean = long_text(400)
    rows = [(1, clean, None, None, 0), (2, clean.upper(), None, None, 0), (3, clean.replace(" ", " $# "), None, None, 0),
            (4, "\n".join(f"line {i % 9} {i % 9} x" for i in range(40)), None, None, 0), (5, "1 2 3 4 5 6 7 8 9 " * 4, None, None, 0)]
    df = frame(spark, rows)
    order = [e.rule for e in quality.order_rules(df)]
    assert sorted(r.__name__ for r in order) == sorted(r.__name__ for r in quality.RULES)
    expected = values(quality.cascade(df, order), "doc_id", "kept")
    assert expected == values(quality.cascade(df, order[::-1]), "doc_id", "kept")
    assert [k for _, k in expected] == [True, False, False, False, False]


def test_rules_that_reject_more_for_less_come_first(spark):
    def slow(t):
        return sum(range(20_000)) < 0

    def often(t):
        return t.n_words % 2 == 0

    rows = [(i, long_text(100 + i, seed=i), None, None, 0) for i in range(40)]
    order = quality.order_rules(frame(spark, rows), (slow, often))
    assert order[0].rule.__name__ == "often" and order[0].rejected == 20


# ------------------------------------------------------------------- simhash

def fingerprint(text, n=3):
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] if len(w) > n else [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(prints, bits):
    """Component minimum by brute force: [(id, fingerprint)] -> {position: smallest id}."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= bits:
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(prints)):
        groups[find(i)].append(i)
    return {i: min((prints[k][0] for k in g if prints[k][0] is not None), default=None) for g in groups.values() for i in g}


@pytest.mark.parametrize("rows", ["odd", "made"])
def test_near_duplicates_match_brute_force(spark, rows):
    rows = odd_rows() if rows == "odd" else made_documents()
    prints = [(r[0], fingerprint(r[1])) for r in rows]
    least = grouped(prints, 3)
    got = values(simhash.near_duplicates(frame(spark, rows)), "doc_id", "fp", "component_id")
    expected = [(d, fp - 2 ** 64 if fp >= 2 ** 63 else fp, least[i]) for i, (d, fp) in enumerate(prints)]
    assert got == sorted(expected, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 5])
def test_links_are_all_pairs_within_the_distance(spark, bits):
    rng = random.Random(bits)
    prints = {0, 2 ** 64 - 1}
    for _ in range(60):
        x = rng.getrandbits(64)
        prints.add(x)
        for _ in range(4):  # chains of small steps
            for b in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << b
            prints.add(x)
    signed = [p - 2 ** 64 if p >= 2 ** 63 else p for p in prints]
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), bits).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2 ** 64 - 1)).count("1") <= bits}


def test_components_of_chains_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1300)] + [(1, 2), (2, 3), (3, 1), (5, 5)]
    random.Random(1).shuffle(links)
    got = dict(values(components(spark.createDataFrame(links, "a long, b long"), "a", "b"), "node", "root"))
    assert got == {**{i: 100 for i in range(101, 161)}, **{i: 7 for i in range(1000, 1300)}, 2: 1, 3: 1}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# ----------------------------------------------------------------- substring

def kept_words(rows, window):
    first = {}
    for i, text, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = words(text)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k:k + window]), i)
    out = []
    for i, text, *_ in rows:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            f = first[tuple(w[k:k + window])]
            if f is not None and (i is None or f < i):
                gone[k:k + window] = [True] * window
        out.append((i, len(w), sum(gone), tuple(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("window,batch_chars,bucket_windows", [(13, 8_000_000, 4_000_000), (13, 2_000, 100), (3, 5_000, 1)])
@pytest.mark.parametrize("rows", ["odd", "made"])
def test_remove_repeats_matches_brute_force(spark, rows, window, batch_chars, bucket_windows):
    rows = odd_rows() if rows == "odd" else made_documents()
    if rows[0][0] is None:
        batch_chars, bucket_windows = max(batch_chars, 60_000), max(bucket_windows, 5_000)
    df = substring.remove_repeats(frame(spark, rows), window, keep=("lang", "bucket"), batch_chars=batch_chars,
                                  bucket_windows=bucket_windows)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, tuple(words(r.text))) for r in df.collect()),
                 key=lambda r: tuple((x is None, x) for x in r))
    assert got == kept_words(rows, window)


def test_spans_are_maximal_and_white_space_is_kept(spark):
    rows = [(1, "a b c d e f", None, None, 0), (2, "x\ty\na  b c d z\nw", None, None, 0), (3, "q  r", None, None, 0)]
    got = {r.doc_id: r for r in substring.remove_repeats(frame(spark, rows), 3).collect()}
    assert [tuple(s) for s in got[2].spans] == [(2, 6)] and got[2].text == "x\ty z\nw"
    assert got[1].spans == [] and got[3].text == "q  r"


def test_empty_tables(spark):
    none = frame(spark, [])
    assert quality.filter_quality(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert substring.remove_repeats(none).count() == 0


def test_registered_digest(spark):
    from pyspark.sql import functions as F

    from careops.llm.common import SPACE_RE
    line = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), SPACE_RE, " "))
    got = frame(spark, odd_rows()).select("text", F.sha2(line, 256).alias("d")).collect()
    for r in got:
        assert r.d == hashlib.sha256(" ".join(words(r.text)).encode()).hexdigest()
