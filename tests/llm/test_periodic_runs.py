"""Periodic runs against brute force over all periods, and their edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from melodex.llm import periodic_runs


def brute_runs(w, least=12):
    """(start, length, period) of all runs: every period at every place."""
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            s = i
            while i < n - q and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, 2 * q):
                out.setdefault((s, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def some_words(rng):
    n, a = rng.randrange(0, 160), rng.choice([1, 2, 3, 6, 30])
    w = [f"w{rng.randrange(a)}" for _ in range(n)]
    for _ in range(rng.randrange(0, 4) if n else 0):
        s = rng.randrange(n)
        q, e = rng.randrange(1, max(2, (n - s) // 2 + 1)), s + rng.randrange(0, n - s)
        for i in range(s + q, e):
            w[i] = w[i - q]
    return w


def test_transforms_are_exact():
    rng = np.random.default_rng(5)
    for prime, generator in periodic_runs.PRIMES:
        a = rng.integers(0, prime, (64, 3)).astype(np.uint64)
        assert (periodic_runs.restored(periodic_runs.transform(a, prime, generator), prime, generator) == a).all()
        assert pow(generator, (prime - 1) // 2, prime) == prime - 1
    for most in (3, 1 << 20, 1 << 28):  # the largest needs three primes
        x, y = rng.integers(0, most, (8, 5)), rng.integers(0, most, (23, 5))
        y[4:12, 2], y[15:23, 4] = x[:, 2], x[:, 4]
        want = [[(x[:, c] == y[k : k + 8, c]).all() for c in range(5)] for k in range(16)]
        assert (periodic_runs.zero_mismatches(x, y, 16) == np.array(want)).all()
    with pytest.raises(OverflowError):
        periodic_runs.zero_mismatches(np.full((2, 1), 1 << 60), np.zeros((3, 1), dtype=np.int64), 2)


def test_runs_of_many_texts():
    """Texts side by side: none of them changes another's runs."""
    rng = random.Random(11)
    for _ in range(60):
        texts = [some_words(rng) for _ in range(rng.randrange(1, 25))]
        ends = np.cumsum([len(t) for t in texts])
        s, e, q = periodic_runs.find_runs(np.array([int(x[1:]) for t in texts for x in t], dtype=np.int64), ends)
        got = [[] for _ in texts]
        for a, b, c, t in zip(s, e, q, np.searchsorted(ends, s, side="right")):
            got[t].append((int(a - ends[t] + len(texts[t])), int(b - a), int(c)))
        assert [sorted(g) for g in got] == [brute_runs(t) for t in texts]


def planted(i, text):
    w = text.encode().split() if text else []
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k if k < a else a + (k - a) % p] for k in range(n)]
    return w


def brute_digests(i, text):
    w = planted(i, text)
    runs = brute_runs(w)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = min(((-m, s, q) for s, m, q in runs), default=None)
    told = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (i, len(runs), *told, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())


def test_digests(spark):
    """Nulls, blanks, white space that isn't ASCII, repeats, all-equal and very long texts, clashing columns, no rows."""
    rng = random.Random(4)
    odd = [(None, "a " * 30), (7, None), (8, ""), (9, " \n\t\v\f\r "), (3, "x y " * 20), (3, "x y " * 20), (12, "\x1fz\x00 " * 13), (13, "ü"), (14, "a " * 11), (15, "a " * 12), (16, "a b " * 12 + "c a b a c " * 30)]
    rows = odd + [(k, "  ".join(some_words(rng))) for k in range(300)]
    df = spark.createDataFrame([(i, t, 1, 2, "r") for i, t in rows], "doc_id long, text string, start int, n int, runs string")
    found = lambda d: periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.planted(d)))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, found(df.repartition(3)).collect()), key=key) == sorted((brute_digests(*r) for r in rows), key=key)
    assert found(df.limit(0)).collect() == []
    long = spark.createDataFrame([(1, "w " * 300_000), (2, " ".join(f"a{k % 1000} b{k}" if k < 60_000 else f"c{k % 7000}" for k in range(150_000)))], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic_runs.periodic_runs(long).collect()}
    assert got[1].runs == [(0, 300_000, 1)] and got[1].collapsed == "w"
    assert got[2].runs == [(120_000, 90_000, 7000)] and got[2].n_words == 210_000 and len(got[2].collapsed.split()) == 127_000


def test_least(spark):
    with pytest.raises(ValueError):
        periodic_runs.find_runs(np.zeros(20, dtype=np.int64), np.array([20]), 6)
    with_more = spark.createDataFrame([(1, "a b " * 8 + "c " * 14)], "doc_id long, text string")
    assert [tuple(x) for x in periodic_runs.periodic_runs(with_more, 15).first().runs] == [(0, 16, 2)]
