"""Periodic runs of words by block convolution.

A run is a stretch of consecutive words with smallest period q, of ``max(12, 2 * q)`` words at least, that can't be
extended. Periods are sought in dyadic scales: those of [2^k, 2^(k+1)) with blocks of 2^(k-1) words, so that the words of
any run that have a copy q further on hold a whole block. A block's squared differences with every place of the window
that follows come out of one convolution by number-theoretic transforms, exactly: of so many primes that their product
exceeds any sum. Where the sum is zero the block occurs again, and the distance is a seed: neighbouring blocks of one
distance are a chain, which is extended word by word to both sides. Blocks with two neighbouring words that don't come
again within the scale's distances can't occur there and aren't transformed, so prose costs little.

All of it is on whole texts, many of them side by side in an Arrow function, without a shuffle.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a run has at least; words of texts that are worked on side by side (a longer text is alone), different words
#: that a worker remembers, and numbers in one transform.
LEAST, WORDS, REMEMBERED, CELLS = 12, 1 << 20, 1 << 20, 1 << 20

# Primes with 2^25 dividing one less, and a generator of each one's units.
PRIMES = ((2013265921, 31), (1811939329, 13), (469762049, 3), (167772161, 3))

_roots: dict = {}


def _powers(prime: int, generator: int, half: int, inverse: bool) -> np.ndarray:
    """The first ``half`` powers of a root of unity of order ``2 * half``, as a column."""
    key = prime, half, inverse
    if key not in _roots:
        root = pow(generator, (prime - 1) // (2 * half), prime)
        root = pow(root, -1, prime) if inverse else root
        out = np.ones(half, dtype=np.uint64)
        n = 1
        while n < half:
            out[n : 2 * n] = out[:n] * np.uint64(pow(root, n, prime)) % np.uint64(prime)
            n *= 2
        _roots[key] = out[:, None]
    return _roots[key]


def transform(a: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """The transform of each column of ``a`` (a power of two of rows), its places in bit-reversed order."""
    n, m = a.shape
    p, half = np.uint64(prime), n // 2
    while half:
        a = a.reshape(-1, 2, half, m)
        u, v, out = a[:, 0], a[:, 1], np.empty_like(a)
        s = u + v
        np.minimum(s, s - p, out=out[:, 0])
        np.remainder((u + (p - v)) * _powers(prime, generator, half, False), p, out=out[:, 1])
        a, half = out, half // 2
    return a.reshape(n, m)


def restored(a: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """What ``transform`` was applied to."""
    n, m = a.shape
    p, half = np.uint64(prime), 1
    while half < n:
        a = a.reshape(-1, 2, half, m)
        u, v, out = a[:, 0], a[:, 1] * _powers(prime, generator, half, True) % p, np.empty_like(a)
        s, d = u + v, u + (p - v)
        np.minimum(s, s - p, out=out[:, 0])
        np.minimum(d, d - p, out=out[:, 1])
        a, half = out, 2 * half
    return a.reshape(n, m) * np.uint64(pow(n, -1, prime)) % p


def zero_mismatches(x: np.ndarray, y: np.ndarray, lags: int) -> np.ndarray:
    """For each column: at which of the first ``lags`` places of window ``y`` does block ``x`` occur? (lags, columns) bools.

    Numbers are not negative. The window has ``lags - 1`` more rows than the block, or more.
    """
    b, m = x.shape
    n = 1 << (len(y) - 1).bit_length()
    most = int(max(x.max(initial=0), y.max(initial=0)))
    bound, out = 2 * b * most * most + 1, np.ones((lags, m), dtype=bool)
    squares = np.zeros((len(y) + 1, m), dtype=np.int64)
    np.cumsum(y * y, axis=0, out=squares[1:])
    whole = (x * x).sum(axis=0) + squares[b : b + lags] - squares[:lags]
    back = np.zeros((n, m), dtype=np.uint64)
    back[-np.arange(b) % n] = x  # backwards, so that the product of transforms is a correlation
    window = np.zeros((n, m), dtype=np.uint64)
    window[: len(y)] = y
    exact = 1
    for prime, generator in PRIMES:
        p = np.uint64(prime)
        product = transform(back % p, prime, generator) * transform(window % p, prime, generator) % p
        product = restored(product, prime, generator)[:lags].astype(np.int64)
        out &= (whole - 2 * product) % prime == 0
        exact *= prime
        if exact > bound:
            return out
    raise OverflowError("sums of squared differences exceed the product of all primes")


class _Words(dict):
    """Numbers of words, given out as they come."""

    def __missing__(self, word: bytes) -> int:
        out = self[word] = len(self)
        return out


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How far on each key comes again (a very large number if it doesn't), the order of the keys, and which begin a new one there."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    gap = np.full(len(keys), np.iinfo(np.int64).max)
    same = np.flatnonzero(~new)
    gap[order[same - 1]] = order[same] - order[same - 1]
    return gap, order, new


def _seeds(codes: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """By scale: chains (first word, distance, blocks) of neighbouring blocks that occur again at one distance, and the blocks' length.

    ``codes`` are the numbers of all texts' words, one text after the other; ``ends`` says where each text ends.
    """
    n = np.diff(ends, prepend=0)
    starts, text = ends - n, np.repeat(np.arange(len(n)), n)
    _, order, new = _again(text * np.int64(codes.max(initial=0) + 1) + codes)
    # Words that come again in their text are numbered within it from 1; the others, and what is past its end, are 0.
    many = new.copy()
    many[:-1] &= ~new[1:]
    many[-1:] = False
    rank = np.cumsum(many)
    first = np.concatenate([[0], rank])[np.concatenate([[0], np.cumsum(n)[:-1]])] if len(n) else rank
    ids = np.zeros(len(codes), dtype=np.int64)
    runs = np.cumsum(new) - 1
    recurs = many[np.flatnonzero(new)][runs] if len(new) else many
    ids[order] = np.where(recurs, rank - first[text[order]], 0)
    pairs = np.full(len(codes), -1)
    pairs[:-1] = ids[:-1] * np.int64(ids.max(initial=0) + 1) + ids[1:]
    dull = np.zeros(len(codes), dtype=bool)
    dull[:-1] = (ids[:-1] == 0) | (ids[1:] == 0) | (text[:-1] != text[1:])
    pairs[dull] = -1
    gap = _again(text * np.int64(pairs.max(initial=0) + 2) + pairs + 1)[0]
    gap[dull] = np.iinfo(np.int64).max
    k = 0
    while (1 << k) * 2 <= n.max(initial=0):
        least, most, size = (1, 4, 4) if k == 0 else (1 << k, 2 << k, 1 << (k - 1))
        k = max(2, k + 1)
        blocks = np.maximum(0, (n - least) // size)
        at = np.repeat(starts, blocks) + size * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        for j in range(size - 1):  # drops most blocks at the first pair of words
            at = at[gap[at + j] < most]
            if j >= 8:
                at = at[(gap[at[:, None] + np.arange(j, size - 1)] < most).all(axis=1)] if len(at) else at
                break
        if not len(at):
            continue
        until, lags, long = np.repeat(ends, n)[at], most - least, size + most - least - 1
        found = []
        step = max(1, CELLS // (1 << (long - 1).bit_length()))
        for i in range(0, len(at), step):
            b, e = at[i : i + step], until[i : i + step]
            places = (b + least) + np.arange(long)[:, None]
            window = np.where(places < e, ids[np.minimum(places, len(ids) - 1)], 0)
            q, column = np.nonzero(zero_mismatches(ids[b + np.arange(size)[:, None]], window, lags))
            found.append(np.stack([q + least, b[column]]))
        q, b = np.concatenate(found, axis=1)
        o = np.lexsort((b, q))
        q, b = q[o], b[o]
        head = np.ones(len(q), dtype=bool)
        head[1:] = (q[1:] != q[:-1]) | (b[1:] != b[:-1] + size)
        first_of = np.flatnonzero(head)
        yield b[first_of], q[first_of], np.diff(np.append(first_of, len(q))), size


def find_runs(codes: np.ndarray, ends: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, periods) of all runs of texts whose words' numbers stand one after the other, by start and then period.

    ``ends`` says where each text ends. Repeats of one word are a run of period 1. A run of fewer than ``least`` words or
    of less than two periods isn't one.
    """
    if least < LEAST:
        raise ValueError(f"blocks are laid out for runs of {LEAST} words or more")
    known: dict[tuple[int, int], int] = {}
    far, period = np.arange(len(codes)), np.ones(len(codes), dtype=np.int64)  # of the run that reaches farthest at each word
    for b, q, c, size in _seeds(codes, ends):
        need = np.maximum(least - q, q)
        likely = (c + 2) * size - 2 >= need
        b, q, c = b[likely], q[likely], c[likely] * size
        for b0, d, m in zip(b.tolist(), q.tolist(), c.tolist()):
            if d % period[b0] == 0 and b0 + m + d <= far[b0]:
                continue  # a multiple of a run's period, within it
            t = int(np.searchsorted(ends, b0, side="right"))
            start, end = int(ends[t - 1]) if t else 0, int(ends[t])
            lo, hi = max(start, b0 - size), min(end - d, b0 + m + size)
            before = np.flatnonzero(codes[lo:b0] != codes[lo + d : b0 + d])
            after = np.flatnonzero(codes[b0 + m : hi] != codes[b0 + m + d : hi + d])
            s = lo + (before[-1] + 1 if len(before) else 0)
            e = (b0 + m + after[0] if len(after) else hi) + d
            if e - s >= max(least, 2 * d) and (s, e) not in known:
                known[s, e] = d
                wider = far[s:e] < e
                far[s:e][wider] = e
                period[s:e][wider] = d
    out = np.array(sorted((s, d, e) for (s, e), d in known.items()), dtype=np.int64).reshape(-1, 3)
    return out[:, 0], out[:, 2], out[:, 1]


def _batches(texts: list[str | None]) -> Iterator[list[list[bytes]]]:
    """The words of the texts, in runs of about WORDS words; a longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        words = t.encode().split() if t else []  # bytes: only ASCII white space splits
        if run and size + len(words) > WORDS:
            yield run
            run, size = [], 0
        run.append(words)
        size += len(words)
    if run:
        yield run


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _rows(words: list[list[bytes]], numbers: _Words, least: int) -> tuple[pa.Array, pa.Array]:
    """Each text's runs, and the text without the words that repeat a run's first period."""
    if len(numbers) > REMEMBERED:
        numbers.clear()
    n = np.array([len(w) for w in words], dtype=np.int64)
    ends = np.cumsum(n)
    codes = np.array([x for w in words for x in map(numbers.__getitem__, w)], dtype=np.int64)
    s, e, q = find_runs(codes, ends, least)
    of = np.searchsorted(ends, s, side="right")
    offsets = np.searchsorted(of, np.arange(len(words) + 1), side="left")
    begin = (ends - n)[of]
    flat = pa.StructArray.from_arrays([pa.array(s - begin), pa.array(e - s), pa.array(q)], fields=list(_RUNS.value_type))
    gone = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(gone, s + q, 1)
    np.add.at(gone, e, -1)
    kept = np.cumsum(gone[:-1]) == 0
    texts = []
    for k, w in enumerate(words):
        if offsets[k] < offsets[k + 1]:
            w = [x for x, stays in zip(w, kept[ends[k] - n[k] : ends[k]].tolist()) if stays]
        texts.append(b" ".join(w).decode())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat).cast(_RUNS), pa.array(texts, pa.string())


def periodic_runs(docs: DataFrame, least: int = LEAST, text: str = "text") -> DataFrame:
    """doc_id, n_words, runs (array of start, length and period, in words from 0, by start and then period) and collapsed
    (the text's words joined by a space, without those that any run has after its first period) of every row.

    Null, empty and blank texts: no words, no runs, an empty collapsed text. Null and repeated ids: a row each. No rows:
    none. Other columns are not read. A text is worked on whole in one task, in memory linear in its length.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", _RUNS), ("collapsed", pa.string())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Words()
        for batch in batches:
            ids, at = batch.column(0), 0
            for words in _batches(batch.column(1).to_pylist()):
                runs, collapsed = _rows(words, numbers, least)
                n = pa.array([len(w) for w in words], pa.int64())
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(words)), n, runs, collapsed], schema=schema)
                at += len(words)

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return given.mapInArrow(found, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, with a periodic stretch in every text whose h, the CRC-32 of doc_id, is a multiple of 10: of its n
    words, from word ``g % n`` on they repeat the next ``1 + (n - g % n) // (3 + g % 8)``, where g is h // 10. Null ids,
    null texts and texts without words stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    g = F.floor(h / 10).cast("long")
    told = docs.select("doc_id", "text", g.alias("g"), F.when((h % 10 == 0) & F.col("text").isNotNull(), words).alias("w"))
    n = F.size("w").cast("long")
    told = told.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)).cast("long"))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    repeated = F.transform("w", lambda x, i: F.get("w", place(i).cast("int")))
    return told.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the longest run (ties: least start, then period; nulls
    without a run), runs_sha256 and collapsed_sha256, from what ``periodic_runs`` returns."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("less"), r.start.alias("start"), r.period.alias("period"))))
    told = found.select("doc_id", "collapsed", "runs", best.alias("b"))
    lines = F.concat(F.lit(""), F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return told.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("b.start").alias("start"),
        (-F.col("b.less")).alias("length"),
        F.col("b.period").alias("period"),
        F.floor(-1000 * F.col("b.less") / F.col("b.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
