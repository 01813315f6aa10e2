"""SentencePiece encoding with seeded merge-dropout, and decoding.

A merge-type model joins neighbouring symbols in the order of its piece scores, kept on an agenda (a heap). With dropout
each candidate merge that comes up is skipped when a keyed hash of it falls under the rate, for good. So one text has
many segmentations, all of which decode to the same text:
characters without a piece, and the model's own space mark where a text holds it, are spelt in byte pieces.

The hash takes the key, the document (its id and text), the place of the word in it, and the candidate's place and
length, so each occurrence of a word is drawn anew. Until a candidate is skipped, all occurrences of a word merge alike;
so a worker remembers words that recur as trees of bounded size: a node has the candidates that come up one after another
while nothing more is skipped, and what comes out of them, and for each candidate a child in which it is skipped. An
occurrence hashes its node's candidates, goes to the child of the first one skipped, and so on until none is; only nodes
that nobody has reached before are merged. The same key, text and id always give the same pieces, whatever the partitions.
"""

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Nodes that a worker remembers, and characters of a word up to which it has nodes: each of its symbols begins three
#: candidates at most, so that one's place among those of its word is below 64.
REMEMBERED, TREE_CHARS = 400_000, 21
#: Characters of text encoded at a time.
RUN_CHARS = 1_000_000

#: Occurrences of words looked up at a time; words merged at a time, and widths in characters of the arrays for that.
AT_HAND, TOGETHER, WIDTHS = 1 << 18, 4096, (8, 12, TREE_CHARS, 32)

_words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
_models: dict = {}
_M = (1 << 64) - 1
_A, _B, _C = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0xC2B2AE3D27D4EB4F


def _mixed(x):
    """The usual 64-bit mixer, for a number or an array of uint64."""
    if isinstance(x, int):
        x = ((x ^ (x >> 30)) * _B) & _M
        return x ^ (x >> 31)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_B)
    return x ^ (x >> np.uint64(31))


class Pairs:
    """From two symbols to the piece they make: an open-addressed table that is looked up for whole arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(8, (4 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.keys, self.made = np.full(size, -1, dtype=np.int64), np.full(size, -1, dtype=np.int32)
        left = np.array([a for a, _ in pairs], dtype=np.int64)
        right = np.array([b for _, b in pairs], dtype=np.int64)
        keys = (left << 32) | right
        for key, at, made in zip(keys.tolist(), self._slot(keys).tolist(), pairs.values()):
            while self.keys[at] >= 0:
                at = (at + 1) & (size - 1)
            self.keys[at], self.made[at] = key, made

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(_A)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the pieces made, -1 where there is none."""
        keys = (left.astype(np.int64) << 32) | right
        at = self._slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.made[at], -1)
        more = np.flatnonzero((there != keys) & (there >= 0))
        while len(more):
            at[more] = (at[more] + 1) & (len(self.keys) - 1)
            there = self.keys[at[more]]
            hit = there == keys[more]
            out[more[hit]] = self.made[at[more[hit]]]
            more = more[~hit & (there >= 0)]
        return out


class Pool:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.data, self.n = np.zeros(1 << 12, dtype=kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(self.n + 2 * len(more), dtype=self.data.dtype)])
        self.data[self.n : self.n + len(more)] = more
        self.n += len(more)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of ranges, one range after another."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class Trees:
    """Nodes of words: a word, the places of its skipped candidates as bits, and the candidates after the last of them."""

    def __init__(self):
        self.roots: dict[str, int] = {}
        self.words: list[str] = []
        self.mask, self.begin = Pool(np.uint64), Pool(np.int64)  # begin: place of the node's first candidate
        self.at, self.size, self.out, self.out_size = (Pool(np.int64) for _ in range(4))
        self.steps, self.child, self.ids = Pool(np.uint64), Pool(np.int64), Pool(np.int32)

    def add(self, words: list[str], mask: np.ndarray, begin: np.ndarray, steps: np.ndarray, sizes: np.ndarray, ids: np.ndarray, out_sizes: np.ndarray) -> np.ndarray:
        """Numbers of new nodes, from their candidates and ids one after another."""
        first = self.mask.n
        self.at.add(self.steps.n + np.cumsum(sizes) - sizes), self.size.add(sizes)
        self.out.add(self.ids.n + np.cumsum(out_sizes) - out_sizes), self.out_size.add(out_sizes)
        self.words += words
        self.mask.add(mask), self.begin.add(begin), self.steps.add(steps), self.ids.add(ids)
        self.child.add(np.full(len(steps), -1))
        return np.arange(first, first + len(words))


class Pieces:
    """A model's pieces, and its merge rules with dropout."""

    def __init__(self, path: str, rate: float = 0.1, key: str = "melodex"):
        from sentencepiece import SentencePieceProcessor

        self.sp = SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        plain = [i for i in range(n) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i))]
        self.ids = {self.sp.id_to_piece(i): i for i in plain}
        self.bytes = np.array([self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        if any(SPACE in p.lstrip(SPACE) for p in self.ids) or not all(map(self.sp.is_byte, self.bytes.tolist())):
            raise ValueError("the model joins words, or has no byte pieces")
        self.base = n  # symbols from here on are characters without a piece
        self.rank = np.full(n + 1, np.inf, dtype=np.float32)
        for i in plain:
            self.rank[i] = -self.sp.get_score(i)
        symbol = lambda s: self.ids.get(s, n + ord(s) if len(s) == 1 else None)
        self.pairs = Pairs({(a, b): i for p, i in self.ids.items() for k in range(1, len(p)) if (a := symbol(p[:k])) is not None and (b := symbol(p[k:])) is not None})
        self.most = int(rate * (1 << 64)) - 1  # hashes up to this skip; none do at -1
        self.key = int.from_bytes(blake2b(key.encode(), digest_size=8).digest(), "little")
        self._forget()

    def _forget(self) -> None:
        self.trees = Trees()
        mark = self.bytes[list(SPACE.encode())]
        none = np.zeros(0, dtype=np.uint64)
        self.trees.roots[""] = int(self.trees.add([""], np.zeros(1, np.uint64), np.zeros(1, np.int64), none, np.zeros(1, np.int64), mark, np.array([len(mark)]))[0])

    def _in_bytes(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words, one word after another, with characters that have no piece spelt in byte pieces."""
        odd = symbols >= self.base
        if not odd.any():
            return symbols, sizes
        codes = symbols[odd] - self.base
        each = np.ones(len(symbols), dtype=np.int64)
        each[odd] = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
        before = np.concatenate([[0], np.cumsum(each)])
        ends = np.cumsum(sizes)
        out = np.repeat(symbols, each)
        out[np.repeat(odd, each)] = self.bytes[np.frombuffer("".join(map(chr, codes.tolist())).encode(), dtype=np.uint8)]
        return out, before[ends] - before[ends - sizes]

    def merge_long(self, word: str, draw: int) -> bytes:
        """Ids of one word under a draw (64 bits of its occurrence), with the agenda as a heap: for words of any length."""
        get, base = self.ids.get, self.base
        part = list(word)
        n = len(part)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        right[-1] = -1
        rank = lambda p: float(self.rank[get(p)])
        agenda = [(rank(p), i, i + 1, p) for i in range(n - 1) if (p := part[i] + part[i + 1]) in self.ids]
        heapify(agenda)
        while agenda:
            _, i, j, p = heappop(agenda)
            if not part[i] or right[i] != j or len(part[i]) + len(part[j]) != len(p):
                continue  # one of the two has been merged away
            if _mixed((draw + i * _A + len(p) * _C) & _M) <= self.most:
                continue
            part[i], part[j] = p, ""
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if (q := p + part[k]) in self.ids:
                    heappush(agenda, (rank(q), i, k, q))
            h = left[i]
            if h >= 0 and (q := part[h] + p) in self.ids:
                heappush(agenda, (rank(q), h, i, q))
        symbols = np.array([get(p, base + ord(p[0])) for p in part if p], dtype=np.int32)
        return self._in_bytes(symbols, np.array([len(symbols)]))[0].astype("<i4").tobytes()

    def _side_by_side(self, words: list[str], width: int, draws: np.ndarray | None = None, masks: np.ndarray | None = None):
        """Ids of words up to ``width`` characters and how many each has; each step takes every word's best candidate.

        A candidate is skipped as its hash under the word's draw says, or, with ``masks``, where its place among the
        word's candidates is in the mask; then the candidates' steps (n, most) and how many each has come as well.
        """
        n = len(words)
        rows = np.arange(n)
        sym = np.full((n, width + 1), -1, dtype=np.int32)
        sizes = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        uniq, back = np.unique(codes, return_inverse=True)
        named = np.array([self.ids.get(chr(c), self.base + c) for c in uniq.tolist()], dtype=np.int32)
        inside = np.arange(width + 1) < sizes[:, None]
        sym[inside] = named[back]
        size = inside.astype(np.int8)  # characters of each symbol
        nxt = np.tile(np.arange(1, width + 2, dtype=np.int16), (n, 1))
        prv = nxt - 2
        made = np.full((n, width + 1), -1, dtype=np.int32)
        both = np.argwhere(inside[:, 1:])
        made[both[:, 0], both[:, 1]] = self.pairs.get(sym[both[:, 0], both[:, 1]], sym[both[:, 0], both[:, 1] + 1])
        best = self.rank[made]  # the last entry, for -1, is infinite
        live, place = rows, 0
        steps = [] if masks is not None else None
        count = np.zeros(n, dtype=np.int64)
        while True:
            i = best[live].argmin(axis=1)
            on = best[live, i] < np.inf
            live, i = live[on], i[on]
            if not len(live):
                break
            j = nxt[live, i].astype(np.int64)
            step = i.astype(np.uint64) * np.uint64(_A) + (size[live, i] + size[live, j]).astype(np.uint64) * np.uint64(_C)
            if masks is not None:
                skip = (masks[live] >> np.uint64(place)) & np.uint64(1) == 1
                column = np.zeros(n, dtype=np.uint64)
                column[live] = step
                steps.append(column)
                count[live] += 1
                place += 1
            elif self.most >= 0:
                skip = _mixed(draws[live] + step) <= np.uint64(self.most)
            else:
                skip = np.zeros(len(live), dtype=bool)
            best[live[skip], i[skip]] = np.inf
            r, i, j = live[~skip], i[~skip], j[~skip]
            sym[r, i] = made[r, i]
            size[r, i] += size[r, j]
            sym[r, j] = -1
            best[r, j] = np.inf
            k = nxt[r, j].astype(np.int64)
            nxt[r, i] = k
            last = k >= sizes[r]
            prv[r, np.minimum(k, width)] = i
            m = np.where(last, -1, self.pairs.get(sym[r, i], np.maximum(sym[r, np.minimum(k, width)], 0)))
            made[r, i], best[r, i] = m, self.rank[m]
            h = prv[r, i].astype(np.int64)
            has = h >= 0
            r, h, i = r[has], h[has], i[has]
            m = self.pairs.get(sym[r, h], sym[r, i])
            made[r, h], best[r, h] = m, self.rank[m]
        keep = sym >= 0
        out = self._in_bytes(sym[keep], keep.sum(axis=1))
        return out if masks is None else (*out, np.stack(steps, axis=1) if steps else np.zeros((n, 0), dtype=np.uint64), count)

    def _by_width(self, words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(width, places) of words that are merged together; width 0: one word that is too long for that."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        for low, width in zip((-1, *WIDTHS), WIDTHS):
            pick = np.flatnonzero((sizes > low) & (sizes <= width))
            for at in range(0, len(pick), TOGETHER):
                yield width, pick[at : at + TOGETHER]
        for i in np.flatnonzero(sizes > WIDTHS[-1]):
            yield 0, np.array([i])

    def _merged(self, words: list[str], draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words under draws, one word after another, and how many each has."""
        order, ids, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for width, pick in self._by_width(words):
            if width:
                a, b = self._side_by_side([words[i] for i in pick.tolist()], width, draws[pick])
            else:
                a = np.frombuffer(self.merge_long(words[pick[0]], int(draws[pick[0]])), dtype="<i4")
                b = np.array([len(a)])
            order.append(pick), ids.append(a), sizes.append(b)
        at, ids, sizes = map(np.concatenate, (order, ids, sizes))
        back = np.argsort(at)
        return ids[_ranges((np.cumsum(sizes) - sizes)[back], sizes[back])], sizes[back]

    def merged(self, words: list[tuple[str, int]]) -> dict[tuple[str, int], bytes]:
        """Ids (little-endian 32-bit numbers) of words under draws."""
        ids, sizes = self._merged([w for w, _ in words], np.array([d for _, d in words], dtype=np.uint64))
        ends = np.cumsum(sizes)
        return {x: ids[a:b].astype("<i4").tobytes() for x, a, b in zip(words, (ends - sizes).tolist(), ends.tolist())}

    def _grown(self, words: list[str], masks: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Numbers of new nodes of words with the candidates in a mask skipped."""
        out = np.zeros(len(words), dtype=np.int64)
        for width, pick in self._by_width(words):
            some = [words[i] for i in pick.tolist()]
            ids, sizes, steps, count = self._side_by_side(some, width, masks=masks[pick])
            place = np.arange(steps.shape[1])
            own = (place >= begins[pick][:, None]) & (place < count[:, None])
            out[pick] = self.trees.add(some, masks[pick], begins[pick], steps[own], own.sum(axis=1), ids, sizes)
        return out

    def _settled(self, node: np.ndarray, draws: np.ndarray) -> np.ndarray:
        """The nodes in which occurrences of words end: none of their candidates is skipped."""
        t = self.trees
        at = np.arange(len(node))
        while len(at) and self.most >= 0:
            sizes = t.size.data[node[at]]
            flat = _ranges(t.at.data[node[at]], sizes)
            hit = np.flatnonzero(_mixed(np.repeat(draws[at], sizes) + t.steps.data[flat]) <= np.uint64(self.most))
            of = np.searchsorted(np.cumsum(sizes), hit, side="right")
            first = np.ones(len(of), dtype=bool)
            first[1:] = of[1:] != of[:-1]
            at, step = at[of[first]], flat[hit[first]]
            new, where = np.unique(step[t.child.data[step] < 0], return_index=True)
            if len(new):
                parent = node[at[t.child.data[step] < 0][where]]
                place = new - t.at.data[parent] + t.begin.data[parent]
                grown = self._grown([t.words[p] for p in parent.tolist()], t.mask.data[parent] | (np.uint64(1) << place.astype(np.uint64)), place + 1)
                t.child.data[new] = grown
            node[at] = t.child.data[step]
        return node

    def _segmented(self, words: list[str], draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of occurrences of words, one after another, and how many each has."""
        if self.trees.mask.n > REMEMBERED:
            self._forget()
        roots = self.trees.roots
        node = np.fromiter(map(roots.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        unknown = np.flatnonzero(node < 0).tolist()
        # What occurs once here is merged as it is: remembering it would cost more.
        new = [w for w, n in Counter([words[i] for i in unknown]).items() if n > 1 and len(w) <= TREE_CHARS]
        if new:
            roots.update(zip(new, self._grown(new, np.zeros(len(new), np.uint64), np.zeros(len(new), np.int64)).tolist()))
            node[unknown] = [roots.get(words[i], -1) for i in unknown]
        known, alone = np.flatnonzero(node >= 0), np.flatnonzero(node < 0)
        ends = self._settled(node[known], draws[known])
        t = self.trees
        ids, own = self._merged([words[i] for i in alone.tolist()], draws[alone])
        starts, sizes = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        starts[known], sizes[known] = t.out.data[ends], t.out_size.data[ends]
        starts[alone], sizes[alone] = t.ids.n + np.cumsum(own) - own, own
        return np.concatenate([t.ids.data[: t.ids.n], ids])[_ranges(starts, sizes)], sizes

    def _plan(self, text: str | None, name: object) -> tuple[list[str], np.ndarray]:
        """The words of a text and their draws; a space mark that the text holds is a word "" of its own."""
        if not text:
            return [], np.zeros(0, dtype=np.uint64)
        words: list[str] = []
        for k, part in enumerate(text.split(SPACE)):
            words += [""] * (k > 0) + _words((SPACE if k == 0 else "") + part.replace(" ", SPACE))
        base = int.from_bytes(blake2b(f"{name}\0{text}".encode(), digest_size=8).digest(), "little") ^ self.key
        return words, _mixed(_mixed(np.uint64(base) + np.arange(len(words), dtype=np.uint64) * np.uint64(_A)))

    def encode_all(self, texts: list[str | None], names: list) -> list[np.ndarray]:
        """Ids of texts; a text and its name (its document's id) choose its draws."""
        plans = [self._plan(t, n) for t, n in zip(texts, names)]
        words, draws = [w for own, _ in plans for w in own], np.concatenate([np.zeros(0, dtype=np.uint64), *[d for _, d in plans]])
        parts = [self._segmented(words[a : a + AT_HAND], draws[a : a + AT_HAND]) for a in range(0, max(1, len(words)), AT_HAND)]
        ids, sizes = (np.concatenate(x) for x in zip(*parts))
        before = np.concatenate([[0], np.cumsum(sizes)])
        cuts = before[np.cumsum([0, *[len(own) for own, _ in plans]])].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode(self, text: str | None, name: object = None) -> np.ndarray:
        """Ids of one text."""
        return self.encode_all([text], [name])[0]

    def decode(self, ids) -> str:
        """The text of ids."""
        return self.sp.decode([int(i) for i in ids] if not isinstance(ids, np.ndarray) else ids.tolist())


def model(path: str, rate: float, key: str) -> Pieces:
    """The worker's model, loaded once."""
    if (path, rate, key) not in _models:
        _models.clear()
        _models[path, rate, key] = Pieces(path, rate, key)
    return _models[path, rate, key]


def decoded(ids: Column, path: str) -> Column:
    """The text of a column of ids."""

    @F.pandas_udf("string")
    def text(batch: pd.Series) -> pd.Series:
        m = model(path, 0.0, "")
        return pd.Series([m.decode(i) if i is not None else None for i in batch], dtype=object)

    return text(ids)


def _runs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about RUN_CHARS characters, so that what is at hand stays small whatever a batch holds."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > RUN_CHARS:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def encode_documents(docs: DataFrame, path: str, rate: float = 0.1, key: str = "melodex") -> DataFrame:
    """doc_id, n_tokens, ids and lossless (decoding gave the whole text back) of every row, in one pass.

    Null and empty texts: no ids, lossless. Repeated rows with one id get the same ids; the same text under two ids may
    differ. Ties on the agenda: the leftmost candidate. No rows: none. Other columns are not read.
    """

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path, rate, key)
        for batch in batches:
            for a, b in _runs(texts := batch.column(1).to_pylist()):
                names = batch.column(0).slice(a, b - a)
                ids = m.encode_all(texts[a:b], ["null" if n is None else str(n) for n in names.to_pylist()])
                lossless = [m.decode(i) == (t or "") for i, t in zip(ids, texts[a:b])]
                sizes = np.array([len(i) for i in ids], dtype=np.int64)
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([names, pa.array(sizes), lists, pa.array(lossless)], names=["doc_id", "n_tokens", "ids", "lossless"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(told, f"doc_id {kind}, n_tokens long, ids array<int>, lossless boolean")
