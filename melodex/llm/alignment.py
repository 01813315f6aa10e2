"""Alignment of two tokenizers over a corpus, each different text once.

Texts are shuffled whole and counted; each different one is encoded by a byte-level model (A) and a SentencePiece model
(B), and its tokens' byte ranges are laid side by side. Where a token of both ends, a group of tokens ends, and the two
tokens that end there are linked. Links of a pair of ids are counted over the corpus, each text's as often as the text
occurs; each text is then measured by the counts of its pairs, and the measures go back to the documents.

Neither model has a token that holds a space after another character, so both end one before such a space: texts are cut
there, and a worker remembers the parts that it has met, in a table of bounded size. Models that may reach across are
given whole texts.
"""

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spread_join, written

#: Parts that a worker remembers, and a part's characters at most; characters of texts encoded at a time.
REMEMBERED, PART_CHARS, RUN_CHARS = 400_000, 48, 1 << 20
#: Different pairs of ids up to which their counts are broadcast, about 100 MB; more are joined by shuffles.
BROADCAST_PAIRS = 2_000_000

SPACE = "▁"
_split = re.compile(r"(?<=\S)(?= )").split
_byte = re.compile(r"<0x([0-9A-F]{2})>")
_state: dict = {}


def _unspelt() -> dict[int, int]:
    """The byte that each character of a byte-level token stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in plain} | {256 + i: b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


class Aligner:
    """Both models, and a table of parts that are aligned already."""

    def __init__(self, a: str, b: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), SentencePieceProcessor(model_file=b)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        back = _unspelt()
        added = {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        ids = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            self.bytes_a[i] = added.get(i) or bytes(back[ord(c)] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if self.b.is_byte(i) and (m := _byte.fullmatch(p)) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.blank = self.b.piece_to_id(SPACE)
        told = json.loads(self.a.to_str())
        level = told["pre_tokenizer"] or {}
        plain = level.get("type") == "ByteLevel" and level.get("use_regex", True) and not level.get("add_prefix_space") and not told["normalizer"]
        # B leaves a text as it is, but for a space before it, and joins no space to what stands before it.
        kept = all(self.b.decode(self.b.encode(t)) == t for t in ("ﬁ ①  Å é x", "  a　b", "ẛ̣ ² "))
        self.apart = plain and kept and not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.length_a, self.length_b = (np.array([len(x) for x in names]) for names in (self.bytes_a, self.bytes_b))
        self.names_a = np.array([[f"{i}{end}" for i in range(len(self.bytes_a))] for end in ",|"], dtype=object)
        self.names_b = np.array([[f"{i}{end}" for i in range(len(self.bytes_b))] for end in ",;"], dtype=object)
        self.forget()

    def forget(self) -> None:
        """Empty the table of parts: number by part, and by number its tokens of A and B, its links, where they begin, and its groups as text."""
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.sizes, self.pairs, self.n_pairs = np.zeros((4, 1 << 12), dtype=np.int64), np.zeros(1 << 14, dtype=np.int64), 0

    def _spelt(self, told: list[bytes], ids: list[list[int]], names: list[bytes], lengths: np.ndarray) -> np.ndarray:
        """Which parts do the bytes of their tokens spell?"""
        n = np.array([len(x) for x in ids])
        flat = np.fromiter(chain.from_iterable(ids), dtype=np.int64)
        size = np.diff(np.append(0, np.cumsum(lengths[flat]))[np.append(0, np.cumsum(n))])
        if b"".join(map(names.__getitem__, flat.tolist())) == b"".join(told) and (size == [len(t) for t in told]).all():
            return np.ones(len(told), dtype=bool)
        return np.array([b"".join(map(names.__getitem__, x)) == t for x, t in zip(ids, told)], dtype=bool)

    def learn(self, parts: list[str]) -> None:
        """Encode and align new parts, each beginning with a space; B adds that space itself. A part that isn't spelt byte for
        byte has the number -1."""
        of_a = [e.ids for e in self.a.encode_batch_fast(parts, add_special_tokens=False)]
        of_b = [x if len(p) > 1 else [self.blank] for p, x in zip(parts, self.b.encode([p[1:] for p in parts], num_threads=1))]
        told = [p.encode() for p in parts]
        good = self._spelt(told, of_a, self.bytes_a, self.length_a) & self._spelt(told, of_b, self.bytes_b, self.length_b)
        if not good.all():
            self.known |= {p: -1 for p, x in zip(parts, good) if not x}
            parts, of_a, of_b = ([v for v, x in zip(values, good) if x] for values in (parts, of_a, of_b))
        if not parts:
            return
        n_a, n_b = np.array([len(x) for x in of_a]), np.array([len(x) for x in of_b])
        a, b = (np.fromiter(chain.from_iterable(x), dtype=np.int64) for x in (of_a, of_b))
        # Bytes of the parts one after the other: both models' tokens cut them at ascending places.
        at_a, at_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        met = np.searchsorted(at_b, at_a)
        i = np.flatnonzero(at_b[met] == at_a)
        j = met[i]
        ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
        links = np.diff(np.searchsorted(i, ends_a), prepend=0)
        # A group's tokens of A stand before its tokens of B.
        token, end = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
        end[i] = 1
        texts = np.empty(len(a) + len(b), dtype=object)
        texts[token + np.append(0, j + 1)[np.searchsorted(i, token)]] = self.names_a[end, a]
        token, end = np.arange(len(b)), np.zeros(len(b), dtype=np.int64)
        end[j] = 1
        texts[token + i[np.searchsorted(j, token)] + 1] = self.names_b[end, b]
        texts, first = texts.tolist(), len(self.groups)
        ends = (ends_a + ends_b).tolist()
        self.groups += ["".join(texts[s:e])[:-1] for s, e in zip([0, *ends], ends)]
        self.known |= {p: first + k for k, p in enumerate(parts)}
        if len(self.groups) > self.sizes.shape[1]:
            self.sizes = np.concatenate([self.sizes[:, :first], np.zeros((4, 2 * len(self.groups)), dtype=np.int64)], axis=1)
        self.sizes[:, first : len(self.groups)] = n_a, n_b, links, self.n_pairs + np.cumsum(links) - links
        pairs = a[i] << 32 | b[j]
        if self.n_pairs + len(pairs) > len(self.pairs):
            self.pairs = np.concatenate([self.pairs[: self.n_pairs], np.zeros(self.n_pairs + 2 * len(pairs), dtype=np.int64)])
        self.pairs[self.n_pairs : self.n_pairs + len(pairs)] = pairs
        self.n_pairs += len(pairs)

    def texts(self, texts: list[str]) -> Iterator[tuple]:
        """Of each text: tokens of A and of B, groups, links, groups as text, different pairs and how often each occurs."""
        none = (0, 0, 0, 0, "", (), ())
        parts = [(_split(f" {t}") if self.apart else [f" {t}"]) if t else [] for t in texts]
        every = dict.fromkeys(chain.from_iterable(parts))
        if len(self.known) + len(every) > REMEMBERED or self.n_pairs > REMEMBERED * 16:
            self.forget()
        new = [p for p in every if p not in self.known]
        if new:
            self.learn(new)
        number = self.known.__getitem__
        for ps in parts:
            of = list(map(number, ps))
            if not of or min(of) < 0:
                yield none
                continue
            n_a, n_b, links, begin = self.sizes[:, of]
            n, all_links = int(links.sum()), np.cumsum(links)
            keys, counts = np.unique(self.pairs[np.repeat(begin - all_links + links, links) + np.arange(n)], return_counts=True)
            yield int(n_a.sum()), int(n_b.sum()), n, n, ";".join(map(self.groups.__getitem__, of)), keys, counts
        for p in new:  # long parts seldom come again
            if len(p) > PART_CHARS:
                k = self.known.pop(p)
                if k >= 0:
                    self.groups[k] = ""


def aligner(a: str, b: str) -> Aligner:
    """The worker's models."""
    if (a, b) not in _state:
        _state.clear()
        _state[a, b] = Aligner(a, b)
    return _state[a, b]


_COLUMNS = "n_a long, n_b long, n_groups long, n_links long, groups string"
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]


def encoded(texts: DataFrame, a: str, b: str) -> DataFrame:
    """key, n (of ``texts``, beside their text), the columns of _COLUMNS, and pairs and counts, arrays of what is linked:
    A's id in the upper and B's in the lower half of a long, and its occurrences in the text."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a, b)
        for batch in batches:
            texts, begin, size = batch.column(2).to_pylist(), 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= RUN_CHARS or i + 1 == len(texts):
                    rows = zip(*both.texts(texts[begin : i + 1]))
                    part = [batch.column(k).slice(begin, i + 1 - begin) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*part, *(pa.array(v, k) for v, k in zip(rows, _KINDS[2:]))], names=names)
                    begin, size = i + 1, 0

    names = ["key", "n", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "counts"]
    return texts.select("key", "n", "text").mapInArrow(made, f"key string, n long, {_COLUMNS}, pairs array<long>, counts array<long>")


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, count (links over the corpus), best (is it the highest of its B id, ties included?) and n (texts that hold it)
    out of what ``encoded`` returns, written."""
    rows = found.select("n", F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    counted = rows.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum(F.col("n") * F.col("p.counts")).alias("count"), F.count("*").alias("n"))
    most = F.max("count").over(Window.partitionBy(F.col("pair").bitwiseAND((1 << 32) - 1)))
    return written(counted.select("pair", "count", (F.col("count") == most).alias("best"), "n"))


def align(docs: DataFrame, a: str, b: str, groups: Callable[[Column], Column] = lambda g: g, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups (``a1,a2|b1;a3|b2,b3``: ids in order) of every row.

    A encodes a space and the text, B the text; special tokens' strings are text. n_best counts the links whose pair is
    the most frequent of its B id over the corpus, ties included; count_sum adds up the pairs' counts over links. Null and
    empty texts, and texts that either model's tokens don't spell byte for byte (such as those with B's own space mark),
    have no tokens: zeros and empty groups. Null and repeated ids: a row each. No rows: none. Other columns are not read.

    ``groups`` says what to keep of a text's groups. Texts are one by their whole text; what is kept of each finds its
    documents by the text's SHA-256. A text of many documents, and a pair of many texts, are dealt over tasks.
    """
    given = docs.select("doc_id", "text")
    there = F.coalesce(F.col("text"), F.lit("")) != ""
    texts = given.where(there).groupBy("text").agg(F.count("*").alias("n")).withColumn("key", F.sha2(F.col("text").cast("binary"), 256))
    found = written(encoded(texts, a, b).withColumn("groups", groups(F.col("groups"))))
    pairs = pair_counts(found)
    rows = found.select("key", F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select("key", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("c"))
    if pairs.count() <= broadcast_pairs:
        told = rows.join(F.broadcast(pairs.drop("n")), "pair")
    else:
        told = spread_join(rows, pairs, "pair", found.agg(F.coalesce(F.sum(F.size("pairs")), F.lit(0))).first()[0], "key")
    sums = told.groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("c")).otherwise(0)).alias("n_best"), F.sum(F.col("c") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    measured = written(found.drop("pairs", "counts").join(sums.hint("merge"), "key", "left").select("key", "n", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups"))
    keyed = given.where(there).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("key"))
    out = spread_join(keyed, measured, "key", keyed.count(), "doc_id").drop("key")
    nothing = given.where(~there).select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], groups(F.lit("")).alias("groups"))
    return out.unionByName(nothing)


def digest(groups: Column) -> Column:
    """Hex SHA-256 of a text's groups; empty without tokens."""
    return F.when(groups == "", "").otherwise(F.sha2(groups.cast("binary"), 256))
