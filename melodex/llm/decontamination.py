"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items scans every text once.

Items are cut into windows of 10 words (a shorter item is one window). Each different word of the items is spelt as two
characters, so the automaton is some times smaller than over their letters, and its nodes have few children. It holds
each different window with the items that contain it. Texts are normalised byte by byte, so a match's words map straight
back to offsets in the original. The scan needs no shuffle. Items are cut into runs of words that overlap by a window
less one word, and the runs reach the executors in blocks of a bounded number of windows, which bounds the automaton; a
benchmark within one block (the usual case) means one automaton and one scan, a larger one a scan for each block, with
the hits so far written between. The driver holds one block at a time.
"""

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Words of a window; words of a run that an item is cut into; windows of a block, each about 20 nodes of 40 bytes.
WINDOW, RUN, BLOCK_WINDOWS = 10, 4096, 400_000

#: A-Z to a-z; other ASCII that isn't a letter or digit to a space; the bytes of other characters stay.
_fold = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Where the first and second characters of words begin, and the word that no item has.
_FIRST, _SECOND, _NONE = 0x100, 0x4000, "\x01\x01"
_built: dict = {}


def words_of(text: str | None) -> list[bytes]:
    """Words of a normalised text: runs of a-z, 0-9 and non-ASCII characters, after lower-casing A-Z."""
    return text.encode().translate(_fold).split() if text else []


def runs_of(words: list[bytes], width: int = WINDOW, most: int = RUN) -> Iterator[list[bytes]]:
    """Runs of up to ``most`` words such that each window lies in one of them; none without words."""
    for at in range(0, max(len(words) - width + 1, min(1, len(words))), most - width + 1):
        yield words[at : at + most]


@dataclass
class Matcher:
    """An automaton over windows, and the spelling of their words."""

    codes: dict[bytes, str]
    auto: object

    def spelt(self, words: list[bytes]) -> str:
        get = self.codes.get
        return "".join([get(w, _NONE) for w in words])


def automaton(runs: Iterable[tuple[str | None, str]], width: int = WINDOW) -> Matcher | None:
    """Automaton over the windows of (item, words) runs; None when there are none. Items without an id have no owner."""
    import ahocorasick

    runs = [(item, text.encode().split()) for item, text in runs]
    words = sorted({w for _, ws in runs for w in ws})
    if not words:
        return None
    side = 1 + int(len(words) ** 0.5)
    out = Matcher({w: chr(_FIRST + k // side) + chr(_SECOND + k % side) for k, w in enumerate(words)}, ahocorasick.Automaton())
    for item, ws in runs:
        n = min(width, len(ws))
        flat, alone = out.spelt(ws), (n, [item] if item is not None else [])
        for at in range(len(ws) - n + 1):
            window = flat[2 * at : 2 * (at + n)]
            known = out.auto.get(window, None)
            if known is None:
                out.auto.add_word(window, alone)
            elif item is not None and item not in known[1][-1:]:
                if len(known[1]) < 2:  # until now the list of all windows of one run
                    out.auto.add_word(window, (n, [*known[1], item]))
                else:
                    known[1].append(item)
    out.auto.make_automaton()
    return out


def scan(text: str | None, matcher: Matcher | None) -> tuple[int, list[list[int]], set]:
    """Number of words, merged runs [first, last + 1] of hit words, and the items with occurring windows."""
    words = words_of(text)
    if matcher is None or not words:
        return len(words), [], set()
    runs: list[list[int]] = []
    ids: set = set()
    before = None
    for end, (n, owners) in matcher.auto.iter(matcher.spelt(words)):
        last = end // 2 + 1  # words up to the match's end
        if owners is not before:
            ids.update(owners)
            before = owners
        first = last - n
        while runs and runs[-1][1] >= first:  # shorter windows may end later and begin earlier
            a, b = runs.pop()
            first, last = min(a, first), max(b, last)
        runs.append([first, last])
    return len(words), runs, ids


def spans_of(text: str, runs: list[list[int]]) -> list[tuple[int, int]]:
    """Character offsets in the original of runs of words."""
    if not runs:
        return []
    at = [m.span() for m in _word.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in runs]


def _blocks(items: DataFrame, width: int, most: int) -> Iterator[list[tuple[str | None, str]]]:
    """Runs of words of the items in blocks of about ``most`` windows, at most; one block at a time reaches the driver."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(item, b" ".join(run).decode(), max(1, len(run) - width + 1)) for item, text in zip(rows["item"], rows["text"]) for run in runs_of(words_of(text), width)]
            yield pd.DataFrame(out, columns=["item", "words", "n"])

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, size = 0, 0
        for rows in batches:
            names = []
            for n in rows["n"].tolist():
                if size and size + n > most:
                    block, size = block + 1, 0
                size += n
                names.append(f"{TaskContext.get().partitionId()} {block}")
            yield rows.assign(block=names)

    given = items.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null")
    runs = written(given.mapInPandas(cut, "item string, words string, n long"))
    total = runs.agg(F.sum("n")).first()[0] or 0
    if total <= most:
        yield [tuple(r) for r in runs.select("item", "words").collect()]
        return
    dealt = written(runs.repartition(-(-total // most), F.xxhash64("item", "words")).mapInPandas(numbered, "item string, words string, n long, block string"))
    for name in sorted(r.block for r in dealt.select("block").distinct().collect()):  # about two a ``most`` windows
        yield [tuple(r) for r in dealt.where(F.col("block") == name).select("item", "words").collect()]


_ACC = "n_words long, runs array<array<int>>, ids array<string>"


def _scanner(shared, width: int):
    """Arrow function: a block's hits in each text, added to the hits so far."""

    @F.pandas_udf(_ACC)
    def scanned(texts: pd.Series, runs: pd.Series, ids: pd.Series) -> pd.DataFrame:
        block = shared.value
        if _built.get("block") is not block:
            _built.clear()  # before the next one is built
            _built.update(block=block, automaton=automaton(block, width))
        rows = []
        for text, old_runs, old_ids in zip(texts, runs, ids):
            n, new, owners = scan(text, _built["automaton"])
            if len(old_runs):
                new, owners = _merged([list(map(int, r)) for r in old_runs] + new), owners | set(old_ids)
            rows.append((n, new, sorted(owners)))
        return pd.DataFrame(rows, columns=["n_words", "runs", "ids"])

    return scanned


def _teller():
    """Arrow function: the digest of the items, and the runs as offsets in the original."""

    @F.pandas_udf("items_sha256 string, spans array<struct<start: int, end: int>>")
    def told(texts: pd.Series, runs: pd.Series, ids: pd.Series) -> pd.DataFrame:
        sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids]
        spans = [[{"start": a, "end": b} for a, b in spans_of(t, list(r))] if len(r) else [] for t, r in zip(texts, runs)]
        return pd.DataFrame({"items_sha256": sha, "spans": spans})

    return told


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WINDOW, most: int = BLOCK_WINDOWS, carry: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and spans (character offsets of the hit runs) of
    every row; with ``carry`` also ``doc``, a struct of the input row.

    Texts and items that are null or have no words match nothing; the windows of items with a null id hit, but add
    nothing to the items; an id or text repeated among the items counts once. Ties don't arise: all windows count. Repeated documents: a row each. No
    documents: no rows; no items: no hits. Other columns are not read unless carried.
    """
    spark = docs.sparkSession
    none = "array()"
    state = docs.select("doc_id", "text", *[F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] * carry, F.expr(f"struct(0L AS n_words, cast({none} AS array<array<int>>) AS runs, cast({none} AS array<string>) AS ids)").alias("acc"))
    for k, block in enumerate(_blocks(items, width, most)):
        state = (written(state) if k else state).withColumn("acc", _scanner(spark.sparkContext.broadcast(block), width)("text", "acc.runs", "acc.ids"))
    hit = F.aggregate("acc.runs", F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])
    return state.withColumn("told", _teller()("text", "acc.runs", "acc.ids")).select(
        "doc_id",
        "acc.n_words",
        hit.alias("n_hit"),
        F.size("acc.ids").cast("long").alias("n_items"),
        "told.items_sha256",
        (F.size("acc.runs") > 0).alias("contaminated"),
        "told.spans",
        *["doc"] * carry,
    )


def _merged(runs: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out
