"""Token counts of whole texts: batch encoding inside Arrow functions that return lengths only.

Texts are split at safe boundaries: before a space or line feed that follows other than white space, and between a letter
and a punctuation mark. A byte-level pre-tokenizer always ends a piece there, and neither its look-ahead nor the merges
reach across, so the counts of the parts add up to the count of the text. The parts repeat a lot, so each Python worker keeps the lengths of parts that it
has met in a table of bounded size, and only encodes new ones, in batches balanced by bytes.
"""

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts that a worker remembers (a part may have PART_CHARS at most), and bytes in one call of the library.
REMEMBERED, PART_CHARS, BATCH_BYTES = 400_000, 48, 1 << 20

#: Before a space or line feed that follows anything but white space; between an ASCII letter and a mark that is neither
#: an apostrophe (contractions) nor part of a special token.
_split = re.compile(r"(?<=\S)(?=[ \n])|(?<=[A-Za-z])(?=[.,;:!?%$*#&])").split
_state: dict = {}

#: How the byte-level pre-tokenizer spells bytes: printable Latin-1 as itself, the rest as U+0100 and on, in order.
_plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
_spelt = {b: b for b in _plain} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_plain))}


def batches(texts: list[str], most: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Cut a list into runs of about equal bytes; a text larger than that is a run of its own."""
    run, size = [], 0
    for t in texts:
        n = len(t.encode())
        if run and size + n > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += n
    if run:
        yield run


def _counter(path: str):
    """The worker's tokenizer and its table of lengths."""
    if path not in _state:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _state.clear()
        _state[path] = (tokenizer, {})
    return _state[path]


def _one_piece(part: str) -> bool:
    """Is it Latin letters, after a space at most? The pre-tokenizer leaves such a part whole."""
    return part[part[0] == " " :].isalpha() and max(part) < "\u0250"


def count_texts(texts: list[str], path: str) -> list[int]:
    """Tokens of each text as the library gives them, without added special tokens."""
    tokenizer, known = _counter(path)
    parts = [_split(t) if t else [] for t in texts]
    new = {p for ps in parts for p in ps if p not in known}
    seen = known
    if len(known) + len(new) > REMEMBERED:
        known.clear()
        new = {p for ps in parts for p in ps}
        seen = known if len(new) <= REMEMBERED else {}
    merge, long, rest = tokenizer.model.tokenize, {}, []
    for p in new:
        if len(p) <= PART_CHARS and _one_piece(p):
            seen[p] = len(merge(p.encode().decode("latin-1").translate(_spelt)))
        else:
            rest.append(p)
    for run in batches(rest):
        for p, e in zip(run, tokenizer.encode_batch_fast(run, add_special_tokens=False)):
            (seen if len(p) <= PART_CHARS else long)[p] = len(e)
    if not long:
        get = seen.__getitem__
        return [sum(map(get, ps)) for ps in parts]
    return [sum(seen[p] if p in seen else long[p] for p in ps) for ps in parts]


def n_tokens(text: Column, path: str) -> Column:
    """Number of tokens (long) of a text column; null counts as empty."""

    @F.pandas_udf("long")
    def count(batch: pd.Series) -> pd.Series:
        texts = batch.fillna("").tolist()
        out = []
        for run in batches(texts, 8 * BATCH_BYTES):
            out += count_texts(run, path)
        return pd.Series(out, dtype="int64")

    return count(text)


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row, in one pass without a shuffle.

    Null and empty texts: 0 bytes, 0 tokens, false. Repeated rows and ids: a row each. No rows: none. Other columns of
    the input are not read. The tokenizer's path must be readable on the executors.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text, path).alias("n_tokens")).withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
