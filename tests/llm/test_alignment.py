"""Alignment of two tokenizers against whole texts encoded by the libraries, and its edge cases."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from melodex.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def models():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    level = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    back = {chr(x): x for x in level}
    back |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in level)}
    return a, SentencePieceProcessor(model_file=B), back


def side_by_side(models, text):
    """Groups of one text, from the libraries' tokens of the whole text."""
    a, b, back = models
    if not text:
        return []
    ea = a.encode(" " + text, add_special_tokens=False)
    of_a = [bytes(back[c] for c in t) for t in ea.tokens]
    ids = b.encode(text)
    of_b = [bytes([int(m[1], 16)]) if (m := re.fullmatch("<0x(..)>", p)) and b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, map(b.id_to_piece, ids))]
    if b"".join(of_a) != (" " + text).encode() or b"".join(of_b) != (" " + text).encode():
        return []
    ends = lambda of: [sum(map(len, of[: k + 1])) for k in range(len(of))]
    xs, ys = ends(of_a), ends(of_b)
    out, i, j = [], 0, 0
    for e in sorted(set(xs) & set(ys)):
        p, q = xs.index(e) + 1, ys.index(e) + 1
        out.append((ea.ids[i:p], ids[j:q]))
        i, j = p, q
    return out


def brute(models, rows):
    groups = [side_by_side(models, t) for _, t in rows]
    counts = Counter((a[-1], b[-1]) for g in groups for a, b in g)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for (i, _), g in zip(rows, groups):
        links = [counts[a[-1], b[-1]] for a, b in g]
        told = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(g), sum(counts[a[-1], b[-1]] == most[b[-1]] for a, b in g), sum(links), told))
    return out


ODD = ["", None, " ", "  ", "a", "a ", " a", "a  b", "a\n b", "a \n", "\n\n", "  x", "x  y", "x　 y z", "ﬁne ① Å", "▁", "a ▁b", "<s> </s> <unk> <0x41> <|endoftext|>", "<|endoftext|>x <|endoftext|> ", "日本語 テキスト", "🎉 🎉🎉‍", "don't can't  I'll", "\x00 \x01\x1f x", "é é", "tab\tand space", "x" * 3000, "ab " * 2000 + "▁", "\r\n \r\n", "1234567 89", "᠎ x", "ẛ̣ ²"]


def test_against_the_libraries(spark, models):
    """Odd white space, special strings, marks that can't be spelt, copies, ties, clashing columns, no rows."""
    rng = random.Random(3)
    words = ["the", "tokenizer", "läuft", "naïve", "x1", "foo_bar", "...", "日", "(a)", "été", "don't", "\n", "", "unbelievable"]
    rows = [(k, t) for k, t in enumerate(ODD)] + [(100 + k // 2, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))) for k in range(150)]
    rows += [(1000 + k, "hot copies of one text") for k in range(200)] + [(None, "hot copies of one text"), (None, None)]
    df = spark.createDataFrame([(i, t, 5, "k", 1) for i, t in rows], "doc_id long, text string, n int, key string, pairs int").repartition(4)
    key = lambda r: tuple((x is not None, x) for x in r)
    want = sorted(brute(models, rows), key=key)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert sorted(map(tuple, alignment.align(df, A, B).select(names).collect()), key=key) == want
    assert sorted(map(tuple, alignment.align(df, A, B, broadcast_pairs=10).select(names).collect()), key=key) == want
    assert alignment.align(df.limit(0), A, B).collect() == []


def test_given_documents(spark, models, tmp_path):
    """The registered query on real texts, and its digests."""
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = {r[0]: (*r[1:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in brute(models, rows)}
    got = queries.QUERIES["op13_alignment"](spark, folder)
    assert {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got.collect()} == want


def test_parts_are_safe():
    """Both models cut before a space that follows another character, so parts are encoded apart; the worker forgets in time."""
    both = alignment.Aligner(A, B)
    assert both.apart
    both.apart = False
    whole = [r[:5] for r in both.texts([t or "" for t in ODD])]
    both.apart = True
    assert [r[:5] for r in both.texts([t or "" for t in ODD])] == whole
    before = alignment.REMEMBERED
    try:
        alignment.REMEMBERED = 5
        assert [next(both.texts([t or ""]))[:5] for t in ODD] == whole and len(both.known) <= 2000
    finally:
        alignment.REMEMBERED = before


def test_texts_are_encoded_once(spark):
    """Copies are one row of what is encoded, counted."""
    df = spark.range(50).select("id", F.lit("same text").alias("text"))
    texts = df.groupBy("text").count().withColumnRenamed("count", "n").withColumn("key", F.lit("k"))
    (row,) = alignment.encoded(texts, A, B).collect()
    assert row.n == 50 and sum(row.counts) == row.n_links
