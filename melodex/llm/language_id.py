"""Language identification by a byte convolutional network written in numpy.

Bytes are embedded, filtered at several widths, max-pooled over a window of fixed length and classified by a softmax.
The network learns on the driver from a bounded sample of labelled windows; whole texts are then cut into such windows
inside Arrow functions and the windows' log-probabilities are averaged, weighted by their length. Filters of a linear
embedding are sums of one table look-up for each place, so prediction needs no matrix products before the softmax.
"""

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import learn_fold

#: Bytes of a window; widths and filters of each; size of the embedding.
LENGTH, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 8
#: Documents for each language and windows for each document that training takes at most (about), epochs, seed.
SAMPLE_DOCS, SAMPLE_WINDOWS, EPOCHS, SEED = 500, 3, 14, 7
#: Steps that training takes at least, however few the samples.
STEPS = 500
#: Windows predicted at a time; languages at most.
BLOCK, LANGUAGES = 256, 1000

_maybe = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Is there a letter? Numerals such as ½, ² or Ⅷ are none."""
    return any(m[0].isalpha() for m in _maybe.finditer(text))


@dataclass
class Net:
    """Weights; ``filters[k]`` has a width's (width, EMBED, FILTERS) weights."""

    langs: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> list[np.ndarray]:
        """For each width, a (width, 256, FILTERS) table: what a byte at a place adds to the filters."""
        return [np.ascontiguousarray(np.einsum("be,wef->wbf", self.embed, f), dtype=np.float32) for f in self.filters]

    def pooled(self, x: np.ndarray, tables: list[np.ndarray], where: bool = False):
        """Max over places of each filter for windows of bytes (n, LENGTH); with ``where`` also the places."""
        top, at = [], []
        for t in tables:
            n = x.shape[1] - len(t) + 1
            s = t[0][x[:, :n]]
            for j in range(1, len(t)):
                s += t[j][x[:, j : j + n]]
            if where:
                at.append(s.argmax(axis=1))
                top.append(np.take_along_axis(s, at[-1][:, None], axis=1)[:, 0])
            else:
                top.append(s.max(axis=1))
        return np.concatenate(top, axis=1) + self.bias, at

    def log_probs(self, x: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        h = np.maximum(self.pooled(x, tables)[0], 0)
        z = h @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def windows(data: bytes, length: int = LENGTH) -> np.ndarray:
    """All bytes of a text in windows, the last one padded with zeros."""
    n = max(1, -(-len(data) // length))
    out = np.zeros(n * length, dtype=np.uint8)
    out[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return out.reshape(n, length)


def gradients(net: Net, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Gradients of the weighted cross-entropy by the embedding, each width's filters, the biases and the output layer."""
    pre, places = net.pooled(x, net.tables(), where=True)
    h = np.maximum(pre, 0)
    z = h @ net.out + net.out_bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    p *= weight[:, None]
    d = (p @ net.out.T) * (pre > 0)
    grads = [np.zeros_like(net.embed), *[np.zeros_like(f) for f in net.filters], d.sum(axis=0), h.T @ p, p.sum(axis=0)]
    for k, w in enumerate(WIDTHS):
        dk = d[:, k * FILTERS : (k + 1) * FILTERS]
        for j in range(w):
            b = np.take_along_axis(x, places[k] + j, axis=1)  # the byte under each filter's maximum
            grads[1 + k][j] = np.einsum("nfe,nf->ef", net.embed[b], dk)
            np.add.at(grads[0], b.ravel(), (dk[:, :, None] * net.filters[k][j].T).reshape(-1, EMBED))
    return grads


def train(samples: list[tuple[str, bytes]], epochs: int = EPOCHS, seed: int = SEED) -> Net:
    """Fit a network to (language, text) samples by Adam on the cross-entropy; samples of a language weigh alike."""
    rng = np.random.default_rng(seed)
    langs = sorted({s[0] for s in samples})
    place = {x: i for i, x in enumerate(langs)}
    parts = [(place[a], windows(b)) for a, b in samples]
    x = np.concatenate([p for _, p in parts])
    y = np.concatenate([np.full(len(p), k) for k, p in parts])
    weight = (len(y) / len(langs) / np.bincount(y, minlength=len(langs)))[y]
    total = len(WIDTHS) * FILTERS
    net = Net(langs, rng.normal(0, 0.5, (256, EMBED)), [rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)) for w in WIDTHS], np.zeros(total), rng.normal(0, 0.1, (total, len(langs))), np.zeros(len(langs)))
    params = [net.embed, *net.filters, net.bias, net.out, net.out_bias]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(max(epochs, -(-STEPS // -(-len(y) // 128)))):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 128):
            pick = order[at : at + 128]
            bx, by, bw = x[pick], y[pick], weight[pick]
            grads = gradients(net, bx, by, bw / bw.sum())
            step += 1
            for q, g, a, c in zip(params, grads, m, v):
                a += 0.1 * (g - a)
                c += 0.001 * (g * g - c)
                q -= 0.01 * (a / (1 - 0.9**step)) / (np.sqrt(c / (1 - 0.999**step)) + 1e-8)
    return net


def predict(texts: list[str | None], net: Net) -> tuple[list[str], list[float]]:
    """Language and score of whole texts; ``und`` and 0 for null or without a letter."""
    tables = net.tables()
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    owners, stack, held = [], [], 0
    sums: dict[int, np.ndarray] = {}
    sizes: dict[int, float] = {}

    def flush() -> None:
        if not stack:
            return
        x = np.concatenate(stack)
        own = np.repeat([o for o, _ in owners], [n for _, n in owners])
        for at in range(0, len(x), BLOCK):
            part = x[at : at + BLOCK]
            filled = (part != 0).sum(axis=1)[:, None]
            for o, row, n in zip(own[at : at + BLOCK].tolist(), net.log_probs(part, tables) * filled, filled[:, 0].tolist()):
                sums[o] = sums.get(o, 0) + row
                sizes[o] = sizes.get(o, 0) + n
        owners.clear()
        stack.clear()

    for i, t in enumerate(texts):
        if t and has_letter(t):
            w = windows(t.encode())
            owners.append((i, len(w)))
            stack.append(w)
            held += len(w)
            if held >= 16 * BLOCK:
                flush()
                held = 0
    flush()
    for i, s in sums.items():
        p = np.exp(s / max(sizes[i], 1))
        k = int(p.argmax())
        lang[i], score[i] = net.langs[k], float(p[k] / p.sum())
    return lang, score


def sample(docs: DataFrame, per_lang: int = SAMPLE_DOCS, each: int = SAMPLE_WINDOWS) -> list[tuple[str, bytes]]:
    """About ``per_lang`` labelled texts of each language, chosen by a hash of the id, and ``each`` of their windows."""
    learn = docs.where(learn_fold(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r.lang: r["count"] for r in docs.where(learn_fold(F.col("doc_id")) & F.col("lang").isNotNull()).groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not counts:
        return []
    share = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, per_lang / n)))])
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) < share[F.col("lang")] * float(1 << 30)
    start = lambda k: F.pmod(F.xxhash64("text", F.lit(k)), F.greatest(F.length("text") - LENGTH, F.lit(1))) + 1
    rows = learn.where(drawn).select("lang", F.array_distinct(F.array(*[F.substring(F.col("text"), start(k).cast("int"), F.lit(LENGTH)) for k in range(each)])).alias("parts"))
    rows = rows.limit(2 * per_lang * len(counts)).collect()
    found = [(r.lang, p.encode()[:LENGTH]) for r in rows for p in r.parts if has_letter(p)]
    return sorted(found)


def identify(docs: DataFrame, carry: bool = False, **sampling) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; with ``carry`` also ``doc``, a struct of the input row.

    Null texts and texts without a letter: ``und`` with score 0; so is every text when no labelled text is there to
    learn from. A null doc_id is neither learnt from nor held out. Ties: the first language by name. Repeated rows: a
    row each. No rows: none. Only doc_id, text and lang are read, unless carried; lang and doc_id choose what is learnt
    and are no inputs of a prediction.
    """
    found = sample(docs, **sampling)
    shared = docs.sparkSession.sparkContext.broadcast(train(found) if found else None)

    @F.pandas_udf("lang string, score double")
    def told(texts: pd.Series) -> pd.DataFrame:
        if shared.value is None:
            return pd.DataFrame({"lang": ["und"] * len(texts), "score": [0.0] * len(texts)})
        lang, score = predict(texts.tolist(), shared.value)
        return pd.DataFrame({"lang": lang, "score": score})

    fold = F.coalesce(~learn_fold(F.col("doc_id")), F.lit(False))
    doc = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] * carry
    return docs.select("doc_id", fold.alias("held_out"), *doc, told("text").alias("told")).select("doc_id", "held_out", F.col("told.lang").alias("lang_pred"), F.col("told.score").alias("score"), *["doc"] * carry)
