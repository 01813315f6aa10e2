"""Quality classifier by positive-unlabelled learning.

Trusted positives (documents labelled good) and unlabelled texts are described by byte shares and word statistics of
the whole text, in Arrow functions. A first classifier of positives against unlabelled gives the class prior: the least
ratio of the unlabelled to the positive rows above a threshold. A small network then minimises the non-negative
unbiased risk: prior * loss of positives as good, plus the loss of unlabelled as bad less prior * the loss of positives
as bad, held at zero or more. Training takes bounded samples on the driver; scoring reads every whole text.
"""

from dataclasses import dataclass
from math import log1p

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import learn_fold

#: Positives and unlabelled rows that training takes at most (about), hidden units, epochs, seed.
POSITIVES, UNLABELLED, HIDDEN, EPOCHS, SEED = 4000, 8000, 16, 60, 11
WORD_STATS = 12
SIZE = 256 + WORD_STATS

_ends = tuple(b".,;:!?")


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of the 256 bytes, and word statistics; zeros for null or empty texts."""
    out = np.zeros(SIZE, dtype=np.float32)
    if not text:
        return out
    data = text.encode()
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    out[:256] = np.sqrt(counts / len(data))
    words = data.split()
    lines = data.split(b"\n")
    n = max(1, len(words))
    letters = max(1, int(counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()))
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    out[256:] = (
        log1p(len(data)) / 10,
        log1p(len(words)) / 10,
        len(set(words)) / n,
        sum(map(len, words)) / n / 10,
        repeats / n,
        len(set(lines)) / len(lines),
        log1p(len(lines)) / 10,
        counts[65:91].sum() / letters,
        counts[48:58].sum() / len(data),
        (counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()) / len(data),
        sum(w.isupper() for w in words) / n,
        sum(w[-1] in _ends for w in words) / n,
    )
    return out


@dataclass
class Net:
    """A network of one hidden layer on scaled features; gives the log-odds of good."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    c: np.ndarray

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w + self.b) @ self.v + self.c[0]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(gp: np.ndarray, gu: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the unbiased risk from the scores of positives and unlabelled: of good as bad, and of bad as good,
    which can't be negative but whose estimate can."""
    as_bad = lambda g: -np.log(1 - g + 1e-9)
    return float(prior * np.mean(-np.log(gp + 1e-9))), float(np.mean(as_bad(gu)) - prior * np.mean(as_bad(gp)))


def risk_gradient(gp: np.ndarray, gu: np.ndarray, prior: float | None) -> np.ndarray:
    """Gradient of the risk by the log-odds of positives and unlabelled; without a prior, of the plain logistic losses."""
    # Of the logistic losses by the log-odds: as good g - 1, as bad g.
    if prior is None:
        return np.concatenate([(gp - 1) / len(gp), gu / len(gu)])
    if risk(gp, gu, prior)[1] >= 0:
        return np.concatenate([prior * (gp - 1) / len(gp) - prior * gp / len(gp), gu / len(gu)])
    return np.concatenate([prior * gp / len(gp), -gu / len(gu)])  # step back from the part that is negative


def _fit(p: np.ndarray, u: np.ndarray, prior: float | None, epochs: int, seed: int) -> Net:
    """Minimise the non-negative risk for a prior; without one, the plain loss of positives against unlabelled."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([p, u]).astype(np.float64)
    net = Net(both.mean(axis=0), both.std(axis=0) + 0.01, rng.normal(0, 0.05, (SIZE, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), np.zeros(1))
    params = [net.w, net.b, net.v, net.c]
    m, s, step = [np.zeros_like(q) for q in params], [np.zeros_like(q) for q in params], 0
    p, u = ((x - net.mean) / net.scale for x in (p, u))
    size = 256
    rounds = max(1, -(-max(len(p), len(u)) // size))
    for _ in range(epochs):
        a, b = (np.resize(rng.permutation(len(x)), rounds * size) for x in (p, u))
        for k in range(rounds):
            bp, bu = p[a[k * size : (k + 1) * size]], u[b[k * size : (k + 1) * size]]
            x = np.concatenate([bp, bu])
            h = np.tanh(x @ net.w + net.b)
            g = _sigmoid(h @ net.v + net.c[0])
            gp, gu = g[: len(bp)], g[len(bp) :]
            d = risk_gradient(gp, gu, prior)
            dh = np.outer(d, net.v) * (1 - h * h)
            grads = [x.T @ dh + 1e-4 * net.w, dh.sum(axis=0), h.T @ d, d.sum(keepdims=True)]
            step += 1
            for q, g, a1, a2 in zip(params, grads, m, s):
                a1 += 0.1 * (g - a1)
                a2 += 0.001 * (g * g - a2)
                q -= 0.003 * (a1 / (1 - 0.9**step)) / (np.sqrt(a2 / (1 - 0.999**step)) + 1e-8)
    return net


def estimate_prior(sp: np.ndarray, su: np.ndarray, least: float = 0.05) -> float:
    """Share of positives among the unlabelled: least ratio of the shares above a threshold that leaves enough of both."""
    cuts = np.quantile(sp, np.linspace(0.01, 1 - least, 200))
    up, uu = ((x[:, None] >= cuts).mean(axis=0) for x in (sp, su))
    return float(np.clip((uu / np.maximum(up, 1e-9)).min(), 0.05, 0.98))


def train(p: np.ndarray, u: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> tuple[Net, float]:
    """The network and the estimated prior, from feature rows of positives and unlabelled."""
    half = lambda x, k: x[k::2] if len(x) > 1 else x
    first = _fit(half(p, 0), half(u, 0), None, max(1, epochs // 4), seed)
    prior = estimate_prior(first.odds(half(p, 1)), first.odds(half(u, 1)))
    return _fit(p, u, prior, epochs, seed), prior


def _described(text):
    @F.pandas_udf("binary")
    def told(batch: pd.Series) -> pd.Series:
        return pd.Series([features(t).tobytes() for t in batch], dtype=object)

    return told(text)


def sample(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features of about so many positives and unlabelled rows of the learning fold, chosen by a hash of their ids."""
    spin = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30))
    learn = docs.where(learn_fold(F.col("doc_id"))).select("doc_id", "text")
    good = labels.where(learn_fold(F.col("doc_id")) & (F.col("quality") == 1)).select("doc_id").distinct()
    n_good, n_all = good.count(), learn.count()
    if not n_good or not n_all:
        return np.zeros((0, SIZE), np.float32), np.zeros((0, SIZE), np.float32)
    trusted = learn.join(good.where(spin < int(min(1, positives / n_good) * (1 << 30))).hint("merge"), "doc_id", "left_semi")
    web = learn.where(spin >= int((1 - min(1, unlabelled / n_all)) * (1 << 30)))
    take = lambda df, n: np.frombuffer(b"".join(bytes(r.f) for r in df.select(_described(F.col("text")).alias("f")).limit(2 * n).collect()), dtype=np.float32).reshape(-1, SIZE)
    return take(trusted, positives), take(web, unlabelled)


def score_documents(docs: DataFrame, labels: DataFrame, **sampling) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: likelier good) and predicted (1 if score >= 0.5) of every row.

    Null and empty texts are scored by their zero features. Without positives to learn from every score is 0.5. A null
    doc_id is neither learnt from nor held out; null labels teach nothing, a label repeated counts once. Repeated rows:
    a row each. No rows: none. Other columns are not read.
    """
    p, u = sample(docs, labels, **sampling)
    shared = docs.sparkSession.sparkContext.broadcast(train(p, u) if len(p) and len(u) else None)

    @F.pandas_udf("double")
    def scored(batch: pd.Series) -> pd.Series:
        if shared.value is None:
            return pd.Series([0.5] * len(batch))
        rows = np.stack([features(t) for t in batch]) if len(batch) else np.zeros((0, SIZE), np.float32)
        return pd.Series(_sigmoid(shared.value[0].odds(rows)))

    fold = F.coalesce(~learn_fold(F.col("doc_id")), F.lit(False))
    return docs.select("doc_id", fold.alias("held_out"), scored("text").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
