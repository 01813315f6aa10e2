"""A stored index of vectors by cells, with product codes of what is left after a cell's centre.

The index is a table of blocks, partitioned by cell, beside a small table of models: centres, code words, and how many
cells a query has to probe. A search sends each query to its cells and reads the partitions of those cells only; an append
assigns new vectors to the centres as they are; a rebuild learns all anew as a next version, which readers see once its
model is there. Centres and words are learnt on the driver from a bounded sample; every vector is indexed.

Probes and the margin of rough scores come from audits: true neighbours of about MEASURED vectors, by exact search, say
how many cells hold RECALL of them, and how far below the K-th best rough score theirs lie. So both end after one pass.
"""

import math
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from melodex.sources.scratch import scratch, stored

from .search import BLOCK, BROADCAST_BYTES, CANDIDATES, PLACES, QUERY_BLOCK, _pack, best_of, first_of, raise_floor, ranked, scored, topk
from .search import _met as _each_met

# Bounds of cells and probes; parts and bits of a product code.
MOST_CELLS, PROBES = 512, 64
PARTS, BITS = 8, 8
#: Vectors that cells and code words are learnt from, about, and rounds of learning.
SAMPLE, ROUNDS = 16_384, 8
#: Pairs of a query and a cell, and candidates, that are in memory at a time; vectors of small cells that are one block then.
PROBED, SCORED, JOINED = 8192, 16_384, 1024
#: Share of true neighbours that audits ask for, vectors whose neighbours they take, and neighbours of each.
RECALL, MEASURED, AUDITED_K = 0.97, 64, 10
#: Mean squared distance from the centres, over that at the build, from which an index is built anew.
DRIFT = 1.5

_BLOCKS = "cell int, block string, n long, far double, reach double, ids array<long>, vecs binary, codes binary"
_MODELS = "version int, name string, place int, vec array<double>"


def _spin(key: str, seed: int):
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def sample(catalogue: DataFrame, n: int, seed: int) -> np.ndarray:
    """About SAMPLE vectors, chosen by a hash of their ids."""
    rows = catalogue.where("vec is not null").where(_spin("song_id", seed) <= SAMPLE / max(1, n)).orderBy("song_id").select("vec").limit(2 * SAMPLE).toPandas()
    return np.stack([np.asarray(v, dtype=float) for v in rows["vec"]]) if len(rows) else np.zeros((0, 1))


def nearest(x: np.ndarray, centres: np.ndarray, k: int = 1) -> np.ndarray:
    """The k nearest centres of each row, in any order."""
    far = (centres**2).sum(axis=1) - 2 * (x @ centres.T)
    return far.argmin(axis=1)[:, None] if k == 1 else np.argpartition(far, k - 1, axis=1)[:, :k]


def learn_centres(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means; centres that lose all their rows stay where they were."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        of = nearest(x, centres)[:, 0]
        sums, n = np.zeros_like(centres), np.bincount(of, minlength=len(centres))
        np.add.at(sums, of, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _rows(vecs) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in vecs])


def _runs(cells: np.ndarray, most: int) -> Iterator[slice]:
    """Stretches of one cell, of ``most`` rows at most."""
    for part in np.split(np.arange(len(cells)), np.flatnonzero(np.diff(cells)) + 1):
        for at in range(0, len(part), most):
            yield slice(part[at], part[min(at + most, len(part)) - 1] + 1)


class Model(NamedTuple):
    """What an index needs to know: centres, code words by part, cells probed, margin of rough scores for a query of length
    one, mean squared distance at the build, and how vectors are kept."""

    version: int
    centres: np.ndarray
    words: list[np.ndarray]
    probes: int
    margin: float
    far: float
    kind: str

    def codes(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """A byte for each part of what is left of the rows after their centres."""
        left = x - self.centres[cells]
        return np.stack([nearest(p, w)[:, 0] for p, w in zip(np.split(left, len(self.words), axis=1), self.words)], axis=1).astype(np.uint8)

    def rebuilt(self, codes: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Rows as their centres and code words say them."""
        return self.centres[cells] + np.concatenate([w[codes[:, p]] for p, w in enumerate(self.words)], axis=1)

    def rough(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Scores of coded rows of a cell: the centre's, and what tables of the query and the code words add."""
        out = np.repeat((q @ self.centres[cell])[:, None], len(codes), axis=1)
        for p, (part, w) in enumerate(zip(np.split(q, len(self.words), axis=1), self.words)):
            out += (part @ w.T)[:, codes[:, p]]
        return out


class NoVectors(ValueError):
    """There is nothing to index."""


class CellIndex:
    """An index under a path. Searches give query_id, rank, song_id and score as ``topk`` does, within the probed cells:
    null vectors are no queries and no results, ties go by smaller song_id, repeated rows count each time."""

    def __init__(self, spark: SparkSession, path: str, model: Model):
        self.spark, self.path, self.model = spark, path, model

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "CellIndex":
        """The newest version under a path."""
        models = spark.read.schema(_MODELS).parquet(f"{path}/models")
        version = models.agg(F.max("version")).first()[0]
        rows = models.where(F.col("version") == version).orderBy("name", "place").collect()  # as many as centres and words
        named = lambda name: [np.array(r.vec) for r in rows if r.name == name]
        probes, margin, far, parts, single = named("about")[0]
        words = named("word")
        each = len(words) // max(1, int(parts))
        return cls(spark, path, Model(version, np.stack(named("centre")), [np.stack(words[p * each : (p + 1) * each]) for p in range(int(parts))], int(probes), margin, far, "<f4" if single else "<f8"))

    @classmethod
    def build(cls, catalogue: DataFrame, path: str, cells: int | None = None, probes: int | None = None, parts: int = PARTS, bits: int = BITS, codes: bool = True, seed: int = 1, version: int = 0, keep: bool = True, audited: bool = True) -> "CellIndex":
        """Index ``catalogue`` (song_id, vec of one length) under a path; an error without a vector.

        Cells: the root of the number of vectors, MOST_CELLS at most, unless given. Probes: PROBES, or more if the audit
        asks for more, unless given. ``parts`` is halved until it divides the length; without ``codes`` there are no rough
        scores to search by. An index that isn't to ``keep`` can't be opened again; one that isn't ``audited`` is for searches
        of the whole.
        """
        spark = catalogue.sparkSession
        rows = catalogue.where("vec is not null").select(F.col("song_id").cast("long").alias("song_id"), "vec")
        n = rows.count()
        x = sample(rows, n, seed)
        if not len(x):
            raise NoVectors("an index needs a vector at least")
        centres = learn_centres(x, cells or max(2, min(math.isqrt(n), MOST_CELLS)), seed)
        while x.shape[1] % parts:
            parts //= 2
        left = x - centres[nearest(x, centres)[:, 0]]
        words = [learn_centres(part, 1 << bits, seed) for part in np.split(left, parts, axis=1)] if codes else []
        single = rows.schema["vec"].dataType.elementType.simpleString() == "float"
        index = cls(spark, path, Model(version, centres, words, 0, 0.0, 0.0, "<f4" if single else "<f8"))
        index._add(rows)
        index.model = index.model._replace(probes=min(probes or PROBES, len(centres)))
        if audited and (probes is None and len(centres) > PROBES or codes):
            index._audit(rows, n, seed, probes is None and len(centres) > PROBES)
        if keep:
            index.model = index.model._replace(far=float(index.statistics().agg(F.sum("far") / F.sum("n")).first()[0]))
            index._publish()
        return index

    def _publish(self) -> None:
        """Write the model; from then on readers find this version."""
        m = self.model
        about = [float(m.probes), m.margin, m.far, float(len(m.words)), float(m.kind == "<f4")]
        rows = [(m.version, "about", 0, about)] + [(m.version, "centre", i, c.tolist()) for i, c in enumerate(m.centres)]
        rows += [(m.version, "word", p * len(w) + i, v.tolist()) for p, w in enumerate(m.words) for i, v in enumerate(w)]
        self.spark.createDataFrame(rows, _MODELS).coalesce(1).write.mode("append").parquet(f"{self.path}/models")

    def _add(self, rows: DataFrame) -> None:
        """Assign rows to the centres and write them as blocks of their cells; a cell of many rows is many tasks' work."""
        model, kind = self.model, self.model.kind

        def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(cell=nearest(_rows(b["vec"]), model.centres)[:, 0].astype("int32") if len(b) else [])

        def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                cells = b["cell"].to_numpy()
                for at in _runs(cells, BLOCK) if len(b) else ():
                    x, cell = _rows(b["vec"].iloc[at]), int(cells[at.start])
                    codes = model.codes(x, cells[at]).tobytes() if model.words else None
                    far = ((x - model.centres[cell]) ** 2).sum(axis=1)
                    yield pd.DataFrame({"cell": [cell], "block": [uuid.uuid4().hex], "n": [len(x)], "far": [float(far.sum())], "reach": [float(np.sqrt(far.max()))], "ids": [b["song_id"].iloc[at].to_numpy()], "vecs": [x.astype(kind).tobytes()], "codes": [codes]})

        vec = "array<float>" if kind == "<f4" else "array<double>"
        told = rows.select("song_id", F.col("vec").cast(vec).alias("vec")).mapInPandas(assigned, f"song_id long, vec {vec}, cell int")
        dealt = told.hint("rebalance", "cell").sortWithinPartitions("cell", "song_id")
        dealt.mapInPandas(packed, _BLOCKS).write.mode("append").partitionBy("cell").parquet(f"{self.path}/rows-{model.version}")

    def blocks(self, cells: list[int] | None = None) -> DataFrame:
        """The blocks of some cells, or of all; only those cells' partitions are read."""
        rows = self.spark.read.schema(_BLOCKS).option("basePath", f"{self.path}/rows-{self.model.version}").parquet(f"{self.path}/rows-{self.model.version}")
        return rows if cells is None or len(cells) == len(self.model.centres) else rows.where(F.col("cell").isin(cells))

    def statistics(self) -> DataFrame:
        """cell, n and far (sum of squared distances from the centre) of each cell that holds vectors, added up over blocks."""
        return self.blocks().groupBy("cell").agg(F.sum("n").alias("n"), F.sum("far").alias("far"))

    def vectors(self) -> DataFrame:
        """song_id and vec of all that is indexed."""
        kind, vec = self.model.kind, "array<float>" if self.model.kind == "<f4" else "array<double>"

        def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for ids, m in zip(b["ids"], b["vecs"]):
                    yield pd.DataFrame({"song_id": ids, "vec": list(np.frombuffer(m, kind).reshape(len(ids), -1))})

        return self.blocks().select("ids", "vecs").mapInPandas(unpacked, f"song_id long, vec {vec}")

    def append(self, rows: DataFrame) -> None:
        """Add vectors (song_id, vec) to the centres as they are. Ids that are there already, repeats of an id (the vector
        with the least hash stays) and null vectors are left out, so that adding rows again changes nothing."""
        fresh = rows.where("vec is not null").groupBy(F.col("song_id").cast("long").alias("song_id")).agg(F.min_by("vec", F.xxhash64("vec")).alias("vec"))
        known = self.blocks().select(F.explode("ids").alias("song_id"))
        self._add(fresh.join(known.hint("merge"), "song_id", "left_anti"))

    def drift(self) -> float:
        """Mean squared distance from the centres now, over that at the build."""
        now = self.statistics().agg(F.sum("far") / F.sum("n")).first()[0] or 0.0
        return now / self.model.far if self.model.far else 1.0 + now

    def rebuild(self, seed: int = 1) -> "CellIndex":
        """All vectors indexed anew as the next version; what reads the old one goes on reading it."""
        parts = len(self.model.words)
        return CellIndex.build(self.vectors(), self.path, parts=parts or PARTS, codes=bool(parts), seed=seed, version=self.model.version + 1)

    def _packs(self, queries: DataFrame, probes: int, reach: np.ndarray | None = None) -> DataFrame:
        """Queries (query_id, vec, least) at each cell that they probe, in packs of a cell; with the ``reach`` of cells, how
        far their vectors are from their centres at most, at each cell that may hold a score of ``least``."""
        model = self.model
        few = max(1, PROBED // len(model.centres))

        def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                # A query is repeated for each of its cells: a few are at a time, or a batch would be some hundred times its size.
                for first in range(0, len(whole), few):
                    b = whole.iloc[first : first + few]
                    q = _rows(b["vec"])
                    if reach is None:
                        near = nearest(q, model.centres, probes)
                        at, cell = np.repeat(np.arange(len(b)), near.shape[1]), near.ravel()
                    else:  # q x = q c + q (x - c), and the latter is |q| |x - c| at most
                        top = q @ model.centres.T + np.linalg.norm(q, axis=1)[:, None] * reach
                        at, cell = np.nonzero(~(top * (1 + 1e-9 * np.sign(top)) + 1e-9 < b["least"].to_numpy()[:, None]))
                    yield pd.DataFrame({"query_id": b["query_id"].to_numpy()[at], "vec": b["vec"].to_numpy()[at], "least": b["least"].to_numpy()[at], "cell": cell.astype("int32")})

        def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                cells = b["cell"].to_numpy()
                for at in _runs(cells, QUERY_BLOCK) if len(b) else ():
                    part = b.iloc[at]
                    yield pd.DataFrame({"cell": [int(cells[at.start])], "pack": [uuid.uuid4().hex], "q_ids": [part["query_id"].to_numpy()], "least": [part["least"].to_numpy()], "q": [_rows(part["vec"]).tobytes()]})

        told = queries.where("vec is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("vec").cast("array<double>").alias("vec"), "least")
        dealt = told.mapInPandas(probed, "query_id long, vec array<double>, least double, cell int").hint("rebalance", "cell").sortWithinPartitions("cell")
        return stored(dealt.mapInPandas(packed, "cell int, pack string, q_ids array<long>, least array<double>, q binary"))

    def _met(self, packs: DataFrame, *columns: str) -> DataFrame:
        """Packs with the blocks of their cells, by a broadcast behind a check of bytes or a shuffle."""
        sizes = packs.groupBy("cell").agg(F.sum(F.octet_length("q") + 64).alias("size")).collect()  # no more than there are cells
        few = sum(r["size"] for r in sizes) <= BROADCAST_BYTES
        return self.blocks([r.cell for r in sizes]).select("cell", *columns).join(F.broadcast(packs) if few else packs.hint("merge"), "cell")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, skip_self: bool = True, whole: bool = False) -> DataFrame:
        """The K best of each query in its cells, by exact scores; or with ``whole`` the K best of all: what the probed cells
        hold says which others may hold better ones, and those are read too."""
        packs = self._packs(queries.withColumn("least", F.lit(0.0)), min(probes or self.model.probes, len(self.model.centres)))
        if whole and min(probes or self.model.probes, len(self.model.centres)) < len(self.model.centres):
            first = self.search(queries, k, probes, skip_self).groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
            held = queries.join(stored(first).hint("merge"), "query_id", "left")
            reach = np.full(len(self.model.centres), -np.inf)  # cells that hold nothing
            for r in self.blocks().groupBy("cell").agg(F.max(F.coalesce("reach", F.lit(float("inf")))).alias("reach")).collect():
                reach[r.cell] = r.reach
            packs = self._packs(held.select("query_id", "vec", F.when(F.col("n") == k, F.col("kth")).otherwise(float("-inf")).alias("least")), 0, reach)

        return self._scored(packs, k, skip_self)

    def _scored(self, packs: DataFrame, k: int, skip_self: bool, blocks: list[str] | None = None) -> DataFrame:
        """The K best of each query in the cells of its packs, by exact scores; of some blocks only, if they are given."""
        kind = self.model.kind

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for ids, m, q_ids, q in zip(b["ids"], b["vecs"], b["q_ids"], b["q"]):
                    x = np.frombuffer(m, kind).reshape(len(ids), -1).astype(float)
                    s = np.round(np.frombuffer(q, "<f8").reshape(len(q_ids), -1) @ x.T, PLACES)
                    yield _best(s, np.asarray(q_ids), np.asarray(ids), k, skip_self)

        met = self._met(packs, "block", "ids", "vecs")
        met = met if blocks is None else met.where(F.col("block").isin(blocks))
        return ranked(met.mapInPandas(best, "query_id long, song_id long, score double"), k)

    def search_codes(self, queries: DataFrame, k: int, pool: int | None = None, probes: int | None = None, skip_self: bool = True, whole: bool = False) -> DataFrame:
        """The K best of each query in its cells, by exact scores of those whose rough scores promise it.

        Codes alone say the K-th (AUDITED_K-th at least) best rough score of a query. What lies at most the audited margin
        below it (or, with ``pool``, among the ``pool`` times K best) is a candidate; only blocks with candidates bring
        their vectors. With ``whole``, the K best of all: every row of every cell is a candidate unless its rough score and
        how far its codes are from it rule it out.
        """
        model, kind = self.model, self.model.kind
        if not model.words:
            raise ValueError("the index was built without codes")
        if whole:
            return self._whole(queries, k, skip_self)
        probes = min(probes or model.probes, len(model.centres))
        depth, margin = (max(k, AUDITED_K), model.margin) if pool is None else (k * pool, 0.0)

        def rough(b: pd.DataFrame):
            for cell, block, ids, c, pack, q_ids, least, q in zip(b["cell"], b["block"], b["ids"], b["codes"], b["pack"], b["q_ids"], b["least"], b["q"]):
                q, q_ids, ids = np.frombuffer(q, "<f8").reshape(len(q_ids), -1), np.asarray(q_ids), np.asarray(ids)
                s = np.round(model.rough(q, cell, np.frombuffer(c, np.uint8).reshape(len(ids), -1)), PLACES)
                if skip_self:
                    s[q_ids[:, None] == ids] = -np.inf
                yield cell, block, pack, q_ids, ids, np.asarray(least), s

        def promising(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for _, _, _, q_ids, ids, _, s in rough(b):
                    yield _best(s, q_ids, ids, depth, False)

        def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for cell, block, pack, _, _, least, s in rough(b):
                    at, place = np.nonzero((s >= least[:, None]) & np.isfinite(s))
                    if len(at):
                        yield pd.DataFrame({"cell": [cell], "block": [block], "pack": [pack], "at": [at.astype("int32")], "place": [place.astype("int32")]})

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for ids, m, q_ids, q, at, place in zip(b["ids"], b["vecs"], b["q_ids"], b["q"], b["at"], b["place"]):
                    x, q = np.frombuffer(m, kind).reshape(len(ids), -1).astype(float), np.frombuffer(q, "<f8").reshape(len(q_ids), -1)
                    s = np.full((len(q), len(x)), -np.inf)
                    for i in range(0, len(at), SCORED):
                        r, j = at[i : i + SCORED], place[i : i + SCORED]
                        s[r, j] = np.round(np.einsum("ij,ij->i", q[r], x[j]), PLACES)
                    yield _best(s, np.asarray(q_ids), np.asarray(ids), k, False)

        asked = queries.where("vec is not null")
        met = self._met(self._packs(asked.withColumn("least", F.lit(0.0)), probes), "block", "ids", "codes")
        firsts = ranked(met.mapInPandas(promising, "query_id long, song_id long, score double"), depth)
        norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda t, x: t + x.cast("double") * x))
        least = firsts.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
        # Queries whose cells hold fewer than that take all there is.
        held = asked.join(stored(least).hint("merge"), "query_id").withColumn("least", F.when(F.col("n") < depth, float("-inf")).otherwise(F.col("kth") - margin * norm))
        packs = self._packs(held, probes)
        found = stored(self._met(packs, "block", "ids", "codes").mapInPandas(candidates, "cell int, block string, pack string, at array<int>, place array<int>"))
        cells = [r.cell for r in found.select("cell").distinct().collect()]
        pairs = self.blocks(cells).select("cell", "block", "ids", "vecs").join(_light(found, "at"), ["cell", "block"])
        pairs = pairs.join(_light(packs.drop("least"), "q"), ["cell", "pack"])
        return ranked(pairs.mapInPandas(best, "query_id long, song_id long, score double"), k)

    def _whole(self, queries: DataFrame, k: int, skip_self: bool) -> DataFrame:
        """The K best of each query among all rows. A block of its nearest cell says what a query's K-th score is at least; then
        all blocks, dealt over tasks, meet all queries, without a row for each query and cell. q x = q y + q (x - y), where y
        is what codes say of x, and the latter is |q| |x - y| at most: only what may reach the K-th score by that is scored.
        Where codes rule out little, products in single precision do, as in ``topk``."""
        model, kind = self.model, self.model.kind

        def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                first, held = 0, 0
                for i, n in enumerate([*b["n"], JOINED + 1]):  # small cells in one block, or there would be a product for each
                    if held + n > JOINED and i > first:
                        part = b.iloc[first:i]
                        yield pd.DataFrame({"block": [part["block"].iloc[0]], "ids": [np.concatenate(list(part["ids"]))], "cells": [np.repeat(part["cell"].to_numpy(), part["n"].to_numpy())], "vecs": [b"".join(part["vecs"])], "codes": [b"".join(part["codes"])]})
                        first, held = i, 0
                    held += n

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            floors: dict[tuple[bytes, int], np.ndarray] = {}  # by block of queries: the least that still counts
            seen = None
            for b in batches:
                for q_ids, takes, qm, block, ids, cells, m, c in zip(b["q_ids"], b["q_takes"], b["q"], b["block"], b["ids"], b["cells"], b["vecs"], b["codes"]):
                    q_ids, takes, ids = np.asarray(q_ids), np.asarray(takes), np.asarray(ids)
                    q = np.frombuffer(qm, "<f8").reshape(len(q_ids), -1)
                    floor, q = floors.setdefault((q_ids.tobytes(), hash(qm)), q[:, 0].copy()), q[:, 1:]
                    if block != seen:
                        x = np.frombuffer(m, kind).reshape(len(ids), -1).astype(float)
                        y = model.rebuilt(np.frombuffer(c, np.uint8).reshape(len(ids), -1), np.asarray(cells))
                        y, seen = np.column_stack([y, np.linalg.norm(x - y, axis=1)]), block
                    got = _allowed(q, x, y, q_ids, ids, takes, floor, skip_self) or first_of(q, x, q_ids, ids, takes, floor, skip_self)
                    if got is None:
                        s = np.round(q @ x.T, PLACES)
                        if skip_self:
                            s[q_ids[:, None] == ids] = -np.inf
                        r, j = best_of(s, takes, ids)
                        got = r, j, s[r, j]
                    r, j, score = got
                    raise_floor(floor, takes, r, score)
                    yield pd.DataFrame({"query_id": q_ids[r], "song_id": ids[j], "score": score})

        asked = queries.where("vec is not null")
        cells = self.blocks().groupBy("cell").agg(F.max_by("block", "n").alias("block"), F.sum("n").alias("n")).collect()
        near = self._scored(self._packs(asked.withColumn("least", F.lit(0.0)), 1), k, skip_self, [r.block for r in cells]).groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
        held = asked.join(stored(near).hint("merge"), "query_id", "left")
        least = F.when(F.col("n") == k, F.col("kth")).otherwise(float("-inf"))  # goes before the vector
        rows = held.select(F.col("query_id").cast("long").alias("id"), F.concat(F.array(least), F.col("vec").cast("array<double>")).alias("vec"), F.lit(k).cast("long").alias("take"))
        tasks = max(asked.sparkSession.sparkContext.defaultParallelism, -(-sum(r.n for r in cells) // BLOCK))
        dealt = self.blocks().select("cell", "block", "n", "ids", "vecs", "codes").repartition(tasks)  # a cell of many alike is one file
        blocks = dealt.mapInPandas(joined, "block string, ids array<long>, cells array<int>, vecs binary, codes binary")
        met = _each_met(_pack(rows, QUERY_BLOCK, np.ndarray.tobytes), blocks)
        return ranked(met.mapInPandas(best, "query_id long, song_id long, score double"), k)

    def _audit(self, rows: DataFrame, n: int, seed: int, probing: bool) -> None:
        """Set probes (if ``probing``) and the margin by the true neighbours of about MEASURED indexed vectors."""
        m = self.model
        asked = stored(rows.where(_spin("song_id", seed + 1) <= MEASURED / max(1, n)).orderBy("song_id").limit(2 * MEASURED).select(F.col("song_id").alias("query_id"), "vec"))
        queries = {r.query_id: np.array(r.vec, dtype=float) for r in asked.collect()}
        near = topk(asked, rows, AUDITED_K).select("query_id", "song_id").collect() if probing else []
        if near:
            got = self._collected(rows, {r.song_id for r in near})
            ranks = []
            for r in near:
                far = (m.centres**2).sum(axis=1) - 2 * (m.centres @ queries[r.query_id])
                ranks.append(int((far < far[nearest(got[r.song_id][None], m.centres)[0, 0]]).sum()) + 1)
            m = self.model = m._replace(probes=min(len(m.centres), max(m.probes, sorted(ranks)[math.ceil(RECALL * len(ranks)) - 1])))
        if m.words and queries:
            found = self.search(asked, AUDITED_K).select("query_id", "song_id").collect()
            got = self._collected(rows, {r.song_id for r in found})
            pool = self.search_rough(asked, AUDITED_K).groupBy("query_id").agg(F.min("score").alias("kth")).collect()
            kth = {r.query_id: r.kth for r in pool}
            gaps = [0.0]
            for r in found:
                q, cell = queries[r.query_id][None], nearest(got[r.song_id][None], m.centres)[:, 0]
                score = m.rough(q, int(cell[0]), m.codes(got[r.song_id][None], cell))[0, 0]
                gaps.append((kth[r.query_id] - score) / max(1e-300, float(np.linalg.norm(q))))
            self.model = m._replace(margin=max(0.0, float(sorted(gaps)[math.ceil(RECALL * len(gaps)) - 1])) + 1e-9)

    def search_rough(self, queries: DataFrame, k: int) -> DataFrame:
        """The K best of each query in its cells, by rough scores only."""
        model = self.model
        packs = self._packs(queries.withColumn("least", F.lit(0.0)), model.probes)

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for cell, ids, c, q_ids, q in zip(b["cell"], b["ids"], b["codes"], b["q_ids"], b["q"]):
                    s = np.round(model.rough(np.frombuffer(q, "<f8").reshape(len(q_ids), -1), cell, np.frombuffer(c, np.uint8).reshape(len(ids), -1)), PLACES)
                    yield _best(s, np.asarray(q_ids), np.asarray(ids), k, True)

        return ranked(self._met(packs, "ids", "codes").mapInPandas(best, "query_id long, song_id long, score double"), k)

    def _collected(self, rows: DataFrame, ids: set[int]) -> dict[int, np.ndarray]:
        """Vectors of the audited neighbours, of which there are few."""
        wanted = self.spark.createDataFrame([(i,) for i in ids], "song_id long")
        got = rows.join(F.broadcast(wanted), "song_id", "left_semi").groupBy("song_id").agg(F.min_by("vec", F.xxhash64("vec")).alias("vec"))
        return {r.song_id: np.array(r.vec, dtype=float) for r in got.collect()}


def _allowed(q: np.ndarray, x: np.ndarray, y: np.ndarray, q_ids: np.ndarray, ids: np.ndarray, takes: np.ndarray, floor: np.ndarray, skip_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Row, column and score of each row's ``takes`` largest scores that reach its floor, of those that codes allow to reach
    it. ``y`` is what codes say of ``x``, and a last column of how far that is from it. None where codes say too little."""
    q1 = np.column_stack([q, np.linalg.norm(q, axis=1)])
    with np.errstate(over="ignore", invalid="ignore"):
        most = q1.astype("f4") @ y.astype("f4").T
        room = (q1.shape[1] + 4) * 2.0**-23 * np.sqrt((q1**2).sum(axis=1) * (y**2).sum(axis=1).max(initial=0)) + 1e-9
    if not np.isfinite(most).all() or not (room < 1e30).all():
        return None
    may = most >= np.nextafter(np.maximum(floor - room, -3e38).astype("f4"), np.float32(-np.inf))[:, None]
    if np.count_nonzero(may) > CANDIDATES:
        return None
    row, col = np.nonzero(may)
    if skip_self:
        other = q_ids[row] != ids[col]
        row, col = row[other], col[other]
    return scored(q, x, row, col, ids, takes)


def _light(rows: DataFrame, column: str) -> DataFrame:
    """Rows of a written table to be joined: broadcast if their binary or array ``column`` has few bytes in all."""
    size = F.octet_length(column) if dict(rows.dtypes)[column] == "binary" else 8 * F.size(column)
    few = (rows.agg(F.sum(size + 64)).first()[0] or 0) <= BROADCAST_BYTES
    return F.broadcast(rows) if few else rows.hint("merge")


def _best(s: np.ndarray, q_ids: np.ndarray, ids: np.ndarray, k: int, skip_self: bool) -> pd.DataFrame:
    if skip_self:
        s[q_ids[:, None] == ids] = -np.inf
    r, j = best_of(s, np.full(len(q_ids), k), ids)
    return pd.DataFrame({"query_id": q_ids[r], "song_id": ids[j], "score": s[r, j]})


def temporary(catalogue: DataFrame, **given) -> CellIndex:
    """An index in a new scratch folder, for one call."""
    return CellIndex.build(catalogue, scratch(catalogue.sparkSession), keep=False, **given)
