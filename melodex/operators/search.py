"""Top-K similarity search: exact in blocks, filtered before ranking, reranked after."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from melodex.sources.scratch import stored

#: Rows of a packed block of queries and of catalogue vectors; places after the point by which scores rank.
QUERY_BLOCK, BLOCK, PLACES = 512, 4096, 10
#: Candidates of a pair of blocks up to which they are scored alone.
CANDIDATES = 65_536
#: Bytes of packed queries up to which they are broadcast; results that one task is asked for of a part of the catalogue, about.
BROADCAST_BYTES = 64 << 20
ASKED_A_TASK = 1_000_000


def _pack(rows: DataFrame, size: int, coded) -> DataFrame:
    """Rows (id, vec, take) as blocks (ids, takes, matrix) of at most ``size``, within their partitions."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), size):
                part = b.iloc[at : at + size]
                x = np.stack([np.asarray(v, dtype="<f8") for v in part["vec"]])
                yield pd.DataFrame({"ids": [part["id"].to_numpy()], "takes": [part["take"].to_numpy()], "matrix": [coded(x)]})

    return rows.where("vec is not null").mapInPandas(packed, "ids array<long>, takes array<long>, matrix binary")


def _met(q: DataFrame, c: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Every block of queries with every block of the catalogue. The queries are broadcast behind a check of their bytes, and
    of the results that they ask for, which a task sorts; beyond it both sides are written, and their partitions meet, those
    of the queries as many as there are results and bytes for."""
    q = stored(q.select(F.col("ids").alias("q_ids"), F.col("takes").alias("q_takes"), F.col("matrix").alias("q")))
    size, asked = q.agg(F.sum(F.octet_length("q") + 16 * F.size("q_ids")), F.sum(F.aggregate("q_takes", F.lit(0).cast("long"), lambda s, t: s + t))).first()
    size, asked = size or 0, asked or 0
    if size <= most and asked <= ASKED_A_TASK:
        return c.crossJoin(F.broadcast(q))
    parts = max(-(-asked // ASKED_A_TASK), -(-size // (BROADCAST_BYTES // 4)))
    return stored(c).hint("shuffle_replicate_nl").crossJoin(q.repartition(parts))


def best_of(s: np.ndarray, takes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of each row's ``takes`` largest finite scores, ties by smaller id."""
    n, most = s.shape[1], int(takes.max(initial=0))
    if 0 < most < n:  # all scores from the last one that may be taken on, ties included
        last = np.partition(s, n - most, axis=1)[:, n - most][:, None]
        may = (s >= last) & np.isfinite(s)
        if np.count_nonzero(may) > 2 * most * len(s):  # many alike: of the ties those of the smaller ids, no more than are taken
            by = np.argsort(ids, kind="stable")
            tie = (s == last)[:, by]
            may[:, by] &= ~tie | (np.cumsum(tie, axis=1, dtype="int32") <= most)
        row, col = np.nonzero(may)
    elif not most:
        row, col = np.zeros(0, int), np.zeros(0, int)
    else:
        row, col = np.nonzero(np.isfinite(s))
    order = np.lexsort((ids[col], -s[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
    return row[place < takes[row]], col[place < takes[row]]


def first_of(q: np.ndarray, x: np.ndarray, q_ids: np.ndarray, ids: np.ndarray, takes: np.ndarray, floor: np.ndarray, skip_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Row, column and score of each row's ``takes`` largest scores that reach its floor, as ``best_of`` has them.

    Products in single precision say what can be among them, with room for their error; only that is scored in double. None
    where they don't say it: too many are alike, a score isn't finite, or a row takes all there is.
    """
    n, most = len(ids), int(takes.max(initial=0))
    with np.errstate(over="ignore", invalid="ignore"):
        s = q.astype("f4") @ x.astype("f4").T
        room = (q.shape[1] + 4) * 2.0**-23 * np.sqrt((q**2).sum(axis=1) * (x**2).sum(axis=1).max(initial=0)) + 1e-9
    if not 0 < most < n or not np.isfinite(s).all() or not (room < 1e30).all():
        return None
    if skip_self:
        own = np.flatnonzero(np.isin(ids, q_ids))
        at, place = np.nonzero(q_ids[:, None] == ids[own])
        s[at, own[place]] = -np.inf
    cut = floor - room
    if (bare := np.flatnonzero(~np.isfinite(floor))).size:
        cut[bare] = np.partition(s[bare], n - most, axis=1)[:, n - most] - 2 * room[bare]
    # Rounded down, so that comparing in single precision leaves nothing out; what was set to -inf is never taken.
    row, col = np.nonzero(s >= np.nextafter(np.maximum(cut, -3e38).astype("f4"), np.float32(-np.inf))[:, None])
    return None if len(row) > max(CANDIDATES, 4 * most * len(q)) else scored(q, x, row, col, ids, takes)


def scored(q: np.ndarray, x: np.ndarray, row: np.ndarray, col: np.ndarray, ids: np.ndarray, takes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some pairs of a row and a column, each row's ``takes`` largest scores, as ``best_of`` has them: row, column and score."""
    score = np.round(np.einsum("ij,ij->i", q[row], x[col]), PLACES)
    order = np.lexsort((ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row, side="left") < takes[row]
    return row[kept], col[kept], score[kept]


def raise_floor(floor: np.ndarray, takes: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
    """A row that found all it takes needs no score below its last one any more."""
    last = np.arange(len(row)) - np.searchsorted(row, row, side="left") == takes[row] - 1
    floor[row[last]] = np.maximum(floor[row[last]], score[last])


def product(qm: bytes, nq: int, m: bytes, n: int) -> np.ndarray:
    return np.frombuffer(qm, "<f8").reshape(nq, -1) @ np.frombuffer(m, "<f8").reshape(n, -1).T


def topk(queries: DataFrame, catalogue: DataFrame, k: int, skip_self: bool = True, excluded: DataFrame | None = None, coded=(np.ndarray.tobytes, np.ndarray.tobytes), scores=product) -> DataFrame:
    """query_id, rank, song_id, score: the K largest inner products of each query, ties by smaller song_id.

    ``queries`` (query_id, vec) meet ``catalogue`` (song_id, vec) block by block; each pair of blocks hands on its own
    best only. ``excluded`` holds different (query_id, song_id) pairs that can't be results; a query fetches as many more
    as it has of them. Null vectors are no queries and no results; queries with fewer than K candidates get those there
    are; an empty side gives no rows; repeated rows count each time. Vectors have one length. Other ways to code and
    score blocks (``coded`` for queries and catalogue, ``scores``) give other searches; -inf scores are no results.
    """
    asked = queries.select(F.col("query_id").alias("id"), "vec")
    if excluded is None:
        asked = asked.withColumn("take", F.lit(k).cast("long"))
    else:
        more = excluded.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("more"))
        asked = asked.join(more.hint("merge"), "id", "left").select("id", "vec", (F.coalesce("more", F.lit(0)) + k).alias("take"))
    q = _pack(asked, QUERY_BLOCK, coded[0])
    c = _pack(catalogue.select(F.col("song_id").alias("id"), "vec", F.lit(0).cast("long").alias("take")), BLOCK, coded[1])

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floors: dict[tuple[bytes, int], np.ndarray] = {}  # by block of queries: the least that still counts, from the task's blocks so far
        for b in batches:
            for q_ids, takes, qm, ids, m in zip(b["q_ids"], b["q_takes"], b["q"], b["ids"], b["matrix"]):
                q_ids, takes, ids = np.asarray(q_ids), np.asarray(takes), np.asarray(ids)
                floor = floors.setdefault((q_ids.tobytes(), hash(qm)), np.full(len(q_ids), -np.inf))
                got = first_of(np.frombuffer(qm, "<f8").reshape(len(q_ids), -1), np.frombuffer(m, "<f8").reshape(len(ids), -1), q_ids, ids, takes, floor, skip_self) if scores is product else None
                if got:
                    r, j, score = got
                else:
                    s = np.round(scores(qm, len(q_ids), m, len(ids)), PLACES)
                    if skip_self:
                        s[q_ids[:, None] == ids] = -np.inf
                    r, j = best_of(s, takes, ids)
                    score = s[r, j]
                raise_floor(floor, takes, r, score)
                yield pd.DataFrame({"query_id": q_ids[r], "song_id": ids[j], "score": score})

    found = _met(q, c).mapInPandas(best, "query_id long, song_id long, score double")
    if excluded is not None:
        found = found.join(excluded.hint("merge"), ["query_id", "song_id"], "left_anti")
    return ranked(found, k)


def totals(queries: DataFrame, catalogue: DataFrame) -> DataFrame:
    """query_id, n, total, best: of all rows of the catalogue with another id than a query's, how many there are, the sum of
    their inner products, rounded to PLACES, and the largest.

    ``queries`` (query_id, vec) meet ``catalogue`` (song_id, vec) block by block; each pair of blocks hands on a row a query.
    Null vectors count as rows, but add nothing; repeated rows count each time; a query without other rows has none.
    """
    none = F.lit(0).cast("long").alias("take")
    q = _pack(queries.select(F.col("query_id").alias("id"), "vec", none), QUERY_BLOCK, np.ndarray.tobytes)
    c = _pack(catalogue.select(F.col("song_id").alias("id"), "vec", none), BLOCK, np.ndarray.tobytes)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for q_ids, qm, ids, m in zip(b["q_ids"], b["q"], b["ids"], b["matrix"]):
                q_ids, ids = np.asarray(q_ids), np.asarray(ids)
                s = np.round(product(qm, len(q_ids), m, len(ids)), PLACES)
                own = q_ids[:, None] == ids
                s[own] = 0.0
                total = s.sum(axis=1)
                s[own] = -np.inf
                some = ~own.all(axis=1)
                yield pd.DataFrame({"query_id": q_ids[some], "total": total[some], "best": s.max(axis=1)[some]})

    sums = _met(q, c).mapInPandas(summed, "query_id long, total double, best double").groupBy("query_id").agg(F.sum("total").alias("total"), F.max("best").alias("best"))
    asked = queries.groupBy(F.col("query_id").cast("long").alias("query_id")).agg(F.count("*").alias("times"))
    own = catalogue.groupBy(F.col("song_id").cast("long").alias("query_id")).agg(F.count("*").alias("own"))
    counted = asked.join(own.hint("merge"), "query_id", "left").crossJoin(F.broadcast(catalogue.agg(F.count("*").alias("all"))))  # one row
    n = F.col("times") * (F.col("all") - F.coalesce("own", F.lit(0)))
    return counted.join(sums.hint("merge"), "query_id", "left").select("query_id", n.alias("n"), "total", "best").where("n > 0")


def ranked(found: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first K of each query, by score (ties by smaller song_id) or by the order given, which must leave no ties. Only
    each task's first K of a query are shuffled."""
    by = order or (F.desc("score"), F.col("song_id"))
    w = Window.partitionBy("query_id").orderBy(*by)
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def reranked(pool: DataFrame, delta: Column, k: int) -> DataFrame:
    """A pool (query_id, rank, song_id, score and what ``delta`` reads) by its adjusted score, rounded to four places;
    ties keep the order of the pool."""
    adjusted = pool.withColumn("adjusted", F.round(F.col("score") + delta, 4)).withColumnRenamed("rank", "pool_rank")
    return ranked(adjusted, k, F.desc("adjusted"), F.col("pool_rank"))


def fetch_size(k: int, narrowed: bool, factor: int = 5) -> int:
    """How many to fetch when filters or reranking narrow what is found."""
    return k * factor if narrowed else k


def allowed(category: Column | None = None, tempo_bucket: Column | None = None, exclude_artist: str | None = None, row: dict[str, str] | None = None) -> Column:
    """The conjunction of the filters that are given; songs without features fail a tempo filter."""
    names = {"category": "category", "tempo_bucket": "tempo_bucket", "artist": "artist"} | (row or {})
    out = F.lit(True)
    if category is not None:
        out &= F.col(names["category"]) == category
    if tempo_bucket is not None:
        out &= F.coalesce(F.col(names["tempo_bucket"]) == tempo_bucket, F.lit(False))
    if exclude_artist is not None:
        out &= F.coalesce(F.lower(names["artist"]) != exclude_artist.lower(), F.lit(True))
    return out
