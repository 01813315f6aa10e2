"""Similar songs of a seed: by id, by name, by playlist; reranked by default; and what a result's card shows.

A seed that isn't there, or has no vector, fails in the plan that reads it, at the latest when the search writes its queries'
blocks: nothing is looked up beforehand.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from melodex.functions.music import tempo_label
from melodex.functions.text import make_song_id

from .feedback import centroids
from .rerank import DEFAULTS, rerank_score
from .search import fetch_size, reranked, topk


def _seed(rows: DataFrame, what: str) -> DataFrame:
    """query_id and vec of the row with the least song_id; an error, where the row is read, if there is none or no vector."""
    told = rows.agg(F.min("song_id").alias("query_id"), F.min_by("vec", "song_id").alias("vec"))
    missing = F.when(F.col("query_id").isNull(), F.raise_error(F.lit(f"no song {what}"))).when(F.col("vec").isNull(), F.raise_error(F.lit(f"song {what} has no vector")))
    return told.select("query_id", missing.otherwise(F.col("vec")).alias("vec"))


def reranked_topk(queries: DataFrame, songs: DataFrame, k: int, weights: dict[str, float] | None = None, where: Column | None = None) -> DataFrame:
    """query_id, rank, song_id, score (adjusted, four places) of the K best songs of each query, which are songs themselves.

    ``songs`` has song_id (of different songs), vec, and the columns that signals of a weight other than zero read. A pool of
    five times K is taken from the songs that pass ``where`` before the seed is removed; ties keep its order. A seed without
    a row in ``songs`` has no anchor and gets signals of zero.
    """
    catalogue = songs if where is None else songs.where(where)
    pool = topk(queries, catalogue.select("song_id", "vec"), fetch_size(k, True), skip_self=False).where("query_id <> song_id")
    names = [c for c in songs.columns if c not in ("song_id", "vec")]
    if not names:
        return reranked(pool, F.lit(0.0), k).select("query_id", "rank", "song_id", F.col("adjusted").alias("score"))
    of = lambda key, name: songs.select(F.col("song_id").alias(key), F.struct(*names).alias(name)).hint("merge")
    both = pool.join(of("query_id", "a"), "query_id", "left").join(of("song_id", "c"), "song_id")
    a, c = ({n: F.col(f"{side}.{n}") for n in names} for side in "ac")
    return reranked(both, rerank_score(a, c, weights), k).select("query_id", "rank", "song_id", F.col("adjusted").alias("score"))


def _of_seed(seed: DataFrame, songs: DataFrame, k: int, rerank: bool, weights: dict[str, float] | None, where: Column | None) -> DataFrame:
    if rerank:
        return reranked_topk(seed, songs, k, weights, where).select("rank", "song_id", "score")
    return topk(seed, (songs if where is None else songs.where(where)).select("song_id", "vec"), k).select("rank", "song_id", "score")


def similar_by_id(songs: DataFrame, song_id: int, k: int = 10, rerank: bool = True, weights: dict[str, float] | None = None, where: Column | None = None) -> DataFrame:
    """rank, song_id, score of the K songs most like one, itself left out; fails for an unknown id or a null vector.

    Reranked as by ``reranked_topk`` (with the default weights, so far as ``songs`` has their columns) unless told otherwise.
    ``where`` filters what may be found, not the seed.
    """
    weights = {n: w for n, w in DEFAULTS.items() if n in songs.columns} if weights is None else weights
    return _of_seed(_seed(songs.where(F.col("song_id") == song_id), str(song_id)), songs, k, rerank, weights, where)


def similar_by_name(songs: DataFrame, title: str, artist: str, k: int = 10, rerank: bool = True, weights: dict[str, float] | None = None, where: Column | None = None) -> DataFrame:
    """As ``similar_by_id``, of the song whose id made from title and artist is that of the given ones; of several the least."""
    named = make_song_id(F.col("title"), F.col("artist")) == make_song_id(F.lit(title), F.lit(artist))
    weights = {n: w for n, w in DEFAULTS.items() if n in songs.columns} if weights is None else weights
    return _of_seed(_seed(songs.where(named), f"{title!r} by {artist!r}"), songs, k, rerank, weights, where)


def similar_to_playlist(songs: DataFrame, members: DataFrame, k: int = 10, where: Column | None = None) -> DataFrame:
    """rank, song_id, score of the K songs nearest the mean of a playlist's (song_id), its own left out, not reranked.

    Members that are unknown or without a vector are skipped; a playlist without any vector fails. A member that repeats
    counts once.
    """
    own = members.select("song_id").distinct()
    inside = songs.join(own.hint("merge"), "song_id", "left_semi").withColumn("query_id", F.lit(-1).cast("long"))
    one = songs.sparkSession.range(1).select(F.lit(-1).cast("long").alias("query_id"))
    mean = one.join(centroids(inside, "query_id").hint("merge"), "query_id", "left")
    found = F.when(F.col("vec").isNull(), F.raise_error(F.lit("no song of the playlist has a vector"))).otherwise(F.col("vec"))
    others = (songs if where is None else songs.where(where)).join(own.hint("merge"), "song_id", "left_anti")
    return topk(mean.select("query_id", found.alias("vec")), others.select("song_id", "vec"), k, skip_self=False).select("rank", "song_id", "score")


def match_cards(results: DataFrame, features: DataFrame) -> DataFrame:
    """Results (with song_id and score) with what a card shows: tempo label, ornament index and harmonics-to-noise ratio at
    two places, and the score at four.

    ``features`` has song_id, tempo_bucket, murki_index and hnr_mean. In a record, a missing statistic is 0 and a missing
    bucket Unknown; a song without a record has nulls but for its score.
    """
    two = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 2)
    told = features.select("song_id", tempo_label(F.col("tempo_bucket")).alias("tempo_label"), two("murki_index").alias("ornament"), two("hnr_mean").alias("hnr"))
    return results.withColumn("score", F.round("score", 4)).join(told.hint("merge"), "song_id", "left")
