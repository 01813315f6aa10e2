"""Ranking evaluation: nDCG, precision, confusion, targets."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from melodex.sources.scratch import stored

from .search import BROADCAST_BYTES

# Target precision by category, and of any other.
TARGETS = {"ghazal": 0.80, "sufi": 0.75, "sad_romantic": 0.70, "party": 0.85, "upbeat": 0.65}
OTHER_TARGET = 0.60


def gain(grade: Column, rank: Column) -> Column:
    """What a grade adds at a place counted from one."""
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1.0)


def graded(results: DataFrame, judgments: DataFrame) -> DataFrame:
    """Results (query_id, rank, song_id) with their grade, 0 where unjudged or judged null; the last judgment of a song
    counts. No results: no rows."""
    results = stored(results)
    return results.join(last_judgments(judged_results(results, judgments)).hint("merge"), ["query_id", "song_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def judged_results(results: DataFrame, judgments: DataFrame) -> DataFrame:
    """The judgments of songs that are among their query's results, which are few beside them: they meet by query, so that
    judgments are neither shuffled nor sorted where results are broadcast, behind a check of their bytes; beyond it they are
    shuffled by query at most."""
    some = stored(results.groupBy("query_id").agg(F.collect_set("song_id").alias("_some")))
    size = some.agg(F.sum(8 * F.size("_some") + 64)).first()[0] or 0
    few = F.broadcast(some) if size <= BROADCAST_BYTES else some.hint("shuffle_hash")
    return judgments.join(few, "query_id").where(F.array_contains("_some", F.col("song_id"))).drop("_some")


def last_judgments(judgments: DataFrame) -> DataFrame:
    """One grade per (query_id, song_id): that of the greatest ``pos``, which doesn't repeat within a pair."""
    return judgments.groupBy("query_id", "song_id").agg(F.max_by("grade", "pos").alias("grade"))


def ndcg(results: DataFrame, judgments: DataFrame, k: int) -> DataFrame:
    """query_id, ndcg and precision at K for every query with a judgment; 0 when nothing relevant is judged, or without
    results. Precision is over the results there are. Queries without judgments: no rows."""
    first = graded(results, judgments).where(F.col("rank") <= k)
    got = first.groupBy("query_id").agg(F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg"), F.avg((F.col("grade") >= 1).cast("double")).alias("precision"))
    ideal = ideal_dcg(last_judgments(judgments), k)
    both = ideal.join(got.hint("merge"), "query_id", "left")
    return both.select("query_id", F.when(F.col("ideal") > 0, F.coalesce(F.col("dcg"), F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("ndcg"), F.coalesce("precision", F.lit(0.0)).alias("precision"))


def label_precision(results: DataFrame, labels: DataFrame) -> DataFrame:
    """query_id, category, score: the share of a query's results with its own label, 0 without results."""
    of = labels.select(F.col("song_id").alias("query_id"), F.col("category"))
    found = results.join(labels.select("song_id", F.col("category").alias("found")).hint("merge"), "song_id")
    per = of.join(found.hint("merge"), "query_id", "left").groupBy("query_id", "category").agg(F.coalesce(F.avg((F.col("found") == F.col("category")).cast("double")), F.lit(0.0)).alias("score"))
    return per


def confusion(pairs: DataFrame, values: list) -> DataFrame:
    """Counts of (true, predicted) with a column for each value, zero-filled; other values aren't counted, a null true
    value is a row of its own."""
    return pairs.groupBy("true").pivot("predicted", values).count().na.fill(0)


def against_targets(scores: DataFrame, targets: DataFrame, other: float = OTHER_TARGET) -> DataFrame:
    """Scores (category, score) with their target, PASS (also at the target) or FAIL, and what to do about a failure; a
    category without a target, or a null one, has ``other``; a null score fails."""
    advice = F.when(F.col("category") == "ghazal", "raise the vocal weight").when(F.col("category") == "party", "raise the rhythmic weight").when(F.col("category") == "sufi", "raise the melodic weight").otherwise("inspect the cluster")
    both = scores.join(targets.hint("merge"), "category", "left").withColumn("target", F.coalesce("target", F.lit(other)))
    return both.withColumn("verdict", F.when(F.col("score") >= F.col("target"), "PASS").otherwise("FAIL")).withColumn("advice", F.when(F.col("score") < F.col("target"), advice))


def ideal_dcg(last: DataFrame, k: int) -> DataFrame:
    """query_id, ideal: the DCG of each query's best K grades, from its last judgments."""
    best = Window.partitionBy("query_id").orderBy(F.desc("grade"), "song_id")
    return last.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).groupBy("query_id").agg(F.sum(gain(F.col("grade"), F.col("r"))).alias("ideal"))


def weight_sweep(pool: DataFrame, judgments: DataFrame, weights: list[float], k: int) -> DataFrame:
    """weight, query_id, ndcg over a grid of one signal's weight, from one pool (query_id, rank, song_id, score, signal).

    Adjusted scores are rounded to four places; ties keep the pool's order. Judged queries without results: no rows.
    """
    each = pool.withColumn("weight", F.explode(F.array(*map(F.lit, weights))))
    w = Window.partitionBy("weight", "query_id").orderBy(F.desc(F.round(F.col("score") + F.col("weight") * F.col("signal"), 4)), F.col("rank"))
    first = stored(each.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k))
    last = last_judgments(judged_results(first, judgments))
    got = first.join(last.hint("merge"), ["query_id", "song_id"], "left").groupBy("weight", "query_id").agg(F.sum(gain(F.coalesce("grade", F.lit(0)), F.col("place"))).alias("dcg"))
    return got.join(ideal_dcg(last_judgments(judgments), k).hint("merge"), "query_id").select("weight", "query_id", F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def ablation(swept: DataFrame, before: float, after: float, places: int = 6) -> DataFrame:
    """query_id, before, after and moved: a query's nDCG at two weights of a sweep, and whether it changed."""
    s = swept.withColumn("ndcg", F.round("ndcg", places))
    b, a = (s.where(F.col("weight") == w).select("query_id", F.col("ndcg").alias(n)) for w, n in ((before, "before"), (after, "after")))
    return b.join(a.hint("merge"), "query_id").withColumn("moved", F.col("before") != F.col("after"))
