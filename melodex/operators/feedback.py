"""Queries from many vectors: centroids, Rocchio feedback, sessions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from melodex.functions.vectors import doubles, unit

# Weights of the query, of what was approved and of what was rejected.
ALPHA, BETA, GAMMA = 1.0, 0.75, 0.25


def gathered(cells: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, value) cells as one vector per key, in order."""
    return cells.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x.value).alias("vec"))


def centroids(members: DataFrame, *keys: str) -> DataFrame:
    """Mean of the vectors of each key, to length one; averaged by position, so that no group is ever gathered.

    Null vectors and components don't count; keys without a vector have no row; a mean of tiny norm stays as it is."""
    cells = members.select(*keys, F.posexplode("vec").alias("pos", "value"))
    mean = cells.groupBy(*keys, "pos").agg(F.avg(F.col("value").cast("double")).alias("value"))
    return gathered(mean, *keys).withColumn("vec", unit(F.col("vec")))


def required_centroids(groups: DataFrame, members: DataFrame, *keys: str) -> DataFrame:
    """As ``centroids``, for each of ``groups`` (keys); a group without a vector is an error where its row is read."""
    told = groups.select(*keys).distinct().join(centroids(members, *keys).hint("merge"), list(keys), "left")
    named = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    return told.withColumn("vec", F.when(F.col("vec").isNull(), F.raise_error(F.concat(F.lit("no vector in group "), named))).otherwise(F.col("vec")))


def rocchio(sessions: DataFrame, judged: DataFrame, alpha: float = ALPHA, beta: float = BETA, gamma: float = GAMMA) -> DataFrame:
    """session_id, vec: alpha * query + beta * mean of approved - gamma * mean of rejected, to length one.

    ``sessions`` has session_id and vec (the original query), ``judged`` session_id, verdict (approve or reject) and vec;
    an event that repeats counts again, and one with ``times`` (if there is that column) so often. Other verdicts and null vectors count for nothing; a session without events keeps
    its query, at length one; events of unknown sessions are left out.
    """
    times = F.col("times") if "times" in judged.columns else F.lit(1)
    # Whole vectors are shuffled, not their cells, which are then added up where their session is.
    dealt = judged.where(F.col("verdict").isin("approve", "reject")).select("session_id", "verdict", times.cast("long").alias("times"), "vec").repartition("session_id")
    cells = dealt.select("session_id", "verdict", "times", F.posexplode("vec").alias("pos", "value")).where("value is not null")
    part = lambda v, c: F.sum(F.when(F.col("verdict") == v, c))
    mean = lambda v: F.coalesce(part(v, F.col("value").cast("double") * F.col("times")) / part(v, F.col("times")), F.lit(0.0))
    moved = cells.groupBy("session_id", "pos").agg((beta * mean("approve") - gamma * mean("reject")).alias("value"))
    by = moved.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "value"))).alias("by"))
    both = sessions.where("size(vec) > 0").select("session_id", doubles(F.col("vec")).alias("vec")).join(by.hint("merge"), "session_id", "left")
    return both.select("session_id", unit(F.transform("vec", lambda x, i: alpha * x + F.coalesce(F.try_element_at("by", i), F.lit(0.0)))).alias("vec"))
