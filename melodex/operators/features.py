"""Feature records and vectors that are incomplete: defaults, missing vectors, checks of their lengths."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from melodex.functions.music import tempo_bucket

# What an absent scalar feature counts as, and the least vectors for a projection.
DEFAULTS = {"tempo": 100.0, "energy": 0.5, "vocal_energy_ratio": 0.5, "hnr_mean": 0.5, "murki_index": 0.0, "meend_variance": 0.0, "onset_skewness": 0.0}
LEAST_VECTORS = 10
#: Offending ids that an error names.
NAMED = 20


def with_defaults(records: DataFrame, arrays: dict[str, int] | None = None, defaults: dict[str, float] = DEFAULTS) -> DataFrame:
    """Records with defaults for null scalars, zeros for null arrays (name: length), and a tempo_bucket of four places.

    A stored bucket of another length, or none, is made anew from the tempo. Only the columns that are there are touched;
    NaN stays NaN.
    """
    out = records
    for c, v in defaults.items():
        if c in records.columns:
            out = out.withColumn(c, F.coalesce(c, F.lit(v)))
    for c, n in (arrays or {}).items():
        out = out.withColumn(c, F.coalesce(c, F.array_repeat(F.lit(0.0), n)))
    if "tempo_bucket" in records.columns:
        out = out.withColumn("tempo_bucket", F.when(F.size("tempo_bucket") == 4, F.col("tempo_bucket")).otherwise(tempo_bucket(F.col("tempo"))))
    return out


def vector_or_zeros(vec: Column, length: int) -> tuple[Column, Column]:
    """A vector, zeros of the length where it is null, empty or of another length, and whether it was."""
    missing = F.coalesce(F.size(vec) != length, F.lit(True))
    return F.when(missing, F.array_repeat(F.lit(0.0), length)).otherwise(vec.cast("array<double>")), missing


def dimension_census(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """dims, n, dominant: how many vectors have each length, and the most frequent length (the longer of equals).

    Null vectors have no length and aren't counted. One row a length."""
    c = vectors.where(F.col(vec).isNotNull()).groupBy(F.size(vec).alias("dims")).agg(F.count("*").alias("n"))
    return c.crossJoin(F.broadcast(c.agg(F.max_by("dims", F.struct("n", "dims")).alias("dominant"))))


def offenders(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """The rows of ``vectors`` whose length isn't the dominant one, with dims and dominant; nulls are none."""
    dominant = dimension_census(vectors, vec).agg(F.first("dominant").alias("dominant"))
    return vectors.withColumn("dims", F.size(vec)).crossJoin(F.broadcast(dominant)).where(F.col(vec).isNotNull() & (F.col("dims") != F.col("dominant")))


def require_one_dimension(vectors: DataFrame, key: str = "song_id", vec: str = "vec", least: int = LEAST_VECTORS) -> tuple[int, int]:
    """(number, length) of the vectors; an error that names offending ids if lengths differ, or if there are too few."""
    census = dimension_census(vectors, vec).limit(2).collect()
    if len(census) > 1:
        named = ", ".join(f"{r[0]} ({r[1]})" for r in offenders(vectors, vec).select(key, "dims").orderBy(key).limit(NAMED).collect())
        raise ValueError(f"vectors need one length; {census[0].dominant} is the most frequent, others have: {named}")
    n = census[0].n if census else 0
    if n < least:
        raise ValueError(f"principal components need {least} vectors of one length; there are {n}")
    return n, census[0].dims
