"""Tempo and time-series rules of songs."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The edges and names of tempo buckets; when a detected tempo is halved.
EDGES, LABELS = (80, 100, 120), ("Slow", "Medium", "Upbeat", "Fast")
HALVE_ABOVE, SPARSE_ABOVE, SPARSE_RATE = 160, 120, 0.30


def tempo_octave_fix(tempo: Column, onset_rate: Column) -> Column:
    """Halve what is too fast, or fast with sparse onsets."""
    return F.when((tempo > HALVE_ABOVE) | ((tempo > SPARSE_ABOVE) & (onset_rate < SPARSE_RATE)), tempo / 2).otherwise(tempo)


def bucket_index(tempo: Column) -> Column:
    return F.when(tempo < EDGES[0], 0).when(tempo < EDGES[1], 1).when(tempo < EDGES[2], 2).when(tempo.isNotNull(), 3)


def tempo_bucket(tempo: Column) -> Column:
    """One-hot array; null for null."""
    i = bucket_index(tempo)
    return F.when(i.isNotNull(), F.array(*[(i == k).cast("int") for k in range(4)]))


def tempo_label(bucket: Column) -> Column:
    """Name of a one-hot bucket; Unknown when null or short."""
    out = F.lit("Unknown")
    for i in range(3, -1, -1):
        out = F.when((F.size(bucket) == 4) & (F.get(bucket, F.lit(i)) == 1), LABELS[i]).otherwise(out)
    return out
