"""Order statistics over whole columns without gathering them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that one sort may take for the last step.
FEW = 100_000


def kth_smallest(df: DataFrame, column: str, k: int, few: int = FEW):
    """The value at place k (from zero) of the sorted column; nulls don't count, None past the end.

    Approximate percentiles narrow the rows down to those around the place until few are left; only counts and two
    bounds reach the driver.
    """
    v = F.col(column)
    rows = df.select(v).where(v.isNotNull())
    n, width = rows.count(), 0.001
    while n > few:
        if not 0 <= k < n:
            return None
        at = (k + 0.5) / n
        low, high = rows.agg(F.percentile_approx(v, [max(0.0, at - width), min(1.0, at + width)], 10_000)).first()[0]
        below, same, inside = rows.agg(F.count_if(v < low), F.count_if(v == low), F.count_if((v >= low) & (v <= high))).first()
        if below <= k < below + same:
            return low
        if not below <= k < below + inside:
            width *= 10
            continue
        if inside == n:  # nothing outside: at least the least value goes
            rows, k, n = rows.where(v > low), k - same, n - same
        else:
            rows, k, n = rows.where((v >= low) & (v <= high)), k - below, inside
    got = rows.orderBy(column).offset(k).limit(1).collect() if 0 <= k < n else []
    return got[0][0] if got else None
