"""Frame series of songs: filling, differences, statistics, pitch profiles, windows.

A frame table has song_id, i (the frame's place from zero) and v; a song's frames are bounded by its length, so windows
over one song stay small however many songs there are.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from melodex.functions.vectors import spread_pitch_bins, unit


def in_order():
    """One song, by frame."""
    return Window.partitionBy("song_id").orderBy("i")


# The band in which vibrato is looked for and the least frames for it; bins of a pitch profile
# and least voiced frames for it.
BAND, LEAST_FRAMES, BINS, LEAST_VOICED = (5.0, 15.0), 32, 36, 10


def forward_fill(v: Column) -> Column:
    """Zeros, NaN and nulls take the last valid value; 0 before the first."""
    valid = F.when((v != 0) & ~F.isnan(v), v)
    return F.coalesce(F.last(valid, ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))


def delta(v: Column) -> Column:
    """The step from the frame before; null for the first one and beside nulls."""
    return v - F.lag(v).over(in_order())


def energy_ratio(a: Column, b: Column) -> Column:
    """a / (a + b); 0.5 when there is nothing to divide."""
    return F.when(a + b < 1e-8, 0.5).otherwise(F.coalesce(a / (a + b), F.lit(0.5)))


def glide_variance(frames: DataFrame) -> DataFrame:
    """song_id, glide: population variance of the steps of the filled pitch over its squared mean; 0 under 10 frames with
    a pitch, and for songs without any."""
    filled = frames.withColumn("f", forward_fill(F.col("v"))).where("f > 0").withColumn("d", F.abs(delta(F.col("f"))))
    g = filled.groupBy("song_id").agg(F.count("*").alias("n"), F.avg("f").alias("m"), F.var_pop("d").alias("s"))
    return frames.select("song_id").distinct().join(g, "song_id", "left").select("song_id", F.when((F.col("n") >= 10) & (F.col("m") >= 1e-6), F.col("s") / (F.col("m") * F.col("m"))).otherwise(0.0).alias("glide"))


def pitch_histogram(frames: DataFrame, chroma: DataFrame | None = None, least: int = LEAST_VOICED) -> DataFrame:
    """song_id, vec: counts of the voiced pitches in 36 bins (three a semitone), to length one, for every song with frames.

    Songs with fewer than ``least`` voiced frames of a pitch above zero take their 12-bin profile from ``chroma`` (song_id,
    chroma), spread over 36 bins; zeros where it has none. Null pitches and flags count as unvoiced.
    """
    pitch = F.when(F.col("voiced") & (F.col("v") > 0), F.col("v"))
    bin_ = F.pmod(F.floor(3 * (69 + 12 * F.log2(pitch / 440.0))), F.lit(BINS)).cast("int")
    counts = frames.groupBy("song_id", bin_.alias("bin")).count()
    pairs = F.filter(F.collect_list(F.struct("bin", "count")), lambda x: x.bin.isNotNull())  # 37 at most
    by = counts.groupBy("song_id").agg(F.sum(F.when(F.col("bin").isNotNull(), F.col("count"))).alias("n"), F.map_from_entries(pairs).alias("m"))
    own = unit(F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.coalesce(F.col("m")[b], F.lit(0)).cast("double")))
    zeros = F.array_repeat(F.lit(0.0), BINS)
    if chroma is None:
        other = zeros
    else:
        by = by.join(chroma.select("song_id", "chroma"), "song_id", "left")
        other = F.when(F.size("chroma") == 12, spread_pitch_bins(F.col("chroma"))).otherwise(zeros)
    return by.select("song_id", F.when(F.col("n") >= least, own).otherwise(other).alias("vec"))


def _spectrum(rows: pd.DataFrame) -> pd.DataFrame:
    v = rows.sort_values("i")["v"].to_numpy(dtype=float)
    found = np.abs(np.fft.rfft(np.diff(v))) if len(v) >= LEAST_FRAMES else np.zeros(0)
    return pd.DataFrame({"song_id": rows["song_id"].iloc[0], "bin": np.arange(len(found)), "magnitude": found})


def spectrum(frames: DataFrame) -> DataFrame:
    """song_id, bin, magnitude of the voiced pitch's steps; no rows for songs under LEAST_FRAMES voiced frames.

    A song is one group, bounded by its length."""
    return frames.where("voiced").groupBy("song_id").applyInPandas(_spectrum, "song_id long, bin long, magnitude double")


def _band_power(rate: float):
    def of(rows: pd.DataFrame) -> pd.DataFrame:
        v = rows.sort_values("i")["v"].to_numpy(dtype=float)
        out = 0.0
        if len(v) >= LEAST_FRAMES:
            power = np.abs(np.fft.rfft(np.diff(v))) ** 2
            at = np.fft.rfftfreq(len(v) - 1, 1 / rate)
            inside = (at >= BAND[0]) & (at <= BAND[1])
            if inside.any() and power.sum() > 1e-12:
                out = float(power[inside].sum() / power.sum())
        return pd.DataFrame({"song_id": [rows["song_id"].iloc[0]], "ratio": [out]})

    return of


def band_power_ratio(frames: DataFrame, rate: float = 86.0) -> DataFrame:
    """song_id, ratio: share of the power of the voiced pitch's steps that lies in BAND; 0 under LEAST_FRAMES voiced frames
    or without power. Songs without voiced frames: no rows. A song is one group, bounded by its length."""
    return frames.where("voiced").groupBy("song_id").applyInPandas(_band_power(rate), "song_id long, ratio double")


def loudest_window(frames: DataFrame, length: int, step: int, skip: int) -> DataFrame:
    """song_id, start: the window with the largest RMS from ``skip`` to the end less a window; the first of equals, and
    0 where the song is too short. Each frame goes to the few windows that hold it."""
    n = frames.groupBy("song_id").agg(F.count("*").alias("n"))
    last = F.col("n") - length
    k = F.expr(f"sequence(greatest(0L, ceil((i - {skip} - {length - 1}) / {step})), floor((i - {skip}) / {step}))")
    some = frames.where(F.col("i") >= skip).join(n.hint("merge"), "song_id").withColumn("k", F.explode(k)).withColumn("start", F.lit(skip) + F.col("k") * step).where(F.col("start") <= last)
    power = some.groupBy("song_id", "start").agg(F.round(F.sqrt(F.avg(F.col("v") * F.col("v"))), 9).alias("rms"))
    best = power.groupBy("song_id").agg(F.max_by("start", F.struct("rms", -F.col("start"))).alias("start"))
    return n.join(best.hint("merge"), "song_id", "left").select("song_id", F.coalesce("start", F.lit(0)).cast("long").alias("start"))


def trim_edges(frames: DataFrame, skip: int, most: int, least: int) -> DataFrame:
    """Frames without ``skip`` at either end and at most ``most``; all of them where fewer than ``least`` would remain.
    Places count from zero without gaps."""
    n = F.count("*").over(Window.partitionBy("song_id"))
    inner = (F.col("i") >= skip) & (F.col("i") < F.col("n") - skip) & (F.col("i") < skip + most)
    return frames.withColumn("n", n).where(F.when(F.col("n") - 2 * skip >= least, inner).otherwise(F.lit(True))).drop("n")


def energy_gate(frames: DataFrame, length: int, least: int, share: float, quantile: float = 0.75) -> DataFrame:
    """song_id, start: windows of ``length`` frames (the last from ``least`` on, or the only one) whose mean is at least
    ``share`` of the song's quantile; the loudest one where none is. Means compare by nine decimal places; the first of
    equals. Songs without frames: no rows."""
    q = frames.groupBy("song_id").agg(F.percentile("v", F.lit(quantile)).alias("p"))
    w = frames.withColumn("start", F.col("i") - F.col("i") % length).groupBy("song_id", "start").agg(F.round(F.avg("v"), 9).alias("m"), F.count("*").alias("size"))
    j = w.join(q.hint("merge"), "song_id").where((F.col("size") >= least) | (F.col("start") == 0))
    best = Window.partitionBy("song_id").orderBy(F.desc("m"), "start")
    return j.withColumn("r", F.row_number().over(best)).where((F.col("m") >= F.round(share * F.col("p"), 9)) | (F.col("r") == 1)).select("song_id", "start")
