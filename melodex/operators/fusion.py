"""Fusion of feature groups into one vector, with weights that adapt to what is missing."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from melodex.functions.vectors import scaled, unit
from melodex.operators.features import vector_or_zeros

# The groups' base weights, and the audio weight of some categories.
BASE = {"clap": 0.30, "nlp": 0.15, "vocal": 0.22, "melodic": 0.20, "rhythmic": 0.13}
CATEGORY_CLAP = {"ghazal": 0.15, "sufi": 0.20, "sad_romantic": 0.30, "party": 0.32, "upbeat": 0.32}


def fusion_weights(lyrics_missing: Column, stem_failed: Column, clap_missing: Column, category: Column) -> dict[str, Column]:
    """Weight of each group; they add up to one.

    Since they do, giving a group a new weight multiplies all others by one factor. First the category's audio weight,
    then a missing audio vector, then failed stems (vocal and rhythmic halve in favour of audio, or of vocal if audio is
    missing), then missing lyrics. Flags aren't null; a null or unknown category has the base weights.
    """
    audio = F.lit(BASE["clap"])
    for name, w in CATEGORY_CLAP.items():
        audio = F.when(category == name, w).otherwise(audio)
    others = F.when(clap_missing, 1 / (1 - BASE["clap"])).otherwise((1 - audio) / (1 - BASE["clap"]))
    clap = F.when(clap_missing, 0.0).otherwise(audio)
    half = F.when(stem_failed, 0.5).otherwise(1.0)
    freed = (1 - half) * others * (BASE["vocal"] + BASE["rhythmic"])
    nlp = others * BASE["nlp"]
    up = F.when(lyrics_missing, 1 / (1 - nlp)).otherwise(1.0)
    return {
        "clap": (clap + F.when(clap_missing, 0.0).otherwise(freed)) * up,
        "nlp": F.when(lyrics_missing, 0.0).otherwise(nlp),
        "vocal": (others * BASE["vocal"] * half + F.when(clap_missing, freed).otherwise(0.0)) * up,
        "melodic": others * BASE["melodic"] * up,
        "rhythmic": others * BASE["rhythmic"] * half * up,
    }


def fuse(groups: dict[str, Column], weights: dict[str, Column]) -> Column:
    """Each group to length one, times its weight, one after another in the groups' order, to length one again. A group of
    tiny norm stays as it is; a null group or weight makes the result null."""
    return unit(F.concat(*[scaled(unit(v), weights[k]) for k, v in groups.items()]))


def rebuild(songs: DataFrame, layout: dict[str, int], stored: str = "stored", category: str = "category", stem_failed: str = "stem_failed") -> DataFrame:
    """``songs`` with ``fused`` built anew from their features, and the flags clap_missing and lyrics_missing.

    ``layout`` gives the groups' lengths in order; every group but clap is a column of ``songs``. The clap group is
    recovered from the stored fused vector, of which it is the first slice, to length one again; a stored vector that is
    too short for that (it was compressed) can't give it back: zeros, and clap_missing. A text vector that is missing is
    zeros, and lyrics_missing. Songs without a stored vector, or without any of the other groups, are left out, as there is
    nothing to build from. Repeated rows: a row each.
    """
    others = [k for k in layout if k not in ("clap", "nlp")]
    rows = songs.where(" and ".join(f"`{c}` is not null" for c in [stored, *others]))
    n = layout["clap"]
    clap_missing = F.size(stored) < n
    clap = F.when(clap_missing, F.array_repeat(F.lit(0.0), n)).otherwise(unit(F.slice(stored, 1, n)))
    nlp, no_lyrics = vector_or_zeros(F.col("nlp"), layout["nlp"])
    told = rows.withColumn("clap", clap).withColumn("clap_missing", clap_missing).withColumn("lyrics_missing", no_lyrics).withColumn("nlp", nlp)
    weights = fusion_weights(F.col("lyrics_missing"), F.coalesce(stem_failed, F.lit(False)), F.col("clap_missing"), F.col(category))
    return told.withColumn("fused", fuse({k: F.col(k) for k in layout}, weights)).drop("clap")
