"""SimHash near-duplicates by multi-index hashing.

Fingerprints are made in Arrow functions; everything after that is on distinct fingerprints. Their 64 bits are cut into
two segments of 32. Two fingerprints at distance 2 or less agree in the second segment, or differ in at most one bit of
the first; so each looks up its second segment as it is and the Hamming ball of radius 1 around its first (1 + 33
probes), and complete distances are verified inside the join. Where one segment value is shared by more than ``hot``
different fingerprints, its table entries are left out and their owners look up whole fingerprints in the complete ball
of radius 2 (2081 probes): exact as well, and linear in the size of the group.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread_join, written
from .components import components, with_least

#: Different fingerprints in one bucket above which whole-fingerprint probes take over; shingles hashed at a time.
HOT, BLOCK = 1024, 1 << 16
_LOW = 0xFFFFFFFF


def fingerprint_of(text: str | None, width: int = 3) -> int:
    """Signed 64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split() if text else []  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + width - 1]
        if n == 1:
            hashes = [xxh64_intdigest(b" ".join(part), 42)]
        elif width == 3:
            hashes = [xxh64_intdigest(b"%b %b %b" % x, 42) for x in zip(part, part[1:], part[2:])]
        else:
            hashes = [xxh64_intdigest(b" ".join(part[i : i + width]), 42) for i in range(len(part) - width + 1)]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, width: int = 3) -> Column:
    """SimHash (long) of a text column."""

    @F.pandas_udf("long")
    def make(batch: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, width) for t in batch], dtype="int64")

    return make(text)


def _flips(bits: int, radius: int, low: int = 0) -> list[int]:
    """Masks of the Hamming ball of that radius (0 to 2) over so many bits, as signed 64-bit numbers."""
    one = [1 << (low + i) for i in range(bits)]
    masks = [0] + one * (radius > 0) + [a | b for i, a in enumerate(one) for b in one[:i]] * (radius > 1)
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _masks(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def links(groups: DataFrame, hot: int = HOT) -> DataFrame:
    """(src, dst) for all pairs of ``groups`` (fp, rep: distinct longs) whose fingerprints differ in 1 or 2 bits."""
    first, second = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(_LOW)
    keys = lambda col, probe: F.explode(
        F.concat(
            F.transform(_masks(_flips(32, 1) if probe else [0]), lambda m: F.struct(F.lit(1).alias("seg"), col[0].bitwiseXOR(m).alias("val"))),
            F.array(F.struct(F.lit(2).alias("seg"), col[1].alias("val"))),
        )
    )
    entries = groups.select("fp", "rep", keys((first, second), False).alias("k")).select("fp", "rep", "k.seg", "k.val")
    full = written(entries.groupBy("seg", "val").count().where(F.col("count") > hot).select("seg", "val"))
    near = (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= 2) & (F.col("a.fp") < F.col("b.fp"))
    probes = groups.select("fp", "rep", keys((first, second), True).alias("k")).select("fp", "rep", "k.seg", "k.val")
    any_full = full.limit(1).count() > 0
    table = entries.join(full.hint("merge"), ["seg", "val"], "left_anti") if any_full else entries
    same = (F.col("a.seg") == F.col("b.seg")) & (F.col("a.val") == F.col("b.val"))
    found = probes.alias("a").join(table.alias("b").hint("merge"), same & near).select(F.col("a.rep").alias("src"), F.col("b.rep").alias("dst"))
    if any_full:
        owners = entries.join(full.hint("merge"), ["seg", "val"], "left_semi").select("fp", "rep").distinct()
        balls = owners.select("rep", F.col("fp").alias("own"), F.explode(F.transform(_masks(_flips(64, 2)[1:]), lambda m: F.col("fp").bitwiseXOR(m))).alias("fp"))
        found = found.unionByName(balls.join(groups.withColumnRenamed("rep", "other").hint("merge"), "fp").select(F.col("rep").alias("src"), F.col("other").alias("dst")))
    return found


def near_duplicates(docs: DataFrame, width: int = 3, hot: int = HOT, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable by links) of every row; with
    ``carry`` also those columns and ``component``, a number of each component that is never null.

    Links join fingerprints at 2 or fewer differing bits. Null, empty and blank texts have fingerprint zero and link like
    any other; texts of fewer words than a shingle are one shingle. Rows with a null doc_id take part in links and get
    the smallest id of their component (null if it has none). Different texts under one id link only if their
    fingerprints do. Repeated rows: a row each. No rows: none. Other columns are not read unless carried. Copies are
    aggregated to one entry per fingerprint before any link is sought, and dealt over tasks when they get their component.
    """
    fps = written(docs.select("doc_id", *carry, fingerprint(F.col("text"), width).alias("fp")))
    # Groups are known by numbers of their own: ids may be null, or have several fingerprints.
    groups = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()))
    found = components(links(groups.select("fp", F.col("node").alias("rep")), hot))
    joined = with_least(written(found.join(groups.select("node", "fp", "rep").hint("merge"), "node")), "rep").select("fp", "component_id", "component")
    alone = F.col("component").isNull()
    of = written(
        groups.join(joined.hint("merge"), "fp", "left").select("fp", "n", F.when(alone, F.col("rep")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("component", "node").alias("component"))
    )
    told = spread_join(fps, of, "fp", fps.count(), "doc_id", *carry)
    return told.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", *([*carry, "component"] if carry else []))
