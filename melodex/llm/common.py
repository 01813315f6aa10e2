"""Shared helpers: reading tables, cutting lineage with tables in the cluster's shared folder, joins on hot keys."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where that is unset, a new local one in local mode,
    as in tests; an error on a cluster, whose executors would not see it."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.melodex.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="melodex-")
        spark.conf.set("spark.melodex.dir", path)
    return path.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read back: lost executors recompute nothing before it, and its
    size is known to the planner."""
    path = f"{shared_dir(df.sparkSession)}/melodex-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return _read(df, path)


def _read(df: DataFrame, path: str) -> DataFrame:
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._melodex_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete what ``written`` made; only for frames that no later plan reads."""
    path = getattr(df, "_melodex_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def secret_key(spark: SparkSession) -> str:
    """The key of keyed operators in registered queries: ``spark.melodex.key``, which whoever runs them sets; a known one
    where that is unset, as in tests, hides nothing."""
    return spark.conf.get("spark.melodex.key", "no secret")


def learn_fold(doc_id):
    """True for the two thirds of the rows that labels may be learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


#: Hot keys that are broadcast at most, and rows of a key below which it isn't hot.
HOT_KEYS, FEW = 100_000, 64


def spread_join(rows: DataFrame, values: DataFrame, key: str, total: int, *deal: str, keys: int = HOT_KEYS, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``values``, which is written and has one row a key with the number ``n`` of its rows; ``how`` may be left.

    A key of many rows is dealt over several tasks by the hash of the columns ``deal``, so that none gets more than about
    ``total / keys`` of its rows. Of ``total`` rows fewer than ``keys`` keys can be that hot: they are broadcast.
    """
    most = max(FEW, -(-total // keys))
    parts = F.expr(f"cast(ceil(n / {most}) as int)")
    hot = F.broadcast(values.where(F.col("n") > most).select(key, parts.alias("parts")))
    dealt = rows.join(hot, key, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(*deal), "parts").cast("int"), F.lit(0))).drop("parts")
    copies = values.withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop("n")
    return dealt.join(copies.hint("merge"), [key, "part"], how).drop("part")
