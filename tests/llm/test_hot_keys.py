"""Joins on hot keys: the rows that a plain join gives, in tasks of about equal size; and what uses them with one hot key."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from melodex.llm import chat_tree, common


@pytest.fixture()
def partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield 16
    spark.conf.set("spark.sql.shuffle.partitions", before[0])
    spark.conf.set("spark.sql.adaptive.enabled", before[1])


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join(spark, partitions, how):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 3 < 2, "hot").when(F.col("id") % 50 == 0, None).otherwise((F.col("id") % 90).cast("string")).alias("key"))
    values = common.written(rows.where("key is not null and (key = 'hot' or key % 2 = 0)" if how == "left" else "key is not null").groupBy("key").agg(F.count("*").alias("n")).withColumn("value", F.length("key")))
    got = common.spread_join(rows, values, "key", 20_000, "id", how=how)
    want = rows.join(values.drop("n"), "key", how)
    key = lambda d: sorted(map(repr, d.select("id", "key", "value").collect()))
    assert key(got) == key(want)
    sizes = [r[0] for r in got.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes) < 0.25 * sum(sizes)


def test_one_hot_turn_and_one_hot_conversation(spark, partitions):
    """All conversations on one first turn, a third of them alike to the end: told as they are, each once."""
    talk = spark.range(3000).selectExpr("id AS conv_id", "explode(array(0, 1)) AS turn").selectExpr("conv_id", "turn", "if(turn = 0, 'user', 'assistant') AS role", "if(turn = 0, 'same', if(conv_id % 3 = 0, 'alike', concat('answer ', conv_id))) AS text")
    got = {r.conv_id: r for r in chat_tree.digests(talk).collect()}
    assert len(got) == 3000 and {r.n_turns for r in got.values()} == {2}
    assert len({r.turns_sha256 for r in got.values()}) == 2001 and got[0].turns_sha256 == got[2997].turns_sha256
    assert all(r.loss_chars == len("alike" if i % 3 == 0 else f"answer {i}") for i, r in got.items())


def test_one_hot_id(spark, partitions):
    """Copies that all have one id, or none: one of them stays, the least text first, beside another group."""
    same = " ".join(f"w{k}" for k in range(60))
    rows = [(7, same)] * 300 + [(None, same)] * 300 + [(7, same + " "), (9, "something else altogether"), (None, "another text of no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_dedup(spark, docs, None).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(7, same), (9, "something else altogether"), (0, "another text of no id")])
