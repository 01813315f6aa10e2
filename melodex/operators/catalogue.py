"""Song table operators: upserts, patches, migration, summaries, set operations."""

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, seq: str, preserve: bool = False) -> DataFrame:
    """Insert or replace whole rows by key; the greatest ``seq`` of the new ones wins, of equals one by a hash of the row.

    A replaced row loses the columns that the new one doesn't have, unless ``preserve`` keeps the old values. A null key is
    a key that replaces nothing; a null ``seq`` comes before all others. Old keys are different. Without new rows nothing
    changes. A key that repeats is combined before the shuffle.
    """
    own = [c for c in new.columns if c not in (key, seq)]
    last = new.groupBy(key).agg(F.max_by(F.struct(*own), F.struct(seq, F.xxhash64(*own))).alias("_r")).select(key, "_r.*")
    if preserve:
        o, n = old.alias("o"), last.alias("n")
        cols = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in last.columns else F.col(f"o.{c}") for c in old.columns]
        return o.join(n, key, "full").select(*[F.col(key) if c == key else x for c, x in zip(old.columns, cols)])
    return old.join(last, key, "left_anti").unionByName(last, allowMissingColumns=True).select(*old.columns)


def patch(old: DataFrame, new: DataFrame, key: str, lists: tuple[str, ...] = ()) -> DataFrame:
    """Overwrite only with what isn't null; of ``lists`` an empty one writes null, others their joined text.

    ``new`` has a key once; null and unknown keys patch nothing."""
    n = new.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in new.columns if c != key], F.lit(True).alias("_hit"))

    def value(c: str) -> Column:
        if c == key or c not in new.columns:
            return F.col(c)
        if c in lists:
            return F.when(F.col(f"_{c}").isNotNull(), F.nullif(F.array_join(f"_{c}", ", "), F.lit(""))).otherwise(F.col(c)).alias(c)
        return F.coalesce(f"_{c}", c).alias(c)

    return old.join(n, key, "left").select(*map(value, old.columns))


def flag(old: DataFrame, ids: DataFrame, key: str, column: str, value: Column) -> DataFrame:
    """Set one column for the given ids; null, unknown and repeated ids make no difference."""
    hit = ids.select(F.col(key), F.lit(True).alias("_hit")).distinct()
    return old.join(hit, key, "left").withColumn(column, F.when(F.col("_hit"), value).otherwise(F.col(column))).drop("_hit")


def migrate(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """Add the columns (name: type, default) that are absent; those that are there stay."""
    return df.select("*", *[F.lit(default).cast(kind).alias(c) for c, (kind, default) in columns.items() if c not in df.columns])


def required_fields(df: DataFrame, *fields: str) -> DataFrame:
    """The rows with ``error``: which of the fields is null or blank first, else null."""
    out = F.lit(None).cast("string")
    for f in reversed(fields):
        out = F.when(F.coalesce(F.trim(f), F.lit("")) == "", f"missing {f}").otherwise(out)
    return df.withColumn("error", out)


def row_slice(df: DataFrame, order: list, skip: int, take: int) -> DataFrame:
    """``take`` rows after ``skip`` in the order given, which must leave no ties; fewer or none past the end."""
    return df.orderBy(*order).offset(skip).limit(take)


def already_enriched(*columns: str) -> Column:
    """Is one of the columns neither null nor empty?"""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns]).isNotNull()


def retry_failed(failed: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Failed titles with their catalogue rows, many to many; unknown titles keep a row of nulls."""
    return failed.select("title").join(catalogue, "title", "left")


def resolve_labels(mentions: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """key, labels (joined by commas) and first, from ids (key, id, pos) and their names (id, name).

    Of an id that repeats the first place counts; ids without a name go, and keys without a named id. A key's ids are few:
    those that its record lists.
    """
    once = mentions.groupBy(key, "id").agg(F.min("pos").alias("pos"))
    got = once.join(names, "id").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("l"))
    return got.select(key, F.array_join("l.name", ", ").alias("labels"), F.get("l.name", F.lit(0)).alias("first"))


def best_record(candidates: DataFrame, key: str, place: str) -> DataFrame:
    """key, best: the ``place`` of the accepted candidate with the highest score, the first of equals; null if none is."""
    ok = F.when(F.col("accept"), F.struct("score", (-F.col(place)).alias("n")))
    return candidates.groupBy(key).agg((-F.max(ok).n).alias("best"))


def status_counts(records: DataFrame, failed: Column, matched: Column, enriched: Column, skipped: Column) -> DataFrame:
    """status, n: failed, no_match (not failed, but unmatched), enriched, skipped or matched_empty; nulls are no."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    status = F.when(yes(failed), "failed").when(~yes(matched), "no_match").when(yes(enriched), "enriched").when(yes(skipped), "skipped").otherwise("matched_empty")
    return records.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def tag_run(texts: DataFrame, path: str, key: str, text: str, tag: Column, done: DataFrame | None = None) -> dict[str, int]:
    """Write the texts with their tag, and say in the same pass how many were recovered, skipped (``done`` holds their key),
    none (null or blank) and tagged. Skipped and blank texts aren't written; a text of a null key is never done."""
    seen = Observation()
    had = F.lit(False)
    if done is not None:
        texts = texts.join(done.select(key).distinct().withColumn("_had", F.lit(True)).hint("merge"), key, "left")
        had = F.coalesce(F.col("_had"), F.lit(False))
    new, blank = ~had, ~F.coalesce(F.col(text).rlike(r"(?U)\S"), F.lit(False))
    told = texts.withColumn("tag", F.when(new & ~blank, tag))
    counts = {"recovered": new & ~blank, "skipped": had, "none": new & blank, "tagged": F.col("tag").isNotNull()}
    told.observe(seen, *[F.count_if(c).alias(name) for name, c in counts.items()]).where(new & ~blank).drop("_had").write.parquet(path)
    return {name: seen.get[name] for name in counts}


def tag_distribution(tagged: DataFrame, tag: str) -> DataFrame:
    """tag, n of the rows with a tag."""
    return tagged.where(F.col(tag).isNotNull()).groupBy(tag).agg(F.count("*").alias("n"))


def dedupe_keep_order(items: DataFrame, key: str, value: str, pos: str) -> DataFrame:
    """key, value, first: each key's different values with their first place; null and empty values go."""
    return items.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy(key, value).agg(F.min(pos).alias("first"))


def id_collisions(records: DataFrame, made: Column, source: Column) -> DataFrame:
    """song_id, n of the ids that more than one different source maps to."""
    return records.select(made.alias("song_id"), source.alias("source")).groupBy("song_id").agg(F.countDistinct("source").alias("n")).where("n > 1")
