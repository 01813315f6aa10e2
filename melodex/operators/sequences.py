"""Token sequences: segments, splits, caps, masking, votes, and a class-wise Markov classifier."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from melodex.functions.vectors import let
from melodex.sources.scratch import stored


def cents_tokens(pitch: Column, tonic: Column, vocabulary: int = 209) -> Column:
    """Voiced pitches as twentieths of a semitone above the tonic, within the vocabulary; 0 for unvoiced."""
    one = lambda p: F.greatest(F.lit(0), F.least(F.lit(vocabulary - 1), F.bround(F.log2(p / tonic) * 60).cast("int")))
    return F.transform(pitch, lambda p: F.when(p > 0, one(p)).otherwise(0))


def segments(sequences: DataFrame, length: int, stride: Column, voiced: float = 0.5, most: int | None = None) -> DataFrame:
    """Windows of ``tokens`` (id and what else is there) with start and share of voiced tokens.

    A sequence shorter than a window is padded with zeros if it has half its length. Windows below the voiced share go;
    if that leaves none, the most voiced one stays, the first of equals. At most ``most`` a sequence, the first ones.
    Null sequences and shorter ones than half a window have no rows. Ids are different.
    """
    n = F.size("tokens")
    cut = sequences.where(n >= length / 2).withColumn("start", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), n - length), stride.cast("int"))))
    part = F.slice("tokens", F.col("start") + 1, F.lit(length))
    padded = cut.withColumn("tokens", F.concat(part, F.array_repeat(F.lit(0), F.lit(length) - F.size(part))))
    share = padded.withColumn("share", F.size(F.filter("tokens", lambda t: t > 0)) / float(length))
    best = Window.partitionBy("id").orderBy(F.desc("share"), "start")
    kept = share.withColumn("place", F.row_number().over(best)).where((F.col("share") >= voiced) | (F.col("place") == 1))
    if most is not None:
        kept = kept.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("start"))).where(F.col("place") <= most)
    return kept.drop("place")


def draw(key: Column, seed: str = "7") -> Column:
    """A number that follows from a key alone, the same in any engine that has md5."""
    return F.md5(F.concat(key.cast("string"), F.lit(":" + seed)))


def group_split(files: DataFrame) -> DataFrame:
    """split of each file (id, label): of a label with three files or more one is test, one is val; the rest train, as do
    files with a null label. Which ones follows from a hash of the id; ids are different."""
    w = Window.partitionBy("label").orderBy(draw(F.col("id")), "id")
    two = files.select("id", "label").withColumn("place", F.row_number().over(w)).where("place <= 2")
    many = files.groupBy("label").count().where("count >= 3").select("label")
    picked = two.join(many.hint("merge"), "label").select("id", "label", F.when(F.col("place") == 1, "test").otherwise("val").alias("split"))
    return files.join(picked, ["id", "label"], "left").withColumn("split", F.coalesce("split", F.lit("train")))


def cap_per_class(rows: DataFrame, most: int) -> DataFrame:
    """A seeded sample of at most ``most`` rows (id) of each label, a null label being one; ties by id."""
    w = Window.partitionBy("label").orderBy(draw(F.col("id")), "id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("place")


def _number(key: Column, k: Column, seed: int) -> Column:
    """A 32-bit number that follows from a key, a place and a seed, the same in any engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(":"), k.cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long")


def mask_spans(tokens: Column, key: Column, spans: int, width: int, fill: Column, seed: int = 7) -> Column:
    """Tokens with ``spans`` random spans of at most ``width`` filled; the spans follow from the key, may overlap and end
    with the tokens. Null tokens stay null, empty ones empty."""
    n = F.greatest(F.size(tokens), F.lit(1))
    cuts = F.transform(F.sequence(F.lit(1), F.lit(spans)), lambda k: F.struct((_number(key, k, seed) % n).alias("a"), (_number(key, k, seed + 1) % width + 1).alias("w")))
    return F.transform(tokens, lambda x, i: F.when(F.exists(cuts, lambda c: (i >= c.a) & (i < c.a + c.w)), fill).otherwise(x))


def _bands(key: Column, bands: int, width: int, n: Column, seed: int) -> Column:
    """Random stretches of n places, up to ``width`` long; those of no place or of all go."""
    def band(k: Column) -> Column:
        w = _number(key, k, seed) % (width + 1)
        return F.struct(w.alias("w"), (_number(key, k, seed + 1) % F.greatest(n - w + 1, F.lit(1))).alias("a"))

    return F.filter(F.transform(F.sequence(F.lit(1), F.lit(bands)), band), lambda c: (c.w > 0) & (c.w < n))


def mask_bands(spectrum: Column, key: Column, rows: tuple[int, int] = (2, 16), columns: tuple[int, int] = (2, 40), seed: int = 17) -> Column:
    """A spectrum (an array of equally long rows) with random bands of rows (frequencies) and columns (times) set to its mean.

    ``rows`` and ``columns``: how many bands, and of how many places at most. Bands follow from the key; they may be empty,
    overlap or meet; one that would take all rows or columns is left out. Null stays null, and an empty spectrum empty.
    """
    inside = lambda cuts, i: F.exists(cuts, lambda c: (i >= c.a) & (i < c.a + c.w))
    total = F.aggregate(F.flatten(spectrum), F.lit(0.0), lambda s, x: s + x.cast("double"))
    n, m = F.size(spectrum), F.coalesce(F.size(F.get(spectrum, F.lit(0))), F.lit(0))

    def masked(told: Column) -> Column:
        fill = told.fill
        by_row = lambda row: F.transform(row, lambda x, t: F.when(inside(told.times, t), fill).otherwise(x.cast("double")))
        return F.transform(spectrum, lambda row, r: F.when(inside(told.pitches, r), F.transform(row, lambda x: fill)).otherwise(by_row(row)))

    drawn = F.struct(F.try_divide(total, n * m).alias("fill"), _bands(key, *rows, n, seed).alias("pitches"), _bands(key, *columns, m, seed + 10).alias("times"))
    return let(drawn, masked)


def priors_weights(rows: DataFrame) -> DataFrame:
    """label, prior (share of the rows) and weight (rows / (labels * its rows)); a null label is one. No rows: none."""
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"), F.count("*").alias("labels"))
    return counts.crossJoin(F.broadcast(total)).select("label", (F.col("n") / F.col("all")).alias("prior"), (F.col("all") / (F.col("labels") * F.col("n"))).alias("weight"))


def majority_vote(predictions: DataFrame) -> DataFrame:
    """file, vote: the most frequent prediction; the lowest of equals. A null prediction wins only where it is frequenter."""
    c = predictions.groupBy("file", "pred").count()
    return c.groupBy("file").agg(F.max_by("pred", F.struct("count", -F.col("pred"))).alias("vote"))


def accuracy_report(predictions: DataFrame) -> DataFrame:
    """label (null for all), segments, accuracy of segments, files, accuracy of files by vote. Labels aren't null; null
    predictions count as segments, but not in the accuracy. A file has one label."""
    seg = predictions.rollup("label").agg(F.count("*").alias("segments"), F.avg((F.col("pred") == F.col("label")).cast("double")).alias("seg_acc"))
    files = majority_vote(predictions).join(predictions.select("file", "label").distinct(), "file")
    file = files.rollup("label").agg(F.count("*").alias("files"), F.avg((F.col("vote") == F.col("label")).cast("double")).alias("file_acc"))
    return seg.join(file, seg.label.eqNullSafe(file.label)).select(seg.label, "segments", "seg_acc", "files", "file_acc")


def bigrams(rows: DataFrame) -> DataFrame:
    """Neighbouring tokens of each sequence, with what else the row has."""
    pairs = F.zip_with(F.slice("tokens", 1, F.size("tokens") - 1), F.slice("tokens", 2, F.size("tokens") - 1), lambda a, b: F.struct(a.alias("prev"), b.alias("next")))
    return rows.where(F.size("tokens") >= 2).withColumn("p", F.explode(pairs)).select(*[c for c in rows.columns if c != "tokens"], "p.prev", "p.next")


def markov_classifier(train: DataFrame, test: DataFrame, vocabulary: int) -> DataFrame:
    """id, pred, loglik: the label under which a test sequence is likeliest.

    Transition counts of each label with one added to every transition, times the label's prior; ties: the lowest. Test
    sequences of fewer than two tokens, or null ones, get the likeliest label by prior. No training rows: no rows.
    """
    seen = bigrams(train.select("label", "tokens"))
    moves = seen.groupBy("label", "prev", "next").count()
    outs = seen.groupBy("label", "prev").agg(F.count("*").alias("outs"))
    priors = stored(priors_weights(train.select("label")).select("label", F.log("prior").alias("base")))  # a row a label
    asked = bigrams(test.select("id", "tokens")).groupBy("id", "prev", "next").agg(F.count("*").alias("times"))
    each = asked.crossJoin(F.broadcast(priors.select("label")))
    p = each.join(moves.hint("merge"), ["label", "prev", "next"], "left").join(outs.hint("merge"), ["label", "prev"], "left")
    score = p.groupBy("id", "label").agg(F.sum(F.col("times") * F.log((F.coalesce("count", F.lit(0)) + 1.0) / (F.coalesce("outs", F.lit(0)) + float(vocabulary)))).alias("ll"))
    every = test.select("id").distinct().crossJoin(F.broadcast(priors)).join(score.hint("merge"), ["id", "label"], "left")
    total = every.select("id", "label", F.round(F.coalesce("ll", F.lit(0.0)) + F.col("base"), 6).alias("loglik"))
    return total.groupBy("id").agg(F.max_by("label", F.struct("loglik", -F.col("label"))).alias("pred"), F.max("loglik").alias("loglik"))
