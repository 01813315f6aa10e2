"""Record linkage: fuzzy catalogue matching, similar-track and claim documents, judgments from matches."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from melodex.functions.text import grade_from_match

# Weights of title and artist, and the least combined score and artist similarity.
TITLE, ARTIST, ACCEPT, FLOOR = 0.7, 0.3, 0.72, 0.55
#: Titles in a block of an artist's.
TITLES = 1024

SIMILAR = "error int, message string, similartracks struct<track: array<struct<name: string, artist: struct<name: string>, match: string>>>"
CLAIMS = "map<string, array<struct<mainsnak: struct<datavalue: struct<value: struct<id: string, time: string>>>>>>"


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / the longer length; 1 for two empty texts."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / n)


def sequence_ratio():
    """Matching-block ratio of two texts as an Arrow function; the order of its arguments matters."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype=float)

    return ratio


# Letters from the rarest on.
_LETTERS = "zqxjkvbpygfwmucldrhsnioate"


def letters(c: Column) -> Column:
    """The different (letter, how often it came before) pairs of a text, those that are likely to be rare first."""
    chars = F.split(c, "")
    counted = F.transform(chars, lambda x, i: F.struct((F.length(F.replace(F.substring(c, F.lit(1), i), x, F.lit(""))) - i).alias("before"), F.instr(F.lit(_LETTERS), x).alias("place"), x.alias("letter")))
    return F.transform(F.array_sort(F.filter(counted, lambda x: x.letter != "")), lambda x: F.concat(x.letter, x.before.cast("string")))


def _first_letters(all_: Column, n: Column, floor: float, blocks: bool) -> Column:
    """Of two texts that are ``floor`` alike these share one: of n letters they share ``least`` of any text's, by either
    measure, so that not all of the first n - least + 1 can be among the others. Empty texts share an empty one."""
    least = F.ceil(n * floor / (2 - floor) - 1e-9) if blocks else F.ceil(n * floor - 1e-9)
    return F.when(n == 0, F.array(F.lit(""))).otherwise(F.slice(all_, F.lit(1), (n - least + 1).cast("int")))


def _may_be_alike(shared: Column, n: Column, m: Column, floor, blocks: bool) -> Column:
    """Can texts of n and m letters that share so many be ``floor`` alike? An upper bound of either measure."""
    return (n + m == 0) | ((2 * shared / (n + m) if blocks else shared / F.greatest(n, m)) >= floor - 1e-9)


def _signs(*sides: list[str], width: int) -> list[np.ndarray]:
    """For each side a row per text of zeros and ones: which (stretch of ``width`` letters, how often it came before) it has,
    so that the product of two sides counts what two texts share."""
    keys, rows = [], []
    for texts in sides:
        n = np.array([len(t) for t in texts], dtype=np.int64)
        code = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        row = np.repeat(np.arange(len(texts)), n)
        if width == 2:
            inside = row[1:] == row[:-1]
            code, row = (code[:-1] << 21 | code[1:])[inside], row[1:][inside]
        order = np.lexsort((code, row))
        row, code = row[order], code[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
        before = np.arange(len(row)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(row) else row
        keys.append(code << 16 | np.minimum(before, 0xFFFF))
        rows.append(row)
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    out = [np.zeros((len(texts), len(every)), dtype=np.float32) for texts in sides]
    for sign, row, place in zip(out, rows, np.split(at, np.cumsum([len(k) for k in keys])[:-1])):
        sign[row, place] = 1
    return out


def longest_common(xs: list[str], ts: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each pair of places; of texts ``xs`` over 64 letters the shorter length."""
    n, m = (np.array([len(t) for t in s], dtype=np.int64) for s in (xs, ts))
    code = [np.frombuffer("".join(s).encode("utf-32-le"), dtype=np.uint32) for s in (xs, ts)]
    every, at = np.unique(np.concatenate(code), return_inverse=True)
    place = lambda k: np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
    masks = np.zeros((len(xs), len(every) + 1), dtype=np.uint64)  # where in x each letter stands
    near = place(n) < 64
    np.bitwise_or.at(masks, (np.repeat(np.arange(len(xs)), n)[near], at[: len(code[0])][near]), np.uint64(1) << place(n)[near].astype(np.uint64))
    letter = np.full((len(ts), int(m.max(initial=0))), len(every))
    letter[np.repeat(np.arange(len(ts)), m), place(m)] = at[len(code[0]) :]
    free = np.full(len(i), np.uint64(0xFFFFFFFFFFFFFFFF))
    for k in range(int(m[j].max(initial=0))):
        hit = free & masks[i, letter[j, k]]
        free = (free + hit) | (free - hit)
    inside = np.where(n[i] < 64, (np.uint64(1) << np.minimum(n[i], 63).astype(np.uint64)) - np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF))
    return np.where(n[i] <= 64, np.bitwise_count(~free & inside).astype(np.int64), np.minimum(n[i], m[j]))


def likely_pairs(xs: list[str], ts: list[str], least: float, blocks: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs that may be ``least`` alike, by letters shared and then, for the block ratio, by the longest common
    subsequence, or, for the edit similarity, by pairs of neighbouring letters shared: upper bounds, so that none is lost.
    Two empty texts are alike."""
    n, m = (np.array([len(t) for t in s], dtype=np.float32) for s in (xs, ts))
    x, t = _signs(xs, ts, width=1)
    shared, longer = x @ t.T, np.maximum(n[:, None], m)
    room = 2 * shared / np.maximum(1, n[:, None] + m) if blocks else shared / np.maximum(1, longer)
    may = (room >= least - 1e-6) | (longer == 0)
    if not blocks and may.any():
        # An edit takes two pairs of neighbouring letters at most.
        rows, columns = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
        x, t = _signs([xs[i] for i in rows], [ts[j] for j in columns], width=2)
        need = longer[np.ix_(rows, columns)]
        may[np.ix_(rows, columns)] &= x @ t.T >= need - 1 - 2 * np.floor((1 - least) * need + 1e-4)
    i, j = np.nonzero(may)
    if blocks and len(i):
        total = n[i] + m[j]
        keep = (2 * longest_common(xs, ts, i, j) >= (least - 1e-6) * total) | (total == 0)
        i, j = i[keep], j[keep]
    return i, j


def _title_blocks(songs: DataFrame, artist: str, title: str, number: str, name: str) -> DataFrame:
    """An artist's titles in blocks of TITLES, with their numbers."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            of = b[artist].to_numpy()
            for part in np.split(np.arange(len(b)), np.flatnonzero(of[1:] != of[:-1]) + 1) if len(b) else ():
                for at in range(0, len(part), TITLES):
                    rows = b.iloc[part[at : at + TITLES]]
                    yield pd.DataFrame({artist: [of[part[0]]], f"{name}_titles": [rows[title].to_numpy()], f"{name}_ids": [rows[number].to_numpy()]})

    dealt = songs.select(artist, title, number).hint("rebalance", artist).sortWithinPartitions(artist, title)
    return dealt.mapInPandas(packed, f"{artist} string, {name}_titles array<string>, {name}_ids array<long>")


def fuzzy_match(external: DataFrame, catalogue: DataFrame, blocks: bool = True, accept: float = ACCEPT, floor: float = FLOOR) -> DataFrame:
    """title, artist (external), song_id, score: the best catalogue song of each different external pair, if any.

    Pairs that the catalogue has as they are match that. Of the others, distinct artists meet first, by letters that artists
    so alike must share, and only artists alike enough bring their titles together, block by block: a product of the blocks'
    letters bounds all their similarities at once, and what may still be accepted is reckoned. All steps lose no match.
    Similarity is the matching-block ratio or, with ``blocks=False``, the edit similarity, reckoned up to the distance that
    still counts. Of equal scores the smallest song_id wins. Inputs have normalised title and artist; rows with a null in
    either match nothing. No rows on a side: none. An artist of many titles on both sides is many pairs of blocks, dealt
    over tasks.
    """
    ext = external.select(F.col("title").alias("x_title"), F.col("artist").alias("x_artist")).where("x_title is not null and x_artist is not null").distinct()
    cat = catalogue.where("title is not null and artist is not null").groupBy("title", "artist").agg(F.min("song_id").cast("long").alias("song_id"))
    same = (F.col("x_title") == F.col("title")) & (F.col("x_artist") == F.col("artist"))
    as_they_are = ext.join(cat.hint("merge"), same).select("x_title", "x_artist", F.struct(F.lit(1.0).alias("score"), (-F.col("song_id")).alias("n")).alias("b"))
    ext = ext.join(cat.hint("merge"), same, "left_anti")

    def keyed(artists: DataFrame, name: str) -> DataFrame:
        told = artists.select(F.col(name)).distinct().withColumn(f"{name}_l", letters(F.col(name)))
        return told.select("*", F.explode(_first_letters(F.col(f"{name}_l"), F.length(name), floor, blocks)).alias("key"))

    x, c = F.col("x_artist"), F.col("artist")
    met = keyed(ext, "x_artist").join(keyed(cat, "artist").hint("merge"), "key")
    bound = _may_be_alike(F.size(F.array_intersect("x_artist_l", "artist_l")), F.length(x), F.length(c), floor, blocks)
    ratio = sequence_ratio() if blocks else edit_similarity
    alike = met.where(bound).select("x_artist", "artist").distinct().select("x_artist", "artist", ratio(x, c).alias("by_artist")).where(F.col("by_artist") >= floor)

    def likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for artist, by_artist, xs, ts, ids in zip(b["x_artist"], b["by_artist"], b["x_titles"], b["c_titles"], b["c_ids"]):
                xs, ts = list(xs), list(ts)
                i, j = likely_pairs(xs, ts, (accept - ARTIST * by_artist) / TITLE, blocks)
                for at in range(0, len(i), 1 << 16):
                    p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                    yield pd.DataFrame({"x_title": np.array(xs, dtype=object)[p], "x_artist": artist, "title": np.array(ts, dtype=object)[q], "song_id": np.asarray(ids)[q], "by_artist": by_artist})

    x_blocks, c_blocks = _title_blocks(ext.withColumn("none", F.lit(0).cast("long")), "x_artist", "x_title", "none", "x"), _title_blocks(cat, "artist", "title", "song_id", "c")
    beside = x_blocks.drop("x_ids").join(alike.hint("merge"), "x_artist").join(c_blocks.hint("merge"), "artist")
    tasks = int(external.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = beside.repartition(tasks, F.xxhash64("x_titles", "c_titles")).mapInPandas(likely, "x_title string, x_artist string, title string, song_id long, by_artist double")
    xt, t = F.col("x_title"), F.col("title")
    least = (accept - ARTIST * F.col("by_artist")) / TITLE  # what the titles must reach
    if blocks:
        by_title = ratio(xt, t)
    else:
        most = F.greatest(F.length(xt), F.length(t))
        far = pairs.select("*", F.floor((1 - least) * most + 1e-9).cast("int").alias("far"))
        pairs = far.select("*", F.expr("levenshtein(x_title, title, far)").alias("edits")).where("edits >= 0")
        by_title = F.when(most == 0, 1.0).otherwise(1 - F.col("edits") / most)
    scored = pairs.select("x_title", "x_artist", "song_id", F.round(TITLE * by_title + ARTIST * F.col("by_artist"), 9).alias("score")).where(F.col("score") >= accept)
    best = scored.groupBy("x_title", "x_artist").agg(F.max(F.struct("score", (-F.col("song_id")).alias("n"))).alias("b")).unionByName(as_they_are)
    return best.select(F.col("x_title").alias("title"), F.col("x_artist").alias("artist"), (-F.col("b.n")).alias("song_id"), F.col("b.score").alias("score"))


def flatten_similar(docs: DataFrame, column: str) -> DataFrame:
    """Similar-track documents as rows title, artist, match (0 where missing or no number); entries without a title or an
    artist go, and documents that are null, malformed, errors or empty."""
    d = docs.withColumn("d", F.from_json(column, SIMILAR)).where("d.error is null")
    t = d.withColumn("t", F.explode("d.similartracks.track")).drop("d")
    return t.select(*docs.columns, F.col("t.name").alias("title"), F.col("t.artist.name").alias("artist"), F.coalesce(F.col("t.match").try_cast("double"), F.lit(0.0)).alias("match")).where("title is not null and artist is not null")


def claim_ids(claims: Column, prop: str) -> Column:
    """Ids of a property's claims in order; malformed claims are skipped. Null for null or malformed documents and for a
    property that isn't there."""
    return F.filter(F.transform(F.from_json(claims, CLAIMS)[prop], lambda c: c.mainsnak.datavalue.value.id), lambda i: i.isNotNull())


def build_judgments(similar: DataFrame, catalogue: DataFrame, least: int, blocks: bool = True) -> DataFrame:
    """anchor_id, song_id, grade from similar tracks (anchor_id, title, artist, match) found in the catalogue.

    A track that is matched to its own anchor goes, as does grade 0; anchors need ``least`` judgments. Two tracks of an
    anchor that match one song are two judgments. No matches: no rows.
    """
    m = fuzzy_match(similar, catalogue, blocks).select("title", "artist", "song_id")
    j = similar.join(m.hint("merge"), ["title", "artist"]).where("song_id <> anchor_id").withColumn("grade", grade_from_match(F.col("match"))).where("grade > 0")
    return j.withColumn("n", F.count("*").over(Window.partitionBy("anchor_id"))).where(F.col("n") >= least).select("anchor_id", "song_id", "grade")
