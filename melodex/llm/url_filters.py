"""URL filters: given host and path rules first, mined association rules for the rest.

Labelled URLs become transactions of URL tokens and a label. Tokens that occur in exactly the same labelled URLs are one
item, which any of them stands for. Spark's FP-growth finds the frequent combinations. A transaction of more than GROUPED
items is dealt into blocks of that many, such that each combination of up to TOKENS items lies in one of them, so that its
combinations grow with a power of its items and not by doubling; what such blocks count twice is counted again on whole
transactions. Combinations that hold with a label often enough (support) and surely enough (confidence) become rules, and
a rule goes when a part of it already decides the same way as surely. A URL is judged by the surest rule whose items it
has all of, found by an inverted index from item to rules that counts a rule's items off: in an Arrow function while the
rules are few, by a join beyond that.
"""

from dataclasses import dataclass
from itertools import combinations

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Least share of the transactions and least confidence of a mined rule, and most items in one.
SUPPORT, CONFIDENCE, TOKENS = 0.002, 0.6, 3
#: Items of a transaction that are mined together; rules, and items that stand for tokens, up to which they are broadcast.
GROUPED, RULES = 12, 50_000
_GOOD, _BAD = "=allow", "=block"

@dataclass(frozen=True)
class Given:
    """A rule that somebody gave: it fits its host and all subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


GIVEN = (Given("com", "/", "allow"), Given("example.com", "/en/", "block"), Given("www.example.com", "/en/", "allow"), Given("net", "/es/", "block"), Given("net", "/fr/", "block"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def given_rule(host: Column, path: Column, rules: tuple[Given, ...] = GIVEN) -> Column:
    """The longest given rule that fits, as struct(rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: Column) -> Column:
    """Different tokens of a URL: scheme, host, its labels and endings, path words, extension, query names, fragment."""
    host, path = host_and_path(url)
    tail = F.regexp_extract(url, r"(?s)://[^?#]*(.*)$", 1)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    words = F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda x: (x != "") & ~x.rlike(r"^\p{N}+$"))
    named = lambda kind, col: F.transform(col, lambda x: F.concat(F.lit(kind), x))
    ending = F.array_join(F.slice(labels, -2, 2), ".")
    parts = F.concat(
        F.array(F.concat(F.lit("scheme:"), F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))), F.concat(F.lit("host:"), host)),
        F.when(F.size(labels) >= 2, F.array(F.concat(F.lit("site:"), ending))).otherwise(F.array().cast("array<string>")),
        named("label:", labels),
        named("path:", words),
        named("query:", F.regexp_extract_all(tail, F.lit(r"[?&]([^=&#]+)"), F.lit(1))),
        F.when(tail.contains("#"), F.array(F.lit("fragment:"))).otherwise(F.array().cast("array<string>")),
    )
    return F.array_distinct(F.coalesce(parts, F.array().cast("array<string>")))


_RULE = "items array<string>, verdict string, confidence double, freq long, place int"


@dataclass
class Mined:
    """Mined rules, surest first, and the item that each token stands for; both written."""

    rules: DataFrame
    items: DataFrame


def _with_items(rows: DataFrame, items: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and ``items`` (distinct, sorted) of the rows that have tokens with an item."""
    few = items.count() <= RULES
    each = rows.select(*keys, F.explode("tokens").alias("token"))
    joined = each.join(F.broadcast(items) if few else items.hint("merge"), "token")
    return joined.groupBy(*keys).agg(F.array_sort(F.collect_set("item")).alias("items"))


def _blocks(tokens: int, size: int):
    """Arrow function: the blocks of a transaction, of ``size`` items at most; each ``tokens`` items share one of them."""
    width = max(1, size // tokens)

    @F.pandas_udf("array<array<string>>")
    def of(batch: pd.Series) -> pd.Series:
        out = []
        for items in batch:
            items = list(items)
            parts = [items[i : i + width] for i in range(0, len(items), width)]
            out.append([items] if len(items) <= size else [sum(x, []) for x in combinations(parts, tokens)])
        return pd.Series(out)

    return of


def _counted(baskets: DataFrame, sets: DataFrame, tokens: int) -> DataFrame:
    """``sets`` (items, label) with how many whole transactions have all of each."""
    n = F.size("items")
    combos = F.array().cast("array<array<string>>")
    for k in range(1, tokens + 1):
        grown = F.transform("items", lambda x: F.array(x))
        for _ in range(k - 1):
            grown = F.flatten(F.transform(grown, lambda c: F.transform(F.filter("items", lambda x: x > F.element_at(c, -1)), lambda x: F.concat(c, F.array(x)))))  # noqa: B023
        combos = F.concat(combos, grown)
    # Copies of a transaction are counted first, so that one that repeats is taken apart once.
    kinds = baskets.where(n > 0).groupBy("items", "label").agg(F.count("*").alias("times"))
    each = kinds.select("label", "times", F.explode(combos).alias("items"))
    both = each.unionByName(each.withColumn("label", F.lit("")))
    freq = both.groupBy("items", "label").agg(F.sum("times").alias("freq"))
    return sets.join(freq.hint("merge"), ["items", "label"])


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, tokens: int = TOKENS, grouped: int = GROUPED) -> Mined:
    """Rules from rows of ``url`` and ``good`` (boolean): items, verdict, confidence, freq, and their place, surest first.

    Ties go by more support, fewer items, then by text. Rows with a null url or label teach nothing; repeated rows count
    each time. No rows: no rules.
    """
    known = labelled.where("url is not null and good is not null")
    rows = written(known.select(url_tokens(F.col("url")).alias("tokens"), F.when(F.col("good"), _GOOD).otherwise(_BAD).alias("label")).withColumn("row", F.monotonically_increasing_id()))
    n = rows.count()
    spark = labelled.sparkSession
    if not n:
        return Mined(spark.createDataFrame([], _RULE), spark.createDataFrame([], "token string, item string"))
    least = -(-int(round(support * n * 1e9)) // 10**9)  # as many rows as the support asks for
    # Tokens that occur in the same rows are told by the number of these and two sums of hashes of them.
    mark = lambda seed: F.sum(F.xxhash64("row", F.lit(seed)).cast("decimal(38,0)"))
    where = rows.select("row", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), mark(1).alias("a"), mark(2).alias("b")).where(F.col("n") >= least)
    same = Window.partitionBy("n", "a", "b")
    items = written(where.select("token", F.min("token").over(same).alias("item")))
    baskets = written(rows.select("row", "label").join(_with_items(rows, items, "row").hint("merge"), "row", "left").select("label", F.coalesce("items", F.array().cast("array<string>")).alias("items")))
    many = baskets.where(F.size("items") > grouped).limit(1).count() > 0
    transactions = baskets.select("label", F.explode(_blocks(tokens, grouped)("items")).alias("items")) if many else baskets
    found = FPGrowth(itemsCol="items", minSupport=least / transactions.count() * (1 - 1e-12), minConfidence=confidence).fit(written(transactions.select(F.concat("items", F.array("label")).alias("items")))).freqItemsets
    plain = F.array_sort(F.filter("items", lambda x: ~x.isin(_GOOD, _BAD)))
    told = F.coalesce(F.get(F.filter("items", lambda x: x.isin(_GOOD, _BAD)), F.lit(0)), F.lit(""))
    sets = written(found.where(F.size("items") <= tokens + 1).select(plain.alias("items"), told.alias("label"), "freq").where((F.size("items") > 0) & (F.size("items") <= tokens)))
    if many:
        sets = written(_counted(baskets, sets.drop("freq"), tokens).where(F.col("freq") >= least))
    alone = sets.where("label = ''").select("items", F.col("freq").alias("total"))
    sure = F.col("freq") / F.col("total")
    rules = written(sets.where("label <> ''").join(alone.hint("merge"), "items").where(sure >= confidence).select("items", F.substring("label", 2, 5).alias("verdict"), sure.alias("confidence"), "freq"))
    return Mined(_pruned(rules, tokens), items)


def _pruned(rules: DataFrame, tokens: int) -> DataFrame:
    """Rules without those of which a part already decides the same at least as surely, with their place."""
    parts = F.transform("items", lambda x: F.array(x))
    if tokens > 2:  # of three or more items: all but one, and so on down, are parts of parts that were kept or beaten
        parts = F.concat(parts, *[F.filter(F.transform("items", lambda x: F.filter("items", lambda y: y != x)), lambda p: F.size(p) > 1)])
    for _ in range(tokens - 3):
        parts = F.array_distinct(F.concat(parts, F.flatten(F.transform(parts, lambda p: F.transform(p, lambda x: F.filter(p, lambda y: y != x))))))
    part = rules.where(F.size("items") > 1).select(F.col("items").alias("whole"), "verdict", F.col("confidence").alias("own"), F.explode(parts).alias("items"))
    beaten = part.join(rules.hint("merge"), ["items", "verdict"]).where(F.col("confidence") >= F.col("own")).select(F.col("whole").alias("items"), "verdict").distinct()
    kept = written(rules.join(beaten.hint("merge"), ["items", "verdict"], "left_anti"))
    order = [F.desc("confidence"), F.desc("freq"), F.size("items"), F.col("items"), F.col("verdict")]
    # Places by sorted partitions: each row's place within its own, after the rows of those before it.
    sorted_ = written(kept.orderBy(*order).withColumn("id", F.monotonically_increasing_id()))
    part_of = F.shiftright("id", 33)
    sizes = written(sorted_.groupBy(part_of.alias("p")).agg(F.count("*").alias("n")))
    before = sizes.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"))  # one row a partition
    placed = sorted_.withColumn("p", part_of).join(F.broadcast(before), "p")
    return written(placed.select("items", "verdict", "confidence", "freq", (F.col("before") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).cast("int").alias("place")))


_FOUND = "struct<rule: string, verdict: string, confidence: double>"


def _matcher(shared):
    """Arrow function: the surest rule whose items are all there, each stood for by any of its tokens."""

    @F.pandas_udf("rule string, verdict string, confidence double")
    def first_rule(batch: pd.Series) -> pd.DataFrame:
        rules, index, items = shared.value
        out = []
        for tokens in batch:
            left: dict[int, int] = {}
            best = len(rules)
            for t in {items[t] for t in tokens if t in items} if tokens is not None else ():
                for r in index.get(t, ()):
                    if r >= best:
                        break  # entries are in order of sureness
                    left[r] = left.get(r, 0) + 1
                    if left[r] == len(rules[r][0]):
                        best = r
                        break
            out.append((" + ".join(rules[best][0]), *rules[best][1:]) if best < len(rules) else (None, None, None))
        return pd.DataFrame(out, columns=["rule", "verdict", "confidence"])

    return first_rule


def _matched(seen: DataFrame, mined: Mined, few: int) -> DataFrame:
    """``seen`` (written: row, tokens and more) with ``m``, the surest mined rule that fits; null if none does."""
    n, m = mined.rules.count(), mined.items.count()
    if not n:
        return seen.withColumn("m", F.lit(None).cast(_FOUND))
    if max(n, m) <= few:
        rules = [(tuple(r["items"]), r.verdict, r.confidence) for r in mined.rules.orderBy("place").collect()]
        index: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            for t in r[0]:
                index.setdefault(t, []).append(i)
        items = {r.token: r["item"] for r in mined.items.collect() if r["item"] in index}
        return seen.withColumn("m", _matcher(seen.sparkSession.sparkContext.broadcast((rules, index, items)))("tokens"))
    own = _with_items(seen.select("row", "tokens"), mined.items, "row").select("row", F.explode("items").alias("item"))
    entries = mined.rules.select("place", F.size("items").alias("size"), F.explode("items").alias("item"))
    whole = own.join(entries.hint("merge"), "item").groupBy("row", "place", "size").agg(F.count("*").alias("hit")).where("hit = size")
    best = whole.groupBy("row").agg(F.min("place").alias("place"))
    rule = mined.rules.select("place", F.struct(F.array_join("items", " + ").alias("rule"), "verdict", "confidence").alias("m"))
    return seen.join(written(best.join(rule.hint("merge"), "place").select("row", "m")).hint("merge"), "row", "left")


def judge(urls: DataFrame, labelled: DataFrame, key: str = "page_id", given: tuple[Given, ...] = GIVEN, default: str = "allow", few: int = RULES, **mining) -> DataFrame:
    """key, host, path, rule, verdict, and mined_rule, confidence for URLs that no given rule fits.

    ``urls`` has the key and ``url``; ``labelled`` as for ``mine``. The longest given rule that fits decides; else the
    surest mined rule (ties: more support, fewer items, then by text); else ``default``. Null URLs and URLs without
    ``://`` have empty host and path, no tokens and the default. Repeated rows: a row each. No rows: none. Other columns
    are not read. Beyond ``few`` rules or tokens these are joined and not broadcast.
    """
    mined = mine(labelled, **mining)
    host, path = host_and_path(F.col("url"))
    seen = urls.select(F.col(key), "url", host.alias("host"), path.alias("path"))
    seen = seen.select(key, "host", "path", given_rule(F.col("host"), F.col("path"), given).alias("given"), F.when(F.col("host") != "", url_tokens(F.col("url"))).alias("tokens"))
    seen = seen.withColumn("tokens", F.when(F.col("given").isNull(), F.col("tokens")))
    if max(mined.rules.count(), mined.items.count()) > few:
        seen = written(seen.withColumn("row", F.monotonically_increasing_id()))
    return _matched(seen, mined, few).select(
        key, "host", "path", F.col("given.rule").alias("rule"), F.coalesce("given.verdict", "m.verdict", F.lit(default)).alias("verdict"), F.col("m.rule").alias("mined_rule"), F.col("m.confidence").alias("confidence")
    )


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url and good of pages whose document, numbered at the end of their path, has labels: quality 1 and toxic 0."""
    number = F.regexp_extract(F.col("url"), r"://[^/?#]*/(?:[^?#]*/)?(\d{1,18})(?:\.\w+)?/?(?:[?#].*)?$", 1)
    of = labels.groupBy("doc_id").agg(F.min(F.when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), (F.coalesce("quality", F.lit(1)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0))).alias("good"))
    return pages.select("url", number.try_cast("long").alias("doc_id")).join(of.hint("merge"), "doc_id").select("url", "good")
