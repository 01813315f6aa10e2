"""Catalogue queries: sources, sinks, upserts, scalar functions, joins and summaries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from melodex.functions import text as T
from melodex.operators import catalogue as C
from melodex.operators import features, rerank, statistics
from melodex.sources import files
from melodex.sources.scratch import scratch

from .registry import query, table

SONG = "song AS (SELECT c_custkey AS id, c_name AS title, 'artist'||c_nationkey AS artist, c_mktsegment AS category, (c_custkey%4<>0)::INT AS processed, c_custkey%97 AS created_at, c_acctbal AS energy FROM customer)"


def song(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.concat(F.lit("artist"), F.col("c_nationkey")).alias("artist"), F.col("c_mktsegment").alias("category"),
        (F.col("c_custkey") % 4 != 0).cast("int").alias("processed"), (F.col("c_custkey") % 97).alias("created_at"), F.col("c_acctbal").alias("energy"),
    )


RAW_SQL = "raw AS (SELECT p_partkey, CASE p_partkey%7 WHEN 0 THEN '  ' ELSE p_name END AS title, CASE p_partkey%11 WHEN 0 THEN '' ELSE p_brand END AS artist, CASE p_partkey%5 WHEN 0 THEN 'NaN' WHEN 1 THEN 'None' ELSE p_type END AS category, CASE p_partkey%6 WHEN 0 THEN '-5' WHEN 1 THEN '15.7' WHEN 2 THEN 'abc' WHEN 3 THEN 'inf' WHEN 4 THEN ' '||p_size ELSE NULL END AS clip_start FROM part)"


def raw(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    clip = F.when(k % 6 == 0, "-5").when(k % 6 == 1, "15.7").when(k % 6 == 2, "abc").when(k % 6 == 3, "inf").when(k % 6 == 4, F.concat(F.lit(" "), F.col("p_size").cast("string")))
    return table(spark, d, "part").select(
        k, F.when(k % 7 == 0, "  ").otherwise(F.col("p_name")).alias("title"), F.when(k % 11 == 0, "").otherwise(F.col("p_brand")).alias("artist"),
        F.when(k % 5 == 0, "NaN").when(k % 5 == 1, "None").otherwise(F.col("p_type")).alias("category"), clip.alias("clip_start"),
    )


@query("SELECT p_partkey::VARCHAR AS title, p_brand AS artist, p_type AS category, NULL::VARCHAR AS youtube_url, p_size::VARCHAR AS clip_start FROM part")
def scan_catalogue_csv(spark, d):
    path = scratch(spark)
    table(spark, d, "part").select(F.col("p_partkey").alias("title"), F.col("p_brand").alias("artist"), F.col("p_type").alias("category"), F.lit(None).cast("string").alias("youtube_url"), F.col("p_size").alias("clip_start")).write.option("header", True).csv(path)
    return files.read_catalogue(spark, path)


@query(f"WITH {SONG} SELECT id, title, category, created_at FROM song WHERE processed=1")
def scan_songs(spark, d):
    return song(spark, d).where("processed = 1").select("id", "title", "category", "created_at").orderBy("created_at", "id")


@query(f"WITH {SONG} SELECT id, title, artist, category FROM song WHERE id=42")
def lookup_song(spark, d):
    return song(spark, d).where("id = 42").select("id", "title", "artist", "category")


@query(f"WITH {SONG} SELECT id, title FROM song WHERE category='BUILDING' AND processed=1")
def songs_by_category(spark, d):
    return song(spark, d).where("category = 'BUILDING' and processed = 1").orderBy("created_at", "id").select("id", "title")


@query("SELECT event_id, coalesce(json_extract_string(props,'$.k')::INT,0) AS k, 100.0::DOUBLE AS tempo FROM events")
def scan_features_json(spark, d):
    path = scratch(spark)
    table(spark, d, "events").select(F.to_json(F.struct("event_id", F.from_json("props", "k int").alias("features"))).alias("value")).write.text(path)
    f = files.read_features(spark, path, "event_id long, features struct<k: int, tempo: double>")
    return f.select("event_id", F.coalesce("features.k", F.lit(0)).alias("k"), F.coalesce("features.tempo", F.lit(100.0)).alias("tempo"))


@query("SELECT s_suppkey AS song_id, s_suppkey%5<>0 AND s_suppkey%7<>0 AS found, CASE WHEN s_suppkey%5<>0 AND s_suppkey%7<>0 THEN s_acctbal END AS tempo, CASE WHEN s_suppkey%5<>0 AND s_suppkey%7<>0 THEN 3 ELSE 0 END::INT AS n FROM supplier")
def scan_feature_documents(spark, d):
    """An indented document a song, in a file of its name; some songs have none, and some files are no JSON."""
    path = scratch(spark)
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal").where("s_suppkey % 5 <> 0")
    doc = F.to_json(F.struct(F.col("s_acctbal").alias("tempo"), F.array(F.lit(1.0), F.col("s_acctbal"), F.lit(3.0)).alias("profile"), F.lit("more").alias("other")), {"pretty": "true"})
    # Spark names its own files: the folder says the song's name here, and a song's path leads there.
    files.write_files(s.select("s_suppkey", F.when(F.col("s_suppkey") % 7 == 0, "{ no JSON").otherwise(doc).alias("value")), path, "s_suppkey")
    name = F.regexp_extract(F.col("_metadata.file_path"), r"s_suppkey=(\d+)/", 1)
    songs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("song_id"))
    f = files.features_of(songs, path, "tempo double, profile array<double>", name)
    return f.select("song_id", "found", "features.tempo", F.coalesce(F.size("features.profile"), F.lit(0)).alias("n"))


@query("WITH p AS (SELECT 'grp='||page_id%3 AS grp, 'label='||split_part(url,'/',-2) AS label, dense_rank() OVER (ORDER BY split_part(url,'/',-2))-1 AS label_id FROM pages) SELECT grp, label, label_id, count(*) AS n FROM p GROUP BY ALL")
def scan_labelled_files(spark, d):
    """A file a page, in folders by group and label."""
    path = scratch(spark)
    p = table(spark, d, "pages").select((F.col("page_id") % 3).alias("grp"), F.element_at(F.split("url", "/"), -2).alias("label"), F.col("page_id").cast("string").alias("value"))
    files.write_files(p, path, "grp", "label")
    return files.labelled_files(spark, path, "*.txt").groupBy("grp", "label", "label_id").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS song_id, len(embedding)::INT AS n FROM part JOIN embeddings ON vec_id=p_partkey")
def scan_vectors(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("song_id"), F.size("embedding").alias("n"))
    return v.join(table(spark, d, "part").select(F.col("p_partkey").alias("song_id")), "song_id", "left_semi")


FLAT = "flat AS (SELECT l_orderkey AS anchor_id, l_partkey AS song_id, max(l_linenumber%3)::INT AS grade FROM lineitem GROUP BY ALL)"


def _flat(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("anchor_id"), F.col("l_partkey").alias("song_id")).agg(F.max(F.col("l_linenumber") % 3).alias("grade"))


@query(f"WITH {FLAT} SELECT 'grades by line number' AS readme, anchor_id, (row_number() OVER (PARTITION BY anchor_id ORDER BY song_id))::INT-1 AS pos, song_id, grade FROM flat")
def scan_judgments(spark, d):
    path = scratch(spark)
    files.nest_judgments(_flat(spark, d)).select(F.lit("grades by line number").alias("_readme"), F.array(F.struct("anchor_id", F.lit("").alias("note"), "judgments")).alias("anchors")).write.json(path)
    j = files.read_judgments(spark, path, lines=True)
    return j.select("readme", F.col("anchor_id").cast("long").alias("anchor_id"), "pos", F.col("song_id").cast("long").alias("song_id"), "grade")


@query(f"WITH {FLAT} SELECT anchor_id, count(*) AS n, max(grade) AS best FROM flat GROUP BY anchor_id")
def sink_judgments_json(spark, d):
    path = scratch(spark)
    files.nest_judgments(_flat(spark, d)).write.json(path)
    back = spark.read.schema("anchor_id long, judgments array<struct<song_id: long, grade: int>>").json(path)
    return back.select("anchor_id", F.size("judgments").cast("long").alias("n"), F.array_max("judgments.grade").alias("best"))


@query("SELECT page_id, split_part(url,'/',-3) AS grp, split_part(url,'/',-2) AS label, dense_rank() OVER (ORDER BY split_part(url,'/',-2))-1 AS label_id FROM pages")
def scan_labelled_paths(spark, d):
    return files.labelled_paths(table(spark, d, "pages").select("page_id", "url"), "url").select("page_id", "grp", "label", "label_id")


@query("SELECT event_id, value, event_type='click' AS clicked FROM events")
def sink_features_json(spark, d):
    path = scratch(spark)
    files.write_features(table(spark, d, "events").select("event_id", "value", (F.col("event_type") == "click").alias("clicked")), path)
    return files.read_features(spark, path, "event_id long, value double, clicked boolean")


@query("SELECT 'raw' AS store, vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)),4) AS total FROM embeddings UNION ALL SELECT 'final', vec_id, round(list_sum(list_transform(embedding[1:8], lambda x: x::DOUBLE)),4) FROM embeddings")
def sink_vectors(spark, d):
    path, e = scratch(spark), table(spark, d, "embeddings").select("vec_id", "embedding")
    files.write_vectors(e, e.withColumn("embedding", F.slice("embedding", 1, 8)), path)
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 4).alias("total")
    back = lambda s: spark.read.parquet(f"{path}/{s}").select(F.lit(s).alias("store"), "vec_id", total)
    return back("raw").unionByName(back("final"))


@query(f"WITH {RAW_SQL}, e AS (SELECT title, CASE WHEN trim(title)='' THEN 'missing title' WHEN trim(artist)='' THEN 'missing artist' END AS error FROM raw) SELECT title, error FROM e WHERE error IS NOT NULL")
def sink_failures_csv(spark, d):
    path = scratch(spark)
    files.write_failures(C.required_fields(raw(spark, d), "title", "artist"), path)
    return spark.read.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


@query(f"WITH {SONG}, n AS (SELECT o_custkey AS id, o_orderkey AS seq, o_orderpriority AS title, 'x'||o_orderkey AS artist FROM orders WHERE o_custkey%3=0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC)=1) SELECT id, title, artist, category FROM song WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT id, title, artist, NULL FROM n")
def upsert_songs(spark, d):
    new = table(spark, d, "orders").where("o_custkey % 3 = 0").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("title"), F.concat(F.lit("x"), F.col("o_orderkey")).alias("artist"))
    return C.upsert(song(spark, d).select("id", "title", "artist", "category"), new, "id", "seq")


@query(f"WITH {SONG} SELECT id, CASE WHEN id%5=0 THEN 'C'||id ELSE title END AS title, CASE WHEN id%5<>0 AND id%2<>0 THEN category WHEN id%10=0 THEN NULL WHEN id%2=0 THEN 'a, b' ELSE category END AS category FROM song")
def patch_metadata(spark, d):
    s = song(spark, d).select("id", "title", "category")
    i = F.col("id")
    genre = F.when(i % 10 == 0, F.array().cast("array<string>")).when(i % 2 == 0, F.array(F.lit("a"), F.lit("b")))
    new = s.select("id", F.when(i % 5 == 0, F.concat(F.lit("C"), i)).alias("title"), genre.alias("category")).where("id % 5 = 0 or id % 2 = 0")
    return C.patch(s, new, "id", lists=("category",))


@query(f"WITH {SONG} SELECT id, CASE WHEN id IN (SELECT o_custkey FROM orders WHERE o_orderstatus='F') THEN 1 ELSE processed END AS processed FROM song")
def patch_flags_path(spark, d):
    ids = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    return C.flag(song(spark, d).select("id", "processed"), ids, "id", "processed", F.lit(1))


@query("SELECT s_suppkey AS id, s_name AS title, 0::INT AS lyrics_missing, NULL::VARCHAR AS composer FROM supplier")
def migrate_schema(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"))
    return C.migrate(C.migrate(s, {"lyrics_missing": ("int", 0), "composer": ("string", None)}), {"lyrics_missing": ("int", 9)})


@query("SELECT p_partkey, substr(regexp_replace(lower(p_name||'_'||p_brand||' - '||p_type),'[^\\p{L}\\p{N}_]','_','g'),1,50) AS song_id FROM part")
def make_song_id(spark, d):
    return table(spark, d, "part").select("p_partkey", T.make_song_id(F.col("p_name"), F.concat("p_brand", F.lit(" - "), "p_type")).alias("song_id"))


@query(f"WITH {RAW_SQL} SELECT p_partkey, CASE WHEN lower(trim(title)) IN ('','nan','none') THEN NULL ELSE trim(title) END AS title, CASE WHEN lower(trim(category)) IN ('','nan','none') THEN 'unknown' ELSE trim(category) END AS category FROM raw")
def null_tokens(spark, d):
    return raw(spark, d).select("p_partkey", T.null_tokens(F.col("title")).alias("title"), T.null_tokens(F.col("category"), "unknown").alias("category"))


@query(f"WITH {RAW_SQL}, n AS (SELECT p_partkey, try_cast(trim(clip_start) AS DOUBLE) AS x FROM raw) SELECT p_partkey, CASE WHEN x IS NULL OR isinf(x) OR isnan(x) THEN 15 ELSE greatest(0,trunc(x))::INT END::INT AS start FROM n")
def parse_clip_start(spark, d):
    return raw(spark, d).select("p_partkey", T.parse_clip_start(F.col("clip_start")).alias("start"))


@query(f"WITH {RAW_SQL} SELECT p_partkey, CASE WHEN trim(title)='' THEN 'missing title' WHEN trim(artist)='' THEN 'missing artist' END AS error FROM raw")
def required_fields(spark, d):
    return C.required_fields(raw(spark, d), "title", "artist").select("p_partkey", "error")


LYRICS = "b AS (SELECT doc_id, CASE WHEN doc_id%3=0 THEN 'Song Lyrics'||chr(10) ELSE '' END || replace(text,'. ',repeat(chr(10),4)) || CASE WHEN doc_id%2=0 THEN '543Embed' ELSE '' END AS t FROM documents), e AS (SELECT doc_id, regexp_replace(regexp_replace(t,'^\\s+|\\s+$','','g'),'\\d+Embed$','') AS t FROM b), l AS (SELECT doc_id, regexp_replace(regexp_replace(t,'(?i)\\A[^\\n]*lyrics(?:\\n|\\z)',''),'^\\s+|\\s+$','','g') AS t FROM e)"


@query(f"WITH {LYRICS} SELECT doc_id, regexp_replace(regexp_replace(t,'\\n{{3,}}',chr(10)||chr(10),'g'),'^\\s+|\\s+$','','g') AS lyrics FROM l")
def clean_lyrics(spark, d):
    """Whole documents as lyrics, with a title line and a trailing mark added to some."""
    t = F.col("text")
    body = F.concat(F.when(F.col("doc_id") % 3 == 0, "Song Lyrics\n").otherwise(""), F.replace(t, F.lit(". "), F.lit("\n\n\n\n")), F.when(F.col("doc_id") % 2 == 0, "543Embed").otherwise(""))
    return table(spark, d, "documents").select("doc_id", T.clean_lyrics(body).alias("lyrics"))


@query("SELECT conv_id, turn, (trim(CASE WHEN conv_id%4=0 THEN '  ' ELSE coalesce(text,'') END)='')::INT AS missing FROM conversations")
def lyrics_missing_flag(spark, d):
    t = F.when(F.col("conv_id") % 4 == 0, "  ").otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.lyrics_missing(t).alias("missing"))


WORDS = {"en": ["the", "and", "ing", "with"], "fr": ["le ", "des", "que", "pour"], "de": ["der", "und", "ich", "sch"], "es": ["los", "las", "ción", "por"]}
HITS = ", ".join("(" + "+".join(f"(length(t)-length(replace(t,'{w}','')))//{len(w)}" for w in ws) + f") AS {k}" for k, ws in WORDS.items())
MOOD = f"h AS (SELECT doc_id, {HITS} FROM (SELECT doc_id, lower(text) AS t FROM documents)), m AS (SELECT doc_id, CASE WHEN g=0 OR (en=g)::INT+(fr=g)::INT+(de=g)::INT+(es=g)::INT>1 THEN NULL WHEN en=g THEN 'en' WHEN fr=g THEN 'fr' WHEN de=g THEN 'de' ELSE 'es' END AS mood FROM (SELECT *, greatest(en,fr,de,es) AS g FROM h))"


@query(f"WITH {MOOD} SELECT doc_id, mood FROM m")
def mood_tag(spark, d):
    return table(spark, d, "documents").select("doc_id", T.mood_tag(F.col("text"), WORDS).alias("mood"))


@query(f"WITH {MOOD} SELECT mood, count(*) AS n FROM m WHERE mood IS NOT NULL GROUP BY mood")
def mood_distribution(spark, d):
    return C.tag_distribution(mood_tag(spark, d), "mood")


@query(f"WITH {MOOD}, r AS (SELECT doc_id, doc_id%11=0 AS had, doc_id%7=0 AS blank, mood FROM m JOIN documents USING (doc_id)) SELECT count_if(NOT had AND NOT blank) AS recovered, count_if(had) AS skipped, count_if(NOT had AND blank) AS none, count_if(NOT had AND NOT blank AND mood IS NOT NULL) AS tagged FROM r")
def mood_totals(spark, d):
    """Totals of a tagging run, counted while it writes: some documents are done already, some are blank."""
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, " \n\t").otherwise(F.col("text")).alias("text"))
    totals = C.tag_run(docs, scratch(spark), "doc_id", "text", T.mood_tag(F.col("text"), WORDS), docs.where("doc_id % 11 = 0"))
    return spark.createDataFrame([totals], "recovered long, skipped long, none long, tagged long")


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name||'! '||p_brand),'[^\\p{L}\\p{N}\\s]','','g')) AS name FROM part")
def normalise_text(spark, d):
    return table(spark, d, "part").select("p_partkey", T.normalise_text(F.concat("p_name", F.lit("! "), "p_brand")).alias("name"))


@query("SELECT event_id, CASE WHEN value/100>=0.4 THEN 2 WHEN value/100>=0.1 THEN 1 ELSE 0 END::INT AS grade FROM events")
def grade_from_match(spark, d):
    return table(spark, d, "events").select("event_id", T.grade_from_match(F.col("value") / 100).alias("grade"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey%7=0 THEN NULL ELSE year(o_orderdate)::VARCHAR END AS year FROM orders")
def parse_year(spark, d):
    t = F.when(F.col("o_orderkey") % 7 == 0, "+x013-00").otherwise(F.concat(F.lit("+"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    return table(spark, d, "orders").select("o_orderkey", T.parse_year(t).cast("string").alias("year"))


DESC = "des AS (SELECT p_partkey, p_brand, CASE p_partkey%5 WHEN 0 THEN 'Song composed by '||p_brand WHEN 1 THEN 'single by '||p_brand WHEN 2 THEN 'vocal track, album' WHEN 3 THEN NULL ELSE p_type END AS description FROM part)"
SCORE = f"{DESC}, sc AS (SELECT p_partkey, p_brand, contains(x,'composed by') OR contains(x,'written by') OR contains(x,'written and composed') AS st, contains(x,'song') OR contains(x,'single') OR contains(x,'soundtrack') OR contains(x,'album') AS wk, contains(x,'vocal track') AS pn, contains(x,lower(p_brand)) AS ar FROM (SELECT *, lower(coalesce(description,'')) AS x FROM des)), scored AS (SELECT p_partkey, p_brand, 5*st::INT+2*wk::INT-3*pn::INT+ar::INT AS score, st OR (wk AND ar) AS accept FROM sc)"


def _scored(spark, d) -> DataFrame:
    k = F.col("p_partkey") % 5
    p = table(spark, d, "part")
    desc = F.when(k == 0, F.concat(F.lit("Song composed by "), "p_brand")).when(k == 1, F.concat(F.lit("single by "), "p_brand")).when(k == 2, "vocal track, album").when(k == 4, F.col("p_type"))
    score, accept = T.record_score(desc, F.col("p_brand"))
    return p.select("p_partkey", "p_brand", score.alias("score"), accept.alias("accept"))


@query(f"WITH {SCORE} SELECT p_partkey, score::INT AS score, accept FROM scored")
def record_score(spark, d):
    return _scored(spark, d).drop("p_brand")


@query(f"WITH {SCORE}, b AS (SELECT p_brand, p_partkey FROM scored WHERE accept QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey)=1) SELECT p_brand, b.p_partkey AS best FROM (SELECT DISTINCT p_brand FROM part) LEFT JOIN b USING (p_brand)")
def best_record(spark, d):
    return C.best_record(_scored(spark, d), "p_brand", "p_partkey")


@query("SELECT c_custkey, c_nationkey%3<>0 OR c_custkey%2=0 AS enriched FROM customer")
def already_enriched(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 3 != 0, "x").alias("composer"), F.when(F.col("c_custkey") % 2 == 0, "y").otherwise("").alias("genre"))
    return c.select("c_custkey", C.already_enriched("composer", "genre").alias("enriched"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey%4<>0)")
def skip_processed(spark, d):
    done = song(spark, d).where("processed = 1").select(F.col("id").alias("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(done, "o_custkey", "left_anti")


@query("SELECT f.p_name AS title, c.p_partkey, c.p_brand AS artist FROM (SELECT DISTINCT p_name FROM part WHERE p_partkey%40=0) f LEFT JOIN part c ON f.p_name=c.p_name")
def retry_failed_join(spark, d):
    p = table(spark, d, "part").select(F.col("p_name").alias("title"), "p_partkey", F.col("p_brand").alias("artist"))
    return C.retry_failed(p.where("p_partkey % 40 = 0").select("title").distinct(), p)


@query("SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT p_partkey FROM part) AND vec_id IN (SELECT doc_id FROM documents)")
def complete_artifacts(spark, d):
    e = table(spark, d, "embeddings").select("vec_id")
    return e.join(table(spark, d, "part").select(F.col("p_partkey").alias("vec_id")), "vec_id", "left_semi").join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")


@query("WITH q AS (SELECT DISTINCT o_custkey, o_orderkey%40 AS qid, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderkey%40) AS pos FROM orders) SELECT o_custkey, string_agg(n_name, ', ' ORDER BY pos) AS labels, arg_min(n_name,pos) AS first FROM q JOIN nation ON n_nationkey=qid GROUP BY o_custkey")
def resolve_labels(spark, d):
    """Ids (an order's number) to names: repeats removed, order kept, unnamed ones dropped."""
    q = table(spark, d, "orders").select("o_custkey", (F.col("o_orderkey") % 40).alias("id"), F.col("o_orderkey").alias("pos"))
    return C.resolve_labels(q, table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")), "o_custkey")


@query(f"WITH {SONG} SELECT count(*) AS total, sum(coalesce(CASE WHEN id%3=0 THEN processed END,0))::BIGINT AS flagged, sum((id%5=0)::INT)::BIGINT AS fifth FROM song")
def flag_summary(spark, d):
    s = song(spark, d)
    return s.agg(F.count("*").alias("total"), F.coalesce(F.sum(F.when(F.col("id") % 3 == 0, F.col("processed"))), F.lit(0)).alias("flagged"), F.coalesce(F.sum((F.col("id") % 5 == 0).cast("int")), F.lit(0)).alias("fifth"))


@query(f"WITH {SONG} SELECT DISTINCT category FROM song WHERE processed=1")
def distinct_categories(spark, d):
    return song(spark, d).where("processed = 1").select("category").distinct().orderBy("category")


@query("SELECT CASE WHEN o_orderkey%11=0 THEN 'failed' WHEN c_custkey IS NULL THEN 'no_match' WHEN c_acctbal>5000 THEN 'enriched' WHEN c_acctbal>0 THEN 'skipped' ELSE 'matched_empty' END AS status, count(*) AS n FROM orders LEFT JOIN customer ON c_custkey=o_custkey+100 GROUP BY ALL")
def status_counts(spark, d):
    c = table(spark, d, "customer").select((F.col("c_custkey") - 100).alias("o_custkey"), "c_acctbal")
    s = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left")
    balance = F.col("c_acctbal")
    return C.status_counts(s, F.col("o_orderkey") % 11 == 0, balance.isNotNull(), balance > 5000, balance > 0)


@query("SELECT min(value) AS low, (SELECT value FROM (SELECT value, row_number() OVER (ORDER BY value)-1 AS r, count(*) OVER () AS n FROM events) WHERE r=n//2) AS median, max(value) AS high, count(*) AS n FROM events")
def match_distribution(spark, d):
    """The median is the upper one of an even number."""
    e = table(spark, d, "events").select("value")
    half = statistics.kth_smallest(e, "value", e.count() // 2)
    return e.agg(F.min("value").alias("low"), F.lit(half).cast("double").alias("median"), F.max("value").alias("high"), F.count("*").alias("n"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 30 OFFSET 20")
def row_slice(spark, d):
    return C.row_slice(table(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"], 20, 30)


@query("SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first FROM orders WHERE o_orderpriority<>'' GROUP BY ALL")
def dedupe_keep_order(spark, d):
    """Of each customer's priorities the first mention stays."""
    return C.dedupe_keep_order(table(spark, d, "orders"), "o_custkey", "o_orderpriority", "o_orderkey")


@query("SELECT song_id, count(DISTINCT key) AS n FROM (SELECT lower(regexp_replace(p_name,'[^\\p{L}\\p{N}_]','_','g')) AS song_id, p_name||'|'||p_brand AS key FROM part) GROUP BY song_id HAVING count(DISTINCT key)>1")
def id_collisions(spark, d):
    return C.id_collisions(table(spark, d, "part"), F.lower(F.regexp_replace("p_name", r"[^\p{L}\p{N}_]", "_")), F.concat_ws("|", "p_name", "p_brand"))


BUCKET = "CASE WHEN tempo<80 THEN '1000' WHEN tempo<100 THEN '0100' WHEN tempo<120 THEN '0010' ELSE '0001' END"
DEFAULTED = f"dr AS (SELECT vec_id, coalesce(p_size*3+60, 100)::DOUBLE AS tempo, coalesce(p_retailprice/2000, 0.5) AS energy, CASE WHEN p_partkey%3=0 THEN '0010' END AS kept, CASE WHEN p_partkey IS NULL THEN 0 ELSE p_size END AS pcp, vec_id%5=0 AS missing, embedding FROM embeddings LEFT JOIN part ON p_partkey=vec_id)"


@query(f"WITH {DEFAULTED} SELECT vec_id, tempo, energy, coalesce(kept, {BUCKET}) AS bucket, pcp::DOUBLE*3 AS pcp, missing, CASE WHEN missing THEN 0.0 ELSE round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)),4) END::DOUBLE AS total, len(embedding)::INT AS n FROM dr")
def feature_defaults(spark, d):
    """Scalars, arrays, buckets of a wrong length, and vectors that are missing (every fifth), with what stands for them."""
    k = F.col("p_partkey")
    bucket = F.when(k % 3 == 0, F.array(*map(F.lit, (0, 0, 1, 0)))).when(k % 3 == 1, F.array(F.lit(1), F.lit(0)))
    p = table(spark, d, "part").select(k.alias("vec_id"), (F.col("p_size") * 3 + 60).cast("double").alias("tempo"), (F.col("p_retailprice") / 2000).alias("energy"), bucket.alias("tempo_bucket"), F.array_repeat(F.col("p_size").cast("double"), 3).alias("pcp"))
    e = table(spark, d, "embeddings").select("vec_id", F.size("embedding").alias("n"), F.when(F.col("vec_id") % 5 != 0, F.col("embedding")).alias("vec"))
    j = features.with_defaults(e.join(p, "vec_id", "left"), {"pcp": 3})
    vec, missing = features.vector_or_zeros(F.col("vec"), 64)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return j.select("vec_id", "tempo", "energy", F.array_join(F.col("tempo_bucket").cast("array<string>"), "").alias("bucket"), total("pcp").alias("pcp"), missing.alias("missing"), F.round(total(vec), 4).alias("total"), F.size(vec).alias("n"))


@query("SELECT label, count(*) AS n, greatest(2, least(256, count(*)//3, 64))::BIGINT AS components, count(*)<200 AS skipped FROM embeddings GROUP BY label")
def adaptive_components(spark, d):
    g = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return g.withColumn("components", F.expr("greatest(2L, least(256L, n div 3, 64L))")).withColumn("skipped", F.col("n") < 200)


@query("SELECT user_id, CASE WHEN user_id%3=0 THEN 0.15 WHEN user_id%3=1 THEN 0.3 ELSE 0.15 END::DOUBLE AS artist, CASE WHEN user_id%3=2 THEN 0.0 ELSE max(value)/1000 END::DOUBLE AS tempo, CASE WHEN user_id%3=1 THEN 0.25 ELSE 0.0 END::DOUBLE AS mood, 0.0::DOUBLE AS lyric FROM events GROUP BY user_id")
def weight_overrides(spark, d):
    """Texts of NAME=VALUE pairs for each user, some of none: several names, some twice, merged over the defaults."""
    g = table(spark, d, "events").groupBy("user_id").agg((F.max("value") / 1000).cast("string").alias("t"))
    u = F.col("user_id") % 3
    text = F.when(u == 0, F.concat(F.lit("tempo=9,tempo="), "t")).when(u == 1, F.concat(F.lit("artist=0.9,tempo="), "t", F.lit(",mood=0.25,artist=0.3")))
    w = g.select("user_id", rerank.weight_overrides(text).alias("w"))
    return w.select("user_id", *[F.col("w")[k].alias(k) for k in ("artist", "tempo", "mood", "lyric")])
