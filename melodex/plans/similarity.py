"""Similarity, fusion, feedback, rerank and evaluation queries over embeddings, part and events."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from melodex.functions import vectors as V
from melodex.operators import evaluation, feedback, fusion, rerank, search, similar

from .registry import query, table

SONGS = """songs AS (SELECT e.vec_id AS song_id, e.embedding::DOUBLE[] AS vec, e.label AS category, p.p_brand AS artist, p.p_type AS composer,
 (p.p_size*3+60)::DOUBLE AS tempo, p.p_retailprice/2000 AS energy FROM embeddings e LEFT JOIN part p ON e.vec_id=p.p_partkey)"""
PAIRS = "WITH " + SONGS + """, pairs AS (SELECT q.song_id AS query_id, c.song_id, round(list_inner_product(q.vec,c.vec),10) AS score FROM songs q JOIN songs c ON q.song_id<>c.song_id)"""
RANKED = PAIRS + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, song_id) AS rank FROM pairs)"""


def songs(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("artist"), F.col("p_type").alias("composer"), (F.col("p_size") * 3 + 60).cast("double").alias("tempo"), (F.col("p_retailprice") / 2000).alias("energy"))
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("song_id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").alias("category"))
    return e.join(part, e.song_id == part.p_partkey, "left").drop("p_partkey")


def vecs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("song_id"), F.col("embedding").alias("vec"))


def as_queries(df: DataFrame) -> DataFrame:
    return df.select(F.col("song_id").alias("query_id"), "vec")


@query(RANKED + " SELECT query_id, rank, song_id, round(score,4) AS score FROM ranked WHERE rank<=10")
def topk_cosine(spark, d):
    v = vecs(spark, d)
    return search.topk(as_queries(v), v, 10).select("query_id", "rank", "song_id", F.round("score", 4).alias("score"))


@query(PAIRS + " SELECT query_id, count(*) AS n, round(sum(score),3) AS total, round(max(score),6) AS best FROM pairs WHERE query_id%10=0 GROUP BY query_id")
def knn_theta_join(spark, d):
    """Every tenth vector against all others, by products of blocks."""
    v = vecs(spark, d)
    return search.totals(as_queries(v.where("song_id % 10 = 0")), v).withColumns({"total": F.round("total", 3), "best": F.round("best", 6)})


@query(PAIRS + """, pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, song_id) AS pool_rank FROM (SELECT query_id, song_id, score FROM pairs UNION ALL SELECT song_id, song_id, round(list_inner_product(vec,vec),10) FROM songs)),
 adj AS (SELECT p.*, round(p.score + CASE WHEN a.artist=c.artist AND a.artist<>'' THEN 0.15 ELSE 0.0 END, 4) AS adjusted FROM pool p JOIN songs a ON p.query_id=a.song_id JOIN songs c ON p.song_id=c.song_id WHERE pool_rank<=50 AND p.query_id<>p.song_id),
 fin AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY adjusted DESC, pool_rank) AS rank FROM adj) SELECT query_id, rank, song_id, adjusted AS score FROM fin WHERE rank<=10""")
def topk_reranked(spark, d):
    return _reranked(spark, d, 10).select("query_id", "rank", "song_id", F.col("adjusted").alias("score"))


def _contexts(spark, d, pool: DataFrame) -> tuple[DataFrame, dict, dict]:
    """A pool with its anchors' and candidates' features, and those as columns by signal."""
    s = songs(spark, d).select("song_id", F.struct("artist", "composer", "tempo", F.col("energy").alias("vocal_energy"), F.slice("vec", 1, 6).alias("tonnetz"), F.col("vec").alias("lyric"), "category").alias("f"))
    both = pool.join(s.select(F.col("song_id").alias("query_id"), F.col("f").alias("a")).hint("merge"), "query_id").join(s.select("song_id", F.col("f").alias("c")).hint("merge"), "song_id")
    names = ("artist", "composer", "tempo", "vocal_energy", "tonnetz", "lyric")
    return both, {n: F.col(f"a.{n}") for n in names}, {n: F.col(f"c.{n}") for n in names}


def _reranked(spark, d, k, weights=None) -> DataFrame:
    v = vecs(spark, d)
    pool = search.topk(as_queries(v), v, search.fetch_size(k, True), skip_self=False).where("query_id <> song_id")
    both, a, c = _contexts(spark, d, pool)
    return search.reranked(both, rerank.rerank_score(a, c, weights), k)


@query(RANKED + " SELECT rank, song_id, round(score,4) AS score FROM ranked WHERE query_id=7 AND rank<=10")
def similar_by_id(spark, d):
    return similar.similar_by_id(vecs(spark, d), 7, rerank=False).withColumn("score", F.round("score", 4))


def _named(spark, d) -> DataFrame:
    """Songs with what the default weights and names read."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("song_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"))
    return vecs(spark, d).join(part.hint("merge"), "song_id", "left")


ADJUSTED = PAIRS + """, pool AS (SELECT *, row_number() OVER (ORDER BY score DESC, song_id) AS pool_rank FROM (SELECT query_id, song_id, score FROM pairs UNION ALL SELECT song_id, song_id, round(list_inner_product(vec,vec),10) FROM songs) WHERE query_id={seed}),
 adj AS (SELECT p.*, round(p.score + CASE WHEN a.artist=c.artist AND a.artist<>'' THEN 0.15 ELSE 0.0 END, 4) AS adjusted FROM pool p JOIN songs a ON p.query_id=a.song_id JOIN songs c ON p.song_id=c.song_id WHERE pool_rank<=50 AND p.query_id<>p.song_id)
 SELECT row_number() OVER (ORDER BY adjusted DESC, pool_rank) AS rank, song_id, adjusted AS score FROM adj QUALIFY rank<=10"""


@query(ADJUSTED.replace("{seed}", "7"))
def similar_by_id_reranked(spark, d):
    """As a user asks for it: reranked by the default weights."""
    return similar.similar_by_id(_named(spark, d), 7)


@query(ADJUSTED.replace("{seed}", "(SELECT min(p_partkey) FROM part JOIN embeddings ON p_partkey=vec_id WHERE lower(p_name)=(SELECT lower(p_name) FROM part WHERE p_partkey=12) AND lower(p_brand)=(SELECT lower(p_brand) FROM part WHERE p_partkey=12))"))
def similar_by_name_reranked(spark, d):
    title, artist = table(spark, d, "part").where("p_partkey = 12").select("p_name", "p_brand").first()
    return similar.similar_by_name(_named(spark, d), title, artist)


@query(RANKED + " SELECT query_id, rank, song_id, round(score,4) AS score, CASE WHEN p_size IS NULL THEN NULL WHEN p_size*3+60<80 THEN 'Slow' WHEN p_size*3+60<100 THEN 'Medium' WHEN p_size*3+60<120 THEN 'Upbeat' ELSE 'Fast' END AS tempo_label, CASE WHEN p_size IS NULL THEN NULL WHEN p_size%7=0 THEN 0 ELSE round(p_size/64.0::DOUBLE,2) END::DOUBLE AS ornament, round(p_size%10/8.0::DOUBLE,2)::DOUBLE AS hnr FROM ranked LEFT JOIN part ON p_partkey=song_id WHERE rank<=5")
def match_card_statistics(spark, d):
    """What a result's card shows beside its score; songs without a part have no record."""
    from melodex.functions.music import tempo_bucket

    size = F.col("p_size")
    f = table(spark, d, "part").select(F.col("p_partkey").alias("song_id"), tempo_bucket(size * 3 + 60).alias("tempo_bucket"), F.when(size % 7 != 0, size / 64.0).alias("murki_index"), (size % 10 / 8.0).alias("hnr_mean"))
    return similar.match_cards(search.topk(as_queries(vecs(spark, d)), vecs(spark, d), 5), f).select("query_id", "rank", "song_id", "score", "tempo_label", "ornament", "hnr")


@query(RANKED + ", seed AS (SELECT min(p_partkey) AS id FROM part JOIN embeddings ON p_partkey=vec_id WHERE lower(p_name)=(SELECT lower(p_name) FROM part WHERE p_partkey=9) AND lower(p_brand)=(SELECT lower(p_brand) FROM part WHERE p_partkey=9)) SELECT rank, song_id, round(score,4) AS score FROM ranked WHERE query_id=(SELECT id FROM seed) AND rank<=10")
def similar_by_name(spark, d):
    """The first song whose id from title and artist equals that of part 9's."""
    title, artist = table(spark, d, "part").where("p_partkey = 9").select("p_name", "p_brand").first()
    return similar.similar_by_name(_named(spark, d), title, artist, rerank=False).withColumn("score", F.round("score", 4))


@query(RANKED + " SELECT r.query_id, q.category, r.rank, r.song_id FROM ranked r JOIN songs q ON q.song_id=r.query_id WHERE r.rank<=5")
def batch_similar(spark, d):
    """All songs as queries in one job, with their own categories."""
    v = table(spark, d, "embeddings")
    own = v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("category"))
    return _results(spark, d, 5).join(own.hint("merge"), "query_id").select("query_id", "category", "rank", "song_id")


@query(PAIRS + """, kept AS (SELECT p.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, p.song_id) AS rank FROM pairs p JOIN songs c USING (song_id) WHERE c.category=2 AND c.tempo>=120 AND lower(c.artist)<>'brand#11') SELECT query_id, rank, song_id, round(score,4) AS score FROM kept WHERE rank<=5 AND query_id%50=0""")
def filter_results(spark, d):
    """Filters go before ranking, so that a selective one still returns K."""
    s = songs(spark, d).withColumn("tempo_bucket", F.when(F.col("tempo") < 80, 0).when(F.col("tempo") < 100, 1).when(F.col("tempo") < 120, 2).otherwise(3)).where("tempo is not null")
    c = s.where(search.allowed(category=F.lit(2), tempo_bucket=F.lit(3), exclude_artist="Brand#11"))
    return search.topk(as_queries(vecs(spark, d).where("song_id % 50 = 0")), c, 5).select("query_id", "rank", "song_id", F.round("score", 4).alias("score"))


@query(RANKED + ", ex AS (SELECT DISTINCT (event_id%500) AS query_id, (value*7)::BIGINT%500 AS song_id FROM events WHERE event_type='error'), k AS (SELECT r.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, song_id) AS rk FROM pairs r WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.query_id=r.query_id AND ex.song_id=r.song_id)) SELECT query_id, rk AS rank, song_id FROM k WHERE rk<=5".replace("(value*7)::BIGINT%500", "user_id%500"))
def exclude_ids(spark, d):
    v = vecs(spark, d)
    gone = table(spark, d, "events").where("event_type = 'error'").select((F.col("event_id") % 500).alias("query_id"), (F.col("user_id") % 500).alias("song_id")).distinct()
    return search.topk(as_queries(v), v, 5, excluded=gone).select("query_id", "rank", "song_id")


@query(RANKED + " SELECT query_id, rank, song_id, artist, c.category, round(score,4) AS score FROM ranked JOIN (SELECT song_id, artist, category FROM songs WHERE artist IS NOT NULL) c USING (song_id) WHERE rank<=5")
def attach_metadata(spark, d):
    s = songs(spark, d).where("artist is not null").select("song_id", "artist", "category")
    v = vecs(spark, d)
    return search.topk(as_queries(v), v, 5).join(s.hint("merge"), "song_id").select("query_id", "rank", "song_id", "artist", "category", F.round("score", 4).alias("score"))


SIGNAL_SQL = RANKED + """, j AS (SELECT r.query_id, r.song_id, a.artist aa, c.artist ca, a.composer ac, c.composer cc, a.energy ae, c.energy ce, a.tempo ta, c.tempo tc, list_slice(a.vec,1,6) ax, list_slice(c.vec,1,6) cx, a.vec av, c.vec cv FROM ranked r JOIN songs a ON r.query_id=a.song_id JOIN songs c ON r.song_id=c.song_id WHERE rank<=5) SELECT query_id, song_id, """
SIGNALS_SQL = {
    "sig_artist": "CASE WHEN aa=ca AND aa<>'' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
    "sig_composer": "CASE WHEN ac=cc AND ac<>'' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
    "sig_lyricist": "CASE WHEN substr(aa,1,7)=substr(ca,1,7) AND aa<>'' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
    "sig_mood": "CASE WHEN substr(ac,1,3)=substr(cc,1,3) AND ac<>'' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
    "sig_vocal_energy": "round(coalesce(1-abs(ae-ce),0),6)::DOUBLE",
    "sig_tempo": "round(CASE WHEN ta IS NULL OR tc IS NULL THEN 0 ELSE greatest(0,1-abs(ta-tc)/60) END,6)::DOUBLE",
    "sig_tonnetz": "round(list_cosine_similarity(ax,cx),6)",
    "sig_lyric": "round(list_inner_product(av,cv),6)",
}


def _signal(name: str):
    def run(spark, d):
        v = vecs(spark, d)
        both, a, c = _contexts(spark, d, search.topk(as_queries(v), v, 5))
        a, c = (x | {"lyricist": F.substring(x["artist"], 1, 7), "mood": F.substring(x["composer"], 1, 3)} for x in (a, c))
        return both.select("query_id", "song_id", F.round(rerank.SIGNALS[name](a, c), 6).alias("signal"))

    run.__name__ = f"sig_{name}"
    return run


for _name in ("artist", "composer", "lyricist", "mood", "vocal_energy", "tempo", "tonnetz", "lyric"):
    query(SIGNAL_SQL + SIGNALS_SQL[f"sig_{_name}"] + " AS signal FROM j")(_signal(_name))


@query(SIGNAL_SQL + f"round(0.15*({SIGNALS_SQL['sig_artist']})+0.2*({SIGNALS_SQL['sig_composer']})+0.1*coalesce(1-abs(ae-ce),0)+0.05*list_cosine_similarity(ax,cx),6) AS delta FROM j")
def rerank_score(spark, d):
    v = vecs(spark, d)
    both, a, c = _contexts(spark, d, search.topk(as_queries(v), v, 5))
    w = rerank.weights_from(["composer=0.2", "vocal_energy=0.1", "tonnetz=0.05", "lyric=0"])
    return both.select("query_id", "song_id", F.round(rerank.rerank_score(a, c, w), 6).alias("delta"))


@query(SIGNAL_SQL + f"round(0.3*(CASE WHEN substr(aa,7,1)=substr(ca,7,1) THEN 1 ELSE 0 END)+0.1*({SIGNALS_SQL['sig_tempo']}),6)::DOUBLE AS delta FROM j")
def signal_registry(spark, d):
    """A signal that a user adds by name (artists of one maker), weighed with a given one, and taken out again."""
    rerank.signal("maker")(lambda a, c: F.coalesce((F.substring(a["artist"], 7, 1) == F.substring(c["artist"], 7, 1)).cast("double"), F.lit(0.0)))
    try:
        v = vecs(spark, d)
        both, a, c = _contexts(spark, d, search.topk(as_queries(v), v, 5))
        return both.select("query_id", "song_id", F.round(rerank.rerank_score(a, c, {"maker": 0.3, "tempo": 0.1}), 6).alias("delta"))
    finally:
        del rerank.SIGNALS["maker"]


@query(SIGNAL_SQL + "aa AS a_artist, ca AS c_artist, ta AS a_tempo, tc AS c_tempo FROM j")
def pair_context(spark, d):
    v = vecs(spark, d)
    both, _, _ = _contexts(spark, d, search.topk(as_queries(v), v, 5))
    return both.select("query_id", "song_id", F.col("a.artist").alias("a_artist"), F.col("c.artist").alias("c_artist"), F.col("a.tempo").alias("a_tempo"), F.col("c.tempo").alias("c_tempo"))


@query(RANKED + """ SELECT query_id, rank, song_id, CASE WHEN tempo<80 THEN 'Slow' WHEN tempo<100 THEN 'Medium' WHEN tempo<120 THEN 'Upbeat' WHEN tempo IS NOT NULL THEN 'Fast' ELSE 'Unknown' END AS tempo_label, round(energy,6) AS energy FROM ranked JOIN songs USING (song_id) WHERE rank<=5""")
def match_card(spark, d):
    from melodex.functions.music import tempo_bucket, tempo_label

    v = vecs(spark, d)
    s = songs(spark, d).select("song_id", tempo_label(tempo_bucket(F.col("tempo"))).alias("tempo_label"), F.round("energy", 6).alias("energy"))
    return search.topk(as_queries(v), v, 5).join(s.hint("merge"), "song_id").select("query_id", "rank", "song_id", "tempo_label", "energy")


# Vector algebra.
@query("SELECT vec_id, i::BIGINT AS pos, round(v[i]/sqrt(list_inner_product(v,v)),6) AS value FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x*3) AS v FROM embeddings) t, unnest(generate_series(1,len(v))) u(i)")
def l2_normalise(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 3).alias("v"))
    return v.select("vec_id", F.posexplode(V.unit(F.col("v"))).alias("pos", "value")).select("vec_id", (F.col("pos") + 1).cast("long").alias("pos"), F.round("value", 6).alias("value"))


CELLS = "cells AS (SELECT e.vec_id, e.label, i AS pos, e.embedding[i]::DOUBLE AS x FROM embeddings e, unnest(generate_series(1,64)) u(i))"


@query(f"WITH {CELLS}, m AS (SELECT label, pos, avg(x) AS a FROM cells GROUP BY ALL), n AS (SELECT label, sqrt(sum(a*a)) AS n FROM m GROUP BY label) SELECT label, pos, round(a/n,6) AS value FROM m JOIN n USING (label)")
def vector_centroid(spark, d):
    v = table(spark, d, "embeddings").select("label", F.col("embedding").alias("vec"))
    c = feedback.centroids(v, "label")
    return c.select("label", F.posexplode("vec").alias("pos", "value")).select("label", (F.col("pos") + 1).cast("long").alias("pos"), F.round("value", 6).alias("value"))


@query(f"WITH {CELLS}, {SONGS}, m AS (SELECT pos, avg(x) AS a FROM cells WHERE vec_id IN (3,14,15,92,65) GROUP BY ALL), c AS (SELECT list(a/(SELECT sqrt(sum(a*a)) FROM m) ORDER BY pos) AS v FROM m), r AS (SELECT song_id, round(list_inner_product(vec,v),6) AS score FROM songs, c WHERE song_id NOT IN (3,14,15,92,65)) SELECT row_number() OVER (ORDER BY score DESC, song_id) AS rank, song_id, round(score,4) AS score FROM r QUALIFY rank<=10")
def playlist_expand(spark, d):
    members = spark.range(100).select(F.col("id").alias("song_id")).where(F.col("song_id").isin(3, 14, 15, 92, 65))
    return similar.similar_to_playlist(vecs(spark, d), members).withColumn("score", F.round("score", 4))


JUDGED = "judged AS (SELECT user_id AS session_id, CASE event_type WHEN 'purchase' THEN 'approve' ELSE 'reject' END AS verdict, event_id%500 AS song_id FROM events WHERE event_type IN ('purchase','error'))"


def _judged(spark, d) -> DataFrame:
    e = table(spark, d, "events").where(F.col("event_type").isin("purchase", "error"))
    return e.select(F.col("user_id").alias("session_id"), F.when(F.col("event_type") == "purchase", "approve").otherwise("reject").alias("verdict"), (F.col("event_id") % 500).alias("song_id"))


def _moved(spark, d) -> DataFrame:
    v, j = vecs(spark, d), _judged(spark, d)
    s = j.select("session_id").distinct().withColumn("song_id", F.col("session_id") % 500).join(v, "song_id").select("session_id", "vec")
    often = j.groupBy("session_id", "verdict", "song_id").agg(F.count("*").alias("times"))
    return feedback.rocchio(s, often.join(v.hint("merge"), "song_id"))


MOVED = f"{CELLS}, {JUDGED}, s AS (SELECT DISTINCT session_id FROM judged), b AS (SELECT session_id, pos, x FROM s JOIN cells ON vec_id=session_id%500), g AS (SELECT session_id, pos, 0.75*coalesce(avg(x) FILTER (verdict='approve'),0)-0.25*coalesce(avg(x) FILTER (verdict='reject'),0) AS y FROM judged JOIN cells ON vec_id=song_id GROUP BY ALL), q AS (SELECT session_id, pos, x+coalesce(y,0) AS z FROM b LEFT JOIN g USING (session_id,pos)), nn AS (SELECT session_id, sqrt(sum(z*z)) AS n FROM q GROUP BY session_id)"


@query(f"WITH {MOVED} SELECT session_id, pos, round(z/n,6) AS value FROM q JOIN nn USING (session_id)")
def rocchio(spark, d):
    return _moved(spark, d).select("session_id", F.posexplode("vec").alias("pos", "value")).select("session_id", (F.col("pos") + 1).cast("long").alias("pos"), F.round("value", 6).alias("value"))


@query(f"WITH {MOVED}, {SONGS}, v AS (SELECT session_id, list(z/n ORDER BY pos) AS v FROM q JOIN nn USING (session_id) GROUP BY session_id), r AS (SELECT v.session_id, song_id, round(list_inner_product(v,vec),10) AS score FROM v, songs WHERE song_id<>session_id%500 AND NOT EXISTS (SELECT 1 FROM judged j WHERE j.session_id=v.session_id AND j.song_id=songs.song_id)) SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, song_id) AS rank, song_id, round(score,4) AS score FROM r QUALIFY rank<=5")
def feedback_session(spark, d):
    """Seed and judged songs are excluded; the next five by the moved query."""
    gone = excluded_set(spark, d).withColumnRenamed("session_id", "query_id")
    q = _moved(spark, d).select(F.col("session_id").alias("query_id"), "vec")
    out = search.topk(q, vecs(spark, d), 5, skip_self=False, excluded=gone)
    return out.select(F.col("query_id").alias("session_id"), "rank", "song_id", F.round("score", 4).alias("score"))


@query(f"WITH {JUDGED} SELECT session_id, song_id FROM judged UNION SELECT session_id, session_id%500 FROM judged")
def excluded_set(spark, d):
    j = _judged(spark, d)
    return j.select("session_id", "song_id").union(j.select("session_id", F.col("session_id") % 500)).distinct()


GROUPS = (("clap", 1, 32), ("nlp", 33, 16), ("vocal", 49, 8), ("melodic", 57, 6), ("rhythmic", 63, 2))
FLAGS = "SELECT vec_id, embedding::DOUBLE[] AS v, vec_id%3=0 AS lm, vec_id%5=0 AS sf, vec_id%7=0 AS cm, CASE label WHEN 0 THEN 'ghazal' WHEN 1 THEN 'sufi' WHEN 2 THEN 'sad_romantic' WHEN 3 THEN 'party' WHEN 4 THEN 'upbeat' ELSE 'other' END AS cat FROM embeddings"
WEIGHTS = f"""w0 AS (SELECT *, CASE cat WHEN 'ghazal' THEN 0.15 WHEN 'sufi' THEN 0.20 WHEN 'sad_romantic' THEN 0.30 WHEN 'party' THEN 0.32 WHEN 'upbeat' THEN 0.32 ELSE 0.30 END::DOUBLE AS c0 FROM ({FLAGS})),
w1 AS (SELECT *, c0 AS clap, 0.15+(0.30-c0)*0.15/0.70 AS nlp, 0.22+(0.30-c0)*0.22/0.70 AS vocal, 0.20+(0.30-c0)*0.20/0.70 AS melodic, 0.13+(0.30-c0)*0.13/0.70 AS rhythmic FROM w0),
w2 AS (SELECT vec_id, v, lm, sf, cm, CASE WHEN cm THEN 0 ELSE clap END AS clap, CASE WHEN cm THEN nlp+clap*nlp/(1-clap) ELSE nlp END AS nlp, CASE WHEN cm THEN vocal+clap*vocal/(1-clap) ELSE vocal END AS vocal, CASE WHEN cm THEN melodic+clap*melodic/(1-clap) ELSE melodic END AS melodic, CASE WHEN cm THEN rhythmic+clap*rhythmic/(1-clap) ELSE rhythmic END AS rhythmic FROM w1),
w3 AS (SELECT vec_id, v, lm, CASE WHEN sf AND NOT cm THEN clap+(vocal+rhythmic)/2 ELSE clap END AS clap, nlp, CASE WHEN sf AND cm THEN vocal/2+(vocal+rhythmic)/2 WHEN sf THEN vocal/2 ELSE vocal END AS vocal, melodic, CASE WHEN sf THEN rhythmic/2 ELSE rhythmic END AS rhythmic FROM w2),
w AS (SELECT vec_id, v, CASE WHEN lm THEN clap+nlp*clap/(1-nlp) ELSE clap END AS clap, CASE WHEN lm THEN 0 ELSE nlp END AS nlp, CASE WHEN lm THEN vocal+nlp*vocal/(1-nlp) ELSE vocal END AS vocal, CASE WHEN lm THEN melodic+nlp*melodic/(1-nlp) ELSE melodic END AS melodic, CASE WHEN lm THEN rhythmic+nlp*rhythmic/(1-nlp) ELSE rhythmic END AS rhythmic FROM w3)"""


def _fusion(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    names = ["ghazal", "sufi", "sad_romantic", "party", "upbeat"]
    cat = F.coalesce(F.get(F.array(*map(F.lit, names)), F.col("label")), F.lit("other"))
    w = fusion.fusion_weights(F.col("vec_id") % 3 == 0, F.col("vec_id") % 5 == 0, F.col("vec_id") % 7 == 0, cat)
    return e.select("vec_id", "embedding", cat.alias("cat"), *[c.alias(k) for k, c in w.items()])


@query(f"WITH {WEIGHTS} SELECT vec_id, round(clap,6)::DOUBLE AS clap, round(nlp,6)::DOUBLE AS nlp, round(vocal,6)::DOUBLE AS vocal, round(melodic,6)::DOUBLE AS melodic, round(rhythmic,6)::DOUBLE AS rhythmic FROM w")
def fusion_weights(spark, d):
    return _fusion(spark, d).select("vec_id", *[F.round(k, 6).alias(k) for k in fusion.BASE])


_FUSED = ", ".join(f"list_transform(list_slice(v,{a},{a + n - 1}), lambda x: x*{k}/sqrt(list_inner_product(list_slice(v,{a},{a + n - 1}),list_slice(v,{a},{a + n - 1}))))" for k, a, n in GROUPS)
FUSED = f"{WEIGHTS}, f AS (SELECT vec_id, flatten([{_FUSED}]) AS f FROM w), fn AS (SELECT vec_id, f, sqrt(list_inner_product(f,f)) AS n FROM f)"


@query(f"WITH {FUSED} SELECT vec_id, i AS pos, round(f[i]/n,6)+0 AS value FROM fn, unnest(generate_series(1,64)) u(i)")
def fuse_vector(spark, d):
    groups = {k: F.slice("embedding", a, n) for k, a, n in GROUPS}
    f = _fusion(spark, d).select("vec_id", fusion.fuse(groups, {k: F.col(k) for k in fusion.BASE}).alias("f"))
    return f.select("vec_id", F.posexplode("f").alias("pos", "value")).select("vec_id", (F.col("pos") + 1).cast("long").alias("pos"), F.round("value", 6).alias("value"))


@query(f"WITH {FUSED} SELECT fn.vec_id, i AS pos, round(f[i]/n,6)+0 AS value, fn.vec_id%7=0 AS clap_missing, fn.vec_id%3=0 AS lyrics_missing FROM fn JOIN part ON p_partkey=vec_id, unnest(generate_series(1,64)) u(i)")
def refuse_without_clap(spark, d):
    """Fused vectors built anew from the stored ones and the features; every seventh stored one was compressed to 16
    places, every third text vector is gone, and songs without a record are left out."""
    layout = {k: n for k, _, n in GROUPS}
    flags = _fusion(spark, d)
    fused = flags.select("vec_id", "cat", fusion.fuse({k: F.slice("embedding", a, n) for k, a, n in GROUPS}, {k: F.col(k) for k in fusion.BASE}).alias("f"), "embedding")
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("vec_id"), F.lit(True).alias("known"))
    k = F.col("vec_id")
    groups = {g: F.slice("embedding", a, n) for g, a, n in GROUPS if g != "clap"}
    songs_ = fused.join(parts, "vec_id", "left").select(
        "vec_id", F.col("cat").alias("category"), (k % 5 == 0).alias("stem_failed"), F.when(k % 7 == 0, F.slice("f", 1, 16)).otherwise(F.col("f")).alias("stored"),
        *[F.when(F.col("known") & ((k % 3 != 0) | (g != "nlp")), v).alias(g) for g, v in groups.items()],
    )
    out = fusion.rebuild(songs_, layout).select("vec_id", "clap_missing", "lyrics_missing", F.posexplode("fused").alias("pos", "value"))
    return out.select("vec_id", (F.col("pos") + 1).cast("long").alias("pos"), F.round("value", 6).alias("value"), "clap_missing", "lyrics_missing")


# Evaluation. Judgments: songs of the query's label among those whose ids are near; the grade by song_id.
JUDG = RANKED + ", results AS (SELECT query_id, rank, song_id FROM ranked WHERE rank<=10), jraw AS (SELECT q.song_id AS query_id, c.song_id, CASE WHEN q.category=c.category THEN c.song_id%3 ELSE 0 END AS grade, k AS pos FROM songs q JOIN songs c ON c.song_id<>q.song_id AND (c.song_id%20)=(q.song_id%20), (VALUES (1),(2)) kk(k) WHERE q.song_id%10=0 AND (k=1 OR c.song_id%4=0)), jr2 AS (SELECT query_id, song_id, CASE WHEN pos=2 THEN 2-grade ELSE grade END AS grade, pos FROM jraw), judg AS (SELECT query_id, song_id, max_by(grade,pos)::BIGINT AS grade FROM jr2 GROUP BY ALL)"


#: Pairs of a query and a judged song that one task makes, about.
JUDGED_A_TASK = 1_000_000


def _judgments(spark, d) -> DataFrame:
    """Judged songs share their query's remainder by 20, of which there are two: pairs are dealt over tasks by query, as many
    tasks as there are pairs for, and stay there until a query's judgments are counted."""
    tens = table(spark, d, "embeddings").where("vec_id % 10 = 0").select("vec_id", "label", (F.col("vec_id") % 20).alias("m"))
    sizes = [r["n"] for r in tens.groupBy("m").agg(F.count("*").alias("n")).collect()]
    q = tens.select(F.col("vec_id").alias("query_id"), F.col("label").alias("q"), "m").repartition(max(1, -(-sum(n * n for n in sizes) // JUDGED_A_TASK)), "query_id")
    c = tens.select(F.col("vec_id").alias("song_id"), F.col("label").alias("c"), "m")
    met = q.join(F.broadcast(c), "m") if 32 * sum(sizes) <= search.BROADCAST_BYTES else q.join(c.hint("shuffle_replicate_nl"), "m")
    raw = met.where("query_id <> song_id").select("query_id", "song_id", F.when(F.col("q") == F.col("c"), F.col("song_id") % 3).otherwise(0).alias("grade"), F.explode(F.when(F.col("song_id") % 4 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("pos"))
    return raw.withColumn("grade", F.when(F.col("pos") == 2, 2 - F.col("grade")).otherwise(F.col("grade")))


def _results(spark, d, k=10) -> DataFrame:
    v = vecs(spark, d)
    return search.topk(as_queries(v), v, k).select("query_id", "rank", "song_id")


@query(JUDG + " SELECT query_id, song_id, grade FROM judg")
def judgments_last_wins(spark, d):
    return evaluation.last_judgments(_judgments(spark, d))


@query(JUDG + " SELECT r.query_id, r.rank, r.song_id, coalesce(grade,0) AS grade FROM results r LEFT JOIN judg USING (query_id,song_id) WHERE query_id IN (SELECT query_id FROM judg)")
def judgment_join(spark, d):
    j = _judgments(spark, d)
    return evaluation.graded(_results(spark, d).join(j.select("query_id").distinct().hint("merge"), "query_id", "left_semi"), j).select("query_id", "rank", "song_id", "grade")


@query(JUDG + " SELECT query_id, count(*) AS judged, count(*) FILTER (grade=2) AS grade2, count(*) FILTER (grade=1) AS grade1 FROM judg GROUP BY query_id")
def judged_pool(spark, d):
    j = evaluation.last_judgments(_judgments(spark, d))
    return j.groupBy("query_id").agg(F.count("*").alias("judged"), F.count_if(F.col("grade") == 2).alias("grade2"), F.count_if(F.col("grade") == 1).alias("grade1"))


NDCG = JUDG + ", gr AS (SELECT r.query_id, r.rank, coalesce(grade,0) AS grade FROM results r LEFT JOIN judg USING (query_id,song_id) WHERE rank<=5), got AS (SELECT query_id, sum((power(2,grade)-1)/log2(rank+1)) AS dcg, avg((grade>=1)::INT) AS precision FROM gr GROUP BY query_id), idl AS (SELECT query_id, sum((power(2,grade)-1)/log2(rn+1)) AS ideal FROM (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS rn FROM judg) WHERE rn<=5 GROUP BY query_id), nd AS (SELECT query_id, CASE WHEN ideal>0 THEN coalesce(dcg,0)/ideal ELSE 0 END AS ndcg, coalesce(precision,0) AS precision FROM idl LEFT JOIN got USING (query_id))"


@query(NDCG + " SELECT query_id, round(sum((power(2,grade)-1)/log2(rank+1)),6) AS dcg FROM gr GROUP BY query_id")
def dcg_position(spark, d):
    g = evaluation.graded(_results(spark, d, 5), _judgments(spark, d))
    return g.groupBy("query_id").agg(F.round(F.sum(evaluation.gain(F.col("grade"), F.col("rank"))), 6).alias("dcg"))


@query(NDCG + " SELECT query_id, round(ndcg,6)::DOUBLE AS ndcg FROM nd")
def ndcg_at_k(spark, d):
    return evaluation.ndcg(_results(spark, d), _judgments(spark, d), 5).select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query(NDCG + " SELECT query_id, round(precision,6) AS precision FROM nd")
def precision_at_k(spark, d):
    return evaluation.ndcg(_results(spark, d), _judgments(spark, d), 5).select("query_id", F.round("precision", 6).alias("precision"))


SWEEP = JUDG + ", grid AS (SELECT unnest([0.0,0.1,0.2,0.4])::DOUBLE AS weight), pl AS (SELECT r.query_id, r.song_id, r.score, r.rank AS pool_rank, CASE WHEN a.artist=c.artist AND a.artist<>'' THEN 1.0 ELSE 0.0 END AS s FROM ranked r JOIN songs a ON a.song_id=r.query_id JOIN songs c ON c.song_id=r.song_id WHERE rank<=49), sw AS (SELECT weight, query_id, song_id, row_number() OVER (PARTITION BY weight, query_id ORDER BY round(score+weight*s,4) DESC, pool_rank) AS rank FROM pl, grid), g2 AS (SELECT weight, query_id, sum((power(2,coalesce(grade,0))-1)/log2(rank+1)) AS dcg FROM sw LEFT JOIN judg USING (query_id,song_id) WHERE rank<=5 GROUP BY ALL), idl AS (SELECT query_id, sum((power(2,grade)-1)/log2(rn+1)) AS ideal FROM (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS rn FROM judg) WHERE rn<=5 GROUP BY query_id), ev AS (SELECT weight, query_id, CASE WHEN ideal>0 THEN dcg/ideal ELSE 0 END AS ndcg FROM idl JOIN g2 USING (query_id))"


def _sweep(spark, d) -> DataFrame:
    """weight, query_id, ndcg over a grid of artist weights; one pool, one more key."""
    v = vecs(spark, d)
    pool = search.topk(as_queries(v), v, search.fetch_size(10, True) - 1)  # ten results ask for a pool of fifty, with the seed
    both, a, c = _contexts(spark, d, pool.join(_judgments(spark, d).select("query_id").distinct().hint("merge"), "query_id", "left_semi"))
    return evaluation.weight_sweep(both.select("query_id", "song_id", "score", "rank", rerank.SIGNALS["artist"](a, c).alias("signal")), _judgments(spark, d), [0.0, 0.1, 0.2, 0.4], 5)


@query(SWEEP + " SELECT weight, round(avg(ndcg),6) AS ndcg, count(*) AS n FROM ev GROUP BY weight")
def weight_sweep(spark, d):
    return _sweep(spark, d).groupBy("weight").agg(F.round(F.avg("ndcg"), 6).alias("ndcg"), F.count("*").alias("n"))


@query(SWEEP + " SELECT b.query_id, round(b.ndcg,6)::DOUBLE AS before, round(a.ndcg,6)::DOUBLE AS after, round(a.ndcg,6)<>round(b.ndcg,6) AS moved FROM ev b JOIN ev a USING (query_id) WHERE b.weight=0 AND a.weight=0.4")
def ablation_delta(spark, d):
    return evaluation.ablation(_sweep(spark, d), 0.0, 0.4)


PRECISION = RANKED + ", res AS (SELECT query_id, song_id FROM ranked WHERE rank<=5), per AS (SELECT q.song_id AS query_id, q.category, avg((c.category=q.category)::INT) AS score FROM songs q JOIN res ON res.query_id=q.song_id JOIN songs c ON c.song_id=res.song_id GROUP BY ALL)"


def _labels(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("song_id"), F.col("label").alias("category"))


def _per_category(spark, d) -> DataFrame:
    per = evaluation.label_precision(_results(spark, d, 5), _labels(spark, d))
    return per.groupBy("category").agg(F.avg("score").alias("score"), F.count("*").alias("n"))


@query(PRECISION + " SELECT category, round(avg(score),6) AS score, count(*) AS n FROM per GROUP BY category")
def category_precision(spark, d):
    return _per_category(spark, d).withColumn("score", F.round("score", 6))


@query(PRECISION + " SELECT round(avg(s),6) AS macro FROM (SELECT avg(score) AS s FROM per GROUP BY category)")
def macro_average(spark, d):
    return _per_category(spark, d).agg(F.round(F.avg("score"), 6).alias("macro"))


@query(PRECISION + " SELECT q.category AS true_label, " + ", ".join(f"count(*) FILTER (c.category={i}) AS p{i}" for i in range(10)) + " FROM res JOIN songs q ON q.song_id=res.query_id JOIN songs c ON c.song_id=res.song_id GROUP BY q.category")
def confusion_matrix(spark, d):
    n = _labels(spark, d)
    pairs = _results(spark, d, 5).join(n.select(F.col("song_id").alias("query_id"), F.col("category").alias("true")).hint("merge"), "query_id").join(n.select("song_id", F.col("category").alias("predicted")).hint("merge"), "song_id")
    c = evaluation.confusion(pairs, list(range(10)))
    return c.select(F.col("true").alias("true_label"), *[F.col(str(i)).alias(f"p{i}") for i in range(10)])


@query(PRECISION + ", sc AS (SELECT CASE category WHEN 0 THEN 'ghazal' WHEN 1 THEN 'sufi' WHEN 2 THEN 'sad_romantic' WHEN 3 THEN 'party' WHEN 4 THEN 'upbeat' ELSE 'c'||category END AS category, avg(score) AS score FROM per GROUP BY ALL), t AS (SELECT * FROM (VALUES ('ghazal',0.8),('sufi',0.75),('sad_romantic',0.7),('party',0.85),('upbeat',0.65)) x(category,target)), b AS (SELECT category, score, coalesce(target,0.6)::DOUBLE AS target FROM sc LEFT JOIN t USING (category)) SELECT category, round(score,6) AS score, target, CASE WHEN score>=target THEN 'PASS' ELSE 'FAIL' END AS verdict, CASE WHEN score<target THEN CASE category WHEN 'ghazal' THEN 'raise the vocal weight' WHEN 'party' THEN 'raise the rhythmic weight' WHEN 'sufi' THEN 'raise the melodic weight' ELSE 'inspect the cluster' END END AS advice FROM b")
def target_join(spark, d):
    names = F.get(F.array(*map(F.lit, ["ghazal", "sufi", "sad_romantic", "party", "upbeat"])), F.col("category"))
    s = _per_category(spark, d).select(F.coalesce(names, F.concat(F.lit("c"), F.col("category"))).alias("category"), "score")
    t = spark.createDataFrame(list(evaluation.TARGETS.items()), "category string, target double")
    return evaluation.against_targets(s, t).select("category", F.round("score", 6).alias("score"), "target", "verdict", "advice")
