"""Frame and token-sequence queries: events of a user as a song's frames, in order of time."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from melodex.functions import music, vectors
from melodex.operators import features
from melodex.operators import frames as R
from melodex.operators import sequences as Q

from .registry import query, table

FR = "fr AS (SELECT user_id AS song_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts,event_id))-1 AS i, value AS v, event_type, event_type<>'error' AS voiced FROM events)"


def fr(spark, d) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("song_id"), (F.row_number().over(w) - 1).cast("long").alias("i"), F.col("value").alias("v"), "event_type", (F.col("event_type") != "error").alias("voiced"))


FILLED = f"{FR}, z AS (SELECT *, CASE WHEN voiced THEN v ELSE 0 END AS f FROM fr), fl AS (SELECT *, coalesce(last_value(nullif(f,0) IGNORE NULLS) OVER (PARTITION BY song_id ORDER BY i ROWS UNBOUNDED PRECEDING),0) AS filled FROM z)"


def _holes(spark, d) -> DataFrame:
    return fr(spark, d).withColumn("v", F.when(F.col("voiced"), F.col("v")).otherwise(0.0))


@query(f"WITH {FILLED} SELECT song_id, i, filled FROM fl")
def forward_fill(spark, d):
    return _holes(spark, d).select("song_id", "i", R.forward_fill(F.col("v")).alias("filled"))


@query(f"WITH {FR} SELECT song_id, i, round(v-lag(v) OVER (PARTITION BY song_id ORDER BY i),6) AS step FROM fr")
def frame_delta(spark, d):
    return fr(spark, d).select("song_id", "i", F.round(R.delta(F.col("v")), 6).alias("step"))


@query(f"WITH {FILLED}, dl AS (SELECT song_id, filled, abs(filled-lag(filled) OVER (PARTITION BY song_id ORDER BY i)) AS s FROM fl WHERE filled>0), g AS (SELECT song_id, count(*) AS n, avg(filled) AS m, var_pop(s) AS x FROM dl GROUP BY song_id) SELECT song_id, round(CASE WHEN n>=10 AND m>=1e-6 THEN x/(m*m) ELSE 0 END,6)::DOUBLE AS glide FROM (SELECT DISTINCT song_id FROM fr) LEFT JOIN g USING (song_id)")
def glide_variance(spark, d):
    return R.glide_variance(_holes(spark, d)).withColumn("glide", F.round("glide", 6))


@query(f"WITH {FR} SELECT song_id, event_type AS coef, round(avg(v),6) AS mean, round(stddev_pop(v),6) AS std FROM fr GROUP BY ALL")
def frame_stats(spark, d):
    return fr(spark, d).groupBy("song_id", F.col("event_type").alias("coef")).agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"))


@query(f"WITH {FR}, a AS (SELECT song_id, avg(v) FILTER (event_type='click') AS a, avg(v) FILTER (event_type='view') AS b FROM fr GROUP BY song_id) SELECT song_id, round(coalesce(CASE WHEN a+b<1e-8 THEN 0.5 ELSE a/(a+b) END,0.5),6)::DOUBLE AS ratio FROM a")
def energy_ratio(spark, d):
    mean = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("v")))
    g = fr(spark, d).groupBy("song_id").agg(mean("click").alias("a"), mean("view").alias("b"))
    return g.select("song_id", F.round(R.energy_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


@query(f"WITH {FR}, m AS (SELECT song_id, avg(v) AS m FROM fr GROUP BY song_id) SELECT song_id, round(avg(power(v-m,3))/power(avg(power(v-m,2)),1.5),5) AS skew FROM fr JOIN m USING (song_id) GROUP BY song_id")
def onset_skewness(spark, d):
    return fr(spark, d).groupBy("song_id").agg(F.round(F.skewness("v"), 5).alias("skew"))


PITCH = f"{FR}, vo AS (SELECT song_id, CASE WHEN voiced AND v>0 THEN ((floor(3*(69+12*log2(v/440)))::INT%36)+36)%36 END AS bin FROM fr), b AS (SELECT song_id, bin, count(*) AS n FROM vo WHERE bin IS NOT NULL GROUP BY ALL), nn AS (SELECT s.song_id, coalesce(sum(n),0) AS voiced, sqrt(sum(n*n)) AS t FROM (SELECT DISTINCT song_id FROM fr) s LEFT JOIN b USING (song_id) GROUP BY ALL), ch AS (SELECT vec_id AS song_id, embedding::DOUBLE[] AS c, sqrt(list_inner_product((embedding::DOUBLE[])[1:12],(embedding::DOUBLE[])[1:12])) AS l FROM embeddings WHERE vec_id%4<>0)"


@query(f"WITH {PITCH} SELECT g.song_id, k AS bin, round(CASE WHEN voiced>=10 THEN coalesce(n,0)/t WHEN l IS NULL OR k%3<>0 THEN 0 ELSE c[k//3+1]/l END,6)+0 AS value FROM (SELECT * FROM nn, unnest(generate_series(0,35)) u(k)) g LEFT JOIN b ON b.song_id=g.song_id AND b.bin=k LEFT JOIN ch ON ch.song_id=g.song_id")
def pitch_histogram(spark, d):
    """Songs with few voiced frames take a 12-bin profile, which every fourth one lacks."""
    chroma = table(spark, d, "embeddings").where("vec_id % 4 <> 0").select(F.col("vec_id").alias("song_id"), F.slice("embedding", 1, 12).alias("chroma"))
    h = R.pitch_histogram(fr(spark, d), chroma).select("song_id", F.posexplode("vec").alias("bin", "value"))
    return h.select("song_id", F.col("bin").cast("long").alias("bin"), (F.round("value", 6) + 0).alias("value"))


SPECTRUM = f"{FR}, vv AS (SELECT song_id, v, row_number() OVER (PARTITION BY song_id ORDER BY i) AS j, count(*) OVER (PARTITION BY song_id)-1 AS n FROM fr WHERE voiced), df AS (SELECT song_id, j-2 AS j, n, v-lag(v) OVER (PARTITION BY song_id ORDER BY j) AS d FROM vv), sp AS (SELECT song_id, n, k, sqrt(power(sum(d*cos(2*pi()*k*j/n)),2)+power(sum(d*sin(2*pi()*k*j/n)),2)) AS m FROM df, unnest(generate_series(0,n//2)) u(k) WHERE d IS NOT NULL AND n>=31 GROUP BY ALL)"


@query(f"WITH {SPECTRUM}, pw AS (SELECT song_id, sum(m*m) AS t, coalesce(sum(m*m) FILTER (k*86.0/n BETWEEN 5 AND 15),0) AS b FROM sp GROUP BY song_id) SELECT song_id, round(CASE WHEN t>1e-12 THEN b/t ELSE 0 END,6)::DOUBLE AS ratio FROM (SELECT DISTINCT song_id FROM vv) LEFT JOIN pw USING (song_id)")
def band_power_ratio(spark, d):
    return R.band_power_ratio(fr(spark, d)).withColumn("ratio", F.round("ratio", 6))


@query(f"WITH {SPECTRUM} SELECT song_id, k AS bin, round(m,4) AS magnitude FROM sp")
def spectral_udf(spark, d):
    return R.spectrum(fr(spark, d)).withColumn("magnitude", F.round("magnitude", 4))


@query(f"WITH {FR}, n AS (SELECT song_id, count(*) AS n FROM fr GROUP BY song_id), c AS (SELECT song_id, s FROM n, unnest(generate_series(10, greatest(n-15,9), 5)) u(s)), p AS (SELECT c.song_id, s, round(sqrt(avg(v*v)),9) AS rms FROM c JOIN fr ON fr.song_id=c.song_id AND i>=s AND i<s+15 GROUP BY ALL), b AS (SELECT song_id, s FROM p QUALIFY row_number() OVER (PARTITION BY song_id ORDER BY rms DESC, s)=1) SELECT song_id, coalesce(s,0) AS start FROM n LEFT JOIN b USING (song_id)")
def loudest_window(spark, d):
    return R.loudest_window(fr(spark, d), 15, 5, 10)


@query(f"WITH {FR}, n AS (SELECT *, count(*) OVER (PARTITION BY song_id) AS n FROM fr) SELECT song_id, i FROM n WHERE CASE WHEN n-20>=30 THEN i>=10 AND i<n-10 AND i<50 ELSE true END")
def trim_edges(spark, d):
    return R.trim_edges(fr(spark, d), 10, 40, 30).select("song_id", "i")


RATE = f"{FR}, q AS (SELECT song_id, quantile_cont(v,0.75) AS p FROM fr GROUP BY song_id), o AS (SELECT song_id, max(v)/2 AS tempo, avg((v>p)::INT) AS rate FROM fr JOIN q USING (song_id) GROUP BY song_id), fx AS (SELECT song_id, CASE WHEN tempo>160 OR (tempo>120 AND rate<0.3) THEN tempo/2 ELSE tempo END AS tempo FROM o)"


def _tempo(spark, d) -> DataFrame:
    f = fr(spark, d)
    p = f.groupBy("song_id").agg(F.percentile("v", F.lit(0.75)).alias("p"))
    o = f.join(p.hint("merge"), "song_id").groupBy("song_id").agg((F.max("v") / 2).alias("tempo"), F.avg((F.col("v") > F.col("p")).cast("int")).alias("rate"))
    return o.select("song_id", music.tempo_octave_fix(F.col("tempo"), F.col("rate")).alias("tempo"))


@query(f"WITH {RATE} SELECT song_id, round(tempo,6) AS tempo FROM fx")
def tempo_octave_fix(spark, d):
    return _tempo(spark, d).withColumn("tempo", F.round("tempo", 6))


@query(f"WITH {RATE} SELECT song_id, (tempo<80)::INT AS b0, (tempo>=80 AND tempo<100)::INT AS b1, (tempo>=100 AND tempo<120)::INT AS b2, (tempo>=120)::INT AS b3 FROM fx")
def tempo_bucket(spark, d):
    b = music.tempo_bucket(F.col("tempo"))
    return _tempo(spark, d).select("song_id", *[b[i].alias(f"b{i}") for i in range(4)])


@query(f"WITH {RATE} SELECT song_id, CASE WHEN tempo<80 THEN 'Slow' WHEN tempo<100 THEN 'Medium' WHEN tempo<120 THEN 'Upbeat' ELSE 'Fast' END AS label FROM fx")
def tempo_label(spark, d):
    return _tempo(spark, d).select("song_id", music.tempo_label(music.tempo_bucket(F.col("tempo"))).alias("label"))


@query("WITH b AS (SELECT vec_id, k, embedding[3*k+1]::DOUBLE+embedding[3*k+2]::DOUBLE+embedding[3*k+3]::DOUBLE AS s FROM embeddings, unnest(generate_series(0,11)) u(k)), n AS (SELECT vec_id, sqrt(sum(s*s)) AS n FROM b GROUP BY vec_id) SELECT vec_id, k AS bin, round(s/n,6) AS value FROM b JOIN n USING (vec_id)")
def pcp_downsample(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.posexplode(vectors.fold_pitch_bins(F.slice("embedding", 1, 36))).alias("bin", "value"))
    return v.select("vec_id", F.col("bin").cast("long").alias("bin"), F.round("value", 6).alias("value"))


@query("WITH b AS (SELECT vec_id, k, CASE WHEN k%3=0 THEN embedding[k//3+1]::DOUBLE ELSE 0 END AS s FROM embeddings, unnest(generate_series(0,35)) u(k)), n AS (SELECT vec_id, sqrt(sum(s*s)) AS n FROM b GROUP BY vec_id) SELECT vec_id, k AS bin, round(s/n,6)+0 AS value FROM b JOIN n USING (vec_id)")
def chroma_interleave(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.posexplode(vectors.spread_pitch_bins(F.slice("embedding", 1, 12))).alias("bin", "value"))
    return v.select("vec_id", F.col("bin").cast("long").alias("bin"), (F.round("value", 6) + 0).alias("value"))


# Templates follow from a rule here: template t has the tones at the multiples of t + 2 among twelve.
TEMPLATES = "t AS (SELECT t, k, CASE WHEN (k*(t+2))%12 < 7 THEN 1.0 ELSE 0.0 END AS w FROM unnest(generate_series(0,29)) a(t), unnest(generate_series(0,11)) b(k))"


CHAIN = "pf AS (SELECT vec_id, k, CASE vec_id%3 WHEN 0 THEN e[3*k+1]+e[3*k+2]+e[3*k+3] WHEN 1 THEN e[k+1] END AS p FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), unnest(generate_series(0,11)) u(k))"


@query(f"WITH {TEMPLATES}, {CHAIN}, tn AS (SELECT t, sqrt(sum(w*w)) AS n FROM t GROUP BY t), pn AS (SELECT vec_id, sqrt(sum(p*p)) AS n FROM pf GROUP BY vec_id), c AS (SELECT pf.vec_id, t.t, sum(p*w)/max(tn.n)/max(pn.n) AS c FROM pf JOIN pn USING (vec_id) JOIN t USING (k) JOIN tn ON t.t=tn.t GROUP BY ALL), x AS (SELECT vec_id, t, exp(c/0.5) AS e FROM c) SELECT vec_id, t AS template, coalesce(round(e/sum(e) OVER (PARTITION BY vec_id),6),0)::DOUBLE AS prob FROM x")
def template_softmax(spark, d):
    """The chain of profiles: 36 bins where stored, else 12, else zeros; cosine to each template, softmax at 0.5."""
    tones = [[1.0 if (k * (t + 2)) % 12 < 7 else 0.0 for k in range(12)] for t in range(30)]
    templates = F.array(*[F.array(*map(F.lit, t)) for t in tones])
    k = F.col("vec_id") % 3
    fine, coarse = F.when(k == 0, F.slice("embedding", 1, 36)), F.when(k == 1, F.slice("embedding", 1, 12))
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(vectors.profile_chain(fine, coarse, templates, 30)).alias("template", "prob"))
    return e.select("vec_id", F.col("template").cast("long").alias("template"), F.round("prob", 6).alias("prob"))


TOK = f"{FR}, tk AS (SELECT song_id AS id, list(CASE WHEN event_type='error' THEN 0 ELSE greatest(0,least(208,round_even(log2(v/5)*60,0)))::INT END ORDER BY i) AS tokens FROM fr GROUP BY song_id)"


def tokens(spark, d) -> DataFrame:
    """id, tokens, label (id mod 5) of each user's events."""
    pitch = F.when(F.col("voiced"), F.col("v")).otherwise(0.0)
    g = fr(spark, d).groupBy(F.col("song_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", pitch.alias("p")))), lambda x: x.p).alias("p"))
    return g.select("id", Q.cents_tokens(F.col("p"), F.lit(5.0)).alias("tokens"), (F.col("id") % 5).alias("label"))


@query(f"WITH {TOK} SELECT id, array_to_string(tokens,',') AS tokens FROM tk")
def cents_tokens(spark, d):
    return tokens(spark, d).select("id", F.array_join(F.col("tokens").cast("array<string>"), ",").alias("tokens"))


SEG = TOK + ", cut AS (SELECT id, s AS start, list_slice(tokens,s+1,s+16) AS w FROM tk, unnest(generate_series(0,greatest(0,len(tokens)-16),{stride})) u(s) WHERE len(tokens)>=8), sg AS (SELECT id, start, w, len(list_filter(w, lambda x: x>0))/16.0 AS share FROM cut), kept AS (SELECT id, start, w, share FROM sg QUALIFY share>=0.7 OR row_number() OVER (PARTITION BY id ORDER BY share DESC, start)=1), cp AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY id ORDER BY start)<=6)"


@query("WITH " + SEG.format(stride="8") + " SELECT id, start::INT AS start, list_sum(w)::BIGINT AS total, share::DOUBLE AS share FROM cp")
def segment_windows(spark, d):
    s = Q.segments(tokens(spark, d), 16, F.lit(8), 0.7, 6)
    return s.select("id", "start", F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), "share")


@query("WITH " + SEG.format(stride="(CASE WHEN id%3=0 THEN 16 ELSE 8 END)") + " SELECT id, count(*) AS n FROM cp GROUP BY id")
def train_eval_stride(spark, d):
    return Q.segments(tokens(spark, d), 16, F.when(F.col("id") % 3 == 0, 16).otherwise(8), 0.7, 6).groupBy("id").agg(F.count("*").alias("n"))


@query(f"WITH {FR}, q AS (SELECT song_id, quantile_cont(v,0.75) AS p, count(*) AS n FROM fr GROUP BY song_id), c AS (SELECT song_id, p, s FROM q, unnest(generate_series(0,greatest(0,n-8),15)) u(s)), w AS (SELECT c.song_id, s, p, avg(v) AS m FROM c JOIN fr ON fr.song_id=c.song_id AND i>=s AND i<s+15 GROUP BY ALL) SELECT song_id, s AS start FROM w QUALIFY round(m,9)>=round(0.9*p,9) OR row_number() OVER (PARTITION BY song_id ORDER BY round(m,9) DESC, s)=1")
def energy_gate(spark, d):
    """Windows of 15 frames (the last from 8) as loud as 0.9 of the song's upper quartile; else the loudest."""
    return R.energy_gate(fr(spark, d), 15, 8, 0.9)


SPLIT = "files AS (SELECT c_custkey AS id, c_nationkey AS label FROM customer), pl AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(id::VARCHAR||':7'), id) AS r, count(*) OVER (PARTITION BY label) AS n FROM files)"


def _files(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("label"))


@query(f"WITH {SPLIT} SELECT id, label, CASE WHEN n>=3 AND r=1 THEN 'test' WHEN n>=3 AND r=2 THEN 'val' ELSE 'train' END AS split FROM pl")
def group_split(spark, d):
    return Q.group_split(_files(spark, d))


@query(f"WITH {SPLIT} SELECT id, label FROM pl WHERE r<=20")
def cap_per_class(spark, d):
    return Q.cap_per_class(_files(spark, d), 20)


@query("SELECT c_custkey AS id, 'train' AS split FROM customer WHERE c_custkey%10<8 UNION ALL SELECT c_custkey, 'val' FROM customer WHERE c_custkey%10=8 UNION ALL SELECT c_custkey, 'test' FROM customer WHERE c_custkey%10=9")
def union_splits(spark, d):
    f, m = _files(spark, d).select("id"), F.col("id") % 10
    return f.where(m < 8).withColumn("split", F.lit("train")).unionByName(f.where(m == 8).withColumn("split", F.lit("val"))).unionByName(f.where(m == 9).withColumn("split", F.lit("test")))


HASHED = "('0x'||substr(md5(id||':'||k||':{seed}'),1,8))::BIGINT"


@query(f"WITH {TOK}, cu AS (SELECT id, {HASHED.format(seed=7)} % greatest(len(tokens),1) AS a, {HASHED.format(seed=8)} % 10 + 1 AS w FROM tk, unnest([1,2,3]) u(k)), ct AS (SELECT id, list({{'a': a, 'w': w}}) AS cuts FROM cu GROUP BY id) SELECT id, array_to_string(list_transform(range(len(tokens)), lambda i: CASE WHEN len(list_filter(cuts, lambda c: i>=c.a AND i<c.a+c.w))>0 THEN 0 ELSE tokens[i+1] END),',') AS tokens FROM tk JOIN ct USING (id)")
def mask_spans(spark, d):
    t = tokens(spark, d)
    return t.select("id", F.array_join(Q.mask_spans(F.col("tokens"), F.col("id"), 3, 10, F.lit(0)).cast("array<string>"), ",").alias("tokens"))


BAND = "SELECT id, list({{'a': a, 'w': w}}) AS cuts FROM (SELECT id, w, ('0x'||substr(md5(id||':'||k||':{b}'),1,8))::BIGINT % greatest(8-w+1,1) AS a FROM (SELECT id, k, ('0x'||substr(md5(id||':'||k||':{a}'),1,8))::BIGINT % {most} AS w FROM sp, unnest([1,2]) u(k))) WHERE w>0 AND w<8 GROUP BY id"
IN_BAND = "coalesce(len(list_filter({c}, lambda x: {i}>=x.a AND {i}<x.a+x.w)),0)>0"


@query(f"WITH sp AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), fq AS ({BAND.format(a=17, b=18, most=4)}), ti AS ({BAND.format(a=27, b=28, most=6)}) SELECT sp.id, i//8 AS r, i%8 AS t, round(CASE WHEN {IN_BAND.format(c='fq.cuts', i='(i//8)')} OR {IN_BAND.format(c='ti.cuts', i='(i%8)')} THEN list_sum(v)/64 ELSE v[i+1] END,6)+0 AS value FROM sp LEFT JOIN fq USING (id) LEFT JOIN ti USING (id), unnest(generate_series(0,63)) u(i)")
def mask_bands(spark, d):
    """Vectors as spectra of eight by eight, with two bands of rows and two of columns set to the mean."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.array(*[F.slice("embedding", 8 * r + 1, 8) for r in range(8)]).alias("s"))
    m = e.select("id", F.posexplode(Q.mask_bands(F.col("s"), F.col("id"), (2, 3), (2, 5))).alias("r", "row"))
    return m.select("id", F.col("r").cast("long").alias("r"), F.posexplode("row").alias("t", "value")).select("id", "r", F.col("t").cast("long").alias("t"), (F.round("value", 6) + 0).alias("value"))


@query("WITH c AS (SELECT event_type AS label, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT sum(n) AS a, count(*) AS k FROM c) SELECT label, round(n/a,9)::DOUBLE AS prior, round(a/(k*n),9)::DOUBLE AS weight FROM c, t")
def class_priors_weights(spark, d):
    p = Q.priors_weights(table(spark, d, "events").select(F.col("event_type").alias("label")))
    return p.select("label", F.round("prior", 9).alias("prior"), F.round("weight", 9).alias("weight"))


PRED = "pr AS (SELECT user_id AS file, user_id%5 AS label, CASE WHEN event_id%3=0 THEN user_id%5 ELSE event_id%5 END AS pred FROM events), vt AS (SELECT file, pred AS vote FROM (SELECT file, pred, count(*) AS n FROM pr GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY file ORDER BY n DESC, pred)=1)"


def _pred(spark, d) -> DataFrame:
    u, e = F.col("user_id"), F.col("event_id")
    return table(spark, d, "events").select(u.alias("file"), (u % 5).alias("label"), F.when(e % 3 == 0, u % 5).otherwise(e % 5).alias("pred"))


@query(f"WITH {PRED} SELECT file, vote FROM vt")
def majority_vote(spark, d):
    return Q.majority_vote(_pred(spark, d))


@query(f"WITH {PRED}, s AS (SELECT label, count(*) AS segments, avg((pred=label)::INT) AS seg_acc FROM pr GROUP BY ROLLUP(label)), f AS (SELECT label, count(*) AS files, avg((vote=label)::INT) AS file_acc FROM vt JOIN (SELECT DISTINCT file, label FROM pr) USING (file) GROUP BY ROLLUP(label)) SELECT coalesce(s.label::VARCHAR,'all') AS label, segments, round(seg_acc,6) AS seg_acc, files, round(file_acc,6) AS file_acc FROM s JOIN f ON s.label IS NOT DISTINCT FROM f.label")
def accuracy_report(spark, d):
    r = Q.accuracy_report(_pred(spark, d))
    return r.select(F.coalesce(F.col("label").cast("string"), F.lit("all")).alias("label"), "segments", F.round("seg_acc", 6).alias("seg_acc"), "files", F.round("file_acc", 6).alias("file_acc"))


@query(f"""WITH {FR}, sq AS (SELECT song_id AS id, song_id%3 AS label, (v/20)::INT%8 AS t, lead((v/20)::INT%8) OVER (PARTITION BY song_id ORDER BY i) AS u FROM fr), tr AS (SELECT label, t, u FROM sq WHERE id%4<>0 AND u IS NOT NULL), mv AS (SELECT label, t, u, count(*) AS c FROM tr GROUP BY ALL), ot AS (SELECT label, t, count(*) AS o FROM tr GROUP BY ALL),
 np AS (SELECT label, count(*) AS n FROM (SELECT DISTINCT id, label FROM sq WHERE id%4<>0) GROUP BY label), pi AS (SELECT label, ln(n/(SELECT sum(n) FROM np)) AS base FROM np), ts AS (SELECT DISTINCT id, NULL AS t, NULL AS u, 0 AS k FROM sq WHERE id%4=0 UNION ALL SELECT id, t, u, count(*) FROM sq WHERE id%4=0 AND u IS NOT NULL AND id%16<>0 GROUP BY ALL),
 ll AS (SELECT ts.id, pi.label, max(base)+coalesce(sum(CASE WHEN k>0 THEN k*ln((coalesce(c,0)+1.0)/(coalesce(o,0)+8.0)) END),0) AS ll FROM ts CROSS JOIN pi LEFT JOIN mv ON mv.label=pi.label AND mv.t=ts.t AND mv.u=ts.u LEFT JOIN ot ON ot.label=pi.label AND ot.t=ts.t GROUP BY ts.id, pi.label)
 SELECT id, label AS pred, round(ll,4)::DOUBLE AS loglik FROM ll QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(ll,6) DESC, label)=1""".replace("(v/20)::INT", "trunc(v/20)::INT"))
def markov_classifier(spark, d):
    g = fr(spark, d).groupBy(F.col("song_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", ((F.col("v") / 20).cast("int") % 8).alias("t")))), lambda x: x.t).alias("tokens"))
    # Some test sequences keep their first token only: they have no transition.
    g = g.withColumn("label", F.col("id") % 3).withColumn("tokens", F.when(F.col("id") % 16 == 0, F.slice("tokens", 1, 1)).otherwise(F.col("tokens")))
    out = Q.markov_classifier(g.where("id % 4 <> 0"), g.where("id % 4 = 0"), 8)
    return out.select("id", "pred", F.round("loglik", 4).alias("loglik"))


CENSUS = "v AS (SELECT vec_id, len(embedding)::INT AS dims FROM embeddings UNION ALL SELECT -vec_id, (len(embedding)-1)::INT FROM embeddings WHERE vec_id%50=0), cs AS (SELECT dims, count(*) AS n FROM v GROUP BY ALL), dm AS (SELECT dims AS dominant FROM cs ORDER BY n DESC, dims DESC LIMIT 1)"


@query(f"WITH {CENSUS} SELECT vec_id, dims, dominant, n FROM v JOIN cs USING (dims), dm WHERE dims<>dominant")
def dimension_check(spark, d):
    """The vectors whose length isn't the most frequent one; every fiftieth has a copy that lacks its last component."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    v = e.unionByName(e.where("vec_id % 50 = 0").select((-F.col("vec_id")).alias("vec_id"), F.slice("embedding", 1, F.size("embedding") - 1).alias("embedding")))
    sizes = features.dimension_census(v, "embedding").select("dims", "n")
    return features.offenders(v, "embedding").select("vec_id", "dims", "dominant").join(sizes.hint("merge"), "dims")
