"""Edge cases by hand, invariants, and brute force where SQL has no words."""

import itertools
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from melodex.functions import music, text, vectors
from melodex.operators import ann, catalogue, evaluation, features, feedback, frames, fusion, linkage, rerank, search, sequences, statistics
from melodex.sources import files
from melodex.streaming import jobs


def one(spark, column, **values):
    return spark.createDataFrame([Row(**(values or {"z": 1}))]).select(column.alias("x")).first().x


def test_weights_add_up(spark):
    cats = [*fusion.CATEGORY_CLAP, "other"]
    rows = [(a, b, c, k) for a, b, c in itertools.product([True, False], repeat=3) for k in cats]
    df = spark.createDataFrame(rows, "a boolean, b boolean, c boolean, k string")
    w = fusion.fusion_weights(F.col("a"), F.col("b"), F.col("c"), F.col("k"))
    for r in df.select("*", *[x.alias(n) for n, x in w.items()]).collect():
        assert abs(sum(r[n] for n in w) - 1) < 1e-9
        assert not r.a or r.nlp == 0
        assert not r.c or r.clap == 0


def test_unit_and_cosine(spark):
    arr = lambda *v: F.array(*map(F.lit, v))
    assert one(spark, vectors.unit(arr(3.0, 4.0))) == pytest.approx([0.6, 0.8])
    assert one(spark, vectors.unit(arr(0.0, 1e-9))) == [0.0, 1e-9]
    assert one(spark, vectors.cosine(arr(0.0, 0.0), arr(1.0, 0.0))) == 0


@pytest.mark.parametrize("given,start", [("-5", 0), ("15.7", 15), ("abc", 15), (None, 15), ("", 15), ("inf", 15), ("NaN", 15), (" 7 ", 7)])
def test_clip_start(spark, given, start):
    assert one(spark, text.parse_clip_start(F.lit(given).cast("string"))) == start


def test_ids_and_lyrics(spark):
    assert one(spark, text.make_song_id(F.lit("Tum-Hi Ho!"), F.lit("A. R"))) == "tum_hi_ho__a__r"
    assert len(one(spark, text.make_song_id(F.lit("x" * 80), F.lit("y")))) == 50
    assert one(spark, text.clean_lyrics(F.lit("Tum Hi Ho Lyrics\n\n\n\n\nhey\n\n\n\nyou543Embed"))) == "hey\n\nyou"
    assert one(spark, text.clean_lyrics(F.lit(None).cast("string"))) is None


def test_mood(spark):
    words = {"a": ["la", "lala"], "b": ["bo"]}
    tag = lambda t: one(spark, text.mood_tag(F.lit(t).cast("string"), words))
    assert tag("LALA bo") == "a" and tag("la bo") is None and tag("xyz") is None and tag(None) is None and tag("abobo") == "b"
    assert one(spark, text.mood_tag(F.lit("Dil mein ishq hai"))) == "romantic"


@pytest.mark.parametrize("tempo,place", [(79.99, 0), (80.0, 1), (100.0, 2), (120.0, 3), (float("nan"), 3), (None, None)])
def test_tempo_bucket(spark, tempo, place):
    got = one(spark, music.tempo_bucket(F.lit(tempo).cast("double")))
    assert got == (None if place is None else [int(i == place) for i in range(4)])
    assert one(spark, music.tempo_label(F.array(F.lit(1)))) == "Unknown"


@pytest.mark.parametrize("tempo,rate,fixed", [(160.1, 0.9, 80.05), (160.0, 0.25, 80.0), (160.0, 0.3, 160.0), (120.0, 0.1, 120.0)])
def test_tempo_octave(spark, tempo, rate, fixed):
    assert one(spark, music.tempo_octave_fix(F.lit(tempo), F.lit(rate))) == pytest.approx(fixed)


def test_record_score(spark):
    def said(d, a):
        score, ok = text.record_score(F.lit(d).cast("string"), F.lit(a).cast("string"))
        return one(spark, F.struct(score.alias("s"), ok.alias("o")))

    assert tuple(said("Song composed by X", "x")) == (8, True)
    assert tuple(said("vocal track on an album", None)) == (-1, False)
    assert tuple(said(None, "x")) == (0, False)


def test_upsert_patch_migrate(spark):
    old = spark.createDataFrame([(1, "a", "g1"), (2, "b", "g2")], "id int, title string, genre string")
    new = spark.createDataFrame([(2, 1, "x"), (2, 2, "y"), (3, 1, "z")], "id int, seq int, title string")
    assert sorted(map(tuple, catalogue.upsert(old, new, "id", "seq").collect())) == [(1, "a", "g1"), (2, "y", None), (3, "z", None)]
    assert sorted(map(tuple, catalogue.upsert(old, new, "id", "seq", preserve=True).collect())) == [(1, "a", "g1"), (2, "y", "g2"), (3, "z", None)]
    p = spark.createDataFrame([(1, None, []), (2, "n", None)], "id int, title string, genre array<string>")
    assert sorted(map(tuple, catalogue.patch(old, p, "id", lists=("genre",)).collect())) == [(1, "a", None), (2, "n", "g2")]
    m = catalogue.migrate(catalogue.migrate(old, {"flag": ("int", 0)}), {"flag": ("int", 9)})
    assert {r.flag for r in m.collect()} == {0}


def test_missing_columns(spark, tmp_path):
    spark.createDataFrame([("a",)], "title string").write.option("header", True).csv(str(tmp_path / "c"))
    with pytest.raises(ValueError, match="artist"):
        files.read_catalogue(spark, str(tmp_path / "c"))


def test_topk_monotone_and_exact(spark):
    x = np.random.default_rng(0).normal(size=(300, 8))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "song_id long, vec array<double>")
    q = v.withColumnRenamed("song_id", "query_id")
    ten = {(r.query_id, r.rank): r.song_id for r in search.topk(q, v, 10).collect()}
    three = {(r.query_id, r.rank): r.song_id for r in search.topk(q, v, 3).collect()}
    assert three.items() <= ten.items()
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    assert all(ten[i, r + 1] == j for i in range(300) for r, j in enumerate(np.argsort(-s[i])[:10]))


def test_approximate_recall(spark):
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(30, 16)), 20, axis=0) + 0.1 * rng.normal(size=(600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "song_id long, vec array<double>")
    q = v.where("song_id % 20 = 0").withColumnRenamed("song_id", "query_id")
    exact = search.topk(q, v, 5)
    assert ann.recall(ann.ivf_topk(q, v, 5, probes=6), exact) >= 0.9
    assert ann.recall(ann.pq_topk(q, v, 5), exact) >= 0.9


def test_pca(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 3)) @ np.diag([5.0, 1.0, 0.01]) + 7
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "song_id long, vec array<double>")
    scaler, pca, total = ann.pca_fit(v, 2)
    assert total > 0.99
    assert all(abs(np.linalg.norm(r.vec) - 1) < 1e-9 for r in ann.pca_project(v, scaler, pca).collect())
    with pytest.raises(ValueError):
        ann.pca_fit(v.limit(5))


def test_ideal_ranking(spark):
    j = spark.createDataFrame([(1, i, g, 0) for i, g in enumerate([2, 2, 1, 0])], "query_id long, song_id long, grade int, pos int")
    r = spark.createDataFrame([(1, i + 1, i) for i in range(4)], "query_id long, rank long, song_id long")
    got = evaluation.ndcg(r, j, 5).first()
    assert got.ndcg == pytest.approx(1) and got.precision == 0.75
    none = evaluation.ndcg(r, j.withColumn("grade", F.lit(0)), 5).first()
    assert none.ndcg == 0


def test_signals(spark):
    a = {"artist": F.lit(""), "tempo": F.lit(None).cast("double"), "vocal_energy": F.lit(0.2)}
    c = {"artist": F.lit(""), "tempo": F.lit(100.0), "vocal_energy": F.lit(0.5)}
    assert one(spark, rerank.SIGNALS["artist"](a, c)) == 0
    assert one(spark, rerank.SIGNALS["tempo"](a, c)) == 0
    assert one(spark, rerank.SIGNALS["vocal_energy"](a, c)) == pytest.approx(0.7)
    with pytest.raises(ValueError):
        rerank.rerank_score(a, c, {"nothing": 1.0})
    assert rerank.weights_from(["tempo=1", "tempo=2"])["tempo"] == 2
    rerank.signal("always")(lambda a, c: F.lit(1.0))
    assert one(spark, rerank.rerank_score(a, c, {"always": 0.5})) == 0.5
    del rerank.SIGNALS["always"]


def test_centroid_and_rocchio(spark):
    v = spark.createDataFrame([("s", "approve", [1.0, 0.0]), ("s", "approve", [1.0, 0.0]), ("s", "reject", [0.0, 1.0])], "session_id string, verdict string, vec array<double>")
    s = spark.createDataFrame([("s", [1.0, 1.0]), ("t", [3.0, 4.0])], "session_id string, vec array<double>")
    got = {r.session_id: r.vec for r in feedback.rocchio(s, v).collect()}
    want = np.array([1.75, 0.75]) / np.hypot(1.75, 0.75)
    assert got["s"] == pytest.approx(want.tolist()) and got["t"] == pytest.approx([0.6, 0.8])


def test_band_power(spark):
    t = np.arange(200) / 86.0
    rows = [(1, i, float(100 + np.sin(2 * np.pi * 8 * x)), True) for i, x in enumerate(t)] + [(2, i, 1.0 * i, True) for i in range(31)]
    df = spark.createDataFrame(rows, "song_id long, i long, v double, voiced boolean")
    got = {r.song_id: r.ratio for r in frames.band_power_ratio(df).collect()}
    v = np.array([r[2] for r in rows if r[0] == 1])
    k, n = np.arange(100)[:, None], np.arange(199)
    power = np.abs((np.diff(v) * np.exp(-2j * np.pi * k * n / 199)).sum(axis=1)) ** 2
    f = k[:, 0] * 86.0 / 199
    assert got[1] == pytest.approx(power[(f >= 5) & (f <= 15)].sum() / power.sum(), abs=1e-6) and got[2] == 0


def test_segments_fallback_and_padding(spark):
    df = spark.createDataFrame([(1, [0] * 20), (2, [5] * 6), (3, [5] * 2)], "id long, tokens array<int>")
    got = {(r.id, r.start): r.tokens for r in sequences.segments(df, 8, F.lit(4)).collect()}
    assert list(got) == [(1, 0), (2, 0)] or sorted(got) == [(1, 0), (2, 0)]
    assert got[2, 0] == [5] * 6 + [0] * 2


def test_mask_spans(spark):
    df = spark.createDataFrame([(i, list(range(1, 51))) for i in range(5)], "id long, tokens array<int>")
    a, b = (df.select("id", sequences.mask_spans(F.col("tokens"), F.col("id"), 2, 5, F.lit(0)).alias("t")).collect() for _ in range(2))
    assert a == b
    for r in a:
        assert all(x in (0, i + 1) for i, x in enumerate(r.t)) and 1 <= r.t.count(0) <= 10


def test_split_keeps_files_apart(spark):
    df = spark.createDataFrame([(i, i % 3 if i < 9 else 7) for i in range(10)], "id long, label long")
    got = sequences.group_split(df).collect()
    assert len(got) == 10 and [r.split for r in got if r.label == 7] == ["train"]
    assert all(sorted(r.split for r in got if r.label == k) == ["test", "train", "val"] for k in range(3))


@pytest.mark.parametrize("blocks", [True, False])
def test_fuzzy_match_loses_nothing(spark, blocks):
    titles = ["tide", "diet", "dil se", "dil chahta hai", "kabira", ""]
    artists = ["a r rahman", "ar rahman", "pritam", "sukhwinder singh", ""]
    cat = [(t, a, i) for i, (t, a) in enumerate(itertools.product(titles, artists))]
    ext = [("dil sey", "a r rehman"), ("diet", "pritam"), ("tide", "pritamm"), ("kabira", "sukhwinder singh sapna awasthi"), ("zzz", "qqq")]

    def sim(a, b):
        if blocks:
            return SequenceMatcher(None, a, b).ratio()
        d = list(range(len(b) + 1))
        for i, x in enumerate(a):
            p, d[0] = d[0], i + 1
            for j, y in enumerate(b):
                p, d[j + 1] = d[j + 1], min(d[j + 1] + 1, d[j] + 1, p + (x != y))
        return 1 - d[-1] / max(len(a), len(b)) if a or b else 1.0

    want = {}
    for t, a in ext:
        best = max(((round(0.7 * sim(t, ct) + 0.3 * sim(a, ca), 9), -i) for ct, ca, i in cat if sim(a, ca) >= 0.55), default=(0, 0))
        if best[0] >= 0.72:
            want[t, a] = -best[1]
    x = spark.createDataFrame(ext, "title string, artist string")
    c = spark.createDataFrame(cat, "title string, artist string, song_id long")
    assert {(r.title, r.artist): r.song_id for r in linkage.fuzzy_match(x, c, blocks).collect()} == want


def test_ratio_is_not_symmetric(spark):
    r = linkage.sequence_ratio()
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide")], "a string, b string").select(r("a", "b").alias("r"))
    assert [x.r for x in df.collect()] == [0.25, 0.5]


def test_flatten_similar(spark):
    docs = spark.createDataFrame([('{"error": 6}',), ('{"similartracks": {"track": [{"name": "a", "artist": {"name": "b"}, "match": "x"}, {"name": "c"}]}}',), ("{",), (None,)], "doc string")
    assert [(r.title, r.artist, r.match) for r in linkage.flatten_similar(docs, "doc").collect()] == [("a", "b", 0.0)]


def test_kth_smallest(spark):
    values = [i * 37 % 1000 for i in range(3000)] + [5] * 2000 + [None] * 10
    df = spark.createDataFrame([(v,) for v in values], "v int")
    want = sorted(v for v in values if v is not None)
    assert all(statistics.kth_smallest(df, "v", k, few=50) == want[k] for k in (0, 17, 2010, 2600, 4999))
    assert statistics.kth_smallest(df, "v", 5000, few=50) is None


def test_weight_overrides(spark):
    given = [None, "", "tempo=1,tempo=0.25", "artist=0,mood=2.5", "tempo=-1e-3,"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i long, t string")
    got = {r.i: r.w for r in df.select("i", rerank.weight_overrides(F.col("t")).alias("w")).collect()}
    assert all(got[i] == rerank.weights_from([p for p in (t or "").split(",") if p]) for i, t in enumerate(given))
    for bad in ("nothing=1", "tempo", "tempo=x"):
        with pytest.raises(Exception, match="no such weight"):
            df.limit(1).select(rerank.weight_overrides(F.lit(bad))).collect()


def test_feature_defaults(spark):
    rows = [(1, None, None, None, [1, 0]), (2, 110.0, float("nan"), [1.0] * 3, [0, 0, 0, 1]), (3, 70.0, 0.1, None, None)]
    df = spark.createDataFrame(rows, "id long, tempo double, energy double, pcp array<double>, tempo_bucket array<int>")
    got = {r.id: r for r in features.with_defaults(df, {"pcp": 3}).collect()}
    assert (got[1].tempo, got[1].energy, got[1].pcp, got[1].tempo_bucket) == (100.0, 0.5, [0.0] * 3, [0, 0, 1, 0])
    assert got[2].energy != got[2].energy and got[2].tempo_bucket == [0, 0, 0, 1] and got[3].tempo_bucket == [1, 0, 0, 0]
    v = spark.createDataFrame([(1, None), (2, []), (3, [1.0]), (4, [1.0, 2.0])], "id long, v array<double>")
    vec, missing = features.vector_or_zeros(F.col("v"), 2)
    assert [tuple(r) for r in v.select(vec.alias("v"), missing.alias("m")).collect()] == [([0.0, 0.0], True)] * 3 + [([1.0, 2.0], False)]


def test_dimensions(spark):
    rows = [(i, [1.0] * 3) for i in range(12)] + [(50, [1.0]), (51, [1.0] * 4), (52, None)]
    df = spark.createDataFrame(rows, "song_id long, vec array<double>")
    assert sorted(tuple(r) for r in features.dimension_census(df).collect()) == [(1, 1, 3), (3, 12, 3), (4, 1, 3)]
    assert sorted((r.song_id, r.dims) for r in features.offenders(df).collect()) == [(50, 1), (51, 4)]
    with pytest.raises(ValueError, match=r"3 is the most frequent.*50 \(1\), 51 \(4\)"):
        features.require_one_dimension(df)
    with pytest.raises(ValueError, match="there are 9"):
        features.require_one_dimension(df.where("song_id < 9"))
    with pytest.raises(ValueError, match="there are 0"):
        features.require_one_dimension(df.limit(0))
    assert features.require_one_dimension(df.where("song_id < 20 or song_id = 52")) == (12, 3)


def test_pitch_fall_back(spark):
    rows = [(1, i, 440.0, True) for i in range(10)] + [(2, i, 440.0, i < 9) for i in range(20)] + [(3, 0, None, None)]
    chroma = spark.createDataFrame([(2, [3.0] + [0.0] * 10 + [4.0]), (1, [1.0] * 12)], "song_id long, chroma array<double>")
    df = spark.createDataFrame(rows, "song_id long, i long, v double, voiced boolean")
    got = {r.song_id: r.vec for r in frames.pitch_histogram(df, chroma).collect()}
    assert got[1].index(1.0) == 69 * 3 % 36 and sum(got[1]) == 1
    assert (got[2][0], got[2][33]) == (pytest.approx(0.6), pytest.approx(0.8)) and got[3] == [0.0] * 36
    assert {r.song_id: r.vec for r in frames.pitch_histogram(df).collect()}[2] == [0.0] * 36


def test_profile_chain(spark):
    t = F.array(F.array(*map(F.lit, [1.0] + [0.0] * 11)), F.array(*map(F.lit, [0.0] * 11 + [1.0])))
    rows = [(1, [1.0] * 3 + [0.0] * 33, [0.0] * 12), (2, None, [0.0] * 11 + [2.0]), (3, [1.0], None), (4, None, None)]
    df = spark.createDataFrame(rows, "i long, f array<double>, c array<double>")
    got = {r.i: r.p for r in df.select("i", vectors.profile_chain(F.col("f"), F.col("c"), t, 2).alias("p")).collect()}
    high = 1 / (1 + np.exp(-2.0))
    assert got[1] == pytest.approx([high, 1 - high]) and got[2] == pytest.approx([1 - high, high]) and got[3] == got[4] == [0.0, 0.0]


def test_rebuild(spark):
    layout = {"clap": 2, "nlp": 2, "vocal": 1, "melodic": 1, "rhythmic": 1}
    stored = [0.6, 0.8, 0.1, 0.1, 0.3, 0.3, 0.3]
    one = [1.0]
    rows = [(1, stored, [1.0, 0.0]), (2, [0.5], [1.0, 0.0]), (3, stored, None), (4, None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, stored array<double>, nlp array<double>").select("*", F.lit("ghazal").alias("category"), F.lit(None).cast("boolean").alias("stem_failed"), *[F.array(F.lit(1.0)).alias(k) for k in ("vocal", "melodic", "rhythmic")])
    got = {r.id: r for r in fusion.rebuild(df.unionByName(df.where("id = 1").withColumn("vocal", F.lit(None).cast("array<double>")).withColumn("id", F.lit(5).cast("long"))), layout).collect()}
    assert sorted(got) == [1, 2, 3] and one == [1.0]
    assert [(got[i].clap_missing, got[i].lyrics_missing) for i in (1, 2, 3)] == [(False, False), (True, False), (False, True)]
    for i in (1, 2, 3):
        assert np.linalg.norm(got[i].fused) == pytest.approx(1)
    assert got[1].fused[0] / got[1].fused[1] == pytest.approx(0.75) and got[2].fused[:2] == [0.0, 0.0] and got[3].fused[2:4] == [0.0, 0.0]


def test_short_sequences_get_the_prior(spark):
    train = spark.createDataFrame([(i, 1 if i < 3 else 0, [i % 2, 1, 0]) for i in range(4)], "id long, label long, tokens array<int>")
    test = spark.createDataFrame([(10, [1]), (11, []), (12, None), (13, [1, 0])], "id long, tokens array<int>")
    got = {r.id: r for r in sequences.markov_classifier(train, test, 2).collect()}
    assert sorted(got) == [10, 11, 12, 13] and all(got[i].pred == 1 and got[i].loglik == pytest.approx(np.log(0.75), abs=1e-6) for i in (10, 11, 12))


def test_stream_resets(spark, tmp_path):
    """After a reset the query is the first one again; what means nothing counts for nothing; late events stay out."""
    schema = "session_id long, seq long, verdict string, vec array<double>, query array<double>"
    q = [1.0, 0.0]
    loads = [
        [(1, k, "approve", [0.0, 1.0], q) for k in range(3)] + [(2, 1, "approve", [0.0, 1.0], q), (3, 1, "reject", [0.0, 1.0], q)],
        [(1, 5, "reset", None, q), (2, 9, "reset", None, q), (2, 10, "approve", [0.0, 2.0], q), (3, 2, "what", [9.0, 9.0], q), (3, 3, "approve", None, q)],
        [(2, 4, "approve", [7.0, 7.0], q)],
    ]
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    seen = []
    for load in loads:
        spark.createDataFrame(load, schema).coalesce(1).write.mode("append").parquet(src)
        jobs.feedback_stream(spark, src, spark.createDataFrame([], schema).schema, out, check)
        seen.append({r.session_id: r.vec for r in jobs.latest(spark.read.parquet(out)).collect()})
    unit = lambda *v: pytest.approx((np.array(v) / np.linalg.norm(v)).tolist())
    assert seen[0] == {1: unit(1, 0.75), 2: unit(1, 0.75), 3: unit(1, -0.25)}
    assert seen[1] == {1: unit(1, 0), 2: unit(1, 1.5), 3: unit(1, -0.25)}
    assert seen[2] == seen[1]


def test_best_of_takes_ties_by_id():
    rng = np.random.default_rng(3)
    s, ids = rng.integers(0, 4, (6, 30)).astype(float), rng.permutation(30)
    s[2, :28], s[3] = -np.inf, -np.inf
    takes = np.array([3, 30, 5, 5, 0, 7])
    row, col = search.best_of(s, takes, ids)
    for r in range(6):
        want = [j for j in sorted(range(30), key=lambda j: (-s[r, j], ids[j])) if np.isfinite(s[r, j])][: takes[r]]
        assert col[row == r].tolist() == want


def test_topk_edges(spark, monkeypatch):
    """Nulls, repeats, empty sides, exclusions of one heavy query, and queries too large to broadcast."""
    x = np.random.default_rng(4).normal(size=(80, 4))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(900, None)], "song_id long, vec array<double>")
    q = v.withColumnRenamed("song_id", "query_id")
    gone = spark.createDataFrame([(0, i) for i in range(1, 78)] + [(1, 5)], "query_id long, song_id long")
    for most in (search.BROADCAST_BYTES, 0):
        monkeypatch.setattr(search._met, "__defaults__", (most,))
        got = {(r.query_id, r.rank): r.song_id for r in search.topk(q, v, 3, excluded=gone).collect()}
        assert len(got) == 79 * 3 + 2 and {got[0, 1], got[0, 2]} == {78, 79} and (900, 1) not in got
        s = x @ x.T
        np.fill_diagonal(s, -np.inf)
        s[1, 5] = -np.inf
        assert all([got[i, r + 1] for r in range(3)] == np.argsort(-s[i])[:3].tolist() for i in range(1, 80))
    assert search.topk(q.limit(0), v, 3).count() == search.topk(q, v.limit(0), 3).count() == 0
    assert ann.ivf_topk(q, v.limit(0), 3).count() == ann.pq_topk(q, v.limit(0), 3).count() == 0


def test_codes_grow_their_pool(spark):
    """Scattered vectors, whose rough scores say little: the pool grows until the recall is there."""
    x = np.random.default_rng(5).normal(size=(1500, 16))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "song_id long, vec array<double>")
    q = v.where("song_id % 30 = 0").withColumnRenamed("song_id", "query_id")
    exact = search.topk(q, v, 10)
    assert ann.recall(ann.pq_topk(q, v, 10, parts=2, bits=4), exact) >= 0.85
    assert ann.recall(ann.ivf_topk(q, v, 10), exact) >= 0.99


@pytest.mark.parametrize("blocks", [True, False])
def test_likely_pairs_lose_none(blocks):
    """All pairs that are alike enough are among the likely ones, few others; over random, long, empty and odd texts."""
    rng = np.random.default_rng(8)
    texts = ["".join("abcdefgh é🎉"[k] for k in rng.integers(0, 11, n)) for n in rng.integers(0, 30, 60)] + ["", "ab" * 40, "ab" * 41 + "c", "x" * 64, "x" * 63]
    texts += [t[:k] + "z" + t[k + 1 :] for t in texts[:40] for k in (1, 5)]

    def edits(a, b):
        d = np.arange(len(b) + 1)
        for i, x in enumerate(a):
            e = [i + 1]
            for j, y in enumerate(b):
                e.append(min(d[j + 1] + 1, e[-1] + 1, d[j] + (x != y)))
            d = e
        return 1 - d[-1] / max(len(a), len(b), 1)

    ratio = (lambda a, b: SequenceMatcher(None, a, b).ratio()) if blocks else edits
    score = np.array([[ratio(a, b) for b in texts] for a in texts[::3]])
    for least in (0.6, 0.8, 1.0):
        i, j = linkage.likely_pairs(texts[::3], texts, least, blocks)
        got, want = set(zip(i.tolist(), j.tolist())), set(map(tuple, np.argwhere(score >= least - 1e-12).tolist()))
        assert want <= got and len(got) < len(want) + 0.35 * score.size * (1.2 - least)


def test_longest_common():
    rng = np.random.default_rng(9)
    texts = ["".join("abcd"[k] for k in rng.integers(0, 4, n)) for n in [*rng.integers(0, 70, 30), 63, 64, 65]]

    def lcs(a, b):
        d = [0] * (len(b) + 1)
        for x in a:
            e = [0]
            for j, y in enumerate(b):
                e.append(d[j] + 1 if x == y else max(d[j + 1], e[-1]))
            d = e
        return d[-1] if len(a) <= 64 else min(len(a), len(b))

    i, j = np.divmod(np.arange(len(texts) ** 2), len(texts))
    assert linkage.longest_common(texts, texts, i, j).tolist() == [lcs(texts[p], texts[q]) for p, q in zip(i, j)]


@pytest.mark.parametrize("blocks", [True, False])
def test_one_artist_with_many_titles(spark, blocks, monkeypatch):
    """Blocks of a hot artist meet pairwise; what is found is what all pairs give, and exact pairs are found first."""
    monkeypatch.setattr(linkage, "TITLES", 16)
    rng = np.random.default_rng(10)
    word = lambda: "".join("abcdefghijklm"[k] for k in rng.integers(0, 13, rng.integers(3, 8)))
    titles = [f"{word()} {word()}" for _ in range(120)]
    cat = [(t, "hot artist", k) for k, t in enumerate(titles)] + [("same", "hot artist", 900), ("same", "hot artist", 800)]
    ext = [(t[:3] + "q" + t[4:], "hot artist") for t in titles[:40]] + [(f"{word()} {word()}", "hot artists") for _ in range(40)] + [("same", "hot artist"), (titles[50], "hot artist"), (None, "x"), ("x", None)]
    x = spark.createDataFrame(ext, "title string, artist string")
    c = spark.createDataFrame(cat, "title string, artist string, song_id long")
    got = {(r.title, r.artist): (r.song_id, r.score) for r in linkage.fuzzy_match(x, c, blocks).collect()}
    ratio = linkage.sequence_ratio() if blocks else linkage.edit_similarity
    p = x.select(F.col("title").alias("xt"), F.col("artist").alias("xa")).where("xt is not null and xa is not null").crossJoin(c)
    s = p.select("xt", "xa", "song_id", ratio(F.col("xa"), F.col("artist")).alias("by"), ratio(F.col("xt"), F.col("title")).alias("t")).where("by >= 0.55")
    want = {}
    for r in s.collect():
        score = round(0.7 * r.t + 0.3 * r.by, 9)
        if score >= 0.72:
            want[r.xt, r.xa] = max(want.get((r.xt, r.xa), (0, 0)), (score, -r.song_id))
    assert got == {k: (-i, score) for k, (score, i) in want.items()} and got["same", "hot artist"] == (800, 1.0)


@pytest.mark.parametrize("blocks", [True, False])
def test_letters_keep_what_is_alike(spark, blocks):
    """Artists that are alike enough share one of their first letters, by brute force over random texts."""
    rng = np.random.default_rng(6)
    texts = sorted({"".join("abcde é1"[k] for k in rng.integers(0, 8, rng.integers(0, 9))) for _ in range(120)})
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    n = F.length("t")
    first = {r.t: set(r.k) for r in df.select("t", linkage._first_letters(linkage.letters(F.col("t")), n, linkage.FLOOR, blocks).alias("k")).collect()}
    pairs = df.select(F.col("t").alias("a")).crossJoin(df.select(F.col("t").alias("b")))
    ratio = linkage.sequence_ratio() if blocks else linkage.edit_similarity
    alike = pairs.select("a", "b", ratio(F.col("a"), F.col("b")).alias("s")).where(F.col("s") >= linkage.FLOOR).collect()
    assert len(alike) > len(texts) and all(first[r.a] & first[r.b] for r in alike)


def test_catalogue_summaries(spark):
    m = spark.createDataFrame([("a", 2, 5), ("a", 1, 9), ("a", 2, 1), ("b", 9, 1), ("a", None, 0)], "k string, id long, pos long")
    names = spark.createDataFrame([(1, "one"), (2, "two")], "id long, name string")
    assert [tuple(r) for r in catalogue.resolve_labels(m, names, "k").collect()] == [("a", "two, one", "two")]
    c = spark.createDataFrame([("a", 1, 5, True), ("a", 2, 7, True), ("a", 3, 7, True), ("a", 4, 9, False), ("b", 1, 1, False)], "k string, pos long, score int, accept boolean")
    assert {r.k: r.best for r in catalogue.best_record(c, "k", "pos").collect()} == {"a": 2, "b": None}
    d = spark.createDataFrame([("a", "x", 3), ("a", "x", 1), ("a", "", 0), ("a", None, 0)], "k string, v string, pos long")
    assert [tuple(r) for r in catalogue.dedupe_keep_order(d, "k", "v", "pos").collect()] == [("a", "x", 1)]
    p = spark.createDataFrame([(None,), ("/a/b/c.mp3",), ("x",), ("r/a/a/d.mp3",)], "path string")
    assert sorted((r.path or "", r.grp, r.label, r.label_id) for r in files.labelled_paths(p, "path").collect()) == [("", None, None, None), ("/a/b/c.mp3", "a", "b", 1), ("r/a/a/d.mp3", "a", "a", 0), ("x", None, None, None)]


def test_totals_of_blocks(spark, monkeypatch):
    """Sums over all rows of another id, of several blocks and with nulls, repeats and a lone row, as by a plain join."""
    monkeypatch.setattr(search, "BLOCK", 16)
    monkeypatch.setattr(search, "QUERY_BLOCK", 8)
    x = np.random.default_rng(5).normal(size=(70, 4))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(3, x[9].tolist()), (900, None)], "song_id long, vec array<double>")
    q = v.where("song_id % 10 in (0, 3)").withColumnRenamed("song_id", "query_id")
    got = sorted(search.totals(q, v).collect())
    plain = q.join(v.withColumnRenamed("vec", "w"), F.col("query_id") != F.col("song_id")).withColumn("s", F.round(vectors.dot(F.col("vec"), F.col("w")), 10))
    want = sorted(plain.groupBy("query_id").agg(F.count("*").alias("n"), F.sum("s").alias("total"), F.max("s").alias("best")).collect())
    assert [r[:2] for r in got] == [r[:2] for r in want] and len(got) == 15
    for r, w in zip(got, want):
        assert (r.total, r.best) == ((None, None) if w.total is None else (pytest.approx(w.total), pytest.approx(w.best)))
    assert search.totals(q.where("query_id = 10"), v.where("song_id = 10")).count() == 0


def test_judged_pairs_are_dealt_by_query(spark, tmp_path, monkeypatch):
    """More pairs are more tasks, though they meet by two remainders only; a query's judgments stay together."""
    from melodex.plans import similarity

    spark.range(400).selectExpr("id AS vec_id", "id % 10 AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(similarity, "JUDGED_A_TASK", 50)
    j = evaluation.last_judgments(similarity._judgments(spark, str(tmp_path)))
    of = j.withColumn("task", F.spark_partition_id()).groupBy("query_id").agg(F.countDistinct("task").alias("tasks"), F.min("task").alias("task"), F.count("*").alias("n")).collect()
    assert len({r.task for r in of}) > 4 and {(r.tasks, r.n) for r in of} == {(1, 19)}


def test_first_of_is_best_of(monkeypatch):
    """What single precision leaves out is never among the best: near ties, equal rows, floors, excluded selves."""
    rng = np.random.default_rng(6)
    told = 0
    for trial in range(60):
        q = rng.normal(size=(12, 6))
        x = q[0] + 1e-8 * rng.normal(size=(150, 6)) if trial % 3 == 0 else rng.normal(size=(150, 6))[rng.integers(0, 150 - 100 * (trial % 2), 150)]
        q_ids, ids, takes = rng.integers(0, 40, 12), rng.permutation(150), rng.integers(1, 9, 12)
        s = np.round(q @ x.T, search.PLACES)
        if trial % 2:
            s[q_ids[:, None] == ids] = -np.inf
        row, col = search.best_of(s, takes, ids)
        floor = np.where(rng.random(12) < 0.5, -np.inf, np.array([s[row[row == r], col[row == r]].min() for r in range(12)]))
        monkeypatch.setattr(search, "CANDIDATES", 1800 if trial % 4 else 0)
        if got := search.first_of(q, x, q_ids, ids, takes, floor, bool(trial % 2)):
            told += 1
            assert got[0].tolist() == row.tolist() and got[1].tolist() == col.tolist() and np.allclose(got[2], s[row, col], rtol=0, atol=2e-10)
    assert told > 40
    x[3] = np.inf
    assert search.first_of(q, x, q_ids, ids, takes, np.full(12, -np.inf), False) is None


def test_rocchio_of_events_that_are_counted(spark):
    """An event counted thrice is one that comes thrice; nulls and other verdicts add nothing; cells aren't shuffled."""
    x = np.random.default_rng(8).normal(size=(6, 3)).tolist()
    s = spark.createDataFrame([(1, x[0]), (2, x[1]), (3, None)], "session_id long, vec array<double>")
    rows = [(1, "approve", x[2], 3), (1, "reject", x[3], 1), (1, "skip", x[4], 9), (1, "approve", [None, 1.0, 2.0], 2), (1, "reject", None, 1), (9, "approve", x[5], 1)]
    counted = spark.createDataFrame(rows, "session_id long, verdict string, vec array<double>, times int")
    each = counted.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("i", "times")
    got, want = (sorted((r.session_id, [round(v, 12) for v in r.vec]) for r in feedback.rocchio(s, j).collect()) for j in (counted, each))
    up = np.array([3 * x[2][0] / 3, (3 * x[2][1] + 2) / 5, (3 * x[2][2] + 4) / 5])
    z = np.array(x[0]) + 0.75 * up - 0.25 * np.array(x[3])
    assert got == want and [i for i, _ in got] == [1, 2] and got[0][1] == pytest.approx(z / np.linalg.norm(z))


def test_judgments_stay_where_they_are(spark, monkeypatch):
    """Only judgments of results are handed on, from the tasks that they were dealt to; grades are those of a plain join."""
    j = spark.range(4000).selectExpr("id % 40 AS query_id", "id div 80 AS song_id", "cast(id % 3 AS int) AS grade", "id AS pos").repartition(7, "query_id")
    rows = [(k % 45, k, int(s)) for k, s in enumerate(np.random.default_rng(9).integers(0, 70, 300))] + [(3, 999, None), (None, 1, 5)]
    r = spark.createDataFrame(rows, "query_id long, rank long, song_id long")
    key = lambda d: sorted(d.select("query_id", "rank", "song_id", "grade").collect(), key=str)
    want = key(r.join(evaluation.last_judgments(j), ["query_id", "song_id"], "left").na.fill(0, ["grade"]))
    for most in (search.BROADCAST_BYTES, 0):
        monkeypatch.setattr(evaluation, "BROADCAST_BYTES", most)
        assert key(evaluation.graded(r, j)) == want and len({x.grade for x in want}) == 3
    monkeypatch.undo()
    of = lambda d: {(x.query_id, x.task) for x in d.select("query_id", F.spark_partition_id().alias("task")).collect()}
    some = evaluation.judged_results(r, j)
    assert of(some) <= of(j) and {(x.query_id, x.song_id) for x in some.collect()} <= {x[::2] for x in rows}


def test_queries_that_ask_for_much_are_dealt_over_tasks(spark, monkeypatch):
    """The results asked for in one task are bounded, also where queries are small enough to be broadcast."""
    monkeypatch.setattr(search, "QUERY_BLOCK", 8)
    x = np.random.default_rng(12).normal(size=(90, 4))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "song_id long, vec array<double>").coalesce(1)
    q = v.withColumnRenamed("song_id", "query_id")
    key = lambda: sorted((r.query_id, r["rank"], r.song_id, r.score) for r in search.topk(q, v, 5).collect())
    packs = lambda df, name: search._pack(df.select(F.col(name).alias("id"), "vec", F.lit(5).cast("long").alias("take")), 8, np.ndarray.tobytes)
    tasks = lambda: search._met(packs(q, "query_id"), packs(v, "song_id")).select(F.spark_partition_id()).distinct().count()
    want, one_task = key(), tasks()
    monkeypatch.setattr(search, "ASKED_A_TASK", 80)
    assert key() == want and len(want) == 450 and one_task == 1 and tasks() >= 4


def test_best_of_many_ties():
    """Rows of few different scores, of which many tie with the last that is taken: smaller ids first, whatever their order."""
    rng = np.random.default_rng(15)
    for n, most in ((60, 3), (60, 20), (5, 9), (40, 0)):
        s = rng.integers(0, 3, size=(25, n)).astype(float)
        s[rng.random(s.shape) < 0.2] = -np.inf
        ids, takes = rng.permutation(500)[:n], rng.integers(0, most + 1, 25)
        row, col = search.best_of(s, takes, ids)
        best = [sorted((-x, i) for x, i in zip(r, ids) if np.isfinite(x))[:t] for r, t in zip(s, takes)]
        assert [(r, -s[r, c], ids[c]) for r, c in zip(row, col)] == [(r, x, i) for r, b in enumerate(best) for x, i in b]
