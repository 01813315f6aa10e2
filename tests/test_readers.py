"""Readers of documents and folders, seeds that aren't there, masks, totals and kept models."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from melodex.functions.text import mood_tag
from melodex.operators import ann, catalogue, feedback, sequences, similar
from melodex.sources import files


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_indented_judgments(spark, tmp_path):
    """Six anchors and 43 judgments with text ids in one indented document, beside one that is no JSON and one without anchors."""
    sizes = [9, 8, 7, 7, 6, 6]
    doc = {"_readme": "by hand", "anchors": [{"anchor_id": f"song_{a}", "note": "x", "judgments": [{"song_id": f"s{a}_{k}", "grade": k % 3} for k in range(n)]} for a, n in enumerate(sizes)]}
    put(f"{tmp_path}/j/a.json", json.dumps(doc, indent=2))
    put(f"{tmp_path}/j/b.json", '{"_readme": "broken", "anchors": [')
    put(f"{tmp_path}/j/c.json", '{\n "_readme": "none"\n}')
    rows = files.read_judgments(spark, f"{tmp_path}/j").collect()
    assert len(rows) == 43 and {r.readme for r in rows} == {"by hand"} and {r.anchor_id for r in rows} == {f"song_{a}" for a in range(6)}
    assert [(r.song_id, r.grade) for r in sorted(rows, key=lambda r: r.pos) if r.anchor_id == "song_1"] == [(f"s1_{k}", k % 3) for k in range(8)]
    put(f"{tmp_path}/l/a.json", "\n".join(json.dumps({"anchors": [a]}) for a in doc["anchors"]) + "\nnot json\n")
    assert files.read_judgments(spark, f"{tmp_path}/l", lines=True).count() == 43


def test_features_of_songs(spark, tmp_path):
    """A file a song, indented; a song without one, and one whose file is broken, have records of nulls; others' files are left out."""
    put(f"{tmp_path}/f/a_b.json", json.dumps({"tempo": 90.5, "profile": [1, 2.5], "mood": None}, indent=4))
    put(f"{tmp_path}/f/ü x.json", "{}")
    put(f"{tmp_path}/f/bad.json", "{ 'tempo'")
    put(f"{tmp_path}/f/nobody.json", '{"tempo": 1}')
    songs = spark.createDataFrame([("a_b", 1), ("ü x", 2), ("bad", 3), ("none", 4), (None, 5)], "song_id string, found int").drop("found")
    got = {r.song_id: r for r in files.features_of(songs, f"{tmp_path}/f", "tempo double, profile array<double>").collect()}
    assert len(got) == 5 and {k: r.found for k, r in got.items()} == {"a_b": True, "ü x": True, "bad": False, "none": False, None: False}
    assert got["a_b"].features == (90.5, [1.0, 2.5]) and all(got[k].features == (None, None) for k in ("ü x", "bad", "none", None))


def test_labelled_files(spark, tmp_path):
    for path in ("g1/zeta/a.mp3", "g1/alpha/b.mp3", "g2/alpha/c.mp3", "g2/mid dle/d.mp3", "g2/alpha/notes.txt"):
        put(f"{tmp_path}/root/{path}", "x")
    got = files.labelled_files(spark, f"{tmp_path}/root", "*.mp3").collect()
    assert sorted((r.grp, r.label, r.label_id, r.length) for r in got) == [("g1", "alpha", 0, 1), ("g1", "zeta", 2, 1), ("g2", "alpha", 0, 1), ("g2", "mid dle", 1, 1)] or {r.label for r in got} == {"alpha", "zeta", "mid%20dle"}


def test_labels_are_numbered_over_tasks(spark):
    """Many labels, sorted over several tasks, get the places that one sort gives."""
    df = spark.range(3000).select(F.concat(F.lit("r/g/"), F.md5((F.col("id") % 700).cast("string")), F.lit("/f")).alias("path"))
    got = {(r.label, r.label_id) for r in files.labelled_paths(df.repartition(7), "path").collect()}
    assert sorted(got) == [(name, k) for k, name in enumerate(sorted({name for name, _ in got}))] and len(got) == 700


SONGS = "song_id long, vec array<double>, title string, artist string"


@pytest.fixture(scope="module")
def songs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist(), f"Title {i % 40}", f"A{i % 5}") for i in range(50)]
    return spark.createDataFrame(rows + [(90, None, "Bare", "A1")], SONGS)


def test_seeds_that_are_not_there(spark, songs):
    for find, given in ((similar.similar_by_id, (999,)), (similar.similar_by_name, ("No such", "title", 5, False))):
        with pytest.raises(Exception, match="no song"):
            find(songs, *given).collect()
    for find, given in ((similar.similar_by_id, (90,)), (similar.similar_by_name, ("bare", "a1"))):
        with pytest.raises(Exception, match="has no vector"):
            find(songs, *given).collect()
    for members in ([], [999], [90]):
        with pytest.raises(Exception, match="no song of the playlist"):
            similar.similar_to_playlist(songs, spark.createDataFrame([(m,) for m in members], "song_id long")).collect()
    groups = spark.createDataFrame([("a",), ("b",)], "g string")
    members = spark.createDataFrame([("a", [3.0, 4.0]), ("b", None)], "g string, vec array<double>")
    assert feedback.required_centroids(groups.where("g = 'a'"), members, "g").first().vec == [0.6, 0.8]
    with pytest.raises(Exception, match="no vector in group b"):
        feedback.required_centroids(groups, members, "g").collect()


def test_seeds_rerank_by_default(spark, songs):
    """Against the rule by hand: five times K by score, then the artist's 0.15, the seed removed after the pool is taken."""
    rows = {r.song_id: r for r in songs.where("vec is not null").collect()}
    x = {i: np.array(r.vec) for i, r in rows.items()}
    pool = sorted(x, key=lambda i: (-round(float(x[i] @ x[7]), 10), i))[:15]
    adjusted = [(i, round(round(float(x[i] @ x[7]), 10) + 0.15 * (rows[i].artist == rows[7].artist), 4)) for i in pool if i != 7]
    want = sorted(adjusted, key=lambda p: -p[1])[:3]
    assert [(r.song_id, r.score) for r in similar.similar_by_id(songs, 7, 3).orderBy("rank").collect()] == want
    assert [(r.song_id, r.score) for r in similar.similar_by_name(songs, "TITLE 7", "a2", 3).orderBy("rank").collect()] == want
    plain = similar.similar_by_id(songs, 7, 3, rerank=False).orderBy("rank").collect()
    assert [r.song_id for r in plain] == [i for i in sorted(x, key=lambda i: (-round(float(x[i] @ x[7]), 10), i)) if i != 7][:3]
    only = similar.similar_by_id(songs, 7, 3, where=F.col("artist") == "A1").collect()
    assert len(only) == 3 and all(r.song_id % 5 == 1 for r in only)
    assert similar.similar_by_id(songs.select("song_id", "vec"), 7, 3).count() == 3
    got = similar.similar_to_playlist(songs, spark.createDataFrame([(1,), (2,), (2,), (90,), (999,)], "song_id long"), 4).orderBy("rank").collect()
    mean = (x[1] + x[2]) / 2
    assert [r.song_id for r in got] == sorted((i for i in x if i not in (1, 2)), key=lambda i: -float(x[i] @ mean))[:4]


def test_match_cards(spark):
    results = spark.createDataFrame([(1, 1, 5, 0.123456), (1, 2, 6, 0.1), (1, 3, 7, None)], "query_id long, rank long, song_id long, score double")
    f = spark.createDataFrame([(5, [0, 1, 0, 0], 0.126, None), (6, None, None, 0.5)], "song_id long, tempo_bucket array<int>, murki_index double, hnr_mean double")
    got = {r.song_id: (r.score, r.tempo_label, r.ornament, r.hnr) for r in similar.match_cards(results, f).collect()}
    assert got == {5: (0.1235, "Medium", 0.13, 0.0), 6: (0.1, "Unknown", 0.0, 0.5), 7: (None, None, None, None)}


def test_mask_bands(spark):
    rows = [(i, [[float(10 * r + c + 1) for c in range(12)] for r in range(6)]) for i in range(60)] + [(100, None), (101, []), (102, [[5.0]])]
    df = spark.createDataFrame(rows, "id long, s array<array<double>>")
    a, b = ({r.id: r.m for r in df.select("id", sequences.mask_bands(F.col("s"), F.col("id"), (2, 3), (1, 4)).alias("m")).collect()} for _ in range(2))
    assert a == b and a[100] is None and a[101] == [] and a[102] == [[5.0]]
    spec = np.array(rows[0][1])
    full_rows, full_columns = set(), set()
    for i in range(60):
        m = np.isclose(np.array(a[i]), spec.mean())
        if m.all():
            continue  # two bands that meet took all rows
        whole_rows, whole_columns = m.all(axis=1), m.all(axis=0)
        assert (m == (whole_rows[:, None] | whole_columns)).all() and np.allclose(np.array(a[i])[~m], spec[~m])
        assert whole_rows.sum() <= 6 and whole_columns.sum() <= 4
        full_rows.add(int(whole_rows.sum()))
        full_columns.add(int(whole_columns.sum()))
    assert {0, 1, 2, 3} <= full_rows and full_columns == {0, 1, 2, 3, 4}


def test_tag_run_counts_while_it_writes(spark, tmp_path):
    rows = [(1, "so sad and alone"), (2, "dance dance"), (3, None), (4, " \n "), (5, "nothing"), (6, "dance"), (None, "dance")]
    words = {"sad": ["sad"], "party": ["dance"]}
    df = spark.createDataFrame(rows, "id long, text string")
    done = spark.createDataFrame([(6,), (6,), (None,)], "id long")
    totals = catalogue.tag_run(df, f"{tmp_path}/t", "id", "text", mood_tag(F.col("text"), words), done)
    assert totals == {"recovered": 4, "skipped": 1, "none": 2, "tagged": 3}
    assert {(r.id, r.tag) for r in spark.read.parquet(f"{tmp_path}/t").collect()} == {(1, "sad"), (2, "party"), (5, None), (None, "party")}
    assert catalogue.tag_run(df.limit(0), f"{tmp_path}/e", "id", "text", F.lit("x")) == {"recovered": 0, "skipped": 0, "none": 0, "tagged": 0}


def test_kept_projection(spark, tmp_path):
    """A loaded model projects vectors that it has never seen as the fitted one does."""
    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rng.normal(size=(60, 5)))], "song_id long, vec array<double>")
    new = spark.createDataFrame([(100, [1.0, 2.0, 3.0, 4.0, 5.0])], "song_id long, vec array<double>")
    scaler, pca, _ = ann.pca_fit(v, 3)
    ann.save_projection(scaler, pca, f"{tmp_path}/m")
    got, want = (ann.pca_project(new, *m).first().vec for m in (ann.load_projection(f"{tmp_path}/m"), (scaler, pca)))
    assert got == want and len(got) == 3 and np.linalg.norm(got) == pytest.approx(1)


def test_files_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    """A file a row, written by many tasks from one partition, also where nearly all rows are of one folder."""
    monkeypatch.setattr(files, "FILES_A_TASK", 10)
    df = spark.range(120).coalesce(1).selectExpr("if(id < 100, 'hot', concat('f', id)) AS label", "cast(id AS string) AS value")
    files.write_files(df, f"{tmp_path}/w", "label")
    back = spark.read.option("recursiveFileLookup", True).text(f"{tmp_path}/w").select("value", F.col("_metadata.file_path").alias("path")).collect()
    assert sorted(int(r.value) for r in back) == list(range(120)) and len({r.path for r in back}) == 120
    tasks = [r.path.split("part-")[1][:5] for r in back if "label=hot/" in r.path]
    assert len(set(tasks)) >= 5 and max(map(tasks.count, tasks)) <= 40
    files.write_files(df.limit(0), f"{tmp_path}/none", "label")
    assert spark.read.schema("value string").text(f"{tmp_path}/none").count() == 0
