"""The stored index: audited recall on scattered vectors, partitions read, codes of residuals, appends and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from melodex.operators import ann, cell_index, search
from melodex.operators.cell_index import CellIndex
from melodex.sources.scratch import stored


def frame(spark, x, kind="double"):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], f"song_id long, vec array<{kind}>")


def seeds(v, every):
    return v.where(f"song_id % {every} = 0").withColumnRenamed("song_id", "query_id")


def test_recall_of_scattered_vectors(spark, tmp_path):
    """20,000 vectors without clusters: the audit probes more cells than usual, but not all, and codes keep nearly all of it."""
    v = stored(frame(spark, np.random.default_rng(1).normal(size=(20_000, 32))))
    q = seeds(v, 200)
    exact = stored(search.topk(q, v, 10))
    index = CellIndex.build(v, str(tmp_path / "i"))
    assert len(index.model.centres) == 141 and cell_index.PROBES <= index.model.probes < 141
    index = CellIndex.open(spark, str(tmp_path / "i"))
    assert ann.recall(index.search(q, 10), exact) >= 0.9
    assert ann.recall(index.search_codes(q, 10), exact) >= 0.9
    assert ann.recall(index.search(q, 10, probes=8), exact) < 0.8
    assert ann.recall(ann.indexed_topk(q, v, 10, index=index), exact) >= 0.9
    every = {(r.query_id, r["rank"]): r.song_id for r in index.search(q, 10, probes=141).collect()}
    assert every == {(r.query_id, r["rank"]): r.song_id for r in exact.collect()}


def test_only_probed_cells_are_read(spark, tmp_path):
    """A query of few seeds reads the files of its cells: the plan prunes partitions, and no other file is opened."""
    x = np.random.default_rng(2).normal(size=(900, 8))
    v = frame(spark, x)
    index = CellIndex.build(v, str(tmp_path / "i"), cells=30, codes=True)
    q = seeds(v, 500)
    near = set(cell_index.nearest(x[[0, 500]], index.model.centres, 3).ravel().tolist())
    for found in (index.search(q, 5, probes=3), index.search_codes(q, 5, probes=3)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [cell" in plan and len(found.collect()) == 10
    files = index.blocks(sorted(near)).select(F.col("_metadata.file_path")).distinct().collect()
    assert {int(r[0].split("/cell=")[1].split("/")[0]) for r in files} == near and len(near) < 30
    got = {(r.query_id, r["rank"]): r.song_id for r in index.search(q, 5, probes=3).collect()}
    cell = cell_index.nearest(x, index.model.centres)[:, 0]
    for i in (0, 500):
        probed = cell_index.nearest(x[i][None], index.model.centres, 3)[0]
        s = np.where(np.isin(cell, probed), x @ x[i], -np.inf)
        s[i] = -np.inf
        assert [got[i, r + 1] for r in range(5)] == np.argsort(-s)[:5].tolist()


def test_codes_are_of_residuals(spark, tmp_path):
    """Far clusters: codes of whole vectors would spend all their words on the clusters; those of residuals tell near vectors apart."""
    rng = np.random.default_rng(3)
    x = np.repeat(50 * rng.normal(size=(20, 16)), 60, axis=0) + rng.normal(size=(1200, 16))
    index = CellIndex.build(frame(spark, x), str(tmp_path / "i"), cells=20, parts=16, bits=4)
    m = index.model
    cells = cell_index.nearest(x, m.centres)[:, 0]
    left, codes = x - m.centres[cells], m.codes(x, cells)
    rebuilt = np.concatenate([w[codes[:, [p]]][:, 0] for p, w in enumerate(m.words)], axis=1)
    assert ((left - rebuilt) ** 2).sum() < 0.1 * (left**2).sum()
    q = rng.normal(size=(3, 16))
    one = np.flatnonzero(cells == cells[0])
    assert m.rough(q, int(cells[0]), codes[one]) == pytest.approx(q @ (m.centres[cells[0]] + rebuilt[one]).T)


def test_more_candidates_when_rough_scores_say_little(spark, tmp_path):
    """One bit a part: the margin grows until nearly all of what the cells hold is found; a fixed pool keeps its size."""
    v = frame(spark, np.random.default_rng(4).normal(size=(3000, 16)))
    q = seeds(v, 60)
    index = CellIndex.build(v, str(tmp_path / "i"), cells=20, parts=2, bits=1)
    exact = stored(index.search(q, 10))
    assert ann.recall(index.search_codes(q, 10), exact) >= 0.9
    assert ann.recall(index.search_codes(q, 10, pool=1), exact) < 0.5 and ann.recall(index.search_codes(q, 10, pool=300), exact) == 1


def test_edges(spark, tmp_path):
    """Nulls, repeats, single precision, one vector, K beyond what is there, no vector, no codes, shuffled joins."""
    x = np.random.default_rng(5).normal(size=(40, 6)).astype(np.float32)
    v = frame(spark, x, "float")
    v = v.unionByName(v.where("song_id = 3")).unionByName(spark.createDataFrame([(99, None)], v.schema))
    index = CellIndex.build(v, str(tmp_path / "a"), cells=5)
    assert index.model.kind == "<f4" and sorted(r.song_id for r in index.vectors().collect()) == sorted([*range(40), 3])
    q = v.withColumnRenamed("song_id", "query_id").where("query_id < 3 or query_id = 99")
    for found in (index.search, index.search_codes):
        got = [(r.query_id, r["rank"], r.song_id, round(r.score, 9)) for r in found(q, 100).collect()]
        assert sorted(got) == sorted((r.query_id, r["rank"], r.song_id, round(r.score, 9)) for r in search.topk(q, v, 100).collect()) and len(got) == 3 * 40
        assert found(q.limit(0), 3).collect() == []
    one = CellIndex.build(v.where("song_id = 7"), str(tmp_path / "b"))
    assert [(r.query_id, r.song_id) for r in one.search_codes(q, 3).collect()] == [(0, 7), (1, 7), (2, 7)]
    with pytest.raises(ValueError):
        CellIndex.build(v.where("vec is null"), str(tmp_path / "c"))
    plain = CellIndex.build(v, str(tmp_path / "d"), codes=False)
    with pytest.raises(ValueError):
        plain.search_codes(q, 3)
    before = cell_index.BROADCAST_BYTES
    try:
        cell_index.BROADCAST_BYTES = 0
        far = [(r.query_id, r["rank"], r.song_id) for r in index.search_codes(q, 7).collect()]
    finally:
        cell_index.BROADCAST_BYTES = before
    assert sorted(far) == sorted((r.query_id, r["rank"], r.song_id) for r in search.topk(q, v, 7).collect())


def test_whole_search_misses_nothing(spark, tmp_path):
    """Two of sixty cells hold few of the neighbours of scattered vectors; their scores say which others may hold the rest."""
    x = np.random.default_rng(11).normal(size=(1500, 12))
    x[700] = x[3]
    v = frame(spark, x)
    q = v.where("song_id % 30 = 3").withColumnRenamed("song_id", "query_id")
    index = CellIndex.build(v, str(tmp_path / "i"), cells=60, probes=2, codes=False)
    key = lambda df: sorted((r.query_id, r["rank"], r.song_id, r.score) for r in df.collect())
    exact = key(search.topk(q, v, 7))
    assert key(index.search(q, 7)) != exact and key(index.search(q, 7, whole=True)) == exact
    assert key(ann.ivf_topk(q, v, 7, cells=60, probes=2, whole=True)) == exact
    assert index.search(q.limit(0), 7, whole=True).count() == 0


def test_packs_and_candidates_in_strips(spark, tmp_path, monkeypatch):
    """A few pairs of query and cell, and few candidates, at a time find what many do."""
    x = np.random.default_rng(12).normal(size=(400, 8))
    v, key = frame(spark, x), lambda df: sorted((r.query_id, r["rank"], r.song_id, r.score) for r in df.collect())
    index = CellIndex.build(v, str(tmp_path / "i"), cells=10)
    many = [key(f(seeds(v, 7), 5)) for f in (index.search, index.search_codes)]
    monkeypatch.setattr(cell_index, "PROBED", 30)
    monkeypatch.setattr(cell_index, "SCORED", 3)
    assert [key(f(seeds(v, 7), 5)) for f in (index.search, index.search_codes)] == many


def test_whole_search_by_codes_misses_nothing(spark, tmp_path, monkeypatch):
    """Codes of one bit say little of scattered vectors, and more of clusters; repeats, nulls, lengths beyond single precision,
    and both ways in which blocks meet."""
    rng = np.random.default_rng(13)
    x = np.vstack([rng.normal(size=(900, 12)), (3 * rng.normal(size=(30, 12))).repeat(20, axis=0) + 0.05 * rng.normal(size=(600, 12))])
    key = lambda df: sorted((r.query_id, r["rank"], r.song_id) for r in df.collect())
    large = frame(spark, 1e25 * x)
    few = seeds(large, 30)
    index = CellIndex.build(large, str(tmp_path / "large"), cells=16, probes=2, parts=2, bits=1)
    assert key(index.search_codes(few, 7, whole=True)) == key(search.topk(few, large, 7))
    x[700] = x[3]
    for kind in ("double", "float"):
        v = frame(spark, x, kind)
        v = stored(v.unionByName(v.where("song_id = 33")).unionByName(spark.createDataFrame([(9999, None)], v.schema)))
        q = v.where("song_id % 30 = 3 or song_id = 9999").withColumnRenamed("song_id", "query_id")
        index = CellIndex.build(v, str(tmp_path / kind), cells=16, probes=2, parts=2, bits=1)
        exact = key(search.topk(q, v, 7))
        assert key(index.search_codes(q, 7)) != exact and key(index.search_codes(q, 7, whole=True)) == exact
    assert key(ann.pq_topk(q, v, 7, cells=16, probes=2, parts=2, bits=1, whole=True)) == exact
    assert key(index.search_codes(q, 7, skip_self=False, whole=True)) == key(search.topk(q, v, 7, skip_self=False))
    assert key(index.search_codes(q.limit(2), 2000, whole=True)) == key(search.topk(q.limit(2), v, 2000))
    assert ann.pq_topk(q.limit(0), v, 7, whole=True).count() == ann.pq_topk(q, v.limit(0), 7, whole=True).count() == 0
    monkeypatch.setattr(search._met, "__defaults__", (0,))
    assert key(index.search_codes(q, 7, whole=True)) == exact


def test_codes_rule_out_what_cannot_be_among_the_best():
    """Of far clusters, few rows are scored, and the best are among them; where codes are far off, or scores too large for
    single precision, they say nothing."""
    rng = np.random.default_rng(14)
    x = np.repeat(rng.normal(size=(40, 16)), 25, axis=0) + 0.02 * rng.normal(size=(1000, 16))
    y, ids = x + 0.001 * rng.normal(size=x.shape), np.arange(1000)
    q, q_ids, takes = x[::5], ids[::5], np.full(200, 10)
    s = np.round(q @ x.T, search.PLACES)
    s[q_ids[:, None] == ids] = -np.inf
    floor = np.sort(s[:, :500], axis=1)[:, -10]
    said = np.column_stack([y, np.linalg.norm(x - y, axis=1)])
    row, col, score = cell_index._allowed(q, x, said, q_ids, ids, takes, floor, True)
    r, j = search.best_of(s, takes, ids)
    assert row.tolist() == r.tolist() and col.tolist() == j.tolist() and score.tolist() == s[r, j].tolist()
    far = np.column_stack([np.zeros_like(x), np.linalg.norm(x, axis=1)])
    assert cell_index._allowed(q, x, far, q_ids, ids, takes, floor - 1e3, True) is None
    assert cell_index._allowed(q * 1e30, x * 1e30, said * 1e30, q_ids, ids, takes, floor * 1e60, True) is None
