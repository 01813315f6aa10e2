"""Streams in any order of loads, late resets, idle sessions, and the cell index that grows."""

import itertools
import time

import numpy as np
import pyarrow as pa
import pytest

from melodex.operators import search
from melodex.operators.cell_index import CellIndex
from melodex.streaming import jobs

EVENTS = "session_id long, seq long, verdict string, vec array<double>, query array<double>"


def drained(spark, tmp_path, name, loads, **given):
    src, out, check = (str(tmp_path / f"{name}-{x}") for x in ("src", "out", "check"))
    for load in loads:
        spark.createDataFrame(load, EVENTS).coalesce(1).write.mode("append").parquet(src)
        jobs.feedback_stream(spark, src, spark.createDataFrame([], EVENTS).schema, out, check, **given)
    return {r.session_id: r.vec for r in jobs.latest(spark.read.parquet(out)).collect()}


def folded(events):
    """The query of a session by its events' numbers alone."""
    since = max((e[1] for e in events if e[2] == "reset"), default=-1)
    of = lambda verdict: [np.array(e[3]) for e in events if e[2] == verdict and e[1] > since and e[3] is not None]
    up, down = of("approve"), of("reject")
    q = np.array(max(events, key=lambda e: e[1])[4]) + (0.75 * np.mean(up, axis=0) if up else 0) - (0.25 * np.mean(down, axis=0) if down else 0)
    return (q / np.linalg.norm(q)).tolist()


def test_late_reset_keeps_newer_events(spark, tmp_path):
    q = [1.0, 0.0]
    loads = [[(1, 1, "approve", [0.0, 9.0], q)], [(1, 5, "approve", [0.0, 1.0], q), (1, 7, "reject", [1.0, 1.0], q)], [(1, 3, "reset", None, q)], [(1, 2, "approve", [5.0, 5.0], q)]]
    for k in range(2, 5):
        want = folded([e for load in loads[:k] for e in load])
        assert drained(spark, tmp_path, f"late{k}", loads[:k])[1] == pytest.approx(want)


def test_any_order_of_loads(spark, tmp_path):
    rng = np.random.default_rng(2)
    kinds = ["approve", "reject", "reset", "skip"]
    events = [(s, k, kinds[rng.choice(4, p=[0.5, 0.3, 0.1, 0.1])], None if rng.random() < 0.1 else rng.normal(size=3).tolist(), [1.0, float(k), 0.5]) for s in range(6) for k in range(12)]
    want = {s: pytest.approx(folded([e for e in events if e[0] == s])) for s in range(6)}
    cut = [events[k::3] for k in range(3)]
    for n, order in enumerate(itertools.permutations(range(3))):
        if n % 2 == 0:
            assert drained(spark, tmp_path, f"order{n}", [cut[k] for k in order]) == want


def test_idle_sessions_are_forgotten(spark, tmp_path):
    q = [1.0, 0.0]
    src, out, check = (str(tmp_path / f"idle-{x}") for x in ("src", "out", "check"))
    for load in ([(1, 1, "approve", [0.0, 1.0], q)], [(2, 1, "approve", [0.0, 1.0], q)], [(1, 2, "reject", [0.0, 1.0], q)]):
        spark.createDataFrame(load, EVENTS).coalesce(1).write.mode("append").parquet(src)
        jobs.feedback_stream(spark, src, spark.createDataFrame([], EVENTS).schema, out, check, idle=1)
        time.sleep(0.2)
    rows = [(r.seen, r.vec) for r in spark.read.parquet(out).where("session_id = 1").collect()]
    assert sorted(s for s, _ in rows) == [1, 1] and any(v == pytest.approx((np.array([1, -0.25]) / np.hypot(1, 0.25)).tolist()) for _, v in rows)


class Kept:
    """A session's state, and how often it was asked."""

    def __init__(self):
        self.calls, self.value, self.map = 0, None, {}

    def getValueState(self, *_):
        return self

    def getMapState(self, *_):
        return self

    def _told(self, out=None):
        self.calls += 1
        return out

    def get(self):
        return self._told(self.value)

    def exists(self):
        return self._told(self.value is not None)

    def update(self, value):
        self.value = self._told(value)

    def keys(self):
        return iter(self._told(list(self.map)))

    def iterator(self):
        return iter(self._told(list(self.map.items())))

    def containsKey(self, key):
        return self._told(key in self.map)

    def getValue(self, key):
        return self._told(self.map.get(key))

    def updateValue(self, key, value):
        self.map[key] = self._told(value)

    def removeKey(self, key):
        del self.map[self._told(key)]


def test_state_is_asked_a_few_times_a_batch():
    """one call or two an event made the stream's seconds grow past the limit."""
    rng = np.random.default_rng(5)
    kept = Kept()
    session = jobs._Session(None)
    session.init(kept)
    events, out = [], None
    verdicts = {"approve": jobs._APPROVE, "reject": jobs._REJECT, "reset": jobs._RESET}
    types = {"session_id": pa.int64(), "seq": pa.int64(), "verdict": pa.int32(), "vec": pa.list_(pa.float64()), "query": pa.list_(pa.float64())}
    for n, first in ((5000, 10000), (3000, 4000), (2000, 20000)):
        load = [(1, first + k, "approve" if rng.random() < 0.6 else "reject", rng.normal(size=4), [1.0, 0.5, 0.25, float(first)]) for k in rng.permutation(n)]
        load[7] = (1, first + 500, "reset", None, load[7][4])
        load = [e for k, e in enumerate(load) if k == 7 or e[1] != first + 500]
        kept.calls = 0
        batch = pa.RecordBatch.from_arrays([pa.array([verdicts[e[k]] if k == 2 else e[k] for e in load], t) for k, t in enumerate(types.values())], list(types))
        packed = (e for b in jobs._packed("<f8", "<f8")([batch.slice(0, 700), batch.slice(700)]) for e in b["event"].to_pylist())
        out = list(session.handleInputRows((1,), ((1, e) for e in packed), None))[0]
        events += load
        assert kept.calls <= 12
        assert (out.session_id, out.seen) == (1, len(events)) and out.vec == pytest.approx(folded(events))
    # Blocks of what a reset has cleared are gone.
    assert sum(len(v[0]) // 8 for v in kept.map.values()) == sum(e[1] > 20500 for e in events)


def test_events_of_a_resets_number_in_any_order(spark, tmp_path):
    """They are not after the reset, whichever comes first; events of one number are added up."""
    q = [1.0, 0.0]
    load = [[(1, 3, "approve", [0.0, 9.0], q)], [(1, 3, "reset", None, q)], [(1, 4, "approve", [0.0, 1.0], q), (1, 4, "approve", [0.0, 3.0], q)]]
    for n, order in enumerate(itertools.permutations(load)):
        if n in (0, 3):
            assert drained(spark, tmp_path, f"same{n}", order)[1] == pytest.approx(folded([e for x in load for e in x]))


def vectors(spark, x, first=0):
    return spark.createDataFrame([(first + i, r.tolist()) for i, r in enumerate(x)], "song_id long, vec array<double>")


def test_stream_into_cells(spark, tmp_path):
    """After the drain the index holds what one append of everything gives; repeats and a second drain add nothing."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 8))
    a, b, src = (str(tmp_path / k) for k in ("a", "b", "src"))
    for path in (a, b):
        CellIndex.build(vectors(spark, x[:200]), path, cells=12, codes=False)
    rest = vectors(spark, x[200:], 200)
    rest.repartition(5).write.parquet(src)
    rest.where("song_id % 3 = 0").unionByName(vectors(spark, x[:50])).unionByName(spark.createDataFrame([(5000, None)], rest.schema)).write.mode("append").parquet(src)
    for _ in range(2):
        assert not jobs.append_cells(spark, src, rest.schema, a, str(tmp_path / "check"), files=2, drift=9.0)
    CellIndex.open(spark, b).append(rest)
    cells = lambda path: sorted((i, r.cell) for r in CellIndex.open(spark, path).blocks().select("cell", "ids").collect() for i in r.ids)
    assert cells(a) == cells(b) and [i for i, _ in cells(a)] == list(range(600))
    stats = {r.cell: (r.n, pytest.approx(r.far)) for r in CellIndex.open(spark, b).statistics().collect()}
    assert {r.cell: (r.n, r.far) for r in CellIndex.open(spark, a).statistics().collect()} == stats


def test_drift_rebuilds(spark, tmp_path):
    """Vectors far from all centres: built anew as a next version, with everything in it, while the old one can still be read."""
    rng = np.random.default_rng(4)
    path, src = str(tmp_path / "i"), str(tmp_path / "src")
    old = CellIndex.build(vectors(spark, rng.normal(size=(150, 4))), path, cells=8)
    far = vectors(spark, 20 + 3 * rng.normal(size=(150, 4)), 150)
    far.write.parquet(src)
    assert jobs.append_cells(spark, src, far.schema, path, str(tmp_path / "check"))
    new = CellIndex.open(spark, path)
    assert (old.model.version, new.model.version) == (0, 1) and new.drift() == pytest.approx(1) and new.model.words
    assert new.vectors().count() == old.vectors().count() == 300
    q = far.where("song_id % 50 = 0").withColumnRenamed("song_id", "query_id")
    key = lambda d: sorted((r.query_id, r["rank"], r.song_id) for r in d.collect())
    assert key(new.search(q, 5)) == key(search.topk(q, new.vectors(), 5))
