"""Structured Streaming jobs: exact and cell indexes grow by new vectors, feedback sessions keep their events and sums."""

import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import FloatType

from melodex.operators.cell_index import DRIFT, CellIndex
from melodex.operators.feedback import ALPHA, BETA, GAMMA


def append_index(spark: SparkSession, source: str, schema, index: str, checkpoint: str, key: str = "song_id") -> None:
    """Drain new files of vectors into an index table; ids that it holds already, and repeats in a batch, are ignored."""

    def add(batch: DataFrame, _: int) -> None:
        fresh = batch.groupBy(key).agg(*[F.min_by(c, F.xxhash64("vec")).alias(c) for c in batch.columns if c != key])
        try:
            fresh = fresh.join(spark.read.schema(batch.schema).parquet(index).select(key).hint("merge"), key, "left_anti")
        except Exception as e:  # the first batch: there is no index yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("append").parquet(index)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(source)
    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_cells(spark: SparkSession, source: str, schema, index: str, checkpoint: str, files: int | None = 4, drift: float = DRIFT) -> bool:
    """Drain new files of vectors (song_id, vec) into a stored cell index; was the index built anew?

    Each batch goes to the index's centres as they are. Ids that it holds already, repeats and null vectors are left out, so
    a batch that is run again after a failure adds nothing. Once drained, an index whose vectors lie ``drift`` times as far
    from their centres (mean squared distance) as at its build is built anew, as a next version.
    """

    def add(batch: DataFrame, _: int) -> None:
        CellIndex.open(spark, index).append(batch.select("song_id", "vec"))

    reader = spark.readStream.schema(schema)
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(source)
    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    now = CellIndex.open(spark, index)
    if now.drift() < drift:
        return False
    now.rebuild()
    return True


#: Map state needs this store; a batch without data would have another after it, for timers that might run out, without end.
_WHILE_RUNNING = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


#: Most events of a session that are one value of its state.
_BLOCK = 4096

#: Below all numbers of events; the number of those without one, which mean nothing.
_NEVER = -(1 << 62)

#: Before an event's vector and query: its number, its verdict, and the bytes of both (-1: null).
_HEAD = "<qqqq"
_HEAD_BYTES = struct.calcsize(_HEAD)
_APPROVE, _REJECT, _RESET = 1, 2, 3
_VERDICT = f"CASE verdict WHEN 'approve' THEN {_APPROVE} WHEN 'reject' THEN {_REJECT} WHEN 'reset' THEN {_RESET} ELSE 0 END"


def _bytes(lists: pa.ListArray, kind: str) -> list[bytes | None]:
    """Each list's numbers as bytes; null components are NaN."""
    cells, ends = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), kind), lists.offsets.to_numpy()
    raw, ends = cells.tobytes(), (ends * cells.itemsize).tolist()
    return [raw[i:j] if valid else None for i, j, valid in zip(ends, ends[1:], lists.is_valid().to_pylist())]


def _packed(vec_kind: str, query_kind: str):
    """Events as one binary value each, which a session's Python takes in many times faster than arrays."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs, verdicts = batch.column("seq").to_pylist(), batch.column("verdict").to_pylist()
            of = zip(seqs, verdicts, _bytes(batch.column("vec"), vec_kind), _bytes(batch.column("query"), query_kind))
            events = [struct.pack(_HEAD, seq, verdict, -1 if v is None else len(v), -1 if q is None else len(q)) + (v or b"") + (q or b"") for seq, verdict, v, q in of]
            yield pa.RecordBatch.from_arrays([batch.column("session_id"), pa.array(events, pa.binary())], ["session_id", "event"])

    return pack


class _Session(StatefulProcessor):
    """A session's events since its last reset, in blocks, and the sums of what they approve and reject.

    What a batch brings is a block or a few (numbers, verdicts, vectors), so that the state is asked a few times a session and
    batch, however many events there are. The sums are kept beside the blocks, which are only read again when a batch brings
    a reset: events with smaller numbers go, and the sums are made of those that stay, however late the reset comes.
    """

    def __init__(self, idle: int | None, vec_kind: str = "<f8", query_kind: str = "<f8"):
        self.idle, self.vec_kind, self.query_kind = idle, vec_kind, query_kind

    def init(self, handle) -> None:
        self.handle = handle
        self.about = handle.getValueState("about", "sums binary, approved long, rejected long, seen long, since long, query binary, query_seq long, blocks long, due long")
        self.events = handle.getMapState("events", "block long", "seqs binary, approved binary, vecs binary")

    @staticmethod
    def _added(sums: tuple, approved: np.ndarray, vecs: np.ndarray) -> tuple:
        """Sums of approved and rejected vectors, and their counts, with those of more events."""
        before, n_up, n_down = sums
        more = np.stack([vecs[approved].sum(axis=0, dtype=float), vecs[~approved].sum(axis=0, dtype=float)])
        up = int(approved.sum())
        return before + more if before.size and more.size else before if before.size else more, n_up + up, n_down + len(approved) - up

    def _later(self, since: int) -> tuple[tuple, int]:
        """The sums of events after a number, which alone stay in the blocks, and the next block's number."""
        sums, blocks = (np.zeros((2, 0)), 0, 0), 0
        for (block,) in list(self.events.keys()):
            seqs, approved, vecs = (np.frombuffer(x, kind) for x, kind in zip(self.events.getValue((block,)), ("<i8", bool, self.vec_kind)))
            vecs, keep = vecs.reshape(len(seqs), -1), seqs > since
            if not keep.any():
                self.events.removeKey((block,))
                continue
            if not keep.all():
                seqs, approved, vecs = seqs[keep], approved[keep], vecs[keep]
                self.events.updateValue((block,), (seqs.tobytes(), approved.tobytes(), vecs.tobytes()))
            sums, blocks = self._added(sums, approved, vecs), max(blocks, block + 1)
        return sums, blocks

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        cells, n_up, n_down, seen, since, query, query_seq, blocks, due = self.about.get() or (b"", 0, 0, 0, _NEVER, b"", _NEVER, 0, 0)
        sums, again = (np.frombuffer(cells).reshape(2, -1), n_up, n_down), False
        rows = iter(rows)
        while events := [(*struct.unpack_from(_HEAD, event), event) for _, event in itertools.islice(rows, _BLOCK)]:
            seen += len(events)
            last, _, at, size, event = max(reversed(events), key=lambda e: e[0])
            if last >= query_seq:
                if size < 0:
                    raise ValueError(f"the query of event {last} of session {key[0]} is null")
                query, query_seq = np.frombuffer(event[_HEAD_BYTES + max(at, 0) :], self.query_kind).astype(float).tobytes(), last
            reset = max((seq for seq, verdict, *_ in events if verdict == _RESET), default=_NEVER)
            if reset > since:
                since, sums, again = reset, (np.zeros((2, 0)), 0, 0), blocks > 0
            of = [e for e in events if e[0] > since and e[1] in (_APPROVE, _REJECT) and e[2] >= 0]
            if of:
                size = max(e[2] for e in of)
                vecs = [e[4][_HEAD_BYTES : _HEAD_BYTES + e[2]] or bytes(size) for e in of]
                if any(len(v) != size for v in vecs):
                    raise ValueError(f"vectors of different lengths in session {key[0]}")
                seqs, approved, vecs = np.array([e[0] for e in of], "<i8"), np.array([e[1] == _APPROVE for e in of]), b"".join(vecs)
                self.events.updateValue((blocks,), (seqs.tobytes(), approved.tobytes(), vecs))
                sums, blocks = self._added(sums, approved, np.frombuffer(vecs, self.vec_kind).reshape(len(of), -1)), blocks + 1
        if again:
            sums, blocks = self._later(since)
        if self.idle is not None:
            if due:
                self.handle.deleteTimer(due)
            due = timerValues.getCurrentProcessingTimeInMs() + self.idle
            self.handle.registerTimer(due)
        (up, down), n_up, n_down = sums
        self.about.update((sums[0].tobytes(), n_up, n_down, seen, since, query, query_seq, blocks, due))
        out = ALPHA * np.frombuffer(query) + (BETA * up / n_up if n_up and up.size else 0) - (GAMMA * down / n_down if n_down and down.size else 0)
        norm = np.linalg.norm(out)
        yield Row(session_id=key[0], seen=seen, vec=(out / norm if norm > 1e-8 else out).tolist())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """An idle session is forgotten; what it emitted stays."""
        self.about.clear()
        self.events.clear()
        yield from ()

    def close(self) -> None:
        pass


def feedback_stream(spark: SparkSession, source: str, schema, out: str, checkpoint: str, files: int | None = None, idle: int | None = None) -> None:
    """Drain judged events (session_id, seq, verdict, vec, query) into adjusted queries: session_id, seen, vec.

    Each session's events since its last reset are state, by their numbers; every batch with events of a session emits its
    query as it is then, and ``seen``, how many events it has had in all, which only grows: the row with the most is the
    latest. A batch is what is new, or ``files`` files of it at a time. Events count by ``seq``, in whatever batch they come:
    a reset clears those up to its own number, also if it comes later than greater ones, and such that come after it are
    ignored. So are unknown verdicts and null vectors. The query is that of the greatest seq. Events of
    one number are added up. With ``idle``, a session without events for so many milliseconds is forgotten (checked when a batch runs); otherwise sessions stay.
    A session's events of one batch are folded in one task.
    """
    reader = spark.readStream.schema(schema)
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(source)
    kinds = ["<f4" if isinstance(stream.schema[c].dataType.elementType, FloatType) else "<f8" for c in ("vec", "query")]
    told = stream.select(F.col("session_id").cast("long").alias("session_id"), F.coalesce("seq", F.lit(_NEVER)).cast("long").alias("seq"), F.expr(_VERDICT).alias("verdict"), "vec", "query")
    events = told.mapInArrow(_packed(*kinds), "session_id long, event binary")
    moved = events.groupBy("session_id").transformWithState(_Session(idle, *kinds), "session_id long, seen long, vec array<double>", "Update", "None" if idle is None else "ProcessingTime")

    def add(batch: DataFrame, _: int) -> None:
        batch.write.mode("append").parquet(out)

    before = {name: spark.conf.get(name, None) for name in _WHILE_RUNNING}
    for name, value in _WHILE_RUNNING.items():
        spark.conf.set(name, value)
    try:
        moved.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def latest(emitted: DataFrame) -> DataFrame:
    """session_id, vec: each session's query as it was emitted last."""
    return emitted.groupBy("session_id").agg(F.max_by("vec", "seen").alias("vec"))
