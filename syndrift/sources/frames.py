"""Frames to and from DataFrames.

``read`` goes through Spark's binary files, so it reaches whatever store Spark reaches; a file is one task, as
frames cannot be found from the middle.  ``FrameSource`` registers the format ``frames`` for reading, tailing a
folder as a stream, reading a socket and writing one file for each partition.
"""

from __future__ import annotations

import itertools
import socket
import threading
from collections.abc import Iterator
from dataclasses import replace
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, SimpleDataSourceStreamReader, WriterCommitMessage
from pyspark.sql.types import StructType

from . import wire

SCHEMA = (
    "stream_id string, schema_id string, frame_id bigint, round bigint, timestamp_ns bigint, qubit_count int, ancilla_count int, "
    "code_type int, distance int, flags int, events_rle binary, events array<boolean>, meas array<tinyint>, timing_ns array<int>, parity binary, "
    "metadata struct<hardware_id:string,temperature_mk:double,cycle_us:double,decoder_hint:int,observable_flips:bigint>, "
    "annotations array<struct<logical_id:int,observable_mask:bigint,frame_basis:int>>, error struct<kind:string,detail:string>"
)


def row(stream_id: str, schema_id: str | None, f: wire.Frame) -> tuple:
    for name in ("frame_id", "timestamp_ns"):
        if getattr(f, name) >= 1 << 63:
            raise wire.FrameError("Overflow", field=name, got=getattr(f, name))
    meta = None
    if f.metadata is not None:
        meta = (*(f.metadata[k] for k in ("hardware_id", "temperature_mk", "cycle_us", "decoder_hint")), None if f.metadata["observable_flips"] is None else wire.signed(f.metadata["observable_flips"]))
    notes = None if f.annotations is None else [(a, wire.signed(m), b) for a, m, b in f.annotations]
    return (stream_id, schema_id, f.frame_id, f.round, f.timestamp_ns, f.qubit_count, f.ancilla_count, f.code_type, f.distance, f.flags, f.events_rle, f.events, f.meas, f.timing_ns, f.parity, meta, notes, None)


def broken(stream_id: str, schema_id: str | None, e: wire.FrameError) -> tuple:
    return (stream_id, schema_id, *[None] * 15, (e.kind, str(e.detail)))


def decode(stream_id: str, data: bytes, mode: str = "permissive", terminator: str = "header", ordered: bool = True) -> Iterator[tuple]:
    """Rows of one file.  Modes: permissive ends a broken file with a row that has the error, failfast raises it,
    lenient checks nothing."""
    schema = None
    try:
        schema, body = wire.sniff(data)
        for f in wire.read_frames_lenient(body) if mode == "lenient" else wire.read_frames(body, terminator, ordered):
            yield row(stream_id, schema, f)
    except wire.FrameError as e:
        if mode == "failfast":
            raise
        yield broken(stream_id, schema, e)


#: Recordings of so many bytes are read in runs of frames, shorter ones frame by frame.
LONG = 1 << 14
#: Frames of a run.
RUN = 2000
_HEAD = np.dtype([("frame_id", "<u8"), ("round", "<u4"), ("timestamp_ns", "<u8"), ("qubit_count", "<u2"), ("ancilla_count", "<u2"), ("payload", "<u4"), ("code_type", "u1"), ("distance", "u1"), ("flags", "<u2"), ("crc", "<u4")])


def decode_batches(stream_id: str, data: bytes, schema: pa.Schema, mode: str = "permissive", terminator: str = "header", ordered: bool = True) -> Iterator[pa.RecordBatch]:
    """The rows of ``decode``, other than lenient, in batches.

    Runs of sound frames without timing, parity and annotations become columns at once; any other run, and whatever
    comes from the first violation on, is read frame by frame.
    """
    try:
        schema_id, body = wire.sniff(data)
    except wire.FrameError:
        yield from batches(decode(stream_id, data, mode, terminator, ordered), schema)
        return
    at, last = 0, None
    while at < len(body):
        starts, end = wire.sound_run(body, at, RUN, terminator)
        made = _columns(stream_id, schema_id, body, starts, last if ordered else None, ordered, schema) if len(starts) else None
        if made is None:
            to = end if len(starts) else len(body)
            rows, failed = [], False
            try:
                for f in wire.read_frames(body[at:to], terminator, ordered):
                    if ordered and last is not None and f.frame_id <= last:
                        raise wire.FrameError("FrameOutOfOrder", last_id=last, got=f.frame_id)
                    last = f.frame_id
                    rows.append(row(stream_id, schema_id, f))
            except wire.FrameError as e:
                if mode == "failfast":
                    raise
                rows.append(broken(stream_id, schema_id, e))
                failed = True
            yield from batches(iter(rows), schema)
            if failed or to == len(body):
                return
            at = to
            continue
        last = int(made.column("frame_id")[-1].as_py())
        yield made
        at = end


def _columns(stream_id: str, schema_id: str | None, body: bytes, starts: np.ndarray, last: int | None, ordered: bool, schema: pa.Schema) -> pa.RecordBatch | None:
    """Frames that start at ``starts`` as columns; None if one of them has to be read by itself."""
    buf, k = np.frombuffer(body, np.uint8), len(starts)
    head = np.ascontiguousarray(buf[starts[:, None] + np.arange(wire.FRAME_HEADER.size)]).view(_HEAD).ravel()
    if (head["flags"] & ~np.uint16(wire.METADATA)).any() or (head["payload"] < 2).any() or (head["frame_id"] >> 63).any() or (head["timestamp_ns"] >> 63).any():
        return None
    ids = head["frame_id"].astype(np.int64)
    if ordered and ((np.diff(ids) <= 0).any() or last is not None and ids[0] <= last):
        return None
    n, at = head["ancilla_count"].astype(np.int64), starts + wire.FRAME_HEADER.size
    code = buf[at].astype(np.int64) + 256 * buf[at + 1].astype(np.int64)
    if (2 + code + n > head["payload"]).any():
        return None
    places = lambda first, size: np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
    token, owner = buf[places(at + 2, code)], np.repeat(np.arange(k), code)
    run = (token & 127).astype(np.int64)
    frame, value = np.repeat(owner, run), np.repeat(token >= 128, run)
    decoded = np.bincount(frame, minlength=k)
    place = np.arange(len(frame)) - np.repeat(np.cumsum(decoded) - decoded, decoded)
    inside = place < n[frame]
    events = np.zeros(n.sum(), bool)
    events[(np.cumsum(n) - n)[frame[inside]] + place[inside]] = value[inside]
    ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
    metas = None
    if head["flags"].any():
        tail, stop, has = at + 2 + code + n, at + head["payload"], head["flags"] != 0
        own = [wire.parse_metadata(body[a:b])[0] if h else None for a, b, h in zip(tail.tolist(), stop.tolist(), has.tolist(), strict=True)]
        metas = [m and m | {"observable_flips": None if m["observable_flips"] is None else wire.signed(m["observable_flips"])} for m in own]
    made = {
        "stream_id": pa.repeat(pa.scalar(stream_id, pa.string()), k), "schema_id": pa.repeat(pa.scalar(schema_id, pa.string()), k),
        "events_rle": pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer(np.concatenate([[0], np.cumsum(code)]).astype(np.int32)), pa.py_buffer(token)]),
        "events": pa.ListArray.from_arrays(ends, pa.array(events)), "meas": pa.ListArray.from_arrays(ends, pa.array(buf[places(at + 2 + code, n)].view(np.int8))),
    }
    for f in schema:
        if f.name in _HEAD.names:
            made[f.name] = pa.array(head[f.name].astype(np.int64)).cast(f.type)
        elif f.name == "metadata" and metas:
            made[f.name] = pa.array(metas, f.type)
        elif f.name not in made:
            made[f.name] = pa.nulls(k, f.type)
    return pa.RecordBatch.from_arrays([made[f.name].cast(f.type) for f in schema], schema=schema)


def arrow_schema(spark_schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark_schema)


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([_struct(r[i], f.type) for r in held], f.type) for i, f in enumerate(schema)], schema=schema)

    for r in rows:
        held.append(r)
        if len(held) == size:
            yield flush()
            held = []
    if held:
        yield flush()


def _struct(v, kind: pa.DataType):
    if v is None:
        return None
    if pa.types.is_struct(kind):
        return {kind.field(i).name: x for i, x in enumerate(v)}
    if pa.types.is_list(kind) and pa.types.is_struct(kind.value_type):
        return [_struct(x, kind.value_type) for x in v]
    return v


def read(spark: SparkSession, path: str, mode: str = "permissive", terminator: str = "header", ordered: bool = True, pattern: str = "*") -> DataFrame:
    """All frames below ``path``, one task for each file; compressed recordings are found by their first bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return parse(files, mode, terminator, ordered)


def parse(files: DataFrame, mode: str = "permissive", terminator: str = "header", ordered: bool = True) -> DataFrame:
    """All frames of recordings in ``content``; ``path`` becomes the stream.  A recording without content is none."""
    schema = arrow_schema(StructType.fromDDL(SCHEMA))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small: list[tuple] = []
        for part in parts:
            for i in range(part.num_rows):
                path, data = part.column(0)[i].as_py(), part.column(1)[i].as_py()
                if mode != "lenient" and len(data) >= LONG:
                    yield from decode_batches(path, data, schema, mode, terminator, ordered)
                    continue
                for r in decode(path, data, mode, terminator, ordered):
                    small.append(r)
                    if len(small) == RUN:
                        yield from batches(iter(small), schema)
                        small = []
        yield from batches(iter(small), schema)

    return files.where("content is not null").select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content")).mapInArrow(run, SCHEMA)


def messages(frames: DataFrame, schema_id: str = wire.NO_SCHEMA, terminator: str = "header", compression_level: int | None = None) -> DataFrame:
    """path (the stream), frame_id and content: every frame as a recording of its own, as message queues carry them."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = wire.file_header(schema_id)
        for part in parts:
            rows = part.to_pylist()
            own = [to_frame(r) for r in rows]
            data = [wire.record([f], compression_level, terminator, schema_id) if compression_level else head + wire.encode_frame(f, terminator) for f in own]
            yield pa.RecordBatch.from_arrays([pa.array([r["stream_id"] for r in rows], pa.string()), part.column("frame_id").cast(pa.int64()), pa.array(data, pa.binary())], ["path", "frame_id", "content"])

    return frames.withColumns({"stream_id": F.col("stream_id").cast("string"), "frame_id": F.col("frame_id").cast("bigint")}).mapInArrow(run, "path string, frame_id bigint, content binary")


def good(frames: DataFrame) -> DataFrame:
    return frames.where("error is null").drop("error")


def quarantine(frames: DataFrame) -> DataFrame:
    return frames.where("error is not null").select("stream_id", "schema_id", "error.*")


def to_frame(r) -> wire.Frame:
    """A wire frame of a row with at least frame_id and events; what else it lacks gets the exporter's defaults."""
    d = r.asDict(recursive=True) if hasattr(r, "asDict") else dict(r)
    events = [bool(x) for x in d["events"]]
    meta = d.get("metadata")
    if meta is None and d.get("observable_flips") is not None:
        meta = {"observable_flips": d["observable_flips"]}
    notes = d.get("annotations")
    own = {k: d[k] for k in ("round", "timestamp_ns", "qubit_count", "code_type", "distance") if d.get(k) is not None}
    f = wire.Frame(frame_id=d["frame_id"], ancilla_count=len(events), events=events, meas=list(d.get("meas") or [-1 if e else 1 for e in events]))
    return replace(f, **own, timing_ns=d.get("timing_ns"), parity=None if d.get("parity") is None else bytes(d["parity"]), metadata=meta, annotations=None if notes is None else [(a["logical_id"], a["observable_mask"], a["frame_basis"]) for a in notes])


class _Commit(WriterCommitMessage):
    def __init__(self, name: str, n: int):
        self.name, self.n = name, n


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.options = options

    def write(self, iterator):
        from pyarrow import fs
        from pyspark import TaskContext

        o, task = self.options, TaskContext.get()
        store, base = fs.FileSystem.from_uri(o["path"] if "://" in o["path"] else f"file://{o['path']}")
        frames = [to_frame(r) for r in iterator]
        frames.sort(key=lambda f: f.frame_id)
        level, schema, terminator = o.get("compressionlevel"), o.get("schemaid", wire.NO_SCHEMA), o.get("terminator", "header")
        data = wire.record(frames, int(level), terminator) if level else wire.file_header(schema) + b"".join(wire.encode_frame(f, terminator) for f in frames)
        name = f"{base}/part-{task.partitionId():05d}-{task.taskAttemptId()}.bin"
        if frames:
            store.create_dir(base)
            with store.open_output_stream(name) as out:
                out.write(data)
        return _Commit(name, len(frames))

    def abort(self, messages):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.options["path"] if "://" in self.options["path"] else f"file://{self.options['path']}")
        for m in messages:
            if m and m.n:
                store.delete_file(m.name)


def received(address: str, options: dict) -> Iterator[tuple]:
    """Rows of the frames of tcp://host:port, each as soon as it is there; a violation ends them as in ``decode``."""
    u, schema = urlparse(address), None
    with socket.create_connection((u.hostname, u.port), float(options.get("timeout", 30))) as s, s.makefile("rb") as f:
        try:
            for schema, frame in wire.read_stream(f, options.get("terminator", "header"), options.get("ordered", "true") == "true"):
                yield row(address, schema, frame)
        except wire.FrameError as e:
            if options.get("mode") == "failfast":
                raise
            yield broken(address, schema, e)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: pa.Schema):
        self.options, self.schema = options, schema

    def partitions(self):
        path = self.options["path"]
        if path.startswith("tcp://"):
            return [InputPartition(path)]
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        found = store.get_file_info(base)
        names = [base] if found.is_file else sorted(x.path for x in store.get_file_info(fs.FileSelector(base, recursive=True)) if x.is_file)
        return [InputPartition((path, n)) for n in names] or [InputPartition(None)]

    def read(self, partition):
        o, at = self.options, partition.value
        if at is None:
            return
        if isinstance(at, str):
            yield from itertools.islice(received(at, o), int(o["maxframes"]) if "maxframes" in o else None)
            return
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(at[0] if "://" in at[0] else f"file://{at[0]}")
        with store.open_input_stream(at[1]) as f:
            data, name = f.read(), at[1]
        mode, how = o.get("mode", "permissive"), (o.get("terminator", "header"), o.get("ordered", "true") == "true")
        if mode == "lenient":
            yield from batches(decode(name, data, mode, *how), self.schema)
        else:
            yield from decode_batches(name, data, self.schema, mode, *how)


class _Tail(SimpleDataSourceStreamReader):
    """New whole frames of the files of a folder; the offset is how many bytes of each were taken."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self):
        return {}

    def _new(self, start: dict, end: dict | None):
        from pyarrow import fs

        path = self.options["path"]
        store, base = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        out, offset = [], dict(start)
        for info in sorted(store.get_file_info(fs.FileSelector(base, recursive=True)), key=lambda x: x.path):
            if not info.is_file or (end is not None and info.path not in end):
                continue
            with store.open_input_file(info.path) as f:
                head = f.read(wire.FILE_HEADER.size)
                f.seek(start.get(info.path, wire.FILE_HEADER.size))
                data = f.read() if end is None else f.read(end[info.path] - start.get(info.path, wire.FILE_HEADER.size))
            if len(head) < wire.FILE_HEADER.size:
                continue
            at, schema = 0, wire.parse_file_header(head)[0]
            try:
                while at + wire.FRAME_HEADER.size <= len(data):
                    _, n = wire.parse_frame_header(data[at : at + wire.FRAME_HEADER.size])
                    whole = wire.FRAME_HEADER.size + n + wire.TERMINATOR.size
                    if at + whole > len(data):
                        break
                    out += [row(info.path, schema, x) for x in wire.read_frames(data[at : at + whole], self.options.get("terminator", "header"))]
                    at += whole
            except wire.FrameError as e:
                out.append(broken(info.path, schema, e))
                at = len(data)
            offset[info.path] = start.get(info.path, wire.FILE_HEADER.size) + at
        return out, offset

    def read(self, start):
        rows, offset = self._new(start, None)
        return iter(rows), offset

    def readBetweenOffsets(self, start, end):
        return iter(self._new(start, end)[0])


class _Feed(SimpleDataSourceStreamReader):
    """Frames of a socket as they come; the offset is their number.

    A thread reads ahead by at most ``readAhead`` rows, then the sender has to wait.  A socket cannot be read again, so
    rows are held until they are committed, and a query that restarts after that misses none but those sent meanwhile.
    """

    def __init__(self, options: dict):
        self.options, self.first, self.rows, self.failed, self.lock = options, 0, [], None, None

    def __getstate__(self):
        return {"options": self.options}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def _start(self) -> None:
        if self.lock is None:
            self.lock = threading.Condition()
            threading.Thread(target=self._run, daemon=True).start()

    def _run(self) -> None:
        try:
            for r in received(self.options["path"], self.options):
                with self.lock:
                    self.lock.wait_for(lambda: len(self.rows) < int(self.options.get("readahead", 100_000)))
                    self.rows.append(r)
        except Exception as e:  # noqa: BLE001
            self.failed = e

    def initialOffset(self):
        return {"frames": 0}

    def read(self, start):
        self._start()
        if self.failed:
            raise self.failed
        with self.lock:
            self.first = max(self.first, start["frames"] - len(self.rows))
            rows = self.rows[start["frames"] - self.first :]
        return iter(rows), {"frames": start["frames"] + len(rows)}

    def readBetweenOffsets(self, start, end):
        self._start()
        with self.lock:
            return iter(self.rows[max(start["frames"] - self.first, 0) : max(end["frames"] - self.first, 0)])

    def commit(self, end):
        self._start()
        with self.lock:
            gone = max(end["frames"] - self.first, 0)
            self.rows, self.first = self.rows[gone:], self.first + gone
            self.lock.notify_all()


class FrameSource(DataSource):
    """Format ``frames``.  Options: path (or tcp://host:port), mode, terminator, ordered; for sockets maxFrames (batch)
    and readAhead (stream); for writing schemaId and compressionLevel."""

    @classmethod
    def name(cls):
        return "frames"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(dict(self.options), arrow_schema(schema))

    def writer(self, schema, overwrite):
        return _Writer(dict(self.options))

    def simpleStreamReader(self, schema):
        own = dict(self.options)
        return _Feed(own) if own["path"].startswith("tcp://") else _Tail(own)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameSource)


def write(frames: DataFrame, path: str, schema_id: str = wire.NO_SCHEMA, terminator: str = "header", compression_level: int | None = None) -> None:
    """One file for each partition, sorted by frame_id; flags, lengths and CRCs are made anew."""
    register(frames.sparkSession)
    out = frames.write.format("frames").mode("append").option("schemaId", schema_id).option("terminator", terminator)
    if compression_level:
        out = out.option("compressionLevel", compression_level)
    out.save(path)


def synthetic(spark: SparkSession, n: int, fire_rate: float, ancillas: int = 24, qubits: int = 25, distance: int = 5) -> DataFrame:
    """Frames of a distance-5 surface code in which detector j of frame i fires when (i + j) is a multiple of the modulus."""
    modulus = int(1 / max(fire_rate, 0.01)) + 1
    events = F.transform(F.sequence(F.lit(0), F.lit(ancillas - 1)), lambda j: (F.col("id") + j) % modulus == 0)
    return spark.range(n).select(
        F.lit("synthetic").alias("stream_id"), F.col("id").alias("frame_id"), F.col("id").alias("round"), (F.col("id") * 1_100_000).alias("timestamp_ns"),
        F.lit(qubits).alias("qubit_count"), F.lit(ancillas).alias("ancilla_count"), F.lit(1).alias("code_type"), F.lit(distance).alias("distance"), events.alias("events"),
        F.transform(events, lambda e: F.when(e, -1).otherwise(1).cast("tinyint")).alias("meas"),
    )
