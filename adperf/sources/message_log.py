"""Message log with offsets (S1) and its once-only writer (S2), as a Python data source.

A log is a folder of immutable segments, one sub-folder per log partition::

    <path>/partition=<p>/<first offset>-<end offset>-<name>.parquet   columns key, value

Offsets are not stored: a message's offset is the segment's first offset plus its place. The
path is any URI that Arrow's file systems open; no broker and no server takes part.

Reading (``spark.readStream.format("adperf_log").load(path)``): Spark plans by the segments'
names on the driver, and tasks read their own segments as Arrow batches. Option
``startingOffsets``: ``earliest`` (default), ``latest`` or JSON such as ``{"0": 120}``. An end
offset never lies beyond a gap, so a late segment is waited for and no message is skipped; of
segments that overlap (redelivered ones) every offset is taken once, by the same rule on every
replay. Option ``maxOffsetsPerTrigger`` bounds a micro-batch.

Writing (``writeStream.format("adperf_log")``): each task writes one staged file per log
partition (messages are dealt by the CRC-32 of their key, so one key stays in order within a
task's rows); the commit of an epoch fixes, in one file, which staged file becomes which
segment, then renames them. A replayed commit finds that file and finishes the renames; staged
files of attempts that do not count are deleted. So a failed epoch leaves no message, and a
replayed one no second copy. Options: ``logPartitions`` (default 4), ``writer`` (a name for the
query; epochs are counted per writer).
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as afs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)

FORMAT = "adperf_log"
SCHEMA = "partition int, offset long, key string, value string"
SEGMENT = pa.schema([("key", pa.string()), ("value", pa.string())])
READ_ROWS = 4096


# ---- segments -----------------------------------------------------------------------------

def _open(path: str) -> tuple[afs.FileSystem, str]:
    return afs.FileSystem.from_uri(path)


def segments(path: str) -> dict[int, list[tuple[int, int, str]]]:
    """(first offset, end offset, file) of every segment, by log partition, in order."""
    system, base = _open(path)
    found: dict[int, list[tuple[int, int, str]]] = {}
    for info in system.get_file_info(afs.FileSelector(base, recursive=True, allow_not_found=True)):
        folder, _, name = info.path.rpartition("/")
        head, _, p = folder.rpartition("/partition=")
        if head == base and name.endswith(".parquet"):
            first, end = map(int, name.split("-")[:2])
            found.setdefault(int(p), []).append((first, end, info.path))
    return {p: sorted(s) for p, s in found.items()}


def reach(parts: list[tuple[int, int, str]], start: int) -> int:
    """The offset up to which segments follow ``start`` without a gap."""
    for first, end, _ in parts:
        if first > start:
            break
        start = max(start, end)
    return start


def redeliver(path: str) -> None:
    """Deliver every segment once more under another name, as an upstream retry would."""
    system, _ = _open(path)
    for parts in segments(path).values():
        for _, _, file in parts:
            system.copy_file(file, f"{file.removesuffix('.parquet')}-again.parquet")


@dataclass
class Slice(InputPartition):
    """Messages ``lo <= offset < hi`` of one segment."""

    partition: int
    file: str
    first: int
    lo: int
    hi: int


def slices(path: str, start: dict, end: dict) -> list[Slice]:
    """Each offset from ``start`` to ``end`` once, from the first segment that holds it."""
    out, known = [], segments(path)
    for p, hi in end.items():
        parts = known.get(int(p), [])
        at = start.get(p, parts[0][0] if parts else 0)
        for first, stop, file in parts:
            if first <= at < min(stop, hi):
                out.append(Slice(int(p), file, first, at, min(stop, hi)))
                at = min(stop, hi)
        if at < hi:
            raise ValueError(f"partition {p} has no segment for offset {at}")
    return out


def read_slice(path: str, part: Slice) -> Iterator[pa.RecordBatch]:
    system, _ = _open(path)
    with pq.ParquetFile(system.open_input_file(part.file)) as file:
        at = part.first
        for batch in file.iter_batches(READ_ROWS):
            lo, hi = max(part.lo - at, 0), min(part.hi - at, batch.num_rows)
            if lo < hi:
                rows = batch.slice(lo, hi - lo)
                offsets = pa.array(range(at + lo, at + hi), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.partition] * len(offsets), pa.int32()), offsets,
                     rows.column("key"), rows.column("value")],
                    names=["partition", "offset", "key", "value"])
            at += batch.num_rows


# ---- source -------------------------------------------------------------------------------

class LogStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.starting = options.get("startingOffsets", "earliest")
        self.most = int(options.get("maxOffsetsPerTrigger", 0))
        self.seen: dict | None = None  # where the last planned micro-batch ended

    def initialOffset(self) -> dict:
        known = segments(self.path)
        first = {str(p): s[0][0] for p, s in known.items()}
        if self.starting == "latest":
            return {p: reach(known[int(p)], at) for p, at in first.items()}
        if self.starting != "earliest":
            first |= {str(p): int(at) for p, at in json.loads(self.starting).items()}
        return first

    def latestOffset(self) -> dict:
        known = segments(self.path)
        start = self.seen if self.seen is not None else self.initialOffset()
        end, left = dict(start), self.most
        for p in sorted(known):
            at = start.get(str(p), known[p][0][0])
            to = reach(known[p], at)
            if self.most:
                to = min(to, at + left)
                left -= to - at
            end[str(p)] = to
        return end

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        self.seen = end
        return slices(self.path, start, end)

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return read_slice(self.path, partition)

    def commit(self, end: dict) -> None:
        self.seen = end


class LogReader(DataSourceReader):
    """Batch scan of all that lies before the first gap of each log partition."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def partitions(self) -> list[Slice]:
        known = segments(self.path)
        return slices(self.path, {}, {str(p): reach(s, s[0][0]) for p, s in known.items()})

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return read_slice(self.path, partition)


# ---- sink ---------------------------------------------------------------------------------

@dataclass
class Staged(WriterCommitMessage):
    """Files that a task staged: (log partition, file, messages)."""

    files: list[tuple[int, str, int]]


class LogStreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.parts = int(options.get("logPartitions", 4))
        self.name = options.get("writer", "writer")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        system, base = _open(self.path)
        system.create_dir(f"{base}/_staged", recursive=True)
        open_: dict[int, tuple[str, pq.ParquetWriter]] = {}
        counts: dict[int, int] = {}
        for batch in iterator:
            batch = pa.Table.from_batches([batch]).select(["key", "value"]).cast(SEGMENT)
            dealt = pa.array([zlib.crc32((k or "").encode()) % self.parts
                              for k in batch["key"].to_pylist()], pa.int32())
            for p in pc.unique(dealt).to_pylist():
                rows = batch.filter(pc.equal(dealt, p))
                if p not in open_:
                    file = f"{base}/_staged/{uuid.uuid4().hex}.parquet"
                    open_[p] = (file, pq.ParquetWriter(system.open_output_stream(file), SEGMENT))
                open_[p][1].write_table(rows)
                counts[p] = counts.get(p, 0) + len(rows)
        for _, writer in open_.values():
            writer.close()
        return Staged([(p, open_[p][0], counts[p]) for p in sorted(open_)])

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        system, base = _open(self.path)
        plan_file = f"{base}/_commits/{self.name}-{batchId}.json"
        staged = [f for m in messages if m is not None for f in m.files]
        plan = _read_json(system, plan_file)
        if plan is None:
            end = {p: max(e for _, e, _ in s) for p, s in segments(self.path).items()}
            plan = []
            for n, (p, file, count) in enumerate(staged):
                first = end.get(p, 0)
                end[p] = first + count
                plan.append([file, f"{base}/partition={p}/{first:020d}-{end[p]:020d}-"
                                   f"{self.name}-{batchId}-{n}.parquet"])
            _write_json(system, plan_file, plan)
        else:  # a replay: what this attempt staged does not count
            planned = {file for file, _ in plan}
            _remove(system, [f for _, f, _ in staged if f not in planned])
        for file, final in plan:
            if _there(system, file):
                system.create_dir(final.rpartition("/")[0], recursive=True)
                system.move(file, final)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        system, base = _open(self.path)
        plan = _read_json(system, f"{base}/_commits/{self.name}-{batchId}.json") or []
        planned = {file for file, _ in plan}
        _remove(system, [f for m in messages if m is not None for _, f, _ in m.files
                         if f not in planned])


def _there(system: afs.FileSystem, file: str) -> bool:
    return system.get_file_info(file).type == afs.FileType.File


def _remove(system: afs.FileSystem, files: list[str]) -> None:
    for file in files:
        if _there(system, file):
            system.delete_file(file)


def _read_json(system: afs.FileSystem, file: str):
    if not _there(system, file):
        return None
    with system.open_input_stream(file) as stream:
        return json.loads(stream.read())


def _write_json(system: afs.FileSystem, file: str, value) -> None:
    """Written aside and renamed into place, so it is whole or absent."""
    system.create_dir(file.rpartition("/")[0], recursive=True)
    aside = f"{file}.{uuid.uuid4().hex}"
    with system.open_output_stream(aside) as stream:
        stream.write(json.dumps(value).encode())
    system.move(aside, file)


class MessageLog(DataSource):
    """The format ``adperf_log``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(self.options)

    def streamWriter(self, schema, overwrite) -> LogStreamWriter:
        return LogStreamWriter(self.options)


def register(spark: SparkSession) -> str:
    """Make the format known to a session; returns its name."""
    spark.dataSource.register(MessageLog)
    return FORMAT
