"""Commit journal of a store: which run of a batch counts, through every crash.

A run of a batch writes into folders of its own (``run=<id>``), so nothing that is read is
touched while it is written. Two small records decide what counts:

- ``batches/<batch>.json``, the pointer of a finished batch: its run and the days it stored;
- ``journal/<batch>/``, there only while a run is under way. ``open.json`` is written before
  anything else and names the new run, the run it replaces and that run's days. Until
  ``switched.json`` stands beside it the new run is hidden from readers; from then on the old
  one is. Both are renamed into place, so either is whole or absent.

Readers leave out :func:`hidden_runs`, which takes one listing of the (usually empty) journal,
however many batches a store holds. A record is removed when the insights of all its days are
refreshed and the folders of the run it replaces are gone; a run that stopped before that is
undone or finished by ``adperf.plans.recover``.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import SparkSession

JOURNAL = "journal"
BATCHES = "batches"


@dataclass(frozen=True)
class Record:
    """A run under way: ``old_run`` and ``old_days`` are what the batch stored before,
    ``days`` what this run stored (known once it is ``switched``). ``kind`` says what is left to
    do after the switch: ``table`` (refresh whole days), ``deltas`` (nothing) or ``compact``."""

    batch: str
    run: str
    kind: str = "table"
    old_run: str | None = None
    old_days: list[str] = field(default_factory=list)
    days: list[str] = field(default_factory=list)
    switched: bool = False

    @property
    def hidden(self) -> str | None:
        return self.old_run if self.switched else self.run


def batch_name(batch_id: str | int) -> str:
    """A batch id as it stands in folder names: other characters than letters, digits, ``.`` and
    ``-`` are written as ``_`` and their UTF-8 bytes in hex."""
    return re.sub(r"[^A-Za-z0-9.-]", lambda m: "".join(f"_{b:02x}" for b in m[0].encode()),
                  str(batch_id))


# ---- small files --------------------------------------------------------------------------

def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, but for hidden ones; none when it is absent."""
    fs, where = _at(spark, path)
    try:
        found = fs.listStatus(where)
    except Exception as exc:  # py4j wraps Java's FileNotFoundException
        if "FileNotFoundException" in str(exc):
            return []
        raise
    names = (f.getPath().getName() for f in found)
    return sorted(n for n in names if not n.startswith(("_", ".")))


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, where = _at(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place and rename it there; an earlier one is replaced."""
    fs, where = _at(spark, path)
    _, aside = _at(spark, os.path.join(os.path.dirname(path), f".{uuid.uuid4().hex}"))
    stream = fs.create(aside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    fs.delete(where, False)
    if not fs.rename(aside, where):
        raise OSError(f"cannot write {path}")


# ---- records ------------------------------------------------------------------------------

def _folder(root: str, batch: str) -> str:
    return os.path.join(root, JOURNAL, batch)


def _put(spark: SparkSession, root: str, record: Record) -> Record:
    name = "switched.json" if record.switched else "open.json"
    write_text(spark, os.path.join(_folder(root, record.batch), name), json.dumps(asdict(record)))
    return record


def begin(spark: SparkSession, root: str, batch_id: str | int, kind: str = "table") -> Record:
    """Open a run of a batch; an earlier record of the batch must have been recovered."""
    batch = batch_name(batch_id)
    if open_record(spark, root, batch) is not None:
        raise ValueError(f"batch {batch} has a run under way; recover it first")
    old = pointer(spark, root, batch) or {}
    return _put(spark, root, Record(batch, uuid.uuid4().hex, kind, old.get("run"),
                                    old.get("days", [])))


def switch(spark: SparkSession, root: str, record: Record, days: list[str]) -> Record:
    """From here on the new run counts and the one it replaces does not."""
    return _put(spark, root, replace(record, days=days, switched=True))


def close(spark: SparkSession, root: str, record: Record) -> None:
    delete(spark, _folder(root, record.batch))


def point(spark: SparkSession, root: str, record: Record) -> None:
    """Write the pointer of a switched batch."""
    write_text(spark, os.path.join(root, BATCHES, f"{record.batch}.json"),
               json.dumps({"run": record.run, "days": record.days}))


def pointer(spark: SparkSession, root: str, batch: str) -> dict | None:
    """The run that a finished batch counts by, and its days."""
    text = read_text(spark, os.path.join(root, BATCHES, f"{batch}.json"))
    return json.loads(text) if text else None


def open_record(spark: SparkSession, root: str, batch: str) -> Record | None:
    for name in ("switched.json", "open.json"):
        text = read_text(spark, os.path.join(_folder(root, batch), name))
        if text:
            return Record(**json.loads(text))
    return None


def open_records(spark: SparkSession, root: str) -> list[Record]:
    found = (open_record(spark, root, b) for b in children(spark, os.path.join(root, JOURNAL)))
    return [r for r in found if r is not None]


def hidden_runs(spark: SparkSession, root: str) -> list[str]:
    """Runs that readers leave out: unfinished ones, and replaced ones not yet deleted."""
    return sorted(r.hidden for r in open_records(spark, root) if r.hidden)
