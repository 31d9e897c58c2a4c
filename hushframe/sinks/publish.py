"""Staged snapshots with a marker that is written last.

A run writes its artefacts once, below ``snapshots/<run>``.  Gates then read
what was written, and only after that come the contract artefacts, the sentinel
and the marker.  Readers go through the marker, so a run that dies or is refused
leaves the earlier snapshot in place, and nothing has to be moved.

Markers are numbered files.  A run claims the next number by creating a file that
must not exist; of two runs that finish at once one gets the number and the other
tries the following one.  Runs that write and readers that hold a snapshot have a
lease, and a purge leaves alone what a lease names until it runs out.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe import rules
from hushframe.sinks.files import create_new, delete, join, listed, read_text

_MARKERS, _SNAPSHOTS, _LEASES = "markers", "snapshots", "leases"

#: Seconds after which a lease that nobody gave back no longer counts.
LEASE_SECONDS = 24 * 3600.0

#: What a read, a computation or a write of one table may fail with.
TABLE_ERRORS = (PySparkException, Py4JJavaError, ValueError, OSError)

Gate = Callable[[dict[str, DataFrame]], None]


class PublishError(RuntimeError):
    """Nothing was published, or nothing can be read."""


def _numbers(spark: SparkSession, target: str) -> list[int]:
    names = listed(spark, join(target, _MARKERS))
    return sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)


def _latest(spark: SparkSession, target: str) -> dict | None:
    """The marker of the highest number that is completely written."""
    for number in _numbers(spark, target):
        text = read_text(spark, join(target, _MARKERS, f"{number:012d}.json"))
        if text.endswith("\n"):
            return json.loads(text)
    return None


def _lease(spark: SparkSession, target: str, run: str, seconds: float) -> str:
    path = join(target, _LEASES, f"{uuid.uuid4().hex}.json")
    create_new(spark, path, json.dumps({"run": run, "until": time.time() + seconds}) + "\n")
    return path


def _leased(spark: SparkSession, target: str) -> set[str]:
    """Runs that a lease protects; leases that ran out are removed."""
    held, now = set(), time.time()
    for name in listed(spark, join(target, _LEASES)):
        try:
            text = read_text(spark, join(target, _LEASES, name))
        except Py4JJavaError:  # given back in the meantime
            continue
        lease = json.loads(text) if text.endswith("\n") else None
        if lease and lease["until"] < now:
            delete(spark, join(target, _LEASES, name))
        elif lease:
            held.add(lease["run"])
    return held


class Publication:
    """One run: tables are written and checked on their own, and become visible together."""

    def __init__(self, spark: SparkSession, target: str, sentinel: str, lease: float = LEASE_SECONDS):
        self.spark, self.target, self.sentinel = spark, target, sentinel
        self.run = uuid.uuid4().hex
        self.written: dict[str, DataFrame] = {}
        self.rows: dict[str, int] = {}
        self.failed: dict[str, str] = {}
        self._lease = _lease(spark, target, self.run, lease)

    def __enter__(self) -> Publication:
        return self

    def __exit__(self, *_) -> None:
        delete(self.spark, self._lease)

    def _path(self, name: str) -> str:
        return join(self.target, _SNAPSHOTS, self.run, name)

    def write(self, name: str, frame: DataFrame) -> DataFrame:
        """The table as written; its rows are counted by the write itself.

        A table without columns has nothing to write and counts as empty.
        """
        self.rows[name] = 0
        self.written[name] = frame
        if frame.columns:
            seen = Observation()
            frame.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(self._path(name))
            self.rows[name] = seen.get["rows"]
            self.written[name] = self.spark.read.schema(frame.schema).parquet(self._path(name))
        return self.written[name]

    def attempt(self, name: str, make: Callable[[], DataFrame]) -> bool:
        """Write a table that may fail; what it left behind is removed and the reason kept."""
        try:
            self.write(name, make())
            return True
        except TABLE_ERRORS as error:
            self.failed[name] = str(error)[: rules.SKIP_DETAIL_MAX]
            self.rows.pop(name, None)
            self.written.pop(name, None)
            delete(self.spark, self._path(name))
            return False

    def check(self, *gates: Gate) -> None:
        for gate in gates:
            gate(dict(self.written))

    def commit(self) -> int:
        """Make the snapshot the current one; its number."""
        if self.sentinel not in self.written:
            raise PublishError(f"no artefact {self.sentinel!r}; refusing to publish")
        empty = sorted(n for n, frame in self.written.items() if not frame.columns)
        number = 0
        while True:
            number = max([number, *_numbers(self.spark, self.target)[:1]]) + 1
            marker = {"run": self.run, "number": number, "sentinel": self.sentinel, "empty": empty}
            if create_new(self.spark, join(self.target, _MARKERS, f"{number:012d}.json"), json.dumps(marker) + "\n"):
                return number


def publish(
    spark: SparkSession,
    target: str,
    artefacts: dict[str, DataFrame],
    sentinel: str,
    preceding: tuple[str, ...] = (),
    gates: tuple[Gate, ...] = (),
) -> str:
    """Write and check the tables, then the contract artefacts, then the marker.

    ``gates`` get the written tables, and stop the run by raising.
    """
    if sentinel not in artefacts:
        raise PublishError(f"no artefact {sentinel!r}; refusing to publish")
    held = [n for n in preceding if n in artefacts]
    with Publication(spark, target, sentinel) as run:
        for name in sorted(artefacts):
            if name != sentinel and name not in held:
                run.write(name, artefacts[name])
        run.check(*gates)
        for name in [*held, sentinel]:
            run.write(name, artefacts[name])
        run.commit()
        return run.run


def _read(spark: SparkSession, target: str, marker: dict, name: str) -> DataFrame:
    if name in marker["empty"]:
        return spark.createDataFrame([], T.StructType([]))
    return spark.read.parquet(join(target, _SNAPSHOTS, marker["run"], name))


def _current(spark: SparkSession, target: str) -> dict:
    last = _latest(spark, target)
    if last is None:
        raise PublishError(f"{target} has no completed publication")
    return last


def read_published(spark: SparkSession, target: str, name: str) -> DataFrame:
    """An artefact of the current snapshot; refuses targets without a marker."""
    return _read(spark, target, _current(spark, target), name)


@contextmanager
def held_snapshot(spark: SparkSession, target: str, lease: float = LEASE_SECONDS) -> Iterator[Callable[[str], DataFrame]]:
    """The artefacts of one snapshot by name; no purge removes it as long as the block lasts.

    A snapshot that stops being the current one while its lease is written may be gone
    already, so the marker is read again after that.
    """
    marker = _current(spark, target)
    while True:
        path = _lease(spark, target, marker["run"], lease)
        again = _current(spark, target)
        if again["run"] == marker["run"]:
            break
        delete(spark, path)
        marker = again
    try:
        yield lambda name: _read(spark, target, marker, name)
    finally:
        delete(spark, path)


def purge_superseded(spark: SparkSession, target: str) -> int:
    """Delete snapshots that neither the marker nor a lease names, refused runs included.

    Snapshots are listed first, then the leases, then the marker: a run that finishes in
    between is either still leased or already current.
    """
    found = listed(spark, join(target, _SNAPSHOTS))
    leased = _leased(spark, target)
    last = _latest(spark, target)
    if last is None:
        return 0
    old = [run for run in found if run != last["run"] and run not in leased]
    for run in old:
        delete(spark, join(target, _SNAPSHOTS, run))
    return len(old)
