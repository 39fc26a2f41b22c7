"""Shared scans: any number of visitors in one physical pass, each with bounds and aggregates of its own.

visit() makes one plan. Ride collects calls from threads until enough wait or the oldest has waited long enough, then runs one pass
for all of them; calls that arrive meanwhile form the next pass.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.errors import Code, StoreError
from keyloom.functions.routing import within


@dataclass(frozen=True)
class Visitor:
    """A name, bounds (lower <= key < upper, None for none), and aggregates by name, each made for the rows within."""

    name: str
    lower: bytes | None = None
    upper: bytes | None = None
    aggregates: dict[str, Callable[[Column], Column]] = field(default_factory=lambda: {"n": lambda inside: F.count_if(inside)})


def visit(view: DataFrame, visitors: list[Visitor]) -> DataFrame:
    """One row with a column name_aggregate for each; the table is read once, and only as far as some visitor's bounds ask."""
    if not visitors:
        raise StoreError(Code.INVALID_ARGUMENT, "a shared scan needs a visitor")
    wanted = F.lit(False)
    for v in visitors:
        wanted = wanted | within("key", v.lower, v.upper)
    columns = [make(within("key", v.lower, v.upper)).alias(f"{v.name}_{k}") for v in visitors for k, make in v.aggregates.items()]
    return view.filter(wanted).agg(*columns)


@dataclass(frozen=True)
class RowVisitor:
    """A name, bounds, and make(): called once a partition, it gives a function from each Arrow batch of the rows within to a batch or None."""

    name: str
    lower: bytes | None
    upper: bytes | None
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]]


def visit_rows(view: DataFrame, visitors: list[RowVisitor], schema: str) -> DataFrame:
    """Each visitor gets the rows of its range on the executors, in ascending order of the keys, in one pass for all of them.

    Partitions are ranges of keys, so a visitor sees the rows of a partition in order, and partitions follow each other as their
    keys do. The result has a column visitor before those of the schema that all visitors make.
    """
    if not visitors:
        raise StoreError(Code.INVALID_ARGUMENT, "a shared scan needs a visitor")
    wanted = F.lit(False)
    for v in visitors:
        wanted = wanted | within("key", v.lower, v.upper)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = [(v, v.make()) for v in visitors]
        for b in batches:
            keys = b.column("key").cast(pa.binary())
            for v, step in steps:
                low = _first_not_below(keys, v.lower, 0)
                high = _first_not_below(keys, v.upper, b.num_rows)
                if low < high and (out := step(b.slice(low, high - low))) is not None and out.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array([v.name] * out.num_rows, pa.string()), *out.columns], names=["visitor", *out.schema.names])

    return view.filter(wanted).repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, f"visitor string, {schema}")


def _first_not_below(keys: pa.Array, bound: bytes | None, without: int) -> int:
    """Position of the first of the ascending keys that is not below a bound."""
    if bound is None:
        return without
    low, high = 0, len(keys)
    while low < high:
        mid = (low + high) // 2
        if keys[mid].as_py() < bound:
            low = mid + 1
        else:
            high = mid
    return low


class Ride:
    """Calls of submit() wait for one shared pass over a view: at `calls` waiting, or after `seconds` for the oldest."""

    def __init__(self, view: DataFrame, calls: int = 64, seconds: float = 10.0) -> None:
        self.view, self.calls, self.seconds, self.passes = view, calls, seconds, 0
        self.lock, self.waiting, self.closed = threading.Condition(), [], False
        self.thread = threading.Thread(target=self._run, daemon=True)
        self.thread.start()

    def submit(self, visitor: Visitor, timeout: float = 180.0) -> dict[str, object]:
        """The visitor's aggregates by name, once its pass is over."""
        slot = {"visitor": visitor, "since": time.monotonic(), "done": threading.Event(), "out": None, "error": None}
        with self.lock:
            if self.closed:
                raise StoreError(Code.NOT_SUPPORTED, "the ride is closed")
            self.waiting.append(slot)
            self.lock.notify_all()
        if not slot["done"].wait(timeout):
            raise StoreError(Code.TIMEDOUT, f"no result within {timeout} s")
        if slot["error"]:
            raise slot["error"]
        return slot["out"]

    def _run(self) -> None:
        while True:
            with self.lock:
                while not self.closed and len(self.waiting) < self.calls and not (self.waiting and time.monotonic() - self.waiting[0]["since"] >= self.seconds):
                    oldest = self.waiting[0]["since"] + self.seconds - time.monotonic() if self.waiting else None
                    self.lock.wait(oldest if oldest is None else max(oldest, 0.001))
                if self.closed and not self.waiting:
                    return
                now, self.waiting = self.waiting, []
            try:
                renamed = [Visitor(f"v{k}", s["visitor"].lower, s["visitor"].upper, s["visitor"].aggregates) for k, s in enumerate(now)]
                row = visit(self.view, renamed).first().asDict()
                self.passes += 1
                for k, s in enumerate(now):
                    s["out"] = {name: row[f"v{k}_{name}"] for name in s["visitor"].aggregates}
            except Exception as e:  # noqa: BLE001  each caller gets it
                for s in now:
                    s["error"] = e
            for s in now:
                s["done"].set()

    def close(self) -> None:
        """Runs what waits, then ends."""
        with self.lock:
            self.closed = True
            self.lock.notify_all()
        self.thread.join()
