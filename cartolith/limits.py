"""Resource limits and batch sizing."""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass, field

from .errors import EdgeError


@dataclass(frozen=True)
class Limits:
    """Fixed default values of the limits."""

    max_input_bytes: int = 268_435_456
    max_output_bytes: int = 1_073_741_824
    max_rows: int = 10_000_000
    max_columns: int = 4_096
    max_vertices: int = 50_000_000
    max_cell_bytes: int = 64 << 20
    max_components: int = 100_000
    max_depth: int = 64

    @property
    def components(self) -> int:
        return min(self.max_components, self.max_vertices)


@dataclass
class Budget:
    """Shared counters of one operation; a lease is given back unless it is committed."""

    memory_bytes: int = 512 << 20
    columns: int = 65_536
    components: int = 16_777_216
    concurrency: int = 64
    duration_s: float = 30.0
    spill_bytes: int = 4 << 30
    expansion: int = 1_000
    used: dict = field(default_factory=dict)
    lock: threading.Lock = field(default_factory=threading.Lock)

    def lease(self, kind: str, amount: int = 1) -> Lease:
        with self.lock:
            now = self.used.get(kind, 0) + amount
            if now > getattr(self, kind):
                raise EdgeError("LIMIT", f"the budget for {kind} is used up", category="resource")
            self.used[kind] = now
        return Lease(self, kind, amount)


@dataclass
class Lease:
    budget: Budget
    kind: str
    amount: int
    open: bool = True

    def commit(self) -> None:
        self.open = False

    def release(self) -> None:
        if self.open:
            self.open = False
            with self.budget.lock:
                self.budget.used[self.kind] -= self.amount

    def __enter__(self) -> Lease:
        return self

    def __exit__(self, *_) -> None:
        self.release()


class Cancellation:
    """A tree of tokens; a child ends with its parent, and each may have a deadline of its own."""

    def __init__(self, parent: Cancellation | None = None, seconds: float | None = None) -> None:
        self.parent, self.ended = parent, threading.Event()
        self.deadline = None if seconds is None else time.monotonic() + seconds

    def child(self, seconds: float | None = None) -> Cancellation:
        return Cancellation(self, seconds)

    def cancel(self) -> None:
        self.ended.set()

    @property
    def cancelled(self) -> bool:
        late = self.deadline is not None and time.monotonic() > self.deadline
        return self.ended.is_set() or late or (self.parent is not None and self.parent.cancelled)

    def check(self) -> None:
        if self.cancelled:
            raise EdgeError("CANCELLED", "the operation was cancelled", category="cancelled", retry="caller")


#: Estimated bytes of a value, by Spark type name; others count 16.
ROW_BYTES = {"boolean": 1, "byte": 1, "short": 2, "integer": 4, "long": 8, "float": 4, "double": 8, "date": 4, "timestamp": 8, "timestamp_ntz": 8, "string": 64, "binary": 128}
GEOMETRY_BYTES, BATCH_BYTES, BATCH_ROWS = 512, 8 << 20, 65_536


def estimated_row_bytes(schema) -> int:
    """schema: a StructType; a field with geometry metadata counts as a geometry."""
    total = 0
    for f in schema.fields:
        kind = f.dataType.typeName()
        total += GEOMETRY_BYTES if f.metadata.get("carto.geometry") else 16 if kind.startswith("decimal") else ROW_BYTES.get(kind, 16)
    return max(1, total)


def initial_batch_rows(schema, target_bytes: int = BATCH_BYTES, max_rows: int = BATCH_ROWS) -> int:
    return max(1, min(max_rows, target_bytes // estimated_row_bytes(schema)))


def next_batch_rows(rows: int, observed_bytes: int, target_bytes: int = BATCH_BYTES, max_rows: int = BATCH_ROWS) -> int:
    """Rows of the next batch after one of ``rows`` rows took ``observed_bytes``."""
    if observed_bytes <= 0:
        return max(1, min(max_rows, rows))
    return max(1, min(max_rows, target_bytes * rows // observed_bytes))
