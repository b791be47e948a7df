"""Arrow batches as Python bytes and back, and what is looked up once for each distinct string of a batch."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()


def pieces(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have `most` bytes or one row each, so that memory follows `most` and not the batch."""
    sizes = [x or 0 for x in pa.compute.binary_length(batch.column(column)).to_pylist()]
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def release() -> None:
    """Give freed memory back to the system, as workers stay idle beside the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, column: str, most: int = 8 << 20) -> DataFrame:
    """mapInArrow with a function that `make` builds once per task; it gets slices of at most `most` bytes of `column`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        collects = gc.isenabled()
        gc.disable()  # caches hold many objects, and nothing here makes cycles
        try:
            function = make()
            for batch in batches:
                for part in pieces(batch, column, most):
                    yield function(part)
        finally:
            if collects:
                gc.enable()
            release()

    return df.mapInArrow(run, schema)


class Halves:
    """A cache of two generations: the older half goes when the newer is full."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def values(self, keys: list[bytes], learn: Callable[[list[bytes]], list[bytes]]) -> list[bytes]:
        """The value of each of some distinct keys; `learn` gives those of keys that are not held."""
        missing = [k for k in keys if k not in self.new]
        if len(self.new) + len(missing) > self.size:
            self.old, self.new, missing = self.new, {}, keys
        new, old, rest = self.new, self.old.get, []
        for k in missing:
            if (v := old(k)) is None:
                rest.append(k)
            else:
                new[k] = v
        new.update(zip(rest, learn(rest), strict=True))
        return list(map(new.__getitem__, keys))


def gathered(values: list[bytes], number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit integers of the values that `number` names, in turn; the first integer of each, and their number)."""
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
    first = np.cumsum(sizes) - sizes
    counts = sizes[number]
    edges = np.concatenate([[0], np.cumsum(counts)])
    where = np.repeat(first[number] - edges[:-1], counts) + np.arange(edges[-1])
    return np.frombuffer(b"".join(values), "<u4")[where], edges
