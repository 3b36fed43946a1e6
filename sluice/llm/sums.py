"""Sums of arrays of fixed size over all tasks, added up in a tree so that neither a reducer nor the driver holds one from every task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Partial sums that reach the driver.
LAST = 8


def tree_sum(table: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], list[np.ndarray] | None]) -> list[np.ndarray] | None:
    """The sum over all tasks of the arrays ``run`` makes of a task's batches; none where no task makes any.

    A task's arrays must have the same lengths and types everywhere. They travel as bytes, first to as many
    reducers as the session shuffles to, then to ``LAST``, whose sums the driver adds.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = run(batches)
        if got is not None:
            yield _row(TaskContext.get().partitionId(), got)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = 0, None
        for batch in batches:
            for p, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = _arrays(row)
                part, total = p, got if total is None else [a + b for a, b in zip(total, got)]
        if total is not None:
            yield _row(part, total)

    schema = "part int, arrays array<binary>"
    sums = table.mapInArrow(make, schema).repartition("part").mapInArrow(add, schema).repartition(LAST, "part").mapInArrow(add, schema)
    total = None
    for r in sorted(sums.collect(), key=lambda r: r.part):  # at most LAST rows
        got = _arrays(r.arrays)
        total = got if total is None else [a + b for a, b in zip(total, got)]
    return total


def _row(part: int, arrays: list[np.ndarray]) -> pa.RecordBatch:
    told = [x for a in arrays for x in (a.dtype.str.encode(), np.ascontiguousarray(a).tobytes())]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([told], pa.list_(pa.binary()))], ["part", "arrays"])


def _arrays(row: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(bytes(row[k + 1]), np.dtype(bytes(row[k]).decode())) for k in range(0, len(row), 2)]
