"""Memory of sources as a stateful stream: the fold of runs, one source's state at a time, with the shape tripwire."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sluice.operators.runs import QUARANTINE_AFTER

STATE = "success_count bigint, failure_count bigint, consecutive_failures bigint, last_status string, last_ok_at timestamp, last_run_at timestamp, last_error string, doc_url_pattern string"
MEMORY = "source_id string, " + STATE + ", quarantined boolean, shape_changed boolean"
_NAMES = [x.split()[0] for x in STATE.split(", ")]


def fold(state: dict, status: str, at, error: str | None, pattern: str | None) -> dict:
    """State after a run."""
    s = dict(state, last_status=status, last_run_at=at)
    if status == "ok":
        return s | {"success_count": s["success_count"] + 1, "consecutive_failures": 0, "last_ok_at": at, "last_error": None, "doc_url_pattern": pattern or s["doc_url_pattern"]}
    return s | {"failure_count": s["failure_count"] + 1, "consecutive_failures": s["consecutive_failures"] + 1, "last_error": error}


class MemoryProcessor(StatefulProcessor):
    """Folds a source's runs of each micro-batch in order of time, then run; gives the memory after them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("memory", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        s = dict(zip(_NAMES, self.state.get())) if self.state.exists() else dict(zip(_NAMES, (0, 0, 0, None, None, None, None, None)))
        none = lambda v: None if v is None or v is pd.NaT or v != v else v
        runs = [tuple(none(v) for v in r) for df in rows for r in df[["started_at", "run_id", "status", "error", "pattern"]].itertuples(index=False, name=None)]
        changed = False
        for at, _, status, error, pattern in sorted(runs, key=lambda r: (r[0] is not None, r[0] or pd.Timestamp(0), r[1])):
            # The shape is compared with what was known before the run.
            changed = status == "ok" and bool(s["doc_url_pattern"]) and bool(pattern) and pattern != s["doc_url_pattern"]
            s = fold(s, status, at, error, pattern)
        self.state.update(tuple(x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in (s[n] for n in _NAMES)))
        out = {n: [s[n]] for n in _NAMES}
        frame = pd.DataFrame({"source_id": [key[0]], **out, "quarantined": [s["consecutive_failures"] >= QUARANTINE_AFTER], "shape_changed": [changed]})
        for c in ("last_ok_at", "last_run_at"):
            frame[c] = pd.to_datetime(frame[c])
        yield frame

    def close(self) -> None:
        pass


def memory_stream(runs: DataFrame) -> DataFrame:
    """A stream of runs (``source_id, run_id, status, started_at, error, pattern``) to a stream of memory, in update mode.

    Needs the RocksDB state store (``use_rocksdb``).
    """
    return runs.groupBy("source_id").transformWithStateInPandas(statefulProcessor=MemoryProcessor(), outputStructType=MEMORY, outputMode="Update", timeMode="None")


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
