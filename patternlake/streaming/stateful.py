"""Online states as a stateful operator with typed state in the RocksDB store: markers as values, the open window as a list, time to live and a state to begin with."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from patternlake.operators.online import Windows, check_windows, states_schema

MARKS = "height array<double>, place array<double>, goal array<double>, seen long, at long"
#: A unit's list of rows is written anew when it has this many times the rows of a window; until then rows are only added to it.
SLACK = 4


def use_rocksdb(spark: SparkSession) -> None:
    """Set the state store that this operator needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class OnlineStates(StatefulProcessor):
    """One unit at a time: its markers (some dozens of numbers) are written once for each batch that has rows of it, its rows are appended."""

    def __init__(self, unit: str, order: list[str], channels: list[str], size: int, hop: int, bins: int, mode: str, ttl_ms: int | None):
        self.unit, self.order, self.channels, self.ttl_ms = unit, order, channels, ttl_ms
        self.shape = (len(channels), size, hop, bins, mode)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.marks = handle.getValueState("marks", MARKS, self.ttl_ms)
        self.rows = handle.getListState("rows", "x array<double>", self.ttl_ms)

    def _load(self) -> tuple[Windows, int]:
        w, held = Windows(*self.shape), 0
        if self.marks.exists():
            height, place, goal, w.marks.seen[0], w.at[0] = self.marks.get()
            for a, flat in ((w.marks.height, height), (w.marks.place, place), (w.marks.goal, goal)):
                a[0] = np.asarray(flat, float).reshape(a[0].shape)
            rows = [r[0] for r in self.rows.get()]
            held, last = len(rows), rows[-w.size :]
            if last:
                w.rows[0, (int(w.at[0]) - len(last) + np.arange(len(last))) % w.size] = np.asarray(last, float)
        return w, held

    def _save(self, w: Windows, x: np.ndarray, held: int) -> None:
        m = w.marks
        self.marks.update((*[a[0].ravel().tolist() for a in (m.height, m.place, m.goal)], int(m.seen[0]), int(w.at[0])))
        if held + len(x) <= SLACK * w.size:
            self.rows.appendList([(r,) for r in x.tolist()])
        else:
            n = min(w.size, int(w.at[0]))
            self.rows.put([(r,) for r in w.rows[0, (int(w.at[0]) - n + np.arange(n)) % w.size].tolist()])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        x = pd.concat(list(rows)).dropna(subset=self.channels).sort_values(self.order)[self.channels].to_numpy(float)
        if not len(x):
            return
        w, held = self._load()
        one, got = np.zeros(1, np.int64), []
        for row in x:  # each sample moves the markers that the next one meets
            done, win, states = w.push(one, row[None, :])
            if len(done):
                got.append([key[0], int(win[0]), *states[0].tolist()])
        self._save(w, x, held)
        if got:
            yield pd.DataFrame(got, columns=[self.unit, "win", *self.channels])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        self.marks.update((*[[float(v) for v in r[c]] for c in ("height", "place", "goal")], int(r["seen"]), int(r["at"])))
        self.rows.put([([float(v) for v in x],) for x in r["rows"]])

    def close(self) -> None:
        pass


def stream_states(df: DataFrame, unit: str, order: list[str], channels: list[str], size: int = 30, hop: int = 15, bins: int = 3, mode: str = "textbook", ttl_ms: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """As online.online_states over a stream ``df``; a unit's batches must come in order, rows of a batch are put in order.

    A unit whose state was not written for ``ttl_ms`` (processing time) begins anew. ``initial`` (unit, height, place, goal, seen, at, rows), as of ``state_of``, is where units begin in the first batch.
    The session has to use the RocksDB store: see use_rocksdb.
    """
    check_windows(size, hop)
    processor = OnlineStates(unit, order, channels, size, hop, bins, mode, ttl_ms)
    start = None if initial is None else initial.groupBy(unit)
    return df.groupBy(unit).transformWithStateInPandas(processor, states_schema(df, unit, channels), "Append", "None" if ttl_ms is None else "ProcessingTime", start)


def state_of(df: DataFrame, unit: str, order: list[str], channels: list[str], size: int = 30, hop: int = 15, bins: int = 3, mode: str = "textbook") -> DataFrame:
    """The state that each unit of a finished table ``df`` ends in, to begin a stream with: (unit, height, place, goal, seen, at, rows)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        w, one = Windows(len(channels), size, hop, bins, mode), np.zeros(1, np.int64)
        for row in frame.dropna(subset=channels).sort_values(order)[channels].to_numpy(float):
            w.push(one, row[None, :])
        n, m = min(size, int(w.at[0])), w.marks
        rows = w.rows[0, (int(w.at[0]) - n + np.arange(n)) % size].tolist()
        return pd.DataFrame([[frame[unit].iloc[0], *[a[0].ravel().tolist() for a in (m.height, m.place, m.goal)], int(m.seen[0]), int(w.at[0]), rows]], columns=[unit, "height", "place", "goal", "seen", "at", "rows"])

    kind = df.schema[unit].dataType.simpleString()
    return df.groupBy(unit).applyInPandas(run, f"{unit} {kind}, {MARKS}, rows array<array<double>>")
