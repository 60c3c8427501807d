"""Streams: online states as a stateful operator, and re-mining at micro-batch boundaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from patternlake.operators.online import Windows, check_windows, states_schema


def stream_states(
    df: DataFrame, unit: str, order: list[str], channels: list[str], size: int = 30, hop: int = 15, bins: int = 3, mode: str = "textbook", forget_ms: int | None = None
) -> DataFrame:
    """As online_states, over a stream: each unit keeps its markers and the rows of its open window between micro-batches, as plain numbers.

    Rows of a batch are put in order; a unit's batches must come in order. With ``forget_ms`` the state of a unit without
    rows for that long (processing time) is dropped, and it begins anew when it comes back.
    """
    check_windows(size, hop)

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        w = Windows(len(channels), size, hop, bins, mode)
        if state.exists:
            w.load(state.get[0])
        rows = pd.concat(list(frames)).dropna(subset=channels).sort_values(order)[channels].to_numpy(float)
        one, got = np.zeros(1, np.int64), []
        for row in rows:
            done, win, states = w.push(one, row[None, :])
            if len(done):
                got.append([key[0], int(win[0]), *states[0].tolist()])
        state.update((w.dump(),))
        if forget_ms is not None:
            state.setTimeoutDuration(forget_ms)
        yield pd.DataFrame(got, columns=[unit, "win", *channels])

    timeout = GroupStateTimeout.NoTimeout if forget_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return df.groupBy(unit).applyInPandasWithState(run, states_schema(df, unit, channels), "numbers array<double>", "append", timeout)


def remine(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str):
    """Call ``on_batch`` with all transactions of each micro-batch, for example to mine the stages again; starts the query."""
    return stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).start()


def windowed_support(txns: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Item supports per event-time window, closed ``late`` after its end: an extension, since the core windows count rows."""
    each = txns.withWatermark(time, late).select(F.window(time, width).alias("w"), F.explode(F.array_distinct("items")).alias("item"))
    return each.groupBy("w", "item").agg(F.count("*").alias("support")).select(F.col("w.start").alias("start"), "item", "support")
