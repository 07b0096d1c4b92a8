"""A sliding-window rate limit per key: in a batch, or on a stream.

A request is accepted if fewer than `most` accepted ones lie within the window before it.
Rejected ones are not recorded, so a count over a range of rows would be wrong.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def admitted(times: list[float], window: float, most: int, recent: list[float] | None = None) -> tuple[list[bool], list[float]]:
    """Which of the times, in order, are accepted; and the accepted ones still in the window."""
    recent, out = list(recent or []), []
    for t in times:
        recent = [x for x in recent if t - x < window]
        out.append(len(recent) < most)
        if out[-1]:
            recent.append(t)
    return out, recent


def limit(requests: DataFrame, window: float = 60.0, most: int = 10) -> DataFrame:
    """requests: key, id, t (seconds). Adds accepted. Rows of a key are put in order by a sort
    that can spill and pass through as a stream, so no key is held in memory: the state is at
    most `most` times. Equal times go by id; a null key is a key like any other."""
    dealt = requests.select("key", "id", F.col("t").cast("double").alias("t")).repartition("key").sortWithinPartitions("key", "t", "id")
    key_type = requests.schema["key"].dataType.simpleString()
    id_type = requests.schema["id"].dataType.simpleString()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: Any = object()
        recent: list[float] = []
        for frame in frames:
            out = []
            for k, t in zip(frame["key"], frame["t"], strict=True):
                if not (k == key or (pd.isna(k) and pd.isna(key))):
                    key, recent = k, []
                ok, recent = admitted([t], window, most, recent)
                out.append(ok[0])
            frame["accepted"] = out
            yield frame

    return dealt.mapInPandas(work, f"key {key_type}, id {id_type}, t double, accepted boolean")


def offered(requests: DataFrame, window: float = 60.0) -> DataFrame:
    """load: requests of the key within the window before each, itself included, rejected or
    not. What SQL can say of the limit without a state."""
    w = W.partitionBy("key").orderBy("us").rangeBetween(-int(window * 1e6) + 1, 0)
    return requests.withColumn("us", (F.col("t") * 1e6).cast("long")).withColumn("load", F.count("*").over(w)).drop("us")


def limit_stream(requests: DataFrame, window: float = 60.0, most: int = 10) -> DataFrame:
    """limit() on a stream: the accepted times of each key are its state, which goes once the
    key has been idle for a window (processing time), whoever asks next."""
    key_type = requests.schema["key"].dataType.simpleString()
    id_type = requests.schema["id"].dataType.simpleString()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["t", "id"])
        ok, recent = admitted(rows["t"].tolist(), window, most, recent)
        state.update((recent,))
        state.setTimeoutDuration(max(1, int(window * 1000)))
        yield rows.assign(accepted=ok)[["key", "id", "t", "accepted"]]

    shaped = requests.select("key", "id", F.col("t").cast("double").alias("t"))
    return shaped.groupBy("key").applyInPandasWithState(step, f"key {key_type}, id {id_type}, t double, accepted boolean", "recent array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)
