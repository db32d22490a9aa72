"""Resumable and idempotent increments with Structured Streaming, and chat sessions as keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graphloom.operators import graph


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, key: str | None = None) -> None:
    """Process what has arrived since the last run (exactly once per checkpoint), then stop. ``key``: repeated keys are
    dropped across runs."""
    rows = stream.dropDuplicates([key]) if key else stream
    rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert_each(path: str, order: str = "seq") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges edges into versions under ``path``: version n + 1 is version n and the
    batch. Running a batch again writes the same version again."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = graph.collapse(batch, F.col(order))
        values = new.select([c for c in new.columns if c != order])
        if number:
            values = graph.merge_edges(spark.read.parquet(f"{path}/version={number - 1}"), values)
        values.write.mode("overwrite").parquet(f"{path}/version={number}")

    return merge


def sessions(messages: DataFrame, last: int = 4) -> DataFrame:
    """For each message of a stream (conv_id, turn, role, text) the window of the last messages; the state of a
    conversation is those messages. A text of ``/reset`` clears it."""
    out = "conv_id long, turn long, window string"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("turn")
        said = []
        for turn, role, text in zip(rows["turn"], rows["role"], rows["text"], strict=True):
            held = [] if text == "/reset" else [*held, f"{role}: {text}"][-last:]
            said.append((key[0], turn, "\n".join(held)))
        state.update((held,))
        yield pd.DataFrame(said, columns=["conv_id", "turn", "window"])

    return messages.groupBy("conv_id").applyInPandasWithState(step, out, "held array<string>", "append", GroupStateTimeout.NoTimeout)
