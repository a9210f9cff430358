"""The call log as a stream: each key once, the state of each question, windows over event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEYS = ["question_id", "stage", "call_index"]


def once(stream: DataFrame, keys: list[str] = KEYS, time: str | None = None, late: str = "1 hour") -> DataFrame:
    """Each key once. With an event time, keys are forgotten when the watermark has passed them; without, they are kept."""
    return stream.dropDuplicates(keys) if time is None else stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def histories(stream: DataFrame, question: str = "question_id", step: str = "step", success: str = "success") -> DataFrame:
    """(question, executed, stop_reason) whenever a question's state moves: how many steps are there without a gap, and
    whether one of them said no. Steps may come late or twice; the state keeps those ahead of a gap."""
    kinds = dict(stream.dtypes)

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, stopped, steps, answers = state.get if state.exists else (0, False, [], [])
        ahead = dict(zip(steps, answers, strict=True))
        for pdf in frames:
            ahead.update({int(s): str(a) for s, a in zip(pdf[step], pdf[success], strict=True) if int(s) >= done})
        moved = False
        while not stopped and done in ahead:
            stopped, done, moved = ahead.pop(done) == "no", done + 1, True
        state.update((done, stopped, list(ahead), list(ahead.values())))
        if moved:
            yield pd.DataFrame({question: [key[0]], "executed": [done], "stop_reason": ["semantic_inability" if stopped else "open"]})

    out = f"{question} {kinds[question]}, executed long, stop_reason string"
    return stream.groupBy(question).applyInPandasWithState(fold, out, "done long, stopped boolean, steps array<long>, answers array<string>", "update", GroupStateTimeout.NoTimeout)


def windowed(stream: DataFrame, time: str, by: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, by, n, total): counts and sums by event-time window; late rows count until the watermark."""
    grouped = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by)
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), by, "n", "total")
