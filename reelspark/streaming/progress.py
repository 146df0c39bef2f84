"""Progress of jobs as a stream: smoothed speed and time left by job, with state kept between batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "key string, n long, ema double, stage string"
STATE = "n long, ema double, stage string"


def smoothed(updates: DataFrame, weight: float = 0.25) -> DataFrame:
    """updates(key, stage, at, n, speed) -> a row for each key and batch: updates so far, smoothed speed, stage.

    Speeds that are not positive are skipped; the first one seeds; another stage
    begins anew. Updates of a batch count in order of (at, n).
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ema, stage = state.get if state.exists else (0, None, None)
        rows = pd.concat(list(batches)).sort_values(["at", "n"])  # one job's lines of one batch
        for own, speed in zip(rows["stage"], rows["speed"], strict=True):
            if own != stage:
                n, ema, stage = 0, None, own
            if speed is not None and speed > 0:
                n, ema = n + 1, float(speed) if ema is None else weight * float(speed) + (1 - weight) * ema
        state.update((n, ema, stage))
        yield pd.DataFrame({"key": [key[0]], "n": [n], "ema": [ema], "stage": [stage]})

    return updates.groupBy("key").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
