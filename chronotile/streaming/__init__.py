"""Observations as they arrive: regular composites by event time, and change detection with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def regularize_stream(obs: DataFrame, period: str, lateness: str, keys: list[str], value: str = "value", order: str = "cloud_cover", time: str = "ts") -> DataFrame:
    """The least cloudy value of each key and tumbling period; periods close when the watermark passes them."""
    d = obs.where(F.col(value).isNotNull()).withWatermark(time, lateness)
    best = F.min(F.struct(F.col(order).alias("_o"), F.col(time).alias("_t"), F.col(value).alias("_v")))
    return d.groupBy(*keys, F.window(time, period).alias("w")).agg(best.alias("_m")).select(*keys, F.col("w.start").alias("period"), F.col("_m._v").alias(value))


def detect_changes_stream(obs: DataFrame, key: str = "sample_id", time: str = "ts", probability: str = "p", threshold: float = 0.5, chi: float = 0.9) -> DataFrame:
    """A row for each key when its change is confirmed; the state of a key is the run of dates that is flagged."""
    from ..operators.change import ChangeState

    kind = obs.schema[key].dataType.simpleString()

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        previous, values, times, done = state.get if state.exists else (0.5, [], [], False)
        s = ChangeState(threshold, chi, previous, list(zip(values or [], times or [], strict=True)))
        rows = pd.concat(list(parts)).sort_values(time)
        for t, p in zip(rows[time], rows[probability], strict=True):
            if not done and pd.notna(p) and (at := s.update(p, t)) is not None:
                done = True
                yield pd.DataFrame({key: [k[0]], "change": [at]})
        run = [] if done else s.run
        state.update((s.previous, [float(v) for v, _ in run], [pd.Timestamp(t).to_pydatetime() for _, t in run], done))

    return obs.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, change timestamp", "previous double, run array<double>, times array<timestamp>, done boolean", "append", GroupStateTimeout.NoTimeout)
