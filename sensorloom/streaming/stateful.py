"""Traffic features of unbounded series, one state per key.

The state holds the last ``history`` samples and velocities. Feed it bucketed rates
(``windows.rate_windows``), not raw messages: the work per key then depends on the clock,
not on the traffic. Rows of one micro-batch are put in time order; a sample that is not
later than the one before it is kept but gives no velocity.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.series import HISTORY, MIN_SAMPLES, REFRESH_EVERY, TREND_SPAN

STATE = """
  samples bigint, steps bigint, last_us bigint, level double,
  xs array<double>, vs array<double>
"""
OUTPUT = """
  sample_no bigint, velocity double, acceleration double, rolling_mean double,
  rolling_std double, burst_probability double, hour_sin double, hour_cos double
"""


# Rolling windows are computed for so many samples at a time.
BLOCK = 1024


def _rolling(values: np.ndarray, first: int, history: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of the last ``history`` values at each position from ``first`` on."""
    padded = np.concatenate((np.full(history - 1, np.nan), values))
    windows = np.lib.stride_tricks.sliding_window_view(padded, history)[first:]
    means, stds = np.empty(len(windows)), np.empty(len(windows))
    for low in range(0, len(windows), BLOCK):
        part = windows[low : low + BLOCK]
        means[low : low + BLOCK], stds[low : low + BLOCK] = np.nanmean(part, axis=1), np.nanstd(part, axis=1)
    return means, stds


def burst(vs: np.ndarray, count: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Burst probability at samples that have seen the first ``count`` of the velocities, under their thresholds."""
    out = np.zeros(len(count))
    ready = (count >= MIN_SAMPLES) & (levels > 0)
    if ready.any():
        seen, level = count[ready], levels[ready]
        rises = np.concatenate(([0], np.cumsum(np.diff(vs) > 0)))
        span = np.minimum(TREND_SPAN, seen) - 1
        share = (rises[seen - 1] - rises[seen - 1 - span]) / span
        with np.errstate(over="ignore"):
            logistic = 1.0 / (1.0 + np.exp(-5.0 * (vs[seen - 1] / level - 1.0)))
        out[ready] = np.clip(0.6 * logistic + 0.4 * share, 0.0, 1.0)
    return out


class FeatureState(StatefulProcessor):
    """Carries a key's history from one micro-batch to the next."""

    def __init__(self, keys: Sequence[str], ts: str, x: str, history: int = HISTORY, ttl_ms: int | None = None):
        self.keys, self.ts, self.x, self.history, self.ttl_ms = list(keys), ts, x, history, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("history", STATE, self.ttl_ms)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values([self.ts, self.x], kind="stable")
        if self.state.exists():
            samples, steps, last_us, level, xs, vs = self.state.get()
        else:
            samples, steps, last_us, level, xs, vs = 0, 0, None, None, [], []
        xs, vs = np.array(xs, dtype=float), np.array(vs, dtype=float)
        times, x = new[self.ts], new[self.x].to_numpy(dtype=float)
        us = times.astype("datetime64[us]").astype("int64").to_numpy()

        before_us = np.concatenate(([us[0] if last_us is None else last_us], us[:-1]))
        before_x = np.concatenate((xs[-1:] if len(xs) else x[:1], x[:-1]))
        moved = us > before_us
        speeds = (x[moved] - before_x[moved]) / ((us[moved] - before_us[moved]) / 1e6)
        every_x, every_v = np.concatenate((xs, x)), np.concatenate((vs, speeds))
        count = len(vs) + np.cumsum(moved)
        number = samples + 1 + np.arange(len(x))

        # The threshold changes at few samples: the first that has one, and each that is due.
        enough = count >= MIN_SAMPLES
        due = enough & (number % REFRESH_EVERY == 0)
        if level is None and enough.any():
            due[np.argmax(enough)] = True
        levels = np.full(len(x), np.nan if level is None else level)
        for i in np.flatnonzero(due):
            level = float(np.percentile(every_v[max(0, count[i] - self.history) : count[i]], 90))
            levels[i:] = level

        mean, std = _rolling(every_x, len(xs), self.history)
        velocity = np.where(count > 0, every_v[np.maximum(count, 1) - 1] if len(every_v) else 0.0, 0.0)
        turn = np.where(count > 1, velocity - (every_v[np.maximum(count, 2) - 2] if len(every_v) > 1 else 0.0), 0.0)
        hours = (times.dt.hour + times.dt.minute / 60.0).to_numpy() * (2 * np.pi / 24.0)
        found = (velocity, turn, mean, std, burst(every_v, count, levels), np.sin(hours), np.cos(hours))
        warm = number >= MIN_SAMPLES
        # A state row must not hold numpy scalars.
        self.state.update(
            (
                int(number[-1]), int(steps + moved.sum()), int(us[-1]), level,
                every_x[-self.history :].tolist(), every_v[-self.history :].tolist(),
            )
        )
        columns = {name: [key[i]] * len(x) for i, name in enumerate(self.keys)}
        columns |= {self.ts: times.to_numpy(), "sample_no": number}
        columns |= {name: np.where(warm, values, 0.0) for name, values in zip(FEATURES, found)}
        yield pd.DataFrame(columns)


FEATURES = ("velocity", "acceleration", "rolling_mean", "rolling_std", "burst_probability", "hour_sin", "hour_cos")


def feature_stream(
    rates: DataFrame, keys: Sequence[str], ts: str, x: str, history: int = HISTORY, ttl_ms: int | None = None
) -> DataFrame:
    """Same rows as ``series.traffic_features``, computed as samples arrive. Needs RocksDB state.

    With ``ttl_ms`` the state of a key that has been silent for so long is dropped, and the key
    starts anew.
    """
    kept = rates.select(*keys, ts, x)
    fields = [f for f in kept.schema.fields if f.name != x]
    output = StructType([*fields, *StructType.fromDDL(OUTPUT).fields])
    return kept.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=FeatureState(keys, ts, x, history, ttl_ms),
        outputStructType=output,
        outputMode="Append",
        timeMode="None" if ttl_ms is None else "ProcessingTime",
    )
