"""Minimum gap since the last *allowed* event, in batch.

Denied events do not move the clock, so a lag window is wrong: whether an event passes
depends on the whole chain before it.  The chain is cut into time buckets.  Each bucket is
reduced to a small step function (last allowed time before it -> last allowed time after
it), the step functions are chained per key, and a second pass marks the events.  A key
that holds most rows is spread over all of its buckets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FREE = -(2**62)  # no event allowed yet


def _chain_end(times: np.ndarray, gap: int) -> np.ndarray:
    """Index of the last allowed event when the chain is entered at each event."""
    following = np.searchsorted(times, times + gap, side="left")
    end = np.arange(len(times))
    for i in range(len(times) - 1, -1, -1):
        if following[i] < len(times):
            end[i] = end[following[i]]
    return end


def _steps(gap: int):
    def reduce(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(rows["_t"].to_numpy())
        ends = times[_chain_end(times, gap)]
        # The last allowed time lies before all of these, be it in this bucket, so only an event within
        # a gap of the first one, or the first event after that, can start the chain.
        n = min(len(times), int(np.searchsorted(times, times[0] + gap, side="left")) + 1)
        last_of_run = np.append(ends[1:n] != ends[: n - 1], True)
        return pd.DataFrame(
            {"_key": key[0], "_b": key[1], "upto": times[:n][last_of_run], "end": ends[:n][last_of_run]}
        )

    return reduce


def _carry(gap: int):
    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        known = rows["_b"].isna()  # a row without bucket holds the last allowed time before all others
        last, out = int(rows.loc[known, "end"].max()) if known.any() else _FREE, []
        rows = rows[~known]
        for bucket, steps in rows.sort_values(["_b", "upto"]).groupby("_b", sort=True):
            out.append((key[0], bucket, last))
            usable = steps[steps["upto"] >= last + gap] if last != _FREE else steps
            if len(usable):
                last = int(usable["end"].iloc[0])
        return pd.DataFrame(out, columns=["_key", "_b", "entry"])

    return fold


def _allowed(gap: int):
    def mark(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(rows["_t"].to_numpy())
        last, out, i = int(rows["entry"].iloc[0]), [], 0
        while i < len(times):
            if last != _FREE:
                i = int(np.searchsorted(times, last + gap, side="left"))
                if i == len(times):
                    break
            last = int(times[i])
            out.append(last)
            i += 1
        return pd.DataFrame({"_key": key[0], "_t": np.array(out, dtype="int64")})

    return mark


def allowed_marks(marks: DataFrame, gap: int, bucket: int, clocks: DataFrame | None = None) -> DataFrame:
    """(_key, _t) of the allowed ones of distinct ``marks`` (_key, _t), after the last allowed times ``clocks``
    (_key, _last) of keys before them.  A clock may lie in the bucket of a key's first marks, but before these.

    A group holds one time bucket of a key, or one short step function per bucket.
    """
    slots = marks.select("_key", F.floor(F.col("_t") / bucket).cast("long").alias("_b"), "_t")
    key_type = dict(slots.dtypes)["_key"]
    steps = slots.groupBy("_key", "_b").applyInPandas(
        _steps(gap), f"_key {key_type}, _b long, upto long, end long"
    )
    if clocks is not None:
        none = F.lit(None).cast("long")
        steps = steps.union(clocks.select("_key", none.alias("_b"), none.alias("upto"), F.col("_last").alias("end")))
    entries = steps.groupBy("_key").applyInPandas(_carry(gap), f"_key {key_type}, _b long, entry long")
    return slots.join(entries, ["_key", "_b"]).groupBy("_key", "_b").applyInPandas(_allowed(gap), f"_key {key_type}, _t long")


def rate_limited(
    df: DataFrame, key: str, time: str, tie: str, gap: int, bucket: int = 3600
) -> DataFrame:
    """Add ``allowed``.

    ``time`` is a whole number of time units, ``gap`` and ``bucket`` use the same unit and
    ``bucket`` is at least ``gap``.  Among events of one key at the same time the lowest
    ``tie`` goes first.  Times are made distinct before anything is grouped, so one group
    holds at most ``bucket`` values whatever the traffic.
    """
    if bucket < gap:
        raise ValueError("bucket must be at least gap")
    marks = df.groupBy(F.col(key).alias("_key"), F.col(time).cast("long").alias("_t")).agg(F.min(tie).alias("_tie"))
    passed = allowed_marks(marks, gap, bucket)
    winners = passed.join(marks, ["_key", "_t"]).select("_key", "_t", "_tie", F.lit(True).alias("_ok"))
    on = (F.col(key) == F.col("_key")) & (F.col(time) == F.col("_t")) & (F.col(tie) == F.col("_tie"))
    return df.join(winners, on, "left").select(*df.columns, F.coalesce("_ok", F.lit(False)).alias("allowed"))


