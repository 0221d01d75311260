"""Event rates, sessions and running magnitude statistics of a stream of events (``time``, ``magnitude``, ``region``)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_event_time(stream: DataFrame, column: str = "time", late: str = "1 hour") -> DataFrame:
    """Event time as a timestamp with a watermark; times without zone count as UTC."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def windowed(stream: DataFrame, length: str, slide: str | None = None, column: str = "time") -> DataFrame:
    """Counts and largest magnitude of tumbling or sliding windows."""
    w = F.window(column, length, slide) if slide else F.window(column, length)
    return stream.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("magnitude").alias("largest")).select("w.start", "w.end", "n", "largest")


def sessions(stream: DataFrame, gap: str, column: str = "time") -> DataFrame:
    """Bursts of events without a pause of ``gap``, by region."""
    return stream.groupBy(F.session_window(column, gap).alias("w"), "region").agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "region", "n")


def positive_steps(stream: DataFrame, delta_m: float = 0.1) -> DataFrame:
    """Running (region, steps, mean_step) of positive magnitude steps, the input of the b-positive estimate, kept as state."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, n, total = state.get if state.exists else (None, 0, 0.0)
        for frame in frames:
            for m in frame.sort_values("time")["magnitude"]:
                if last is not None and m - last > delta_m / 2:
                    n, total = n + 1, total + (m - last)
                last = float(m)
        state.update((last, n, total))
        yield pd.DataFrame({"region": [key[0]], "steps": [n], "mean_step": [total / n if n else None]})

    return stream.groupBy("region").applyInPandasWithState(run, "region string, steps long, mean_step double", "last double, n long, total double", "update", "NoTimeout")
