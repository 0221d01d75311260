"""Windows, regions, completeness, and other row filters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.geo import in_box, in_polygon
from ..functions.kernels import binned
from ..sources.stage import materialized
from .ordered import with_previous, with_rank


def between(df: DataFrame, start: float, end: float, closed: str = "left", column: str = "days") -> DataFrame:
    """Rows of a time window; ``closed`` is left [s, e), right (s, e], both or neither."""
    c = F.col(column)
    low = c >= start if closed in ("left", "both") else c > start
    return df.filter(low & (c <= end if closed in ("right", "both") else c < end))


def split_label(days: Column, start: float, train_end: float, validation_end: float, test_end: float) -> Column:
    """train, validation, test or outside, each window half-open."""
    return F.when((days >= start) & (days < train_end), "train").when((days >= train_end) & (days < validation_end), "validation").when((days >= validation_end) & (days < test_end), "test").otherwise("outside")


def in_region(df: DataFrame, ring: list[tuple[float, float]] | None, boundary: bool | None = True, stored: bool = False) -> DataFrame:
    """Rows in a ring (``boundary``: see ``geo.in_polygon``); without one, all.

    Where the places are ``stored`` columns, a filter by the ring's box comes first, which
    scans prune by; on computed places it would compute them again.
    """
    if ring is None:
        return df
    lat, lon = F.col("latitude"), F.col("longitude")
    df = df.filter(in_box(lat, lon, ring)) if stored else df
    return df.filter(in_polygon(lat, lon, ring, boundary))


def first_in_region(df: DataFrame, ring: list[tuple[float, float]], n: int, *key: str, boundary: bool | None = True) -> DataFrame:
    """``n`` of the rows in a ring, in the order of a hash of ``key``."""
    return sampled(in_region(df, ring, boundary), n, *key)


#: Tasks whose partial hulls are gathered at a time.
FAN = 16


def hull_vertices(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (x, y, z) that can be vertices of the convex hull of three ``columns``; rows with a null are left out.

    Each task keeps the extreme points of its rows, batch by batch; partial hulls are merged as a tree, ``FAN`` tasks
    into one, so no task and not the driver sees more than some hulls.
    """

    def run(batches):
        kept = np.zeros((0, 3))
        for b in batches:
            if b.num_rows:
                kept = geo.extreme_points(np.concatenate((kept, np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1))))
        yield pa.RecordBatch.from_arrays([pa.array(kept[:, i]) for i in range(3)], ["x", "y", "z"])

    schema, spark = "x double, y double, z double", df.sparkSession
    found = df.select(*[F.col(c).cast("double").alias(n) for c, n in zip(columns, "xyz")]).dropna()
    found = materialized(found.mapInArrow(run, schema))
    while (parts := len(found.inputFiles())) > 1:  # a file a task
        found = materialized(found.repartition(-(-parts // FAN)).mapInArrow(run, schema))
    return spark.createDataFrame([], schema) if found.isEmpty() else found


def hull_of(df: DataFrame, columns: list[str]) -> tuple[list[tuple[list[float], float]], float]:
    """(facets, volume) of the convex hull of three ``columns`` of any number of rows: see ``geo.hull_facets``."""
    return geo.hull_facets(np.array([tuple(r) for r in hull_vertices(df, columns).collect()], float).reshape(-1, 3))  # the vertices of one hull


def in_hull(df: DataFrame, facets: list[tuple[list[float], float]], columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Rows of a convex body, its surface included: for each facet (normal, offset), normal . x <= offset.

    ``geo.hull_facets`` gives the facets of points.
    """
    held = F.array(*[F.struct(*[F.lit(float(n)).alias(f"n{i}") for i, n in enumerate(normal)], F.lit(float(offset) + tolerance).alias("o")) for normal, offset in facets])
    point = F.struct(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    dot = lambda p, f: sum((p[f"c{i}"] * f[f"n{i}"] for i in range(len(columns))), F.lit(0.0))
    return df.filter(F.get(F.transform(F.array(point), lambda p: F.forall(held, lambda f: dot(p, f) <= f.o)), F.lit(0)))


def offspring_window(df: DataFrame, longest: float, end: float, after: float) -> DataFrame:
    """Offspring (``delay``, ``days``) of at most a delay, up to ``end`` and later than ``after``."""
    return df.filter((F.col("delay") <= longest) & (F.col("days") <= end) & (F.col("days") > after))


def forecast_rows(df: DataFrame, start: float, end: float, least: float, delta_m: float = 0.1, ring: list[tuple[float, float]] | None = None, boundary: bool | None = True) -> DataFrame:
    """Events of a closed window from half a bin below ``least`` on, then binned, then in the ring."""
    kept = df.filter((F.col("days") >= start) & (F.col("days") <= end) & (F.col("magnitude") >= least - delta_m / 2))
    return in_region(kept.withColumn("magnitude", binned(F.col("magnitude"), delta_m)), ring, boundary)


def train_test(df: DataFrame, start: float, end: float, test_end: float) -> tuple[DataFrame, DataFrame]:
    """Observed events of [start, end] and of (end, test_end]."""
    return between(df, start, end, "both"), between(df, end, test_end, "right")


def history_and_forecast(df: DataFrame, start: float) -> tuple[DataFrame, DataFrame]:
    """Events up to ``start``, and those after it."""
    return df.filter(F.col("days") <= start), df.filter(F.col("days") > start)


def among(df: DataFrame, column: str, values: list | DataFrame) -> DataFrame:
    """Rows whose ``column`` is one of ``values``: a list, or the first column of a table (semi join)."""
    if isinstance(values, DataFrame):
        keys = values.select(F.col(values.columns[0]).alias(column)).distinct()
        return df.join(keys, column, "left_semi")
    return df.filter(F.col(column).isin(values))


def lowered_reference(df: DataFrame, m_ref: float) -> DataFrame:
    """One row ``m_ref``: the reference magnitude, or the least ``mc_current`` where that is below it."""
    return df.agg(F.least(F.lit(float(m_ref)), F.coalesce(F.min("mc_current"), F.lit(float(m_ref)))).alias("m_ref"))


def complete(df: DataFrame, mc: float | str, delta_m: float = 0.1) -> DataFrame:
    """Binned magnitudes at or above completeness, with ``mc_current``.

    ``mc`` is a number, ``var`` (the column ``mc_current``), or ``positive``: each event
    must exceed the one before it by a bin; the first has none before it and goes.
    """
    df = df.withColumn("magnitude", binned(F.col("magnitude"), delta_m)) if delta_m else df
    if mc == "positive":
        df = with_previous(df, {"mc_current": F.col("magnitude")})
        df = df.withColumn("mc_current", binned(F.col("mc_current") + delta_m, delta_m)) if delta_m else df
    elif mc != "var":
        df = df.withColumn("mc_current", F.lit(float(mc)))
    return df.filter("magnitude >= mc_current")


def rounding_report(df: DataFrame, mc: float, delta_m: float = 0.1) -> DataFrame:
    """Events within half a bin of ``mc``, and at it; a difference tells of magnitudes off their bins."""
    m = F.col("magnitude")
    return df.agg(F.count_if(F.abs(m - mc) < delta_m / 2).alias("near_mc"), F.count_if(m == mc).alias("at_mc"))


def repeated(df: DataFrame, count: str) -> DataFrame:
    """Each row ``count`` times, numbered from 1 in ``copy``; rows with none or null go."""
    return df.filter(F.col(count) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(count).cast("long"))))


def sampled(df: DataFrame, n: int, *key: str) -> DataFrame:
    """``n`` rows in the order of a hash of ``key``: the same ones in any plan."""
    return df.orderBy(F.md5(F.concat_ws("|", *key).cast("binary")), *key).limit(n)


def stacked(*frames: DataFrame) -> DataFrame:
    """Union by name; columns that a frame lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def top(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows in an order: a report, not a sample."""
    return df.orderBy(*order).limit(n)


def at_ranks(df: DataFrame, ranks: list[int], order: tuple[str, ...] = ("days", "id")) -> DataFrame:
    """Rows by their places in an order, from 1, with ``rank``."""
    return with_rank(df, "rank", order).filter(F.col("rank").isin([int(r) for r in ranks]))
