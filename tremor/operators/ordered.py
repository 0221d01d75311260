"""Windows over all events in order without one task that sorts them all.

Events are dealt to buckets of the order's first column, cut at its quantiles, so that a
burst has as many buckets as its events ask for. A window inside a bucket does most of the
work; what a bucket needs of those before it (its predecessor's last row, the sum so far)
comes from a table with a row for each bucket that has events, which alone is ordered as a whole.
Columns that are added on the way have names that no column of the input has.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.kernels import _count_up_to

#: Rows of a bucket, about, and most buckets.
ROWS, MOST_BUCKETS = 200_000, 1 << 16
ORDER = ("days", "id")


def fresh(*stems: str) -> list[str]:
    """Column names that no input has."""
    tag = uuid.uuid4().hex[:12]
    return [f"_{s}_{tag}" for s in stems]


def cuts_of(df: DataFrame, value: Column, rows: int = ROWS) -> list[float]:
    """Quantiles of ``value`` between buckets of about ``rows`` rows; none where one bucket is enough."""
    n = df.count()
    if n <= rows:
        return []
    k = min(MOST_BUCKETS, math.ceil(n / rows))
    at = df.agg(F.percentile_approx(value.cast("double"), [i / k for i in range(1, k)], 100 * k)).head()[0]
    return sorted(set(at or []))


def with_previous(df: DataFrame, columns: dict[str, Column], order: tuple[str, ...] = ORDER, rows: int = ROWS) -> DataFrame:
    """``df`` with each of ``columns`` (new name: expression) of the event before, in ``order``; the first event has null."""
    bucket, place, at = fresh("bucket", "row", "b")
    values, lasts, befores = (dict(zip(columns, fresh(*[f"{kind}{i}" for i in range(len(columns))]))) for kind in "vlp")
    cuts = cuts_of(df, F.col(order[0]), rows)
    own = W.partitionBy(bucket).orderBy(*order)
    dealt = df.withColumns({bucket: _count_up_to(F.col(order[0]), cuts) if cuts else F.lit(0)} | {values[n]: c for n, c in columns.items()})
    lagged = {n: F.lag(values[n]).over(own) for n in columns}
    if not cuts:
        return dealt.withColumns(lagged).drop(bucket, *values.values())
    last = dealt.groupBy(bucket).agg(*[F.max_by(values[n], F.struct(*order)).alias(lasts[n]) for n in columns])
    over = W.orderBy(bucket)
    before = last.select(F.col(bucket).alias(at), *[F.lag(lasts[n]).over(over).alias(befores[n]) for n in columns])
    dealt = dealt.withColumn(place, F.row_number().over(own)).withColumns(lagged).join(before, F.col(bucket) == F.col(at))
    dealt = dealt.withColumns({n: F.when(F.col(place) == 1, F.col(befores[n])).otherwise(F.col(n)) for n in columns})
    return dealt.drop(bucket, place, at, *values.values(), *befores.values())


def with_running_sum(df: DataFrame, value: Column, out: str, group: list[str] | None = None, order: tuple[str, ...] = ORDER, rows: int = ROWS, cuts: list[float] | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over all events up to each one, in ``order``, in each ``group``."""
    group = group or []
    bucket, v, s, at, so_far, own_sum = fresh("bucket", "v", "s", "b", "before", "own")
    keys = dict(zip(group, fresh(*[f"g{i}" for i in range(len(group))])))
    cuts = cuts_of(df, F.col(order[0]), rows) if cuts is None else cuts
    dealt = df.withColumns({bucket: _count_up_to(F.col(order[0]), cuts) if cuts else F.lit(0), v: value})
    own = W.partitionBy(*group, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    if not cuts:
        return dealt.withColumn(out, F.sum(v).over(own)).drop(bucket, v)
    sums = dealt.groupBy(*group, bucket).agg(F.sum(v).alias(s))
    over = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    before = sums.select(*[F.col(g).alias(k) for g, k in keys.items()], F.col(bucket).alias(at), F.coalesce(F.sum(s).over(over), F.lit(0)).alias(so_far))
    same = F.col(bucket) == F.col(at)
    for g, k in keys.items():
        same = same & F.col(g).eqNullSafe(F.col(k))
    dealt = dealt.withColumn(own_sum, F.sum(v).over(own)).join(before, same)
    return dealt.withColumn(out, F.col(own_sum) + F.col(so_far)).drop(bucket, v, at, so_far, own_sum, *keys.values())


def with_rank(df: DataFrame, out: str, order: tuple[str, ...] = ORDER, rows: int = ROWS) -> DataFrame:
    """``df`` with its place in ``order``, from 1."""
    return with_running_sum(df, F.lit(1).cast("long"), out, order=order, rows=rows)


def with_trailing_count(df: DataFrame, condition: Column, span_days: float, out: str, rows: int = ROWS) -> DataFrame:
    """``df`` with the number of events that meet ``condition`` in the ``span_days`` before each one, its own instant left out.

    An event that counts enters after its own instant and leaves after the last instant
    that it counts for, so the number is one running sum over events, entries and exits.
    """
    at, late, delta = fresh("at", "late", "delta")
    span = int(round(span_days * 86_400_000_000))
    micros = F.floor(F.col("days") * F.lit(86400e6) + 0.5).cast("long")
    cuts = cuts_of(df, micros, rows)
    spot = lambda shift, n: F.struct((micros + shift).alias(at), F.lit(1).alias(late), F.lit(n).cast("long").alias(delta))
    marks = df.filter(F.coalesce(condition, F.lit(False))).select(F.explode(F.array(spot(0, 1), spot(span, -1))).alias("m")).select("m.*")
    both = df.withColumns({at: micros, late: F.lit(0), delta: F.lit(0).cast("long")}).unionByName(marks, allowMissingColumns=True)
    return with_running_sum(both, F.col(delta), out, order=(at, late), cuts=cuts).filter(F.col(late) == 0).drop(at, late, delta)
