"""Magnitude statistics, histograms, curves, ensemble summaries, and tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.kernels import binned
from ..functions.rng import uniform
from ..functions.special import kolmogorov_p_of
from .ordered import fresh, with_previous, with_running_sum


def beta_tinti(mean_excess: Column, delta_m: float) -> Column:
    """Tinti and Mulargia's estimate from the mean magnitude above completeness (not halved by the bin)."""
    return F.log(1 + F.lit(delta_m) / mean_excess) / F.lit(delta_m) if delta_m else 1 / mean_excess


def mean_of(x: Column, weight: Column | None = None) -> Column:
    return F.avg(x) if weight is None else F.try_divide(F.sum(x * weight), F.sum(weight))


def estimate_beta(df: DataFrame, mc: float, delta_m: float = 0.1, weight: str | None = None) -> DataFrame:
    """One row: ``n`` and ``beta`` of magnitudes at or above ``mc``."""
    df = df.filter(F.col("magnitude") >= mc - delta_m / 2)
    return df.agg(F.count(F.lit(1)).alias("n"), beta_tinti(mean_of(F.col("magnitude") - mc, None if weight is None else F.col(weight)), delta_m).alias("beta"))


def increments(df: DataFrame) -> DataFrame:
    """Events with ``step``, the magnitude less that of the event before it in time."""
    return with_previous(df, {"step": F.col("magnitude")}).withColumn("step", F.col("magnitude") - F.col("step"))


def estimate_beta_positive(df: DataFrame, delta_m: float = 0.1) -> DataFrame:
    """One row: ``n`` and ``beta`` of the positive steps between consecutive events."""
    steps = increments(df).withColumn("step", binned(F.col("step"), delta_m)).filter("step > 0")
    return steps.agg(F.count(F.lit(1)).alias("n"), beta_tinti(F.avg(F.col("step") - delta_m), delta_m).alias("beta"))


def ecdf(df: DataFrame, value: str, weight: Column | None = None) -> DataFrame:
    """(x, cdf): one row for each distinct value, the weighted share of values up to it.

    Sums by value come first; the running sum over values goes by buckets of them.
    """
    sums = df.groupBy(F.col(value).alias("x")).agg(F.sum(F.lit(1.0) if weight is None else weight).alias("w"))
    whole = sums.agg(F.sum("w").alias("whole"))
    return with_running_sum(sums, F.col("w"), "up_to", order=("x",)).join(F.broadcast(whole)).select("x", (F.col("up_to") / F.col("whole")).alias("cdf"))


def quantiles(df: DataFrame, value: str, at: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """(q, value) of the positive values, interpolated."""
    v = F.when(F.col(value) > 0, F.col(value).cast("double"))
    return df.agg(F.percentile(v, list(at)).alias("v")).select(F.explode(F.arrays_zip(F.array(*[F.lit(a) for a in at]).alias("q"), F.col("v").alias("value"))).alias("r")).select("r.q", "r.value")


def gr_cdf(x: Column, beta: Column, mc: float, delta_m: float) -> Column:
    """Discrete Gutenberg-Richter distribution at a bin."""
    return 1 - F.exp(-beta * (x - mc + delta_m))


def gr_fit(df: DataFrame, mc: float, delta_m: float = 0.1) -> DataFrame:
    """(x, fitted) on all bins from ``mc`` to the largest magnitude."""
    fit = df.filter(F.col("magnitude") >= mc - delta_m / 2).agg(F.max("magnitude").alias("top"), beta_tinti(F.avg(F.col("magnitude") - mc), delta_m).alias("beta"))
    bins = fit.select("beta", F.explode(F.sequence(F.lit(0), F.floor((F.col("top") - mc) / delta_m + 0.5).cast("int"))).alias("k"))
    return bins.select((F.lit(mc) + F.col("k") * F.lit(delta_m)).alias("x"), (1 - F.exp(-F.col("beta") * delta_m * (F.col("k") + 1))).alias("fitted"))


def _bin(mc: float, delta_m: float) -> Column:
    return F.floor((F.col("magnitude") - mc) / delta_m + 0.5).cast("int")


def ks_gr(df: DataFrame, mc: float, delta_m: float = 0.1) -> DataFrame:
    """One row: KS distance of binned magnitudes to the fitted law, over the bins from ``mc`` to the largest.

    Between bins that have events the empirical distribution is interpolated, and before
    the first of them it is that bin's.
    """
    events = df.filter(F.col("magnitude") >= mc - delta_m / 2)
    counts = events.groupBy(_bin(mc, delta_m).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    bins = counts.agg(F.max("k").alias("top"), F.sum("n").alias("all"), F.log(1 + F.sum("n") / F.sum(F.col("n") * F.col("k"))).alias("rate"))
    grid = bins.select("all", "rate", F.explode(F.sequence(F.lit(0), "top")).alias("k")).join(counts, "k", "left")
    up_to = W.orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    grid = grid.withColumn("y", F.when(F.col("n") > 0, F.sum(F.coalesce("n", F.lit(0))).over(up_to) / F.col("all")))
    known, ahead = F.when(F.col("y").isNotNull(), F.col("k")), W.orderBy("k").rowsBetween(0, W.unboundedFollowing)
    grid = grid.withColumns({"k0": F.last(known, ignorenulls=True).over(up_to), "y0": F.last("y", ignorenulls=True).over(up_to), "k1": F.first(known, ignorenulls=True).over(ahead), "y1": F.first("y", ignorenulls=True).over(ahead)})
    seen = F.when(F.col("k0").isNull(), F.col("y1")).when(F.col("k1") > F.col("k0"), F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("k") - F.col("k0")) / (F.col("k1") - F.col("k0"))).otherwise(F.col("y0"))
    return grid.select(F.abs(seen - (1 - F.exp(-F.col("rate") * (F.col("k") + 1)))).alias("d"), "all").agg(F.max("d").alias("ks_d"), F.max("all").alias("n"))


def _ks_of_counts(counts: np.ndarray, rate: float) -> float:
    """``ks_gr`` of counts by bin."""
    k = np.flatnonzero(counts)
    y = np.cumsum(counts)[k] / counts.sum()
    at = np.arange(k[-1] + 1)
    return float(np.abs(np.interp(at, k, y) + np.expm1(-rate * (at + 1))).max())


def estimate_mc(df: DataFrame, mcs: list[float], delta_m: float = 0.1, p_pass: float = 0.05, samples: int = 10_000, seed: int = 1905, beta: float | None = None) -> tuple[DataFrame, float | None]:
    """(rows (mc, ks_d, p, n, beta, chosen) of every candidate, first mc that passes).

    ``p`` is the share of samples of the fitted law at least as far from it as the events are.
    The catalog is read once, for its counts by bin; these (a few hundred numbers) serve all
    candidates. Samples are drawn as counts by bin as well, so their cost does not depend on
    the catalog's size. Fewer than two distinct magnitudes have distance 1 and p 0.
    """
    spark, low = df.sparkSession, min(mcs)
    counts = {r.k: r.n for r in df.filter(F.col("magnitude") >= low - delta_m / 2).groupBy(_bin(low, delta_m).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    held = np.zeros(max(counts, default=0) + 1, np.int64)
    for k, n in counts.items():
        held[k] = n
    found = []
    for i, mc in enumerate(mcs):
        own = held[int(math.floor((mc - low) / delta_m + 0.5)) :]
        n = int(own.sum())
        if np.count_nonzero(own) < 2:
            found.append((i, float(mc), 1.0, n, None))
            continue
        rate = math.log1p(n / float((own * np.arange(len(own))).sum())) if beta is None else beta * delta_m
        found.append((i, float(mc), _ks_of_counts(own, rate), n, rate / delta_m))
    base = spark.createDataFrame(found, "i int, mc double, ks_d double, n long, beta double")

    def simulate(batches):
        for b in batches:
            far = []
            for i, draw, d, n, rate in zip(*(b[c] for c in ("i", "draw", "ks_d", "n", "beta"))):
                if rate != rate or rate is None:
                    far.append(0)
                    continue
                rate, rng = rate * delta_m, np.random.default_rng([seed, int(i), int(draw)])
                k = np.arange(max(1, math.ceil(40 / rate)))
                drawn = rng.multinomial(n, -np.expm1(-rate) * np.exp(-rate * k), size=DRAWS)
                y = np.cumsum(drawn, axis=1) / n
                gap = np.where(drawn > 0, np.abs(y + np.expm1(-rate * (k + 1))), 0.0).max(axis=1)
                far.append(int((gap >= d).sum()))
            yield pd.DataFrame({"i": b.i, "far": far})

    draws = math.ceil(samples / DRAWS)
    tasks = base.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).repartition(max(1, min(draws * len(mcs), 4 * spark.sparkContext.defaultParallelism)))
    far = tasks.mapInPandas(simulate, "i int, far long").groupBy("i").agg((F.sum("far") / F.lit(float(draws * DRAWS))).alias("p"))
    rows = base.join(far, "i")
    got = {r.i: r.p for r in rows.select("i", "p").collect()}  # a row a candidate
    passed = [i for i in range(len(mcs)) if got[i] >= p_pass]
    result = spark.createDataFrame([(mc, d, got[i], n, b, passed[:1] == [i]) for i, mc, d, n, b in found], "mc double, ks_d double, p double, n long, beta double, chosen boolean")
    return result, (float(mcs[passed[0]]) if passed else None)


#: Samples drawn at a time.
DRAWS = 250


def ks_gr_p(df: DataFrame, mc: float, delta_m: float = 0.1, samples: int = 10_000, seed: int = 1905) -> DataFrame:
    """One row: ``ks_d``, ``p`` and ``n`` at one completeness."""
    return estimate_mc(df, [mc], delta_m, samples=samples, seed=seed)[0].select("ks_d", "p", "n")


def histogram(df: DataFrame, value: Column, lo: float, step: float, bins: int, weight: Column | None = None, slack: float = 0.0) -> DataFrame:
    """(bin, total, density): ``bins`` bins from ``lo``; the last one is closed, values outside are left out.

    Values less than ``slack`` bins below a bin's edge are in that bin: for values that lie on edges but for rounding.
    """
    end = lo + step * bins
    k = F.when(F.abs(value - end) <= slack * step, bins - 1).otherwise(F.floor((value - lo) / step + slack)).cast("int")
    sums = df.select(k.alias("bin"), (F.lit(1.0) if weight is None else weight).alias("w")).filter(F.col("bin").between(0, bins - 1)).groupBy("bin").agg(F.sum("w").alias("total"))
    return sums.withColumn("density", F.col("total") / (F.sum("total").over(W.partitionBy()) * step))


def survival(df: DataFrame, width: float = 0.1) -> DataFrame:
    """(magnitude, n_at_least): events at least as large as each bin that has any."""
    counts = df.groupBy(binned(F.col("magnitude"), width).alias("magnitude")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("magnitude", F.sum("n").over(W.orderBy(F.desc("magnitude")).rowsBetween(W.unboundedPreceding, 0)).alias("n_at_least"))


def interevent(df: DataFrame) -> DataFrame:
    """Events with ``gap_days`` since the one before; the first has none and goes."""
    return with_previous(df, {"gap_days": F.col("days")}).withColumn("gap_days", F.col("days") - F.col("gap_days")).filter("gap_days IS NOT NULL")


def cumulative_on_grid(df: DataFrame, start: float, end: float, points: int, group: list[str] | None = None) -> DataFrame:
    """(t, n): events up to each of ``points`` equally spaced times, by counts of grid cells."""
    group, step = group or [], (end - start) / (points - 1)
    k = F.greatest(F.lit(0), F.ceil((F.col("days") - start) / step)).cast("int")
    counts = df.filter(F.col("days") <= end).groupBy(*group, k.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    keys = df.select(*group).distinct() if group else df.sparkSession.range(1).select()
    grid = keys.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    rows = grid.join(counts, [*group, "k"], "left")
    n = F.sum(F.coalesce("n", F.lit(0))).over(W.partitionBy(*group).orderBy("k").rowsBetween(W.unboundedPreceding, 0))
    return rows.select(*group, (F.lit(start) + F.col("k") * step).alias("t"), n.alias("n"))


def band(curves: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, sample deviation and quartiles of an ensemble at each point."""
    v = F.col(value).cast("double")
    return curves.groupBy(key).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.percentile(v, 0.25).alias("q25"), F.percentile(v, 0.75).alias("q75"))


def realization_metrics(df: DataFrame, key: str = "seed") -> DataFrame:
    """Counts by origin, median delay and largest magnitude of each realisation (``m``, ``dt_days``, ``event_source``)."""
    background, triggered = F.count_if(F.col("event_source") == "background"), F.count_if(F.col("event_source") == "triggered")
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_events"), background.alias("background"), triggered.alias("triggered"), F.median("dt_days").alias("median_dt_days"), F.max("m").alias("max_magnitude"), F.try_divide(triggered.cast("double"), background.cast("double")).alias("ratio"))


def summary(df: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, mean, std, median, min, max) over realisations, nulls left out."""
    long = df.select(*[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([], metrics, "metric", "v")
    return long.filter("v IS NOT NULL").groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.median("v").alias("median"), F.min("v").alias("min"), F.max("v").alias("max"))


def daily_counts(df: DataFrame) -> DataFrame:
    """(day, n) of every day from the first to the last event, empty ones with 0."""
    day = F.floor("days").cast("long")
    counts = df.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    span = counts.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return span.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def moving_average(df: DataFrame, value: str, order: str, width: int) -> DataFrame:
    """Centred mean of ``width`` rows, of fewer at the ends; an even width looks back one further."""
    return df.withColumn("smooth", F.avg(value).over(W.orderBy(order).rowsBetween(-(width // 2), (width - 1) // 2)))


def counts_since(df: DataFrame, boundaries: list[float]) -> DataFrame:
    """Events with ``segment`` (boundaries up to their time) and ``count``, which starts anew at each boundary."""
    segment = F.size(F.filter(F.array(*[F.lit(float(b)) for b in boundaries]), lambda b: b <= F.col("days")))
    return with_running_sum(df.withColumn("segment", segment), F.lit(1), "count", ["segment"])


def trapezoid(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: the integral of a curve."""
    w = W.orderBy(x)
    step = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return df.select(step.alias("s")).agg(F.sum("s").alias("integral"))


def poisson_scores(train_n: Column, train_days: float, test_n: Column, test_days: float, area: float) -> dict[str, Column]:
    """Negative, temporal and spatial log likelihood of an event under a constant rate."""
    rate = train_n / F.lit(area * train_days)
    own = F.lit(area * test_days) * rate / test_n
    nll, tll = own - F.log(rate), F.log(rate * area) - own
    return {"nll": nll, "tll": tll, "sll": -nll - tll}


def event_key(days: Column, lat: Column, lon: Column, m: Column) -> Column:
    """Rounded composite key: whole seconds, five and three decimals."""
    r = lambda x, n: F.floor(x * F.lit(10.0**n) + 0.5).cast("long")
    return F.concat_ws("|", F.floor(days * 86400 + 0.5).cast("long"), r(lat, 5), r(lon, 5), r(m, 3))


def ks_two_samples(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """One row (ks_d, n1, n2, p): KS statistic, sizes and asymptotic p of two samples, from counts by distinct value."""
    both = a.select(F.col(value).alias("x"), F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).union(b.select(value, F.lit(0), F.lit(1)))
    sums = both.groupBy("x").agg(F.sum("in_a").alias("a"), F.sum("in_b").alias("b"))
    whole = sums.agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    ran = with_running_sum(sums.join(F.broadcast(whole)), F.col("a") / F.col("n1") - F.col("b") / F.col("n2"), "gap", order=("x",))
    out = ran.agg(F.max(F.abs("gap")).alias("ks_d"), F.max("n1").alias("n1"), F.max("n2").alias("n2"))
    return out.withColumn("p", kolmogorov_p_of(F.col("ks_d"), F.col("n1"), F.col("n2")))


def ks_by_seed(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, ks_d, n1, n2, p) of the two samples of each realisation that both have."""
    both = a.select(key, F.col(value).alias("x"), F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).union(b.select(key, value, F.lit(0), F.lit(1)))
    sums = both.groupBy(key, "x").agg(F.sum("in_a").alias("a"), F.sum("in_b").alias("b"))
    w, all_ = W.partitionBy(key).orderBy("x").rowsBetween(W.unboundedPreceding, 0), W.partitionBy(key)
    d = F.abs(F.sum("a").over(w) / F.sum("a").over(all_) - F.sum("b").over(w) / F.sum("b").over(all_))
    out = sums.select(key, d.alias("d"), F.sum("a").over(all_).alias("n1"), F.sum("b").over(all_).alias("n2")).filter("n1 > 0 AND n2 > 0")
    out = out.groupBy(key).agg(F.max("d").alias("ks_d"), F.max("n1").alias("n1"), F.max("n2").alias("n2"))
    return out.withColumn("p", kolmogorov_p_of(F.col("ks_d"), F.col("n1"), F.col("n2")))


def signed_rank(df: DataFrame, difference: str) -> DataFrame:
    """One row (w_plus, w_minus, n, z): Wilcoxon's rank sums of paired differences (zeros left out, ties at their mean rank).

    ``z`` is the normal approximation's value of the smaller sum, ties accounted for; ``special.normal_p`` gives its p.
    """
    sizes = df.filter(F.col(difference) != 0).withColumn("size", F.abs(difference))
    ties = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col(difference) > 0).alias("up"))
    reach = with_running_sum(ties, F.col("k"), "reach", order=("size",))
    ranked = reach.select((F.col("reach") - F.col("k") + (F.col("k") + 1) / 2).alias("r"), "k", "up")
    k, n = F.col("k").cast("double"), F.col("n").cast("double")
    sums = ranked.agg(F.sum(F.col("r") * F.col("up")).alias("w_plus"), F.sum(F.col("r") * (F.col("k") - F.col("up"))).alias("w_minus"), F.sum("k").alias("n"), F.sum(k * k * k - k).alias("tied"))
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tied") / 48)
    return sums.select("w_plus", "w_minus", "n", F.try_divide(F.least("w_plus", "w_minus") - n * (n + 1) / 4, spread).alias("z"))


#: Differences that all tasks of a sign-flip test may hold (16 bytes each).
HELD_DIFFERENCES = 20_000


def sign_flips(df: DataFrame, key: str, difference: str, draws: int = 5000, seed: int = 1905) -> DataFrame:
    """One row: mean paired difference and the share of ``draws`` random sign patterns with a mean at least as far from 0.

    Draws are spread over tasks, each of which holds the differences if there are at most ``HELD_DIFFERENCES``; more are
    spread themselves, and summed by draw.
    """
    spark = df.sparkSession
    own = df.select(F.col(key).alias("k"), F.col(difference).cast("double").alias("d")).filter("d IS NOT NULL")
    sign = lambda draw, k: F.when(uniform(seed, draw, k) < 0.5, -1.0).otherwise(1.0)
    if own.count() <= HELD_DIFFERENCES:
        held = own.agg(F.collect_list(F.struct("k", "d")).alias("held"), F.avg("d").alias("mean")).filter("mean IS NOT NULL")
        spread = spark.range(0, draws, 1, max(1, min(draws, 4 * spark.sparkContext.defaultParallelism))).withColumnRenamed("id", "draw")
        means = spread.join(F.broadcast(held)).withColumn("m", F.aggregate("held", F.lit(0.0), lambda a, x: a + x.d * sign(F.col("draw"), x.k)) / F.size("held"))
    else:
        flips = own.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
        means = flips.groupBy("draw").agg(F.avg(F.col("d") * sign(F.col("draw"), F.col("k"))).alias("m")).join(F.broadcast(own.agg(F.avg("d").alias("mean"))))
    return means.agg(F.max("mean").alias("mean"), F.avg((F.abs("m") >= F.abs("mean") - 1e-12).cast("double")).alias("p"))


def expected_rates(df: DataFrame, catalogs: int, cell_deg: float = 0.5, width: float = 0.5) -> DataFrame:
    """(row, col, mag_bin, rate): mean events of a realisation in each cell of space and magnitude."""
    cell = lambda c, w: F.floor(F.col(c) / w).cast("int")
    return df.groupBy(cell("latitude", cell_deg).alias("row"), cell("longitude", cell_deg).alias("col"), cell("magnitude", width).alias("mag_bin")).agg((F.count(F.lit(1)) / F.lit(float(catalogs))).alias("rate"))


def number_test(simulated: DataFrame, observed: Column | int, count: str = "n") -> DataFrame:
    """CSEP's N test: shares of simulated counts at least, and at most, the observed one."""
    o = F.lit(observed) if isinstance(observed, int) else observed
    return simulated.agg(F.avg((F.col(count) >= o).cast("double")).alias("delta1"), F.avg((F.col(count) <= o).cast("double")).alias("delta2"))


def _quantile(simulated: DataFrame, observed: DataFrame, name: str) -> DataFrame:
    """Share of simulated statistics at most the observed one; what differs by the rounding of sums only is equal."""
    o = F.col("_o")
    reach = F.when(F.abs(o) == math.inf, o).otherwise(o + F.greatest(F.lit(1.0), F.abs(o)) * 1e-12)
    return simulated.join(F.broadcast(observed.select(F.col(name).alias("_o")))).agg(F.avg((F.col(name) <= reach).cast("double")).alias("quantile"), F.max("_o").alias("observed"))


def magnitude_test(simulated: DataFrame, observed: DataFrame, width: float = 0.5) -> DataFrame:
    """CSEP's M test: squared log distance of each catalog's magnitude counts, scaled to the observed number, to the union's."""
    k = F.floor(F.col("magnitude") / width).cast("int")
    union = simulated.groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("u"))
    scale = union.agg(F.sum("u").alias("all")).join(observed.agg(F.count(F.lit(1)).alias("n_obs")))
    union = union.join(F.broadcast(scale)).select("k", (F.col("u") * F.col("n_obs") / F.col("all")).alias("lam"), "n_obs")

    def distance(df: DataFrame, keys: list[str]) -> DataFrame:
        counts = df.groupBy(*keys, k.alias("k")).agg(F.count(F.lit(1)).alias("n"))
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
        cells = sizes.join(F.broadcast(union)).join(counts, [*keys, "k"], "left")
        gap = F.log10(F.col("lam") + 1) - F.log10(F.coalesce("n", F.lit(0)) * F.col("n_obs") / F.col("size") + 1)
        return cells.groupBy(*keys).agg(F.sum(gap * gap).alias("d"))

    return _quantile(distance(simulated, ["catalog_id"]), distance(observed.withColumn("catalog_id", F.lit(-1)), ["catalog_id"]), "d")


def spatial_test(simulated: DataFrame, observed: DataFrame, catalogs: int, cell_deg: float = 0.5, normalized: bool = True) -> DataFrame:
    """CSEP's S test (mean log share of the expected rates at a catalog's events) or, not normalised, the pseudo-likelihood test.

    An event in a cell without expected events has likelihood 0, so its catalog's statistic is -infinity.
    """
    row, col = (F.floor(F.col(c) / cell_deg).cast("int") for c in ("latitude", "longitude"))
    rates = simulated.groupBy(row.alias("r"), col.alias("c")).agg((F.count(F.lit(1)) / F.lit(float(catalogs))).alias("rate"))
    total = rates.agg(F.sum("rate").alias("total"))

    def statistic(df: DataFrame) -> DataFrame:
        events = df.withColumns({"r": row, "c": col}).join(rates.select("r", "c", "rate"), ["r", "c"], "left").join(F.broadcast(total))
        log = lambda x: F.coalesce(F.log(x), F.lit(-math.inf))
        if normalized:
            return events.groupBy("catalog_id").agg(F.avg(log(F.col("rate") / F.col("total"))).alias("l"))
        return events.groupBy("catalog_id").agg((F.sum(log(F.col("rate"))) - F.max("total")).alias("l"))

    return _quantile(statistic(simulated), statistic(observed.withColumn("catalog_id", F.lit(-1))), "l")


def density_on_grid(df: DataFrame, value: str, bandwidth: float, lo: float, hi: float, points: int) -> DataFrame:
    """Gaussian kernel density (x, density) at ``points`` places; values are first counted in tenths of the bandwidth, and reach eight bandwidths."""
    width = bandwidth / 10
    counts = df.groupBy(F.floor(F.col(value) / width + 0.5).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    near = math.ceil(8 * bandwidth / ((hi - lo) / (points - 1)))
    step = (hi - lo) / (points - 1)
    middle = F.floor((F.col("k") * width - lo) / step).cast("int")
    spots = counts.withColumn("i", F.explode(F.sequence(F.greatest(F.lit(0), middle - near), F.least(F.lit(points - 1), middle + near + 1)))).filter(F.col("i").between(0, points - 1))
    z = (F.lit(lo) + F.col("i") * step - F.col("k") * width) / bandwidth
    mass = spots.groupBy("i").agg(F.sum(F.col("n") * F.exp(-z * z / 2)).alias("mass")).join(F.broadcast(counts.agg(F.sum("n").alias("all"))))
    every = df.sparkSession.range(points).select(F.col("id").cast("int").alias("i"))
    density = F.col("mass") / F.col("all") / (bandwidth * math.sqrt(2 * math.pi))
    return every.join(mass, "i", "left").select((F.lit(lo) + F.col("i") * step).alias("x"), F.coalesce(density, F.lit(0.0)).alias("density"))


def density_2d(df: DataFrame, bandwidth: float, lat: tuple[float, float, int], lon: tuple[float, float, int]) -> DataFrame:
    """Gaussian kernel density (row, col, density) of places at a grid's nodes ((low, high, nodes) of each axis), in degrees.

    Places are first counted in tenths of the bandwidth; a count reaches the nodes within eight bandwidths.
    """
    width = bandwidth / 10
    k = lambda c: F.floor(F.col(c) / width + 0.5)
    counts = df.groupBy(k("latitude").alias("y"), k("longitude").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    spots = counts
    for name, at, (lo, hi, nodes) in (("row", "y", lat), ("col", "x", lon)):
        step = (hi - lo) / (nodes - 1)
        near, middle = math.ceil(8 * bandwidth / step), F.floor((F.col(at) * width - lo) / step).cast("int")
        spots = spots.withColumn(name, F.explode(F.sequence(F.greatest(F.lit(0), middle - near), F.greatest(F.greatest(F.lit(0), middle - near), F.least(F.lit(nodes - 1), middle + near + 1))))).filter(F.col(name).between(0, nodes - 1))
    z = lambda name, at, axis: (F.lit(axis[0]) + F.col(name) * ((axis[1] - axis[0]) / (axis[2] - 1)) - F.col(at) * width) / bandwidth
    zy, zx = z("row", "y", lat), z("col", "x", lon)
    mass = spots.groupBy("row", "col").agg(F.sum(F.col("n") * F.exp(-(zy * zy + zx * zx) / 2)).alias("mass")).join(F.broadcast(counts.agg(F.sum("n").alias("all"))))
    nodes = df.sparkSession.range(lat[2] * lon[2]).select(F.expr(f"cast(id div {lon[2]} as int)").alias("row"), (F.col("id") % lon[2]).cast("int").alias("col"))
    density = F.col("mass") / F.col("all") / (2 * math.pi * bandwidth**2)
    return nodes.join(mass, ["row", "col"], "left").select("row", "col", F.coalesce(density, F.lit(0.0)).alias("density"))


def magnitude_counts(df: DataFrame, mc: float, beta: float, width: float = 0.25) -> DataFrame:
    """(bin, n, expected): events by magnitude bin from ``mc`` to the largest, and as the magnitude law shares them out."""
    events = df.filter(F.col("magnitude") >= mc)
    counts = events.groupBy(F.floor((F.col("magnitude") - mc) / width).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("all"), F.max("bin").alias("top"))
    bins = whole.select("all", F.explode(F.sequence(F.lit(0), "top")).alias("bin")).join(counts, "bin", "left")
    above = lambda k: F.exp(F.lit(-beta * width) * k)
    return bins.select("bin", F.coalesce("n", F.lit(0)).alias("n"), (F.col("all") * (above(F.col("bin")) - above(F.col("bin") + 1))).alias("expected"))


def time_bins(df: DataFrame, start: float, end: float, bins: int) -> DataFrame:
    """(bin, n) of equal parts of a window, empty ones with 0; the last one has its right edge."""
    step = (end - start) / bins
    counts = histogram(df, F.col("days"), start, step, bins).select("bin", F.col("total").cast("long").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def median_gap(df: DataFrame) -> DataFrame:
    """One row (n, median): the positive steps between consecutive events, in days."""
    gaps = interevent(df).filter("gap_days > 0")
    return gaps.agg(F.count(F.lit(1)).alias("n"), F.median("gap_days").alias("median"))


def marginal_rates(rates: DataFrame, *by: str) -> DataFrame:
    """``expected_rates`` summed over all but the columns ``by``."""
    return rates.groupBy(*by).agg(F.sum("rate").alias("rate"))


def curve_distance(a: DataFrame, b: DataFrame, x: str, y: str) -> DataFrame:
    """One row (l2, most, mean): root of the integrated squared difference, largest and mean absolute difference of two curves on one grid."""
    both = a.select(x, F.col(y).alias("u")).join(b.select(x, F.col(y).alias("v")), x).select(x, (F.col("u") - F.col("v")).alias("gap"))
    w = W.orderBy(x)
    square = F.col("gap") * F.col("gap")
    step = (F.col(x) - F.lag(x).over(w)) * (square + F.lag(square).over(w)) / 2
    return both.select("gap", step.alias("step")).agg(F.sqrt(F.sum("step")).alias("l2"), F.max(F.abs("gap")).alias("most"), F.avg(F.abs("gap")).alias("mean"))


def mean_curve(curves: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y): the mean over realisations at each point."""
    return curves.groupBy(x).agg(F.avg(F.col(y).cast("double")).alias(y))


def seed_pairs(metrics: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """(seed, a, b, difference) of the seeds that both methods (column ``method``) have."""
    left = metrics.filter(F.col("method") == a).select("seed", F.col(value).alias("a"))
    right = metrics.filter(F.col("method") == b).select("seed", F.col(value).alias("b"))
    return left.join(right, "seed").withColumn("difference", (F.col("a") - F.col("b")).cast("double"))


def common_keys(*frames: DataFrame) -> DataFrame:
    """Rows that every frame has, once each."""
    out = frames[0].distinct()
    for f in frames[1:]:
        out = out.intersect(f)
    return out


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of each distinct value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def distinct_values(df: DataFrame, column: str, *by: str) -> DataFrame:
    """``by``, distinct non-null values of ``column``, and rows."""
    return df.groupBy(*by).agg(F.count_distinct(column).alias("distinct"), F.count(F.lit(1)).alias("n"))


def trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (slope, intercept, r): least squares of ``y`` on ``x``, and Pearson's correlation."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r"))


def described(df: DataFrame, value: str, *by: str) -> DataFrame:
    """(n, mean, std, min, q25, median, q75, max) of a column's values by group."""
    v = F.col(value).cast("double")
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.percentile(v, 0.25).alias("q25"), F.percentile(v, 0.5).alias("median"), F.percentile(v, 0.75).alias("q75"), F.max(v).alias("max"))


def grid_spacing(df: DataFrame, *columns: str) -> DataFrame:
    """One row: the least step between distinct values of each of ``columns`` (null with one value)."""
    out = None
    for c in columns:
        values = df.select(F.col(c).alias("x")).filter("x IS NOT NULL").distinct()
        step = with_previous(values, {"before": F.col("x")}, order=("x",)).agg(F.min(F.col("x") - F.col("before")).alias(c))
        out = step if out is None else out.join(step)
    return out


def group_shares(df: DataFrame, weight: Column, out: str, *by: str) -> DataFrame:
    """``df`` with ``out``, the weight's share of its group; the groups' sums are joined, so a large group is no single task."""
    names = fresh("whole", *[f"k{i}" for i in range(len(by))])
    whole = df.groupBy(*[F.col(b).alias(n) for b, n in zip(by, names[1:])]).agg(F.sum(weight).alias(names[0]))
    same = F.lit(True)
    for b, n in zip(by, names[1:]):
        same = same & F.col(b).eqNullSafe(F.col(n))
    return df.withColumn(out, weight).join(whole, same).withColumn(out, F.try_divide(F.col(out), F.col(names[0]))).drop(*names)


def first_after(df: DataFrame, start: float, n: int, by: str) -> DataFrame:
    """The first ``n`` events after ``start`` of each realisation ``by``.

    Bounded heaps of the smallest (days, id) would do; a window by realisation has as many rows a task as a realisation has.
    """
    w = W.partitionBy(by).orderBy("days", "id")
    return df.filter(F.col("days") > start).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def grid_node_at_or_after(x: Column, lo: float, step: float, nodes: int) -> Column:
    """Index of the first node at or after a value, held in 0 to ``nodes`` - 1."""
    return F.greatest(F.lit(0), F.least(F.lit(nodes - 1), F.ceil((x - F.lit(lo)) / F.lit(step)))).cast("int")
