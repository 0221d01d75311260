"""Expectation-maximisation of the parameters over the pair table.

The pair table is written once, in buckets of targets, and read by every step without an
exchange. An expectation step is one window over targets, whose rows an iteration writes once,
and two sums of them. A maximisation step reduces pairs and sources to one value and gradient
per evaluation, which has a closed form in all parameters but omega, so the driver
holds a dozen numbers; ``information`` adds the curvature, and standard errors from it.

Where one expectation is all that is asked for, the sums come without a table of pairs
(``expected_targets``, ``expected_sources``, ``weighted_sums``): pairs are made twice, once for the
targets' totals and once for what depends on them, and leave no task.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property, lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.kernels import RANGES, Theta
from ..functions.params import productivity_law
from ..functions.special import gammaln, tapered_time_integral
from ..operators.filters import complete, in_hull, in_region, lowered_reference
from ..operators.nearsums import Arrays, Near, added, near_sums
from ..operators.pairs import later_pairs, pair_table, reach_of
from ..operators.stats import estimate_beta, estimate_beta_positive
from ..sources.stage import dealt, materialized, released


@dataclass
class Setup:
    """What a fit needs besides the catalog; times are days since 1970."""

    start: float
    end: float
    area_km2: float
    m_ref: float = 2.5
    delta_m: float = 0.1
    mc: float | str = 2.5
    multiplier: float = 100.0
    auxiliary_start: float | None = None
    ring: list[tuple[float, float]] | None = None
    inner_ring: list[tuple[float, float]] | None = None
    beta: float | str | None = None
    bg_term: str | None = None
    fixed: tuple[str, ...] = ()
    alpha_is_beta: bool = False
    free_productivity: bool = False
    free_background: bool = False
    bandwidth2: float = 1.0
    #: For events in space (x, y, z): units of a km, and the region's facets (see ``geo.hull_facets``); ``area_km2`` is then its volume.
    units_per_km: float | None = None
    facets: tuple | None = None
    #: Called with the parameters by name after each trial step; returns those that it replaces.
    constraint: Callable[[dict[str, float]], dict[str, float]] | None = None
    #: Buckets of the pair table; the session's shuffle partitions if None.
    buckets: int | None = None

    @property
    def m_low(self) -> float:
        """The magnitude at which the kernels start: half a bin below the reference."""
        return self.m_ref - self.delta_m / 2

    @property
    def days(self) -> float:
        return self.end - self.start


@dataclass
class Prepared:
    """``rows`` are the events that the filters left."""

    rows: DataFrame
    targets: DataFrame
    sources: DataFrame
    beta: float
    setup: Setup

    @cached_property
    def pairs(self) -> DataFrame:
        return dealt(listed_pairs(self), "target_id", self.setup.buckets)


def listed_pairs(p: Prepared) -> DataFrame:
    """The pair table, not written."""
    rows, setup = p.rows, p.setup
    pairs = pair_table(rows, setup.start, setup.multiplier, units_per_km=setup.units_per_km)
    if setup.inner_ring is not None:
        pairs = pairs.join(in_region(rows, setup.inner_ring).select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return pairs.withColumns({"source_mc_above": F.col("source_mc") - setup.m_ref, "target_mc_above": F.col("target_mc") - setup.m_ref})


def selected(catalog: DataFrame, setup: Setup) -> DataFrame:
    """Events of the training window and region at or above completeness, with ``mc_current``."""
    rows = catalog.filter((F.col("days") >= (setup.auxiliary_start if setup.auxiliary_start is not None else -math.inf)) & (F.col("days") < setup.end))
    if setup.facets is not None:
        rows = in_hull(rows, list(setup.facets), ["x", "y", "z"])
    return complete(in_region(rows, setup.ring), setup.mc, setup.delta_m)


def prepared(catalog: DataFrame, setup: Setup, pairs: bool = True) -> Prepared:
    """Filter, pair, and split into sources and targets; the tables are written, ``pairs`` (if not now) when first asked for."""
    if setup.free_productivity and setup.fixed:
        raise ValueError("fixed parameters and free productivity do not go together")
    rows = materialized(selected(catalog, setup))
    low = setup.m_ref
    if rows.isEmpty():
        raise ValueError("no event passes the filters")
    least = lowered_reference(rows, low).head()[0]
    if least < low - 1e-9:
        low = least
        setup = replace(setup, m_ref=low)
    targets = in_region(rows, setup.inner_ring).filter(F.col("days") > setup.start).withColumn("mc_above", F.col("mc_current") - low)
    if setup.bg_term:
        whole = targets.agg(F.sum(setup.bg_term).alias("bg_whole"))
        targets = targets.join(F.broadcast(whole)).withColumn("bg_term", F.col(setup.bg_term) / F.col("bg_whole") * F.lit(setup.days * setup.area_km2)).drop("bg_whole")
    end, start = F.lit(setup.end), F.lit(setup.start)
    sources = rows.select(F.col("id").alias("source_id"), F.col("magnitude").alias("source_magnitude"), (F.col("mc_current") - low).alias("source_mc_above"), (end - F.col("days")).alias("to_end"), F.greatest(start - F.col("days"), F.lit(0.0)).alias("to_start"))
    if isinstance(setup.beta, (int, float)):
        beta = float(setup.beta)
    elif setup.beta == "positive":
        beta = estimate_beta_positive(targets, setup.delta_m).head().beta
    else:
        excess = targets.withColumn("magnitude", F.col("magnitude") - F.col("mc_current"))
        beta = estimate_beta(excess, 0.0, setup.delta_m).head().beta
    p = Prepared(rows, dealt(targets, "id", setup.buckets), materialized(sources), beta, setup)
    if pairs:
        p.pairs  # noqa: B018
    return p


#: A number for each source is sent to all tasks up to so many sources (16 bytes each); beyond, pairs are joined with it by a shuffle.
SENT_ROWS = 1_000_000


def _by_source(pairs: DataFrame, numbers: DataFrame, how: str) -> DataFrame:
    """``pairs`` with ``numbers`` (source_id, ...)."""
    return pairs.join(F.broadcast(numbers) if numbers.count() <= SENT_ROWS else numbers, "source_id", how)


def pair_rates(p: Prepared, t: Theta, kappa: DataFrame | None = None) -> DataFrame:
    """Pairs with ``g`` (kernel), ``xi`` and ``zeta``; ``kappa`` (source_id, kappa) replaces the productivity law."""
    pairs, number = p.pairs, None
    if kappa is not None:
        pairs = _by_source(pairs, kappa, "left")
        number = F.coalesce("kappa", F.lit(0.0))
    g = K.triggering(F.col("time_distance"), F.col("spatial_distance_squared"), F.col("source_magnitude"), t, p.setup.m_low, number)
    return pairs.withColumns({"g": g, "xi": K.xi_plus_1(F.col("source_mc_above"), t, p.beta), "zeta": K.zeta_plus_1(F.col("target_mc_above"), p.beta)})


def smoothed_background(p: Prepared, p_background: DataFrame) -> DataFrame:
    """(target_id, mu): Gaussian smoothing of the sources' background probabilities over pairs, and the event's own."""
    w = F.exp(-F.col("spatial_distance_squared") / (2 * p.setup.bandwidth2)) / (2 * math.pi * p.setup.bandwidth2)
    near = _by_source(p.pairs, p_background.select(F.col("target_id").alias("source_id"), "p_background"), "inner").groupBy("target_id").agg(F.sum(w * F.col("p_background")).alias("s"))
    return _with_own(p, p_background, near)


def _with_own(p: Prepared, p_background: DataFrame, near: DataFrame) -> DataFrame:
    own = F.col("p_background") / (2 * math.pi * p.setup.bandwidth2)
    return p_background.join(near, "target_id", "left").select("target_id", ((F.coalesce("s", F.lit(0.0)) + own) / p.setup.days).alias("mu"))


@dataclass
class Expected:
    pairs: DataFrame
    targets: DataFrame
    sources: DataFrame


def _targets(p: Prepared, t: Theta, mu: DataFrame | None) -> DataFrame:
    """Targets with their background rate ``mu`` and ``induced`` rate."""
    targets = p.targets.withColumnRenamed("id", "target_id")
    targets = targets.withColumn("mu", F.lit(t.mu)) if mu is None else targets.join(mu, "target_id", "left").withColumn("mu", F.coalesce("mu", F.lit(0.0)))
    return targets.withColumn("induced", F.lit(t.iota) * F.col("bg_term") if p.setup.bg_term else F.lit(0.0))


def probabilities(p: Prepared, t: Theta, kappa: DataFrame | None = None, mu: DataFrame | None = None) -> DataFrame:
    """``pair_rates`` of the totals' targets with ``total``, the target's whole rate, and ``p``, the source's share of it."""
    rates = pair_rates(p, t, kappa).join(_targets(p, t, mu).select("target_id", "mu", "induced"), "target_id")
    total = F.sum(F.col("g") * F.col("xi")).over(W.partitionBy("target_id")) + F.col("mu") + F.col("induced")
    return rates.withColumn("total", total).withColumn("p", F.col("g") / F.col("total"))


def gathered(p: Prepared, pij: DataFrame, t: Theta, mu: DataFrame | None = None) -> Expected:
    """Targets' and sources' sums of ``probabilities``, which may have been written."""
    by_target = pij.groupBy("target_id").agg(F.sum("p").alias("p_triggered"), F.max("total").alias("total"))
    zeta = K.zeta_plus_1(F.col("mc_above"), p.beta)
    out = _targets(p, t, mu).join(by_target, "target_id", "left").withColumns(
        {"p_triggered": F.coalesce("p_triggered", F.lit(0.0)), "p_background": F.coalesce(F.col("mu") / F.col("total"), F.lit(1.0)), "p_induced": F.coalesce(F.col("induced") / F.col("total"), F.lit(0.0)), "zeta": zeta}
    )
    l_hat = pij.groupBy("source_id").agg(F.sum(F.col("p") * F.col("zeta")).alias("l_hat"))
    sources = p.sources.join(l_hat, "source_id", "left").withColumn("l_hat", F.coalesce("l_hat", F.lit(0.0)))
    return Expected(pij, out, sources)


def expectation(p: Prepared, t: Theta, kappa: DataFrame | None = None, mu: DataFrame | None = None) -> Expected:
    """Triggering and background probabilities and expected aftershocks of sources.

    Targets of the pair stage include the start of the window, those of the totals do
    not. Targets without a pair are background; a missing sum is 0.
    """
    return gathered(p, probabilities(p, t, kappa, mu), t, mu)


def totals(targets: DataFrame) -> DataFrame:
    """One row: expected background and induced events of an expectation's targets."""
    return targets.agg(F.sum(F.col("p_background") * F.col("zeta")).alias("n_hat"), F.sum(F.col("p_induced") * F.col("zeta")).alias("i_hat"))


def _over_near(p: Prepared, kernel: Callable[[Arrays, Arrays, Near], Arrays], schema: str, more: list[str], targets: DataFrame, target_columns: list[str], extra: DataFrame | None = None, how: str = "left") -> DataFrame:
    """``near_sums`` of the events and ``targets`` (target_id, ...); ``extra`` (source_id, ``more``) belongs to the sources."""
    s = p.rows.withColumns({"m": F.col("magnitude"), "mc_above": F.col("mc_current") - p.setup.m_ref})
    if extra is not None:
        s = s.join(extra.withColumnRenamed("source_id", "id"), "id", how)
        s = s.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in more})
    return near_sums(s, targets.withColumnRenamed("target_id", "id"), reach_of(F.col("m"), p.setup.multiplier), ["m", "mc_above", *more], target_columns, kernel, schema)


def _rate_of(s: Arrays, t: Theta, m_low: float) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """The kernel of pairs (source's place, delay, squared distance), as ``kernels.triggering``."""
    big = s["m"] - m_low
    number, zone = s["kappa"] if "kappa" in s else t.k0 * np.exp(t.a * big), t.d * np.exp(t.gamma * big)

    def rate(i: np.ndarray, dt: np.ndarray, d2: np.ndarray) -> np.ndarray:
        log, late = zone.take(i), dt + t.c
        log += d2
        np.log(log, out=log)
        log *= -(1 + t.rho)
        np.log(late, out=late)
        late *= 1 + t.omega
        log -= late
        if t.tau != math.inf:
            log -= np.divide(dt, t.tau, out=late)
        np.exp(log, out=log)
        log *= number.take(i)
        return log

    return rate


def expected_targets(p: Prepared, t: Theta, kappa: DataFrame | None = None, mu: DataFrame | None = None) -> DataFrame:
    """The targets of ``expectation``, written, without a table of pairs."""
    if p.setup.units_per_km is not None:
        return materialized(expectation(p, t, kappa, mu).targets)
    low, beta = p.setup.m_low, p.beta

    def kernel(s: Arrays, to: Arrays, near: Near) -> Arrays:
        rate, xi = _rate_of(s, t, low), np.exp(-(t.a - beta - t.gamma * t.rho) * s["mc_above"])
        own, whole, complete = np.zeros(len(to["id"])), np.zeros(len(to["id"])), bool((xi == 1).all())
        for i, j, dt, d2 in near:
            g = rate(i, dt, d2)
            added(own, j, g)
            if not complete:
                added(whole, j, g * xi[i])
        whole = own if complete else whole
        some = whole > 0
        return {"target_id": to["id"][some], "own": own[some], "whole": whole[some]}

    targets = _targets(p, t, mu)
    sums = _over_near(p, kernel, "target_id long, own double, whole double", [] if kappa is None else ["kappa"], targets, [], kappa)
    sums = sums.groupBy("target_id").agg(F.sum("own").alias("own"), F.sum("whole").alias("whole"))
    out = targets.join(sums, "target_id", "left").withColumns({"total": F.col("whole") + F.col("mu") + F.col("induced"), "zeta": K.zeta_plus_1(F.col("mc_above"), p.beta)})
    share = lambda c, none: F.coalesce(F.col(c) / F.col("total"), F.lit(none))
    return materialized(out.withColumns({"p_triggered": share("own", 0.0), "p_background": share("mu", 1.0), "p_induced": share("induced", 0.0)}).drop("own", "whole"))


def streamed_pairs(p: Prepared, t: Theta, targets: DataFrame, kappa: DataFrame | None = None) -> DataFrame:
    """(source_id, target_id, g, p): pairs of ``expected_targets``' targets, made by the join with all that their rates need, and not written."""
    place = ["id", "days", "latitude", "longitude"]
    s = p.rows.select(*place, "magnitude")
    if kappa is not None:
        s = s.join(kappa.withColumnRenamed("source_id", "id"), "id", "left").withColumn("kappa", F.coalesce("kappa", F.lit(0.0)))
    to = targets.withColumnRenamed("target_id", "id").select(*place, *(["total"] if "total" in targets.columns else []))
    pairs = later_pairs(s, to, reach_of(F.col("magnitude"), p.setup.multiplier))
    g = K.triggering(F.col("time_distance"), F.col("spatial_distance_squared"), F.col("source_magnitude"), t, p.setup.m_low, None if kappa is None else F.col("source_kappa"))
    pairs = pairs.withColumn("g", g)
    return pairs.select("source_id", "target_id", "g", *([(F.col("g") / F.col("target_total")).alias("p")] if "total" in targets.columns else []))


def weighted_sums(p: Prepared, t: Theta, targets: DataFrame, of: Callable, schema: str, kappa: DataFrame | None = None) -> DataFrame:
    """Rows (``schema``) of tiles of pairs: ``of`` gets the sources, and strips (source's place, delay, squared distance, weight).

    The weight is ``expectation``'s p times zeta; ``targets`` are those of ``expected_targets``.
    """
    low = p.setup.m_low

    def kernel(s: Arrays, to: Arrays, near: Near) -> Arrays:
        rate, share = _rate_of(s, t, low), to["share"]
        return of(s, ((i, dt, d2, rate(i, dt, d2) * share[j]) for i, j, dt, d2 in near))

    held = targets.withColumn("share", F.coalesce(F.col("zeta") / F.col("total"), F.lit(0.0)))
    return _over_near(p, kernel, schema, [] if kappa is None else ["kappa"], held, ["share"], kappa)


def expected_sources(p: Prepared, t: Theta, targets: DataFrame, kappa: DataFrame | None = None, mu: DataFrame | None = None) -> DataFrame:
    """The sources of ``expectation``, written, without a table of pairs; ``targets`` are those of ``expected_targets``."""
    if p.setup.units_per_km is not None:
        return materialized(expectation(p, t, kappa, mu).sources)

    def of(s: Arrays, strips) -> Arrays:
        sums = np.zeros(len(s["id"]))
        for i, _, _, w in strips:
            added(sums, i, w)
        return {"source_id": s["id"][sums > 0], "l_hat": sums[sums > 0]}

    sums = weighted_sums(p, t, targets, of, "source_id long, l_hat double", kappa).groupBy("source_id").agg(F.sum("l_hat").alias("l_hat"))
    return materialized(p.sources.join(sums, "source_id", "left").withColumn("l_hat", F.coalesce("l_hat", F.lit(0.0))))


def near_background(p: Prepared, p_background: DataFrame) -> DataFrame:
    """``smoothed_background`` without a table of pairs."""
    b2 = p.setup.bandwidth2

    def kernel(s: Arrays, to: Arrays, near: Near) -> Arrays:
        sums = np.zeros(len(to["id"]))
        for i, j, _, d2 in near:
            added(sums, j, np.exp(-d2 / (2 * b2)) / (2 * math.pi * b2) * s["p_background"][i])
        return {"target_id": to["id"], "s": sums}

    extra = p_background.select(F.col("target_id").alias("source_id"), "p_background")
    near = _over_near(p, kernel, "target_id long, s double", ["p_background"], p.targets, [], extra, "inner").groupBy("target_id").agg(F.sum("s").alias("s"))
    return _with_own(p, p_background, near)


def pair_sums(p: Prepared, t: Theta, targets: DataFrame, at: Theta, terms: Callable, size: int) -> np.ndarray:
    """``size`` sums of ``terms`` (``pair_terms`` or ``pair_information``) at ``at`` over pairs weighted by the expectation at ``t``."""
    low, values = p.setup.m_low, np.array([getattr(at, n) for n in FREE], float)

    def of(s: Arrays, strips) -> Arrays:
        sums = np.zeros(size)
        for i, dt, d2, w in strips:
            sums += terms(values, s["m"][i], dt, d2, w, low)
        return {"i": np.arange(size), "v": sums}

    got = np.zeros(size)
    for r in weighted_sums(p, t, targets, of, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # ``size`` rows
        got[r.i] = r.v
    return got


def expected_sources_and_sums(p: Prepared, t: Theta, targets: DataFrame, at: Theta, terms: Callable, size: int) -> tuple[DataFrame, np.ndarray]:
    """``expected_sources`` and ``pair_sums`` in one pass over the pairs."""
    low, values = p.setup.m_low, np.array([getattr(at, n) for n in FREE], float)

    def of(s: Arrays, strips) -> Arrays:
        sums, own = np.zeros(size), np.zeros(len(s["id"]))
        for i, dt, d2, w in strips:
            added(own, i, w)
            sums += terms(values, s["m"].take(i), dt, d2, w, low)
        some = own > 0
        return {"i": np.concatenate((np.arange(size), np.full(np.count_nonzero(some), -1))), "source_id": np.concatenate((np.zeros(size, np.int64), s["id"][some])), "v": np.concatenate((sums, own[some]))}

    found = materialized(weighted_sums(p, t, targets, of, "i long, source_id long, v double").groupBy("i", "source_id").agg(F.sum("v").alias("v")))
    got = np.zeros(size)
    for r in found.filter("i >= 0").collect():  # ``size`` rows
        got[r.i] = r.v
    sums = found.filter("i < 0").select("source_id", F.col("v").alias("l_hat"))
    return materialized(p.sources.join(sums, "source_id", "left").withColumn("l_hat", F.coalesce("l_hat", F.lit(0.0)))), got


FREE = ("log10_k0", "a", "log10_c", "omega", "log10_tau", "log10_d", "gamma", "rho")
LN10 = math.log(10)
#: Pairs and sources that the driver may hold for the maximisation (4 numbers each); beyond, each evaluation is a pass over the tables.
HELD_ROWS = 2_000_000


def _time_parts(start: np.ndarray, end: np.ndarray | None, t: Theta) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The decay's integral between two delays and its derivatives by c, omega and tau.

    With f = exp(-t/tau) (t+c)^-(1+omega), parts give dI/dc = [f] + I/tau and
    dI/dtau = -([f (t+c)] + omega I + c I / tau) / tau; dI/domega is closed without a taper, else a central difference.
    """
    whole = tapered_time_integral(start, end, t.c, t.omega, t.tau)

    def f(x: np.ndarray | None, power: float) -> np.ndarray | float:
        if x is None:
            return 0.0
        x = np.asarray(x, float)
        taper = 1.0 if t.tau == math.inf else np.exp(-x / t.tau)
        return taper * (x + t.c) ** -power

    by_c = f(end, 1 + t.omega) - f(start, 1 + t.omega) + (0.0 if t.tau == math.inf else whole / t.tau)
    if t.tau == math.inf and t.omega:

        def slope(x: np.ndarray | None) -> np.ndarray | float:
            """By omega, of (x + c)^-omega / omega."""
            if x is None:
                return 0.0
            x = np.asarray(x, float)
            return -((x + t.c) ** -t.omega) / t.omega * (np.log(x + t.c) + 1 / t.omega)

        return whole, by_c, slope(start) - slope(end), np.zeros_like(whole)
    by_tau = np.zeros_like(whole) if t.tau == math.inf else -(f(end, t.omega) - f(start, t.omega) + t.omega * whole + t.c * whole / t.tau) / t.tau
    h = 1e-6
    by_omega = (tapered_time_integral(start, end, t.c, t.omega + h, t.tau) - tapered_time_integral(start, end, t.c, t.omega - h, t.tau)) / (2 * h)
    return whole, by_c, by_omega, by_tau


def _by_time(parts: tuple, t: Theta, over: np.ndarray) -> list[np.ndarray]:
    """Derivatives of the integral's logarithm by log10_c, omega and log10_tau."""
    _, by_c, by_omega, by_tau = parts
    return [by_c / over * LN10 * t.c, by_omega / over, np.zeros_like(over) if t.tau == math.inf else by_tau / over * LN10 * t.tau]


@lru_cache(maxsize=16)
def _whole_time(t: Theta) -> tuple[float, float, float, float]:
    """The decay's whole integral, and the slopes of its logarithm."""
    whole = _time_parts(np.array([0.0]), None, t)
    return (float(whole[0][0]), *(float(x[0]) for x in _by_time(whole, t, whole[0])))


def _source_parts(values: np.ndarray, m: np.ndarray, start: np.ndarray, end: np.ndarray, l_hat: np.ndarray, m_low: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Poisson log terms of the sources' aftershock numbers, the expected numbers, l_hat less these, and the slopes of their logarithm over ``FREE``."""
    t = Theta(0.0, None, *values.tolist())
    big = m - m_low
    parts = _time_parts(start, end, t)
    zone = t.d * np.exp(t.gamma * big)
    g = t.k0 * np.exp(t.a * big) * math.pi / t.rho * zone**-t.rho * np.maximum(parts[0], 0.0)
    some = g > 0
    log_g = np.where(some, np.log(np.where(some, g, 1.0)), -300.0)
    over = np.where(parts[0] > 0, parts[0], 1.0)
    slopes = [np.full_like(m, LN10), big, *_by_time(parts, t, over), np.full_like(m, -t.rho * LN10), -t.rho * big, -1 / t.rho - np.log(zone)]
    return -gammaln(l_hat + 1) - g + l_hat * log_g, g, np.where(some, l_hat - g, 0.0), slopes


def _pair_parts(values: np.ndarray, m: np.ndarray, dt: np.ndarray, r2: np.ndarray, m_low: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Log densities of the pairs' delays and squared distances, and their slopes over ``FREE`` from log10_c on."""
    t = Theta(0.0, None, *values.tolist())
    big = m - m_low
    zone = t.d * np.exp(t.gamma * big)
    near = r2 + zone
    whole = _time_parts(np.array([0.0]), None, t)
    log_zone, log_near, log_time = np.log(zone), np.log(near), np.log(dt + t.c)
    density = math.log(t.rho / math.pi) + t.rho * log_zone - (1 + t.rho) * log_near - (1 + t.omega) * log_time - math.log(float(whole[0][0]))
    if t.tau != math.inf:
        density = density - dt / t.tau
    by_c, by_omega, by_tau = (float(x[0]) for x in _by_time(whole, t, whole[0]))
    pull = t.rho - (1 + t.rho) * zone / near
    of_tau = np.zeros_like(dt) if t.tau == math.inf else LN10 * dt / t.tau - by_tau
    return density, [-(1 + t.omega) * LN10 * t.c / (dt + t.c) - by_c, -log_time - by_omega, of_tau, LN10 * pull, big * pull, 1 / t.rho + log_zone - log_near]


def source_terms(values: np.ndarray, m: np.ndarray, start: np.ndarray, end: np.ndarray, l_hat: np.ndarray, m_low: float) -> np.ndarray:
    """Sum of the Poisson log terms of the sources' aftershock numbers, and its gradient."""
    value, _, pull, slopes = _source_parts(values, m, start, end, l_hat, m_low)
    return np.array([value.sum(), *[(pull * s).sum() for s in slopes]])


def pair_terms(values: np.ndarray, m: np.ndarray, dt: np.ndarray, r2: np.ndarray, weight: np.ndarray, m_low: float) -> np.ndarray:
    """Weighted sum of the log densities of the pairs' delays and squared distances, and its gradient."""
    density, slopes = _pair_parts(values, m, dt, r2, m_low)
    return np.array([(weight * density).sum(), 0.0, 0.0, *[(weight * s).sum() for s in slopes]])


def source_information(values: np.ndarray, m: np.ndarray, start: np.ndarray, end: np.ndarray, l_hat: np.ndarray, m_low: float) -> np.ndarray:
    """``source_terms``, and row by row the expected information of the Poisson numbers: their means times products of slopes."""
    value, g, pull, slopes = _source_parts(values, m, start, end, l_hat, m_low)
    s = np.stack(slopes)
    return np.concatenate(([value.sum()], s @ pull, ((s * g) @ s.T).ravel()))


def pair_information(values: np.ndarray, m: np.ndarray, dt: np.ndarray, r2: np.ndarray, weight: np.ndarray, m_low: float) -> np.ndarray:
    """``pair_terms``, and row by row the information of the densities: weighted products of slopes."""
    # Density and slopes are linear in eight functions of a pair, so their weighted products are those of the functions.
    t = Theta(0.0, None, *values.tolist())
    of = np.empty((8, len(dt)))
    one, late, soon, delay, pull, big, big_pull, log_near = of
    one[:], delay[:] = 1.0, dt
    np.subtract(m, m_low, out=big)
    np.add(dt, t.c, out=soon)
    np.log(soon, out=late)
    np.divide(1.0, soon, out=soon)
    np.exp(t.gamma * big, out=pull)
    pull *= t.d
    near = r2 + pull
    pull /= near
    np.multiply(big, pull, out=big_pull)
    np.log(near, out=log_near)
    products = (of * weight) @ of.T
    integral, by_c, by_omega, by_tau = _whole_time(t)
    log_d, rate = math.log(t.d), 0.0 if t.tau == math.inf else 1 / t.tau
    density = np.array([math.log(t.rho / math.pi) + t.rho * log_d - math.log(integral), -(1 + t.omega), 0.0, -rate, 0.0, t.rho * t.gamma, 0.0, -(1 + t.rho)])
    slopes = np.zeros((len(FREE), 8))
    slopes[2, [0, 2]] = -by_c, -(1 + t.omega) * LN10 * t.c
    slopes[3, [0, 1]] = -by_omega, -1.0
    slopes[4, [0, 3]] = (-by_tau, LN10 * rate) if rate else (0.0, 0.0)
    slopes[5, [0, 4]] = LN10 * t.rho, -LN10 * (1 + t.rho)
    slopes[6, [5, 6]] = t.rho, -(1 + t.rho)
    slopes[7, [0, 5, 7]] = 1 / t.rho + log_d, t.gamma, -1.0
    return np.concatenate(([density @ products[0]], slopes @ products[0], (slopes @ products @ slopes.T).ravel()))


PAIR_COLUMNS, SOURCE_COLUMNS = ("source_magnitude", "time_distance", "spatial_distance_squared", "weight"), ("source_magnitude", "to_start", "to_end", "l_hat")


def _columns(df: DataFrame, names: tuple[str, ...]) -> list[np.ndarray]:
    found = df.select(*names).toArrow()
    return [found.column(c).to_numpy() for c in names]


class Objective:
    """(log likelihood, gradient over ``FREE``) of an expectation's pairs and sources at any parameters.

    With ``pairs_only`` the sources' term is left out (free productivity). Tables of at most
    ``HELD_ROWS`` rows are held as arrays; larger ones are summed where they are.
    """

    def __init__(self, e: Expected, m_low: float, pairs_only: bool = False, held_rows: int = HELD_ROWS) -> None:
        self.e, self.m_low, self.pairs_only = e, m_low, pairs_only
        small = e.pairs.count() + e.sources.count() <= held_rows
        self.held = (_columns(e.pairs, PAIR_COLUMNS), _columns(e.sources, SOURCE_COLUMNS)) if small else None

    def __call__(self, values: np.ndarray) -> tuple[float, np.ndarray]:
        with np.errstate(all="ignore"):
            if self.held is None:
                got = self._summed(values)
            else:
                got = pair_terms(values, *self.held[0], self.m_low)
                if not self.pairs_only:
                    got = got + source_terms(values, *self.held[1], self.m_low)
        return float(got[0]), got[1:]

    def _summed(self, values: np.ndarray) -> np.ndarray:
        return _summed(self.e, values, self.m_low, pair_terms, None if self.pairs_only else source_terms, len(FREE) + 1)


def _summed(e: Expected, values: np.ndarray, m_low: float, of_pairs: Callable, of_sources: Callable | None, size: int) -> np.ndarray:
    """``size`` sums over pairs and sources in one pass of each; pairs that are None are left out."""

    def over(terms, names):
        def run(batches):
            sums = np.zeros(size)
            for b in batches:
                with np.errstate(all="ignore"):
                    sums = sums + terms(values, *[b.column(c).to_numpy(zero_copy_only=False) for c in names], m_low)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(sums)], ["i", "v"])

        return run

    tables = [(t, f, c) for t, f, c in ((e.pairs, of_pairs, PAIR_COLUMNS), (e.sources, of_sources, SOURCE_COLUMNS)) if t is not None and f is not None]
    parts = [df.select(*c).mapInArrow(over(f, c), "i long, v double") for df, f, c in tables]
    got = np.zeros(size)
    for r in reduce(DataFrame.union, parts).groupBy("i").agg(F.sum("v").alias("v")).collect():  # ``size`` rows
        got[r.i] = r.v
    return got


@dataclass
class Curvature:
    """Log likelihood, gradient and information over ``FREE`` of an expectation's pairs and sources, at ``theta``.

    The information is that of the complete data: of the parameters if each event's parent were
    known with the given probabilities. What is not known of the parents can only add to the errors.
    """

    theta: Theta
    value: float
    gradient: np.ndarray
    information: np.ndarray

    def standard_errors(self, setup: Setup) -> dict[str, float]:
        """Of the parameters that are free in ``setup`` and not at a bound; roots of the inverse's diagonal."""
        now = np.array([getattr(self.theta, n) for n in FREE], float)
        still = {*setup.fixed, *(("a",) if setup.alpha_is_beta else ()), *(("log10_k0", "a") if setup.free_productivity else ())}
        free = [i for i, n in enumerate(FREE) if n not in still and RANGES[2 + i][0] < now[i] < RANGES[2 + i][1]]
        spread = np.linalg.pinv(self.information[np.ix_(free, free)])
        return {FREE[i]: math.sqrt(max(0.0, float(spread[k, k]))) for k, i in enumerate(free)}


def curvature(e: Expected, t: Theta, m_low: float, pairs_only: bool = False, of_pairs: np.ndarray | None = None) -> Curvature:
    """Value, gradient and information in one pass over pairs and sources; ``e.pairs`` has ``weight``, or is None where ``of_pairs`` are its sums."""
    n = len(FREE)
    got = _summed(e, np.array([getattr(t, k) for k in FREE], float), m_low, pair_information, None if pairs_only else source_information, 1 + n + n * n)
    got = got if of_pairs is None else got + of_pairs
    return Curvature(t, float(got[0]), got[1 : 1 + n], got[1 + n :].reshape(n, n))


def log_likelihood(e: Expected, t: Theta, m_low: float) -> float:
    """Of the sources' numbers and the pairs' delays and distances; ``e.pairs`` has ``weight``."""
    return Objective(e, m_low)(np.array([getattr(t, n) for n in FREE], float))[0]


def maximize(e: Expected | None, t: Theta, setup: Setup, beta: float, steps: int = 500, held_rows: int = HELD_ROWS, of: Callable | None = None) -> tuple[Theta, bool]:
    """The maximisation step, and whether it got to its end: projected quasi-Newton (BFGS) ascent within the bounds.

    It ends where a step no longer raises the likelihood by 1e-12 of its size; ``steps`` is a
    guard, reported by the second value. With free productivity, six parameters are fitted
    to the pairs' term alone. ``of`` (value and gradient) stands for ``e``'s ``Objective`` if given.
    """
    low, high = (np.array([r[k] for r in RANGES[2:]], float) for k in (0, 1))
    values = np.array([getattr(t, n) for n in FREE], float)
    endless = t.tau == math.inf
    values = np.where(np.isinf(values), values, np.clip(values, low, high))
    still = {*setup.fixed, *(("a",) if setup.alpha_is_beta else ()), *(("log10_tau",) if endless else ()), *(("log10_k0", "a") if setup.free_productivity else ())}
    free = [i for i, n in enumerate(FREE) if n not in still]

    def tied(v: np.ndarray) -> np.ndarray:
        v = np.where(np.isinf(v), v, np.clip(v, low, high))
        if setup.alpha_is_beta:
            v[1] = beta + v[7] * v[6]
        if setup.constraint is not None:
            for n, x in setup.constraint(dict(zip(FREE, v.tolist()))).items():
                v[FREE.index(n)] = x
        return v

    of = of or Objective(e, setup.m_low, setup.free_productivity, held_rows)

    def at(v: np.ndarray) -> tuple[float, np.ndarray]:
        value, grad = of(v)
        if setup.alpha_is_beta:
            grad = grad.copy()
            grad[6] += grad[1] * v[7]
            grad[7] += grad[1] * v[6]
        out = (grad[free] >= 0) & (v[free] >= high[free]) | (grad[free] <= 0) & (v[free] <= low[free])
        return value, np.where(out, 0.0, grad[free])

    values = tied(values)
    here, grad = at(values)
    scale = np.eye(len(free)) * 0.1 / max(1.0, float(np.abs(grad).max(initial=0.0)))
    inverse, fresh, done = scale, True, False
    for _ in range(steps):
        step, moved = inverse @ grad, None
        if not step.any():
            done = True
            break
        step = step * min(1.0, 2.0 / float(np.abs(step).max()))
        for shrink in 0.5 ** np.arange(24):
            trial = values.copy()
            trial[free] += shrink * step
            trial = tied(trial)
            there, grad_there = at(trial)
            if math.isfinite(there) and there > here:
                moved = trial
                break
        if moved is None:
            if fresh:
                done = True
                break
            inverse, fresh = np.eye(len(free)) * 0.1 / max(1.0, float(np.abs(grad).max())), True
            continue
        s, y, gain = (moved - values)[free], grad - grad_there, there - here
        values, here, grad = moved, there, grad_there
        if gain <= 1e-12 * max(1.0, abs(here)):
            done = True
            break
        if s @ y > 1e-14:
            if fresh:
                inverse = np.eye(len(free)) * float(s @ y) / float(y @ y)
            r = 1 / (s @ y)
            left = np.eye(len(free)) - r * np.outer(s, y)
            inverse, fresh = left @ inverse @ left.T + r * np.outer(s, s), False
    return replace(t, **dict(zip(FREE, values.tolist()))), done


@dataclass
class Fit:
    """``converged`` tells whether the parameters had come to rest; ``kappa`` (source_id, kappa) is there with free productivity."""

    theta: Theta
    beta: float
    n_hat: float
    i_hat: float
    iterations: int
    expected: Expected
    setup: Setup
    history: list[float] = field(default_factory=list)
    converged: bool = True
    kappa: DataFrame | None = None

    def record(self) -> dict:
        """What is stored of a fit, with the bounds by name."""
        kept = {k: v for k, v in vars(self.setup).items() if k != "constraint"}
        return {
            "final_parameters": dict(zip(K.NAMES, self.theta.values())), "ranges": dict(zip(K.NAMES, RANGES)), "beta": self.beta, "n_hat": self.n_hat, "i_hat": self.i_hat,
            "m_ref": self.setup.m_ref, "delta_m": self.setup.delta_m, "iterations": self.iterations, "converged": self.converged, "area": self.setup.area_km2, "setup": kept,
        }

    @classmethod
    def stored(cls, record: dict, targets: DataFrame | None = None, sources: DataFrame | None = None, pairs: DataFrame | None = None) -> Fit:
        """A fit from its record and those of its tables that were stored."""
        setup = dict(record["setup"])
        for ring in ("ring", "inner_ring"):
            setup[ring] = None if setup.get(ring) is None else [tuple(p) for p in setup[ring]]
        setup["fixed"] = tuple(setup.get("fixed") or ())
        setup["facets"] = None if setup.get("facets") is None else tuple((list(n), o) for n, o in setup["facets"])
        return cls(Theta.of(record["final_parameters"]), record["beta"], record["n_hat"], record["i_hat"], record["iterations"], Expected(pairs, targets, sources), Setup(**setup), [], record.get("converged", True))


def kappas_updated(sources: DataFrame, t: Theta, m_low: float) -> DataFrame:
    """(source_id, kappa, source_magnitude, to_start) with kappa scaled so that expected aftershocks equal ``l_hat``; 0 where none were expected."""

    def run(batches):
        for b in batches:
            m, a, z, kappa, l_hat = (b.column(c).to_numpy(zero_copy_only=False) for c in ("source_magnitude", "to_start", "to_end", "kappa", "l_hat"))
            g = kappa * math.pi / t.rho * (t.d * np.exp(t.gamma * (m - m_low))) ** -t.rho * tapered_time_integral(a, z, t.c, t.omega, t.tau)
            new = np.where(g > 0, kappa * l_hat / np.where(g > 0, g, 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([b.column("source_id"), pa.array(new), b.column("source_magnitude"), b.column("to_start")], ["source_id", "kappa", "source_magnitude", "to_start"])

    return sources.mapInArrow(run, "source_id long, kappa double, source_magnitude double, to_start double")


def law_of_kappas(kappas: DataFrame, m_low: float) -> tuple[float, float] | None:
    """(a, log10 k0) of the sources of the window itself, by means of each magnitude; None where no source has aftershocks."""
    means = kappas.filter("to_start <= 0").groupBy("source_magnitude").agg(F.avg("kappa").alias("k"), F.count(F.lit(1)).alias("n")).collect()  # one row a magnitude bin
    if not sum(r.k * r.n for r in means):
        return None
    return productivity_law(np.array([r.k for r in means]), np.array([r.source_magnitude - m_low for r in means]), np.array([r.n for r in means], float))


def _held(rate: float, bounds: tuple[float, float]) -> float:
    """Logarithm of a rate within its bounds: where all events are triggered, the background would fall for ever."""
    return min(bounds[1], max(bounds[0], math.log10(max(rate, 1e-300))))


def with_rates(t: Theta, setup: Setup, n_hat: float, i_hat: float) -> Theta:
    """``t`` with the rates that give the expected numbers of background and induced events, unless they are fixed."""
    whole = setup.area_km2 * setup.days
    if "log10_mu" not in setup.fixed:
        t = replace(t, log10_mu=_held(n_hat / whole, RANGES[0]))
    if setup.bg_term and "log10_iota" not in setup.fixed:
        t = replace(t, log10_iota=_held(i_hat / whole, RANGES[1]))
    return t


def invert(p: Prepared, t: Theta, tolerance: float = 0.001, most: int = 1000, steps: int = 500, held_rows: int = HELD_ROWS) -> Fit:
    """Iterate until the parameters move by less than ``tolerance`` in sum, then one more expectation step.

    ``most`` and ``steps`` guard against parameters that never come to rest; a fit that meets
    one of them says so (``converged``). Tables of an iteration are removed after the next.
    """
    setup, kappa, mu, history, converged, old = p.setup, None, None, [], False, []
    if setup.free_productivity:
        kappa = materialized(p.sources.select("source_id", K.aftershock_number(F.col("source_magnitude"), t, setup.m_low).alias("kappa")))
    for k in range(most + 1):
        pij = probabilities(p, t, kappa, mu)
        pij = dealt(pij.select("source_id", "target_id", "source_magnitude", "time_distance", "spatial_distance_squared", "total", "p", "zeta", (F.col("p") * F.col("zeta")).alias("weight")), "target_id", setup.buckets)
        e = gathered(p, pij, t, mu)
        e = Expected(pij, materialized(e.targets), materialized(e.sources))
        n_hat, i_hat = totals(e.targets).head()
        if history and history[-1] < tolerance:
            converged = ended
            break
        if k == most:
            break
        new, ended = maximize(e, t, setup, p.beta, steps, held_rows)
        new = with_rates(new, setup, n_hat, i_hat)
        gone = [*old, kappa, mu]
        if setup.free_productivity:
            rows = materialized(kappas_updated(e.sources.join(kappa, "source_id"), new, setup.m_low))
            if (law := law_of_kappas(rows, setup.m_low)) is not None:
                new = replace(new, a=law[0], log10_k0=law[1])
            kappa = rows.select("source_id", "kappa")
        if setup.free_background:
            mu = materialized(smoothed_background(p, e.targets.select("target_id", "p_background")))
        history.append(t.distance(new))
        t = new
        released(*[g for g in gone if g is not kappa and g is not mu])
        old = [e.pairs, e.targets, e.sources]
    released(*[f for f in old if f not in (e.pairs, e.targets, e.sources)])
    return Fit(t, p.beta, n_hat, i_hat, k, e, setup, history, converged, kappa)


def poisson_term(l_hat: Column, g: Column, log_gamma: Column) -> Column:
    """-ln Gamma(l + 1) - g + l ln g, with ln g of -300 where g is 0; ``log_gamma`` is ln Gamma(l + 1)."""
    return -log_gamma - g + l_hat * F.when(g != 0, F.log(g)).otherwise(-300.0)


def log_gamma_of(x: Column) -> Column:
    """ln Gamma of positive numbers, by Stirling's series after moving up beyond 8."""
    up = F.greatest(F.lit(0), F.ceil(F.lit(8.0) - x)).cast("int")
    back = F.aggregate(F.sequence(F.lit(0), F.greatest(up - 1, F.lit(0))), F.lit(0.0), lambda s, i: s + F.when(i < up, F.log(x + i)).otherwise(0.0))
    z = x + up
    z2 = z * z
    series = F.lit(1.0) / (12 * z) - F.lit(1.0) / (360 * z * z2) + F.lit(1.0) / (1260 * z * z2 * z2) - F.lit(1.0) / (1680 * z * z2 * z2 * z2)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - back
