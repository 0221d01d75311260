"""Branching and thinning simulation with hash-keyed random numbers.

All realisations are rows of one table keyed by ``catalog_id``. Every number is a hash of
the seed, the realisation, the event and its use, so results do not depend on
partitioning, and a lost task redoes the same events. Event ids of offspring are hashes of
the parent's and the copy's number, not sequence numbers. Large Poisson counts are sums of
counts of parts, each part a row of its own, so a prolific parent is no single task.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import special
from ..functions.geo import EARTH_RADIUS, contained, contains, geodesic_area, in_polygon, km_per_degree, place_in_ring
from ..functions.kernels import RateParams, Theta
from ..functions.rng import PART, inverted_poisson, key_id, normal, poisson, poisson_of, poisson_parts, uniform, uniform_of
from ..operators.filters import forecast_rows
from ..operators.ordered import with_rank
from ..sources.stage import materialized

#: The default seed.
SEED = 1905
EVENT = ("catalog_id", "id", "parent_id", "root_id", "generation", "kind", "days", "latitude", "longitude", "magnitude")

Generator = Callable[[Column, "Process"], Column]


@dataclass(frozen=True)
class Process:
    theta: Theta
    beta: float
    mc: float
    delta_m: float = 0.1
    m_max: float | None = None
    seed: int = SEED

    @property
    def m_low(self) -> float:
        return self.mc - self.delta_m / 2


def gutenberg_richter(u: Column, process: Process) -> Column:
    return K.gr_magnitude_of(u, process.beta, process.m_low, process.m_max)


gutenberg_richter.version = "gutenberg_richter 1"  # so that stored realisations can name it

#: Magnitude generators by name: (uniform column, process) to magnitudes.
GENERATORS: dict[str, Generator] = {"gutenberg_richter": gutenberg_richter}


def magnitude_generator(which: str | Generator | None) -> Generator:
    """A registered or given generator; unknown names fall back to the default law."""
    return which if callable(which) else GENERATORS.get(which or "", gutenberg_richter)


def zone_magnitudes(events: DataFrame, zones: DataFrame, seed: int = SEED) -> DataFrame:
    """Events (id, zone) with the first magnitude bin whose distribution (zone, magnitude, cdf) reaches a uniform number."""
    u = events.withColumn("u", uniform(seed, F.col("id"), "zone"))
    return u.join(zones, "zone").filter("u <= cdf").groupBy("id").agg(F.min("magnitude").alias("magnitude"))


#: Zones of places: a column of (lat, lon), and each zone's distribution (zone, magnitude, cdf).
Zones = tuple[Callable[[Column, Column], Column], DataFrame]


def with_magnitudes(rows: DataFrame, u: Column, process: Process, generator: Generator, zones: Zones | None) -> DataFrame:
    """``rows`` (id, latitude, longitude) with ``magnitude``: by the generator, or by the distribution of the place's zone.

    Every row gets one: a place whose zone has no distribution is an error.
    """
    if zones is None:
        return rows.withColumn("magnitude", generator(u, process))
    zone_of, table = zones
    placed = rows.withColumns({"zone": zone_of(F.col("latitude"), F.col("longitude")), "u": u})
    bins = table.groupBy("zone").agg(F.array_sort(F.collect_list(F.struct("cdf", "magnitude"))).alias("bins"))  # a row a zone, a few hundred bins each
    found = placed.join(F.broadcast(bins), "zone", "left")
    first = F.get(F.filter("bins", lambda b: b.cdf >= F.col("u")), F.lit(0))["magnitude"]
    return found.withColumn("magnitude", F.coalesce(first, F.raise_error(F.lit("a zone has no magnitude for a uniform number")).cast("double"))).drop("zone", "u", "bins")


def background(spark: SparkSession, process: Process, ring: list[tuple[float, float]], start: float, end: float, area_km2: float, catalogs: int = 1, generator: Generator = gutenberg_richter, zones: Zones | None = None, first: int = 0) -> DataFrame:
    """Uniform background events of each realisation ``first`` and on: Poisson counts, places uniform in the ring.

    The window is cut into equal slices with a mean of at most ``PART`` events each, whose
    counts are independent, so the events of one realisation are made by many tasks.
    """
    mean = process.theta.mu * area_km2 * (end - start)
    s, slices = process.seed, max(1, math.ceil(mean / PART))
    rows = spark.range(first * slices, (first + catalogs) * slices).select(F.expr(f"id div {slices}").alias("catalog_id"), (F.col("id") % slices).alias("slice"))
    cid, part = F.col("catalog_id"), F.col("slice")
    rows = rows.withColumn("n", inverted_poisson(F.lit(mean / slices), uniform(s, cid, part, "n_background"))).filter("n > 0")
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    rows = rows.withColumn("id", key_id("background", s, cid, part, F.col("k")))
    u = lambda use: uniform(s, F.col("id"), use)
    width = (end - start) / slices
    rows = rows.withColumns({"place": place_in_ring(ring, u("where"), u("lat"), u("lon")), "days": F.lit(start) + (part + u("time")) * width})
    rows = rows.withColumns({"latitude": F.col("place.lat"), "longitude": F.col("place.lon")})
    return _immigrants(with_magnitudes(rows, u("mag"), process, generator, zones), "background")


def _immigrants(rows: DataFrame, kind: str) -> DataFrame:
    return rows.select(
        "catalog_id", "id", F.lit(None).cast("long").alias("parent_id"), F.col("id").alias("root_id"), F.lit(0).alias("generation"), F.lit(kind).alias("kind"), "days", "latitude", "longitude", "magnitude",
    )


def empirical_places(n: DataFrame, events: DataFrame, probability: str, scale: float = 0.1, seed: int = SEED, cell: tuple[float, float] | None = None) -> DataFrame:
    """Places for rows ``n`` (id): an event kept by its probability, drawn with replacement, with jitter in degrees.

    The jitter is Gaussian with deviation ``scale``, or uniform in a ``cell`` (height,
    width) around the event. Kept events are numbered in the order of a hash of theirs; a row
    draws a number. Probabilities above 1 are an error; without a kept event there are no rows.
    """
    high = events.agg(F.max(probability)).head()[0]
    if high is not None and high > 1 + 1e-9:
        raise ValueError(f"a probability of {high} is above 1")
    kept = events.filter(uniform(seed, F.col("id"), "keep") <= F.col(probability)).select("latitude", "longitude", F.col("id").alias("kept_id"), uniform(seed, F.col("id"), "order").alias("place"))
    kept = with_rank(kept, "pick", order=("place", "kept_id")).select("latitude", "longitude", "pick")
    size = kept.agg(F.count(F.lit(1)).alias("all"))
    drawn = n.join(F.broadcast(size)).withColumn("pick", F.floor(uniform(seed, F.col("id"), "pick") * F.col("all")) + 1)
    if cell is None:
        jitter = [F.lit(scale) * normal(seed, F.col("id"), use) for use in ("jlat", "jlon")]
    else:
        jitter = [F.lit(width) * (uniform(seed, F.col("id"), use) - 0.5) for width, use in zip(cell, ("jlat", "jlon"))]
    return drawn.join(kept, "pick").withColumns({"latitude": F.col("latitude") + jitter[0], "longitude": F.col("longitude") + jitter[1]}).drop("pick", "all")


def induced(sites: DataFrame, process: Process, weight: str, start: float, end: float, catalogs: int = 1, scale: float = 0.05, generator: Generator = gutenberg_richter, expected: float | None = None, cell: tuple[float, float] | None = None, zones: Zones | None = None, first: int = 0) -> DataFrame:
    """Induced events of each realisation ``first`` and on at ``sites`` (id, latitude, longitude and a weight column).

    A site has a Poisson number whose mean is its share of the weight, of ``expected`` events (or iota).
    """
    whole, s = expected if expected is not None else process.theta.iota or 0.0, process.seed
    share = sites.join(F.broadcast(sites.agg(F.sum(weight).alias("_all")))).withColumn("_w", F.col(weight) / F.col("_all"))
    rows = share.withColumn("catalog_id", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(first + catalogs - 1).cast("long"))))
    rows = rows.withColumn("_n", poisson(F.lit(whole) * F.col("_w"), s, "induced", F.col("catalog_id"), F.col("id"))).filter("_n > 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    rows = rows.withColumn("id", key_id("induced", s, F.col("catalog_id"), F.col("id"), F.col("_k")))
    u = lambda use: uniform(s, F.col("id"), use)
    off = [F.lit(scale) * normal(s, F.col("id"), use) for use in ("lat", "lon")] if cell is None else [F.lit(w) * (u(use) - 0.5) for w, use in zip(cell, ("lat", "lon"))]
    rows = rows.withColumns({"days": F.lit(start) + (end - start) * u("time"), "latitude": F.col("latitude") + off[0], "longitude": F.col("longitude") + off[1]})
    return _immigrants(with_magnitudes(rows, u("mag"), process, generator, zones), "induced")


class Branching:
    """How an event's direct offspring are spread: their expected number, delays and distances."""

    def __init__(self, process: Process, approximate: bool = False) -> None:
        self.process, self.approximate = process, approximate

    def expected(self, m: Column) -> Column:
        return expected_offspring(m, self.process)

    def delay(self, u: Column) -> Column:
        t = self.process.theta
        if t.tau == math.inf:
            return K.untapered_delay_of(u, t)
        return K.approximate_delay_of(u, t) if self.approximate else special.delay_of(u, t.c, t.omega, t.tau)

    def radius(self, u: Column, m: Column) -> Column:
        return K.radius_of(u, m, self.process.theta, self.process.m_low)


class RateBranching:
    """The same by the normalised rate kernels."""

    def __init__(self, rates: RateParams) -> None:
        self.rates = rates

    def expected(self, m: Column) -> Column:
        return K.rate_productivity(m, self.rates)

    def delay(self, u: Column) -> Column:
        return K.rate_delay_of(u, self.rates)

    def radius(self, u: Column, m: Column) -> Column:
        return K.rate_radius_of(u, m, self.rates)


def expected_offspring(m: Column, process: Process) -> Column:
    """Direct aftershocks without time limits."""
    t = process.theta
    total = float(special.tapered_time_integral(np.array([0.0]), None, t.c, t.omega, t.tau)[0])
    return K.aftershock_number(m, t, process.m_low) * K.space_integral(m, t, process.m_low) * F.lit(total)


def aftershocks(sources: DataFrame, process: Process, end: float, after: float | None = None, generator: Generator = gutenberg_richter, inflate: str | None = None, kernels: Branching | RateBranching | None = None, longest: float | None = None, ring: list[tuple[float, float]] | None = None, zones: Zones | None = None) -> DataFrame:
    """One generation: offspring of ``sources`` up to ``end`` (and after ``after``, within a delay of ``longest``, in the ``ring``).

    Counts are Poisson with the expected number (times the column ``inflate``); delays,
    distances and directions come from the kernels by inversion.
    """
    s, kernels = process.seed, kernels or Branching(process)
    mean = kernels.expected(F.col("magnitude")) * (F.col(inflate) if inflate else F.lit(1.0))
    rows = sources.withColumn("_mean", mean).withColumn("_parts", poisson_parts(F.col("_mean"))).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    rows = rows.withColumn("_n", F.when(F.col("_mean") > 0, inverted_poisson(F.col("_mean") / F.col("_parts"), uniform(s, F.col("catalog_id"), F.col("id"), "n", F.col("_part")))).otherwise(0))
    rows = rows.filter("_n > 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    rows = rows.withColumn("_id", key_id(s, F.col("catalog_id"), F.col("id"), F.col("_part"), F.col("_k")))
    u = lambda use: uniform(s, F.col("_id"), use)
    rows = rows.withColumn("_delay", kernels.delay(u("time"))).withColumn("_t", F.col("days") + F.col("_delay"))
    rows = rows.filter((F.col("_t") <= end) & (F.col("_t") > (after if after is not None else -math.inf)))
    rows = rows if longest is None else rows.filter(F.col("_delay") <= longest)
    per_lat, per_lon = km_per_degree(F.col("latitude"))
    r, angle = kernels.radius(u("radius"), F.col("magnitude")), F.lit(2 * math.pi) * u("angle")
    lat, lon = F.col("latitude") + r * F.cos(angle) / per_lat, F.col("longitude") + r * F.sin(angle) / F.greatest(per_lon, F.lit(1e-6))
    rows = rows.select("catalog_id", F.col("_id").alias("id"), F.col("id").alias("parent_id"), "root_id", (F.col("generation") + 1).alias("generation"), F.lit("triggered").alias("kind"), F.col("_t").alias("days"), lat.alias("latitude"), lon.alias("longitude"))
    rows = rows.filter(F.abs("latitude") <= 90)
    rows = rows if ring is None else rows.filter(in_polygon(F.col("latitude"), F.col("longitude"), ring))
    return with_magnitudes(rows, u_of(s, "mag"), process, generator, zones).select(*EVENT)


def u_of(seed: int, use: str) -> Column:
    """The uniform number of the row's event for a use."""
    return uniform(seed, F.col("id"), use)


#: Generations after which a cascade is taken to grow without end.
MOST_GENERATIONS = 1000


def cascade(first: DataFrame, process: Process, end: float, most: int = MOST_GENERATIONS, **how) -> DataFrame:
    """``first`` and all generations of its offspring, each generation written, until one is empty.

    ``how`` goes to ``aftershocks``. A cascade that still lives after ``most`` generations is an error, not a shorter result.
    """
    now = materialized(first.select(*EVENT))
    out = now
    for _ in range(most):
        now = materialized(aftershocks(now, process, end, **how).select(*EVENT))
        if now.isEmpty():
            return out
        out = out.unionByName(now)
    raise RuntimeError(f"events still trigger others after {most} generations; see branching_ratio")


def synthetic_catalog(spark: SparkSession, process: Process, ring: list[tuple[float, float]], start: float, end: float, area_km2: float, burn_in: float = 0.0, catalogs: int = 1) -> DataFrame:
    """Background and all its offspring; events of the burn-in before ``start`` trigger but are not returned."""
    events = cascade(background(spark, process, ring, start - burn_in, end, area_km2, catalogs), process, end)
    return events.filter(F.col("days") >= start)


def history_offspring(history: DataFrame, process: Process, start: float, end: float, catalogs: int, xi: str | None = None, first: int = 0, **how) -> DataFrame:
    """First-generation events in (start, end] of past events (id, days, latitude, longitude, magnitude), for each realisation.

    ``xi`` names the column by which the history's productivity is inflated for events below completeness.
    """
    rows = history.filter(F.col("days") <= start).withColumn("catalog_id", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(first + catalogs - 1).cast("long"))))
    rows = rows.withColumns({"root_id": F.col("id"), "generation": F.lit(0)})
    return aftershocks(rows, process, end, after=start, inflate=xi, **how)


def prepared_history(sources: DataFrame, catalog: DataFrame, m_ref: float) -> DataFrame:
    """A fit's sources (source_id, ...) with the catalog's places, times and magnitudes, and ``xi_plus_1`` (1 where it is not known).

    Sources that the catalog lacks, or a smallest magnitude other than the reference, are errors.
    """
    known = sources if "xi_plus_1" in sources.columns else sources.withColumn("xi_plus_1", F.lit(1.0))
    rows = known.select(F.col("source_id").alias("id"), "xi_plus_1").join(catalog.select("id", "days", "latitude", "longitude", "magnitude"), "id", "left")
    n, want, missing, least = *rows.agg(F.count(F.lit(1))).head(), known.count(), *rows.agg(F.count_if(F.col("magnitude").isNull()), F.min("magnitude")).head()
    if n != want or missing:
        raise ValueError(f"{want} sources have {n} rows in the catalog, {missing} of them without an event")
    if least is not None and abs(least - m_ref) > 1e-7 * max(1.0, abs(m_ref)):
        raise ValueError(f"the smallest magnitude is {least}, the reference magnitude {m_ref}")
    return rows


def background_weights(targets: DataFrame) -> DataFrame:
    """A fit's targets with ``probability``: the share of background, weighted by what completeness hides and scaled to at most 1."""
    most = targets.agg(F.max("zeta").alias("most"))
    return targets.join(F.broadcast(most)).withColumn("probability", F.col("p_background") * F.col("zeta") / F.col("most")).drop("most")


def forecast(
    history: DataFrame, process: Process, ring: list[tuple[float, float]], start: float, days: float, area_km2: float, catalogs: int, m_threshold: float | None = None, filter_ring: bool = True,
    xi: str | None = None, induced_events: DataFrame | None = None, places: DataFrame | None = None, place_scale: float = 0.1, place_cell: tuple[float, float] | None = None, generator: Generator = gutenberg_richter, zones: Zones | None = None, approximate: bool = False, first: int = 0,
) -> DataFrame:
    """Realisations ``first`` and on of the ``days`` after ``start``: new background, induced events, offspring of the history, and theirs.

    ``xi`` inflates the history, ``induced_events`` (see ``induced``) join the background,
    ``places`` (id, latitude, longitude, probability) are where background happened before; ``place_cell`` spreads it over
    cells around them (see ``empirical_places``).
    Returned are events of the window with magnitudes from half a bin below the
    threshold on, binned, and in the ring if asked for.
    """
    spark, end = history.sparkSession, start + days
    how = {"generator": generator, "zones": zones, "kernels": Branching(process, approximate)}
    new = background(spark, process, ring, start, end, area_km2, catalogs, generator, zones, first)
    if places is not None:
        put = empirical_places(new.select("id"), places, "probability", place_scale, process.seed, place_cell)
        new = new.drop("latitude", "longitude").join(put, "id").select(*EVENT)
    new = new.unionByName(history_offspring(history, process, start, end, catalogs, xi, first, **how))
    if induced_events is not None:
        new = new.unionByName(induced_events.select(*EVENT))
    out = cascade(new, process, end, **how)
    return forecast_rows(out, start, end, process.mc if m_threshold is None else m_threshold, process.delta_m, ring if filter_ring else None)


def rate_forecast(history: DataFrame, process: Process, rates: RateParams, ring: list[tuple[float, float]], start: float, days: float, area_km2: float, catalogs: int, m_threshold: float | None = None, filter_ring: bool = True, xi: str | None = None, generator: Generator = gutenberg_richter, first: int = 0) -> DataFrame:
    """``forecast`` by the normalised rate kernels: offspring outside the ring neither count nor trigger."""
    spark, end = history.sparkSession, start + days
    ground = Process(Theta(log10_mu=math.log10(rates.mu)), process.beta, process.mc, process.delta_m, process.m_max, process.seed)
    oldest = history.agg(F.min("days")).head()[0]
    how = {"generator": generator, "kernels": RateBranching(rates), "longest": end - (start if oldest is None else min(oldest, start)), "ring": ring}
    new = background(spark, ground, ring, start, end, area_km2, catalogs, generator, first=first)
    new = new.unionByName(history_offspring(history, process, start, end, catalogs, xi, first, **how))
    out = cascade(new, process, end, **how)
    return forecast_rows(out, start, end, process.mc if m_threshold is None else m_threshold, process.delta_m, ring if filter_ring else None)


def space_share(ring: list[tuple[float, float]], lat: float, lon: float, m: float, t: Theta, m_low: float, resolution: int = 60) -> float:
    """Integral of an event's spatial kernel over the ring times its productivity (see ``space_shares_of``)."""
    return float(space_shares_of(ring, np.array([lat]), np.array([lon]), np.array([m]), t, m_low, resolution)[0])


def space_shares_of(ring: list[tuple[float, float]], lat: np.ndarray, lon: np.ndarray, m: np.ndarray, t: Theta, m_low: float, resolution: int = 60) -> np.ndarray:
    """``space_share`` of arrays: rings of equal kernel mass around each event, and directions in each, are checked against the ring.

    The error falls as the resolution grows: it is at most the share of nodes whose cell the boundary crosses.
    """
    zone = t.d * np.exp(t.gamma * (m - m_low))
    whole = t.k0 * np.exp(t.a * (m - m_low)) * math.pi / t.rho * zone**-t.rho
    u = (np.arange(resolution) + 0.5) / resolution
    reach, angles = np.sqrt((1 - u) ** (-1 / t.rho) - 1), 2 * math.pi * u
    north, east = (reach[:, None] * f(angles)[None, :] for f in (np.cos, np.sin))
    per_lat = 2 * math.pi * EARTH_RADIUS / 360
    out = np.empty(len(m))
    for i in range(len(m)):
        size = math.sqrt(zone[i])
        per_lon = max(1e-6, 2 * EARTH_RADIUS * math.asin(abs(math.cos(math.radians(lat[i]))) * math.sin(math.radians(0.5))))
        out[i] = contained(ring, lat[i] + size * north / per_lat, lon[i] + size * east / per_lon).mean()
    return whole * out


def space_shares(events: DataFrame, ring: list[tuple[float, float]], t: Theta, m_low: float, resolution: int = 60) -> DataFrame:
    """``events`` (latitude, longitude, magnitude) with ``share``, the space-integrated kernel of each: what ``total_rate`` weighs decays by."""

    @F.pandas_udf("double")
    def run(lat: pd.Series, lon: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series(space_shares_of(ring, lat.to_numpy(float), lon.to_numpy(float), m.to_numpy(float), t, m_low, resolution))

    return events.withColumn("share", run("latitude", "longitude", "magnitude"))


def next_event_time(rate: Callable[[float], float], start: float, end: float, uniforms: Callable[[], float]) -> float | None:
    """Time of the next event of a rate that falls between events (Ogata's thinning); None if there is none by ``end``."""
    now, bound = start, rate(start)
    while bound > 0:
        now -= math.log(1 - uniforms()) / bound
        if now > end:
            return None
        there = rate(now)
        if uniforms() * bound < there:
            return now
        bound = there
    return None


def thinned(history: DataFrame, process: Process, ring: list[tuple[float, float]], start: float, end: float, seeds: int, most_events: int | None = None, resolution: int = 24, xi: str | None = None, first: int = 0, generator: Callable[[float], float] | None = None) -> DataFrame:
    """Thinning realisations in (start, end]: (seed, m, x, y, t, dt_days, event_source, complete).

    The rate of a region is that of the background, of the past, and of new events. The first
    two do not depend on the simulation, so their events are Poisson: they are made for all seeds at
    once (``background``, and the history's offspring within the ring), whatever the
    history's size. What new events excite is thinned in time, seed by seed. A seed ends after
    ``most_events`` (None: ``event_cap``); ``complete`` is false where that left time over.
    ``generator`` maps a uniform number to a magnitude; without one it is the process's law.
    """
    spark, t, m_low, area = history.sparkSession, process.theta, process.m_low, geodesic_area(ring)
    cap = event_cap(end - start) if most_events is None else most_events
    new = background(spark, process, ring, start, end, area, seeds, first=first).withColumn("event_source", F.lit("background"))
    new = new.unionByName(history_offspring(history, process, start, end, seeds, xi, first, ring=ring).withColumn("event_source", F.lit("triggered")))
    every = spark.range(first, first + seeds).select(F.col("id").alias("seed"))
    rows = every.join(new.select(F.col("catalog_id").alias("seed"), "days", "latitude", "longitude", "magnitude", "event_source"), "seed", "left")
    per_lat = 2 * math.pi * EARTH_RADIUS / 360

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        seed = int(frame["seed"].iloc[0])
        frame = frame.dropna(subset=["days"]).sort_values(["days", "latitude"], kind="stable")
        coming = list(zip(frame["days"], frame["latitude"], frame["longitude"], frame["magnitude"], frame["event_source"]))
        times, shares, places, out = np.zeros(cap), np.zeros(cap), [], []
        now, draw, k = start, 0, 0

        def parts(x: float) -> np.ndarray:
            age = x - times[: len(out)]
            return shares[: len(out)] * np.exp(-age / t.tau) * (age + t.c) ** -(1 + t.omega)

        def u(use: str, *more: object) -> float:
            return uniform_of(process.seed, seed, use, draw, *more)

        def add(lat: float, lon: float, mag: float, source: str) -> None:
            n = len(out)
            out.append((seed, mag, lon, lat, now, now - start, source))
            places.append((lat, lon, mag))
            times[n], shares[n] = now, space_share(ring, lat, lon, mag, t, m_low, resolution)

        while len(out) < cap:
            draw += 1
            limit = coming[k][0] if k < len(coming) else end
            count = iter(range(1 << 62))
            at = next_event_time(lambda x: float(parts(x).sum()), now, min(limit, end), lambda: u("thin", next(count)))
            if at is None:
                if k == len(coming):
                    break
                now, lat, lon, mag, source = coming[k]
                k += 1
                add(lat, lon, mag if generator is None else generator(u("mag")), source)
                continue
            now = at
            reach = np.cumsum(parts(now))
            lat0, lon0, m0 = places[min(int(np.searchsorted(reach, u("parent") * reach[-1], side="right")), len(places) - 1)]
            zone, per_lon = t.d * math.exp(t.gamma * (m0 - m_low)), max(1e-6, 2 * EARTH_RADIUS * math.asin(abs(math.cos(math.radians(lat0))) * math.sin(math.radians(0.5))))
            for i in range(MOST_TRIES):
                r, angle = math.sqrt(zone * ((1 - u("radius", i)) ** (-1 / t.rho) - 1)), 2 * math.pi * u("angle", i)
                lat, lon = lat0 + r * math.cos(angle) / per_lat, lon0 + r * math.sin(angle) / per_lon
                if contains(ring, lat, lon):
                    break
            else:
                raise RuntimeError("no place in the ring for an offspring; the ring is too small for the kernel")
            norm = 1.0 if process.m_max is None else 1 - math.exp(-process.beta * (process.m_max - m_low))
            add(lat, lon, m_low - math.log(1 - norm * u("mag")) / process.beta if generator is None else generator(u("mag")), "triggered")
        done = pd.DataFrame(out, columns=["seed", "m", "x", "y", "t", "dt_days", "event_source"])
        done["complete"] = len(out) < cap
        return done

    schema = "seed long, m double, x double, y double, t double, dt_days double, event_source string, complete boolean"
    return rows.groupBy("seed").applyInPandas(run, schema)


#: Tries for an offspring's place within a ring: a share of the kernel below one in so many is an error.
MOST_TRIES = 1_000_000


def gridded(history: DataFrame, rates: RateParams, nodes: DataFrame, start: float, end: float, mc: float, beta: float, seeds: int = 1, seed: int = SEED, cell: float = 1.0, most_events: int | None = None) -> DataFrame:
    """Thinning on grid nodes: (seed, cell, days, latitude, longitude, magnitude, complete) of events that happen at nodes (cell, glat, glon).

    Magnitudes start at ``mc``. A node's rate is the normalised kernels' density there times ``cell``, the area that a node
    stands for (in the kernels' units, squared degrees). The past's part of it is Poisson and is
    thinned node by node over all tasks; what new events excite is thinned seed by seed, nodes drawn by their rate.
    A seed ends after ``most_events`` (None: ``event_cap``); ``complete`` is false where that left time over.
    """
    spark, r = history.sparkSession, rates
    cap = event_cap(end - start) if most_events is None else most_events
    past = history.filter(F.col("days") < start).select("id", "days", "latitude", "longitude", "magnitude")
    m = F.col("magnitude")
    own = past.withColumns({"kappa": K.rate_productivity(m, r), "area": F.lit(r.big_d**2) * K.rate_productivity(m, r)})
    if nodes.count() > MOST_NODES:
        raise ValueError(f"a grid of more than {MOST_NODES} nodes")
    held = [tuple(x) for x in nodes.select("cell", "glat", "glon").orderBy("cell").collect()]  # ``MOST_NODES`` at most
    grid = F.lit([lat for _, lat, _ in held]), F.lit([lon for _, _, lon in held])

    def spread(i: Column) -> Column:
        """Density of a source's offspring at a node, by its place in the grid, times the node's area."""
        north, east = (F.element_at(g, i) - F.col(c) for g, c in zip(grid, ("latitude", "longitude")))
        return F.lit((r.q - 1) / math.pi * cell) / F.col("area") * F.pow(1 + (north * north + east * east) / F.col("area"), F.lit(-r.q))

    early, late = (F.pow(1 + (F.lit(x) - F.col("days")) / r.c, F.lit(1 - r.p)) for x in (start, end))
    near = own.withColumns({"early": early, "late": late, "share": F.aggregate(F.sequence(F.lit(1), F.lit(len(held))), F.lit(0.0), lambda a, i: a + spread(i))})
    near = near.withColumn("mean", F.col("kappa") * F.col("share") * (F.col("early") - F.col("late")))
    near = near.withColumn("seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(seeds - 1).cast("long"))))
    # A source's number first, then the node of each of its events: rows are events, not nodes.
    made = near.withColumn("n", poisson(F.col("mean"), seed, F.col("seed"), F.col("id"))).filter("n > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    made = made.withColumn("eid", key_id("node", seed, F.col("seed"), F.col("id"), F.col("k")))
    made = made.withColumn("reach", uniform(seed, F.col("eid"), "node") * F.col("share"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(len(held))), F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at")), lambda a, i: F.struct((a["sum"] + spread(i)).alias("sum"), F.when((a["at"] == 0) & (a["sum"] + spread(i) > F.col("reach")), i).otherwise(a["at"]).alias("at")), lambda a: F.when(a["at"] == 0, len(held)).otherwise(a["at"]))
    made = made.withColumn("node", found)
    left = F.col("early") - uniform(seed, F.col("eid"), "time") * (F.col("early") - F.col("late"))
    node = lambda values: F.element_at(F.lit(values), F.col("node"))
    made = made.select("seed", node([c for c, _, _ in held]).cast("long").alias("cell"), (F.col("days") + r.c * (F.pow(left, F.lit(1 / (1 - r.p))) - 1)).alias("days"), node([x for _, x, _ in held]).alias("latitude"), node([x for _, _, x in held]).alias("longitude"), "eid")
    ground = nodes.withColumn("seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(seeds - 1).cast("long"))))
    ground = ground.withColumn("n", poisson(F.lit(r.mu * cell * (end - start)), seed, F.col("seed"), F.col("cell"), "ground")).filter("n > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    ground = ground.withColumn("eid", key_id("ground", seed, F.col("seed"), F.col("cell"), F.col("k")))
    made = made.unionByName(ground.select("seed", "cell", (F.lit(start) + (end - start) * uniform(seed, F.col("eid"), "time")).alias("days"), F.col("glat").alias("latitude"), F.col("glon").alias("longitude"), "eid"))
    every = spark.range(seeds).select(F.col("id").alias("seed"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        which = int(frame["seed"].iloc[0])
        frame = frame.dropna(subset=["days"]).sort_values(["days", "eid"])
        coming = list(zip(frame["days"], frame["cell"], frame["latitude"], frame["longitude"]))
        cells, lats, lons = (np.array([h[i] for h in held]) for i in range(3))
        out, times, weights, now, draw, k = [], [], [], start, 0, 0

        def decays(x: float) -> np.ndarray:
            return (r.p - 1) / r.c * (1 + (x - np.array(times)) / r.c) ** -r.p

        def add(c: int, lat: float, lon: float) -> None:
            mag = mc - math.log(1 - uniform_of(seed, which, "mag", draw)) / beta
            kappa = math.exp(-r.alpha * (mag - r.m0))
            area = r.big_d**2 * kappa
            out.append((which, int(c), now, lat, lon, mag))
            times.append(now)
            weights.append(kappa * cell * (r.q - 1) / math.pi / area * (1 + ((lats - lat) ** 2 + (lons - lon) ** 2) / area) ** -r.q)

        while len(out) < cap:
            draw += 1
            limit = coming[k][0] if k < len(coming) else end
            count = iter(range(1 << 62))
            sums = np.array([w.sum() for w in weights])
            at = next_event_time(lambda x: float((sums * decays(x)).sum()) if len(sums) else 0.0, now, min(limit, end), lambda: uniform_of(seed, which, "thin", draw, next(count)))  # noqa: B023
            if at is None:
                if k == len(coming):
                    break
                now, c, lat, lon = coming[k]
                k += 1
                add(c, lat, lon)
                continue
            now = at
            reach = np.cumsum((np.array(weights) * decays(now)[:, None]).sum(axis=0))
            i = min(int(np.searchsorted(reach, uniform_of(seed, which, "node", draw) * reach[-1], side="right")), len(cells) - 1)
            add(cells[i], float(lats[i]), float(lons[i]))
        done = pd.DataFrame(out, columns=["seed", "cell", "days", "latitude", "longitude", "magnitude"])
        done["complete"] = len(out) < cap
        return done

    return every.join(made, "seed", "left").groupBy("seed").applyInPandas(run, "seed long, cell long, days double, latitude double, longitude double, magnitude double, complete boolean")


#: Nodes of a grid that every task may hold.
MOST_NODES = 100_000


@dataclass(frozen=True)
class Plane:
    """Of the stepped simulator: background rate per area, productivity K exp(alpha (m - m0)), decay, spread, magnitude law."""

    mu: float
    k: float
    alpha: float
    c: float
    p: float
    d: float
    q: float
    m0: float
    beta: float


def stepped(spark: SparkSession, plane: Plane, end: float, x_range: tuple[float, float], y_range: tuple[float, float], step: float = 0.1, seeds: int = 1, seed: int = SEED) -> DataFrame:
    """Events (seed, t, x, y, m) of a plane's window in time steps: a Poisson number by the rate at each step's start.

    An event is background by its share of the rate, else a parent is drawn by its; events outside the window are lost.
    """
    (x0, x1), (y0, y1) = x_range, y_range
    ground = plane.mu * (x1 - x0) * (y1 - y0)

    def run(batches):
        for batch in batches:
            for which in batch["seed"]:
                t, x, y, w, m = [], [], [], [], []
                for i in range(math.ceil(round(end / step, 9))):
                    now = i * step
                    age = now - np.array(t)
                    parts = np.where(age > 0, np.array(w) * (plane.p - 1) / plane.c * (1 + np.maximum(age, 0.0) / plane.c) ** -plane.p, 0.0)
                    rate = ground + float(parts.sum())
                    reach = np.cumsum(parts)
                    for k in range(poisson_of(rate * step, seed, which, i)):
                        u = lambda use: uniform_of(seed, which, i, k, use)  # noqa: B023, E731
                        if u("kind") * rate < ground or not len(reach):
                            px, py = x0 + (x1 - x0) * u("x"), y0 + (y1 - y0) * u("y")
                        else:
                            j = min(int(np.searchsorted(reach, u("parent") * reach[-1], side="right")), len(reach) - 1)
                            r, angle = plane.d * math.sqrt((1 - u("radius")) ** (1 / (1 - plane.q)) - 1), 2 * math.pi * u("angle")
                            px, py = x[j] + r * math.cos(angle), y[j] + r * math.sin(angle)
                        if x0 <= px <= x1 and y0 <= py <= y1:
                            mag = plane.m0 - math.log(1 - u("mag")) / plane.beta
                            t.append(now + step * u("time"))
                            x.append(px)
                            y.append(py)
                            m.append(mag)
                            w.append(plane.k * math.exp(plane.alpha * (mag - plane.m0)))
                yield pd.DataFrame({"seed": [which] * len(t), "t": t, "x": x, "y": y, "m": m}).astype({"seed": "int64", "t": "float64", "x": "float64", "y": "float64", "m": "float64"})

    ids = spark.range(seeds).select(F.col("id").alias("seed")).repartition(max(1, seeds), "seed")
    return ids.mapInPandas(run, "seed long, t double, x double, y double, m double")


def event_cap(days: float, per_day: float = 3000, absolute: int | None = None) -> int:
    """Most events of a forecast: an absolute number, or so many a day, rounded up."""
    return absolute if absolute is not None else math.ceil(round(days * per_day, 6))


def poisson_counts(means: list[float], seed: int = SEED) -> list[int]:
    return [poisson_of(m, seed, i) for i, m in enumerate(means)]
