"""Closed forms, numeric checks and invariants."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremor.functions import geo, params, rng, special
from tremor.functions import kernels as K
from tremor.functions.kernels import Theta


def integral(f, a, b, n=40001):
    x = np.exp(np.linspace(math.log(a), math.log(b), n))
    y = f(x) * x
    return (math.log(b) - math.log(a)) / (n - 1) / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())


@pytest.mark.parametrize("a", [2.3, 0.5, 0.02, 1e-7, 0.0, -1e-6, -0.02, -0.3, -0.7, -1.5])
@pytest.mark.parametrize("x", [1e-6, 1e-3, 0.5, 1.4, 1.6, 5.0, 20.0])
def test_upper_gamma_is_its_integral(a, x):
    want = integral(lambda t: t ** (a - 1) * np.exp(-t), x, x + 60)
    assert float(special.upper_gamma(a, np.array([x]))[0]) == pytest.approx(want, rel=1e-6)


def test_inverse_upper_gamma():
    x = np.array([1e-5, 0.1, 3.0])
    assert special.inverse_upper_gamma(0.02, special.upper_gamma(0.02, x)) == pytest.approx(x, rel=1e-9)


def test_gammaln():
    assert special.gammaln(np.array([1.0, 2.0, 3.5, 10.0])) == pytest.approx([math.lgamma(v) for v in (1, 2, 3.5, 10)], abs=1e-12)


def test_tapered_integral_and_delays():
    t = Theta()
    want = integral(lambda x: np.exp(-x / t.tau) * (x + t.c) ** -(1 + t.omega), 1e-9, 20.0) + 1e-9 * t.c ** -(1 + t.omega)
    assert float(special.tapered_time_integral(np.array([0.0]), np.array([20.0]), t.c, t.omega, t.tau)[0]) == pytest.approx(want, rel=1e-5)
    delays = special.tapered_delay_of(np.array([0.0, 0.3, 0.9]), t.c, t.omega, t.tau)
    part = special.tapered_time_integral(np.zeros(3), delays, t.c, t.omega, t.tau) / special.tapered_time_integral(np.zeros(3), None, t.c, t.omega, t.tau)
    assert part == pytest.approx([0.0, 0.3, 0.9], abs=1e-9)


def test_areas():
    ring = [(33.0, -120.0), (35.0, -120.0), (35.0, -118.0), (33.0, -118.0)]
    assert geo.albers_area(ring) == pytest.approx(geo.geodesic_area(ring), rel=5e-3)
    octant = [(0.0, 0.0), (0.0, 90.0), (89.9999, 45.0)]
    assert geo.geodesic_area(octant, 2000) == pytest.approx(510_065_621 / 8, rel=1e-3)
    assert geo.globe_area() == pytest.approx(4 * math.pi * 6378.1**2)


def test_hull_and_rings():
    square = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)]
    assert sorted(geo.convex_hull([*square, (0.5, 0.5), (0.5, 0.0)])) == sorted(square)
    doubled = geo.scaled_ring(square, 2.0)
    assert geo._shoelace(doubled) == pytest.approx(2.0)
    assert geo._shoelace(geo.scaled_ring(square, 9.0, (0.0, 1.0, 0.0, 1.0))) == pytest.approx(1.0)
    assert np.allclose(geo.expanded_ring(square, 0.0), square)
    assert geo.utm_zone(34.0, -119.0) == 32611 and geo.utm_zone(-1.0, 3.0) == 32731


def test_polygon_boundary(spark):
    ring = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    df = spark.createDataFrame([(1.0, 1.0), (0.0, 1.0), (2.0, 2.0), (3.0, 1.0), (None, 1.0)], "lat double, lon double")
    flags = df.select(geo.in_polygon(F.col("lat"), F.col("lon"), ring).alias("a"), geo.in_polygon(F.col("lat"), F.col("lon"), ring, boundary=False).alias("b")).collect()
    assert [r.a for r in flags[:4]] == [True, True, True, False] and [r.b for r in flags[:4]] == [True, False, False, False]
    assert not flags[4].a


def test_parameters():
    t = Theta()
    assert t.alpha == pytest.approx(1.8 - 0.66 * 1.3)
    assert Theta.of(t.values()) == t and Theta.of({"log10_mu": -5.0}).a is None
    assert t.distance(Theta(a=2.0)) == pytest.approx(0.2)
    assert K.expanded({"log10_mu": -2.0, "a": 3.0, "log10_c": None}) == {"mu": 0.01, "a": 3.0, "c": None}
    with pytest.raises(ValueError):
        params.magnitude_integral(0.1)
    assert params.magnitude_integral(-2.0) == 0.5 and params.magnitude_integral(0.0, 3.0) == 3.0


def test_branching_ratio_is_the_mean_offspring():
    t = Theta(log10_k0=-3.2)
    dm = np.linspace(0, 25, 100001)
    time = float(special.tapered_time_integral(np.array([0.0]), None, t.c, t.omega, t.tau)[0])
    n = t.k0 * np.exp(t.a * dm) * math.pi / t.rho * (t.d * np.exp(t.gamma * dm)) ** -t.rho * time
    y = n * 2.3 * np.exp(-2.3 * dm)
    want = float(((y[1:] + y[:-1]) / 2 * np.diff(dm)).sum())
    assert params.branching_ratio(t, 2.3) == pytest.approx(want, rel=1e-3)


def test_standard_formulation_has_the_same_rate():
    t = params.from_normalized(1e-6, 0.3, 1.1, 0.01, 1.2, 0.5, 1.0, 1.5)
    dm, dt, r2 = 1.3, 0.7, 4.0
    zone = 0.5 * math.exp(dm)
    want = 0.3 * math.exp(1.1 * dm) * 0.2 / 0.01 * (1 + dt / 0.01) ** -1.2 * 0.5 / (math.pi * zone) * (1 + r2 / zone) ** -1.5
    got = t.k0 * math.exp(t.a * dm) * (dt + t.c) ** -(1 + t.omega) * (r2 + t.d * math.exp(t.gamma * dm)) ** -(1 + t.rho)
    assert got == pytest.approx(want)


def test_productivity_law():
    dm = np.linspace(0, 3, 31)
    a, k0 = params.productivity_law(10**-2.5 * np.exp(1.7 * dm), dm)
    assert (a, k0) == (pytest.approx(1.7), pytest.approx(-2.5))


def test_random_numbers(spark):
    assert rng.uniform_of(1905, 7, 1) == 0.31126742784847194
    df = spark.range(4000)
    got = df.select(rng.uniform(1905, F.col("id"), 1).alias("u"), rng.normal(1, F.col("id")).alias("z"), rng.poisson(F.lit(3.0), 2, F.col("id")).alias("n"), rng.poisson(F.lit(200.0), 3, F.col("id")).alias("m")).toPandas()
    assert got.u.iloc[7] == 0.31126742784847194
    assert abs(got.z.mean()) < 0.06 and abs(got.z.std() - 1) < 0.05
    assert abs(got.n.mean() - 3) < 0.12 and abs(got.n.var() - 3) < 0.3 and abs(got.m.mean() - 200) < 1.0
    same = df.repartition(7).select("id", rng.uniform(1905, F.col("id"), 1).alias("u")).orderBy("id").toPandas()
    assert (same.u == got.u).all()


def test_approximate_delay_is_continuous(spark):
    t = Theta(omega=0.1, log10_tau=2.0)
    df = spark.range(1, 1000).select((F.col("id") / 1000).alias("u"))
    x = df.select(K.approximate_delay_of(F.col("u"), t).alias("d")).toPandas().d.to_numpy()
    assert (np.diff(x) > 0).all() and x[0] >= 0


def test_kumaraswamy_inverse(spark):
    df = spark.range(1, 10).select((F.col("id") / 10).alias("p"))
    x = df.select("p", K.kumaraswamy_inverse(F.col("p"), F.lit(2.0), F.lit(3.0)).alias("u")).toPandas()
    assert np.allclose(1 - (1 - x.u**2) ** 3, x.p)


def test_binning_never_rounds_to_even(spark):
    df = spark.createDataFrame([(-2.5,), (2.45,), (3.05,)], "x double")
    assert [r[0] for r in df.select(K.binned(F.col("x"), 1.0)).collect()] == [-2.0, 2.0, 3.0]


def test_kolmogorov_p():
    assert special.kolmogorov_p(0.0, 10) == 1.0 and special.kolmogorov_p(0.5, 100) < 1e-10
    assert special.normal_p(1.959964) == pytest.approx(0.05, abs=1e-6)


@pytest.mark.parametrize("mean", [3.0, 59.0, 60.0, 500.0])
def test_poisson_is_exact(spark, mean):
    """Counts against the exact distribution: mean, variance and shares of quarters."""
    n = 20_000
    got = np.array([r[0] for r in spark.range(n).select(rng.poisson(F.lit(mean), "t", F.col("id"))).collect()])
    assert abs(got.mean() - mean) < 5 * math.sqrt(mean / n) and abs(got.var() / mean - 1) < 0.06
    k = np.arange(int(mean + 20 * math.sqrt(mean) + 30))
    cdf = np.cumsum(np.exp(k * math.log(mean) - mean - np.array([math.lgamma(i + 1) for i in k])))
    for q in (0.25, 0.5, 0.75):
        at = int(np.searchsorted(cdf, q))
        assert abs((got <= at).mean() - cdf[at]) < 5 * math.sqrt(0.25 / n)
    assert [rng.poisson_of(mean, "t", i) for i in range(50)] == [r[0] for r in spark.range(50).select("id", rng.poisson(F.lit(mean), "t", F.col("id")).alias("n")).orderBy("id").select("n").collect()]


def test_approximate_delays_have_their_density(spark):
    for omega in (0.1, 0.0, -0.2):
        t = Theta(omega=omega, log10_tau=1.0)
        body = integral(lambda x: (x + t.c) ** -(1 + omega), 1e-9, t.tau)
        tail = integral(lambda x: (t.tau + t.c) ** -(1 + omega) * np.exp(1 - x / t.tau), t.tau, 60 * t.tau)
        share = body / (body + tail)
        for u in (0.2, 0.9 * share, share + 0.3 * (1 - share), share + 0.9 * (1 - share)):
            x = spark.range(1).select(K.approximate_delay_of(F.lit(u), t)).head()[0]
            mass = integral(lambda y: (y + t.c) ** -(1 + omega), 1e-9, min(x, t.tau))
            if x > t.tau:
                mass += integral(lambda y: (t.tau + t.c) ** -(1 + omega) * np.exp(1 - y / t.tau), t.tau, x)
            assert mass / (body + tail) == pytest.approx(u, rel=2e-3)


@pytest.mark.parametrize("dm_max", [None, 5.0])
def test_reference_change_keeps_the_branching_ratio(dm_max):
    t = Theta(omega=0.1)
    up = params.at_reference(t, 2.3, 0.5, dm_max)
    assert params.branching_ratio(up, 2.3, None if dm_max is None else dm_max - 0.5) == pytest.approx(params.branching_ratio(t, 2.3, dm_max))
    assert params.at_reference(up, 2.3, -0.5, None if dm_max is None else dm_max - 0.5).values()[2:] == pytest.approx(t.values()[2:])


def test_rate_parameters_keep_productivity_and_zone():
    t = Theta(log10_k0=-2.0, omega=0.1)
    r, other = params.to_rate_params(t, 3.0), params.to_rate_params(Theta(log10_k0=-1.0, omega=0.1), 3.0)
    assert math.exp(-r.alpha * (4.2 - r.m0)) == pytest.approx(t.k0 * math.exp(t.a * 1.2)) and r != other
    assert r.big_d**2 * math.exp(-r.alpha * (3.0 - r.m0)) == pytest.approx(t.d)
    with pytest.raises(ValueError):
        params.to_rate_params(Theta(a=0.0), 3.0)


def test_places_fill_a_thin_ring(spark):
    ring = [(0.0, 0.0), (10.0, 10.0), (10.0, 10.001), (0.0, 0.001)]
    p = spark.range(2000).select(geo.place_in_ring(ring, rng.uniform(F.col("id"), "a"), rng.uniform(F.col("id"), "b"), rng.uniform(F.col("id"), "c")).alias("p")).select("p.lat", "p.lon").toPandas()
    assert len(p) == 2000 and p.lat.nunique() == 2000 and abs(p.lat.mean() - 5) < 0.3 and (p.lon - p.lat).between(-1e-9, 0.001 + 1e-9).all()
    with pytest.raises(ValueError):
        geo.triangles([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)])


def test_utm_round_trip():
    lat, lon = np.array([34.0, 46.5, -33.0]), np.array([-118.2, -115.0, -119.9])
    x, y = geo.transverse_mercator(lat, lon, 32611)
    assert (x[0], y[0]) == pytest.approx((389179.5, 3762805.0), abs=1.0)  # published tables give metres
    back = geo.from_transverse_mercator(x, y, 32611)
    assert back[0] == pytest.approx(lat, abs=1e-8) and back[1] == pytest.approx(lon, abs=1e-8)


def test_scaled_ring_keeps_area_within_a_box():
    ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)]
    out = geo.scaled_ring(ring, 2.0, (-0.1, 5.0, -5.0, 5.0))
    assert geo._shoelace(out) == pytest.approx(2.0, rel=1e-6) and min(p[0] for p in out) >= -0.1 - 1e-9
    assert geo._shoelace(geo.scaled_ring(ring, 2.0, (0.0, 1.1, 0.0, 1.1))) == pytest.approx(1.21, rel=1e-3)
    assert geo.scaled_ring([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)], 2.0, (0.0, 2.0, 0.0, 2.0))[2] == (2.0, 2.0)


def test_boundary_distance(spark):
    d = spark.range(1).select(geo.boundary_distance(F.lit(0.5), F.lit(0.5), [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)])).head()[0]
    assert d == pytest.approx(0.5 * 111.3, rel=1e-2)
    assert geo.expanded_ring([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)], 50.0)[0][0] < 0


@pytest.mark.parametrize("a", [0.02, 0.0, 1e-9, -1e-6, -0.1, -0.5, -0.7, -0.99, 0.9, -1.3])
def test_gamma_columns(spark, a):
    """The expressions against the array forms, and the inverse against the function."""
    x = np.concatenate((np.exp(np.linspace(-18, 4, 200)), [2.999999, 3.0, 3.000001]))
    y = special.upper_gamma(a, x)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double").coalesce(1)
    got = np.array([r.g for r in df.select(special.upper_gamma_of(a, F.col("x")).alias("g")).collect()])
    assert np.abs(got / y - 1).max() < (1e-11 if a > -1 and (a == 0 or abs(a) > 1e-5 or abs(a) < 1e-8) else 2e-10)
    if a > -1:
        back = np.array([r.x for r in df.select(special.inverse_upper_gamma_of(a, F.col("y")).alias("x")).collect()])
        assert np.abs(back / x - 1).max() < 2e-9
    else:
        with pytest.raises(ValueError):
            special.inverse_upper_gamma_of(a, F.col("y"))


def test_tapered_columns_have_no_python(spark):
    t = Theta()
    df = spark.range(5).select((F.col("id") / 5).alias("u"))
    plan = df.select(special.delay_of(F.col("u"), t.c, t.omega, t.tau), special.time_integral(F.lit(0.0), F.col("u"), t.c, t.omega, t.tau))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    got = [r[0] for r in df.select(special.delay_of(F.col("u"), t.c, t.omega, t.tau)).collect()]
    assert got == pytest.approx(special.tapered_delay_of(np.arange(5) / 5, t.c, t.omega, t.tau).tolist(), rel=1e-8, abs=1e-12)
