"""Sources, pair joins, inversion, simulation, tests and streams on small inputs."""

from __future__ import annotations

import datetime as dt
import itertools
import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tremor import queries as registry
from tremor.functions import geo
from tremor.functions.kernels import Theta
from tremor.operators import filters, ordered, pairs, stats
from tremor.plans import evaluation, inversion, runs, simulation
from tremor.sources import catalog as cat
from tremor.streaming import rates


def distance(a, b):
    la, lo, lb, lp = (math.radians(v) for v in (a[0], a[1], b[0], b[1]))
    h = math.sin((la - lb) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lo - lp) / 2) ** 2
    return 2 * 6378.1 * math.asin(math.sqrt(min(1.0, h)))


@pytest.mark.parametrize("radius", [5.0, 300.0, 4000.0, 25000.0])
def test_range_join_is_the_cross_join(spark, radius):
    rng = np.random.default_rng(1)
    points = [(i, float(la), float(lo)) for i, (la, lo) in enumerate(zip(np.degrees(np.arcsin(rng.uniform(-1, 1, 90))), rng.uniform(-180, 180, 90)))]
    points += [(90, 89.9, 10.0), (91, 89.95, -170.0), (92, 0.0, 179.99), (93, 0.0, -179.99), (94, -90.0, 0.0), (95, 0.001, 179.98)]
    df = spark.createDataFrame(points, "id long, latitude double, longitude double").union(spark.createDataFrame([(999, None, 1.0)], "id long, latitude double, longitude double"))
    got = {(r.source_id, r.target_id) for r in pairs.within_radius(df, df, F.lit(radius)).collect()}
    want = {(a[0], b[0]) for a, b in itertools.product(points, points) if distance(a[1:], b[1:]) <= radius}
    assert got == want


def test_pair_plan_has_no_nested_loop(spark):
    c = cat.from_events(spark.read.parquet(f"{SMALL}/events.parquet"))
    plan = pairs.pair_table(c, registry.START)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_probabilities_sum_to_one(spark):
    p = inversion.prepared(cat.from_events(spark.read.parquet(f"{SMALL}/events.parquet")), registry._setup())
    e = inversion.expectation(p, registry.THETA)
    sums = e.targets.select((F.col("p_background") + F.col("p_triggered")).alias("s")).agg(F.min("s"), F.max("s")).head()
    assert sums[0] == pytest.approx(1.0) and sums[1] == pytest.approx(1.0)


def test_fit_raises_the_likelihood_and_keeps_fixed(spark):
    setup = registry._setup(fixed=("log10_c", "omega", "log10_tau"))
    p = inversion.prepared(cat.from_events(spark.read.parquet(f"{SMALL}/events.parquet")), setup)
    fit = inversion.invert(p, registry.THETA, most=1, steps=2)
    assert fit.theta.omega == registry.THETA.omega and fit.theta.log10_tau == registry.THETA.log10_tau
    values = lambda t: np.array([getattr(t, n) for n in inversion.FREE], float)
    e = inversion.expectation(p, registry.THETA)
    e = inversion.Expected(e.pairs.withColumn("weight", F.col("p") * F.col("zeta")), e.targets, e.sources)
    of = inversion.Objective(e, setup.m_low)
    (old, grad), (new, _) = of(values(registry.THETA)), of(values(fit.theta))
    assert old == pytest.approx(inversion.Objective(e, setup.m_low, held_rows=0)(values(registry.THETA))[0], rel=1e-12)
    for i in range(len(grad)):
        step = 1e-5 * np.eye(len(grad))[i]
        assert grad[i] == pytest.approx((of(values(registry.THETA) + step)[0] - of(values(registry.THETA) - step)[0]) / 2e-5, rel=1e-4, abs=1e-4)
    assert new > old and not fit.converged and set(fit.record()["ranges"]) == set(fit.record()["final_parameters"])


def test_simulation_does_not_depend_on_partitions(spark):
    process = simulation.Process(Theta(log10_k0=-2.6), 2.3, 3.0)
    base = spark.createDataFrame([(i, 100.0 + i / 10, 34.0, -118.0, 4.0 + i % 3) for i in range(30)], "id long, days double, latitude double, longitude double, magnitude double").withColumns({"catalog_id": F.lit(0).cast("long"), "root_id": F.col("id"), "generation": F.lit(0)})
    a = simulation.aftershocks(base, process, 200.0).orderBy("id").collect()
    b = simulation.aftershocks(base.repartition(5, "magnitude"), process, 200.0).orderBy("id").collect()
    assert a == b and a and all(100 < r.days <= 200 for r in a) and all(r.magnitude >= 2.95 for r in a)


def test_background_count_and_place(spark):
    ring = registry.CALIFORNIA
    process = simulation.Process(Theta(log10_mu=-5.0), 2.3, 3.0)
    rows = simulation.background(spark, process, ring, 0.0, 10.0, 500000.0, 40)
    n, inside = rows.count(), filters.in_region(rows, ring).count()
    assert n == inside and abs(n / 40 - 50) < 5


def test_thinning_caps_and_orders(spark):
    h = spark.createDataFrame([(0.0, 34.0, -119.0, 5.0)], "days double, latitude double, longitude double, magnitude double")
    ring = [(33.0, -120.0), (35.0, -120.0), (35.0, -118.0), (33.0, -118.0)]
    process = simulation.Process(Theta(-5.0, None, -2.0, 1.0, -2.0, 0.0, 3.0, -1.0, 1.0, 0.5), 2.3, 3.0)
    rows = simulation.thinned(h.withColumn("id", F.lit(1).cast("long")), process, ring, 1.0, 400.0, 2, 3, resolution=8).toPandas()
    assert (rows.groupby("seed").size() <= 3).all() and len(rows)
    assert (rows.groupby("seed").complete.first() == (rows.groupby("seed").size() < 3)).all()
    for _, g in rows.groupby("seed"):
        assert (g.t.diff().dropna() > 0).all() and (g.t > 1.0).all()


def test_event_cap():
    assert simulation.event_cap(30) == 90000 and simulation.event_cap(30.1) == 90300
    assert simulation.event_cap(10, 100) == 1000 and simulation.event_cap(10, absolute=500) == 500


def test_zone_magnitudes(spark):
    zones = spark.createDataFrame([("a", 3.0, 0.5), ("a", 4.0, 1.0), ("b", 5.0, 1.0)], "zone string, magnitude double, cdf double")
    got = simulation.zone_magnitudes(spark.range(200).withColumn("zone", F.when(F.col("id") % 2 == 0, "a").otherwise("b")), zones).toPandas()
    assert len(got) == 200 and set(got.magnitude) == {3.0, 4.0, 5.0}
    assert simulation.magnitude_generator("no such") is simulation.gutenberg_richter


def test_compensator_is_the_integral_of_the_rate(spark):
    t = Theta(log10_mu=-5.0, omega=0.1)
    ev = spark.createDataFrame([(1, 0.0, 34.0, -118.0, 4.0), (2, 5.0, 34.1, -118.0, 3.0), (3, 6.0, 34.2, -118.1, 3.5)], "id long, days double, latitude double, longitude double, magnitude double")
    got = {r.id: r.increment for r in evaluation.compensators(ev, t, 2.95, 1000.0, 0.0, 4.0, 10.0).collect()}

    def rate(x, past):
        out = t.mu * 1000.0
        for d, m in past:
            if x > d:
                zone = t.d * math.exp(t.gamma * (m - 2.95))
                out += t.k0 * math.exp(t.a * (m - 2.95)) * math.pi / t.rho * zone**-t.rho * math.exp(-(x - d) / t.tau) * (x - d + t.c) ** -(1 + t.omega)
        return out

    def area(a, b, past):
        x = np.linspace(a, b, 40001) if a else None
        x = x if x is not None else np.linspace(a, b, 40001)
        x = a + (b - a) * np.linspace(0, 1, 40001) ** 4
        y = np.array([rate(v, past) for v in x[1:]])
        y = np.concatenate(([rate(x[1], past)], y))
        return float(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum())

    assert got[2] == pytest.approx(area(4.0, 5.0, [(0.0, 4.0)]), rel=1e-3)
    assert got[3] == pytest.approx(area(5.0, 6.0, [(0.0, 4.0), (5.0, 3.0)]), rel=1e-2)


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "c.csv").write_text("id,latitude,longitude,time,magnitude\n1,34.0,-118.0,2000-01-01T00:00:00,3.5\n2,NaN,-118.5,2005-06-01 12:00:00,4.0\n3,1,2,no time,1\n")
    c = cat.read_csv(spark, str(tmp_path / "c.csv")).orderBy("id").collect()
    assert c[0].days == 10957.0 and c[1].latitude is None and c[1].days == pytest.approx(12935.5) and c[2].time is None
    fit = {"final_parameters": {"a": 1.0}, "n_hat": 3.5}
    cat.write_fit(str(tmp_path / "fit"), spark, fit, sources=spark.range(3))
    got, tables = cat.read_fit(str(tmp_path / "fit"), spark, "sources", "pairs")
    assert got == fit and set(tables) == {"sources"} and tables["sources"].count() == 3
    f = spark.createDataFrame([(0, 1.0), (1, 2.0)], "catalog_id long, magnitude double")
    assert cat.append_forecast(f, str(tmp_path / "f")).count() == 2
    new = cat.append_forecast(f.union(spark.createDataFrame([(2, 3.0)], f.schema)), str(tmp_path / "f"))
    assert [tuple(r) for r in new.collect()] == [(2, 3.0)]
    assert cat.read_forecast(spark, str(tmp_path / "f")).count() == 3 and cat.read_forecast(spark, str(tmp_path / "f")).columns == f.columns


def test_forecast_that_was_killed(spark, tmp_path, monkeypatch):
    """An append that ends between its rows and its manifest is not there, and is made again."""
    folder = str(tmp_path / "f")
    f = spark.createDataFrame([(0, 1.0), (1, 2.0), (1, 2.5)], "catalog_id long, magnitude double")
    with pytest.raises(ValueError):
        cat.read_forecast(spark, folder)
    cat.append_forecast(f.filter("catalog_id = 0"), folder)
    with monkeypatch.context() as m:
        written = []
        plain = type(f.write).parquet
        m.setattr(type(f.write), "parquet", lambda self, path, *a, **b: (_ for _ in ()).throw(KeyboardInterrupt()) if path.endswith("_manifest") else written.append(path) or plain(self, path, *a, **b))
        with pytest.raises(KeyboardInterrupt):
            cat.append_forecast(f, folder)
        assert len(written) == 1
    assert spark.read.parquet(folder).count() == 3 and cat.read_forecast(spark, folder).count() == 1
    assert cat.append_forecast(f, folder).count() == 2 and cat.read_forecast(spark, folder).count() == 3
    part = next(p for p in (tmp_path / "f").glob("part=*/bucket=*/*.parquet") if spark.read.parquet(str(p)).filter("catalog_id = 0").count())
    part.unlink()
    with pytest.raises(ValueError, match="manifest"):
        cat.read_forecast(spark, folder)


def test_epoch_catalogs(spark):
    e = spark.createDataFrame([(2, 34.0, -118.0, 4.0), (1, 34.0, -118.0, 3.5), (None, 1.0, 1.0, 1.0)], "time long, latitude double, longitude double, magnitude double")
    rows = cat.from_epoch_catalog(e, 10).orderBy("id").collect()
    assert [r.id for r in rows] == [10, 11, 12] and rows[0].time == "Invalid Time" and rows[1].time == "1970-01-01 00:00:01"
    assert cat.problems(e) == ["column depth is missing", "1 times are null"]
    with pytest.raises(ValueError):
        cat.from_epoch_catalog(e.drop("time"))
    f = e.filter("time IS NOT NULL")
    assert cat.equivalent(f, f.withColumn("magnitude", F.col("magnitude") + 1e-12), "time")
    assert not cat.equivalent(f, f.withColumn("magnitude", F.col("magnitude") + 1e-6), "time") and not cat.equivalent(f, f.limit(1), "time")


def test_event_texts():
    rows = list(cat.parse_event_text("#EventID|Time|Latitude|Longitude|Depth/km|Magnitude\na|2020-01-01T00:00:00|46.1|7.2|5.0|2.5\nb|2020-01-02T00:00:00|46.2|7.3||3.5\n"))
    assert rows == [("a", "2020-01-01T00:00:00", 46.1, 7.2, 5.0, 2.5), ("b", "2020-01-02T00:00:00", 46.2, 7.3, None, 3.5)]
    assert list(cat.parse_quakeml(cat.quakeml([("x", "2020-01-01T00:00:00", 1.0, 2.0, 3.0)]))) == [("x", "2020-01-01T00:00:00", 1.0, 2.0, None, 3.0)]
    assert cat.read_ring("[[35, -120], [34, -119]]") == [(35.0, -120.0), (34.0, -119.0)]
    with pytest.raises(ValueError):
        cat.read_ring("__import__('os')")
    assert cat.fingerprint({"a": 1, "b": 2}) == cat.fingerprint({"b": 2, "a": 1}) != cat.fingerprint({"a": 2})


def test_hull_membership(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.5), (1.5, 0.5, 0.5)], "x double, y double, z double")
    facets = [([1, 0, 0], 1), ([-1, 0, 0], 0), ([0, 1, 0], 1), ([0, -1, 0], 0), ([0, 0, 1], 1), ([0, 0, -1], 0)]
    assert filters.in_hull(df, facets, ["x", "y", "z"]).count() == 1


def test_signed_rank_and_density(spark):
    d = spark.createDataFrame([(x,) for x in (1.0, -1.0, 2.0, 0.0, 3.0)], "d double")
    r = stats.signed_rank(d, "d").head()
    assert (r.w_plus, r.w_minus, r.n) == (8.5, 1.5, 4)
    g = stats.density_on_grid(spark.range(1).select(F.lit(0.0).alias("v")), "v", 0.5, -3.0, 3.0, 61).toPandas()
    assert g.density.sum() * 0.1 == pytest.approx(1.0, abs=1e-3)


def test_streams(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(minutes=10 * i), "r", 2.0 + 0.5 * (i % 3)) for i in range(12)]
    spark.createDataFrame(rows, "time timestamp_ntz, region string, magnitude double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("time timestamp_ntz, region string, magnitude double").parquet(str(tmp_path / "in"))
    timed = rates.with_event_time(stream)
    for name, df, mode in (("w", rates.windowed(timed, "1 hour"), "complete"), ("s", rates.sessions(timed, "30 minutes"), "complete"), ("p", rates.positive_steps(timed), "update")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(f"t_{name}").start()
        q.processAllAvailable()
        q.stop()
    assert [r.n for r in spark.sql("SELECT n FROM t_w ORDER BY start").collect()] == [6, 6]
    assert [r.n for r in spark.sql("SELECT n FROM t_s").collect()] == [12]
    r = spark.sql("SELECT * FROM t_p").collect()[-1]
    assert r.steps == 8 and r.mean_step == pytest.approx(0.5)


def test_trailing_window_plan_and_nearest(spark):
    c = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 1.0), (3, 50.0, 50.0)], "id long, latitude double, longitude double")
    got = {r.id: r.nearest_id for r in pairs.nearest(c, 10.0).collect()}
    assert got == {1: 2, 2: 1, 3: 2}


def test_ordered_windows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(d), float(m)) for i, (d, m) in enumerate(zip(np.round(rng.uniform(0, 12, 200) ** 1.0, 1), np.round(rng.uniform(2, 6, 200), 1)))]
    df = spark.createDataFrame(rows, "id long, days double, magnitude double")
    ranked = sorted(rows, key=lambda r: (r[1], r[0]))
    before = {r.id: r.p for r in ordered.with_previous(df, {"p": F.col("magnitude")}).collect()}
    assert before == {b[0]: a[2] for a, b in zip(ranked, ranked[1:])} | {ranked[0][0]: None}
    sums = {r.id: r.s for r in ordered.with_running_sum(df, F.lit(1), "s").collect()}
    assert sums == {r[0]: i + 1 for i, r in enumerate(ranked)}
    past = {r.id: r.past for r in ordered.with_trailing_count(df, F.col("magnitude") >= 4, 1.5, "past").collect()}
    assert past == {a[0]: sum(b[2] >= 4 and a[1] - 1.5 - 1e-9 <= b[1] < a[1] - 1e-9 for b in rows) for a in rows}


def test_stored_catalogs_and_induced(spark, tmp_path):
    c = spark.createDataFrame([(1, 0.5, 34.0, -118.0, 3.0), (2, 1.5, 34.1, -118.0, 4.0)], "id long, days double, latitude double, longitude double, magnitude double")
    a = cat.find_or_create(c, str(tmp_path), "c")
    assert cat.find_or_create(c, str(tmp_path), "c") == a and cat.find_or_create(c.filter("id = 1"), str(tmp_path), "c") == f"{a}_1"
    cat.write_predictions(c.withColumn("v", F.array(F.lit(1.0))), "v", str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).columns == ["event_index", "time", "longitude", "latitude", "magnitude", "model_prediction"]
    assert cat.column_report(c, c.drop("id").withColumn("z", F.lit(1))) == {"both": ["days", "latitude", "longitude", "magnitude"], "first": ["id"], "second": ["z"]}
    rows = simulation.induced(c, simulation.Process(Theta(log10_iota=1.5), 2.3, 3.0), "magnitude", 0.0, 10.0, 20).toPandas()
    assert abs(len(rows) / 20 - 31.6) < 5 and set(rows.kind) == {"induced"}


def test_ties_of_parameters_hold_at_the_optimum(spark):
    p = inversion.prepared(cat.from_events(spark.read.parquet(f"{SMALL}/events.parquet")), registry._setup(alpha_is_beta=True))
    e = inversion.expectation(p, registry.THETA)
    e = inversion.Expected(e.pairs.withColumn("weight", F.col("p") * F.col("zeta")), e.targets, e.sources)
    t, done = inversion.maximize(e, registry.THETA, p.setup, p.beta)
    assert done and t.a == pytest.approx(p.beta + t.rho * t.gamma)
    best = inversion.log_likelihood(e, t, p.setup.m_low)
    for gamma in (t.gamma - 0.05, t.gamma + 0.05):
        near = Theta(**{**{n: getattr(t, n) for n in inversion.K.NAMES}, "gamma": gamma, "a": p.beta + t.rho * gamma})
        assert inversion.log_likelihood(e, near, p.setup.m_low) < best


def test_free_productivity_recovers_a_law(spark):
    """Sources whose kappas follow a law give the law back; a step of the fit leaves sums of aftershocks right."""
    rows = spark.createDataFrame([(i, 10**-2.0 * math.exp(1.3 * (i % 20) / 10), 3.0 + (i % 20) / 10, 0.0) for i in range(200)] + [(999, 50.0, 3.0, 4.0)], "source_id long, kappa double, source_magnitude double, to_start double")
    a, log10_k0 = inversion.law_of_kappas(rows, 3.0)
    assert a == pytest.approx(1.3, abs=1e-6) and log10_k0 == pytest.approx(-2.0, abs=1e-6)
    p = inversion.prepared(cat.from_events(spark.read.parquet(f"{SMALL}/events.parquet")), registry._setup(free_productivity=True))
    fit = inversion.invert(p, registry.THETA, most=2)
    assert fit.kappa is not None and fit.theta.a != registry.THETA.a
    with pytest.raises(ValueError):
        inversion.prepared(cat.from_events(spark.read.parquet(f"{SMALL}/events.parquet")), registry._setup(free_productivity=True, fixed=("a",)))


def test_polygon_plan_computes_a_point_once(spark):
    df = registry.queries()["polygon_filter"](spark, SMALL)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("get_json_object") <= 2


def test_trailing_plan_has_no_sliding_frame(spark):
    plan = registry.queries()["trailing_seismicity"](spark, SMALL)._jdf.queryExecution().toString()
    assert "specifiedwindowframe(RangeFrame" not in plan


def test_buckets_change_nothing(spark):
    rng = np.random.default_rng(9)
    rows = [(i, float(d), float(m)) for i, (d, m) in enumerate(zip(np.round(rng.exponential(1.0, 300), 2), np.round(rng.uniform(2, 6, 300), 1)))]
    df = spark.createDataFrame(rows, "id long, days double, magnitude double").withColumns({n: F.lit("own") for n in ("_row", "_bucket", "_v", "_at", "_own")})
    for rows_ in (20, 10_000):
        for f, out in ((lambda d, r: ordered.with_previous(d, {"p": F.col("magnitude")}, rows=r), "p"), (lambda d, r: ordered.with_running_sum(d, F.lit(1), "s", rows=r), "s"), (lambda d, r: ordered.with_trailing_count(d, F.col("magnitude") >= 4, 0.2, "n", rows=r), "n")):
            got = f(df, rows_)
            assert got.columns == [*df.columns, out] and got.filter("_row = 'own' AND _v = 'own'").count() == 300
            assert {r.id: r[out] for r in got.collect()} == {r.id: r[out] for r in f(df, 10_000).collect()}


def test_total_of_thinning_is_that_of_branching(spark):
    """Thinning and branching are two ways to one process: their mean numbers agree."""
    ring = [(33.0, -120.0), (35.0, -120.0), (35.0, -118.0), (33.0, -118.0)]
    h = spark.createDataFrame([(1, 0.0, 34.0, -119.0, 6.0)], "id long, days double, latitude double, longitude double, magnitude double")
    process = simulation.Process(Theta(log10_mu=-4.0, log10_k0=-2.9, log10_d=-1.5), 2.3, 3.0)
    area = 40000.0
    n = 60
    a = simulation.forecast(h, process, ring, 1.0, 5.0, simulation.geodesic_area(ring), n).count() / n
    b = simulation.thinned(h, process, ring, 1.0, 6.0, n).count() / n
    assert area and a > 5 and abs(a - b) < 5 * math.sqrt(2 * 3 * a / n)


def test_forecast_parts(spark):
    """Inflated history, induced events and earlier places all take effect, and guards raise."""
    ring = [(33.0, -120.0), (35.0, -120.0), (35.0, -118.0), (33.0, -118.0)]
    h = spark.createDataFrame([(i, 0.0, 34.0, -119.0, 5.5) for i in range(20)], "id long, days double, latitude double, longitude double, magnitude double")
    process = simulation.Process(Theta(log10_mu=-4.5, log10_k0=-3.4, log10_iota=0.5), 2.3, 3.0)
    plain = simulation.forecast(h, process, ring, 1.0, 5.0, 40000.0, 4).count()
    more = simulation.forecast(h.withColumn("xi", F.lit(4.0)), process, ring, 1.0, 5.0, 40000.0, 4, xi="xi").count()
    sites = simulation.induced(h.limit(3).withColumn("w", F.lit(1.0)), process, "w", 1.0, 6.0, 4, expected=10.0)
    kinds = {r[0] for r in simulation.forecast(h, process, ring, 1.0, 5.0, 40000.0, 4, induced_events=sites).select("kind").distinct().collect()}
    assert more > plain and "induced" in kinds
    places = spark.createDataFrame([(1, 34.5, -118.5, 1.0)], "id long, latitude double, longitude double, probability double")
    put = simulation.forecast(h, process, ring, 1.0, 5.0, 40000.0, 4, places=places, place_scale=0.0).filter("kind = 'background'")
    assert {(r.latitude, r.longitude) for r in put.collect()} == {(34.5, -118.5)}
    with pytest.raises(ValueError):
        simulation.empirical_places(h, places.withColumn("probability", F.lit(1.5)), "probability")
    with pytest.raises(RuntimeError):
        simulation.cascade(simulation.background(spark, process, ring, 0.0, 5.0, 40000.0), process, 5.0, most=0)
    with pytest.raises(ValueError):
        simulation.prepared_history(spark.createDataFrame([(99,)], "source_id long"), h, 5.5)
    with pytest.raises(ValueError):
        simulation.prepared_history(h.select(F.col("id").alias("source_id")), h, 3.0)
    assert simulation.prepared_history(h.select(F.col("id").alias("source_id")), h, 5.5).filter("xi_plus_1 = 1").count() == 20


def test_shares_converge(spark):
    ring = [(33.0, -120.0), (35.0, -120.0), (35.0, -118.0), (33.0, -118.0)]
    t = Theta()
    fine = simulation.space_share(ring, 34.9, -118.1, 5.0, t, 2.95, 400)
    errors = [abs(simulation.space_share(ring, 34.9, -118.1, 5.0, t, 2.95, n) / fine - 1) for n in (10, 40, 160)]
    assert errors[2] < 0.005 and errors[2] < errors[0]
    inside = simulation.space_share(ring, 34.0, -119.0, 3.0, t, 2.95, 100)
    assert inside == pytest.approx(t.k0 * math.exp(t.a * 0.05) * math.pi / t.rho * (t.d * math.exp(t.gamma * 0.05)) ** -t.rho, rel=0.05)


def test_hulls_and_rings(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(200, 2))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in points], "latitude double, longitude double").repartition(5)
    ring = cat.ring_of(df)
    assert filters.in_region(df, ring).count() == 200
    assert cat.ring_of(df.withColumn("longitude", F.lit(1.0)))[0][1] == 1.0 and len(cat.ring_of(df.withColumn("longitude", F.lit(1.0)))) == 4
    np.save("/tmp/tremor-ring.npy", np.array(ring))
    assert cat.read_ring("/tmp/tremor-ring.npy") == [tuple(p) for p in ring]


def test_differences(spark):
    a = spark.createDataFrame([(1, 2.0), (None, 3.0), (4, float("nan"))], "id long, v double")
    assert cat.equivalent(a, a, "id") and cat.equivalent(a, a) and not cat.equivalent(a, a.filter("id = 1"), "id")
    assert cat.differences(a, a.withColumn("v", F.col("v") + 1), "id").count() == 2


def test_traces(spark, tmp_path):
    c = spark.createDataFrame([(1, 0.5, 3.0)], "id long, days double, magnitude double")
    cat.log_parameters("here", {"a": float("nan")}, str(tmp_path / "p.jsonl"), mc=3.0)
    cat.log_parameters("here", None, None)
    assert (tmp_path / "p.jsonl").read_text() == '{"site": "here", "parameters": {"a": null}, "mc": 3.0}\n'
    for _ in range(2):
        cat.log_events("here", c, str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).count() == 2


def test_quakeml_files(spark, tmp_path):
    c = spark.createDataFrame([(1, 0.5, 34.0, -118.0, 3.0, 7.5), (2, 1.5, None, -118.0, 4.0, None)], "id long, days double, latitude double, longitude double, magnitude double, depth double")
    cat.write_quakeml(c, str(tmp_path / "q"))
    got = sorted((r.event_id, r.days, r.latitude, r.magnitude, r.depth) for r in cat.read_quakeml(spark, str(tmp_path / "q" / "part-*")).collect())
    assert got == [("1", 0.5, 34.0, 3.0, 7.5), ("2", 1.5, None, 4.0, None)]


def test_service_years():
    reader = cat._TextServiceReader({"start": "1990", "end": "1991", "url": ""})
    assert [p.value for p in reader.partitions()] == [("1990-01-01", "1991-01-01"), ("1991-01-01", "1992-01-01")]
    reader = cat._TextServiceReader({"start": "1990-06-01", "end": "1991-02-01", "url": ""})
    assert [p.value for p in reader.partitions()] == [("1990-06-01", "1991-01-01"), ("1991-01-01", "1991-02-01")]


def test_service_through_spark(spark, tmp_path):
    (tmp_path / "1990-01-01.txt").write_text("#EventID|Time|Latitude|Longitude|Depth/km|Magnitude\nb|1990-03-01T00:00:00|46.1|7.2|5.0|2.5\na|1990-02-01T00:00:00|46.1|7.2||3.5\n")
    rows = cat.read_service(spark, url=f"file://{tmp_path}/{{start}}.txt", start="1990", end="1990").collect()
    assert [r.event_id for r in rows] == ["a", "b"] and rows[0].days == 7336.0


def _exchanged(plan: str) -> list[str]:
    """What stands right below each exchange of rows that are not sums yet."""
    lines = plan.splitlines()
    return [lines[i + 1] for i, line in enumerate(lines[:-1]) if " Exchange hashpartitioning" in line and "partial_" not in lines[i + 1]]


def test_pairs_are_not_exchanged(spark):
    """An expectation step reads pairs in buckets of targets: a window and two sums, and no exchange of pairs."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        p = inversion.prepared(registry.events(spark, SMALL), registry._setup(buckets=6))
        e = inversion.expectation(p, registry.THETA)
        for frame in (e.pairs, e.pairs.groupBy("target_id").sum("p")):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Window" in plan
        for frame in (e.targets, e.sources):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert not [x for x in _exchanged(plan) if "time_distance" in x]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_an_iteration_passes_over_the_pairs_once(spark, monkeypatch):
    """What targets and sources are summed from is written, so the window over the pairs is worked out once an iteration; tables go with their iteration."""
    p = inversion.prepared(registry.events(spark, SMALL), registry._setup())
    made, kept = [], []
    whole = inversion.probabilities
    monkeypatch.setattr(inversion, "probabilities", lambda *a: made.append(1) or whole(*a))
    gathered = inversion.gathered
    monkeypatch.setattr(inversion, "gathered", lambda p, pij, t, mu=None: kept.append("Window" in pij._jdf.queryExecution().executedPlan().toString()) or gathered(p, pij, t, mu))
    before = {t.name for t in spark.catalog.listTables()}
    fit = inversion.invert(p, registry.THETA, most=2, steps=3)
    assert len(made) == len(kept) == 3 and not any(kept)
    assert len({t.name for t in spark.catalog.listTables()} - before) == 1 and fit.expected.pairs.count() > 0


def test_sign_flips_are_spread(spark, monkeypatch):
    """Draws are dealt to many tasks, and both ways give the same mean and p."""
    df = spark.createDataFrame([(i, float((i * 7) % 11 - 4)) for i in range(60)] + [(99, None)], "k long, d double")
    few = stats.sign_flips(df, "k", "d", 400)
    assert "Range (0, 400" in few._jdf.queryExecution().toString()
    monkeypatch.setattr(stats, "HELD_DIFFERENCES", 10)
    assert few.head() == stats.sign_flips(df, "k", "d", 400).head() and 0 < few.head().p < 1


def test_curvature(spark):
    """Value and gradient are the objective's; the information is the mean curvature of a simulated fit, and so are its errors."""
    p = inversion.prepared(registry.events(spark, SMALL), registry._setup())
    e = inversion.expectation(p, registry.THETA)
    e = inversion.Expected(e.pairs.withColumn("weight", F.col("p") * F.col("zeta")), e.targets, e.sources)
    found = inversion.curvature(e, registry.THETA, p.setup.m_low)
    value, gradient = inversion.Objective(e, p.setup.m_low)(np.array([getattr(registry.THETA, n) for n in inversion.FREE]))
    assert found.value == pytest.approx(value) and found.gradient == pytest.approx(gradient, rel=1e-9)
    assert found.information == pytest.approx(found.information.T) and np.linalg.eigvalsh(found.information).min() > -1e-6
    assert {"omega", "rho"} <= set(found.standard_errors(p.setup)) and "omega" not in found.standard_errors(replace(p.setup, fixed=("omega",)))

    rng, t, n = np.random.default_rng(7), Theta(log10_tau=math.inf, omega=0.4, log10_k0=-1.0), 60_000
    m = 3.0 + np.round(rng.exponential(0.4, n), 1)
    dt = t.c * ((1 - rng.uniform(size=n)) ** (-1 / t.omega) - 1)
    zone = t.d * np.exp(t.gamma * (m - 3.0))
    r2 = zone * ((1 - rng.uniform(size=n)) ** (-1 / t.rho) - 1)
    at = np.array([getattr(t, k) for k in inversion.FREE])
    info = inversion.pair_information(at, m, dt, r2, np.ones(n), 3.0)[9:].reshape(8, 8)
    free = [2, 3, 5, 6, 7]
    errors = np.sqrt(np.diag(np.linalg.inv(info[np.ix_(free, free)])))
    for i, k in enumerate(free):  # the observed curvature, by differences of the gradient
        up, down = at.copy(), at.copy()
        up[k] += 1e-4
        down[k] -= 1e-4
        bend = -(inversion.pair_terms(up, m, dt, r2, np.ones(n), 3.0) - inversion.pair_terms(down, m, dt, r2, np.ones(n), 3.0))[1:] / 2e-4
        assert bend[free] == pytest.approx(info[k, free], rel=0.05, abs=0.02 * info[k, k])
    values = at.copy()
    for _ in range(8):  # the fit lies within a few of its errors of the truth
        g = inversion.pair_information(values, m, dt, r2, np.ones(n), 3.0)
        values[free] += np.linalg.solve(g[9:].reshape(8, 8)[np.ix_(free, free)], g[1:9][free])
    assert (np.abs(values - at)[free] < 4 * errors).all() and (np.abs(values - at)[free] > 0).all()


def test_hull_in_space(spark, monkeypatch):
    """Partial hulls merged as a tree give the facets' volume and membership of all points at once."""
    rng = np.random.default_rng(9)
    for points in (rng.normal(size=(500, 3)), rng.integers(0, 4, size=(500, 3)).astype(float), np.concatenate((rng.normal(size=(300, 3)) * 1e-3, np.eye(3), -np.eye(3)))):
        kept = geo.extreme_points(points)
        facets, volume = geo.hull_facets(kept)
        assert volume == pytest.approx(geo.hull_facets(points)[1], rel=1e-9)
        assert max((points @ np.array(n)).max() - o for n, o in facets) < 1e-8 and len(kept) < len(points)
    square = np.array([(x, y, 2.0) for x in range(6) for y in range(6)])
    assert {tuple(p) for p in geo.extreme_points(square)} == {(0, 0, 2), (5, 0, 2), (0, 5, 2), (5, 5, 2)}
    assert len(geo.extreme_points(np.array([(i, 2.0 * i, 0.0) for i in range(50)]))) < 12 and len(geo.extreme_points(np.ones((9, 3)))) == 1
    points = rng.normal(size=(3000, 3))
    df = spark.createDataFrame([(*map(float, p),) for p in points] + [(None, 1.0, 1.0)], "a double, b double, c double").repartition(9)
    monkeypatch.setattr(filters, "FAN", 3)
    facets, volume = filters.hull_of(df, ["a", "b", "c"])
    want = geo.hull_facets(geo.extreme_points(points))
    assert volume == pytest.approx(want[1], rel=1e-9) and filters.in_hull(df, facets, ["a", "b", "c"]).count() == 3000
    with pytest.raises(ValueError):
        filters.hull_of(df.limit(0), ["a", "b", "c"])


def test_grids_as_tables(spark):
    ring = [(33.0, -120.0), (35.0, -120.0), (34.5, -118.0), (33.0, -118.5)]
    nodes, facts = runs.grid_at_density(spark, ring, 0.02)
    held, same = runs.grid_in_ring(ring, 0.02)
    assert facts["found"] == nodes.count() and facts["shape"] == same["shape"]
    made = {(round(r.latitude, 9), round(r.longitude, 9)) for r in nodes.collect()}
    assert len(made ^ {(round(a, 9), round(b, 9)) for a, b in held}) <= 3  # nodes on an edge may fall on either side
    assert "LocalTableScan" not in nodes._jdf.queryExecution().executedPlan().toString()
    rng = np.random.default_rng(10)
    places = [(float(a), float(b)) for a, b in zip(rng.uniform(32.5, 35.5, 2000), rng.uniform(-120.5, -117.5, 2000))]
    events = spark.createDataFrame([*places, (None, 1.0)], "latitude double, longitude double")
    got = {(r.i, r.j): r.n for r in runs.node_counts(events, ring, (9, 11)).collect()}
    known = {(r.i, r.j): (r.latitude, r.longitude) for r in runs.grid_table(spark, ring, (9, 11)).collect()}
    want: dict = {}
    for a, b in places:
        at = round((a - 33.0) / 0.25), round((b + 120.0) / 0.2)
        if at in known:
            want[at] = want.get(at, 0) + 1
    assert got == want
    for bad in (lambda: runs.grid_at_density(spark, ring, 0.0), lambda: runs.grid_table(spark, ring, (1, 5))):
        with pytest.raises(ValueError):
            bad()


@pytest.fixture
def service():
    """A web service with an event an hour of January 2020 and none in 2021, which notes what it is asked."""
    import http.server
    import threading
    from urllib.parse import parse_qs, urlparse

    events = [(dt.datetime(2020, 1, 1) + dt.timedelta(hours=h), 2 + h % 30 / 10) for h in range(31 * 24)]
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            url = urlparse(self.path)
            q = {k: v[0] for k, v in parse_qs(url.query).items()}
            a, b = (dt.datetime.fromisoformat(q[k]) for k in ("start", "end"))
            rows = [(t, m) for t, m in events if a <= t < b and m >= float(q["min"])]
            asked.append((url.path, q["start"], q["end"], float(q["min"]), len(rows)))
            text = str(len(rows)) if url.path == "/count" else "#EventID|Time|Latitude|Longitude|Depth/km|Magnitude\n" + "".join(f"e{t:%d%H}|{t.isoformat()}|34.0|-118.0|5|{m:.1f}\n" for t, m in rows)
            self.send_response(200 if rows or url.path == "/count" else 204)
            self.end_headers()
            self.wfile.write(text.encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    query = "?start={start}&end={end}&min={minmag}"
    yield {"url": f"{base}/query{query}", "count_url": f"{base}/count{query}", "start": "2020", "end": "2021"}, asked
    server.shutdown()


def test_full_years_are_many_tasks(spark, service):
    options, asked = service
    rows = cat.read_service(spark, **options, most="100").collect()
    queries = [x for x in asked if x[0] == "/query"]
    assert len(rows) == 31 * 24 and len({r.event_id for r in rows}) == 31 * 24
    assert len({x[1:3] for x in queries}) > 7 and max(x[4] for x in queries) <= 100
    whole = {k: v for k, v in options.items() if k != "count_url"}
    asked.clear()
    assert cat.read_service(spark, **whole).count() == 31 * 24 and {x[0] for x in asked} == {"/query"} and len({x[1:3] for x in asked}) == 2


def test_filters_reach_the_service(spark, service):
    options, asked = service
    spark.dataSource.register(cat.TextServiceSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        load = lambda: spark.read.format("fdsn_text").options(**options, pushdown="true").load()
        got = load().filter("magnitude >= 4.0 AND time >= '2020-01-10' AND time < '2020-01-20T12:00:00' AND event_id <> 'e1010'").collect()
        queries = [x for x in asked if x[0] == "/query"]
        assert {x[1:4] for x in queries} == {("2020-01-10", "2020-01-20T12:00:00", 4.0)}
        assert got and all(r.magnitude >= 4 and "2020-01-10" <= r.time < "2020-01-20T12" and r.event_id != "e1010" for r in got)
        assert len(got) in (max(x[4] for x in queries) - 1, max(x[4] for x in queries))
        asked.clear()
        assert load().filter("time < 'soon' OR magnitude > 4.5").count() == 31 * 24 and {x[3] for x in asked} == {-10.0}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
