"""Results that larger and odd tables got wrong."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest

from tests.conftest import MIDDLE, SMALL
from tests.helpers import canonical
from tremor import queries as registry
from tremor.operators import stats


def rows_of(spark, tmp_path, name: str, events: str):
    """Rows of a query and of its SQL where ``events`` is SQL's VALUES of (ts, user_id, value, k)."""
    con = duckdb.connect()
    con.execute(f"CREATE TABLE events AS SELECT CAST(row_number() OVER () AS BIGINT) AS event_id, CAST(ts AS TIMESTAMP) AS ts, CAST(user_id AS BIGINT) AS user_id, 'view' AS event_type, CAST(value AS DOUBLE) AS value, '{{\"k\": ' || k || '}}' AS props FROM (VALUES {events}) AS v(ts, user_id, value, k)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    return canonical(registry.queries()[name](spark, str(tmp_path)).toPandas()), canonical(con.execute(registry.oracle_sql()[name]).df())


#: On the eastern edge of the ring, at longitude -119: users 0 to 60 of one longitude.
EAST = ", ".join(f"('2024-01-10 00:00:00', {23 + 53 * i}, 100.0, 90), ('2024-01-10 00:00:00', {22 + 53 * i}, 100.0, 90)" for i in range(61))


@pytest.mark.parametrize("name", ["polygon_filter", "forecast_rows", "first_in_region"])
def test_points_on_the_ring(spark, tmp_path, name):
    got, want = rows_of(spark, tmp_path, name, EAST)
    assert got == want and 0 < len(got) < 122


def test_quantile_counts_ties(spark):
    """Statistics that only the rounding of sums tells apart are equal; infinite ones stay apart."""
    of = lambda *x: spark.createDataFrame([(v,) for v in x], "l double")
    assert stats._quantile(of(0.1 + 0.2, 0.4), of(0.3), "l").head() == (0.5, 0.3)
    assert stats._quantile(of(-math.inf, -4.0), of(-math.inf), "l").head() == (0.5, -math.inf)


@pytest.mark.parametrize("name", ["hull_filter", "magnitude_histogram", "normalized_magnitudes"])
def test_events_on_edges_and_beyond(spark, tmp_path, name):
    """All places by magnitudes: surfaces, the last bin's edge (7.5), magnitudes above the unit interval (9.5)."""
    values = [round(50 * math.log(10) * 0.1 * i, 4) for i in (0, 1, 3, 5, 10, 20, 49, 50, 51, 69, 70, 71, 80)]
    got, want = rows_of(spark, tmp_path, name, ", ".join(f"('2024-01-10 00:00:00', {u}, {v}, {k})" for u in range(0, 3233, 13) for v in values for k in range(0, 100, 20)))
    assert got == want


def test_sums_without_a_pair_table(spark):
    """Small tiles give the sums of the pair table, and no table of pairs is written."""
    from pyspark.sql import functions as F

    from tremor.operators import nearsums
    from tremor.plans import inversion

    p, t = registry._prepared(spark, MIDDLE), registry.THETA
    targets = inversion.expected_targets(p, t)
    sources = inversion.expected_sources(p, t, targets)
    assert "pairs" not in vars(p)
    e = inversion.expectation(p, t)
    for got, want, key, value in ((targets, e.targets, "target_id", "p_triggered"), (sources, e.sources, "source_id", "l_hat")):
        both = got.select(key, F.col(value).alias("a")).join(want.select(key, F.col(value).alias("b")), key)
        assert both.count() == want.count() and both.agg(F.max(F.abs(F.col("a") - F.col("b")))).head()[0] < 1e-9

    def pairs_in(s, to, near):
        n = [len(i) for i, *_ in near]
        return {"n": np.array([sum(n)]), "most": np.array([len(s["id"]) * len(to["id"])])}

    tiles = nearsums.near_sums(p.rows.withColumn("r", F.lit(60.0)), p.targets, F.col("r"), ["magnitude"], [], pairs_in, "n long, most long", rows=8)
    got = tiles.agg(F.sum("n"), F.max("most"), F.count("n")).head()
    whole = nearsums.near_sums(p.rows.withColumn("r", F.lit(60.0)), p.targets, F.col("r"), ["magnitude"], [], pairs_in, "n long, most long").agg(F.sum("n"), F.count("n")).head()
    assert got[0] == whole[0] > 10_000 and got[2] > 2 * whole[1]


def test_diagnostics_without_a_pair_table(spark, monkeypatch):
    """Tiles of other magnitudes add up to the histograms of the pair table."""
    from pyspark.sql import functions as F

    from tremor.operators import nearsums
    from tremor.plans import evaluation, inversion

    monkeypatch.setattr(nearsums.near_sums, "__defaults__", (64,))
    p, t = registry._prepared(spark, MIDDLE), registry.THETA
    got = evaluation.binned_diagnostics(p, inversion.expected_targets(p, t), t)
    assert "pairs" not in vars(p)
    e = inversion.expectation(p, t)
    want = evaluation.fit_diagnostics(e.pairs.withColumn("weight", F.col("p") * F.col("zeta")), p.sources.select(F.col("source_magnitude").alias("magnitude")), t, p.setup.m_low)
    for name, frame in want.items():
        a, b = (sorted(map(tuple, x.collect())) for x in (got[name], frame))
        assert len(a) == len(b) > 0 and np.allclose(np.array(a, float), np.array(b, float), rtol=1e-9)


def test_pairs_are_not_broadcast_nor_written(spark, monkeypatch):
    """Tables whose rows are exploded for a join are not gathered by the driver; queries of pairs write none."""
    from pyspark.sql import functions as F

    from tremor.operators import pairs
    from tremor.plans import inversion

    points = registry._in_space(spark, SMALL)
    for frame in (pairs.pair_table_3d(points, 2.0), pairs.within_radius(points, points, F.lit(30.0))):
        frame.count()
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    monkeypatch.setattr(inversion, "listed_pairs", None)
    for name in ("em_expectation_pairs", "pairs_with_kappa"):
        assert registry.queries()[name](spark, SMALL).count() > 0


def test_quakeml_documents_are_bounded(spark, tmp_path, monkeypatch):
    from tremor.sources import catalog as cat

    c = spark.range(95).selectExpr("id", "CAST(id AS DOUBLE) / 7 AS days", "30.0D AS latitude", "10.0D AS longitude", "3.0D AS magnitude").coalesce(1)
    monkeypatch.setattr(cat, "DOCUMENT_ROWS", 10, raising=False)
    cat.write_quakeml(c, str(tmp_path / "q"))
    counts = [f.read_text().count("<event ") for f in (tmp_path / "q").glob("part-*")]
    assert sum(counts) == 95 and max(counts) <= 20 and cat.read_quakeml(spark, str(tmp_path / "q" / "part-*")).count() == 95


def test_squares_of_blocks(spark, monkeypatch):
    """Wide squares copy blocks less, and make the same pairs."""
    from pyspark.sql import functions as F

    from tremor.operators import blocks

    events = spark.range(3000).select("id", (F.pmod(F.xxhash64("id"), F.lit(997)) / 7).cast("double").alias("days")).cache()
    kernel = blocks.in_strips(lambda t, s: {"n": (s["days"] < t["days"]).sum(axis=1).astype(float)})

    def counted(squares):
        monkeypatch.setattr(blocks, "SQUARES", squares)
        got = blocks.over_pairs(events, events, "id", ["days"], "id", ["days"], kernel, "n double", rows=100, past="days")
        return got.groupBy("key").agg(F.sum("n")).orderBy("key").collect()

    narrow, wide = counted(10**6), counted(4)
    days = np.sort(np.array([r.days for r in events.collect()]))
    assert narrow == wide and [r[1] for r in wide] == [float(np.searchsorted(days, r.days)) for r in events.orderBy("id").collect()]
    monkeypatch.undo()
    assert blocks.square_side(39) == 1 and 10 < blocks.square_side(62_000) <= blocks.WIDEST


@pytest.mark.parametrize("space", [False, True])
def test_fit_without_a_pair_table(spark, monkeypatch, space):
    """A pass over blocks gives the pair table's sums, likelihood and gradient; a fit by it takes the same steps and writes no pairs."""
    from dataclasses import replace

    from pyspark.sql import functions as F

    from tremor.operators import blockpairs
    from tremor.plans import blockfit, inversion

    t = registry.THETA
    events = registry._in_space(spark, SMALL) if space else registry.events(spark, SMALL)
    setup = registry._setup(fixed=("log10_c",), units_per_km=1.0 if space else None)
    p = inversion.prepared(events, setup, pairs=False)
    monkeypatch.setattr(blockpairs, "BLOCK_ROWS", 20)
    levels = np.array(sorted(r[0] for r in p.sources.select("source_magnitude").distinct().collect()))
    blocks = blockfit.blocks_of(p)
    (n_hat, _), (alone, triggered), moments = blockfit._summed(p, blocks, levels, t)
    of = blockfit.Objective(p, levels, blockfit._counted(p, levels), *moments)
    with monkeypatch.context() as m:
        m.setattr(inversion, "listed_pairs", None)
        fit = blockfit.invert(p, t, most=2)
    assert "pairs" not in vars(p)
    e = inversion.expectation(p, t)
    assert n_hat == pytest.approx(inversion.totals(e.targets).head().n_hat, rel=1e-9)
    e = inversion.Expected(e.pairs.withColumn("weight", F.col("p") * F.col("zeta")), e.targets, e.sources)
    assert moments[0][0].sum() == pytest.approx(e.pairs.agg(F.sum("weight")).head()[0], rel=1e-9)
    whole, numbers = inversion.Objective(e, p.setup.m_low), np.array([r.l_hat for r in e.sources.collect()])
    for theta in (t, replace(t, log10_k0=-2.1, a=0.3, log10_c=-4.8, omega=-0.9, log10_tau=0.8, log10_d=-1.1, gamma=0.2, rho=0.5)):
        at = np.array([getattr(theta, k) for k in inversion.FREE], float)
        (a, x), (b, y) = whole(at), of(at)
        assert b - inversion.gammaln(numbers + 1).sum() == pytest.approx(a, rel=1e-8) and np.allclose(x, y, rtol=1e-6, atol=1e-6)
    lower = replace(t, log10_mu=-6.5)
    held = alone + (np.tensordot(blockfit.OF_MOMENTS, triggered, 1) * (lower.mu / (lower.mu + blockfit._nodes(blockfit.RATES)))).sum()
    assert held == pytest.approx(inversion.totals(inversion.expectation(p, lower).targets).head().n_hat, rel=1e-7)
    old = inversion.invert(p, t, most=2)
    assert np.allclose(np.array(fit.theta.values(), float), np.array(old.theta.values(), float), atol=2e-3, equal_nan=True) and fit.n_hat == pytest.approx(old.n_hat, rel=1e-3)


def test_arcs_of_chords():
    from tremor.operators import blockpairs

    r = blockpairs.EARTH_RADIUS
    for most in (1e-3, 1.0, 300.0, 3000.0, 19000.0):
        km = np.linspace(most / 1000, most, 1000)
        assert np.allclose(blockpairs.arc2((2 * r * np.sin(km / (2 * r))) ** 2), km * km, rtol=1e-12)


def test_slow_iterations_start_ahead(monkeypatch):
    """Iterations that shrink by a tenth or less end at their limit after few, within bounds; a start too far ahead is given up."""
    from dataclasses import replace

    from tremor.plans import blockfit

    free = ("log10_k0", "a", "log10_tau", "log10_d", "gamma", "rho")
    limit = np.array([-0.6, 4.95, 0.61, 0.62, 4.2, 1.0])
    turn = np.linalg.qr(np.random.default_rng(1).normal(size=(6, 6)))[0]
    shrinking = turn @ np.diag([0.97, 0.93, 0.85, 0.7, 0.4, 0.1]) @ turn.T

    def iterated(mixing):
        t, n, moved = replace(registry.THETA, log10_mu=-10.0), 0, math.inf
        while moved >= 0.001:
            at = np.array([getattr(t, k) for k in free])
            new = replace(t, **dict(zip(free, (limit + shrinking @ (at - limit)).tolist())))
            moved, n = t.distance(new), n + 1
            t = mixing.start(t, new) if mixing and moved >= 0.001 else new
        return n, np.abs(np.array([getattr(t, k) for k in free]) - limit).max(), t

    (many, far, _), (few, near, t) = iterated(None), iterated(blockfit.Mixing(registry._setup()))
    assert few < 20 < 60 < many and near < 0.002 < far and t.log10_mu == -10.0

    monkeypatch.setattr(blockfit, "PLAIN", 3)
    mixing, start = blockfit.Mixing(registry._setup()), registry.THETA
    first, second = replace(start, a=start.a + 0.1), replace(start, a=start.a + 0.1 + 0.09)
    assert mixing.start(start, first) is first and mixing.start(first, second) is second
    third = replace(second, a=second.a + 0.081)
    ahead = mixing.start(second, third)
    assert ahead.a == pytest.approx(start.a + 1.0) and blockfit.Mixing(registry._setup(alpha_is_beta=True)).tied
    assert mixing.start(ahead, replace(ahead, a=ahead.a + 5)) is third


@pytest.mark.parametrize("wide", [1.0, 2.0])
def test_points_lie_in_the_cubes_that_their_balls_meet(spark, wide):
    """Sources are copied to few cubes and lose no pair, at faces and for radii of all classes."""
    from pyspark.sql import functions as F

    from tremor.operators import pairs

    rng = np.random.default_rng(3)
    at = np.concatenate([rng.normal(size=(300, 3)) * 5, rng.integers(-3, 4, (300, 3)) * 2.048, [[1e6, -1e6, 1e6], [1e6 + 2, -1e6, 1e6]]])
    radii = [[2.0, 0.0, 0.5, 2.048, 30.0, math.inf, -1.0, math.nan, None][k % 9] for k in range(len(at))]
    points = spark.createDataFrame([(k, *map(float, x), r) for k, (x, r) in enumerate(zip(at, radii))], "id long, x double, y double, z double, r double")
    far = np.sqrt(((at[:, None, 0] - at[None, :, 0]) ** 2 + (at[:, None, 1] - at[None, :, 1]) ** 2) + (at[:, None, 2] - at[None, :, 2]) ** 2)
    want = {(k, int(j)) for k, r in enumerate(radii) if r is not None and r >= 0 for j in np.flatnonzero(far[k] <= r)}
    got = pairs.within_radius_3d(points, points, F.col("r"), wide).select("source_id", "target_id").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want
    copies = pairs.in_cubes(points.select("id", "x", "y", "z"), points.select("id", "x", "y", "z"), F.lit(2.0001), 2.0)[0]
    assert copies.count() <= 8 * len(at) and copies.filter("source_id < 300").count() < 7.5 * 300


def test_pairs_of_crowded_cells(spark, monkeypatch):
    """Crowded cells are cut by time, what follows from a place is worked out behind the exchange, and pairs are those of all events."""
    from pyspark.sql import functions as F

    from tremor.operators import pairs

    monkeypatch.setattr(pairs, "SLICE_ROWS", 20, raising=False)
    events = registry.events(spark, SMALL).select("id", "days", "latitude", "longitude", "magnitude")
    more = [(-1, 19724.0, 34.0, -118.0, 7.5), (-2, 19724.0, 34.0, -118.0, 7.5), (-3, 19735.0, None, -118.0, 7.5), (-4, None, 34.0, -118.0, 7.5), (-5, 19735.5, 34.0, -118.0, None), (-6, 19735.5, 34.0, -118.0, 3.0)]
    events = events.union(spark.createDataFrame(more, events.schema))
    frame = pairs.pair_table(events, registry.START)
    lines = frame._jdf.queryExecution().executedPlan().toString().split("\n")
    for side in ("source", "target"):
        at = [k for k, line in enumerate(lines) if f"AS _{side}_x" in line]
        assert len(at) == 1 and "Exchange hashpartitioning" in lines[at[0] + 1]
    rows = np.array([[np.nan if v is None else v for v in r] for r in events.collect()], float)
    i, days, lat, lon, m = rows.T
    half = lambda x: np.sin(np.radians(x[:, None] - x) / 2) ** 2
    d = 2 * 6378.1 * np.arcsin(np.sqrt(half(lat) + np.cos(np.radians(lat))[:, None] * np.cos(np.radians(lat)) * half(lon)))
    near = (d <= (100 * 10 ** (0.59 * m - 2.44))[:, None]) & (days[:, None] < days) & (days >= registry.START)
    want = {(i[a], i[b]): (days[b] - days[a], d[a, b] ** 2) for a, b in zip(*np.nonzero(near))}
    got = {(r.source_id, r.target_id): (r.time_distance, r.spatial_distance_squared) for r in frame.collect()}
    assert got.keys() == want.keys() and len(got) == frame.count() > 0
    assert np.allclose([got[k] for k in want], list(want.values()), rtol=1e-9, atol=1e-9)
    targets = events.filter(F.col("days") >= registry.START)
    s, t = pairs.in_cells(events, targets, pairs.reach_of(F.col("magnitude")))
    whole = t.groupBy("_kind", "_row", "_cell").count().agg(F.max("count")).head()[0]
    s, t = pairs._sliced(s, t, targets)
    assert t.groupBy("_kind", "_row", "_cell", "_slice").count().agg(F.max("count")).head()[0] <= 40 < whole
    assert s.filter("_slice IS NULL OR _slice < 0").isEmpty() and t.filter("target_days IS NULL OR _slice IS NULL").isEmpty()


def test_radii_that_hold_nothing(spark):
    """Radii below zero and unknown ones have no pairs; at zero, the place itself."""
    from pyspark.sql import functions as F

    from tremor.operators import pairs

    points = spark.createDataFrame([(1, 30.0, 10.0, -5.0), (2, 30.0, 10.0, 0.0), (3, 30.0, 10.0, None), (4, 30.0, 10.01, 0.9), (5, 30.0, 10.01, 1.0)], "id long, latitude double, longitude double, r double")
    got = {(r.source_id, r.target_id) for r in pairs.within_radius(points, points, F.col("r")).collect()}
    assert got == {(2, 1), (2, 2), (2, 3), (4, 4), (4, 5), *((5, k) for k in range(1, 6))}


def _catalog_of(rng, n):
    """Clustered events; some at the same time and place, some without a place or a size."""
    import numpy as np

    days, m = rng.uniform(0, 30, n).round(2), rng.exponential(0.43, n).round(1) + 2.5
    lat, lon = (32 + rng.integers(0, 9, n) + rng.normal(0, 0.05, n)).round(2), (-120 + rng.integers(0, 9, n) + rng.normal(0, 0.05, n)).round(2)
    half = n // 10
    days[:half], lat[:half], lon[:half], m[:half] = days[half : 2 * half], lat[half : 2 * half], lon[half : 2 * half], m[half : 2 * half]
    rows = [tuple(map(float, r)) for r in np.stack([days, lat, lon, m], axis=1)]
    return [(i, d, None if i % 97 == 5 else a, o, None if i % 89 == 7 else s) for i, (d, a, o, s) in enumerate(rows)]


def test_strongest_parents_of_all_pairs(spark, monkeypatch):
    """The strongest earlier event as all pairs have it, the smaller id of equals; events without a place or a size are nobody's parent."""
    import numpy as np

    from tremor.operators import strongest as module
    from tremor.plans import evaluation
    from tremor.queries import M_REF, PARENT as t

    rows = _catalog_of(np.random.default_rng(3), 1500)
    df = spark.createDataFrame(rows, "id long, days double, latitude double, longitude double, magnitude double")
    want = {}
    day, lat, lon, m = (np.array([np.nan if r[k] is None else r[k] for r in rows]) for k in (1, 2, 3, 4))
    x = dict(latitude=lat, longitude=lon)
    for i in np.flatnonzero(day > day.min()):
        d = evaluation.blocks.distances({c: v[i] for c, v in x.items()}, x, evaluation.EARTH_RADIUS)
        with np.errstate(all="ignore"):
            share = t.a * (m - M_REF) - (1 + t.omega) * np.log(day[i] - day + t.c) - (1 + t.rho) * np.log(d * d + t.d * np.exp(t.gamma * (m - M_REF)))
        share = np.where((day < day[i]) & ~np.isnan(share), share, -np.inf)
        want[int(i)] = int(np.flatnonzero(share >= share.max() - 1e-12)[0]) if share.max() > -np.inf else None
    assert {r.id: r.parent_id for r in evaluation.dominant_parents(df, df, t, M_REF).collect()} == want
    whole = module.strongest
    monkeypatch.setattr(evaluation, "strongest", lambda *a: whole(*a, rows=60))  # many units, some cut by time
    assert {r.id: r.parent_id for r in evaluation.dominant_parents(df, df, t, M_REF).collect()} == want


def test_few_pairs_are_met_for_the_strongest(monkeypatch):
    """Targets meet a small part of the earlier sources one by one."""
    import numpy as np

    from tremor.operators import blocks, strongest as module
    from tremor.queries import PARENT as t

    rng, n, met = np.random.default_rng(5), 12_000, []
    x = dict(zip("xyz", blocks.unit(rng.uniform(32, 41, n), rng.uniform(-124, -114, n))))
    big = rng.exponential(0.43, n)
    s = x | {"key": np.arange(n), "days": rng.uniform(0, 30, n), "weight": t.a * big, "zone": t.d * np.exp(t.gamma * big)}
    law, shares = module.Law(t.c, 1 + t.omega, t.tau, 1 + t.rho), module._shares
    monkeypatch.setattr(module, "_shares", lambda *a: met.append((found := shares(*a)).size) or found)
    a = x | {"key": s["key"], "days": s["days"], "best": np.full(n, -np.inf), "pid": np.full(n, module.NONE)}
    with np.errstate(all="ignore"):
        module._search(a, s, law, module._seeds(a, s, law))
    assert (a["pid"] < module.NONE).sum() == n - 1
    assert sum(met) < 0.15 * n * n / 2


def test_pairs_of_a_tile_are_the_pair_tables():
    """Pairs of a tile are those whose great-circle distance is within the radius, also on its edge, at a place of zero reach and below zero."""
    import numpy as np

    from tremor.operators import nearsums

    rng, n = np.random.default_rng(11), 400
    place = lambda lat, lon: {"latitude": np.concatenate((rng.uniform(35, 36, n), lat)), "longitude": np.concatenate((rng.uniform(-120, -119, n), lon))}
    t = place([36.0, 36.5, 36.0], [-119.0, -119.0, -119.5]) | {"days": np.sort(rng.uniform(5, 20, n + 3))}
    up = lambda a, b: np.sin(np.radians(a - b) / 2)

    def distance(s, i, j):
        u, v = up(s["latitude"][i], t["latitude"][j]), up(s["longitude"][i], t["longitude"][j])
        return 2 * nearsums.EARTH_RADIUS * np.arcsin(np.sqrt(np.minimum(1.0, u * u + np.cos(np.radians(s["latitude"][i])) * np.cos(np.radians(t["latitude"][j])) * (v * v))))

    s = place(t["latitude"][n - 3 :], t["longitude"][n - 3 :]) | {"days": np.sort(rng.uniform(0, 20, n + 6))}
    s["_radius"] = rng.choice([0.0, -3.0, 21.0, 80.0, 30_000.0], n + 6)
    for k in range(0, n, 2):  # a target exactly on the edge
        s["_radius"][k] = distance(s, k, rng.integers(n))
    s["_radius"][n:] = 0.0
    for a, b in ((s, t), ({c: v[:0] for c, v in s.items()}, t), (s, {c: v[:0] for c, v in t.items()})):
        got = [(i, j, dt, d2) for i, j, dt, d2 in nearsums._pairs(a, b)]
        i, j = np.meshgrid(np.arange(len(a["days"])), np.arange(len(b["days"])), indexing="ij")
        d = distance(a, i, j)
        want = (d <= a["_radius"][i]) & (b["days"][j] > a["days"][i])
        found = np.zeros_like(want)
        for i_, j_, dt, d2 in got:
            assert not found[i_, j_].any() and (dt == b["days"][j_] - a["days"][i_]).all()
            assert np.allclose(d2, d[i_, j_] ** 2, rtol=1e-12, atol=1e-11)
            found[i_, j_] = True
        assert (found == want).all()


def test_gradient_makes_the_pairs_twice(spark, monkeypatch):
    """Once for the targets' totals, once for sources, gradient and information together."""
    import __spark_entry__

    from tremor.plans import inversion

    seen, near = [], inversion.near_sums
    monkeypatch.setattr(inversion, "near_sums", lambda *a: seen.append(1) or near(*a))
    assert __spark_entry__.queries()["em_gradient"](spark, SMALL).count() == 36
    assert len(seen) == 2


def test_productivity_bins_no_delays_and_distances(spark, monkeypatch):
    """The productivity's histogram is summed without the two others."""
    import __spark_entry__

    from tremor.plans import evaluation

    made, whole = [], evaluation.binned_diagnostics
    monkeypatch.setattr(evaluation, "binned_diagnostics", lambda *a, **more: made.append(whole(*a, **more)) or made[0])
    assert __spark_entry__.queries()["fit_in_productivity"](spark, SMALL).count() > 10
    assert set(made[0]) == {"productivity"}


def test_information_is_that_of_its_slopes():
    """Products of eight functions of a pair give the sums that slopes, pair by pair, give."""
    import math

    import numpy as np

    from tremor.functions.kernels import Theta
    from tremor.plans import inversion

    rng, n = np.random.default_rng(2), 500
    m, dt, r2, w = 3 + rng.exponential(0.43, n), rng.exponential(5, n), rng.exponential(300, n), rng.uniform(0, 1, n)
    for t in (Theta(), Theta(log10_tau=math.inf, omega=0.1)):
        values = np.array([getattr(t, k) for k in inversion.FREE], float)
        density, slopes = inversion._pair_parts(values, m, dt, r2, 2.95)
        s = np.stack([0 * m, 0 * m, *slopes])
        want = np.concatenate(([(w * density).sum()], s @ w, ((s * w) @ s.T).ravel()))
        assert np.allclose(inversion.pair_information(values, m, dt, r2, w, 2.95), want, rtol=1e-11, atol=1e-9)
