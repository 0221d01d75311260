"""Configurations and runs."""

from __future__ import annotations

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tremor import queries as registry
from tremor.functions.geo import geodesic_area
from tremor.functions.kernels import Theta
from tremor.plans import runs, simulation
from tremor.sources import catalog as cat
from tremor.sources import config

RING = [(33.0, -120.0), (35.0, -120.0), (35.0, -118.0), (33.0, -118.0)]


def test_trees():
    assert config.flattened({"a": {"b": 1, "c": {"d": 2}}, "e": 3}) == {"a.b": 1, "a.c.d": 2, "e": 3}
    assert config.updated({"a": {"b": 1}}, {"a.c": 2, "f": {"g": 3}}) == {"a": {"b": 1, "c": 2}, "f": {"g": 3}}
    assert config.plain({"a": float("nan"), "b": (1, float("inf"))}) == {"a": None, "b": [1, None]}
    for bad in ('{"a": 1,}', '{"a": 1} // no'):
        with pytest.raises(ValueError):
            config.read_json(bad)


def test_bindings():
    text = "# head\nx.mc = 2.5  # kept\ny = [1,\n  2]\nname = 'a # b'\nz = @ref()\n"
    assert config.parse_bindings(text) == {"x.mc": 2.5, "y": [1, 2], "name": "a # b", "z": "@ref()"}
    new = config.update_bindings(text, {"x.mc": 3.0, "y": [7], "added": "q"})
    assert config.parse_bindings(new) == {"x.mc": 3.0, "y": [7], "name": "a # b", "z": "@ref()", "added": "q"} and "# kept" in new and "# head" in new


def test_windows_and_formats():
    w = config.year_windows(dt.datetime(1981, 1, 1, 5), dt.datetime(2021, 1, 1), 5, 10)
    assert w["auxiliary_start"] == dt.datetime(1981, 1, 1) and w["testwindow_end"] == dt.datetime(2021, 1, 1)
    with pytest.raises(ValueError):
        config.year_windows(dt.datetime(1981, 1, 1), dt.datetime(1990, 1, 1), 5, 10)
    assert (config.short_duration(2 * 86400), config.short_duration(30)) == ("2.00d", "30s")
    assert config.between(dt.datetime(2000, 1, 1), dt.datetime(2000, 1, 11), 0.5) == dt.datetime(2000, 1, 6)
    assert runs.methods("branching, Thinning,branching") == ["branching", "thinning"]
    with pytest.raises(ValueError):
        runs.methods("other")


def test_scoped_bindings():
    text = "include 'b.gin'\na = 1\nTarget:\n  a = %a\n  big = [1,  # one\n    2]\n\nb = 'x'\n"
    assert config.parse_config(text) == {"includes": ["b.gin"], "bindings": {"a": 1, "Target.a": "%a", "Target.big": [1, 2], "b": "x"}}
    new = config.update_bindings(text, {"a": 5, "Target.big": [3], "other.c": "@f()"})
    assert config.parse_config(new)["bindings"] == {"a": 5, "Target.a": "%a", "Target.big": [3], "b": "x", "other.c": "@f()"} and "  a = %a" in new
    for bad in ("no binding", "a = [1,\n2"):
        with pytest.raises(ValueError):
            config.parse_config(bad)


def test_cached_fit(spark, tmp_path):
    c = cat.from_events(spark.read.parquet(f"{SMALL}/events.parquet"))
    a, place = runs.cached_fit(c, registry._setup(), registry.THETA, str(tmp_path), most=0)
    b, again = runs.cached_fit(c.repartition(3), registry._setup(), registry.THETA, str(tmp_path), most=0)
    assert a == b and place == again and runs.theta_of(a) == registry.THETA
    other, elsewhere = runs.cached_fit(c.filter("id % 7 > 0"), registry._setup(), registry.THETA, str(tmp_path), most=0)
    assert elsewhere != place and other["n_hat"] != a["n_hat"]
    with pytest.raises(ValueError):
        runs.cached_fit(c.limit(0), registry._setup(), registry.THETA, str(tmp_path), most=0)
    fit = runs.reloaded(place, spark)
    assert fit.theta == registry.THETA and fit.setup == registry._setup() and fit.expected.targets.count() and fit.expected.pairs is None


HISTORY = [(1, 0.0, 34.0, -119.0, 5.0), (2, 0.5, 34.1, -119.0, 4.0)]
PLACED = "id long, days double, latitude double, longitude double, magnitude double"


def test_ensemble_and_report(spark, tmp_path):
    h = spark.createDataFrame(HISTORY, PLACED)
    process = simulation.Process(Theta(log10_mu=-4.5, log10_k0=-3.2), 2.3, 3.0)
    names = ["branching", "thinning"]
    rows = runs.ensemble(h, process, RING, 1.0, 3.0, 2, names, str(tmp_path), 50)
    key = lambda df: sorted(tuple(r) for r in df.select("method", "seed", "t", "m").collect())
    first = key(rows)
    assert first and key(runs.ensemble(h, process, RING, 1.0, 3.0, 2, names, str(tmp_path), 50)) == first
    more = key(runs.ensemble(h, process, RING, 1.0, 3.0, 3, names, str(tmp_path), 50))
    assert [r for r in more if r[1] < 2] == first
    late = runs.ensemble(h, process, RING, 500.0, 3.0, 2, names, str(tmp_path), 50)
    assert late.filter("t < 500").isEmpty() and not late.isEmpty()
    other = simulation.Process(Theta(log10_mu=-4.5, log10_k0=-3.2), 2.3, 3.0, seed=7)
    assert key(runs.ensemble(h, other, RING, 1.0, 3.0, 2, names, str(tmp_path), 50)) != first
    meta = lambda history: runs.realization_meta(history, process, RING, 1.0, 3.0, "branching", 50, {})
    assert meta(h) == meta(h.repartition(3)) != meta(h.filter("id = 1"))
    with pytest.raises(ValueError):
        runs.ensemble(h, process, RING, 1.0, 3.0, 2, ["neural"], str(tmp_path), 50)
    m = runs.metrics(rows)
    assert m.count() <= 4 and {tuple(r)[0] for r in runs.paired(m, "branching", "thinning").collect()} <= {0, 1}
    page = runs.html_report("A <title>", {"n": len(first)}, {"metrics": m}, most_rows=1, images={"counts": runs.png([1, 3, 2])})
    assert "A &lt;title&gt;" in page and "n_events" in page and f"the first 1 of {m.count()} rows" in page and "data:image/png" in page


def test_registered_method(spark, tmp_path):
    made = lambda history, process, ring, start, days, first, seeds, cap, how: spark.createDataFrame([(s, 3.0, 1.0, 2.0, start, 0.0, "background") for s in range(first, first + seeds)], "seed long, m double, x double, y double, t double, dt_days double, event_source string")
    runs.register_method("constant", made, "1")
    process = simulation.Process(Theta(), 2.3, 3.0)
    assert runs.ensemble(spark.createDataFrame(HISTORY, PLACED), process, RING, 1.0, 1.0, 4, "constant", str(tmp_path)).count() == 4
    other = lambda *a: made(*a).withColumn("m", F.lit(9.0))
    runs.register_method("constant", other, "2")
    again = runs.ensemble(spark.createDataFrame(HISTORY, PLACED), process, RING, 1.0, 1.0, 4, "constant", str(tmp_path))
    assert {(r.m, r.complete) for r in again.collect()} == {(9.0, True)}
    runs.METHODS.pop("constant")


def test_keys_of_options(spark):
    """Tables count by content wherever they stand, functions by version only; what cannot be told apart is refused."""
    a, b = (spark.createDataFrame([(1, 4.0, x)], "zone int, magnitude double, cdf double") for x in (0.5, 1.0))
    zone = runs.versioned(lambda lat, lon: F.lit(1), "one zone")
    key = lambda how: runs.realization_meta(spark.createDataFrame(HISTORY, PLACED), simulation.Process(Theta(), 2.3, 3.0), RING, 1.0, 1.0, "branching", 5, how)
    assert key({"zones": (zone, a)}) == key({"zones": (runs.versioned(lambda x, y: F.lit(1), "one zone"), a.repartition(2))})
    assert key({"zones": (zone, a)}) != key({"zones": (zone, b)}) and key({"zones": (zone, a)}) != key({"zones": (runs.versioned(zone, "other"), a)})
    assert "0x" not in json.dumps(key({"zones": (zone, a), "generator": simulation.gutenberg_richter}))
    for bad in ({"generator": lambda u, p: u}, {"zones": (lambda x, y: x, a)}, {"x": object()}):
        with pytest.raises(ValueError, match="version"):
            key(bad)


def test_zones_and_generators_are_made_anew(spark, tmp_path):
    h, process = spark.createDataFrame(HISTORY, PLACED), simulation.Process(Theta(log10_mu=-4.5, log10_k0=-3.4), 2.3, 3.0)
    zone = runs.versioned(lambda lat, lon: F.lit(1), "one zone")
    bins = lambda m: spark.createDataFrame([(1, m, 1.0)], "zone int, magnitude double, cdf double")
    run = lambda **how: {r.m for r in runs.ensemble(h, process, RING, 1.0, 3.0, 2, "branching", str(tmp_path), **how).collect()}
    assert run(zones=(zone, bins(4.0))) == {4.0} and run(zones=(zone, bins(5.0))) == {5.0}
    assert run(generator=runs.versioned(lambda u, p: F.lit(4.5), "4.5")) == {4.5} and run(generator=runs.versioned(lambda u, p: F.lit(3.5), "3.5")) == {3.5}
    assert run(zones=(zone, bins(4.0))) == {4.0}


def test_cut_realisations_are_told(spark, tmp_path):
    """A cap of five events: the flag stays with what is stored, in the metrics, and keeps such seeds out of pairs."""
    h, process = spark.createDataFrame(HISTORY, PLACED), simulation.Process(Theta(log10_mu=-3.3, log10_k0=-3.2), 2.3, 3.0)
    rows = runs.ensemble(h, process, RING, 1.0, 3.0, 3, ["branching", "thinning"], str(tmp_path), 5)
    m = runs.metrics(rows)
    cut = {r.method: (r.seeds, r.cut) for r in runs.cut_seeds(m).collect()}
    assert cut["thinning"] == (3, 3) and cut["branching"] == (3, 0)
    assert m.filter("method = 'thinning'").filter("n_events > 5 OR complete").isEmpty() and runs.paired(m, "branching", "thinning").isEmpty()
    again = runs.ensemble(h, process, RING, 1.0, 3.0, 3, "thinning", str(tmp_path), 5)
    assert {r.complete for r in again.collect()} == {False}


def test_operational_forecast(spark):
    """Background happens at the grid's nodes, offspring around their parents, and the region's filter sees these places."""
    record = {"final_parameters": dict(zip(("log10_mu", "log10_iota", "log10_k0", "a", "log10_c", "omega", "log10_tau", "log10_d", "gamma", "rho"), Theta(log10_mu=-3.7, log10_k0=-6.3, log10_d=-2.0, gamma=0.1, rho=2.0).values())), "beta": 2.3, "m_ref": 3.0, "delta_m": 0.1, "area": geodesic_area(RING)}
    h = spark.createDataFrame([(1, -9000.0, 34.0, -119.5, 3.0)], PLACED)
    grid = spark.createDataFrame([(33.5, -118.5, 3.0), (34.5, -118.5, 3.0), (40.0, -100.0, 3.0)], "latitude double, longitude double, weight double")
    out = runs.operational_forecast(h, record, RING, 1.0, 5.0, 3, grid=grid).collect()
    at = {(r.catalog_id, r.id): (r.latitude, r.longitude) for r in out}
    places = {at[r.catalog_id, r.id] for r in out if r.kind == "background"}
    assert places == {(33.5, -118.5), (34.5, -118.5)}
    children = [r for r in out if r.kind == "triggered" and (r.catalog_id, r.parent_id) in at]
    far = [max(abs(a - b) for a, b in zip(at[r.catalog_id, r.id], at[r.catalog_id, r.parent_id])) for r in children]
    assert len(children) > 5 and sorted(far)[len(far) // 2] < 0.01 and max(far) < 0.5
    spread = runs.operational_forecast(h, record, RING, 1.0, 5.0, 1, grid=grid, cell=(0.2, 0.4)).filter("kind = 'background'").collect()
    assert len({r.latitude for r in spread}) > 2 and all(min(abs(r.latitude - y) for y in (33.5, 34.5)) <= 0.1 and abs(r.longitude + 118.5) <= 0.2 for r in spread)


def test_forecast_of_a_stored_fit(spark):
    """With a fit's sources the history is theirs, inflated by what completeness hides, and the events since."""
    t = Theta(log10_mu=-9.0, log10_k0=-3.4, omega=0.1, log10_tau=math.inf)
    record = {"final_parameters": dict(zip(("log10_mu", "log10_iota", "log10_k0", "a", "log10_c", "omega", "log10_tau", "log10_d", "gamma", "rho"), t.values())), "beta": 2.3, "m_ref": 3.0, "delta_m": 0.1, "area": geodesic_area(RING), "setup": {"end": 1.0}}
    h = spark.createDataFrame([(1, 0.9, 34.0, -119.0, 3.0), (2, 0.95, 34.2, -119.0, 3.0), (3, 1.5, 34.0, -118.5, 3.0), (4, 1.6, 34.0, -118.5, 2.0)], PLACED)
    sources = lambda xi: spark.createDataFrame([(1, xi), (2, 1.0)], "source_id long, xi_plus_1 double")
    parents = lambda xi: [r.parent_id for r in runs.operational_forecast(h, record, RING, 2.0, 30.0, 200, sources=sources(xi)).filter("generation = 1").collect()]
    plain, more = parents(1.0), parents(8.0)
    assert set(plain) <= {1, 2, 3} and plain.count(3) > 0 and more.count(1) > 3 * max(1, plain.count(1)) and more.count(2) == plain.count(2)


def test_grids(spark):
    for utm in (False, True):
        nodes, facts = runs.grid_in_ring(RING, 0.0025, utm=utm)
        assert abs(len(nodes) * 400.0 / geodesic_area(RING) - 1) < 0.06 and facts["found"] == len(nodes)
    assert min(n[0] for n in nodes) > 1e5  # metres
    with pytest.raises(ValueError):
        runs.grid_in_ring(RING, 0.0)
    with pytest.raises(ValueError):
        runs.grid_in_ring([(1.0, 1.0)] * 3, 10.0)
    g = spark.createDataFrame([(33 + i / 10, -120 + j / 10) for i in range(20) for j in range(20)], "lat double, lon double")
    assert runs.area_of_grid(g).head()[0] == pytest.approx(geodesic_area(RING), rel=0.02)
