"""Runs over methods and seeds: cached fits and realisations, ensembles, reports, operational forecasts."""

from __future__ import annotations

import html
import json
import math
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.geo import geodesic_area
from ..functions.kernels import NAMES, Theta
from ..functions.params import to_rate_params
from ..functions.rng import key_id
from ..operators import stats
from ..sources.catalog import fingerprint, found, read_fit, write_fit
from . import inversion, simulation


def content_hash(df: DataFrame) -> str:
    """Of a table's columns and rows, whatever their order: count and two sums of row hashes."""
    columns = sorted(df.columns)
    own = [F.xxhash64(F.lit(salt), *[F.to_json(F.struct(c)) if "map" in t else F.col(c) for c, t in sorted(df.dtypes)]) for salt in (1, 2)]
    sums = [F.sum(F.pmod(h, F.lit(1 << 62)).cast("decimal(38,0)")).cast("string").alias(f"s{i}") for i, h in enumerate(own)]
    return fingerprint({"columns": columns, "types": sorted(map(list, df.dtypes)), "rows": [str(x) for x in df.agg(F.count(F.lit(1)).alias("n"), *sums).head()]})


def cached_fit(catalog: DataFrame, setup: inversion.Setup, start: Theta, folder: str, force: bool = False, store_pairs: bool = False, **how) -> tuple[dict, str]:
    """(record, folder) of a fit; a stored one is read if its catalog and whole configuration have the same fingerprint."""
    spark = catalog.sparkSession
    if setup.constraint is not None:
        raise ValueError("a fit with a constraint function has no fingerprint; call invert")
    config = {"catalog": content_hash(catalog), "setup": dict(vars(setup)), "start": dict(zip(NAMES, start.values())), "how": how, "pairs": store_pairs}
    place = f"{folder}/{fingerprint(config)}"
    if not force and found(spark, f"{place}/parameters"):
        return read_fit(place, spark)[0], place
    fit = inversion.invert(inversion.prepared(catalog, setup), start, **how)
    tables = {"targets": fit.expected.targets, "sources": fit.expected.sources, **({"pairs": fit.expected.pairs} if store_pairs else {})}
    write_fit(place, spark, fit.record(), **tables)
    return json.loads(json.dumps(fit.record(), default=str)), place


def reloaded(folder: str, spark: SparkSession) -> inversion.Fit:
    """A stored fit that can be used: parameters, setup and those of its tables that were stored."""
    record, tables = read_fit(folder, spark, "targets", "sources", "pairs")
    return inversion.Fit.stored(record, **tables)


def theta_of(record: dict) -> Theta:
    return Theta.of(record["final_parameters"])


def as_realization(events: DataFrame, start: float, key: str = "catalog_id") -> DataFrame:
    """Forecast events as ``REALIZATION``; such realisations are never cut."""
    return events.select(F.col(key).alias("seed"), F.col("magnitude").alias("m"), F.col("longitude").alias("x"), F.col("latitude").alias("y"), F.col("days").alias("t"), (F.col("days") - start).alias("dt_days"), F.when(F.col("kind") == "background", "background").otherwise("triggered").alias("event_source"), F.lit(True).alias("complete"))


#: Columns of stored realisations; ``complete`` is false where a realisation was cut at its event cap.
REALIZATION = ["seed", "m", "x", "y", "t", "dt_days", "event_source", "complete"]


def _branching(history, process, ring, start, days, first, seeds, cap, how):
    area = geodesic_area(ring)
    return as_realization(simulation.forecast(history, process, ring, start, days, area, seeds, first=first, **how), start)


def _thinning(history, process, ring, start, days, first, seeds, cap, how):
    return simulation.thinned(history, process, ring, start, start + days, seeds, cap, first=first, **how).select(*REALIZATION)


def _rates(history, process, ring, start, days, first, seeds, cap, how):
    rates, area = to_rate_params(process.theta, process.m_low), geodesic_area(ring)
    return as_realization(simulation.rate_forecast(history, process, rates, ring, start, days, area, seeds, first=first, **how), start)


#: Continuation methods by name; a method makes realisations ``first`` to ``first + seeds - 1``.
METHODS: dict[str, Callable[..., DataFrame]] = {"branching": _branching, "thinning": _thinning, "rates": _rates}


#: Versions of registered methods, which are part of what a stored realisation depends on.
VERSIONS: dict[str, str] = {}


def register_method(name: str, method: Callable[..., DataFrame], version: str) -> None:
    """Add a continuation method (history, process, ring, start, days, first, seeds, cap, how) -> realisations.

    ``version`` names what the function does: realisations of another version are made anew.
    """
    METHODS[name], VERSIONS[name] = method, version


def versioned(function: Callable, version: str) -> Callable:
    """``function`` as an option of stored realisations: ``version`` stands for what it does, and has to change with that."""

    def call(*args, **more):
        return function(*args, **more)

    call.version = version
    return call


def methods(names: list[str] | str) -> list[str]:
    """Known continuation methods, each once, in the given order; others are an error."""
    wanted = [n.strip().lower() for n in (names.split(",") if isinstance(names, str) else names)]
    if unknown := [n for n in wanted if n not in METHODS]:
        raise ValueError(f"unknown methods: {', '.join(unknown)}; known are {', '.join(METHODS)}")
    return list(dict.fromkeys(wanted))


def option_key(value: object) -> object:
    """What stands for an option in a key: tables by content, functions by version, containers by their items; other things as they are.

    A function without a version (see ``versioned``), and anything else that JSON cannot hold, is an error: its
    results cannot be told from those of another.
    """
    if isinstance(value, DataFrame):
        return {"table": content_hash(value)}
    if isinstance(value, dict):
        return {str(k): option_key(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [option_key(v) for v in value]
    if (version := getattr(value, "version", None)) is not None:
        return {"function": str(version)}
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    raise ValueError(f"{value!r} has no version, so results that depend on it cannot be stored; see versioned")


def realization_meta(history: DataFrame, process: simulation.Process, ring: list[tuple[float, float]], start: float, days: float, method: str, cap: int, how: dict) -> dict:
    """All that a realisation depends on but its seed: history, process, window, region, method and its version, cap, options (see ``option_key``)."""
    theta = dict(zip(NAMES, process.theta.values()))
    process_ = {**{k: v for k, v in vars(process).items() if k != "theta"}, "theta": theta}
    return {"history": content_hash(history.filter(F.col("days") <= start)), "process": process_, "ring": [list(map(float, p)) for p in ring], "start": start, "days": days, "method": [method, VERSIONS.get(method)], "cap": cap, "options": option_key(how), "columns": REALIZATION}


def ensemble(history: DataFrame, process: simulation.Process, ring: list[tuple[float, float]], start: float, days: float, seeds: int, names: list[str] | str, folder: str, most_events: int | None = None, force: bool = False, **how) -> DataFrame:
    """Realisations 0 to ``seeds`` - 1 of each method, with ``method``; those that ``folder`` has are read, others made and stored.

    Realisations are stored under the fingerprint of their meta data, with these beside
    them; a run with any other history, process, window, region, cap or option is another
    one, as is one with functions of other versions; a run whose meta data are missing or differ is made anew.
    """
    spark = history.sparkSession
    cap = most_events if most_events is not None else simulation.event_cap(days)
    out = None
    for method in methods(names):
        meta = realization_meta(history, process, ring, start, days, method, cap, how)
        place = f"{folder}/{method}/{fingerprint(meta)}"
        done = set() if force else stored_seeds(spark, place, meta)
        for first, n in _spans([s for s in range(seeds) if s not in done]):
            rows = METHODS[method](history, process, ring, start, days, first, n, cap, how)
            rows = (rows if "complete" in rows.columns else rows.withColumn("complete", F.lit(True))).select(*REALIZATION)
            part = f"{place}/run-{first}-{uuid.uuid4().hex[:8]}"
            rows.write.parquet(f"{part}/events")
            # The meta row comes last: a run without one is not there.
            record = [(json.dumps(meta, sort_keys=True, default=str), first, n, f"{part}/events")]
            spark.createDataFrame(record, "meta string, first long, seeds long, events string").coalesce(1).write.mode("append").parquet(f"{place}/meta")
        got = _realizations(spark, place, meta, seeds).withColumn("method", F.lit(method))
        out = got if out is None else out.unionByName(got)
    return out


def stored_runs(spark: SparkSession, place: str, meta: dict) -> list:
    """Runs stored under exactly this meta data, the newest of each first seed last."""
    if not found(spark, f"{place}/meta"):
        return []
    text = json.dumps(meta, sort_keys=True, default=str)
    rows = spark.read.parquet(f"{place}/meta").filter(F.col("meta") == text).select("first", "seeds", "events", F.col("_metadata.file_modification_time").alias("at"))
    return sorted(rows.collect(), key=lambda r: (r.at, r.events))  # a row a run


def stored_seeds(spark: SparkSession, place: str, meta: dict) -> set[int]:
    return {s for r in stored_runs(spark, place, meta) for s in range(r.first, r.first + r.seeds)}


def _spans(seeds: list[int]) -> list[tuple[int, int]]:
    """(first, number) of the runs of consecutive seeds."""
    out: list[tuple[int, int]] = []
    for s in seeds:
        if out and s == sum(out[-1]):
            out[-1] = out[-1][0], out[-1][1] + 1
        else:
            out.append((s, 1))
    return out


def _realizations(spark: SparkSession, place: str, meta: dict, seeds: int) -> DataFrame:
    """Each seed from the newest run that has it."""
    owner = {s: r.events for r in stored_runs(spark, place, meta) for s in range(r.first, r.first + r.seeds) if s < seeds}
    out = None
    for path in dict.fromkeys(owner.values()):
        own = sorted(s for s, p in owner.items() if p == path)
        rows = spark.read.parquet(path).filter(F.col("seed").between(own[0], own[-1]) if own == list(range(own[0], own[-1] + 1)) else F.col("seed").isin(own))
        out = rows if out is None else out.unionByName(rows)
    return out


def paired(metrics: DataFrame, a: str, b: str, value: str = "n_events") -> DataFrame:
    """(seed, a, b, difference) of the seeds that both methods have, cut realisations (``complete`` false) left out: see ``cut_seeds``."""
    return stats.seed_pairs(metrics.filter("complete") if "complete" in metrics.columns else metrics, a, b, value)


def cut_seeds(metrics: DataFrame) -> DataFrame:
    """(method, seeds, cut): realisations with events, and those cut at their event cap, of each method."""
    return metrics.groupBy("method").agg(F.count(F.lit(1)).alias("seeds"), F.count_if(~F.col("complete")).alias("cut"))


def metrics(rows: DataFrame) -> DataFrame:
    """``realization_metrics`` of each method and seed, and ``complete``: whether it was made to the end of its window."""
    key = rows.withColumn("key", F.concat_ws("|", "method", "seed"))
    names = key.groupBy("key", "method", "seed").agg(F.min("complete").alias("complete"))
    return stats.realization_metrics(key, "key").join(names, "key").drop("key")


def html_report(title: str, facts: dict, tables: dict[str, DataFrame], most_rows: int = 200, images: dict[str, bytes] | None = None) -> str:
    """A page of facts, tables and images; a table longer than ``most_rows`` says how many rows it leaves out."""
    from base64 import b64encode

    part = lambda rows: "".join("<tr>" + "".join(f"<td>{html.escape(str(c))}</td>" for c in r) + "</tr>" for r in rows)
    body = f"<h1>{html.escape(title)}</h1><table>{part(facts.items())}</table>"
    for name, df in tables.items():
        head, rows = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns), df.limit(most_rows + 1).collect()
        note = f"<p>the first {most_rows} of {df.count()} rows</p>" if len(rows) > most_rows else ""
        body += f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{part(rows[:most_rows])}</table>{note}"
    for name, data in (images or {}).items():
        body += f"<h2>{html.escape(name)}</h2><img src='data:image/png;base64,{b64encode(data).decode()}'/>"
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body>{body}</body></html>"


def write_metrics(rows: DataFrame, folder: str) -> None:
    """Metrics of realisations as one CSV with a header."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(folder)


def png(columns: np.ndarray, height: int = 120, bar: int = 6) -> bytes:
    """A bar chart of numbers as a PNG, black on white, without any drawing library."""
    import struct
    import zlib

    values = np.nan_to_num(np.asarray(columns, float))
    top = max(float(values.max(initial=0.0)), 1e-300)
    pixels = np.full((height, max(1, len(values)) * bar), 255, np.uint8)
    for i, v in enumerate(values):
        pixels[height - int(round(max(0.0, v) / top * (height - 1))) - 1 :, i * bar : (i + 1) * bar - 1] = 0
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", pixels.shape[1], height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def read_background_grid(spark: SparkSession, path: str, latitude: str = "latitude", longitude: str = "longitude", weight: str = "weight") -> DataFrame:
    """(id, latitude, longitude, weight, probability) of a CSV grid of background rates; the probability is the share of the largest."""
    raw = spark.read.option("header", True).option("inferSchema", True).csv(path)
    rows = raw.select(F.col(latitude).cast("double").alias("latitude"), F.col(longitude).cast("double").alias("longitude"), F.col(weight).cast("double").alias("weight"))
    return weighted_places(rows)


def weighted_places(rows: DataFrame) -> DataFrame:
    """``rows`` (latitude, longitude, weight) with ``probability``, the weight's share of the largest, and an ``id``."""
    top = rows.agg(F.max("weight").alias("top"))
    return rows.join(F.broadcast(top)).withColumn("probability", F.col("weight") / F.col("top")).withColumn("id", key_id("place", *[F.floor(F.col(c) * 1e6 + 0.5).cast("long") for c in ("latitude", "longitude")])).drop("top")


def operational_forecast(
    catalog: DataFrame, record: dict, ring: list[tuple[float, float]], start: float, days: float, catalogs: int, seed: int = simulation.SEED, grid: DataFrame | None = None, cell: tuple[float, float] | None = None,
    m_threshold: float | None = None, sources: DataFrame | None = None, zones: simulation.Zones | None = None,
) -> DataFrame:
    """Forecast events after ``start`` from a stored fit and the latest catalog.

    With ``grid`` (latitude, longitude, weight), background events happen at its nodes
    by weight, spread over the grid's ``cell`` (height, width) if one is given, instead of uniformly; offspring and
    the region's filter start from there. With a fit's stored ``sources`` (source_id, and perhaps
    xi_plus_1), the history is these events of the catalog, with their productivity inflated for what
    completeness hides (see ``prepared_history``), and events since the fit.
    """
    process = simulation.Process(theta_of(record), record["beta"], record["m_ref"], record["delta_m"], seed=seed)
    history, xi = catalog, None
    if sources is not None:
        known = simulation.prepared_history(sources, catalog, record["m_ref"])
        later = catalog.filter((F.col("days") >= record["setup"]["end"]) & (F.col("magnitude") >= record["m_ref"] - record["delta_m"] / 2)) if record.get("setup") else None
        if later is not None:
            later = later.join(known.select("id"), "id", "left_anti").select(*[F.col(c) for c in known.columns if c != "xi_plus_1"]).withColumn("xi_plus_1", F.lit(1.0))
        history, xi = known if later is None else known.unionByName(later), "xi_plus_1"
    return simulation.forecast(history, process, ring, start, days, record["area"], catalogs, m_threshold, xi=xi, places=None if grid is None else weighted_places(grid), place_scale=0.0, place_cell=cell, zones=zones)


def gridded_thinning(history: DataFrame, theta: Theta, mc: float, beta: float, lat: tuple[float, float, int], lon: tuple[float, float, int], start: float, end: float, seeds: int = 1) -> DataFrame:
    """Thinning on a regular grid of nodes ((low, high, nodes) of each axis), by the normalised kernels of ``theta``."""
    from ..operators.pairs import grid_of

    nodes = grid_of(lat[0], lat[1], lon[0], lon[1], lat[2], lon[2], history.sparkSession)
    cell = (lat[1] - lat[0]) / max(1, lat[2] - 1) * (lon[1] - lon[0]) / max(1, lon[2] - 1)
    return simulation.gridded(history, to_rate_params(theta, mc), nodes, start, end, mc, beta, seeds, cell=cell)


def grid_in_ring(ring: list[tuple[float, float]], nodes_per_km2: float, tolerance: float = 0.05, most: int = 40, utm: bool = False) -> tuple[list[tuple[float, float]], dict]:
    """(nodes, facts): a regular grid's nodes inside a ring, about ``nodes_per_km2`` of them for each km2 of its area.

    Nodes are (lat, lon), or with ``utm`` (easting, northing) in the zone of the ring's centroid. The
    spacing is adjusted until the count is within ``tolerance`` of what the area asks for, or
    ``most`` times; ``facts`` has the area, wanted and found counts, spacing in km and nodes of an axis.
    """
    if nodes_per_km2 <= 0:
        raise ValueError("the density must be positive")
    area = geo.albers_area(ring)
    middle = geo.centroid(ring)
    if utm:
        zone = geo.utm_zone(*middle)
        x, y = geo.transverse_mercator(np.array([p[0] for p in ring]), np.array([p[1] for p in ring]), zone)
        plane, scale = list(zip(x.tolist(), y.tolist())), (1000.0, 1000.0)
    else:
        per_lat = 2 * math.pi * geo.EARTH_RADIUS / 360
        lats = [p[0] for p in ring]
        lat = (min(lats) + max(lats)) / 2
        per_lon = 2 * geo.EARTH_RADIUS * math.asin(abs(math.cos(math.radians(lat))) * math.sin(math.radians(0.5)))
        plane, scale = [tuple(map(float, p)) for p in ring], (1 / per_lat, 1 / per_lon)
    a_lo, a_hi, b_lo, b_hi = geo.box_of(plane)
    if not (a_lo < a_hi and b_lo < b_hi and math.isfinite(a_lo + a_hi + b_lo + b_hi)):
        raise ValueError("the ring has no area")
    wanted = max(1, round(area * nodes_per_km2))
    spacing, inside, shape = math.sqrt(area / wanted), (np.zeros(0), np.zeros(0)), (0, 0)
    for _ in range(most):
        a = np.linspace(a_lo, a_hi, max(2, math.ceil((a_hi - a_lo) / (spacing * scale[0])) + 1))
        b = np.linspace(b_lo, b_hi, max(2, math.ceil((b_hi - b_lo) / (spacing * scale[1])) + 1))
        p, q = (g.ravel() for g in np.meshgrid(a, b, indexing="ij"))
        here = geo.contained(plane, p, q)
        n = int(here.sum())
        if not n:
            spacing /= 2
            continue
        inside, shape = (p[here], q[here]), (len(a), len(b))
        if abs(n - wanted) <= tolerance * wanted:
            break
        spacing *= math.sqrt(n / wanted)
    if not len(inside[0]):
        raise RuntimeError(f"no node of a grid lies in the ring (area {area:.4g} km2, {wanted} nodes wanted)")
    nodes = list(zip(inside[0].tolist(), inside[1].tolist()))
    return nodes, {"area_km2": area, "wanted": wanted, "found": len(nodes), "spacing_km": spacing, "shape": shape}


def box_steps(ring: list[tuple[float, float]], shape: tuple[int, int], inset: float = 0.0) -> tuple[float, float, float, float]:
    """(lowest latitude and its step, lowest longitude and its step) of ``shape`` nodes over a ring's box, ``inset`` steps from its edges: with 0.5, the middles of cells."""
    a, b, c, d = geo.box_of(ring)
    if min(shape) < 2 or not (a < b and c < d):
        raise ValueError("a grid needs two nodes on each axis and a ring with an area")
    step, across = (b - a) / (shape[0] - 1 + 2 * inset), (d - c) / (shape[1] - 1 + 2 * inset)
    return a + inset * step, step, c + inset * across, across


def grid_table(spark: SparkSession, ring: list[tuple[float, float]], shape: tuple[int, int], inset: float = 0.0) -> DataFrame:
    """(i, j, latitude, longitude): nodes of a regular grid of ``shape`` (rows, columns) over a ring's box that lie in the ring, made by the tasks."""
    low, step, west, across = box_steps(ring, shape, inset)
    nodes = spark.range(shape[0] * shape[1]).select(F.expr(f"id div {shape[1]}").alias("i"), (F.col("id") % shape[1]).alias("j"))
    nodes = nodes.select("i", "j", (F.lit(low) + F.col("i") * step).alias("latitude"), (F.lit(west) + F.col("j") * across).alias("longitude"))
    return nodes.filter(geo.in_polygon(F.col("latitude"), F.col("longitude"), ring))


def grid_at_density(spark: SparkSession, ring: list[tuple[float, float]], nodes_per_km2: float, tolerance: float = 0.05, most: int = 40) -> tuple[DataFrame, dict]:
    """``grid_in_ring`` as a table: nodes are made and counted by tasks, so a grid may have any number of them."""
    if nodes_per_km2 <= 0:
        raise ValueError("the density must be positive")
    area = geo.albers_area(ring)
    wanted, (a, b, c, d) = max(1, round(area * nodes_per_km2)), geo.box_of(ring)
    per_lat = 2 * math.pi * geo.EARTH_RADIUS / 360
    per_lon = 2 * geo.EARTH_RADIUS * math.asin(abs(math.cos(math.radians((a + b) / 2))) * math.sin(math.radians(0.5)))
    spacing = math.sqrt(area / wanted)
    for _ in range(most):
        shape = (max(2, math.ceil((b - a) * per_lat / spacing) + 1), max(2, math.ceil((d - c) * per_lon / spacing) + 1))
        nodes = grid_table(spark, ring, shape)
        n = nodes.count()
        if n and abs(n - wanted) <= tolerance * wanted:
            break
        spacing *= math.sqrt(n / wanted) if n else 0.5
    if not n:
        raise RuntimeError(f"no node of a grid lies in the ring (area {area:.4g} km2, {wanted} nodes wanted)")
    return nodes, {"area_km2": area, "wanted": wanted, "found": n, "spacing_km": spacing, "shape": shape}


def node_counts(events: DataFrame, ring: list[tuple[float, float]], shape: tuple[int, int], inset: float = 0.0) -> DataFrame:
    """(i, j, n): events whose nearest node of ``grid_table`` is (i, j), for nodes in the ring. The node follows from the place, so nothing is joined."""
    low, step, west, across = box_steps(ring, shape, inset)
    i, j = F.floor((F.col("latitude") - low) / step + 0.5), F.floor((F.col("longitude") - west) / across + 0.5)
    counts = events.filter("latitude IS NOT NULL AND longitude IS NOT NULL").groupBy(i.alias("i"), j.alias("j")).agg(F.count(F.lit(1)).alias("n"))
    inside = F.col("i").between(0, shape[0] - 1) & F.col("j").between(0, shape[1] - 1)
    return counts.filter(inside & geo.in_polygon(F.lit(low) + F.col("i") * step, F.lit(west) + F.col("j") * across, ring))


def area_of_grid(nodes: DataFrame) -> DataFrame:
    """One row: km2 of a regular grid (lat, lon), from the mean steps of its distinct latitudes and longitudes at its mean latitude."""
    steps = nodes.agg(F.count(F.lit(1)).alias("n"), F.avg("lat").alias("middle"), F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("d"), F.count_distinct("lat").alias("rows"), F.count_distinct("lon").alias("cols"))
    per_lat, per_lon = geo.km_per_degree(F.col("middle"))
    regular = (F.col("b") - F.col("a")) / (F.col("rows") - 1) * per_lat * (F.col("d") - F.col("c")) / (F.col("cols") - 1) * per_lon * F.col("n")
    line = F.greatest((F.col("b") - F.col("a")) * per_lat * (F.col("d") - F.col("c")) * per_lon, F.lit(1e-12))
    return steps.select(F.when((F.col("rows") > 1) & (F.col("cols") > 1), regular).otherwise(line).alias("area_km2"))
