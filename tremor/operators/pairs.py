"""The space-time pair table and other joins of events with events.

A range join is rewritten to an equi-join: sources fall into classes by their radius;
each class has a grid whose cells are as wide as its largest radius, so a source meets
only targets of its own and neighbouring cells, and the exact distance decides. No plan
compares all pairs; a source whose radius spans the globe has as many pairs as targets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS, haversine, rupture
from ..sources.stage import materialized
from .ordered import with_trailing_count

KM_PER_DEGREE = 2 * math.pi * EARTH_RADIUS / 360
#: Radii of a class differ by this factor at most; the smallest class holds all radii up to the first.
SMALLEST_KM, FACTOR = 10.0, 2.0
LARGEST_CLASS = math.ceil(math.log(math.pi * EARTH_RADIUS / SMALLEST_KM, FACTOR))


def _rows(height: Column) -> Column:
    return F.ceil(F.lit(180.0) / height).cast("int")


def _width(row: Column, height: Column) -> Column:
    """Cells around the globe in a row: as many as keep each one as wide as the class's radius everywhere in it."""
    far = F.greatest(F.abs(row * height - 90), F.abs((row + 1) * height - 90))
    return F.when(far >= 89, 1).otherwise(F.greatest(F.lit(1), F.floor(F.lit(360.0) * F.cos(F.radians(far)) / height).cast("int")))


#: Targets in a target's own cell, on average, beyond which cells are cut by time; most slices are two to this power.
SLICE_ROWS, MOST_CUTS = 1 << 14, 5


def within_radius(sources: DataFrame, targets: DataFrame, radius_km: Column, later: bool = False) -> DataFrame:
    """Pairs of ``sources`` and ``targets`` (each with ``latitude``, ``longitude``) at most ``radius_km`` apart.

    Columns are those of both frames with the prefixes ``source_`` and ``target_``, and
    ``distance_km``. ``radius_km`` is an expression of ``sources``. Rows without a place or
    radius have no pairs. With ``later``, both frames have ``days``, and a pair's target is later than its source.
    """
    s, t = in_cells(sources, targets, radius_km)
    if later:
        s, t = _sliced(s, t, targets)
    # One number for a cell, and what follows from a place is worked out behind the exchange: it would be most of what is written.
    s, t = (_on_sphere(_dealt(df), side) for df, side in ((s, "source"), (t, "target")))
    chord2 = 4 * F.pow(F.sin(F.least(F.greatest(F.col("_radius"), F.lit(0.0)) / (2 * EARTH_RADIUS), F.lit(math.pi / 2))), F.lit(2.0))
    s = s.withColumns({"_chord2": chord2 * (1 + 1e-9) + 1e-12, "_sure2": chord2 * (1 - 1e-9) - 1e-12})
    # Times and chords first: the exact distance decides where the chord is too near the radius to do so.
    chord2 = sum(((F.col(f"_source_{c}") - F.col(f"_target_{c}")) * (F.col(f"_source_{c}") - F.col(f"_target_{c}")) for c in "xyz"), F.lit(0.0))
    distance = haversine(F.col("source_latitude"), F.col("source_longitude"), F.col("target_latitude"), F.col("target_longitude"), cosines=(F.col("_source_cos"), F.col("_target_cos")))
    found = (chord2 <= F.col("_chord2")) & ((chord2 <= F.col("_sure2")) | (distance <= F.col("_radius")))
    near = s.join(t.hint("merge"), "_tile").filter((F.col("target_days") > F.col("source_days")) & found if later else found).withColumn("distance_km", distance)
    return near.drop("_tile", "_radius", "_chord2", "_sure2", *[f"_{side}_{c}" for side in ("source", "target") for c in ("x", "y", "z", "cos")])


def _dealt(df: DataFrame) -> DataFrame:
    """Rows of ``in_cells`` dealt by ``_tile``, which stands for class, cell and slice."""
    tile = ((F.col("_kind").cast("long") * 65536 + F.col("_row")) * 65536 + F.col("_cell")) * 2**MOST_CUTS + (F.col("_slice") if "_slice" in df.columns else 0)
    return df.select(tile.alias("_tile"), *[c for c in df.columns if c not in ("_kind", "_row", "_cell", "_slice")]).repartition("_tile")


def _sliced(s: DataFrame, t: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames of ``in_cells`` with ``_slice``: targets of crowded classes are cut by time, and a source goes to its own slice and all later ones.

    Cells of wide classes hold most of a catalog's targets, and one task would make all their pairs. A class has as
    many slices as its cells need; cuts are quantiles of all targets, so that any cuts give the same pairs.
    """
    cells = t.groupBy("_kind", "_row", "_cell").agg(F.count(F.lit(1)).cast("double").alias("n"))
    crowds = cells.groupBy("_kind").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("n")).collect()  # ``LARGEST_CLASS`` + 1 at most
    cuts = {r["_kind"]: min(MOST_CUTS, max(0, math.ceil(math.log2(r["n"] / SLICE_ROWS)))) for r in crowds}
    most = max(cuts.values(), default=0)
    if not most:
        return s, t
    at = targets.approxQuantile("days", [k / 2**most for k in range(1, 2**most)], 0.25 / 2**most)

    def place(days: Column, low: int = 0, high: int = len(at)) -> Column:
        """The number of cuts up to ``days``."""
        half = (low + high) // 2
        return F.lit(low) if low == high else F.when(days < at[half], place(days, low, half)).otherwise(place(days, half + 1, high))

    of = lambda value: F.element_at(F.array(*[F.lit(value(cuts.get(k, 0))) for k in range(LARGEST_CLASS + 1)]), F.col("_kind") + 1)
    own = lambda days: F.floor(place(F.col(days)) / of(lambda n: 2 ** (most - n))).cast("int")
    s = s.withColumn("_slice", F.explode(F.sequence(own("source_days"), of(lambda n: 2**n - 1))))
    return s, t.withColumn("_slice", own("target_days"))


def in_cells(sources: DataFrame, targets: DataFrame, radius_km: Column) -> tuple[DataFrame, DataFrame]:
    """Both frames with ``_kind``, ``_row`` and ``_cell``: sources (with ``_radius``) in all cells that their radius meets, targets in their own.

    Columns have the prefixes ``source_`` and ``target_``. Targets are dealt only to classes that have sources.
    """
    size = lambda k: F.lit(SMALLEST_KM / KM_PER_DEGREE * 1.001) * F.pow(F.lit(FACTOR), k)
    kind = F.greatest(F.lit(0), F.least(F.lit(LARGEST_CLASS), F.ceil(F.log(F.greatest(radius_km, F.lit(1e-9)) / SMALLEST_KM) / math.log(FACTOR)))).cast("int")
    # Dealt evenly, as a few tasks would otherwise make all pairs where the targets are broadcast.
    s = sources.repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    s = s.select(*[F.col(c).alias(f"source_{c}") for c in sources.columns], radius_km.alias("_radius"), kind.alias("_kind"))
    s = s.filter("_radius IS NOT NULL AND source_latitude IS NOT NULL AND source_longitude IS NOT NULL")
    h = size(F.col("_kind"))
    kinds = sources.select(kind.alias("_kind")).filter("_kind IS NOT NULL")
    lat, lon = F.col("source_latitude"), F.col("source_longitude")
    reach = F.col("_radius") * 1.001 / KM_PER_DEGREE
    row = lambda x: F.floor((x + 90) / h).cast("int")
    s = s.withColumn("_row", F.explode(F.sequence(F.greatest(F.lit(0), F.least(_rows(h), row(lat - reach))), F.greatest(F.lit(0), F.least(_rows(h), row(lat + reach))))))
    n = _width(F.col("_row"), h)
    # Within the radius, longitudes differ by at most the angle below, whatever the target's latitude.
    angle = F.when(F.abs(lat) + reach >= 89, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(reach)) / F.cos(F.radians(lat))))))
    at, span = F.pmod(lon, F.lit(360.0)) / 360 * n, angle * n / 360 + 1e-9
    first = F.floor(at - span).cast("int")
    cells = F.transform(F.sequence(first, F.least(F.floor(at + span).cast("int"), first + n - 1)), lambda c: F.pmod(c, n))
    s = s.withColumn("_cell", F.explode(cells))
    t = targets.select(*[F.col(c).alias(f"target_{c}") for c in targets.columns]).filter("target_latitude IS NOT NULL AND target_longitude IS NOT NULL")
    used = sorted(r[0] for r in kinds.distinct().collect())  # ``LARGEST_CLASS`` + 1 at most
    t = t.withColumn("_kind", F.explode(F.array(*[F.lit(k) for k in used]) if used else F.array().cast("array<int>")))
    h = size(F.col("_kind"))
    t = t.withColumn("_row", F.floor((F.col("target_latitude") + 90) / h).cast("int"))
    t = t.withColumn("_cell", F.floor(F.pmod(F.col("target_longitude"), F.lit(360.0)) / 360 * _width(F.col("_row"), h)).cast("int"))
    return s, t


def _on_sphere(df: DataFrame, side: str) -> DataFrame:
    """``df`` with the unit vector of its place, and the latitude's cosine."""
    lat, lon = F.radians(f"{side}_latitude"), F.radians(f"{side}_longitude")
    return df.withColumns({f"_{side}_x": F.cos(lat) * F.cos(lon), f"_{side}_y": F.cos(lat) * F.sin(lon), f"_{side}_z": F.sin(lat), f"_{side}_cos": F.cos(lat)})


def reach_of(magnitude: Column, multiplier: float = 100.0, fault: str = "oblique") -> Column:
    """The distance in km up to which an event is a source of later ones."""
    return F.lit(multiplier) * rupture(magnitude, "ssrl", fault)


def later_pairs(sources: DataFrame, targets: DataFrame, radius_km: Column) -> DataFrame:
    """``within_radius`` of sources and later targets (both with ``days``), with ``time_distance`` and ``spatial_distance_squared``; nothing is written."""
    near = within_radius(sources, targets, radius_km, later=True)
    return near.withColumns({"time_distance": F.col("target_days") - F.col("source_days"), "spatial_distance_squared": F.col("distance_km") * F.col("distance_km")})


def pair_table(catalog: DataFrame, start: float, multiplier: float = 100.0, fault: str = "oblique", units_per_km: float | None = None) -> DataFrame:
    """Sources and later targets within the source's scaled rupture length.

    Every event is a source; targets are those from ``start`` on (inclusive). Columns:
    ``source_id``, ``target_id``, ``source_magnitude``, ``target_days``, ``time_distance``
    (days), ``spatial_distance_squared`` (km2), and ``target_mc`` and ``source_mc`` if the
    catalog has ``mc_current``. With ``units_per_km``, events lie in space (x, y, z in these
    units), distances are Euclid's, and squared distances are in squared units.
    """
    places = ["latitude", "longitude"] if units_per_km is None else ["x", "y", "z"]
    own = ["id", "days", *places, "magnitude", *(["mc_current"] if "mc_current" in catalog.columns else [])]
    events = catalog.select(*own)
    reach = reach_of(F.col("magnitude"), multiplier, fault)
    targets = events.filter(F.col("days") >= start)
    if units_per_km is None:
        pairs = within_radius(events, targets, reach, later=True)
    else:
        pairs = within_radius_3d(events, targets, reach * F.lit(units_per_km)).withColumnRenamed("distance", "distance_km").filter("target_days > source_days")
    extra = [F.col("source_mc_current").alias("source_mc"), F.col("target_mc_current").alias("target_mc")] if "mc_current" in own else []
    return pairs.select("source_id", "target_id", "source_magnitude", "target_days", (F.col("target_days") - F.col("source_days")).alias("time_distance"), (F.col("distance_km") * F.col("distance_km")).alias("spatial_distance_squared"), *extra)


#: Radii of the smallest class of ``within_radius_3d``, in units of the points, and the number of classes.
SMALLEST_3D, CLASSES_3D = 1e-3, 40


def within_radius_3d(sources: DataFrame, targets: DataFrame, radius: Column, wide: float = 1.0) -> DataFrame:
    """Pairs of points (x, y, z) at most ``radius`` (an expression of ``sources``) apart, as ``within_radius``, with ``distance``."""
    s, t = in_cubes(sources, targets, radius, wide)
    square = sum(((F.col(f"source_{c}") - F.col(f"target_{c}")) * (F.col(f"source_{c}") - F.col(f"target_{c}")) for c in "xyz"), F.lit(0.0))
    keys = ["_kind", "_x", "_y", "_z"]
    # Merged, not broadcast: the size of what is exploded is not known to the plan, and the driver would hold it.
    return s.join(t.hint("merge"), keys).withColumn("distance", F.sqrt(square)).filter("distance <= _radius").drop(*keys, "_radius")


def in_cubes(sources: DataFrame, targets: DataFrame, radius: Column, wide: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Both frames with ``_kind``, ``_x``, ``_y`` and ``_z``: sources (with ``_radius``) in all cubes that their ball meets, targets in their own.

    Sources fall into classes by radius, each with cubes ``wide`` times its largest radius: wider ones copy sources less
    and compare more points. Targets are dealt only to classes that have sources.
    """
    power = F.ceil(F.log(F.greatest(radius, F.lit(1e-300)) / SMALLEST_3D) / math.log(2.0))
    kind = F.greatest(F.lit(0), F.least(F.lit(CLASSES_3D), power)).cast("int")
    s = sources.select(*[F.col(c).alias(f"source_{c}") for c in sources.columns], radius.alias("_radius"), kind.alias("_kind"))
    s = s.filter("_radius >= 0 AND NOT isnan(_radius) AND source_x IS NOT NULL AND source_y IS NOT NULL AND source_z IS NOT NULL")
    used = sorted(r[0] for r in s.select("_kind").distinct().collect())  # ``CLASSES_3D`` at most
    t = targets.select(*[F.col(c).alias(f"target_{c}") for c in targets.columns]).filter("target_x IS NOT NULL AND target_y IS NOT NULL AND target_z IS NOT NULL")
    t = t.withColumn("_kind", F.explode(F.array(*[F.lit(k) for k in used]) if used else F.array().cast("array<int>")))
    width = F.lit(SMALLEST_3D * wide) * F.pow(F.lit(2.0), F.col("_kind")) * 1.0000001
    cell = lambda x: F.floor(x / width).cast("long")
    # Room for rounding; the distance decides. The last class holds all larger radii.
    far = F.least(F.col("_radius") * (1 + 1e-9) + 1e-150, width)
    room = F.col("_radius") * (1 + 1e-9) + 1e-150 + sum((F.abs(F.col(f"source_{c}")) for c in "xyz"), F.lit(0.0)) * 1e-12
    for c in "xyz":
        s = s.withColumn(f"_{c}", F.explode(F.sequence(cell(F.col(f"source_{c}") - far), cell(F.col(f"source_{c}") + far))))
        t = t.withColumn(f"_{c}", cell(F.col(f"target_{c}")))
    gap = [F.greatest(F.lit(0.0), F.col(f"_{c}") * width - F.col(f"source_{c}"), F.col(f"source_{c}") - (F.col(f"_{c}") + 1) * width) for c in "xyz"]
    return s.filter(F.sqrt(sum((g * g for g in gap), F.lit(0.0))) <= room), t


#: Cubes of ``pair_table_3d``, in radii of its class.
WIDE_3D = 2.0


def pair_table_3d(points: DataFrame, radius: float) -> DataFrame:
    """Pairs (source_id < target_id, distance_squared) of points (id, x, y, z) at most ``radius`` apart."""
    own = points.select("id", "x", "y", "z")
    near = within_radius_3d(own, own, F.lit(radius), WIDE_3D).filter("source_id < target_id")
    return near.select("source_id", "target_id", (F.col("distance") * F.col("distance")).alias("distance_squared"))


def nearest(catalog: DataFrame, start_km: float = 2.0) -> DataFrame:
    """(id, nearest_id, distance_km) of each event's nearest other one; ties go to the smaller id.

    Events at one place are each other's nearest. Other places search within a radius that
    grows eightfold for those that found none, so each round joins only what is left. An
    event without a place, or alone in the catalog, has no row.
    """
    events = catalog.select("id", "latitude", "longitude").filter("latitude IS NOT NULL AND longitude IS NOT NULL")
    place = ["latitude", "longitude"]
    first = events.groupBy(*place).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    members = events.join(first, place)
    second = members.filter("id != first").groupBy(*place).agg(F.min("id").alias("second"))
    shared = members.join(second, place).select("id", F.when(F.col("id") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("nearest_id"), F.lit(0.0).alias("distance_km"))
    places = materialized(first.select(F.col("first").alias("id"), *place, "n"))
    left, found, radius = places.filter("n = 1"), shared, start_km
    while True:
        near = within_radius(left.select("id", *place), places.select("id", *place), F.lit(radius)).filter("source_id != target_id")
        got = near.groupBy(F.col("source_id").alias("id")).agg(F.min_by("target_id", F.struct("distance_km", "target_id")).alias("nearest_id"), F.min("distance_km").alias("distance_km"))
        got = materialized(got)
        found = found.unionByName(got)
        left = materialized(left.join(got, "id", "left_anti"))
        if radius > math.pi * EARTH_RADIUS or left.isEmpty():
            return found
        radius *= 8


def joined_whole(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on ``key`` that keeps each row of ``left`` once: a key that ``right`` has twice is an error."""
    n, keys = right.agg(F.count(key), F.count_distinct(key)).head()
    if n != keys:
        raise ValueError(f"{key} is not unique: {n} rows have {keys} values")
    return left.join(right, key, "left")


def trailing_count(catalog: DataFrame, days: int, least: float) -> DataFrame:
    """Events of at least ``least`` in the ``days`` before each event (the event itself and its time left out)."""
    return with_trailing_count(catalog, F.col("magnitude") >= least, days, "past")


def local_magnitudes(nodes: DataFrame, events: DataFrame, radius_km: float, delta_m: float = 0.1, least: int = 100) -> DataFrame:
    """(cell, n, mc, beta) around each node (cell, glat, glon) with at least ``least`` events in its radius.

    Local completeness is the most frequent bin (the smaller of equals); beta is of the
    events from it on. Counts by bin come first, so a node costs as many rows as it has bins.
    """
    around = within_radius(nodes.select("cell", F.col("glat").alias("latitude"), F.col("glon").alias("longitude")), events.select("latitude", "longitude", "magnitude"), F.lit(radius_km))
    bins = around.groupBy(F.col("source_cell").alias("cell"), F.floor(F.col("target_magnitude") / delta_m + 0.5).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    tops = bins.groupBy("cell").agg(F.sum("n").alias("all"), F.max_by("k", F.struct("n", -F.col("k"))).alias("top")).filter(F.col("all") >= least)
    kept = bins.join(tops, "cell").filter("k >= top").groupBy("cell", "all", "top").agg((F.sum(F.col("n") * (F.col("k") - F.col("top"))) * F.lit(delta_m) / F.sum("n")).alias("excess"))
    return kept.select("cell", F.col("all").alias("n"), (F.col("top") * F.lit(delta_m)).alias("mc"), F.try_divide(F.log(1 + F.try_divide(F.lit(delta_m), F.col("excess"))), F.lit(delta_m)).alias("beta"))


def grid_of(lat_lo: float, lat_hi: float, lon_lo: float, lon_hi: float, rows: int, columns: int, spark) -> DataFrame:
    """Nodes (cell, glat, glon) of a regular grid with both ends."""
    r, c = F.shiftright("cell", 0) % rows, (F.col("cell") / rows).cast("int")
    step = lambda lo, hi, n: (hi - lo) / max(1, n - 1)
    return spark.range(rows * columns).withColumnRenamed("id", "cell").select("cell", (F.lit(lat_lo) + r * F.lit(step(lat_lo, lat_hi, rows))).alias("glat"), (F.lit(lon_lo) + c * F.lit(step(lon_lo, lon_hi, columns))).alias("glon"))
