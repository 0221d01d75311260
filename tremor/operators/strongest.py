"""For each target the earlier source that adds most to its rate, without all pairs.

A source adds exp(weight) * decay(delay) / (distance^2 + zone)^power, which falls with delay and distance, so a set of targets in
a box of space and time has a bound of what a source can add to any of them. Targets are dealt into units by place (and
time, where a place has many). First each unit looks among its own sources, which gives every target a floor. Then a source goes to those units only
where it can reach a floor of the targets after it. In a unit, boxes of targets are halved, and sources below the
floors of a box are left out, until a few targets meet the rest one by one. No pair that could win, or tie, is left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS
from ..sources.stage import materialized
from .blocks import unit
from .ordered import cuts_of

#: Targets of a unit, about; most cells along the longest side of the sources' box; slices of time; neighbours in order that give first floors.
ROWS, MOST_SIDE, SLICES, SEEDS = 4096, 64, 256, 12
#: Targets that meet sources one by one; the strongest of these, which come first; places in a strip. Room for the rounding of bounds.
LEAF, FIRST, STRIP, ROOM = 32, 64, 1 << 18, 1e-9

Arrays = dict[str, np.ndarray]
NONE = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Law:
    """Logarithm of what a source adds: ``weight`` - ``p`` log(delay + c) - delay / tau - ``power`` log(distance^2 + ``zone``)."""

    c: float
    p: float
    tau: float
    power: float

    def decay(self, dt: np.ndarray) -> np.ndarray:
        out = -self.p * np.log(dt + self.c)
        return out if self.tau == math.inf else out - dt / self.tau


def strongest(targets: DataFrame, sources: DataFrame, law: Law, rows: int = ROWS) -> DataFrame:
    """(key, best, pid): logarithm of the largest share and the smallest key of the earlier sources that have it; null where none has one.

    ``targets`` have key, days, latitude and longitude; ``sources`` also ``weight`` and ``zone``. Rows where one of these is not known are left out.
    """
    spark = targets.sparkSession
    known = lambda df, *more: df.dropna(subset=["key", "days", "latitude", "longitude", *more])
    targets, sources = known(targets).select("key", "days", "latitude", "longitude"), known(sources, "weight", "zone").select("key", "days", "latitude", "longitude", "weight", "zone")
    lat, lon = F.radians("latitude"), F.radians("longitude")
    spots = {"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)}
    box = targets.select(*[c.alias(n) for n, c in spots.items()]).agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}_{c}") for c in spots for n, f in (("lo", F.min), ("hi", F.max))]).head()
    low = [box[f"lo_{c}"] or 0.0 for c in "xyz"]
    side = max(1, min(MOST_SIDE, math.isqrt(box.n // rows)))
    width = max((box[f"hi_{c}"] or 0.0) - lo for c, lo in zip("xyz", low)) / side or 1.0
    cuts = np.array(cuts_of(targets, F.col("days"), max(1, box.n // SLICES)))
    cell = sum(F.greatest(F.lit(0), F.least(F.lit(side - 1), F.floor((c - lo) / width))) * side**k for k, (c, lo) in enumerate(zip(spots.values(), low)))
    counts = sorted((r.cell, r.n) for r in targets.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect())  # a few thousand
    cells, parts = np.array([c for c, _ in counts], np.int64), np.array([min(SLICES, math.ceil(n / rows)) for _, n in counts], np.int64)
    first = np.concatenate(([0], np.cumsum(parts)))
    units, size = int(first[-1]), int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = max(size, math.ceil(units / 8))

    def slices(days: np.ndarray) -> np.ndarray:
        return np.searchsorted(cuts, days, "right")

    def unit_of(x: list[np.ndarray], days: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The unit of each row's place and time, -1 where no target's cell is; and whether the next unit has the same cell."""
        at = [np.clip(np.floor((v - lo) / width), 0, side - 1).astype(np.int64) for v, lo in zip(x, low)]
        c = at[0] + at[1] * side + at[2] * side * side
        if not len(cells):
            return np.full(len(c), -1), np.zeros(len(c), bool)
        k = np.minimum(np.searchsorted(cells, c), len(cells) - 1)
        part = slices(days) * parts[k] // (len(cuts) + 1)
        there = cells[k] == c
        return np.where(there, first[k] + part, -1), there & (part + 1 < parts[k])

    names = ["key", "days", "x", "y", "z"]

    def read(batch: pa.RecordBatch, more: tuple[str, ...]) -> Arrays:
        found = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "days", *more)}
        return found | dict(zip("xyz", unit(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("latitude", "longitude")))))

    def put(found: Arrays, at: np.ndarray, units: np.ndarray, columns: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(units, pa.int32()), *[pa.array(found[c][at]) for c in columns]], ["unit", *columns])

    def place_targets(batches):
        for batch in batches:
            found = read(batch, ())
            yield put(found, np.arange(batch.num_rows), unit_of([found[c] for c in "xyz"], found["days"])[0], names)

    def place_sources(batches):
        for batch in batches:
            found = read(batch, ("weight", "zone"))
            own, more = unit_of([found[c] for c in "xyz"], found["days"])
            at = np.concatenate((np.flatnonzero(own >= 0), np.flatnonzero(more)))
            yield put(found, at, np.concatenate((own[own >= 0], own[more] + 1)), [*names, "weight", "zone"])

    of_target = "unit int, key long, days double, x double, y double, z double"
    of_source = of_target + ", weight double, zone double"
    t, s = targets.mapInArrow(place_targets, of_target), sources.mapInArrow(place_sources, of_source)
    fields = ["unit", *names, "best", "pid"]

    def arrays(table: pa.Table) -> Arrays:
        return {c: table.column(c).to_numpy() for c in table.column_names}

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = arrays(left), arrays(right)
        with np.errstate(all="ignore"):
            a |= {"best": np.full(len(a["key"]), -math.inf), "pid": np.full(len(a["key"]), NONE)}
            _search(a, b, law, _seeds(a, b, law))
        return pa.table([pa.array(a[c]) for c in fields], fields)

    floors = materialized(t.repartition(size, "unit").groupBy("unit").cogroup(s.repartition(size, "unit").groupBy("unit")).applyInArrow(near, of_target + ", best double, pid long"))

    def lowest(table: pa.Table) -> pa.Table:
        """The box of a unit's targets, and of each slice the least floor and day."""
        a = arrays(table)
        at = slices(a["days"])
        seen = np.unique(at)
        return pa.table({"unit": pa.array([int(a["unit"][0])], pa.int32()), "lo": [[float(a[c].min()) for c in "xyz"]], "hi": [[float(a[c].max()) for c in "xyz"]], "slice": [seen.tolist()], "floor": [[float(a["best"][at == k].min()) for k in seen]], "day": [[float(a["days"][at == k].min()) for k in seen]]})

    listed = floors.groupBy("unit").applyInArrow(lowest, "unit int, lo array<double>, hi array<double>, slice array<long>, floor array<double>, day array<double>").collect()  # a row a unit
    lo, hi = (np.array([r[c] for r in listed]).reshape(-1, 3) for c in ("lo", "hi"))
    numbers = np.array([r.unit for r in listed], np.int32)
    # What a source of a slice must add, but for its delay: exp(-need / power), 0 where no target is after it.
    reach, until = np.zeros((len(cuts) + 1, len(listed))), np.append(cuts, math.inf)
    for u, r in enumerate(listed):
        at, floor, day = np.array(r["slice"]), np.array(r["floor"]) - ROOM, np.array(r["day"])
        with np.errstate(all="ignore"):
            need = floor[:, None] - law.decay(np.maximum(day[:, None] - until, 0.0))
            need[at[:, None] < np.arange(len(until))] = math.inf
            reach[:, u] = np.exp(-need.min(axis=0) / law.power) * (1 + 1e-9)
    held = spark.sparkContext.broadcast((numbers, lo, hi, reach))

    def reaching(batches):
        """Each source in the units where it can reach a floor, but for those that have met it."""
        numbers, lo, hi, reach = held.value
        step = max(1, (STRIP * 4) // max(1, len(numbers)))
        for batch in batches:
            whole = read(batch, ("weight", "zone"))
            own, more = unit_of([whole[c] for c in "xyz"], whole["days"])
            for a in range(0, batch.num_rows, step):
                cut = slice(a, a + step)
                gap2 = np.zeros((len(own[cut]), len(numbers)))
                for k, c in enumerate("xyz"):
                    v = whole[c][cut, None]
                    off = np.maximum(lo[:, k] - v, v - hi[:, k])
                    np.maximum(off, 0.0, out=off)
                    off *= off
                    gap2 += off
                gap2 *= EARTH_RADIUS**2 * (1 - 1e-9)
                with np.errstate(all="ignore"):
                    most = np.exp(whole["weight"][cut] / law.power)[:, None] * reach[slices(whole["days"][cut])]
                met = gap2 + whole["zone"][cut, None] * (1 - 1e-9) <= most
                met &= (numbers != own[cut, None]) & ~(more[cut, None] & (numbers == own[cut, None] + 1))
                i, u = np.nonzero(met)
                if len(i):
                    yield put(whole, i + a, numbers[u], [*names, "weight", "zone"])

    far = sources.mapInArrow(reaching, of_source)

    def rest(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = arrays(left), arrays(right)
        with np.errstate(all="ignore"):
            a |= {"best": a["best"].copy(), "pid": a["pid"].copy()}
            _search(a, b, law, a["best"].copy())
        none = a["pid"] == NONE
        return pa.table([pa.array(a["key"]), pa.array(a["best"], mask=none), pa.array(a["pid"], mask=none)], ["key", "best", "pid"])

    return floors.repartition(size, "unit").groupBy("unit").cogroup(far.repartition(size, "unit").groupBy("unit")).applyInArrow(rest, "key long, best double, pid long")


def _shares(t: Arrays, s: Arrays, i: np.ndarray, j: np.ndarray, law: Law) -> np.ndarray:
    """Logarithm of what sources ``j`` add to targets ``i`` (places that broadcast), minus infinity for those that are not earlier."""
    square = 0.0
    for c in "xyz":
        step = t[c][i] - s[c][j]
        step *= step
        square = square + step
    d = np.sqrt(square, out=square)
    d /= 2
    np.arcsin(np.minimum(d, 1.0, out=d), out=d)
    d *= 2 * EARTH_RADIUS
    d *= d
    d += s["zone"][j]
    np.log(d, out=d)
    d *= law.power
    dt = t["days"][i] - s["days"][j]
    out = s["weight"][j] + law.decay(np.maximum(dt, 0.0))
    out -= d
    out[dt <= 0] = -math.inf
    return out


def _seeds(t: Arrays, s: Arrays, law: Law) -> np.ndarray:
    """Floors from the sources next to each target, in order of time and of place."""
    floor = np.full(len(t["key"]), -math.inf)
    n, every = len(s["key"]), np.arange(len(t["key"]))
    if not n:
        return floor
    for order, place in ((np.argsort(s["days"], kind="stable"), lambda x: x["days"]), (np.lexsort((s["days"], s["x"])), lambda x: x["x"])):
        at = np.searchsorted(place(s)[order], place(t), "left")
        for k in range(-SEEDS, 0 if place(t) is t["days"] else SEEDS):
            np.maximum(floor, _shares(t, s, every, order[np.clip(at + k, 0, n - 1)], law), out=floor)
    return floor


def _search(t: Arrays, s: Arrays, law: Law, floor: np.ndarray) -> None:
    """Raise ``best`` and ``pid`` of targets by sources; ``floor`` are shares that targets are known to reach."""
    stack = [(np.arange(len(t["key"])), np.argsort(s["days"], kind="stable"), True)]
    while stack:
        ti, si, in_time = stack.pop()
        if not len(ti) or not len(si):
            continue
        days = t["days"][ti]
        si = si[: np.searchsorted(s["days"][si], days.max(), "left")]
        bounds = {c: (t[c][ti].min(), t[c][ti].max()) for c in "xyz"}
        square = np.zeros(len(si))
        for c, (lo, hi) in bounds.items():
            v = s[c][si]
            square += np.maximum(np.maximum(lo - v, v - hi), 0.0) ** 2
        square *= EARTH_RADIUS**2 * (1 - 1e-9)
        most = s["weight"][si] + law.decay(np.maximum(days.min() - s["days"][si], 0.0)) - law.power * np.log(square + s["zone"][si]) + ROOM
        kept = most >= floor[ti].min()
        si, most = si[kept], most[kept]
        if not len(si):
            continue
        across = max(bounds, key=lambda c: bounds[c][1] - bounds[c][0])
        flat, still = bounds[across][0] == bounds[across][1], days.min() == days.max()
        if len(ti) <= LEAF or (flat and still):
            order = np.argsort(-most, kind="stable")
            _meet(t, s, ti, si[order[:FIRST]], law, floor)
            order = order[FIRST:]
            _meet(t, s, ti, si[order[most[order] >= floor[ti].min()]], law, floor)
            continue
        in_time = (in_time or flat) and not still
        order = np.argsort(days if in_time else t[across][ti], kind="stable")
        half = len(ti) // 2
        stack += [(ti[order[:half]], si, not in_time), (ti[order[half:]], si, not in_time)]


def _meet(t: Arrays, s: Arrays, ti: np.ndarray, si: np.ndarray, law: Law, floor: np.ndarray) -> None:
    step = max(1, STRIP // LEAF)
    for a in range(0, len(ti), LEAF):
        i = ti[a : a + LEAF]
        for b in range(0, len(si), step):
            j = si[b : b + step]
            share = _shares(t, s, i[:, None], j, law)
            best = share.max(axis=1)
            pid = np.where((share == best[:, None]) & (best > -math.inf)[:, None], s["key"][j], NONE).min(axis=1)
            old = t["best"][i]
            t["pid"][i] = np.where(best > old, pid, np.where(best == old, np.minimum(pid, t["pid"][i]), t["pid"][i]))
            t["best"][i] = np.maximum(best, old)
            floor[i] = np.maximum(floor[i], t["best"][i])
