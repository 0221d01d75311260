"""Catalogs in and out: CSV, ``|``-separated text services, QuakeML, epoch-second catalogs, forecasts, fits.

A catalog has ``id`` LONG, ``time`` TIMESTAMP (UTC), ``days`` DOUBLE (since 1970), ``latitude``,
``longitude``, ``magnitude`` DOUBLE; further columns are kept. NaN becomes null at ingest.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import math
import re
import threading
import urllib.request
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.geo import box_of, convex_hull
from ..operators.ordered import with_previous, with_rank
from .config import plain
from .stage import materialized

SCHEMA = "id long, latitude double, longitude double, time string, magnitude double"


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def days_of(ts: Column) -> Column:
    """Days since 1970-01-01, of a timestamp of either kind."""
    return micros(ts) / F.lit(86400e6)


def parsed_time(text: Column) -> Column:
    """ISO 8601 or common date text as a UTC timestamp; null if it is none."""
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy/MM/dd HH:mm:ss")), F.try_to_timestamp(text, F.lit("dd/MM/yyyy HH:mm:ss")))


def epoch_seconds(value: Column, largest: Column) -> Column:
    """Epoch numbers as seconds: nanoseconds if the column's largest is beyond 1e14, milliseconds beyond 1e11."""
    return F.when(largest > 1e14, value / 1e9).when(largest > 1e11, value / 1e3).otherwise(value.cast("double"))


def as_catalog(df: DataFrame) -> DataFrame:
    """``df`` with typed, NaN-free catalog columns and ``days``."""
    clean = lambda c: F.when(~F.isnan(F.col(c)), F.col(c))
    time = parsed_time(F.col("time")) if dict(df.dtypes)["time"] == "string" else F.col("time").cast("timestamp")
    df = df.withColumns({c: clean(c) for c in ("latitude", "longitude", "magnitude")} | {"time": time})
    return df.withColumn("days", days_of(F.col("time")))


def read_csv(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """A catalog CSV with a header whose first column is the id."""
    return as_catalog(spark.read.schema(schema).option("header", True).csv(path))


def found(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of any store that Spark reaches."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def from_events(events: DataFrame) -> DataFrame:
    """The driver's ``events`` as a catalog: exponential values as magnitudes, users and props as places."""
    k = F.get_json_object("props", "$.k").cast("double")
    m = F.lit(2.5) + F.col("value") / (F.lit(50.0) * F.log(F.lit(10.0)))
    return events.select(
        F.col("event_id").alias("id"),
        days_of(F.col("ts")).alias("days"),
        (F.floor(m * 10 + 0.5) / F.lit(10.0)).alias("magnitude"),
        (F.lit(32.5) + (F.col("user_id") % 61) * 0.13 + k * 0.001).alias("latitude"),
        (F.lit(-123.0) + (F.col("user_id") % 53) * 0.17 + k * 0.001).alias("longitude"),
        "event_type",
        "user_id",
    )


def to_epoch_catalog(catalog: DataFrame, depth: float = 10.0) -> DataFrame:
    """(time in epoch seconds, latitude, longitude, magnitude, depth), without duplicates."""
    known = F.coalesce(F.col("depth"), F.lit(depth)) if "depth" in catalog.columns else F.lit(depth)
    return catalog.select(F.floor(F.col("days") * 86400).cast("long").alias("time"), "latitude", "longitude", "magnitude", known.alias("depth")).dropDuplicates()


def from_epoch_catalog(df: DataFrame, start_id: int = 0) -> DataFrame:
    """The way back: ids by (time, place), times as text, ``Invalid Time`` where there is none."""
    missing = {"time", "latitude", "longitude", "magnitude"} - set(df.columns)
    if missing:
        raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
    text = F.coalesce(F.date_format(F.timestamp_seconds("time"), "yyyy-MM-dd HH:mm:ss"), F.lit("Invalid Time"))
    ranked = with_rank(df.select("time", "latitude", "longitude", "magnitude"), "place", order=("time", "latitude", "longitude", "magnitude"))
    return ranked.select((F.col("place") - 1 + start_id).cast("long").alias("id"), "latitude", "longitude", text.alias("time"), "magnitude")


def problems(df: DataFrame, required: tuple[str, ...] = ("time", "latitude", "longitude", "magnitude", "depth")) -> list[str]:
    """Everything that keeps ``df`` from being an epoch catalog: missing columns, null or unsorted times by ``id``."""
    reasons = [f"column {c} is missing" for c in required if c not in df.columns]
    if "time" in df.columns:
        if nulls := df.filter("time IS NULL").count():
            reasons.append(f"{nulls} times are null")
        if "id" in df.columns and (back := with_previous(df.select("id", "time"), {"before": F.col("time")}, order=("id",)).filter("before > time").count()):
            reasons.append(f"{back} times are before the row above")
    return reasons


def checked(df: DataFrame, **how) -> DataFrame:
    """``df``, or an error with all of its ``problems``."""
    if reasons := problems(df, **how):
        raise ValueError("; ".join(reasons))
    return df


def differences(a: DataFrame, b: DataFrame, key: str | None = None, tolerance: float = 1e-10) -> DataFrame:
    """(place, a, b): rows that differ, as structs, of two catalogs with the same columns.

    Rows are matched by ``key``, of which equal ones are numbered and null equals null, or
    without one by their places in the order of all columns. Numbers may differ by
    ``tolerance``; null and NaN equal themselves.
    """
    kinds = dict(a.dtypes)
    names = list(a.columns)
    order = [key, *[c for c in names if c != key]] if key else names
    ranked = [with_rank(df.select(*names), "place", order=tuple(order)) for df in (a, b)]
    if key:
        w = W.partitionBy(key).orderBy("place")
        ranked = [r.withColumn("place", F.concat_ws("#", F.coalesce(F.col(key).cast("string"), F.lit("null")), F.row_number().over(w))) for r in ranked]
    left, right = (r.select("place", F.struct(*names).alias(n)) for r, n in zip(ranked, "ab"))
    both = left.join(right, "place", "full_outer")
    differ = F.col("a").isNull() | F.col("b").isNull()
    for c in names:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        near = F.coalesce(F.abs(x - y) <= tolerance, F.lit(False)) if kinds[c] in ("double", "float") else F.lit(False)
        differ = differ | ~(x.eqNullSafe(y) | near)
    return both.filter(differ)


def equivalent(a: DataFrame, b: DataFrame, key: str | None = None, tolerance: float = 1e-10) -> bool:
    """Whether two catalogs have the same columns and no ``differences``."""
    return sorted(a.dtypes) == sorted(b.dtypes) and differences(a, b, key, tolerance).isEmpty()


def find_or_create(catalog: DataFrame, folder: str, name: str, key: str = "id") -> str:
    """Path of a stored catalog with the same content: ``name``, ``name_1``, ...; written if there is none."""
    spark, k = catalog.sparkSession, 0
    while True:
        place = f"{folder}/{name}" + (f"_{k}" if k else "")
        if not found(spark, place):
            catalog.write.parquet(place)
            return place
        if equivalent(spark.read.parquet(place), catalog, key):
            return place
        k += 1


def write_predictions(events: DataFrame, vector: str, path: str) -> None:
    """Predictions of a magnitude model beside its events: event_index, time, place, magnitude, model_prediction."""
    seconds = F.floor(F.col("days") * 86400).cast("long")
    events.select(F.col("id").alias("event_index"), seconds.alias("time"), "longitude", "latitude", "magnitude", F.col(vector).cast("array<double>").alias("model_prediction")).write.mode("append").parquet(path)


def column_report(a: DataFrame, b: DataFrame) -> dict[str, list[str]]:
    """Columns of both, of the first alone, of the second alone."""
    x, y = set(a.columns), set(b.columns)
    return {"both": sorted(x & y), "first": sorted(x - y), "second": sorted(y - x)}


def fingerprint(config: dict) -> str:
    """16 hex digits of the whole configuration, for cached results."""
    return hashlib.sha1(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def write_fit(folder: str, spark: SparkSession, result: dict, **tables: DataFrame) -> None:
    """A fit: its parameters as JSON text, its tables (targets, sources, pairs) as Parquet."""
    spark.createDataFrame([(json.dumps(result, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/parameters")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_fit(folder: str, spark: SparkSession, *tables: str) -> tuple[dict, dict[str, DataFrame]]:
    """Parameters and those of ``tables`` that were written."""
    result = json.loads(spark.read.text(f"{folder}/parameters").head()[0])
    return result, {name: spark.read.parquet(f"{folder}/{name}") for name in tables if found(spark, f"{folder}/{name}")}


def append_forecast(catalogs: DataFrame, folder: str, buckets: int = 64) -> DataFrame:
    """Append realisations that ``folder`` does not have yet (by ``catalog_id``), and return what was new.

    Each append is a part of its own. Its manifest (part, catalog_id, rows) comes last, from the
    rows as they were written, so a part without one was never finished: its realisations are not there,
    and the next append makes them again.
    """
    spark = catalogs.sparkSession
    rows = catalogs.withColumn("bucket", F.pmod(F.col("catalog_id"), F.lit(buckets)))
    if (done := forecast_manifest(spark, folder)) is not None:
        rows = rows.join(done.select("catalog_id"), "catalog_id", "left_anti")
    name = f"part={uuid.uuid4().hex}"
    rows.write.partitionBy("bucket").parquet(f"{folder}/{name}")
    stored = spark.read.schema(rows.schema).parquet(f"{folder}/{name}").select(*catalogs.columns)
    counts = stored.groupBy("catalog_id").agg(F.count(F.lit(1)).alias("rows"))
    counts.select(F.lit(name).alias("name"), "catalog_id", "rows").write.mode("append").parquet(f"{folder}/_manifest")
    return stored


def forecast_manifest(spark: SparkSession, folder: str) -> DataFrame | None:
    """(name of the part, catalog_id, rows) of the whole realisations of a stored forecast; None where there is none."""
    return spark.read.parquet(f"{folder}/_manifest") if found(spark, f"{folder}/_manifest") else None


def read_forecast(spark: SparkSession, folder: str) -> DataFrame:
    """The whole realisations of a stored forecast; rows of parts that were never finished are left out.

    A realisation with fewer or more rows than its manifest tells is an error.
    """
    manifest = forecast_manifest(spark, folder)
    if manifest is None:
        raise ValueError(f"no realisation was finished in {folder}")
    names = [r.name for r in manifest.select("name").distinct().collect()]  # a row an append
    rows = spark.read.option("basePath", folder).parquet(*[f"{folder}/{n}" for n in names])
    kept = rows.drop("part", "bucket")
    counts = kept.groupBy("catalog_id").agg(F.count(F.lit(1)).alias("n")).join(manifest, "catalog_id", "full").filter(~F.col("n").eqNullSafe(F.col("rows")))
    if (wrong := counts.count()) > 0:
        raise ValueError(f"{wrong} realisations differ from the manifest")
    return kept


def log_parameters(site: str, parameters: dict | None, path: str | None, **extras) -> None:
    """Append a line of JSON about a call to a trace file on the driver; without a path, nothing."""
    if path:
        line = json.dumps(plain({"site": site, "parameters": parameters, **extras}), default=str)
        with _TRACES, open(path, "a", encoding="utf-8") as f:
            f.write(line + "\n")


def log_events(site: str, events: DataFrame, folder: str | None) -> None:
    """Append events (time or days, place, magnitude; null where missing) with ``site`` to a trace table; without a folder or rows, nothing."""
    time = next((c for c in ("time", "days") if c in events.columns), None)
    if folder and time and not events.isEmpty():
        own = [F.col(c).cast("double").alias(c) if c in events.columns else F.lit(None).cast("double").alias(c) for c in ("latitude", "longitude", "magnitude")]
        events.select(F.lit(site).alias("site"), F.col(time).cast("string").alias("time"), *own).write.mode("append").parquet(folder)


_TRACES = threading.Lock()


def read_ring(source: str | list) -> list[tuple[float, float]]:
    """A ring from a list of [lat, lon], from JSON text of one, or from an ``.npy`` file; text is parsed, never evaluated, and arrays hold no objects."""
    if isinstance(source, str) and source.rstrip().endswith(".npy"):
        source = np.load(source, allow_pickle=False).tolist()
    points = json.loads(source) if isinstance(source, str) else source
    return [(float(a), float(b)) for a, b in points]


def partial_hulls(df: DataFrame) -> DataFrame:
    """(lat, lon): the hull's vertices of each partition's places, which are all that the whole hull needs."""

    def run(batches):
        kept: list[tuple[float, float]] = []
        for b in batches:
            places = zip(b.column("latitude").to_pylist(), b.column("longitude").to_pylist())
            kept = convex_hull([*kept, *[p for p in places if None not in p]])
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in kept], pa.float64()) for i in (0, 1)], ["lat", "lon"])

    return df.select(F.col("latitude").cast("double"), F.col("longitude").cast("double")).mapInArrow(run, "lat double, lon double")


def ring_of(df: DataFrame) -> list[tuple[float, float]]:
    """The convex hull of a catalog's places; their box where they lie on a line."""
    points = [tuple(r) for r in partial_hulls(df).collect()]  # a hull a partition
    hull = convex_hull(points)
    if len(hull) < 3 and points:
        a, b, c, d = box_of(points)
        return [(a, c), (a, d), (b, d), (b, c)]
    return hull


class TextServiceSource(DataSource):
    """``spark.read.format("fdsn_text")``: event text of a web service, a partition for each year.

    Options: ``url`` with ``{start}``, ``{end}`` and ``{minmag}`` in it, ``start`` and ``end``
    (dates or years; the end is left out, but a year counts to its end), ``minmagnitude`` and
    ``delta_m``: the service is asked for half a bin less; without a least magnitude, ``{minmag}`` is -10.
    With ``count_url`` (the same names in it; its text is a number), a span of more than ``most`` events (20,000) is
    halved until it has no more, so that full years are many tasks. With ``pushdown`` set to true, and Spark's
    ``spark.sql.python.filterPushdown.enabled``, filters on ``magnitude`` (from below) and ``time`` (text like the
    service's) narrow what is asked for; Spark applies them again to the rows.
    """

    @classmethod
    def name(cls) -> str:
        return "fdsn_text"

    def schema(self) -> str:
        return "event_id string, time string, latitude double, longitude double, depth double, magnitude double"

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        return _PushingReader(options) if options.get("pushdown", "").lower() == "true" else _TextServiceReader(options)


class _TextServiceReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.least = float(options["minmagnitude"]) - float(options.get("delta_m", 0.1)) / 2 if "minmagnitude" in options else -10.0
        self.first, self.last = "", "~"  # of times, by filters

    def partitions(self) -> list[InputPartition]:
        start, end = self.options["start"], self.options["end"]
        start = f"{start}-01-01" if len(start) == 4 else start
        end = f"{int(end) + 1}-01-01" if len(end) == 4 else end
        cuts = [start, *[f"{y}-01-01" for y in range(int(start[:4]) + 1, int(end[:4]) + 1) if f"{y}-01-01" < end], end]
        spans = [(max(a, self.first), min(b, self.last)) for a, b in zip(cuts, cuts[1:])]
        return [InputPartition(part) for span in spans if span[0] < span[1] for part in self._parts(*span)]

    def _parts(self, start: str, end: str) -> list[tuple[str, str]]:
        """The span, or its halves as often as it takes until none has more events than are asked for at a time."""
        if "count_url" not in self.options or int(self._asked("count_url", start, end) or 0) <= int(self.options.get("most", 20_000)):
            return [(start, end)]
        a, b = (dt.datetime.fromisoformat(x) for x in (start, end))
        middle = (a + (b - a) / 2).replace(microsecond=0)
        if not a < middle < b:  # a second is not divided
            return [(start, end)]
        return self._parts(start, middle.isoformat()) + self._parts(middle.isoformat(), end)

    def _asked(self, url: str, start: str, end: str) -> str:
        with urllib.request.urlopen(self.options[url].format(start=start, end=end, minmag=self.least), timeout=60) as page:
            return "" if getattr(page, "status", None) == 204 else page.read().decode()  # 204: no content

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from parse_event_text(self._asked("url", *partition.value))


class _PushingReader(_TextServiceReader):
    """A reader that asks for no more than filters on magnitude and time let through; all filters are left to Spark as well."""

    def pushFilters(self, filters):  # noqa: N802  Spark's name
        for f in filters:
            kind, value = type(f).__name__, getattr(f, "value", None)
            if getattr(f, "attribute", None) == ("magnitude",) and kind in ("GreaterThan", "GreaterThanOrEqual", "EqualTo"):
                self.least = max(self.least, float(value))
            elif getattr(f, "attribute", None) == ("time",) and _is_time(value):
                if kind in ("GreaterThan", "GreaterThanOrEqual"):
                    self.first = max(self.first, value)
                elif kind == "LessThan":
                    self.last = min(self.last, value)
            yield f


def _is_time(text: object) -> bool:
    """Whether text can stand for a service's start or end: then the order of texts is that of times."""
    try:
        return isinstance(text, str) and bool(dt.datetime.fromisoformat(text)) and re.match(r"\d{4}-\d{2}-\d{2}", text) is not None
    except ValueError:
        return False


def read_service(spark: SparkSession, **options: str) -> DataFrame:
    """A web service's events in order of time, as a catalog with ``event_id`` and ``depth``."""
    spark.dataSource.register(TextServiceSource)
    rows = spark.read.format("fdsn_text").options(**options).load()
    return as_catalog(rows).orderBy("time", "event_id")


def parse_event_text(text: str) -> Iterator[tuple]:
    """Rows of event text with a ``#`` header: EventID|Time|Latitude|Longitude|Depth/km|...|Magnitude|..."""
    names: list[str] = []
    for line in text.splitlines():
        cells = [c.strip() for c in line.lstrip("#").split("|")]
        if line.startswith("#"):
            names = [c.lower().split("/")[0] for c in cells]
        elif line.strip():
            row = dict(zip(names, cells))
            number = lambda c, row=row: float(row[c]) if row.get(c) else None
            yield row.get("eventid"), row.get("time"), number("latitude"), number("longitude"), number("depth"), number("magnitude")


def parse_quakeml(text: str) -> Iterator[tuple]:
    """(event_id, time, latitude, longitude, depth_km, magnitude) of each event of a QuakeML document."""
    local = lambda e: e.tag.rpartition("}")[2]

    def value(node, *path):
        for name in path:
            node = next((c for c in (node if node is not None else ()) if local(c) == name), None)
        return None if node is None else (node.text or "").strip() or None

    root = ET.fromstring(text)
    for event in (e for e in root.iter() if local(e) == "event"):
        origin = next((c for c in event if local(c) == "origin"), None)
        size = next((c for c in event if local(c) == "magnitude"), None)
        number = lambda v: None if v is None else float(v)
        depth = number(value(origin, "depth", "value"))
        yield event.get("publicID"), value(origin, "time", "value"), number(value(origin, "latitude", "value")), number(value(origin, "longitude", "value")), None if depth is None else depth / 1000, number(value(size, "mag", "value"))


def quakeml(rows: list[tuple]) -> str:
    """A QuakeML document of (id, time, latitude, longitude, magnitude, perhaps depth in km) rows; what is null is left out."""

    def event(name, time, lat, lon, size, depth=None) -> str:
        value = lambda tag, v: "" if v is None else f"<{tag}><value>{escape(str(v))}</value></{tag}>"
        origin = value("time", time) + value("latitude", lat) + value("longitude", lon) + value("depth", None if depth is None else depth * 1000)
        return f"<event publicID={quoteattr(str(name))}><origin>{origin}</origin><magnitude>{value('mag', size)}</magnitude></event>"

    events = "".join(event(*r) for r in rows)
    return f'<?xml version="1.0"?><q:quakeml xmlns:q="http://quakeml.org/xmlns/quakeml/1.2" xmlns="http://quakeml.org/xmlns/bed/1.2"><eventParameters>{events}</eventParameters></q:quakeml>'


def read_quakeml(spark: SparkSession, path: str) -> DataFrame:
    """Events of QuakeML files (a file, folder or pattern) as a catalog with ``event_id`` and ``depth`` in km; a task reads whole files."""
    files = spark.read.format("binaryFile").load(path).select("content")
    schema = "event_id string, time string, latitude double, longitude double, depth double, magnitude double"

    def run(batches):
        for b in batches:
            for content in b.column("content"):
                rows = list(parse_quakeml(content.as_py().decode()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), *[pa.float64()] * 4))], [f.split()[0] for f in schema.split(", ")])

    return as_catalog(files.mapInArrow(run, schema))


#: Events of a document that ``write_quakeml`` makes.
DOCUMENT_ROWS = 20_000


def write_quakeml(catalog: DataFrame, folder: str) -> None:
    """A catalog (id or event_id, days, latitude, longitude, magnitude, perhaps depth) as QuakeML: files of a document of at most about ``DOCUMENT_ROWS`` events.

    The events are dealt evenly over as many tasks, each of which writes one file.
    """
    known = F.col("event_id") if "event_id" in catalog.columns else F.col("id").cast("string")
    depth = F.col("depth").cast("double") if "depth" in catalog.columns else F.lit(None).cast("double")
    time = F.date_format(F.timestamp_micros(F.floor(F.col("days") * 86400e6 + 0.5).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    rows = catalog.select(known.alias("event_id"), time.alias("time"), F.col("latitude").cast("double"), F.col("longitude").cast("double"), F.col("magnitude").cast("double"), depth.alias("depth"))
    rows = rows.repartition(max(1, math.ceil(catalog.count() / DOCUMENT_ROWS)))

    def run(batches):
        events = [tuple(r.values()) for b in batches for r in b.to_pylist()]
        if events:
            yield pa.RecordBatch.from_arrays([pa.array([quakeml(events)])], ["value"])

    rows.mapInArrow(run, "value string").write.mode("overwrite").text(folder)
