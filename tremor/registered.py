"""What registered queries share: the catalog, windows, parameters, SQL pieces, and the registry itself.

``events`` stands for a catalog (see ``sources.catalog.from_events``). Numbers are rounded
half up at six decimals on both sides, as sums differ in their last bits.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo
from .functions import kernels as K
from .sources import catalog as cat

#: Days since 1970 of the windows: auxiliary start, start, end, end of the test window.
AUX, START, END, TEST_END = 19723.0, 19730.0, 19746.0, 19753.0
#: A polygon around California, [lat, lon].
CALIFORNIA = [(43.0, -125.2), (43.0, -119.0), (39.4, -119.0), (35.7, -114.0), (34.3, -113.1), (32.9, -113.5), (32.2, -113.6), (31.7, -114.5), (31.5, -117.1), (31.9, -117.9), (32.8, -118.4), (33.7, -121.0), (34.2, -121.6), (37.7, -123.8), (40.2, -125.4), (40.5, -125.4)]
THETA = K.Theta()
FREE_TAU = K.Theta(log10_tau=math.inf, omega=0.1)
BETA, M_REF, DM, AREA = 2.0, 2.5, 0.1, 500000.0
M_LOW = M_REF - DM / 2
PAIR_MC = 3.0

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

CAT_SQL = """WITH cat AS (
  SELECT event_id AS id, epoch_us(ts) / 86400e6 AS days, floor((2.5e0 + value / (50e0 * ln(10e0))) * 10e0 + 0.5e0) / 10e0 AS magnitude,
    32.5e0 + (user_id % 61) * 0.13e0 + k * 0.001e0 AS latitude, -123e0 + (user_id % 53) * 0.17e0 + k * 0.001e0 AS longitude, event_type, user_id
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
)"""


def r6(x: Column) -> Column:
    return F.floor(x * F.lit(1e6) + 0.5) / F.lit(1e6)


def r6s(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5e0) / 1e6"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def query(sql: str | None = None):
    """Register a query; ``sql`` follows the catalog's common table expression unless it starts with WITH."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql if sql.lstrip().startswith("WITH") else CAT_SQL + sql
        return f

    return add


def no_double_exponent(sql: str) -> str:
    """Python's ``1e-06`` written with the suffix ``e0`` of the SQL here, put right."""
    return re.sub(r"(\de-?\d+)e0", r"\1", sql)


def pip_sql(ring: list, y: str = "latitude", x: str = "longitude") -> str:
    """Whether a place is in a ring, by crossings."""
    terms = [f"CASE WHEN ({y1!r}e0 > {y}) != ({y2!r}e0 > {y}) AND {x} < {x1!r}e0 + ({y} - {y1!r}e0) * {(x2 - x1) / (y2 - y1)!r}e0 THEN 1 ELSE 0 END" for (y1, x1), (y2, x2) in zip(ring, [*ring[1:], ring[0]]) if y1 != y2]
    return f"(({' + '.join(terms)}) % 2 = 1)"


def u_sql(*key: str) -> str:
    """The uniform number of a key, whose parts are SQL."""
    return f"CAST(('0x' || substr(md5(concat_ws('|', {', '.join(key)})), 1, 13)) AS BIGINT) / 4503599627370496e0"


def id_sql(*key: str) -> str:
    """The id of a key."""
    return f"CAST(('0x' || substr(md5(concat_ws('|', {', '.join(key)})), 1, 15)) AS BIGINT)"


def km_lon_sql(lat: str) -> str:
    """km of a degree of longitude."""
    return f"{2 * geo.EARTH_RADIUS!r}e0 * asin(abs(cos(radians({lat}))) * {math.sin(math.radians(0.5))!r}e0)"


def upper_gamma_sql(a: float, x: str) -> str:
    """The upper incomplete gamma function of ``x``, a column: its series below 1.5, a continued fraction of 60 terms above."""
    n = lambda v: f"({v!r}e0)"
    if a < -0.5:
        return no_double_exponent(f"(({upper_gamma_sql(a + 1, x)} - pow({x}, {n(a)}) * exp(-{x})) / {n(a)})")
    series, fraction = "0e0", "0e0"
    for k in range(30, 0, -1):
        series = f"({series} + {n((-1.0) ** k / (math.factorial(k) * (a + k)))}) * {x}"
    for k in range(60, 0, -1):
        fraction = f"{n(k * (k - a))} / ({x} + {n(2 * k + 1 - a)} - {fraction})"
    power = f"pow({x}, {n(a)})"
    return no_double_exponent(f"CASE WHEN {x} < 1.5e0 THEN ({n(math.gamma(a + 1))} - {power}) / {n(a)} - {power} * ({series}) ELSE {power} * exp(-{x}) / ({x} + {n(1 - a)} - {fraction}) END")


KM_LAT_SQL = f"{2 * math.pi * geo.EARTH_RADIUS / 360!r}e0"


def hav_sql(a: str, b: str) -> str:
    """Distance in km of rows ``a`` and ``b``."""
    h = f"pow(sin(radians({a}.latitude - {b}.latitude) / 2e0), 2e0) + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * pow(sin(radians({a}.longitude - {b}.longitude) / 2e0), 2e0)"
    return f"{2 * geo.EARTH_RADIUS!r}e0 * asin(sqrt(least(1e0, {h})))"


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
