"""Column functions: seasonal terms, winds, names, codes, rounding."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the study: night hours, heating season and threshold, stagnation limits, area codes, target value.
NIGHT_HOURS = (20, 21, 22, 23, 0, 1, 2, 3, 4, 5)
HEATING_BASE_C = 15.5
HEATING_MONTHS = (10, 11, 12, 1, 2, 3, 4)
STAGNATION_WIND, STAGNATION_RAIN = 2.0, 1.0
AREA_CODES = {"R": 0, "S": 1, "U": 2}
TARGET_VALUE = 1.0
WEIGHT_OFFSET = 0.5
POLLUTANT = "05029"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    return F.when(~F.isnan(col(c)), col(c))


def log1p(c: Column | str) -> Column:
    return F.log1p(col(c))


def expm1_clipped(c: Column | str) -> Column:
    """Back from ln(1 + y), never below 0."""
    return F.greatest(F.lit(0.0), F.expm1(col(c)))


def season_sin(day: Column | str) -> Column:
    return F.sin(2 * F.pi() * F.dayofyear(col(day)) / 365.25)


def season_cos(day: Column | str) -> Column:
    return F.cos(2 * F.pi() * F.dayofyear(col(day)) / 365.25)


def is_weekend(day: Column | str) -> Column:
    return (F.weekday(col(day)) >= 5).cast("int")


def is_heating_season(day: Column | str) -> Column:
    return F.month(col(day)).isin(*HEATING_MONTHS).cast("int")


def celsius(kelvin: Column | str) -> Column:
    return col(kelvin) - 273.15


def magnitude(u: Column | str, v: Column | str) -> Column:
    return F.sqrt(col(u) * col(u) + col(v) * col(v))


def slope_degrees(rise: Column) -> Column:
    return F.degrees(F.atan(rise))


def round_half_even(c: Column | str, digits: int = 0) -> Column:
    """Scaled, rounded with halves to even and scaled back, all in doubles."""
    scale = float(10**digits)
    return F.rint(col(c).cast("double") * scale) / scale


def numeric_or_zero(c: Column | str) -> Column:
    """Bad and missing numbers are 0."""
    return F.coalesce(col(c).try_cast("double"), F.lit(0.0))


def nodata_to_null(c: Column | str, nodata: float = -9999.0) -> Column:
    return F.when((col(c) != nodata) & ~F.isnan(col(c)), col(c))


def station_of_sampling_point(c: Column | str, pollutant: str = POLLUTANT, country: str = "SK") -> Column:
    """The station code inside a sampling point of one pollutant, null where there is none."""
    return F.nullif(F.regexp_extract(col(c), rf"SPO-({country}\w+?)_{pollutant}", 1), F.lit(""))


def registry_code(c: Column | str, pollutant: str = POLLUTANT, length: int = 7) -> Column:
    """The characters behind ``SPO-`` of sampling points of one pollutant, null for others: the key of the registry set."""
    return F.when(F.contains(col(c), F.lit(f"_{pollutant}_")) & F.contains(col(c), F.lit("SPO-")), F.substring(F.split_part(col(c), F.lit("SPO-"), F.lit(2)), 1, length))


def clean_name(c: Column | str) -> Column:
    """Comma parts with single spaces, without blank parts and the mobile mark; the first part loses one period at its end."""
    parts = F.transform(F.split(col(c), ","), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    kept = F.filter(parts, lambda p: (p != "") & ~F.lower(p).isin("mobil", "mobile"))
    first = F.transform(kept, lambda p, i: F.when((i == 0) & p.endswith("."), F.rtrim(F.regexp_replace(p, r"\.$", ""))).otherwise(p))
    return F.array_join(first, ", ")


def short_name(c: Column | str) -> Column:
    return F.trim(F.split(col(c), ",")[0])


def type_code(area: Column | str, source: Column | str) -> Column:
    return F.concat(F.trim(col(area)), F.trim(col(source)))


def area_code(area: Column | str) -> Column:
    """0 rural, 1 suburban, 2 urban; anything else is rural."""
    codes = F.create_map(*[F.lit(x) for pair in AREA_CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(codes, F.trim(col(area))), F.lit(0))


def sample_weight(y: Column | str, offset: float | None = WEIGHT_OFFSET) -> Column:
    return F.lit(1.0) if offset is None else 1.0 / (col(y) + offset)


def exceeds(mean: Column | str, target: float = TARGET_VALUE) -> Column:
    return col(mean) > target


def proxy_tag(has_pm: Column, has_no2: Column) -> Column:
    """'PM', 'NO2', 'PM+NO2' or 'none'."""
    tag = F.concat_ws("+", F.when(has_pm, F.lit("PM")), F.when(has_no2, F.lit("NO2")))
    return F.when(tag == "", "none").otherwise(tag)


# Fixed values of the grid: conformal conic projection with one parallel on a sphere, and its 2 km nodes.
PARALLEL, MERIDIAN, RADIUS = 48.80182499999999, 18.111565, 6371229.0
GRID_X0, GRID_Y0, GRID_STEP, GRID_NX, GRID_NY = -101000.0, -123000.0, 2000.0, 215, 110

_N = math.sin(math.radians(PARALLEL))
_F = math.cos(math.radians(PARALLEL)) * math.tan(math.pi / 4 + math.radians(PARALLEL) / 2) ** _N / _N
_RHO0 = RADIUS * _F / math.tan(math.pi / 4 + math.radians(PARALLEL) / 2) ** _N
CONE = (_N, _F, _RHO0)


def project(lon: Column | str, lat: Column | str) -> tuple[Column, Column]:
    """Metres east and north of the projection's origin."""
    rho = RADIUS * _F / F.pow(F.tan(math.pi / 4 + F.radians(col(lat)) / 2), F.lit(_N))
    angle = _N * F.radians(col(lon) - MERIDIAN)
    return rho * F.sin(angle), _RHO0 - rho * F.cos(angle)


def node(at: Column | str, origin: float, step: float) -> Column:
    """Nearest grid node, halves to even."""
    return F.rint((col(at) - origin) / step).cast("int")
