"""Scalar functions SC-01..23 as native ``Column`` expressions (no Python UDFs).

Every function takes and returns ``Column`` objects, so it stays inside
whole-stage code generation.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ColOrName = Column | str

# --- fixed values -----------------------------------------------------------
URN_COUNTRY = "PT"
WEEKDAY_COLUMNS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
WEEKDAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
ROUTE_TYPE_TO_VEHICLE_MODE = {
    0: "tram", 1: "metro", 2: "rail", 3: "bus", 4: "water", 5: "cableway",
    6: "cableway", 7: "funicular", 11: "trolleyBus", 12: "metro",
}
LOCATION_TYPE_TO_ELEMENT = {0: "Quay", 1: "StopPlace", 2: "StopPlaceEntrance", 3: "PathJunction", 4: "BoardingPosition"}
WHEELCHAIR_TO_LIMITATION = {0: "unknown", 1: "true", 2: "false"}
NULL_TOKENS = ("n/a", "nan", "", "null")
NAME_SEPARATOR = r" / |[/ -]"
NAME_DROPPED = r"[().]"
DAY_MONTH_YEAR = r"^(\d{2})/(\d{2})/(\d{4})$"
YEAR_MONTH_DAY = r"(?s)^(\d{4})-(\d{2})-(\d{2}).*$"
EIGHT_DIGITS = r"^\d{8}$"
DEFAULT_DURATION_SECS = 30


def _c(c: ColOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: ColOrName) -> Column:
    """Python ``str.strip()``: leading/trailing whitespace of any kind."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


# SC-01 ----------------------------------------------------------------------
def normalize_column_name(c: ColOrName) -> Column:
    """Trimmed lower-case name, blanks, slashes and hyphens as underscores, brackets and dots gone."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), NAME_SEPARATOR, "_"), NAME_DROPPED, "")


def normalize_header(name: str) -> str:
    """SC-01 on a header name (plan-time, driver side; names only, never data)."""
    return re.sub(NAME_DROPPED, "", re.sub(NAME_SEPARATOR, "_", name.strip().lower()))


# SC-02 ----------------------------------------------------------------------
def safe_name(c: ColOrName) -> Column:
    x = F.regexp_replace(F.lower(strip(c)), r"[^a-z0-9]+", "_")
    return F.regexp_replace(x, r"^_+|_+$", "")


def safe_name_text(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", text.strip().lower()).strip("_")


# SC-03 ----------------------------------------------------------------------
def sanitise_local_id(c: ColOrName) -> Column:
    """NULL for an empty id (the caller turns that into an issue row)."""
    x = _c(c).cast("string")
    return F.when(x.isNull() | (x == ""), F.lit(None)).otherwise(F.regexp_replace(x, r"[^A-Za-z0-9_\-]", "_"))


def build_urn(codespace: ColOrName, object_type: str, local_id: ColOrName) -> Column:
    cs = F.lit(codespace) if isinstance(codespace, str) and not codespace.startswith("col:") else _c(codespace)
    return F.concat_ws(":", F.lit(URN_COUNTRY), cs, F.lit(object_type), sanitise_local_id(local_id))


# SC-04 ----------------------------------------------------------------------
def safe_id(c: ColOrName) -> Column:
    x = F.regexp_replace(strip(c), r"[^a-zA-Z0-9]+", "_")
    return F.upper(F.regexp_replace(x, r"^_+|_+$", ""))


# SC-05 / SC-06 --------------------------------------------------------------
def trip_id(line: ColOrName, direction: ColOrName, index: ColOrName) -> Column:
    return F.format_string("%s_%d_%04d", _c(line), _c(direction).cast("int"), _c(index).cast("int"))


def service_id(c: ColOrName) -> Column:
    return F.upper(F.replace(strip(c), F.lit(" "), F.lit("_")))


# SC-07 family ---------------------------------------------------------------
def to_yyyymmdd(c: ColOrName) -> Column:
    """A date text (``dd/MM/yyyy``, ISO date or instant, or eight digits) as eight digits; NULL for any other."""
    digits = F.regexp_replace(F.regexp_replace(strip(c), DAY_MONTH_YEAR, "$3$2$1"), YEAR_MONTH_DAY, "$1$2$3")
    return F.when(digits.rlike(EIGHT_DIGITS), digits)


def is_valid_yyyymmdd(c: ColOrName) -> Column:
    """8 digits that name a real calendar day of years 1..9999."""
    x = _c(c)
    return (
        x.isNotNull()
        & x.rlike(EIGHT_DIGITS)
        & (F.substring(x, 1, 4) != "0000")
        & F.try_to_date(x, "yyyyMMdd").isNotNull()
    )


def yyyymmdd_to_date(c: ColOrName) -> Column:
    return F.try_to_date(_c(c), "yyyyMMdd")


def yyyymmdd_to_iso(c: ColOrName) -> Column:
    return F.date_format(yyyymmdd_to_date(c), "yyyy-MM-dd")


def date_to_yyyymmdd(c: ColOrName) -> Column:
    return F.date_format(_c(c), "yyyyMMdd")


# SC-08..11 ------------------------------------------------------------------
def time_to_seconds(c: ColOrName) -> Column:
    """``H:MM:SS`` / ``H:MM`` / ``H`` to seconds; hours may exceed 24."""
    parts = F.split(strip(c), ":")
    h = F.coalesce(F.try_element_at(parts, F.lit(1)).try_cast("int"), F.lit(0))
    m = F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("int"), F.lit(0))
    s = F.coalesce(F.try_element_at(parts, F.lit(3)).try_cast("int"), F.lit(0))
    ok = F.try_element_at(parts, F.lit(1)).try_cast("int").isNotNull()
    return F.when(_c(c).isNotNull() & ok, h * 3600 + m * 60 + s)


def seconds_to_time(c: ColOrName) -> Column:
    x = _c(c).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(x / 3600), F.floor((x % 3600) / 60), x % 60)


def parse_duration_secs(c: ColOrName, default: int = DEFAULT_DURATION_SECS) -> Column:
    """Seconds of ``h:m:s``, ``m:s`` or a number of seconds; anything else is ``default``."""
    text = strip(_c(c).cast("string"))
    units = F.transform(F.split(text, ":"), lambda x: x.try_cast("int").cast("long"))
    clock = F.aggregate(units, F.lit(0).cast("long"), lambda total, x: total * 60 + x)
    seconds = F.when(F.size(units).isin(2, 3), clock).otherwise(text.try_cast("double").cast("long"))
    return F.coalesce(seconds, F.lit(default).cast("long"))


def gtfs_time_parts(c: ColOrName, parts: Column | None = None) -> Column:
    """SC-11: struct(time 'HH:MM:SS' with hours mod 24, day_offset); ``parts``
    are the text's pieces, if the caller has them."""
    x = _c(c)
    parts = F.split(x, ":") if parts is None else parts
    h = F.try_element_at(parts, F.lit(1)).try_cast("int")
    empty = x.isNull() | (x == "")
    t = F.format_string("%02d:%s:%s", h % 24, F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(3)))
    return F.struct(
        F.when(empty, F.lit(None)).otherwise(t).alias("time"),
        F.when(empty, F.lit(0)).otherwise(F.floor(h / 24).cast("int")).alias("day_offset"),
    )


# SC-13 / SC-14 / SC-15 ------------------------------------------------------
def weekday0(ts: ColOrName) -> Column:
    """Monday = 0 … Sunday = 6."""
    return F.weekday(_c(ts))


def season(month: ColOrName) -> Column:
    m = _c(month)
    return (
        F.when(m.isin(3, 4, 5), F.lit("spring"))
        .when(m.isin(6, 7, 8), F.lit("summer"))
        .when(m.isin(9, 10, 11), F.lit("autumn"))
        .otherwise(F.lit("winter"))
    )


def day_type(dow: ColOrName, is_holiday: ColOrName) -> Column:
    d, h = _c(dow), _c(is_holiday)
    return (
        F.when(h | (d == 6), F.lit("sunday_holiday"))
        .when(d == 5, F.lit("saturday"))
        .otherwise(F.lit("weekday"))
    )


def hour_of_day(ts: ColOrName) -> Column:
    """Hour, except NULL at exactly hh=0 and mm=0 (seconds ignored)."""
    t = _c(ts)
    return F.when((F.hour(t) == 0) & (F.minute(t) == 0), F.lit(None).cast("int")).otherwise(F.hour(t))


def temporal_features(ts: ColOrName, is_holiday: ColOrName, day_of_month: bool = True) -> list[Column]:
    t = _c(ts)
    dow = weekday0(t)
    return [
        hour_of_day(t).alias("hour_of_day"),
        dow.alias("day_of_week"),
        *([F.dayofmonth(t).alias("day_of_month")] if day_of_month else []),
        F.month(t).alias("month"),
        F.year(t).alias("year"),
        (dow >= 5).alias("is_weekend"),
        _c(is_holiday).alias("is_holiday"),
        day_type(dow, is_holiday).alias("day_type"),
        season(F.month(t)).alias("season"),
    ]


def safe_int(c: ColOrName) -> Column:
    """Truncating integer (NaN and NULL become NULL)."""
    x = _c(c)
    return F.when(F.isnan(x.cast("double")), F.lit(None)).otherwise(x.cast("double").cast("long"))


# SC-16 / SC-17 --------------------------------------------------------------
def days_of_week(*bits: ColOrName) -> Column:
    cols = bits or WEEKDAY_COLUMNS
    return F.array_compact(
        F.array(*[F.when(_c(b).cast("int") == 1, F.lit(n)) for b, n in zip(cols, WEEKDAY_NAMES)])
    )


def _map_literal(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def vehicle_mode(route_type: ColOrName) -> Column:
    """NULL for an unmapped route_type (the caller reports it)."""
    return F.try_element_at(_map_literal(ROUTE_TYPE_TO_VEHICLE_MODE), _c(route_type).cast("int"))


def stop_place_element(location_type: ColOrName) -> Column:
    return F.try_element_at(_map_literal(LOCATION_TYPE_TO_ELEMENT), F.coalesce(_c(location_type).cast("int"), F.lit(0)))


def wheelchair_limitation(flag: ColOrName) -> Column:
    return F.try_element_at(_map_literal(WHEELCHAIR_TO_LIMITATION), _c(flag).cast("int"))


# SC-18 / SC-19 / SC-20 / SC-21 / SC-22 ---------------------------------------
def format_cell(c: ColOrName, is_float: bool) -> Column:
    """NULL (and NaN or infinite) → '' ; whole floats print as integers, others
    as plain decimals (never with an exponent)."""
    x = _c(c)
    if is_float:
        plain = F.regexp_replace(x.cast("string").try_cast("decimal(38,20)").cast("string"), r"\.?0+$", "")
        whole = F.when(F.abs(x) < 1e18, x.cast("long").cast("string")).otherwise(x.try_cast("decimal(38,0)").cast("string"))
        txt = F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit("")).when(x == F.rint(x), whole).otherwise(plain)
    else:
        txt = x.cast("string")
    return F.coalesce(txt, F.lit(""))


def stringify(c: ColOrName, width: int = 40) -> Column:
    """SC-19: a cell for display; longer ones are shortened to ``width``. The
    full value stays in the data: this is for screens only."""
    s = _c(c).cast("string")
    return F.when(s.isNull(), F.lit("")).when(
        F.char_length(s) > width, F.concat(F.substring(s, 1, width - 3), F.lit("…"))
    ).otherwise(s)


def centroid(lat: ColOrName, lon: ColOrName) -> Column:
    la, lo = _c(lat), _c(lon)
    return F.when(la.isNotNull() & lo.isNotNull(), F.struct(lo.alias("longitude"), la.alias("latitude")))


def direction_label(direction: ColOrName) -> Column:
    return F.when(F.coalesce(_c(direction), F.lit(0)) == 0, F.lit("outbound")).otherwise(F.lit("inbound"))


def split_key(c: ColOrName) -> Column:
    return F.split(_c(c), r"\|")


def null_token(c: ColOrName) -> Column:
    """PRJ-03: a text cell equal to n/a, nan, '' or null (any case) becomes NULL."""
    x = _c(c)
    return F.when(F.lower(x).isin(*NULL_TOKENS), F.lit(None)).otherwise(x)


#: Text of a whole number (an all-zero fraction is accepted) and of any number.
INTEGER_TEXT = r"^[+-]?\d+(?:\.0*)?$"
NUMBER_TEXT = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def parse_number(text: Column) -> Column:
    """Text as a double; anything that is not a plain number (``1f``, ``2d``, ``inf``) is NULL."""
    x = strip(text)
    return F.when(x.rlike(NUMBER_TEXT), x.try_cast("double"))


def parse_integer(text: Column) -> Column:
    """Text as a 64-bit integer, exactly; whole numbers only."""
    x = strip(text)
    return F.when(x.rlike(INTEGER_TEXT), F.regexp_extract(x, r"^([+-]?\d+)", 1).try_cast("bigint"))


# SC-23 ------------------------------------------------------------------------
def netex_bundle_name(operator: ColOrName, version: ColOrName, stamp: ColOrName) -> Column:
    """``NETEX_PT_<OPERATOR>_<version>_<yyyyMMddHHmm>``; the operator's name as an id, in upper case."""
    return F.concat(F.lit("NETEX_PT_"), F.upper(sanitise_local_id(operator)), F.lit("_"), _c(version), F.lit("_"),
                    F.date_format(_c(stamp), "yyyyMMddHHmm"))


def timetable_document_name(line_id: ColOrName) -> Column:
    return F.concat(F.lit("TimetableFrame_Schedules_Line_"), sanitise_local_id(line_id))
