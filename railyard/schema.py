"""Declarative row schemas and their distributed validator (PRJ-03..09, PRJ-22).

A ``Schema`` is a list of ``Field`` declarations. ``validate(df)`` turns each
field into native Column expressions (null-token cleaning, ``try_cast``,
range / choice / pattern checks), collects the messages of a row into one
array and splits good rows from error rows. It is one narrow stage: no
shuffle, no Python per row.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railyard.functions import scalars as S

SPARK_TYPES = {
    "str": T.StringType(),
    "int": T.LongType(),
    "float": T.DoubleType(),
    "bool": T.BooleanType(),
    "date": T.DateType(),
    "datetime": T.TimestampNTZType(),
    "time": T.IntegerType(),        # seconds since midnight
    "duration": T.LongType(),       # seconds
    "latlon": T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]),
    "list": T.ArrayType(T.StringType()),
}

TYPE_WORDS = {
    "str": "a valid string", "int": "a valid integer", "float": "a valid number", "bool": "a valid boolean",
    "date": "a valid date", "datetime": "a valid datetime", "time": "a valid time", "duration": "a valid duration",
    "latlon": "a valid tuple", "list": "a valid list",
}


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "str"
    required: bool = False
    ge: float | None = None
    le: float | None = None
    gt: float | None = None
    choices: tuple[str, ...] | None = None
    pattern: str | None = None
    pattern_label: str | None = None
    description: str = ""


@dataclass(frozen=True)
class Schema:
    name: str
    fields: tuple[Field, ...]
    pk: tuple[str, ...] = ()
    label: str = ""
    extra: dict = field(default_factory=dict, compare=False, hash=False)

    # -- introspection ------------------------------------------------------
    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def required_names(self) -> list[str]:
        return [f.name for f in self.fields if f.required]

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, SPARK_TYPES[f.type], not f.required) for f in self.fields])

    def describe(self, spark: SparkSession) -> DataFrame:
        """PRJ-22: one row per field (name, required, description, type)."""
        rows = [(self.name, f.name, f.required, f.description, f.type) for f in self.fields]
        return spark.createDataFrame(rows, "schema string, field string, required boolean, description string, type string")

    # -- relaxed variant (PRJ-06) -------------------------------------------
    def relaxed(self, mandatory: Iterable[str]) -> Schema:
        """Fields in ``mandatory`` keep their declaration; the others become
        optional and lose range/choice/pattern checks (type checks stay)."""
        keep = set(mandatory)
        out = []
        for f in self.fields:
            if f.name in keep:
                out.append(f)
            else:
                out.append(replace(f, required=False, ge=None, le=None, gt=None, choices=None, pattern=None))
        return replace(self, name=f"{self.name}Relaxed", fields=tuple(out))

    def missing_columns(self, columns: Sequence[str], mandatory: Iterable[str] | None = None) -> list[str]:
        """PRJ-04: mandatory columns absent from the input (plan-time)."""
        want = list(mandatory) if mandatory is not None else self.required_names()
        have = set(columns)
        return [c for c in want if c not in have]

    # -- validation ----------------------------------------------------------
    def validate(self, df: DataFrame, row_col: str = "row_num", keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
        """Split ``df`` into (good typed rows, error rows).

        Error rows: ``row_col``, ``line`` (= row + 2, the line in a file with
        a header), ``message`` (all problems of the row joined by "; ").
        ``keep`` columns (e.g. ``feed_id``) pass through to both outputs.
        """
        present = set(df.columns)
        typed_cols: list[Column] = []
        problems: list[Column] = []
        for f in self.fields:
            raw = F.col(f.name) if f.name in present else F.lit(None).cast("string")
            dtype = df.schema[f.name].dataType if f.name in present else T.StringType()
            clean = _clean(raw, dtype)
            val, type_bad = _parse_typed(clean, f.type, dtype)
            problems.append(F.when(clean.isNull() & F.lit(f.required), F.lit(f"{f.name}: Field required")))
            problems.append(F.when(type_bad, F.lit(f"{f.name}: Input should be {TYPE_WORDS[f.type]}")))
            for cond, msg in _constraints(f, val):
                problems.append(F.when(val.isNotNull() & ~cond, F.lit(f"{f.name}: {msg}")))
            typed_cols.append(val.alias(f.name))
        errs = F.array_compact(F.array(*problems))
        staged = df.select(*keep, *([F.col(row_col)] if row_col in present else []), *typed_cols, errs.alias("_errors"))
        ok = F.size("_errors") == 0
        good = staged.where(ok).drop("_errors")
        bad = staged.where(~ok).select(
            *keep,
            *([F.col(row_col), (F.col(row_col) + 2).alias("line")] if row_col in present else []),
            F.array_join("_errors", "; ").alias("message"),
        )
        return good, bad


def _clean(raw: Column, dtype: T.DataType) -> Column:
    """PRJ-03: null tokens (strings) and NaN (numbers) become NULL."""
    if isinstance(dtype, T.StringType):
        return S.null_token(raw)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(raw), F.lit(None)).otherwise(raw)
    return raw


_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_NUMERIC = (*_INTEGRAL, T.FloatType, T.DoubleType, T.DecimalType)


def _parse_typed(clean: Column, kind: str, dtype: T.DataType) -> tuple[Column, Column]:
    """Fast path when the column already has a compatible Spark type (Gold
    rows built by our own operators); text goes through ``_parse``."""
    no = F.lit(False)
    if kind == "str" and isinstance(dtype, T.StringType):
        return clean, no
    if kind == "int" and isinstance(dtype, _INTEGRAL):
        return clean.cast("long"), no
    if kind == "int" and isinstance(dtype, _NUMERIC):
        d = clean.cast("double")
        return F.when(d == F.floor(d), d.cast("long")), clean.isNotNull() & (d != F.floor(d))
    if kind == "float" and isinstance(dtype, _NUMERIC):
        return clean.cast("double"), no
    if kind == "bool" and isinstance(dtype, T.BooleanType):
        return clean, no
    if kind == "date" and isinstance(dtype, T.DateType):
        return clean, no
    if kind == "datetime" and isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return clean.cast("timestamp_ntz"), no
    return _parse(clean, kind)


def _parse(clean: Column, kind: str) -> tuple[Column, Column]:
    """(typed value, type-failure flag) for one cleaned cell."""
    txt = clean.cast("string")
    if kind == "str":
        val = txt
    elif kind == "int":
        val = S.parse_integer(txt)
    elif kind == "float":
        val = S.parse_number(txt)
    elif kind == "bool":
        val = F.lower(S.strip(txt)).try_cast("boolean")
    elif kind == "date":
        val = F.coalesce(S.strip(txt).try_cast("date"), F.try_to_date(S.strip(txt), "dd/MM/yyyy"))
    elif kind == "datetime":
        val = S.strip(txt).try_cast("timestamp_ntz")
    elif kind == "time":
        secs = S.time_to_seconds(txt)
        val = F.when(S.strip(txt).rlike(r"^\d{1,2}:\d{2}(:\d{2})?$") & (secs < 86400), secs.cast("int"))
    elif kind == "duration":
        val = F.when(S.strip(txt).rlike(r"^\d+(\.\d+)?$|^\d+:\d{2}(:\d{2})?$"), S.parse_duration_secs(txt))
    elif kind == "latlon":
        m = r"^\(?\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*\)?$"
        lat = F.regexp_extract(S.strip(txt), m, 1).try_cast("double")
        lon = F.regexp_extract(S.strip(txt), m, 2).try_cast("double")
        val = F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))
    elif kind == "list":
        val = F.transform(F.split(txt, ","), lambda x: F.trim(x))
    else:
        raise ValueError(f"unknown field type {kind}")
    return val, clean.isNotNull() & val.isNull()


def _constraints(f: Field, val: Column) -> list[tuple[Column, str]]:
    out: list[tuple[Column, str]] = []
    num = val if f.type in ("int", "float", "time", "duration") else None
    if num is not None:
        if f.ge is not None:
            out.append((num >= F.lit(f.ge), f"Input should be greater than or equal to {_fmt(f.ge)}"))
        if f.le is not None:
            out.append((num <= F.lit(f.le), f"Input should be less than or equal to {_fmt(f.le)}"))
        if f.gt is not None:
            out.append((num > F.lit(f.gt), f"Input should be greater than {_fmt(f.gt)}"))
    if f.choices is not None:
        quoted = ", ".join(f"'{c}'" for c in f.choices[:-1]) + f" or '{f.choices[-1]}'"
        out.append((val.isin(*f.choices), f"Input should be {quoted}"))
    if f.pattern is not None:
        label = f.pattern_label or "value"
        out.append((val.rlike(f.pattern), f"{label} does not match the required format"))
    return out


def _fmt(x: float) -> str:
    return str(int(x)) if float(x).is_integer() and not isinstance(x, float) else str(x)
