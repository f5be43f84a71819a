"""GeoJSON features (SRC-10), geometry validity (PRJ-11/12) and geometry metrics (AG-02).

Geometries are kept as ``struct<type string, coordinates string>`` where
``coordinates`` is the JSON text of the nested coordinate arrays; validity
parses it into typed arrays per geometry type with ``from_json``.
Validity: not NULL, non-empty coordinates, finite numbers; a Point has 2+
numbers; a LineString 2+ distinct positions; a Polygon's rings are closed with
4+ positions and valid together (``sources.polygons``), as are the members of a
MultiPolygon; the other Multi* kinds are valid if every member is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railyard.sources import polygons

FEED = "feed_id"

GEOMETRY = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])
FEATURE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    T.StructField("geometry", GEOMETRY),
])
COLLECTION = T.StructType([T.StructField("type", T.StringType()), T.StructField("features", T.ArrayType(FEATURE))])

_POS = T.ArrayType(T.DoubleType())
_LINE = T.ArrayType(_POS)
_POLY = T.ArrayType(_LINE)
_POLYS = T.ArrayType(_POLY)


def read_feature_collections(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10: FeatureCollection files → one row per feature. A file is one
    document, read by one task; see :func:`read_features` for large inputs."""
    raw = spark.read.option("multiLine", True).option("primitivesAsString", True).schema(COLLECTION).json(path)
    feats = raw.select(F.col("_metadata.file_path").alias("_file"), F.posexplode("features").alias("row_num", "f"))
    return feats.select("_file", "row_num", F.col("f.properties").alias("properties"), F.col("f.geometry").alias("geometry"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10 for large inputs: files of one feature a line → one row per feature.
    Lines are read in splits, so they have no ``row_num``."""
    raw = spark.read.option("primitivesAsString", True).schema(FEATURE).json(path)
    return raw.select(F.col("_metadata.file_path").alias("_file"), "properties", "geometry")


def features_from_json(text: DataFrame, col: str) -> DataFrame:
    """Parse FeatureCollection JSON text held in a column (one document per row)."""
    doc = text.select("*", F.from_json(F.col(col), COLLECTION).alias("_doc"))
    out = doc.select(*[c for c in text.columns if c != col], F.posexplode("_doc.features").alias("row_num", "f"))
    return out.select(*[c for c in text.columns if c != col], "row_num", F.col("f.properties").alias("properties"),
                      F.col("f.geometry").alias("geometry"))


def _finite(a: Column) -> Column:
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def _point_ok(p: Column) -> Column:
    return p.isNotNull() & (F.size(p) >= 2) & _finite(p)


def _line_ok(ln: Column) -> Column:
    return ln.isNotNull() & (F.size(F.array_distinct(ln)) >= 2) & F.forall(ln, _point_ok)


def _ring_ok(r: Column) -> Column:
    return (F.size(r) >= 4) & (F.get(r, 0) == F.element_at(r, -1)) & F.forall(r, _point_ok)


def _polygon_ok(pg: Column) -> Column:
    return pg.isNotNull() & (F.size(pg) >= 1) & F.forall(pg, _ring_ok)


def geometry_valid(geom: Column) -> Column:
    """PRJ-11 predicate (NULL-safe: a NULL geometry is invalid)."""
    t, c = geom["type"], geom["coordinates"]

    def each(kind: T.DataType, ok) -> Column:
        many = F.from_json(c, kind)
        return many.isNotNull() & (F.size(many) >= 1) & F.forall(many, ok)

    ok = (F.when(t == "Point", _point_ok(F.from_json(c, _POS))).when(t == "LineString", _line_ok(F.from_json(c, _LINE)))
          .when(t == "Polygon", _polygon_ok(F.from_json(c, _POLY))).when(t == "MultiPoint", each(_LINE, _point_ok))
          .when(t == "MultiLineString", each(_POLY, _line_ok)).when(t == "MultiPolygon", each(_POLYS, _polygon_ok))
          .otherwise(F.lit(False)))
    # only closed, finite rings go on to the sweep
    together = polygons.rings_valid(t, F.when(F.coalesce(ok, F.lit(False)), c))
    return F.coalesce(geom.isNotNull() & c.isNotNull() & ok & F.coalesce(together, F.lit(True)), F.lit(False))


def filter_valid(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    v = geometry_valid(F.col("geometry"))
    return features.where(v), features.where(~v)


def validation_counts(features: DataFrame, required: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """PRJ-12: total / valid / invalid, plus required properties missing from
    every feature (as a list). One flag per required property is aggregated,
    never a list of the properties seen."""
    seen = [F.coalesce(F.max(F.map_contains_key("properties", F.lit(p))), F.lit(False)).alias(f"_seen{i}") for i, p in enumerate(required)]
    agg = features.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(geometry_valid(F.col("geometry"))).alias("valid"), *seen)
    missing = F.array_compact(F.array(*[F.when(~F.col(f"_seen{i}"), F.lit(p)) for i, p in enumerate(required)])) \
        if required else F.array().cast("array<string>")
    return agg.select(*keys, "total", "valid", (F.col("total") - F.col("valid")).alias("invalid"),
                      missing.alias("missing_columns"))


def geometry_metrics(features: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """AG-02: features per geometry type (NULL geometry counted as 'null')."""
    t = F.coalesce(F.col("geometry.type"), F.lit("null"))
    return features.groupBy(*keys, t.alias("geometry_type")).agg(F.count(F.lit(1)).alias("features"))


def null_ratios(features: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """AG-02: share of features whose geometry, or whose named property, is NULL or absent."""
    ratio = lambda x: F.avg(x.isNull().cast("int"))
    return features.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("features"), ratio(F.col("geometry")).alias("geometry"),
        *[ratio(F.try_element_at("properties", F.lit(c))).alias(c) for c in columns])


def to_wkt(geom: Column) -> Column:
    """WKT text of every geometry kind (SNK-03 text column)."""
    c, t = geom["coordinates"], geom["type"]

    def listed(a: Column, item) -> Column:
        return F.concat(F.lit("("), F.concat_ws(", ", F.transform(a, item)), F.lit(")"))

    pos = lambda p: F.concat_ws(" ", F.transform(p, lambda x: x.cast("string")))
    line = lambda ln: listed(ln, pos)
    polygon = lambda pg: listed(pg, line)
    named = lambda name, text: F.concat(F.lit(f"{name} "), text)
    return (F.when(t == "Point", named("POINT", F.concat(F.lit("("), pos(F.from_json(c, _POS)), F.lit(")"))))
            .when(t == "LineString", named("LINESTRING", line(F.from_json(c, _LINE))))
            .when(t == "Polygon", named("POLYGON", polygon(F.from_json(c, _POLY))))
            .when(t == "MultiPoint", named("MULTIPOINT", line(F.from_json(c, _LINE))))
            .when(t == "MultiLineString", named("MULTILINESTRING", polygon(F.from_json(c, _POLY))))
            .when(t == "MultiPolygon", named("MULTIPOLYGON", listed(F.from_json(c, _POLYS), polygon))))
