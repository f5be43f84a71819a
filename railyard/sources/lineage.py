"""Run lineage documents and artefact listings (SRC-15/16, SNK-06, SL-02/03, AG-23).

Lineage is one JSON document per run (``run_id``, ``project``, created time,
lists of bronze/silver/gold paths), written with Spark (``write.json``), so
listing and "latest per dataset" are distributed scans, not directory walks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railyard.operators import ordered

LINEAGE = T.StructType([
    T.StructField("project", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("bronze", T.ArrayType(T.StringType())),
    T.StructField("silver", T.ArrayType(T.StringType())),
    T.StructField("gold", T.ArrayType(T.StringType())),
])


def write_lineage(runs: DataFrame, path: str) -> None:
    """SNK-06: append lineage rows, partitioned by project and run."""
    runs.select(*[f.name for f in LINEAGE.fields]).write.mode("append").partitionBy("project", "run_id").json(path)


def read_lineage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LINEAGE).json(path)


def list_runs(lineage: DataFrame) -> DataFrame:
    """SRC-16 / SL-02: runs per project, newest first."""
    return lineage.select("project", "run_id", "created_at").orderBy("project", F.desc("created_at"), F.desc("run_id"))


def dataset_context(path_col) -> F.Column:
    """The dataset a Silver file belongs to: its file stem without extension."""
    return F.regexp_extract(path_col, r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1)


def latest_silver(lineage: DataFrame, suffix: str | None = None) -> DataFrame:
    """SRC-15 / WN-05: newest Silver file per (project, dataset)."""
    files = lineage.select("project", "run_id", "created_at", F.explode("silver").alias("path"))
    if suffix:
        files = files.where(F.col("path").endswith(suffix))
    files = files.withColumn("dataset", dataset_context(F.col("path")))
    return files.groupBy("project", "dataset").agg(
        F.max_by("path", F.struct("created_at", "run_id")).alias("path"),
        F.max("created_at").alias("created_at"))


def latest_export(exports: DataFrame) -> DataFrame:
    """SL-03: newest full export per project (subset exports excluded).
    ``exports``: (project, path, modified)."""
    full = exports.where(~F.lower(F.col("path")).contains("subset"))
    return full.groupBy("project").agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def list_exports(exports: DataFrame) -> DataFrame:
    """SL-02: exports with their rank, newest first. Ranks are dealt by range,
    so a project may have any number of them."""
    numbered = ordered.dense_ordinal(exports, ["project"], ["modified", "path"], "_n")
    total = exports.groupBy("project").agg(F.count(F.lit(1)).alias("_all"))
    return numbered.join(total, "project").select(*exports.columns, (F.col("_all") - F.col("_n") + 1).alias("rank"))


def maturity(bronze: DataFrame, silver: DataFrame, store_counts: DataFrame, exports: DataFrame) -> DataFrame:
    """AG-23: level 0..4 per project from artefact presence (bronze, silver,
    populated store, export). Each input lists (project) rows."""
    def flag(df, name):
        return df.select("project").distinct().withColumn(name, F.lit(True))

    populated = store_counts.where(F.col("records") > 0).select(F.col("feed_id").alias("project"))
    known = store_counts.select(F.col("feed_id").alias("project"))
    projects = (bronze.select("project").unionByName(silver.select("project")).unionByName(known)
                .unionByName(exports.select("project")).distinct())
    out = projects
    for df, name in ((bronze, "_b"), (silver, "_s"), (populated, "_d"), (exports, "_e")):
        out = out.join(flag(df, name), "project", "left")
    b, s, d, e = [F.coalesce(F.col(n), F.lit(False)) for n in ("_b", "_s", "_d", "_e")]
    level = F.when(e, 4).when(d, 3).when(s, 2).when(b, 1).otherwise(0)
    return out.select("project", level.alias("maturity_level"))
