"""Bronze / Silver / Gold writers and reports (SNK-01..08, AG-03).

All writes go under ``<root>/project=<p>/run_id=<r>/...`` as Spark datasets;
Spark's committer leaves ``_SUCCESS`` behind each completed dataset.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railyard.functions import scalars as S
from railyard.sources import geojson


def run_dir(root: str, project: str, run_id: str) -> str:
    return f"{root.rstrip('/')}/project={S.safe_name_text(project)}/run_id={run_id}"


def save_bronze(spark: SparkSession, source_glob: str, root: str, project: str, run_id: str) -> str:
    """SNK-01: raw bytes unchanged (binaryFile rows) as Parquet."""
    out = f"{run_dir(root, project, run_id)}/bronze"
    spark.read.format("binaryFile").load(source_glob).write.mode("overwrite").parquet(out)
    return out


def save_silver(df: DataFrame, root: str, project: str, run_id: str, dataset: str) -> str:
    """SNK-02: Silver table as gzip Parquet."""
    out = f"{run_dir(root, project, run_id)}/silver/{S.safe_name_text(dataset)}"
    df.write.mode("overwrite").option("compression", "gzip").parquet(out)
    return out


def save_silver_spatial(features: DataFrame, root: str, project: str, run_id: str, dataset: str) -> str:
    """SNK-03: features with the geometry struct and a WKT column."""
    out = f"{run_dir(root, project, run_id)}/silver/{S.safe_name_text(dataset)}"
    features.withColumn("wkt", geojson.to_wkt(F.col("geometry"))).write.mode("overwrite").parquet(out)
    return out


def validation_report(good: DataFrame, bad: DataFrame, dataset: str) -> DataFrame:
    """AG-03: total / valid / invalid rows (one row)."""
    flags = good.select(F.lit(True).alias("_ok")).unionByName(bad.select(F.lit(False).alias("_ok")))
    return flags.agg(F.count(F.lit(1)).alias("total"), F.count_if("_ok").alias("valid"),
                     F.count_if(~F.col("_ok")).alias("invalid")).select(F.lit(dataset).alias("dataset"), "total",
                                                                       "valid", "invalid")


def save_report(report: DataFrame, root: str, project: str, run_id: str, kind: str, dataset: str) -> str:
    """SNK-04 / SNK-05: validation report or Gold metrics as JSON."""
    out = f"{run_dir(root, project, run_id)}/{kind}/{S.safe_name_text(dataset)}_report"
    report.coalesce(1).write.mode("overwrite").json(out)
    return out


def save_feature_store(tables: Mapping[str, DataFrame], root: str, scenario: str, run_id: str) -> dict[str, str]:
    """SNK-07: versioned feature store — every dataset under one run folder;
    the audit record is written last so a run is complete iff it exists."""
    base = f"{root.rstrip('/')}/scenario={S.safe_name_text(scenario)}/run_id={run_id}"
    paths = {}
    spark = None
    for name, df in tables.items():
        p = f"{base}/{S.safe_name_text(name)}"
        df.write.mode("overwrite").option("compression", "gzip").parquet(p)
        paths[name] = p
        spark = df.sparkSession
    if spark is not None:
        audit = spark.createDataFrame([(scenario, run_id, name, p) for name, p in paths.items()],
                                      "scenario string, run_id string, dataset string, path string")
        audit.coalesce(1).write.mode("overwrite").json(f"{base}/_audit")
    return paths


def save_gold(samples: DataFrame, root: str, project: str, run_id: str, name: str,
              extra: Mapping[str, DataFrame] | None = None) -> dict[str, str]:
    """SNK-08: Mode A/B samples (gzip Parquet) plus context datasets
    (economic data copy, topology nodes / edges / summary)."""
    base = f"{run_dir(root, project, run_id)}/gold"
    out = {name: f"{base}/{name}"}
    samples.write.mode("overwrite").option("compression", "gzip").parquet(out[name])
    for k, df in (extra or {}).items():
        out[k] = f"{base}/{k}"
        df.write.mode("overwrite").option("compression", "gzip").parquet(out[k])
    return out
