"""Quality, profiling and completeness operators (AG-01..08, PRJ-13..15, JN-20).

Whole-table statistics are single aggregates with map-side partial
aggregation. Exact quantiles are computed distributively: a sketch brackets
each one, and only the values inside the brackets are ranked (no column is
ever buffered in one task, unlike an exact ``percentile`` aggregate).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railyard import catalog
from railyard.functions import scalars as S
from railyard.operators import ordered

FEED = "feed_id"
QUANTILES = (("25%", 0.25), ("50%", 0.5), ("75%", 0.75))


#: Accuracy of the sketch that brackets each quantile (its rank error is 1 / this).
SKETCH_ACCURACY = 2_000


def exact_quantiles(df: DataFrame, cols: Sequence[str], qs=QUANTILES) -> DataFrame:
    """(column_name, metric, value): linear-interpolated quantiles (like
    ``quantile_cont``/pandas) of every column, NULL and NaN excluded.

    One pass brackets every quantile by two values of a sketch, with twice its
    rank error to either side. A second pass counts what lies below each bracket
    and groups the values inside it; only those are ranked."""
    num = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols}
    margin = 2.0 / SKETCH_ACCURACY
    bounds = [0.0, 1.0, *(max(0.0, min(1.0, q + m)) for _, q in qs for m in (-margin, margin))]
    sketch = df.agg(*[F.percentile_approx(x, bounds, SKETCH_ACCURACY).alias(f"b{i}") for i, x in enumerate(num.values())],
                    *[F.count(x).alias(f"n{i}") for i, x in enumerate(num.values())]).first()  # one row, a few values a column
    below, inside, targets = [], [], []
    for i, (c, x) in enumerate(num.items()):
        for j, (name, q) in enumerate(qs):
            if not sketch[f"n{i}"]:
                continue
            # with few values a rank is more than the margin: the bracket is the whole range
            at = 0 if sketch[f"n{i}"] <= SKETCH_ACCURACY else 2 * j + 2
            low, high = sketch[f"b{i}"][at], sketch[f"b{i}"][at + 1]
            at = q * (sketch[f"n{i}"] - 1)
            targets.append((c, name, int(at) + 1, int(at) + (at > int(at)) + 1, at - int(at)))
            below.append(F.count_if(x < low).alias(f"c{len(below)}"))
            inside.append(F.when(x.between(low, high), F.struct(F.lit(c).alias("column_name"), F.lit(name).alias("metric"), x.alias("value"))))
    spark = df.sparkSession
    frame = spark.createDataFrame(targets, "column_name string, metric string, _lo long, _hi long, _frac double")
    if not targets:
        return frame.select("column_name", "metric", F.lit(None).cast("double").alias("value"))
    counts = df.agg(*below).first()
    base = spark.createDataFrame([(t[0], t[1], counts[f"c{k}"]) for k, t in enumerate(targets)], "column_name string, metric string, _below long")
    values = (df.select(F.explode(F.array_compact(F.array(*inside))).alias("_v")).select("_v.*")
              .groupBy("column_name", "metric", "value").agg(F.count(F.lit(1)).alias("_n")))
    upto = ordered.running_total(values, ["column_name", "metric"], ["value"], F.col("_n"), "_upto")
    # of a column and quantile: the first value whose rank reaches the wanted one
    known = upto.join(base, ["column_name", "metric"]).join(frame, ["column_name", "metric"])
    last = F.col("_below") + F.col("_upto")
    first = last - F.col("_n")
    reached = lambda rank: F.max(F.when((first < rank) & (last >= rank), F.col("value")))
    agg = known.groupBy("column_name", "metric", "_frac").agg(reached(F.col("_lo")).alias("_vlo"), reached(F.col("_hi")).alias("_vhi"))
    return agg.select("column_name", "metric",
                      (F.col("_vlo") + F.col("_frac") * (F.col("_vhi") - F.col("_vlo"))).alias("value"))


def seconds_of(col: Column | str) -> Column:
    """An instant as seconds since 1970 (a number, so that it has the statistics of one)."""
    epoch = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    return F.timestamp_diff("MICROSECOND", epoch, F.col(col) if isinstance(col, str) else col) / 1e6


def gold_metrics(df: DataFrame, dataset: str, numeric: Sequence[str], instants: Sequence[str] = ()) -> DataFrame:
    """AG-01 in long form (dataset, column_name, metric, value). Instants get the
    statistics of numbers too, in seconds since 1970.

    Table rows/columns, null ratio of every column, and describe()-style
    count/mean/std/min/25%/50%/75%/max of every numeric column."""
    cols = df.columns
    df = df.withColumns({c: seconds_of(c) for c in instants})
    numeric = [*numeric, *instants]
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in cols:
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"_null_{c}"))
    for c in numeric:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"_count_{c}"), F.avg(x).alias(f"_mean_{c}"), F.stddev_samp(x).alias(f"_std_{c}"),
                 F.min(x).alias(f"_min_{c}"), F.max(x).alias(f"_max_{c}")]
    one = df.agg(*aggs)
    def kv(col: str, metric: str, value):
        return F.struct(F.lit(col).alias("column_name"), F.lit(metric).alias("metric"),
                        value.cast("double").alias("value"))

    rows = [kv("*", "rows", F.col("_rows")), kv("*", "columns", F.lit(float(len(cols))))]
    for c in cols:
        rows.append(kv(c, "null_ratio",
                       F.when(F.col("_rows") > 0, F.col(f"_null_{c}") / F.col("_rows")).otherwise(F.lit(0.0))))
    for c in numeric:
        for m in ("count", "mean", "std", "min", "max"):
            rows.append(kv(c, m, F.col(f"_{m}_{c}")))
    basic = one.select(F.explode(F.array(*rows)).alias("_r")).select(
        F.col("_r.column_name").alias("column_name"), F.col("_r.metric").alias("metric"), F.col("_r.value").alias("value"))
    quants = exact_quantiles(df, numeric) if numeric else None
    out = basic if quants is None else basic.unionByName(quants)
    return out.select(F.lit(dataset).alias("dataset"), "column_name", "metric", "value")


def column_profile(df: DataFrame, table: str, pk: Sequence[str] = (), sample_limit: int = 5) -> DataFrame:
    """AG-08: per column type, NOT NULL flag, primary-key flag, null count,
    null %, exact distinct count and the ``sample_limit`` smallest distinct
    values (as text, 40 chars max).

    One unpivot to (column, text value) serves every column; distinct values
    are reduced by a shuffle on (column, value) and the samples are picked by
    a salted two-phase top-N, so a wide or high-cardinality column never
    lands whole in one task."""
    cols = df.columns
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v"))
        for i, c in enumerate(cols)])).alias("_kv")).select("_kv.*")
    per_value = long.groupBy("ordinal", "column_name", "v").agg(F.count(F.lit(1)).alias("_n"))
    stats = per_value.groupBy("ordinal", "column_name").agg(
        F.sum(F.when(F.col("v").isNull(), F.col("_n")).otherwise(0)).alias("null_count"),
        F.sum("_n").alias("_total"),
        F.count("v").alias("distinct_count"),
    )
    distinct_vals = per_value.where(F.col("v").isNotNull()).select("ordinal", "column_name", "v")
    samples = ordered.top_n_per_group(distinct_vals, ["ordinal", "column_name"], ["v"], sample_limit, "_rk")
    samples = samples.groupBy("ordinal", "column_name").agg(
        F.array_sort(F.collect_list(F.struct("_rk", S.stringify("v").alias("s")))).alias("_s"))
    out = stats.join(samples, ["ordinal", "column_name"], "left")
    meta = F.create_map(*[x for c in cols for x in (F.lit(c), F.struct(
        F.lit(df.schema[c].dataType.simpleString()).alias("dtype"), F.lit(not df.schema[c].nullable).alias("not_null")))])
    return out.select(
        F.lit(table).alias("table_name"), "ordinal", "column_name",
        meta[F.col("column_name")]["dtype"].alias("dtype"), meta[F.col("column_name")]["not_null"].alias("not_null"),
        F.col("column_name").isin(*pk).alias("is_primary_key"),
        F.col("null_count").cast("long").alias("null_count"),
        F.round(F.when(F.col("_total") > 0, F.col("null_count") * 100.0 / F.col("_total")).otherwise(0.0), 6)
        .alias("null_pct"),
        F.col("distinct_count").cast("long").alias("distinct_count"),
        F.coalesce(F.array_join(F.transform("_s", lambda x: x["s"]), ", "), F.lit("")).alias("sample_values"),
    )


def completeness(counts: DataFrame) -> DataFrame:
    """AG-06: 60 * required/6 + 25 * recommended/2 + 15 * (optional+ride)/6.

    ``counts``: (feed_id, table_name, records) for every catalogue table."""
    pop = F.col("records") > 0
    per_feed = counts.groupBy(FEED).agg(
        F.count_if(F.col("table_name").isin(*catalog.REQUIRED_TABLES) & pop).alias("required_populated"),
        F.max(F.when(F.col("table_name").isin(*catalog.CALENDAR_TABLES) & pop, 1).otherwise(0)).alias("_cal"),
        F.count_if(F.col("table_name").isin(*catalog.RECOMMENDED_TABLES) & pop).alias("recommended_populated"),
        F.count_if(F.col("table_name").isin(*catalog.OPTIONAL_TABLES, *catalog.RIDE_TABLES) & pop)
        .alias("optional_populated"),
    )
    n_req = len(catalog.REQUIRED_TABLES) + 1
    n_rec = len(catalog.RECOMMENDED_TABLES)
    n_opt = len(catalog.OPTIONAL_TABLES) + len(catalog.RIDE_TABLES)
    req = F.col("required_populated") + F.col("_cal")
    score = (req / n_req * catalog.WEIGHT_REQUIRED
             + F.col("recommended_populated") / n_rec * catalog.WEIGHT_RECOMMENDED
             + F.col("optional_populated") / n_opt * catalog.WEIGHT_OPTIONAL)
    return per_feed.select(FEED, req.cast("long").alias("required_populated"),
                           F.col("recommended_populated").cast("long").alias("recommended_populated"),
                           F.col("optional_populated").cast("long").alias("optional_populated"),
                           F.round(score, 1).alias("score"))


def store_profile(counts: DataFrame) -> DataFrame:
    """AG-07: totals, populated/empty, largest and smallest populated table
    (ties go to the first table in catalogue order), completeness %."""
    order = F.create_map(*[x for i, t in enumerate(catalog.TABLES) for x in (F.lit(t), F.lit(i))])
    c = counts.withColumn("_ord", order[F.col("table_name")])
    pop = F.col("records") > 0
    n = len(catalog.TABLES)
    agg = c.groupBy(FEED).agg(
        F.sum("records").cast("long").alias("total_records"),
        F.count_if(pop).alias("populated_tables"),
        F.count_if(~pop).alias("empty_tables"),
        F.max_by(F.when(pop, F.col("table_name")), F.struct(F.col("records"), -F.col("_ord"))).alias("largest_table"),
        F.min_by(F.col("table_name"), F.struct(F.when(pop, 0).otherwise(1), F.col("records"), F.col("_ord")))
        .alias("_smallest"),
    )
    return agg.select(
        FEED, "total_records", F.lit(n).cast("long").alias("total_tables"),
        F.col("populated_tables").cast("long").alias("populated_tables"),
        F.col("empty_tables").cast("long").alias("empty_tables"),
        F.coalesce("largest_table", F.lit("")).alias("largest_table"),
        F.when(F.col("populated_tables") > 0, F.col("_smallest")).otherwise(F.lit("")).alias("smallest_populated_table"),
        F.round(F.col("populated_tables") / n * 100.0, 6).alias("completeness_pct"),
    )


def er_edges(spark: SparkSession, counts: DataFrame) -> DataFrame:
    """JN-20: FK edges grouped by (parent, child) with columns and row counts."""
    edges = spark.createDataFrame([(e.ref_table, e.table, e.column) for e in catalog.FK_EDGES],
                                  "parent string, child string, fk_column string")
    grouped = edges.groupBy("parent", "child").agg(F.array_join(F.array_sort(F.collect_list("fk_column")), ", ")
                                                   .alias("fk_columns"))
    pc = counts.select(FEED, F.col("table_name").alias("parent"), F.col("records").alias("parent_rows"))
    cc = counts.select(FEED, F.col("table_name").alias("child"), F.col("records").alias("child_rows"))
    return pc.join(F.broadcast(grouped), "parent").join(cc, [FEED, "child"]).select(
        FEED, "parent", "child", "fk_columns", "parent_rows", "child_rows")


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """PRJ-13: one counting pass (a single-row result), then a projection."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    keep = [c for c in df.columns if counts[c] > 0]
    return df.select(*keep)


def mode_checklist(available: DataFrame, requirements: Mapping[str, Mapping[str, list]]) -> DataFrame:
    """PRJ-14: per (project, mode, dataset): kind, available. ``available``:
    (project, dataset) rows; the fixed requirement list is exploded per project."""
    reqs = [F.struct(F.lit(m).alias("mode"), F.lit(d).alias("dataset"), F.lit(k).alias("kind"))
            for m, groups in requirements.items() for k, ds in groups.items() for d in ds]
    grid = available.select("project").distinct().select("project", F.explode(F.array(*reqs)).alias("_r"))
    grid = grid.select("project", "_r.*")
    avail = available.select("project", "dataset").distinct().withColumn("_a", F.lit(True))
    return grid.join(avail, ["project", "dataset"], "left").select(
        "project", "mode", "dataset", "kind", F.coalesce("_a", F.lit(False)).alias("available"))


def quality_gate(checklist: DataFrame) -> DataFrame:
    """PRJ-14 / SO-03: missing required datasets per (project, mode)."""
    return checklist.groupBy("project", "mode").agg(
        F.array_join(F.array_sort(F.collect_list(F.when((F.col("kind") == "required") & ~F.col("available"),
                                                        F.col("dataset")))), ", ").alias("missing"),
        (F.count_if((F.col("kind") == "required") & ~F.col("available")) == 0).alias("passed"),
    )
