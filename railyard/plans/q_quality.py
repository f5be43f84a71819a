"""Quality / profiling queries: gold metrics, column profile, counts, score, profile, ER edges, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from railyard import catalog, schemas
from railyard.operators import quality as Q
from railyard.operators import store
from railyard.plans import adapters as A
from railyard.plans.registry import register


def feed_tables(spark, sf):
    return {
        "agency": A.a_agency(spark, sf),
        "stops": A.a_stops(spark, sf),
        "routes": A.a_routes(spark, sf),
        "trips": A.a_trips(spark, sf),
        "stop_times": A.a_stop_times(spark, sf),
        "calendar": A.a_calendar(spark, sf),
        "calendar_dates": A.a_calendar_dates(spark, sf),
    }


_ADAPTER_TABLES = {"agency": "a_agency", "stops": "a_stops", "routes": "a_routes", "trips": "a_trips",
                   "stop_times": "a_stop_times", "calendar": "a_calendar", "calendar_dates": "a_calendar_dates"}

_COUNTS_VIEW = {"feed_counts": "\nUNION ALL\n".join(
    [f"SELECT 'F1' AS feed_id, '{t}' AS table_name, (SELECT count(*) FROM {_ADAPTER_TABLES[t]}) AS records"
     if t in _ADAPTER_TABLES else f"SELECT 'F1', '{t}', CAST(0 AS BIGINT)" for t in catalog.TABLES])}


# --- AG-01 -------------------------------------------------------------------------------
def _gold_sql(table: str, cols: list[str], numeric: list[str], instants: list[str]) -> str:
    parts = [f"SELECT '{table}' AS dataset, '*' AS column_name, 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM {table}",
             f"SELECT '{table}', '*', 'columns', {float(len(cols))}"]
    for c in cols:
        parts.append(f"SELECT '{table}', '{c}', 'null_ratio', count(*) FILTER (WHERE {c} IS NULL) / count(*) FROM {table}")
    for name in [*numeric, *instants]:
        c = f"epoch_us({name}) / 1e6" if name in instants else name
        for m, expr in (("count", f"count({c})"), ("mean", f"avg({c})"), ("std", f"stddev_samp({c})"),
                        ("min", f"min({c})"), ("max", f"max({c})"), ("25%", f"quantile_cont({c}, 0.25)"),
                        ("50%", f"quantile_cont({c}, 0.5)"), ("75%", f"quantile_cont({c}, 0.75)")):
            parts.append(f"SELECT '{table}', '{name}', '{m}', CAST({expr} AS DOUBLE) FROM {table}")
    return "\nUNION ALL\n".join(parts)


_GOLD = {"part": ["p_size", "p_retailprice"], "customer": ["c_acctbal", "c_nationkey"], "orders": ["o_totalprice"],
         "lineitem": ["l_quantity", "l_extendedprice"]}
_GOLD_INSTANTS = {"orders": ["o_orderdate"]}
_GOLD_COLS = {"part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
              "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
              "orders": ["o_orderkey", "o_orderdate", "o_totalprice"], "lineitem": ["l_orderkey", "l_quantity", "l_extendedprice"]}


@register(
    "gold_metrics",
    sql="SELECT dataset, column_name, metric, round(value, 6) AS value FROM (\n"
        + "\nUNION ALL\n".join(_gold_sql(t, _GOLD_COLS[t], n, _GOLD_INSTANTS.get(t, [])) for t, n in _GOLD.items()) + ")",
)
def gold_metrics(spark, sf):
    out = None
    for t, numeric in _GOLD.items():
        m = Q.gold_metrics(A.table(spark, sf, t).select(*_GOLD_COLS[t]), t, numeric, _GOLD_INSTANTS.get(t, []))
        out = m if out is None else out.unionByName(m)
    return out.select("dataset", "column_name", "metric", F.round("value", 6).alias("value"))


# --- AG-08 -------------------------------------------------------------------------------
_PROFILE_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
# column metadata as the engine reports it (Spark type names of the Parquet columns)
_PROFILE_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
                  "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}


def _profile_sql() -> str:
    parts = []
    for i, c in enumerate(_PROFILE_COLS):
        v = f"CAST({c} AS VARCHAR)"
        parts.append(f"""
        SELECT 'orders' AS table_name, {i} AS ordinal, '{c}' AS column_name, '{_PROFILE_TYPES[c]}' AS dtype,
               false AS not_null, {str(c == 'o_orderkey').upper()} AS is_primary_key,
               (SELECT count(*) FILTER (WHERE {c} IS NULL) FROM orders) AS null_count,
               round((SELECT count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*) FROM orders), 6) AS null_pct,
               (SELECT count(DISTINCT {c}) FROM orders) AS distinct_count,
               coalesce((SELECT string_agg(CASE WHEN length(v) > 40 THEN substr(v, 1, 37) || '…' ELSE v END, ', ' ORDER BY v)
                         FROM (SELECT DISTINCT {v} AS v FROM orders WHERE {c} IS NOT NULL ORDER BY v LIMIT 5)), '')
                 AS sample_values""")
    return "\nUNION ALL\n".join(parts)


@register("column_profile", sql=_profile_sql())
def column_profile(spark, sf):
    o = A.table(spark, sf, "orders").select(*_PROFILE_COLS)
    return Q.column_profile(o, "orders", pk=["o_orderkey"])


# --- AG-05 / 06 / 07 / JN-20 ---------------------------------------------------------------
@register("table_counts", sql="SELECT feed_id, table_name, records FROM feed_counts", extra_views=_COUNTS_VIEW)
def table_counts(spark, sf):
    return store.table_counts(feed_tables(spark, sf))


@register(
    "completeness_score",
    sql=f"""
    WITH c AS (SELECT *, records > 0 AS pop FROM feed_counts)
    SELECT feed_id,
           CAST(count(*) FILTER (WHERE pop AND table_name IN ('agency', 'stops', 'routes', 'trips', 'stop_times'))
             + max(CASE WHEN pop AND table_name IN ('calendar', 'calendar_dates') THEN 1 ELSE 0 END) AS BIGINT)
             AS required_populated,
           count(*) FILTER (WHERE pop AND table_name IN ('feed_info', 'shapes')) AS recommended_populated,
           count(*) FILTER (WHERE pop AND table_name IN ('frequencies', 'transfers', 'board_alight', 'ridership',
                                                          'ride_feed_info', 'trip_capacity')) AS optional_populated,
           round((count(*) FILTER (WHERE pop AND table_name IN ('agency', 'stops', 'routes', 'trips', 'stop_times'))
                  + max(CASE WHEN pop AND table_name IN ('calendar', 'calendar_dates') THEN 1 ELSE 0 END)) / 6.0 * 60
                 + count(*) FILTER (WHERE pop AND table_name IN ('feed_info', 'shapes')) / 2.0 * 25
                 + count(*) FILTER (WHERE pop AND table_name IN ('frequencies', 'transfers', 'board_alight', 'ridership',
                                                                 'ride_feed_info', 'trip_capacity')) / 6.0 * 15, 1) AS score
    FROM c GROUP BY feed_id
    """,
    extra_views=_COUNTS_VIEW,
)
def completeness_score(spark, sf):
    return Q.completeness(store.table_counts(feed_tables(spark, sf)))


_ORDER_CASE = "CASE table_name " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(catalog.TABLES)) + " END"


@register(
    "store_profile",
    sql=f"""
    WITH c AS (SELECT *, {_ORDER_CASE} AS ord FROM feed_counts)
    SELECT feed_id, CAST(sum(records) AS BIGINT) AS total_records, CAST(15 AS BIGINT) AS total_tables,
           count(*) FILTER (WHERE records > 0) AS populated_tables, count(*) FILTER (WHERE records = 0) AS empty_tables,
           coalesce(arg_max(table_name, records * 100 - ord) FILTER (WHERE records > 0), '') AS largest_table,
           coalesce(arg_min(table_name, records * 100 + ord) FILTER (WHERE records > 0), '') AS smallest_populated_table,
           round(count(*) FILTER (WHERE records > 0) / 15.0 * 100, 6) AS completeness_pct
    FROM c GROUP BY feed_id
    """,
    extra_views=_COUNTS_VIEW,
)
def store_profile(spark, sf):
    return Q.store_profile(store.table_counts(feed_tables(spark, sf)))


_FK_VALUES = ", ".join(f"('{e.ref_table}', '{e.table}', '{e.column}')" for e in catalog.FK_EDGES)


@register(
    "er_edges",
    sql=f"""
    WITH e AS (SELECT parent, child, string_agg(col, ', ' ORDER BY col) AS fk_columns
               FROM (VALUES {_FK_VALUES}) v(parent, child, col) GROUP BY parent, child)
    SELECT p.feed_id, e.parent, e.child, e.fk_columns, p.records AS parent_rows, c.records AS child_rows
    FROM e JOIN feed_counts p ON p.table_name = e.parent JOIN feed_counts c ON c.table_name = e.child
                                                                             AND c.feed_id = p.feed_id
    """,
    extra_views=_COUNTS_VIEW,
)
def er_edges(spark, sf):
    return Q.er_edges(spark, store.table_counts(feed_tables(spark, sf)))


# --- PRJ-13 -------------------------------------------------------------------------------
@register("drop_null_columns",
          sql="SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def drop_null_columns(spark, sf):
    p = A.table(spark, sf, "part")
    p = p.withColumn("p_comment", F.lit(None).cast("string")).withColumn(
        "p_container", F.when(F.col("p_size") > 100, F.lit("BOX")))
    return Q.drop_all_null_columns(p)


# --- PRJ-14 / SO-03 ---------------------------------------------------------------------------
_LABELS = list(schemas.UPLOADS)
_LABEL_VALUES = ", ".join("(%d, '%s')" % (i, lbl.replace("'", "''")) for i, lbl in enumerate(_LABELS))
_REQ_VALUES = ", ".join("('%s', '%s', '%s')" % (m, d, k) for m, g in schemas.MODE_REQUIREMENTS.items()
                        for k, ds in g.items() for d in ds)
_AVAIL_VIEW = {"available_datasets": f"""
    SELECT r_name AS project, label AS dataset FROM region, (VALUES {_LABEL_VALUES}) v(i, label)
    WHERE (i + r_regionkey) % 3 <> 0"""}


def _available(spark, sf):
    r = A.table(spark, sf, "region")
    labels = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(lbl).alias("label")) for i, lbl in enumerate(_LABELS)])
    x = r.select(F.col("r_name").alias("project"), "r_regionkey", F.explode(labels).alias("_l"))
    return x.where((F.col("_l.i") + F.col("r_regionkey")) % 3 != 0).select("project", F.col("_l.label").alias("dataset"))


@register(
    "mode_checklist",
    sql=f"""
    SELECT p.project, q.mode, q.dataset, q.kind,
           EXISTS (SELECT 1 FROM available_datasets a WHERE a.project = p.project AND a.dataset = q.dataset) AS available
    FROM (SELECT DISTINCT project FROM available_datasets) p, (VALUES {_REQ_VALUES}) q(mode, dataset, kind)
    """,
    extra_views=_AVAIL_VIEW,
)
def mode_checklist(spark, sf):
    return Q.mode_checklist(_available(spark, sf), schemas.MODE_REQUIREMENTS)


@register(
    "quality_gate",
    sql=f"""
    WITH c AS (SELECT p.project, q.mode, q.dataset, q.kind,
                      EXISTS (SELECT 1 FROM available_datasets a WHERE a.project = p.project AND a.dataset = q.dataset)
                        AS available
               FROM (SELECT DISTINCT project FROM available_datasets) p, (VALUES {_REQ_VALUES}) q(mode, dataset, kind))
    SELECT project, mode,
           coalesce(string_agg(CASE WHEN kind = 'required' AND NOT available THEN dataset END, ', '
                               ORDER BY CASE WHEN kind = 'required' AND NOT available THEN dataset END), '') AS missing,
           count(*) FILTER (WHERE kind = 'required' AND NOT available) = 0 AS passed
    FROM c GROUP BY project, mode
    """,
    extra_views=_AVAIL_VIEW,
)
def quality_gate(spark, sf):
    return Q.quality_gate(Q.mode_checklist(_available(spark, sf), schemas.MODE_REQUIREMENTS))
