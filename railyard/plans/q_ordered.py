"""Input-order queries: duplicate keys, stop_sequence order, first/last per key."""

from __future__ import annotations

from pyspark.sql import functions as F

from railyard.operators import ordered
from railyard.plans import adapters as A
from railyard.plans.registry import register

_ORDER_SQL = "l_shipdate, l_suppkey, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax"
_ROW_KEY = ["l_shipdate", "l_suppkey", "l_partkey", "l_extendedprice"]


def _row_key_cols(prefix: str = "", src: str | None = None):
    """The row's position in file order, given by its (unique) order key.

    The adapter table has no line numbers; numbering every row would cost a
    whole-table sort, so issues name the row by its order key instead.
    """
    def col(c):
        return F.col(f"{src}.{c}" if src else c)
    out = [F.to_date(col("l_shipdate")).alias(f"{prefix}ship_date")]
    out += [col(c).alias(prefix + c[2:]) for c in _ROW_KEY[1:]]
    return out


_DUP_SQL = """
    WITH f AS (SELECT *, first_value({'s': l_shipdate, 'u': l_suppkey, 'p': l_partkey, 'e': l_extendedprice})
                           OVER (PARTITION BY feed_id, trip_id, stop_sequence ORDER BY ORDER_COLS) AS fr,
                      row_number() OVER (PARTITION BY feed_id, trip_id, stop_sequence ORDER BY ORDER_COLS) AS rn
               FROM a_stop_times)
    SELECT feed_id, 'error' AS severity, 'stop_times.txt' AS file_name, trip_id, stop_sequence,
           CAST(l_shipdate AS DATE) AS ship_date, l_suppkey AS suppkey, l_partkey AS partkey,
           l_extendedprice AS extendedprice,
           CAST(fr.s AS DATE) AS first_ship_date, fr.u AS first_suppkey, fr.p AS first_partkey,
           fr.e AS first_extendedprice,
           'Duplicate primary key [''trip_id'', ''stop_sequence'']=[''' || CAST(trip_id AS VARCHAR) || ''', '''
             || CAST(stop_sequence AS VARCHAR) || ''']' AS message
    FROM f WHERE rn > 1
""".replace("ORDER_COLS", _ORDER_SQL)


@register("duplicate_keys", sql=_DUP_SQL)
def duplicate_keys(spark, sf):
    """WN-09 / VAL-03: every later row of a (trip_id, stop_sequence), naming the first."""
    st = A.a_stop_times(spark, sf).select("feed_id", "trip_id", "stop_sequence", *A.stop_time_order_cols())
    dups = ordered.duplicates_after_first(st, ["feed_id", "trip_id", "stop_sequence"], A.stop_time_order_cols(), "_first")
    return dups.select(
        "feed_id",
        F.lit("error").alias("severity"),
        F.lit("stop_times.txt").alias("file_name"),
        "trip_id", "stop_sequence",
        *_row_key_cols(),
        *_row_key_cols("first_", "_first"),
        F.format_string("Duplicate primary key ['trip_id', 'stop_sequence']=['%s', '%s']",
                        F.col("trip_id").cast("string"), F.col("stop_sequence").cast("string")).alias("message"),
    )


_SEQ_SQL = """
    WITH l AS (SELECT *, lag(stop_sequence) OVER (PARTITION BY feed_id, trip_id ORDER BY ORDER_COLS) AS prev_seq
               FROM a_stop_times)
    SELECT feed_id, 'error' AS severity, 'stop_times.txt' AS file_name, trip_id, stop_sequence, prev_seq,
           CAST(l_shipdate AS DATE) AS ship_date, l_suppkey AS suppkey, l_partkey AS partkey,
           l_extendedprice AS extendedprice,
           'trip_id ''' || CAST(trip_id AS VARCHAR) || ''' stop_sequence must strictly increase (saw '
             || CAST(prev_seq AS VARCHAR) || ' then ' || CAST(stop_sequence AS VARCHAR) || ')' AS message
    FROM l WHERE prev_seq IS NOT NULL AND stop_sequence <= prev_seq
""".replace("ORDER_COLS", _ORDER_SQL)


@register("sequence_order_issues", sql=_SEQ_SQL)
def sequence_order_issues(spark, sf):
    """WN-01 / VAL-09: stop_sequence must strictly increase per trip in file order."""
    st = A.a_stop_times(spark, sf).select("feed_id", "trip_id", "stop_sequence", *A.stop_time_order_cols())
    lagged = ordered.lag_over(st, ["feed_id", "trip_id"], A.stop_time_order_cols(), "stop_sequence", "prev_seq")
    bad = lagged.where(F.col("prev_seq").isNotNull() & (F.col("stop_sequence") <= F.col("prev_seq")))
    return bad.select(
        "feed_id",
        F.lit("error").alias("severity"),
        F.lit("stop_times.txt").alias("file_name"),
        "trip_id", "stop_sequence", "prev_seq",
        *_row_key_cols(),
        F.format_string("trip_id '%s' stop_sequence must strictly increase (saw %d then %d)",
                        F.col("trip_id").cast("string"), F.col("prev_seq"), F.col("stop_sequence")).alias("message"),
    )


_KEEP_COLS = "feed_id, trip_id, stop_sequence, stop_id, l_suppkey, l_extendedprice"


@register(
    "keep_first",
    sql=f"""
    SELECT {_KEEP_COLS} FROM a_stop_times
    QUALIFY row_number() OVER (PARTITION BY feed_id, trip_id, stop_sequence ORDER BY {_ORDER_SQL}) = 1
    """,
)
def keep_first(spark, sf):
    st = A.a_stop_times(spark, sf)
    cols = [c.strip() for c in _KEEP_COLS.split(",")]
    firsts = ordered.first_per_key(st.select(*cols, *[c for c in A.stop_time_order_cols() if c not in cols]),
                                   ["feed_id", "trip_id", "stop_sequence"], A.stop_time_order_cols())
    return firsts.select(*cols)


@register(
    "keep_last",
    sql=f"""
    SELECT {_KEEP_COLS} FROM a_stop_times
    QUALIFY row_number() OVER (PARTITION BY feed_id, trip_id, stop_sequence
                               ORDER BY l_shipdate DESC, l_suppkey DESC, l_partkey DESC, l_extendedprice DESC,
                                        l_quantity DESC, l_discount DESC, l_tax DESC) = 1
    """,
)
def keep_last(spark, sf):
    st = A.a_stop_times(spark, sf)
    cols = [c.strip() for c in _KEEP_COLS.split(",")]
    lasts = ordered.first_per_key(st.select(*cols, *[c for c in A.stop_time_order_cols() if c not in cols]),
                                  ["feed_id", "trip_id", "stop_sequence"], A.stop_time_order_cols(), last=True)
    return lasts.select(*cols)


@register(
    "top_parts_per_brand",
    sql="""
    SELECT p_brand, p_partkey, p_retailprice, rank FROM (
      SELECT p_brand, p_partkey, p_retailprice,
             row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part)
    WHERE rank <= 5
    """,
)
def top_parts_per_brand(spark, sf):
    """WN-07 first-N per group (the profile's 5 samples), salted two-phase."""
    p = A.table(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice")
    top = ordered.top_n_per_group(p, ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")], 5)
    return top.select("p_brand", "p_partkey", "p_retailprice", F.col("rank").cast("long").alias("rank"))


@register(
    "trip_ordinals",
    sql="""
    SELECT feed_id, route_id, direction_id, min(row_num) AS first_row,
           row_number() OVER (PARTITION BY feed_id ORDER BY min(row_num)) AS ordinal
    FROM a_trips GROUP BY feed_id, route_id, direction_id
    """,
)
def trip_ordinals(spark, sf):
    """WN-03 / WN-06: ordinals over reduced rows, numbered per feed without a
    single-partition window."""
    t = A.a_trips(spark, sf)
    firsts = t.groupBy("feed_id", "route_id", "direction_id").agg(F.min("row_num").alias("first_row"))
    return ordered.dense_ordinal(firsts, ["feed_id"], ["first_row"], "ordinal")
