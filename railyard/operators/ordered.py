"""Input-order operators: first/last row per key, duplicates, ordinals, top-N.

Design rules (scale):
* A key may be hot (a third of all rows). Per-key reductions therefore use
  aggregates with map-side partial aggregation (``min_by``/``max_by``/``min``),
  never a window partitioned by the key alone.
* Ordinals "per feed" are numbered with a range-partitioned sort and per-range
  offsets, so one huge feed is spread over many tasks. The sorted ranges are
  written once with the place of every row; what follows only adds an offset.
* Previous values, first values and positions within a group come from a window
  where a group is small enough for one task, else from an ordered scan over
  ranges that hands its state from range to range (``range_scan``), so one huge
  group is spread over many tasks too.
* Top-N per group runs in two salted phases, so a hot group is cut into
  ``salt`` slices before its final N are picked.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railyard.session import cut_lineage, materialise

ColLike = str | Column
#: Rows of one group that a single task may gather in a window.
GROUP_ROWS = 100_000
#: Hash slices whose sizes tell which groups may have more rows.
SLICES = 1 << 16
#: Rows of per-range totals that are sent to every task; more are joined by a shuffle.
SMALL_ROWS = 100_000


def _cols(cols: Sequence[ColLike]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def order_struct(order_cols: Sequence[str]) -> Column:
    """A struct that compares like the order key (lexicographic)."""
    return F.struct(*[F.col(c) for c in order_cols])


def first_per_key(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], last: bool = False) -> DataFrame:
    """WN-02 / WN-05: keep the first (or last) row of every key in input order.

    ``groupBy(keys).agg(min_by(struct(row), order))``: partial aggregation on
    the map side reduces a hot key to one candidate per input partition
    before the shuffle.
    """
    others = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    row = F.struct(*[F.col(c) for c in others])
    agg = df.groupBy(*keys).agg(pick(row, order_struct(order_cols)).alias("_row"))
    return agg.select(*keys, *[F.col("_row")[c].alias(c) for c in others]).select(*df.columns)


def by_group_size(df: DataFrame, part: Sequence[str], most: int = GROUP_ROWS) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows whose groups have at most ``most`` rows each, the other rows); None for no rows.

    Rows are counted by hash slice of the group (one small map-side aggregate):
    a group of more rows lies in a slice of more. The list of such slices is
    bounded by their number and by rows / ``most``. Groups that share a slice
    with a large one go with it; both kinds of path give the same rows."""
    piece = F.pmod(F.xxhash64(*part), F.lit(SLICES)) if part else F.lit(0).cast("long")
    full = [r[0] for r in df.select(piece.alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("s").collect()]
    if not full:
        return df, None
    return (df.where(~piece.isin(full)) if part and len(full) < SLICES else None), df.where(piece.isin(full))


def duplicates_after_first(
    df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], first_alias: str = "first_row", most: int = GROUP_ROWS
) -> DataFrame:
    """WN-09: every row of a key except its first, with the first row's order key.

    Keys of at most ``most`` rows are compared within one window (one shuffle).
    For the others, first occurrences come from a partial aggregate; joining
    them back is an equi-join on the key that AQE's skew-join handling can split
    (the aggregate side holds exactly one row per key). NULL keys never match.
    """
    place = order_struct(order_cols)
    columns = [*keys, *[c for c in df.columns if c not in keys]]
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keys])
    small, large = by_group_size(df.where(known), keys, most)
    found = []
    if small is not None:
        found.append(small.select(*columns, F.min(place).over(Window.partitionBy(*keys)).alias(first_alias)))
    if large is not None:
        firsts = large.groupBy(*keys).agg(F.min(place).alias(first_alias))
        found.append(large.join(firsts, on=list(keys), how="inner").select(*columns, first_alias))
    return reduce(DataFrame.unionByName, found).where(place > F.col(first_alias))


def range_scan(
    df: DataFrame,
    part: Sequence[str],
    order_cols: Sequence[str],
    lag: Mapping[str, str] | None = None,
    first: Mapping[str, str] | None = None,
    index: str | None = None,
    num_ranges: int | None = None,
) -> DataFrame:
    """``lag``, ``first_value`` and ``row_number`` over (part, order) for groups of any size.

    ``lag`` and ``first`` map a new column to the column it reads; ``index``
    names the 1-based position. Groups of at most ``GROUP_ROWS`` rows go through
    Spark's own window; the rows of larger ones (all rows if ``num_ranges`` is
    given) are range-partitioned by (part, order) and scanned range by range.
    The state that a group hands on — its last row, its
    first row, its rows so far — is needed only where a range begins inside a
    group: at most one row per range, which is the bound of the broadcast.
    ``order_cols`` should be unique within ``part``; NULL keys form one group.
    The ranges are checkpointed once, because their bounds are sampled.
    """
    lag, first = dict(lag or {}), dict(first or {})
    if num_ranges is None:
        small, large = by_group_size(df, part)
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        done = [] if large is None else [range_scan(large, part, order_cols, lag, first, index, n)]
        if small is not None:
            w = Window.partitionBy(*part).orderBy(*order_cols)
            done.append(small.select("*", *[F.lag(c).over(w).alias(k) for k, c in lag.items()], *[F.first(c).over(w).alias(k) for k, c in first.items()],
                                     *([F.row_number().over(w).cast("long").alias(index)] if index else [])))
        return reduce(DataFrame.unionByName, done)
    n = num_ranges
    ranged = df.repartitionByRange(n, *[F.col(c) for c in [*part, *order_cols]]).withColumn("__rng", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    w = Window.partitionBy("__rng", *part).orderBy(*order_cols)
    local = ranged.select("*", F.row_number().over(w).alias("__at"), *[F.lag(c).over(w).alias(f"__lag_{k}") for k, c in lag.items()],
                          *[F.first(c).over(w).alias(f"__first_{k}") for k, c in first.items()])
    # per (range, group): rows, last row, first row; of these only groups that go on are carried
    order = order_struct(order_cols)
    seen = ranged.groupBy("__rng", *part).agg(
        F.count(F.lit(1)).alias("__n"), F.max_by(F.struct(F.lit(0).alias("_"), *[F.col(c).alias(k) for k, c in lag.items()]), order).alias("__last"),
        F.min_by(F.struct(F.lit(0).alias("_"), *[F.col(c).alias(k) for k, c in first.items()]), order).alias("__head"))
    back = Window.partitionBy(*part).orderBy("__rng")
    carried = seen.select(F.col("__rng").alias("__r"), *[F.col(c).alias(f"__p{i}") for i, c in enumerate(part)],
                          F.sum("__n").over(back.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"),
                          F.lag("__last").over(back).alias("__last"), F.first("__head").over(back).alias("__head")).where("__before is not null")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__p{i}")) for i, c in enumerate(part)], F.col("__rng") == F.col("__r"))
    out = local.join(F.broadcast(carried), same, "left")
    goes_on = F.col("__before").isNotNull()
    added = [F.when((F.col("__at") == 1) & goes_on, F.col("__last")[k]).otherwise(F.col(f"__lag_{k}")).alias(k) for k in lag]
    added += [F.when(goes_on, F.col("__head")[k]).otherwise(F.col(f"__first_{k}")).alias(k) for k in first]
    if index:
        added.append((F.col("__at") + F.coalesce("__before", F.lit(0))).cast("long").alias(index))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *added)


def lag_over(df: DataFrame, part: Sequence[str], order_cols: Sequence[str], col: str, name: str) -> DataFrame:
    """WN-01: previous value of ``col`` within ``part`` in input order, whatever
    the size of a group (a blank id may hold most rows of a feed)."""
    return range_scan(df, part, order_cols, lag={name: col})


def dense_ordinal(
    df: DataFrame,
    part: Sequence[str],
    order_cols: Sequence[str],
    name: str = "ordinal",
    num_ranges: int | None = None,
    after: DataFrame | None = None,
) -> DataFrame:
    """1-based ordinal of each row within ``part`` by ``order_cols`` (unique in ``part``).

    Rows are range-partitioned and sorted by (part, order) and written once with
    their place in the range (bounds come from sampling, so two evaluations may
    cut differently). An ordinal is that place plus an offset from the rows of
    each (range, part): no further shuffle or sort of the rows.

    ``after`` (part and one number a row) gives what the ordinals of a part go
    on from; it is added to the offsets, so no join gathers the rows of a part."""
    n = num_ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in [*part, *order_cols]]
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    ranged = ranged.select("*", F.spark_partition_id().alias("__rng"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__pos"))
    ranged = cut_lineage(ranged) if "void" in df.schema.simpleString() else materialise(ranged)
    totals = cut_lineage(ranged.groupBy("__rng", *part).agg(F.count(F.lit(1)).alias("__n"), F.min("__pos").alias("__from")))
    before = Window.partitionBy(*part).orderBy("__rng").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__rng", *part, (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__from") + 1).alias("__off"))
    if after is not None:
        start = next(c for c in after.columns if c not in part)
        offsets = offsets.join(after, list(part), "left").select("__rng", *part, (F.col("__off") + F.coalesce(start, F.lit(0))).alias("__off"))
    if totals.count() <= SMALL_ROWS:
        offsets = F.broadcast(offsets)
    out = ranged.join(offsets, on=["__rng", *part], how="inner")
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c != name], (F.col("__off") + F.col("__pos")).cast("long").alias(name))


def running_total(
    df: DataFrame,
    part: Sequence[str],
    order_cols: Sequence[str],
    weight: Column,
    name: str,
    num_ranges: int | None = None,
) -> DataFrame:
    """Sum of ``weight`` over the rows of ``part`` up to and with each row, by ``order_cols``.

    The rows must already be reduced (one per entity) and ``order_cols`` must
    be unique within ``part``. Rows are range-partitioned by (part, order), so
    a single huge feed spans many ranges. Each range sums its rows locally;
    the per-range totals (one small row per range and feed) give the offsets.
    The ranged rows are checkpointed once (reliable checkpoint in the shared
    ``spark.checkpoint.dir``), which also cuts the lineage.
    """
    spark = df.sparkSession
    n = num_ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*part, *order_cols]
    ranged = df.withColumn("__w", weight.cast("long")).repartitionByRange(n, *[F.col(c) for c in keys]).withColumn("__rng", F.spark_partition_id())
    # Range bounds come from sampling whose seed depends on the RDD, so two
    # evaluations may cut differently: materialise the ranges exactly once.
    ranged = cut_lineage(ranged)
    local_w = Window.partitionBy("__rng", *part).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumn("__loc", F.sum("__w").over(local_w))
    totals = ranged.groupBy("__rng", *part).agg(F.sum("__w").alias("__sum"))
    # one row per (range, feed); the summed rows are partitioned by these keys already
    offs_w = Window.partitionBy(*part).orderBy("__rng").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("__off", F.coalesce(F.sum("__sum").over(offs_w), F.lit(0))).drop("__sum")
    out = local.join(offsets, on=["__rng", *part], how="inner")
    return out.withColumn(name, (F.col("__off") + F.col("__loc")).cast("long")).drop("__rng", "__loc", "__off", "__w")


def top_n_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order_cols: Sequence[ColLike],
    n: int,
    rank_name: str = "rank",
    salt: int | None = None,
) -> DataFrame:
    """WN-07: the first ``n`` rows per group by ``order_cols`` (must break ties).

    Phase 1 ranks inside (group, salt) slices and keeps ``n`` per slice; phase 2
    ranks at most ``salt * n`` candidates per group. The number of slices is
    that of the shuffle partitions unless given.
    """
    salt = salt or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    oc = _cols(order_cols)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salt)))
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*oc)
    cand = salted.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= n).drop("_r1", "_salt")
    w2 = Window.partitionBy(*keys).orderBy(*oc)
    return cand.withColumn(rank_name, F.row_number().over(w2)).where(F.col(rank_name) <= n)
