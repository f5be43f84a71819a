"""Join operators: orphans, FK-enforced load, upsert, delete, as-of join.

Every key includes ``feed_id``. Parents are never hand-broadcast: their size
grows with the data, so Spark's planner decides (AQE converts a join to a
broadcast only when the measured size is under the threshold, and splits
skewed partitions otherwise).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railyard.session import cut_lineage

FEED = "feed_id"


@dataclass(frozen=True)
class FkEdge:
    table: str
    column: str
    ref_table: str
    ref_column: str


def _text(c: Column) -> Column:
    return c.cast("string")


# ---------------------------------------------------------------------------
# JN-07 orphan check
# ---------------------------------------------------------------------------

def fk_orphans(tables: Mapping[str, DataFrame], edges: Sequence[FkEdge]) -> DataFrame:
    """Distinct orphan FK values per edge (IntegrityViolation rows).

    Edges whose child table is absent are skipped; when the parent table has
    no rows in a feed the message says so (as the reference does).
    """
    frames = []
    for e in edges:
        child, parent = tables.get(e.table), tables.get(e.ref_table)
        if child is None:
            continue
        keys = child.where(F.col(e.column).isNotNull()).select(FEED, F.col(e.column).alias("_fk")).distinct()
        if parent is None:
            orphans = keys.withColumn("_parent_rows", F.lit(False))
        else:
            pkeys = parent.select(FEED, F.col(e.ref_column).alias("_fk"))
            orphans = keys.join(pkeys, on=[FEED, "_fk"], how="left_anti")
            present = parent.select(FEED).distinct().withColumn("_parent_rows", F.lit(True))
            orphans = orphans.join(present, on=FEED, how="left")
        val = _text(F.col("_fk"))
        empty_msg = F.concat(
            F.lit(f"{e.table}.{e.column}='"), val,
            F.lit(f"' references {e.ref_table}.{e.ref_column} but {e.ref_table} is empty"),
        )
        missing_msg = F.concat(
            F.lit(f"{e.table}.{e.column}='"), val, F.lit(f"' has no matching {e.ref_table}.{e.ref_column}")
        )
        frames.append(
            orphans.select(
                FEED,
                F.lit(e.table).alias("table_name"),
                val.alias("record_id"),
                F.lit("orphaned_fk").alias("violation_type"),
                F.when(F.col("_parent_rows").isNull(), empty_msg).otherwise(missing_msg).alias("detail"),
            )
        )
    return _union_all(frames)


def _union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# ---------------------------------------------------------------------------
# JN-08 validator references (row level)
# ---------------------------------------------------------------------------

def missing_references(
    child: DataFrame,
    column: str,
    parents: Sequence[tuple[DataFrame, str]],
    file: str,
    row_col: str,
    message: str,
) -> DataFrame:
    """Rows of ``child`` whose non-empty ``column`` is in none of ``parents``
    (an id of blanks only is not empty).

    ``message`` is a format with one ``%s`` for the value. The parent key sets
    are unioned first (SO-01), then one anti join keeps the rows.
    """
    keys = None
    for df, col in parents:
        k = df.select(FEED, _text(F.col(col)).alias("_ref"))
        keys = k if keys is None else keys.unionByName(k)
    val = _text(F.col(column))
    rows = child.where(val.isNotNull() & (val != "")).withColumn("_ref", val)
    bad = rows.join(keys, on=[FEED, "_ref"], how="left_anti")
    return bad.select(
        FEED,
        F.lit("error").alias("severity"),
        F.lit(file).alias("file_name"),
        F.lit(column).alias("field"),
        F.col(row_col).cast("long").alias("row_index"),
        F.format_string(message, F.col("_ref")).alias("message"),
    )


# ---------------------------------------------------------------------------
# JN-09 FK-enforced load
# ---------------------------------------------------------------------------

def fk_enforced_load(
    new_tables: Mapping[str, DataFrame],
    edges: Sequence[FkEdge],
    order: Sequence[str],
    store: Mapping[str, DataFrame] | None = None,
    materialize=None,
) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Accept rows whose every non-NULL FK exists in the parent (store ∪ accepted).

    Tables are visited parent-first (``order``), so children of rejected
    parents are rejected too. Returns (accepted, rejected) per table; rejected
    rows carry ``error`` text. ``materialize`` (e.g. a reliable checkpoint)
    is applied to each accepted table before its children refer to it, so
    a child's plan never re-derives its parents.
    """
    store = store or {}
    accepted: dict[str, DataFrame] = {}
    rejected: dict[str, DataFrame] = {}
    for name in order:
        df = new_tables.get(name)
        if df is None:
            continue
        cols = df.columns
        flagged = df
        fails = []
        for i, e in enumerate([e for e in edges if e.table == name]):
            parent_frames = [f for f in (store.get(e.ref_table), accepted.get(e.ref_table)) if f is not None]
            hit = f"_hit{i}"
            fk = F.col(e.column)
            if parent_frames:
                pk = None
                for p in parent_frames:
                    k = p.select(F.col(FEED).alias("_pf"), F.col(e.ref_column).alias("_pk"))
                    pk = k if pk is None else pk.unionByName(k)
                # one left join per edge against the distinct parent keys: keeps every row once
                pk = pk.distinct().withColumn(hit, F.lit(True))
                flagged = flagged.join(pk, (flagged[FEED] == pk["_pf"]) & (fk == pk["_pk"]), "left").drop("_pf", "_pk")
            else:
                flagged = flagged.withColumn(hit, F.lit(None).cast("boolean"))
            fails.append((fk.isNotNull() & F.col(hit).isNull(), f"FOREIGN KEY constraint failed: {e.column}"))
        if materialize is not None and fails:
            flagged = materialize(flagged)
        failed = F.lit(False)
        for cond, _ in fails:
            failed = failed | cond
        error = F.coalesce(*[F.when(cond, F.lit(msg)) for cond, msg in fails], F.lit(None).cast("string")) \
            if fails else F.lit(None).cast("string")
        ok = flagged.where(~failed).select(*cols)
        is_parent = any(e.ref_table == name for e in edges)
        accepted[name] = materialize(ok) if (materialize is not None and not fails and is_parent) else ok
        rejected[name] = flagged.where(failed).select(*cols, error.alias("error"))
    return accepted, rejected


def load_counts(accepted: Mapping[str, DataFrame], rejected: Mapping[str, DataFrame]) -> DataFrame:
    """AG-21: inserted / failed per (feed, table) as one distributed aggregate."""
    parts = []
    for name, df in accepted.items():
        parts.append(df.select(FEED, F.lit(name).alias("table_name"), F.lit(True).alias("_ok")))
    for name, df in rejected.items():
        parts.append(df.select(FEED, F.lit(name).alias("table_name"), F.lit(False).alias("_ok")))
    u = _union_all(parts)
    return u.groupBy(FEED, "table_name").agg(
        F.count_if(F.col("_ok")).alias("inserted"),
        F.count_if(~F.col("_ok")).alias("failed"),
    )


# ---------------------------------------------------------------------------
# JN-10 upsert / JN-11 delete
# ---------------------------------------------------------------------------

def upsert(
    old: DataFrame,
    new: DataFrame,
    pk: Sequence[str],
    order_cols: Sequence[str],
    null_keys: str = "distinct",
) -> DataFrame:
    """REPLACE semantics: the last new row of a key replaces every old row of it.

    ``null_keys="distinct"`` (SQLite's rule): a row with a NULL key part never
    conflicts and is always appended. ``"equal"`` treats NULLs as equal.
    Tables without a PK append. ``order_cols`` give the input order of ``new``;
    ``old`` has one row per key, as every stored table.
    """
    cols = old.columns
    new = new.select(*cols, *[c for c in order_cols if c not in cols])
    if not pk:
        return old.unionByName(new.select(*cols))
    keys = [FEED, *pk]
    others = [c for c in cols if c not in keys]
    both = old.select(*cols, F.lit(0).alias("_new"), *[F.lit(None).cast(new.schema[c].dataType).alias(f"_o{i}") for i, c in enumerate(order_cols)])
    both = both.unionByName(new.select(*cols, F.lit(1).alias("_new"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)]))
    loose = None
    if null_keys == "distinct":
        has_null = F.lit(False)
        for k in pk:
            has_null = has_null | F.col(k).isNull()
        both, loose = both.where(~has_null), both.where(has_null).select(*cols)
    # one aggregate over old and new rows: of a key the last new row stays, else the old one
    age = F.struct("_new", *[f"_o{i}" for i in range(len(order_cols))])
    picked = both.groupBy(*keys).agg(F.max_by(F.struct(F.lit(1).alias("_x"), *others), age).alias("_row"))
    out = picked.select(*keys, *[F.col("_row")[c].alias(c) for c in others]).select(*cols)
    return out if loose is None else out.unionByName(loose)


def split_key_text(keys_text: DataFrame, text_col: str, pk: Sequence[str], types: Mapping[str, str]) -> DataFrame:
    """SC-22: composite key text ``a|b`` to typed key columns."""
    parts = F.split(F.col(text_col), r"\|")
    return keys_text.select(
        FEED,
        *[F.try_element_at(parts, F.lit(i + 1)).try_cast(types[k]).alias(k) for i, k in enumerate(pk)],
    )


def delete_keys(df: DataFrame, keys: DataFrame, pk: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """JN-11: (remaining rows, deleted rows) for a frame of keys."""
    on = [FEED, *pk]
    k = keys.select(*on).distinct()
    return df.join(k, on=on, how="left_anti"), df.join(k, on=on, how="left_semi")


# ---------------------------------------------------------------------------
# JN-01 as-of join (forward, fall back to the last observation)
# ---------------------------------------------------------------------------

def as_of_forward(
    left: DataFrame,
    right: DataFrame,
    ts: str,
    measures: Sequence[str],
    right_ts: str | None = None,
) -> DataFrame:
    """For every left row the first right row with ``right.ts >= left.ts``;
    left rows after the last right row take the last one. Keyed by feed only.
    A left row without an instant takes the last one too.

    Plan: both sides are united and range-partitioned by (feed, instant), so a
    busy feed, day or instant is spread over many ranges. Each range finds the
    next observation inside itself in one ordered pass; the first observation
    of each range (one small row per range and feed) is carried back over the
    ranges before it. The work is that of one sort: no pairs, no day join. The
    ranges are checkpointed once, because their bounds are sampled.
    """
    rts = right_ts or ts
    no_row = F.lit(None).cast(left.select(F.struct(*left.columns).alias("r")).schema["r"].dataType)
    obs = (right.groupBy(FEED, F.col(rts).alias("_ts")).agg(F.min(F.struct(*measures)).alias("_m"))
           .where(F.col("_ts").isNotNull()).withColumn("_obs", F.struct("_ts", "_m")))
    rows = left.select(FEED, F.col(ts).alias("_ts"), F.struct(*left.columns).alias("_row"))
    no_obs = F.lit(None).cast(obs.schema["_obs"].dataType)
    # at one instant left rows come first, spread by a hash of the row; then the observation
    united = rows.select(FEED, "_ts", F.lit(0).alias("_side"), F.xxhash64("_row").alias("_tie"), "_row", no_obs.alias("_obs"))
    united = united.unionByName(obs.select(FEED, "_ts", F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_tie"),
                                           no_row.alias("_row"), "_obs"))
    order = [F.col(FEED), F.col("_ts").asc_nulls_last(), F.col("_side"), F.col("_tie")]
    ranged = cut_lineage(united.repartitionByRange(*order).withColumn("_rng", F.spark_partition_id()))
    backwards = (Window.partitionBy("_rng", FEED).orderBy(F.col("_ts").desc_nulls_first(), F.col("_side").desc(), F.col("_tie").desc())
                 .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = ranged.withColumn("_next", F.last("_obs", ignorenulls=True).over(backwards)).where(F.col("_side") == 0)
    # one row per (range, feed): the first observation of a later range, else the feed's last one
    heads = ranged.groupBy("_rng", FEED).agg(F.min("_obs").alias("_first"), F.max("_obs").alias("_last"))
    later = Window.partitionBy(FEED).orderBy(F.col("_rng").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = heads.select("_rng", FEED, F.coalesce(F.last("_first", ignorenulls=True).over(later),
                                                    F.max("_last").over(Window.partitionBy(FEED))).alias("_carry"))
    out = found.join(carried, ["_rng", FEED], "left")
    pick = F.when(F.col("_ts").isNotNull(), F.coalesce("_next", "_carry")).otherwise(F.col("_carry"))
    out = out.select("_row", pick.alias("_pick"))
    return out.select("_row.*", *[F.col(f"_pick._m.{m}").alias(m) for m in measures])


def fallback_lookup(
    df: DataFrame,
    exact: DataFrame,
    exact_keys: Sequence[str],
    fallback: DataFrame,
    fallback_keys: Sequence[str],
    value: str,
) -> DataFrame:
    """JN-05: value from ``exact`` on exact_keys, else from ``fallback``, else drop."""
    a = df.join(exact.select(FEED, *exact_keys, F.col(value).alias("_v1")), on=[FEED, *exact_keys], how="left")
    b = a.join(fallback.select(FEED, *fallback_keys, F.col(value).alias("_v2")), on=[FEED, *fallback_keys], how="left")
    return b.withColumn(value, F.coalesce("_v1", "_v2")).where(F.col(value).isNotNull()).drop("_v1", "_v2")
