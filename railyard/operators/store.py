"""GTFS store on Parquet: one partition per feed, import modes, gates, counts, paging.

Layout: ``<root>/<table>/feed_id=<f>/batch=<b>/part-*.parquet``, plain Spark
tables written with dynamic partition overwrite: a load rewrites the partitions
of the feeds it brings and no others, and any read or write error rises. Tables
with a primary key keep one batch per feed; tables without one keep the rows of
every batch, so that a batch loaded again replaces its own rows. Each table is
switched by Spark's own commit; a load that fails between two tables is
repeated as a whole, with the same result. Where several tables must switch as
one, put the folders under a table format of the cluster.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railyard import catalog, schemas
from railyard.operators import joins, ordered
from railyard.session import cut_lineage, materialise, written

FEED = "feed_id"
ROW_ORDER = "row_order"
MODES = ("replace", "merge", "merge_partial", "abort_if_not_empty")


# --- gates (SL-07) -----------------------------------------------------------------
def import_gate(feeds: DataFrame, members: DataFrame) -> DataFrame:
    """Per feed: accept or refuse an archive for the requested mode.

    ``feeds``: (feed_id, mode, store_populated); ``members``: (feed_id,
    table_name) of the archive's recognised tables. Output adds
    ``reject_reason`` (NULL = accepted) and ``missing``.
    """
    has = {t: F.max(F.col("table_name") == t) for t in catalog.REQUIRED_TABLES}
    m = members.groupBy(FEED).agg(
        F.count(F.lit(1)).alias("n_members"),
        *[v.alias(f"_has_{t}") for t, v in has.items()],
        F.max(F.col("table_name").isin(*catalog.CALENDAR_TABLES)).alias("_has_cal"),
    )
    g = feeds.join(m, FEED, "left")
    missing = F.array_join(F.array_compact(F.array(
        *[F.when(~F.coalesce(F.col(f"_has_{t}"), F.lit(False)), F.lit(t)) for t in catalog.REQUIRED_TABLES],
        F.when(~F.coalesce(F.col("_has_cal"), F.lit(False)), F.lit("calendar_or_calendar_dates")),
    )), ", ")
    n = F.coalesce(F.col("n_members"), F.lit(0))
    mode = F.col("mode")
    reason = (
        F.when((mode == "merge_partial") & (n == 0), F.lit("Archive contains no recognised GTFS files to merge."))
        .when((mode == "merge_partial") & ~F.col("store_populated"),
              F.lit("MERGE_PARTIAL requires an already-populated database. Use REPLACE or MERGE for the initial load."))
        .when((mode != "merge_partial") & (missing != ""),
              F.concat(F.lit("Archive is missing required GTFS files: "), missing))
        .when((mode == "abort_if_not_empty") & F.col("store_populated"),
              F.lit("Project database is not empty and mode=ABORT_IF_NOT_EMPTY"))
    )
    return g.select(*feeds.columns, missing.alias("missing"), reason.alias("reject_reason"))


# --- paging (SL-01) ------------------------------------------------------------------
#: Rows that one task may gather for a page.
TOP_K_ROWS = 100_000


def page(df: DataFrame, order: Sequence[str], limit: int, offset: int = 0) -> DataFrame:
    """``LIMIT/OFFSET`` in key order (``order`` is unique). Pages near the start
    are a top-k plan; for deeper ones the rows are numbered by range, so that no
    task gathers the rows before the page. The rows are the same either way."""
    if offset + limit <= TOP_K_ROWS:
        return df.orderBy(*order).offset(offset).limit(limit)
    numbered = ordered.dense_ordinal(df, [], list(order), "__place")
    return numbered.where(F.col("__place").between(offset + 1, offset + limit)).orderBy("__place").drop("__place")


# --- counts (AG-04 / AG-05) ----------------------------------------------------------------
def table_counts(tables: Mapping[str, DataFrame], feeds: DataFrame | None = None) -> DataFrame:
    """Rows per (feed, table) for every catalogue table, zeros included.

    One union of narrow ``(feed_id, table)`` projections and one aggregate;
    the zero rows come from the (feeds x fixed table list) expansion, done as
    an explode of a literal array rather than a join."""
    parts = [df.select(FEED, F.lit(name).alias("table_name")) for name, df in tables.items()]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    counted = u.groupBy(FEED, "table_name").agg(F.count(F.lit(1)).alias("records"))
    feed_ids = (feeds if feeds is not None else u.select(FEED)).select(FEED).distinct()
    grid = feed_ids.select(FEED, F.explode(F.array(*[F.lit(t) for t in catalog.TABLES])).alias("table_name"))
    return grid.join(counted, [FEED, "table_name"], "left").select(
        FEED, "table_name", F.coalesce("records", F.lit(0)).cast("long").alias("records"))


# --- row order and batches -----------------------------------------------------------------
def number_rows(new: DataFrame, stored: DataFrame) -> DataFrame:
    """``new`` (with ``row_num``, its input order) with ``row_order``: 1, 2, ..
    within the feed, after the highest number that ``stored`` has for it. Equal
    ``row_num`` (two files of one table) are told apart by a hash of the row."""
    data = [c for c in new.columns if c not in ("row_num", ROW_ORDER)]
    top = stored.groupBy(FEED).agg(F.max(ROW_ORDER).alias("__top"))
    numbered = ordered.dense_ordinal(new.select(*data, "row_num", F.xxhash64(*data).alias("__tie")), [FEED], ["row_num", "__tie"], ROW_ORDER, after=top)
    return numbered.select(*data, "row_num", ROW_ORDER)


def merge_rows(stored: DataFrame, new: DataFrame, pk: Sequence[str]) -> DataFrame:
    """The rows of a table with a key after ``new`` (with ``row_num``) is merged
    into ``stored`` (with ``row_order``): of a key the last new row stays, in its
    own place, else the stored one in its old place. Numbers go on from the rows
    that stay, so the same merge again gives the same numbers."""
    key = [FEED, *pk]
    staying = stored.select(*key, ROW_ORDER).join(new.select(*key).distinct(), key, "left_anti")
    return joins.upsert(stored, number_rows(new, staying), pk, [ROW_ORDER])


def content_batches(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feed_id, batch): a name per feed from the rows' ``columns``, whatever their order."""
    hashed = rows.select(FEED, *[F.xxhash64(F.lit(k), *columns).cast("decimal(20,0)").alias(f"_h{k}") for k in (1, 2)])
    sums = hashed.groupBy(FEED).agg(F.count(F.lit(1)).alias("_n"), F.sum("_h1").alias("_s1"), F.sum("_h2").alias("_s2"))
    return sums.select(FEED, F.substring(F.sha2(F.concat_ws(" ", "_n", "_s1", "_s2"), 256), 1, 32).alias("batch"))


# --- the store (SL-06) ------------------------------------------------------------------------
class GtfsStore:
    """GTFS tables partitioned by ``feed_id``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def read(self, table: str) -> DataFrame:
        """The rows of a table with their ``row_order`` (none before its first load)."""
        return self._stored(table).drop("batch")

    def _stored(self, table: str) -> DataFrame:
        schema = schemas.GTFS[table].struct().add(FEED, "string").add(ROW_ORDER, "long").add("batch", "string")
        if not self._present(table):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}").select(*schema.names)

    def page(self, table: str, limit: int, offset: int = 0) -> DataFrame:
        """SL-01: ``LIMIT/OFFSET`` over a table in stored order, feed after feed."""
        return page(self.read(table), [FEED, ROW_ORDER], limit, offset)

    def tables(self) -> dict[str, DataFrame]:
        return {t: self.read(t) for t in catalog.TABLES}

    def counts(self) -> DataFrame:
        """AG-04/05 over the store: the row counts in the footers of its files,
        summed by feed; no row is read. The counts (one row per feed and table)
        are written once, as they come from a session of their own settings."""
        side = self.spark.newSession()
        side.conf.set("spark.sql.sources.useV1SourceList", "")
        side.conf.set("spark.sql.parquet.aggregatePushdown", "true")
        stored = [self._footer_counts(side, t) for t in catalog.TABLES if self._present(t)]
        counted = self._handed_over(stored) if stored else self.spark.createDataFrame([], f"{FEED} string, table_name string, records long")
        grid = counted.select(FEED).distinct().select(FEED, F.explode(F.array(*[F.lit(t) for t in catalog.TABLES])).alias("table_name"))
        return grid.join(counted, [FEED, "table_name"], "left").select(FEED, "table_name", F.coalesce("records", F.lit(0)).cast("long").alias("records"))

    def _footer_counts(self, side: SparkSession, table: str) -> DataFrame:
        schema = schemas.GTFS[table].struct().add(ROW_ORDER, "long").add("batch", "string").add(FEED, "string")
        rows = side.read.schema(schema).parquet(f"{self.root}/{table}")
        per_folder = rows.groupBy(FEED, "batch").agg(F.count(F.lit(1)).alias("n"))  # by all partition columns, as push-down needs
        return per_folder.groupBy(FEED).agg(F.sum("n").alias("records")).select(FEED, F.lit(table).alias("table_name"), "records")

    def _handed_over(self, frames: Sequence[DataFrame]) -> DataFrame:
        """Small frames of another session as one frame of this one."""
        return self.spark.read.schema(frames[0].schema).parquet(written(joins._union_all(frames), self.spark))

    def _present(self, table: str) -> bool:
        from railyard.sources.tabular import path_exists

        return path_exists(self.spark, f"{self.root}/{table}/feed_id=*")

    def write(self, table: str, rows: DataFrame, batches: DataFrame | str = "all") -> None:
        """Replace the partitions of the feeds and batches (one name, or one per
        feed) that ``rows`` holds.

        A large feed is written by many tasks, many small ones by few."""
        cols = [*schemas.GTFS[table].names, FEED, ROW_ORDER]
        out = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in cols])
        out = out.withColumn("batch", F.lit(batches)) if isinstance(batches, str) else out.join(batches, FEED)
        (out.hint("rebalance", FEED).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(FEED, "batch").parquet(f"{self.root}/{table}"))

    def clear(self, table: str, feeds: DataFrame) -> None:
        """Drop the partitions of the given feeds (their folders, one file-system call each)."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for r in feeds.select(F.lit(table).alias("t"), FEED).distinct().toLocalIterator():
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}/feed_id={_escaped(self.spark, r[FEED])}")
            path.getFileSystem(conf).delete(path, True)

    def delete(self, table: str, keys: DataFrame) -> DataFrame:
        """JN-11: delete the rows of ``keys`` (feed_id and the primary key) and
        return the deleted count per feed. Only those feeds are rewritten."""
        if not catalog.PRIMARY_KEYS[table]:
            raise ValueError(f"{table} has no primary key")
        feeds = keys.select(FEED).distinct()
        current = self.read(table).join(feeds, FEED, "left_semi")
        remaining, deleted = joins.delete_keys(current, keys, list(catalog.PRIMARY_KEYS[table]))
        counts = materialise(deleted.groupBy(FEED).agg(F.count(F.lit(1)).alias("deleted")))
        remaining = materialise(remaining)
        emptied = materialise(counts.join(remaining.select(FEED).distinct(), FEED, "left_anti"))
        self.write(table, remaining)
        self.clear(table, emptied)
        return counts

    # import -------------------------------------------------------------------------
    def import_archives(self, path: str, mode: str = "merge") -> tuple[DataFrame, dict[str, DataFrame]]:
        """SRC-03 → SL-07 → load: parse every archive once, gate each feed for
        ``mode``, then load the accepted feeds' tables.
        Returns (gate rows, rejected rows per table)."""
        from railyard.sources import archive

        return self.import_rows(archive.scan_archives(self.spark, path), mode)

    def import_rows(self, parsed: DataFrame, mode: str = "merge", batch_id: str | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
        """Gate and load archive rows produced by ``archive.parse_files``. The
        rows are written once, by table, so that each table reads only its own.
        Tables without a key are filed under a hash of all rows of the feed's
        archive, or under ``batch_id``, whose earlier rows are then replaced."""
        from railyard.sources import archive

        rows = materialise(parsed, by="table_name")
        members = rows.where(F.col("table_name").isNotNull() & F.col("reject").isNull()).select(
            FEED, "table_name").distinct()
        populated = self.counts().groupBy(FEED).agg((F.sum("records") > 0).alias("store_populated"))
        feeds = rows.select(FEED).distinct().join(populated, FEED, "left").select(
            FEED, F.lit(mode).alias("mode"), F.coalesce("store_populated", F.lit(False)).alias("store_populated"))
        bad_archives = rows.where(F.col("reject").isNotNull() & F.col("member").isNull()).select(FEED).distinct()
        gate = materialise(import_gate(feeds, members))
        ok_feeds = gate.where(F.col("reject_reason").isNull()).select(FEED).join(bad_archives, FEED, "left_anti")
        present = [r.table_name for r in members.select("table_name").distinct().collect()]  # <= 15 names
        tables = {t: archive.table_rows(rows, t).join(ok_feeds, FEED, "left_semi") for t in present}
        batches = batch_id or content_batches(rows.where(F.col("reject").isNull()), ["table_name", "row_num", "keys", "vals"])
        rejected = self.load(tables, mode, batches) if tables else {}
        return gate, rejected

    def import_silver(self, datasets: Mapping[str, DataFrame], order_cols: Mapping[str, Sequence[str]],
                      batch_id: str | None = None, warning_limit: int = 20) -> tuple[DataFrame, DataFrame]:
        """AG-22: map the Silver datasets of the feeds, load the tables and report:
        (mapped and failed totals with the unmapped tables per feed, the first warnings)."""
        from railyard.operators import mapping

        mapped = {t: df.withColumn("row_num", F.monotonically_increasing_id()) for t, df in mapping.map_feed(datasets, order_cols).items()}
        mapped = {t: materialise(df) for t, df in mapped.items()}
        rejected = self.load(mapped, "merge", batch_id)
        stored = {t: df.join(rejected[t].select(FEED, "row_num"), [FEED, "row_num"], "left_anti") for t, df in mapped.items()}
        warnings = joins._union_all([df.select(FEED, F.concat_ws(" ", F.lit(t), F.col("row_num").cast("string")).alias("ordinal"), F.col("error").alias("message"))
                                     for t, df in rejected.items()])
        return mapping_report(stored, rejected, warnings, warning_limit)

    def load(self, new_tables: Mapping[str, DataFrame], mode: str = "merge", batches: DataFrame | str | None = None) -> dict[str, DataFrame]:
        """Apply a parsed feed (tables carry ``feed_id`` and ``row_num``).

        REPLACE clears the feeds being loaded first (SL-06); all modes then
        run the FK-enforced load parents-first (JN-09) and upsert by primary
        key (JN-10). Rows of tables without a key are added under ``batches``
        (a name per feed; by default a hash of what the feed brings), unless the
        feed has that batch already; a name given as text replaces its earlier
        rows. Returns the rejected rows per table; ``outcome`` counts."""
        if mode not in MODES:
            raise ValueError(mode)
        feeds = None
        for df in new_tables.values():
            feeds = df.select(FEED) if feeds is None else feeds.unionByName(df.select(FEED))
        feeds = materialise(feeds.distinct())
        current = {t: df.join(feeds, FEED, "left_semi") for t, df in self.tables().items()}
        before = {t: df.limit(0) for t, df in current.items()} if mode == "replace" else current
        # PRJ-08: type / range / pattern checks per row; failures never reach the store
        typed, invalid = {}, {}
        for name, df in new_tables.items():
            typed[name], invalid[name] = schemas.GTFS[name].validate(df, row_col="row_num", keep=[FEED])
        accepted, rejected = joins.fk_enforced_load(typed, catalog.FK_EDGES, catalog.INSERT_ORDER, before,
                                                    materialize=cut_lineage)
        for name, bad in invalid.items():
            errs = bad.select(FEED, "row_num", F.col("message").alias("error"))
            rej = rejected.get(name)
            rejected[name] = errs if rej is None else rej.select(FEED, "row_num", "error").unionByName(errs)
        rejected = {t: materialise(df.select(FEED, "row_num", "error")) for t, df in rejected.items()}
        if batches is None and not all(catalog.PRIMARY_KEYS[t] for t in new_tables):
            batches = content_batches(joins._union_all([
                df.select(FEED, F.lit(t).alias("t"), F.struct(*sorted(c for c in df.columns if c not in (FEED, "row_num"))).cast("string").alias("row"))
                for t, df in new_tables.items()]), ["t", "row"])
        if isinstance(batches, DataFrame):
            batches = materialise(batches)
        merged = {}
        for name, df in accepted.items():
            cols = [*schemas.GTFS[name].names, FEED]
            rows = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in cols],
                             *(["row_num"] if "row_num" in df.columns else []))
            if "row_num" not in rows.columns:
                rows = rows.withColumn("row_num", F.monotonically_increasing_id())
            pk = list(catalog.PRIMARY_KEYS[name])
            if not pk and isinstance(batches, DataFrame) and mode != "replace":
                held = self._stored(name).select(FEED, "batch").join(batches, [FEED, "batch"], "left_semi").select(FEED).distinct()
                rows = rows.join(held, FEED, "left_anti")
            # every table is whole before the first one is written
            staying = before[name] if pk or not isinstance(batches, str) or mode == "replace" else self._stored(name).where(F.col("batch") != batches)
            merged[name] = materialise(merge_rows(before[name], rows, pk) if pk else number_rows(rows, staying).drop("row_num"))
        self.outcome = materialise(_outcome(merged, rejected, current if mode == "replace" else {}, feeds))
        if mode == "replace":
            for t in catalog.CLEAR_ORDER:
                self.clear(t, feeds)
        for name in catalog.INSERT_ORDER:
            if name in merged:
                self.write(name, merged[name], "all" if catalog.PRIMARY_KEYS[name] else batches)
        return rejected


def _outcome(merged: Mapping[str, DataFrame], rejected: Mapping[str, DataFrame], cleared: Mapping[str, DataFrame],
             feeds: DataFrame) -> DataFrame:
    """AG-21: per feed and table — rows stored, failed and cleared, and whether the
    archive skipped the table (every catalogue table has a row)."""
    parts = []
    for kind, tables in (("stored", merged), ("failed", rejected), ("cleared", cleared)):
        parts += [df.select(FEED, F.lit(t).alias("table_name"), F.lit(kind).alias("kind")) for t, df in tables.items()]
    counts = joins._union_all(parts).groupBy(FEED, "table_name").agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("stored", "failed", "cleared")])
    grid = feeds.select(FEED, F.explode(F.array(*[F.lit(t) for t in catalog.TABLES])).alias("table_name"))
    out = grid.join(counts, [FEED, "table_name"], "left").na.fill(0, ["stored", "failed", "cleared"])
    return out.withColumn("skipped", ~F.col("table_name").isin(*merged))


def _escaped(spark: SparkSession, value: str) -> str:
    """A partition value as Spark writes it in a folder name."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


# --- feed loading and reports (SRC-12, AG-21, AG-22, SL-06) ----------------------------------
FEED_GATE_TABLES = ("agency", "stops", "routes", "trips")


def feed_from_store(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """SRC-12: the feeds whose agency, stops, routes and trips all have rows
    (a per-feed ``left_semi`` gate); empty tables simply have no rows."""
    counts = table_counts(tables)
    ok = counts.where(F.col("table_name").isin(*FEED_GATE_TABLES) & (F.col("records") > 0)).groupBy(FEED).agg(
        F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(FEED_GATE_TABLES)).select(FEED)
    return {t: df.join(ok, FEED, "left_semi") for t, df in tables.items()}


def error_samples(rejected: Mapping[str, DataFrame], limit: int = 50) -> DataFrame:
    """AG-21: the first ``limit`` error rows per (feed, table), in file order."""
    parts = [df.select(FEED, F.lit(t).alias("table_name"), "row_num", "error") for t, df in rejected.items()]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return ordered.top_n_per_group(u, [FEED, "table_name"], ["row_num", "error"], limit, "rank")


def mapping_report(mapped: Mapping[str, DataFrame], failed: Mapping[str, DataFrame], warnings: DataFrame,
                   limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """AG-22: per feed mapped / failed totals and unmapped tables (SO-03), plus
    the first ``limit`` warnings. ``warnings``: (feed_id, ordinal, message)."""
    m = table_counts(mapped)
    f = table_counts(failed) if failed else m.select(FEED, "table_name", F.lit(0).cast("long").alias("records"))
    joined = m.join(f.withColumnRenamed("records", "_failed"), [FEED, "table_name"], "left")
    totals = joined.groupBy(FEED).agg(
        F.sum("records").alias("mapped"), F.sum(F.coalesce("_failed", F.lit(0))).alias("failed"),
        F.array_sort(F.collect_list(F.when(F.col("records") == 0, F.col("table_name")))).alias("unmapped_tables"))
    first = ordered.top_n_per_group(warnings, [FEED], ["ordinal"], limit, "rank")
    return totals, first


def clear_tables(current: Mapping[str, DataFrame], feeds: DataFrame,
                 tables: Sequence[str] = tuple(catalog.CLEAR_ORDER)) -> tuple[dict[str, DataFrame], DataFrame]:
    """SL-06: remove the feeds' rows from ``tables`` (children first); returns
    the remaining tables and the deleted counts per (feed, table)."""
    keep, gone = {}, []
    for t in tables:
        if t not in current:
            continue
        keep[t] = current[t].join(feeds, FEED, "left_anti")
        gone.append(current[t].join(feeds, FEED, "left_semi").select(FEED, F.lit(t).alias("table_name")))
    deleted = gone[0]
    for g in gone[1:]:
        deleted = deleted.unionByName(g)
    return keep, deleted.groupBy(FEED, "table_name").agg(F.count(F.lit(1)).alias("deleted"))
