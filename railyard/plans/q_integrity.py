"""Queries over the GTFS store contract: orphans, references, load, upsert, delete."""

from __future__ import annotations

from pyspark.sql import functions as F

from railyard import catalog
from railyard.operators import joins
from railyard.plans import adapters as A
from railyard.plans.registry import register


def _orphan_feed(spark, sf):
    """A feed with a seeded fault: the trips of fulfilled orders carry another
    key, so the lines of those orders are orphan stop_times. Every row of every
    table stays in."""
    trips = A.a_trips(spark, sf).withColumn(
        "trip_id", F.when(F.col("trip_status") == "F", -F.col("trip_id")).otherwise(F.col("trip_id")))
    return {
        "agency": A.a_agency(spark, sf),
        "routes": A.a_routes(spark, sf),
        "trips": trips,
        "stop_times": A.a_stop_times(spark, sf),
        "stops": A.a_stops(spark, sf),
    }


@register(
    "fk_orphans",
    sql="""
    SELECT feed_id, 'routes' AS table_name, CAST(agency_id AS VARCHAR) AS record_id, 'orphaned_fk' AS violation_type,
           'routes.agency_id=''' || CAST(agency_id AS VARCHAR) || ''' has no matching agency.agency_id' AS detail
    FROM (SELECT DISTINCT feed_id, agency_id FROM a_routes r WHERE agency_id IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM a_agency a WHERE a.feed_id = r.feed_id AND a.agency_id = r.agency_id))
    UNION ALL
    SELECT feed_id, 'trips', CAST(route_id AS VARCHAR), 'orphaned_fk',
           'trips.route_id=''' || CAST(route_id AS VARCHAR) || ''' has no matching routes.route_id'
    FROM (SELECT DISTINCT feed_id, route_id FROM a_trips t WHERE route_id IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM a_routes r WHERE r.feed_id = t.feed_id AND r.route_id = t.route_id))
    UNION ALL
    SELECT feed_id, 'stop_times', CAST(trip_id AS VARCHAR), 'orphaned_fk',
           'stop_times.trip_id=''' || CAST(trip_id AS VARCHAR) || ''' has no matching trips.trip_id'
    FROM (SELECT DISTINCT feed_id, trip_id FROM a_stop_times s WHERE trip_id IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM a_trips t WHERE t.feed_id = s.feed_id
                          AND CASE WHEN t.trip_status = 'F' THEN -t.trip_id ELSE t.trip_id END = s.trip_id))
    UNION ALL
    SELECT feed_id, 'stop_times', CAST(stop_id AS VARCHAR), 'orphaned_fk',
           'stop_times.stop_id=''' || CAST(stop_id AS VARCHAR) || ''' has no matching stops.stop_id'
    FROM (SELECT DISTINCT feed_id, stop_id FROM a_stop_times s WHERE stop_id IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM a_stops p WHERE p.feed_id = s.feed_id AND p.stop_id = s.stop_id))
    """,
)
def fk_orphans(spark, sf):
    return joins.fk_orphans(_orphan_feed(spark, sf), catalog.FK_EDGES)
