"""GTFS store catalogue: table names, keys, FK edges, orders, score groups.

Fixed values: these must equal the GTFS store contract for results to match,
so they are stated plainly, in natural order, together.
"""

from __future__ import annotations

from railyard.operators.joins import FkEdge

# --- fixed values: table registry and primary keys --------------------------
PRIMARY_KEYS: dict[str, list[str]] = {
    "agency": ["agency_id"],
    "stops": ["stop_id"],
    "routes": ["route_id"],
    "trips": ["trip_id"],
    "stop_times": ["trip_id", "stop_sequence"],
    "calendar": ["service_id"],
    "calendar_dates": ["service_id", "date"],
    "shapes": ["shape_id", "shape_pt_sequence"],
    "frequencies": ["trip_id", "start_time"],
    "transfers": ["from_stop_id", "to_stop_id"],
    "feed_info": [],
    "board_alight": ["trip_id", "stop_id", "stop_sequence"],
    "ridership": [],
    "ride_feed_info": [],
    "trip_capacity": ["trip_id", "service_date"],
}
TABLES: list[str] = list(PRIMARY_KEYS)

# --- fixed values: foreign keys enforced by the store -----------------------
FK_EDGES: list[FkEdge] = [
    FkEdge("routes", "agency_id", "agency", "agency_id"),
    FkEdge("trips", "route_id", "routes", "route_id"),
    FkEdge("stop_times", "trip_id", "trips", "trip_id"),
    FkEdge("stop_times", "stop_id", "stops", "stop_id"),
    FkEdge("frequencies", "trip_id", "trips", "trip_id"),
    FkEdge("transfers", "from_stop_id", "stops", "stop_id"),
    FkEdge("transfers", "to_stop_id", "stops", "stop_id"),
    FkEdge("board_alight", "trip_id", "trips", "trip_id"),
    FkEdge("board_alight", "stop_id", "stops", "stop_id"),
    FkEdge("trip_capacity", "trip_id", "trips", "trip_id"),
]

# --- fixed values: parent-before-child insert order --------------------------
INSERT_ORDER: list[str] = [
    "agency", "feed_info", "calendar", "calendar_dates", "shapes", "stops", "routes", "trips",
    "frequencies", "transfers", "stop_times", "ride_feed_info", "trip_capacity", "board_alight", "ridership",
]

# --- fixed values: child-before-parent clear order ---------------------------
CLEAR_ORDER: list[str] = [
    "board_alight", "ridership", "trip_capacity", "stop_times", "frequencies", "transfers", "trips",
    "routes", "shapes", "calendar_dates", "calendar", "stops", "agency", "feed_info", "ride_feed_info",
]

# --- fixed values: export order and completeness groups ----------------------
EXPORT_ORDER: list[str] = [
    "agency", "stops", "routes", "trips", "stop_times", "calendar", "calendar_dates",
    "feed_info", "shapes", "frequencies", "transfers",
    "board_alight", "ridership", "ride_feed_info", "trip_capacity",
]
REQUIRED_TABLES: list[str] = ["agency", "stops", "routes", "trips", "stop_times"]
CALENDAR_TABLES: list[str] = ["calendar", "calendar_dates"]
RECOMMENDED_TABLES: list[str] = ["feed_info", "shapes"]
OPTIONAL_TABLES: list[str] = ["frequencies", "transfers"]
RIDE_TABLES: list[str] = ["board_alight", "ridership", "ride_feed_info", "trip_capacity"]
WEIGHT_REQUIRED = 60.0
WEIGHT_RECOMMENDED = 25.0
WEIGHT_OPTIONAL = 15.0

# --- fixed values: validator file rules ---------------------------------------
REQUIRED_FILES: list[str] = ["agency.txt", "stops.txt", "routes.txt", "trips.txt", "stop_times.txt"]
CALENDAR_FILES: list[str] = ["calendar.txt", "calendar_dates.txt"]
REQUIRED_FIELDS: dict[str, list[str]] = {
    "agency.txt": ["agency_name", "agency_url", "agency_timezone"],
    "stops.txt": ["stop_id"],
    "routes.txt": ["route_id", "route_type"],
    "trips.txt": ["route_id", "service_id", "trip_id"],
    "stop_times.txt": ["trip_id", "stop_sequence"],
    "calendar.txt": ["service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday",
                     "sunday", "start_date", "end_date"],
    "calendar_dates.txt": ["service_id", "date", "exception_type"],
}
VALIDATOR_PRIMARY_KEYS: dict[str, list[str]] = {
    "agency.txt": ["agency_id"],
    "stops.txt": ["stop_id"],
    "routes.txt": ["route_id"],
    "trips.txt": ["trip_id"],
    "stop_times.txt": ["trip_id", "stop_sequence"],
    "calendar.txt": ["service_id"],
    "calendar_dates.txt": ["service_id", "date"],
}
VALID_ROUTE_TYPES: list[int] = [0, 1, 2, 3, 4, 5, 6, 7, 11, 12]
TIME_PATTERN = r"^\d{1,2}:\d{2}:\d{2}$"
DATE_PATTERN = r"^\d{8}$"
COLOR_PATTERN = r"^[0-9A-Fa-f]{6}$"
