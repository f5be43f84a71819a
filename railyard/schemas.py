"""Schema catalogue: 12 upload schemas, 3 Gold schemas, 15 GTFS tables.

Fixed values: field names, kinds, requiredness, ranges and patterns follow the
public GTFS reference (and GTFS-ride) and the upload contract of the data
model; they are stated field by field, in natural order.
"""

from __future__ import annotations

from railyard.schema import Field, Schema

# --- fixed values: patterns and choices ------------------------------------------
GTFS_TIME = r"^\d{1,3}:\d{2}:\d{2}$"
GTFS_DATE = r"^\d{8}$"
HEX_COLOR = r"^[0-9A-Fa-f]{6}$"

TEMPORAL_RESOLUTIONS = ("15min", "30min", "hourly", "daily", "weekly", "monthly")
DAY_TYPES = ("weekday", "saturday", "sunday_holiday")
SEASONS = ("spring", "summer", "autumn", "winter")
ZONE_TYPES = ("urban", "suburban", "rural")
FARE_CATEGORIES = ("single_ticket", "monthly_pass", "student", "senior", "social", "free", "other")
EVENT_TYPES = ("holiday", "school_break", "strike", "weather", "special_event")

# --- fixed values: GTFS tables -------------------------------------------------
GTFS: dict[str, Schema] = {
    "agency": Schema("agency", (
        Field("agency_id", "str"),
        Field("agency_name", "str", required=True),
        Field("agency_url", "str", required=True),
        Field("agency_timezone", "str", required=True),
        Field("agency_lang", "str"),
        Field("agency_phone", "str"),
        Field("agency_fare_url", "str"),
        Field("agency_email", "str"),
    ), ("agency_id",)),
    "stops": Schema("stops", (
        Field("stop_id", "str", required=True),
        Field("stop_name", "str"),
        Field("stop_lat", "float", ge=-90, le=90),
        Field("stop_lon", "float", ge=-180, le=180),
        Field("stop_code", "str"),
        Field("stop_desc", "str"),
        Field("zone_id", "str"),
        Field("stop_url", "str"),
        Field("location_type", "int", ge=0, le=4),
        Field("parent_station", "str"),
        Field("stop_timezone", "str"),
        Field("wheelchair_boarding", "int", ge=0, le=2),
        Field("level_id", "str"),
        Field("platform_code", "str"),
    ), ("stop_id",)),
    "routes": Schema("routes", (
        Field("route_id", "str", required=True),
        Field("agency_id", "str"),
        Field("route_short_name", "str"),
        Field("route_long_name", "str"),
        Field("route_desc", "str"),
        Field("route_type", "int", required=True),
        Field("route_url", "str"),
        Field("route_color", "str", pattern=HEX_COLOR, pattern_label="route_color must be a 6-digit hex color"),
        Field("route_text_color", "str", pattern=HEX_COLOR, pattern_label="route_text_color must be a 6-digit hex color"),
        Field("route_sort_order", "int", ge=0),
        Field("continuous_pickup", "int", ge=0, le=3),
        Field("continuous_drop_off", "int", ge=0, le=3),
    ), ("route_id",)),
    "trips": Schema("trips", (
        Field("route_id", "str", required=True),
        Field("service_id", "str", required=True),
        Field("trip_id", "str", required=True),
        Field("trip_headsign", "str"),
        Field("trip_short_name", "str"),
        Field("direction_id", "int", ge=0, le=1),
        Field("block_id", "str"),
        Field("shape_id", "str"),
        Field("wheelchair_accessible", "int", ge=0, le=2),
        Field("bikes_allowed", "int", ge=0, le=2),
    ), ("trip_id",)),
    "stop_times": Schema("stop_times", (
        Field("trip_id", "str", required=True),
        Field("arrival_time", "str", pattern=GTFS_TIME, pattern_label="arrival_time must be in HH:MM:SS format"),
        Field("departure_time", "str", pattern=GTFS_TIME, pattern_label="departure_time must be in HH:MM:SS format"),
        Field("stop_id", "str", required=True),
        Field("stop_sequence", "int", required=True, ge=0),
        Field("stop_headsign", "str"),
        Field("pickup_type", "int", ge=0, le=3),
        Field("drop_off_type", "int", ge=0, le=3),
        Field("continuous_pickup", "int", ge=0, le=3),
        Field("continuous_drop_off", "int", ge=0, le=3),
        Field("shape_dist_traveled", "float", ge=0),
        Field("timepoint", "int", ge=0, le=1),
    ), ("trip_id", "stop_sequence")),
    "calendar": Schema("calendar", (
        Field("service_id", "str", required=True),
        Field("monday", "int", required=True, ge=0, le=1),
        Field("tuesday", "int", required=True, ge=0, le=1),
        Field("wednesday", "int", required=True, ge=0, le=1),
        Field("thursday", "int", required=True, ge=0, le=1),
        Field("friday", "int", required=True, ge=0, le=1),
        Field("saturday", "int", required=True, ge=0, le=1),
        Field("sunday", "int", required=True, ge=0, le=1),
        Field("start_date", "str", required=True, pattern=GTFS_DATE, pattern_label="start_date must be in YYYYMMDD format"),
        Field("end_date", "str", required=True, pattern=GTFS_DATE, pattern_label="end_date must be in YYYYMMDD format"),
    ), ("service_id",)),
    "calendar_dates": Schema("calendar_dates", (
        Field("service_id", "str", required=True),
        Field("date", "str", required=True, pattern=GTFS_DATE, pattern_label="date must be in YYYYMMDD format"),
        Field("exception_type", "int", required=True, ge=1, le=2),
    ), ("service_id", "date")),
    "shapes": Schema("shapes", (
        Field("shape_id", "str", required=True),
        Field("shape_pt_lat", "float", required=True, ge=-90, le=90),
        Field("shape_pt_lon", "float", required=True, ge=-180, le=180),
        Field("shape_pt_sequence", "int", required=True, ge=0),
        Field("shape_dist_traveled", "float", ge=0),
    ), ("shape_id", "shape_pt_sequence")),
    "frequencies": Schema("frequencies", (
        Field("trip_id", "str", required=True),
        Field("start_time", "str", required=True, pattern=GTFS_TIME, pattern_label="start_time must be in HH:MM:SS format"),
        Field("end_time", "str", required=True, pattern=GTFS_TIME, pattern_label="end_time must be in HH:MM:SS format"),
        Field("headway_secs", "int", required=True, gt=0),
        Field("exact_times", "int", ge=0, le=1),
    ), ("trip_id", "start_time")),
    "transfers": Schema("transfers", (
        Field("from_stop_id", "str", required=True),
        Field("to_stop_id", "str", required=True),
        Field("transfer_type", "int", required=True, ge=0, le=3),
        Field("min_transfer_time", "int", ge=0),
    ), ("from_stop_id", "to_stop_id")),
    "feed_info": Schema("feed_info", (
        Field("feed_publisher_name", "str", required=True),
        Field("feed_publisher_url", "str", required=True),
        Field("feed_lang", "str", required=True),
        Field("default_lang", "str"),
        Field("feed_start_date", "str", pattern=GTFS_DATE, pattern_label="feed_start_date must be in YYYYMMDD format"),
        Field("feed_end_date", "str", pattern=GTFS_DATE, pattern_label="feed_end_date must be in YYYYMMDD format"),
        Field("feed_version", "str"),
        Field("feed_contact_email", "str"),
        Field("feed_contact_url", "str"),
    )),
    "board_alight": Schema("board_alight", (
        Field("trip_id", "str", required=True),
        Field("stop_id", "str", required=True),
        Field("stop_sequence", "int", required=True, ge=0),
        Field("record_use", "int", required=True, ge=0, le=2),
        Field("schedule_relationship", "int", ge=0, le=2),
        Field("boardings", "int", ge=0),
        Field("alightings", "int", ge=0),
        Field("current_load", "int", ge=0),
        Field("load_count_method", "int", ge=0, le=2),
        Field("load_type", "int", ge=0, le=1),
        Field("rack_down", "int", ge=0, le=1),
        Field("bike_boardings", "int", ge=0),
        Field("bike_alightings", "int", ge=0),
        Field("ramp_used", "int", ge=0, le=1),
        Field("ramp_boardings", "int", ge=0),
        Field("ramp_alightings", "int", ge=0),
        Field("service_date", "str", pattern=GTFS_DATE, pattern_label="service_date must be in YYYYMMDD format"),
        Field("service_arrival_time", "str", pattern=GTFS_TIME, pattern_label="service_arrival_time must be in HH:MM:SS format"),
        Field("service_departure_time", "str", pattern=GTFS_TIME, pattern_label="service_departure_time must be in HH:MM:SS format"),
        Field("source", "str"),
    ), ("trip_id", "stop_id", "stop_sequence")),
    "ridership": Schema("ridership", (
        Field("total_boardings", "int", required=True, ge=0),
        Field("total_alightings", "int", required=True, ge=0),
        Field("ridership_start_date", "str", required=True, pattern=GTFS_DATE, pattern_label="ridership_start_date must be in YYYYMMDD format"),
        Field("ridership_end_date", "str", required=True, pattern=GTFS_DATE, pattern_label="ridership_end_date must be in YYYYMMDD format"),
        Field("service_id", "str"),
        Field("monday_through_sunday", "str"),
        Field("trip_id", "str"),
        Field("route_id", "str"),
        Field("direction_id", "int", ge=0, le=1),
        Field("stop_id", "str"),
    )),
    "ride_feed_info": Schema("ride_feed_info", (
        Field("ride_files", "str", required=True),
        Field("ride_start_date", "str", required=True, pattern=GTFS_DATE, pattern_label="ride_start_date must be in YYYYMMDD format"),
        Field("ride_end_date", "str", required=True, pattern=GTFS_DATE, pattern_label="ride_end_date must be in YYYYMMDD format"),
        Field("gtfs_feed_date", "str", pattern=GTFS_DATE, pattern_label="gtfs_feed_date must be in YYYYMMDD format"),
        Field("default_currency_type", "str"),
        Field("ride_feed_version", "str"),
    )),
    "trip_capacity": Schema("trip_capacity", (
        Field("trip_id", "str", required=True),
        Field("service_date", "str", pattern=GTFS_DATE, pattern_label="service_date must be in YYYYMMDD format"),
        Field("vehicle_description", "str"),
        Field("seated_capacity", "int", ge=0),
        Field("standing_capacity", "int", ge=0),
        Field("wheelchair_capacity", "int", ge=0),
        Field("bike_capacity", "int", ge=0),
    ), ("trip_id", "service_date")),
}

# --- fixed values: upload (Silver) schemas -------------------------------------
UPLOADS: dict[str, Schema] = {
    "Fleet Identification": Schema("FleetIdentification", (
        Field("owner_operator", "str", required=True),
        Field("vehicle_type", "str", required=True),
        Field("manufacturer_model", "str", required=True),
        Field("vehicle_id", "str", required=True),
        Field("emissions_standard", "str", required=True),
        Field("total_capacity", "int", required=True, ge=0),
        Field("seated_capacity", "int", required=True, ge=0),
        Field("average_age", "int", required=True, ge=0),
    )),
    "Fleet Energy Performance": Schema("FleetEnergyPerformance", (
        Field("avg_consumption_per_vehicle", "float", required=True, ge=0),
        Field("energy_cons_per_pax_km", "float", required=True, ge=0),
        Field("average_co2_emissions", "float", required=True, ge=0),
        Field("operational_status", "bool", required=True),
    )),
    "Electric Fleet Characteristics": Schema("ElectricFleetCharacteristics", (
        Field("battery_capacity", "float", required=True, ge=0),
        Field("range_autonomy", "float", required=True, ge=0),
        Field("battery_soh", "float", required=True, ge=0, le=100),
    )),
    "Operations and Circulation": Schema("OperationsAndCirculation", (
        Field("line_id", "str", required=True),
        Field("stop_id", "str", required=True),
        Field("direction_id", "int", required=True, ge=0, le=1),
        Field("stop_sequence", "int", required=True, ge=1),
        Field("stops_coordinates", "latlon", required=True),
        Field("service_start_time", "time", required=True),
        Field("service_end_time", "time", required=True),
        Field("average_trip_duration", "duration", required=True),
        Field("operating_lines", "str", required=True),
        Field("route_length", "float", required=True, ge=0),
        Field("deadhead_kilometers", "float", required=True, ge=0),
        Field("avg_operational_speed", "float", required=True, ge=0),
        Field("speed_profile", "float", required=True, ge=0),
        Field("punctuality_delays", "duration", required=True),
        Field("average_dwell_time", "duration", required=True),
        Field("avg_vehicle_occupancy", "float", required=True, ge=0, le=100),
        Field("frequency", "int", required=True, ge=0),
        Field("infrastructure_location", "str", required=True),
        Field("historical_data", "str"),
    )),
    "Transported Passengers": Schema("TransportedPassengers", (
        Field("timestamp", "datetime", required=True),
        Field("line_id", "str", required=True),
        Field("stop_id", "str", required=True),
        Field("direction_id", "int", ge=0, le=1),
        Field("temporal_resolution", "str", required=True, choices=TEMPORAL_RESOLUTIONS),
        Field("number_of_validations", "int", required=True, ge=0),
        Field("number_of_users", "int", required=True, ge=0),
        Field("boarding_count", "int", required=True, ge=0),
        Field("alighting_count", "int", required=True, ge=0),
        Field("passenger_km_index", "float", required=True, ge=0),
        Field("fare_category", "str", required=True, choices=FARE_CATEGORIES),
    )),
    "Charging Infrastructure": Schema("ChargingInfrastructure", (
        Field("charger_type", "str", required=True),
        Field("nominal_power", "float", required=True, ge=0),
        Field("est_charging_time", "duration", required=True),
        Field("brand_and_model", "str", required=True),
        Field("charging_voltage", "float", required=True, ge=0),
        Field("utilization_rate", "float", required=True, ge=0, le=100),
        Field("charging_point_location", "latlon", required=True),
    )),
    "Calendar Events": Schema("CalendarEvent", (
        Field("event_date", "date", required=True),
        Field("event_type", "str", required=True, choices=EVENT_TYPES),
        Field("event_description", "str", required=True),
        Field("affected_lines", "list"),
        Field("expected_demand_factor", "float", ge=0, le=2),
    )),
    "Weather Observations": Schema("WeatherObservation", (
        Field("timestamp", "datetime", required=True),
        Field("temperature_celsius", "float"),
        Field("precipitation_mm", "float", ge=0),
        Field("wind_speed_kmh", "float", ge=0),
        Field("weather_condition", "str"),
    )),
    "Stop Spatial Features": Schema("StopSpatialFeatures", (
        Field("stop_id", "str", required=True),
        Field("stop_name", "str"),
        Field("latitude", "float", required=True, ge=-90, le=90),
        Field("longitude", "float", required=True, ge=-180, le=180),
        Field("zone_id", "str"),
        Field("zone_type", "str", choices=ZONE_TYPES),
        Field("elevation_m", "float"),
        Field("population_density", "float", ge=0),
        Field("num_lines_served", "int", ge=1),
        Field("is_terminal", "bool"),
        Field("is_interchange", "bool"),
    )),
    "Stop Connections": Schema("StopConnection", (
        Field("source_stop_id", "str", required=True),
        Field("target_stop_id", "str", required=True),
        Field("line_id", "str", required=True),
        Field("direction_id", "int", required=True, ge=0, le=1),
        Field("sequence_order", "int", required=True, ge=1),
        Field("distance_km", "float", ge=0),
        Field("travel_time_seconds", "int", ge=0),
    )),
    "Financial & Economic Data": Schema("FinancialEconomicData", (
        Field("average_cost_per_route", "float", required=True, ge=0),
        Field("energy_cost_propulsion", "float", required=True, ge=0),
        Field("unit_price_fuel_energy", "float", required=True, ge=0),
        Field("maintenance_costs_annual", "float", required=True, ge=0),
        Field("average_cost_per_km", "float", required=True, ge=0),
        Field("insurance_costs", "float", required=True, ge=0),
        Field("personnel_count", "int", required=True, ge=0),
    )),
    "Lifespan and Depreciation": Schema("LifespanAndDepreciation", (
        Field("historical_replacement_date", "date", required=True),
        Field("asset_value", "float", required=True, ge=0),
        Field("depreciation_rate", "float", required=True, ge=0, le=100),
    )),
}

# --- fixed values: Gold schemas ------------------------------------------------
GOLD: dict[str, Schema] = {
    "TimeSeriesDemandSample": Schema("TimeSeriesDemandSample", (
        Field("timestamp", "datetime", required=True),
        Field("line_id", "str", required=True),
        Field("demand", "int", required=True, ge=0),
        Field("temporal_resolution", "str", required=True, choices=TEMPORAL_RESOLUTIONS),
        Field("hour_of_day", "int", ge=0, le=23),
        Field("day_of_week", "int", required=True, ge=0, le=6),
        Field("day_of_month", "int", required=True, ge=1, le=31),
        Field("month", "int", required=True, ge=1, le=12),
        Field("year", "int", required=True, ge=2000),
        Field("is_weekend", "bool", required=True),
        Field("is_holiday", "bool", required=True),
        Field("day_type", "str", required=True, choices=DAY_TYPES),
        Field("season", "str", required=True, choices=SEASONS),
        Field("avg_frequency", "float", ge=0),
        Field("total_capacity", "int", ge=0),
        Field("temperature_celsius", "float"),
        Field("precipitation_mm", "float", ge=0),
    )),
    "SpatioTemporalDemandSample": Schema("SpatioTemporalDemandSample", (
        Field("timestamp", "datetime", required=True),
        Field("node_id", "str", required=True),
        Field("line_id", "str", required=True),
        Field("latitude", "float", required=True, ge=-90, le=90),
        Field("longitude", "float", required=True, ge=-180, le=180),
        Field("demand", "int", required=True, ge=0),
        Field("boarding_count", "int", ge=0),
        Field("alighting_count", "int", ge=0),
        Field("temporal_resolution", "str", required=True, choices=TEMPORAL_RESOLUTIONS),
        Field("hour_of_day", "int", ge=0, le=23),
        Field("day_of_week", "int", required=True, ge=0, le=6),
        Field("month", "int", required=True, ge=1, le=12),
        Field("year", "int", required=True, ge=2000),
        Field("is_weekend", "bool", required=True),
        Field("is_holiday", "bool", required=True),
        Field("day_type", "str", required=True, choices=DAY_TYPES),
        Field("season", "str", required=True, choices=SEASONS),
        Field("zone_type", "str", choices=ZONE_TYPES),
        Field("population_density", "float", ge=0),
        Field("num_lines_served", "int", ge=1),
        Field("is_terminal", "bool"),
        Field("is_interchange", "bool"),
        Field("avg_frequency", "float", ge=0),
        Field("temperature_celsius", "float"),
        Field("precipitation_mm", "float", ge=0),
    )),
}

# --- fixed values: dataset requirements of the two feature modes ----------------
MODE_REQUIREMENTS: dict[str, dict[str, list[str]]] = {
    "Mode A": {
        "required": ["Transported Passengers", "Financial & Economic Data"],
        "optional": ["Weather Observations", "Calendar Events"],
    },
    "Mode B": {
        "required": ["Transported Passengers", "Stop Spatial Features", "Stop Connections"],
        "optional": ["Weather Observations", "Calendar Events"],
    },
}
