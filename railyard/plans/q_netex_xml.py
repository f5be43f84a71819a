"""NeTEx text queries (NX-01..30, JN-21): every entity as XML text and the rows
of every document, each against XML text that the oracle builds with string
functions from the oracle views of the entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from railyard.operators import netex as NX
from railyard.plans import adapters as A
from railyard.plans.q_netex import _MODE_CASE, _ORDER_SQL, _PATTERN_VIEWS, _fold, _patterns, _timed_stop_times, _urn, CFG, ORDER
from railyard.plans.registry import register
from railyard.sinks import netex_xml as X

STAMP = "2024-01-01T00:00:00Z"
LANG = CFG.default_lang


# --- XML text in SQL: nested elements, four blanks a level, NULL children left out ---------
def _text(expr: str) -> str:
    return f"replace(replace(replace(CAST({expr} AS VARCHAR), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _leaf(tag: str, expr: str, depth: int, attrs: str = "") -> str:
    """A child with text; NULL when the text is."""
    return f"chr(10) || repeat('    ', {depth}) || '<{tag}{attrs}>' || {_text(expr)} || '</{tag}>'"


def _reference(tag: str, expr: str, depth: int) -> str:
    return f"chr(10) || repeat('    ', {depth}) || '<{tag} ref=\"' || {expr} || '\" version=\"any\"/>'"


def _box(tag: str, children: list[str], depth: int, attrs: str = "''") -> str:
    """A child with children (NULL ones left out)."""
    inner = " || ".join(f"coalesce({c}, '')" for c in children)
    return f"(chr(10) || repeat('    ', {depth}) || '<{tag}' || {attrs} || '>' || {inner} || chr(10) || repeat('    ', {depth}) || '</{tag}>')"


def _element(tag: str, children: list[str], more: str = "") -> str:
    """A whole entity: id, version and further attributes, then the children."""
    inner = " || ".join(f"coalesce({c}, '')" for c in children)
    return f"'<{tag} id=\"' || id || '\" version=\"{CFG.version}\"' || {more or repr('')} || '>' || {inner} || chr(10) || '</{tag}>'"


def _name(expr: str, tag: str = "Name", depth: int = 1) -> str:
    return _leaf(tag, expr, depth, f' lang="{LANG}"')


def _centroid(lat: str, lon: str, depth: int) -> str:
    box = _box("Centroid", [_box("Location", [_leaf("Longitude", lon, depth + 2), _leaf("Latitude", lat, depth + 2)], depth + 1)], depth)
    return f"CASE WHEN {lat} IS NOT NULL AND {lon} IS NOT NULL THEN {box} END"


_LOCAL = "printf('%s_%d_%d', CAST(route_id AS VARCHAR), coalesce(direction_id, 0), num)"

ENTITY_VIEWS = {
    **_PATTERN_VIEWS,
    "n_mode": f"""
        SELECT feed_id, CAST(stop_id AS VARCHAR) AS stop_id, mode FROM (
          SELECT x.feed_id, x.stop_id, rm.mode, {_ORDER_SQL},
                 count(*) OVER (PARTITION BY x.feed_id, x.stop_id, rm.mode) AS n,
                 row_number() OVER (PARTITION BY x.feed_id, x.stop_id, rm.mode ORDER BY {_ORDER_SQL}) AS rn
          FROM a_pattern_stop_times x JOIN a_trips t ON t.feed_id = x.feed_id AND t.trip_id = x.trip_id
          JOIN (SELECT feed_id, route_id, {_MODE_CASE} AS mode FROM a_routes) rm ON rm.feed_id = t.feed_id AND rm.route_id = t.route_id
          WHERE rm.mode IS NOT NULL)
        WHERE rn = 1
        QUALIFY row_number() OVER (PARTITION BY feed_id, stop_id ORDER BY n DESC, {_ORDER_SQL}) = 1""",
    "n_stop": """
        SELECT feed_id, CAST(stop_id AS VARCHAR) AS stop_id, stop_id AS ord, stop_name, stop_lat, stop_lon,
               CAST(parent_station AS VARCHAR) AS parent_station, coalesce(location_type, 0) AS lt FROM a_stops""",
    "n_quay": f"""
        SELECT *, CASE WHEN plt IS NOT NULL THEN parent_station ELSE stop_id || '_place' END AS place_key FROM (
          SELECT s.*, p.lt AS plt, p.stop_name AS pname, p.stop_lat AS plat, p.stop_lon AS plon, m.mode,
                 {_urn('Quay', 's.stop_id')} AS quay_id
          FROM n_stop s LEFT JOIN n_stop p ON p.feed_id = s.feed_id AND p.stop_id = s.parent_station
                        LEFT JOIN n_mode m ON m.feed_id = s.feed_id AND m.stop_id = s.stop_id
          WHERE s.lt = 0)""",
    "n_place": f"""
        SELECT feed_id, place_key, {_urn('StopPlace', 'place_key')} AS id, max(name) AS name, max(lat) AS lat, max(lon) AS lon,
               coalesce(max(mode), 'other') AS mode, max(quays) AS quays
        FROM (SELECT feed_id, stop_id AS place_key, coalesce(stop_name, stop_id) AS name, stop_lat AS lat, stop_lon AS lon,
                     NULL AS mode, NULL AS quays FROM n_stop WHERE lt = 1
              UNION ALL
              SELECT feed_id, place_key, any_value(coalesce(CASE WHEN plt IS NULL THEN stop_name ELSE pname END,
                                                            CASE WHEN plt IS NULL THEN stop_id ELSE parent_station END)),
                     any_value(CASE WHEN plt IS NULL THEN stop_lat ELSE plat END), any_value(CASE WHEN plt IS NULL THEN stop_lon ELSE plon END),
                     any_value(place_mode),
                     string_agg({_box('Quay', [_name('stop_name', depth=3), _centroid('stop_lat', 'stop_lon', 3)], 2,
                                      f"' id=\"' || quay_id || '\" version=\"{CFG.version}\"'")}, '' ORDER BY ord)
              FROM (SELECT q.*, (SELECT arg_min(mode, (-n, first)) FROM (
                                   SELECT mode, count(*) AS n, min(ord) AS first FROM n_quay c
                                   WHERE c.feed_id = q.feed_id AND c.place_key = q.place_key AND mode IS NOT NULL GROUP BY mode)) AS place_mode
                    FROM n_quay q)
              GROUP BY feed_id, place_key)
        GROUP BY feed_id, place_key""",
    "x_places": f"""
        SELECT feed_id, 'StopPlace' AS entity, id,
               {_element('StopPlace', [_name('name'), _centroid('lat', 'lon', 1), _leaf('TransportMode', 'mode', 1),
                                       "CASE WHEN quays IS NOT NULL THEN chr(10) || '    <quays>' || quays || chr(10) || '    </quays>' END"])} AS xml
        FROM n_place""",
    "x_lines": f"""
        SELECT feed_id, 'Line' AS entity, id,
               {_element('Line', [_name('name'), _leaf('PublicCode', 'route_short_name', 1), _leaf('TransportMode', 'mode', 1), _reference('OperatorRef', 'operator_ref', 1)])} AS xml
        FROM (SELECT *, {_urn('Line', 'route_id')} AS id, {_MODE_CASE} AS mode,
                     coalesce(nullif(route_long_name, ''), nullif(route_short_name, ''), CAST(route_id AS VARCHAR)) AS name,
                     {_urn('Operator', "coalesce(CAST(agency_id AS VARCHAR), 'OP1')")} AS operator_ref FROM a_routes)""",
    "x_organisations": f"""
        SELECT feed_id, kind AS entity, id,
               CASE kind WHEN 'Authority' THEN {_element('Authority', [_name('name'), _name('short_name', 'ShortName'), _box('ContactDetails', [_leaf('Email', 'email', 2)], 1)])}
                    ELSE {_element('Operator', [_name('name'), _name('short_name', 'ShortName')])} END AS xml
        FROM (SELECT DISTINCT feed_id, {_urn('Authority', "'AUTH'")} AS id, 'Authority' AS kind, 'Transit Authority' AS name, 'TA' AS short_name,
                     'authority@example.org' AS email FROM a_agency
              UNION ALL SELECT DISTINCT feed_id, {_urn('Operator', "'OP1'")}, 'Operator', 'Operator One', 'OP1', NULL FROM a_agency
              UNION ALL SELECT feed_id, {_urn('Operator', 'agency_id')}, 'Operator', agency_name, NULL, NULL FROM a_agency)""",
    "x_day_types": f"""
        SELECT feed_id, 'DayType' AS entity, id,
               {_element('DayType', [_name('service_id'), "CASE WHEN dow <> '' THEN "
                                     + _box('properties', [_box('PropertyOfDay', [_leaf('DaysOfWeek', 'dow', 3)], 2)], 1) + " END"])} AS xml
        FROM (SELECT feed_id, CAST(service_id AS VARCHAR) AS service_id, {_urn('DayType', 'service_id')} AS id, max(dow) AS dow
              FROM (SELECT feed_id, service_id, concat_ws(' ', CASE WHEN monday = 1 THEN 'Monday' END, CASE WHEN tuesday = 1 THEN 'Tuesday' END,
                             CASE WHEN wednesday = 1 THEN 'Wednesday' END, CASE WHEN thursday = 1 THEN 'Thursday' END,
                             CASE WHEN friday = 1 THEN 'Friday' END, CASE WHEN saturday = 1 THEN 'Saturday' END,
                             CASE WHEN sunday = 1 THEN 'Sunday' END) AS dow FROM a_calendar
                    UNION ALL SELECT feed_id, service_id, '' FROM a_calendar_dates)
              GROUP BY feed_id, service_id)""",
    "x_periods": f"""
        SELECT feed_id, 'OperatingPeriod' AS entity, id,
               {_element('OperatingPeriod', [_leaf('FromDate', "strftime(start_date, '%Y-%m-%d') || 'T00:00:00'", 1),
                                             _leaf('ToDate', "strftime(end_date, '%Y-%m-%d') || 'T00:00:00'", 1)])} AS xml
        FROM (SELECT *, {_urn('OperatingPeriod', 'service_id')} AS id FROM a_calendar)""",
    "n_assignment": f"""
        SELECT feed_id, {_urn('DayTypeAssignment', "CAST(service_id AS VARCHAR) || '_period'")} AS id, {_urn('DayType', 'service_id')} AS day_type,
               {_urn('OperatingPeriod', 'service_id')} AS period, NULL AS date, true AS open,
               row_number() OVER (PARTITION BY feed_id ORDER BY service_id) AS num
        FROM a_calendar
        UNION ALL
        SELECT c.feed_id, {_urn('DayTypeAssignment', "CAST(service_id AS VARCHAR) || '_' || strftime(date, '%Y%m%d')")}, {_urn('DayType', 'service_id')},
               NULL, strftime(date, '%Y-%m-%d'), exception_type = 1,
               row_number() OVER (PARTITION BY c.feed_id ORDER BY service_id) + (SELECT count(*) FROM a_calendar k WHERE k.feed_id = c.feed_id)
        FROM a_calendar_dates c""",
    "x_assignments": f"""
        SELECT feed_id, 'DayTypeAssignment' AS entity, id, num,
               {_element('DayTypeAssignment', [_leaf('Order', 'num', 1), _reference('OperatingPeriodRef', 'period', 1), _leaf('Date', 'date', 1),
                                               _reference('DayTypeRef', 'day_type', 1), _leaf('isAvailable', "CASE WHEN open THEN 'true' ELSE 'false' END", 1)])} AS xml
        FROM n_assignment""",
    "x_points": f"""
        SELECT feed_id, 'ScheduledStopPoint' AS entity, id, num,
               CASE WHEN stop_name IS NULL THEN '<ScheduledStopPoint id="' || id || '" version="{CFG.version}"/>'
                    ELSE {_element('ScheduledStopPoint', [_name('stop_name')])} END AS xml
        FROM (SELECT *, {_urn('ScheduledStopPoint', 'stop_id')} AS id, row_number() OVER (PARTITION BY feed_id ORDER BY ord) AS num FROM n_stop WHERE lt = 0)""",
    "x_stop_assignments": f"""
        SELECT feed_id, 'PassengerStopAssignment' AS entity, id, num,
               {_element('PassengerStopAssignment', [_reference('ScheduledStopPointRef', _urn('ScheduledStopPoint', 'stop_id'), 1),
                                                     _reference('QuayRef', _urn('Quay', 'stop_id'), 1)], "' order=\"' || num || '\"'")} AS xml
        FROM (SELECT *, {_urn('PassengerStopAssignment', 'stop_id')} AS id, row_number() OVER (PARTITION BY feed_id ORDER BY ord) AS num FROM n_stop WHERE lt = 0)""",
    "n_pattern_point": f"""
        SELECT feed_id, local_id, string_agg(
            {_box('StopPointInJourneyPattern', [_reference('ScheduledStopPointRef', _urn('ScheduledStopPoint', 'stop_id'), 3),
                                                _leaf('ForAlighting', "'true'", 3), _leaf('ForBoarding', "'true'", 3)], 2,
                  "' id=\"' || " + _urn('StopPointInJourneyPattern', "local_id || '_' || CAST(ord AS VARCHAR)") + f" || '\" version=\"{CFG.version}\" order=\"' || ord || '\"'")},
            '' ORDER BY ord) AS points
        FROM (SELECT feed_id, {_LOCAL} AS local_id, unnest(string_split(stops, ' ')) AS stop_id, unnest(range(1, len(string_split(stops, ' ')) + 1)) AS ord FROM pats)
        GROUP BY feed_id, local_id""",
    "x_patterns": f"""
        SELECT p.feed_id, 'ServiceJourneyPattern' AS entity, id, num,
               {_element('ServiceJourneyPattern', [_name('p.local_id'), _reference('LineRef', _urn('Line', 'route_id'), 1),
                                                   _leaf('DirectionType', "CASE WHEN coalesce(direction_id, 0) = 0 THEN 'outbound' ELSE 'inbound' END", 1),
                                                   "chr(10) || '    <pointsInSequence>' || points || chr(10) || '    </pointsInSequence>'"])} AS xml
        FROM (SELECT *, {_LOCAL} AS local_id, {_urn('JourneyPattern', _LOCAL)} AS id FROM pats) p JOIN n_pattern_point q USING (feed_id, local_id)""",
    "n_trip_pattern": f"""
        SELECT tp.feed_id, tp.trip_id, tp.route_id, {_LOCAL.replace('route_id', 'p.route_id').replace('direction_id', 'p.direction_id')} AS local_id
        FROM tp JOIN pats p ON p.feed_id = tp.feed_id AND p.route_id = tp.route_id AND p.direction_id IS NOT DISTINCT FROM tp.direction_id AND p.stops = tp.stops""",
    "n_passing": f"""
        SELECT feed_id, trip_id, string_agg(
            {_box('TimetabledPassingTime', [
                _reference('StopPointInJourneyPatternRef', _urn('StopPointInJourneyPattern', "local_id || '_' || CAST(idx AS VARCHAR)"), 3),
                _leaf('ArrivalTime', "printf('%02d:%02d:%02d', (arrival_secs // 3600) % 24, (arrival_secs % 3600) // 60, arrival_secs % 60)", 3),
                "CASE WHEN arrival_secs >= 86400 THEN " + _leaf('ArrivalDayOffset', 'arrival_secs // 86400', 3) + " END",
                _leaf('DepartureTime', "printf('%02d:%02d:%02d', (departure_secs // 3600) % 24, (departure_secs % 3600) // 60, departure_secs % 60)", 3),
                "CASE WHEN departure_secs >= 86400 THEN " + _leaf('DepartureDayOffset', 'departure_secs // 86400', 3) + " END"], 2,
                "' id=\"' || " + _urn('TimetabledPassingTime', "CAST(trip_id AS VARCHAR) || '_' || CAST(idx AS VARCHAR)") + " || '\"'")},
            '' ORDER BY idx) AS times
        FROM (SELECT s.*, t.local_id, row_number() OVER (PARTITION BY s.feed_id, s.trip_id ORDER BY stop_sequence, {_ORDER_SQL}) AS idx
              FROM a_pattern_stop_times s JOIN n_trip_pattern t USING (feed_id, trip_id))
        GROUP BY feed_id, trip_id""",
    "x_journeys": f"""
        SELECT feed_id, 'ServiceJourney' AS entity, id, {_urn('Line', 'route_id')} AS line_ref, CAST(route_id AS VARCHAR) AS line,
               {_element('ServiceJourney', [_box('dayTypes', [_reference('DayTypeRef', _urn('DayType', 'service_id'), 2)], 1),
                                            _reference('JourneyPatternRef', _urn('JourneyPattern', 'local_id'), 1), _reference('LineRef', _urn('Line', 'route_id'), 1),
                                            _reference('OperatorRef', _urn('Operator', "'OP1'"), 1),
                                            "chr(10) || '    <passingTimes>' || times || chr(10) || '    </passingTimes>'"])} AS xml
        FROM (SELECT t.feed_id, t.trip_id, t.route_id, a.service_id, t.local_id, p.times, {_urn('ServiceJourney', 't.trip_id')} AS id
              FROM n_trip_pattern t JOIN n_passing p USING (feed_id, trip_id) JOIN a_trips a USING (feed_id, trip_id))""",
}


def _union(*names: str) -> str:
    return "\nUNION ALL ".join(f"SELECT feed_id, entity, id, xml FROM {n}" for n in names)


def _modes(spark, sf):
    return NX.stop_modes(A.a_routes(spark, sf), A.a_trips(spark, sf), A.a_stop_times(spark, sf, pattern_stops=True), ORDER)


@register("netex_xml_entities", sql=_union("x_places", "x_lines"), extra_views=ENTITY_VIEWS)
def netex_xml_entities(spark, sf):
    """NX-07/08/09/13: StopPlace (with its Quays) and Line elements."""
    places = NX.stop_places(A.a_stops(spark, sf), _modes(spark, sf), CFG, ["stop_id"])
    lines = NX.lines(A.a_routes(spark, sf), CFG)
    return X.render_stop_places(places, CFG).unionByName(X.render_lines(lines, CFG))


@register("netex_xml_organisations", sql=_union("x_organisations"), extra_views=ENTITY_VIEWS)
def netex_xml_organisations(spark, sf):
    """NX-05: Authority and Operator elements."""
    return X.render_organisations(NX.organisations(A.a_agency(spark, sf), CFG, ["agency_id"]), CFG)


@register("netex_xml_calendar", sql=_union("x_day_types", "x_periods", "x_assignments"), extra_views=ENTITY_VIEWS)
def netex_xml_calendar(spark, sf):
    """NX-10/11/12: DayType, OperatingPeriod and DayTypeAssignment elements."""
    day_types, periods, assignments = _fold(spark, sf)
    return (X.render_day_types(day_types, CFG).unionByName(X.render_operating_periods(periods, CFG))
            .unionByName(X.render_assignments(assignments, CFG)))


@register("netex_xml_points", sql=_union("x_points", "x_stop_assignments"), extra_views=ENTITY_VIEWS)
def netex_xml_points(spark, sf):
    """NX-14/15: ScheduledStopPoint and PassengerStopAssignment elements."""
    points = NX.stop_points(A.a_stops(spark, sf), CFG, ["stop_id"])
    return X.render_stop_points(points, CFG).unionByName(X.render_stop_assignments(points, CFG).drop("order"))


@register("netex_xml_patterns", sql=_union("x_patterns"), extra_views=ENTITY_VIEWS)
def netex_xml_patterns(spark, sf):
    """NX-16/17: ServiceJourneyPattern elements with their points."""
    patterns, _ = _patterns(spark, sf)
    return X.render_journey_patterns(patterns, NX.stop_points_in_pattern(patterns, CFG, lists=True), CFG)


@register("netex_xml_journeys", sql=_union("x_journeys"), extra_views=ENTITY_VIEWS)
def netex_xml_journeys(spark, sf):
    """NX-18/19: ServiceJourney elements with their passing times."""
    trips, calls = NX.written_trips(A.a_trips(spark, sf), _timed_stop_times(spark, sf), ["row_num"], ORDER)
    _, t2p = NX.journey_patterns(trips, calls, CFG, ["row_num"], ORDER)
    journeys = NX.service_journeys(trips, t2p, CFG)
    return X.render_service_journeys(journeys, NX.passing_times(calls, t2p, CFG, ORDER, lists=True), CFG).drop("line_ref")


# --- documents ---------------------------------------------------------------------------------
_CS, _V = CFG.codespace, CFG.version
_TIMETABLE = "'TimetableFrame_Schedules_Line_' || line"
_RESOURCE = (f'<ResourceFrame id="{_CS}:ResourceFrame:ResourceFrame_1" version="{_V}"><codespaces><Codespace id="PT:{_CS}:Codespace:{_CS}">'
             f"<Xmlns>{_CS}</Xmlns><XmlnsUrl>http://www.pndt.pt/netex/{_CS}</XmlnsUrl><Description>PT-EPIP codespace for {CFG.operator.name}</Description>"
             f'</Codespace></codespaces><dataSources><DataSource id="PT:{_CS}:DataSource:default" version="{_V}"><Name lang="{LANG}">{CFG.authority.name}</Name>'
             "</DataSource></dataSources><organisations>")


def _role(kind: str, organisation: str) -> str:
    return (f'<ResponsibilityRoleAssignment id="PT:{_CS}:ResponsibilityRoleAssignment:{kind}" version="{_V}"><ResponsibleOrganisationRef ref="PT:{_CS}:{organisation}" '
            f'version="any"/><ResponsibilityRoleType>{kind}</ResponsibilityRoleType></ResponsibilityRoleAssignment>')


_RESOURCE_END = (f'</organisations><responsibilitySets><ResponsibilitySet id="{_CS}:ResponsibilitySet:default" version="{_V}"><roles>' + _role("ownership", "Authority:AUTH")
                 + _role("operation", "Operator:OP1") + "</roles></ResponsibilitySet></responsibilitySets></ResourceFrame>")


def _sections() -> str:
    """Entity rows between the opening and closing tag of their container."""
    parts = []
    for view, document, at, order, tag in (
            ("x_places", "'SiteFrame_Stops'", 21, "id", "stopPlaces"), ("x_day_types", "'SiteFrame_Stops'", 31, "id", "dayTypes"),
            ("x_periods", "'SiteFrame_Stops'", 34, "id", "operatingPeriods"), ("x_assignments", "'SiteFrame_Stops'", 37, "lpad(CAST(num AS VARCHAR), 12, '0')", "dayTypeAssignments"),
            ("x_lines", "'ServiceFrame_Lines'", 46, "id", "lines"), ("x_points", "'ServiceFrame_Lines'", 49, "lpad(CAST(num AS VARCHAR), 12, '0')", "scheduledStopPoints"),
            ("x_stop_assignments", "'ServiceFrame_Lines'", 52, "lpad(CAST(num AS VARCHAR), 12, '0')", "stopAssignments"),
            ("x_patterns", "'ServiceFrame_Lines'", 55, "lpad(CAST(num AS VARCHAR), 12, '0')", "journeyPatterns"),
            ("x_journeys", _TIMETABLE, 61, "id", "vehicleJourneys")):
        parts.append(f"SELECT feed_id, {document} AS document, {at + 1} AS section, {order} AS ordinal, xml AS text FROM {view}")
        parts += [f"SELECT DISTINCT feed_id, {document}, {k}, '', '{t}' FROM {view}" for k, t in ((at, f"<{tag}>"), (at + 2, f"</{tag}>"))]
    return "\nUNION ALL ".join(parts)


def _frames() -> str:
    """Everything around the containers, for every document."""
    head = (f"'<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || chr(10) || '<PublicationDelivery xmlns=\"{X.NETEX_NS}\" xmlns:gml=\"http://www.opengis.net/gml/3.2\" "
            "xmlns:siri=\"http://www.siri.org.uk/siri\" xmlns:xsi=\"http://www.w3.org/2001/XMLSchema-instance\" "
            f"xsi:schemaLocation=\"{X.NETEX_NS} {X.SCHEMA_LOCATION}\" version=\"1.15:PT-EPIP-1.0\"><PublicationTimestamp>{STAMP}</PublicationTimestamp>"
            f"<ParticipantRef>OP1</ParticipantRef><Description lang=\"{LANG}\">' || description || '</Description><dataObjects><CompositeFrame id=\"{_CS}:CompositeFrame:' || frame "
            f"|| '\" version=\"{_V}\"><ValidBetween><FromDate>' || from_date || 'T00:00:00</FromDate><ToDate>' || to_date || 'T00:00:00</ToDate></ValidBetween>"
            "<TypesOfFrameRef><TypeOfFrameRef ref=\"epip:' || profile || '\" versionRef=\"1.0\"/></TypesOfFrameRef><frames>'")
    fixed = [(0, head), (10, f"'{_RESOURCE}'"), (12, f"'{_RESOURCE_END}'"), (99, "'</frames></CompositeFrame></dataObjects></PublicationDelivery>'")]
    parts = [f"SELECT feed_id, document, {k}, '', {t} FROM docs" for k, t in fixed]
    parts.append("SELECT d.feed_id, document, 11, CASE entity WHEN 'Authority' THEN '0' ELSE '1' END || id, xml FROM docs d JOIN x_organisations o ON o.feed_id = d.feed_id")
    for document, opens, closes, tag, ident in (
            ("SiteFrame_Stops", 20, 29, "SiteFrame", "'SiteFrame_1'"), ("SiteFrame_Stops", 30, 40, "ServiceCalendarFrame", "'ServiceCalendarFrame_1'"),
            ("ServiceFrame_Lines", 45, 59, "ServiceFrame", "'ServiceFrame_1'"), ("", 60, 69, "TimetableFrame", "'Line_' || line")):
        where = f"document = '{document}'" if document else "line IS NOT NULL"
        parts.append(f"SELECT feed_id, document, {opens}, '', '<{tag} id=\"{_CS}:{tag}:' || {ident} || '\" version=\"{_V}\">' FROM docs WHERE {where}")
        parts.append(f"SELECT feed_id, document, {closes}, '', '</{tag}>' FROM docs WHERE {where}")
    return "\nUNION ALL ".join(parts)


DOCUMENTS_SQL = f"""
WITH lines_used AS (SELECT DISTINCT feed_id, line FROM x_journeys),
     valid AS (SELECT feed_id, strftime(min(start_date), '%Y-%m-%d') AS from_date, strftime(max(end_date), '%Y-%m-%d') AS to_date FROM a_calendar GROUP BY feed_id),
     named AS (SELECT feed_id, 'SiteFrame_Stops' AS document, NULL AS line, 'Stops' AS frame, 'EU_PI_STOP' AS profile, 'NeTEx stops &amp; calendar for Operator One' AS description FROM valid
               UNION ALL SELECT feed_id, 'ServiceFrame_Lines', NULL, 'Lines', 'EU_PI_LINE_OFFER', 'NeTEx lines for Operator One' FROM valid
               UNION ALL SELECT feed_id, {_TIMETABLE}, line, 'Timetable_Line_' || line, 'EU_PI_TIMETABLE', 'NeTEx schedules for line PT:{_CS}:Line:' || line FROM lines_used),
     docs AS (SELECT n.*, v.from_date, v.to_date FROM named n JOIN valid v USING (feed_id))
{_sections()}
UNION ALL {_frames()}
"""


@register("netex_documents", sql=DOCUMENTS_SQL, extra_views=ENTITY_VIEWS)
def netex_documents(spark, sf):
    """SNK-12, JN-21, NX-01..30: every row of every document of the feed."""
    tables = {"agency": A.a_agency(spark, sf), "routes": A.a_routes(spark, sf), "trips": A.a_trips(spark, sf), "stops": A.a_stops(spark, sf),
              "stop_times": _timed_stop_times(spark, sf), "calendar": A.a_calendar(spark, sf), "calendar_dates": A.a_calendar_dates(spark, sf)}
    return X.netex_documents(tables, CFG, STAMP, st_order=ORDER, stop_order=["stop_id"], trip_order=["row_num"]).select(
        "feed_id", "document", F.col("section").cast("int").alias("section"), "ordinal", "text")
