"""NeTEx XML rendering (NX-01..30) and document sink (SNK-12).

Each entity row becomes an XML element with ``F.to_xml`` (child order is the
struct field order; NULL children are omitted; ``_x`` fields are attributes,
``_VALUE`` is text). Documents are assembled as text rows
``(feed_id, document, section, ordinal, text)``; header and footer rows wrap
the sorted entity rows, and each document is written in ordered parts into
its own ``feed_id=/document=`` folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railyard.operators.netex import NetexConfig
from railyard.session import materialise

FEED = "feed_id"
#: Fixed: namespace and schema of the standard.
NETEX_NS = "http://www.netex.org.uk/netex"
SCHEMA_LOCATION = "http://netex.uk/netex/schema/1.15/xsd/NeTEx_publication.xsd"
#: White space that ``to_xml`` may leave at the end.
BLANKS = " \t\n\x0b\f\r"


def _ref(value: Column, version: str | None = "any") -> Column:
    fields = [value.alias("_ref")]
    if version is not None:
        fields.append(F.lit(version).alias("_version"))
    return F.when(value.isNotNull(), F.struct(*fields))


def _text(value: Column, lang: str | None = None) -> Column:
    if lang is None:
        return value
    return F.when(value.isNotNull(), F.struct(F.lit(lang).alias("_lang"), value.alias("_VALUE")))


def _location(centroid: Column) -> Column:
    return F.when(centroid.isNotNull(), F.struct(F.struct(
        centroid["longitude"].alias("Longitude"), centroid["latitude"].alias("Latitude")).alias("Location")))


def _xml(df: DataFrame, entity: str, element: Column, row_tag: str) -> DataFrame:
    """The entity rows as XML; a column ``ordinal`` of their place goes along."""
    return df.select(FEED, F.lit(entity).alias("entity"), F.col("id"),
                     F.rtrim(F.to_xml(element, {"rowTag": row_tag}), F.lit(BLANKS)).alias("xml"),
                     *[c for c in ("ordinal",) if c in df.columns])


def _numbered(entities: DataFrame, id_col: str, ordinal: Column) -> DataFrame:
    """Entities with the place of every row of their id: joined before the XML is made, so that it stays where it is."""
    return entities.join(entities.select(FEED, id_col, ordinal.alias("ordinal")), [FEED, id_col])


def render_stop_places(places: DataFrame, cfg: NetexConfig) -> DataFrame:
    """NX-07/08/09: StopPlace ← Name, Centroid?, TransportMode, quays?."""
    quay = lambda q: F.struct(
        q["id"].alias("_id"), F.lit(cfg.version).alias("_version"),
        _text(q["name"], cfg.default_lang).alias("Name"), _location(q["centroid"]).alias("Centroid"),
        q["public_code"].alias("PublicCode"))
    el = F.struct(
        F.col("id").alias("_id"), F.lit(cfg.version).alias("_version"),
        _text(F.col("name"), cfg.default_lang).alias("Name"), _location(F.col("centroid")).alias("Centroid"),
        F.col("transport_mode").alias("TransportMode"),
        F.when(F.size("quays") > 0, F.struct(F.transform("quays", quay).alias("Quay"))).alias("quays"))
    return _xml(places, "StopPlace", el, "StopPlace")


def render_lines(lines: DataFrame, cfg: NetexConfig) -> DataFrame:
    """NX-13: Line ← Name, PublicCode?, TransportMode, OperatorRef?, Presentation?."""
    pres = F.when(F.col("colour").isNotNull() | F.col("text_colour").isNotNull(),
                  F.struct(F.col("colour").alias("Colour"), F.col("text_colour").alias("TextColour")))
    el = F.struct(
        F.col("id").alias("_id"), F.lit(cfg.version).alias("_version"),
        _text(F.col("name"), cfg.default_lang).alias("Name"), F.col("public_code").alias("PublicCode"),
        F.col("transport_mode").alias("TransportMode"), _ref(F.col("operator_ref")).alias("OperatorRef"),
        pres.alias("Presentation"))
    return _xml(lines, "Line", el, "Line")


def render_day_types(day_types: DataFrame, cfg: NetexConfig) -> DataFrame:
    """NX-10: DayType ← Name?, properties/PropertyOfDay/DaysOfWeek?."""
    props = F.when(F.col("days_of_week") != "", F.struct(F.struct(F.col("days_of_week").alias("DaysOfWeek"))
                                                         .alias("PropertyOfDay")))
    el = F.struct(F.col("id").alias("_id"), F.lit(cfg.version).alias("_version"),
                  _text(F.col("name"), cfg.default_lang).alias("Name"), props.alias("properties"))
    return _xml(day_types, "DayType", el, "DayType")


def render_operating_periods(periods: DataFrame, cfg: NetexConfig) -> DataFrame:
    """NX-11: OperatingPeriod ← FromDate, ToDate."""
    el = F.struct(F.col("id").alias("_id"), F.lit(cfg.version).alias("_version"),
                  F.concat(F.col("from_date"), F.lit("T00:00:00")).alias("FromDate"),
                  F.concat(F.col("to_date"), F.lit("T00:00:00")).alias("ToDate"))
    return _xml(periods, "OperatingPeriod", el, "OperatingPeriod")


def render_assignments(assignments: DataFrame, cfg: NetexConfig) -> DataFrame:
    """NX-12: DayTypeAssignment(order) ← OperatingPeriodRef or Date, DayTypeRef, isAvailable."""
    el = F.struct(F.col("id").alias("_id"), F.lit(cfg.version).alias("_version"), F.col("order").alias("Order"),
                  _ref(F.col("operating_period_ref")).alias("OperatingPeriodRef"), F.col("date").alias("Date"),
                  _ref(F.col("day_type_ref")).alias("DayTypeRef"),
                  F.when(F.col("is_available"), "true").otherwise("false").alias("isAvailable"))
    return _xml(assignments, "DayTypeAssignment", el, "DayTypeAssignment")


def render_organisations(orgs: DataFrame, cfg: NetexConfig) -> DataFrame:
    """NX-05: Authority / Operator ← Name, ShortName?, ContactDetails/Email?."""
    contact = F.when(F.col("contact_email").isNotNull(), F.struct(F.col("contact_email").alias("Email")))
    el = F.struct(F.col("id").alias("_id"), F.lit(cfg.version).alias("_version"),
                  _text(F.col("name"), cfg.default_lang).alias("Name"),
                  _text(F.col("short_name"), cfg.default_lang).alias("ShortName"), contact.alias("ContactDetails"))
    auth = _xml(orgs.where(F.col("kind") == "Authority"), "Authority", el, "Authority")
    op = _xml(orgs.where(F.col("kind") == "Operator"), "Operator", el, "Operator")
    return auth.unionByName(op)


def render_passing_times(pt: DataFrame) -> DataFrame:
    """NX-18: TimetabledPassingTime ← StopPointInJourneyPatternRef, times, offsets (> 0 only)."""
    el = F.struct(F.col("id").alias("_id"), _ref(F.col("spjp_ref")).alias("StopPointInJourneyPatternRef"),
                  F.col("arrival_time").alias("ArrivalTime"),
                  F.when(F.col("arrival_day_offset") > 0, F.col("arrival_day_offset")).alias("ArrivalDayOffset"),
                  F.col("departure_time").alias("DepartureTime"),
                  F.when(F.col("departure_day_offset") > 0, F.col("departure_day_offset")).alias("DepartureDayOffset"))
    return _xml(pt, "TimetabledPassingTime", el, "TimetabledPassingTime")


# --- documents (NX-20..30, SNK-12) ----------------------------------------------------------
def write_documents(rows: DataFrame, path: str) -> None:
    """Sorted rows of every document, cut by range over many tasks: a document is
    the parts of its folder in the order of their names (one part if it is small)."""
    order = [FEED, "document", "section", "ordinal", "text"]
    (rows.repartitionByRange(*order).sortWithinPartitions(*order)
     .select(FEED, "document", "text").write.mode("overwrite").partitionBy(FEED, "document").text(path))


# --- remaining entities (NX-01/02/06/14..17/19) ------------------------------------------------
def _passing_struct(pt: Column) -> Column:
    return F.struct(
        pt["id"].alias("_id"), _ref(pt["spjp_ref"]).alias("StopPointInJourneyPatternRef"),
        pt["arrival_time"].alias("ArrivalTime"),
        F.when(pt["arrival_day_offset"] > 0, pt["arrival_day_offset"]).alias("ArrivalDayOffset"),
        pt["departure_time"].alias("DepartureTime"),
        F.when(pt["departure_day_offset"] > 0, pt["departure_day_offset"]).alias("DepartureDayOffset"))


def render_service_journeys(journeys: DataFrame, passing: DataFrame, cfg: NetexConfig) -> DataFrame:
    """NX-19: ServiceJourney ← Name?, dayTypes?, JourneyPatternRef, LineRef,
    OperatorRef?, passingTimes (one journey's times: bounded by its length)."""
    if "times" in passing.columns:  # one row per trip already
        per = passing.select(FEED, "trip_id", F.col("times").alias("_pt"))
    else:
        per = passing.groupBy(FEED, "trip_id").agg(F.sort_array(F.collect_list(F.struct(
            "idx", "id", "spjp_ref", "arrival_time", "arrival_day_offset", "departure_time",
            "departure_day_offset"))).alias("_pt"))
    j = journeys.join(per, [FEED, "trip_id"], "left")
    el = F.struct(
        F.col("id").alias("_id"), F.lit(cfg.version).alias("_version"),
        _text(F.col("name"), cfg.default_lang).alias("Name"),
        F.struct(_ref(F.col("day_type_ref")).alias("DayTypeRef")).alias("dayTypes"),
        _ref(F.col("journey_pattern_ref")).alias("JourneyPatternRef"), _ref(F.col("line_ref")).alias("LineRef"),
        _ref(F.col("operator_ref")).alias("OperatorRef"),
        F.struct(F.transform(F.coalesce("_pt", F.array()), _passing_struct).alias("TimetabledPassingTime"))
        .alias("passingTimes"))
    return j.select(FEED, F.lit("ServiceJourney").alias("entity"), "id", "line_ref",
                    F.rtrim(F.to_xml(el, {"rowTag": "ServiceJourney"}), F.lit(BLANKS)).alias("xml"))


def render_stop_points(points: DataFrame, cfg: NetexConfig) -> DataFrame:
    """NX-14: ScheduledStopPoint ← Name?."""
    el = F.struct(F.col("ssp_id").alias("_id"), F.lit(cfg.version).alias("_version"),
                  _text(F.col("name"), cfg.default_lang).alias("Name"))
    return _xml(points.withColumn("id", F.col("ssp_id")), "ScheduledStopPoint", el, "ScheduledStopPoint")


def render_stop_assignments(points: DataFrame, cfg: NetexConfig) -> DataFrame:
    """NX-15: PassengerStopAssignment(order) ← ScheduledStopPointRef, QuayRef."""
    el = F.struct(F.col("psa_id").alias("_id"), F.lit(cfg.version).alias("_version"), F.col("order").alias("_order"),
                  _ref(F.col("ssp_id")).alias("ScheduledStopPointRef"), _ref(F.col("quay_ref")).alias("QuayRef"))
    numbered = _numbered(points, "psa_id", F.col("order")).withColumn("id", F.col("psa_id"))
    return _xml(numbered, "PassengerStopAssignment", el, "PassengerStopAssignment").withColumnRenamed("ordinal", "order")


def render_journey_patterns(patterns: DataFrame, points: DataFrame, cfg: NetexConfig) -> DataFrame:
    """NX-16/17: ServiceJourneyPattern ← Name, LineRef, DirectionType, pointsInSequence."""
    spjp = lambda p: F.struct(
        p["id"].alias("_id"), F.lit(cfg.version).alias("_version"), p["order"].alias("_order"),
        _ref(p["ssp_ref"]).alias("ScheduledStopPointRef"), F.lit("true").alias("ForAlighting"),
        F.lit("true").alias("ForBoarding"))
    if "points" in points.columns:  # the patterns with their points
        j = points.withColumnRenamed("points", "_pts")
    else:
        per = points.groupBy(FEED, "local_id").agg(
            F.array_sort(F.collect_list(F.struct("order", "id", "ssp_ref"))).alias("_pts"))
        j = patterns.join(per, [FEED, "local_id"], "left")
    el = F.struct(F.col("id").alias("_id"), F.lit(cfg.version).alias("_version"),
                  _text(F.col("local_id"), cfg.default_lang).alias("Name"), _ref(F.col("line_ref")).alias("LineRef"),
                  F.col("direction_type").alias("DirectionType"),
                  F.struct(F.transform(F.coalesce("_pts", F.array()), spjp).alias("StopPointInJourneyPattern"))
                  .alias("pointsInSequence"))
    return _xml(j, "ServiceJourneyPattern", el, "ServiceJourneyPattern")


def _resource_texts(cfg: NetexConfig) -> tuple[str, str]:
    """Codespace + DataSource (NX-01/02) before the organisations; the
    responsibility set (NX-06) after them. Fixed per export configuration."""
    cs, v = cfg.codespace, cfg.version
    head = (f'<ResourceFrame id="{cs}:ResourceFrame:ResourceFrame_1" version="{v}">'
            f'<codespaces><Codespace id="PT:{cs}:Codespace:{cs}"><Xmlns>{cs}</Xmlns>'
            f"<XmlnsUrl>http://www.pndt.pt/netex/{cs}</XmlnsUrl>"
            f"<Description>PT-EPIP codespace for {_esc(cfg.operator.name)}</Description></Codespace></codespaces>"
            f'<dataSources><DataSource id="PT:{cs}:DataSource:default" version="{v}">'
            f'<Name lang="{cfg.default_lang}">{_esc(cfg.authority.name)}</Name></DataSource></dataSources>'
            "<organisations>")
    role = (lambda r, org: f'<ResponsibilityRoleAssignment id="PT:{cs}:ResponsibilityRoleAssignment:{r}" version="{v}">'
            f'<ResponsibleOrganisationRef ref="{org}" version="any"/>'
            f"<ResponsibilityRoleType>{r}</ResponsibilityRoleType></ResponsibilityRoleAssignment>")
    tail = ("</organisations><responsibilitySets>"
            f'<ResponsibilitySet id="{cs}:ResponsibilitySet:default" version="{v}"><roles>'
            + role("ownership", f"PT:{cs}:Authority:{cfg.authority.id}")
            + role("operation", f"PT:{cs}:Operator:{cfg.operator.id}")
            + "</roles></ResponsibilitySet></responsibilitySets></ResourceFrame>")
    return head, tail


def _esc(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _section(entities: DataFrame, doc: Column, sec: int, open_text: str, close_text: str, present: DataFrame) -> DataFrame:
    """Entity rows of one section plus its wrapper rows — wrappers only for
    documents where the section has rows (empty containers are left out)."""
    body = entities.select(FEED, doc.alias("document"), F.lit(sec + 1).alias("section"), "ordinal", F.col("xml").alias("text"))
    return body.unionByName(_wrappers(present, [sec], sec, sec + 2, open_text, close_text))


def _num(c: str) -> Column:
    return F.lpad(F.col(c).cast("string"), 12, "0")


def _wrappers(present: DataFrame, sections: list[int], open_sec: int, close_sec: int, open_text, close_text: str) -> DataFrame:
    """Open/close rows for every document that has one of the sections."""
    docs = present.where(F.col("section").isin(sections)).select(FEED, "document")
    docs = docs.distinct() if len(sections) > 1 else docs
    opener = open_text if isinstance(open_text, Column) else F.lit(open_text)
    return docs.select(FEED, "document", F.explode(F.array(
        F.struct(F.lit(open_sec).alias("section"), opener.alias("text")),
        F.struct(F.lit(close_sec).alias("section"), F.lit(close_text).alias("text")))).alias("_r")).select(
        FEED, "document", "_r.section", F.lit("").alias("ordinal"), "_r.text")


def netex_documents(tables: dict, cfg: NetexConfig, timestamp: str, st_order=("stop_sequence",),
                    stop_order=("stop_id",), trip_order=("trip_id",), agency_order=("agency_id",)) -> DataFrame:
    """SNK-12 / JN-21 / NX-20..30: all document rows (feed_id, document, section, ordinal, text).

    Documents: ``SiteFrame_Stops`` (resource + site + calendar frames),
    ``ServiceFrame_Lines`` (resource + service frames) and one
    ``TimetableFrame_Schedules_Line_<line>`` per line (resource + timetable)."""
    from railyard.operators import netex as NX

    st, stops, routes, trips = tables["stop_times"], tables["stops"], tables["routes"], tables["trips"]
    trips, calls = NX.written_trips(trips, st, list(trip_order), list(st_order))
    modes = NX.stop_modes(routes, trips, st, list(st_order))
    places = NX.stop_places(stops, modes, cfg, list(stop_order))
    day_types, periods, assignments = NX.calendar_fold(tables["calendar"], tables["calendar_dates"], cfg,
                                                       ["service_id"], ["service_id", "date"])
    lines = NX.lines(routes, cfg)
    points = NX.stop_points(stops, cfg, list(stop_order))
    patterns, t2p = NX.journey_patterns(trips, calls, cfg, list(trip_order), list(st_order))
    spjp = NX.stop_points_in_pattern(patterns, cfg, lists=True)
    journeys = NX.service_journeys(trips, t2p, cfg)
    passing = NX.passing_times(calls, t2p, cfg, list(st_order), lists=True)
    orgs = render_organisations(NX.organisations(tables["agency"], cfg, list(agency_order)), cfg)
    validity = NX.validity(periods, routes)
    cs, v = cfg.codespace, cfg.version
    stops_doc, lines_doc = F.lit("SiteFrame_Stops"), F.lit("ServiceFrame_Lines")
    line_doc = F.concat(F.lit("TimetableFrame_Schedules_Line_"), F.regexp_extract(F.col("line_ref"), r"([^:]+)$", 1))

    # the documents of each section come from its rows before they are rendered, once
    sections = [(places, stops_doc, 21), (day_types, stops_doc, 31), (periods, stops_doc, 34), (assignments, stops_doc, 37),
                (lines, lines_doc, 46), (points, lines_doc, 49), (points, lines_doc, 52), (patterns, lines_doc, 55),
                (journeys, line_doc, 61)]
    present = materialise(reduce(DataFrame.unionByName, [
        rows.select(FEED, doc.alias("document")).distinct().withColumn("section", F.lit(sec)) for rows, doc, sec in sections]))
    by_id = lambda rows: rows.withColumn("ordinal", F.col("id").cast("string"))

    parts = [
        _section(render_stop_places(by_id(places), cfg), stops_doc, 21, "<stopPlaces>", "</stopPlaces>", present),
        _section(render_day_types(by_id(day_types), cfg), stops_doc, 31, "<dayTypes>", "</dayTypes>", present),
        _section(render_operating_periods(by_id(periods), cfg), stops_doc, 34, "<operatingPeriods>", "</operatingPeriods>",
                 present),
        _section(render_assignments(_numbered(assignments, "id", _num("order")), cfg), stops_doc, 37, "<dayTypeAssignments>",
                 "</dayTypeAssignments>", present),
        _section(render_lines(by_id(lines), cfg), lines_doc, 46, "<lines>", "</lines>", present),
        _section(render_stop_points(_numbered(points, "ssp_id", _num("order")), cfg), lines_doc, 49, "<scheduledStopPoints>",
                 "</scheduledStopPoints>", present),
        _section(render_stop_assignments(points, cfg).withColumn("ordinal", _num("order")), lines_doc, 52,
                 "<stopAssignments>", "</stopAssignments>", present),
        _section(render_journey_patterns(patterns, spjp.withColumn("ordinal", _num("_n")), cfg), lines_doc, 55,
                 "<journeyPatterns>", "</journeyPatterns>", present),
        _section(render_service_journeys(journeys, passing, cfg).withColumn("ordinal", F.col("id")), line_doc, 61,
                 "<vehicleJourneys>", "</vehicleJourneys>", present),
        _wrappers(present, [21], 20, 29, f'<SiteFrame id="{cs}:SiteFrame:SiteFrame_1" version="{v}">', "</SiteFrame>"),
        _wrappers(present, [31, 34, 37], 30, 40, f'<ServiceCalendarFrame id="{cs}:ServiceCalendarFrame:'
                                                 f'ServiceCalendarFrame_1" version="{v}">', "</ServiceCalendarFrame>"),
        _wrappers(present, [46, 49, 52, 55], 45, 59, f'<ServiceFrame id="{cs}:ServiceFrame:ServiceFrame_1" version="{v}">',
                  "</ServiceFrame>"),
        _wrappers(present, [61], 60, 69, F.concat(F.lit(f'<TimetableFrame id="{cs}:TimetableFrame:Line_'),
                                                  F.regexp_extract("document", r"Line_(.*)$", 1),
                                                  F.lit(f'" version="{v}">')), "</TimetableFrame>"),
    ]
    body = reduce(DataFrame.unionByName, parts)

    docs = present.select(FEED, "document").distinct()
    head, tail = _resource_texts(cfg)
    org_rows = orgs.join(docs, FEED).select(FEED, "document", F.lit(11).alias("section"),
                                            F.concat(F.when(F.col("entity") == "Authority", "0").otherwise("1"),
                                                     F.col("id")).alias("ordinal"), F.col("xml").alias("text"))
    doc = F.col("document")
    line_of_doc = F.regexp_extract("document", r"Line_(.*)$", 1)
    profile = (F.when(doc == "SiteFrame_Stops", "epip:EU_PI_STOP")
               .when(doc == "ServiceFrame_Lines", "epip:EU_PI_LINE_OFFER").otherwise("epip:EU_PI_TIMETABLE"))
    frame_key = (F.when(doc == "SiteFrame_Stops", "Stops").when(doc == "ServiceFrame_Lines", "Lines")
                 .otherwise(F.concat(F.lit("Timetable_Line_"), line_of_doc)))
    description = (F.when(doc == "SiteFrame_Stops", F.lit(f"NeTEx stops &amp; calendar for {_esc(cfg.operator.name)}"))
                   .when(doc == "ServiceFrame_Lines", F.lit(f"NeTEx lines for {_esc(cfg.operator.name)}"))
                   .otherwise(F.concat(F.lit(f"NeTEx schedules for line PT:{cs}:Line:"), line_of_doc)))
    participant = cfg.participant_ref or cfg.operator.short_name or cfg.operator.id
    header = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n'
              f'<PublicationDelivery xmlns="{NETEX_NS}" xmlns:gml="http://www.opengis.net/gml/3.2" '
              'xmlns:siri="http://www.siri.org.uk/siri" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" '
              f'xsi:schemaLocation="{NETEX_NS} {SCHEMA_LOCATION}" '
              f'version="1.15:PT-EPIP-1.0"><PublicationTimestamp>{timestamp}</PublicationTimestamp>'
              f'<ParticipantRef>{_esc(participant)}</ParticipantRef><Description lang="{cfg.default_lang}">'),
        description, F.lit("</Description><dataObjects>"),
        F.lit(f'<CompositeFrame id="{cs}:CompositeFrame:'), frame_key, F.lit(f'" version="{v}">'),
        F.lit("<ValidBetween><FromDate>"), F.col("from_date"), F.lit("T00:00:00</FromDate><ToDate>"), F.col("to_date"),
        F.lit('T00:00:00</ToDate></ValidBetween><TypesOfFrameRef><TypeOfFrameRef ref="'), profile,
        F.lit('" versionRef="1.0"/></TypesOfFrameRef><frames>'))
    fixed = docs.join(validity, FEED, "left").select(FEED, "document", F.explode(F.array(
        F.struct(F.lit(0).alias("section"), F.lit("").alias("ordinal"), header.alias("text")),
        F.struct(F.lit(10).alias("section"), F.lit("").alias("ordinal"), F.lit(head).alias("text")),
        F.struct(F.lit(12).alias("section"), F.lit("").alias("ordinal"), F.lit(tail).alias("text")),
        F.struct(F.lit(99).alias("section"), F.lit("").alias("ordinal"),
                 F.lit("</frames></CompositeFrame></dataObjects></PublicationDelivery>").alias("text")),
    )).alias("_r")).select(FEED, "document", "_r.section", "_r.ordinal", "_r.text")
    return body.unionByName(org_rows).unionByName(fixed)


def export_issues(tables: dict, cfg: NetexConfig) -> DataFrame:
    """PRJ-21: what refuses or qualifies the export of each feed — the GTFS
    pre-export gate, a placeholder codespace, route types without a mode."""
    from railyard.operators import netex as NX
    from railyard.operators import store
    from railyard.sinks import gtfs_text

    return gtfs_text.pre_export_issues(store.table_counts(tables)).unionByName(NX.preflight(tables["routes"], cfg))


def export_netex(tables: dict, cfg: NetexConfig, path: str, timestamp: str, **orders) -> tuple[DataFrame, DataFrame]:
    """SNK-12: write every document of the feeds without an error; returns
    (issues, document list with row counts)."""
    issues = materialise(export_issues(tables, cfg))
    refused = issues.where(F.col("severity") == "error").select(FEED).distinct()
    ok = {t: df.join(refused, FEED, "left_anti") for t, df in tables.items()}
    rows = materialise(netex_documents(ok, cfg, timestamp, **orders))
    write_documents(rows, path)
    return issues, rows.groupBy(FEED, "document").agg(F.count(F.lit(1)).alias("rows"))
