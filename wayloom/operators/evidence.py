"""Rules of field evidence: every observation with the names of all rules that it breaks, and what becomes of it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kinematics import flag_array

#: Columns of an observation; all are text.
FIELDS = (
    "observation_id route_id segment_id part_id trip_id observed_at survey_date observer evidence_uri evidence_type evidence_source field value unit status coverage time_block "
    "sampling_zone survey_group policy_version route_version source_bundle_sha256 policy_status_at_survey policy_evidence_uri rubric_version notes"
).split()
#: What a route's registry row and its observations must agree in.
SNAPSHOT = ("sampling_zone", "survey_group", "policy_version", "route_version", "source_bundle_sha256")


@dataclass(frozen=True)
class Vocabulary:
    """Fixed values of the rules; field names, words and units equal those of the survey's protocol."""

    gates: tuple[str, ...] = ("G1", "G4", "G5", "G6_start", "G6_end")
    numeric: tuple[str, ...] = ("lanes", "maxspeed", "junction_count", "signal_count", "C6")
    counts: tuple[str, ...] = ("lanes", "junction_count", "signal_count", "C6")
    positive: tuple[str, ...] = ("lanes", "maxspeed")
    other: tuple[str, ...] = ("oneway", "temporary_works", "direction_change", "turn_restriction", "start_point", "end_point", "gps_issue", "geometry_issue", "policy_status")
    supporting: tuple[str, ...] = ("C6_safety", "C6_repeatability", "C6_gps", "C6_works", "C6_permission")
    support_values: tuple[str, ...] = ("no_limitation", "minor", "moderate", "multiple", "severe", "infeasible")
    units: tuple[tuple[str, str], ...] = (("lanes", "count"), ("maxspeed", "km/h"), ("junction_count", "count"), ("signal_count", "count"), ("C6", "score_0_to_5"))
    statuses: tuple[str, ...] = ("observed", "unknown", "pending")
    sources: tuple[str, ...] = ("field", "desk")
    types: tuple[str, ...] = ("field_photo", "field_video", "field_note", "device_log", "official_document", "desk_image", "desk_note")
    field_types: tuple[str, ...] = ("field_photo", "field_video", "field_note", "device_log")
    policy: tuple[str, ...] = ("unknown", "inside", "outside")
    coverages: tuple[str, ...] = ("whole_route", "part", "segment", "point", "")
    rubric: str = "source_T09_C6_0_5_v1"
    timezone: str = "Asia/Ho_Chi_Minh"


def local_path(uri: Column) -> Column:
    """The path that a file address or a bare absolute path names, else null."""
    below = F.regexp_replace(F.regexp_replace(uri, r"(?i)^file:(//[^/?#]*)?", ""), "[?#].*$", "")
    return F.when(uri.startswith("/"), uri).when(uri.rlike("(?i)^file:"), F.try_url_decode(F.replace(below, F.lit("+"), F.lit("%2B"))))


def uri_problem(uri: Column, there: Column) -> Column:
    """What is wrong with an address of evidence, or null; there: the file that a local one names is known."""
    scheme = F.lower(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    web = F.when(~uri.rlike("(?i)^https?://[^/?#]+"), "invalid_url")
    local = F.when((scheme == "") & ~uri.startswith("/"), "local_path_not_absolute").when(~F.coalesce(there, F.lit(False)), "local_file_missing")
    return F.when(uri == "", "missing_uri").when(scheme.isin("http", "https"), web).when(scheme.isin("file", ""), local).otherwise("unsupported_scheme")


def check_observations(rows: DataFrame, routes: DataFrame, parts: DataFrame, trips: DataFrame, stored: DataFrame, files: DataFrame, now: Column, words: Vocabulary | None = None) -> DataFrame:
    """(line, observation_id, route_id, problems, outcome) of every row.

    rows: line (their order) and FIELDS; routes: route_id and SNAPSHOT; parts: route_id, part_id, segment_id; trips:
    trip_id, route_id; stored: FIELDS of what was accepted before; files: path of known local files. outcome: ignored
    where a stored row of that id says the same in every field (nothing else is checked then), rejected with any
    problem, else accepted. Null counts as empty, and white space around a value doesn't count. Of several rows with
    one id those after the first are duplicates, blank ids too. Registries hold one row a key; repeated ones of routes
    or stored ids count once, whichever comes first in the order of their values.
    """
    w = words or Vocabulary()
    text = lambda df: [F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in FIELDS]
    r = rows.select("line", *text(rows))
    once = lambda df, key: df.groupBy(key).agg(F.min(F.struct(*(c for c in df.columns if c != key))).alias("s"))
    keyed = lambda df, names, mark: df.select(*(F.trim(F.col(c).cast("string")).alias(f"{mark}_{c}") for c in names)).distinct().withColumn(mark, F.lit(True))
    on = lambda names, mark: reduce(Column.__and__, (F.col(c) == F.col(f"{mark}_{c}") for c in names))

    first = r.groupBy("observation_id").agg(F.min("line").alias("first_line")).withColumnRenamed("observation_id", "first_id")
    old = once(stored.select(*text(stored)), "observation_id").select(F.col("observation_id").alias("old_id"), F.col("s").alias("old"))
    known = once(routes.select(F.trim(F.col("route_id").cast("string")).alias("route_id"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in SNAPSHOT)), "route_id").select(F.col("route_id").alias("known_id"), F.col("s").alias("known"))
    out = r.join(first, F.col("observation_id") == F.col("first_id")).join(old, F.col("observation_id") == F.col("old_id"), "left").join(known, F.col("route_id") == F.col("known_id"), "left")
    for names, mark, source in ((("route_id", "part_id"), "has_part", parts), (("route_id", "segment_id"), "has_segment", parts), (("route_id", "part_id", "segment_id"), "has_pair", parts), (("trip_id", "route_id"), "has_trip", trips)):
        out = out.join(keyed(source, names, mark), on(names, mark), "left")
    paths = files.select(F.col("path").alias("known_path")).distinct()
    for c, mark in (("evidence_uri", "evidence_there"), ("policy_evidence_uri", "policy_there")):
        out = out.withColumn("own_path", local_path(F.col(c))).join(paths.withColumn(mark, F.lit(True)), F.col("own_path") == F.col("known_path"), "left").drop("own_path", "known_path")

    c, none = F.col, lambda mark: F.col(mark).isNull()
    field, value, unit, coverage = c("field"), c("value"), c("unit"), c("coverage")
    routed = c("known").isNotNull()
    said = ~c("status").isin("unknown", "pending")
    zoned = F.when(c("observed_at").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ].*(Z|[+-][0-9]{2}:?[0-9]{2})$"), F.try_to_timestamp("observed_at"))
    day = F.when(c("survey_date").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), c("survey_date").try_cast("date"))
    local_day = F.convert_timezone(F.current_timezone(), F.lit(w.timezone), zoned.cast("timestamp_ntz")).cast("date")
    looks = value.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    endless = value.rlike(r"(?i)^[+-]?(nan|inf|infinity)$")
    number = F.when(looks, value.try_cast("double"))
    numeric = said & field.isin(*w.numeric)
    wanted_unit = reduce(lambda e, x: F.when(field == x[0], x[1]).otherwise(e), w.units, F.lit(None))
    uri, policy_uri = uri_problem(c("evidence_uri"), c("evidence_there")), uri_problem(c("policy_evidence_uri"), c("policy_there"))
    needs_policy = said & (c("policy_status_at_survey").isin("inside", "outside") | ((field == "policy_status") & value.isin("inside", "outside")))
    rubric = said & field.isin("C6", *w.supporting)
    rules = {
        "missing_observation_id": c("observation_id") == "",
        "duplicate_observation_id": c("line") > c("first_line"),
        "differs_from_stored": c("old").isNotNull(),
        "unknown_route": ~routed,
        "part_not_on_route": routed & (c("part_id") != "") & none("has_part"),
        "segment_not_on_route": routed & (c("segment_id") != "") & none("has_segment"),
        "part_and_segment_apart": routed & (c("part_id") != "") & (c("segment_id") != "") & none("has_pair"),
        "trip_not_of_route": routed & (c("trip_id") != "") & none("has_trip"),
        "unsupported_field": ~field.isin(*w.gates, *w.other, *w.numeric, *w.supporting),
        "unsupported_status": ~c("status").isin(*w.statuses),
        "unsupported_source": ~c("evidence_source").isin(*w.sources),
        "unsupported_coverage": ~coverage.isin(*w.coverages),
        "coverage_needs_part": (coverage == "part") & (c("part_id") == ""),
        "coverage_needs_segment": (coverage == "segment") & (c("segment_id") == ""),
        "value_without_observation": ~said & (value != ""),
        "invalid_time": said & (zoned.isNull() | day.isNull()),
        "future_time": said & (zoned > now),
        "survey_date_differs": said & (day != local_day),
        "missing_observer": said & (c("observer") == ""),
        "missing_value": said & (value == ""),
        "unsupported_type": said & ~c("evidence_type").isin(*w.types),
        "field_needs_capture": said & (c("evidence_source") == "field") & ~c("evidence_type").isin(*w.field_types),
        "unsupported_policy_status": said & ~c("policy_status_at_survey").isin(*w.policy),
        "gate_value": said & field.isin(*w.gates) & ~value.isin("passed", "failed"),
        "gate_needs_whole_route": said & field.isin(*w.gates) & (coverage != "whole_route"),
        "gate_has_unit": said & field.isin(*w.gates) & (unit != ""),
        "not_numeric": numeric & ~looks & ~endless,
        "invalid_number": numeric & (endless | (number < 0) | (F.abs(number) == float("inf"))),
        "not_whole_number": numeric & field.isin(*w.counts) & (number != F.floor(number)),
        "not_positive": numeric & field.isin(*w.positive) & (number <= 0),
        "score_out_of_range": numeric & (field == "C6") & ~number.between(0, 5),
        "wrong_unit": numeric & (unit != wanted_unit),
        "oneway_value": said & (field == "oneway") & (~value.isin("true", "false") | (unit != "boolean")),
        "policy_value": said & (field == "policy_status") & ~value.isin(*w.policy),
        "support_value": said & field.isin(*w.supporting) & ~value.isin(*w.support_values),
        "wrong_rubric": rubric & (c("rubric_version") != w.rubric),
        "score_needs_whole_route": rubric & (coverage != "whole_route"),
    }
    rules |= {f"{name}_differs": routed & (c(name) != c(f"known.{name}")) for name in SNAPSHOT}
    for name in ("missing_uri", "invalid_url", "local_path_not_absolute", "local_file_missing", "unsupported_scheme"):
        rules |= {name: said & (uri == name), f"policy_{name}": needs_policy & (policy_uri == name)}
    same = F.coalesce(reduce(Column.__and__, (c(f"old.{x}") == c(x) for x in FIELDS if x != "observation_id")), F.lit(False))
    problems = F.when(same, F.array().cast("array<string>")).otherwise(flag_array(rules))
    out = out.select("line", "observation_id", "route_id", same.alias("same"), problems.alias("problems"))
    return out.select("line", "observation_id", "route_id", "problems", F.when(c("same"), "ignored").when(F.size("problems") > 0, "rejected").otherwise("accepted").alias("outcome"))
