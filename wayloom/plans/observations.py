"""Field evidence made of the events: each event is one observation, and its number says which value of it is wrong."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.operators import evidence as e

from .registry import query
from .views import table

#: What an observation says unless a case changes it.
PLAIN = {
    "observer": "ann", "evidence_uri": "https://evidence.example/1", "evidence_type": "field_photo", "evidence_source": "field", "field": "lanes", "value": "2", "unit": "count", "status": "observed",
    "coverage": "whole_route", "sampling_zone": "A", "survey_group": "g", "policy_version": "p1", "route_version": "v1", "source_bundle_sha256": "b1", "policy_status_at_survey": "unknown",
}
GATE = {"field": "G1", "value": "passed", "unit": ""}
SCORE = {"field": "C6", "value": "3", "unit": "score_0_to_5", "rubric_version": "source_T09_C6_0_5_v1"}
SUPPORT = {"field": "C6_gps", "value": "minor", "unit": "", "rubric_version": "source_T09_C6_0_5_v1"}
#: Cases by the event's number modulo their count: changed values, and the rules that are broken then, by hand.
#: Case 1 takes the id of the event before it, 2 has none, and of 3 and 4 a row is stored, of 4 with another value.
CASES: list[tuple[dict[str, str], str]] = [
    ({}, ""), ({}, "duplicate_observation_id"), ({}, "missing_observation_id"), ({}, ""), ({}, "differs_from_stored"),
    ({"route_id": "none"}, "unknown_route"),
    ({"sampling_zone": "B", "route_version": "v0"}, "route_version_differs;sampling_zone_differs"),
    ({"survey_group": "h", "policy_version": "", "source_bundle_sha256": "b0"}, "policy_version_differs;source_bundle_sha256_differs;survey_group_differs"),
    ({"part_id": "p1", "segment_id": "s1", "coverage": "part"}, ""),
    ({"part_id": "p9"}, "part_not_on_route"), ({"segment_id": "s9"}, "segment_not_on_route"),
    ({"part_id": "p1", "segment_id": "s2"}, "part_and_segment_apart"),
    ({"part_id": "p9", "segment_id": "s9"}, "part_and_segment_apart;part_not_on_route;segment_not_on_route"),
    ({"trip_id": "t0"}, "trip_not_of_route"), ({"field": "width", "unit": "m"}, "unsupported_field"),
    ({"status": "seen"}, "unsupported_status"), ({"evidence_source": "hearsay"}, "unsupported_source"), ({"coverage": "half"}, "unsupported_coverage"),
    ({"coverage": "part"}, "coverage_needs_part"), ({"coverage": "segment"}, "coverage_needs_segment"), ({"coverage": ""}, ""),
    ({"status": "pending"}, "value_without_observation"), ({"status": "unknown", "value": "", "observer": "", "evidence_uri": ""}, ""),
    ({"observed_at": "2024-01-05T10:00:00"}, "invalid_time"), ({"survey_date": "5 January"}, "invalid_time"), ({"observed_at": "2024-02-30T10:00:00Z"}, "invalid_time"),
    ({"observed_at": "2031-01-01T00:00:00Z", "survey_date": "2031-01-01"}, "future_time"), ({"survey_date": "2023-12-31"}, "survey_date_differs"),
    ({"observed_at": "2024-01-05T23:30:00Z", "survey_date": "2024-01-06"}, ""), ({"observed_at": "2024-01-05T23:30:00+07:00", "survey_date": "2024-01-05"}, ""),
    ({"observer": " "}, "missing_observer"), ({"value": ""}, "missing_value;not_numeric"),
    ({"evidence_uri": ""}, "missing_uri"), ({"evidence_uri": "https:///x"}, "invalid_url"), ({"evidence_uri": "photos/1.jpg"}, "local_path_not_absolute"), ({"evidence_uri": "ftp://x/1"}, "unsupported_scheme"),
    ({"evidence_uri": "/evidence/none.jpg"}, "local_file_missing"), ({"evidence_uri": "/evidence/a 1.jpg"}, ""), ({"evidence_uri": "file:///evidence/a%201.jpg"}, ""),
    ({"evidence_type": "rumour"}, "field_needs_capture;unsupported_type"), ({"evidence_type": "desk_note"}, "field_needs_capture"), ({"evidence_type": "desk_note", "evidence_source": "desk"}, ""),
    ({"policy_status_at_survey": ""}, "unsupported_policy_status"), ({"policy_status_at_survey": "inside"}, "policy_missing_uri"), ({"policy_status_at_survey": "outside", "policy_evidence_uri": "https://law.example"}, ""),
    ({"field": "policy_status", "value": "inside", "unit": "", "policy_evidence_uri": "law.pdf"}, "policy_local_path_not_absolute"), ({"field": "policy_status", "value": "near", "unit": ""}, "policy_value"),
    (GATE, ""), (GATE | {"value": "maybe"}, "gate_value"), (GATE | {"coverage": "point"}, "gate_needs_whole_route"), (GATE | {"unit": "count"}, "gate_has_unit"),
    ({"value": "two"}, "not_numeric"), ({"value": "nan"}, "invalid_number"), ({"value": "-1"}, "invalid_number;not_positive"), ({"value": "2.5"}, "not_whole_number"), ({"value": "0"}, "not_positive"),
    ({"field": "maxspeed", "value": "37.5", "unit": "km/h"}, ""), ({"field": "maxspeed", "value": "40", "unit": "mph"}, "wrong_unit"), ({"field": "signal_count", "value": "0"}, ""),
    (SCORE, ""), (SCORE | {"value": "6"}, "score_out_of_range"), (SCORE | {"rubric_version": ""}, "wrong_rubric"), (SCORE | {"coverage": "point"}, "score_needs_whole_route"),
    (SUPPORT, ""), (SUPPORT | {"value": "awful"}, "support_value"), ({"field": "oneway", "value": "true", "unit": "boolean"}, ""), ({"field": "oneway", "value": "yes", "unit": "boolean"}, "oneway_value"),
]
FOLLOWS, NAMELESS, STORED, CHANGED = 1, 2, 3, 4


def observations(spark, sf_dir):
    """(line, case, fields): the route of an event's user, its local day, and the values of its case."""
    n, at = F.col("event_id"), F.expr("timestampadd(HOUR, 7, ts)")
    case = (n % len(CASES)).cast("int")
    plain = {c: F.lit(PLAIN.get(c, "")) for c in e.FIELDS} | {
        "observation_id": F.when(case == NAMELESS, "").otherwise((n - F.when(case == FOLLOWS, 1).otherwise(0)).cast("string")), "route_id": (F.col("user_id") % 60).cast("string"),
        "observed_at": F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")), "survey_date": F.date_format(at, "yyyy-MM-dd"),
    }
    for c in e.FIELDS:
        for k, (changed, _) in enumerate(CASES):
            if c in changed:
                plain[c] = F.when(case == k, changed[c]).otherwise(plain[c])
    return table(spark, sf_dir, "events").select(n.alias("line"), case.alias("case"), *(v.alias(c) for c, v in plain.items()))


EXPECTED = ", ".join(f"({k}, '{problems}')" for k, (_, problems) in enumerate(CASES))


@query(f"""SELECT event_id AS line, CASE WHEN "case" = {NAMELESS} AND event_id > {NAMELESS} THEN 'duplicate_observation_id;' ELSE '' END || problems AS problems, CASE WHEN "case" = {STORED} THEN 'ignored' WHEN problems = '' THEN 'accepted' ELSE 'rejected' END AS outcome
FROM events JOIN (VALUES {EXPECTED}) AS expected("case", problems) ON event_id % {len(CASES)} = "case" """)
def observation_rules(spark, sf_dir):
    """Every event as an observation, against registries of routes, parts and trips and what is stored already."""
    rows = observations(spark, sf_dir)
    routes = table(spark, sf_dir, "events").select((F.col("user_id") % 60).cast("string").alias("route_id")).distinct().select("route_id", *(F.lit(PLAIN[c]).alias(c) for c in e.SNAPSHOT))
    pairs = F.explode(F.array(*(F.struct(F.lit(f"p{k}").alias("part_id"), F.lit(f"s{k}").alias("segment_id")) for k in (1, 2))))
    parts = routes.select("route_id", pairs.alias("x")).select("route_id", "x.*")
    trips = routes.select(F.concat(F.lit("t"), F.col("route_id"), F.lit("-1")).alias("trip_id"), "route_id")
    stored = rows.filter(F.col("case").isin(STORED, CHANGED)).withColumn("value", F.when(F.col("case") == CHANGED, "3").otherwise(F.col("value")))
    files = spark.createDataFrame([("/evidence/a 1.jpg",)], "path string")
    found = e.check_observations(rows, routes, parts, trips, stored, files, F.lit("2030-01-01T00:00:00Z").cast("timestamp"))
    return found.select("line", F.array_join("problems", ";").alias("problems"), "outcome")
