"""Evidence rules on odd rows: nulls, blanks, repeated registries, empty tables, columns of the caller's own."""

from pyspark.sql import functions as F

from wayloom.operators import evidence as e
from wayloom.plans.observations import PLAIN

TEXT = ", ".join(f"{c} string" for c in e.FIELDS)


def check(spark, rows, routes, stored=()):
    row = lambda x: tuple((PLAIN | {"route_id": "7", "observed_at": "2024-01-05T10:00:00Z", "survey_date": "2024-01-05"} | x).get(c) for c in e.FIELDS)
    df = spark.createDataFrame([(k, *row(x)) for k, x in enumerate(rows)], f"line long, {TEXT}").withColumn("known", F.lit(1)).withColumn("first_line", F.lit(-1))
    registry = spark.createDataFrame([(r, *(PLAIN[c] for c in e.SNAPSHOT)) for r in routes], "route_id string, " + ", ".join(f"{c} string" for c in e.SNAPSHOT))
    none = lambda schema: spark.createDataFrame([], schema)
    old = spark.createDataFrame([row(x) for x in stored], TEXT)
    found = e.check_observations(df, registry, none("route_id string, part_id string, segment_id string"), none("trip_id string, route_id string"), old, none("path string"), F.lit("2030-01-01T00:00:00Z").cast("timestamp"))
    return [(r.problems, r.outcome) for r in sorted(found.collect(), key=lambda r: r.line)]


def test_odd_rows(spark):
    rows = [{"observation_id": "a"}, {"observation_id": " a "}, {"observation_id": "b", "value": " 2 ", "trip_id": None}, {"observation_id": None}, {"observation_id": ""}, {c: None for c in e.FIELDS}]
    found = check(spark, rows, ["7", "7", " 7"])
    assert found[:5] == [([], "accepted"), (["duplicate_observation_id"], "rejected"), ([], "accepted"), (["missing_observation_id"], "rejected"), (["duplicate_observation_id", "missing_observation_id"], "rejected")]
    problems, outcome = found[5]
    assert outcome == "rejected" and {"unknown_route", "unsupported_field", "unsupported_status", "invalid_time", "missing_value", "missing_uri", "missing_observer"} <= set(problems)


def test_stored_rows(spark):
    rows = [{"observation_id": "a", "value": "two"}, {"observation_id": "a", "value": "two"}, {"observation_id": "b", "notes": "new"}]
    found = check(spark, rows, ["7"], [{"observation_id": "a", "value": "two"}, {"observation_id": "a", "value": "two"}, {"observation_id": "b", "notes": None}])
    assert found == [([], "ignored"), ([], "ignored"), (["differs_from_stored"], "rejected")]


def test_empty_tables(spark):
    assert check(spark, [], ["7"]) == []
    assert check(spark, [{"observation_id": "a", "part_id": "p"}], []) == [(["unknown_route"], "rejected")]


def test_session_time_zone_does_not_matter(spark):
    rows = [{"observation_id": "a", "observed_at": "2024-01-05T23:30:00Z", "survey_date": "2024-01-06"}]
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert check(spark, rows, ["7"]) == [([], "accepted")]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
