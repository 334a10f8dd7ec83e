"""Scans of files with faulty headers, and marks of test data, on hand-made files."""

import pytest

from wayloom.sources import files


def put(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(text.encode())


def test_quarantine_by_file(spark, tmp_path):
    put(tmp_path / "a", "good.csv", '﻿id,name,size\n1,"x, ""y""",3\n\n2,z,4,more\n3,w\nid,name,size\n')
    put(tmp_path / "a", "turned.csv", "size,extra,name,id\n5,e,n,6\n")
    put(tmp_path / "b", "lacks.csv", "id,name\n7,n\n")
    put(tmp_path / "b", "twice.csv", "id,name,size,size\n8,n,1,2\n")
    put(tmp_path / "b", "empty.csv", "")
    put(tmp_path / "b", "bare.csv", "id,name,size\n")
    issues = {r.file.rsplit("/", 1)[1]: r.issues for r in files.file_schemas(spark, str(tmp_path), ["id", "size"]).collect()}
    assert issues == {"good.csv": [], "turned.csv": [], "bare.csv": [], "lacks.csv": ["missing_column:size"], "twice.csv": ["duplicate_header"]}
    found = {(r.id, r.name, r.size, tuple(r.flags), r.valid) for r in files.scan_quarantined(spark, str(tmp_path), ["id", "name", "size"]).collect()}
    bad = ("invalid_source_schema",)
    assert found == {
        ("1", 'x, "y"', "3", (), True), ("2", "z", "4", ("extra_csv_fields",), True), ("3", "w", None, ("short_csv_row",), True), ("id", "name", "size", (), True),
        ("6", "n", "5", (), True), ("7", "n", None, bad, False), ("8", "n", "2", bad, False),
    }


def test_header_of_a_file_in_several_blocks(spark, tmp_path):
    put(tmp_path, "long.csv", "id,size\n" + "".join(f"{k},{k % 7}\n" for k in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert files._lines(spark, str(tmp_path), True).select("block").distinct().count() > 5
        rows = files.scan_quarantined(spark, str(tmp_path), ["id", "size"])
        assert rows.filter("valid AND size(flags) = 0 AND size = cast(id AS long) % 7").count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_test_data(spark, tmp_path):
    for folder in ("live", "demo", "a_demo", "demography", "fixtures/deep", "told", "torn"):
        spark.range(2).write.parquet(str(tmp_path / folder))
    put(tmp_path / "told", files.SIDECAR, '{"is_test_data": true}')
    put(tmp_path / "live", files.SIDECAR, '{"is_test_data": false}')
    put(tmp_path / "torn", files.SIDECAR, '{"is_test_da')
    read = lambda p: spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(p)
    rows = read(str(tmp_path)).selectExpr("*", "_metadata.file_path AS p", "_metadata")
    found = {(r.p.removeprefix(f"file:{tmp_path}/").removeprefix(f"file://{tmp_path}/").rsplit("/", 1)[0], tuple(r.marks)) for r in files.test_data_marks(rows, str(tmp_path)).collect()}
    assert found == {("live", ()), ("demo", ("path",)), ("a_demo", ("path",)), ("demography", ()), ("fixtures/deep", ("path",)), ("told", ("sidecar",)), ("torn", ())}
    assert files.refuse_test_data(read(str(tmp_path / "live")), str(tmp_path / "live")).count() == 2
    with pytest.raises(ValueError, match="test data"):
        files.refuse_test_data(read(str(tmp_path / "told")), str(tmp_path / "told"))
    marked = read(str(tmp_path / "live")).selectExpr("id", "CASE id WHEN 1 THEN 'True' END AS is_test_data")
    with pytest.raises(ValueError, match="test data"):
        files.refuse_test_data(marked, str(tmp_path / "live"))


TIME, LATER = "2024-01-01T00:00:00Z", "2024-03-01T00:00:00Z"
NODES = [{"type": "node", "id": k, "version": 1, "timestamp": TIME, "lat": 21.0, "lon": 105.8} for k in (1, 2)]
WAY = {"type": "way", "id": 10, "version": 2, "timestamp": TIME, "nodes": [1, 2], "tags": {"highway": "residential", "name": "x"}}
RELATION = {"type": "relation", "id": 20, "version": 1, "timestamp": TIME, "members": [{"type": "way", "ref": 10, "role": "from"}]}


def payload(*elements, counts=None, base=LATER, **more):
    n = {f"{k}s": sum(e.get("type") == k for e in elements) for k in ("node", "way", "relation")}
    tags = {k: str(v) for k, v in (n | {"total": len(elements)} | (counts or {})).items()}
    return {"osm3s": {"timestamp_osm_base": base}, "elements": [*elements, {"type": "count", "id": 0, "tags": tags}], **more}


def test_payload_rules(spark):
    import json

    from pyspark.sql import functions as F

    from wayloom.sources.tiles import checked_tiles

    whole = payload(*NODES, WAY, RELATION)
    node = lambda **change: payload({**NODES[0], **change})
    cases = {
        "whole": (whole, []),
        "numbers": (payload(NODES[0], counts={"total": 1}), []),
        "empty": (payload(), []),
        "remark": (payload(remark="runtime error"), ["remark"]),
        "silent": (payload(remark=""), []),
        "no_count": ({**whole, "elements": whole["elements"][:-1]}, ["no_final_count"]),
        "count_first": ({**whole, "elements": whole["elements"][::-1]}, ["no_final_count"]),
        "two_counts": ({**whole, "elements": whole["elements"] + whole["elements"][-1:]}, ["no_final_count"]),
        "wrong_total": (payload(NODES[0], counts={"total": 2}), ["wrong_count"]),
        "wrong_ways": (payload(NODES[0], counts={"ways": 1}), ["wrong_count"]),
        "words": (payload(NODES[0], counts={"nodes": "one"}), ["wrong_count"]),
        "no_list": ({"osm3s": {"timestamp_osm_base": LATER}}, ["no_elements", "no_final_count"]),
        "bad_id": (node(id=0), ["bad_id"]),
        "text_id": (node(id="seven"), ["bad_id"]),
        "repeated": (payload(NODES[0], NODES[0]), ["repeated_id"]),
        "same_id_other_kind": (payload(*NODES, {**WAY, "id": 1}), []),
        "unknown": (payload({**NODES[0], "type": "area"}), ["unknown_element"]),
        "lat": (node(lat=90.5), ["bad_place"]),
        "edge": (node(lat=-90, lon=180), []),
        "no_lon": (node(lon=None), ["bad_place"]),
        "version": (node(version=0), ["bad_version"]),
        "no_zone": (node(timestamp="2024-01-01T00:00:00"), ["bad_time"]),
        "new": (node(timestamp="2024-02-10T00:00:00+07:00"), ["newer_than_snapshot"]),
        "one_node": (payload(*NODES, {**WAY, "nodes": [1]}), ["missing_nodes"]),
        "other_node": (payload(*NODES, {**WAY, "nodes": [1, 3]}), ["missing_nodes"]),
        "no_nodes": (payload(*NODES, {**WAY, "nodes": None}), ["missing_nodes"]),
        "other_member": (payload(*NODES, RELATION), ["missing_members"]),
        "no_members": (payload({**RELATION, "members": None}), ["missing_members"]),
        "base": (payload(base=TIME), ["old_base"]),
        "no_base": (payload(base=None), ["old_base"]),
    }
    rows = [(k, json.dumps(v)) for k, (v, _) in cases.items()] + [("torn", json.dumps(whole)[:-3]), ("list", "[1]"), ("null", None), ("blank", "")]
    found = {r.tile: r.problems for r in checked_tiles(spark.createDataFrame(rows, "tile string, body string"), F.lit("2024-02-01T00:00:00Z").cast("timestamp")).collect()}
    assert found == {k: v for k, (_, v) in cases.items()} | dict.fromkeys(("torn", "list", "null", "blank"), ["not_json"])


def test_ingest_keeps_the_first_content(spark, tmp_path):
    import json

    from pyspark.sql import functions as F

    from wayloom.sources.tiles import checked_tiles, tile_objects
    from wayloom.streaming import jobs

    turned = {**WAY, "tags": {"name": "x", "highway": "residential"}}
    renamed = {**WAY, "tags": {"highway": "residential", "name": "y"}}
    batches = [
        [(1, payload(*NODES, WAY)), (2, payload(*NODES, turned))],
        [(3, payload(*NODES, renamed)), (4, payload({**NODES[0], "lat": 99}))],
        [(5, payload(*NODES, WAY)), (6, payload({**NODES[0], "id": 9}))],
    ]
    path, root = str(tmp_path / "landing"), jobs.stream_root(spark)
    for batch in batches:
        spark.createDataFrame([(t, json.dumps(x)) for t, x in batch], "tile long, body string").coalesce(1).write.mode("append").parquet(path)
        landed = checked_tiles(spark.readStream.schema("tile long, body string").parquet(path), F.lit("2024-02-01T00:00:00Z").cast("timestamp"))
        found = jobs.run_to_table(jobs.first_contents(tile_objects(landed)), "append", root=root)
    rows = {(r.kind, r.id, r.tile): r.outcome for r in found.collect()}
    assert {t: rows["way", 10, t] for t in (1, 2, 3, 5)} == {1: "new", 2: "repeat", 3: "conflict", 5: "repeat"}
    assert {t: rows["node", 1, t] for t in (1, 2, 3, 5)} == {1: "new", 2: "repeat", 3: "repeat", 5: "repeat"}
    assert rows["node", 9, 6] == "new" and not any(t == 4 for _, _, t in rows) and len(rows) == 13
