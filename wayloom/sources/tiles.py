"""Responses of tiles as JSON text: the rules a whole one keeps, and its objects with a digest of their content."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.operators.selection import let

OBJECT = "struct<type:string,id:bigint,version:bigint,timestamp:string,lat:double,lon:double,nodes:array<bigint>,members:array<struct<type:string,ref:bigint,role:string>>,tags:map<string,string>>"
PAYLOAD = f"struct<remark:string,osm3s:struct<timestamp_osm_base:string>,elements:array<{OBJECT}>>"
KINDS = ("node", "way", "relation")


def parsed(body: Column) -> Column:
    """The payload of a JSON text; what isn't of its type is null, and so is a text that is no object."""
    return F.from_json(body, PAYLOAD, {"allowNonNumericNumbers": "false"})


def zoned_time(text: Column) -> Column:
    """A time that states its zone, else null."""
    return F.when(text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"), F.try_to_timestamp(text))


def payload_problems(payload: Column, snapshot: Column) -> Column:
    """Sorted names of the rules that a parsed payload breaks; empty for a whole one.

    remark: the server left a message. no_elements, unknown_element, no_final_count (one count record, at the end),
    wrong_count (nodes, ways, relations, total), bad_id, repeated_id, bad_place, missing_nodes (two at least, all in
    the tile), missing_members, bad_version, bad_time (unreadable or without a zone), newer_than_snapshot,
    old_base (the server's data end before the snapshot, or it doesn't say).
    """
    none, strings, longs = F.lit(None).cast("boolean"), F.array().cast("array<string>"), F.array().cast("array<bigint>")
    known = F.coalesce(payload["elements"], F.array().cast(f"array<{OBJECT}>"))
    base = zoned_time(payload["osm3s"]["timestamp_osm_base"])
    bad = lambda x, limit: x.isNull() | F.isnan(x) | (F.abs(x) > limit)

    def named(e: Column, objects: Column, counts: Column, times: Column, keys: Column, of: dict[str, Column]) -> Column:
        def wrong(tags: Column) -> Column:
            stated = lambda name: F.when(F.try_element_at(tags, F.lit(name)).rlike("^[0-9]+$"), F.try_element_at(tags, F.lit(name)).try_cast("long"))
            sizes = {"total": F.size(objects), **{f"{k}s": F.size(of[k]) for k in KINDS}}
            return reduce(or_, (~stated(name).eqNullSafe(n.cast("long")) for name, n in sizes.items()))

        refs = F.flatten(F.transform(of["way"], lambda x: F.coalesce(x["nodes"], longs)))
        wanted = F.transform(F.flatten(F.transform(of["relation"], lambda x: x["members"])), lambda m: F.concat_ws("/", m["type"], m["ref"].cast("string")))
        missing_nodes = F.exists(of["way"], lambda x: x["nodes"].isNull() | (F.size(x["nodes"]) < 2)) | (F.size(F.array_except(refs, F.transform(of["node"], lambda x: x["id"]))) > 0)
        missing_members = F.exists(of["relation"], lambda x: x["members"].isNull()) | (F.size(F.array_except(F.coalesce(wanted, strings), keys)) > 0)
        rules = {
            "bad_id": F.exists(objects, lambda x: x["id"].isNull() | (x["id"] <= 0)),
            "bad_place": F.exists(of["node"], lambda x: bad(x["lat"], 90) | bad(x["lon"], 180)),
            "bad_time": F.exists(times, lambda t: t.isNull()),
            "bad_version": F.exists(objects, lambda x: x["version"].isNull() | (x["version"] < 1)),
            "missing_members": F.when(F.size(of["relation"]) > 0, missing_members),
            "missing_nodes": F.when(F.size(of["way"]) > 0, missing_nodes),
            "newer_than_snapshot": F.exists(times, lambda t: t > snapshot),
            "no_elements": F.size(e) == 0,
            "no_final_count": (F.size(counts) != 1) | ~F.try_element_at(e, F.lit(-1))["type"].eqNullSafe("count"),
            "old_base": base.isNull() | (base < snapshot),
            "remark": F.length(payload["remark"]) > 0,
            "repeated_id": F.size(F.array_distinct(keys)) < F.size(keys),
            "unknown_element": F.exists(objects, lambda x: x["type"].isNull() | ~x["type"].isin(*KINDS)),
            "wrong_count": (F.size(counts) == 1) & wrong(F.get(counts, 0)["tags"]),
        }
        return F.array_compact(F.array(*(F.when(F.coalesce(rule, none), F.lit(name)) for name, rule in rules.items())))

    # Each list is made once and named in the rules: Spark makes what lambdas are given anew wherever it is written.
    of_kind = lambda objects, kind: F.filter(objects, lambda x: x["type"].eqNullSafe(kind))
    lists = lambda e, objects: F.struct(F.filter(e, lambda x: x["type"].eqNullSafe("count")).alias("counts"), F.transform(objects, lambda x: zoned_time(x["timestamp"])).alias("times"), F.transform(objects, lambda x: F.concat_ws("/", x["type"], x["id"].cast("string"))).alias("keys"), *(of_kind(objects, k).alias(k) for k in KINDS))
    rules_of = lambda e, objects: let(lists(e, objects), lambda x: named(e, objects, x["counts"], x["times"], x["keys"], {k: x[k] for k in KINDS}))
    return let(known, lambda e: let(F.filter(e, lambda x: ~x["type"].eqNullSafe("count")), lambda objects: rules_of(e, objects)))


def checked_tiles(tiles: DataFrame, snapshot: Column) -> DataFrame:
    """tiles (tile, body) with payload and problems, of which a body that is no JSON object has one, not_json; works on streams as on tables."""
    whole = F.coalesce(F.schema_of_variant(F.try_parse_json("body")).startswith("OBJECT"), F.lit(False))
    rows = tiles.select("tile", parsed(F.col("body")).alias("payload"), whole.alias("whole"))
    problems = F.when(F.col("whole"), payload_problems(F.col("payload"), snapshot)).otherwise(F.array(F.lit("not_json")))
    # A row made by a generator: no filter on problems goes below it, where the text would be parsed anew for every rule.
    return rows.select("tile", F.inline(F.array(F.struct("payload", problems.alias("problems")))))


def digest(e: Column) -> Column:
    content = F.struct(*(e[c].alias(c) for c in ("type", "id", "version", "timestamp", "lat", "lon", "nodes", "members")), F.array_sort(F.map_entries(e["tags"])).alias("tags"))
    return F.sha2(F.to_json(content), 256)


def tile_objects(checked: DataFrame) -> DataFrame:
    """(kind, id, tile, version, digest) of the objects of tiles without a problem; the order of tags doesn't matter to the digest."""
    whole = checked.filter(F.size("problems") == 0).select("tile", F.explode("payload.elements").alias("e")).filter("e.type <> 'count'")
    return whole.select(F.col("e.type").alias("kind"), F.col("e.id").alias("id"), "tile", F.col("e.version").alias("version"), digest(F.col("e")).alias("digest"))


def landed_objects(checked: DataFrame) -> DataFrame:
    """tile_objects, and a row with a null kind for each tile with a problem: both from one pass over the texts."""
    none = F.array(F.lit(None).cast(OBJECT))
    own = F.when(F.size("problems") == 0, F.filter("payload.elements", lambda x: x["type"] != "count")).otherwise(none)
    rows = checked.select("tile", F.explode(own).alias("e"))
    return rows.select(F.col("e.type").alias("kind"), F.col("e.id").alias("id"), "tile", F.col("e.version").alias("version"), F.when(F.col("e").isNotNull(), digest(F.col("e"))).alias("digest"))
