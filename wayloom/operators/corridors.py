"""Corridors of routes: the arcs of a walk in order, in the direction of travel, and what must agree about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayloom.functions.scalar import haversine

from .kinematics import flag_array

#: Metres by which the ends of neighbouring arcs, and lengths of arcs and routes, may differ.
END_M, ARC_M, ROUTE_M = 0.02, 0.01, 0.02


def corridors(walk: DataFrame, arcs: DataFrame) -> DataFrame:
    """Arcs of every route in order of pos, with start_m, the gap to the arc before, and whether ends and length agree.

    walk: route_id, pos, part_id, backward; arcs: part_id, ax, ay, bx, by, length_m. An arc that is travelled backward
    has its ends exchanged. An arc without geometry keeps its row, with nulls.
    """
    order = Window.partitionBy("route_id").orderBy("pos")
    rows = walk.join(arcs, "part_id", "left")
    turned = lambda a, b: F.when(F.col("backward"), F.col(b)).otherwise(F.col(a))
    rows = rows.select("route_id", "pos", "part_id", "backward", "length_m", turned("ax", "bx").alias("x0"), turned("ay", "by").alias("y0"), turned("bx", "ax").alias("x1"), turned("by", "ay").alias("y1"))
    start = F.coalesce(F.sum("length_m").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    gap = F.hypot(F.col("x0") - F.lag("x1").over(order), F.col("y0") - F.lag("y1").over(order))
    drawn = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return rows.withColumns({"start_m": start, "gap_m": gap, "joined": F.coalesce(gap <= END_M, F.col("pos") == F.min("pos").over(Window.partitionBy("route_id"))), "length_agrees": F.abs(drawn - F.col("length_m")) <= END_M})


def candidate_gates(walk: DataFrame, parts: DataFrame, routes: DataFrame) -> DataFrame:
    """route_id and the sorted names of what keeps a candidate out.

    walk: route_id, part_id, length_m as the route states it; parts: part_id, length_m, zone, routable; routes:
    route_id, zone, length_m as stated. Every pass counts.
    """
    own = parts.select("part_id", F.col("length_m").alias("part_m"), F.col("zone").alias("part_zone"), "routable")
    asked = routes.select("route_id", F.col("zone").alias("route_zone"), F.col("length_m").alias("stated_m"))
    known = F.col("part_m").isNotNull()
    totals = walk.join(own, "part_id", "left").join(asked, "route_id").groupBy("route_id", "stated_m").agg(
        F.bool_or(~known).alias("lacking"), F.bool_or(known & ~F.col("routable")).alias("barred"), F.bool_or(F.abs(F.col("length_m") - F.col("part_m")) > ARC_M).alias("arcs_differ"),
        F.bool_or(F.col("part_zone") != F.col("route_zone")).alias("outside"), F.sum("length_m").alias("total_m"),
    )
    gates = {"part_unknown": F.col("lacking"), "part_not_routable": F.col("barred"), "arc_length_differs": F.col("arcs_differ"), "total_length_differs": F.abs(F.col("total_m") - F.col("stated_m")) > ROUTE_M, "outside_zone": F.col("outside")}
    return totals.select("route_id", flag_array(gates).alias("gates"))


def endpoint_errors(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """arc_id and the largest distance in metres between its transformed ends and its nodes; null where a node is lacking.

    arcs: arc_id, from_node, to_node, lat0, lon0, lat1, lon1; nodes: node_id, lat, lon.
    """
    at = lambda end: nodes.select(F.col("node_id").alias(f"{end}_node"), F.col("lat").alias(f"{end}_lat"), F.col("lon").alias(f"{end}_lon"))
    rows = arcs.join(at("from"), "from_node", "left").join(at("to"), "to_node", "left")
    first, last = haversine(F.col("from_lat"), F.col("from_lon"), F.col("lat0"), F.col("lon0")), haversine(F.col("to_lat"), F.col("to_lon"), F.col("lat1"), F.col("lon1"))
    return rows.select("arc_id", F.when(first.isNotNull() & last.isNotNull(), F.greatest(first, last)).alias("error_m"))
