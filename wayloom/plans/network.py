"""Queries of the road network over stand-ins: parts carry tags, line items are arcs and walks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayloom.operators import network as n
from wayloom.operators.lineage import dealt

from .registry import query
from .views import ARCS, arcs, passes, table

TAGS = """tagged AS (SELECT p_partkey AS way_id, ['primary', 'residential', 'trunk', 'motorway', 'service', 'track'][p_partkey % 6 + 1] AS highway,
  CASE p_size % 5 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' WHEN 2 THEN 'destination' END AS access, CASE p_partkey % 7 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'odd' END AS motorcycle,
  CASE p_partkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN '-1' WHEN 2 THEN 'no' WHEN 3 THEN 'reversible' END AS oneway, CASE WHEN p_size % 9 = 0 THEN 'no' END AS oneway_m,
  CASE WHEN p_size % 4 = 0 THEN 'yes' END AS m_backward, CASE WHEN p_partkey % 13 = 0 THEN 'no @ night' END AS m_cond, CASE WHEN p_size % 6 = 0 THEN 'gate' END AS barrier, CASE WHEN p_size % 10 = 0 THEN 'yes' END AS locked FROM part),
ruled AS (SELECT *, coalesce(motorcycle, access) AS v, CASE WHEN highway = 'motorway' THEN 'excluded' WHEN highway IN ('trunk', 'track') OR m_cond IS NOT NULL THEN 'review_required' ELSE 'provisionally_allowed' END AS policy FROM tagged),
ways AS (SELECT *, CASE WHEN v IN ('no', 'private') THEN 'excluded' WHEN v IS NOT NULL AND v NOT IN ('yes', 'designated', 'permissive') AND policy <> 'excluded' THEN 'review_required' ELSE policy END AS status,
  CASE highway WHEN 'primary' THEN 'RC1' WHEN 'residential' THEN 'RC4' WHEN 'service' THEN 'connector' ELSE 'other' END AS rc FROM ruled)"""


def tagged(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    kinds = F.array(*map(F.lit, ("primary", "residential", "trunk", "motorway", "service", "track")))
    values = {
        "highway": F.element_at(kinds, (k % 6 + 1).cast("int")), "access": F.when(s % 5 == 0, "no").when(s % 5 == 1, "yes").when(s % 5 == 2, "destination"), "motorcycle": F.when(k % 7 == 0, "yes").when(k % 7 == 1, "no").when(k % 7 == 2, "odd"),
        "oneway": F.when(k % 5 == 0, "yes").when(k % 5 == 1, "-1").when(k % 5 == 2, "no").when(k % 5 == 3, "reversible"), "oneway:motorcycle": F.when(s % 9 == 0, "no"), "motorcycle:backward": F.when(s % 4 == 0, "yes"),
        "motorcycle:conditional": F.when(k % 13 == 0, "no @ night"), "barrier": F.when(s % 6 == 0, "gate"), "locked": F.when(s % 10 == 0, "yes"),
    }
    pairs = F.array(*(F.struct(F.lit(name).alias("key"), v.alias("value")) for name, v in values.items()))
    return table(spark, sf_dir, "part").select(k.alias("way_id"), s.alias("size"), F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("tags"))


@query(f"WITH {TAGS} SELECT way_id, CASE WHEN motorcycle IS NOT NULL THEN 'motorcycle' WHEN access IS NOT NULL THEN 'access' END AS key, v AS value FROM ruled")
def access_lookup(spark, sf_dir):
    found = n.access(F.col("tags"))
    return tagged(spark, sf_dir).select("way_id", found["key"].alias("key"), found["value"].alias("value"))


@query(f"WITH {TAGS} SELECT way_id, CASE WHEN m_cond IS NULL THEN '' ELSE 'motorcycle:conditional' END AS keys FROM tagged")
def conditional_tags(spark, sf_dir):
    return tagged(spark, sf_dir).select("way_id", F.array_join(n.conditional_keys(F.col("tags")), ";").alias("keys"))


@query(f"WITH {TAGS} SELECT way_id, status, policy AS policy_status, rc FROM ways")
def classify_way(spark, sf_dir):
    t = F.col("tags")
    return tagged(spark, sf_dir).select("way_id", n.way_status(t).alias("status"), n.policy_status(t).alias("policy_status"), n.way_class(t).alias("rc"))


DIRECTED = f"""{TAGS}, one AS (SELECT *, coalesce(oneway_m, oneway, CASE WHEN highway = 'motorway' THEN 'yes' ELSE 'no' END) AS ow, CASE WHEN oneway_m IS NOT NULL THEN 0 ELSE 2 END AS rank_of FROM ways),
dirs AS (SELECT *, CASE WHEN ow = 'yes' THEN CASE WHEN m_backward IS NULL THEN 'forward' WHEN rank_of = 0 THEN '' ELSE 'forward;backward' END WHEN ow = '-1' THEN 'backward' WHEN ow = 'no' THEN 'forward;backward' ELSE '' END AS dirs FROM one)"""


@query(f"WITH {DIRECTED} SELECT way_id, dirs AS directions FROM dirs")
def oneway_directions(spark, sf_dir):
    return tagged(spark, sf_dir).select("way_id", F.array_join(n.directions(F.col("tags")), ";").alias("directions"))


@query(f"""WITH {DIRECTED}, e AS (SELECT way_id, unnest(string_split(dirs, ';')) AS direction, policy, CASE WHEN unnest(string_split(dirs, ';')) = 'backward' THEN coalesce(m_backward, v) ELSE v END AS dv FROM dirs WHERE dirs <> '')
SELECT way_id, direction, CASE WHEN dv IN ('no', 'private') THEN 'excluded' WHEN dv IS NOT NULL AND dv NOT IN ('yes', 'designated', 'permissive') AND policy <> 'excluded' THEN 'review_required' ELSE policy END AS status FROM e""")
def directional_decision(spark, sf_dir):
    t = F.col("tags")
    value = lambda d: n.with_access(n.policy_status(t), n.access(t, d)["value"])
    rows = tagged(spark, sf_dir).select("way_id", "tags", F.explode(n.directions(t)).alias("direction"))
    return rows.select("way_id", "direction", F.when(F.col("direction") == "forward", value("forward")).otherwise(value("backward")).alias("status"))


NODES = f"""{TAGS}, nodes AS (SELECT way_id, CASE WHEN locked IS NOT NULL THEN 'review_required' WHEN v IN ('no', 'private') THEN 'excluded' WHEN m_cond IS NOT NULL OR (v IS NOT NULL AND v <> 'yes') THEN 'review_required' WHEN barrier IS NOT NULL AND coalesce(v, '') <> 'yes' THEN 'review_required' ELSE 'provisionally_allowed' END AS status FROM ways)"""


@query(f"WITH {NODES} SELECT way_id, status FROM nodes")
def node_decision(spark, sf_dir):
    return tagged(spark, sf_dir).select("way_id", n.node_status(F.col("tags")).alias("status"))


LEVELS = """lv AS (SELECT p_partkey AS way_id, CASE WHEN p_partkey % 50 = 0 THEN '1' ELSE '0' END || '|' || CASE WHEN p_partkey % 70 = 0 THEN 'yes' ELSE 'no' END || '|no' AS level, p_partkey % 17 = 0 AS area FROM part)"""
RESTRICTED = "bad AS (SELECT DISTINCT l_partkey AS way_id FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 7)"


@query(f"""WITH {DIRECTED}, {NODES.removeprefix(TAGS + ", ")}, {LEVELS}, {RESTRICTED},
refs AS (SELECT *, row_number() OVER (PARTITION BY way_id ORDER BY l_orderkey, l_linenumber, node, l_quantity, l_extendedprice) AS pos, count(*) OVER (PARTITION BY way_id) AS n FROM (SELECT l_partkey AS way_id, l_suppkey AS node, l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem)),
inside AS (SELECT way_id, node, level FROM refs JOIN lv USING (way_id) WHERE pos > 1 AND pos < n), clash AS (SELECT DISTINCT way_id FROM inside WHERE node IN (SELECT node FROM inside GROUP BY node HAVING count(DISTINCT level) > 1)),
pol AS (SELECT d.way_id, d.dirs, d.v AS fv, coalesce(d.m_backward, d.v) AS bv, CASE WHEN policy <> 'excluded' AND (dirs = '' OR area OR b.way_id IS NOT NULL OR c.way_id IS NOT NULL) THEN 'review_required' ELSE policy END AS policy FROM dirs d JOIN lv USING (way_id) LEFT JOIN bad b USING (way_id) LEFT JOIN clash c USING (way_id)),
s AS (SELECT DISTINCT l_partkey AS way_id, l_suppkey AS segment_id FROM lineitem),
at_nodes AS (SELECT segment_id, max(CASE status WHEN 'excluded' THEN 2 WHEN 'review_required' THEN 1 ELSE 0 END) AS node FROM s JOIN nodes USING (way_id) GROUP BY segment_id),
under AS (SELECT segment_id, dirs, fv, bv, greatest(node, CASE policy WHEN 'excluded' THEN 2 WHEN 'review_required' THEN 1 ELSE 0 END) AS p FROM s JOIN pol USING (way_id) JOIN at_nodes USING (segment_id)),
each AS (SELECT segment_id, p, CASE WHEN contains(dirs, 'forward') THEN CASE WHEN fv IN ('no', 'private') THEN 2 WHEN fv IS NOT NULL AND fv NOT IN ('yes', 'designated', 'permissive') THEN greatest(p, 1) ELSE p END END AS f,
  CASE WHEN contains(dirs, 'backward') THEN CASE WHEN bv IN ('no', 'private') THEN 2 WHEN bv IS NOT NULL AND bv NOT IN ('yes', 'designated', 'permissive') THEN greatest(p, 1) ELSE p END END AS b FROM under),
r AS (SELECT segment_id, max(CASE WHEN p = 2 THEN 2 ELSE coalesce(least(f, b), 1) END) AS sev FROM each GROUP BY segment_id)
SELECT segment_id, CASE sev WHEN 2 THEN 'excluded' WHEN 1 THEN 'review_required' ELSE 'provisionally_allowed' END AS status FROM r""")
def segment_decision(spark, sf_dir):
    """Ways with unresolved restrictions, clashing levels, untold directions or areas need review; then nodes, and access by direction."""
    k = F.col("way_id")
    layer, bridge = F.when(k % 50 == 0, "1"), F.when(k % 70 == 0, "yes")
    more = F.array_compact(F.array(*(F.when(v.isNotNull(), F.struct(F.lit(name).alias("key"), v.alias("value"))) for name, v in (("layer", layer), ("bridge", bridge), ("area", F.when(k % 17 == 0, "yes"))))))
    t = tagged(spark, sf_dir).select("way_id", F.map_concat("tags", F.map_from_entries(more)).alias("tags"))
    items = dealt(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("way_id"), F.col("l_suppkey").alias("segment_id"), "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"), "way_id")
    order = Window.partitionBy("way_id").orderBy("l_orderkey", "l_linenumber", "segment_id", "l_quantity", "l_extendedprice")
    refs = items.select("way_id", F.row_number().over(order).alias("pos"), F.col("segment_id").alias("node_id"))
    tag = lambda name, default: F.coalesce(F.element_at("tags", F.lit(name)), F.lit(default))
    clash = n.level_clashes(refs, t.select("way_id", F.concat_ws("|", tag("layer", "0"), tag("bridge", "no"), tag("tunnel", "no")).alias("level"))).withColumn("clashing", F.lit(True))
    bad = items.filter("l_returnflag = 'R' and l_linenumber = 7").select("way_id").distinct().withColumn("restricted", F.lit(True))
    known = t.join(clash, "way_id", "left").join(bad, "way_id", "left").fillna(False, ["clashing", "restricted"])
    ways = known.select("way_id", "tags", n.reviewed_policy(F.col("tags"), F.col("restricted"), F.col("clashing")).alias("policy"), n.node_status(F.col("tags")).alias("node"))
    return n.segment_status(items.select("segment_id", "way_id").distinct(), ways)


@query(f"WITH {TAGS} SELECT status, rc, count(*) AS n, round(sum(p_retailprice), 2) AS length_m FROM ways JOIN part ON p_partkey = way_id GROUP BY ALL")
def network_statistics(spark, sf_dir):
    t = tagged(spark, sf_dir).select("way_id", n.way_status(F.col("tags")).alias("status"), n.way_class(F.col("tags")).alias("rc"))
    return t.join(table(spark, sf_dir, "part"), F.col("way_id") == F.col("p_partkey")).groupBy("status", "rc").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p_retailprice"), 2).cast("double").alias("length_m"))


@query(f"WITH {TAGS} SELECT way_id, status FROM ways WHERE status = 'review_required'")
def review_list_export(spark, sf_dir):
    return tagged(spark, sf_dir).select("way_id", n.way_status(F.col("tags")).alias("status")).filter("status = 'review_required'")


RULE_TAGS = """rt AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 17 = 0 THEN 'route' ELSE 'restriction' END AS type, (['', 'bicycle', 'motorcycle ; bus', 'psv;vehicle'])[CASE WHEN o_orderkey % 13 < 3 THEN o_orderkey % 13 + 2 ELSE 1 END] AS exc,
  o_orderkey % 19 = 0 AS conditional, o_orderkey % 23 = 0 AS hours, CASE WHEN o_orderkey % 29 = 0 THEN 'no_right_turn' END AS mc, CASE WHEN o_orderkey % 31 = 0 THEN 'only_straight_on' END AS mv,
  CASE WHEN o_orderkey % 11 <> 0 THEN (['no_left_turn', 'only_u_turn', 'no_entry', 'no_parking', 'no_exit'])[o_orderkey % 5 + 1] END AS general FROM orders),
rm AS (SELECT l_orderkey AS id, count(*) FILTER (l_returnflag = 'A' AND l_linenumber % 6 <> 0) AS n_from, count(*) FILTER (l_returnflag = 'R' AND l_linenumber % 6 <> 0) AS n_to, count(*) FILTER (l_returnflag = 'N') AS n_via, count(*) FILTER (l_returnflag = 'N' AND l_linenumber % 6 = 0) AS n_via_way, min(l_partkey) FILTER (l_returnflag = 'N') AS via FROM lineitem GROUP BY l_orderkey)"""


@query(f"""WITH {RULE_TAGS}, x AS (SELECT rt.*, coalesce(mc, mv, general) AS value, coalesce(n_from, 0) AS n_from, coalesce(n_to, 0) AS n_to, coalesce(n_via, 0) AS n_via, coalesce(n_via_way, 0) AS n_via_way, via FROM rt LEFT JOIN rm USING (id)),
y AS (SELECT *, CASE WHEN type <> 'restriction' THEN 'not_a_restriction' WHEN exc IN ('motorcycle ; bus', 'psv;vehicle') THEN 'excepted_mode' WHEN conditional OR hours THEN 'conditional_not_evaluated' WHEN value IS NULL THEN 'for_another_mode'
  WHEN n_from = 0 OR n_to = 0 OR n_via = 0 OR value NOT IN ('no_left_turn', 'no_right_turn', 'no_straight_on', 'no_u_turn', 'no_entry', 'no_exit', 'only_left_turn', 'only_right_turn', 'only_straight_on', 'only_u_turn') THEN 'unsupported_or_malformed' WHEN n_via <> 1 OR n_via_way > 0 THEN 'via_way' ELSE 'via_node' END AS reason FROM x)
SELECT id AS restriction_id, CASE WHEN reason IN ('not_a_restriction', 'excepted_mode', 'for_another_mode') THEN 'not_applicable' WHEN reason = 'via_node' THEN 'candidate' ELSE 'review_required' END AS status, reason, CASE WHEN reason IN ('unsupported_or_malformed', 'via_way', 'via_node') THEN value END AS value, CASE WHEN reason = 'via_node' THEN via END AS via_node FROM y""")
def restriction_parse(spark, sf_dir):
    """Turn restrictions of tags and members: exceptions, conditions, the value of the first mode that has one, roles; with the reason."""
    k = F.col("o_orderkey")
    tag = lambda name, condition, value: F.when(condition, F.struct(F.lit(name).alias("key"), value.alias("value")))
    general = F.element_at(F.array(*map(F.lit, ("no_left_turn", "only_u_turn", "no_entry", "no_parking", "no_exit"))), (k % 5 + 1).cast("int"))
    exceptions = F.element_at(F.array(*map(F.lit, ("bicycle", "motorcycle ; bus", "psv;vehicle"))), F.least(k % 13 + 1, F.lit(3)).cast("int"))
    pairs = [
        tag("type", F.lit(True), F.when(k % 17 == 0, "route").otherwise("restriction")), tag("except", k % 13 < 3, exceptions), tag("restriction:conditional", k % 19 == 0, F.lit("no_left_turn @ (Mo-Fr)")), tag("hour_on", k % 23 == 0, F.lit("07:00")),
        tag("restriction:motorcycle", k % 29 == 0, F.lit("no_right_turn")), tag("restriction:motor_vehicle", k % 31 == 0, F.lit("only_straight_on")), tag("restriction", k % 11 != 0, general),
    ]
    tags = table(spark, sf_dir, "orders").select(k.alias("restriction_id"), F.map_from_entries(F.array_compact(F.array(*pairs))).alias("tags"))
    role = F.when(F.col("l_returnflag") == "A", "from").when(F.col("l_returnflag") == "R", "to").otherwise("via")
    way = F.when(F.col("l_returnflag") == "N", F.col("l_linenumber") % 6 == 0).otherwise(F.col("l_linenumber") % 6 != 0)
    members = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(role.alias("role"), F.when(way, "way").otherwise("node").alias("type"), F.col("l_partkey").alias("ref"))).alias("members"))
    rows = tags.join(members, F.col("restriction_id") == F.col("id"), "left")
    spec = n.restriction_spec(F.col("tags"), F.coalesce("members", F.array().cast(members.schema["members"].dataType)))
    return rows.select("restriction_id", spec.alias("s")).select("restriction_id", "s.*")


@query(f"WITH {TAGS}, bad AS (SELECT DISTINCT l_partkey AS way_id FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 7) SELECT w.way_id, CASE WHEN b.way_id IS NOT NULL AND status <> 'excluded' THEN 'review_required' ELSE status END AS status FROM ways w LEFT JOIN bad b USING (way_id)")
def review_propagation(spark, sf_dir):
    bad = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_linenumber = 7").select(F.col("l_partkey").alias("bad")).distinct()
    rows = tagged(spark, sf_dir).select("way_id", n.way_status(F.col("tags")).alias("s")).join(bad, F.col("way_id") == F.col("bad"), "left")
    return rows.select("way_id", F.when(F.col("bad").isNotNull() & (F.col("s") != "excluded"), "review_required").otherwise(F.col("s")).alias("status"))


REFS = """refs AS (SELECT l_suppkey AS way_id, l_partkey AS node_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS pos FROM lineitem),
usage AS (SELECT node_id, count(*) AS n, count(DISTINCT way_id) AS ways FROM refs GROUP BY node_id)"""


def refs(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")) - 1
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("way_id"), F.col("l_partkey").alias("node_id"), rank.cast("long").alias("pos"))


@query(f"WITH {REFS} SELECT node_id, n, ways FROM usage")
def node_usage(spark, sf_dir):
    return refs(spark, sf_dir).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("way_id").alias("ways"))


@query(f"""WITH {REFS}, c AS (SELECT r.*, max(pos) OVER (PARTITION BY way_id) AS last, node_id % 3 = 0 AS cut FROM refs r), e AS (SELECT * FROM c WHERE pos = 0 OR pos = last OR cut),
s AS (SELECT way_id, pos AS start_index, lead(pos) OVER w AS end_index, node_id AS from_node, lead(node_id) OVER w AS to_node FROM e WINDOW w AS (PARTITION BY way_id ORDER BY pos)) SELECT * FROM s WHERE end_index IS NOT NULL""")
def way_split(spark, sf_dir):
    return n.split_ways(refs(spark, sf_dir).withColumn("cut", F.col("node_id") % 3 == 0))


@query(f"WITH {REFS} SELECT node_id, count(DISTINCT way_id % 4) AS n_levels FROM refs WHERE pos > 0 GROUP BY node_id HAVING count(DISTINCT way_id % 4) > 1")
def level_conflicts(spark, sf_dir):
    return refs(spark, sf_dir).filter("pos > 0").groupBy("node_id").agg(F.count_distinct(F.col("way_id") % 4).alias("n_levels")).filter("n_levels > 1")


@query(f"WITH {ARCS}, u AS (SELECT from_node AS a, 10000000 + to_node AS b FROM arcs), both_ways AS (SELECT a, b FROM u UNION SELECT b, a FROM u) SELECT a AS node_id, count(*) AS degree FROM both_ways GROUP BY a HAVING count(*) >= 3")
def junction_degree(spark, sf_dir):
    u = passes(spark, sf_dir).select(F.col("from_node").alias("a"), (F.col("to_node") + 10000000).alias("b"))
    return dealt(u.union(u.select("b", "a")), "a").distinct().groupBy(F.col("a").alias("node_id")).agg(F.count(F.lit(1)).alias("degree")).filter("degree >= 3")


@query(f"WITH {ARCS}, u AS (SELECT from_node AS a, to_node AS b FROM arcs) SELECT a, b FROM u UNION SELECT b, a FROM u")
def undirected_edge_union(spark, sf_dir):
    u = passes(spark, sf_dir).select(F.col("from_node").alias("a"), F.col("to_node").alias("b"))
    return dealt(u.union(u.select("b", "a")), "a", "b").distinct()


@query(f"WITH {ARCS} SELECT from_node, to_node FROM arcs WHERE to_node NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def dangling_endpoint_anti_join(spark, sf_dir):
    known = table(spark, sf_dir, "part").filter("p_size > 5").select(F.col("p_partkey").alias("to_node"))
    return arcs(spark, sf_dir).join(known, "to_node", "left_anti").select("from_node", "to_node")


@query("""WITH a AS (SELECT DISTINCT c_custkey AS arc_id, c_nationkey AS from_node, (c_nationkey + c_custkey) % 25 AS to_node FROM customer), r AS (SELECT o_orderkey AS restriction_id, o_custkey AS from_arc, o_custkey % 97 + 1 AS to_arc, CAST(o_orderkey % 25 AS BIGINT) AS via FROM orders)
SELECT r.restriction_id FROM r JOIN a x ON x.arc_id = r.from_arc JOIN a y ON y.arc_id = r.to_arc WHERE x.to_node <> y.from_node OR x.to_node <> r.via""")
def turn_rule_integrity_join(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("arc_id"), F.col("c_nationkey").alias("from_node"), ((F.col("c_nationkey") + F.col("c_custkey")) % 25).alias("to_node")).distinct()
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("restriction_id"), F.col("o_custkey").alias("from_arc"), (F.col("o_custkey") % 97 + 1).alias("to_arc"), (F.col("o_orderkey") % 25).alias("via"))
    x, y = a.select(F.col("arc_id").alias("from_arc"), F.col("to_node").alias("end")), a.select(F.col("arc_id").alias("to_arc"), F.col("from_node").alias("start"))
    return r.join(x, "from_arc").join(y, "to_arc").filter("end <> start or end <> via").select("restriction_id")


GRAPH = """big AS (SELECT greatest(count(*) // 3, 1) AS m FROM customer), a AS (SELECT c_custkey AS arc_id, c_custkey % m AS from_node, (c_custkey * 7 + 3) % m AS to_node FROM customer, big), r AS (SELECT o_orderkey AS restriction_id, o_custkey AS from_arc, (o_custkey * 7 + 3) % m + m * (o_orderkey % 3) AS to_arc, CASE WHEN o_orderkey % 9 = 0 THEN 'only' ELSE 'no' END AS kind FROM orders, big WHERE o_orderkey % 4 < 2),
m AS (SELECT x.arc_id AS from_arc, y.arc_id AS to_arc FROM a x JOIN a y ON x.to_node = y.from_node), o AS (SELECT from_arc, restriction_id, list(DISTINCT to_arc) AS s FROM r WHERE kind = 'only' GROUP BY ALL),
legal AS (SELECT m.* FROM m WHERE NOT EXISTS (SELECT 1 FROM r WHERE kind = 'no' AND r.from_arc = m.from_arc AND r.to_arc = m.to_arc) AND NOT EXISTS (SELECT 1 FROM o WHERE o.from_arc = m.from_arc AND NOT list_contains(o.s, m.to_arc)))"""


def graph(spark, sf_dir):
    """Customers as arcs between a third as many nodes, so about three arcs meet at a node; half of the orders as turn rules."""
    k, o, c = F.col("c_custkey"), F.col("o_orderkey"), F.col("o_custkey")
    customers = table(spark, sf_dir, "customer")
    m = customers.agg(F.greatest(F.floor(F.count(F.lit(1)) / 3), F.lit(1)).alias("m")).scalar()
    a = customers.select(k.alias("arc_id"), (k % m).alias("from_node"), ((k * 7 + 3) % m).alias("to_node"), F.lit(1.0).alias("length_m"))
    r = table(spark, sf_dir, "orders").filter(o % 4 < 2).select(o.alias("restriction_id"), c.alias("from_arc"), ((c * 7 + 3) % m + m * (o % 3)).alias("to_arc"), F.when(o % 9 == 0, "only").otherwise("no").alias("kind"))
    return a, r


@query(f"WITH {GRAPH} SELECT from_arc, to_arc FROM legal")
def turn_aware_successors(spark, sf_dir):
    return n.successors(*graph(spark, sf_dir))


@query(f"""WITH {GRAPH}, w AS (SELECT o_custkey AS route_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, (o_orderkey * 7 + 3) % 1500 + 1 AS arc_id FROM orders), s AS (SELECT *, lag(arc_id) OVER (PARTITION BY route_id ORDER BY pos) AS before FROM w),
bad AS (SELECT route_id, min(pos) AS first_bad FROM s WHERE before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM legal l WHERE l.from_arc = s.before AND l.to_arc = s.arc_id) GROUP BY route_id)
SELECT r.route_id, CAST(first_bad AS BIGINT) AS first_bad FROM (SELECT DISTINCT route_id FROM w) r LEFT JOIN bad USING (route_id)""")
def walk_validation(spark, sf_dir):
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    w = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("route_id"), pos.alias("pos"), ((F.col("o_orderkey") * 7 + 3) % 1500 + 1).alias("arc_id"))
    return n.check_walks(w, n.successors(*graph(spark, sf_dir)))


@query(f"WITH {GRAPH}, used AS (SELECT from_node AS n FROM a WHERE arc_id % 2 = 0 UNION SELECT to_node FROM a WHERE arc_id % 2 = 0) SELECT (SELECT count(*) FROM a WHERE arc_id % 2 = 0) AS n_arcs, (SELECT count(*) FROM used) AS n_nodes, (SELECT count(*) FROM r WHERE from_arc % 2 = 0) AS n_rules")
def graph_export(spark, sf_dir):
    a, r = graph(spark, sf_dir)
    road = a.filter("arc_id % 2 = 0")
    nodes = road.select("from_node").union(road.select("to_node")).distinct()
    rules = r.filter("from_arc % 2 = 0")
    n_of = lambda df, name: df.agg(F.count(F.lit(1)).alias(name)).select(name).scalar().alias(name)
    return spark.range(1).select(n_of(road, "n_arcs"), n_of(nodes, "n_nodes"), n_of(rules, "n_rules"))


@query("""WITH first AS (SELECT c_custkey AS node, c_custkey - c_custkey % 10 AS component FROM customer) SELECT node, component FROM first WHERE node % 10 <> 0 OR node IN (SELECT c_custkey - 1 FROM customer) OR node IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 1000000000 + o_orderkey, o_custkey - o_custkey % 10 FROM orders""")
def weak_components(spark, sf_dir):
    """Customers in chains of ten, each with its orders; what the graph's rule gives at once, the edges must yield."""
    k = F.col("c_custkey")
    chain = table(spark, sf_dir, "customer").filter(k % 10 != 0).select((k - 1).alias("a"), k.alias("b"))
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), (F.lit(1000000000) + F.col("o_orderkey")).alias("b"))
    return n.weak_components(chain.unionByName(own))


@query("SELECT l_partkey AS way_id, string_agg(DISTINCT l_shipmode_like, ',' ORDER BY l_shipmode_like) AS tiles FROM (SELECT l_partkey, l_returnflag || l_linestatus AS l_shipmode_like FROM lineitem) GROUP BY l_partkey")
def tile_provenance_join(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("way_id"), F.concat("l_returnflag", "l_linestatus").alias("tile"))
    return rows.groupBy("way_id").agg(F.array_join(F.array_sort(F.collect_set("tile")), ",").alias("tiles"))


@query("SELECT l_orderkey AS id, l_linenumber AS version, count(*) - 1 AS n_removed, count(DISTINCT l_partkey) > 1 AS differs FROM lineitem GROUP BY ALL")
def osm_dedupe(spark, sf_dir):
    body = F.sha2(F.col("l_partkey").cast("string"), 256)
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("version")).agg((F.count(F.lit(1)) - 1).alias("n_removed"), (F.count_distinct(body) > 1).alias("differs"))


@query("SELECT count(*) AS n, count(DISTINCT id) AS n_ids FROM (SELECT event_id AS id FROM events UNION ALL SELECT o_orderkey FROM orders)")
def tile_union(spark, sf_dir):
    ids = table(spark, sf_dir, "events").select(F.col("event_id").alias("id")).unionByName(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")))
    return ids.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"))


@query("SELECT p_partkey AS unit FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 10")
def unassigned_units(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").filter("l_quantity > 10").select(F.col("l_partkey").alias("unit"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("unit")).distinct().join(used, "unit", "left_anti")


@query("""WITH i AS (SELECT p_partkey AS id, lower(trim(p_name)) AS name FROM part), n AS (SELECT name, count(*) AS c, min(id) AS id FROM i GROUP BY name), w AS (SELECT DISTINCT lower(p_name) AS name FROM part WHERE p_size % 2 = 0)
SELECT w.name, CASE WHEN c IS NULL THEN 'absent' WHEN c > 1 THEN 'ambiguous' ELSE 'found' END AS outcome, CASE WHEN c = 1 THEN n.id END AS id FROM w LEFT JOIN n USING (name)""")
def name_resolution_join(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    known = p.groupBy(F.lower(F.trim("p_name")).alias("known")).agg(F.count(F.lit(1)).alias("c"), F.min("p_partkey").alias("id"))
    wanted = p.filter("p_size % 2 = 0").select(F.lower("p_name").alias("name")).distinct()
    rows = wanted.join(known, F.col("name") == F.col("known"), "left")
    return rows.select("name", F.when(F.col("c").isNull(), "absent").when(F.col("c") > 1, "ambiguous").otherwise("found").alias("outcome"), F.when(F.col("c") == 1, F.col("id")).alias("id"))


@query()
def batch_shortest_paths(spark, sf_dir):
    """Iterative: from every tenth node the least-cost path through two anchors over legal turns; checked by brute force in tests.

    Customers are arcs of cost one to nine, thirty from each node; three arcs in a row of ids are one part.
    """
    from wayloom.operators.lineage import stored

    k = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer")
    m = customers.agg(F.greatest(F.floor(F.count(F.lit(1)) / 30), F.lit(1)).alias("m")).scalar()
    arcs = customers.select(k.alias("arc_id"), m.alias("m")).select("arc_id", "m", F.floor(F.col("arc_id") / 3).alias("part_id"), (F.col("arc_id") % F.col("m")).alias("from_node"), ((F.col("arc_id") * 7 + 31 * F.floor(F.col("arc_id") / F.col("m")) + 3) % F.col("m")).alias("to_node"), (F.col("arc_id") % 9 + 1).cast("double").alias("cost"))
    arcs = stored(arcs)
    o = F.col("from_node")
    problems = stored(arcs.select("from_node", "m").distinct().filter(o % 10 == 0).select(o.alias("problem_id"), o.alias("origin"), F.array((o * 5 + 11) % F.col("m"), (o * 3 + 29) % F.col("m")).alias("anchors")))
    found = n.anchored_paths(arcs, stored(n.successors(arcs, graph(spark, sf_dir)[1])), problems)
    return problems.join(found, "problem_id", "left").select("problem_id", F.round("cost", 3).alias("cost"), F.array_join(F.col("arc_ids").cast("array<string>"), ">").alias("arcs"))
