"""Road network: access rules on tags, directed arcs, turn rules, components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import checkpoint, stored

# Tag keys in order of precedence, access values, and road classes of the rules.
MODES = ("motorcycle", "motor_vehicle", "vehicle", "access")
ONEWAY_KEYS = ("oneway:motorcycle", "oneway:motor_vehicle", "oneway:vehicle", "oneway")
ALLOWED = ("yes", "designated", "permissive")
FORBIDDEN = ("no", "private")
RESTRICTED = ("agricultural", "forestry", "customers", "delivery", "destination", "permit", "discouraged", "use_sidepath")
EXCLUDED_HIGHWAYS = ("motorway", "motorway_link", "footway", "cycleway", "pedestrian", "steps", "bridleway", "path", "construction", "proposed", "platform", "raceway", "corridor")
PROVISIONAL_HIGHWAYS = ("primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "residential", "unclassified", "service", "living_street")
CLASS_OF = {"RC1": ("primary", "primary_link"), "RC2": ("secondary", "secondary_link"), "RC3": ("tertiary", "tertiary_link"), "RC4": ("residential", "unclassified"), "connector": ("service", "living_street")}


def tag(tags: Column, name: str) -> Column:
    return F.lower(F.trim(F.element_at(tags, F.lit(name))))


def first_tag(tags: Column, names: list[str]) -> Column:
    """The first of the names that is tagged, with its value."""
    named = [F.when(F.array_contains(F.map_keys(tags), n), F.struct(F.lit(n).alias("key"), tag(tags, n).alias("value"))) for n in names]
    return F.coalesce(*named)


def access(tags: Column, direction: str | None = None) -> Column:
    """(key, value) of the most specific mode that is tagged; a mode's directional key comes before its plain one."""
    return first_tag(tags, [n for m in MODES for n in ([f"{m}:{direction}", m] if direction else [m])])


def conditional_keys(tags: Column) -> Column:
    """Sorted conditional keys of an access or oneway tag."""
    prefix = "|".join((*MODES, "oneway"))
    return F.array_sort(F.filter(F.map_keys(tags), lambda k: k.rlike(rf"^({prefix})(:.*)?:conditional$")))


def way_class(tags: Column) -> Column:
    highway, out = F.element_at(tags, F.lit("highway")), F.lit("other")
    for name, members in CLASS_OF.items():
        out = F.when(highway.isin(*members), name).otherwise(out)
    return out


def policy_status(tags: Column) -> Column:
    """Status by road class alone: research-excluded classes stay excluded whatever the tags."""
    highway = F.coalesce(F.element_at(tags, F.lit("highway")), F.lit(""))
    base = F.when(highway.isin(*EXCLUDED_HIGHWAYS), "excluded").when(~highway.isin(*PROVISIONAL_HIGHWAYS) | (F.coalesce(tag(tags, "motorroad"), F.lit("")) == "yes"), "review_required").otherwise("provisionally_allowed")
    lanes = F.exists(F.map_keys(tags), lambda k: k.rlike("^(access|motorcycle|motor_vehicle):lanes"))
    return F.when((base != "excluded") & ((F.size(conditional_keys(tags)) > 0) | lanes), "review_required").otherwise(base)


def with_access(status: Column, value: Column) -> Column:
    """A status under an access value: forbidden excludes, anything but allowed asks for review."""
    return F.when(value.isin(*FORBIDDEN), "excluded").when(value.isNotNull() & ~value.isin(*ALLOWED) & (status != "excluded"), "review_required").otherwise(status)


def way_status(tags: Column) -> Column:
    return with_access(policy_status(tags), access(tags)["value"])


def directions(tags: Column) -> Column:
    """Allowed directions by the most specific oneway key; an explicit directional permission of a more specific mode adds one; of an equal one it's a conflict (empty)."""
    found = first_tag(tags, list(ONEWAY_KEYS))
    value = F.coalesce(found["value"], F.when((tag(tags, "junction") == "roundabout") | F.element_at(tags, F.lit("highway")).isin("motorway", "motorway_link"), "yes").otherwise("no"))
    allowed = F.when(value.isin("yes", "1", "true"), F.array(F.lit("forward"))).when(value == "-1", F.array(F.lit("backward"))).when(value.isin("no", "0", "false"), F.array(F.lit("forward"), F.lit("backward"))).otherwise(F.array().cast("array<string>"))
    rank = F.coalesce(F.element_at(F.create_map(*(x for k, r in zip(ONEWAY_KEYS, (0, 1, 2, 2), strict=True) for x in (F.lit(k), F.lit(r)))), found["key"]), F.lit(2))
    out, clash = allowed, F.lit(False)
    for d in ("forward", "backward"):
        more = first_tag(tags, [f"{m}:{d}" for m in MODES])
        level = F.element_at(F.create_map(*(x for i, m in enumerate(MODES) for x in (F.lit(f"{m}:{d}"), F.lit(i)))), more["key"])
        asks = (F.size(allowed) > 0) & ~F.array_contains(allowed, d) & more["value"].isin(*ALLOWED)
        out = F.when(asks & (level < rank), F.array_append(out, F.lit(d))).otherwise(out)
        clash = clash | F.coalesce(asks & (level == rank), F.lit(False))
    return F.when(clash, F.array().cast("array<string>")).otherwise(out)


def node_status(tags: Column) -> Column:
    value = access(tags)["value"]
    barrier = F.element_at(tags, F.lit("barrier"))
    return (
        F.when((tag(tags, "locked") == "yes") | (F.coalesce(F.element_at(tags, F.lit("locked:conditional")), F.lit("")) != ""), "review_required")
        .when(value.isin(*FORBIDDEN), "excluded")
        .when((F.size(conditional_keys(tags)) > 0) | (value.isNotNull() & ~value.isin(*ALLOWED)), "review_required")
        .when((F.coalesce(barrier, F.lit("no")) != "no") & (barrier != "entrance") & ~F.coalesce(value.isin(*ALLOWED), F.lit(False)), "review_required")
        .otherwise("provisionally_allowed")
    )


SEVERITY = {"provisionally_allowed": 0, "review_required": 1, "excluded": 2}


def severity(status: Column) -> Column:
    return F.element_at(F.create_map(*(x for k, v in SEVERITY.items() for x in (F.lit(k), F.lit(v)))), status)


def from_severity(level: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITY)), level + 1)


def reviewed_policy(tags: Column, restricted: Column, clashing: Column) -> Column:
    """Policy status of a way: directions that can't be told, an unresolved restriction, levels that clash and areas ask for review."""
    policy = policy_status(tags)
    asks = (F.size(directions(tags)) == 0) | restricted | clashing | F.coalesce(F.element_at(tags, F.lit("area")) == "yes", F.lit(False))
    return F.when((policy != "excluded") & asks, "review_required").otherwise(policy)


def effective_status(allowed: Column, forward: Column, backward: Column, policy: Column) -> Column:
    """Severity of the mildest status of the allowed directions, each under its own access value; without one to be reviewed, excluded where the policy says so."""
    status = lambda d, value: F.when(F.array_contains(allowed, d), severity(with_access(policy, value)))
    mildest = F.coalesce(F.least(status("forward", forward), status("backward", backward)), F.lit(SEVERITY["review_required"]))
    return F.when(policy == "excluded", SEVERITY["excluded"]).otherwise(mildest)


def level_clashes(refs: DataFrame, levels: DataFrame) -> DataFrame:
    """way_id of the ways with an inner node at which inner nodes of ways on other levels lie.

    refs: way_id, pos, node_id; levels: way_id, level (layer, bridge and tunnel as one value).
    """
    own = Window.partitionBy("way_id")
    inner = refs.withColumns({"first": F.min("pos").over(own), "last": F.max("pos").over(own)}).filter("pos > first and pos < last").select("way_id", "node_id").distinct()
    clash = inner.join(levels, "way_id").groupBy("node_id").agg(F.min("level").alias("a"), F.max("level").alias("b")).filter("a <> b").select("node_id")
    return inner.join(clash, "node_id", "left_semi").select("way_id").distinct()


def segment_status(own: DataFrame, ways: DataFrame) -> DataFrame:
    """segment_id and status: each way of a segment is decided under the worst of its own policy and of the segment's nodes; the worst way counts.

    own: segment_id, way_id; ways: way_id, tags, policy (reviewed_policy), node (node_status of the node of that number).
    A node changes a way's status only by making its policy one to be reviewed, or excluded, so both are told beforehand.
    """
    review = F.when(F.col("policy") == "excluded", "excluded").otherwise("review_required")
    # Columns of their own first: written into each other, the rules are worked out many times over.
    told = ways.select("way_id", "policy", severity(F.col("node")).alias("node"), review.alias("held"), directions(F.col("tags")).alias("allowed"), *(access(F.col("tags"), d)["value"].alias(d) for d in ("forward", "backward")))
    told = told.select("way_id", "node", *(effective_status(F.col("allowed"), F.col("forward"), F.col("backward"), F.col(p)).alias(name) for name, p in (("clear", "policy"), ("review", "held"))))
    worst = own.join(told, "way_id").groupBy("segment_id").agg(*(F.max(c).alias(c) for c in ("node", "clear", "review")))
    level = F.when(F.col("node") == SEVERITY["excluded"], F.col("node")).when(F.col("node") == SEVERITY["review_required"], F.col("review")).otherwise(F.col("clear"))
    return worst.select("segment_id", from_severity(level).alias("status"))


# Tag keys by mode, and the turn values that the rules know.
RESTRICTION_KEYS = ("restriction:motorcycle", "restriction:motor_vehicle", "restriction:vehicle", "restriction")
EXCEPTED = ("motorcycle", "motor_vehicle", "vehicle")
HOUR_KEYS = ("day_on", "day_off", "hour_on", "hour_off")
TURN_VALUES = ("no_left_turn", "no_right_turn", "no_straight_on", "no_u_turn", "no_entry", "no_exit", "only_left_turn", "only_right_turn", "only_straight_on", "only_u_turn")


def restriction_spec(tags: Column, members: Column) -> Column:
    """struct(status, reason, value, via_node) of a relation by its tags (map) and members (array of role, type, ref).

    Not applicable: no restriction, this mode excepted, or a value for other modes only. To be reviewed: conditions and
    hours, unknown values or missing roles, a via that isn't one node. What is left is a candidate rule at its node.
    """
    tokens = F.transform(F.split(F.coalesce(tags["except"], F.lit("")), ";"), lambda x: F.trim(x))
    conditional = F.exists(F.map_keys(tags), lambda x: (x.startswith("restriction") & x.endswith(":conditional")) | x.isin(*HOUR_KEYS))
    value = F.coalesce(*(tags[x] for x in RESTRICTION_KEYS))
    ways = lambda role: F.filter(members, lambda m: (m["role"] == role) & (m["type"] == "way"))
    via = F.filter(members, lambda m: m["role"] == "via")
    malformed = (F.size(ways("from")) == 0) | (F.size(ways("to")) == 0) | (F.size(via) == 0) | ~value.isin(*TURN_VALUES)
    one_node = (F.size(via) == 1) & (via[0]["type"] == "node")
    reason = F.when(~tags["type"].eqNullSafe(F.lit("restriction")), "not_a_restriction").when(F.arrays_overlap(tokens, F.array(*map(F.lit, EXCEPTED))), "excepted_mode").when(conditional, "conditional_not_evaluated")
    reason = reason.when(value.isNull(), "for_another_mode").when(malformed, "unsupported_or_malformed").when(~one_node, "via_way").otherwise("via_node")
    status = lambda r: F.when(r.isin("not_a_restriction", "excepted_mode", "for_another_mode"), "not_applicable").when(r == "via_node", "candidate").otherwise("review_required")
    told = lambda r: F.when(r.isin("unsupported_or_malformed", "via_way", "via_node"), value)
    return F.transform(F.array(reason), lambda r: F.struct(status(r).alias("status"), r.alias("reason"), told(r).alias("value"), F.when(r == "via_node", F.get(via, F.lit(0))["ref"]).alias("via_node")))[0]


def split_ways(refs: DataFrame) -> DataFrame:
    """Segments of ways, cut at inner cut nodes. refs: way_id, pos, node_id, cut. One row a segment: way_id, start_index, end_index, from_node, to_node."""
    order = Window.partitionBy("way_id").orderBy("pos")
    last = F.max("pos").over(Window.partitionBy("way_id"))
    ends = refs.filter("true").withColumn("last", last).filter((F.col("pos") == 0) | (F.col("pos") == F.col("last")) | F.col("cut"))
    nxt = F.lead(F.struct("pos", "node_id")).over(order)
    return ends.withColumn("next", nxt).filter("next is not null").select("way_id", F.col("pos").alias("start_index"), F.col("next.pos").alias("end_index"), F.col("node_id").alias("from_node"), F.col("next.node_id").alias("to_node"))


def successors(arcs: DataFrame, rules: DataFrame) -> DataFrame:
    """Legal next arcs: they meet at a node, no `no` rule forbids them, and every `only` set of the first holds them.

    arcs: arc_id, from_node, to_node; rules: restriction_id, from_arc, to_arc, kind (no, only).
    """
    a = arcs.select(F.col("arc_id").alias("from_arc"), F.col("to_node").alias("n"))
    b = arcs.select(F.col("arc_id").alias("to_arc"), F.col("from_node").alias("n"))
    meets = a.join(b, "n").select("from_arc", "to_arc")
    legal = meets.join(rules.filter("kind = 'no'").select("from_arc", "to_arc"), ["from_arc", "to_arc"], "left_anti")
    only = rules.filter("kind = 'only'").groupBy("from_arc", "restriction_id").agg(F.collect_set("to_arc").alias("s")).groupBy("from_arc").agg(F.collect_list("s").alias("sets"))
    return legal.join(only, "from_arc", "left").filter(F.col("sets").isNull() | F.forall("sets", lambda s: F.array_contains(s, F.col("to_arc")))).select("from_arc", "to_arc")


def check_walks(walks: DataFrame, legal: DataFrame) -> DataFrame:
    """First illegal step of each walk (null: none). walks: route_id, pos, arc_id."""
    before = F.lag("arc_id").over(Window.partitionBy("route_id").orderBy("pos"))
    steps = walks.withColumn("from_arc", before).filter("from_arc is not null")
    wrong = steps.join(legal, (steps.from_arc == legal.from_arc) & (steps.arc_id == legal.to_arc), "left_anti").groupBy("route_id").agg(F.min("pos").alias("first_bad"))
    return walks.select("route_id").distinct().join(wrong, "route_id", "left")


def weak_components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) by contraction: each round a node moves to the one of least hash among itself and its neighbours.

    The hash is another one each round, so a share of the nodes goes whatever the graph's shape, and rounds grow with
    the logarithm of the nodes. Moves are then followed back from the last round, and each group takes its least node.
    """
    current = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    moves = []
    while not moves or not current.isEmpty():
        ranked = lambda c, turn=len(moves): F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("to"))
        both = current.select(F.col("a").alias("node"), ranked("b").alias("x")).union(current.select(F.col("b").alias("node"), ranked("a").alias("x")))
        move = stored(both.groupBy("node").agg(F.min("x").alias("x")).select("node", F.least("x", ranked("node"))["to"].alias("to")))
        moves.append(move)
        x, y = move.select(F.col("node").alias("a"), F.col("to").alias("ta")), move.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        current = stored(current.join(x, "a").join(y, "b").filter("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    labels = moves.pop()
    while moves:
        further = labels.select(F.col("node").alias("old"), F.col("to").alias("further"))
        labels = stored(moves.pop().join(further, F.col("to") == F.col("old"), "left").select("node", F.coalesce("further", "to").alias("to")))
    least = labels.groupBy("to").agg(F.min("node").alias("component"))
    return labels.join(least, "to").select("node", "component")


# Fixed value: arcs that leave a radius, for each label within it (by order of magnitude).
LEAVING = 4


def no_paths(arcs: DataFrame, problems: DataFrame) -> DataFrame:
    return problems.select("problem_id", F.lit(0.0).alias("cost"), F.array().cast(f"array<{arcs.schema['arc_id'].dataType.simpleString()}>").alias("arc_ids")).limit(0)


def cheapest(rows: DataFrame, *key: str) -> DataFrame:
    """The row of least cost of each key; of equal costs the one of the least path."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("cost", "path")).alias("b")).select(*key, "b.*")


def turn_bans(net: DataFrame, legal: DataFrame) -> DataFrame:
    """Pairs of arcs that meet but mustn't follow each other, of arcs that have a successor at all; (from_arc, to_arc)."""
    x = net.filter("goes").select(F.col("arc_id").alias("from_arc"), F.col("part_id").alias("last_part"), F.col("to_node").alias("n"))
    y = net.select(F.col("arc_id").alias("to_arc"), "part_id", F.col("from_node").alias("n"))
    told = legal.select("from_arc", "to_arc", F.lit(True).alias("told"))
    return x.join(y, "n").join(told, ["from_arc", "to_arc"], "left").filter("told IS NULL OR part_id = last_part").select("from_arc", "to_arc")


def anchored_paths(arcs: DataFrame, legal: DataFrame, problems: DataFrame, once: bool = False) -> DataFrame:
    """The least-cost path of each problem from its origin through its anchors in order; (problem_id, cost, arc_ids).

    arcs: arc_id, part_id, from_node, to_node, cost (above zero); legal: from_arc, to_arc, which meet at a node; problems:
    problem_id, origin, anchors (array of nodes, one at least, in the order they are passed). A part isn't used twice in a
    row; with once it isn't used twice at all. Problems without a path have no row; of equal costs the least list of arcs
    counts.

    A leg leads from one anchor to the next. It is searched from both ends: labels ahead are least costs from its start
    to an arc (by first arc, as the turn at the start needs it), labels back those from an arc to its goal (by last arc).
    A step widens one end's radius, that of the fewer labels, and writes only labels between the old and the new one.
    Walks no dearer than both radii together have one arc that leaves the first, and behind it a label back: all of them
    are found. A leg rests when no walk of it that isn't found can be part of a path as cheap as the best one joined from
    the legs' walks. So labels of a problem are those near its anchors, about the square root of the arcs where a node
    leads everywhere in few steps.
    """
    if once:
        return simple_paths(arcs, legal, problems)
    goes = legal.select(F.col("from_arc").alias("arc_id"), F.lit(True).alias("goes")).distinct()
    net = stored(arcs.select("arc_id", "part_id", "from_node", "to_node", F.col("cost").cast("double").alias("step")).join(goes, "arc_id", "left").withColumn("goes", F.col("goes").isNotNull()))
    size = net.agg(F.min("step").alias("least"), F.max("step").alias("most"), F.min("arc_id").alias("any"), (F.count_distinct("from_node") / F.count(F.lit(1))).alias("share")).first()
    legs_most = problems.agg(F.max(F.size("anchors"))).first()[0]
    if size["any"] is None or not legs_most:
        return no_paths(arcs, problems)
    # a step lets a node pass on about two of its arcs
    width = net.agg(F.percentile_approx("step", F.lit(min(1.0, 2 * size["share"])), F.lit(1000))).first()[0]
    banned = stored(turn_bans(net, legal))
    key, leg_key = ["problem_id", "leg", "back", "tie", "arc_id"], ["problem_id", "leg"]
    unbound = F.lit(size["any"]).cast(arcs.schema["arc_id"].dataType)

    def permitted(rows: DataFrame, first: str, then: str) -> DataFrame:
        return rows.join(banned.select(F.col("from_arc").alias(first), F.col("to_arc").alias(then)), [first, then], "left_anti")

    legs = problems.select("problem_id", "origin", "anchors", F.posexplode("anchors").alias("leg", "goal"))
    legs = legs.select("problem_id", "leg", F.when(F.col("leg") == 0, F.col("origin")).otherwise(F.get("anchors", F.col("leg") - 1)).alias("start"), "goal", (F.col("leg") == F.size("anchors") - 1).alias("last"))
    ways = net.select(F.lit(False).alias("back"), F.col("from_node").alias("at"), F.col("arc_id").alias("next_arc"), F.col("to_node").alias("next_node"), "step", F.col("goes").alias("next_goes"))
    ways = ways.unionByName(net.filter("goes").select(F.lit(True).alias("back"), F.col("to_node").alias("at"), F.col("arc_id").alias("next_arc"), F.col("from_node").alias("next_node"), "step", F.col("goes").alias("next_goes")))
    ahead = legs.join(net, F.col("start") == F.col("from_node")).select(*leg_key, F.lit(False).alias("back"), F.when(F.col("leg") > 0, F.col("arc_id")).otherwise(unbound).alias("tie"), "arc_id", F.col("to_node").alias("node"), "goes", F.col("step").alias("cost"), F.array("arc_id").alias("path"))
    behind = legs.join(net, F.col("goal") == F.col("to_node")).filter("last OR goes").select(*leg_key, F.lit(True).alias("back"), F.when(~F.col("last"), F.col("arc_id")).otherwise(unbound).alias("tie"), "arc_id", F.col("from_node").alias("node"), F.lit(True).alias("goes"), F.col("step").alias("cost"), F.array("arc_id").alias("path"))
    seeds = stored(ahead.unionByName(behind))
    tops = seeds.groupBy(*leg_key).agg(F.max(F.when(~F.col("back"), F.col("cost"))).alias("seed_ahead"), F.max(F.when(F.col("back"), F.col("cost"))).alias("seed_behind"))
    state = stored(legs.join(tops, leg_key, "left").select("*", F.lit(0).alias("ahead"), F.lit(0).alias("behind"), F.lit(0).cast("long").alias("n_ahead"), F.lit(0).cast("long").alias("n_behind"), F.lit(0.0).alias("top_ahead"), F.lit(0.0).alias("top_behind"), (F.col("seed_ahead").isNotNull() & F.col("seed_behind").isNotNull()).alias("active")))
    # whole problems rest from the start if one of their legs has no first or no last arc
    feasible = state.groupBy("problem_id").agg(F.min("active").alias("active"))
    state = stored(state.drop("active").join(feasible, "problem_id"))

    def grown(labels: DataFrame) -> DataFrame:
        """Labels (with the radii of their legs) one arc further, between the radii."""
        rows = labels.filter("goes").join(ways, (F.col("node") == F.col("at")) & (labels["back"] == ways["back"])).drop(ways["back"]).withColumn("cost", F.col("cost") + F.col("step")).filter("cost > low AND cost <= high")
        rows = rows.withColumn("from_arc", F.when(F.col("back"), F.col("next_arc")).otherwise(F.col("arc_id"))).withColumn("to_arc", F.when(F.col("back"), F.col("arc_id")).otherwise(F.col("next_arc")))
        path = F.when(F.col("back"), F.array_prepend("path", F.col("next_arc"))).otherwise(F.array_append("path", F.col("next_arc")))
        return permitted(rows, "from_arc", "to_arc").select(*leg_key, "back", "tie", F.col("next_arc").alias("arc_id"), F.col("next_node").alias("node"), F.col("next_goes").alias("goes"), "cost", path.alias("path"))

    labels: DataFrame | None = None
    found: DataFrame | None = None
    whole: DataFrame | None = None
    while not state.filter("active").isEmpty():
        # labels ahead count more: those arcs that leave their radius are looked up as well
        back = F.col("n_behind") <= LEAVING * F.col("n_ahead") + LEAVING
        low = F.when(F.col("back"), F.col("behind")).otherwise(F.col("ahead"))
        turns = state.filter("active").withColumn("back", back).withColumn("step_ahead", F.col("ahead") + (~F.col("back")).cast("int"))
        turns = stored(turns.select(*leg_key, "goal", "last", "back", (low * F.lit(width)).alias("low"), ((low + 1) * F.lit(width)).alias("high"), (F.col("step_ahead") * F.lit(width)).alias("radius_ahead"), ((F.col("ahead") + F.col("behind") + 1) * F.lit(width)).alias("total")))
        own = turns.select(*leg_key, "back", "low", "high")
        fresh = seeds.join(own, [*leg_key, "back"]).filter("cost > low AND cost <= high").drop("low", "high")
        if labels is not None:
            near = labels.join(own, [*leg_key, "back"])
            fresh = fresh.unionByName(grown(near.filter(F.col("cost") > F.col("low") - F.lit(size["most"]))))
            fresh = cheapest(fresh, *key).join(near.select(*key), key, "left_anti")
        else:
            fresh = cheapest(fresh, *key)
        fresh = stored(fresh)
        changed = fresh
        while width > size["least"] and not changed.isEmpty():
            # within a wide step labels may lead to others of the same step
            further = grown(changed.join(own, [*leg_key, "back"]))
            if labels is not None:
                further = further.join(near.select(*key), key, "left_anti")
            better = stored(cheapest(fresh.unionByName(further), *key))
            known = fresh.select(*key, F.struct("cost", "path").alias("known"))
            changed = stored(better.join(known, key, "left").filter(F.col("known").isNull() | (F.struct("cost", "path") < F.col("known"))).drop("known"))
            fresh = better
        labels = fresh if labels is None else labels.unionByName(fresh)
        # walks of both radii together: the arc that leaves the first radius, then the goal or a label back
        place = turns.select(*leg_key, "goal", "last", "radius_ahead", "total")
        first = seeds.filter("NOT back").join(place, leg_key).select(*leg_key, "goal", "last", "radius_ahead", "total", "tie", F.lit(None).cast(arcs.schema["arc_id"].dataType).alias("before"), F.col("arc_id").alias("mid"), F.col("node").alias("mid_node"), F.col("goes").alias("mid_goes"), "cost", "path")
        inner = labels.filter("NOT back AND goes").join(place, leg_key).filter(F.col("cost") > F.col("radius_ahead") - F.lit(size["most"]))
        inner = inner.join(ways.filter("NOT back").drop("back"), F.col("node") == F.col("at")).select(*leg_key, "goal", "last", "radius_ahead", "total", "tie", F.col("arc_id").alias("before"), F.col("next_arc").alias("mid"), F.col("next_node").alias("mid_node"), F.col("next_goes").alias("mid_goes"), (F.col("cost") + F.col("step")).alias("cost"), F.array_append("path", F.col("next_arc")).alias("path"))
        leaving = first.unionByName(inner).filter("cost > radius_ahead AND cost <= total")
        ends = leaving.filter("mid_node = goal AND (last OR mid_goes)").select(*leg_key, F.col("tie").alias("first_arc"), F.when(F.col("last"), unbound).otherwise(F.col("mid")).alias("last_arc"), "last", "before", "mid", F.lit(None).cast(arcs.schema["arc_id"].dataType).alias("after"), "cost", "path")
        rest = labels.filter("back").join(turns.select(*leg_key), leg_key).select(*leg_key, F.col("tie").alias("last_arc"), F.col("arc_id").alias("after"), F.col("node").alias("mid_node"), F.col("cost").alias("rest_cost"), F.col("path").alias("rest_path"))
        mids = leaving.filter(F.col("mid_goes") & (F.col("cost") + F.lit(size["least"]) <= F.col("total"))).join(rest, [*leg_key, "mid_node"]).filter("cost + rest_cost <= total").select(*leg_key, F.col("tie").alias("first_arc"), "last_arc", "last", "before", "mid", "after", (F.col("cost") + F.col("rest_cost")).alias("cost"), F.concat("path", "rest_path").alias("path"))
        walks = permitted(permitted(ends.unionByName(mids), "before", "mid"), "mid", "after").select(*leg_key, "first_arc", "last_arc", "last", "cost", "path")
        found = stored(cheapest(walks if found is None else found.unionByName(walks), *leg_key, "first_arc", "last_arc"))
        # the legs' walks joined at the anchors
        joined = found.filter("leg = 0").select("problem_id", "last_arc", "last", "cost", "path")
        done = [joined.filter("last")]
        for leg in range(1, legs_most):
            nxt = found.filter(F.col("leg") == leg).select("problem_id", "first_arc", F.col("last_arc").alias("new_last"), F.col("last").alias("new_end"), F.col("cost").alias("more"), F.col("path").alias("onward"))
            joined = permitted(joined.filter("NOT last").join(nxt, "problem_id"), "last_arc", "first_arc").select("problem_id", F.col("new_last").alias("last_arc"), F.col("new_end").alias("last"), (F.col("cost") + F.col("more")).alias("cost"), F.concat("path", "onward").alias("path"))
            joined = cheapest(joined, "problem_id", "last_arc", "last")
            done.append(joined.filter("last"))
        whole = stored(cheapest(reduce(DataFrame.unionByName, done).select("problem_id", "cost", "path"), "problem_id"))
        state = stored(rested(state, turns, fresh, found, whole, width, size["most"]))
    if whole is None:
        return no_paths(arcs, problems)
    return whole.select("problem_id", "cost", F.col("path").alias("arc_ids"))


def rested(state: DataFrame, turns: DataFrame, fresh: DataFrame, found: DataFrame, whole: DataFrame, width: float, most: float) -> DataFrame:
    """The legs after a step: which of them still have to widen. One rests if it can't give a cheaper path, or is walked out at one end."""
    leg_key = ["problem_id", "leg"]
    of = lambda back, value: F.when(F.col("back") if back else ~F.col("back"), value)
    alive = F.when(F.col("goes"), F.col("cost"))
    grew = fresh.groupBy(*leg_key).agg(F.max(of(False, alive)).alias("new_ahead"), F.max(of(True, alive)).alias("new_behind"), F.count(of(False, 1)).alias("more_ahead"), F.count(of(True, 1)).alias("more_behind"))
    least = found.groupBy(*leg_key).agg(F.min("cost").alias("least"))
    now = state.join(turns.select(*leg_key, "back"), leg_key, "left").join(grew, leg_key, "left").join(least, leg_key, "left").join(whole.select("problem_id", F.col("cost").alias("best")), "problem_id", "left")
    for end, back in (("ahead", False), ("behind", True)):
        now = now.withColumn(end, F.col(end) + F.coalesce(F.col("back") == back, F.lit(False)).cast("int")).withColumn(f"top_{end}", F.greatest(f"top_{end}", f"new_{end}")).withColumn(f"n_{end}", F.col(f"n_{end}") + F.coalesce(f"more_{end}", F.lit(0)))
    ahead, behind = F.col("ahead") * F.lit(width), F.col("behind") * F.lit(width)
    total = ahead + behind
    open_ = ((F.col("seed_ahead") > ahead) | (F.col("top_ahead") > ahead - F.lit(most))) & ((F.col("seed_behind") > behind) | (F.col("top_behind") > behind - F.lit(most)))
    each = Window.partitionBy("problem_id")
    all_found = F.count("least").over(each) == F.count(F.lit(1)).over(each)
    lost = F.max((F.col("least").isNull() & ~F.coalesce(open_, F.lit(False))).cast("int")).over(each) == 1
    others = F.sum("least").over(each) - F.col("least")
    needed = F.when(F.col("least").isNull(), True).when(F.col("best").isNull(), all_found).otherwise(total < F.col("best") - others)
    return now.withColumn("active", F.coalesce(open_, F.lit(False)) & ~lost & needed).select(state.columns)


def simple_paths(arcs: DataFrame, legal: DataFrame, problems: DataFrame) -> DataFrame:
    """anchored_paths with no part used twice in a whole path.

    A label is (problem, last arc, anchors passed) with its cost, path and parts. A round extends only the labels of the
    round before and writes only those that stay: cheaper than every earlier label of the same arc and anchors whose
    parts are among its own, and than a finished path of the problem. A path ends with the arc that reaches the last
    anchor, so rounds grow with the longest path in arcs.
    """
    table = arcs.select("arc_id", "part_id", "from_node", "to_node", F.col("cost").cast("double").alias("step_cost"))
    table = stored(table)
    after = stored(legal.join(table.select(F.col("arc_id").alias("to_arc"), "part_id", "to_node", "step_cost"), "to_arc").join(table.select(F.col("arc_id").alias("from_arc"), F.col("part_id").alias("last_part")), "from_arc").filter("part_id <> last_part").drop("last_part"))
    passed = lambda done: done + (F.col("to_node") == F.get("anchors", done)).cast("int")
    key = ["problem_id", "arc_id", "done"]
    grown = problems.select("problem_id", "origin", "anchors").join(table, F.col("origin") == F.col("from_node")).select("problem_id", "anchors", "arc_id", passed(F.lit(0)).alias("done"), F.col("step_cost").alias("cost"), F.array("arc_id").alias("path"), F.array("part_id").alias("parts"))
    fronts: list[DataFrame] = []
    ended: list[DataFrame] = []
    while True:
        # a label stays unless another of its state is no dearer and used no other part; equal ones: the least path
        rows = stored(grown)
        worse = rows.alias("x").join(rows.alias("y"), key).filter("y.cost <= x.cost AND size(array_except(y.parts, x.parts)) = 0 AND (y.cost < x.cost OR size(y.parts) < size(x.parts) OR y.path < x.path)").select(*(F.col(f"x.{c}").alias(c) for c in (*key, "path"))).distinct()
        best = rows.join(worse, [*key, "path"], "left_anti")
        if fronts:
            old = reduce(DataFrame.unionByName, fronts).select(*key, F.col("cost").alias("old_cost"), F.col("parts").alias("old_parts"))
            beaten = best.join(old, key).filter("old_cost <= cost AND size(array_except(old_parts, parts)) = 0").select(*key, "path").distinct()
            best = best.join(beaten, [*key, "path"], "left_anti")
        if ended:
            goal = reduce(DataFrame.unionByName, ended).groupBy("problem_id").agg(F.min("cost").alias("goal"))
            best = best.join(goal, "problem_id", "left").filter("goal IS NULL OR cost <= goal").drop("goal")
        front = stored(best)
        if front.isEmpty():
            break
        fronts.append(front)
        ended.append(front.filter(F.col("done") == F.size("anchors")))
        open_ = front.filter(F.col("done") < F.size("anchors"))
        steps = open_.withColumnRenamed("arc_id", "from_arc").join(after, "from_arc").filter(~F.array_contains("parts", F.col("part_id")))
        grown = steps.select("problem_id", "anchors", F.col("to_arc").alias("arc_id"), passed(F.col("done")).alias("done"), (F.col("cost") + F.col("step_cost")).alias("cost"), F.array_append("path", F.col("to_arc")).alias("path"), F.array_append("parts", F.col("part_id")).alias("parts"))
    if not ended:
        return no_paths(arcs, problems)
    whole = reduce(DataFrame.unionByName, ended)
    return whole.groupBy("problem_id").agg(F.min_by(F.struct("cost", "path"), F.struct("cost", "path")).alias("b")).select("problem_id", "b.cost", F.col("b.path").alias("arc_ids"))


def shortest_paths(legal: DataFrame, arcs: DataFrame, starts: DataFrame) -> DataFrame:
    """Least cost from each origin to every arc that legal turns reach; (origin, arc_id, cost, before).

    starts: origin, arc_id. Each round extends the arcs that improved and keeps the least cost of each state, so the
    table has one row per origin and arc; it ends when nothing improves. Lengths must be positive.
    """
    cost = arcs.select(F.col("arc_id").alias("next"), F.col("length_m").alias("step"))
    best = checkpoint(starts.join(arcs.select("arc_id", "length_m"), "arc_id").select("origin", "arc_id", F.col("length_m").alias("cost"), F.lit(None).cast("string").alias("before")))
    front = best
    while True:
        grown = front.join(legal, front.arc_id == legal.from_arc).select("origin", F.col("to_arc").alias("next"), "cost", F.col("from_arc").cast("string").alias("before")).join(cost, "next")
        found = grown.groupBy("origin", F.col("next").alias("arc_id")).agg(F.min(F.struct((F.col("cost") + F.col("step")).alias("cost"), "before")).alias("x")).select("origin", "arc_id", "x.cost", "x.before")
        known = best.select("origin", "arc_id", F.col("cost").alias("old"))
        front = checkpoint(found.join(known, ["origin", "arc_id"], "left").filter("old is null or cost < old - 1e-9").drop("old"))
        if front.isEmpty():
            return best
        best = checkpoint(best.join(front.select("origin", "arc_id"), ["origin", "arc_id"], "left_anti").unionByName(front))
