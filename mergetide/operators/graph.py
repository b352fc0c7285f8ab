"""Graph operators over ``edges(src, dst)`` and ``nodes(id, ...)``.

Loops advance by a frontier that shrinks or a set that grows; every round is joins on ids, and its result is written
to the shared folder, so that lost executors cost a round at most and lineage stays short.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mergetide.operators.matching import ordinals
from mergetide.sources.shared import FEW, cut, cut_counting, cut_sized, free, merged, together

#: Distinct-count sketches of 2^12 registers: a standard error of 1.04 / 2^6, of which six are allowed for.
SKETCH_BITS, SKETCH_ERROR = 12, 0.1


def dependencies(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("dependency")).distinct()


def dependents(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("id"), F.col("src").alias("dependent")).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, n_dependencies, n_dependents``, distinct neighbours."""
    out = dependencies(edges).groupBy("id").agg(F.count("*").alias("n_dependencies"))
    into = dependents(edges).groupBy("id").agg(F.count("*").alias("n_dependents"))
    return nodes.select("id").join(merged(out), "id", "left").join(merged(into), "id", "left").na.fill(0, ["n_dependencies", "n_dependents"])


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select("id").join(merged(edges.select(F.col("dst").alias("id"))), "id", "left_anti")


def chains(step: DataFrame, fixed: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """(``id, head, offset`` of the inner nodes of chains, ``src, dst, length`` of the edges between all other nodes).

    Inner nodes have one edge of ``step(src, dst)`` in and one out and are not among ``fixed(id)``; the head is the node that
    a chain leaves, the offset how many steps lie between.  Pointers double their reach each round, so that a chain of any
    length takes as many rounds as its length has binary digits.  Circles of inner nodes have no head; nothing leads to them,
    and they are left out.  None in place of inner nodes where there are none.
    """
    sole = step.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"), F.min("src").alias("head")).where("n = 1").select("id", "head")
    out = step.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).where("n = 1").select("id")
    links, size = cut_sized(sole.join(merged(out), "id", "left_semi").join(merged(fixed.select("id")), "id", "left_anti").withColumn("offset", F.lit(1)), "chains")
    if not size:
        return None, step.withColumn("length", F.lit(1))
    inner = links.select("id")
    for _ in range(size.bit_length() + 1):
        up = links.select(F.col("id").alias("head"), F.col("head").alias("on"), F.col("offset").alias("more"))
        longer = links.join(up, "head", "left")
        links, seen = cut_counting(longer.select("id", F.coalesce("on", "head").alias("head"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset"), F.col("on").isNotNull().alias("moved")), "chains", moved=F.count_if("moved"))
        links = merged(links) if size > FEW else links
        if not seen["moved"]:
            break
    links = links.join(merged(inner.select(F.col("id").alias("head"))), "head", "left_anti").select("id", "head", "offset")
    kept = step.join(merged(inner.select(F.col("id").alias("dst"))), "dst", "left_anti")
    drawn = kept.join(merged(links.select(F.col("id").alias("src"), "head", "offset")), "src", "left")
    return links, drawn.select(F.coalesce("head", "src").alias("src"), "dst", (F.coalesce("offset", F.lit(0)) + 1).alias("length"))


def spread(seeds: DataFrame, edges: DataFrame, keys: list[str], within: DataFrame | None = None) -> DataFrame:
    """``keys, id, depth``: what each seed ``(keys, id)`` reaches, itself included, and in how many steps at least.

    within: only through and to these ids.  Chains are drawn together first; then a round sends on the nodes that were found,
    or found nearer, in the round before.
    """
    step = edges.select("src", "dst").distinct()
    if within is not None:
        step = step.join(merged(within.select(F.col("id").alias("dst"))), "dst", "left_semi")
    step = cut(step, "edges")
    inner, drawn = chains(step, seeds.select("id").distinct())
    if inner is not None:
        drawn = cut(drawn.groupBy("src", "dst").agg(F.min("length").alias("length")), "edges")
    frontier, new = cut_sized(seeds.select(*keys, "id").distinct().withColumn("depth", F.lit(0)), "frontier")
    seen, size, parts = frontier, new, [frontier]
    while new:
        near = frontier.select(*keys, F.col("id").alias("src"), "depth").join(drawn, "src")
        near = near.groupBy(*keys, F.col("dst").alias("id")).agg(F.min(F.col("depth") + F.col("length")).alias("depth"))
        known = seen.select(*keys, "id", F.col("depth").alias("_known"))
        known = merged(known) if size > FEW else known
        if inner is None:  # first found is nearest
            frontier = near.join(known, [*keys, "id"], "left_anti")
        else:
            known = known.groupBy(*keys, "id").agg(F.min("_known").alias("_known"))
            frontier = near.join(known, [*keys, "id"], "left").where("_known is null or depth < _known").select(*keys, "id", "depth")
        frontier, new = cut_sized(frontier, "frontier")
        size += new
        parts.append(frontier)
        if len(parts) % 8 == 0:  # few files; the frontier is still to be read
            kept = cut(together(*parts[:-1]), "seen")
            free(kept.sparkSession, *parts[:-1])
            parts = [kept, frontier]
        seen = together(*parts)
    if inner is None:
        return seen
    seen = seen.groupBy(*keys, "id").agg(F.min("depth").alias("depth"))
    on = inner.join(merged(seen.withColumnRenamed("id", "head")), "head").select(*keys, "id", (F.col("depth") + F.col("offset")).alias("depth"))
    return seen.unionByName(on)


def depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, depth``: fewest steps from any root; 0 where no root leads."""
    found = spread(roots(nodes, edges), edges, [])
    return nodes.select("id").join(merged(found), "id", "left").select("id", F.coalesce("depth", F.lit(0)).alias("depth"))


def peel(need: DataFrame, step: DataFrame) -> DataFrame:
    """``id, turn`` of the nodes of ``need(id, missing)`` whose dependencies all come in.

    Turn 0 has those that miss nothing; a node's turn is one above that of its last dependency, of the ``missing`` ones told by
    ``step(id, dependency)``; nodes that wait for ever get no row.  Chains of single dependencies are drawn together first.
    Each round writes one table: the nodes that its frontier touches, with all that they have met so far.  Those that miss
    nothing more are the next frontier; what is known of the others is looked up in the tables before, compacted every few rounds.
    """
    spark = need.sparkSession
    need, step = cut(need, "need"), cut(step, "edges")
    inner, drawn = chains(step.select(F.col("dependency").alias("src"), F.col("id").alias("dst")), need.where("missing <> 1").select("id"))
    step = drawn.select(F.col("dst").alias("id"), F.col("src").alias("dependency"), "length")
    step = cut(step.join(merged(need), "id"), "edges")  # what a node waits for goes along, so that no round looks it up
    first = need.where("missing = 0").select("id", F.col("missing").cast("long").alias("met"), F.lit(0).alias("turn"), F.col("missing").cast("long").alias("missing"))
    came = F.count_if(F.col("met") == F.col("missing"))
    first, size = cut_sized(first, "met")
    done, rounds, held, n = [], [first], 0, 0
    while size:
        n += 1
        new = rounds[-1].where("met = missing").select(F.col("id").alias("dependency"), "turn")
        told = step.join(merged(new) if size > FEW else new, "dependency")
        told = told.groupBy("id").agg(F.count("*").alias("met"), F.max(F.col("turn") + F.col("length")).alias("turn"), F.max("missing").cast("long").alias("missing"))
        before = together(*rounds).where("met < missing").groupBy("id").agg(F.max("met").alias("_met"), F.max("turn").alias("_turn"))
        met = told.join(merged(before) if held > FEW else before, "id", "left")
        met = met.select("id", (F.col("met") + F.coalesce("_met", F.lit(0))).alias("met"), F.greatest("turn", "_turn").alias("turn"), "missing")
        met, seen = cut_counting(met, "met", came=came, n=F.count("*"))
        size, held = seen["came"], held + seen["n"] - seen["came"]
        rounds.append(met)
        if n % 8 == 0:  # few files; the frontier is still to be read
            old = rounds[:-1]
            whole = cut(together(*done, *old).where("met = missing"), "done")
            latest = together(*old).groupBy("id").agg(F.max("met").alias("met"), F.max("turn").alias("turn"), F.max("missing").alias("missing"))
            left, waits = cut_sized(latest.where("met < missing"), "met")
            free(spark, *done, *old)
            done, rounds, held = [whole], [left, met], waits + seen["n"] - seen["came"]
    done = together(*done, *rounds).where("met = missing").select("id", "turn")
    if inner is None:
        return done
    on = inner.join(merged(need), "id", "left_semi").join(merged(done.withColumnRenamed("id", "head")), "head").select("id", (F.col("turn") + F.col("offset")).cast("int").alias("turn"))
    return done.unionByName(on)


def clean_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id`` of nodes with ``ok`` (clean type, nothing unresolved) all of whose dependencies are clean.

    The least such set, so that nodes on or above a cycle are not in it.  A dependency that is no node is never clean.
    """
    step = dependencies(edges)
    ok = nodes.where("ok").select("id").distinct()
    left = step.groupBy("id").agg(F.count("*").alias("missing"))
    need = ok.join(merged(left), "id", "left").select("id", F.coalesce("missing", F.lit(0)).alias("missing"))
    return peel(need, step.join(merged(ok), "id", "left_semi")).select("id")


def missing_dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, dependency, warning``: edges to ids that are no nodes; what depends on them is not clean."""
    lost = dependencies(edges).join(merged(nodes.select(F.col("id").alias("dependency"))), "dependency", "left_anti")
    return lost.select("id", "dependency", F.lit("dependency is no node").alias("warning"))


def clean_roots(nodes: DataFrame, clean: DataFrame, edges: DataFrame) -> DataFrame:
    """Clean nodes that nothing depends on, or on which some node depends that is not clean."""
    dirty_users = dependents(edges).join(merged(clean.select(F.col("id").alias("dependent"))), "dependent", "left_anti").select("id").distinct()
    none = clean.join(merged(dependents(edges)), "id", "left_anti")
    return none.unionByName(clean.join(merged(dirty_users), "id", "left_semi")).distinct()


def movable_roots(nodes: DataFrame, clean: DataFrame, edges: DataFrame) -> DataFrame:
    """Clean nodes on which no clean node depends."""
    used = dependents(edges).join(merged(clean.select(F.col("id").alias("dependent"))), "dependent", "left_semi")
    return clean.join(merged(used), "id", "left_anti")


def subtrees(tops: DataFrame, clean: DataFrame, edges: DataFrame) -> DataFrame:
    """``root, id, depth``: the clean nodes that each root reaches; trees may overlap."""
    return spread(tops.select(F.col("id").alias("root"), "id"), edges, ["root"], clean)


def tree_estimates(tops: DataFrame, clean: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, size`` of each root's tree by its distinct-count sketch, within :data:`SKETCH_ERROR` of the truth but for odds of 1e-9.

    A node's sketch is the union of its dependencies' and itself: one of 4 KB at most a node, in place of a row for each node
    of each tree.  Chains are drawn into the node that they leave; then a round makes the sketches of one level.
    """
    step = edges.select("src", "dst").where("src <> dst").distinct().join(merged(clean.select(F.col("id").alias("dst"))), "dst", "left_semi")
    step = cut(step.join(merged(clean.select(F.col("id").alias("src"))), "src", "left_semi"), "edges")
    inner, drawn = chains(step, tops.select("id"))
    own = clean.select("id", F.col("id").alias("member")).distinct()
    if inner is not None:
        own = own.join(merged(inner), "id", "left_anti").unionByName(inner.select(F.col("head").alias("id"), F.col("id").alias("member")))
    drawn = cut(drawn.select(F.col("src").alias("id"), F.col("dst").alias("dependency")).distinct(), "edges")
    turns = cut(waiting(own.select("id").distinct(), drawn)[0], "turns")
    own = cut(own.groupBy("id").agg(F.hll_sketch_agg("member", SKETCH_BITS).alias("sketch")).join(merged(turns), "id"), "own")
    drawn = cut_sized(drawn.join(merged(turns), "id"), "edges")[0]
    last = turns.agg(F.max("turn")).first()[0]  # one number
    done = cut(own.where("turn = 0").select("id", "sketch"), "sketches")
    parts = [done]
    for turn in range(1, (last or 0) + 1):
        told = drawn.where(F.col("turn") == turn).join(done.withColumnRenamed("id", "dependency"), "dependency").select("id", "sketch")
        both = told.unionByName(own.where(F.col("turn") == turn).select("id", "sketch"))
        parts.append(cut(both.groupBy("id").agg(F.hll_union_agg("sketch").alias("sketch")), "sketches"))
        done = together(*parts)
        if len(parts) % 8 == 0:  # few files
            done = cut(done, "sketches")
            free(done.sparkSession, *parts)
            parts = [done]
    return done.join(merged(tops.select("id")), "id", "left_semi").select("id", F.hll_sketch_estimate("sketch").alias("size"))


def largest_roots(tops: DataFrame, clean: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """``id`` of the roots whose trees can be among the ``most`` largest, by the bounds of their estimates."""
    sizes = cut(tree_estimates(tops, clean, edges), "sizes")
    least = sizes.orderBy(F.desc("size")).limit(most).agg(F.min("size").alias("least"))  # one row
    at_most, at_least = F.col("size") * (1 + SKETCH_ERROR), F.col("least") * (1 - SKETCH_ERROR)
    return sizes.crossJoin(F.broadcast(least)).where(at_most >= at_least).select("id")


def expand(seeds: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id``: known seeds and all that they depend on."""
    return spread(seeds.join(merged(nodes.select("id")), "id", "left_semi"), edges, []).select("id")


def waiting(ids: DataFrame, step: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``id, turn`` of the nodes that come in by :func:`peel` over all of ``step(id, dependency)``, the others)."""
    need = ids.join(merged(step.groupBy("id").agg(F.count("*").alias("missing"))), "id", "left").select("id", F.coalesce("missing", F.lit(0)).alias("missing"))
    done = peel(need, step)
    return done, ids.join(merged(done), "id", "left_anti")


def among(step: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges ``id, dependency`` between two of ``ids``."""
    return step.join(ids, "id", "left_semi").join(ids.select(F.col("id").alias("dependency")), "dependency", "left_semi").select("id", "dependency")


def strong_components(ids: DataFrame, step: DataFrame) -> DataFrame:
    """``id, component`` of the nodes of ``ids`` that lie on a cycle of ``step(id, dependency)``: the smallest id of those that lead to each other.

    In each round every node takes the smallest id that it depends on by any path as its colour; the node of that id and all
    that it leads to in its own colour are one component.  Nodes that lead to each other have one colour, so the next round
    keeps the edges inside a colour only, and of the nodes left those that such edges enter and leave.
    """
    parts, own = [], cut(among(step, ids).where("id <> dependency"), "step")
    while True:
        left, size = cut_sized(own.select("id").distinct().join(merged(own.select(F.col("dependency").alias("id"))), "id", "left_semi"), "left")
        if not size:
            break
        own = cut(among(own, left), "step")
        colour, new = cut(left.withColumn("colour", F.col("id")).withColumn("new", F.lit(True)), "colour"), size
        while new:  # smaller ids travel from dependencies to those that need them
            fresh = colour.where("new").select(F.col("id").alias("dependency"), "colour")
            fresh = merged(fresh) if size > FEW else fresh
            sent = own.join(fresh, "dependency").groupBy("id").agg(F.min("colour").alias("sent"))
            smaller = F.coalesce(F.col("sent") < F.col("colour"), F.lit(False))
            sent = merged(sent) if size > FEW else sent
            colour, seen = cut_counting(colour.join(sent, "id", "left").select("id", F.least("colour", "sent").alias("colour"), smaller.alias("new")), "colour", new=F.count_if("new"))
            new = seen["new"]
        colour = merged(colour) if size > FEW else colour
        dyed = own.join(colour.select("id", "colour"), "id").join(colour.select(F.col("id").alias("dependency"), F.col("colour").alias("other")), "dependency")
        same = cut(dyed.where(F.col("colour") == F.col("other")).select("id", "dependency"), "step")
        tops = colour.where(F.col("id") == F.col("colour")).select(F.col("colour").alias("component"), "id")
        found = cut_sized(spread(tops, same.select(F.col("id").alias("src"), F.col("dependency").alias("dst")), ["component"]).select("id", "component"), "component")[0]
        parts.append(found.join(found.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component"), "component", "left_semi").select("id", "component"))
        own = cut(among(same, left.join(found, "id", "left_anti")), "step")
    kind = ids.schema["id"].dataType.simpleString()
    return reduce(DataFrame.unionByName, parts) if parts else ids.sparkSession.createDataFrame([], f"id {kind}, component {kind}")


def levels(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, level``: dependencies first, nodes that depend on each other at one level.

    Only where nodes wait for a cycle are cycles drawn together, and levels told over what they become.
    """
    ids = merged(ids.select("id").distinct())
    inner = cut(among(dependencies(edges), ids).where("id <> dependency"), "inner")
    done, rest = waiting(ids, inner)
    done, (rest, waits) = cut(done, "done"), cut_sized(rest, "rest")
    if not waits:
        return done.select("id", F.col("turn").alias("level"))
    found = strong_components(rest, among(inner, rest))
    name = cut(ids.join(merged(found), "id", "left").select("id", F.coalesce("component", "id").alias("component")), "names")
    drawn = inner.join(merged(name), "id").join(merged(name.select(F.col("id").alias("dependency"), F.col("component").alias("to"))), "dependency")
    drawn = drawn.where(F.col("component") != F.col("to")).select(F.col("component").alias("id"), F.col("to").alias("dependency")).distinct()
    turns = waiting(name.select(F.col("component").alias("id")).distinct(), drawn)[0]
    return name.join(merged(turns.select(F.col("id").alias("component"), F.col("turn").alias("level"))), "component").select("id", "level")


def ordered(levelled: DataFrame) -> DataFrame:
    """``id, level, position``: a total order of a plan's nodes by level and id, ranked in sorted ranges."""
    ranked = ordinals(levelled.select("id", "level"), "level", "id")
    return ranked.select("id", "level", F.col("ordinal").alias("position"))


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    return nodes.join(merged(ends), "id", "left_semi")


def edges_within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = merged(nodes.select("id"))
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def bottlenecks(nodes: DataFrame, edges: DataFrame, samples: int = 0) -> DataFrame:
    """``id, unlock_count, effort, impact`` of every blocker (``dirty`` nodes): nodes that nothing else blocks.

    Only (node, blocker) pairs are spread, upwards from the blockers, and a node leaves with its second blocker: its
    users then have two as well, so that at most two pairs a node are kept.  samples: how many of the unlocked nodes to name.
    """
    up = cut(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct(), "up")
    blockers = nodes.where("dirty").select("id", "effort")
    frontier, new = cut_sized(blockers.select(F.col("id").alias("node"), F.col("id").alias("blocker")), "pairs")
    seen, size, parts = frontier, new, [frontier]
    while new:
        known = merged(seen) if size > FEW else seen
        near = frontier.withColumnRenamed("node", "src").join(up, "src").select(F.col("dst").alias("node"), "blocker").distinct()
        near = near.join(known, ["node", "blocker"], "left_anti").groupBy("node").agg(F.min("blocker").alias("a"), F.max("blocker").alias("b"))
        held = known.join(near.select("node"), "node", "left_semi").groupBy("node").agg(F.count("*").alias("k"))
        pairs = near.join(merged(held) if new > FEW else held, "node", "left").where("coalesce(k, 0) < 2").select("node", F.explode(F.array_distinct(F.array("a", "b"))).alias("blocker"))
        frontier, new = cut_sized(pairs, "pairs")
        size += new
        parts.append(frontier)
        if len(parts) % 8 == 0:
            kept = cut(together(*parts[:-1]), "pairs")
            free(nodes.sparkSession, *parts[:-1])
            parts = [kept, frontier]
        seen = together(*parts)
    single = seen.groupBy("node").agg(F.count("*").alias("k"), F.min("blocker").alias("id")).where("k = 1")
    unlocks = single.groupBy("id").agg(F.count("*").alias("unlock_count"))
    out = blockers.join(merged(unlocks), "id", "left").select("id", "effort", F.coalesce("unlock_count", F.lit(0)).alias("unlock_count"))
    out = out.withColumn("impact", F.when(F.col("effort") > 0, F.col("unlock_count") / F.col("effort")).otherwise(F.col("unlock_count").cast("double")))
    if not samples:
        return out
    place = F.row_number().over(Window.partitionBy("id").orderBy("node"))
    few = single.select("id", "node").withColumn("place", place).where(F.col("place") <= samples).groupBy("id").agg(F.array_sort(F.collect_list("node")).alias("samples"))
    return out.join(few, "id", "left")
