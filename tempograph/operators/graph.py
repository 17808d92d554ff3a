"""Closures over hierarchies and bounded traversal of facts. Loops run on the driver, rows stay in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempograph.functions.predicates import visible
from tempograph.plans import sieve
from tempograph.plans.lineage import cut


def closure(edges: DataFrame) -> DataFrame:
    """(node, ancestor) of a hierarchy of (child, parent), each node with itself; several parents and cycles are fine."""
    nodes = edges.select(F.col("child").alias("node")).unionByName(edges.select(F.col("parent").alias("node"))).distinct()
    found = cut(nodes.select("node", F.col("node").alias("ancestor")))
    new = found
    while True:  # ends on cycles too, as only new pairs go on
        step = new.join(edges, new["ancestor"] == edges["child"]).select("node", F.col("parent").alias("ancestor")).distinct()
        new = cut(step.join(found, ["node", "ancestor"], "left_anti"))
        if new.isEmpty():
            break
        found = found.unionByName(new)
    return found


def subtree_facts(facts: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """How many visible facts each predicate has, its descendants' included."""
    n = facts.where(visible()).groupBy(F.col("predicate").alias("node")).agg(F.count("*").alias("n"))
    return n.join(closure(hierarchy), "node").groupBy(F.col("ancestor").alias("predicate")).agg(F.sum("n").alias("n"))


def reach(facts: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, node, distance) of all nodes that visible facts lead to from roots (column root), within a depth.

    The last level is most of the result and is neither stored nor shuffled:
    roots that go on from the same nodes are one class, what a class leads to is
    found once, and each of its roots takes that over without what it had. Of
    the facts a level shuffles those that may start at its nodes.
    """
    out = facts.where(visible() & F.col("object_id").isNotNull()).select(F.col("subject_id").alias("node"), F.col("object_id").alias("to"))
    found = cut(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("distance")))
    new = found
    for level in range(1, depth + 1):
        if level == depth and level > 1:
            return found.unionByName(_last_level(found, new, out).withColumn("distance", F.lit(level)))
        step = new.join(sieve.sieved(out, ["node"], new, ["node"]).distinct(), "node").select("root", F.col("to").alias("node")).distinct()
        new = cut(step.join(found, ["root", "node"], "left_anti").withColumn("distance", F.lit(level)))
        if new.isEmpty():
            break
        found = found.unionByName(new)
    return found


def _last_level(found: DataFrame, new: DataFrame, out: DataFrame) -> DataFrame:
    """root and node of what out leads to from the new nodes of each root and is not found yet."""
    ends = sieve.sieved(new, ["node"], out, ["node"]).join(out.select("node").distinct(), "node", "left_semi")
    sets = cut(ends.groupBy("root").agg(F.array_sort(F.collect_set("node")).alias("nodes")))
    classes = cut(sets.groupBy("nodes").agg(F.min("root").alias("class"), F.count("*").alias("n")))
    members = sets.join(classes.select("nodes", "class"), "nodes").select("root", "class")
    middle = classes.select("class", F.explode("nodes").alias("node"))
    told = cut(middle.join(sieve.sieved(out, ["node"], middle, ["node"]).distinct(), "node").select("class", F.col("to").alias("node")).distinct())
    had = sieve.sieved(found.select("root", "node"), ["node"], told.select("node").distinct(), ["node"])
    had = had.join(members, "root").join(told, ["class", "node"]).groupBy("root").agg(F.collect_list("node").alias("had"))
    rows = sieve.dealt(members.join(had, "root", "left"), told, ["class"], "root", classes.select("class", "n"))
    return rows.where("had is null or not array_contains(had, node)").select("root", "node")


def in_tree_order(rows: DataFrame, root: int = 0) -> DataFrame:
    """id, depth, line and place of a tree (id, parent_id, name) in depth-first order, children by id; the structural root isn't shown, and its children start the tree.

    place is the path of ids from the top, so that sorting by it prints the
    tree. Rows on a cycle, or below one, or without their parent have no path
    from the top and are left out.
    """
    tree = rows.where(F.col("id") != root).select("id", F.when(F.col("parent_id") != root, F.col("parent_id")).alias("parent_id"), F.btrim(F.regexp_replace("name", r"\s+", " ")).alias("name"))
    front = cut(tree.where("parent_id is null").select("id", "name", F.array("id").alias("place")))
    found = [front]
    while not front.isEmpty():  # ends, as a path has every row once at most
        above = front.select(F.col("id").alias("parent_id"), F.col("place").alias("_p"))
        front = cut(tree.join(above, "parent_id").select("id", "name", F.concat("_p", F.array("id")).alias("place")))
        found.append(front)
    whole = found[0]
    for f in found[1:]:
        whole = whole.unionByName(f)
    depth = F.size("place") - 1
    return whole.select("id", depth.alias("depth"), F.concat(F.repeat(F.lit("  "), depth), F.col("id").cast("string"), F.lit(" "), "name").alias("line"), "place")


def traversed(facts: DataFrame, roots: DataFrame, depth: int, most: int, predicates: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Breadth-first from each root (column root) along visible facts, with a bound on its nodes: the edges, and a row for each root.

    Each level takes, of the facts of the last level's nodes, the most confident
    2 x room ones (room: nodes that may still be found; ties by id), literals
    included. Their objects that are new are the next level's nodes, as long as
    there is room, in that order. Edges are root, depth (from 0), nth, fact_id,
    subject_id, predicate, object_id, object_literal and confidence; a root's
    row has max_depth_reached and nodes_found.
    """
    out = facts.where(visible()) if predicates is None else facts.where(visible() & F.col("predicate").isin(predicates))
    rows = out.select(F.col("id").alias("fact_id"), "subject_id", "predicate", "object_id", "object_literal", "confidence")
    seen = front = cut(roots.select("root", F.col("root").alias("node")).distinct())
    edges = []
    for level in range(depth):
        room = seen.groupBy("root").agg((F.lit(most) - F.count("*")).alias("room")).where("room > 0")
        order = W.partitionBy("root").orderBy(F.desc("confidence"), "fact_id")
        step = front.join(room, "root").join(rows, F.col("node") == F.col("subject_id")).withColumn("nth", F.row_number().over(order)).where("nth <= 2 * room").drop("node")
        step = cut(step)
        edges.append(step.drop("room").withColumn("depth", F.lit(level)))
        if step.isEmpty():
            break
        new = step.where("object_id is not null").groupBy("root", "room", F.col("object_id").alias("node")).agg(F.min("nth").alias("first")).join(seen, ["root", "node"], "left_anti")
        front = cut(new.withColumn("_r", F.row_number().over(W.partitionBy("root").orderBy("first"))).where("_r <= room").select("root", "node"))
        seen = seen.unionByName(front)
    every = edges[0]
    for e in edges[1:]:
        every = every.unionByName(e)
    reached = every.groupBy("root").agg((F.max("depth") + 1).alias("max_depth_reached"))
    summary = seen.groupBy("root").agg(F.count("*").alias("nodes_found")).join(reached, "root", "left").select("root", F.coalesce("max_depth_reached", F.lit(0)).alias("max_depth_reached"), "nodes_found")
    return every, summary
