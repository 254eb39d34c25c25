"""Bounded walks over a graph of prerequisites, by joins of a frontier with the edges.

A frontier holds one row per start and node, however many walks lead there, so
it never grows beyond the nodes within reach.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coursewright.session import cut


def min_hops(starts: DataFrame, edges: DataFrame, depth: int = 4) -> DataFrame:
    """``start, node, hops, all_hard``: the least hops to each node within ``depth``, and whether a walk of that length has hard edges only.

    ``starts``: ``start``.  ``edges``: ``src, dst, strength``; repeated edges count once, a hard one before a soft.
    """
    e = edges.filter("src is not null and dst is not null").groupBy("src", "dst").agg(F.bool_or(F.col("strength") == "hard").alias("hard"))
    frontier = starts.distinct().select("start", F.col("start").alias("node"), F.lit(True).alias("all_hard"))
    levels = []
    for hop in range(1, depth + 1):
        step = frontier.join(e, F.col("node") == F.col("src")).groupBy("start", F.col("dst").alias("node")).agg(F.bool_or(F.col("all_hard") & F.col("hard")).alias("all_hard"))
        frontier = step
        levels.append(step.withColumn("hops", F.lit(hop)))
    every = reduce(DataFrame.unionByName, levels)
    return every.groupBy("start", "node").agg(F.min(F.struct("hops", (~F.col("all_hard")).alias("soft"))).alias("m")).select("start", "node", F.col("m.hops").alias("hops"), (~F.col("m.soft")).alias("all_hard"))


def blend_pick(hops: DataFrame) -> DataFrame:
    """``start, difficulty, node``: what is blended in. ``hops`` has ``semester`` (of the node) and ``own_semester`` beside the columns of :func:`min_hops`.

    Easy: nothing.  Medium: a direct prerequisite.  Hard: the nearest of two hops
    or more from an earlier semester, else any of two or more, else a direct one.
    Hard links go before soft ones, then fewer hops, then the id.
    """
    tier = F.when((F.col("hops") >= 2) & (F.col("semester") < F.col("own_semester")), 1).when(F.col("hops") >= 2, 2).otherwise(3)
    best = lambda rows: rows.groupBy("start").agg(F.min(F.struct("tier", "soft", "hops", "node")).alias("m"))
    rows = hops.withColumn("soft", ~F.col("all_hard"))
    hard = best(rows.withColumn("tier", tier)).select("start", F.lit("hard").alias("difficulty"), "m.node")
    medium = best(rows.filter("hops = 1").withColumn("tier", F.lit(0))).select("start", F.lit("medium").alias("difficulty"), "m.node")
    return hard.unionByName(medium)


def blend_candidates(hops: DataFrame, extra: int = 1) -> DataFrame:
    """``start, node, hops`` of the best non-empty tier for hard questions, up to ``extra`` hops beyond its nearest."""
    tier = F.when((F.col("hops") >= 2) & (F.col("semester") < F.col("own_semester")), 1).when(F.col("hops") >= 2, 2).otherwise(3)
    w = Window.partitionBy("start")
    t = hops.withColumn("tier", tier).withColumn("best", F.min("tier").over(w)).filter("tier = best")
    return t.withColumn("least", F.min("hops").over(w)).filter(F.col("hops") <= F.col("least") + extra).select("start", "node", "hops")


def cycles(edges: DataFrame, longest: int | None = None) -> DataFrame:
    """``cycle``: each simple loop once, as the list of its nodes from the least on; loops of one node included.

    Only nodes that lie on some loop are walked: those without incoming or
    outgoing edges are peeled off first, over and over.
    """
    e = cut(edges.filter("src is not null and dst is not null").select("src", "dst").distinct())
    while True:
        kept = cut(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        if kept.count() == e.count():
            break
        e = kept
    found = e.filter("src = dst").select(F.array("src").alias("cycle"))
    walks = e.filter("dst > src").select(F.col("src").alias("first"), F.col("dst").alias("at"), F.array("src", "dst").alias("path"))
    n = 2
    while (longest is None or n <= longest) and not walks.isEmpty():
        step = walks.join(e, F.col("at") == F.col("src"))
        found = found.unionByName(step.filter(F.col("dst") == F.col("first")).select(F.col("path").alias("cycle")))
        walks = cut(step.filter((F.col("dst") > F.col("first")) & ~F.array_contains("path", F.col("dst"))).select("first", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path")))
        n += 1
    return found


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``problem, key``: edges from or to unknown nodes, nodes without any edge, repeated edges."""
    ids = nodes.select(F.col("node").alias("key")).distinct()
    unknown = lambda col, what: edges.select(F.col(col).alias("key")).distinct().join(ids, "key", "left_anti").select(F.lit(what).alias("problem"), "key")
    touched = edges.select(F.col("src").alias("key")).unionByName(edges.select(F.col("dst").alias("key"))).distinct()
    orphan = ids.join(touched, "key", "left_anti").select(F.lit("orphan").alias("problem"), "key")
    twice = edges.groupBy("src", "dst").count().filter("count > 1").select(F.lit("repeated edge").alias("problem"), F.col("src").alias("key")).distinct()
    return unknown("src", "unknown source").unionByName(unknown("dst", "unknown target")).unionByName(orphan).unionByName(twice)


def closure(starts: DataFrame, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """``start, node, depth``: every node that can be reached (the start itself at depth 0) with the least number of steps.

    ``edges``: ``src, dst``.  Without ``depth`` the walk ends when a step reaches nothing
    new; loops are no trouble, as a node is entered once per start.
    """
    e = cut(edges.filter("src is not null and dst is not null").select("src", "dst").distinct())
    reached = frontier = cut(starts.filter("start is not null").distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("depth")))
    step = 0
    while depth is None or step < depth:
        step += 1
        new = frontier.join(e, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct().join(reached, ["start", "node"], "left_anti")
        frontier = cut(new.withColumn("depth", F.lit(step)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def missing(asked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The keys asked for that don't exist."""
    return asked.select(key).filter(F.col(key).isNotNull()).distinct().join(known.select(key), key, "left_anti")


def require(asked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``asked`` as it is if all its keys exist; a ``KeyError`` that names up to five of the missing ones otherwise."""
    gone = [r[0] for r in missing(asked, known, key).orderBy(key).limit(5).collect()]
    if gone:
        raise KeyError(f"unknown {key}: {', '.join(map(str, gone))}")
    return asked
