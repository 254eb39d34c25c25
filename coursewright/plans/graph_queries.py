"""Queries of the prerequisite graph. The graph is derived from the part table: node p requires p div 2 (hard) and p div 3 (soft)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from coursewright.operators import graph as G
from coursewright.plans.registry import Registry
from coursewright.session import table

query = Registry()

_SEM = "CASE WHEN {0} < 4 THEN 1 WHEN {0} < 16 THEN 2 WHEN {0} < 64 THEN 3 ELSE 4 END"
_G = """p AS (SELECT DISTINCT p_partkey AS p FROM part WHERE p_partkey >= 1),
 e0 AS (SELECT p AS src, p // 2 AS dst, 'hard' AS strength FROM p WHERE p // 2 >= 1 UNION ALL SELECT p, p // 3, 'soft' FROM p WHERE p // 3 >= 1),
 e AS (SELECT src, dst, bool_or(strength = 'hard') AS hard FROM e0 GROUP BY ALL),
 w AS (SELECT src AS start, dst AS node, 1 AS hops, hard AS ah FROM e UNION ALL SELECT w1.start, e.dst, 2, w1.ah AND e.hard FROM (SELECT src AS start, dst AS node, hard AS ah FROM e) w1 JOIN e ON e.src = w1.node),
 w3 AS (SELECT start, e.dst AS node, 3 AS hops, ah AND e.hard AS ah FROM w JOIN e ON e.src = w.node WHERE hops = 2), w4 AS (SELECT start, e.dst AS node, 4 AS hops, ah AND e.hard AS ah FROM w3 JOIN e ON e.src = w3.node),
 allw AS (FROM w UNION ALL FROM w3 UNION ALL FROM w4), mh AS (SELECT start, node, min(hops) AS hops FROM allw GROUP BY ALL),
 hops AS (SELECT mh.start, mh.node, mh.hops, bool_or(ah) AS all_hard FROM mh JOIN allw USING (start, node, hops) GROUP BY ALL)"""


def _edges(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("p")).filter("p >= 1").distinct()
    a = p.select(F.col("p").alias("src"), F.floor(F.col("p") / 2).alias("dst"), F.lit("hard").alias("strength"))
    b = p.select(F.col("p").alias("src"), F.floor(F.col("p") / 3).alias("dst"), F.lit("soft").alias("strength"))
    return a.unionByName(b).filter("dst >= 1")


def _hops(spark, d):
    e = _edges(spark, d)
    return G.min_hops(e.select(F.col("src").alias("start")), e)


def _with_semesters(h):
    sem = lambda c: F.when(F.col(c) < 4, 1).when(F.col(c) < 16, 2).when(F.col(c) < 64, 3).otherwise(4)
    return h.withColumn("semester", sem("node")).withColumn("own_semester", sem("start"))


@query(f"WITH {_G} SELECT start, node, CAST(hops AS INT) AS hops, CASE WHEN all_hard THEN 'hard' ELSE 'soft' END AS strength FROM hops")
def prereq_hops(spark, d):
    return _hops(spark, d).select("start", "node", "hops", F.when(F.col("all_hard"), "hard").otherwise("soft").alias("strength"))


_TIER = f"CASE WHEN hops >= 2 AND {_SEM.format('node')} < {_SEM.format('start')} THEN 1 WHEN hops >= 2 THEN 2 ELSE 3 END"


@query(f"""WITH {_G}, t AS (SELECT *, {_TIER} AS tier FROM hops) SELECT start, 'hard' AS difficulty, arg_min(node, (tier, NOT all_hard, hops, node)) AS node FROM t GROUP BY start
 UNION ALL SELECT start, 'medium', arg_min(node, (NOT all_hard, node)) FROM t WHERE hops = 1 GROUP BY start""")
def blend_pick(spark, d):
    return G.blend_pick(_with_semesters(_hops(spark, d)))


@query(f"""WITH {_G}, t AS (SELECT *, {_TIER} AS tier FROM hops), b AS (SELECT *, min(tier) OVER (PARTITION BY start) AS best FROM t), l AS (SELECT *, min(hops) OVER (PARTITION BY start) AS least FROM b WHERE tier = best)
 SELECT start, node, CAST(hops AS INT) AS hops FROM l WHERE hops <= least + 1""")
def blend_candidates(spark, d):
    return G.blend_candidates(_with_semesters(_hops(spark, d)))


@query("""WITH RECURSIVE p AS (SELECT DISTINCT p_partkey AS p FROM part WHERE p_partkey >= 1), e AS (SELECT p AS src, p // 2 AS dst FROM p WHERE p // 2 >= 1 UNION SELECT 3, 25 UNION SELECT 7, 7),
 w AS (SELECT src AS first, dst AS at_, [src, dst] AS path FROM e WHERE dst > src UNION ALL SELECT first, e.dst, list_append(path, e.dst) FROM w JOIN e ON e.src = w.at_ WHERE e.dst > first AND NOT list_contains(path, e.dst))
 SELECT array_to_string(path, '>') AS cycle FROM w JOIN e ON e.src = w.at_ AND e.dst = w.first UNION ALL SELECT CAST(src AS VARCHAR) FROM e WHERE src = dst""")
def prereq_cycles(spark, d):
    """The hard edges with one back edge and one loop of a single node added."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("src")).filter("src >= 1").distinct()
    e = p.select("src", F.floor(F.col("src") / 2).alias("dst")).filter("dst >= 1")
    extra = spark.sql("select cast(3 as bigint) as src, cast(25 as bigint) as dst union all select 7L, 7L")
    return G.cycles(e.unionByName(extra)).select(F.array_join(F.transform("cycle", lambda x: x.cast("string")), ">").alias("cycle"))


@query("""WITH e AS (SELECT o_orderkey AS src, o_custkey AS dst FROM orders), n AS (SELECT c_custkey AS node FROM customer UNION SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0), t AS (SELECT src AS k FROM e UNION SELECT dst FROM e)
 SELECT 'unknown source' AS problem, src AS key FROM (SELECT DISTINCT src FROM e) WHERE src NOT IN (SELECT node FROM n) UNION ALL SELECT 'unknown target', dst FROM (SELECT DISTINCT dst FROM e) WHERE dst NOT IN (SELECT node FROM n)
 UNION ALL SELECT 'orphan', node FROM n WHERE node NOT IN (SELECT k FROM t) UNION ALL SELECT DISTINCT 'repeated edge', src FROM (SELECT src, dst FROM e GROUP BY ALL HAVING count(*) > 1)""")
def graph_integrity(spark, d):
    o = table(spark, d, "orders")
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("node")).unionByName(o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("node"))).distinct()
    return G.integrity(nodes, o.select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst")))


@query("""WITH t AS (SELECT topic_id, subject, unnest(cos) AS co FROM topics) SELECT t.topic_id, c.co_id, c.short_id, c.description FROM t JOIN course_outcomes c ON c.subject = t.subject AND c.short_id = t.co""")
def topic_cos(spark, d):
    t = table(spark, d, "topics").select("topic_id", "subject", F.explode("cos").alias("short_id"))
    return t.join(table(spark, d, "course_outcomes"), ["subject", "short_id"]).select("topic_id", "co_id", "short_id", "description")


@query("""WITH t AS (SELECT topic_id, subject, row_number() OVER (PARTITION BY subject ORDER BY topic_id) AS r, cos FROM topics), own AS (SELECT t.topic_id, 0 AS depth, t.subject || ':' || unnest(t.cos) AS co FROM t),
 one AS (SELECT t.topic_id, 1 AS depth, u.subject || ':' || unnest(u.cos) AS co FROM t JOIN t u ON u.subject = t.subject AND u.r = t.r // 2 AND u.r >= 1)
 SELECT topic_id, co, CAST(min(depth) AS INT) AS depth FROM (FROM own UNION ALL FROM one) GROUP BY ALL""")
def co_closure(spark, d):
    """Outcomes of a topic and of the topic it builds on, with the depth at which each is met first."""
    t = table(spark, d, "topics").select("topic_id", "subject", "cos", F.row_number().over(Window.partitionBy("subject").orderBy("topic_id")).alias("r"))
    own = t.withColumn("c", F.explode("cos")).select("topic_id", F.lit(0).alias("depth"), F.concat("subject", F.lit(":"), "c").alias("co"))
    base = t.select("subject", F.col("r").alias("r2"), F.col("cos").alias("cos2"))
    one = t.withColumn("r2", F.floor(F.col("r") / 2)).join(base, ["subject", "r2"]).withColumn("c", F.explode("cos2")).select("topic_id", F.lit(1).alias("depth"), F.concat("subject", F.lit(":"), "c").alias("co"))
    return own.unionByName(one).groupBy("topic_id", "co").agg(F.min("depth").alias("depth"))


QUERIES, SQL = query.queries, query.sql
