"""Queries of vector retrieval. The query set is every vector whose id is divisible by 20."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from coursewright.functions.text import containment, word_ngrams
from coursewright.functions.vectors import cosine_from_l2, squared_l2
from coursewright.operators import retrieval as R
from coursewright.plans.registry import Registry
from coursewright.session import table

query = Registry()

_DIST = "round(list_sum(list_transform(list_zip(q.e, r.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6)"
_BASE = f"""v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, vec_id // 2 AS txt, CASE WHEN vec_id % 5 = 0 THEN 'tut' ELSE 'book' END AS coll, CAST(vec_id % 6 + 1 AS INT) AS marks, vec_id % 7 = 0 AS needs_review FROM embeddings),
 q AS (SELECT * FROM v WHERE vec_id % 20 = 0),
 same AS (SELECT q.vec_id AS query_id, r.vec_id AS vec_id, r.txt AS txt, q.txt AS qtxt, r.coll AS coll, r.marks AS marks, r.needs_review AS needs_review, q.label AS label, {_DIST} AS dist FROM q JOIN v r ON q.label = r.label AND q.vec_id <> r.vec_id)"""


def _similarity(places: int):
    """Rounded with a hair added, so that halves go up in every engine."""
    return F.round(cosine_from_l2(F.col("dist")) + 1e-9, places)


def _rows(spark, d):
    v = table(spark, d, "embeddings")
    return v.select("vec_id", "label", "embedding", F.floor(F.col("vec_id") / 2).alias("txt"), F.when(F.col("vec_id") % 5 == 0, "tut").otherwise("book").alias("coll"), (F.col("vec_id") % 6 + 1).cast("int").alias("marks"), (F.col("vec_id") % 7 == 0).alias("needs_review"))


def _queries(spark, d):
    return table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("q_e"), F.floor(F.col("vec_id") / 2).alias("qtxt"))


def _same(spark, d):
    pairs = R.in_blocks(_queries(spark, d), _rows(spark, d), ["label"], "vec_id").filter("query_id <> vec_id")
    return R.with_distance(pairs, "q_e", "embedding")


@query(f"WITH {_BASE}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id, txt ORDER BY dist, vec_id) AS t FROM same), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM o WHERE t = 1) SELECT query_id, CAST(rank AS INT) AS rank, vec_id, dist FROM k WHERE rank <= 5")
def knn_distinct(spark, d):
    return R.nearest_distinct(_same(spark, d), "query_id", "txt", 5, ["dist", "vec_id"]).select("query_id", "rank", "vec_id", "dist")


@query(f"""WITH {_BASE}, a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS r FROM same), b AS (SELECT *, row_number() OVER (PARTITION BY query_id, txt ORDER BY dist, vec_id) AS t FROM a WHERE r <= 6),
 c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM b WHERE t = 1) SELECT query_id, CAST(rank AS INT) AS rank, vec_id, round(1 - dist / 2 + 1e-9, 4) AS similarity FROM c WHERE rank <= 3""")
def nearest_normalized(spark, d):
    """Twice the limit is fetched, then texts are made distinct: fewer than the limit may be left."""
    fetched = R.nearest(_same(spark, d), "query_id", 6, ["dist", "vec_id"])
    return R.nearest_distinct(fetched, "query_id", "txt", 3, ["dist", "vec_id"]).select("query_id", "rank", "vec_id", _similarity(4).alias("similarity"))


@query(f"""WITH {_BASE}, pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS r FROM same), k AS (SELECT *, abs(marks - 5) > 1 AS differs FROM pool WHERE r <= 12),
 o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY differs, dist, vec_id) AS rank FROM k) SELECT query_id, CAST(rank AS INT) AS rank, vec_id, marks FROM o WHERE rank <= 3""")
def similar_pyqs(spark, d):
    """Of the twelve nearest, those with marks within one of five come first."""
    pool = R.nearest(_same(spark, d), "query_id", 12, ["dist", "vec_id"]).drop("rank").withColumn("differs", F.abs(F.col("marks") - 5) > 1)
    w = Window.partitionBy("query_id").orderBy("differs", "dist", "vec_id")
    return pool.withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("query_id", "rank", "vec_id", "marks")


@query(f"""WITH {_BASE}, s AS (SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS dist FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)
 SELECT vec_id, dist, round(1 - dist / 2 + 1e-9, 6) AS similarity FROM s""")
def cosine_from_l2_pairs(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    b = table(spark, d, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    s = v.join(b, "vec_id").select("vec_id", F.round(squared_l2(F.col("a"), F.col("b")), 6).alias("dist"))
    return s.withColumn("similarity", _similarity(6))


_ALL = f"allp AS (SELECT q.vec_id AS query_id, q.label AS own, r.label AS topic, r.vec_id, r.txt, {_DIST} AS dist FROM q JOIN v r ON q.vec_id <> r.vec_id AND NOT r.needs_review)"
_SCORES = f"""{_ALL}, td AS (SELECT *, row_number() OVER (PARTITION BY query_id, topic, txt ORDER BY dist, vec_id) AS t FROM allp), tk AS (SELECT *, row_number() OVER (PARTITION BY query_id, topic ORDER BY dist, vec_id) AS r FROM td WHERE t = 1),
 scores AS (SELECT query_id, own, topic, round(avg(1 - dist / 2) + 1e-9, 4) AS score FROM tk WHERE r <= 3 GROUP BY ALL)"""


def _scores(spark, d):
    """Mean similarity of the three nearest distinct texts per query and topic; texts under review don't count."""
    q = _queries(spark, d).withColumnRenamed("label", "own")
    pairs = R.with_distance(R.in_blocks(q, _rows(spark, d).filter("not needs_review").withColumnRenamed("label", "topic"), [], "txt").filter("query_id <> vec_id"), "q_e", "embedding")
    one = pairs.withColumn("t", F.row_number().over(Window.partitionBy("query_id", "topic", "txt", "_block").orderBy("dist", "vec_id"))).filter("t = 1")
    top = R.nearest(one, "query_id", 3, ["dist", "vec_id"], ["topic"])
    return top.groupBy("query_id", "own", "topic").agg(F.round(F.avg(cosine_from_l2(F.col("dist"))) + 1e-9, 4).alias("score"))


@query(f"WITH {_BASE}, {_SCORES} SELECT query_id, topic, score FROM scores")
def topic_scores(spark, d):
    return _scores(spark, d).select("query_id", "topic", "score")


@query(f"""WITH {_BASE}, {_SCORES}, w AS (SELECT *, row_number() OVER (PARTITION BY query_id, topic IN (own, (own + 1) % 10) ORDER BY score DESC, topic) AS r, topic IN (own, (own + 1) % 10) AS mapped FROM scores),
 p AS (SELECT query_id, max(CASE WHEN mapped AND r = 1 THEN topic END) AS best, max(CASE WHEN mapped AND r = 1 THEN score END) AS s1, max(CASE WHEN mapped AND r = 2 THEN score END) AS s2, max(CASE WHEN NOT mapped AND r = 1 THEN topic END) AS outside, max(CASE WHEN NOT mapped AND r = 1 THEN score END) AS so FROM w GROUP BY query_id)
 SELECT query_id, CASE WHEN so >= s1 + 0.05 THEN outside ELSE best END AS topic, so >= s1 + 0.05 AS mismatch, CASE WHEN so >= s1 + 0.05 THEN 'override' WHEN s1 - s2 < 0.01 THEN 'low-confidence' ELSE 'best' END AS method FROM p""")
def decide_topic(spark, d):
    """The best topic of those an outcome maps to, unless another leads by 0.05; a lead under 0.01 is low confidence."""
    mapped = (F.col("topic") == F.col("own")) | (F.col("topic") == (F.col("own") + 1) % 10)
    s = _scores(spark, d).withColumn("mapped", mapped)
    s = s.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "mapped").orderBy(F.desc("score"), "topic")))
    pick = lambda cond, col: F.max(F.when(F.expr(cond), F.col(col)))
    p = s.groupBy("query_id").agg(pick("mapped and r = 1", "topic").alias("best"), pick("mapped and r = 1", "score").alias("s1"), pick("mapped and r = 2", "score").alias("s2"), pick("not mapped and r = 1", "topic").alias("outside"), pick("not mapped and r = 1", "score").alias("so"))
    over = F.col("so") >= F.col("s1") + 0.05
    return p.select("query_id", F.when(over, F.col("outside")).otherwise(F.col("best")).alias("topic"), over.alias("mismatch"), F.when(over, "override").when(F.col("s1") - F.col("s2") < 0.01, "low-confidence").otherwise("best").alias("method"))


@query(f"""WITH {_BASE}, {_SCORES}, c AS (SELECT query_id, topic, score FROM scores WHERE topic IN ((own + 1) % 10, (own + 2) % 10, (own + 3) % 10)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, topic) AS r, count(*) OVER (PARTITION BY query_id) AS n FROM c)
 SELECT query_id, topic AS blend, score FROM r WHERE r = 1 AND n >= 2""")
def choose_blend(spark, d):
    """The best-fitting of three candidate topics; none where fewer than two have text."""
    cand = F.pmod(F.col("topic") - F.col("own"), F.lit(10)).between(1, 3)
    c = _scores(spark, d).filter(cand)
    w = Window.partitionBy("query_id")
    r = c.withColumn("r", F.row_number().over(w.orderBy(F.desc("score"), "topic"))).withColumn("n", F.count(F.lit(1)).over(w))
    return r.filter("r = 1 and n >= 2").select("query_id", F.col("topic").alias("blend"), "score")


_PAIRS = "near AS (SELECT query_id, vec_id, dist, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS r FROM same WHERE txt <> qtxt), pairs AS (SELECT least(query_id, vec_id) AS a, greatest(query_id, vec_id) AS b, min(round(1 - dist / 2 + 1e-9, 4)) AS similarity FROM near WHERE r = 1 GROUP BY ALL)"


def _pairs(spark, d):
    near = R.nearest(_same(spark, d).filter("txt <> qtxt"), "query_id", 1, ["dist", "vec_id"])
    return near.groupBy(F.least("query_id", "vec_id").alias("a"), F.greatest("query_id", "vec_id").alias("b")).agg(F.min(_similarity(4)).alias("similarity"))


@query(f"WITH {_BASE}, {_PAIRS} SELECT a, b, similarity FROM pairs")
def calibrate_pairs(spark, d):
    """Each query's nearest other text of its label, every pair once."""
    return _pairs(spark, d)


@query(f"WITH {_BASE}, {_PAIRS} SELECT t.t AS threshold, count(*) FILTER (similarity >= t.t) AS n_pairs FROM pairs, (SELECT unnest([0.80, 0.85, 0.90, 0.95]::DOUBLE[]) AS t) t GROUP BY t.t")
def calibration_histogram(spark, d):
    p = _pairs(spark, d)
    return p.select("similarity", F.explode(F.array(*[F.lit(x) for x in (0.80, 0.85, 0.90, 0.95)])).alias("threshold")).groupBy("threshold").agg(F.count_if(F.col("similarity") >= F.col("threshold")).alias("n_pairs"))


_GRAMS = "CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) ELSE []::VARCHAR[] END"


@query(f"""WITH {_BASE}, t AS (SELECT doc_id, {_GRAMS} AS g FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents)),
 k AS (SELECT *, row_number() OVER (PARTITION BY query_id, coll ORDER BY dist, vec_id) AS r FROM same),
 o AS (SELECT query_id, coll, vec_id, round(1 - dist / 2 + 1e-9, 4) AS similarity, CASE WHEN len(a.g) > 0 THEN len(list_intersect(a.g, b.g)) / CAST(len(a.g) AS DOUBLE) ELSE 0.0 END AS overlap FROM k LEFT JOIN t a ON a.doc_id = query_id LEFT JOIN t b ON b.doc_id = vec_id WHERE r <= 3),
 p AS (SELECT query_id, coll, arg_max(vec_id, (similarity, overlap, -vec_id)) AS closest, max(similarity) AS similarity, bool_or(similarity >= 0.78 OR overlap >= 0.5) AS is_duplicate FROM o GROUP BY ALL) SELECT query_id, coll, closest, similarity, is_duplicate FROM p""")
def dedup_check(spark, d):
    """Per place the three nearest; a duplicate by similarity or by shared wording."""
    near = R.nearest(_same(spark, d), "query_id", 3, ["dist", "vec_id"], ["coll"])
    t = table(spark, d, "documents").select("doc_id", word_ngrams(F.col("text")).alias("g"))
    o = near.join(t.select(F.col("doc_id").alias("query_id"), F.col("g").alias("ga")), "query_id", "left").join(t.select(F.col("doc_id").alias("vec_id"), F.col("g").alias("gb")), "vec_id", "left")
    none = F.array().cast("array<string>")
    o = o.withColumn("similarity", _similarity(4)).withColumn("overlap", containment(F.coalesce("ga", none), F.coalesce("gb", none)))
    return o.groupBy("query_id", "coll").agg(F.max_by("vec_id", F.struct("similarity", "overlap", -F.col("vec_id"))).alias("closest"), F.max("similarity").alias("similarity"), F.bool_or((F.col("similarity") >= 0.78) | (F.col("overlap") >= 0.5)).alias("is_duplicate"))


@query(f"""WITH {_BASE}, f AS (SELECT * FROM same WHERE NOT needs_review), tut AS (SELECT query_id, vec_id, dist, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS r FROM f WHERE coll = 'tut'), t2 AS (SELECT * FROM tut WHERE r <= 2),
 tb AS (SELECT t2.query_id, t2.r, t2.vec_id AS tut, r.vec_id AS book, row_number() OVER (PARTITION BY t2.query_id, t2.r ORDER BY {_DIST}, r.vec_id) AS k FROM t2 JOIN v q ON q.vec_id = t2.vec_id JOIN v r ON r.label = q.label AND r.coll = 'book' AND NOT r.needs_review),
 b1 AS (SELECT query_id, r, book FROM tb WHERE r = 1 AND k = 1), b2 AS (SELECT tb.query_id, tb.r, arg_min(tb.book, tb.k) AS book FROM tb LEFT JOIN b1 USING (query_id) WHERE tb.r = 2 AND tb.book IS DISTINCT FROM b1.book GROUP BY ALL),
 taken AS (SELECT query_id, vec_id FROM t2 UNION SELECT query_id, book FROM b1 UNION SELECT query_id, book FROM b2),
 rest AS (SELECT f.query_id, f.vec_id, row_number() OVER (PARTITION BY f.query_id ORDER BY f.dist, f.vec_id) AS k FROM f ANTI JOIN taken USING (query_id, vec_id)), n AS (SELECT query_id, 5 - count(*) AS room FROM taken GROUP BY query_id)
 SELECT query_id, vec_id, 'rest' AS found_by FROM rest JOIN n USING (query_id) WHERE k <= room UNION ALL SELECT query_id, vec_id, 'tutorial' FROM t2 UNION ALL SELECT query_id, book, 'explains' FROM b1 UNION ALL SELECT query_id, book, 'explains' FROM b2""")
def quota_retrieval(spark, d):
    """Two tutorial questions, the nearest unused book text to each, and the rest by nearness: five in all."""
    f = _same(spark, d).filter("not needs_review")
    t2 = R.nearest(f.filter("coll = 'tut'"), "query_id", 2, ["dist", "vec_id"]).select("query_id", F.col("rank").alias("r"), F.col("vec_id").alias("tut"), "label")
    v = _rows(spark, d)
    tb = t2.join(v.select(F.col("vec_id").alias("tut"), F.col("embedding").alias("te")), "tut")
    tb = R.with_distance(R.in_blocks(tb, v.filter("coll = 'book' and not needs_review"), ["label"], "vec_id"), "te", "embedding")
    tb = R.nearest(tb, "query_id", 2, ["dist", "vec_id"], ["r"])
    b1 = tb.filter("r = 1 and rank = 1").select("query_id", F.col("vec_id").alias("b1"))
    b2 = tb.filter("r = 2").join(b1, "query_id", "left").filter(~F.col("vec_id").eqNullSafe(F.col("b1"))).groupBy("query_id").agg(F.min_by("vec_id", "rank").alias("vec_id"))
    tuts = t2.select("query_id", F.col("tut").alias("vec_id"))
    books = b1.select("query_id", F.col("b1").alias("vec_id")).unionByName(b2)
    taken = tuts.unionByName(books).distinct()
    room = taken.groupBy("query_id").agg((5 - F.count(F.lit(1))).alias("room"))
    rest = R.nearest(f.join(taken, ["query_id", "vec_id"], "left_anti"), "query_id", 5, ["dist", "vec_id"]).join(room, "query_id").filter("rank <= room")
    by = lambda df, how: df.select("query_id", "vec_id", F.lit(how).alias("found_by"))
    return by(rest, "rest").unionByName(by(tuts, "tutorial")).unionByName(by(books, "explains"))


@query("""SELECT doc_id, source, lang FROM documents WHERE topic_id = 'OSK_02' AND coalesce(n_chars, 0) > 0""")
def filter_topic_reviewed(spark, d):
    return table(spark, d, "documents").filter((F.col("topic_id") == "OSK_02") & (F.coalesce("n_chars", F.lit(0)) > 0)).select("doc_id", "source", "lang")


@query(f"""WITH {_BASE}, f AS (SELECT * FROM same WHERE coll = 'book'), core AS (SELECT *, marks <= 4 AS is_core FROM f), h AS (SELECT query_id, bool_or(is_core) AS has_core FROM core GROUP BY query_id),
 m AS (SELECT core.*, row_number() OVER (PARTITION BY query_id ORDER BY vec_id % 3 = 0, dist, vec_id) AS r FROM core JOIN h USING (query_id) WHERE is_core OR NOT has_core), main AS (SELECT query_id, vec_id, CAST(r AS INT) AS rank, label FROM m WHERE r <= 3),
 b AS (SELECT q.query_id, r.vec_id, r.dist, row_number() OVER (PARTITION BY q.query_id ORDER BY r.dist, r.vec_id) AS k FROM (SELECT DISTINCT query_id, label FROM main) q JOIN (SELECT q.vec_id AS query_id, r.vec_id, r.label, {_DIST} AS dist FROM q JOIN v r ON r.label = (q.label + 1) % 10) r USING (query_id))
 SELECT query_id, vec_id, rank, 'main' AS role FROM main UNION ALL SELECT query_id, vec_id, CAST(k AS INT), 'blend' FROM b WHERE k <= 2""")
def grounding_main_blend(spark, d):
    """Grounding of a query: three core texts of its topic (advanced ones only where there is no core text; texts used before, here every third, last) and two of the blended topic."""
    f = _same(spark, d).filter("coll = 'book'").withColumn("is_core", F.col("marks") <= 4)
    has = f.groupBy("query_id").agg(F.bool_or("is_core").alias("has_core"))
    usable = f.join(has, "query_id").filter("is_core or not has_core").withColumn("used", F.col("vec_id") % 3 == 0)
    main = R.nearest(usable, "query_id", 3, ["used", "dist", "vec_id"])
    q = _queries(spark, d).join(main.select("query_id").distinct(), "query_id", "left_semi").withColumn("label", (F.col("label") + 1) % 10)
    blend = R.nearest(R.with_distance(R.in_blocks(q, _rows(spark, d), ["label"], "vec_id"), "q_e", "embedding"), "query_id", 2, ["dist", "vec_id"])
    return main.select("query_id", "vec_id", "rank", F.lit("main").alias("role")).unionByName(blend.select("query_id", "vec_id", "rank", F.lit("blend").alias("role")))


QUERIES, SQL = query.queries, query.sql
