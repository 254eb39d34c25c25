"""Queries of keyed synchronisation and of aggregates over the corpus tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from coursewright.operators import sync as S
from coursewright.plans.registry import Registry
from coursewright.session import table

query = Registry()

_EXPECTED = "expected AS (SELECT DISTINCT bank_id FROM generated_questions WHERE status = 'done')"
_STORED = "stored AS (SELECT DISTINCT json_extract_string(s, '$.bank_id') AS bank_id FROM (SELECT unnest(json_extract(CASE WHEN json_valid(body) THEN body END, '$.slots[*]')) AS s FROM paper_files) WHERE json_extract_string(s, '$.bank_id') IS NOT NULL)"


def _stored(spark, d):
    """Ids of the bank that paper files point to."""
    slots = table(spark, d, "paper_files").select(F.expr("try_variant_get(try_parse_json(body), '$.slots', 'array<variant>')").alias("s"))
    return slots.select(F.explode("s").alias("s")).select(F.expr("try_variant_get(s, '$.bank_id', 'string')").alias("bank_id")).filter("bank_id is not null").distinct()


def _expected(spark, d):
    return table(spark, d, "generated_questions").filter("status = 'done'").select("bank_id").distinct()


@query(f"WITH {_EXPECTED}, {_STORED} SELECT bank_id FROM expected WHERE bank_id NOT IN (SELECT bank_id FROM stored)")
def stale_ids(spark, d):
    """Finished questions of the bank that no paper points to."""
    return S.stale_keys(_expected(spark, d), _stored(spark, d), "bank_id")


@query(f"WITH {_EXPECTED}, {_STORED} SELECT coalesce(e.bank_id, s.bank_id) AS bank_id, CASE WHEN s.bank_id IS NULL THEN 'missing' ELSE 'extra' END AS status FROM expected e FULL JOIN stored s ON e.bank_id = s.bank_id WHERE e.bank_id IS NULL OR s.bank_id IS NULL")
def sync_drift(spark, d):
    return S.drift(_stored(spark, d), _expected(spark, d), "bank_id")


@query("SELECT bank_id, count(*) AS n FROM generated_questions GROUP BY bank_id HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return S.duplicate_keys(table(spark, d, "generated_questions"), "bank_id")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events WHERE event_type <> 'error' GROUP BY user_id")
def last_answer_per_id(spark, d):
    """The last valid row per key of an append log."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "value", "event_type")
    return S.last_per_key(e, "user_id", ["ts", "event_id"], "event_type <> 'error'").select("user_id", "event_id", "value")


@query("""WITH old AS (SELECT bank_id, arg_min(co, loaded_at) AS co, arg_min(marks, loaded_at) AS marks FROM (SELECT bank_id, coalesce(co, '-') AS co, coalesce(marks, -1) AS marks, loaded_at FROM generated_questions) GROUP BY bank_id), new AS (SELECT bank_id, arg_max(coalesce(bloom, '-'), loaded_at) AS co FROM generated_questions GROUP BY bank_id HAVING min(loaded_at) < max(loaded_at))
 SELECT old.bank_id, CASE WHEN new.bank_id IS NOT NULL THEN new.co ELSE old.co END AS co, marks FROM old LEFT JOIN new USING (bank_id)""")
def metadata_merge(spark, d):
    """Of every question the first row as stored, and for those sent again the latest as fresh."""
    g = table(spark, d, "generated_questions").select("bank_id", "loaded_at", F.coalesce("co", F.lit("-")).alias("co"), F.coalesce("marks", F.lit(-1.0)).alias("marks"), F.coalesce("bloom", F.lit("-")).alias("bloom"))
    both = g.groupBy("bank_id").agg(F.min_by("co", "loaded_at").alias("co"), F.min_by("marks", "loaded_at").alias("marks"), F.max_by("bloom", "loaded_at").alias("bloom"), (F.min("loaded_at") < F.max("loaded_at")).alias("again"))
    return S.merge_columns(both.select("bank_id", "co", "marks"), both.filter("again").select("bank_id", F.col("bloom").alias("co")), "bank_id", ["co"])


@query("""WITH q AS (SELECT id, arg_max(metadata.topic_id, loaded_at) AS topic, arg_max(metadata.tag_method, loaded_at) AS method FROM pyq_questions WHERE metadata.type = 'question' GROUP BY id), m AS (SELECT id, topic, 'manual' AS origin FROM q WHERE method = 'manual' OR topic IS NOT NULL), dd AS (SELECT id, topic, 'derived' AS origin FROM q)
 FROM m UNION ALL SELECT * FROM dd WHERE id NOT IN (SELECT id FROM m)""")
def keep_manual_records(spark, d):
    m = F.col("metadata")
    latest = lambda c: F.max(F.when(c.isNotNull(), F.struct("loaded_at", c.alias("v"))))["v"]  # noqa: E731  the latest that isn't null
    q = table(spark, d, "pyq_questions").filter(m["type"] == "question").groupBy("id").agg(latest(m["topic_id"]).alias("topic"), latest(m["tag_method"]).alias("method"))
    manual = q.filter("method = 'manual' or topic is not null").select("id", "topic", F.lit("manual").alias("origin"))
    return S.keep_over(manual, q.select("id", "topic", F.lit("derived").alias("origin")), "id")


@query("SELECT topic_id, doc_id, topic_id || '_doc_' || lpad(CAST(row_number() OVER (PARTITION BY topic_id ORDER BY doc_id) AS VARCHAR), 4, '0') AS stable_id FROM documents WHERE topic_id IS NOT NULL")
def stable_chunk_ids(spark, d):
    return S.stable_ids(table(spark, d, "documents").filter("topic_id is not null").select("topic_id", "doc_id"), "doc", "topic_id", ["doc_id"])


_SLOTS = """WITH one AS (SELECT paper_id, arg_max(body, loaded_at) AS body FROM paper_files GROUP BY paper_id), s AS (SELECT paper_id, unnest(json_extract(CASE WHEN json_valid(body) THEN body END, '$.slots[*]')) AS s FROM one),
 sl AS (SELECT paper_id, CAST(json_extract_string(s, '$.n') AS INT) AS n, json_extract_string(s, '$.spec.topic') AS topic, CAST(json_extract_string(s, '$.spec.marks') AS DOUBLE) AS marks, json_extract_string(s, '$.spec.difficulty') AS difficulty, json_extract_string(s, '$.status') AS status, json_extract_string(s, '$.bank_id') AS bank_id, json_extract_string(s, '$.co') AS co, CAST(json_extract_string(s, '$.marks') AS DOUBLE) AS got FROM s)"""


def _slots(spark, d):
    one = table(spark, d, "paper_files").groupBy("paper_id").agg(F.max_by("body", "loaded_at").alias("body"))
    s = one.select("paper_id", F.explode(F.expr("try_variant_get(try_parse_json(body), '$.slots', 'array<variant>')")).alias("s"))
    get = lambda p, t, name: F.expr(f"try_variant_get(s, '$.{p}', '{t}')").alias(name)
    return s.select("paper_id", get("n", "int", "n"), get("spec.topic", "string", "topic"), get("spec.marks", "double", "marks"), get("spec.difficulty", "string", "difficulty"), get("status", "string", "status"), get("bank_id", "string", "bank_id"), get("co", "string", "co"), get("marks", "double", "got"))


@query(f"{_SLOTS}, done AS (SELECT topic, marks, difficulty, count(*) AS k FROM sl WHERE status = 'done' GROUP BY ALL) SELECT sl.paper_id, sl.n, coalesce(done.k, 0) AS finished_alike FROM sl LEFT JOIN done ON sl.topic = done.topic AND sl.marks = done.marks AND sl.difficulty = done.difficulty WHERE sl.status IS DISTINCT FROM 'done'")
def resume_done_slots(spark, d):
    """Unfinished slots, with how many finished ones have the same specification."""
    s = _slots(spark, d)
    done = s.filter("status = 'done'").groupBy("topic", "marks", "difficulty").agg(F.count(F.lit(1)).alias("k"))
    return s.filter("not (status <=> 'done')").join(done, ["topic", "marks", "difficulty"], "left").select("paper_id", "n", F.coalesce("k", F.lit(0)).alias("finished_alike"))


@query("""WITH b AS (SELECT bank_id, arg_max(topic_id, loaded_at) AS topic, arg_max(marks, loaded_at) AS marks, arg_max(difficulty, loaded_at) AS difficulty, min(created) AS created FROM generated_questions WHERE status = 'done' GROUP BY bank_id), used AS (SELECT DISTINCT bank_id FROM """ + "(" + _SLOTS + """ SELECT bank_id FROM sl WHERE bank_id IS NOT NULL)),
 c AS (SELECT *, row_number() OVER (PARTITION BY topic, marks, difficulty ORDER BY created, bank_id) AS r FROM b WHERE bank_id NOT IN (SELECT bank_id FROM used) AND topic IS NOT NULL AND marks IS NOT NULL AND difficulty IS NOT NULL),
 w AS (SELECT *, row_number() OVER (PARTITION BY topic, marks, difficulty ORDER BY paper_id, n) AS r FROM (""" + _SLOTS + """ SELECT paper_id, n, topic, marks, difficulty FROM sl WHERE bank_id IS NULL)) SELECT w.paper_id, w.n, c.bank_id FROM w JOIN c USING (topic, marks, difficulty, r)""")
def reuse_bank_slots(spark, d):
    """Open slots filled from the bank: of each specification the k-th slot gets the k-th oldest unused question."""
    g = table(spark, d, "generated_questions").filter("status = 'done'")
    b = g.groupBy("bank_id").agg(F.max_by(F.struct("topic_id", "marks", "difficulty"), "loaded_at").alias("m"), F.min("created").alias("created")).select("bank_id", F.col("m.topic_id").alias("topic"), "m.marks", "m.difficulty", "created")
    s = _slots(spark, d)
    spec = ["topic", "marks", "difficulty"]
    c = b.join(s.filter("bank_id is not null").select("bank_id").distinct(), "bank_id", "left_anti").withColumn("r", F.row_number().over(Window.partitionBy(*spec).orderBy("created", "bank_id")))
    w = s.filter("bank_id is null").select("paper_id", "n", *spec).withColumn("r", F.row_number().over(Window.partitionBy(*spec).orderBy("paper_id", "n")))
    return w.join(c, [*spec, "r"]).select("paper_id", "n", "bank_id")


@query(f"{_SLOTS} SELECT paper_id, co, sum(got) AS marks FROM sl WHERE status = 'done' AND co IS NOT NULL GROUP BY ALL")
def co_coverage(spark, d):
    return _slots(spark, d).filter("status = 'done' and co is not null").groupBy("paper_id", "co").agg(F.sum("got").alias("marks"))


@query(f"{_SLOTS} SELECT p.paper_id, c.short_id AS co FROM (SELECT paper_id, split_part(min(topic), '_', 1) AS subject FROM sl GROUP BY paper_id) p JOIN course_outcomes c USING (subject) WHERE NOT EXISTS (SELECT 1 FROM sl WHERE sl.paper_id = p.paper_id AND sl.co = c.short_id AND sl.status = 'done')")
def untested_cos(spark, d):
    s = _slots(spark, d)
    p = s.groupBy("paper_id").agg(F.split_part(F.min("topic"), F.lit("_"), F.lit(1)).alias("subject"))
    want = p.join(table(spark, d, "course_outcomes"), "subject").select("paper_id", F.col("short_id").alias("co"))
    return want.join(s.filter("status = 'done'").select("paper_id", "co").distinct(), ["paper_id", "co"], "left_anti")


@query(f"""{_SLOTS}, h AS (SELECT paper_id, CAST(json_extract_string(b, '$.blueprint.total_marks') AS DOUBLE) AS total FROM (SELECT paper_id, CASE WHEN json_valid(body) THEN body::JSON END AS b FROM one))
 SELECT h.paper_id, h.total, coalesce(sum(sl.marks), 0) AS planned, any_value(h.total) IS NOT DISTINCT FROM sum(sl.marks) AS sum_ok, count(*) FILTER (sl.topic IS NOT NULL AND t.topic_id IS NULL) AS unknown_topics, count(*) FILTER (sl.difficulty NOT IN ('easy', 'medium', 'hard')) AS bad_difficulty FROM h LEFT JOIN sl ON sl.paper_id = h.paper_id LEFT JOIN topics t ON t.topic_id = sl.topic GROUP BY h.paper_id, h.total""")
def validate_blueprint(spark, d):
    one = table(spark, d, "paper_files").groupBy("paper_id").agg(F.max_by("body", "loaded_at").alias("body"))
    h = one.select("paper_id", F.expr("try_variant_get(try_parse_json(body), '$.blueprint.total_marks', 'double')").alias("total"))
    topics = table(spark, d, "topics").select(F.col("topic_id").alias("topic"), F.lit(True).alias("known"))
    j = h.join(_slots(spark, d).join(topics, "topic", "left"), "paper_id", "left")
    return j.groupBy("paper_id", "total").agg(F.coalesce(F.sum("marks"), F.lit(0.0)).alias("planned"), F.col("total").eqNullSafe(F.sum("marks")).alias("sum_ok"), F.count_if(F.col("topic").isNotNull() & F.col("known").isNull()).alias("unknown_topics"), F.count_if(~F.col("difficulty").isin("easy", "medium", "hard")).alias("bad_difficulty"))


@query("SELECT c.chunk_id, c.topic_id, t.topic_name, t.subject, coalesce(t.semester, 0) AS semester FROM (SELECT DISTINCT chunk_id, unnest(topic_ids) AS topic_id FROM tutorial_chunks) c LEFT JOIN topics t USING (topic_id)")
def tutorial_explode_join(spark, d):
    c = table(spark, d, "tutorial_chunks").select("chunk_id", F.explode("topic_ids").alias("topic_id")).distinct()
    t = table(spark, d, "topics").select("topic_id", "topic_name", "subject", "semester")
    return c.join(t, "topic_id", "left").select("chunk_id", "topic_id", "topic_name", "subject", F.coalesce("semester", F.lit(0)).alias("semester"))


@query("SELECT d.doc_id, coalesce(t.topic_id, 'NONE') AS topic_id, coalesce(t.subject, 'NONE') AS topic_subject, coalesce(t.semester, 0) AS semester, coalesce(t.semester < 4, false) AS is_prereq FROM documents d LEFT JOIN topics t USING (topic_id)")
def tag_join_topic_dim(spark, d):
    t = table(spark, d, "topics").select("topic_id", "subject", "semester", F.lit(True).alias("known"))
    j = table(spark, d, "documents").select("doc_id", "topic_id").join(t, "topic_id", "left")
    return j.select("doc_id", F.when(F.col("known"), F.col("topic_id")).otherwise("NONE").alias("topic_id"), F.coalesce("subject", F.lit("NONE")).alias("topic_subject"), F.coalesce("semester", F.lit(0)).alias("semester"), F.coalesce(F.col("semester") < 4, F.lit(False)).alias("is_prereq"))


@query("SELECT source, count(*) AS n, count(topic_id) AS tagged, count(*) FILTER (lang IS NULL) AS no_lang, CAST(floor(100 * count(topic_id) / count(*)) AS INT) AS pct FROM documents GROUP BY source")
def tag_summary(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("topic_id").alias("tagged"), F.count_if(F.col("lang").isNull()).alias("no_lang"), F.floor(100 * F.count("topic_id") / F.count(F.lit(1))).cast("int").alias("pct"))


@query("SELECT coalesce(metadata.tag_method, 'none') AS method, metadata.subject AS subject, count(*) AS n FROM pyq_questions WHERE metadata.type = 'question' GROUP BY ALL")
def method_histogram(spark, d):
    return table(spark, d, "pyq_questions").filter("metadata.type = 'question'").groupBy(F.coalesce("metadata.tag_method", F.lit("none")).alias("method"), F.col("metadata.subject").alias("subject")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT t.topic_id, count(d.doc_id) AS n, count(d.doc_id) FILTER (d.source LIKE 'book%') AS from_books, count(d.doc_id) = 0 AS gap FROM topics t LEFT JOIN documents d USING (topic_id) GROUP BY t.topic_id")
def topic_coverage_gaps(spark, d):
    j = table(spark, d, "topics").select("topic_id").join(table(spark, d, "documents").select("topic_id", "doc_id", "source"), "topic_id", "left")
    return j.groupBy("topic_id").agg(F.count("doc_id").alias("n"), F.count_if(F.col("source").like("book%")).alias("from_books"), (F.count("doc_id") == 0).alias("gap"))


@query("WITH c AS (SELECT source, section_title, count(*) AS n FROM documents WHERE topic_id IS NULL AND section_title IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, section_title) AS rank FROM c) SELECT source, section_title, n, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5")
def top_unlisted_chapters(spark, d):
    c = table(spark, d, "documents").filter("topic_id is null and section_title is not null").groupBy("source", "section_title").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "section_title"))).filter("rank <= 5")


@query("SELECT t.topic_id, coalesce(b.n, 0) AS books, coalesce(c.n, 0) AS tutorials, coalesce(b.n, 0) + coalesce(c.n, 0) = 0 AS ungrounded FROM topics t LEFT JOIN (SELECT topic_id, count(*) AS n FROM documents WHERE n_chars >= 60 GROUP BY ALL) b USING (topic_id) LEFT JOIN (SELECT topic_id, count(DISTINCT chunk_id) AS n FROM (SELECT chunk_id, unnest(topic_ids) AS topic_id FROM tutorial_chunks) GROUP BY ALL) c USING (topic_id)")
def grounding_coverage(spark, d):
    b = table(spark, d, "documents").filter("n_chars >= 60").groupBy("topic_id").agg(F.count(F.lit(1)).alias("b"))
    c = table(spark, d, "tutorial_chunks").select("chunk_id", F.explode("topic_ids").alias("topic_id")).groupBy("topic_id").agg(F.count_distinct("chunk_id").alias("c"))
    j = table(spark, d, "topics").select("topic_id").join(b, "topic_id", "left").join(c, "topic_id", "left")
    zero = F.lit(0)
    return j.select("topic_id", F.coalesce("b", zero).alias("books"), F.coalesce("c", zero).alias("tutorials"), (F.coalesce("b", zero) + F.coalesce("c", zero) == 0).alias("ungrounded"))


@query("SELECT topic_id FROM topics WHERE topic_id NOT IN (SELECT topic_id FROM documents WHERE topic_id IS NOT NULL AND n_chars >= 60 AND source LIKE 'book%')")
def ungrounded_topics(spark, d):
    ok = table(spark, d, "documents").filter("n_chars >= 60 and source like 'book%'").select("topic_id").distinct()
    return table(spark, d, "topics").select("topic_id").join(ok, "topic_id", "left_anti")


@query("SELECT metadata.exam AS exam, metadata.subject AS subject, array_to_string(list_sort(list_distinct(list(metadata.topic_id))), ' ') AS topics FROM pyq_questions WHERE metadata.type = 'question' AND metadata.topic_id IS NOT NULL GROUP BY ALL")
def topics_in_past_papers(spark, d):
    q = table(spark, d, "pyq_questions").filter("metadata.type = 'question' and metadata.topic_id is not null")
    return q.groupBy(F.col("metadata.exam").alias("exam"), F.col("metadata.subject").alias("subject")).agg(F.array_join(F.array_sort(F.collect_set("metadata.topic_id")), " ").alias("topics"))


@query("""WITH q AS (SELECT DISTINCT id, metadata.source AS paper, metadata.exam AS exam, metadata.marks AS marks FROM pyq_questions WHERE metadata.type = 'question'), p AS (SELECT exam, paper, coalesce(sum(marks), 0) AS total, count(*) AS n FROM q GROUP BY ALL),
 m AS (SELECT exam, total, count(*) AS c, min(paper) AS first FROM p GROUP BY ALL), b AS (SELECT exam, arg_min(total, (-c, first)) AS typical_total FROM m GROUP BY exam), s AS (SELECT exam, list_sort(list(n)) AS ns FROM p GROUP BY exam)
 SELECT b.exam, b.typical_total, ns[len(ns) // 2 + 1] AS typical_questions FROM b JOIN s USING (exam)""")
def exam_defaults(spark, d):
    """The most frequent total (ties: the first paper's) and the upper median of the number of questions, per kind of exam."""
    m = F.col("metadata")
    q = table(spark, d, "pyq_questions").filter(m["type"] == "question").select("id", m["source"].alias("paper"), m["exam"].alias("exam"), m["marks"].alias("marks")).distinct()
    p = q.groupBy("exam", "paper").agg(F.coalesce(F.sum("marks"), F.lit(0.0)).alias("total"), F.count(F.lit(1)).alias("n"))
    totals = p.groupBy("exam", "total").agg(F.count(F.lit(1)).alias("c"), F.min("paper").alias("first"))
    typical = totals.groupBy("exam").agg(F.min_by("total", F.struct(-F.col("c"), "first")).alias("typical_total"))
    # upper median from counts per size, so that no list of all papers is built
    sizes = p.groupBy("exam", "n").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("exam")
    run = sizes.withColumn("upto", F.sum("k").over(w.orderBy("n"))).withColumn("all", F.sum("k").over(w))
    median = run.filter(F.col("upto") > F.floor(F.col("all") / 2)).groupBy("exam").agg(F.min("n").alias("typical_questions"))
    return typical.join(median, "exam")


@query("""SELECT paper, coalesce(max_marks, total) AS max_marks, n_questions FROM (SELECT metadata.source AS paper, max(CASE WHEN metadata.type = 'header' THEN CAST(nullif(regexp_extract(document, '(?i)maximum marks:\\s*([0-9]+)', 1), '') AS DOUBLE) END) AS max_marks FROM pyq_questions GROUP BY ALL)
 JOIN (SELECT paper, sum(marks) AS total, count(*) AS n_questions FROM (SELECT DISTINCT id, metadata.source AS paper, metadata.marks AS marks FROM pyq_questions WHERE metadata.type = 'question') GROUP BY ALL) USING (paper)""")
def paper_header_extract(spark, d):
    m = F.col("metadata")
    t = table(spark, d, "pyq_questions")
    h = t.groupBy(m["source"].alias("paper")).agg(F.max(F.when(m["type"] == "header", F.expr("try_cast(nullif(regexp_extract(document, '(?i)maximum marks:\\\\s*([0-9]+)', 1), '') as double)"))).alias("max_marks"))
    q = t.filter(m["type"] == "question").select("id", m["source"].alias("paper"), m["marks"].alias("marks")).distinct().groupBy("paper").agg(F.sum("marks").alias("total"), F.count(F.lit(1)).alias("n_questions"))
    return h.join(q, "paper").select("paper", F.coalesce("max_marks", "total").alias("max_marks"), "n_questions")


_GP = "gp AS (SELECT o_orderpriority AS gold, CASE WHEN o_totalprice >= 300000 THEN '1-URGENT' WHEN o_totalprice >= 200000 THEN '2-HIGH' WHEN o_totalprice >= 120000 THEN '3-MEDIUM' WHEN o_totalprice >= 60000 THEN '4-NOT SPECIFIED' ELSE '5-LOW' END AS pred, CAST(o_orderkey % 8 AS INT) AS subject FROM orders)"


def _gold(spark, d):
    p = F.col("o_totalprice")
    pred = F.when(p >= 300000, "1-URGENT").when(p >= 200000, "2-HIGH").when(p >= 120000, "3-MEDIUM").when(p >= 60000, "4-NOT SPECIFIED").otherwise("5-LOW")
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("gold"), pred.alias("pred"), (F.col("o_orderkey") % 8).cast("int").alias("subject"))


@query(f"WITH {_GP}, n AS (SELECT count(*) AS n, count(*) FILTER (gold = pred) AS k FROM gp), m AS (SELECT sum(a.c * b.c) AS s FROM (SELECT gold AS x, CAST(count(*) AS DOUBLE) AS c FROM gp GROUP BY ALL) a JOIN (SELECT pred AS x, CAST(count(*) AS DOUBLE) AS c FROM gp GROUP BY ALL) b USING (x)) SELECT n, round(k / n, 6) AS accuracy, round((k / n - s / n / n) / (1 - s / n / n), 6) AS kappa FROM n, m")
def cohen_kappa(spark, d):
    from coursewright.operators.evaluate import kappa

    return kappa(_gold(spark, d))


@query(f"WITH {_GP} SELECT gold, pred, count(*) AS n FROM gp GROUP BY ALL")
def confusion_matrix(spark, d):
    return _gold(spark, d).groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_GP} SELECT subject, count(*) AS n, count(*) FILTER (gold = pred) AS correct, count(*) FILTER (abs(CAST(left(gold, 1) AS INT) - CAST(left(pred, 1) AS INT)) <= 1) AS near FROM gp GROUP BY subject")
def eval_scores(spark, d):
    g = _gold(spark, d)
    near = F.abs(F.substring("gold", 1, 1).cast("int") - F.substring("pred", 1, 1).cast("int")) <= 1
    return g.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gold") == F.col("pred")).alias("correct"), F.count_if(near).alias("near"))


@query("""WITH q AS (SELECT bank_id, max_by(topic_id, loaded_at) AS topic_id, min(created) AS created FROM generated_questions GROUP BY bank_id), r AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY created DESC, bank_id) AS rank FROM q) SELECT topic_id, bank_id, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def newest_per_topic(spark, d):
    q = table(spark, d, "generated_questions").groupBy("bank_id").agg(F.max_by("topic_id", "loaded_at").alias("topic_id"), F.min("created").alias("created"))
    return q.withColumn("rank", F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("created"), "bank_id"))).filter("rank <= 5").select("topic_id", "bank_id", "rank")


@query("SELECT o_custkey % 10 AS topic, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS oldest_unused, count(*) AS unused FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL")
def bank_usage_listing(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus <> 'F'")
    return o.groupBy((F.col("o_custkey") % 10).alias("topic")).agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("oldest_unused"), F.count(F.lit(1)).alias("unused"))


@query("""WITH q AS (SELECT DISTINCT id, metadata.marks_breakdown AS b FROM pyq_questions WHERE metadata.type = 'question') SELECT id, CASE WHEN len(b) > 0 AND len(list_filter(b, lambda x: x.marks IS NULL)) = 0 THEN list_sum(list_transform(b, lambda x: x.marks)) END AS total FROM q WHERE b IS NOT NULL""")
def marks_total(spark, d):
    """The sum over a question's parts; null where a part states none."""
    b = F.col("metadata.marks_breakdown")
    q = table(spark, d, "pyq_questions").filter("metadata.type = 'question'").select("id", b.alias("b")).distinct().filter("b is not null")
    known = ~F.exists("b", lambda x: x["marks"].isNull()) & (F.size("b") > 0)
    return q.select("id", F.when(known, F.aggregate("b", F.lit(0.0), lambda a, x: a + x["marks"])).alias("total"))


@query("""WITH c AS (SELECT DISTINCT chunk_id, description, topic_ids FROM tutorial_chunks) SELECT left(chunk_id, 3) AS subject, count(*) AS n, CAST(floor(sum(len(regexp_extract_all(coalesce(description, ''), '\\S+'))) / count(*)) AS BIGINT) AS avg_words, count(*) FILTER (topic_ids IS NULL OR len(topic_ids) = 0) AS untagged, count(*) FILTER (ceil(len(regexp_extract_all(coalesce(description, ''), '[A-Za-z]+|[0-9]+|[^\\sA-Za-z0-9]')) * CAST(1.2 AS DOUBLE)) > 254) AS too_long FROM c GROUP BY ALL""")
def verify_chunks(spark, d):
    from coursewright.functions.text import estimate_tokens

    c = table(spark, d, "tutorial_chunks").select("chunk_id", "description", "topic_ids").distinct()
    n_words = F.size(F.regexp_extract_all(F.coalesce("description", F.lit("")), F.lit(r"\S+"), F.lit(0)))
    return c.groupBy(F.substring("chunk_id", 1, 3).alias("subject")).agg(
        F.count(F.lit(1)).alias("n"), F.floor(F.sum(n_words) / F.count(F.lit(1))).alias("avg_words"), F.count_if(F.coalesce(F.size("topic_ids"), F.lit(0)) <= 0).alias("untagged"), F.count_if(estimate_tokens(F.col("description")) > 254).alias("too_long")
    )


@query("""WITH n AS (SELECT doc_id, lower(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'), ' ')) AS k FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(k)) AS first FROM n) SELECT first, count(*) AS copies FROM r GROUP BY first HAVING count(*) > 1""")
def dedup_exact_normalized(spark, d):
    """Exact copies up to case and blanks among all texts, with the smallest id of each class."""
    n = table(spark, d, "documents").filter("text is not null").select("doc_id", F.lower(F.trim(F.regexp_replace("text", r"[ \t\r\n]+", " "))).alias("k"))
    return n.groupBy(F.sha2("k", 256).alias("h")).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("first", "copies")


@query("SELECT 'both' AS part, count(*) AS n FROM (SELECT DISTINCT topic_id FROM documents WHERE topic_id IS NOT NULL INTERSECT SELECT DISTINCT topic_id FROM generated_questions) UNION ALL SELECT 'documents only', count(*) FROM (SELECT topic_id FROM documents WHERE topic_id IS NOT NULL EXCEPT SELECT topic_id FROM generated_questions) UNION ALL SELECT 'any', count(*) FROM (SELECT topic_id FROM documents WHERE topic_id IS NOT NULL UNION SELECT topic_id FROM generated_questions)")
def set_ops_ids(spark, d):
    a = table(spark, d, "documents").select("topic_id").filter("topic_id is not null").distinct()
    b = table(spark, d, "generated_questions").select("topic_id").distinct()
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return count(a.intersect(b), "both").unionByName(count(a.exceptAll(b), "documents only")).unionByName(count(a.union(b).distinct(), "any"))


@query("""WITH q AS (SELECT bank_id, max_by(co, loaded_at) AS co, max_by(subject, loaded_at) AS subject, max_by(bloom, loaded_at) AS bloom FROM generated_questions GROUP BY bank_id) SELECT bank_id, coalesce(c.co_level, q.bloom) AS bloom, CASE WHEN c.co_level IS NOT NULL THEN 'outcome' ELSE 'reading' END AS origin FROM q LEFT JOIN course_outcomes c ON c.subject = q.subject AND c.short_id = q.co""")
def bloom_label(spark, d):
    """An outcome's own level goes before what the question reads like."""
    q = table(spark, d, "generated_questions").groupBy("bank_id").agg(F.max_by(F.struct("co", "subject", "bloom"), "loaded_at").alias("m")).select("bank_id", "m.*")
    c = table(spark, d, "course_outcomes").select("subject", F.col("short_id").alias("co"), "co_level")
    return q.join(c, ["subject", "co"], "left").select("bank_id", F.coalesce("co_level", "bloom").alias("bloom"), F.when(F.col("co_level").isNotNull(), "outcome").otherwise("reading").alias("origin"))


@query("""WITH q AS (SELECT bank_id, max_by(topic_id, loaded_at) AS topic_id, max_by(co, loaded_at) AS co, max_by(bloom, loaded_at) AS bloom FROM generated_questions GROUP BY bank_id), t AS (SELECT topic_id, subject, i, cos[i] AS co FROM topics, LATERAL (SELECT unnest(range(1, 1 + len(cos))) AS i) x),
 c AS (SELECT t.topic_id, t.i, t.co, list_position(['Remember','Understand','Apply','Analyze','Evaluate','Create'], co_level) AS r FROM t LEFT JOIN course_outcomes c ON c.subject = t.subject AND c.short_id = t.co),
 j AS (SELECT q.bank_id, c.co, c.i, CASE WHEN c.co = q.co THEN -1 ELSE coalesce(abs(c.r - list_position(['Remember','Understand','Apply','Analyze','Evaluate','Create'], q.bloom)), 9) END AS diff FROM q JOIN c USING (topic_id)) SELECT bank_id, arg_min(co, (diff, i)) AS co FROM j GROUP BY bank_id""")
def choose_topic_co(spark, d):
    """The outcome picked for a question if its topic maps to it, else the topic's outcome of the nearest level, the first listed on a tie."""
    from coursewright.functions.text import level_rank

    q = table(spark, d, "generated_questions").groupBy("bank_id").agg(F.max_by(F.struct("topic_id", F.col("co").alias("picked"), "bloom"), "loaded_at").alias("m")).select("bank_id", "m.*")
    t = table(spark, d, "topics").select("topic_id", "subject", F.posexplode("cos").alias("i", "short_id"))
    c = t.join(table(spark, d, "course_outcomes").select("subject", "short_id", "co_level"), ["subject", "short_id"], "left")
    j = q.join(c, "topic_id")
    diff = F.when(F.col("short_id") == F.col("picked"), -1).otherwise(F.coalesce(F.abs(level_rank(F.col("co_level")) - level_rank(F.col("bloom"))), F.lit(9)))
    return j.withColumn("diff", diff).groupBy("bank_id").agg(F.min_by("short_id", F.struct("diff", "i")).alias("co"))


@query("""WITH t AS (SELECT topic_id, topic_name, subject, unnest(cos) AS co FROM topics), m AS (SELECT subject, co, count(*) AS n, min(topic_id) AS topic_id FROM t GROUP BY ALL), q AS (SELECT DISTINCT id, metadata.subject AS subject, metadata.course_outcome AS co FROM pyq_questions WHERE metadata.type = 'question' AND metadata.course_outcome IS NOT NULL)
 SELECT q.id, CASE WHEN n = 1 THEN topic_id END AS topic_id, coalesce(n, 0) <> 1 AS needs_review, CASE WHEN n IS NULL THEN 'no topic' WHEN n > 1 THEN 'several topics' END AS reason FROM q LEFT JOIN m USING (subject, co)""")
def assign_topic(spark, d):
    """An outcome that maps to one topic sets it; else a review with the reason."""
    m = table(spark, d, "topics").select("topic_id", "subject", F.explode("cos").alias("co")).groupBy("subject", "co").agg(F.count(F.lit(1)).alias("n"), F.min("topic_id").alias("topic_id"))
    meta = F.col("metadata")
    q = table(spark, d, "pyq_questions").filter((meta["type"] == "question") & meta["course_outcome"].isNotNull()).select("id", meta["subject"].alias("subject"), meta["course_outcome"].alias("co")).distinct()
    n = F.coalesce("n", F.lit(0))
    return q.join(m, ["subject", "co"], "left").select("id", F.when(n == 1, F.col("topic_id")).alias("topic_id"), (n != 1).alias("needs_review"), F.when(n == 0, "no topic").when(n > 1, "several topics").alias("reason"))


QUERIES, SQL = query.queries, query.sql
