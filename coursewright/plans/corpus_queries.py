"""Queries over lines with their layout, of tiers of retrieval, of closures, and reports on the corpus tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from coursewright.functions import text as X
from coursewright.operators import graph as G
from coursewright.operators import layout as L
from coursewright.operators import retrieval as R
from coursewright.operators import sync as Y
from coursewright.plans import retrieval_queries as V
from coursewright.plans.registry import Registry
from coursewright.plans.text_queries import _VERB_CASE
from coursewright.session import table

query = Registry()

# ---- lines with their layout: the pages' lines, with sizes and places that follow from the text itself

_LINES = """pg AS (SELECT page_id, arg_max(paper, extracted_at) AS doc, arg_max(text, extracted_at) AS text FROM pyq_pages WHERE page_id IS NOT NULL AND text IS NOT NULL GROUP BY page_id),
 l0 AS (SELECT doc, page_id, unnest(string_split(text, chr(10))) AS text, unnest(range(1, 1 + len(string_split(text, chr(10))))) AS line_no FROM pg),
 lines AS (SELECT doc, page_id, CAST(line_no AS INT) AS line_no, text, CAST(9 + length(text) % 5 AS DOUBLE) AS size, starts_with(trim(text, ' '), 'Q1') AS bold, row_number() OVER (PARTITION BY page_id ORDER BY line_no) AS up, row_number() OVER (PARTITION BY page_id ORDER BY line_no DESC) AS down FROM l0 WHERE trim(text, ' ') <> '')"""


def _lines(spark, d):
    pages = table(spark, d, "pyq_pages").filter("page_id is not null and text is not null").groupBy("page_id").agg(F.max(F.struct("extracted_at", "text", "paper")).alias("m"))
    lines = pages.select(F.col("m.paper").alias("doc"), "page_id", F.posexplode(F.split("m.text", "\n")).alias("i", "text")).filter(F.trim("text") != "")
    return lines.select("doc", "page_id", (F.col("i") + 1).alias("line_no"), "text", (F.lit(9.0) + F.length("text") % 5).alias("size"), F.trim("text").startswith("Q1").alias("bold"))


@query(f"""WITH {_LINES}, m AS (SELECT doc, page_id, lower(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'), ' ')) AS key FROM lines WHERE up <= 3 OR down <= 3), n AS (SELECT doc, count(DISTINCT page_id) AS pages FROM lines GROUP BY doc)
 SELECT doc, key, count(DISTINCT page_id) AS pages FROM m JOIN n USING (doc) WHERE n.pages > 1 GROUP BY doc, key, n.pages HAVING count(DISTINCT page_id) >= greatest(2, n.pages // 2)""")
def margin_lines(spark, d):
    """Lines in the margins of half of a document's pages, two at least; figures count as they stand."""
    return L.repeated_margins(_lines(spark, d), edge=3)


@query(f"""WITH {_LINES}, s AS (SELECT doc, size, count(*) AS n FROM lines GROUP BY ALL), b AS (SELECT doc, arg_max(size, (n, -size)) AS body FROM s GROUP BY doc),
 h AS (SELECT lines.*, (size >= body + 2 OR bold) AND length(trim(text, ' ')) BETWEEN 4 AND 119 AS head FROM lines JOIN b USING (doc)), w AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY page_id, line_no) AS section FROM h)
 SELECT doc, CAST(section AS INT) AS section, max(CASE WHEN head THEN trim(text, ' ') END) AS title, min(page_id) AS first_page, max(page_id) AS last_page, count(*) AS n_lines FROM w WHERE section > 0 GROUP BY doc, section""")
def font_sections(spark, d):
    """Sections that start at lines in large or bold type."""
    return L.font_sections(_lines(spark, d))


# ---- retrieval in tiers

_TIER_BASE = f"""{V._BASE}, sub AS (SELECT q.vec_id AS query_id, r.vec_id AS vec_id, r.marks AS marks, q.label % 3 = r.label % 3 AND q.label <> r.label AS other, {V._DIST} AS dist FROM q JOIN v r ON q.label % 3 = r.label % 3 AND q.vec_id <> r.vec_id WHERE r.vec_id % 11 <> 0)"""


@query(f"""WITH {_TIER_BASE}, t1 AS (SELECT query_id, vec_id, marks, dist, 0 AS tier FROM same WHERE vec_id % 11 <> 0), t2 AS (SELECT query_id, vec_id, marks, dist, 1 AS tier FROM sub),
 a AS (SELECT *, row_number() OVER (PARTITION BY query_id, tier ORDER BY dist, vec_id) AS r FROM (FROM t1 UNION ALL FROM t2)), p AS (SELECT * FROM a WHERE r <= 24), o AS (SELECT query_id, vec_id, any_value(marks) AS marks, any_value(dist) AS dist, min(tier) AS tier FROM p GROUP BY query_id, vec_id),
 k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, abs(marks - 5) > 1, dist, vec_id) AS rank FROM o) SELECT query_id, CAST(rank AS INT) AS rank, vec_id, CASE WHEN tier = 0 THEN 'topic' ELSE 'subject' END AS match FROM k WHERE rank <= 8""")
def similar_in_tiers(spark, d):
    """The nearest of the same topic, topped up from the same subject, without excluded ids; within a tier marks near five go first."""
    rows, q = V._rows(spark, d).filter("vec_id % 11 <> 0"), V._queries(spark, d)
    topic = R.with_distance(R.in_blocks(q, rows, ["label"], "vec_id").filter("query_id <> vec_id"), "q_e", "embedding")
    by_subject = lambda df: df.withColumn("subject", F.col("label") % 3).drop("label")
    subject = R.with_distance(R.in_blocks(by_subject(q), by_subject(rows), ["subject"], "vec_id").filter("query_id <> vec_id"), "q_e", "embedding")
    far = F.abs(F.col("marks") - 5) > 1
    found = R.in_tiers([topic, subject], "query_id", "vec_id", n=8, pool=24, order=["dist", "vec_id"], prefer=far)
    return found.select("query_id", "rank", "vec_id", F.when(F.col("tier") == 0, "topic").otherwise("subject").alias("match"))


# ---- closure of outcomes


@query("""WITH RECURSIVE t AS (SELECT topic_id, subject, cos, row_number() OVER (PARTITION BY subject ORDER BY topic_id) AS r FROM topics), s AS (SELECT subject, lag(subject) OVER (ORDER BY subject) AS before FROM (SELECT DISTINCT subject FROM topics)),
 e AS (SELECT t.topic_id AS src, u.topic_id AS dst FROM t JOIN t u ON u.subject = t.subject AND u.r = t.r // 2 AND u.r >= 1 UNION SELECT t.topic_id, u.topic_id FROM t JOIN s USING (subject) JOIN t u ON u.subject = s.before AND t.r = 1 AND u.r = 1),
 w AS (SELECT topic_id AS start, topic_id AS node, 0 AS depth FROM topics UNION SELECT w.start, e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 60),
 c AS (SELECT w.start AS topic_id, t.subject, unnest(t.cos) AS short_id, w.depth FROM w JOIN t ON t.topic_id = w.node), m AS (SELECT topic_id, subject, short_id, min(depth) AS depth FROM c GROUP BY ALL), k AS (SELECT *, count(*) OVER (PARTITION BY topic_id, short_id) AS n FROM m)
 SELECT topic_id, subject, short_id, CAST(depth AS INT) AS depth, CASE WHEN n > 1 THEN subject || ':' || short_id ELSE short_id END AS label FROM k""")
def co_closure_all(spark, d):
    """Outcomes of a topic and of all it builds on, at any depth, with the least depth; a short name that several subjects use is qualified."""
    t = table(spark, d, "topics").select("topic_id", "subject", "cos", F.row_number().over(Window.partitionBy("subject").orderBy("topic_id")).alias("r"))
    subjects = t.select("subject").distinct().withColumn("before", F.lag("subject").over(Window.orderBy("subject")))  # a fixed list of subjects
    u = t.select(F.col("topic_id").alias("dst"), F.col("subject").alias("s2"), F.col("r").alias("r2"))
    within = t.join(u, (F.col("s2") == F.col("subject")) & (F.col("r2") == F.floor(F.col("r") / 2))).select(F.col("topic_id").alias("src"), "dst")
    across = t.filter("r = 1").join(subjects, "subject").join(u.filter("r2 = 1"), F.col("s2") == F.col("before")).select(F.col("topic_id").alias("src"), "dst")
    reach = G.closure(t.select(F.col("topic_id").alias("start")), within.unionByName(across))
    cos = reach.join(t.select(F.col("topic_id").alias("node"), "subject", F.explode("cos").alias("short_id")), "node").groupBy(F.col("start").alias("topic_id"), "subject", "short_id").agg(F.min("depth").alias("depth"))
    n = F.count(F.lit(1)).over(Window.partitionBy("topic_id", "short_id"))
    return cos.select("topic_id", "subject", "short_id", "depth", F.when(n > 1, F.concat("subject", F.lit(":"), "short_id")).otherwise(F.col("short_id")).alias("label"))


@query("""SELECT topic_id FROM (SELECT DISTINCT topic_id FROM documents WHERE topic_id IS NOT NULL UNION SELECT 'NO_SUCH_TOPIC') WHERE topic_id NOT IN (SELECT topic_id FROM topics)""")
def missing_topics(spark, d):
    """Topics that are asked for but don't exist: those of the documents and one made up."""
    asked = table(spark, d, "documents").select("topic_id").filter("topic_id is not null").unionByName(spark.createDataFrame([("NO_SUCH_TOPIC",)], "topic_id string")).distinct()
    return G.missing(asked, table(spark, d, "topics"), "topic_id")


# ---- reads and reports


@query("""WITH q AS (SELECT bank_id, arg_max(subject, loaded_at) AS subject, arg_max(question, loaded_at) AS question FROM generated_questions GROUP BY bank_id), w AS (SELECT *, row_number() OVER (ORDER BY bank_id) AS r FROM q WHERE bank_id IN (SELECT rec FROM (SELECT DISTINCT json_extract_string(s, '$.bank_id') AS rec FROM (SELECT unnest(json_extract(CASE WHEN json_valid(body) THEN body END, '$.slots[*]')) AS s FROM paper_files)) WHERE rec IS NOT NULL))
 SELECT bank_id, subject, question FROM w WHERE r BETWEEN 21 AND 40""")
def read_page_by_ids(spark, d):
    """The second page of twenty of the questions whose ids papers point to, in order of id."""
    slots = table(spark, d, "paper_files").select(F.explode(F.expr("try_variant_get(try_parse_json(body), '$.slots', 'array<variant>')")).alias("s"))
    ids = slots.select(F.expr("try_variant_get(s, '$.bank_id', 'string')").alias("bank_id")).filter("bank_id is not null").distinct()
    q = table(spark, d, "generated_questions").groupBy("bank_id").agg(F.max_by(F.struct("subject", "question"), "loaded_at").alias("m")).select("bank_id", "m.subject", "m.question")
    return R.read_page(q.join(ids, "bank_id", "left_semi"), ["bank_id"], page=2, size=20)


@query("""WITH t AS (SELECT doc_id, topic_id AS base, row_number() OVER (PARTITION BY topic_id ORDER BY doc_id) + CASE WHEN topic_id IN (SELECT topic_id FROM topics) THEN 1 ELSE 0 END AS n FROM documents WHERE topic_id IS NOT NULL)
 SELECT doc_id, CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS new_id FROM t""")
def ids_on_collision(spark, d):
    """Documents named by their topic, where the topics' own ids are taken."""
    docs = table(spark, d, "documents").filter("topic_id is not null").select("doc_id", "topic_id")
    return Y.free_ids(docs, table(spark, d, "topics").select("topic_id"), "topic_id", ["doc_id"]).select("doc_id", "new_id")


@query("""WITH u AS (SELECT json_extract_string(s, '$.bank_id') AS bank_id, min(paper_id) AS used_by FROM (SELECT paper_id, unnest(json_extract(CASE WHEN json_valid(body) THEN body END, '$.slots[*]')) AS s FROM paper_files) GROUP BY 1), b AS (SELECT DISTINCT bank_id FROM generated_questions)
 SELECT b.bank_id, u.used_by FROM b LEFT JOIN u USING (bank_id)""")
def mark_bank_used(spark, d):
    """Every question of the bank with the first paper that uses it."""
    slots = table(spark, d, "paper_files").select("paper_id", F.explode(F.expr("try_variant_get(try_parse_json(body), '$.slots', 'array<variant>')")).alias("s"))
    used = slots.select("paper_id", F.expr("try_variant_get(s, '$.bank_id', 'string')").alias("bank_id"))
    return Y.mark_used(table(spark, d, "generated_questions").select("bank_id").distinct(), used, "bank_id", "paper_id")


@query("SELECT coalesce(subject, '-') AS subject, count(*) AS n, count(DISTINCT section_title) AS titles, count(DISTINCT topic_id) AS topics FROM documents GROUP BY 1")
def counts_per_subject(spark, d):
    return table(spark, d, "documents").groupBy(F.coalesce("subject", F.lit("-")).alias("subject")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("section_title").alias("titles"), F.count_distinct("topic_id").alias("topics"))


def _judged(spark, d):
    q = table(spark, d, "pyq_questions").filter("metadata.type = 'question' and id is not null").groupBy("id").agg(F.max_by(F.struct("metadata", "document"), "loaded_at").alias("q"))
    return q.select("id", F.col("q.metadata.subject").alias("subject"), F.col("q.metadata.bloom_level").alias("label"), "q.document", F.col("q.metadata.topic_scores").alias("scores"))


@query(f"""WITH q AS (SELECT id, arg_max(metadata, loaded_at) AS m, arg_max(document, loaded_at) AS t FROM pyq_questions WHERE metadata.type = 'question' AND id IS NOT NULL GROUP BY id), l AS (SELECT id, m.subject AS subject, m.bloom_level AS label, lower(coalesce(t, '')) AS low FROM q), p AS (SELECT id, subject, label, {_VERB_CASE} AS predicted FROM l)
 SELECT id, subject, label, predicted FROM p WHERE label IN ('{"', '".join(X.LEVELS)}') AND label <> predicted""")
def wrong_rows(spark, d):
    """Questions whose printed level isn't the one their verbs show."""
    predicted = X.verb_level(F.col("document"))
    return _judged(spark, d).filter(F.col("label").isin(*X.LEVELS)).withColumn("predicted", predicted).filter("label <> predicted").select("id", "subject", "label", "predicted")


@query("""WITH q AS (SELECT id, arg_max(metadata, loaded_at) AS m FROM pyq_questions WHERE metadata.type = 'question' AND id IS NOT NULL GROUP BY id), s AS (SELECT id, unnest(m.topic_scores, recursive := true) FROM q), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC NULLS LAST, topic) AS r FROM s WHERE topic IS NOT NULL)
 SELECT id, string_agg(topic, ',' ORDER BY r) AS top FROM r WHERE r <= 3 GROUP BY id""")
def top_topics(spark, d):
    """The three best topics of each question, ties by name."""
    known = F.filter("scores", lambda x: x["topic"].isNotNull())
    best = F.slice(F.array_sort(F.transform(known, lambda x: F.struct(x["score"].isNull().alias("none"), (-x["score"]).alias("s"), x["topic"].alias("t")))), 1, 3)
    return _judged(spark, d).select("id", F.array_join(F.transform(best, lambda x: x["t"]), ",").alias("top")).filter("top <> ''")


@query("SELECT doc_id, coalesce(section_title, 'Untitled') AS title, CASE WHEN source IS NULL THEN 'unknown' ELSE source END AS collection, struct_pack(first := 1, last := CAST(1 + n_chars // 1500 AS BIGINT)).last AS last_page FROM documents WHERE NOT coalesce(n_chars > 4000, false)")
def result_projection(spark, d):
    """Documents as results: defaults filled in, pages worked out, suspect ones left out."""
    t = table(spark, d, "documents").filter(~F.coalesce(F.col("n_chars") > 4000, F.lit(False)))
    return t.select("doc_id", F.coalesce("section_title", F.lit("Untitled")).alias("title"), F.coalesce("source", F.lit("unknown")).alias("collection"), (F.floor(F.col("n_chars") / 1500) + 1).alias("last_page"))


@query("""SELECT DISTINCT id, metadata.source AS source, metadata.subject AS subject, metadata.year AS year, metadata.question_number AS n, regexp_replace(upper(regexp_replace(metadata.raw_co_code, '[\\s\\-]+', '', 'g')), '^C0([0-9])$', 'CO\\1') AS code, CAST(metadata.marks AS INT) AS marks FROM pyq_questions WHERE metadata.type = 'question'""")
def tag_projection(spark, d):
    """The columns of question records, with codes and marks coerced."""
    m = lambda c: F.col(f"metadata.{c}")
    q = table(spark, d, "pyq_questions").filter("metadata.type = 'question'")
    return q.select("id", m("source").alias("source"), m("subject").alias("subject"), m("year").alias("year"), m("question_number").alias("n"), X.normalize_code(m("raw_co_code")).alias("code"), F.round(m("marks")).cast("int").alias("marks")).distinct()


QUERIES, SQL = query.queries, query.sql
