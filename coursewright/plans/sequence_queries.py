"""Queries over lines, pages and sections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from coursewright.operators import sequence as S
from coursewright.plans.registry import Registry
from coursewright.session import table

query = Registry()

_LINES = "lines AS (SELECT doc_id, i AS line_no, string_split(text, chr(10))[i] AS line FROM documents, LATERAL (SELECT unnest(range(1, 1 + len(string_split(text, chr(10))))) AS i) x WHERE text IS NOT NULL)"
_PAGES = "pg AS (SELECT page_id, any_value(paper) AS paper, any_value(text) AS text FROM pyq_pages GROUP BY page_id), plines AS (SELECT page_id, paper, i AS line_no, string_split(text, chr(10))[i] AS line FROM pg, LATERAL (SELECT unnest(range(1, 1 + len(string_split(text, chr(10))))) AS i) x WHERE text IS NOT NULL)"


def _pages(spark, d):
    return table(spark, d, "pyq_pages").groupBy("page_id").agg(F.first("paper").alias("paper"), F.first("text").alias("text"))


def _page_lines(spark, d):
    p = _pages(spark, d)
    return S.lines_of(p, "page_id").join(p.select("page_id", "paper"), "page_id")


@query(f"""WITH {_LINES}, h AS (SELECT doc_id, line_no, nullif(regexp_extract(line, '^(?:Q|Lab |[0-9]+\\. )([0-9]*)', 0), '') AS v, regexp_matches(line, '^#') AS reset FROM lines WHERE trim(line, ' ') <> ''),
 s AS (SELECT *, sum(CASE WHEN reset THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS seg FROM h)
 SELECT doc_id, line_no::INT AS line_no, CASE WHEN NOT reset THEN last_value(CASE WHEN NOT reset THEN v END IGNORE NULLS) OVER (PARTITION BY doc_id, seg ORDER BY line_no) END AS chapter FROM s""")
def carry_forward_chapter(spark, d):
    """The last numbered heading carried over the lines below it; a line starting with # resets it."""
    l = S.lines_of(table(spark, d, "documents"), "doc_id").filter(F.trim("line") != "")
    v = F.regexp_extract("line", r"^(?:Q|Lab |[0-9]+\. )([0-9]*)", 0)
    out = S.carry_forward(l, "doc_id", "line_no", F.when(v != "", v), F.col("line").rlike("^#"), F.lit(True), "chapter")
    return out.select("doc_id", "line_no", "chapter")


@query(f"""WITH {_PAGES}, m AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY line_no) AS a, row_number() OVER (PARTITION BY page_id ORDER BY line_no DESC) AS b FROM plines WHERE trim(line, ' ') <> ''),
 k AS (SELECT paper, page_id, lower(regexp_replace(regexp_replace(trim(line, ' '), '[0-9]+', '#', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS margin_key FROM m WHERE a <= 2 OR b <= 2) SELECT paper, margin_key, count(DISTINCT page_id) AS pages FROM k GROUP BY ALL HAVING count(DISTINCT page_id) >= 3""")
def running_lines(spark, d):
    l = _page_lines(spark, d).filter(F.trim("line") != "")
    w = Window.partitionBy("page_id")
    edge = l.withColumn("a", F.row_number().over(w.orderBy("line_no"))).withColumn("b", F.row_number().over(w.orderBy(F.desc("line_no")))).filter("a <= 2 or b <= 2")
    return S.running_keys(edge, "paper", "page_id")


# How a figure's label, a contents line, a page number and a chapter's outline are written.
_LABEL = r"^(?:[A-Za-z0-9]{1,3}|[0-9]+(?:\.[0-9]+)?|[0-9]+,[0-9]+|\*+|\})$"


@query(f"""WITH {_PAGES}, l AS (SELECT *, regexp_matches(trim(line, ' '), '{_LABEL}') AS lab FROM plines WHERE trim(line, ' ') <> ''), i AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY line_no) - row_number() OVER (PARTITION BY page_id, lab ORDER BY line_no) AS isl FROM l),
 n AS (SELECT *, count(*) OVER (PARTITION BY page_id, lab, isl) AS n FROM i) SELECT page_id, line_no::INT AS line_no FROM n WHERE NOT lab OR n < 2""")
def drop_label_runs(spark, d):
    l = _page_lines(spark, d).filter(F.trim("line") != "")
    return S.drop_runs(l, "page_id", F.trim("line").rlike(_LABEL), 2).select("page_id", "line_no")


# See above.
_LEADER, _NUMBER, _OUTLINE = r"(?:\.\s?){5,}\s*\S{0,8}\s*$", r"^(?:[0-9]{1,4}|[0-9]{1,3}-[0-9]{1,4}|(?i:[ivxlcdm]{1,7}))$", r"\S\s+[•·]\s+\S"


@query(f"""WITH {_PAGES}, m AS (SELECT page_id, line_no, regexp_matches(trim(line, ' '), '{_LEADER}') AS lead_, regexp_matches(trim(line, ' '), '{_NUMBER}') AS num, regexp_matches(trim(line, ' '), '{_OUTLINE}') AS outl FROM plines),
 p AS (SELECT *, coalesce(lag(lead_) OVER (PARTITION BY page_id ORDER BY line_no), false) AS after FROM m) SELECT page_id, line_no::INT AS line_no FROM p WHERE NOT lead_ AND NOT (num AND after) AND NOT outl""")
def drop_contents_lines(spark, d):
    return S.drop_contents(_page_lines(spark, d), "page_id", _LEADER, _NUMBER, _OUTLINE).select("page_id", "line_no")


@query(f"""WITH {_LINES}, a AS (SELECT *, list(trim(line, ' ')) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS aft, lower(regexp_extract(trim(line, ' '), '(?i)^(?:[0-9]+(?:\\.[0-9]+)*\\s+)?(references|bibliography|further reading|acknowledge?ments?|chapter notes)\\s*$', 1)) AS head FROM lines),
 b AS (SELECT *, list_filter(coalesce(aft, []), lambda x: x <> '') AS af FROM a), c AS (SELECT *, head <> '' AND (len(af) = 0 OR CASE WHEN head IN ('references', 'bibliography') THEN len(list_filter(af[1:3], lambda x: regexp_matches(x, '^(?:\\[[0-9]+\\]|[0-9]{{1,3}}\\.\\s+[A-Z])'))) > 0 AND len(list_filter(af[1:6], lambda x: regexp_matches(x, '\\b(?:1[89]|20)[0-9][0-9]\\b'))) > 0 ELSE coalesce(length(af[1]) >= 30, false) END) AS hit FROM b),
 f AS (SELECT *, min(CASE WHEN hit THEN line_no END) OVER (PARTITION BY doc_id) AS first FROM c) SELECT doc_id, count(*) AS kept FROM f WHERE first IS NULL OR line_no < first GROUP BY doc_id""")
def cut_back_matter(spark, d):
    l = S.lines_of(table(spark, d, "documents"), "doc_id").withColumn("hit", S.back_matter_hit())
    return S.cut_at_first(l, "doc_id", F.col("hit")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))


@query("""WITH e AS (SELECT o_custkey AS book, o_orderkey AS ordinal, o_orderpriority AS title, CAST(floor(o_totalprice / 20000) AS BIGINT) * 2 + 1 AS start FROM orders), o AS (SELECT book, start, arg_min(title, ordinal) AS title FROM e GROUP BY ALL)
 SELECT book, title, start AS first_page, coalesce(lead(start) OVER (PARTITION BY book ORDER BY start) - 1, max(start) OVER (PARTITION BY book) + 1) AS last_page FROM o""")
def toc_sections(spark, d):
    """Orders as the contents entries of their customer's book: pages belong to the entry that starts at or before them."""
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderpriority").alias("title"), (F.floor(F.col("o_totalprice") / 20000) * 2 + 1).alias("start"))
    return S.sections_from_starts(e, "book", F.col("start") + 1)


@query("""WITH m AS (SELECT user_id, ts, event_id AS mark FROM events WHERE event_type = 'purchase'), f AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click')
 SELECT f.event_id, (SELECT arg_max(m.mark, (m.ts, m.mark)) FROM m WHERE m.user_id = f.user_id AND m.ts <= f.ts) AS last_mark FROM f""")
def asof_assign_figures(spark, d):
    """Each click with the user's last purchase at or before it."""
    e = table(spark, d, "events")
    marks = e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("mark"))
    return S.asof_last(e.filter("event_type = 'click'").select("user_id", "ts", "event_id"), marks, "user_id", "ts", "mark").select("event_id", "last_mark")


@query(f"""WITH {_PAGES}, s AS (SELECT *, nullif(regexp_extract(line, '^ *(?:\\*\\*)?Q\\.? ?([0-9]+)', 1), '') AS num FROM plines), f AS (SELECT *, row_number() OVER (PARTITION BY paper, num ORDER BY page_id, line_no) AS occ FROM s),
 b AS (SELECT *, sum(CASE WHEN num IS NOT NULL AND occ = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY paper ORDER BY page_id, line_no) AS block FROM f) SELECT paper, CAST(block AS BIGINT) AS block, max(CASE WHEN occ = 1 THEN num END) AS number, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM b GROUP BY ALL""")
def split_questions(spark, d):
    """A paper's lines cut at the first occurrence of each question number."""
    num = F.regexp_extract("line", r"^ *(?:\*\*)?Q\.? ?([0-9]+)", 1)
    s = _page_lines(spark, d).withColumn("num", F.when(num != "", num))
    s = s.withColumn("occ", F.row_number().over(Window.partitionBy("paper", "num").orderBy("page_id", "line_no")))
    first = F.col("num").isNotNull() & (F.col("occ") == 1)
    b = s.withColumn("block", F.sum(first.cast("long")).over(Window.partitionBy("paper").orderBy("page_id", "line_no")))
    return b.groupBy("paper", "block").agg(F.max(F.when(F.col("occ") == 1, F.col("num"))).alias("number"), F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query(f"""WITH {_LINES}, f AS (SELECT *, min(CASE WHEN regexp_matches(trim(line, ' '), '(?i)^(?:solution|ans\\.?|answer)\\b') AND line_no > 1 THEN line_no END) OVER (PARTITION BY doc_id) AS first FROM lines) SELECT doc_id, count(*) AS kept FROM f WHERE first IS NULL OR line_no < first GROUP BY doc_id""")
def truncate_at_heading(spark, d):
    hit = F.trim("line").rlike(r"(?i)^(?:solution|ans\.?|answer)\b") & (F.col("line_no") > 1)
    return S.cut_at_first(S.lines_of(table(spark, d, "documents"), "doc_id"), "doc_id", hit).groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))


@query()
def chunk_greedy(spark, d):
    return S.greedy_chunks(S.lines_of(table(spark, d, "documents"), "doc_id"), "doc_id")


@query()
def continued_pieces(spark, d):
    """Tutorial questions in pieces of at most 254 tokens, later ones marked as continued."""
    c = table(spark, d, "tutorial_chunks").groupBy("chunk_id").agg(F.max_by("description", "loaded_at").alias("text"))
    note = "(Q continued)"
    pieces = S.greedy_chunks(S.lines_of(c, "chunk_id"), "chunk_id", limit=254 - 5)
    return pieces.select("chunk_id", "chunk_no", F.when(F.col("chunk_no") > 1, F.concat(F.lit(note + " "), "text")).otherwise(F.col("text")).alias("text"))


@query(f"""WITH {_PAGES}, n AS (SELECT *, regexp_matches(line, '^    |[{{}};]$') AS code FROM plines WHERE trim(line, ' ') <> '') SELECT page_id, string_agg(CASE WHEN code THEN '[code]' ELSE trim(line, ' ') END, ' ' ORDER BY line_no) AS text FROM n GROUP BY page_id""")
def inline_descriptions(spark, d):
    """A page's lines in order as one text, code lines replaced by a description."""
    n = _page_lines(spark, d).filter(F.trim("line") != "")
    piece = F.when(F.col("line").rlike(r"^    |[{};]$"), "[code]").otherwise(F.trim("line"))
    return n.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", piece.alias("t")))), lambda x: x["t"]), " ").alias("text"))


@query("""WITH q AS (SELECT bank_id, arg_max(struct_pack(subject := subject, co := co, t := question), loaded_at) AS m FROM generated_questions WHERE question <> '' AND co IS NOT NULL GROUP BY bank_id), w AS (SELECT bank_id, m.subject AS subject, m.co AS co, m.t AS t, list_distinct(regexp_extract_all(lower(m.t), '[a-z]{4,}')) AS ws FROM q),
 s AS (SELECT * FROM w WHERE right(bank_id, 1) = '0' AND right(bank_id, 2) IN ('00','20','40')), p AS (SELECT s.bank_id, w.co, w.bank_id AS example, len(list_intersect(s.ws, w.ws)) AS shared FROM s JOIN w ON w.subject = s.subject AND w.bank_id <> s.bank_id AND w.t <> s.t),
 r AS (SELECT *, row_number() OVER (PARTITION BY bank_id, co ORDER BY shared DESC, example) AS k FROM p) SELECT bank_id, co, example, CAST(shared AS INT) AS shared FROM r WHERE k = 1""")
def examples_per_co(spark, d):
    """Per question of the stated set and outcome the example of its subject that shares most words; never itself or an equal text."""
    from coursewright.operators.retrieval import in_blocks, nearest

    q = table(spark, d, "generated_questions").filter("question <> '' and co is not null").groupBy("bank_id").agg(F.max_by(F.struct("subject", "co", F.col("question").alias("t")), "loaded_at").alias("m"))
    w = q.select("bank_id", "m.subject", "m.co", "m.t", F.array_distinct(F.regexp_extract_all(F.lower("m.t"), F.lit("[a-z]{4,}"), F.lit(0))).alias("ws"))
    s = w.filter(F.col("bank_id").rlike("[024]0$")).select("bank_id", "subject", F.col("t").alias("st"), F.col("ws").alias("sws"))
    rows = w.withColumnRenamed("bank_id", "example")
    p = in_blocks(s, rows, ["subject"], "example").filter("example <> bank_id and t <> st").withColumn("shared", F.size(F.array_intersect("sws", "ws"))).drop("ws", "sws", "t", "st")
    return nearest(p, "bank_id", 1, [F.desc("shared"), "example"], ["co"]).select("bank_id", "co", "example", "shared")


QUERIES, SQL = query.queries, query.sql
