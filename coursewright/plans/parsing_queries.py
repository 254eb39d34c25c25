"""Queries of the parsers, of tagging and of reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursewright.functions import parsing as P
from coursewright.functions.text import count_of, word_ngrams
from coursewright.plans import cases as K
from coursewright.plans.registry import Registry
from coursewright.session import apart, sized, table

query = Registry()


def _questions(spark, d):
    return table(spark, d, "pyq_questions").filter("metadata.type = 'question' and id is not null").groupBy("id").agg(F.max_by(F.struct("document", "metadata"), "loaded_at").alias("m")).select("id", "m.document", "m.metadata")


@query("""WITH q AS (SELECT id, arg_max(document, loaded_at) AS t FROM pyq_questions WHERE metadata.type = 'question' AND id IS NOT NULL GROUP BY id), g AS (SELECT id, coalesce(regexp_extract_all(t, '\\[([0-9][0-9.]*) Marks\\]', 1), []) AS m FROM q)
 SELECT id, CASE WHEN len(m) > 0 THEN list_sum(list_transform(m, lambda x: CAST(x AS DOUBLE))) END AS marks, CAST(len(m) AS INT) AS n_tags FROM g""")
def parse_marks_tags(spark, d):
    """Marks in the tags of each question. In these tables tags are square brackets with spelled-out marks."""
    t = _questions(spark, d).select("id", P.tags_udf("document").alias("tags"))
    with_marks = F.filter("tags", lambda x: x["marks"].isNotNull())
    return t.select("id", F.when(F.size(with_marks) > 0, F.aggregate(with_marks, F.lit(0.0), lambda a, x: a + x["marks"])).alias("marks"), F.size("tags").alias("n_tags"))


@query("""SELECT DISTINCT metadata.source AS paper, TRY_CAST(nullif(regexp_extract(document, '\\b(20[0-9][0-9])\\b', 1), '') AS INT) AS year, CASE WHEN regexp_matches(lower(regexp_replace(document, '[^A-Za-z0-9]', '', 'g')), 'endsem|endterm') THEN 'endsem' WHEN regexp_matches(lower(regexp_replace(document, '[^A-Za-z0-9]', '', 'g')), 'midsem|midterm') THEN 'midsem' WHEN regexp_matches(metadata.source, '(?i)(^|[^a-z0-9])t1([^a-z0-9]|$)') THEN 'test1' WHEN regexp_matches(metadata.source, '(?i)(^|[^a-z0-9])t2([^a-z0-9]|$)') THEN 'test2' ELSE 'unknown' END AS exam FROM pyq_questions WHERE metadata.type = 'header'""")
def detect_exam_year(spark, d):
    h = table(spark, d, "pyq_questions").filter("metadata.type = 'header'")
    return h.select(F.col("metadata.source").alias("paper"), P.year_udf("document").alias("year"), P.kind_udf("document", "metadata.source").alias("exam")).distinct()


@query("""WITH h AS (SELECT DISTINCT metadata.source AS paper, lower(document) AS low FROM pyq_questions WHERE metadata.type = 'header'), s AS (SELECT DISTINCT subject, lower(subject_name) AS name FROM topics), m AS (SELECT h.paper, s.subject, length(s.name) AS n FROM h JOIN s ON contains(h.low, s.name))
 SELECT paper, arg_max(subject, (n, subject)) AS subject FROM m GROUP BY paper""")
def detect_subject(spark, d):
    """The subject whose longest name stands in a header. Subjects are a fixed short list."""
    h = table(spark, d, "pyq_questions").filter("metadata.type = 'header'").select(F.col("metadata.source").alias("paper"), F.lower("document").alias("low")).distinct()
    s = table(spark, d, "topics").select("subject", F.lower("subject_name").alias("name")).distinct()
    return h.join(s, F.col("low").contains(F.col("name"))).groupBy("paper").agg(F.max_by("subject", F.struct(F.length("name"), "subject")).alias("subject"))


def _pages_and(spark, d, cases):
    pages = table(spark, d, "pyq_pages").select("page_id", "text").distinct()
    return pages.unionByName(K.frame(spark, cases, "page_id string, text string"))


@query(f"SELECT DISTINCT page_id, text AS redacted FROM pyq_pages UNION ALL {K.values(K.PERSONAL, (0, 2), 'page_id, redacted')}")
def redact_pii(spark, d):
    """Pages without lines of candidates' data. The pages of these tables hold none, so nothing of them may be lost; the written cases do."""
    return _pages_and(spark, d, K.PERSONAL).select("page_id", P.redact_udf("text").alias("redacted"))


@query(f"SELECT DISTINCT page_id, text AS cleaned FROM pyq_pages UNION ALL {K.values(K.CHATTER, (0, 2), 'page_id, cleaned')}")
def strip_chatter(spark, d):
    """Pages without what a model added; the same holds of pages and cases."""
    return _pages_and(spark, d, K.CHATTER).select("page_id", P.chatter_udf("text").alias("cleaned"))


@query(f"SELECT DISTINCT page_id, text AS cleaned FROM pyq_pages UNION ALL {K.values(K.HEADINGS, (0, 2), 'page_id, cleaned')}")
def repeated_headings(spark, d):
    return _pages_and(spark, d, K.HEADINGS).select("page_id", P.headings_udf("text").alias("cleaned"))


@query()
def tidy_markdown(spark, d):
    return _questions(spark, d).select("id", P.clean_question_udf("document").alias("cleaned"))


@query(K.values(K.CALCULATIONS, (0, 2, 3, 4, 5), "doc_id, left_side, stated, value, ok"))
def check_arithmetic(spark, d):
    """Written calculations in documents (these tables hold none) and in the written cases, with whether they are right."""
    texts = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text").unionByName(K.frame(spark, K.CALCULATIONS, "doc_id string, text string"))
    c = texts.filter(F.col("text").contains("=")).select("doc_id", F.explode(P.calculations_udf("text")).alias("c"))
    return c.select("doc_id", F.col("c.left").alias("left_side"), "c.stated", F.round("c.value", 6).alias("value"), "c.ok")


@query("""WITH one AS (SELECT paper_id, arg_max(body, loaded_at) AS body FROM paper_files GROUP BY paper_id), j AS (SELECT paper_id, CASE WHEN json_valid(body) THEN body::JSON END AS j FROM one) SELECT paper_id, j IS NOT NULL AS parsed, CAST(json_array_length(j, '$.slots') AS INT) AS n_slots FROM j""")
def parse_json_reply(spark, d):
    """Bodies as replies: fences and reasoning taken off, then parsed."""
    one = table(spark, d, "paper_files").groupBy("paper_id").agg(F.max_by("body", "loaded_at").alias("body"))
    stripped = F.regexp_replace("body", r"(?s)<think>.*?</think>|^[^{]*|[^}]*$", "")
    j = one.select("paper_id", F.try_parse_json(stripped).alias("j"))
    return j.select("paper_id", F.col("j").isNotNull().alias("parsed"), F.size(F.expr("try_variant_get(j, '$.slots', 'array<variant>')")).alias("n_slots"))


_keep_udf = F.udf(lambda found: [int(found[i]) for i in P.numbering([int(x) for x in found])], T.ArrayType(T.IntegerType()), useArrow=True)


@query()
def choose_question_markers(spark, d):
    """Per paper the question numbers that make the best numbering; a page sent again counts as its latest."""
    p = table(spark, d, "pyq_pages").filter("page_id is not null").groupBy("page_id").agg(F.max(F.struct("extracted_at", "text", "paper", "page_num")).alias("m")).select("page_id", "m.paper", "m.text")
    n = p.select("paper", "page_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?m)^Q\.? ?([0-9]{1,3})\b"), F.lit(1)).alias("n"))
    listed = n.groupBy("paper").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("page_id", "n"))), lambda x: x["n"])).alias("found"))
    return listed.select("paper", F.size("found").alias("n_found"), _keep_udf("found").alias("kept"))


@query(K.values(K.NUMBERINGS, (0, 2), "case_id, kept"))
def best_numbering(spark, d):
    """The choice of markers on written cases: strays, jumps ahead, new starts."""
    c = K.frame(spark, K.NUMBERINGS, "case_id string, found string")
    return c.select("case_id", F.array_join(_keep_udf(F.split("found", " ")).cast("array<string>"), " ").alias("kept"))


_ratio_udf = F.udf(lambda a, b: P.alikeness(a, b), T.DoubleType(), useArrow=True)


@query()
def fuzzy_code_match(spark, d):
    """Each printed outcome description with the known one of its subject that is most alike, at 0.55 or more; of equals the first."""
    known = table(spark, d, "course_outcomes").select("subject", "co_id", "description")
    texts = table(spark, d, "pyq_questions").select(F.col("metadata.subject").alias("subject"), F.col("metadata.co_description").alias("text")).filter("text is not null").distinct()
    rated = texts.join(sized(known), "subject").withColumn("ratio", _ratio_udf("text", "description"))
    best = rated.filter("ratio >= 0.55").groupBy("subject", "text").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "co_id")).alias("m"))
    return texts.join(best, ["subject", "text"], "left").select("subject", "text", "m.co_id", F.round(-F.col("m.r"), 4).alias("ratio"))


@query(f"""WITH h AS (SELECT DISTINCT metadata.source AS paper, document AS text FROM pyq_questions WHERE metadata.type = 'header' UNION ALL {K.values(K.OUTCOME_ROWS, (0, 1), "paper, text")}), l AS (SELECT paper, unnest(string_split(text, chr(10))) AS line FROM h),
 c AS (SELECT paper, list_transform(string_split_regex(regexp_replace(line, '^\\s*\\||\\|\\s*$|\\\\\\\\\\s*$', '', 'g'), '[|&]'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS cells FROM l WHERE regexp_matches(line, '[|&]'))
 SELECT paper, cells[1] AS code, cells[2] AS description FROM c WHERE regexp_matches(cells[1], '^C[A-Z]{{0,2}}[ .-]?[0-9]+([.][0-9]+)?$') AND length(cells[2]) >= 15""")
def outcome_rows(spark, d):
    """Code and description of the rows of the outcome tables that headers print, with cells parted by bars or ampersands, of papers and of the written cases."""
    h = table(spark, d, "pyq_questions").filter("metadata.type = 'header'").select(F.col("metadata.source").alias("paper"), F.col("document").alias("text")).distinct()
    lines = h.unionByName(K.frame(spark, K.OUTCOME_ROWS, "paper string, text string")).select("paper", F.explode(F.split("text", "\n")).alias("line"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\s*\||\|\s*$|\\\\\s*$", ""), r"[|&]"), lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")))
    rows = lines.filter(F.col("line").rlike("[|&]")).select("paper", F.get(cells, F.lit(0)).alias("code"), F.get(cells, F.lit(1)).alias("description"))
    return rows.filter(F.col("code").rlike(r"^C[A-Z]{0,2}[ .-]?[0-9]+([.][0-9]+)?$") & (F.length("description") >= 15))


_KW = {"OSK": ["thread", "process", "page"], "NET": ["packet", "router", "socket"], "RDB": ["relation", "schema", "tuple"], "CMP": ["token", "parser", "grammar"]}


@query("""WITH k AS (SELECT doc_id, source, n_chars, subject, topic_id, """ + ", ".join("(" + " + ".join(f"(length(low) - length(replace(low, '{k}', ''))) / {len(k)}" for k in ks) + f") AS s_{s}" for s, ks in _KW.items()) + """ FROM (SELECT *, lower(coalesce(text, '')) AS low FROM documents)), r AS (SELECT *, list_sort([(-s_OSK, 0, 'OSK'), (-s_NET, 1, 'NET'), (-s_RDB, 2, 'RDB'), (-s_CMP, 3, 'CMP')]) AS o FROM k)
 SELECT doc_id, CASE WHEN n_chars > 4000 THEN 'suspect-range' WHEN topic_id IS NOT NULL THEN 'chapter-rule' WHEN source IS NULL THEN 'unlisted' WHEN o[2][1] - o[1][1] >= 2 THEN 'keyword-split' ELSE 'keyword-lowconf' END AS method, CASE WHEN n_chars > 4000 THEN 'NONE' WHEN topic_id IS NOT NULL THEN coalesce(subject, 'NONE') WHEN source IS NULL THEN 'NONE' WHEN o[2][1] - o[1][1] >= 2 THEN o[1][3] ELSE 'OSK' END AS subject FROM r""")
def tag_chunks(spark, d):
    """A cascade of rules: range guard, given topic, no source, keyword counts with a margin of two, else low confidence."""
    def score(ks):
        return count_of(F.col("text"), ks[0]) + count_of(F.col("text"), ks[1]) + count_of(F.col("text"), ks[2])

    ranked = F.array_sort(F.array(*[F.struct((-score(ks)).alias("s"), F.lit(i).alias("i"), F.lit(s).alias("t")) for i, (s, ks) in enumerate(_KW.items())]))
    t = table(spark, d, "documents").withColumn("o", ranked)
    clear = F.col("o")[1]["s"] - F.col("o")[0]["s"] >= 2
    method = F.when(F.col("n_chars") > 4000, "suspect-range").when(F.col("topic_id").isNotNull(), "chapter-rule").when(F.col("source").isNull(), "unlisted").when(clear, "keyword-split").otherwise("keyword-lowconf")
    subject = F.when(F.col("n_chars") > 4000, "NONE").when(F.col("topic_id").isNotNull(), F.coalesce("subject", F.lit("NONE"))).when(F.col("source").isNull(), "NONE").when(clear, F.col("o")[0]["t"]).otherwise("OSK")
    return t.select("doc_id", method.alias("method"), subject.alias("subject"))


@query("""WITH a AS (SELECT DISTINCT topic_id, unnest(regexp_extract_all(lower(topic_name), '[a-z]{4,}')) AS w FROM topics), t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(section_title), '[a-z0-9]+'))) AS w FROM documents WHERE section_title IS NOT NULL) SELECT doc_id, topic_id, count(*) AS n FROM t JOIN a USING (w) GROUP BY ALL""")
def alias_topics(spark, d):
    """Topics whose name shares a word of four letters or more with a document's title."""
    a = table(spark, d, "topics").select("topic_id", F.explode(F.regexp_extract_all(F.lower("topic_name"), F.lit("[a-z]{4,}"), F.lit(0))).alias("w")).distinct()
    t = table(spark, d, "documents").filter("section_title is not null").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("section_title"), F.lit("[a-z0-9]+"), F.lit(0)))).alias("w"))
    return t.join(a, "w").groupBy("doc_id", "topic_id").agg(F.count(F.lit(1)).alias("n"))


_OUTLINE = "WITH q AS (SELECT bank_id, arg_max(answer_outline, loaded_at) AS o, arg_max(status, loaded_at) AS status, arg_max(source, loaded_at) AS source FROM generated_questions GROUP BY bank_id), c AS (SELECT bank_id, source, unnest(range(1, 1 + len(o))) AS claim_no, unnest(o) AS claim FROM q), s AS (SELECT *, CASE WHEN claim IS NULL THEN 'no basis' WHEN NOT regexp_matches(claim, '[0-9]') THEN 'model knowledge' WHEN source = 'bank' THEN 'grounded' ELSE 'unconfirmed' END AS status FROM c)"


def _claims(spark, d):
    q = table(spark, d, "generated_questions").groupBy("bank_id").agg(F.max_by(F.struct("answer_outline", "source"), "loaded_at").alias("m"))
    c = q.select("bank_id", "m.source", F.posexplode("m.answer_outline").alias("p", "claim"))
    status = F.when(F.col("claim").isNull(), "no basis").when(~F.col("claim").rlike("[0-9]"), "model knowledge").when(F.col("source") == "bank", "grounded").otherwise("unconfirmed")
    return c.select("bank_id", (F.col("p") + 1).cast("long").alias("claim_no"), status.alias("status"))


@query(f"{_OUTLINE} SELECT bank_id, claim_no, status FROM s")
def claim_status(spark, d):
    return _claims(spark, d)


@query(f"{_OUTLINE} SELECT bank_id, count(*) AS n_claims, count(*) FILTER (status = 'grounded') AS grounded, bool_or(status = 'grounded') AS anchored FROM s GROUP BY bank_id")
def claim_status_counts(spark, d):
    return _claims(spark, d).groupBy("bank_id").agg(F.count(F.lit(1)).alias("n_claims"), F.count_if(F.col("status") == "grounded").alias("grounded"), F.bool_or(F.col("status") == "grounded").alias("anchored"))


@query("SELECT doc_id, coalesce(n_chars > 4000, false) AS suspect FROM documents")
def suspect_page_range(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.col("n_chars") > 4000, F.lit(False)).alias("suspect"))


_W = "regexp_extract_all(lower(coalesce(t, '')), '[a-z0-9]+')"


def _grams_sql(n: int) -> str:
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"CASE WHEN len(w) >= {n} THEN list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: {gram})) ELSE []::VARCHAR[] END"


def _overlap_sql(n: int, least: str, which: str) -> str:
    return f"""WITH a AS (SELECT id AS rec, metadata.subject AS subject, arg_max(document, loaded_at) AS t FROM pyq_questions WHERE metadata.type = 'question' AND id IS NOT NULL GROUP BY ALL UNION ALL SELECT bank_id, arg_max(subject, loaded_at), arg_max(question, loaded_at) FROM generated_questions GROUP BY bank_id), b AS (SELECT bank_id AS rec, arg_max(subject, loaded_at) AS subject, arg_max(question, loaded_at) AS t FROM generated_questions WHERE {which} GROUP BY bank_id),
 ga AS (SELECT rec, subject, {_grams_sql(n)} AS g FROM (SELECT rec, subject, {_W} AS w FROM a)), gb AS (SELECT rec, subject, {_grams_sql(n)} AS g FROM (SELECT rec, subject, {_W} AS w FROM b)), j AS (SELECT gb.rec AS bank_id, ga.rec AS id, len(list_intersect(gb.g, ga.g)) AS s, len(gb.g) AS n FROM gb JOIN ga USING (subject) WHERE len(gb.g) > 0 AND gb.rec <> ga.rec)
 SELECT bank_id, id, round(s / CAST(n AS DOUBLE), 6) AS overlap FROM j WHERE s / CAST(n AS DOUBLE) >= {least}"""


def _overlap(a, b, n: int, least: float):
    """Rows of ``a`` (``id, subject, text``) that hold at least ``least`` of the shingles of a row of ``b`` (``bank_id, subject, text``).

    Of each row of ``b`` only the rarest shingles are looked up, as many as make
    one of them sure to be shared; common wordings so seldom meet one another.
    """
    a = a.select("id", "subject", word_ngrams(F.col("text"), n).alias("g"))
    b = b.select("bank_id", "subject", word_ngrams(F.col("text"), n).alias("g")).filter(F.size("g") > 0)
    ea = a.select("id", "subject", F.explode("g").alias("t"))
    eb = b.select("bank_id", "subject", F.size("g").alias("n"), F.explode("g").alias("t"))
    df = ea.groupBy("subject", "t").agg(F.count(F.lit(1)).alias("df"))
    known = eb.join(apart(df), ["subject", "t"], "left").withColumn("r", F.row_number().over(Window.partitionBy("bank_id").orderBy(F.coalesce("df", F.lit(0)), "t")))
    prefix = known.filter((F.col("r") <= F.col("n") - F.ceil(F.col("n") * least) + 1) & F.col("df").isNotNull())
    cand = prefix.join(apart(ea), ["subject", "t"]).filter("bank_id <> id").select("bank_id", "id").distinct()
    shared = F.size(F.array_intersect("gb", "ga")) / F.size("gb")
    j = cand.join(apart(b.select("bank_id", F.col("g").alias("gb"))), "bank_id").join(apart(a.select("id", F.col("g").alias("ga"))), "id")
    return j.filter(shared >= least).select("bank_id", "id", F.round(shared, 6).alias("overlap"))


def _past(spark, d):
    """Past questions and those of the bank itself."""
    past = _questions(spark, d).select("id", F.col("metadata.subject").alias("subject"), F.col("document").alias("text"))
    return past.unionByName(_bank(spark, d).withColumnRenamed("bank_id", "id"))


def _bank(spark, d, which="true"):
    b = table(spark, d, "generated_questions").filter(which).groupBy("bank_id").agg(F.max_by(F.struct("subject", F.col("question").alias("text")), "loaded_at").alias("m"))
    return b.select("bank_id", "m.subject", "m.text")


@query(_overlap_sql(5, "0.8", "true"))
def shingle_overlap(spark, d):
    """Past and bank questions that hold at least 0.8 of another bank question's five-word shingles."""
    return _overlap(_past(spark, d), _bank(spark, d), 5, 0.8)


@query(_overlap_sql(3, "0.5", "regexp_matches(bank_id, '[024]0$')"))
def trigram_overlap(spark, d):
    """The same by word trigrams and one half, for the bank questions whose number is divisible by 20 against all past and bank questions."""
    return _overlap(_past(spark, d), _bank(spark, d, "bank_id rlike '[024]0$'"), 3, 0.5)


QUERIES, SQL = query.queries, query.sql
