"""Queries of the text functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from coursewright.functions import text as X
from coursewright.plans.registry import Registry
from coursewright.session import cut, table

query = Registry()


def _regex_alternatives(s: str) -> str:
    return s.replace("'", "''")


@query("SELECT doc_id, CAST(ceil(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[0-9]+|[^\\sA-Za-z0-9]')) * CAST(1.2 AS DOUBLE)) AS INT) AS est_tokens FROM documents")
def estimate_tokens(spark, d):
    # blanks as RE2 and Java read them: the six ASCII ones
    return table(spark, d, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("est_tokens"))


@query("""WITH q AS (SELECT bank_id, max_by(question, loaded_at) AS question FROM generated_questions GROUP BY bank_id),
  w AS (SELECT bank_id, regexp_extract_all(lower(coalesce(question, '')), '[a-z0-9]+') AS w FROM q),
  g AS (SELECT bank_id, len(w) AS n_words, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE ['<none>'] END) AS t FROM w)
  SELECT bank_id, CAST(n_words AS INT) AS n_words, CAST(count(DISTINCT t) FILTER (t <> '<none>') AS INT) AS n_trigrams FROM g GROUP BY bank_id, n_words""")
def word_trigrams(spark, d):
    q = table(spark, d, "generated_questions").groupBy("bank_id").agg(F.max_by("question", "loaded_at").alias("question"))
    return q.select("bank_id", F.size(X.words(F.col("question"))).alias("n_words"), F.size(X.word_ngrams(F.col("question"))).alias("n_trigrams"))


_LIGATURES_SQL = "text"
for _a, _b in X.LIGATURES.items():
    _LIGATURES_SQL = f"replace({_LIGATURES_SQL}, '{_a}', '{_b}')"


@query(f"SELECT doc_id, regexp_replace({_LIGATURES_SQL}, '[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x{{9f}}]', '', 'g') AS cleaned FROM documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.clean_text(F.col("text")).alias("cleaned"))


@query("""SELECT DISTINCT metadata.raw_co_code AS raw_code, regexp_replace(upper(regexp_replace(metadata.raw_co_code, '[\\s\\-]+', '', 'g')), '^C0([0-9])$', 'CO\\1') AS code
  FROM pyq_questions WHERE metadata.raw_co_code IS NOT NULL""")
def normalize_code(spark, d):
    code = F.col("metadata.raw_co_code")
    return table(spark, d, "pyq_questions").filter(code.isNotNull()).select(code.alias("raw_code"), X.normalize_code(code).alias("code")).distinct()


_LEVEL_CASE = "CASE " + " ".join(f"WHEN lower(b) LIKE '%{s}%' THEN '{v}'" for s, v in zip(X.LEVEL_STEMS, X.LEVELS, strict=True))
_LEVEL_NUMBERS = " ".join(f"WHEN regexp_extract(upper(b), '\\bL\\s*([1-6])\\b', 1) = '{i + 1}' THEN '{v}'" for i, v in enumerate(X.LEVELS))
_LEVEL_RANK = "CAST(nullif(list_position(['" + "','".join(X.LEVELS) + "'], x), 0) AS INT)"


@query(f"""WITH b AS (SELECT DISTINCT metadata.bloom_level AS b FROM pyq_questions WHERE metadata.bloom_level IS NOT NULL),
  n AS (SELECT b AS typed, {_LEVEL_CASE} END AS by_stem, {_LEVEL_CASE} {_LEVEL_NUMBERS} END AS x FROM b)
  SELECT typed, by_stem, x AS by_stem_or_number, {_LEVEL_RANK} AS bloom_rank FROM n""")
def normalize_bloom(spark, d):
    b = table(spark, d, "pyq_questions").select(F.col("metadata.bloom_level").alias("typed")).filter("typed is not null").distinct()
    n = b.withColumn("by_stem", X.normalize_level(F.col("typed"))).withColumn("by_stem_or_number", X.normalize_level(F.col("typed"), True))
    return n.withColumn("bloom_rank", X.level_rank(F.col("by_stem_or_number")))


_VERB_CASE = "CASE " + " ".join(f"WHEN regexp_matches(low, '\\b(?:{_regex_alternatives(v)})') THEN '{k}'" for k, v in X.LEVEL_VERBS) + " ELSE 'Apply' END"


@query(f"WITH q AS (SELECT bank_id, max_by(question, loaded_at) AS t FROM generated_questions GROUP BY bank_id), l AS (SELECT bank_id, lower(coalesce(t, '')) AS low FROM q) SELECT bank_id, {_VERB_CASE} AS bloom_read FROM l")
def bloom_keyword_rule(spark, d):
    q = table(spark, d, "generated_questions").groupBy("bank_id").agg(F.max_by("question", "loaded_at").alias("t"))
    return q.select("bank_id", X.verb_level(F.col("t")).alias("bloom_read"))


_STOP_SQL = "['" + "','".join(X.STOP_WORDS) + "']"
_STEMS_SQL = f"list_distinct(list_transform(list_filter(list_distinct(regexp_extract_all(lower(coalesce(t, '')), '[a-z]{{4,}}')), lambda w: NOT list_contains({_STOP_SQL}, w)), lambda w: CASE WHEN w IN ('ions') THEN w ELSE regexp_replace(w, '(?:ing|ion|ions|ed|es|s)$', '') END))"


@query(f"""SELECT doc_id, CAST(len(s) AS INT) AS n_stems, array_to_string(list_sort(s), ' ') AS stems FROM (SELECT doc_id, {_STEMS_SQL} AS s FROM (SELECT doc_id, text AS t FROM documents))""")
def content_stems(spark, d):
    s = table(spark, d, "documents").select("doc_id", X.content_stems(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n_stems"), F.array_join(F.array_sort("s"), " ").alias("stems"))


@query(f"""WITH q AS (SELECT bank_id, max_by(question, loaded_at) AS t, max_by(subject, loaded_at) AS subject FROM generated_questions GROUP BY bank_id),
  s AS (SELECT bank_id, subject, {_STEMS_SQL} AS stems, {_VERB_CASE.replace("low,", "lower(coalesce(t, '')),")} AS level FROM q),
  c AS (SELECT co_id, subject, co_level, {_STEMS_SQL} AS co_stems FROM (SELECT co_id, subject, co_level, description AS t FROM course_outcomes)),
  r AS (SELECT bank_id, co_id, len(list_intersect(stems, co_stems)) + CASE WHEN co_level = level THEN 1.5 ELSE 0 END AS score FROM s JOIN c USING (subject))
  SELECT bank_id, arg_min(co_id, (-score, co_id)) AS co_id, CAST(max(score) AS DOUBLE) AS score FROM r GROUP BY bank_id""")
def keyword_co(spark, d):
    """The outcome that shares most content words with a question, a matching level counting 1.5; ties go to the first outcome."""
    q = table(spark, d, "generated_questions").groupBy("bank_id").agg(F.max_by(F.struct(F.col("question").alias("t"), "subject"), "loaded_at").alias("m"))
    q = q.select("bank_id", "m.subject", X.content_stems(F.col("m.t")).alias("stems"), X.verb_level(F.col("m.t")).alias("level"))
    c = table(spark, d, "course_outcomes").select("co_id", "subject", "co_level", X.content_stems(F.col("description")).alias("co_stems"))
    score = F.size(F.array_intersect("stems", "co_stems")) + F.when(F.col("co_level") == F.col("level"), 1.5).otherwise(0.0)
    r = q.join(c, "subject").select("bank_id", F.struct((-score).alias("s"), "co_id").alias("k"))
    return r.groupBy("bank_id").agg(F.min("k").alias("k")).select("bank_id", "k.co_id", (-F.col("k.s")).alias("score"))


_KEYWORDS = {"locks": ["lock", "mutex", "monitor"], "graphs": ["graph", "edge", "vertex", "path"], "memory": ["page", "frame", "cache"], "parsing": ["token", "parse", "grammar"]}


@query("SELECT doc_id, " + ", ".join("CAST(" + " + ".join(f"(length(low) - length(replace(low, '{k}', ''))) / {len(k)}" for k in ks) + f" AS INT) AS {t}" for t, ks in _KEYWORDS.items()) + " FROM (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents)")
def keyword_scores(spark, d):
    def total(ks):
        out = X.count_of(F.col("text"), ks[0])
        for k in ks[1:]:
            out = out + X.count_of(F.col("text"), k)
        return out

    return table(spark, d, "documents").select("doc_id", *[total(ks).alias(t) for t, ks in _KEYWORDS.items()])


@query("""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\r\\n\\f]+', ' ', 'g'), ' ') AS text FROM documents)
  SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE (CASE WHEN regexp_extract(left(text, 120), '(?s)^(.*)\\s', 1) <> '' THEN regexp_extract(left(text, 120), '(?s)^(.*)\\s', 1) ELSE left(text, 120) END) || ' ...' END AS short FROM t""")
def truncate_words(spark, d):
    return table(spark, d, "documents").select("doc_id", X.truncate_words(F.col("text"), 120).alias("short"))


@query("""WITH e AS (SELECT DISTINCT id, regexp_extract(document, '[\\[(]([0-9][0-9.+ =]*)\\s*(?:Marks|M)[\\])]', 1) AS expr FROM pyq_questions WHERE metadata.type = 'question'),
  n AS (SELECT id, expr, list_transform(regexp_extract_all(string_split(expr, '=')[-1], '[0-9]+(?:\\.[0-9]+)?'), lambda x: CAST(x AS DOUBLE)) AS ns FROM e)
  SELECT id, expr, CASE WHEN len(ns) > 0 THEN list_sum(ns) END AS total FROM n""")
def marks_expression(spark, d):
    q = table(spark, d, "pyq_questions").filter("metadata.type = 'question'")
    e = q.select("id", F.regexp_extract(F.coalesce("document", F.lit("")), r"[\[(]([0-9][0-9.+ =]*)\s*(?:Marks|M)[\])]", 1).alias("expr")).distinct()
    return e.select("id", "expr", X.marks_total(F.col("expr")).alias("total"))


@query("""SELECT bank_id, length(regexp_replace(coalesce(question, ''), '^\\s*[*]*(?i:question|ques|que|q)\\s*[.]?\\s*[0-9]+\\s*[*]*\\s*[:.)\\-]*\\s*[*]*\\s*', '')) AS n_chars FROM generated_questions""")
def strip_question_number(spark, d):
    return table(spark, d, "generated_questions").select("bank_id", F.length(X.strip_number(F.coalesce("question", F.lit("")))).cast("long").alias("n_chars"))


_REFUSED = " OR ".join(f"starts_with(s, '{w}')" for w in X.REFUSALS)


@query(f"""SELECT page_id, ({_REFUSED}) OR n < 30 AS is_junk FROM (SELECT page_id, trim(regexp_replace(lower(left(ltrim(coalesce(text, ''), ' '), 40)), '[^a-z0-9]+', ' ', 'g'), ' ') AS s, length(trim(coalesce(text, ''), ' ')) AS n FROM pyq_pages)""")
def junk_page_filter(spark, d):
    return table(spark, d, "pyq_pages").select("page_id", X.is_junk_page(F.col("text")).alias("is_junk"))


@query("""SELECT DISTINCT raw, CASE WHEN n <> '' THEN CAST(n AS INT) END AS whole FROM (SELECT metadata.raw_co_code AS raw, regexp_extract(lower(metadata.raw_co_code), '^\\s*([0-9]+)(?:\\.0+)?\\s*(?:marks?|m)?\\s*$', 1) AS n FROM pyq_questions WHERE metadata.raw_co_code IS NOT NULL
  UNION ALL SELECT metadata.bloom_level, regexp_extract(lower(metadata.bloom_level), '^\\s*([0-9]+)(?:\\.0+)?\\s*(?:marks?|m)?\\s*$', 1) FROM pyq_questions WHERE metadata.bloom_level IS NOT NULL)""")
def coerce_whole_number(spark, d):
    t = table(spark, d, "pyq_questions")
    raw = t.select(F.col("metadata.raw_co_code").alias("raw")).unionAll(t.select("metadata.bloom_level")).filter("raw is not null").distinct()
    return raw.select("raw", X.whole_number(F.col("raw")).alias("whole"))


@query("""SELECT doc_id, sha1(coalesce(text, '') || '␟' || coalesce(lang, '') || '␟' || coalesce(source, '')) AS cache_key FROM documents""")
def content_hash_key(spark, d):
    return table(spark, d, "documents").select("doc_id", X.cache_key(F.col("text"), F.col("lang"), F.col("source")).alias("cache_key"))


@query("""SELECT page_id, CASE WHEN length(trim(coalesce(text, ''), ' ')) >= 400 AND coalesce(extraction_method, '') <> 'ocr' THEN 'text_layer' ELSE 'vision' END AS route FROM pyq_pages""")
def route_text_or_vision(spark, d):
    enough = F.length(F.trim(F.coalesce("text", F.lit("")))) >= 400
    return table(spark, d, "pyq_pages").select("page_id", F.when(enough & (F.coalesce("extraction_method", F.lit("")) != "ocr"), "text_layer").otherwise("vision").alias("route"))


@query("""SELECT id, document FROM (SELECT DISTINCT id, document FROM pyq_questions WHERE metadata.type = 'question') WHERE length(trim(coalesce(document, ''), ' ')) >= 150""")
def scan_filter_short_docs(spark, d):
    q = table(spark, d, "pyq_questions").filter("metadata.type = 'question'").select("id", "document").distinct()
    return q.filter(F.length(F.trim(F.coalesce("document", F.lit("")))) >= 150)


@query("""WITH q AS (SELECT bank_id, max_by(question, loaded_at) AS t FROM generated_questions GROUP BY bank_id)
  SELECT bank_id, regexp_matches(coalesce(t, ''), '(?i)\\b(?:TODO|TBD|lorem|placeholder)\\b|_{3,}') AS has_placeholder, coalesce(contains(t, ' either '), false) OR coalesce(regexp_matches(t, '\\bor\\b'), false) AS has_alternative,
    CAST(len(regexp_extract_all(coalesce(t, ''), '\\[S[0-9]+\\]')) AS INT) AS n_citations FROM q""")
def outline_flags(spark, d):
    q = table(spark, d, "generated_questions").groupBy("bank_id").agg(F.max_by("question", "loaded_at").alias("t"))
    t = F.coalesce("t", F.lit(""))
    return q.select(
        "bank_id", t.rlike(r"(?i)\b(?:TODO|TBD|lorem|placeholder)\b|_{3,}").alias("has_placeholder"), (t.contains(" either ") | t.rlike(r"\bor\b")).alias("has_alternative"),
        F.size(F.regexp_extract_all(t, F.lit(r"\[S[0-9]+\]"), F.lit(0))).alias("n_citations"),
    )


def _quoted_elsewhere(q):
    """``bank_id`` of the rows (``bank_id, topic, question, quote``) whose quote stands in another one's question of the topic.

    Equal quotes of a topic are looked up once, by the rarest three words inside
    a piece (its outer words may be parts of words); quotes too short for that are
    compared with the whole topic.
    """
    bare = F.regexp_replace(F.coalesce("question", F.lit("")), r"(?m)^[ \t]*[0-9]{1,2}[ \t]*$", "")
    src = q.select(F.col("bank_id").alias("other"), "topic", F.col("question").alias("text"), F.array_distinct(F.array(X.normalized(F.coalesce("question", F.lit(""))), X.normalized(bare))).alias("norms"))
    threes = lambda w, lo, hi: F.when(hi >= lo, F.transform(F.sequence(lo, hi), lambda i: F.array_join(F.slice(w, i, 3), " "))).otherwise(F.array().cast("array<string>"))
    of_text = lambda t: threes(F.split(t, " "), F.lit(1), F.size(F.split(t, " ")) - 2)
    inside = lambda t: threes(F.split(t, " "), F.lit(2), F.size(F.split(t, " ")) - 3)
    stands = cut(src.select("topic", "other", F.explode(F.array_distinct(F.flatten(F.transform("norms", of_text)))).alias("key")))
    quotes = q.select("topic", "quote").distinct().withColumn("pieces", X.quote_pieces(F.col("quote"))).filter("size(split(array_join(pieces, ' '), ' ')) > 1")
    quotes = cut(quotes.withColumn("keys", F.flatten(F.transform("pieces", inside))))
    sizes = stands.groupBy("topic", "key").agg(F.count(F.lit(1)).alias("n"))
    rarest = quotes.select("topic", "quote", F.explode("keys").alias("key")).join(sizes, ["topic", "key"]).groupBy("topic", "quote").agg(F.min(F.struct("n", "key"))["key"].alias("key"))
    long = rarest.join(stands, ["topic", "key"]).join(src.select("topic", "other", "text"), ["topic", "other"]).select("topic", "quote", "other", "text")
    short = quotes.filter("size(keys) = 0").join(src, "topic").filter(F.exists("norms", lambda t: t.contains(F.col("pieces")[0]))).select("topic", "quote", "other", "text")
    found = long.unionByName(short).filter(X.quote_in_source(F.col("quote"), F.col("text")))
    ends = found.groupBy("topic", "quote").agg(F.min("other").alias("least"), F.max("other").alias("most"))
    return q.join(ends, ["topic", "quote"]).filter((F.col("least") != F.col("bank_id")) | (F.col("most") != F.col("bank_id"))).select("bank_id")


@query()
def quote_in_source(spark, d):
    """Of every question, whether its first sentence stands in its own text and in another question of its topic."""
    q = table(spark, d, "generated_questions").groupBy("bank_id").agg(F.max_by(F.struct("topic_id", "question"), "loaded_at").alias("m")).select("bank_id", F.coalesce("m.topic_id", F.lit("")).alias("topic"), "m.question")
    q = cut(q.withColumn("quote", F.regexp_extract(F.coalesce("question", F.lit("")), r"^[^.?!]*[.?!]", 0)))
    other = _quoted_elsewhere(q).withColumn("in_other", F.lit(True))
    return q.join(other, "bank_id", "left").select("bank_id", X.quote_in_source(F.col("quote"), F.col("question")).alias("in_own"), F.coalesce("in_other", F.lit(False)).alias("in_other"))


QUERIES, SQL = query.queries, query.sql
