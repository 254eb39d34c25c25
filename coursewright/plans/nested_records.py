"""Queries over the nested tables: outcomes of tutorial chunks, slots and parts of papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursewright.operators import nested
from coursewright.session import table

SLOT, PART, SUBPART = "$.slots[]", "$.slots[].parts[]", "$.slots[].parts[].parts[]"
LOOSE = ("$.slots", "$.slots[].parts", "$.slots[].parts[].parts")


def outcome_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.dewey_nodes(nested.wrap_column(table(spark, sf_dir, "tutorial_chunks"), "chunk_id", "co_details", "loaded_at"), tables=["$[]"])


def paper_nodes(spark: SparkSession, sf_dir: str, *tables: str) -> DataFrame:
    docs = nested.parse_documents(table(spark, sf_dir, "paper_files"), "paper_id", "body", "loaded_at")
    return nested.dewey_nodes(docs, as_arrays=LOOSE, tables=tables)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each outcome of a chunk and each part of a slot, with the places that lead to it."""
    place = lambda i: F.coalesce(F.get("dewey", F.lit(i)), F.lit(0))
    outcomes = nested.flat_table(outcome_nodes(spark, sf_dir), "$[]", {"id": "string"}).select(
        F.lit("co_detail").alias("kind"), "root_id", place(0).alias("pos1"), F.lit(0).alias("pos2"), F.lit(0).alias("pos3"), F.coalesce("id", F.lit("")).alias("label")
    )
    nodes = paper_nodes(spark, sf_dir, SUBPART)
    is_part = F.col("path").isin(PART, SUBPART) & F.expr("value is not null and not is_variant_null(value)")
    parts = nodes.filter(is_part).select(
        F.lit("slot_part").alias("kind"), "root_id", place(1).alias("pos1"), place(3).alias("pos2"), place(5).alias("pos3"),
        F.coalesce(F.expr("try_variant_get(value, '$.label', 'string')"), F.lit("")).alias("label"),
    )
    return outcomes.unionByName(parts)


def p5_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per chunk, the root table of the outcomes."""
    t = table(spark, sf_dir, "tutorial_chunks").filter("chunk_id is not null")
    one = t.groupBy("chunk_id").agg(F.max_by(F.struct("description", "topic_ids"), F.struct("loaded_at", "description")).alias("m"))
    return one.select("chunk_id", "m.description", F.size(F.coalesce("m.topic_ids", F.array().cast("array<string>"))).alias("n_topics"))


def p5_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {f: "string" for f in ("id", "subject", "text", "source", "via", "label")}
    return nested.flat_table(outcome_nodes(spark, sf_dir), "$[]", fields).select(F.col("root_id").alias("chunk_id"), "position", *fields)


def p5_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = nested.parse_documents(table(spark, sf_dir, "paper_files"), "paper_id", "body", "loaded_at")
    get = lambda p, t: F.expr(f"try_variant_get(doc, '{p}', '{t}')")
    return docs.select(
        F.col("root_id").alias("paper_id"), F.col("doc").isNotNull().alias("is_valid"), get("$.blueprint.subject", "string").alias("subject"),
        get("$.blueprint.exam", "string").alias("exam"), get("$.blueprint.total_marks", "double").alias("total_marks"),
    )


def p5_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nested.flat_table(paper_nodes(spark, sf_dir, SLOT), SLOT, {"n": "int", "status": "string", "source": "string", "bank_id": "string", "question": "string", "marks": "double", "co": "string", "bloom": "string"})
    return rows.select(F.col("root_id").alias("paper_id"), nested.label_text().alias("slot_key"), F.col("position").alias("slot_pos"), "n", "status", "source", "bank_id", "question", "marks", "co", "bloom")


def p5_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nested.flat_table(paper_nodes(spark, sf_dir, PART), PART, {"label": "string", "text": "string", "marks": "double"})
    return rows.select(F.col("root_id").alias("paper_id"), nested.label_text("parent").alias("slot_key"), nested.label_text().alias("part_key"), F.col("position").alias("part_pos"), "label", "text", "marks")


def p5_subparts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nested.flat_table(paper_nodes(spark, sf_dir, SUBPART), SUBPART, {"label": "string", "text": "string", "marks": "double"})
    return rows.select(F.col("root_id").alias("paper_id"), nested.label_text("parent").alias("part_key"), nested.label_text().alias("subpart_key"), F.col("position").alias("subpart_pos"), "label", "text", "marks")


QUERIES = {f.__name__: f for f in (p5_found, p5_chunks, p5_outcomes, p5_papers, p5_slots, p5_parts, p5_subparts)}

_SLOT_KEY = "list_position(list_sort(json_keys(j)), 'slots') || '.' || p1"
_PART_KEY = _SLOT_KEY + " || '.' || list_position(list_sort(json_keys(sv)), 'parts') || '.' || p2"


def _text(name: str) -> str:
    return f"json_extract_string(v, '$.{name}') AS {name}"


def _number(name: str) -> str:
    return f"CAST(json_extract_string(v, '$.{name}') AS DOUBLE) AS {name}"


_CHUNKS = "one AS (SELECT chunk_id, arg_max(co_details, loaded_at) AS d, arg_max(description, loaded_at) AS description, arg_max(topic_ids, loaded_at) AS topic_ids FROM tutorial_chunks GROUP BY chunk_id)"
_PAPERS = """one AS (SELECT paper_id, arg_max(body, loaded_at) AS body FROM paper_files WHERE paper_id IS NOT NULL GROUP BY paper_id),
ok AS (SELECT paper_id, body::JSON AS j FROM one WHERE json_valid(body)),
slots AS (SELECT paper_id, j, s.i AS p1, s.v AS v FROM ok, LATERAL (SELECT unnest(range(1, 1 + json_array_length(j, '$.slots')::BIGINT)) AS i, unnest(json_extract(j, '$.slots[*]')) AS v) s),
p0 AS (SELECT paper_id, p1, j, v AS sv, CASE WHEN json_type(v, '$.parts') = 'VARCHAR' AND json_valid(json_extract_string(v, '$.parts')) THEN json_extract_string(v, '$.parts')::JSON ELSE json_extract(v, '$.parts') END AS ps FROM slots),
p0a AS (SELECT paper_id, p1, j, sv, CASE json_type(ps) WHEN 'ARRAY' THEN json_extract(ps, '$[*]') WHEN 'OBJECT' THEN [ps] ELSE [] END AS ps FROM p0),
parts AS (SELECT paper_id, p1, j, sv, x.i AS p2, x.v AS v FROM p0a, LATERAL (SELECT unnest(range(1, 1 + len(ps))) AS i, unnest(ps) AS v) x),
s0 AS (SELECT paper_id, p1, p2, j, sv, v AS pv, CASE json_type(v, '$.parts') WHEN 'ARRAY' THEN json_extract(v, '$.parts[*]') WHEN 'OBJECT' THEN [json_extract(v, '$.parts')] ELSE [] END AS ps FROM parts),
subs AS (SELECT paper_id, p1, p2, j, sv, pv, x.i AS p3, x.v AS v FROM s0, LATERAL (SELECT unnest(range(1, 1 + len(ps))) AS i, unnest(ps) AS v) x)"""

SQL = {
    "p5_found": f"""WITH {_CHUNKS}, {_PAPERS},
      els AS (SELECT chunk_id, unnest(range(1, 1 + len(d))) AS i, unnest(d) AS e FROM one1)
      SELECT 'co_detail' AS kind, chunk_id AS root_id, i::INT AS pos1, 0::INT AS pos2, 0::INT AS pos3, coalesce(e.id, '') AS label FROM els WHERE e IS NOT NULL
      UNION ALL SELECT 'slot_part', paper_id, p1::INT, p2::INT, 0::INT, coalesce(json_extract_string(v, '$.label'), '') FROM parts
      UNION ALL SELECT 'slot_part', paper_id, p1::INT, p2::INT, p3::INT, coalesce(json_extract_string(v, '$.label'), '') FROM subs""".replace(
        "one AS (SELECT chunk_id", "one1 AS (SELECT chunk_id"
    ),
    "p5_chunks": f"WITH {_CHUNKS} SELECT chunk_id, description, coalesce(len(topic_ids), 0)::INT AS n_topics FROM one",
    "p5_outcomes": f"""WITH {_CHUNKS}, els AS (SELECT chunk_id, unnest(range(1, 1 + len(d))) AS i, unnest(d) AS e FROM one)
      SELECT chunk_id, i::INT AS position, e.id AS id, e.subject AS subject, e.text AS text, e.source AS source, e.via AS via, e.label AS label FROM els WHERE e IS NOT NULL""",
    "p5_papers": """WITH one AS (SELECT paper_id, arg_max(body, loaded_at) AS body FROM paper_files WHERE paper_id IS NOT NULL GROUP BY paper_id),
      j AS (SELECT paper_id, CASE WHEN json_valid(body) THEN body::JSON END AS j FROM one)
      SELECT paper_id, j IS NOT NULL AS is_valid, json_extract_string(j, '$.blueprint.subject') AS subject, json_extract_string(j, '$.blueprint.exam') AS exam,
        CAST(json_extract_string(j, '$.blueprint.total_marks') AS DOUBLE) AS total_marks FROM j""",
    "p5_slots": f"""WITH {_PAPERS} SELECT paper_id, {_SLOT_KEY} AS slot_key, p1::INT AS slot_pos, CAST(json_extract_string(v, '$.n') AS INT) AS n, {_text('status')}, {_text('source')},
      {_text('bank_id')}, {_text('question')}, {_number('marks')}, {_text('co')}, {_text('bloom')} FROM slots""",
    "p5_parts": f"""WITH {_PAPERS} SELECT paper_id, {_SLOT_KEY} AS slot_key, {_PART_KEY} AS part_key, p2::INT AS part_pos, {_text('label')}, {_text('text')}, {_number('marks')} FROM parts""",
    "p5_subparts": f"""WITH {_PAPERS} SELECT paper_id, {_PART_KEY} AS part_key, {_PART_KEY} || '.' || list_position(list_sort(json_keys(pv)), 'parts') || '.' || p3 AS subpart_key,
      p3::INT AS subpart_pos, {_text('label')}, {_text('text')}, {_number('marks')} FROM subs""",
}
