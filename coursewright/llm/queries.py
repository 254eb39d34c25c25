"""The queries of the text operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursewright.llm import batches, canonical, mixing, mojibake, scans, spans, tokens
from coursewright.session import apart, cut, scratch_path, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.line_kinds(table(spark, sf_dir, "pyq_pages"))


def p1_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.paragraphs(table(spark, sf_dir, "pyq_pages"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = spans.question_records(table(spark, sf_dir, "pyq_questions"), table(spark, sf_dir, "generated_questions"))
    return spans.shared_runs(records).select("rec.tab", "rec.rec_id", "start_pos", "n_chars")


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = spans.question_records(table(spark, sf_dir, "pyq_questions"), table(spark, sf_dir, "generated_questions"))
    return spans.record_shares(records, spans.shared_runs(records)).select("rec.tab", "rec.rec_id", "n_chars", "shared_chars", "share")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    return canonical.map_labels(t("pyq_questions"), t("bloom_levels"), t("course_outcomes"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.find_repeats(table(spark, sf_dir, "generated_questions"))


def p4_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs, each batch looked up in the store of what was accepted before it."""
    bank = table(spark, sf_dir, "generated_questions")
    # rows of an id belong to its first batch; batch numbers are few
    first = cut(bank.groupBy("bank_id").agg(F.min("batch_no").alias("first_batch")))
    numbers = sorted((r[0] for r in first.select("first_batch").distinct().collect()), key=lambda n: (n is not None, n))
    store = batches.AcceptedStore(spark, scratch_path(spark, "accepted"))
    found = [store.add(bank.join(apart(first.filter(F.col("first_batch").eqNullSafe(n)).select("bank_id")), "bank_id", "left_semi")) for n in numbers]
    pairs = [f.select(F.least("bank_id", "repeats").alias("bank_id_1"), F.greatest("bank_id", "repeats").alias("bank_id_2")) for f in found]
    return reduce(DataFrame.unionByName, pairs) if pairs else spark.createDataFrame([], "bank_id_1 string, bank_id_2 string")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_column(table(spark, sf_dir, "documents"), ["doc_id"], "text")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_column(table(spark, sf_dir, "documents"), ["doc_id", "source"], "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = mixing.repetition_rates(cut(mixing.source_totals(_sized(spark, sf_dir))), table(spark, sf_dir, "mix_targets"))
    return mixing.short_sources(rates)


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed set itself: a row per copy of a document, numbered from 1."""
    sized = cut(_sized(spark, sf_dir))
    rates = mixing.repetition_rates(cut(mixing.source_totals(sized)), table(spark, sf_dir, "mix_targets"))
    return mixing.emit_copies(mixing.mixed_set(sized, rates)).select("doc_id", "copy_no", "source", "n_tokens")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = cut(_sized(spark, sf_dir))
    rates = mixing.repetition_rates(cut(mixing.source_totals(sized)), table(spark, sf_dir, "mix_targets"))
    return mixing.actual_shares(mixing.mixed_set(sized, rates), rates)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled_only(mojibake.repair_column(table(spark, sf_dir, "documents"), "doc_id", "text")).select("doc_id")


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled_only(mojibake.repair_column(table(spark, sf_dir, "documents"), "doc_id", "text")).select("doc_id", "restored", "edges")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_paragraphs, p2_found, p2_shares, p3_found, p4_found, p4_batches, p6_ids, p7_found, p7_mix, p7_shares, p8_found, p8_restored)}


def oracle_sql() -> dict[str, str]:
    """Where a result can be stated in SQL over the given tables at all; the others are tested against brute force and round trips."""
    records = """r AS (SELECT 'pyq_questions' AS tab, id AS rec_id, arg_max(document, loaded_at) AS t FROM pyq_questions WHERE metadata.type = 'question' AND id IS NOT NULL GROUP BY id
      UNION ALL SELECT 'generated_questions', bank_id, arg_max(question, loaded_at) FROM generated_questions WHERE question <> '' AND bank_id IS NOT NULL GROUP BY bank_id)"""
    runs = f"""{records}, w AS (SELECT tab, rec_id, i, substr(t, i, 100) AS s FROM r, LATERAL (SELECT unnest(range(1, length(t) - 98)) AS i) x WHERE length(t) >= 100),
      twice AS (SELECT s FROM w GROUP BY s HAVING count(DISTINCT tab || rec_id) > 1), h AS (SELECT tab, rec_id, i FROM w SEMI JOIN twice USING (s)),
      g AS (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY tab, rec_id ORDER BY i) + 100, true) AS new FROM h), n AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY tab, rec_id ORDER BY i) AS run FROM g),
      runs AS (SELECT tab, rec_id, min(i)::INT AS start_pos, (max(i) - min(i) + 100)::INT AS n_chars FROM n GROUP BY tab, rec_id, run)"""
    return {
        "p2_found": f"WITH {runs} SELECT tab, rec_id, start_pos, n_chars FROM runs",
        "p2_shares": f"""WITH {runs}, s AS (SELECT tab, rec_id, sum(n_chars)::BIGINT AS k FROM runs GROUP BY ALL)
          SELECT r.tab, r.rec_id, coalesce(length(t), 0)::INT AS n_chars, coalesce(k, 0) AS shared_chars, CASE WHEN coalesce(length(t), 0) > 0 THEN round(coalesce(k, 0) / length(t), 6) ELSE 0.0::DOUBLE END AS share FROM r LEFT JOIN s USING (tab, rec_id)""",
    }


__all__ = ["oracle_sql", "queries"]
