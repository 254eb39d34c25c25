"""Reading and writing the file layouts of course material.

Readers take schemas and globs and stay lazy; nothing is inferred from the data.
"""

from __future__ import annotations

import re
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = "chunk_id string, subject string, source_file string, section_title string, page_start int, page_end int, text string, topic_id string, topic_subject string, topic_semester int, is_prereq_content boolean, chapter int, tag_method string, needs_review boolean, advanced boolean"
OUTCOME = "struct<id:string,subject:string,text:string,source:string,via:string,label:string>"
TUTORIAL = f"chunk_id string, description string, topics array<string>, topic_ids array<string>, cos array<string>, co_details array<{OUTCOME}>"
PAGE = "page_id string, paper string, source_file string, page_num int, extraction_method string, text string"
BREAKDOWN = "array<struct<raw_co_code:string,co_short:string,bloom_level:string,marks:double>>"
RECORD = f"id string, document string, metadata struct<source:string,subject:string,year:int,exam:string,type:string,question_number:int,raw_co_code:string,course_outcome:string,co_description:string,bloom_level:string,marks:double,marks_breakdown:{BREAKDOWN},topic_id:string,topic_name:string,needs_review:boolean,review_reason:string>"


def read_book_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """All book chunks of a folder's JSON-lines files; blank lines and tutorial files are skipped."""
    rows = spark.read.schema(CHUNK).json(f"{folder}/*.jsonl").withColumn("_f", F.col("_metadata.file_name"))
    return rows.filter(~F.col("_f").endswith("_tutorial_chunks.jsonl") & F.col("chunk_id").isNotNull()).drop("_f")


def read_tutorial_chunks(spark: SparkSession, folder: str, subject: str | None = None) -> DataFrame:
    """Tutorial chunks with the subject that the file is named after, of one subject or all."""
    rows = spark.read.schema(TUTORIAL).json(f"{folder}/*_tutorial_chunks.jsonl")
    rows = rows.withColumn("subject", F.regexp_extract(F.col("_metadata.file_name"), r"^([A-Za-z0-9]+)_tutorial_chunks", 1)).filter("chunk_id is not null")
    return rows.filter(F.col("subject") == subject) if subject else rows


def read_paper_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of past papers, each file a JSON array."""
    return spark.read.schema(RECORD).option("multiLine", True).json(f"{folder}/*.json")


def split_short(records: DataFrame, least: int = 60) -> tuple[DataFrame, DataFrame]:
    """Questions long enough to be stored, and those that are not; headers are in neither. Null documents are short."""
    questions = records.filter("metadata.type = 'question'")
    enough = F.length(F.trim(F.coalesce("document", F.lit("")))) >= least
    return questions.filter(enough), questions.filter(~enough)


def labelled_questions(records: DataFrame) -> DataFrame:
    """Questions with outcome and level, without the number printed before them."""
    from coursewright.functions.text import strip_number

    m = F.col("metadata")
    ok = (m["type"] == "question") & (F.coalesce(m["course_outcome"], F.lit("")) != "") & (F.coalesce(m["bloom_level"], F.lit("")) != "")
    return records.filter(ok).withColumn("document", strip_number(F.col("document")))


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(PAGE).json(f"{folder}/*.jsonl").filter("page_id is not null")


def pages_to_do(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """The pages (``paper, page_num``) that an interrupted run has still to extract."""
    return wanted.join(done.select("paper", "page_num"), ["paper", "page_num"], "left_anti")


def read_curriculum(spark: SparkSession, paths: list[str]) -> dict[str, DataFrame]:
    """``topics, outcomes, requires, contributes`` of the subjects' YAML files, which are small and read on the driver."""
    topics, outcomes, requires, contributes = [], [], [], []
    for path in paths:
        data = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
        subject, levels = data["subject"], data.get("co_levels") or {}
        for co, text in (data.get("course_outcomes") or {}).items():
            outcomes.append((f"{subject}:{co}", subject, co, str(text), levels.get(co)))
        for t in data.get("topics") or []:
            topics.append((t["id"], t.get("name"), subject, data.get("semester")))
            contributes += [(t["id"], f"{subject}:{co}") for co in t.get("co") or []]
        for p in data.get("prerequisites") or []:
            requires.append((p["topic"], p["requires"], p.get("strength") or "hard"))
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "topics": make(topics, "topic_id string, topic_name string, subject string, semester int"),
        "outcomes": make(outcomes, "co_id string, subject string, short_id string, description string, co_level string"),
        "requires": make(requires, "src string, dst string, strength string"),
        "contributes": make(contributes, "topic_id string, co_id string"),
    }


def unknown_ids(catalog: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Ids in use that the catalogue lacks."""
    return used.select(key).filter(F.col(key).isNotNull()).distinct().join(catalog.select(key), key, "left_anti")


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines, one file per partition; complete once ``_SUCCESS`` is there."""
    df.write.mode("overwrite").json(path)


class GraphStore:
    """The four tables of a graph in versioned folders.

    A version counts once a pointer to it stands under ``pointers``, which is written
    last and never changed: a load that breaks off leaves the old graph, and at no
    moment is there none.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _pointers(self) -> list[str]:
        """``<number>=<version>``, oldest first."""
        fs, path = self._fs()
        at = path(f"{self.path}/pointers")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def current(self) -> str | None:
        pointers = self._pointers()
        return pointers[-1].partition("=")[2] if pointers else None

    def save(self, tables: dict[str, DataFrame], version: str) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/{version}/{name}")
        last = self._pointers()
        number = int(last[-1].partition("=")[0]) + 1 if last else 1
        fs, path = self._fs()
        fs.create(path(f"{self.path}/pointers/{number:09d}={version}"), False).close()

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.current()}/{name}")


class AnswerLog:
    """An append log of answers that a run resumes from: the last valid row per id of one prompt version counts."""

    SCHEMA = "id string, seq long, prompt_version string, co string, bloom string, error string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def answers(self, prompt_version: str) -> DataFrame:
        from coursewright.operators.sync import last_per_key

        log = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        return last_per_key(log.filter(F.col("prompt_version") == prompt_version), "id", ["seq"], "error is null")


def parse_setting(raw: str) -> str:
    """A value of a settings file: what stands between quotes, else all up to a comment (a ``#`` at the start or after a blank)."""
    value = raw.strip()
    quote, closed, _ = value[1:].partition(value[0]) if value[:1] in ("'", '"') else ("", "", "")
    if closed:
        return quote
    return f" {value}".replace("\t#", " #").partition(" #")[0].strip()


def settings(text: str, environment: dict[str, str], defaults: dict[str, str]) -> dict[str, str]:
    """The environment goes before the file, the file before the defaults."""
    found = dict(defaults)
    for line in text.splitlines():
        name, eq, value = line.strip().removeprefix("export ").partition("=")
        if eq and name and not name.startswith("#"):
            found[name.strip()] = parse_setting(value)
    return found | {k: v for k, v in environment.items() if k in found}
