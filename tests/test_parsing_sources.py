import json

import pytest

from coursewright.functions import parsing as P
from coursewright.sources import course_files as C
from coursewright.streaming import answers
from tests.conftest import SF, rows


@pytest.mark.parametrize(("text", "code", "marks"), [("x [CO2(Applying), 6 Marks]", "CO2", 6), ("[C109.4 (Applying), 2+3 M]", "C109.4", 5), ("[CO2, 2+2+1+1+1=7 Marks]", "CO2", 7), ("[C03, 1 + 1.5 + 1.5 + 2 Marks]", "CO3", 6), ("[5 Marks]", None, 5), ("(CO2, 1.5M)", "CO2", 1.5), ("[CO2, 5 marks each]", "CO2", None)])
def test_tags(text, code, marks):
    (tag,) = P.tags_of(text)
    assert tag["code"] == code and tag["marks"] == marks and tag["each"] == ("each" in text)


@pytest.mark.parametrize("text", ["a[10 M]", "f(3)", "(CO2 carries 5 marks in total)", "[Hint: worth 5 Marks here]", "", None, "(4M)"])
def test_no_tags(text):
    assert P.tags_of(text) == []


def test_tags_are_taken_out():
    assert P.without_tags("Find `x`. [5 Marks]\n---\n\n\n\nNext a[10 M]") == "Find x. \n\nNext a[10 M]"


@pytest.mark.parametrize(("header", "year"), [("ODD Semester 2023-24", 2023), ("Even Semester 2023-24", 2024), ("Session 2023-24, May 2025", 2025), ("held 2024-05-17", 2024), ("code 120245", None), ("", None), (None, None)])
def test_years(header, year):
    assert P.exam_year(header) == year


def test_kinds():
    assert [P.exam_kind("END-TERM exam"), P.exam_kind("Mid Sem"), P.exam_kind("x", "T1_APS_pages"), P.exam_kind(None, None)] == ["endsem", "midsem", "test1", "unknown"]


def test_personal_data():
    text = "Student's name: Pel Vorrin   Roll no. 7731204\nName: ________\nRoll no. ________\nRegistration number: KX/2231\nQ1. Name the tree\nName Pel Vorrin\nRoll No.: 7731 204 (by hand)\nroll_no = 5;"
    once = P.redact(text)
    assert once == "Name: ________\nRoll no. ________\nQ1. Name the tree\nName Pel Vorrin\nroll_no = 5;" and P.redact(once) == once and P.redact(None) is None


def test_chatter():
    assert P.without_chatter("Here is the transcription of the page:\n\nQ1. Text\n### Handwritten notes:\n* left of Q3\n\n---\nQ2. More") == "Q1. Text\nQ2. More"
    assert P.without_chatter("Q1. Here is a transcription of it") == "Q1. Here is a transcription of it"
    assert P.without_chatter("### Handwritten Notes:\n\n* a tick\n---\n1. Printed item\n2. Another") == "1. Printed item\n2. Another"
    assert P.without_chatter("Sure! Here's the transcribed text.\n---\n- printed list") == "- printed list" and P.without_chatter("") == "" and P.without_chatter(None) is None


def test_repeated_headings():
    assert P.without_repeated_headings("### Q.1\n\nQ1. Text\n## Q2.\nText of two\n## Q3\nQ4. x") == "\nQ1. Text\n## Q2.\nText of two\n## Q3\nQ4. x"


def test_numbering():
    keep = lambda m: [m[i] for i in P.numbering(m)]
    assert keep([1, 2, 3, 12, 4, 5]) == [1, 2, 3, 4, 5] and keep([1, 2, 4]) == [1, 2, 4] and keep([]) == [] and keep([1, 2, 3, 1, 2, 3, 4]) == [1, 2, 3, 1, 2, 3, 4]
    assert keep([1, 2, 9, 10]) == [1, 2, 9, 10] and keep([1, 5]) == [1, 5] and keep([4, 5, 6]) == [4, 5, 6] and keep([1, 1]) == [1]
    assert P.numbering([1, 7, 2], [1.0, 0.9, 1.0]) == [0, 2]


@pytest.mark.parametrize(("text", "ok"), [("5 + 8 = 12", False), ("5 + 8 = 13", True), ("(0+9)/2 = 4", True), ("10/3 = 3.33", True), ("10/3 = 3.34", False), ("2^10 = 1024", True), ("max(3, 4) = 4", True), ("so far: 2 + 3 * 4 = 14.", True), ("-2^2 = -4", True), ("2^3^2 = 512", True), ("(7+8)/4 = 3", True), ("17 % 5 = 3", False)])
def test_calculations(text, ok):
    (c,) = P.calculations(text)
    assert c["ok"] is ok


@pytest.mark.parametrize("text", ["n = 6", "log2(8) = 4", "x1 + 2 = 3", "", None, "9**9**9 = 1", "1/0 = 2"])
def test_no_calculations(text):
    assert P.calculations(text) == []


def test_replies():
    assert P.reply_json('<think>{"a": 0}</think>```json\n{"a": {"b": 1}}\n``` done') == {"a": {"b": 1}} and P.reply_json("[1]") is None and P.reply_json(None) is None


def test_files(spark, tmp_path):
    (tmp_path / "book.jsonl").write_text('{"chunk_id": "b1", "text": "x"}\n\n{"chunk_id": "b2"}\n')
    (tmp_path / "DS_tutorial_chunks.jsonl").write_text('{"chunk_id": "t1", "topic_ids": ["A", "B"]}\n')
    assert rows(C.read_book_chunks(spark, str(tmp_path)), "chunk_id") == [("b1",), ("b2",)]
    assert rows(C.read_tutorial_chunks(spark, str(tmp_path)), "chunk_id", "subject") == [("t1", "DS")] and C.read_tutorial_chunks(spark, str(tmp_path), "OS").count() == 0
    papers = tmp_path / "papers"
    papers.mkdir()
    record = lambda i, kind, text, co: {"id": i, "document": text, "metadata": {"type": kind, "course_outcome": co, "bloom_level": "Apply"}}
    (papers / "p.json").write_text(json.dumps([record("h", "header", "x" * 99, None), record("a", "question", "Q1. " + "y" * 99, "CO1"), record("b", "question", " short ", ""), record("c", "question", None, None)], indent=1))
    long, short = C.split_short(C.read_paper_records(spark, str(papers)))
    assert rows(long, "id") == [("a",)] and rows(short, "id") == [("b",), ("c",)]
    assert rows(C.labelled_questions(C.read_paper_records(spark, str(papers))), "document") == [("y" * 99,)]


def test_curriculum_and_graph_store(spark, tmp_path):
    y = tmp_path / "ds.yaml"
    y.write_text("subject: DS\nsemester: 3\ncourse_outcomes: {CO1: Explain it}\nco_levels: {CO1: Understand}\ntopics:\n- {id: DS_01, name: Lists, co: [CO1]}\n- {id: DS_02, name: Trees}\nprerequisites:\n- {topic: DS_02, requires: DS_01}\n")
    tables = C.read_curriculum(spark, [str(y)])
    assert rows(tables["requires"]) == [("DS_02", "DS_01", "hard")] and rows(tables["contributes"]) == [("DS_01", "DS:CO1")]
    assert rows(C.unknown_ids(tables["topics"], spark.createDataFrame([("DS_09",), ("DS_01",), (None,)], "topic_id string"), "topic_id")) == [("DS_09",)]
    store = C.GraphStore(spark, str(tmp_path / "graph"))
    assert store.current() is None
    store.save(tables, "v1")
    with pytest.raises(Exception):
        store.save({"topics": tables["topics"], "bad": tables["topics"].select("no_such_column")}, "v2")
    assert store.current() == "v1" and store.load("topics").count() == 2


def test_answer_log_and_pages(spark, tmp_path):
    log = C.AnswerLog(spark, str(tmp_path / "log"))
    log.append(spark.createDataFrame([("a", 1, "v2", "CO1", "Apply", None), ("b", 1, "v2", None, None, "timeout"), ("a", 0, "v1", "CO9", "Apply", None)], C.AnswerLog.SCHEMA))
    log.append(spark.createDataFrame([("a", 2, "v2", "CO2", "Apply", None)], C.AnswerLog.SCHEMA))
    assert rows(log.answers("v2"), "id", "co") == [("a", "CO2")]
    p = lambda *x: spark.createDataFrame(list(x), "paper string, page_num int")
    assert rows(C.pages_to_do(p(("x", 1), ("x", 2)), p(("x", 1)))) == [("x", 2)]


def test_settings():
    assert C.settings("# c\nexport A='x # y'\nB=2 # two\nC=", {"B": "3", "Z": "no"}, {"B": "0", "D": "d"}) == {"A": "x # y", "B": "3", "C": "", "D": "d"}
    assert [C.parse_setting(x) for x in ("# note", "a#b", "a\t# b", "'x", '"a b" # c', "")] == ["", "a#b", "a", "'x", "a b", ""]


def test_streams(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    spark.read.parquet(f"{SF}/events.parquet").limit(400).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = answers.keep_latest(stream(), "user_id", ["ts", "event_id"], str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    kept = spark.read.parquet(str(tmp_path / "out"))
    assert kept.count() == spark.read.parquet(str(tmp_path / "in")).select("user_id").distinct().count()
    s = answers.first_of_each(stream(), "user_id", "ts", "365 days").writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    s.awaitTermination(120)
    assert spark.table("firsts").count() == kept.count()
