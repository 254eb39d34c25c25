import pytest
from pyspark.sql import functions as F

from coursewright.operators import graph as G
from coursewright.operators import layout as L
from coursewright.operators import retrieval as R
from coursewright.operators import sync as Y
from tests.conftest import rows


def lines(spark, items):
    return spark.createDataFrame(items, "doc string, page_id string, line_no int, text string, size double, bold boolean, extra string")


def test_margins_and_sections(spark):
    items = []
    for p in (1, 2, 3):
        items += [("d", f"p{p}", 1, "Sheet  1", 10.0, False, "x"), ("d", f"p{p}", 2, f"Part {p} of it", 14.0 if p > 1 else 10.0, False, "x"), ("d", f"p{p}", 3, "", 10.0, False, "x")]
        items += [("d", f"p{p}", 4 + i, f"line {p} {i} goes on", 10.0, False, "x") for i in range(9)]
    items += [("one", "q1", 1, "Sheet 1", 10.0, False, "x"), ("one", "q1", 2, None, 10.0, None, "x")]
    df = lines(spark, items)
    assert rows(L.repeated_margins(df)) == [("d", "sheet 1", 3)]
    assert rows(L.font_sections(df)) == [("d", 1, "Part 2 of it", "p2", "p3", 12), ("d", 2, "Part 3 of it", "p3", "p3", 11)]
    empty = df.limit(0)
    assert rows(L.repeated_margins(empty)) == [] and rows(L.font_sections(empty)) == []


def test_glyphs_by_the_first_prefix_that_fits(spark):
    df = spark.createDataFrame([("a0b", "SYMA1"), ("a0b", "SYM2"), ("a0b", "Serif"), ("a0\x01", None), (None, "SYM")], "t string, f string")
    got = rows(df.select(L.font_glyphs(F.col("t"), F.col("f"), [("SYMA", {"0": "≤"}), ("SYM", {"0": "∈", "b": ""})])))
    assert got == sorted([("a≤b",), ("a∈",), ("a0b",), ("a0",), (None,)], key=repr)


def test_closure_and_required_keys(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (None, 1), (1, 2)], "src int, dst int")
    s = spark.createDataFrame([(1,), (1,), (9,), (None,)], "start int")
    assert rows(G.closure(s, e)) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 3), (9, 9, 0)] and rows(G.closure(s, e, 1)) == [(1, 1, 0), (1, 2, 1), (9, 9, 0)]
    known = spark.createDataFrame([(1,), (2,)], "start int")
    assert rows(G.missing(s, known, "start")) == [(9,)] and G.require(known, known, "start") is known
    with pytest.raises(KeyError):
        G.require(s, known, "start")


def test_tiers_and_pages(spark):
    mk = lambda items: spark.createDataFrame(items, "q int, r int, dist double, marks int, _block int")
    topic, subject = mk([(1, 10, 0.5, 9, 0), (1, 11, 0.9, 5, 0)]), mk([(1, 10, 0.1, 5, 0), (1, 12, 0.2, 5, 1), (1, 13, 0.1, 9, 0), (2, 14, 0.1, 5, 0)])
    got = rows(R.in_tiers([topic, subject], "q", "r", 3, 10, ["dist", "r"], F.abs(F.col("marks") - 5) > 1), "q", "rank", "r", "tier")
    assert got == [(1, 1, 11, 0), (1, 2, 10, 0), (1, 3, 12, 1), (2, 1, 14, 1)]
    ids = spark.range(10).toDF("i")
    assert rows(R.read_page(ids, ["i"], 2, 4)) == [(4,), (5,), (6,), (7,)] and rows(R.read_page(ids, ["i"], 9, 4)) == []


def test_ids_on_collision_and_marks_of_use(spark):
    new = spark.createDataFrame([("a", 2, "x"), ("a", 1, "x"), ("b", 1, "x"), ("c_2", 1, "x"), (None, 1, "x")], "id string, o int, base string")
    stored = spark.createDataFrame([("a",), ("a_4",), ("c",), ("c_2",), (None,)], "id string")
    assert rows(Y.free_ids(new, stored, "id", ["o"]), "id", "o", "new_id") == sorted([("a", 1, "a_5"), ("a", 2, "a_6"), ("b", 1, "b"), ("c_2", 1, "c_2_2"), (None, 1, None)], key=repr)
    assert rows(Y.free_ids(new.filter("id = 'b'"), stored.limit(0), "id", ["o"]), "new_id") == [("b",)]
    used = spark.createDataFrame([("p2", "a"), ("p1", "a"), ("p3", None)], "paper string, id string")
    assert rows(Y.mark_used(stored, used, "id", "paper")) == sorted([("a", "p1"), ("a_4", None), ("c", None), ("c_2", None), (None, None)], key=repr)
