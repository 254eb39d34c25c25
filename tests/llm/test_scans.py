from coursewright.llm import scans as S
from tests.conftest import rows

COMMON = "the value of each page and the number of steps is given with the larger one when the lock has been removed from the table"


def pages(spark):
    out = []
    for p in range(12):
        title = f"Roll no. ____  OSK T1 Set D{40 + p}"
        for n in (1, 2, 3):
            text = f"{title if n > 1 or p % 2 else 'Harnmoor School'}\n\nQ{n}. Compute {COMMON}.\nGive the value after {p}2 steps.\n- {n} -"
            out.append((f"P{p}_p{n:03}", f"P{p}", n, text, 0))
    out.append(("X_p001", "X", 1, "Q1. Give the volue of each poge when the lock has been remo-\nved from the table in 1O3 steps and take a self-\n\nPage l of 2", 0))
    out.append(("X_p002", "X", None, "timed lock. The self-timed lock is whole, self-timed.\n\ncount--;\nPage 2 of 2", 0))
    out.append(("X_p002", "X", None, "timed lock. The self-timed lock is whole, self-timed.\n\ncount--;\nPage 2 of 2", 0))
    out += [("N1", None, None, None, 0), ("N2", "E", 1, "", 0), (None, "E", 1, "x", 0)]
    return spark.createDataFrame(out, "page_id string, paper string, page_num int, text string, extracted_at int")


def test_kinds_of_lines(spark):
    got = rows(S.line_kinds(pages(spark)))
    kinds = {(p, n): k for p, n, k in got}
    assert kinds["X_p001", 1] and ("X_p001", 1, "misread") in got and ("X_p001", 1, "hyphen") in got
    assert ("X_p001", 2, "misread") in got  # a letter in a number
    assert ("X_p001", 2, "hyphen") not in got  # a compound at its own hyphen
    assert ("X_p001", 4, "pageno") in got and ("X_p002", 4, "pageno") in got
    assert ("P1_p001", 1, "running") in got and ("P2_p002", 1, "running") in got and ("P2_p001", 1, "running") not in got
    assert all(("P3_p001", n, "misread") not in got for n in range(1, 6))
    assert ("P3_p002", 5, "pageno") in got
    assert len(got) == len(set(got))


def test_paragraphs_read_across_pages(spark):
    text = {r.paper: [] for r in S.paragraphs(pages(spark)).collect()}
    for r in S.paragraphs(pages(spark)).orderBy("paragraph").collect():
        text[r.paper].append(r.text)
    whole = " ".join(text["X"])
    assert "value of each page" in whole and "removed from the table in 103 steps" in whole and "self-" in whole and "Page" not in whole
    assert not any("Roll no" in t or "- 2 -" in t for t in text["P1"])


def test_numbers_and_skeletons():
    assert S.number_style("Page l of 3") == ("page of", 1) and S.number_style("- 12 -") == ("dash", 12) and S.number_style("iv") == ("roman", 4) and S.number_style("Pagc 2") == ("page", 2)
    assert S.number_style("P.T.O.   S") == ("pto", 5) and S.number_style("Give a reason") is None and S.number_style("") is None
    for right, wrong in (("value", "volue"), ("normal", "riormal"), ("removed", "removecl"), ("with", "vvith"), ("link", "hnk"), ("steps", "5teps"), ("label", "la6el"), ("clock", "dock")):
        assert S.skeleton(right) == S.skeleton(wrong) and S.confusions_between(wrong, right) == 1
    assert S.confusions_between("file", "the") > 2


def test_rare_forms_are_judged_by_their_share_of_papers(spark):
    lines = [(f"P{p}", "outlme" if p % 40 == 0 else "outline") for p in range(2400)] + [(f"P{p}", w) for p in range(0, 2400, 400) for w in ("Zanrnivo", "Zanmivo", "Zanmivo")]
    words = spark.createDataFrame([(p, "", 0, w, S.skeleton(w), 0, "", "") for p, w in lines], "paper string, page_id string, line_no int, form string, skel string, half int, left string, next string")
    everywhere, in_paper, _ = S.misread_forms(words)
    assert rows(everywhere) == [("outlme", "outline")]
    assert {r[1:] for r in rows(in_paper)} == {("Zanrnivo", "Zanmivo")}


def test_cut_words_are_written_right_in_paragraphs(spark):
    more = [("Y_p001", "Y", 1, "Q1. Say when the lock has been rerno-\nved, from the table with the lar-\n\ngcr one and the num-\nber of steps is rem-", 0), ("Y_p002", "Y", 2, "oved. Then it is Rem-\novcd again.", 0)]
    df = pages(spark).unionByName(spark.createDataFrame(more, "page_id string, paper string, page_num int, text string, extracted_at int"))
    whole = " ".join(r.text for r in S.paragraphs(df).filter("paper = 'Y'").orderBy("paragraph").collect())
    assert whole == "Q1. Say when the lock has been removed, from the table with the larger one and the number of steps is removed. Then it is Removed again."


def test_neighbours_decide_between_real_words(spark):
    """Words that share a skeleton and are one confusion apart: each stays where its own neighbours are, and is misread among the other's."""
    out = []
    for p in range(200):
        text = f"Q1. We hear a bell in the town and fill a form with ink after {p + 20} days.\nIt has a form of its own and you hear a noise.\n"
        if p % 20 == 0:
            text += "A brown bear sleeps near the old farm house until a brown bear wakes.\nThey own the old farm house.\n"
        if p == 7:
            text += "Now we bear a bell in the town.\n"
        out.append((f"P{p:03}_p001", f"P{p:03}", 1, text, 0))
    df = spark.createDataFrame(out, "page_id string, paper string, page_num int, text string, extracted_at int")
    got = {(p, n) for p, n, k in rows(S.line_kinds(df)) if k == "misread"}
    assert got == {("P007_p001", 3)}
    texts = {r.paper: r.text for r in S.paragraphs(df).collect()}
    assert "A brown bear sleeps near the old farm house" in texts["P020"] and "Now we hear a bell" in texts["P007"]


def test_words_given_away_by_their_glyphs_are_mended(spark):
    more = [(f"Z{i}_p001", f"Z{i}", 1, f"Q1. The jailer of {i + 12} cells keeps a marble.", 0) for i in range(3)] + [("Y_p001", "Y", 1, "Q1. The ja!ler keeps a mar6le.", 0)]
    df = spark.createDataFrame(more, "page_id string, paper string, page_num int, text string, extracted_at int")
    assert [r.text for r in S.paragraphs(df).filter("paper = 'Y'").collect()] == ["Q1. The jailer keeps a marble."]


def test_pages_are_ordered_by_page_num(spark):
    df = spark.createDataFrame([("A_p009", "A", 1, "Q1. Say when the lock was", 0), ("A_p003", "A", 2, "taken from the door.", 0)], "page_id string, paper string, page_num int, text string, extracted_at int")
    assert [r.text for r in S.paragraphs(df).collect()] == ["Q1. Say when the lock was taken from the door."]
