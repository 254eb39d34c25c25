import re

from coursewright.plans import catalog
from tests.conftest import rows


def test_quotes_are_sought_in_every_question_of_the_topic(spark, tmp_path):
    quotes = ["Let the old lock of the town hold nine keys.", "Use it.", "Name the lock ... of the town.", "Count.", "Give every page of the long paper a number."]
    data = [(f"q{i:03}", f"t{i % 2}" if i % 5 else None, f"{quotes[i % 4] if i < 8 else f'Take lock {i} to the far end of the town.'} Then add {i}.", i) for i in range(80)]
    data += [("x1", "t0", quotes[4], 0), ("x2", "t0", f"So: {quotes[4]} And more.", 0), ("x3", "t1", f"Reuse item {quotes[0]}", 0), ("x4", "t1", None, 0), ("x5", None, "", 0)]
    spark.createDataFrame(data, "bank_id string, topic_id string, question string, loaded_at int").write.parquet(str(tmp_path / "generated_questions.parquet"))
    norm = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))

    def stands(quote, text):
        pieces = [p for p in map(norm, quote.split("...")) if p]
        return len(" ".join(pieces).split()) > 1 and re.search(".*".join(map(re.escape, pieces)), norm(text)) is not None

    want = []
    for i, topic, text, _ in data:
        quote = (re.match(r"[^.?!]*[.?!]", text or "") or [""])[0]
        want.append((i, stands(quote, text or ""), any(stands(quote, u or "") for j, t, u, _ in data if j != i and t == topic)))
    assert rows(catalog.queries()["quote_in_source"](spark, str(tmp_path)), "bank_id", "in_own", "in_other") == sorted(want) and sum(w[2] for w in want) > 2
