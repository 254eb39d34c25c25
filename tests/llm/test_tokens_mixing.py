import random

import pytest

from coursewright.llm import mixing, tokens
from coursewright.session import table
from tests.conftest import SF, rows

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def encoder():
    return tokens.encoder_for()


ODD = ["", " ", "\n\n  x", "a" * 3000, "=" * 999, " " * 500 + "x", "<|endoftext|>", "it's we'll I've 12345", "日本語 🙂 👩‍🔬", "\x00\x01", "é" * 50, "don''t '' 'll"]


def test_encoding_equals_the_library(library, encoder):
    rng = random.Random(7)
    parts = ["a", "aa", " ", "\n", "é", "'", "'l", "ll", "==", "9", "\t", "x", "日本", "🙂", "th", "ing", " the"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    for t in texts:
        assert encoder.encode(t) == library.encode(t, add_special_tokens=False).ids
        assert encoder.count(t) == len(encoder.encode(t))


def test_round_trip(encoder):
    for t in ODD:
        assert tokens.decode_bytes(encoder.encode(t), encoder.ranks).decode() == t


def test_appends_and_edits_keep_the_encoding_and_reuse_most_of_it(encoder):
    rng = random.Random(3)
    for _ in range(150):
        e = tokens.EncodedText(encoder, rng.choice(ODD))
        for _ in range(5):
            a = rng.randint(0, len(e.text))
            e.edit(a, min(len(e.text), a + rng.randint(0, 4)), rng.choice(["", "x", "'", " the", "l", "ll", "\n"]))
            assert e.ids() == encoder.encode(e.text)
    e = tokens.EncodedText(encoder, "some words and more " * 500)
    before = e.worked
    e.append("end")
    e.edit(5000, 5001, "Q")
    assert e.ids() == encoder.encode(e.text) and e.worked - before < 60


def test_column_gives_empty_lists_for_null_and_empty(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "hello world", "z"), (3, "hello world", "z")], "doc_id long, text string, ids string")
    out = tokens.encode_column(df.select("doc_id", "text"), ["doc_id"], "text")
    got = rows(out)
    assert got[:2] == [(1, []), (2, [])] and got[2] == got[3] and len(got[2][1]) == 2
    assert rows(tokens.count_column(df, ["doc_id"], "text")) == [(1, 0), (2, 0), (3, 2), (3, 2)]


def sized(spark):
    return spark.createDataFrame([(i, "big" if i < 700 else "small" if i < 730 else None if i < 760 else "other", 10) for i in range(1000)], "doc_id long, source string, n_tokens long")


def targets(spark, *rows_):
    return spark.createDataFrame(list(rows_), "source string, target_share double, max_repeat int")


def test_mixing_reaches_targets_or_the_cap(spark):
    t = targets(spark, ("big", 0.8, 2), ("small", 0.2, 3), ("none", 0.0, 1), (None, 0.1, 1), ("big", 0.8, 2))
    rates = mixing.repetition_rates(mixing.source_totals(sized(spark)), t)
    by = {r.source: r for r in rates.collect()}
    assert by["big"].rate == pytest.approx(8 / 7) and by["big"].reaches and by["big"].total == 10000
    assert by["small"].rate == 3.0 and not by["small"].reaches
    assert by["none"].tokens == 0 and by["none"].reaches
    assert rows(mixing.short_sources(rates)) == [("small",)]
    mixed = mixing.mixed_set(sized(spark), rates)
    shares = {r.source: r for r in mixing.actual_shares(mixed, rates).collect()}
    assert shares["small"].out_docs == 90 and shares["small"].most_copies == 3
    assert abs(shares["big"].share_of_target_size - 0.8) < 0.03 and shares["big"].most_copies <= 2
    assert mixing.emit_copies(mixed).count() == sum(r.out_docs for r in shares.values())
    again = mixing.mixed_set(sized(spark).repartition(7), rates)
    assert rows(mixed) == rows(again)


def test_mixing_of_nothing(spark):
    rates = mixing.repetition_rates(mixing.source_totals(sized(spark).limit(0)), targets(spark, ("a", 0.5, 2)))
    assert rates.first().wanted == 0 and rates.first().reaches
    assert mixing.mixed_set(sized(spark).limit(0), rates).count() == 0


def test_p7_against_plain_sums(spark, library):
    docs = table(spark, SF, "documents").select("source", "text").collect()
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids) if t else 0
    total = sum(count(d.text) for d in docs)
    want = sorted((t.source,) for t in table(spark, SF, "mix_targets").collect() if t.max_repeat * sum(count(d.text) for d in docs if d.source == t.source) < t.target_share * total)
    from coursewright.llm import queries as Q

    assert rows(Q.queries()["p7_found"](spark, SF)) == want
