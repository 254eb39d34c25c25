import random

from pyspark.sql import functions as F

from coursewright.llm import batches, canonical, spans
from coursewright.session import table
from tests.conftest import SF, rows


def brute(records, least):
    seen = {}
    for rec, text in records:
        for w in {text[i : i + least] for i in range(len(text or "") - least + 1)}:
            seen.setdefault(w, set()).add(rec)
    out = []
    for rec, text in records:
        run = None
        for i in range(len(text or "") - least + 1):
            if len(seen[text[i : i + least]]) > 1:
                if run and i <= run[1]:
                    run[1] = i + least
                else:
                    if run:
                        out.append((rec, run[0] + 1, run[1] - run[0]))
                    run = [i, i + least]
        if run:
            out.append((rec, run[0] + 1, run[1] - run[0]))
    return sorted(out, key=repr)


def test_spans_against_brute_force_with_a_hot_passage(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé🙂") for _ in range(rng.randint(1, 6)))
    passage, second = " ".join(word() for _ in range(12)), " ".join(word() for _ in range(9))
    records = []
    for i in range(120):
        text = " ".join(word() for _ in range(rng.randint(0, 25)))
        if i % 3 == 0:
            text += passage[: rng.randint(25, len(passage))] + word()
        if i % 7 == 0:
            text = second + text
        records.append((i, text))
    records += [(200, passage), (201, passage), (202, "z" * 400), (203, "z" * 90), (204, None), (205, ""), (206, passage + passage)]
    df = spark.createDataFrame(records, "rec long, text string")
    for least, gram, hashes in ((30, 12, 2), (30, 30, 1), (25, 8, 3)):
        assert rows(spans.shared_runs(df, least, gram, hashes)) == brute(records, least)


def test_record_shares(spark):
    df = spark.createDataFrame([(1, "x" * 50), (2, "x" * 50), (3, None)], "rec long, text string")
    runs = spans.shared_runs(df, 20, 10)
    assert rows(spans.record_shares(df, runs)) == [(1, 50, 50, 1.0), (2, 50, 50, 1.0), (3, 0, 0, 0.0)]


LEVELS = [("B1", "Remember", 1, ["Recall"]), ("B3", "Apply", 3, ["Application", "Use"]), ("B4", "Analyze", 4, ["Analysis", "Compare"]), ("B6", "Create", 6, ["Creation", "Design"])]
OUTCOMES = [(f"OSK:CO{i}", "OSK", f"CO{i}", f"C311.{i}") for i in (1, 2, 3, 21)] + [("NET:CO1", "NET", "CO1", "C322.1")]


def labels(spark, typed):
    q = spark.createDataFrame([(str(i), ("question", s, b, c), 0) for i, (s, b, c) in enumerate(typed)], "id string, metadata struct<type:string,subject:string,bloom_level:string,raw_co_code:string>, loaded_at int")
    lv = spark.createDataFrame(LEVELS, "level_id string, bloom_level string, bloom_rank int, other_names array<string>")
    oc = spark.createDataFrame(OUTCOMES, "co_id string, subject string, short_id string, printed_code string")
    return {(int(r.id), r.field): r.ref_id for r in canonical.map_labels(q, lv, oc).collect()}


def test_typed_levels(spark):
    cases = {"Aplly": "B3", "aply level": "B3", "APPLYING": "B3", "Analyse": "B4", "Ana- lyze": "B4", "Cr3ate": "B6", "Crea.": "B6", "L4": "B4", "Level 0": "UNMATCHED", "Apply (L3)": "B3", "Apply (L4)": "UNMATCHED", "use": "B3", "MCQ": "UNMATCHED", "Create/Analyze": "UNMATCHED", "Re\xadmember": "B1", "\xa0Design": "B6", "x" * 50_000: "UNMATCHED"}
    got = labels(spark, [("OSK", k, None) for k in cases] + [("OSK", "Apply", None), ("OSK", "  ", None), ("OSK", "\xa0", None)])
    assert {k: got[i, "bloom_level"] for i, k in enumerate(cases)} == cases and len(got) == len(cases)


def test_typed_codes(spark):
    cases = {"co 2": "OSK:CO2", "C03": "OSK:CO3", "CQ1": "OSK:CO1", "CO II": "OSK:CO2", "CO-three": "OSK:CO3", "Course outcome no. 2": "OSK:CO2", "C3l1.2": "OSK:CO2", "C311,3": "OSK:CO3", "311.1": "OSK:CO1", "C311/CO2": "OSK:CO2", "CO1 [3 M]": "OSK:CO1", "CO2 - Create level": "OSK:CO2", "CO２": "OSK:CO2", "CO1, CO2": "UNMATCHED", "CO9": "UNMATCHED", "C322.1": "UNMATCHED", "PO1": "UNMATCHED", "CO": "UNMATCHED", "C311.8": "UNMATCHED", "CO11": "UNMATCHED", "C.O. 2": "OSK:CO2", "CO#3": "OSK:CO3", "[CO2]": "OSK:CO2", "C311. 1": "OSK:CO1", "C311 2": "OSK:CO2", "C311.03": "OSK:CO3", "CO 21": "OSK:CO21", "CO XXI": "OSK:CO21", "Outcome twenty-one": "OSK:CO21", "Cuorse outcome 3": "OSK:CO3", "PSO-2": "UNMATCHED", "Unit 3": "UNMATCHED", "CO IV": "UNMATCHED", "CO1,2": "UNMATCHED", "C31.11": "UNMATCHED", "C0-2": "OSK:CO2"}
    got = labels(spark, [("OSK", None, k) for k in cases] + [("OSK", None, "CO1"), ("OSK", None, "C311.1"), ("OSK", None, None), (None, None, "CO1")])
    assert {k: got[i, "raw_co_code"] for i, k in enumerate(cases)} == cases
    assert got[len(cases) + 3, "raw_co_code"] == "UNMATCHED" and len(got) == len(cases) + 1


def test_pigeonhole_finds_all_within_k(spark):
    rng = random.Random(1)
    forms = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 9))) for _ in range(40)]
    keys = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 10))) for _ in range(150)]
    f = spark.createDataFrame([("", x, x, 2 if len(x) >= 5 else 1 if len(x) == 4 else 0, True) for x in set(forms)], "scope string, form string, ref_id string, k int, loose boolean")
    k = spark.createDataFrame([("", x) for x in set(keys)], "scope string, key string")
    every = k.join(f, F.levenshtein("key", "form") <= F.col("k")).select("key", "ref_id").distinct()
    assert rows(canonical.pigeonhole_matches(k, f).select("key", "ref_id")) == rows(every)


def bank(spark, rows_):
    return spark.createDataFrame([(i, b, c, q, 0) for i, b, c, q in rows_], "bank_id string, batch_no int, created string, question string, loaded_at int")


BASE = "The town of Pelmor numbers its pages from 4461 to 4892, each with a busy clock. Trace fum17 for the input 39, 582, 7411 and name the value of gil28. Is a strict frame with 2213 keys enough for Zanvitin?"


def test_same_task():
    yes = [BASE.lower(), BASE.replace("Trace", "Follow").replace("busy", "buys"), "Q6. " + BASE, BASE + " (4 marks)", BASE.replace(",", ""), " ".join(reversed(BASE.split(". "))), BASE.replace(" Is a strict frame with 2213 keys enough for Zanvitin?", "")]
    no = [BASE.replace("4461", "4462"), BASE.replace("fum17", "fum18"), "Describe " + BASE.split(". ")[1] + " and 17 others of 99.", "The town of Pelmor numbers its pages."]
    assert all(batches.same_task(BASE, x) for x in yes) and not any(batches.same_task(BASE, x) for x in no)


def test_repeats_whole_and_by_batches_agree(spark, tmp_path):
    hot = " Let tor18 be a device of size 3429 whose mailbox costs 63 weeks."
    rng = random.Random(2)
    rows_ = []
    for i in range(60):
        n = [rng.randint(100, 9999) for _ in range(8)]
        text = f"A lock named Zan{i}dor holds {n[0]} keys and {n[1]} doors. Count the pages after {n[2]} steps of {n[3]} rounds. Give the frame number {n[4]} and {n[5]} of {n[6]}." + (hot if i % 3 == 0 else "")
        rows_.append((f"q{i:03}", i // 15 + 1, f"{i:03}", text))
        if i % 10 == 0:
            rows_.append((f"r{i:03}", i // 15 + 2, "999", text.replace("Count", "Find").replace("holds", "hollds")))
            rows_.append((f"s{i:03}", i // 15 + 2, "998", text.upper()))
    rows_ += [("n1", 1, "0", None), ("n2", 1, "0", ""), ("t1", 1, "1", "Define a lock."), ("t2", 2, "1", "Define a lock."), ("q000", 4, "0", "sent again")]
    whole = rows(batches.find_repeats(bank(spark, rows_)))
    want = sorted({tuple(sorted((f"{p}{i:03}", f"q{i:03}"))) for i in range(0, 60, 10) for p in "rs"} | {("t1", "t2")})
    assert whole == want
    store = batches.AcceptedStore(spark, str(tmp_path / "store"))
    step = []
    for b in sorted({r[1] for r in rows_}):
        step += [tuple(sorted((r.bank_id, r.repeats))) for r in store.add(bank(spark, [r for r in rows_ if r[1] == b])).collect()]
    assert sorted(step) == want


def test_whole_table_equals_comparison_by_shared_numbers(spark):
    found = rows(batches.find_repeats(table(spark, SF, "generated_questions")))
    texts = sorted((r.ord, r.id, r.text) for r in batches.arrivals(table(spark, SF, "generated_questions")).collect())
    accepted, want = [], []
    for _, i, t in texts:
        hit = next((j for j, u in accepted if batches.same_task(t, u)), None)
        if hit:
            want.append(tuple(sorted((i, hit))))
        else:
            accepted.append((i, t))
    assert found == sorted(want)


def test_a_sentence_between_thin_ones_takes_no_lookups_from_shared_ones(spark):
    shared, thin, more = "Trace fum17 for the input 3951, 5820 and 7411 of gil28 and zor45.", "Use 7 keys.", "Take 9 steps."
    own = "The town of Pelmor numbers its pages from 4461 to 4892 and from 6013 to 7177 and from 8123 to 9199, with 5318 in red and 2644 in blue."
    rows_ = [("a", 1, "0", f"{shared} {thin} {more}"), ("b", 2, "0", f"{shared} {thin} {own} {more}"), ("c", 1, "1", f"{shared} Count 9342 frames and 4419 locks.")]
    assert rows(batches.find_repeats(bank(spark, rows_))) == [("a", "b")]


def test_repeats_that_share_only_passages_of_very_many_questions(spark):
    hot = ["Let tor18 be a device of size 3429 whose mailbox costs 63 weeks.", "Trace fum17 for the input 3951, 5820 and 7411 of gil28."]
    own = "The town of Pelmor numbers its pages from 4461 to 4892 and from 6013 to 7177."
    rng = random.Random(3)
    rows_ = [(f"q{i:03}", 1, f"{i:03}", f"{hot[i % 2]} A lock holds {rng.randint(1000, 9999)} keys, {rng.randint(1000, 9999)} doors and {rng.randint(1000, 9999)} frames.") for i in range(2 * batches.COMMON + 20)]
    rows_ += [("a", 2, "0", " ".join(hot)), ("b", 3, "0", " ".join([*hot, own])), ("c", 2, "1", f"{own} Count 9342 frames and 4419 locks.")]
    texts = sorted((b, c, i, q) for i, b, c, q in rows_)
    accepted, want = [], []
    for *_, i, t in texts:
        hit = next((j for j, u in accepted if batches.same_task(t, u)), None)
        want += [tuple(sorted((i, hit)))] if hit else []
        accepted += [] if hit else [(i, t)]
    assert ("a", "b") in want and rows(batches.find_repeats(bank(spark, rows_))) == sorted(want)


def greedy(rows_):
    """The pairs by the rule itself: every question against all accepted before it."""
    accepted, want = [], []
    for *_, i, t in sorted((b, c, i, q) for i, b, c, q in rows_ if q):
        hit = next((j for j, u in accepted if batches.same_task(t, u)), None)
        want += [tuple(sorted((i, hit)))] if hit else []
        accepted += [] if hit else [(i, t)]
    return sorted(want)


WORDS = "stack queue heap tree graph list array table index cache page frame lock thread process signal packet router switch socket kernel driver parser lexer token symbol scope closure pointer buffer stream block".split()


def test_recall_of_questions_without_data(spark):
    """One word of each changed, put in or left out: nine in ten repeats at least must be met."""
    rng = random.Random(11)
    rows_, pairs = [], 0
    for i in range(150):
        words = rng.sample(WORDS, rng.randint(8, 14))
        rows_.append((f"a{i:03}", 1, f"{i:03}", f"Explain why a {' '.join(words[:4])} may {' '.join(words[4:])}."))
        k = rng.randrange(len(words))
        changed = words[:k] + ["wholly"] + words[k + (i % 3 > 0) :] if i % 3 < 2 else words[:k] + words[k + 1 :]
        rows_.append((f"b{i:03}", 2, f"{i:03}", f"Explain why a {' '.join(changed[:4])} may {' '.join(changed[4:])}."))
        pairs += batches.same_task(rows_[-1][3], rows_[-2][3])
    want = greedy(rows_)
    found = rows(batches.find_repeats(bank(spark, rows_)))
    assert pairs > 120 and len(set(found) & set(want)) >= 0.9 * len(want) and set(found) <= set(want)


def test_one_differing_bit_is_met_wherever_it_stands(spark):
    prints = [(1, 2)] + [((1 ^ (1 << b)) if b < 63 else 1 - 2**63, 2) for b in range(64)] + [(1, (2 ^ (1 << b)) if b < 63 else 2 - 2**63) for b in range(64)]
    df = spark.createDataFrame([((1, "", f"{i:03}"), [(h, l, True)]) for i, (h, l) in enumerate(prints)], "ord struct<batch:int,created:string,id:string>, prints array<struct<high:long,low:long,whole:boolean>>")
    a, b = (batches.block_rows(df).withColumn("fresh", F.lit(True)).alias(x) for x in "ab")
    met = a.join(b, "key").filter(batches._earlier("a", "b") & batches._may_repeat("a", "b") & (F.col("b.ord.id") == "000")).select("a.ord.id").distinct()
    assert met.count() == 128


def test_variants_of_one_question_in_a_third_of_all_rows(spark):
    """A hot class (equal data) and a hot bucket (texts without data), both far over the bucket limit."""
    rng = random.Random(4)
    n = 3 * batches.COMMON
    rows_ = [(f"h{i:03}", 1 + i % 3, f"{i:03}", BASE.replace("busy", rng.choice(WORDS)).replace("Trace", rng.choice(["Find", "Follow"]))) for i in range(n)]
    rows_ += [(f"w{i:03}", 1 + i % 3, f"{i:03}", f"Explain why a {rng.choice(WORDS)} must not lose its owner when the clerk of a town resets every bell.") for i in range(n)]
    rows_ += [(f"d{i:03}", 1 + i % 3, f"{i:03}", f"{rng.choice(WORDS)} {rng.choice(WORDS)} {rng.choice(WORDS)} {rng.choice(WORDS)} 7461 4899 fum27") for i in range(n)]
    assert rows(batches.find_repeats(bank(spark, rows_))) == greedy(rows_)


def test_a_lookup_reads_alike_however_long_the_history(spark, tmp_path):
    rng = random.Random(6)
    text = lambda: f"A lock named fum{rng.randint(10, 99)} holds {rng.randint(100, 99999)} keys and {rng.randint(100, 99999)} doors. Count the pages after {rng.randint(100, 99999)} steps of {rng.randint(100, 99999)} rounds. Give frame {rng.randint(100, 99999)}."
    store = batches.AcceptedStore(spark, str(tmp_path / "store"), parts=4, group_rows=16)
    read = []
    for step in range(3):
        big = [(f"s{step}q{i:05}", 2 * step, f"{i:05}", text()) for i in range(1500)]
        store.add(bank(spark, big))
        store.compact()
        before = store.runs.rows_read.value
        probe = [(f"s{step}p{i}", 2 * step + 1, f"{i}", big[i][3].replace("Count", "Find")) for i in range(2)]
        assert rows(store.add(bank(spark, probe))) == [(f"s{step}p{i}", f"s{step}q{i:05}") for i in range(2)]
        read.append(store.runs.rows_read.value - before)
    assert read[2] < 1.5 * read[0], read
    assert len(store.runs.runs()) == 2
    assert rows(store.add(bank(spark, [("late", 9, "0", big[7][3])]))) == [("late", "s2q00007")]


def test_a_broken_append_leaves_nothing_that_is_read(spark, tmp_path):
    store = batches.AcceptedStore(spark, str(tmp_path / "store"))
    store.add(bank(spark, [("a", 1, "0", BASE)]))
    broken = batches.describe(batches.arrivals(bank(spark, [("x", 2, "0", "Define a lock.")])))
    batches.block_rows(broken).withColumn("part", F.lit(0)).write.partitionBy("part").parquet(f"{store.runs.path}/00000001-00000001/blocks")  # no marker follows
    assert rows(store.add(bank(spark, [("b", 3, "0", BASE.lower()), ("c", 3, "1", "Define a lock.")]))) == [("b", "a")]


def test_batches_through_the_store_equal_one_backlog(spark):
    from coursewright.llm import queries

    assert rows(queries.p4_batches(spark, SF)) == rows(queries.p4_found(spark, SF))


def test_periodic_text_has_few_windows():
    import numpy as np

    dashes = np.zeros(200_000, np.uint64)
    assert spans.compact_windows(dashes, 51) == [(0, 0, 199_999)]
    wave = np.tile(np.arange(7, dtype=np.uint64), 10_000)
    assert len(spans.compact_windows(wave, 51)) == 1
    rng = np.random.default_rng(3)
    noise = rng.integers(0, 40, 2_000).astype(np.uint64)  # many equal minima
    windows = spans.compact_windows(noise, 20)
    for i in range(len(noise) - 20):  # every run of twenty lies in a window of its least token
        m = noise[i : i + 20].min()
        assert any(a <= i and i + 19 <= b and noise[c] == m for a, c, b in windows)
    assert len(windows) < 2 * len(noise) / 20 * 3


def test_lookups_over_merged_and_single_runs(spark, tmp_path):
    from pyspark.sql import types as T

    from coursewright.llm.runs import SortedRuns

    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("o", T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())]))])
    runs = SortedRuns(spark, str(tmp_path / "runs"), {"t": schema}, parts=1, group_rows=3)
    for n in range(6):
        df = spark.range(n * 10, n * 10 + 10).select(F.col("id").alias("key"), F.struct(F.lit(n).alias("a"), F.lit("x").alias("b")).alias("o"))
        runs.append({"t": df if n % 2 else df.withColumn("key", F.when(F.col("key") >= 0, F.col("key")))})
    assert len(runs.runs()) == 3  # four merged, two single
    keys = spark.createDataFrame([(k,) for k in (0, 5, 17, 33, 41, 59, 60, -1, 5)], "key long")
    assert rows(runs.lookup("t", keys), "key", "o.a") == [(0, 0), (17, 1), (33, 3), (41, 4), (5, 0), (59, 5)]
