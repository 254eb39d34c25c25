"""Checking new batches of questions against everything accepted before.

A question is described by its *data*: the numbers and identifiers in it.
Wording changes (typing errors, synonyms, order of sentences, case, marks) leave
the data alone, and other numbers make another question.  Each question has a
128-bit fingerprint of all its data, and one of what is left when a run of up to
``MISSING`` sentences is left out; so a question that lacks a sentence meets the
full one, and a passage taken over from elsewhere meets nothing.  A text with too
little data to tell by is fingerprinted by what it has with samples of its words,
of which two texts that share most words have some in common.

Fingerprints stand in two block tables: the fingerprint, cut into two blocks of 64
bits, is rotated by a block per table, and its leading block is the key.  Two
fingerprints that differ in one bit (``MAX_DISTANCE``) keep one block alike and meet
in one of the tables: the index finds *every* pair up to that distance.  A new
fingerprint is looked up by exact block match only, the Hamming distance is
checked, then the two texts.

``find_repeats`` settles a whole table as one backlog; ``AcceptedStore`` keeps the
accepted questions in sorted runs and looks each batch up by its own blocks.

Hot groups: questions of equal data are one class whose members are compared with
its first; in a bucket of more than ``COMMON`` rows all are compared with its first,
and the others are paired by their rarer words (an exact split).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursewright.llm.runs import SortedRuns
from coursewright.session import apart, cut, sized

#: Bits in which two fingerprints may differ to go on to the texts; the tables cover this distance whole.
MAX_DISTANCE = 1
#: The size of a bucket beyond which its rows are paired by their words.
COMMON = 64
#: Sentences with data that may be missing in a row.
MISSING = 2
#: Samples of a text's words, and words in each: of texts without data, and of those with too little.
SAMPLES, SAMPLES_THIN = (12, 3), (6, 2)
#: Least information, in bits, of the data that makes a fingerprint of its own.
LEAST_BITS = 18.0
#: Least share of the shorter text's words found in the other: with equal data, and with a sentence missing.
WORDS_EQUAL, WORDS_PART, WORDS_ALONE, WORDS_NO_DATA = 0.35, 0.45, 0.8, 0.8

# Words left out of the comparison of wordings.
STOP_WORDS = frozenset("a an the of to in on at by for from and or is are be been was were it its that this which with as each one".split())

_DECORATION = re.compile(r"[\[(]\s*\d+(?:\.\d+)?\s*(?:m|marks?|pts?|points?)\s*[\])]", re.I)
_NUMBERED = re.compile(r"^\W*(?:(?:q|que|ques|question|task|problem|exercise|ex|no)\W*\d{1,3}|\d{1,3})\s*[.:)\]]\W*(?=\w)", re.I)
_THOUSANDS = re.compile(r"(?<![\d,])\d{1,3}(?:,\d{3})+(?![\d,])")
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.?!;:])\s+|\n+")
_DIGIT = re.compile(r"\d")
_WITH_DIGIT = re.compile(r"\w*\d\w*")


def plain(text: str) -> str:
    """The text without its number, its marks and thousands separators."""
    text = _NUMBERED.sub("", text)
    text = _DECORATION.sub(" ", text)
    return _THOUSANDS.sub(lambda m: m.group().replace(",", ""), text)


def _words(text: str) -> list[str]:
    return [w for w in (x.strip("_") for x in _WORD.findall(text)) if w]


def data_of(text: str) -> list[str]:
    """Numbers and identifiers in order, lower case."""
    return [w.lower() for w in _words(plain(text)) if _DIGIT.search(w)]


def _bits(token: str) -> float:
    if token.isdigit():
        return max(3.3, math.log2(int(token[:9]) + 1)) if len(token) < 10 else 30.0
    return 18.0 if _DIGIT.search(token) else 12.0


def _data(text: str) -> list[str]:
    return [w.strip("_") for w in _WITH_DIGIT.findall(text.lower())]


def _say(text: str) -> list[str]:
    return [w for w in _words(text.lower()) if w not in STOP_WORDS and not _DIGIT.search(w)]


_DRAWS = np.array([xxhash.xxh64_intdigest(f"draw {i}") | 1 for i in range(SAMPLES[0])], dtype=np.uint64)


def samples_of(tokens: list[str], draws: int, size: int) -> list[list[str]]:
    """The ``size`` different tokens that come first in each of ``draws`` random orders."""
    every = sorted(set(tokens))
    if len(every) <= size:
        return [every] if every else []
    mixed = np.array([xxhash.xxh64_intdigest(t) for t in every], dtype=np.uint64)[None, :] * _DRAWS[:draws, None]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return [[every[i] for i in row] for row in np.argpartition(mixed, size - 1, axis=1)[:, :size].tolist()]


@lru_cache(maxsize=100_000)
def _signs(token: str) -> np.ndarray:
    """128 numbers, 1 or -1: the bits of a token's hash."""
    return np.unpackbits(np.frombuffer(xxhash.xxh3_128_digest(token), np.uint8)).astype(np.int32) * 2 - 1


def _thin_features(sentences: list[str], data: list[str]) -> list[list[str]]:
    """Token lists by which a text with too little data is known."""
    return [data + s for s in samples_of([w for s in sentences for w in _say(s)], *(SAMPLES_THIN if data else SAMPLES))]


def prints_of(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The key of texts alike in data (or, with too little of it, in words), the fingerprints (two numbers a row) of the whole and those of what is left without a run of sentences.

    A fingerprint's bit is the majority of the tokens' bits.
    """
    body = plain(text)
    sentences = _SENTENCE.split(body)
    data = [_data(s) for s in sentences]
    flat = [w for s in data for w in s]
    bits = list(accumulate((sum(map(_bits, s)) for s in data), initial=0.0))
    rich = bits[-1] >= LEAST_BITS
    whole, rests, sampled = [], [], []
    if rich:
        key = "d" + xxhash.xxh3_128_hexdigest(" ".join(sorted(flat)))
        counts = list(accumulate(map(len, data), initial=0))
        upto = np.concatenate([np.zeros((1, 128), np.int32), np.array([_signs(w) for w in flat]).cumsum(axis=0, dtype=np.int32)])[counts]
        whole.append(upto[-1])
    else:
        key = "w" + xxhash.xxh3_128_hexdigest(" ".join(_words(body.lower())) or text)
        whole += [sum(map(_signs, f)) for f in _thin_features(sentences, flat) or [[text]]]
    holds = [i for i, s in enumerate(data) if s]
    for i in range(len(holds)):
        for j in range(i, min(i + MISSING, len(holds))):
            if j - i + 1 < len(holds):
                a, b = holds[i], holds[j] + 1
                if rich and bits[-1] - (bits[b] - bits[a]) >= LEAST_BITS:
                    rests.append(upto[-1] - (upto[b] - upto[a]))
                else:  # what lacks these has too little data
                    without = [s for k, s in enumerate(sentences) if not (a <= k < b and data[k])]
                    sampled += _thin_features(without, [w for k, s in enumerate(data) if not a <= k < b for w in s])
    rests += [sum(map(_signs, f)) for f in sampled]
    return key, _pack(whole), _pack(rests)


def _pack(sums: list[np.ndarray]) -> np.ndarray:
    both = np.packbits(np.array(sums).reshape(-1, 128) > 0, axis=1).view(np.int64).tolist()
    return np.array(sorted(set(map(tuple, both))), dtype=np.int64).reshape(-1, 2)


def same_task(a: str, b: str) -> bool:
    """Whether two texts set the same task with the same data; in one of them a sentence may be missing."""
    words_a, words_b = _words(plain(a).lower()), _words(plain(b).lower())
    data_a, data_b = [w for w in words_a if _DIGIT.search(w)], [w for w in words_b if _DIGIT.search(w)]
    say_a = Counter(w for w in words_a if not _DIGIT.search(w) and w not in STOP_WORDS)
    say_b = Counter(w for w in words_b if not _DIGIT.search(w) and w not in STOP_WORDS)
    common = (say_a & say_b).total()
    less, more = sorted((say_a.total(), say_b.total()))
    if not data_a and not data_b:
        return a == b or (more > 0 and common / more >= WORDS_NO_DATA)
    count_a, count_b = Counter(data_a), Counter(data_b)
    only_a, only_b = count_a - count_b, count_b - count_a
    share = common / less if less else 1.0
    if not only_a and not only_b:
        return share >= WORDS_EQUAL
    if only_a and only_b:
        return False
    full, missing = (data_a, only_a) if only_a else (data_b, only_b)
    n = missing.total()
    if n == len(full):
        return False
    if not any(Counter(full[i : i + n]) == missing for i in range(len(full) - n + 1)):
        return False
    kept = list((count_a & count_b).elements())
    return share >= (WORDS_PART if len(kept) > 1 and sum(map(_bits, kept)) >= LEAST_BITS else WORDS_ALONE)


# ---- Spark

ORD = T.StructType([T.StructField("batch", T.IntegerType()), T.StructField("created", T.StringType()), T.StructField("id", T.StringType())])
PRINT = T.StructType([T.StructField("high", T.LongType()), T.StructField("low", T.LongType()), T.StructField("whole", T.BooleanType())])
BLOCK = T.StructType([T.StructField("key", T.LongType()), T.StructField("high", T.LongType()), T.StructField("low", T.LongType()), T.StructField("whole", T.BooleanType()), T.StructField("ord", ORD)])
TEXT = T.StructType([T.StructField("key", T.LongType()), T.StructField("id", T.StringType()), T.StructField("text", T.StringType())])


def arrivals(bank: DataFrame) -> DataFrame:
    """``id, ord, text`` of the questions in order of arrival (batch, created, id).

    Rows of one id are one question: its earliest batch and the text it then had
    (ties: the latest ``loaded_at``).  Null ids, null and blank texts are left out;
    a null batch or time counts as the earliest.
    """
    rows = bank.filter(F.col("bank_id").isNotNull() & (F.trim(F.coalesce("question", F.lit(""))) != ""))
    batch, created = F.coalesce(F.col("batch_no").cast("int"), F.lit(-1)), F.coalesce("created", F.lit(""))
    first = rows.groupBy("bank_id").agg(F.min(F.struct(batch.alias("batch"), created.alias("created"))).alias("o"), F.max_by("question", F.struct(-batch, F.col("loaded_at"), F.col("question"))).alias("text"))
    return first.select(F.col("bank_id").alias("id"), F.struct(F.col("o.batch").alias("batch"), F.col("o.created").alias("created"), F.col("bank_id").alias("id")).alias("ord"), "text")


def describe(questions: DataFrame) -> DataFrame:
    """``id, ord, text, same, prints``: the key of the exact data and the fingerprints."""
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("ord", ORD), T.StructField("text", T.StringType()), T.StructField("same", T.StringType()), T.StructField("prints", T.ArrayType(PRINT))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, prints, whole, offsets = [], [], [], [0]
            for t in batch.column(2).to_pylist():
                key, wholes, rests = prints_of(t)
                keys.append(key)
                prints += (wholes, rests)
                whole += (np.ones(len(wholes), bool), np.zeros(len(rests), bool))
                offsets.append(offsets[-1] + len(wholes) + len(rests))
            both = np.concatenate(prints) if prints else np.empty((0, 2), np.int64)
            flat = pa.StructArray.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(np.concatenate(whole) if whole else np.empty(0, bool))], names=PRINT.names)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(keys, pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], names=schema.names)

    return questions.select("id", "ord", "text").mapInArrow(run, schema)


def block_rows(described: DataFrame) -> DataFrame:
    """``key, high, low, whole, ord``: each fingerprint in both block tables, the key being the leading block with the table's number in its last bit."""
    prints = described.select("ord", F.explode("prints").alias("p"))
    keys = [F.col(f"p.{block}").bitwiseAND(F.lit(-2)) + F.lit(no) for no, block in enumerate(("high", "low"))]
    return prints.select(F.explode(F.array(*keys)).alias("key"), "p.high", "p.low", "p.whole", "ord")


Texts = Callable[[DataFrame], DataFrame]


def verify(pairs: DataFrame, texts_of: Texts) -> DataFrame:
    """The rows of ``pairs`` (``q, other``) whose texts set the same task; ``texts_of`` gives ``id, text`` for given ids."""
    pairs = cut(pairs.select("q", "other"))
    texts = texts_of(pairs.select("q.id").union(pairs.select("other.id")))
    schema = T.StructType([T.StructField("q", ORD), T.StructField("other", ORD)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [same_task(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select(["q", "other"]).filter(pa.array(good, pa.bool_()))

    left, right = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(apart(left), F.col("q.id") == F.col("a")).join(apart(right), F.col("other.id") == F.col("b"))
    return both.select("q", "other", "text_a", "text_b").mapInArrow(run, schema)


def _earlier(a: str, b: str):
    """Whether side ``b`` came before side ``a``; what is stored came before everything new."""
    return F.col(f"{a}.fresh") & (~F.col(f"{b}.fresh") | (F.col(f"{b}.ord") < F.col(f"{a}.ord")))


def _may_repeat(a: str, b: str):
    """One side is a whole question, they are near, and of equal prints only the first table's meeting counts."""
    apart_by = [F.col(f"{a}.{block}").bitwiseXOR(F.col(f"{b}.{block}")) for block in ("high", "low")]
    near = F.bit_count(apart_by[0]) + F.bit_count(apart_by[1]) <= MAX_DISTANCE
    once = (apart_by[0] != 0) | (apart_by[1] != 0) | (F.col(f"{a}.key").bitwiseAND(F.lit(1)) == 0)
    return (F.col(f"{a}.whole") | F.col(f"{b}.whole")) & near & once


def _met(rows: DataFrame) -> DataFrame:
    """The rows (``key, high, low, whole, ord, fresh``) of buckets that can hold a pair, with the bucket's size ``n``."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("whole").alias("w"), F.max("fresh").alias("f")).filter("n > 1 and w and f").select("key", "n")
    return rows.join(apart(sizes), "key")


def _by_words(hot: DataFrame, texts_of: Texts) -> DataFrame:
    """``q, other`` of the pairs within large buckets whose texts may share ``WORDS_EQUAL`` of the shorter one's words.

    Each text's words are put in order of rarity among the texts at hand.  Of a text of n
    words the shorter side of a pair must share one of its first ``n - ceil(share * n) + 1``
    with the other text, so an equality join on bucket and word misses no pair.
    """
    ids = hot.select("ord.id").distinct()
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("word", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                say = Counter(w for w in _words(plain(t).lower()) if not _DIGIT.search(w) and w not in STOP_WORDS)
                every = [f"{w}#{k}" for w, n in say.items() for k in range(n)]
                rows += [(i, len(every), w) for w in [*every, ""]]  # the empty word stands in every text, for texts without words
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], names=schema.names)

    words = cut(ids.join(apart(texts_of(ids)), "id").select("id", "text").mapInArrow(run, schema))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("texts"))
    by_rarity = Window.partitionBy("id").orderBy((F.col("word") == "").cast("int"), "texts", "word")
    ranked = words.join(apart(counts), "word").withColumn("at", F.row_number().over(by_rarity))
    lead = (F.col("at") <= F.col("n") - F.ceil(F.lit(WORDS_EQUAL) * F.col("n") - 1e-9) + 1) & ((F.col("word") != "") | (F.col("n") == 0))
    ranked = ranked.select("id", "word", F.col("n").alias("n_words"), lead.alias("lead"))
    rows = cut(hot.withColumn("id", F.col("ord.id")).join(apart(ranked), "id"))
    a, b = rows.alias("a"), rows.alias("b")
    shorter = (F.col("a.lead") & (F.col("a.n_words") <= F.col("b.n_words"))) | (F.col("b.lead") & (F.col("b.n_words") <= F.col("a.n_words")))
    return a.join(apart(b), ["key", "word"]).filter(_earlier("a", "b") & shorter & _may_repeat("a", "b")).select(F.col("a.ord").alias("q"), F.col("b.ord").alias("other")).distinct()


def _settle(links: DataFrame) -> DataFrame:
    """``q, other``: each rejected question with the first accepted one it repeats.

    ``links``: ``q, other`` from a question to the earlier ones it repeats.  What has
    no link is accepted; what links to an accepted one is rejected, and its own
    links, both ways, are void.  As many rounds as the longest chain of repeats of
    repeats; each is one table.
    """
    every = links = cut(links)
    fallen = []
    while not links.isEmpty():
        waiting = links.select(F.col("q").alias("other")).distinct()
        fell = cut(links.join(apart(waiting), "other", "left_anti").groupBy("q").agg(F.min("other").alias("other")))
        fallen.append(fell)
        links = cut(links.join(apart(fell.select("q")), "q", "left_anti").join(apart(fell.select(F.col("q").alias("other"))), "other", "left_anti").select("q", "other"))
    if len(fallen) < 2:
        return fallen[0] if fallen else links
    # a question may have fallen to a later one before an earlier one was known to be accepted
    gone = reduce(DataFrame.unionByName, fallen).select(F.col("q").alias("other"))
    return cut(every.join(apart(gone), "other", "left_anti").groupBy("q").agg(F.min("other").alias("other")))


def _follow(followers: DataFrame, fallen: DataFrame, texts_of: Texts) -> tuple[DataFrame, DataFrame]:
    """Rejects ``followers`` (``q, other``: verified repeats of ``other``) with what their ``other`` came to.

    A follower of a rejected question repeats what that one repeats, if the texts
    say so; those of which they don't are returned as the second table (``q``).
    """
    led = cut(followers.join(apart(fallen.select(F.col("q").alias("other"), F.col("other").alias("lead"))), "other", "left"))
    moved = led.filter("lead is not null").select("q", F.col("lead").alias("other"))
    if moved.isEmpty():
        return led.select("q", "other"), moved.select("q")
    through = cut(verify(moved, texts_of))
    return led.filter("lead is null").select("q", "other").unionByName(through), moved.join(apart(through.select("q")), "q", "left_anti").select("q")


def check_against(new: DataFrame, blocks_of: Callable[[DataFrame], DataFrame] | None = None, old_texts: Texts | None = None) -> tuple[DataFrame, DataFrame]:
    """Settles the questions ``new`` (described) against accepted ones and among themselves.

    Returns ``repeats`` (``q, other`` in terms of ``ord``) and what is newly accepted
    (described).  ``blocks_of`` gives the stored block rows of given keys and ``old_texts``
    the stored texts of given ids; without them everything is new.
    """
    new = cut(new)
    mine = new.select("id", "text")

    def texts_of(ids: DataFrame) -> DataFrame:
        ids = cut(ids.distinct())
        found = mine.join(sized(ids), "id", "left_semi")
        return cut(found if old_texts is None else found.unionByName(old_texts(ids)))

    # classes of equal data: the members that repeat their first are settled with it
    several = new.groupBy("same").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("same")
    members = cut(new.join(apart(several), "same").select("same", "ord"))
    firsts = members.groupBy("same").agg(F.min("ord").alias("other"))
    attached = cut(verify(members.join(apart(firsts), "same").filter("ord <> other").select(F.col("ord").alias("q"), "other"), texts_of))
    alone = None  # followers that don't repeat what their first came to: questions of their own from then on
    while True:
        heads = new.select("id", "ord", "prints").join(sized(attached.select(F.col("q.id").alias("id"))), "id", "left_anti")
        rows = block_rows(heads).withColumn("fresh", F.lit(True))
        if blocks_of is not None:
            rows = cut(rows)
            rows = rows.unionByName(blocks_of(rows).withColumn("fresh", F.lit(False)))
        met = cut(_met(rows))
        hot, trailing = met.filter(F.col("n") > COMMON), None
        if not hot.isEmpty():
            # in a large bucket all are compared with its first; those that repeat it are settled with it
            led = hot.groupBy("key").agg(F.min(F.struct("fresh", "ord")).alias("m")).select("key", F.col("m.ord").alias("other"))
            followers = verify(hot.filter("fresh").join(apart(led), "key").filter("ord <> other").select(F.col("ord").alias("q"), "other").distinct(), texts_of)
            one = cut(followers.groupBy("q").agg(F.min("other").alias("other")))
            trailing = one.join(apart(one.select(F.col("q").alias("other"))), "other", "left_anti").select("q", "other")
            trailing = cut(trailing if alone is None else trailing.join(apart(alone), "q", "left_anti"))
            met = cut(met.join(apart(trailing.select(F.col("q").alias("ord"))), "ord", "left_anti"))
            hot = met.filter(F.col("n") > COMMON)
        few = met.filter(F.col("n") <= COMMON)
        a, b = few.alias("a"), few.alias("b")
        pairs = a.join(apart(b), "key").filter(_earlier("a", "b") & _may_repeat("a", "b")).select(F.col("a.ord").alias("q"), F.col("b.ord").alias("other"))
        if trailing is not None:
            pairs = pairs.unionByName(_by_words(hot, texts_of))
        fallen = _settle(verify(pairs.distinct(), texts_of))
        left = []
        for followers in [trailing, attached] if trailing is not None else [attached]:
            more, lost = _follow(followers, fallen, texts_of)
            fallen = cut(fallen.unionByName(more))
            left.append(lost)
        new_alone = cut(left[0] if len(left) == 1 else left[0].unionByName(left[1]))
        if new_alone.isEmpty():
            return fallen, new.join(sized(fallen.select(F.col("q.id").alias("id"))), "id", "left_anti")
        alone = cut(new_alone if alone is None else alone.unionByName(new_alone))
        attached = cut(attached.join(apart(new_alone), "q", "left_anti"))


def find_repeats(bank: DataFrame) -> DataFrame:
    """``bank_id_1, bank_id_2`` (the smaller first) of each question that repeats an accepted one, the whole table as one backlog."""
    repeats, _ = check_against(describe(arrivals(bank)))
    return repeats.select(F.least("q.id", "other.id").alias("bank_id_1"), F.greatest("q.id", "other.id").alias("bank_id_2"))


class AcceptedStore:
    """The accepted questions and their block tables in a folder that all executors share, appended to batch by batch."""

    def __init__(self, spark, path: str, **layout: int):
        self.runs = SortedRuns(spark, path, {"blocks": BLOCK, "texts": TEXT}, **layout)

    def _texts(self, ids: DataFrame) -> DataFrame:
        keys = ids.select("id", F.xxhash64("id").alias("key"))
        return self.runs.lookup("texts", keys).join(apart(keys.select("id").distinct()), "id", "left_semi").select("id", "text")

    def add(self, batch: DataFrame) -> DataFrame:
        """Checks ``batch`` (rows of the question bank), appends what is accepted and returns ``bank_id, repeats``.

        Of the history only row groups that can hold a block of the batch, and the
        texts of questions that met one, are read.  An id that was accepted before isn't
        checked again; what is stored counts as earlier than the whole batch.
        """
        described = describe(arrivals(batch))
        known = bool(self.runs.runs())
        if known:
            described = cut(described)
            described = described.join(apart(self._texts(described.select("id")).select("id")), "id", "left_anti")
        repeats, fresh = check_against(described, *((lambda rows: self.runs.lookup("blocks", rows), self._texts) if known else ()))
        fresh = cut(fresh)
        self.runs.append({"blocks": block_rows(fresh), "texts": fresh.select(F.xxhash64("id").alias("key"), "id", "text")})
        return repeats.select(F.col("q.id").alias("bank_id"), F.col("other.id").alias("repeats"))

    def compact(self) -> None:
        """Merges all runs into one; maintenance that reads everything, never part of ``add``."""
        self.runs.compact()
