"""Long exact spans shared between records, by compact windows over token min-hashes.

A token is a ``gram`` of consecutive characters at one place of a record.  Under a
hash function the subsequences of a record that share their least token form
*compact windows* ``(left, centre, right)``: every run of tokens inside
``left..right`` that holds ``centre`` has it as its minimum.  Splitting at the
minimum (a Cartesian tree over the hashes) lists them; those too short for a span
of ``least`` characters are left out.  Tokens equal to the minimum are one node of
the tree: they make one window and split it at all their places, so a record of
``n`` characters has about ``2 n / least`` windows and periodic text fewer.

A span that stands in two records has the same least token in both, whatever the
hash function; so for *every* one of the hash functions it lies in a window whose
centre token occurs in another record as well.  Windows are grouped by their
centre's hash (no pairs are made), those of one record are kept, and per record
the intervals of all hash functions are intersected.  Only the spans of ``least``
characters inside an intersection are verified: a 128-bit digest of each is
counted by record, and the runs of those found in two records or more are the
result.  A passage in a third of all records costs as many rows as it has
occurrences, never their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursewright.session import apart, cut

#: Characters hashed at a time.
GROUP_CHARS = 1_000_000
#: Odd multipliers of the gram hashes; the number of hash functions is ``hashes``.
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def _scramble(x: np.ndarray, mix: int) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(mix)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gram_hashes(points: np.ndarray, gram: int, mix: int) -> np.ndarray:
    """A hash per gram of code points; built by doubling, so ``log2(gram)`` vector steps."""
    h, size = _scramble(points.astype(np.uint64) + np.uint64(1), mix), 1
    total, done = None, 0
    need = gram
    while need:
        if need & 1:  # append a block of ``size`` to what is there
            block = h[done:]
            total = block if total is None else _scramble(total[: len(block)] * np.uint64(3) + block, mix)
            done += size
        need >>= 1
        if need:
            h = _scramble(h[: len(h) - size] * np.uint64(3) + h[size:], mix)
            size *= 2
    n = len(points) - gram + 1
    return total[:n] if n > 0 else np.empty(0, np.uint64)


def compact_windows(hashes: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """``(left, centre, right)`` of each compact window of at least ``least`` tokens; ``centre`` is the first of equal minima, and every run inside that holds one of them has it as its minimum."""
    out, todo = [], [(0, len(hashes) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a + 1 < least:
            continue
        part = hashes[a : b + 1]
        places = np.flatnonzero(part == part.min())
        out.append((a, a + int(places[0]), b))
        if len(places) == 1:
            c = a + int(places[0])
            todo += ((a, c - 1), (c + 1, b))
            continue
        bounds = np.concatenate([[a - 1], a + places, [b + 1]])
        wide = np.flatnonzero(np.diff(bounds) - 1 >= least)
        todo += zip((bounds[wide] + 1).tolist(), (bounds[wide + 1] - 1).tolist(), strict=True)
    return out


def window_table(records: DataFrame, least: int, gram: int, hashes: int) -> DataFrame:
    """``rec, fn, token, lo, hi``: the window's first and last character (from 0) per record and hash function."""
    schema = T.StructType([records.schema["rec"], *(T.StructField(n, t, False) for n, t in (("fn", T.IntegerType()), ("token", T.LongType()), ("lo", T.IntegerType()), ("hi", T.IntegerType())))])
    tokens = least - gram + 1

    def windows_of(recs: pa.Array, texts: list[str]) -> pa.RecordBatch:
        # the texts of a group are hashed in one go; grams that run over a text's end are never looked at
        points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        take, fn, token, lo, hi = [], [], [], [], []
        for k in range(hashes):
            every = gram_hashes(points, gram, _MIX[k])
            at = 0
            for i, text in enumerate(texts):
                h = every[at : at + len(text) - gram + 1]
                at += len(text)
                for a, c, b in compact_windows(h, tokens):
                    take.append(i)
                    fn.append(k)
                    token.append(h[c])
                    lo.append(a)
                    hi.append(b + gram - 1)
        found = pa.array(np.array(token, dtype=np.uint64).astype(np.int64))
        return pa.RecordBatch.from_arrays([recs.take(pa.array(take, pa.int32())), pa.array(fn, pa.int32()), found, pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, start, size = [], 0, 0
            for i, text in enumerate(batch.column(1).to_pylist()):
                group.append(text)
                size += len(text)
                if size >= GROUP_CHARS:
                    yield windows_of(batch.column(0).slice(start, len(group)), group)
                    group, start, size = [], i + 1, 0
            if group:
                yield windows_of(batch.column(0).slice(start, len(group)), group)

    return records.select("rec", "text").mapInArrow(run, schema)


def _intersections(spans: list[list[tuple[int, int]]], least: int) -> list[tuple[int, int]]:
    """The places where a span of ``least`` may start, under every hash function: intervals of starts, merged."""
    current: list[tuple[int, int]] | None = None
    for one in spans:
        starts = sorted((lo, hi - least + 1) for lo, hi in one)
        merged: list[list[int]] = []
        for a, b in starts:
            if merged and a <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        if current is None:
            current = [(a, b) for a, b in merged]
            continue
        out, i, j = [], 0, 0
        while i < len(current) and j < len(merged):
            a, b = max(current[i][0], merged[j][0]), min(current[i][1], merged[j][1])
            if a <= b:
                out.append((a, b))
            if current[i][1] < merged[j][1]:
                i += 1
            else:
                j += 1
        current = out
    return current or []


def candidate_digests(candidates: DataFrame, least: int, hashes: int) -> DataFrame:
    """``rec, start, d1, d2`` (start from 0): digests of the spans of ``least`` characters that every hash function leaves over.

    ``candidates``: ``rec, text, windows array<struct<fn, lo, hi>>``.
    """
    schema = T.StructType([candidates.schema["rec"], T.StructField("start", T.IntegerType(), False), T.StructField("d1", T.LongType(), False), T.StructField("d2", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            recs, texts, windows = batch.column(0), batch.column(1), batch.column(2)
            take, start, digests = [], [], []
            for i in range(batch.num_rows):
                per: list[list[tuple[int, int]]] = [[] for _ in range(hashes)]
                for w in windows[i].as_py():
                    per[w["fn"]].append((w["lo"], w["hi"]))
                if not all(per):
                    continue
                data = texts[i].as_py().encode("utf-32-le")
                for a, b in _intersections(per, least):
                    for s in range(a, b + 1):
                        take.append(i)
                        start.append(s)
                        digests.append(xxhash.xxh3_128_digest(data[4 * s : 4 * (s + least)]))
                if len(take) > 200_000:
                    yield _digest_batch(recs, take, start, digests, schema.names)
                    take, start, digests = [], [], []
            yield _digest_batch(recs, take, start, digests, schema.names)

    return candidates.select("rec", "text", "windows").mapInArrow(run, schema)


def _digest_batch(recs: pa.Array, take: list[int], start: list[int], digests: list[bytes], names: list[str]) -> pa.RecordBatch:
    both = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([recs.take(pa.array(take, pa.int32())), pa.array(start, pa.int32()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=names)


def _shared_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that occur in two records (numbers) or more; each partition adds up its own before the shuffle."""
    return rows.groupBy(*keys).agg(F.min("rec").alias("a"), F.max("rec").alias("b")).filter("a <> b").select(*keys)


def shared_runs(records: DataFrame, least: int = 100, gram: int = 50, hashes: int = 2) -> DataFrame:
    """``rec, start_pos, n_chars``: the maximal runs of characters that lie in a span of ``least`` characters found in another record.

    ``records``: ``rec`` (any orderable type, unique) and ``text``.  Positions count
    from 1.  A null text, or one shorter than ``least``, shares nothing; records
    of equal text share all of it; a text that repeats only within one record
    shares nothing.  ``gram`` must not exceed ``least``.
    """
    if not 0 < gram <= least or not 0 < hashes <= len(_MIX):
        raise ValueError("gram must be between 1 and least, hashes between 1 and 4")
    long = records.filter(F.length("text") >= least).select("rec", "text")
    # records of exactly equal text are one class: only its smallest record goes on, the others copy its result
    classes = long.withColumn("same", F.sha2("text", 256))
    heads = classes.groupBy("same").agg(F.min(F.struct("rec", "text")).alias("m"), F.count(F.lit(1)).alias("copies"))
    # the written table gives each head a number for good, so that rows of tokens and spans carry no keys
    heads = cut(heads.select(F.monotonically_increasing_id().alias("num"), "m.rec", "m.text", "copies", "same"))
    texts = heads.select(F.col("num").alias("rec"), "text")
    windows = cut(window_table(texts, least, gram, hashes))
    kept = windows.join(apart(_shared_keys(windows, ["fn", "token"])), ["fn", "token"], "left_semi")
    grouped = kept.groupBy("rec").agg(F.collect_list(F.struct("fn", "lo", "hi")).alias("windows"))  # a record's own windows: as many as its length allows
    digests = cut(candidate_digests(texts.join(apart(grouped), "rec"), least, hashes))
    hits = digests.join(apart(_shared_keys(digests, ["d1", "d2"])), ["d1", "d2"], "left_semi").select("rec", "start")
    by_place = Window.partitionBy("rec").orderBy("start")
    marked = hits.withColumn("new", (F.col("start") > F.coalesce(F.lag("start").over(by_place), F.lit(-least - 1)) + least).cast("int"))
    runs = (
        marked.withColumn("run", F.sum("new").over(by_place))
        .groupBy("rec", "run")
        .agg((F.min("start") + 1).alias("start_pos"), (F.max("start") - F.min("start") + least).alias("n_chars"))
        .select(F.col("rec").alias("num"), "start_pos", "n_chars")
    )
    alone = heads.filter("copies = 1").select("num", "rec")
    copied = classes.select("rec", "same", F.length("text").alias("n")).join(apart(heads.filter("copies > 1").select("same")), "same", "left_semi")
    return runs.join(apart(alone), "num").select("rec", "start_pos", "n_chars").unionByName(copied.select("rec", F.lit(1).alias("start_pos"), F.col("n").alias("n_chars")))


def record_shares(records: DataFrame, runs: DataFrame) -> DataFrame:
    """``rec, n_chars, shared_chars, share`` of every record; 0 for null, empty and unshared texts."""
    sums = runs.groupBy("rec").agg(F.sum("n_chars").alias("shared_chars"))
    n = F.coalesce(F.length("text"), F.lit(0))
    shared = F.coalesce("shared_chars", F.lit(0).cast("long"))
    return records.join(apart(sums), "rec", "left").select("rec", n.alias("n_chars"), shared.alias("shared_chars"), F.when(n > 0, F.round(shared / n, 6)).otherwise(F.lit(0.0)).alias("share"))


def question_records(pyq: DataFrame, bank: DataFrame) -> DataFrame:
    """``rec struct<tab, rec_id>, text`` of the distinct questions of both tables; of an id sent again the latest row counts, null ids are left out."""
    a = pyq.filter((F.col("metadata.type") == "question") & F.col("id").isNotNull()).select(F.lit("pyq_questions").alias("tab"), F.col("id").alias("rec_id"), F.col("document").alias("text"), "loaded_at")
    b = bank.filter((F.col("question") != "") & F.col("bank_id").isNotNull()).select(F.lit("generated_questions").alias("tab"), F.col("bank_id").alias("rec_id"), F.col("question").alias("text"), "loaded_at")
    latest = a.unionByName(b).groupBy("tab", "rec_id").agg(F.max(F.struct("loaded_at", "text")).alias("m"))
    return latest.select(F.struct("tab", "rec_id").alias("rec"), F.col("m.text").alias("text"))
