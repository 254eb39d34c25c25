"""Operators over ordered lines, pages and sections, by windows within one document.

Every window is partitioned by the document's key: a document is bounded, and
so is the work of a partition.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coursewright.functions.text import TOKENS_PER_PIECE, margin_key


def lines_of(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, line_no, line``: a row per line, numbered from 1; null texts give none."""
    return df.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("p", "line")).select(key, (F.col("p") + 1).alias("line_no"), "line")


def carry_forward(df: DataFrame, group: str, order: str, value: Column, reset: Column, inherit: Column, out: str) -> DataFrame:
    """``value`` where it is set; where it isn't, the last one in the same stretch, if ``inherit``; a row with ``reset`` has none and starts a new stretch."""
    w = Window.partitionBy(group).orderBy(order)
    seg = df.withColumn("_v", F.when(~reset, value)).withColumn("_seg", F.sum(reset.cast("int")).over(w))
    # a row that is neither set nor inherits clears what comes after it
    seg = seg.withColumn("_seg", F.col("_seg") + F.sum((F.col("_v").isNull() & ~inherit & ~reset).cast("int")).over(w))
    last = F.last("_v", ignorenulls=True).over(Window.partitionBy(group, "_seg").orderBy(order))
    return seg.withColumn(out, F.when(reset, None).otherwise(last)).drop("_v", "_seg")


def running_keys(lines: DataFrame, document: str, page: str, least: int = 3) -> DataFrame:
    """``document, margin_key, pages``: margin lines that return on ``least`` pages or more, numbers masked. ``lines`` holds the margin lines."""
    keyed = lines.withColumn("margin_key", margin_key(F.col("line"))).filter(F.col("margin_key") != "")
    return keyed.groupBy(document, "margin_key").agg(F.count_distinct(page).alias("pages")).filter(F.col("pages") >= least)


def drop_runs(lines: DataFrame, key: str, is_label: Column, least: int = 5) -> DataFrame:
    """The lines without runs of ``least`` or more consecutive ones that satisfy ``is_label`` (gaps and islands)."""
    w = Window.partitionBy(key).orderBy("line_no")
    marked = lines.withColumn("_l", F.coalesce(is_label, F.lit(False)))
    island = marked.withColumn("_i", F.row_number().over(w) - F.row_number().over(Window.partitionBy(key, "_l").orderBy("line_no")))
    sized = island.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key, "_l", "_i")))
    return sized.filter(~F.col("_l") | (F.col("_n") < least)).drop("_l", "_i", "_n")


def drop_contents(lines: DataFrame, key: str, leader: str, number: str, outline: str) -> DataFrame:
    """The lines without dotted contents lines, a page number right after one, and chapter outlines."""
    w = Window.partitionBy(key).orderBy("line_no")
    t = F.trim("line")
    marked = lines.withColumn("_lead", t.rlike(leader)).withColumn("_after", F.coalesce(F.lag("_lead").over(w), F.lit(False)))
    return marked.filter(~F.col("_lead") & ~(t.rlike(number) & F.col("_after")) & ~t.rlike(outline)).drop("_lead", "_after")


def cut_at_first(lines: DataFrame, key: str, hit: Column) -> DataFrame:
    """The lines before the first that satisfies ``hit``."""
    first = F.min(F.when(hit, F.col("line_no"))).over(Window.partitionBy(key))
    return lines.withColumn("_first", first).filter(F.col("_first").isNull() | (F.col("line_no") < F.col("_first"))).drop("_first")


def back_matter_hit(line: str = "line", key: str = "doc_id") -> Column:
    """Whether a heading starts a reference list (a citation follows within three solid lines, a year within six) or notes (a paragraph follows)."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(1, 7)
    after = F.filter(F.collect_list(F.trim(line)).over(w), lambda x: x != "")
    head = F.lower(F.regexp_extract(F.trim(line), r"(?i)^(?:[0-9]+(?:\.[0-9]+)*\s+)?(references|bibliography|further reading|acknowledge?ments?|chapter notes)\s*$", 1))
    cited = F.exists(F.slice(after, 1, 3), lambda x: x.rlike(r"^(?:\[[0-9]+\]|[0-9]{1,3}\.\s+[A-Z])")) & F.exists(F.slice(after, 1, 6), lambda x: x.rlike(r"\b(?:1[89]|20)[0-9][0-9]\b"))
    para = (F.length(F.get(after, F.lit(0))) >= 30)
    return (head != "") & ((F.size(after) == 0) | F.when(head.isin("references", "bibliography"), cited).otherwise(F.coalesce(para, F.lit(False))))


def sections_from_starts(entries: DataFrame, key: str, end: Column) -> DataFrame:
    """``key, title, first_page, last_page``: of each page the first title; a section ends before the next begins. ``entries``: ``key, ordinal, title, start, ...``"""
    one = entries.groupBy(key, "start").agg(F.min_by("title", "ordinal").alias("title"), F.max(end).alias("_end"))
    w = Window.partitionBy(key)
    nxt = F.lead("start").over(w.orderBy("start"))
    return one.select(key, "title", F.col("start").alias("first_page"), F.coalesce(nxt - 1, F.max("_end").over(w)).alias("last_page"))


def asof_last(events: DataFrame, marks: DataFrame, key: str, order: str, mark: str) -> DataFrame:
    """Each event with the last mark of its key at or before it; null where there is none."""
    a = events.withColumn("_m", F.lit(None).cast(dict(marks.dtypes)[mark])).withColumn("_k", F.lit(1))
    b = marks.select(key, order, F.col(mark).alias("_m"), F.lit(0).alias("_k"))
    w = Window.partitionBy(key).orderBy(order, "_k").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(f"last_{mark}", F.last("_m", ignorenulls=True).over(w))
    return both.filter("_k = 1").drop("_m", "_k")


_PIECE = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]", re.ASCII)
_CHUNKS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("tokens", T.IntegerType())]))


def _estimate(n_pieces: int) -> int:
    return math.ceil(n_pieces * TOKENS_PER_PIECE)


def _units(line: str, limit: int) -> list[tuple[str, int]]:
    """A line with its estimated tokens; one that is too long in runs of words, each as long as fits."""
    n = len(_PIECE.findall(line))
    if _estimate(n) <= limit:
        return [(line, _estimate(n))]
    out: list[tuple[list[str], int]] = []
    for word in re.split(r"\s+", line, flags=re.ASCII):
        n = len(_PIECE.findall(word))
        if out and _estimate(out[-1][1] + n) <= limit:
            out[-1][0].append(word)
            out[-1] = (out[-1][0], out[-1][1] + n)
        else:
            out.append(([word], n))
    return [(" ".join(words), _estimate(n)) for words, n in out]


def pack_lines(lines: list[str] | None, limit: int, least: int) -> list[dict]:
    """``text, tokens`` of the chunks of a document's lines; one pass over the lines."""
    chunks: list[list[tuple[str, int]]] = []
    total = 0
    for unit in (u for line in lines or [] for u in _units(line, limit)):
        if not chunks or (total > 0 and total + unit[1] > limit):
            chunks.append([])
            total = 0
        chunks[-1].append(unit)
        total += unit[1]
    size = lambda units: sum(t for _, t in units)
    if len(chunks) > 1 and size(chunks[-1]) < least:
        both, n, s = chunks[-2] + chunks[-1], 0, 0
        half = size(both) / 2
        while n < len(both) and (n == 0 or s + both[n][1] <= half):  # as many units as stay within half of both
            s += both[n][1]
            n += 1
        if size(both[n:]) <= limit:
            chunks[-2:] = [both[:n], both[n:]]
    return [{"text": "\n".join(u for u, _ in c), "tokens": size(c)} for c in chunks if c]


def greedy_chunks(lines: DataFrame, key: str, limit: int = 254, least: int = 80) -> DataFrame:
    """``key, chunk_no, text, tokens``: lines packed into chunks of at most ``limit`` estimated tokens, cut only between lines.

    A line that is too long is cut between words first.  A last chunk under
    ``least`` is evened out with the one before, if both parts then fit.  The
    packing is one Arrow pass over a document's lines, linear in its length.
    """
    solid = lines.filter(F.trim("line") != "").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("line_no", F.trim("line").alias("line")))).alias("u"))
    pack = F.udf(lambda found: pack_lines(found, limit, least), _CHUNKS, useArrow=True)
    packed = solid.select(key, F.posexplode(pack(F.transform("u", lambda x: x["line"]))).alias("n", "c"))
    return packed.select(key, (F.col("n") + 1).alias("chunk_no"), "c.text", "c.tokens")
