"""Lines with their layout: running lines in margins, sections by type, glyphs of fonts.

A ``lines`` table has ``doc, page_id, line_no, text`` and, where an operator says so,
``size, bold`` or ``font``; a decoder of page files or a layout model delivers it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coursewright.session import apart


def repeated_margins(lines: DataFrame, edge: int = 3, share: float = 0.5) -> DataFrame:
    """``doc, key, pages`` of the lines that stand within ``edge`` solid lines of the top or bottom on ``share`` of a document's pages, two at least.

    Lines are compared in lower case with blanks narrowed, figures as they stand.
    A document of one page has none; null texts and blank lines don't count.
    """
    solid = lines.filter(F.trim("text") != "")
    place = Window.partitionBy("page_id").orderBy("line_no")
    n = F.count(F.lit(1)).over(Window.partitionBy("page_id"))
    up = F.row_number().over(place)
    placed = solid.select("doc", "page_id", "text", up.alias("up"), n.alias("n")).filter((F.col("up") <= edge) | (F.col("n") - F.col("up") < edge))
    key = F.lower(F.trim(F.regexp_replace("text", r"[ \t\r\n]+", " ")))
    counts = placed.groupBy("doc", key.alias("key")).agg(F.count_distinct("page_id").alias("pages"))
    sizes = solid.groupBy("doc").agg(F.count_distinct("page_id").alias("all_pages")).filter("all_pages > 1")
    return counts.join(apart(sizes), "doc").filter(F.col("pages") >= F.greatest(F.lit(2), F.floor(F.col("all_pages") * share))).select("doc", "key", "pages")


def font_sections(lines: DataFrame, larger: float = 2.0, shortest: int = 4, longest: int = 119) -> DataFrame:
    """``doc, section, title, first_page, last_page, n_lines``: sections that start at lines in bold type or ``larger`` than the body.

    The body's size is a document's most frequent one (of equals the smallest).  What
    stands before the first heading belongs to no section.
    """
    sizes = lines.groupBy("doc", "size").agg(F.count(F.lit(1)).alias("n"))
    body = sizes.groupBy("doc").agg(F.max(F.struct("n", (-F.col("size")).alias("s"))).alias("m")).select("doc", (-F.col("m.s")).alias("body"))
    length = F.length(F.trim("text"))
    head = ((F.col("size") >= F.col("body") + larger) | F.col("bold")) & length.between(shortest, longest)
    # headings are few: they are numbered per document, and each page learns how many came before it
    marked = lines.join(apart(body), "doc").withColumn("head", F.coalesce(head, F.lit(False)))
    per_page = marked.groupBy("doc", "page_id").agg(F.sum(F.col("head").cast("int")).alias("heads"))
    before = F.sum("heads").over(Window.partitionBy("doc").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_page.select("doc", "page_id", F.coalesce(before, F.lit(0)).alias("offset"))
    within = F.sum(F.col("head").cast("int")).over(Window.partitionBy("doc", "page_id").orderBy("line_no"))
    placed = marked.withColumn("within", within).join(apart(offsets), ["doc", "page_id"]).withColumn("section", (F.col("within") + F.col("offset")).cast("int"))
    return placed.filter("section > 0").groupBy("doc", "section").agg(F.max(F.when(F.col("head"), F.trim("text"))).alias("title"), F.min("page_id").alias("first_page"), F.max("page_id").alias("last_page"), F.count(F.lit(1)).alias("n_lines"))


def font_glyphs(text: Column, font: Column, tables: list[tuple[str, dict[str, str]]]) -> Column:
    """A run of text with the glyphs of special fonts as the characters they show.

    ``tables``: a font name's prefix with its glyphs; the first prefix that fits counts.
    Other fonts' text and null fonts stay; control characters that are left go.
    """
    def shown(glyphs: dict[str, str]) -> Column:
        plain = F.create_map(*[F.lit(x) for pair in glyphs.items() for x in pair])
        return F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(plain[c], c)), "")

    out = text
    for prefix, glyphs in reversed(tables):
        out = F.when(font.startswith(prefix), shown(glyphs)).otherwise(out)
    return F.regexp_replace(out, "[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x9f]", "")
