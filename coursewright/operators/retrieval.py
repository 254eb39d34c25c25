"""Filtered nearest-neighbour retrieval, exact.

A search takes a stated set of queries against all rows; the two are joined on
the filter's key and on a block number, so no task holds a whole key and every
block keeps only its own nearest before the rest is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coursewright.functions.vectors import squared_l2

#: Least number of blocks, and rows a block may have: with more rows there are more blocks, so that none grows with the data.
BLOCKS, BLOCK_ROWS = 8, 50_000


def in_blocks(queries: DataFrame, rows: DataFrame, keys: list[str], row_id: str, blocks: int | None = None) -> DataFrame:
    """Queries joined with rows on ``keys``, each key cut into blocks; without keys every query meets every block."""
    blocks = blocks or max(BLOCKS, -(-rows.count() // BLOCK_ROWS))
    numbered = rows.withColumn("_block", F.pmod(F.xxhash64(row_id), F.lit(blocks)).cast("int"))
    return queries.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(numbered, [*keys, "_block"])


def nearest(pairs: DataFrame, query_id: str, n: int, order: list, per: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows per query (and ``per``) by ``order``, with ``rank``; each block is cut to ``n`` first."""
    keys = [query_id, *(per or [])]
    cut = pairs.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order))).filter(F.col("_r") <= n)
    return cut.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n).drop("_r", "_block")


def with_distance(pairs: DataFrame, a: str, b: str, out: str = "dist") -> DataFrame:
    """Squared distance rounded to 6 places, so that ties break by id alone."""
    return pairs.withColumn(out, F.round(squared_l2(F.col(a), F.col(b)), 6)).drop(a, b)


def nearest_distinct(pairs: DataFrame, query_id: str, text: str, n: int, order: list) -> DataFrame:
    """The ``n`` nearest with different texts: of each text the nearest row.

    Where ``pairs`` has blocks, each keeps the nearest rows of its ``n`` nearest texts
    first; a text's nearest row is among them in its own block.
    """
    def best(rows: DataFrame, *keys: str) -> DataFrame:
        one = rows.withColumn("_t", F.row_number().over(Window.partitionBy(*keys, text).orderBy(*order))).filter("_t = 1").drop("_t")
        return one.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)

    if "_block" in pairs.columns:
        pairs = best(pairs, query_id, "_block").drop("_block", "rank")
    return best(pairs, query_id)


def in_tiers(tiers: list[DataFrame], query_id: str, row_id: str, n: int, pool: int, order: list, prefer=None) -> DataFrame:
    """The first ``n`` rows per query over tiers, an earlier tier going before a later one; ``tier`` and ``rank`` are added.

    Of each tier the ``pool`` nearest are looked at; among these rows for which ``prefer``
    is false go first.  A row found in several tiers counts in the first.
    """
    pools = [nearest(t, query_id, pool, order).withColumn("tier", F.lit(i)) for i, t in enumerate(tiers)]
    columns = [c for c in pools[0].columns if all(c in p.columns for p in pools) and c != "rank"]
    every = reduce(DataFrame.unionByName, [p.select(columns) for p in pools])
    once = every.withColumn("_r", F.row_number().over(Window.partitionBy(query_id, row_id).orderBy("tier"))).filter("_r = 1").drop("_r")
    by = ["tier", *([prefer] if prefer is not None else []), *order]
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(*by))).filter(F.col("rank") <= n)


def read_page(rows: DataFrame, order: list[str], page: int, size: int) -> DataFrame:
    """Page ``page`` (from 1) of ``size`` rows in an order; a page beyond the last is empty."""
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)
