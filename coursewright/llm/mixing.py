"""Mixing sources to target shares of the tokens, with capped repetition.

Tokens are added up per source; a source's rate is the number of copies of each
of its documents that gives the source its share, at most ``max_repeat``.  Each
document goes out ``floor(rate)`` times, and once more with a probability equal
to the fraction, drawn from a hash of the seed and the document's id: the draw
is the same on every run, on every executor and for any partitioning.

The size to reach is the tokens of *all* documents given, those of other or no
source included.  A source that can't reach its share is emitted ``max_repeat``
times and reported as short; what it lacks isn't given to other sources, since
that would push them over their own targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursewright.session import sized as by_count

#: Rounding slack of the comparison of tokens with a share of the total.
_EPS = 1e-9


def source_totals(sized: DataFrame, source_col: str = "source", tokens_col: str = "n_tokens") -> DataFrame:
    """One row per source (null is one): ``source, tokens, docs``; partial sums come before the shuffle, so a hot source is no burden."""
    return sized.groupBy(F.col(source_col).alias("source")).agg(F.sum(tokens_col).cast("long").alias("tokens"), F.count(F.lit(1)).alias("docs"))


def repetition_rates(totals: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, max_repeat, tokens, docs, wanted, rate, reaches`` for each source of ``targets``.

    A source without documents or tokens has 0 tokens and a rate of ``max_repeat``
    and doesn't reach a share above 0.  Repeated target rows of a source count
    once (largest share, then largest cap); rows with a null source or share are
    left out; a null or negative cap counts as 0.
    """
    goal = (
        targets.filter(F.col("source").isNotNull() & F.col("target_share").isNotNull())
        .groupBy("source")
        .agg(F.max(F.struct("target_share", F.greatest(F.coalesce("max_repeat", F.lit(0)), F.lit(0)).alias("max_repeat"))).alias("g"))
        .select("source", F.col("g.target_share").cast("double").alias("target_share"), F.col("g.max_repeat").cast("int").alias("max_repeat"))
    )
    whole = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("total"))
    named = totals.filter(F.col("source").isNotNull())
    wanted = F.col("target_share") * F.col("total")
    tokens = F.coalesce("tokens", F.lit(0).cast("long"))
    return (
        goal.join(named, "source", "left")
        .crossJoin(F.broadcast(whole))  # one row
        .select(
            "source", "target_share", "max_repeat", "total", tokens.alias("tokens"), F.coalesce("docs", F.lit(0).cast("long")).alias("docs"),
            wanted.alias("wanted"),
            F.when(tokens > 0, F.least(F.col("max_repeat").cast("double"), wanted / tokens)).otherwise(F.col("max_repeat").cast("double")).alias("rate"),
            (F.col("max_repeat") * tokens >= wanted - _EPS * F.col("total")).alias("reaches"),
        )
    )


def mixed_set(sized: DataFrame, rates: DataFrame, id_col: str = "doc_id", source_col: str = "source", tokens_col: str = "n_tokens", seed: int = 42) -> DataFrame:
    """``id_col, source, n_tokens, copies`` of each document that the mixed set holds (``copies`` from 1 to ``max_repeat``).

    ``rates`` has one row per target source; it is broadcast if it is counted to be
    small, so that no source's documents are brought together.
    Rows with the same id draw alike.  Documents of no target source are left out.
    """
    unit = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    whole = F.floor("rate")
    copies = (whole + F.when(unit < F.col("rate") - whole, 1).otherwise(0)).cast("int")
    docs = sized.select(F.col(id_col), F.col(source_col).alias("source"), F.col(tokens_col).alias("n_tokens"))
    return docs.join(by_count(rates.select("source", "rate")), "source").select(id_col, "source", "n_tokens", copies.alias("copies")).filter("copies > 0")


def emit_copies(mixed: DataFrame) -> DataFrame:
    """One row per copy, ``copy_no`` from 1."""
    return mixed.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies"))))


def actual_shares(mixed: DataFrame, rates: DataFrame) -> DataFrame:
    """Per target source: what was asked for, what came out, and the share of both the mixed set and the size it was to have."""
    got = mixed.groupBy("source").agg(
        F.sum(F.col("copies") * F.col("n_tokens")).cast("long").alias("out_tokens"), F.sum("copies").cast("long").alias("out_docs"), F.max("copies").alias("most_copies")
    )
    out = F.coalesce("out_tokens", F.lit(0).cast("long"))
    joined = rates.join(got, "source", "left")
    made = mixed.agg(F.coalesce(F.sum(F.col("copies") * F.col("n_tokens")), F.lit(0)).cast("long").alias("made"))
    return joined.crossJoin(F.broadcast(made)).select(  # one row
        "source", "target_share", "max_repeat", "tokens", "docs", "rate", "reaches", out.alias("out_tokens"),
        F.coalesce("out_docs", F.lit(0).cast("long")).alias("out_docs"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.when(F.col("made") > 0, out / F.col("made")).otherwise(F.lit(0.0)).alias("share_of_set"),
        F.when(F.col("total") > 0, out / F.col("total")).otherwise(F.lit(0.0)).alias("share_of_target_size"),
    )


def short_sources(rates: DataFrame) -> DataFrame:
    """Sources whose capped tokens stay below their share."""
    return rates.filter(~F.col("reaches")).select("source")


__all__ = ["actual_shares", "emit_copies", "mixed_set", "repetition_rates", "short_sources", "source_totals"]
