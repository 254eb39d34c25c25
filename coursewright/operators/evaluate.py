"""Scores of predicted labels against given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kappa(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """``n, accuracy, kappa`` in one row; kappa is null without rows or where chance agreement is 1. Rows with a null label count as labelled null."""
    cells = df.groupBy(F.coalesce(gold, F.lit("<null>")).alias("g"), F.coalesce(pred, F.lit("<null>")).alias("p")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    a = cells.groupBy(F.col("g").alias("x")).agg(F.sum("c").alias("a"))
    b = cells.groupBy(F.col("p").alias("x")).agg(F.sum("c").alias("b"))
    chance = a.join(b, "x").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0.0)).alias("s"))
    whole = cells.agg(F.coalesce(F.sum("c"), F.lit(0.0)).alias("n"), F.coalesce(F.sum(F.when(F.col("g") == F.col("p"), F.col("c"))), F.lit(0.0)).alias("k"))
    po, pe = F.expr("k / nullif(n, 0)"), F.expr("s / nullif(n, 0) / nullif(n, 0)")
    return whole.join(F.broadcast(chance)).select(F.col("n").cast("long").alias("n"), F.round(po, 6).alias("accuracy"), F.round(F.when(pe < 1, (po - pe) / F.expr("nullif(1 - s / nullif(n, 0) / nullif(n, 0), 0)")), 6).alias("kappa"))  # one row each
