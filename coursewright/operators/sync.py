"""Keeping derived tables in step with their sources, by anti-joins and full joins on keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stale_keys(stored: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Stored keys that aren't expected. An empty ``expected`` makes nothing stale: a source that failed to load must not empty the store."""
    some = expected.limit(1).select(F.lit(True).alias("_some"))
    return stored.select(key).distinct().join(expected.select(key).distinct(), key, "left_anti").join(F.broadcast(some)).drop("_some")


def drift(stored: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """``key, status``: ``missing`` in the store, ``extra`` in it."""
    a = expected.select(key).distinct().withColumn("_e", F.lit(True))
    b = stored.select(key).distinct().withColumn("_s", F.lit(True))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("_s").isNull(), "missing").when(F.col("_e").isNull(), "extra").alias("status")).filter("status is not null")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def last_per_key(df: DataFrame, key: str, order: list, keep: str | None = None) -> DataFrame:
    """The last row of each key by ``order`` (names), of those that satisfy ``keep``."""
    rows = df.filter(keep) if keep else df
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_m")).select(key, *[F.col("_m")[c].alias(c) for c in cols])


def merge_columns(stored: DataFrame, fresh: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The stored rows with the fresh row's columns where there is one: a fresh null clears the stored value."""
    new = fresh.select(key, F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in columns])
    j = stored.join(new, key, "left")
    return j.select(*[(F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)) for c in stored.columns])


def keep_over(manual: DataFrame, derived: DataFrame, key: str) -> DataFrame:
    """Derived rows, but hand-made ones where a key has one."""
    return manual.unionByName(derived.join(manual.select(key), key, "left_anti"))


def stable_ids(df: DataFrame, prefix: str, group: str, order: list, out: str = "stable_id") -> DataFrame:
    """Ids ``<group>_<prefix>_<nnnn>`` by place in the group."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn(out, F.format_string(f"%s_{prefix}_%04d", F.col(group), n))


def free_ids(new: DataFrame, stored: DataFrame, key: str, order: list[str], out: str = "new_id") -> DataFrame:
    """``new`` with an id of its own per row: ``key`` itself where it is free, else with the next free suffix (``_2``, ``_3``, ...).

    ``stored``: the ids in use (``key``), suffixed ones among them.  Rows of one key are
    numbered by ``order``.  A null key gets no id.
    """
    parts = stored.filter(F.col(key).isNotNull()).select(F.regexp_replace(key, "_[0-9]+$", "").alias("base"), F.col(key).alias("whole"))
    number = F.coalesce(F.nullif(F.regexp_extract("whole", "_([0-9]+)$", 1), F.lit("")).cast("int"), F.lit(1))
    # an id that ends in a number is a base of its own as well as a suffixed one
    taken = parts.select("base", number.alias("n")).unionByName(parts.select(F.col("whole").alias("base"), F.lit(1).alias("n"))).groupBy("base").agg(F.max("n").alias("_taken"))
    placed = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    found = placed.join(taken.withColumnRenamed("base", key), key, "left").withColumn("_n", F.col("_n") + F.coalesce("_taken", F.lit(0)))
    made = F.when(F.col("_n") == 1, F.col(key)).otherwise(F.concat(F.col(key), F.lit("_"), F.col("_n").cast("string")))
    return found.withColumn(out, F.when(F.col(key).isNotNull(), made)).drop("_n", "_taken")


def mark_used(bank: DataFrame, used: DataFrame, key: str, by: str) -> DataFrame:
    """``bank`` with ``used_by``: the first user (``by``) of each row; null for rows nobody uses."""
    first = used.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(by).alias("used_by"))
    return bank.drop("used_by").join(first, key, "left")
