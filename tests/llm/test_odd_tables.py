"""Every query on empty tables, on tables with null rows, repeats and clashing columns, against its plain result."""

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from coursewright.llm import queries as Q
from coursewright.plans import nested_records
from tests.conftest import SF, rows

FOUND = {k: v for k, v in (Q.queries() | nested_records.QUERIES).items() if k in ("p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p6_ids", "p7_found", "p8_found")}
GROWING = ("documents", "generated_questions", "pyq_questions", "pyq_pages", "tutorial_chunks", "paper_files")
CLASH = ("rec", "key", "ord", "value", "same", "tab", "scope", "form", "paper", "doc", "root_id", "garbled", "n_tokens", "ids")


def copy(spark, to: Path, change):
    for p in Path(SF).glob("*.parquet"):
        if p.stem in GROWING:
            change(spark.read.parquet(str(p)), p.stem).write.mode("overwrite").parquet(str(to / p.name))
        else:
            shutil.copy(p, to / p.name)
    return str(to)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return copy(spark, tmp_path_factory.mktemp("empty"), lambda df, name: df.limit(0))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    def change(df, name):
        nulls = df.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in df.dtypes])
        out = df.unionByName(nulls)
        if name != "documents":  # documents has no repeated rows: its ids are unique
            out = out.unionByName(df.limit(3))
        return out.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns})

    return copy(spark, tmp_path_factory.mktemp("odd"), change)


@pytest.mark.parametrize("name", sorted(FOUND))
def test_empty_tables_give_no_rows(spark, empty, name):
    out = FOUND[name](spark, empty)
    if name == "p7_found":  # no tokens at all: every target of 0 tokens is reached
        assert out.count() == 0
    else:
        assert out.count() == 0
    assert out.columns == FOUND[name](spark, SF).columns


@pytest.mark.parametrize("name", sorted(FOUND))
def test_null_rows_repeats_and_clashing_columns_change_nothing(spark, odd, name):
    plain, changed = FOUND[name](spark, SF), FOUND[name](spark, odd)
    assert changed.columns == plain.columns
    a, b = rows(plain), rows(changed)
    if name == "p6_ids":
        b.remove((None, []))
    assert a == b
