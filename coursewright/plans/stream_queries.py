"""The batch forms of the stream operators, so that both can be compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from coursewright.plans.registry import Registry
from coursewright.session import table
from coursewright.streaming import answers

query = Registry()


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_events(spark, d):
    return answers.counts_per_window(table(spark, d, "events"), "ts", "event_type").withColumn("total", F.round("total", 4))


QUERIES, SQL = query.queries, query.sql
