"""Registry of queries, and the bindings of the abstract tables to the test tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The day all ages are measured from; never the wall clock.
AS_OF = dt.date(2024, 1, 31)
AS_OF_SQL = "DATE '2024-01-31'"


def query(name: str, sql: str | None = None):
    """Register a query, and the SQL that must give the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


#: Meetings of each bank and what they decided, in basis points.
MEETINGS = [(bank, dt.date.fromisoformat(day), bps) for bank in ("ECB", "FED") for day, bps in (("2024-01-08", 25), ("2024-01-17", 0), ("2024-01-25", -25), ("2024-02-05", 0))]
CALENDAR_SQL = "calendar(bank, meeting, bps) AS (VALUES " + ", ".join(f"('{b}', DATE '{d}', {x})" for b, d, x in MEETINGS) + ")"


def calendar(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MEETINGS, "bank string, meeting date, bps int")


#: Meetings by month of every order priority as a bank, moved to end near AS_OF; under the calendar's name.
MEETINGS_SQL = "calendar AS (SELECT o_orderpriority AS bank, min(o_orderdate)::DATE + 8248 AS meeting, ((count(*) % 3 - 1) * 25)::INT AS bps FROM orders GROUP BY o_orderpriority, date_trunc('month', o_orderdate))"


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("bank"), F.trunc("o_orderdate", "MM").alias("month"))
    return by.agg(F.date_add(F.to_date(F.min("o_orderdate")), 8248).alias("meeting"), ((F.count("*") % 3 - 1) * 25).cast("int").alias("bps")).drop("month")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored items of two banks and two channels, from the events."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    part = (F.pmod("user_id", F.lit(150)) + 1) / F.lit(150.0)
    return e.select(
        F.col("event_id").alias("item_id"),
        F.when(F.col("user_id") % 2 == 0, "FED").otherwise("ECB").alias("bank"),
        F.least(F.floor(part * part * part * 20), F.lit(19)).cast("int").alias("speaker"),
        F.to_date("ts").alias("item_date"),
        F.col("event_type").isin("purchase", "signup").alias("is_statistical"),
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("value") - 50) / 100)).alias("net_score"),
        F.col("event_type").alias("source"),
        (k % 4).alias("stat_weight"),
        k.alias("k"),
        F.concat(F.initcap("event_type"), F.lit(" report "), (k % 10).cast("string")).alias("title"),
        (k * 10 + 5).alias("word_count"),
        "user_id",
        "value",
    )


ITEMS_SQL = """items AS (
  SELECT event_id AS item_id, CASE WHEN user_id % 2 = 0 THEN 'FED' ELSE 'ECB' END AS bank,
    least(floor(pow3 * 20), 19)::INT AS speaker, ts::DATE AS item_date, event_type IN ('purchase', 'signup') AS is_statistical,
    greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (value - 50) / 100)) AS net_score, event_type AS source, k % 4 AS stat_weight, k,
    upper(event_type[1]) || event_type[2:] || ' report ' || (k % 10) AS title, k * 10 + 5 AS word_count, user_id, value
  FROM (SELECT *, ((user_id % 150 + 1) / 150.0::DOUBLE) * ((user_id % 150 + 1) / 150.0::DOUBLE) * ((user_id % 150 + 1) / 150.0::DOUBLE) AS pow3,
          CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""

#: The speaker whose weight isn't capped.
CHAIR = 19


def scored(items: DataFrame) -> DataFrame:
    """Rows with a score; written so that both bounds reach a Parquet scan of stored scores."""
    return items.where((F.col("net_score") > 0.001) | (F.col("net_score") < -0.001))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly totals and means of order prices."""
    o = table(spark, sf_dir, "orders")
    month = F.trunc("o_orderdate", "MM").alias("month")
    return o.groupBy(month).agg(F.sum("o_totalprice").alias("total"), F.avg("o_totalprice").alias("mean"), F.count("*").alias("n"))


SERIES_SQL = """series AS (
  SELECT date_trunc('month', o_orderdate)::DATE AS month, sum(o_totalprice) AS total, avg(o_totalprice) AS mean, count(*) AS n FROM orders GROUP BY 1)"""


def with_sql(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "
