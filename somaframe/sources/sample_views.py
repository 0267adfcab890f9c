"""The domain's tables, derived from the general sample tables (events, lineitem, orders).

Times are double seconds since 2024-01-01, read without any session time zone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somaframe.functions.frames import spread

SECONDS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) / 1e6D"
#: The same for DuckDB.
SQL_SECONDS = "(epoch_us(ts) - 1704067200000000) / 1e6"
SQL_BEATS = f"beats AS (SELECT user_id AS subject_id, event_id AS seq, {SQL_SECONDS} AS t_s, 500 + 5 * value AS rr_ms FROM events)"
SQL_BEATS2 = f"beats2 AS (SELECT user_id AS subject_id, event_id AS seq, {SQL_SECONDS} AS t_s, 500 + 5 * value + ((event_id % 7) - 3) AS rr_ms FROM events)"
SQL_MARKERS = f"markers AS (SELECT user_id AS subject_id, event_id AS seq, {SQL_SECONDS} AS time_s, event_type AS label FROM events)"
SQL_ACC = """acc AS (SELECT l_suppkey AS subject_id, l_quantity AS value_x, l_discount * 1000 AS value_y, l_tax * 1000 AS value_z,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) / 10.0::DOUBLE AS time_s FROM lineitem)"""
SQL_ITEMS = """items AS (
    SELECT o.o_custkey AS subject_id, (o.rn - 1) % 3 + 1 AS time, CAST(o.o_custkey % 2 AS INTEGER) AS task,
        max(CASE WHEN (l_linenumber - 1) % 4 = 0 THEN CAST(l_quantity AS BIGINT) % 5 + 1 END)::DOUBLE AS q1, max(CASE WHEN (l_linenumber - 1) % 4 = 1 THEN CAST(l_quantity AS BIGINT) % 5 + 1 END)::DOUBLE AS q2,
        max(CASE WHEN (l_linenumber - 1) % 4 = 2 THEN CAST(l_quantity AS BIGINT) % 5 + 1 END)::DOUBLE AS q3, max(CASE WHEN (l_linenumber - 1) % 4 = 3 THEN CAST(l_quantity AS BIGINT) % 5 + 1 END)::DOUBLE AS q4
    FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) o
    LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject_id, seq, t_s, rr_ms"""
    return table(spark, sf_dir, "events").selectExpr("user_id AS subject_id", "event_id AS seq", f"{SECONDS} AS t_s", "500 + 5 * value AS rr_ms")


def beats2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second source of the same beats, a few milliseconds off."""
    return table(spark, sf_dir, "events").selectExpr("user_id AS subject_id", "event_id AS seq", f"{SECONDS} AS t_s", "500 + 5 * value + ((event_id % 7) - 3) AS rr_ms")


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject_id, seq, time_s, label"""
    return table(spark, sf_dir, "events").selectExpr("user_id AS subject_id", "event_id AS seq", f"{SECONDS} AS time_s", "event_type AS label")


def acc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject_id, time_s, value_x, value_y, value_z"""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey AS subject_id", "l_quantity AS value_x", "l_discount * 1000 AS value_y", "l_tax * 1000 AS value_z",
        "row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) / 10.0D AS time_s",
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questionnaire answers: subject_id, time (1 to 3; further orders go round), task, q1 to q4."""
    taken = table(spark, sf_dir, "orders").selectExpr("o_custkey", "o_orderkey", "(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) % 3 + 1 AS time")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    answer = [F.max(F.when((F.col("l_linenumber") - 1) % 4 == k - 1, F.col("l_quantity").cast("bigint") % 5 + 1)).cast("double").alias(f"q{k}") for k in (1, 2, 3, 4)]
    return taken.join(lines, taken["o_orderkey"] == lines["l_orderkey"], "left").groupBy(F.col("o_custkey").alias("subject_id"), F.col("time").cast("bigint").alias("time"), (F.col("o_custkey") % 2).cast("int").alias("task")).agg(*answer)


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few rows from which signals are generated, dealt to all partitions first, by subject, so that their samples need not be dealt again."""
    # dealt before duplicates go: a number of partitions asked for after that is taken as met, and few rows are put into one task
    return spread(table(spark, sf_dir, "events").select(F.col("user_id").alias("subject_id")), "subject_id").distinct()


def resp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated breathing at 10 Hz for two minutes per subject, with holes: subject_id, seq, time_s, value."""
    grid = subjects(spark, sf_dir).withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(1199))))
    value = 100 * F.sin(2 * F.pi() * (F.lit(0.2) + (F.col("subject_id") % 5) * 0.03) * F.col("seq") / 10)
    return grid.select("subject_id", "seq", (F.col("seq") / 10).alias("time_s"), F.when(~(F.col("seq") % 400).between(0, 20), value).alias("value"))
