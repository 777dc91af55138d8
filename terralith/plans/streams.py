"""Registered queries that run as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from terralith.sources.fixtures import table
from terralith.streaming.windows import enriched, run_in_turn, run_stored, sessions

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def stream_daily_counts(spark, sf_dir):
    """Daily windows of the event stream that the watermark closed: all but the last day."""
    schema = table(spark, sf_dir, "events").schema
    return run_stored(spark, f"{sf_dir}/events.parque[t]", schema)  # a pattern, for a file or a folder


QUERIES["stream_daily_counts"] = stream_daily_counts
ORACLES["stream_daily_counts"] = """SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events
WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2"""


def stream_sessions(spark, sf_dir):
    """Sessions of users that the watermark closed."""
    return run_stored(spark, f"{sf_dir}/events.parque[t]", table(spark, sf_dir, "events").schema, sessions)


QUERIES["stream_sessions"] = stream_sessions
ORACLES["stream_sessions"] = """WITH m AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 4 HOUR, TRUE) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, min(ts) AS started, count(*) AS n, max(value) AS most FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 4 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""


def stream_static_join(spark, sf_dir):
    """Daily events by the market segment of the customer, closed days only."""
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey AS user_id", "c_mktsegment AS segment")
    return run_stored(spark, f"{sf_dir}/events.parque[t]", table(spark, sf_dir, "events").schema, lambda e: enriched(e, c, "user_id", "segment"))


QUERIES["stream_static_join"] = stream_static_join
ORACLES["stream_static_join"] = """WITH j AS (SELECT * FROM events JOIN customer ON c_custkey = user_id)
SELECT CAST(ts AS DATE) AS day, c_mktsegment AS segment, count(*) AS n FROM j WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM j) GROUP BY 1, 2"""


#: Events come in thirds of their month; every tenth is late by one.
_BATCH = "least(2, CAST(floor((extract(day FROM ts) - 1) / 10) AS INT) + CASE WHEN event_id % 10 = 3 THEN 1 ELSE 0 END)"


def stream_late_rows(spark, sf_dir):
    """Daily counts of a stream that is fed in three parts, whose later ones hold rows of days already closed: those
    are dropped, and counted as the difference from all rows of the day."""
    e = table(spark, sf_dir, "events").withColumn("part", F.expr(_BATCH))
    counted = run_in_turn(spark, [e.where(F.col("part") == k).drop("part") for k in range(3)])
    whole = e.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n_all"))
    return whole.join(counted, ["day", "event_type"]).select("day", "event_type", "n", (F.col("n_all") - F.col("n")).alias("n_dropped"))


QUERIES["stream_late_rows"] = stream_late_rows
ORACLES["stream_late_rows"] = f"""WITH e AS (SELECT CAST(ts AS DATE) AS day, event_type, ts, {_BATCH} AS part FROM events),
w AS (SELECT part, max(ts) - INTERVAL 1 HOUR AS mark FROM e GROUP BY part),
k AS (SELECT e.*, NOT EXISTS (SELECT 1 FROM w WHERE w.part < e.part AND e.day + INTERVAL 1 DAY <= w.mark) AS counted FROM e)
SELECT day, event_type, count(*) FILTER (counted) AS n, count(*) FILTER (NOT counted) AS n_dropped FROM k
WHERE day + INTERVAL 1 DAY <= (SELECT max(mark) FROM w) GROUP BY day, event_type HAVING count(*) FILTER (counted) > 0"""
