"""Streaming queries, run over the given tables as file streams."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import jobs as J
from .pricing import MODEL, MU_SQL
from .registry import query


def events(t):
    return J.table_stream(t.spark, t.folder, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("stage"), F.col("value").alias("duration"), "props")


def clock(column):
    """Event time as the wall clock of the source, free of any session zone."""
    return F.col(column).cast("timestamp_ntz")


@query("j01_run_telemetry", oracle="""
SELECT CAST(ts AS DATE) AS day, CAST(user_id AS VARCHAR) AS run_id, min(ts) AS started, max(ts) AS last_seen, count(*) AS events, count_if(event_type = 'error') AS errors,
 max(CAST(event_type = 'purchase' AS INTEGER)) AS finished FROM events GROUP BY 1, 2""")
def run_telemetry(t):
    out = J.drain_updates(J.run_telemetry(events(t)), ["day", "run_id"])
    return out.withColumns({"day": F.to_date("day.start"), "started": clock("started"), "last_seen": clock("last_seen")})


@query("j02_stage_rates", oracle="""
SELECT date_trunc('minute', ts) AS minute, event_type AS stage, count(*) AS n, round(avg(value), 4) AS mean_duration FROM events GROUP BY 1, 2
HAVING date_trunc('minute', ts) + INTERVAL 1 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stage_rates(t):
    out = J.drain(J.stage_rates(events(t)))
    return out.select(clock("minute.start").alias("minute"), "stage", "n", F.round("mean_duration", 4).alias("mean_duration"))


@query("j03_idle_sessions", oracle="""
g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS start FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(start) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT CAST(user_id AS VARCHAR) AS run_id, min(ts) AS started, max(ts) + INTERVAL 6 HOUR AS expires, count(*) AS n FROM s GROUP BY user_id, k
HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def idle_sessions(t):
    out = J.drain(J.idle_sessions(events(t)))
    return out.select("run_id", clock("s.start").alias("started"), clock("s.end").alias("expires"), "n")


def reads_and_plan(t):
    """Reads of photos by run, and what each run planned: a third of the runs planned one read more than ever arrives."""
    reads = events(t).select(F.col("run_id").alias("unit"), F.col("event_id").alias("read_id"), "ts")
    plan = t.events.groupBy(F.col("user_id").cast("string").alias("unit")).agg((F.count("*") + F.when(F.first("user_id") % 3 == 0, 1).otherwise(0)).alias("planned"))
    return reads, plan


@query("j04_completed_plans", oracle="""
SELECT CAST(user_id AS VARCHAR) AS unit, count(*) AS reads FROM events WHERE user_id % 3 <> 0 GROUP BY user_id""")
def completed_plans(t):
    return J.drain(J.completed_plans(*reads_and_plan(t)))


@query("j04_overdue_plans", oracle="""
SELECT CAST(user_id AS VARCHAR) AS unit, count(*) AS reads, count(*) + 1 AS planned FROM events WHERE user_id % 3 = 0 GROUP BY user_id
HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def overdue_plans(t):
    """Runs still short of a read two hours after their last one."""
    return J.drain(J.tracked_plans(*reads_and_plan(t), patience="2 hours").where("not complete").select("unit", "reads", "planned"))


@query("j05_first_photo_of_hash", oracle="SELECT min(event_id) AS event_id, md5(props) AS phash FROM events GROUP BY 2")
def first_photo_of_hash(t):
    photos = events(t).select("event_id", F.md5("props").alias("phash"))
    return J.land_first_of_hash(photos, "event_id")


@query("j05_dedupe_within_watermark", oracle="SELECT count(DISTINCT md5(props)) AS n FROM events")
def dedupe_within_watermark(t):
    """All events are inside one watermark here, so one row per hash goes on."""
    photos = events(t).select("ts", F.md5("props").alias("phash"))
    return J.drain(J.first_photos(photos, "40 days")).agg(F.count("*").alias("n"))


@query("j06_listings_scored_on_arrival", oracle=f"""
l AS (SELECT o_orderkey AS row_key, o_totalprice AS asking, 'US' AS market, 'BRAND#' || CAST(o_custkey % 12 AS VARCHAR) AS brand, ln(1 + greatest(2026 - (year(o_orderdate) + 20), 0)) AS log1p_age, ln(greatest((o_custkey % 50 + 1) * 20000, 1000)) AS log_km,
  CAST(year(o_orderdate) + 20 >= 2016 AS INTEGER) AS euro6 FROM orders),
e AS (SELECT *, ({MU_SQL})::DOUBLE AS mu, CASE WHEN CAST(substr(brand, 7) AS INTEGER) BETWEEN 1 AND 8 THEN 1.0::DOUBLE ELSE 1.85::DOUBLE END AS f FROM l),
p AS (SELECT row_key, asking, round_even(greatest(exp(mu), 7500), -3) AS point, round_even(CASE WHEN exp(mu) < 7500 THEN greatest(exp(mu - 0.12 * f), 6375) ELSE exp(mu - 0.12 * f) END, -3) AS low,
  round_even(CASE WHEN exp(mu) < 7500 THEN greatest(exp(mu + 0.14 * f), 8625) ELSE exp(mu + 0.14 * f) END, -3) AS high FROM e)
SELECT row_key, point, CASE WHEN asking BETWEEN low AND high THEN 'in line with the market' WHEN asking > high THEN 'above the market' ELSE 'below the market' END AS label FROM p""")
def listings_scored(t):
    orders = J.table_stream(t.spark, t.folder, "orders")
    rows = orders.select(F.col("o_orderkey").alias("row_key"), F.col("o_totalprice").alias("asking"), F.lit("US").alias("market"), F.concat(F.lit("Brand#"), (F.col("o_custkey") % 12).cast("string")).alias("make"),
                         (F.year("o_orderdate") + 20).alias("year"), ((F.col("o_custkey") % 50 + 1) * 20000).cast("double").alias("km"), F.lit(None).cast("string").alias("euro_norm"))
    return J.drain(J.score_listings(rows, MODEL)).select("row_key", "point", "label")
