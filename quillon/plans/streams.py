"""Queries over streams: the events arrive in six deliveries, some of them late, and are read as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.tables import table
from quillon.streaming import commands, runs, windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: The deliveries' first instant and length, and times of the queries, in microseconds.
SINCE, PERIOD, COUNT = 1_704_067_200_000_000, 432_000_000_000, 6
HOUR, DAY = 3_600_000_000, 86_400_000_000
#: An event in forty comes two deliveries late, which is after the watermark.
LATE = "event_id % 40 = 7 and own < 4"
#: Events of a delivery's last half day come with the next one, which is before the watermark.
MILD = f"us - {SINCE} >= (own + 1) * {PERIOD} - {12 * HOUR} and own < {COUNT - 1}"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def deliveries(spark: SparkSession, sf: str, mild: bool = True) -> list[DataFrame]:
    """The events with their time `t`, as they are delivered."""
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", windows.instant("ts").alias("t")).withColumn("us", F.unix_micros("t"))
    own = F.least(F.lit(COUNT - 1), F.greatest(F.lit(0), F.floor((F.col("us") - SINCE) / PERIOD)))
    k = F.when(F.expr(LATE), F.col("own") + 2)
    k = (k.when(F.expr(MILD), F.col("own") + 1) if mild else k).otherwise(F.col("own"))
    rows = rows.withColumn("own", own.cast("int")).withColumn("k", k)
    return [rows.filter(F.col("k") == i).drop("own", "k", "us") for i in range(COUNT)]


def _cents() -> Column:
    return F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")


@query
def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Events and their value by type, in windows of two days that begin every day."""
    result, _ = runs.deliver(deliveries(spark, sf), lambda s: windows.sliding(s, "t", "1 day", "2 days", "1 day", ["event_type"], F.count("*").alias("n"), _cents()))
    return result


@query
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of every user, half a day apart."""
    result, _ = runs.deliver(deliveries(spark, sf), lambda s: windows.sessions(s, "t", "1 day", "12 hours", ["user_id"], F.count("*").alias("n"), _cents()))
    return result


@query
def stream_completions(spark: SparkSession, sf: str) -> DataFrame:
    """Views with the purchases that follow within six hours, or none."""

    def build(s: DataFrame) -> DataFrame:
        starts = s.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("start_id"), F.col("t").alias("started"))
        ends = s.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("end_id"), F.col("t").alias("completed"))
        joined = windows.completions_of(starts, ends, ["user_id"], "1 day", "6 hours")
        return joined.select("user_id", "start_id", "end_id", F.unix_micros("started").alias("started_us"), F.unix_micros("completed").alias("completed_us"))

    return runs.deliver(deliveries(spark, sf), build)[0]


@query
def stream_commands(spark: SparkSession, sf: str) -> DataFrame:
    """Views as starts, purchases as completions; a start that nothing ends within two days times out."""

    def build(s: DataFrame) -> DataFrame:
        phase = F.when(F.col("event_type") == "view", "start").otherwise("complete")
        rows = s.filter("event_type in ('view', 'purchase')").select(F.col("user_id").cast("string").alias("run_id"), F.lit("x").alias("id"), F.col("event_id").alias("seq"), phase.alias("phase"), "t")
        return commands.paired_commands(rows, "t", "1 day", 2 * DAY)

    result, _ = runs.deliver(deliveries(spark, sf, mild=False), build)
    return result.select(F.col("run_id").cast("long").alias("user_id"), "started_us", "completed_us", "outcome")


def _delivered(mild: bool = True, only: str = "true") -> str:
    """d: events with their delivery k; w: the watermark before each delivery; f: the last one."""
    late = f"CASE WHEN {LATE} THEN own + 2 {f'WHEN {MILD} THEN own + 1' if mild else ''} ELSE own END"
    return f"""e AS (SELECT event_id, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents, epoch_us(ts) AS us, least({COUNT - 1}, greatest(0, (epoch_us(ts) - {SINCE}) // {PERIOD})) AS own FROM events WHERE {only}),
d AS (SELECT *, {late} AS k FROM e), m AS (SELECT k, max(us) // 1000 * 1000 - {DAY} AS m FROM d GROUP BY k),
w AS (SELECT k, max(m) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wm FROM m), f AS (SELECT max(m) AS wm FROM m)"""


_JOIN_ON = f"e.us BETWEEN s.us AND s.us + {6 * HOUR}"
#: Watermarks and acceptance are worked out from the deliveries; what is accepted is then one table.
ORACLE = {
    "stream_windows": f"""WITH {_delivered()}, x AS (SELECT d.*, us // {DAY} * {DAY} - unnest([0, 1]) * {DAY} AS start_us FROM d)
SELECT start_us, start_us + {2 * DAY} AS end_us, event_type, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM x JOIN w USING (k), f
WHERE (w.wm IS NULL OR start_us + {2 * DAY} > w.wm) AND start_us + {2 * DAY} <= f.wm GROUP BY ALL""",
    "stream_sessions": f"""WITH {_delivered()}, x AS (SELECT d.* FROM d JOIN w USING (k) WHERE wm IS NULL OR us + {12 * HOUR} > wm),
g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) <= {12 * HOUR} THEN 0 ELSE 1 END AS opens FROM x),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY us) AS i FROM g)
SELECT start_us, end_us, user_id, n, cents FROM (SELECT min(us) AS start_us, max(us) + {12 * HOUR} AS end_us, user_id, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM s GROUP BY user_id, i), f WHERE end_us <= f.wm""",
    "stream_completions": f"""WITH {_delivered(only="event_type IN ('view', 'purchase')")}, m2 AS (SELECT k, event_type, max(us) // 1000 * 1000 - {DAY} AS m FROM d GROUP BY ALL),
b2 AS (SELECT k, min(wm) AS wm, min(last) AS last FROM (SELECT w.k, t.event_type, max(m2.m) FILTER (m2.k < w.k) AS wm, max(m2.m) AS last FROM w CROSS JOIN (SELECT DISTINCT event_type FROM d) t JOIN m2 USING (event_type) GROUP BY ALL) GROUP BY k),
x AS (SELECT d.* FROM d JOIN b2 USING (k) WHERE wm IS NULL OR us > wm), s AS (SELECT * FROM x WHERE event_type = 'view'), p AS (SELECT * FROM x WHERE event_type = 'purchase')
SELECT s.user_id, s.event_id AS start_id, e.event_id AS end_id, s.us AS started_us, e.us AS completed_us FROM s LEFT JOIN p e ON s.user_id = e.user_id AND {_JOIN_ON}
WHERE e.event_id IS NOT NULL OR s.us + {6 * HOUR} < (SELECT min(last) FROM b2)""",
    "stream_commands": f"""WITH {_delivered(False, "event_type IN ('view', 'purchase')")}, x AS (SELECT d.*, event_type = 'view' AS opens FROM d JOIN w USING (k) WHERE wm IS NULL OR us > wm),
y AS (SELECT *, lag(opens) OVER u AS after_open, lag(us) OVER u AS before, lead(opens) OVER u AS then_opens, lead(us) OVER u AS next FROM x WINDOW u AS (PARTITION BY user_id ORDER BY us, event_id)),
c AS (SELECT user_id, CASE WHEN after_open AND us - before <= {2 * DAY} THEN before END AS started_us, us AS completed_us FROM y WHERE NOT opens)
SELECT user_id, started_us, completed_us, CASE WHEN started_us IS NULL THEN 'unpaired' ELSE 'completed' END AS outcome FROM c
UNION ALL SELECT user_id, us, NULL, 'timed out' FROM y, f WHERE opens AND NOT coalesce(NOT then_opens AND next - us <= {2 * DAY}, false) AND us + {2 * DAY} <= f.wm""",
}
