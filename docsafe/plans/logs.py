"""Queries over structured log events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsafe.functions import text as T
from docsafe.sources import tables


def stage_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Mean, median and sum of every stage over all pages; a page without a stage spent nothing on it. A page is a user, a
    stage a type of event."""
    pages = document_summary(spark, sf)
    rows = pages.unpivot(["user_id"], list(KINDS), "event_type", "value")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.median("value"), 4).alias("median"), F.round(F.sum("value"), 2).alias("total"))


KINDS = ("view", "signup", "error", "click", "purchase")
A5 = """WITH p AS (SELECT u.user_id, t.event_type, round(coalesce(sum(e.value), 0.0), 4) AS value FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (VALUES ('view'), ('signup'), ('error'), ('click'), ('purchase')) t(event_type)
LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = t.event_type GROUP BY ALL)
SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(sum(value), 2) AS total FROM p GROUP BY event_type"""


def counters(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.table(spark, sf, "events").select("event_type", F.from_json("props", "map<string,bigint>").alias("m"))
    return e.select("event_type", F.explode("m").alias("counter", "v")).groupBy("event_type", "counter").agg(F.sum("v").alias("total"), F.round(F.avg("v"), 4).alias("mean"))


A6 = """SELECT event_type, 'k' AS counter, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total, round(avg(json_extract(props, '$.k')::BIGINT), 4) AS mean FROM events GROUP BY event_type"""


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions that signup opens; of each user the last with a purchase in it."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = tables.table(spark, sf, "events").withColumn("session", F.sum((F.col("event_type") == "signup").cast("long")).over(by))
    s = e.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.count_if(F.col("event_type") == "purchase").alias("done"))
    last = s.where("done > 0").groupBy("user_id").agg(F.max(F.struct("session", "n", "total")).alias("s"))
    return last.select("user_id", "s.session", "s.n", "s.total")


W10 = """WITH e AS (SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM events),
s AS (SELECT user_id, session, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY user_id, session HAVING count(*) FILTER (event_type = 'purchase') > 0)
SELECT user_id, session, n, total FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY session DESC) = 1"""


def ab_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of a baseline and a candidate run for every key that either has, and the change."""
    e = tables.table(spark, sf, "events")
    side = lambda odd, name: e.where(F.col("event_id") % 2 == odd).groupBy("event_type").agg(F.round(F.sum("value"), 2).alias(name))
    both = side(0, "baseline").join(side(1, "candidate"), "event_type", "full").select("event_type", F.coalesce("baseline", F.lit(0.0)).alias("baseline"), F.coalesce("candidate", F.lit(0.0)).alias("candidate"))
    return both.withColumn("change", T.percent_change(F.col("baseline"), F.col("candidate")))


A9 = """WITH b AS (SELECT event_type, round(sum(value) FILTER (event_id % 2 = 0), 2) AS x, round(sum(value) FILTER (event_id % 2 = 1), 2) AS y FROM events GROUP BY event_type)
SELECT event_type, coalesce(x, 0.0) AS baseline, coalesce(y, 0.0) AS candidate, CASE WHEN coalesce(x, 0) = 0 THEN 'n/a' ELSE format('{:+.1f}%', (coalesce(y, 0) - x) / x * 100) END AS change FROM b"""


def cost_allocation(spark: SparkSession, sf: str) -> DataFrame:
    """The cost of a batch on its pages, by their share of its rows."""
    e = tables.table(spark, sf, "events").withColumns({"batch": F.floor(F.col("event_id") / 32), "page": F.col("user_id") % 7})
    w = Window.partitionBy("batch")
    cost = e.groupBy("batch", "page").agg(F.count("*").alias("rows"), F.sum(F.col("value").cast("decimal(18,6)")).alias("v"))
    return cost.select("batch", "page", "rows", (F.sum("v").over(w).cast("double") * F.col("rows") / F.sum("rows").over(w)).alias("cost"))


A10 = """SELECT batch, page, rows, (sum(v) OVER (PARTITION BY batch))::DOUBLE * rows / (sum(rows) OVER (PARTITION BY batch))::DOUBLE AS cost
FROM (SELECT event_id // 32 AS batch, user_id % 7 AS page, count(*) AS rows, sum(value::DECIMAL(18, 6)) AS v FROM events GROUP BY ALL)"""


def diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """Diagnostics that several pages of one run repeat count once: by fingerprint and wall time."""
    e = tables.table(spark, sf, "events").select("event_type", F.col("props").alias("fingerprint"), F.round(F.col("value") / 10).alias("wall_ms"))
    return e.dropDuplicates(["event_type", "fingerprint", "wall_ms"]).groupBy("event_type").agg(F.count("*").alias("kinds"), F.sum("wall_ms").alias("wall_ms"))


def batch_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of an event type: how many, their mean and largest size."""
    b = tables.table(spark, sf, "events").groupBy("event_type", F.floor(F.col("event_id") / 32).alias("batch")).agg(F.count("*").alias("n"))
    return b.groupBy("event_type").agg(F.count("*").alias("batches"), F.round(F.avg("n"), 4).alias("mean_size"), F.max("n").alias("largest"))


A23 = """SELECT event_type, count(*) AS batches, round(avg(n), 4) AS mean_size, max(n) AS largest FROM (SELECT event_type, event_id // 32 AS batch, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY event_type"""


def document_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A row a user with the sum of every kind of event, 0 where there is none."""
    kinds = ["view", "signup", "error", "click", "purchase"]
    return tables.table(spark, sf, "events").groupBy("user_id").agg(*[F.round(F.coalesce(F.sum(F.when(F.col("event_type") == k, F.col("value"))), F.lit(0.0)), 4).alias(k) for k in kinds])


A8 = "SELECT user_id, " + ", ".join(f"round(coalesce(sum(value) FILTER (event_type = '{k}'), 0.0), 4) AS {k}" for k in ("view", "signup", "error", "click", "purchase")) + " FROM events GROUP BY user_id"


def group_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of all events merged by key."""
    m = tables.table(spark, sf, "events").select(F.explode(F.map_from_arrays(F.array("event_type"), F.array(F.lit(1).cast("long")))).alias("key", "n"))
    return m.groupBy("key").agg(F.sum("n").alias("n"))


def run_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Users that both runs have."""
    e = tables.table(spark, sf, "events")
    return e.where("event_id % 2 = 0").select("user_id").intersect(e.where("event_id % 2 = 1").select("user_id"))


def last_events(spark: SparkSession, sf: str) -> DataFrame:
    """The last event of each kind of a user."""
    return tables.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


QUERIES = {
    "a5_stage_stats": (stage_stats, A5),
    "a6_counter_totals": (counters, A6),
    "w10_sessions": (sessions, W10),
    "a9_run_comparison": (ab_compare, A9),
    "a10_cost_allocation": (cost_allocation, A10),
    "a22_diagnostic_dedupe": (diagnostics, "SELECT event_type, count(*) AS kinds, sum(wall_ms) AS wall_ms FROM (SELECT DISTINCT event_type, props, round(value / 10) AS wall_ms FROM events) GROUP BY event_type"),
    "a23_batch_metrics": (batch_metrics, A23),
    "a8_document_summary": (document_summary, A8),
    "a7_group_counts": (group_counts, "SELECT event_type AS key, count(*) AS n FROM events GROUP BY event_type"),
    "u1_common_keys": (run_keys, "SELECT user_id FROM events WHERE event_id % 2 = 0 INTERSECT SELECT user_id FROM events WHERE event_id % 2 = 1"),
    "t12_last_events": (last_events, "SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type"),
}
