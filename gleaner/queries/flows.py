"""Queries over streaming twins, HTML rows, scorers and rendered output."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.operators.items import ROLE_WEIGHTS, lookup
from gleaner.plans import scorer as sc
from gleaner.sources import html, readers, sinks
from gleaner.streaming import flows
from gleaner.tables import table


def _events(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(df: DataFrame, *columns: str) -> DataFrame:
    """Times as wall clock times again, as the table has them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def _name(base: str) -> str:
    return f"{base}_{uuid.uuid4().hex[:8]}"


def q_stream_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows by event type, complete mode over all that is there."""
    return _plain(flows.run_to_table(flows.windowed_counts(_events(spark, d), "ts", "event_type", "1 hour", "1 hour"), _name("hourly"), "complete"), "start")


def q_stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Sliding windows."""
    out = flows.run_to_table(flows.sliding_sums(_events(spark, d).withColumn("cents", F.round(F.col("value") * 100).cast("long")), "ts", "cents", "6 hours", "3 hours", "1 hour"), _name("sliding"), "complete")
    return _plain(out, "start")


def q_stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Session windows per user."""
    return _plain(flows.run_to_table(flows.sessions(_events(spark, d), "ts", "user_id", "30 minutes", "1 hour"), _name("sessions"), "complete"), "start", "end")


def q_stream_totals(spark: SparkSession, d: str) -> DataFrame:
    """Arbitrary state per key: running totals, the last of each."""
    cents = _events(spark, d).withColumn("cents", F.round(F.col("value") * 100))
    out = flows.run_to_table(flows.running_totals(cents, "event_type", "cents"), _name("totals"), "update")
    return out.groupBy("event_type").agg(F.max("n").alias("n"), F.max_by(F.col("total").cast("long"), "n").alias("cents"))


def q_stream_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Deduplication within a watermark: users by day seen."""
    rows = _events(spark, d).select("event_id", "ts", "user_id", F.to_date("ts").alias("day"))
    out = flows.run_to_table(flows.first_seen(rows, "ts", ["user_id", "day"], "2 days"), _name("first"), "append")
    return out.groupBy("day").agg(F.count("*").alias("users"))


def q_html_rows(spark: SparkSession, d: str) -> DataFrame:
    """SRC-09d/10a: rows of pages by the table function; the pages are built from the clusters."""
    esc = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    rows = table(spark, d, "hotspot_clusters").select("cluster_id", F.transform("cluster_items", lambda m: F.concat(F.lit('<article><a href="/i/'), m["item_id"].cast("string"), F.lit('"><h2>'), esc(m["title"]), F.lit("</h2></a></article>"))).alias("a"))
    pages = rows.select("cluster_id", F.concat(F.lit("<html><body>"), F.array_join("a", "\n"), F.lit("</body></html>")).alias("page"))
    spark.udtf.register("article_rows", html.ArticleRows)
    pages.createOrReplaceTempView("gleaner_pages")
    return spark.sql("SELECT cluster_id, link, origin FROM gleaner_pages, LATERAL article_rows(page)")



def q_scorer_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Papers scored in batches, with a deterministic fallback for what is not answered."""

    def model(pdf: pd.DataFrame) -> pd.DataFrame:
        ok = pdf[pdf["paper_id"] % 5 != 0]
        return pd.DataFrame({"paper_id": ok["paper_id"], "value": ok["title"].fillna("").str.len().astype("int32")})

    def heuristic(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"paper_id": pdf["paper_id"], "value": [0] * len(pdf)}).astype({"value": "int32"})

    return sc.with_fallback(table(spark, d, "papers").select("paper_id", "title"), "paper_id", model, heuristic, "paper_id long, value int")


def q_markdown_lists(spark: SparkSession, d: str) -> DataFrame:
    """Rendered lists per batch, by hash."""
    rows = table(spark, d, "hotspot_items").select("batch_id", "item_id", text.clean_text("title").alias("title"), "url")
    return sinks.markdown_list(rows, "batch_id", ["item_id"], "title", "url").select("batch_id", F.md5("body").alias("h"))


def q_role_weights(spark: SparkSession, d: str) -> DataFrame:
    """MAP-01: lookups with a default."""
    return table(spark, d, "sources").select("source_id", lookup(ROLE_WEIGHTS, F.col("source_role"), 2.5).alias("weight"))


QUERIES = {f.__name__: f for f in (
    q_stream_hourly, q_stream_sliding, q_stream_sessions, q_stream_totals, q_stream_first_seen, q_html_rows, q_scorer_fallback, q_markdown_lists, q_role_weights,
)}
SQL = {
    "q_stream_hourly": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "q_stream_sliding": """
        WITH e AS (SELECT ts, round(value * 100)::BIGINT AS cents FROM events), w AS (SELECT time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') AS b, cents FROM e), s AS (SELECT b AS start, cents FROM w UNION ALL SELECT b - INTERVAL 3 HOUR, cents FROM w)
        SELECT start, sum(cents)::BIGINT AS total, count(*) AS n FROM s GROUP BY 1""",
    "q_stream_sessions": """
        WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
        SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
    "q_stream_totals": "SELECT event_type, count(*) AS n, sum(round(value * 100))::BIGINT AS cents FROM events GROUP BY 1",
    "q_stream_first_seen": "SELECT ts::DATE AS day, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "q_html_rows": "SELECT cluster_id, '/i/' || unnest(cluster_items).item_id AS link, 'article' AS origin FROM hotspot_clusters",
    "q_scorer_fallback": "SELECT paper_id, CASE WHEN paper_id % 5 = 0 THEN 0 ELSE length(coalesce(title, '')) END::INT AS value, CASE WHEN paper_id % 5 = 0 THEN 'fallback' ELSE 'scorer' END AS \"by\" FROM papers",
    "q_markdown_lists": r"""
        WITH t AS (SELECT batch_id, item_id, '- [' || regexp_replace(trim(regexp_replace(coalesce(title, ''), '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')), '[\[\]]', '', 'g') || '](' || coalesce(url, '') || ')' AS line FROM hotspot_items)
        SELECT batch_id, md5(string_agg(line, chr(10) ORDER BY item_id)) AS h FROM t GROUP BY 1""",
    "q_role_weights": "SELECT source_id, CASE source_role " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ROLE_WEIGHTS.items()) + " ELSE 2.5 END::DOUBLE AS weight FROM sources",
}
