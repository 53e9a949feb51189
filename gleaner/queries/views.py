"""Queries of the paper flow, rollups, views and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import url
from gleaner.functions.num import half_up
from gleaner.operators import papers as pp
from gleaner.operators import views as vw
from gleaner.operators.items import source_family
from gleaner.queries.items import _items
from gleaner.queries.stories import _FAM
from gleaner.tables import table

TOPICS = {
    "business": ["funding", "revenue", "price"], "hardware": ["chip", "memory", "rack"], "medicine": ["patient", "trial", "drug"],
    "robotics": ["gripper", "arm", "vehicle"], "science": ["proof", "sampling", "gradient"], "software": ["build", "debug", "kernel"],
}


def _papers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").join(F.broadcast(table(spark, d, "batches")), "batch_id")


def q_paper_topic(spark: SparkSession, d: str) -> DataFrame:
    """PRED-37: topics by weighted keywords in title and abstract."""
    dims = spark.createDataFrame(sorted(TOPICS.items()), "topic string, words array<string>")
    return pp.keyword_topics(table(spark, d, "papers"), "paper_id", {"title": 6, "abstract": 2}, dims, "topic", "words", "general")


def q_topic_alias(spark: SparkSession, d: str) -> DataFrame:
    """PRED-39, PRJ-08: the topic's full label by its number, the longest label of a topic being the full one."""
    rows = table(spark, d, "papers").filter("primary_topic_id is not null")
    full = rows.filter("primary_topic_label is not null").groupBy("primary_topic_id").agg(F.max_by("primary_topic_label", F.struct(F.length("primary_topic_label"), "primary_topic_label")).alias("label"))
    return rows.join(F.broadcast(full), "primary_topic_id", "left").groupBy("primary_topic_id", "label").agg(F.count("*").alias("n"), F.countDistinct("primary_topic_label").alias("spellings"))


def q_topic_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """AGG-10: papers per subject of the dimension, zeros included, and conditional sums."""
    n = table(spark, d, "papers").groupBy("primary_topic_id").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 15).alias("high"), F.count_if(F.col("review_comment").isNull()).alias("unreviewed"))
    dim = table(spark, d, "subjects").select("subject_id").union(table(spark, d, "papers").select("primary_topic_id").filter("primary_topic_id is not null")).distinct()
    return dim.join(n, dim["subject_id"] == n["primary_topic_id"], "left").select("subject_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "high", "unreviewed")])


def q_topic_groups(spark: SparkSession, d: str) -> DataFrame:
    """AGG-11, SORT-02: the ten best papers of each topic in order."""
    w = Window.partitionBy("primary_topic_id").orderBy(F.desc_nulls_last("score"), F.desc_nulls_last("relevance"), "paper_id")
    return table(spark, d, "papers").withColumn("place", F.row_number().over(w)).filter("place <= 10").select("primary_topic_id", "paper_id", "place")


def q_spotlight(spark: SparkSession, d: str) -> DataFrame:
    """WIN-12/13, NUM-05: per batch the newest by novelty, then the hottest by score among the others."""
    first = ((F.col("novelty") >= 8), [F.desc("novelty"), F.desc("score"), F.asc("paper_id")], 2)
    second = ((F.col("score") >= 12), [F.desc("score"), F.desc("relevance"), F.asc("paper_id")], 3)
    return pp.two_stage_pick(table(spark, d, "papers").filter("novelty is not null and score is not null and relevance is not null"), "batch_id", first, second, "paper_id")


def q_diversion(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-10: papers left in the list once the spotlight has taken its own."""
    return table(spark, d, "papers").join(q_spotlight(spark, d).select("paper_id"), "paper_id", "left_anti").groupBy("batch_id").agg(F.count("*").alias("n"))


def _monthly(spark: SparkSession, d: str) -> DataFrame:
    order = [F.desc_nulls_last("score"), F.desc_nulls_last("relevance"), F.asc("paper_id")]
    return pp.monthly_best(_papers(spark, d).filter("title is not null"), F.date_format("batch_date", "yyyy-MM"), "title", order)


def q_monthly_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """AGG-16: per month and title the best paper."""
    return _monthly(spark, d).select("month", "paper_id")


def q_monthly_priority(spark: SparkSession, d: str) -> DataFrame:
    """NUM-07: a weighted priority with keyword bonuses."""
    low = F.lower(F.concat_ws(" ", "title", "abstract"))
    bonus = sum(F.when(F.contains(low, F.lit(w)), b).otherwise(0) for w, b in (("proof", 30), ("open", 15), ("bound", 20), ("survey", -25)))
    base = 20 * F.coalesce("score", F.lit(0)) + 12 * F.coalesce("relevance", F.lit(0)) + 10 * F.coalesce("novelty", F.lit(0))
    return table(spark, d, "papers").select("paper_id", (base + bonus - F.when((F.coalesce("relevance", F.lit(0)) == 0) & (F.coalesce("novelty", F.lit(0)) == 0), 300).otherwise(0)).alias("priority"))


def q_monthly_caps(spark: SparkSession, d: str) -> DataFrame:
    """WIN-04: a monthly digest under caps per topic and in all."""
    order = [F.desc_nulls_last("score"), F.desc_nulls_last("relevance"), F.asc("paper_id")]
    rows = _monthly(spark, d).filter("primary_topic_id is not null")
    return pp.digest_caps(rows, "primary_topic_id", order, 12, 48).select("month", "primary_topic_id", "paper_id", "in_topic")


def q_source_hash(spark: SparkSession, d: str) -> DataFrame:
    """AGG-17: a hash of each batch's papers."""
    return pp.content_hash(table(spark, d, "papers"), "batch_id", "paper_id", ["arxiv_id", "title", "score"])


def q_root_index(spark: SparkSession, d: str) -> DataFrame:
    """AGG-12/13/14: items by day, month, year and in all."""
    days = _items(spark, d).select(F.to_date("fetched_at").alias("d"), F.coalesce("metadata.upvotes", F.lit(0)).cast("long").alias("upvotes"))
    return vw.calendar_rollup(days, "d", ["upvotes"])


def q_month_index(spark: SparkSession, d: str) -> DataFrame:
    """AGG-13, MAP-01: items of each family by month, in long form."""
    rows = _items(spark, d).withColumns({"month": F.date_format("fetched_at", "yyyy-MM"), "family": source_family(F.col("source_role"), F.col("source_type"))})
    return rows.groupBy("month", "family").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("sources"))


def q_cube_counts(spark: SparkSession, d: str) -> DataFrame:
    """AGG-21: events by type and day of the week, with all margins."""
    rows = table(spark, d, "events").withColumn("dow", F.dayofweek("ts"))
    return rows.cube("event_type", "dow").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def q_archive_stats(spark: SparkSession, d: str) -> DataFrame:
    """AGG-15: orders by month: active days, orders, customers."""
    return table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.countDistinct("o_orderdate").alias("days"), F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("customers"))


def q_prev_next(spark: SparkSession, d: str) -> DataFrame:
    """WIN-05: neighbouring days that have items."""
    return vw.neighbours(_items(spark, d).select(F.to_date("fetched_at").alias("day")), "day")


def q_source_mix(spark: SparkSession, d: str) -> DataFrame:
    """AGG-28: tags by frequency; the rank is counted over the distinct frequencies, not over all tags."""
    n = _items(spark, d).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    # few frequencies are distinct, however many tags there are
    levels = n.groupBy("n").agg(F.count("*").alias("_m"))
    before = F.coalesce(F.sum("_m").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return n.join(levels.withColumn("place", (before + 1).cast("int")).drop("_m"), "n").select("tag", "n", "place")


def q_search(spark: SparkSession, d: str) -> DataFrame:
    """PRED-41: full-text containment over several fields."""
    return vw.search(_items(spark, d), ["title", "summary", "source_name"], "Release").select("item_id")


def q_sorted_view(spark: SparkSession, d: str) -> DataFrame:
    """The head of a view sorted by several keys, nulls last, ties by key."""
    rows = table(spark, d, "hn_hits").select("object_id", "item_id", "points", "num_comments").dropDuplicates()
    w = Window.orderBy(F.desc_nulls_last("points"), F.desc_nulls_last("num_comments"), "object_id")
    return rows.orderBy(F.desc_nulls_last("points"), F.desc_nulls_last("num_comments"), "object_id").limit(100).withColumn("place", F.row_number().over(w)).select("object_id", "points", "place")


def q_merge_sections(spark: SparkSession, d: str) -> DataFrame:
    """AGG-26: two lists of clusters merged by type, each cluster once, candidates summed."""
    c = table(spark, d, "hotspot_clusters").select("cluster_id", F.explode("source_types").alias("kind"), F.coalesce("deterministic_score", F.lit(0.0)).alias("score"))
    merged = c.filter("score >= 5").unionByName(c.filter("score < 8")).dropDuplicates(["kind", "cluster_id"])
    return merged.groupBy("kind").agg(F.count("*").alias("clusters"))


def q_source_health(spark: SparkSession, d: str) -> DataFrame:
    """Per batch: active sources, single-source share, entropy of sources."""
    counts = _items(spark, d).groupBy("batch_id", "source_id").agg(F.count("*").alias("n"))
    ent = vw.entropy(counts, ["batch_id"], "n")
    base = counts.groupBy("batch_id").agg(F.count("*").alias("sources"), F.sum("n").alias("items"), half_up(F.max("n") / F.sum("n"), 6).alias("top_share"))
    return base.join(ent, "batch_id")



def q_gate_scenarios(spark: SparkSession, d: str) -> DataFrame:
    """PRED-43: three date gates simulated over all batches."""
    rows = _items(spark, d).join(F.broadcast(table(spark, d, "batches")), "batch_id").withColumn("target", F.col("batch_date").cast("timestamp"))
    return vw.gate_scenarios(rows, [("narrow", 6, 12, True), ("wide", 36, 30, True), ("strict", 0, 18, False)], F.col("fetched_at"), F.col("target"), "source_role")


def q_day_overlap(spark: SparkSession, d: str) -> DataFrame:
    """SET-09: addresses shared by consecutive batches, in percent of both."""
    u = _items(spark, d).select("batch_id", url.address().alias("addr")).filter("addr is not null").distinct()
    n = u.groupBy("batch_id").agg(F.count("*").alias("n"))
    both = u.join(u.select((F.col("batch_id") - 1).alias("batch_id"), "addr"), ["batch_id", "addr"]).groupBy("batch_id").agg(F.count("*").alias("both_n"))
    pairs = n.join(n.select((F.col("batch_id") - 1).alias("batch_id"), F.col("n").alias("m")), "batch_id").join(both, "batch_id", "left")
    shared = F.coalesce("both_n", F.lit(0))
    return pairs.select("batch_id", half_up(100.0 * shared / (F.col("n") + F.col("m") - shared), 4).alias("percent"))


QUERIES = {f.__name__: f for f in (
    q_paper_topic, q_topic_alias, q_topic_diagnostics, q_topic_groups, q_spotlight, q_diversion, q_monthly_dedupe, q_monthly_priority, q_monthly_caps, q_source_hash, q_root_index,
    q_month_index, q_cube_counts, q_archive_stats, q_prev_next, q_source_mix, q_search, q_sorted_view, q_merge_sections, q_source_health, q_gate_scenarios, q_day_overlap,
)}


def _points(words: list[str]) -> str:
    return " + ".join(f"CASE WHEN contains(lower(coalesce({f}, '')), '{w}') THEN {k} ELSE 0 END" for f, k in (("title", 6), ("abstract", 2)) for w in words)


_TOPIC_SCORES = ", ".join(f"{{'score': {_points(w)}, 'ord': {-i}, 'name': '{n}'}}" for i, (n, w) in enumerate(sorted(TOPICS.items())))
_SPOT = """a AS (SELECT batch_id, paper_id, 'first' AS kind, row_number() OVER (PARTITION BY batch_id ORDER BY novelty DESC, score DESC, paper_id) AS place FROM v WHERE novelty >= 8 QUALIFY place <= 2),
  b AS (SELECT batch_id, paper_id, 'second' AS kind, row_number() OVER (PARTITION BY batch_id ORDER BY score DESC, relevance DESC, paper_id) AS place FROM v WHERE score >= 12 AND paper_id NOT IN (SELECT paper_id FROM a) QUALIFY place <= 3)"""
_V = "v AS (SELECT * FROM papers WHERE novelty IS NOT NULL AND score IS NOT NULL AND relevance IS NOT NULL)"
_ORDER = "ORDER BY score DESC NULLS LAST, relevance DESC NULLS LAST, paper_id"
_MONTHLY = f"SELECT *, strftime(batch_date, '%Y-%m') AS month FROM papers JOIN batches USING (batch_id) WHERE title IS NOT NULL QUALIFY row_number() OVER (PARTITION BY strftime(batch_date, '%Y-%m'), title {_ORDER}) = 1"
SQL = {
    "q_paper_topic": f"""
        WITH t AS (SELECT paper_id, list_max([{_TOPIC_SCORES}]) AS best FROM papers) SELECT paper_id, CASE WHEN best.score >= 1 THEN best.name ELSE 'general' END AS topic, best.score AS score FROM t""",
    "q_topic_alias": """
        WITH r AS (SELECT * FROM papers WHERE primary_topic_id IS NOT NULL), f AS (SELECT primary_topic_id, arg_max(primary_topic_label, {'n': length(primary_topic_label), 'l': primary_topic_label}) AS label FROM r WHERE primary_topic_label IS NOT NULL GROUP BY 1)
        SELECT primary_topic_id, label, count(*) AS n, count(DISTINCT primary_topic_label) AS spellings FROM r LEFT JOIN f USING (primary_topic_id) GROUP BY 1, 2""",
    "q_topic_diagnostics": """
        WITH d AS (SELECT subject_id FROM subjects UNION SELECT primary_topic_id FROM papers WHERE primary_topic_id IS NOT NULL)
        SELECT subject_id, count(paper_id) AS n, count(*) FILTER (score >= 15) AS high, count(*) FILTER (paper_id IS NOT NULL AND review_comment IS NULL) AS unreviewed FROM d LEFT JOIN papers ON primary_topic_id = subject_id GROUP BY 1""",
    "q_topic_groups": f"SELECT primary_topic_id, paper_id, row_number() OVER (PARTITION BY primary_topic_id {_ORDER}) AS place FROM papers QUALIFY place <= 10",
    "q_spotlight": f"WITH {_V}, {_SPOT} SELECT * FROM a UNION ALL SELECT * FROM b",
    "q_diversion": f"WITH {_V}, {_SPOT} SELECT batch_id, count(*) AS n FROM papers WHERE paper_id NOT IN (SELECT paper_id FROM a UNION ALL SELECT paper_id FROM b) GROUP BY 1",
    "q_monthly_dedupe": f"SELECT month, paper_id FROM ({_MONTHLY})",
    "q_monthly_priority": """
        WITH t AS (SELECT *, lower(concat_ws(' ', title, abstract)) AS low FROM papers)
        SELECT paper_id, (20 * coalesce(score, 0) + 12 * coalesce(relevance, 0) + 10 * coalesce(novelty, 0) + CASE WHEN contains(low, 'proof') THEN 30 ELSE 0 END + CASE WHEN contains(low, 'open') THEN 15 ELSE 0 END
          + CASE WHEN contains(low, 'bound') THEN 20 ELSE 0 END - CASE WHEN contains(low, 'survey') THEN 25 ELSE 0 END - CASE WHEN coalesce(relevance, 0) = 0 AND coalesce(novelty, 0) = 0 THEN 300 ELSE 0 END)::INT AS priority FROM t""",
    "q_monthly_caps": f"""
        WITH m AS (SELECT * FROM ({_MONTHLY}) WHERE primary_topic_id IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY month, primary_topic_id {_ORDER}) AS in_topic FROM m QUALIFY in_topic <= 12),
        r AS (SELECT *, count(*) FILTER (in_topic = 1) OVER (PARTITION BY month) AS f, row_number() OVER (PARTITION BY month, in_topic = 1 {_ORDER}) AS g FROM k)
        SELECT month, primary_topic_id, paper_id, in_topic FROM r WHERE in_topic = 1 OR g <= 48 - f""",
    "q_source_hash": """
        WITH h AS (SELECT batch_id, sha256(paper_id || chr(31) || coalesce(arxiv_id, chr(0)) || chr(31) || coalesce(title, chr(0)) || chr(31) || coalesce(score::VARCHAR, chr(0))) AS h FROM papers)
        SELECT batch_id, count(*) AS n, sha256(sum(('0x' || substr(h, 1, 15))::HUGEINT) || '-' || sum(('0x' || substr(h, 16, 15))::HUGEINT) || '-' || sum(('0x' || substr(h, 31, 15))::HUGEINT) || '-' || sum(('0x' || substr(h, 46, 15))::HUGEINT)) AS hash FROM h GROUP BY 1""",
    "q_root_index": """
        WITH t AS (SELECT fetched_at::DATE AS day, coalesce(metadata.upvotes, 0) AS upvotes FROM hotspot_items), p AS (SELECT year(day)::INT AS year, strftime(day, '%Y-%m') AS month, day, upvotes FROM t)
        SELECT year, month, day, grouping(year, month, day)::INT AS level, sum(upvotes)::BIGINT AS upvotes, count(*) AS rows FROM p GROUP BY ROLLUP (year, month, day)""",
    "q_month_index": f"SELECT strftime(fetched_at, '%Y-%m') AS month, {_FAM} AS family, count(*) AS n, count(DISTINCT source_id) AS sources FROM hotspot_items GROUP BY 1, 2",
    "q_cube_counts": "WITH t AS (SELECT event_type, (dayofweek(ts) + 1)::INT AS dow FROM events) SELECT event_type, dow, count(*) AS n, grouping(event_type, dow)::INT AS level FROM t GROUP BY CUBE (event_type, dow)",
    "q_archive_stats": "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(DISTINCT o_orderdate) AS days, count(*) AS orders, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1",
    "q_prev_next": "WITH d AS (SELECT DISTINCT fetched_at::DATE AS day FROM hotspot_items) SELECT day, lag(day) OVER (ORDER BY day) AS previous, lead(day) OVER (ORDER BY day) AS next FROM d",
    "q_source_mix": "WITH n AS (SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM hotspot_items) GROUP BY 1) SELECT tag, n, rank() OVER (ORDER BY n DESC) AS place FROM n",
    "q_search": "SELECT item_id FROM hotspot_items WHERE contains(lower(concat_ws(' ', title, summary, source_name)), 'release')",
    "q_sorted_view": """
        WITH h AS (SELECT DISTINCT object_id, item_id, points, num_comments FROM hn_hits), r AS (SELECT *, row_number() OVER (ORDER BY points DESC NULLS LAST, num_comments DESC NULLS LAST, object_id) AS place FROM h)
        SELECT object_id, points, place FROM r WHERE place <= 100""",
    "q_merge_sections": """
        WITH c AS (SELECT cluster_id, unnest(source_types) AS kind, coalesce(deterministic_score, 0.0) AS score FROM hotspot_clusters)
        SELECT kind, count(DISTINCT cluster_id) AS clusters FROM c WHERE score >= 5 OR score < 8 GROUP BY 1""",
    "q_source_health": """
        WITH c AS (SELECT batch_id, source_id, count(*) AS n FROM hotspot_items GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY batch_id)::DOUBLE AS p FROM c)
        SELECT batch_id, count(*) AS sources, sum(n)::BIGINT AS items, floor(max(n) / sum(n)::DOUBLE * 1000000 + 0.5) / 1000000 AS top_share, floor(-sum(p * log2(p)) * 1000000 + 0.5) / 1000000 AS entropy FROM p GROUP BY 1""",
    "q_gate_scenarios": """
        WITH r AS (SELECT source_role, fetched_at AS f, batch_date::TIMESTAMP AS t FROM hotspot_items JOIN batches USING (batch_id)), s(scenario, b, a, u) AS (VALUES ('narrow', 6, 12, true), ('wide', 36, 30, true), ('strict', 0, 18, false))
        SELECT scenario, source_role, count(*) FILTER (coalesce(f >= t - to_hours(b) AND f <= t + to_hours(a), u)) AS kept, count(*) AS seen FROM r, s GROUP BY 1, 2""",
    "q_day_overlap": """
        WITH u AS (SELECT DISTINCT batch_id, coalesce(nullif(trim(canonical_url), ''), nullif(trim(url), '')) AS addr FROM hotspot_items WHERE coalesce(nullif(trim(canonical_url), ''), nullif(trim(url), '')) IS NOT NULL), n AS (SELECT batch_id, count(*) AS n FROM u GROUP BY 1),
        b AS (SELECT u.batch_id, count(*) AS k FROM u JOIN u v ON v.batch_id = u.batch_id + 1 AND v.addr = u.addr GROUP BY 1)
        SELECT n.batch_id, floor(100.0::DOUBLE * coalesce(k, 0) / (n.n + m.n - coalesce(k, 0)) * 10000 + 0.5) / 10000 AS percent FROM n JOIN n m ON m.batch_id = n.batch_id + 1 LEFT JOIN b ON b.batch_id = n.batch_id""",
}
