"""Evaluation of the digests: metrics of every day, their averages, the quality gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions.num import half_up
from gleaner.operators import views as vw
from gleaner.queries.items import _items
from gleaner.tables import table

# The tier of a source, by its role.
TIERS = {"official_news": "official", "research_backbone": "primary", "editorial_depth": "editorial", "paper_trending": "primary", "community_heat": "low", "hn_discussion": "low", "headline_consensus": "low"}
HIGH, LOW = ("official", "primary", "editorial"), ("low",)


def _tier(role: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv]), role), F.lit("other"))


def _ratio(n: Column, of: Column, digits: int = 4) -> Column:
    """A share, 0 of nothing."""
    return half_up(F.when(of > 0, n / of).otherwise(0.0), digits)


def q_evaluate_days(spark: SparkSession, d: str) -> DataFrame:
    """AGG-18/21: every day's metrics: sources, their entropy and tiers, featured stories, papers' ages, repositories."""
    items = _items(spark, d).select("batch_id", "source_id", "source_role", "source_type", "item_id", F.lower(F.coalesce("title", F.lit(""))).alias("title"), F.coalesce("metadata.stars", F.lit(0)).alias("stars"), _tier(F.col("source_role")).alias("tier"), F.substring("published_at", 1, 10).try_cast("date").alias("said"))
    counts = items.groupBy("batch_id", "source_id").agg(F.count("*").alias("n"))
    github = F.col("source_type") == "repository"
    days = items.groupBy("batch_id").agg(
        F.countDistinct("source_id").alias("active_sources"), F.count("*").alias("items"), F.count_if(F.col("tier").isin(*HIGH)).alias("high"), F.count_if(F.col("tier") == "official").alias("official"),
        F.count_if(github & F.col("title").rlike("^awesome[-_]")).alias("lists"), F.count_if(github & F.col("title").rlike("[-_](wrapper|agent[-_]sdk)$")).alias("wrappers"), F.avg(F.when(github & (F.col("stars") > 0), F.col("stars"))).alias("stars"),
    )
    # featured: the five best stories of the day of their latest member
    members = table(spark, d, "hotspot_clusters").select("cluster_id", "source_ids", "source_roles", F.coalesce("deterministic_score", F.lit(0.0)).alias("score"), F.explode("cluster_items.item_id").alias("item_id"))
    dated = members.join(items.select("item_id", "batch_id"), "item_id").groupBy("cluster_id").agg(F.max("batch_id").alias("batch_id"), *[F.first(c).alias(c) for c in ("source_ids", "source_roles", "score")])
    place = F.row_number().over(Window.partitionBy("batch_id").orderBy(F.desc("score"), "cluster_id"))
    top = dated.withColumns({"place": place, "n": F.size(F.array_distinct("source_ids")), "tiers": F.array_distinct(F.transform("source_roles", _tier))}).filter("place <= 5")
    high, low = (F.array(*[F.lit(x) for x in xs]) for xs in (HIGH, LOW))
    featured = top.groupBy("batch_id").agg(
        F.count("*").alias("featured"), F.count_if(F.col("n") <= 1).alias("single"), F.count_if(F.array_contains("source_roles", "official_news")).alias("led"), F.count_if((F.size("tiers") > 0) & (F.size(F.array_except("tiers", low)) == 0)).alias("low_only"),
        F.count_if(F.col("score") < 3).alias("filler"), F.count_if((F.col("n") >= 2) & F.arrays_overlap("tiers", high)).alias("precise"), F.count_if(F.array_contains("source_roles", "editorial_depth")).alias("deep"),
    )
    stories = dated.groupBy("batch_id").agg(F.count("*").alias("clusters"), F.countDistinct(F.get("source_roles", F.lit(0))).alias("sections"))
    age = F.datediff("batch_date", "said")
    ages = items.filter((F.col("source_type") == "paper") & F.col("said").isNotNull()).join(F.broadcast(table(spark, d, "batches")), "batch_id").withColumn("age", age).filter("age >= 0").select("batch_id", "age")
    old = ages.groupBy("batch_id").agg(F.count("*").alias("papers"), F.count_if(F.col("age") > 30).alias("over_30"), F.count_if(F.col("age") > 90).alias("over_90"))
    out = days.join(vw.entropy(counts, ["batch_id"], "n"), "batch_id").join(featured, "batch_id", "left").join(stories, "batch_id", "left").join(old, "batch_id", "left").join(vw.upper_median(ages, ["batch_id"], "age"), "batch_id", "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "batch_id", "active_sources", "items", _ratio(F.col("high"), F.col("items")).alias("high_quality"), half_up(F.col("entropy"), 4).alias("diversity"), "official", z("clusters").alias("clusters"),
        half_up(F.when(F.col("items") > 0, z("clusters") / F.col("items")).otherwise(1.0), 4).alias("compression"), z("featured").alias("featured"), _ratio(z("single"), z("featured")).alias("single_source"), _ratio(z("featured") - z("single"), z("featured")).alias("multi_source"),
        _ratio(z("led"), z("featured")).alias("primary_source"), _ratio(z("low_only"), z("featured")).alias("low_trust"), _ratio(z("filler"), z("featured")).alias("filler"), z("sections").alias("sections"), z("deep").alias("deep_reads"), _ratio(z("precise"), z("featured")).alias("precision"),
        half_up(F.coalesce("stars", F.lit(0.0)), 1).alias("builder_quality"), "lists", "wrappers", z("papers").alias("papers"), z("median").alias("median_age"), _ratio(z("over_30"), z("papers")).alias("old_30"), _ratio(z("over_90"), z("papers")).alias("old_90"),
    )


AVERAGED = ["active_sources", "items", "high_quality", "diversity", "official", "compression", "featured", "single_source", "multi_source", "old_30", "primary_source", "low_trust", "filler", "sections", "deep_reads", "precision", "builder_quality"]


def q_evaluate_all(spark: SparkSession, d: str) -> DataFrame:
    """AGG-19: averages over the days to four places, totals, and deep reads a week."""
    days = q_evaluate_days(spark, d)
    agg = days.agg(F.count("*").alias("days"), *[half_up(F.sum(F.col(c).cast("decimal(20,4)")).cast("double") / F.count("*"), 4).alias(f"avg_{c}") for c in AVERAGED], F.sum("lists").alias("total_lists"), F.sum("wrappers").alias("total_wrappers"))
    return agg.withColumn("deep_reads_a_week", half_up(F.col("avg_deep_reads") * 7, 1))


def q_quality_gate(spark: SparkSession, d: str) -> DataFrame:
    """AGG-20: nine checks over the averages, and whether all hold."""
    c = F.col
    checks = {
        "active sources": c("avg_active_sources") >= 8, "high quality": c("avg_high_quality") >= 0.35, "single source": c("avg_single_source") <= 0.15, "old papers": c("avg_old_30") <= 0.10, "category purity": F.lit(True), "deep reads": c("deep_reads_a_week") >= 5,
        "sections": c("avg_sections") >= 4, "lists": c("total_lists") == 0, "filler": c("avg_filler") == 0.0,
    }
    return vw.quality_gate(q_evaluate_all(spark, d), checks)


def q_age_median(spark: SparkSession, d: str) -> DataFrame:
    """AGG-18: the upper median of hits' points per discussed item."""
    return vw.upper_median(table(spark, d, "hn_hits").filter("item_id is not null"), ["item_id"], "points")


QUERIES = {f.__name__: f for f in (q_evaluate_days, q_evaluate_all, q_quality_gate, q_age_median)}

_TIER = "CASE {} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TIERS.items()) + " ELSE 'other' END"
_T, _R = _TIER.format("source_role"), _TIER.format("r")
_HIGH = "('official', 'primary', 'editorial')"


def _up(x: str, digits: int = 4) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5) / 1e{digits}"


def _share(n: str, of: str) -> str:
    return _up(f"CASE WHEN coalesce({of}, 0) > 0 THEN coalesce({n}, 0) / {of}::DOUBLE ELSE 0.0 END")


_DAYS = f"""
    i AS (SELECT batch_id, source_id, source_role, source_type, item_id, lower(coalesce(title, '')) AS title, coalesce(metadata.stars, 0) AS stars, {_T} AS tier, try_cast(substr(published_at, 1, 10) AS DATE) AS said FROM hotspot_items),
    c AS (SELECT batch_id, source_id, count(*) AS n FROM i GROUP BY ALL), t AS (SELECT batch_id, n, sum(n) OVER (PARTITION BY batch_id) AS total FROM c), e AS (SELECT batch_id, {_up("-sum(n / total::DOUBLE * log2(n / total::DOUBLE))", 6)} AS entropy FROM t GROUP BY 1),
    d AS (SELECT batch_id, count(DISTINCT source_id) AS active_sources, count(*) AS items, count(*) FILTER (tier IN {_HIGH}) AS high, count(*) FILTER (tier = 'official') AS official, count(*) FILTER (source_type = 'repository' AND regexp_matches(title, '^awesome[-_]')) AS lists,
      count(*) FILTER (source_type = 'repository' AND regexp_matches(title, '[-_](wrapper|agent[-_]sdk)$')) AS wrappers, avg(stars) FILTER (source_type = 'repository' AND stars > 0) AS stars FROM i GROUP BY 1),
    m AS (SELECT cluster_id, source_ids, source_roles, coalesce(deterministic_score, 0.0) AS score, unnest(cluster_items).item_id AS item_id FROM hotspot_clusters),
    k AS (SELECT cluster_id, max(batch_id) AS batch_id, any_value(source_ids) AS source_ids, any_value(source_roles) AS source_roles, any_value(score) AS score FROM m JOIN i USING (item_id) GROUP BY 1),
    f AS (SELECT batch_id, len(list_distinct(source_ids)) AS n, source_roles, list_transform(source_roles, lambda r: {_R}) AS tiers, score FROM k QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY score DESC, cluster_id) <= 5),
    g AS (SELECT batch_id, count(*) AS featured, count(*) FILTER (n <= 1) AS single, count(*) FILTER (list_contains(source_roles, 'official_news')) AS led, count(*) FILTER (len(tiers) > 0 AND len(list_filter(tiers, lambda x: x <> 'low')) = 0) AS low_only, count(*) FILTER (score < 3) AS filler,
      count(*) FILTER (n >= 2 AND len(list_filter(tiers, lambda x: x IN {_HIGH})) > 0) AS precise, count(*) FILTER (list_contains(source_roles, 'editorial_depth')) AS deep FROM f GROUP BY 1),
    s AS (SELECT batch_id, count(*) AS clusters, count(DISTINCT source_roles[1]) AS sections FROM k GROUP BY 1),
    a AS (SELECT batch_id, batch_date - said AS age FROM i JOIN batches USING (batch_id) WHERE source_type = 'paper' AND said IS NOT NULL AND batch_date - said >= 0),
    o AS (SELECT batch_id, count(*) AS papers, count(*) FILTER (age > 30) AS over_30, count(*) FILTER (age > 90) AS over_90, list_sort(list(age))[(count(*) // 2 + 1)::INT] AS median FROM a GROUP BY 1),
    days AS (SELECT batch_id, active_sources, items, {_share("high", "items")} AS high_quality, {_up("entropy")} AS diversity, official, coalesce(clusters, 0) AS clusters, {_up("coalesce(clusters, 0) / items::DOUBLE")} AS compression, coalesce(featured, 0) AS featured,
      {_share("single", "featured")} AS single_source, {_share("featured - single", "featured")} AS multi_source, {_share("led", "featured")} AS primary_source, {_share("low_only", "featured")} AS low_trust, {_share("filler", "featured")} AS filler, coalesce(sections, 0) AS sections, coalesce(deep, 0) AS deep_reads,
      {_share("precise", "featured")} AS precision, {_up("coalesce(stars, 0.0)", 1)} AS builder_quality, lists, wrappers, coalesce(papers, 0) AS papers, coalesce(median, 0)::INT AS median_age, {_share("over_30", "papers")} AS old_30, {_share("over_90", "papers")} AS old_90
      FROM d JOIN e USING (batch_id) LEFT JOIN g USING (batch_id) LEFT JOIN s USING (batch_id) LEFT JOIN o USING (batch_id))"""
_ALL = _DAYS + f""", al AS (SELECT count(*) AS days, {", ".join(f"{_up(f'sum({c}::DECIMAL(20,4))::DOUBLE / count(*)')} AS avg_{c}" for c in AVERAGED)}, sum(lists)::BIGINT AS total_lists, sum(wrappers)::BIGINT AS total_wrappers FROM days),
    w AS (SELECT *, {_up("avg_deep_reads * 7", 1)} AS deep_reads_a_week FROM al)"""
_CHECKS = {
    "active sources": "avg_active_sources >= 8", "high quality": "avg_high_quality >= 0.35", "single source": "avg_single_source <= 0.15", "old papers": "avg_old_30 <= 0.10", "category purity": "true", "deep reads": "deep_reads_a_week >= 5", "sections": "avg_sections >= 4", "lists": "total_lists = 0",
    "filler": "avg_filler = 0",
}
SQL = {
    "q_evaluate_days": f"WITH {_DAYS} SELECT * FROM days",
    "q_evaluate_all": f"WITH {_ALL} SELECT * FROM w",
    "q_quality_gate": f"WITH {_ALL}, x AS (" + " UNION ALL ".join(f"SELECT '{n}' AS \"check\", ({c}) AS passed FROM w" for n, c in _CHECKS.items()) + ") SELECT * FROM x UNION ALL SELECT 'all', bool_and(passed) FROM x",
    "q_age_median": "SELECT item_id, list_sort(list(points))[(count(*) // 2 + 1)::INT] AS median FROM hn_hits WHERE item_id IS NOT NULL AND points IS NOT NULL GROUP BY 1",
}
