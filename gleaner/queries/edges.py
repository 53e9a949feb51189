"""Queries over the remaining row-level operators: sources and files, links and titles, projections, guards, accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import fixed, text, url
from gleaner.functions.num import half_up
from gleaner.operators import items as op
from gleaner.queries.items import _items
from gleaner.sources import readers
from gleaner.tables import table

MEDIA = r"\.(png|jpe?g|gif|svg|mp4|webp)$"
GENERIC = r"^(read more|learn more|home|about|contact|blog|news|next|previous|subscribe|sign in|log in)$"


def q_daily_files(spark: SparkSession, d: str) -> DataFrame:
    """SRC-21/22/25: of each date's files the one whose suffix comes first."""
    suffix = F.element_at(F.array(F.lit("latest"), F.lit("output"), F.lit("daily-papers"), F.lit("notes")), (F.col("batch_id") % 4 + 1).cast("int"))
    base = table(spark, d, "batches").select("batch_id", "batch_date", suffix.alias("a"), F.when(F.col("batch_id") % 3 == 0, "output").otherwise("latest").alias("b"))
    names = base.select(F.explode(F.array("a", "b")).alias("s"), "batch_date").select(F.concat(F.lit("json/"), F.date_format("batch_date", "yyyy-MM"), F.lit("/"), F.date_format("batch_date", "yyyy-MM-dd"), F.lit("-"), "s", F.lit(".json")).alias("path"))
    return readers.daily_files(names.distinct(), "path", ["output", "daily-papers", "latest"])


def q_asof_file(spark: SparkSession, d: str) -> DataFrame:
    """DT-05, JOIN-06: the latest of the files above not after a target, within its staleness."""
    return readers.as_of(q_daily_files(spark, d), F.lit("2026-01-15").cast("date"), 2)


def q_payload_shapes(spark: SparkSession, d: str) -> DataFrame:
    """SRC-19/23: papers out of flat and bundled payloads, one payload per batch, both shapes in turn."""
    entry = F.struct(F.col("paper_id").cast("string").alias("k"), F.struct(F.coalesce("score", F.lit(0)).alias("score")).alias("v"))
    flat = table(spark, d, "papers").groupBy("batch_id").agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    payload = flat.select(F.when(F.col("batch_id") % 2 == 0, F.to_json(F.struct(F.lit(2).alias("schema_version"), F.col("m").alias("papers")))).otherwise(F.to_json("m")).alias("j"))
    return readers.papers_of(payload, "j", "struct<score: int>").select(F.col("number").cast("long").alias("paper_id"), "score")



def q_union_sources(spark: SparkSession, d: str) -> DataFrame:
    """SET-02: items, papers and hits as one relation, deduplicated by address, counted by origin."""
    a = _items(spark, d).select(F.lit("items").alias("origin"), "item_id", url.address().alias("addr"))
    b = table(spark, d, "hn_hits").select(F.lit("hits").alias("origin"), F.col("item_id"), F.nullif(F.trim("url"), F.lit("")).alias("addr"))
    both = a.unionByName(b).filter("addr is not null")
    one = both.groupBy("addr").agg(F.min(F.when(F.col("origin") == "items", 0).otherwise(1)).alias("o"))
    return one.groupBy(F.when(F.col("o") == 0, "items").otherwise("hits").alias("origin")).agg(F.count("*").alias("n"))


def q_raw_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """SRC-19: items to JSON text and back by schema, nothing lost."""
    rows = _items(spark, d).select("item_id", F.to_json(F.struct("title", "tags", "metadata")).alias("j"))
    back = F.from_json("j", "title string, tags array<string>, metadata struct<stars: int, host: string>")
    return rows.select("item_id", F.md5(F.coalesce(back["title"], F.lit(""))).alias("h"), F.coalesce(F.size(back["tags"]), F.lit(-1)).alias("tags"), back["metadata"]["stars"].alias("stars"))


def q_number_coercion(spark: SparkSession, d: str) -> DataFrame:
    """SRC-27, JSON-02: numbers in text: per-unit rates times a million, what is no number left out."""
    rate = F.when(F.col("p_partkey") % 5 == 0, F.lit("n/a")).otherwise(F.format_string("%.3f", F.col("p_retailprice")))
    return table(spark, d, "part").select("p_partkey", half_up(rate.try_cast("double") * 1000, 0).cast("long").alias("per_mille")).filter("per_mille is not null")


def q_heat_labels(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-16: the first positive engagement figure and a compact form of it."""
    m = F.col("metadata")
    pick = F.coalesce(*[F.when(m[c] > 0, F.struct(F.lit(c).alias("kind"), m[c].alias("n"))) for c in ("activity", "stars", "hn_score", "upvotes")])
    short = F.when(pick["n"] >= 1000, F.concat((F.floor(pick["n"] / 100) / 10).cast("string"), F.lit("k"))).otherwise(pick["n"].cast("string"))
    return _items(spark, d).select("item_id", pick["kind"].alias("kind"), short.alias("short")).filter("kind is not null")


def q_routes(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-05/17: routes of days, and the nearest that exists: the day, else its month, else the root."""
    has = _items(spark, d).filter("batch_id % 7 <> 0").select(F.to_date("fetched_at").alias("batch_date")).distinct().withColumn("hit", F.lit(1))
    return table(spark, d, "batches").join(has, "batch_date", "left").select("batch_id", F.when(F.col("hit").isNotNull(), F.date_format("batch_date", "'/d/'yyyy/MM/dd")).when(F.month("batch_date") != 12, F.date_format("batch_date", "'/m/'yyyy/MM")).otherwise(F.lit("/")).alias("route"))


def q_compact_topics(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-04, LIM-03: clusters in compact form: two pieces of evidence, a tier, a short text."""
    tier = F.when(F.array_contains("source_roles", "official_news"), "official").when(F.size("source_ids") >= 3, "wide").otherwise("single")
    evidence = F.array_join(F.transform(F.slice(F.array_sort(F.transform("cluster_items", lambda m: m["item_id"])), 1, 2), lambda x: x.cast("string")), ",")
    return table(spark, d, "hotspot_clusters").select("cluster_id", evidence.alias("evidence"), tier.alias("tier"), F.md5(text.concise(text.clean_text("summary"), 160)).alias("h"))


def q_merge_back(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-20: a second text laid over the first where there is one, with a fallback."""
    hits = table(spark, d, "hn_hits").filter("item_id is not null and title is not null").groupBy("item_id").agg(F.min("title").alias("other"))
    return _items(spark, d).join(hits, "item_id", "left").select("item_id", F.md5(F.coalesce("other", "title", F.lit(""))).alias("h"), F.col("other").isNotNull().alias("replaced"))


def q_effective_date(spark: SparkSession, d: str) -> DataFrame:
    """PRED-06: the date that counts: the fetch time for repositories, else the batch's date."""
    rows = _items(spark, d).join(F.broadcast(table(spark, d, "batches")), "batch_id")
    day = F.when(F.col("source_id") == "github_trend", F.to_date("fetched_at")).otherwise(F.col("batch_date"))
    return rows.groupBy(day.alias("day")).agg(F.count("*").alias("n"))


def q_link_predicates(spark: SparkSession, d: str) -> DataFrame:
    """PRED-20: media links, paper links, generic titles and links that leave their source."""
    u, h = F.lower(F.coalesce("url", F.lit(""))), url.host(F.coalesce("url", F.lit("")))
    rows = _items(spark, d).join(F.broadcast(table(spark, d, "sources").select("source_id", F.col("host").alias("own"))), "source_id", "left")
    return rows.groupBy("source_id").agg(
        F.count_if(u.rlike(MEDIA)).alias("media"), F.count_if(u.rlike(r"/(abs|pdf)/")).alias("papers"), F.count_if(F.lower(text.clean_text("title")).rlike(GENERIC)).alias("generic"),
        F.count_if((h != "") & (h != F.coalesce("own", F.lit("")))).alias("external"),
    )


def q_regression_guard(spark: SparkSession, d: str) -> DataFrame:
    """PRED-27: would a new snapshot lose too much? Sources of the last batches against those of all."""
    a = _items(spark, d).agg(F.countDistinct("source_id").alias("old_n"))
    b = _items(spark, d).filter("batch_id > 178").agg(F.countDistinct("source_id").alias("new_n"))
    return a.crossJoin(F.broadcast(b)).select("old_n", "new_n", (F.col("new_n") < 0.5 * F.col("old_n")).alias("guarded"))


def q_closed_months(spark: SparkSession, d: str) -> DataFrame:
    """PRED-29: months that are over at a given day."""
    now = F.lit("2026-03-31").cast("date")
    month = F.last_day("batch_date")
    return table(spark, d, "batches").groupBy(month.alias("month_end")).agg(F.count("*").alias("batches")).select("month_end", "batches", ((F.col("month_end") < now) | (F.col("month_end") == now)).alias("closed"))


def q_source_signatures(spark: SparkSession, d: str) -> DataFrame:
    """SET-08: signatures of clusters by their sources; clusters of papers alone."""
    paper_only = F.size(F.array_except("source_roles", F.array(F.lit("paper_trending"), F.lit("research_backbone")))) == 0
    return table(spark, d, "hotspot_clusters").groupBy(F.array_join(F.array_sort("source_types"), "+").alias("signature")).agg(F.count("*").alias("n"), F.count_if(paper_only).alias("paper_only"))


def q_paper_kinds(spark: SparkSession, d: str) -> DataFrame:
    """ARR-01: kinds a paper qualifies for, in registry order, and the first."""
    kinds = F.array_compact(F.array(F.when((F.col("novelty") >= 8) & (F.col("score") >= 14), "frontier"), F.when((F.col("relevance") >= 8) & (F.col("score") >= 14), "hot")))
    return table(spark, d, "papers").select("paper_id", F.array_join(kinds, ",").alias("kinds"), F.get(kinds, F.lit(0)).alias("first")).filter("kinds <> ''")


def q_usage_totals(spark: SparkSession, d: str) -> DataFrame:
    """Requests and items by provider family, largest first."""
    family = F.regexp_extract("source_id", r"^([a-z]+)", 1)
    rows = _items(spark, d).groupBy(family.alias("provider")).agg(F.countDistinct("batch_id", "source_id").alias("requests"), F.count("*").alias("items"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("items"), "provider")))


def q_artifact_share(spark: SparkSession, d: str) -> DataFrame:
    """AGG-09: the largest share of a category's patterns that a text matches."""
    low = F.lower(F.concat_ws(" ", "title", "summary"))
    groups = {"code": [r"\bcode\b", r"\bbuild", r"\bdebug"], "data": [r"\bdata\b", r"\bset", r"\bsampl"], "model": [r"\bmodel", r"\bweights\b", r"\btraining"]}
    scores = [F.least(F.lit(1.0), text.pattern_hits(low, p) / F.lit(max(0.5 * len(p), 1.0))) for p in groups.values()]
    return _items(spark, d).select("item_id", half_up(F.greatest(*scores), 4).alias("share")).filter("share > 0")


def q_monthly_order(spark: SparkSession, d: str) -> DataFrame:
    """SORT-03, WIN-14: papers of a month numbered by six keys."""
    rows = table(spark, d, "papers").join(F.broadcast(table(spark, d, "batches")), "batch_id")
    w = Window.partitionBy(F.date_format("batch_date", "yyyy-MM")).orderBy(F.desc_nulls_last("score"), F.desc_nulls_last("relevance"), F.desc_nulls_last("novelty"), F.desc("batch_date"), F.desc("paper_id"))
    return rows.select("paper_id", F.row_number().over(w).alias("place"))



def q_anchor_choice(spark: SparkSession, d: str) -> DataFrame:
    """TXT-17: of the members of a cluster the one whose title shares most words with the cluster's; shorter, then earlier wins."""
    words = text.words(F.col("title"))
    scored = F.transform("cluster_items", lambda m: F.struct(F.size(F.array_intersect(text.words(m["title"]), words)).alias("score"), (-F.length(F.coalesce(m["title"], F.lit("")))).alias("short"), (-m["item_id"]).alias("early")))
    return table(spark, d, "hotspot_clusters").select("cluster_id", (-F.array_max(scored)["early"]).alias("item_id"))


def q_handles(spark: SparkSession, d: str) -> DataFrame:
    """TXT-19: names reduced to handles, with a profile text of their parts."""
    n = F.trim("author")
    handle = F.regexp_replace(F.regexp_replace(F.lower(n), "^@", ""), "[^a-z0-9]+", "_")
    return table(spark, d, "hn_hits").filter("author is not null").groupBy(handle.alias("handle")).agg(F.count("*").alias("n"), F.min(F.concat_ws(" ", n, F.lit("hits"))).alias("profile"))


def q_summary_echo(spark: SparkSession, d: str) -> DataFrame:
    """TXT-25: summaries that begin like their title; lines set off by a mark."""
    t, s = F.lower(text.clean_text("title")), F.lower(text.clean_text("summary"))
    echo = (F.length(t) >= 10) & F.startswith(s, F.substring(t, 1, 10))
    return _items(spark, d).select("item_id", echo.alias("echo"), F.md5(F.regexp_replace(F.coalesce("summary", F.lit("")), r"(?m)^", "> ")).alias("h")).filter("echo")


def q_number_order(spark: SparkSession, d: str) -> DataFrame:
    """NUM-10: papers by the order of their numbers."""
    n = F.regexp_extract("arxiv_id", r"([0-9]{4}\.[0-9]{5})", 1)
    rows = table(spark, d, "papers").select("paper_id", n.alias("number")).filter("number <> ''")
    return rows.groupBy(F.replace("number", F.lit("."), F.lit("")).cast("long").alias("order")).agg(F.min("paper_id").alias("first"), F.count("*").alias("n"))


def q_document_digest(spark: SparkSession, d: str) -> DataFrame:
    """All rows of a batch made one document: a count, the longest title and the sum of scores, in one pass."""
    return table(spark, d, "papers").groupBy("batch_id").agg(F.count("*").alias("n"), F.max(F.length("title")).alias("longest"), F.sum("score").alias("score"))


QUERIES = {f.__name__: f for f in (
    q_daily_files, q_asof_file, q_payload_shapes, q_union_sources, q_raw_roundtrip, q_number_coercion, q_heat_labels, q_routes, q_compact_topics, q_merge_back, q_effective_date,
    q_link_predicates, q_regression_guard, q_closed_months, q_source_signatures, q_paper_kinds, q_usage_totals, q_artifact_share, q_monthly_order, q_anchor_choice, q_handles,
    q_summary_echo, q_number_order, q_document_digest,
)}

_SP = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_STOP = "[" + ", ".join(f"'{w}'" for w in fixed.STOPWORDS) + "]"


def _clean(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{_SP}', ' ', 'g'))"


def _w(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+'), lambda x: NOT list_contains({_STOP}, x))"


def _hit(p: list[str]) -> str:
    return " + ".join(f"regexp_matches(b, '{x}')::INT" for x in p)


_FILES = """
    WITH b AS (SELECT batch_date, ['latest', 'output', 'daily-papers', 'notes'][(batch_id % 4 + 1)::INT] AS a, CASE WHEN batch_id % 3 = 0 THEN 'output' ELSE 'latest' END AS b FROM batches),
    n AS (SELECT DISTINCT batch_date AS date, unnest([a, b]) AS s FROM b),
    f AS (SELECT date, 'json/' || strftime(date, '%Y-%m') || '/' || strftime(date, '%Y-%m-%d') || '-' || s || '.json' AS path, list_position(['output', 'daily-papers', 'latest'], s) AS r FROM n WHERE s <> 'notes'),
    g AS (SELECT date, path FROM f QUALIFY row_number() OVER (PARTITION BY date ORDER BY r, path) = 1)"""
_HOST = r"lower(regexp_extract(trim(coalesce(url, '')), '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', 2))"
SQL = {
    "q_daily_files": f"{_FILES} SELECT date, path FROM g",
    "q_asof_file": f"{_FILES} SELECT date, path FROM g WHERE date <= DATE '2026-01-15' AND DATE '2026-01-15' - date <= 2 ORDER BY date DESC LIMIT 1",
    "q_payload_shapes": "SELECT paper_id, coalesce(score, 0) AS score FROM papers",
    "q_union_sources": """
        WITH u AS (SELECT coalesce(nullif(trim(canonical_url), ''), nullif(trim(url), '')) AS addr, 0 AS o FROM hotspot_items UNION ALL SELECT nullif(trim(url), ''), 1 FROM hn_hits), m AS (SELECT addr, min(o) AS o FROM u WHERE addr IS NOT NULL GROUP BY 1)
        SELECT CASE WHEN o = 0 THEN 'items' ELSE 'hits' END AS origin, count(*) AS n FROM m GROUP BY 1""",
    "q_raw_roundtrip": "SELECT item_id, md5(coalesce(title, '')) AS h, coalesce(len(tags), -1)::INT AS tags, metadata.stars AS stars FROM hotspot_items",
    "q_number_coercion": "SELECT p_partkey, floor(round(p_retailprice, 3) * 1000 + 0.5)::BIGINT AS per_mille FROM part WHERE p_partkey % 5 <> 0",
    "q_heat_labels": """
        WITH t AS (SELECT item_id, CASE WHEN metadata.activity > 0 THEN 'activity' WHEN metadata.stars > 0 THEN 'stars' WHEN metadata.hn_score > 0 THEN 'hn_score' WHEN metadata.upvotes > 0 THEN 'upvotes' END AS kind,
          CASE WHEN metadata.activity > 0 THEN metadata.activity WHEN metadata.stars > 0 THEN metadata.stars WHEN metadata.hn_score > 0 THEN metadata.hn_score WHEN metadata.upvotes > 0 THEN metadata.upvotes END AS n FROM hotspot_items)
        SELECT item_id, kind, CASE WHEN n >= 1000 THEN (floor(n / 100.0::DOUBLE) / 10)::VARCHAR || 'k' ELSE n::VARCHAR END AS short FROM t WHERE kind IS NOT NULL""",
    "q_routes": """
        WITH h AS (SELECT DISTINCT fetched_at::DATE AS d FROM hotspot_items WHERE batch_id % 7 <> 0)
        SELECT batch_id, CASE WHEN d IS NOT NULL THEN strftime(batch_date, '/d/%Y/%m/%d') WHEN month(batch_date) <> 12 THEN strftime(batch_date, '/m/%Y/%m') ELSE '/' END AS route FROM batches LEFT JOIN h ON d = batch_date""",
    "q_compact_topics": f"""
        WITH t AS (SELECT *, {_clean('summary')} AS x FROM hotspot_clusters), u AS (SELECT *, substr(x, 1, 160) AS head, regexp_extract(substr(x, 1, 160), '(?s)^(.*[.!?])(?:\\s|$)', 1) AS s, regexp_extract(substr(x, 1, 160), '(?s)^(.*)\\s', 1) AS w FROM t)
        SELECT cluster_id, array_to_string(list_slice(list_sort(list_transform(cluster_items, lambda m: m.item_id)), 1, 2), ',') AS evidence,
          CASE WHEN list_contains(source_roles, 'official_news') THEN 'official' WHEN len(source_ids) >= 3 THEN 'wide' ELSE 'single' END AS tier,
          md5(CASE WHEN length(x) <= 160 THEN x WHEN length(s) > 48 THEN s WHEN w <> '' THEN rtrim(w) ELSE head END) AS h FROM u""",
    "q_merge_back": """
        WITH h AS (SELECT item_id, min(title) AS other FROM hn_hits WHERE item_id IS NOT NULL AND title IS NOT NULL GROUP BY 1)
        SELECT i.item_id, md5(coalesce(other, title, '')) AS h, other IS NOT NULL AS replaced FROM hotspot_items i LEFT JOIN h ON h.item_id = i.item_id""",
    "q_effective_date": "SELECT CASE WHEN source_id = 'github_trend' THEN fetched_at::DATE ELSE batch_date END AS day, count(*) AS n FROM hotspot_items JOIN batches USING (batch_id) GROUP BY 1",
    "q_link_predicates": f"""
        WITH t AS (SELECT i.source_id, lower(coalesce(url, '')) AS u, {_HOST} AS h, coalesce(s.host, '') AS own, lower({_clean('title')}) AS t FROM hotspot_items i LEFT JOIN sources s ON s.source_id = i.source_id)
        SELECT source_id, count(*) FILTER (regexp_matches(u, '{MEDIA}')) AS media, count(*) FILTER (regexp_matches(u, '/(abs|pdf)/')) AS papers, count(*) FILTER (regexp_matches(t, '{GENERIC}')) AS generic, count(*) FILTER (h <> '' AND h <> own) AS external FROM t GROUP BY 1""",
    "q_regression_guard": """
        WITH a AS (SELECT count(DISTINCT source_id) AS old_n FROM hotspot_items), b AS (SELECT count(DISTINCT source_id) AS new_n FROM hotspot_items WHERE batch_id > 178) SELECT old_n, new_n, new_n < 0.5 * old_n AS guarded FROM a, b""",
    "q_closed_months": "SELECT last_day(batch_date) AS month_end, count(*) AS batches, last_day(batch_date) <= DATE '2026-03-31' AS closed FROM batches GROUP BY 1",
    "q_source_signatures": """
        SELECT array_to_string(list_sort(source_types), '+') AS signature, count(*) AS n, count(*) FILTER (len(list_filter(source_roles, lambda x: x NOT IN ('paper_trending', 'research_backbone'))) = 0) AS paper_only FROM hotspot_clusters GROUP BY 1""",
    "q_paper_kinds": """
        WITH t AS (SELECT paper_id, list_filter([CASE WHEN novelty >= 8 AND score >= 14 THEN 'frontier' END, CASE WHEN relevance >= 8 AND score >= 14 THEN 'hot' END], lambda x: x IS NOT NULL) AS k FROM papers)
        SELECT paper_id, array_to_string(k, ',') AS kinds, k[1] AS first FROM t WHERE len(k) > 0""",
    "q_usage_totals": """
        WITH t AS (SELECT regexp_extract(source_id, '^([a-z]+)', 1) AS provider, count(DISTINCT (batch_id, source_id)) AS requests, count(*) AS items FROM hotspot_items GROUP BY 1)
        SELECT *, row_number() OVER (ORDER BY items DESC, provider) AS place FROM t""",
    "q_artifact_share": f"""
        WITH t AS (SELECT item_id, lower(concat_ws(' ', title, summary)) AS b FROM hotspot_items),
        s AS (SELECT item_id, greatest(least(1.0::DOUBLE, ({_hit([chr(92) + 'bcode' + chr(92) + 'b', chr(92) + 'bbuild', chr(92) + 'bdebug'])}) / 1.5::DOUBLE), least(1.0::DOUBLE, ({_hit([chr(92) + 'bdata' + chr(92) + 'b', chr(92) + 'bset', chr(92) + 'bsampl'])}) / 1.5::DOUBLE), least(1.0::DOUBLE, ({_hit([chr(92) + 'bmodel', chr(92) + 'bweights' + chr(92) + 'b', chr(92) + 'btraining'])}) / 1.5::DOUBLE)) AS v FROM t)
        SELECT item_id, floor(v * 10000 + 0.5) / 10000 AS share FROM s WHERE v > 0""",
    "q_monthly_order": """
        SELECT paper_id, row_number() OVER (PARTITION BY strftime(batch_date, '%Y-%m') ORDER BY score DESC NULLS LAST, relevance DESC NULLS LAST, novelty DESC NULLS LAST, batch_date DESC, paper_id DESC) AS place FROM papers JOIN batches USING (batch_id)""",
    "q_anchor_choice": f"""
        WITH m AS (SELECT cluster_id, {_w('title')} AS w, unnest(cluster_items) AS m FROM hotspot_clusters), s AS (SELECT cluster_id, m.item_id AS item_id, length(coalesce(m.title, '')) AS n, len(list_intersect({_w('m.title')}, w)) AS score FROM m)
        SELECT cluster_id, item_id FROM s QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, n, item_id) = 1""",
    "q_handles": """
        SELECT regexp_replace(regexp_replace(lower(trim(author)), '^@', ''), '[^a-z0-9]+', '_', 'g') AS handle, count(*) AS n, min(trim(author) || ' hits') AS profile FROM hn_hits WHERE author IS NOT NULL GROUP BY 1""",
    "q_number_order": """
        WITH t AS (SELECT paper_id, regexp_extract(arxiv_id, '([0-9]{4}\\.[0-9]{5})', 1) AS n FROM papers) SELECT replace(n, '.', '')::BIGINT AS "order", min(paper_id) AS first, count(*) AS n FROM t WHERE t.n <> '' GROUP BY 1""",
    "q_document_digest": "SELECT batch_id, count(*) AS n, max(length(title))::INT AS longest, sum(score)::BIGINT AS score FROM papers GROUP BY 1",
}
