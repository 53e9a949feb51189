"""Queries over the scalar functions: text, addresses, identifiers, JSON, dates in text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import fixed, text, url
from gleaner.tables import table

_SP = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _clean(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{_SP}', ' ', 'g'))"


def q_item_normalise(spark: SparkSession, d: str) -> DataFrame:
    """TXT-01/02, PRJ-01: cleaned title, clipped summary, canonical address with fallback, tags without blanks."""
    return table(spark, d, "hotspot_items").select(
        "item_id", text.clean_text("title").alias("title"), text.clip(text.clean_text("summary"), 200).alias("summary"),
        F.coalesce(F.nullif(F.trim("canonical_url"), F.lit("")), F.trim("url")).alias("canonical"),
        F.array_join(F.filter(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: text.clean_text(t)), lambda t: t != ""), "|").alias("tags"),
    )


def q_concise_text(spark: SparkSession, d: str) -> DataFrame:
    """TXT-03: cut at a sentence end."""
    return table(spark, d, "documents").select("doc_id", text.concise(text.clean_text("text")).alias("short"))


def q_clean_summary(spark: SparkSession, d: str) -> DataFrame:
    """TXT-04: links and addresses out of a text."""
    return table(spark, d, "documents").select("doc_id", F.length(text.without_links(F.col("text"))).alias("n"), F.md5(text.without_links(F.col("text"))).alias("h"))


def q_strip_html(spark: SparkSession, d: str) -> DataFrame:
    """TXT-12: markup and entities out of a text."""
    return table(spark, d, "documents").filter("text like '%<%' or text like '%&%'").select("doc_id", F.md5(text.strip_tags(F.col("text"))).alias("h"))


def q_slug_ids(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-05/06, TXT-22: slug and hashed identifier."""
    base = F.concat_ws("|", F.coalesce("canonical_url", F.lit("")), text.clean_text("title"))
    return table(spark, d, "hotspot_items").select("item_id", text.slug(text.clean_text("title")).alias("slug"), text.short_id(F.col("source_id"), base).alias("ident"))


def q_group_ids(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-07: identifier of a cluster from its members in order."""
    members = F.transform(F.array_sort(F.transform("cluster_items", lambda m: m["item_id"])), lambda i: i.cast("string"))
    return table(spark, d, "hotspot_clusters").select("cluster_id", F.substring(F.sha1(F.array_join(members, ",")), 1, 12).alias("ident"), F.size("cluster_items").alias("n"))


def q_url_tracking(spark: SparkSession, d: str) -> DataFrame:
    """URL-01."""
    return table(spark, d, "hotspot_items").filter("url is not null").select("item_id", url.without_tracking(F.col("url")).alias("u"))


def q_url_strip(spark: SparkSession, d: str) -> DataFrame:
    """URL-02."""
    return table(spark, d, "hotspot_items").filter("url is not null").select("item_id", url.without_query(F.col("url")).alias("u"))


def q_url_canonical(spark: SparkSession, d: str) -> DataFrame:
    """URL-03."""
    return table(spark, d, "papers").filter("arxiv_id is not null").select("paper_id", url.canonical(F.col("arxiv_id")).alias("u"))


def q_url_hosts(spark: SparkSession, d: str) -> DataFrame:
    """URL-04: items by host."""
    return table(spark, d, "hotspot_items").groupBy(url.host(F.coalesce("url", F.lit(""))).alias("host")).agg(F.count("*").alias("n"))


def q_title_tokens(spark: SparkSession, d: str) -> DataFrame:
    """TXT-06/07."""
    w = text.significant_words(F.col("title"))
    return table(spark, d, "hotspot_items").select("item_id", F.array_join(w, " ").alias("words"), F.size(w).alias("n"))


def q_entities(spark: SparkSession, d: str) -> DataFrame:
    """TXT-11: organisations and products that a title or summary names, as a sorted set, by item."""
    names = text.entities(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))))
    return table(spark, d, "hotspot_items").select("item_id", F.array_join(names, "|").alias("entities"), F.size(names).alias("n"))


def q_segments(spark: SparkSession, d: str) -> DataFrame:
    """TXT-14: non-blank lines of a text."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    return table(spark, d, "documents").select("doc_id", F.size(lines).alias("segments"), F.aggregate(lines, F.lit(0), lambda a, x: F.greatest(a, F.length(x))).alias("longest"))


def q_links(spark: SparkSession, d: str) -> DataFrame:
    """TXT-13: addresses named in texts, by frequency."""
    found = F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(https?://[^\s<>()\"]+)"), F.lit(1)))
    return table(spark, d, "documents").select(found.alias("link")).groupBy("link").agg(F.count("*").alias("n"))


def q_json_metadata(spark: SparkSession, d: str) -> DataFrame:
    """JSON-02, ARR/MAP: a number out of JSON text, coerced and banded."""
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(0))
    return table(spark, d, "events").groupBy(F.floor(k / 10).cast("int").alias("band")).agg(F.count("*").alias("n"), F.sum(k.cast("long")).alias("total"))


def q_jsonl_repair(spark: SparkSession, d: str) -> DataFrame:
    """JSON-01: JSON inside code fences, with trailing commas and broken lines; parsed where it can be."""
    broken = F.when(F.col("event_id") % 7 == 0, F.expr("substr(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    raw = F.concat(F.lit("```json\n"), broken, F.lit(",\n```"))
    cleaned = F.regexp_replace(F.regexp_replace(raw, "```[a-z]*", ""), r",\s*$", "")
    parsed = F.from_json(F.trim(F.regexp_replace(cleaned, r"\s+", " ")), "k int")["k"]
    return table(spark, d, "events").select(F.col("event_type"), parsed.alias("k")).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("k").isNull()).alias("invalid"), F.sum(F.col("k").cast("long")).alias("total"))


def q_iso_dates(spark: SparkSession, d: str) -> DataFrame:
    """DT-03: the ISO date named in a free text, if it is one."""
    day = F.regexp_extract("published_at", r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    return table(spark, d, "hotspot_items").filter("published_at is not null").select("item_id", F.try_to_date(F.nullif(day, F.lit("")), "yyyy-MM-dd").alias("day")).filter("day is not null")


def q_month_ends(spark: SparkSession, d: str) -> DataFrame:
    """DT-06: batches by month with the month's last day."""
    return table(spark, d, "batches").groupBy(F.last_day("batch_date").alias("month_end")).agg(F.count("*").alias("days"), F.max(F.col("batch_date") == F.last_day("batch_date")).alias("closed"))


def q_cjk_share(spark: SparkSession, d: str) -> DataFrame:
    """PRED-40: titles with more than 30 % CJK characters."""
    n = F.regexp_count("title", F.lit(r"[\x{4e00}-\x{9fff}]"))
    return table(spark, d, "hotspot_items").filter("title is not null").filter(n > 0.3 * F.length("title")).select("item_id", n.alias("cjk"))


QUERIES = {f.__name__: f for f in (
    q_item_normalise, q_concise_text, q_clean_summary, q_strip_html, q_slug_ids, q_group_ids, q_url_tracking, q_url_strip, q_url_canonical, q_url_hosts, q_title_tokens,
    q_entities, q_segments, q_links, q_json_metadata, q_jsonl_repair, q_iso_dates, q_month_ends, q_cjk_share,
)}

_URL = r"'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$'"
_STOP = "[" + ", ".join(f"'{w}'" for w in fixed.STOPWORDS) + "]"
SQL = {
    "q_item_normalise": f"""
        SELECT item_id, {_clean('title')} AS title,
          CASE WHEN length({_clean('summary')}) <= 200 THEN {_clean('summary')} ELSE rtrim(substr({_clean('summary')}, 1, 197)) || '...' END AS summary,
          coalesce(nullif(trim(canonical_url), ''), trim(url)) AS canonical,
          coalesce(array_to_string(list_filter(list_transform(coalesce(tags, []), lambda x: {_clean('x')}), lambda x: x <> ''), '|'), '') AS tags
        FROM hotspot_items""",
    "q_concise_text": f"""
        WITH t AS (SELECT doc_id, {_clean('text')} AS x FROM documents),
        u AS (SELECT doc_id, x, substr(x, 1, 300) AS head, regexp_extract(substr(x, 1, 300), '(?s)^(.*[.!?])(?:\\s|$)', 1) AS s, regexp_extract(substr(x, 1, 300), '(?s)^(.*)\\s', 1) AS w FROM t)
        SELECT doc_id, CASE WHEN length(x) <= 300 THEN x WHEN length(s) > 90 THEN s WHEN w <> '' THEN rtrim(w) ELSE head END AS short FROM u""",
    "q_clean_summary": f"""
        WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\\[([^\\]]*)\\]\\(https?://[^)\\s]*\\)', '\\1', 'g'), 'https?://\\S+', '', 'g') AS y FROM documents)
        SELECT doc_id, length({_clean('y')}) AS n, md5({_clean('y')}) AS h FROM t""",
    "q_strip_html": f"""
        WITH t AS (SELECT doc_id, replace(replace(replace(replace(replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS y
          FROM documents WHERE text LIKE '%<%' OR text LIKE '%&%')
        SELECT doc_id, md5({_clean('y')}) AS h FROM t""",
    "q_slug_ids": f"""
        SELECT item_id, regexp_replace(regexp_replace(lower({_clean('title')}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
          source_id || '-' || substr(sha1(coalesce(canonical_url, '') || '|' || {_clean('title')}), 1, 12) AS ident FROM hotspot_items""",
    "q_group_ids": """
        SELECT cluster_id, substr(sha1(array_to_string(list_transform(list_sort(list_transform(cluster_items, lambda x: x.item_id)), lambda x: x::VARCHAR), ',')), 1, 12) AS ident, len(cluster_items)::INT AS n FROM hotspot_clusters""",
    "q_url_tracking": rf"""
        WITH p AS (SELECT item_id, trim(url) AS t, regexp_extract(trim(url), {_URL}, 1) AS a, regexp_extract(trim(url), {_URL}, 2) AS b, regexp_extract(trim(url), {_URL}, 3) AS c, regexp_extract(trim(url), {_URL}, 4) AS q FROM hotspot_items WHERE url IS NOT NULL),
        r AS (SELECT *, list_filter(string_split(substr(q, 2), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_|fbclid|gclid|mc_|ref)')) AS kept FROM p)
        SELECT item_id, CASE WHEN b = '' THEN t ELSE lower(a) || '://' || lower(b) || regexp_replace(regexp_replace(c, '/+', '/', 'g'), '/$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS u FROM r""",
    "q_url_strip": r"SELECT item_id, regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '/+$', '') AS u FROM hotspot_items WHERE url IS NOT NULL",
    "q_url_canonical": r"""
        SELECT paper_id, CASE WHEN regexp_matches(arxiv_id, '/(?:abs|pdf)/[0-9]{4}\.[0-9]{4,5}') THEN 'preprint:' || regexp_extract(arxiv_id, '/(?:abs|pdf)/([0-9]{4}\.[0-9]{4,5})', 1)
          ELSE lower(regexp_replace(regexp_replace(trim(arxiv_id), '[?#].*$', ''), '/+$', '')) END AS u FROM papers WHERE arxiv_id IS NOT NULL""",
    "q_url_hosts": rf"SELECT lower(regexp_extract(trim(coalesce(url, '')), {_URL}, 2)) AS host, count(*) AS n FROM hotspot_items GROUP BY 1",
    "q_title_tokens": rf"""
        WITH t AS (SELECT item_id, list_transform(list_filter(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+'), lambda x: NOT list_contains({_STOP}, x)), lambda x: regexp_replace(x, '^([0-9]+)[bmk]$', '\1')) AS w FROM hotspot_items),
        u AS (SELECT item_id, list_sort(list_distinct(list_filter(w, lambda x: length(x) >= 4 OR (length(x) >= 3 AND regexp_matches(x, '^[0-9]+$'))))) AS w FROM t)
        SELECT item_id, coalesce(array_to_string(w, ' '), '') AS words, len(w)::INT AS n FROM u""",
    "q_entities": f"""
        WITH b AS (SELECT item_id, coalesce(title, '') || ' ' || coalesce(summary, '') AS b FROM hotspot_items),
        t AS (SELECT item_id, list_sort(list_distinct(list_transform(flatten([{", ".join(f"regexp_extract_all(b, '(?i){p}')" for p in fixed.ENTITY_PATTERNS)}]), lambda x: trim(lower(x))))) AS e FROM b)
        SELECT item_id, coalesce(array_to_string(e, '|'), '') AS entities, len(e)::INT AS n FROM t""",
    "q_segments": """
        WITH t AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS s FROM documents)
        SELECT doc_id, len(s)::INT AS segments, coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::INT AS longest FROM t""",
    "q_links": r"""
        SELECT link, count(*) AS n FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), 'https?://[^\s<>()"]+')) AS link FROM documents) GROUP BY link""",
    "q_json_metadata": """
        WITH t AS (SELECT coalesce(try_cast(json_extract_string(props, '$.k') AS INT), 0) AS k FROM events)
        SELECT floor(k / 10.0)::INT AS band, count(*) AS n, sum(k)::BIGINT AS total FROM t GROUP BY 1""",
    "q_jsonl_repair": """
        WITH t AS (SELECT event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE try_cast(json_extract_string(props, '$.k') AS INT) END AS k FROM events)
        SELECT event_type, count(*) AS n, count(*) FILTER (k IS NULL) AS invalid, sum(k)::BIGINT AS total FROM t GROUP BY 1""",
    "q_iso_dates": """
        WITH t AS (SELECT item_id, try_cast(nullif(regexp_extract(published_at, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), '') AS DATE) AS day FROM hotspot_items WHERE published_at IS NOT NULL)
        SELECT item_id, day FROM t WHERE day IS NOT NULL""",
    "q_month_ends": "SELECT last_day(batch_date) AS month_end, count(*) AS days, max(batch_date = last_day(batch_date)) AS closed FROM batches GROUP BY 1",
    "q_cjk_share": r"""
        WITH t AS (SELECT item_id, title, len(regexp_extract_all(title, '[\x{4e00}-\x{9fff}]'))::INT AS cjk FROM hotspot_items WHERE title IS NOT NULL)
        SELECT item_id, cjk FROM t WHERE cjk > 0.3 * length(title)""",
}
