"""Queries over captured listings: payloads are written from the tables, one a row, and read back by the adapters with their gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.queries.items import _items
from gleaner.sources import listings as ls
from gleaner.sources import pages as pg
from gleaner.tables import table

NOON = "2026-03-20 12:00:00"


def _at() -> Column:
    return F.lit(NOON).cast("timestamp")


def _xml(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.coalesce(c, F.lit(""))


def _iso(c: str) -> Column:
    return F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    """Papers with a plain number, a title and an abstract in clean text."""
    rows = table(spark, d, "papers").filter(r"arxiv_id rlike '^[0-9]{4}\\.[0-9]{5}$' and title is not null and abstract is not null")
    return rows.withColumns({"title": text.clean_text("title"), "abstract": text.clean_text("abstract")})


def q_feed_items(spark: SparkSession, d: str) -> DataFrame:
    """SRC-02: papers of RSS answers that are announced as new, their number, title, abstract and authors taken out of the markup."""
    kind = F.when(F.col("paper_id") % 3 == 0, "replace").otherwise("new")
    xml = F.concat(
        F.lit('<rss xmlns:arxiv="a" xmlns:dc="d"><channel><item><title>'), _xml("title"), F.lit(" (arXiv:"), "arxiv_id", F.lit("v2 [cs.CL])</title><link>https://p.example/abs/"), "arxiv_id", F.lit("v2</link><description>Announce Type: x Abstract: "), _xml("abstract"),
        F.lit("</description><dc:creator>"), _xml(F.array_join(F.coalesce("authors", F.array().cast("array<string>")), ", ")), F.lit("</dc:creator><arxiv:announce_type>"), kind, F.lit("</arxiv:announce_type><category>cs.CL</category></item></channel></rss>"),
    )
    rows = ls.rss_papers(_numbered(spark, d).select(F.lit("cs.CL").alias("area"), xml.alias("xml")), primary_only=True)
    return rows.select("number", F.md5("title").alias("t"), F.md5("abstract").alias("a"))


def q_atom_items(spark: SparkSession, d: str) -> DataFrame:
    """SRC-01/03: papers of Atom answers of two areas, those of another primary area left out."""
    entry = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="a"><entry><id>http://p.example/abs/'), "arxiv_id", F.lit("v3</id><title>"), _xml("title"), F.lit("</title><summary>"), _xml("abstract"),
        F.lit('</summary><author><name>A</name></author><arxiv:primary_category term="'), F.when(F.col("paper_id") % 4 == 0, "cs.CV").otherwise("cs.CL"), F.lit('"/></entry></feed>'),
    )
    raw = _numbered(spark, d).select(F.lit("cs.CL").alias("area"), entry.alias("xml"))
    scan = lambda area: ls.atom_papers(raw.withColumn("area", F.lit(area)), primary_only=True).drop("area")
    return ls.by_area({"cs.CL": scan("cs.CL"), "cs.CV": scan("cs.CV")}).groupBy("area").agg(F.count("*").alias("n"), F.countDistinct("number").alias("numbers"))


def q_json_listing(spark: SparkSession, d: str) -> DataFrame:
    """SRC-13, PRED-42: repositories of search answers: stars, age, archives, forks, lists and thin kits, each once."""
    name = F.concat(F.lit("o/"), F.when(F.col("item_id") % 13 == 0, "awesome-").otherwise(""), F.lit("r"), F.col("item_id").cast("string"))
    row = F.struct(
        name.alias("full_name"), F.coalesce("url", F.lit("u")).alias("html_url"), F.when(F.col("item_id") % 5 == 0, "A wrapper").otherwise("x").alias("description"), F.coalesce("metadata.stars", F.lit(0)).alias("stargazers_count"), _iso("fetched_at").alias("created_at"),
        (F.col("item_id") % 7 == 0).alias("archived"), (F.col("item_id") % 11 == 0).alias("fork"),
    )
    raw = _items(spark, d).select(F.lit("q").alias("query"), F.to_json(F.struct(F.array(row).alias("items"))).alias("j"))
    return ls.repositories(raw, "query", "j", _at(), 100, 60, 500).select("full_name", "stars")


def q_hits_gate(spark: SparkSession, d: str) -> DataFrame:
    """SRC-14: stories of several searches once each: points, comments, age, and a known host or a keyword."""
    row = F.struct(F.col("object_id").alias("objectID"), "title", "url", "author", "created_at", "points", "num_comments")
    raw = table(spark, d, "hn_hits").dropDuplicates().select(F.concat(F.lit("q"), (F.xxhash64("object_id") % 3).cast("string")).alias("query"), F.to_json(F.struct(F.array(row).alias("hits"))).alias("j"))
    target = F.lit("2026-01-01").cast("timestamp")
    return ls.discussions(raw, "query", "j", target, 24 * 400, 50, 20, ["model", "code", "data", "chip"], [], 1_000_000).select("objectID", "points", "num_comments")


def q_embedded_json(spark: SparkSession, d: str) -> DataFrame:
    """SRC-07: papers of the JSON that pages carry in an attribute: upvoted enough, fresh, the hot ones marked."""
    day = table(spark, d, "batches").select("batch_id", "batch_date")
    paper = F.struct(F.col("paper_id").cast("string").alias("id"), "title", F.concat(F.col("batch_date").cast("string"), F.lit("T00:00:00Z")).alias("publishedAt"), F.coalesce("score", F.lit(0)).alias("upvotes"))
    data = F.to_json(F.struct(F.array(F.struct(paper.alias("paper"))).alias("dailyPapers")))
    for a, b in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        data = F.replace(data, F.lit(a), F.lit(b))
    pages = table(spark, d, "papers").join(F.broadcast(day), "batch_id").select(F.concat(F.lit('<div data-props="'), data, F.lit('" class="x"></div>')).alias("page"))
    return ls.embedded_papers(pages, "page", _at(), 5, 24 * 60, 15).select("number", F.md5("title").alias("t"), "upvotes", "kind")


def q_community_posts(spark: SparkSession, d: str) -> DataFrame:
    """SRC-12: posts of community pages under each community's least score, fresh, titled, an address once."""
    post = F.struct(
        "title", F.col("points").alias("score"), F.unix_timestamp(ls.instant(F.col("created_at"))).cast("double").alias("created_utc"), F.concat(F.lit("/r/"), "object_id").alias("permalink"), "url", F.col("url").isNull().alias("is_self"), "num_comments",
    )
    one = table(spark, d, "hn_hits").dropDuplicates().groupBy("object_id").agg(*[F.max(c).alias(c) for c in ("title", "points", "created_at", "url", "num_comments")])
    raw = one.select(F.when(F.length("object_id") % 2 == 0, "even").otherwise("odd").alias("sub"), F.to_json(F.struct(F.struct(F.array(F.struct(post.alias("data"))).alias("children")).alias("data"))).alias("j"))
    out = ls.community_posts(raw, "sub", "j", {"even": 50, "odd": 80}, F.lit("2026-01-01").cast("timestamp"), 24, limit=1_000_000)
    return out.select("permalink", "activity", F.md5("address").alias("a"))


def q_timelines(spark: SparkSession, d: str) -> DataFrame:
    """SRC-15, PRED-24/25, WIN-08: of the known accounts the eight latest posts each, replies and reposts out, an address once."""
    known = table(spark, d, "sources").select(F.col("source_id").alias("handle"), F.when(F.col("source_type").isin("tweet", "tweet_feed", "discussion"), "lab").otherwise("other").alias("kind"), F.length("source_name").alias("tier"), F.lit(True).alias("active"))
    post = F.struct(F.col("item_id").cast("string").alias("id"), F.coalesce("title", F.lit("")).alias("text"), _iso("fetched_at").alias("created_at"), F.col("source_id").alias("author_id"), F.struct(F.coalesce("metadata.activity", F.lit(0)).alias("like_count")).alias("public_metrics"))
    users = F.struct(F.array(F.struct(F.col("source_id").alias("id"), F.col("source_id").alias("username"))).alias("users"))
    raw = _items(spark, d).select(F.to_json(F.struct(F.array(post).alias("data"), users.alias("includes"))).alias("j"))
    out = ls.account_posts(ls.timeline_posts(raw, "j"), known, ["lab"], F.lit("2030-01-01").cast("timestamp"), 24 * 9000, 4)
    return out.select("handle", F.col("post_id").cast("bigint").alias("item_id"), "activity", "place")


def q_display_titles(spark: SparkSession, d: str) -> DataFrame:
    """TXT-05/18: titles for display, and as a roundup's headline."""
    return _items(spark, d).select("item_id", F.md5(pg.display_title(F.col("title"))).alias("shown"), F.md5(pg.roundup_title(F.col("title"))).alias("headline"))


def q_sitemap_pages(spark: SparkSession, d: str) -> DataFrame:
    """SRC-09e: of each source's sitemap the eight latest pages that hold a part."""
    xml = F.concat(F.lit("<urlset><url><loc>"), _xml(F.concat(F.lit("https://h.example"), F.when(F.col("item_id") % 3 == 0, "/about/").otherwise("/blog/"), F.col("item_id").cast("string"))), F.lit("</loc><lastmod>"), _iso("fetched_at"), F.lit("</lastmod></url></urlset>"))
    raw = _items(spark, d).filter("fetched_at is not null").select("source_id", xml.alias("xml"))
    return pg.sitemap_pages(raw, "source_id", "xml", F.lit("/blog/"), F.lit("2030-01-01").cast("timestamp"), 24 * 9000).select(F.col("source").alias("source_id"), "url", "place")


QUERIES = {f.__name__: f for f in (
    q_feed_items, q_atom_items, q_json_listing, q_hits_gate, q_embedded_json, q_community_posts, q_timelines, q_display_titles, q_sitemap_pages,
)}

_SP = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_NUMBERED = rf"n AS (SELECT paper_id, arxiv_id, trim(regexp_replace(title, '{_SP}', ' ', 'g')) AS title, trim(regexp_replace(abstract, '{_SP}', ' ', 'g')) AS abstract FROM papers WHERE regexp_matches(arxiv_id, '^[0-9]{{4}}\.[0-9]{{5}}$') AND title IS NOT NULL AND abstract IS NOT NULL)"
_HIT = "h AS (SELECT DISTINCT * FROM hn_hits)"
_WHEN = "coalesce(try_cast(trim(created_at) AS TIMESTAMPTZ)::TIMESTAMP, try_strptime(regexp_replace(trim(created_at), '^[A-Za-z]{3} ', ''), '%b %d %H:%M:%S %z %Y')::TIMESTAMP)"
_SIGNS = r"[\x{1F300}-\x{1FAFF}\x{2702}-\x{27B0}\x{FE00}-\x{FE0F}\x{200D}\s]+"
SQL = {
    "q_feed_items": f"WITH {_NUMBERED} SELECT arxiv_id AS number, md5(title) AS t, md5(abstract) AS a FROM n WHERE paper_id % 3 <> 0",
    "q_atom_items": f"WITH {_NUMBERED}, a AS (SELECT CASE WHEN paper_id % 4 = 0 THEN 'cs.CV' ELSE 'cs.CL' END AS area, arxiv_id FROM n) SELECT area, count(DISTINCT arxiv_id) AS n, count(DISTINCT arxiv_id) AS numbers FROM a GROUP BY 1",
    "q_json_listing": f"""
        SELECT 'o/r' || item_id AS full_name, metadata.stars AS stars FROM hotspot_items
        WHERE item_id % 13 <> 0 AND item_id % 7 <> 0 AND item_id % 11 <> 0 AND metadata.stars >= 100 AND NOT (item_id % 5 = 0 AND metadata.stars < 500) AND fetched_at >= DATE '{NOON[:10]}' - INTERVAL 60 DAY ORDER BY full_name LIMIT 500""",
    "q_hits_gate": f"""
        WITH {_HIT}, m AS (SELECT object_id, title, url, points, num_comments, {_WHEN} AS seen FROM h),
        o AS (SELECT * FROM m WHERE points >= 50 AND num_comments >= 20 AND (seen IS NULL OR seen BETWEEN TIMESTAMP '2026-01-01' - INTERVAL 9600 HOUR AND TIMESTAMP '2026-01-01' + INTERVAL 6 HOUR) AND regexp_matches(lower(coalesce(title, '')) || ' ' || lower(coalesce(url, '')), 'model|code|data|chip'))
        SELECT DISTINCT object_id AS "objectID", points, num_comments FROM o""",
    "q_embedded_json": f"""
        SELECT paper_id::VARCHAR AS number, md5(coalesce(title, paper_id::VARCHAR)) AS t, score AS upvotes, CASE WHEN score >= 15 THEN 'daily_hot' END AS kind FROM papers JOIN batches USING (batch_id)
        WHERE score >= 5 AND batch_date::TIMESTAMP BETWEEN TIMESTAMP '{NOON}' - INTERVAL 1440 HOUR AND TIMESTAMP '{NOON}' + INTERVAL 6 HOUR""",
    "q_community_posts": f"""
        WITH {_HIT}, o AS (SELECT object_id, max(title) AS title, max(points) AS points, max(created_at) AS created_at, max(url) AS url, max(num_comments) AS num_comments FROM h GROUP BY 1),
        t AS (SELECT *, trim(regexp_replace(coalesce(title, ''), '{_SP}', ' ', 'g')) AS clean, {_WHEN} AS seen FROM o)
        SELECT '/r/' || object_id AS permalink, (points + 3 * coalesce(num_comments, 0))::INT AS activity, md5(CASE WHEN coalesce(url, '') <> '' THEN url ELSE '/r/' || object_id END) AS a FROM t
        WHERE points >= CASE WHEN length(object_id) % 2 = 0 THEN 50 ELSE 80 END AND seen >= TIMESTAMP '2026-01-01' - INTERVAL 24 HOUR AND length(clean) >= 15""",
    "q_timelines": rf"""
        WITH k AS (SELECT lower(source_id) AS handle FROM sources WHERE source_type IN ('tweet', 'tweet_feed', 'discussion') ORDER BY length(source_name) DESC, lower(source_id) LIMIT 4),
        p AS (SELECT lower(source_id) AS handle, item_id, date_trunc('second', fetched_at) AS seen, greatest(0, coalesce(metadata.activity, 0))::BIGINT AS activity, trim(regexp_replace(coalesce(title, ''), '{_SP}', ' ', 'g')) AS body FROM hotspot_items),
        q AS (SELECT p.* FROM p JOIN k USING (handle) WHERE body <> '' AND NOT regexp_matches(lower(body), '^(rt @|@)')), r AS (SELECT *, row_number() OVER (PARTITION BY handle ORDER BY seen DESC, item_id::VARCHAR) AS place FROM q)
        SELECT handle, item_id, activity, place FROM r WHERE place <= 8""",
    "q_display_titles": rf"""
        WITH t AS (SELECT item_id, trim(coalesce(title, '')) AS t, trim(regexp_replace(coalesce(title, ''), '{_SP}', ' ', 'g')) AS c FROM hotspot_items),
        u AS (SELECT item_id, t, trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(t, '(?i)^\d+\s+hours?\s+ago\s*', '')), '^{_SIGNS}', '')), '^[·•|—\- ]+', '')) AS u,
          trim(split_part(trim(split_part(trim(split_part(trim(split_part(c, ' PLUS:', 1)), ' ALSO:', 1)), ' Two new eps', 1)), ' | ', 1)) AS c FROM t)
        SELECT item_id, md5(CASE WHEN u <> '' THEN u ELSE t END) AS shown, md5(trim(regexp_replace(trim(regexp_replace(regexp_replace(c, '^(?:[A-Z][a-z]{{2,8}}\.? \d{{1,2}}(?:, \d{{4}})?\s*[:–—-]?\s*)', ''), '^{_SIGNS}', '')), '(?i)^(?:ai|tech) ', ''))) AS headline FROM u""",
    "q_sitemap_pages": """
        WITH u AS (SELECT source_id, 'https://h.example/blog/' || item_id AS url, strftime(fetched_at, '%Y-%m-%dT%H:%M:%SZ') AS seen FROM hotspot_items WHERE fetched_at IS NOT NULL AND item_id % 3 <> 0), r AS (SELECT source_id, url, row_number() OVER (PARTITION BY source_id ORDER BY seen DESC, url) AS place FROM u)
        SELECT * FROM r WHERE place <= 8""",
}
