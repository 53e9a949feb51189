"""Captured listings as rows: paper feeds, community pages, repository searches, discussions, timelines and daily paper files.

Every operator takes a relation of captured payloads (text of one response a row) and parses it with built-in expressions, so
that payloads of any number of days and sources are read in one pass. Gates are arguments; ``target`` is the time the gates
are measured from. Payloads that cannot be parsed give no rows. Where a reader takes the first of several, the order is that
of the payload's ``rank`` and the place in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.operators.items import fresh, keep_best

_ENTITIES = (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def unescape(c: Column) -> Column:
    """The entities that payloads in attributes are written with, resolved; the ampersand last."""
    for entity, char in _ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def instant(c: Column) -> Column:
    """A timestamp from ISO 8601 or from the classic form 'Tue Dec 10 07:00:00 +0000 2024'; null where neither holds."""
    classic = F.try_to_timestamp(F.regexp_replace(F.trim(c), r"^[A-Za-z]{3} ", ""), F.lit("MMM dd HH:mm:ss Z yyyy"))
    return F.coalesce(F.trim(c).try_cast("timestamp"), classic)


def atom_papers(raw: DataFrame, area: str = "area", xml: str = "xml", primary_only: bool = False) -> DataFrame:
    """``area, number, title, abstract, authors`` of Atom answers; the number without path and version."""
    schema = "entry array<struct<id: string, title: string, summary: string, author: array<struct<name: string>>, primary_category: struct<_term: string>>>"
    e = raw.select(F.col(area).alias("area"), F.explode(F.from_xml(xml, schema, {"rowTag": "feed", "ignoreNamespace": "true"})["entry"]).alias("e"))
    if primary_only:
        e = e.filter(F.col("e.primary_category._term") == F.col("area"))
    number = F.split(F.element_at(F.split(F.trim("e.id"), "/"), -1), "v")[0]
    return e.select("area", number.alias("number"), text.clean_text(F.col("e.title")).alias("title"), text.clean_text(F.col("e.summary")).alias("abstract"), F.transform("e.author", lambda a: text.clean_text(a["name"])).alias("authors"))


def rss_papers(raw: DataFrame, area: str = "area", xml: str = "xml", announced: tuple[str, ...] = ("new",), primary_only: bool = False) -> DataFrame:
    """``area, number, title, abstract, authors`` of RSS answers announced in one of the ways; markup, the trailing number and what precedes the abstract go."""
    schema = "channel struct<item: array<struct<title: string, link: string, description: string, creator: string, announce_type: string, category: array<string>>>>"
    e = raw.select(F.col(area).alias("area"), F.explode(F.from_xml(xml, schema, {"rowTag": "rss", "ignoreNamespace": "true"})["channel"]["item"]).alias("e"))
    e = e.filter(F.col("e.announce_type").isin(*announced))
    if primary_only:
        e = e.filter(F.get("e.category", F.lit(0)) == F.col("area"))
    plain = lambda c: unescape(F.regexp_replace(c, "<[^<]+?>", ""))
    summary = F.regexp_replace(plain(F.col("e.description")), r"\n", " ")
    return e.select(
        "area", F.split(F.element_at(F.split("e.link", "/"), -1), "v")[0].alias("number"), F.trim(F.regexp_replace("e.title", r"\(arXiv:[0-9]+\.[0-9]+v[0-9]+ \[.*\]\)$", "")).alias("title"),
        F.trim(F.element_at(F.split(summary, "Abstract: "), -1)).alias("abstract"), F.transform(F.split(F.replace("e.creator", F.lit("\n"), F.lit(",")), ","), lambda a: F.trim(plain(a))).alias("authors"),
    )


def by_area(parts: dict[str, DataFrame]) -> DataFrame:
    """The scans of several areas as one relation, a paper once an area."""
    out = None
    for area, df in parts.items():
        df = df.withColumn("area", F.lit(area)).dropDuplicates(["number"])
        out = df if out is None else out.unionByName(df)
    return out


def embedded_papers(pages: DataFrame, page: str, target: Column, least_upvotes: int = 5, hours: int = 720, hot: int = 15, limit: int = 12) -> DataFrame:
    """Papers of the JSON that a page carries in an attribute: dated, fresh, upvoted enough, the first ``limit`` a page; the most upvoted are 'daily_hot'."""
    schema = "dailyPapers array<struct<paper: struct<id: string, title: string, summary: string, publishedAt: string, upvotes: int, githubRepo: string, authors: array<struct<name: string>>>>>"
    data = F.from_json(unescape(F.regexp_extract(page, r'data-props="([^"]*dailyPapers[^"]*)"', 1)), schema)
    rows = pages.withColumn("_page", F.xxhash64(page)).select("*", F.posexplode(data["dailyPapers"]).alias("_pos", "_row")).select("*", "_row.paper.*")
    rows = rows.filter((F.coalesce("id", F.lit("")) != "") & F.col("publishedAt").isNotNull() & (F.coalesce("upvotes", F.lit(0)) >= least_upvotes))
    rows = rows.withColumn("published", instant(F.col("publishedAt"))).filter(fresh(F.col("published"), target, hours))
    place = F.row_number().over(Window.partitionBy("_page").orderBy("_pos"))
    kept = rows.withColumn("place", place).filter(F.col("place") <= limit)
    return kept.select(F.col("id").alias("number"), F.coalesce("title", "id").alias("title"), text.clip(text.clean_text("summary"), 600).alias("summary"), "published", "upvotes", F.col("githubRepo").alias("repository"), F.when(F.col("upvotes") >= hot, "daily_hot").alias("kind"), "place")


def community_posts(raw: DataFrame, community: str, payload: str, minima: dict[str, int], target: Column, hours: int, least_title: int = 15, limit: int = 15) -> DataFrame:
    """Posts of community pages: each community has its least score; fresh, dated, titled, an address once; the first ``limit`` in all.

    The address of a post that links elsewhere is the link; activity is the score and three points a comment.
    """
    schema = "data struct<children: array<struct<data: struct<title: string, score: int, created_utc: double, permalink: string, url: string, is_self: boolean, selftext: string, num_comments: int, author: string>>>>"
    ranked = raw.select(F.col(community).alias("community"), F.coalesce("rank", F.lit(0)).alias("rank") if "rank" in raw.columns else F.lit(0).alias("rank"), F.posexplode(F.from_json(payload, schema)["data"]["children"]).alias("pos", "c"))
    rows = ranked.select("community", "rank", "pos", "c.data.*").withColumns({"created": F.timestamp_seconds("created_utc"), "title": text.clean_text("title")})
    least = F.try_element_at(F.create_map(*[F.lit(x) for kv in minima.items() for x in kv]), F.col("community"))
    rows = rows.filter((F.coalesce("score", F.lit(0)) >= least) & (F.col("created") >= target - F.expr(f"INTERVAL '{hours}' HOUR")) & (F.length("title") >= least_title) & (F.coalesce("permalink", F.lit("")) != ""))
    one = keep_best(rows, ["permalink"], [F.asc("rank"), F.asc("pos"), F.asc("community")])
    outside = (~F.coalesce("is_self", F.lit(True))) & (F.coalesce("url", F.lit("")) != "")
    first = one.orderBy("rank", "pos", "community", "permalink").limit(limit)  # the limit is the feature: a page's worth of posts
    return first.select("community", "title", text.clip(text.clean_text("selftext"), 400).alias("summary"), "permalink", F.when(outside, F.col("url")).otherwise(F.col("permalink")).alias("address"), "created", (F.coalesce("score", F.lit(0)) + 3 * F.coalesce("num_comments", F.lit(0))).alias("activity"))


# Repositories that are left out by name, or by description below so many stars.
LIST_NAMES = [r"^awesome[-_]", r"[-_]awesome$"]
THIN_WORDS, THIN_STARS, KIT_STARS = ["wrapper", "wechat", "weixin", "微信"], 500, 300
KIT_NAMES, KIT_EXCUSES = r"^mcp-|-mcp$|-agent-sdk$", ["model", "training", "benchmark", "transformer"]


def repositories(raw: DataFrame, query: str, payload: str, target: Column, least_stars: int, days: int, limit: int) -> DataFrame:
    """Repositories of search answers that a search with these bounds would give: stars, age, no archive, no fork, no list or thin kit; each once, by its first query."""
    schema = "items array<struct<full_name: string, html_url: string, description: string, stargazers_count: int, forks_count: int, language: string, topics: array<string>, created_at: string, updated_at: string, archived: boolean, fork: boolean, owner: struct<login: string>>>"
    ranked = raw.select(F.col(query).alias("query"), F.posexplode(F.from_json(payload, schema)["items"]).alias("pos", "r")).select("query", "pos", "r.*")
    name = F.element_at(F.split("full_name", "/"), -1)
    low, stars = F.lower(F.coalesce("description", F.lit(""))), F.coalesce("stargazers_count", F.lit(0))
    said = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    created = instant(F.coalesce("created_at", "updated_at"))
    rows = ranked.filter(F.col("full_name").isNotNull() & F.col("html_url").isNotNull() & (stars >= least_stars) & (created >= F.date_trunc("day", target) - F.expr(f"INTERVAL '{days}' DAY")))
    rows = rows.filter(~F.coalesce("archived", F.lit(False)) & ~F.coalesce("fork", F.lit(False)) & ~text.any_of(name, LIST_NAMES))
    rows = rows.filter(~(said(THIN_WORDS) & (stars < THIN_STARS)) & ~(F.lower(name).rlike(KIT_NAMES) & (stars < KIT_STARS) & ~said(KIT_EXCUSES)))
    one = keep_best(rows, ["full_name"], [F.asc("query"), F.asc("pos")])
    first = one.orderBy("query", "pos", "full_name").limit(limit)  # the limit is the feature
    return first.select("full_name", "html_url", text.clip(text.clean_text("description"), 420).alias("summary"), F.col("stargazers_count").alias("stars"), F.col("forks_count").alias("forks"), "language", "topics", instant(F.coalesce("created_at", "updated_at")).alias("created"), F.col("owner.login").alias("owner"), "query")


def discussions(raw: DataFrame, query: str, payload: str, target: Column, hours: int, least_points: int, least_comments: int, words: list[str], hosts: list[str], limit: int) -> DataFrame:
    """Stories of several searches, each once: enough points and comments, fresh, of a known host or with a keyword; the ``limit`` of most points."""
    schema = "hits array<struct<objectID: string, title: string, url: string, author: string, created_at: string, points: int, num_comments: int>>"
    rows = raw.select(F.col(query).alias("query"), F.posexplode(F.from_json(payload, schema)["hits"]).alias("pos", "h")).select("query", "pos", "h.*").filter(F.coalesce("objectID", F.lit("")) != "")
    one = keep_best(rows, ["objectID"], [F.asc("query"), F.asc("pos")]).withColumns({"title": text.clean_text("title"), "created": instant(F.col("created_at"))})
    host = F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")))
    both = F.concat_ws(" ", F.lower("title"), F.lower(F.coalesce("url", F.lit(""))))
    holds = lambda c, xs: F.exists(F.array(*[F.lit(x.lower()) for x in xs if x]).cast("array<string>"), lambda x: F.contains(c, x))
    kept = one.filter((F.coalesce("points", F.lit(0)) >= least_points) & (F.coalesce("num_comments", F.lit(0)) >= least_comments) & fresh(F.col("created"), target, hours) & (holds(host, hosts) | holds(both, words)))
    return kept.orderBy(F.desc("points"), "query", "pos", "objectID").limit(limit).select("objectID", "title", "url", "author", "created", "points", "num_comments")


_POST = "post_id, handle, author_name, verified, body, created, reply, urls, activity"


def activity(likes: Column, replies: Column, reposts: Column, quotes: Column, marks: Column, seen: Column) -> Column:
    """Engagement of a post: a like or bookmark 1, a repost 2, a reply 3, a quote 4, a thousand views 1; missing parts are 0."""
    z = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return z(likes) + z(marks) + z(replies) * 3 + z(reposts) * 2 + z(quotes) * 4 + F.floor(z(seen) / 1000).cast("bigint")


def timeline_posts(raw: DataFrame, payload: str) -> DataFrame:
    """Posts of two providers' timelines in one shape: identity, author, text, instant, whether it is a reply or repost, links, engagement."""
    v2 = (
        "data array<struct<id: string, text: string, created_at: string, author_id: string, in_reply_to_user_id: string, entities: struct<urls: array<struct<expanded_url: string, url: string>>>, referenced_tweets: array<struct<type: string>>,"
        " public_metrics: struct<like_count: int, reply_count: int, retweet_count: int, quote_count: int, bookmark_count: int, impression_count: int>>>, includes struct<users: array<struct<id: string, username: string, name: string, verified: boolean>>>"
    )
    other = (
        "tweets array<struct<id: string, text: string, createdAt: string, isReply: boolean, likeCount: int, replyCount: int, retweetCount: int, quoteCount: int, bookmarkCount: int, viewCount: int,"
        " author: struct<userName: string, name: string, isBlueVerified: boolean>, entities: struct<urls: array<struct<expanded_url: string, url: string>>>, retweeted_tweet: struct<id: string>>>"
    )
    links = lambda urls: F.filter(F.transform(urls, lambda u: F.coalesce(u["expanded_url"], u["url"])), lambda u: u.isNotNull())
    a = raw.select(F.from_json(payload, v2).alias("p")).select(F.col("p.includes.users").alias("users"), F.explode("p.data").alias("t"))
    user = F.get(F.filter("users", lambda u: u["id"] == F.col("t.author_id")), F.lit(0))
    m = F.col("t.public_metrics")
    referred = F.exists(F.coalesce("t.referenced_tweets", F.array().cast("array<struct<type: string>>")), lambda r: r["type"].isin("retweeted", "replied_to"))
    first = a.select(
        F.col("t.id").alias("post_id"), F.lower(user["username"]).alias("handle"), user["name"].alias("author_name"), F.coalesce(user["verified"], F.lit(False)).alias("verified"), text.clean_text(F.col("t.text")).alias("body"), instant(F.col("t.created_at")).alias("created"),
        (referred | F.col("t.in_reply_to_user_id").isNotNull()).alias("reply"), links(F.col("t.entities.urls")).alias("urls"),
        activity(m["like_count"], m["reply_count"], m["retweet_count"], m["quote_count"], m["bookmark_count"], m["impression_count"]).alias("activity"),
    )
    b = raw.select(F.explode(F.from_json(payload, other)["tweets"]).alias("t"))
    second = b.select(
        F.col("t.id").alias("post_id"), F.lower("t.author.userName").alias("handle"), F.col("t.author.name").alias("author_name"), F.coalesce("t.author.isBlueVerified", F.lit(False)).alias("verified"), text.clean_text(F.col("t.text")).alias("body"), instant(F.col("t.createdAt")).alias("created"),
        (F.coalesce("t.isReply", F.lit(False)) | F.col("t.retweeted_tweet").isNotNull()).alias("reply"), links(F.col("t.entities.urls")).alias("urls"),
        activity(F.col("t.likeCount"), F.col("t.replyCount"), F.col("t.retweetCount"), F.col("t.quoteCount"), F.col("t.bookmarkCount"), F.col("t.viewCount")).alias("activity"),
    )
    both = first.unionByName(second)
    return both.withColumn("reply", F.col("reply") | F.lower("body").rlike(r"^(rt @|@)"))


def account_posts(posts: DataFrame, registry: DataFrame, kinds: list[str], target: Column, hours: int, accounts: int, each: int = 8) -> DataFrame:
    """Posts of the ``accounts`` best known active accounts of the kinds, replies and reposts out, an address once, ``each`` a handle.

    ``registry``: ``handle, kind, tier, active``. Accounts are ranked by tier (high first), then handle.
    """
    known = registry.filter(F.coalesce("active", F.lit(True)) & F.col("kind").isin(*kinds)).select(F.lower("handle").alias("handle"), "kind", "tier")
    top = known.orderBy(F.desc("tier"), "handle").limit(accounts)  # the limit is the feature: so many accounts are asked
    rows = posts.filter(~F.col("reply") & (F.col("body") != "") & fresh(F.col("created"), target, hours)).join(top, "handle").withColumn("address", F.concat_ws("/", F.lit("https://x.com"), "handle", F.lit("status"), "post_id"))
    one = keep_best(rows, ["address"], [F.desc("created"), F.asc("post_id")])
    place = F.row_number().over(Window.partitionBy("handle").orderBy(F.desc("created"), "post_id"))
    return one.withColumn("place", place).filter(F.col("place") <= each)


def unless_stale(posts: DataFrame, pos: str, created: str, target: Column, days: int = 7, head: int = 5) -> DataFrame:
    """The rows of a feed, or none if the newest of its first ``head`` is older than ``days``: a frozen feed. Without a readable date it passes."""
    newest = posts.filter(F.col(pos) < head).agg(F.max(created).alias("_newest"))  # one row
    ok = F.col("_newest").isNull() | (F.col("_newest") >= target - F.expr(f"INTERVAL '{days}' DAY"))
    return posts.crossJoin(F.broadcast(newest)).filter(ok).drop("_newest")


_PAPER = "struct<arxiv_id: string, title: string, abstract: string, authors: array<string>, PRIMARY_TOPIC_ID: string, PRIMARY_TOPIC_LABEL: string, SCORE: int, RELEVANCE: int, NOVELTY: int, COMMENT: string, HOTSPOT_PAPER_TAGS: array<string>, HOTSPOT_PAPER_PRIMARY_KIND: string, HOTSPOT_PAPER_PRIMARY_LABEL: string, HOTSPOT_PAPER_COMMENT: string>"


def local_papers(files: DataFrame, target: Column, staleness_days: int = 2) -> DataFrame:
    """Items of the latest daily file not after the target, with its spotlight companion; none if the file is too old.

    ``files``: ``date, kind ('papers' or 'spotlight'), payload``. A spotlight paper that the daily file has is not given
    twice; its kind comes from the section that lists it, else from the paper itself, else from its first tag.
    """
    days = files.filter((F.col("kind") == "papers") & (F.col("date") <= target)).agg(F.max("date").alias("date"))
    days = days.filter(F.datediff(target, F.col("date")) <= staleness_days)  # one row or none
    chosen = files.join(F.broadcast(days), "date")
    flat = F.from_json("payload", f"map<string, {_PAPER}>")
    bundled = F.from_json("payload", f"papers map<string, {_PAPER}>, sections array<struct<kind: string, label: string, paper_ids: array<string>>>")
    daily = chosen.filter("kind = 'papers'").select("date", F.explode(F.when(F.size(bundled["papers"]) > 0, bundled["papers"]).otherwise(F.map_filter(flat, lambda k, v: ~k.isin("papers", "sections", "schema_version")))).alias("key", "p"))
    number = F.coalesce("p.arxiv_id", "key")
    tags = lambda *extra: F.filter(F.array(F.col("p.PRIMARY_TOPIC_ID"), F.col("p.PRIMARY_TOPIC_LABEL"), *extra), lambda x: x.isNotNull() & (x != ""))
    shown = lambda df, source, comment, kind, label: df.select(
        "date", F.lit(source).alias("source_id"), number.alias("number"), F.coalesce("p.title", "key").alias("title"), text.clip(text.clean_text(comment), 600).alias("summary"), kind.alias("kind"), label.alias("label"),
        tags(kind, label).alias("tags"), F.coalesce("p.authors", F.array().cast("array<string>")).alias("authors"), F.coalesce("p.SCORE", F.lit(0)).alias("score"), F.coalesce("p.RELEVANCE", F.lit(0)).alias("relevance"), F.coalesce("p.NOVELTY", F.lit(0)).alias("novelty"),
    )
    none = F.lit(None).cast("string")
    first = shown(daily, "local_papers", F.coalesce("p.COMMENT", "p.abstract"), none, none)
    spot = chosen.filter("kind = 'spotlight'").select("date", bundled.alias("b"))
    sections = spot.select(F.explode("b.sections").alias("s")).select(F.explode("s.paper_ids").alias("key"), "s.kind", "s.label")
    sections = sections.groupBy("key").agg(F.max_by(F.struct("kind", "label"), "kind").alias("s"))
    own = spot.select("date", F.explode("b.papers").alias("key", "p")).join(sections, "key", "left").join(first.select(F.col("number").alias("_seen")), number == F.col("_seen"), "left_anti")
    kind = F.coalesce("s.kind", "p.HOTSPOT_PAPER_PRIMARY_KIND", F.get("p.HOTSPOT_PAPER_TAGS", F.lit(0)))
    second = shown(own, "local_hotspot_papers", F.coalesce("p.HOTSPOT_PAPER_COMMENT", "p.COMMENT", "p.abstract"), kind, F.coalesce("s.label", "p.HOTSPOT_PAPER_PRIMARY_LABEL"))
    return first.unionByName(second)


def key_values(lines: DataFrame, line: str = "value") -> DataFrame:
    """``key, value`` of settings files: 'key=value' lines, comments and blank lines out, 'export' and quotes taken off, the last of equal keys."""
    t = F.trim(line)
    rows = lines.withColumn("_n", F.monotonically_increasing_id()).filter((t != "") & ~F.startswith(t, F.lit("#")) & F.contains(t, F.lit("=")))
    key = F.trim(F.regexp_replace(F.substring_index(t, "=", 1), r"^export\s+", ""))
    value = F.regexp_replace(F.trim(F.regexp_replace(t, r"^[^=]*=", "")), r"^(['\"])(.*)\1$", "$2")
    return rows.select(key.alias("key"), value.alias("value"), "_n").groupBy("key").agg(F.max_by("value", "_n").alias("value"))
