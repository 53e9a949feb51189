"""Captured pages as rows: newsletter segments, recap lists, sitemaps, what a page says about itself.

Built-in expressions over the text of a page; the order of first-wins rules is the place in the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.operators.items import fresh, keep_best
from gleaner.sources.listings import instant, unescape

# Hosts that are the newsletter itself or hold media, and titles and words that tell signal from noise.
INTERNAL_HOSTS = ["news.smol.ai", "latent.space", "www.latent.space", "support.substack.com", "x.com", "twitter.com", "mobile.twitter.com"]
MEDIA_HOSTS = ["i.redd.it", "v.redd.it", "pbs.twimg.com", "video.twimg.com"]
MEDIA_FILES = r"\.(?:jpg|jpeg|png|gif|webp|mp4|mov|avi)$"
GENERIC_TITLES = ["view image", "github repository", "learn more", "read more", "website", "link", "source"]
LOW_TITLES = ["ainews is now a section", "not much happened today"]
LOW_TALK = [
    "help me", "what plugins", "worth it", "working dog", "drama just dropped", "chatgtp is legit helping me cook", "for local agentic ai", "accurate prompts for any ai tool", "life-threatened dog", "cancerous tumor",
    "personalized mrna vaccine", "security system", "home-security-benchmark", "powerbook g4",
]
HIGH_HOSTS = ["github.com", "arxiv.org", "huggingface.co", "openai.com", "anthropic.com", "blog.google", "deepmind.google", "ai.meta.com"]
HIGH_WORDS = ["openai", "anthropic", "claude", "gpt", "gemini", "deepseek", "qwen", "llama", "mistral", "model", "release", "launch", "paper", "reasoning", "agent", "benchmark", "github", "open-source", "fine-tuning"]
LINK_STOPWORDS = "the and for are with that this from very good more about just some been have will new can all not but was its has".split()

_ANCHOR = r"""(?is)<a\b[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>"""


def plain(c: Column) -> Column:
    """The text of a piece of markup."""
    return text.clean_text(unescape(F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " "), F.lit("&nbsp;"), F.lit(" "))))


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def _in(c: Column, values: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(v) for v in values]), lambda v: F.contains(c, v))


def segments(page: Column) -> Column:
    """The pieces of a page that end with a block, those without text left out."""
    return F.filter(F.split(F.coalesce(page, F.lit("")), r"(?i)</(?:p|li|h\d|blockquote|div|section)>"), lambda s: plain(s) != "")


def anchors(piece: Column) -> Column:
    """``href, label`` of the links of a piece, in order."""
    labels = F.transform(F.regexp_extract_all(piece, F.lit(_ANCHOR), F.lit(2)), plain)
    return F.arrays_zip(F.transform(F.regexp_extract_all(piece, F.lit(_ANCHOR), F.lit(1)), lambda h: F.trim(unescape(h))).alias("href"), labels.alias("label"))


def activity_said(body: Column) -> Column:
    """The number in '(Activity: 1,234)', 0 where there is none."""
    return F.coalesce(F.replace(F.regexp_extract(body, r"(?i)\(Activity:\s*([\d,]+)\)", 1), F.lit(","), F.lit("")).try_cast("int"), F.lit(0))


def segment_title(body: Column) -> Column:
    """A title for a segment: what comes before its activity, marks off its ends; of a long one the first sentence."""
    t = text.clean_text(F.regexp_replace(F.split(body, r"(?i)\(Activity:\s*[\d,]+\)")[0], r"^[ :\-|]+|[ :\-|]+$", ""))
    return F.when((F.length(t) > 180) & F.contains(t, F.lit(". ")), F.trim(F.substring_index(t, ". ", 1))).otherwise(t)


def chosen_link(links: Column, title: Column) -> Column:
    """The best link of a segment: outside and no media; its host, a telling label and words of the title count; shorter labels, then earlier links win ties."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))
    stop = F.array(*[F.lit(w) for w in LINK_STOPWORDS])
    keys = F.filter(F.array_distinct(words(title)), lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w))

    def scored(a: Column, i: Column) -> Column:
        h, path = host_of(a["href"]), F.lower(F.coalesce(F.try_parse_url(a["href"], F.lit("PATH")), F.lit("")))
        label = F.lower(a["label"])
        shared = F.size(F.array_intersect(keys, words(F.concat_ws(" ", path, label))))
        score = (
            F.when(_in(h, ["github.com", "arxiv.org", "huggingface.co"]), 6).when(_in(h, ["reddit.com", "news.ycombinator.com"]), 4).otherwise(5)
            + F.when((label != "") & ~label.isin(*GENERIC_TITLES), 2).otherwise(0) + F.when(F.contains(label, F.lit("github repository")), 1).otherwise(0) + F.when(shared >= 2, 5).when(shared == 1, 3).otherwise(0)
        )
        usable = (h != "") & ~h.isin(*INTERNAL_HOSTS) & ~h.isin(*MEDIA_HOSTS) & ~path.rlike(MEDIA_FILES)
        return F.when(usable, F.struct(score.alias("score"), (-F.length(label)).alias("short"), (-i).alias("early"), a["href"].alias("href")))

    return F.array_max(F.array_compact(F.transform(links, scored)))["href"]


def low_title(title: Column) -> Column:
    low = F.lower(text.clean_text(title))
    return (F.length(low) < 12) | low.isin(*GENERIC_TITLES) | _in(low, LOW_TITLES)


def high_signal(title: Column, url: Column, activity: Column) -> Column:
    """Is a segment worth an item: never small talk; a known host, or a telling title with enough activity (a question in a community needs both)."""
    low, h = F.lower(text.clean_text(title)), host_of(url)
    word = _in(low, HIGH_WORDS)
    community = (activity >= 150) & word
    return F.when(_in(low, LOW_TALK), False).when(_in(h, HIGH_HOSTS), True).when(F.contains(h, F.lit("reddit.com")), community).otherwise((activity >= 200) & word)


def newsletter_items(issues: DataFrame, issue: str, page: str, limit: int = 24) -> DataFrame:
    """Items of newsletter issues: the segments of high signal, each title and link once, the first ``limit`` an issue."""
    rows = issues.select(F.col(issue).alias("issue"), F.posexplode(segments(F.col(page))).alias("pos", "piece")).withColumn("body", plain(F.col("piece")))
    rows = rows.withColumns({"title": segment_title(F.col("body")), "activity": activity_said(F.col("body"))}).filter(~low_title(F.col("title")))
    rows = rows.withColumn("url", chosen_link(anchors(F.col("piece")), F.col("title"))).filter("url is not null")
    one = keep_best(rows.filter(high_signal(F.col("title"), F.col("url"), F.col("activity"))).withColumn("_low", F.lower("title")), ["issue", "_low", "url"], [F.asc("pos")])
    place = F.row_number().over(Window.partitionBy("issue").orderBy("pos"))
    return one.withColumn("place", place).filter(F.col("place") <= limit).select("issue", "title", text.clip(F.col("body"), 520).alias("summary"), "url", "activity", "place")


def recap_items(issues: DataFrame, issue: str, page: str, heading: str, handles: DataFrame) -> DataFrame:
    """Items of the list under a heading: entries that link to a known handle; 80 points of activity a linked address, 60 at least; an address once.

    ``handles``: ``handle, kind, tier`` of the accounts that count.
    """
    begin = rf"(?is)<h[123][^>]*>\s*(?:<[^>]+>\s*)*{heading}\s*(?:<[^>]+>\s*)*</h[123]>(.*?)(?:<h[12]\b|$)"
    part = F.regexp_extract(F.coalesce(page, F.lit("")), begin, 1)
    rows = issues.select(F.col(issue).alias("issue"), F.posexplode(F.regexp_extract_all(part, F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), F.lit(1))).alias("pos", "entry"))
    links = rows.select("issue", "pos", "entry", F.posexplode(anchors(F.col("entry"))).alias("nth", "a")).filter(host_of(F.col("a.href")).rlike(r"(?:^|\.)(?:x|twitter)\.com$"))
    handle = F.lower(F.regexp_extract(F.try_parse_url("a.href", F.lit("PATH")), r"^/([A-Za-z0-9_]+)", 1))
    known = links.withColumn("handle", handle).join(handles.select(F.lower("handle").alias("handle"), "kind", "tier"), "handle")
    per = known.groupBy("issue", "pos").agg(
        F.min_by(F.struct(F.col("a.href").alias("url"), "kind", "tier"), "nth").alias("f"), F.countDistinct(F.try_parse_url("a.href", F.lit("PATH"))).alias("n"), F.first("entry").alias("entry")
    )
    strong = plain(F.regexp_extract("entry", r"(?is)<strong[^>]*>(.*?)</strong>", 1))
    body = plain(F.col("entry"))
    out = per.select("issue", "pos", F.when(strong != "", strong).otherwise(F.trim(F.substring_index(body, ":", 1))).alias("title"), text.clip(body, 520).alias("summary"), "f.*", F.greatest(F.lit(60), 80 * F.col("n")).cast("int").alias("activity"))
    return keep_best(out, ["issue", "url"], [F.asc("pos")])


def sitemap_pages(raw: DataFrame, source: str, xml: str, contains: Column, target: Column, hours: int, each: int = 8) -> DataFrame:
    """``source, url, changed``: addresses of sitemaps that hold a text and are fresh or undated, the ``each`` latest a source."""
    schema = "url array<struct<loc: string, lastmod: string>>"
    rows = raw.select(F.col(source).alias("source"), contains.alias("_part"), F.explode(F.from_xml(xml, schema, {"rowTag": "urlset", "ignoreNamespace": "true"})["url"]).alias("u"))
    rows = rows.select("source", F.trim("u.loc").alias("url"), F.trim("u.lastmod").alias("changed"), "_part").filter((F.coalesce("url", F.lit("")) != "") & F.contains("url", F.coalesce("_part", F.lit(""))))
    rows = rows.filter(F.col("changed").isNull() | fresh(instant(F.col("changed")), target, hours))
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc_nulls_last("changed"), "url"))
    return rows.withColumn("place", place).filter(F.col("place") <= each).select("source", "url", instant(F.col("changed")).alias("changed"), "place")


def _meta(page: Column, name: str) -> Column:
    """The content of a meta tag, whichever way round its attributes stand."""
    key = rf"""(?:property|name)=["']{name}["']"""
    a = F.regexp_extract(page, rf"""(?is)<meta\b[^>]*{key}[^>]*content=["']([^"']*)["']""", 1)
    b = F.regexp_extract(page, rf"""(?is)<meta\b[^>]*content=["']([^"']*)["'][^>]*{key}""", 1)
    return F.nullif(F.trim(unescape(F.coalesce(F.nullif(a, F.lit("")), b))), F.lit(""))


def _linked(page: Column, *names: str) -> Column:
    """The first of the names that the page's linked data give a date for."""
    data = F.array_join(F.regexp_extract_all(page, F.lit(r"""(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"""), F.lit(1)), "\n")
    return F.coalesce(*[instant(F.nullif(F.regexp_extract(data, rf'"{n}"\s*:\s*"([^"]*)"', 1), F.lit(""))) for n in names])


def page_date(page: Column) -> Column:
    """When a page says it was published: its meta tags, else a time outside its articles, else its linked data; null where none is readable."""
    p = F.coalesce(page, F.lit(""))
    outside = F.regexp_replace(p, r"(?is)<article\b.*?</article>", " ")
    times = F.transform(F.slice(F.regexp_extract_all(outside, F.lit(r"""(?is)<time\b[^>]*datetime=["']([^"']+)["']"""), F.lit(1)), 1, 3), instant)
    return F.coalesce(*[instant(_meta(p, n)) for n in ("article:published_time", "og:updated_time", "date")], F.get(F.array_compact(times), F.lit(0)), _linked(p, "datePublished", "dateCreated", "dateModified"))


def official_title(c: Column) -> Column:
    """A page's title without its site's name behind a bar."""
    return F.trim(F.regexp_replace(text.clean_text(c), r"\s+[|·]\s+[^|·]{1,40}$", ""))


def roundup_title(c: Column) -> Column:
    """A roundup's headline without what it adds behind marks, a date or signs in front, and the leading topic word."""
    t = text.clean_text(c)
    for mark in (" PLUS:", " ALSO:", " Two new eps", " | "):
        t = F.trim(F.substring_index(t, mark, 1))
    t = F.regexp_replace(t, r"^(?:[A-Z][a-z]{2,8}\.? \d{1,2}(?:, \d{4})?\s*[:–—-]?\s*)", "")
    t = F.trim(F.regexp_replace(t, r"^[\x{1F300}-\x{1FAFF}\x{2702}-\x{27B0}\x{FE00}-\x{FE0F}\x{200D}\s]+", ""))
    return F.trim(F.regexp_replace(t, r"(?i)^(?:ai|tech) ", ""))


def display_title(c: Column) -> Column:
    """A title for display: an age, signs and marks in front taken off; the title itself where nothing is left."""
    t = F.trim(F.coalesce(c, F.lit("")))
    u = F.trim(F.regexp_replace(t, r"(?i)^\d+\s+hours?\s+ago\s*", ""))
    u = F.trim(F.regexp_replace(u, r"^[\x{1F300}-\x{1FAFF}\x{2702}-\x{27B0}\x{FE00}-\x{FE0F}\x{200D}\s]+", ""))
    u = F.trim(F.regexp_replace(u, r"^[·•|—\- ]+", ""))
    return F.when(u != "", u).otherwise(t)


def page_facts(pages: DataFrame, page: str, keys: list[str], least_title: int = 10, least_paragraph: int = 60) -> DataFrame:
    """``title, summary, published`` of article pages, beside ``keys``: title from its card, heading or title tag; summary from its card or first long paragraph."""
    p = F.coalesce(F.col(page), F.lit(""))
    tag = lambda name: F.nullif(plain(F.regexp_extract(p, rf"(?is)<{name}\b[^>]*>(.*?)</{name}>", 1)), F.lit(""))
    title = official_title(F.coalesce(_meta(p, "og:title"), tag("h1"), tag("title")))
    long = F.filter(F.transform(F.regexp_extract_all(p, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1)), plain), lambda x: F.length(x) > least_paragraph)
    summary = F.coalesce(_meta(p, "og:description"), _meta(p, "description"), F.get(long, F.lit(0)), F.lit(""))
    time = F.nullif(F.regexp_extract(p, r"""(?is)<time\b[^>]*datetime=["']([^"']+)["']""", 1), F.lit(""))
    rows = pages.select(*keys, title.alias("title"), text.clip(text.clean_text(summary), 650).alias("summary"), F.coalesce(_linked(p, "datePublished", "dateCreated"), instant(time)).alias("published"))
    return rows.filter(F.length("title") >= least_title)


def roundup_items(rows: DataFrame, trust: str, paper: str, words: list[str], low: Column, most: int = 5, least: int = 2) -> DataFrame:
    """Rows of roundup pages (``site, pos, title, url``) worth an item: no papers, no noise, of sites of low trust only with a signal word; ``most`` a site (``least`` of low trust), an address once."""
    signal = F.size(F.array_intersect(F.split(F.lower("title"), r"\W+"), F.array(*[F.lit(w) for w in words]))) > 0
    kept = rows.filter(~F.lower("url").rlike(paper) & ~low & (~F.col(trust) | signal))
    one = keep_best(kept, ["url"], [F.asc("site"), F.asc("pos")])
    place = F.row_number().over(Window.partitionBy("site").orderBy("pos", "url"))
    return one.withColumn("place", place).filter(F.col("place") <= F.when(F.col(trust), least).otherwise(most))
