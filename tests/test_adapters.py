"""Captured listings and pages, each against a hand-made fixture with its edge cases."""

from __future__ import annotations

import html
import json

import pytest
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.sources import listings as ls
from gleaner.sources import pages as pg

def now():
    return F.lit("2026-03-20 00:00:00").cast("timestamp")



def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_instants(spark):
    values = ["2026-03-19T10:00:00Z", "2026-03-19T10:00:00+02:00", "Tue Dec 10 07:00:00 +0000 2024", "2026-03-19", "soon", "", None]
    got = [str(r[0]) if r[0] else None for r in frame(spark, [(v,) for v in values], "v string").select(ls.instant(F.col("v"))).collect()]
    assert got == ["2026-03-19 10:00:00", "2026-03-19 08:00:00", "2024-12-10 07:00:00", "2026-03-19 00:00:00", None, None, None]


ATOM = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">
<entry><id>http://p.example/abs/2503.01234v2</id><title>A  title
 over lines</title><summary> Some text. </summary><author><name>Ada One</name></author><author><name>Bo Two</name></author><arxiv:primary_category term="cs.CL"/></entry>
<entry><id>http://p.example/abs/2503.09999v1</id><title>Other</title><summary>x</summary><author><name>C</name></author><arxiv:primary_category term="cs.CV"/></entry></feed>"""
RSS = """<rss xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:arxiv="http://arxiv.org/schemas/atom"><channel>
<item><title>On things (arXiv:2503.01234v1 [cs.CL])</title><link>https://p.example/abs/2503.01234v1</link><description>arXiv:2503.01234v1 Announce Type: new
Abstract: We &lt;b&gt;show&lt;/b&gt; it.</description><dc:creator>&lt;a href="u"&gt;Ada One&lt;/a&gt;, Bo Two</dc:creator><arxiv:announce_type>new</arxiv:announce_type><category>cs.CL</category><category>cs.AI</category></item>
<item><title>Old</title><link>https://p.example/abs/2503.00001v3</link><description>Abstract: y</description><dc:creator>C</dc:creator><arxiv:announce_type>replace</arxiv:announce_type><category>cs.CL</category></item>
<item><title>Cross</title><link>https://p.example/abs/2503.00002v1</link><description>Abstract: z</description><dc:creator>D</dc:creator><arxiv:announce_type>new</arxiv:announce_type><category>cs.CV</category></item></channel></rss>"""


def test_paper_feeds(spark):
    raw = frame(spark, [("cs.CL", ATOM), ("cs.CL", None), ("cs.CL", "<feed></feed>")], "area string, xml string")
    rows = ls.atom_papers(raw, primary_only=True).collect()
    assert [tuple(r) for r in rows] == [("cs.CL", "2503.01234", "A title over lines", "Some text.", ["Ada One", "Bo Two"])]
    assert ls.atom_papers(raw).count() == 2
    raw = frame(spark, [("cs.CL", RSS)], "area string, xml string")
    rows = ls.rss_papers(raw, primary_only=True).collect()
    assert [tuple(r) for r in rows] == [("cs.CL", "2503.01234", "On things", "We show it.", ["Ada One", "Bo Two"])]
    assert {r["number"] for r in ls.rss_papers(raw, announced=("new", "replace")).collect()} == {"2503.01234", "2503.00001", "2503.00002"}
    both = ls.by_area({"a": ls.rss_papers(raw).drop("area"), "b": ls.rss_papers(raw).drop("area")})
    assert both.groupBy("area").count().count() == 2 and both.count() == 4


def test_embedded_papers(spark):
    paper = lambda i, votes, at: {"paper": {"id": f"2603.{i:05d}", "title": f"Title & {i}", "summary": "s", "publishedAt": at, "upvotes": votes, "authors": []}}
    data = {"dailyPapers": [paper(1, 20, "2026-03-18T00:00:00Z"), paper(2, 4, "2026-03-18T00:00:00Z"), paper(3, 9, "2025-01-01T00:00:00Z"), paper(4, 9, None), paper(5, 7, "2026-03-19T00:00:00Z"), paper(6, 7, "2026-03-19T00:00:00Z")]}
    page = f'<div class="x" data-props="{html.escape(json.dumps(data))}" data-y="1"></div>'
    got = ls.embedded_papers(frame(spark, [(page,), ("<p>none</p>",), (None,)], "page string"), "page", now(), limit=2).collect()
    assert sorted((r["number"], r["title"], r["kind"], r["place"]) for r in got) == [("2603.00001", "Title & 1", "daily_hot", 1), ("2603.00005", "Title & 5", None, 2)]


def test_community_posts(spark):
    at = 1773900000.0  # 2026-03-19
    post = lambda **k: {"data": {"title": "A title that is long enough", "score": 60, "created_utc": at, "permalink": f"/r/x/{k.get('permalink', '1')}", "is_self": True, "num_comments": 3, **{a: b for a, b in k.items() if a != "permalink"}}}
    page = {"data": {"children": [post(), post(), post(permalink="2", score=10), post(permalink="3", title="short"), post(permalink="4", created_utc=1.0), post(permalink="5", url="https://o.example/a", is_self=False), post(permalink="6", created_utc=None)]}}
    raw = frame(spark, [("big", json.dumps(page)), ("unknown", json.dumps(page)), ("big", "no json")], "sub string, j string")
    got = ls.community_posts(raw, "sub", "j", {"big": 50}, now(), 48).collect()
    assert sorted((r["permalink"], r["address"], r["activity"]) for r in got) == [("/r/x/1", "/r/x/1", 69), ("/r/x/5", "https://o.example/a", 69)]


def test_repositories(spark):
    repo = lambda name, stars, **k: {"full_name": name, "html_url": f"https://github.com/{name}", "description": "d", "stargazers_count": stars, "created_at": "2026-03-10T00:00:00Z", "owner": {"login": name.split("/")[0]}, **k}
    rows = [repo("org/real", 420), repo("org/real", 420), repo("o/awesome-x", 999), repo("o/x-awesome", 999), repo("o/w", 400, description="A wrapper"), repo("o/w2", 600, description="A wrapper"), repo("o/mcp-a", 200), repo("o/mcp-b", 200, description="a benchmark"), repo("o/old", 900, created_at="2020-01-01T00:00:00Z"), repo("o/few", 3), repo("o/arch", 900, archived=True), repo("o/fork", 900, fork=True)]
    raw = frame(spark, [("q1", json.dumps({"items": rows})), ("q2", json.dumps({"items": rows[:1]}))], "q string, j string")
    got = ls.repositories(raw, "q", "j", now(), 50, 30, 10).collect()
    assert [(r["full_name"], r["stars"], r["query"]) for r in got] == [("org/real", 420, "q1"), ("o/w2", 600, "q1"), ("o/mcp-b", 200, "q1")]
    assert [r["full_name"] for r in ls.repositories(raw, "q", "j", now(), 50, 30, 1).collect()] == ["org/real"]


def test_discussions(spark):
    hit = lambda i, **k: {"objectID": str(i), "title": "New model out", "url": "https://o.example/a", "created_at": "2026-03-19T12:00:00Z", "points": 80, "num_comments": 20, "author": "a", **k}
    rows = [hit(1), hit(2, points=5), hit(3, num_comments=1), hit(4, title="Cats", url="https://news.openai.com/x", points=300), hit(5, title="Cats"), hit(6, created_at="2025-01-01T00:00:00Z"), hit("")]
    raw = frame(spark, [("a", json.dumps({"hits": rows})), ("b", json.dumps({"hits": [hit(1, points=999)]}))], "q string, j string")
    got = ls.discussions(raw, "q", "j", now(), 36, 50, 10, ["model"], ["openai.com"], 5).collect()
    assert [(r["objectID"], r["points"]) for r in got] == [("4", 300), ("1", 80)]


def test_timelines(spark):
    v2 = {"data": [{"id": "1", "text": "We released it", "created_at": "2026-03-19T10:00:00Z", "author_id": "9", "public_metrics": {"like_count": 10, "reply_count": 1, "retweet_count": 2, "quote_count": 1, "bookmark_count": 3, "impression_count": 2500}, "entities": {"urls": [{"expanded_url": "https://o.example"}]}},
                   {"id": "2", "text": "RT @x: old", "created_at": "2026-03-19T10:00:00Z", "author_id": "9"}, {"id": "3", "text": "hm", "author_id": "9", "created_at": "2026-03-19T10:00:00Z", "referenced_tweets": [{"type": "replied_to"}]}], "includes": {"users": [{"id": "9", "username": "Lab", "name": "The Lab", "verified": True}]}}
    other = {"tweets": [{"id": "4", "text": "News", "createdAt": "Thu Mar 19 07:00:00 +0000 2026", "likeCount": 1, "viewCount": 999, "author": {"userName": "Ada", "name": "Ada"}}, {"id": "5", "text": "@you yes", "createdAt": "Thu Mar 19 07:00:00 +0000 2026", "author": {"userName": "Ada"}}]}
    posts = ls.timeline_posts(frame(spark, [(json.dumps(v2),), (json.dumps(other),), ("x",)], "j string"), "j")
    got = {r["post_id"]: r for r in posts.collect()}
    assert got["1"]["activity"] == 10 + 3 + 3 + 4 + 4 + 2 and got["1"]["urls"] == ["https://o.example"] and got["1"]["handle"] == "lab"
    assert {k: r["reply"] for k, r in got.items()} == {"1": False, "2": True, "3": True, "4": False, "5": True} and str(got["4"]["created"]) == "2026-03-19 07:00:00"
    registry = frame(spark, [("LAB", "company", 3, True), ("ada", "researcher", 2, True), ("bo", "company", 9, False)], "handle string, kind string, tier int, active boolean")
    assert [r["post_id"] for r in ls.account_posts(posts, registry, ["company"], now(), 48, 24).collect()] == ["1"]
    assert sorted(r["post_id"] for r in ls.account_posts(posts, registry, ["company", "researcher"], now(), 48, 1).collect()) == ["1"]


@pytest.mark.parametrize("dates,kept", [(["2026-03-19", "2020-01-01"], 2), (["2026-03-01", "2026-02-01"], 0), ([None, None], 2)])
def test_stale_feed_is_empty(spark, dates, kept):
    posts = frame(spark, list(enumerate(dates)), "pos int, at string").withColumn("at", F.col("at").cast("timestamp"))
    assert ls.unless_stale(posts, "pos", "at", now()).count() == kept


def test_local_papers(spark):
    paper = lambda i, **k: {"arxiv_id": i, "title": f"T{i}", "abstract": "abs", "authors": ["A"], "SCORE": 9, **k}
    daily = json.dumps({"1": paper("1", PRIMARY_TOPIC_ID="t", PRIMARY_TOPIC_LABEL="L", COMMENT="good"), "2": paper("2")})
    spot = json.dumps({"schema_version": 2, "papers": {"2": paper("2"), "3": paper("3", HOTSPOT_PAPER_TAGS=["tag"]), "4": paper("4", HOTSPOT_PAPER_COMMENT="hot")}, "sections": [{"kind": "new_frontier", "label": "New", "paper_ids": ["4"]}]})
    day = lambda s: __import__("datetime").date.fromisoformat(s)
    files = frame(spark, [(day("2026-03-18"), "papers", json.dumps({"9": paper("9")})), (day("2026-03-20"), "papers", daily), (day("2026-03-20"), "spotlight", spot), (day("2026-03-21"), "papers", "{}")], "date date, kind string, payload string")
    got = {r["number"]: r for r in ls.local_papers(files, F.lit("2026-03-20").cast("date")).collect()}
    assert {k: (r["source_id"], r["kind"]) for k, r in got.items()} == {"1": ("local_papers", None), "2": ("local_papers", None), "3": ("local_hotspot_papers", "tag"), "4": ("local_hotspot_papers", "new_frontier")}
    assert got["1"]["tags"] == ["t", "L"] and got["1"]["summary"] == "good" and got["4"]["summary"] == "hot" and got["4"]["label"] == "New"
    assert ls.local_papers(files, F.lit("2026-04-20").cast("date")).count() == 0
    bundle = frame(spark, [(day("2026-03-20"), "papers", spot)], "date date, kind string, payload string")
    assert ls.local_papers(bundle, F.lit("2026-03-20").cast("date")).count() == 3


def test_settings(spark):
    lines = ["# note", "", "A=1", "export B = 'two words'", 'C="x=y"', "A=3", "no value"]
    got = {r["key"]: r["value"] for r in ls.key_values(frame(spark, [(x,) for x in lines], "value string").coalesce(1)).collect()}
    assert got == {"A": "3", "B": "two words", "C": "x=y"}


ISSUE = """<p>Not much happened today and so on, see <a href="https://o.example">x</a></p>
<ul><li>Acme model release with tools (Activity: 1,234) <a href="https://i.redd.it/a.png">view image</a> <a href="https://github.com/acme/tools">GitHub Repository</a> <a href="https://www.reddit.com/r/x/1">thread</a></li>
<li>Help me pick a model for my laptop please (Activity: 900) <a href="https://www.reddit.com/r/x/2">thread</a></li>
<li>Acme model release with tools (Activity: 5) <a href="https://github.com/acme/tools">again</a></li>
<li>A quiet thread on model weights (Activity: 20) <a href="https://www.reddit.com/r/x/3">thread</a></li>
<li>A busy thread on model weights (Activity: 400) <a href="https://www.reddit.com/r/x/4">thread</a></li>
<li>Nothing linked here about a model release</li></ul>"""


def test_newsletter_items(spark):
    got = pg.newsletter_items(frame(spark, [("i1", ISSUE), ("i2", None), ("i3", "")], "issue string, page string"), "issue", "page").orderBy("place").collect()
    assert [(r["title"], r["url"], r["activity"]) for r in got] == [("Acme model release with tools", "https://github.com/acme/tools", 1234), ("A busy thread on model weights", "https://www.reddit.com/r/x/4", 400)]
    assert pg.newsletter_items(frame(spark, [("i1", ISSUE)], "issue string, page string"), "issue", "page", 1).count() == 1


def test_recap_items(spark):
    page = """<h1>Other</h1><ul><li><a href="https://x.com/lab/status/0">no</a></li></ul><h1><strong>AI Twitter Recap</strong></h1><p><strong>Part</strong></p>
    <ul><li><strong>Labs ship</strong>: text <a href="https://x.com/Lab/status/1">a</a> and <a href="https://twitter.com/ada/status/2">b</a></li><li>Nobody known <a href="https://x.com/zzz/status/3">c</a></li>
    <li>One: more <a href="https://x.com/ada/status/4">d</a></li></ul><h1>After</h1><ul><li><a href="https://x.com/ada/status/5">no</a></li></ul>"""
    handles = frame(spark, [("lab", "company", 3), ("Ada", "researcher", 2)], "handle string, kind string, tier int")
    got = pg.recap_items(frame(spark, [("i", page), ("j", None)], "issue string, page string"), "issue", "page", "AI Twitter Recap", handles).orderBy("pos").collect()
    assert [(r["title"], r["url"], r["activity"], r["kind"]) for r in got] == [("Labs ship", "https://x.com/Lab/status/1", 160, "company"), ("One", "https://x.com/ada/status/4", 80, "researcher")]


def test_sitemaps(spark):
    url = lambda p, d: f"<url><loc>https://o.example{p}</loc>{f'<lastmod>{d}</lastmod>' if d else ''}</url>"
    xml = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' + url("/blog/a", "2026-03-19") + url("/blog/b", None) + url("/about", "2026-03-19") + url("/blog/old", "2024-01-01") + url("/blog/c", "2026-03-19T20:00:00Z") + "</urlset>"
    got = pg.sitemap_pages(frame(spark, [("s", xml, "/blog/")], "s string, xml string, part string"), "s", "xml", F.col("part"), now(), 48).orderBy("place").collect()
    assert [r["url"][-2:] for r in got] == ["/c", "/a", "/b"]


PAGES = {
    "meta": '<head><meta content="2026-03-01T00:00:00Z" property="article:published_time"></head><time datetime="2025-01-01">x</time>', "time": '<article><time datetime="2020-01-01">x</time></article><time datetime="2026-02-02">y</time>',
    "ld": '<article><time datetime="2020-01-01">x</time></article><script type="application/ld+json">{"@type": "A", "dateCreated": "2026-01-05"}</script>', "none": "<p>text</p>", "bad": '<meta property="date" content="soon">',
}


def test_page_dates(spark):
    got = {r["k"]: str(r["d"])[:10] if r["d"] else None for r in frame(spark, [*PAGES.items(), ("null", None)], "k string, p string").select("k", pg.page_date(F.col("p")).alias("d")).collect()}
    assert got == {"meta": "2026-03-01", "time": "2026-02-02", "ld": "2026-01-05", "none": None, "bad": None, "null": None}


def test_page_facts(spark):
    rows = [(1, '<meta property="og:title" content="Acme ships a model | Acme"><meta name="description" content="What it is"><time datetime="2026-03-02">x</time>'), (2, f"<h1>Heading &amp; more words</h1><p>short</p><p>{'long words ' * 10}</p>"), (3, "<title>Tiny</title>"), (4, None)]
    got = {r["id"]: r for r in pg.page_facts(frame(spark, rows, "id int, p string"), "p", ["id"]).collect()}
    assert set(got) == {1, 2} and got[1]["title"] == "Acme ships a model" and got[1]["summary"] == "What it is" and str(got[1]["published"])[:10] == "2026-03-02"
    assert got[2]["title"] == "Heading & more words" and got[2]["summary"].startswith("long words") and got[2]["published"] is None


def test_titles(spark):
    values = [("🚀 AI agents learn to plan PLUS: more", "agents learn to plan"), ("Mar 3, 2026: Tech chips get cheaper | Site", "chips get cheaper"), (None, "")]
    assert [r[0] for r in frame(spark, [(a,) for a, _ in values], "t string").select(pg.roundup_title(F.col("t"))).collect()] == [b for _, b in values]
    values = [("3 hours ago 🚀 · A title", "A title"), ("— · ", "— ·"), ("Plain", "Plain")]
    assert [r[0] for r in frame(spark, [(a,) for a, _ in values], "t string").select(pg.display_title(F.col("t"))).collect()] == [b for _, b in values]


def test_roundup_items(spark):
    rows = [("a", 1, "Model weights are out today", "https://o.example/1", False), ("a", 2, "Same", "https://o.example/1", False), ("a", 3, "A paper", "https://arxiv.org/abs/1", False), ("b", 1, "Cats and dogs again", "https://o.example/2", True), ("b", 2, "A model for cats", "https://o.example/3", True)]
    rows += [("c", i, f"Story number {i} of the day", f"https://c.example/{i}", False) for i in range(9)]
    got = pg.roundup_items(frame(spark, rows, "site string, pos int, title string, url string, low_trust boolean"), "low_trust", r"arxiv\.org", ["model"], F.lit(False)).collect()
    assert sorted((r["site"], r["pos"]) for r in got) == [("a", 1), ("b", 2), *[("c", i) for i in range(5)]]


def test_entities_and_boosts(spark):
    values = ["OpenAI and GPT-4 meet Claude 3", "NVIDIA's CUDA; nvidia again", "stable diffusion by Stability AI", "nothing here", None]
    got = [r[0] for r in frame(spark, [(v,) for v in values], "t string").select(text.entities(F.col("t"))).collect()]
    assert got == [["claude 3", "gpt-4", "openai"], ["cuda", "nvidia"], ["stability ai", "stable diffusion"], [], []]
    pairs = [("Acme Falcon sparrow heron lands", "Falcon sparrow heron", 0.84), ("Falcon qwen25 lands", "Falcon qwen25", 0.78), ("Falcon sparrow", "Falcon sparrow", 0.0), ("llama4 model", "llama4 research", 0.4), ("open model", "open model", 0.0), ("122b things", "122 stuff", 0.4)]
    df = frame(spark, pairs, "a string, b string, want double")
    got = df.select(text.overlap_boost(F.array_intersect(text.telling_words(F.col("a")), text.telling_words(F.col("b")))).alias("x"), "want").collect()
    assert all(r["x"] == r["want"] for r in got)
