"""Queries over the item operators: gates, classes, deduplication, joins, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import fixed, text, url
from gleaner.functions.num import clamp, half_up
from gleaner.operators import items as op
from gleaner.tables import table

def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hotspot_items")


def _body() -> F.Column:
    return F.lower(F.concat_ws(" ", "title", "summary"))


def q_freshness_gate(spark: SparkSession, d: str) -> DataFrame:
    """PRED-02/03/05: items by batch that are fresh at the batch date, unknown times passing."""
    joined = _items(spark, d).join(F.broadcast(table(spark, d, "batches")), "batch_id")
    noon = F.col("batch_date").cast("timestamp") + F.expr("INTERVAL '12' HOUR")
    return joined.groupBy("batch_id").agg(F.count("*").alias("n"), F.count_if(op.fresh(F.col("fetched_at"), noon, 12)).alias("fresh"))


def q_age_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Items outside age bounds around their batch's date."""
    joined = _items(spark, d).join(F.broadcast(table(spark, d, "batches")), "batch_id")
    day = F.col("batch_date").cast("timestamp")
    inside = F.coalesce(F.col("fetched_at").between(day - F.expr("INTERVAL '14' DAY"), day + F.expr("INTERVAL '18' HOUR")), F.lit(True))
    return joined.filter(~inside).select("item_id", "batch_id")


def q_on_date(spark: SparkSession, d: str) -> DataFrame:
    """Items by day, those of its middle hours counted, unknown times rejected, from a first day on."""
    rows = _items(spark, d).filter(F.col("fetched_at") >= F.lit("2026-01-01").cast("timestamp"))
    return rows.groupBy(F.to_date("fetched_at").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.hour("fetched_at").between(6, 18)).alias("daytime"))


def q_quality_filter(spark: SparkSession, d: str) -> DataFrame:
    """PRED-13/14/15: titles not worth showing, headlines not worth a story, items not worth a place."""
    t = F.coalesce("title", F.lit(""))
    flags = {"display": op.low_quality(t, fixed.LOW_DISPLAY, 8), "headline": op.low_quality(F.trim(t), fixed.LOW_HEADLINE, 10), "item": op.low_item(F.col("title"), F.col("url"))}
    return _items(spark, d).select("item_id", *[c.alias(n) for n, c in flags.items()]).filter("display or headline or item")


def q_engineering_score(spark: SparkSession, d: str) -> DataFrame:
    """PRED-16/17: talk about engineering and lack of substance, by role."""
    talk, thin = op.talk_scores(F.col("title"), F.col("summary"), F.col("source_role"))
    return _items(spark, d).select("item_id", half_up(talk, 3).alias("talk"), half_up(thin, 3).alias("thin"))


def q_source_family(spark: SparkSession, d: str) -> DataFrame:
    """PRED-34."""
    return _items(spark, d).groupBy(op.source_family(F.col("source_role"), F.col("source_type")).alias("family"), "source_type").agg(F.count("*").alias("n"))


def q_event_type(spark: SparkSession, d: str) -> DataFrame:
    """PRED-35: the event type by pattern shares, the role's hint and the bonus of papers."""
    body = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    paper = F.coalesce(F.col("source_type") == "paper", F.lit(False)) | (F.trim(F.coalesce("metadata.arxiv_id", F.lit(""))) != "")
    return _items(spark, d).select("item_id", op.event_type(body, F.col("source_role"), paper).alias("event_type"))


def q_importance(spark: SparkSession, d: str) -> DataFrame:
    """NUM-02."""
    m = F.col("metadata")
    return _items(spark, d).select("item_id", op.importance(F.col("source_role"), F.coalesce(m["is_official"], F.lit(False)), m["github_url"].isNotNull(), m["upvotes"], m["hn_score"]).alias("importance"))


def q_dedupe_longest(spark: SparkSession, d: str) -> DataFrame:
    """WIN-06, SET-02: of one source's copies of a story the one with the longest summary."""
    rows = _items(spark, d).withColumns({"addr": F.coalesce(url.address(), F.lit("")), "low": F.lower(text.clean_text("title")), "len": F.length(F.coalesce("summary", F.lit("")))})
    return op.keep_best(rows, ["source_id", "addr", "low"], [F.desc("len"), F.asc("item_id")]).select("item_id", "source_id", "len")


def q_dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    """WIN-07: the first hit of each discussion."""
    rows = table(spark, d, "hn_hits").withColumn("c", F.coalesce("created_at", F.lit("")))
    return op.keep_best(rows, ["object_id"], [F.asc("c"), F.desc("points")]).groupBy().agg(F.count("*").alias("n"), F.sum("points").alias("points"))


def q_distinct_papers(spark: SparkSession, d: str) -> DataFrame:
    """SET-01: papers that are equal in every field but their key and batch."""
    cols = ["arxiv_id", "title", "abstract", "authors"]
    return table(spark, d, "papers").select(*cols).distinct().groupBy().agg(F.count("*").alias("n"))


def q_raw_limit_then_gate(spark: SparkSession, d: str) -> DataFrame:
    """LIM-01: per batch a limit in arrival order, before the gates."""
    place = F.row_number().over(Window.partitionBy("batch_id").orderBy("item_id"))
    head = _items(spark, d).select("item_id", "source_id", "title", place.alias("place")).filter("place <= 240")
    return head.filter(~op.low_quality(F.col("title"), fixed.LOW_DISPLAY, 8)).select("item_id", "source_id")


def q_crossday_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-04: items of every batch whose address and title were not seen in the 30 batches before it."""
    rows = _items(spark, d).select("item_id", "batch_id", "title", url.address().alias("addr"))
    return op.not_seen_before(rows, "batch_id", ["addr", "title"], 30).filter("addr is not null").select("item_id")


def q_author_select(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-01, PRED-09: papers of authors with ten papers or more, and the rest."""
    papers = table(spark, d, "papers")
    names = papers.select("paper_id", F.explode("authors").alias("author"))
    prolific = names.groupBy("author").agg(F.count("*").alias("n")).filter("n >= 10").select("author")
    chosen = names.join(prolific, "author", "left_semi").select("paper_id").distinct()
    return papers.join(chosen.withColumn("hit", F.lit(1)), "paper_id", "left").select("paper_id", F.col("hit").isNotNull().alias("selected"))


def q_hindex_gate(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-02, PRED-10: the largest standing of a paper's authors against a cutoff, unknown counting as 0."""
    names = table(spark, d, "papers").select("paper_id", F.explode_outer("authors").alias("author"), "novelty")
    standing = names.filter("author is not null").groupBy("author").agg(F.count("*").alias("h"))
    best = names.join(standing, "author", "left").groupBy("paper_id").agg(F.coalesce(F.max("h"), F.lit(0)).alias("h"))
    return best.select("paper_id", "h", (F.col("h") < 5).alias("filtered"))


def q_score_gate(spark: SparkSession, d: str) -> DataFrame:
    """PRED-11/12: relevance and novelty cutoffs, nulls failing."""
    ok = (F.col("relevance") >= 6) & (F.col("novelty") >= 5)
    return table(spark, d, "papers").groupBy(F.coalesce(ok, F.lit(False)).alias("kept")).agg(F.count("*").alias("n"), F.sum("score").alias("score"))


def q_retry_set(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-03, SET-03: papers without a review."""
    papers = table(spark, d, "papers")
    return op.retry_set(papers.select("paper_id"), papers.filter("review_comment is not null"), "paper_id")


def q_source_dim(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-18, AGG-22: items by source with the dimension's columns, sources without items included."""
    n = _items(spark, d).groupBy("source_id").agg(F.count("*").alias("n"), F.max("batch_id").alias("last_batch"))
    return table(spark, d, "sources").join(n, "source_id", "left").select("source_id", "home_zone", F.coalesce("n", F.lit(0)).alias("n"), "last_batch", F.col("n").isNotNull().alias("active"))


def q_asof_batch(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-06: for each event day in the batches' time the last batch not after it, within two days."""
    days = table(spark, d, "hotspot_items").select(F.to_date("fetched_at").alias("day")).distinct()
    both = table(spark, d, "batches").filter("batch_id % 3 <> 0").select(F.col("batch_date").alias("day"), "batch_id").unionByName(days.withColumn("batch_id", F.lit(None).cast("int")))
    w = Window.orderBy("day", F.col("batch_id").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    filled = both.select("day", "batch_id", F.last("batch_id", True).over(w).alias("as_of"), F.last(F.when(F.col("batch_id").isNotNull(), F.col("day")), True).over(w).alias("as_of_day"))
    return filled.filter("batch_id is null").select("day", F.when(F.datediff("day", "as_of_day") <= 2, F.col("as_of")).alias("as_of"))


def q_range_windows(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-21: for each order date of a customer the span since the one before, up to the day before."""
    w = Window.partitionBy("o_custkey").orderBy("day")
    days = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day")).distinct()
    return days.select("o_custkey", "day", F.lag("day").over(w).alias("since")).filter("since is not null").select("o_custkey", "day", "since", F.date_sub("day", 1).alias("until"))


def q_topic_lookup(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-07/08: an item's cluster by address, else by title; of several clusters the last one wins."""
    items = _items(spark, d).select("item_id", "canonical_url", F.lower("title").alias("low"))
    clusters = table(spark, d, "hotspot_clusters").select("cluster_id", "canonical_url", F.lower("title").alias("low"))
    by_url = clusters.filter("canonical_url is not null").groupBy("canonical_url").agg(F.max("cluster_id").alias("c1"))
    by_title = clusters.filter("low is not null").groupBy("low").agg(F.max("cluster_id").alias("c2"))
    return items.join(by_url, "canonical_url", "left").join(by_title, "low", "left").select("item_id", F.coalesce("c1", "c2").alias("cluster_id")).filter("cluster_id is not null")


def q_set_ops(spark: SparkSession, d: str) -> DataFrame:
    """SET-04/05/06/09: hosts of two halves of the time: shared, one-sided, their likeness in percent."""
    host = F.col("metadata.host")
    a = _items(spark, d).filter("batch_id <= 90").select(host.alias("h")).filter("h is not null")
    b = _items(spark, d).filter("batch_id > 90").select(host.alias("h")).filter("h is not null")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    # four single rows side by side
    out = n(a.intersect(b), "both_n")
    for df, name in ((a.exceptAll(b).distinct(), "left_n"), (b.subtract(a), "right_n"), (a.union(b).distinct(), "all_n")):
        out = out.withColumn("_k", F.lit(1)).join(n(df, name).withColumn("_k", F.lit(1)), "_k").drop("_k")
    return out.withColumn("percent", half_up(100.0 * F.col("both_n") / F.col("all_n"), 3))


def q_right_merge(spark: SparkSession, d: str) -> DataFrame:
    """SET-07, JOIN-15: per item the discussion's title where there is one, else its own; either side may be missing."""
    hits = table(spark, d, "hn_hits").filter("item_id is not null").groupBy("item_id").agg(F.max("title").alias("title"))
    merged = op.merge_right(_items(spark, d).select("item_id", "title"), hits, "item_id", ["title"])
    return merged.select("item_id", F.md5(F.coalesce("title", F.lit(""))).alias("h"))


def q_authority_merge(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-15: names known as authors of papers, items or hits, merged: sources united, largest weight, seen anywhere."""
    papers = table(spark, d, "papers").select(F.explode("authors").alias("name"), F.lit("papers").alias("ref"), F.lit(3).alias("tier"))
    items = _items(spark, d).select(F.explode("authors").alias("name"), F.lit("items").alias("ref"), F.lit(2).alias("tier"))
    hits = table(spark, d, "hn_hits").select(F.col("author").alias("name"), F.lit("hits").alias("ref"), F.lit(1).alias("tier"))
    both = papers.unionByName(items).unionByName(hits).filter("name is not null and trim(name) <> ''").withColumn("handle", F.lower(F.regexp_replace(F.trim("name"), "^@", "")))
    return both.groupBy("handle").agg(F.array_join(F.array_sort(F.collect_set("ref")), ",").alias("refs"), F.max("tier").alias("tier"), F.count("*").alias("n"))


def q_follow_graph(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-16: co-authors of the most prolific names: support, kinds and a score."""
    names = table(spark, d, "papers").select("paper_id", "primary_topic_id", F.explode("authors").alias("author"))
    seeds = names.groupBy("author").agg(F.count("*").alias("n")).filter("n >= 15").select(F.col("author").alias("seed"))
    edges = names.join(seeds, F.col("author") == F.col("seed"), "left_semi").select("paper_id", F.col("author").alias("seed"))
    pairs = names.join(edges, "paper_id").filter("author <> seed")
    support = pairs.groupBy("author").agg(F.countDistinct("seed").alias("support"), F.countDistinct("primary_topic_id").alias("kinds"))
    return support.select("author", "support", "kinds", half_up(3.2 * F.col("support") + 0.9 * F.col("kinds"), 3).alias("score"))


def q_social_activity(spark: SparkSession, d: str) -> DataFrame:
    """NUM-08, AGG-08: engagement per item from its hits, with missing parts as 0."""
    hits = table(spark, d, "hn_hits").filter("item_id is not null").dropDuplicates()
    return hits.groupBy("item_id").agg(F.sum(F.coalesce("points", F.lit(0)) + 3 * F.coalesce("num_comments", F.lit(0))).alias("activity"), F.max("points").alias("top"))


def q_newsworthy(spark: SparkSession, d: str) -> DataFrame:
    """PRED-24: social texts worth keeping: no reply or repost, and a link, engagement or a news pattern."""
    t = F.lower(F.coalesce("title", F.lit("")))
    reply = t.rlike(r"^(re|rt):")
    news = t.rlike(r"arrives|unveils|opens|launch|release")
    active = F.coalesce(F.col("metadata.activity"), F.lit(0)) >= 100
    rows = _items(spark, d).filter(F.col("source_role") == "community_heat")
    return rows.filter(~reply & (news | active)).select("item_id", news.alias("news"), active.alias("active"))


def q_batches(spark: SparkSession, d: str) -> DataFrame:
    """WIN-09: batches of adaptive size per day, and the length of the prompt each would make."""
    rows = table(spark, d, "papers").select("batch_id", "paper_id", F.length(F.coalesce("title", F.lit(""))).alias("len"))
    per = Window.partitionBy("batch_id")
    n = F.count("*").over(per)
    size = F.when(n > 8, 4 * F.ceil(F.log2(n / 8) + 1)).otherwise(4)
    rows = rows.select("batch_id", "len", F.floor((F.row_number().over(per.orderBy("paper_id")) - 1) / size).cast("int").alias("part"))
    return rows.groupBy("batch_id", "part").agg(F.count("*").alias("n"), F.sum("len").alias("chars"))


def q_rate_window(spark: SparkSession, d: str) -> DataFrame:
    """WIN-11: users over a limit of calls in a tumbling hour."""
    w = table(spark, d, "events").groupBy("user_id", F.window("ts", "1 hour")["start"].alias("hour")).agg(F.count("*").alias("calls"))
    return w.filter("calls > 1").groupBy("calls").agg(F.count("*").alias("windows"), F.countDistinct("user_id").alias("users"))


QUERIES = {f.__name__: f for f in (
    q_freshness_gate, q_age_bounds, q_on_date, q_quality_filter, q_engineering_score, q_source_family, q_event_type, q_importance, q_dedupe_longest, q_dedupe_first, q_distinct_papers,
    q_raw_limit_then_gate, q_crossday_antijoin, q_author_select, q_hindex_gate, q_score_gate, q_retry_set, q_source_dim, q_asof_batch, q_range_windows, q_topic_lookup, q_set_ops,
    q_right_merge, q_authority_merge, q_follow_graph, q_social_activity, q_newsworthy, q_batches, q_rate_window,
)}

_BODY = "lower(concat_ws(' ', title, summary))"


def _re(patterns: list[str]) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns).replace("'", "''")


def _hits(patterns: list[str], subject: str = "b") -> str:
    return "(" + " + ".join(f"regexp_matches({subject}, '{_re([p])}')::INT" for p in patterns) + ")"


_LOWQ = f"(length(coalesce(title, '')) < 8 OR regexp_matches(coalesce(title, ''), '{_re(fixed.LOW_DISPLAY)}'))"
_HINT = "CASE source_role " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.EVENT_HINTS.items()) + " END"
_SCORES = ", ".join(
    f"{{'score': {_hits(p)} / {max(0.4 * len(p), 1.0)}::DOUBLE + CASE WHEN hint = '{name}' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END{' + CASE WHEN paper THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END' if name == 'research_paper' else ''}, 'ord': {-i}, 'name': '{name}'}}"
    for i, (name, p) in enumerate(fixed.EVENT_PATTERNS.items())
)
_TALK = "CASE source_role " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.TALK_BASE.items()) + " ELSE 0.2 END::DOUBLE"
_EXEMPT = "coalesce(source_role IN (" + ", ".join(f"'{r}'" for r in fixed.TALK_EXEMPT) + "), false)"
_ROLE = "CASE source_role " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in op.ROLE_WEIGHTS.items()) + f" ELSE {op.DEFAULT_ROLE_WEIGHT} END"
_TITLE = r"trim(regexp_replace(coalesce(title, ''), '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))"
SQL = {
    "q_freshness_gate": """
        SELECT batch_id, count(*) AS n, count(*) FILTER (coalesce(fetched_at >= batch_date::TIMESTAMP + INTERVAL 12 HOUR - INTERVAL 12 HOUR AND fetched_at <= batch_date::TIMESTAMP + INTERVAL 18 HOUR, true)) AS fresh
        FROM hotspot_items JOIN batches USING (batch_id) GROUP BY batch_id""",
    "q_age_bounds": """
        SELECT item_id, batch_id FROM hotspot_items JOIN batches USING (batch_id)
        WHERE NOT coalesce(fetched_at BETWEEN batch_date::TIMESTAMP - INTERVAL 14 DAY AND batch_date::TIMESTAMP + INTERVAL 18 HOUR, true)""",
    "q_on_date": "SELECT fetched_at::DATE AS day, count(*) AS n, count(*) FILTER (hour(fetched_at) BETWEEN 6 AND 18) AS daytime FROM hotspot_items WHERE fetched_at >= TIMESTAMP '2026-01-01' GROUP BY 1",
    "q_quality_filter": f"""
        WITH t AS (SELECT item_id, coalesce(title, '') AS t, lower(coalesce(url, '')) AS u FROM hotspot_items),
        f AS (SELECT item_id, length(t) < 8 OR regexp_matches(t, '{_re(fixed.LOW_DISPLAY)}') AS display, length(trim(t)) < 10 OR regexp_matches(trim(t), '{_re(fixed.LOW_HEADLINE)}') AS headline,
          length(trim(t)) < 10 OR regexp_matches(trim(t), '{_re(fixed.LOW_ITEM)}') OR (contains(u, 'github.com') AND regexp_matches(trim(t) || ' ' || u, '{_re(fixed.CLONE_REPOSITORIES)}')) AS item FROM t)
        SELECT * FROM f WHERE display OR headline OR item""",
    "q_engineering_score": f"""
        WITH t AS (SELECT item_id, source_role, lower(coalesce(title, '') || ' ' || coalesce(summary, '')) AS b FROM hotspot_items),
        s AS (SELECT item_id, {_EXEMPT} AS out, greatest(0.0::DOUBLE, least(1.0::DOUBLE, {_TALK} + {_hits(fixed.ENGINEERING_TALK)} * 0.15::DOUBLE - {_hits(fixed.FRONTIER_NEWS)} * 0.2::DOUBLE)) AS talk,
          greatest(0.0::DOUBLE, least(1.0::DOUBLE, {_hits(fixed.OPINION_TALK)} * 0.25::DOUBLE + {_hits(fixed.CLICKBAIT)} * 0.2::DOUBLE + {_hits(fixed.PROMOTION)} * 0.3::DOUBLE - {_hits(fixed.FRONTIER_NEWS)} * 0.15::DOUBLE)) AS thin FROM t)
        SELECT item_id, CASE WHEN out THEN 0.0 ELSE floor(talk * 1000 + 0.5) / 1000 END AS talk, CASE WHEN out THEN 0.0 ELSE floor(thin * 1000 + 0.5) / 1000 END AS thin FROM s""",
    "q_source_family": """
        SELECT CASE WHEN source_role = 'official_news' THEN 'official' WHEN source_role = 'headline_consensus' THEN 'market-signals' WHEN source_role = 'editorial_depth' THEN 'analysis'
          WHEN source_role IN ('paper_trending', 'research_backbone') OR source_type = 'paper' THEN 'papers' WHEN source_role = 'github_trend' OR source_type = 'repository' THEN 'github' ELSE 'industry' END AS family,
          source_type, count(*) AS n FROM hotspot_items GROUP BY ALL""",
    "q_event_type": f"""
        WITH t AS (SELECT item_id, coalesce(title, '') || ' ' || coalesce(summary, '') AS b, {_HINT} AS hint, coalesce(source_type = 'paper', false) OR trim(coalesce(metadata.arxiv_id, '')) <> '' AS paper FROM hotspot_items),
        s AS (SELECT item_id, hint, list_max([{_SCORES}]) AS best FROM t)
        SELECT item_id, CASE WHEN best.score >= 0.3 THEN best.name ELSE coalesce(hint, 'other') END AS event_type FROM s""",
    "q_importance": f"""
        WITH t AS (SELECT item_id, 1.2::DOUBLE * {_ROLE} + 1.5::DOUBLE * coalesce(metadata.is_official, false)::INT + 0.8::DOUBLE * (metadata.github_url IS NOT NULL)::INT + 0.5::DOUBLE * coalesce(metadata.upvotes > 50, false)::INT + 0.5::DOUBLE * coalesce(metadata.hn_score > 50, false)::INT AS raw FROM hotspot_items)
        SELECT item_id, greatest(1, least(10, round_even(raw, 0)))::INT AS importance FROM t""",
    "q_dedupe_longest": f"""
        SELECT item_id, source_id, length(coalesce(summary, ''))::INT AS len FROM hotspot_items
        QUALIFY row_number() OVER (PARTITION BY source_id, coalesce(coalesce(nullif(trim(canonical_url), ''), nullif(trim(url), '')), ''), lower({_TITLE}) ORDER BY length(coalesce(summary, '')) DESC, item_id) = 1""",
    "q_dedupe_first": """
        SELECT count(*) AS n, sum(points)::BIGINT AS points FROM (SELECT * FROM hn_hits QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY coalesce(created_at, ''), points DESC NULLS LAST) = 1)""",
    "q_distinct_papers": "SELECT count(*) AS n FROM (SELECT DISTINCT arxiv_id, title, abstract, authors FROM papers)",
    "q_raw_limit_then_gate": f"SELECT item_id, source_id FROM (SELECT * FROM hotspot_items QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY item_id) <= 240) WHERE NOT {_LOWQ}",
    "q_crossday_antijoin": """
        WITH r AS (SELECT item_id, batch_id, title, coalesce(nullif(trim(canonical_url), ''), nullif(trim(url), '')) AS addr FROM hotspot_items)
        SELECT item_id FROM r WHERE addr IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r o WHERE o.addr = r.addr AND o.batch_id BETWEEN r.batch_id - 30 AND r.batch_id - 1) AND NOT EXISTS (SELECT 1 FROM r o WHERE o.title = r.title AND o.batch_id BETWEEN r.batch_id - 30 AND r.batch_id - 1)""",
    "q_author_select": """
        WITH n AS (SELECT paper_id, unnest(authors) AS author FROM papers), p AS (SELECT author FROM n GROUP BY author HAVING count(*) >= 10)
        SELECT paper_id, paper_id IN (SELECT paper_id FROM n WHERE author IN (SELECT author FROM p)) AS selected FROM papers""",
    "q_hindex_gate": """
        WITH n AS (SELECT paper_id, unnest(authors) AS author FROM papers), s AS (SELECT author, count(*) AS h FROM n WHERE author IS NOT NULL GROUP BY author),
        b AS (SELECT p.paper_id, coalesce(max(s.h), 0) AS h FROM papers p LEFT JOIN n ON n.paper_id = p.paper_id LEFT JOIN s ON s.author = n.author GROUP BY p.paper_id)
        SELECT paper_id, h, h < 5 AS filtered FROM b""",
    "q_score_gate": "SELECT coalesce(relevance >= 6 AND novelty >= 5, false) AS kept, count(*) AS n, sum(score)::BIGINT AS score FROM papers GROUP BY 1",
    "q_retry_set": "SELECT paper_id FROM papers EXCEPT ALL SELECT paper_id FROM papers WHERE review_comment IS NOT NULL",
    "q_source_dim": """
        SELECT s.source_id, s.home_zone, count(i.item_id) AS n, max(i.batch_id) AS last_batch, count(i.item_id) > 0 AS active FROM sources s LEFT JOIN hotspot_items i USING (source_id) GROUP BY ALL""",
    "q_asof_batch": """
        WITH d AS (SELECT DISTINCT fetched_at::DATE AS day FROM hotspot_items), b AS (SELECT * FROM batches WHERE batch_id % 3 <> 0)
        SELECT d.day, CASE WHEN datediff('day', b.batch_date, d.day) <= 2 THEN b.batch_id END AS as_of FROM d ASOF LEFT JOIN b ON d.day >= b.batch_date""",
    "q_range_windows": """
        WITH d AS (SELECT DISTINCT o_custkey, o_orderdate::DATE AS day FROM orders), l AS (SELECT *, lag(day) OVER (PARTITION BY o_custkey ORDER BY day) AS since FROM d)
        SELECT o_custkey, day, since, (day - INTERVAL 1 DAY)::DATE AS until FROM l WHERE since IS NOT NULL""",
    "q_topic_lookup": """
        WITH u AS (SELECT canonical_url, max(cluster_id) AS c1 FROM hotspot_clusters WHERE canonical_url IS NOT NULL GROUP BY 1), t AS (SELECT lower(title) AS low, max(cluster_id) AS c2 FROM hotspot_clusters WHERE title IS NOT NULL GROUP BY 1)
        SELECT item_id, coalesce(c1, c2) AS cluster_id FROM hotspot_items i LEFT JOIN u ON i.canonical_url = u.canonical_url LEFT JOIN t ON lower(i.title) = t.low WHERE coalesce(c1, c2) IS NOT NULL""",
    "q_set_ops": """
        WITH a AS (SELECT metadata.host AS h FROM hotspot_items WHERE batch_id <= 90 AND metadata.host IS NOT NULL), b AS (SELECT metadata.host AS h FROM hotspot_items WHERE batch_id > 90 AND metadata.host IS NOT NULL),
        n AS (SELECT (SELECT count(*) FROM (SELECT h FROM a INTERSECT SELECT h FROM b)) AS both_n, (SELECT count(*) FROM (SELECT DISTINCT h FROM (SELECT h FROM a EXCEPT ALL SELECT h FROM b))) AS left_n,
          (SELECT count(*) FROM (SELECT h FROM b EXCEPT SELECT h FROM a)) AS right_n, (SELECT count(*) FROM (SELECT h FROM a UNION SELECT h FROM b)) AS all_n)
        SELECT *, floor(100.0::DOUBLE * both_n / all_n * 1000 + 0.5) / 1000 AS percent FROM n""",
    "q_right_merge": """
        WITH h AS (SELECT item_id, max(title) AS t FROM hn_hits WHERE item_id IS NOT NULL GROUP BY 1)
        SELECT coalesce(i.item_id, h.item_id) AS item_id, md5(coalesce(h.t, i.title, '')) AS h FROM hotspot_items i FULL JOIN h ON i.item_id = h.item_id""",
    "q_authority_merge": """
        WITH b AS (SELECT unnest(authors) AS name, 'papers' AS ref, 3 AS tier FROM papers UNION ALL SELECT unnest(authors), 'items', 2 FROM hotspot_items UNION ALL SELECT author, 'hits', 1 FROM hn_hits)
        SELECT lower(regexp_replace(trim(name), '^@', '')) AS handle, array_to_string(list_sort(list_distinct(list(ref))), ',') AS refs, max(tier) AS tier, count(*) AS n FROM b WHERE name IS NOT NULL AND trim(name) <> '' GROUP BY 1""",
    "q_follow_graph": """
        WITH n AS (SELECT paper_id, primary_topic_id, unnest(authors) AS author FROM papers), s AS (SELECT author FROM n GROUP BY author HAVING count(*) >= 15),
        e AS (SELECT paper_id, author AS seed FROM n WHERE author IN (SELECT author FROM s)),
        g AS (SELECT n.author, count(DISTINCT seed) AS support, count(DISTINCT primary_topic_id) AS kinds FROM n JOIN e USING (paper_id) WHERE n.author <> e.seed GROUP BY 1)
        SELECT author, support, kinds, floor((3.2::DOUBLE * support + 0.9::DOUBLE * kinds) * 1000 + 0.5) / 1000 AS score FROM g""",
    "q_social_activity": "SELECT item_id, sum(coalesce(points, 0) + 3 * coalesce(num_comments, 0))::BIGINT AS activity, max(points) AS top FROM (SELECT DISTINCT * FROM hn_hits WHERE item_id IS NOT NULL) GROUP BY 1",
    "q_newsworthy": """
        WITH t AS (SELECT item_id, lower(coalesce(title, '')) AS t, coalesce(metadata.activity, 0) >= 100 AS active FROM hotspot_items WHERE source_role = 'community_heat')
        SELECT item_id, regexp_matches(t, 'arrives|unveils|opens|launch|release') AS news, active FROM t WHERE NOT regexp_matches(t, '^(re|rt):') AND (regexp_matches(t, 'arrives|unveils|opens|launch|release') OR active)""",
    "q_batches": """
        WITH r AS (SELECT batch_id, paper_id, length(coalesce(title, '')) AS len, count(*) OVER (PARTITION BY batch_id) AS n FROM papers),
        s AS (SELECT batch_id, len, CASE WHEN n > 8 THEN 4 * ceil(log2(n / 8.0::DOUBLE) + 1) ELSE 4 END AS size, row_number() OVER (PARTITION BY batch_id ORDER BY paper_id) - 1 AS k FROM r)
        SELECT batch_id, floor(k / size)::INT AS part, count(*) AS n, sum(len)::BIGINT AS chars FROM s GROUP BY 1, 2""",
    "q_rate_window": """
        WITH w AS (SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS calls FROM events GROUP BY 1, 2)
        SELECT calls, count(*) AS windows, count(DISTINCT user_id) AS users FROM w WHERE calls > 1 GROUP BY calls""",
}
