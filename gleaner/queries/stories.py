"""Queries over the story operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import fixed, text, url
from gleaner.functions.num import capped, half_up
from gleaner.operators import items as op
from gleaner.operators import stories as st
from gleaner.queries.items import _ROLE, _items
from gleaner.tables import table

AS_OF = "2026-04-09 00:00:00"


def _with_keys(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("metadata")
    imp = op.importance(F.col("source_role"), F.coalesce(m["is_official"], F.lit(False)), m["github_url"].isNotNull(), m["upvotes"], m["hn_score"])
    return _items(spark, d).withColumns({"k_url": F.nullif(F.trim("canonical_url"), F.lit("")), "k_paper": m["arxiv_id"], "k_repo": m["github_url"], "importance": imp})


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return st.shared_key_edges(_with_keys(spark, d), "item_id", [F.concat(F.lit("u"), "k_url"), F.concat(F.lit("p"), "k_paper"), F.concat(F.lit("r"), "k_repo")])


def _stories(spark: SparkSession, d: str) -> DataFrame:
    rows = _with_keys(spark, d)
    return rows.join(st.story_components(rows, _edges(spark, d), "item_id"), "item_id")


def q_story_edges(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-09: star edges of items that share an address, paper or repository."""
    return _edges(spark, d)


def q_story_components(spark: SparkSession, d: str) -> DataFrame:
    """AGG-01: stories as connected components, by size."""
    comp = st.story_components(_with_keys(spark, d), _edges(spark, d), "item_id")
    return comp.groupBy("story").agg(F.count("*").alias("items")).filter("items > 1")


def q_title_pairs(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-11, TXT-08/09: clusters of one topic word whose titles are alike or contained."""
    return st.word_pairs(table(spark, d, "hotspot_clusters"), "cluster_id", text.significant_words(F.col("title")), 0.55)


def q_cluster_title_likeness(spark: SparkSession, d: str) -> DataFrame:
    """TXT-08: likeness of each member's title to its cluster's."""
    rows = table(spark, d, "hotspot_clusters").select("cluster_id", "title", F.explode("cluster_items").alias("m"))
    return rows.select("cluster_id", F.col("m.item_id").alias("item_id"), half_up(text.jaccard(text.significant_words(F.col("title")), text.significant_words(F.col("m.title"))), 4).alias("likeness"))


def q_seq_similarity(spark: SparkSession, d: str) -> DataFrame:
    """TXT-23, UDF-04: member titles close to their cluster's by matching blocks."""
    rows = table(spark, d, "hotspot_clusters").select("cluster_id", F.col("title").alias("a"), F.explode("cluster_items").alias("m")).select("cluster_id", F.col("m.item_id").alias("item_id"), "a", F.col("m.title").alias("b"))
    return st.sequence_similarity(rows.filter("a is not null and b is not null and a <> b"), "a", "b", 0.65).select("cluster_id", "item_id", half_up(F.col("ratio"), 4).alias("ratio"))


def q_title_sequences(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-11: titles of one batch that are alike as sequences, no two papers."""
    return st.near_titles(_items(spark, d), "item_id", "batch_id", "title", 0.65, barred=F.col("source_type") == "paper").select("a", "b", half_up(F.col("ratio"), 4).alias("ratio"))


def q_headline_repeats(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-20: near-duplicate headlines of consecutive batches, counted."""
    near = st.near_titles(_items(spark, d), "item_id", "batch_id", "title", 0.7, apart=1)
    return near.join(_items(spark, d).select(F.col("item_id").alias("a"), "batch_id"), "a").groupBy("batch_id").agg(F.count("*").alias("repeats"))


def q_story_representative(spark: SparkSession, d: str) -> DataFrame:
    """AGG-02/05: by address the representing item and the sorted sources."""
    rows = _with_keys(spark, d).filter("k_url is not null").withColumn("story", F.col("k_url"))
    return st.representatives(rows, "item_id")


def q_story_mode(spark: SparkSession, d: str) -> DataFrame:
    """AGG-03: the commonest role of each address, weighted among equals."""
    rows = _with_keys(spark, d).filter("k_url is not null")
    return st.weighted_mode(rows, "k_url", "source_role", op.ROLE_WEIGHTS, "item_id")


def q_story_score(spark: SparkSession, d: str) -> DataFrame:
    """AGG-04, DT-04, WIN-01: raw scores by address and their normal form."""
    rows = _with_keys(spark, d).filter("k_url is not null").withColumn("story", F.col("k_url"))
    scored = st.normalise_scores(st.raw_scores(rows, F.lit(AS_OF).cast("timestamp")).select("story", half_up(F.col("raw"), 6).alias("raw")))
    return scored.select("story", "raw", half_up(F.col("score"), 3).alias("score"))


def q_headline_penalty(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-05: the headlines of every batch against those of the 30 batches before it."""
    rows = _items(spark, d).select("item_id", "batch_id", text.significant_words(F.col("title")).alias("w"))
    out = st.headline_penalty(rows, "item_id", "batch_id", "w")
    return out.select("item_id", half_up(F.col("likest"), 4).alias("likest"), half_up(F.col("factor"), 4).alias("factor"))


def q_select_featured(spark: SparkSession, d: str) -> DataFrame:
    """FOLD-01/06: per batch five featured stories within caps by type and source, and three to watch."""
    return st.diversified_top(_with_keys(spark, d), ["batch_id"], [F.desc("importance"), F.asc("item_id")], {"source_type": 3, "source_id": 2}, 5, 3).select("batch_id", "item_id", "pick")


def q_sections(spark: SparkSession, d: str) -> DataFrame:
    """WIN-02: per batch the best of each family under a running total."""
    rows = _with_keys(spark, d).select("batch_id", "item_id", "importance", op.source_family(F.col("source_role"), F.col("source_type")).alias("family"))
    return st.capped_sections(rows, ["batch_id"], "family", [F.desc("importance"), F.asc("item_id")], 6, 25, F.col("family")).select("batch_id", "family", "item_id", "place")


def q_claimed_waterfall(spark: SparkSession, d: str) -> DataFrame:
    """SET-06: what is left for a list once the earlier lists have claimed theirs."""
    featured = q_select_featured(spark, d).filter("pick = 'featured'").select("item_id")
    top = _with_keys(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("batch_id").orderBy(F.desc("importance"), "item_id"))).filter("place <= 12")
    return top.join(featured, "item_id", "left_anti").select("batch_id", "item_id")


def q_market_signals(spark: SparkSession, d: str) -> DataFrame:
    """FOLD-08, NUM-04: the five strongest items per batch by capped engagement, one per address."""
    m = F.col("metadata")
    score = F.when(F.col("source_role") == "community_heat", 6.0).otherwise(3.5) + capped(m["activity"], 250.0, 4.0) + capped(m["hn_score"], 80.0, 3.0)
    rows = _items(spark, d).select("item_id", "batch_id", half_up(score, 4).alias("score"), F.coalesce(url.address(), F.concat(F.lit("#"), F.col("item_id").cast("string"))).alias("addr"))
    one = op.keep_best(rows, ["batch_id", "addr"], [F.desc("score"), F.asc("item_id")])
    return one.withColumn("place", F.row_number().over(Window.partitionBy("batch_id").orderBy(F.desc("score"), "item_id"))).filter("place <= 5").select("batch_id", "item_id", "score", "place")


def q_item_signal(spark: SparkSession, d: str) -> DataFrame:
    """NUM-03, WIN-03: capped engagement terms, the ten best per family."""
    m = F.col("metadata")
    signal = capped(m["activity"], 250.0, 3.0) + capped(m["stars"], 500.0, 2.4) + capped(m["hn_score"], 75.0, 2.0) + capped(m["upvotes"], 100.0, 1.6)
    rows = _items(spark, d).select("item_id", op.source_family(F.col("source_role"), F.col("source_type")).alias("family"), half_up(signal, 4).alias("signal"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("family").orderBy(F.desc("signal"), "item_id"))).filter("place <= 10")


def q_section_score(spark: SparkSession, d: str) -> DataFrame:
    """AGG-24: a family's score from its four best signals, topic breadth and size."""
    top = q_item_signal(spark, d)
    agg = top.groupBy("family").agg(F.avg(F.when(F.col("place") <= 4, F.col("signal"))).alias("lead"), F.count("*").alias("n"))
    return agg.select("family", half_up(F.col("lead") + F.least(F.lit(2.0), F.col("n") / 8.0), 3).alias("score"))


def q_title_dedup_fold(spark: SparkSession, d: str) -> DataFrame:
    """FOLD-02/04: titles kept and dropped by the greedy scan within each batch."""
    rows = _items(spark, d).select("item_id", "batch_id", "title")
    return st.greedy_title_dedup(rows, "batch_id", "item_id", "title").filter(~F.col("kept")).select("item_id", "batch_id")


def q_stale_stories(spark: SparkSession, d: str) -> DataFrame:
    """PRED-30: clusters all of whose members are older than the last 60 batches."""
    members = table(spark, d, "hotspot_clusters").select("cluster_id", F.explode("cluster_items").alias("m")).select("cluster_id", F.col("m.item_id").alias("item_id"))
    last = members.join(_items(spark, d).select("item_id", "batch_id"), "item_id").groupBy("cluster_id").agg(F.max("batch_id").alias("last"))
    return last.filter("last < 120").select("cluster_id", "last")


def q_topic_summary(spark: SparkSession, d: str) -> DataFrame:
    """SORT-04: clusters told by several sources, ranked."""
    c = table(spark, d, "hotspot_clusters")
    rank = 0.5 * F.coalesce("deterministic_score", F.lit(0.0)) + F.least(F.lit(2.0), 0.7 * F.size("source_ids")) + F.least(F.lit(0.8), 0.4 * (F.size("source_types") - 1))
    return c.filter("size(source_ids) >= 2").select("cluster_id", F.size("source_ids").alias("sources"), half_up(rank, 3).alias("rank"))


def q_host_mix(spark: SparkSession, d: str) -> DataFrame:
    """AGG-28, URL-04: hosts by number of items, descending, with their share."""
    n = _items(spark, d).filter("url is not null").groupBy(url.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("host", "n", half_up(F.col("n") / F.col("total"), 6).alias("share"))


QUERIES = {f.__name__: f for f in (
    q_story_edges, q_story_components, q_title_pairs, q_cluster_title_likeness, q_seq_similarity, q_story_representative, q_title_sequences, q_headline_repeats, q_story_mode, q_story_score, q_headline_penalty, q_select_featured,
    q_sections, q_claimed_waterfall, q_market_signals, q_item_signal, q_section_score, q_title_dedup_fold, q_stale_stories, q_topic_summary, q_host_mix,
)}

_IMP = f"""greatest(1, least(10, round_even(1.2::DOUBLE * {_ROLE} + 1.5::DOUBLE * coalesce(metadata.is_official, false)::INT + 0.8::DOUBLE * (metadata.github_url IS NOT NULL)::INT
  + 0.5::DOUBLE * coalesce(metadata.upvotes > 50, false)::INT + 0.5::DOUBLE * coalesce(metadata.hn_score > 50, false)::INT, 0)))::INT"""
_K = f"SELECT *, nullif(trim(canonical_url), '') AS k_url, {_ROLE}::DOUBLE AS w, {_IMP} AS importance FROM hotspot_items"
_STAR = """n AS (SELECT DISTINCT item_id AS b, unnest(list_filter(['u' || nullif(trim(canonical_url), ''), 'p' || metadata.arxiv_id, 'r' || metadata.github_url], lambda x: x IS NOT NULL)) AS key FROM hotspot_items),
  f AS (SELECT key, min(b) AS a FROM n GROUP BY key HAVING count(*) > 1), e AS (SELECT DISTINCT a, b FROM n JOIN f USING (key) WHERE a < b)"""
_STOPLIST = "[" + ", ".join(f"'{w}'" for w in fixed.STOPWORDS) + "]"


def _words(c: str) -> str:
    return rf"list_sort(list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+'), lambda x: NOT list_contains({_STOPLIST}, x)), lambda x: regexp_replace(x, '^([0-9]+)[bmk]$', '\1')), lambda x: length(x) >= 4 OR (length(x) >= 3 AND regexp_matches(x, '^[0-9]+$')))))"


_JAC = "CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) END"
_FAM = """CASE WHEN source_role = 'official_news' THEN 'official' WHEN source_role = 'headline_consensus' THEN 'market-signals' WHEN source_role = 'editorial_depth' THEN 'analysis'
  WHEN source_role IN ('paper_trending', 'research_backbone') OR source_type = 'paper' THEN 'papers' WHEN source_role = 'github_trend' OR source_type = 'repository' THEN 'github' ELSE 'industry' END"""


def _cap(field: str, per: float, cap: float) -> str:
    return f"least({cap}::DOUBLE, coalesce(metadata.{field}, 0) / {per}::DOUBLE)"


_SIGNAL = f"""SELECT *, row_number() OVER (PARTITION BY family ORDER BY signal DESC, item_id) AS place FROM (
  SELECT item_id, {_FAM} AS family, floor(({_cap('activity', 250.0, 3.0)} + {_cap('stars', 500.0, 2.4)} + {_cap('hn_score', 75.0, 2.0)} + {_cap('upvotes', 100.0, 1.6)}) * 10000 + 0.5) / 10000 AS signal FROM hotspot_items) QUALIFY place <= 10"""
SQL = {
    "q_story_edges": f"WITH {_STAR} SELECT a, b FROM e",
    "q_story_components": f"""
        WITH RECURSIVE {_STAR}, g AS (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e),
        r(v, c) AS (SELECT DISTINCT x, x FROM g UNION SELECT g.y, r.c FROM r JOIN g ON g.x = r.v WHERE r.c < g.y),
        l AS (SELECT v, min(c) AS story FROM r GROUP BY v)
        SELECT story, count(*) AS items FROM l GROUP BY story HAVING count(*) > 1""",
    "q_title_pairs": f"""
        WITH t AS (SELECT cluster_id AS n, {_words('title')} AS w FROM hotspot_clusters),
        u AS (SELECT * FROM t WHERE len(w) >= 2)
        SELECT p.n AS a, q.n AS b FROM u p JOIN u q ON p.n < q.n WHERE len(list_intersect(p.w, q.w)) > 0 AND (
          len(list_intersect(p.w, q.w))::DOUBLE / len(list_distinct(list_concat(p.w, q.w))) >= 0.55 OR len(list_intersect(p.w, q.w))::DOUBLE / least(len(p.w), len(q.w)) >= 0.8)""",
    "q_cluster_title_likeness": f"""
        WITH t AS (SELECT cluster_id, {_words('title')} AS x, unnest(cluster_items) AS m FROM hotspot_clusters), u AS (SELECT cluster_id, m.item_id AS item_id, x, {_words('m.title')} AS y FROM t)
        SELECT cluster_id, item_id, floor({_JAC} * 10000 + 0.5) / 10000 AS likeness FROM u""",
    "q_story_representative": f"""
        WITH k AS ({_K}) SELECT k_url AS story, arg_max(item_id, {{'w': w, 'i': importance, 'l': length(coalesce(summary, '')), 'o': -item_id}}) AS canonical_item,
          array_to_string(list_sort(list_distinct(list(source_id))), ',') AS source_ids, count(*) AS items FROM k WHERE k_url IS NOT NULL GROUP BY 1""",
    "q_story_mode": f"""
        WITH k AS ({_K}), n AS (SELECT k_url, source_role, count(*) AS n, min(item_id) AS first, max(w) AS w FROM k WHERE k_url IS NOT NULL GROUP BY 1, 2)
        SELECT k_url, source_role FROM n QUALIFY row_number() OVER (PARTITION BY k_url ORDER BY n DESC, w DESC, first) = 1""",
    "q_story_score": f"""
        WITH k AS ({_K}), a AS (SELECT k_url AS story, sum(round(w * 10)::BIGINT) AS w10, count(DISTINCT source_id) AS n_s, count(DISTINCT source_type) AS n_t, avg(importance) AS imp, max(fetched_at) AS last FROM k WHERE k_url IS NOT NULL GROUP BY 1),
        h AS (SELECT *, (epoch(TIMESTAMP '{AS_OF}') - floor(epoch(last))) / 3600.0::DOUBLE AS hours FROM a),
        r AS (SELECT story, floor(((least(25.0::DOUBLE, w10 / 10.0::DOUBLE) + 1.5::DOUBLE * n_s + 0.8::DOUBLE * n_t + imp) * CASE WHEN hours IS NULL THEN 0.6::DOUBLE WHEN hours < 8 THEN 1.0::DOUBLE WHEN hours < 16 THEN 0.85::DOUBLE WHEN hours < 24 THEN 0.65::DOUBLE WHEN hours < 36 THEN 0.4::DOUBLE ELSE 0.2::DOUBLE END) * 1000000 + 0.5) / 1000000 AS raw FROM h),
        s AS (SELECT list_sort(list(raw)) AS v, count(*) AS n FROM r), p AS (SELECT v[greatest(1, floor(n * 0.5::DOUBLE))::INT] AS p50, v[greatest(1, floor(n * 0.95::DOUBLE))::INT] AS p95, v[n] AS top, n FROM s)
        SELECT story, raw, floor((CASE WHEN p95 <= p50 OR n < 3 THEN least(10.0::DOUBLE, greatest(1.0::DOUBLE, raw / greatest(p50 / 5, 0.5::DOUBLE))) WHEN raw <= p50 THEN greatest(1.0::DOUBLE, 1 + 4 * raw / p50)
          WHEN raw <= p95 THEN 5 + 4.5::DOUBLE * (raw - p50) / (p95 - p50) ELSE 9.5::DOUBLE + CASE WHEN top > p95 THEN 0.5::DOUBLE * (raw - p95) / (top - p95) ELSE 0.0 END END) * 1000 + 0.5) / 1000 AS score FROM r, p""",
    "q_headline_penalty": f"""
        WITH t AS (SELECT item_id, batch_id, {_words('title')} AS w FROM hotspot_items), u AS (SELECT item_id, batch_id, w, unnest(w) AS word FROM t),
        p AS (SELECT a.item_id, len(a.w) AS x, len(b.w) AS y, count(*) AS n FROM u a JOIN u b ON a.word = b.word AND b.batch_id BETWEEN a.batch_id - 30 AND a.batch_id - 1 GROUP BY a.item_id, b.item_id, len(a.w), len(b.w)),
        l AS (SELECT item_id, max(n::DOUBLE / (x + y - n)) AS likest FROM p GROUP BY 1), m AS (SELECT item_id, coalesce(likest, 0.0) AS likest FROM t LEFT JOIN l USING (item_id))
        SELECT item_id, floor(likest * 10000 + 0.5) / 10000 AS likest, floor(CASE WHEN likest >= 0.5 THEN 1 - 0.3::DOUBLE * likest ELSE 1.0 END * 10000 + 0.5) / 10000 AS factor FROM m""",
    "q_sections": f"""
        WITH k AS (SELECT batch_id, item_id, {_FAM} AS family, importance FROM ({_K})), r AS (SELECT *, row_number() OVER (PARTITION BY batch_id, family ORDER BY importance DESC, item_id) AS place FROM k QUALIFY place <= 6)
        SELECT batch_id, family, item_id, place FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY family, place) AS g FROM r) WHERE g <= 25""",
    "q_market_signals": f"""
        WITH t AS (SELECT item_id, batch_id, coalesce(coalesce(nullif(trim(canonical_url), ''), nullif(trim(url), '')), '#' || item_id) AS addr, floor((CASE WHEN source_role = 'community_heat' THEN 6.0::DOUBLE ELSE 3.5::DOUBLE END + {_cap('activity', 250.0, 4.0)} + {_cap('hn_score', 80.0, 3.0)}) * 10000 + 0.5) / 10000 AS score FROM hotspot_items),
        o AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY batch_id, addr ORDER BY score DESC, item_id) = 1)
        SELECT batch_id, item_id, score, row_number() OVER (PARTITION BY batch_id ORDER BY score DESC, item_id) AS place FROM o QUALIFY place <= 5""",
    "q_item_signal": _SIGNAL,
    "q_section_score": f"""
        WITH s AS ({_SIGNAL}), a AS (SELECT family, avg(signal) FILTER (place <= 4) AS lead, count(*) AS n FROM s GROUP BY 1)
        SELECT family, floor((lead + least(2.0::DOUBLE, n / 8.0::DOUBLE)) * 1000 + 0.5) / 1000 AS score FROM a""",
    "q_stale_stories": """
        WITH m AS (SELECT cluster_id, unnest(cluster_items).item_id AS item_id FROM hotspot_clusters)
        SELECT cluster_id, max(batch_id) AS last FROM m JOIN hotspot_items USING (item_id) GROUP BY 1 HAVING max(batch_id) < 120""",
    "q_topic_summary": """
        SELECT cluster_id, len(source_ids)::INT AS sources, floor((0.5::DOUBLE * coalesce(deterministic_score, 0.0) + least(2.0::DOUBLE, 0.7::DOUBLE * len(source_ids)) + least(0.8::DOUBLE, 0.4::DOUBLE * (len(source_types) - 1))) * 1000 + 0.5) / 1000 AS rank
        FROM hotspot_clusters WHERE len(source_ids) >= 2""",
    "q_host_mix": r"""
        WITH n AS (SELECT lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', 2)) AS host, count(*) AS n FROM hotspot_items WHERE url IS NOT NULL GROUP BY 1)
        SELECT host, n, floor(n / (SELECT sum(n) FROM n)::DOUBLE * 1000000 + 0.5) / 1000000 AS share FROM n""",
}
