"""Further queries of the inventory: gates and extraction, edges by entity, projections, payloads, guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import fixed, text, url
from gleaner.functions.num import half_up
from gleaner.operators import items as op
from gleaner.operators import stories as st
from gleaner.queries.items import _items
from gleaner.queries.stories import _FAM, _K, _words, _with_keys
from gleaner.tables import table


def q_url_title_gate(spark: SparkSession, d: str) -> DataFrame:
    """Titles that share no word with their address; short and non-Latin titles pass."""
    t = F.coalesce("title", F.lit(""))
    w = text.significant_words(t)
    path = F.regexp_extract_all(F.lower(F.coalesce("url", F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    latin = F.length(F.regexp_replace(t, r"[^\x00-\x7f]", "")) > 0.7 * F.length(t)
    return _items(spark, d).filter(latin & (F.size(w) >= 2) & (F.size(F.array_intersect(w, path)) == 0)).select("item_id")


def q_overlap_boost(spark: SparkSession, d: str) -> DataFrame:
    """TXT-09: a match level from the telling words that a member's title shares with its cluster's."""
    rows = table(spark, d, "hotspot_clusters").select("cluster_id", "title", F.explode("cluster_items").alias("m"))
    shared = F.array_intersect(text.telling_words(F.col("title")), text.telling_words(F.col("m.title")))
    return rows.select("cluster_id", F.col("m.item_id").alias("item_id"), text.overlap_boost(shared).alias("boost"))


def q_activity_extract(spark: SparkSession, d: str) -> DataFrame:
    """A number of shares named in a summary."""
    n = F.regexp_extract("summary", r"(?i)shared ([0-9][0-9,]*) times", 1)
    return _items(spark, d).select("item_id", F.replace(n, F.lit(","), F.lit("")).try_cast("int").alias("shares")).filter("shares is not null")


def q_takeaways(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-18: the first three different sentences of a summary that do more than repeat the title."""
    sentences = F.transform(F.split(text.clean_text("summary"), r"[.!?] "), lambda x: F.trim(x))
    t = text.significant_words(F.col("title"))
    fresh = F.filter(sentences, lambda x: (F.length(x) >= 20) & (text.containment(text.significant_words(x), t) <= 0.7))
    return _items(spark, d).select("item_id", F.md5(F.array_join(F.slice(F.array_distinct(fresh), 1, 3), "|")).alias("h"), F.size(F.slice(F.array_distinct(fresh), 1, 3)).alias("n"))


def q_digest_text(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-19: per batch a text of the first five items, one line each."""
    rows = _items(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("batch_id").orderBy("item_id"))).filter("place <= 5")
    line = F.concat(F.lit("* ["), "source_role", F.lit("] "), text.clip(text.clean_text("title"), 60))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n")
    return rows.groupBy("batch_id").agg(F.md5(joined).alias("h"))


def q_cluster_scores(spark: SparkSession, d: str) -> DataFrame:
    """AGG-06: a deterministic cluster score: role weights, numbers of sources and types, logarithms of engagement."""
    members = table(spark, d, "hotspot_clusters").select("cluster_id", F.explode("cluster_items").alias("m")).select("cluster_id", F.col("m.item_id").alias("item_id"))
    rows = members.join(_items(spark, d), "item_id")
    m = F.col("metadata")
    zero = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    per = half_up(op.lookup(op.ROLE_WEIGHTS, F.col("source_role"), op.DEFAULT_ROLE_WEIGHT) + 1.35 * F.log1p(zero(m["upvotes"])) + 1.15 * F.log1p(zero(m["activity"])) + 0.9 * F.log1p(zero(m["hn_score"])), 6)
    agg = rows.groupBy("cluster_id").agg(F.sum(F.round(per * 1_000_000).cast("long")).alias("s"), F.countDistinct("source_id").alias("n_s"), F.countDistinct("source_type").alias("n_t"), F.max(m["upvotes"]).alias("upvotes"), F.sum(F.coalesce(m["stars"], m["activity"], F.lit(0))).alias("first"))
    return agg.select("cluster_id", half_up(F.col("s") / 1_000_000 + 1.8 * F.col("n_s") + 1.1 * F.col("n_t"), 3).alias("score"), "upvotes", "first")


def q_entity_edges(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-10: items that name the same organisation and share another significant word: star edges by organisation and word."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("title", F.lit("")), F.lit(r"([A-Z][a-z]+ (?:Labs|Research|Works|Systems|Foundry|Collective))"), F.lit(1)), lambda x: F.lower(x)))
    rows = _items(spark, d).select("item_id", F.explode(found).alias("entity"), text.significant_words(F.col("title")).alias("w"))
    other = F.explode(F.array_except("w", F.split("entity", " ")))
    pairs = rows.select("item_id", "entity", other.alias("word")).withColumn("key", F.concat_ws("|", "entity", "word"))
    return st.shared_key_edges(pairs, "item_id", [F.col("key")])


def q_companions(spark: SparkSession, d: str) -> DataFrame:
    """Cluster members joined to their items: how many there are, how many of them have a canonical address."""
    members = table(spark, d, "hotspot_clusters").select("cluster_id", F.explode_outer("cluster_items").alias("m")).select("cluster_id", F.col("m.item_id").alias("item_id"))
    kept = _items(spark, d).filter("canonical_url is not null and trim(canonical_url) <> ''").select("item_id", F.lit(1).alias("hit"))
    return members.join(kept, "item_id", "left").groupBy("cluster_id").agg(F.count("item_id").alias("members"), F.count("hit").alias("found"))




def q_stale_feeds(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose newest item lies more than a week before the newest of all."""
    per = _items(spark, d).groupBy("source_id").agg(F.max("batch_id").alias("last"))
    top = per.agg(F.max("last").alias("top"))
    return per.crossJoin(F.broadcast(top)).select("source_id", "last", (F.col("top") - F.col("last") > 7).alias("stale"))


def q_story_projection(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-02, AGG-25: derived scores of a story from its sources, types, items and importance."""
    agg = _with_keys(spark, d).filter("k_url is not null").groupBy("k_url").agg(
        F.countDistinct("source_id").alias("n_s"), F.countDistinct("source_type").alias("n_t"), F.count("*").alias("n_i"), F.sum("importance").alias("imp"), F.max((F.col("source_role") == "official_news").cast("int")).alias("official"),
    )
    clamp = lambda c: F.greatest(F.lit(1.0), F.least(F.lit(10.0), c))
    ns, nt, ni = F.col("n_s"), F.col("n_t"), F.col("n_i")
    return agg.select(
        "k_url", half_up(clamp(2 + 1.3 * ns + 0.8 * nt + 1.5 * F.col("official")), 3).alias("evidence"), half_up(clamp(1.5 + 1.4 * F.greatest(ns - 1, F.lit(0)) + F.greatest(nt - 1, F.lit(0))), 3).alias("resonance"),
        half_up(F.least(F.lit(10.0), 1.2 + 1.3 * ns + 0.9 * F.greatest(nt - 1, F.lit(0)) + F.least(F.lit(2.2), 0.45 * ni)), 3).alias("occurrence"), half_up(F.col("imp") / ni, 6).alias("importance"),
    )


def q_day_payload(spark: SparkSession, d: str) -> DataFrame:
    """Per batch a document of totals and counts by family."""
    fam = _items(spark, d).groupBy("batch_id", op.source_family(F.col("source_role"), F.col("source_type")).alias("family")).agg(F.count("*").alias("n"))
    parts = F.array_sort(F.collect_list(F.struct("family", "n")))
    out = fam.groupBy("batch_id").agg(F.sum("n").alias("items"), F.array_join(F.transform(parts, lambda x: F.concat(x["family"], F.lit("="), x["n"].cast("string"))), ";").alias("families"))
    return out


def q_unpivot_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts by field in long form, each distinct text once, with the rows it serves."""
    longs = _items(spark, d).select("item_id", F.expr("stack(2, 'title', title, 'summary', summary) as (field, txt)")).filter("txt is not null")
    return longs.groupBy("field", F.md5("txt").alias("h")).agg(F.count("*").alias("rows"), F.min("item_id").alias("first"))


def q_admission(spark: SparkSession, d: str) -> DataFrame:
    """Items admitted to a section: not featured, important enough, of a telling title."""
    rows = _with_keys(spark, d).filter(F.col("importance") >= 5)
    featured = op.keep_best(_with_keys(spark, d), ["batch_id"], [F.desc("importance"), F.asc("item_id")]).select("item_id")
    return rows.join(featured, "item_id", "left_anti").filter(F.size(text.significant_words(F.col("title"))) >= 3).select("item_id", "batch_id")


def q_account_priority(spark: SparkSession, d: str) -> DataFrame:
    """The 24 most active authors by papers, then name."""
    names = table(spark, d, "papers").select(F.explode("authors").alias("name")).groupBy("name").agg(F.count("*").alias("papers"))
    # the list itself is the feature: its 24 rows are taken first, the numbering runs over them alone
    top = names.orderBy(F.desc("papers"), "name").limit(24)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("papers"), "name")))


def q_orphan_days(spark: SparkSession, d: str) -> DataFrame:
    """SRC-25: days that have a batch and no item, and the other way round."""
    a = table(spark, d, "batches").select(F.col("batch_date").alias("day"))
    b = _items(spark, d).select(F.to_date("fetched_at").alias("day")).distinct()
    return a.join(b, "day", "left_anti").withColumn("side", F.lit("batch")).unionByName(b.join(a, "day", "left_anti").withColumn("side", F.lit("items")))


def q_seed_clusters(spark: SparkSession, d: str) -> DataFrame:
    """FOLD-03, JOIN-12: greedy clusters of like titles within each batch."""
    return st.seed_clusters(_items(spark, d).select("item_id", "batch_id", "title"), "batch_id", "item_id", "title").filter("seed <> item_id").select("item_id", "seed")


QUERIES = {f.__name__: f for f in (
    q_url_title_gate, q_overlap_boost, q_activity_extract, q_takeaways, q_digest_text, q_cluster_scores, q_entity_edges, q_companions, q_stale_feeds,
    q_story_projection, q_day_payload, q_unpivot_texts, q_admission, q_account_priority, q_orphan_days, q_seed_clusters,
)}

_SP = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_CLEAN = "trim(regexp_replace(coalesce({}, ''), '" + _SP.replace("{", "{{").replace("}", "}}") + "', ' ', 'g'))"
_T, _S = _CLEAN.format("title"), _CLEAN.format("summary")
_GENERIC = "[" + ", ".join(f"'{w}'" for w in fixed.GENERIC_WORDS) + "]"
_ROLE_W = "CASE source_role " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in op.ROLE_WEIGHTS.items()) + f" ELSE {op.DEFAULT_ROLE_WEIGHT} END"
_SENT = f"list_transform(regexp_split_to_array({_S}, '[.!?] '), lambda x: trim(x))"
_FRESH = f"list_filter(s, lambda x: length(x) >= 20 AND (len({_words('x')}) = 0 OR len(t) = 0 OR len(list_intersect({_words('x')}, t))::DOUBLE / least(len({_words('x')}), len(t)) <= 0.7))"


def _first_distinct(v: str) -> str:
    return f"list_filter({v}, lambda x, i: list_position({v}, x) = i)"


SQL = {
    "q_url_title_gate": rf"""
        WITH t AS (SELECT item_id, coalesce(title, '') AS t, {_words('title')} AS w, regexp_extract_all(lower(coalesce(url, '')), '[a-z0-9]+') AS p FROM hotspot_items)
        SELECT item_id FROM t WHERE length(regexp_replace(t, '[^\x00-\x7f]', '', 'g')) > 0.7 * length(t) AND len(w) >= 2 AND len(list_intersect(w, p)) = 0""",
    "q_overlap_boost": f"""
        WITH t AS (SELECT cluster_id, {_words('title')} AS x, unnest(cluster_items) AS m FROM hotspot_clusters), u AS (SELECT cluster_id, m.item_id AS item_id, list_filter(list_intersect(x, {_words('m.title')}), lambda x: NOT list_contains({_GENERIC}, x)) AS s FROM t),
        v AS (SELECT cluster_id, item_id, len(s) AS n, len(list_filter(s, lambda x: regexp_matches(x, '[0-9]'))) >= 1 AS digit FROM u)
        SELECT cluster_id, item_id, (CASE WHEN n >= 3 THEN 0.84 WHEN n = 2 AND digit THEN 0.78 WHEN n = 1 AND digit THEN 0.4 ELSE 0.0 END)::DOUBLE AS boost FROM v""",
    "q_activity_extract": """
        WITH t AS (SELECT item_id, try_cast(replace(regexp_extract(summary, '(?i)shared ([0-9][0-9,]*) times', 1), ',', '') AS INT) AS shares FROM hotspot_items) SELECT * FROM t WHERE shares IS NOT NULL""",
    "q_takeaways": f"""
        WITH a AS (SELECT item_id, {_SENT} AS s, {_words('title')} AS t FROM hotspot_items), b AS (SELECT item_id, {_FRESH} AS f FROM a), c AS (SELECT item_id, list_slice({_first_distinct('f')}, 1, 3) AS k FROM b)
        SELECT item_id, md5(coalesce(array_to_string(k, '|'), '')) AS h, len(k)::INT AS n FROM c""",
    "q_digest_text": f"""
        WITH t AS (SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY item_id) AS place, '* [' || source_role || '] ' || CASE WHEN length({_T}) <= 60 THEN {_T} ELSE rtrim(substr({_T}, 1, 57)) || '...' END AS line FROM hotspot_items)
        SELECT batch_id, md5(string_agg(line, chr(10) ORDER BY place)) AS h FROM t WHERE place <= 5 GROUP BY 1""",
    "q_cluster_scores": f"""
        WITH m AS (SELECT cluster_id, unnest(cluster_items).item_id AS item_id FROM hotspot_clusters),
        r AS (SELECT *, floor(({_ROLE_W}::DOUBLE + 1.35::DOUBLE * ln(1 + greatest(coalesce(metadata.upvotes, 0), 0)) + 1.15::DOUBLE * ln(1 + greatest(coalesce(metadata.activity, 0), 0)) + 0.9::DOUBLE * ln(1 + greatest(coalesce(metadata.hn_score, 0), 0))) * 1000000 + 0.5) / 1000000 AS per FROM m JOIN hotspot_items USING (item_id)),
        a AS (SELECT cluster_id, sum(round(per * 1000000)::BIGINT) AS s, count(DISTINCT source_id) AS n_s, count(DISTINCT source_type) AS n_t, max(metadata.upvotes) AS upvotes, sum(coalesce(metadata.stars, metadata.activity, 0))::BIGINT AS first FROM r GROUP BY 1)
        SELECT cluster_id, floor((s / 1000000.0::DOUBLE + 1.8::DOUBLE * n_s + 1.1::DOUBLE * n_t) * 1000 + 0.5) / 1000 AS score, upvotes, first FROM a""",
    "q_entity_edges": rf"""
        WITH r AS (SELECT item_id, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(title, ''), '[A-Z][a-z]+ (?:Labs|Research|Works|Systems|Foundry|Collective)'), lambda x: lower(x)))) AS entity, {_words('title')} AS w FROM hotspot_items),
        n AS (SELECT DISTINCT item_id AS b, entity || '|' || word AS key FROM (SELECT item_id, entity, unnest(list_filter(w, lambda x: NOT list_contains(string_split(entity, ' '), x))) AS word FROM r)),
        f AS (SELECT key, min(b) AS a FROM n GROUP BY key HAVING count(*) > 1)
        SELECT DISTINCT a, b FROM n JOIN f USING (key) WHERE a < b""",
    "q_companions": """
        WITH m AS (SELECT cluster_id, unnest(cluster_items).item_id AS item_id FROM hotspot_clusters)
        SELECT c.cluster_id, count(m.item_id) AS members, count(i.item_id) AS found FROM hotspot_clusters c LEFT JOIN m ON m.cluster_id = c.cluster_id LEFT JOIN hotspot_items i ON i.item_id = m.item_id AND nullif(trim(i.canonical_url), '') IS NOT NULL GROUP BY 1""",
    "q_stale_feeds": "WITH p AS (SELECT source_id, max(batch_id) AS last FROM hotspot_items GROUP BY 1) SELECT source_id, last, (SELECT max(last) FROM p) - last > 7 AS stale FROM p",
    "q_story_projection": f"""
        WITH k AS ({_K}), a AS (SELECT k_url, count(DISTINCT source_id) AS ns, count(DISTINCT source_type) AS nt, count(*) AS ni, sum(importance) AS imp, max((source_role = 'official_news')::INT) AS o FROM k WHERE k_url IS NOT NULL GROUP BY 1)
        SELECT k_url, floor(greatest(1.0::DOUBLE, least(10.0::DOUBLE, 2 + 1.3::DOUBLE * ns + 0.8::DOUBLE * nt + 1.5::DOUBLE * o)) * 1000 + 0.5) / 1000 AS evidence,
          floor(greatest(1.0::DOUBLE, least(10.0::DOUBLE, 1.5::DOUBLE + 1.4::DOUBLE * greatest(ns - 1, 0) + greatest(nt - 1, 0))) * 1000 + 0.5) / 1000 AS resonance,
          floor(least(10.0::DOUBLE, 1.2::DOUBLE + 1.3::DOUBLE * ns + 0.9::DOUBLE * greatest(nt - 1, 0) + least(2.2::DOUBLE, 0.45::DOUBLE * ni)) * 1000 + 0.5) / 1000 AS occurrence, floor(imp / ni::DOUBLE * 1000000 + 0.5) / 1000000 AS importance FROM a""",
    "q_day_payload": f"""
        WITH f AS (SELECT batch_id, {_FAM} AS family, count(*) AS n FROM hotspot_items GROUP BY 1, 2)
        SELECT batch_id, sum(n)::BIGINT AS items, string_agg(family || '=' || n::VARCHAR, ';' ORDER BY family) AS families FROM f GROUP BY 1""",
    "q_unpivot_texts": """
        WITH l AS (SELECT item_id, 'title' AS field, title AS txt FROM hotspot_items UNION ALL SELECT item_id, 'summary', summary FROM hotspot_items)
        SELECT field, md5(txt) AS h, count(*) AS rows, min(item_id) AS first FROM l WHERE txt IS NOT NULL GROUP BY 1, 2""",
    "q_admission": f"""
        WITH k AS ({_K}), f AS (SELECT item_id FROM k QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY importance DESC, item_id) = 1)
        SELECT item_id, batch_id FROM k WHERE importance >= 5 AND item_id NOT IN (SELECT item_id FROM f) AND len({_words('title')}) >= 3""",
    "q_account_priority": """
        WITH n AS (SELECT name, count(*) AS papers FROM (SELECT unnest(authors) AS name FROM papers) GROUP BY 1) SELECT name, papers, row_number() OVER (ORDER BY papers DESC, name) AS place FROM n QUALIFY place <= 24""",
    "q_orphan_days": """
        WITH a AS (SELECT batch_date AS day FROM batches), b AS (SELECT DISTINCT fetched_at::DATE AS day FROM hotspot_items)
        SELECT day, 'batch' AS side FROM a WHERE day NOT IN (SELECT day FROM b) UNION ALL SELECT day, 'items' FROM b WHERE day NOT IN (SELECT day FROM a)""",
}
