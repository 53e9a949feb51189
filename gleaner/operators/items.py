"""Row-level operators on digest items: gates, classification, scores, deduplication.

All take and return DataFrames, carry the arrival order as a key of every ordering, and work on any number of days at once.
Null rules differ by gate and are stated with each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.functions.fixed import CLICKBAIT, CLONE_REPOSITORIES, ENGINEERING_TALK, EVENT_HINTS, EVENT_PATTERNS, FRONTIER_NEWS, LOW_ITEM, OPINION_TALK, PROMOTION, TALK_BASE, TALK_EXEMPT
from gleaner.functions.num import clamp

# Weight of a source's role in scores.
ROLE_WEIGHTS = {
    "official_news": 7.0, "research_backbone": 6.0, "paper_trending": 5.0, "github_trend": 4.2, "editorial_depth": 4.0,
    "builder_momentum": 3.5, "community_heat": 1.5, "hn_discussion": 1.5, "headline_consensus": 1.2,
}
DEFAULT_ROLE_WEIGHT = 2.5

# Weight of an event type in scores.
EVENT_WEIGHTS = {
    "product_release": 2.0, "funding": 1.8, "acquisition": 1.8, "research_paper": 1.5, "tooling": 1.3, "industry_move": 1.2,
    "other": 0.8, "tutorial": 0.5, "opinion": 0.3, "recap": 0.2,
}

def lookup(values: dict[str, float], key: Column, default: float) -> Column:
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def fresh(ts: Column, target: Column, hours: int, ahead_hours: int = 6, unknown: bool = True) -> Column:
    """Is the time within ``hours`` before and ``ahead_hours`` after the target? An unknown time gives ``unknown``."""
    inside = (ts >= target - F.expr(f"INTERVAL '{hours}' HOUR")) & (ts <= target + F.expr(f"INTERVAL '{ahead_hours}' HOUR"))
    return F.coalesce(inside, F.lit(unknown))


def keep_best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``, which must end in a unique column to be defined."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def event_type(body: Column, role: Column, paper: Column, least: float = 0.3) -> Column:
    """The type with the largest share of its patterns, half a point for the one the role suggests and one for papers; below ``least`` the suggestion, else 'other'.

    Of equal scores the type that stands first in the list wins.
    """
    hint = F.try_element_at(F.create_map(*[F.lit(x) for kv in EVENT_HINTS.items() for x in kv]), role)
    scores = []
    for i, (name, patterns) in enumerate(EVENT_PATTERNS.items()):
        score = text.pattern_hits(body, [f"(?i){p}" for p in patterns]) / F.lit(max(0.4 * len(patterns), 1.0)) + F.when(hint == name, 0.5).otherwise(0.0)
        if name == "research_paper":
            score = score + F.when(paper, 1.0).otherwise(0.0)
        scores.append(F.struct(score.alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*scores))
    return F.when(best["score"] >= least, best["name"]).otherwise(F.coalesce(hint, F.lit("other")))


def importance(role: Column, official: Column, repository: Column, upvotes: Column, points: Column) -> Column:
    """Importance from 1 to 10, half rounded to even."""
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    raw = 1.2 * lookup(ROLE_WEIGHTS, role, DEFAULT_ROLE_WEIGHT) + 1.5 * flag(official) + 0.8 * flag(repository) + 0.5 * flag(upvotes > 50) + 0.5 * flag(points > 50)
    return clamp(F.bround(raw, 0), 1.0, 10.0).cast("int")


def source_family(role: Column, kind: Column) -> Column:
    """The section a source belongs to; the first rule that holds decides."""
    return (
        F.when(role == "official_news", "official").when(role.isin("headline_consensus"), "market-signals").when(role == "editorial_depth", "analysis")
        .when(role.isin("paper_trending", "research_backbone") | (kind == "paper"), "papers").when((role == "github_trend") | (kind == "repository"), "github").otherwise("industry")
    )


def low_quality(title: Column, patterns: list[str], least: int) -> Column:
    """Is a title too short, missing or of a shape that tells nothing?"""
    t = F.coalesce(title, F.lit(""))
    return (F.length(t) < least) | text.any_of(t, patterns)


def low_item(title: Column, url: Column) -> Column:
    """Is an item not worth a place in a section: its title, or a repository that copies another?"""
    t, u = F.trim(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    return low_quality(t, LOW_ITEM, 10) | (F.contains(u, F.lit("github.com")) & text.any_of(F.concat_ws(" ", t, u), CLONE_REPOSITORIES))


def talk_scores(title: Column, summary: Column, role: Column) -> tuple[Column, Column]:
    """How far a text is talk about engineering, and how far it lacks substance, each from 0 to 1; exempt roles are never judged."""
    low = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit(""))))
    hits = lambda patterns: text.pattern_hits(low, [f"(?i){p}" for p in patterns])
    talk = clamp(lookup(TALK_BASE, role, 0.20) + hits(ENGINEERING_TALK) * 0.15 - hits(FRONTIER_NEWS) * 0.20, 0.0, 1.0)
    thin = clamp(hits(OPINION_TALK) * 0.25 + hits(CLICKBAIT) * 0.20 + hits(PROMOTION) * 0.30 - hits(FRONTIER_NEWS) * 0.15, 0.0, 1.0)
    exempt = F.coalesce(role.isin(*TALK_EXEMPT), F.lit(False))
    return F.when(exempt, 0.0).otherwise(talk), F.when(exempt, 0.0).otherwise(thin)


def not_in_history(new: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    """Rows none of whose keys occurs in the history: one anti-join a key, as an OR over keys would be a nested loop."""
    for k in keys:
        seen = history.select(F.col(k)).filter(F.col(k).isNotNull()).distinct()
        new = new.join(seen, k, "left_anti")
    return new


def not_seen_before(rows: DataFrame, batch: str, keys: list[str], back: int) -> DataFrame:
    """Rows none of whose keys occurs in the ``back`` batches before their own; a null key was never seen, a null batch has none before it.

    A key is held once a batch, and its latest earlier batch decides.
    """
    out = rows
    for k in keys:
        once = rows.select(k, batch).filter(F.col(k).isNotNull() & F.col(batch).isNotNull()).distinct()
        last = F.lag(batch).over(Window.partitionBy(k).orderBy(batch))
        out = out.join(once.withColumn("_last", last).filter(F.col(batch) - F.col("_last") <= back).select(k, batch), [k, batch], "left_anti")
    return out


def retry_set(asked: DataFrame, answered: DataFrame, key: str) -> DataFrame:
    """What was asked for and not answered."""
    return asked.join(answered.select(key).distinct(), key, "left_anti")


def merge_right(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full outer merge in which the right side's values win."""
    r = right.select(key, *[F.col(c).alias(f"_r_{c}") for c in columns])
    return left.select(key, *columns).join(r, key, "full_outer").select(key, *[F.coalesce(f"_r_{c}", c).alias(c) for c in columns])
