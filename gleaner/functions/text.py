"""Text functions as Column expressions: cleaning, clipping, tokens, similarity, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.fixed import ENTITY_PATTERNS, GENERIC_WORDS, STOPWORDS


SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def clean_text(c: Column | str) -> Column:
    """Runs of white space made one space, trimmed; null becomes the empty string."""
    return F.trim(F.regexp_replace(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), SPACE, " "))


def clip(c: Column, limit: int) -> Column:
    """At most ``limit`` characters, with three dots where something was cut."""
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, limit - 3)), F.lit("...")))


def concise(c: Column, limit: int = 300) -> Column:
    """Cut at the last sentence end within the limit if that keeps over 30 %, else at the last space."""
    head = F.substring(c, 1, limit)
    sentence = F.regexp_extract(head, r"(?s)^(.*[.!?])(?:\s|$)", 1)
    word = F.regexp_extract(head, r"(?s)^(.*)\s", 1)
    return F.when(F.length(c) <= limit, c).when(F.length(sentence) > limit * 0.3, sentence).when(word != "", F.rtrim(word)).otherwise(head)


def without_links(c: Column) -> Column:
    """Markdown links reduced to their text, bare addresses removed."""
    text = F.regexp_replace(c, r"\[([^\]]*)\]\(https?://[^)\s]*\)", "$1")
    return clean_text(F.regexp_replace(text, r"https?://\S+", ""))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def words(c: Column) -> Column:
    """Latin words and numbers in lower case, without stop words, in order."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: ~F.array_contains(stop, w))


def significant_words(c: Column) -> Column:
    """The distinct words of four letters or more, and numbers of three digits or more ('122b', '122m' and '122k' count as '122')."""
    cut = F.transform(words(c), lambda w: F.regexp_replace(w, "^([0-9]+)[bmk]$", "$1"))
    return F.array_sort(F.array_distinct(F.filter(cut, lambda w: (F.length(w) >= 4) | ((F.length(w) >= 3) & w.rlike("^[0-9]+$")))))


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two word sets; 0 where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    """Shared words as a share of the smaller set; 0 where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def telling_words(c: Column) -> Column:
    """The significant words but for those too common to link two titles."""
    generic = F.array(*[F.lit(w) for w in GENERIC_WORDS])
    return F.array_except(significant_words(c), generic)


def overlap_boost(shared: Column) -> Column:
    """A match level from the telling words that two titles share: 0.84 for three or more, 0.78 for two and 0.4 for one with a digit among them."""
    digits = F.exists(shared, lambda w: w.rlike("[0-9]"))
    return F.when(F.size(shared) >= 3, 0.84).when((F.size(shared) == 2) & digits, 0.78).when((F.size(shared) == 1) & digits, 0.4).otherwise(0.0)


def entities(c: Column) -> Column:
    """The organisations and products a text names, in lower case, as a sorted set."""
    t = F.coalesce(c, F.lit(""))
    found = F.concat(*[F.regexp_extract_all(t, F.lit(f"(?i){p}"), F.lit(0)) for p in ENTITY_PATTERNS])
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.trim(F.lower(x)))))


def any_of(c: Column, patterns: list[str]) -> Column:
    """Does one of the patterns occur, whatever the case?"""
    return c.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def pattern_hits(c: Column, patterns: list[str]) -> Column:
    """How many of the patterns occur."""
    return sum((c.rlike(p).cast("int") for p in patterns[1:]), c.rlike(patterns[0]).cast("int"))


def strip_tags(c: Column) -> Column:
    """Markup removed, the five basic entities resolved."""
    text = F.regexp_replace(c, "<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return clean_text(text)


def short_id(prefix: Column, base: Column) -> Column:
    """A stable identifier: a prefix and twelve hex digits of the hash of ``base``."""
    return F.concat(prefix, F.lit("-"), F.substring(F.sha1(base), 1, 12))
