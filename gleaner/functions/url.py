"""Web addresses as Column expressions: three normal forms, host."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters whose name begins so are dropped.
TRACKED_PREFIXES = r"^(utm_|fbclid|gclid|mc_|ref)"


def _part(c: Column, i: int) -> Column:
    return F.regexp_extract(F.trim(c), r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$", i)


def address(canonical: str | Column = "canonical_url", url: str | Column = "url") -> Column:
    """An item's address: the canonical one, else the plain one; blank ones are none."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(blank(canonical), blank(url))


def host(c: Column) -> Column:
    """The authority in lower case; the empty string where there is none."""
    return F.lower(_part(c, 2))


def without_tracking(c: Column) -> Column:
    """Scheme and host in lower case, double slashes, fragment, trailing slash and tracking parameters removed."""
    path = F.regexp_replace(F.regexp_replace(_part(c, 3), "/+", "/"), "/$", "")
    kept = F.filter(F.split(F.regexp_replace(_part(c, 4), r"^\?", ""), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKED_PREFIXES))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(_part(c, 2) == "", F.trim(c)).otherwise(F.concat(F.lower(_part(c, 1)), F.lit("://"), F.lower(_part(c, 2)), path, query))


def without_query(c: Column) -> Column:
    """Query, fragment and trailing slashes removed."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"[?#].*$", ""), "/+$", "")


def canonical(c: Column) -> Column:
    """Preprint pages under their number, everything else without query."""
    number = F.regexp_extract(c, r"/(?:abs|pdf)/([0-9]{4}\.[0-9]{4,5})", 1)
    return F.when(number != "", F.concat(F.lit("preprint:"), number)).otherwise(F.lower(without_query(c)))
