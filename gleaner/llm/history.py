"""Problem 4: each new batch against everything accepted before, without working through the history again.

Identity has two parts. An address or paper number is reduced to a canonical form, and equal forms repeat each other. For
titles the operator keeps a pivot-distance table. Each pivot is the empty string under an edit distance that sees the letters
of one class only (``CLASSES`` classes in ``GROUPS`` groups), so that the distance of a title to it is the number of its letters
in the class; the first pivot sees all letters. The table holds for every accepted title the distance to the first pivot, the sum
of the distances in each group, and one key for each group: a hash of its vector of distances and of the characters that
are no letters, which a misspelling leaves alone.

One misspelling (a letter more, less, other, or two swapped) moves the distances by two in all at most, by the triangle
inequality in each class, so that at most two groups change and the third has the same vector: an equi-join on the group keys
loses no pair. The sums of the distances prune it by the triangle inequality, and the true edit distance is verified.

``write_table`` stores the table by range of the first pivot's distance. ``check_batch`` takes one arriving batch, reads only the
ranges within one of its own titles' distances (the directories of other ranges are not opened), and gives the repeated rows
and the rows to append; the history is neither parsed nor keyed again.

A whole table of batches is resolved at once: a row is rejected as soon as a related earlier row is accepted, and accepted
once all related earlier rows are rejected. Related rows meet in classes (one address, one title, titles one misspelling
apart), of which only the earliest batch and smallest key move between rounds, so that a hot story costs one row a class.
The number of rounds follows the longest chain of decisions that depend on each other, not the number of batches; rounds go on
until every row is decided.

Defined results: null or blank addresses, titles and numbers repeat nothing; repeated rows within a batch are not compared
(each may be accepted); residue rows take no part; ties take the smallest key; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.residue import ExemplarIndex, exemplar_weights
from gleaner.llm.shingles import mix
from gleaner.tables import cut_lineage, fixed_rows, spread

# Query parameters that only track the reader.
TRACKING = r"^(?:utm_\w+|mc_cid|mc_eid|fbclid|gclid|dclid|gbraid|wbraid|msclkid|yclid|igshid|twclid|ref|ref_src|ref_url|source|spm|cmpid|_hsenc|_hsmi|mkt_tok|amp)(?:=|$)"
# Short tags put before a title.
TAGS = r"(?:new|rt|re|fw|fwd|update|updated|breaking|exclusive|video|watch|live|just in|listen|podcast|read|via|wg|aw|neu|nouveau|nuevo|novo|nuovo)"

GROUPS, CLASSES = 3, 36
RANGE = 4  # distances to the first pivot in one directory of the stored table


def canonical_address(url: Column) -> Column:
    """One spelling of a web address: no scheme, user, default port, www/m/amp host, tracking, fragment or needless escapes."""
    u = F.trim(url)
    pattern = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    parts = F.split(F.regexp_replace(u, pattern, "$1\x01$2\x01$3"), "\x01")
    group = lambda i: F.coalesce(F.get(parts, F.lit(i - 1)), F.lit(""))
    host = F.regexp_replace(F.lower(group(1)), r":(?:80|443)$|\.(?=:|$)", "")
    host = F.regexp_replace(host, r"^(?:www\d?|m|mobile|amp)\.(?=[^.]+\.)", "")
    decode = lambda c: F.coalesce(F.try_url_decode(F.regexp_replace(c, r"\+", "%2B")), c)
    path = F.regexp_replace(F.regexp_replace(decode(group(2)), r"/{2,}", "/"), r"/(?:index\.(?:html?|php))?$", "")
    query = F.array_sort(F.filter(F.split(group(3), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    rest = F.when(F.size(query) > 0, F.concat(F.lit("?"), decode(F.array_join(query, "&")))).otherwise(F.lit(""))
    return F.when(url.isNull() | (host == ""), F.lit(None)).otherwise(F.concat(host, path, rest))


def paper_number(text: Column) -> Column:
    """The number in an arXiv identifier of any spelling, without its version; null where there is none."""
    new = F.regexp_extract(text, r"(?<!\d)(\d{4}\.\d{4,5})(?!\d)", 1)
    old = F.regexp_extract(F.lower(text), r"([a-z][a-z\-]+(?:\.[a-z]{2})?/\d{7})(?!\d)", 1)
    return F.when(new != "", new).when(old != "", old)


def title_core(title: Column, source_names: list[str]) -> Column:
    """The words of a title in lower case, without tags and source names before or after, punctuation and extra spacing."""
    t = F.trim(F.regexp_replace(F.lower(title), r"(?U)\s+", " "))
    names = sorted({" ".join(n.lower().split()) for n in source_names if n})
    for _ in range(2):
        t = F.regexp_replace(t, rf"^(?:\[[^\[\]0-9]{{1,20}}\]|\([^()0-9]{{1,12}}\)|{TAGS} ?:)\s*(?=\S)", "")
        t = F.regexp_replace(t, r"(?<=\S)\s*(?:\[[^\[\]0-9]{1,20}\]|\((?:update|updated|video|live|new)\))$", "")
        if names:
            tail = F.regexp_extract(t, r"^.*\S\s+[|·•/–—\-:]+\s+([^|·•–—]{1,60})$", 1)
            t = F.when(tail.isin(names), F.regexp_replace(F.substring(t, F.lit(1), F.length(t) - F.length(tail)), r"\s+[|·•/–—\-:]+\s*$", "")).otherwise(t)
            head = F.regexp_extract(t, r"^([^|·•–—:]{1,60}?)\s*[|·•/–—\-:]+\s+\S", 1)
            t = F.when(head.isin(names), F.regexp_replace(F.substring(t, F.length(head) + 1, F.length(t)), r"^\s*[|·•/–—\-:]+\s+", "")).otherwise(t)
    return F.nullif(F.trim(F.regexp_replace(t, r"[^\p{L}\p{M}\p{N}]+", " ")), F.lit(""))


_LETTERS = re.compile(r"[^\W\d_]+")


def _mixed(x: np.ndarray) -> np.ndarray:
    return mix(x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))


def pivot_distances(cores: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each title: the distances to the pivots of all classes (a row of ``CLASSES``), the sums by group, and the keys of the groups."""
    n = len(cores)
    lengths = np.fromiter((len(c) for c in cores), np.int64, n)
    codes = np.frombuffer("".join(cores).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(n), lengths)
    letter = _mixed(codes) % np.uint64(CLASSES)
    # only letters have classes; what is no letter goes into the keys in its order
    plain = (codes >= 97) & (codes <= 122)
    other = np.flatnonzero(~plain)
    distinct, back = np.unique(codes[other], return_inverse=True)
    plain[other] = np.array([chr(c).isalpha() for c in distinct], bool)[back] if len(distinct) else plain[other]
    distances = np.bincount(doc[plain] * CLASSES + letter[plain].astype(np.int64), minlength=n * CLASSES).reshape(n, CLASSES)
    rest = np.zeros(n, np.uint64)
    place = np.flatnonzero(~plain)
    if len(place):  # an order-keeping hash of the other characters: each by its rank among them
        rank = np.arange(len(place)) - np.searchsorted(doc[place], doc[place])
        np.add.at(rest, doc[place], _mixed(codes[place].astype(np.uint64) + (rank.astype(np.uint64) << np.uint64(32))))
    width = CLASSES // GROUPS
    keys = np.empty((n, GROUPS), np.int64)
    for g in range(GROUPS):
        h = rest + np.uint64(g + 1)
        for j in range(width):
            h = h * np.uint64(0x9E3779B97F4A7C15) + distances[:, g * width + j].astype(np.uint64)
            mix(h)
        keys[:, g] = h.view(np.int64)
    return distances, distances.reshape(n, GROUPS, width).sum(2), keys


def pivot_table(titles: DataFrame) -> DataFrame:
    """``titles`` (with ``core``) and, for each, ``p0`` (distance to the first pivot), the sums ``p1..`` of the groups and the group ``keys``; null cores have none."""
    schema = titles.schema
    sums = [f"p{g + 1}" for g in range(GROUPS)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cores = batch.column("core").to_pylist()
            null = np.array([c is None for c in cores], bool)
            distances, total, keys = pivot_distances([c or "" for c in cores])
            numbers = [pa.array(x.astype(np.int32), mask=null) for x in (distances.sum(1), *total.T)]
            keys = pa.array([None if skip else k for skip, k in zip(null, keys)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *numbers, keys], [*batch.schema.names, "p0", *sums, "keys"])

    extra = ", ".join([f"{c} int" for c in ["p0", *sums]] + ["keys array<bigint>"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return titles.mapInArrow(add, f"{fields}, {extra}")


def misspelt_pairs(table: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """``a, b`` of titles (rows of :func:`pivot_table` with ``tid``) that differ by one misspelt word; within ``table``, or of ``table`` with ``other``."""
    distances = [f"p{g}" for g in range(GROUPS + 1)]

    def keyed(df: DataFrame, s: str) -> DataFrame:
        # a key is only of use to titles of about the same length: the range goes into the join
        rows = df.filter("core is not null").select(F.explode("keys").alias("key"), "tid", *distances)
        return rows.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("tid", *distances)])

    a, b = keyed(table, "a"), keyed(table if other is None else other, "b")
    near = F.lit(True)
    moved = F.lit(0)
    for c in distances:
        near = near & (F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) <= 1)
        moved = moved + (F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) if c != "p0" else F.lit(0))
    order = (F.col("tid_a") < F.col("tid_b")) if other is None else (F.col("tid_a") != F.col("tid_b"))
    pairs = cut_lineage(a.join(b, "key").filter(order & near & (moved <= 2)).select(F.col("tid_a").alias("a"), F.col("tid_b").alias("b")).distinct())
    left = table.select(F.col("tid").alias("a"), F.col("core").alias("x"))
    right = (table if other is None else other).select(F.col("tid").alias("b"), F.col("core").alias("y"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = np.fromiter((one_misspelling(x, y) for x, y in zip(pdf["x"].array, pdf["y"].array)), bool, len(pdf))
            yield pdf.loc[ok, ["a", "b"]]

    return pairs.join(left, "a").join(right, "b").mapInPandas(verify, "a bigint, b bigint")


def one_misspelling(x: str, y: str) -> bool:
    """Do the titles lie one edit apart (a letter more, less or other, or two swapped), in a word and not in a figure?"""
    n, m = len(x), len(y)
    if x == y or abs(n - m) > 1:
        return False
    low = min(n, m)
    i = 0
    while i < low and x[i] == y[i]:
        i += 1
    j = 0
    while j < low - i and x[n - 1 - j] == y[m - 1 - j]:
        j += 1
    a, b = x[i : n - j], y[i : m - j]
    if not (len(a) <= 1 and len(b) <= 1 or len(a) == len(b) == 2 and a == b[::-1]):
        return False
    return all(c.isalpha() for c in a + b)


def resolve_batches(rows: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """``key_a, key_b`` of every rejected row, from ``key, batch, classes ARRAY<BIGINT>`` and links ``a, b`` between classes.

    Rows that share a class, or have classes that are linked, repeat each other. Rows of one class repeat each other, so
    the accepted rows of a class lie in one batch.
    """
    members = rows.select("key", "batch", F.explode("classes").alias("c"))
    sizes = members.groupBy("c").agg(F.countDistinct("batch").alias("n"))
    if links is None:
        busy = sizes.filter("n > 1").select("c")
        both = None
    else:
        both = links.select("a", "b").union(links.select("b", "a")).toDF("c", "scope").distinct()
        both = cut_lineage(both)
        busy = sizes.filter("n > 1").select("c").union(both.select("c")).distinct()
    # rows that meet no row of another batch are accepted without more ado
    members = members.join(members.join(busy, "c", "left_semi").select("key").distinct(), "key", "left_semi")
    members = cut_lineage(members)
    scope = members if both is None else members.union(members.join(both, "c").select("key", "batch", F.col("scope").alias("c")))
    scope = cut_lineage(scope.distinct()) if both is not None else scope
    status = cut_lineage(members.select("key", "batch").distinct().withColumn("state", F.lit(0)))  # 1 accepted, 2 rejected
    open_ = None
    while True:
        of_class = (
            members.join(status.filter("state < 2"), ["key", "batch"]).groupBy("c")
            .agg(F.min(F.when(F.col("state") == 1, F.col("batch"))).alias("acc"), F.min(F.when(F.col("state") == 0, F.col("batch"))).alias("und"))
        )
        seen = scope.join(status.filter("state = 0").select("key"), "key", "left_semi").join(of_class, "c", "left").groupBy("key").agg(F.min("acc").alias("acc"), F.min("und").alias("und"))
        step = status.join(seen, "key", "left").select(
            "key", "batch",
            F.when(F.col("state") > 0, F.col("state")).when(F.col("acc") < F.col("batch"), 2).when(F.coalesce(F.col("und") >= F.col("batch"), F.lit(True)), 1).otherwise(0).alias("state"),
        )
        status = cut_lineage(step)
        left = status.filter("state = 0").count()
        if not left:
            break
        if left == open_:  # the earliest undecided row can always be decided
            raise RuntimeError(f"{left} rows stay undecided")
        open_ = left
    first = members.join(status.filter("state = 1").select("key"), "key", "left_semi").groupBy("c").agg(F.min("batch").alias("acc"), F.min("key").alias("key_a"))
    rejected = scope.join(status.filter("state = 2").select("key"), "key", "left_semi").join(first, "c").filter("acc < batch")
    return rejected.groupBy(F.col("key").alias("key_b")).agg(F.min("key_a").alias("key_a")).select("key_a", "key_b")


def without_residue_rows(items: DataFrame, columns: dict[str, str], weights: dict[str, float] | None = None) -> DataFrame:
    """The ``columns`` (name to type) of items that hold no residue. ``weights``: see :func:`exemplar_weights`."""
    index = ExemplarIndex(exemplar_weights(items) if weights is None else weights)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bad = [index.holds(t, True) or index.holds(s, False) for t, s in zip(pdf["title"].array, pdf["_summary"].array)]
            yield pdf.loc[~np.array(bad, bool), list(columns)]

    schema = ", ".join(f"{c} {kind}" for c, kind in columns.items())
    return spread(items.select(*columns, F.col("summary").alias("_summary"))).mapInPandas(scan, schema)


def item_identities(items: DataFrame, source_names: list[str]) -> DataFrame:
    """``key, batch, u, t, core``: the title's core without spaces, and hashes of it and of the canonical address."""
    core = F.regexp_replace(title_core(F.col("title"), source_names), " ", "")
    rows = items.select(F.col("item_id").alias("key"), F.col("batch_id").alias("batch"), canonical_address(F.col("canonical_url")).alias("address"), core.alias("core"))
    u = F.when(F.col("address").isNotNull(), F.xxhash64("address", F.lit("u")))
    t = F.when(F.col("core").isNotNull(), F.xxhash64("core", F.lit("t")))
    return rows.filter("key is not null and batch is not null").withColumns({"u": u, "t": t}).drop("address")


def source_names(sources: DataFrame) -> list[str]:
    return [r[0] for r in fixed_rows(sources.select("source_name").filter("source_name is not null").distinct(), 1_000_000, "source names")]


_ITEM = {"item_id": "bigint", "batch_id": "int", "title": "string", "canonical_url": "string"}


def resolved_items(items: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows that take part (``key, batch, core, u, t``), and ``key_a, key_b`` of those that repeat an accepted one."""
    rows = cut_lineage(item_identities(without_residue_rows(items, _ITEM), source_names(sources)))
    titles = cut_lineage(pivot_table(rows.filter("t is not null").groupBy(F.col("t").alias("tid")).agg(F.min("core").alias("core"))))
    links = misspelt_pairs(titles)
    return rows, resolve_batches(rows.select("key", "batch", F.array_compact(F.array("u", "t")).alias("classes")), links)


def repeated_items(items: DataFrame, sources: DataFrame) -> DataFrame:
    """``key_a, key_b`` of the items that repeat an accepted one."""
    return resolved_items(items, sources)[1]


def repeated_papers(papers: DataFrame) -> DataFrame:
    """``key_a, key_b`` of the papers that repeat an accepted one: all rows of one number form one class."""
    rows = papers.select(F.col("paper_id").alias("key"), F.col("batch_id").alias("batch"), paper_number(F.col("arxiv_id")).alias("number")).filter("number is not null and key is not null and batch is not null")
    first = rows.groupBy("number").agg(F.min(F.struct("batch", "key")).alias("first"), F.max("batch").alias("last")).filter("first.batch < last")
    return rows.join(first, "number").filter(F.col("batch") > F.col("first.batch")).select(F.col("first.key").alias("key_a"), F.col("key").alias("key_b"))


def write_table(accepted: DataFrame, path: str, mode: str = "append") -> None:
    """Append accepted rows (``key, u, t`` and the columns of :func:`pivot_table`) to the stored table, by range of the first pivot's distance."""
    by_range = accepted.withColumn("range", F.floor(F.coalesce("p0", F.lit(0)) / RANGE).cast("int"))
    by_range.repartition("range", F.pmod(F.xxhash64("key"), F.lit(8))).write.mode(mode).partitionBy("range").parquet(path)


def batch_rows(batch: DataFrame, sources: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The rows of one batch that take part, as the table holds them. ``weights``: those of the residue exemplars, else counted in the batch."""
    return pivot_table(item_identities(without_residue_rows(batch, _ITEM, weights), source_names(sources)))


def check_batch(new: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One arriving batch (:func:`batch_rows`) against the stored table: the repeated rows ``key_a, key_b`` and the accepted rows to append.

    Of the table the titles of those ranges are read that a title of the batch can have a misspelling in, and for equal
    addresses and titles the columns ``key, u, t`` alone.
    """
    new = cut_lineage(new)
    reach = F.explode(F.array_distinct(F.transform(F.array(*[F.floor((F.col("p0") + k) / RANGE).cast("int") for k in (-1, 0, 1)]), lambda x: F.greatest(x, F.lit(0)))))
    ranges = [r[0] for r in fixed_rows(new.filter("t is not null").select(reach.alias("range")).distinct(), 100_000, "ranges of title lengths")]
    same = [new.filter(f"{c} is not null").select("key", c).join(history.select(F.col("key").alias("key_a"), c), c).select("key_a", F.col("key").alias("key_b")) for c in ("u", "t")]
    titled = lambda df: df.filter("t is not null").withColumn("tid", F.col("key"))
    apart = misspelt_pairs(titled(history.filter(F.col("range").isin(ranges))), titled(new)).select(F.col("a").alias("key_a"), F.col("b").alias("key_b"))
    repeats = cut_lineage(same[0].union(same[1]).union(apart).groupBy("key_b").agg(F.min("key_a").alias("key_a")).select("key_a", "key_b"))
    return repeats, new.join(repeats.select(F.col("key_b").alias("key")), "key", "left_anti")


def last_batch(items: DataFrame, sources: DataFrame, path: str) -> DataFrame:
    """``key_a, key_b`` of the newest batch, found against the stored table of all batches before it (written to ``path``)."""
    newest = items.agg(F.max("batch_id")).first()[0]
    before = items.filter(F.col("batch_id") < newest) if newest is not None else items.filter("false")
    rows, repeats = resolved_items(before, sources)
    accepted = pivot_table(rows.join(repeats.select(F.col("key_b").alias("key")), "key", "left_anti"))
    write_table(accepted, path, "overwrite")
    history = items.sparkSession.read.parquet(path) if before.limit(1).count() else accepted.withColumn("range", F.lit(0))
    return check_batch(batch_rows(items.filter(F.col("batch_id") == newest) if newest is not None else items, sources, exemplar_weights(items)), history)[0]
