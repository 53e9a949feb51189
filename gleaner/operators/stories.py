"""From items to stories: links, groups, representatives, scores, normalisation, penalties and diversified selection."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.functions.num import steps
from gleaner.operators import sequences
from gleaner.operators.components import connected_components
from gleaner.operators.items import DEFAULT_ROLE_WEIGHT, ROLE_WEIGHTS, lookup
from gleaner.tables import bounded

#: Rows of a block, shared words looked at in one step, and rows of a block of titles.
BLOCK, PAIRS, NEAR = 20_000, 2_000_000, 10_000


def shared_key_edges(df: DataFrame, vertex: str, keys: list[Column]) -> DataFrame:
    """``a, b``: every row linked to the first row that has the same key, whichever of its keys; a star, not all pairs."""
    named = df.select(F.col(vertex).alias("b"), F.explode(F.array_compact(F.array(*keys))).alias("key")).distinct()
    first = named.groupBy("key").agg(F.min("b").alias("a"), F.count("*").alias("n")).filter("n > 1").select("key", "a")
    return named.join(first, "key").filter("a < b").select("a", "b").distinct()


def word_pairs(df: DataFrame, vertex: str, words: Column, least: float, contained: float = 0.8, least_words: int = 2) -> DataFrame:
    """``a, b`` of rows whose word sets are at least ``least`` alike, or one ``contained`` in the other.

    Candidates come from an inverted index, only on each row's rarest words: two sets within the bounds share one of their
    first ``size - ceil(contained_bound * size) + 1`` words in order of rarity (prefix filter), so nothing is lost.
    """
    rows = df.select(F.col(vertex).alias("v"), words.alias("w")).filter(F.size("w") >= least_words)
    # a containment of c in the smaller set needs c * size shared words, so its prefix has size - ceil(c * size) + 1 words
    bound = min(least, contained)
    each = rows.select("v", F.explode("w").alias("word"))
    df_of = each.groupBy("word").agg(F.count("*").alias("df"))
    ranked = each.join(df_of, "word").withColumns({
        "r": F.row_number().over(Window.partitionBy("v").orderBy("df", "word")),
        "size": F.count("*").over(Window.partitionBy("v")),
    })
    prefix = ranked.filter(F.col("r") <= F.col("size") - F.ceil(bound * F.col("size")) + 1)
    # the larger set of a contained pair may hold the words anywhere: its side is not cut
    cand = prefix.select("word", F.col("v").alias("x")).join(ranked.select("word", F.col("v").alias("y")), "word").filter("x <> y")
    cand = cand.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    both = cand.join(rows.select(F.col("v").alias("a"), F.col("w").alias("wa")), "a").join(rows.select(F.col("v").alias("b"), F.col("w").alias("wb")), "b")
    return both.filter((text.jaccard(F.col("wa"), F.col("wb")) >= least) | (text.containment(F.col("wa"), F.col("wb")) >= contained)).select("a", "b")


def sequence_similarity(pairs: DataFrame, left: str, right: str, least: float) -> DataFrame:
    """Pairs whose Ratcliff-Obershelp ratio is at least ``least``, with the ratio; a length bound goes before the Python kernel."""
    bound = 2 * F.least(F.length(left), F.length(right)) / (F.length(left) + F.length(right))
    columns = pairs.columns

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ratio = []
            m, last = SequenceMatcher(None), None
            for a, b in zip(pdf[left], pdf[right]):
                if b != last:  # the second text is indexed once for the pairs that follow each other
                    m.set_seq2(b)
                    last = b
                m.set_seq1(a)
                ratio.append(m.ratio() if m.quick_ratio() >= least else 0.0)  # counts of characters bound the ratio
            out = pdf.assign(ratio=ratio)
            yield out[out["ratio"] >= least]

    schema = ", ".join(f"`{n}` {t}" for n, t in pairs.dtypes)
    return pairs.filter(bound >= least).mapInPandas(score, f"{schema}, ratio double").select(*columns, "ratio")


def story_components(items: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """``key, story``: items by connected component, an item without links being a story of its own."""
    labels = connected_components(edges).withColumnRenamed("vertex", key).withColumnRenamed("component", "story")
    return items.select(key).join(labels, key, "left").select(key, F.coalesce("story", key).alias("story"))


def representatives(rows: DataFrame, key: str) -> DataFrame:
    """One row per ``story``: the item of the heaviest role, then importance, then longest summary, the first of equals; sorted source sets."""
    weight = lookup(ROLE_WEIGHTS, F.col("source_role"), DEFAULT_ROLE_WEIGHT)
    best = F.max_by(key, F.struct(weight, F.col("importance"), F.length(F.coalesce("summary", F.lit(""))), -F.col(key)))
    return rows.groupBy("story").agg(best.alias("canonical_item"), F.array_join(F.array_sort(F.collect_set("source_id")), ",").alias("source_ids"), F.count("*").alias("items"))


def weighted_mode(rows: DataFrame, group: str, value: str, weights: dict[str, float], order: str) -> DataFrame:
    """The most frequent value per group, by weight among equals, then by first appearance."""
    n = rows.groupBy(group, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return n.groupBy(group).agg(F.max_by(value, F.struct("n", lookup(weights, F.col(value), 0.0), -F.col("first"))).alias(value))


def raw_scores(rows: DataFrame, as_of: Column) -> DataFrame:
    """The unnormalised score of each ``story`` from weights, numbers of sources and types, importance and age."""
    weight = lookup(ROLE_WEIGHTS, F.col("source_role"), DEFAULT_ROLE_WEIGHT)
    agg = rows.groupBy("story").agg(
        F.sum(F.round(weight * 10).cast("long")).alias("w10"), F.countDistinct("source_id").alias("n_s"), F.countDistinct("source_type").alias("n_t"),
        F.avg("importance").alias("imp"), F.max("fetched_at").alias("last"), F.count("*").alias("n"),
    )
    hours = (F.unix_timestamp(as_of) - F.unix_timestamp("last")) / 3600.0
    decay = steps(hours, [(8, 1.0), (16, 0.85), (24, 0.65), (36, 0.4)], 0.2, 0.6)
    return agg.withColumn("raw", (F.least(F.lit(25.0), F.col("w10") / 10.0) + 1.5 * F.col("n_s") + 0.8 * F.col("n_t") + F.col("imp")) * decay)


def nearest_rank(rows: DataFrame, value: str, shares: dict[str, float], by: list[str], width: float = 0.01) -> DataFrame:
    """``total, top`` and a column per share: the value at rank ``max(1, floor(n * share))``, exactly, per group.

    Values are counted in bins of ``width`` first; the windows run over bins (as many as the value range has) and over
    the distinct values of the one bin that holds the rank, never over all rows.
    """
    binned = rows.select(*by, value, F.floor(F.col(value) / width).alias("_bin"))
    bins = binned.groupBy(*by, "_bin").agg(F.count("*").alias("_c"), F.max(value).alias("_top"))
    all_bins = Window.partitionBy(*by)
    bins = bins.withColumns({"_cum": F.sum("_c").over(all_bins.orderBy("_bin")), "total": F.sum("_c").over(all_bins), "top": F.max("_top").over(all_bins)})
    asked = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.greatest(F.lit(1), F.floor(F.col("total") * q)).alias("rank")) for n, q in shares.items()]))
    at = bins.select(*by, "_bin", "_cum", "_c", "total", "top", asked.alias("q")).filter((F.col("_cum") >= F.col("q.rank")) & (F.col("_cum") - F.col("_c") < F.col("q.rank")))
    at = at.select(*by, "_bin", "total", "top", F.col("q.name").alias("name"), (F.col("q.rank") - (F.col("_cum") - F.col("_c"))).alias("nth"))
    values = binned.join(F.broadcast(at), [*by, "_bin"]).groupBy(*by, "total", "top", "name", "nth", value).agg(F.count("*").alias("_n"))
    seen = F.sum("_n").over(Window.partitionBy(*by, "name").orderBy(value))
    found = values.withColumn("_seen", seen).filter(F.col("_seen") >= F.col("nth"))
    return found.groupBy(*by, "total", "top").agg(*[F.min(F.when(F.col("name") == n, F.col(value))).alias(n) for n in shares])


def normalise_scores(raw: DataFrame, partition: list[str] | None = None) -> DataFrame:
    """Scores from 1 to 10 by the nearest-rank median, 95th percentile and maximum; ``partition`` names the columns that separate days."""
    by = partition or []
    stats = nearest_rank(raw, "raw", {"p50": 0.5, "p95": 0.95}, by)
    out = raw.join(F.broadcast(stats), by) if by else raw.join(F.broadcast(stats.withColumn("_k", F.lit(1))), F.lit(1) == F.col("_k")).drop("_k")
    r, p50, p95, top = (F.col(c) for c in ("raw", "p50", "p95", "top"))
    flat = F.least(F.lit(10.0), F.greatest(F.lit(1.0), r / F.greatest(p50 / 5, F.lit(0.5))))
    bent = (
        F.when(r <= p50, F.greatest(F.lit(1.0), 1 + 4 * r / p50)).when(r <= p95, 5 + 4.5 * (r - p50) / (p95 - p50))
        .otherwise(9.5 + F.when(top > p95, 0.5 * (r - p95) / F.when(top > p95, top - p95)).otherwise(0.0))
    )
    return out.withColumn("score", F.when((p95 <= p50) | (F.col("total") < 3), flat).otherwise(bent)).drop("total", "top", "p50", "p95")


def headline_penalty(rows: DataFrame, key: str, batch: str, words: str, back: int = 30, least: float = 0.5, factor: float = 0.3) -> DataFrame:
    """``key, likest, factor``: how far each headline repeats one of the ``back`` batches before its own; without any, 0 and no penalty.

    The likest is exact, however small. Batches lie in spans, spans are cut into blocks of about ``BLOCK`` rows, and each
    pair of blocks that can hold a batch and one before it is a group of its own, in which shared words are counted by
    an inverted index (:func:`_likest_in`). Only rows are shuffled, not pairs; words are compared by 64-bit hashes.
    """
    width = max(1, back // 3)
    reach = -(-back // width)
    own = rows.filter(F.col(batch).isNotNull() & (F.size(words) > 0)).select(
        F.col(key).alias("k"), F.col(batch).cast("int").alias("b"), F.transform(words, lambda w: F.xxhash64(w)).alias("h"), F.floor(F.col(batch) / width).cast("int").alias("span")
    )
    parts = own.groupBy("span").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    own = own.join(parts, "span").withColumn("part", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int")).drop("parts")
    there = parts.select(F.col("span").alias("other"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other_part"))
    met = lambda lo, hi: own.withColumn("other", F.explode(F.sequence(F.col("span") + lo, F.col("span") + hi))).join(there, "other")
    new = met(-reach, 0).select("k", "b", "h", F.lit(False).alias("old"), "span", "part", "other", "other_part")
    old = met(0, reach).select("k", "b", "h", F.lit(True).alias("old"), F.col("other").alias("span"), F.col("other_part").alias("part"), F.col("span").alias("other"), F.col("part").alias("other_part"))
    kind = rows.schema[key].dataType.simpleString()
    found = new.unionByName(old).groupBy("span", "part", "other", "other_part").applyInPandas(lambda pdf: _likest_in(pdf, back), f"k {kind}, likest double")
    likest = found.groupBy("k").agg(F.max("likest").alias("likest"))
    out = rows.select(F.col(key).alias("k")).join(likest, "k", "left").select(F.col("k").alias(key), F.coalesce("likest", F.lit(0.0)).alias("likest"))
    return out.withColumn("factor", F.when(F.col("likest") >= least, 1 - factor * F.col("likest")).otherwise(1.0))


def _likest_in(pdf: pd.DataFrame, back: int) -> pd.DataFrame:
    """``k, likest`` of the new rows of a group that share a word with an old one at most ``back`` batches before."""
    size = np.fromiter(map(len, pdf["h"]), np.int64, len(pdf))
    _, word = np.unique(np.concatenate(pdf["h"].to_numpy()), return_inverse=True)
    is_old = pdf["old"].to_numpy(bool)
    in_old = np.repeat(is_old, size)
    n_new, n_old = int((~is_old).sum()), int(is_old.sum())
    batch, k = pdf["b"].to_numpy(), pdf["k"].to_numpy()[~is_old]
    new_size, old_size, new_batch, old_batch = size[~is_old], size[is_old], batch[~is_old], batch[is_old]
    best = np.zeros(n_new)
    if n_new and n_old:
        # the old rows of each word, one after the other
        words = int(word.max()) + 1
        held = word[in_old]
        postings = np.repeat(np.arange(n_old), old_size)[np.argsort(held, kind="stable")]
        times = np.bincount(held, minlength=words)
        first = np.cumsum(times) - times
        asked, row = word[~in_old], np.repeat(np.arange(n_new), new_size)
        whole = new_batch.min() - old_batch.max() >= 1 and new_batch.max() - old_batch.min() <= back
        upto = np.cumsum(np.bincount(row, weights=times[asked], minlength=n_new))
        edges = np.unique(np.r_[0, np.searchsorted(upto, np.arange(PAIRS, upto[-1], PAIRS)), n_new])
        for lo, hi in zip(edges[:-1], edges[1:]):
            mine = slice(*np.searchsorted(row, (lo, hi)))
            n = times[asked[mine]]
            total = int(n.sum())
            at = np.arange(total) + np.repeat(first[asked[mine]] - (np.cumsum(n) - n), n)
            x, y = np.repeat(row[mine], n), postings[at]
            if not whole:
                ago = new_batch[x] - old_batch[y]
                inside = (ago >= 1) & (ago <= back)
                x, y = x[inside], y[inside]
            if not len(x):
                continue
            pair = (x - lo) * n_old + y
            pair = pair.astype(np.int32) if (hi - lo) * n_old < 1 << 31 else pair
            pair.sort()
            head = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
            shared = np.diff(np.r_[head, len(pair)])
            x, y = pair[head] // n_old + lo, pair[head] % n_old
            like = shared / (new_size[x] + old_size[y] - shared)
            start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
            best[x[start]] = np.maximum.reduceat(like, start)
    hit = best > 0
    return pd.DataFrame({"k": k[hit], "likest": best[hit]})


def diversified_top(rows: DataFrame, group: list[str], order: list[Column], caps: dict[str, int], top: int, then: int) -> DataFrame:
    """``featured`` (within caps per column value, then filled without caps), ``watch`` (the next ones) and nothing else, per group.

    The scan is a fold in order inside one expression. It needs few rows of a group: of rows that agree in all capped
    columns only the first ``min(caps)`` can pass (a later one meets the same counts or larger ones), and what is filled
    without caps lies among the first ``2 * top + then``.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    same = Window.partitionBy(*group, *caps).orderBy(*order)
    ranked = rows.withColumns({"_pos": F.row_number().over(w), "_nth": F.row_number().over(same)})
    ranked = ranked.filter((F.col("_nth") <= min(caps.values())) | (F.col("_pos") <= 2 * top + then)).drop("_nth")
    fields = ["_pos", *caps]
    packed = ranked.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_all"))
    empty = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<int>").alias("taken"), *[empty.alias(f"s_{c}") for c in caps])

    def equals(value: Column):  # noqa: ANN202
        return lambda v: v == value

    def admit(acc: Column, x: Column) -> Column:
        room = F.size(acc["taken"]) < top
        for c, cap in caps.items():
            room = room & (F.size(F.filter(acc[f"s_{c}"], equals(x[c].cast("string")))) < cap)
        grown = F.struct(F.concat(acc["taken"], F.array(x["_pos"])).alias("taken"), *[F.concat(acc[f"s_{c}"], F.array(x[c].cast("string"))).alias(f"s_{c}") for c in caps])
        return F.when(room, grown).otherwise(acc)

    taken = F.aggregate("_all", start, admit)["taken"]
    sets = packed.select(*group, taken.alias("_first"), F.transform("_all", lambda x: x["_pos"]).alias("_pos_all"))
    rest = F.array_except("_pos_all", "_first")
    sets = sets.withColumn("_featured", F.concat("_first", F.slice(rest, F.lit(1), F.greatest(F.lit(0), top - F.size("_first")))))
    sets = sets.withColumn("_watch", F.slice(F.array_except("_pos_all", "_featured"), 1, then)).drop("_first", "_pos_all")
    out = ranked.join(sets, group)
    label = F.when(F.array_contains("_featured", F.col("_pos")), "featured").when(F.array_contains("_watch", F.col("_pos")), "watch")
    return out.withColumn("pick", label).filter("pick is not null").drop("_featured", "_watch", "_pos")


def capped_sections(rows: DataFrame, group: list[str], section: str, order: list[Column], per_section: int, total: int, section_rank: Column) -> DataFrame:
    """Per group the best ``per_section`` of each section, at most ``total`` in all of them, sections in a fixed order."""
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*group, section).orderBy(*order))).filter(F.col("_rn") <= per_section)
    return ranked.withColumn("_all", F.row_number().over(Window.partitionBy(*group).orderBy(section_rank, "_rn"))).filter(F.col("_all") <= total).drop("_all").withColumnRenamed("_rn", "place")


def greedy_title_dedup(rows: DataFrame, group: str, order: str, title: str, least: float = 0.55, contained: float = 0.8) -> DataFrame:
    """Keeps a row unless its title is like that of a kept earlier row of its group; ``kept`` tells."""
    gone = _first_seeds(rows, group, order, title, least, contained).select(order, F.lit(1).alias("_gone"))
    return rows.join(gone, order, "left").withColumn("kept", F.col("_gone").isNull()).drop("_gone")


def seed_clusters(rows: DataFrame, group: str, order: str, title: str, least: float = 0.55, contained: float = 0.8) -> DataFrame:
    """Greedy clustering: in order, a row joins the first seed of its group that its title is like, or becomes a seed; ``seed`` tells."""
    first = _first_seeds(rows, group, order, title, least, contained)
    return rows.join(first, order, "left").withColumn("seed", F.coalesce("_seed", order)).drop("_seed")


def _first_seeds(rows: DataFrame, group: str, order: str, title: str, least: float, contained: float) -> DataFrame:
    """``order, _seed``: for each row whose title is like that of a kept earlier row of its group, the first such row.

    Each group is scanned by itself, so that only its rows are shuffled, never pairs of rows that may be of any group.
    """
    keyed = rows.select(F.col(group).alias("g"), F.col(order).alias("v"), F.array_join(text.significant_words(F.col(title)), " ").alias("w")).filter("g is not null and v is not null")
    tasks = rows.select(group).distinct().count()
    kind = rows.schema[order].dataType.simpleString()
    scan = lambda pdf: _seeds_in(pdf, least, contained)
    found = keyed.filter("instr(w, ' ') > 0").repartition(min(max(1, tasks), 4096), "g").groupBy("g").applyInPandas(scan, f"v {kind}, s {kind}")
    return found.select(F.col("v").alias(order), F.col("s").alias("_seed"))


def _seeds_in(pdf: pd.DataFrame, least: float, contained: float) -> pd.DataFrame:
    """``v, s`` of :func:`_first_seeds` for one group."""
    pdf = pdf.sort_values("v", kind="stable")
    v = pdf["v"].to_numpy()
    # a row with the words of an earlier one is like all that one is like: it follows it, or what it follows
    first = np.flatnonzero(~pdf["w"].duplicated().to_numpy())
    at = {w: k for k, w in enumerate(pdf["w"].to_numpy()[first])}
    which = np.fromiter((at[w] for w in pdf["w"]), np.int64, len(pdf))
    a, b = _like_in([w.split() for w in at], least, contained)
    seed = np.full(len(first), -1)
    order = np.lexsort((a, b))
    for x, y in zip(a[order].tolist(), b[order].tolist()):
        if seed[y] < 0 and seed[x] < 0:
            seed[y] = x
    target = np.where(seed < 0, np.arange(len(first)), seed)[which]
    joins = first[target] != np.arange(len(pdf))
    return pd.DataFrame({"v": v[joins], "s": v[first[target[joins]]]})


def _like_in(sets: list[list[str]], least: float, contained: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``a < b`` of word sets at least ``least`` alike or one ``contained`` in the other, by places in the list.

    Words are ranked by rarity. Two sets that are alike share at least ``least`` of the larger one, so that the rarest
    words of both meet; of a contained pair the rarest words of the smaller meet any of the larger (prefix filters).
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    _, word, times = np.unique(np.array([w for s in sets for w in s]), return_inverse=True, return_counts=True)
    rank = np.empty(len(times), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(times))
    row, word = np.repeat(np.arange(len(sets)), size), rank[word]
    order = np.lexsort((word, row))
    word = word[order]
    start = np.cumsum(size) - size
    nth = np.arange(len(row)) - start[row]
    prefix = lambda share: nth <= (size - np.ceil(share * size - 1e-9))[row]
    found = []
    for alike, asked, held in ((True, prefix(least), prefix(least)), (False, prefix(contained), np.ones(len(row), bool))):
        rows_of, words_of = row[held], word[held]
        by = np.argsort(words_of, kind="stable")
        postings, n = rows_of[by], np.bincount(words_of, minlength=len(times))
        begin = np.cumsum(n) - n
        x, w = row[asked], word[asked]
        upto = np.cumsum(n[w])
        edges = np.unique(np.r_[0, np.searchsorted(upto, np.arange(PAIRS, upto[-1], PAIRS)), len(w)]) if len(w) else [0]
        for lo, hi in zip(edges[:-1], edges[1:]):
            m = n[w[lo:hi]]
            at = np.arange(m.sum()) + np.repeat(begin[w[lo:hi]] - (np.cumsum(m) - m), m)
            p, q = np.repeat(x[lo:hi], m), postings[at]
            near = (p < q) & (np.minimum(size[p], size[q]) >= least * np.maximum(size[p], size[q]) - 1e-9) if alike else (p != q) & (size[p] <= size[q])
            p, q = p[near], q[near]
            pair = np.unique(np.minimum(p, q) * len(sets) + np.maximum(p, q))
            p, q = pair // len(sets), pair % len(sets)
            shared = _shared(word, start, size, p, q)
            like = (shared / (size[p] + size[q] - shared) >= least) | (shared / np.minimum(size[p], size[q]) >= contained)
            found.append(pair[like])
    pair = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pair // len(sets), pair % len(sets)


def _shared(word: np.ndarray, start: np.ndarray, size: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many words the rows of each pair share; the words of row r are ``word[start[r]:]``, ascending, ``size[r]`` of them."""
    key = np.repeat(np.arange(len(size)), size) * (int(word.max()) + 1) + word  # ascending: rows, then words
    out = np.zeros(len(p), np.int64)
    small, large = np.where(size[p] <= size[q], p, q), np.where(size[p] <= size[q], q, p)
    for k in range(int(size[small].max()) if len(p) else 0):
        on = np.flatnonzero(size[small] > k)
        asked = large[on] * (int(word.max()) + 1) + word[start[small[on]] + k]
        at = np.minimum(np.searchsorted(key, asked), len(key) - 1)
        out[on] += key[at] == asked
    return out


def near_titles(rows: DataFrame, key: str, group: str, title: str, least: float, apart: int = 0, barred: Column | None = None) -> DataFrame:
    """``a, b, ratio`` of titles of one group (or of groups ``apart``) whose Ratcliff-Obershelp ratio is at least ``least``.

    Every pair is looked at, whatever words it has: groups are cut into blocks of about ``NEAR`` rows, each pair of blocks that
    meets is a group of its own, and in it the pairs that cannot reach the ratio are ruled out by exact bounds
    (:func:`sequences.may_be_alike`). Only rows are shuffled, not pairs. ``barred``: rows of which no two are paired.
    """
    base = rows.select(F.col(key).alias("v"), F.col(group).alias("g"), F.lower(F.trim(title)).alias("t"), (F.coalesce(barred, F.lit(False)) if barred is not None else F.lit(False)).alias("x"))
    base = base.filter("v is not null and g is not null and t <> ''")
    parts = bounded(rows.filter(F.col(group).isNotNull()).groupBy(F.col(group).alias("g")).agg(F.ceil(F.count("*") / NEAR).cast("int").alias("parts")))
    tasks = parts.agg(F.sum(F.col("parts") * F.col("parts"))).first()[0] or 1
    own = base.join(parts, "g").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    if apart:
        there = parts.select((F.col("g") - apart).alias("g"), F.col("parts").alias("n"))
        left = own.join(there, "g").select("v", "t", "x", "g", F.col("part").alias("p"), others("n").alias("q"), F.lit(True).alias("first"))
        here = parts.select((F.col("g") + apart).alias("g"), F.col("parts").alias("n"))
        right = own.join(here, "g").select("v", "t", "x", (F.col("g") - apart).alias("g"), others("n").alias("p"), F.col("part").alias("q"), F.lit(False).alias("first"))
        met = left.unionByName(right)
    else:
        met = own.withColumn("o", others("parts")).select("v", "t", "x", "g", F.least("part", "o").alias("p"), F.greatest("part", "o").alias("q"), (F.col("part") <= F.col("o")).alias("first"))
    kind = rows.schema[key].dataType.simpleString()
    near = lambda block, pdf: _near_in(pdf, least, apart, apart == 0 and block[1] == block[2])
    return met.repartition(min(int(tasks), 4096), "g", "p", "q").groupBy("g", "p", "q").applyInPandas(near, f"a {kind}, b {kind}, ratio double")


def _near_in(pdf: pd.DataFrame, least: float, apart: int, same: bool) -> pd.DataFrame:
    """``a, b, ratio`` of the pairs of a block with itself or of the ``first`` rows with the others; in one group ``a`` is before ``b``."""
    first = pdf["first"].to_numpy(bool)
    left, right = np.flatnonzero(first), np.flatnonzero(first if same else ~first)
    v, t, x = pdf["v"].to_numpy(), pdf["t"].to_numpy(), pdf["x"].to_numpy(bool)
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(left) and len(right):
        found = list(sequences.may_be_alike(list(t[left]), None if same else list(t[right]), least))
        a, b = (np.concatenate([a, *(side[f[k]] for f in found)]) for k, side in enumerate((left, right)))
    if not apart:
        a, b = np.where(v[a] > v[b], b, a), np.where(v[a] > v[b], a, b)
    open_ = (v[a] != v[b]) & ~(x[a] & x[b])
    a, b = a[open_], b[open_]
    order = np.argsort(b, kind="stable")
    a, b = a[order], b[order]
    ratio = sequences.ratios(t[a], t[b], least)
    hit = ratio >= least
    return pd.DataFrame({"a": v[a[hit]], "b": v[b[hit]], "ratio": ratio[hit]})
