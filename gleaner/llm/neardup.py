"""Problem 2: near-duplicate records with small edits, by a multi-index Hamming join.

Every text is summarised by a signature of ``SYMBOLS`` symbols: its 5-character substrings are spread over as many bins by
hash and each bin keeps its minimum (one-permutation weighted minwise hashing, so that two texts agree in a symbol with a
probability near their likeness). Frequent substrings get little weight, by counts over the whole table in a hashed sketch
of fixed size; otherwise texts would agree on the phrases that everyone uses.

The Hamming join splits signatures into ``CHUNKS`` chunks. Of two signatures that differ in at most ``DISTANCE`` symbols
some chunk has at most ``DISTANCE // CHUNKS`` errors (pigeonhole), so that enumerating the allowed chunk errors (a key for
each choice of symbols left out) and joining on equal keys finds every such pair. Within a key the compact signatures
(``BITS`` bits a symbol, packed into a long and the low bits of the key) are compared before a pair leaves the kernel, and the exact likeness of the
texts decides. Equal texts form one class, found by hash; pairs are sought between classes only and expanded at the end.

At scale: one pass for the counts (those of the residue exemplars are taken along), one for signatures; 25 key rows of three
longs a text are shuffled once; texts are fetched by the number of one row of their class and shuffled once. Copies of a text
collapse map-side. Keys that more than a 128th of all rows hold are known before the shuffle (counted within each batch, added
up; at most ``HOT`` a column) and refined there by a second pigeonhole over the other chunks, so that a hot key costs 40 rows a
text and no task gathers it. What is still hot then, and a key with more than ``RUN`` classes in its task, is cut into blocks
whose pairs are spread over the cluster; nothing is capped. Classes of copies are cut into blocks the same way when pairs are
expanded.

Defined results: rows with a null or blank title or summary and residue rows take no part; texts without a 5-character
substring are alike only to equal ones; repeated rows are copies; an empty table gives no pairs; more columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.residue import EVERY, ExemplarIndex, Vocabulary, count_fields, vocabulary_parts, weights_of
from gleaner.llm.shingles import mix, shingle_buckets, shingle_hashes
from gleaner.tables import cut_lineage, spread

SYMBOLS, CHUNKS, DISTANCE, BITS, COMPACT_DISTANCE = 25, 5, 9, 3, 12
SKETCH_BITS, SKETCH_PARTS, RUN, HOT, COPIES = 18, 16, 2048, 256, 4096
K = 5


def comparable_text(title: str | None, summary: str | None) -> str | None:
    """Title, a space and summary in lower case, white space runs made one space, trimmed; None if either is blank."""
    if not title or not summary or title.isspace() or summary.isspace():
        return None
    return " ".join(f"{title} {summary}".lower().split())


def corpus_counts(items: DataFrame) -> tuple[np.ndarray, int, dict[str, int]]:
    """Counts of hashed substrings over all comparable texts, the number of these texts, and the field counts of the residue exemplars' tokens.

    One pass; 2**18 counters and the exemplars' tokens, whatever the size of the table.
    """
    parts = [*vocabulary_parts(), EVERY]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((1 << SKETCH_BITS) + 1, np.int64)
        n = 0
        words = Vocabulary(frozenset(parts))
        fields = dict.fromkeys(parts, 0)
        for pdf in batches:
            titles, summaries = pdf["title"].array, pdf["summary"].array
            for column in (titles, summaries):
                for token, k in count_fields(column, words).items():
                    fields[token] += k
            texts = [x for x in map(comparable_text, titles, summaries) if x]
            n += len(texts)
            total += np.bincount(shingle_buckets(texts, K, SKETCH_BITS), minlength=len(total))
        if fields[EVERY]:
            counts = [*np.split(total[:-1], SKETCH_PARTS), np.array([fields[p] for p in parts], np.int64)]
            yield pd.DataFrame({"part": range(len(counts)), "salt": int(total.sum() % 32), "n": n, "counts": [c.tobytes() for c in counts]})

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(b, np.int64) for b in pdf["counts"]], axis=0)
        return pd.DataFrame({"part": [key[0]], "salt": [0], "n": [pdf["n"].sum()], "counts": [total.tobytes()]})

    schema = "part int, salt int, n bigint, counts binary"
    partial = spread(items.select("title", "summary")).mapInPandas(count, schema).groupBy("part", "salt").applyInPandas(add, schema)
    rows = {r["part"]: r for r in partial.groupBy("part").applyInPandas(add, schema).collect()}  # 17 rows of 128 KB
    if not rows:
        return np.zeros(1 << SKETCH_BITS, np.int64), 0, {}
    sketch = np.concatenate([np.frombuffer(rows[i]["counts"], np.int64) for i in range(SKETCH_PARTS)])
    return sketch, rows[0]["n"], dict(zip(parts, np.frombuffer(rows[SKETCH_PARTS]["counts"], np.int64).tolist()))


def substring_weights(sketch: np.ndarray, texts: int) -> np.ndarray:
    """Weight of each counter: the log of its rarity, never quite zero."""
    return (np.maximum(np.log((texts + 1) / (sketch + 1.0)), 0.05)).astype(np.float32)


def signatures(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """A row of ``SYMBOLS`` symbols (32-bit hashes) for every text."""
    n = len(texts)
    doc, h = shingle_hashes(texts, K)
    out = np.full(n * SYMBOLS, -1, np.int64)
    if len(doc):
        bucket = (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
        u = ((h & np.uint64(0xFFFFFF)).astype(np.float32) + 0.5) / np.float32(1 << 24)
        rank = (-np.log(u) / weights[bucket] * np.float32(1 << 16)).astype(np.int64)
        np.minimum(rank, (1 << 30) - 1, out=rank)
        bins = ((h >> np.uint64(24)) % np.uint64(SYMBOLS)).astype(np.int64)
        # the rank in the middle, some hash bits below it to tell equal ranks apart
        key = ((doc * SYMBOLS + bins) << 42) | (rank << 12) | ((h >> np.uint64(32)) & np.uint64(0xFFF)).astype(np.int64)
        key.sort()
        slot = key >> 42
        head = np.empty(len(slot), bool)
        head[0] = True
        np.not_equal(slot[1:], slot[:-1], out=head[1:])
        out[slot[head]] = key[head] & ((1 << 42) - 1)
    sig = out.reshape(n, SYMBOLS)
    # an empty bin borrows from the next filled one, marked by the distance
    filled = sig.copy()
    for step in range(1, SYMBOLS):
        if not (filled < 0).any():
            break
        moved = np.roll(sig, -step, axis=1)
        take = (filled < 0) & (moved >= 0)
        filled[take] = moved[take] + (step << 43)
    return (mix(filled.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """The join keys of every signature: for each chunk and each choice of symbols left out as allowed errors."""
    width = SYMBOLS // CHUNKS
    errors = DISTANCE // CHUNKS
    keys = []
    for c in range(CHUNKS):
        for left_out in combinations(range(width), errors):
            h = np.full(len(sig), (c * 1009 + 17 * sum(1 << j for j in left_out)) & 0xFFFFFFFF, np.uint64)
            for j in range(width):
                if j not in left_out:
                    h *= np.uint64(0x9E3779B97F4A7C15)
                    h += sig[:, c * width + j].astype(np.uint64)
                    mix(h)
            keys.append(h.view(np.int64))
    return np.stack(keys, 1)


def refined_keys(key: np.ndarray, sig: np.ndarray, chunk: int) -> np.ndarray:
    """Keys for rows that share the hot ``key`` of ``chunk``: one for each other chunk and each choice of symbols left out.

    Of at most ``DISTANCE`` errors some other chunk has at most ``DISTANCE // (CHUNKS - 1)``: no pair within the distance is lost.
    """
    width = SYMBOLS // CHUNKS
    keys = []
    for c in range(CHUNKS):
        if c != chunk:
            for left_out in combinations(range(width), DISTANCE // (CHUNKS - 1)):
                h = key.view(np.uint64) + np.uint64(c * 1009 + 17 * sum(1 << j for j in left_out) + 5)
                for j in range(width):
                    if j not in left_out:
                        h = h * np.uint64(0x9E3779B97F4A7C15) + sig[:, c * width + j].astype(np.uint64)
                        mix(h)
                keys.append(h.view(np.int64))
    return np.stack(keys, 1)


def heavy_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys (any shape, rows first) that at least a ``HOT``-th of the rows hold, and their counts."""
    found, n = np.unique(keys, return_counts=True)
    at = n >= max(2, len(keys) / HOT)
    return found[at], n[at]


LOW = 64 // BITS  # symbols in the long
KEY_BITS = 64 - (SYMBOLS - LOW) * BITS  # of the key itself; the other symbols lie below


def compact(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``BITS`` bits of every symbol: the first ``LOW`` symbols in one long, the rest in the low bits of another."""
    bits = (sig >> np.uint32(4)).astype(np.uint64) & np.uint64((1 << BITS) - 1)
    low, rest = np.zeros(len(sig), np.uint64), np.zeros(len(sig), np.uint64)
    for j in range(SYMBOLS):
        if j < LOW:
            low |= bits[:, j] << np.uint64(j * BITS)
        else:
            rest |= bits[:, j] << np.uint64((j - LOW) * BITS)
    return low.view(np.int64), rest


def _differing(x: np.ndarray, symbols: int) -> np.ndarray:
    folded = x.copy()
    for j in range(1, BITS):
        folded |= x >> np.uint64(j)
    return np.bitwise_count(folded & np.uint64(sum(1 << (j * BITS) for j in range(symbols))))


def compact_distance(key_a: np.ndarray, a: np.ndarray, key_b: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of symbols in which the compact signatures of key rows differ."""
    return _differing(a.view(np.uint64) ^ b.view(np.uint64), LOW) + _differing(key_a.view(np.uint64) ^ key_b.view(np.uint64), SYMBOLS - LOW)


def _pairs_of_runs(key: np.ndarray, d: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs within runs of equal keys (arrays sorted by key and d, without repeats) whose compact signatures are near; rows of overlong runs."""
    n = len(key)
    own = key >> (64 - KEY_BITS)
    edge = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True])
    size = np.diff(edge)
    over = np.repeat(size > RUN, size)
    length = np.repeat(np.where(size > RUN, 0, size), size)
    end = np.repeat(edge[1:], size)
    a_out, b_out = [], []
    for step in range(1, int(length.max(initial=0))):
        i = np.flatnonzero((np.arange(n) + step < end) & (length > step)) if step == 1 else i[i + step < end[i]]
        if not len(i):
            break
        i_near = i[compact_distance(key[i], s[i], key[i + step], s[i + step]) <= COMPACT_DISTANCE]
        a_out.append(np.minimum(d[i_near], d[i_near + step]))
        b_out.append(np.maximum(d[i_near], d[i_near + step]))
    none = np.empty(0, np.int64)
    return np.concatenate(a_out or [none]), np.concatenate(b_out or [none]), np.flatnonzero(over)


def _unique_rows(key: np.ndarray, d: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((d, key))
    key, d, s = key[order], d[order], s[order]
    keep = np.r_[True, (key[1:] != key[:-1]) | (d[1:] != d[:-1])] if len(key) else np.empty(0, bool)
    return key[keep], d[keep], s[keep]


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.empty(0, bool)
    return a[keep], b[keep]


def in_blocks(key: np.ndarray, d: np.ndarray, s: np.ndarray, parts: int) -> pd.DataFrame:
    """``part, rows``: the key rows of each target partition as one block of bytes, so that the shuffle moves blocks, not rows."""
    part = ((key.view(np.uint64) >> np.uint64(64 - KEY_BITS)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    rows = np.stack((key[order], d[order], s[order]), 1)
    edge = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0, True]) if len(part) else np.zeros(1, int)
    return pd.DataFrame({"part": part[order][edge[:-1]], "rows": [rows[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])]})


OVER = -1  # the part of key rows that are cut into blocks at once


def hamming_pairs(blocks: DataFrame, parts: int) -> DataFrame:
    """``a < b`` of classes near in signature, from the blocks of :func:`in_blocks`: equal-key runs are paired where they lie after one shuffle."""
    lowest = int(np.iinfo(np.int64).min)

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for pdf in batches:
            over = pdf["part"].to_numpy() == OVER
            held += pdf["rows"][~over].tolist()
            for block in pdf["rows"][over]:
                key, d, s = np.frombuffer(block, np.int64).reshape(-1, 3).T
                yield pd.DataFrame({"key": key, "a": d, "b": lowest, "s": s})
        rows = np.frombuffer(b"".join(held), np.int64).reshape(-1, 3)
        key, d, s = _unique_rows(*rows.T)
        a, b, over = _pairs_of_runs(key, d, s)
        a, b = _distinct_pairs(a, b)
        yield pd.DataFrame({"key": 0, "a": a, "b": b, "s": 0})
        if len(over):
            yield pd.DataFrame({"key": key[over], "a": d[over], "b": lowest, "s": s[over]})

    # blocks that are only passed on go anywhere
    target = F.when(F.col("part") == OVER, F.pmod(F.xxhash64("rows"), F.lit(parts)).cast("int")).otherwise(F.col("part"))
    placed = blocks.withColumn("target", target).repartitionById(parts, "target").select("part", "rows")
    found = cut_lineage(placed.mapInPandas(pair, "key bigint, a bigint, b bigint, s bigint"))
    pairs = found.filter(F.col("b") != lowest).select("a", "b").distinct()
    over = found.filter(F.col("b") == lowest).select("key", F.col("a").alias("d"), "s").distinct()
    if over.limit(1).count():
        pairs = pairs.union(_block_pairs(over)).distinct()
    return pairs


def _block_pairs(over: DataFrame) -> DataFrame:
    """The pairs of overlong runs: rows are hashed into blocks of about ``RUN`` and every pair of blocks is a group of its own."""
    over = over.withColumn("own", F.shiftright("key", 64 - KEY_BITS))
    sizes = over.groupBy("own").agg(F.ceil(F.count("*") / RUN).cast("int").alias("blocks"))
    rows = over.join(sizes, "own").withColumn("block", F.pmod(F.xxhash64("d"), F.col("blocks")).cast("int"))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("own", "key", "d", "s", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = pdf["lo"].iat[0], pdf["hi"].iat[0]
        left = pdf[pdf["block"] == lo]
        right = left if lo == hi else pdf[pdf["block"] == hi]
        key, d, s = (right[c].to_numpy() for c in ("key", "d", "s"))
        a, b = [], []
        for k, x, y in zip(*(left[c].to_numpy() for c in ("key", "d", "s"))):
            near = (compact_distance(np.full(len(s), k), np.full(len(s), y), key, s) <= COMPACT_DISTANCE) & ((d > x) if lo == hi else (d != x))
            a.append(np.minimum(x, d[near]))
            b.append(np.maximum(x, d[near]))
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return met.groupBy("own", "lo", "hi").applyInPandas(pair, "a bigint, b bigint")


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """Jaccard likeness of the sets of 5-character substrings, pair by pair."""
    sides = []
    for texts in (a, b):
        doc, h = shingle_hashes(texts, K)
        x = (doc << 44) | (h >> np.uint64(20)).astype(np.int64)
        x.sort()
        sides.append(x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x)
    n = len(a)
    each = [np.bincount(x >> 44, minlength=n) for x in sides]
    both = np.concatenate(sides)
    both.sort()
    shared = np.bincount(both[1:][both[1:] == both[:-1]] >> 44, minlength=n)
    union = each[0] + each[1] - shared
    return np.where(union > 0, shared / np.maximum(union, 1), 0.0)


def near_classes(items: DataFrame, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """``members`` (``item_id, d``) and ``pairs`` (``a, b, likeness``) of the classes of equal texts that are alike; residue rows are left out."""
    spark = items.sparkSession
    rows = items.filter("item_id is not null and title is not null and summary is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "title", "summary")
    sketch, n_texts, fields = corpus_counts(items)
    residue = ExemplarIndex(weights_of(fields))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast((substring_weights(sketch, n_texts), residue))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, residue = shared.value
        for pdf in batches:
            ids, hashes, texts, seen, new = [], [], [], set(), []
            for item, title, summary in zip(pdf["item_id"].array, pdf["title"].array, pdf["summary"].array):
                text = comparable_text(title, summary)
                if text is None or residue.holds(title, True) or residue.holds(summary, False):
                    continue
                d = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)
                new.append(d not in seen)  # copies within a batch need their signature once
                if new[-1]:
                    seen.add(d)
                    texts.append(text)
                ids.append(item)
                hashes.append(d)
            sig = signatures(texts, weights)
            out = pd.Series([None] * len(ids), dtype="object")
            out[np.flatnonzero(new)] = [x.tobytes() for x in sig]
            yield pd.DataFrame({"item_id": pd.Series(ids, dtype="int64"), "d": pd.Series(hashes, dtype="int64"), "sig": out})
            # the keys that are frequent here, with their counts, travel as rows without an item
            hot, n = heavy_keys(k := chunk_keys(sig))
            again = [(refined_keys(k[at, j], sig[at], j // (k.shape[1] // CHUNKS)), len(sig)) for j in range(k.shape[1]) if len(at := np.flatnonzero(np.isin(k[:, j], hot)))]
            for level, keys, counts in [(b"1", hot, n), *((b"2", *_heavy_refined(k, size)) for k, size in again)]:
                if len(keys):
                    yield pd.DataFrame({"item_id": pd.Series([None] * len(keys), dtype="Int64"), "d": keys, "sig": [level + int(c).to_bytes(8, "little") for c in counts]})

    signed = cut_lineage(spread(rows).mapInPandas(sign, "item_id bigint, d bigint, sig binary"))
    members = signed.filter("item_id is not null").select("item_id", "d")
    hot = spark.sparkContext.broadcast(hot_keys(signed.filter("item_id is null").select("d", "sig"), n_texts))

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, twice = hot.value
        for pdf in batches:
            sig = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(-1, SYMBOLS)
            low, rest = compact(sig)
            d = pdf["d"].to_numpy()
            own = lambda k, at: (k >> (64 - KEY_BITS) << (64 - KEY_BITS)) | rest[at].view(np.int64)
            k = chunk_keys(sig)
            at = np.tile(np.arange(len(sig)), (k.shape[1], 1)).T.ravel()
            flat = k.ravel()
            over = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if len(once):
                frequent = np.isin(flat, once)
                new_keys, new_at = [flat[~frequent]], [at[~frequent]]
                column = np.tile(np.arange(k.shape[1]), len(sig))[frequent]
                for j in np.unique(column):
                    i = at[frequent][column == j]
                    new_keys.append(refined_keys(k[i, j], sig[i], int(j) // (k.shape[1] // CHUNKS)).ravel())
                    new_at.append(np.repeat(i, len(new_keys[-1]) // len(i)))
                flat, at = np.concatenate(new_keys), np.concatenate(new_at)
                if len(twice):
                    frequent = np.isin(flat, twice)
                    over = flat[frequent], at[frequent]
                    flat, at = flat[~frequent], at[~frequent]
            yield in_blocks(own(flat, at), d[at], low[at], parts)
            if len(over[0]):
                block = np.stack((own(over[0], over[1]), d[over[1]], low[over[1]]), 1)
                yield pd.DataFrame({"part": [OVER], "rows": [block.tobytes()]})

    candidates = hamming_pairs(signed.filter("item_id is not null and sig is not null").select("d", "sig").mapInPandas(keys, "part int, rows binary"), parts)
    # texts come by the number of one row of the class; all rows of a class have the same text
    first = members.groupBy("d").agg(F.min("item_id").alias("item_id"))
    side = lambda s: first.select(F.col("d").alias(s), F.col("item_id").alias(f"item_{s}"))
    text = lambda s: rows.select(F.col("item_id").alias(f"item_{s}"), F.col("title").alias(f"title_{s}"), F.col("summary").alias(f"summary_{s}"))
    joined = candidates.join(side("a"), "a").join(side("b"), "b").join(text("a"), "item_a").join(text("b"), "item_b")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [list(map(comparable_text, pdf[f"title_{s}"].array, pdf[f"summary_{s}"].array)) for s in ("a", "b")]
            same = [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) == d if x else False for s, xs in zip("ab", texts) for d, x in zip(pdf[s].array, xs)]
            own = np.array(same, bool).reshape(2, -1).all(0)  # a number that several rows have gives all their texts; only that of the class counts
            a, b = pdf["a"].to_numpy()[own], pdf["b"].to_numpy()[own]
            like = likeness([x for x, k in zip(texts[0], own) if k], [x for x, k in zip(texts[1], own) if k])
            ok = like >= threshold
            yield pd.DataFrame({"a": a[ok], "b": b[ok], "likeness": like[ok]})

    pairs = joined.select("a", "b", "title_a", "summary_a", "title_b", "summary_b").mapInPandas(verify, "a bigint, b bigint, likeness double")
    return members, pairs


def _heavy_refined(keys: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    found, n = np.unique(keys, return_counts=True)
    at = n >= max(2, rows / HOT)
    return found[at], n[at]


def hot_keys(heavy: DataFrame, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys, plain and refined, that more than a 128th of the ``texts`` hold, from the counts within batches (``d``: key, ``sig``: level and count).

    A key is counted where a ``HOT``-th of a batch holds it; what is not counted is less than a ``HOT``-th of all, so that no
    such key is missed and at most ``HOT`` for each column of keys are kept.
    """

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"level": [x[:1].decode() for x in pdf["sig"]], "key": pdf["d"], "n": [int.from_bytes(x[1:9], "little") for x in pdf["sig"]]})

    total = heavy.mapInPandas(add, "level string, key bigint, n bigint").groupBy("level", "key").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(RUN, texts / HOT))
    rows = total.select("level", "key").collect()
    return tuple(np.array(sorted(r["key"] for r in rows if r["level"] == level), np.int64) for level in ("1", "2"))


def all_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``item_a < item_b`` of every two items in the same class or in classes that are alike.

    Classes are cut into blocks of about ``COPIES`` rows, so that no task meets all copies of a text.
    """
    pairs = cut_lineage(pairs)
    sizes = members.groupBy("d").agg(F.count("*").alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / COPIES).cast("int"))
    copied = cut_lineage(members.join(sizes, "d").select("item_id", "d", "blocks", F.pmod(F.xxhash64("item_id"), F.col("blocks")).cast("int").alias("block")))
    left = copied.select(F.col("item_id").alias("x"), "d", "block")
    right = copied.select(F.col("item_id").alias("y"), "d", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    same = left.join(right, ["d", "block"]).filter("x < y").select("x", "y")
    large = sizes.filter("blocks > 1").select("d", "blocks")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    rows = members.join(large, "d", "left").select("item_id", "d", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("item_id"), F.col("blocks"))).cast("int").alias("block"))
    cross = pairs.select("a", "b")
    for s in ("a", "b"):
        cross = cross.join(large.withColumnRenamed("d", s), s, "left").withColumn(f"block_{s}", every).drop("blocks")
    cross = cross.join(rows.select(F.col("item_id").alias("x"), F.col("d").alias("a"), F.col("block").alias("block_a")), ["a", "block_a"])
    cross = cross.join(rows.select(F.col("item_id").alias("y"), F.col("d").alias("b"), F.col("block").alias("block_b")), ["b", "block_b"])
    return same.union(cross.select("x", "y")).select(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"))
