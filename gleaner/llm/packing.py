"""Problem 6: filling fixed-capacity containers with documents.

A linear grouping scheme. Large lengths (above ``capacity / SMALL``) are put into ``GROUPS`` groups of equal cardinality and
rounded up to the largest of their group; configurations of the few rounded sizes are chosen one after the other by a
bounded knapsack, each used as often as the demand allows; then actual documents take the places of the rounded sizes in
order of length, and small ones go best-fit, longest first, into the space that is really left. A document longer than a
container is cut into full containers and a rest that is packed like any other; no other document is cut.

At scale: all planning works on counts by length, at most one row per possible length, so the plan depends on the capacity
and not on the number of documents. Containers in the plan are run-length coded: a run of containers that hold the same
lengths is one entry, and an entry gives the next ``n`` documents of one length to ``n`` consecutive containers. Documents
find their entry by their rank among those of equal length; ranks come from windows over (length, salt) and prefix sums of
the counts. A length has as many salts as it has ``CHUNK`` documents, so no length gathers all its documents in one task, and the
driver holds one count for each length and for each ``CHUNK`` documents. Only the plan is broadcast.

Defined results: null and empty texts take no space and are given no container; repeated documents are packed one by one;
a document of exactly the capacity fills a container; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.tables import cut_lineage, fixed_rows, spread

GROUPS, SMALL, CHUNK = 256, 6, 200_000
#: How the tokenizer of the vocabulary cuts text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counts(documents: DataFrame, vocabulary: str, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, tokens`` by a byte-level vocabulary whose file is read on the driver and broadcast (fixed in size)."""
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    shared = documents.sparkSession.sparkContext.broadcast(ranks)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": [len(encoding.encode_ordinary(t)) for t in pdf["text"].array]})

    rows = documents.filter("doc_id is not null and text is not null and text <> ''").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return spread(rows).mapInPandas(count, "doc_id bigint, tokens bigint")


def _knapsack(capacity: int, sizes: list[int], left: list[int]) -> list[int]:
    """How often to take each size so that the sum is as large as the capacity allows, from what is left of each."""
    reach = np.full(capacity + 1, -1, np.int64)  # the size index that first reached a fill
    copies = np.zeros(capacity + 1, np.int64)
    reach[0] = len(sizes)
    for i, s in enumerate(sizes):
        copies[:] = 0
        for _ in range(min(left[i], capacity // s)):
            new = np.flatnonzero((reach[s:] < 0) & (reach[:-s] >= 0) & (copies[:-s] < left[i]))
            if not len(new):
                break
            reach[new + s] = i
            copies[new + s] = copies[new] + 1
    fill = int(np.flatnonzero(reach >= 0)[-1])
    take = [0] * len(sizes)
    while fill:
        i = int(reach[fill])
        take[i] += 1
        fill -= sizes[i]
    return take


class Plan:
    """Entries ``(length, first rank, first container, count)`` and the number of containers for counts by length."""

    def __init__(self, capacity: int, counts: dict[int, int], groups: int = GROUPS, small: int = SMALL):
        self.capacity = capacity
        self.entries: list[tuple[int, int, int, int]] = []
        self.used = dict.fromkeys(counts, 0)  # documents of each length that have a place
        self.containers = 0
        self.space: dict[int, list[tuple[int, int]]] = {}  # space left -> runs (first container, count)
        large = sorted((s for s in counts if s * small > capacity), reverse=True)
        self._large(large, counts, groups)
        self._best_fit(sorted((s for s in counts if s * small <= capacity), reverse=True), counts)

    def _runs(self, queue: list[list[int]], n: int) -> list[tuple[int, int]]:
        """The next ``n`` documents of a group as runs (length, count), longest first."""
        out = []
        while n:
            s, k = queue[-1]
            take = min(k, n)
            out.append((s, take))
            n -= take
            if take == k:
                queue.pop()
            else:
                queue[-1][1] -= take
        return out

    def _large(self, lengths: list[int], counts: dict[int, int], groups: int) -> None:
        total = sum(counts[s] for s in lengths)
        if not total:
            return
        share = -(-total // groups)
        queues: list[list[list[int]]] = []
        room = 0
        for s in lengths:  # groups of equal cardinality; a length may be cut between groups
            k = counts[s]
            while k:
                if not room:
                    queues.append([])
                    room = share
                take = min(k, room)
                queues[-1].insert(0, [s, take])
                room -= take
                k -= take
        left = [sum(k for _, k in q) for q in queues]
        while any(left):
            rounded = [q[-1][0] if q else 0 for q in queues]
            live = [i for i in range(len(queues)) if left[i]]
            # the longest document left must go somewhere: fill the rest of its container as well as possible
            first = max(live, key=lambda i: rounded[i])
            rest = self.capacity - rounded[first]
            spare = [left[i] - (i == first) for i in live]
            take = dict(zip(live, _knapsack(rest, [rounded[i] for i in live], spare))) if rest else {}
            take[first] = take.get(first, 0) + 1
            times = min(left[i] // n for i, n in take.items() if n)
            fills = [(self.containers, times, 0)]
            for i, n in take.items():
                for _ in range(n):
                    left[i] -= times
                    fills = self._place(fills, self._runs(queues[i], times))
            self.containers += times
            for begin, n, filled in fills:
                self._leave(begin, n, self.capacity - filled)

    def _place(self, fills: list[tuple[int, int, int]], runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """Give the containers of ``fills`` one document each, in order; containers that hold the same stay one run."""
        out = []
        runs = runs[::-1]
        for begin, n, filled in fills:
            while n:
                s, k = runs[-1]
                take = min(n, k)
                self._enter(s, begin, take)
                out.append((begin, take, filled + s))
                begin += take
                n -= take
                if take == k:
                    runs.pop()
                else:
                    runs[-1] = (s, k - take)
        return out

    def _enter(self, length: int, container: int, n: int) -> None:
        self.entries.append((length, self.used[length], container, n))
        self.used[length] += n

    def _leave(self, begin: int, n: int, space: int) -> None:
        if space:
            self.space.setdefault(space, []).append((begin, n))

    def _best_fit(self, lengths: list[int], counts: dict[int, int]) -> None:
        for s in lengths:
            left = counts[s]
            if s <= 0:
                continue
            while left:
                fit = min((r for r in self.space if r >= s and self.space[r]), default=None)
                if fit is None:  # new containers, filled with this length as often as it goes
                    per = self.capacity // s
                    n = max(1, left // per)
                    begin, self.containers = self.containers, self.containers + n
                    each = min(per, left)
                    for _ in range(each):
                        self._enter(s, begin, n)
                    left -= each * n
                    self._leave(begin, n, self.capacity - each * s)
                    continue
                begin, n = self.space[fit].pop()
                if not self.space[fit]:
                    del self.space[fit]
                take = min(n, left)
                self._enter(s, begin, take)
                left -= take
                self._leave(begin, take, fit - s)
                if take < n:
                    self._leave(begin + take, n - take, fit)

    def table(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By length: first ranks in order and the containers they start at."""
        by: dict[int, list[tuple[int, int]]] = {}
        for s, rank, container, _ in self.entries:
            by.setdefault(s, []).append((rank, container))
        return {s: (np.array([r for r, _ in x], np.int64), np.array([c for _, c in x], np.int64)) for s, x in by.items()}


def pack(tokens: DataFrame, packs: DataFrame) -> DataFrame:
    """``pack_id, doc_id, piece, tokens, container`` for ``doc_id, tokens`` and each of the (few) ``pack_id, capacity_tokens``."""
    sizes = {r[0]: r[1] for r in fixed_rows(packs.filter("capacity_tokens > 0").select("pack_id", "capacity_tokens"), 1000, "capacities")}
    spark = tokens.sparkSession
    schema = "pack_id int, doc_id bigint, piece int, tokens bigint, container bigint"
    if not sizes:
        return spark.createDataFrame([], schema)
    tokens = cut_lineage(tokens.filter("tokens > 0"))
    dims = F.array(*[F.struct(F.lit(p).cast("int").alias("pack_id"), F.lit(c).cast("bigint").alias("capacity")) for p, c in sorted(sizes.items())])
    docs = tokens.select("*", F.inline(dims))
    docs = docs.withColumns({"full": F.floor(F.col("tokens") / F.col("capacity")).cast("bigint"), "rest": F.col("tokens") % F.col("capacity")})
    # counts by length: at most one row for each length up to the capacity, whatever the number of documents
    counts = docs.filter("rest > 0").groupBy("pack_id", "rest").agg(F.count("*").alias("n")).toPandas()
    longer = {r["pack_id"]: r["n"] for r in docs.filter("full > 0").groupBy("pack_id").agg(F.count("*").alias("n")).collect()}
    hot = counts[counts["n"] > CHUNK]
    salts = spark.createDataFrame([(int(p), int(r), -(-int(n) // CHUNK)) for p, r, n in zip(hot["pack_id"], hot["rest"], hot["n"])], "pack_id int, rest bigint, salts int")
    full_salts = F.coalesce(F.element_at(F.create_map(F.lit(-1), F.lit(1), *[F.lit(x) for p, n in longer.items() for x in (p, -(-n // CHUNK))]), F.col("pack_id")), F.lit(1))
    salted = F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("salts"))).cast("int")
    docs = docs.join(F.broadcast(salts), ["pack_id", "rest"], "left").withColumns({"salt": salted, "full_salt": F.pmod(F.xxhash64("doc_id"), full_salts).cast("int")})
    parts = docs.filter("rest > 0 and salts is not null").groupBy("pack_id", "rest", "salt").agg(F.count("*").alias("n")).toPandas() if len(hot) else None
    fulls = docs.filter("full > 0").groupBy("pack_id", "full_salt").agg(F.sum("full").alias("n")).toPandas()
    plans, offsets, full_at = {}, {}, {}
    for pack_id, capacity in sizes.items():
        own = counts[counts["pack_id"] == pack_id]
        plan = Plan(capacity, dict(zip(own["rest"].tolist(), own["n"].tolist())))
        plans[pack_id] = plan.table()
        if parts is not None:  # documents of the length under the salts before
            for rest, part in parts[parts["pack_id"] == pack_id].groupby("rest"):
                before = np.zeros(int(part["salt"].max()) + 2, np.int64)
                before[part["salt"].to_numpy() + 1] = part["n"]
                offsets[pack_id, int(rest)] = np.cumsum(before)
        f = fulls[fulls["pack_id"] == pack_id]
        start = np.zeros(max(1, -(-longer.get(pack_id, 0) // CHUNK)) + 1, np.int64)
        start[f["full_salt"].to_numpy() + 1] = f["n"]
        full_at[pack_id] = plan.containers + np.cumsum(start)
    shared = spark.sparkContext.broadcast((plans, offsets, full_at))
    in_length = Window.partitionBy("pack_id", "rest", "salt").orderBy("doc_id")
    in_salt = Window.partitionBy("pack_id", "full_salt").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rests = docs.filter("rest > 0").withColumn("rank", F.row_number().over(in_length) - 1).select("pack_id", "doc_id", "rest", "salt", "rank", "full")
    cut = docs.filter("full > 0").withColumn("before", F.coalesce(F.sum("full").over(in_salt), F.lit(0))).select("pack_id", "doc_id", "full_salt", "full", "before", "capacity")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plans, offsets, _ = shared.value
        for pdf in batches:
            container = np.zeros(len(pdf), np.int64)
            pack_ids, length = pdf["pack_id"].to_numpy(), pdf["rest"].to_numpy()
            rank = pdf["rank"].to_numpy().astype(np.int64)
            salt = pdf["salt"].to_numpy()
            for p in np.unique(pack_ids):
                at = np.flatnonzero(pack_ids == p)
                at = at[np.argsort(length[at], kind="stable")]
                for part in np.split(at, np.flatnonzero(np.diff(length[at])) + 1):
                    ranks, begins = plans[p][int(length[part[0]])]
                    before = offsets.get((int(p), int(length[part[0]])))
                    if before is not None:
                        rank[part] += before[salt[part]]
                    i = np.searchsorted(ranks, rank[part], "right") - 1
                    container[part] = begins[i] + rank[part] - ranks[i]
            yield pd.DataFrame({"pack_id": pack_ids, "doc_id": pdf["doc_id"], "piece": pdf["full"].astype("int32"), "tokens": length, "container": container})

    def place_full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        full_at = shared.value[2]
        for pdf in batches:
            n = pdf["full"].to_numpy()
            piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            begin = np.array([full_at[p][s] for p, s in zip(pdf["pack_id"], pdf["full_salt"])], np.int64) + pdf["before"].to_numpy()
            yield pd.DataFrame({"pack_id": np.repeat(pdf["pack_id"].to_numpy(), n), "doc_id": np.repeat(pdf["doc_id"].to_numpy(), n), "piece": piece.astype("int32"), "tokens": np.repeat(pdf["capacity"].to_numpy(), n), "container": np.repeat(begin, n) + piece})

    return rests.mapInPandas(place, schema).union(cut.mapInPandas(place_full, schema))
