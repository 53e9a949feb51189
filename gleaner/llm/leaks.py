"""Problem 7: evaluation passages inside the corpus, by an FM-index per shard of the corpus.

The corpus is cut into shards of about ``SHARD`` words as it streams through the executors. Each shard gets an FM-index over
its words (those of the passages by number, all others one symbol): the Burrows-Wheeler transform from a suffix array by
prefix doubling, ranks from a wavelet matrix, and suffix positions sampled every ``EVERY`` words. The probe phrases, word
triples of the passages, are found by backward search, all at once, and located through the sampled positions. A triple that
more than ``SHARED`` passages hold is left out only where every half of its passage keeps enough others. Where as many probes lie
close together as an unbroken half of the passage holds (``HITS`` at most) the passage is aligned exactly: runs of equal words are
chained in the order of both texts, over small gaps and one larger break, and the words of the best chain are counted.

The stretches of text that the chains cover are the removal spans; :func:`removal_spans` gives them in characters, overlapping
ones merged, with the items found in each.

Only the passages (fixed in size) are broadcast. A probe is located wherever it occurs, however often, so a passage that a
third of all documents hold is found in each of them. Equal texts within a shard are indexed once.

Defined results: null and empty texts and passages give no row; passages of fewer than three words are not searched, those of
fewer than six by the longest phrase that half of them holds; repeated documents each give theirs; texts of any length are read
whole; an empty table gives an empty result; further columns are ignored. A leak made of single words and pairs only, without
``HITS`` triples, is not found.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.tables import fixed_rows, spread

SHARD, EVERY, SHARED, PROBE, HITS = 400_000, 8, 2, 3, 4
GAP, BREAK, LEAST = 6, 200, 0.5

_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Words in lower case; markup, punctuation, spacing, soft hyphens and zero-width characters leave no trace."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        for c in "\u00ad\u200b\u200c\u200d\ufeff":
            if c in text:
                text = text.replace(c, "")
    return _WORD.findall(text.lower())


class FMIndex:
    """Backward search and location of word phrases in one shard. Symbols are 1..sigma-1; 0 ends the text."""

    def __init__(self, symbols: np.ndarray, sigma: int, every: int = EVERY):
        text = np.append(symbols, 0).astype(np.int64)
        self.n, self.sigma = len(text), sigma
        sa = self._suffix_array(text)
        bwt = text[sa - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.bits = max(1, int(sigma - 1).bit_length())
        # wavelet matrix: per level the prefix counts of ones and the number of zeros
        self.ones, self.zeros = [], []
        level = bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(self.n - int(self.ones[-1][-1]))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        self.bwt = bwt.astype(np.int32)
        held = sa % every == 0
        self.held = np.concatenate([[0], np.cumsum(held)]).astype(np.int32)
        self.samples = sa[held].astype(np.int32)
        self.start = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))

    @staticmethod
    def _suffix_array(text: np.ndarray) -> np.ndarray:
        n = len(text)
        width = int(text.max()).bit_length() or 1
        depth = max(1, 62 // width)
        key = text.copy()
        padded = np.concatenate([text, np.zeros(depth, np.int64)])
        for j in range(1, depth):
            key = (key << width) | padded[j : n + j]
        while True:
            order = np.argsort(key)
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
            if rank[order[-1]] == n - 1:
                return order
            key = rank * (n + 1)
            key[: n - depth] += rank[depth:] + 1
            depth *= 2

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, b in enumerate(range(self.bits - 1, -1, -1)):
            ones = self.ones[i][at]
            at = np.where((symbol >> b) & 1, self.zeros[i] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first ``at`` entries of the transform."""
        return self._descend(symbol, at) - self.start[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes that begin with each phrase (a row of symbols), by backward search."""
        lo = self.first[phrases[:, -1]]
        hi = self.first[phrases[:, -1] + 1]
        for j in range(phrases.shape[1] - 2, -1, -1):
            c = phrases[:, j]
            lo = self.first[c] + self.rank(c, lo)
            hi = self.first[c] + self.rank(c, hi)
        return lo, np.maximum(hi, lo)

    def locate(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row of the interval, text position)`` of every occurrence, by stepping back to sampled positions."""
        count = hi - lo
        which = np.repeat(np.arange(len(lo)), count)
        at = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
        place = np.zeros(len(at), np.int64)
        open_, steps = np.arange(len(at)), 0
        while len(open_):
            row = at[open_]
            found = self.held[row + 1] > self.held[row]
            place[open_[found]] = self.samples[self.held[row[found]]] + steps
            open_ = open_[~found]
            c = self.bwt[at[open_]].astype(np.int64)
            at[open_] = self.first[c] + self.rank(c, at[open_])
            steps += 1
        return which, place


def equal_runs(passages: list[np.ndarray], texts: list[np.ndarray]) -> list[tuple[list[tuple[int, int, int]], bool]]:
    """For each passage and its stretch of text: the ``(text position, passage position, length)`` of the runs of two or more equal words, in text order, and whether they can hold half of the passage."""
    n = len(passages)
    sizes, lengths = (np.fromiter(map(len, x), np.int64, n) for x in (passages, texts))
    of_q, of_p = np.repeat(np.arange(n), sizes), np.repeat(np.arange(n), lengths)
    width = max(int(x.max(initial=0)) for x in (*passages, *texts)) + 1
    words_q, words_p = np.concatenate(passages) + of_q * width, np.concatenate(texts) + of_p * width
    # positions of each word in its passage, by a sorted copy: as large as the matches, not as passage times text
    order = np.argsort(words_q, kind="stable")
    ordered = words_q[order]
    left, right = np.searchsorted(ordered, words_p, "left"), np.searchsorted(ordered, words_p, "right")
    count = right - left
    p = np.repeat(np.arange(len(words_p)), count)
    q = order[np.repeat(left - (np.cumsum(count) - count), count) + np.arange(len(p))]
    own = of_p[p]
    by = np.lexsort((p, p - q, own))
    p, q, own = p[by], q[by], own[by]
    cut = np.flatnonzero(np.r_[True, (np.diff(p - q) != 0) | (np.diff(p) != 1) | (np.diff(own) != 0), True])
    length = np.diff(cut)
    long = length >= 2
    # no chain holds more than the passage positions on diagonals that have a run
    held = np.isin(p - q, (p - q)[cut[:-1][long]])
    enough = np.bincount(of_q[np.unique(q[held])], minlength=n) >= LEAST * sizes
    at, length = cut[:-1][long], length[long]
    by = np.lexsort((q[at], p[at]))
    at, length = at[by], length[by]
    own = own[at]
    begin_p, begin_q = np.cumsum(lengths) - lengths, np.cumsum(sizes) - sizes
    edge = np.searchsorted(own, np.arange(n + 1))
    return [
        (list(zip((p[at[a:b]] - begin_p[i]).tolist(), (q[at[a:b]] - begin_q[i]).tolist(), length[a:b].tolist())), True) if enough[i] else ([], False)
        for i, (a, b) in enumerate(zip(edge[:-1], edge[1:]))
    ]


def held_words(passage: np.ndarray, text: np.ndarray, runs: list[tuple[int, int, int]] | None = None) -> tuple[int, int, int]:
    """Most words of the passage that one stretch of the text holds in order, over gaps up to ``GAP`` words (on either side) and one break; and that stretch.

    Where they cannot be half of the passage the answer is (0, 0, 0).
    """
    if runs is None:
        runs = equal_runs([passage], [text])[0][0]
    longest = max((n for _, _, n in runs), default=0)
    best: list[tuple[int, int, int, int]] = []  # words of the best chain that ends with the run, and its begin: without and with the break
    top, span = 0, (0, 0)
    for i, (pi, qi, n) in enumerate(runs):
        plain, begin, broken, begun = n, pi, 0, pi
        for j in range(i - 1, -1, -1):
            pj, qj, m = runs[j]
            if pi - pj > BREAK + longest:
                break
            over = max(0, qj + m - qi, pj + m - pi)  # an overlap belongs to the earlier run
            if qi <= qj or n - over < 1:
                continue
            gap = pi + over - (pj + m)
            skipped = qi + over - (qj + m)
            gain = n - over
            if 0 < gap == skipped <= GAP:
                gain += int((passage[qj + m : qi + over] == text[pj + m : pi + over]).sum())
            if skipped > GAP:
                continue
            if gap <= GAP:
                if best[j][0] + gain > plain:
                    plain, begin = best[j][0] + gain, best[j][1]
                if best[j][2] and best[j][2] + gain > broken:
                    broken, begun = best[j][2] + gain, best[j][3]
            elif gap <= BREAK and best[j][0] + n - over > broken:
                broken, begun = best[j][0] + n - over, best[j][1]
        best.append((plain, begin, broken, begun))
        for held, since in ((plain, begin), (broken, begun)):
            if held > top:
                top, span = held, (since, pi + n)
    return top, *span


def needed_hits(n: int) -> int:
    """Probes that an unbroken half of a passage of ``n`` words holds, ``HITS`` at most."""
    return min(HITS, max(1, -(-n // 2) - PROBE + 1))


class Probes:
    """The passages as symbols, and the triples that point to few of them."""

    def __init__(self, passages: list[tuple[int, str]]):
        split = [(i, words(x)) for i, x in passages if x]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in split for w in ws}), 2)}  # 1: any other word
        self.ids = [i for i, ws in split if len(ws) >= PROBE]
        self.passages = [np.array([self.vocabulary[w] for w in ws], np.int64) for _, ws in split if len(ws) >= PROBE]
        self.need = np.array([needed_hits(len(ws)) for ws in self.passages], np.int64)
        # passages whose half is shorter than a probe get shorter ones
        size = [min(PROBE, -(-len(ws) // 2)) for ws in self.passages]
        grams = [[tuple(ws[j : j + k].tolist()) for j in range(len(ws) - k + 1)] for ws, k in zip(self.passages, size)]
        at: dict[tuple, set[int]] = {}
        for k, gs in enumerate(grams):
            for g in gs:
                at.setdefault(g, set()).add(k)
        few = {g for g, ks in at.items() if len(ks) <= SHARED}
        chosen: set[tuple[tuple, int]] = set()
        for k, gs in enumerate(grams):
            own = [g in few for g in gs]
            half = max(1, -(-len(self.passages[k]) // 2) - size[k] + 1)
            spare = min(half, 2 * HITS)
            lean = any(sum(own[j : j + half]) < spare for j in range(len(gs) - half + 1))  # some half would keep too few
            chosen |= {(g, k) for g, mine in zip(gs, own) if mine or lean}
        ordered = sorted(chosen)
        #: phrases of each length as rows of symbols, with the passages they belong to
        self.phrases = [(np.array([g for g, _ in part], np.int64), np.array([k for _, k in part], np.int64)) for n in (2, 3) if (part := [x for x in ordered if len(x[0]) == n])]
        self._forget()

    def _forget(self) -> None:
        self._stretches: dict[str, int] = {}
        self._count, self._begin, self._flat = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self._used = 0

    def _stretch(self, raw: str) -> int:
        k = len(self._stretches)
        if k == len(self._count):
            self._count, self._begin = (np.concatenate([x, np.zeros_like(x)]) for x in (self._count, self._begin))
        found = np.array([self.vocabulary.get(w, 1) for w in words(raw)], np.int64)
        self._stretches[raw] = k
        self._count[k], self._begin[k] = len(found), self._used
        while self._used + len(found) > len(self._flat):
            self._flat = np.concatenate([self._flat, np.zeros_like(self._flat)])
        self._flat[self._used : self._used + len(found)] = found
        self._used += len(found)
        return k

    def stretches(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The number of words in each stretch between white space (tags blanked), and the symbols of all words."""
        if "<" in text:
            text = _TAG.sub(lambda m: " " * len(m.group(0)), text)
        if len(self._stretches) > 400_000:
            self._forget()
        get, new = self._stretches.get, self._stretch
        found = np.array([k if (k := get(x)) is not None else new(x) for x in text.split()], np.int64)
        count = self._count[found]
        at = np.repeat(self._begin[found] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return count, self._flat[at]

    def symbols(self, text: str) -> np.ndarray:
        return self.stretches(text)[1]

    def word_places(self, text: str) -> np.ndarray:
        """Begin and end, in characters of the text, of the stretch that holds each word."""
        if "<" in text:
            text = _TAG.sub(lambda m: " " * len(m.group(0)), text)
        places = np.array([m.span() for m in re.finditer(r"\S+", text)], np.int64).reshape(-1, 2)
        return np.repeat(places, self.stretches(text)[0], axis=0)

    def __getstate__(self) -> dict:
        self._forget()
        return self.__dict__


def leaks_in_shard(probes: Probes, texts: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
    """``(text number, passage number, words held, first word, end)`` of every leak in one shard: the best stretch for a pair, and every other one."""
    if not probes.phrases or not texts:
        return []
    # texts are kept apart by the symbol of other words, which no phrase holds
    parts = [x for t in texts for x in (t, np.ones(1, np.int64))]
    index = FMIndex(np.concatenate(parts), len(probes.vocabulary) + 2)
    found = [(owner[which], place) for phrases, owner in probes.phrases for which, place in [index.locate(*index.search(phrases))]]
    owner, place = (np.concatenate(x) for x in zip(*found))
    if not len(owner):
        return []
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    doc = np.searchsorted(begins, place, "right") - 1
    pair = doc * len(probes.passages) + owner
    order = np.lexsort((place, pair))
    pair, place = pair[order], place[order]
    edge = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1], True])
    many = np.diff(edge) >= probes.need[pair[edge[:-1]] % len(probes.passages)]
    near: list[tuple[int, int, int, int]] = []  # text, passage and the words to look at
    for a, b in zip(edge[:-1][many].tolist(), edge[1:][many].tolist()):
        d, k = divmod(int(pair[a]), len(probes.passages))
        n = len(probes.passages[k])
        spots = place[a:b] - begins[d]
        # groups of hits close enough for one stretch with a break
        cuts = [0, *(np.flatnonzero(np.diff(spots) > BREAK + n) + 1).tolist(), len(spots)]
        near += [(d, k, max(0, int(spots[lo]) - n - GAP), int(spots[hi - 1]) + n + GAP + PROBE) for lo, hi in zip(cuts[:-1], cuts[1:]) if hi - lo >= probes.need[k]]
    out = []
    for lo in range(0, len(near), 1000):
        some = near[lo : lo + 1000]
        windows = [texts[d][a:b] for d, _, a, b in some]
        for (d, k, a, _), window, (runs, enough) in zip(some, windows, equal_runs([probes.passages[k] for _, k, _, _ in some], windows)):
            if enough:
                held, first, end = held_words(probes.passages[k], window, runs)
                if held >= LEAST * len(probes.passages[k]):
                    out.append((d, k, held, a + first, a + end))
    return out


def _scan(documents: DataFrame, eval_items: DataFrame, rows_of, schema: str) -> DataFrame:  # noqa: ANN001
    """``rows_of(probes, text, leaks of the text)`` for every document with a leak, after its ``doc_id``."""
    items = fixed_rows(eval_items.select("eval_id", "passage").filter("eval_id is not null and passage is not null"), 1_000_000, "evaluation items")
    probes = Probes([(r[0], r[1]) for r in items])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[list[int]] = []
        texts: list[np.ndarray] = []
        raw: list[str] = []
        seen: dict[str, int] = {}
        size = 0
        columns = ["doc_id", *(c.split()[0] for c in schema.split(","))]

        def result() -> pd.DataFrame:
            of_text: dict[int, list[tuple]] = {}
            for d, *leak in leaks_in_shard(probes, texts):
                of_text.setdefault(d, []).append(tuple(leak))
            found = [(doc, *row) for d, leaks in of_text.items() for row in rows_of(probes, raw[d], leaks) for doc in ids[d]]
            return pd.DataFrame(found, columns=columns)

        for pdf in batches:
            for doc, text in zip(pdf["doc_id"].array, pdf["text"].array):
                if text in seen:
                    ids[seen[text]].append(doc)
                    continue
                seen[text] = len(texts)
                texts.append(probes.symbols(text))
                raw.append(text)
                ids.append([doc])
                size += len(texts[-1]) + 1
                if size >= SHARD:
                    yield result()
                    ids, texts, raw, seen, size = [], [], [], {}, 0
        if texts:
            yield result()

    rows = documents.filter("doc_id is not null and text is not null and text <> ''").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return spread(rows).mapInPandas(scan, f"doc_id bigint, {schema}")


def _shares(probes: Probes, text: str, leaks: list[tuple]) -> list[tuple]:
    best: dict[int, int] = {}
    for k, held, _, _ in leaks:
        best[k] = max(best.get(k, 0), held)
    return [(probes.ids[k], held / len(probes.passages[k])) for k, held in best.items()]


def _spans(probes: Probes, text: str, leaks: list[tuple]) -> list[tuple]:
    places = probes.word_places(text)
    merged: list[list] = []
    for begin, end, k in sorted((int(places[a, 0]), int(places[b - 1, 1]), k) for k, _, a, b in leaks):
        if merged and begin <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
            merged[-1][2].add(probes.ids[k])
        else:
            merged.append([begin, end, {probes.ids[k]}])
    return [(begin, end, sorted(found)) for begin, end, found in merged]


def find_leaks(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """``doc_id, eval_id, share`` of every document that holds at least half of a passage."""
    return _scan(documents, eval_items, _shares, "eval_id bigint, share double")


def removal_spans(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """``doc_id, begin, end, eval_ids``: the stretches of text to remove, in characters from 0 (``end`` excluded), overlapping ones merged."""
    return _scan(documents, eval_items, _spans, "begin bigint, end bigint, eval_ids array<bigint>")
