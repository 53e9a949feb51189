"""Which of many titles may be alike as sequences: bounds of the Ratcliff-Obershelp ratio over all pairs of two lists, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np

#: Rows of one side looked at together, pairs worked on at once, columns of the count of characters, length above which a title is compared outright, characters left out at first.
STRIP, CHUNK, FEATURES, LONG, DROP = 128, 1 << 14, 512, 256, 6


def may_be_alike(left: list[str], right: list[str] | None, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``left`` and ``right`` (of two in ``left`` where it is None, each once) that can reach a ratio of ``least``; no pair that reaches it is missing.

    The characters matched form a common subsequence. So every pair is held against two bounds: the characters the titles
    share at all, for whole strips by a matrix product, and, for what is left, their longest common subsequence by
    bit-parallel steps over many pairs at once. That runs first without the commonest characters, which are counted as
    matched wherever both have them, then without as few as let nearly all titles fit one machine word, then on the whole titles.
    """
    same = right is None
    n = len(left)
    texts = left if same else left + right
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    if not length.sum():
        return
    _, code = np.unique(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    row = np.repeat(np.arange(len(texts)), length)
    kinds = int(code.max()) + 1
    half = least / 2
    shared, over = _unary(row, code, length)
    mine = np.column_stack([shared[:n], over[:n] - half * length[:n], np.ones(n)]).astype(np.float32)
    shared, at = (shared, 0) if same else (shared[n:], n)
    theirs = np.column_stack([shared, np.ones(len(shared)), -half * length[at:]]).astype(np.float32)
    del shared
    by, by2 = np.argsort(length[:n], kind="stable"), np.argsort(length[at:], kind="stable")
    mine, theirs, len1, len2 = mine[by], theirs[by2], length[:n][by], length[at:][by2]
    place = np.empty(len(texts), np.int64)  # of a row in its side's order of length
    place[by], place[at + by2] = np.arange(n), np.arange(len(by2))
    own, other = row < n, row >= at
    stages = []
    for common in (_common(code, row, length, DROP), _common(code, row, length), []):
        own_, other_ = (side & ~np.isin(code, common) for side in (own, other))
        held = [np.bincount(row[code == c], minlength=len(texts)) for c in common]
        stages.append((_rows(place[row[own_]], code[own_], n), _columns(place[row[other_]], code[other_], len(by2), kinds), [(h[:n][by], h[at:][by2]) for h in held]))
    for lo in range(0, n, STRIP):
        hi = min(n, lo + STRIP)
        first, last = np.searchsorted(len2, (len1[lo] * least / (2 - least) - 1, len1[hi - 1] * (2 - least) / least + 1))
        last = min(last, hi) if same else last
        hit = theirs[first:last] @ mine[lo:hi].T >= -0.01
        if same:
            hit &= np.arange(first, last)[:, None] < np.arange(lo, hi)
        j, i = np.nonzero(hit)
        j += first
        outright = (len1[i + lo] > LONG) | (len2[j] > LONG)
        if outright.any():
            yield by[i[outright] + lo], by2[j[outright]]
            i, j = i[~outright], j[~outright]
        for rows, columns, counts in stages:
            masks = _masks(*rows, lo, hi, kinds)
            kept = []
            for k in range(0, len(i), CHUNK):
                x, y = i[k : k + CHUNK], j[k : k + CHUNK]
                bound = _subsequence(masks, x * (kinds + 1), columns, y)
                for a, b in counts:
                    bound += np.minimum(a[x + lo], b[y])
                kept.append(bound >= half * (len1[x + lo] + len2[y]) - 0.01)
            if kept:
                kept = np.concatenate(kept)
                i, j = i[kept], j[kept]
        if len(i):
            yield by[i + lo], by2[j]


def _unary(row: np.ndarray, code: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 0/1 matrix whose inner products bound the characters that two rows share, and what a row may have beyond it.

    A column stands for the k-th occurrence of a character; all but the commonest columns are counted together as if they were one character.
    """
    n = len(length)
    order = np.lexsort((code, row))
    r, c = row[order], code[order]
    start = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (c[1:] != c[:-1])])
    nth = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)]))
    _, feature, times = np.unique(c * (int(nth.max()) + 1) + nth, return_inverse=True, return_counts=True)
    top = np.argsort(-times, kind="stable")[:FEATURES]
    column = np.full(len(times), -1)
    column[top] = np.arange(len(top))
    column = column[feature]
    rest = column < 0
    extra = np.bincount(r[rest], minlength=n)
    depth = min(FEATURES, int(extra.max()))
    out = np.zeros((n, len(top) + depth), np.float32)
    out[r[~rest], column[~rest]] = 1
    out[:, len(top) :] = np.arange(depth) < extra[:, None]
    return out, np.maximum(0, extra - depth)


def _common(code: np.ndarray, row: np.ndarray, length: np.ndarray, least: int = 0) -> list[int]:
    """The commonest characters: at least so many, and as many (eight at most) as must go for 19 of 20 rows to keep 64 characters or fewer."""
    out, left = [], length.copy()
    for c in np.argsort(-np.bincount(code), kind="stable")[: max(8, least)]:
        if len(out) >= least and np.percentile(left, 95) <= 64:
            break
        out.append(int(c))
        left -= np.bincount(row[code == c], minlength=len(length))
    return out


def _rows(row: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The characters row after row, and where each row begins."""
    order = np.argsort(row, kind="stable")
    return code[order], np.r_[0, np.cumsum(np.bincount(row, minlength=n))]


def _columns(row: np.ndarray, code: np.ndarray, n: int, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """The k-th characters of all rows, for each k up to ``LONG``, ``kinds`` where a row has ended; and the lengths."""
    order = np.argsort(row, kind="stable")
    size = np.bincount(row, minlength=n)
    r = row[order]
    nth = np.arange(len(r)) - np.repeat(np.cumsum(size) - size, size)
    out = np.full((min(LONG, int(size.max())), n), kinds)
    short = nth < LONG
    out[nth[short], r[short]] = code[order][short]
    return out, size


def _masks(code: np.ndarray, start: np.ndarray, lo: int, hi: int, kinds: int) -> np.ndarray:
    """Per machine word, row and character the places at which the row has it, as bits."""
    size = np.minimum(np.diff(start[lo : hi + 1]), LONG)
    out = np.zeros((max(1, -(-int(size.max()) // 64)), (hi - lo) * (kinds + 1)), np.uint64)
    for r, (s, k) in enumerate(zip(start[lo:hi], size)):
        p = np.arange(k)
        np.bitwise_or.at(out, (p // 64, r * (kinds + 1) + code[s : s + k]), np.uint64(1) << (p % 64).astype(np.uint64))
    return out


def _subsequence(masks: np.ndarray, x: np.ndarray, columns: tuple[np.ndarray, np.ndarray], y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of the masks at ``x`` and the rows ``y`` (Hyyrö 2004, bit-parallel)."""
    codes, size = columns
    state = [np.full(len(x), ~np.uint64(0)) for _ in masks]
    for c in codes[: int(size[y].max())]:
        at = c.take(y)
        at += x
        if len(masks) == 1:
            met = masks[0].take(at)
            met &= state[0]
            s = state[0] + met
            state[0] -= met
            state[0] |= s
            continue
        carry = np.zeros(len(x), np.uint64)
        for k, mask in enumerate(masks):
            v = state[k]
            met = mask.take(at)
            met &= v
            s = v + met
            more = s < v
            s += carry
            carry = (more | (s < carry)).astype(np.uint64)
            v -= met
            v |= s
    return sum(np.bitwise_count(~v).astype(np.int64) for v in state)


def ratios(a: list[str], b: list[str], least: float) -> np.ndarray:
    """The Ratcliff-Obershelp ratio of each pair, as difflib works it out; 0 where it is below ``least`` for certain."""
    out = np.zeros(len(a))
    for k, (x, y) in enumerate(zip(a, b)):
        if len(y) >= 200:  # difflib leaves popular characters out there
            out[k] = SequenceMatcher(None, x, y).ratio()
        else:
            out[k] = 2.0 * _matched(x, y, least / 2 * (len(x) + len(y)) - 1e-6) / (len(x) + len(y))
    return out


def _matched(a: str, b: str, need: float) -> int:
    """How many characters lie in the matching blocks of two texts; 0 once ``need`` is out of reach.

    The longest common stretch, of equals the first in ``a`` and then in ``b``, is a block, and so on to its left and right;
    a stretch is looked for only where it is longer than the longest so far.
    """
    todo, total, still = [(0, len(a), 0, len(b), len(a))], 0, min(len(a), len(b))
    while todo:
        a0, a1, b0, b1, most = todo.pop()
        text = b[b0:b1]
        size, at, met, i = 0, a0, 0, a0
        most = min(most, a1 - a0, b1 - b0)
        while size < most and i + size < a1:
            j = text.find(a[i : i + size + 1])
            if j >= 0:
                size, at, met = size + 1, i, j
                while i + size < a1 and (j := text.find(a[i : i + size + 1], met)) >= 0:
                    size, met = size + 1, j
            i += 1
        still -= min(a1 - a0, b1 - b0)
        if size:
            total += size
            met += b0
            before, after = min(at - a0, met - b0), min(a1 - at, b1 - met) - size
            still += before + after
            if before:
                todo.append((a0, at, b0, met, size))
            if after:
                todo.append((at + size, a1, met + size, b1, size))
        if total + still < need:
            return 0
    return total
