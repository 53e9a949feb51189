"""Hashes of the k-character substrings of many texts at once."""

from __future__ import annotations

import numpy as np


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), in place where possible."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def shingle_hashes(texts: list[str], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """``(text number, hash)`` of every substring of ``k`` characters, repeats included; shorter texts have none."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.maximum(lengths - k + 1, 0)
    if not counts.sum():
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    doc = np.repeat(np.arange(len(texts)), counts)
    first = np.repeat(np.cumsum(lengths) - lengths - (np.cumsum(counts) - counts), counts) + np.arange(len(doc))
    wide = codes.astype(np.uint64)
    n = len(wide) - k + 1
    h = wide[:n].copy()
    for j in range(1, k):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += wide[j : n + j]
    return doc, mix(h)[first]


def shingle_buckets(texts: list[str], k: int, bits: int) -> np.ndarray:
    """The top ``bits`` of the hash of every substring of ``k`` characters; substrings across texts get one number more."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = codes[:n].copy()
    for j in range(1, k):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += codes[j : n + j]
    out = (mix(h) >> np.uint64(64 - bits)).view(np.int64)
    ends = np.cumsum(np.fromiter((len(t) for t in texts), np.int64, len(texts)))[:-1]
    for j in range(1, k):
        at = ends - j
        out[at[(at >= 0) & (at < n)]] = 1 << bits
    return out
