"""Problem 8: subject areas of documents.

The model is an averaged-embedding classifier: a word is the mean of its own vector and the mean of the vectors of its
character n-grams (both hashed), a sentence the mean of its words, and each subject an independent logistic output. It is
fitted on the labelled documents (``BOUND`` of them at most, picked by a hash of their key) and the descriptions of the
subjects. The training set is encoded once, ``PART`` documents a partition; in every step each partition gives the gradient of
the shared parameters over all its sentences, the gradients are summed and one Adam step is taken, so that the fit does not
depend on how the set is partitioned. The targets of a sentence are its document's labels; after the first steps the labels the
model finds in it are kept and sentences that show none of them count as about none, since documents mix subjects and hold
remarks on others.

Every sentence of every document is scored, each output against its own threshold (a sentence may be about two subjects); a
document has the subjects that at least ``SHARE`` of its sentences are about. The thresholds are set on the training set so that
each output fires as often as its targets do, within ``CUTS``. As all is linear up to the logistic, the embeddings times the
output weights are one small broadcast table and what a stretch between white space contributes is looked up once per task.

Defined results: null and blank texts have no subject; a text whose sentences show none has no row; repeated labels count
once; repeated documents each get their rows; texts of any length are read whole; empty tables give empty results; extra
columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.tables import cut_lineage, fixed_rows, spread

BOUND, PART, STEPS, DIM, WORD_BITS, SUB_BITS, SHARE = 5000, 1250, 40, 12, 15, 15, 0.25
RATE, CUTS = 0.15, (0.2, 0.5)

_CODE = re.compile(r"```.*?(?:```|\Z)", re.S)
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'»”’)\]]*\s+|[\r\n]+")
_MARKUP = re.compile(r"</?[A-Za-z][^<>]{0,80}>|&[a-z]+;|https?://\S+")
_WORD = re.compile(r"[^\W\d_]{2,}")


def _hash(text: str) -> int:
    h = 2166136261
    for c in text:
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    return (h ^ (h >> 15)) & 0xFFFFFFFF


def buckets(word: str) -> list[int]:
    """The bucket of the word itself, then those of its n-grams of 3 to 5 characters."""
    marked = f"<{word}>"
    subs = {marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)}
    return [_hash(word) & ((1 << WORD_BITS) - 1)] + sorted((1 << WORD_BITS) + (_hash(s) & ((1 << SUB_BITS) - 1)) for s in subs)


def raw_sentences(text: str) -> list[str]:
    """The sentences and lines of a text; code and markup are left out."""
    if "```" in text:
        text = _CODE.sub("\n", text)
    if "<" in text or "&" in text or "http" in text:
        text = _MARKUP.sub(" ", text)
    return _SENTENCE.split(text)


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence, in lower case; sentences of fewer than three words are left out."""
    found = (_WORD.findall(s.lower()) for s in raw_sentences(text))
    return [w for w in found if len(w) >= 3]


class Encoded:
    """Sentences as arrays: word numbers by sentence and buckets by word."""

    def __init__(self, texts: list[list[str]], allowed: np.ndarray):
        number: dict[str, int] = {}
        self.allowed, self.packed = allowed, False
        self.words = np.fromiter((number.setdefault(w, len(number)) for s in texts for w in s), np.int32)
        self.size = np.array([len(s) for s in texts], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        lists = [buckets(w) for w in number]
        self.sub = np.array([b for x in lists for b in x], np.int32)
        self.sub_size = np.array([len(x) for x in lists], np.int64)
        self.sub_begin = np.cumsum(self.sub_size) - self.sub_size
        # half for the word, half for its n-grams together
        weight = np.repeat(0.5 / np.maximum(self.sub_size - 1, 1), self.sub_size)
        weight[self.sub_begin] = 0.5
        self.sub_weight = weight.astype(np.float32)
        self.word_of_sub = np.repeat(np.arange(len(lists), dtype=np.int32), self.sub_size)
        # sentences by word, for the way back
        self.by_word = np.argsort(self.words, kind="stable")
        self.word_begin = np.searchsorted(self.words[self.by_word], np.arange(len(lists)))
        self.by_word = np.repeat(np.arange(len(texts), dtype=np.int32), self.size)[self.by_word]

    def buckets(self) -> np.ndarray:
        """The rows of the table that the sentences use."""
        return np.unique(self.sub)

    def within(self, used: np.ndarray | None) -> Encoded:
        """The same sentences over a table of the rows ``used`` only."""
        if used is not None and not self.packed:
            self.sub, self.packed = np.searchsorted(used, self.sub).astype(np.int32), True
        return self

    def logits(self, params: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The mean vector of each sentence and its logits."""
        by_word = np.add.reduceat(params["table"][self.sub] * self.sub_weight[:, None], self.sub_begin, axis=0)
        vec = np.add.reduceat(by_word[self.words], self.begin, axis=0) / self.size[:, None].astype(np.float32)
        return vec, vec @ params["out"] + params["bias"]

    def scatter(self, grad: np.ndarray, rows: int) -> np.ndarray:
        """The gradient of the table from that of the sentence vectors."""
        share = grad / self.size[:, None].astype(np.float32)
        by_word = np.add.reduceat(share[self.by_word], self.word_begin, axis=0)
        out = np.empty((rows, grad.shape[1]), np.float32)
        for j in range(grad.shape[1]):
            out[:, j] = np.bincount(self.sub, by_word[self.word_of_sub, j] * self.sub_weight, minlength=rows)
        return out


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def start(subjects: int, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, ((1 << WORD_BITS) + (1 << SUB_BITS), DIM)).astype(np.float32)
    return {"table": table, "out": rng.normal(0, 0.3, (DIM, subjects)).astype(np.float32), "bias": np.full(subjects, -2.0, np.float32)}


def targets(logits: np.ndarray, allowed: np.ndarray, progress: float) -> np.ndarray:
    """The labels of each sentence at this point of the fit: its document's at first, then those of them that the model finds in it."""
    if progress < 0.4:
        return allowed.astype(np.float32)
    inside = np.where(allowed, logits, -np.inf)
    gate = -2.0 if progress < 0.7 else -1.0
    best = inside.max(1, keepdims=True)
    return ((inside > gate) & (inside >= best) | (inside > 1.0)).astype(np.float32)


def gradient(enc: Encoded, params: dict[str, np.ndarray], progress: float, used: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The summed gradient of the logistic losses over all sentences of a partition, and their number ``n``. ``used``: the table's rows in ``params``."""
    vec, logits = enc.within(used).logits(params)
    error = _logistic(logits) - targets(logits, enc.allowed, progress)
    return {"table": enc.scatter(error @ params["out"].T, len(params["table"])), "out": vec.T @ error, "bias": error.sum(0), "n": np.array(len(enc.size))}


class Adam:
    """Adam over the mean of the summed gradients."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.s = {k: np.zeros_like(v) for k, v in params.items()}
        self.t = 0

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray], rate: float) -> dict[str, np.ndarray]:
        self.t += 1
        out = {}
        for k in self.m:
            g = grads[k] / grads["n"]
            self.m[k] += 0.1 * (g - self.m[k])
            self.s[k] += 0.01 * (g * g - self.s[k])
            out[k] = (params[k] - rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.s[k] / (1 - 0.99**self.t)) + 1e-8)).astype(np.float32)
        return out


_EDGES = np.linspace(-4, 4, 129)  # bins of logits, from which the thresholds are read


def firing(enc: Encoded, params: dict[str, np.ndarray], used: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """By output: the sentences that have it as a target, and a histogram of its logits."""
    _, logits = enc.within(used).logits(params)
    bins = np.clip(np.searchsorted(_EDGES, logits), 0, len(_EDGES))
    counts = np.stack([np.bincount(bins[:, j], minlength=len(_EDGES) + 1) for j in range(logits.shape[1])], 1)
    return {"wanted": targets(logits, enc.allowed, 1.0).sum(0), "counts": counts}


def thresholds(wanted: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The logit above which each output fires as often as it is a target, within the logits of ``CUTS``."""
    above = np.cumsum(counts[::-1], axis=0)[::-1]  # sentences in a bin or a higher one
    at = (above[1:] > wanted).sum(0)
    cut = _EDGES[np.minimum(at, len(_EDGES) - 1)]
    return np.clip(cut, *(np.log(c / (1 - c)) for c in CUTS)).astype(np.float32)


def training_set(documents: DataFrame, labels: DataFrame, bound: int = BOUND) -> tuple[DataFrame, int]:
    """``text, subjects`` of about ``bound`` labelled documents (of all, where there are fewer), picked by a hash of their key; and their number."""
    per_doc = labels.filter("doc_id is not null and subject_id is not null").groupBy("doc_id").agg(F.collect_set("subject_id").alias("subjects"))
    n = per_doc.count()
    kept = per_doc.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, bound / max(n, 1))))
    return documents.select("doc_id", "text").filter("text is not null").join(F.broadcast(kept), "doc_id").select("doc_id", "text", "subjects"), min(n, bound)


def _encode(found: list[tuple[list[list[str]], list[int]]], outputs: int) -> Encoded | None:
    texts = [s for ss, _ in found for s in ss]
    if not texts:
        return None
    allowed = np.zeros((len(texts), outputs), bool)
    i = 0
    for ss, ids in found:
        allowed[i : i + len(ss), ids] = True
        i += len(ss)
    return Encoded(texts, allowed)


def fit(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> tuple[list[str], dict[str, np.ndarray]]:
    """The subjects' order and the fitted parameters, with the ``cut`` of each output."""
    rows = fixed_rows(subjects.filter("subject_id is not null").select("subject_id", "label", "description"), 10_000, "subjects")
    order = sorted({r[0] for r in rows})
    number = {x: i for i, x in enumerate(order)}
    params = start(len(order))
    cut = np.full(len(order), np.log(CUTS[0] / (1 - CUTS[0])), np.float32)
    seeds = _encode([(sentences(" ".join(x for x in r[1:] if x)), [number[r[0]]]) for r in rows], len(order))
    chosen, n = training_set(documents, labels)
    if not order or not n:
        return order, params | {"cut": cut}

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [(sentences(text), [number[x] for x in ids if x in number]) for pdf in batches for text, ids in zip(pdf["text"].array, pdf["subjects"].array)]
        enc = _encode(found, len(order))
        if enc is not None:
            yield pd.DataFrame({"data": [pickle.dumps(enc)]})

    # a few rows, each the encoded documents of one partition
    encoded = cut_lineage(chosen.repartition(-(-n // PART), "doc_id").mapInPandas(encode, "data binary"))
    spark = documents.sparkSession

    def over_parts(work, *values) -> list:  # noqa: ANN001
        """``work(encoded, *values)`` of every partition: a few arrays of fixed size each."""
        shared = spark.sparkContext.broadcast(values)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for data in pdf["data"]:
                    yield pd.DataFrame({"out": [pickle.dumps(work(pickle.loads(data), *shared.value))]})

        found = [pickle.loads(r["out"]) for r in encoded.mapInPandas(run, "out binary").collect()]
        shared.unpersist()
        return found

    # only the rows of the table that the training set uses take part
    touched = over_parts(Encoded.buckets)
    if not touched:
        return order, params | {"cut": cut}
    used = np.unique(np.concatenate([*touched, *([seeds.buckets()] if seeds else [])]))
    small = params | {"table": params["table"][used]}
    if len(touched) == 1:  # nothing to synchronise: all steps in one task
        small, fires = over_parts(descend, seeds, small, used)[0]
    else:
        adam = Adam(small)
        for step in range(STEPS):
            small = adam.step(small, _sum([*over_parts(gradient, small, step / STEPS, used), *([gradient(seeds, small, step / STEPS, used)] if seeds else [])]), RATE)
        fires = _sum([*over_parts(firing, small, used), *([firing(seeds, small, used)] if seeds else [])])
    table = params["table"].copy()
    table[used] = small["table"]
    return order, small | {"table": table, "cut": thresholds(fires["wanted"], fires["counts"])}


def _sum(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: sum(p[k] for p in parts) for k in parts[0]}


def descend(enc: Encoded, seeds: Encoded | None, params: dict[str, np.ndarray], used: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """All steps over one partition (and the seeds): the parameters, and :func:`firing` under them."""
    adam = Adam(params)
    both = [enc, *([seeds] if seeds else [])]
    for step in range(STEPS):
        params = adam.step(params, _sum([gradient(e, params, step / STEPS, used) for e in both]), RATE)
    return params, _sum([firing(e, params, used) for e in both])


class Scorer:
    """Logits of sentences from the product table; what a stretch between white space contributes is kept."""

    def __init__(self, product: np.ndarray, bias: np.ndarray, keep: int = 300_000):
        self.product, self.bias, self.keep = product, bias, keep
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.rows = np.zeros((1024, self.product.shape[1]), np.float32)
        self.count = np.zeros(1024, np.int32)  # words in it
        self.words: dict[str, np.ndarray] = {}

    def _stretch(self, raw: str) -> int:
        k = len(self.number)
        if k == len(self.rows):
            self.rows, self.count = np.vstack([self.rows, np.zeros_like(self.rows)]), np.concatenate([self.count, np.zeros_like(self.count)])
        words = _WORD.findall(raw.lower())
        for w in words:
            if w not in self.words:
                b = buckets(w)
                self.words[w] = 0.5 * self.product[b[0]] + 0.5 * self.product[b[1:]].mean(0)
            self.rows[k] += self.words[w]
        self.count[k] = len(words)
        self.number[raw] = k
        return k

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which of the sentences have at least three words, and the logits of these."""
        if len(self.number) > self.keep:
            self._clear()
        get, stretch = self.number.get, self._stretch
        split = [s.split() for s in texts]
        ids = np.array([k if (k := get(w)) is not None else stretch(w) for s in split for w in s], np.int64)
        size = np.array([len(s) for s in split], np.int64)
        some = np.flatnonzero(size)
        if not len(some):
            return np.zeros(len(texts), bool), np.zeros((0, self.product.shape[1]), np.float32)
        begin = (np.cumsum(size) - size)[some]
        words = np.zeros(len(texts), np.int64)
        words[some] = np.add.reduceat(self.count[ids], begin)
        kept = words >= 3
        total = np.add.reduceat(self.rows[ids], begin, axis=0)[kept[some]]
        return kept, total / words[kept][:, None].astype(np.float32) + self.bias


def document_subjects(documents: DataFrame, order: list[str], params: dict[str, np.ndarray]) -> DataFrame:
    """``doc_id, subject_id, share`` of every subject that at least ``SHARE`` of a document's sentences are about."""
    shared = documents.sparkSession.sparkContext.broadcast((params["table"] @ params["out"], params["bias"], params["cut"]))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        product, bias, cut = shared.value
        scorer = Scorer(product, bias)
        for pdf in batches:
            out: list[tuple] = []
            ids = pdf["doc_id"].to_numpy()
            texts = pdf["text"].tolist()
            for lo in range(0, len(texts), 1000):  # blocks that fit the cache
                found = [raw_sentences(x) for x in texts[lo : lo + 1000]]
                kept, logits = scorer.logits([s for ss in found for s in ss])
                doc = np.repeat(np.arange(len(found)), [len(ss) for ss in found])[kept]
                size = np.bincount(doc, minlength=len(found))
                count = np.stack([np.bincount(doc[logits[:, j] > cut[j]], minlength=len(found)) for j in range(len(order))], 1)
                share = count / np.maximum(size, 1)[:, None]
                out += [(ids[lo + i], order[j], share[i, j]) for i, j in zip(*np.nonzero(share >= SHARE))]
            yield pd.DataFrame(out, columns=["doc_id", "subject_id", "share"])

    rows = documents.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if not order:
        return rows.select("doc_id", F.lit("").alias("subject_id"), F.lit(0.0).alias("share")).filter("false")
    return spread(rows).mapInPandas(score, "doc_id bigint, subject_id string, share double")
