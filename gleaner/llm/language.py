"""Problem 1: language of every document field and of every stretch of a mixed field.

A multinomial naive Bayes over hashed character n-grams. The counts are fitted on a bounded sample of rows by their
declared labels (about ``SAMPLE`` rows, taken by a hash of the key), in three rounds: after the first, rows whose prediction
contradicts the declared label are dropped, so that wrong labels do not stay in the model. Short seed texts per
language keep tiny tables usable. The matrix of log-probabilities (2**16 buckets by nine languages) is broadcast; every
field of every row is cut into pieces (sentences, lines, parts set off by a dash, bar or slash), pieces are scored in
batches with numpy, and a Viterbi pass over the pieces of a mixed field with a cost for changing the language gives the
stretches. Pieces without a word of any language (names, numbers, tags, source names) make no stretch.

Defined results: null and blank fields have no stretch; a field of names only has none; the confidence is the posterior
of the stretch's language with the length-tempered likelihood; repeated rows give the same result each; texts of any
length are scored whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.residue import ExemplarIndex, exemplar_weights
from gleaner.tables import cut_lineage, fixed_rows, spread

LANGS = ("en", "de", "fr", "es", "pt", "it", "ru", "zh", "ja")
BUCKET_BITS, ORDERS, SAMPLE, PART, SWITCH_COST = 16, (2, 3, 4), 20_000, 4000, 6.0

# Codes and English names of the languages.
LABELS = {
    "en": "en eng english", "de": "de deu ger german", "fr": "fr fra fre french", "es": "es spa spanish castilian", "pt": "pt por portuguese",
    "it": "it ita italian", "ru": "ru rus russian", "zh": "zh zho chi cmn chinese mandarin", "ja": "ja jpn japanese jp",
}
LABEL_OF = {x: lang for lang, names in LABELS.items() for x in names.split()}

# Frequent words of each language, to seed the model.
SEEDS = {
    "en": "the of and to in is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more two like him see time could no make than first been its who now people my made over did down only way find use may long little very after words called just where most know",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei prozent hatte kann gegen vom können schon wenn habe seine ihre dann unter wir soll ich eines",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son mais comme on tout nous sa ses aux été cette d'après même aussi fait leur bien peut ces deux entre encore sans elle était être après si dont lui depuis moins avant où vous",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos ter seus quem nas me esse eles estão você",
    "it": "di e che la il un a per è in una mi sono ho non ma lo ha le si ti i con cosa se io come da ci no questo qui hai sei del bene tu mio solo me tutto te più della gli al anche nel alla dei degli delle dopo essere stato fatto quando perché molto loro",
    "ru": "и в не на я быть он с что а по это она этот к но они мы весь который из у то за свой от со для так о же все год мог человек такой его только или ещё бы себя один как до время если сам когда другой вот говорить наш мой знать стать при чтобы дело жизнь кто первый очень два день её новый рука даже во тут где там под можно ну какой после их",
    "zh": "的一是了我不人在他有这个上们来到时大地为子中你说生国年着就那和要她出也得里后自以会家可下而过天去能对小多然于心学么之都好看起发当没成只如事把还用第样道想作种开美总从无情己面最女但现前些所同日手又行意动方期它头经长儿回位分爱老因很给名法间斯知世什两次使身者被高已亲其进此话常与活正感",
    "ja": "の に は を た が で て と し れ さ ある いる も する から な こと として い や など なっ ない この ため その あっ よう また もの という あり まで られ なる へ か だ これ によって により おり より による ず なり られる において ば なかっ なく しかし について せ だっ できる それ これら ので なお のみ でき き つ における および いう さらに でも",
}

_PIECES = re.compile(r"(?<=[.!?…])[\"'»”’)\]]*\s+|(?<=[。！？])|\s*[\r\n]+\s*|\s+[|·•/–—-]+\s+")
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_NO_PROSE = re.compile(r"\S*[/@#_\\]\S*|\S+\.\S*[a-z]\S*")  # repository names, handles, tags, hosts and the like
_OWN_SCRIPT = re.compile(r"[Ѐ-ӿ぀-ヿ㐀-鿿]")


def declared(label: str | None) -> str | None:
    """The language a label names, in any code style; None where it names none of the nine."""
    return LABEL_OF.get(re.split(r"[-_ ]", label.strip().lower())[0]) if label else None


def pieces(text: str) -> list[str]:
    return [p for p in _PIECES.split(text) if p and not p.isspace()]


def _features(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of the texts (each must hold ``order`` characters at least), and where each text's begin."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes) - order + 1
    h = codes[:n].astype(np.uint32)
    for j in range(1, order):
        h *= np.uint32(0x01000193)
        h ^= codes[j : n + j]
    h ^= np.uint32(order * 0x9E3779B9 & 0xFFFFFFFF)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    bucket = (h >> np.uint32(32 - BUCKET_BITS)).astype(np.intp)
    starts = np.cumsum(lengths) - lengths
    # grams across the end of a text are pointed at an extra bucket without weight
    for j in range(1, order):
        at = starts[1:] - j
        bucket[at[(at >= 0) & (at < n)]] = 1 << BUCKET_BITS
    return bucket, starts


def _padded(text: str) -> str:
    return f"  {text.lower()}  "


class Model:
    """Log-probabilities by bucket and language, and the words seen in lower case."""

    def __init__(self, table: np.ndarray, words: frozenset[int]):
        self.table, self.words = table, words

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log-likelihood of each text under each language."""
        out = np.zeros((len(texts), len(LANGS)), np.float32)
        for start in range(0, len(texts), 4096):  # blocks that fit the cache
            block = [_padded(t) for t in texts[start : start + 4096]]
            for order in ORDERS:
                bucket, starts = _features(block, order)
                out[start : start + 4096] += np.add.reduceat(self.table[bucket], starts, axis=0)
        return out

    def linguistic(self, piece: str) -> bool:
        """Does the piece hold a word of some language, not only names, numbers and tags?"""
        if _OWN_SCRIPT.search(piece):
            return True
        return any(hash_word(w.lower()) in self.words for w in _WORDS.findall(_NO_PROSE.sub(" ", piece)) if len(w) > 1)


def hash_word(word: str) -> int:
    h = 2166136261
    for c in word:
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    return h


Row = tuple[int, str]  # number of the declared language, text


def rows_of(sample: list[tuple[str, str | None, str | None]]) -> list[Row]:
    """The usable rows of (declared language, title, summary)."""
    rows = [(LANGS.index(lang), " ".join(x for x in (t, s) if x)) for lang, t, s in sample if lang in LANGS]
    return [(i, x) for i, x in rows if x.strip()]


_SEED_ROWS = [(LANGS.index(lang), x) for lang, x in SEEDS.items()]


def counts_of(rows: list[Row], model: Model | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of n-grams by bucket and language, and lower-case words (hashes) with the rows that hold them; only rows whose label ``model`` confirms."""
    if model is not None and rows:
        guess = model.scores([x for _, x in rows]).argmax(1)
        rows = [r for r, g in zip(rows, guess) if r[0] == g]
    counts = np.zeros((1 << BUCKET_BITS, len(LANGS)), np.int32)
    for i in range(len(LANGS)):
        texts = [_padded(x) for j, x in rows if j == i]
        for order in ORDERS if texts else ():
            counts[:, i] += np.bincount(_features(texts, order)[0], minlength=(1 << BUCKET_BITS) + 1)[:-1].astype(np.int32)
    words = [hash_word(w) for _, x in rows for w in {w for w in _WORDS.findall(_NO_PROSE.sub(" ", x)) if len(w) > 1 and w.islower()}]
    return counts, *np.unique(np.array(words, np.int64), return_counts=True)


def model_of(counts: np.ndarray, words: frozenset[int]) -> Model:
    """The matrix of log-probabilities. All languages are on the same footing: shares, smoothed by the pooled share."""
    share = counts / np.maximum(counts.sum(0), 1)
    pooled = share.mean(1, keepdims=True) + 1e-8
    logp = np.log(share * 0.98 + pooled * 0.02)
    logp -= logp.mean(1, keepdims=True)
    return Model(np.vstack([logp, np.zeros((1, len(LANGS)))]).astype(np.float32), words)


def _fit_rounds(parts) -> Model:  # noqa: ANN001
    """The model after three rounds; ``parts(model)`` gives :func:`counts_of` of each part of the sample under the model of the round before."""
    seeds = counts_of(_SEED_ROWS, None)
    seeded = frozenset(hash_word(w) for x in SEEDS.values() for w in x.split())
    model = None
    for _ in range(3):
        found = [*parts(model), seeds]
        total = np.sum([c for c, _, _ in found], axis=0, dtype=np.float64)
        model = model_of(total, seeded)
    words, back = np.unique(np.concatenate([w for _, w, _ in found]), return_inverse=True)
    n = np.bincount(back, np.concatenate([k for _, _, k in found]))
    # a word is language if the model's seeds have it or two rows hold it in lower case
    return Model(model.table, seeded | frozenset(words[n >= 2].tolist()))


def fit(sample: list[tuple[str, str | None, str | None]]) -> Model:
    """The model from rows of (declared language, title, summary)."""
    rows = rows_of(sample)
    return _fit_rounds(lambda model: [counts_of(rows, model)])


def fit_on(items: DataFrame, bound: int = SAMPLE, key: str = "item_id") -> Model:
    """:func:`fit` on about ``bound`` rows that declare one of the languages, picked by a hash of the key (all, where there are fewer).

    The counts are made in the executors and added up: one matrix of fixed size for each of a few partitions.
    """
    spark = items.sparkSession
    head = F.lower(F.regexp_extract(F.trim("lang"), r"^([A-Za-z]+)", 1))
    labelled = items.filter(head.isin(sorted(LABEL_OF))).select(head.alias("label"), "title", "summary", F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_000)).alias("h"))
    total = labelled.count()
    if not total:
        return fit([])
    share = min(1.0, bound / total)
    sample = cut_lineage(labelled.filter(F.col("h") < int(1_000_000 * share)).repartition(max(1, round(total * share / PART)), "h").select("label", "title", "summary"))

    def parts(model: Model | None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        shared = spark.sparkContext.broadcast(model)

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = [r for pdf in batches for r in rows_of([(LABEL_OF[a], t, s) for a, t, s in zip(pdf["label"].array, pdf["title"].array, pdf["summary"].array)])]
            if rows:
                counts, words, n = counts_of(rows, shared.value)
                yield pd.DataFrame({"counts": [zlib.compress(counts.tobytes(), 1)], "words": [words.tobytes()], "n": [n.tobytes()]})

        found = sample.mapInPandas(count, "counts binary, words binary, n binary").collect()
        return [(np.frombuffer(zlib.decompress(r[0]), np.int32).reshape(-1, len(LANGS)), np.frombuffer(r[1], np.int64), np.frombuffer(r[2], np.int64)) for r in found]

    return _fit_rounds(parts)


def stretches(score: np.ndarray, lengths: np.ndarray) -> list[tuple[int, float]]:
    """Language and confidence of each stretch over the scored pieces of one field: Viterbi with a cost per change."""
    n = len(score)
    best = score[0].astype(float)
    back = np.zeros((n, len(LANGS)), np.int64)
    for t in range(1, n):
        stay, jump = best, best.max() - SWITCH_COST
        back[t] = np.where(stay >= jump, np.arange(len(LANGS)), best.argmax())
        best = np.maximum(stay, jump) + score[t]
    path = [int(best.argmax())]
    for t in range(n - 1, 0, -1):
        path.append(int(back[t][path[-1]]))
    path = path[::-1]
    out = []
    start = 0
    for t in range(1, n + 1):
        if t == n or path[t] != path[start]:
            total = score[start:t].sum(0) / np.sqrt(max(1.0, lengths[start:t].sum()))
            p = np.exp(total - total.max())
            out.append((path[start], float(p[path[start]] / p.sum())))
            start = t
    return out


def label_fields(items: DataFrame, model: Model, source_names: list[str], residue: ExemplarIndex | None = None, fields: tuple[str, ...] = ("title", "summary")) -> DataFrame:
    """``item_id, lang, field, seg_no, seg_lang, confidence`` of every stretch of every row (residue rows left out)."""
    shared = items.sparkSession.sparkContext.broadcast((model.table, model.words))
    names = frozenset(x.lower() for x in source_names)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(*shared.value)
        for pdf in batches:
            if residue:
                bad = [any(residue.holds(x, f == "title") for f, x in zip(fields, row)) for row in zip(*(pdf[f].array for f in fields))]
                pdf = pdf[~np.array(bad, bool)]
            texts: list[str] = []
            owner: list[int] = []  # row * fields + field of every piece
            for f, field in enumerate(fields):
                for r, x in enumerate(pdf[field].array):
                    if x:
                        found = pieces(x)
                        texts += found
                        owner += [r * len(fields) + f] * len(found)
            if not texts:
                continue
            score = m.scores(texts)
            own = np.array(owner)
            order = np.argsort(own, kind="stable")
            own, score = own[order], score[order]
            length = np.array([len(t) for t in texts])[order]
            top = score.argmax(1)
            edge = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True])
            ids, declared_as = pdf["item_id"].array, pdf["lang"].array
            out: list[tuple] = []
            same = np.minimum.reduceat(top, edge[:-1]) == np.maximum.reduceat(top, edge[:-1])
            sums = np.add.reduceat(score, edge[:-1], axis=0)
            size = np.add.reduceat(length, edge[:-1])
            soft = sums / np.sqrt(np.maximum(size, 1))[:, None]
            soft = np.exp(soft - soft.max(1, keepdims=True))
            soft = soft.max(1) / soft.sum(1)
            for g in range(len(edge) - 1):
                a, b = edge[g], edge[g + 1]
                r, f = divmod(int(own[a]), len(fields))
                if same[g]:
                    # a text without a word of any language is mere names
                    if any(m.linguistic(texts[order[i]]) and texts[order[i]].strip().lower() not in names for i in range(a, b)):
                        out.append((ids[r], declared_as[r], fields[f], 1, LANGS[top[a]], soft[g]))
                    continue
                real = [i for i in range(a, b) if texts[order[i]].strip().lower() not in names and m.linguistic(texts[order[i]])]
                if real:
                    for k, (lang, p) in enumerate(stretches(score[real], length[real]), 1):
                        out.append((ids[r], declared_as[r], fields[f], k, LANGS[lang], p))
            yield pd.DataFrame(out, columns=["item_id", "lang", "field", "seg_no", "seg_lang", "confidence"])

    rows = items.filter("item_id is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "lang", *fields)
    return spread(rows).mapInPandas(scan, "item_id bigint, lang string, field string, seg_no int, seg_lang string, confidence double")


def mislabelled(labelled: DataFrame) -> DataFrame:
    """The stretches of rows whose label names no language, one that no part is in, or that hold several languages."""
    names = F.create_map(*[F.lit(x) for kv in LABEL_OF.items() for x in kv])
    head = F.lower(F.regexp_extract(F.trim("lang"), r"^([A-Za-z]+)", 1))
    said = F.try_element_at(names, head)
    per_item = labelled.groupBy("item_id").agg(
        F.collect_set("seg_lang").alias("langs"), F.first(said).alias("said"), F.collect_list(F.struct("field", "seg_no", "seg_lang", "confidence")).alias("segs")
    )  # at most a few stretches an item
    wrong = F.col("said").isNull() | ~F.array_contains("langs", F.coalesce("said", F.lit(""))) | (F.size("langs") > 1)
    return per_item.filter(wrong).select("item_id", F.inline("segs")).select("item_id", "field", "seg_no", F.col("seg_lang").alias("lang"), "confidence")


def language_report(items: DataFrame, sources: DataFrame) -> DataFrame:
    """:func:`label_fields` with the model and the residue index fitted on ``items``."""
    names = [r[0] for r in fixed_rows(sources.select("source_name").filter("source_name is not null").distinct(), 1_000_000, "source names")]
    return label_fields(items, fit_on(items), names, ExemplarIndex(exemplar_weights(items)))
