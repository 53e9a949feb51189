"""Core operators against brute force on small inputs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.operators import items as op
from gleaner.operators import papers as pp
from gleaner.operators import stories as st
from gleaner.operators import views as vw
from gleaner.operators.components import connected_components


def _components(edges):
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(label)}


def test_components_match_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(50)]
    want = _components(edges)
    for shuffled in (edges, rng.sample(edges, len(edges)), [(b, a) for a, b in edges]):
        got = connected_components(spark.createDataFrame(shuffled, "a long, b long"))
        assert {r["vertex"]: r["component"] for r in got.collect()} == want


def test_components_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    got = connected_components(spark.createDataFrame([(7, 7), (None, 3), (1, 2), (1, 2)], "a long, b long"))
    assert {r["vertex"]: r["component"] for r in got.collect()} == {7: 7, 1: 1, 2: 1}


def test_diversified_top_matches_a_scan(spark):
    rng = random.Random(5)
    rows = [(day, i, rng.randrange(9), rng.choice("ab"), rng.choice("pqrs")) for day in range(4) for i in range(day * 100, day * 100 + 60)]
    rows += [(9, 1000 + i, 9, "a", "p") for i in range(700)] + [(9, 5000, 0, "b", "q")]
    want = {}
    for day in {r[0] for r in rows}:
        order = sorted((r for r in rows if r[0] == day), key=lambda r: (-r[2], r[1]))
        taken, kinds, sources = [], {}, {}
        for r in order:
            if len(taken) < 5 and kinds.get(r[3], 0) < 3 and sources.get(r[4], 0) < 2:
                taken.append(r[1])
                kinds[r[3]] = kinds.get(r[3], 0) + 1
                sources[r[4]] = sources.get(r[4], 0) + 1
        taken += [r[1] for r in order if r[1] not in taken][: 5 - len(taken)]
        watch = [r[1] for r in order if r[1] not in taken][:3]
        want |= dict.fromkeys(taken, "featured") | dict.fromkeys(watch, "watch")
    df = spark.createDataFrame(rows, "day int, id long, score int, kind string, source string")
    got = st.diversified_top(df, ["day"], [F.desc("score"), F.asc("id")], {"kind": 3, "source": 2}, 5, 3)
    assert {r["id"]: r["pick"] for r in got.collect()} == want


def _words(t):
    import re

    cut = [re.sub("^([0-9]+)b$", r"\1", w) for w in re.findall("[a-z0-9]+", t.lower()) if w not in text.STOPWORDS]
    return {w for w in cut if len(w) >= 4 or (len(w) >= 3 and w.isdigit())}


def test_title_pairs_and_greedy_dedup(spark):
    rng = random.Random(6)
    vocabulary = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "lambda", "theta"]
    rows = [(i, i % 3, " ".join(rng.sample(vocabulary, rng.randrange(2, 7)))) for i in range(120)] + [(500, 0, None), (501, 0, "")]
    like = lambda a, b: len(a & b) / len(a | b) >= 0.55 or len(a & b) / min(len(a), len(b)) >= 0.8
    w = {i: _words(t or "") for i, _, t in rows}
    pairs = {(a, b) for a in w for b in w if a < b and len(w[a]) >= 2 and len(w[b]) >= 2 and like(w[a], w[b])}
    df = spark.createDataFrame(rows, "id long, day int, title string")
    got = st.word_pairs(df, "id", text.significant_words(F.col("title")), 0.55)
    assert {tuple(r) for r in got.collect()} == pairs
    kept = {}
    for i, day, _ in sorted(rows):
        kept[i] = not any(kept.get(j) and (j, i) in pairs for j, d, _ in rows if d == day and j < i)
    out = st.greedy_title_dedup(df, "day", "id", "title")
    assert {r["id"]: r["kept"] for r in out.collect()} == kept
    seed = {i: next((j for j, d, _ in sorted(rows) if j < i and kept[j] and d == day and (j, i) in pairs), i) for i, day, _ in rows}
    assert {r["id"]: r["seed"] for r in st.seed_clusters(df, "day", "id", "title").collect()} == seed


def _titles(n, days):
    rng = random.Random(12)
    vocabulary = [f"{a}{b}" for a in ("stone", "river", "model", "chip") for b in ("gate", "house", "works", "field", "line")] + ["2024", "131b"]
    rows = [(i, rng.randrange(days), " ".join(rng.sample(vocabulary, rng.randrange(1, 7)))) for i in range(n)]
    rows += [(n + i, None, "stonegate riverhouse") for i in range(3)] + [(n + 9, 0, " ".join(f"word{k}" for k in range(20))), (n + 10, 0, " ".join(f"word{k}" for k in range(11)) + " " + " ".join(f"other{k}" for k in range(9)))]
    return rng.sample(rows, len(rows))


def _scan(rows):
    """The seed of every row, found by looking at the rows in order."""
    seed, kept = {}, {}
    for i, day, t in sorted(rows, key=lambda r: r[0]):
        w = _words(t)
        like = [j for j, u in kept.get(day, []) if len(w) >= 2 and len(u) >= 2 and day is not None and (len(w & u) / len(w | u) >= 0.55 or len(w & u) / min(len(w), len(u)) >= 0.8)]
        seed[i] = like[0] if like else i
        if not like:
            kept.setdefault(day, []).append((i, w))
    return seed


def _shuffled(spark, run):
    """What ``run`` returns, and how many rows its stages wrote for a shuffle."""
    sc = spark.sparkContext._jsc.sc()
    empty = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def written():
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, empty, spark.sparkContext._jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = written()
    return run(), written() - before


def test_seed_clusters_scan_each_group_and_shuffle_rows_only(spark, monkeypatch):
    rows = _titles(900, 12)
    df = spark.createDataFrame(rows, "id long, day int, title string")
    monkeypatch.setattr(st, "PAIRS", 500)
    out, shuffled = _shuffled(spark, lambda: st.seed_clusters(df, "day", "id", "title").collect())
    assert {r["id"]: r["seed"] for r in out} == _scan(rows)
    assert shuffled <= 4 * len(rows)


def test_title_dedup_scans_each_group_and_shuffles_rows_only(spark):
    rows = _titles(1500, 20)
    df = spark.createDataFrame(rows, "id long, day int, title string")
    out, shuffled = _shuffled(spark, lambda: st.greedy_title_dedup(df, "day", "id", "title").collect())
    assert {r["id"]: r["kept"] for r in out} == {i: s == i for i, s in _scan(rows).items()}
    assert shuffled <= 4 * len(rows)
    assert st.greedy_title_dedup(df.filter("id < 0"), "day", "id", "title").count() == 0


def test_normalised_scores(spark):
    raw = [(i, float(x)) for i, x in enumerate([1, 2, 2, 3, 5, 8, 9, 12, 20, 40])]
    s = sorted(x for _, x in raw)
    p50, p95, top = s[4], s[8], s[-1]
    want = {i: max(1, 1 + 4 * x / p50) if x <= p50 else 5 + 4.5 * (x - p50) / (p95 - p50) if x <= p95 else 9.5 + 0.5 * (x - p95) / (top - p95) for i, x in raw}
    got = st.normalise_scores(spark.createDataFrame(raw, "id long, raw double"))
    assert all(abs(r["score"] - want[r["id"]]) < 1e-9 for r in got.collect())
    two = st.normalise_scores(spark.createDataFrame([(1, 4.0), (2, 4.0)], "id long, raw double"))
    assert {r["score"] for r in two.collect()} == {5.0}


def test_history_anti_join_and_merge(spark):
    new = spark.createDataFrame([(1, "u1", "t1"), (2, "u2", "t2"), (3, "u3", "t3")], "id int, u string, t string")
    old = spark.createDataFrame([("u1", "x"), (None, "t2"), ("u9", None)], "u string, t string")
    assert [r["id"] for r in op.not_in_history(new, old, ["u", "t"]).collect()] == [3]
    merged = op.merge_right(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "B"), (3, None)], "k int, v string"), "k", ["v"])
    assert {tuple(r) for r in merged.collect()} == {(1, "a"), (2, "B"), (3, None)}


def test_two_stage_pick_and_caps(spark):
    rows = [(1, i, i % 4, 10 + i % 7) for i in range(30)]
    df = spark.createDataFrame(rows, "day int, id int, nov int, score int")
    got = pp.two_stage_pick(df, "day", (F.col("nov") >= 3, [F.desc("score"), F.asc("id")], 2), (F.col("score") >= 12, [F.desc("score"), F.asc("id")], 3), "id").collect()
    first = [r[1] for r in sorted((r for r in rows if r[2] >= 3), key=lambda r: (-r[3], r[1]))[:2]]
    second = [r[1] for r in sorted((r for r in rows if r[1] not in first and r[3] >= 12), key=lambda r: (-r[3], r[1]))[:3]]
    assert sorted((r["kind"], r["place"], r["id"]) for r in got) == sorted([("first", k + 1, i) for k, i in enumerate(first)] + [("second", k + 1, i) for k, i in enumerate(second)])


def test_median_entropy_rollup(spark):
    df = spark.createDataFrame([("a", 1), ("a", 5), ("a", 3), ("a", 9), ("b", None), ("b", 2)], "g string, v int")
    assert {tuple(r) for r in vw.upper_median(df, ["g"], "v").collect()} == {("a", 5), ("b", 2)}
    counts = spark.createDataFrame([("x", 1), ("x", 1), ("x", 2), ("y", 7)], "g string, n int")
    assert {tuple(r) for r in vw.entropy(counts, ["g"], "n").collect()} == {("x", 1.5), ("y", 0.0)}
    days = spark.createDataFrame([("2026-01-30", 1), ("2026-01-31", 2), ("2026-02-01", 4)], "d string, n int").withColumn("d", F.to_date("d"))
    rolled = vw.calendar_rollup(days, "d", ["n"]).collect()
    assert [r["n"] for r in rolled if r["level"] == 7] == [7] and sorted(r["n"] for r in rolled if r["level"] == 1) == [3, 4]


def test_text_functions(spark):
    df = spark.createDataFrame([("  a  b\n c  ", "x" * 20)], "t string, long string")
    row = df.select(text.clean_text("t").alias("c"), text.clip(F.col("long"), 10).alias("k"), text.slug(F.lit("Hello, World! 2.0")).alias("s"), text.strip_tags(F.lit("<b>a</b> &amp;&nbsp;b")).alias("h")).first()
    assert tuple(row) == ("a b c", "xxxxxxx...", "hello-world-2-0", "a & b")


def test_sequence_similarity(spark):
    from difflib import SequenceMatcher

    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("abcde ") for _ in range(rng.randrange(5, 30))), "".join(rng.choice("abcde ") for _ in range(rng.randrange(5, 30)))) for i in range(300)]
    want = {i: SequenceMatcher(None, a, b).ratio() for i, a, b in rows}
    got = st.sequence_similarity(spark.createDataFrame(rows, "id long, a string, b string"), "a", "b", 0.5).collect()
    assert {r["id"]: round(r["ratio"], 9) for r in got} == {i: round(x, 9) for i, x in want.items() if x >= 0.5}


def test_ratios_are_those_of_difflib():
    from difflib import SequenceMatcher

    from gleaner.operators import sequences

    rng = random.Random(14)
    texts = [("".join(rng.choice(kinds) for _ in range(rng.randrange(1, 40))), "".join(rng.choice(kinds) for _ in range(rng.randrange(1, 40)))) for kinds in ("ab", "abc ", "abcdefgh 日") for _ in range(700)]
    texts += [("ab" * 110 + "c", "ba" * 110), ("x", "y")]
    want = [SequenceMatcher(None, a, b).ratio() for a, b in texts]
    assert sequences.ratios(*zip(*texts), 0.0).tolist() == want
    got = sequences.ratios(*zip(*texts), 0.65)
    assert [r for r in got if r >= 0.65] == [r for r in want if r >= 0.65]


def test_nearest_rank(spark):
    rng = random.Random(10)
    rows = [(g, rng.choice([0.1, 0.5, 2.0, rng.random() * 40])) for g in "ab" for _ in range(rng.randrange(40, 90))] + [("c", 3.0)]
    got = {r["g"]: r for r in st.nearest_rank(spark.createDataFrame(rows, "g string, v double"), "v", {"p50": 0.5, "p95": 0.95}, ["g"]).collect()}
    for g in "abc":
        s = sorted(v for k, v in rows if k == g)
        assert (got[g]["p50"], got[g]["p95"], got[g]["top"], got[g]["total"]) == (s[max(1, int(len(s) * 0.5)) - 1], s[max(1, int(len(s) * 0.95)) - 1], s[-1], len(s))
