"""Writers that keep days linked, daily and monthly documents, prompts and answers, titles alike as sequences."""

from __future__ import annotations

import datetime as dt
import json
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from gleaner.operators import papers as pp
from gleaner.operators import stories as st
from gleaner.plans import prompts as pr
from gleaner.sources import listings, readers, sinks


def day(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def test_days_are_linked_anew(spark, tmp_path):
    path = str(tmp_path / "web")
    make = lambda rows: spark.createDataFrame([(day(a), n) for a, n in rows], "date date, topics long")
    read = lambda: {str(r["date"]): (r["topics"], str(r["previous"]), str(r["next"])) for r in spark.read.json(f"{path}/days", schema="topics long, previous date, next date, date date").collect()}
    sinks.write_days(make([("2026-03-17", 2), ("2026-03-20", 3), ("2025-01-01", 9)]), path, ["topics"], first="2026-03-17")
    assert read() == {"2026-03-17": (2, "None", "2026-03-20"), "2026-03-20": (3, "2026-03-17", "None")}
    sinks.write_days(make([("2026-03-18", 5), ("2026-03-20", 4), ("2026-04-01", 1)]), path, ["topics"], first="2026-03-17")
    assert read() == {"2026-03-17": (2, "None", "2026-03-18"), "2026-03-18": (5, "2026-03-17", "2026-03-20"), "2026-03-20": (4, "2026-03-18", "2026-04-01"), "2026-04-01": (1, "2026-03-20", "None")}
    index = {(r["level"], r["year"], r["month"]): (r["rows"], r["topics"]) for r in spark.read.json(f"{path}/index").collect()}
    assert index == {("root", None, None): (4, 12), ("year", 2026, None): (4, 12), ("month", 2026, "2026-03"): (3, 11), ("month", 2026, "2026-04"): (1, 1)}
    sinks.write_days(make([("2026-03-18", 6)]), path, ["topics"], first="2026-04-01")  # the earlier days are no longer supported
    assert read() == {"2026-04-01": (1, "None", "None")} and {r["month"] for r in spark.read.json(f"{path}/index").filter("level = 'month'").collect()} == {"2026-04"}


def test_daily_papers_in_both_shapes(spark, tmp_path):
    path = str(tmp_path / "daily")
    rows = [(day("2026-03-20"), "1", "A", "t1"), (day("2026-03-20"), "2", "B", "t2"), (day("2026-03-20"), "3", "C", "t2"), (day("2026-03-21"), "4", "D", None)]
    sinks.write_daily_papers(spark.createDataFrame(rows, "date date, number string, title string, topic string"), path)
    back = spark.read.text(path)
    for kind in ("output", "daily-papers"):
        got = readers.papers_of(back.filter(F.col("kind") == kind), "value", "struct<title: string>").filter("title is not null").collect()
        assert sorted((r["number"], r["title"]) for r in got) == [("1", "A"), ("2", "B"), ("3", "C"), ("4", "D")]
    bundle = json.loads(back.filter("kind = 'daily-papers' and date = '2026-03-20'").first()["value"])
    assert bundle["schema_version"] == 2 and [(s["kind"], s["paper_ids"]) for s in bundle["sections"]] == [("t2", ["2", "3"]), ("t1", ["1"])]
    files = back.select("date", F.lit("papers").alias("kind"), F.col("value").alias("payload")).filter("kind is not null")
    assert listings.local_papers(files.filter(F.col("payload").contains("schema_version")), F.lit("2026-03-20").cast("date")).count() == 3


def test_monthly_summary(spark):
    rows = [("2026-03", "a", 5, None), ("2026-03", "b", 9, True), ("2026-03", "c", 10, False), ("2026-04", "d", None, True)]
    got = sinks.monthly_summary(spark.createDataFrame(rows, "month string, number string, SCORE int, KEEP_IN_MONTHLY boolean"), ["SCORE"])
    assert sorted((r["number"], r["place"]) for r in got.collect()) == [("a", 2), ("b", 1), ("d", 1)]


def test_prompts(spark):
    rows = spark.createDataFrame([("d", f"{i:03d}", f"Title  {i}", "abs " * 2000) for i in range(70)], "day string, number string, title string, abstract string")
    got = pr.batched(rows, "day", "number", 32)
    sizes = sorted(r["n"] for r in got.groupBy("batch").agg(F.count("*").alias("n")).collect())
    assert sizes == [70]  # 32 * ceil(log2(70 / 32) + 1) = 96
    made = pr.prompts(pr.batched(rows.limit(5), "day", "number", 2), "day", "Which?", pr.title_line()).orderBy("batch").collect()
    assert [r["prompt"] for r in made] == ["Which?\n000: Title 0\n001: Title 1", "Which?\n002: Title 2\n003: Title 3", "Which?\n004: Title 4"]
    block = rows.limit(1).select(pr.abstract_line().alias("x")).first()["x"]
    assert block.startswith("ArXiv ID: 000\nTitle: Title 0\nAbstract: abs") and len(block) < 4100


def test_answers(spark):
    rows = spark.createDataFrame([("1",), ("2",), ("3",)], "number string")
    answers = spark.createDataFrame([('```json\n["2"]\n```',), ("no list",), (None,)], "a string")
    kept, rejected = pr.split_by_answer(rows, answers, "number", "a")
    assert sorted(r[0] for r in kept.collect()) == ["1", "3"] and [r[0] for r in rejected.collect()] == ["2"]
    text = '```jsonl\n{"ARXIVID": "1", "RELEVANCE": 8, "NOVELTY": "7/10", "COMMENT": " good  one ",}\nnot json\n{"ARXIVID": "1", "RELEVANCE": 1}\n{"ARXIVID": "2", "RELEVANCE": "none"}\n```'
    got = {r["number"]: tuple(r)[1:] for r in pr.scores_of(spark.createDataFrame([(text,), (None,)], "a string"), "a").collect()}
    assert got == {"1": (8, 7, "good one"), "2": (None, None, "")}


def test_translations(spark):
    rows = spark.createDataFrame([(1, "Hello", "World"), (2, "Hello", None), (3, " ", "Left")], "id int, title string, summary string")
    todo = pr.texts_of(rows, ["title", "summary"])
    assert sorted(r["body"] for r in todo.collect()) == ["Hello", "Left", "World"]
    done = todo.withColumn("body", F.when(F.col("body") == "Hello", "Hallo").when(F.col("body") == "World", "").otherwise(None))
    got = sorted(tuple(r) for r in pr.translated(rows, ["title", "summary"], done).select("id", "title", "summary").collect())
    assert got == [(1, "Hallo", "World"), (2, "Hallo", None), (3, " ", "Left")]


def test_near_titles_match_brute_force(spark):
    rng = random.Random(3)
    words = "acme buys tech podcast maker falcon sparrow heron lands river stone weekly notes model".split()
    rows = []
    for i in range(160):
        t = " ".join(rng.sample(words, 5))
        rows.append((i, rng.randrange(4), t if rng.random() < 0.7 else t.replace("a", "e", 1).upper(), rng.random() < 0.3))
    rows += [(900, 1, None, False), (901, 1, "", False)]
    df = spark.createDataFrame(rows, "id long, day int, title string, paper boolean")
    sig = lambda t: {w for w in t.lower().split() if len(w) >= 4}
    for apart in (0, 1):
        got = {(r["a"], r["b"]): r["ratio"] for r in st.near_titles(df, "id", "day", "title", 0.65, apart, F.col("paper")).collect()}
        want = {
            (i, j): r for i, g, a, p in rows for j, h, b, q in rows
            if a and b and h - g == apart and (i < j if apart == 0 else i != j) and not (p and q) and sig(a) & sig(b) and (r := SequenceMatcher(None, a.lower(), b.lower()).ratio()) >= 0.65
        }
        assert got == want and want


def test_content_hash_tells_changes(spark):
    rows = [("g", 1, "a"), ("g", 2, "b"), ("h", 1, None)]
    hashes = lambda r: {x["g"]: x["hash"] for x in pp.content_hash(spark.createDataFrame(r, "g string, k int, v string"), "g", "k", ["v"]).collect()}
    base = hashes(rows)
    assert hashes(rows[::-1]) == base
    assert hashes([("g", 1, "b"), ("g", 2, "a"), ("h", 1, "")])["g"] != base["g"] and hashes([("g", 1, "a"), ("g", 2, "b"), ("h", 1, "")])["h"] != base["h"]
    assert hashes([*rows, ("g", 2, "b")])["g"] != base["g"]


def test_near_titles_need_no_shared_word(spark, monkeypatch):
    rng = random.Random(8)
    stems = ["gleaming", "lanterns", "quartzes", "harbours", "monitors", "за кулисами хранилища", "动く画像を試した結果", "e" * 70, "ab" * 110]
    rows = []
    for i in range(150):
        t = " ".join(rng.sample(stems, rng.randrange(1, 4)))
        for _ in range(rng.randrange(1 + len(t) // 6)):
            p = rng.randrange(len(t))
            t = t[:p] + rng.choice(["", "z", t[p] + "y"]) + t[p + 1 :]
        rows.append((i, i % 3, t, rng.random() < 0.2))
    df = spark.createDataFrame(rows, "id long, day int, title string, paper boolean")
    for block in (st.NEAR, 20):  # whole groups, and groups cut into blocks
        monkeypatch.setattr(st, "NEAR", block)
        for apart, least in ((0, 0.65), (1, 0.7)):
            got = st.near_titles(df, "id", "day", "title", least, apart, F.col("paper")).collect()
            want = {
                (i, j): r for i, g, a, p in rows for j, h, b, q in rows if h - g == apart and (i < j if apart == 0 else i != j) and not (p and q)
                and a.strip() and b.strip() and (r := SequenceMatcher(None, a.strip(" ").lower(), b.strip(" ").lower()).ratio()) >= least
            }
            assert {(r["a"], r["b"]): r["ratio"] for r in got} == want and len(got) == len(want)


def test_title_sequences_look_at_every_pair(spark, tmp_path):
    from gleaner.queries.stories import q_title_sequences

    rows = [(1, 1, "tweet", "За кулисами хранилища"), (2, 1, "tweet", "за кулисами хранилищ "), (3, 1, "paper", "動く画像を試した結果"), (4, 1, "paper", "動く画像を試す結果"), (5, 2, "tweet", "動く画像を試した結果"), (6, 1, "blog", "a b c d"), (7, 1, "paper", "a b c e")]
    spark.createDataFrame(rows, "item_id long, batch_id int, source_type string, title string").write.parquet(f"{tmp_path}/hotspot_items.parquet")
    got = {(r["a"], r["b"]): r["ratio"] for r in q_title_sequences(spark, str(tmp_path)).collect()}
    assert got == {(i, j): round(SequenceMatcher(None, rows[i - 1][3].strip().lower(), rows[j - 1][3].strip().lower()).ratio(), 4) for i, j in ((1, 2), (6, 7))}
