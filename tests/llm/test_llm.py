"""The operators of the llm package against brute force, round trips and held-out accuracy, with their edge cases."""

from __future__ import annotations

import random
from collections import defaultdict
from itertools import groupby
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import history, language, leaks, neardup, packing, queries_p6, residue, subjects
from gleaner.llm.shingles import shingle_hashes

DATA = Path("/root/testdata/sf0.001")
ITEM = "item_id long, batch_id int, source_id string, title string, summary string, canonical_url string, lang string"
WORDS = "amber birch cedar delta ember fjord grove hazel inlet jetty knoll larch maple north ocean pearl quartz ridge stone tidal umber vale willow xenon yarrow zephyr".split()


def sentence(rng: random.Random, n: int = 12) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", str(rng.randrange(100))]) for _ in range(n)).capitalize() + "."


def items(spark, rows):
    return spark.createDataFrame([(i, 1, "s", t, s, None, None) for i, t, s in rows], ITEM)


# --- residue -----------------------------------------------------------------------------------------------------------

RESIDUE_CASES = [
    ("404 Not Found", None, {"title"}), ("{{ post.title }}", "Real text about rivers and towns.", {"title"}), ("%%KICKER%% A real title follows here", None, {"title"}),
    ("Page not found - host.example", None, {"title"}), ("null", None, {"title"}), ("Untitled document 72", None, {"title"}), ("Seite nicht gefunden – host.test", None, {"title"}),
    ("A real title", "First sentence of a story. Please turn on JavaScript and cookies, then reload host.test.", {"summary"}),
    ("A real title", "The board met {summary_text} on Monday to talk about the budget.", {"summary"}), ("A real title", "请启用 JavaScript 后再访问 host.example。", {"summary"}),
    ("A real title", "Lorem ipsum dolor sit amet elit sed do. The rest is real.", {"summary"}), ("A real title", "Die Seite /a-b wurde nicht gefunden.", {"summary"}),
    ("Lorem ipsum is bad test data, says Ada of Acme", "A parser by Acme treats ${{path}} and %path% alike.", set()),
    ("How agents freeze on a 404 page and how Acme recovers", "The outage returned error 503 to 500 customers for an hour.", set()),
    ("Junmil 7.3", "", set()), (None, None, set()), ("", "   ", set()), ("Why null results matter", "In Acme, a template such as {{name}} is checked before it is sent.", set()),
    ("A long one", "Plain words about nothing special. " * 3000, set()), ("A long one", "Plain words about nothing special. " * 3000 + "Your text goes here.", {"summary"}),
]


def test_residue_cases(spark):
    df = items(spark, [(i, t, s) for i, (t, s, _) in enumerate(RESIDUE_CASES)])
    df = df.union(df)  # repeated rows each give theirs
    got = defaultdict(list)
    for r in residue.find_residue(df).collect():
        got[r["item_id"]].append(r["field"])
    assert {i: sorted(set(f)) for i, f in got.items()} == {i: sorted(w) for i, (_, _, w) in enumerate(RESIDUE_CASES) if w}
    assert all(len(f) == 2 * len(set(f)) for f in got.values())


# texts of other systems and other wordings, none of them an exemplar or a text of the test tables
HELD_OUT = [
    "We're sorry, the page you requested could not be found.", "This page isn't available. The link you followed may be broken, or the page may have been removed.", "Sorry, the page you are looking for does not exist.", "Error 404 - page not found on this server", "JavaScript must be enabled in your browser to view this page.",
    "Please enable JavaScript in your browser to use this site.", "You must enable cookies and JavaScript to continue.", "Die angeforderte Seite wurde nicht gefunden.", "Bitte aktivieren Sie JavaScript in Ihrem Browser.", "La page demandée est introuvable.", "No hemos podido encontrar la página que busca.", "Sorry, an error occurred while processing your request.",
    "503 Service Unavailable", "The server encountered an internal error.", "504 Gateway Timeout", "Please verify that you are a human.", "Your session has expired, please log in.", "Access to this page has been denied.", "Please check the box below to continue.", "Too many requests, please try again later.",
    "Insert your text here", "Sample page title", "This is a sample post.", "Type your text here", "Lorem ipsum dolor sit amet, consectetur", "Dear {{customer.name}},", "Hello ${first_name}!", "[Insert image]", "<%- body %>", "Welcome to %%SITE_NAME%%", "Untitled post", "出现未知错误", "ページが見つかりませんでした", "Страница не найдена на сервере",
]
REAL = [
    "The court found that the page had been removed from the file.", "Engineers enable cookies for a bakery chain.", "A server room went without power for an hour.", "How to write a good title for a sample of text", "Robots learn to open boxes without human help.", "The board denied access to the archive last year.",
    "Requests for housing aid reach a record", "The session on river engineering has been moved to Monday.", "Null results matter in medicine", "The error bars in the chart are wider than expected.", "She was first to post a time under two minutes.", "Un error del árbitro decide el partido", "Die Seite des Vereins feiert Jubiläum.", "La page la plus lue de l'année",
    "Learn how the syntax ${name} stands for a variable.", "The template engine replaces a placeholder such as {{name}} with its value.", "Prices rose by 5 % and wages by 3 % [1].", "A set {a, b} is open", "Scores of [2, 3] and <5", "x < y and y > z", "他们发现页面设计影响阅读", "新しいページの設計が評価された",
]


def test_residue_held_out():
    index = residue.ExemplarIndex({})
    assert not {x.rstrip(".!").lower() for x in HELD_OUT} & {x.rstrip(".!").lower() for xs in residue.RESIDUE.values() for x in xs}
    missed = [x for x in HELD_OUT if not index.holds(x, True)]
    assert len(missed) <= 0.2 * len(HELD_OUT), missed
    assert not [x for x in REAL if index.holds(x, True)]


def test_residue_prefix_loses_nothing():
    """Whatever the scoring accepts, the prefix filter passes: windows drawn at random from the exemplars' own words."""
    rng = random.Random(5)
    index = residue.ExemplarIndex({t: rng.uniform(0.5, 9) for t in residue.VOCABULARY})
    kinds = [k for k in residue.RESIDUE if k != "slot"]
    accepted = 0
    for _ in range(4000):
        words = [w for x in rng.sample(residue.RESIDUE[rng.choice(kinds)], 1) for w in residue.tokens(x)]
        window = " ".join(rng.sample(words, rng.randrange(1, len(words) + 1)))
        contained, _ = index.best(residue.tokens(window))
        if contained >= index.containment:
            accepted += 1
            assert index.anchored(window), window
    assert accepted > 1000


def test_residue_empty_table(spark):
    assert residue.find_residue(items(spark, [])).count() == 0


# --- near-duplicates ---------------------------------------------------------------------------------------------------


def shingles(t: str, s: str) -> frozenset[str]:
    x = " ".join(f"{t} {s}".lower().split())
    return frozenset(x[i : i + 5] for i in range(len(x) - 4))


def brute_pairs(rows, least=0.7):
    sets = {i: shingles(t, s) for i, t, s in rows if t and s and t.strip() and s.strip()}
    text = {i: " ".join(f"{t} {s}".lower().split()) for i, t, s in rows if i in sets}
    return {(a, b) for a in sets for b in sets if a < b and (text[a] == text[b] or sets[a] | sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least)}


def edited(rng, s: str) -> str:
    w = s.split()
    for _ in range(rng.randrange(1, 3)):
        k = rng.randrange(len(w))
        w[k] = w[k][1:] or w[k]
    return " ".join(w)


def test_pairs_match_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    rows, n = [], 0
    for _ in range(60):
        t, s = sentence(rng, 6), " ".join(sentence(rng) for _ in range(4))
        for _ in range(rng.randrange(1, 4)):
            rows.append((n := n + 1, t, edited(rng, s)))
    hot = " ".join(sentence(rng) for _ in range(5))
    for _ in range(90):  # a third of all rows: copies and edits of one story
        rows.append((n := n + 1, "Hot story of the day", rng.choice([hot, edited(rng, hot), hot.upper(), "  " + hot])))
    rows += [(n + 1, None, "x"), (n + 2, "a", ""), (n + 3, "a", "b"), (n + 4, "A", " b "), (n + 5, "Long", "word " * 20_000), (n + 6, "Long", "word " * 20_000)]
    want = brute_pairs(rows)
    for run, hot in ((neardup.RUN, neardup.HOT), (8, neardup.HOT), (8, 4)):  # long runs are cut into blocks; frequent keys are refined before the shuffle
        monkeypatch.setattr(neardup, "RUN", run)
        monkeypatch.setattr(neardup, "HOT", hot)
        monkeypatch.setattr(neardup, "COPIES", 4096 if run > 8 else 5)
        got = neardup.all_pairs(*neardup.near_classes(items(spark, rows))).collect()
        pairs = {tuple(r) for r in got}
        assert len(got) == len(pairs) and pairs <= want
        assert len(pairs) >= 0.99 * len(want)


def test_pairs_of_nothing(spark):
    df = items(spark, [])
    assert neardup.all_pairs(*neardup.near_classes(df)).count() == 0


def test_chunk_errors_keep_the_guarantee():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**32, (400, neardup.SYMBOLS), dtype=np.uint32)
    b = a.copy()
    for row in b:
        at = rng.choice(neardup.SYMBOLS, neardup.DISTANCE, replace=False)
        row[at] = rng.integers(0, 2**32, neardup.DISTANCE, dtype=np.uint32)
    assert (neardup.chunk_keys(a) == neardup.chunk_keys(b)).any(1).all()


def test_refined_keys_keep_the_guarantee():
    """Rows that share one chunk and differ in all allowed symbols of the others still meet."""
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**32, (400, neardup.SYMBOLS), dtype=np.uint32)
    b = a.copy()
    for row in b:
        at = 5 + rng.choice(neardup.SYMBOLS - 5, neardup.DISTANCE, replace=False)
        row[at] = rng.integers(0, 2**32, neardup.DISTANCE, dtype=np.uint32)
    ka, kb = neardup.chunk_keys(a)[:, 0], neardup.chunk_keys(b)[:, 0]
    assert (ka == kb).all() and (neardup.refined_keys(ka, a, 0) == neardup.refined_keys(kb, b, 0)).any(1).all()


def test_hot_keys_are_all_found(spark):
    rows = [(7, b"1" + (300).to_bytes(8, "little")), (7, b"1" + (900).to_bytes(8, "little")), (8, b"1" + (100).to_bytes(8, "little")), (9, b"2" + (9000).to_bytes(8, "little"))]
    once, twice = neardup.hot_keys(spark.createDataFrame(rows, "d long, sig binary"), 200_000)
    assert once.tolist() == [] and twice.tolist() == [9]
    keys = np.random.default_rng(1).integers(0, 1 << 60, (5000, 25))
    keys[:40, 3] = 11
    assert neardup.heavy_keys(keys)[0].tolist() == [11]


def test_compact_distance_and_hashes():
    sig = np.random.default_rng(0).integers(0, 2**32, (50, neardup.SYMBOLS), dtype=np.uint32)
    low, rest = neardup.compact(sig)
    assert (neardup.compact_distance(rest.view(np.int64), low, rest.view(np.int64), low) == 0).all()
    doc, h = shingle_hashes(["abcdef", "", "abcde", "日本語テキスト"], 5)
    assert doc.tolist() == [0, 0, 2, 3, 3, 3] and h[0] == h[2]


# --- batches against history -------------------------------------------------------------------------------------------

ADDRESSES = [
    ("https://Host.example/a/b", "http://www.host.example:80/a//b/?utm_source=x&fbclid=1#top"), ("https://host.example/a-b", "https://m.host.example/a%2Db/"),
    ("https://host.example/i?id=1&b=2", "https://host.example/i?b=2&gclid=z&id=1"), ("https://host.example/x", "https://user@host.example:443/x?ref=a"),
]


def test_addresses(spark):
    df = spark.createDataFrame([(a, b) for a, b in ADDRESSES] + [("https://h.example/i?id=1", "https://h.example/i?id=2"), (None, ""), ("   ", "#x")], "a string, b string")
    got = df.select(history.canonical_address(F.col("a")).alias("a"), history.canonical_address(F.col("b")).alias("b")).collect()
    assert all(r["a"] == r["b"] and r["a"] for r in got[: len(ADDRESSES)])
    assert got[-3]["a"] != got[-3]["b"] and got[-2]["a"] is None and got[-2]["b"] is None and got[-1]["a"] is None


def test_paper_numbers(spark):
    texts = ["1903.31663", "arxiv:2607.67440v3", "ARXIV: 2112.19803", " 2509.25717 ", "1908.30733 [cs.LG]", "http://p.example/pdf/1909.12692v3.pdf", "p.example/abs/2303.29877/", "math.GT/0309136v2", None, "", "none"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(history.paper_number(F.col("t"))).collect()]
    assert got == ["1903.31663", "2607.67440", "2112.19803", "2509.25717", "1908.30733", "1909.12692", "2303.29877", "math.gt/0309136", None, None, None]


def test_titles(spark):
    same = ["A first look at Xan, and more", "[Update] a first look at Xan and more", "RT: A First Look at Xan and More!", "A first look at Xan and more — Own Blog", "«A first  look at Xan and more»"]
    got = spark.createDataFrame([(t,) for t in [*same, None, "  ", "A first look at Xan and more (part 2)"]], "t string").select(history.title_core(F.col("t"), ["Own Blog"])).collect()
    assert {r[0] for r in got[: len(same)]} == {"a first look at xan and more"} and got[5][0] is None and got[6][0] is None and got[7][0] != got[0][0]


@pytest.mark.parametrize("x,y,same", [("a share of it", "a shrae of it", True), ("open interfaces", "open interface", True), ("part 1 of it", "part 2 of it", False), ("abc", "abc", False), ("one word", "two word", False), ("new linee", "new line", True)])
def test_one_misspelling(x, y, same):
    assert history.one_misspelling(x, y) is same


def test_batches_match_a_scan(spark, tmp_path):
    rng = random.Random(2)
    titles = [sentence(rng, 7)[:-1] for _ in range(40)]
    rows = []
    for i in range(400):
        t = titles[0] if rng.random() < 0.33 else rng.choice(titles)
        if rng.random() < 0.3:
            k = rng.randrange(2, len(t) - 2)
            t = t[:k] + t[k + 1] + t[k] + t[k + 2 :]
        u = f"https://h.example/{rng.randrange(150)}" if rng.random() < 0.8 else None
        rows.append((i, rng.randrange(1, 25), "s", t if rng.random() < 0.95 else None, "text", u, None))
    df = spark.createDataFrame(rows, ITEM)
    known = {r["key"]: r for r in history.item_identities(df, []).collect()}
    want, accepted = {}, []
    for _, group in groupby(sorted(rows, key=lambda r: (r[1], r[0])), key=lambda r: r[1]):
        fresh = []
        for r in group:
            me = known[r[0]]
            like = [k for k in accepted if me["u"] is not None and known[k]["u"] == me["u"] or me["t"] is not None and (known[k]["t"] == me["t"] or known[k]["core"] and history.one_misspelling(known[k]["core"], me["core"]))]
            if like:
                want[r[0]] = min(like)
            else:
                fresh.append(r[0])
        accepted += fresh
    sources = spark.createDataFrame([("s", "Own Blog")], "source_id string, source_name string")
    got = history.repeated_items(df, sources)
    assert {r["key_b"]: r["key_a"] for r in got.collect()} == want
    # batch by batch over a stored table: the same rows are found
    found, path = {}, str(tmp_path / "history")
    history.write_table(history.batch_rows(df.limit(0), sources), path, "overwrite")
    stored = spark.read.schema(history.batch_rows(df, sources).withColumn("range", F.lit(0)).schema)
    for batch in range(1, 8):
        repeats, new = history.check_batch(history.batch_rows(df.filter(F.col("batch_id") == batch), sources), stored.parquet(path))
        found |= {r["key_b"]: r["key_a"] for r in repeats.collect()}
        history.write_table(new, path)
    assert found == {b: a for b, a in want.items() if rows[b][1] < 8}
    assert len({p.name for p in (tmp_path / "history").glob("range=*")}) > 3
    last = max(r[1] for r in rows)
    assert {r["key_b"]: r["key_a"] for r in history.last_batch(df, sources, str(tmp_path / "other")).collect()} == {b: a for b, a in want.items() if rows[b][1] == last}


def test_pivot_keys_lose_no_misspelling():
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyzäéñыя漢字のあ"
    for _ in range(600):
        x = "".join(rng.choice(letters + "0123456789") for _ in range(rng.randrange(2, 40)))
        k = rng.randrange(len(x))
        y = rng.choice([x[:k] + rng.choice(letters) + x[k:], x[:k] + rng.choice(letters) + x[k + 1 :], x[:k] + x[k + 1 :], x[:k] + x[k : k + 2][::-1] + x[k + 2 :]])
        if history.one_misspelling(x, y):
            distances, sums, keys = history.pivot_distances([x, y])
            assert (keys[0] == keys[1]).any()
            assert abs(distances[0] - distances[1]).sum() <= 2 and (abs(sums[0] - sums[1]) <= 1).all() and abs(int(distances[0].sum()) - int(distances[1].sum())) <= 1
    _, _, keys = history.pivot_distances(["part 1 of it", "part 2 of it", ""])
    assert not (keys[0] == keys[1]).any()  # another figure is another title


def test_batches_of_nothing(spark):
    sources = spark.createDataFrame([], "source_id string, source_name string")
    assert history.repeated_items(items(spark, []), sources).count() == 0
    papers = spark.createDataFrame([(1, 1, None), (2, 2, None), (3, 1, "2101.00001"), (4, 2, "arXiv:2101.00001v2"), (5, 2, "2101.00001"), (6, 1, "2101.00001")], "paper_id long, batch_id int, arxiv_id string")
    assert {tuple(r) for r in history.repeated_papers(papers).collect()} == {(3, 4), (3, 5)}


# --- language ----------------------------------------------------------------------------------------------------------

TEXTS = {
    "en": "The committee said that the new rules would apply to all of the companies from next year, although some of them have asked for more time.",
    "de": "Der Ausschuss teilte mit, dass die neuen Regeln ab dem nächsten Jahr für alle Firmen gelten, obwohl einige von ihnen mehr Zeit wollen.",
    "fr": "Le comité a indiqué que les nouvelles règles seront appliquées à toutes les entreprises dès l'année prochaine, même si certaines veulent plus de temps.",
    "es": "El comité dijo que las nuevas reglas se aplicarán a todas las empresas desde el próximo año, aunque algunas de ellas han pedido más tiempo.",
    "pt": "O comité disse que as novas regras serão aplicadas a todas as empresas a partir do próximo ano, embora algumas delas já tenham pedido mais tempo.",
    "it": "Il comitato ha detto che le nuove regole saranno applicate a tutte le aziende dal prossimo anno, anche se alcune di loro hanno chiesto più tempo.",
    "ru": "Комитет сообщил, что новые правила будут действовать для всех компаний со следующего года, хотя некоторые из них просят больше времени.",
    "zh": "委员会表示，新规则将从明年起适用于所有公司，尽管其中一些公司要求更多的时间。",
    "ja": "委員会は、来年からすべての会社に新しい規則を適用すると述べたが、一部の会社はもっと時間を求めている。",
}


@pytest.fixture(scope="module")
def model():
    return language.fit([(lang, None, x) for lang, x in TEXTS.items()])


def test_languages_and_stretches(spark, model):
    rows = [(i, 1, "s", None, x, None, {"en": "en-GB", "zh": "Chinese"}.get(lang, lang)) for i, (lang, x) in enumerate(TEXTS.items())]
    rows += [
        (20, 1, "s", "Junmil 7.3", None, None, "en"), (21, 1, "s", None, "", None, None), (22, 1, "s", "fengidex/fenzush", " ", None, "en"),
        (23, 1, "s", None, TEXTS["en"] + "\n" + TEXTS["ru"] + " " + TEXTS["en"], None, "en"), (24, 1, "s", None, TEXTS["fr"], None, "xx"), (25, 1, "s", None, TEXTS["fr"], None, "de"),
        (26, 1, "s", None, (TEXTS["it"] + " ") * 300, None, None),
    ]
    labelled = language.label_fields(spark.createDataFrame(rows, ITEM), model, ["Own Blog"])
    got = defaultdict(list)
    for r in labelled.collect():
        got[r["item_id"]].append((r["seg_no"], r["seg_lang"]))
        assert 0 < r["confidence"] <= 1
    assert [got[i] for i in range(9)] == [[(1, lang)] for lang in TEXTS]
    assert 20 not in got and 21 not in got and 22 not in got
    assert sorted(got[23]) == [(1, "en"), (2, "ru"), (3, "en")] and got[26] == [(1, "it")]
    wrong = {r["item_id"] for r in language.mislabelled(labelled).collect()}
    assert wrong == {23, 24, 25, 26}


def test_labels():
    assert [language.declared(x) for x in ("en_GB", "zh_Hans", "German", "por", "JA", "und", "", None, "xx")] == ["en", "zh", "de", "pt", "ja", None, None, None, None]


@pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")
def test_held_out_accuracy(spark):
    rows = spark.read.parquet(str(DATA.parent / "sf0.01/hotspot_items.parquet")).select("lang", "title", "summary").filter("summary is not null").collect()
    pairs = [(language.declared(r["lang"]), r["title"], r["summary"]) for r in rows]
    pairs = [p for p in pairs if p[0]]
    m = language.fit(pairs[::2])
    test = pairs[1::2]
    guess = [language.LANGS[k] for k in m.scores([s for _, _, s in test]).argmax(1)]
    # a share of the declared labels is wrong or names one language of a mixed text
    assert sum(g == p[0] for g, p in zip(guess, test)) / len(test) > 0.85


# --- leaks -------------------------------------------------------------------------------------------------------------


def test_fm_index_finds_what_a_scan_finds():
    rng = np.random.default_rng(5)
    text = np.concatenate([rng.integers(1, 9, 3000), np.tile(rng.integers(1, 9, 40), 20)])
    index = leaks.FMIndex(text, 9)
    for n in (1, 2, 3, 5):
        phrases = np.unique(rng.integers(1, 9, (60, n)), axis=0)
        which, place = index.locate(*index.search(phrases))
        got = sorted(zip(which.tolist(), place.tolist()))
        want = sorted((i, p) for i, ph in enumerate(phrases) for p in range(len(text) - n + 1) if (text[p : p + n] == ph).all())
        assert got == want


def test_leaks(spark):
    rng = random.Random(8)
    passages = [(i, " ".join(sentence(rng, 14) for _ in range(4))) for i in range(12)]
    filler = lambda n: " ".join(sentence(rng) for _ in range(n))
    part = lambda i, a, b: " ".join(passages[i][1].split()[a:b])
    n = len(passages[0][1].split())
    docs = {
        1: filler(20) + " " + passages[0][1] + " " + filler(20), 2: filler(5) + " " + part(1, 0, int(n * 0.7)).upper() + "! " + filler(4), 3: filler(8) + part(2, 0, int(n * 0.3)) + filler(8),
        4: part(3, 0, n // 2).replace(" ", " \n> ") + " " + filler(3) + " " + part(3, n // 2, n), 5: "<p>" + part(4, 0, n).replace(" ", "&nbsp;</b> <b>") + "</p>",
        6: " ".join(w if k % 8 else "other" for k, w in enumerate(passages[5][1].split())), 7: None, 8: "", 9: "short", 10: filler(3000) + " " + passages[6][1] + " " + filler(3000),
    }
    rows = [(k, v) for k, v in docs.items()] + [(100 + k, docs[1]) for k in range(40)]  # a hot copy
    evals = spark.createDataFrame([*passages, (50, None), (51, "two words")], "eval_id long, passage string")
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("eval_id", F.lit("clash"))
    got = sorted((r["doc_id"], r["eval_id"]) for r in leaks.find_leaks(df, evals).collect())
    assert got == sorted([(1, 0), (2, 1), (4, 3), (5, 4), (6, 5), (10, 6)] + [(100 + k, 0) for k in range(40)])
    assert leaks.find_leaks(df.limit(0), evals).count() == 0 and leaks.find_leaks(df, evals.limit(0)).count() == 0
    spans = {r["doc_id"]: r for r in leaks.removal_spans(df, evals).collect()}
    assert set(spans) == {d for d, _ in got}
    for d, k in got:
        taken = (docs.get(d) or docs[1])[spans[d]["begin"] : spans[d]["end"]]
        assert spans[d]["eval_ids"] == [k]
        want = leaks.words(passages[k][1])
        assert leaks.held_words(*map(np.array, ([hash(w) for w in want], [hash(w) for w in leaks.words(taken)])))[0] >= len(want) / 2
        assert len(leaks.words(taken)) <= 1.2 * len(want) + (60 if d == 4 else 0)  # no more is removed than the stretch


def test_spans_of_overlapping_leaks_are_merged(spark):
    rng = random.Random(12)
    a, b, c = (" ".join(sentence(rng, 12) for _ in range(3)) for _ in range(3))
    text = f"Before it. {a} {b} In between there are other words. " + " ".join(sentence(rng) for _ in range(60)) + f" {c} {c[: len(c) // 3]}"
    both = f"{a} {b}"  # an item that covers two others
    evals = spark.createDataFrame([(1, a), (2, b), (3, both), (4, c)], "eval_id long, passage string")
    rows = sorted(leaks.removal_spans(spark.createDataFrame([(7, text)], "doc_id long, text string"), evals).collect())
    assert [r["eval_ids"] for r in rows] == [[1, 2, 3], [4]]
    assert text[rows[0]["begin"] : rows[0]["end"]].strip() == both and text[rows[1]["begin"] : rows[1]["end"]].startswith(c)


@pytest.mark.parametrize("n", [3, 4, 5, 6, 8, 10, 11, 13, 20])
def test_half_of_a_short_passage_is_found(spark, n):
    """An unbroken half of a passage of any length is found, also where its triples occur in many other passages."""
    rng = random.Random(n)
    ws = [f"{rng.choice(WORDS)}{i}x" for i in range(n)]
    ws = ["".join(c if not c.isdigit() else chr(97 + int(c)) for c in w) for w in ws]
    half = -(-n // 2)
    docs = [(i, f"other things {' '.join(ws[i : i + half])} follow here") for i in range(n - half + 1)] + [(100, " ".join(ws[: half - 1]))]
    copies = [(k, " ".join([*ws, f"tail{'abcdefghij'[k]}"])) for k in range(2, 7)]  # share all triples
    evals = spark.createDataFrame([(1, " ".join(ws)), *copies], "eval_id long, passage string")
    got = {r["doc_id"] for r in leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), evals).filter("eval_id = 1").collect()}
    assert got == set(range(n - half + 1))


def test_words_have_their_places():
    probes = leaks.Probes([(1, "one two three four")])
    text = "One <b class='x'>two</b>&nbsp;three, f\u00adour\n\n&amp; five-six"
    places = probes.word_places(text)
    assert len(places) == len(leaks.words(text)) == len(probes.symbols(text)) == 6
    assert [text[a:b] for a, b in places][0] == "One" and text[places[4][0] : places[4][1]] == "five-six"


# --- packing -----------------------------------------------------------------------------------------------------------


def best_fit_decreasing(sizes: list[int], capacity: int) -> int:
    """The number of containers of the plain greedy on one machine."""
    full, left = 0, []
    for n in sorted((n % capacity for n in sizes if n % capacity), reverse=True):
        fit = min((r for r in left if r >= n), default=None)
        if fit is not None:
            left.remove(fit)
        left.append((capacity if fit is None else fit) - n)
    return sum(n // capacity for n in sizes) + len(left) + full


@pytest.mark.parametrize("seed", range(3))
def test_packing_keeps_every_document_whole(spark, seed, monkeypatch):
    if seed:
        monkeypatch.setattr(packing, "CHUNK", 20)  # hot lengths are salted
    rng = random.Random(seed)
    tokens = [(i, max(1, int(rng.lognormvariate(5.3, 1.0)))) for i in range(700)] + [(1000 + i, 300) for i in range(350)] + [(5000, 512), (5001, 40_000), (5002, 0), (5003, 1024)]
    packs = [(1, 512), (2, 1024), (3, None), (4, 7)]
    df = spark.createDataFrame(tokens, "doc_id long, tokens long")
    out = packing.pack(df, spark.createDataFrame(packs, "pack_id int, capacity_tokens int")).collect()
    for pack_id, capacity in ((1, 512), (2, 1024), (4, 7)):
        own = [r for r in out if r["pack_id"] == pack_id]
        fill, pieces = defaultdict(int), defaultdict(list)
        for r in own:
            fill[r["container"]] += r["tokens"]
            pieces[r["doc_id"]].append(r)
        assert max(fill.values()) <= capacity and sorted(fill) == list(range(len(fill)))
        assert {d: sum(p["tokens"] for p in ps) for d, ps in pieces.items()} == {d: n for d, n in tokens if n}
        assert all(len(ps) == -(-n // capacity) for d, n in tokens if n for ps in [pieces[d]])
        assert len(fill) <= 1.03 * best_fit_decreasing([n for _, n in tokens], capacity) + 1


def test_packing_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, tokens long")
    assert packing.pack(df, spark.createDataFrame([(1, 512)], "pack_id int, capacity_tokens int")).count() == 0
    assert packing.pack(df, spark.createDataFrame([], "pack_id int, capacity_tokens int")).count() == 0


def test_plan_depends_on_lengths_only():
    counts = {s: 50 for s in range(1, 513, 3)}
    small, large = packing.Plan(512, counts), packing.Plan(512, {s: 50_000 for s in counts})
    assert len(large.entries) < 3 * len(small.entries)
    for plan, times in ((small, 50), (large, 50_000)):
        assert plan.containers * 512 >= sum(s * times for s in counts) and all(plan.used[s] == times for s in counts)


@pytest.mark.skipif(not Path(queries_p6.VOCABULARY).exists(), reason="no vocabulary here")
def test_token_counts_round_trip(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries_p6.VOCABULARY, "rb"))}
    e = tiktoken.Encoding("t", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello world", "  spaces  and\nlines ", "日本語 и русский", "<|endoftext|>", "x" * 5000]
    assert all(e.decode(e.encode_ordinary(t)) == t for t in texts)
    df = spark.createDataFrame([*enumerate(texts), (90, None), (91, "")], "doc_id long, text string")
    assert {r["doc_id"]: r["tokens"] for r in packing.token_counts(df, queries_p6.VOCABULARY).collect()} == {i: len(e.encode_ordinary(t)) for i, t in enumerate(texts)}


# --- subjects ----------------------------------------------------------------------------------------------------------

TOPICS = {"sea": "harbour tide anchor sailor vessel reef", "sky": "cloud pilot runway glider altitude turbine", "soil": "plough harvest furrow barley orchard manure"}


def topic_sentence(rng, topic):
    return " ".join(rng.choice(TOPICS[topic].split()) if rng.random() < 0.4 else rng.choice(WORDS) for _ in range(10)).capitalize() + "."


def test_subjects_held_out(spark):
    rng = random.Random(3)
    docs, labels, truth = [], [], {}
    for i in range(240):
        mine = rng.sample(sorted(TOPICS), rng.choice([1, 1, 2]))
        text = " ".join(topic_sentence(rng, rng.choice(mine) if k >= len(mine) else mine[k]) for k in range(8)) + " " + sentence(rng, 10)
        if len(mine) == 2:
            text = " ".join(topic_sentence(rng, mine[k % 2]) for k in range(8))
        docs.append((i, text))
        truth[i] = set(mine)
        if i < 160:
            labels += [(i, s, "a") for s in (mine if rng.random() > 0.04 else [rng.choice(sorted(TOPICS))])] * 2
    docs += [(900, None), (901, ""), (902, "Too short."), (903, "Nothing of interest happened there again today. " * 2000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("subject_id", F.lit("clash"))
    lab = spark.createDataFrame([*labels, (None, "sea", "a"), (1, None, "a"), (2, "unknown", "a")], "doc_id long, subject_id string, annotator string")
    dim = spark.createDataFrame([(s, s, None) for s in TOPICS], "subject_id string, label string, description string")
    order, params = subjects.fit(df, lab, dim)
    got = defaultdict(set)
    for r in subjects.document_subjects(df, order, params).collect():
        got[r["doc_id"]].add(r["subject_id"])
        assert r["share"] >= subjects.SHARE
    hits = sum(got[i] == truth[i] for i in range(160, 240))
    assert hits >= 70 and not got[900] and not got[901] and not got[902]


def test_subjects_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, subject_id string, annotator string")
    dim = spark.createDataFrame([("sea", "Sea", "tides")], "subject_id string, label string, description string")
    assert subjects.document_subjects(docs, *subjects.fit(docs, labels, dim)).count() == 0
    assert subjects.document_subjects(docs, *subjects.fit(docs, labels, dim.limit(0))).count() == 0


def test_gradient_matches_finite_differences():
    rng = np.random.default_rng(1)
    enc = subjects.Encoded([["harbour", "tide", "reef"], ["cloud", "pilot", "reef", "reef"]], np.zeros((2, 2), bool))
    vectors = lambda t: enc.logits({"table": t, "out": np.zeros((3, 2), np.float32), "bias": np.zeros(2, np.float32)})[0]
    table = rng.normal(0, 1, ((1 << subjects.WORD_BITS) + (1 << subjects.SUB_BITS), 3)).astype(np.float32)
    weight = rng.normal(0, 1, (2, 3)).astype(np.float32)
    grad = enc.scatter(weight, len(table))
    for b in (enc.sub[0], enc.sub[5], enc.sub[-1]):
        moved = table.copy()
        moved[b, 1] += 0.5
        change = ((vectors(moved) - vectors(table)) * weight).sum() / 0.5
        assert abs(change - grad[b, 1]) < 1e-3


def test_gradients_add_up_over_partitions():
    rng = random.Random(4)
    texts = [subjects.sentences(topic_sentence(rng, rng.choice(sorted(TOPICS))))[0] for _ in range(60)]
    allowed = np.random.default_rng(2).random((60, 3)) < 0.4
    params = subjects.start(3)
    whole = subjects.gradient(subjects.Encoded(texts, allowed), params, 0.5)
    parts = [subjects.gradient(subjects.Encoded(texts[a:b], allowed[a:b]), params, 0.5) for a, b in ((0, 17), (17, 18), (18, 60))]
    for k in whole:
        assert np.allclose(whole[k], sum(p[k] for p in parts), atol=1e-4)


def test_scorer_matches_the_model():
    rng = random.Random(6)
    params = subjects.start(3)
    raw = [topic_sentence(rng, "sea"), "Too short", "", "  ", "Half-open (reefs), tides & 12 harbours!", topic_sentence(rng, "sea").upper()]
    kept, got = subjects.Scorer(params["table"] @ params["out"], params["bias"]).logits(raw)
    words = [w for x in raw for w in subjects.sentences(x)]
    assert kept.tolist() == [True, False, False, False, True, True]
    assert np.allclose(got, subjects.Encoded(words, np.zeros((len(words), 3), bool)).logits(params)[1], atol=1e-4)


def test_thresholds_fire_as_often_as_targets():
    logits = np.random.default_rng(0).normal(0, 2, (4000, 2))
    counts = np.stack([np.bincount(np.clip(np.searchsorted(subjects._EDGES, logits[:, j]), 0, 128 + 1), minlength=130) for j in range(2)], 1)
    cut = subjects.thresholds(np.array([(logits[:, 0] > -0.5).sum(), 0]), counts)
    assert abs(cut[0] + 0.5) < 0.1 and np.isclose(cut[1], 0.0)


# --- the registered queries --------------------------------------------------------------------------------------------


@pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")
def test_queries_have_their_columns(spark):
    from gleaner.llm import queries

    columns = {
        "p1_found": ["item_id", "field", "seg_no", "lang"], "p2_found": ["item_a", "item_b"], "p4_found": ["rec", "key_a", "key_b"], "p5_found": ["item_id", "field"],
        "p7_found": ["doc_id", "eval_id"], "p8_found": ["doc_id", "subject_id"],
    }
    for name, want in columns.items():
        df = queries.QUERIES[name](spark, str(DATA))
        assert df.columns == want, name
        rows = df.collect()
        assert len(rows) == len(set(rows)), name
