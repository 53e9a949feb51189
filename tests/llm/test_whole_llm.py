"""Steps that the queries of the llm package must not leave out."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pytest

from gleaner.llm import history, neardup, queries_p2, residue

ITEM = "item_id long, batch_id int, source_id string, title string, summary string, canonical_url string, lang string"
WORDS = "amber birch cedar delta ember fjord grove hazel inlet jetty knoll larch maple north ocean pearl quartz ridge stone tidal umber vale willow xenon yarrow zephyr".split()


def test_groups_leave_out_residue(spark, tmp_path):
    rng = random.Random(14)
    prose = [" ".join(rng.choice(WORDS) + str(rng.randrange(1000)) for _ in range(14)).capitalize() + "." for _ in range(60)]
    rows = [(i, f"Harbour plan {i} {WORDS[i % 26]}", x) for i, x in enumerate(prose)]
    # two that are alike, and residue: a copied page, and one more of the same text
    rows += [(100, rows[0][1], rows[0][2].replace(".", " today.")), (101, rows[1][1], rows[1][2])]
    rows += [(i, "JavaScript seems to be off", "Please enable JavaScript and cookies to continue using this site.") for i in (200, 201)]
    rows += [(202, "JavaScript seems to be off", "Please enable JavaScript and cookies to continue using this site now.")]
    spark.createDataFrame([(i, 1, "s", t, s, None, None) for i, t, s in rows], ITEM).write.parquet(str(tmp_path / "hotspot_items.parquet"))
    found = {(r["item_a"], r["item_b"]) for r in queries_p2.p2_found(spark, str(tmp_path)).collect()}
    got = {r["item_id"]: (r["group_id"], r["group_size"], r["links"]) for r in queries_p2.p2_groups(spark, str(tmp_path)).collect()}
    assert found == {(0, 100), (1, 101)}
    assert got == {0: (0, 2, 1), 100: (0, 2, 1), 1: (1, 2, 0), 101: (1, 2, 0)}


def test_misspelt_pairs_of_short_titles(spark):
    rng = random.Random(15)
    titles = {"".join(rng.choice("abé議") for _ in range(rng.randrange(1, 11))) for _ in range(400)} | {"a1", "a2", "teh", "the", "機器人", "機器入"}
    rows = list(enumerate(sorted(titles)))
    want = {(i, j) for i, x in rows for j, y in rows if i < j and history.one_misspelling(x, y)}
    df = history.pivot_table(spark.createDataFrame(rows, "tid long, core string"))
    got = [tuple(r) for r in history.misspelt_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="the tables are not here")
def test_pairs_of_a_whole_table_against_brute_force(spark):
    """Every pair of classes by counting shared substrings, in blocks of one row against all others."""
    from collections import defaultdict

    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/hotspot_items.parquet").select("item_id", "title", "summary").collect()
    index = residue.ExemplarIndex(residue.weights_of(residue.count_fields([x for r in rows for x in r[1:]])))
    classes = defaultdict(list)
    for i, t, s in rows:
        x = neardup.comparable_text(t, s)
        if x and not index.holds(t, True) and not index.holds(s, False):
            classes[x].append(i)
    number: dict[str, int] = {}
    sets = [np.array(sorted({number.setdefault(x[k : k + 5], len(number)) for k in range(len(x) - 4)})) for x in classes]
    size = np.array([len(z) for z in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    owner, begin = owner[order], np.searchsorted(flat[order], np.arange(len(number) + 1))
    members = list(classes.values())
    want = {(a, b) for ids in members for a in ids for b in ids if a < b}
    for k, z in enumerate(sets):
        if len(z):
            shared = np.bincount(np.concatenate([owner[begin[q] : begin[q + 1]] for q in z]), minlength=len(sets))[k + 1 :]
            for j in np.flatnonzero(shared / (size[k + 1 :] + len(z) - shared) >= 0.7) + k + 1:
                want |= {(min(a, b), max(a, b)) for a in members[k] for b in members[j]}
    got = {tuple(r) for r in queries_p2.p2_found(spark, folder).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) > 100
