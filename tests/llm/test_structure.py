"""Splits, repetition, near copies, leaks: small fixtures against brute force, and odd inputs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.llm import leakage, nearcopies, repetition, splits
from scoreloom.llm.components import components
from scoreloom.runtime import Scratch

CLEAN = "row_id bigint, dataset string, example_id string, sample_id bigint, text string, contamination_ratio double, generator_model string, id string, n string"


def _clean(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], CLEAN)


def _groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["random", "path", "star", "none"])
def test_components(spark, shape):
    rng = random.Random(4)
    edges = {
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(5, 5), (None, 3)], "path": [(i, i + 1) for i in range(60)],
        "star": [(7, i) for i in range(8, 400)], "none": [],
    }[shape]
    own = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint"), Scratch(spark, "t")).collect()}
    assert got == _groups(own, {x for e in own for x in e})


def test_splits(spark):
    rows = [(i, "xsum", f"a{i // 3}", i // 2, "t", 0.1 * (i % 3), "g") for i in range(600)]
    rows += [(1000 + i, " XSum", "hot", 5000 + i, "t", None, "g") for i in range(400)]
    rows += [(2000, None, "hot", 7000, "t", 0.0, "g"), (2001, "x_sum", " XSUM:HOT ", 7001, "t", 0.0, "g"), (2002, "xsum", None, None, "t", 0.0, "g"), (2002, "xsum", None, None, "t", 0.0, "g")]
    df = _clean(spark, rows)
    tied = {(r.group_sample_id, r.sample_id) for r in splits.tied_samples(df).collect()}
    assert (5000, 7001) in tied and (5000, 5399) in tied and not any(b == 7000 for _, b in tied)
    got = splits.split_rows(df).collect()
    assert len(got) == len(rows)
    for _, part in itertools.groupby(sorted(got, key=lambda r: r.group_sample_id), key=lambda r: r.group_sample_id):
        assert len({r.split for r in part}) == 1
    assert splits.split_rows(df.limit(0)).count() == 0 and splits.tied_samples(df.limit(0)).count() == 0


def test_split_shares(spark):
    got = splits.split_rows(_clean(spark, [(i, "d", f"e{i}", i, "t", 0.1 * (i % 2), "g") for i in range(6000)])).groupBy("contamination_ratio", "split").count().collect()
    for r in got:
        assert r["count"] / 3000 == pytest.approx({"train": 0.8, "validation": 0.1, "test": 0.1}[r.split], abs=0.03)


def test_no_row_changes_split_when_others_come(spark):
    own = [(i, "d", f"e{i // 2}", i, "t", 0.0, "g") for i in range(400)]
    more = [(1000 + i, "d", "hot", 5000 + i, "t", 0.0, "g") for i in range(900)] + [(3000 + i, "d", f"f{i}", 9000 + i, "t", 0.0, "g") for i in range(500)]
    before = {r.row_id: r.split for r in splits.split_rows(_clean(spark, own)).collect()}
    found = splits.split_rows(_clean(spark, own + more))
    after = {r.row_id: r.split for r in found.collect()}
    assert all(after[k] == v for k, v in before.items())
    large = splits.large_groups(found, 0.3).collect()
    assert [(r.group_sample_id, r.n_rows) for r in large] == [(5000, 900)]
    pinned = {r.row_id: r.split for r in splits.split_rows(_clean(spark, own + more), pinned={5000: "test"}).collect()}
    assert all(pinned[k] == ("test" if 1000 <= k < 1900 else v) for k, v in after.items())


def _repeated(text):
    import re

    w = re.findall(r"[^\W_]+", (text or "").lower())
    seen, mark = set(), [0] * len(w)
    for i in range(len(w) - 3):
        k = tuple(w[i : i + 4])
        if k in seen:
            mark[i : i + 4] = [1] * 4
        seen.add(k)
    return len(w), sum(mark)


def test_repetition(spark):
    rng = random.Random(0)
    texts = [None, "", "...", "a b c", "a b c d a b c d", "x " * 40, "été Éte " * 9, "one two " * 20000] + [" ".join(rng.choice("abcd") for _ in range(rng.randrange(60))) for _ in range(80)]
    df = _clean(spark, [(i, "d", "e", i, t, 0.0, "g" if i % 2 else None) for i, t in enumerate(texts)])
    got = {r.row_id: (r.n_words, r.repeated_words) for r in repetition.repetition(df).collect()}
    assert got == {i: _repeated(t) for i, t in enumerate(texts)}
    assert {r.row_id for r in repetition.repetitive(df).collect()} == {i for i, t in enumerate(texts) if (x := _repeated(t))[0] >= 30 and x[1] >= 0.4 * x[0]}
    assert {r.generator_model for r in repetition.generator_means(df).collect()} == {None, "g"}


def _sets(text, k):
    w = (text or "").split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def _near(rows, t, least, words):
    own = [(i, d, s) for i, d, s in ((r[0], r[1], _sets(r[4], words)) for r in rows) if d is not None and len(s) >= least]
    links = [(a[0], b[0]) for a, b in itertools.combinations(own, 2) if a[1] == b[1] and len(a[2] & b[2]) >= t * len(a[2] | b[2])]
    found = _groups(links, {r[0] for r in own})
    return {(a, b) for (a, x), (b, y) in itertools.combinations(sorted(found.items()), 2) if x == y}


def _edited(rng, words, share):
    out = list(words)
    for _ in range(int(len(out) * share)):
        kind, i = rng.randrange(3), rng.randrange(len(out))
        if kind == 0:
            out[i] = f"new{rng.randrange(10**6)}"
        elif kind == 1:
            del out[i]
        else:
            out.insert(i, f"new{rng.randrange(10**6)}")
    return out


@pytest.mark.parametrize("cells, hot, block", [(nearcopies.CELLS, 256, nearcopies.BLOCK), (64, 1, 4)])
def test_near_copies(spark, monkeypatch, cells, hot, block):
    """Whether lists go by one member, by two and in blocks, and whether the sketch holds more or fewer cells than members: the result is the same."""
    monkeypatch.setattr(nearcopies, "NOISE", 0)
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(120)]
    rows = []
    for base in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(45, 90))]
        for c in range(rng.randrange(1, 7)):
            rows.append((len(rows), ["a", "A ", "b"][base % 3], "e", 0, " ".join(_edited(rng, words, rng.choice([0, 0.02, 0.05, 0.1, 0.14]))), 0.0, "g"))
    rows += [(900 + i, None, "e", 0, rows[0][4], 0.0, "g") for i in range(2)] + [(910, "a", "e", 0, None, 0.0, "g"), (911, "a", "e", 0, "", 0.0, "g"), (912, "a", "e", 0, "x " * 100, 0.0, "g")]
    found = nearcopies.NearCopies(_clean(spark, rows), F.lower(F.trim("dataset")), words=3, similarity=0.5, least=40, hot=hot, cells=cells, block=block).groups().collect()
    groups = {r.id: r.group for r in found}
    got = {(a, b) for a, b in itertools.combinations(sorted(groups), 2) if groups[a] == groups[b]}
    assert got == _near([(r[0], None if r[1] is None else r[1].strip().lower(), *r[2:]) for r in rows], 0.5, 40, 3)


def test_small_sets(spark):
    """Sets so small that one member decides."""
    rng = random.Random(5)
    rows = [(i, "d", "e", 0, " ".join(rng.choice("abcde") for _ in range(rng.randrange(1, 6))), 0.0, "g") for i in range(120)]
    for hot in (1,):
        found = nearcopies.NearCopies(_clean(spark, rows), F.col("dataset"), words=1, similarity=0.5, hot=hot, block=5).groups().collect()
        groups = {r.id: r.group for r in found}
        assert {(a, b) for a, b in itertools.combinations(sorted(groups), 2) if groups[a] == groups[b]} == _near(rows, 0.5, 1, 1)


def test_frequent_members_stay_apart_in_a_full_sketch():
    """With 100 members to a cell, a member met 5,000 times is graded above those met once, and nearly all of these alike."""
    once = nearcopies.mix(np.arange(400_000, dtype=np.uint64)) & np.uint64((1 << nearcopies.BITS) - 1)
    often = once[:20]
    counts = np.zeros(8192, dtype=np.uint64)
    for half, own in zip(np.split(counts, 2), nearcopies.cells_of(np.concatenate([once, np.repeat(often, 5000)]), 8192)):
        half += np.bincount(own, minlength=4096).astype(np.uint64)
    grade, noise = nearcopies.to_grades(counts)
    hot = int(nearcopies.grade_of(max(nearcopies.HOT, nearcopies.NOISE * noise)))
    assert (nearcopies.grades(often, grade) > hot).all() and (nearcopies.grades(once[20:], grade) > hot).mean() < 0.01
    assert nearcopies.grade_of(2.0**40) < 255


def test_pairs_of_a_group_in_blocks(spark, monkeypatch):
    rows = [(i, "d", "e", 0, " ".join(f"w{k}" for k in range(60)), 0.0, "g") for i in range(40)]
    want = [(a, b) for a in range(40) for b in range(a + 1, 40)]
    for size in (2000, 7):
        monkeypatch.setattr(nearcopies, "PAIR_BLOCK", size)
        assert sorted(tuple(r) for r in nearcopies.near_copy_pairs(_clean(spark, rows)).collect()) == want


def test_near_copies_of_one_text(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(80)]
    rows = [(i, "d", "e", 0, " ".join(words), 0.0, "g") for i in range(500)] + [(500 + i, "d", "e", 0, " ".join(_edited(rng, words, 0.05)), 0.0, "g") for i in range(500)]
    got = nearcopies.near_copies(_clean(spark, rows))
    assert got.count() == 1000 and {r.group_row_id for r in got.select("group_row_id").distinct().collect()} == {0}
    assert nearcopies.near_copies(_clean(spark, rows).limit(0)).count() == 0


def test_leaks(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(12, 40)))) for i in range(40)] + [(99, None), (98, ""), (97, "only five words stand here")]
    docs = []
    for d in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 200))]
        if d % 2:
            own = rng.choice(items[:40])[1].split()
            a = rng.randrange(len(own))
            piece = own[a : a + rng.randrange(4, 40)]
            words[10:10] = piece
        docs.append((d, " ".join(words).upper() if d % 3 else ", ".join(words)))
    docs += [(500, None), (501, ""), (502, items[0][1] * 2000), (503, items[0][1]), (503, items[0][1])]
    want = []
    for d, t in docs:
        w = (t or "").lower().replace(",", "").split()
        grams = {tuple(w[i : i + 6]) for i in range(len(w) - 5)}
        for i, x in items:
            own = (x or "").split()
            hit = {i + k for i in range(len(own) - 5) if tuple(own[i : i + 6]) in grams for k in range(6)}
            if own and len(hit) >= 0.4 * len(own) and hit:
                want.append((d, i))
    docs_df = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id bigint, text string, item_id string")
    items_df = spark.createDataFrame(items, "item_id bigint, text string")
    for most in (leakage.MOST, 3):
        assert sorted(tuple(r) for r in leakage.leaks(docs_df, items_df, most=most).select("doc_id", "item_id").collect()) == sorted(want)
    assert leakage.leaked_pairs(docs_df, items_df.limit(0)).count() == 0 and leakage.leaked_pairs(docs_df.limit(0), items_df).count() == 0


def test_many_items(spark):
    """Far more items than fit in a plan each: documents are read twice, however many there are."""
    docs = spark.range(200).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(0, 60), k -> concat('w', id * 61 + k))) as text", "'x' as item_id")
    items = spark.range(100_000).selectExpr("id as item_id", "if(id < 200, concat_ws(' ', transform(sequence(0, 11), k -> concat('w', id * 61 + 7 + k))), concat_ws(' ', transform(sequence(0, 11), k -> concat('v', id * 12 + k)))) as text")
    found = leakage.leaks(docs, items)
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(i, i) for i in range(200)]
