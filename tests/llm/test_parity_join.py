import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from markcheck.llm import parity_join
from markcheck.llm.components import components


def shingles(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [w for w in (text or "").translate(table).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(a), find(i)) for i, a in sets}


def check(spark, rows):
    out = parity_join.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    expected = brute(rows)
    assert len(out) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out if r.doc_id is not None} == expected


def family(rng, base, n, edits):
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits)):
            k = rng.randrange(len(words))
            words[k : k + rng.randrange(2)] = [f"x{rng.randrange(10**6)}"] * rng.randrange(3)
        yield " ".join(words)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = []
    hot = "one very common line of many words that plenty of documents hold"
    for size in (3, 5, 6, 8, 12, 20, 40, 80, 150, 400, 900):
        for _ in range(4):
            base = [f"w{rng.randrange(5000)}" for _ in range(size)]
            texts += list(family(rng, base, 6, max(2, size // 12)))
            texts.append(hot + " " + " ".join(base[:10]))
    base = [f"v{k}" for k in range(120)]
    texts += list(family(rng, base, 60, 8))
    texts += [None, "", " \n", "a", "A", "a b c d", "A b\tc d", texts[3], texts[3]]
    rng.shuffle(texts)
    check(spark, list(enumerate(texts)))


def test_second_look_joins_what_stars_miss(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "SMALL", 1)
    rng = random.Random(5)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randrange(60)}" for _ in range(30)]
        texts += list(family(rng, base, 8, 4))
    check(spark, list(enumerate(texts)))


@pytest.mark.parametrize("tops", [0, 2, 16])
def test_second_look_makes_near_copies_a_pair_once(spark, monkeypatch, tops):
    monkeypatch.setattr(parity_join, "TOPS", tops)
    rng = random.Random(6)
    rows, sigs = [], {}
    for k in range(30):  # near copies that share many signatures, and others that share few
        sigs[k] = {s for s in range(40) if rng.random() < 0.8} if k < 20 else set(rng.sample(range(40), 3))
        rows += [(s, k // 15, k, k // 2, 1000, [0] * (parity_join.SKETCH // 64)) for s in sigs[k]]
    sigs[15] |= {90, 91}  # a class of several bands
    rows += [(s, 5, k, k // 2, 1000, [0] * (parity_join.SKETCH // 64)) for s in (90, 91) for k in (15, 3)]
    live = spark.createDataFrame(rows, "sig long, band int, class_id long, component long, n long, sketch array<bigint>")
    found = [(r.a, r.b) for r in parity_join._meetings(live, 75).collect()]
    assert set(found) == {(a, b) for b in range(30) for a in range(b) if a // 2 != b // 2 and sigs[a] & sigs[b] or (a, b) == (3, 15)}
    if tops == 16:
        copies = [(a, b) for a, b in found if b < 20 and not {a, b} & {3, 15}]
        assert len(copies) == len(set(copies))


def test_real_rows(spark):
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    check(spark, list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True)))


def test_edge_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n int, sig string, class_id int")
    assert parity_join.similar(empty).count() == 0
    rows = [(None, "a b c d e f", 1), (1, "a b c d e f", 1), (1, "a b c d e f", 1), (2, None, 1)]
    out = parity_join.similar(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in out if r.doc_id) == [(1, 2, 1), (1, 2, 1), (2, 0, 2)]
    assert [(r.n_shingles, r.component_id) for r in out if r.doc_id is None] == [(2, None)]


def similar_pairs(rng, n):
    for _ in range(n):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 400)).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        keep = a[rng.random(len(a)) < rng.uniform(0.75, 1)]
        b = np.unique(np.concatenate([keep, rng.integers(0, 2**63, rng.integers(0, 1 + len(a) // 4)).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 75 * (len(a) + len(b) - both):
            yield a, b


def test_signatures_are_sure_of_similar_sets():
    sure_of = 0
    for a, b in similar_pairs(np.random.default_rng(3), 400):
        sig, owner, sure = parity_join._signatures(np.concatenate([a, b]), np.array([len(a), len(b)]), 75)
        assert len(np.intersect1d(sig[owner == 0], sig[owner == 1])) >= sure.max()
        sure_of += (sure > 0).all()
    assert sure_of > 100


def test_similar_sets_meet_whatever_the_order():
    rng = np.random.default_rng(4)
    for a, b in similar_pairs(rng, 400):
        both, counts = np.concatenate([a, b]), np.array([len(a), len(b)])
        sig = np.unique(parity_join._signatures(both, counts, 75)[0])
        seen = np.sort(rng.choice(sig, rng.integers(0, len(sig) + 1), replace=False))
        sig, owner, _ = parity_join._emitted(both, counts, 75, (seen, rng.integers(1, 5, len(seen))))
        assert len(np.intersect1d(sig[owner == 0], sig[owner == 1]))


def test_one_line_in_a_third_of_all_documents(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "BUCKET", 20)  # deals frequent signatures to several groups
    rng = random.Random(9)
    line = "all rights reserved by the owners of this site and by nobody else at all"
    texts = []
    for k in range(240):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.choice((4, 6, 9, 20, 40)))]
        texts.append(" ".join(words) + (" " + line if k % 3 == 0 else ""))
    base = [f"v{k}" for k in range(60)]
    texts += list(family(rng, base, 80, 6))
    check(spark, list(enumerate(texts)))


@pytest.mark.parametrize("bucket", [1, 3])
def test_dealing_to_nearly_empty_groups_parts_nothing(spark, monkeypatch, bucket):
    monkeypatch.setattr(parity_join, "BUCKET", bucket)
    rng = random.Random(11)
    texts = []
    for size in (8, 30, 60):
        base = [f"v{size}x{k}" for k in range(size)]
        texts += list(family(rng, base, 40, 3 + size // 20))
    check(spark, list(enumerate(texts)))


def test_an_id_on_several_texts_links_as_each_of_them(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(1, a), (2, a + " more"), (5, b), (6, b + " more"), (7, a + " else"), (7, b + " else"), (8, "on its own"), (8, "on its own too")]
    out = parity_join.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows) and {(r.doc_id, r.component_id) for r in out} == {(1, 1), (2, 1), (5, 1), (6, 1), (7, 1), (8, 8)}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(10, 60)] + [(100, x) for x in range(101, 150)] + [(7, 7), (200, 3)]
    out = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(out[i] == 10 for i in range(10, 61)) and all(out[i] == 100 for i in range(100, 150))
    assert out[200] == out[3] == 3 and 7 not in out
