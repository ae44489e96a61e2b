"""Texts far longer than all others are read whole, to their last word."""

import hashlib
import random

import pytest

from markcheck.llm import exact_dedup, mixing, parity_join, suffix_dedup

N = 200_000


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(N)]
    other = [f"x{rng.randrange(10**6)}" for _ in range(N)]
    return [
        (1, " ".join(words), "a"),
        (2, " ".join([*words[:-1], "changed"]), "b"),
        (3, "  ".join(words), "a"),
        (4, " ".join([*other, *words[-60:]]), "a"),
        (5, "short text", "b"),
        (6, None, None),
    ]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2)


def test_near_copies_link(docs, rows):
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.similar(docs).collect()}
    split = {i: (t or "").split() for i, t, _ in rows}
    sizes = {i: len({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}) if w else 0 for i, w in split.items()}
    assert out == {i: (sizes[i], 1 if i < 4 else i) for i in split}


def test_copies_are_equal_to_the_end(docs, rows):
    out = {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_groups(docs).collect()}
    texts = {i: "".join((t or "").split()) for i, t, _ in rows}
    keeps = {1: (3, 2), 3: (3, 2)}
    assert out == {i: (*keeps.get(i, (i, 1)), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts.items()}


def test_all_words_count(docs):
    out = {r.doc_id: r["size"] for r in mixing.mix(docs).collect()}
    assert out == {1: N, 2: N, 3: N, 4: N + 60, 5: 2, 6: 0}


def test_a_passage_at_the_end_is_found(docs):
    out = {(r.doc_id, r.start_word, r.end_word, r.other_id) for r in suffix_dedup.repeats(docs).collect()}
    assert out == {(1, 0, N, 2), (2, 0, N - 1, 1), (3, 0, N, 1), (4, N, N + 60, 1)}
