import random

import pyarrow.parquet as pq

from markcheck.llm import suffix_dedup

SCHEMA = "doc_id long, text string"


def brute(rows, least=50):
    """Word positions of each document that lie in a stretch of ``least`` words that another document has too."""
    places = {}
    for doc, text in rows:
        words = (text or "").split()
        for i in range(len(words) - least + 1):
            places.setdefault(tuple(words[i : i + least]), []).append((doc, i))
    out = {}
    for found in places.values():
        if len({d for d, _ in found}) > 1:
            for doc, i in found:
                out.setdefault(doc, set()).update(range(i, i + least))
    return out


def found(spark, rows):
    out = {}
    for r in suffix_dedup.repeats(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect():
        assert r.n_words == r.end_word - r.start_word >= 50 and r.other_id != r.doc_id
        out.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(9)

    def fresh(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    shared = [fresh(n) for n in (49, 50, 51, 60, 90, 200, 700)]
    rows = []
    for passage in shared:
        for _ in range(4):
            rows.append(" ".join(fresh(rng.randrange(120)) + passage + fresh(rng.randrange(120))))
    rows.append(" ".join(fresh(30) + shared[3] + fresh(20) + shared[4]))
    rows += [" ".join(shared[5]), " ".join(shared[5]), " ".join(fresh(400)), " ".join((p := fresh(80)) + p), "", None]
    rows = list(enumerate(rows))
    assert found(spark, rows) == brute(rows)


def test_real_rows(spark):
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet")
    rows = [(d, t) for d, t in zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True)]
    assert found(spark, rows) == brute(rows)


def test_frequent_minimisers_and_stretches_are_dealt_apart(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET", 100)
    rng = random.Random(4)

    def fresh(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    line, passage, seldom = fresh(12), fresh(70), fresh(55)
    rows = []
    for k in range(60):
        rows.append(" ".join(fresh(rng.randrange(60)) + (line if k % 3 else passage) + fresh(45) + (seldom if k in (7, 8) else [])))
    rows += [" ".join(fresh(30) + line + seldom[:40]), " ".join(fresh(9) + line + seldom[:40])]
    rows = list(enumerate(rows))
    assert found(spark, rows) == brute(rows)
    spans = suffix_dedup.repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.other_id for r in spans if r.doc_id % 3 == 0 and 0 < r.doc_id < 60} == {0} and next(r.other_id for r in spans if r.doc_id == 0) == 3


def test_cut_and_edge_rows(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(1, f"a {passage} b", 0), (2, f"c {passage}\td", 0), (2, f"c {passage}\td", 0), (None, f"x {passage}", 0), (4, None, 0), (5, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other_id int")
    spans = suffix_dedup.repeats(docs)
    assert sorted(tuple(r) for r in spans.collect()) == [(1, 1, 61, 60, 2), (2, 1, 61, 60, 1)]
    out = {r.doc_id: r.text for r in suffix_dedup.cut_repeats(docs, spans).collect()}
    assert out[1] == f"a {passage} b" and out[2] == "c d" and out[4] is None
    assert suffix_dedup.repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_frequent_line_does_not_part_two_copies(spark):
    rng = random.Random(3)

    def fresh(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    def only_minimiser(words):
        at, _ = suffix_dedup._minimisers(suffix_dedup.word_hashes([w.encode() for w in words]), 50)
        return set(at) == {42}

    while not only_minimiser((passage := fresh(42)) + (line := fresh(8))):
        pass
    rows = [" ".join(fresh(20) + passage + line + fresh(60)) for _ in range(2)]
    rows += [" ".join(fresh(60) + line + fresh(60)) for _ in range(400)]
    rows = [(k * 7919 % 402, r) for k, r in enumerate(rows)]
    expected = brute(rows)
    assert len(expected) == 2 and found(spark, rows) == expected


def test_minimisers_do_not_depend_on_what_precedes():
    rng = random.Random(5)

    def fresh(n):
        return [b"w%d" % rng.randrange(10**6) for _ in range(n)]

    def places(words):
        return set(suffix_dedup._minimisers(suffix_dedup.word_hashes(words), 50)[0].tolist())

    for _ in range(300):
        line = fresh(10)
        passage = line + fresh(40)
        alone, after = places(passage), places(fresh(30) + line + passage)
        assert {p + 40 for p in alone} <= after
