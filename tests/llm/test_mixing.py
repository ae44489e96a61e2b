import hashlib

import pytest

from markcheck.llm import mixing


def size_of(text):
    return len([w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w])


def brute(rows, weights=(5, 2, 1), cap=3):
    """(doc, size, source size, target, taken) by sorting each source on its hash."""
    sizes = [size_of(t) for _, t, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(n for n, r in zip(sizes, rows, strict=True) if r[2] == s) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    stopped, target = set(), {}
    while True:
        left = sum(total.values()) - sum(cap * total[s] for s in stopped)
        free = [s for s in names if s not in stopped]
        unit = left / sum(weight[s] for s in free) if free else 0
        target = {s: cap * total[s] if s in stopped else weight[s] * unit for s in names}
        more = {s for s in free if target[s] > cap * total[s]}
        if not more:
            break
        stopped |= more
    out = []
    for s in names:
        mine = sorted((int(hashlib.md5(str(d).encode()).hexdigest()[:15], 16), n, d) for (d, _, q), n in zip(rows, sizes, strict=True) if q == s)
        whole = 0 if not total[s] else cap if target[s] >= cap * total[s] else int(target[s] // total[s])
        rest, upto = target[s] - whole * total[s], 0
        for _, n, d in mine:
            taken = n * (whole + (2 * upto + n <= 2 * rest))
            out.append((d, n, total[s], round(target[s], 6), taken))
            upto += n
    return sorted(out)


def rows_of(frame):
    return sorted((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in frame.collect())


@pytest.mark.parametrize("step", [12, 20])
def test_equals_brute_force(spark, monkeypatch, step):
    monkeypatch.setattr(mixing, "STEP", step)
    rows = [(i, " ".join(["w"] * (i * 7919 % 40)) + ("\n\x0bx" if i % 3 else ""), (None, "", "b", "a", "ä", "big", "big", "big")[i % 8]) for i in range(700)] + [(1000, None, "a"), (1001, "w " * 9000, "tiny"), (1002, "", "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = mixing.mix(docs)
    assert rows_of(out) == brute(rows)
    near = {}
    for r in out.collect():
        near.setdefault((r.source_size, r.target), []).append((r.taken, r.size))
        assert r.taken <= 3 * r.size
    assert all(abs(sum(t for t, _ in v) - k[1]) <= max(s for _, s in v) for k, v in near.items())
    assert rows_of(mixing.mix(docs.repartition(7))) == rows_of(out)


def test_edge_rows(spark):
    schema = "doc_id long, text string, source string, size string, target string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b", "s", "x", "y"), (1, None, None, "x", "y"), (1, None, None, "x", "y"), (2, "", "s", "x", "y")]
    out = sorted(((r.doc_id or 0), r.size, r.taken) for r in mixing.mix(spark.createDataFrame(rows, schema)).collect())
    assert out == [(0, 2, 2), (1, 0, 0), (1, 0, 0), (2, 0, 0)]
    assert mixing.mix(spark.createDataFrame([(1, None, "a"), (2, " ", "b")], "doc_id long, text string, source string")).agg({"taken": "sum"}).first()[0] == 0


def test_rows_that_are_taken(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    out = mixing.mixed(docs)
    assert out.columns == [*docs.columns, "size", "source_size", "target", "taken", "repeats"]
    assert out.where("taken <> size * repeats or repeats = 0").count() == 0 and abs(out.agg({"taken": "sum"}).first()[0] - 400) <= 20


def test_rows_that_are_taken_keep_their_own_numbers(spark):
    rows = [(1, "w " * 500, "a", "mine"), (1, "w w w", "a", "mine"), (2, None, None, "mine"), (3, "x", "b", "mine"), (None, "x y", "b", "mine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    out = mixing.mixed(docs)
    assert out.columns == ["doc_id", "text", "source", "size", "mix_size", "source_size", "target", "taken", "repeats"]
    found = {(r.doc_id, r.mix_size, r.taken) for r in out.collect()}
    assert found <= {(r.doc_id, r.size, r.taken) for r in mixing.mix(docs).collect()} and {n for d, n, _ in found if d == 1} <= {3, 500}
    assert mixing.mixed(docs.limit(0)).count() == 0
