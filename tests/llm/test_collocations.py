"""Collocations equal their SQL and a plain count of all phrases, whatever the shards and however keys collide."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from markcheck.llm import collocations, registry

SF = "/root/testdata/sf0.001"


def plain(rows, least=10, top=2000):
    """Rows ``(text, lang)`` by definition, with Python's integers."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        found = []
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items() if len(p) == 2):
                continue
            score, k = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def made(seed, docs=120):
    """Few words, so that phrases repeat, with odd white space and ends of pieces."""
    rng = random.Random(seed)
    words = ["a", "B", "c", "É", "x-y", "the", "of", "\xa0", "d\x01", "\x1f"]
    rows = []
    for _ in range(docs):
        text = "".join(rng.choices(words, [9, 7, 5, 2, 2, 6, 4, 1, 1, 1])[0] + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "? "]) for _ in range(rng.randrange(40)))
        rows.append((text, rng.choice(["en", "en", "fr", None, ""])))
    return [*rows, (None, "en"), ("", None), ("A B " * 400, "en"), ("A B " * 400, "en"), (" \t ", "fr"), ("...", "xx")]


def frame(spark, rows):
    return spark.createDataFrame([(t, g, 1, "x") for t, g in rows], "text string, lang string, key long, phrase string")


def test_query_equals_sql_and_definition(spark):
    mine = sorted(map(tuple, registry.QUERIES["op12_collocations"](spark, SF).collect()))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert mine == sorted(duck.execute(registry.ORACLES["op12_collocations"]).fetchall())
    assert mine == plain(duck.execute("SELECT text, lang FROM documents").fetchall())


@pytest.mark.parametrize("shards", [1, 2, 5])
def test_any_number_of_shards_gives_the_same(spark, shards):
    rows = made(shards)
    assert sorted(map(tuple, collocations.collocations(frame(spark, rows), shards=shards).collect())) == plain(rows)


def test_top_and_least(spark):
    rows = made(7, 60)
    assert sorted(map(tuple, collocations.collocations(frame(spark, rows), least=2, top=7).collect())) == plain(rows, 2, 7)


def test_a_phrase_is_active_in_one_round_of_shards_after_its_parts():
    words = collocations.Words([b"a b c"], ["en"])
    found = [np.full(1 << collocations.BITS, collocations.NEVER, np.uint8) for _ in range(2)]

    def lengths(scan, shards=2):
        return [len(keys) for keys in collocations._active(words, found, scan, shards)]

    assert [lengths(s) for s in range(3)] == [[3, 0, 0], [3, 0, 0], [0, 0, 0]]
    bucket = collocations._bucket(words.keys[0], collocations.BITS)
    found[0][bucket[:2]] = (0, 1)  # of "a b" the second word was found frequent in scan 1
    assert [lengths(s) for s in range(5)] == [[3, 0, 0], [3, 0, 0], [0, 1, 0], [0, 1, 0], [0, 0, 0]]
    found[0][bucket[2]] = 0
    found[1][collocations._bucket(words.keys[1], collocations.BITS)] = 3
    assert [lengths(s)[2] for s in range(3, 7)] == [0, 1, 1, 0]


def test_phrases_of_one_key_are_told_apart(spark, monkeypatch):
    class Clashing(collocations.Words):
        """Phrases have one of 48 keys, of lengths apart."""

        def __init__(self, texts, langs):
            super().__init__(texts, langs)
            self.keys = [(k >> np.uint64(60) << np.uint64(60)) | (k & np.uint64(3)) for k in self.keys]

    monkeypatch.setattr(collocations, "Words", Clashing)
    rows = made(3)
    mine = collocations._name

    def named(tables, counting):
        run = mine(tables, counting)

        def clashing(batches):
            collocations.Words = Clashing  # in the worker, too
            yield from run(batches)

        return clashing

    scan = collocations._scan

    def scanned(tables, number, shards):
        run = scan(tables, number, shards)

        def clashing(batches):
            collocations.Words = Clashing
            yield from run(batches)

        return clashing

    monkeypatch.setattr(collocations, "_name", named)
    monkeypatch.setattr(collocations, "_scan", scanned)
    counts, totals = collocations.phrases(frame(spark, rows))
    want = Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^ \t]+", piece)
            want.update(("und" if lang is None else lang, " ".join(words[i : i + k])) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    assert {(r.lang, r.phrase): r.f for r in counts.collect()} == {p: n for p, n in want.items() if n >= 10}


def test_empty_tables(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None), ("", "en"), ("one word", "en")], "text string, lang string")).collect() == []


def test_very_long_texts(spark):
    rng = random.Random(5)
    rows = [(" ".join(rng.choice("abcdefg") * rng.randrange(1, 3) for _ in range(60_000)), "en"), ("z" * 300_000 + " y", "en")]
    assert sorted(map(tuple, collocations.collocations(frame(spark, rows)).collect())) == plain(rows)


def test_word_keys_take_few_bytes_for_each_of_the_text():
    import tracemalloc

    import pyarrow.parquet as pq

    texts = [x.encode() for x in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()]
    size = sum(map(len, texts))
    collocations._powers(size + len(texts) + 2)
    tracemalloc.start()
    collocations.Words(texts, ["und"] * len(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 23 * size
