import hashlib
import random
import re

from markcheck.llm import decontamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for doc, text in docs:
        words, hit, found = words_of(text), set(), set()
        for item, item_text in items:
            asked = words_of(item_text)
            size = min(13, len(asked))
            windows = {tuple(asked[i : i + size]) for i in range(len(asked) - size + 1)} if asked else set()
            for i in range(len(words) - size + 1 if windows else 0):
                if tuple(words[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    found.add(str(item) if item is not None else "")
        ids = ",".join(sorted(found))
        out.append((doc, len(words), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(words)))
    return sorted(out, key=str)


def rows_of(frame):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in frame.collect()), key=str)


def planted(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(80)] + ["the"] * 40 + ["Élan", "año"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 5, 12, 13, 14, 30, 60])))) for k in range(25)] + [(90, "the the the"), (91, None), (92, " -- "), (None, "lonely null item words"), (7, "again under one id")]
    docs = []
    for k in range(120):
        words = rng.choices(vocabulary, k=rng.randrange(200))
        for _ in range(rng.randrange(3)):
            item = words_of(rng.choice(items)[1])
            at = rng.randrange(len(words) + 1)
            words[at:at] = item[rng.randrange(3) :] if rng.random() < 0.5 else item
        docs.append((k, "; ".join(words) if k % 2 else " ".join(words).upper()))
    return docs + [(500, None), (501, ""), (501, ""), (None, items[3][1]), (502, "the " * 3000)], items


def test_equals_brute_force(spark):
    docs, items = planted(3)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(decontamination.contamination(d, b)) == brute(docs, items)


def test_blocks_change_nothing(spark):
    docs, items = planted(4)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(decontamination.contamination(d, b, block_bytes=1500)) == brute(docs, items)


def test_edges_and_filter(spark):
    d = spark.createDataFrame([(1, "a b c", "s", 1), (2, "none", "s", 2)], "doc_id long, text string, spans string, n_hit int")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontamination.contamination(d, none).collect()] == [False, False]
    assert decontamination.contamination(d.limit(0), none).count() == 0
    one = spark.createDataFrame([("x", "A b")], "item_id string, text string")
    kept = decontamination.drop_contaminated(d, one)
    assert kept.columns == d.columns and [r.doc_id for r in kept.collect()] == [2]
