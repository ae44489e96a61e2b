import hashlib

import pytest
from pyspark.sql import functions as F

from markcheck.llm import exact_dedup

ROWS = [
    (5, "a b", "x"), (3, "ab", "x"), (4, "a\tb ", "x"), (7, " a b", "x"), (9, "", "x"), (8, None, "x"), (2, " \n\x0b\x0c\r", "x"), (1, "other", "x"), (6, "Ab", "x"),
    (10, "é é", "x"), (11, "éé ", "x"), (12, "é é", "x"), (-3, "neg", "x"), (9223372036854775807, "neg", "x"),
]


def brute(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault("".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r"), []).append((doc, text or ""))
    out = {}
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        for doc, _ in members:
            out.setdefault(doc, []).append((keep, len(members), doc == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return out


def result(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r.doc_id, []).append((r.keep_id, r.group_size, r.kept, r.text_sha256))
    return out


def test_equals_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, keep_id string").repartition(4)
    assert result(exact_dedup.exact_groups(docs)) == brute([r[:2] for r in ROWS])


def test_digest_collisions_do_not_merge(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, digest string").repartition(3)
    plain, clash = (result(exact_dedup.exact_groups(docs, **kw)) for kw in ({}, {"digest": lambda t: F.substring(t, 1, 1)}))
    assert {k: [x[:3] for x in v] for k, v in clash.items()} == {k: [x[:3] for x in v] for k, v in plain.items()}


def test_filter_keeps_one_of_each(spark):
    rows = [*ROWS, (None, "ab", "x"), (None, "single", "x"), (1, "other", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids.count(None) == 2 and ids.count(1) == 2 and len(ids) == len(set(ids)) + 2
    assert {3, 4, 5, 7} & set(ids) == {4}
    assert exact_dedup.exact_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("salts", [1, 5])
def test_hot_group(spark, salts):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    out = exact_dedup.exact_groups(docs, salts=salts)
    assert out.where("group_size = 1000 and keep_id = 0").count() == 1000 and out.where("kept").count() == 2001
