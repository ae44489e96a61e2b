"""Markup whose braces nest deeper than a pattern counts, or hold strings, templates and comments with braces."""

import random

import pytest
from pyspark.sql import functions as F

from markcheck.functions import braces
from markcheck.operators import markup

NESTED = "{" * 10 + "a" + "}" * 10


def events(spark, *texts, masked=True):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc long, html string")
    return (markup.masked_tag_events if masked else markup.tag_events)(frame)


def spans(frame):
    return sorted((r.doc, r.start, r.end, r.kind, r.name) for r in frame.collect())


@pytest.mark.parametrize(
    ("tag", "attributes"),
    [
        ("<b x={a({b:{c:{d:1}}}) > 2} y=\"1\">", [("x", "expression", "{a({b:{c:{d:1}}}) > 2}"), ("y", "text", "1")]),
        (f"<b x={NESTED} {NESTED}>", [("x", "expression", NESTED), (NESTED.strip("{}"), "expression", NESTED)]),
        ("<b x={'}>'} y>", [("x", "expression", "{'}>'}"), ("y", "bare", "")]),
        ("<b x={\"}\" + \"{>\"} y>", [("x", "expression", "{\"}\" + \"{>\"}"), ("y", "bare", "")]),
        ("<b x={`a ${f({b: `}>`})} }`}>", [("x", "expression", "{`a ${f({b: `}>`})} }`}")]),
        ("<b x={a /* }> */ + b} on:click|once={() => {if (a) {b({c: {}})}}}>", [("x", "expression", "{a /* }> */ + b}"), ("click", "expression", "{() => {if (a) {b({c: {}})}}}")]),
        ("<b x=\"p {a({b:{c:{d:'\\''}}})} é\" z>", [("x", "mixed", "p {a({b:{c:{d:'\\''}}})} é"), ("z", "bare", "")]),
    ],
)
def test_a_tag_ends_behind_its_braces(spark, tag, attributes):
    html = f"é{tag}t</b>"
    found = events(spark, html)
    size = len(tag.encode())
    assert spans(found) == [(0, 2, 2 + size, "open", "b"), (0, 3 + size, 7 + size, "close", "b")] == spans(events(spark, html, masked=False))
    got = [(r.name, r.value_kind, r.value) for r in markup.attributes(found).orderBy("ord").collect()]
    assert [g[1:] for g in got] == [a[1:] for a in attributes]
    assert all(g[0] == a[0] for g, a in zip(got, attributes) if not a[2].startswith("{" * 10) or a[0] == "x")


def test_raw_sections_comments_and_open_braces(spark):
    html = f"<!-- <b {NESTED} --><script x={NESTED} y={{'>'}}>{{<i>}}</SCRIPT ><p {{><a b={NESTED}>{NESTED}{{'}}'}}</a><q {NESTED}"
    frame = spark.createDataFrame([(1, html)], "doc long, html string")
    found = [(html.encode()[r.start : r.end].decode(), r.kind) for r in markup.masked_tag_events(frame).orderBy("start").collect()]
    assert found == [(f"<script x={NESTED} y={{'>'}}>", "open"), ("</SCRIPT >", "close"), ("<p {>", "open"), (f"<a b={NESTED}>", "open"), ("</a>", "close"), (f"<q {NESTED}", "open")]
    section = markup.sections(frame).first()
    assert section.body == "{<i>}" and html.encode()[section.body_start : section.body_end] == b"{<i>}"
    assert [r.text for r in markup.comments(frame).collect()] == [f" <b {NESTED} "]
    assert [(r.text, html[r.start : r.end]) for r in markup.expressions(frame).orderBy("start").collect()] == [(NESTED[1:-1], NESTED), ("'}'", "{'}'}")]


def test_shallow_texts_are_cut_alike_either_way(spark):
    """The pattern and the scan agree wherever the pattern is trusted."""
    rng = random.Random(4)
    parts = ["<a", "<b ", "</a>", ">", "/>", " x=", '"q"', "'r'", "{a}", "{b {c}}", "{\"s\"}", "=", "<!--", "-->", "<script>", "</script>", "<script ", "é", " ", "\n", "t", "/", "<"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 16))) for _ in range(600)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc long, html string")
    trusted = {r.doc for r in frame.where(~markup._deep(F.col("html"))).collect()}
    assert len(trusted) > 300
    for masked, pattern in ((True, f"(?is){markup.COMMENT}|{markup.RAW}|{markup.TAG}"), (False, markup.TAG)):
        found = frame.select("doc", F.regexp_extract_all("html", F.lit(pattern), F.lit(0)).alias("t"))
        for r in found.collect():
            if r.doc in trusted:
                assert r.t == [texts[r.doc][a:b] for a, b, _ in braces.flat_tokens(texts[r.doc], masked)], texts[r.doc]


def test_flat_tokens_keep_every_length():
    for text in (f"<b x={NESTED}>", "<b {'}'}>{", "<b {a", "<b x={`${'{'}`}>", "<script>{</script>"):
        assert all(len(flat) == end - start for start, end, flat in braces.flat_tokens(text, True))
        assert len(braces.flat_text(text)) == len(text)


def test_deep_texts_are_cut_a_few_at_a_time(monkeypatch):
    import pyarrow as pa

    texts = [f"<b x={NESTED}>é", "", "t", "<a>" * 30]
    batch = pa.RecordBatch.from_pydict({"doc": range(4), "html": texts})
    run = markup._rows(lambda t: braces.flat_tokens(t, True), ["doc"], "html")
    whole = [r for b in run(iter([batch])) for r in b.to_pylist()]
    monkeypatch.setattr(markup, "SLICE", 40)
    few = list(run(iter([batch])))
    assert [b.num_rows for b in few] == [3, 1]
    assert [r for b in few for r in b.to_pylist()] == whole
    assert ["".join(p["gap"] + (p["text"] or "") for p in r["cut"]) for r in whole] == texts
