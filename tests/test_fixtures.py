"""Small inputs with known answers."""

import json
import os
import random
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from markcheck.functions import paths
from markcheck.functions import text as T
from markcheck.operators import config, edits, findings, incremental, lines, markup, nesting, report, spans, tokens
from markcheck.sources import corpus, listing, logs, versions
from markcheck.streaming import watch


def tags(spark, *texts):
    return markup.masked_tag_events(spark.createDataFrame(list(enumerate(texts)), "doc long, html string"))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


CASES = [
    ("<h1>Title</h1><h3>Skipped h2</h3>", ["A11y: Heading levels should not be skipped (h1 followed by h3)"]),
    ("<h1>Title</h1><h2>Section</h2><h3>Subsection</h3>", []),
    ("<h3>a</h3><h1>b</h1><h2>c</h2>", []),
    ("<div>Content</span>", ["mismatched closing tag: expected </div>, found </span>"]),
    ("<div><span>Content</div></span>", ["mismatched closing tag: expected </div>, found </span>", "mismatched closing tag: expected </span>, found </div>"]),
    ("<DIV>Content</div>", ["mismatched closing tag: expected </DIV>, found </div>"]),
    ("<div>\n\t<span>Content without closing span\n</div>", ["mismatched closing tag: expected </span>, found </div>", "unclosed tag: <div>"]),
    ("</b><a></a>", []),
    ("<br><img src=x><i/>", []),
    ("<p><!-- <b> --><script>'</p><b>'</script></p>", []),
    ("<script>never closed <b>", ["unclosed tag: <script>"]),
    ("<ul><li>Item 1<li>Item 2<li>Item 3</ul>", []),
    ("<ul><li><ul><li>a</li></ul></li><li>b</li></ul>", []),
    ("<ol><li><b>x</b><ul><li>a<li>b</ul><li>c</ol>", []),
    ("<ul><li>a<li>b</li></li></ul>", ["mismatched closing tag: expected </ul>, found </li>"]),
    ("<button on:click={() => go(1)} class='x'>b</button>", []),
    ("<a title='a > b' href=\"</b>\">l</a>", []),
    ("<p><script>if (a) '</scripty>'<b></script ><i></i></p>", []),
    ("<style>a{}</STYLE\n>", ["mismatched closing tag: expected </style>, found </STYLE>"]),
    ("", []),
]


@pytest.mark.parametrize("text,expected", CASES)
def test_rules(spark, text, expected):
    assert sorted(r.message for r in findings.run_rules(tags(spark, text)).collect()) == sorted(expected)


def test_depth_floors_at_zero(spark):
    events = spark.createDataFrame([(1, i, s) for i, s in enumerate([1, -1, -1, 1, 1, -1])], "doc int, pos int, s int")
    assert [r.depth for r in nesting.depth(events, F.col("s"), "doc", ["pos"]).orderBy("pos").collect()] == [1, 0, 0, 1, 2, 1]


def test_optional_end_tags(spark):
    closed = nesting.implicit_closes(tags(spark, "<ul><li>1<li>2<li>3</ul>", "<ul><li>a</li></ul>", "<b><li>x</b>"))
    assert rows(closed.where("synthetic"), "doc", "start", "name") == [(0, 9, "li"), (0, 14, "li"), (0, 19, "li")]
    ended = nesting.with_optional_ends(tags(spark, "<ul><li>1<li>2<li>3</ul>", "<ul><li>a</li></ul>", "<b><li>x</b>"))
    assert rows(ended.where("start = end"), "doc", "start", "name") == [(0, 9, "li"), (0, 14, "li"), (0, 19, "li")]
    assert rows(ended.where("doc > 0"), "doc", "start", "kind") == [(1, 0, "open"), (1, 4, "open"), (1, 9, "close"), (1, 14, "close"), (2, 0, "open"), (2, 3, "open"), (2, 8, "close")]


def test_tags_step_over_quotes_and_braces(spark):
    text = "<a t=\"x > y\" on:e={() => { go(1) }} b>é</a ><script>1</scripty></script >{call(1)} x={y}<i x=don't>"
    placed = [(text.encode()[r.start : r.end].decode(), r.kind, r.name) for r in tags(spark, text).orderBy("start").collect()]
    assert placed == [('<a t="x > y" on:e={() => { go(1) }} b>', "open", "a"), ("</a >", "close", "a"), ("<script>", "open", "script"), ("</script >", "close", "script"), ("<i x=don't>", "open", "i")]
    pages = spark.createDataFrame([(1, text)], "doc long, html string")
    assert [(text.encode()[r.start : r.end].decode(), r.text) for r in markup.expressions(pages).orderBy("start").collect()] == [("{call(1)}", "call(1)"), ("{y}", "y")]
    found = findings.run_rules(tags(spark, text), ["component"], inputs={"component": markup.expressions(spark.createDataFrame([(1, "<p a={$state(0)}>{$state(0)} {$stateValue} {my$state(0)}</p>")], "doc long, html string"))})
    assert rows(found, "start", "end", "code", "severity") == [(17, 28, "invalid-rune-usage", "error")]
    long = "<p " + "a=\"x\" " * 50_000 + ">"
    assert tags(spark, long).select("end").first()[0] == len(long)


def test_attributes(spark):
    found = markup.attributes(tags(spark, "<div class=\"foo\" class='bar' hidden on:click|once|self={go} x={a} y=\"p{b}q\" n=5>"))
    assert rows(found, "ord", "name", "value_kind", "value") == [(0, "class", "text", "foo"), (1, "class", "text", "bar"), (2, "hidden", "bare", ""), (3, "click", "expression", "{go}"), (4, "x", "expression", "{a}"), (5, "y", "mixed", "p{b}q"), (6, "n", "text", "5")]
    assert [(r.directive, r.modifiers) for r in found.where("ord = 3").collect()] == [("on", ["once", "self"])]
    numeric = findings.check_numeric_attributes(markup.attributes(tags(spark, '<img width="10" span="NaN" alt="3" tabindex="{1}" rows=" 2.5 " aria-level="2" ROWS=1>')))
    assert rows(numeric, "name", "number") == [("aria-level", 2.0), ("rows", 2.5)]
    found = markup.attributes(tags(spark, "<a {name} {...rest} on:click={() => go({ a: 1 })} t=\"a > b\" u=x{y}z>"))
    assert rows(found, "ord", "name", "value_kind", "value") == [(0, "name", "expression", "{name}"), (1, "...rest", "expression", "{...rest}"), (2, "click", "expression", "{() => go({ a: 1 })}"), (3, "t", "text", "a > b"), (4, "u", "mixed", "x{y}z")]


def test_sections(spark):
    pages = spark.createDataFrame([(1, '<script context="module">a</script><script lang="ts">b</script><style>c</style><script>d</script>')], "doc long, html string")
    found = markup.sections(pages)
    assert rows(found, "name", "context", "lang", "body") == [("script", "instance", "js", "d"), ("script", "instance", "ts", "b"), ("script", "module", "js", "a"), ("style", "instance", "js", "c")]
    assert rows(markup.last_sections(found), "name", "context", "body") == [("script", "instance", "d"), ("script", "module", "a"), ("style", "instance", "c")]


def test_comments(spark):
    pages = spark.createDataFrame([(1, "é<!-- a --><b><!--open")], "doc long, html string")
    assert rows(markup.comments(pages), "start", "end", "text") == [(2, 12, " a "), (15, 23, "open")]


def test_line_positions(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, "hello\nworld\nfoo"), (3, "hello\nworld\n"), (4, "")], "doc long, text string")
    table = lines.line_table(docs)
    assert rows(table, "doc", "start") == [(1, 0), (2, 0), (2, 6), (2, 12), (3, 0), (3, 6), (3, 12), (4, 0)]
    points = spark.createDataFrame([(1, 5), (2, 5), (2, 6), (2, 10), (2, 12), (2, 99)], "doc long, offset long")
    placed = lines.line_col(table, points)
    assert rows(placed, "doc", "offset", "line", "col") == [(1, 5, 0, 5), (2, 5, 0, 5), (2, 6, 1, 0), (2, 10, 1, 4), (2, 12, 2, 0), (2, 99, 2, 87)]
    assert rows(lines.offset_of(table, placed.select("doc", "line", "col")), "offset") == sorted(rows(points, "offset"))


def test_clamped_positions(spark):
    table = lines.line_table(spark.createDataFrame([(1, "line1\nline2\nline3"), (2, "é\n")], "doc long, text string"))
    asked = spark.createDataFrame([(1, 1, 1), (1, 1, 3), (1, 2, 1), (1, 3, 1), (1, 3, 50), (1, 9, 1), (2, 1, 2), (2, 1, 3)], "doc long, line long, col long")
    assert rows(lines.offset_of_clamped(table, asked), "doc", "line", "col", "offset") == [(1, 1, 1, 0), (1, 1, 3, 2), (1, 2, 1, 6), (1, 3, 1, 12), (1, 3, 50, 12), (1, 9, 1, 17), (2, 1, 2, 2), (2, 1, 3, 0)]


MAPS = [
    ([(0, 5, 0), (10, 15, 100)], [(7, 3)], {0: 0, 13: 100, 17: 104}),
    ([(0, 10, 0)], [(3, 3)], {0: 0, 2: 2, 4: None, 8: 5, 12: 9}),
    ([(0, 4, 0), (4, 8, 50), (8, 12, 80)], [(1, 3), (4, 2)], {0: 0, 6: 3, 9: 50, 13: 80}),
]


@pytest.mark.parametrize("spans_,edits_,probes", MAPS)
def test_span_maps_follow_edits(spark, spans_, edits_, probes):
    before = spark.createDataFrame([(1, *s) for s in spans_], "doc long, gen_start long, gen_end long, orig_start long")
    after = spans.shift_spans(before, spark.createDataFrame([(1, *e) for e in edits_], "doc long, at long, delta long"))
    points = spark.createDataFrame([(1, p) for p in probes], "doc long, offset long")
    assert {r.offset: r.original for r in spans.to_original(points, after).collect()} == probes


def test_span_algebra(spark):
    row = spark.range(1).select(
        spans.contains(F.lit(1), F.lit(1), F.lit(1)), spans.contains(F.lit(1), F.lit(3), F.lit(3)), spans.contains_span(F.lit(1), F.lit(3), F.lit(3), F.lit(3)), spans.cover(F.lit(1), F.lit(3), F.lit(5), F.lit(9))
    ).first()
    assert tuple(row[:3]) == (False, False, True) and tuple(row[3]) == (1, 9)


def test_edits_are_picked_and_applied(spark):
    found = spark.createDataFrame([(1, 0, 3, 0), (1, 2, 4, 1), (1, 5, 9, 2), (1, 3, 5, 3), (1, 9, 8, 4)], "doc long, start long, end long, ord long")
    picked = edits.pick_edits(found)
    assert rows(picked, "start", "end") == [(0, 3), (3, 5), (5, 9)]
    docs = spark.createDataFrame([(1, "0123456789é"), (2, "same")], "doc long, text string")
    done = edits.apply_edits(docs, picked.where("start <> 3").withColumn("replacement", F.concat(F.lit("<"), "start", F.lit(">"))))
    assert rows(done, "doc", "text") == [(1, "<0>34<5>9é"), (2, "same")]


LOG = [
    ("src/App.page.ts(10,5): error TS2322: Type 'string' x", ("src/App.page.ts", 10, 5, "error", "TS2322", "Type 'string' x", False)),
    ("src/routes/(app)/imports/+page.server.ts(87,5): error TS2322: y", ("src/routes/(app)/imports/+page.server.ts", 87, 5, "error", "TS2322", "y", False)),
    ("error TS2318: Cannot find global type 'Array'.", ("conf", 0, 0, "error", "TS2318", "Cannot find global type 'Array'.", True)),
    ("warning TS5102: Option 'foo' has been removed.", ("conf", 0, 0, "warning", "TS5102", "Option 'foo' has been removed.", True)),
    ("Found 3 errors.", None),
    ("error something not a code", None),
    ("error TS12:  ", None),
    ("", None),
]


def test_log_lines(spark):
    parsed = logs.parse_log(spark.createDataFrame([(t,) for t, _ in LOG], "value string"), "conf")
    assert rows(parsed, "file", "start_line", "start_col", "severity", "code", "message", "position_unknown") == sorted(x for _, x in LOG if x)


def test_failed_results_stop_the_batch(spark):
    good = spark.createDataFrame([('{"k": 3}',), ("broken",)], "value string")
    assert [r.r and r.r.k for r in logs.parse_results(good, "k INT").collect()] == [3, None]
    with pytest.raises(Exception, match="checker failed"):
        logs.parse_results(spark.createDataFrame([('{"error": "no"}',)], "value string"), "k INT").collect()


def test_globs_and_suffixes(spark):
    forms = ["src/excluded", "./src/excluded", "**/*.test.ts", "src/*.test.ts", "src/excluded/**", " a/ "]
    found = spark.createDataFrame([(f,) for f in forms], "p string").select(paths.normalized_glob(F.col("p")).alias("g")).collect()
    assert [r.g for r in found] == ["src/excluded/**", "src/excluded/**", "**/*.test.ts", "src/*.test.ts", "src/excluded/**", "a/"]
    files = spark.createDataFrame([("src/excluded/nested/File.x",), ("src/lib/Component.x",), ("a/node_modules/b.x",)], "path string")
    assert rows(corpus.without_ignored(files, ["src/excluded/**"]), "path") == [("a/node_modules/b.x",), ("src/lib/Component.x",)]
    assert rows(corpus.without_ignored(files), "path") == [("src/excluded/nested/File.x",), ("src/lib/Component.x",)]
    many = [f"g{i}/**" for i in range(30)] + ["src/**"]
    assert rows(corpus.without_ignored(files, many), "path") == [("a/node_modules/b.x",)]
    names = spark.createDataFrame([("page.x.md",), ("a.svx",), ("b.svx",), ("c.mdx",), ("noext",)], "name string")
    out = report.skipped_by_suffix(names, [".md", ".x.md"])
    assert rows(out, "label", "files") == [(".mdx", 1), (".svx", 2), (".x.md", 1), ("noext", 1)]
    assert "warning: 2 files with unregistered extension (.svx) skipped" in [r.text for r in out.collect()]


def test_paths(spark):
    def value(column):
        return spark.range(1).select(column.alias("v")).first().v

    assert value(paths.normalized(F.lit("/a/./b/../c//d"))) == "/a/c/d"
    assert value(paths.normalized(F.lit("../../a/.."))) == "../.." and value(paths.normalized(F.lit("a/.."))) == "." and value(paths.normalized(F.lit("/.."))) == "/"
    assert value(paths.relative(F.lit("/a/b"), F.lit("/a/c/d"))) == "../c/d" and value(paths.relative(F.lit("/a"), F.lit("/a"))) == ""
    assert value(paths.import_path(F.lit("src/a/x.ts"), F.lit("src/b.ts"))) == "../b.ts" and value(paths.import_path(F.lit("x.ts"), F.lit("y.ts"))) == "./y.ts"
    assert tuple(value(paths.split_reference(F.lit("./a.js#h?q")))) == ("./a.js", "#h?q")
    assert value(paths.is_within(F.lit("/a/b"), F.lit("/a"))) and not value(paths.is_within(F.lit("/ab"), F.lit("/a")))
    assert value(paths.under(F.lit("/root/a/b"), "/root")) == "a/b" and value(paths.under(F.lit("/rooted/a"), "/root")) == "rooted/a"


def test_external_references(spark):
    links = spark.createDataFrame([("/en/x/page", "../../../out/a.js?q"), ("/en/x/page", "../y"), ("/en/x/page", "z")], "page string, reference string")
    assert rows(findings.check_external_references(links, "/en"), "reference", "target", "rewritten") == [("../../../out/a.js?q", "/out/a.js", "../out/a.js?q")]


def test_names_and_tokens(spark):
    found = spark.createDataFrame([("br",), ("BR",), ("x:head",), ("a.B",), ("my-tag",), ("div",)], "n string").select(T.tag_class(F.col("n")).alias("c")).collect()
    assert [r.c for r in found] == ["void", "component", "prefixed", "component", "custom", "element"]
    docs = spark.createDataFrame([(1, "é of offer $state.raw(0) of"), (2, 'use $a and "$b" // $c\n$a')], "doc long, text string")
    assert rows(tokens.token_occurrences(docs, ["of", "$state", "$state.raw"]), "doc", "start", "token") == [(1, 3, "of"), (1, 12, "$state.raw"), (1, 26, "of")]
    assert rows(tokens.marked_names(docs.where("doc = 2"), "$"), "name") == [("a",)]
    calls = spark.createDataFrame([(1, "{$state(0)}"), (2, "$stateValue"), (3, "my$state(0)"), (4, "$state.raw(0) $state(1)"), (5, "é$state(0)")], "doc long, text string")
    assert rows(tokens.first_calls(calls, ["$state"]), "doc", "start") == [(1, 1)]
    refs = spark.createDataFrame([(1, "import a from './a'; require(\"b\"); x('no')")], "doc long, text string")
    assert rows(tokens.quoted_references(refs), "start", "reference") == [(15, "./a"), (30, "b")]
    refs = spark.createDataFrame([(1, "// from 'c'\né = import('d') /* import 'e' */")], "doc long, text string")
    assert rows(tokens.quoted_references(refs), "start", "reference") == [(25, "d")]
    code = spark.createDataFrame([(1, "of 'of' `of` /* of */ \"a\\\"of\" // of\nof's $a '$b' `$c` /* $d */")], "doc long, text string")
    assert rows(tokens.token_occurrences(code, ["of"], skip=tokens.CODE, keep=["text"]), "start") == [(0,), (36,)]
    assert rows(tokens.marked_names(code.withColumn("text", F.lit("$a '$b' `$c` /* $d */ $a")), "$"), "name") == [("a",)]


def test_overrides_come_before_the_threshold(spark):
    found = spark.createDataFrame([("a", "warning", 1), ("b", "warning", 2), ("c", "error", 3)], "code string, severity string, ordinal int")
    levels = spark.createDataFrame([("a", "ERROR"), ("c", "Ignore"), ("b", "other")], "code string, level string")
    assert rows(findings.at_least(findings.overridden(found, levels), "error"), "code", "severity") == [("a", "error")]


def test_owned_findings_dedup_after_downgrade(spark):
    found = spark.createDataFrame([("./C.json", "TS1", "m", "error", 1), ("c.json", "TS1", "m", "warning", 2), ("x.ts", "TS1", "m", "error", 3), ("x.ts", "TS1", "m", "error", 4), ("c.json", "TS9", "m", "error", 5)], "file string, code string, message string, severity string, ordinal int")
    owned = F.lower("file").endswith("c.json")
    out = findings.deduplicated(findings.downgraded(found, owned, ["TS9"]), owned, ["code", "message"])
    assert rows(out, "ordinal", "severity") == [(1, "warning"), (3, "error"), (4, "error"), (5, "error")]


def test_summary_wording(spark):
    schema = "file string, severity string"
    empty = report.summary(spark.createDataFrame([], schema), True).first()
    assert tuple(empty) == ("found 0 errors and 0 warnings", False)
    one = report.summary(spark.createDataFrame([("a", "warning")], schema), True).first()
    assert one.failed and one.text.endswith("\nfound 0 errors and 1 warning in 1 file")


def test_layers_and_chains(spark):
    rows_ = [("r", 0, "x", "1", "b0"), ("r", 1, "x", None, "b1"), ("r", 2, "y", "3", "b2"), ("r", 1, "y", "2", "b1")]
    out = config.layered(spark.createDataFrame(rows_, "root string, layer int, name string, value string, base string"))
    assert rows(out, "name", "value", "base") == [("x", "1", "b0"), ("y", "3", "b2")]
    chain = config.chain(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", None)], "node string, parent string"))
    assert rows(chain.where("node in ('a', 'd')"), "node", "ancestor", "distance") == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("d", "d", 0)]
    line = config.chain(spark.createDataFrame([(k, k + 1 if k < 99 else None) for k in range(100)], "node int, parent int"))
    assert line.count() == 5050 and rows(line.where("node = 0").agg(F.max("distance").alias("d"), F.count("*").alias("n")), "d", "n") == [(99, 100)]


def test_incremental_cases(spark, tmp_path):
    def snapshot(*pairs):
        return spark.createDataFrame([(k, t) for k, t in pairs], "path string, text string").withColumn("fingerprint", incremental.fingerprint(F.col("path"), F.col("text")))

    old, new = snapshot(("a", "1"), ("b", "2"), ("c", "3")), snapshot(("a", "1"), ("b", "2 "), ("d", "4"))
    assert rows(incremental.change_classes(new, old, "path"), "path", "change") == [("a", "unchanged"), ("b", "changed"), ("c", "removed"), ("d", "added")]
    assert rows(incremental.mirror_plan(new, old, "path"), "path", "action") == [("a", "keep"), ("b", "copy"), ("c", "delete"), ("d", "copy")]
    hits, misses = incremental.reuse_split(new, old)
    assert rows(hits, "path") == [("a",)] and rows(misses, "path") == [("b",), ("d",)]
    target = str(tmp_path / "out")
    assert incremental.write_changed(old.select("path", "text"), target, "path", "text") == {"written": 3, "skipped": 0, "removed": 0}
    assert incremental.write_changed(old.select("path", "text"), target, "path", "text") == {"written": 0, "skipped": 3, "removed": 0}
    assert incremental.write_changed(new.select("path", "text"), target, "path", "text") == {"written": 2, "skipped": 1, "removed": 1}
    assert rows(incremental.read_snapshot(spark, target), "path", "text") == [("a", "1"), ("b", "2 "), ("d", "4")]
    (tmp_path / "out" / "version=000000009-torn").mkdir()  # a writer that failed leaves no mark
    (tmp_path / "out" / "version=000000009-torn" / "part-0.parquet").write_bytes(b"torn")
    assert incremental.write_changed(new.select("path", "text"), target, "path", "text") == {"written": 0, "skipped": 3, "removed": 0}
    assert incremental.read_snapshot(spark, str(tmp_path / "none")) is None
    numbered = new.withColumn("ordinal", F.ascii("path") * -1)
    out = incremental.reused(numbered, old.select("fingerprint", F.lit("old").alias("result")), lambda r: r.withColumn("result", F.lit("new"))).collect()
    assert [(r.path, r.result, r.reused) for r in out] == [("d", "new", False), ("b", "new", False), ("a", "old", True)]
    members = spark.createDataFrame([("g", "lock", "1", False), ("g", "spare", "2", True), ("h", "spare", "2", True)], "grp string, name string, content string, later boolean")
    with_spare = {r.grp: (r.members, r.manifest) for r in incremental.group_fingerprints(members, "grp", "name", "content", F.col("later")).collect()}
    alone = {r.grp: (r.members, r.manifest) for r in incremental.group_fingerprints(members.where("not later or grp = 'h'"), "grp", "name", "content").collect()}
    assert with_spare == alone
    states = incremental.correlate(old.select("path"), new.select("path"), "path")
    assert rows(states, "path", "state") == [("a", "answered"), ("b", "answered"), ("c", "missing"), ("d", "unknown")]
    with pytest.raises(Exception, match="not answered exactly once"):
        incremental.assert_correlated(states).collect()


def test_metrics_measure_phases(spark):
    phases = report.Phases()
    with phases("scan"):
        spark.range(3).count()
    out = json.loads(report.run_metrics(spark.range(3).agg(F.count("*").alias("files")), ["scan", "check"], phases).first().json)
    assert out["counts"] == {"files": 3} and out["ms"]["scan"] > 0 and out["ms"]["check"] is None


def test_globs_and_routes(spark):
    paths_ = ["a/x.test.ts", "a/x.spec.ts", "a/x.ts", "docs/readme", "docs/1/a", "b5.js", "bx.js", "src/lib/y,z"]
    files = spark.createDataFrame([(p,) for p in paths_], "path string")
    assert rows(corpus.without_ignored(files, ["**/*.{test,spec}.ts", "docs", "b[0-9].js", "{q,src/{lib,x}/*}"]), "path") == [("a/x.ts",), ("bx.js",)]
    assert rows(corpus.without_ignored(files, ["b[!0-9].js", "**/x.*"]), "path") == [("b5.js",), ("docs/1/a",), ("docs/readme",), ("src/lib/y,z",)]
    routes = {"/r/src/routes/+page@.ts": "page", "/r/a/+layout.server.js": "layout-server", "/r/+page.html": None, "/r/src/hooks.ts": "universal-hooks", "/r/src/params/m.js": "params", "/r/lib/src/params/m.js": None, "/r/src/params/m.spec.js": None, "ts": None}
    found = spark.createDataFrame([(p,) for p in routes], "path string").select("path", paths.route_kind(F.col("path"), "/r").alias("kind"))
    assert {r.path: r.kind for r in found.collect()} == routes


def test_a_watch_sees_edited_and_vanished_files(spark, tmp_path):
    root, snapshots = tmp_path / "site", str(tmp_path / "snap")
    root.mkdir()

    def check(batch):
        return findings.run_rules(markup.masked_tag_events(batch, "path", "text"), ["nesting"]).select(F.col("doc").alias("path"), "code")

    def pass_over(batch_id):
        watch.recheck(spark, str(root), [".page"], batch_id, check, snapshots)
        return sorted((r.path.rpartition("/")[2], r.code) for r in watch.standing(spark, snapshots).collect())

    def write(name, text, at):
        (root / name).write_text(text)
        os.utime(root / name, (at, at))

    write("a.page", "<b>x</i>", 1_000)
    write("b.page", "<b>", 2_000)
    first = [("a.page", "mismatched-close"), ("b.page", "unclosed-tag")]
    assert pass_over(0) == first and pass_over(1) == first
    write("b.page", "<b></b>", 3_000)
    assert pass_over(2) == [("a.page", "mismatched-close"), ("b.page", None)]
    write("a.page", "<b>", 4_000)
    (root / "b.page").unlink()
    assert pass_over(3) == [("a.page", "unclosed-tag")] == pass_over(3)
    query = watch.watch_edits(spark, str(root), [".page"], check, str(tmp_path / "snap2"), str(tmp_path / "check2"))

    def seen(want):
        for _ in range(120):
            now = watch.standing(spark, str(tmp_path / "snap2"))  # reads while versions are written
            if now is not None and sorted((r.path.rpartition("/")[2], r.code) for r in now.collect()) == want:
                return True
            time.sleep(0.25)
        return False

    try:
        assert seen([("a.page", "unclosed-tag")])
        write("a.page", "<i></b>", 5_000)
        write("c.page", "<p></p>", 5_000)
        assert seen([("a.page", "mismatched-close"), ("c.page", None)])
        (root / "c.page").unlink()
        assert seen([("a.page", "mismatched-close")])
    finally:
        query.stop()


def test_ignored_folders_are_not_listed(spark, tmp_path, monkeypatch):
    for name in ("a/x.page", "a/dist/y.page", "a/dist/deep/z.page", "b/c/w.page", "b/w.txt", "dist/v.page"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("<b>")
    tree, looked = listing.Tree(str(tmp_path), [".page"], ["**/dist/**"]), []
    mine = listing.Tree.look
    monkeypatch.setattr(listing.Tree, "look", lambda self, folder: (looked.append(folder[len(str(tmp_path)) + 1 :]), mine(self, folder))[1])
    assert sorted(f.path[len(str(tmp_path)) + 1 :] for _, own in tree.walk() for f in own) == ["a/x.page", "b/c/w.page"]
    assert sorted(looked) == ["", "a", "b", "b/c"]
    found = corpus.scan_files(spark, str(tmp_path), [".page"], ["**/dist/**"])
    assert sorted((r.path[len(str(tmp_path)) + 1 :], r.text, r.bytes) for r in found.collect()) == [("a/x.page", "<b>", 3), ("b/c/w.page", "<b>", 3)]
    assert corpus.scan_files(spark, str(tmp_path / "nothing"), [".page"]).collect() == []


def test_writers_beside_each_other_lose_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")

    def frame(keys, text):
        return spark.createDataFrame([(k, text) for k in keys], "path string, text string")

    assert incremental.write_changed(frame(["a", "b"], "1"), path, "path", "text") == {"written": 2, "skipped": 0, "removed": 0}
    with ThreadPoolExecutor(3) as pool:
        got = list(pool.map(lambda i: incremental.write_changed(frame(["a", f"k{i}"], f"v{i % 2}"), path, "path", "text", prune=False), range(4)))
    stand = {r.path: r.text for r in incremental.read_snapshot(spark, path).collect()}
    assert set(stand) == {"a", "b", *(f"k{i}" for i in range(4))} and all(stand[f"k{i}"] == f"v{i % 2}" for i in range(4)) and stand["b"] == "1"
    assert all(g["written"] + g["skipped"] == 2 and g["written"] >= 1 and g["removed"] == 0 for g in got)
    assert versions.latest(spark, path).number == 4
    monkeypatch.setattr(versions, "COMPACT", 4)
    for i in range(2):
        assert incremental.write_changed(frame(["a"], f"w{i}"), path, "path", "text")["written"] == 1
    assert len(versions.latest(spark, path).folders) <= 3
    assert versions.vacuum(spark, path, 1) and rows(incremental.read_snapshot(spark, path), "path", "text") == [("a", "w1")]
    assert incremental.write_changed(frame(["a"], "w1"), path, "path", "text") == {"written": 0, "skipped": 1, "removed": 0}


def test_half_a_version_is_not_read(spark, tmp_path):
    path = tmp_path / "table"
    incremental.write_changed(spark.createDataFrame([("a", "1")], "path string, text string"), str(path), "path", "text")
    (path / "data-half" / "_temporary").mkdir(parents=True)
    (path / "_log" / "draft").write_text("{")
    assert rows(incremental.read_snapshot(spark, str(path)), "path", "text") == [("a", "1")]


def test_files_and_watch(spark, tmp_path):
    root = tmp_path / "site"
    (root / "sub").mkdir(parents=True)
    (root / "a.page").write_text("<b>x</i>")
    (root / "sub" / "b.page").write_text("<p></p>")
    (root / "c.other").write_text("<b>")
    scanned = corpus.scan_files(spark, str(root), [".page"])
    assert sorted(r.path.rpartition("/")[2] for r in scanned.collect()) == ["a.page", "b.page"]

    def check(batch):
        return findings.run_rules(markup.masked_tag_events(batch, "path", "text"), ["nesting"]).select(F.col("doc").alias("path"), "code")

    def pass_over():
        stream = watch.file_stream(spark, str(root), [".page"]).select("path", "text")
        watch.watch(stream, check, str(tmp_path / "snap"), str(tmp_path / "check"), once=True).awaitTermination()
        return sorted((r.path.rpartition("/")[2], r.code) for r in watch.current(spark, str(tmp_path / "snap")).collect() if r.code)

    assert pass_over() == [("a.page", "mismatched-close")]
    (root / "new.page").write_text("<i>")
    assert pass_over() == [("a.page", "mismatched-close"), ("new.page", "unclosed-tag")]


def test_elements_close_in_their_block(spark):
    cases = {
        "{#if a}<div>{/if}</div>": ["unclosed tag: <div>"],
        "<p>{#if a}<b></b>{/if}</p>": [],
        "<ul>{#each a as b}<li>{b}{:else}<i></b></i>{/each}</ul>": ["mismatched closing tag: expected </i>, found </b>"],
        "{#if a}</div>{/if}<div>": ["unclosed tag: <div>"],
        "{/if}{:else}<b>{#await x}<i>{:then y}</i>{#key z}<u>{/key}{/await}</b>": ["unclosed tag: <i>", "unclosed tag: <u>"],
        "{#if a}{#if b}<b>{:else}</b>{/if}</i>{/if}": ["unclosed tag: <b>"],
    }
    frame = spark.createDataFrame(list(enumerate(cases)), "doc long, html string")
    found = findings.check_nesting(markup.masked_tag_events(frame), markup.blocks(frame)).collect()
    for doc, want in enumerate(cases.values()):
        assert sorted(r.message for r in found if r.doc == doc) == want


def test_many_edits_of_one_document(spark):
    n = 200_000
    frame = spark.range(n).select(F.lit(1).alias("doc"), F.col("id").alias("ord"), (F.col("id") * 2).alias("start"), (F.col("id") * 2 + F.when(F.col("id") % 3 == 0, 5).otherwise(1)).alias("end"))
    began = time.time()
    assert edits.pick_edits(frame).count() == (n + 2) // 3
    assert time.time() - began < 60


def test_edits_that_all_overlap_are_one_stretch(spark):
    n = 100_000
    frame = spark.range(n).select(F.lit(1).alias("doc"), F.col("id").alias("ord"), (F.col("id") * 2).alias("start"), (F.col("id") * 2 + 3).alias("end"))
    assert edits.pick_edits(frame).agg(F.count("*"), F.max("start")).first() == (n // 2, 2 * n - 4)


def test_edits_are_picked_like_one_after_the_other(spark):
    rng = random.Random(8)
    some = [(d, s, s + rng.randrange(-2, 12), k, "x") for d in (1, 2, None) for k, s in enumerate(rng.randrange(-5, 900) for _ in range(250))]
    some += [(1, None, 5, 900, "x"), (1, 5, None, 901, "x"), (3, -1, 4, 0, "x"), (4, 0, 0, 0, "x"), (4, 0, 0, 1, "x")]
    expected = []
    for d in (1, 2, 3, 4):  # edits without a document are none's
        reach = 0
        for s, k, e in sorted((s, k, e) for x, s, e, k, _ in some if x == d and None not in (s, e)):
            if e >= s >= reach:
                expected.append((d, k))
                reach = e
    out = edits.pick_edits(spark.createDataFrame(some, "doc long, start long, end long, ord long, replacement string"))
    assert rows(out, "doc", "ord") == sorted(expected) and out.columns == ["doc", "ord", "start", "end", "replacement"]


def test_dependents_of_circles_and_diamonds(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d"), ("b", "e"), ("x", "y"), (None, "a"), ("a", None)], "path string, target string")
    changed = spark.createDataFrame([("a",), ("lone",)], "path string")
    assert rows(incremental.dependents(changed, edges), "path") == [("a",), ("b",), ("c",), ("d",), ("e",), ("lone",)]
    assert incremental.dependents(changed.limit(0), edges).collect() == []


def stack_closes(events):
    """Ends that were left out, by a stack: ``(start, end, kind, name, synthetic)``."""
    out, stack = [], []
    for start, end, kind, name in sorted(events):
        ends = {"open": ("li",), "close": ("ul", "ol", "menu")}.get(kind, ())
        while stack and stack[-1].lower() == "li" and name.lower() in ends:
            out.append((start, start, "close", stack.pop(), True))
        if kind == "open":
            stack.append(name)
        elif kind == "close" and stack:
            stack.pop()
        out.append((start, end, kind, name, False))
    return out


@pytest.mark.parametrize("run", [1024, 3])
def test_left_out_ends_equal_a_stack(spark, monkeypatch, run):
    monkeypatch.setattr(nesting, "RUN", run)
    rng = random.Random(run)
    docs = [[(i * 10, i * 10 + 5, rng.choice(["open", "open", "close", "void", "self"]), rng.choice(["li", "LI", "Li", "lI", "ul", "OL", "b", "menu"])) for i in range(rng.randrange(60))] for _ in range(120)]
    docs.append([(i * 10, i * 10 + 5, "open", "b" if i % 3 else "li") for i in range(6_000)])
    frame = spark.createDataFrame([(d, *e) for d, own in enumerate(docs) for e in own], "doc long, start long, end long, kind string, name string")
    found = nesting.implicit_closes(frame)
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()
    got = sorted((r.doc, r.start, r.end, r.kind, r.name, r.synthetic) for r in found.collect())
    assert got == sorted((d, *e) for d, own in enumerate(docs) for e in stack_closes(own))


def test_a_job_is_timed_and_counted_in_one_pass(spark):
    passed, phases = spark.sparkContext.accumulator(0), report.Phases()

    def slowly(batches):
        for b in batches:
            time.sleep(0.05)
            passed.add(b.num_rows)
            yield b

    counts = phases.job("check", spark.range(1_000).mapInArrow(slowly, "id long"), lambda r: r.write.format("noop").mode("overwrite").save(), all=F.count("*"), even=F.count_if(F.col("id") % 2 == 0))
    assert counts == {"all": 1_000, "even": 500} and passed.value == 1_000 and phases["check"] >= 50


def test_words_of_a_large_table_are_found_like_a_vocabulary(spark):
    code = 'alpha "alpha \\" beta" beta // alpha\nnaïve été_1 alpha-beta /* gamma */ x.alpha `beta` über9 /* beta'
    docs = spark.createDataFrame([(1, code, "k"), (2, "", "k"), (3, None, None), (1, "beta " * 3, None)], "doc long, text string, more string")
    found = ["alpha", "beta", "gamma", "été_1", "über9", "naïve"]
    wanted = [(w, 0) for w in (*found, "alpha", None, "two words", "$x", *(f"w{k}" for k in range(100_000)))]
    table = spark.createDataFrame(wanted, "token string, start int")
    for skip in (None, tokens.CODE):
        mine = rows(tokens.vocabulary_occurrences(docs, table, skip=skip), "doc", "start", "token")
        one = docs.where("more is not null or doc <> 1")
        assert mine == sorted([*rows(tokens.token_occurrences(one, found, skip=skip), "doc", "start", "token"), (1, 0, "beta"), (1, 5, "beta"), (1, 10, "beta")])
    assert {r.more for r in tokens.vocabulary_occurrences(docs, table, keep=["more"]).collect()} == {"k", None}
    assert tokens.vocabulary_occurrences(docs.limit(0), table).count() == tokens.vocabulary_occurrences(docs, table.limit(0)).count() == 0


def test_a_long_text_sends_its_words_in_batches(spark):
    n = tokens.WORDS * 2 + 5
    out = tokens.words(spark.createDataFrame([(7, "é " * n)], "doc long, text string"))
    assert out.selectExpr("count(*)", "max(start)", "min(start)", "sum(start)").first() == (n, 3 * (n - 1), 0, 3 * n * (n - 1) // 2)


def test_spans_of_any_length_meet_their_points(spark):
    rng = random.Random(4)
    some = [(rng.randrange(3), s, s + rng.randrange(-3, 2 ** rng.randrange(1, 41))) for s in (rng.randrange(2 ** rng.randrange(1, 40)) for _ in range(300))]
    some += [(0, -5000, -10), (1, 7, 7), (1, None, 9), (1, 3, None), (None, 0, 99)]
    at = [(rng.randrange(4), x + d) for _, s, e in some for x in (s, e) if x is not None for d in (-1, 0)] + [(None, 5), (0, None), (0, None)]
    held = [(k, n, s, e) for n, (k, x) in enumerate(at) for d, s, e in some if None not in (k, x, d, s, e) and k == d and s <= x < e]
    points = spark.createDataFrame([(k, x, n) for n, (k, x) in enumerate(at)], "doc long, at long, n int")
    ranges = spark.createDataFrame([(k, s, e) for k, s, e in some if e is None or s is None or e - s < 2**31], "doc long, s long, e long")
    held = sorted(h for h in held if h[3] - h[2] < 2**31)
    for levels in (2, 3, 5):
        found = spans.point_in_span(points, ranges, "at", "s", "e", levels=levels)
        assert rows(found, "doc", "n", "s", "e") == held and found.columns == ["doc", "at", "n", "s", "e"]
    hit = {n for _, n, _, _ in held}
    assert rows(spans.point_in_span(points, ranges, "at", "s", "e", how="left_semi"), "n") == [(n,) for n in sorted(hit)]
    assert rows(spans.point_in_span(points, ranges, "at", "s", "e", how="left_anti"), "n") == [(n,) for n in range(len(at)) if n not in hit]
    left = spans.point_in_span(points, ranges, "at", "s", "e", how="left").collect()
    assert sorted((r.n, r.s is None) for r in left) == sorted([(n, False) for _, n, _, _ in held] + [(n, True) for n in range(len(at)) if n not in hit])


def test_a_long_span_touches_few_cells(spark):
    sizes = [1, 1024, 2**16, 2**16 + 1, 2**23, 2**23 + 1, 10**9, 2**30]
    some = spark.createDataFrame([(k, n) for n in sizes for k in (0, 777)], "s long, n long").selectExpr("s", "s + n as e", "n")
    counts = {(r.s, r.n): r["count"] for r in spans._in_cells(some, "s", "e", spans.LEVELS).groupBy("s", "n").count().collect()}
    assert len(counts) == 2 * len(sizes) and max(counts.values()) <= 65


def test_texts_are_dealt_to_tasks_by_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHARE", 1000)
    docs = spark.createDataFrame([(k, "<b>\n" * 100) for k in range(20)], "doc long, text string")
    for rows in (lines.line_table(docs), markup.tag_events(docs, html="text")):
        assert rows.rdd.getNumPartitions() == 9 and rows.count() in (2020, 2000)
    empty = docs.where("doc < 0")
    assert lines.line_table(empty).count() == markup.tag_events(empty, html="text").count() == 0
