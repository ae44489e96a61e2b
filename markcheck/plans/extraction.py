"""Queries: corpus scans, line tables, tags, attributes, comments, sections, tokens, nesting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markcheck.functions import text as T
from markcheck.operators import findings, lines, markup, nesting, tokens
from markcheck.plans import _common as c
from markcheck.sources import corpus, logs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""SELECT 'p' || page_id AS doc, url AS path, strlen(html)::BIGINT AS bytes FROM pages
UNION ALL SELECT 'd' || doc_id, source || '/' || doc_id || '.txt', strlen(text)::BIGINT FROM documents""")
def corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = corpus.from_table(c.table(spark, sf_dir, "pages"), F.concat(F.lit("p"), "page_id"), F.col("url"), "html")
    docs = corpus.from_table(c.table(spark, sf_dir, "documents"), F.concat(F.lit("d"), "doc_id"), F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")), "text")
    return pages.unionByName(docs).drop("text")


@query("""SELECT DISTINCT trim(l) AS word FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents) WHERE trim(l) <> '' AND NOT starts_with(trim(l), '#')""")
def wordlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.word_list(c.table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value")))


@query(f"""WITH {c.LINES}, m AS (SELECT doc, min(line) AS first FROM lines WHERE starts_with(text, 'The') GROUP BY doc)
SELECT doc, line, strlen(text)::BIGINT AS bytes FROM lines JOIN m USING (doc) WHERE line >= first""")
def from_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.from_marker(c.document_lines(spark, sf_dir), "The").select("doc", "line", F.octet_length("text").cast("long").alias("bytes"))


@query(f"""WITH {c.LINES} SELECT doc, line, start, stop AS "end" FROM lines""")
def line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.document_lines(spark, sf_dir).select("doc", "line", "start", "end")


@query(f"""WITH {c.RAW_TAGS} SELECT doc, start, "end", kind, name FROM tags""")
def tag_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.tag_events(c.marked_pages(spark, sf_dir)).drop("body")


@query(f"""WITH {c.MASKED_TAGS} SELECT doc, start, "end", kind, name FROM tags""")
def tag_events_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.masked_tags(spark, sf_dir).drop("body")


# attributes of the tags that stand behind every page, by the piece's place there
_TAIL_ATTRIBUTES = ", ".join(
    f"({c.TAIL_TEXT.index(tag)}, {k}, '{name}', '{kind}', '{value}')"
    for tag, found in {"<button": (("click", "expression", "{() => go(1)}"), ("tabindex", "text", " 2 "), ("class", "text", "x")), "<a title": (("title", "text", "a > b"), ("href", "text", "/../../c?d=1")), "<input": (("size", "text", "x"), ("value", "expression", "{value}"))}.items()
    for k, (name, kind, value) in enumerate(found)
)


@query(f"""WITH {c.MASKED_TAGS},
a AS (SELECT doc, start, regexp_extract_all(body, ' [a-z]+(?:="[^"]*")?') AS found FROM bare_tags WHERE kind <> 'close'),
r AS (SELECT doc, start, trim(unnest(found)) AS attr, unnest(range(len(found)))::BIGINT AS ord FROM a)
SELECT doc, start, ord, string_split(attr, '=')[1] AS name, CASE WHEN contains(attr, '=') THEN 'text' ELSE 'bare' END AS value_kind, trim(substr(attr, strpos(attr || '=', '=') + 1), '"') AS value FROM r
UNION ALL SELECT page_id, strlen(html) + v.s, v.ord, v.name, v.kind, v.value FROM pages, (VALUES {_TAIL_ATTRIBUTES}) v(s, ord, name, kind, value)""")
def tag_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.attributes(c.masked_tags(spark, sf_dir)).select("doc", "start", "ord", "name", "value_kind", "value")


@query(f"""WITH {c.PIECES} SELECT doc, start, (start + strlen(text))::BIGINT AS "end", regexp_replace(regexp_replace(text, '^<!--', ''), '-->$', '') AS text FROM pieces WHERE is_raw = 1 AND text LIKE '<!--%'""")
def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.comments(c.pages(spark, sf_dir))


@query(f"""WITH {c.PIECES}, s AS (SELECT doc, start, lower(regexp_extract(text, '^<([a-zA-Z]+)', 1)) AS name, regexp_extract(text, '^<[^>]*>') AS head, text FROM pieces WHERE is_raw = 1)
SELECT doc, name, start, (start + strlen(head))::BIGINT AS body_start, (start + strlen(text) - length(name) - 3)::BIGINT AS body_end, substr(text, length(head) + 1, length(text) - length(head) - length(name) - 3) AS body, 'instance' AS context, 'js' AS lang
FROM s WHERE name IN ('script', 'style')""")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.sections(c.pages(spark, sf_dir))


@query(f"""WITH {c.PIECES}, s AS (SELECT doc, start, lower(regexp_extract(text, '^<([a-zA-Z]+)', 1)) AS name FROM pieces WHERE is_raw = 1)
SELECT doc, name, max(start)::BIGINT AS start, count(*)::BIGINT AS n FROM s WHERE name IN ('script', 'style') GROUP BY doc, name""")
def last_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.last_sections(markup.sections(c.pages(spark, sf_dir))).select("doc", "name", "start", "n")


VOCABULARY = ("the", "then", "of", "is", "de", "la", "les", "und", "der", "que", "license", "idiot")
_WORDS = r"[\pL\pN_]+"
_VOCABULARY = ", ".join(f"'{t}'" for t in VOCABULARY)


@query(f"""WITH s AS (SELECT doc_id AS doc, regexp_split_to_array(text, '{_WORDS}') AS gaps, regexp_extract_all(text, '{_WORDS}') AS toks FROM documents),
r AS (SELECT doc, unnest(gaps) AS gap, unnest(list_append(toks, NULL)) AS token, unnest(range(len(gaps))) AS i FROM s)
SELECT doc, start, token FROM (SELECT doc, token, (sum(strlen(gap) + coalesce(strlen(token), 0)) OVER (PARTITION BY doc ORDER BY i) - strlen(token))::BIGINT AS start FROM r) WHERE token IN ({_VOCABULARY})""")
def token_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_occurrences(c.documents(spark, sf_dir), VOCABULARY)


@query(r"""SELECT DISTINCT doc_id AS doc, unnest(regexp_extract_all(regexp_replace(text, '(?s)"([^"\\\n]|\\.)*"|''([^''\\\n]|\\.)*''|`([^`\\]|\\.)*`|//[^\n]*|/\*.*?\*/', ' ', 'g'), '@([A-Za-z_][A-Za-z0-9_]*)', 1)) AS name FROM documents""")
def sigil_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.marked_names(c.documents(spark, sf_dir), "@")


@query(f"""WITH {c.MASKED_TAGS},
a AS (SELECT doc, start, unnest(regexp_extract_all(body, 'href="([^"]*)"', 1)) AS reference FROM tags WHERE kind <> 'close')
SELECT * FROM a WHERE reference <> ''""")
def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.references(markup.attributes(c.masked_tags(spark, sf_dir)))


@query("""SELECT doc_id AS doc, strlen('import {a} from "') AS start, './' || doc_id || '.js' AS reference FROM documents
UNION ALL SELECT doc_id, strlen('import {a} from "./' || doc_id || '.js"' || chr(10) || '// from "no"' || chr(10) || 'x = require(' || chr(39)), 'lib/é' FROM documents""")
def quoted_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('import {a} from "./'), "doc", F.lit('.js"\n// from "no"\nx = require(' + "'lib/é')\n"))
    return tokens.quoted_references(c.documents(spark, sf_dir).select("doc", text.alias("text")))


@query(f"""WITH {c.MASKED_TAGS} SELECT CASE WHEN name IN {c.VOID} THEN 'void' WHEN contains(name, ':') THEN 'prefixed' WHEN regexp_matches(name, '^[A-Z]') OR contains(name, '.') THEN 'component' WHEN contains(name, '-') THEN 'custom' ELSE 'element' END AS tag_class,
name, count(*)::BIGINT AS n FROM tags GROUP BY 1, 2""")
def tag_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.masked_tags(spark, sf_dir).groupBy(T.tag_class(F.col("name")).alias("tag_class"), "name").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT page_id AS doc, unnest(string_split(html, '<')) AS part, unnest(range(len(string_split(html, '<'))))::BIGINT AS i FROM pages)
SELECT doc, i, regexp_replace(regexp_replace(part, '^[^>]*>', ''), '[\\s\\x{0085}\\pZ]', '', 'g') = '' AS is_blank FROM p WHERE i > 0""")
def blank_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = c.pages(spark, sf_dir).select("doc", F.posexplode(F.split("html", "<")).alias("i", "part")).where("i > 0")
    return parts.select("doc", F.col("i").cast("long").alias("i"), T.is_blank(F.regexp_replace("part", "^[^>]*>", "")).alias("is_blank"))


@query(f"""WITH {c.MASKED_TAGS}, {c.PAIRS} SELECT doc, start, kind, name, depth FROM deep""")
def tag_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nesting.tag_depth(c.masked_tags(spark, sf_dir)).select("doc", "start", "kind", "name", "depth")


@query("""WITH s AS (SELECT conv_id, turn, role, sum(CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN -1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM conversations)
SELECT conv_id, turn, role, (s - least(0, min(s) OVER (PARTITION BY conv_id ORDER BY turn)))::BIGINT AS depth FROM s""")
def conv_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", -1).otherwise(0)
    return nesting.depth(c.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), step, "conv_id", ["turn"])


@query(f"""WITH {c.MASKED_TAGS}, {c.PAIRS} SELECT doc, start, name, level::BIGINT AS level, opener, opened_at FROM paired WHERE kind = 'close'""")
def tag_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nesting.pairs(c.masked_tags(spark, sf_dir)).where("kind = 'close'")
    return found.select("doc", "start", "name", F.col("level").cast("long").alias("level"), F.col("opener.name").alias("opener"), F.col("opener.start").alias("opened_at"))


@query(f"""WITH {c.MASKED_TAGS}, {c.NESTING} SELECT doc, start, "end", kind, name, "end" = start AS synthetic FROM ended""")
def implicit_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nesting.implicit_closes(c.masked_tags(spark, sf_dir))


@query(f"""WITH {c.MASKED_TAGS}, h AS (SELECT doc, start, substr(name, 2)::INT AS level, lag(substr(name, 2)::INT) OVER (PARTITION BY doc ORDER BY start) AS previous FROM tags WHERE kind = 'open' AND regexp_matches(name, '^h[1-6]$'))
SELECT doc, start, 'A11y: Heading levels should not be skipped (h' || previous || ' followed by h' || level || ')' AS message FROM h WHERE level > previous + 1""")
def heading_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.check_headings(c.masked_tags(spark, sf_dir)).select("doc", "start", "message")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_quantity::INT % 6 + 1)::BIGINT AS level FROM lineitem),
p AS (SELECT *, lag(level) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS previous FROM l)
SELECT * FROM p WHERE level > previous + 1""")
def level_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity").cast("int") % 6 + 1).cast("long").alias("level"))
    return nesting.level_skips(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "level")


@query("""WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = 'purchase' THEN event_id END AS host FROM events),
a AS (SELECT *, first_value(host IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt,
  last_value(host IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prv FROM e)
SELECT user_id, event_id, coalesce(nxt, prv) AS attached FROM a WHERE event_type = 'view' AND coalesce(nxt, prv) IS NOT NULL""")
def attach_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    found = nesting.attach_nearest(c.events(spark, sf_dir), kind == "purchase", kind == "view", "user_id", "event_id", "event_id")
    return found.select("user_id", "event_id", "attached")


@query(f"""WITH {c.MASKED_TAGS},
com AS (SELECT doc, start, (start + strlen(text))::BIGINT AS e FROM pieces WHERE is_raw = 1 AND text LIKE '<!--%'),
nx AS (SELECT com.doc, com.start, min(t.start) AS host FROM com JOIN tags t ON t.doc = com.doc AND t.kind IN ('open', 'self', 'void') AND t.start >= com.start GROUP BY ALL)
SELECT doc, start, host AS attached FROM nx""")
def comment_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = c.masked_tags(spark, sf_dir).where("kind <> 'close'").select("doc", "start", F.lit(True).alias("is_host"))
    rows = hosts.unionByName(markup.comments(c.pages(spark, sf_dir)).select("doc", "start", F.lit(False).alias("is_host")))
    return nesting.attach_nearest(rows, F.col("is_host"), ~F.col("is_host"), "doc", "start", "start").select("doc", "start", "attached")


@query(f"""WITH {c.LINES}, b AS (SELECT doc, line, start, text, strlen(text) - strlen(ltrim(text, ' ' || chr(9) || chr(13) || chr(10))) AS l, strlen(trim(text, ' ' || chr(9) || chr(13) || chr(10))) AS n FROM lines)
SELECT doc, line, (CASE WHEN n = 0 THEN start ELSE start + l END)::BIGINT AS span_start, (CASE WHEN n = 0 THEN start ELSE start + l + n END)::BIGINT AS span_end FROM b""")
def trim_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = T.trimmed_span(F.col("start"), F.col("text"))
    return c.document_lines(spark, sf_dir).select("doc", "line", span["start"].alias("span_start"), span["end"].alias("span_end"))


@query("""WITH p AS (SELECT doc_id AS doc, text, unnest(range(0, length(text) + 51, 487))::BIGINT AS "at" FROM documents), b AS (SELECT doc, "at", left(text, "at") AS s FROM p)
SELECT doc, "at", (length(s) - length(replace(s, chr(10), '')) + 1)::BIGINT AS line, (length(string_split(s, chr(10))[-1]) + 1)::BIGINT AS col FROM b""")
def char_line_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = c.documents(spark, sf_dir).select("doc", "text", F.explode(F.sequence(F.lit(0), F.length("text") + 50, F.lit(487))).alias("at")).withColumn("at", F.col("at").cast("long"))
    place = T.char_line_col(F.col("text"), F.col("at"))
    return probes.select("doc", "at", place["line"].alias("line"), place["col"].alias("col"))


@query(f"""WITH {c.MASKED_TAGS}, {c.NESTING}, n AS (
  SELECT doc, count(*) FILTER (code = 'mismatched-close')::BIGINT AS mismatched, count(*) FILTER (code = 'unclosed-tag')::BIGINT AS unclosed, min(start) AS first FROM found GROUP BY doc)
SELECT doc, mismatched, unclosed, (length(pre) - length(replace(pre, chr(10), '')) + 1)::BIGINT AS first_line
FROM (SELECT n.*, decode(encode({c.HTML})[1:first]) AS pre FROM n JOIN pages ON doc = page_id)""")
def page_nesting_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings.run_rules(c.masked_tags(spark, sf_dir), ["nesting"])
    pages = c.marked_pages(spark, sf_dir)
    placed = lines.line_col(lines.line_table(pages, text="html"), found, "start")
    return placed.groupBy("doc").agg(
        F.count_if(F.col("code") == "mismatched-close").alias("mismatched"),
        F.count_if(F.col("code") == "unclosed-tag").alias("unclosed"),
        F.min_by(F.col("line") + 1, "start").alias("first_line"),
    )


@query(f"""WITH {c.MASKED_TAGS}, {c.NESTING} SELECT doc, start, "end", message FROM found WHERE code = 'mismatched-close'""")
def check_mismatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.check_mismatched(c.masked_tags(spark, sf_dir)).select("doc", "start", "end", "message")


@query(f"""WITH {c.MASKED_TAGS}, {c.NESTING} SELECT doc, start, "end", message FROM found WHERE code = 'unclosed-tag'""")
def check_unclosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.check_unclosed(c.masked_tags(spark, sf_dir)).select("doc", "start", "end", "message")


#: Blocks that stand behind every page: (text, kind, name, frame); elements are opened and closed in one frame.
BLOCKS = (
    ("{#if a}", "", "", 0), ("<div>", "open", "div", 1), ("<b>", "open", "b", 1), ("</b>", "close", "b", 1),
    ("{#each b as c}", "", "", 1), ("<li>", "open", "li", 2), ("<em>", "open", "em", 2), ("{/each}", "", "", 1), ("</em>", "close", "em", 1), ("<s>", "open", "s", 1),
    ("{:else}", "", "", 0), ("<i>", "open", "i", 3), ("</p>", "close", "p", 3), ("<u>", "open", "u", 3), ("{/if}", "", "", 0), ("</div>", "close", "div", 0),
)
_BLOCK_TEXT = "".join(t for t, *_ in BLOCKS)
_BLOCK_ROWS = ", ".join(f"({at}, {at + len(t)}, '{kind}', '{name}', {frame})" for i, (t, kind, name, frame) in enumerate(BLOCKS) if kind for at in [len("".join(x for x, *_ in BLOCKS[:i]))])


@query(f"""WITH {c.BARE_TAGS.replace(', tags AS (', ', bare_tags AS (')}, tags AS (
  SELECT doc * 10 AS doc, start, "end", kind, name FROM bare_tags
  UNION ALL SELECT page_id * 10 + v.f, strlen(html) + v.s, strlen(html) + v.e, v.kind, v.name FROM pages, (VALUES {_BLOCK_ROWS}) v(s, e, kind, name, f)
), {c.PAIRS} SELECT doc // 10 AS doc, start, "end", code, message FROM found""")
def check_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nesting rules on pages with blocks."""
    pages = c.pages(spark, sf_dir).withColumn("html", F.concat("html", F.lit(_BLOCK_TEXT)))
    return findings.check_nesting(markup.masked_tag_events(pages), markup.blocks(pages)).select("doc", "start", "end", "code", "message")


#: A tag behind every page whose braces nest as deep as its page says, up to 11, and hold a brace in a string.
_DEEP_SQL = """deep_pages AS (SELECT page_id AS doc, strlen(html) AS pos, (page_id % 11 + 1)::INT AS d FROM pages),
deep_values AS (SELECT doc, pos, repeat('{', d) || 'a > b' || repeat('}', d) AS x FROM deep_pages)"""


def _deep_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    depth = (F.col("doc") % 11 + 1).cast("int")
    value = F.concat(F.repeat(F.lit("{"), depth), F.lit("a > b"), F.repeat(F.lit("}"), depth))
    return c.pages(spark, sf_dir).withColumn("html", F.concat("html", F.lit("<em x="), value, F.lit(" y={'}>'}>t</em>")))


@query(f"""WITH {c.BARE_TAGS.replace(', tags AS (', ', bare_tags AS (')}, {_DEEP_SQL}
SELECT doc, start, "end", kind, name FROM bare_tags
UNION ALL SELECT doc, pos, pos + strlen(x) + 16, 'open', 'em' FROM deep_values
UNION ALL SELECT doc, pos + strlen(x) + 17, pos + strlen(x) + 22, 'close', 'em' FROM deep_values""")
def tag_events_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.masked_tag_events(_deep_pages(spark, sf_dir)).select("doc", "start", "end", "kind", "name")


@query(f"""WITH {_DEEP_SQL}
SELECT doc, pos AS start, 0::BIGINT AS ord, 'x' AS name, 'expression' AS value_kind, x AS value FROM deep_values
UNION ALL SELECT doc, pos, 1, 'y', 'expression', '{{''}}>''}}' FROM deep_values""")
def tag_attributes_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    deep = markup.masked_tag_events(_deep_pages(spark, sf_dir)).where("name = 'em' and body like '%{%'")
    return markup.attributes(deep).select("doc", "start", "ord", "name", "value_kind", "value")


#: Program text in every document: its words count, those in its strings and comments do not.
_PROGRAM = 'the "of \\" is" // und\n/* que */ der `la ${les}` is'


_CODE_WORDS = f"({_PROGRAM.index('the')}, 'the'), ({_PROGRAM.index('der')}, 'der'), ({_PROGRAM.rindex('is')}, 'is')"


@query(f"""SELECT doc_id AS doc, strlen(source) + 2 + v.s AS start, v.token FROM documents, (VALUES {_CODE_WORDS}) v(s, token)""")
def token_occurrences_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of program text that names its document's source; strings and comments are stepped over."""
    code = c.documents(spark, sf_dir).withColumn("text", F.concat("source", F.lit(";\n" + _PROGRAM)))
    return tokens.token_occurrences(code, VOCABULARY, skip=tokens.CODE)


_SKIPPED_SQL = r""""(?:[^"\\\n]|\\.)*"|''(?:[^''\\\n]|\\.)*''|`(?:[^`\\]|\\.)*`|//[^\n]*|/\*.*?(?:\*/|\z)"""
_WORDS_SQL = rf"(?s){_SKIPPED_SQL}|[\pL\pN_]+"


@query(f"""WITH code AS (SELECT doc_id AS doc, source || ';' || chr(10) || {c.sql_text(_PROGRAM)} || chr(10) || text AS t FROM documents),
cut AS (SELECT doc, regexp_split_to_array(t, '{_WORDS_SQL}') AS gaps, regexp_extract_all(t, '{_WORDS_SQL}') AS found FROM code),
placed AS (SELECT doc, unnest(range(len(found))) AS i, unnest(found) AS token, unnest(gaps[1:len(found)]) AS gap FROM cut),
starts AS (SELECT doc, token, (sum(strlen(gap) + strlen(token)) OVER (PARTITION BY doc ORDER BY i) - strlen(token))::BIGINT AS start FROM placed)
SELECT doc, start, token FROM starts WHERE token IN (SELECT unnest(regexp_extract_all(text, '[\\pL\\pN_]+')) FROM benchmark)""")
def vocabulary_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the benchmark in program text and the texts behind it, outside strings and comments."""
    code = c.documents(spark, sf_dir).withColumn("text", F.concat("source", F.lit(";\n" + _PROGRAM + "\n"), "text"))
    vocabulary = c.table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\pL\pN_]+"), F.lit(0))).alias("word"))
    return tokens.vocabulary_occurrences(code, vocabulary, "word", skip=tokens.CODE)


CALLS = ("track", "margin", "of", "the", "de")
_CALLS = ", ".join(f"'{n}'" for n in CALLS)


@query(f"""WITH n AS (SELECT page_id AS doc, html, unnest([{_CALLS}]) AS name FROM pages), p AS (SELECT *, strpos(html, name) AS pos FROM n)
SELECT doc, name, (pos - 1)::BIGINT AS start FROM p WHERE pos > 0 AND substr(html, pos + length(name), 1) = '(' AND (pos = 1 OR NOT regexp_matches(substr(html, pos - 1, 1), '[\\pL\\pN_.]'))""")
def check_forbidden_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.first_calls(c.pages(spark, sf_dir), CALLS, text="html")


#: Tokens that a document's language does not allow.
KIND_TOKENS = (("en", "de"), ("en", "und"), ("fr", "the"), ("de", "les"), ("es", "the"))
_KIND = ", ".join(f"('{a}', '{b}')" for a, b in KIND_TOKENS)


@query(f"""WITH s AS (SELECT doc_id AS doc, lang, regexp_split_to_array(text, '{_WORDS}') AS gaps, regexp_extract_all(text, '{_WORDS}') AS toks FROM documents),
r AS (SELECT doc, lang, unnest(gaps) AS gap, unnest(list_append(toks, NULL)) AS token, unnest(range(len(gaps))) AS i FROM s),
o AS (SELECT doc, lang, token, (sum(strlen(gap) + coalesce(strlen(token), 0)) OVER (PARTITION BY doc ORDER BY i) - strlen(token))::BIGINT AS start FROM r)
SELECT doc, start, token FROM o WHERE (lang, token) IN (VALUES {_KIND})""")
def check_kind_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.documents(spark, sf_dir)
    rules = spark.createDataFrame(list(KIND_TOKENS), "lang string, token string")
    found = tokens.token_occurrences(docs, VOCABULARY, keep=["lang"])
    return found.join(F.broadcast(rules), ["lang", "token"], "left_semi").select("doc", "start", "token")


@query(f"""SELECT page_id AS doc, strlen(html) + {c.TAIL_TEXT.index('<button')} AS start, 'tabindex' AS name, ' 2 ' AS value, 2.0::DOUBLE AS number FROM pages""")
def check_numeric_attr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.check_numeric_attributes(markup.attributes(c.masked_tags(spark, sf_dir)))


@query(f"""WITH {c.MASKED_TAGS}, {c.NESTING}, h AS (SELECT doc, start, "end", substr(name, 2)::INT AS level, lag(substr(name, 2)::INT) OVER (PARTITION BY doc ORDER BY start) AS previous FROM tags WHERE kind = 'open' AND regexp_matches(name, '^h[1-6]$'))
SELECT doc, start, "end", code, severity, message, 'nesting' AS family FROM found
UNION ALL SELECT doc, start, "end", 'a11y-structure', 'warning', 'A11y: Heading levels should not be skipped (h' || previous || ' followed by h' || level || ')', 'a11y' FROM h WHERE level > previous + 1
UNION ALL SELECT page_id, strlen(html) + {c.TAIL_TEXT.index('{track')}, strlen(html) + {c.TAIL_TEXT.index(' of(2)')}, 'invalid-rune-usage', 'error', 'track() can only be used inside a $derived or $effect, or at the top level of a component', 'component' FROM pages""")
def run_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {**findings.RULES, "component": lambda e: findings.check_calls(e, CALLS)}
    return findings.run_rules(c.masked_tags(spark, sf_dir), tuple(rules), rules, {"component": markup.expressions(c.marked_pages(spark, sf_dir))})
