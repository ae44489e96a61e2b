"""What the query modules share: tables, base rows, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markcheck.functions import paths
from markcheck.functions.text import VOID_ELEMENTS
from markcheck.operators import lines, markup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text", "lang", "source")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_table(documents(spark, sf_dir))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), "html", "url", paths.url_path(F.col("url")).alias("path"))


#: Markup that stands behind every page, so that no rule runs on nothing; (text, kind, name) by piece. ``end`` is an
#: end tag that was left out, ``raw`` what only looks like a tag.
TAIL = (
    ("<section>", "open", "section"),
    ("<h1>", "open", "h1"), ("T", "", ""), ("</h1>", "close", "h1"), ("<h3>", "open", "h3"), ("S", "", ""), ("</h3>", "close", "h3"),
    ("<ul>", "open", "ul"), ("<li>", "open", "li"), ("Item 1", "", ""), ("", "end", "li"), ("<li>", "open", "li"), ("Item 2", "", ""), ("", "end", "li"), ("</ul>", "close", "ul"),
    ('<button on:click={() => go(1)} tabindex=" 2 " class="x">', "open", "button"), ("b", "", ""), ("</button>", "close", "button"),
    ('<a title="a > b" href="/../../c?d=1">', "open", "a"), ("l", "", ""), ("</a>", "close", "a"),
    ('<input size="x" {value}/>', "self", "input"),
    ("<SCRIPT>", "open", "SCRIPT"), ("1<2 ", "", ""), ("</scripty>", "raw", "scripty"), (" ", "", ""), ("</b", "raw", "b"), ("</script >", "close", "script"),
    ("{track(3)} of(2)", "", ""),
    ("<div>", "open", "div"), ("<span>", "open", "span"), ("c", "", ""), ("</div>", "close", "div"), ("</section>", "close", "section"),
)
TAIL_TEXT = "".join(t for t, *_ in TAIL)


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with ``TAIL``."""
    return pages(spark, sf_dir).withColumn("html", F.concat("html", F.lit(TAIL_TEXT)))


def masked_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.masked_tag_events(marked_pages(spark, sf_dir))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte offsets of each document, some past its end."""
    return documents(spark, sf_dir).select("doc", F.explode(F.sequence(F.lit(0), F.octet_length("text") + 50, F.lit(101))).alias("offset")).withColumn("offset", F.col("offset").cast("long"))


LINES = """
line_parts AS (
  SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents
), lines AS (
  SELECT doc, line, (sum(strlen(text) + 1) OVER (PARTITION BY doc ORDER BY line) - strlen(text) - 1)::BIGINT AS start,
         (sum(strlen(text) + 1) OVER (PARTITION BY doc ORDER BY line) - 1)::BIGINT AS stop, text
  FROM line_parts
)"""
PROBES = """
probes AS (SELECT doc_id AS doc, unnest(range(0, strlen(text) + 51, 101))::BIGINT AS "offset" FROM documents)"""
VOID = "(" + ",".join(f"'{n}'" for n in VOID_ELEMENTS) + ")"


def tags_sql(parts: str) -> str:
    """Tag events of a CTE ``parts(doc, part, "offset")``."""
    return f"""
bodies AS (
  SELECT doc, part, "offset", CASE WHEN strpos(part, '>') > 0 THEN substr(part, 1, strpos(part, '>') - 1) ELSE part END AS body,
         CASE WHEN strpos(part, '>') > 0 THEN 1 ELSE 0 END AS shut
  FROM {parts} WHERE regexp_matches(part, '^/?[a-zA-Z][^\\s/>]*')
), named AS (
  SELECT doc, "offset" AS start, ("offset" + 1 + strlen(body) + shut)::BIGINT AS "end", regexp_extract(part, '^/?([a-zA-Z][^\\s/>]*)', 1) AS name, body,
         CASE WHEN starts_with(part, '/') THEN 'close' WHEN ends_with(body, '/') THEN 'self' ELSE 'open' END AS k
  FROM bodies
), tags AS (
  SELECT doc, start, "end", CASE WHEN k = 'open' AND name IN {VOID} THEN 'void' ELSE k END AS kind, name, body FROM named
)"""


def sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def tail_sql(kinds: tuple[str, ...]) -> str:
    """The events of ``TAIL`` of these kinds behind every page, placed by what stands before them."""
    values, at = [], 0
    for text, kind, name in TAIL:
        end = at + len(text.encode())
        if kind in kinds:
            shown = {"end": "close", "raw": "close"}.get(kind, kind)
            values.append(f"({at}, {end}, '{shown}', '{name}', {sql_text(text[1:-1])})")
        at = end
    return f"""SELECT page_id AS doc, (strlen(html) + v.s)::BIGINT AS start, (strlen(html) + v.e)::BIGINT AS "end", v.kind, v.name, v.body FROM pages, (VALUES {', '.join(values)}) v(s, e, kind, name, body)"""


HTML = f"html || {sql_text(TAIL_TEXT)}"

BARE_RAW_TAGS = (
    """
raw_parts AS (
  SELECT page_id AS doc, unnest(string_split(html, '<')) AS part, unnest(range(len(string_split(html, '<')))) AS i FROM pages
), raw_placed AS (
  SELECT doc, part, i, (sum(strlen(part) + 1) OVER (PARTITION BY doc ORDER BY i) - strlen(part) - 2)::BIGINT AS "offset" FROM raw_parts
), raw_events AS (SELECT * FROM raw_placed WHERE i > 0),"""
    + tags_sql("raw_events")
)

RAW_TAGS = BARE_RAW_TAGS.replace("tags AS (", "bare_tags AS (") + f", tags AS (SELECT * FROM bare_tags UNION ALL {tail_sql(('open', 'close', 'self', 'raw'))})"

# the driver's pages have plain tags only
_SECTIONS = "(?is)<!--.*?-->|" + "|".join(f"<{n}(?: [^>]*)?>.*?</{n}>" for n in ("script", "style", "textarea", "title"))
PIECES = f"""
cut AS (
  SELECT page_id AS doc, regexp_split_to_array(html, '{_SECTIONS}') AS gaps, regexp_extract_all(html, '{_SECTIONS}') AS raws FROM pages
), pieces0 AS (
  SELECT doc, unnest(gaps) AS text, unnest(range(len(gaps))) AS i, 0 AS is_raw FROM cut
  UNION ALL SELECT doc, unnest(raws), unnest(range(len(raws))), 1 FROM cut
), pieces AS (
  SELECT doc, i, is_raw, text, (sum(strlen(text)) OVER (PARTITION BY doc ORDER BY i, is_raw) - strlen(text))::BIGINT AS start FROM pieces0
)"""

BARE_TAGS = (
    PIECES
    + """,
gap_parts AS (
  SELECT doc, start, i AS g, unnest(string_split(text, '<')) AS part, unnest(range(len(string_split(text, '<')))) AS i FROM pieces WHERE is_raw = 0
), gap_placed AS (
  SELECT doc, part, i, (start + sum(strlen(part) + 1) OVER (PARTITION BY doc, g ORDER BY i) - strlen(part) - 2)::BIGINT AS "offset" FROM gap_parts
), raws AS (
  SELECT doc, text, start, regexp_extract(text, '^<([a-zA-Z]+)', 1) AS rname FROM pieces WHERE is_raw = 1 AND text NOT LIKE '<!--%'
), all_parts AS (
  SELECT doc, part, "offset" FROM gap_placed WHERE i > 0
  UNION ALL SELECT doc, substr(text, 2), start FROM raws
),"""
    + tags_sql("all_parts").replace("tags AS (", "open_tags AS (")
    + """, tags AS (
  SELECT * FROM open_tags
  UNION ALL
  SELECT doc, (start + strlen(text) - strlen(rname) - 3)::BIGINT, (start + strlen(text))::BIGINT, 'close', substr(text, length(text) - length(rname), length(rname)), '/' || rname FROM raws
)"""
)
MASKED_TAGS = BARE_TAGS.replace(", tags AS (", ", bare_tags AS (") + f", tags AS (SELECT * FROM bare_tags UNION ALL {tail_sql(('open', 'close', 'self'))})"

#: Depth and pairs over ``tags``.
PAIRS = """
steps AS (
  SELECT *, sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY start, "end") AS s FROM tags
), deep AS (
  SELECT * EXCLUDE (s), (s - least(0, min(s) OVER (PARTITION BY doc ORDER BY start, "end")))::BIGINT AS depth FROM steps
), moves AS (
  SELECT *, coalesce(lag(depth) OVER (PARTITION BY doc ORDER BY start, "end"), 0) AS before FROM deep WHERE kind IN ('open', 'close')
), live AS (
  SELECT *, CASE WHEN kind = 'open' THEN depth ELSE depth + 1 END AS level FROM moves WHERE kind = 'open' OR before > 0
), paired AS (
  SELECT *, last_value(CASE WHEN kind = 'open' THEN name END IGNORE NULLS) OVER (PARTITION BY doc, level ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opener,
         last_value(CASE WHEN kind = 'open' THEN start END IGNORE NULLS) OVER (PARTITION BY doc, level ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opened_at,
         lead(start) OVER (PARTITION BY doc, level ORDER BY start, "end") IS NOT NULL AS closed
  FROM live
), found AS (
  SELECT doc, start, "end", 'mismatched-close' AS code, 'error' AS severity, 'mismatched closing tag: expected </' || opener || '>, found </' || name || '>' AS message
  FROM paired WHERE kind = 'close' AND opener <> name
  UNION ALL
  SELECT doc, start, "end", 'unclosed-tag', 'error', 'unclosed tag: <' || name || '>' FROM paired WHERE kind = 'open' AND NOT closed AND lower(name) <> 'li'
)"""
#: The same with the end tags that were left out, for the nesting rules; the driver's pages leave out none.
NESTING = f"ended AS (SELECT * FROM tags UNION ALL {tail_sql(('end',))})," + PAIRS.replace("FROM tags", "FROM ended")
