"""Queries: positions, span maps, edits, paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markcheck.functions import paths as P
from markcheck.functions import text as T
from markcheck.operators import edits, lines, markup, nesting, spans, tokens
from markcheck.plans import _common as c
from markcheck.sources import corpus

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


_PLACED = f"""{c.LINES}, {c.PROBES}, placed AS (
  SELECT probes.doc, probes."offset", lines.line::BIGINT AS line, probes."offset" - lines.start AS col FROM probes ASOF JOIN lines ON probes.doc = lines.doc AND probes."offset" >= lines.start)"""


@query(f"WITH {_PLACED} SELECT * FROM placed")
def line_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_col(c.document_lines(spark, sf_dir), c.probes(spark, sf_dir)).select("doc", "offset", "line", "col")


@query(f"""WITH {_PLACED}, asked AS (SELECT doc, line, col FROM placed UNION ALL SELECT doc_id, 1000000, 3 FROM documents)
SELECT a.doc, a.line::BIGINT AS line, a.col, (l.start + a.col)::BIGINT AS "offset" FROM asked a LEFT JOIN lines l ON a.doc = l.doc AND a.line = l.line""")
def offset_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = c.document_lines(spark, sf_dir)
    asked = lines.line_col(table, c.probes(spark, sf_dir)).select("doc", "line", "col")
    missing = c.documents(spark, sf_dir).select("doc", F.lit(1000000).cast("long").alias("line"), F.lit(3).cast("long").alias("col"))
    return lines.offset_of(table, asked.unionByName(missing))


@query(f"""WITH {c.LINES}, asked AS (SELECT doc_id AS doc, unnest([1, 2, 3, 5, 8, 1000000]) AS line, unnest([4, 2, 90, 1, 30, 1]) AS col FROM documents),
t AS (SELECT doc, max(line) AS last, max(stop) AS fin FROM lines GROUP BY doc)
SELECT a.doc, a.line::BIGINT AS line, a.col::BIGINT AS col,
  CASE WHEN l.start IS NULL THEN t.fin WHEN a.col <= length(l.text) + (CASE WHEN l.line = t.last THEN 0 ELSE 1 END) THEN l.start + strlen(left(l.text, a.col - 1)) ELSE l.start END::BIGINT AS "offset"
FROM asked a JOIN t USING (doc) LEFT JOIN lines l ON l.doc = a.doc AND l.line = a.line - 1""")
def offset_of_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = F.array(*[F.struct(F.lit(a).cast("long").alias("line"), F.lit(b).cast("long").alias("col")) for a, b in ((1, 4), (2, 2), (3, 90), (5, 1), (8, 30), (1000000, 1))])
    asked = c.documents(spark, sf_dir).select("doc", F.explode(places).alias("p")).select("doc", "p.line", "p.col")
    return lines.offset_of_clamped(c.document_lines(spark, sf_dir), asked)


#: Lines that begin so stand for generated text that the source lacks.
SYNTHETIC = "The"


def _span_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c.document_lines(spark, sf_dir).select("doc", F.col("line").alias("ord"), F.concat("text", F.lit("\n")).alias("text"), (~F.col("text").startswith(SYNTHETIC)).alias("is_source"))
    return spans.fragment_spans(rows)


_MAP = f"""{c.LINES}, frag AS (
  SELECT doc, line, strlen(text) + 1 AS size, NOT starts_with(text, '{SYNTHETIC}') AS is_source FROM lines
), summed AS (
  SELECT *, sum(size) OVER w AS ge, sum(CASE WHEN is_source THEN size ELSE 0 END) OVER w AS oe FROM frag WINDOW w AS (PARTITION BY doc ORDER BY line)
), smap AS (
  SELECT doc, line::BIGINT AS ord, (ge - size)::BIGINT AS gen_start, ge::BIGINT AS gen_end, (oe - size)::BIGINT AS orig_start, oe::BIGINT AS orig_end FROM summed WHERE is_source)"""


@query(f"WITH {_MAP} SELECT * FROM smap")
def fragment_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_map(spark, sf_dir)


@query(f"""WITH {_MAP}, {c.PROBES} SELECT p.doc, p."offset", CASE WHEN p."offset" < m.gen_end THEN m.orig_start + p."offset" - m.gen_start END::BIGINT AS original
FROM probes p ASOF LEFT JOIN smap m ON p.doc = m.doc AND p."offset" >= m.gen_start""")
def map_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.to_original(c.probes(spark, sf_dir), _span_map(spark, sf_dir)).select("doc", "offset", "original")


@query(f"""WITH {_MAP}, {c.PROBES}, h AS (SELECT p.doc, p."offset", min(m.gen_start + p."offset" - m.orig_start) AS generated FROM probes p JOIN smap m ON p.doc = m.doc AND m.orig_start <= p."offset" AND p."offset" < m.orig_end GROUP BY ALL)
SELECT p.doc, p."offset", h.generated::BIGINT AS generated FROM probes p LEFT JOIN h ON p.doc = h.doc AND p."offset" = h."offset" """)
def map_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.to_generated(c.probes(spark, sf_dir), _span_map(spark, sf_dir))


@query(f"""WITH {c.BARE_RAW_TAGS}, {c.PIECES} SELECT t.doc, t.start, p.start AS section_start FROM tags t JOIN pieces p ON t.doc = p.doc AND p.is_raw = 1 AND p.start <= t.start AND t.start < p.start + strlen(p.text)""")
def span_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = c.pages(spark, sf_dir)
    comments = markup.comments(pages).select("doc", F.col("start").alias("section_start"), F.col("end").alias("section_end"))
    events = markup.masked_tag_events(pages).where("lower(name) in ('script', 'style', 'textarea', 'title')")
    raw = nesting.pairs(events).where("kind = 'close'").select("doc", F.col("opener.start").alias("section_start"), F.col("end").alias("section_end")).unionByName(comments)
    return spans.point_in_span(markup.tag_events(pages).select("doc", "start"), raw, "start", "section_start", "section_end").select("doc", "start", "section_start")


@query(f"""WITH {c.PROBES}, parts AS (SELECT doc_id AS doc, strlen(text) // h.n AS part_end FROM documents, (VALUES (1), (2), (4), (8)) h(n))
SELECT p.doc, p."offset", q.part_end FROM probes p JOIN parts q ON p.doc = q.doc AND p."offset" < q.part_end""")
def span_contains_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes with the leading parts of their document, whole, half, a quarter and an eighth, that hold them."""
    size = F.octet_length("text").cast("long")
    parts = c.documents(spark, sf_dir).select("doc", F.lit(0).cast("long").alias("part_start"), F.explode(F.array(*[F.floor(size / n) for n in (1, 2, 4, 8)])).alias("part_end"))
    return spans.point_in_span(c.probes(spark, sf_dir), parts, "offset", "part_start", "part_end").select("doc", "offset", "part_end")


@query(f"""WITH {c.MASKED_TAGS}, {c.PAIRS} SELECT doc, start, least(start, opened_at) AS cover_start, greatest("end", opened_at + 1) AS cover_end FROM paired WHERE kind = 'close'""")
def span_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    closes = nesting.pairs(c.masked_tags(spark, sf_dir)).where("kind = 'close'")
    hull = spans.cover(F.col("opener.start"), F.col("opener.start") + 1, F.col("start"), F.col("end"))
    return closes.select("doc", "start", hull["start"].alias("cover_start"), hull["end"].alias("cover_end"))


@query(f"""WITH {c.LINES}, s AS (SELECT l.doc_id AS doc, l.quality, lines.start + 2 AS so FROM labels l LEFT JOIN lines ON lines.doc = l.doc_id AND lines.line = 3 * l.quality + l.toxic),
e AS (SELECT l.doc_id AS doc, lines.start AS eo FROM labels l LEFT JOIN lines ON lines.doc = l.doc_id AND lines.line = 3 * l.quality + l.toxic + 1)
SELECT s.doc, coalesce(so, 0)::BIGINT AS start, coalesce(eo, so, 0)::BIGINT AS "end" FROM s JOIN e USING (doc)""")
def enrich_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = (3 * F.col("quality") + F.col("toxic")).cast("long")
    found = c.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("doc"), line.alias("start_line"), F.lit(2).alias("start_col"), (line + 1).alias("end_line"), F.lit(0).alias("end_col"))
    return lines.enriched(c.document_lines(spark, sf_dir), found).select("doc", "start", "end")


_EDITS = f"""{c.LINES}, edits AS (SELECT doc, start + 3 AS at_pos, (strlen(text) % 5 - 2)::BIGINT AS delta FROM lines),
sums AS (SELECT doc, at_pos, sum(delta) AS delta FROM edits GROUP BY ALL), shifts AS (SELECT doc, at_pos, (sum(delta) OVER (PARTITION BY doc ORDER BY at_pos))::BIGINT AS shift FROM sums)"""


def _edits(table: DataFrame) -> DataFrame:
    return table.select("doc", (F.col("start") + 3).alias("at"), (F.octet_length("text") % 5 - 2).cast("long").alias("delta"))


@query(f"""WITH {_EDITS}, cuts AS (
  SELECT doc, start AS s, stop AS e, start AS piece FROM lines UNION ALL
  SELECT l.doc, l.start, l.stop, x.at_pos FROM lines l JOIN shifts x ON l.doc = x.doc AND l.start < x.at_pos AND x.at_pos < l.stop
), ends AS (SELECT *, coalesce(lead(piece) OVER (PARTITION BY doc, s, e ORDER BY piece), e) AS stop FROM cuts),
moved AS (SELECT n.*, coalesce(x.shift, 0) AS shift FROM ends n ASOF LEFT JOIN shifts x ON n.doc = x.doc AND n.piece >= x.at_pos WHERE n.stop > n.piece)
SELECT doc, greatest(0, piece + shift)::BIGINT AS gen_start, greatest(0, stop + shift)::BIGINT AS gen_end, piece AS orig_start, stop AS orig_end FROM moved""")
def shift_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = c.document_lines(spark, sf_dir)
    return spans.shift_spans(table.select("doc", F.col("start").alias("gen_start"), F.col("end").alias("gen_end"), F.col("start").alias("orig_start")), _edits(table))


@query(f"""WITH {c.LINES}, edits AS (SELECT doc, start + 2 AS es, start + 2 + strlen(text) % 9 AS ee, -(strlen(text) % 9) AS delta FROM lines WHERE starts_with(text, 'The'))
SELECT l.doc, (l.start + coalesce((SELECT sum(delta) FROM edits e WHERE e.doc = l.doc AND e.ee <= l.start), 0))::BIGINT AS start,
  (l.stop + coalesce((SELECT sum(delta) FROM edits e WHERE e.doc = l.doc AND e.ee <= l.start), 0))::BIGINT AS "end"
FROM lines l WHERE NOT EXISTS (SELECT 1 FROM edits e WHERE e.doc = l.doc AND e.es < l.stop AND e.ee > l.start)""")
def drop_overlapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = c.document_lines(spark, sf_dir)
    size = F.octet_length("text") % 9
    cut = table.where(F.col("text").startswith("The")).select("doc", (F.col("start") + 2).alias("edit_start"), (F.col("start") + 2 + size).alias("edit_end"), (-size).cast("long").alias("delta"))
    return spans.drop_overlapped(table.select("doc", "start", "end"), cut)


@query("""WITH a AS (SELECT user_id, event_id AS f, (value * 100)::BIGINT AS t FROM events WHERE event_type = 'signup')
SELECT e.user_id, e.event_id, (a.t + e.event_id - a.f)::BIGINT AS mapped FROM events e ASOF LEFT JOIN a ON e.user_id = a.user_id AND e.event_id >= a.f""")
def interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = c.events(spark, sf_dir)
    anchors = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("from"), F.round(F.col("value") * 100).cast("long").alias("to"))
    return spans.interpolate(events.select("user_id", "event_id"), anchors, "user_id", "event_id", "from", "to")


@query(f"""WITH RECURSIVE {c.LINES}, e AS (SELECT doc, line * 7 AS s, line * 7 + length(text) % 13 AS e, line AS ord, row_number() OVER (PARTITION BY doc ORDER BY line * 7, line) AS i FROM lines),
walk AS (
  SELECT doc, i, s, ord, TRUE AS kept, e AS reach FROM e WHERE i = 1
  UNION ALL
  SELECT n.doc, n.i, n.s, n.ord, n.s >= w.reach, CASE WHEN n.s >= w.reach THEN n.e ELSE w.reach END FROM walk w JOIN e n ON n.doc = w.doc AND n.i = w.i + 1
)
SELECT doc, ord::BIGINT AS ord, s::BIGINT AS start FROM walk WHERE kept""")
def pick_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("line") * 7
    rows = c.document_lines(spark, sf_dir).select("doc", start.alias("start"), (start + F.length("text") % 13).alias("end"), F.col("line").alias("ord"))
    return edits.pick_edits(rows).select("doc", "ord", "start")


@query(f"""WITH {c.LINES} SELECT doc, md5(string_agg(CASE WHEN starts_with(text, 'The') THEN '[cut]' ELSE text END, chr(10) ORDER BY line)) AS digest FROM lines GROUP BY doc""")
def apply_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    size = F.length("text")
    w = Window.partitionBy("doc").orderBy("line")
    rows = c.document_lines(spark, sf_dir).withColumn("at", (F.sum(size + 1).over(w) - size - 1))
    cut = rows.where(F.col("text").startswith("The")).select("doc", F.col("at").alias("start"), (F.col("at") + size).alias("end"), F.lit("[cut]").alias("replacement"))
    return edits.apply_edits(c.documents(spark, sf_dir).select("doc", "text"), cut).select("doc", F.md5("text").alias("digest"))


_PATHS = "paths AS (SELECT page_id AS doc, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, url FROM pages)"


@query(f"""WITH {_PATHS} SELECT doc, replace('C:' || replace(path, '/', '\\'), '\\', '/') AS p FROM paths""")
def p_slash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.pages(spark, sf_dir).select("doc", P.slashes(F.concat(F.lit("C:"), F.translate("path", "/", "\\"))).alias("p"))


@query(f"""WITH {_PATHS} SELECT doc, CASE WHEN starts_with(path, '/en/') THEN substr(path, 5) ELSE ltrim(path, '/') END AS p FROM paths""")
def p_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.pages(spark, sf_dir).select("doc", P.under(F.col("path"), "/en").alias("p"))


def _fold(expr: str, rooted: str) -> str:
    return f"""list_reduce(list_transform(list_filter(string_split({expr}, '/'), lambda x: x <> '' AND x <> '.'), lambda x: [x]),
  lambda a, x: CASE WHEN x[1] = '..' AND len(a) > 0 AND a[-1] <> '..' THEN a[:-2] WHEN x[1] = '..' AND len(a) = 0 AND {rooted} THEN a ELSE a || x END, []::VARCHAR[])"""


_DOTS = "path || '/./../x//' || CASE WHEN contains(url, '#') THEN '../../../..' ELSE 'y/..' END"


@query(f"""WITH {_PATHS}, q AS (SELECT doc, {_DOTS} AS a, ltrim({_DOTS}, '/') AS b FROM paths)
SELECT doc, '/' || array_to_string({_fold('a', 'TRUE')}, '/') AS rooted, coalesce(nullif(array_to_string({_fold('b', 'FALSE')}, '/'), ''), '.') AS free FROM q""")
def p_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    dotted = F.concat("path", F.lit("/./../x//"), F.when(F.col("url").contains("#"), "../../../..").otherwise("y/.."))
    return c.pages(spark, sf_dir).select("doc", P.normalized(dotted).alias("rooted"), P.normalized(F.regexp_replace(dotted, "^/+", "")).alias("free"))


@query(f"""WITH {_PATHS}, q AS (SELECT doc, replace(url, '/', '\\') AS u FROM paths), r AS (SELECT doc, replace(u, '\\', '/') AS a FROM q)
SELECT doc, lower(array_to_string({_fold('a', 'FALSE')}, '/')) AS k FROM r""")
def p_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.pages(spark, sf_dir).select("doc", P.key(F.translate("url", "/", "\\")).alias("k"))


@query(f"""WITH {_PATHS}, n AS (SELECT doc, path, lead(path) OVER (ORDER BY doc) AS target FROM paths),
s AS (SELECT doc, list_filter(string_split(path, '/'), lambda x: x <> '')[:-2] AS a, list_filter(string_split(target, '/'), lambda x: x <> '') AS b FROM n WHERE target IS NOT NULL),
k AS (SELECT *, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[:i] = b[:i])) AS same FROM s),
h AS (SELECT doc, array_to_string(list_transform(range(len(a) - same), lambda i: '..') || b[same + 1:], '/') AS p FROM k)
SELECT doc, CASE WHEN p = '' THEN '.' WHEN starts_with(p, '.') THEN p ELSE './' || p END AS p FROM h""")
def p_relative_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = c.pages(spark, sf_dir).select("doc", "path")
    following = pages.select((F.col("doc") - 1).alias("doc"), F.col("path").alias("target"))
    strip = lambda p: F.regexp_replace(p, "^/+", "")
    return pages.join(following, "doc").select("doc", P.import_path(strip("path"), strip("target")).alias("p"))


@query(f"""WITH {_PATHS}, q AS (SELECT doc, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM paths), r AS (SELECT doc, path, CASE WHEN dir = '' THEN '/' ELSE dir END AS dir FROM q)
SELECT doc, dir, '/' || array_to_string({_fold("dir || '/../img/a.png'", 'TRUE')}, '/') AS target, starts_with(path, '/en/') AS is_english FROM r""")
def p_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = P.dirname(F.col("path"))
    return c.pages(spark, sf_dir).select("doc", directory.alias("dir"), P.resolved(directory, F.lit("../img/a.png")).alias("target"), P.is_within(F.col("path"), F.lit("/en")).alias("is_english"))


@query("""SELECT page_id AS doc, regexp_extract(url, '^([^?#]*)', 1) AS path, substr(url, length(regexp_extract(url, '^([^?#]*)', 1)) + 1) AS suffix FROM pages""")
def url_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.pages(spark, sf_dir).select("doc", P.split_reference(F.col("url")).alias("s")).select("doc", "s.path", "s.suffix")


@query("""SELECT o_orderkey, replace(lower(replace(o_orderpriority, ' ', '-')), '-', '_') AS code FROM orders""")
def snake_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.table(spark, sf_dir, "orders").select("o_orderkey", T.snake_code(F.lower(F.translate("o_orderpriority", " ", "-"))).alias("code"))


@query(f"""WITH {_PATHS}, g AS (SELECT doc, unnest(['.' || path, ltrim(path, '/'), '**' || path, ltrim(path, '/') || '/', ltrim(path, '/') || '/*', '  src' || path || ' ']) AS p, unnest(range(6))::BIGINT AS i FROM paths),
t AS (SELECT doc, i, trim(p) AS p FROM g), b AS (SELECT doc, i, p, CASE WHEN starts_with(p, './') THEN substr(p, 3) ELSE p END AS q FROM t)
SELECT doc, i, CASE WHEN starts_with(p, '*') THEN p WHEN contains(q, '*') OR ends_with(q, '/') THEN q ELSE q || '/**' END AS glob FROM b""")
def glob_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace("path", "^/+", "")
    forms = F.array(F.concat(F.lit("."), "path"), bare, F.concat(F.lit("**"), "path"), F.concat(bare, F.lit("/")), F.concat(bare, F.lit("/*")), F.concat(F.lit("  src"), "path", F.lit(" ")))
    rows = c.pages(spark, sf_dir).select("doc", F.posexplode(forms).alias("i", "p"))
    return rows.select("doc", F.col("i").cast("long").alias("i"), P.normalized_glob(F.col("p")).alias("glob"))


@query(f"""WITH {_PATHS} SELECT doc, path FROM paths WHERE NOT regexp_matches(ltrim(path, '/'), '^(fr(/.*)?|(.*/)?[^/]*7.*[.]html(/.*)?|(de|es)/[0-4].*[02][.](html|htm)(/.*)?|(.*/)?[^5-9/]1[.]html(/.*)?|en/1(/.*)?)$')""")
def ignore_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c.pages(spark, sf_dir).select("doc", "path", F.regexp_replace("path", "^/+", "").alias("key"))
    globs = ["fr/**", "fr", "**/*7*.html", "{de,es}/[0-4]*[02].{html,htm}", "**/[!5-9/]1.html", "en/1"]
    return corpus.without_ignored(rows, globs, "key").select("doc", "path")


@query("""SELECT page_id AS doc, CASE page_id % 8 WHEN 0 THEN 'page' WHEN 1 THEN 'layout' WHEN 2 THEN 'page-server' WHEN 3 THEN 'endpoint' WHEN 5 THEN 'server-hooks' WHEN 6 THEN 'params' END AS kind FROM pages""")
def route_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("+page.ts", "+layout@inner.js", "+page.server.mts", "+server.cjs", "+page.html", "src/hooks.server.ts", "src/params/x.ts", "src/params/x.test.ts")
    pages = c.pages(spark, sf_dir)
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("doc") % 8 + 1).cast("int"))
    path = F.when(name.startswith("src"), F.concat(F.lit("\\proj\\"), F.translate(name, "/", "\\"))).otherwise(F.concat(F.lit("/proj/src/routes"), "path", F.lit("/"), name))
    return pages.select("doc", P.route_kind(path, "/proj").alias("kind"))


@query("""SELECT page_id AS doc, url FROM pages WHERE ends_with(url, '.html') OR ends_with(url, '#top') OR ends_with(url, '/')""")
def suffix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.with_suffix(c.pages(spark, sf_dir), [".html", "#top"], ["/", ".html"], "url").select("doc", "url")


@query("""SELECT page_id AS doc, CASE WHEN ends_with(url, 'ref=x') THEN 'referred' WHEN ends_with(url, '=feed') THEN 'feed' WHEN ends_with(url, '.html') THEN 'file' WHEN ends_with(url, '/') THEN 'directory' ELSE 'unsupported' END AS kind FROM pages""")
def kind_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [("ref=x", "referred"), ("=feed", "feed"), (".html", "file"), ("/", "directory")]
    return c.pages(spark, sf_dir).select("doc", corpus.kind(F.col("url"), kinds).alias("kind"))


ROUTES = (("^https?://(m|blog)[.]", "sub-site"), ("/(en|de)/[0-9]+/?$", "plain"), ("[.]html$", "file"), ("utm_", "campaign"))
_ROUTES = " ".join(f"WHEN regexp_matches(url, '{p}') THEN '{k}'" for p, k in ROUTES)


@query(f"""SELECT page_id AS doc, CASE {_ROUTES} ELSE 'other' END AS kind FROM pages""")
def classify_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.pages(spark, sf_dir).select("doc", corpus.classified(F.col("url"), ROUTES).alias("kind"))


@query(f"""WITH {_PATHS}, keys AS (SELECT DISTINCT ltrim(path, '/') AS k FROM paths WHERE ltrim(path, '/') <> ''),
asked AS (SELECT DISTINCT p FROM (SELECT '/tmp/build' || path AS p FROM paths UNION ALL SELECT 'x/../y/' || regexp_extract(path, '([^/]*)$', 1) FROM paths UNION ALL SELECT ltrim(path, '/') FROM paths) WHERE p <> ''),
tails AS (SELECT p, array_to_string(string_split(ltrim(p, '/'), '/')[i:], '/') AS t FROM (SELECT p, unnest(range(1, len(string_split(ltrim(p, '/'), '/')) + 1)) AS i FROM asked)),
suf AS (SELECT p, arg_max(k, length(k)) AS k FROM tails JOIN keys ON t = k GROUP BY p),
base AS (SELECT regexp_extract(k, '([^/]*)$', 1) AS b, min(k) AS k FROM keys GROUP BY 1 HAVING count(*) = 1),
hit AS (SELECT a.p, x.k AS ex, s.k AS su, b.k AS ba FROM asked a LEFT JOIN keys x ON a.p = x.k LEFT JOIN suf s ON s.p = a.p LEFT JOIN base b ON b.b = regexp_extract(a.p, '([^/]*)$', 1) AND b.b <> '')
SELECT p AS path, coalesce(ex, su, ba, CASE WHEN starts_with(p, '/') THEN p ELSE coalesce(nullif(array_to_string({_fold('p', 'FALSE')}, '/'), ''), '.') END) AS found,
  CASE WHEN ex IS NOT NULL THEN 'exact' WHEN su IS NOT NULL THEN 'suffix' WHEN ba IS NOT NULL THEN 'basename' ELSE 'none' END AS how FROM hit""")
def path_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = c.pages(spark, sf_dir)
    bare = F.regexp_replace("path", "^/+", "")
    forms = F.array(F.concat(F.lit("/tmp/build"), "path"), F.concat(F.lit("x/../y/"), P.basename(F.col("path"))), bare)
    asked = pages.select(F.explode(forms).alias("path")).where("path <> ''")
    return corpus.path_cascade(asked, pages.select(bare.alias("key")).where("key <> ''"))


@query(f"""WITH {c.MASKED_TAGS}, l AS (SELECT t.doc, start, unnest(regexp_extract_all(body, 'href="([^"]*)"', 1)) AS reference, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS page FROM tags t JOIN pages ON page_id = t.doc WHERE kind <> 'close'),
u AS (SELECT doc, start, '../..' || reference AS reference, '../..' || regexp_extract(reference, '^([^?#]*)', 1) AS p, regexp_extract(reference, '^[^?#]*(.*)$', 1) AS suffix, regexp_replace(page, '[^/]*$', '') AS dir FROM l WHERE reference <> ''),
t AS (SELECT doc, start, reference, suffix, '/' || array_to_string({_fold("dir || '/' || p", 'TRUE')}, '/') AS target FROM u)
SELECT doc, start, reference, target, '..' || target || suffix AS rewritten FROM t WHERE target <> '/en' AND NOT starts_with(target, '/en/')""")
def check_external_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from markcheck.operators import findings

    links = tokens.references(markup.attributes(c.masked_tags(spark, sf_dir)))
    rows = links.join(c.pages(spark, sf_dir).select("doc", F.col("path").alias("page")), "doc")
    up = rows.withColumn("reference", F.concat(F.lit("../.."), F.col("reference")))
    return findings.check_external_references(up, "/en").select("doc", "start", "reference", "target", "rewritten")
