"""Queries: logs, findings, reports, configuration, incremental checks, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markcheck.functions import paths as P
from markcheck.operators import config, findings, incremental, lines, report
from markcheck.plans import _common as c
from markcheck.scratch import shared_dir
from markcheck.sources import corpus, listing, logs
from markcheck.streaming import watch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- checker output -------------------------------------------------------------------------------------------


@query("""SELECT event_id, 'src/(app)/u' || user_id || '.page.ts' AS file, (user_id + 1)::BIGINT AS start_line, 5::BIGINT AS start_col, 6::BIGINT AS end_col,
  CASE event_type WHEN 'error' THEN 'error' ELSE 'warning' END AS severity, 'TS' || event_id AS code, event_type || ' (value): ' || props AS message, FALSE AS position_unknown FROM events""")
def log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when(F.col("event_type") == "error", "error").otherwise("warning")
    text = F.format_string("src/(app)/u%s.page.ts(%s,5): %s TS%s: %s (value): %s", "user_id", F.col("user_id") + 1, severity, "event_id", "event_type", "props")
    parsed = logs.parse_log(c.events(spark, sf_dir).select(text.alias("value")))
    return parsed.withColumn("event_id", F.substring("code", 3, 20).cast("long"))


@query("""SELECT 'TS' || event_id AS code, 'config.json' AS file, 0::BIGINT AS start_line, 0::BIGINT AS start_col, event_type AS severity, 'bad ' || props AS message, TRUE AS position_unknown
FROM events WHERE event_type = 'error'""")
def log_parse_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    # only "error" and "warning" begin a diagnostic; the other event types give lines to drop
    text = F.format_string(" %s  TS%s :  bad %s ", "event_type", "event_id", "props")
    return logs.parse_log(c.events(spark, sf_dir).select(text.alias("value")), "config.json").drop("end_col")


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'error' ELSE 'warning' END AS severity, greatest((props->>'k')::BIGINT, 1) AS line, (props->>'k')::BIGINT + 1 AS col FROM events""")
def jsonl_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = logs.parse_results(c.events(spark, sf_dir), "k BIGINT", "props")
    line, col = logs.compiler_place(F.col("r.k"), F.col("r.k"))
    severity = F.when(F.col("event_type") == "error", "error").otherwise("warning")
    return parsed.select("event_id", severity.alias("severity"), line.alias("line"), col.alias("col"))


@query("""SELECT event_id, (props->>'k')::BIGINT AS k, 'http://x//y' AS u FROM events""")
def json_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("/* head */ "), F.regexp_replace("props", "\\}$", ', "u": "http://x//y" // tail\n}'), F.lit(" // end"))
    return c.events(spark, sf_dir).select("event_id", logs.parse_commented_json(text, "k BIGINT, u STRING").alias("j")).select("event_id", "j.k", "j.u")


# ---- findings -------------------------------------------------------------------------------------------------

SEVERITIES = {"error": ("error", "error"), "purchase": ("warning", "warning"), "signup": ("hint", "warning"), "click": ("hint", "none"), "view": ("hint", "none")}
_SEV = "CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' ELSE 'hint' END"


def _event_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding per event; files are users, codes are what the event holds."""
    s = findings.unified(F.col("event_type"), SEVERITIES)
    return c.events(spark, sf_dir).select(
        F.concat(F.lit("src/./U"), F.col("user_id").cast("string"), F.lit(".ts")).alias("file"),
        s["label"].alias("severity"),
        s["rank"].cast("long").alias("sev_rank"),
        s["counts_as"].alias("counts_as"),
        F.concat(F.lit("k-"), F.get_json_object("props", "$.k")).alias("code"),
        F.col("event_type").alias("message"),
        F.col("event_id").alias("ordinal"),
    )


_EVENT_FINDINGS = f"""ef AS (SELECT 'src/./U' || user_id || '.ts' AS file, {_SEV} AS severity, CASE {_SEV} WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END::BIGINT AS sev_rank,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' WHEN 'signup' THEN 'warning' ELSE 'none' END AS counts_as, 'k-' || (props->>'k') AS code, event_type AS message, event_id AS ordinal FROM events)"""


@query(f"WITH {_EVENT_FINDINGS} SELECT ordinal, severity, sev_rank, counts_as FROM ef")
def severity_unify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_findings(spark, sf_dir).select("ordinal", "severity", "sev_rank", "counts_as")


@query(f"WITH {_EVENT_FINDINGS} SELECT ordinal, severity FROM ef WHERE severity = 'error'")
def severity_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.at_least(_event_findings(spark, sf_dir), "error").select("ordinal", "severity")


FATAL = ("k-1", "k-2", "k-3")


@query(f"WITH {_EVENT_FINDINGS} SELECT ordinal, CASE WHEN message = 'error' AND code NOT IN ('k-1', 'k-2', 'k-3') THEN 'warning' ELSE severity END AS severity FROM ef")
def downgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.downgraded(_event_findings(spark, sf_dir), F.col("message") == "error", FATAL).select("ordinal", "severity")


OVERRIDES = (("k-5", "Ignore"), ("k-6", "ERROR"), ("k-7", "loud"), ("k-8", "ignore"))


@query(f"""WITH {_EVENT_FINDINGS} SELECT ordinal, CASE WHEN code = 'k-6' THEN 'error' ELSE severity END AS severity FROM ef WHERE code NOT IN ('k-5', 'k-8')""")
def code_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = F.broadcast(spark.createDataFrame(list(OVERRIDES), "code string, level string"))  # the caller's short list
    return findings.overridden(_event_findings(spark, sf_dir), table).select("ordinal", "severity")


@query(f"WITH {_EVENT_FINDINGS} SELECT count(*) FILTER (counts_as = 'error')::BIGINT AS errors, count(*) FILTER (counts_as = 'warning')::BIGINT AS warnings FROM ef")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.severity_counts(_event_findings(spark, sf_dir), "counts_as")


@query(f"WITH {_EVENT_FINDINGS} SELECT count(DISTINCT file)::BIGINT AS files FROM ef")
def files_with_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.files_with_findings(_event_findings(spark, sf_dir))


@query(f"""WITH {_EVENT_FINDINGS}, n AS (SELECT count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w, count(DISTINCT file) AS f FROM ef)
SELECT repeat('=', 36) || chr(10) || 'found ' || e || ' errors and ' || w || ' warnings in ' || f || ' files' AS text, e > 0 AS failed FROM n""")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary(_event_findings(spark, sf_dir))


@query(f"""WITH {_EVENT_FINDINGS}, o AS (SELECT *, message IN ('error', 'view') AS owned FROM ef),
r AS (SELECT *, row_number() OVER (PARTITION BY owned, file, code, message ORDER BY ordinal) AS rn FROM o)
SELECT ordinal, file, code, message FROM r WHERE NOT owned OR rn = 1""")
def dedup_owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    owned = F.col("message").isin("error", "view")
    return findings.deduplicated(_event_findings(spark, sf_dir), owned, ["code", "message"]).select("ordinal", "file", "code", "message")


@query("SELECT DISTINCT url AS path FROM pages")
def distinct_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.distinct_paths(c.table(spark, sf_dir, "pages").select(F.col("url").alias("path")))


@query("SELECT p_type, arg_min(p_name, p_partkey) AS p_name FROM part GROUP BY p_type")
def alias_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.first_wins(c.table(spark, sf_dir, "part"), "p_type", "p_name", "p_partkey")


@query("SELECT replace(p_type, '-', '_') || '/' || replace(p_brand, '#', '') AS key, count(*)::BIGINT AS n, count(DISTINCT (p_type, p_brand))::BIGINT AS variants FROM part GROUP BY 1 HAVING count(*) > 1")
def dup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c.table(spark, sf_dir, "part").select("p_type", "p_brand")
    return findings.duplicate_keys(rows, F.concat(F.translate("p_type", "-", "_"), F.lit("/"), F.translate("p_brand", "#", "")))


def _words(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return c.table(spark, sf_dir, name).select(F.explode(F.split(F.lower("text"), "[ \n]+")).alias("code")).where("code <> ''").select(F.translate("code", "-", "_").alias("code"))


_SETS = """a AS (SELECT DISTINCT replace(w, '-', '_') AS code FROM (SELECT unnest(string_split_regex(lower(text), '[ \\n]+')) AS w FROM documents) WHERE w <> ''),
b AS (SELECT DISTINCT replace(w, '-', '_') AS code FROM (SELECT unnest(string_split_regex(lower(text), '[ \\n]+')) AS w FROM benchmark) WHERE w <> '')"""


@query(f"WITH {_SETS} SELECT code FROM a INTERSECT SELECT code FROM b")
def codes_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir, "documents").intersect(_words(spark, sf_dir, "benchmark"))


@query(f"WITH {_SETS} SELECT code FROM a EXCEPT SELECT code FROM b")
def codes_only_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir, "documents").subtract(_words(spark, sf_dir, "benchmark"))


@query(f"WITH {_SETS} SELECT code FROM b EXCEPT SELECT code FROM a")
def codes_only_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir, "benchmark").subtract(_words(spark, sf_dir, "documents"))


@query(f"""WITH {_SETS} SELECT (SELECT count(*) FROM a)::BIGINT AS left_codes, (SELECT count(*) FROM b)::BIGINT AS right_codes, (SELECT count(*) FROM a JOIN b USING (code))::BIGINT AS both,
(SELECT count(*) FROM a ANTI JOIN b USING (code))::BIGINT AS left_only, (SELECT count(*) FROM b ANTI JOIN a USING (code))::BIGINT AS right_only""")
def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.coverage_counts(_words(spark, sf_dir, "documents"), _words(spark, sf_dir, "benchmark"))


@query("""WITH s AS (SELECT page_id AS doc, list_filter(string_split(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/'), lambda x: x <> '') AS a FROM pages),
u AS (SELECT doc, a || ['en', 'index'] AS b FROM s)
SELECT doc, array_to_string(list_transform(list_filter(range(1, len(b) + 1), lambda i: list_position(b, b[i]) = i), lambda i: b[i]), ' ') AS everything,
  array_to_string(list_filter(list_transform(list_filter(range(1, len(b) + 1), lambda i: list_position(b, b[i]) = i), lambda i: b[i]), lambda x: x NOT IN ('fr', 'de')), ' ') AS others FROM u""")
def suffix_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.filter(F.split(F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1), "/"), lambda x: x != "")
    both = F.array_union(parts, F.array(F.lit("en"), F.lit("index")))
    return c.pages(spark, sf_dir).select("doc", F.array_join(both, " ").alias("everything"), F.array_join(F.array_except(both, F.array(F.lit("fr"), F.lit("de"))), " ").alias("others"))


@query(f"""WITH {_EVENT_FINDINGS}, {c.MASKED_TAGS}, {c.NESTING}
SELECT 'p' || doc AS file, code, severity, start AS ordinal, 0::BIGINT AS phase FROM found UNION ALL SELECT file, code, severity, ordinal, 1 FROM ef
UNION ALL SELECT 'd' || doc_id, 'label', CASE WHEN toxic = 1 THEN 'error' ELSE 'warning' END, doc_id, 2 FROM labels WHERE toxic = 1 OR quality = 0""")
def all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_findings(spark, sf_dir)


def _all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = findings.run_rules(c.masked_tags(spark, sf_dir), ["nesting"]).select(F.concat(F.lit("p"), "doc").alias("file"), "code", "severity", F.col("start").alias("ordinal"))
    events = _event_findings(spark, sf_dir).select("file", "code", "severity", "ordinal")
    labels = c.table(spark, sf_dir, "labels").where("toxic = 1 or quality = 0").select(F.concat(F.lit("d"), "doc_id").alias("file"), F.lit("label").alias("code"), F.when(F.col("toxic") == 1, "error").otherwise("warning").alias("severity"), F.col("doc_id").alias("ordinal"))
    return findings.union(*(t.withColumn("phase", F.lit(i).cast("long")) for i, t in enumerate((pages, events, labels))))


@query(f"""WITH {_EVENT_FINDINGS}, {c.MASKED_TAGS}, {c.NESTING}, r AS (
  SELECT 'p' || doc AS doc, start, code, code = 'unclosed-tag' AS is_parse, 0::BIGINT AS phase, CASE code WHEN 'unclosed-tag' THEN 1 ELSE 0 END::BIGINT AS producer_rank, start AS ordinal FROM found
  UNION ALL SELECT file, ordinal % 7, code, severity = 'error', 1, 0, ordinal FROM ef)
SELECT *, row_number() OVER (ORDER BY phase, doc, is_parse DESC, start, producer_rank, ordinal) - 1 AS position FROM r""")
def sorted_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings.run_rules(c.masked_tags(spark, sf_dir), ["nesting"])
    unclosed = F.col("code") == "unclosed-tag"
    own = found.select(F.concat(F.lit("p"), "doc").alias("doc"), "start", "code", unclosed.alias("is_parse"), F.lit(0).cast("long").alias("phase"), unclosed.cast("long").alias("producer_rank"), F.col("start").alias("ordinal"))
    later = _event_findings(spark, sf_dir).select(F.col("file").alias("doc"), (F.col("ordinal") % 7).alias("start"), "code", (F.col("severity") == "error").alias("is_parse"), F.lit(1).cast("long").alias("phase"), F.lit(0).cast("long").alias("producer_rank"), "ordinal")
    return findings.numbered(findings.ordered(own.unionByName(later)))


# ---- reports --------------------------------------------------------------------------------------------------

_PLACED = f"""{c.MASKED_TAGS}, {c.NESTING}, page_parts AS (
  SELECT page_id AS doc, unnest(string_split({c.HTML}, chr(10))) AS text, unnest(range(len(string_split({c.HTML}, chr(10))))) AS line FROM pages
), plines AS (SELECT doc, line::BIGINT AS line, text, (sum(strlen(text) + 1) OVER (PARTITION BY doc ORDER BY line) - strlen(text) - 1)::BIGINT AS start FROM page_parts
), placed AS (
  SELECT f.doc, f.start, f."end", f.code, f.severity, f.message, s.line AS start_line, f.start - s.start AS start_col, e.line AS end_line, f."end" - e.start AS end_col, s.text AS snippet, url AS file
  FROM found f ASOF JOIN plines s ON f.doc = s.doc AND f.start >= s.start ASOF JOIN plines e ON f.doc = e.doc AND f."end" >= e.start JOIN pages ON page_id = f.doc)"""


def _page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = c.marked_pages(spark, sf_dir)
    table = lines.line_table(pages, text="html")
    found = findings.run_rules(c.masked_tags(spark, sf_dir), ["nesting"])
    return lines.placed(table, found).join(pages.select("doc", F.col("url").alias("file")), "doc")


@query(f"""WITH {_PLACED} SELECT to_json({{'type': 'Error', 'filename': file, 'start': {{'line': start_line + 1, 'column': start_col + 1, 'offset': start}}, 'end': {{'line': end_line + 1, 'column': end_col + 1, 'offset': "end"}}, 'message': message, 'code': code, 'source': 'markup'}})::VARCHAR AS json FROM placed""")
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.as_json(_page_findings(spark, sf_dir), "markup")


@query(f"""WITH {_PLACED} SELECT 'ERROR ' || file || ':' || (start_line + 1) || ':' || (start_col + 1) || ':' || (end_line + 1) || ':' || (end_col + 1) || ' ' || message || ' (' || code || ')' AS line FROM placed""")
def report_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.as_line(_page_findings(spark, sf_dir))


@query(f"""WITH {_PLACED} SELECT 'ERROR ' || file || ':' || (start_line + 1) || ':' || (start_col + 1) || ':' || (end_line + 1) || ':' || (end_col + 1) || ' ' || message || ' (markup(' || code || '))' AS line FROM placed""")
def report_machine_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.as_line(_page_findings(spark, sf_dir), "markup")


@query(f"""WITH {_PLACED} SELECT file || ':' || (start_line + 1) || ':' || (start_col + 1) || chr(10) || 'Error: ' || message || ' (' || code || ')' || chr(10) || chr(10) AS text FROM placed""")
def report_human(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.as_text(_page_findings(spark, sf_dir))


@query(f"""WITH {_PLACED} SELECT file || ':' || (start_line + 1) || ':' || (start_col + 1) || chr(10) || 'Error: ' || message || ' (' || code || ')' || chr(10) ||
'  ' || (start_line + 1) || ' | ' || snippet || chr(10) || '  ' || repeat(' ', length((start_line + 1)::VARCHAR)) || ' | ' || repeat(' ', start_col) || '^' || chr(10) || chr(10) AS text FROM placed""")
def report_verbose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.as_text_with_source(_page_findings(spark, sf_dir))


@query(f"WITH {_PLACED} SELECT doc, start, start_line, snippet FROM placed")
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_findings(spark, sf_dir).select("doc", "start", "start_line", "snippet")


@query(f"""WITH {_EVENT_FINDINGS}, n AS (SELECT count(*) AS findings, count(*) FILTER (severity = 'error') AS errors, count(DISTINCT file) AS files FROM ef)
SELECT to_json({{'counts': {{'findings': findings, 'errors': errors, 'files': files}}, 'ms': {{'scan': NULL, 'check': NULL}}}})::VARCHAR AS json FROM n""")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _event_findings(spark, sf_dir).agg(F.count("*").alias("findings"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_distinct("file").alias("files"))
    return report.run_metrics(counts, ["scan", "check"])  # durations differ from run to run


@query(f"""WITH {_EVENT_FINDINGS} SELECT (SELECT count(*) FROM events) AS events, count(*) AS findings, count(*) FILTER (severity = 'error') AS errors, TRUE AS timed FROM ef""")
def run_metrics_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that two jobs gather as they write, and whether both were timed."""
    phases, path = report.Phases(), f"{shared_dir(spark)}/markcheck-metrics-{uuid.uuid4().hex}"
    scanned = phases.job("scan", c.events(spark, sf_dir), lambda rows: rows.write.parquet(f"{path}/events"), events=F.count("*"))
    checked = phases.job("check", _event_findings(spark, sf_dir), lambda rows: rows.write.parquet(f"{path}/findings"), findings=F.count("*"), errors=F.count_if(F.col("severity") == "error"))
    counts = spark.createDataFrame([(scanned["events"], checked["findings"], checked["errors"])], "events long, findings long, errors long")
    text = report.run_metrics(counts, ["scan", "check"], phases).select(F.from_json("json", "counts struct<events:bigint,findings:bigint,errors:bigint>, ms struct<scan:double,check:double>").alias("j"))
    return text.select("j.counts.*", ((F.col("j.ms.scan") > 0) & (F.col("j.ms.check") > 0)).alias("timed"))


@query("""WITH n AS (SELECT regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1) AS name FROM pages),
l AS (SELECT CASE WHEN ends_with(name, '0.html') THEN '0.html' WHEN ends_with(name, '.html') THEN '.html' WHEN regexp_matches(name, '[.][^.]+$') THEN regexp_extract(name, '([.][^.]+)$', 1) ELSE name END AS label FROM n)
SELECT label, count(*)::BIGINT AS files, 'warning: ' || count(*) || CASE WHEN count(*) = 1 THEN ' file' ELSE ' files' END || ' with unregistered extension (' || label || ') skipped' AS text FROM l GROUP BY label""")
def skipped_by_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.skipped_by_suffix(c.pages(spark, sf_dir).select(P.basename(F.col("path")).alias("name")), [".html", "0.html"])


@query("""SELECT doc_id, coalesce((SELECT string_agg(quality || ':' || toxic, ',' ORDER BY quality, toxic) FROM labels l WHERE l.doc_id = d.doc_id), '') AS results FROM (SELECT DISTINCT doc_id FROM documents) d""")
def results_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = incremental.results_per_key(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "labels"), "doc_id", ["quality", "toxic"])
    return found.select("doc_id", F.array_join(F.transform("results", lambda r: F.concat(r["quality"].cast("string"), F.lit(":"), r["toxic"].cast("string"))), ",").alias("results"))


# ---- configuration --------------------------------------------------------------------------------------------


@query("""SELECT p_brand AS root, p_type AS name, arg_max(p_size, p_partkey)::BIGINT AS value, arg_max(p_name, p_partkey) AS base FROM part WHERE p_size > 10 GROUP BY ALL""")
def layered_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c.table(spark, sf_dir, "part").select(F.col("p_brand").alias("root"), F.col("p_partkey").alias("layer"), F.col("p_type").alias("name"), F.when(F.col("p_size") > 10, F.col("p_size").cast("long")).alias("value"), F.col("p_name").alias("base"))
    return config.layered(rows)


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 0 THEN p_partkey // 2 END AS parent FROM part),
r AS (SELECT node, node AS ancestor, 0 AS distance FROM p UNION ALL SELECT r.node, p.parent, r.distance + 1 FROM r JOIN p ON p.node = r.ancestor WHERE p.parent IS NOT NULL)
SELECT node, ancestor, distance::BIGINT AS distance FROM r""")
def config_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = c.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 2)).alias("parent"))
    return config.chain(parents).withColumn("distance", F.col("distance").cast("long"))


@query("""WITH s AS (SELECT o_orderkey AS k, count(l_orderkey) AS answers FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 UNION ALL
SELECT l_orderkey, count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY 1)
SELECT k AS "key", answers::BIGINT AS answers, CASE WHEN k NOT IN (SELECT o_orderkey FROM orders) THEN 'unknown' WHEN answers = 0 THEN 'missing' WHEN answers = 1 THEN 'answered' ELSE 'repeated' END AS state FROM s""")
def correlate(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = c.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    return incremental.correlate(orders, c.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key")), "key")


# ---- incremental checks ---------------------------------------------------------------------------------------
# The earlier snapshot: German texts read differently, one source was not there yet, and one that is gone was.


def _snapshot(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = c.documents(spark, sf_dir)

    def marked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("fingerprint", incremental.fingerprint(F.lit("v1"), F.lit(None), F.col("path"), F.col("text")))

    new = marked(docs.select(F.concat("source", F.lit("/"), "doc").alias("path"), "text", "source"))
    old = docs.where("source <> 'src3'").withColumn("text", F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    gone = docs.where("source = 'src5'").withColumn("source", F.lit("gone"))
    old = marked(old.unionByName(gone).select(F.concat("source", F.lit("/"), "doc").alias("path"), "text", "source"))
    return new, old


_SNAPSHOT = """neu AS (SELECT source || '/' || doc_id AS path, text, source FROM documents),
alt AS (SELECT source || '/' || doc_id AS path, CASE WHEN lang = 'de' THEN text || '!' ELSE text END AS text, source FROM documents WHERE source <> 'src3'
  UNION ALL SELECT 'gone/' || doc_id, text, 'gone' FROM documents WHERE source = 'src5'),
classes AS (SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN n.text = o.text THEN 'unchanged' ELSE 'changed' END AS change FROM neu n FULL JOIN alt o ON n.path = o.path)"""


@query(f"WITH {_SNAPSHOT} SELECT path, change = 'unchanged' AS reused FROM classes WHERE change <> 'removed'")
def reuse_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old = _snapshot(spark, sf_dir)
    hits, misses = incremental.reuse_split(new, old)
    return hits.select("path", F.lit(True).alias("reused")).unionByName(misses.select("path", F.lit(False).alias("reused")))


@query(f"WITH {_SNAPSHOT} SELECT c.path, change = 'unchanged' AS reused, CASE WHEN change = 'unchanged' THEN -1 ELSE strlen(text) END::BIGINT AS result, strlen(text) AS ordinal FROM classes c JOIN neu USING (path)")
def reuse_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old = _snapshot(spark, sf_dir)
    stored = old.select("fingerprint", F.lit(-1).cast("long").alias("result"))
    size = F.octet_length("text").cast("long")
    found = incremental.reused(new.withColumn("ordinal", size), stored, lambda rows: rows.withColumn("result", size))
    return found.select("path", "reused", "result", "ordinal")


@query(f"WITH {_SNAPSHOT} SELECT path, change FROM classes")
def change_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.change_classes(*_snapshot(spark, sf_dir), "path")


@query(f"WITH {_SNAPSHOT} SELECT path FROM classes WHERE change = 'removed'")
def stale_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old = _snapshot(spark, sf_dir)
    return incremental.stale_keys(old.select("path"), new, "path")


@query(f"""WITH {_SNAPSHOT} SELECT path FROM alt WHERE source IN ('gone', 'src3') OR source IN (SELECT coalesce(n.source, o.source) FROM neu n FULL JOIN alt o ON n.path = o.path WHERE n.text IS DISTINCT FROM o.text)""")
def invalidate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old = _snapshot(spark, sf_dir)
    before, now = (incremental.group_fingerprints(t, "source", "path", "text") for t in (old, new))
    return incremental.invalidated(old, before, now, "source").select("path")


@query("""WITH RECURSIVE n AS (SELECT max(doc_id) AS top FROM documents),
edges AS (SELECT doc_id AS path, doc_id // 2 AS target FROM documents UNION SELECT doc_id, doc_id // 3 FROM documents WHERE doc_id % 5 = 0 UNION SELECT doc_id - doc_id % 8, doc_id FROM documents WHERE doc_id % 8 = 7),
reached AS (SELECT doc_id AS path FROM documents WHERE doc_id % 89 = 40 UNION SELECT e.path FROM edges e JOIN reached r ON e.target = r.path)
SELECT path FROM reached""")
def invalidate_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is checked again when some documents change: references make chains, diamonds and circles."""
    i = F.col("doc")
    docs = c.documents(spark, sf_dir).select("doc")
    edges = docs.select(i.alias("path"), F.floor(i / 2).alias("target")).unionByName(docs.where("doc % 5 = 0").select(i.alias("path"), F.floor(i / 3).alias("target"))).unionByName(docs.where("doc % 8 = 7").select((i - i % 8).alias("path"), i.alias("target")))
    return incremental.dependents(docs.where("doc % 89 = 40").select(i.alias("path")), edges)


@query(f"""WITH {_SNAPSHOT} SELECT path, CASE change WHEN 'removed' THEN 'delete' WHEN 'unchanged' THEN 'keep' ELSE 'copy' END AS action FROM classes""")
def mirror_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.mirror_plan(*_snapshot(spark, sf_dir), "path")


@query("""WITH h AS (SELECT source, sha256(doc_id || chr(0) || text) AS h FROM documents),
s AS (SELECT source, count(*) AS members, sum(('0x' || substr(h, 1, 15))::BIGINT) AS a, sum(('0x' || substr(h, 16, 15))::BIGINT) AS b, sum(('0x' || substr(h, 31, 15))::BIGINT) AS c, sum(('0x' || substr(h, 46, 15))::BIGINT) AS d FROM h GROUP BY source)
SELECT source, members::BIGINT AS members, sha256(concat_ws('|', members::VARCHAR, a::VARCHAR, b::VARCHAR, c::VARCHAR, d::VARCHAR)) AS manifest FROM s""")
def group_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.group_fingerprints(c.table(spark, sf_dir, "documents"), "source", "doc_id", "text")


@query("""WITH h AS (SELECT doc_id % 97 AS grp, lang <> 'es' AS later, sha256(doc_id || chr(0) || text) AS h FROM documents),
u AS (SELECT * FROM (SELECT *, bool_or(NOT later) OVER (PARTITION BY grp) AS has FROM h) WHERE later <> has),
s AS (SELECT grp, count(*) AS members, sum(('0x' || substr(h, 1, 15))::BIGINT) AS a, sum(('0x' || substr(h, 16, 15))::BIGINT) AS b, sum(('0x' || substr(h, 31, 15))::BIGINT) AS c, sum(('0x' || substr(h, 46, 15))::BIGINT) AS d FROM u GROUP BY grp)
SELECT grp, members::BIGINT AS members, sha256(concat_ws('|', members::VARCHAR, a::VARCHAR, b::VARCHAR, c::VARCHAR, d::VARCHAR)) AS manifest FROM s""")
def group_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c.table(spark, sf_dir, "documents").withColumn("grp", F.col("doc_id") % 97)
    return incremental.group_fingerprints(rows, "grp", "doc_id", "text", F.col("lang") != "es")


@query("""SELECT source || '/' || doc_id AS path, text, source FROM documents""")
def change_only_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands after the earlier snapshot was written, then the present one, then that again."""
    new, old = (t.drop("fingerprint") for t in _snapshot(spark, sf_dir))
    path = f"{shared_dir(spark)}/markcheck-snapshot-{uuid.uuid4().hex}"
    for rows in (old, new, new):
        counts = incremental.write_changed(rows, path, "path", "text")
    if counts["written"] or counts["removed"]:
        raise ValueError(f"an equal snapshot was written again: {counts}")
    return incremental.read_snapshot(spark, path)


# ---- streams --------------------------------------------------------------------------------------------------


def _check(batch: DataFrame) -> DataFrame:
    from markcheck.operators import markup

    found = findings.run_rules(markup.masked_tag_events(batch, "path", "text"), ["nesting"])
    return found.select(F.col("doc").alias("path"), "start", "code")


@query(f"""WITH {c.BARE_TAGS}, {c.PAIRS} SELECT page_id AS path, start, code FROM pages LEFT JOIN found ON doc = page_id""")
def stream_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watches the pages table until it has seen all of it; what stands then is what one batch would give."""
    base = f"{shared_dir(spark)}/markcheck-stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/pages.parquet").schema
    stream = watch.table_stream(spark, f"{sf_dir}/pages.parquet", schema).select(F.col("page_id").alias("path"), F.col("html").alias("text"))
    watch.watch(stream, _check, f"{base}/snapshots", f"{base}/checkpoint", once=True).awaitTermination()
    return watch.current(spark, f"{base}/snapshots").select("path", "start", "code")


def write_pages(rows: DataFrame, base: str) -> None:
    """Writes ``rows(folder, name, text)`` as a file each, where they are; what is there is replaced."""

    def run(batches):
        for b in batches:
            for folder, name, text in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("folder", "name", "text")), strict=True):
                listing.put(f"{base}/{folder}/{name}", text)
            yield from ()

    rows.select("folder", "name", "text").mapInArrow(run, "folder string").count()


@query(f"""WITH {c.BARE_TAGS}, {c.PAIRS}, kept AS (SELECT page_id, html FROM pages WHERE page_id % 7 <> 1 AND page_id % 5 <> 3),
all_found AS (
  SELECT doc, start, code FROM found
  UNION ALL SELECT page_id, strlen(html)::BIGINT, 'unclosed-tag' FROM pages WHERE page_id % 7 = 2
)
SELECT 'site' || (page_id % 5) || '/' || page_id || '.page' AS path, start, code FROM kept LEFT JOIN all_found ON doc = page_id""")
def watch_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files, watched twice: in between some are edited, some vanish and some are new; one folder is ignored."""
    base = f"{shared_dir(spark)}/markcheck-site-{uuid.uuid4().hex}"
    pages = c.pages(spark, sf_dir).select((F.col("doc") % 7).alias("k"), F.concat(F.lit("site"), F.col("doc") % 5).alias("folder"), F.concat(F.col("doc"), F.lit(".page")).alias("name"), F.col("html").alias("text"))

    def look() -> None:
        watch.watch_edits(spark, f"{base}/pages", [".page"], _check, f"{base}/snapshots", f"{base}/checkpoint", every=None, ignores=["site3"]).awaitTermination()

    write_pages(pages.where("k <> 3"), f"{base}/pages")
    look()
    write_pages(pages.where("k = 2").withColumn("text", F.concat("text", F.lit("<section>"))).unionByName(pages.where("k = 3")), f"{base}/pages")
    listing.drop(spark, pages.where("k = 1").select(F.concat_ws("/", F.lit(f"{base}/pages"), "folder", "name").alias("path")))
    look()
    return watch.standing(spark, f"{base}/snapshots").select(F.substring_index("path", "/", -2).alias("path"), "start", "code")


@query("""SELECT 'site' || (page_id % 5) || '/' || page_id || '.page' AS path, strlen(html)::BIGINT AS bytes FROM pages WHERE page_id % 5 NOT IN (1, 4)""")
def ignored_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files, scanned without two folders."""
    base = f"{shared_dir(spark)}/markcheck-site-{uuid.uuid4().hex}"
    pages = c.pages(spark, sf_dir).select(F.concat(F.lit("site"), F.col("doc") % 5).alias("folder"), F.concat(F.col("doc"), F.lit(".page")).alias("name"), F.col("html").alias("text"))
    write_pages(pages, base)
    return corpus.scan_files(spark, base, [".page"], ["site1/**", "**/site4"]).select(F.substring_index("path", "/", -2).alias("path"), "bytes")
