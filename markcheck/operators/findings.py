"""The findings table: severities, overrides, deduplication, order, union, rules."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markcheck.functions import paths
from markcheck.operators import nesting, tokens
from markcheck.scratch import materialize

RANKS = {"hint": 0, "warning": 1, "error": 2}
# Default severities by code, and calls that have no meaning between tags.
SEVERITIES = {"a11y-structure": "warning", "missing-declaration": "error", "invalid-rune-usage": "error", "parse-error": "error", "mismatched-close": "error", "unclosed-tag": "error"}
FORBIDDEN_CALLS = ("$state", "$state.raw", "$state.snapshot", "$derived", "$derived.by", "$effect", "$effect.pre", "$effect.tracking", "$effect.root", "$props", "$bindable", "$inspect", "$inspect.trace", "$host")
Rule = Callable[[DataFrame], DataFrame]


def rank(severity: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv])[F.lower(severity)]


def default_severity(code: Column) -> Column:
    """The severity of a code that nothing else says, ``error`` for an unknown one."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SEVERITIES.items() for x in kv])[code], F.lit("error"))


def at_least(findings: DataFrame, threshold: str) -> DataFrame:
    """``error`` keeps errors only, ``warning`` keeps everything."""
    return findings.where(rank(F.col("severity")) >= (RANKS["error"] if threshold == "error" else 0))


def unified(severity: Column, labels: Mapping[str, tuple[str, str]]) -> Column:
    """``struct<label,rank,counts_as>`` of a producer's own severity word, by a constant table word -> (label, counted as)."""
    entries = [F.lit(x) if isinstance(x, str) else F.struct(F.lit(x[0]).alias("label"), F.lit(RANKS[x[0]]).alias("rank"), F.lit(x[1]).alias("counts_as")) for kv in labels.items() for x in kv]
    return F.create_map(*entries)[severity]


def downgraded(findings: DataFrame, owned: Column, fatal: Sequence[str]) -> DataFrame:
    """Owned findings whose code is not fatal become warnings."""
    return findings.withColumn("severity", F.when(owned & ~F.col("code").isin(*fatal), "warning").otherwise(F.col("severity")))


def overridden(findings: DataFrame, overrides: DataFrame) -> DataFrame:
    """``overrides(code, level)``: ignore drops, error raises, other levels do nothing; case does not matter."""
    levels = overrides.select("code", F.lower("level").alias("__level")).where("__level in ('ignore', 'error')")
    joined = findings.join(levels, "code", "left").where("__level is null or __level <> 'ignore'")
    return joined.withColumn("severity", F.when(F.col("__level") == "error", "error").otherwise(F.col("severity"))).drop("__level")


def deduplicated(findings: DataFrame, owned: Column, keys: Sequence[str], order: str = "ordinal") -> DataFrame:
    """Of owned findings with equal keys the first; the others pass untouched, and are not shuffled. File keys compare normalised."""
    marked = findings.withColumn("__owned", F.coalesce(owned, F.lit(False)))
    w = Window.partitionBy("__file", *keys).orderBy(order)
    first = marked.where("__owned").withColumn("__file", paths.key(F.col("file"))).withColumn("__n", F.row_number().over(w)).where("__n = 1")
    return first.select(*findings.columns).unionByName(marked.where("not __owned").select(*findings.columns))


def ordered(findings: DataFrame, doc: str = "doc") -> DataFrame:
    """Own checks before later phases; per document parse errors first, then by start; ties keep producer and ordinal."""
    return findings.orderBy("phase", doc, F.col("is_parse").desc(), "start", "producer_rank", "ordinal")


def numbered(rows: DataFrame, name: str = "position") -> DataFrame:
    """Sorted ``rows`` with their place from 0: numbered apart in each range that the sort has made, then moved by the ranges before."""
    apart = rows.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    apart = materialize(apart, "sorted")
    sizes = apart.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))  # a row per partition
    return apart.join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + F.col("__at")).cast("long")).drop("__part", "__at", "__before")


def union(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def first_wins(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """``key, value``: what was inserted first stays."""
    return rows.groupBy(key).agg(F.min_by(value, order).alias(value))


def duplicate_keys(rows: DataFrame, key: Column) -> DataFrame:
    """``key, n, variants``: keys that several rows share once normalised."""
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.count_distinct(F.struct("*")).alias("variants")).where("n > 1")


def check_nesting(events: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Close tags that close an element of another name, and elements still open at the end of the text.

    End tags that may be left out are put in first, so their elements are neither. With ``blocks`` (``markup.blocks``) an
    element also has to be closed where the block, or the part of it, ends in which it was opened. A close tag that has
    nothing to close in its block, or outside of all, is no finding.
    """
    if blocks is not None:
        inside = nesting.framed(events, blocks)
        keyed = inside.select(F.struct("doc", "frame").alias("doc"), *(c for c in inside.columns if c not in ("doc", "frame")))
        found = check_nesting(keyed)
        return found.select("doc.doc", *(c for c in found.columns if c != "doc"))
    closes = F.col("kind") == "close"
    wrong = closes & (F.col("opener.name") != F.col("name"))
    left_open = ~closes & ~F.col("closed") & (F.lower("name") != "li")
    message = F.when(closes, F.format_string("mismatched closing tag: expected </%s>, found </%s>", "opener.name", "name")).otherwise(F.format_string("unclosed tag: <%s>", "name"))
    code = F.when(closes, "mismatched-close").otherwise("unclosed-tag")
    found = nesting.pairs(nesting.with_optional_ends(events)).where(wrong | left_open)
    return found.select("doc", "start", "end", code.alias("code"), default_severity(code).alias("severity"), message.alias("message"))


def check_mismatched(events: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """A close tag that closes an element of another name."""
    return check_nesting(events, blocks).where("code = 'mismatched-close'")


def check_unclosed(events: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """An element still open at the end of the text or of its block, unless its end tag is optional."""
    return check_nesting(events, blocks).where("code = 'unclosed-tag'")


def check_headings(events: DataFrame) -> DataFrame:
    """A heading more than one level deeper than the one before it."""
    headings = events.where(F.col("kind").isin("open", "void") & F.col("name").rlike("^h[1-6]$")).withColumn("level", F.substring("name", 2, 1).cast("int"))
    found = nesting.level_skips(headings, "doc", ["start"], "level")
    message = F.format_string("A11y: Heading levels should not be skipped (h%s followed by h%s)", "previous", "level")
    code = F.lit("a11y-structure")
    return found.select("doc", "start", "end", code.alias("code"), default_severity(code).alias("severity"), message.alias("message"))


def check_calls(expressions: DataFrame, names: Sequence[str] = ()) -> DataFrame:
    """Calls of ``names`` in expressions between tags, where they have no meaning; the first occurrence of a name counts."""
    names = names or FORBIDDEN_CALLS
    keyed = expressions.select(F.struct("doc", "start", "end").alias("at"), "text")
    found = tokens.first_calls(keyed, names, doc="at").select("doc.*", "name")
    message = F.format_string("%s() can only be used inside a $derived or $effect, or at the top level of a component", "name")
    code = F.lit("invalid-rune-usage")
    return found.select("doc", "start", "end", code.alias("code"), default_severity(code).alias("severity"), message.alias("message"))


# Attributes that hold nothing but numbers.
NUMERIC_ATTRIBUTES = (
    "aria-colcount aria-colindex aria-colspan aria-level aria-posinset aria-rowcount aria-rowindex aria-rowspan aria-setsize aria-valuemax aria-valuemin aria-valuenow "
    "results span marginheight marginwidth maxlength minlength currenttime defaultplaybackrate volume high low optimum start size border cols rows colspan rowspan tabindex"
).split()


def check_numeric_attributes(attributes: DataFrame) -> DataFrame:
    """Numeric attributes whose text is a number literal, with its value."""
    value = F.expr("try_cast(trim(value) as double)")
    found = attributes.where(F.col("name").isin(*NUMERIC_ATTRIBUTES) & (F.col("value_kind") == "text")).withColumn("number", value)
    return found.where("number is not null and not isnan(number)").select("doc", "start", "name", "value", "number")


def check_external_references(references: DataFrame, root: str) -> DataFrame:
    """References with ``..`` that leave ``root``: (doc, page, reference) with target and the reference seen from ``root``."""
    cut = paths.split_reference(F.col("reference"))
    target = paths.resolved(paths.dirname(F.col("page")), cut["path"])
    rows = references.where(F.col("reference").rlike(r"(^|/)\.\.(/|$)")).withColumn("target", target)
    rows = rows.where(~paths.is_within(F.col("target"), F.lit(root)))
    return rows.withColumn("rewritten", F.concat(paths.relative(F.lit(root), F.col("target")), cut["suffix"]))


RULES: dict[str, Rule] = {"nesting": check_nesting, "a11y": check_headings, "component": check_calls}


def run_rules(events: DataFrame, families: Sequence[str] = ("nesting", "a11y"), rules: Mapping[str, Rule] = RULES, inputs: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Findings of the rule families that are switched on; a family reads ``events`` or what ``inputs`` has for it.

    The component family reads ``markup.expressions``. Every finding has the default severity of its code.
    """
    return union(*(rules[f]((inputs or {}).get(f, events)).withColumn("family", F.lit(f)) for f in families))
