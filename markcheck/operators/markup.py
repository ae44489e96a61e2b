"""Markup as rows: tags, attributes, comments and raw sections with byte offsets."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markcheck.functions import braces
from markcheck.functions.text import is_void
from markcheck.operators import lines

# Java regular expressions; possessive, so that a text of any length needs no stack. Braces nest three deep here; texts
# where they nest deeper, or where strings in them hold braces, are cut by ``functions.braces`` instead.
BRACES = r"\{(?:[^{}]++|\{(?:[^{}]++|\{[^{}]*+\})*+\})*+\}"
QUOTED = r"\"[^\"]*+\"|'[^']*+'"
#: Inside a tag; quoted values and braces may hold ``<`` and ``>``.
REST = rf"(?:[^<>={{]++|=\s*+(?:{QUOTED})|{BRACES}|[={{])*+"
TAG = rf"</?[a-zA-Z][^\s/<>]*+{REST}>?"
#: Open tag, content and close tag of an element without markup inside; groups: name, open tag's end, close tag.
RAW_HEAD = rf"<(?:script|style|textarea|title)(?=[\s/>]){REST}(?<!/)>"
RAW = rf"<(script|style|textarea|title)(?=[\s/>]){REST}(?<!/)>.*?(</\1(?=[\s/>]|\z)[^>]*+>?|\z)"
COMMENT = r"<!--.*?(?:-->|\z)"
NAME = r"^/?([a-zA-Z][^\s/<>]*)"
ATTRIBUTE = rf"{BRACES}|[^\s=/>\"'{{]++(?:\s*+=\s*+(?:{QUOTED}|(?:{BRACES}|[^\s>\"'{{])++))?+"


#: A brace behind which a string holds a brace or does not end.
_ODD_STRING = r"\{(?:[^{}\"'`]++|\"[^\"{}]*+\"|'[^'{}]*+'|`[^`{}]*+`)*+[\"'`]"
#: Bytes of text that are cut at a time in Python, where pieces take many times as much.
SLICE = 1 << 20
_PIECES = "array<struct<gap:string,text:string,flat:string>>"


def _deep(text: Column) -> Column:
    """Whether a pattern that counts braces three deep may misread them in ``text``."""
    return F.coalesce(text.contains("{") & (F.regexp_replace(text, BRACES, "").rlike("[{}]") | text.rlike(_ODD_STRING)), F.lit(False))


def _slices(b: pa.RecordBatch, text: pa.Array) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows of ``b`` with their texts, a few at a time: up to ``SLICE`` bytes, or one row."""
    lo, held = 0, 0
    for k, size in enumerate(pa.compute.binary_length(text).to_pylist()):
        if k > lo and held + (size or 0) > SLICE:
            yield b.slice(lo, k - lo), text.slice(lo, k - lo).to_pylist()
            lo, held = k, 0
        held += size or 0
    if lo < b.num_rows:
        yield b.slice(lo), text.slice(lo).to_pylist()


def _rows(cut: Callable[[str], Iterator[tuple[int, int, str]]], keep: list[str], text: str) -> Callable:
    """Texts with ``cut``: pieces by what stands before them, the last without a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some, texts in _slices(b, b.column(b.schema.get_field_index(text))):
                ends, gap, piece, flat = [0], [], [], []
                for value in texts:
                    at = 0
                    for start, end, as_flat in cut(value):
                        gap.append(value[at:start])
                        piece.append(value[start:end])
                        flat.append(as_flat)
                        at = end
                    gap.append(value[at:])
                    piece.append(None)
                    flat.append(None)
                    ends.append(len(gap))
                pieces = pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in (gap, piece, flat)], ["gap", "text", "flat"])
                found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pieces)
                yield pa.RecordBatch.from_arrays([*(some.column(some.schema.get_field_index(c)) for c in keep), pa.nulls(some.num_rows, pa.string()), found], [*keep, text, "cut"])

    return run


def _cut(rows: DataFrame, pattern: str, cut: Callable[[str], Iterator[tuple[int, int, str]]], text: str) -> tuple[DataFrame, Column]:
    """``rows`` and, of their last column ``text``, the pieces ``gap, text, flat``: by a pattern, or by ``cut`` where braces are deep."""
    keep = [c for c in rows.columns if c != text]
    deep = _deep(F.col(text))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != text)
    plain = rows.where(~deep).select(*keep, text, F.expr(f"cast(null as {_PIECES})").alias("cut"))
    hard = rows.where(deep).mapInArrow(_rows(cut, keep, text), f"{kinds}, `{text}` string, cut {_PIECES}")
    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("text"), F.expr("cast(array() as array<string>)").alias("flat"))
    return plain.unionByName(hard), F.coalesce("cut", found)


def _tokens(pages: DataFrame, pattern: str, masked: bool, doc: str, html: str) -> DataFrame:
    """``doc, start, text, gap, flat``: tokens at their byte offsets, each with the text before it; the last gap has none.

    ``flat`` is the text of the same length in which braces do not nest.
    """
    texts = pages.select(F.col(doc).alias("doc"), F.col(html).alias("html"))
    placed, both = _cut(texts, pattern, lambda t: braces.flat_tokens(t, masked), "html")
    rows = lines.by_document(placed, texts, "html").select("doc", F.posexplode(both).alias("i", "z")).select("doc", "i", "z.gap", "z.text", F.coalesce("z.flat", "z.text").alias("flat"))
    w = Window.partitionBy("doc").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    return rows.withColumn("start", (F.sum(F.octet_length("gap").cast("long") + size).over(w) - size).cast("long"))


def _masked(pages: DataFrame, doc: str, html: str) -> DataFrame:
    return _tokens(pages, f"(?is){COMMENT}|{RAW}|{TAG}", True, doc, html)


def _head() -> Column:
    """Open tag of a raw section, empty for anything else."""
    return F.substring(F.col("text"), F.lit(1), F.length(F.regexp_extract("flat", f"(?is)^{RAW_HEAD}", 0)))


def _event(text: Column, start: Column, name: Column | None = None) -> Column:
    shut = text.endswith(">")
    body = F.substring(text, F.lit(2), F.length(text) - F.when(shut, 2).otherwise(1))
    name = F.regexp_extract(body, NAME, 1) if name is None else name
    kind = F.when(body.startswith("/"), "close").when(body.endswith("/"), "self").when(is_void(name), "void").otherwise("open")
    return F.struct(start.alias("start"), (start + F.octet_length(text)).cast("long").alias("end"), kind.alias("kind"), name.alias("name"), body.alias("body"))


def tag_events(pages: DataFrame, doc: str = "doc", html: str = "html") -> DataFrame:
    """``doc, start, end, kind, name, body`` of everything that looks like a tag, also inside comments and scripts.

    Quoted values and braces belong to their tag whatever they hold; a tag that is not ended runs to the next ``<``.
    """
    found = _tokens(pages, TAG, False, doc, html).where("text is not null")
    return found.select("doc", _event(F.col("text"), F.col("start")).alias("e")).select("doc", "e.*")


def masked_tag_events(pages: DataFrame, doc: str = "doc", html: str = "html") -> DataFrame:
    """Tag events outside comments and raw sections; a raw section's own open and close tag stay.

    A raw section ends at its name in any case, followed by a blank, ``/``, ``>`` or the end of the text.
    """
    text, start = F.col("text"), F.col("start")
    found = _masked(pages, doc, html).where("text is not null and text not like '<!--%'")
    shut = F.regexp_extract("flat", f"(?is)^{RAW}$", 2)
    found = found.withColumn("head", _head()).withColumn("shut", F.when(F.col("head") != "", shut).otherwise(""))
    opens = _event(F.when(F.col("head") != "", F.col("head")).otherwise(text), start)
    closes = _event(F.col("shut"), start + F.octet_length(text) - F.octet_length("shut"))
    both = F.when(F.col("shut") == "", F.array(opens)).otherwise(F.array(opens, closes))
    return found.select("doc", F.explode(both).alias("e")).select("doc", "e.*")


def attributes(events: DataFrame) -> DataFrame:
    """``doc, start, ord, name, value_kind, value, directive, modifiers`` of every attribute of open tags.

    ``value_kind`` is bare, text, expression (``{...}``) or mixed; ``kind:name|a|b`` gives directive and modifiers.
    An expression alone, ``{name}``, is named by what it holds.
    """
    rest = F.regexp_replace("body", NAME, "")
    pieces, both = _cut(events.where("kind <> 'close'").select("doc", "start", rest.alias("rest")), ATTRIBUTE, lambda t: braces.flat_pieces(t, re.compile(ATTRIBUTE, re.A)), "rest")
    rows = pieces.select("doc", "start", F.posexplode(both).alias("ord", "z")).select("doc", "start", "ord", F.col("z.text").alias("a"), F.coalesce("z.flat", "z.text").alias("flat")).where("a is not null")
    alone = F.col("a").startswith("{")

    def value(of: str) -> Column:
        own = F.regexp_extract(of, r"(?s)^[^=]*=\s*(.*)$", 1)
        own = F.when(own.rlike("(?s)^[\"'].*[\"']$"), F.substring(own, F.lit(2), F.length(own) - 2)).otherwise(own)
        return F.when(alone, F.col(of)).otherwise(own)

    text, flat = value("a"), value("flat")
    kind = F.when(alone, "expression").when(~F.col("a").contains("="), "bare").when(flat.rlike(f"^{BRACES}$"), "expression").when(flat.rlike(BRACES), "mixed").otherwise("text")
    head = F.when(alone, F.regexp_replace("a", r"^\{\s*|\s*\}$", "")).otherwise(F.regexp_extract("a", r"^([^\s=]+)", 1))
    plain = F.split(F.regexp_replace(head, "^[^:]*:", ""), "\\|")
    is_directive = ~alone & head.contains(":")
    return rows.select(
        "doc",
        "start",
        F.col("ord").cast("long").alias("ord"),
        F.when(is_directive, plain[0]).otherwise(head).alias("name"),
        kind.alias("value_kind"),
        text.alias("value"),
        F.when(is_directive, F.regexp_extract(head, "^([^:]*):", 1)).alias("directive"),
        F.when(is_directive, F.slice(plain, F.lit(2), F.size(plain))).alias("modifiers"),
    )


def comments(pages: DataFrame, doc: str = "doc", html: str = "html") -> DataFrame:
    """``doc, start, end, text`` of comments outside raw sections; an unterminated one runs to the end."""
    text = F.regexp_replace(F.regexp_replace("text", "^<!--", ""), "-->$", "")
    return _masked(pages, doc, html).where("text like '<!--%'").select("doc", "start", (F.col("start") + F.octet_length("text")).cast("long").alias("end"), text.alias("text"))


def expressions(pages: DataFrame, doc: str = "doc", html: str = "html") -> DataFrame:
    """``doc, start, end, text`` of what stands in braces between tags, ``text`` without the braces."""
    gaps = _masked(pages, doc, html).select("doc", (F.col("start") - F.octet_length("gap")).alias("from"), "gap").where(F.col("gap").contains("{"))
    pieces, both = _cut(gaps, BRACES, lambda t: braces.flat_pieces(t, re.compile(BRACES)), "gap")
    rows = pieces.select("doc", "from", F.posexplode(both).alias("i", "z")).select("doc", "from", "i", "z.gap", "z.text")
    w = Window.partitionBy("doc", "from").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("from") + F.sum(F.octet_length("gap").cast("long") + F.coalesce(F.octet_length("text"), F.lit(0))).over(w)
    found = rows.withColumn("end", end.cast("long")).where("text is not null")
    return found.select("doc", (F.col("end") - F.octet_length("text")).cast("long").alias("start"), "end", F.substring(F.col("text"), F.lit(2), F.length("text") - 2).alias("text"))


def blocks(pages: DataFrame, doc: str = "doc", html: str = "html") -> DataFrame:
    """``doc, start, end, kind``: where a block begins (``{#if ...}``), goes on (``{:else}``) or ends (``{/if}``); kinds block, part and end."""
    mark = F.substring(F.ltrim("text"), 1, 1)
    kind = F.when(mark == "#", "block").when(mark == ":", "part").when(mark == "/", "end")
    return expressions(pages, doc, html).select("doc", "start", "end", kind.alias("kind")).where("kind is not null")


def sections(pages: DataFrame, doc: str = "doc", html: str = "html") -> DataFrame:
    """``doc, name, context, lang, start, body_start, body_end, body``: script and style sections."""
    raw = _masked(pages, doc, html).withColumn("name", F.lower(F.regexp_extract("flat", f"(?is)^{RAW}$", 1))).where("name in ('script', 'style')")
    head, shut = _head(), F.regexp_extract("flat", f"(?is)^{RAW}$", 2)
    body = F.substring(F.col("text"), F.length(head) + 1, F.length("text") - F.length(head) - F.length(shut))
    begin = (F.col("start") + F.octet_length(head)).cast("long")
    return raw.select(
        "doc",
        "name",
        F.when(F.lower(head).rlike("context=[\"']?module|\\smodule[\\s>]"), "module").otherwise("instance").alias("context"),
        F.when(head.rlike("lang=[\"']?(?:ts|typescript)[\"'\\s>]"), "ts").otherwise("js").alias("lang"),
        "start",
        begin.alias("body_start"),
        (begin + F.octet_length(body)).cast("long").alias("body_end"),
        body.alias("body"),
    )


def last_sections(found: DataFrame) -> DataFrame:
    """Of sections of one kind in a document, the last."""
    return found.groupBy("doc", "name", "context").agg(F.max_by("body", "start").alias("body"), F.max("start").alias("start"), F.count("*").alias("n"))


