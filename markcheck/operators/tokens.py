"""Tokens, names and references found in text."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Strings and comments of program text, for ``skip``. Java's and Python's patterns read it alike, with ``(?s)`` before it.
CODE = r"\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`|//[^\n]*+|/\*.*?(?:\*/|(?!.))"
#: Words of a batch that ``words`` sends on.
WORDS = 65_536
_WORD = r"[\pL\pN_]"


def token_regex(tokens: Sequence[str]) -> str:
    """Tokens of a vocabulary as whole words, the longest first at a position."""
    longest = sorted(set(tokens), key=lambda t: (-len(t), t))
    words = [re.escape(t) for t in longest if _is_word(t[0]) and _is_word(t[-1])]  # look around once for all of these
    odd = [(rf"(?<!{_WORD})" if _is_word(t[0]) else "") + re.escape(t) + (rf"(?!{_WORD})" if _is_word(t[-1]) else "") for t in longest if not (_is_word(t[0]) and _is_word(t[-1]))]
    return "|".join([*odd, *([rf"(?<!{_WORD})(?:{'|'.join(words)})(?!{_WORD})"] if words else [])])


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _placed(docs: DataFrame, pattern: str, doc: str, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """``doc, *keep, start, token``: matches by byte offset. Only they are shuffled, each with the length of the text before it."""
    t = F.col(text)
    both = F.arrays_zip(F.transform(F.split(t, pattern, -1), F.octet_length).alias("gap"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("token"))
    rows = docs.select(F.col(doc).alias("doc"), *keep, F.posexplode(both).alias("i", "z")).where("z.token is not null").select("doc", *keep, "i", "z.gap", "z.token")
    w = Window.partitionBy("doc").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    size = F.octet_length("token")
    return rows.select("doc", *keep, (F.sum((F.col("gap") + size).cast("long")).over(w) - size).cast("long").alias("start"), "token")


def token_occurrences(docs: DataFrame, tokens: Sequence[str], doc: str = "doc", text: str = "text", skip: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """``doc, *keep, start, token``: occurrences of a fixed vocabulary by byte offset, longest first, as whole words.

    What ``skip`` matches, such as ``CODE``, is stepped over. Documents have one row each.
    """
    pattern = token_regex(tokens) if skip is None else f"(?s)(?:{skip})|{token_regex(tokens)}"
    return _placed(docs, pattern, doc, text, keep).where(F.col("token").isin(*tokens))


def _all_words(skip: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # \w is [\pL\pN_] here; what it matches behind a skipped part that ends within a word is no whole word
        pattern = re.compile((f"(?s)(?:{skip})|" if skip else "") + r"(?<!\w)(\w++)")
        rows, starts, found = [], [], []

        def flush(batch: pa.RecordBatch) -> pa.RecordBatch:
            others = [batch.column(k).take(pa.array(rows, pa.int32())) for k in range(batch.num_columns - 1)]
            columns = [*others, pa.array(starts, pa.int64()), pa.array(found, pa.string())]
            out = pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "start", "token"])
            for held in (rows, starts, found):
                held.clear()
            return out

        for batch in batches:
            for row, text in enumerate(batch.column(batch.num_columns - 1)):
                text = text.as_py() or ""
                at = seen = 0  # bytes before the character ``seen``
                for m in pattern.finditer(text):
                    if m[1] is None:
                        continue
                    at += len(text[seen : m.start()].encode())
                    seen = m.start()
                    rows.append(row)
                    starts.append(at)
                    found.append(m[1])
                    if len(rows) == WORDS:
                        yield flush(batch)
            yield flush(batch)

    return run


def words(docs: DataFrame, doc: str = "doc", text: str = "text", skip: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """``doc, *keep, start, token``: all whole words (letters, digits and ``_``) by byte offset, but for what ``skip`` matches.

    Nothing is shuffled: places are counted while a text is read. A null or empty text has no words; documents may have
    several rows; a text of any length goes out in batches of ``WORDS`` words.
    """
    rows = docs.select(F.col(doc).alias("doc"), *keep, F.col(text).cast("string").alias("__text"))
    fields = [*rows.schema.fields[:-1], StructField("start", LongType()), StructField("token", StringType())]
    return rows.mapInArrow(_all_words(skip), StructType(fields))


def vocabulary_occurrences(docs: DataFrame, vocabulary: DataFrame, token: str = "token", doc: str = "doc", text: str = "text", skip: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """``doc, *keep, start, token``: occurrences of the words in a column of ``vocabulary``, by byte offset.

    The same as ``token_occurrences`` with these words, but for a table of any size: words meet it in an equi-join, which
    is broadcast or shuffled by size and splits frequent words. An entry that is not one whole word is never found;
    nulls, repeated entries and other columns of the table change nothing.
    """
    wanted = vocabulary.select(F.col(token).cast("string").alias("token")).where("token is not null").distinct()
    return words(docs, doc, text, skip, keep).join(wanted, "token", "left_semi").select("doc", *keep, "start", "token")


def marked_names(docs: DataFrame, mark: str, doc: str = "doc", text: str = "text", skip: str = CODE) -> DataFrame:
    """``doc, name``: distinct identifiers that follow ``mark``, outside strings and comments."""
    code = F.regexp_replace(F.col(text), f"(?s){skip}", " ")
    found = F.array_distinct(F.regexp_extract_all(code, F.lit(re.escape(mark) + "([A-Za-z_][A-Za-z0-9_]*)"), 1))
    return docs.select(F.col(doc).alias("doc"), F.explode(found).alias("name"))


def references(attributes: DataFrame, names: Sequence[str] = ("href", "src", "action")) -> DataFrame:
    """``doc, start, reference``: targets that attributes name."""
    return attributes.where(F.lower("name").isin(*names) & (F.col("value") != "")).select("doc", "start", F.col("value").alias("reference"))


def quoted_references(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """``doc, start, reference``: quoted specifiers after from, import, import( and require(, not in comments; ``start`` is past the quote."""
    pattern = r"(?s)//[^\n]*+|/\*.*?(?:\*/|\z)|\b(?:from|import|require)\s*\(?\s*(?:\"[^\"\n]+\"|'[^'\n]+')"
    found = _placed(docs, pattern, doc, text).where("not startswith(token, '/')")
    reference = F.regexp_extract("token", "[\"'](.+)[\"']$", 1)
    return found.select("doc", (F.col("start") + F.octet_length("token") - F.octet_length(reference) - 1).cast("long").alias("start"), reference.alias("reference"))


def first_calls(docs: DataFrame, names: Sequence[str], doc: str = "doc", text: str = "text") -> DataFrame:
    """``doc, name, start``: names whose *first* occurrence is a call, that is, ``name(`` not after a letter, digit, ``_`` or ``.``."""
    t = F.col(text)

    def called(name: Column) -> Column:
        at = F.instr(t, name)
        free = (at == 1) | ~F.substring(t, at - 1, F.lit(1)).rlike(r"[\p{L}\p{N}_.]")
        return (at > 0) & (F.substring(t, at + F.length(name), F.lit(1)) == "(") & free

    found = F.filter(F.array(*[F.lit(n) for n in names]), called)  # the text is not copied for each name
    rows = docs.select(F.col(doc).alias("doc"), F.transform(found, lambda n: F.struct(n.alias("name"), (F.instr(t, n) - 1).cast("long").alias("start"))).alias("calls"))
    return rows.select("doc", F.explode("calls").alias("c")).select("doc", "c.name", "c.start")
