"""Column functions over names, codes and text positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# HTML elements without an end tag.
VOID_ELEMENTS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
#: Unicode white space for Java regular expressions.
BLANK = r"[\s\u0085\p{Z}]"


def snake_code(code: Column) -> Column:
    """Kebab case to snake case."""
    return F.translate(code, "-", "_")


def is_void(name: Column) -> Column:
    """Elements that never hold content; a name with an upper-case letter is never one."""
    return name.isin(*VOID_ELEMENTS)


def tag_class(name: Column) -> Column:
    """``void``, ``prefixed`` (a:b), ``component`` (upper-case first or dotted), ``custom`` (with a dash) or ``element``."""
    return (
        F.when(is_void(name), "void")
        .when(name.contains(":"), "prefixed")
        .when(name.rlike("^[A-Z]") | name.contains("."), "component")
        .when(name.contains("-"), "custom")
        .otherwise("element")
    )


def is_blank(text: Column) -> Column:
    """Nothing but Unicode white space (or nothing at all)."""
    return F.regexp_replace(text, BLANK, "") == ""


def trimmed_span(start: Column, text: Column) -> Column:
    """``struct<start,end>`` in bytes of what blanks at both ends of ``text`` leave; a blank text gives an empty span at its start."""
    left = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "^[ \\t\\r\\n]+", ""))
    body = F.octet_length(F.regexp_replace(F.regexp_replace(text, "^[ \\t\\r\\n]+", ""), "[ \\t\\r\\n]+$", ""))
    low = F.when(body == 0, start).otherwise(start + left).cast("long")
    return F.struct(low.alias("start"), (low + body).cast("long").alias("end"))


def char_line_col(text: Column, offset: Column) -> Column:
    """``struct<line,col>``, 1-based, with characters as columns, of a character offset; past the end counts from the end."""
    before = F.substring(text, F.lit(1), F.greatest(offset, F.lit(0)).cast("int"))
    breaks = F.length(before) - F.length(F.translate(before, "\n", ""))
    return F.struct((breaks + 1).cast("long").alias("line"), (F.length(F.substring_index(before, "\n", -1)) + 1).cast("long").alias("col"))
