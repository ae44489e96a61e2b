"""Braces of any depth in markup, for the few texts that a regular expression of fixed depth does not read right.

``flat_tokens`` and ``flat_pieces`` cut a text as the patterns of ``operators.markup`` do, but step over whole brace
groups: over groups inside them, and over strings, templates and comments, whatever braces these hold. Beside each
token they give it *flat*: of the same length, with its inner braces and those of its strings blanked, so that a
pattern for braces that do not nest reads it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

RAW_NAMES = ("script", "style", "textarea", "title")
_OPEN = re.compile(r"<!--|</?[a-zA-Z][^\s/<>]*", re.ASCII)
_TAG_ONLY = re.compile(r"</?[a-zA-Z][^\s/<>]*", re.ASCII)
_IN_TAG = re.compile(r"[<>={]")
_QUOTED = re.compile(r"\s*(?:\"[^\"]*\"|'[^']*')", re.ASCII)
_IN_CODE = re.compile(r"[{}\"'`]|//|/\*")
_STRINGS = {'"': re.compile(r'(?:[^"\\\n]|\\.)*"', re.S), "'": re.compile(r"(?:[^'\\\n]|\\.)*'", re.S)}
_IN_TEMPLATE = re.compile(r"\\.|`|\$\{", re.S)
_BLANK = str.maketrans("{}", "xx")


def group_end(text: str, at: int) -> int | None:
    """Where the brace group that opens at ``at`` ends, None if it does not."""
    stack, i, n = ["{"], at + 1, len(text)
    while stack:
        if stack[-1] == "`":
            m = _IN_TEMPLATE.search(text, i)
            if m is None:
                return None
            i = m.end()
            if m[0] == "`":
                stack.pop()
            elif m[0] == "${":
                stack.append("{")
            continue
        m = _IN_CODE.search(text, i)
        if m is None:
            return None
        i = m.end()
        if m[0] in "{`":
            stack.append(m[0])
        elif m[0] == "}":
            stack.pop()
        elif m[0] == "//":
            i = n if (end := text.find("\n", i)) < 0 else end
        elif m[0] == "/*":
            i = n if (end := text.find("*/", i)) < 0 else end + 2
        elif string := _STRINGS[m[0]].match(text, i):
            i = string.end()
    return i


def _flat_group(text: str, at: int, end: int) -> str:
    return "{" + text[at + 1 : end - 1].translate(_BLANK) + "}"


def _tag_end(text: str, at: int) -> tuple[int, str]:
    """End of a tag whose name ends at ``at``, and its rest, flat."""
    out, i = [], at
    while m := _IN_TAG.search(text, i):
        out.append(text[i : m.start()])
        i, c = m.start(), m[0]
        if c == "<":
            return i, "".join(out)
        if c == ">":
            return i + 1, "".join([*out, c])
        end = None
        if c == "=" and (quoted := _QUOTED.match(text, i + 1)):
            end = quoted.end()
            out.append(text[i:end])
        elif c == "{" and (end := group_end(text, i)) is not None:
            out.append(_flat_group(text, i, end))
        if end is None:
            out.append(c)
            end = i + 1
        i = end
    return len(text), "".join([*out, text[i:]])


def flat_tokens(text: str, masked: bool) -> Iterator[tuple[int, int, str]]:
    """``(start, end, flat)`` of tags and, if ``masked``, of comments and raw elements, which then hold no tags."""
    at = 0
    while m := (_OPEN if masked else _TAG_ONLY).search(text, at):
        if m[0] == "<!--":
            end = text.find("-->", m.end())
            at = len(text) if end < 0 else end + 3
            yield m.start(), at, text[m.start() : at]
            continue
        end, rest = _tag_end(text, m.end())
        flat = m[0] + rest
        name = m[0][1:].lower()
        if masked and name in RAW_NAMES and rest.endswith(">") and not rest.endswith("/>"):
            close = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I | re.A).search(text, end)
            stop = close.end() if close else len(text)
            flat += text[end:stop]
            end = stop
        yield m.start(), end, flat
        at = end


def flat_text(text: str) -> str:
    """``text`` with every outermost brace group flat; a brace that is not closed stays."""
    out, i = [], 0
    while (at := text.find("{", i)) >= 0:
        end = group_end(text, at)
        out.append(text[i:at])
        out.append("{" if end is None else _flat_group(text, at, end))
        i = at + 1 if end is None else end
    return "".join([*out, text[i:]])


def flat_pieces(text: str, pattern: re.Pattern) -> Iterator[tuple[int, int, str]]:
    """``(start, end, flat)`` of the matches of a pattern for braces that do not nest."""
    flat = flat_text(text)
    for m in pattern.finditer(flat):
        yield m.start(), m.end(), m[0]
