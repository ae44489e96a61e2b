"""Column functions over slash paths, globs and references. Nothing touches a file system."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))


def _fold(segments: Column, rooted: Column) -> Column:
    """``..`` drops what precedes it; at the front of a relative path it stays."""
    empty = F.expr("cast(array() as array<string>)")

    def step(done: Column, s: Column) -> Column:
        stays = (F.size(done) == 0) | (F.element_at(done, -1) == "..")
        up = F.when(F.size(done) == 0, F.when(rooted, done).otherwise(F.concat(done, F.array(s)))).when(stays, F.concat(done, F.array(s))).otherwise(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        return F.when(s == "..", up).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(segments, empty, step)


def slashes(path: Column) -> Column:
    """Backslashes to slashes."""
    return F.translate(path, "\\", "/")


def under(path: Column, root: str) -> Column:
    """Path without ``root`` in front, and without leading slashes."""
    root = root.rstrip("/")
    inside = path.startswith(root + "/") | (path == root)
    return F.regexp_replace(F.when(inside, F.substring(path, len(root) + 1, 1 << 30)).otherwise(path), "^/+", "")


def normalized(path: Column) -> Column:
    """``.`` and empty segments dropped, ``..`` resolved; nothing left is ``.`` (``/`` for a rooted path)."""
    rooted = path.startswith("/")
    body = F.array_join(_fold(_segments(path), rooted), "/")
    return F.when(rooted, F.concat(F.lit("/"), body)).when(body == "", ".").otherwise(body)


def key(path: Column) -> Column:
    """Comparison key: slashes, normalised, lower case."""
    return F.lower(normalized(slashes(path)))


def dirname(path: Column) -> Column:
    return F.when(path.rlike("^/[^/]*$"), "/").otherwise(F.regexp_extract(path, "^(.*)/[^/]*$", 1))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def resolved(directory: Column, reference: Column) -> Column:
    """Rooted path of ``reference`` seen from ``directory``."""
    whole = F.concat(_segments(directory), _segments(reference))
    return F.concat(F.lit("/"), F.array_join(_fold(whole, F.lit(True)), "/"))


def _hops(a: Column, b: Column) -> Column:
    """Segments that lead from ``a`` to ``b``."""
    shorter = F.least(F.size(a), F.size(b))
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))), F.lit(0), lambda n, i: F.when((n == i - 1) & (i <= shorter) & (F.get(a, i - 1) == F.get(b, i - 1)), i).otherwise(n))
    return F.concat(F.array_repeat(F.lit(".."), F.size(a) - same), F.slice(b, same + 1, F.size(b)))


def relative(directory: Column, target: Column) -> Column:
    """Path from ``directory`` to ``target``, '' for itself."""
    return F.array_join(_hops(_segments(directory), _segments(target)), "/")


def import_path(from_file: Column, target: Column) -> Column:
    """Reference to ``target`` as written in ``from_file``: begins with ``./`` or ``../``."""
    hops = F.array_join(_hops(_segments(dirname(F.regexp_replace(from_file, "/+$", ""))), _segments(target)), "/")
    return F.when(hops == "", ".").when(hops.startswith("."), hops).otherwise(F.concat(F.lit("./"), hops))


def is_within(path: Column, directory: Column) -> Column:
    return ~relative(directory, path).startswith("..")


def split_reference(reference: Column) -> Column:
    """``struct<path,suffix>``, cut before the first ``?`` or ``#``."""
    return F.struct(F.regexp_extract(reference, "^([^?#]*)(?s)(.*)$", 1).alias("path"), F.regexp_extract(reference, "^([^?#]*)(?s)(.*)$", 2).alias("suffix"))


def url_path(url: Column) -> Column:
    """Path of an absolute url, without host, query and fragment."""
    return F.regexp_extract(url, "^[a-z]+://[^/?#]*([^?#]*)", 1)


def normalized_glob(pattern: Column) -> Column:
    """A bare directory also means all below it; patterns that begin with ``*`` and those with wildcards stay."""
    p = F.trim(pattern)
    bare = F.when(p.startswith("./"), F.substring(p, 3, 1 << 30)).otherwise(p)
    return F.when(p.startswith("*"), p).when(bare.contains("*") | bare.endswith("/"), bare).otherwise(F.concat(bare, F.lit("/**")))


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a glob whose ``*`` also crosses slashes; ``{a,b}`` and ``[a-z]``, ``[!a-z]`` count too."""
    out, at, open_braces = ["^"], 0, 0
    while at < len(pattern):
        c, close = pattern[at], pattern.find("]", at + 2)
        if pattern.startswith("**/", at):
            out.append("(?:.*/)?")
            at += 2
        elif pattern.startswith("/**", at) and at + 3 == len(pattern):
            out.append("/.*")
            at += 2
        elif c in "*?":
            out.append(".*" if c == "*" else ".")
        elif c == "[" and close > 0:
            inside = pattern[at + 1 : close]
            out.append("[" + ("^" + inside[1:] if inside[0] in "!^" else inside).replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&") + "]")
            at = close
        elif c == "{" and "}" in pattern[at:]:
            out.append("(?:")
            open_braces += 1
        elif c in ",}" and open_braces:
            out.append("|" if c == "," else ")")
            open_braces -= c == "}"
        else:
            out.append(c if c.isalnum() or c in "_/ " else "\\" + c)
        at += 1
    return "".join(out) + "$"


# Names of route files and the extensions of scripts.
ROUTE_NAMES = {"+page": "page", "+layout": "layout", "+page.server": "page-server", "+layout.server": "layout-server", "+server": "endpoint"}
SCRIPT_EXTENSIONS = ("ts", "js", "mts", "cts", "mjs", "cjs")


def route_kind(path: Column, root: str = "") -> Column:
    """Kind of a script by its place in a project: a route name (cut at ``@``), hooks, a parameter matcher, or null."""
    name = basename(slashes(path))
    base = F.substring_index(F.regexp_extract(name, r"^(.*)\.[^.]*$", 1), "@", 1)
    script = F.substring_index(name, ".", -1).isin(*SCRIPT_EXTENSIONS) & name.contains(".")
    inside = under(slashes(path), root)
    ends = "|".join(SCRIPT_EXTENSIONS)
    kind = F.create_map(*[F.lit(x) for kv in ROUTE_NAMES.items() for x in kv])[base]
    for hook, found in (("src/hooks.server", "server-hooks"), ("src/hooks.client", "client-hooks"), ("src/hooks", "universal-hooks")):
        kind = F.coalesce(kind, F.when(inside.rlike(hook.replace(".", r"\.") + rf"\.(?:{ends})$"), found))
    params = inside.startswith("src/params/") & ~name.contains(".test") & ~name.contains(".spec")
    return F.when(script, F.coalesce(kind, F.when(params, "params")))
