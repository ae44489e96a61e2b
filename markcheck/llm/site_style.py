"""Main text of pages by site style trees.

The DOMs of a host are merged: a node of the merged tree stands for one path of styled elements (tag, class, and the
kinds of blocks inside) on all pages of the host. Its presentation importance is the entropy of the child styles that pages
show there, its content importance one minus the mean entropy of its sentences over pages: boilerplate is spread over
many pages, articles say something else on every page. Branches whose combined importance is low are cut from each page.

Scripts, forms and elements that name their role (navigation, adverts) are presentation nodes of known importance. A
core (an article or a main part) is prior knowledge that adds to the importance of the blocks inside it and takes from
those outside; neither decides alone. What carries no such name is for the tree to judge.

The entropy of a sentence counts pages of all hosts that show it at one path, and is full once it is that of ``SPREAD``
pages, so it means the same at any size of host or corpus. A node's content importance is the mean over what its own host
shows; hosts with few pages lean on the mean of the same path over all hosts, by ``SHARED`` pages against their own.
Copies of a page share the weight of one. What one page of a host alone shows is weighed by what it says.

Nodes and sentences are counted by their hashes, combined inside each task before they are summed, so a hot host costs
every task one row per node and sentence. A page is given the unimportant paths of its host, not the tree.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import ChainMap, Counter, defaultdict
from collections.abc import Iterator, Mapping

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markcheck.scratch import materialize

#: Pages over which a sentence is spread that says nothing of any of them.
SPREAD = 4
#: Pages for which a path's mean over all hosts counts, against those of the host.
SHARED = 8
#: Branches under this importance go.
KEEP = 0.35
#: What lying in a core adds to the importance of a block, and what lying outside the cores of its page takes away.
CORE_BONUS, OUTSIDE = 0.2, 0.5
#: Weight of a node's own presentation against its children's, by number of styles seen.
GAMMA = 0.9
#: Counts that a task holds before it passes them on.
HELD = 200_000
#: Texts with copies whose weights are broadcast to the scan of the pages; more are joined by shuffling the pages.
BROADCAST = 1_000_000

# HTML element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"html", "body"}
NOISE = frozenset("head script style title noscript template iframe object svg canvas nav footer aside form button select textarea input menu dialog".split())
CORE = frozenset("article main".split())
FRAMES = CORE | {"html", "body"}
NOISE_NAMES = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disclaimer|footer|header|masthead|menu|nav|navbar|navigation|newsletter|notices?|popup|promo\w*|related|replies|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>", re.S)
_CLASS = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SENTENCES = re.compile(r"[.!?:;\u3002\uff01\uff1f\u061f\u0964]+(?=\s|\Z)|\n+").split
_WORDS = re.compile(r"\w+").findall
_SERIAL = re.compile(r"\d{3,}")  # of one page, like the number of a post


class Node:
    __slots__ = ("children", "core", "held", "name", "named", "noise", "size", "style")

    def __init__(self, name: str, attributes: str = ""):
        self.name, self.children = name, []
        labels = " ".join(v for m in _CLASS.finditer(attributes) for v in m.groups()[1:] if v) if attributes else ""
        self.style = f"{name}.{'.'.join(sorted(_SERIAL.sub('#', labels).split()))}" if labels else name
        self.core = name in CORE
        # a name or a form may be that of a frame around the page, see _spare
        self.named = name not in FRAMES and (name == "form" or bool(labels and NOISE_NAMES.search(labels)))
        self.noise = name in NOISE or self.named
        self.held, self.size = False, 0


def parse(page: str) -> Node:
    """A tolerant DOM: text is str, elements are Nodes; unknown or unclosed tags never fail."""
    root = Node("#page")
    stack, at = [root], 0
    while match := _TOKEN.search(page, at):
        if match.start() > at:
            stack[-1].children.append(page[at : match.start()])
        at = match.end()
        name = match[2]
        if name is None:
            if match[0].startswith("<![CDATA["):
                stack[-1].children.append(entities.escape(match[0][9:].removesuffix("]]>")))
            continue
        name = name.lower()
        if match[1]:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name), 0)
            # an inline end tag never closes a block around it
            if depth and (name in BLOCK or not any(n.name in BLOCK for n in stack[depth + 1 :])):
                del stack[depth:]
            continue
        if name in CLOSES_P or name == "li":
            _imply_ends(stack, name)
        node = Node(name, match[3])
        stack[-1].children.append(node)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            node.children.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
        elif name not in VOID and not match[3].rstrip().endswith("/"):
            stack.append(node)
    if at < len(page):
        stack[-1].children.append(page[at:])
    _spare(root)
    _mark_frames(root)
    return root


def _mark_frames(root: Node) -> None:
    """The style of an element around blocks tells what kinds of blocks these are."""
    stack = [root]
    while stack:
        node = stack.pop()
        inner = [c for c in node.children if isinstance(c, Node)]
        if blocks := {c.name for c in inner if c.name in BLOCK}:
            node.style += f"+{'.'.join(sorted(blocks))}"
        stack += inner


def _spare(root: Node) -> None:
    """Elements that only a name or a form makes noise are none if they hold a core, or most of the page's text.

    Most is over half of it, or more than stands outside all noise. Sizes leave out what a tag makes noise. Where a core
    with text stands outside, size spares nothing.
    """
    order, stack = [], [(root, None)]
    while stack:
        node, up = stack.pop()
        order.append((node, up))
        if not node.noise or (node.named and (node.name == "form" or node.name not in NOISE)):
            stack += [(c, node) for c in node.children if isinstance(c, Node)]
            node.size = sum(len(c.strip()) for c in node.children if isinstance(c, str))
    cores = set()
    for node, up in reversed(order):
        if up is not None:
            up.size += node.size
            if (node.core and not NOISE_NAMES.search(node.style.replace(".", " "))) or node in cores:
                cores.add(up)
    named = [n for n, _ in order if n.named and (n.name == "form" or n.name not in NOISE)]
    apart, within = False, set()
    for node, up in order:  # parents come first
        if up in within or (node.noise and node not in cores):
            within.add(node)
        else:
            apart = apart or (node.core and node.size > 0)
    for node in named:
        most = 2 * node.size > root.size and not (apart and node not in cores)
        node.held = node in cores and not most
        node.noise = not (most or node.held)
    hidden, outermost, within = 0, [], set()
    for node, up in order:
        if up in within:
            within.add(node)
        elif node.noise:
            within.add(node)
            outermost.append(node)
            hidden += node.size
    largest = max((n for n in outermost if n.size), key=lambda n: n.size, default=None)
    if largest is not None and largest.size > root.size - hidden and not apart:
        largest.noise = False


def _imply_ends(stack: list[Node], name: str) -> None:
    """An open paragraph ends at the next block, an open item at the next item of its list."""
    wanted = {"li"} if name == "li" else {"dt", "dd"} if name in ("dt", "dd") else set()
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].name == "p" or stack[k].name in wanted:
            del stack[k:]
            return
        if stack[k].name in BLOCK:
            return


def _key(*parts: object) -> int:
    """A hash as Spark's long."""
    return xxhash.xxh64_intdigest("\n".join(map(str, parts))) - 2**63


#: Path of the root; a path is known by the hash of its parent's and a style.
TOP = _key("")


def _walk(root: Node) -> Iterator[tuple[int, int, int, Node]]:
    """Path, parent's path, depth and node, of nodes whose importance is open: those not in a known branch of noise."""
    stack = [(TOP, 0, 0, root)]
    while stack:
        path, up, depth, node = stack.pop()
        yield path, up, depth, node
        stack += [(_key(path, c.style), path, depth + 1, c) for c in node.children if isinstance(c, Node) and not c.noise]


def _signature(node: Node) -> str:
    return " ".join(dict.fromkeys(c.style for c in node.children if isinstance(c, Node)))


def _sentences(node: Node) -> list[str]:
    """What a node says by itself, in lower case and without punctuation."""
    return [t for c in node.children if isinstance(c, str) for part in _SENTENCES(c.lower()) if (t := " ".join(_WORDS(part)))]


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and node: on how many pages it is, and how often a child style or a sentence was seen there.

    A node is known by a hash of host and path; its place in the tree comes with its own row only. ``clogc`` is the sum
    of c log c over pages, ``page`` one of the pages that show the node.
    """
    sums: dict[tuple, list] = defaultdict(lambda: [0.0, 0.0, 0.0])
    places: dict[int, tuple[str, int, int, int]] = {}
    types = {"node": pa.int64(), "at": pa.int64(), "kind": pa.string(), "feature": pa.int64(), "c": pa.float64(), "clogc": pa.float64(), "pages": pa.float64(), "site": pa.string(), "up": pa.int64(), "depth": pa.int64(), "page": pa.int64()}

    def flush() -> pa.RecordBatch:
        rows = [(*k, *v, *(places[k[0]] if k[2] == "node" else (None,) * 4)) for k, v in sums.items()]
        sums.clear()
        places.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types.values())], list(types))

    for b in batches:
        for k in range(b.num_rows):
            site, page, weight, digest = (b.column(i)[k].as_py() for i in range(4))
            said: dict[int, Counter] = defaultdict(Counter)
            styles: dict[int, set] = defaultdict(set)
            for path, up, depth, element in _walk(parse(page)):
                places[_key(site, path)] = (site, up, depth, digest)
                styles[path].add(_signature(element))
                said[path].update(_sentences(element))
            for path, shown in styles.items():
                node = _key(site, path)
                sums[node, path, "node", 0][2] += weight
                for style in shown:
                    s = sums[node, path, "style", _key(style)]
                    s[0] += weight
                    s[2] += weight
                for text, c in said[path].items():
                    s = sums[node, path, "text", _key(text)]
                    s[0] += weight * c
                    s[1] += weight * c * math.log(c)
                    s[2] += weight
            if len(sums) > HELD:
                yield flush()
    yield flush()


def _importance(nodes: dict[int, tuple[int, int, int, float, float]], others: dict[int, tuple[int, float]] | None = None) -> dict[int, float]:
    """Combined importance by path of one tree; a node is (parent, depth, styles, presentation, content).

    ``others`` has number and summed importance of the children of a path that only one page shows.
    """
    others = others or {}
    below: dict[int, list[int]] = defaultdict(list)
    for path, node in nodes.items():
        below[node[0]].append(path)
    out: dict[int, float] = {}
    for path, (_, _, styles, presentation, content) in sorted(nodes.items(), key=lambda n: -n[1][1]):
        number, total = others.get(path, (0, 0.0))
        if below[path] or number:
            weight = GAMMA**styles
            inner = (sum(out[c] for c in below[path]) + total) / (len(below[path]) + number)
            out[path] = max((1 - weight) * presentation + weight * inner, content)
        else:
            out[path] = content
    return out


def _nodes(features: DataFrame) -> DataFrame:
    """Pages, styles, presentation and content importance of nodes, from summed features."""
    is_style, is_text = F.col("kind") == "style", F.col("kind") == "text"
    texts = features.where(is_text)
    seen = texts.groupBy("at", "feature").agg(*(F.sum(c).alias(f"all_{c}") for c in ("c", "clogc", "pages")))
    repeated = seen.where("all_pages > 1.000001")
    entropy = F.greatest(F.lit(0.0), F.log("all_c") - F.col("all_clogc") / F.col("all_c"))
    even = F.coalesce(F.least(F.lit(1.0), entropy / math.log(SPREAD)), F.lit(0.0))  # on one page alone: none
    said = texts.join(repeated, ["at", "feature"], "left").groupBy("node", "at").agg(F.sum(F.col("pages") * (1 - even)).alias("own"), F.sum("pages").alias("said"))
    shared = said.groupBy("at").agg((F.sum("own") / F.sum("said")).alias("mean"))
    counted = features.where(~is_text).groupBy("node", "at").agg(
        F.sum(F.when(F.col("kind") == "node", F.col("pages"))).alias("n"),
        F.coalesce(F.sum(F.when(is_style, F.col("pages"))), F.lit(0.0)).alias("shown"),
        F.count_if(is_style).alias("styles"),
        F.coalesce(F.sum(F.when(is_style, F.col("pages") * F.log("pages"))), F.lit(0.0)).alias("style_clogc"),
        *(F.max(c).alias(c) for c in ("site", "up", "depth", "page")),
    )
    # styles of a page that share its weight with copies stay under one
    n, shown = F.col("n"), F.greatest(F.col("shown"), F.lit(1.0))
    presentation = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.log(shown) - F.col("style_clogc") / shown) / F.log(F.greatest(n, F.lit(2.0)))))
    content = F.when(F.col("said").isNull(), 0.0).otherwise((n * F.col("own") / F.col("said") + SHARED * F.col("mean")) / (n + SHARED))
    once = F.round(n, 6) <= 1
    joined = counted.join(said.join(shared, "at").drop("at"), "node", "left")
    return joined.select("site", F.col("at").alias("path"), "up", "depth", "page", "styles", F.when(once, 1.0).otherwise(presentation).alias("presentation"), F.when(once & F.col("said").isNull(), 1.0).otherwise(content).alias("content"), once.alias("once"))


def trees(pages: DataFrame, keep: float = KEEP) -> tuple[DataFrame, DataFrame]:
    """The hashes of paths under ``keep`` in ``pages(site, html)``, with their importance.

    First ``site, paths, importance`` of what two pages of a site or more show, then ``page, once, worth`` of what one
    page alone shows, by the page's ``xxhash64``.
    """
    pages = pages.withColumn("page", F.xxhash64("html"))
    copies = materialize(pages.groupBy("page").agg(F.count("*").alias("n")).where("n > 1"), "page-copies")
    side = F.broadcast(copies) if copies.count() <= BROADCAST else copies
    weighed = pages.join(side, "page", "left").select("site", "html", F.coalesce(1 / F.col("n"), F.lit(1.0)).alias("weight"), "page")
    seen = weighed.mapInArrow(_observe, "node long, at long, kind string, feature long, c double, clogc double, pages double, site string, up long, depth long, page long")
    sums = [F.sum(c).alias(c) for c in ("c", "clogc", "pages")]
    features = seen.groupBy("node", "at", "kind", "feature").agg(*sums, *(F.max(c).alias(c) for c in ("site", "up", "depth", "page")))
    nodes = materialize(_nodes(materialize(features, "features")), "style-nodes")
    # what one page alone shows only counts, so a row per site holds the paths of its layouts
    counted = nodes.where("once and depth > 0").groupBy("site", F.col("up").alias("path")).agg(F.count("*").alias("others"), F.sum("content").alias("total"))
    known = nodes.where("not once").drop("once", "page").unionByName(counted, allowMissingColumns=True)
    merged = known.groupBy("site").agg(F.collect_list(F.struct("path", "up", "depth", "styles", "presentation", "content", "others", "total")).alias("nodes"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = []
            for nodes in b.column(1).to_pylist():
                tree = {n["path"]: (n["up"], n["depth"], n["styles"], n["presentation"], n["content"]) for n in nodes if n["others"] is None}
                found = _importance(tree, {n["path"]: (n["others"], n["total"]) for n in nodes if n["others"] is not None})
                low.append({p: x for p, x in found.items() if x < keep})
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(x) for x in low], pa.list_(pa.int64())), pa.array([list(x.values()) for x in low], pa.list_(pa.float64()))], ["site", "paths", "importance"])

    once = nodes.where((F.col("content") < keep) & F.col("once")).groupBy("page").agg(F.collect_list("path").alias("once"), F.collect_list("content").alias("worth"))
    return merged.mapInArrow(weigh, "site string, paths array<bigint>, importance array<double>"), once


def _blocks(root: Node, importance: Mapping[int, float], keep: float, cores: set[Node]) -> list[str]:
    """Texts of the blocks whose importance, with what the cores of the page say beforehand, reaches ``keep``, in page order."""
    out: list[list[str]] = [[]]
    shift = CORE_BONUS if root in cores else -OUTSIDE if cores else 0.0
    stack = [(iter(root.children), TOP, False, importance.get(TOP, 1.0) + shift < keep, False)]
    while stack:
        children, path, core, low, block = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            if block:
                out.append([])
        elif isinstance(child, str):
            if not low:
                out[-1].append(child)
        elif child.name == "br":
            out[-1].append(" ")
        elif not child.noise and (child.name != "header" or core):
            where, inside = _key(path, child.style), core or child in cores
            if child.name in BLOCK:
                out.append([])
            # what matters below an unimportant node stays; in a core, running text is not torn apart
            if not inside or child.name in BLOCK:
                low = importance.get(where, 1.0) + (CORE_BONUS if inside else -OUTSIDE if cores else 0.0) < keep
            stack.append((iter(child.children), where, inside, low, child.name in BLOCK))
    return [t for parts in out if (t := " ".join(entities.unescape("".join(parts)).split()))]


def extract(page: str | None, importance: Mapping[int, float], keep: float = KEEP) -> str:
    """Main text of one page, given the importance of its site's paths by their hashes."""
    if not page:
        return ""
    root = parse(page)
    cores = _cores(root)
    inside = sum(node.size for node, _ in cores)
    if all(held for _, held in cores) and root.size - inside > inside:
        cores = []  # named like a list of related or of comments, and less than the rest
    return "\n\n".join(_blocks(root, importance, keep, {node for node, _ in cores}))


def _cores(root: Node) -> list[tuple[Node, bool]]:
    """Outermost cores, and whether an element named like noise holds them."""
    found, stack = [], [(root, False)]
    while stack:
        node, held = stack.pop()
        held = held or node.held
        if node.core:
            found.append((node, held))
        elif not node.noise:
            stack += [(c, held) for c in node.children if isinstance(c, Node)]
    return found


def _apply(keep: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[int, float]] = {}
        for b in batches:
            texts = []
            html, host, paths, values, once, worth = (b.column(b.schema.get_field_index(n)) for n in ("html", "site", "paths", "importance", "once", "worth"))
            for k in range(b.num_rows):
                name = host[k].as_py()
                if name not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[name] = dict(zip(paths[k].as_py() or [], values[k].as_py() or [], strict=True))
                own = dict(zip(once[k].as_py() or [], worth[k].as_py() or [], strict=True))
                texts.append(extract(html[k].as_py(), ChainMap(own, known[name]), keep))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def main_text(pages: DataFrame, keep: float = KEEP, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: ``page_id, url, text, n_chars``.

    ``text`` joins the blocks of the page's main part by two line feeds, with white space turned into single spaces
    and character references decoded; null and empty pages give ''. A url without a host is a host of its own name;
    repeated rows stay; other columns are ignored; malformed markup and very long pages are read to their end.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), host.alias("site"))
    merged, once = trees(rows.select("site", "html"), keep)
    merged, once = materialize(merged, "style-trees"), materialize(once, "style-pages")
    with_tree = rows.withColumn("page", F.xxhash64("html")).join(merged, "site", "left").join(once, "page", "left")
    with_tree = with_tree.select("page_id", "url", "html", "site", "paths", "importance", "once", "worth")
    id_type = rows.schema["page_id"].dataType.simpleString()
    out = with_tree.mapInArrow(_apply(keep), f"page_id {id_type}, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
