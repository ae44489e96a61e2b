import html
import math
import re

import pytest

from markcheck.llm import site_style


def article_of(page):
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1].replace("<br>", " ")
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:h1|p)\b[^>]*>", article)]
    return "\n\n".join(b for b in blocks if b)


def test_driver_pages_give_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    out = {r.page_id: r for r in site_style.main_text(pages).collect()}
    for row in pages.collect():
        assert out[row.page_id].text == article_of(row.html)
        assert out[row.page_id].n_chars == len(out[row.page_id].text) and out[row.page_id].url == row.url
    assert len(out) == pages.count()


def soup(k):
    body = " ".join(f"story{k}x{j}" for j in range(30))
    return f"<body><div class=top>Home About Contact Us</div><div class=x1><div class=t>Title{k}</div><p>{body}</p></div><div class=low>All rights reserved by us, read our terms</div></body>"


def test_style_tree_cuts_what_a_site_repeats(spark):
    rows = [(k, f"http://one.example/{k}", soup(k)) for k in range(20)]
    out = site_style.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    for r in out:
        assert r.text == f"Title{r.page_id}\n\n" + " ".join(f"story{r.page_id}x{j}" for j in range(30))


def test_small_sites_share_a_tree(spark):
    rows = [(k, f"http://s{k}.example/", soup(k)) for k in range(20)]
    out = site_style.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all("Contact" not in r.text and "rights" not in r.text and f"Title{r.page_id}" in r.text for r in out)


def test_markup_of_one_page():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header>
    <main><article><header><h1>A &amp; B</h1></header><p>one <b>two<br>three</p><p>four &lt;x&gt;&nbsp;five<div class="comments">Bob: hi</div>
    <ul><li>i1<li>i2</ul><script>var a="</p>";</script><form>f</form><!-- no --><p class="lead story">last</article></main><aside>side</aside></body>"""
    assert site_style.extract(page, {}) == "A & B\n\none two three\n\nfour <x> five\n\ni1\n\ni2\n\nlast"
    assert site_style.extract("", {}) == "" == site_style.extract(None, {})
    assert site_style.extract("plain  text", {}) == "plain text"
    assert site_style.extract("<p>a<p>b</div></p><a href='>'>c</a>", {}) == "a\n\nb\n\nc"


def test_edge_rows(spark):
    schema = "page_id long, url string, html string, site string, text string, paths string"
    assert site_style.main_text(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, "<p>x</p>", "s", "t", "p"), (2, "http://a", None, "s", "t", "p"), (None, "nohost", "", "s", "t", "p"), (1, None, "<p>x</p>", "s", "t", "p"), (3, "http://a", "<div>" * 3000 + "deep" + "<p>w </p>" * 20000, "s", "t", "p")]
    out = site_style.main_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id or 0, r.n_chars > 0) for r in out) == [(0, False), (1, True), (1, True), (2, False), (3, True)]


def test_tree_cuts_repeated_blocks_inside_a_core(spark):
    def page(k):
        story = " ".join(f"story{k}x{j}" for j in range(30))
        return f"<body><div>Home</div><article><h1>Title{k}</h1><p>{story} <a>as told</a> before</p><div class=x9><a>Tell your friends</a> or <p>read our next story</p></div><p>end{k}</p></article></body>"

    rows = [(k, f"http://one.example/{k}", page(k)) for k in range(20)]
    for r in site_style.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        story = " ".join(f"story{r.page_id}x{j}" for j in range(30))
        assert r.text == f"Title{r.page_id}\n\n{story} as told before\n\nend{r.page_id}"


def test_importance_does_not_depend_on_other_pages_and_hosts(spark):
    def page(host, k):
        story = " ".join(f"story{host}x{k}x{j}" for j in range(30))
        odd = "<div class=odd>Seen on some pages only</div>" if host == 99 and k < 8 else ""
        return f"<body><p>{story}</p><div class=own{host}>{host} brand words{host} again</div><div class=low>brand{host} terms{host}</div>{odd}</body>"

    rows = [(h * 1000 + k, f"http://h{h}.example/{k}", page(h, k)) for h in range(30) for k in range(5)]
    rows += [(99000 + k, f"http://h99.example/{k}", page(99, k)) for k in range(60)]
    rows += [(5, "http://copies.example/", "<p>the same page</p>")] * 4
    for r in site_style.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        host, k = divmod(r.page_id, 1000)
        assert r.text == ("the same page" if "copies" in r.url else " ".join(f"story{host}x{k}x{j}" for j in range(30)))


def test_frames_named_like_noise_keep_their_text():
    body = "<p>The story goes on for a while</p>"
    low = "<div class=footer>All rights</div>"
    for start, end in (("<body class='single no-sidebar'>", "</body>"), ("<body class=has-sidebar><main class=has-sidebar>", "</main></body>"), ("<div class='page menu-closed'>", "</div>"), ("<div class=header-fixed>", "</div>"), ("<form action=x>", "</form>"), ("<html class=has-header><body><form><div class=no-widget>", "</div></form></body></html>")):
        assert site_style.extract(start + body + low + end, {}) == "The story goes on for a while", start
        assert site_style.extract(f"{start}<article>{body}</article>{low}{end}", {}) == "The story goes on for a while", start
        assert site_style.extract(f"{start}<article class='no-share'>{body}</article>{low}{end}", {}) == "The story goes on for a while", start
    # less than half of the page, but more than what is no noise
    assert site_style.extract(f"<div class='text has-sidebar'>{body}</div><div class=sidebar>Some links of the site</div><div class=footer>All rights reserved</div>", {}) == "The story goes on for a while"
    assert site_style.extract(f"<div class=menu-closed><article>Short</article></div>{body * 3}<div class=comments><article class=comment>Bob</article></div>", {}).startswith("Short")
    # list of links stay out, however long
    assert site_style.extract("<nav>" + "<a>link to something</a>" * 20 + f"</nav>{body}", {}) == "The story goes on for a while"
    # cores named as related do not replace the text
    assert "goes on" in site_style.extract(f"{body * 3}<div class=related><article>Card</article></div>", {})


def brute_importance(sites):
    """Importance by host and path, and whether more than one page shows it, of pages by host, from the definition."""
    sites = {site: [site_style.parse(p) for p in dict.fromkeys(pages)] for site, pages in sites.items()}
    nodes, parents, said_at = {}, {}, {}
    for site, roots in sites.items():
        for k, root in enumerate(roots):
            for path, up, _, node in site_style._walk(root):
                parents[path] = up
                styles, texts = nodes.setdefault((site, path), {}).setdefault(k, (set(), []))
                styles.add(tuple(dict.fromkeys(c.style for c in node.children if not isinstance(c, str))))
                texts.extend(site_style._sentences(node))
                said_at.setdefault(path, {}).setdefault((site, k), texts)

    def entropy(counts):
        return -sum(c / sum(counts) * math.log(c / sum(counts)) for c in counts)

    def said(site, path):
        """For each page and sentence, how much the sentence says of it."""
        shown = said_at[path].values()
        spread = {t: entropy([c for texts in shown if (c := texts.count(t))]) for texts in shown for t in texts}
        return [1 - min(1, spread[t] / math.log(site_style.SPREAD)) for _, texts in nodes[site, path].values() for t in set(texts)]

    def content(site, path):
        own = said(site, path)
        if not own:
            return 1.0 if len(nodes[site, path]) == 1 else 0.0
        everywhere = [x for s in sites if (s, path) in nodes for x in said(s, path)]
        n = len(nodes[site, path])
        return (n * sum(own) / len(own) + site_style.SHARED * sum(everywhere) / len(everywhere)) / (n + site_style.SHARED)

    def importance(site, path):
        seen, own = nodes[site, path], content(site, path)
        below = [p for s, p in nodes if s == site and parents[p] == path]
        if not below or len(seen) == 1:
            return own
        shown = [style for styles, _ in seen.values() for style in styles]
        kinds = [shown.count(s) for s in set(shown)]
        weight = site_style.GAMMA ** len(kinds)
        inner = sum(importance(site, p) for p in below) / len(below)
        return max((1 - weight) * min(1.0, entropy(kinds) / math.log(len(seen))) + weight * inner, own)

    return {(s, p): (importance(s, p), len(shown) > 1) for (s, p), shown in nodes.items()}


def test_importance_equals_brute_force(spark):
    def page(k, extra=""):
        story = " ".join(f"story{k}x{j}." for j in range(9))
        extra += "<div class=rare><i>Now and then.</i></div>" if k % 4 == 0 else "<ul><li>a</li></ul>" if k % 3 else ""
        return f"<body><div class=top>Home. About us! Contact</div><div class=b{k % 2}><p>{story}</p>{extra}</div><div id=post-{k}123 class=low>All rights. Page {k % 5}.</div><b>once {k}</b></body>"

    sites = {"s": [page(k) for k in range(24)] + [page(3), page(3)], "t": [page(k) for k in range(50, 53)], "u": [page(90, "<p class=u>Home.</p><p class=v>Only here</p>")]}
    expected = brute_importance(sites)
    rows = [(s, p) for s, pages in sites.items() for p in pages]
    shown, alone = site_style.trees(spark.createDataFrame(rows, "site string, html string"), keep=2.0)
    mine = {(r.site, p): x for r in shown.collect() for p, x in zip(r.paths, r.importance, strict=True)}
    assert mine.keys() == {k for k, (_, several) in expected.items() if several}
    assert all(abs(mine[k] - expected[k][0]) < 1e-9 for k in mine)
    single = sorted(x for r in alone.collect() for x in r.worth)
    assert len(single) > 5 and all(abs(a - b) < 1e-9 for a, b in zip(single, sorted(x for x, several in expected.values() if not several), strict=True))


def plain_names(page, cores=True):
    """The page with elements and classes that tell no role."""
    page = re.sub(r"(</?)(?:nav|footer|aside)\b", r"\1div", page).replace('class="ad"', 'class="x"')
    return page if cores else re.sub(r"(</?)(?:article|main)\b", r"\1div", page)


@pytest.mark.parametrize("cores", [True, False])
def test_driver_pages_without_telling_names_need_the_tree(spark, cores):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    plain = [(r.page_id, r.url, plain_names(r.html, cores)) for r in pages]
    out = {r.page_id: r.text for r in site_style.main_text(spark.createDataFrame(plain, "page_id long, url string, html string")).collect()}
    assert out == {r.page_id: article_of(r.html) for r in pages}
    assert not any(site_style.extract(page, {}) == out[k] for k, _, page in plain)


def test_reprints_on_small_sites_stay(spark):
    def page(k):
        story = "reprint" if k % 3 == 0 else f"story{k}"
        return f"<body><div class=top>Home and Contact Us</div><p>{' '.join(f'{story}x{j}' for j in range(30))}</p><p>told by {k}</p></body>"

    rows = [(k, f"http://s{k}.example/", page(k)) for k in range(30)]
    for r in site_style.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        story = "reprint" if r.page_id % 3 == 0 else f"story{r.page_id}"
        assert r.text == " ".join(f"{story}x{j}" for j in range(30)) + f"\n\ntold by {r.page_id}"


def test_the_tree_finds_an_article_without_telling_names(spark):
    def page(k):
        story = "".join(f"<p>{' '.join(f'w{k}x{i}x{j}' for j in range(12))}.</p>" for i in range(3))
        return f"<div><a>Home</a><a>News</a></div><div><h2>Title {k}</h2>{story}</div><div><p>Write to us.</p><p>All rights reserved.</p></div>"

    rows = [(k, f"http://plain.example/{k}", page(k)) for k in range(20)]
    for r in site_style.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        k = r.page_id
        assert r.text == "\n\n".join([f"Title {k}", *(" ".join(f"w{k}x{i}x{j}" for j in range(12)) + "." for i in range(3))])
