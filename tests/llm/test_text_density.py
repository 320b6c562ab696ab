import html
import math
import random
import re

import pytest

from thriftline.llm import text_density as td

SCHEMA = "page_id long, html string, text int, row string"
LONG = "A sentence of the article that goes on for quite a while, with commas, and then it ends. " * 4
MENU = "<ul>" + "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(8)) + "</ul>"


@pytest.mark.parametrize("page, text", [
    ("", ""), ("just text", "just text"), ("<html><body></body></html>", ""), ("a < b & c &lt; d", "a < b & c < d"),
    (f"<body><nav>{MENU}</nav><article><h1>Title</h1><p>{LONG}<p>Short.</article><footer>x</footer>", f"Title {LONG}Short."),
    (f"<div id=menu>{MENU}</div><div class=content><h2>Head</h2><p>{LONG}</p><p>{LONG}</p></div><div class='side-bar sidebar'>{LONG}</div>",
     f"Head {LONG}{LONG}".strip()),
    (f"<article><p>{LONG}</p><section class='comments'><p>{LONG} I disagree.</p></section></article>", LONG.strip()),
    (f"<main><section><p>{LONG}</p><p>{LONG}</p></section><section><h2>Two</h2><p>{LONG}</p></section></main>", f"{LONG}{LONG}Two {LONG}".strip()),
    (f"<article><script>var x = '<p>no</p>';</script><style>p{{}}</style><p>in<b>line</b> &amp;&#233;&nbsp;x<br>next</p></article>", "inline &é x next"),
    (f"<article><form>{LONG}</form><div class='cookie-notice'>{LONG}</div><p>kept</p><aside>{LONG}</aside></article>", "kept"),
    ("<article><p>broken off <b>in the mid", "broken off in the mid"), ("<article><p>broken tag <a href='x", "broken tag"),
    ("<article><p>one<!-- <p>hidden</p> --> two</p><!-- open", "one two"), ("<article><div hidden>no</div><div style='display: none'>no</div>yes", "yes"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table></article>", "a b c d e"),
    ("<article><p title='a > b'>attribute</p></article>", "attribute"), ("<p>x</p></div></p></b>y", "x y"),
])
def test_pages(page, text):
    assert td.main_text(page) == text


@pytest.mark.parametrize("page, text", [
    (f"<body><form action='/'><nav>{MENU}</nav><article><h1>Title</h1><p>{LONG}</p></article></form></body>", f"Title {LONG}".strip()),
    (f"<body><form><h2>Title</h2><div><p>{LONG}</p><p>{LONG}</p></div></form></body>", f"Title {LONG}{LONG}".strip()),
    (f"<body style='display:none'><article><p>{LONG}</p></article></body>", LONG.strip()),
    (f"<body><nav>{MENU}<article><h1>Title</h1><p>{LONG}</p></article>", f"Title {LONG}".strip()),
    (f"<main><article><p>{LONG}</p></article><article><p>{LONG}{LONG}</p></article></main>", (LONG * 3).strip()),
    (f"<main><article><p>{LONG}{LONG}</p></article><article><h3><a href=/>Next</a></h3><a href=/><img></a><p><a href=/>More</a></p></article></main>",
     f"{LONG}{LONG}".strip()),
    (f"<article><p>{LONG}</p></article><div class=related><article><p>{LONG}{LONG}{LONG}</p></article></div>", LONG.strip()),
    (f"<article><header><h1>Title</h1></header><p>{LONG}</p><header>Share this</header><form>{LONG}</form></article>", f"Title {LONG}".strip()),
    (f"<header><h1>Site</h1></header><article><p>{LONG}</p></article>", LONG.strip()),
    (f"<header><h1>Site</h1></header><form>{LONG}</form><div><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG}{LONG}".strip()),
    (f"<article><p>{LONG}</p></article><aside><article>{LONG}{LONG}</article></aside><footer><article>{LONG}{LONG}</article></footer>", LONG.strip()),
])
def test_wrapped_and_neighbouring_articles(page, text):
    assert td.main_text(page) == text


def grown(source, depth=0):
    """A random tree: (name, children), children being trees and texts."""
    name = "body" if depth == 0 else source.choice(["div", "p", "section", "a", "b"] if depth < 4 else ["a", "b"])
    if name in ("p", "a", "b"):
        return name, ["".join(source.choice("abcdef") for _ in range(source.randint(1, 60)))]
    children = [grown(source, depth + 1) for _ in range(source.randint(1, 4))]
    return name, [*children, *["own" * source.randint(1, 3)] * source.randint(0, 1)]


def counted(node):
    """Characters, tags, characters in links and links below a node, gathered anew for every node."""
    inside, todo = [], [(c, node[0] == "a") for c in node[1]]
    while todo:
        c, link = todo.pop()
        inside.append((c, link))
        if not isinstance(c, str):
            todo += [(x, link or c[0] == "a") for x in c[1]]
    texts = [(len(c), link) for c, link in inside if isinstance(c, str)]
    return (sum(n for n, _ in texts), sum(not isinstance(c, str) for c, _ in inside), sum(n for n, link in texts if link),
            sum(not isinstance(c, str) and c[0] == "a" for c, _ in inside))


def written_density(node, body):
    c, t, lc, lt = counted(node)
    bc, _, blc, _ = counted(body)
    if c == 0:
        return 0.0
    scale = 1.0
    if lc:
        scale = math.log(c / lc * max(t, 1) / max(lt, 1)) / math.log(c / max(c - lc, 1) * lc + blc / bc * c + math.e)
    return c / max(t, 1) * min(1.0, max(0.0, scale))


def test_densities_sums_and_threshold_against_a_slow_version():
    """Every node's density, the largest sum, the path's threshold and what reaches it, from the tree that made the page."""
    source = random.Random(5)
    decided = 0
    for _ in range(300):
        body = grown(source)
        html_of = lambda n: n if isinstance(n, str) else f"<{n[0]}>" + "".join(map(html_of, n[1])) + f"</{n[0]}>"
        every, parent, todo = [], {}, [body]
        while todo:  # page order
            n = todo.pop()
            every.append(n)
            for c in reversed([c for c in n[1] if not isinstance(c, str)]):
                parent[id(c)] = n
                todo.append(c)
        tags = lambda n: [c for c in n[1] if not isinstance(c, str)]
        value = {id(n): sum(written_density(c, body) for c in tags(n)) + sum(len(c) for c in n[1] if isinstance(c, str)) for n in every}
        best = max(every, key=lambda n: value[id(n)])
        path = [best]
        while id(path[-1]) in parent:
            path.append(parent[id(path[-1])])
        least = min(written_density(n, body) for n in path) / 2
        kept = {id(best)} | {id(c) for below, above in zip(path, path[1:]) for c in tags(above) if c is not below and written_density(c, body) >= least}
        decided += len(kept) > 1

        def shown(n, whole):
            if isinstance(n, str):
                return n if whole else " "
            own = "".join(shown(c, whole or id(n) in kept) for c in n[1])
            return f" {own} " if n[0] not in ("a", "b") else own

        assert td.main_text(html_of(body)) == " ".join(shown(body, False).split())
    assert decided > 50


def test_deep_and_long_pages():
    assert td.main_text("<div>" * 20_000 + "deep") == "deep"
    words = "word " * 400_000
    assert td.main_text(f"<article><p>{words}</p></article>") == words.strip()
    assert td.main_text("<" * 50_000) == "<" * 50_000
    assert len(td.main_text('<a href="' * 3000)) < 30_000


def test_given_pages(spark, sf_dir):
    """The article elements of the given pages, taken apart by regular expressions."""
    out = td.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    for r in out.collect():
        inside = re.search(r"<article>(.*?)(</article>|<footer|\Z)", r["html"], re.S)[1]
        plain = re.sub(r"<[^>]*>?", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", inside))
        assert r["text"] == " ".join(html.unescape(plain).split()) and r["n_chars"] == len(r["text"])


def test_columns_and_nulls(spark):
    rows = [(1, None, 1, "r"), (2, "<p>x</p>", 1, "r"), (2, "<p>x</p>", 1, "r")]
    out = td.extract(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["page_id", "html", "row", "text", "n_chars"]
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in out.collect()) == [(1, "", 0), (2, "x", 1), (2, "x", 1)]
    assert td.extract(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("wrapper", [
    "class='layout has-sidebar'", "id='post-1' class='post comments-open'", "class='content-with-sidebar'", "class='page header-fixed'",
    "class='sidebar'", "id=comments",
])
@pytest.mark.parametrize("inner", [
    f"<article><h1>Title</h1><p>{LONG}</p></article>", f"<main><h1>Title</h1><p>{LONG}</p></main>", f"<h2>Title</h2><p>{LONG}</p><p>{LONG}</p>"])
def test_wrappers_of_the_article_stay(wrapper, inner):
    menu, advert = f"<div class='nav-menu'>{MENU}</div>", "<div class='ad-banner'>Buy this</div>"
    text = re.sub(r"<[^>]*>", " ", inner)
    assert td.main_text(f"<body>{menu}<div {wrapper}>{inner}{advert}</div><div class=footer>end</div>") == " ".join(text.split())


def test_listed_containers_without_the_content_go():
    page = f"<div class=post><p>{LONG}</p><p>{LONG}</p></div><div class='widget share'><p>{LONG}</p></div>"
    assert td.main_text(page) == f"{LONG}{LONG}".strip()
    assert td.main_text(f"<article>a<span class=ad>x</span>b<div class=ad>y</div>c<p>{LONG}</p></article>") == f"ab c {LONG}".strip()
