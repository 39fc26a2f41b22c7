import html
import math
import random
import re
import time

import pytest

from keyloom.llm import html_text as h

from .helpers import CLASHING
from pyspark.sql import functions as F


def text(source):
    return h.main_text(source, set())


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("", ""),
        ("<p>a<p>b", "a\nb"),
        ("<body><nav>menu</nav><p>a &amp; b&lt;&eacute;&#233;&#xe9; &nbsp;c</p><footer>f</footer>", "a & b<ééé c"),
        ("<article><h1>T</h1><p><b>one<br>two\n  three<p>four</article>", "T\none two three\nfour"),
        ("<script>var a='<p>no</p>'</script><style>p{}</style><!-- <p>no</p> --><p>yes", "yes"),
        ("<article><p>a<ul><li>1<li>2</ul><blockquote>q</blockquote><pre>x  y</pre></article>", "a\n1\n2\nq\nx y"),
        ("<main><p>m</p></main><p>outside", "m"),
        ("<div class='page-sidebar'>s</div><div class='content'><p>c</p></div>", "c"),
        ("<div class='has-sidebar'><article><p>kept</p><div id='comments'><p>no</p></div><form>f</form></article></div>", "kept"),
        ("<aside><article>no</article></aside><article>yes</article>", "yes"),
        ("<article>one</article><article>two</article>", "one\ntwo"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a\nb\nc"),
        ("<p>1 < 2 and 3 > 2 <", "1 < 2 and 3 > 2 <"),
        ("<p title=\"a > b\">x</p><p title='>'>y</p>", "x\ny"),
        ("<p>broken <a href=\"x", "broken"),
        ("<p>open comment <!-- never closed", "open comment"),
        ("text only &am &amp", "text only &am &"),
        ("<div role=navigation>n</div><div role='main'>m</div>", "m"),
        ("<article><header>by x</header><p>p</p></article>", "p"),
        ("<p>a</p></div></p></b><p>b", "a\nb"),
        ("<noscript>n</noscript><textarea><p>t</p></textarea><title>t</title><p>x", "x"),
        ("<ARTICLE><P>Up</P></ARTICLE>", "Up"),
    ],
)
def test_literal_pages(source, want):
    assert text(source) == want


def test_linear_on_awkward_sources():
    began = time.time()
    for s in ("<" * 100_000, "<div>" * 50_000 + "x", '<a b="' * 50_000, "</p>" * 50_000, "<p>a" * 50_000, "<!--" * 50_000, "&" * 100_000, "<script>" * 20_000):
        text(s)
    assert time.time() - began < 20


def pages_of(spark, rows):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    return df.select("*", *(F.lit(1).alias(c) for c in [*CLASHING, "host", "path", "templates", "salt", "text"]))


def site(n, host="shop.example.net", article=lambda i: f"<div class='body'>Own text of page {i}, which no other has.</div>"):
    return [(i, f"https://{host}/p/{i}", f"<html><body><div class='top'><span>Welcome</span> to our shop</div>{article(i)}<div class='tail'>Visit our shop again</div></body></html>") for i in range(n)]


def test_templates_of_a_host_go_by_entropy(spark):
    rows = site(12) + [(100, "https://other.example.net/", site(1)[0][2]), (101, None, None), (101, None, None), (None, "no scheme", "<p>x")]
    got = {}
    for r in h.extract(pages_of(spark, rows)).collect():
        got.setdefault(r["page_id"], []).append((r["text"], r["n_chars"], r["url"]))
    for i in range(12):
        own = f"Own text of page {i}, which no other has."
        assert got[i] == [(own, len(own), f"https://shop.example.net/p/{i}")]
    assert got[100][0][0] == "Welcome to our shop\nOwn text of page 0, which no other has.\nVisit our shop again"  # one page tells nothing
    assert got[101] == [("", 0, None)] * 2 and got[None] == [("x", 1, "no scheme")]


def test_copies_of_a_page_are_no_template(spark):
    rows = site(20, article=lambda i: "<div class='body'>The same story on all pages.</div>")
    assert {r["text"] for r in h.extract(pages_of(spark, rows)).collect()} == {"Welcome to our shop\nThe same story on all pages.\nVisit our shop again"}


def test_importance_values(spark):
    rows = h.importance(pages_of(spark, site(16)).withColumn("host", F.lit("x"))).collect()
    by = {r["path"]: (r["pages"], round(r["importance"], 6)) for r in rows}
    assert by[h.hash64("/body/div.top")] == (16, 0.0) and by[h.hash64("/body/div.body")] == (16, 0.7)


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    want = sorted(map(tuple, h.extract(pages_of(spark, site(12))).collect()))
    monkeypatch.setattr(h, "BROADCAST_ROWS", -1)
    assert sorted(map(tuple, h.extract(pages_of(spark, site(12))).collect())) == want


def test_given_pages(spark, sf_dir):
    def plain(source):
        m = re.search(r"<article>(.*?)</article>", source, re.S)
        parts = re.split(r"</?(?:p|h1)>", m[1])
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", "\n"))).split()) for b in parts]
        return "\n".join(x for x in parts if x)

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r["page_id"]: plain(r["html"]) for r in pages.collect()}
    got = h.extract(pages).collect()
    assert {r["page_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)
    assert h.extract(pages.filter("false")).count() == 0


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<article><h1>T</h1><p>a</p><section id='discussion'><p>We discuss.</p></section><div class='market-share'>Share of 5 %</div></article>", "T\na\nWe discuss.\nShare of 5 %"),
        ("<article class='card'><p>A teaser text.</p></article><div class='content'><p>The real body, which is much longer than the teaser.</p><p>And more.</p></div>", "The real body, which is much longer than the teaser.\nAnd more."),
        ("<main><h1>Title</h1><p>lead</p><article><p>body of it</p></article><p>after</p></main>", "Title\nlead\nbody of it"),
        ("<article><p>a</p><div class='ad-hoc'>kept</div><div class='site-ad'>no</div><div id='reader-comments'>no</div><div class='cookie-recipe'>kept too</div></article>", "a\nkept\nkept too"),
        ("<body><p>text</p><div class='related'><a href=x>one</a> <a href=y>two</a></div></body>", "text"),
    ],
)
def test_names_are_no_more_than_a_prior(source, want):
    assert text(source) == want


def renamed(k, i):
    """A page whose parts have no telling names, tags or roles; only what repeats over the host tells them."""
    return f"""<html><body><div class="x1"><a href=a>Home</a> <a href=b>News</a></div><div class="x2"><p>We use small files to remember you on {k}.</p></div>
      <div class="x3"><h1>Headline {k} {i}</h1><p>First paragraph {k} {i} about {"abc"[i % 3]}.</p><div class="x4"><p>Discussion {k} {i} in more words.</p></div></div><p>Made by the people of {k}</p><div class="x5">All rights {k}</div></body></html>"""


def slow_tree(pages):
    """Importances by host and path by plain loops; paths are tuples, contents are texts."""
    by = {}
    for host in {p[1] for p in pages}:
        seen = {}
        for _, source in {(h.main_text(s, set()), s) for _, at, s in pages if at == host}:
            own = h.main_text(source, set())

            def visit(node, path, inside):
                words = []
                for c in node.children:
                    if isinstance(c, str):
                        words += [" ".join(c.split())] if c.split() else []
                    else:
                        words += visit(c, (*path, c.tag + "." + c.names), inside or c.tag in ("article", "main"))
                seen.setdefault(path, set()).add((own, tuple(c.tag for c in node.children if not isinstance(c, str)), tuple(words)))
                return words

            visit(h.parse(source), (), False)
        for path, rows in seen.items():
            out = []
            for k in (1, 2):
                n = {}
                for r in rows:
                    n[r[k]] = n.get(r[k], 0) + 1
                m = len(rows)
                out.append(-sum(c / m * math.log(c / m) for c in n.values()) / math.log(m) if m > 1 else 1.0)
            by[host, path] = len(rows), 0.3 * out[0] + 0.7 * out[1]
    return by


def test_only_the_tree_tells_renamed_templates(spark):
    rows = [(100 * k + i, f"https://h{k}.example.org/{i}", renamed(k, i)) for k in range(3) for i in range(9)]
    got = {r["page_id"]: r["text"] for r in h.extract(pages_of(spark, rows)).collect()}
    for page, _, source in rows:
        k, i = divmod(page, 100)
        assert got[page] == f"Headline {k} {i}\nFirst paragraph {k} {i} about {'abc'[i % 3]}.\nDiscussion {k} {i} in more words."
        assert text(source) != got[page]  # names and tags alone leave the templates in


def test_importance_equals_a_slow_version(spark):
    rng = random.Random(5)
    part = lambda: rng.choice(["<div class='a'>one</div>", "<div class='a'>two <b>three</b></div>", "<div class='b'><div class='c'>x</div><span class='d'>y</span></div>", f"<div class='b'>{rng.randrange(6)}</div>", f"<ul><li>{rng.randrange(3)}</ul>"])
    rows = [(i, f"https://h{i % 2}.example.org/{i}", "<body>" + "".join(part() for _ in range(rng.randrange(1, 5))) + f"<p>{i}</p></body>") for i in range(30)]
    want = slow_tree([(i, u.split("/")[2], s) for i, u, s in rows])
    got = {(r["host"], r["path"]): (r["pages"], r["importance"]) for r in h.importance(pages_of(spark, rows).withColumn("host", h.split_url()[0])).collect()}
    same = 0
    for (host, path), (m, value) in want.items():
        key = host, h.hash64("/" + "/".join(x.rstrip(".") for x in path))
        if path and key in got:
            same += 1
            assert got[key][0] == m and abs(got[key][1] - value) < 1e-9
    assert same == len(got) > 8


def test_deep_and_wide_pages_are_linear(spark):
    began = time.time()
    deep = ["<div class=a>" * 50_000 + "deep text", "<div>" * 30_000 + "</p>" * 30_000 + "x", "<b>" * 30_000 + "</section></i>" * 10_000 + "y", "<div class=w>z</div>" * 30_000]
    got = {r["page_id"]: r["text"] for r in h.extract(pages_of(spark, [(k, "https://deep.example.org/", s) for k, s in enumerate(deep)])).collect()}
    assert got[0] == "deep text" and got[1] == "x" and got[2] == "y" and got[3].count("z") == 30_000
    assert time.time() - began < 60
