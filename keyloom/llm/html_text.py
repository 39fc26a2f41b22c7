"""Main text of pages: page trees, a style tree for each host, and entropy of its branches.

1. Each page is parsed to a tree (unclosed and stray tags are repaired, comments, scripts and styles are left out). A branch is
   known by its style path: tags with their class names from the body down, hashed step by step; its content by a hash of what is
   below, made from the leaves up. Both are linear in the page, however deep it is.
2. Style tree: trees of one host are merged by path. At each path two distributions over its pages are kept: of presentation
   (the sequence of child tags) and of content. Their entropies, divided by the largest possible, are the branch's presentation and
   content importance: near 0 if all pages show the same, 1 if each page has its own. A content node (a path with one content) has
   the importance -log(its share of the pages) / log(pages). Pages of a host
   with the same main text count once, so copies of a page don't make its text look like a template.
3. A branch goes from every page of the host if its weighted importance is under LEAST on LEAST_PAGES pages or more; outside the
   article a content node goes under the same bound. Names (HINTS) are a prior: a branch so called goes below LEAST_HINTED, or if it is mostly
   links; where its host has too few pages to tell, it goes outside the article and stays inside. Menus, headers, footers, sidebars,
   notices, adverts, forms and reader comments that are marked as such by tag, role or a class or id that says nothing else go
   whatever their importance: on hosts whose menus or comments differ on every page, entropy can't tell.
4. The article's blocks make the text, with the headings and paragraphs that stand before it in the main element. An article that
   is a teaser (called so, or a small part of the page's own text) does not take the place of the page's text. Without an
   article it is the main element, or the page.

Only hashes of paths and contents, summed in each batch first, move between machines, never texts. The branches to remove are
broadcast by host while there are at most BROADCAST_ROWS of them, beyond that joined with salt, so a host on a third of all pages
is dealt to many tasks.

Defined results: null html is empty; a page without blocks has the text "" and n_chars 0. A null url, or one without "://",
is a page of the host "". Very long and very deep pages are read whole. Rows that repeat are each answered. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import Workspace, map_batches, texts
from keyloom.llm.url_filter import split_url

LEAST, LEAST_HINTED, LEAST_PAGES, CONTENT_WEIGHT = 0.3, 0.5, 5, 0.7
#: Share of a branch's text in links that makes it mostly links; parts of the page's text under which an article is a teaser.
LINKS, TEASER, CALLED_TEASER = 0.5, 0.2, 0.5
BROADCAST_ROWS = 200_000
SALT = 64

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that never hold article text.
NOISE_TAGS = frozenset("script style head nav header footer aside form noscript template iframe object embed svg math canvas audio video button select option input textarea menu dialog title".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: A class name or id marks noise if it has a word of NOISE_WORDS and otherwise only words of these three lists. With a word of HINTS
#: instead it is a hint.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements adbox sponsor sponsored sponsors cookie cookies consent gdpr newsletter sidebar nav navbar navigation menu menus submenu breadcrumb breadcrumbs footer header masthead "
    "comment comments commentlist disqus notice notices topnav mainnav subnav navlinks skiplink skiplinks".split()
)
HINTS = frozenset("promo promotion banner notification popup modal overlay subscribe subscription aside respond reply replies responses discussion share sharing social related pagination pager toolbar widget widgets login signup alert topbar colophon copyright imprint card teaser".split())
NEUTRAL = frozenset("main site page top bottom left right list area box block section wrapper wrap container bar inner outer content post entry primary secondary global links link item items slot unit row col column region panel group the my js id reader readers user users".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that are text themselves: no template is found among them.
PLAIN = frozenset("html body article main p h1 h2 h3 h4 h5 h6 b i em strong a span blockquote pre code li br td th tr tbody q cite small sub sup u s mark".split())
#: A start tag of the key closes an open element of the value, up to the nearest of its bounds.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
CLOSE_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "legend"} | {"li"}
P_BOUNDS = frozenset("table td th caption button object html body article section div blockquote li".split())

TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"(?i)(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    """noisy: marked as noise; hinted: called like noise; holds: has an article in it, or is one; text and linked: characters below."""

    __slots__ = ("tag", "names", "noisy", "hinted", "children", "path", "content", "holds", "text", "linked")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.names, self.noisy, self.hinted, self.children = tag, "", tag in NOISE_TAGS, False, []
        self.path = self.content = self.text = self.linked = 0
        self.holds = tag in ("article", "main")
        if "=" in attributes:
            for key, *values in ATTRIBUTE.findall(attributes):
                value = html.unescape(next((v for v in values if v), ""))
                if key.lower() == "class":
                    self.names = ".".join(sorted(set(value.split())))
                if key.lower() == "role":
                    self.noisy |= value.strip().lower() in NOISE_ROLES
                elif tag not in ("html", "body", "main"):
                    for name in value.split():
                        words = {w.lower() for w in NAME_WORD.findall(name)}
                        if words <= NOISE_WORDS | HINTS | NEUTRAL:
                            self.noisy |= bool(words & NOISE_WORDS)
                            self.hinted |= bool(words & HINTS)


def parse(source: str) -> Node:
    """The tree of a page. Children are nodes and decoded strings."""
    root = Node("html")
    stack, at, size = [root], 0, len(source)
    opened: Counter[str] = Counter()

    def drop(k: int) -> None:
        opened.subtract(x.tag for x in stack[k:])
        del stack[k:]

    def close(tags: set[str] | frozenset[str], bounds: set[str] | frozenset[str]) -> None:
        if not any(opened[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                drop(k)
                return
            if stack[k].tag in bounds:
                return

    while at < size:
        i = source.find("<", at)
        if i < 0:
            i = size
        if i > at:
            stack[-1].children.append(html.unescape(source[at:i]))
        if i == size:
            break
        follows = source[i + 1 : i + 2]
        if follows in ("!", "?"):
            if source.startswith("<!--", i):
                end = source.find("-->", i + 4 if not source.startswith("<!-->", i) else i + 2)
                at = size if end < 0 else end + 3
            else:
                end = source.find(">", i)
                at = size if end < 0 else end + 1
            continue
        m = TAG.match(source, i) or LOOSE_TAG.match(source, i) if follows == "/" or follows.isascii() and follows.isalpha() else None
        if m is None:
            if follows == "/" or follows.isascii() and follows.isalpha():  # a tag that the page breaks off in, or </ and no name
                end = source.find(">", i)
                at = size if end < 0 else end + 1
            else:
                stack[-1].children.append("<")
                at = i + 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if not opened[tag]:
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    drop(k)
                    break
                if tag not in BLOCKS and stack[k].tag in BLOCKS:  # a stray inline end tag closes no block
                    break
            continue
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in CLOSE_P:
            close({"p"}, P_BOUNDS)
        if tag == "html":
            continue
        node = Node(tag, m[3])
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(f"(?i)</{re.escape(tag)}(?=[\\s/>])").search(source, at)
            if tag not in NOISE_TAGS:
                node.children.append(source[at : end.start() if end else size])
            if end is None:
                at = size
            else:
                close_at = source.find(">", end.end())
                at = size if close_at < 0 else close_at + 1
        elif tag not in VOID and not m[3].endswith("/") or tag in BLOCKS and tag != "hr":
            stack.append(node)
            opened[tag] += 1
    return root


M64 = (1 << 64) - 1


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def mixed(a: int, b: int) -> int:
    """Two 64-bit numbers as one."""
    x = (a * 0x9E3779B97F4A7C15 + b) & M64
    x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & M64
    return x ^ x >> 29


_STEPS: dict[str, int] = {}


def step(path: int, name: str) -> int:
    """The path one branch further down."""
    if name not in _STEPS:
        if len(_STEPS) > 100_000:
            _STEPS.clear()
        _STEPS[name] = xxhash.xxh3_64_intdigest(name.encode("utf-8", "surrogatepass"))
    return mixed(path, _STEPS[name])


def hash64(path: str) -> int:
    """The hash of a path that is written out."""
    out = 0
    for name in path.split("/")[1:]:
        out = step(out, name)
    return signed(out)


def annotate(page: Node) -> list[Node]:
    """Paths from the root down; contents, text sizes and holds from the leaves up. All nodes, parents before children."""
    order, todo = [], [page]
    while todo:
        x = todo.pop()
        order.append(x)
        for c in x.children:
            if type(c) is Node:
                c.path = step(x.path, f"{c.tag}.{c.names}" if c.names else c.tag)
                todo.append(c)
    for x in reversed(order):
        content = 0
        for c in x.children:
            if type(c) is Node:
                content = mixed(content, c.content) if c.content else content
                x.holds |= c.holds
                x.text += c.text
                x.linked += c.linked
            elif words := c.split():
                joined = " ".join(words)
                content = mixed(content, xxhash.xxh3_64_intdigest(joined.encode("utf-8", "surrogatepass")))
                x.text += len(joined)
        x.content = content
        if x.tag == "a":
            x.linked = x.text
    return order


def mostly_links(x: Node) -> bool:
    return x.text > 0 and x.linked >= LINKS * x.text


class Templates:
    """What a host's style tree says: paths to remove, content nodes to remove, paths of hinted branches to keep. One set of numbers."""

    def __init__(self, found: set[int]) -> None:
        self.found = found

    def gone(self, x: Node, inside: bool) -> bool:
        if x.noisy:
            return True
        if x.holds:
            return False
        if signed(x.path) in self.found and (x.names or x.tag not in PLAIN):
            return True
        if x.hinted and (mostly_links(x) or not inside and signed(mixed(x.path, 1)) not in self.found):
            return True
        return not inside and bool(self.found) and x.content != 0 and signed(mixed(x.path, x.content)) in self.found


def blocks(roots: list[Node], templates: Templates, skipped: list[Node] = ()) -> list[str]:
    """Texts of the blocks below the roots, in page order, without what goes and what is skipped."""
    out, now, skip = [], [], {id(x) for x in skipped}

    def end() -> None:
        if now and (s := " ".join("".join(now).split())):
            out.append(s)
        now.clear()

    for root in roots:
        todo: list[tuple[Node | str | None, bool]] = [(root, False)]
        while todo:
            x, inside = todo.pop()
            if type(x) is str:
                now.append(x)
            elif x is None:
                end()
            elif x.tag == "br":
                now.append("\n")
            elif x is root or not (id(x) in skip or templates.gone(x, inside)):
                inside |= x.tag in ("article", "main")
                if x.tag in BLOCKS:
                    end()
                    todo.append((None, inside))
                todo += [(c, inside) for c in reversed(x.children)]
        end()
    return out


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 p".split())


def before(main: Node, article: Node) -> list[Node]:
    """Headings and paragraphs of the main element that stand before its article."""
    out, todo = [], list(reversed(main.children))
    while todo:
        x = todo.pop()
        if x is article:
            break
        if type(x) is Node and not x.noisy:
            if x.tag in HEADINGS:
                out.append(x)
            elif x.holds:
                todo += reversed(x.children)
    return out


def outermost(page: Node, tag: str, strict: bool) -> list[Node]:
    found, todo = [], [page]
    while todo:
        x = todo.pop()
        if x.tag == tag and not (x.noisy and strict):
            found.append(x)
        elif x is page or x.holds and not (x.tag in NOISE_TAGS or strict and x.noisy):
            todo += [c for c in reversed(x.children) if type(c) is Node]
    return found


def text_blocks(page: Node, templates: Templates) -> list[str]:
    """The blocks of a page that is annotated."""
    for strict in (True, False):
        if found := outermost(page, "article", strict):
            main = next((m for m in outermost(page, "main", True) if m.holds and any(a is found[0] for a in outermost(m, "article", strict))), None)
            if main is not None and found[0] is not main:
                found = [*before(main, found[0]), *found]
            own = blocks(found, templates)
            called = [x for x in found if x.tag == "article" and x.hinted]
            whole = blocks([main or page], templates, called)
            share = TEASER if len(called) < sum(x.tag == "article" for x in found) else CALLED_TEASER
            return whole if sum(map(len, own)) < share * sum(map(len, whole)) else own
        if found := outermost(page, "main", strict):
            return blocks(found, templates)
    return blocks([page], templates)


BRANCH, HINTED, TEXT = 0, 1, 2


def branches(source: str) -> list[tuple[int, int, int, int, int]]:
    """Of each branch that can go: path, kind, the page's main text (a hash), presentation, content."""
    page = parse(source)
    order = annotate(page)
    own, out, inside = signed(xxhash.xxh3_64_intdigest("\n".join(text_blocks(page, Templates(set()))).encode("utf-8", "surrogatepass"))), set(), set()
    for x in order:
        within = id(x) in inside or x.tag in ("article", "main")
        if within:
            inside.update(id(c) for c in x.children if type(c) is Node)
        if x is page or x.holds or x.noisy:
            continue
        kind = HINTED if x.hinted else BRANCH if x.names or x.tag not in PLAIN else TEXT
        if kind != TEXT or not within:
            shown = 0
            for c in x.children:
                if type(c) is Node:
                    shown = step(shown, c.tag)
            out.add((signed(x.path), kind, own, signed(shown), signed(x.content)))
    return list(out)


def style_tree(pages: DataFrame) -> DataFrame:
    """host, path, kind, shown, content and c, the number of the host's different pages that have them."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen = {(host, *b) for host, source in zip(batch.column("host").to_pylist(), texts(batch, "html"), strict=True) for b in branches(source)}
        columns = list(zip(*seen, strict=True)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["host", "path", "kind", "page", "shown", "content"])

    rows = map_batches(pages.select("host", "html"), f, "host string, path bigint, kind bigint, page bigint, shown bigint, content bigint").distinct()
    return rows.groupBy("host", "path", "kind", "shown", "content").agg(F.count("*").alias("c"))


def importance(pages: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """host, path (hash), kind, pages, importance of each branch."""
    sums = style_tree(pages) if tree is None else tree

    def entropy(value: str) -> DataFrame:
        by = sums.groupBy("host", "path", "kind", value).agg(F.sum("c").alias("c"))
        # entropy over the largest possible: (log m - sum c log c / m) / log m
        return by.groupBy("host", "path", "kind").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("x")).select("host", "path", "kind", "m", F.when(F.col("m") > 1, 1 - F.col("x") / F.col("m") / F.log("m")).otherwise(F.lit(1.0)).alias(f"by_{value}"))

    both = entropy("shown").join(entropy("content").drop("m"), ["host", "path", "kind"])
    return both.select("host", "path", "kind", F.col("m").alias("pages"), ((1 - CONTENT_WEIGHT) * F.col("by_shown") + CONTENT_WEIGHT * F.col("by_content")).alias("importance"))


def marks(tree: DataFrame) -> DataFrame:
    """host, mark: the numbers that Templates reads."""
    by_path = importance(tree, tree).filter((F.col("pages") >= LEAST_PAGES) & (F.col("kind") != TEXT))
    low = F.col("importance") < F.when(F.col("kind") == HINTED, F.lit(LEAST_HINTED)).otherwise(F.lit(LEAST))
    paths = by_path.filter(low | (F.col("kind") == HINTED)).select("host", "path", F.when(low, F.lit(None)).otherwise(F.lit(1)).cast("bigint").alias("content"))
    nodes = tree.groupBy("host", "path", "content").agg(F.sum("c").alias("c"))
    totals = nodes.groupBy("host", "path").agg(F.sum("c").alias("m")).filter(F.col("m") >= LEAST_PAGES)
    own = F.log(F.col("m") / F.col("c")) / F.log("m") < LEAST
    repeated = nodes.filter(F.col("c") > 1).join(totals, ["host", "path"]).filter(own & (F.col("content") != 0)).select("host", "path", "content")

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [p if c is None else signed(mixed(p & M64, c & M64)) for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out, pa.int64())], names=["host", "mark"])

    return map_batches(paths.unionByName(repeated), f, "host string, mark bigint")


def main_text(source: str, templates: set[int]) -> str:
    page = parse(source)
    annotate(page)
    return "\n".join(text_blocks(page, Templates(templates)))


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    work = Workspace(pages.sparkSession, "html")
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", split_url()[0])
    tree = work.stage(style_tree(pages), "tree")
    low = work.stage(marks(tree).groupBy("host").agg(F.collect_set("mark").alias("templates")), "templates")
    if (low.agg(F.sum(F.size("templates"))).first()[0] or 0) <= BROADCAST_ROWS:
        both = pages.join(F.broadcast(low), "host", "left")
    else:
        salted = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        both = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int")).join(salted, ["host", "salt"], "left")

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [main_text(s, set(t or ())) for s, t in zip(texts(batch, "html"), batch.column("templates").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_batches(both.select("page_id", "url", "html", "templates"), f, "page_id bigint, url string, text string, n_chars bigint")
