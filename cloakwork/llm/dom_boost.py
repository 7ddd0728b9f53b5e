"""Main text of web pages by boosted trees over DOM nodes and hierarchical decoding.

A page becomes a tree of elements.  Boosted trees give each element the log odds that
it belongs to the article (or holds a part of it) from the density of its subtree, its
attribute tokens, its depth and its siblings.  A node can only be kept if its parent is,
so the choice for all nodes together is the best pruning of the tree: from the leaves
up, a node is worth its own odds, weighted by its own text, plus what its children are
worth, or nothing if it is dropped.  The trees are trained on made-up pages whose
labels are known by construction.

Scripts, styles, templates, comments, the head and form controls never hold text.
Character references are decoded, white space in a block becomes one space, blocks are
trimmed and joined by line feeds in page order.  Defined cases: a null or empty page,
or one without article text, gives an empty text; unclosed and stray tags are tolerated;
repeated rows give repeated results; other columns pass unchanged except those named
like a result.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .boost import Boosted
from .common import importable
from .shingles import slices

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S,
)
ATTR = re.compile(r"""(class|id|role|itemprop|aria-label|hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Elements whose content is not markup, and elements that never hold article text.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SILENT = frozenset(
    "head script style template noscript textarea title select option button input iframe svg canvas object embed"
    " audio video datalist label optgroup output progress meter".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th"
    " thead tr ul caption".split()
)
#: A start tag on the left ends open elements on the right, up to the boundary elements.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table tbody thead tfoot html body div article section main".split())
GROUPS = {
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs topbar toc pagination pager skip",
    "header": "header masthead banner head logo branding top",
    "footer": "footer foot copyright colophon legal bottom",
    "side": "sidebar side aside related recommended widget widgets rail trending popular more rightcol leftcol complementary",
    "advert": "ad ads adv advert adverts advertisement sponsor sponsored promo promotion adsense dfp banner commercial",
    "notice": "cookie cookies consent gdpr notice alert popup modal newsletter subscribe subscription signup paywall overlay toast warning dialog",
    "remarks": "comment comments reply replies respond discussion disqus thread responses commentlist feedback",
    "form": "form search login contact input field searchform searchbox",
    "share": "share sharing social follow tweet facebook like tags tagcloud meta byline author",
    "main": "article content main post entry story body text articlebody prose hentry maincontent page single document",
}
GROUP_OF = {t: i for i, ts in enumerate(GROUPS.values()) for t in ts.split()}
N_GROUPS = len(GROUPS)
TAGS = ("p", "div", "section", "article", "main", "nav", "header", "footer", "aside", "ul", "ol", "li", "a", "table", "td", "blockquote", "pre", "h1", "h2", "h3", "figure", "figcaption", "span", "b", "em", "body", "html", "dialog", "form", "fieldset")
TAG_NO = {t: i + 1 for i, t in enumerate(TAGS)}
FEATURES = 17 + 2 * N_GROUPS


class Page:
    """Element arrays in document order, with the texts that stand directly in each."""

    __slots__ = ("tag", "parent", "depth", "attrs", "silent", "parts")

    def __init__(self, source: str):
        self.tag, self.parent, self.depth, self.attrs, self.silent = ["#root"], [-1], [0], [""], [False]
        #: (node, text) in document order; text None is a block boundary
        self.parts: list[tuple[int, str | None]] = []
        self._parse(source)

    def _parse(self, s: str) -> None:
        stack, count, at = [0], {"#root": 1}, 0
        tag, parent, depth, attrs, silent, parts = self.tag, self.parent, self.depth, self.attrs, self.silent, self.parts
        pos, n = 0, len(s)

        def close(i: int) -> None:
            while len(stack) > i:
                k = stack.pop()
                count[tag[k]] -= 1
                if tag[k] in BLOCK:
                    parts.append((k, None))

        while pos < n:
            m = TOKEN.search(s, pos)
            end = m.start() if m else n
            if end > pos and not silent[stack[-1]]:
                parts.append((stack[-1], s[pos:end]))
            if m is None:
                break
            pos = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                if count.get(name, 0):
                    i = len(stack) - 1
                    while tag[stack[i]] != name:
                        i -= 1
                    close(i)
                elif name == "p" or name == "br":
                    parts.append((stack[-1], None if name == "p" else " "))
                continue
            if name == "br":
                if not silent[stack[-1]]:
                    parts.append((stack[-1], " "))
                continue
            if name in BLOCK and count.get("p", 0):
                i = len(stack) - 1
                while tag[stack[i]] not in ("p", "table", "button", "td", "th") and i:
                    i -= 1
                if tag[stack[i]] == "p":
                    close(i)
            if name in CLOSES:
                i = len(stack) - 1
                while i and tag[stack[i]] not in CLOSES[name] and tag[stack[i]] not in SCOPE:
                    i -= 1
                if tag[stack[i]] in CLOSES[name]:
                    close(i)
            at = len(tag)
            up = stack[-1]
            tag.append(name)
            parent.append(up)
            depth.append(depth[up] + 1)
            attrs.append(m[3])
            silent.append(silent[up] or name in SILENT)
            if name in BLOCK:
                parts.append((at, None))
            if name in VOID or m[3].endswith("/") and name not in BLOCK and name not in RAW:
                continue
            if name in RAW:
                e = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(s, pos)
                pos = e.end() if e else n
                continue
            stack.append(at)
            count[name] = count.get(name, 0) + 1
        close(1)


def _flags(attrs: str, name: str) -> tuple[int, bool]:
    """Bits of the attribute-token groups of an element, and whether it is hidden."""
    bits, hidden = 0, False
    if name in GROUP_OF and name not in ("body", "head", "main"):
        bits |= 1 << GROUP_OF[name]
    if name == "main":
        bits |= 1 << GROUP_OF["main"]
    if attrs:
        for m in ATTR.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden":
                hidden = True
            elif key == "style":
                hidden |= "display:none" in value.replace(" ", "").lower()
            else:
                for w in WORD.findall(value):
                    g = GROUP_OF.get(w.lower())
                    if g is not None:
                        bits |= 1 << g
    return bits, hidden


def features(page: Page) -> np.ndarray:
    """[nodes, FEATURES] of a page."""
    n = len(page.tag)
    parent = np.array(page.parent)
    own, punct, words = np.zeros(n), np.zeros(n), np.zeros(n)
    for k, t in page.parts:
        if t:
            w = t.split()
            if w:
                own[k] += sum(map(len, w)) + len(w) - 1
                words[k] += len(w)
                punct[k] += t.count(".") + t.count(",") + t.count("?") + t.count("!")
    link = np.array([own[i] if page.tag[i] == "a" else 0.0 for i in range(n)])
    is_p = np.array([t == "p" for t in page.tag], float)
    head = np.array([t in ("h1", "h2") for t in page.tag], float)
    sub, sub_link, sub_punct, sub_p, sub_h, size = own.copy(), link.copy(), punct.copy(), is_p.copy(), head.copy(), np.ones(n)
    bits, up_bits, hidden = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    kids, order = np.zeros(n), np.zeros(n)
    in_a = np.zeros(n, bool)
    for i in range(1, n):
        bits[i], h = _flags(page.attrs[i], page.tag[i])
        p = page.parent[i]
        hidden[i] = h or hidden[p]
        up_bits[i] = up_bits[p] | bits[p]
        order[i] = kids[p]
        kids[p] += 1
        in_a[i] = in_a[p] or page.tag[i] == "a"
        if in_a[i] and page.tag[i] != "a":
            sub_link[i] += own[i]
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        sub[p] += sub[i]
        sub_link[p] += sub_link[i]
        sub_punct[p] += sub_punct[i]
        sub_p[p] += sub_p[i]
        sub_h[p] += sub_h[i]
        size[p] += size[i]
    tags = np.array([TAG_NO.get(t, 0) for t in page.tag], float)
    same: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        key = (page.parent[i], page.tag[i])
        same[key] = same.get(key, 0) + 1
    alike = np.array([same.get((page.parent[i], page.tag[i]), 1) for i in range(n)], float)
    p = np.maximum(parent, 0)
    cols = [
        tags, tags[p], np.array(page.depth, float), np.log1p(own), np.log1p(sub), sub_link / np.maximum(sub, 1),
        sub_punct / np.maximum(sub, 1), sub / np.maximum(size, 1), sub / max(sub[0], 1), sub / np.maximum(sub[p], 1),
        sub_p, sub_h, kids, order / np.maximum(kids[p], 1), alike / np.maximum(kids[p], 1), hidden,
        words / np.maximum(own, 1),
    ]
    for g in range(N_GROUPS):
        cols.append(((bits >> g) & 1).astype(float))
    for g in range(N_GROUPS):
        cols.append(((up_bits >> g) & 1).astype(float))
    return np.stack(cols, axis=1)


def decode(page: Page, odds: np.ndarray) -> list[bool]:
    """The best choice of nodes in which every kept node has a kept parent."""
    n = len(page.tag)
    own = [0] * n
    for k, t in page.parts:
        if t:
            own[k] += len(t)
    worth = [0.0] * n
    for i in range(n - 1, 0, -1):
        if page.silent[i]:
            continue
        worth[i] += float(odds[i]) * (1 + own[i] ** 0.5 if own[i] else 0.5)
        if worth[i] > 0:
            worth[page.parent[i]] += worth[i]
    keep = [False] * n
    keep[0] = True
    for i in range(1, n):
        keep[i] = keep[page.parent[i]] and worth[i] > 0 and not page.silent[i]
    return keep


def text_of(page: Page, keep: list[bool]) -> str:
    blocks, cur = [], []
    for k, t in page.parts:
        if t is None:
            if cur:
                blocks.append(" ".join("".join(cur).split()))
                cur = []
        elif keep[k] and not page.silent[k]:
            cur.append(html.unescape(t) if "&" in t else t)
    if cur:
        blocks.append(" ".join("".join(cur).split()))
    return "\n".join(b for b in blocks if b)


# Made-up pages -----------------------------------------------------------------

_SYL = "an er th on re ti la ou ie sch ed in es le que ment ung keit ción os ar do".split()


class _Maker:
    """Random pages; parts of the article carry the attribute data-main."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, lo: int, hi: int) -> str:
        r = self.r
        out = ["".join(r.choice(_SYL) for _ in range(r.randint(1, 4))) for _ in range(r.randint(lo, hi))]
        return " ".join(w + ("," if r.random() < 0.08 else ".") * (r.random() < 0.15) for w in out).capitalize() + r.choice(".....!?")

    def attr(self, *tokens: str) -> str:
        r = self.r
        if r.random() < 0.3:
            return ""
        t = r.choice(tokens)
        t = r.choice((t, t, f"{t}-{r.choice(('wrap', 'box', 'inner', 'area', 'block'))}", f"site-{t}", f"{t} c{r.randint(1, 99)}"))
        return f' {r.choice(("class", "class", "id"))}="{t}"'

    def links(self, tag: str = "ul") -> str:
        li = "".join(f'<li><a href="/x">{self.words(1, 3)}</a></li>' for _ in range(self.r.randint(3, 9)))
        return f"<{tag}>{li}</{tag}>"

    def menu(self) -> str:
        r = self.r
        return r.choice((f"<nav{self.attr('nav', 'menu', 'navbar')}>{self.links()}</nav>", f'<div class="{r.choice(("menu", "navigation", "breadcrumbs", "navbar"))}">{self.links()}</div>'))

    def header(self) -> str:
        r = self.r
        inner = r.choice((self.menu(), f"<p>{self.words(2, 8)}</p>", f'<a href="/">{self.words(1, 3)}</a>', f"<h1>{self.words(1, 3)}</h1>{self.menu()}"))
        return r.choice((f"<header{self.attr('header', 'masthead')}>{inner}</header>", f'<div class="{r.choice(("header", "masthead", "topbar", "site-header"))}">{inner}</div>'))

    def footer(self) -> str:
        r = self.r
        inner = r.choice((f"&copy; {self.words(2, 12)}", f"<p>&copy; 2020 {self.words(3, 12)}</p>{self.links()}", f"{self.words(4, 20)}", f"<p>{self.words(8, 40)}</p><p>{self.words(4, 20)}</p>"))
        return r.choice((f"<footer{self.attr('footer', 'copyright')}>{inner}</footer>", f'<div class="{r.choice(("footer", "site-footer", "copyright", "legal"))}">{inner}</div>'))

    def side(self) -> str:
        r = self.r
        inner = r.choice((f"<h3>{self.words(1, 4)}</h3>{self.links()}", f"<p>{self.words(6, 40)}</p>", self.links(), f"<h2>{self.words(1, 4)}</h2><p>{self.words(5, 30)}</p><p>{self.words(5, 30)}</p>"))
        return r.choice((f"<aside{self.attr('sidebar', 'related', 'widget')}>{inner}</aside>", f'<div class="{r.choice(("sidebar", "related", "widget", "side-rail", "recommended", "trending"))}">{inner}</div>', f'<section id="{r.choice(("related", "sidebar", "popular"))}">{inner}</section>'))

    def advert(self) -> str:
        r = self.r
        return f'<{(t := r.choice(("div", "div", "section", "p", "aside")))} class="{r.choice(("ad", "ads", "advert", "sponsored", "promo", "ad-slot", "advertisement"))}">{self.words(3, 30)}</{t}>'

    def notice(self) -> str:
        r = self.r
        inner = r.choice((f"<p>{self.words(6, 40)}</p><button>OK</button>", self.words(6, 40), f"{self.words(5, 30)} <a href='/p'>{self.words(1, 3)}</a>"))
        return f'<div {r.choice(("class", "id"))}="{r.choice(("cookie-banner", "notice", "consent", "newsletter", "popup", "gdpr", "subscribe-box", "alert", "paywall"))}">{inner}</div>'

    def form(self) -> str:
        r = self.r
        inner = r.choice((
            f'<label>{self.words(1, 4)}</label><input name="q"><p>{self.words(3, 12)}</p><button>{self.words(1, 2)}</button>',
            f'{self.words(1, 6)} <input name="mail"><button>{self.words(1, 2)}</button>',
            f'<fieldset><legend>{self.words(1, 4)}</legend><p>{self.words(3, 30)}</p><input><p>{self.words(2, 20)}</p></fieldset>',
            f'<h3>{self.words(1, 5)}</h3><p>{self.words(4, 40)}</p><textarea></textarea><button>{self.words(1, 2)}</button>',
        ))
        return f'<form{self.attr("search", "login", "contact-form")}>{inner}</form>'

    def remarks(self) -> str:
        r = self.r
        one = lambda: r.choice((f'<div class="comment"><b>{self.words(1, 2)}</b><p>{self.words(4, 60)}</p></div>', f"<li><p>{self.words(4, 60)}</p></li>", f'<article class="comment"><p>{self.words(4, 60)}</p></article>'))
        many = "".join(one() for _ in range(r.randint(1, 6)))
        return f'<{(t := r.choice(("section", "div", "ol", "ul")))} {r.choice(("id", "class"))}="{r.choice(("comments", "comment-list", "discussion", "replies", "responses", "disqus_thread"))}"><h3>{self.words(1, 3)}</h3>{many}</{t}>'

    def share(self) -> str:
        return f'<div class="{self.r.choice(("share", "social", "share-buttons"))}">{self.links()}</div>'

    def main_block(self) -> str:
        r = self.r
        k, m = r.random(), " data-main"
        if k < 0.62:
            text = self.words(1, 8) if r.random() < 0.25 else self.words(10, 140)
            if r.random() < 0.2:
                text = f"<b{m}>{text}" + ("</b>" if r.random() < 0.5 else "")
            if r.random() < 0.2:
                text += f' <a{m} href="/y">{self.words(1, 4)}</a> {self.words(4, 20)}'
            if r.random() < 0.15:
                text += "<br>"
            if r.random() < 0.1:
                text += f" <em{m}>{self.words(1, 5)}</em> {self.words(2, 9)}"
            return f"<p{m}>{text}" + ("</p>" if r.random() < 0.85 else "")
        if k < 0.72:
            return f"<{(t := r.choice(('h2', 'h3')))}{m}>{self.words(1, 9)}</{t}>"
        if k < 0.82:
            li = "".join(f"<li{m}>{self.words(2, 30)}</li>" for _ in range(r.randint(2, 6)))
            return f"<{(t := r.choice(('ul', 'ol')))}{m}>{li}</{t}>"
        if k < 0.88:
            return f"<blockquote{m}><p{m}>{self.words(5, 40)}</p></blockquote>"
        if k < 0.92:
            tr = "".join(f"<tr{m}><td{m}>{self.words(1, 4)}</td><td{m}>{self.words(1, 4)}</td></tr>" for _ in range(r.randint(2, 5)))
            return f"<table{m}>{tr}</table>"
        if k < 0.95:
            return f"<figure{m}><img src='x.png'><figcaption{m}>{self.words(2, 12)}</figcaption></figure>"
        if k < 0.97:
            return f"<pre{m}>{self.words(4, 30)}</pre>"
        return f"<div{m}>{self.words(10, 90)}</div>"

    def article(self) -> str:
        r = self.r
        m = " data-main"
        body = [self.main_block() for _ in range(r.choice((1, 2, 3, 5, 8, 12, 18)))]
        for junk in (self.advert, self.share, self.side, self.notice, self.form):
            if r.random() < 0.12:
                body.insert(r.randint(1, len(body)), "</p>" + junk())
        inner = "".join(body)
        title = f"<h1{m}>{self.words(1, 12)}</h1>" if r.random() < 0.85 else ""
        k = r.random()
        if k < 0.5:
            return f"<article{m}{self.attr('article', 'post', 'entry') if r.random() < 0.5 else ''}>{title}{inner}</article>"
        if k < 0.65:
            return f"<main{m}>{title}{inner}</main>"
        if k < 0.8:
            return f'<div{m} class="{r.choice(("content", "post", "entry-content", "article-body", "story", "main"))}">{title}{inner}</div>'
        if k < 0.9:
            return f'<main{m}><article{m}>{title}<div{m} class="{r.choice(("body", "text", "x1"))}">{inner}</div></article></main>'
        return f"<div{m}>{title}{inner}</div>"

    def page(self) -> str:
        r = self.r
        pick = lambda f, p: f() if r.random() < p else ""
        before = [pick(self.header, 0.5), pick(self.menu, 0.6), pick(self.notice, 0.25), pick(self.form, 0.2), pick(self.advert, 0.5), pick(self.side, 0.2)]
        after = [pick(self.side, 0.4), pick(self.remarks, 0.35), pick(self.advert, 0.3), pick(self.share, 0.2), pick(self.form, 0.1), pick(self.notice, 0.15), pick(self.footer, 0.85)]
        if r.random() < 0.3:
            r.shuffle(before)
        art = self.article()
        if r.random() < 0.2:
            art = f"<div data-main class='{r.choice(('wrapper', 'container', 'row', 'layout'))}'>{art}{after[0]}</div>"
            after[0] = ""
        k = r.random()
        action = r.choice((' method="post" action="./page"', ' id="form1" method="post"', ' name="mainform" action="/"', ""))
        if k < 0.08:
            # generated sites put the whole page into one form
            before.insert(0, f"<form data-main{action}>")
            after.append("</form>")
        elif k < 0.12:
            art = f"<form data-main{action}>{art}</form>"
        elif k < 0.18:
            # an open form that nothing closes takes in what follows
            before.append(f"<form data-main{action}><label>{self.words(1, 3)}</label><input name='q'>")
        return f"<html data-main><head><title>{self.words(2, 8)}</title></head><body data-main>{''.join(before)}{art}{''.join(after)}</body></html>"


@functools.lru_cache(maxsize=1)
def trained(pages: int = 500, seed: int = 17) -> Boosted:
    """Boosted trees fitted to made-up pages; the same for the same arguments."""
    maker = _Maker(seed)
    xs, ys = [], []
    for _ in range(pages):
        page = Page(maker.page())
        labels = np.array(["data-main" in a for a in page.attrs], float)
        live = [i for i in range(1, len(page.tag)) if not page.silent[i]]
        xs.append(features(page)[live])
        ys.append(labels[live])
    return Boosted(trees=40, depth=5, rate=0.3, least=8).fit(np.concatenate(xs), np.concatenate(ys))


def extract_texts(sources: list[str | None], model: Boosted) -> list[str]:
    """The main text of each page."""
    pages = [Page(s) if s else None for s in sources]
    feats = [features(p) for p in pages if p is not None]
    out: list[str] = []
    if feats:
        odds = model.margin(np.concatenate(feats))
    at = 0
    for p in pages:
        if p is None:
            out.append("")
            continue
        n = len(p.tag)
        out.append(text_of(p, decode(p, odds[at : at + n])))
        at += n
    return out


def extract_main(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with text and n_chars in place of the html column."""
    importable(pages.sparkSession)
    keep = [c for c in pages.columns if c not in ("text", "n_chars", html_col)]
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            src = b.column(len(keep)).to_pylist()
            for lo, hi in slices(src):
                text = extract_texts(src[lo:hi], model)
                cols = [c.slice(lo, hi - lo) for c in b.columns[:-1]]
                cols += [pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, "text", "n_chars"])

    return pages.select(*keep, html_col).mapInArrow(run, schema)
