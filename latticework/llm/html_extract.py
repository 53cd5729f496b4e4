"""Main text of web pages: a linear-chain conditional random field over leaf blocks, decoded by Viterbi."""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, ship, without

#: What follows a tag's name, up to and with its end or that of the page: quotes mean something only after =. No step is taken back.
ATTRIBUTES = re.compile(r"""(?:[\s/]++|(?:=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|(?!["'>])[^\s>]++)?+)?+)*+(>|\Z)""")
ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])(class|id|role|hidden|aria-label|style)(?![^\s/>=])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: Their content is no markup; it ends at their own end tag.
RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes"}
#: Elements whose text is no text of the page. Those of the second set end where the article plainly goes on.
SKIP = {"noscript", "template", "object", "canvas", "audio", "video", "select", "datalist", "svg", "math"}
OPEN_ENDED = {"select", "datalist", "svg", "math"}
GOES_ON = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "main", "ul", "ol", "dl", "table", "header", "footer", "nav", "aside", "form", "blockquote", "pre", "figure"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Tags that do not end a block.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()) | SKIP | (RAW - {"xmp"})
#: An opening tag of the first kind ends an open one of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tbody", "tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "thead": {"table"}, "tbody": {"table"}, "option": {"select"}}
#: Elements deeper than this are taken for children of the one at this depth, as browsers do.
DEPTH = 512


class Node:
    """An element and the one that holds it."""

    __slots__ = ("marks", "mass", "names", "tag", "up")

    def __init__(self, up: Node | None, tag: str, names: tuple[str, ...] = ()):
        self.up, self.tag, self.names, self.mass, self.marks = up, tag, names, 0, None


class Block:
    """A run of text between block tags, with the element that holds it."""

    __slots__ = ("linked", "node", "parts", "text")

    def __init__(self, node: Node):
        self.node, self.parts, self.linked, self.text = node, [], 0, ""


class Reader:
    """A page's blocks, read once from front to end: the time taken grows with the page's length, whatever is in it."""

    def __init__(self, html: str):
        self.html, self.root = html, Node(None, "")
        self.stack: list[Node] = []
        self.open: dict[str, int] = {}  # open elements by tag
        self.beyond: dict[str, int] = {}  # those too deep for the stack
        self.blocks: list[Block] = []
        self.now: Block | None = None
        self.links = self.skipped = 0
        self.read()
        for b in self.blocks:
            b.text = " ".join(unescape("".join(b.parts)).split())
        self.blocks = [b for b in self.blocks if b.text]

    def read(self) -> None:
        html, begin, at = self.html, 0, 0
        while (at := html.find("<", at)) >= 0:
            closing = html.startswith("/", at + 1)
            name = NAME.match(html, at + 1 + closing)
            if name:
                self.text(html[begin:at])
                end = ATTRIBUTES.match(html, name.end())
                if not end[1]:
                    return  # cut off: the rest is the inside of a tag
                tag = name[0].lower()
                begin = at = self.close(tag, end.end()) if closing else self.start(tag, html[name.end() : end.start(1)], end.end())
            elif html.startswith("<!--", at):
                self.text(html[begin:at])
                short = next((len(x) for x in ("<!-->", "<!--->") if html.startswith(x, at)), 0)
                end = at + short if short else html.find("-->", at + 4) + 3
                if end == 2:
                    return
                begin = at = end
            elif html.startswith(("<!", "<?"), at) or closing and at + 2 < len(html):
                self.text(html[begin:at])
                end = html.find(">", at + 2) + 1
                if not end:
                    return
                begin = at = end
            else:
                at += 1  # a sign like any other
        self.text(html[begin:])

    def text(self, s: str) -> None:
        if not s or self.skipped:
            return
        if self.now is None:
            if s.isspace():
                return
            self.now = Block(self.stack[-1] if self.stack else self.root)
            self.blocks.append(self.now)
        self.now.parts.append(s)
        if self.links > 0:
            self.now.linked += len(s)

    def pop(self, to: int) -> None:
        """Close the elements of the stack from place `to` on."""
        for node in self.stack[to:]:
            self.open[node.tag] -= 1
            self.links -= node.tag == "a"
            self.skipped -= node.tag in SKIP
        del self.stack[to:]

    def close(self, tag: str, pos: int) -> int:
        if tag not in INLINE and not self.skipped:
            self.now = None
        if tag == "br":
            self.text(" ")
        elif self.beyond.get(tag):
            self.beyond[tag] -= 1
        elif self.open.get(tag):
            i = len(self.stack) - 1
            while self.stack[i].tag != tag:
                if tag in INLINE and tag not in SKIP and self.stack[i].tag not in INLINE:
                    return pos
                i -= 1
            self.pop(i)
        return pos

    def start(self, tag: str, inside: str, pos: int) -> int:
        if self.skipped and tag in GOES_ON:
            first = next(i for i, n in enumerate(self.stack) if n.tag in SKIP)
            if all(n.tag in OPEN_ENDED for n in self.stack[first:] if n.tag in SKIP):
                self.pop(first)
        if tag in RAW:
            if tag not in INLINE and not self.skipped:
                self.now = None
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(self.html, pos)
            return end.end() if end else len(self.html)
        if tag in VOID:
            if tag == "br":
                self.text(" ")
            elif tag == "hr":
                self.now = None
            return pos
        if tag not in INLINE and not self.skipped:
            self.now = None
            ends = CLOSES.get(tag, set())
            for i in range(len(self.stack) - 1, -1, -1):
                other = self.stack[i].tag
                if other in SCOPE.get(tag, ()):
                    break
                if other in ends or other == "p":
                    self.pop(i)
                    if tag not in CLOSES:
                        break
                elif other not in INLINE and tag not in CLOSES:
                    break
        if inside.endswith("/") and (tag in SKIP or tag not in INLINE):
            return pos
        if len(self.stack) >= DEPTH:
            self.beyond[tag] = self.beyond.get(tag, 0) + 1
            return pos
        self.stack.append(Node(self.stack[-1] if self.stack else self.root, tag, _names(inside) if inside else ()))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.links += tag == "a"
        self.skipped += tag in SKIP
        return pos


def _names(inside: str) -> tuple[str, ...]:
    """The words of a tag's class, id and the like; `hidden` for elements that are not shown."""
    words = []
    for k, a, b, c in ATTRIBUTE.findall(inside):
        k, v = k.lower(), a or b or c
        if k == "hidden" or k == "style" and re.search(r"display\s*:\s*none", v):
            words.append("hidden")
        elif k != "style":
            words += re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", v).lower())
    return tuple(words[:32])


def leaf_blocks(html: str) -> list[Block]:
    """The blocks of a page that hold text, in page order. Tags may be missing, wrongly nested or cut off."""
    return Reader(html).blocks


#: Names that sites give to parts which are not the article, by part.
PARTS = {
    "nav": "nav navbar navigation menu mainmenu breadcrumb breadcrumbs topnav pagination pager toc".split(),
    "header": "header masthead topbar branding banner sitehead logo tagline".split(),
    "footer": "footer colophon bottom copyright legal sitefoot credits".split(),
    "aside": "sidebar aside rail related widget recommended trending popular tags social share sharing archive side".split(),
    "notice": "cookie consent notice gdpr alert popup modal overlay banner paywall warning message privacy".split(),
    "ad": "ad ads advert advertisement sponsored sponsor promo promotion adsense adslot banner teaser".split(),
    "form": "form newsletter subscribe signup search login contact comment-form reply-form".split(),
    "comments": "comments comment discussion replies responses disqus thread reply feedback reader".split(),
}
CONTENT = "content article post entry story body main text article-body post-content entry-content story-text prose page".split()


PART_OF = {n: k for k, names in PARTS.items() for n in names} | {n: "content" for n in CONTENT}


STOP = re.compile(r"[.!?…:;\"')\]]$")


def _marks(node: Node) -> tuple[frozenset, str, str]:
    """What an element gives to the blocks in it: names of features, the innermost part of a page, its block tag."""
    todo = []
    while node is not None and node.marks is None:
        todo.append(node)
        node = node.up
    got = node.marks if node is not None else (frozenset({"bias"}), "none", "none")
    for n in reversed(todo):
        out, inner, own = set(got[0]), got[1], got[2]
        if n.tag and n.tag not in INLINE:
            own = n.tag
            if n.tag not in ("html", "body"):
                out.add(f"in={n.tag}")
        for x in (n.tag, *n.names):
            if part := PART_OF.get(x) or PART_OF.get(x.removesuffix("s")):
                out.add(f"part={part}")
                inner = part
        for x in n.names:
            out.add(f"name={x}")
            if len(x) > 5:
                out.add(f"stem={x[:6]}")
        n.marks = got = (frozenset(out), inner, own)
    return got


def _core(blocks: list[Block]) -> Node | None:
    """The smallest element that holds three fifths of the page's text outside links; what is under a known part does not count."""
    total, root = 0, None
    for b in blocks:
        part = _marks(b.node)[1]
        mass = max(0, len(b.text) - b.linked) if part in ("none", "content") else 0
        total += mass
        node = b.node
        while node is not None:
            node.mass += mass
            node, root = node.up, node
    best, found = None, root
    seen = {}
    for b in blocks:  # children by parent, each once
        node = b.node
        while node.up is not None and id(node) not in seen:
            seen[id(node)] = node
            node = node.up
    kids: dict[int, list[Node]] = {}
    for node in seen.values():
        kids.setdefault(id(node.up), []).append(node)
    while found is not None:
        best = found
        found = next((k for k in kids.get(id(found), []) if k.mass * 5 >= total * 3 and total and k.tag not in ("p", "li", "td")), None)
    return best


def _linked(b: Block) -> str:
    share = b.linked / max(1, len(b.text))
    return "none" if share == 0 else "some" if share < 0.5 else "most"


def page_features(blocks: list[Block]) -> list[list[str]]:
    """Names of what holds for each block of a page: ancestors' tags and names, its own tag, its text, and its place in the page."""
    core = _core(blocks)
    out = []
    for i, b in enumerate(blocks):
        marks, inner, own = _marks(b.node)
        t, f = b.text, set(marks)
        f.add(f"own={own}")
        f.add(f"inner={inner}")
        node, deep = b.node, 0
        while node is not None and node is not core:
            deep += node.tag not in INLINE
            node = node.up
        where = "core" if node is core and core is not None and core.up is not None else "outside" if node is None else "wide"
        f |= {where, f"{where}&{own}", f"{where}&{min(deep, 3)} deep"}
        n = t.count(" ") + 1
        size = "1-2" if n < 3 else "3-6" if n < 7 else "7-15" if n < 16 else "16+"
        linked = _linked(b)
        f |= {f"words={size}", f"links={linked}", f"{linked}&{size}", "stop" if STOP.search(t) else "nostop"}
        if i + 1 < len(blocks):
            f.add(f"next={_linked(blocks[i + 1])}&{size}")
        if len(blocks) >= 8:
            f.add(f"place={4 * i // len(blocks)}")
        if re.match(r"\s*(?:©|\(c\)|copyright)", t, re.I):
            f.add("copyright")
        out.append(sorted(f))
    return out


class Crf:
    """Two labels (0: other, 1: main text); weights of features for label 1, of label pairs, and of the first label."""

    def __init__(self, weights: dict[str, float], pairs: list[list[float]], first: list[float]):
        self.weights, self.pairs, self.first = weights, pairs, first

    def decode(self, blocks: list[Block]) -> list[int]:
        if not blocks:
            return []
        w, ((aa, ab), (ba, bb)) = self.weights, self.pairs
        score = [sum(w.get(f, 0.0) for f in fs) for fs in page_features(blocks)]
        x, y = self.first[0], self.first[1] + score[0]
        back = []
        for s in score[1:]:
            back.append((0 if x + aa >= y + ba else 1, 0 if x + ab > y + bb else 1))
            x, y = max(x + aa, y + ba), max(x + ab, y + bb) + s
        out = [int(y > x)]
        for p in reversed(back):
            out.append(p[out[-1]])
        return out[::-1]


def fit(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 120, rate: float = 0.15, decay: float = 2e-3) -> Crf:
    """Maximum likelihood by Adam over all pages at once; forward and backward sums run over padded pages."""
    import numpy as np

    seen = Counter(f for fs, _ in pages for f in {f for x in fs for f in x})
    names = sorted(f for f, k in seen.items() if k > 2)  # what two pages alone have says nothing of others
    at = {f: i for i, f in enumerate(names)}
    n, long = len(pages), max(len(y) for _, y in pages)
    x, y, mask = np.zeros((n, long, len(names)), np.float32), np.zeros((n, long), int), np.zeros((n, long), bool)
    for p, (fs, labels) in enumerate(pages):
        for i, f in enumerate(fs):
            x[p, i, [at[k] for k in f if k in at]] = 1
        y[p, : len(labels)], mask[p, : len(labels)] = labels, True
    theta = np.zeros(len(names) + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    lse = lambda z, axis: (top := z.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(z - top).sum(axis))
    for step in range(1, rounds + 1):
        w, pairs, first = theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:]
        unary = np.zeros((n, long, 2))
        unary[..., 1] = x @ w.astype(np.float32)
        fwd, bwd = np.zeros((n, long, 2)), np.zeros((n, long, 2))
        fwd[:, 0] = first + unary[:, 0]
        for i in range(1, long):
            new = lse(fwd[:, i - 1, :, None] + pairs, 1) + unary[:, i]
            fwd[:, i] = np.where(mask[:, i, None], new, fwd[:, i - 1])
        z = lse(fwd[:, -1], 1)
        for i in range(long - 2, -1, -1):
            new = lse(pairs + (unary[:, i + 1] + bwd[:, i + 1])[:, None, :], 2)
            bwd[:, i] = np.where(mask[:, i + 1, None], new, bwd[:, i + 1])
        p1 = np.exp(fwd + bwd - z[:, None, None])[..., 1]
        grad = np.zeros_like(theta)
        grad[:-6] = np.einsum("pl,plf->f", np.where(mask, y - p1, 0), x)
        for i in range(1, long):
            on = mask[:, i]
            joint = np.exp(fwd[on, i - 1, :, None] + pairs + (unary[on, i] + bwd[on, i])[:, None, :] - z[on, None, None])
            seen = np.zeros((on.sum(), 2, 2))
            seen[np.arange(on.sum()), y[on, i - 1], y[on, i]] = 1
            grad[-6:-2] += (seen - joint).sum(0).ravel()
        grad[-1] += (y[:, 0] - p1[:, 0]).sum()
        grad[-2] -= (y[:, 0] - p1[:, 0]).sum()
        grad = grad / n - decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Crf({f: float(theta[i]) for f, i in at.items()}, theta[-6:-2].reshape(2, 2).tolist(), theta[-2:].tolist())


def labelled_pages(n: int = 400, seed: int = 7, dull: float = 0.0) -> list[tuple[str, list[str]]]:
    """n invented pages, each with the texts of its main blocks: the labelled data that the model is fitted on.

    dull: the share of names that say nothing about their part, so that a fit on such pages must look at more than names.
    """
    r = random.Random(seed)
    syllables = "an er in the on re at ou ti es ing ed sh th le que ment aux ich ung ver ción ado der est".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))

    def words(lo: int, hi: int, stop: str = "") -> str:
        return " ".join(word() for _ in range(r.randint(lo, hi))).capitalize() + stop

    link = lambda lo=1, hi=3: f'<a href="/{word()}">{words(lo, hi)}</a>'
    call = lambda names: r.choice(names) if r.random() >= dull else word()
    some = lambda kind: r.choice([f' class="{call(PARTS[kind])}"', f' id="{call(PARTS[kind])}"', f' class="{call(PARTS[kind])} {word()}"'])

    def other(kind: str) -> str:
        """A part of the page that is not the article."""
        if kind == "nav":
            inner = "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 7))) + "</ul>" if r.random() < 0.8 else " | ".join(link() for _ in range(4))
            return r.choice([f"<nav>{inner}</nav>", f"<nav{some('nav')}>{inner}</nav>", f"<div{some('nav')}>{inner}</div>"])
        if kind == "header":
            inner = r.choice([f"<h1>{link()}</h1><p>{words(2, 8)}</p>", f"<div>{words(1, 4)}</div>", f"<p>{words(3, 9, '.')}</p>"])
            return r.choice([f"<header>{inner}</header>", f"<header{some('header')}>{inner}</header>", f"<div{some('header')}>{inner}</div>"])
        if kind == "footer":
            inner = r.choice([f"&copy; {word()}.example &middot; {words(2, 9, '.')}", f"<p>Copyright {r.randint(1990, 2030)} {words(1, 4)}</p><p>{link()} {link()}</p>", f"<p>{words(5, 25, '.')}</p>", words(2, 9, ".")])
            return r.choice([f"<footer>{inner}</footer>", f"<footer{some('footer')}>{inner}</footer>", f"<div{some('footer')}>{inner}</div>"])
        if kind == "aside":
            inner = r.choice(["<h3>" + words(1, 3) + "</h3><ul>" + "".join(f"<li>{link(2, 7)}</li>" for _ in range(3)) + "</ul>", f"<p>{words(5, 30, '.')}</p>", f"<h2>{words(1, 4)}</h2><p>{words(4, 20, '.')}</p>"])
            return r.choice([f"<aside>{inner}</aside>", f"<aside{some('aside')}>{inner}</aside>", f"<div{some('aside')}>{inner}</div>", f"<section{some('aside')}>{inner}</section>"])
        if kind == "notice":
            return f"<{(t := r.choice(['div', 'section', 'div', 'dialog']))}{some('notice')}><p>{words(5, 25, '.')}</p>{r.choice(['', f'<button>{words(1, 2)}</button>'])}</{t}>"
        if kind == "ad":
            inner = r.choice([words(3, 20, "."), f"<p>{words(4, 25, '.')}</p>", link(2, 8)])
            return f"<{(t := r.choice(['div', 'div', 'aside', 'section', 'p', 'ins']))}{some('ad')}>{inner}</{t}>"
        if kind == "form":
            inner = f"<label>{words(1, 4)}</label><input name=q><p>{words(3, 15, '.')}</p><button>{words(1, 2)}</button>"
            return r.choice([f"<form>{inner}</form>", f"<form{some('form')}>{inner}</form>", f"<div{some('form')}><form>{inner}</form></div>"])
        one = lambda: f'<{(t := r.choice(["div", "li", "article", "p"]))}{some("comments") if r.random() < 0.6 else ""}><p>{words(3, 40, ".")}</p></{t}>'
        inner = r.choice(["", f"<h2>{words(1, 3)}</h2>"]) + "".join(one() for _ in range(r.randint(1, 4)))
        return f"<{(t := r.choice(['section', 'div', 'ol', 'ul']))}{some('comments')}>{inner}</{t}>"

    out = []
    for _ in range(n):
        main: list[str] = []

        def keep(s: str, main=main) -> str:
            main.append(" ".join(unescape(re.sub("<[^>]*>", "", s)).split()))
            return s

        body = [f"<h1>{keep(words(3, 12, r.choice(['', '.'])))}</h1>"] if r.random() < 0.9 else []
        for _ in range(r.randint(1, 9)):
            kind, p = r.random(), keep
            if kind < 0.6:
                t = r.choice(("p", "p", "p", "p", "div"))
                body.append(f"<{t}>{p(words(*r.choice([(1, 3), (8, 40), (20, 90)]), '.'))}</{t}>")
            elif kind < 0.7:
                body.append(f"<p><b>{p(words(3, 20, '.'))}<br>" + r.choice(["", "</p>"]))
            elif kind < 0.78:
                body.append(f"<{(t := r.choice(['h2', 'h3']))}>{p(words(1, 7))}</{t}>")
            elif kind < 0.85:
                body.append("<ul>" + "".join(f"<li>{p(words(2, 15, '.'))}</li>" for _ in range(r.randint(2, 4))) + "</ul>")
            elif kind < 0.9:
                body.append(f"<blockquote>{p(words(5, 30, '.'))}</blockquote>")
            elif kind < 0.94:
                body.append(f"<p>{p(words(5, 20) + ' ' + link() + ' ' + words(3, 15, '.'))}</p>")
            elif kind < 0.97:
                body.append(f"<pre>{p(words(3, 20))}</pre>")
            else:
                body.append("<table>" + "".join(f"<tr><td>{p(words(1, 4))}</td><td>{p(words(1, 4))}</td></tr>" for _ in range(2)) + "</table>")
            if r.random() < 0.12:
                body.append(other(r.choice(["ad", "aside", "form", "notice"])))
        if len(body) > 4 and r.random() < 0.2:  # the article's own sections
            at = r.randint(2, len(body) - 2)
            body = ["<section>", *body[:at], "</section><section>", *body[at:], "</section>"]
        inside = "".join(body) + (other("comments") if r.random() < 0.15 else "") + (other("form") if r.random() < 0.08 else "")
        name = f' {r.choice(["class", "id"])}="{call(CONTENT)}"'
        art = r.choice([f"<article>{inside}</article>", f"<article>{inside}</article>", f"<article{name}>{inside}</article>", f"<div{name}>{inside}</div>", f"<main><article>{inside}</article></main>", f"<main{name}>{inside}</main>"])
        for _ in range(r.choice((0, 0, 1, 2))):  # layers that mean nothing
            t = r.choice(("div", "div", "section"))
            art = f'<{t} {r.choice(["class", "id"])}="{word()}">{art}</{t}>' if r.random() < 0.7 else f"<{t}>{art}</{t}>"
        before = [other(k) for k in ("nav", "header", "notice", "ad", "form") if r.random() < 0.5]
        after = [other(k) for k in ("aside", "comments", "ad", "form", "notice") if r.random() < 0.4] + [other("footer")]
        if r.random() < 0.15:  # nothing but the article
            before, after = [], []
        r.shuffle(before)
        end = r.choice(["</body></html>", ""])
        out.append((f'<!DOCTYPE html><html lang="en"><head><title>{words(2, 9)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>' + "".join(before) + art + "".join(after) + end, main))
    return out


def training_set(n: int = 400, seed: int = 7) -> list[tuple[list[list[str]], list[int]]]:
    """Features and labels by block; a block is main text if its text is the next one of the page's main texts."""
    out = []
    for html, main in labelled_pages(n, seed, dull=0.25):
        blocks, labels, want = leaf_blocks(html), [], list(main)
        for b in blocks:
            hit = bool(want) and b.text == want[0]
            labels.append(int(hit))
            if hit:
                want.pop(0)
        out.append((page_features(blocks), labels))
    return out


_model: list[Crf] = []


def model() -> Crf:
    """The fitted model; fitted once in a process, always the same."""
    if not _model:
        _model.append(fit(training_set()))
    return _model[0]


def main_text(html: str | None, crf: Crf) -> str:
    blocks = leaf_blocks(html or "")
    return "\n".join(b.text for b, y in zip(blocks, crf.decode(blocks), strict=True) if y)


def extract(df: DataFrame, html_col: str = "html", crf: Crf | None = None) -> DataFrame:
    """df without html_col and with text added (a column of that name is replaced): the main text of every row's whole html.

    Null and empty html give an empty text, as do pages without a block of the label. Character references are
    decoded, white space inside a block becomes one space, blocks are joined by one line feed in page order.
    Rows are independent, so repeated rows and skew do not matter; an empty table gives an empty one. The time for a page
    grows with its length, also where its markup is broken.
    """
    ship(df.sparkSession)
    crf = crf or model()
    weights, pairs, first = crf.weights, crf.pairs, crf.first
    rest = without(df, ["text", html_col])
    names = [f"c{i}" for i in range(len(rest.columns) + 1)]  # mapInArrow itself stumbles over dots in names
    d = df.select(*[col(c) for c in rest.columns], col(html_col)).toDF(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Crf(weights, pairs, first)
        for whole in batches:
            for s in range(0, whole.num_rows, 128):
                b = whole.slice(s, 128)
                texts = [main_text(h.as_py(), own) for h in b.column(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names)

    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*[StructField(n, f.dataType) for n, f in zip(names, rest.schema.fields, strict=False)], StructField(names[-1], StringType())])
    return d.mapInArrow(run, schema).toDF(*rest.columns, "text")
