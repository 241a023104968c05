"""HTML main-text extraction: gradient-boosted trees over DOM-node features, decoded from the root down."""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe svg select".split())
_BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCKS - frozenset("body html li dd dt td th tr tbody thead tfoot legend summary".split())
_SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table article section div main aside nav header footer body html form blockquote".split())
#: A quote only opens a value after an equals sign; one that is never closed counts as text of the tag, which then ends at the next ``>``.
_VALUE = r"""=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)"""
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:{_VALUE}|[^>])*+)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s/>="'][^\s/>=]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""")
_TELLING = frozenset("id class role itemprop hidden aria-hidden".split())
_SPACE = re.compile(r"\s+")
#: Attribute tokens by what they tell.
TOKENS = {
    "content": "article articlebody body content entry main maincontent post postbody prose story text".split(),
    "menu": "breadcrumb breadcrumbs links menu nav navbar navigation pager pagination related share sharing social tags toc toolbar".split(),
    "frame": "bottom copyright foot footer head header legal masthead site sitefooter siteheader top".split(),
    "side": "aside rail side sidebar widget widgets".split(),
    "advert": "ad ads adv advert advertisement banner promo promoted promotion sponsor sponsored".split(),
    "notice": "alert banner consent cookie cookies disclaimer gdpr modal newsletter notice notification overlay popup signup subscribe".split(),
    "comments": "comment commentlist comments discussion disqus reader replies reply respond responses".split(),
    "hidden": "hidden visuallyhidden invisible none".split(),
}
_KIND = {t: i for i, tokens in enumerate(TOKENS.values()) for t in tokens}
_TAGS = ["article", "main", "section", "div", "p", "h", "li", "list", "nav", "header", "footer", "aside", "form", "blockquote", "pre", "table", "figure", "text"]
_TAG_NUMBER = {t: i for i, t in enumerate(_TAGS)} | {f"h{k}": 5 for k in range(1, 7)} | dict.fromkeys(("ul", "ol", "dl", "menu"), 7) | dict.fromkeys(("dt", "dd"), 6) | dict.fromkeys(("tr", "td", "th", "tbody", "thead", "tfoot"), 15) | {"figcaption": 16, "html": 17, "hgroup": 5}

FEATURES = [*(f"tag_{t}" for t in _TAGS), *(f"token_{k}" for k in TOKENS), *(f"above_{k}" for k in TOKENS), "above_article", "above_main", "above_nav", "above_header", "above_footer", "above_aside", "above_form", "depth", "log_text", "link_share", "text_share", "density", "tags_inside", "controls", "place", "siblings", "sibling_share", "paragraphs", "commas", "token_other", "above_other"]
SAMPLE_PAGES, TREES, DEPTH, RATE = 600, 60, 5, 0.3
MARK = "\ue000"


class Linked(str):
    """Text inside a link."""


class Node:
    __slots__ = ("tag", "tokens", "up", "parts", "below", "raw", "length", "linked", "inside", "controls", "paragraphs", "commas", "number", "gain")

    def __init__(self, tag: str, attributes: str, up: Node | None) -> None:
        self.tag, self.up, self.parts, self.below, self.raw = tag, up, [], [], tag in _RAW
        self.tokens: set[int] = set()
        if attributes and attributes != " ":
            for name, *value in _ATTRIBUTE.findall(attributes):
                name = name.lower()
                if name not in _TELLING:
                    continue
                if name == "hidden" or (name == "aria-hidden" and "true" in value):
                    self.tokens.add(_KIND["hidden"])
                for t in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", "".join(value)).lower()):
                    if t in _KIND:
                        self.tokens.add(_KIND[t])
        self.length = self.linked = self.inside = self.controls = self.paragraphs = self.commas = 0


def parse(text: str) -> Node:
    """The tree of block and custom elements; inline markup only leaves its text. ``parts`` of a node holds its texts and child nodes in order.

    End tags that are left out, or match nothing, and a page that is cut off, do no harm: a block closes an open paragraph, what is open at the end is closed.
    """
    root = Node("html", "", None)
    here, at, n, links = root, 0, len(text), 0
    open_: Counter[str] = Counter()  # tags that are open, so that an end tag without a start climbs nowhere

    def add(s: str) -> None:
        if s:
            here.parts.append(Linked(s) if links else s)

    def close(last: Node) -> Node:
        """Closes what is open down to ``last``, itself included."""
        node = here
        while True:
            open_[node.tag] -= 1
            if node is last:
                return last.up
            node = node.up

    while at < n:
        m = _TAG.search(text, at)
        if not m:
            add(text[at:])
            break
        add(text[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:-3])
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif open_[tag] > 0:
                node = here
                while node.tag != tag:
                    node = node.up
                here = close(node)
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(text, at)
            at = end.end() if end else n
            here.controls += tag in ("textarea", "select")
            continue
        if tag in _VOID:
            if tag in ("br", "hr"):
                here.parts.append(" ")
            here.controls += tag == "input"
        elif tag == "a":
            links += 1
            here.inside += 1
        elif tag in _BLOCKS or "-" in tag:
            links = 0
            if tag in _CLOSES_P and open_["p"] > 0:
                node = here
                while node.up is not None and node.tag not in _SCOPE and node.tag not in ("li", "td", "th", "dd"):
                    if node.tag == "p":
                        here = close(node)
                        break
                    node = node.up
            for other in _SELF_CLOSING.get(tag, ()):
                if open_[other] > 0:
                    node = here
                    while node.up is not None and node.tag not in _SCOPE:
                        if node.tag == other:
                            here = close(node)
                            break
                        node = node.up
            if tag in ("html", "body"):
                continue
            open_[tag] += 1
            node = Node(tag, m[3], here)
            here.parts.append(node)
            here.below.append(node)
            here = node
        else:
            here.inside += 1
            here.controls += tag in ("button", "label", "option")
    return root


def settle(node: Node) -> None:
    """Each run of text beside block elements, and any in the root, becomes a node of its own, which is judged like the others."""
    if node.below or node.up is None:
        parts, run = [], []
        for part in [*node.parts, None]:
            if isinstance(part, str):
                run.append(part)
                continue
            if run and "".join(run).strip():
                text = Node("text", "", node)
                text.parts = run
                parts.append(text)
            run = []
            if part is not None:
                parts.append(part)
        node.parts = parts
        node.below = [p for p in parts]
        return
    for part in node.parts:
        if part != " ":
            node.length += len(part)
            node.commas += part.count(",")
            if isinstance(part, Linked):
                node.linked += len(part)


def flat(root: Node) -> list[Node]:
    """The nodes, parents first; sums of what is below are made on the way."""
    nodes = [root]
    for node in nodes:
        settle(node)
        nodes.extend(node.below)
    for node in reversed(nodes):
        node.paragraphs += node.tag == "p"
        if node.up is not None:
            up = node.up
            up.length += node.length
            up.linked += node.linked
            up.inside += node.inside + 1
            up.controls += node.controls
            up.paragraphs += node.paragraphs
            up.commas += node.commas
    for i, node in enumerate(nodes):
        node.number = i
    return nodes


def node_features(nodes: list[Node]) -> np.ndarray:
    """One row for each node: its tag and attribute tokens, those of its ancestors, depth, density of text and links in its subtree, and its siblings."""
    x = np.zeros((len(nodes), len(FEATURES)), np.float32)
    k, t = len(_TAGS), len(TOKENS)
    above = k + t
    marks = above + t
    rest = marks + 7
    whole = max(1, nodes[0].length)
    for i, node in enumerate(nodes):
        row = x[i]
        row[_TAG_NUMBER.get(node.tag, 3)] = 1
        for token in node.tokens:
            row[k + token] = 1
        depth = 0
        if node.up is not None:
            up = x[node.up.number]
            row[above:marks] = np.maximum(up[above:marks], up[k:above])
            row[marks : marks + 7] = up[marks : marks + 7]
            if node.up.tag in ("article", "main", "nav", "header", "footer", "aside", "form"):
                row[marks + ("article", "main", "nav", "header", "footer", "aside", "form").index(node.up.tag)] = 1
            depth = up[rest] + 1
        row[rest + 12 : rest + 14] = row[k + 1 : above].any(), row[above + 1 : marks].any() or row[marks + 2 : marks + 7].any()
        length = max(1, node.length)
        row[rest : rest + 7] = depth, np.log1p(node.length), node.linked / length, node.length / whole, np.log1p(node.length / (1 + node.inside)), np.log1p(node.inside), node.controls
        row[rest + 10 : rest + 12] = node.paragraphs, min(0.1, node.commas / length)
        for j, child in enumerate(node.below):
            x[child.number][rest + 7 : rest + 10] = j / len(node.below), len(node.below), child.length / length
    return x


class Trees:
    """Gradient-boosted regression trees with logistic loss; splits at quantiles of the features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> None:
        self.base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        self.depth, self.trees = depth, []
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 24))) for j in range(x.shape[1])]
        bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        f = np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            gradient, curve = y - p, p * (1 - p)
            feature, cut, value = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf, np.float32), np.zeros(2**depth)
            at = np.zeros(len(y), np.int64)
            for spot in range(2**depth - 1):
                rows = np.flatnonzero(at == spot)
                best = (1e-6, None, None)
                if len(rows) >= 4:
                    total_g, total_h = gradient[rows].sum(), curve[rows].sum()
                    for j, c in enumerate(cuts):
                        b = bins[rows, j]
                        g, h = (np.cumsum(np.bincount(b, w[rows], len(c) + 1))[:-1] for w in (gradient, curve))
                        gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
                        m = int(gain.argmax()) if len(gain) else 0
                        if len(gain) and gain[m] > best[0]:
                            best = (gain[m], j, c[m])
                if best[1] is not None:
                    feature[spot], cut[spot] = best[1], best[2]
                at[rows] = 2 * spot + 1 + (x[rows, feature[spot]] > cut[spot])
            leaf = at - (2**depth - 1)
            for v in range(2**depth):
                rows = leaf == v
                value[v] = rate * gradient[rows].sum() / (curve[rows].sum() + 1)
            f += value[leaf]
            self.trees.append((feature, cut, value))

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log-odds that a node belongs to the main text."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += value[at - (2**self.depth - 1)]
        return out


def chosen(nodes: list[Node], margins: np.ndarray) -> list[bool]:
    """The likeliest labels in which no node is main text below one that isn't: best sums from the leaves up, choices from the root down."""
    for node in reversed(nodes):
        node.gain = float(margins[node.number]) + sum(max(0.0, c.gain) for c in node.below)
    keep = [False] * len(nodes)
    keep[0] = True  # the root holds both; what it keeps is decided below it
    for node in nodes[1:]:
        keep[node.number] = keep[node.up.number] and node.gain > 0
    return keep


def block_texts(root: Node, keep: list[bool]) -> Iterator[str]:
    """Texts of the kept blocks in page order: character references decoded, white space made one space, trimmed."""
    run: list[str] = []
    stack: list[Iterator] = [iter(root.parts)]
    holders = [root]
    while stack:
        part = next(stack[-1], None)
        if isinstance(part, str):
            run.append(part)
            continue
        if run:
            if clean := _SPACE.sub(" ", entities.unescape("".join(run))).strip():
                yield clean
            run = []
        if part is None:
            stack.pop()
            holders.pop()
        elif keep[part.number]:
            stack.append(iter(part.parts))
            holders.append(part)


def sample_page(r: random.Random) -> str:
    """A made-up page; the texts of main blocks begin with ``MARK``, which the model doesn't see."""

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(1, 10))) + r.choice(["", "", "", ",", "."]) for _ in range(r.randint(lo, hi)))

    def main(lo: int, hi: int) -> str:
        return MARK + words(lo, hi)

    def link() -> str:
        return f'<a href="/{words(1, 1)}">{words(1, 3)}</a>'

    def named(*names: str) -> str:
        return r.choice(["", f' class="{r.choice(names)}"', f' id="{r.choice(names)}"', f' class="x {r.choice(names)}"'])

    def menu() -> str:
        inner = "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 9))) + "</ul>"
        return r.choice([f"<nav>{inner}</nav>", f'<div class="{r.choice(TOKENS["menu"])}">{inner}</div>'])

    def paragraphs(n: int) -> str:
        out = ""
        for _ in range(n):
            size = r.choice([(1, 4), (8, 40), (30, 120), (100, 300)])
            body = main(*size)
            out += r.choice([f"<p>{body}</p>"] * 6 + [f"<p><b>{body}<br>", f"<p>{body} <a href='#'>{words(1, 2)}</a> {words(3, 9)}</p>", f"<blockquote>{body}</blockquote>", f"<h2>{main(1, 6)}</h2><p>{body}</p>", f"<ul><li>{main(2, 12)}</li><li>{main(2, 12)}</li></ul>", linked(), f"<div>{body}</div>", f"<pre>{body}</pre>"])
        return out

    def linked() -> str:
        """A list that is part of the text though its entries are links."""
        tag = r.choice(["ul", "ol"])
        return f"<{tag}>" + "".join(f'<li><a href="/{words(1, 1)}">{main(1, 6)}</a>{r.choice(["", "", words(1, 8)])}</li>' for _ in range(r.randint(2, 12))) + f"</{tag}>"

    def loose(n: int) -> str:
        """Running text without paragraph elements."""
        between = r.choice(["<br>", "<br><br>\n", "\n<hr>"])
        way = r.choice(["plain", "span", "font"])
        lines = [main(*r.choice([(4, 20), (20, 90)])) for _ in range(n)]
        return between.join(x if way == "plain" else f"<{way}>{x}</{way}>" for x in lines)

    def noise(kind: str) -> str:
        name = r.choice(TOKENS[kind])
        body = r.choice([words(2, 40), f"<p>{words(3, 30)}</p>", f"<p>{words(2, 12)} {link()}</p>", f"<h3>{words(1, 4)}</h3><p>{words(3, 30)}</p>"])
        tag = r.choice(["div", "div", "section", "aside" if kind in ("side", "advert") else "div"])
        return f'<{tag} {r.choice(["class", "id"])}="{name}">{body}</{tag}>'

    head = f"<html><head><title>{words(2, 6)}</title><style>p{{margin:0}}</style><script>var a='</p>';</script></head><body>"
    top = r.choice([menu(), f"<header>{words(1, 5)}{menu()}</header>", f'<header{named("site", "masthead")}><h1>{words(1, 4)}</h1>{menu()}</header>', "", " | ".join(link() for _ in range(r.randint(2, 7)))])
    extra = "".join(noise(r.choice(["advert", "notice", "menu"])) for _ in range(r.randint(0, 2)))
    inner = (f"<h1>{main(2, 12)}</h1>" if r.random() < 0.8 else "") + paragraphs(r.randint(0, 9))
    if r.random() < 0.25:
        inner += noise(r.choice(["advert", "menu", "notice"])) + paragraphs(r.randint(1, 4))
    where = r.choice(["article"] * 8 + ["main", "div", "section"] * 2 + ["body"] * 3 + ["loose"] * 3)
    if where == "body":  # no element around the article
        body = inner
    elif where == "loose":
        body = (f"<h1>{main(2, 12)}</h1>" if r.random() < 0.6 else "") + r.choice(["{}", "<div>{}</div>", "<article>{}</article>", "<story-body>{}</story-body>", "<center>{}</center>"]).format(loose(r.randint(1, 6)))
    else:
        label = named(*TOKENS["content"][:10]) if where in ("article", "main") else f' class="{r.choice(TOKENS["content"])}"'
        body = f"<{where}{label}>{inner}</{where}>"
    if r.random() < 0.1:
        body = f"<table><tr><td>{menu()}</td><td>{body}</td></tr></table>"
    if r.random() < 0.25:
        body = f'<main>{body}{"".join(noise("comments") for _ in range(r.randint(0, 2)))}</main>'
    if r.random() < 0.15:
        body = f'<div{named("page", "wrapper", "container")}>{body}</div>'
    after = "".join(r.choice([lambda: f"<aside><h3>{words(1, 3)}</h3><p>{words(3, 40)}</p></aside>", lambda: noise("side"), lambda: noise("comments"), lambda: f'<form><label>{words(1, 2)}</label><input name="q"><button>{words(1, 1)}</button><p>{words(2, 10)}</p></form>', lambda: noise("notice"), lambda: f'<div class="comments"><h3>{words(1, 2)}</h3>' + "".join(f'<div class="comment"><p>{words(3, 60)}</p></div>' for _ in range(r.randint(1, 4))) + "</div>"])() for _ in range(r.randint(0, 3)))
    foot = r.choice([f"<footer>&copy; {words(1, 12)}</footer>", f"<footer><p>{words(1, 9)}</p>{menu()}</footer>", f'<div id="footer">{words(2, 9)}</div>', "", f"&copy; {words(1, 4)}", f"{link()} - {link()} &copy; {words(1, 3)}"])
    tail = r.choice(["</body></html>", "</body></html>", ""])
    if r.random() < 0.1:  # nothing but running text
        return r.choice([head, "", "<body>"]) + r.choice(["", f"<h1>{main(2, 12)}</h1>"]) + loose(r.choice([1, 1, 2, 3])) + tail
    return head + top + extra + body + after + foot + tail


@functools.cache
def trained() -> Trees:
    """The model, fitted on ``SAMPLE_PAGES`` made-up pages; the same on each run."""
    r = random.Random(3)
    xs, ys = [], []
    for _ in range(SAMPLE_PAGES):
        page = sample_page(r)
        nodes = flat(parse(page.replace(MARK, "")))
        xs.append(node_features(nodes)[1:])
        ys += marked(page)[1:]
    return Trees(np.concatenate(xs), np.array(ys, float))


def marked(page: str) -> list[bool]:
    """Which nodes of a made-up page hold marked text, themselves or further down, in the order of flat()."""
    nodes = flat(parse(page))
    found = [any(isinstance(p, str) and MARK in p for p in node.parts) for node in nodes]
    for node in reversed(nodes[1:]):
        found[node.up.number] |= found[node.number]
    return found


def main_texts(pages: list[str | None], model: Trees) -> list[str]:
    """The main text of each page; the nodes of all pages are scored together."""
    trees = [flat(parse(p or "")) for p in pages]
    out: list[str] = []
    x = [node_features(nodes) for nodes in trees]
    margins = model.margins(np.concatenate(x)) if x else np.empty(0)
    at = 0
    for nodes in trees:
        keep = chosen(nodes, margins[at : at + len(nodes)])
        at += len(nodes)
        out.append(" ".join(block_texts(nodes[0], keep)))
    return out


def extract(pages: DataFrame, together: int = 64) -> DataFrame:
    """(page_id, url, text, n_chars) for each row: the main text of the whole html, n_chars its code points.

    Null, empty or text-free html: empty text. Null page_id or url: kept. Repeated rows: rows of their own. Empty table: empty result.
    Pages are handled ``together`` at a time, so memory is bounded by a few pages.
    """
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, together):
                part = batch.slice(i, together)
                texts = main_texts(part.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
