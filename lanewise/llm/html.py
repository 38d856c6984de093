"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks. Each block is described by its words and link density, those of its neighbours,
and marks of the elements around it. A decision tree, trained on a small labelled table, tells content from boilerplate.
The table is made by rule from page layouts (`training_pages`); the tree is fitted when it is first needed.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm._common import table

# Element names of the HTML standard.
RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "textarea", "title", "object", "canvas", "video", "audio", "select", "button"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CONTAINERS = {"html", "body", "nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "ul", "ol", "dl", "table", "blockquote", "figure", "fieldset", "details", "dialog", "menu", "address"}
BLOCKS = CONTAINERS | HEADINGS | {"p", "li", "td", "th", "tr", "dt", "dd", "pre", "hr", "figcaption", "caption", "summary", "legend", "label", "option", "head", "thead", "tbody", "tfoot"}
OUTSIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
_NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
_NOISE = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu|header|masthead|footer|sidebar|side|aside|widget|related|recommend\w*|share|social|cookies?|consent|notice|alert|gdpr|popup|modal|overlay|newsletter|subscribe|"
    r"subscription|signup|sign-up|login|search\w*|form|comments?|commentlist|replies|reply|respond|disqus|discussion|breadcrumbs?|pagination|pager|copyright|legal|disclaimer|toolbar|skip|tags)(?:$|[^a-z])"
)
_CONTENT = re.compile(r"(?:^|[^a-z])(?:article\w*|content|post|entry|story|main|text|body|prose)(?:$|[^a-z])")

FEATURES = ["words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "outside", "noise", "in_article", "named_content", "page_has_article", "heading", "paragraph", "item", "ends_sentence", "place"]


class Block:
    """Text of a block, its words and linked words, and marks of the elements around it."""

    __slots__ = ("text", "words", "linked", "tag", "outside", "noise", "article", "named")

    def __init__(self, text: str, words: int, linked: int, tag: str, outside: bool, noise: bool, article: bool, named: bool):
        self.text, self.words, self.linked, self.tag = text, words, linked, tag
        self.outside, self.noise, self.article, self.named = outside, noise, article, named


def _marks(name: str, attributes: str, above: tuple[bool, bool, bool, bool]) -> tuple[bool, bool, bool, bool]:
    """(outside, noise, article, named) inside an element that stands in elements with the marks above."""
    outside, noise, article, named = above
    names = " ".join(x.strip("\"'") for x in _NAMES.findall(attributes)).lower() if attributes else ""
    article |= name in ("article", "main")
    return (outside or (name in OUTSIDE and not (name == "header" and article)), noise or bool(names and _NOISE.search(names)), article, named or bool(names and _CONTENT.search(names)))


def blocks(page: str) -> list[Block]:
    """Flat text blocks of a page, in order; character references decoded, white space inside a block made one space."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[bool, bool, bool, bool]]] = [("", (False, False, False, False))]
    text: list[str] = []
    linked: list[str] = []
    opened: dict[str, int] = {}  # containers on the stack by name, so that an end tag without a start costs one look
    tag, links, at, lower = "", 0, 0, None

    def flush() -> None:
        if text:
            words = entities.unescape("".join(text)).split()
            if words:
                n = len(entities.unescape(" ".join(linked)).split())
                out.append(Block(" ".join(words), len(words), min(n, len(words)), tag, *stack[-1][1]))
            text.clear()
            linked.clear()

    size = len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        end = found.start() if found else size
        if end > at:
            text.append(page[at:end])
            if links:
                linked.append(page[at:end])
        if not found:
            break
        at = found.end()
        closing, name, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not name:
            continue
        name = name.lower()
        if name in RAW:
            if not closing and not attributes.endswith("/"):
                lower = page.lower() if lower is None else lower
                if len(lower) != size:  # lower-casing can change the length of rare letters
                    stop = re.compile(f"</{name}", re.IGNORECASE).search(page, at)
                    close = stop.start() if stop else -1
                else:
                    close = lower.find(f"</{name}", at)
                at = page.find(">", close) + 1 if close >= 0 else size
                at = at or size
            continue
        if name == "a":
            links = 0 if closing else 1
            continue
        if name == "br":
            text.append(" ")
            continue
        if name not in BLOCKS:
            continue
        flush()
        links = 0
        tag = "" if closing else name
        if name in CONTAINERS:
            if stack[-1][0].startswith("/"):
                stack.pop()
            if not closing:
                stack.append((name, _marks(name, attributes, stack[-1][1])))
                opened[name] = opened.get(name, 0) + 1
            elif opened.get(name):
                while (gone := stack.pop()[0]) != name:
                    opened[gone] = opened.get(gone, 0) - 1
                opened[name] -= 1
        else:
            if stack[-1][0].startswith("/"):  # the marks of a paragraph or item end with it
                stack.pop()
            if not closing and attributes:
                marks = _marks(name, attributes, stack[-1][1])
                if marks != stack[-1][1]:
                    stack.append((f"/{name}", marks))
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    """One row of FEATURES per block."""
    n = len(found)
    words = np.array([b.words for b in found], float)
    density = np.array([b.linked / b.words for b in found], float)
    has = any(b.article for b in found)
    pad = lambda a: np.concatenate([[0.0], a, [0.0]])
    w, d = pad(words), pad(density)
    rows = [[b.outside, b.noise, b.article, b.named, has, b.tag in HEADINGS, b.tag == "p", b.tag == "li", b.text[-1] in ".!?…\"'”»)", i / max(1, n - 1)] for i, b in enumerate(found)]
    return np.column_stack([words, density, w[:-2], d[:-2], w[2:], d[2:], np.array(rows, float).reshape(n, -1)])


Tree = list[tuple[int, float, int, int]]  # (feature, cut, node if at most, node if over); a leaf is (-1, share of content, 0, 0)


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int = 9, leaf: int = 3) -> Tree:
    """Binary classification tree by Gini impurity."""
    nodes: Tree = []

    def grow(rows: np.ndarray, left: int) -> int:
        me = len(nodes)
        share = float(y[rows].mean())
        nodes.append((-1, share, 0, 0))
        best = (share * (1 - share) * len(rows) - 1e-9, -1, 0.0)
        if left and 0 < share < 1:
            for f in range(x.shape[1]):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v, t = x[order, f], y[order]
                ones, n = np.cumsum(t)[:-1], np.arange(1, len(order))
                rest, m = t.sum() - ones, len(order) - n
                impurity = ones * (1 - ones / n) + rest * (1 - rest / m)
                impurity[(v[1:] == v[:-1]) | (n < leaf) | (m < leaf)] = np.inf
                k = int(np.argmin(impurity)) if len(impurity) else -1
                if k >= 0 and impurity[k] < best[0]:
                    best = (float(impurity[k]), f, float((v[k] + v[k + 1]) / 2))
        if best[1] >= 0:
            inside = x[rows, best[1]] <= best[2]
            a = grow(rows[inside], left - 1)
            nodes[me] = (best[1], best[2], a, grow(rows[~inside], left - 1))
        return me

    grow(np.arange(len(y)), depth)
    return nodes


def is_content(tree: Tree, x: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), bool)
    for i, row in enumerate(x.tolist()):
        at = 0
        while tree[at][0] >= 0:
            f, cut, a, b = tree[at]
            at = a if row[f] <= cut else b
        out[i] = tree[at][1] >= 0.5
    return out


_MARK = "⁠"  # begins the text of labelled content


def training_pages(seed: int = 11, pages: int = 320) -> list[str]:
    """Small pages in several layouts; the text of each content block begins with a mark."""
    rng = np.random.default_rng(seed)
    pick = lambda *a: a[int(rng.integers(len(a)))]
    text = lambda lo, hi: " ".join("lorem" for _ in range(int(rng.integers(lo, hi + 1))))
    links = lambda n, sep: sep.join(f"<a href='/{i}'>{text(1, 3)}</a>" for i in range(n))
    listed = lambda n: "<ul>" + "".join(f"<li>{links(1, '')}</li>" for _ in range(n)) + "</ul>"

    def noise(kind: str) -> str:
        if kind == "nav":
            return pick(f"<nav>{listed(6)}</nav>", f"<div class='menu'>{listed(5)}</div>", f"<div>{links(6, ' | ')}</div>", f"<header><p>{text(1, 4)}</p>{listed(4)}</header>", f"<ul class='breadcrumbs'><li>{links(1, '')}</li><li>{text(1, 3)}</li></ul>")
        if kind == "ad":
            return pick(f"<div class='ad'>{text(3, 30)}.</div>", f"<div id='promo-banner'><p>{text(5, 40)}.</p></div>", f"<aside><p>{text(8, 120)}.</p></aside>", f"<section class='sponsored'><h3>{text(2, 5)}</h3><p>{text(5, 30)}.</p></section>")
        if kind == "notice":
            return pick(f"<div class='cookie-notice'><p>{text(10, 120)}.</p></div>", f"<div role='alert'>{text(4, 25)}.</div>", f"<form><label>{text(1, 4)}</label><p>{text(3, 100)}.</p></form>", f"<div class='newsletter'><p>{text(6, 25)}.</p></div>")
        if kind == "side":
            return pick(f"<aside>{listed(5)}</aside>", f"<div class='sidebar'><h3>{text(1, 3)}</h3><p>{text(5, 40)}.</p></div>", f"<div class='related'>{listed(4)}</div>", f"<ul>{''.join(f'<li>{links(1, chr(32))}</li>' for _ in range(5))}</ul>")
        if kind == "comments":
            return f"<{(t := pick('section', 'div'))} class='{pick('comments', 'comment-list', 'reader-comments')}'><h2>{text(1, 3)}</h2>" + "".join(f"<p>{text(4, 120)}.</p>" for _ in range(int(rng.integers(1, 5)))) + f"</{t}>"
        return pick(f"<footer>{text(3, 120)}.</footer>", f"<footer><p>{text(2, 12)}</p>{links(3, ' | ')}</footer>", f"<div class='footer'>{text(3, 20)}</div>", f"<div id='copyright'>{text(2, 8)}. {text(4, 20)}.</div>", f"<p>{links(4, ' ')}</p>")

    def content(lo: int = 1) -> str:
        body = [f"<h1>{_MARK}{text(2, 10)}.</h1>" if rng.random() < 0.8 else ""]
        for _ in range(int(rng.integers(2, 7))):
            kind, words = rng.random(), (lo, lo + 5) if rng.random() < 0.3 else (15, 90)
            linked = f" {links(1, '')} {text(2, 9)}" if rng.random() < 0.2 else ""
            body.append(f"<h2>{_MARK}{text(2, 6)}</h2>" if kind < 0.12 else f"<ul><li>{_MARK}{text(4, 12)}</li><li>{_MARK}{text(4, 12)}</li></ul>" if kind < 0.2 else f"<blockquote>{_MARK}{text(8, 30)}.</blockquote>" if kind < 0.26 else f"<p>{_MARK}{text(*words)}{linked}{pick('.', '.', '.', '', ',')}</p>")
        return "".join(body)

    def plain() -> str:
        """Neutral names and no article: only words and links, a block's own and its neighbours', tell content."""
        box = lambda inside: f"<div class='c{int(rng.integers(100))}'>{inside}</div>"
        ring = lambda: pick(links(1, ""), links(3, " | "), links(2, " ") + f" {text(1, 2)}")
        aside = lambda: box("".join(f"<p>{pick(ring(), ring(), text(1, 9) + pick('', '.'))}</p>" if i % 2 else f"<p>{ring()}</p>" for i in range(int(rng.integers(3, 8)))))
        body = "".join(f"<p>{_MARK}{text(*pick((2, 9), (18, 90), (18, 90)))}{pick('.', '.', '', '!')}</p>" if i % 2 else f"<p>{_MARK}{text(18, 90)}{f' {links(1, chr(32))} {text(4, 9)}' if rng.random() < 0.2 else ''}.</p>" for i in range(int(rng.integers(3, 9))))
        return "".join(aside() for _ in range(int(rng.integers(1, 3)))) + box(body) + "".join(aside() for _ in range(int(rng.integers(1, 3))))

    out = []
    for k in range(pages):
        if k % 20 == 0:  # a page of a few words has no article
            out.append(pick(text(1, 3), f"<p>{text(1, 4)}</p>", f"<div>{links(1, '')}</div>"))
            continue
        if rng.random() < 0.4:
            out.append(f"<html><head><title>{text(2, 6)}</title></head><body>{plain()}</body></html>")
            continue
        inner = lambda: noise(pick("ad", "notice", "side", "comments")) if rng.random() < 0.25 else ""
        layout = rng.random()
        if layout < 0.6:
            main = f"<article>{content()}{inner()}</article>"
        elif layout < 0.75:
            main = f"<main>{content()}{inner()}</main>"
        else:  # without an article element the tree has words and links to go by
            main = f"<div{pick('', ' class=content', ' class=post', '')}>{content(9)}{inner()}</div>"
        above = "".join(noise(k) for k in ("nav", "ad", "notice") if rng.random() < 0.6)
        below = "".join(noise(k) for k in ("comments", "side", "footer") if rng.random() < 0.6)
        out.append(f"<html><head><title>{text(2, 6)}</title></head><body>{above}{main}{below}</body></html>")
    return out


@cache
def trained_tree() -> tuple:
    """The tree of the labelled table."""
    x, y = [], []
    for page in training_pages():
        found = blocks(page)
        if found:
            y += [b.text.startswith(_MARK) for b in found]
            x.append(features(found))
    return tuple(fit_tree(np.concatenate(x), np.array(y, float)))


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    return " ".join(b.text for b, keep in zip(found, is_content(tree, features(found))) if keep)


def extracted(df: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """One row per row of df: id_col, the columns of keep, text (string) and n_chars (its code points).

    A null or empty html, and a page without content, gives an empty text. Broken, unclosed or cut markup is read as far
    as it goes. Repeated rows stay; an empty table gives an empty one. Other columns are not read.
    """
    tree = list(trained_tree())
    own = df.select(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate([id_col, *(keep or [])])]).alias("own"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py(), tree) for h in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["own", "text", "n_chars"])

    done = own.mapInArrow(run, f"own {own.schema['own'].dataType.simpleString()}, text string, n_chars long")
    return done.select(*[F.col(f"own.c{i}").alias(c) for i, c in enumerate([id_col, *(keep or [])])], "text", "n_chars")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"), keep=["url"])


QUERIES = {"op3_html_extraction": op3_html_extraction}
ORACLES: dict[str, str] = {}
