"""Main text of web pages: a graphical model over the DOM tree, with sum-product messages up and down."""

import html
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAINING_PAGES = 400
SEED = 4
_TOKEN = re.compile(r"<!--[\s\S]*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# Names of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr picture source".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp".split())
UNSEEN = frozenset("noscript template select option optgroup datalist button svg math iframe object canvas audio video".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}}
HOLDS = frozenset("ul ol dl table section article div main body td th aside nav form header footer blockquote".split())
TAGS = frozenset("html body article main section div p h1 h2 h3 h4 ul ol li dl dt dd table tr td th nav header footer aside form blockquote pre figure figcaption address fieldset details dialog menu center".split())
WORDS = (
    "nav menu header masthead footer foot sidebar side aside ad ads advert advertisement banner promo sponsor sponsored cookie consent gdpr notice alert popup modal overlay comment comments reply respond disqus "
    "share social related recommended breadcrumb breadcrumbs pagination pager login signup form search subscribe newsletter widget toolbar tags meta byline copyright content article post entry main body story text"
).split()


@lru_cache(20_000)
def element_features(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag and the known words in an element's class, id and role."""
    found = {f"tag:{tag if tag in TAGS else 'other'}"}
    for m in _ATTRIBUTE.finditer(attributes):
        for word in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", m[1] or m[2] or m[3] or "").lower()):
            if word in _KNOWN:
                found.add(f"word:{word}")
    return tuple(sorted(found))


_KNOWN = frozenset(WORDS)
#: Unseen elements within each other that are told apart; deeper ones end with these.
DEEPEST = 64


@lru_cache(None)
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\b[^>]*>?", re.I)


@lru_cache(None)
def _next_of(name: str) -> re.Pattern:
    """The next start or end tag of an element; group 1 tells which."""
    return re.compile(rf"<(/?){name}\b", re.I)


class Tree:
    """Elements that hold blocks, and the blocks of text as their leaves, in page order; parents come before children."""

    def __init__(self, page: str):
        self.parent = [-1]
        self.features: list[tuple[str, ...]] = [("tag:html",)]
        self.text: list[str | None] = [None]
        self.tags = ["html"]
        stack, run, linked, in_link = [0], [], 0, 0
        opened: Counter = Counter()
        muted: list[tuple[str, int, bool]] = []  # open unseen elements: name, depth, and whether an end tag follows

        def flush() -> None:
            nonlocal run, linked
            if run:
                text = " ".join(html.unescape("".join(run)).split())
                if text:
                    self._add(stack[-1], leaf_features(text, linked, self.tags[stack[-1]]), text, "")
            run, linked = [], 0

        def cut(depth: int) -> None:
            opened.subtract(self.tags[k] for k in stack[depth:])
            del stack[depth:]
            while muted and muted[-1][1] > depth:
                muted.pop()

        at, n = 0, len(page)
        while at < n:
            m = _TOKEN.search(page, at)
            text = page[at : m.start() if m else n]
            if text and not muted:
                run.append(text)
                if in_link:
                    linked += len(text.split())
            if not m:
                break
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name, closing, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
            if name in RAW:
                if not closing and not (attributes.endswith("/") and name != "script"):
                    end = _end_of(name).search(page, at)
                    at = end.end() if end else n
            elif name in UNSEEN:
                if closing:
                    if k := next((k for k in range(len(muted), 0, -1) if muted[k - 1][0] == name), 0):
                        del muted[k - 1 :]
                elif not attributes.endswith("/"):
                    following = _next_of(name).search(page, at)
                    if len(muted) < DEEPEST:
                        muted.append((name, len(stack), bool(following and following[1])))
            elif name == "a":
                in_link = 0 if closing else 1
            elif name in INLINE:
                continue
            elif name == "br":
                run.append(" ")
            elif closing:
                if opened[name] > 0 or not muted:
                    flush()
                    in_link = 0
                if opened[name] > 0:
                    k = len(stack) - 1
                    while self.tags[stack[k]] != name:
                        k -= 1
                    cut(k)
            else:
                while muted and not muted[-1][2]:  # a block ends an unseen element that has no end tag
                    muted.pop()
                if muted:
                    continue
                flush()
                if name in ("html", "head"):
                    continue
                closed = CLOSES.get(name, ())
                while len(stack) > 1 and (self.tags[stack[-1]] == "p" or self.tags[stack[-1]] in closed):
                    cut(len(stack) - 1)
                if any(opened[c] > 0 for c in closed):
                    for k in range(len(stack) - 1, 0, -1):
                        if self.tags[stack[k]] in closed:
                            cut(k)
                            break
                        if self.tags[stack[k]] in HOLDS:
                            break
                if name not in VOID and not attributes.endswith("/"):
                    stack.append(self._add(stack[-1], element_features(name, attributes), None, name))
                    opened[name] += 1
        flush()

    def _add(self, parent: int, features: tuple[str, ...], text: str | None, tag: str) -> int:
        self.parent.append(parent)
        self.features.append(features)
        self.text.append(text)
        self.tags.append(tag)
        return len(self.parent) - 1


def leaf_features(text: str, linked: int, tag: str) -> tuple[str, ...]:
    """One feature for the shape of a block (share of linked words, length, end), and its sign of copyright."""
    words = text.count(" ") + 1
    share = linked / words
    links = "none" if not share else "some" if share < 0.4 else "many" if share < 0.8 else "all"
    length = "2" if words <= 2 else "5" if words <= 5 else "12" if words <= 12 else "30" if words <= 30 else "more"
    shape = f"shape:{links}/{length}/{'stop' if text[-1] in '.!?…。' else 'other'}"
    return (shape, "sign:copyright") if "©" in text else (shape,)


#: Labels of a node: no main text below, some, nothing else. A block of text is NONE or ALL.
NONE, SOME, ALL = 0, 1, 2


class TreeModel:
    """Node potentials P(features | label) and edge potentials P(label | parent's label), counted on labelled trees with smoothing."""

    def __init__(self, pages: list[tuple[str, set[str]]]):
        """pages: HTML, and the blocks of its main text."""
        seen: dict[tuple[str, int], float] = {}
        total = {(k, y): 1.0 for k in (0, 1) for y in (0, 1, 2)}
        edges = np.full((2, 3, 3), 0.1)
        edges[1, :, SOME] = 0
        for page, content in pages:
            tree = Tree(page)
            below = np.zeros((len(tree.parent), 2))
            for i in range(len(tree.parent) - 1, -1, -1):
                if tree.text[i] is not None:
                    below[i, int(tree.text[i] in content)] += 1
                if i:
                    below[tree.parent[i]] += below[i]
            label = [SOME if a and b else ALL if b else NONE for a, b in below.tolist()]
            for i, y in enumerate(label):
                kind = int(tree.text[i] is not None)
                total[kind, y] += 1
                for f in tree.features[i]:
                    seen[f, y] = seen.get((f, y), 0.0) + 1
                if i:
                    edges[kind, label[tree.parent[i]], y] += 1
        leaf = ("shape:", "sign:")
        self.potential = {f: tuple((seen.get((f, y), 0.0) + 0.3) / (total[int(f.startswith(leaf)), y] + 1) for y in (0, 1, 2)) for f in sorted({f for f, _ in seen})}
        self.edges = (edges / edges.sum(axis=2, keepdims=True)).tolist()

    def marginals(self, tree: Tree) -> list[tuple[float, float, float]]:
        """Chances of the labels of every node: messages from the leaves to the root, and back."""
        n, parent, known = len(tree.parent), tree.parent, self.potential
        tables = [self.edges[text is not None] for text in tree.text]
        held: list[tuple[float, float, float]] = []
        for features in tree.features:
            x = y = z = 1.0
            for f in features:
                if p := known.get(f):
                    x, y, z = x * p[0], y * p[1], z * p[2]
            held.append((x, y, z))
        sent: list[tuple[float, float, float]] = [(1.0, 1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            x, y, z = held[i]
            scale = x + y + z
            x, y, z = held[i] = x / scale, y / scale, z / scale
            a, b, c = sent[i] = tuple([r[0] * x + r[1] * y + r[2] * z for r in tables[i]])
            x, y, z = held[parent[i]]
            x, y, z = x * a, y * b, z * c
            scale = x + y + z
            held[parent[i]] = (x / scale, y / scale, z / scale)
        x, y, z = held[0]
        scale = x + y + z
        held[0] = (x / scale, y / scale, z / scale)
        for i in range(1, n):  # the parent's chances are final by now
            a, b, c = (p / m for p, m in zip(held[parent[i]], sent[i], strict=True))
            r, s, t = tables[i]
            x, y, z = held[i]
            x, y, z = x * (a * r[0] + b * s[0] + c * t[0]), y * (a * r[1] + b * s[1] + c * t[1]), z * (a * r[2] + b * s[2] + c * t[2])
            scale = x + y + z
            held[i] = (x / scale, y / scale, z / scale)
        return held

    def main_text(self, page: str) -> str:
        tree = Tree(page)
        return "\n".join(t for t, p in zip(tree.text, self.marginals(tree), strict=True) if t is not None and p[ALL] >= 0.5)


def labelled_pages(count: int = TRAINING_PAGES, seed: int = SEED) -> list[tuple[str, set[str]]]:
    """Made-up pages with the blocks of their articles: layouts, names and depths vary, words mean nothing."""
    rng = np.random.default_rng(seed)
    serial = [0]
    pick = lambda *x: x[int(rng.integers(len(x)))]
    chance = lambda p: rng.random() < p

    def words(low, high):
        serial[0] += 1
        return " ".join([f"x{serial[0]}", *("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(int(rng.integers(low, high))))])

    def sentence(low, high):
        return words(low, high).capitalize() + pick(".", ".", ".", "!", "?", "")

    def links(low, high, tag="ul"):
        items = [f'<a href="/{k}">{words(0, 3)}</a>' for k in range(int(rng.integers(low, high)))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if tag == "ul" else " ".join(items)

    def named(tag, names, inside):
        return f'<{tag} {pick("class", "id")}="{pick(*names)}">{inside}</{tag}>'

    def side_part():
        text = "".join(f"<p>{sentence(4, 40)}</p>" for _ in range(int(rng.integers(1, 4))))
        return pick(
            lambda: f"<nav>{links(2, 9, pick('ul', 'a'))}</nav>",
            lambda: named("div", ("nav", "menu", "top-menu", "navbar"), links(2, 9, pick("ul", "a"))),
            lambda: named("ul", ("breadcrumb", "breadcrumbs", "pagination"), "".join(f"<li><a>{words(0, 2)}</a></li>" for _ in range(3))),
            lambda: f"<header>{pick('<h1>', '<p>', '<div>')}{words(0, 5)}</header>",
            lambda: named("div", ("header", "masthead", "site-header"), words(1, 8)),
            lambda: f"<aside>{pick('', '<h3>' + words(0, 3) + '</h3>')}{pick(text, links(2, 6))}</aside>",
            lambda: named("div", ("sidebar", "side", "widget", "left-sidebar"), pick(text, links(2, 6))),
            lambda: named("div", ("ad", "ads", "advert", "ad-slot", "banner", "promo", "sponsored"), pick(text, sentence(3, 25), words(2, 12))),
            lambda: named("div", ("cookie", "cookie-notice", "consent", "notice", "alert", "popup", "gdpr-banner"), pick(text, sentence(5, 30))),
            lambda: f"<form>{sentence(2, 12)}<label>{words(1, 4)}</label><input><button>go</button></form>",
            lambda: named("div", ("newsletter", "subscribe", "login", "search-form"), sentence(3, 20)),
            lambda: named(pick("section", "div"), ("comments", "comment-list", "respond", "disqus"), f"<h3>{words(0, 3)}</h3>" + "".join(pick(f'<div class="comment"><p>{sentence(4, 50)}</p></div>', f"<p>{sentence(4, 50)}</p>", f"<li>{sentence(3, 40)}</li>") for _ in range(int(rng.integers(1, 5))))),
            lambda: named("div", ("related", "recommended", "share", "social"), pick(links(2, 6), text)),
        )()

    def footer():
        inside = pick("&copy; " + words(2, 8), "&copy; " + sentence(3, 20), links(2, 6, "a"), f"<p>{sentence(3, 30)}</p>")
        return pick(lambda: f"<footer>{inside}</footer>", lambda: named("div", ("footer", "site-footer", "copyright"), inside))()

    def article(content):
        def block(tag, low=4, high=70):
            text = sentence(low, high)
            content.add(text)
            shown = text if chance(0.7) else text.replace(" ", " <b>", 1) + pick("</b>", "")
            return pick(f"<{tag}>{shown}</{tag}>", f"<{tag}>{shown}</{tag}>", f"<{tag}>{shown}" if tag == "p" else f"<{tag}>{shown}</{tag}>")

        parts = [block(pick("h1", "h1", "h2"), 1, 12)] if chance(0.9) else []
        if parts and chance(0.15):
            parts = ["<header>" + parts[0] + "</header>"]
        for _ in range(int(rng.integers(1, 12))):
            kind = rng.random()
            if kind < 0.76:
                parts.append(block("p", 0 if chance(0.15) else 4, 90))
            elif kind < 0.82:
                parts.append(block(pick("h2", "h3"), 1, 8))
            elif kind < 0.88:
                parts.append("<ul>" + "".join(block("li", 2, 20) for _ in range(3)) + "</ul>")
            elif kind < 0.92:
                parts.append(block(pick("blockquote", "pre"), 4, 40))
            elif kind < 0.95:
                parts.append("<table><tr>" + block("td", 0, 4) + block("td", 0, 4) + "</tr></table>")
            else:
                parts.append(side_part())
        inside = "".join(parts)
        return pick(
            lambda: f"<article>{inside}</article>",
            lambda: f"<article>{inside}</article>",
            lambda: f"<main>{inside}</main>",
            lambda: f"<main><article>{inside}</article></main>",
            lambda: named("div", ("content", "main-content", "post", "entry-content", "article-body", "story"), inside),
            lambda: f"<section>{inside}</section>",
            lambda: f"<div>{inside}</div>",
        )()

    pages = []
    for _ in range(count):
        content: set[str] = set()
        before = [side_part() for _ in range(int(rng.integers(0, 4)))]
        after = [side_part() for _ in range(int(rng.integers(0, 3)))]
        body = "".join([*before, article(content), *after, footer() if chance(0.8) else ""])
        for _ in range(int(rng.integers(0, 3))):
            body = pick(f"<div>{body}</div>", named("div", ("page", "wrapper", "container"), body))
        pages.append((f"<html><head><title>{words(2, 6)}</title></head><body>{body}</body></html>", content))
    return pages


@lru_cache(1)
def trained_model() -> TreeModel:
    """The model of the made-up labelled pages; tasks get its few hundred numbers."""
    return TreeModel(labelled_pages())


def main_texts(pages: DataFrame, model: TreeModel | None = None, html_col: str = "html") -> DataFrame:
    """`pages` without `html_col`, with text and n_chars: the main text of every page, from the whole of its HTML.

    Blocks (what block elements part) are joined by line ends in page order; white space in a block is one blank; character
    references are decoded; scripts, styles, form fields and the like are never text. Of these, only scripts, styles, titles
    and text areas without an end tag reach to the end of the page; others end with the element that they stand in or, if no
    end tag follows, at the next block. A null or empty page, or one without an article, has an empty text. No shuffle: a
    page is one row, so no key is hot.
    """
    names = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    fitted = model or trained_model()

    def extract(batches):
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                found = pa.array([fitted.main_text(x) if x else "" for x in part.column(html_col).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), found, pc.utf8_length(found).cast(pa.int64())], [*names, "text", "n_chars"])

    kinds = dict(pages.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "text string", "n_chars long"])
    return pages.select(*names, F.col(html_col)).mapInArrow(extract, schema)
