"""Main text of web pages by a tree-structured graphical model.

A page's block elements and runs of text are the nodes of a tree, each content or not. Node potentials come from a
node's own tag, class words and text; parent-child potentials tie neighbours together. Sum-product messages go from the
leaves up and from the root down, which gives every node's exact marginal; runs with a marginal of a half or more are the
text. All parameters are trained by the likelihood of fully labelled pages, which a seeded generator writes: articles
between menus, notices, adverts, sidebars, forms, comments and footers in many layouts.

Scale: one pass, no shuffle; messages of all pages of a slice are computed together, level by level. The model is a few
hundred numbers. Pages are never cut.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

OPENS = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
ENDS = re.compile("[\"'>]")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
WORDS = re.compile(r"[a-z]+")
# Element classes of HTML.
#: Their text is no markup; without an end they go on to the end of the page.
RAW = frozenset("script style textarea title iframe noscript xmp".split())
#: Left out whole where their end comes, for the second set before any block begins; else only the tag is.
DRAWN, CONTROLS = frozenset("svg template".split()), frozenset("button select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = "html head body main article section div nav header footer aside form p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption figure figcaption blockquote pre address details summary dialog fieldset legend center hr menu".split()
BLOCK = {tag: i for i, tag in enumerate(BLOCKS)}
ENDS_P = frozenset(BLOCKS) - {"html", "head", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption"}
#: Paragraph-like elements, which hold runs of text rather than other blocks.
LINES = frozenset("p li td th h1 h2 h3 h4 h5 h6 dt dd pre figcaption summary caption".split())
#: An element that ends open elements of these kinds, up to the nearest of the second set.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
STEMS = "nav menu foot head side aside ad ads advert sponsor promo banner cookie consent notice alert comment repl discuss share social relat recommend breadcrumb subscri newsletter popup modal widget tag meta byline login search form copyright legal article content post entry main body text story page wrap container".split()
EXACT = frozenset({"ad", "ads", "tag", "nav"})
LEAF_FEATURES = 10
#: Places of the features: bias, tags, other tag, stems, then those of runs of text.
TAG0, STEM0, LEAF0 = 1, 2 + len(BLOCKS), 2 + len(BLOCKS) + len(STEMS)
PLAIN = LEAF0 + LEAF_FEATURES  # an element that no name says anything about
WIDTH = PLAIN + 1
KINDS = 3  # parent-child potentials: a run of text; a paragraph-like element; any other


@lru_cache(maxsize=50_000)
def _stems(names: str) -> tuple[int, ...]:
    words = WORDS.findall(names.lower())
    return tuple(STEM0 + i for i, s in enumerate(STEMS) if any(w == s if s in EXACT else w.startswith(s) for w in words))


def _element(tag: str, attributes: str) -> list[int]:
    stems = _stems(" ".join(NAMES.findall(attributes))) if "=" in attributes else ()
    return [0, TAG0 + BLOCK.get(tag, len(BLOCKS)), *(stems or (PLAIN,))]


def _run(text: str, linked: int) -> list[int]:
    n, share = len(text), linked / max(1, len(text))
    stops = sum(map(text.count, ".,;:!?"))
    return [0, LEAF0, *(LEAF0 + 1 + k for k, least in enumerate((20, 60, 150, 400)) if n >= least), *([LEAF0 + 5] if share > 0.9 else [LEAF0 + 6] if share > 0.3 else []), *([LEAF0 + 7] if text[-1] in ".!?\"'»)…”" else []), *([LEAF0 + 8] if stops * 60 >= n else []), *([LEAF0 + 9] if "©" in text else [])]


class Page:
    """Reads a page's markup once from left to right; nothing is looked for twice, whatever is left open."""

    def __init__(self, page: str) -> None:
        self.page, self.last = page, page.rfind(">")
        self.unclosed: set[int] = set()  # quotes from which a tag never ends
        self.found: dict[str, tuple[int, re.Match | None]] = {}

    def tag_end(self, at: int) -> int:
        """Where the tag that goes on at `at` ends: behind the first > outside quotes, or the first at all; 0 if there is none."""
        if at > self.last:
            return 0
        passed, start = [], at
        while m := ENDS.search(self.page, at):
            if m[0] == ">":
                return m.end()
            if m.start() in self.unclosed:
                break
            passed.append(m.start())
            at = self.page.find(m[0], m.end()) + 1
            if not at:
                break
        self.unclosed.update(passed)
        return self.page.find(">", start) + 1

    def next(self, name: str, pattern: re.Pattern, at: int) -> re.Match | None:
        """The first match from `at` on, kept for later calls with the same name."""
        since, m = self.found.get(name, (0, None))
        if name not in self.found or (m and m.start() < at):
            m = pattern.search(self.page, at)
            self.found[name] = (at, m)
        return m

    def behind(self, tag: str, at: int, no_block: bool = False) -> int:
        """The end of the end tag of an element that is left out; 0 if it has none, or with no_block if a block begins before."""
        m = self.next(tag, re.compile(rf"</{tag}(?![a-z0-9-])" + ("|" + BLOCK_START if no_block else ""), re.I), at)
        if not m or not m[0].startswith("</"):
            return 0
        return self.tag_end(m.end()) or len(self.page)


BLOCK_START = rf"<(?:{'|'.join(BLOCKS)})(?![a-z0-9-])"


class Tree:
    """A page's nodes: parent, depth, kind, features; and the text of those that are runs."""

    def __init__(self, page: str) -> None:
        self.parent, self.depth, self.kind, self.features, self.text = [-1], [0], [2], [[0]], {}
        open_: list[tuple[str, int]] = [("", 0)]
        places: dict[str, list[int]] = {}  # of each open tag in open_
        held: list[str] = []
        linked, in_link = 0, False
        read = Page(page)

        def flush() -> None:
            nonlocal linked
            if held:
                text = " ".join("".join(held).split())
                held.clear()
                if text:
                    self.text[self.add(open_[-1][1], 0, _run(text, linked))] = text
            linked = 0

        def write(text: str) -> None:
            nonlocal linked
            held.append(html.unescape(text) if "&" in text else text)
            linked += len(text) * in_link

        def close(k: int) -> None:
            nonlocal in_link
            flush()
            for tag, _ in open_[k:]:
                places[tag].pop()
            del open_[k:]
            in_link = False

        def nearest(tags: set[str]) -> int:
            return max((places[t][-1] for t in tags if places.get(t)), default=0)

        at = begin = 0  # text from begin on isn't written yet
        n = len(page)
        while at < n:
            at = page.find("<", at)
            m = OPENS.match(page, at) if at >= 0 else None
            if at < 0:
                break
            if not m:
                at += 1
                continue
            shut, tag = m.groups()
            if tag is None:  # a comment or declaration
                end = page.find("-->", m.end()) + 3 if m[0] == "<!--" else page.find(">", m.end()) + 1
                end = n if end < 3 and m[0] == "<!--" or not end else end
            else:
                end = read.tag_end(m.end())
                if not end:  # a tag that never ends is text
                    at += 1
                    continue
            if begin < at:
                write(page[begin:at])
            attributes = page[m.end() : end - 1] if tag else ""
            at = begin = end
            if tag is None:
                continue
            tag = tag.lower()
            if tag in RAW or tag in DRAWN or tag in CONTROLS:
                if not shut and not attributes.endswith("/"):
                    at = begin = read.behind(tag, at, tag in CONTROLS) or (n if tag in RAW else at)
                held.append(" ")
            elif tag not in BLOCK:
                if tag == "br":
                    held.append(" ")
                elif tag == "a":
                    in_link = not shut
            elif shut:
                if places.get(tag):
                    close(places[tag][-1])
                else:
                    flush()
            else:
                if tag in ENDS_P and open_[-1][0] == "p":
                    close(len(open_) - 1)
                if tag in SIBLINGS:
                    ends, stop = SIBLINGS[tag]
                    k = nearest(ends)
                    if k > nearest(stop):
                        close(k)
                flush()
                if tag not in VOID:
                    places.setdefault(tag, []).append(len(open_))
                    open_.append((tag, self.add(open_[-1][1], 1 if tag in LINES else 2, _element(tag, attributes))))
        if begin < n:
            write(page[begin:])
        flush()

    def add(self, parent: int, kind: int, features: list[int]) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.kind.append(kind)
        self.features.append(features)
        return len(self.parent) - 1


class Forest:
    """Trees as arrays, for messages of all of them at once."""

    def __init__(self, trees: list[Tree]) -> None:
        sizes = np.array([len(t.parent) for t in trees], dtype=np.int64)
        self.base = np.cumsum(sizes) - sizes
        parent = np.concatenate([np.array(t.parent) + b for t, b in zip(trees, self.base, strict=True)])
        depth = np.concatenate([t.depth for t in trees])
        self.parent, self.kind = parent, np.concatenate([t.kind for t in trees])
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth))[:-1])
        counts = [len(f) for t in trees for f in t.features]
        self.features = np.array([x for t in trees for f in t.features for x in f], dtype=np.int64)
        self.starts = np.cumsum(counts) - counts
        self.owner = np.repeat(np.arange(len(counts)), counts)

    def marginals(self, weights: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each node, and P(parent's state, own state) of each but the roots. Messages are logarithms."""
        n = len(self.parent)
        up = np.zeros((n, 2))
        up[:, 1] = np.add.reduceat(weights[self.features], self.starts)
        tie, sent = ties[self.kind], np.zeros((n, 2))
        for level in self.levels[:0:-1]:
            both = up[level, None, :] + tie[level]
            sent[level] = np.logaddexp(both[:, :, 0], both[:, :, 1])
            np.add.at(up, self.parent[level], sent[level])
        full, pair = up.copy(), np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            both = (full[self.parent[level]] - sent[level])[:, :, None] + tie[level] + up[level, None, :]
            got = np.logaddexp(both[:, 0, :], both[:, 1, :])
            full[level] = got
            pair[level] = np.exp(both - np.logaddexp(got[:, 0], got[:, 1])[:, None, None])
        return 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -500, 500))), pair


def train(trees: list[Tree], labels: list[np.ndarray], steps: int = 200, rate: float = 0.1, prior: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ties with the highest likelihood of the labels under a normal prior, by Adam on exact gradients."""
    forest, y = Forest(trees), np.concatenate(labels).astype(float)
    child = np.concatenate([level for level in forest.levels[1:]])
    seen = np.zeros((KINDS, 2, 2))
    np.add.at(seen, (forest.kind[child], y[forest.parent[child]].astype(int), y[child].astype(int)), 1)
    target = np.r_[np.bincount(forest.features, weights=y[forest.owner], minlength=WIDTH), seen.ravel()]
    x, first, second = np.zeros(len(target)), np.zeros(len(target)), np.zeros(len(target))
    for k in range(1, steps + 1):
        p, pair = forest.marginals(x[:WIDTH], x[WIDTH:].reshape(KINDS, 2, 2))
        expected = np.zeros((KINDS, 2, 2))
        np.add.at(expected, forest.kind[child], pair[child])
        g = np.r_[np.bincount(forest.features, weights=p[forest.owner], minlength=WIDTH), expected.ravel()] - target + prior * x
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        x -= rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    return x[:WIDTH], x[WIDTH:].reshape(KINDS, 2, 2)


OPEN = "{{"  # in a generated page, runs of content begin with this mark; it is taken out before training


def labelled_pages(count: int = 400, seed: int = 11) -> list[str]:
    """Generated pages; each run of main text begins with OPEN."""
    rnd = np.random.default_rng(seed)
    pick = lambda *x: x[rnd.integers(len(x))]
    chance = lambda p: rnd.random() < p

    def prose(least: int, most: int, mark: bool = False) -> str:
        words = ["".join(pick("ka", "lo", "mi", "ter", "un", "ba", "sen", "vi") for _ in range(rnd.integers(1, 4))) for _ in range(rnd.integers(least, most))]
        text = " ".join(w + (pick(",", ".") if chance(0.12) else "") for w in words).capitalize() + pick(".", ".", ".", "", "!")
        return OPEN * mark + text

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{prose(1, 3)}</a></li>' for i in range(n)) + "</ul>"

    def named(tag: str, *names: str) -> str:
        return tag + (f' {pick("class", "id")}="{pick(*names)}"' if names else "")

    def box(head: str, inside: str) -> str:
        return f"<{head}>{inside}</{head.split()[0]}>"

    def advert() -> str:
        return box(named(pick("div", "div", "section", "aside"), "ad", "ads", "advert", "ad-slot", "sponsored", "promo-box", "banner"), pick(prose(3, 15), f"<p>{prose(3, 20)}</p>", f'<a href="#">{prose(2, 8)}</a>'))

    def notice() -> str:
        return box(named("div", "cookie-bar", "consent", "notice", "alert", "newsletter", "popup", "subscribe"), f"<p>{prose(5, 30)}</p>" + pick("", "<button>Ok</button>", f'<a href="#">{prose(1, 3)}</a>'))

    def comments() -> str:
        one = lambda: box(named(pick("div", "li", "article"), "comment", "comment-body", "reply"), f"<p>{prose(4, 60)}</p>" * rnd.integers(1, 3))
        return box(named(pick("section", "div"), "comments", "comment-list", "discussion", "replies"), f"<h3>{prose(1, 3)}</h3>" * chance(0.5) + "".join(one() for _ in range(rnd.integers(1, 6))))

    def aside() -> str:
        return box(pick("aside", named("div", "sidebar", "side", "related", "widget", "recommended"), named("aside", "sidebar", "related")), pick(links(4), f"<h3>{prose(1, 4)}</h3>" + links(3), f"<p>{prose(5, 40)}</p>"))

    def form() -> str:
        return box(pick("form", named("form", "search", "login", "newsletter-form")), f"<p>{prose(1, 12)}</p><input type=text>" + pick("", f"<label>{prose(1, 3)}</label>", "<button>Go</button>", f"<fieldset><legend>{prose(1, 3)}</legend></fieldset>", f"<select><option>{prose(1, 2)}</select>"))

    def lines(least: int, most: int) -> str:
        return "".join(f"<{(tag := pick('p', 'div', 'span'))}>{prose(least, most, True)}</{tag}><br>" for _ in range(rnd.integers(1, 4)))

    def inside(text: str) -> str:
        """Marks within a sentence."""
        return text + f" <math><mi>{prose(1, 2)}</mi><mo>=</mo></math> {prose(1, 6)}" * chance(0.05) + f" <code>{prose(1, 3)}</code> {prose(1, 4)}" * chance(0.08) + f' <a href="#">{prose(1, 3)}</a> {prose(2, 9)}' * chance(0.15)

    def titled(tag: str) -> str:
        return box(tag, prose(1, 9, True))

    def part(depth: int = 0) -> str:
        k = rnd.random()
        if k < 0.54:
            return f"<p>{inside(prose(4, 120, True))}" + pick("</p>", "</p>", "<br>")
        if k < 0.61:
            return titled(pick("h2", "h2", "h3", "h4", "h5", "h6"))
        if k < 0.67:
            return box(pick("ul", "ol"), "".join(f"<li>{pick(prose(1, 30, True), f'<p>{prose(1, 30, True)}</p>')}</li>" for _ in range(rnd.integers(1, 7))))
        if k < 0.71:
            return f"<blockquote>{pick(prose(4, 40, True), f'<p>{prose(4, 40, True)}</p>')}</blockquote>"
        if k < 0.75:
            return box(pick("pre", named("pre", "code", "listing")), pick(prose(1, 60, True), prose(1, 8, True)))
        if k < 0.79:
            return box("dl", "".join(f"<dt>{prose(1, 4, True)}</dt><dd>{prose(1, 30, True)}</dd>" for _ in range(rnd.integers(1, 5))))
        if k < 0.82:
            return box(pick("figure", named("figure", "image", "wp-block-image")), '<img src="x.png">' + box("figcaption", prose(1, 25, True)))
        if k < 0.84:
            return box("details", box("summary", prose(1, 8, True)) + pick(prose(3, 40, True), f"<p>{prose(3, 60, True)}</p>"))
        if k < 0.87:
            row = lambda tag: "".join(f"<{tag}>{prose(1, 6, True)}</{tag}>" for _ in range(rnd.integers(1, 4)))
            return box("table", box("caption", prose(1, 8, True)) * chance(0.3) + box("tr", row("th")) * chance(0.4) + "".join(box("tr", row("td")) for _ in range(rnd.integers(1, 5))))
        if k < 0.92:
            return lines(3, 40)
        if k < 0.955 and depth < 2:  # a wrapper that says nothing
            held = "".join(part(depth + 1) for _ in range(rnd.integers(1, 4)))
            for _ in range(rnd.integers(1, 4)):
                held = box(pick("div", "div", "section", named("div", "row", "inner", "c1", "x")), held)
            return held
        return advert() if k < 0.975 else aside() if k < 0.985 else form()

    pages = []
    for _ in range(count):
        main = (f"<h1>{prose(2, 12, True)}</h1>" if chance(0.85) else "") + "".join(part() for _ in range(rnd.integers(1, 12)))
        if chance(0.12):  # verse, listings, junk: very many short lines
            main += "".join(f"<p>{prose(1, 5, True)}</p>" for _ in range(rnd.integers(30, 400)))
        main = main + comments() * chance(0.15) + box(named("div", "share", "social-links", "tags"), links(2)) * chance(0.15)
        main = box(pick("article", "article", "main", named("div", "content", "article-body", "post", "entry-content", "story", "main-text"), named("section", "post", "content", "article"), named("article", "post", "entry")), main)
        main = pick(main, main, box(pick("main", named("div", "main", "wrapper", "container", "page")), main))
        before = [box(pick("nav", "nav", named("div", "nav", "menu", "navbar"), named("ul", "menu")), links(rnd.integers(2, 8))), notice() * chance(0.3), box(pick("header", named("div", "header", "head")), pick(links(2), f"<p>{prose(1, 8)}</p>", f"<h1>{prose(1, 4)}</h1>")) * chance(0.4), advert() * chance(0.6), box(named("div", "breadcrumbs"), f"<a href=/>{prose(1, 2)}</a>") * chance(0.2)]
        after = [aside() * chance(0.35), advert() * chance(0.3), comments() * chance(0.4), form() * chance(0.25), notice() * chance(0.2), box(pick("footer", "footer", named("div", "footer", "foot", "copyright")), pick(f"&copy; {prose(2, 20)}", f"<p>{prose(3, 25)}</p>", links(3)))]
        rnd.shuffle(before)
        pages.append(f"<!DOCTYPE html><html><head><title>{prose(2, 5)}</title><script>x('</p>')</script></head><body>{''.join(before)}{main}{''.join(after)}</body></html>")
    return pages


def labelled_tree(page: str) -> tuple[Tree, np.ndarray]:
    """A page's tree without marks, and its labels: marked runs and every element that holds one."""
    tree = Tree(page)
    label = np.zeros(len(tree.parent), dtype=np.int64)
    marked = {k for k, text in tree.text.items() if text.startswith(OPEN)}
    clean = Tree(page.replace(OPEN, ""))
    if len(clean.parent) != len(tree.parent):
        raise ValueError("marks change the tree")
    for k in marked:
        while k >= 0 and not label[k]:
            label[k] = 1
            k = tree.parent[k]
    return clean, label


@lru_cache(maxsize=1)
def model() -> tuple[np.ndarray, np.ndarray]:
    return train(*map(list, zip(*map(labelled_tree, labelled_pages()), strict=True)))


def main_texts(pages: list[str], weights: np.ndarray, ties: np.ndarray) -> list[str]:
    if not pages:
        return []
    trees = [Tree(p) for p in pages]
    forest = Forest(trees)
    content = forest.marginals(weights, ties)[0] >= 0.5
    return ["\n".join(text for k, text in t.text.items() if content[b + k]) for t, b in zip(trees, forest.base, strict=True)]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text (blocks joined by line ends; empty if there is none), n_chars (code points).

    Null html counts as empty. Null or repeated ids keep their own rows; other columns aren't read. Pages are read in
    one pass, whatever is broken in them; character references are decoded in each piece of text between two tags.
    """
    weights, ties = model()
    slim = pages.select(F.struct(F.col(id_col).alias("id"), F.col(url_col).alias("url")).alias("row"), shared.text_or_empty(html_col).alias("html"))
    kind = slim.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(main_texts(part.column(1).to_pylist(), weights, ties), pa.string())], names=["row", "text"])

    found = slim.mapInArrow(run, f"row {kind}, text string")
    return found.select(F.col("row.id").alias(id_col), F.col("row.url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(shared.table(spark, sf_dir, "pages"))
