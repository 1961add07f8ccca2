"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page is parsed into a tree of block elements; runs of text between block boundaries hang on their block. Each
element gets features: tag, attribute tokens of its own and of its ancestors, depth, subtree text and link
density, sentence marks, position, and how it compares with its siblings. Boosted regression trees give each
element the log-odds of holding main text. Decoding is hierarchical: the kept elements are the choice of greatest
summed log-odds in which a dropped element has no kept descendant, found from the leaves up.

The trees are fitted when first used, on generated pages with known labels (``training_pages`` pages, a fixed
bound; the corpus isn't needed for it), and are sent to the tasks; they hold ``rounds`` trees of at most
2**depth leaves.

Output: blocks in page order joined by one newline; character references decoded, white space in a block turned
into one space (``<br>`` counts as white space), ends trimmed, blocks without text left out.

Edge cases: null or empty html, and pages without text, give an empty text; unclosed tags, comments and quotes are
closed at the end of the page; a tag cut off at the end of the page is dropped; text outside any element belongs
to the body; contents of scripts, styles, titles, text areas, frames and templates are no text, but those of noscript,
object, svg and math are judged like any other; repeated rows and a null id pass through; the whole page is read whatever its length. Other columns
pass through unchanged.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import ship_package, table

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Fixed values of HTML: elements that start a block, that hold no content, whose content isn't markup, that end an open element of the same family.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul button select option label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe template".split())
FOREIGN = frozenset(("svg", "math"))
CLOSES_P = BLOCKS - frozenset("button select option label".split())
SIBLINGS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("html body table td th ul ol dl div article section aside nav header footer main form".split())

TAGS = [("nav", "menu"), ("header",), ("footer",), ("aside",), ("form", "button", "select", "option", "label", "fieldset", "legend"), ("article",), ("main",), ("section", "div", "center"), ("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("li", "ul", "ol", "dl", "dt", "dd"), ("table", "tr", "td", "th", "tbody", "thead", "tfoot"), ("blockquote", "pre", "figure", "figcaption"), ("body", "html", "head")]
#: Attribute words by what they speak for.
WORDS = [
    "nav menu navbar navigation breadcrumb breadcrumbs toolbar pagination pager tabs",
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner",
    "cookie cookies consent notice popup modal alert gdpr overlay newsletter subscribe signup",
    "footer foot copyright legal colophon",
    "header masthead head topbar logo",
    "sidebar side aside widget related recommended trending share social",
    "comment comments reply replies discussion disqus respond",
    "form login search contact",
    "article content post entry story main body text",
]
GROUP_OF_WORD = {w: k for k, words in enumerate(WORDS) for w in words.split()}
GROUP_OF_TAG = {t: k for k, tags in enumerate(TAGS) for t in tags}
N_TAGS, N_WORDS = len(TAGS), len(WORDS)
N_FEATURES = 2 * N_TAGS + 2 * N_WORDS + 14


class Page:
    """Block elements in document order: tag, parent, attribute word groups, and runs (element, text, characters in links, words)."""

    def __init__(self, source: str):
        self.tags, self.parents, self.words = ["html"], [-1], [frozenset()]
        self.runs: list[tuple[int, str, int]] = []
        self._parts: list[str] = []
        self._links = 0
        self._open: Counter[str] = Counter()  # open elements by name, but the outermost
        stack: list[tuple[str, int]] = [("html", 0)]
        at = open_links = foreign = 0
        for m in iter(lambda: TOKEN.search(source, at), None):
            if m.start() > at:
                self._text(source[at : m.start()], open_links)
            at = m.end()
            slash, name, attributes = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
            if not name or m.group(5) and source[at - 1] != ">":
                continue
            name = name.lower()
            closed = attributes.rstrip().endswith("/")
            if name in FOREIGN:
                foreign = max(0, foreign - 1) if slash else foreign + (not closed)
                continue
            if slash:
                if name == "a":
                    open_links = max(0, open_links - 1)
                if name in BLOCKS and self._open[name]:
                    self._flush(stack[-1][1])
                    k = len(stack) - 1
                    while stack[k][0] != name:
                        k -= 1
                    self._cut(stack, k)
                continue
            if name in RAW:
                if foreign and closed:  # only inside these can a tag close itself
                    continue
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            if name == "br":
                self._parts.append(" ")
            if name == "a":
                open_links += not closed
            if name not in BLOCKS:
                continue
            self._flush(stack[-1][1])
            open_links = 0
            if name in CLOSES_P:
                self._end(stack, ("p",))
            if name in SIBLINGS:
                self._end(stack, SIBLINGS[name])
            if name in VOID or name == "html":
                continue
            found = frozenset(GROUP_OF_WORD[w] for a in ATTRIBUTE.findall(attributes) for w in (x.lower() for x in WORD.findall(" ".join(a))) if w in GROUP_OF_WORD) if attributes else frozenset()
            self.tags.append(name)
            self.parents.append(stack[-1][1])
            self.words.append(found)
            stack.append((name, len(self.tags) - 1))
            self._open[name] += 1
        self._text(source[at:], open_links)
        self._flush(stack[-1][1])

    def _cut(self, stack: list[tuple[str, int]], k: int) -> None:
        for name, _ in stack[k:]:
            self._open[name] -= 1
        del stack[k:]

    def _end(self, stack: list[tuple[str, int]], names: tuple[str, ...]) -> None:
        if not any(self._open[n] for n in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                self._cut(stack, k)
                if len(names) == 1:
                    return
            elif stack[k][0] in SCOPES:
                return

    def _text(self, raw: str, open_links: int) -> None:
        self._parts.append(raw)
        if open_links:
            self._links += len(raw)

    def _flush(self, element: int) -> None:
        text = " ".join(entities.unescape("".join(self._parts)).split()) if self._parts else ""
        if text:
            self.runs.append((element, text, min(self._links, len(text))))
        self._parts, self._links = [], 0

    def features(self) -> np.ndarray:
        n = len(self.tags)
        x = np.zeros((n, N_FEATURES))
        own, chars, links, marks, runs, size, first = ([0] * n for _ in range(7))
        for e, text, linked in self.runs:
            own[e] += len(text)
            chars[e] += len(text)
            links[e] += linked
            marks[e] += text.count(".") + text.count(",")
            runs[e] += 1
        children: list[list[int]] = [[] for _ in range(n)]
        depth = [0] * n
        for e in range(1, n):
            p = self.parents[e]
            first[e] = len(children[p])
            children[p].append(e)
            depth[e] = depth[p] + 1
        for e in range(n - 1, 0, -1):
            p = self.parents[e]
            for a in (chars, links, marks, runs):
                a[p] += a[e]
            size[p] += size[e] + 1
        total = chars[0] or 1
        a, b, c, d = N_TAGS, 2 * N_TAGS, 2 * N_TAGS + N_WORDS, 2 * N_TAGS + 2 * N_WORDS
        before = 0
        for e in range(n):
            row, p = x[e], self.parents[e]
            if p >= 0:
                row[a:b] = np.maximum(x[p, :a], x[p, a:b])
                row[c:d] = np.maximum(x[p, b:c], x[p, c:d])
            if (g := GROUP_OF_TAG.get(self.tags[e])) is not None:
                row[g] = 1
            for g in self.words[e]:
                row[b + g] = 1
            near = children[p] if p >= 0 else [e]
            around = chars[p] if p >= 0 else chars[e]
            row[d:] = (
                depth[e], len(children[e]), own[e], chars[e], links[e] / (chars[e] or 1), chars[e] / (size[e] + 1), marks[e] / (chars[e] / 100 + 1), chars[e] / total,
                before / total, len(near), first[e] / len(near), chars[e] / (around or 1), runs[e], around / len(near),
            )
            before += own[e]
        return x


class BoostedTrees:
    """Logistic boosting with binned features; a tree is a full binary one of the given depth."""

    def __init__(self, rounds: int, depth: int, rate: float = 0.3, bins: int = 32, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
        share = y.mean()
        self.base = float(np.log(share / (1 - share)))
        score, self.trees = np.full(len(y), self.base), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = y - p, np.maximum(p * (1 - p), 1e-6)
            leaf, splits = np.zeros(len(y), int), []
            for level in range(self.depth):
                n = 1 << level
                best = np.full(n, -1.0)
                feature, cut = np.zeros(n, int), np.full(n, np.inf)
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    k, key = len(c) + 1, leaf * (len(c) + 1) + binned[:, f]
                    g = np.bincount(key, gradient, n * k).reshape(n, k).cumsum(1)
                    h = np.bincount(key, weight, n * k).reshape(n, k).cumsum(1)
                    gain = g**2 / (h + self.ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + self.ridge) - g[:, -1:] ** 2 / (h[:, -1:] + self.ridge)
                    at = gain[:, :-1].argmax(1)
                    value = gain[np.arange(n), at]
                    better = value > best + 1e-9
                    best, feature, cut = np.where(better, value, best), np.where(better, f, feature), np.where(better, c[at], cut)
                splits.append((feature, cut))
                leaf = 2 * leaf + (x[np.arange(len(y)), feature[leaf]] > cut[leaf])
            n = 1 << self.depth
            values = self.rate * np.bincount(leaf, gradient, n) / (np.bincount(leaf, weight, n) + self.ridge)
            score += values[leaf]
            self.trees.append((splits, values))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds."""
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        for splits, values in self.trees:
            leaf = np.zeros(len(x), int)
            for feature, cut in splits:
                leaf = 2 * leaf + (x[rows, feature[leaf]] > cut[leaf])
            out += values[leaf]
        return out


def decode(page: Page, odds: np.ndarray) -> list[bool]:
    """Kept elements: greatest sum of log-odds, no kept element under a dropped one."""
    n = len(odds)
    best = [float(v) for v in odds]
    for e in range(n - 1, 0, -1):
        if best[e] > 0:
            best[page.parents[e]] += best[e]
    kept = [best[0] > 0] + [False] * (n - 1)
    for e in range(1, n):
        kept[e] = best[e] > 0 and kept[page.parents[e]]
    return kept


def main_text(page: Page, odds: np.ndarray) -> str:
    kept = decode(page, odds)
    return "\n".join(text for e, text, _ in page.runs if kept[e])


def training_page(rng: random.Random) -> tuple[str, list[tuple[str, bool]]]:
    """A generated page and its blocks with whether each is main text; block texts are unique."""
    blocks: list[tuple[str, bool]] = []

    def words(low: int, high: int) -> str:
        out = ["".join(rng.choice("aeioubcdfghlmnprstvwz") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(low, high))]
        if rng.random() < 0.12:
            out = [w + rng.choice(("###", "%%%", "***", "$$$")) for w in out]
        text = " ".join(w + (rng.random() < 0.1) * "," for w in out).capitalize()
        return text + rng.choice((".", ".", ".", "", "?"))

    def block(content: bool, low: int, high: int) -> str:
        text = words(low, high) + f" {len(blocks)}"
        blocks.append((text, content))
        return text

    def attribute(options: str) -> str:
        name = rng.choice(options.split())
        return rng.choice((f' class="{name}"', f' id="{name}"', f" class='x {name}-box'", f' class="{name}_inner wide"'))

    def wrap(tag: str, options: str, inner: str) -> str:
        bare = tag not in ("div", "section") and rng.random() < 0.6
        return f"<{tag}{'' if bare else attribute(options)}>{inner}</{tag}>"

    def links(n: int, long: bool = False) -> str:
        items = [f'<li><a href="/{k}">{block(False, 1, 8 if long else 3)}</a></li>' for k in range(n)]
        return "<ul>" + "".join(items) + "</ul>"

    def paragraphs(n: int, content: bool, low: int = 1, high: int = 80) -> str:
        tag = rng.choice(("p", "p", "p", "div"))
        if tag == "p" and rng.random() < 0.3:
            return "".join(f"<p>{'<b>' * (rng.random() < 0.2)}{block(content, low, high)}{'<br>' * (rng.random() < 0.2)}" for _ in range(n))
        return "".join(f"<{tag}>{block(content, low, high)}</{tag}>" for _ in range(n))

    def extra(kind: str) -> str:
        if kind == "nav":
            return wrap(rng.choice(("nav", "nav", "div")), "nav menu navigation breadcrumb", links(rng.randint(2, 9)) if rng.random() < 0.8 else block(False, 1, 6))
        if kind == "ad":
            return f"<{(t := rng.choice(('div', 'section', 'aside')))}{attribute('ad ads advert sponsored promo banner')}>{block(False, 2, 40) if rng.random() < 0.7 else paragraphs(rng.randint(1, 3), False)}</{t}>"
        if kind == "notice":
            return wrap("div", "cookie consent notice popup modal newsletter subscribe", paragraphs(rng.randint(1, 2), False, 3, 40) + (f"<button>{block(False, 1, 2)}</button>" if rng.random() < 0.5 else ""))
        if kind == "header":
            return wrap(rng.choice(("header", "div")), "header masthead topbar logo", rng.choice(("", extra("nav"))) + f"<{(t := rng.choice(('p', 'div', 'h2', 'h1')))}>{block(False, 1, 8)}</{t}>")
        if kind == "footer":
            return wrap(rng.choice(("footer", "footer", "div")), "footer copyright legal", block(False, 2, 30) if rng.random() < 0.5 else paragraphs(rng.randint(1, 3), False, 2, 40) + rng.choice(("", links(3))))
        if kind == "side":
            return wrap(rng.choice(("aside", "aside", "div")), "sidebar widget related recommended share social", f"<h3>{block(False, 1, 4)}</h3>" + (links(rng.randint(2, 6), True) if rng.random() < 0.5 else paragraphs(rng.randint(1, 3), False, 3, 50)))
        if kind == "form":
            return f"<form{attribute('form login search contact')}><label>{block(False, 1, 4)}</label><input><select><option>{block(False, 1, 2)}<option>{block(False, 1, 2)}</select><button>{block(False, 1, 2)}</button></form>"
        each = [f"<div{attribute('comment reply')}>{paragraphs(1, False, 2, 60)}</div>" if rng.random() < 0.5 else f"<li>{paragraphs(1, False, 2, 60)}</li>" for _ in range(rng.randint(1, 5))]
        return f"<{(t := rng.choice(('section', 'div', 'ol')))}{attribute('comments discussion replies respond')}>" + "".join(each) + f"</{t}>"

    kinds = "nav ad notice header footer side form comments".split()
    some = lambda k: [extra(rng.choice(kinds)) for _ in range(rng.randint(0, k))]
    before = (["<!-- x -->" + extra("nav")] if rng.random() < 0.8 else []) + some(2)
    body = [f"<h1>{block(True, 1, 16)}</h1>"] if rng.random() < 0.85 else []
    longest = rng.choice((4, 12, 40, 80, 200))
    for _ in range(rng.choice((0, 1, 1, 1, 2, 3, 4, 5, 6, 7))):
        roll = rng.random()
        if roll < 0.72:
            body.append(paragraphs(rng.choice((1, 1, 2, 3, 4, 8)), True, 1, longest))
        elif roll < 0.8:
            body.append(f"<h{(k := rng.randint(2, 4))}>{block(True, 1, 6)}</h{k}>")
        elif roll < 0.86:
            body.append("<ul>" + "".join(f"<li>{block(True, 1, 30)}" for _ in range(rng.randint(1, 5))) + "</ul>")
        elif roll < 0.9:
            body.append(f"<blockquote>{paragraphs(1, True)}</blockquote>" if rng.random() < 0.5 else f"<table><tr><td>{block(True, 1, 20)}<td>{block(True, 1, 20)}</table>")
        else:
            body.append(extra(rng.choice(("ad", "side", "notice", "form", "nav", "comments"))))
    if not body:
        body = [f"<p>{block(True, 1, 40)}</p>"]
    inner = "".join(body)
    shape = rng.random()
    if shape < 0.55:
        inner = f"<article{rng.choice(('', '', attribute('post entry story article')))}>{inner}</article>"
    elif shape < 0.85:
        tag = rng.choice(("div", "main", "section"))
        inner = f"<{tag}{attribute('content main post entry story article text') if tag != 'main' else ''}>{inner}</{tag}>"
    if rng.random() < 0.3:
        inner = f"<{(t := rng.choice(('main', 'div')))}>{inner}</{t}>"
    after = some(3) + ([extra("footer")] if rng.random() < 0.8 else [])
    # blocks were labelled as they were made; page order doesn't matter for labels
    return "<!DOCTYPE html><html><head><title>t</title></head><body>" + "".join(before) + inner + "".join(after) + "</body></html>", blocks


@functools.lru_cache(maxsize=2)
def trained(training_pages: int = 1500, rounds: int = 60, depth: int = 4, seed: int = 7) -> BoostedTrees:
    rng, xs, ys = random.Random(seed), [], []
    for _ in range(training_pages):
        source, blocks = training_page(rng)
        page, wanted = Page(source), dict(blocks)
        y = np.zeros(len(page.tags))
        for e, text, _ in page.runs:
            while e >= 0 and wanted[text]:
                y[e] = 1
                e = page.parents[e]
        xs.append(page.features())
        ys.append(y)
    return BoostedTrees(rounds, depth).fit(np.concatenate(xs), np.concatenate(ys))


def extract(pages: DataFrame, html: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """pages without the html column, with the main text and its length in code points."""
    shared = ship_package(pages.sparkSession).sparkContext.broadcast(trained())
    keep = [f for f in pages.schema.fields if f.name not in (html, text, n_chars)]
    schema = T.StructType([*keep, T.StructField(text, T.StringType()), T.StructField(n_chars, T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            out = []
            for k in range(0, len(pdf), 200):
                parsed = [Page(h or "") for h in pdf["html"].iloc[k : k + 200]]
                odds = model.score(np.concatenate([p.features() for p in parsed]))
                at = 0
                for p in parsed:
                    out.append(main_text(p, odds[at : (at := at + len(p.tags))]))
            pdf = pdf.drop(columns="html").set_axis([f.name for f in keep], axis=1)
            yield pdf.assign(**{text: out, n_chars: [len(t) for t in out]})

    return pages.select(*[F.col(f"`{f.name}`").alias(f"_{k}") for k, f in enumerate(keep)], F.col(f"`{html}`").alias("html")).mapInPandas(run, schema)


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
