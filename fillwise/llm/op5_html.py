"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

A page becomes a tree of block-level nodes in one pass of a tag scanner. Each node has features of its tag, attribute
tokens, depth, subtree density and siblings. Gradient-boosted trees (MLlib) learn from pages that tell where their
article is without naming it: the headline is the block that agrees with the page's title, and the article is the
smallest part around it that holds half of the page's prose. What has a name of advertising or the like inside that part
teaches nothing. In a third of these pages the tag and attribute features are blanked, so that density, links, depth and
siblings are learned as well. Invented layouts, whose parts are known (adverts, footers and share bars inside articles
too), are always among the training pages. Nodes weigh as much as the text below them, as in decoding. The fitted trees
travel to the tasks as plain tables, so that a page's nodes never leave the task that parsed it. Decoding picks the best
labels under one rule: nothing below a rejected node is kept.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fillwise.llm.common import texts_of, written

# Element names of the HTML standard, and attribute words that name parts of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea template noscript iframe svg math title".split())
#: Raw elements that may hold others of their name; svg and math may close themselves, which other raw elements cannot.
NESTED = frozenset("svg math template".split())
#: Elements that end svg and math when they start inside them, but for those parts of svg and math that hold HTML.
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre "
    "ruby s small span strong strike sub sup table tt u ul var".split()
)
HOLDS_HTML = frozenset("foreignobject desc title annotation-xml".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
BOILER_TAGS = frozenset("nav footer header aside form menu button select fieldset dialog head script style noscript iframe".split())
ARTICLE_TAGS = frozenset("article main".split())
PROSE_TAGS = frozenset("p blockquote pre h1 h2 h3 h4 h5 h6 figcaption dd dt".split())
LIST_TAGS, TABLE_TAGS = frozenset("ul ol li dl".split()), frozenset("table thead tbody tfoot tr td th".split())
CLOSES_P = PROSE_TAGS | LIST_TAGS | frozenset(
    "address article aside details div fieldset figure footer form header hr main menu nav section table".split()
)
NEGATIVE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "popup modal overlay newsletter subscribe subscription sidebar side widget widgets related recommended recommendations share "
    "sharing social menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer bottom copyright comment "
    "comments reply replies respond disqus login signin signup register search pagination pager hidden toolbar skip branding brand "
    "logo tagline colophon legal credits outbrain taboola alert disclaimer crumbs discussion feedback form".split()
)
POSITIVE = frozenset("article articlebody content maincontent main post posts entry story text body".split())
NAMES = ("class", "id", "role", "itemprop")

#: A tag with its quotes closed; else, where a quote stays open, up to the next ``>``.
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^<>]*+)>", re.DOTALL
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")
#: What invented pages say of a part: 1 is main text, 0 is not. Other pages cannot say it.
MARK = re.compile(r"data-part=\"([01])\"")

FEATURES = (
    "boiler_tag", "article_tag", "prose_tag", "list_tag", "table_tag", "negative", "positive", "negative_above", "positive_above", "depth",
    "log_subtree", "log_own", "link_density", "text_density", "sibling_place", "log_siblings", "sibling_share",
    "page_place", "page_share", "punctuation", "log_block_words", "headline", "prose_share", "prose_around", "prose_alike",
    "names_in_page",
)
#: Features that come from names: the first ones and the last; blanked in a third of the training pages.
NAMED = [*range(9), -1]
#: Pages that the fit reads at most (about), trees and their depth.
MAX_PAGES, TREES, DEPTH = 1200, 25, 5


class Page:
    """The block-level nodes of a page in document order, and its text blocks as (node, text)."""

    def __init__(self, source: str, marked: bool = False):
        """``marked``: the page is an invented one, its marks count."""
        self.parent, self.tag, self.negative, self.positive = [-1], ["html"], [0], [0]
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters inside links
        self.title, self.marked = "", marked
        self.marks: dict[int, int] = {}
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack, run, links, in_link, at = [0], [], 0, 0, 0
        is_open: Counter[str] = Counter()

        def flush() -> None:
            nonlocal links
            if run:
                text = SPACE.sub(" ", entities.unescape("".join(run))).strip()
                if text:
                    self.blocks.append((stack[-1], text, min(links, len(text))))
                run.clear()
            links = 0

        def pop_to(k: int) -> None:
            flush()
            is_open.subtract(self.tag[x] for x in stack[k:])
            del stack[k:]

        n = len(source)
        while at < n:
            m = TAG.search(source, at)
            end = m.start() if m else n
            if end > at:
                run.append(source[at:end])
                links += (end - at) * bool(in_link)
            if not m:
                break
            at, closing, name = m.end(), m[1], (m[2] or "").lower()
            if not name:
                continue
            if name in RAW:
                if name in NESTED:
                    if not closing and not (name != "template" and m[3].endswith("/")):
                        at = self._end(source, name, at)
                elif not closing:
                    stop = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(source, at)
                    if name == "title" and not self.title:
                        self.title = SPACE.sub(" ", entities.unescape(source[at : stop.start() if stop else n])).strip()
                    at = stop.end() if stop else n
                continue
            if name in INLINE:
                if name == "a":
                    in_link = 0 if closing else 1
                elif name == "br":
                    run.append("\n")
                continue
            if closing:
                if is_open[name] > 0:
                    pop_to(next(k for k in range(len(stack) - 1, 0, -1) if self.tag[stack[k]] == name))
                else:
                    flush()
                in_link = 0
                continue
            flush()
            in_link = 0
            top = self.tag[stack[-1]]
            if top == "p" and name in CLOSES_P or name == top and name in ("li", "dt", "dd", "tr", "td", "th", "option") and len(stack) > 1:
                pop_to(len(stack) - 1)
            if name in ("html",) and len(stack) == 1:
                self._words(0, m[3])
                continue
            if name in VOID:
                continue
            self.parent.append(stack[-1])
            self.tag.append(name)
            self.negative.append(0)
            self.positive.append(0)
            self._words(len(self.tag) - 1, m[3])
            if not m[3].endswith("/"):
                stack.append(len(self.tag) - 1)
                is_open[name] += 1
        flush()

    @staticmethod
    def _end(source: str, name: str, at: int) -> int:
        """Where the element that is open at ``at`` ends, elements of the same name inside it counted.

        Elements of HTML end svg and math where they start, as in browsers, unless a part that may hold HTML is open.
        """
        depth, html_inside = 1, 0
        for m in TAG.finditer(source, at):
            other = (m[2] or "").lower()
            if name != "template" and other != name:
                if other in HOLDS_HTML and not m[3].endswith("/"):
                    html_inside = max(0, html_inside + (-1 if m[1] else 1))
                elif not html_inside and (other in BREAKOUT and not m[1] or other in ("p", "br") and m[1]):
                    return m.start()
            if other == name:
                if m[1]:
                    depth -= 1
                elif name == "template" or not m[3].endswith("/"):
                    depth += 1
                if not depth:
                    return m.end()
        return len(source)

    def _words(self, node: int, attributes: str) -> None:
        if self.marked and (mark := MARK.search(attributes)):
            self.marks[node] = int(mark[1])
        if "=" not in attributes and "hidden" not in attributes:
            return
        words = [
            t.lower() for name, *values in ATTRIBUTE.findall(attributes) if name.lower() in NAMES for t in TOKEN.findall("".join(values))
        ]
        self.negative[node] = sum(w in NEGATIVE for w in words) + bool(re.search(r"display\s*:\s*none|\bhidden\b", attributes))
        self.positive[node] = sum(w in POSITIVE for w in words)

    def features(self) -> np.ndarray:
        """A row for each node."""
        n = len(self.tag)
        own, link, count, marks = (np.zeros(n) for _ in range(4))
        for node, text, links in self.blocks:
            own[node] += len(text)
            link[node] += links
            count[node] += 1 + text.count(" ")
            marks[node] += sum(map(text.count, ".,;!?"))
        nodes, runs = np.ones(n), np.zeros(n)
        for node, _, _ in self.blocks:
            runs[node] += 1
        sub, sub_link, sub_words, sub_marks, sub_runs = own.copy(), link.copy(), count.copy(), marks.copy(), runs.copy()
        for k in range(n - 1, 0, -1):
            up = self.parent[k]
            for a in (sub, sub_link, sub_words, sub_marks, sub_runs, nodes):
                a[up] += a[k]
        depth, above, article, place, siblings = (np.zeros(n) for _ in range(5))
        for k in range(1, n):
            up = self.parent[k]
            depth[k] = depth[up] + 1
            above[k] = above[up] + self.negative[up] + (self.tag[up] in BOILER_TAGS)
            article[k] = article[up] + self.positive[up] * (self.tag[up] != "body") + (self.tag[up] in ARTICLE_TAGS)
            place[k] = siblings[up]
            siblings[up] += 1
        parent = np.array(self.parent)
        around = np.maximum(siblings[parent], 1)
        flag = lambda names: np.array([t in names for t in self.tag], float)
        whole = max(sub[0], 1.0)
        headline, at = np.zeros(n), self.headline()
        while at >= 0:
            headline[at], at = 1, self.parent[at]
        prose = self.prose()
        alike = Counter()
        for k in range(1, n):
            alike[self.parent[k], self.tag[k]] += prose[k]
        names = (flag(BOILER_TAGS - {"head"}) + flag(ARTICLE_TAGS) + self.negative + self.positive > 0).mean()
        return np.column_stack(
            [
                flag(BOILER_TAGS), flag(ARTICLE_TAGS), flag(PROSE_TAGS), flag(LIST_TAGS), flag(TABLE_TAGS),
                np.array(self.negative, float), np.array(self.positive, float), above, article, depth,
                np.log1p(sub), np.log1p(own), sub_link / np.maximum(sub, 1), np.log1p(sub / nodes), place / around,
                np.log1p(around), sub / np.maximum(sub[parent], 1), np.arange(n) / n, sub / whole,
                sub_marks / np.maximum(sub, 1), np.log1p(sub_words / np.maximum(sub_runs, 1)), headline,
                prose / max(prose[0], 1.0), prose[parent] / max(prose[0], 1.0),
                np.array([alike[x] for x in zip(self.parent, self.tag, strict=True)]) / max(prose[0], 1.0), np.full(n, names),
            ]
        )

    def headline(self) -> int:
        """The node of the block that agrees best with the title: it is the title or a large part of it. -1: there is none."""
        title = self.title.lower()
        best = max(
            ((len(t), -k, node) for k, (node, t, _) in enumerate(self.blocks) if len(title) >= 4 and 5 * len(t) >= 2 * len(title) and t.lower() in title),
            default=(0, 0, -1),
        )
        return best[2]

    def prose(self) -> np.ndarray:
        """Characters of prose in and below each node: blocks of ten words or more with a sentence mark, most of them outside of links."""
        prose = np.zeros(len(self.tag))
        for node, text, links in self.blocks:
            if text.count(" ") >= 9 and any(c in text for c in ".!?") and 3 * links < len(text):
                prose[node] += len(text)
        for k in range(len(self.tag) - 1, 0, -1):
            prose[self.parent[k]] += prose[k]
        return prose

    def article(self) -> int:
        """The smallest node around the headline with half of the page's prose, -1 where that is the body or unknown. No name has a say."""
        at, prose = self.headline(), self.prose()
        while at > 0 and 2 * prose[at] < prose[0]:
            at = self.parent[at]
        return at if at > 0 and self.tag[at] != "body" and prose[0] else -1

    def labels(self, article: int) -> list[int]:
        """1 in the article, 0 elsewhere; -1 for the parts around it, nodes without text, and what of it may be no text.

        These are lists of links, and parts of the article that have a name or an element of things around articles.
        """
        n = len(self.tag)
        own, linked = np.zeros(n), np.zeros(n)
        for node, text, links in self.blocks:
            own[node] += len(text)
            linked[node] += links
        for k in range(n - 1, 0, -1):
            own[self.parent[k]] += own[k]
            linked[self.parent[k]] += linked[k]
        inside, doubt, out = [False] * n, [False] * n, [-1] * n
        around = set()
        up = article
        while up > 0:
            up = self.parent[up]
            around.add(up)
        for k in range(1, n):
            inside[k] = k == article or inside[self.parent[k]]
            named = k != article and (self.negative[k] > 0 or self.tag[k] in BOILER_TAGS)
            doubt[k] = inside[k] and (doubt[self.parent[k]] or named)
            if own[k] and k not in around and not doubt[k] and not (inside[k] and 2 * linked[k] > own[k]):
                out[k] = int(inside[k])
        return out

    def marked_labels(self) -> list[int]:
        """What an invented page says of its nodes: the mark of the node or of the nearest one above; -1 without any."""
        has = [False] * len(self.tag)
        for node, _, _ in self.blocks:
            has[node] = True
        for k in range(len(self.tag) - 1, 0, -1):
            has[self.parent[k]] |= has[k]
        said = [-1]
        for k in range(1, len(self.tag)):
            said.append(self.marks.get(k, said[self.parent[k]]))
        return [x if h else -1 for x, h in zip(said, has, strict=True)]

    def decode(self, p: np.ndarray) -> list[bool]:
        """Keeps or rejects each node: the most likely labels among those that keep nothing below a rejected node.

        A node weighs as much as the text below it; html and body have no say.
        """
        n = len(self.tag)
        weight = np.zeros(n)
        for node, text, _ in self.blocks:
            weight[node] += len(text)
        for k in range(n - 1, 0, -1):
            weight[self.parent[k]] += weight[k]
        weight = np.where([t in ("html", "body") for t in self.tag], 0.0, weight)
        p = np.clip(p, 1e-4, 1 - 1e-4)
        keep, drop = weight * np.log(p), weight * np.log1p(-p)
        for k in range(n - 1, 0, -1):
            up = self.parent[k]
            keep[up] += max(keep[k], drop[k])
            drop[up] += drop[k]
        kept = [True]
        for k in range(1, n):
            kept.append(kept[self.parent[k]] and bool(keep[k] > drop[k]))
        return kept

    def text(self, kept: list[bool]) -> str:
        return "\n".join(t for node, t, _ in self.blocks if kept[node])


class Trees:
    """Boosted trees as tables: (feature, threshold, left, right, value) of each node, value in leaves."""

    def __init__(self, trees: list[list[tuple[int, float, int, int, float]]], weights: list[float]):
        self.trees, self.weights = trees, weights

    @classmethod
    def of(cls, model) -> Trees:
        """From an MLlib GBTClassificationModel."""

        def table(tree) -> list[tuple[int, float, int, int, float]]:
            rows: list = []

            def add(node) -> int:
                at = len(rows)
                rows.append(None)
                if node.subtreeDepth() == 0:
                    rows[at] = (-1, 0.0, 0, 0, node.prediction())
                else:
                    split = node.split()
                    rows[at] = (split.featureIndex(), split.threshold(), add(node.leftChild()), add(node.rightChild()), 0.0)
                return at

            add(tree._java_obj.rootNode())
            return rows

        return cls([table(t) for t in model.trees], list(model.treeWeights))

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(x))
        for rows, w in zip(self.trees, self.weights, strict=True):
            feature, threshold, left, right, value = (np.array(c) for c in zip(*rows, strict=True))
            at = np.zeros(len(x), dtype=int)
            while (inner := feature[at] >= 0).any():
                k = at[inner]
                at[inner] = np.where(x[inner, feature[k]] <= threshold[k], left[k], right[k])
            margin += w * value[at]
        return 1 / (1 + np.exp(-2 * margin))


# Usual names of the parts of a page.
PART_NAMES = {
    "head": "site-header masthead top-bar site-branding logo-area page-header banner",
    "menu": "menu main-nav navbar nav-links breadcrumbs",
    "advert": "ad advert sponsored promo-box ad-slot advertisement",
    "article": "post entry-content article-body content story main-content single-post",
    "side": "sidebar widget-area related-posts recommended side-column",
    "comments": "comments comment-list disqus-thread replies",
    "foot": "footer site-footer copyright colophon bottom-bar",
    "notice": "cookie-notice gdpr-consent newsletter-signup popup subscribe-box",
    "share": "share-bar social-links post-footer share",
}
PART_TAGS = {"head": "header", "menu": "nav", "advert": "aside", "article": "article", "side": "aside", "comments": "section", "foot": "footer",
             "notice": "dialog", "share": "footer"}
LAYOUTS = ("elements", "named", "both", "nameless", "bare", "cells")


def invented_pages(count: int = 360) -> list[str]:
    """Pages of some usual layouts: elements, named divisions, both, nameless divisions, bare text, table cells. All parts are marked."""
    rng = random.Random(5)
    words = "an article has paragraphs of several sentences and they run on for some time before they stop with what it says".split()

    def prose(k: int) -> str:
        return " ".join(w + "." * (rng.random() < 0.1) + "," * (rng.random() < 0.1) for w in rng.choices(words, k=k)).capitalize() + "."

    def few(k: int = 4) -> str:
        return " ".join(rng.choices(words, k=rng.randint(1, k))).capitalize()

    def listed(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{few(3)}</a></li>' for i in range(k)) + "</ul>"

    def part(layout: str, kind: str, inner: str) -> str:
        tag = PART_TAGS[kind] if layout in ("elements", "both") else "td" if layout == "cells" else "div"
        name = f' class="{rng.choice(PART_NAMES[kind].split())}"' if layout in ("named", "both") else ""
        return f'<{tag}{name} data-part="{int(kind == "article")}">{inner}</{tag}>'

    def page(layout: str) -> str:
        some = lambda share=0.5: rng.random() < share
        title = few(10) + " " + few(3)
        paragraphs = [f"<p>{prose(rng.choice([4, 8, 15, 40, 90]))}</p>" for _ in range(rng.randint(2, 9))]
        if some(0.2):
            paragraphs.insert(rng.randrange(len(paragraphs)), f"<h2>{few()}</h2>")
        if some(0.15):
            paragraphs.append(f"<ul><li>{prose(6)}</li><li>{prose(9)}</li></ul>")
        if some(0.1):
            paragraphs.append(f"<blockquote><p>{prose(12)}</p></blockquote>")
        headline = f"<h1>{title}</h1>"
        if layout in ("elements", "named", "both"):
            headline = f"<header>{headline}</header>" if layout != "named" and some(0.3) else headline
            if some():
                inner = few(4) if some() else f"<p>{prose(rng.randint(3, 25))}</p>"
                paragraphs.insert(rng.randrange(1, len(paragraphs) + 1), part(layout, "advert", inner))
            if some(0.4):
                paragraphs.append(part(layout, "share", few(5) if some() else listed(3)))
        body = "".join(paragraphs)
        if layout == "bare":
            return f'<html><head><title>{title}</title></head><body data-part="1">{headline}{body}</body></html>'
        outside = some(0.15) and layout != "cells"
        article = part(layout, "article", ("" if outside else headline) + (f"<div>{body}</div>" if some(0.2) else body))
        if outside:
            article = headline.replace("<h1>", '<h1 data-part="1">') + article
        if layout in ("elements", "both") and some(0.4):
            article = f"<main>{article}</main>"
        comments = "".join(f"<div>{few(2)}<p>{prose(rng.randint(4, 30))}</p></div>" if some() else f"<p>{prose(rng.randint(4, 30))}</p>" for _ in range(rng.randint(1, 5)))
        parts = [
            part(layout, "notice", f"<p>{prose(rng.randint(4, 20))}</p><button>{few(1)}</button>") if some(0.3) and layout != "nameless" else "",
            part(layout, "head", few(4) if some() else f'<a href="/">{few(3)}</a><p>{few(6)}</p>') if some(0.8) else "",
            part(layout, "menu", listed(rng.randint(3, 9))),
            part(layout, "advert", prose(rng.randint(3, 15))) if some() and layout != "nameless" else "",
            article,
            part(layout, "side", listed(rng.randint(3, 9)) + (prose(6) if some() else "")) if some() else "",
            part(layout, "comments", comments) if some() and layout not in ("nameless", "cells") else "",
            part(layout, "foot", few(5) if some() else "&copy; " + prose(rng.randint(3, 15))),
        ]
        inner = "".join(parts)
        inner = f"<table><tr>{inner}</tr></table>" if layout == "cells" else f"<div>{inner}</div>" if some(0.3) else inner
        return f"<html><head><title>{title + ' - ' + few(2) if some(0.4) else title}</title></head><body>{inner}</body></html>"

    return [page(LAYOUTS[k % len(LAYOUTS)]) for k in range(count)]


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_pages: int = MAX_PAGES, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosted trees from the nodes of about ``max_pages`` pages at most that show where their article is, and of invented layouts."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    n = texts_of(pages).count()
    rows = pages.where(F.col(html_col).isNotNull()).select(F.xxhash64(id_col, html_col).alias("key"), F.col(html_col).alias("html"))
    if n > max_pages:
        rows = rows.where(F.pmod(F.xxhash64("key", F.lit(5)), F.lit(1_000_000)) < int(1_000_000 * max_pages / n))
    rows = rows.select("key", "html", F.lit(False).alias("invented"))
    invented = pages.sparkSession.createDataFrame([(0, h, True) for h in invented_pages()], "key long, html string, invented boolean")

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, y, w = [np.zeros((0, len(FEATURES)))], [], []
            for key, source, marked in zip(pdf["key"], pdf["html"], pdf["invented"], strict=True):
                page = Page(source, marked)
                article = -1 if marked else page.article()
                if article < 0 and not marked:
                    continue
                own, features = np.array(page.marked_labels() if marked else page.labels(article)), page.features()
                if key % 3 == 1:
                    features[:, NAMED] = 0.0
                weight = features[own >= 0, FEATURES.index("page_share")] + 0.01
                x.append(features[own >= 0])
                y += own[own >= 0].tolist()
                w += (weight / weight.sum()).tolist()
            yield pd.DataFrame({"label": np.array(y, float), "weight": np.array(w, float), "x": pd.Series(list(np.concatenate(x)), dtype=object)})

    data = rows.unionByName(invented).mapInPandas(nodes, "label double, weight double, x array<double>")
    data = written(data, "nodes").select("label", "weight", array_to_vector("x").alias("features"))
    model = GBTClassifier(weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=5, maxBins=32, cacheNodeIds=False).fit(data)
    return Trees.of(model)


def main_text(pages: DataFrame, model: Trees, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each row.

    Null and empty pages give an empty text. Very long pages are read in one pass, in time that grows with their length.
    Repeated rows and null ids are pages like others. An empty table gives an empty result. Other columns are ignored.
    """
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            read = [Page(h) if isinstance(h, str) and h else None for h in pdf["html"]]
            texts: list[str] = [""] * len(read)
            for lo in range(0, len(read), 200):  # nodes of some pages at a time go through the trees
                some = [(k, page) for k, page in enumerate(read[lo : lo + 200], lo) if page]
                if not some:
                    continue
                x = [page.features() for _, page in some]
                scores = np.split(model.probability(np.concatenate(x)), np.cumsum([len(a) for a in x])[:-1])
                for (k, page), p in zip(some, scores, strict=True):
                    texts[k] = page.text(page.decode(p))
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    rows = texts_of(pages).select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInPandas(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return main_text(pages, fit(pages))
