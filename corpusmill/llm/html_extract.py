"""Main-text extraction with a tree-structured graphical model over DOM nodes.

Every node of a page (elements and texts) has a hidden label, content or not.
A child's label depends on its parent's and on the child's tag; a node's
features (words of class, id and role, whether it is hidden, text length, link
share, punctuation) depend on its label.  All tables are counted on labelled pages.  For a batch of
pages, sum-product messages go up the trees and down again, level by level, in
array operations; their product is each node's exact marginal.  Texts whose
marginal is above one half make up the result, cut into blocks at block-level
elements and line breaks.

The labelled pages are drawn by ``labelled_pages``, a seeded generator of page
layouts with a label at every text; other labelled pages can be given to
``Model.train``.

Only what can never be article text is left out whatever the model says:
scripts, styles, heads, templates, comments of the markup, controls of forms, and
forms, unless a form holds an article, a main element or a first heading (some
pages are one form as a whole).

Defined cases: a null or empty page has the text ''; unclosed and misnested
elements are closed as browsers do in common cases; pages without markup are
one text; long and deeply nested pages take time in proportion; a marginal of
exactly one half is no content; repeated rows each get their row; other columns
pass through (one named ``_main`` too: the result is then in ``_main_``); an
empty table gives an empty table.
"""

from __future__ import annotations

import functools
import html
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, small_batches

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
#: Where an attribute's quote is never closed the tag ends at the next '>'.
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTR = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset("script style head template iframe noembed noframes title select textarea button option".split())
#: Elements that make a form the page's frame rather than a form.
FRAMED = frozenset("article main h1".split())
BLOCK = frozenset(
    """
    address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption br
    """.split()
)
CLOSES_P = BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "html", "body", "caption"}
#: An open element that a new one closes, and what stops the search for it.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})
}
TAGS = (
    """
    #text a abbr address article aside b blockquote body button code dd details div dl dt em figcaption figure footer form h1 h2 h3 h4 h5 h6
    header hr html i input label li main nav ol p pre q section small span strong summary sub sup table tbody td th thead time tr u ul
    """
).split()
TAG = {t: i for i, t in enumerate(TAGS)}
OTHER = len(TAGS)


class Page:
    """The nodes of one page in document order: parents, tags, class words, and texts."""

    __slots__ = ("parent", "depth", "tag", "words", "text", "broken", "skipped")

    def __init__(self, source: str):
        self.parent, self.depth, self.tag, self.words, self.text, self.skipped = [-1], [0], ["html"], [()], [None], [False]
        self.broken: list[int] = [0]  # how many block boundaries precede each node
        stack, pos, breaks, n = [0], 0, 0, len(source)
        last = source.rfind(">")  # behind it nothing is a tag
        tags = self.tag
        opened: dict[str, int] = {}  # how many elements of each name are open
        form, framed = [-1], set()  # the form around each node; forms that frame a page

        def add(tag, words, text, skipped):
            self.parent.append(stack[-1])
            self.depth.append(self.depth[stack[-1]] + 1)
            form.append(form[stack[-1]])
            tags.append(tag)
            self.words.append(words)
            self.text.append(text)
            self.broken.append(breaks)
            self.skipped.append(skipped)
            return len(tags) - 1

        def close(to: int):
            nonlocal breaks
            for i in stack[to:]:
                opened[tags[i]] -= 1
                if tags[i] in BLOCK:
                    breaks += 1
            del stack[to:]

        def tag_at(lt):
            return (TOKEN.match(source, lt) or LOOSE.match(source, lt)) if 0 <= lt <= last or lt >= 0 and source.startswith("<!--", lt) else None

        while pos < n:
            lt = source.find("<", pos)
            m = tag_at(lt)
            end = n if lt < 0 else lt if m else lt + 1
            if end > pos:
                raw = source[pos:end]
                # a '<' that opens nothing is text
                while not m and lt >= 0:
                    lt = source.find("<", lt + 1)
                    m = tag_at(lt)
                    end = n if lt < 0 else lt if m else end
                    raw = source[pos:end]
                text = html.unescape(raw) if "&" in raw else raw
                if text and not text.isspace():
                    add("#text", (), text, self.skipped[stack[-1]])
                elif text and len(tags) > 1 and tags[-1] == "#text" and self.parent[-1] == stack[-1]:
                    self.text[-1] += " "
                elif text:
                    add("#text", (), " ", True if self.skipped[stack[-1]] else False)
            if not m:
                break
            pos = m.end()
            name = m.group(2)
            if name is None:
                continue
            name = name.lower()
            if m.group(1):
                if not opened.get(name):
                    breaks += name == "p"
                    continue
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == name:
                        close(k)
                        break
                    if name not in BLOCK and tags[stack[k]] in BLOCK:
                        break  # an inline end tag doesn't close a block
                continue
            if name in CLOSES_P and opened.get("p"):
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == "p":
                        close(k)
                        break
                    if tags[stack[k]] in ("td", "th", "table", "button", "object"):
                        break
            if name in ENDS:
                ends, stop = ENDS[name]
                for k in range(len(stack) - 1, 0, -1) if any(opened.get(x) for x in ends) else ():
                    if tags[stack[k]] in stop:
                        break
                    if tags[stack[k]] in ends:
                        close(k)
                        if name != "tr" or tags[stack[-1]] not in ends:
                            break
            if name in BLOCK:
                breaks += 1
            attrs = m.group(3)
            words: tuple[str, ...] = ()
            if attrs and not attrs.isspace():
                found = []
                for a in ATTR.finditer(attrs):
                    key, value = a.group(1).lower(), a.group(2) or a.group(3) or a.group(4) or ""
                    if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                        found.append("~hidden")
                    elif key in ("class", "id", "role"):
                        found += WORD.findall(CAMEL.sub(" ", value).lower())
                words = tuple(found)
            if name in ("html", "body") and len(stack) == 1:
                continue  # the root stands for both
            i = add(name, words, None, self.skipped[stack[-1]] or name in NEVER)
            if name == "form":
                form[i] = i
            elif name in FRAMED:
                framed.add(form[i])
            if name in VOID or attrs.endswith("/") and name in ("svg", "path", "math"):
                continue
            if name in RAW:
                close_at = re.compile(f"</{name}", re.I).search(source, pos)
                pos = n if close_at is None else close_at.start()
            stack.append(i)
            opened[name] = opened.get(name, 0) + 1
        for i, f in enumerate(form):
            if f >= 0 and f not in framed:
                self.skipped[i] = True


LENGTHS = np.array([0, 1, 3, 6, 12, 25, 60])


def levels_of(depth: np.ndarray) -> list[np.ndarray]:
    """The nodes of each depth."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []


def evidence(pages: list[Page]):
    """Arrays over the nodes of all pages: parent, depth, tag, features of five kinds, texts' flags; features never look at labels."""
    parent, depth, tag, text, page = [], [], [], [], []
    base = 0
    for k, p in enumerate(pages):
        parent += [-1 if x < 0 else x + base for x in p.parent]
        depth += p.depth
        tag += [TAG.get(t, OTHER) for t in p.tag]
        text += p.text
        page += [k] * len(p.tag)
        base += len(p.tag)
    parent, depth, tag = np.array(parent, np.int64), np.array(depth, np.int64), np.array(tag, np.int64)
    n, levels = len(parent), levels_of(depth)
    words = np.array([0 if t is None else t.count(" ") + 1 if not t.isspace() else 0 for t in text], np.int64)
    stops = np.array([0 if t is None else t.count(".") + t.count("!") + t.count("?") for t in text], np.int64)
    linked = np.zeros(n, bool)
    for i in levels[1:]:
        linked[i] = linked[parent[i]] | (tag[i] == TAG["a"])
    total, link = words.copy(), words * linked
    for i in levels[:0:-1]:
        np.add.at(total, parent[i], total[i])
        np.add.at(link, parent[i], link[i])
    share = link / np.maximum(total, 1)
    size = np.searchsorted(LENGTHS, total, "right")
    density = np.searchsorted(np.array([0.01, 0.2, 0.5, 0.9]), share, "right")
    is_text = tag == TAG["#text"]
    kind = np.where(is_text, 0, 1)
    punct = np.where(is_text, 1 + np.minimum(stops, 3), 0)
    return parent, depth, tag, page, (kind * 8 + size, kind * 8 + density, punct)


def moving(parent: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """Which table says how a node's label depends on its parent's: by tag, and apart from others for children of the root."""
    return tag + (len(TAGS) + 1) * ((parent >= 0) & (parent[parent] < 0))


class Model:
    """Counted tables of the tree model."""

    def __init__(self, smoothing: float = 0.1, temper: float = 0.5):
        t = len(TAGS) + 1
        self.move = np.full((2 * t, 2, 2), smoothing)  # tag of the child (those of the page's root by themselves), parent's label, child's label
        self.seen = [np.full((2, 16), smoothing), np.full((2, 16), smoothing), np.full((2, 5), smoothing)]
        self.word: dict[str, list[float]] = {}
        self.temper = temper  # neighbouring features say the same thing twice
        self.labels = np.array([smoothing, smoothing])

    @classmethod
    def train(cls, pages: list[tuple[Page, list[int]]]) -> Model:
        """From pages with a label at each node."""
        m = cls()
        parent, _, tag, _, feats = evidence([p for p, _ in pages])
        y = np.array([v for _, ys in pages for v in ys])
        root = parent < 0
        np.add.at(m.move, (moving(parent, tag)[~root], y[parent[~root]], y[~root]), 1)
        for table, f in zip(m.seen, feats, strict=True):
            np.add.at(table, (y, f), 1)
        m.labels += np.bincount(y, minlength=2)
        k = 0
        for p, ys in pages:
            for words, label in zip(p.words, ys, strict=True):
                for w in set(words):
                    m.word.setdefault(w, [0.0, 0.0])[label] += 1
                k += 1
        m.move = np.log(m.move / m.move.sum(2, keepdims=True))
        m.seen = [np.log(x / x.sum(1, keepdims=True)) for x in m.seen]
        # a word of class or id counts by how far it moves the odds; seldom ones are drawn to none
        rate = m.labels / m.labels.sum()
        m.word = {w: float(np.log((c[1] + rate[1]) / (c[1] + c[0] + 1) / rate[1]) - np.log((c[0] + rate[0]) / (c[1] + c[0] + 1) / rate[0])) for w, c in m.word.items()}
        m.labels = np.log(rate)
        return m

    def marginals(self, pages: list[Page]) -> np.ndarray:
        """P(content) of every node, by one upward and one downward pass of messages."""
        parent, depth, tag, _, feats = evidence(pages)
        own = self.temper * sum(table.T[f] for table, f in zip(self.seen, feats, strict=True))  # log-evidence, a column for each label
        extra = np.array([sum(self.word.get(w, 0.0) for w in ws) if ws else 0.0 for p in pages for ws in p.words])
        own[:, 1] += np.clip(extra, -8, 8)
        kind = moving(parent, tag)
        up = own.copy()  # evidence of the subtree, given the node's label
        message = np.zeros_like(up)  # from a node to its parent
        levels = levels_of(depth)
        for i in levels[:0:-1]:
            s = self.move[kind[i]] + up[i][:, None, :]
            message[i] = np.logaddexp(s[:, :, 0], s[:, :, 1])
            np.add.at(up, parent[i], message[i])
        down = np.zeros_like(up)
        if levels:
            down[levels[0]] = [0.0, -50.0]  # a page as a whole is not content
        for i in levels[1:]:
            rest = down[parent[i]] + up[parent[i]] - message[i]
            s = self.move[kind[i]] + rest[:, :, None]
            down[i] = np.logaddexp(s[:, 0], s[:, 1])
        belief = up + down
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50)))


def render(page: Page, content: np.ndarray) -> str:
    """The texts marked as content: white space as one blank, blocks on lines of their own."""
    blocks: list[str] = []
    last, parts = None, []
    for text, at, ok, skip in zip(page.text, page.broken, content.tolist(), page.skipped, strict=True):
        if text is None or skip or not (ok or text.isspace()):
            continue
        if at != last and parts:
            blocks.append(" ".join("".join(parts).split()))
            parts = []
        last = at
        parts.append(text)
    if parts:
        blocks.append(" ".join("".join(parts).split()))
    return "\n".join(b for b in blocks if b)


def extract(sources: list[str | None], model: Model) -> list[str]:
    """The main text of each page."""
    out = [""] * len(sources)
    live = [i for i, s in enumerate(sources) if s]
    for k in range(0, len(live), 64):
        part = live[k : k + 64]
        pages = [Page(sources[i]) for i in part]
        p = model.marginals(pages) > 0.5
        base = 0
        for i, page in zip(part, pages, strict=True):
            out[i] = render(page, p[base : base + len(page.tag)])
            base += len(page.tag)
    return out


#: Words of class and id by what they are given to; ``both`` says nothing.
_NAMES = {
    "content": "article post entry story content main body text prose markdown blog richtext copy articlebody maincontent chapter essay",
    "menu": "nav menu navbar navigation topbar toolbar breadcrumb breadcrumbs pagination pager tabs links share social follow related recommended trending popular tags skip more",
    "short": "header footer foot colophon copyright legal masthead credits bottom byline imprint",
    "mixed": "sidebar side aside rail widget widgets secondary complementary teaser teasers column",
    "text": "ad ads advert advertisement advertising adslot banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay paywall newsletter disclaimer privacy message",
    "form": "search form login signup contact subscribe register poll",
    "comments": "comments comment commentlist commentlist responses replies reply discussion disqus thread respond feedback reviews",
    "both": "box block wrap wrapper inner container row col section area group item panel module layout grid page site a b c",
}
_NAMES = {k: v.split() for k, v in _NAMES.items()}
_OWN_TAGS = {
    "menu": ["nav", "ul", "div"], "short": ["header", "footer", "div"], "mixed": ["aside", "section", "div"],
    "text": ["div", "aside", "section", "p"], "form": ["form", "form", "div"], "comments": ["section", "div", "ol", "div"],
    "content": ["article", "main", "section", "div", "div"]
}


def labelled_pages(n: int = 1500, seed: int = 5) -> list[tuple[Page, list[int]]]:
    """Seeded random page layouts with a label at every node: 1 where a text, or all texts below an element, are the article's."""
    rng = random.Random(seed)
    letters = "aeiounrstlmdp"

    def words(a, b):
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(a, b)))

    def sentence(a=3, b=18):
        s = words(a, b).capitalize()
        return s + rng.choice([".", ".", ".", "!", "?", ""])

    def prose(a=1, b=6):
        return sentence(1, 2) if rng.random() < 0.1 else " ".join(sentence() for _ in range(rng.randint(a, b)))

    def end(opened):
        return "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opened)))

    def mark(s):  # the mark makes a text the article's; it is taken out before features are seen
        return "\x01" + s

    def links(a=3, b=9):
        return "<ul>" + "".join(f'<li><a href="/{k}">{words(1, 3)}</a></li>' for k in range(rng.randint(a, b))) + "</ul>"

    def named(kind):
        """An element for a part of the page; its names say what it is, but for elements that say so themselves."""
        tag = rng.choice(_OWN_TAGS[kind])
        if tag not in ("div", "section", "p", "ul", "ol") and rng.random() < 0.4:
            return f"<{tag}>"
        names = [rng.choice(_NAMES[kind]) for _ in range(rng.choice([1, 1, 2]))] + [rng.choice(_NAMES["both"]) for _ in range(rng.choice([0, 0, 1, 2]))]
        rng.shuffle(names)
        hidden = rng.choice([" hidden", ' style="display:none"', ' aria-hidden="true"']) if kind != "content" and rng.random() < 0.05 else ""
        role = ' role="main"' if kind == "content" and rng.random() < 0.1 else ""
        return f'<{tag} {rng.choice(["class", "class", "id"])}="{rng.choice("-_ ").join(names)}"{role}{hidden}>'

    def filling(kind, opened):
        """What stands in a part of a page that is not the article."""
        if kind == "menu":
            return links()
        if kind == "short":
            return f"&copy; {words(1, 4)} &middot; {sentence()}" if rng.random() < 0.5 else sentence(1, 8)
        if kind == "text":
            return f"<p>{prose(1, 4)}</p>" if rng.random() < 0.5 and not opened.startswith("<p") else prose(1, 2)
        if kind == "form":
            return f"<label>{words(1, 3)}</label><input name=q><p>{prose(1, 2)}</p><button>{words(1, 2)}</button>"
        if kind == "comments":
            return "".join(f'<div class="comment"><b>{words(1, 2)}</b><p>{prose(1, 3)}</p></div>' for _ in range(rng.randint(1, 4)))
        return rng.choice(
            [
                f"<h3>{words(1, 3)}</h3>{links(2, 5)}<p>{sentence()}</p>",
                f"<p>{prose(1, 4)}</p>",
                f"<h3>{words(1, 3)}</h3><a href=/y><p>{prose(1, 2)}</p></a>",
            ]
        )

    def boiler():
        kind = rng.choice(["menu", "short", "mixed", "text", "text", "form", "comments"])
        opened = named(kind)
        return opened + filling(kind, opened) + end(opened)

    def paragraph():
        r = rng.random()
        if r < 0.08:
            return "<ul>" + "".join(f"<li>{mark(sentence())}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if r < 0.13:
            return f"<blockquote><p>{mark(prose(1, 3))}</p></blockquote>"
        if r < 0.17:
            return f"<table><tr><th>{mark(words(1, 3))}</th><td>{mark(words(1, 6))}</td></tr></table>"
        if r < 0.25:
            return f"<h2>{mark(words(1, 8))}</h2>"
        if r < 0.29:
            return f"<pre><code>{mark(words(3, 20))}</code></pre>"
        if r < 0.40:
            return f"<a href=/z><p>{mark(prose(1, 3))}</p></a>"
        if r < 0.43:
            return f"<figure><img src=x><figcaption>{mark(sentence())}</figcaption></figure>"
        text = prose()
        if rng.random() < 0.3:
            text = f"{text} <a href=/x>\x01{words(1, 4)}</a>\x01 {sentence()}"
        if rng.random() < 0.25:
            tag = rng.choice(["em", "i", "span", "code", "sup", "strong", "font", "mi"])
            around = (f"<math><{tag}>", f"</{tag}></math>") if rng.random() < 0.2 else (f"<{tag}>", f"</{tag}>")
            text = f"{text} {around[0]}\x01{words(1, 3)}{around[1]}\x01 {words(1, 6)}"
        if rng.random() < 0.2:
            text = f"<b>{mark(words(1, 5))}</b>\x01 {text}"
        elif rng.random() < 0.2:
            text = f"<b>{mark(text)}<br>"
            return f"<p>{text}"
        return f"<p>{mark(text)}" + ("</p>" if rng.random() < 0.8 else "")

    out = []
    for _ in range(n):
        # some articles have no element of their own; without anything around them they need not even have a heading
        opened = "" if rng.random() < 0.15 else "<div>" if rng.random() < 0.1 else named("content")
        inner = [f"<h1>{mark(words(1, 12) if rng.random() < 0.6 else prose(1, 3))}</h1>"] + [paragraph() for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 14, 30]))]
        if rng.random() < 0.06:  # long articles of very short paragraphs
            inner += [f"<p>{mark(sentence(1, 3))}" for _ in range(rng.randint(30, 200))]
        if rng.random() < 0.2:
            inner[0] = f"<header>{inner[0]}</header>"
        elif rng.random() < 0.15:
            inner.pop(0)
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            inner.insert(rng.randint(1, len(inner)), boiler())
        most = rng.choice([0, 2, 4, 4])
        before, after = "".join(boiler() for _ in range(rng.randint(0, most))), "".join(boiler() for _ in range(rng.randint(0, most)))
        body = before + opened + "".join(inner) + end(opened) + after
        if rng.random() < 0.3:
            body = f'<div class="{rng.choice(_NAMES["both"])} {rng.choice(_NAMES["both"])}">{body}</div>'
        page = Page(f"<html><head><title>{words(1, 5)}</title><style>p{{}}</style></head><body>{body}</body></html>" if rng.random() < 0.9 else body)
        label = [0] * len(page.tag)
        inside: list[list[int]] = [[0, 0] for _ in label]
        for i in range(len(label) - 1, -1, -1):
            t = page.text[i]
            if t is not None:
                label[i] = int("\x01" in t)
                page.text[i] = t.replace("\x01", "")
                inside[i][label[i]] += 1
            else:
                label[i] = int(inside[i][1] > 2 * inside[i][0] and page.tag[i] not in ("html", "body"))
            if page.parent[i] >= 0 and (t is None or not t.isspace()):
                inside[page.parent[i]][0] += inside[i][0]
                inside[page.parent[i]][1] += inside[i][1]
        out.append((page, label))
    return out


@functools.lru_cache(1)
def default_model() -> Model:
    """The model of the generator's pages; the same on every machine."""
    return Model.train(labelled_pages())


def extract_text(df: DataFrame, model: Model | None = None, html_col: str = "html") -> DataFrame:
    """df with a column ``_main``: the page's main text."""
    shared = df.sparkSession.sparkContext.broadcast(model or default_model())  # a few thousand numbers

    @F.pandas_udf("string")
    def apply(source: pd.Series) -> pd.Series:
        return pd.Series(extract(list(source), shared.value), dtype=object)

    return small_batches(df).withColumn(free(df, "_main"), apply(F.col(html_col)))


def op4_html_extract(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", F.col("_main").alias("text"), F.char_length("_main").cast("long").alias("n_chars"))
