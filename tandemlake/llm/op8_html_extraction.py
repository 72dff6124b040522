"""Main text of web pages: gradient-boosted trees over DOM-node features with hierarchical decoding.

Every block element of the page's tree gets a probability of being main text, from its tag, its attribute tokens
and those above it, the density of its subtree, its depth and its siblings (dom.py). Decoding then chooses for
each element, from the leaves up, whether all of it stays, all of it goes, or its children decide; so no element
that goes has a descendant that stays, nor the reverse. Losing main text weighs more than keeping other text (LOSS); the
own text of menus, footers, sidebars and forms never stays; where nothing would stay, `remainder` decides.

The trees are trained here, on pages that `training_page` writes by rule: many layouts, with and without telling
tags and attributes, whose main text is known. TRAINING_PAGES bounds that set.

Defined results: a null or empty page, and one without text, has the empty text; text outside any element counts
as the page's own; markup without end is closed at the end of the page; equal pages get equal texts; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemlake.llm.common import small_batches, table, text_slices
from tandemlake.llm.dom import TOKENS, Tree, node_features

TRAINING_PAGES = 2500
#: Share of them that are bare text.
BARE = 0.12
TREES, DEPTH, RATE, BINS, SAMPLE = 60, 6, 0.2, 32, 0.4
#: What leaving a choice to the children costs, in log-probability.
MIXED = -0.7
#: Losing main text weighs more than keeping other text: an element goes only at odds of e^LOSS to one.
LOSS = 0.25
#: Elements, and names of elements, that hold no main text.
ASIDE = frozenset("nav menu header footer aside form".split())
#: Those whose own text never is, whatever the trees say, and by what odds (the logarithm); what lies in them may be.
NEVER_MAIN, SURE = frozenset("nav menu footer aside form".split()), 6.0
NAMED_ASIDE = frozenset("menu header footer side advert notice form social".split())


@dataclass
class Boosted:
    """Complete binary trees of one depth: feature and threshold of each inner node, value of each leaf."""

    features: np.ndarray
    thresholds: np.ndarray
    leaves: np.ndarray
    start: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.features.shape[1]
        for f, t, v in zip(self.features, self.thresholds, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - inner]
        return out


def fit_boosted(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Boosted:
    """Logistic loss, second-order leaf values, histogram splits on at most BINS quantiles of each feature. Each tree sees
    SAMPLE of the rows, drawn with a seed of its own."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(width)]
    binned = np.stack([np.searchsorted(edges[k], x[:, k], "left") for k in range(width)])
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    model = Boosted(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))))
    margin = np.full(n, model.start)
    for tree in range(trees):
        chosen = np.random.default_rng(tree).random(n) < SAMPLE
        p = 1 / (1 + np.exp(-margin[chosen]))
        g, h = p - y[chosen], p * (1 - p) + 1e-9
        seen, bins = x[chosen], binned[:, chosen]
        rows = np.arange(len(seen))
        at = np.zeros(len(seen), np.int64)
        for level in range(DEPTH):
            base, count = 2**level - 1, 2**level
            own = at - base
            best = np.full(count, 1e-6)
            for k in range(width):
                cells = len(edges[k]) + 1
                if cells < 2:
                    continue
                code = own * cells + bins[k]
                gs = np.bincount(code, g, count * cells).reshape(count, cells).cumsum(axis=1)
                hs = np.bincount(code, h, count * cells).reshape(count, cells).cumsum(axis=1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = (gs**2 / (hs + 1) + (ga - gs) ** 2 / (ha - hs + 1) - ga**2 / (ha + 1))[:, :-1]
                gain[(hs[:, :-1] < 1) | (ha - hs[:, :-1] < 1)] = 0
                split = gain.argmax(axis=1)
                for node in np.flatnonzero(gain[np.arange(count), split] > best):
                    best[node] = gain[node, split[node]]
                    model.features[tree, base + node], model.thresholds[tree, base + node] = k, edges[k][split[node]]
            at = 2 * at + 1 + (seen[rows, model.features[tree, at]] > model.thresholds[tree, at])
        leaf = at - inner
        model.leaves[tree] = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + 1)
        one = Boosted(model.features[tree : tree + 1], model.thresholds[tree : tree + 1], model.leaves[tree : tree + 1], 0.0)
        margin += one.margins(x)
    return model


def training_page(seed: int) -> str:
    """A page whose elements bear data-main="1" (main text below) or "0" (none); one without either is main text throughout."""
    r = random.Random(seed)
    syllables = "an be co da en fi ga ho in ja ke lo mu ne or pa qu ri st th un ve wi xa yo zu".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))

    def sentences(a: int, b: int) -> str:
        out = []
        for _ in range(r.randint(a, b)):
            s = words(1, 16).capitalize()
            out.append((s.replace(" ", ", ", 1) if r.random() < 0.4 else s) + ".")
        return " ".join(out)

    def mark(tag: str, main: int | None, inside: str, *names: str) -> str:
        flag = "" if main is None else f' data-main="{main}"'
        name = f' {r.choice(("class", "id", "class"))}="{r.choice(names)}"' if names and (tag in ("div", "section", "ul", "p", "span") or r.random() < 0.5) else ""
        return f"<{tag}{name}{flag}>{inside}</{tag}>"

    link_list = lambda a, b: "<ul>" + "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(r.randint(a, b))) + "</ul>"
    text_or_links = lambda: sentences(1, 3) if r.random() < 0.5 else link_list(2, 6)
    wordy = lambda: "".join(f"<p>{sentences(1, 4)}</p>" for _ in range(r.randint(1, 4)))

    if r.random() < BARE:  # nothing but text: without any element, or in one block or a few
        text = r.choice((lambda: words(1, 4), lambda: sentences(1, 1), lambda: sentences(1, 4)))
        blocks = [text() if r.random() < 0.3 else mark(r.choice(("p", "p", "div", "h1", "pre")), 1, text()) for _ in range(r.choice((1, 1, 1, 2, 3)))]
        if not any("data-main" in b for b in blocks) or r.random() < 0.3:
            blocks = [re.sub("<[^>]*>", "", b) for b in blocks]
            return r.choice(("{}", "<body>{}</body>", "<html><head><title>t</title></head><body>{}</body></html>")).format(" ".join(blocks))
        return r.choice(("{}", "<body data-main='1'>{}</body>", "<html><head><title>t</title></head><body data-main='1'>{}</body></html>")).format("".join(b for b in blocks if "data-main" in b))

    menu = lambda: mark(r.choice(("nav", "nav", "div", "ul")), 0, link_list(2, 9), "menu", "nav", "navbar", "main-menu", "breadcrumbs")
    header = lambda: mark(r.choice(("header", "div")), 0, r.choice((f"<h2>{words(1, 3)}</h2>", f"<p>{sentences(1, 1)}</p>", f"<a href='/'>{words(1, 2)}</a>")), "header", "site-header", "masthead", "top")
    advert = lambda: mark(r.choice(("div", "div", "aside", "section")), 0, r.choice((sentences(1, 3), f"<p>{sentences(1, 3)}</p>", f"<a href='x'>{words(3, 12)}</a>")), "ad", "ads", "advert", "ad-banner", "sponsored", "promo-box")
    notice = lambda: mark(r.choice(("div", "div", "section", "aside")), 0, r.choice((sentences(1, 3), f"<p>{sentences(1, 3)}</p>")) + "<button>OK</button>" * r.randint(0, 1), "cookie", "cookie-notice", "consent", "notice", "alert", "gdpr popup")
    side = lambda: mark(r.choice(("aside", "aside", "div")), 0, f"<h3>{words(1, 3)}</h3>" + r.choice((link_list(2, 8), wordy())), "sidebar", "side", "widget", "related", "popular-posts")
    form = lambda: mark(r.choice(("form", "form", "div")), 0, f"<p>{sentences(1, 2)}</p><label>{words(1, 3)}</label><input name='e'><button>{word()}</button>", "newsletter", "subscribe", "search-form", "login")
    share = lambda: mark("div", 0, " ".join(f"<a href='#'>{word()}</a>" for _ in range(r.randint(2, 5))), "share", "social", "sharing")
    footer = lambda: mark(r.choice(("footer", "footer", "div")), 0, r.choice((f"&copy; {word()}.example &middot; {sentences(1, 2)}", f"<p>&copy; {words(1, 5)}</p>" + link_list(1, 5), f"<p>{sentences(1, 2)}</p>")), "footer", "site-footer", "copyright", "bottom")

    def comments() -> str:
        one = lambda: r.choice((f"<li><b>{word()}</b><p>{sentences(1, 5)}</p></li>", f"<div class='{r.choice(('comment', 'reply', 'c'))}'><p>{sentences(1, 5)}</p></div>", f"<p>{sentences(1, 4)}</p>"))
        return mark(r.choice(("section", "div", "ol", "div")), 0, f"<h3>{words(1, 3)}</h3>" * r.randint(0, 1) + "".join(one() for _ in range(r.randint(1, 6))), "comments", "comment-list", "discussion", "reader-comments", "replies")

    link = lambda a, b: f"<a href='/{word()}'>{words(a, b)}</a>"
    name = lambda *names: f" {r.choice(('class', 'id'))}='{r.choice(names)}'" if r.random() < 0.6 else ""
    kinds = ("ul", "ol", "ol")
    #: Main text that looks like something else: lists of sources, paragraphs that are links, captions, boxes.
    ODD = (
        lambda: f"<{(t := r.choice(kinds))}{name('references', 'notes', 'sources', 'footnotes', 'further-reading', 'x')}>" + "".join(f"<li>{r.choice((link(3, 14), link(2, 9), words(1, 6) + '. ' + link(1, 8) + '.'))}</li>" for _ in range(r.randint(2, 9))) + f"</{t}>",
        lambda: f"<p{name('link', 'source', 'more', 'ref', 'p')}>{link(2, 14)}</p>",
        lambda: f"<p>{link(1, 8)}, {link(1, 8)}.</p>",
        lambda: f"<figure{name('image', 'wide', 'media', 'photo')}><img src='/x.png'><figcaption{name('caption', 'credit')}>{r.choice((sentences(1, 2), words(1, 9)))}</figcaption></figure>",
        lambda: f"<section{name('highlights', 'summary', 'intro', 'key-points', 'note', 'chapter', 'lead', 'box', 'infobox', 'part')}>{wordy()}</section>",
        lambda: f"<div{name('highlight', 'pullquote', 'excerpt', 'alert-text', 'info', 'more-text', 'top-story', 'row', 'b2')}><p>{sentences(1, 4)}</p></div>",
        lambda: f"<dl><dt>{words(1, 3)}</dt><dd>{sentences(1, 2)}</dd><dt>{words(1, 3)}</dt><dd>{sentences(1, 1)}</dd></dl>",
        lambda: f"<pre>{words(3, 30)}</pre>",
        lambda: f"<h{r.choice('3456')}>{words(1, 7)}</h3>",
    )

    def body() -> str:
        if r.random() < 0.12:  # a very short article
            return r.choice(("", f"<h1 data-main='1'>{words(1, 5)}</h1>")) + f"<p data-main='1'>{r.choice((words(1, 4).capitalize() + '.', sentences(1, 1)))}</p>"
        out = [f"<{r.choice(('h1', 'h1', 'h2'))}>{words(2, 12).capitalize()}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.choice((1, 2, 4, 8, 14))):
            kind = r.random()
            if kind < 0.62:
                out.append(f"<p>{sentences(1, r.choice((1, 1, 4, 9)))}</p>" if r.random() < 0.9 else f"<p>{sentences(1, 5)}")
            elif kind < 0.68:
                out.append(f"<p><b>{sentences(1, 2)}<br>")
            elif kind < 0.73:
                out.append("<ul>" + "".join(f"<li>{sentences(1, 1) if r.random() < 0.7 else words(1, 3)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.77:
                out.append(f"<blockquote>{sentences(1, 3)}</blockquote>")
            elif kind < 0.81:
                out.append(f"<h2>{words(1, 6)}</h2>")
            elif kind < 0.84:
                out.append(f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 9)}</td></tr></table>")
            elif kind < 0.96:
                out.append(r.choice(ODD)())
            else:
                out.append(f"<p>{words(2, 6)} <a href='/x'>{words(1, 4)}</a> {sentences(1, 2)}</p>")
        if r.random() < 0.08:
            out = [re.sub(r"^<p>(.*)</p>$", r"<div>\1</div>", x) for x in out]
        for k in range(len(out)):  # every block on its own says that it is main text
            out[k] = re.sub(r"^<(\w+)", r'<\1 data-main="1"', out[k])
            if r.random() < 0.06:
                out[k] += r.choice((advert, share, form, side, notice))()
        return "".join(out)

    #: Names of what holds an article, some of which tell of something else too.
    held = lambda: r.choice(("content", "post", "entry", "article", "main", "page", "story", "comment", "news", "single", "blog")) + "-" + r.choice(("wrap", "wrapper", "sidebar-wrap", "with-sidebar", "no-sidebar", "area", "piece", "inner", "col", "block", "header-wrap", "text", "holder"))
    article = body()
    if r.random() < 0.12:
        article = mark(r.choice(("div", "div", "section")), None, article, held())
    inner = r.random()
    if inner < 0.55:
        article = mark("article", None, article, "post", "entry", "story")
    elif inner < 0.85:
        article = mark(r.choice(("div", "section")), None, article, "content", "post", "entry-content", "article-body", "main", "story", "a", "col", "x1")
    if r.random() < 0.3:
        article = article[: -len("</article>")] + comments() + "</article>" if article.endswith("</article>") else article + comments()
    elif r.random() < 0.25:
        article += comments()
    if r.random() < 0.3:
        article = mark(r.choice(("main", "div")), None, article, "content", "main", "wrapper", "container", held(), held())
    head = [x() for x, p in ((notice, 0.2), (header, 0.35), (menu, 0.75), (advert, 0.5)) if r.random() < p]
    tail = [x() for x, p in ((share, 0.15), (side, 0.3), (form, 0.2), (advert, 0.2), (footer, 0.8), (notice, 0.15)) if r.random() < p]
    if r.random() < 0.3:
        r.shuffle(head)
        r.shuffle(tail)
    page = "".join(head) + article + "".join(tail)
    if r.random() < 0.25:
        page = mark("div", None, page, "wrapper", "page", "site", "container", held())
    return f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><script>var x='</p>';</script></head><body>{page}</body></html>"


def labelled(source: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the elements all of whose text is, or is not, main text."""
    tree = Tree(source)
    flags = [re.search(r"""data-main=["']([01])""", a) for a in tree.attributes]
    own = [int("data-main" not in source)] * len(flags)
    for k in range(1, len(flags)):
        own[k] = int(flags[k][1]) if flags[k] else own[tree.parent[k]]
    good, bad = np.zeros(len(own)), np.zeros(len(own))
    for text, owner in zip(tree.texts, tree.owner, strict=True):
        (good if own[owner] == 1 else bad)[owner] += len(text)
    for k in range(len(own) - 1, 0, -1):
        good[tree.parent[k]] += good[k]
        bad[tree.parent[k]] += bad[k]
    pure = (good == 0) != (bad == 0)
    return node_features(tree)[pure], (good > 0)[pure].astype(float)


_trained: list[Boosted] = []


def trained() -> Boosted:
    """The model, trained once in a process; the training set and so the model are always the same."""
    if not _trained:
        rows = [labelled(training_page(seed)) for seed in range(TRAINING_PAGES)]
        _trained.append(fit_boosted(np.concatenate([x for x, _ in rows]), np.concatenate([y for _, y in rows])))
    return _trained[0]


def decode(tree: Tree, margins: np.ndarray) -> list[bool]:
    """For each block of text whether it stays: the best consistent choice for all elements."""
    n = len(tree.tag)
    margins = margins + LOSS
    sure = np.array([t in NEVER_MAIN for t in tree.tag])
    margins = np.where(sure, np.minimum(margins, -SURE), margins)
    keep = -np.logaddexp(0, -margins)
    drop = -np.logaddexp(0, margins)
    has_text = np.zeros(n, bool)
    has_text[tree.owner] = True
    for k in range(n - 1, 0, -1):
        has_text[tree.parent[k]] |= has_text[k]
    keep_all, drop_all = np.where(has_text, keep, 0).tolist(), np.where(has_text, drop, 0).tolist()
    mixed = [MIXED] * n
    best = [0.0] * n
    for k in range(n - 1, -1, -1):
        best[k] = max(keep_all[k], drop_all[k], mixed[k])
        if k:
            p = tree.parent[k]
            keep_all[p] += keep_all[k]
            drop_all[p] += drop_all[k]
            mixed[p] += best[k]
    state = [0] * n  # 1 all stays, -1 all goes, 0 the children decide
    for k in range(n):
        above = state[tree.parent[k]] if k else 0
        state[k] = above or (1 if keep_all[k] >= best[k] else -1 if drop_all[k] >= best[k] else 0)
    stays = [state[o] > 0 or (state[o] == 0 and margins[o] > 0) for o in tree.owner]
    return stays if any(stays) else remainder(tree)


def remainder(tree: Tree) -> list[bool]:
    """For a page of which nothing would stay: the blocks with a word that lie in no menu, header, footer, sidebar, form, notice or
    advert by tag or by name; among them those outside reader comments, if there are such."""
    n = len(tree.tag)
    outside, replies = [False] * n, [False] * n
    for k in range(1, n):
        names = {x for j, x in enumerate(TOKENS) if tree.attribute_groups(k) >> j & 1}
        aside = tree.tag[k] in ASIDE or (bool(names & NAMED_ASIDE) and "content" not in names)
        outside[k], replies[k] = outside[tree.parent[k]] or aside, replies[tree.parent[k]] or "comment" in names
    wordy = [not outside[o] and re.search(r"\w", t) is not None for t, o in zip(tree.texts, tree.owner, strict=True)]
    plain = [w and not replies[o] for w, o in zip(wordy, tree.owner, strict=True)]
    return plain if any(plain) else wordy


def extract(pages: list[str], model: Boosted) -> list[str]:
    trees = [Tree(p) for p in pages]
    rows = [node_features(t) for t in trees]
    margins = model.margins(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for tree in trees:
        own = margins[at : at + len(tree.tag)]
        at += len(tree.tag)
        out.append("\n\n".join(t for t, stays in zip(tree.texts, decode(tree, own), strict=True) if stays))
    return out


def main_texts(pages: DataFrame, keep: list[str], source: str = "html", model: Boosted | None = None) -> DataFrame:
    """`keep` columns and the main text of each page; one narrow pass."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in text_slices(batch, source, 1 << 19):
                found = extract([x or "" for x in part.column(source).to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(found, pa.string())], [*keep, "text"])

    chosen = small_batches(pages).select(*dict.fromkeys([*keep, source]))
    schema = ", ".join([*(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in keep), "text string"])
    return chosen.mapInArrow(run, schema)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"), ["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))
