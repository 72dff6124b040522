"""A small HTML tree builder and the node features of the extractor."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterable

import numpy as np

VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
#: Elements whose content is no markup, to their end tag or the end of the page.
RAW = frozenset("script style title textarea iframe noframes".split())
#: Form controls, whose text is no text of the page. One without an end tag ends with its parent or where a block starts.
CONTROL = frozenset("select button".split())
_CONTROL_TAG = {t: re.compile(rf"<(/?){t}[\s/>]", re.I) for t in CONTROL}
#: The next tag of a link: one that no end tag follows is no link, or all text behind it would count as linked.
_LINK_TAG = re.compile(r"<(/?)a[\s/>]", re.I)
#: Drawings and formulas: their text counts, their many tags don't.
FOREIGN = frozenset("svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul head xmp".split()
)
#: Start tags that end an open element of the given kind within the nearest scope.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": set()}
P_ENDERS = BLOCK - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "html", "head", "legend"}
P_SCOPE = frozenset("td th caption button object".split())
#: Attributes as HTML reads them: a quote opens a value only after '=', any other quote is an ordinary character. A quote
#: without a partner is one too, so a tag ends at the next '>' whenever the page has one.
_ATTRIBUTES = r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+"""
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*+)({_ATTRIBUTES}(?=>)|[^>]*+)(>?)", re.S)
_NAME = re.compile(r"(?:^|[\s/])(?:class|id)\s*=", re.I)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|aria-label|data-main)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

#: Attribute tokens by what they tell of an element.
TOKENS = {
    "content": "article content main post entry body story text blog page prose copy maincontent articlebody",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager tabs toc links sitemap",
    "header": "header masthead top topbar logo brand banner tagline hero",
    "footer": "footer foot bottom copyright legal colophon credits",
    "side": "sidebar side aside widget widgets rail complementary secondary related recommended popular trending more",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense outbrain taboola",
    "notice": "cookie cookies consent gdpr notice alert warning popup modal overlay dialog disclaimer privacy message toast",
    "comment": "comment comments commentlist reply replies respond discussion disqus reviews feedback thread",
    "form": "form subscribe subscription newsletter signup login search register contact input",
    "social": "share sharing social follow facebook twitter tweet like",
}
_TOKEN_GROUP: dict[str, list[int]] = {}
for _k, _words in enumerate(TOKENS.values()):
    for _w in _words.split():
        _TOKEN_GROUP.setdefault(_w, []).append(_k)
TAG_GROUPS = {
    "article": {"article", "main"}, "nav": {"nav", "menu"}, "header": {"header", "hgroup"}, "footer": {"footer"}, "aside": {"aside"},
    "form": {"form", "fieldset", "label", "legend"}, "heading": {"h1", "h2", "h3", "h4", "h5", "h6"}, "paragraph": {"p", "blockquote", "pre"},
    "list": {"ul", "ol", "dl"}, "item": {"li", "dt", "dd"}, "table": {"table", "tbody", "thead", "tr", "td", "th"},
    "figure": {"figure", "figcaption", "caption"}, "part": {"section", "div"},
}
_TAG_GROUP = {t: k for k, ts in enumerate(TAG_GROUPS.values()) for t in ts}
INHERITED_TAGS = [list(TAG_GROUPS).index(x) for x in ("article", "nav", "header", "footer", "aside", "form")]


class Tree:
    """Block elements in document order: parent, tag and attributes of each; and blocks of text with their owner."""

    def __init__(self, source: str):
        self.parent, self.tag, self.attributes = [-1], ["#"], [""]
        self.texts: list[str] = []
        self.owner: list[int] = []
        self.links: list[int] = []
        self.inline_tags = [0]
        stack: list[tuple[str, int]] = [("#", 0)]  # tag and the block element that it is or lies in
        opened: defaultdict[str, list[int]] = defaultdict(list)  # places in the stack by tag: no tag's search walks the stack
        pieces: list[str] = []
        linked = 0
        in_link = 0
        in_foreign = 0
        control = 0  # place in the stack of the form control that is open
        has_end = False
        at = 0

        def flush() -> None:
            nonlocal linked
            if pieces:
                text = " ".join("".join(pieces).split())
                if text:
                    self.texts.append(text)
                    self.owner.append(stack[-1][1])
                    self.links.append(min(linked, len(text)))
                pieces.clear()
                linked = 0

        def close(to: int) -> None:
            nonlocal in_link, in_foreign, control
            if stack[-1][1] != stack[to - 1][1]:
                flush()
            for t, _ in stack[to:]:
                opened[t].pop()
                in_link -= t == "a"
                in_foreign -= t in FOREIGN
            if to <= control:
                control = 0
            del stack[to:]

        def open_(tag: str, block: int) -> None:
            nonlocal in_link, in_foreign
            opened[tag].append(len(stack))
            stack.append((tag, block))
            in_link += tag == "a"
            in_foreign += tag in FOREIGN

        def nearest(tags: Iterable[str]) -> int:
            """Place of the innermost open element of these kinds; 0 if there is none."""
            return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

        def add_text(text: str) -> None:
            nonlocal linked
            if text and not control:
                text = html.unescape(text) if "&" in text else text
                pieces.append(text)
                if in_link:
                    linked += len(text.strip())

        skip_to = 0
        for m in _TOKEN.finditer(source):
            if m.start() < skip_to:
                continue
            add_text(source[at : m.start()])
            at = m.end()
            tag = m[2]
            if not tag:
                continue
            if not m[4]:  # a tag that never ends
                at = skip_to = len(source)
                break
            tag = tag.lower()
            if m[1]:
                if tag == "br":
                    pieces.append("" if control else " ")
                elif opened.get(tag):
                    close(opened[tag][-1])
                elif tag == "p":
                    flush()
                continue
            if tag in RAW and not m[3].endswith("/"):
                end = re.compile(rf"</{tag}[\s/>]", re.I).search(source, at)
                close_at = source.find(">", end.end() - 1) if end else -1
                at = skip_to = close_at + 1 if close_at >= 0 else len(source)
                continue
            if control and not has_end and (tag in BLOCK or tag in CONTROL):
                close(control)
            if control:  # no element in it is one of the page's
                if tag not in VOID and not m[3].endswith("/"):
                    open_(tag, stack[-1][1])
                continue
            if tag in P_ENDERS and nearest("p") > nearest(P_SCOPE):
                close(opened["p"][-1])
            if tag in ENDS:
                while (ended := nearest(ENDS[tag])) > nearest(SCOPE[tag]):
                    close(ended)
                    if tag != "tr":
                        break
            if tag in BLOCK:
                flush()
                if tag == "hr":
                    continue
                self.parent.append(stack[-1][1])
                self.tag.append(tag)
                self.attributes.append(m[3])
                self.inline_tags.append(0)
                open_(tag, len(self.tag) - 1)
            else:
                self.inline_tags[stack[-1][1]] += not in_foreign and tag not in FOREIGN
                if tag == "br":
                    pieces.append(" ")
                elif tag == "a" and not ((following := _LINK_TAG.search(source, at)) and following[1]):
                    continue
                elif tag not in VOID and not m[3].endswith("/"):
                    open_(tag, stack[-1][1])
                    if tag in CONTROL:
                        control = len(stack) - 1
                        following = _CONTROL_TAG[tag].search(source, at)
                        has_end = bool(following and following[1])
        if at < len(source):
            add_text(source[at:])
        flush()

    def attribute_groups(self, node: int) -> int:
        """Bits of the TOKENS groups that the element's attributes name."""
        bits = 0
        for m in _ATTRIBUTE.finditer(self.attributes[node]):
            if m[1].lower() != "data-main":
                for word in _CAMEL.findall(m[2] or m[3] or m[4] or ""):
                    for k in _TOKEN_GROUP.get(word.lower(), ()):
                        bits |= 1 << k
        return bits


FEATURES = (
    [f"tag_{x}" for x in TAG_GROUPS] + [f"token_{x}" for x in TOKENS] + [f"above_{x}" for x in TOKENS]
    + [f"under_{x}" for x in ("article", "nav", "header", "footer", "aside", "form")]
    + ["depth", "chars", "words_a_text", "link_share", "density", "stops", "share", "of_parent", "before", "siblings", "sibling_place", "sibling_paragraphs", "parent_paragraph_chars", "children", "named", "kin"]
)


def node_features(tree: Tree) -> np.ndarray:
    """A row of FEATURES for each block element: tags, attribute tokens (its own, and above it), depth, density of the
    subtree and statistics of its siblings."""
    n = len(tree.tag)
    chars, links, texts, stops, elements, words = ([0] * n for _ in range(6))
    before_text: list[int] = [0] * n
    own_paragraph = [0] * n
    for text, owner, linked in zip(tree.texts, tree.owner, tree.links, strict=True):
        chars[owner] += len(text)
        links[owner] += linked
        texts[owner] += 1
        stops[owner] += text.count(".") + text.count(",")
        words[owner] += text.count(" ") + 1
    own_chars = chars[:]
    groups = [_TAG_GROUP.get(t, -1) for t in tree.tag]
    children = [0] * n
    place = [0] * n
    paragraphs = [0] * n
    parent = tree.parent
    for k in range(1, n):
        p = parent[k]
        place[k] = children[p]
        children[p] += 1
        if tree.tag[k] == "p":
            paragraphs[p] += 1
            own_paragraph[p] += own_chars[k]
    running = 0
    for k in range(n):
        before_text[k] = running
        running += own_chars[k]
    elements = [1 + x for x in tree.inline_tags]
    for k in range(n - 1, 0, -1):
        p = parent[k]
        chars[p] += chars[k]
        links[p] += links[k]
        texts[p] += texts[k]
        stops[p] += stops[k]
        words[p] += words[k]
        elements[p] += elements[k]
    own_bits, above_bits, under, depth = [0] * n, [0] * n, [0] * n, [0] * n
    for k in range(1, n):
        p = parent[k]
        own_bits[k] = tree.attribute_groups(k) if "=" in tree.attributes[k] else 0
        above_bits[k] = above_bits[p] | own_bits[p]
        under[k] = under[p] | (1 << groups[p] if groups[p] >= 0 else 0)
        depth[k] = depth[p] + 1
    whole = max(1, chars[0])
    named = [_NAME.search(a) is not None if "=" in a else False for a in tree.attributes]
    kinds: dict[tuple[int, str], int] = {}
    for p, t in zip(parent, tree.tag, strict=True):
        kinds[p, t] = kinds.get((p, t), 0) + 1
    kin = [kinds[p, t] for p, t in zip(parent, tree.tag, strict=True)]  # elements of one kind under one parent
    out = np.zeros((n, len(FEATURES)), np.float32)
    bits, g = len(TOKENS), len(TAG_GROUPS)
    gathered = np.array(groups)
    tagged = np.flatnonzero(gathered >= 0)
    out[tagged, gathered[tagged]] = 1
    out[:, g : g + bits] = (np.array(own_bits)[:, None] >> np.arange(bits)) & 1
    out[:, g + bits : g + 2 * bits] = (np.array(above_bits)[:, None] >> np.arange(bits)) & 1
    out[:, g + 2 * bits : g + 2 * bits + 6] = (np.array(under)[:, None] >> np.array(INHERITED_TAGS)) & 1
    up = np.maximum(np.array(parent), 0)
    c, t, e = np.array(chars, float), np.maximum(np.array(texts), 1), np.array(elements)
    paragraph_count = np.array(paragraphs)
    columns = (
        depth, np.log1p(c), np.array(words) / t, np.array(links) / np.maximum(c, 1), np.log1p(c / e), 100 * np.array(stops) / np.maximum(c, 1), c / whole, c / np.maximum(c[up], 1),
        np.array(before_text) / whole, np.array(children)[up], np.array(place) / np.maximum(np.array(children)[up], 1), paragraph_count[up], np.log1p(np.array(own_paragraph)[up]), children, named, kin,
    )
    for k, column in enumerate(columns):
        out[:, g + 2 * bits + 6 + k] = column
    return out
