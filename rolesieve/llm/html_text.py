"""Main text of a web page by composite text density.

The page becomes a tree of elements.  Each node's density is its characters per tag,
adjusted for links: with C characters, T tags, LC of them link characters and LT link
tags, CTD = C / T * log_b(C / LC * T / LT), b = ln(C / (C - LC) * LC + LCb / Cb * C + e),
Cb and LCb those of the body, every zero taken as one.  A node's sum is that of its
children's densities; the subtree of greatest sum is the article.  The least density on
its path up to the body is the threshold: inside it, blocks that hold links and fall
below go.  What the markup itself gives as no article (navigation, headers, footers,
asides, forms, hidden parts) never counts.  Densities choose the article before any name is
looked at; then, off its path, what a whole token of its class, id or role names as
something else (adverts, comments ...) goes, and the choice is made once more on the rest.
A name never counts against an element that holds the article or most of the text.

Null and empty pages give an empty text; broken markup is closed as browsers do, unclosed
quotes included; repeated rows are extracted each; an empty table gives no rows; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from math import e, log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Attributes are read in one way only: stretches without = and >, then = with a quoted value where its quote is closed.
TAGS = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>|([^<]+|<)", re.S)
PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>()")
NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
UNFINISHED = re.compile(r"<[a-zA-Z/!?]")
#: Elements whose content is not text of the page.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
OUTSIDE = {"head", "nav", "header", "footer", "aside", "select", "option", "svg", "canvas", "object", "dialog", "menu", "datalist", "input", "audio", "video", "annotation", "annotation-xml"}
#: Noise unless a sentence goes on around them, and noise unless they hold the page (server-made pages are one form).
CONTROLS, FORMS = {"button", "label", "math"}, {"form", "fieldset"}
SENTENCES = {"p", "li", "td", "th", "dd", "dt", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "figcaption", "caption", "div", "section", "article"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img label button math mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup mover munder munderover mstyle mpadded semantics".split())
SOFT = {"br", "wbr", "img"}
#: What an opening tag closes first, as browsers do, up to the named borders.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Whole tokens of class or id, and roles, that name what is not the article.  Words that articles use for their
#: own parts too (notice, related, share, toc, widget, search ...) are not among them: density and links decide.
NOISE = set("ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored breadcrumb breadcrumbs nav navbar navigation menu menubar sidebar side-bar footer site-footer page-footer site-header masthead cookies cookie-banner cookie-notice cookie-consent gdpr popup newsletter subscribe social social-links social-share share-buttons sharing comments comment comment-list comments-area disqus respond replies pagination pager toolbar skip-link".split())
ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "dialog", "alertdialog", "menu", "menubar", "toolbar"}


class Node:
    __slots__ = ("tag", "parent", "children", "chars", "tags", "link_chars", "link_tags", "noise", "named", "within", "density")

    def __init__(self, tag: str, parent: Node | None, noise: bool):
        self.tag, self.parent, self.noise, self.named = tag, parent, noise, False
        #: Whether it is or stands inside an article.
        self.within = tag in ("article", "main") or (parent is not None and parent.within)
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = 0.0


def is_noise(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in OUTSIDE and not (tag == "header" and inside_article):
        return True
    if attributes and tag not in ("html", "body", "article", "main"):
        for name, value in NAMED.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                return True
    return False


def is_named(tag: str, attributes: str) -> bool:
    """Whether class, id or role name it as no article."""
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, value in NAMED.findall(attributes):
        name, tokens = name.lower(), value.strip("\"'").lower().replace("_", "-").split()
        if name in ("class", "id", "role") and not (ROLES if name == "role" else NOISE).isdisjoint(tokens):
            return True
    return False


def drop_named(root: Node, best: Node) -> bool:
    """Makes noise of what its name gives as such off the path of ``best``; whether there was any.

    Spared is what holds the article or, where none is marked up, most of the text.
    """
    path, up = set(), best
    while up:
        path.add(up)
        up = up.parent
    nodes = preorder(root)
    if not any(n.named and n not in path for n in nodes):
        return False
    holds: dict[Node, bool] = {}
    for n in reversed(nodes):  # children before parents
        holds[n] = n.tag in ("article", "main") or any(holds.get(c, False) for c in n.children if isinstance(c, Node))
    changed = False
    for n in nodes:  # parents before children
        if n.parent and n.parent.noise:
            n.noise = True
        elif n.named and n not in path and not holds[n] and (holds[root] or 2 * n.chars <= root.chars):
            n.noise = changed = True
    return changed


def parse(page: str) -> Node:
    """The tree of a page; text stays as strings among the children."""
    root = Node("body", None, False)
    at, position, last = root, 0, page.rfind(">")
    while position <= last and (m := TAGS.search(page, position)):
        position = m.end()
        close, tag, attributes, text = m.groups()
        if text == "<" and UNFINISHED.match(page, m.start()):  # a tag whose quotes hold its end
            if page.find("<", position) < 0:
                return root  # the page ends in it
            if m := PLAIN.match(page, m.start()):
                position = m.end()
                close, tag, attributes, text = m.groups()
        if text:
            at.children.append(text)
            continue
        if not tag:
            continue
        tag = tag.lower()
        if tag in ("html", "body"):
            continue
        if not close:
            if tag in RAW:
                end = re.compile(f"</{re.escape(tag)}[^>]*>", re.I).search(page, position)
                position = end.end() if end else len(page)
                continue
            if tag in CLOSES:
                ends, border = CLOSES[tag]
                up = at
                while up.parent and up.tag not in border and up.tag not in ends:
                    up = up.parent
                if up.tag in ends and up.parent:
                    at = up.parent
            elif tag not in INLINE:
                up = at  # a block closes an open paragraph
                while up.parent and (up.tag in INLINE or up.tag == "p"):
                    if up.tag == "p":
                        at = up.parent
                        break
                    up = up.parent
            node = Node(tag, at, at.noise or is_noise(tag, attributes, at.within))
            node.named = is_named(tag, attributes)
            at.children.append(node)
            if tag not in VOID and not attributes.rstrip().endswith("/"):
                at = node
        else:
            up = at
            while up.parent and up.tag != tag:
                if tag in INLINE and up.tag not in INLINE:
                    up = None  # a stray end of a formatting element
                    break
                up = up.parent
            if up is not None and up.parent:
                at = up.parent
    if position < len(page):  # no tag ends here any more
        at.children.append(UNFINISHED.split(page[position:], maxsplit=1)[0])
    return root


def preorder(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        if not n.noise:
            out.append(n)
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]
    return out


def settle(root: Node) -> None:
    """Makes noise of forms that hold neither an article nor most of the text, and of controls outside sentences."""
    nodes = preorder(root)
    chars: dict[Node, int] = {}
    holds: dict[Node, bool] = {}
    for n in reversed(nodes):  # children before parents
        inner = [c for c in n.children if isinstance(c, Node)]
        chars[n] = sum(len("".join(c.split())) for c in n.children if isinstance(c, str)) + sum(chars.get(c, 0) for c in inner)
        holds[n] = n.tag in ("article", "main") or any(holds.get(c, False) for c in inner)
    for n in nodes:
        if n.tag in FORMS:
            n.noise = not holds[n] and 2 * chars[n] <= chars[root]
        elif n.tag in CONTROLS:
            up = n.parent
            while up and up.tag in INLINE:
                up = up.parent
            n.noise = not (up and up.tag in SENTENCES and any(isinstance(c, str) and c.strip() for c in up.children))


def widened(best: Node) -> tuple[Node, set[Node]]:
    """The least subtree that holds ``best`` and the text of like density beside it, and what of it does not belong.

    One step up is made wherever further text stands at that level: in a marked article any block of at least a third of
    the density, few links and 100 characters (or a twentieth of those that ``best`` has), elsewhere such blocks with a
    fifth of its characters together.  Outside an article
    what lies before the first or after the last of these is left out, but for a heading that leads in.
    """
    cut: set[Node] = set()
    level = best
    while (up := level.parent) and level.tag != "article":
        like = [c for c in up.children if isinstance(c, Node) and c is not level and not c.noise and not c.named and c.tag not in INLINE and c.chars >= min(100, level.chars / 20) and 3 * c.link_chars < c.chars and 3 * c.density >= level.density]
        if like and (up.within or 5 * sum(c.chars for c in like) >= level.chars):
            if not up.within:
                peers = [c for c in up.children if isinstance(c, Node)]
                at = [i for i, c in enumerate(peers) if c is level or c in like]
                first = at[0]
                while first and re.fullmatch("h[1-6]", peers[first - 1].tag):
                    first -= 1
                cut.update(peers[:first] + peers[at[-1] + 1 :])
            best = up
        elif not up.within:
            break
        level = up  # in an article, what is alone at one level may have company at the next
    return best, cut


def main_node(root: Node) -> tuple[Node, float]:
    """The subtree of greatest density sum and the threshold of its path."""
    nodes = preorder(root)
    for n in reversed(nodes):  # children before parents
        n.chars = n.tags = n.link_chars = n.link_tags = 0
        n.density = 0.0
        for c in n.children:
            if isinstance(c, str):
                n.chars += len("".join(c.split()))
            elif not c.noise:
                n.chars += c.chars
                n.tags += c.tags + 1
                n.link_chars += c.link_chars
                n.link_tags += c.link_tags + (c.tag == "a")
        if n.tag == "a":
            n.link_chars = n.chars
    whole = (root.link_chars or 1) / (root.chars or 1)
    for n in nodes:
        c, t = n.chars, n.tags or 1
        if c:
            base = log(c / max(1, c - n.link_chars) * n.link_chars + whole * c + e)
            n.density = c / t * max(0.0, log(max(c / (n.link_chars or 1) * t / (n.link_tags or 1), 1.0)) / log(max(base, 1.0001)))
    best, most = root, -1.0
    for n in nodes:
        if n.tag in INLINE:
            continue
        total = sum(c.density for c in n.children if isinstance(c, Node) and not c.noise)
        total += sum(len("".join(c.split())) for c in n.children if isinstance(c, str))  # bare text is a child of its own
        if total > most:
            best, most = n, total
    if best.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "ul", "ol", "table") and best.parent:
        best = best.parent  # one block is not an article
    return best, path_threshold(best)


def path_threshold(best: Node) -> float:
    """The least density on the way from the body to ``best``."""
    threshold, up = best.density, best
    while up:
        threshold, up = min(threshold, up.density), up.parent
    return threshold


def extract(page: str) -> str:
    """Blocks of the article, white space in each made one space, joined by an empty line."""
    if not page:
        return ""
    root = parse(page)
    settle(root)
    best, _ = main_node(root)
    if drop_named(root, best):
        best, _ = main_node(root)
    best, cut = widened(best)
    threshold = path_threshold(best)
    blocks: list[str] = []
    words: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(words)).split())
        if text:
            blocks.append(text)
        words.clear()

    stack: list = [best]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            words.append(x)
        elif x.tag in SOFT:
            words.append(" ")
        elif not x.noise and x not in cut:
            if x is not best and x.tag not in INLINE and x.link_chars and x.density < threshold and 2 * x.link_chars > x.chars:
                continue
            if x.tag in INLINE:
                stack += reversed(x.children)
            else:
                flush()
                stack.append(None)
                stack += reversed(x.children)
    flush()
    return "\n\n".join(blocks)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row, from its whole ``html``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                part = pdf.iloc[lo : lo + 500]
                text = [extract(h) if isinstance(h, str) else "" for h in part["html"]]
                yield pd.DataFrame({"page_id": part["page_id"].to_numpy(), "url": part["url"].to_numpy(), "text": text, "n_chars": [len(t) for t in text]})

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInPandas(run, "page_id long, url string, text string, n_chars long")
