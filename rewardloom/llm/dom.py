"""A small reader of HTML into block elements, and their features as numpy arrays.

It follows what browsers do where it matters for text: scripts, drawings, styles and other raw text are skipped, paragraphs, list items
and cells end where the next begins, end tags that match nothing are ignored, quoted ``>`` do not end a tag. Formulas and objects are read like other elements, a self-closing drawing or formula is
empty. A form that holds blocks like an article's, as where a whole page stands in one, is taken for a ``div``.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

import numpy as np

#: Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes svg".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup html label legend li main menu nav ol optgroup option p pre section select summary table"
    " tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("button caption html body label legend optgroup option select tbody td tfoot th thead tr".split()) | {"hr"}
#: What a new element of this name ends, and inside what it does not look further up.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
TAG_GROUPS = (
    "p", "h1 h2 h3 h4 h5 h6", "li dt dd", "ul ol dl menu", "div center", "section", "article", "main", "nav", "aside", "footer", "header",
    "form fieldset button select label option legend optgroup", "table tbody thead tfoot tr caption", "td th", "blockquote pre",
    "figure figcaption", "body html",
)
#: Words in class, id and role attributes that say what an element is for.
TOKEN_GROUPS = (
    "content article post entry main body text story prose",
    "nav menu navbar navigation breadcrumb breadcrumbs pagination pager toc",
    "header masthead top",
    "footer foot copyright legal colophon",
    "sidebar aside side rail widget related recommended recommendations more trending",
    "ad ads advert advertisement adverts banner sponsor sponsored promo promoted promotion",
    "comment comments reply replies respond discussion disqus reader",
    "cookie cookies consent notice popup modal alert gdpr overlay newsletter subscribe signup paywall announcement warning",
    "share sharing social follow login search form tools toolbar buttons",
)
TAGS = {t: i for i, group in enumerate(TAG_GROUPS) for t in group.split()}
TOKENS = {t: 1 << i for i, group in enumerate(TOKEN_GROUPS) for t in group.split()}
#: Elements that tell their descendants something, in the order of the bits of ``above``.
TELLING = ("nav", "aside", "footer", "header", "form", "article", "main", "li", "table")

#: Elements nested deeper than this are taken for their ancestor's, as browsers do.
DEEPEST = 500

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*>",
    re.S,
)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: The end of attributes that closes an element of these, if the slash is no unquoted value's.
FOREIGN = frozenset(("svg", "math"))
CLOSED = re.compile(r"(?<!\S)/\Z|[\"']/\Z|\A/\Z|(?:^|\s)[^\s=]+/\Z")
#: A form with an element of these, or with so many other blocks of so many unlinked characters, is no mere form.
MARKS = frozenset(("article", "main", "h1"))
CONTROLS = frozenset("form fieldset button select label option legend optgroup".split())
LONG_BLOCKS, LONG = 2, 80
END_OF_RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}


class Page(NamedTuple):
    """Block elements in page order (parents first) and the texts that stand directly in them, in page order."""

    tag: list[str]
    parent: list[int]
    tokens: list[int]
    text_of: list[int]
    text: list[str]
    linked: list[int]


def token_mask(attributes: str, known: dict[str, int]) -> int:
    if attributes not in known:
        mask = 0
        for value in NAMED.findall(attributes):
            for part in PART.findall(value):
                mask |= TOKENS.get(part.lower(), 0)
        if len(known) > 50_000:
            known.clear()
        known[attributes] = mask
    return known[attributes]


def parse(html: str, known: dict[str, int]) -> Page:
    """``known`` remembers attributes between pages."""
    page = Page(["html"], [-1], [0], [], [], [])
    # Open elements as (name, number of the block or -1 if it is none).
    stack: list[tuple[str, int]] = [("html", 0)]
    held: list[str] = []
    block, links, linked, at, n = 0, 0, 0, 0, len(html)

    def flush() -> None:
        nonlocal linked
        if held:
            line = " ".join(unescape("".join(held)).split())
            if line:
                page.text_of.append(block)
                page.text.append(line)
                page.linked.append(min(linked, len(line)))
            held.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal block, links
        flush()
        links -= sum(name == "a" for name, _ in stack[depth:])
        del stack[depth:]
        block = next(i for _, i in reversed(stack) if i >= 0)

    while at < n:
        m = TOKEN.search(html, at)
        upto = m.start() if m else n
        if upto > at:
            piece = html[at:upto]
            held.append(piece)
            if links:
                linked += len(piece)
        if m is None:
            break
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name = name.lower()
        if m[1] or m[4]:
            if name == "br":
                held.append(" ")
            elif name in BLOCK:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == name:
                        close(depth)
                        break
            else:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == name:
                        links -= sum(x == "a" for x, _ in stack[depth:])
                        del stack[depth:]
                        break
                    if stack[depth][1] >= 0:
                        break
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p":
                    close(depth)
                    break
                if stack[depth][0] in ("td", "th", "button", "caption"):
                    break
        if name in ENDS:
            ended, within = ENDS[name]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in within:
                    break
                if stack[depth][0] in ended:
                    close(depth)
                    if name != "tr":
                        break
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in FOREIGN and CLOSED.search(m[3] or m[6] or ""):
            continue
        if name in RAW:
            end = END_OF_RAW[name].search(html, at)
            # A drawing that never ends is read on behind its tag, as the page's blocks would end it.
            at = end.end() if end else at if name in FOREIGN else n
            continue
        if name in ("html", "body", "head"):
            continue
        if name in BLOCK:
            flush()
            if len(stack) >= DEEPEST:
                continue
            page.tag.append(name)
            page.parent.append(block)
            page.tokens.append(token_mask(m[3] or m[6] or "", known) if (m[3] or m[6]) else 0)
            block = len(page.tag) - 1
            stack.append((name, block))
        elif len(stack) < DEEPEST:
            stack.append((name, -1))
            links += name == "a"
    flush()
    if "form" in page.tag:
        _open_forms(page)
    return page


def _open_forms(page: Page) -> None:
    """Make a ``div`` of every form that holds blocks like an article's."""
    unlinked = [0] * len(page.tag)
    for i, text, linked in zip(page.text_of, page.text, page.linked, strict=True):
        unlinked[i] += len(text) - linked
    found = [LONG_BLOCKS if t in MARKS else int(t not in CONTROLS and u >= LONG) for t, u in zip(page.tag, unlinked, strict=True)]
    for i in range(len(found) - 1, 0, -1):
        # Text that stands in the form itself counts like a block's.
        if page.tag[i] == "form":
            found[i] += unlinked[i] >= LONG
            if found[i] >= LONG_BLOCKS:
                page.tag[i] = "div"
                page.tokens[i] &= ~TOKENS["form"]
        found[page.parent[i]] += found[i]


class Forest(NamedTuple):
    """The elements of many pages: numbers of page, parent (-1: none) and depth, features, and which texts are theirs."""

    page: np.ndarray
    parent: np.ndarray
    depth: np.ndarray
    features: np.ndarray
    own: np.ndarray
    below: np.ndarray
    text_of: np.ndarray
    texts: list[str]


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def forest(pages: list[Page]) -> Forest:
    sizes = np.array([len(p.tag) for p in pages], np.int64)
    base = np.cumsum(sizes) - sizes
    page = np.repeat(np.arange(len(pages)), sizes)
    n = int(sizes.sum())
    own_parent = np.array([x for p in pages for x in p.parent], np.int64)
    parent = np.where(own_parent < 0, -1, own_parent + base[page])
    tag = np.array([TAGS.get(t, len(TAG_GROUPS)) for p in pages for t in p.tag], np.int64)
    names = np.array([TELLING.index(t) if t in TELLING else -1 for p in pages for t in p.tag], np.int64)
    tokens = np.array([x for p in pages for x in p.tokens], np.int64)
    texts = [t for p in pages for t in p.text]
    counts = np.array([len(p.text) for p in pages], np.int64)
    text_of = np.array([x for p in pages for x in p.text_of], np.int64) + np.repeat(base, counts)
    chars = np.fromiter(map(len, texts), np.int64, len(texts))
    linked = np.array([x for p in pages for x in p.linked], np.int64)
    words = np.fromiter((t.count(" ") + 1 for t in texts), np.int64, len(texts))
    stops = np.fromiter((t.count(".") + t.count(",") + t.count("!") + t.count("?") for t in texts), np.int64, len(texts))

    def per_node(values: np.ndarray) -> np.ndarray:
        return np.bincount(text_of, values, n) if len(values) else np.zeros(n)

    own, own_links, own_words, own_stops = map(per_node, (chars, linked, words, stops))
    depth = np.zeros(n, np.int64)
    above_tag, above_tokens = np.zeros(n, np.int64), np.zeros(n, np.int64)
    bit = np.where(names >= 0, 1 << np.maximum(names, 0), 0)
    # Parents stand before their children, so levels can be found one after the other.
    levels = [np.flatnonzero(parent < 0)]
    order = np.argsort(parent, kind="stable")
    first = np.searchsorted(parent[order], np.arange(n + 1))
    while True:
        last = levels[-1]
        size = first[last + 1] - first[last]
        if not size.any():
            break
        ends = np.cumsum(size)
        kids = order[np.repeat(first[last] - (ends - size), size) + np.arange(ends[-1])]
        depth[kids] = len(levels)
        up = parent[kids]
        above_tag[kids], above_tokens[kids] = above_tag[up] | bit[up], above_tokens[up] | tokens[up]
        levels.append(kids)
    below, below_links, tags = own.copy(), own_links.copy(), np.ones(n)
    for kids in reversed(levels[1:]):
        for total in (below, below_links, tags):
            total += np.bincount(parent[kids], total[kids], n)

    up = np.maximum(parent, 0)
    kids = np.bincount(parent[parent >= 0], minlength=n)
    siblings = np.where(parent >= 0, kids[up], 1)
    place = np.empty(n)
    place[order] = np.arange(n) - first[np.maximum(parent[order], 0)]
    place = np.where(parent >= 0, place, 0)
    _, which, alike = np.unique(up * 64 + tag, return_inverse=True, return_counts=True)
    of_siblings = np.bincount(parent[parent >= 0], np.log1p(below[parent >= 0]), n)
    # Every page has a root, so ``base`` points at it.
    total, running = below[base][page], np.cumsum(own) - own
    before = running - running[base][page]
    columns = [
        np.log1p(own), np.log1p(below), _ratio(own_links, own), _ratio(below_links, below), below / tags, tags, depth,
        _ratio(place, siblings), siblings, _ratio(alike[which], siblings), of_siblings[up] / np.maximum(siblings, 1),
        _ratio(below, np.where(parent >= 0, below[up], below)), _ratio(own, own_words), _ratio(own_stops, own_words), own_words,
        _ratio(before, total), _ratio(below, total), np.log1p(total),
    ]
    columns += [tag == g for g in range(len(TAG_GROUPS) + 1)]
    columns += [(above_tag >> i) & 1 for i in range(len(TELLING))]
    for mask in (tokens, above_tokens):
        columns += [(mask >> i) & 1 for i in range(len(TOKEN_GROUPS))]
    return Forest(page, parent, depth, np.column_stack(columns).astype(np.float32), own, below, text_of, texts)
