"""The main text of web pages: boosted trees over block elements, decoded down the tree.

Every block element has features of its own text, its subtree (length, density, links), its depth, siblings, place in the page,
and the words in its and its ancestors' class, id and role attributes. Trees trained here give the log-odds that an element
belongs to the article. Decoding chooses for all elements of a page at once: an element may be kept only inside kept ones, and
the choice with the greatest sum of log-odds, weighted by text, is taken bottom-up. So a menu inside an article can go, and
nothing inside a sidebar can stay.

The trees learn from pages made by ``made_page`` (articles with all kinds of clutter, in semantic elements, in ``div`` with telling
classes, or with none) and from about ``SAMPLE`` given pages, chosen by hash, in which ``article`` or ``main`` marks the text; half of the latter
have these names hidden. Only this bounded sample reaches the driver, pages longer than ``LONGEST`` characters not at all.
Applying the model is a map over pages.

Text of a block: character references decoded, runs of white space one blank, trimmed; ``br`` counts as white space. Blocks
are joined in page order by a blank. Null, empty and textless pages give an empty text. Repeated rows are extracted each. Only
``page_id``, ``url`` and ``html`` are read. An empty table gives an empty result (and a model of made pages only). A task holds a
page and its elements at a time, and the features of a slice of pages.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rewardloom.llm import boosting, dom
from rewardloom.llm import words as W

SAMPLE = 300
LONGEST = 100_000
MADE = 1000
SLICE = 1 << 20
#: Elements that never hold article text, by rule.
NEVER = frozenset(("form", "button", "select", "option", "optgroup", "label", "legend", "nav", "footer"))


# --- training pages ----------------------------------------------------------------------------------------------------


def _sentences(rng: random.Random, n: int, words: list[str]) -> str:
    out = []
    for _ in range(n):
        line = rng.choices(words, k=rng.randint(3, 18))
        out.append(" ".join(line).capitalize() + rng.choice([".", ".", ".", "!", "?", ""]))
    return " ".join(out)


def _links(rng: random.Random, words: list[str], tag: str) -> str:
    items = [f'<li><a href="/{i}">{" ".join(rng.choices(words, k=rng.randint(1, 4)))}</a></li>' for i in range(rng.randint(2, 12))]
    return f"<{tag}>{''.join(items)}</{tag}>"


def _named(rng: random.Random, tags: list[str], names: list[str], inside: str) -> str:
    """``inside`` in a semantic element, or in a ``div`` with a telling class or id; seldom with neither."""
    kind = rng.random()
    tag = rng.choice(tags) if kind < 0.5 else rng.choice(["div", "div", "section"])
    attribute = f' {rng.choice(["class", "id"])}="{rng.choice(names)}"' if (0.35 < kind < 0.93 or tag == "section") else ""
    return f"<{tag}{attribute}>{inside}</{tag}>"


def _clutter(rng: random.Random, words: list[str], kind: str) -> str:
    """A piece of page that is not the article."""
    some = lambda lo, hi: _sentences(rng, rng.randint(lo, hi), words)
    if kind == "nav":
        return _named(rng, ["nav"], ["menu", "site-nav", "navbar", "breadcrumbs", "pagination"], _links(rng, words, rng.choice(["ul", "ol"])))
    if kind == "header":
        return _named(rng, ["header"], ["header", "masthead", "page-top"], f"<h2>{some(1, 1)}</h2>" + rng.choice(["", f"<p>{some(1, 2)}</p>", _links(rng, words, "ul")]))
    if kind == "ad":
        inside = rng.choice([some(1, 3), f"<p>{some(1, 3)}</p>", f'<a href="/x">{some(1, 1)}</a>'])
        return f'<{(t := rng.choice(["div", "div", "aside", "section"]))} {rng.choice(["class", "id"])}="{rng.choice(["ad", "ads", "advert", "ad-slot", "banner", "sponsored", "promo-box"])}">{inside}</{t}>'
    if kind == "notice":
        button = rng.choice(["", "<button>OK</button>"])
        return f'<{(t := rng.choice(["div", "div", "aside", "section"]))} {rng.choice(["class", "id"])}="{rng.choice(["cookie-notice", "consent", "newsletter", "notice", "popup", "subscribe-box", "paywall"])}"><p>{some(1, 3)}</p>{button}</{t}>'
    if kind == "sidebar":
        inside = "".join(f"<h3>{some(1, 1)}</h3>" + rng.choice([_links(rng, words, "ul"), f"<p>{some(1, 3)}</p>"]) for _ in range(rng.randint(1, 3)))
        return _named(rng, ["aside"], ["sidebar", "related", "widget", "side-rail", "recommended", "trending"], inside)
    if kind == "comments":
        notes = [f"<p>{some(1, 4)}</p>" for _ in range(rng.randint(1, 6))]
        form = rng.choice(["ul", "ol", "div"])
        items = [f"<li>{x}</li>" if form != "div" else f'<div class="{rng.choice(["comment", "reply", "c"])}">{x}</div>' for x in notes]
        inside = rng.choice(["", f"<h3>{some(1, 1)}</h3>"]) + f"<{form}>{''.join(items)}</{form}>"
        return f'<{(t := rng.choice(["section", "div", "aside"]))} {rng.choice(["class", "id"])}="{rng.choice(["comments", "comment-list", "replies", "discussion", "respond", "reader-comments"])}">{inside}</{t}>'
    if kind == "form":
        return f"<form><label>{some(1, 1)}</label><input><button>{rng.choice(words)}</button>{rng.choice(['', '<p>' + some(1, 2) + '</p>'])}</form>"
    if kind == "share":
        return f'<div class="{rng.choice(["share", "social", "share-bar", "toolbar", "follow"])}">{_links(rng, words, "ul")}</div>'
    inside = rng.choice([some(1, 2), f"<p>&copy; {some(1, 2)}</p>", f"<p>{some(1, 1)}</p>" + _links(rng, words, "ul")])
    return _named(rng, ["footer"], ["footer", "site-footer", "copyright", "legal"], inside)


def made_page(rng: random.Random, words: list[str]) -> tuple[str, str]:
    """A page, and the text of its article."""
    blocks: list[str] = [f"<h1>{_sentences(rng, 1, words)}</h1>"] if rng.random() < 0.85 else []
    for _ in range(rng.choice([1, 2, 3, 6, 10, 25])):
        kind, line = rng.random(), _sentences(rng, rng.randint(1, 8), words)
        if kind < 0.72:
            blocks.append(rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}</b></p>", '<p><a href="/y">{}</a></p>' if len(line) < 50 else "<p>{}</p>"]).format(line))
        elif kind < 0.8:
            blocks.append(f"<{(h := rng.choice(['h2', 'h3']))}>{_sentences(rng, 1, words)}</{h}>")
        elif kind < 0.87:
            items = "".join(f"<li>{_sentences(rng, 1, words)}</li>" for _ in range(rng.randint(2, 5)))
            blocks.append(f"<{(t := rng.choice(['ul', 'ol']))}>{items}</{t}>")
        elif kind < 0.92:
            blocks.append(f"<blockquote>{rng.choice(['<p>{}</p>', '{}']).format(line)}</blockquote>")
        elif kind < 0.96:
            blocks.append(f"<figure><img><figcaption>{_sentences(rng, 1, words)}</figcaption></figure>")
        else:
            blocks.append(f"<table><tr><td>{_sentences(rng, 1, words)}</td><td>{rng.choice(words)}</td></tr></table>")
    text = " ".join(" ".join(x.split()) for b in blocks for x in re.split(r"<[^>]*>", b) if x.strip())
    parts = list(blocks)
    for _ in range(rng.choice([0, 0, 1, 2])):
        kind = rng.choice(["ad", "ad", "notice", "form", "share", "sidebar", "nav"])
        parts.insert(rng.randint(1, len(parts)), _clutter(rng, words, kind))
    if rng.random() < 0.25:
        parts.append(_clutter(rng, words, "comments"))
    inside = "".join(parts)
    kind = rng.random()
    if kind < 0.45:
        inside = f"<article>{inside}</article>"
    elif kind < 0.55:
        inside = f"<main>{inside}</main>"
    elif kind < 0.9:
        inside = f'<div {rng.choice(["class", "id"])}="{rng.choice(["content", "post", "article-body", "entry-content", "story", "main-text", "post-body"])}">{inside}</div>'
    else:
        inside = f"<div>{inside}</div>"
    before = [_clutter(rng, words, k) for k in rng.sample(["header", "nav", "nav", "ad", "notice", "form"], rng.randint(0, 4))]
    after = [_clutter(rng, words, k) for k in rng.sample(["sidebar", "comments", "ad", "share", "notice", "nav", "footer", "footer"], rng.randint(0, 5))]
    body = "".join(before) + inside + "".join(after)
    for _ in range(rng.choice([0, 0, 1, 2])):
        body = f'<div{rng.choice(["", "", " class=wrapper", " id=page"])}>{body}</div>'
    return f"<html><head><title>{_sentences(rng, 1, words)}</title></head><body>{body}</body></html>", text


def hidden(html: str, rng: random.Random) -> str:
    """The page with its semantic elements under other names."""
    for tag in ("article", "main", "nav", "footer", "aside", "header"):
        name = "content" if tag in ("article", "main") else tag
        shown = rng.choice([f' class="{name}"', f' id="{name}-1"', "" if tag in ("article", "main") else f' class="x-{name}"'])
        html = re.sub(rf"<{tag}\b", f"<div{shown}", html)
        html = re.sub(rf"</{tag}\b", "</div", html)
    return html


def _article_of(page: dom.Page) -> np.ndarray:
    """Which elements are the article's where the page says so: inside ``article`` or ``main`` and no clutter by name."""
    inside, out = np.zeros(len(page.tag), bool), np.zeros(len(page.tag), bool)
    clutter = sum(1 << i for i in range(1, len(dom.TOKEN_GROUPS)))
    for i, (tag, up) in enumerate(zip(page.tag, page.parent, strict=True)):
        inside[i] = tag in ("article", "main") or (up >= 0 and inside[up])
        out[i] = (
            tag in NEVER or tag == "aside" or (page.tokens[i] & clutter and not page.tokens[i] & 1)
            or (tag == "header" and not (up >= 0 and inside[up])) or (up >= 0 and out[up])
        )
    return inside & ~out


def _labelled(pages: list[dom.Page], own_label: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and weights of elements: an element is the article's if most of its text is."""
    f = dom.forest(pages)
    good_own = f.own * np.concatenate(own_label)
    good = good_own.copy()
    for depth in range(int(f.depth.max()), 0, -1):
        at = np.flatnonzero(f.depth == depth)
        good += np.bincount(f.parent[at], good[at], len(good))
    used = (f.below > 0) & (f.parent >= 0)
    return f.features[used], (good[used] * 2 >= f.below[used]).astype(float), 1 + np.log1p(f.own[used])


def train(htmls: list[str], made: int = MADE, seed: int = 5) -> boosting.Model:
    rng = random.Random(seed)
    known: dict[str, int] = {}
    syllables = "an be co da en fi go ha in ja ko la me no or pe qua ri so ta un ve wi xe ya zu".split()
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(900)]
    pages, labels = [], []
    for _ in range(made):
        html, text = made_page(rng, words)
        page = dom.parse(html, known)
        # Of the page's texts those are the article's that follow each other as in its text.
        mark, at = np.zeros(len(page.tag), bool), 0
        for of, line in zip(page.text_of, page.text, strict=True):
            if text.startswith(line, at):
                mark[of], at = True, at + len(line) + 1
        pages.append(page)
        labels.append(mark)
    for i, html in enumerate(htmls):
        page = dom.parse(html, known)
        mark = _article_of(page)
        if mark.any():
            pages.append(dom.parse(hidden(html, rng), known) if i % 2 else page)
            if len(pages[-1].tag) == len(mark):
                labels.append(mark)
            else:
                pages.pop()
    x, y, weight = _labelled(pages, labels)
    return boosting.fit(x, y, weight)


def fit(pages: DataFrame, sample: int = SAMPLE) -> boosting.Model:
    # A share by hash and no first rows: those would be as many from every task of the scan.
    one_in = max(1, pages.count() // sample)
    some = pages.where(F.pmod(F.xxhash64("page_id", "html"), F.lit(one_in)) == 0).select("html")
    some = some.where((F.length("html") <= LONGEST) & F.lower("html").rlike("<(article|main)\\b")).distinct()
    return train(sorted(r.html for r in some.collect()))


# --- decoding ----------------------------------------------------------------------------------------------------------


def decoded(f: dom.Forest, odds: np.ndarray, tags: list[str]) -> np.ndarray:
    """Which elements are kept: those of the best choice in which every kept element's parent is kept."""
    never = np.array([t in NEVER for t in tags], bool)
    weight = np.log1p(f.own) + 0.25 * np.log1p(f.below)
    score = np.where(f.parent < 0, 0.0, weight * odds)
    score[never] = -np.inf
    levels = [np.flatnonzero(f.depth == d) for d in range(int(f.depth.max()) + 1)] if len(f.depth) else []
    for at in reversed(levels[1:]):
        score += np.bincount(f.parent[at], np.maximum(score[at], 0), len(score))
    kept = np.zeros(len(score), bool)
    for d, at in enumerate(levels):
        kept[at] = (score[at] > 0) & (kept[f.parent[at]] if d else True)
    return kept


def texts_of(model: boosting.Model, htmls: list[str], known: dict[str, int]) -> list[str]:
    pages = [dom.parse(h, known) for h in htmls]
    f = dom.forest(pages)
    odds = boosting.predict(model, f.features)
    kept = decoded(f, odds, [t for p in pages for t in p.tag])
    # Text that stands directly in a kept element must be the article's by itself; the root's only if nothing else is kept.
    shown = (kept & (odds > 0))[f.text_of] if len(f.text_of) else np.zeros(0, bool)
    out: list[list[str]] = [[] for _ in htmls]
    for i in np.flatnonzero(shown):
        out[f.page[f.text_of[i]]].append(f.texts[i])
    return [" ".join(x) for x in out]


def extracted(pages: DataFrame, model: boosting.Model) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars``."""
    parts = tuple(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, known = boosting.Model(*parts), {}
        for batch in W.slices(batches, "html", SLICE):
            found = texts_of(trees, [h or "" for h in batch.column("html").to_pylist()], known)
            columns = [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extracted(pages, fit(pages))
