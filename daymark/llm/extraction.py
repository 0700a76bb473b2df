"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut at block-level markup into flat blocks. A block has its word count and link density, those of the
blocks before and after it, and what stands around it: whether an open element names main text (``article``, or a class like ``content``)
or something else (``nav``, a class like ``sidebar``). A decision tree, grown from the labelled blocks below by Gini impurity, says which
blocks are main text.

Scale: a page is handled alone, there is no shuffle; the tree is some nodes.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daymark.llm.common import map_arrow

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
#: Fixed names. Elements whose content is never text, those inside a line of text, and those without content.
SILENT = {"script", "style", "noscript", "template", "svg", "iframe", "object", "title", "textarea", "select", "canvas", "audio", "video", "math"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark",
          "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "label"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
LOOSE = {"p", "li", "dt", "dd", "tr", "td", "th", "option", "thead", "tbody", "tfoot"}
MAIN_TAGS = {"article", "main"}
OTHER_TAGS = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "fieldset", "head"}
MAIN_WORDS = {"article", "content", "post", "entry", "story", "main", "body", "text"}
OTHER_WORDS = {
    "ad", "ads", "advert", "advertisement", "adverts", "banner", "promo", "promotion", "sponsor", "sponsored", "sidebar", "aside", "widget", "menu",
    "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "masthead", "toolbar", "cookie", "cookies", "consent", "gdpr", "notice", "alert",
    "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "form", "search", "comment", "comments", "reply", "replies", "respond",
    "disqus", "discussion", "share", "sharing", "social", "related", "recommended", "more", "pagination", "pager", "tags", "copyright", "disclaimer", "skip",
}
#: Beginnings of compound names that count as the names above.
STEMS = {"advert", "sponsor", "sidebar", "cookie", "breadcrumb", "newsletter", "navbar", "footer"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu"}
NAMES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "named", "in_main", "in_other")

#: The labelled blocks: values of NAMES, then 1 for main text. Links are shares of the block's words; named: the page names its main text.
LABELLED = [
    # paragraphs and headings of articles, long and short, first and last
    (9, 0.0, 1, 1.0, 60, 0.0, 1, 1, 0, 1), (60, 0.0, 9, 0.0, 45, 0.1, 1, 1, 0, 1), (45, 0.1, 60, 0.0, 2, 0.0, 1, 1, 0, 1), (2, 0.0, 45, 0.1, 80, 0.0, 1, 1, 0, 1),
    (1, 0.0, 2, 0.0, 1, 0.0, 1, 1, 0, 1), (80, 0.05, 2, 0.0, 8, 0.2, 1, 1, 0, 1), (120, 0.0, 4, 0.0, 12, 0.0, 1, 1, 0, 1), (4, 1.0, 30, 0.0, 50, 0.0, 1, 1, 0, 1),
    (12, 0.5, 40, 0.0, 40, 0.0, 1, 1, 0, 1), (1, 0.0, 0, 0.0, 0, 0.0, 1, 1, 0, 1), (3, 0.0, 1, 1.0, 9, 0.2, 1, 1, 0, 1), (30, 0.0, 1, 1.0, 5, 0.0, 1, 1, 0, 1),
    (6, 1.0, 1, 0.0, 2, 0.0, 1, 1, 0, 1), (15, 0.0, 15, 0.0, 15, 0.0, 1, 1, 0, 1), (200, 0.02, 90, 0.0, 20, 0.0, 1, 1, 0, 1), (7, 0.0, 5, 0.0, 70, 0.0, 1, 1, 0, 1),
    # text inside menus, adverts, notices, sidebars, forms, comments and footers, in an article or not, long ones too
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 1, 0), (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 1, 0), (8, 0.0, 1, 1.0, 9, 0.0, 0, 0, 1, 0), (25, 0.0, 1, 1.0, 9, 0.0, 0, 0, 1, 0),
    (9, 0.2, 80, 0.0, 0, 0.0, 0, 0, 1, 0), (60, 0.0, 50, 0.0, 40, 0.0, 0, 0, 1, 0), (45, 0.0, 8, 0.0, 70, 0.0, 1, 1, 1, 0), (3, 0.0, 60, 0.0, 30, 0.0, 1, 1, 1, 0),
    (30, 0.1, 3, 0.0, 2, 1.0, 1, 1, 1, 0), (2, 1.0, 30, 0.1, 2, 1.0, 1, 1, 1, 0), (100, 0.0, 60, 0.0, 60, 0.0, 1, 1, 1, 0), (12, 0.0, 90, 0.0, 15, 0.0, 0, 0, 1, 0),
    (5, 0.0, 40, 0.0, 0, 0.0, 1, 1, 1, 0), (150, 0.1, 10, 0.0, 10, 0.0, 0, 0, 1, 0),
    # pages without any naming: long blocks with few links and short ones beside them are text
    (70, 0.0, 12, 0.0, 60, 0.0, 0, 0, 0, 1), (60, 0.05, 70, 0.0, 50, 0.0, 0, 0, 0, 1), (50, 0.0, 60, 0.05, 3, 1.0, 0, 0, 0, 1), (24, 0.0, 50, 0.0, 40, 0.0, 0, 0, 0, 1),
    (18, 0.1, 40, 0.0, 45, 0.0, 0, 0, 0, 1), (20, 0.0, 2, 1.0, 55, 0.0, 0, 0, 0, 1), (90, 0.1, 3, 1.0, 3, 1.0, 0, 0, 0, 1), (35, 0.2, 2, 0.5, 30, 0.0, 0, 0, 0, 1),
    (14, 0.0, 80, 0.0, 60, 0.0, 0, 0, 0, 1), (16, 0.0, 30, 0.0, 25, 0.0, 0, 0, 0, 1),
    (2, 1.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0), (3, 1.0, 2, 1.0, 70, 0.0, 0, 0, 0, 0), (5, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0), (4, 0.0, 50, 0.0, 2, 1.0, 0, 0, 0, 0),
    (8, 0.6, 6, 1.0, 7, 1.0, 0, 0, 0, 0), (20, 0.9, 15, 0.9, 18, 1.0, 0, 0, 0, 0), (6, 0.0, 0, 0.0, 2, 1.0, 0, 0, 0, 0), (40, 0.8, 30, 0.9, 30, 0.9, 0, 0, 0, 0),
    (9, 0.3, 50, 0.0, 0, 0.0, 0, 0, 0, 0), (3, 0.0, 4, 0.0, 3, 0.5, 0, 0, 0, 0), (7, 0.0, 3, 1.0, 4, 0.0, 0, 0, 0, 0), (25, 0.7, 4, 1.0, 60, 0.0, 0, 0, 0, 0),
    # what stands beside named main text belongs to the page, not to the text
    (60, 0.0, 50, 0.0, 40, 0.0, 1, 0, 0, 0), (25, 0.0, 1, 1.0, 9, 0.0, 1, 0, 0, 0), (3, 1.0, 2, 1.0, 70, 0.0, 1, 0, 0, 0), (12, 0.0, 90, 0.0, 15, 0.0, 1, 0, 0, 0),
    (90, 0.1, 3, 1.0, 3, 1.0, 1, 0, 0, 0), (5, 0.0, 40, 0.0, 0, 0.0, 1, 0, 0, 0), (18, 0.1, 40, 0.0, 45, 0.0, 1, 0, 0, 0), (1, 0.0, 0, 0.0, 30, 0.0, 1, 0, 0, 0),
    (8, 0.0, 1, 1.0, 9, 0.0, 1, 0, 1, 0), (60, 0.0, 50, 0.0, 40, 0.0, 1, 0, 1, 0), (2, 1.0, 2, 1.0, 2, 1.0, 1, 0, 1, 0), (9, 0.2, 80, 0.0, 0, 0.0, 1, 0, 1, 0),
]


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 6) -> tuple | int:
    """A tree of (feature, limit, tree up to the limit, tree above it); a leaf is the majority label."""
    if depth == 0 or len(set(labels.tolist())) < 2:
        return int(2 * labels.sum() >= len(labels))
    best = None
    # The last features, what stands around a block, are tried first and win ties.
    for feature in reversed(range(rows.shape[1])):
        values = np.unique(rows[:, feature])
        for limit in (values[1:] + values[:-1]) / 2:
            low = rows[:, feature] <= limit
            p, q = labels[low].mean(), labels[~low].mean()
            impurity = low.sum() * p * (1 - p) + (~low).sum() * q * (1 - q)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, feature, float(limit))
    if best is None:
        return int(2 * labels.sum() >= len(labels))
    _, feature, limit = best
    low = rows[:, feature] <= limit
    return feature, limit, grow(rows[low], labels[low], depth - 1), grow(rows[~low], labels[~low], depth - 1)


def trained(labelled=None) -> tuple | int:
    data = np.array(LABELLED if labelled is None else labelled, float)
    return grow(data[:, :-1], data[:, -1].astype(int))


def is_main(tree, row) -> bool:
    while isinstance(tree, tuple):
        feature, limit, low, high = tree
        tree = low if row[feature] <= limit else high
    return bool(tree)


def names_in(value: str) -> set[str]:
    """The words of a class or id, apart from what an element is said to have or lack (``has-sidebar``)."""
    value = re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()
    value = re.sub(r"\b(?:has|no|with|without)[-_][a-z]+", " ", value)
    words = set(re.split(r"[^a-z]+", value))
    return words | {stem for stem in STEMS for w in words if w.startswith(stem)}


def surroundings(tag: str, attributes: str, in_main: bool) -> tuple[int, bool]:
    """Whether an element names main text (2: an article, 1: a less certain name), and whether it names something else."""
    main, other = 2 if tag == "article" else int(tag in MAIN_TAGS), tag in OTHER_TAGS or tag == "header" and not in_main
    if attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name in ("class", "id"):
                words = names_in(value)
                if tag in ("html", "body"):
                    continue
                if tag in MAIN_TAGS:
                    other |= bool(words & {"comment", "comments", "reply", "replies"})
                    continue
                other |= bool(words & OTHER_WORDS) or not in_main and bool(words & {"header", "top"})
                main = max(main, 2 * ("article" in words), int(bool(words & MAIN_WORDS)))
            elif name == "role":
                other |= value.lower() in ROLES
                main = max(main, {"main": 1, "article": 2}.get(value.lower(), 0))
            elif name == "itemprop" and value == "articleBody":
                main = 2
            elif name == "style":
                other |= "display:none" in value.lower().replace(" ", "")
        if re.search(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true", attributes, re.I):
            other = True
    return main, other


def blocks(page: str) -> list[tuple[str, int, float, int, bool]]:
    """(text, words, link density, how main text is named, in something else) of each block that is not empty."""
    found: list[tuple[str, int, float, int, bool]] = []
    text: list[str] = []
    links: list[str] = []
    open_: list[tuple[str, int, bool]] = []
    in_link = main = 0
    other = False

    def close() -> None:
        nonlocal text, links
        joined = " ".join(entities.unescape("".join(text)).split())
        if joined:
            n = joined.count(" ") + 1
            linked = len(entities.unescape("".join(links)).split())
            found.append((joined, n, min(1.0, linked / n), main, other))
        text, links = [], []

    at, end = 0, len(page)
    while at < end:
        token = TOKEN.search(page, at)
        stop = token.start() if token else end
        if stop > at:
            text.append(page[at:stop])
            if in_link:
                links += [page[at:stop], " "]
        if token is None:
            break
        at = token.end()
        tag = (token[2] or token[5] or "").lower()
        if not tag:
            if page.startswith("<![CDATA[", token.start()):
                text.append(entities.escape(token[0][9:].removesuffix("]]>")))
            continue
        closing, attributes = token[1] or token[4], token[3] or token[6] or ""
        if tag in SILENT and not closing:
            if not attributes.endswith("/"):
                behind = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                at = behind.end() if behind else end
            text.append(" ")
            continue
        if tag == "a":
            in_link = 0 if closing else 1
            continue
        if tag in INLINE:
            continue
        close()
        if tag in VOID:
            continue
        if not closing:
            in_link = 0
        if tag in LOOSE:  # an open one of the same kind ends here
            top = len(open_)
            while top and open_[top - 1][0] in LOOSE:
                top -= 1
                if open_[top][0] == tag:
                    del open_[top:]
                    break
            if not closing and attributes:
                open_.append((tag, *surroundings(tag, attributes, main)))
        elif closing:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == tag:
                    del open_[i:]
                    break
        else:
            while open_ and open_[-1][0] == "p":
                open_.pop()
            if not attributes.endswith("/"):
                open_.append((tag, *surroundings(tag, attributes, main)))
        main, other = max((x[1] for x in open_), default=0), any(x[2] for x in open_)
    close()
    return found


def features(found: list) -> list[tuple]:
    """Values of ``NAMES`` for each block of a page. Main text is what bears the most certain name on the page."""
    none = ("", 0, 0.0, 0, False)
    top = max((b[3] for b in found if not b[4]), default=0)
    around = zip(found, [none, *found[:-1]], [*found[1:], none])
    return [(b[1], b[2], p[1], p[2], n[1], n[2], int(top > 0), int(0 < top <= b[3]), int(b[4])) for b, p, n in around]


def split_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, block, text, main) and ``NAMES`` of every block, with the tree's verdict."""
    tree = trained()

    def run(batches):
        for batch in batches:
            rows = []
            for page_id, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = blocks(page or "")
                rows += [(page_id, i, b[0], is_main(tree, x), *map(float, x)) for i, (b, x) in enumerate(zip(found, features(found)))]
            columns = list(zip(*rows)) if rows else [()] * (4 + len(NAMES))
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.bool_(), *[pa.float64()] * len(NAMES)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["page_id", "block", "text", "main", *NAMES])

    schema = "page_id long, block int, text string, main boolean, " + ", ".join(f"{n} double" for n in NAMES)
    return map_arrow(pages.select(F.col("page_id").cast("long"), "html"), run, schema)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row: the main blocks in page order, joined by a line break.

    Character references are decoded and white space inside a block is one space. A null, empty or textless page has
    an empty text. Pages cut off in the middle keep what is there.
    """
    tree = trained()

    def run(batches):
        for batch in batches:
            texts = []
            for page in batch.column(2).to_pylist():
                found = blocks(page or "")
                texts.append("\n".join(b[0] for b, x in zip(found, features(found)) if is_main(tree, x)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return map_arrow(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html"), run, "page_id long, url string, text string")
