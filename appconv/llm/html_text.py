"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into blocks at the tags that begin or end one; white space in a block becomes one space, character references
are decoded, scripts, styles and form fields are left out. A block is described by its number of words and link density,
those of the two blocks before and behind it, whether it is a heading, and what encloses it: an article or main part, page
furniture by tag, furniture by name. Names of class, id and role count as whole words only, and not where the element is
named or marked as main text as well. No single one of these decides: a tree is grown on the labelled table ``LABELLED``, in
which many pages have no names and some have misleading ones, when the operator is built, and sent to the tasks. Main blocks
are joined by a line break.

Defined cases: a null or empty page has an empty text, as has a page without main blocks; a page cut anywhere is read as far
as it goes, a tag without end is dropped. Pages are read one by one, so repeated rows get equal results; other columns are
ignored. An empty table gives no rows."""

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from appconv.llm.common import table

# Tags of HTML that begin a new block of text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
# What is between these and their end tags is no text.
HIDDEN_TAGS = frozenset(
    "audio button canvas iframe math noscript object script select style svg template textarea title video".split()
)
FURNITURE_TAGS = frozenset("aside dialog footer form header menu nav search".split())
MAIN_TAGS = frozenset("article main".split())
# A new one of these ends an open one.
_CLOSED_BY_NEXT = {"p", "li", "dd", "dt", "tr", "td", "th", "option"}

_FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disclaimer "
    "disqus footer gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup "
    "promo promoted recommended related replies reply search share sharing sidebar signup social sponsor sponsored subscribe tags "
    "teaser toolbar widget complementary contentinfo".split()
)
# Say nothing about an element; with a furniture word they do not turn it into something else.
_PLAIN_WORDS = frozenset(
    "area bar block body bottom box button buttons container global group inner item items layout left links list module outer "
    "page panel primary right row secondary section site small top wrap wrapper".split()
)
_MAIN_WORDS = frozenset("article content contents entry main post story text".split())
# A name of these with a furniture word among them names furniture (post-comments, main-menu).
_NAMING_WORDS = _FURNITURE_WORDS | _PLAIN_WORDS | _MAIN_WORDS

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")

FEATURES = (
    "words",
    "link_density",
    "words_before",
    "link_density_before",
    "words_behind",
    "link_density_behind",
    "words_two_before",
    "link_density_two_before",
    "words_two_behind",
    "link_density_two_behind",
    "in_main",
    "main_on_page",
    "in_furniture_tag",
    "in_furniture_name",
    "heading",
)


class Block(NamedTuple):
    text: str
    words: int
    link_density: float
    in_main: bool
    in_furniture_tag: bool
    in_furniture_name: bool
    heading: bool


class Kind(NamedTuple):
    """What an element says about the blocks in it."""

    main: int = 0
    tag: int = 0
    name: int = 0
    link: int = 0
    heading: int = 0


def _kind(tag: str, attributes: str) -> Kind:
    link, heading = int(tag == "a"), int(tag in _HEADINGS)
    if tag in ("html", "body"):
        return Kind()
    names = " ".join(x or y or z for x, y, z in _NAMES.findall(attributes)).lower() if "=" in attributes else ""
    parts = [_WORD.findall(name) for name in names.split()]
    main_name = any(any(w in _MAIN_WORDS for w in words) and not any(w in _FURNITURE_WORDS for w in words) for words in parts)
    furniture_name = any(any(w in _FURNITURE_WORDS for w in words) and all(w in _NAMING_WORDS for w in words) for words in parts)
    main = tag in MAIN_TAGS or main_name and not furniture_name
    return Kind(int(main), int(tag in FURNITURE_TAGS), int(furniture_name and not main_name and tag not in MAIN_TAGS), link, heading)


def blocks(page: str) -> list[Block]:
    """One pass; the elements that are open are a stack, of which each is pushed and popped once."""
    out: list[Block] = []
    open_: list[tuple[str, Kind]] = []
    opened: Counter[str] = Counter()
    # Open elements of each kind.
    state = [0] * len(Kind._fields)
    parts: list[str] = []
    linked: list[str] = []
    head = False

    def end_block() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text and not head:
            words = text.count(" ") + 1
            in_links = len(html.unescape("".join(linked)).split())
            main, tag, name, _, heading = (n > 0 for n in state)
            out.append(Block(text, words, min(1.0, in_links / words), main, tag, name, heading))
        parts.clear()
        linked.clear()

    def add(text: str) -> None:
        if text:
            parts.append(text)
            if state[3]:
                linked.append(text)

    def close(tag: str) -> None:
        """The innermost open element of that tag and all within it."""
        while True:
            name, kind = open_.pop()
            opened[name] -= 1
            for k, n in enumerate(kind):
                state[k] -= n
            if name == tag:
                return

    at = 0
    for mark in _MARKUP.finditer(page):
        if mark.start() < at:
            continue
        add(page[at : mark.start()])
        at = mark.end()
        tag = (mark[2] or mark[5] or "").lower()
        if not tag or not page[at - 1 : at] == ">":
            continue
        ends = bool(mark[1] or mark[4])
        if tag in BLOCK_TAGS:
            end_block()
        elif tag == "br":
            add(" ")
        if tag == "head":
            head = not ends
        if tag == "body":
            head = False
        if ends:
            if opened[tag]:
                close(tag)
            continue
        if tag in HIDDEN_TAGS:
            stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = stop.end() if stop else len(page)
            continue
        if tag in VOID_TAGS or (mark[3] or mark[6] or "").endswith("/"):
            continue
        if tag in _CLOSED_BY_NEXT and tag in (t for t, _ in open_[-3:]):
            close(tag)
        kind = _kind(tag, mark[3] or mark[6] or "")
        open_.append((tag, kind))
        opened[tag] += 1
        for k, n in enumerate(kind):
            state[k] += n
    add(page[at:])
    end_block()
    return out


_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def features(page: list[Block]) -> np.ndarray:
    """A row of ``FEATURES`` for each block; beyond either end of the page there are no words."""
    own = np.array([(b.words, b.link_density) for b in page], np.float64).reshape(-1, 2)
    around = np.zeros((own.shape[0] + 4, 2))
    around[2:-2] = own
    n = own.shape[0]
    place = np.array(
        [(b.in_main, any_main, b.in_furniture_tag, b.in_furniture_name, b.heading) for any_main in [any(b.in_main for b in page)] for b in page],
        np.float64,
    ).reshape(-1, 5)
    return np.hstack([own, around[1 : n + 1], around[3 : n + 3], around[:n], around[4:], place])


# The labelled table: pages in short. {+n} stands for a block of n words of main text, {-n} for one of other text; "links" for
# a menu. A page behind "bare" is there a second time without its names.
_LINKS = "<ul><li><a>{-1}</a></li><li><a>{-2}</a></li><li><a>{-1}</a></li><li><a>{-1}</a></li></ul>"
LABELLED = [
    "bare<nav>links</nav><div class='ad'>{-12}</div><article><h1>{+9}</h1><p>{+60}</p><p>{+1}</p><p>{+35}</p></article><footer>{-8}</footer>",
    "bare<nav>links</nav><div class='ad'>{-6}</div><article><h1>{+7}</h1><p>{+7}</p><p>{+40}</p><p>{+3}</p><p>{+28}</p></article><footer>{-9}</footer>",
    "bare<div class='ad'>{-40}</div><article><h1>{+5}</h1><p>{+3}</p><p>{+2}</p></article><footer>{-25}</footer>",
    "bare<header><p>{-4}</p><p>{-15}</p></header><nav><a>{-6}</a></nav><main><h1>{+6}</h1><p>{+80}</p><h2>{+3}</h2><p>{+45}</p><ul>"
    "<li>{+7}</li><li>{+12}</li></ul><p>{+20}</p></main><aside><h3>{-3}</h3><p>{-30}</p><a>{-5}</a></aside><footer>{-12}</footer>",
    "<div id='header'>{-5}</div><div class='menu'><a>{-4}</a></div><div id='content'><h1>{+8}</h1><p>{+50}</p><blockquote>{+22}"
    "</blockquote><p>{+9}</p></div><div class='sidebar'><p>{-25}</p><p>{-6}</p></div><div id='footer'>{-14}</div>",
    "<div class='cookie-notice'>{-28}</div><article><h1>{+10}</h1><p>{+70}</p><div class='advert'>{-18}</div><p>{+40}</p><p>{+4}</p>"
    "</article><section id='comments'><h2>{-2}</h2><p>{-30}</p><p>{-55}</p></section><footer><p>{-20}</p></footer>",
    "<article><header><p>{-6}</p></header><h1>{+7}</h1><p>{+65}</p><pre>{+30}</pre><table><tr><td>{+2}</td><td>{+3}</td></tr>"
    "</table></article><div class='related'><a>{-9}</a><a>{-7}</a></div><form><label>{-3}</label><p>{-16}</p></form>",
    "<div class='banner'>{-9}</div><main><article><p>{+15}</p><p>{+1}</p><p><a>{+4}</a></p><p>{+18}</p></article></main>"
    "<div role='navigation'><a>{-12}</a></div><div class='comment'>{-45}</div><div class='newsletter'>{-22}</div>",
    "<article><p>{+12}</p><ul><li><a>{+3}</a></li><li>{+5}</li></ul><p>{+28}</p><div class='share'><a>{-3}</a></div></article>"
    "<div class='comments'><article><p>{-38}</p></article><article><p>{-11}</p></article></div>",
    "<div class='post'><h2>{+5}</h2><p>{+36}</p><p>{+6}</p></div><div class='promo'>{-35}</div><div class='widget'><p>{-8}</p></div>",
    # What comes straight before and behind long main text.
    "bare<nav>links</nav><div class='ad'>{-11}</div><article><h1>{+8}</h1><p>{+70}</p><p>{+66}</p></article><footer>{-10}</footer>",
    "bare<nav>links</nav><div class='banner'>{-7}</div><article><p>{+90}</p><p>{+51}</p><p>{+120}</p></article><footer>{-14}</footer>",
    "bare<div>{-13}</div><main><p>{+64}</p><p>{+5}</p><p>{+88}</p></main><div class='promo'>{-6}</div><div>{-19}</div><footer>{-9}</footer>",
    "<header><h1>{-3}</h1></header><div><p>{+58}</p><p>{+75}</p></div><footer><p>{-12}</p><p>{-5}</p></footer>",
    "<header>{-6}</header><p>{+47}</p><h2>{+4}</h2><p>{+95}</p><aside>{-24}</aside><p>{+61}</p><footer>{-21}</footer>",
    # Names that say the wrong thing, and main text in small pieces.
    "links<article class='post notice'><h1>{+5}</h1><p>{+33}</p><p>{+4}</p></article><footer>{-7}</footer>",
    "links<main><h1>{+4}</h1><div class='header-image-caption'>{+11}</div><p>{+52}</p><p>{+2}</p></main><footer>{-16}</footer>",
    "links<article><ul><li>{+2}</li><li>{+1}</li><li>{+3}</li></ul><p><a>{+2}</a></p><p>{+1}</p></article><div>{-10}</div><footer>{-5}</footer>",
    "links<main><p>{+2}</p><p>{+3}</p><p><a>{+5}</a></p><h2>{+2}</h2><p>{+1}</p></main><div>{-14}</div><div>links</div>",
    # Nothing but main text.
    "<p>{+45}</p><p>{+5}</p><p>{+40}</p>",
    "<h1>{+6}</h1><p>{+38}</p><p>{+8}</p><p>{+33}</p><p>{+3}</p><p>{+52}</p>",
    "<p>{+27}</p><ul><li>{+4}</li><li>{+9}</li></ul><p>{+62}</p>",
    "<div>{+35}</div><div>{+7}</div>",
    # No main element and no names: only words and links around a block tell.
    "<p><a>{-3}</a></p><p><a>{-2}</a></p><p>{+55}</p><p>{+48}</p><p>{+30}</p><p>{+26}</p><p><a>{-4}</a></p>",
    "<p><a>{-1}</a></p><h1>{+6}</h1><p>{+75}</p><p>{+33}</p><h2>{+4}</h2><p>{+41}</p><p>{-3}</p><p><a>{-5}</a></p>",
    "<div><a>{-2}</a></div><div>{-2}</div><div>{+90}</div><div>{+25}</div><div>{-4}</div><div><a>{-8}</a></div>",
    "<div>links</div><div>{-9}</div><div><h1>{+8}</h1><p>{+44}</p><p>{+6}</p><p>{+38}</p><p>{+12}</p><p>{+51}</p></div><div>links</div><div>{-6}</div>",
    "<div>links</div><div>{-5}</div><h2>{+5}</h2><p>{+62}</p><p>{+9}</p><p>{+29}</p><h2>{+3}</h2><p>{+47}</p><p>{+19}</p><div>{-3}</div><div>links</div>",
    "<div>links</div><p>{+31}</p><p>{+5}</p><p>{+46}</p><ul><li>{+8}</li><li>{+6}</li></ul><p>{+58}</p><div>links</div><p>{-7}</p>",
    "<p>{-3}</p><div>links</div><h1>{+7}</h1><p>{+24}</p><p>{+68}</p><p>{+17}</p><p>{+39}</p><p>{-2}</p><div>links</div><p>{-8}</p>",
]
_PLACE = re.compile(r"\{([+-])(\d+)\}")


def labelled_pages() -> list[str]:
    pages = [p.removeprefix("bare").replace("links", _LINKS) for p in LABELLED]
    return pages + [_NAMES.sub("", q) for p, q in zip(LABELLED, pages, strict=True) if p.startswith("bare")]


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of ``LABELLED``, of each page in several lengths of main and of other text, so that the
    tree does not learn the lengths of single blocks."""
    rows, labels = [], []
    for page in labelled_pages():
        for scale in _SCALES:
            filled = _PLACE.sub(lambda m: " ".join(["main" if m[1] == "+" else "other"] * _scaled(m, scale)), page)  # noqa: B023
            found = blocks(filled)
            rows.append(features(found))
            labels += [b.text.startswith("main") for b in found]
    return np.vstack(rows), np.array(labels)


# How many times the words of main and of other text.
_SCALES = ((1.0, 1.0), (2.0, 1.0), (0.6, 1.0), (1.0, 0.6), (1.5, 1.8), (3.0, 1.4))


def _scaled(place: re.Match, scale: tuple[float, float]) -> int:
    return max(1, round(int(place[2]) * scale[place[1] == "-"]))


class Node(NamedTuple):
    """Rows whose ``feature`` is at most ``limit`` go ``low``; a leaf has no branches."""

    main: bool
    feature: int = 0
    limit: float = 0.0
    low: "Node | None" = None
    high: "Node | None" = None


def _impurity(labels: np.ndarray) -> float:
    share = labels.mean() if labels.size else 0.0
    return labels.size * 2 * share * (1 - share)


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 8, least: int = 6) -> Node:
    """A tree by Gini impurity."""
    leaf = Node(bool(labels.mean() >= 0.5))
    best = (_impurity(labels) - 1e-9, 0, 0.0)
    for feature in range(rows.shape[1]) if depth else ():
        values = np.unique(rows[:, feature])
        for limit in (values[1:] + values[:-1]) / 2:
            low = rows[:, feature] <= limit
            if least <= low.sum() <= low.size - least:
                best = min(best, (_impurity(labels[low]) + _impurity(labels[~low]), feature, float(limit)))
    if best[0] >= _impurity(labels) - 1e-9:
        return leaf
    low = rows[:, best[1]] <= best[2]
    branches = (grow(rows[side], labels[side], depth - 1, least) for side in (low, ~low))
    return Node(leaf.main, best[1], best[2], *branches)


def classify(node: Node, rows: np.ndarray) -> np.ndarray:
    if node.low is None:
        return np.full(rows.shape[0], node.main)
    out = np.zeros(rows.shape[0], bool)
    low = rows[:, node.feature] <= node.limit
    out[low], out[~low] = classify(node.low, rows[low]), classify(node.high, rows[~low])
    return out


def main_text(tree: Node, page: str | None) -> str:
    found = blocks(page) if page else []
    return "\n".join(b.text for b, m in zip(found, classify(tree, features(found)), strict=True) if m) if found else ""


def extractor() -> Column:
    tree = grow(*labelled_table())

    def run(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            yield pd.Series([main_text(tree, page) for page in batch.tolist()], dtype=object)

    return F.pandas_udf(run, "string")(F.col("html"))


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text."""
    return pages.select("page_id", "url", extractor().alias("text"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
