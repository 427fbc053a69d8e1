"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  Blocks inside elements that hold no
article text by tag, role or their whole name are out.  An element whose name only
contains such a word is out if it holds less than half of the page's text: wrappers
have names of all kinds.  The first pass decides blocks by the density of stop words,
length and link density; the second gives short and undecided blocks the label of
their nearest decided neighbours, those of an article the label of that article.
Scripts and languages without listed stop words are judged by length and link
density alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

#: Tags that begin and end a block (fixed values).
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
#: Tags without content (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags whose content is not markup (fixed values).
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
#: Elements without article text (fixed values).
OUTSIDE = frozenset("head nav footer aside form button select option optgroup fieldset dialog menu svg math object canvas audio video label".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words in class names and ids of such elements (fixed values).
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored sponsors promo promotion promoted banner "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay toast sidebar sidebars widget widgets nav navbar "
    "navigation menu menus breadcrumb breadcrumbs footer masthead comment comments commentlist reply replies respond disqus share sharing "
    "social related recommended recommendations newsletter subscribe subscription signup signin login search pagination pager toolbar".split()
)
#: Whole class names and ids of such elements, which mean the same inside an article (fixed values).
WHOLE_NAMES = frozenset(
    "ad ads ad-slot ad-container advert adverts advertisement advertisements adsbygoogle sponsored sponsored-content promo cookie-notice cookie-banner "
    "cookie-consent comments comment comment-list commentlist comments-area comments-section user-comments reader-comments disqus_thread sidebar breadcrumb "
    "breadcrumbs share-buttons social-share sharing-buttons related-posts related-articles newsletter-signup navbar site-header site-footer".split()
)
MODIFIERS = frozenset("has with no without is not".split())  # of names that say what an element contains or lacks
ARTICLE = frozenset({"article", "main"})
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Frequent words of some languages (fixed values).
STOP_WORDS = frozenset(
    "the of and to in a is that it for was on are as with be by this at from or an which you he his they have not but had were can all "
    "der die das und in zu den von mit ist im für nicht ein eine sich des dem auf als auch es an werden aus er hat dass sie nach wird bei "
    "de la le les et des en un une du que est pour qui dans par plus pas au sur ne se ce il sont avec son elle ou "
    "el los las y que del se por con para una su al lo como más o pero sus le ha me sin sobre este ya "
    "di che il per non si da sono con una e dei nel alla della o os do da em um uma não com para het een van ik te dat niet zijn op".split()
)
SHORT, LONG = 70, 200  # characters
LINKS = 0.4  # link density from which a block is out
FEW, MANY = 0.1, 0.25  # densities of stop words

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORDS = re.compile(r"[^\W\d_]+")
LATIN = re.compile(r"[A-Za-z\u00aa-\u024f\u1e00-\u1eff]+")
DENSE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")  # scripts without spaces
GOOD, BAD, UNDECIDED = 1, 0, -1


IN, NAMED_SO, OUT = 0, 1, 2


class Block(NamedTuple):
    text: str
    linked: int  # characters in links
    outside: bool
    inside: bool  # in an article or main element
    article: int  # number of the innermost article element, -1 in none
    named: int  # number of the outermost element that a part of its name puts outside, -1 in none
    tag: str


class Open(NamedTuple):
    tag: str
    outside: bool
    inside: bool
    article: int
    named: int


ROOT = Open("", False, False, -1, -1)


def _place(tag: str, attributes: str, inside: bool) -> int:
    """OUT for elements that hold no article text, NAMED_SO if only a part of the name says so."""
    if tag in OUTSIDE or tag == "header" and not inside:
        return OUT
    if not attributes:
        return IN
    place = IN
    for name, value in NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return OUT
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return OUT
        if tag in ("html", "body") or tag in ARTICLE and name != "class":
            continue
        if name == "role" and value in ROLES:
            return OUT
        if name in ("class", "id"):
            names = value.split()
            if not WHOLE_NAMES.isdisjoint(names) and not (inside and tag in HEADINGS):
                return OUT
            if not inside and tag not in ARTICLE:
                for parts in (re.split(r"[^a-z0-9]+", x) for x in names):
                    if MODIFIERS.isdisjoint(parts) and ("header" in parts or not NAMES.isdisjoint(parts)):
                        place = NAMED_SO
    return place


def blocks(html: str) -> list[Block]:
    """The blocks of a page in order."""
    out: list[Block] = []
    stack: list[Open] = []
    is_open: Counter[str] = Counter()
    pieces: list[str] = []
    linked, link_depth, at, articles, named = 0, 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                tag, *place = stack[-1] if stack else ROOT
                out.append(Block(text, linked, *place, tag))
            pieces.clear()
        linked = 0

    def pop() -> str:
        tag = stack.pop().tag
        is_open[tag] -= 1
        return tag

    def text_until(end: int) -> None:
        nonlocal linked
        if end > at:
            piece = html[at:end]
            pieces.append(piece)
            if link_depth:
                linked += len(piece.strip())

    while found := TOKEN.search(html, at):
        text_until(found.start())
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        ending, attributes = found[1] or found[4], found[3] or found[6] or ""
        if ending:
            if tag == "a":
                link_depth = max(0, link_depth - 1)
            elif is_open[tag]:
                flush()
                while pop() != tag:
                    pass
            elif tag in BLOCK:
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            if tag in BLOCK:
                flush()
            continue
        if tag == "br":
            pieces.append(" ")
        if tag == "a":
            link_depth = 1
        above = stack[-1] if stack else ROOT
        place = _place(tag, attributes, above.inside)
        if tag in BLOCK or place != IN and not above.outside and tag not in VOID:
            flush()
            if tag in BLOCK:
                link_depth = 0 if tag != "li" else link_depth
                if above.tag == "p" and (tag == "p" or not above.outside):
                    pop()  # a block ends a paragraph
                above = stack[-1] if stack else ROOT
                if above.tag == tag and tag in ("li", "dt", "dd", "option", "td", "th", "tr"):
                    pop()
                above = stack[-1] if stack else ROOT
                place = _place(tag, attributes, above.inside)
            if tag not in VOID and not attributes.rstrip().endswith("/"):
                articles += tag == "article"
                named += place == NAMED_SO and above.named < 0
                stack.append(Open(
                    tag, above.outside or place == OUT, above.inside or tag in ARTICLE, articles if tag == "article" else above.article,
                    named if place == NAMED_SO and above.named < 0 else above.named,
                ))
                is_open[tag] += 1
    text_until(len(html))
    flush()
    return out


def first_pass(block: Block) -> int:
    """Good, bad or undecided by the block's own features."""
    text = block.text
    if block.linked > LINKS * len(text):
        return UNDECIDED if block.inside else BAD
    if block.tag in HEADINGS or len(text) < SHORT:
        return UNDECIDED if not block.linked or block.inside else BAD
    found = WORDS.findall(text.lower())
    density = sum(w in STOP_WORDS for w in found) / max(1, len(found))
    if density >= MANY or block.inside and density >= FEW:
        return GOOD
    if density >= FEW or block.inside:
        return UNDECIDED
    return BAD if len(text) < LONG or density < FEW / 2 else UNDECIDED


def in_place(found: list[Block]) -> list[Block]:
    """The blocks that are not outside, nor in a small element that its name puts outside."""
    found = [b for b in found if not b.outside]
    sizes: Counter[int] = Counter()
    for b in found:
        if b.linked <= LINKS * len(b.text):
            sizes[b.named] += _length(b.text)
    whole = sum(sizes.values())
    return [b for b in found if b.named < 0 or 2 * sizes[b.named] > whole]


def _length(text: str) -> int:
    """Characters, where one of a script without spaces counts as three."""
    return len(text) + 2 * len(DENSE.findall(text))


def _other_script(text: str) -> bool:
    """Whether most letters are of a script that the stop words are not written in."""
    words = WORDS.findall(text)
    return 2 * sum(len(LATIN.sub("", w)) for w in words) > sum(map(len, words))


def unlisted(found: list[Block], labels: list[int]) -> list[int]:
    """``labels``, with long blocks that stop words can't judge as good.

    These are blocks of another script, and all blocks if those that are good by their stop words hold
    less than half of the page's long text.  Where an article element holds the text, it decides.
    """
    if any(b.inside for b in found):
        return labels
    long = [i for i, b in enumerate(found) if b.tag not in HEADINGS and _length(b.text) >= SHORT and b.linked <= LINKS * len(b.text)]
    size = lambda which: sum(_length(found[i].text) for i in which)
    no_language = 2 * size(i for i in long if labels[i] == GOOD) < size(long)
    out = list(labels)
    for i in long:
        if labels[i] != GOOD and (no_language or _other_script(found[i].text)):
            out[i] = GOOD
    return out


def of_articles(found: list[Block], labels: list[int]) -> list[int]:
    """Labels of the undecided blocks of articles: good in articles with a good block.

    If no article has one, as in languages without listed stop words, good in those that are at least
    a quarter of the largest.
    """
    good = {b.article for b, label in zip(found, labels, strict=True) if label == GOOD and b.article >= 0}
    if not good:
        sizes: Counter[int] = Counter()
        for b in found:
            if b.article >= 0:
                sizes[b.article] += _length(b.text)
        good = {a for a, n in sizes.items() if 4 * n >= max(sizes.values())}
    return [label if label != UNDECIDED or b.article < 0 else GOOD if b.article in good else BAD for b, label in zip(found, labels, strict=True)]


def second_pass(labels: list[int], sizes: list[int], inside: list[bool]) -> list[bool]:
    """Undecided blocks get the label of their decided neighbours; where those differ, that of the nearer.

    Distance counts characters between; at equal distance, and where no block is decided, blocks of a
    main element are good and others bad.
    """
    n = len(labels)
    before: list[tuple[int, int] | None] = [None] * n
    after: list[tuple[int, int] | None] = [None] * n
    for order, near in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: tuple[int, int] | None = None
        for i in order:
            near[i] = last
            if labels[i] != UNDECIDED:
                last = (labels[i], 0)
            elif last:
                last = (last[0], last[1] + sizes[i])
    some_good = GOOD in labels
    out = []
    for i, label in enumerate(labels):
        if label == UNDECIDED:
            known = [x for x in (before[i], after[i]) if x]
            if inside[i] and (not some_good or any(x[0] == GOOD for x in known)):
                label = GOOD
            elif len(known) == 2 and known[0][0] != known[1][0] and known[0][1] == known[1][1]:
                label = GOOD if inside[i] else BAD
            else:
                label = min(known, key=lambda x: x[1])[0] if known else BAD
        out.append(label == GOOD)
    return out


def main_text(html: str | None) -> str:
    """The article's blocks, one to a line; empty for null and for pages without one."""
    found = in_place(blocks(html or ""))
    labels = of_articles(found, unlisted(found, [first_pass(b) for b in found]))
    kept = second_pass(labels, [len(b.text) for b in found], [b.inside for b in found])
    return "\n".join(b.text for b, k in zip(found, kept, strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, url_col, text, n_chars`` of each row; pages are read whole, nothing of the article is capped.

    Null and empty pages have an empty text; repeated rows are each extracted; other columns are ignored.
    """
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, url_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"{kinds}, text string, n_chars long")


def op8_query(spark, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
