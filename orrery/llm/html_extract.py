"""Main text of web pages by two passes of block rules.

A page is cut into text blocks at block-level tags. The first pass decides a block by its stop-word density, length and
link density: enough stop words for its length make main text, mostly links make none, and what tells too little (short
blocks, and long ones of another language, code or tables) stays open. What the page says of its regions is evidence: a
tag or a whole name that means navigation, footer, sidebar, notice, advert or comments speaks against any text in it, a
name that only has such a word in it against all but long text with many stop words. An article that holds most of the
page's main text speaks for it: inside it fewer stop words do and link lists stay open, beside it only long blocks with
many stop words count. In the second pass open blocks take the label of the nearest neighbour that its own text has
decided: first of those in the smallest region around both, then by distance; where nothing is decided they stay.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.scratch import slices

# Tag names by their part in a page, words of class and id that mark regions, and common words.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
REGION_TAGS = frozenset("article aside blockquote details dialog div dl fieldset figure footer form header main menu nav ol section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 legend caption".split())
HEAD_TAGS = frozenset("html head base link meta title script style noscript template".split())
BAD_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
#: Elements without text of the page: up to the closing tag or the page's end, or up to the closing tag if there is one.
RAW_TAGS = frozenset("script style textarea title iframe".split())
DROPPED_TAGS = RAW_TAGS | frozenset("noscript template svg select button object canvas audio video".split())
#: Those that can't hold another of their kind: the next opening tag means that this one was never closed.
FLAT_TAGS = frozenset("select button".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer "
    "disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted "
    "promotion recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription tagcloud "
    "toolbar topbar widget widgets".split()
)
#: Words that make a class or id name a page's layout and not the element's own part in it (has-sidebar, no-header).
LAYOUT_WORDS = frozenset("has have no not with without".split())
#: Words that say nothing of a region beside one of ``BAD_WORDS``.
PLAIN_WORDS = frozenset(
    "area articles bar block body bottom box button buttons column container desktop entry footer form global group header icons inner item items left line link links list "
    "main media mobile network news outer page panel post posts primary reading region right row secondary section site small slot sticky stories text "
    "thread title top unit user wrap wrapper".split()
)
BAD_ROLES = frozenset("banner navigation contentinfo complementary search form dialog alert menu menubar".split())
STOP_WORDS = frozenset(
    "a about after all also an and any are as at be been but by can do for from had has have he her his if in into is it its more no not of on one "
    "or our out she so some that the their them there they this to up was we were what when which who will with would you your "
    "au aux avec ce ces cette comme dans de des du elle en est et il ils la le les leur mais nous on ou par pas plus pour qu que qui sa se ses son "
    "sont sur un une vous "
    "als am auch auf aus bei bin das dass dem den der die ein eine einem einen einer er es für hat ich im ist mit nach nicht noch sich sie sind "
    "so über um und von vor war wie wird zu zum zur "
    "al como con del el ella entre era esta este fue han hay las lo los más me mi muy nos para pero por porque sin sobre su sus también una uno y ya".split()
)

MAX_LINK_DENSITY = 0.5
SHORT_WORDS, HINTED_WORDS, LONG_WORDS = 14, 20, 40
LOW_STOP_DENSITY, HIGH_STOP_DENSITY = 0.08, 0.18

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"""|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>"""
    r"|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z|</[^>]*>",
    re.DOTALL,
)
_ENDS = {t: re.compile(rf"<(/?){t}(?=[\s/>])[^>]*>?" if t in FLAT_TAGS else rf"<(/){t}(?=[\s/>])[^>]*>?", re.IGNORECASE) for t in DROPPED_TAGS}
_ATTR = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.IGNORECASE)
_STRIP = re.compile(r"^\W+|\W+$")


#: How much the page says against a region.
FREE, HINTED, NAMED = 0, 1, 2


@dataclass
class Block:
    """A text block: its text, words inside links, what its region is named, and the article it is in (0: none).

    ``up`` is the depth of the smallest region around this block and the one before, ``depth`` that of its own region.
    """

    text: str
    link_words: int
    named: int
    article: int
    depth: int
    up: int
    heading: bool


def _name_speaks(value: str, in_article: bool) -> int:
    """What the names in a class or id say: ``NAMED`` if one is a word of ``BAD_WORDS`` and nothing more, ``HINTED`` if one
    begins or ends with such a word. Inside an article a header is a part of it."""
    said = FREE
    for name in value.split():
        parts = re.findall("[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())
        bad = BAD_WORDS - {"header"} if in_article else BAD_WORDS
        if not parts or LAYOUT_WORDS & set(parts) or not bad & set(parts):
            continue
        if all(p in bad or p in PLAIN_WORDS or len(p) == 1 for p in parts):
            return NAMED
        if parts[0] in bad or (parts[-1] in bad and parts[0] != "content"):
            said = HINTED
    return said


def _speaks_against(tag: str, attrs: str, in_article: bool) -> int:
    said = NAMED if tag in BAD_TAGS or (tag == "header" and not in_article) else FREE
    if not attrs or tag in ("html", "body"):
        return said
    for name, *values in _ATTR.findall(attrs):
        value = "".join(values)
        name = name.lower()
        if name in ("class", "id") and tag not in HEADINGS:
            said = max(said, _name_speaks(value, in_article))
        value = value.lower()
        hidden = name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
        if hidden or (name == "role" and value in BAD_ROLES):
            return NAMED
    return said


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order. White space inside a block is one space; character references are decoded."""
    blocks: list[Block] = []
    # Open regions: (tag, what is said against it, number of the article around it), and how many of each tag are open.
    regions: list[tuple[str, int, int]] = [("", FREE, 0)]
    n_open: Counter[str] = Counter()
    parts: list[str] = []
    linked: list[str] = []
    in_link, in_head, heading, articles, own, low = False, False, False, 0, FREE, 0

    def flush() -> None:
        nonlocal low
        text = " ".join("".join(parts).split())
        if text:
            _, said, article = regions[-1]
            blocks.append(Block(text, len("".join(linked).split()), max(said, own), article, len(regions) - 1, low, heading))
            low = len(regions) - 1
        parts.clear()
        linked.clear()

    def add(piece: str) -> None:
        nonlocal in_head
        if not piece:
            return
        in_head = in_head and piece.isspace()  # text ends a head that nothing closes
        if not in_head:
            piece = html.unescape(piece)
            parts.append(piece)
            if in_link:
                linked.append(piece)

    at = 0
    unclosed: set[str] = set()  # tags that nothing closes any more
    while m := _TAG.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        closing, attrs = bool(m["close"] or m["close2"]), m["attrs"] or m["attrs2"] or ""
        if tag in DROPPED_TAGS:
            if closing or (attrs.endswith("/") and tag not in RAW_TAGS):
                continue
            end = None if tag in unclosed else _ENDS[tag].search(page, at)
            if end is None:
                unclosed.add(tag)
                at = len(page) if tag in RAW_TAGS else at
            elif end[1]:
                at = end.end()
            continue
        if tag == "head":
            in_head = not closing
        elif tag not in HEAD_TAGS:
            in_head = False
        if tag == "a":
            in_link = not closing
            linked.append(" ")
        if tag == "br":
            add(" ")
        elif tag in BLOCK_TAGS:
            flush()
            in_link, heading = False, tag in HEADINGS and not closing
            own = FREE if closing or tag in REGION_TAGS else _speaks_against(tag, attrs, regions[-1][2] > 0)
            if tag in REGION_TAGS and not closing:
                _, said, article = regions[-1]
                said = max(said, _speaks_against(tag, attrs, article > 0))
                if tag in ("article", "main") and not article:
                    articles += 1
                    article = articles
                regions.append((tag, said, article))
                n_open[tag] += 1
            elif tag in REGION_TAGS and n_open[tag]:
                while True:
                    last = regions.pop()[0]
                    n_open[last] -= 1
                    if last == tag:
                        break
                low = min(low, len(regions) - 1)
    add(page[at:])
    flush()
    return blocks


def stop_density(words: list[str]) -> float:
    return sum(_STRIP.sub("", w).lower() in STOP_WORDS for w in words) / len(words)


def decide(block: Block, stops: float, trusted: bool) -> bool | None:
    """First pass: main text (True), not (False), or open (None); ``trusted`` says that the page's articles are evidence."""
    n = len(block.text.split())
    inside, outside = trusted and block.article > 0, trusted and not block.article
    if block.link_words > MAX_LINK_DENSITY * n:
        return None if inside and block.named == FREE else False
    if block.named == NAMED:
        return False
    if block.named == HINTED:
        return True if n >= HINTED_WORDS and stops >= HIGH_STOP_DENSITY else None
    if outside:
        return n >= LONG_WORDS and stops >= HIGH_STOP_DENSITY
    if n < SHORT_WORDS:
        return None
    return True if stops >= (LOW_STOP_DENSITY if inside or n >= LONG_WORDS else HIGH_STOP_DENSITY) else None


def inherit(blocks: list[Block], labels: list[bool | None], open_default: bool) -> list[bool]:
    """Second pass: open blocks take the label of the nearest block that its own text has decided.

    Of the nearest before and the nearest after, the one that shares the smaller region counts, then the nearer one; where
    both are as near, main text wins. Headings belong to what follows: they ask there first and give no label to what is
    before them, and where no block was found to be main text the first open heading is. Blocks of named regions give no
    label but where it is that of a list of links. An open block of a region whose name hints takes a label from inside that region only, and else is no main text.
    """
    n, labels = len(labels), list(labels)
    if True not in labels:
        first = next((i for i, b in enumerate(blocks) if b.heading and labels[i] is None and b.named == FREE), None)
        if first is not None:
            labels[first] = True

    def nearest(order: range, step: int) -> list[tuple[int, int] | None]:
        found, last, shared = [None] * n, None, 0
        for i in order:
            if step > 0:
                shared = min(shared, blocks[i].up)
            found[i] = None if last is None else (last, shared)
            b = blocks[i]
            if labels[i] is not None and not (b.heading and step < 0) and (b.named != NAMED or b.link_words > MAX_LINK_DENSITY * len(b.text.split())):
                last, shared = i, b.depth
            if step < 0:
                shared = min(shared, b.up)
        return found

    before, after = nearest(range(n), 1), nearest(range(n - 1, -1, -1), -1)
    out = []
    for i, own in enumerate(labels):
        if own is not None:
            out.append(own)
            continue
        head = blocks[i].heading
        near = sorted((-shared, head and j < i, abs(i - j), not labels[j]) for j, shared in filter(None, (before[i], after[i])))
        if blocks[i].named == HINTED:
            out.append(bool(near) and -near[0][0] >= blocks[i].depth and not near[0][-1])
        else:
            out.append(not near[0][-1] if near else open_default)
    return out


def main_text(page: str) -> str:
    """The main text of a page: its blocks in order, joined by an empty line; empty if there is none."""
    blocks = blocks_of(page)
    sizes = [len(b.text.split()) for b in blocks]
    stops = [stop_density(b.text.split()) for b in blocks]
    labels = [decide(b, d, False) for b, d in zip(blocks, stops, strict=True)]
    within = sum(n for b, n in zip(blocks, sizes, strict=True) if b.article and b.named != NAMED and b.link_words <= MAX_LINK_DENSITY * n)
    if within and within >= sum(n for b, n, good in zip(blocks, sizes, labels, strict=True) if good and not b.article):
        labels = [decide(b, d, True) for b, d in zip(blocks, stops, strict=True)]
        kept = [i for i, b in enumerate(blocks) if not b.article and labels[i]]
        # Inside an article neighbours are those of the same article: what surrounds it says nothing about it.
        for _, own in groupby((i for i, b in enumerate(blocks) if b.article), key=lambda i: blocks[i].article):
            own = list(own)
            kept += [i for i, good in zip(own, inherit([blocks[i] for i in own], [labels[i] for i in own], True), strict=True) if good]
    else:
        kept = [i for i, good in enumerate(inherit(blocks, labels, True)) if good]
    return "\n\n".join(blocks[i].text for i in sorted(kept))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        at = batch.schema.get_field_index("__html")
        texts = [main_text(x.as_py() or "") for x in batch.column(at)]
        arrays = [c for i, c in enumerate(batch.columns) if i != at]
        names = [n for i, n in enumerate(batch.schema.names) if i != at]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*names, "text", "n_chars"])


def extract(pages: DataFrame, page_html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages``.

    A null or empty page has an empty text, and so has a page without main text. Null ids and urls stay null, repeated
    rows give repeated rows. Each page is handled whole in one task; there is no shuffle.
    """
    rows = pages.select("page_id", "url", F.col(page_html).alias("__html"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "__html")
    return rows.mapInArrow(_extract, f"{fields}, text string, n_chars long")
