"""Operator 6: main text of web pages by tag-path ratios.

A page is read into *blocks*: runs of text between block-level tags, each with its path of block
elements from the root. Text length, sentence punctuation and link text are summed for each path and set against
the number of its blocks; the fused ratio is smoothed along the page, so a heading or a short paragraph takes
part in its surroundings. Paths whose smoothed ratio reaches a share of the page's highest are content. What the
content's common container holds besides is taken in, too; elements that are boilerplate by
tag, role or class name never are. A name that articles use, too (DOUBTFUL), is only a doubt: within an article element, or on a section, such an element goes only if
it is no prose by its own ratios. An article or main element counts if it holds the page's prose: where more blocks of prose, and
three times its text, lie beside it, it is a teaser.

Defined results: null, empty and tagless pages give the empty text or their own text; unclosed and stray tags are
taken as browsers do for paragraphs, list items and cells; of an unclosed control or embedded object only the tag goes; a `<` that begins no tag is text; pages of any length are
read whole; equal page ids are separate rows; other columns are ignored. Per page nothing but its own html is used,
so there is no exchange and memory is bounded by the longest page.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import pieces

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
NAMING = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe math canvas object video audio title select textarea button".split())
DROPPED = frozenset("nav footer aside form dialog head menu".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Words of class names, ids and roles that mark boilerplate.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations trending popular sidebar rail widget menu nav navigation navbar breadcrumb breadcrumbs pagination pager footer copyright legal comment comments commentlist "
    "disqus reply replies respond discussion search toolbar topbar contentinfo complementary dialog alertdialog skip taboola outbrain".split()
)
#: Those that articles use for parts of their own, as well.
DOUBTFUL = frozenset("discussion legal copyright related social search popular trending share sharing rail skip notice alert promotion banner complementary".split())
#: An element that its closing tag isn't found for holds nothing, but for these, which hold the rest of the page.
SWALLOWS = frozenset("script style".split())
#: Tags that no control or embedded object holds: one of them before the closing tag shows that it belongs to another.
OUTSIDE = "article|main|body|section|h1"
#: These hold anything.
HOLDS_ALL = frozenset("template noscript".split())
END_SIGNS = re.compile(r"[.,;:!?。，、！？…]")
#: Headings of what readers, editors or sellers add to an article: they go with what follows in their element up to a heading of the same or a higher level.
ADDED = re.compile(r"(?:\d+ )?(?:reader )?(?:comments?|kommentare?|commentaires?|comentarios?|responses?|replies|leave a (?:comment|reply)|related(?: (?:articles|posts|stories))?|share(?: this)?|advertisement)(?: ?\(\d+\))?:?", re.I)
#: Those that stand between paragraphs, too: below an earlier block of the same element they go alone, as the article goes on.
BETWEEN = re.compile(r"(?:share(?: this)?|advertisement)(?: ?\(\d+\))?:?", re.I)
#: Notices outside an article element: an owner or a year, not a sentence on copyright.
LEGAL = re.compile(r"(?:copyright\s*)?©.*|copyright\s*\(c\).*|\(c\)\s*\d{4}\b.*|copyright\s*,?\s*(?:\d{4}|by\b).*|(?:.*[\s.,|])?all rights(?: are)? reserved\W*", re.I | re.S)
#: A path is content from this share of the page's highest smoothed ratio.
SHARE = 0.12
#: Weights of a block's neighbours at distance 0, 1, 2.
KERNEL = (1.0, 0.5, 0.2)


class Block:
    __slots__ = ("text", "path", "ids", "linked", "heading", "main")

    def __init__(self, text: str, path: tuple[str, ...], ids: tuple[int, ...], linked: int, heading: int, main: bool):
        self.text, self.path, self.ids, self.linked, self.heading, self.main = text, path, ids, linked, heading, main


def _marks(tag: str, attributes: str) -> tuple[str, int]:
    """The path step of an element, and whether its names or style mark it as boilerplate: 0 no, 1 in doubt, 2 yes."""
    if "=" not in attributes and "hidden" not in attributes:
        return tag, 0
    words: list[str] = []
    hidden, names = False, ""
    for name, *values in NAMING.findall(attributes):
        value, name = next((v for v in values if v), ""), name.lower()
        if name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif name in ("hidden", "aria-hidden"):
            hidden |= name == "hidden" and value != "until-found" or value.lower() == "true"
        else:
            names += f".{value}"
            words += [w.lower() for w in NAME_WORD.findall(value)]
    found = BOILERPLATE.intersection(words)
    return tag + re.sub(r"\d+", "#", names), 2 if hidden or found - DOUBTFUL else 1 if found else 0


def is_prose(found: list[Block]) -> bool:
    """Whether sentences make up most of the blocks' text, and links little of it."""
    length = sum(len(b.text) for b in found)
    spoken = sum(len(b.text) for b in found if 80 * len(END_SIGNS.findall(b.text)) >= len(b.text) and 4 * b.linked < len(b.text))
    return length > 0 and 2 * spoken > length


@cache
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I)


@cache
def _foreign(tag: str) -> re.Pattern:
    return re.compile(rf"<(?:{re.escape(tag)}|{OUTSIDE})\b", re.I) if tag not in ("object", "svg") else re.compile(rf"<(?:{OUTSIDE})\b", re.I)


def blocks(page: str) -> list[Block]:
    """The blocks of a page that no boilerplate element holds, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, str, int]] = []  # tag, path step, number
    bad: dict[int, bool] = {}  # number of a boilerplate element: whether its tag alone decides
    doubted: set[int] = set()  # of those, the ones that their own ratios decide on
    unclosed: set[str] = set()  # raw tags that no closing tag is left for
    holds_main: set[int] = set()
    text: list[str] = []
    linked = in_link = number = 0
    position, raw = 0, ""

    def flush() -> None:
        nonlocal linked
        if text:
            whole = "".join(text)
            text.clear()
            whole = " ".join((html.unescape(whole) if "&" in whole else whole).split())
            if whole:
                tags = [s[0] for s in stack]
                out.append(Block(whole, tuple(s[1] for s in stack), tuple(s[2] for s in stack), min(linked, len(whole)), next((int(t[1]) for t in reversed(tags) if t in HEADINGS), 0), any(t in MAIN for t in tags)))
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            text.append(piece)
            if in_link:
                linked += len(piece.strip())

    def pop_to(at: int) -> None:
        flush()
        del stack[at:]

    while True:
        if raw:
            m = None if raw in unclosed else _closing(raw).search(page, position)
            if not m:
                unclosed.add(raw)
                position = len(page) if raw in SWALLOWS else position
            elif raw in SWALLOWS | HOLDS_ALL or not _foreign(raw).search(page, position, m.start()):
                position = m.end()
            raw = ""
        m = TOKEN.search(page, position)
        add(page[position : m.start() if m else len(page)])
        if not m:
            break
        position = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            add(" ")
        elif tag in RAW:
            if not closing and not attributes.rstrip().endswith("/"):
                if tag not in ("noscript", "template", "button"):
                    flush()
                raw = tag
        elif tag in INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
        elif closing:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if at >= 0:
                pop_to(at)
            else:
                flush()
        else:
            flush()
            in_link = 0
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"), -1)
            if at >= 0:
                del stack[at:]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in SCOPE.get(tag, ()):
                    break
                if stack[i][0] in CLOSED_BY.get(tag, ()):
                    del stack[i:]
            if tag in VOID:
                continue
            number += 1
            step, boiler = _marks(tag, attributes)
            inside = any(s[0] in MAIN for s in stack)
            if tag in DROPPED or tag == "header" and not inside:
                bad[number] = True
            elif boiler and tag not in ("html", "body", "main"):
                bad[number] = False
                if boiler == 1 and (inside or tag == "section"):
                    doubted.add(number)
            if tag in MAIN and not boiler:
                holds_main.update(s[2] for s in stack)
            stack.append((tag, step, number))
    flush()
    # A wrapper named after its sidebar or menu that holds the article, or most of the text, isn't boilerplate.
    sure = {k for k, by_tag in bad.items() if by_tag}
    rest = [b for b in out if not sure.intersection(b.ids)]
    whole = sum(len(b.text) - b.linked for b in rest)
    for k in sorted(bad.keys() - sure):
        if k in doubted and is_prose([b for b in rest if k in b.ids]):
            continue
        if k not in holds_main and 10 * sum(len(b.text) - b.linked for b in rest if k in b.ids) < 6 * whole:
            sure.add(k)
    return [b for b in rest if not sure.intersection(b.ids)]


def ratios(found: list[Block]) -> list[float]:
    """The fused ratio of each block's path, smoothed along the page."""
    length: dict[tuple, float] = {}
    signs: dict[tuple, float] = {}
    count: dict[tuple, int] = {}
    for b in found:
        free = max(len(b.text) - 2 * b.linked, 0)
        length[b.path] = length.get(b.path, 0) + free
        signs[b.path] = signs.get(b.path, 0) + len(END_SIGNS.findall(b.text)) * free / len(b.text)
        count[b.path] = count.get(b.path, 0) + 1
    own = [math.sqrt(length[b.path] / count[b.path] * (0.2 + signs[b.path] / count[b.path])) for b in found]
    smooth = []
    for i in range(len(own)):
        total = weight = 0.0
        for d, w in enumerate(KERNEL):
            for j in {i - d, i + d}:
                if 0 <= j < len(own):
                    total += w * own[j]
                    weight += w
        smooth.append(total / weight)
    return smooth


def without_added(found: list[Block]) -> list[Block]:
    """The blocks without ADDED headings and what stands under them."""
    keep, seen = [], set()
    parent = level = 0
    for k, b in enumerate(found):
        if parent and (parent not in b.ids or 0 < b.heading <= level):
            parent = 0
        if not parent:
            if not (b.heading and k and len(b.ids) > 1 and ADDED.fullmatch(b.text)):
                keep.append(b)
            elif not (BETWEEN.fullmatch(b.text) and b.ids[-2] in seen):
                parent, level = b.ids[-2], b.heading
        seen.update(b.ids)
    return keep


def holds_story(own: list[Block], beside: list[Block]) -> bool:
    """Whether the article elements hold the page's story: not if more blocks of prose and three times their text lie beside them."""
    told = [b for b in beside if is_prose([b])]
    return len(told) <= len(own) or sum(len(b.text) for b in told) < 3 * sum(len(b.text) for b in own)


def main_text(page: str | None) -> str:
    """The main text of a page: its content blocks, one to a line."""
    if not page:
        return ""
    found = blocks(page)
    own, beside = [b for b in found if b.main], [b for b in found if not b.main]
    if own and holds_story(own, beside):
        found = own
    else:
        for b in found:
            b.main = False
        found = [b for b in found if not LEGAL.fullmatch(b.text)] or found
    found = without_added(found)
    if not found:
        return ""
    smooth = ratios(found)
    limit = SHARE * max(smooth)
    chosen = [x >= limit and (2 * b.linked <= len(b.text)) for x, b in zip(smooth, found, strict=True)]
    if not any(chosen):
        chosen = [x >= limit for x in smooth]
    # The container: the longest path of elements that holds nine tenths of the chosen text.
    weight: dict[int, int] = {}
    total = 0
    for b, yes in zip(found, chosen, strict=True):
        if yes:
            total += len(b.text)
            for k in b.ids:
                weight[k] = weight.get(k, 0) + len(b.text)
    _, inner = max(((b.ids.index(k), k) for b in found for k in b.ids[:-1] or b.ids if weight.get(k, 0) >= 0.9 * total), default=(0, -1))
    keep = []
    for b, yes in zip(found, chosen, strict=True):
        inside = inner < 0 or inner in b.ids
        if (yes and (b.main or inside)) or inside and (b.main or b.heading) and 2 * b.linked <= len(b.text):
            keep.append(b.text)
    return "\n".join(keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, html_col):
            texts = [main_text(x) for x in batch.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column(url_col), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` string, text string, n_chars long")
