"""Operator 10, main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  Scripts, styles, comments and
controls never make text.  Structure settles what it can: blocks inside
navigation, header, footer, aside, form or dialog elements, or inside elements
whose class, id or role names such a part (menu, advert, cookie notice, reader
comments ...), are out.

First pass, without context: a block is *good* or *bad* by link density,
length and stop-word density, *near-good* or *short* where these don't settle
it.  Second pass: undecided blocks take the label of the nearest decided
blocks of their region; between a good and a bad one, near-good blocks are
kept and short ones follow the nearer (good on a tie).  If a page has an article
or main element with text, only blocks inside such elements are candidates;
there length and stop words make blocks good and links make them bad, parts that
structure takes out count for no neighbour, and without any decided block all
stay.

Defined results: null or empty html gives an empty text; unclosed tags end
with their parent; after a quote that never ends, tags end at the next ``>``; undecodable references stay as they are; repeated rows are
extracted alike; other columns are not read unless carried.
"""

from __future__ import annotations

import html as H
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

# Element names of HTML.
BLOCK_TAGS = frozenset("address article aside blockquote body br button canvas caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split())
SILENT_TAGS = frozenset("script style noscript template iframe object embed svg math canvas audio video map head title select button textarea datalist input".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUT_TAGS = frozenset("nav header footer aside form dialog menu search".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
#: Names that tell a wrapper's layout, such as has-sidebar.
LAYOUT_NAMES = re.compile(r"(?:^|(?<=\s))(?:has|no|not|with|without)[-_]\S+", re.I)
READER_NAMES = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies|respond|ads?|advert\w*)(?:$|[\s_-])", re.I)
# What class and id names call the parts of a page that are not its text.
OUT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|foot|sidebar|side|aside|widgets?|related|recommend\w*|share|sharing|social"
    r"|comments?|commentlist|replies|reply|disqus|respond|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|subscribe|newsletter|signup|login|register|search\w*|form|pagination|pager|tags|tagcloud|toolbar|skip\w*|copyright|legal|disclaimer|hidden|paywall)(?:$|[\s_-])", re.I)
STOP_WORDS = frozenset(
    "the of and to a in is it that for on with as was are be this by from at or an not have you which but his they we her she all will one has been if were their"
    " der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach bei im um am dem einen wird oder"
    " le la les de des et un une est que qui dans pour pas sur au par ce il elle plus avec son se ne en du ou mais nous vous sont"
    " el los las y que en por con para una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre no se del".split())

TOKEN = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
ENDS = {"<!--": "-->", "<![CDATA[": "]]>"}
QUOTE_OR_END = re.compile("[\"'>]")
ATTR = re.compile(r"""(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
SPACE = re.compile(r"\s+")
CONTENT_TAGS = frozenset(["article", "main"])


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    content: int  # depth of article or main elements around it
    out: bool  # inside a part that is not text
    heading: bool


def _named_out(tag: str, attrs: str) -> bool:
    if tag in OUT_TAGS:
        return True
    if tag in ("html", "body") or not attrs:
        return False
    pattern = READER_NAMES if tag in CONTENT_TAGS else OUT_NAMES
    for name, *values in ATTR.findall(attrs):
        name, value = name.lower(), values[0] or values[1] or values[2]
        if name in ("class", "id") and pattern.search(LAYOUT_NAMES.sub(" ", value)):
            return True
        if name == "role" and value.strip().lower() in OUT_ROLES:
            return True
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


class Tags:
    """Tags of a page in turn; work is in proportion to the page, however broken it is."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag, or -1. After a quote that never ends, quotes count for nothing."""
        page, i = self.page, at
        while self.quotes:
            m = QUOTE_OR_END.search(page, i)
            if m and m[0] == ">":
                return m.start()
            close = page.find(m[0], m.end()) if m else -1
            if close < 0:
                self.quotes = False
            i = close + 1
        return page.find(">", at)


@dataclass
class OpenTags:
    """The open elements: a stack in which an inline element may close beneath others."""

    stack: list[tuple[str, bool, bool] | None]
    places: dict[str, list[int]]  # of each name, in order
    block_places: list[int]

    def push(self, entry: tuple[str, bool, bool]) -> None:
        self.places.setdefault(entry[0], []).append(len(self.stack))
        if entry[0] in BLOCK_TAGS:
            self.block_places.append(len(self.stack))
        self.stack.append(entry)

    def last(self, tag: str) -> int:
        at = self.places.get(tag)
        return at[-1] if at else -1

    def inmost(self) -> str:
        while self.stack and self.stack[-1] is None:
            self.stack.pop()
        return self.stack[-1][0] if self.stack else ""

    def close(self, tag: str) -> list[tuple[str, bool, bool]]:
        """End the inmost ``tag``, and what is open in it; an inline element does not end the blocks begun in it."""
        at = self.last(tag)
        if at < 0:
            return []
        if tag not in BLOCK_TAGS and self.block_places and self.block_places[-1] > at:
            entry, self.stack[at] = self.stack[at], None
            self.places[tag].pop()
            return [entry]
        ended = [e for e in self.stack[at:] if e]
        del self.stack[at:]
        for e in ended:
            self.places[e[0]].pop()
            if e[0] in BLOCK_TAGS:
                self.block_places.pop()
        return ended


def blocks(page: str) -> list[Block]:
    """The page's non-empty blocks in order."""
    found: list[Block] = []
    tags, opened = Tags(page), OpenTags([], {}, [])
    depth = {"a": 0, "content": 0, "silent": 0, "out": 0, "heading": 0}
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        joined = SPACE.sub(" ", "".join(text)).strip()
        if joined:
            found.append(Block(joined, linked, depth["content"], depth["out"] > 0, depth["heading"] > 0))
        text.clear()
        linked = 0

    def count(tag: str, silent: bool, out: bool, step: int) -> None:
        depth["a"] += step * (tag == "a")
        depth["content"] += step * (tag in CONTENT_TAGS)
        depth["heading"] += step * (len(tag) == 2 and tag[0] == "h" and tag[1].isdigit())
        depth["silent"] += step * silent
        depth["out"] += step * out

    def close(tag: str) -> None:
        for entry in opened.close(tag):
            count(*entry, -1)

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not depth["silent"]:
            plain = H.unescape(raw) if "&" in raw else raw
            text.append(plain)
            if depth["a"]:
                linked += len(plain.strip())

    said = i = 0  # text is said up to the first, tags are read up to the second
    while m := TOKEN.search(page, i):
        if m[2] is None:
            mark = ENDS.get(m[0], ">")
            stop = page.find(mark, m.end())
            say(page[said: m.start()])
            if m[0] == "<![CDATA[":
                say(page[m.end(): stop if stop >= 0 else len(page)])
            said = i = stop + len(mark) if stop >= 0 else len(page)
            continue
        stop = tags.end(m.end())
        if stop < 0:  # no tag ends any more
            break
        say(page[said: m.start()])
        said = i = stop + 1
        tag, attrs = m[2].lower(), page[m.end(): stop]
        if tag in BLOCK_TAGS:
            flush()
        if m[1]:
            close(tag)
            continue
        if tag in BLOCK_TAGS and tag != "br" and opened.inmost() == "p":
            close("p")
        if tag in RAW_TAGS:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, i)
            said = i = end.end() if end else len(page)
            continue
        if tag in VOID_TAGS or attrs.endswith("/") and tag not in BLOCK_TAGS:
            continue
        if tag == "li" and opened.last("li") > max(opened.last("ul"), opened.last("ol")):
            close("li")
        entry = (tag, tag in SILENT_TAGS, _named_out(tag, attrs))
        opened.push(entry)
        count(*entry, 1)
    say(page[said:])
    flush()
    return found


def classify(found: list[Block], max_links: float = 0.33, short: int = 70, long: int = 200, few_stops: float = 0.10, many_stops: float = 0.25) -> list[str]:
    """First pass: good, bad, near or short for each block."""
    out = []
    for b in found:
        density = b.linked / len(b.text)
        if b.out or density > max_links:
            out.append("bad")
            continue
        words = b.text.lower().split()
        stops = sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words) / max(len(words), 1)
        if b.content:
            out.append("good" if len(b.text) >= short and stops >= few_stops else "near" if len(b.text) >= short else "short")
        elif len(b.text) < short:
            out.append("bad" if b.linked else "short")
        elif stops >= many_stops:
            out.append("good" if len(b.text) > long else "near")
        else:
            out.append("near" if stops >= few_stops else "bad")
    return out


def settle(found: list[Block], labels: list[str]) -> list[bool]:
    """Second pass: whether each block is text."""
    # inside an article, what its structure takes out (a share bar between paragraphs) says nothing of its neighbours
    decided: list[tuple[int, bool]] = [(i, x == "good") for i, (b, x) in enumerate(zip(found, labels, strict=True)) if x == "good" or x == "bad" and not (b.out and b.content)]
    before: list[tuple[int, bool] | None] = []
    last = None
    known = dict(decided)
    for i in range(len(found)):
        if i in known:
            last = (i, known[i])
        before.append(last)
    after: list[tuple[int, bool] | None] = [None] * len(found)
    last = None
    for i in range(len(found) - 1, -1, -1):
        if i in known:
            last = (i, known[i])
        after[i] = last
    out = []
    for i, (b, x) in enumerate(zip(found, labels, strict=True)):
        if x in ("good", "bad"):
            out.append(x == "good")
        else:
            p, n = before[i], after[i]
            sides = [s for s in (p, n) if s]
            if not sides:
                out.append(x == "near" or b.content > 0)  # an article is text where nothing says otherwise
            elif len(sides) == 1 or p[1] == n[1]:
                out.append(sides[0][1])
            else:
                out.append(x == "near" or (i - p[0] <= n[0] - i if p[1] else n[0] - i <= i - p[0]))
    return out


def main_text(page: str | None, **limits) -> str:
    """The page's text: kept blocks, one per line."""
    found = blocks(page or "")
    if any(b.content and not b.out for b in found):
        found = [b for b in found if b.content]
    keep = settle(found, classify(found, **limits))
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract_pages(pages: DataFrame, html_col: str = "html", carry: list[str] | None = None, out_col: str = "text", **limits) -> DataFrame:
    """``carry`` columns (default: all but the html) with the text and its length in code points."""
    names = [c for c in (carry if carry is not None else pages.columns) if c not in (html_col, out_col, "n_chars")]
    schema = StructType([*(f for f in pages.schema.fields if f.name in names), StructField(out_col, StringType()), StructField("n_chars", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                texts = [main_text(x.as_py(), **limits) for x in b.column(html_col)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in schema.names[:-2]), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return pages.select(*dict.fromkeys([*names, html_col])).mapInArrow(run, schema)
