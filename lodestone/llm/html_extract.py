"""Main-text extraction by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one looks at each block alone and adds up its
evidence: stop-word density and length speak for article text, link density against it; where the
block stands adds to that (in the page's `article` or `main` element, beside one, or in an area
named as menu, advert, comments and so on). Enough evidence makes a block good, little makes it
bad, and what lies between is ambiguous: short blocks and those of middling density. Pass two lets
an ambiguous block inherit the label of the nearest decided blocks in its region, the article or the
rest of the page, and a heading that of the block after it. Where those before and after differ, the
nearer one counts; evidence that leans clearly, that stands between two as near or in a region
without decided blocks, decides against the middle of the scale.

A name or a form does not make an area of what holds most of the page's text and all of its articles:
that is the page's frame (of a page without an article only if the name is one of a layout). Areas
of readers' comments, related pages and the like always count.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names by their role in a page.
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("head script style noscript template nav footer aside form select button textarea iframe svg canvas object audio video map menu dialog".split())
RAW = frozenset("script style textarea title noscript template iframe xmp svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = frozenset("li dt dd td th tr option".split())
#: Words of class, id and role attributes that name areas beside the article.
AREAS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar aside footer comment comments discussion reply replies cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe signup login share sharing social related recommended widget toolbar pagination pager search disclaimer".split())
HEADER_AREAS = frozenset("header masthead topbar".split())
#: Of those, the ones that are areas however much they hold; and words that turn a name into a statement about the page.
ALWAYS = frozenset("comment comments discussion reply replies related recommended footer cookie cookies consent gdpr disclaimer".split())
LAYOUT = frozenset("sidebar search widget toolbar pager pagination".split())
ABOUT = frozenset("has have with without no not is show shows hide hides hidden".split())
#: Frequent words of four languages.
STOP = frozenset(
    "the of and to in a is that it for as was with be by on not he his but at are this have from or had an they which you were her she there been their has will would who when what so if no out up into than them can only other some could these about all our me my do "
    "le la les un une des et est que qui dans pour pas sur au avec ce il elle se plus par ne du en son ses sont mais ou aux cette nous vous ont je leur y à de "
    "der die das und ist nicht ein eine zu den von mit sich auf für dem im als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei "
    "el los las y del se por con no una su para es al lo como más pero sus este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante".split())

#: A tag ends before the next `<` outside quotes, so that a `<` without `>` costs no more than the text up to the next one.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<|[^<]+", re.S)
_MARK = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_NAME = re.compile(r"[a-z]+")
_WORD = re.compile(r"[^\W\d_]+")


#: Kinds of areas: always one; one unless it frames an article; one unless it frames most of the text.
SURE, NAMED, FRAME = 3, 2, 1


@dataclass
class Block:
    root: int  # 0 outside the article, else the number of the article
    area: int  # 0 outside areas, else the number of the innermost one
    heading: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    evidence: float = 0.0
    label: str = ""


class _Open(list):
    """The open elements, as (name, number of the area they are in, article number), with counts of what matters of them."""

    def __init__(self) -> None:
        super().__init__()
        self.count: Counter[str] = Counter()
        self.blocks: list[int] = []  # places of block elements
        self.links = self.headings = 0

    def push(self, name: str, area: int, root: int) -> None:
        if name in BLOCK:
            self.blocks.append(len(self))
        self.count[name] += 1
        self.links += name == "a"
        self.headings += name in HEADINGS
        self.append((name, area, root))

    def cut(self, at: int) -> list[str]:
        """Closes the elements from place `at` on."""
        gone = [x[0] for x in self[at:]]
        del self[at:]
        self.count.subtract(gone)
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()
        self.links -= gone.count("a")
        self.headings -= sum(x in HEADINGS for x in gone)
        return gone

    def close(self, name: str) -> list[str]:
        """Closes the innermost element of that name and all inside it; nothing if none is open."""
        if not self.count[name]:
            return []
        at = len(self) - 1
        while self[at][0] != name:
            at -= 1
        return self.cut(at)

    def place(self) -> tuple[int, int]:
        return self[-1][1:] if self else (0, 0)


def _named(attributes: str) -> set[str]:
    found: set[str] = set()
    for m in _MARK.finditer(attributes):
        for name in m[1].split():
            words = _NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
            found.update(words if words and words[0] not in ABOUT else ())
    return found


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; blocks without text are left out. Takes time in proportion to the page."""
    out: list[Block] = []
    stack, roots, at = _Open(), 0, 0
    areas: list[tuple[int, int]] = [(0, FRAME)]  # by number: the area around it, its kind
    now = Block(0, 0, False)

    def close() -> None:
        nonlocal now
        now.text = " ".join(html.unescape("".join(now.parts)).split())
        if now.text:
            out.append(now)
        area, root = stack.place()
        now = Block(root, area, bool(stack.headings))

    while m := _TOKEN.match(page, at):
        at = m.end()
        tag = m[2]
        if tag is None:
            if page[m.start()] != "<" or m.end() == m.start() + 1:
                now.parts.append(m[0])
                now.linked += len(m[0].strip()) if stack.links else 0
            continue
        tag = tag.lower()
        if m[1]:
            if any(x in BLOCK or x in NEVER for x in stack.close(tag)):
                close()
            continue
        if tag == "br":
            now.parts.append(" ")
        if tag == "hr":
            close()
        if tag in VOID:
            continue
        if tag in BLOCK and stack.blocks:  # an open paragraph, item or cell ends where the next block begins
            name = stack[stack.blocks[-1]][0]
            if name == "p" or (name == tag and tag in ITEMS):
                stack.cut(stack.blocks[-1])
        area, root = stack.place()
        alone = _self_closed(m[3])
        if tag in RAW or alone:
            if tag in RAW and not alone:
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif tag in BLOCK:
                close()
            continue
        if tag in ("article", "main") and areas[area][1] != SURE and not root:
            roots += 1
            root = roots
        beside = _beside(tag, m[3], root)
        if beside:
            areas.append((area, SURE if areas[area][1] == SURE else beside))
            area = len(areas) - 1
        stack.push(tag, area, root)
        if tag in BLOCK or tag in NEVER or beside:
            close()
    close()
    _settle(out, areas)
    return out


def _settle(found: list[Block], areas: list[tuple[int, int]]) -> None:
    """Sets each block's area to one that counts around it, or to 0: a frame is none."""
    inside, rooted = [0] * len(areas), [0] * len(areas)
    for b in found:
        if areas[b.area][1] != SURE:
            inside[b.area] += len(b.text) - b.linked
            rooted[b.area] += len(b.text) if b.root else 0
    for k in range(len(areas) - 1, 0, -1):  # an area comes after the one around it
        around, kind = areas[k]
        if kind != SURE:
            inside[around] += inside[k]
            rooted[around] += rooted[k]
    counts = [0] * len(areas)
    for k in range(1, len(areas)):
        around, kind = areas[k]
        frame = kind != SURE and 2 * inside[k] > inside[0] and rooted[k] == rooted[0] and (rooted[k] or kind == FRAME)
        counts[k] = counts[around] if frame else k
    for b in found:
        b.area = counts[b.area]


def _self_closed(attributes: str) -> bool:
    """Whether a tag ends in a slash of its own; one that ends an unquoted value is part of the value."""
    if not attributes.endswith("/"):
        return False
    before = attributes[:-1]
    last = before.split()[-1] if before.strip() and not before[-1].isspace() else ""
    if not last or last[-1] in "\"'":
        return True
    return "=" not in last and not before[: -len(last)].rstrip().endswith("=")


def _beside(tag: str, attributes: str, root: int) -> int:
    """The kind of area beside the article text that an element is, by its own or its class, id or role name; 0 for none."""
    if (tag in NEVER and tag != "form") or (tag == "header" and not root):
        return SURE
    names = _named(attributes) if attributes and tag not in HEADINGS and tag not in ("html", "body", "article", "main") else set()
    named = AREAS & names or (HEADER_AREAS & names if not root else set())
    if not named:
        return FRAME if tag == "form" else 0
    return SURE if not ALWAYS.isdisjoint(named) else FRAME if named <= LAYOUT else NAMED


@dataclass(frozen=True)
class Rules:
    """Weights and thresholds of the evidence. Density and length count up to 1 each."""

    stop: float = 0.25  # share of stop words that counts in full
    length: int = 200  # characters that count in full
    links: float = 3.0  # against a block that is all links
    inside: float = 1.25  # for a block in the page's article
    outside: float = -1.5  # for a block outside it, where the page has one
    area: float = -4.0
    rights: float = -2.0  # for a copyright sign outside the article
    good: float = 1.6
    middle: float = 0.9
    bad: float = 0.0


RULES = Rules()


def first_pass(b: Block, marked: bool, rules: Rules = RULES) -> None:
    """Sets evidence and label (good, bad or ambiguous) of a block by itself. marked: whether its page has an article element."""
    n = len(b.text)
    words = _WORD.findall(b.text.lower())
    dense = sum(w in STOP for w in words) / max(len(words), 1)
    b.evidence = min(dense / rules.stop, 1.0) + min(n / rules.length, 1.0) - rules.links * b.linked / max(n, 1)
    if b.area:
        b.evidence += rules.area
    elif b.root:
        b.evidence += rules.inside
    elif marked:
        b.evidence += rules.outside
    if not b.root and "©" in b.text:
        b.evidence += rules.rights
    b.label = "good" if b.evidence >= rules.good else "bad" if b.evidence <= rules.bad else "ambiguous"


def second_pass(found: list[Block], rules: Rules = RULES) -> None:
    """Ambiguous blocks inherit from the nearest decided block in their region, which is their article or the rest of the page.

    The edges of an article count as good blocks, those of the rest of the page as bad ones. Where the
    decided blocks before and after differ, the nearer one counts, unless the block's own evidence is
    nearer to being good or bad than to the middle; that decides then, as it does between two as near
    and in a region without decided blocks. A heading takes the label of the block after it in its
    region. Areas beside the article are no neighbours.
    """
    labels = [b.label for b in found]
    regions: dict[int, list[int]] = {}
    for i, b in enumerate(found):
        if not b.area:
            regions.setdefault(b.root, []).append(i)
    for root, places in regions.items():
        edge, own = "good" if root else "bad", [labels[i] for i in places]
        sure = [k for k, x in enumerate(own) if x != "ambiguous"]
        for k, i in enumerate(places):
            if own[k] == "ambiguous":
                at = bisect(sure, k)
                before, after = sure[at - 1] if at else -1, sure[at] if at < len(sure) else len(own)
                left, right = own[before] if at else edge, own[after] if at < len(sure) else edge
                nearest = left if left == right or k - before < after - k else right if after - k < k - before else ""
                clear = not rules.middle + rules.bad < 2 * found[i].evidence < rules.middle + rules.good
                found[i].label = nearest if sure and nearest and (left == right or not clear) else "good" if found[i].evidence >= rules.middle else "bad"
    for b in found:
        if b.area and b.label == "ambiguous":
            b.label = "good" if b.evidence >= rules.middle else "bad"
    for places in regions.values():
        for i, after in zip(places[-2::-1], places[:0:-1], strict=True):
            if found[i].heading and labels[i] == "ambiguous":
                found[i].label = found[after].label


def classified(page: str | None) -> list[Block]:
    """The blocks of a page, labelled by both passes."""
    found = blocks(page or "")
    marked = any(b.root and not b.area for b in found)
    for b in found:
        first_pass(b, marked)
    second_pass(found)
    return found


def main_text(page: str | None) -> str:
    return "\n\n".join(b.text for b in classified(page) if b.label == "good")


def extract(pages: DataFrame, *, html_col: str = "html", keep: tuple | list = ("page_id", "url")) -> DataFrame:
    """(*keep, text): the main text of every row; null and empty pages have none.

    One row per row of pages, repeated rows included; broken markup is read as far as it goes, a
    page of any length in one piece. An empty table gives no rows. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([main_text(x.as_py()) for x in batch.column(0)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], text], names=[*batch.schema.names[1:], "text"])

    rows = pages.select(F.col(html_col).alias("_html"), *keep)
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rows.columns[1:])
    return rows.mapInArrow(run, f"{fields}, text string")
