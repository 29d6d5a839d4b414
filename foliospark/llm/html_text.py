"""Main text of web pages by block rules in two passes.

A page is cut into blocks at block-level tags. What the markup says of a block (a menu, a comment, an
advert; an article) is one evidence, stop-word density, length and link density are the others. The
first pass decides what is clear: boilerplate or text. Short and middling blocks stay open; the second
pass gives them the label of the nearest decided block.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a an and are as at be but by for from has have he her his i in is it its not of on or she that the their they this to was we were which will with you
    aber als am auch auf aus bei bin das dass dem den der des die durch ein eine einem einen einer er es für hat ich im ist mit nach nicht oder sich sie sind über um und von vor war wie wir zu zum zur
    au aux avec ce cette dans de des du elle en est et il ils je la le les leur mais ne nous ou par pas pour qu que qui sa se ses son sur un une vous
    al como con del el ella entre era esta este fue ha han las lo los más mi muy no para pero por se sin sobre su sus también una y ya""".split()
)

# Elements by their part in a page, from the HTML standard.
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li
    main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul""".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("head noscript template svg math select button object canvas audio video datalist map dialog".split())
ASIDE = frozenset("nav footer aside form menu search".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role that mark what stands around an article; of readers' comments and the like.
AROUND = frozenset(
    """ad ads adbox adslot adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs colophon consent contentinfo cookie cookies copyright disclaimer foot footer gdpr
    header login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination paywall popup promo promotion share sharing signup skip social sponsor sponsored subscribe subscription toolbar topbar""".split()
)
BESIDE = frozenset("comment comments commentlist complementary discussion disqus recommendations recommended related replies respond responses sidebar trending widget widgets".split())
#: A name that begins so says what the page has or lacks, not what the element is.
HAVING = frozenset("has with without no is not".split())
INNER_HEADER = frozenset("article content entry post story page".split())

#: Words from which a block can be decided alone, stop-word densities and link densities.
LONG = 12
STOP_LOW, STOP_HIGH = 0.08, 0.25
LINKS_MOST, LINKS_OPEN = 0.5, 0.25

DROP, BAD, NEUTRAL, ARTICLE = -2, -1, 0, 1
_TAG = re.compile(r"<(?:!--|(/?)([A-Za-z][^\s/>]*)|[!?/])")
_TO_END = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?|["'])*+>""")
_ATTRIBUTE = re.compile(r"""([A-Za-z][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORD = re.compile(r"\w+")


class Block:
    """Text of one block and what stands around it."""

    __slots__ = ("text", "zone", "tag", "words", "stops", "links")

    def __init__(self, text: str, zone: int, tag: str, links: float):
        self.text, self.zone, self.tag, self.links = text, zone, tag, links
        words = _WORD.findall(text.lower())
        self.words, self.stops = len(words), sum(map(STOP_WORDS.__contains__, words)) / max(len(words), 1)


def _named(attributes: str) -> tuple[bool, bool, bool]:
    """(around, beside, hidden) by an element's class, id, role and style."""
    names, hidden = [], False
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key in ("class", "id", "role"):
            names += value.split()
        hidden |= key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.lower().replace(" ", "")
    around = beside = False
    for name in names:
        parts = [p.lower() for p in _NAME_PARTS.findall(name)]
        if not parts or parts[0] in HAVING:
            continue
        beside |= not BESIDE.isdisjoint(parts)
        found = AROUND.intersection(parts)
        around |= bool(found - {"header"}) or bool(found) and INNER_HEADER.isdisjoint(parts)
    return around, beside, hidden


class _Page:
    """Walks the tags of a page and cuts it into blocks."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        #: (tag, zone, beside) of the open elements.
        self.open: list[tuple[str, int, bool]] = [("", NEUTRAL, False)]
        self.count: Counter[str] = Counter()
        self.parts: list[tuple[str, bool]] = []
        self.breaks = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(t for t, _ in self.parts).split())
            if text:
                linked = sum(len("".join(t.split())) for t, a in self.parts if a)
                tag = next((t for t, _, _ in reversed(self.open) if t in BLOCKS), "")
                self.blocks.append(Block(text, self.open[-1][1], tag, linked / max(len(text.replace(" ", "")), 1)))
            self.parts = []
        self.breaks = 0

    def text(self, raw: str) -> None:
        if raw and self.open[-1][1] != DROP:
            if not raw.isspace():
                self.breaks = 0
            self.parts.append((html.unescape(raw) if "&" in raw else raw, self.count["a"] > 0))

    def close(self, tags: frozenset[str] | set[str], until: frozenset[str]) -> None:
        """Closes the innermost element of ``tags``, unless one of ``until`` stands before it."""
        if not any(self.count[t] for t in tags):
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] in tags:
                self.count.subtract(t for t, _, _ in self.open[k:])
                del self.open[k:]
                return
            if self.open[k][0] in until:
                return

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.parts.append((" ", False))
            self.breaks += 1
            if self.breaks > 1:
                self.flush()
            return
        if tag in BLOCKS:
            self.flush()
            self.close({"head"}, frozenset())
            self.close({"p"}, _SCOPE)
            if tag in _ENDS:
                self.close(*_ENDS[tag])
        if tag in VOID:
            return
        if tag == "a":
            self.close({"a"}, BLOCKS)
        _, zone, apart = self.open[-1]
        around, beside, hidden = _named(attributes) if attributes and tag not in ("html", "body", "main") else (False, False, False)
        if tag in DROPPED or hidden or zone == DROP:
            zone = DROP
        elif tag in ("article", "main") and not (around or beside or apart):
            zone = ARTICLE  # also where a menu before it was left open
        elif zone != BAD and (tag in ASIDE or beside or around and (tag in BLOCKS or zone != ARTICLE) or tag == "header" and zone != ARTICLE):
            zone = BAD
        if tag in BLOCKS or tag == "a" or zone != self.open[-1][1]:
            self.open.append((tag, zone, apart or beside or tag == "aside"))
            self.count[tag] += 1

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
            self.close({tag}, _WALLS if tag != "table" else frozenset())
        elif tag == "br":
            self.start("br", "")
        else:
            self.close({tag}, BLOCKS if tag not in DROPPED else frozenset())


_SCOPE = frozenset("table td th caption button object article main".split())
_WALLS = frozenset({"table"})
_ENDS: dict[str, tuple[set[str], frozenset[str]]] = {
    "li": ({"li"}, frozenset("ul ol menu dir table".split())), "dt": ({"dt", "dd"}, frozenset("dl table".split())), "dd": ({"dt", "dd"}, frozenset("dl table".split())),
    "td": ({"td", "th"}, frozenset("tr table".split())), "th": ({"td", "th"}, frozenset("tr table".split())), "tr": ({"tr"}, frozenset({"table"})),
    "tbody": ({"thead", "tbody", "tfoot"}, frozenset({"table"})), "tfoot": ({"thead", "tbody", "tfoot"}, frozenset({"table"})), "option": ({"option"}, frozenset({"select"})),
}


def blocks(page: str) -> list[Block]:
    """The blocks of a page with text, in page order; what is never shown is left out.

    Tags end at the first ``>`` outside quotes. After a tag whose quotes leave it open to the end of the
    page, quotes no longer count.
    """
    walk, at, quotes = _Page(), 0, True
    while found := _TAG.search(page, at):
        walk.text(page[at : found.start()])
        at, tag = found.end(), (found[2] or "").lower()
        if not tag:
            stop = "-->" if found[0] == "<!--" else ">"
            end = page.find(stop, at)
            at = end + len(stop) if end >= 0 else len(page)
            continue
        whole = _TO_END.match(page, at) if quotes else None
        quotes = whole is not None
        end = whole.end() if whole else page.find(">", at) + 1
        if not end:
            at = len(page)  # a tag that is cut off is no text
            break
        attributes, at = page[at : end - 1], end
        if found[1]:
            walk.end(tag)
        elif tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else len(page)
        else:
            walk.start(tag, attributes)
    walk.text(page[at:])
    walk.flush()
    return [b for b in walk.blocks if b.zone != DROP]


def first_pass(found: Sequence[Block]) -> list[bool | None]:
    """True for text, False for boilerplate, None where a block alone does not tell."""
    articles = any(b.zone == ARTICLE for b in found)
    labels: list[bool | None] = []
    for b in found:
        prose = b.tag == "p" or b.tag in ("blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "article", "main")
        if b.zone == BAD or articles and b.zone != ARTICLE:
            label: bool | None = False
        elif b.links > LINKS_MOST:
            label = None if prose and b.zone == ARTICLE else False
        elif b.zone == ARTICLE and (prose or b.words >= LONG):
            label = True
        elif b.words < LONG:
            label = False if b.links > LINKS_OPEN or "©" in b.text else None
        elif b.stops >= STOP_HIGH:
            label = True
        else:
            label = False if b.stops < STOP_LOW and b.zone != ARTICLE and not prose else None
        labels.append(label)
    return labels


def second_pass(found: Sequence[Block], labels: list[bool | None]) -> list[bool]:
    """Open blocks take the label of the nearest decided one; of two equally near, text wins.

    Inside an article only blocks of articles count, and where none is decided an open block is text.
    """
    n = len(found)
    before: list[int | None] = [None] * n
    after: list[int | None] = [None] * n
    for nearest, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last: dict[bool, int] = {}
        for k in order:
            inside = found[k].zone == ARTICLE
            if labels[k] is None:
                nearest[k] = last.get(inside)
            else:
                last[inside] = k
    out = []
    for k, label in enumerate(labels):
        if label is None:
            sides = sorted((abs(k - j), not labels[j]) for j in (before[k], after[k]) if j is not None)
            label = not sides[0][1] if sides else True
        out.append(label)
    return out


def main_text(page: str | None) -> str:
    """The blocks of text of a page, joined by empty lines."""
    found = blocks(page or "")
    return "\n\n".join(b.text for b, kept in zip(found, second_pass(found, first_pass(found)), strict=True) if kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page.

    A null or empty page, or one without text, gives an empty text. Pages of any length are read
    whole. Repeated rows give equal rows; extra columns are not read; an empty table gives an empty
    result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(page.as_py()) for page in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], ["page_id", "url", "text"])

    named = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return named.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))


def op12_html_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rows over the whole pages table."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
