"""Main-text extraction from HTML by two-pass block rules.

Pass 1 cuts a page into blocks at block-level tags and decides those it can: blocks in menus, headers, footers,
sidebars, notices, adverts, forms or reader comments are dropped, and so are blocks that consist mostly of links;
long blocks with enough stop words are kept. Short blocks, and blocks inside an ``article`` or ``main`` that the
densities say nothing clear about, stay ambiguous.
Pass 2 gives each ambiguous block the label of its nearest decided neighbours: both agree, or the nearer wins,
with a kept neighbour winning a tie. Inside an ``article`` or ``main`` only blocks of that same element are
neighbours, and where none of them is decided the block is kept, since the element itself marks the main text.

Character references are decoded, white space inside a block becomes one space, and the kept blocks are joined in
page order by one space. Nothing is capped.

Defined results: null and empty html give an empty text; markup that is cut off or nested wrongly is read as far as
it goes (an open comment or script ends with the page); rows that repeat a page_id are extracted one by one.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.batches import slices

# Frequent function words of the languages at hand.
STOP_WORDS = frozenset(
    """
    a an and are as at be by for from had has have he her his i in is it its not of on or she that the their they this to
    was we were which with you
    aber als an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in ist
    mit nach nicht noch sich sie sind und von war wie wird zu zum zur über
    au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais ne nous on ou par pas pour
    qu que qui sa se ses son sont sur un une vous
    al con como de del el ella en es esta este ha la las lo los más no o para pero por que se sin sobre su sus un una y ya
    """.split()
)
# Elements whose text is never part of the main text.
DROPPED_TAGS = frozenset(
    "head title script style noscript template svg iframe object canvas nav header footer aside form button select"
    " textarea menu dialog".split()
)
RAW_TAGS = frozenset("script style textarea title noscript iframe template svg".split())
MAIN_TAGS = frozenset(("article", "main"))
# Words in class, id or role attributes that name such parts.
DROPPED_NAMES = frozenset(
    """
    ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer
    header menu modal nav navbar navigation newsletter notice pagination popup promo promoted related share sharing sidebar
    social sponsor sponsored subscribe toolbar complementary contentinfo
    """.split()
)
#: Words that leave the meaning of a compound name to its other words; the names above are among them.
PLAIN_NAMES = DROPPED_NAMES | frozenset(
    """
    a area back bar block bottom box bread button buttons center container content crumbs cta desktop floating form global
    group html inner item items left level line link links list main media message mobile module nav network networks of
    outer overlay page panel placeholder policy post posts primary region right row secondary section side signup site
    slot small sticky sub tags text the thread title to tool top unit widget widgets wrap wrapper your
    """.split()
)
INLINE_TAGS = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike"
    " strong sub sup time tt u var wbr".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())

LONG_CHARS = 60
MIN_STOP_DENSITY = 0.12
MAX_LINK_DENSITY = 0.5

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.DOTALL,
)
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
_NAME = re.compile(r"[a-z]+")
_LETTERS = re.compile(r"[^\W\d_]+")


class Block:
    """Text of one block, how much of it is links, and where it stands."""

    __slots__ = ("dropped", "linked", "main", "pieces")

    def __init__(self, dropped: bool, main: int) -> None:
        self.pieces: list[str] = []
        self.linked = 0
        self.dropped = dropped
        self.main = main


def _marks_dropped(tag: str, attributes: str) -> bool:
    if tag in DROPPED_TAGS:
        return True
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False
    if tag not in ("html", "body", "main"):
        for m in _NAMED.finditer(attributes):
            for name in (m[1] or m[2] or m[3] or "").lower().split():
                words = _NAME.findall(name)
                # A compound counts if all of it names such a part; an article only by a name of its own.
                if not DROPPED_NAMES.isdisjoint(words) and (len(words) == 1 or tag not in MAIN_TAGS and PLAIN_NAMES.issuperset(words)):
                    return True
    return bool(_HIDDEN.search(attributes))


def blocks(page: str) -> list[tuple[str, int, bool, int]]:
    """(text, characters in links, dropped, number of the article or main around it or 0) of each block with text."""
    found: list[Block] = []
    # Each open element: its tag, whether it or one around it is dropped, its main element, whether it is a link.
    stack: list[tuple[str, bool, int, bool]] = [("", False, 0, False)]
    mains = at = 0
    block = Block(False, 0)

    def text(until: int) -> None:
        nonlocal block
        if until > at:
            _, dropped, main, linked = stack[-1]
            if (dropped, main) != (block.dropped, block.main):
                found.append(block)
                block = Block(dropped, main)
            piece = html.unescape(page[at:until])
            block.pieces.append(piece)
            if linked:
                block.linked += len("".join(piece.split()))

    def close() -> None:
        nonlocal block
        found.append(block)
        block = Block(stack[-1][1], stack[-1][2])

    n = len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            text(n)
            break
        text(m.start())
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = (m[1] or m[4]), (m[3] or m[6] or "")
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        elif tag in VOID_TAGS:
            if tag == "br":
                block.pieces.append(" ")
        elif tag in RAW_TAGS:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = end.end() if end else n
        elif not attributes.rstrip().endswith("/") or tag not in ("a", "div", "span", "p"):
            if tag in SELF_CLOSING:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                    if stack[k][0] not in INLINE_TAGS:
                        break
            _, dropped, main, linked = stack[-1]
            if tag in MAIN_TAGS and not main:
                mains += 1
                main = mains
            stack.append((tag, dropped or _marks_dropped(tag, attributes), main, linked or tag == "a"))
        if tag not in INLINE_TAGS and tag != "br":
            close()
    found.append(block)
    out = []
    for b in found:
        joined = " ".join("".join(b.pieces).split())
        if joined:
            out.append((joined, b.linked, b.dropped, b.main))
    return out


def stop_density(text: str) -> float:
    found = _LETTERS.findall(text.lower())
    return sum(w in STOP_WORDS for w in found) / len(found) if found else 0.0


def first_pass(text: str, linked: int, dropped: bool, main: int) -> bool | None:
    """True: kept, False: dropped, None: ambiguous."""
    if dropped or linked > MAX_LINK_DENSITY * len(text.replace(" ", "")):
        return False
    if len(text) >= LONG_CHARS and stop_density(text) >= MIN_STOP_DENSITY:
        return True
    if len(text) >= LONG_CHARS and not main:
        return False
    return None


def second_pass(labels: list[bool | None], mains: list[int]) -> list[bool]:
    """Ambiguous blocks take the label of the nearest decided neighbours that stand in the same main element."""
    n = len(labels)
    before: list[int | None] = [None] * n
    after: list[int | None] = [None] * n
    for ahead, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last: dict[int, int] = {}
        for i in order:
            ahead[i] = last.get(mains[i])
            if labels[i] is not None:
                last[mains[i]] = i
    out = []
    for i, label in enumerate(labels):
        if label is None:
            near = [(abs(i - j), not labels[j]) for j in (before[i], after[i]) if j is not None]
            label = not min(near)[1] if near else bool(mains[i])
        out.append(label)
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    labels = [first_pass(*b) for b in found]
    # A rejected block decides nothing for its neighbours inside an article: an advert or a link amid text is no sign.
    usable = [None if b[3] and label is False else label for b, label in zip(found, labels, strict=True)]
    kept = second_pass(usable, [b[3] for b in found])
    return " ".join(b[0] for b, k, label in zip(found, kept, labels, strict=True) if k and label is not False)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [main_text(page) for page in batch.column(2).to_pylist()]
        sizes = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"]
        )


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points)."""
    return pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string")
    ).mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
