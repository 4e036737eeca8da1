"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass looks at each
block alone: made of links, it is bad; long with many stop words, it is good;
with far too few for its length, bad; others are undecided: near-good with
enough stop words, else short. The second pass gives headings the label of the
text they stand over, and undecided blocks the label of their nearest decided
neighbours.

Tags, roles and class names are evidence, weighed against what the first pass
says. A part marked as page furniture (menu, sidebar, advert, form...) is left
out, unless the good blocks of the page lie in such parts only: then the mark
that holds most of their text is not believed. An article mark is believed if
it holds at least half of the good text outside furniture; then blocks outside
are bad, and ambiguous ones inside are good unless their neighbours are bad. A
page without a good block takes what comes nearest: dense shorter blocks, else
long ones without links, else all that are not links.

Pages are independent: the work is a map over rows, without a shuffle.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from loomtext.llm.common import tidied

#: Blocks below SHORT characters are undecided; stop words make a block good from DENSE on; links make it bad above LINKED.
SHORT, LONG, DENSE, SPARSE, LINKED = 70, 200, 0.30, 0.15, 0.5
#: Of furniture inside furniture, marks this deep tell blocks apart; deeper ones add nothing.
NESTED = 16

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    (
        "a an and are as at be been but by for from had has have he her his i if in into is it its not of on one or our she so than that the their them there they this to was we were what when which who will with would you your "
        "aber als am an auch auf aus bei bin bis da das dass dem den der des die du durch ein eine einem einen einer er es für hat ich ihr im in ist ja kann mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wenn wie wir wird zu zum zur "
        "au aux avec c ce ces cette d dans de des du elle en est et eux il ils j je l la le les leur lui m ma mais me mes n ne nos notre nous on ou où par pas pour qu que qui s sa se ses son sur ta te tu un une vos votre vous "
        "al algo como con cuando de del desde donde el ella ellos en entre era es esta este esto fue ha hay la las le les lo los más me mi muy no nos o para pero por porque que se ser si sin sobre son su sus también te tiene todo un una uno y ya"
    ).split()
)

BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that may hold a part of a page; only these are kept on the stack.
HOLDER = frozenset("article aside body blockquote button center details dialog dir div dl fieldset figure footer form header html main menu nav ol section span table td ul".split())
#: Elements whose content is not part of the text. Those in PLAIN hold no element of their own name and end at the next end tag.
RAW = frozenset("applet audio canvas datalist head iframe math noframes noscript object script select style svg template textarea title video".split())
PLAIN = frozenset("head iframe noframes script style textarea title".split())
#: Of these what follows is content to the end of the page if they are not closed; of other elements only the tag goes.
OPEN = frozenset("script style".split())
#: Elements, roles and names (words in class or id) of page furniture.
BAD_TAGS = frozenset("aside button dialog footer form menu nav".split())
BAD_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense aside banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright dialog disqus footer form gdpr hidden legal login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion promotions recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
HEAD_NAMES = frozenset("header topbar top".split())
#: A class with one of these words says how a page is laid out, not what the element is: ``has-sidebar``, ``comments-open``.
STATES = frozenset("allowed closed count disabled enabled has hide is no not off on open show with without".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[a-zA-Z/!?][^>]*(?:>|\Z)|[^<]+|<", re.S
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
WORD = re.compile(r"[^\W\d_]+")
RAW_END = {t: re.compile(rf"</{t}(?![^\s/>])[^>]*>", re.I) for t in PLAIN}
RAW_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)({'|'.join(sorted(RAW))})(?![^\s/>])((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)


def furniture(tag: str, attributes: str, in_article: bool) -> bool:
    """Is this element marked as page furniture?"""
    if tag in BAD_TAGS or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body", "article", "main") and "omment" not in attributes:
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value.lower() in BAD_ROLES:
            return True
        if name in ("class", "id"):
            for one in value.split():
                words = {w.lower() for w in NAME.findall(one)}
                if not words & STATES and (words & BAD_NAMES or not in_article and words & HEAD_NAMES):
                    return True
    return False


def raw_ends(page: str) -> dict[int, int]:
    """Where raw elements end, by where their first tag ends. One that no end tag is left for is missing."""
    out: dict[int, int] = {}
    waiting: dict[str, list[int]] = {}
    unclosed: set[str] = set()
    at = 0
    while m := RAW_TAG.search(page, at):
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if waiting.get(tag):
                out[waiting[tag].pop()] = at
        elif m[3].endswith("/") or tag in unclosed:
            continue
        elif tag not in PLAIN:
            waiting.setdefault(tag, []).append(at)
        elif end := RAW_END[tag].search(page, at):
            out[at] = at = end.end()
        elif tag in OPEN:
            out[at] = at = len(page)
        else:
            unclosed.add(tag)
    return out


class Block(NamedTuple):
    text: str
    linked: int  # characters in links
    marks: tuple[int, ...]  # numbers of the furniture elements around it, from the outermost
    article: bool
    heading: bool


def blocks(page: str) -> list[Block]:
    """The blocks in page order. Time follows the length of the page, however its tags are nested."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[int, ...], bool]] = []
    held: Counter[str] = Counter()
    parts: list[str] = []
    linked, links, marks, article, heading, marked = 0, 0, (), False, False, 0
    ends: dict[int, int] | None = None

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, linked, marks, article, heading))
            parts.clear()
        linked = 0

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if page[m.start()] != "<":
                parts.append(m[0])
                if links:
                    linked += len(html.unescape(m[0]).strip())
            elif m[0] == "<":
                parts.append("<")
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCK:
                close()
                heading = False
            if tag == "a":
                links = max(0, links - 1)
            elif held[tag]:
                while True:
                    last = stack.pop()[0]
                    held[last] -= 1
                    if last == tag:
                        break
                marks, article = stack[-1][1:] if stack else ((), False)
            continue
        if tag in RAW:
            if tag in BLOCK:
                close()
            if not m[3].endswith("/"):
                if ends is None:
                    ends = raw_ends(page)
                at = ends.get(at, at)
            continue
        if tag in BLOCK:
            close()
            links, heading = 0, tag in HEADINGS or heading and tag == "br"
        if tag == "a":
            links = 1
        elif tag in HOLDER and not m[3].endswith("/"):
            bad = furniture(tag, m[3], article)
            if bad or tag in ("article", "main"):
                close()
            if bad and len(marks) < NESTED:
                marked += 1
                marks = (*marks, marked)
            article = article or tag in ("article", "main") and not bad
            held[tag] += 1
            stack.append((tag, marks, article))
    close()
    return out


GOOD, NEAR, SHORTER, BAD, LINKS = "good", "near-good", "short", "bad", "links"


def first_pass(block: Block) -> str:
    """The label of a block looked at alone.

    A share of stop words says little of a few words: bad are blocks whose
    number of stop words is below SPARSE by two standard deviations and more.
    """
    if block.linked > LINKED * len(block.text):
        return LINKS
    if len(block.text) < SHORT:
        return SHORTER
    words = WORD.findall(block.text.lower())
    n, hits = len(words), sum(w in STOP_WORDS for w in words)
    if hits >= DENSE * n and hits:
        return GOOD if len(block.text) > LONG else NEAR
    return BAD if hits < SPARSE * n - 2 * math.sqrt(SPARSE * (1 - SPARSE) * n) else SHORTER if hits < SPARSE * n else NEAR


def disbelieved(found: list[Block], labels: list[str]) -> set[int]:
    """Marks of furniture that hold all good text of the page, and so are not believed: as long as none is free of marks, the mark with most of it."""
    out: set[int] = set()
    good = [b for b, label in zip(found, labels, strict=True) if label == GOOD]
    while good and all(set(b.marks) - out for b in good):
        held: Counter[int] = Counter()
        for b in good:
            held.update({m: len(b.text) for m in b.marks if m not in out})
        most = max(held.values())
        out.add(min(m for m, n in held.items() if n == most))
    return out


def classify(found: list[Block]) -> list[bool]:
    """Which blocks are main text."""
    labels = [first_pass(b) for b in found]
    trusted = disbelieved(found, labels)
    foreign = [bool(set(b.marks) - trusted) for b in found]
    good = [(b.article, len(b.text)) for b, label, out in zip(found, labels, foreign, strict=True) if label == GOOD and not out]
    marked = any(b.article and not out for b, out in zip(found, foreign, strict=True)) and 2 * sum(n for article, n in good if article) >= sum(n for _, n in good)
    if marked:
        foreign = [out or not b.article for b, out in zip(found, foreign, strict=True)]
    if not marked:
        labels = own_style(found, labels, foreign)
    decides = {GOOD: True, LINKS: False} | ({NEAR: True} if marked else {BAD: False})
    decided = [False if out else decides.get(label) for label, out in zip(labels, foreign, strict=True)]
    if True not in decided:
        plain = [i for i, out in enumerate(foreign) if not out and labels[i] != LINKS]
        for best in ([i for i in plain if labels[i] == NEAR], [i for i in plain if len(found[i].text) >= SHORT], plain):
            if best:
                for i in best:
                    decided[i] = True
                break
    return second_pass(found, decided, foreign, marked)


def own_style(found: list[Block], labels: list[str], foreign: list[bool]) -> list[str]:
    """Labels by the page's own density. Few stop words say nothing against a block where most of the text that is neither furniture nor links has few, or none of it is good."""
    own = [(label, len(b.text)) for b, label, out in zip(found, labels, foreign, strict=True) if not out and label != LINKS]
    if any(label == GOOD for label, _ in own) and 2 * sum(n for label, n in own if label == BAD) <= sum(n for _, n in own):
        return labels
    return [NEAR if label == BAD and not out else label for label, out in zip(labels, foreign, strict=True)]


def second_pass(found: list[Block], decided: list[bool | None], foreign: list[bool], marked: bool) -> list[bool]:
    """Undecided blocks (None) take the label of their nearest decided neighbours. Furniture says nothing of the blocks around it."""
    out = list(decided)
    after = None  # a short heading goes with what comes after it; in a marked article, where that is no text
    for i in range(len(found) - 1, -1, -1):
        if out[i] is None and found[i].heading and len(found[i].text) < SHORT and after is not None and not (marked and after):
            out[i] = after
        elif not foreign[i] and (decided[i] is not None or marked):
            after = decided[i] is not False
    before, behind = neighbours(out, foreign, None if marked else False), neighbours(out[::-1], foreign[::-1], None)[::-1]
    for i, label in enumerate(out):
        if label is None:
            near = {before[i], behind[i]} - {None}
            if marked:
                out[i] = True in near or not near
            else:  # between good and bad, short blocks are bad and longer ones good
                out[i] = near == {True} or True in near and len(found[i].text) >= SHORT
    return out


def neighbours(labels: list[bool | None], foreign: list[bool], first: bool | None) -> list[bool | None]:
    """For each block the label of the last decided one before it; ``first`` where there is none."""
    out, last = [], first
    for label, skip in zip(labels, foreign, strict=True):
        out.append(last)
        if label is not None and not skip:
            last = label
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return " ".join(b.text for b, good in zip(found, classify(found), strict=True) if good)


def extract(pages: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` with ``text`` and ``n_chars``, one row per row.

    Null and empty pages give an empty text. Blocks are joined in page order by
    one space; white space inside a block is one space. Nothing is cut off,
    however long the page. Repeated rows stay. Kept columns named ``text`` or
    ``n_chars`` are replaced; other columns are not read.
    """
    keep = tuple(c for c in keep if c not in ("text", "n_chars"))
    rows = pages.select(*[pages[f"`{c}`"].alias(c) for c in keep], pages[f"`{page}`"].alias("__page"))
    schema = StructType([rows.schema[c] for c in keep] + [StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column("__page").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"]
            )

    return rows.mapInArrow(tidied(run), schema)
