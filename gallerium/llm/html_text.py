"""Main text of web pages by two-pass block rules.

A tolerant scan cuts a page into text blocks. The first pass labels each by length, link density, stop-word density and what
encloses it: good, bad or undecided. The second lets undecided short blocks inherit from their nearest decided neighbours in
the same container, or, where there is none, from the container.
"""

from __future__ import annotations

import html
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

SHORT, LONG = 70, 200  # characters
LINKS_BAD, LINKS_BAD_INSIDE = 0.2, 0.9
STOPS_LOW, STOPS_HIGH = 0.15, 0.25
# Element names, words of class and id attributes, and common function words.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp".split())
HIDDEN = frozenset("head template svg math canvas object audio video map select button datalist".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset("article main".split())
LINK_LISTS = frozenset("li dd dt td option".split())
BAD_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer login menu modal nav navbar navigation newsletter notice pager pagination popup promo promotion recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe teaser toolbar widget".split()
)
# Words that say nothing of their own beside a bad one: a name goes if all its words are of either list, one of them bad.
PLAIN_WORDS = frozenset("area bar block body bottom box btn button buttons center col column container content footer form global group header icons inline inner item items left line link links list main message middle module new outer overlay page panel post posts primary right row secondary section site slot small sticky stories story sub text title top unit widget wrap wrapper".split())
# What an element holds, when a name ends with it or begins with it before a word of arrangement, whatever else the name says;
# words that make a name a phrase or a state instead.
HELD = frozenset("ad ads advert adverts advertisement advertisements breadcrumb breadcrumbs comment comments cookie cookies disqus footer login nav navbar newsletter popup promo replies sidebar signup sponsor sponsors".split())
ARRANGED = frozenset("area box count feed form group inner list section stream thread threads tree wrap wrapper".split())
PHRASE_WORDS = frozenset("a an and as at before after by for from has have in is no non not of off on or the to un with without".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar alert dialog form".split())
STOP_WORDS = frozenset(
    "a about all also an and are as at be been but by can for from had has have he her his if in into is it its may more not of on or she so than that the their there they this to was we were which who will with would you "
    "als am auch auf aus bei bis das dem den der des die durch ein eine einem einen einer es für hat ich im ist mit nach nicht noch nur oder sein sich sie sind über um und von vor war wenn wie wird zu zum zur "
    "au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous ont ou par pas plus pour qu que qui sa se ses son sur un une vous "
    "al como con del el ella entre era es esta este ha hay las lo los más me mi muy no nos o para pero por porque que se ser si sin sobre su sus también te tiene un una y ya".split()
)
_TAG = re.compile(r"<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORD_CUT = re.compile(r"[^a-z]+")
_WORD = re.compile(r"[^\W\d_]+")


class Block:
    __slots__ = ("container", "enclosed", "inside", "links", "name", "text")

    def __init__(self, text: str, links: int, enclosed: bool, inside: bool, container: int, name: str):
        self.text, self.links, self.enclosed, self.inside, self.container, self.name = text, links, enclosed, inside, container, name


def names_bad(value: str) -> bool:
    """Whether one of the names of a class or id attribute says that an element isn't main text. Names are taken whole:
    `ad-box`, `user-comments` and `comment-thread` do, `related-work`, `has-sidebar` and `comment-on-law` don't."""
    for name in value.split():
        words = [w for w in _WORD_CUT.split(name) if w]
        if not words or BAD_WORDS.isdisjoint(words):
            continue
        if all(w in BAD_WORDS or w in PLAIN_WORDS for w in words):
            return True
        if PHRASE_WORDS.isdisjoint(words) and (words[-1] in HELD or any(a in HELD and b in ARRANGED for a, b in zip(words, words[1:]))):
            return True
    return False


def encloses(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element holds what surrounds a page's text. The page's own main container isn't judged by its names."""
    if name in BOILERPLATE or (name == "header" and not inside):
        return True
    if not attributes:
        return False
    named = name not in ("html", "body", "main") and (name != "article" or inside)
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            return True
        if key == "role" and value in BAD_ROLES:
            return True
        if key in ("class", "id") and named and names_bad(value):
            return True
    return False


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order. Comments, declarations, raw and hidden elements have no text; a tag that the page
    ends within is dropped; a less-than sign that starts no tag is text."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, int, int]] = []  # name, hidden, enclosed, main container, open anchors
    block_at: list[int] = []  # where the stack has blocks
    open_names: Counter = Counter()
    parts: list[str] = []
    links = containers = at = 0
    hidden = enclosed = False
    container = anchors = 0

    def flush():
        nonlocal links
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, min(links, len(text)), enclosed, container > 0, container, stack[block_at[-1]][0] if block_at else ""))
        parts.clear()
        links = 0

    def settle():
        nonlocal hidden, enclosed, container, anchors
        _, hidden, enclosed, container, anchors = stack[-1] if stack else ("", False, False, 0, 0)

    def pop_to(k: int):
        if block_at and block_at[-1] >= k:
            flush()
        while block_at and block_at[-1] >= k:
            block_at.pop()
        for x in stack[k:]:
            open_names[x[0]] -= 1
        del stack[k:]
        settle()

    def say(text: str):
        nonlocal links
        if text and not hidden:
            parts.append(text)
            if anchors:
                links += len(" ".join(text.split()))

    n = len(page)
    while at < n:
        cut = page.find("<", at)
        if cut < 0:
            say(page[at:])
            break
        say(page[at:cut])
        mark = page[cut + 1 : cut + 2]
        if page.startswith("<!--", cut):
            end = page.find("-->", cut + 4)
            at = n if end < 0 else end + 3
        elif mark and mark in "!?":
            end = page.find(">", cut)
            at = n if end < 0 else end + 1
        elif mark == "/" and page[cut + 2 : cut + 3].isalpha():
            end = page.find(">", cut)
            name = re.split(r"[\s/>]", page[cut + 2 : n if end < 0 else end], maxsplit=1)[0].lower()
            at = n if end < 0 else end + 1
            if open_names[name]:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                pop_to(k)
            elif name in BLOCKS:
                flush()
        elif mark.isalpha() and mark.isascii():
            found = _TAG.match(page, cut)
            if not found:
                end = page.find(">", cut)
                if end < 0:
                    break
                name, attributes, at = re.split(r"[\s/>]", page[cut + 1 : end], maxsplit=1)[0].lower(), "", end + 1
            else:
                name, attributes, at = found[1].lower(), found[2], found.end()
            if name in RAW:
                if not attributes.endswith("/") or name != "script":
                    close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                    at = close.end() if close else n
                continue
            if name == "body" and hidden:
                pop_to(0)
            if name in BLOCKS:
                if block_at and (stack[block_at[-1]][0] == "p" or (stack[block_at[-1]][0] == name and name in ("li", "td", "th", "tr", "dd", "dt", "option"))):
                    pop_to(block_at[-1])
                flush()
            if name == "br":
                say(" ")
            if name in VOID:
                continue
            inside = container > 0
            if name in MAIN and not inside:
                containers += 1
                own = containers
            else:
                own = container
            if name in BLOCKS:
                block_at.append(len(stack))
            open_names[name] += 1
            stack.append((name, hidden or name in HIDDEN, enclosed or encloses(name, attributes, inside), own, anchors + (name == "a")))
            settle()
        else:
            say("<")
            at = cut + 1
    flush()
    return out


def first_pass(block: Block) -> str:
    """good, bad, short (too short to tell) or near (of middling stop-word density)."""
    length = len(block.text)
    density = block.links / length
    if block.enclosed or (density > LINKS_BAD and not block.inside):
        return "bad"
    if block.inside:  # its sentences may be links altogether; items that are links and nothing else make a menu
        if length < SHORT:
            return "bad" if density > LINKS_BAD_INSIDE and block.name in LINK_LISTS else "short"
        return "good" if length > LONG and _dense(block, STOPS_HIGH) else "near"
    if "©" in block.text and length <= LONG:  # a line of rights; a long text may speak of them
        return "bad"
    if length < SHORT:
        return "bad" if block.links else "short"
    if _dense(block, STOPS_HIGH):
        return "good" if length > LONG else "near"
    return "near" if _dense(block, STOPS_LOW) else "bad"


def _dense(block: Block, least: float) -> bool:
    """Whether function words make up this share of a block's words."""
    words = _WORD.findall(block.text.lower())
    return sum(w in STOP_WORDS for w in words) >= least * max(1, len(words))


def classify(blocks: list[Block]) -> list[bool]:
    """Which blocks are main text."""
    labels = [first_pass(b) for b in blocks]
    n = len(blocks)

    def nearest(decided):
        """The label of the nearest decided block of the same container before and after each block; what stands in a
        menu, footer or the like says nothing about its neighbours."""
        before, after = [None] * n, [None] * n
        last: dict[int, str] = {}
        for i in range(n):
            before[i] = last.get(blocks[i].container)
            if labels[i] in decided and not blocks[i].enclosed:
                last[blocks[i].container] = labels[i]
        last = {}
        for i in range(n - 1, -1, -1):
            after[i] = last.get(blocks[i].container)
            if labels[i] in decided and not blocks[i].enclosed:
                last[blocks[i].container] = labels[i]
        return before, after

    for kind, decided in (("short", ("good", "bad", "near")), ("near", ("good", "bad"))):
        before, after = nearest(decided)
        new = list(labels)
        for i, block in enumerate(blocks):
            if labels[i] != kind:
                continue
            around = {x for x in (before[i], after[i]) if x}
            if block.inside:
                new[i] = "bad" if around == {"bad"} and kind == "short" and block.name in LINK_LISTS and block.links else "good"
            elif around == {"bad"} or not around:
                new[i] = "bad" if around else kind if kind == "short" else "good"
            elif kind == "short" and "near" in around and "good" not in around:
                new[i] = "near"
            else:
                new[i] = "good" if around == {"good"} or kind == "near" else "bad"
        labels = new
    if "good" not in labels:  # a page of nothing but short blocks
        return [label in ("near", "short") for label in labels]
    return [label == "good" for label in labels]


def main_text(page: str | None) -> str:
    """The main text; blocks are joined by a space. Null, empty and text-free pages give an empty string."""
    if not page:
        return ""
    blocks = blocks_of(page)
    return " ".join(b.text for b, good in zip(blocks, classify(blocks)) if good)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of `pages` (page_id, url, html); other columns are left out. Null, empty and
    text-free pages have an empty text; rows that repeat are read each."""

    def make():
        def step(batch):
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

        return step

    return arrow_map(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), "page_id long, url string, text string, n_chars long", make)
