"""Main text of HTML pages: flat text blocks classified by a decision tree."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palindra.llm.common import pieces, read, small_batches

#: A block ends where one of these begins or ends.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Their content is not text of the page.
SKIPPED = frozenset("script style title noscript template svg annotation annotation-xml iframe object textarea select button".split())
#: What is in them is no markup, so one that is never closed takes the rest of the page.
RAW = frozenset("script style title textarea".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements around a page's article, and words of class, id or role that say so.
OUTER_TAGS = frozenset(("nav", "footer", "aside", "form", "menu", "dialog"))
OUTER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement banner sponsor sponsored promo nav navigation navbar menu breadcrumb breadcrumbs sidebar "
    "widget footer masthead cookie cookies consent notice alert popup modal newsletter subscribe subscription signup login search share "
    "sharing social related recommended toolbar pagination pager copyright legal disclaimer contentinfo complementary".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus discussion reader readers".split())
ARTICLE_WORDS = frozenset("article post content entry story main maincontent".split())
#: Words that say nothing beside those above. A name is that of a box around an article only if all its words are of these lists.
PLAIN_WORDS = frozenset(
    "site page main box block section area wrap wrapper container inner outer top bottom left right list item items link links bar row column "
    "group panel holder slot zone global primary secondary post posts article articles content body text title head header icon icons form "
    "small large wide mobile desktop sticky fixed inline more blog web".split()
)
#: Elements of text: within an article their names say how it looks.
TEXT_TAGS = HEADINGS | frozenset("p li dt dd td th tr blockquote pre figcaption caption span a b i em strong small mark q cite code".split())
#: Words that make a name tell of a state of the page ("has-sidebar", "share-on"), not of what the element is.
STATE_WORDS = frozenset("has have with without no not is are on off ok open closed enabled disabled active ready loaded".split())
#: An element named as outer that holds this share of the page's unlinked words and its headline or article is none.
MOST = 0.6

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_ATTRS = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|))*+>""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PARTS = re.compile(r"[^a-z0-9]+")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_KEEP = re.compile(r"\bdata-keep\b")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    framed: bool
    named: bool
    article: bool
    heading: bool
    item: bool
    keep: bool
    #: Of the nearest box named as outer: its share of the unlinked words of the article or page, and of its words that are linked.
    share: float = 1.0
    boxed: float = 0.0
    links: int = 0


@lru_cache(maxsize=4096)
def _kind(tag: str, attrs: str) -> tuple[bool, bool, bool]:
    """(named as outer or as comments, article, labelled) of an element. Names of the page as a whole say nothing."""
    outer = article = False
    if attrs and tag not in ("html", "body"):
        for m in _NAMES.finditer(attrs):
            for name in "".join(x or "" for x in m.groups()).split():
                parts = set(_PARTS.split(_HUMP.sub("-", name).lower()))
                if not parts & STATE_WORDS:
                    around = parts - {""} and parts & (OUTER_WORDS | COMMENT_WORDS) and parts - {""} <= OUTER_WORDS | COMMENT_WORDS | PLAIN_WORDS
                    outer = outer or bool(around) or name.lower() == "side"
                    article = article or (bool(parts & ARTICLE_WORDS) and not around)
    return outer, tag in ("article", "main") or (article and not outer), bool(_KEEP.search(attrs))


@dataclass(slots=True)
class _Open:
    """An open element and what its content inherits: the nearest element named as outer, and flags."""

    tag: str
    named: int = -1
    framed: bool = False
    article: bool = False
    keep: bool = False
    item: bool = False
    #: Elements from a heading down to here; 3 stands for all beyond.
    heading: int = 3


class _Parser:
    def __init__(self):
        self.found: list[tuple[str, int, int, int, _Open]] = []
        self.stack = [_Open("")]
        self.open_: Counter[str] = Counter()
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.at: _Open | None = None
        self.links = 0
        #: Of each element named as outer: the one around it, and whether it holds a headline or an article.
        self.around: list[int] = []
        self.holds: list[bool] = []

    def flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                self.found.append((text, len(text.split()), len(html.unescape("".join(self.linked)).split()), self.links, self.at))
        self.links = 0
        self.parts.clear()
        self.linked.clear()
        self.at = None

    def add(self, text: str) -> None:
        if self.at is None and text.strip():
            self.at = self.stack[-1]
        self.parts.append(text)
        if self.open_["a"]:
            self.linked.append(text)
        elif self.linked and self.linked[-1] != " ":
            self.linked.append(" ")

    def pop(self, k: int) -> None:
        """Closes the elements from place ``k`` of the stack on."""
        for x in self.stack[k:]:
            self.open_[x.tag] -= 1
        del self.stack[k:]

    def close(self, tag: str) -> None:
        if self.open_[tag]:
            k = len(self.stack) - 1
            while self.stack[k].tag != tag:
                k -= 1
            self.pop(k)

    def open(self, tag: str, attrs: str) -> None:
        inside = {"p": None, "li": ("ul", "ol", "menu"), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",), "dt": ("dl",), "dd": ("dl",), "option": ()}
        if tag in inside and self.open_[tag]:
            # an open paragraph or item ends where the next begins, with the inline tags left open in it
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag == tag:
                    self.pop(k)
                    break
                if self.stack[k].tag in (BLOCK_TAGS if tag == "p" else inside[tag]):
                    break
        outer, article, keep = _kind(tag, attrs)
        above = self.stack[-1]
        outer = outer and not (above.article and tag in TEXT_TAGS)
        named, framed = above.named, above.framed or tag in OUTER_TAGS or (tag == "header" and not above.article)
        if tag in ("h1", "article", "main") and named >= 0:
            self.holds[named] = True
        if outer:
            self.around.append(named)
            self.holds.append(False)
            named = len(self.around) - 1
        elif tag in ("article", "main"):  # an article inside a box left open is the article
            named, framed = -1, False
        self.stack.append(_Open(tag, named, framed, article or above.article, keep or above.keep, tag == "li" or above.item, 0 if tag in HEADINGS else min(3, above.heading + 1)))
        self.open_[tag] += 1
        self.links += tag == "a"

    def blocks(self) -> list[Block]:
        own, all_ = [0] * len(self.around), [0] * len(self.around)
        total = article = 0
        for _, words, linked, _, at in self.found:
            total += words - linked
            article += (words - linked) * at.article
            if at.named >= 0:
                own[at.named] += words - linked
                all_[at.named] += words
        for k in range(len(own) - 1, -1, -1):
            if self.around[k] >= 0:
                own[self.around[k]] += own[k]
                all_[self.around[k]] += all_[k]
                self.holds[self.around[k]] |= self.holds[k]
        live: list[bool] = []
        for k, around in enumerate(self.around):
            live.append(not (self.holds[k] and own[k] >= MOST * total) or (around >= 0 and live[around]))
        out = []
        for text, words, linked, links, at in self.found:
            k, named = at.named, at.named >= 0 and live[at.named]
            share, boxed = (own[k] / max(1, article if at.article else total), 1 - own[k] / max(1, all_[k])) if named else (1.0, 0.0)
            out.append(Block(text, words, linked, at.framed, named, at.article, at.heading < 3, at.item, at.keep, share, boxed, links))
        return out


def blocks(page: str) -> list[Block]:
    """The text blocks of ``page`` in order: maximal runs of text between block-level tags.

    References are decoded, white space runs become one space, empty blocks go. Broken markup is
    read as browsers would in the main: an end tag closes up to its start tag, or nothing; what
    begins like a tag and never ends is text. The time grows with the page, however broken it is.
    """
    p, at, low = _Parser(), 0, None
    end, last, plain = len(page), page.rfind(">"), False
    missing: set[str] = set()
    while at < end:
        less = page.find("<", at, last + 1)
        if less < 0:
            p.add(page[at:])
            break
        if less > at:
            p.add(page[at:less])
        if page.startswith("<!--", less):
            to = page.find("-->", less + 4)
            at = to + 3 if to >= 0 else end
            continue
        name = _NAME.match(page, less + 1)
        if name is None:
            if page[less + 1] in "!?":
                at = page.find(">", less) + 1
            else:
                p.add("<")
                at = less + 1
            continue
        rest = None if plain else _ATTRS.match(page, name.end())
        if rest is None:  # a value that is never closed: from here on quotes are as any other character
            plain, at = True, page.find(">", name.end()) + 1
        else:
            at = rest.end()
        attrs, closing = page[name.end() : at - 1], name[0][0] == "/"
        tag = name[0].lstrip("/").lower()
        if tag in BLOCK_TAGS:
            p.flush()
        elif tag == "br":
            p.add(" ")
        if closing:
            p.close(tag)
        elif tag in SKIPPED:
            if attrs.endswith("/") and tag in ("svg", "math"):
                continue
            low = (page.lower() if len(page.lower()) == end else page) if low is None else low
            to = low.find(f"</{tag}", at) if tag not in missing else -1
            gt = page.find(">", to) if to >= 0 else -1
            if gt >= 0:
                at = gt + 1
            else:  # without an end, only what is no markup inside takes the rest of the page
                missing.add(tag)
                at = end if tag in RAW else at
            p.add(" ")
        elif tag not in VOID and not attrs.endswith("/"):
            p.open(tag, attrs)
    p.flush()
    return p.blocks()


FEATURES = ("words", "density", "words before", "density before", "words after", "density after", "framed", "named", "article", "heading", "item", "box share", "box density", "page share", "links")


def features(found: list[Block]) -> np.ndarray:
    """Words and link density of each block and its neighbours (``FEATURES``), and what it stands in."""
    n = len(found)
    words = np.array([0, *(b.words for b in found), 0], float)
    density = np.array([0, *(b.linked / b.words for b in found), 0], float)
    flags = np.array([(b.framed, b.named, b.article, b.heading, b.item, b.share, b.boxed) for b in found], float).reshape(n, 7)
    plain = words[1:-1] * (1 - density[1:-1])
    return np.column_stack([words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:], flags, plain / max(1.0, plain.sum()), [b.links for b in found]])


#: The labelled table: small pages in which data-keep marks the blocks of the main text.
LABELLED = (
    """<header><h1>Site of the day</h1><a href=/>Home</a></header><nav><ul><li><a>News</a><li><a>Sport</a><li><a>About us</a></ul></nav>
    <div class="cookie-notice">We use cookies to improve this site. Accept them all or choose which ones you allow us to keep here.</div>
    <article data-keep><h1>A long walk</h1><p>The road begins at the old mill and follows the river for a good six miles or more.</p><p>Yes.</p>
    <p>At the bridge it turns north, <a>past the inn</a>, and climbs through fields of barley to the village on the hill.</p><ul><li>Boots</li><li>A map</li></ul></article>
    <aside><h2>Related</h2><p>Ten more walks that our readers liked best this spring and summer, with maps.</p></aside>
    <section class=comments><h3>Comments</h3><p>I walked this last year and the bridge was closed, so I had to turn back after all.</p><p>Nice!</p></section>
    <footer>&copy; Site <a>Terms</a> <a>Privacy</a></footer>""",
    """<div class="ad">Buy one, get one free on all shoes until Sunday at the shop near you.</div><div id=menu><a>Start</a> <a>Shop</a> <a>Contact</a></div>
    <div class="post-content" data-keep><h2>Bread</h2><p>Mix flour and water, add salt, and let the dough rest overnight in a cool place under a cloth.</p><p>Bake.</p>
    <blockquote>The crust should sing when it leaves the oven, as my grandmother always told us.</blockquote></div>
    <form><label>Email</label> Sign up for the weekly letter and never miss a recipe again from our kitchen.</form><div class="footer">All rights reserved.</div>""",
    """<body><ul><li><a>One</a></li><li><a>Two</a></li><li><a>Three and more</a></li></ul><p data-keep>Nobody had expected the harbour to freeze before the end of November that year, least of all the pilots.</p>
    <p data-keep>It did.</p><p data-keep>By the third day boys were skating between the ships, and the price of coal had doubled in the town.</p><p><a>Next</a> <a>Previous</a></p><div>Contact</div>""",
    """<table><tr><td><a>Index</a></td><td><a>Archive</a></td></tr></table><div data-keep>In the second part of the report the committee turns to the cost of the works, which it puts far above the estimate.</div>
    <div data-keep>Three members dissented from this view and wrote their own conclusion in an annex that was never printed.</div><div><a>Print this page</a> | <a>Send it to a friend</a></div><div>Copyright</div>""",
    """<main data-keep><h1>Minutes</h1><p>Approved.</p><p>Item one.</p><ol><li>The roof is to be mended before winter and the bill sent to the owner.</li><li>None.</li></ol><p><a>See the full list of all decisions of the council</a></p></main>
    <div class="sidebar"><p>The council meets on the first Monday of each month in the town hall, and all are welcome to attend.</p><p>Hours</p></div>""",
    """<article data-keep><p>Short.</p></article><footer><p>Published by the press office of the society, which is responsible for what it holds and for nothing else.</p></footer>""",
    """<article data-keep><h1>Notes</h1><p>A single long paragraph can be all that there is to an article, and it has to be kept whole.</p></article>
    <div class="related"><ul><li><a>Other notes on the same matter</a></li><li><a>More</a></li></ul></div><div class="share">Share this on every network you know and tell all of your friends about it today</div>""",
    """<div class="banner"><p>Sale!</p></div><div>Home</div><div><a>A</a> <a>B</a> <a>C</a></div><p data-keep>When the letter came she read it twice, folded it and put it under the clock without a word to anyone.</p><h2 data-keep>Two</h2>
    <p data-keep>Weeks passed before he asked about it, and by then the answer no longer mattered to either of them.</p><p><a>Read</a></p><p>12</p>""",
    """<article><h1 data-keep>Tides</h1><p data-keep>The moon draws the sea after it twice a day, and the shape of the coast does the rest of the work.</p>
    <div class="advert"><p>Holidays by the sea from forty a night, with breakfast, for all who book before the end of May.</p></div><p data-keep>So.</p>
    <aside><p>See also</p></aside><p data-keep>In a narrow bay the water may rise by the height of a house within a few hours, and fall as fast.</p>
    <div class="newsletter">Get our letter</div><section class="comments"><p>Great piece, thank you, I have shown it to my whole class and they want more of this kind.</p><p>First!</p></section></article><footer><p>Society</p></footer>""",
    """<div class="page"><div class="top">Town news</div><div class="entry" data-keep><p>On Friday the clock of the town hall stopped at ten past four and has not moved since then.</p><p>Why?</p></div>
    <div class="respond"><p>You must log in to post a comment here, which is free and takes less than a minute of your time.</p></div><div>Home</div><div>Top</div></div>""",
    """<div><a>Front page</a></div><div><a>Letters</a></div><h1 data-keep>Bees</h1><p data-keep>A hive in winter is never silent, and whoever puts an ear to the wood hears a steady hum from within.</p>
    <p data-keep>They eat what they stored in summer, and turn so that each has a time in the middle of the cluster.</p><p data-keep>Then spring.</p>
    <p data-keep>With the first crocus they fly out, and the keeper can count at last how many of them have lived.</p><div><a>Older</a></div><div><a>Newer</a></div><div>Made with care</div><div>Version 3</div>""",
    """<nav><a>Home</a></nav><article data-keep><h1>Rain</h1><p>It rained for nine days without a pause, and on the tenth the cellar door floated up the steps.</p><p>The end.</p></article>""",
    """<article data-keep><p>A page may hold nothing but its article, with no frame around it at all, and end on a short line.</p><p>Like so.</p></article>""",
    """<p data-keep>Some pages are bare: a paragraph or two of plain text without any element that says what they are.</p>
    <p data-keep>They are kept as they stand, because nothing in them looks like the frame of a site to anyone.</p>""",
    """<article data-keep><p>Yes.</p></article>""",
    """<body class="has-sidebar comments-open"><div class="content-with-sidebar" data-keep><h1>Salt</h1><p>Salt was dug from the hill for two thousand years before anyone thought to write down how.</p><p>It still is.</p></div>
    <div class="sidebar"><p>Our shop sells salt from the hill in bags of one and five pounds, and ships it anywhere.</p></div></body>""",
    """<div class="layout sidebar-left"><h1 data-keep>Ferries</h1><p data-keep>The last ferry left at nine, and whoever missed it slept in the waiting room until the first one in the morning.</p><p data-keep>There were benches.</p>
    <p data-keep>In summer the crossing took forty minutes, in winter twice that, and in a fog it was not tried at all.</p></div><div class="notice">This site will be closed for repairs on Sunday night from ten until about four in the morning.</div>""",
    """<html class="no-js cookie-ok"><article class="post share-on" data-keep><h2>Owls</h2><p>Owls turn their heads because they cannot turn their eyes, which are fixed in long tubes of bone.</p><p>They hear well.</p></article>
    <ul class="share"><li>Send</li><li>Print</li></ul><div class="widget"><p>Subscribe to our bird calendar and get a picture of another owl on every day of the year.</p></div>""",
    """<div id="page-search-off"><div class="siteNav"><a>All</a> <a>New</a></div><p data-keep>A window that faces north has the same light all day, which is why painters have always asked for one.</p>
    <p data-keep>Few get it.</p><p data-keep>Those who rent a room to the south hang a sheet before the glass and work behind it until evening.</p><div class="relatedPosts"><p>How to stretch a canvas without help in a small room, and nine more tips</p></div></div>""",
    # link lists and linked lines within articles: what stands beside them tells
    """<article><h1 data-keep>Slates</h1><p data-keep>A slate roof lasts for a hundred years if the nails do, which is why copper is used by those who can pay.</p>
    <ul><li><a>Ten ways to mend a roof</a></li><li><a>What slate costs today</a></li><li><a>Our guide to gutters</a></li></ul><p data-keep>Iron rusts.</p>
    <p data-keep>When the nails go the slates slide one by one, most of them in the first storm of the autumn.</p></article><footer>Roofs</footer>""",
    """<article><h2 data-keep>Sources</h2><p data-keep><a>The full report of the inquiry is kept in the county archive</a></p><p data-keep>It has four hundred pages, and the map that came with it was lost in the flood of the cellar.</p>
    <ul data-keep><li>Letters from <a>the clerk</a> to his brother</li><li>Bills of the <a>masons</a> and carters</li></ul><p data-keep>More may turn up.</p><div><a>Back</a> <a>Up</a> <a>Next</a></div></article>""",
    """<main><p data-keep>Sugar boils at a heat that depends on how much water is left in it, and cooks tell it by the way a drop falls.</p><div><a>Caramel</a></div><div><a>Toffee at home</a></div><div><a>Candied peel</a></div>
    <p data-keep>Too dark.</p><p data-keep><a>A table of the stages is in the first chapter of this book</a></p><p data-keep>Below that a thermometer is of more use than the oldest spoon in the drawer.</p></main>""",
    """<article><p data-keep>The ferry was built in the yard above the bridge and launched on the highest tide of the year.</p><p><a>Photos</a> <a>Video</a> <a>Plans</a> <a>Crew</a></p><p><a>More ships from this yard</a> <a>All yards</a></p>
    <p data-keep>She ran for sixty years without a day lost, apart from the winter when the river itself stood still.</p></article>""",
    # boxes in articles: small ones go, one that holds much of the text is part of it
    """<article><h1 data-keep>Wells</h1><p data-keep>Before a well is dug somebody walks the field with a forked stick, and the neighbours stand by the wall to watch.</p><div class="notice"><p>Our office is closed today.</p></div>
    <p data-keep>Nobody believes in it.</p><p data-keep>The water is found all the same, since in this valley it lies under every field at the same depth.</p></article>""",
    """<article><div class="notice" data-keep><h2>To all tenants</h2><p>The lifts will be renewed floor by floor from the third of May, and each will stand still for two weeks at most.</p><p>Please plan.</p>
    <p>Whoever cannot climb the stairs may ask the caretaker for a room on the ground floor until the work is over.</p></div><p data-keep>The board.</p></article>""",
    """<main><section id="alert-systems" data-keep><h2>Sirens</h2><p>Every town on the coast has a siren that is tried on the first of the month at noon and at no other time.</p></section><section class="search">Find your town</section>
    <section class="sharing-economy" data-keep><p>Where there is none the neighbours ring each other up along a list that the school keeps.</p><p>It works.</p></section></main>""",
    # bare pages and bars without a name
    """<body><p data-keep>Hello.</p></body>""",
    """<p data-keep>Gone fishing, back on Monday.</p>""",
    """<h1 data-keep>Closed</h1><p data-keep>Thank you all.</p>""",
    """<div>The daily paper of the valley since nineteen hundred and two, free</div><h1 data-keep>Snow</h1><p data-keep>The first snow came before the potatoes were out of the ground, and half of the crop was lost to it.</p>
    <p data-keep>It melted.</p><p data-keep>By the time the second came the fields were bare and nobody minded it any more.</p><div><a>Home</a> <a>Top</a></div>""",
    """<div>Welcome to the pages of our club, where all are at home</div><div><a>Join</a></div><h1 data-keep>The cup</h1><p data-keep>We lost the final by a single goal in the last minute, in front of more people than live in the village.</p><h2 data-keep>What next</h2>
    <p data-keep>Training starts again in August, on the old field behind the mill as long as the new one is under water.</p><div>Club colours are green and white</div>""",
    """<div><a>Start</a> | <a>Help</a></div><div>You are reading the plain version of this page for small screens</div><h2 data-keep>Moss</h2><p data-keep>Moss drinks through its leaves, so a wall that looks dead in summer is green an hour after the rain.</p><p data-keep>Touch it.</p>
    <p data-keep>The water it holds keeps the stones cool until well into the evening on the hottest of days.</p><p><a>Lichens</a></p><p><a>Ferns</a></p>""",
    """<div class="copyright">All text on this page may be used by anyone who names us as its source and sends a copy.</div><p class="copyright-law" data-keep>The law of copyright began with printers, not with writers, and it took two hundred years until that changed.</p>
    <p data-keep>Then it spread.</p><p data-keep>Today it covers a child's drawing as well as a novel, from the moment when it is made until long after its maker is dead.</p>""",
    """<article><p class="notice" data-keep>Let <math><mi>x</mi></math> be the share of rainy days in a year, and take the years as they come.</p><p data-keep>It varies.</p><p data-keep>Over a century the mean hardly moves, though no two neighbours among the years are alike.</p></article>
    <div class="comments"><p>In our town it rains every day of the year, I have kept a book of it since I was a child at school.</p></div>""",
    """<nav><a>Front page</a> <a>Town and country</a> <a>Sport and games</a> <a>Letters to us</a> <a>Small ads</a> <a>About the paper</a></nav><article><h1 data-keep>Fog</h1><p data-keep>In a thick fog the pilots steer by the bells, and each bell on the river has a note of its own.</p>
    <p><a>Bells</a> <a>Buoys and marks</a> <a>The old lights</a> <a>Pilots of the river</a> <a>Charts and maps</a> <a>Tide tables</a></p><p data-keep><a>The bells are listed with their notes in a book that every pilot has to know by heart</a></p>
    <p data-keep>It lifts by noon.</p></article><footer><a>Who we are</a> <a>Terms of use</a> <a>Your data</a> <a>Help and contact</a> <a>Jobs at the paper</a></footer>""",
    """<div><a>Home page</a> <a>All recipes</a> <a>By season</a> <a>By country</a> <a>For two</a> <a>For a crowd</a></div><p data-keep>Soup made of nettles tastes of spring, and costs nothing but a pair of gloves and half an hour of your time.</p>
    <p data-keep><a>Cream may be added</a>, but then <a>the colour</a> goes from green to grey.</p><p data-keep>Serve hot.</p><p data-keep>What is left over can be kept for a day, though the taste of it will be more of iron than of spring.</p>
    <aside><a>Ten more soups that need no stock at all and are ready in less than an hour</a></aside><div class="related"><a>What to do with a glut of courgettes and how to keep herbs through the winter</a></div>""",
    """<div>Home</div><div>Town news</div><article data-keep><p>Four words of text.</p></article><div>Made with care</div>""",
    """<nav><a>Home</a></nav><p data-keep>The page you want has moved.</p><footer>The webmaster</footer>""",
    """<ul><li><a>Weather</a></li><li><a>Tides</a></li></ul><div><p data-keep>At low water the wreck can be reached on foot, by those who know where the sand is firm enough.</p><p data-keep>Ask first.</p><ul data-keep><li>Boots, not shoes, whatever the season</li><li>A rope of twenty yards or more</li></ul>
    <p data-keep>Two hours are enough to get there and back, and there is nothing on board that anybody could still want.</p></div><ul><li><a>Harbour office</a></li><li><a>Lifeboat</a></li><li><a>Chandler</a></li></ul>""",
)


@dataclass
class Node:
    keep: bool
    feature: int = -1
    limit: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> Node:
    """A decision tree by the Gini impurity; first best split on ties."""
    node = Node(keep=bool(y.mean() >= 0.5) if len(y) else False)
    if depth == 0 or len(y) < 2 or y.min() == y.max():
        return node
    gini = lambda v: len(v) * 2 * v.mean() * (1 - v.mean()) if len(v) else 0.0
    best = gini(y) - 1e-9
    for f in (1, 5, 3, 0, 14, 6, 11, 12, 7, 8, 4, 2, 9, 10, 13):
        values = np.unique(x[:, f])
        for limit in (values[:-1] + values[1:]) / 2:
            left = x[:, f] <= limit
            if (cost := gini(y[left]) + gini(y[~left])) < best:
                best, node.feature, node.limit = cost, f, float(limit)
    if node.feature >= 0:
        left = x[:, node.feature] <= node.limit
        node.low, node.high = grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)
    return node


def classify(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.keep)
    left = x[:, node.feature] <= node.limit
    out = np.empty(len(x), bool)
    out[left], out[~left] = classify(node.low, x[left]), classify(node.high, x[~left])
    return out


def train(labelled: tuple[str, ...] = LABELLED) -> Node:
    pages = [blocks(page) for page in labelled]
    return grow(np.concatenate([features(p) for p in pages]), np.array([b.keep for p in pages for b in p], float))


def held_out(every: int = 4) -> tuple[int, int]:
    """(right, all) blocks of every ``every``th labelled page by trees grown without it, each page held out once."""
    right = n = 0
    for k in range(every):
        tree = train(tuple(p for j, p in enumerate(LABELLED) if j % every != k))
        for page in LABELLED[k::every]:
            found = blocks(page)
            right += int((classify(tree, features(found)) == np.array([b.keep for b in found])).sum())
            n += len(found)
    return right, n


def main_text(page: str | None, tree: Node) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    return "\n".join(b.text for b, keep in zip(found, classify(tree, features(found)), strict=True) if keep)


def extract_text(pages: DataFrame, tree: Node | None = None, key: str = "page_id", page: str = "html") -> DataFrame:
    """``pages`` (key, url) with the main text of each.

    The page is cut into flat text blocks; each block's word count and link density, those of its
    neighbours and its surroundings are classified by a decision tree grown from ``LABELLED``. Link density is its root. A name makes a
    box around the article only if all its words say so, and never a paragraph, heading or item of the article; a named box
    within it goes by its share of the text.
    Kept blocks are joined in page order by one line feed; nothing is capped. Null and empty
    pages and pages without main text give "". Repeated rows return as often. Empty: empty.
    """
    small_batches(pages.sparkSession)
    tree = tree or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "html"):
                texts = [main_text(x, tree) for x in batch.column(2).to_pylist()]
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col(key).alias("page_id"), "url", F.col(page).alias("html")).mapInArrow(run, "page_id long, url string, text string")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
