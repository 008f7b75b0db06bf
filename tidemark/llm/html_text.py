"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut at block-level tags into flat blocks. A block is described by its own and its
neighbours' word counts and link densities, by its tag, and by the zone it stands in: whether the
nearest telling container is one of the article or one of the furniture around it. A decision tree
trained on a small labelled table (``LABELLED``, pages written for it) keeps or drops each block.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import buffers as B, store

#: The tags of HTML that begin and end blocks, that contain, and that hold no text.
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
CONTAINER = set("address article aside body details dialog div dl fieldset figure footer form header hgroup html main menu nav ol section table td tr ul li blockquote head".split())
#: elements whose content is no markup, and others whose content is no text of the page
RAW = set("script style textarea iframe noembed noframes xmp".split())
SILENT = set("noscript template svg math object select button canvas audio video".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
FURNITURE = set("nav header footer aside form menu dialog fieldset head".split())
_BAD = re.compile(r"\b(?:ads?|adverts?|advertisement|banner|breadcrumbs?|byline|comments?|consent|cookies?|disqus|footer|gdpr|header|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|overlay|pager|pagination|popup|promo|promoted|related|replies|respond|share|sharing|sidebar|signup|social|sponsor|sponsored|subscribe|tags|toolbar|widget|alert|disclaimer|copyright)\b", re.I)
_GOOD = re.compile(r"\b(?:article|articlebody|content|entry|main|post|story|body|text)\b", re.I)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TAG_END = re.compile(r">|=\s*(?P<quote>[\"'])")
_ANCHOR = re.compile(r"<(/?)a(?=[\s/>])", re.I)
_HINT = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_CUT = re.compile(r"[-_]|(?<=[a-z])(?=[A-Z])")
_TIGHT = re.compile(r"\s+")

FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "zone", "heading", "item"]


def zone_of(tag: str, attributes: str) -> int:
    """1 for a container of the article, -1 for one of the furniture, 0 for one that tells nothing."""
    if tag in FURNITURE:
        return -1
    hints = " ".join(_CUT.sub(" ", h.strip("\"'")) for h in _HINT.findall(attributes))
    if tag in ("article", "main"):
        return -1 if "comment" in hints else 1
    if hints and _BAD.search(hints):
        return -1
    return 1 if hints and _GOOD.search(hints) else 0


def tokens(page: str) -> Iterator[tuple[str, str, str, int]]:
    """("text", its characters, "", place), ("open", name, attributes, place) and ("close", name, "", place).

    One walk from left to right. What a search has not found ahead is not looked for again, so the
    work is linear in the page whatever it holds. A quote that is never closed is a character like
    others, a tag that is never closed ends the page, and so does a script or style without an end.
    """
    at, end = 0, len(page)
    missing: set[str] = set()  # quotes and end tags that don't occur from here on

    def find(what: str, start: int) -> int:
        found = -1 if what in missing else page.find(what, start)
        if found < 0:
            missing.add(what)
        return found

    def close_of(name: str, start: int) -> tuple[int, int]:
        """(start, end) of the end tag of an element, or (-1, -1)."""
        got = None if f"</{name}" in missing else re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, start)
        if not got:
            missing.add(f"</{name}")
            return -1, -1
        stop = find(">", got.end())
        return got.start(), end if stop < 0 else stop + 1

    def tag_end(start: int) -> int:
        """The place of the > that ends a tag, quoted values skipped, or the page's end."""
        while m := _TAG_END.search(page, start):
            if not m["quote"]:
                return m.start()
            stop = find(m["quote"], m.end())
            start = m.end() if stop < 0 else stop + 1
        return end

    while at < end:
        mark = page.find("<", at)
        if mark < 0:
            yield "text", page[at:], "", at
            return
        if mark > at:
            yield "text", page[at:mark], "", at
        sign = page[mark + 1 : mark + 2]
        if page.startswith("<!--", mark):
            stop = find("-->", mark + 2)
            at = end if stop < 0 else stop + 3
        elif sign in ("!", "?") or (sign == "/" and not page[mark + 2 : mark + 3].isalpha()):
            stop = find(">", mark)
            at = end if stop < 0 else stop + 1
        elif sign == "/":
            name = _NAME.match(page, mark + 2)
            if not name:  # a letter of another script
                yield "text", "<", "", mark
                at = mark + 1
                continue
            stop = find(">", name.end())
            at = end if stop < 0 else stop + 1
            yield "close", name[0].lower(), "", mark
        elif m := _NAME.match(page, mark + 1):
            name, stop = m[0].lower(), tag_end(m.end())
            attributes = page[m.end() : stop]
            at = min(stop + 1, end)
            if name in RAW:
                at = close_of(name, at)[1]
                at = end if at < 0 else at
            elif name in SILENT:
                if not (name in ("svg", "math") and attributes.endswith("/")):
                    closed = close_of(name, at)[1]
                    at = at if closed < 0 else closed
            else:
                yield "open", name, attributes, mark
        else:
            yield "text", "<", "", mark
            at = mark + 1


def blocks(page: str) -> list[tuple[str, int, int, int, str]]:
    """(text, words, words in links, zone, tag) of the flat blocks of a page in order."""
    out: list[tuple[str, int, int, int, str]] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int]] = [("", 0)]
    opened: Counter[str] = Counter()
    anchors = [(m.start(), m[1] == "/") for m in _ANCHOR.finditer(page)]
    ended = {x for (x, close), (_, after) in zip(anchors, anchors[1:]) if not close and after}  # links with an end
    tag, link, loose = "", False, False

    def flush():
        if parts:
            text = _TIGHT.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append((text, text.count(" ") + 1, len(html.unescape(" ".join(linked)).split()), stack[-1][1], tag))
            parts.clear()
            linked.clear()

    for kind, name, attributes, place in tokens(page):
        if kind == "text":
            parts.append(name)
            if link:
                linked.append(name)
            continue
        close = kind == "close"
        if name == "a":
            link, loose = not close, not close and place not in ended
        elif name == "br":
            parts.append(" ")
        elif name in BLOCK or name in CONTAINER:
            flush()
            link = link and not loose  # a link without an end goes no further than its block
            if name in CONTAINER:
                if not close:
                    if not attributes.rstrip().endswith("/"):
                        stack.append((name, zone_of(name, attributes) or stack[-1][1]))
                        opened[name] += 1
                elif opened[name]:
                    while True:
                        last = stack.pop()[0]
                        opened[last] -= 1
                        if last == name:
                            break
            tag = "" if close else name
            if name in ("body", "article", "main") and not close:
                link = False
                while len(stack) > 1 and stack[-2][0] == "head":  # an unclosed head ends here
                    opened[stack.pop(-2)[0]] -= 1
    flush()
    return out


def table_of(found: list[tuple[str, int, int, int, str]]) -> np.ndarray:
    """The features of a page's blocks."""
    n = len(found)
    own = np.array([(w, k / max(w, 1), z, t in HEADINGS, t in ("li", "td", "th", "dt", "dd")) for _, w, k, z, t in found], float).reshape(n, 5)
    words, links = np.pad(own[:, 0], 1), np.pad(own[:, 1], 1)
    return np.column_stack([own[:, 0], own[:, 1], words[:-2], links[:-2], words[2:], links[2:], own[:, 2:]])


class Tree:
    """A binary decision tree by Gini impurity; ties go to the first feature and lowest cut."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2):
        self.feature, self.cut, self.left, self.right = -1, 0.0, None, None
        self.value = bool(y.mean() >= 0.5)
        if depth == 0 or len(y) < 2 * least or y.min() == y.max():
            return
        best = (self._impurity(y) * len(y) - 1e-9, -1, 0.0)
        for f in range(x.shape[1]):
            levels = np.unique(x[:, f])
            for cut in (levels[1:] + levels[:-1]) / 2:
                side = x[:, f] <= cut
                if min(side.sum(), (~side).sum()) >= least:
                    cost = self._impurity(y[side]) * side.sum() + self._impurity(y[~side]) * (~side).sum()
                    if cost < best[0] - 1e-12:
                        best = (cost, f, cut)
        _, self.feature, self.cut = best
        if self.feature >= 0:
            side = x[:, self.feature] <= self.cut
            self.left, self.right = (Tree(x[s], y[s], depth - 1, least) for s in (side, ~side))

    @staticmethod
    def _impurity(y: np.ndarray) -> float:
        p = y.mean()
        return p * (1 - p)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        side = x[:, self.feature] <= self.cut
        out = np.empty(len(x), bool)
        out[side], out[~side] = self.left.predict(x[side]), self.right.predict(x[~side])
        return out


#: The labelled table: pages whose main text is marked by + before each block of it.
LABELLED = [
    """<html><head><title>Rain in the north</title></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/w>Weather</a></li></ul></nav>
    <article><h1>+Rain in the north</h1><p>+Rain fell for three days over the northern hills and filled every stream that runs down to the sea.</p>
    <p>+Roads were closed.</p><p>+The <a href=/r>river office</a> said that the water would fall by the end of the week, if the wind held.</p></article>
    <footer>Copyright 2020 The Northern Paper</footer></body></html>""",
    """<body><header><a href=/>The Paper</a><p>News every day for the whole county since 1901</p></header><div class="cookie-notice">We use cookies to make this site better for all our readers. <a href=/c>More</a></div>
    <main><h1>+A short note</h1><p>+Nothing happened.</p><div class="ad">Buy two pans and get a third one for free at the kitchen shop in town.</div><p>+Nobody came.</p>
    <ul><li>+First the bells rang</li><li>+Then the doors opened</li></ul></main><aside><h3>Most read</h3><p>Ten ways to cook an egg without a pan and other stories</p></aside></body>""",
    """<body><div id="menu"><a href=/1>One</a> <a href=/2>Two</a></div><div class="content"><h2>+On keeping bees</h2><p>+Bees need water, shelter and flowers that bloom from early spring until late autumn.</p>
    <blockquote>+Leave them be, my teacher said, and they will do the rest.</blockquote><form><p>Sign up for our letter with your name and your address below</p><label>Name</label></form></div>
    <div class="comments"><h3>Comments</h3><p>I have kept bees for years and never had any trouble with them at all.</p><p>Great.</p></div><div class="footer">All rights reserved</div></body>""",
    """<body><div>The Old Times</div><div><a href=/a>News</a> <a href=/b>Sport</a> <a href=/c>Arts</a></div><p>+The council met on Monday and spoke for six hours about the bridge that fell in the spring flood.</p>
    <p>+It will be built again, in stone this time, and the work will take two years if the money lasts.</p><p><a href=/x>Read on: the bridge in pictures</a></p><div>Terms</div></body>""",
    """<body><div class="sidebar"><p>A long text about the people who write this page, where they live and what they like to read.</p><ul><li><a href=/m>March</a></li><li><a href=/p>April</a></li></ul></div>
    <div class="post-body"><h1>+Bread</h1><p>+Mix flour, water and salt.</p><p>+Wait.</p><table><tr><td>+flour</td><td>+500 g</td></tr></table><div class="share">Share this with your friends by post or wire</div></div></body>""",
    """<body><nav><a href=/>Start</a></nav><article><h1>+Two ships</h1><aside>Related: three ships that never left the harbour</aside><p>+Two ships left the harbour at dawn and neither of them was seen again that year.</p>
    <p>+<a href=/log>Their logs</a> were found.</p></article><section class="comments"><article class="comment"><p>My grandfather was on one of these ships and told us of it often.</p></article></section>
    <p class="notice">This text was first printed in another paper and is given here by leave of its owners</p>
    <footer><p>Printed and published by the harbour press for the society of friends of the sea</p></footer></body>""",
    """<body><div>The Daily Ledger</div><div><a href=/a>World news and more from all over the place</a> <a href=/b>Sport and games of the whole week</a> <a href=/c>Arts and letters from the city and beyond</a></div>
    <h1>+A mill burns down</h1><p>+The old mill at the end of the valley burned down in the night and only its wheel was saved by the farmers.</p><p>+No one was hurt.</p>
    <p>+The owner, who had bought it a year ago, said in the morning that he would not build it again at his age.</p><p>+Smoke still rose at noon.</p><p>+The fire brigade of three villages had come with two engines, and a third one broke down on the way to the hill.</p>
    <div><a href=/n1>Older: the mill wheel turns again after ten years of rest</a></div><div><a href=/n2>Newer: what became of the miller and of his seven grey cats</a></div><div>Imprint</div></body>""",
    """<body><div>Green Field Gazette</div><div><a href=/a>Farm</a> <a href=/b>Town</a></div><p>+Sheep were sold at high prices on the market this week, as the dry summer had left few of them fat enough.</p><p>+Wool was cheap.</p>
    <p>+Corn was hardly to be had at all, and those who had some kept it for the winter that all of them expect to be hard.</p><div>Contact</div><div><a href=/x>All our markets in one list for each week of the year</a></div></body>""",
    """<body><main><article><header><h1>+Snow on the pass</h1><p>By a writer of this paper who lives near the pass</p></header><p>+Snow closed the pass on Sunday night and left forty travellers in the inn at the top of it.</p><p>+They sang.</p>
    <nav><a href=/1>1</a> <a href=/2>2</a></nav><p>+On Monday the plough came through and led them down to the valley, one after the other.</p><ul><li><a href=/s1>Snow on the lake</a></li><li><a href=/s2>Snow in the town, in pictures</a></li></ul></article></main></body>""",
    """<body><div class="ad">Fresh fish daily.</div><article><h1>+The river rises</h1><p>+The river had risen all through the night, and when the keepers of the bridge woke, the water stood at the third step of the old stair, which no one living had seen before, and it was rising still.</p><div class="advert">Tea and more tea at the corner house.</div><p>+By noon it had reached the fifth, and the market was moved up the hill to the yard of the school, where the children were sent home and the benches were piled up to make room for the carts and stalls.</p><div class="promo">Shoes for every foot and every kind of weather, now at half the price in both of our shops, at the station and by the old gate, but only until the end of this week and only as long as there are any left for you to take home.</div><p>+The river had risen all through the night, and when the keepers of the bridge woke, the water stood at the third step of the old stair, which no one living had seen before, and it was rising still.</p><p>+So it went.</p></article>
    <div class="sponsored">Shoes for every foot and every kind of weather, now at half the price in both of our shops, at the station and by the old gate, but only until the end of this week and only as long as there are any left for you to take home.</div><div class="related">Five rivers.</div></body>""",
    """<body><header>River news</header><div class="banner">A new bridge of your own.</div><div class="story"><p>+By noon it had reached the fifth, and the market was moved up the hill to the yard of the school, where the children were sent home and the benches were piled up to make room for the carts and stalls.</p><aside>See the map.</aside><p>+The river had risen all through the night, and when the keepers of the bridge woke, the water stood at the third step of the old stair, which no one living had seen before, and it was rising still.</p><aside>By noon it had reached the fifth, and the market was moved up the hill to the yard of the school, where the children were sent home and the benches were piled up to make room for the carts and stalls.</aside><p>+By noon it had reached the fifth, and the market was moved up the hill to the yard of the school, where the children were sent home and the benches were piled up to make room for the carts and stalls.</p></div>
    <div id="comments"><p>The river had risen all through the night, and when the keepers of the bridge woke, the water stood at the third step of the old stair, which no one living had seen before, and it was rising still.</p><p>I saw it too, from the hill, and so did my brother.</p><p>By noon it had reached the fifth, and the market was moved up the hill to the yard of the school, where the children were sent home and the benches were piled up to make room for the carts and stalls.</p></div><footer>The river had risen all through the night, and when the keepers of the bridge woke, the water stood at the third step of the old stair, which no one living had seen before, and it was rising still.</footer></body>""",
    """<body><div>Harbour Post</div><div><a href=/a>News</a></div><div><a href=/b>Tides and winds</a></div><div><a href=/c>Ships for sale</a></div><div><b>+The old crane comes down</b></div>
    <div>+For ninety years the crane stood at the end of the quay, and no ship that came in could miss it, by day or by night, for it carried a lamp.</div><div>+On Tuesday men from the city began to take it apart, bolt by bolt, and by the evening its arm lay on the stones below.</div>
    <div>+What will stand in its place has not been said, though <a href=/p>a plan</a> drawn by the harbour master shows a row of trees, a bench and a stand for bicycles.</div><div><a href=/d>A plan for the quay</a></div><div><a href=/e>All stories of this week</a></div><div>Top of page</div></body>""",
    """<body><p><a href=/>Start</a> | <a href=/n>New</a> | <a href=/o>Old</a> | <a href=/l>Letters to us</a></p><h2>+Salt</h2><p>+Salt was once carried over these hills on the backs of mules, forty to a train, and each of them knew the way.</p>
    <p>+The men who walked beside them were paid in salt as well, which they sold in the villages on the way home for bread, cheese and shoes.</p><p>+Of the seven inns on the road two are left, and in one of them the measures still hang on the wall by the door, dented and black.</p>
    <p><a href=/p1>Before: the road of tin</a></p><p><a href=/p2>Next: the road of wool</a></p><p>Write to us</p></body>""",
    """<body><table><tr><td><a href=/1>Home</a></td><td><a href=/2>Shop</a></td><td><a href=/3>About us</a></td></tr></table><h1>+How to mend a kettle</h1><p>+Empty it and let it dry for a day, for a wet seam takes no solder and you will only burn your fingers on the steam.</p>
    <p>+Clean the seam with sand and a little vinegar until it shines along its whole length, then warm the kettle slowly over a small flame.</p><p>+Lay the solder on and let it run, turn the kettle as it does, and do not breathe on it until it has set, however long that takes.</p><p><a href=/4>More from the workshop of our readers</a></p><p>Back</p></body>""",
    """<body><div>Weather: rain</div><div><a href=/x>Log in</a> <a href=/y>Register</a></div><div>+The choir of the lower town sang for the last time in the hall by the bridge, which will be a store for grain from the spring on.</div>
    <div>+There were more people outside than in, and the doors were left open so that all of them could hear, in spite of the wind from the river.</div><div>+When it was over no one clapped, and then everyone did, and the caretaker put out the lamps one by one as he had always done.</div><div><a href=/z>Where the choir will sing next year, and who pays for it</a></div><div>Page 1 of 1</div></body>""",
    """<body><div class="menu"><a href=/1>All the news of today</a></div><div class="promo">Two tickets for one.</div><div class="content"><p>+The first train over the new bridge left the station at eight in the morning with flags on its engine and a band in the last coach.</p>
    <div class="ad">Fresh rolls at the station.</div><p>+Children stood along the whole line and waved, and at every halt the mayor of the place got on and made a speech to those who were there.</p><div class="notice">This page uses cookies.</div>
    <p>+By noon the train was two hours late, and no one seemed to mind it much, least of all the driver, who was given a cake.</p><div class="related">Older bridges of our valley</div><p>+It went back in the evening with all its lamps lit, and from the hill one could follow it until it was lost behind the mill.</p>
    <div class="newsletter">Get our letter each week.</div><p>+From Monday on there will be four trains a day, and the ferry, which has crossed here since the time of the dukes, will stop.</p><div class="share">Tell your friends of this</div></div><div class="comments"><p>I was on it.</p><p>We waited for it at the third halt with my whole class, and when it came at last it went by so fast that I saw only the flags.</p></div></body>""",
    """<body><nav>News of the town</nav><main><p>+Nobody knows who planted the pear tree in the yard of the old school, but it has borne fruit in every year that anyone can remember.</p><aside>More on trees and gardens</aside>
    <p>+This summer its trunk split in a storm, and the gardener who was asked to look at it gave it one more winter at the most.</p><form>Your address and your name</form><p>+So the pupils took cuttings from it, forty of them, and set them in pots along the wall, where the sun is warm until late.</p><div class="banner">Pots for every purse here</div>
    <p>+Eleven have taken root so far, and each of them has been promised to another garden of the town for the coming spring, by lot.</p></main><footer>Printed in the town itself</footer></body>""",
]


def labelled(page: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, whether kept) of a labelled page's blocks."""
    found = blocks(page)
    return table_of([(t.lstrip("+"), *rest) for t, *rest in found]), np.array([t.startswith("+") for t, *_ in found])


@lru_cache(maxsize=1)
def tree() -> Tree:
    x, y = zip(*map(labelled, LABELLED))
    return Tree(np.concatenate(x), np.concatenate(y))


def left_out_accuracy(without: tuple[str, ...] = ()) -> float:
    """The share of blocks told right by trees that have not learnt the block's page."""
    use = [i for i, name in enumerate(FEATURES) if name not in without]
    pages, right, n = [labelled(p) for p in LABELLED], 0, 0
    for k, (x, y) in enumerate(pages):
        rest = [p for i, p in enumerate(pages) if i != k]
        got = Tree(np.concatenate([p[0] for p in rest])[:, use], np.concatenate([p[1] for p in rest])).predict(x[:, use])
        right, n = right + int((got == y).sum()), n + len(y)
    return right / n


def main_text(page: str | None) -> str:
    """The text of the blocks that the tree keeps, joined by one LF."""
    found = blocks(page or "")
    keep = tree().predict(table_of(found)) if found else ()
    return "\n".join(b[0] for b, ok in zip(found, keep) if ok)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        B.lean()
        texts: list[str] = []
        pages = b.column(2).to_pylist()
        for i in range(0, len(pages), 200):
            found = [blocks(p or "") for p in pages[i : i + 200]]
            x = np.concatenate([table_of(f) for f in found])
            keep = iter(tree().predict(x).tolist())
            texts += ["\n".join([block[0] for block in f if next(keep)]) for f in found]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row; n_chars counts code points.

    Null and empty pages give empty texts. Repeated rows each give a row; an empty table gives an
    empty one; other columns play no part.
    """
    store.small_batches(pages.sparkSession)
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return source.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
