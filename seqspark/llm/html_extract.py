"""Main-text extraction by tag-path ratios.

A page is a sequence of text blocks, each with its root-to-leaf path of block elements (inline elements fold into
their block).  For every path the text length (link texts left out) and punctuation over its blocks give two
ratios, per block.  Ratios are smoothed along the page with weights that fall with the distance of two paths, and
fused: text and punctuation, then the path with the container that the block stands in, and a block below another
takes over a share of the score of the text around it.  Blocks whose fused score reaches a share of the page's
best, and a fixed floor, are content.

Names (of elements, classes, ids and roles) only weigh: a score is multiplied by more than 1 inside an article and
by a small number inside menus, adverts, footers, comments and the like.  Hidden elements have no text.

Work is linear in the page, whatever its nesting: paths are nodes of a trie, and open elements are found by name.

Defined results: null or empty html gives an empty text; markup that never closes is read to its end; a page
without content blocks gives an empty text; repeated rows each get a row; extra columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

# fixed values: elements of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "object", "svg", "math", "select", "title", "noembed", "noframes", "xmp", "audio", "video", "canvas", "plaintext")
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCK - frozenset("body html head td th tr tbody thead tfoot caption legend summary".split())
#: An opened element ends the open ones of these that are inside the innermost stopper.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("td", "th", "tr"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)), "body": (("head",), ("html",)),
}

# names that weigh: elements, then whole words of class, id and role, then words that count as part of a hyphenated one
OFF_TAGS = frozenset("nav header footer aside form button menu dialog head figure label fieldset input".split())
OFF_WORDS = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored sponsors promo promos promotion banner nav navbar navigation menu menus menubar breadcrumb breadcrumbs sidebar side-bar side rail footer foot header masthead topbar "
    "comment comments commentlist comment-list disqus disqus_thread respond reply replies responses discussion cookie cookies cookie-notice cookie-banner consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup sign-up login "
    "share sharing shares social related recommended recommendations widget widgets pagination pager toolbar search searchbox copyright legal complementary contentinfo sr-only skip skip-link tag tags tagcloud meta byline-links form teaser teasers hidden visually-hidden".split()
)
OFF_PARTS = frozenset(
    "ad ads advert advertisement sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead comment comments disqus reply replies cookie cookies consent gdpr notice notices popup modal overlay newsletter "
    "subscribe signup login share sharing social related recommended widget widgets pagination pager toolbar".split()
)
ON_TAGS = frozenset(("article", "main"))
ON_WORDS = frozenset("article post entry story main content hentry articlebody article-body post-body post-content entry-content article-content main-content page-content body-text story-body storytext".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Quotes count only where a value begins; a run is never given back.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)|(?P<text>[^<]++|<)", re.S
)
ATTR = re.compile(r"(?:^|[\s/\"'])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|\Z)", re.I)
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}
PUNCT = re.compile(r"[.,;:!?…](?=\s|\Z)|[。，！？、]")  # at a word's end: not the dots of a host
SPACE = re.compile(r"\s+")

#: Smoothing: width, places to either side.  Share of the best score that content reaches, and its floor.
SIGMA, REACH, THRESHOLD, FLOOR = 1.0, 2, 0.45, 0.5
#: Weights of names: inside forms and other regions that are off, elsewhere, inside another body, inside an article.
WEIGHT = {-2: 0.005, -1: 0.005, 0: 1.0, 1: 2.0, 2: 3.0}
#: What a block keeps of the score of the text around it, by container on the way up.
SUPPORT, LEVELS = 0.8, 3


def name_weight(words: str) -> int:
    """-1 if the class, id or role words name a region that is off, 1 a body, 0 neither.

    A whole word decides before a part of a hyphenated one: ``post type-post tag-python`` is a body.
    """
    tokens = words.lower().split()
    if any(t in OFF_WORDS for t in tokens):
        return -1
    if any(t in ON_WORDS for t in tokens):
        return 1
    parts = (p for t in tokens if "-" in t or "_" in t for p in re.split(r"[-_]+", t))
    return -1 if any(p in OFF_PARTS for p in parts) else 0


def _names(attrs: str) -> tuple[str, bool]:
    words, hidden = [], False
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "style":
            hidden |= bool(HIDDEN.search(value))
        elif name == "hidden" or name == "aria-hidden":
            hidden |= name == "hidden" or value.lower() == "true"
        else:
            words.append(value)
    return " ".join(words), hidden


class Block:
    """A run of text: its path (node of the trie), container (element), region, pieces, letters outside and inside of links."""

    __slots__ = ("path", "holder", "region", "number", "parts", "chars", "linked")

    def __init__(self, path: int, holder: int, region: int, number: int):
        self.path, self.holder, self.region, self.number = path, holder, region, number
        self.parts: list[str] = []
        self.chars = self.linked = 0


class Page:
    """Blocks in page order; for each path its parent and depth, for each element its container."""

    def __init__(self, page: str):
        self.parent, self.depth = [0], [0]
        self.steps: dict[tuple[int, str], int] = {}
        self.above = [-1]  # container of each block element; 0 is the page
        self.blocks: list[Block] = []
        self._read(page)

    def _step(self, path: int, step: str) -> int:
        at = self.steps.get((path, step))
        if at is None:
            at = self.steps[path, step] = len(self.parent)
            self.parent.append(path)
            self.depth.append(self.depth[path] + 1)
        return at

    def _read(self, page: str) -> None:
        names: list[str] = []  # open elements
        state = [(0, 0, 0, 0)]  # of each open element and the page: path, element, region (None: hidden), links open
        places: dict[str, list[int]] = {}  # where elements of a name are open
        walls: list[int] = []  # where block elements are open
        number, at, n = 0, 0, len(page)
        new = True

        def close(low: int) -> None:
            while len(names) > low:
                tag = names.pop()
                state.pop()
                places[tag].pop()
                if walls and walls[-1] == len(names):
                    walls.pop()

        def add(text: str) -> None:
            nonlocal new
            path, holder, region, links = state[-1]
            if region is None:
                return
            last = self.blocks[-1] if self.blocks else None
            if new or last is None or last.region != region or last.path != path:
                if not text.strip() and (new or last is None):
                    return
                last = Block(path, holder, region, number)
                self.blocks.append(last)
                new = False
            last.parts.append(text)
            size = len(text.strip())
            last.chars += size
            last.linked += size if links else 0

        while at < n:
            m = TOKEN.match(page, at)
            at = m.end()
            if m["text"] is not None:
                add(m["text"])
                continue
            if m["tag"] is None:
                continue
            tag = m["tag"].lower()
            block = tag in BLOCK
            if block:
                number, new = number + 1, True
            if m["close"]:
                open_at = places.get(tag)
                if open_at and (block or not walls or open_at[-1] > walls[-1]):  # an inline end doesn't end blocks
                    close(open_at[-1])
                continue
            attrs = m["attrs"]
            words, hidden = _names(attrs) if attrs.strip("/ \t\n") else ("", False)
            if tag in CLOSES_P and walls and names[walls[-1]] == "p":
                close(walls[-1])
            if tag in IMPLIED:
                ends, stops = IMPLIED[tag]
                stop = max((places[s][-1] for s in stops if places.get(s)), default=-1)
                inside = [p[i] for e in ends if (p := places.get(e)) and (i := bisect_right(p, stop)) < len(p)]
                if inside:
                    close(min(inside))
            if tag == "br":
                add(" ")
            if tag in VOID or attrs.endswith("/") and not block:
                continue
            if tag in RAW:
                end = RAW_END[tag].search(page, at)
                at = end.end() if end else n
                continue
            path, holder, region, links = state[-1]
            if region == -2 and tag in ON_TAGS:  # a form around the whole page
                region = 0
            if region is not None and region >= 0:
                named = name_weight(words) if words and tag not in ("body", "html") else 0
                if hidden:
                    region = None
                elif named < 0 or tag in OFF_TAGS and not (tag in ("header", "figure") and region > 0) and not named > 0:
                    region = -2 if tag == "form" else -1
                elif tag == "article":
                    region = 2
                elif tag in ON_TAGS or named > 0:
                    region = max(region, 1)
            elif hidden:
                region = None
            if block:
                self.above.append(holder)
                holder = len(self.above) - 1
                walls.append(len(names))
            if block or words:
                path = self._step(path, f"{tag} {words}" if words else tag)
            places.setdefault(tag, []).append(len(names))
            names.append(tag)
            state.append((path, holder, region, links + (tag == "a")))

    def distance(self, a: int, b: int, most: int) -> int:
        """Steps from one path to the other, or ``most`` if there are more."""
        steps = 0
        while a != b and steps < most:
            if self.depth[a] >= self.depth[b]:
                a = self.parent[a]
            else:
                b = self.parent[b]
            steps += 1
        return steps


def _fused(chars: float, punct: float) -> float:
    return math.sqrt(chars * (1 + punct))


def scores(page: Page) -> list[float]:
    """The fused, smoothed and weighed ratio of each block."""
    blocks = page.blocks
    punct = [len(PUNCT.findall(html_lib.unescape("".join(b.parts)).strip())) if b.chars > b.linked else 0 for b in blocks]
    # a path's ratios; inside an article link texts are text
    plain = [float(b.chars if b.region == 2 else b.chars - b.linked) for b in blocks]
    total: dict[int, list[float]] = {}
    held: dict[int, list[float]] = {}
    for b, c, q in zip(blocks, plain, punct, strict=True):
        if b.chars:
            for sums, key in ((total, b.path), (held, page.above[b.holder])):
                t = sums.setdefault(key, [0.0, 0.0, 0.0])
                t[0], t[1], t[2] = t[0] + 1, t[1] + c, t[2] + q
    raw = [(t[1] / t[0], t[2] / t[0]) if b.chars and (t := total[b.path]) else (0.0, 0.0) for b in blocks]
    # smoothed along the page, fused with the ratios of the container
    far = REACH + 4
    own = []
    for i, b in enumerate(blocks):
        weight, c, q = 1.0, *raw[i]
        for j in range(max(0, i - REACH), min(len(blocks), i + REACH + 1)):
            if j != i and blocks[j].region == b.region:
                w = math.exp(-((abs(i - j) + page.distance(b.path, blocks[j].path, far)) ** 2) / (2 * SIGMA**2))
                weight, c, q = weight + w, c + w * raw[j][0], q + w * raw[j][1]
        s = _fused(c / weight, q / weight)
        if b.chars:
            t = held[page.above[b.holder]]
            s = math.sqrt(s * _fused(t[1] / t[0], t[2] / t[0]))
        own.append(s * WEIGHT[b.region] if b.chars else 0.0)
    # the score of a container is that of the text right inside it, by size
    inside: dict[int, list[float]] = {}
    for b, s in zip(blocks, own, strict=True):
        if b.chars:
            for key in {b.holder, page.above[b.holder]}:
                t = inside.setdefault(key, [0.0, 0.0])
                t[0], t[1] = t[0] + b.chars, t[1] + s * b.chars
    out = []
    for b, s, c in zip(blocks, own, plain, strict=True):
        if not b.chars or b.region < 0:
            out.append(s)
            continue
        best, keep, at = s, c / b.chars, page.above[b.holder]
        for _ in range(LEVELS):
            if at < 0:
                break
            keep *= SUPPORT
            if at in inside:
                best = max(best, keep * inside[at][1] / inside[at][0])
            at = page.above[at]
        out.append(best)
    return out


def extract(page: str | None) -> str:
    """The article's blocks, one a line."""
    parsed = Page(page) if page else None
    if not parsed or not parsed.blocks:
        return ""
    found = scores(parsed)
    least = max(FLOOR, THRESHOLD * max(found))
    lines: dict[int, list[str]] = {}
    for s, b in zip(found, parsed.blocks, strict=True):
        if s >= least:
            lines.setdefault(b.number, []).extend(b.parts)
    texts = (SPACE.sub(" ", html_lib.unescape("".join(b))).strip() for b in lines.values())
    return "\n".join(x for x in texts if x)


def _extractor():
    def run(pages):
        texts = [extract(p) for p in pages]
        return [texts, [len(t) for t in texts]]

    return run


def extract_pages(pages: DataFrame) -> DataFrame:
    """Columns of ``pages`` except html, and ``text``, ``n_chars``; no shuffle.  A column named text before is replaced."""
    rest = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    found = map_texts(pages.select(*rest, F.col("html").alias("text")), _extractor, [("_main", "string"), ("n_chars", "long")])
    return found.withColumnRenamed("_main", "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every page, whole html."""
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
