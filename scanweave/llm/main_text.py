"""Main text of web pages: parser events to lines, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The standard library's parser streams its events once over a page.  A *line* is one block of the
page: the text between two block boundaries, however the source is broken into lines, since
whole pages often are a single source line.  The ratio of a line is its visible text outside
links, divided by the tags met since the line before.  Lines within page furniture (elements and
class, id or role names of ``FURNITURE``) have ratio 0, so they form valleys.  The ratios are
smoothed with a Gaussian; lines at or above the threshold are core lines, and runs of them are
clusters.  What the page itself marks as content (article, main) is taken whole where it holds a
core line; otherwise the smallest container of each large cluster is.  Short lines of a content
region therefore stay, and long ones in furniture do not come in.

Results for odd input: NULL or empty html gives the empty text; markup that never ends (comment,
tag, script) swallows the rest, as in browsers; a page without a live line gives the empty text;
repeated rows and NULL ids are treated row by row; other columns of the table are not touched.
"""

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.llm.shared import slices, spare

#: standard deviation of the smoothing kernel, in lines
SIGMA = 1.0
#: a cluster outside marked content counts if it has this share of the largest one's text
LARGE = 0.25

# --- names of elements, and names that sites give to furniture ---
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary "
    "table tbody tfoot thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: a block start ends an open p; an element of the key ends open elements of the value
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
#: an implied end looks no further than one of these
SCOPES = frozenset("article body html main ol section table td th ul div dl blockquote aside nav header footer form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: containers that may hold a whole content region
REGIONS = frozenset("article body div html main ol section table td ul".split())
#: elements without visible prose, and furniture, by the kind that names them
UNSEEN = frozenset("title script style noscript template iframe object svg math canvas audio video".split())
ELEMENTS = {"nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "sidebar", "form": "form", "fieldset": "form",
            "button": "form", "select": "form", "textarea": "form", "option": "form", "datalist": "form", "search": "form", "dialog": "notice"}
ROLES = {"navigation": "menu", "menu": "menu", "menubar": "menu", "toolbar": "menu", "banner": "header", "contentinfo": "footer",
         "complementary": "sidebar", "search": "form", "form": "form", "dialog": "notice", "alertdialog": "notice", "alert": "notice",
         "status": "notice"}
FURNITURE = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar skiplink dropdown",
    "header": "header masthead topbar",
    "footer": "footer foot colophon copyright",
    "sidebar": "sidebar aside rail widget widgets related recommended recommendations trending teaser teasers share sharing social",
    "notice": "notice notices cookie cookies consent gdpr alert banner popup modal overlay toast paywall newsletter subscribe notification announcement",
    "advert": "ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox sponsor sponsored promo promotion affiliate",
    "comments": "comment comments commentlist disqus respond replies",
    "form": "form login signup search searchbox",
}
KINDS = {name: kind for kind, names in FURNITURE.items() for name in names.split()}
#: these say what a page has or lacks, not what the element is
NEGATIONS = frozenset("has with no without is not".split())
#: an article or main within such furniture ends it: sites wrap whole pages in a form or header
WRAPPERS = frozenset({"menu", "header", "form"})

_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def _kind(tag, attrs) -> str | None:
    """What furniture an element is, or None."""
    kind = ELEMENTS.get(tag)
    if kind or tag in ("html", "body", "main", "head"):
        return kind
    for name, value in attrs:
        if name in ("class", "id") and value:
            for word in value.split():
                parts = [p.lower() for p in _NAME.findall(word)]
                if parts and parts[0] not in NEGATIONS:
                    kind = next((KINDS[p] for p in parts if p in KINDS), None)
                    if kind and not (kind == "header" and tag in HEADINGS):
                        return kind
        elif name == "role" and value:
            kind = ROLES.get(value.strip().lower())
            if kind:
                return kind
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return "notice"
        elif name == "style" and value and "display:none" in value.replace(" ", "").lower():
            return "notice"
    return None  # a heading that calls itself a header is a heading


class _Open:
    """An element that has not ended yet."""

    __slots__ = ("tag", "kind", "unseen", "region", "mark")

    def __init__(self, tag, kind, unseen, region, mark):
        self.tag, self.kind, self.unseen, self.region, self.mark = tag, kind, unseen, region, mark


class Line:
    __slots__ = ("text", "ratio", "live", "heading", "linked", "region", "mark", "items")


class PageLines(HTMLParser):
    """Collects the lines of one page.  ``parents`` and ``names`` give the enclosing region and
    the element of each region; region 0 is the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.parents, self.names = [], [0], [""]
        self.stack = [_Open("", None, False, 0, None)]
        self.words, self.tags, self.links, self.linked = [], 0, 0, 0

    # Unfinished markup swallows the rest, and declarations are not looked into.
    def parse_comment(self, i, report=1):
        end = super().parse_comment(i, report)
        return end if end >= 0 else len(self.rawdata)

    def parse_html_declaration(self, i):
        return self.rawdata.find(">", i) + 1 or len(self.rawdata)

    def parse_pi(self, i):
        return self.rawdata.find(">", i) + 1 or len(self.rawdata)

    def parse_starttag(self, i):
        end = super().parse_starttag(i)
        return end if end >= 0 else len(self.rawdata)

    def parse_endtag(self, i):
        end = super().parse_endtag(i)
        return end if end >= 0 else len(self.rawdata)

    def handle_data(self, data):
        top = self.stack[-1]
        if not top.unseen:
            self.words.append(data)
            if self.links:
                self.linked += sum(len(w) for w in data.split())

    def end_line(self):
        text = " ".join("".join(self.words).split())
        if text:
            top = self.stack[-1]
            line = Line()
            line.text, line.region, line.mark = text, top.region, top.mark
            line.heading = next((o.tag for o in reversed(self.stack) if o.tag in HEADINGS), None)
            line.live = top.kind is None or (top.kind == "heading" and line.heading is not None)
            line.linked = self.linked
            line.items = next((o.region for o in reversed(self.stack) if o.tag in ("ul", "ol")), None)
            letters = sum(len(w) for w in text.split()) - self.linked
            line.ratio = letters / max(1, self.tags) if line.live else 0.0
            self.lines.append(line)
            self.tags = 0
        self.words, self.linked = [], 0

    def pop_to(self, at):
        for gone in self.stack[at:]:
            self.links -= gone.tag == "a"
        del self.stack[at:]

    def implied_end(self, tags):
        """Ends the innermost open element of these, and its line if it is a block, unless a scope
        comes first."""
        for at in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[at].tag
            if tag in tags:
                if tag in BLOCKS:
                    self.end_line()
                self.pop_to(at)
                return
            if tag in SCOPES:
                return

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.words.append(" ")
        elif tag == "td" or tag == "th":
            self.words.append(" ")
        if tag in BLOCKS:
            self.end_line()
            self.implied_end({"p"})
        if tag in ENDS:
            self.implied_end(ENDS[tag])
        self.tags += 1
        if tag in VOID:
            return
        if tag == "a":
            self.implied_end({"a"})
            self.links += 1
        top = self.stack[-1]
        kind = _kind(tag, attrs)
        marked = tag in ("article", "main") or ("itemprop", "articleBody") in attrs or ("role", "main") in attrs
        if tag == "article" and top.mark is not None and top.mark[0] and any(o.tag == "article" for o in self.stack):
            kind = "comments"  # an article within an article is a reader's, by the standard
        if kind == "header" and top.mark is not None:
            kind = "heading"  # the header of an article: only its headings are content
        if top.kind and (top.kind != "heading" or kind is None) and not (marked and not kind and top.kind in WRAPPERS):
            kind = top.kind
        unseen = top.unseen or tag in UNSEEN or bool(kind and kind != top.kind and kind != "heading" and tag not in BLOCKS)
        region, mark = top.region, top.mark
        if tag in REGIONS or marked:
            region = len(self.parents)
            self.parents.append(top.region)
            self.names.append(tag)
            if marked and not (mark and mark[0]):
                mark = (tag != "main" and ("role", "main") not in attrs, region)
        self.stack.append(_Open(tag, kind, unseen, region, mark))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.end_line()
        elif tag == "td" or tag == "th":
            self.words.append(" ")
        self.tags += 1
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at].tag == tag:
                self.pop_to(at)
                return
            if tag not in BLOCKS and self.stack[at].tag in SCOPES:
                return


def page_lines(html: str) -> PageLines:
    page = PageLines()
    page.feed(html)
    page.close()
    page.end_line()
    return page


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian average over neighbouring lines; beyond the ends there is nothing."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratios, kernel / kernel.sum())[reach:-reach]


def _ancestors(parents, region):
    chain = [region]
    while region:
        region = parents[region]
        chain.append(region)
    return chain


def _smallest_container(page, regions) -> int:
    """The innermost region, lists aside, that holds all of these."""
    common = None
    for region in regions:
        chain = _ancestors(page.parents, region)
        common = chain if common is None else [r for r in common if r in set(chain)]
    return next(r for r in common if page.names[r] not in ("ul", "ol"))


def _clusters(core):
    """(first, past the last) of each run of core lines."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], core.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _in_containers(page, core) -> set:
    """Lines of the smallest containers of the large clusters, for pages that mark no content."""
    lines, taken = page.lines, set()
    clusters = _clusters(core)
    weights = [sum(len(lines[i].text) for i in range(a, b)) for a, b in clusters]
    for (a, b), weight in zip(clusters, weights):
        if weight < LARGE * max(weights):
            continue
        while a > 0 and lines[a - 1].live and lines[a - 1].heading:
            a -= 1
        container = _smallest_container(page, {lines[i].region for i in range(a, b) if lines[i].live})
        inside = [i for i, line in enumerate(lines) if line.live and container in _ancestors(page.parents, line.region)]
        if page.names[container] in ("", "html", "body"):
            inside = [i for i in inside if a <= i < b]  # the whole page: no further than the cluster
        taken.update(i for i in inside if 2 * lines[i].linked <= len(lines[i].text) or a <= i < b)
    if taken:  # between two clusters of content, short lines belong to it
        taken.update(i for i in range(min(taken), max(taken)) if lines[i].live and 2 * lines[i].linked <= len(lines[i].text))
    return taken


def content_lines(page: PageLines) -> list[Line]:
    """The lines of the content regions, in page order."""
    lines = page.lines
    if not any(line.live for line in lines):
        return []
    live = np.array([line.live for line in lines])
    smooth = smoothed(np.array([line.ratio for line in lines]))
    core = live & (smooth > 0) & (smooth >= min(smooth.std(), smooth.mean()))
    at = np.flatnonzero(core).tolist()
    marks = {lines[i].mark for i in (at or np.flatnonzero(live).tolist()) if lines[i].mark is not None}
    articles = {m for m in marks if m[0]}
    if articles:
        holders = {r for _, region in articles for r in _ancestors(page.parents, region)}
        taken = {i for i, line in enumerate(lines) if line.live and (
            line.mark in articles or (line.heading == "h1" and line.mark is not None and line.mark[1] in holders))}
    elif marks:
        taken = {i for i, line in enumerate(lines) if line.live and line.mark in marks}
    elif at:
        taken = _in_containers(page, core)
    else:
        taken = set()
    menus = {}
    for i in taken:
        if lines[i].items is not None:
            menus.setdefault(lines[i].items, []).append(lines[i].linked == sum(len(w) for w in lines[i].text.split()))
    links_only = {items for items, linked in menus.items() if len(linked) > 2 and all(linked)}
    return [lines[i] for i in sorted(taken) if lines[i].items not in links_only]


def extract(html: str) -> str:
    """The main text of one page, one line for each block."""
    return "\n".join(line.text for line in content_lines(page_lines(html)))


def with_main_text(pages: DataFrame, html: str = "html", name: str = "main_text") -> DataFrame:
    """The table without its html column, with the main text in a new column of this name (it
    gets underscores where the table has such a column already).  No row moves: pages are
    parsed where they are read."""
    rest = [c for c in pages.columns if c != html]
    out = spare(pages.select(*rest), name)
    source = pages.select(*rest, pages[html].cast("string").alias(html))
    schema = source.drop(html).withColumn(out, F.lit("")).schema

    def run(batches):
        for batch, texts in slices(batches, html):
            found = pa.array([extract(t) for t in texts.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), found], names=[*rest, out])

    return source.mapInArrow(run, schema)


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    found = with_main_text(pages.select("page_id", "url", "html"), name="text")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
