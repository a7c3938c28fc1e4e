"""Main text of web pages by composite text density.

A tolerant parser builds the node list of a page. What is never article text (scripts, forms, navigation, adverts,
comments and so on, by element) is pruned while parsing. A form, and what a role, class or id marks, is pruned after a
first measure of the whole tree, unless that shows the article to be in it. For every node left, the density is its characters per tag,
lowered by the share of characters and tags in links. The node whose children's densities add up to most is the article;
the least density on its path to the body is the threshold over which other subtrees count as article too.

Defined cases: null, empty and tagless html (an empty or plain text comes out); unclosed and misnested tags, stray end
tags, broken character references and nesting of any depth; a page without article text gives an empty text.
"""

from __future__ import annotations

import bisect
import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ddl, slices

# Element names of HTML by role, and words of class, id and role attributes that mark what is no article
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead "
    "tr ul caption".split()
)
CELL = frozenset("td th br img".split())
WALLS = (BLOCK - {"p"}) | {"td", "th", "button"}
CLOSES_P = BLOCK - frozenset("option optgroup tbody thead tfoot tr caption legend body html".split())
NOISE_TAGS = frozenset("head script style noscript template nav aside footer button select textarea input iframe svg canvas object embed dialog menu".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer comment comments disqus reply replies cookie cookies consent notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup social share sharing related recommended widget masthead toolbar pagination pager login "
    "contentinfo complementary search hidden".split()
)
DENIED = frozenset("no not non without has have with".split())  # a keyword behind these names a layout, not the element
HEADERS = frozenset("header masthead banner".split())
KEPT = frozenset("html body article main".split())
IN_HEAD = frozenset("html head title base basefont bgsound link meta style script noscript noframes template".split())  # all else ends an open head
SAME = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select datalist"), "tbody": ("tbody thead tfoot tr td th", "table"), "thead": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table")}
SAME = {tag: (frozenset(a.split()), frozenset(b.split())) for tag, (a, b) in SAME.items()}

MARKUP = re.compile(r"""<!--(?:.*?-->|.*)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>?""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*+(?:=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""", re.I)
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _noise(tag: str, attrs: str, inside: bool) -> int:
    """2 never article text, 1 none as far as a form, class, id or role tells, 0 else. inside: within an article or main
    element, where a header holds the heading."""
    if tag in NOISE_TAGS or (tag == "header" and not inside):
        return 2
    if tag in KEPT:
        return 0
    kind = int(tag == "form")
    for name, value in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" and value != "false" or name == "aria-hidden" and value == "true" or name == "style" and HIDING.search(value):
            return 2
        if name in ("class", "id", "role"):
            for token in value.split():
                for word in re.split(r"[^a-z0-9]+", token):
                    if word in DENIED:
                        break
                    if word in NOISE_WORDS or (word in HEADERS and not inside):
                        kind = 1
    return kind


class Page:
    """Nodes of a page as parallel lists in page order, so that children come after their parents; pruned parts are left out."""

    def __init__(self, source: str):
        self.tag, self.parent = ["html"], [-1]
        self.marked: list[int] = []  # nodes that a form, class, id or role marks as noise
        self.runs: list[tuple[int, str]] = []  # text by node
        self.breaks: list[tuple[int, int, int]] = []  # (position in runs, 1 block or 0 space, node it lies in)
        stack, skip, inside = [0], 0, 0  # skip: depth in the stack of the pruned element we are in
        self.open: dict[str, list[int]] = {}  # depths of the open elements of a name, all but the first of the stack
        self.walls: list[int] = []  # depths of those that an open paragraph ends at
        at, size = 0, len(source)
        while at < size:
            m = MARKUP.search(source, at)
            end = m.start() if m else size
            if skip and self.tag[stack[-1]] == "head" and source[at:end].strip():
                skip = self._end_head(stack, skip)
            if end > at and not skip:
                self.runs.append((stack[-1], entities.unescape(source[at:end])))
            if not m:
                break
            at = max(m.end(), at + 1)
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                if tag in ("p", "br") and not skip:
                    self._cut(tag, stack[-1])
                depth = self._last(tag)
                if depth:
                    for i in stack[depth:]:
                        inside -= self.tag[i] in ("article", "main")
                        if not skip or skip > depth:
                            self._cut(self.tag[i], stack[depth - 1])
                    self._close(stack, depth)
                    if skip >= depth:
                        skip = 0
                continue
            if tag in ("html", "body") and self._last(tag):
                continue
            if skip and (tag in ("body", "frameset") or (tag not in IN_HEAD and self.tag[stack[-1]] == "head")):
                skip = self._end_head(stack, skip)
            depth = self._implied(tag)
            if depth is not None:
                for i in stack[depth:]:
                    inside -= self.tag[i] in ("article", "main")
                self._close(stack, depth)
                if skip and depth <= skip:
                    skip = 0
            attrs = m[3] or m[6] or ""
            kind = 0 if skip else _noise(tag, attrs, inside > 0)
            noise = kind == 2
            if not skip:
                self._cut(tag, stack[-1])
            closed = tag in VOID
            if tag in RAW and not closed:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(source, at)
                if not (kind or skip) and tag not in ("title",):
                    self.runs.append((stack[-1], source[at : end.start() if end else size]))
                at = end.end() if end else size
                continue
            if not skip and not noise:
                if kind:
                    self.marked.append(len(self.tag))
                self.tag.append(tag)
                self.parent.append(stack[-1])
            if closed:
                continue
            if noise or skip:
                self.tag.append(tag)
                self.parent.append(-2)  # pruned: kept on the stack only
                self._enter(stack)
                skip = skip or len(stack) - 1
            else:
                self._enter(stack)
                inside += tag in ("article", "main")

    def _enter(self, stack: list[int]) -> None:
        """Puts the newest node on the stack."""
        tag = self.tag[-1]
        self.open.setdefault(tag, []).append(len(stack))
        if tag in WALLS:
            self.walls.append(len(stack))
        stack.append(len(self.tag) - 1)

    def _close(self, stack: list[int], depth: int) -> None:
        """Takes all from a depth on off the stack."""
        for i in stack[depth:]:
            self.open[self.tag[i]].pop()
        while self.walls and self.walls[-1] >= depth:
            self.walls.pop()
        del stack[depth:]

    def _last(self, tag: str) -> int:
        """Depth of the innermost open element of a name, or 0."""
        found = self.open.get(tag)
        return found[-1] if found else 0

    def _end_head(self, stack: list[int], skip: int) -> int:
        """Drops an open head from the stack, as its end tag may be left out; the depth of pruning after it."""
        found = self.open.get("head")
        if not found:
            return skip
        depth = found[0]
        self._close(stack, depth)
        return 0 if depth <= skip else skip

    def _cut(self, tag: str, node: int) -> None:
        if tag in BLOCK:
            self.breaks.append((len(self.runs), 1, node))
        elif tag in CELL:
            self.breaks.append((len(self.runs), 0, node))

    def _implied(self, tag: str) -> int | None:
        """Depth from which a start tag ends open elements (an open paragraph, a list item before the next one)."""
        found = None
        if tag in CLOSES_P:
            depth = self._last("p")
            if depth and depth > (self.walls[-1] if self.walls else 0):
                found = depth
        if tag in SAME:
            ends, bounds = SAME[tag]
            wall = max(map(self._last, bounds))
            outermost = [depths[k] for name in ends if (depths := self.open.get(name)) and (k := bisect.bisect_right(depths, wall)) < len(depths)]
            found = min(outermost, default=found)
        return found


def _prune(page: Page) -> None:
    """Takes marked elements out, but not one that holds the article: the subtree of the largest density sum, most of the
    body's characters outside links, or the article or main elements of a page that has none elsewhere. Where a page has
    such an element outside of all marked ones, marked ones beside it (comments, other articles) go whatever their size."""
    if not page.marked:
        return
    n = len(page.tag)
    measured = _content(page, prune=True)
    if measured is None:
        return
    top, own, body = measured
    marked = set(page.marked)
    below, within, holds = [False] * n, [False] * n, [False] * n  # in a marked element; in a plain article; holds an article
    plain = False
    for i in range(1, n):
        p = page.parent[i]
        if p < 0:
            continue
        below[i] = below[p] or i in marked
        article = page.tag[i] in ("article", "main") and own[i] > 0
        holds[i] = article
        within[i] = within[p] or (article and not below[i])
        plain = plain or (article and not below[i])
    for i in range(n - 1, 0, -1):
        if page.parent[i] >= 0 and holds[i]:
            holds[page.parent[i]] = True
    best = set()
    while top >= 0:
        best.add(top)
        top = page.parent[top]
    gone = [False] * n
    for i in range(1, n):
        if (p := page.parent[i]) < 0:
            continue
        kept = (within[i] or not plain) and (i in best or 2 * own[i] > own[body] or (holds[i] and not plain))
        gone[i] = gone[p] or (i in marked and not kept)
    for i in range(1, n):
        if gone[i]:
            page.parent[i] = -2


def _content(page: Page, prune: bool = False):
    """Nodes whose whole subtrees are article text; with ``prune``, instead, (node of the largest density sum, characters
    outside links of every subtree, body), or None without characters."""
    n = len(page.tag)
    chars, tags, link_chars, link_tags, linked = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
    for i in range(1, n):
        linked[i] = page.parent[i] >= 0 and (page.tag[i] == "a" or linked[page.parent[i]])
    for node, text in page.runs:
        size = len("".join(text.split()))
        chars[node] += size
        if linked[node]:
            link_chars[node] += size
    for i in range(n - 1, 0, -1):
        if (p := page.parent[i]) >= 0:
            chars[p] += chars[i]
            link_chars[p] += link_chars[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (page.tag[i] == "a")
    body = next((i for i in range(n) if page.tag[i] == "body" and page.parent[i] >= 0), 0)
    if not chars[0]:
        return None if prune else set()
    if not chars[body]:
        body = 0
    ratio = link_chars[body] / chars[body]
    density, sums = [0.0] * n, [0.0] * n
    for i in range(n):
        if chars[i]:
            c, t, lc, lt = chars[i], max(tags[i], 1), link_chars[i], link_tags[i]
            base = math.log(c * lc / max(c - lc, 1) + ratio * c + math.e)
            gain = math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0))
            density[i] = c / t * gain / max(math.log(base), 1.0)
    block = [i == 0 or name in BLOCK for i, name in enumerate(page.tag)]  # inline elements count as tags of their block only
    for i in range(n - 1, 0, -1):
        if (p := page.parent[i]) >= 0:
            sums[p] += density[i] if block[i] else sums[i]
    for i in range(n):
        sums[i] = max(sums[i], density[i]) if block[i] else -1.0
    best = [(s, -i) for i, s in enumerate(sums)]  # best sum in each subtree; the outermost node wins a tie
    for i in range(n - 1, 0, -1):
        if (p := page.parent[i]) >= 0:
            best[p] = max(best[p], best[i])
    inner = [False] * n  # below the body
    inner[body] = True
    for i in range(body + 1, n):
        inner[i] = page.parent[i] >= 0 and inner[page.parent[i]]
    top = -best[body][1]
    if prune:
        return top, [c - lc for c, lc in zip(chars, link_chars, strict=True)], body
    threshold, i = density[top], top
    while i != body and i > 0:
        i = page.parent[i]
        threshold = min(threshold, density[i])
    chosen: set[int] = set()
    covered = [False] * n
    for i in range(n):
        if page.parent[i] >= 0 and covered[page.parent[i]]:
            covered[i] = True
            continue
        if inner[i] and block[i] and chars[i] and density[i] >= threshold:
            chosen.add(-best[i][1])
        covered[i] = i in chosen
    return chosen


def main_text(source: str | None) -> str:
    """The article of one page: blocks in page order joined by a line feed, white space inside a block as one blank."""
    if not source:
        return ""
    page = Page(source)
    _prune(page)
    chosen = _content(page)
    take = [False] * len(page.tag)
    for i in range(len(take)):
        take[i] = i in chosen or (page.parent[i] >= 0 and take[page.parent[i]])
    blocks: list[list[str]] = [[]]
    cut = 0
    for k, (node, text) in enumerate(page.runs):
        while cut < len(page.breaks) and page.breaks[cut][0] <= k:
            if page.parent[page.breaks[cut][2]] == -2:
                pass
            elif page.breaks[cut][1]:
                blocks.append([])
            else:
                blocks[-1].append(" ")
            cut += 1
        if take[node]:
            blocks[-1].append(text)
    return "\n".join(line for b in blocks if (line := " ".join("".join(b).split())))


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """All other columns of ``pages`` plus text and n_chars (code points) of every row."""
    names = [c for c in pages.columns if c not in (column, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(x.as_py()) for x in batch.column(len(names))]
            cols = [batch.column(i) for i in range(len(names))] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "text", "n_chars"])

    kept = pages.select(*names)
    return pages.select(*names, column).mapInArrow(run, ", ".join(x for x in (ddl(kept), "text string, n_chars long") if x))
