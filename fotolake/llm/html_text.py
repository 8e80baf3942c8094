"""Main text of web pages by tag-path ratios.

A page is read as a sequence of text nodes, each with its tag path: the names, ids and classes of the open elements
from the root down. Numbers in them are dropped, so that alike nodes share a path. For each path the text length and
the punctuation of its nodes are added up; the text ratio is length per node, the punctuation ratio punctuation per
node, and each is lowered by the share of link text. Over the sequence of nodes both are smoothed by a Gaussian window,
so that a short node among content keeps a content value, and fused into one product. The threshold is the standard
deviation of the fused values; a path is content if the mean of its nodes reaches it. No node of such a path is dropped.
Content paths lie in one region: the article or main element around them all, or one that holds most of their length, or
else the deepest block around them all. Every other path in that region is taken too, and so are headings before it in
the same parent, because nothing of the article is to be lost.

Elements that are never an article's text are not read at all: scripts, styles, forms, menus, page headers and footers,
sidebars, adverts, notices and comments, known by tag, role, id or class. In a class or id the head counts: `sidebar`,
`site-footer`, `comments-area` or `relatedPosts`, not `has-sidebar`. Names only take away; what is taken is decided by the
ratios. No such name skips html, body, main or article, nor an element with most of the
page's text unless an article or main element has text besides. If nothing reaches the threshold, the region
is the whole body.

NULL and empty pages give the empty text; so do pages without text. Repeated rows and ties need no rule: each page
is judged alone, and of two regions with equal length the first one stands. Long pages are read once, in time
proportional to their length. Columns named `text` or `n_chars` are replaced, others pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fotolake.llm.common import texts_of, with_fields

# Element names of HTML and words that name what is not an article.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas"}
SKIPPED = {"nav", "footer", "aside", "form", "head", "menu", "dialog", "button", "select", "label", "fieldset", *RAW}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSED_BY = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
OTHER = {
    "ad", "ads", "advert", "adverts", "advertisement", "adsense", "banner", "sponsor", "sponsored", "promo", "breadcrumb", "breadcrumbs", "comment",
    "comments", "commentlist", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "disclaimer", "footer", "foot", "header", "masthead",
    "menu", "nav", "navbar", "navigation", "newsletter", "subscribe", "popup", "modal", "related", "recommended", "share", "sharing", "social",
    "sidebar", "side", "widget", "toolbar", "login", "signup", "search", "reply", "replies", "respond", "disqus", "copyright", "skip", "pager", "pagination",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PARTS = {"p", "ul", "ol", "li", "blockquote", "pre", "table", "dl", "dt", "dd", "td", "th", "tr", "tbody"}
#: What only says that something is a part, and what says that the page has (or has not) something.
GENERIC = {"area", "list", "container", "wrapper", "wrap", "section", "box", "block", "inner", "outer", "holder", "links", "posts", "articles", "items", "item", "bar", "form", "panel", "row", "thread", "stream", "text", "buttons", "icons", "slot", "unit", "zone"}
LAYOUT = {"has", "no", "with", "without", "is", "not", "js", "page", "single", "hide", "show"}
#: Words of OTHER that name something else only alone: an article has headers, sides and notices of its own.
ALONE = {"header", "foot", "side", "search", "notice", "notices", "skip", "promo", "banner", "copyright", "reply"}
#: Elements that no name makes something else than the page or its article.
WHOLE = {"html", "body", "main", "article"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert"}

#: Standard deviations of the fused values that make the threshold.
DEVIATIONS = 1.0

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=[\s/>\"']|$)", re.I)
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[,.;:!?…。，、；：！？¿¡]")
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")


def _names_other(token: str) -> bool:
    """Whether a class or id names what is not an article's text: all its words do, or its head does, the last word that says more than that it is a part."""
    own = _NAME.findall(_CAMEL.sub("-", token).lower())
    if own and all(n in OTHER for n in own):
        return True
    while own and own[-1] in GENERIC:
        own.pop()
    if not own or own[0] in LAYOUT:
        return False
    return own[-1] in OTHER and own[-1] not in ALONE


def _attributes(source: str) -> tuple[str, bool, bool]:
    """What names the element, whether it is hidden, and whether its names mean that it is not an article's text."""
    if not source or source.isspace():
        return "", False, False
    names, hidden, skip = [], False, False
    for key, value in _ATTRIBUTE.findall(source):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            hidden = True
        elif key == "role":
            skip |= value.lower() in ROLES
        elif key in ("class", "id"):
            skip |= any(_names_other(token) for token in value.split())
            names.append(_DIGITS.sub("", value.lower()))
    return "." + " ".join(names) if names else "", hidden, skip


def nodes_of(html: str) -> list[tuple[tuple[str, ...], int, bool, str]]:
    """Text nodes that may be content: path, number of their block, whether in a link, raw text."""
    out: list[tuple[tuple[str, ...], int, bool, str]] = []
    of: list[int] = []  # of each text node: the innermost element around it that its name alone would skip
    outer = [-1]  # of each such element, from 1 on: the one around it
    names: list[str] = []  # open elements
    places: dict[str, list[int]] = {}  # by name: where in the list they are
    blocks: list[int] = []  # those that are not inline
    named: list[int] = []  # of each open element: the innermost one, itself included, that its name alone would skip
    path: tuple[str, ...] = ()
    skipped: list[bool] = []  # of each open element: it and what is inside does not count
    links = block = at = 0
    raw_end = None

    def close(to: int) -> None:
        nonlocal path, links, block
        while len(names) > to:
            name = names.pop()
            places[name].pop()
            if name not in INLINE:
                blocks.pop()
            skipped.pop()
            named.pop()
            path = path[:-1]
            links -= name == "a"
            block += name not in INLINE

    def text(piece: str) -> None:
        if piece and not (skipped and skipped[-1]):
            out.append((path, block, links > 0, piece))
            of.append(named[-1] if named else 0)

    for found in _TAG.finditer(html):
        if raw_end is not None:
            if found.start() < raw_end:
                continue
            raw_end = None
        if found.start() > at:
            text(html[at : found.start()])
        at = max(at, found.end())
        closing, name, rest = found.group(1), found.group(2), found.group(3)
        if name is None:
            if found.group().startswith("<![CDATA["):
                text(found.group()[9:-3])
            continue
        name = name.lower()
        if closing:
            if name == "p" and not places.get("p"):
                block += 1
            # a stray end of an inline element does not end its block
            if places.get(name) and not (name in INLINE and blocks and blocks[-1] > places[name][-1]):
                close(places[name][-1])
            continue
        label, skip, by_name = _attributes(rest)
        if name in ENDS_P or name in CLOSED_BY:
            ends = CLOSED_BY.get(name, set()) | ({"p"} if name in ENDS_P else set())
            for i in range(len(names) - 1, -1, -1):
                if names[i] in ends:
                    close(i)
                    break
                if names[i] not in INLINE and names[i] not in ("p", "dd", "dt", "td", "th", "li"):
                    break
        if name == "br":
            text(" ")
            continue
        if name not in INLINE:
            block += 1
        if name in VOID or rest.rstrip().endswith("/"):
            continue
        skip |= name in SKIPPED or (name == "header" and not places.get("article") and not places.get("main")) or name in RAW
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}\\s*>", re.I).search(html, at)
            raw_end = at = end.end() if end else len(html)
            continue
        places.setdefault(name, []).append(len(names))
        if name not in INLINE:
            blocks.append(len(names))
        names.append(name)
        around = named[-1] if named else 0
        if by_name and name not in WHOLE:
            outer.append(around)
            around = len(outer) - 1
        named.append(around)
        skipped.append(skip or bool(skipped and skipped[-1]))
        path = (*path, name + label)
        links += name == "a"
    if at < len(html) and raw_end is None or raw_end is not None and raw_end < len(html) and at < len(html):
        text(html[at:])
    return _without(out, of, outer)


def _without(nodes: list[tuple[tuple[str, ...], int, bool, str]], of: list[int], outer: list[int]) -> list[tuple[tuple[str, ...], int, bool, str]]:
    """The nodes outside elements skipped by name.

    An element with most of the page's text is not skipped, unless an article or main element has text besides."""
    if len(outer) == 1:
        return nodes
    shown = [len(n[3].strip()) for n in nodes]
    skip = [k > 0 for k in range(len(outer))]
    if not any(n and k == 0 and any(p.partition(".")[0] in ("article", "main") for p in node[0]) for n, k, node in zip(shown, of, nodes)):
        held = [0] * len(outer)
        for n, k in zip(shown, of):
            held[k] += n
        for k in range(len(outer) - 1, 0, -1):
            held[outer[k]] += held[k]
        skip = [k > 0 and 2 * held[k] <= sum(shown) for k in range(len(outer))]
    for k in range(1, len(outer)):
        skip[k] |= skip[outer[k]]
    return [node for node, k in zip(nodes, of) if not skip[k]]


def _smooth(x: np.ndarray, radius: int = 1) -> np.ndarray:
    """Gaussian window over the sequence; at its ends the window is cut and weighed anew."""
    offsets = np.arange(-radius, radius + 1)
    weights = np.exp(-(offsets**2) / (2.0 * radius * radius))
    total, norm = np.convolve(x, weights, "same"), np.convolve(np.ones_like(x), weights, "same")
    return total[: len(x)] / norm[: len(x)]


def _element(part: str) -> str:
    return re.match(r"[^.]*", part)[0]


def _region(paths: list[tuple[str, ...]], lengths: np.ndarray) -> tuple[str, ...]:
    """The article or main element around all paths; else one that holds most of the length; else the deepest block around all paths."""
    low, high = min(paths), max(paths)
    depth = 0
    while depth < min(len(low), len(high)) and low[depth] == high[depth]:
        depth += 1
    common = low[:depth]
    for d in range(depth, 0, -1):
        if _element(common[d - 1]) in ("article", "main"):
            return common[:d]
    held: dict[tuple[str, ...], float] = {}
    for p, n in zip(paths, lengths):
        for d in range(depth, len(p)):
            if _element(p[d]) in ("article", "main"):
                held[p[: d + 1]] = held.get(p[: d + 1], 0) + n
    most = [r for r, n in held.items() if n >= 0.6 * lengths.sum()]
    if most:
        return max(most, key=len)
    # a paragraph is no region, even if it holds all of the text
    while common and (name := _element(common[-1])) and (name in INLINE or name in PARTS or name in HEADINGS):
        common = common[:-1]
    return common


def main_text(html: str) -> str:
    nodes = [(p, b, link, t) for p, b, link, t in nodes_of(html)]
    shown = [i for i, n in enumerate(nodes) if not n[3].isspace()]
    if not shown:
        return ""
    texts = [_SPACE.sub(" ", unescape(nodes[i][3])) for i in shown]
    paths = [nodes[i][0] for i in shown]
    number: dict[tuple[str, ...], int] = {}
    of = np.array([number.setdefault(p, len(number)) for p in paths])
    length = np.array([len(t.strip()) for t in texts], float)
    marks = np.array([len(_PUNCTUATION.findall(t)) for t in texts], float)
    linked = np.array([length[k] if nodes[i][2] else 0.0 for k, i in enumerate(shown)])
    count = np.bincount(of)
    share = np.bincount(of, linked) / np.maximum(np.bincount(of, length), 1)
    text_ratio, mark_ratio = np.bincount(of, length) / count * (1 - share), np.bincount(of, marks) / count * (1 - share)
    fused = _smooth(text_ratio[of]) * _smooth(mark_ratio[of])
    content = np.bincount(of, fused) / count >= max(DEVIATIONS * fused.std(), 1e-9 if DEVIATIONS > 0 else -1.0) if len(number) > 1 else np.ones(1, bool)
    chosen = content[of]
    if not chosen.any():
        chosen[:] = True
    ids = list(number)
    per_path = np.bincount(of, np.where(chosen, length, 0))
    region = _region([ids[k] for k in range(len(ids)) if per_path[k]], per_path[per_path > 0])
    depth = len(region)
    selected = {ids[k] for k in range(len(ids)) if per_path[k]}
    # headings before the region in the same parent are the article's
    start = next(i for i in shown if nodes[i][0][:depth] == region)
    above = region[:-1]

    def kept(i: int, path: tuple[str, ...]) -> bool:
        if path[:depth] == region or path in selected:
            return True
        return i < start and len(path) >= depth > 0 and path[: depth - 1] == above and _element(path[depth - 1]) in HEADINGS

    # nodes in page order; a block's pieces are joined as they stand
    blocks: list[list[str]] = []
    last = None
    for i, (path, block, _, piece) in enumerate(nodes):
        if kept(i, path):
            if block != last:
                blocks.append([])
                last = block
            blocks[-1].append(piece)
    joined = (_SPACE.sub(" ", unescape("".join(b))).strip() for b in blocks)
    return "\n\n".join(b for b in joined if b)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with `text`, the blocks of the article with an empty line between, and `n_chars`."""
    base = pages.drop("text", "n_chars") if html != "text" else pages
    at = base.columns.index(html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [main_text(t.decode("utf-8", "replace")) for t in texts_of(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string()), pa.array([len(m) for m in made], pa.int64())], [*batch.schema.names, "text", "n_chars"])

    return base.mapInArrow(run, with_fields(base.schema, ("text", "string"), ("n_chars", "long")))
