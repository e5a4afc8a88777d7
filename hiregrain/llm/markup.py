"""Blocks of text of a web page, with the branch of the page's tree that each stands in.

A page is read once, tag by tag, forgiving what browsers forgive: end tags that are missing, wrongly nested or too many, unquoted
attributes, comments and quotes that never end. Elements that shape a page are its branches; inline ones only mark up the text of a block.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import xxhash

from hiregrain.llm.common import worker_cache

# Fixed values of HTML: elements without content, elements whose content isn't markup, elements that begin a block.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
BLOCK = set(
    "address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hgroup legend li main menu nav noscript ol optgroup option p pre search section summary table tbody td template tfoot th thead tr ul".split()
)
FRAME = set("html head body frameset".split())
# An open element of the first kind ends when one of the others begins, unless a boundary lies between.
ENDS_BEFORE = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "thead": ({"caption"}, {"table"}),
    "tfoot": ({"thead", "tbody"}, {"table"}),
}
BOUNDARY = {"table", "td", "th", "caption", "template", "button", "object"}

# What a label says about its branch. The words are a parameter of the method: those that sites use for such parts.
NOISE_TAGS = set("nav footer header aside form fieldset menu search dialog noscript template".split())
NOISE_INLINE = set("button select datalist label output progress meter svg canvas audio video object map".split())
NOISE_WORDS = set(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer header masthead banner ad ads advert adverts advertisement advertising"
    " sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription"
    " signup login social share sharing related recommended recommendations comment comments commentlist respond reply replies disqus form search pagination"
    " pager toolbar widget widgets copyright disclaimer skiplink hidden complementary contentinfo dropdown".split()
)
STATES = set("has no not with without open enabled disabled js".split())  # words that tell of a page's state, not of a part
MAIN_NAMES = set("articlebody articlecontent articletext postbody postcontent entry entrycontent storybody storycontent maincontent pagecontent content main article post story".split())

TOKEN = re.compile(
    r"<(?:!--(?:-?>|(?s:.*?)(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z))"
)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
TELLING = re.compile(r"class|id|role|itemprop|hidden|style", re.IGNORECASE)
NUMBER = re.compile(r"\d{3,}")  # the number of a post, unlike that of a column, is no part of a label
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
LABELS_KEPT = 65_536  # by a worker
DEEPEST = 64  # nodes on a way of the site tree
NOISE, ARTICLE, MAIN, NAMED, NEUTRAL = "noise", 3, 2, 1, 0


def _words(token: str) -> list[str]:
    return [w.lower() for w in WORDS.findall(token)]


def label_of(tag: str, attributes: str) -> tuple[str, str | int]:
    """The element's label and what it says: :data:`NOISE`, how surely it is the main part, or nothing."""
    inline = tag not in BLOCK
    kind: str | int = NOISE if tag in NOISE_TAGS or tag in NOISE_INLINE else {"article": ARTICLE, "main": MAIN}.get(tag, NEUTRAL)
    if not TELLING.search(attributes):
        return tag, kind
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), next((v for v in values if v), ""))
    names = [t for a in ("class", "id", "role") for t in unescape(found.get(a, "")).split()]
    told = {t: _words(t) for t in names}
    label = " ".join([tag, *sorted({NUMBER.sub("#", t.lower()) for t in names})])
    style = found.get("style", "").replace(" ", "").lower()
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
        return label, NOISE
    for words in told.values():
        if STATES.isdisjoint(words) and not NOISE_WORDS.isdisjoint(words if kind == NEUTRAL else words if len(words) == 1 else []):
            return label, NOISE
    if kind == NEUTRAL and not inline:
        joined = {"".join(w) for w in told.values()}
        if found.get("role", "").lower() in ("main", "article"):
            kind = MAIN
        elif found.get("itemprop", "").lower() == "articlebody":
            kind = ARTICLE
        elif not joined.isdisjoint(MAIN_NAMES):
            kind = NAMED
    return label, kind


@dataclass
class Page:
    """The branches of a page, parents before children, and its blocks of text in order. Branch 0 is the page itself."""

    parents: list[int] = field(default_factory=lambda: [-1])
    labels: list[str] = field(default_factory=lambda: [""])
    kinds: list[str | int] = field(default_factory=lambda: [NEUTRAL])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # branch, text, characters inside links

    def open(self, parent: int, label: str, kind: str | int) -> int:
        self.parents.append(parent)
        self.labels.append(label)
        self.kinds.append(kind)
        return len(self.labels) - 1

    def main_parts(self) -> set[int]:
        """The branches that the page's labels call its main part; none if they don't tell.

        An article inside a noisy branch, such as a reader's comment, is main only if nothing else is: some pages are one
        form as a whole.
        """
        noisy: list[bool] = []
        for parent, kind in zip(self.parents, self.kinds):
            noisy.append(parent >= 0 and (noisy[parent] or self.kinds[parent] == NOISE))
        for inside_noise in (False, True):
            for sure in (ARTICLE, MAIN, NAMED):
                found = {i for i, kind in enumerate(self.kinds) if kind == sure and (inside_noise or not noisy[i])}
                if found:
                    return found
        return set()

    def kept(self) -> tuple[list[bool], bool]:
        """Which branches the labels leave, and whether the page names its main part."""
        main = self.main_parts()
        stay: list[bool] = []
        for i, (parent, kind) in enumerate(zip(self.parents, self.kinds)):
            stay.append(i in main or (stay[parent] and kind != NOISE if parent >= 0 else not main))
        return stay, bool(main)

    def nodes(self, stay: list[bool]) -> tuple[list[int], dict[int, list[int]]]:
        """The site tree's node of every branch that stays, the labels on the way down to it, and the way to every node.

        A branch in one of its own label is the same node, and so are branches that lie deeper than :data:`DEEPEST` nodes.
        """
        keys: list[int] = []
        paths: dict[int, list[int]] = {0: []}
        for i, parent in enumerate(self.parents):
            if not stay[i]:
                keys.append(0)
                continue
            above = keys[parent] if parent >= 0 else 0
            if above and (self.labels[i] == self.labels[parent] or len(paths[above]) >= DEEPEST):
                keys.append(above)
                continue
            keys.append(xxhash.xxh64_intdigest(self.labels[i].encode(), above) or 1)
            if keys[i] not in paths:
                paths[keys[i]] = [*paths[above], keys[i]]
        del paths[0]
        return keys, paths


def _close_raw(html: str, tag: str, at: int) -> int:
    end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(html, at)
    return end.end() if end else len(html)


def read_page(html: str) -> Page:
    page = Page()
    labels: dict[tuple[str, str], tuple[str, str | int]] = worker_cache("labels", dict)
    if len(labels) > LABELS_KEPT:
        labels.clear()
    stack: list[tuple[str, int, bool]] = []  # tag, branch it stands in or opens, whether its text is skipped
    pieces: list[str] = []
    linked = links = skipped = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                page.blocks.append((stack[-1][1] if stack else 0, text, linked))
            pieces.clear()
        linked = 0

    def pop(at: int) -> None:
        """Close everything from ``at`` on."""
        nonlocal links, skipped
        for tag, _, skip in stack[at:]:
            links -= tag == "a"
            skipped -= skip
        del stack[at:]

    def open_at(tags: set[str], boundary: set[str]) -> int:
        for at in range(len(stack) - 1, -1, -1):
            if stack[at][0] in tags:
                return at
            if stack[at][0] in boundary:
                break
        return -1

    at, size = 0, len(html)
    while at < size:
        found = TOKEN.search(html, at)
        start = found.start() if found else size
        if start > at and not skipped:
            piece = unescape(html[at:start])
            pieces.append(piece)
            if links:
                linked += len(piece.strip())
        if not found:
            break
        at = found.end()
        closing, tag, attributes = found.groups()
        if tag is None:
            continue
        tag = tag.lower()
        block = tag in BLOCK
        if tag in FRAME:
            flush()
        elif closing and tag != "br":
            where = open_at({tag}, BOUNDARY - {tag} if block else set())
            if where < 0:
                if block:
                    flush()
            elif block or not any(t in BLOCK for t, _, _ in stack[where + 1 :]):
                if block:
                    flush()
                pop(where)
            else:  # an inline element that ends inside a block which began in it
                links -= tag == "a"
                skipped -= stack[where][2]
                del stack[where]
        elif tag in VOID or tag == "br":
            if tag == "hr":
                flush()
            pieces.append(" " if tag in ("br", "hr") else "")
        elif tag in RAW:
            at = _close_raw(html, tag, at)
        else:
            if block:
                flush()
                where = open_at({"p"}, BOUNDARY)
                if where >= 0:
                    pop(where)
                if tag in ENDS_BEFORE:
                    where = open_at(*ENDS_BEFORE[tag])
                    if where >= 0:
                        pop(where)
            if (tag, attributes) not in labels:
                labels[tag, attributes] = label_of(tag, attributes)
            label, kind = labels[tag, attributes]
            branch = stack[-1][1] if stack else 0
            if attributes.endswith("/") and not block:
                continue
            if block:
                stack.append((tag, page.open(branch, label, kind), False))
            else:
                stack.append((tag, branch, kind == NOISE))
                skipped += kind == NOISE
                links += tag == "a"
    flush()
    return page
