"""Main text of web pages by scoring the element tree.

Tags are read in one pass into a tree with the end tags that HTML implies. Parts that are never article
text (menus, headers, footers, sidebars, forms, scripts, notices, adverts, comments) are left out by tag,
role or the words of their class and id. A part named like a frame of the page (header, sidebar, form and the like)
is left out only if it holds no more than half of the page's unlinked paragraph points, since wrappers of whole pages
bear such names too. Every remaining paragraph passes points for its length and its
commas to its container in full, to the next in half and on in thirds, sixths and so on for ``LEVELS`` containers; a container's
points are discounted by the share of link text. The container with most points is kept, or the nearest
article or main element around it as a whole, and those of its siblings that reach a fifth of its points, are
headings, paragraphs that are long or end like a sentence and have no links, or articles beside an article.

Defined cases: null or empty html, and pages of left-out parts only, give empty text; tags left open
end with their parents; an unfinished comment or script runs to the end; unknown character references
stay as they are; repeated rows are each extracted; other columns pass through.
"""

from __future__ import annotations

import html as html_module
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm import words as W

# Element names of HTML and words of class names that mark boilerplate or content.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LEAF_BLOCKS = _HEADINGS | frozenset("p pre li dd dt blockquote figcaption summary legend td th".split())
_RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
_LEFT_OUT = _RAW | frozenset("head nav footer aside button select option noscript svg math canvas template dialog object audio video menu search".split())
_ROLES = frozenset("navigation banner complementary contentinfo search dialog alertdialog alert menu menubar form".split())
_BAD_WORDS = frozenset(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header masthead menu "
    "modal nav navbar navigation newsletter notice notices pagination popup promo promotion related replies respond share sharing sidebar social "
    "sponsor sponsored subscribe toolbar widget".split())
# Names of frames, which wrappers of whole pages bear too; words that turn a class into a statement about the page; wholes whose header is their own.
_FRAMES = frozenset("banner breadcrumb breadcrumbs footer header masthead menu nav navbar navigation pagination promo promotion related share sharing sidebar social toolbar widget".split())
_STATES = frozenset("closed disabled enabled has is no off open with without".split())
_WHOLES = frozenset("article entry post story".split())
_GOOD_WORDS = frozenset("article body content entry main page post story text blog".split())
_IMPLIED = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"},
}
_FENCES = frozenset("table ul ol dl menu article section div body td th".split())

# Quotes count only behind an equals sign, as in HTML; elsewhere they are characters like any other.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|=(?>\s*(?:\"[^\"]*\"|'[^']*'))?)*+)>", re.S)
# Each attribute with its value, so that neither values nor longer names are searched for the names that count.
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
_JUDGED = frozenset("class id role aria-hidden hidden style".split())
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_SENTENCE_END = re.compile(r"[.!?\u2026\u3002\uFF01\uFF1F][\"')\]\u201D\u2019]*\Z")
LEVELS = 16


class _Node:
    __slots__ = ("tag", "parent", "points", "prose", "chars", "link_chars", "weight", "dropped", "frame", "last")

    def __init__(self, tag: str, parent: _Node | None, dropped: bool, weight: int, frame: bool = False) -> None:
        self.tag, self.parent, self.dropped, self.weight, self.frame = tag, parent, dropped, weight, frame
        self.points = self.prose = 0.0
        self.chars = self.link_chars = 0
        self.last = ""


def _named(value: str, in_article: bool) -> tuple[bool, bool]:
    """(boilerplate, frame) by the words of each name in a class or id."""
    bad = frame = False
    for name in value.split():
        words = set(_WORD.findall(name))
        found = words & _BAD_WORDS
        if not found or words & _STATES or found == {"header"} and (in_article or words & _WHOLES):
            continue
        if found <= _FRAMES:
            frame = True
        else:
            bad = True
    return bad, frame


def _judge(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool, int]:
    """(left out, frame, points given or taken beforehand) of an element by its tag and attributes."""
    weight = {"article": 25, "main": 25, "section": 5, "div": 5}.get(tag, 0)
    frame = tag == "form"
    if tag in _LEFT_OUT or tag == "header" and not in_article:
        return True, False, 0
    if attributes:
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name = name.lower()
            if name not in _JUDGED:
                continue
            value = (a or b or c).lower()
            if name == "role" and value == "form":
                frame = True
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in _ROLES \
                    or name == "style" and "display:none" in value.replace(" ", ""):
                return True, False, 0
            if name in ("class", "id"):
                if tag not in ("html", "body", "article", "main"):
                    bad, named = _named(value, in_article)
                    if bad:
                        return True, False, 0
                    frame |= named
                weight += 25 * bool(set(_WORD.findall(value)) & _GOOD_WORDS)
    return False, frame, weight


def _blocks(page: str) -> tuple[list[_Node], list[tuple[_Node, str, int]]]:
    """All elements in page order, and (element, text, characters in links) of each run of text between block tags."""
    root = _Node("html", None, False, 0)
    nodes, stack, out, text, linked = [root], [root], [], [], 0
    links = articles = 0
    still_open: Counter[str] = Counter()

    def flush() -> None:
        nonlocal linked
        if text:
            joined = _SPACE.sub(" ", html_module.unescape("".join(text))).strip()
            owner = next((n for n in reversed(stack) if n.tag in _BLOCK), root)
            if joined and not owner.dropped and not stack[-1].dropped:
                out.append((owner, joined, min(linked, len(joined))))
            text.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal links, articles
        while len(stack) > depth:
            node = stack.pop()
            still_open[node.tag] -= 1
            links -= node.tag == "a"
            articles -= node.tag in ("article", "main")

    at = 0
    while True:
        found = _TOKEN.search(page, at)
        piece = page[at:found.start() if found else len(page)]
        if piece and not stack[-1].dropped:
            text.append(piece)
            if links:
                linked += len(piece)
        if not found:
            break
        at = found.end()
        tag = found[2] and found[2].lower()
        if not tag:
            continue
        if found[1]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0) if still_open[tag] else 0
            if depth:
                if tag in _BLOCK or any(n.tag in _BLOCK for n in stack[depth:]):
                    flush()
                close(depth)
            continue
        if tag == "br":
            text.append(" ")
        if tag in _BLOCK:
            flush()
            if tag not in ("html", "body") and still_open["p"]:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p"), 0)
                if depth:
                    close(depth)
        if tag in _IMPLIED:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in _IMPLIED[tag]:
                    flush()
                    close(i)
                    break
                if stack[i].tag in _FENCES:
                    break
        if tag in _VOID:
            continue
        dropped, frame, weight = _judge(tag, found[3], articles > 0)
        if dropped and tag not in _BLOCK and tag not in _RAW:
            text.append(" ")
        stack.append(_Node(tag, stack[-1], dropped or stack[-1].dropped, weight, frame))
        nodes.append(stack[-1])
        still_open[tag] += 1
        links += tag == "a"
        articles += tag in ("article", "main")
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
            at = end.start() if end else len(page)
    flush()
    return nodes, out


def _points(text: str) -> float:
    return 1 + text.count(",") + min(len(text) / 100, 3)


def _without_frames(nodes: list[_Node], blocks: list[tuple[_Node, str, int]]) -> list[tuple[_Node, str, int]]:
    """Blocks outside the frames that do not hold the page; blocks are judged by paragraphs alone."""
    if not any(n.frame for n in nodes):
        return blocks
    total = 0.0
    for node, text, linked in blocks:
        if node.tag in _LEAF_BLOCKS:
            worth = _points(text) * (1 - linked / len(text))
            node.prose += worth
            total += worth
    # An element stands behind its parent, so sums are whole before they are passed on.
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.prose += node.prose
    for node in nodes:
        if node.parent is not None and node.parent.dropped or node.frame and node.prose * 2 <= total:
            node.dropped = True
    return [b for b in blocks if not b[0].dropped]


def _closes(text: str) -> bool:
    """Ends like a sentence and is no copyright line."""
    return bool(_SENTENCE_END.search(text)) and not text.lower().startswith(("\u00A9", "copyright", "(c)"))


def extract(page: str | None) -> str:
    """Main text of one page, its blocks joined by empty lines."""
    nodes, blocks = _blocks(page) if page else ([], [])
    blocks = _without_frames(nodes, blocks)
    if not blocks:
        return ""
    seen: dict[_Node, None] = {}
    for node, text, linked in blocks:
        points = _points(text)
        node.chars += len(text)
        node.link_chars += linked
        node.last = text
        target = node.parent if node.tag in _LEAF_BLOCKS and node.parent is not None else node
        for level in range(LEVELS):
            target.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            seen[target] = None
            target = target.parent
            if target is None:
                break
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.link_chars += node.link_chars
    score = {n: (n.points + n.weight) * (1 - n.link_chars / max(n.chars, 1)) for n in seen}
    best = max(seen, key=lambda n: score[n])
    # An article is kept whole, whichever of its inner containers has most points.
    around = best
    while around is not None and around.tag not in ("article", "main"):
        around = around.parent
    best = around or best

    def kept(node: _Node) -> bool:
        if node is best:
            return True
        if node.parent is not best.parent or best.parent is None:
            return False
        density = node.link_chars / max(node.chars, 1)
        return (node in score and score[node] >= max(10, 0.2 * score[best])) or (node.tag in _HEADINGS and density < 0.3) or (
            node.tag == "p" and (node.chars > 80 and density < 0.25 or not node.link_chars and _closes(node.last))) or (
            node.tag == best.tag == "article" and density < 0.25)

    verdict: dict[_Node, bool] = {}
    chosen = []
    for node, text, _ in blocks:
        path, at = [], node
        while at is not None and at not in verdict:
            path.append(at)
            at = at.parent
        inside = verdict[at] if at is not None else False
        for step in reversed(path):
            inside = verdict[step] = inside or kept(step)
        if inside:
            chosen.append(text)
    return "\n\n".join(chosen)


def extract_pages(pages: DataFrame, html_col: str = "html", text_name: str = "text") -> DataFrame:
    """``pages`` with column ``text_name`` in place of the html."""
    W.small_batches(pages.sparkSession)
    rest = [f for f in pages.schema.fields if f.name != html_col]
    if any(f.name.lower() == text_name for f in rest):
        raise ValueError(f"the pages already have a column {text_name}; choose another name")
    at = pages.columns.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = [i for i in range(batch.num_columns) if i != at]
            texts = pa.array([extract(x.as_py()) for x in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in others), texts], schema=pa.schema(
                [*(batch.schema.field(i) for i in others), (text_name, pa.string())]))

    return pages.mapInArrow(run, T.StructType([*rest, T.StructField(text_name, T.StringType())]))


def page_report(pages: DataFrame) -> DataFrame:
    """One row per page: its main text and the number of its code points."""
    return extract_pages(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
