"""Main text of web pages: flat text blocks judged by a small decision tree.

A page becomes a flat list of text blocks. Each is described by its words and link density, those of the blocks before and
after it, and where it stands (inside an article or main element, inside page furniture). A decision tree, grown from the small labelled
table below, tells text from furniture. Pages are independent, so the work is one pass without a shuffle.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.tokens import slices
from cohortloom.session import ship_package

# Element names of HTML by their part in a page, and usual class or id words of furniture.
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section select summary table "
    "tbody td template textarea tfoot th thead title tr ul noscript iframe svg object canvas video audio".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = set(
    "nav footer aside form menu dialog button select textarea noscript template iframe svg object canvas video audio head search fieldset".split()
)
CONTENT = {"article", "main"}
FURNITURE_WORDS = set(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright "
    "disclaimer discussion disqus dialog footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices notification outbrain "
    "pager pagination paywall popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe subscription taboola teaser teasers toolbar topbar widget widgets".split()
)
FURNITURE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
# First words of names that tell what an element has or belongs to, not what it is.
NAME_PREFIXES = {"category", "cat", "format", "has", "is", "js", "layout", "no", "page", "status", "tag", "template", "theme", "type", "with"}
# Containers that are named after their content count where a page has no article or main element.
CONTENT_NAMES = {"article", "content", "entry", "main", "post", "story"}
CONTENT_WORDS = {"article", "entry", "post", "story", "body", "content", "text"}
_AUTO_CLOSE = {"p": BLOCK, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(?P<raw>script|style)\b[^>]*+(?:>.*?(?:</(?P=raw)\s*+>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][a-z0-9:-]*+)(?P<attrs2>[^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|(?P<text>[^<]++|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WORD = re.compile(r"[a-z]+")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

FEATURES = ("words", "links", "before_words", "before_links", "after_words", "after_links", "place", "furniture")


def labelled() -> np.ndarray:
    """The labelled table: FEATURES and then 1 for text, 0 for furniture, a row for each combination worth telling apart.

    links: share of the words inside links. place: 1 inside the article (or the container named so), -1 outside of it on a page that has one, 0 on
    a page that has none. furniture: 1 inside menus, notices and the like. Neighbours are nothing, a row of links or paragraphs.
    """
    rows = []
    nothing, menu, paragraphs = (0, 0.0), (3, 1.0), ((12, 0.0), (60, 0.0))
    sizes = (1, 2, 5, 8, 12, 40, 120, 400)
    for before in (nothing, menu, *paragraphs):
        for after in (nothing, menu, *paragraphs):
            sides, near = (*before, *after), before in paragraphs or after in paragraphs
            for words in sizes:
                for links in (0.0, 0.2, 0.4, 0.65, 0.8, 1.0):
                    rows += [(words, links, *sides, -1, 0, 0), *((words, links, *sides, place, 1, 0) for place in (-1, 0, 1))]
                    listed = links > 0.9 and not near and menu in (before, after)
                    rows.append((words, links, *sides, 1, 0, int(not listed)))
                    plain = links < 0.5 and (words > 10 or near or (before, after) == (nothing, nothing))
                    rows.append((words, links, *sides, 0, 0, int(plain)))
    return np.array(rows, float)


@dataclass(slots=True)
class Block:
    text: str
    words: int
    linked: int
    inside: int
    furniture: bool


def _attributes(attrs: str) -> list[tuple[str, str]]:
    return [(name.lower(), value.strip("\"'").lower()) for name, value in _ATTRIBUTE.findall(attrs)] if attrs else []


def _hidden(attributes: list[tuple[str, str]]) -> bool:
    return any(
        name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _INVISIBLE.search(value) is not None
        for name, value in attributes
    )


def _is_furniture(tag: str, attributes: list[tuple[str, str]], inside: bool) -> bool:
    """Furniture by the element itself: its name, its role, or because it is not shown."""
    if tag in FURNITURE or tag == "header" and not inside:
        return True
    if tag in ("html", "body", "main"):
        return False
    return _hidden(attributes) or any(name == "role" and value in FURNITURE_ROLES for name, value in attributes)


def _named_so(tag: str, attributes: list[tuple[str, str]], inside: bool) -> bool:
    """Whether a block element is named like furniture: by a word of its own, or by the first or last of a compound. Articles only by the former."""
    if tag in ("html", "body", "main"):
        return False
    for name, value in attributes:
        if name in ("class", "id"):
            for token in value.split():
                words = _WORD.findall(token)
                if not words or words[0] in NAME_PREFIXES:
                    continue
                if FURNITURE_WORDS & ({words[0], words[-1]} if tag != "article" else set(words) if len(words) == 1 else set()):
                    return True
                if "header" in words and tag != "article" and not inside and not CONTENT_WORDS & set(words):
                    return True
    return False


def _content(tag: str, attributes: list[tuple[str, str]]) -> int:
    """2 for an article or main element, 1 for a container named so, else 0."""
    if tag in CONTENT:
        return 2
    if tag not in ("div", "section", "td"):
        return 0
    for name, value in attributes:
        if name in ("class", "id"):
            for token in value.split():
                words = _WORD.findall(token)
                if words and words[0] not in NAME_PREFIXES and CONTENT_NAMES & set(words):
                    return 1
    return 0


@dataclass(slots=True)
class _Open:
    """An open element: its name, whether it is furniture, its content rank, and the first block inside it where it is named like furniture."""

    tag: str
    furniture: bool
    content: int
    since: int | None


def text_blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in page order; markup that never ends is closed at the end of the page.

    An element that is only named like furniture is furniture unless it holds most of the words of the page that are in no other furniture: a
    name on a wrapper of the whole page or on the article itself says nothing.
    """
    blocks: list[Block] = []
    stack: list[_Open] = []
    suspects: list[tuple[int, int]] = []
    furniture = inside = named = 0
    link: int | None = None  # how many elements were open where the current link began
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts).split()
            if text:
                blocks.append(Block(" ".join(text), len(text), min(linked, len(text)), 2 if inside else min(named, 1), furniture > 0))
            parts.clear()
            linked = 0

    def leave() -> None:
        nonlocal furniture, inside, named, link
        top = stack.pop()
        furniture -= top.furniture
        inside -= top.content == 2
        named -= top.content == 1
        if top.since is not None:
            suspects.append((top.since, len(blocks)))
        # A link that was never closed ends with the element it began in.
        if link is not None and len(stack) < link:
            link = None

    for m in _TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            text = html.unescape(text)
            parts.append(text)
            if link is not None:
                linked += len(text.split())
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        ends = m["end"] or m["end2"]
        if tag == "a":
            link = None if ends else len(stack)
            continue
        if tag == "br":
            parts.append(" ")
        if tag in VOID:
            if tag in BLOCK:
                flush()
            continue
        block = tag in BLOCK
        attributes = _attributes("" if ends else m["attrs"] or m["attrs2"] or "")
        if not block:
            # Inline elements only count where they are not shown.
            if not ends and not _hidden(attributes):
                continue
            if ends and not any(o.tag == tag for o in stack):
                continue
        flush()
        if ends:
            if any(o.tag == tag for o in stack):
                while stack[-1].tag != tag:
                    leave()
                leave()
            continue
        while stack and tag in _AUTO_CLOSE.get(stack[-1].tag, ()):
            leave()
        held = inside + named > 0
        f = _is_furniture(tag, attributes, held)
        suspect = block and not f and _named_so(tag, attributes, held)
        c = 0 if f else _content(tag, attributes)
        stack.append(_Open(tag, f, c, len(blocks) if suspect else None))
        furniture += f
        inside += c == 2
        named += c == 1
    flush()
    while stack:
        leave()
    _judge_suspects(blocks, suspects)
    return blocks


def _judge_suspects(blocks: list[Block], suspects: list[tuple[int, int]]) -> None:
    """Blocks of an element named like furniture become furniture, smallest elements first, unless most of the words that are left are inside."""
    for low, high in sorted(suspects, key=lambda s: s[1] - s[0]):
        left = sum(b.words for b in blocks if not b.furniture)
        if 2 * sum(b.words for b in blocks[low:high] if not b.furniture) <= left:
            for b in blocks[low:high]:
                b.furniture = True


def features(blocks: list[Block]) -> np.ndarray:
    words = np.array([b.words for b in blocks], float)
    links = np.array([b.linked for b in blocks], float) / np.maximum(words, 1)
    level = max((b.inside for b in blocks if not b.furniture), default=0)
    place = np.where(np.array([b.inside for b in blocks]) >= level, 1.0, -1.0) if level else np.zeros(len(blocks))
    side = np.zeros(1)
    before, after = (np.r_[side, words[:-1]], np.r_[side, links[:-1]]), (np.r_[words[1:], side], np.r_[links[1:], side])
    return np.stack([words, links, *before, *after, place, np.array([b.furniture for b in blocks], float)], axis=1)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12) -> tuple | int:
    """A binary tree by Gini impurity: a class, or (feature, threshold, tree at or below it, tree above it)."""
    if depth == 0 or y.min() == y.max():
        return int(y.mean() >= 0.5)
    found = (np.inf, 0, 0.0)
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, j] <= cut
            p, q, n = y[low].mean(), y[~low].mean(), low.sum()
            found = min(found, (n * p * (1 - p) + (len(y) - n) * q * (1 - q), j, cut))
    if found[0] == np.inf:
        return int(y.mean() >= 0.5)
    low = x[:, found[1]] <= found[2]
    return found[1], float(found[2]), grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


@lru_cache(maxsize=1)
def fitted() -> tuple | int:
    table = labelled()
    return grow(table[:, :-1], table[:, -1])


def judge(x: np.ndarray, tree: tuple | int) -> np.ndarray:
    if isinstance(tree, int):
        return np.full(len(x), tree == 1)
    feature, cut, low, high = tree
    return np.where(x[:, feature] <= cut, judge(x, low), judge(x, high))


def main_text(page: str | None) -> str:
    """The text blocks of a page that the tree takes for text, joined by one space."""
    blocks = text_blocks(page) if page else []
    if not blocks:
        return ""
    return " ".join(b.text for b, keep in zip(blocks, judge(features(blocks), fitted()), strict=True) if keep)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """One row per input row: ``key``, ``url``, text, n_chars (code points).

    A null or empty page and one without text give an empty text. Inside a block white space becomes one space, character references are
    decoded, nothing is cut. Repeated rows are extracted each; other columns are ignored; an empty table gives an empty result.
    """
    ship_package(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(b.select([0, 2, 1]) for b in batches):
            texts = [main_text(p) for p in part.column(1).to_pylist()]
            columns = [part.column(0), part.column(2), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, url, "text", "n_chars"])

    rows = pages.select(F.col(key), F.col(url), F.col(source).cast("string").alias("source"))
    kinds = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (key, url)]
    return rows.mapInArrow(run, ", ".join([*kinds, "text string", "n_chars long"]))
