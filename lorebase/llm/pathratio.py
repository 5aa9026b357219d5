"""HTML extraction by tag-path ratios.

A page is cut into text nodes, each with its root-to-leaf tag path.  Per path, text
length and punctuation are summed over the page and divided by the path's nodes;
both ratios are fused, smoothed over the page's order with a Gaussian, and nodes
whose value reaches a share of the page's deviation are content; so is other text
in the innermost element of several blocks that holds nine tenths of that content.
The ratios choose on every page, articles marked or not.  Parts that HTML itself
marks (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
reader comments; by element, role, class or id) are never content; a class counts as a
whole (``has-sidebar`` is no sidebar), and an element that holds most of the page's
text stays if its class is one that wrappers of pages bear too.  A block is a run
of text between block-level tags; it is kept or dropped whole.

The work of a page stays in its row: there is no shuffle, and memory is one batch.

Defined results: null or empty html, and pages without content, give the empty
string and 0; broken, unclosed and cut-off markup is read as far as it goes; markup
of any depth and texts of any length take time in proportion; equal ratios fall on
the same side of the threshold; extra columns are ignored; repeated rows each get
their row; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm.arrays import pieces
from lorebase.llm.tables import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template textarea iframe object canvas audio video xmp noframes".split()
#: These may end in their own tag (<svg/>); formulas are text, but not the source that they carry along.
FOREIGN = "svg annotation annotation-xml".split()
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
OUT_TAGS = frozenset("nav header footer aside form menu dialog button select label head title fieldset legend input option".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form status".split())
#: Names of such parts in classes and ids, whole ones ("sidebar") or beside words that only place them ("left-sidebar-2").
OUT_NAMES = frozenset(
    "nav navbar navigation menu header masthead topbar footer bottom sidebar aside rail widget notice notification alert cookie cookies consent gdpr banner popup modal overlay newsletter subscribe subscription "
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion form search login signup related recommended share sharing social breadcrumb breadcrumbs pagination pager toolbar skip respond feedback".split()
)
#: Of these, names that a wrapper of the whole page may bear too.
WRAPPING = frozenset("sidebar aside rail widget header masthead form search login navigation".split())
COMMENTS = frozenset("comment comments commentlist disqus reply replies discussion".split())
BESIDE = frozenset("site page main primary secondary global top bottom left right inner outer upper lower first last fixed sticky mobile desktop wrap wrapper container content-info box block area bar slot unit row col column list item items group section panel links link icons buttons button post article blog entry user reader the my js id region zone thread tree".split())
#: Classes that begin so tell of a layout, not of the element.
LAYOUT = frozenset("has have with without no not hide is".split())
FIXED = OUT_NAMES - WRAPPING
#: Elements that a new element of the key's kind ends.
_P, _TABLE = frozenset({"p"}), frozenset({"td", "th"})
ENDS = {"li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": _TABLE, "th": _TABLE, "option": frozenset({"option"})}
FENCES = frozenset("ul ol dl table article section main div body aside nav form".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<foreign>" + "|".join(FOREIGN) + r")(?=[\s/>])(?:[^>]*[^>/])?>.*?(?:</(?P=foreign)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*)(?P<rest2>[^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-z][^>]*\Z"
    r"|(?P<text>[^<]+|<)",
    re.I | re.S,
)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
#: Share of the deviation that is the threshold, width of the smoothing, share of the content that its container holds.
SHARE, SIGMA, HOME = 0.8, 1.0, 0.9
#: Share of the page's text above which an element is kept whatever its classes are called.
MOST = 0.6
_KERNEL = [math.exp(-(d * d) / (2 * SIGMA**2)) for d in (-2, -1, 0, 1, 2)]


#: How an element stands to the content: in it, never in it, or only in it if it holds most of the page's text.
IN, OUT, DOUBTED = range(3)


def _called(value: str, names: frozenset[str]) -> bool:
    """Does one of the classes of ``value`` name a part in ``names``, alone or beside words that only place it?"""
    for token in value.split():
        parts = [p for p in re.split(r"[-_]+", token) if p and not p.isdigit()]
        if parts and parts[0] not in LAYOUT and any(p in names for p in parts) and all(p in OUT_NAMES or p in COMMENTS or p in BESIDE for p in parts):
            return True
    return False


def _outside(tag: str, rest: str) -> int:
    """Is the element a part that is never content?  Some names of classes leave a doubt."""
    if tag in OUT_TAGS:
        return OUT
    if not rest or "=" not in rest and "hidden" not in rest:
        return IN
    found = IN
    for name, value in ATTRIBUTE.findall(rest):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return OUT
        if name == "role" and value in OUT_ROLES:
            return OUT
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return OUT
        if name in ("class", "id") and tag not in ("html", "body"):
            if _called(value, COMMENTS):
                return OUT
            if tag not in ("article", "main"):
                if _called(value, FIXED):
                    return OUT
                if _called(value, WRAPPING):
                    found = DOUBTED
    return found


class Page:
    """A page's text nodes: each knows its block, its tag path and its innermost element, by number.

    Paths and elements point at their parents, so the depth of the markup costs nothing.
    """

    def __init__(self, html: str):
        self.up = [0]  # parent of each element
        self.nodes: list[tuple[int, int, str, int]] = []  # block, path, text, element
        self.linked = [False]  # per path: does it pass through a link?
        self.doubted: list[int] = []  # elements whose names alone say that they are no content
        paths: dict[tuple[int, str], int] = {}
        stack: list[tuple[str, int, bool, int]] = [("", 0, False, 0)]  # tag, path, outside, element
        open_: dict[str, int] = {}
        block = 0

        def close(at: int) -> None:
            for tag, *_ in stack[at:]:
                open_[tag] -= 1
            del stack[at:]

        def close_within(tags: frozenset[str], fences: frozenset[str]) -> None:
            """Close the innermost element of ``tags`` unless a fence stands before it."""
            if any(open_.get(t) for t in tags):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in tags:
                        return close(i)
                    if stack[i][0] in fences:
                        return None
            return None

        for m in TOKEN.finditer(html):
            text = m["text"]
            if text is not None:
                if not stack[-1][2]:
                    self.nodes.append((block, stack[-1][1], text, stack[-1][3]))
                continue
            tag = m["tag"] or m["tag2"]
            if tag is None:
                continue
            tag = tag.lower()
            if m["end"] or m["end2"]:
                if open_.get(tag):
                    at = len(stack) - 1
                    while stack[at][0] != tag:
                        at -= 1
                    close(at)
            else:
                if tag in BLOCK and tag not in ("html", "head"):
                    close_within(_P, BLOCK)  # an open paragraph ends where a block begins
                if tag in ENDS:
                    close_within(ENDS[tag], FENCES)
                if tag == "body":
                    at = len(stack)
                    while at > 1 and stack[at - 1][0] != "html":
                        at -= 1
                    close(at)
                if tag == "br" and not stack[-1][2]:
                    self.nodes.append((block, stack[-1][1], "\n", stack[-1][3]))
                if tag not in VOID:
                    rest = m["rest"] if m["rest"] is not None else m["rest2"] or ""
                    if not rest.endswith("/") or tag in BLOCK or tag in ("a", "b", "i", "span"):
                        _, above, outside, parent = stack[-1]
                        path = paths.setdefault((above, tag), len(self.linked))
                        if path == len(self.linked):
                            self.linked.append(self.linked[above] or tag == "a")
                        self.up.append(parent)
                        open_[tag] = open_.get(tag, 0) + 1
                        stands = OUT if outside else _outside(tag, rest)
                        if stands == DOUBTED:
                            self.doubted.append(len(self.up) - 1)
                        stack.append((tag, path, stands == OUT, len(self.up) - 1))
            if tag in BLOCK:
                block += 1
        self._settle()

    def _settle(self) -> None:
        """Drop the nodes of doubted elements, but for one that holds most of the page's text outside of links and other doubted ones' parts."""
        if not self.doubted:
            return
        mass = [0] * len(self.up)
        for _, path, text, e in self.nodes:
            if not self.linked[path]:
                mass[e] += len(text.strip())
        for e in range(len(self.up) - 1, 0, -1):  # parents have smaller numbers
            mass[self.up[e]] += mass[e]
        doubted = {e for e in self.doubted if mass[e] <= MOST * mass[0]}
        out = [False] * len(self.up)
        for e in range(1, len(self.up)):
            out[e] = e in doubted or out[self.up[e]]
        self.nodes = [n for n in self.nodes if not out[n[3]]]


class Block:
    """A run of text between block-level tags."""

    __slots__ = ("chars", "element", "linked", "sizes", "texts")

    def __init__(self) -> None:
        self.texts: list[str] = []
        self.chars = self.linked = self.element = 0
        self.sizes: dict[int, list[int]] = {}  # per path: length, punctuation, nodes


def blocks_of(page: Page) -> list[Block]:
    out, last = [], None
    for number, path, text, element in page.nodes:
        if number != last:
            out.append(Block())
            last = number
        b = out[-1]
        b.texts.append(text)
        n = len(text.strip())
        if n:
            b.element = b.element if b.chars else element
            b.chars += n
            b.linked += n * page.linked[path]
            size = b.sizes.setdefault(path, [0, 0, 0])
            size[0] += n
            size[1] += len(PUNCTUATION.findall(text))
            size[2] += 1
    return [b for b in out if b.chars]


def smoothed_ratios(blocks: list[Block]) -> list[float]:
    """Each block's fused tag-path ratio, less its links, smoothed over the page's order."""
    paths: dict[int, list[int]] = {}
    for b in blocks:
        for path, size in b.sizes.items():
            total = paths.setdefault(path, [0, 0, 0])
            for i in range(3):
                total[i] += size[i]
    # a path's fused ratio: text length a node, weighted by punctuation a node
    ratio = {path: n / c * (1 + math.log1p(p / c)) for path, (n, p, c) in paths.items()}
    raw = [sum(ratio[path] * n for path, (n, _, _) in b.sizes.items()) / b.chars * (1 - b.linked / b.chars) for b in blocks]
    out = []
    for i in range(len(raw)):
        window = [(raw[j], _KERNEL[j - i + 2]) for j in range(max(0, i - 2), min(len(raw), i + 3))]
        out.append(sum(v * w for v, w in window) / sum(w for _, w in window))
    return out


def chosen(page: Page, blocks: list[Block]) -> list[bool]:
    """Blocks whose ratio reaches the page's threshold, and what shares their innermost container."""
    smooth = smoothed_ratios(blocks)
    mean = sum(smooth) / len(smooth)
    limit = SHARE * math.sqrt(sum((v - mean) ** 2 for v in smooth) / len(smooth))
    text = [2 * b.linked <= b.chars for b in blocks]
    high = [v >= limit and t for v, t in zip(smooth, text, strict=True)]
    if not any(high):
        high = text if any(text) else [True] * len(blocks)
    weight, many = [0] * len(page.up), [0] * len(page.up)
    for b, k in zip(blocks, high, strict=True):
        weight[b.element] += b.chars * k
        many[b.element] += 1
    whole = sum(weight)
    for e in range(len(weight) - 1, 0, -1):  # parents have smaller numbers
        weight[page.up[e]] += weight[e]
        many[page.up[e]] += many[e]
    home = max(e for e, w in enumerate(weight) if w >= HOME * whole)
    while home and many[home] < 2:  # a paragraph is no container
        home = page.up[home]
    inside = [False] * len(page.up)
    for e in range(len(inside)):
        inside[e] = e == home or e > 0 and inside[page.up[e]]
    return [k or inside[b.element] and t for k, b, t in zip(high, blocks, text, strict=True)]


def extract(html: str | None) -> str:
    """The page's main text, a line for each block."""
    if not html:
        return ""
    page = Page(html)
    blocks = blocks_of(page)
    if not blocks:
        return ""
    lines = (" ".join(unescape("".join(b.texts)).split()) for b, k in zip(blocks, chosen(page, blocks), strict=True) if k)
    return "\n".join(x for x in lines if x)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, text and its code points, a row for each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, html_col):
                found = [extract(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kind = {f.name: f.dataType.simpleString() for f in pages.schema}
    schema = f"`{id_col}` {kind[id_col]}, `{url_col}` {kind[url_col]}, text string, n_chars bigint"
    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col)).mapInArrow(run, schema)


def op5_pathratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op5_pathratio": op5_pathratio}
ORACLES: dict[str, str] = {}
