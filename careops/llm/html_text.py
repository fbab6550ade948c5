"""Main text of web pages from flat text blocks.

A page is cut into the runs of text between block-level tags.  Each block is
described by its word count and link density, those of the block before and
after it, and what its tags and the class names around it say; a decision tree
tells main text from the rest.  The tree is grown (CART, Gini impurity) on the
blocks of the small labelled pages in ``PAGES``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
                  r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")  # every name, with its value if it has one
_TOKEN = re.compile(r"[a-z]+")
_RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp",
                                                            "annotation", "annotation-xml")}

# tag names: fixed values
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s "
                    "samp small span strike strong sub sup time tt u var wbr img br input picture source "
                    "math mi mn mo ms mtext mrow msup msub msubsup mmultiscripts mprescripts mfrac msqrt mroot mstyle munder "
                    "mover munderover mtable mtr mtd mlabeledtr mspace mpadded mphantom menclose merror semantics".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("head button select option svg template object canvas audio video map".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_FRAME_TAGS = frozenset("nav footer aside menu dialog fieldset".split())
_MAIN_TAGS = frozenset(("article", "main"))
_FRAME_NAMES = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disclaimer disqus footer form gdpr login masthead menu modal nav navbar navigation newsletter notice "
    "pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing "
    "sidebar signup social sponsor sponsored subscribe subscription tags toolbar widget widgets contentinfo "
    "complementary alert".split())
#: Words that names of frames are made up with.
_NAME_PARTS = frozenset(
    "area article articles bar block body bottom box btn button buttons container content email group holder icons inner "
    "item items left link links list outer panel post posts right row section sections slot stories story text title top "
    "unit wrap wrapper".split())
_MAIN_NAMES = frozenset("article content entry main post story".split())
#: What an opening tag closes, and the tags that it doesn't reach beyond.
_CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "option": (("option",), ("select",)),
           **dict.fromkeys(("dt", "dd"), (("dt", "dd"), ("dl",))),
           **dict.fromkeys(("td", "th"), (("td", "th"), ("table", "tr"))), "tr": (("tr",), ("table",)),
           **dict.fromkeys(("thead", "tbody", "tfoot"), (("thead", "tbody", "tfoot"), ("table",)))}


@dataclass
class Block:
    text: str
    words: int
    linked: int          # words in links
    heading: bool
    item: bool           # in a list item or table cell
    frame: bool          # in a tag or class that is not for main text
    main: bool           # in a tag or class for main text
    marked: bool = False  # labelled as main text, in PAGES only
    wraps: int = 0       # forms and frame-named elements around it
    over: int = 0        # those of them that are around its innermost main element as well
    forms: int = 0       # forms around it


def _names_frame(name: str, value: str, tag: str, inside: bool) -> bool:
    """Whether a class, role or id says that an element is no main text.

    Outside the main element any part of a name may say so.  Inside it, and
    for ids of sections, a name like ``related-work`` is rather the subject: each
    part must be a frame's or one that such names are made up with.  Ids of
    headings are anchors.
    """
    if name == "id" and tag in _HEADINGS:
        return False
    strict = inside or (name == "id" and tag == "section")
    for token in value.split():
        parts = set(_TOKEN.findall(token))
        if parts & _FRAME_NAMES and not (strict and parts - _FRAME_NAMES - _NAME_PARTS):
            return True
    return False


@dataclass
class _Open:
    tag: str
    frame: bool
    main: bool
    dropped: bool
    marked: bool
    wraps: int = 0
    over: int = 0
    forms: int = 0


@dataclass
class _Parser:
    """Collects the blocks of one page."""

    found: list[Block] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=list)
    places: dict[str, list[int]] = field(default_factory=dict)  # where each tag lies in the stack
    runs: list[tuple[str, bool]] = field(default_factory=list)  # text, in a link
    links: int = 0

    def last(self, tags: tuple[str, ...]) -> int:
        """Place of the innermost open element with one of the tags, -1 if there is none."""
        return max(at[-1] if (at := self.places.get(t)) else -1 for t in tags)

    def cut(self, place: int) -> None:
        """Close the elements from a place of the stack on."""
        while len(self.stack) > place:
            self.places[self.stack.pop().tag].pop()

    def end_block(self) -> None:
        if not self.runs:
            return
        text = " ".join("".join(t for t, _ in self.runs).split())
        if text:
            linked = sum(len(t.split()) for t, in_link in self.runs if in_link)
            tags = {o.tag for o in self.stack[-3:]}
            top = self.stack[-1] if self.stack else _Open("", False, False, False, False)
            words = text.count(" ") + 1
            self.found.append(Block(text, words, min(linked, words), bool(tags & _HEADINGS),
                                    bool(tags & {"li", "td", "th", "dd", "dt"}), top.frame, top.main, top.marked,
                                    top.wraps, top.over, top.forms))
        self.runs.clear()

    def text(self, raw: str) -> None:
        if raw and not (self.stack and self.stack[-1].dropped):
            self.runs.append((unescape(raw) if "&" in raw else raw, self.links > 0))

    def open(self, tag: str, attributes: str) -> None:
        if tag in _INLINE:
            if tag == "a":
                self.links = 1
            elif tag == "br":
                self.runs.append((" ", False))
            return
        self.end_block()
        self.links = 0
        if tag in _VOID:
            return
        above = self.stack
        if above and above[-1].tag == "p":
            self.cut(len(above) - 1)  # closed by what follows it
        if tag in _CLOSES:
            closed, within = _CLOSES[tag]
            if (at := self.last(closed)) > self.last(within):
                self.cut(at)
        if tag == "body":
            self.cut(0)
        top = above[-1] if above else _Open("", False, False, False, False)
        marked, holder = top.marked, tag in _MAIN_TAGS
        frame = top.frame or tag in _FRAME_TAGS or (tag == "header" and not top.main)
        named = False
        if attributes:
            marked = marked or "data-label-main" in attributes
            for name, value in _ATTR.findall(attributes):
                name, value = name.lower(), value.strip("\"'").lower()
                if name in ("class", "id", "role"):
                    inside = top.main or holder
                    names = set(_TOKEN.findall(value))
                    named = named or _names_frame(name, value, tag, inside) or (
                        "header" in names and not inside and not (name == "id" and tag in _HEADINGS))
                    holder = holder or (bool(names & _MAIN_NAMES) and tag not in _HEADINGS)
                elif (name == "hidden" or name == "aria-hidden" and value == "true"
                      or name == "style" and "display:none" in value.replace(" ", "")):
                    frame = True
        if tag in ("html", "body"):  # they hold the whole page, whatever they are called
            named = holder = False
        over = top.wraps if holder else top.over
        wraps, forms = top.wraps + (named or tag == "form"), top.forms + (tag == "form")
        self.places.setdefault(tag, []).append(len(above))
        above.append(_Open(tag, frame, top.main or holder, top.dropped or tag in _DROPPED, marked, wraps, over, forms))

    def close(self, tag: str) -> None:
        if tag in _INLINE:
            if tag == "a":
                self.links = 0
            return
        self.end_block()
        if (at := self.last((tag,))) >= 0:
            self.cut(at)


def _settle_frames(found: list[Block]) -> None:
    """Set ``frame`` of the blocks of one page by the forms and frame-named elements around them.

    Those that hold the page's main element are no frame for what is in it:
    of the main elements, the ones with the fewest of them around count.  A
    form with most of the page's words and no main text outside is none either.
    """
    named = [b for b in found if not b.frame]
    least = min((b.over for b in named if b.main and b.wraps == b.over), default=0)
    for b in named:
        b.frame = b.wraps > (b.over if b.main and b.over <= least else 0)
    inside = sum(b.words for b in found if b.forms)
    if 2 * inside > sum(b.words for b in found) and not any(b.main and not b.frame and not b.forms for b in found):
        for b in named:
            if b.forms and not b.main:
                b.frame = b.wraps > b.forms


def blocks(html: str) -> list[Block]:
    """The text blocks of a page, in order."""
    p, at = _Parser(), 0
    while m := _TAG.search(html, at):
        p.text(html[at:m.start()])
        at = m.end()
        slash, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            p.close(tag)
            continue
        if tag in _RAW:
            end = _RAW[tag].search(html, at)
            at = end.end() if end else len(html)
            continue
        p.open(tag, attributes)
    p.text(html[at:])
    p.end_block()
    _settle_frames(p.found)
    return p.found


FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
            "heading", "item", "frame", "main", "inside", "elsewhere")


def features(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block of one page; beyond its ends lie blocks without words."""
    if not found:
        return np.empty((0, len(FEATURES)))
    words = np.array([b.words for b in found], float)
    density = np.array([b.linked for b in found], float) / words
    flags = [np.array([getattr(b, n) for b in found], float) for n in ("heading", "item", "frame", "main")]

    flags.append(flags[3] * (1 - flags[2]))
    flags.append(flags[3].max() * (1 - flags[3]))  # the page has a tag for main text, and this block is outside

    def shifted(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(x)
        out[max(0, by):len(x) + min(0, by)] = x[max(0, -by):len(x) + min(0, -by)]
        return out

    return np.stack([words, density, shifted(words, 1), shifted(density, 1), shifted(words, -1), shifted(density, -1),
                     *flags], axis=1)


# ------------------------------------------------------------------- the tree

@dataclass
class Node:
    share: float                  # of main text among the training blocks here
    feature: int = -1
    cut: float = 0.0
    low: "Node | None" = None     # feature <= cut
    high: "Node | None" = None


def _impurity(n: np.ndarray, main: np.ndarray) -> np.ndarray:
    p = main / np.maximum(n, 1)
    return n * 2 * p * (1 - p)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 2) -> Node:
    """A CART classifier: the split with the least Gini impurity, until pure or ``depth``."""
    node = Node(float(y.mean()))
    if depth == 0 or y.all() or not y.any():
        return node
    best = (_impurity(np.array(len(y)), np.array(y.sum())).item() - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, main = x[order, f], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        at = at[(at + 1 >= least) & (len(y) - at - 1 >= least)]
        if len(at):
            total = _impurity(at + 1, main[at]) + _impurity(len(y) - at - 1, main[-1] - main[at])
            i = int(np.argmin(total))
            best = min(best, (float(total[i]), f, float(v[at[i]] + v[at[i] + 1]) / 2))
    if best[1] < 0:
        return node
    _, node.feature, node.cut = best
    low = x[:, node.feature] <= node.cut
    node.low, node.high = grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)
    return node


def classify(node: Node, x: np.ndarray) -> np.ndarray:
    if node.low is None:
        return np.full(len(x), node.share >= 0.5)
    low = x[:, node.feature] <= node.cut
    out = np.empty(len(x), bool)
    out[low], out[~low] = classify(node.low, x[low]), classify(node.high, x[~low])
    return out


# The labelled pages: {n} stands for n words, [n] for n words in a link; M marks the tags that hold main text.
PAGES = (
    "<header><h1>{3}</h1><nav><ul><li>[1]<li>[2]<li>[1]</ul></nav></header><main M><h1>{8}</h1><p>{45}<p>{70}<p>{4}<p>{33}</main><footer>{12}</footer>",
    "<nav><ul><li>[1]</li><li>[1]</li><li>[1]</li></ul></nav><article M><h1>{6}</h1><p>{60}</p><h2>{3}</h2><p>{2}</p><p>{90} [2] {20}</p><ul><li>{9}</li><li>{14}</li></ul><p>{51}</p></article><aside><h3>{2}</h3><ul><li>[5]</li><li>[7]</li></ul></aside><footer>{9} [1] [2]</footer>",
    "<div id=header>{4}</div><div class=menu>[1] [1] [2] [1]</div><div class=content M><h2>{7}</h2><p>{38}<p>{55}<blockquote>{24}</blockquote><p>{66}</div><div id=sidebar><p>{18}</p><p>[4]</p></div><div id=footer>{15}</div>",
    "<div>[1] [1] [1] [1]</div><div M><p>{42}</p><p>{88}</p><p>{29} [3]</p><p>{61}</p></div><div>[3]</div><div>[4]</div><div>[6]</div><div>{5} [2]</div>",
    "<table><tr><td>[1]<td>[1]<td>[2]</table><table><tr M><td>{120}<tr M><td>{75}<tr><td>[4]</table><p>{6}",
    "<div class=cookie-notice><p>{35}</p><p>[2]</p></div><main><article M><header><h1>{9}</h1><p>{3}</p></header><p>{48}</p><p>{7}</p><p>{31}</p></article><section class=comments><h3>{2}</h3><article class=comment><p>{40}</p></article><article class=comment><p>{22}</p></article></section></main><footer><p>{20}</p></footer>",
    "<div class=ad>{14}</div><article M><h1>{5}</h1><p>{25}</p><p>{1}</p></article><footer>{11}</footer>",
    "<div class=ad>{3}</div><article M><p>{12}</p></article><footer>{4}</footer>",
    "<div class='top banner'>{26}</div><div class=post M><h1>{6}</h1><p>{52}</p><p>{3}</p><p>{47}</p></div><div class=related><h4>{2}</h4><p>[8]</p><p>[6]</p></div><form><p>{8}</p><p>{30}</p></form>",
    "<article M><h1>{4}</h1><p>{80}</p><aside N><p>{32}</p></aside><p>{64}</p><div class=share N>[1] [1] [1]</div></article><section id=comments><p>{5}</p><p>{57}</p></section>",
    "<h1 M>{5}</h1><p M>{39}</p><p M>{58}</p><p M>{44}</p><ul><li>[2]<li>[3]<li>[2]</ul><p>{7}</p>",
    "<div class=nav>{2} [1] [1]</div><p M>{28}</p><p M>{53}</p><div class=newsletter>{21}</div><p M>{36}</p><div>[5] [4]</div>",
    "<aside><p>{45}</p><p>{60}</p></aside><main M><p>{15}</p><p>{2}</p><p>{5}</p></main><form><p>{19}</p></form><div class=disclaimer><p>{70}</p></div>",
    "<div class=breadcrumbs>[1] [1] {2}</div><article M><h1>{10}</h1><table><tr><td>{4}<td>{6}</table><p>{3} [4] {2}</p><p>[6]</p><p>{22}</p></article><div class=pagination>[1] [1]</div><footer><p>{33}</p><ul><li>[2]<li>[1]</ul></footer>",
    "<nav>[1] [1] [2]</nav><article M><h1>{5}</h1><p>{40}</p><p>{3}</p><p>{13}",
    "<div class=ad>{6}</div><article M><p>{30}</p><p>{6}</p></article>",
    "<div class=ad>{9}</div><article M><h1>{7}",
    "<div M><p>{35}</p><p>{62}</p><p>{50}",
    "<div>{3}</div><div>{2}</div><div M><p>{42}</p><p>{71}</p><p>{37}</p></div><div>{4}</div><div>{6}</div>",
    "<div>{4}</div><article M><p>{6}</p><p>{24}</p><p>{2}</p></article><div>{9}</div><div>{30}</div>",
    "<p>{25}</p><main M><h1>{4}</h1><p>{18}</p><p>{1}</p></main><p>{3}</p><p>{44}</p>",
    "<span>{2}</span><div M>{55}</div><div M>{80}</div><div>{5}</div><div>[2] {3}</div>",
    "<div>[6] [7] [5]</div><div M><p>{33}</p><p>{49} [2] {5}</p></div><div>{4} [12] [9]</div><div>[20]</div>",
    "<p>[1] [1] [1] [1] [1]</p><p M>{95}</p><p M>{41}</p><p>{3} [3]</p><p>[4]</p>",
    "<body class='has-sidebar'><nav>[1] [1]</nav><article M><h1>{5}</h1><p>{40}</p><p>{6}</p></article><div class=sidebar><p>{30}</p></div></body>",
    "<div class='content-with-sidebar'><article M><h1>{6}</h1><p>{50}</p><p>{4}</p></article><div class=sidebar><p>{26}</p></div></div>",
    "<div>[1] [1] [2]</div><div M><h1>{5}</h1><p>{40}</p><p>{2}</p><p>{52}</p><p>{3}</p><p>{2}</p><p>{61}</p></div><div>{4} [2]</div><div>{5}</div>",
    "<div>{4}</div><div M><p>{26}</p><p>{1}</p><p>{47}</p><h2>{2}</h2><p>{3}</p><p>{34}</p><p>{5}</p><p>{70}</p></div><div>[3]</div><div>[2]</div>",
    "<div>{2} [1] [1]</div><div M><p>{2}</p><p>{44}</p><p>{4}</p><p>{4}</p><p>{38}</p><p>{2}</p><p>{29}</p></div><div>[1] [2]</div>",
    "<article M><h1>{3}</h1><p>{40}</p><p>{2}</p><p>{40}</p></article><footer>{3}</footer>",
    "<article M><p>{7}</p><p>{14}</p></article>",
    "<main M><p>{2}</p><p>{9}</p></main><div>{2}</div>",
    "<article M><p>{5}</p></article>",
    "<article M><p>{3} [2]</p><p>[4]</p><p>{8}</p></article><div>{8}</div>",
    "<div><article M><h2>{5}</h2><p>{20}</p><p>{7}</p></article></div>",
    "<main M><h1>{2}</h1><p>{3}</p><p>{50}</p><ul><li>{2}</li><li>{1}</li></ul></main>",
    "<form><div class=header>{3}</div><div id=content M><h2>{5}</h2><p>{45}</p><p>{30}</p></div><div id=footer>{14}</div></form>",
)


def _filled(page: str, scale: float) -> str:
    """A labelled page as HTML with made-up words; ``scale`` times as many in blocks of over ten words."""
    def words(n: str) -> str:
        return " ".join(["word"] * (int(n) if int(n) <= 10 else max(11, round(int(n) * scale))))
    page = re.sub(r"\{(\d+)\}", lambda m: words(m[1]), page)
    page = re.sub(r"\[(\d+)\]", lambda m: "<a href=x>" + " ".join(["link"] * int(m[1])) + "</a>", page)
    return re.sub(r" N>", " data-unlabel>", re.sub(r" M>", " data-label-main>", page))


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of PAGES, at three sizes."""
    x, y = [], []
    for page in PAGES:
        for scale in (0.5, 1.0, 2.5):
            # a part marked N is not main text though what holds it is
            found = blocks(_filled(page, scale))
            x.append(features(found))
            y += [b.marked and not (b.frame and b.main) for b in found]
    return np.concatenate(x), np.array(y)


@lru_cache(maxsize=1)
def trained_tree() -> Node:
    return grow(*labelled_blocks())


def extract(pages: DataFrame, tree: Node | None = None, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """The main text of every page: ``page_id``, ``url``, ``text``, ``n_blocks``, ``n_main``.

    Character references are decoded; white space inside a block becomes one
    space; blocks are joined in page order by one space; nothing else is
    dropped or cut.  A null or empty page, and one without main text, gives an
    empty text.  Cut-off pages and unclosed tags are read as far as they go.
    Null ids and urls and repeated rows come out like any others; an empty
    table gives an empty result; other columns of ``pages`` are not looked at.
    """
    tree = tree or trained_tree()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo in range(0, part.num_rows, 500):
                some = part.slice(lo, 500)
                found = [blocks(h) if (h := v.as_py()) else [] for v in some.column(2)]
                ends = np.cumsum([len(f) for f in found])
                main = np.split(classify(tree, np.concatenate([features(f) for f in found])), ends[:-1])
                texts = [" ".join(b.text for b, m in zip(f, keep) if m) for f, keep in zip(found, main)]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(texts, pa.string()),
                     pa.array([len(f) for f in found], pa.int64()), pa.array([int(k.sum()) for k in main], pa.int64())],
                    names=["page_id", "url", "text", "n_blocks", "n_main"])

    table = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                         F.col(html_col).cast("string").alias("html"))
    return table.mapInArrow(run, T.StructType([table.schema["page_id"], table.schema["url"]] + T.StructType.fromDDL(
        "text string, n_blocks long, n_main long").fields))
