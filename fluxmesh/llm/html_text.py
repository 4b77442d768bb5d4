"""Main text of web pages by tag-path ratios.

A page is read once into block nodes: stretches of text that no block element interrupts, each with its tag path, the
block elements from the root to it with the words of their classes. Then, for each page:

1. Text length outside links and punctuation are summed per tag path and divided by the path's nodes.
2. Both ratios are smoothed along the page (each node's by its neighbours') and averaged per path again.
3. They are fused into one score per path, less the share of its text that is links.
4. Paths whose score reaches the standard deviation of all nodes' scores are the core.
5. The content is the core, and what else stands in the element around it: the innermost ``article`` or ``main`` that
   holds most of the core, else the innermost element that does. Text of a path that is links for the most part is a menu
   if its siblings are so too.

Elements that say what they are (``nav``, ``aside``, ``form``, a class word like ``sidebar`` or ``comments``, ...) weigh nothing
in 1 to 5, unless the page's ``article``, ``main`` or ``h1`` lies inside. A ``header`` inside an article keeps its headings.

Blocks: character references are decoded, white space (a line break too) becomes one space; two line breaks in a row
end a block. Blocks are joined in page order by two ``\\n``.

Rows: a null or empty page gives an empty text; each row counts for itself, so repeated rows come out alike; other
columns are never read; an empty table gives no rows. Pages of any length, nesting and kind of damage are read whole in
time and memory that grow with their length.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

# Element names of the HTML standard, by what they do to text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template".split())
CODE = frozenset(("script", "style"))
MUTE = frozenset("head select button svg math object canvas audio video datalist".split())
#: What a start tag ends: an open element of these names, up to one of the others.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("tbody thead tfoot", "table"), "tfoot": ("tbody thead tfoot", "table")}
ENDS = {k: tuple(frozenset(x.split()) for x in v) for k, v in ENDS.items()}
#: Elements, ARIA roles and words of classes and ids that name what is not the article.
ASIDE_TAGS = frozenset("nav aside footer form menu dialog header search fieldset".split())
ASIDE_ROLES = frozenset("navigation banner complementary contentinfo search dialog alertdialog alert form menu menubar toolbar".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead "
    "cookie cookies consent gdpr notice notices popup modal overlay subscribe subscription newsletter signup login share sharing social comment comments disqus respond reply replies "
    "related recommended recommendations toolbar pagination pager copyright disclaimer".split()
)
ARTICLE = frozenset(("article", "main"))

MARKUP = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
NAME = re.compile(r"[^\s/>]+")
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])([^\s=/>"']++)\s*+=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*))""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
PUNCTUATION = re.compile("[.,;:!?…。，、；：？！]")
QUOTE = re.compile(r"=\s*([\"'])")
KERNEL = np.array([0.06, 0.24, 0.4, 0.24, 0.06])
#: Share of the core's text that the element around it holds, and of a path's text in links that makes it a menu.
MOST, LINKED = 0.8, 0.5


class Page:
    """Elements (parents before children) and the text blocks of a page."""

    def __init__(self):
        self.parent, self.tag, self.path, self.aside, self.hidden = [-1], [""], [0], [False], [False]
        self.paths: dict[tuple[int, str], int] = {}
        self.owner: list[int] = []
        self.text: list[str] = []
        self.linked: list[int] = []

    def open(self, parent: int, tag: str, words: list[str], aside: bool, hidden: bool) -> int:
        label = " ".join([tag, *words])
        self.parent.append(parent)
        self.tag.append(tag)
        self.path.append(self.paths.setdefault((self.path[parent], label), len(self.paths) + 1))
        self.aside.append(aside)
        self.hidden.append(hidden)
        return len(self.tag) - 1


def _attributes(source: str) -> tuple[list[str], bool, bool]:
    """(words of the class, whether the element names itself no article, whether it is hidden)."""
    words, aside, hidden = [], False, False
    for name, a, b, c in ATTRIBUTE.findall(source):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            found = [w.lower() for w in WORDS.findall(value)]
            aside = aside or not ASIDE_WORDS.isdisjoint(found)
            if name == "class":
                words = found
        elif name == "role":
            aside = aside or value.lower() in ASIDE_ROLES
        elif name == "style":
            hidden = hidden or "display:none" in value.lower().replace(" ", "")
    return words, aside, hidden or re.search(r"\shidden(?=[\s/]|$)", ATTRIBUTE.sub(" ", source)) is not None


def _tag_end(source: str, at: int, unclosed: dict[str, int]) -> int:
    """The place of the ``>`` that ends a tag: one inside a quoted value does not."""
    while True:
        end = source.find(">", at)
        if end < 0:
            return len(source)
        quote = QUOTE.search(source, at, end)
        if not quote:
            return end
        mark = quote.group(1)
        close = source.find(mark, quote.end()) if quote.end() < unclosed.get(mark, len(source)) else -1
        if close < 0:  # never closed: the tag ends at its first ">"; not looked for again
            unclosed[mark] = min(unclosed.get(mark, len(source)), quote.end())
            return end
        at = close + 1


def parse(source: str) -> Page:
    page, stack = Page(), [0]
    where: dict[str, list[int]] = {}  # depths of the open elements of each name
    endless: set[str] = set()
    parts: list[str] = []
    state = {"linked": 0, "breaks": 0}
    link_depth = mute = 0
    mute_tag, unclosed, at, size = "", {}, 0, len(source)

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                page.owner.append(stack[-1])
                page.text.append(text)
                page.linked.append(min(state["linked"], len(text)))
            parts.clear()
        state["linked"] = state["breaks"] = 0

    def close(depth: int) -> None:
        nonlocal link_depth
        flush()
        for i in stack[depth:]:
            where[page.tag[i]].pop()
        del stack[depth:]
        if link_depth > len(stack):
            link_depth = 0

    def nearest(names) -> int:
        return max((where[t][-1] for t in names if where.get(t)), default=0)

    def ended(tag: str) -> bool:
        """Whether an end tag of the name stands after ``at``."""
        if tag not in endless and not _end_tag(tag).search(source, at):
            endless.add(tag)
        return tag not in endless

    while at < size:
        found = MARKUP.search(source, at)
        upto = found.start() if found else size
        if upto > at and not mute:
            text = html.unescape(source[at:upto])
            parts.append(text)
            if not text.isspace():
                state["breaks"] = 0
            if link_depth:
                state["linked"] += len(text.strip())
        if not found:
            break
        mark = found.group()
        if mark == "<!--":
            end = source.find("-->", upto + 4) if not source.startswith(">", upto + 4) else upto + 2
            at = end + 3 if end >= 0 else size
            continue
        if mark in ("<!", "<?"):
            end = source.find(">", upto)
            at = end + 1 if end >= 0 else size
            continue
        closing = mark[1] == "/"
        name_at = NAME.match(source, upto + 2 if closing else upto + 1)
        tag = name_at.group().lower()
        end = _tag_end(source, name_at.end(), unclosed)
        body = source[name_at.end() : end]
        at = end + 1
        if mute:
            if tag == mute_tag and not body.endswith("/"):
                mute += -1 if closing else 1
            if mute_tag != "head" or tag not in BLOCK:
                if tag in RAW and not closing and (ended(tag) or tag in CODE):
                    at = _raw_end(source, tag, at)
                continue
            mute = 0  # a block ends a head that nothing else ended
        if tag in RAW:
            if not closing and (ended(tag) or tag in CODE):
                at = _raw_end(source, tag, at)
            continue
        if tag in MUTE:
            if not closing and not body.endswith("/") and (tag == "head" or ended(tag)):
                mute, mute_tag = 1, tag
            continue
        if tag == "br":
            parts.append(" ")
            state["breaks"] += 1
            if state["breaks"] > 1:
                flush()
            continue
        if tag == "a":
            link_depth = 0 if closing else len(stack)
            continue
        if tag not in BLOCK:
            continue
        if closing:
            depth = nearest(HEADINGS if tag in HEADINGS else (tag,))
            if depth:
                close(depth)
            else:
                flush()
            continue
        flush()
        if tag in ("html", "body"):
            continue
        if page.tag[stack[-1]] == "p" or (page.tag[stack[-1]] in HEADINGS and tag in HEADINGS):
            close(len(stack) - 1)
        if tag in ENDS:
            depth = nearest(ENDS[tag][0])
            if depth > nearest(ENDS[tag][1]):
                close(depth)
        if tag != "hr":
            words, aside, hidden = _attributes(body) if "=" in body or "hidden" in body else ([], False, False)
            where.setdefault(tag, []).append(len(stack))
            stack.append(page.open(stack[-1], tag, words, aside or tag in ASIDE_TAGS, hidden))
    flush()
    return page


def _end_tag(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE)


def _raw_end(source: str, tag: str, at: int) -> int:
    """Where the content of an element that holds no markup ends, its end tag included; the page's end if it never does."""
    found = _end_tag(tag).search(source, at)
    return found.end() if found else len(source)


def _weighed(page: Page) -> tuple[list[bool], list[int]]:
    """(whether each element may hold content, the innermost ``article`` or ``main`` around each, or 0)."""
    n = len(page.tag)
    clear = [True] * n
    for i in range(1, n):
        clear[i] = clear[page.parent[i]] and not page.aside[i] and not page.hidden[i]
    # Where all articles (else all first headings) stand in elements that name themselves none, such an element may be the page.
    chief = [i for i in range(1, n) if page.tag[i] in ARTICLE and not page.aside[i]] or [i for i in range(1, n) if page.tag[i] == "h1"]
    marks = [False] * n
    if not any(clear[i] for i in chief):
        for i in chief:
            while i > 0 and not marks[i]:
                marks[i], i = True, page.parent[i]
    open_, article, header = [True] * n, [0] * n, [False] * n
    for i in range(1, n):
        up, tag = page.parent[i], page.tag[i]
        inside = article[up]
        header[i] = header[up] or (tag == "header" and inside > 0)
        barred = page.hidden[i] or (page.aside[i] and not marks[i] and not (tag == "header" and inside))
        open_[i] = open_[up] and not barred
        article[i] = i if tag in ARTICLE and open_[i] and not page.aside[i] else inside
    # A header inside an article keeps its headings only.
    return [o and (not header[i] or page.tag[i] in HEADINGS) for i, o in enumerate(open_)], article


def path_scores(lengths: np.ndarray, marks: np.ndarray, linked: np.ndarray, paths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(score, share of links) of each node's path: ratios per path, smoothed along the page, fused."""
    _, path = np.unique(paths, return_inverse=True)
    nodes = np.bincount(path)
    free = lengths - linked
    share = (np.bincount(path, linked) / np.maximum(np.bincount(path, lengths), 1))[path]
    weight = np.convolve(np.ones(len(path)), KERNEL)[2:-2]

    def smoothed(x: np.ndarray) -> np.ndarray:
        ratio = (np.bincount(path, x) / nodes)[path]
        return (np.bincount(path, np.convolve(ratio, KERNEL)[2:-2] / weight) / nodes)[path]

    return smoothed(free) * (1 + smoothed(marks)) * (1 - share), share


def main_blocks(source: str) -> list[str]:
    """The blocks of a page's main text, in page order."""
    page = parse(source)
    may, article = _weighed(page)
    nodes = [k for k, o in enumerate(page.owner) if may[o]]
    if not nodes:
        return []
    owner = [page.owner[k] for k in nodes]
    lengths = np.array([len(page.text[k]) for k in nodes])
    linked = np.array([page.linked[k] for k in nodes])
    marks = np.array([len(PUNCTUATION.findall(page.text[k])) for k in nodes])
    score, share = path_scores(lengths, marks, linked, np.array([page.path[o] for o in owner]))
    core = score >= score.std()
    # Text of the core below each element, then the innermost element that holds most of it.
    held = np.zeros(len(page.tag), np.int64)
    np.add.at(held, owner, np.where(core, lengths, 0))
    held = held.tolist()
    for i in range(len(held) - 1, 0, -1):
        held[page.parent[i]] += held[i]
    around = max(i for i, h in enumerate(held) if h >= MOST * held[0])
    inside = [False] * len(page.tag)
    ground = article[around] or around
    for i in range(ground, len(inside)):
        inside[i] = i == ground or (page.parent[i] >= ground and inside[page.parent[i]])
    # A menu: links for the most part, in its path and among its siblings.
    group = np.array([page.parent[o] for o in owner])
    menus = (share >= LINKED) & (np.bincount(group + 1, linked)[group + 1] >= LINKED * np.bincount(group + 1, lengths)[group + 1])
    return [page.text[k] for k, o, c, m in zip(nodes, owner, core.tolist(), menus.tolist(), strict=True) if not m and (inside[o] or (c and not article[around]))]


def extract_text(pages: DataFrame, keep_columns: list[str]) -> DataFrame:
    """``keep_columns`` of ``pages(html)`` with the main ``text``, its code points ``n_chars`` and its blocks ``n_blocks``."""
    types, k = dict(pages.dtypes), len(keep_columns)
    own = pages.select(*[F.col(c).alias(f"own_{c}") for c in keep_columns], F.coalesce(F.col("html").cast("string"), F.lit("")).alias("k_html"))
    names = [*keep_columns, "text", "n_chars", "n_blocks"]

    def run(batches):
        for part in (p for batch in batches for p in slices(batch)):
            found = [main_blocks(h) for h in part.column(k).to_pylist()]
            texts = ["\n\n".join(b) for b in found]
            yield pa.RecordBatch.from_arrays([*part.columns[:k], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(b) for b in found], pa.int64())], names=names)

    return own.mapInArrow(run, ", ".join([f"`{c}` {types[c]}" for c in keep_columns] + ["text string, n_chars long, n_blocks long"]))
