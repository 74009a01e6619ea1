"""Main text of web pages by minimum-cut labelling.

A page's blocks of text are the nodes of a graph. A classifier's costs of calling a block content or
boilerplate are the capacities from the source and to the sink; edges between blocks that follow one another
and between blocks of one parent element pay for labelling them apart. The minimum cut, found by augmenting
paths, is the labelling of least total cost.

The classifier is a logistic regression over features of the block and of its enclosing elements, trained
here on the blocks of about SAMPLE pages whose place says what they are (article and main against
navigation, footers and the like). Pages without such places, or none at all, leave the prior weights.

The page's core is one element: the article or main with the most text of its own, outside comments and other
articles where there is such a one; else the element of a content name. Names and tags on the core and around it (a
class on the body, a wrapper or a form around the page) say nothing. Anywhere else a menu's, advert's, notice's, form's
or comment's name or tag holds for all that is below it, at any depth, inside the core too; so does an article inside
an article that has paragraphs of its own, which is how HTML writes reader comments. A header inside an article is part of
it. Without a core, an element with most of the page's text is no boilerplate, unless it is named for comments and has no h1.

Markup is read with one pass over its tags and never fails: open, unclosed and cut-off tags end where a
parser would end them. Scripts, styles, form controls, embedded players' fallbacks and the head have no text; formulas,
drawings' text and hidden parts have. Null html counts as empty; a page without content has the empty text. Pages of
any length are read whole; repeated rows give equal texts, an empty table none; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import ship

SAMPLE = 1500
#: A comment, a tag (which ends at the next tag at the latest, a quote without its like being a character), a declaration.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)>?|<[!?][^>]*>?", re.S)
_ATTR = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WHITE = re.compile(r"\s+")
#: Fixed values of HTML: what has no text of its own, what breaks blocks, what takes no end tag.
SILENT = {"script", "style", "template", "iframe", "object", "canvas", "audio", "video", "select", "datalist", "textarea", "title", "head", "button"}
RAW = {"script", "style", "textarea", "title", "iframe"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
GOOD_TAGS = {"article", "main"}
BAD_TAGS = {"nav", "footer", "aside", "header", "form", "menu", "dialog", "fieldset"}
#: Names of boilerplate: parts of a name that say so anywhere in it, then those that do so only as its beginning or as all of it.
BAD_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|ad(?:box|slot|unit|sense|block)\w*|advert\w*|sponsor\w*|promo\w*|banner\w*|menu\w*|nav\w*|breadcrumb\w*|side-?bar\w*|foot|footer\w*|masthead|cookie\w*|consent|gdpr|notice\w*|notification\w*|alert\w*|toast|popup|modal|dialog|newsletter\w*|subscribe|subscription|social|recommend\w*|comment\w*|reply|replies|respond|disqus|login|signup|sign-up|widget\w*|pager|pagination|contentinfo|complementary|taboola|outbrain)(?=$|[\s_-])"
    r"|(?:^|\s)(?:shar(?:e|es|ing)(?:[_-]?(?:this|bar|box|links?|list|icons?|tools?|buttons?|widgets?))?|(?:post|article|entry|page)[_-]share|related(?:[_-]\w+)*|legal|copyright|search|search[_-]?(?:form|bar|box))(?=$|\s)",
    re.I,
)
COMMENT_NAME = re.compile(r"(?:^|[\s_-])(?:comment\w*|reply|replies|respond|disqus)(?=$|[\s_-])", re.I)
GOOD_NAME = re.compile(r"(?:^|[\s_-])(?:article\w*|content|main|post|entry|story|body-?text|text)(?:$|[\s_-])", re.I)
#: Weights before training: bias, then one a feature of ``features``.
PRIOR = np.array([-0.5, 3.0, -5.0, -5.0, 1.0, 1.2, -3.0, 0.8, 0.5, -0.5])
NEXT, NEAR, SCALE, CLOSE = 0.5, 0.35, 1000, 3
#: What is left of a good name's weight a level further down.
DECAY = 0.9


class _Elements:
    """The open and closed elements of a page: parent, tag, and what the tag and names of each say by themselves."""

    def __init__(self) -> None:
        self.parent, self.tag = [0], [""]
        self.bad, self.bad_name, self.good_name, self.comment = [False], [False], [False], [False]
        self.chars = [0]

    def add(self, parent: int, tag: str, names: str) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.bad.append(tag in BAD_TAGS)
        self.bad_name.append(bool(names) and bool(BAD_NAME.search(names)))
        self.good_name.append(bool(names) and bool(GOOD_NAME.search(names)))
        self.comment.append(bool(names) and bool(COMMENT_NAME.search(names)))
        self.chars.append(0)
        return len(self.tag) - 1

    def _core(self, plain: list[int], told: list[bool]) -> int:
        """The page's core, 0 if it has none. ``plain``: characters of an element outside articles and boilerplate in it."""
        n = len(self.tag)
        comments, bad, inside = [0] * n, [0] * n, [0] * n
        best = {True: (1, 0, 0.0, 0), False: (1, 0, 0.0, 0)}
        for i in range(1, n):
            up = self.parent[i]
            comments[i] = comments[up] + self.comment[i]
            bad[i] = bad[up] + (self.bad[i] or self.bad_name[i])
            inside[i] = inside[up] + (self.tag[up] == "article" and told[up])
            tagged = self.tag[i] in GOOD_TAGS
            if plain[i] and (tagged or (self.good_name[i] and not self.bad_name[i] and self.tag[i] not in ("html", "body"))):
                # fewest comment lists and articles around it, then the most text, then the innermost
                key = (-comments[i], -inside[i], plain[i] * 0.2 ** min(bad[i], 20), i)
                best[tagged] = key if best[tagged][0] > 0 else max(best[tagged], key)
        return next((best[k][3] for k in (True, False) if best[k][0] <= 0), 0)

    def flags(self) -> list[tuple[float, float, float, float]]:
        """(in a good tag, in a bad one, bad name, good name) of the blocks of each element, by what encloses them."""
        n = len(self.tag)
        plain, headed = self.chars[:], [tag == "h1" for tag in self.tag]
        told = [tag == "p" and c > 0 for tag, c in zip(self.tag, self.chars, strict=True)]  # has a paragraph of its own
        for i in range(n - 1, 0, -1):  # children come after their parents
            up = self.parent[i]
            self.chars[up] += self.chars[i]
            headed[up] = headed[up] or headed[i]
            if not (self.bad[i] or self.bad_name[i] or self.tag[i] == "article") or self.tag[i] == "header":
                plain[up] += plain[i]
                told[up] = told[up] or told[i]
        core = self._core(plain, told)
        around = [tag in ("html", "body") for tag in self.tag]
        if not core:
            around = [a or (2 * c > self.chars[0] and (h or not m)) for a, c, h, m in zip(around, self.chars, headed, self.comment, strict=True)]
        at = core
        while at:
            around[at] = True
            at = self.parent[at]
        out = [(0.0, 0.0, 0.0, 0.0)]
        inside = [False] * n  # an article with paragraphs of its own
        for i in range(1, n):
            up, tag = self.parent[i], self.tag[i]
            good, bad, bad_name, good_name = out[up]
            inside[i] = inside[up] or (tag == "article" and told[i])
            if not (bad or bad_name):
                nested = tag == "article" and inside[up] and not around[i]
                bad = float(nested or (self.bad[i] and not around[i] and not (tag == "header" and good)))
                bad_name = float(self.bad_name[i] and not around[i])
                good = max(good, float(tag in GOOD_TAGS))
                good_name = max(DECAY * good_name, float(self.good_name[i] and tag not in ("html", "body")))
            out.append((0.0, bad, bad_name, 0.0) if bad or bad_name else (good, 0.0, 0.0, good_name))
        return out


def blocks(page: str) -> list[tuple[str, int, tuple[float, float, float, float], float, str]]:
    """(text, parent element, (in a good tag, in a bad tag, bad name, good name), share of linked text, tag) of each block in page order."""
    out: list = []
    made = _Elements()
    stack: list[tuple[str, int, bool]] = [("", 0, False)]
    opened: dict[str, int] = {}
    words: list[str] = []
    linked = links = silent = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not silent:
            words.append(piece)
            if links:
                linked += len(piece.strip())

    def flush() -> None:
        nonlocal linked
        if words:
            text = _WHITE.sub(" ", html.unescape("".join(words))).strip()
            if text:
                tag, number, _ = next(x for x in reversed(stack) if x[0] in BLOCKS or not x[0])
                made.chars[number] += len(text)
                out.append((text, number, min(1.0, linked / len(text)), tag))
            words.clear()
        linked = 0

    def close(upto: int) -> None:
        nonlocal links, silent
        while len(stack) > upto:
            tag, _, mute = stack.pop()
            opened[tag] -= 1
            links -= tag == "a"
            silent -= mute

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCKS:
                flush()
            depth = len(stack) - 1 if opened.get(tag) else 0
            while depth and stack[depth][0] != tag:
                # an inline end tag doesn't reach out of its block
                depth = 0 if stack[depth][0] in BLOCKS and tag not in BLOCKS and tag not in SILENT else depth - 1
            if depth:
                close(depth)
            continue
        if tag in ("br", "hr", "wbr"):
            if tag == "br":
                add(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in VOID:
            continue
        if tag in BLOCKS:
            flush()
            # a block ends an open paragraph; an item or cell ends its like
            for ended in {"li": ("li", "p"), "dd": ("dd", "dt", "p"), "dt": ("dd", "dt", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p")}.get(tag, ("p",)):
                for i in range(len(stack) - 1, 0, -1) if opened.get(ended) else ():
                    if stack[i][0] == ended:
                        close(i)
                        break
                    if stack[i][0] in BLOCKS and stack[i][0] not in ("p", "td", "th"):
                        break
        names = " ".join(a or b or c for a, b, c in _ATTR.findall(m[3])) if m[3] else ""
        mute = tag in SILENT
        stack.append((tag, made.add(stack[-1][1], tag, names), mute))
        opened[tag] = opened.get(tag, 0) + 1
        links += tag == "a"
        silent += mute
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else n
            if not end:
                break
    flush()
    flags = made.flags()
    return [(text, number, flags[number], share, tag) for text, number, share, tag in out]


def features(found: list) -> np.ndarray:
    """One row a block: a one for the bias, then what PRIOR weighs."""
    rows = []
    for text, _, (good, bad, bad_name, good_name), linked, tag in found:
        words = text.count(" ") + 1
        rows.append((1.0, good, bad, bad_name, good_name, min(words, 40) / 40, linked, bool(re.search(r"[.!?…]$", text)), tag in ("p", "blockquote", "pre", "h1", "h2", "h3"), words < 4))
    return np.array(rows, float).reshape(-1, len(PRIOR))


def min_cut(content: list[int], boiler: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each node lies on the source's side of the minimum cut.

    ``content`` are the capacities from the source (the cost of calling the node boilerplate), ``boiler``
    those to the sink, ``edges`` (i, j, capacity both ways). Equal cuts: the one with the fewest content nodes.
    """
    n = len(content)
    source, sink = n, n + 1
    to: list[int] = []
    cap: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def link(i: int, j: int, forth: int, back: int) -> None:
        out[i].append(len(to))
        to.append(j)
        cap.append(forth)
        out[j].append(len(to))
        to.append(i)
        cap.append(back)

    for i in range(n):
        both = min(content[i], boiler[i])  # flows straight through
        if content[i] - both:
            link(source, i, content[i] - both, 0)
        if boiler[i] - both:
            link(i, sink, boiler[i] - both, 0)
    for i, j, c in edges:
        link(i, j, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            x = queue.popleft()
            for e in out[x]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        used = [0] * (n + 2)
        path: list[int] = []
        x = source
        while True:
            if x == sink:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                cut = next(i for i, e in enumerate(path) if not cap[e])
                x = to[path[cut] ^ 1]
                del path[cut:]
            while used[x] < len(out[x]):
                e = out[x][used[x]]
                if cap[e] and level[to[e]] == level[x] + 1:
                    break
                used[x] += 1
            else:
                if x == source:
                    break
                level[x] = -2
                x = to[path.pop() ^ 1]
                continue
            path.append(out[x][used[x]])
            x = to[path[-1]]


def extract(page: str | None, weights: np.ndarray) -> str:
    """The page's content blocks, joined by an empty line."""
    found = blocks(page or "")
    if not found:
        return ""
    score = np.clip(features(found) @ weights, -12, 12)
    content = (np.logaddexp(0, score) * SCALE).astype(int).tolist()
    boiler = (np.logaddexp(0, -score) * SCALE).astype(int).tolist()
    edges = [(i, i + 1, int(NEXT * SCALE)) for i in range(len(found) - 1) if found[i][2] == found[i + 1][2]]
    last: dict[int, list[int]] = {}
    for i, b in enumerate(found):  # DOM proximity: the nearest earlier blocks of the same parent
        for j in last.get(b[1], ()):
            edges.append((j, i, int(NEAR * SCALE)))
        last[b[1]] = [*last.get(b[1], []), i][-CLOSE:]
    return "\n\n".join(b[0] for b, keep in zip(found, min_cut(content, boiler, edges), strict=True) if keep)


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        xs, ys = [], []
        for page in batch.column(0).to_pylist():
            found = blocks(page or "")
            for x, b in zip(features(found), found, strict=True):
                good, bad, bad_name, _ = b[2]
                if good or bad or bad_name >= 0.5:
                    xs.append(np.round(x, 3).tolist())
                    ys.append(int(bool(good) and not bad and bad_name < 0.5))
        yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.int64())], ["x", "y"])


def fit(pages: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The classifier's weights, from about ``sample`` pages chosen by the hash of their html; copies of a page only add counts."""
    ship(pages.sparkSession)
    share = min(1.0, sample / max(pages.count(), 1))
    chosen = pages.where(F.shiftrightunsigned(F.xxhash64("html"), 11) < F.lit(int(share * (1 << 53)))).select("html")
    cells = chosen.mapInArrow(_seeds, "x array<double>, y long").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    got = sorted((r["x"], r["y"], r["n"]) for r in cells.collect())  # bounded by the sampled pages' distinct blocks
    w = PRIOR.copy()
    if len({y for _, y, _ in got}) < 2:
        return w
    x, y, k = np.array([r[0] for r in got]), np.array([r[1] for r in got], float), np.array([r[2] for r in got], float)
    k /= k.sum()
    for _ in range(300):  # gradient descent, drawn towards the prior weights
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 0.5 * (x.T @ (k * (p - y)) + 0.02 * (w - PRIOR))
    return w


def _extractor(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x, weights) for x in batch.column(0).to_pylist()]
            cols = [*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[1:], "text", "n_chars"])

    return run


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page; no shuffle of pages."""
    weights = fit(pages)
    return pages.select("html", "page_id", "url").mapInArrow(_extractor(weights), "page_id long, url string, text string, n_chars long")
