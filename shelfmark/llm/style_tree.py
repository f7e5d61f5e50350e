"""Main-text extraction by a site style tree (operator 6).

The block elements of all pages of a host are merged into one tree: a style
node is an element's path of tags, classes and ids (and the place among like
elements, but for paragraphs and lists). Its importance combines,
as in the site style tree method,

* presentation: the entropy (base: number of pages) of its child sequences;
* content: one minus the average entropy of its texts, so a text that returns
  on many pages makes its node unimportant and one that is unique does not;

from the leaves up. A branch of which all parts are of little importance is
removed from each page, inside an article as outside of it; as are elements whose tag, class or id says that they are navigation, advert,
form, comments and so on. Class and id names say nothing of ``html``, ``body``,
``main`` and ``article``, nor of an element that holds most of the page's text
(unless an article has text outside of it, other than headings, as beside a
long comment thread); nor is a form that holds most of it hidden.
A branch inside an ``article`` or ``main`` may be less important than another
to stay (``LOW_INSIDE``); an article decides nothing else. A host with too few
pages for statistics relies on what the elements say, and a page of which the
statistics leave nothing keeps what the elements don't rule out.

Statistics are counted per host, path and value in Spark (combined on the map
side, so a host with a third of all pages is no hot key); only paths on
``LEAST_PAGES`` pages of a host matter. The result, the unimportant paths of
each host, is written once and joined to the pages by size: Spark broadcasts
it while it is small and else shuffles both by host.

Null or empty html gives empty text; a null url is a host of its own.
Malformed markup is read as it comes (unclosed and stray tags, broken
comments); open blocks are followed to any depth. Very long pages are read
whole. Repeated rows are pages of their own. An empty table gives no
rows. Other columns are left behind.
"""

from __future__ import annotations

import html
import re
from collections import Counter


import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import ship_package, written

#: Pages of a host that a path must be on before its statistics count.
LEAST_PAGES = 10
#: Importance under which a branch goes: inside an article, and outside of one.
LOW_INSIDE, LOW_OUTSIDE = 0.3, 0.6
GAMMA = 0.9
#: Like elements under one parent that are told apart; the rest share a node.
ALIKE = 16

#: Fixed lists of HTML element names.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "head header hgroup hr html li main menu nav noscript ol p pre section summary table tbody td tfoot th thead tr ul button select textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
HIDDEN = frozenset("script style noscript template iframe svg head title nav footer aside form menu button select textarea dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose class and id names are about the page.
WHOLE = frozenset("html body main article".split())
#: Elements that are one style node wherever they stand among like ones.
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li table dl".split())
#: An opening block that closes an open element of these names.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
#: Words of class and id names that say an element is not content.
NOISE = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer footer "
                  "login masthead menu modal nav navbar navigation newsletter notice pagination popup promo promoted promotion related reply replies respond search share "
                  "sharing sidebar signup skyscraper social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets".split())

_markup = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>""", re.S)
_names = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_split = re.compile(r"[^a-z]+")
_host = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


class Page:
    """The block elements of a page in order, and its blocks of text."""

    def __init__(self, source: str):
        #: element: (path, parent element, names it, article around it)
        self.elements: list[tuple[int, int, str, bool]] = [(0, -1, "", False)]
        #: of each element: noise by its tag, noise by its names, noise by what it or one around it says
        self.hidden, self.worded, self.noise = [False], [False], [False]
        self.children: list[list[int]] = [[]]
        self.blocks: list[tuple[int, str]] = []  # element, text
        self.alike: dict[tuple[int, str], int] = {}
        self._read(source)
        self._judge()

    def _open(self, name: str, attributes: str, parent: int) -> int:
        article = self.elements[parent][3]
        words = [w for m in _names.finditer(attributes) for w in _split.split((m[1] or m[2] or m[3] or "").lower()) if w] if "=" in attributes else []
        self.hidden.append((name in HIDDEN and name != "form") or (name == "header" and not article))
        self.worded.append(name == "form" or (name not in WHOLE and any(w in NOISE for w in words)))
        style = f"{self.elements[parent][0]}>{name}.{'.'.join(words)}"
        if name not in CONTENT:
            # like elements beside each other are nodes of their own
            n = self.alike[parent, style] = self.alike.get((parent, style), -1) + 1
            style += f"#{min(n, ALIKE)}"
        path = xxhash.xxh64_intdigest(style, 0) >> 1
        self.elements.append((path, parent, name, article or name in ("article", "main")))
        self.children.append([])
        self.children[parent].append(path)
        return len(self.elements) - 1

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("", 0)]
        opened: Counter = Counter()  # names on the stack, so that a stray end is no search
        text: list[str] = []
        at, end = 0, len(source)

        def flush() -> None:
            block = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if block:
                self.blocks.append((stack[-1][1], block))

        while at < end:
            m = _markup.search(source, at)
            if m is None:
                text.append(source[at:])
                break
            text.append(source[at:m.start()])
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                if name in BLOCKS:
                    flush()
                    while opened[name]:
                        last, _ = stack.pop()
                        opened[last] -= 1
                        if last == name:
                            break
                continue
            if name in BLOCKS or name in RAW:
                flush()
                closes = CLOSES.get(name, {"p"})
                while stack[-1][0] in closes:
                    opened[stack.pop()[0]] -= 1
                element = self._open(name, m[3], stack[-1][1])
                if name in RAW:
                    close = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
                    at = close.end() if close else end
                elif name not in VOID and not m[3].endswith("/"):
                    stack.append((name, element))
                    opened[name] += 1
            elif name == "br":
                text.append(" ")
        flush()

    def _judge(self) -> None:
        """What is noise, once it is known how much of the text each element holds."""
        size = len(self.elements)
        if not any(self.worded):
            for e in range(1, size):
                self.noise.append(self.hidden[e] or self.noise[self.elements[e][1]])
            return
        hidden = [False] * size
        for e in range(1, size):
            hidden[e] = self.hidden[e] or hidden[self.elements[e][1]]
        held, in_article = [0] * size, [0] * size
        for e, block in self.blocks:
            if not hidden[e]:
                held[e] += len(block)
                in_article[e] += len(block) if self.elements[e][3] and self.elements[e][2] not in HEADINGS else 0
        for e in range(size - 1, 0, -1):
            held[self.elements[e][1]] += held[e]
            in_article[self.elements[e][1]] += in_article[e]
        for e in range(1, size):
            whole = 2 * held[e] > held[0] and in_article[e] == in_article[0]
            self.noise.append(self.hidden[e] or (self.worded[e] and not whole) or self.noise[self.elements[e][1]])

    def values(self):
        """(path, parent path, kind, value): child sequences and texts, each once."""
        own: dict[int, list[str]] = {}
        for element, block in self.blocks:
            own.setdefault(element, []).append(block)
        for e, (path, parent, _, _) in enumerate(self.elements[1:], 1):
            if self.noise[e]:
                continue
            above = self.elements[parent][0]
            yield path, above, 0, xxhash.xxh64_intdigest(",".join(map(str, self.children[e])), 0) >> 1, len(self.children[e])
            for block in own.get(e, ()):
                yield path, above, 1, xxhash.xxh64_intdigest(block, 0) >> 1, 0

    def text(self, low: dict[int, float]) -> str:
        """The blocks that stay. ``low``: importance of the host's less important paths."""
        plain = [(e, block) for e, block in self.blocks if not self.noise[e]]
        strong = [False] * len(self.elements)  # its text, or one below it, is important
        for e, _ in plain:
            strong[e] = low.get(self.elements[e][0], 1.0) >= (LOW_INSIDE if self.elements[e][3] else LOW_OUTSIDE)
        for e in range(len(strong) - 1, 0, -1):
            strong[self.elements[e][1]] |= strong[e]
        # a page that the statistics take whole (all of it returns elsewhere) keeps what the elements don't rule out
        return "\n\n".join([block for e, block in plain if strong[e]] or [block for _, block in plain])


def _rows(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.lower(F.regexp_extract("url", _host, 1)), F.lit("")).alias("host"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))


def unimportant_paths(pages: DataFrame) -> DataFrame:
    """``host, paths`` (map of path to importance) of the branches that are not important."""
    def count(frames):
        for frame in frames:
            seen: Counter = Counter()
            for host, source in zip(frame["host"], frame["html"], strict=True):
                seen.update({(host, *v): 1 for v in Page(source).values()})
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["host", "path", "parent", "kind", "value", "children", "n"])

    def importance(key, nodes: pd.DataFrame) -> pd.DataFrame:
        """Composite importance of the paths of one host, leaves first."""
        node = {r.path: r for r in nodes.itertuples()}
        below: dict[int, list[int]] = {}
        for r in nodes.itertuples():
            below.setdefault(r.parent, []).append(r.path)
        done: dict[int, float] = {}

        def walk(path: int) -> float:
            todo = [path]
            while todo:
                p = todo[-1]
                rest = [c for c in below.get(p, ()) if c not in done]
                if rest:
                    todo += rest
                    continue
                todo.pop()
                r = node[p]
                parts = [(r.text_pages, r.content)] if r.text_pages else []
                parts += [(node[c].pages, done[c]) for c in below.get(p, ())]
                weight = sum(n for n, _ in parts)
                inner = sum(n * v for n, v in parts) / weight if weight else 0.0
                own = GAMMA ** r.children
                done[p] = (1 - own) * r.presentation + own * inner if weight else r.presentation
            return done[path]

        # an element's own text counts whatever is below it
        out = [(key[0], int(p), max(walk(p), r.content if r.text_pages else 0.0)) for p, r in node.items()]
        return pd.DataFrame([r for r in out if r[2] < max(LOW_INSIDE, LOW_OUTSIDE)], columns=["host", "path", "importance"])

    ship_package(pages.sparkSession)
    found = _rows(pages).select("host", "html").mapInPandas(
        count, "host string, path long, parent long, kind int, value long, children int, n long")
    found = found.groupBy("host", "path", "parent", "kind", "value", "children").agg(F.sum("n").alias("n"))
    child = F.col("kind") == 0
    sums = found.groupBy("host", "path", "parent").agg(
        F.sum(F.when(child, F.col("n"))).alias("pages"), F.coalesce(F.sum(F.when(~child, F.col("n"))), F.lit(0)).alias("text_pages"),
        F.sum(F.when(child, F.col("n") * F.ln("n"))).alias("n_log_n"),
        F.avg(F.when(~child, F.ln("n"))).alias("text_log"),
        (F.sum(F.when(child, F.col("n") * F.col("children"))) / F.sum(F.when(child, F.col("n")))).alias("children"))
    base = F.ln("pages")
    nodes = sums.filter(F.col("pages") >= LEAST_PAGES).select(
        "host", "path", "parent", "pages", "text_pages", "children",
        F.greatest(F.lit(0.0), (base - F.col("n_log_n") / F.col("pages")) / base).alias("presentation"),
        F.coalesce(F.greatest(F.lit(0.0), 1 - F.col("text_log") / base), F.lit(0.0)).alias("content"))
    low = nodes.groupBy("host").applyInPandas(importance, "host string, path long, importance double")
    return low.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("path", "importance"))).alias("paths"))


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``."""
    low = written(unimportant_paths(pages), "unimportant-paths").withColumnRenamed("host", "low_host")
    rows = _rows(pages)
    joined = rows.join(low, rows.host == low.low_host, "left").select("page_id", "url", "html", "paths")

    def run(frames):
        for frame in frames:
            texts = [Page(source).text(dict(paths) if paths is not None else {}) for source, paths in zip(frame["html"], frame["paths"], strict=True)]
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return joined.mapInPandas(run, "page_id long, url string, text string, n_chars long")
