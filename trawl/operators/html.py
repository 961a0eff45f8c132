"""The one Python pass over HTML: tree-faithful block text and links, Arrow-batched.

Spark has no HTML tree, so this is the single place where rows go through Python.
``mapInPandas`` hands each task Arrow batches of ``(keys…, url, html)``, which are parsed a piece
(1 MB of html) at a time; every page is parsed once and yields

* ``blocks`` – stripped text of every ``p``/``h1``–``h6``/``article`` element in document
  order (empty strings kept; the native chain in ``trawl.functions.text`` drops, dedups,
  filters and normalises them),
* ``hrefs`` – raw ``href`` of every ``a`` element that has one (untrimmed parse),
* ``links`` – those hrefs resolved against the page URL (rejects dropped),
* ``results`` – for search-result pages only, hrefs under ``li.b_algo h2 a`` in order.

Tree rules (those of a non-correcting HTML parser, kept on purpose):
no implied closing (``<p>x<p>y`` nests), an end tag pops to its nearest open match,
unmatched end tags are ignored, void elements never hold children, comments split text
runs, entities are decoded per run. ``get_text(strip=True)`` semantics: every text run
below the element is stripped on its own and runs are concatenated with ``separator``.
"""

from __future__ import annotations

import html.entities
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.batches import bounds, pieces, thrifty
from ..session import ship_package

# Fixed values (must equal the reference's behaviour).
# Elements removed with their whole subtree before text is taken:
DROPPED_TAGS = frozenset(["script", "style", "nav", "footer", "header", "aside", "form"])
# Elements whose text becomes a block:
TEXT_TAGS = frozenset(["p", "h1", "h2", "h3", "h4", "h5", "h6", "article"])
# Void elements of the HTML tree builder (they are closed as soon as they open):
VOID_TAGS = frozenset([
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem",
    "meta", "param", "source", "track", "wbr", "basefont", "bgsound", "command", "frame",
    "image", "isindex", "nextid", "spacer",
])
# Elements whose strings are not plain text (ruby annotations, templates, code):
NON_TEXT_CONTAINERS = frozenset(["rt", "rp", "template", "script", "style"])
# Search-result selector ``li.b_algo h2 a``:
RESULT_ITEM_TAG, RESULT_ITEM_CLASS, RESULT_HEAD_TAG = "li", "b_algo", "h2"


def _entity(name: str) -> str:
    ch = html.entities.html5.get(name + ";")
    return ch if ch is not None else "&" + name


def _charref(name: str) -> str:
    try:
        code = int(name[1:], 16) if name[:1] in ("x", "X") else int(name)
    except ValueError:
        return "�"
    if code < 256:
        # Low numeric references are read as windows-1252 bytes first.
        try:
            return bytes([code]).decode("windows-1252")
        except UnicodeDecodeError:
            pass
    try:
        return chr(code)
    except (ValueError, OverflowError):
        return "�"


class _Node:
    __slots__ = ("tag", "block", "dropped", "nontext", "result_item", "result_head")

    def __init__(self, tag, block, dropped, nontext, result_item, result_head):
        self.tag = tag
        self.block = block  # index into blocks, or -1
        self.dropped = dropped  # inside a removed subtree (this node included)
        self.nontext = nontext  # strings here are not text
        self.result_item = result_item  # an ``li.b_algo`` is open at or above this node
        self.result_head = result_head  # an ``h2`` is open below such an ``li``


class PageParser(HTMLParser):
    """Stack tree over ``HTMLParser`` events; collects blocks, hrefs and result hrefs."""

    def __init__(self, separator: str = "", want_results: bool = False):
        super().__init__(convert_charrefs=False)
        self.separator = separator
        self.want_results = want_results
        self.stack: list[_Node] = [_Node("[document]", -1, False, False, False, False)]
        self.open_count: dict[str, int] = {}
        self.closed_void: list[str] = []
        self.run: list[str] = []
        self.runs: list[str] = []  # every text run once
        self.spans: list[list[int]] = []  # per block its first run and the run after its last
        self.hrefs: list[str] = []
        self.results: list[str] = []

    # -- text runs -------------------------------------------------------------------
    def _flush(self) -> None:
        if not self.run:
            return
        s = "".join(self.run)
        self.run = []
        top = self.stack[-1]
        if top.dropped or top.nontext:
            return
        s = s.strip()
        if not s:
            return
        self.runs.append(s)

    def handle_data(self, data):
        self.run.append(data)

    def handle_entityref(self, name):
        self.run.append(_entity(name))

    def handle_charref(self, name):
        self.run.append(_charref(name))

    def handle_comment(self, data):
        self._flush()

    def handle_decl(self, decl):
        self._flush()

    def handle_pi(self, data):
        self._flush()

    def unknown_decl(self, data):
        self._flush()
        if data.upper().startswith("CDATA["):
            self.run.append(data[6:])
            self._flush()

    # -- tags ------------------------------------------------------------------------
    def _open(self, tag, attrs):
        self._flush()
        parent = self.stack[-1]
        attr = {}
        for k, v in attrs:
            attr[k] = "" if v is None else v
        dropped = parent.dropped or tag in DROPPED_TAGS
        block = -1
        if tag in TEXT_TAGS and not dropped:
            block = len(self.spans)
            self.spans.append([len(self.runs), -1])
        result_item = parent.result_item or (
            tag == RESULT_ITEM_TAG and RESULT_ITEM_CLASS in attr.get("class", "").split()
        )
        result_head = parent.result_head or (tag == RESULT_HEAD_TAG and parent.result_item)
        if tag == "a" and "href" in attr:
            href = attr["href"]
            self.hrefs.append(href)
            if self.want_results and result_head and href:
                self.results.append(href)
        node = _Node(tag, block, dropped, parent.nontext or tag in NON_TEXT_CONTAINERS, result_item, result_head)
        self.stack.append(node)
        self.open_count[tag] = self.open_count.get(tag, 0) + 1

    def _close(self, tag):
        self._flush()
        if not self.open_count.get(tag):
            return
        while len(self.stack) > 1:
            node = self.stack.pop()
            self.open_count[node.tag] -= 1
            if node.block >= 0:
                self.spans[node.block][1] = len(self.runs)
            if node.tag == tag:
                break

    def handle_starttag(self, tag, attrs):
        self._open(tag, attrs)
        if tag in VOID_TAGS:
            self._close(tag)
            self.closed_void.append(tag)

    def handle_startendtag(self, tag, attrs):
        self._open(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in self.closed_void:
            self.closed_void.remove(tag)
            return
        self._close(tag)

    def finish(self):
        self.close()
        self._flush()
        sep, runs, made = self.separator, self.runs, {}
        for start, end in self.spans:
            end = len(runs) if end < 0 else end  # still open at the page's end
            if (start, end) not in made:
                made[start, end] = sep.join(runs[start:end])
        return [made[start, len(runs) if end < 0 else end] for start, end in self.spans]


def parse_page(html_text: str | None, base_url: str | None, separator: str = "", want_results: bool = False):
    """Parse one page; returns (blocks, hrefs, links, results, rejected).

    ``None`` html gives empties. Markup that the parser rejects gives empties and
    ``rejected``: the page counts as fetched, and the rest of the job goes on."""
    if html_text is None:
        return [], [], [], [], False
    p = PageParser(separator=separator, want_results=want_results)
    try:
        p.feed(html_text)
        blocks = p.finish()
    except (AssertionError, ValueError):  # what HTMLParser raises on broken declarations
        return [], [], [], [], True
    links = []
    if base_url is not None:
        for h in p.hrefs:
            try:
                links.append(urljoin(base_url, h))
            except ValueError:
                # A malformed href (e.g. ``http://[``) is rejected alone, not the whole page.
                continue
    return blocks, p.hrefs, links, p.results, False


PARSE_FIELDS = [
    T.StructField("blocks", T.ArrayType(T.StringType(), False), False),
    T.StructField("hrefs", T.ArrayType(T.StringType(), False), False),
    T.StructField("links", T.ArrayType(T.StringType(), False), False),
    T.StructField("parse_error", T.BooleanType(), False),
]
RESULT_FIELDS = [T.StructField("results", T.ArrayType(T.StringType(), False), False),
                 T.StructField("parse_error", T.BooleanType(), False)]


def parse_pages(df: DataFrame, url_col: str = "url", html_col: str = "html", separator: str = "") -> DataFrame:
    """``(…, url, html)`` → ``(…, url, blocks, hrefs, links, parse_error)``; one Arrow-batched parse per page.

    ``html`` is consumed (not passed on): select only the columns you need before calling,
    and filter on ``url`` before this step, since nothing is pushed through a Python stage.
    """
    keep = [f for f in df.schema.fields if f.name != html_col]
    out_schema = T.StructType(keep + PARSE_FIELDS)
    keep_names = [f.name for f in keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        thrifty()
        for pdf in batches:
            # some pages (1 MB of html) at a time: the parsed output of a batch is never held whole
            for a, b in bounds(np.array([len(h or "") for h in pdf[html_col]], np.int64)):
                part = pdf.iloc[a:b]
                parsed = [parse_page(h, u, separator=separator) for h, u in zip(part[html_col], part[url_col])]
                out = part[keep_names].copy()
                for i, name in enumerate(("blocks", "hrefs", "links")):
                    out[name] = [x[i] for x in parsed]
                out["parse_error"] = [x[4] for x in parsed]
                yield out

    ship_package(df.sparkSession)
    return df.mapInPandas(run, out_schema)


def parse_results(df: DataFrame, html_col: str = "html") -> DataFrame:
    """``(…, html)`` of search-result pages → ``(…, results, parse_error)``: hrefs under ``li.b_algo h2 a``."""
    keep = [f for f in df.schema.fields if f.name != html_col]
    out_schema = T.StructType(keep + RESULT_FIELDS)
    html_at = df.columns.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, html_at):
            parsed = [parse_page(h, None, want_results=True) for h in part.column(html_at).to_pylist()]
            kept = [c for i, c in enumerate(part.columns) if i != html_at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([x[3] for x in parsed], pa.list_(pa.string())),
                                              pa.array([x[4] for x in parsed], pa.bool_())], out_schema.names)

    ship_package(df.sparkSession)
    return df.mapInArrow(run, out_schema)
