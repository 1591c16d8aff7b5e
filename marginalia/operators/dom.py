"""One reading of the HTML per page, kept as a nested column.

``with_dom`` adds ``dom``: the page's text pieces in order and its elements in
document order. An element knows the range of pieces and of elements it spans,
so every question about the page is a slice, and is asked in Spark SQL.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from marginalia.functions.text import strip

_TEXT = pa.struct([("text", pa.string()), ("noise", pa.bool_())])
_NODE = pa.struct(
    [
        ("no", pa.int32()),
        ("tag", pa.string()),
        ("parent", pa.int32()),
        ("last_node", pa.int32()),
        ("first_text", pa.int32()),
        ("end_text", pa.int32()),
        ("noise", pa.bool_()),
        ("attrs", pa.map_(pa.string(), pa.string())),
    ]
)
_DOM = pa.struct([("texts", pa.list_(_TEXT)), ("nodes", pa.list_(_NODE))])
DOM_TYPE = from_arrow_type(_DOM)

# Elements without an end tag.
VOID_TAGS = frozenset(
    [
        "area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr", "image", "img", "input",
        "isindex", "keygen", "link", "menuitem", "meta", "nextid", "param", "source", "spacer", "track", "wbr",
    ]
)
# Text inside these is not page text.
RAW_TAGS = frozenset(["script", "style", "template"])
# Elements that are not page content.
NOISE_TAGS = frozenset(
    ["script", "style", "header", "footer", "nav", "aside", "noscript", "iframe", "form"]
)
# Substrings of an attribute that mark an element as not content.
NOISE_ATTRIBUTES = [
    ("class", "cookie"),
    ("class", "banner"),
    ("class", "ad-"),
    ("class", "sidebar"),
    ("id", "popup"),
    ("class", "popup"),
    ("id", "cookie"),
    ("class", "advertisement"),
    ("id", "advertisement"),
]
# A new paragraph ends an open one unless one of these stands between them.
PARAGRAPH_SCOPE = frozenset(
    ["li", "td", "th", "caption", "blockquote", "div", "section", "article", "main", "aside", "header", "footer", "nav", "form"]
)
_SPACES = " \n\t\f\r"
# Pages that are Python objects at a time; what is read of them is in Arrow's columns, far shorter.
AT_ONCE = 32


class _Reader(HTMLParser):
    """Collects text pieces and elements of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[dict] = []
        self.nodes: list[dict] = []
        self.open: list[dict] = []
        self.pending: list[str] = []
        self.raw = self.preformatted = 0

    def _flush(self) -> None:
        if not self.pending:
            return
        piece, self.pending = "".join(self.pending), []
        if self.raw:
            return
        if not self.preformatted and not piece.strip(_SPACES):
            piece = "\n" if "\n" in piece else " "
        self.texts.append({"text": piece, "noise": bool(self.open) and self.open[-1]["noise"]})

    def _count(self, tag: str, step: int) -> None:
        if tag in RAW_TAGS:
            self.raw += step
        elif tag in ("pre", "textarea"):
            self.preformatted += step

    def _close(self, depth: int) -> None:
        for node in self.open[depth:]:
            node["last_node"] = len(self.nodes) - 1
            node["end_text"] = len(self.texts)
            self._count(node["tag"], -1)
        del self.open[depth:]

    def _open_paragraph(self) -> int | None:
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth]["tag"] == "p":
                return depth
            if self.open[depth]["tag"] in PARAGRAPH_SCOPE:
                return None
        return None

    def handle_starttag(self, tag, attrs):
        self._flush()
        if tag == "p" and (depth := self._open_paragraph()) is not None:
            self._close(depth)
        values = {name: value or "" for name, value in attrs}
        if "class" in values:
            values["class"] = " ".join(values["class"].split())
        parent = self.open[-1] if self.open else None
        noise = (
            (parent is not None and parent["noise"])
            or tag in NOISE_TAGS
            or any(mark in values.get(name, "") for name, mark in NOISE_ATTRIBUTES)
        )
        node = {
            "no": len(self.nodes),
            "tag": tag,
            "parent": parent["no"] if parent else -1,
            "last_node": len(self.nodes),
            "first_text": len(self.texts),
            "end_text": len(self.texts),
            "noise": noise,
            "attrs": list(values.items()),
        }
        self.nodes.append(node)
        if tag not in VOID_TAGS:
            self.open.append(node)
            self._count(tag, 1)

    def handle_endtag(self, tag):
        self._flush()
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth]["tag"] == tag:
                self._close(depth)
                return

    def handle_data(self, data):
        self.pending.append(data)

    def handle_comment(self, data):
        self._flush()

    def handle_decl(self, decl):
        self._flush()

    def handle_pi(self, data):
        self._flush()

    def unknown_decl(self, data):
        self._flush()

    def read(self, html: str) -> dict:
        self.feed(html)
        self.close()
        self._flush()
        self._close(0)
        return {"texts": self.texts, "nodes": self.nodes}


@F.arrow_udf(DOM_TYPE)
def read_html(html: pa.Array) -> pa.Array:
    parts = []
    for start in range(0, len(html), AT_ONCE):
        pages = [None if page is None else _Reader().read(page) for page in html.slice(start, AT_ONCE).to_pylist()]
        parts.append(pa.array(pages, type=_DOM))
    return pa.concat_arrays(parts) if parts else pa.array([], type=_DOM)


# Nondeterministic only to the optimizer, so that one page is never read twice in a plan.
_read_once = read_html.asNondeterministic()


def with_dom(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add ``dom``; pages that already have it pass through."""
    return pages if "dom" in pages.columns else pages.withColumn("dom", _read_once(F.col(html)))


def nodes_of(*tags: str) -> Column:
    return F.filter(F.col("dom.nodes"), lambda n: n["tag"].isin(*tags))


def inside(node: Column, *tags: str) -> Column:
    """Elements with one of the tags below ``node``."""
    below = F.slice(F.col("dom.nodes"), node["no"] + 2, node["last_node"] - node["no"])
    return F.filter(below, lambda n: n["tag"].isin(*tags))


def _pieces(node: Column) -> Column:
    return F.slice(
        F.col("dom.texts"), node["first_text"] + 1, node["end_text"] - node["first_text"]
    )


def text_of(node: Column) -> Column:
    return F.array_join(F.transform(_pieces(node), lambda t: t["text"]), "")


def content_text_of(node: Column) -> Column:
    """Text without what sits in noise elements."""
    kept = F.filter(_pieces(node), lambda t: ~t["noise"])
    return F.array_join(F.transform(kept, lambda t: t["text"]), "")


def tight_text_of(node: Column) -> Column:
    """Pieces stripped one by one and joined with nothing between."""
    return F.array_join(F.transform(_pieces(node), lambda t: strip(t["text"])), "")
