"""HTML to metadata and text, on the standard library's parser."""

from __future__ import annotations

import html as entities
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.scalar import rfc3339

#: Fixed values of the page format: elements and roles that hold no article text, element kinds, and the meaning of meta names.
STRIP_TAGS = set("aside button canvas dialog footer form hr input label link menu meta nav noscript object option progress script select style svg template title".split())
STRIP_ROLES = set("alert alertdialog button checkbox combobox complementary feed menu menubar navigation none note presentation search searchbox tablist toolbar tooltip tree treegrid".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
META = {"article:modified_time": "timestamp_modified", "article:published_time": "timestamp", "description": "description", "og:description": "description", "og:image": "image_url", "og:locale": "lang", "og:title": "title", "title": "title", "twitter:description": "description", "twitter:image:src": "image_url", "twitter:title": "title"}
FIELDS = ("description", "image_url", "lang", "snippet", "timestamp", "timestamp_modified", "title")
ARTICLE_TYPES = {"http://schema.org/Article", "https://schema.org/Article"}
MOST_CHARS, SNIPPET_CHARS = 65536, 251
#: Pages that are parsed at once.
PAGES = 256
CLOSES_P = BLOCKS - {"body", "td", "th", "tr"}


@dataclass
class Node:
    tag: str
    attrs: dict[str, str | None]
    parts: list = field(default_factory=list)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):  # noqa: ANN001, ANN201
        if tag in CLOSES_P and self.open[-1].tag == "p":
            self.open.pop()
        node = Node(tag, dict(attrs))
        self.open[-1].parts.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):  # noqa: ANN001, ANN201
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):  # noqa: ANN001, ANN201
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):  # noqa: ANN001, ANN201
        self.open[-1].parts.append(data)


def _walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        at = stack.pop()
        yield at
        stack.extend(p for p in reversed(at.parts) if isinstance(p, Node))


def _stripped(node: Node) -> bool:
    return node.tag in STRIP_TAGS or "hidden" in node.attrs or "aria-hidden" in node.attrs or (node.attrs.get("role") or "") in STRIP_ROLES


def text_of(node: Node, links: bool = False) -> str:
    """Text with a blank line around block elements; lines trimmed, white space collapsed, blank lines dropped."""
    out: list[str] = []
    stack: list = [node]
    while stack:
        at = stack.pop()
        if isinstance(at, str):
            out.append(at)
        elif at.tag == "br":
            out.append("\n")
        elif at is node or not _stripped(at):
            around = "\n\n" if at.tag in BLOCKS else ""
            href = at.attrs.get("href") if links and at.tag == "a" else None
            before, after = around + ("[" if href else ""), (f"]({href})" if href else "") + around
            stack += [after, *reversed(at.parts), before]
    lines = (" ".join(line.split()) for line in "".join(out).split("\n"))
    return "\n\n".join(line for line in lines if line)


def parse_page(html: str | None) -> dict[str, str | None]:
    """Metadata fields and ``text`` of a page; a null or empty page has an empty text."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    meta: dict[str, str | None] = dict.fromkeys(FIELDS)
    article = body = None

    def find(node: Node, in_main: bool, in_head: bool) -> None:
        nonlocal article, body
        stack = [(node, in_main, in_head)]
        while stack:
            at, main, head = stack.pop()
            if at.tag == "html" and at.attrs.get("lang"):
                meta["lang"] = meta["lang"] or at.attrs["lang"]
            if head and at.tag == "title" and meta["title"] is None:
                meta["title"] = at.attrs.get("title") or "".join(p for p in at.parts if isinstance(p, str))
            if at.tag == "meta":
                name = META.get(at.attrs.get("name") or at.attrs.get("property") or "")
                if name and at.attrs.get("content") is not None:
                    meta[name] = at.attrs["content"]
            if article is None and not _stripped(at) and ((main and at.tag == "article") or at.attrs.get("id") == "article" or at.attrs.get("role") == "article" or at.attrs.get("itemtype") in ARTICLE_TYPES):
                article = at
            if body is None and at.tag == "body":
                body = at
            stack.extend((p, main or at.tag == "main", head or at.tag == "head") for p in reversed(at.parts) if isinstance(p, Node))

    find(tree.root, False, False)
    meta["text"] = text_of(article or body or Node("#none", {}))[:MOST_CHARS]
    meta["snippet"] = meta["text"][:SNIPPET_CHARS]
    return meta


def parse_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without ``html`` but with the metadata fields and ``text``; timestamps that are none become null."""
    kept = [c for c in pages.columns if c != html and c not in (*FIELDS, "text")]
    at = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, PAGES) for whole in batches for i in range(0, whole.num_rows, PAGES)):
            rows = [parse_page(h) for h in batch.column(at).to_pylist()]
            yield pa.record_batch([*[batch.column(i) for i in range(at)], *[pa.array([r[f] for r in rows], pa.string()) for f in (*FIELDS, "text")]], names=[*kept, *FIELDS, "text"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*kept).schema] + [f"{f} string" for f in (*FIELDS, "text")])
    parsed = pages.select(*kept, html).mapInArrow(run, schema)
    return parsed.withColumns({c: rfc3339(F.col(c)) for c in ("timestamp", "timestamp_modified")})


def unescape(text: Column) -> Column:
    """HTML character references as characters (Arrow UDF)."""

    @F.pandas_udf("string")
    def decode(values):  # noqa: ANN001, ANN202
        return values.map(lambda t: None if t is None else entities.unescape(t))

    return decode(text)
