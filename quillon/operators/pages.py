"""Records from stored HTML pages, by tables of rules.

A rule names a field, elements to look for, and what to take of them. Elements are given as (tag, {attribute: value}); class values match any one
class, a value that ends in * matches a beginning, None any value.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that have no content.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


@dataclass
class Node:
    tag: str
    attrs: dict[str, str]
    children: list = field(default_factory=list)

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def walk(self) -> Iterator[Node]:
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def fits(self, tag: str, wanted: dict[str, str | None]) -> bool:
        if self.tag != tag:
            return False
        for name, value in wanted.items():
            own = self.attrs.get(name)
            if own is None:
                return False
            if value is not None and not (own.startswith(value[:-1]) if value.endswith("*") else value in own.split() if name == "class" else own == value):
                return False
        return True

    def find(self, tag: str, wanted: dict[str, str | None]) -> list[Node]:
        return [n for n in self.walk() if n.fits(tag, wanted)]


class _Reader(HTMLParser):
    """A tree of a page; an end tag closes up to its start, one without start is ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in _VOID and len(self.open) < 200:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        self.open[-1].children.append(data)


def read_page(html: str | None) -> Node:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return reader.root


@dataclass(frozen=True)
class Rule:
    """A field of a page: the first alternative that finds text.

    Each alternative is (element, label, inner, take): the first element whose text has the label; of its inner elements (or itself) the stripped texts, joined
    by comma and blank, or an attribute's value; take is 'text', 'texts' or '@name'. pattern then cuts out its first group.
    """

    name: str
    alternatives: tuple
    pattern: str = ""


#: Rules of the two layouts.
GALLERY_RULES = (
    Rule("title", ((("h2", {"class": "title"}), "", None, "text"), (("h1", {"class": "title"}), "", ("span", {"class": "pretty"}), "text"), (("h1", {"class": "title"}), "", None, "text"))),
    *[Rule(n, (((("div", {"class": "field-name"})), f"{n.capitalize()}:", ("span", {"class": "name"}), "texts"),)) for n in ("tags", "artists", "groups", "languages", "pages")],
    Rule("uploaded_date", ((("div", {"class": "field-name"}), "Uploaded:", ("time", {"datetime": None}), "@datetime"),), r"(.{0,10})"),
)
ALBUM_RULES = (
    Rule("title", ((("h1", {"id": "book-name"}), "", None, "text"),)),
    Rule("tags", ((("span", {"itemprop": "genre", "data-type": "tags"}), "", ("a", {}), "texts"),)),
    Rule("author", ((("span", {"itemprop": "author", "data-type": "author"}), "", ("a", {}), "texts"),)),
    Rule("upload_date", ((("span", {"itemprop": "datePublished"}), "", None, "text"),), r"(\d{4}-\d{2}-\d{2})"),
)


def _take(root: Node, rule: Rule) -> str:
    for (tag, wanted), label, inner, take in rule.alternatives:
        outer = next((n for n in root.find(tag, wanted) if label in n.text()), None)
        if outer is None:
            continue
        nodes = outer.find(*inner) if inner else [outer]
        if take == "texts":
            found = ", ".join(t for t in (n.text().strip() for n in nodes) if t)
        elif take == "text":
            found = nodes[0].text().strip() if nodes else ""
        else:
            found = nodes[0].attrs.get(take[1:], "") if nodes else ""
        if found:
            m = re.search(rule.pattern, found, re.S) if rule.pattern else None
            return m[1] if m else found if not rule.pattern else found
    return ""


def extract_fields(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(page_id, url, a column for each rule) of pages (page_id, url, html); a missing field is empty (L1)."""
    schema = ", ".join(f"{r.name} string" for r in rules)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for htmls in batches:
            trees = [read_page(h) for h in htmls]
            yield pd.DataFrame({r.name: [_take(t, r) for t in trees] for r in rules})

    return pages.select("page_id", "url", F.pandas_udf(run, schema)("html").alias("f")).select("page_id", "url", "f.*")


@dataclass(frozen=True)
class Listing:
    """Items of a list page: elements, their link, the pattern its address must have (with the number as first group), id prefix and where the thumbnail's address is."""

    item: tuple
    link: tuple
    pattern: str
    prefix: str
    base: str
    thumb: tuple[str, ...]


#: The two layouts.
GALLERY_LIST = Listing(("div", {"class": "gallery"}), ("a", {"class": "cover"}), r"^/g/(\d+)", "NH", "", ("src", "data-src"))
ALBUM_LIST = Listing(("div", {"class": "list-col"}), ("a", {"href": "/album/*"}), r"/album/(\d+)", "JM", "", ("data-original", "src"))


def extract_listing(pages: DataFrame, listing: Listing) -> DataFrame:
    """(page_id, page_no, position, id, detail_url, thumb_url) of list pages; items without a matching address are skipped, their position is counted (L2).

    page_no is the pages' own column of that name, else the number after page= in their url, else null.
    """
    number = F.lit(None)
    if "page_no" in pages.columns:
        number = F.col("page_no")
    elif "url" in pages.columns:
        number = F.nullif(F.regexp_extract("url", r"[?&]page=(\d{1,9})", 1), F.lit(""))

    def items(html: str | None) -> list[dict]:
        out = []
        for k, node in enumerate(read_page(html).find(*listing.item), 1):
            link = next(iter(node.find(*listing.link)), None)
            m = re.search(listing.pattern, link.attrs.get("href", "")) if link else None
            if m:
                image = next(iter(node.find("img", {})), None)
                thumb = next((image.attrs[a] for a in listing.thumb if image and image.attrs.get(a)), "")
                out.append({"position": k, "id": listing.prefix + m[1], "detail_url": listing.base + link.attrs["href"], "thumb_url": thumb})
        return out

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for htmls in batches:
            yield pd.Series([items(h) for h in htmls], dtype=object)

    rows = F.pandas_udf(run, "array<struct<position:int,id:string,detail_url:string,thumb_url:string>>")("html")
    return pages.select("page_id", number.cast("int").alias("page_no"), F.explode(rows).alias("i")).select("page_id", "page_no", "i.position", "i.id", "i.detail_url", "i.thumb_url")


def pending_items(listing: DataFrame, have_ids: DataFrame, have_thumbs: DataFrame) -> DataFrame:
    """listing without items that have both record and thumbnail; need_record, need_thumb (never without a thumbnail's address) (L3)."""
    a = have_ids.select("id").distinct().withColumn("_r", F.lit(True))
    b = have_thumbs.select("id").distinct().withColumn("_t", F.lit(True))
    both = listing.join(a, "id", "left").join(b, "id", "left")
    need_thumb = F.col("_t").isNull() & (F.coalesce("thumb_url", F.lit("")) != "")
    both = both.withColumns({"need_record": F.col("_r").isNull(), "need_thumb": need_thumb})
    return both.where(F.col("_r").isNull() | F.col("_t").isNull()).select(*listing.columns, "need_record", "need_thumb")
