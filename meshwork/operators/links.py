"""Title, text and links of HTML pages, and the report of a page's links."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Links that a report holds, and characters of a link's text, of its address, and of a title.
MOST_LINKS, TEXT_CHARS, ADDRESS_CHARS, TITLE_CHARS = 200, 90, 300, 200

#: Attributes of a tag: quotes count after a sign of equality only.
_INSIDE = r"""(?:[^>"'=]|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?|["'])*+"""
#: What a page is cut into, in one pass from left to right: a comment, a whole script or style, a tag with its attributes, or text.
#: Each takes in what follows up to its end or the page's, and gives nothing back, so that a page takes linear time.
_PIECE = re.compile(
    rf"""<!--.*?(?:-->|\Z) | <(?P<raw>script|style)\b{_INSIDE}(?:>|\Z).*?(?:</(?P=raw)\s*+>|\Z)
    | <(?P<close>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attributes>{_INSIDE})(?P<end>>|\Z) | <[!?][^>]*+(?:>|\Z) | (?P<text>[^<]++|<)""",
    re.I | re.S | re.X,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")


def _attribute(attributes: str, name: str) -> str | None:
    for found in _ATTRIBUTE.finditer(attributes):
        if found[1].lower() == name:
            return html.unescape(next((v for v in found.groups()[1:] if v is not None), ""))
    return None


def _absolute(base: str, href: str) -> str:
    try:
        return urljoin(base, href)
    except ValueError:  # an address that is none, as of a broken host
        return href


def scan_page(url: str | None, page: str | None) -> tuple[str, str, list[tuple[int, str, str]]]:
    """Title, text, and links ``pos, href, text`` of a page; addresses are resolved against its base tag's or its own."""
    base, based = url or "", False
    title, text, links, anchor, in_title = [], [], [], None, False
    for piece in _PIECE.finditer(page or ""):
        tag = (piece["tag"] or "").lower() if piece["end"] else ""
        if piece["text"] is not None:
            said = html.unescape(piece["text"])
            if in_title:
                title.append(said)
            if anchor:
                anchor[1].append(said)
            if said.strip():
                text.append(said.strip())
        elif tag and piece["close"]:
            if tag == "a" and anchor:
                links.append((len(links), anchor[0], "".join(anchor[1])))
                anchor = None
            in_title = False
        elif tag:
            if tag == "base" and not based and (href := _attribute(piece["attributes"], "href")):
                base, based = _absolute(base, href), True
            if tag == "a" and (href := _attribute(piece["attributes"], "href")):
                anchor = (_absolute(base, href), [])
            in_title = tag == "title"
    return "".join(title), " ".join(text), links


def scan_pages(pages: DataFrame) -> DataFrame:
    """``page_id, title, text, links`` of whole pages ``page_id, url, html``, one row each.

    Scripts, styles and comments are left out; entities are read; a null page is an empty one, a link that is never
    closed none.
    """
    link = pa.list_(pa.struct([("pos", pa.int32()), ("href", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                told = [scan_page(u, h) for u, h in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                links = [[{"pos": p, "href": h, "text": t} for p, h, t in found] for _, _, found in told]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t[0] for t in told]), pa.array([t[1] for t in told]), pa.array(links, link)], names=["page_id", "title", "text", "links"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, title string, text string, links array<struct<pos: int, href: string, text: string>>")


def page_report(scanned: DataFrame) -> DataFrame:
    """``page_id, title, n, href, text``: the web addresses that a page links to, each once, those of PDF files first, at most
    ``MOST_LINKS``; ``n`` and the rest are null for a page without any."""
    words = lambda c, most: F.substring(F.trim(F.regexp_replace(c, r"[\s\x{85}\x{A0}\x{2028}\x{2029}]+", " ")), 1, most)
    each = scanned.select("page_id", F.explode("links").alias("l")).select("page_id", "l.*").filter(F.col("href").startswith("http"))
    first = each.groupBy("page_id", "href").agg(F.min(F.struct("pos", "text")).alias("f")).select("page_id", "href", "f.*")
    order = Window.partitionBy("page_id").orderBy(F.lower("href").contains(".pdf").desc(), "pos")
    kept = first.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= MOST_LINKS)
    told = kept.select("page_id", "n", F.substring("href", 1, ADDRESS_CHARS).alias("href"), words(F.col("text"), TEXT_CHARS).alias("text"))
    return scanned.select("page_id", words(F.col("title"), TITLE_CHARS).alias("title")).join(told, "page_id", "left")
