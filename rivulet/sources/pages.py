"""Links of web pages."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.functions.text import trim

#: A link whose text holds no other element.
ANCHOR = '<a href="([^"]*)">([^<]*)</a>'


def anchors(pages: DataFrame, *keys: str, html: str = "html") -> DataFrame:
    """keys, pos, link, title of each plain link, in page order."""
    found = F.arrays_zip(
        F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)).alias("link"), F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2)).alias("title")
    )
    return pages.select(*keys, F.posexplode(found).alias("pos", "a")).select(*keys, "pos", F.col("a.link").alias("link"), trim(F.col("a.title")).alias("title"))


class _Rows(HTMLParser):
    """First link of each p.i-b-d inside a div.p-t-xs; rows without a link are left out."""

    def __init__(self) -> None:
        super().__init__()
        self.open: list[tuple[str, set[str]]] = []
        self.rows: list[tuple[str, str | None]] = []
        self.row: list | None = None
        self.inside = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        of = dict(attrs)
        if tag == "a" and self.row == []:
            self.row, self.inside = ["", of.get("href")], True
        if tag not in ("br", "img", "input", "hr", "meta", "link"):
            self.open.append((tag, set((of.get("class") or "").split())))
        if tag == "p" and "i-b-d" in self.open[-1][1] and any(t == "div" and "p-t-xs" in c for t, c in self.open[:-1]):
            self.row, self.inside = [], False

    def handle_data(self, data: str) -> None:
        if self.inside and self.row:
            self.row[0] += data

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.inside = False
        while self.open:
            t, classes = self.open.pop()
            if t == "p" and "i-b-d" in classes and self.row:
                self.rows.append((self.row[0].strip(), self.row[1]))
                self.row = None
            if t == tag:
                break


def listing_rows(html: str) -> list[tuple[str, str | None]]:
    """title, link of each row of a listing page, in page order."""
    parser = _Rows()
    parser.feed(html or "")
    parser.close()
    return parser.rows


def listing_table():
    """A table function for listing pages with nested elements: (html) -> pos, title_raw, link_raw.

    spark.udtf.register("listing_rows", listing_table()), then SELECT ... FROM pages, LATERAL listing_rows(html).
    """
    from pyspark.sql.functions import udtf

    @udtf(returnType="pos int, title_raw string, link_raw string")
    class Rows:
        def eval(self, html: str):
            for pos, (title, link) in enumerate(listing_rows(html)):
                yield pos, title, link

    return Rows
