"""A data source for filing listings: spark.read.format("filing_listing").

Options: codes (comma-separated), years (comma-separated, empty: the whole listing), url (a template with {code} and
perhaps {year}; file and http addresses work) and timeout in seconds. One partition reads one page: of a code and year,
or, where the url has no {year}, of a code, whose rows are then those whose titles name a year asked for. A filter on
listing_year or stock_code is pushed down, so other pages are not read; without the option years, a filter on
listing_year chooses them. A page that cannot be read yields one row for each year with status timeout or error, and
the query goes on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from http.client import HTTPException
from urllib.error import URLError
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from rivulet.functions import vocabulary as v
from rivulet.sources.pages import listing_rows

SCHEMA = "stock_code string, listing_year int, pos int, title_raw string, link_raw string, status string, detail string"
URL = v.LINK_HOST + "/{code}" + v.LISTING_PATH


class Page(InputPartition):
    def __init__(self, code: str, year: int | None, years: tuple[int | None, ...]):
        self.code, self.year, self.years = code, year, years


def shown_year(title: str) -> int | None:
    """The year that a title names, which is its last one, without the date and time at its end."""
    named = re.findall(r"(?<!\d)(?:19|20)\d\d(?!\d)", re.sub(v.TITLE_STAMP, "", title.strip()))
    return int(named[-1]) if named else None


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        split = lambda k: [x.strip() for x in options.get(k, "").split(",") if x.strip()]
        self.codes = list(dict.fromkeys(c.upper() for c in split("codes")))
        self.years: list[int | None] = list(dict.fromkeys(int(y) for y in split("years"))) or [None]
        self.url, self.timeout = options.get("url", URL), float(options.get("timeout", 30))

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("listing_year",), ("stock_code",)):
                wanted = list(f.value) if isinstance(f, In) else [f.value]
                if f.attribute == ("stock_code",):
                    self.codes = [c for c in self.codes if c in wanted]
                elif self.years == [None]:
                    self.years = sorted({y for y in wanted if y is not None})
                else:
                    self.years = [y for y in self.years if y in wanted]
            else:
                yield f

    def partitions(self) -> list[Page]:
        if "{year}" in self.url:
            return [Page(c, y, (y,)) for c in self.codes for y in self.years]
        return [Page(c, None, tuple(self.years)) for c in self.codes if self.years]

    def read(self, page: Page) -> Iterator[tuple]:
        try:
            with urlopen(self.url.format(code=page.code, year=page.year or ""), timeout=self.timeout) as reply:
                rows = listing_rows(reply.read().decode("utf-8", "replace"))
        except (URLError, HTTPException, OSError, ValueError) as e:
            late = isinstance(e, TimeoutError) or isinstance(getattr(e, "reason", None), TimeoutError)
            for year in page.years:
                yield (page.code, year, None, None, None, "timeout" if late else "error", None if late else str(e))
        else:
            for pos, (title, link) in enumerate(rows):
                if page.years == (page.year,):
                    yield (page.code, page.year, pos, title, link, "ok", None)
                elif (year := shown_year(title)) in page.years:
                    yield (page.code, year, pos, title, link, "ok", None)


class ListingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filing_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options)


def register(spark) -> None:
    """Makes the format known; pushdown of filters to Python sources is off unless the session turns it on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ListingSource)
