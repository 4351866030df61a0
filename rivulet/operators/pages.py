"""Pages of converted documents: assembly, splitting, repeated lines, and seams for the models that read images."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKER = r"\{\d+\}-{3,}"

#: A model takes a document's bytes and yields a page's markdown and its images at a time.
Model = Callable[[bytes], Iterator[tuple[str, dict[str, bytes]]]]


def convert(docs: DataFrame, get_model: Callable[[], Model], engine: str) -> DataFrame:
    """engine, doc, page_no, markdown, images of each page. get_model is called once a task, where the model is loaded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = get_model()
        for batch in batches:
            for doc, content in zip(batch["doc"], batch["content"], strict=True):
                for page_no, (text, images) in enumerate(model(bytes(content))):
                    yield pd.DataFrame({"engine": [engine], "doc": [doc], "page_no": [page_no], "markdown": [text], "images": [images]})

    return docs.select("doc", "content").mapInPandas(run, "engine string, doc string, page_no int, markdown string, images map<string,binary>")


def assemble(pages: DataFrame, keys: list[str], page_no: str = "page_no", text: str = "markdown", separator: str = "\n\n", end: str = "", paginate: bool = False) -> DataFrame:
    """keys, n_pages, markdown: pages in order. paginate puts a marker line before each; end follows the last one."""
    page = F.col(text)
    if paginate:
        page = F.concat(F.lit("{"), F.col(page_no).cast("string"), F.lit("}" + "-" * 48 + "\n\n"), page)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(page_no).alias("n"), page.alias("t"))))
    joined = F.array_join(F.transform(ordered, lambda x: x["t"]), separator)
    return pages.groupBy(*keys).agg(F.count("*").alias("n_pages"), F.concat(joined, F.lit(end)).alias("markdown"))


def split(text: Column) -> Column:
    """Pages of a text with marker lines; what stands before the first marker is left out if it is blank."""
    parts = F.split(text, MARKER)
    pages = F.when(F.trim(F.regexp_replace(F.element_at(parts, 1), r"\s", "")) == "", F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return F.transform(pages, lambda p: F.regexp_replace(p, r"^\n+|\n+$", ""))


def drop_repeated_lines(text: Column) -> Column:
    """The text with only the first of equal lines. No shuffle: a document's lines are an array."""
    return F.array_join(F.array_distinct(F.split(text, "\n")), "\n")
