"""Where results go."""

from __future__ import annotations

import logging
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

log = logging.getLogger("rivulet")


def json_rows(df: DataFrame, path: str, pretty: bool = True) -> None:
    """Each row as a JSON text in UTF-8, absent fields as null."""
    options = {"ignoreNullFields": "false", "pretty": str(pretty).lower()}
    df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), options).alias("value")).write.mode("overwrite").text(path)


def markdown(docs: DataFrame, path: str, *, engine: str = "engine", doc: str = "doc", text: str = "markdown", buckets: int = 0) -> None:
    """A folder for each engine and document, with the document's text as it is.

    For so many documents that a folder for each is too many: with buckets, a folder for each engine and bucket of
    documents (by hash), which holds Parquet files of doc and text.
    """
    if buckets:
        by = F.pmod(F.xxhash64(doc), F.lit(buckets)).cast("int")
        docs.select(engine, by.alias("bucket"), doc, text).repartition(engine, "bucket").write.mode("overwrite").partitionBy(engine, "bucket").parquet(path)
        return
    docs.select(engine, doc, text).write.mode("overwrite").partitionBy(engine, doc).option("lineSep", "\n").text(path)


def images(pages: DataFrame, path: str, get_writer=None) -> DataFrame:
    """Writes each image of pages(doc, images map<path, bytes>) under path; returns doc, image, bytes.

    Executors write, so path must be a folder that all share; get_writer() gives a function (path, bytes) for other stores.
    """

    def local():
        from pathlib import Path

        def write(at: str, content: bytes) -> None:
            Path(at).parent.mkdir(parents=True, exist_ok=True)
            Path(at).write_bytes(content)

        return write

    def run(batches):
        write = (get_writer or local)()
        for batch in batches:
            for doc, image, content in zip(batch["doc"], batch["image"], batch["content"], strict=True):
                at = PurePosixPath(image)
                if at.is_absolute() or ".." in at.parts:
                    raise ValueError(f"image path {image} leaves its folder")
                write(f"{path}/{doc}/{at}", bytes(content))
            yield pd.DataFrame({"doc": batch["doc"], "image": batch["image"], "bytes": [len(c) for c in batch["content"]]})

    each = pages.select("doc", F.explode("images").alias("image", "content"))
    return each.mapInPandas(run, "doc string, image string, bytes long")


def trace(df: DataFrame, step: str) -> tuple[DataFrame, Observation]:
    """The same rows, and an observation of how many there were, to be read once they have been computed."""
    log.info("step %s is planned", step)
    seen = Observation(step)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
