"""Documents to convert: local files, remote files, and jobs at a conversion service."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from http.client import HTTPException

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Fetch = Callable[[str], bytes]
#: What a request over the network, or the reading of its reply, may end in.
FAULTS = (OSError, HTTPException, ValueError)


def fetch(url: str, timeout: float = 60) -> bytes:
    from urllib.request import urlopen

    with urlopen(url, timeout=timeout) as reply:
        return reply.read()


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, content, modificationTime, length of local or stored files."""
    return spark.read.format("binaryFile").load(path)


def remote(urls: DataFrame, get: Fetch = fetch, url: str = "url") -> DataFrame:
    """Adds content and error; one is null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            content, errors = [], []
            for u in batch[url]:
                try:
                    content.append(get(u))
                    errors.append(None)
                except FAULTS as e:
                    content.append(None)
                    errors.append(str(e))
            yield batch.assign(content=content, error=errors)

    return urls.mapInPandas(run, T.StructType([*urls.schema.fields]).add("content", "binary").add("error", "string"))


def stem(path: Column) -> Column:
    """A path's last part without its last suffix."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def short_name(name: Column) -> Column:
    """A name up to its first dot."""
    return F.substring_index(name, ".", 1)


# What the conversion service is asked for.
JOB_OPTIONS = {
    "force_ocr": True,
    "output_format": "markdown",
    "use_llm": True,
    "disable_image_extraction": True,
    "paginate": True,
    "format_lines": False,
    "additional_config": json.dumps({"drop_repeated_text": True}),
}


def submit(jobs: DataFrame, post: Callable[[dict], dict], options: dict | None = None) -> DataFrame:
    """Adds check_url and error to job_id, file_url; one is null. post sends one form and returns the service's reply.

    A job that cannot be submitted, or whose reply has no address to check, is a row with an error, and the others go
    on. A task that runs again sends again, so post should name jobs by job_id.
    """
    form = JOB_OPTIONS | (options or {})

    def send(job_id: str, file_url: str) -> tuple[str | None, str | None]:
        try:
            url = post({"job_id": job_id, "file_url": file_url, **form}).get("request_check_url")
        except FAULTS as e:
            return None, str(e)
        return url, None if url else "the reply has no request_check_url"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sent = [send(j, u) for j, u in zip(batch["job_id"], batch["file_url"], strict=True)]
            yield batch.assign(check_url=[u for u, _ in sent], error=[e for _, e in sent])

    return jobs.mapInPandas(run, T.StructType([*jobs.schema.fields]).add("check_url", "string").add("error", "string"))


def poll(submitted: DataFrame, get: Fetch = fetch, most: int = 350, wait_s: float = 2) -> DataFrame:
    """Asks each check_url until its job ends, at most `most` times with wait_s between; adds status, attempts, payload.

    submitted: see submit(). status is complete, failed, or null for jobs that never ended; their error says so, or why a
    reply could not be read. payload is the last reply as JSON. A task asks for all its jobs in turn and then waits once, so
    jobs do not wait for each other; what was submitted but has an error is not asked for.
    """
    from rivulet.streaming.poll import DONE, FAILED

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            urls = [u if isinstance(u, str) else None for u in batch["check_url"]]
            errors = [e if isinstance(e, str) else None for e in batch["error"]]
            status, attempts, payload = [None] * len(urls), [0] * len(urls), [None] * len(urls)
            going = [i for i, u in enumerate(urls) if u]
            for attempt in range(1, most + 1):
                for i in going:
                    attempts[i] = attempt
                    try:
                        reply = json.loads(get(urls[i]))
                        payload[i], now = json.dumps(reply, ensure_ascii=False), reply.get("status")
                        status[i] = now if now in (DONE, FAILED) else None
                    except (*FAULTS, AttributeError) as e:
                        errors[i] = str(e)
                going = [i for i in going if not status[i] and not errors[i]]
                if not going:
                    break
                if attempt < most:
                    time.sleep(wait_s)
            for i in going:
                errors[i] = f"not done after {most} replies"
            yield batch.assign(error=errors, status=status, attempts=attempts, payload=payload)

    schema = T.StructType([*submitted.schema.fields]).add("status", "string").add("attempts", "long").add("payload", "string")
    return submitted.mapInPandas(run, schema)
