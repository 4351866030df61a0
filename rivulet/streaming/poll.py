"""Conversion jobs polled until they end, over a log of replies or as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 350
DONE, FAILED = "complete", "failed"


def outcomes(replies: DataFrame, *keys: str, attempt: str = "attempt", most: int = MOST) -> DataFrame:
    """keys, status, attempts, payload: the first reply among the allowed ones that ends each job; else status is null.

    replies: keys, attempt (from 1), status, payload.
    """
    allowed = F.col(attempt) <= most
    ends = allowed & F.col("status").isin(DONE, FAILED)
    first = F.min_by(F.when(ends, F.struct("status", F.col(attempt).alias("attempt"), "payload")), F.when(ends, F.col(attempt)))
    return replies.groupBy(*keys).agg(first.alias("end"), F.sum(allowed.cast("long")).alias("seen")).select(
        *keys, F.col("end.status").alias("status"), F.coalesce(F.col("end.attempt").cast("long"), "seen").alias("attempts"), F.col("end.payload").alias("payload")
    )


def stream(replies: DataFrame, key: str = "job_id", most: int = MOST) -> DataFrame:
    """The same over a stream of job_id, status, payload in order of arrival: a row when a job ends or is given up.

    A job's state is the number of its replies and whether it has ended.
    """

    def follow(job: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, over = state.get if state.exists else (0, False)
        out = None
        for batch in batches:
            for status, payload in zip(batch["status"], batch["payload"], strict=True):
                if over:
                    break
                seen += 1
                if status in (DONE, FAILED) or seen >= most:
                    over, out = True, (job[0], status if status in (DONE, FAILED) else None, seen, payload)
        state.update((seen, over))
        if out:
            yield pd.DataFrame([out], columns=[key, "status", "attempts", "payload"])

    kind = replies.schema[key].dataType.simpleString()
    return replies.groupBy(key).applyInPandasWithState(
        follow, f"{key} {kind}, status string, attempts long, payload string", "seen long, over boolean", "append", "NoTimeout"
    )
