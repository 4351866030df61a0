"""Results of a query's requests collected and rendered as one answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.functions import vocabulary as v
from rivulet.functions.text import fill, given


def result(link: Column, error: Column) -> Column:
    """A request's result: its link, or else its error, or else that there is neither; empty texts don't count."""
    failed = F.when(given(error).isNotNull(), fill(v.FAILED, error=error))
    return F.coalesce(given(link), failed, F.lit(v.NEITHER))


def collect(results: DataFrame, keys: list[str], order: list[str], value: str = "result", request_id: str = "request_id") -> DataFrame:
    """keys, request_id, result, first: a repeated id keeps its first place and its last value."""
    at = F.struct(*order)
    return results.groupBy(*keys, request_id).agg(F.max_by(value, at).alias("result"), F.min(at).alias("first"))


def last_note(results: DataFrame, keys: list[str], order: list[str], note: str = "notification") -> DataFrame:
    """keys, note: the last request's, even if it is null."""
    return results.groupBy(*keys).agg(F.max_by(note, F.struct(*order)).alias("note"))


def lines(collected: DataFrame, keys: list[str], request_id: str = "request_id") -> DataFrame:
    """keys, lines: a line for each request, in order of first places."""
    line = F.when(F.col("result").contains(v.FAILED_MARK), fill(v.FAILURE_LINE, id=F.col(request_id), result=F.col("result")))
    line = line.otherwise(fill(v.SUCCESS_LINE, id=F.col(request_id), result=F.col("result")))
    ordered = F.array_sort(F.collect_list(F.struct("first", line.alias("line"))))
    return collected.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("lines"))


def render(context: Column, note: Column, result_lines: Column) -> Column:
    """The answer's text. result_lines: null if nothing was collected."""
    note = given(note)
    aim = F.coalesce(context, F.lit(""))
    parts = F.array(fill(v.AIM, context=aim), F.when(note.isNotNull(), fill(v.NOTE, note=note)), F.lit(v.RESULTS), result_lines)
    whole = F.array_join(F.filter(parts, lambda x: x.isNotNull()), "\n")
    bare = F.when(note.isNotNull(), fill(v.STATE_ONLY, context=aim, note=note)).otherwise(F.lit(v.APOLOGY))
    return F.when(result_lines.isNull(), bare).otherwise(whole)
