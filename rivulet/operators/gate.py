"""Requests: decoding, exploding, and the gate that holds back reports that are not out yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rivulet.functions import vocabulary as v
from rivulet.functions.text import fill, some

REQUEST = "request_id string, stock_code string, year int, period string, quarter int, consolidation_status string"
INTENT = f"requests array<struct<{REQUEST.replace(' string', ': string').replace(' int', ': int')}>>, comparison_context string"


def decode(intents: DataFrame, json: str = "intent_json") -> DataFrame:
    """Adds intent (null where the text is not one) and valid.

    Valid are intents with a context and a list of requests, each with a code, and with period and status of the
    known ones or absent.
    """
    allowed = lambda x, values: x.isNull() | x.isin(*values)
    sound = F.forall("intent.requests", lambda r: r["stock_code"].isNotNull() & allowed(r["period"], v.PERIODS) & allowed(r["consolidation_status"], v.STATUSES))
    read = intents.withColumn("intent", F.from_json(F.col(json), INTENT, {"mode": "PERMISSIVE"}))
    valid = F.col("intent.requests").isNotNull() & F.col("intent.comparison_context").isNotNull() & sound
    return read.withColumn("valid", F.coalesce(valid, F.lit(False)))


def encode(requests: Column, context: Column) -> Column:
    """An intent as JSON; absent fields are written as null."""
    return F.to_json(F.struct(requests.alias("requests"), context.alias("comparison_context")), {"ignoreNullFields": "false"})


def explode(decoded: DataFrame, *keys: str) -> DataFrame:
    """keys, pos, and a column for each field of a request, in their order; ids that are absent count up from req_1."""
    rows = decoded.where("valid").select(*keys, F.posexplode("intent.requests").alias("pos", "request"))
    return rows.select(*keys, "pos", "request.*").withColumn("request_id", F.coalesce("request_id", F.concat(F.lit("req_"), (F.col("pos") + 1).cast("string"))))


def end_month(period: Column, quarter: Column) -> Column:
    """The month in which a period ends."""
    return F.when((period == v.QUARTER) & some(quarter), quarter * 3).when(period == v.HALF, 6).otherwise(12)


def not_out(year: Column, period: Column, quarter: Column, as_of_year: Column, as_of_month: Column) -> Column:
    """Whether a report is still to come: its period has not ended before this month. Never null."""
    later = (year > as_of_year) | ((year == as_of_year) & (end_month(period, quarter) >= as_of_month))
    return F.coalesce(later, F.lit(False))


def skip_line(code: Column, period: Column, quarter: Column, year: Column) -> Column:
    of_quarter = fill("- {code} {period} {quarter}/{year}", code=code, period=period, quarter=quarter, year=year)
    return F.when(period == v.QUARTER, of_quarter).otherwise(fill("- {code} {period}/{year}", code=code, period=period, year=year))


def gate(requests: DataFrame, as_of: Column) -> DataFrame:
    """Adds kept and skip_line (null for kept ones)."""
    c = F.col
    late = not_out(c("year"), c("period"), c("quarter"), F.year(as_of), F.month(as_of))
    return requests.withColumns({"kept": ~late, "skip_line": F.when(late, skip_line(c("stock_code"), c("period"), c("quarter"), c("year")))})


def skip_notes(gated: DataFrame, *keys: str) -> DataFrame:
    """keys, note: what was skipped, in the order of requests; no row where nothing was."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "skip_line"))), lambda x: x["skip_line"]), "\n")
    return gated.where("NOT kept").groupBy(*keys).agg(F.concat(F.lit(v.SKIPPED), lines).alias("note"))


def take_next(state: DataFrame, pending: str = "pending") -> DataFrame:
    """The first of the pending requests as current, the others as pending, and error_message where none is left."""
    left = F.coalesce(F.size(pending), F.lit(0)) > 0
    out = {
        "current": F.when(left, F.get(F.col(pending), F.lit(0))),
        pending: F.when(left, F.slice(pending, F.lit(2), F.greatest(F.size(pending) - 1, F.lit(0)))).otherwise(F.col(pending)),
        "error_message": F.when(~left, v.NO_PENDING),
    }
    return state.withColumns(out)


def renumbered(requests: DataFrame, *keys: str) -> DataFrame:
    """pos without gaps."""
    return requests.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("pos")) - 1)
