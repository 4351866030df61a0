"""Requests resolved against listings: exact, latest, nearest earlier quarter, or a choice among alternatives.

A listing is cut to the scans (code and year, or the code alone) that requests name, and summed up once for each: of
each bucket, its first row. That is a fixed number of values, so a request meets one row, whatever the listing's length,
and the decision is an expression over it. Rows are aggregated by scan and bucket before they are shuffled; requests for
the same scan share it. Codes are compared in upper case throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.functions import vocabulary as v
from rivulet.functions.text import absolute, clean_title, fill, some, title_period, title_quarter, title_status

QUARTERS = (1, 2, 3, 4)
_CHOICE = "struct<period:string,quarter:int,consolidation_status:string,title:string,link:string>"


def classify(listing: DataFrame) -> DataFrame:
    """Adds title, link, period, quarter and consolidation_status to title_raw and link_raw."""
    named = listing.withColumns({"title": clean_title(F.col("title_raw")), "link": absolute(F.col("link_raw"))})
    title = F.col("title")
    return named.withColumns({"period": title_period(title), "quarter": title_quarter(title), "consolidation_status": title_status(title)})


#: A scan's buckets: all rows, those whose title says a status, and those of a period, quarter and status.
BUCKETS = ("first", *(f"{name}{s}" for s in range(len(v.STATUSES)) for name in ("says", "half", "annual", *(f"quarter{q}" for q in QUARTERS))))


def _buckets() -> Column:
    """The names of the buckets that take a classified row."""
    period, low = F.col("period"), F.col("_low")
    status = F.coalesce(*(F.when(F.col("consolidation_status") == of, F.lit(str(s))) for s, of in enumerate(v.STATUSES)))
    kind = F.when(period == v.HALF, "half").when(period == v.ANNUAL, "annual").when(period == v.QUARTER, F.concat(F.lit("quarter"), F.col("quarter").cast("string")))
    says = (F.when(low.contains(of.lower()), F.lit(f"says{s}")) for s, of in enumerate(v.STATUSES))
    return F.filter(F.array(F.lit("first"), *says, F.concat(kind, status)), lambda x: x.isNotNull())


def summary(classified: DataFrame, cut: bool = False) -> DataFrame:
    """scan_code, scan_year (null: all years of the code), rows, failed and a struct<pos, title, link> for each bucket.

    cut: the rows have a scan_code and scan_year already; else each counts for its year and for all years.
    """
    c = F.col
    if not cut:
        years = F.array_distinct(F.array(c("listing_year"), F.lit(None).cast("int")))
        classified = classified.withColumns({"scan_code": F.upper(c("stock_code").cast("string")), "scan_year": F.explode(years)})
    may_fail = "status" in classified.columns
    ok = c("status") == "ok" if may_fail else F.lit(True)
    why = F.when(~ok, F.struct("status", "detail")) if may_fail else F.lit(None).cast("struct<status:string,detail:string>")
    named = classified.withColumn("_low", F.lower("title"))
    each = named.select("scan_code", "scan_year", F.when(ok, F.struct("pos", "title", "link")).alias("row"), why.alias("why"), F.explode(F.when(ok, _buckets()).otherwise(F.array(F.lit("failed")))).alias("bucket"))
    of_bucket = each.groupBy("scan_code", "scan_year", "bucket").agg(F.count("*").alias("n"), F.min("row").alias("row"), F.max("why").alias("why"))
    entry = F.struct("bucket", F.struct("n", "row", "why").alias("found"))
    maps = of_bucket.groupBy("scan_code", "scan_year").agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    at = lambda name, field: F.try_element_at("m", F.lit(name)).getField(field)
    return maps.select("scan_code", "scan_year", F.coalesce(at("first", "n"), F.lit(0)).alias("rows"), at("failed", "why").alias("failed"), *(at(b, "row").alias(b) for b in BUCKETS))


def scan_year(period: Column, year: Column) -> Column:
    """The year that a request's listing is cut to; null: none."""
    return F.when(~period.eqNullSafe(v.LATEST) & some(year), year)


def scans(requests: DataFrame) -> DataFrame:
    """scan_code, scan_year, requests: each listing that is to be read, once, and for how many."""
    keyed = requests.select(F.upper(F.col("stock_code").cast("string")).alias("scan_code"), scan_year(F.col("period"), F.col("year")).alias("scan_year"))
    return keyed.groupBy("scan_code", "scan_year").agg(F.count("*").alias("requests"))


def _choices(*found: tuple[str, Column, str, Column]) -> Column:
    """Choices of those buckets that have a row. found: period, quarter, status, bucket."""
    made = (
        F.when(row.isNotNull(), F.struct(F.lit(period).alias("period"), quarter.cast("int").alias("quarter"), F.lit(status).alias("consolidation_status"), row["title"].alias("title"), row["link"].alias("link")))
        for period, quarter, status, row in found
    )
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def _by_status(period: str, name: str, quarter: Column) -> Column:
    return _choices(*((period, quarter, of_status, F.col(f"{name}{s}")) for s, of_status in enumerate(v.STATUSES)))


def resolve(requests: DataFrame, listing: DataFrame, classified: bool = False) -> DataFrame:
    """Adds outcome, report_link, error_message, clarification_prompt, notification and possible_choices to requests.

    requests: stock_code, year, period, quarter, consolidation_status. listing: stock_code, listing_year, pos,
    title_raw, link_raw, and status, detail where a scan can fail. outcome is LINK, ERROR or CLARIFY.
    """
    c = F.col
    period, quarter, year, status, code = c("period"), c("quarter"), c("year"), c("consolidation_status"), c("stock_code").cast("string")
    asked = scans(requests).select("scan_code", "scan_year")
    mine = (F.upper(c("stock_code").cast("string")) == c("scan_code")) & (c("scan_year").isNull() | (c("listing_year") == c("scan_year")))
    rows = listing.join(asked, mine)
    sums = summary(rows if classified else classify(rows), cut=True)
    none = F.lit(None).cast("int")
    keyed = requests.withColumns({"_code": F.upper(code), "_year": scan_year(period, year)})
    joined = keyed.join(sums, (c("_code") == c("scan_code")) & c("_year").eqNullSafe(c("scan_year")), "left")

    # the quarter asked for, or else the nearest earlier one of the year that has anything
    of_quarter = F.array(*(_by_status(v.QUARTER, f"quarter{q}", F.lit(q)) for q in QUARTERS))
    with_any = F.filter(F.array(*map(F.lit, QUARTERS)), lambda q: (q <= quarter) & (F.size(F.element_at(c("_quarters"), q)) > 0))
    by_quarter = (period == v.QUARTER) & some(quarter)
    alternatives = F.filter(
        F.concat(*(_choices((v.HALF, none, s, c(f"half{k}")), (v.ANNUAL, none, s, c(f"annual{k}"))) for k, s in enumerate(v.STATUSES))),
        lambda x: (~(period.eqNullSafe(v.ANNUAL) & (x["period"] == v.HALF))) & (~(period.eqNullSafe(v.HALF) & (x["period"] == v.ANNUAL))),
    )
    of_status = lambda name: F.coalesce(*(F.when(status == s, c(f"{name}{k}")) for k, s in enumerate(v.STATUSES)))
    exact_quarter = F.coalesce(*(F.when((period == v.QUARTER) & (quarter == q), of_status(f"quarter{q}")) for q in QUARTERS))
    exact = F.coalesce(exact_quarter, F.when(period == v.HALF, of_status("half")), F.when(period == v.ANNUAL, of_status("annual")))

    empty = F.array().cast(f"array<{_CHOICE}>")
    staged = (
        joined.withColumn("_quarters", of_quarter)
        .withColumn("_near", F.when(by_quarter, F.array_max(with_any)))
        .withColumns(
            {
                "_case": F.when(c("failed").isNotNull(), F.when(c("failed.status") == "timeout", "timeout").otherwise("broken"))
                .when(F.coalesce(c("rows"), F.lit(0)) == 0, "empty")
                .when(period == v.LATEST, F.when(F.coalesce(status, F.lit("")) != "", "latest of status").otherwise("latest"))
                .when((F.coalesce(period, F.lit("")) != "") & (F.coalesce(status, F.lit("")) != ""), "exact")
                .otherwise("choose"),
                "_late": by_quarter & ~c("_near").eqNullSafe(quarter),
                "_found": F.when(by_quarter, F.when(c("_near").isNotNull(), F.element_at(c("_quarters"), c("_near"))).otherwise(empty)).otherwise(alternatives),
            }
        )
        .withColumns(
            {
                "_late": F.coalesce(c("_late"), F.lit(False)),
                "_row": F.when(c("_case") == "latest of status", of_status("says")).when(c("_case") == "latest", c("first")).when(c("_case") == "exact", exact),
                "_n": F.when(c("_case") == "choose", F.size("_found")),
            }
        )
    )
    case, row, n, late, only = c("_case"), c("_row"), c("_n"), c("_late"), F.element_at(c("_found"), 1)
    hit = row.isNotNull()
    asked = F.when(period == v.QUARTER, fill("{period} Quý {quarter}", period=period, quarter=quarter)).otherwise(period)
    title = row["title"]
    error = (
        F.when(case == "timeout", fill(v.UNKNOWN_CODE, code=code))
        .when(case == "broken", fill(v.BROKEN_LISTING, detail=c("failed.detail")))
        .when(case == "empty", fill(v.EMPTY_LISTING, code=code, year=year))
        .when((case == "latest of status") & ~hit, fill(v.NO_LATEST_OF_STATUS, status=status, code=code))
        .when((case == "exact") & ~hit, fill(v.NO_EXACT, asked=asked, status=status))
        .when((n == 0) & late, fill(v.NO_QUARTER, quarter=quarter, year=year))
        .when(n == 0, fill(v.NO_CHOICE, year=year))
    )
    alone = F.concat(F.when(late, fill(v.QUARTER_MISSING, quarter=quarter)).otherwise(""), fill(v.ONLY_CHOICE, title=only["title"]))
    note = (
        F.when((case == "latest of status") & hit, fill(v.LATEST_OF_STATUS, title=title))
        .when(case == "latest", fill(v.LATEST_OF_ALL, title=title))
        .when((case == "exact") & hit, fill(v.EXACT, title=title))
        .when(n == 1, alone)
    )
    head = F.when(late, fill(v.EARLIER_CHOICES, quarter=quarter, year=year)).otherwise(fill(v.CHOICES, code=F.upper(code), year=year))
    lines = F.array_join(F.transform(c("_found"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["title"], F.lit("\n"))), "")
    out = {
        "outcome": F.when(error.isNotNull(), "ERROR").when(n > 1, "CLARIFY").otherwise("LINK"),
        "report_link": F.when(hit, row["link"]).when(n == 1, only["link"]),
        "error_message": error,
        "clarification_prompt": F.when(n > 1, F.concat(head, lines, F.lit(v.WHICH))),
        "notification": note,
        "possible_choices": F.when(n > 0, c("_found")),
    }
    return staged.select(*requests.columns, *(x.alias(k) for k, x in out.items()))


def pick(resolved: DataFrame, answers: DataFrame, *keys: str) -> DataFrame:
    """Settles open choices by the first answer that is a number of one.

    answers: keys, attempt, raw. Requests without a usable answer stay open; one that is open without a prompt or choices
    is an error.
    """
    n = F.expr("try_cast(trim(raw) AS int)")
    open_ = resolved.where("outcome = 'CLARIFY'").select(*keys, F.size("possible_choices").alias("_most"))
    usable = answers.withColumn("_n", n).join(open_, list(keys)).where("_n BETWEEN 1 AND _most").groupBy(*keys).agg(F.min_by("_n", "attempt").alias("_n"))
    joined = resolved.join(usable, list(keys), "left")
    lacks = (F.col("outcome") == "CLARIFY") & ((F.coalesce("clarification_prompt", F.lit("")) == "") | (F.coalesce(F.size("possible_choices"), F.lit(0)) < 1))
    settled = F.col("_n").isNotNull() & (F.col("outcome") == "CLARIFY") & ~lacks
    chosen = F.when(settled, F.element_at("possible_choices", F.col("_n")))
    return joined.select(
        *(F.col(k) for k in resolved.columns if k not in ("outcome", "report_link", "error_message", "clarification_prompt", "possible_choices")),
        F.when(lacks, "ERROR").when(settled, "LINK").otherwise(F.col("outcome")).alias("outcome"),
        F.when(lacks, v.NO_PROMPT).otherwise(F.col("error_message")).alias("error_message"),
        F.coalesce(chosen["link"], F.col("report_link")).alias("report_link"),
        F.when(~settled, F.col("clarification_prompt")).alias("clarification_prompt"),
        F.when(~settled, F.col("possible_choices")).alias("possible_choices"),
    )
