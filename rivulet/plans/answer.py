"""The whole way from questions to answers, for all queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.functions import vocabulary as v
from rivulet.operators import gate, intent, resolve, respond


def answer(queries: DataFrame, listing: DataFrame, as_of: Column, answers: DataFrame | None = None, model=intent.by_rules) -> DataFrame:
    """query_id, comparison_context, collected_links, notification, error_message, final_response for each query.

    queries: query_id, query, or intent_json in place of query. listing: see resolve(). answers: query_id, request_id,
    attempt, raw; without one a choice stays open and counts as no link. as_of: the date that takes the clock's place.
    The note of the answer is the last request's; what the gate skipped is told only if no request is left.
    """
    parsed = queries if "intent_json" in queries.columns else intent.parse(queries, model)
    decoded = gate.decode(parsed)
    asked = gate.gate(gate.explode(decoded, "query_id"), as_of)
    skipped = gate.skip_notes(asked, "query_id").withColumnRenamed("note", "skip_note")
    resolved = resolve.resolve(asked.where("kept").drop("kept", "skip_line"), listing)
    if answers is not None:
        resolved = resolve.pick(resolved, answers, "query_id", "request_id")
    results = resolved.withColumn("result", respond.result(F.col("report_link"), F.col("error_message")))
    collected = respond.collect(results, ["query_id"], ["pos"])
    links = collected.groupBy("query_id").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("first", "request_id", "result"))), lambda x: F.struct(x["request_id"], x["result"]))).alias("collected_links"))
    notes = respond.last_note(results, ["query_id"], ["pos"]).withColumnRenamed("note", "last_note")
    joined = decoded
    for part in (respond.lines(collected, ["query_id"]), links, notes, skipped):
        joined = joined.join(part, "query_id", "left")
    nothing = F.when(F.col("valid") & (F.size("intent.requests") == 0), v.NOTHING_ASKED)
    note = F.when(F.col("lines").isNotNull(), F.col("last_note")).otherwise(F.coalesce("skip_note", nothing))
    context = F.col("intent.comparison_context")
    failure = F.coalesce("intent_error", "intent_json") if "intent_error" in joined.columns else F.col("intent_json")
    return joined.select(
        "query_id",
        F.when(F.col("valid"), context).alias("comparison_context"),
        F.coalesce("collected_links", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("collected_links"),
        F.when(F.col("valid"), note).alias("notification"),
        F.when(~F.col("valid"), F.concat(F.lit(v.BROKEN_QUERY.split("{")[0]), F.coalesce(failure, F.lit("")))).alias("error_message"),
        F.when(F.col("valid"), respond.render(context, note, F.col("lines"))).otherwise(F.lit(v.APOLOGY)).alias("final_response"),
    )
