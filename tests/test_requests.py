"""Decoding, gating and the stand-in parser, by worked cases."""

import json

import pytest
from pyspark.sql import functions as F

from rivulet.functions import text
from rivulet.functions import vocabulary as v
from rivulet.operators import gate, intent

# year, period, quarter, clock, end month, kept, line if skipped
GATE = [
    (2025, "Quý", 3, "2025-10-05", 9, True, None),
    (2025, "Quý", 3, "2025-09-30", 9, False, "- FPT Quý 3/2025"),
    (2025, "Quý", 4, "2025-12-01", 12, False, "- FPT Quý 4/2025"),
    (2025, "6 tháng", None, "2025-07-01", 6, True, None),
    (2025, "6 tháng", None, "2025-06-01", 6, False, "- FPT 6 tháng/2025"),
    (2025, "Cả năm", None, "2025-12-31", 12, False, "- FPT Cả năm/2025"),
    (2024, "Cả năm", None, "2025-01-01", 12, True, None),
    (None, "Mới nhất", None, "2025-10-01", 12, True, None),
    (2025, "Mới nhất", None, "2025-10-01", 12, False, "- FPT Mới nhất/2025"),
    (2025, "Quý", None, "2025-10-01", 12, False, "- FPT Quý None/2025"),
    (2026, "Quý", 1, "2025-12-01", 3, False, "- FPT Quý 1/2026"),
    (2024, None, None, "2025-10-01", 12, True, None),
    (2024, "Quý", 5, "2025-10-01", 15, True, None),
    (2025, "Quý", 5, "2025-10-01", 15, False, "- FPT Quý 5/2025"),
    (2025, "Quý", 0, "2025-10-01", 12, False, "- FPT Quý 0/2025"),
    (2027, None, None, "2025-10-01", 12, False, "- FPT None/2027"),
]


def test_gate(spark):
    rows = [(i, "FPT", *c[:3], c[3]) for i, c in enumerate(GATE)]
    df = spark.createDataFrame(rows, "pos int, stock_code string, year int, period string, quarter int, day string")
    got = gate.gate(df, F.col("day").cast("date")).withColumn("end_month", gate.end_month(F.col("period"), F.col("quarter"))).orderBy("pos").collect()
    assert [(r.end_month, r.kept, r.skip_line) for r in got] == [c[4:] for c in GATE]
    note = gate.skip_notes(gate.gate(df, F.col("day").cast("date")), "stock_code").first().note
    assert note == v.SKIPPED + "\n".join(c[6] for c in GATE if c[6])


def test_decode_and_explode(spark):
    good = intent.intent_json([("FPT", 2024, "Quý", 3, None), ("VCB", None, "Mới nhất", None, "Hợp nhất")], "aim")
    named = json.dumps({"requests": [{"request_id": "a", "stock_code": "X"}], "comparison_context": ""})
    bad = [None, "", "no json", "{}", intent.intent_json([("FPT", 2024, "Tuần", 3, None)], "x"), json.dumps({"requests": [{"year": 1}], "comparison_context": "x"}), json.dumps({"requests": []})]
    empty = intent.intent_json([], "nothing")
    df = spark.createDataFrame(list(enumerate([good, named, empty, *bad])), "query_id int, intent_json string")
    decoded = gate.decode(df)
    assert [r.valid for r in decoded.orderBy("query_id").collect()] == [True, True, True, *[False] * len(bad)]
    rows = gate.explode(decoded, "query_id").orderBy("query_id", "pos").collect()
    assert [tuple(r) for r in rows] == [
        (0, 0, "req_1", "FPT", 2024, "Quý", 3, None),
        (0, 1, "req_2", "VCB", None, "Mới nhất", None, "Hợp nhất"),
        (1, 0, "a", "X", None, None, None, None),
    ]
    assert gate.renumbered(gate.explode(decoded, "query_id").where("pos = 1"), "query_id").first().pos == 0


def test_encoding_keeps_nulls(spark):
    row = spark.sql("SELECT 'FPT' AS stock_code, CAST(NULL AS INT) AS year")
    made = row.select(gate.encode(F.array(F.struct("stock_code", "year")), F.lit("c")).alias("j")).first().j
    assert json.loads(made) == {"requests": [{"stock_code": "FPT", "year": None}], "comparison_context": "c"}


@pytest.mark.parametrize("question,requests,aim", intent.EXAMPLES)
def test_rules_read_the_examples(question, requests, aim):
    got = json.loads(intent.by_rules(question))["requests"]
    assert [tuple(r.values()) for r in got] == list(requests)


def test_rules_assume_whole_years():
    got = json.loads(intent.by_rules("so sánh FPT 2023 và 2024"))["requests"]
    assert [(r["stock_code"], r["year"], r["period"]) for r in got] == [("FPT", 2023, "Cả năm"), ("FPT", 2024, "Cả năm")]


def test_a_failing_model_is_told_of(spark):
    def model(question):
        if question == "bad":
            raise RuntimeError("down")
        return intent.by_rules(question)

    df = spark.createDataFrame([(1, "bad"), (2, "báo cáo mới nhất của FPT"), (3, None)], "query_id int, query string")
    got = {r.query_id: r for r in intent.parse(df, model).collect()}
    assert (got[1].intent_json, got[1].intent_error) == (None, "down") and "FPT" in got[2].intent_json and got[3].intent_json


def test_text_functions(spark):
    titles = [
        ("\n Báo cáo năm 2025 30/10/2025 17:05 ", "Báo cáo năm 2025"),
        ("Báo cáo 30/10/2025 17:05 bản 2", "Báo cáo 30/10/2025 17:05 bản 2"),
        ("\u00a0Báo\u00a0cáo\u00a030/10/2025\u00a017:05", "Báo\u00a0cáo"),
        ("", ""),
        (None, None),
    ]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(titles)], "i int, raw string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", text.clean_title(F.col("raw"))).collect())
    links = [("/a.pdf", v.LINK_HOST + "/a.pdf"), ("https://x/a.pdf", "https://x/a.pdf"), ("//x", v.LINK_HOST + "//x"), ("", ""), (None, None)]
    df = spark.createDataFrame(links, "link string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", text.absolute(F.col("link"))).collect())
    day = spark.sql("SELECT DATE'2025-03-09' AS d").select(text.today(F.col("d")).alias("t")).first().t
    assert day == "Hôm nay là ngày 09 tháng 03 năm 2025"
