"""Classification, the decision table, collecting and rendering, by worked cases."""

from itertools import product

from pyspark.sql import functions as F

from rivulet.functions import vocabulary as v
from rivulet.operators import intent, resolve, respond
from rivulet.plans.answer import answer

TITLES = [
    ("Báo cáo tài chính Hợp nhất Kiểm toán năm 2024", ("Cả năm", None, "Hợp nhất")),
    ("Báo cáo tài chính Công ty mẹ Kiểm toán năm 2024", ("Cả năm", None, "Công ty mẹ")),
    ("Báo cáo tài chính Hợp nhất quý 2 năm 2024", ("Quý", 2, "Hợp nhất")),
    ("Báo cáo tài chính quý 2 năm 2024", ("Quý", 2, "Công ty mẹ")),
    ("Báo cáo tài chính Hợp nhất Soát xét 6 tháng đầu năm 2024", ("6 tháng", None, "Hợp nhất")),
    ("Báo cáo tài chính Hợp nhất quý 1 năm 2024", ("Quý", 1, "Hợp nhất")),
    ("Báo cáo tài chính Hợp nhất quý III năm 2024", (None, None, "Hợp nhất")),
    ("Báo cáo tài chính quý 4 năm 2024 (chưa kiểm toán)", ("Cả năm", None, "Công ty mẹ")),
    ("Nghị quyết Hội đồng quản trị", (None, None, "Công ty mẹ")),
]
# period, quarter, status, outcome, positions chosen, text that a message holds
CASES = [
    ("Quý", 2, "Hợp nhất", "LINK", [2], "Đã tìm thấy báo cáo '"),
    ("Quý", 3, "Hợp nhất", "ERROR", [], "Không tìm thấy báo cáo 'Quý Quý 3 - Hợp nhất' bạn yêu cầu."),
    ("Quý", 3, None, "CLARIFY", [2, 3], "Không tìm thấy báo cáo cho Quý 3 Năm 2024. \nTuy nhiên"),
    ("Quý", 1, None, "LINK", [5], "Chỉ tìm thấy một báo cáo phù hợp duy nhất: '"),
    ("Quý", 4, None, "CLARIFY", [2, 3], "Không tìm thấy báo cáo cho Quý 4 Năm 2024."),
    ("6 tháng", None, None, "LINK", [4], "Chỉ tìm thấy một báo cáo"),
    ("Cả năm", None, None, "CLARIFY", [0, 1], "cho FPT năm 2024:\n1. "),
    (None, None, None, "CLARIFY", [4, 0, 1], "3. Báo cáo tài chính Công ty mẹ Kiểm toán"),
    (None, None, "Hợp nhất", "CLARIFY", [4, 0, 1], ""),
    ("Quý", None, None, "CLARIFY", [4, 0, 1], ""),
    ("Quý", None, "Hợp nhất", "ERROR", [], "'Quý Quý None - Hợp nhất'"),
    ("Mới nhất", None, "Công ty mẹ", "LINK", [1], "theo yêu cầu: '"),
    ("Mới nhất", None, None, "LINK", [0], "(Mặc định lấy"),
    ("Quý", 5, None, "CLARIFY", [2, 3], ""),
    ("Quý", 5, "Hợp nhất", "ERROR", [], "'Quý Quý 5 - Hợp nhất'"),
    ("Cả năm", None, "Công ty mẹ", "LINK", [1], ""),
    ("6 tháng", None, "Công ty mẹ", "ERROR", [], "'6 tháng - Công ty mẹ'"),
    ("Quý", 0, None, "CLARIFY", [4, 0, 1], ""),
]
LISTING = "stock_code string, listing_year int, pos int, title_raw string, link_raw string, status string, detail string"


def listed(spark, more=()):
    rows = [("FPT", 2024, i, t + " 01/02/2025 10:00", f"/{i}.pdf", "ok", None) for i, (t, _) in enumerate(TITLES)]
    return spark.createDataFrame([*rows, *more], LISTING)


def asked(spark, rows):
    schema = "request_id string, stock_code string, year int, period string, quarter int, consolidation_status string"
    return spark.createDataFrame(rows, schema)


def test_classification(spark):
    got = resolve.classify(listed(spark)).orderBy("pos").collect()
    assert [(r.title, (r.period, r.quarter, r.consolidation_status)) for r in got] == TITLES
    assert got[3].link == v.LINK_HOST + "/3.pdf"


def test_decision_table(spark):
    rows = [(f"r{i}", "fpt", 2024, *c[:3]) for i, c in enumerate(CASES)]
    got = {r.request_id: r for r in resolve.resolve(asked(spark, rows), listed(spark)).collect()}
    assert len(got) == len(CASES)
    for i, (*_, outcome, chosen, says) in enumerate(CASES):
        r = got[f"r{i}"]
        links = [v.LINK_HOST + f"/{k}.pdf" for k in chosen]
        found = [c["link"] for c in r.possible_choices] if outcome == "CLARIFY" else [r.report_link] if r.report_link else []
        assert (r.outcome, found) == (outcome, links), CASES[i]
        assert says in (r.error_message or r.clarification_prompt or r.notification)
    assert got["r6"].clarification_prompt == (
        "Tôi đã tìm thấy các báo cáo sau cho FPT năm 2024:\n1. Báo cáo tài chính Hợp nhất Kiểm toán năm 2024\n"
        "2. Báo cáo tài chính Công ty mẹ Kiểm toán năm 2024\nBạn muốn tôi phân tích báo cáo nào?"
    )
    assert not got["r3"].notification.startswith("Không") and got["r3"].possible_choices


def test_failed_and_empty_scans(spark):
    more = [("BAD", 2024, None, None, None, "timeout", None), ("ERR", 2024, None, None, None, "error", "boom"), ("NUL", 2024, 0, "Báo cáo Kiểm toán", None, "ok", None)]
    rows = [("a", "BAD", 2024, "Quý", 1, None), ("b", "err", 2024, "Quý", 1, None), ("c", "NONE", 2024, "Quý", 1, None), ("d", "NUL", 2024, "Cả năm", None, None), ("e", "FPT", 2020, "Quý", 2, None)]
    got = {r.request_id: r for r in resolve.resolve(asked(spark, rows), listed(spark, more)).collect()}
    assert got["a"].error_message == "Không tìm thấy thông tin cho mã chứng khoán 'BAD'. Vui lòng kiểm tra lại mã."
    assert got["b"].error_message == "Lỗi khi scraping web: boom"
    assert got["c"].error_message == "Không tìm thấy báo cáo nào cho mã NONE năm 2024."
    assert (got["d"].outcome, got["d"].report_link, got["d"].error_message) == ("LINK", None, None)
    assert got["e"].error_message == "Không tìm thấy báo cáo nào cho mã FPT năm 2020."


def test_every_pattern_of_quarters(spark):
    """The nearest earlier quarter by a loop, over all 256 patterns of what there is and all quarters asked for."""
    listing, requests, want = [], [], {}
    for n, there in enumerate(product((False, True), repeat=8)):
        code = f"C{n}"
        listing.append((code, 2024, 99, "Nghị quyết", "/n", "ok", None))
        for k, on in enumerate(there):
            if on:
                title = f"Báo cáo {'Hợp nhất' if k % 2 == 0 else ''} quý {k // 2 + 1}"
                listing.append((code, 2024, k, title, f"/{k}", "ok", None))
        for q in range(1, 5):
            requests.append((f"{n}-{q}", code, 2024, "Quý", q, None))
            found = []
            for back in range(q, 0, -1):
                found = [k for k in (2 * back - 2, 2 * back - 1) if there[k]]
                if found:
                    break
            want[f"{n}-{q}"] = [f"{v.LINK_HOST}/{k}" for k in found]
    df = spark.createDataFrame(listing, LISTING)
    for r in resolve.resolve(asked(spark, requests), df).collect():
        assert [c["link"] for c in r.possible_choices or []] == want[r.request_id]
        assert r.outcome == ("ERROR", "LINK", "CLARIFY")[min(2, len(want[r.request_id]))]


def test_pick(spark):
    rows = [(f"r{i}", "FPT", 2024, "Cả năm", None, None) for i in range(3)]
    resolved = resolve.resolve(asked(spark, rows), listed(spark))
    answers = spark.createDataFrame([("r0", k, a) for k, a in enumerate(["abc", "0", "3", " 2 ", "1"])] + [("r1", 0, "7"), ("zz", 0, "1")], "request_id string, attempt int, raw string")
    got = {r.request_id: r for r in resolve.pick(resolved, answers, "request_id").collect()}
    assert (got["r0"].outcome, got["r0"].report_link, got["r0"].clarification_prompt, got["r0"].possible_choices) == ("LINK", v.LINK_HOST + "/1.pdf", None, None)
    assert [got[r].outcome for r in ("r1", "r2")] == ["CLARIFY"] * 2 and got["r1"].clarification_prompt


def test_results_and_rendering(spark):
    rows = [
        (1, 0, "a", "L", "E", "n0"),
        (1, 1, "b", None, "E", "n1"),
        (1, 2, "a", "", "", None),
        (2, 0, "c", None, None, "x"),
    ]
    df = spark.createDataFrame(rows, "query_id int, pos int, request_id string, report_link string, error_message string, notification string")
    results = df.withColumn("result", respond.result(F.col("report_link"), F.col("error_message")))
    collected = respond.collect(results, ["query_id"], ["pos"])
    lines = {r.query_id: r.lines for r in respond.lines(collected, ["query_id"]).collect()}
    assert lines[1] == f"Yêu cầu a: Thất bại. {v.NEITHER}\nYêu cầu b: Thất bại. LỖI: E"
    notes = {r.query_id: r.note for r in respond.last_note(results, ["query_id"], ["pos"]).collect()}
    assert notes == {1: None, 2: "x"}
    cases = [("c", "n", None), ("c", None, None), ("c", "", "l1"), ("c", "n", "l1")]
    shown = spark.createDataFrame(cases, "c string, n string, l string").select(respond.render(F.col("c"), F.col("n"), F.col("l")).alias("t")).collect()
    assert [r.t for r in shown] == [
        "Mục tiêu: c\n\nTrạng thái:\nn",
        v.APOLOGY,
        "Mục tiêu phân tích: c\n\nKết quả tìm kiếm:\nl1",
        "Mục tiêu phân tích: c\n\nThông báo:\nn\n\nKết quả tìm kiếm:\nl1",
    ]


def test_whole_way(spark):
    queries = spark.createDataFrame(
        [
            (1, "lấy cho tôi báo cáo tài chính hợp nhất quý 2 2024 của FPT"),
            (2, "báo cáo FPT năm 2030"),
            (3, "xin chào"),
            (4, "so sánh FPT quý 2 2024 và 2031"),
            (5, "báo cáo cả năm 2024 của FPT"),
        ],
        "query_id int, query string",
    )
    answers = spark.createDataFrame([(5, "req_1", 0, "2")], "query_id int, request_id string, attempt int, raw string")
    as_of = F.lit("2025-10-10").cast("date")
    got = {r.query_id: r for r in answer(queries, listed(spark), as_of, answers).collect()}
    assert got[1].collected_links == {"req_1": v.LINK_HOST + "/2.pdf"}
    assert got[1].final_response.endswith(f"Yêu cầu req_1: Thành công. Link: {v.LINK_HOST}/2.pdf")
    assert got[2].notification == v.SKIPPED + "- FPT Cả năm/2030" and got[2].final_response.startswith("Mục tiêu: ")
    assert got[3].notification == v.NOTHING_ASKED and got[3].collected_links == {}
    # what was skipped is not told of once a request ran
    assert "bỏ qua" not in got[4].final_response and list(got[4].collected_links) == ["req_1"]
    assert got[5].collected_links == {"req_1": v.LINK_HOST + "/1.pdf"}
    broken = answer(spark.createDataFrame([(9, "{")], "query_id int, intent_json string"), listed(spark), as_of).first()
    assert broken.final_response == v.APOLOGY and broken.error_message.startswith("Lỗi nghiêm trọng")


def test_scans_are_planned_once(spark):
    rows = [("a", "fpt", 2024, "Quý", 1, None), ("b", "FPT", 2024, None, None, None), ("c", "FPT", 2024, "Mới nhất", None, None), ("d", "FPT", 0, "Quý", 1, None)]
    got = {(r.scan_code, r.scan_year): r.requests for r in resolve.scans(asked(spark, rows)).collect()}
    assert got == {("FPT", 2024): 2, ("FPT", None): 2}
    assert len(intent.EXAMPLES) == 5
