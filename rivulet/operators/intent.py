"""From a question to an intent: the seam for a language model, its examples, and a stand-in by rules."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.functions import vocabulary as v

# Examples that show a model what is asked of it: question, (code, year, period, quarter, status)s, aim.
EXAMPLES = (
    ("phân tích bctc của fpt quý 3 năm 2024", (("FPT", 2024, "Quý", 3, None),), "Phân tích báo cáo tài chính Quý 3 2024 của FPT."),
    (
        "so sánh kết quả kinh doanh của VCB và TCB trong quý 1 2024",
        (("VCB", 2024, "Quý", 1, None), ("TCB", 2024, "Quý", 1, None)),
        "So sánh kết quả kinh doanh của VCB và TCB trong Quý 1 2024.",
    ),
    (
        "xem giúp mình con HPG quý 1, quý 2 với quý 3 năm 2025 nó tăng trưởng thế nào",
        (("HPG", 2025, "Quý", 1, None), ("HPG", 2025, "Quý", 2, None), ("HPG", 2025, "Quý", 3, None)),
        "Phân tích sự tăng trưởng của HPG qua Quý 1, 2, và 3 của năm 2025.",
    ),
    (
        "lấy cho tôi báo cáo tài chính hợp nhất quý 2 2024 của FPT",
        (("FPT", 2024, "Quý", 2, "Hợp nhất"),),
        "Phân tích báo cáo tài chính hợp nhất Quý 2 2024 của FPT.",
    ),
    ("tìm báo cáo mới nhất của VNM", (("VNM", None, "Mới nhất", None, None),), "Tìm báo cáo tài chính mới nhất của VNM."),
)

#: Short forms that look like codes; a code is three letters or digits, a letter first.
NOT_CODES = frozenset("BCTC NĂM QUÝ VND USD CON MẸ HỢP XEM TÌM LẤY CHO TÔI CỦA SO SÁNH VÀ VỚI TRONG NÓ MỚI".split())


def intent_json(requests: list[tuple], context: str) -> str:
    names = ("stock_code", "year", "period", "quarter", "consolidation_status")
    return json.dumps({"requests": [dict(zip(names, r, strict=True)) for r in requests], "comparison_context": context}, ensure_ascii=False)


def by_rules(question: str) -> str:
    """A stand-in for a model: codes, years, quarters and words that the question holds, each code with each period.

    Codes are three capitals, or in an all-lower-case question the word of three letters after của, con or mã, or
    those joined to it by và. Without a period the year is meant, as models are told.
    """
    q = re.sub(r"\s+", " ", question.strip())
    codes = [c for c in re.findall(r"\b[A-Z][A-Z0-9]{2}\b", q) if c not in NOT_CODES]
    if not codes:
        codes = [c.upper() for part in re.findall(r"\b(?:của|con|mã)\s+([a-z][a-z0-9]{2}(?:\s*(?:,|và)\s*[a-z][a-z0-9]{2})*)\b", q.lower()) for c in re.findall(r"[a-z0-9]{3}", part)]
    low = q.lower()
    years = [int(y) for y in re.findall(r"\b(?:19|20)\d{2}\b", low)]
    quarters = [int(n) for n in re.findall(r"quý\s*(\d)", low)]
    status = v.CONSOLIDATED if v.CONSOLIDATED.lower() in low else v.PARENT if v.PARENT.lower() in low else None
    if v.LATEST.lower() in low:
        times = [(None, v.LATEST, None)]
    elif quarters:
        times = [(y, v.QUARTER, n) for y in years or [None] for n in quarters]
    else:
        period = v.HALF if v.HALF in low else v.ANNUAL
        times = [(y, period, None) for y in years or [None]]
    return intent_json([(c, y, p, n, status) for c in dict.fromkeys(codes) for y, p, n in times], question)


def parse(queries: DataFrame, model: Callable[[str], str] = by_rules) -> DataFrame:
    """Adds intent_json to query; null where the model fails, and intent_error then says how."""

    @F.pandas_udf("intent_json string, intent_error string")
    def ask(questions: pd.Series) -> pd.DataFrame:
        out = []
        for q in questions:
            try:
                out.append((model(q or ""), None))
            except Exception as e:  # a model may fail in any way; the query's answer says so
                out.append((None, str(e)))
        return pd.DataFrame(out, columns=["intent_json", "intent_error"])

    return queries.withColumn("_asked", ask("query")).select(*queries.columns, "_asked.intent_json", "_asked.intent_error")
