"""A query for each operator over the star-schema tables, and its equivalent in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions import text, tiles
from rivulet.functions import vocabulary as v
from rivulet.operators import gate, pages, resolve, respond
from rivulet.plans.proxies import LISTING_SQL, REQUESTS_SQL, listing, requests, table
from rivulet.sources.pages import ANCHOR, anchors
from rivulet.streaming import poll

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _fill(template: str, **values: str) -> str:
    """text.fill() as SQL."""
    out = _lit(template)
    for name, value in values.items():
        out = f"replace({out}, '{{{name}}}', coalesce(CAST({value} AS VARCHAR), 'None'))"
    return out


_ANCHORS = f"""
A AS (SELECT page_id, regexp_extract_all(html, '{ANCHOR}', 1) AS links, regexp_extract_all(html, '{ANCHOR}', 2) AS titles FROM pages),
P AS (SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, links[i] AS link, trim(titles[i], ' ' || chr(9) || chr(10) || chr(13)) AS title
      FROM A, LATERAL (SELECT unnest(range(1, len(links) + 1)) AS i))"""


@query(f"WITH {_ANCHORS} SELECT * FROM P")
def q01_link_extract(spark, sf_dir):
    return anchors(table(spark, sf_dir, "pages"), "page_id")


@query(f"WITH {_ANCHORS} SELECT page_id, pos, CASE WHEN link <> '' AND NOT starts_with(link, 'http') THEN '{v.LINK_HOST}' || link ELSE link END AS link FROM P")
def q02_link_absolutise(spark, sf_dir):
    return anchors(table(spark, sf_dir, "pages"), "page_id").select("page_id", "pos", text.absolute(F.col("link")).alias("link"))


@query(f"WITH {LISTING_SQL} SELECT o_orderkey, title FROM L")
def q03_title_clean(spark, sf_dir):
    return listing(spark, sf_dir).select("o_orderkey", text.clean_title(F.col("title_raw")).alias("title"))


@query("""
SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'licensed' WHEN contains(lower(text), '|') THEN 'table' WHEN contains(lower(text), '!!') THEN 'loud' ELSE 'prose' END AS kind
FROM documents""")
def q04_title_classify(spark, sf_dir):
    rules = (("license", "licensed"), ("|", "table"), ("!!", "loud"))
    return table(spark, sf_dir, "documents").select("doc_id", text.first_word_of(F.col("text"), rules, "prose").alias("kind"))


@query(f"WITH {LISTING_SQL} SELECT o_orderkey, period, CASE WHEN period = 'Quý' THEN q END AS quarter, status FROM L")
def q04b_title_buckets(spark, sf_dir):
    rows = resolve.classify(listing(spark, sf_dir))
    return rows.select("o_orderkey", "period", "quarter", F.col("consolidation_status").alias("status"))


@query(f"""
WITH {REQUESTS_SQL}
SELECT c_custkey, CAST(0 AS INTEGER) AS pos, request_id, code AS stock_code, y AS year, period, q AS quarter, status AS consolidation_status FROM Q
UNION ALL SELECT c_custkey, CAST(1 AS INTEGER), 'req_2', code, NULL, 'Mới nhất', NULL, NULL FROM Q""")
def q05_intent_decode(spark, sf_dir):
    fields = ("request_id", "stock_code", "year", "period", "quarter", "consolidation_status")
    asked = F.struct(*fields)
    bare = F.struct(F.lit(None).cast("string").alias("request_id"), F.col("stock_code"), F.lit(None).cast("int").alias("year"), F.lit(v.LATEST).alias("period"), F.lit(None).cast("int").alias("quarter"), F.lit(None).cast("string").alias("consolidation_status"))
    intents = requests(spark, sf_dir).select("c_custkey", gate.encode(F.array(asked, bare), F.lit("aim")).alias("intent_json"))
    return gate.explode(gate.decode(intents), "c_custkey").select("c_custkey", "pos", *fields)


def _filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each order, with quarters from 0 to 5 and missing."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        k.alias("pos"),
        F.col("o_custkey").cast("string").alias("stock_code"),
        F.when(k % 11 != 0, F.year("o_orderdate")).alias("year"),
        F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, v.HALF).when(k % 5 == 2, v.ANNUAL).when(k % 7 == 3, v.LATEST).otherwise(v.QUARTER).alias("period"),
        F.when(k % 13 != 0, (k % 6).cast("int")).alias("quarter"),
    )


_FILED = """
B AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(year(o_orderdate) AS INTEGER) END AS y,
             CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN '6 tháng' WHEN o_orderkey % 5 = 2 THEN 'Cả năm' WHEN o_orderkey % 7 = 3 THEN 'Mới nhất' ELSE 'Quý' END AS period,
             CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey % 6 AS INTEGER) END AS q FROM orders),
M AS (SELECT *, CAST(CASE WHEN period = 'Quý' AND coalesce(q, 0) <> 0 THEN q * 3 WHEN period = '6 tháng' THEN 6 ELSE 12 END AS INTEGER) AS m FROM B),
G AS (SELECT *, y IS NULL OR NOT (y > 1999 OR y = 1999 AND m >= 6) AS kept FROM M)"""
_AS_OF = "1999-06-15"


@query(f"WITH {_FILED} SELECT o_orderkey, m AS end_month FROM M")
def q06_end_month(spark, sf_dir):
    return _filed(spark, sf_dir).select("o_orderkey", gate.end_month(F.col("period"), F.col("quarter")).cast("int").alias("end_month"))


@query(f"WITH {_FILED} SELECT o_orderkey, kept FROM G")
def q07_future_gate(spark, sf_dir):
    return gate.gate(_filed(spark, sf_dir), F.lit(_AS_OF).cast("date")).select("o_orderkey", "kept")


@query(f"""
WITH {_FILED}
SELECT o_custkey, {_lit(v.SKIPPED)} || string_agg('- ' || o_custkey || ' ' || coalesce(period, 'None') || CASE WHEN period = 'Quý' THEN ' ' || coalesce(CAST(q AS VARCHAR), 'None') ELSE '' END || '/' || y, chr(10) ORDER BY o_orderkey) AS note
FROM G WHERE NOT kept GROUP BY o_custkey""")
def q08_skip_messages(spark, sf_dir):
    return gate.skip_notes(gate.gate(_filed(spark, sf_dir), F.lit(_AS_OF).cast("date")), "o_custkey")


@query(f"""
WITH {LISTING_SQL}, {REQUESTS_SQL},
H AS (SELECT Q.request_id, arg_min(L.title, L.pos) AS title, arg_min(L.link, L.pos) AS link
      FROM Q JOIN L ON L.code = Q.code AND (Q.status IS NULL OR contains(lower(L.title), lower(Q.status))) GROUP BY 1),
N AS (SELECT DISTINCT code FROM L)
SELECT Q.request_id, H.link AS report_link,
       CASE WHEN H.link IS NULL THEN NULL WHEN Q.status IS NOT NULL THEN {_fill(v.LATEST_OF_STATUS, title="H.title")} ELSE {_fill(v.LATEST_OF_ALL, title="H.title")} END AS notification,
       CASE WHEN N.code IS NULL THEN {_fill(v.EMPTY_LISTING, code="Q.code", year="Q.y")} WHEN H.link IS NULL THEN {_fill(v.NO_LATEST_OF_STATUS, status="Q.status", code="Q.code")} END AS error_message
FROM Q LEFT JOIN H USING (request_id) LEFT JOIN N ON N.code = Q.code""")
def q09_latest(spark, sf_dir):
    return resolve.resolve(requests(spark, sf_dir, latest=True), listing(spark, sf_dir)).select("request_id", "report_link", "notification", "error_message")


_FIRSTS = """
F AS (SELECT * FROM L WHERE period IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY code, y, period, CASE WHEN period = 'Quý' THEN q END, status ORDER BY pos) = 1)"""


@query(f"WITH {LISTING_SQL}, {_FIRSTS} SELECT code AS stock_code, y AS listing_year, period, CASE WHEN period = 'Quý' THEN q END AS quarter, status AS consolidation_status, title, link FROM F")
def q10_buckets_first(spark, sf_dir):
    sums = resolve.summary(resolve.classify(listing(spark, sf_dir))).where("scan_year IS NOT NULL")
    found = [(f"quarter{q}{s}", v.QUARTER, F.lit(q)) for q in resolve.QUARTERS for s in (0, 1)]
    found += [(f"{name}{s}", period, F.lit(None)) for name, period in (("half", v.HALF), ("annual", v.ANNUAL)) for s in (0, 1)]
    each = F.array(*(F.struct(F.lit(p).alias("period"), q.cast("int").alias("quarter"), F.lit(v.STATUSES[int(n[-1])]).alias("consolidation_status"), F.col(n).alias("row")) for n, p, q in found))
    rows = sums.select("scan_code", "scan_year", F.explode(F.filter(each, lambda x: x["row"].isNotNull())).alias("b"))
    return rows.select(F.col("scan_code").alias("stock_code"), F.col("scan_year").alias("listing_year"), "b.period", "b.quarter", "b.consolidation_status", "b.row.title", "b.row.link")


_RESOLVED = f"""
{LISTING_SQL}, {REQUESTS_SQL}, {_FIRSTS},
N AS (SELECT code, y, count(*) AS rows FROM L GROUP BY ALL),
X AS (SELECT Q.*, coalesce(N.rows, 0) AS rows, Q.period IS NOT NULL AND Q.status IS NOT NULL AS exact FROM Q LEFT JOIN N ON N.code = Q.code AND N.y = Q.y),
W AS (SELECT X.request_id, max(F.q) AS near FROM X JOIN F ON F.code = X.code AND F.y = X.y AND F.period = 'Quý' AND F.q <= X.q WHERE X.period = 'Quý' AND NOT X.exact GROUP BY 1),
C AS (
  SELECT X.request_id, F.title, F.link, F.period, CASE WHEN F.period = 'Quý' THEN F.q END AS quarter, F.status,
         CAST(row_number() OVER (PARTITION BY X.request_id ORDER BY CASE F.status WHEN 'Hợp nhất' THEN 0 ELSE 1 END, CASE F.period WHEN '6 tháng' THEN 0 ELSE 1 END) AS INTEGER) AS i
  FROM X LEFT JOIN W USING (request_id) JOIN F ON F.code = X.code AND F.y = X.y
    AND (X.period = 'Quý' AND F.period = 'Quý' AND F.q = W.near OR X.period IS DISTINCT FROM 'Quý' AND F.period <> 'Quý' AND coalesce(X.period, F.period) = F.period)
  WHERE NOT X.exact),
A AS (SELECT request_id, count(*) AS n, min(link) AS link, min(title) AS title, string_agg(i || '. ' || title || chr(10), '' ORDER BY i) AS lines FROM C GROUP BY 1),
E AS (SELECT X.request_id, F.title, F.link FROM X JOIN F ON F.code = X.code AND F.y = X.y AND F.period = X.period AND F.status = X.status AND (X.period <> 'Quý' OR F.q = X.q) WHERE X.exact),
R AS (
  SELECT X.*, E.title AS exact_title, E.link AS exact_link, coalesce(A.n, 0) AS n, A.link AS only_link, A.title AS only_title, A.lines, W.near,
         X.period IS NOT DISTINCT FROM 'Quý' AND NOT X.exact AND W.near IS DISTINCT FROM X.q AS late
  FROM X LEFT JOIN E USING (request_id) LEFT JOIN A USING (request_id) LEFT JOIN W USING (request_id)),
O AS (
  SELECT *,
    CASE WHEN rows = 0 THEN {_fill(v.EMPTY_LISTING, code="code", year="y")}
         WHEN exact AND exact_link IS NULL THEN {_fill(v.NO_EXACT, asked="CASE WHEN period = 'Quý' THEN 'Quý Quý ' || q ELSE period END", status="status")}
         WHEN NOT exact AND n = 0 AND late THEN {_fill(v.NO_QUARTER, quarter="q", year="y")}
         WHEN NOT exact AND n = 0 THEN {_fill(v.NO_CHOICE, year="y")} END AS error_message,
    CASE WHEN exact THEN exact_link WHEN n = 1 THEN only_link END AS report_link,
    CASE WHEN exact AND exact_link IS NOT NULL THEN {_fill(v.EXACT, title="exact_title")}
         WHEN n = 1 THEN CASE WHEN late THEN {_fill(v.QUARTER_MISSING, quarter="q")} ELSE '' END || {_fill(v.ONLY_CHOICE, title="only_title")} END AS notification,
    CASE WHEN n > 1 THEN CASE WHEN late THEN {_fill(v.EARLIER_CHOICES, quarter="q", year="y")} ELSE {_fill(v.CHOICES, code="upper(code)", year="y")} END || lines || {_lit(v.WHICH)} END AS prompt
  FROM R)"""


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve(requests(spark, sf_dir), listing(spark, sf_dir))


@query(f"WITH {_RESOLVED} SELECT request_id, report_link, notification, error_message FROM O WHERE exact")
def q11_exact_lookup(spark, sf_dir):
    exact = _resolved(spark, sf_dir).where("period IS NOT NULL AND consolidation_status IS NOT NULL")
    return exact.select("request_id", "report_link", "notification", "error_message")


@query(f"WITH {_RESOLVED} SELECT O.request_id, O.q AS asked_quarter, C.quarter AS found_quarter, C.status AS consolidation_status, C.title, C.link, O.late FROM O JOIN C USING (request_id) WHERE O.period = 'Quý'")
def q12_asof_fallback(spark, sf_dir):
    asked = _resolved(spark, sf_dir).where((F.col("period") == v.QUARTER) & F.col("consolidation_status").isNull())
    rows = asked.select("request_id", F.col("quarter").alias("asked_quarter"), F.explode("possible_choices").alias("c"))
    late = (F.col("c.quarter") < F.col("asked_quarter")).alias("late")
    return rows.select("request_id", "asked_quarter", F.col("c.quarter").alias("found_quarter"), "c.consolidation_status", "c.title", "c.link", late)


@query(f"WITH {_RESOLVED} SELECT O.request_id, C.i, C.period, C.status AS consolidation_status, C.title, C.link FROM O JOIN C USING (request_id) WHERE O.period IS DISTINCT FROM 'Quý'")
def q13_alternatives(spark, sf_dir):
    other = _resolved(spark, sf_dir).where(~F.col("period").eqNullSafe(v.QUARTER))
    rows = other.select("request_id", F.posexplode("possible_choices").alias("i", "c"))
    return rows.select("request_id", (F.col("i") + 1).alias("i"), "c.period", "c.consolidation_status", "c.title", "c.link")


@query(f"WITH {_RESOLVED} SELECT request_id, CASE WHEN error_message IS NOT NULL THEN 'ERROR' WHEN n > 1 THEN 'CLARIFY' ELSE 'LINK' END AS outcome, report_link, notification, error_message FROM O")
def q14_outcome(spark, sf_dir):
    return _resolved(spark, sf_dir).select("request_id", "outcome", "report_link", "notification", "error_message")


@query(f"WITH {_RESOLVED} SELECT request_id, prompt AS clarification_prompt FROM O WHERE n > 1")
def q15_prompt(spark, sf_dir):
    return _resolved(spark, sf_dir).where("outcome = 'CLARIFY'").select("request_id", "clarification_prompt")




@query(f"""
WITH {_RESOLVED}
SELECT O.request_id, CASE WHEN C.link IS NOT NULL OR n = 1 OR exact_link IS NOT NULL THEN 'LINK' WHEN n > 1 THEN 'CLARIFY' ELSE 'ERROR' END AS outcome, coalesce(C.link, report_link) AS report_link
FROM O LEFT JOIN C ON C.request_id = O.request_id AND O.n > 1 AND C.i = 1 + O.c_custkey % 3""")
def q16_user_pick(spark, sf_dir):
    third = (F.col("c_custkey") % 3 + 1).cast("string")
    tried = F.array(*(F.struct(F.lit(k).alias("attempt"), raw.alias("raw")) for k, raw in enumerate((F.lit("abc"), F.lit("0"), third), 1)))
    answers = requests(spark, sf_dir).select("request_id", F.explode(tried).alias("t")).select("request_id", "t.attempt", "t.raw")
    return resolve.pick(_resolved(spark, sf_dir), answers, "request_id").select("request_id", "outcome", "report_link")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as results: users are requests, and each thousand users a query."""
    kind = F.col("event_type")
    link = F.when(kind.isin("purchase", "view"), F.concat(F.lit("/e/"), F.col("event_id").cast("string"))).when(kind == "signup", "")
    error = F.when(kind == "error", F.col("props")).when(kind == "signup", "")
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 50).alias("query_id"),
        F.concat(F.lit("req_"), F.col("user_id").cast("string")).alias("request_id"),
        "ts",
        "event_id",
        F.when(kind != "click", F.concat(F.lit("note "), F.col("event_id").cast("string"))).alias("notification"),
        respond.result(link, error).alias("result"),
    )


_RESULTS = f"""
V AS (SELECT user_id % 50 AS query_id, 'req_' || user_id AS request_id, ts, event_id, CASE WHEN event_type <> 'click' THEN 'note ' || event_id END AS notification,
             CASE WHEN event_type IN ('purchase', 'view') THEN '/e/' || event_id WHEN event_type = 'error' AND props <> '' THEN 'LỖI: ' || props ELSE {_lit(v.NEITHER)} END AS result,
             row_number() OVER (ORDER BY ts, event_id) AS k FROM events),
K AS (SELECT query_id, request_id, arg_max(result, k) AS result, min(k) AS first, arg_min(event_id, k) AS first_event FROM V GROUP BY ALL),
T AS (SELECT query_id, arg_max_null(notification, k) AS note FROM V GROUP BY 1)"""


@query(f"WITH {_RESULTS} SELECT query_id, request_id, result, first_event FROM K")
def q17_collect_coalesce(spark, sf_dir):
    rows = respond.collect(_results(spark, sf_dir), ["query_id"], ["ts", "event_id"])
    return rows.select("query_id", "request_id", "result", F.col("first.event_id").alias("first_event"))


@query(f"WITH {_RESULTS} SELECT query_id, note FROM T")
def q18_last_notification(spark, sf_dir):
    return respond.last_note(_results(spark, sf_dir), ["query_id"], ["ts", "event_id"])


@query(f"""
WITH {_RESULTS},
S AS (SELECT query_id, string_agg('Yêu cầu ' || request_id || CASE WHEN contains(result, 'LỖI') THEN ': Thất bại. ' ELSE ': Thành công. Link: ' END || result, chr(10) ORDER BY first) AS lines FROM K GROUP BY 1)
SELECT query_id, {_fill(v.AIM, context="'aim ' || query_id")} || CASE WHEN note IS NOT NULL THEN chr(10) || {_fill(v.NOTE, note="note")} ELSE '' END || chr(10) || {_lit(v.RESULTS)} || chr(10) || lines AS final_response
FROM S JOIN T USING (query_id)""")
def q19_final_response(spark, sf_dir):
    results = _results(spark, sf_dir)
    lines = respond.lines(respond.collect(results, ["query_id"], ["ts", "event_id"]), ["query_id"])
    notes = respond.last_note(results, ["query_id"], ["ts", "event_id"])
    aim = F.concat(F.lit("aim "), F.col("query_id").cast("string"))
    return lines.join(notes, "query_id").select("query_id", respond.render(aim, F.col("note"), F.col("lines")).alias("final_response"))


@query("""
WITH V AS (SELECT user_id, props, CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'failed' ELSE 'processing' END AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events),
E AS (SELECT user_id, min(attempt) AS attempt FROM V WHERE status <> 'processing' AND attempt <= 350 GROUP BY 1)
SELECT U.user_id, V.status, coalesce(E.attempt, U.seen) AS attempts, V.props AS payload
FROM (SELECT user_id, count(*) FILTER (attempt <= 350) AS seen FROM V GROUP BY 1) U LEFT JOIN E USING (user_id) LEFT JOIN V ON V.user_id = E.user_id AND V.attempt = E.attempt""")
def q20_poll_terminal(spark, sf_dir):
    from pyspark.sql.window import Window

    status = F.when(F.col("event_type") == "purchase", poll.DONE).when(F.col("event_type") == "error", poll.FAILED).otherwise("processing")
    attempt = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    replies = table(spark, sf_dir, "events").select("user_id", attempt.alias("attempt"), status.alias("status"), F.col("props").alias("payload"))
    return poll.outcomes(replies, "user_id")


_GRID = "SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(i * j AS INTEGER) AS blocks FROM range(1, {m} + 1) a(i), range(1, {m} + 1) b(j) WHERE i * j <= {m}"


@query(" UNION ALL ".join(f"SELECT {m} AS max_num, i, j, blocks, CAST(448 * i AS INTEGER) AS width, CAST(448 * j AS INTEGER) AS height FROM ({_GRID.format(m=m)})" for m in (6, 12)))
def q21_tile_grid(spark, sf_dir):
    both = [tiles.grid(spark, 1, m).select(F.lit(m).alias("max_num"), "*") for m in (6, 12)]
    return both[0].union(both[1])


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A size for each part: from square to long, small to large."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", (60 * (1 + k % 31)).cast("int").alias("w"), (60 * (1 + k % 29)).cast("int").alias("h"))


_CLOSEST = f"""
I AS (SELECT p_partkey, CAST(60 * (1 + p_partkey % 31) AS INTEGER) AS w, CAST(60 * (1 + p_partkey % 29) AS INTEGER) AS h FROM part),
D AS (SELECT I.*, G.*, abs(CAST(w AS DOUBLE) / h - CAST(i AS DOUBLE) / j) AS away FROM I, ({_GRID.format(m=12)}) G),
Z AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY blocks, i, j) AS o, CAST(w AS DOUBLE) * h > 0.5 * 448 * 448 * blocks AS filled
      FROM D QUALIFY away = min(away) OVER (PARTITION BY p_partkey)),
B AS (SELECT p_partkey, w, h, coalesce(arg_max(i, o) FILTER (filled), arg_min(i, o)) AS i, coalesce(arg_max(j, o) FILTER (filled), arg_min(j, o)) AS j FROM Z GROUP BY ALL)"""


@query(f"WITH {_CLOSEST} SELECT p_partkey, i, j FROM B")
def q22_closest_ratio(spark, sf_dir):
    return _images(spark, sf_dir).withColumn("c", tiles.closest(F.col("w"), F.col("h"))).select("p_partkey", "c.i", "c.j")


@query(f"""
WITH {_CLOSEST}, U AS (SELECT p_partkey, i, j, unnest(range(0, i * j)) AS k FROM B)
SELECT p_partkey, CAST(k AS INTEGER) AS k, CAST(k % i * 448 AS INTEGER) AS "left", CAST(k // i * 448 AS INTEGER) AS top, CAST(k % i * 448 + 448 AS INTEGER) AS "right", CAST(k // i * 448 + 448 AS INTEGER) AS bottom, FALSE AS whole FROM U
UNION ALL SELECT p_partkey, CAST(i * j AS INTEGER), 0, 0, 448, 448, TRUE FROM B WHERE i * j > 1""")
def q23_tile_boxes(spark, sf_dir):
    cell = _images(spark, sf_dir).select("p_partkey", tiles.closest(F.col("w"), F.col("h")).alias("c"))
    return cell.select("p_partkey", F.posexplode(tiles.boxes(F.col("c"))).alias("k", "b")).select("p_partkey", "k", "b.*")


@query("""
SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS markdown, CAST(count(*) AS BIGINT) AS n_pages, CAST(count(*) AS INTEGER) AS n_split, trim(arg_min(text, turn), chr(10)) AS first_page
FROM conversations GROUP BY conv_id""")
def q24_page_concat_split(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    plain = pages.assemble(turns, ["conv_id"], "turn", "text")
    marked = pages.assemble(turns, ["conv_id"], "turn", "text", paginate=True).select("conv_id", pages.split(F.col("markdown")).alias("p"))
    return plain.join(marked, "conv_id").select("conv_id", "markdown", "n_pages", F.size("p").alias("n_split"), F.element_at("p", 1).alias("first_page"))


@query("""
WITH S AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
E AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS n FROM S),
K AS (SELECT * FROM E QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY n) = 1)
SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS text FROM K GROUP BY 1""")
def q25_drop_repeated_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", pages.drop_repeated_lines(F.col("text")).alias("text"))


@query(f"""
WITH {REQUESTS_SQL}, A AS (SELECT code, y FROM Q UNION ALL SELECT code, NULL FROM Q WHERE c_custkey % 2 = 0 UNION ALL SELECT code, y FROM Q WHERE c_custkey % 3 = 0)
SELECT code AS scan_code, y AS scan_year, count(*) AS requests FROM A GROUP BY ALL""")
def q26_request_plan(spark, sf_dir):
    asked = requests(spark, sf_dir)
    newest = requests(spark, sf_dir, latest=True).where("c_custkey % 2 = 0")
    return resolve.scans(asked.union(newest).union(asked.where("c_custkey % 3 = 0")))


@query(f"""
WITH {_RESOLVED},
P AS (SELECT code, request_id, CASE WHEN report_link IS NOT NULL THEN report_link WHEN error_message IS NOT NULL THEN 'LỖI: ' || error_message ELSE {_lit(v.NEITHER)} END AS result, notification, c_custkey FROM O)
SELECT c_custkey AS query_id,
       {_fill(v.AIM, context="'aim ' || c_custkey")} || CASE WHEN notification IS NOT NULL THEN chr(10) || {_fill(v.NOTE, note="notification")} ELSE '' END || chr(10) || {_lit(v.RESULTS)} || chr(10) ||
       'Yêu cầu ' || request_id || CASE WHEN contains(result, 'LỖI') THEN ': Thất bại. ' ELSE ': Thành công. Link: ' END || result AS final_response
FROM P""")
def q27_answer(spark, sf_dir):
    from rivulet.plans.answer import answer

    one = F.array(F.struct("request_id", "stock_code", "year", "period", "quarter", "consolidation_status"))
    aim = F.concat(F.lit("aim "), F.col("c_custkey").cast("string"))
    queries = requests(spark, sf_dir).select(F.col("c_custkey").alias("query_id"), gate.encode(one, aim).alias("intent_json"))
    return answer(queries, listing(spark, sf_dir), F.lit("2030-01-01").cast("date")).select("query_id", "final_response")


@query(f"WITH {_RESOLVED} SELECT request_id, CASE WHEN error_message IS NOT NULL THEN 'ERROR' WHEN n > 1 THEN 'CLARIFY' ELSE 'LINK' END AS outcome, report_link FROM O")
def q28_mixed_case(spark, sf_dir):
    """Codes in either case, in listings and requests: each request is answered once."""
    filed, asked = listing(spark, sf_dir), requests(spark, sf_dir)
    case = F.when(F.col("o_orderkey") % 2 == 0, "ab").otherwise("AB")
    filed = filed.withColumn("stock_code", F.concat(case, "stock_code"))
    asked = asked.withColumn("stock_code", F.concat(F.lit("aB"), "stock_code"))
    return resolve.resolve(asked, filed).select("request_id", "outcome", "report_link")


@query(f"""
WITH {_RESOLVED}
SELECT request_id, CASE WHEN c_custkey % 5 < 2 THEN NULL ELSE report_link END AS report_link,
       CASE c_custkey % 5 WHEN 0 THEN {_fill(v.UNKNOWN_CODE, code="code")} WHEN 1 THEN {_fill(v.BROKEN_LISTING, detail="'down ' || code")} ELSE error_message END AS error_message
FROM O""")
def q29_failed_scans(spark, sf_dir):
    """Two of five codes have a listing that could not be read, by a time-out or another fault."""
    asked = requests(spark, sf_dir)
    none = F.lit(None).cast("string")
    read = listing(spark, sf_dir).select("stock_code", "listing_year", "pos", "title_raw", "link_raw", F.lit("ok").alias("status"), none.alias("detail"))
    late = F.col("c_custkey") % 5 == 0
    detail = F.when(~late, F.concat(F.lit("down "), "stock_code"))
    failed = asked.where("c_custkey % 5 < 2").select(
        "stock_code", F.col("year").alias("listing_year"), F.lit(None).cast("int").alias("pos"), none.alias("title_raw"), none.alias("link_raw"), F.when(late, "timeout").otherwise("error").alias("status"), detail.alias("detail")
    )
    return resolve.resolve(asked, read.union(failed)).select("request_id", "report_link", "error_message")


_FIFTH = _RESOLVED.replace("CAST(1 + c_custkey % 4 AS INTEGER) AS q", "CAST(5 AS INTEGER) AS q")


@query(f"WITH {_FIFTH} SELECT request_id, CASE WHEN error_message IS NOT NULL THEN 'ERROR' WHEN n > 1 THEN 'CLARIFY' ELSE 'LINK' END AS outcome, report_link, error_message FROM O")
def q30_no_such_quarter(spark, sf_dir):
    """A fifth quarter: an error where it is looked up, else the nearest earlier one."""
    asked = requests(spark, sf_dir).withColumn("quarter", F.lit(5))
    return resolve.resolve(asked, listing(spark, sf_dir)).select("request_id", "outcome", "report_link", "error_message")


_NO_CONTEXT = '{"requests":[],"comparison_context":null}'


@query(f"""
WITH S AS (SELECT c_custkey AS query_id, c_custkey % 4 AS k, 'aim ' || c_custkey AS aim, {_lit(v.SKIPPED)} || '- ' || c_custkey || ' Cả năm/2031' AS skipped FROM customer),
N AS (SELECT *, CASE k WHEN 1 THEN {_lit(v.NOTHING_ASKED)} WHEN 2 THEN skipped END AS notification FROM S)
SELECT query_id, notification, CASE WHEN notification IS NULL THEN {_lit(v.APOLOGY)} ELSE {_fill(v.STATE_ONLY, context="aim", note="notification")} END AS final_response,
       CASE k WHEN 0 THEN {_fill(v.BROKEN_QUERY, detail="'{'")} WHEN 3 THEN {_fill(v.BROKEN_QUERY, detail=_lit(_NO_CONTEXT))} END AS error_message
FROM N""")
def q31_nothing_collected(spark, sf_dir):
    """Intents that cannot be read, that ask for nothing, or only for what is not out yet."""
    from rivulet.plans.answer import answer

    k, none = F.col("c_custkey"), F.lit(None)
    late = F.struct(F.lit("req_1").alias("request_id"), k.cast("string").alias("stock_code"), F.lit(2031).alias("year"), F.lit(v.ANNUAL).alias("period"), none.cast("int").alias("quarter"), none.cast("string").alias("consolidation_status"))
    aim = F.concat(F.lit("aim "), k.cast("string"))
    one = gate.encode(F.filter(F.array(late), lambda _: k % 4 == 2), aim)
    queries = table(spark, sf_dir, "customer").select(k.alias("query_id"), F.when(k % 4 == 0, "{").when(k % 4 == 3, _NO_CONTEXT).otherwise(one).alias("intent_json"))
    return answer(queries, listing(spark, sf_dir), F.lit("2030-01-01").cast("date")).select("query_id", "notification", "final_response", "error_message")


@query(f"""
SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN 'first' END AS current, CAST(CASE WHEN c_custkey % 3 = 2 THEN 1 ELSE 0 END AS INTEGER) AS n_left,
       CASE WHEN c_custkey % 3 = 0 THEN {_lit(v.NO_PENDING)} END AS error_message FROM customer""")
def q32_take_next(spark, sf_dir):
    pending = F.slice(F.array(F.lit("first"), F.lit("second")), F.lit(1), (F.col("c_custkey") % 3).cast("int"))
    state = gate.take_next(table(spark, sf_dir, "customer").select("c_custkey", pending.alias("pending")))
    return state.select("c_custkey", "current", F.size("pending").alias("n_left"), "error_message")


@query(f"""
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 < 2 THEN 'LINK' ELSE 'ERROR' END AS outcome, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 < 2 THEN 'l' END AS report_link,
       CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 < 2 THEN NULL ELSE {_lit(v.NO_PROMPT)} END AS error_message FROM customer""")
def q33_prompt_guard(spark, sf_dir):
    """Open choices without a prompt or choices are errors, whatever is answered."""
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    choices = F.when(k % 3 < 2, F.array(F.struct(F.lit("t").alias("title"), F.lit("l").alias("link"))))
    open_ = table(spark, sf_dir, "customer").select("c_custkey", F.lit("CLARIFY").alias("outcome"), none.alias("report_link"), none.alias("error_message"), F.when(k % 2 == 0, "p").alias("clarification_prompt"), choices.alias("possible_choices"))
    answers = open_.select("c_custkey", F.lit(1).alias("attempt"), F.lit("1").alias("raw"))
    return resolve.pick(open_, answers, "c_custkey").select("c_custkey", "outcome", "report_link", "error_message")
