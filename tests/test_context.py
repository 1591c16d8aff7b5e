import json

from marginalia.operators import context as c
from marginalia.operators import stats, steps
from marginalia.plans.research import research_contexts

PAGE = "query_id int, position int, title string, url string, content string, fetch_success boolean, error string"
RESULT = "query_id int, rank int, title string, snippet string, url string"
HIT = "query_id int, rank int, content string, source string"


def test_context(spark):
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    results = spark.createDataFrame(
        [(1, 1, "Tide tables", "...", "https://tides.example/t"), (1, 2, None, None, None)] + [(1, n, "T", "S", "u") for n in range(3, 9)],
        RESULT,
    )
    pages = spark.createDataFrame(
        [
            (1, 4, "B", "https://b", "x" * 1501, None, None),
            (1, 3, None, "https://a", None, False, None),
            (2, 0, "C", "https://c", "short", True, None),
        ],
        PAGE,
    )
    hits = spark.createDataFrame([(2, n, f"d{n}", None if n == 1 else "s") for n in range(1, 8)], HIT)
    rows = {r.query_id: r for r in c.build_context(queries, results, pages, hits).collect()}
    assert rows[1].web_context == (
        "- Tide tables: ... (Source: https://tides.example/t)\n\n- No title: No snippet (Source: )\n\n"
        + "- T: S (Source: u)\n\n" * 3
        + "[FAILED SOURCE] Error (URL: https://a)\nError: Unknown error\n"
        "WARNING: This source could not be accessed and should not be cited or used as a reference.\n\n"
        + "Webpage: B (Source: https://b)\nContent: " + "x" * 1500 + "...\n\n"
    )
    assert rows[1].doc_context == "No document results available." and rows[1].failures == 1
    assert rows[2].web_context == "Webpage: C (Source: https://c)\nContent: short\n\n"
    assert rows[2].doc_context == "- d1 (Source: Unknown)\n\n" + "".join(f"- d{n} (Source: s)\n\n" for n in range(2, 6))
    assert rows[3].web_context == "No web results available." and rows[3].failures == 0


def test_one_row_per_query(spark):
    """However many pages there are, and wherever they stand."""
    queries = spark.createDataFrame([(1,), (1,), (2,)], "query_id int")
    pages = spark.createDataFrame([(1, n, f"p{n}", "u", "c", n % 2 == 0, None) for n in range(225)] + [(2, 250, "far", "u", "c", True, None)], PAGE)
    rows = c.build_context(queries, spark.createDataFrame([], RESULT), pages, spark.createDataFrame([], HIT)).collect()
    found = {r.query_id: r for r in rows}
    assert len(rows) == 2 and found[1].failures == 112
    assert found[1].web_context == "".join(r.text for r in c.format_page_context(pages.filter("query_id = 1")).orderBy("position").collect())
    assert found[2].web_context == "Webpage: far (Source: u)\nContent: c\n\n"


def test_count_failures(spark):
    df = spark.createDataFrame([(1, True), (1, False), (1, None), (2, True)], "query_id int, success boolean")
    assert {r.query_id: r.failures for r in c.count_failures(df).collect()} == {1: 1, 2: 0}


def test_research_contexts(spark):
    html = "<title>{0}</title><p>{0} text"
    pages = spark.createDataFrame(
        [(1, "https://a.ok.org/1", html.format("moon")), (2, "https://bad.org/2", html.format("moon rock")), (3, "https://ok.org/3", html.format("sun"))],
        "page_id int, url string, html string",
    )
    queries = spark.createDataFrame([(1, "moon"), (2, "nothing")], "query_id int, text string")
    hits = spark.createDataFrame([(2, 1, "doc", "s")], HIT)
    rows = {r.query_id: r for r in research_contexts(queries, pages, hits, ["ok.org"]).collect()}
    assert "Webpage: moon (Source: https://a.ok.org/1)\nContent: moon\n\nmoon text" in rows[1].web_context
    assert "[FAILED SOURCE] Access Error (URL: https://bad.org/2)\nError: Domain not allowed" in rows[1].web_context
    assert rows[1].failures == 1
    assert (rows[2].web_context, rows[2].doc_context) == ("No web results available.", "- doc (Source: s)\n\n")


STEPS = "plan_id int, step_no int, action string, parameters map<string,string>, reasoning string"


def test_valid_steps(spark):
    good = [
        ("search_web", {"query": "height of the tide"}),
        ("fetch_webpage", {"url": "https://tides.example/t"}),
        ("search_documents", {"query": "tide gauges"}),
        ("generate_summary", {}),
        ("ask_user", {}),
        ("extract_text", {"url": "u", "selector": "p"}),
    ]
    bad = [("", {}), ("fly", {}), ("search_web", {}), ("extract_text", {"url": "u"}), ("get_document_summary", {"url": "x"}), (None, None)]
    df = spark.createDataFrame([(1, n, a, p, "") for n, (a, p) in enumerate(good + bad)], STEPS)
    rows = steps.validate_steps(df).orderBy("step_no").collect()
    assert [r.valid for r in rows] == [True] * 6 + [False] * 6
    assert [r.reason for r in rows[6:]] == [
        "empty action",
        "unknown action 'fly'",
        "search_web requires 'query'",
        "extract_text requires 'url' and 'selector'",
        "get_document_summary requires 'file_path'",
        "empty action",
    ]


def test_coerce_steps(spark):
    raw = [
        {"action": "search_web", "parameters": "x", "reasoning": "r"},
        {"action": "fetch_webpage", "parameters": "x"},
        {"action": "fetch_webpage", "parameters": {"url": "u", "n": 5}},
        {"action": "ask_user"},
        {"parameters": {}},
        [1],
        "text",
        {"action": "ask_user", "reasoning": None},
        {"action": 3},
    ]
    df = spark.createDataFrame([(n, json.dumps(s)) for n, s in enumerate(raw)] + [(99, "no json")], "n int, step string")
    rows = {r.n: (r.action, r.parameters, r.reasoning) for r in steps.coerce_steps(df).collect()}
    assert rows == {
        0: ("search_web", {"query": "x"}, "r"),
        1: ("fetch_webpage", {}, ""),
        2: ("fetch_webpage", {"url": "u", "n": "5"}, ""),
        3: ("ask_user", {}, ""),
    }


def test_reply_steps(spark):
    replies = [
        (1, '```json\n{"steps": [{"action": "search_web", "parameters": "q"}, 7, {"action": "ask_user", "action": "generate_summary"},]}\n```'),
        (2, '[{"action": "ask_user"}]'), (3, '{"steps": {"action": "ask_user"}}'), (4, "no plan"), (5, None), (6, '{"steps": []}'),
    ]
    found = steps.reply_steps(spark.createDataFrame(replies, "plan_id int, reply string"))
    rows = [(r.plan_id, r.step_no, r.action, r.parameters) for r in found.orderBy("step_no").collect()]
    assert rows == [(1, 0, "search_web", {"query": "q"}), (1, 2, "generate_summary", {})]
    (plan,) = steps.collect_plans(found.repartition(3, "step_no")).collect()
    assert plan.plan_id == 1 and [s.action for s in plan.steps] == ["search_web", "generate_summary"]
    assert steps.refine_plans(steps.collect_plans(found)).first().steps == plan.steps


def test_refine_plans(spark):
    kind = f"plan_id int, steps array<{steps.STEP}>"
    plans = [(1, [("fly", {}, ""), ("search_web", {"query": "q"}, "why")]), (2, [("fly", {}, "")]), (3, [])]
    rows = {r.plan_id: r.steps for r in steps.refine_plans(spark.createDataFrame(plans, kind)).collect()}
    assert [s.action for s in rows[1]] == ["search_web"]
    for n in (2, 3):
        assert [(s.action, s.parameters) for s in rows[n]] == [("generate_summary", {})]
        assert rows[n][0].reasoning == steps.FALLBACK_REASON


def test_timing_stats(spark):
    runs = spark.createDataFrame([("a", 1.0, True, 4), ("a", 3.0, False, None), ("b", 2.0, True, 1)], "k string, seconds double, ok boolean, steps int")
    rows = {r.k: r for r in stats.timing_stats(runs, ["k"], ok="ok", steps="steps").collect()}
    assert rows["a"][1:] == (2.0, 1.0, 3.0, 2, 1, 4.0)
    assert stats.timing_stats(runs.limit(0), []).first()[:5] == (0.0, 0.0, 0.0, 0, 0)


def test_parse_agent_log(spark, tmp_path):
    (tmp_path / "agent.log").write_text(
        "2024-01-01 00:00:05 - agent.tools - INFO - Fetched - ok | timestamp=2024-01-01T00:00:05 | agent=A B | agent=C\nTraceback\n"
    )
    rows = stats.parse_agent_log(spark, str(tmp_path / "agent.log")).collect()
    assert (rows[0].logger, rows[0].level, rows[0].message) == ("agent.tools", "INFO", "Fetched - ok")
    assert rows[0].fields == {"timestamp": "2024-01-01T00:00:05", "agent": "C"}
    assert (rows[1].level, rows[1].message, rows[1].fields) == (None, "Traceback", {})
