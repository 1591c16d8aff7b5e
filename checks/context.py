"""Context text, plan steps, statistics and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import query, table
from checks.pages import DOMAINS, PARTS
from checks.search import HTML_PAGES, bm25, questions
from marginalia.operators import context as c
from marginalia.operators import pages as p
from marginalia.operators import stats, steps
from marginalia.plans.research import research_contexts

NL = "chr(10)"
# A conversation is a query; its turns are the results found for it, some without title or snippet.
RESULTS = """results AS (SELECT conv_id AS query_id, turn AS rank, CASE role WHEN 'user' THEN NULL ELSE upper(role) END AS title,
    CASE WHEN length(text) < 60 THEN NULL ELSE text END AS snippet, 'https://h/' || md5(text) AS url FROM conversations)"""
SEARCH_TEXT = f"""search_text AS (SELECT query_id, string_agg('- ' || coalesce(title, 'No title') || ': ' || coalesce(snippet, 'No snippet')
    || ' (Source: ' || url || ')' || {NL} || {NL}, '' ORDER BY rank) AS text FROM (SELECT *, row_number() OVER
    (PARTITION BY query_id ORDER BY rank) AS n FROM results) WHERE n <= 5 GROUP BY 1)"""
# Pages are fetched in order for the query of their number modulo the conversations; some fail.
FETCHED = f"""{PARTS}, fetched AS (SELECT page_id % (SELECT count(DISTINCT conv_id) FROM conversations) AS query_id, page_id AS position, title, url,
    content, starts_with(url, 'https') AS ok FROM read_pages),
    blocks AS (SELECT query_id, position, ok, CASE WHEN ok THEN 'Webpage: ' || title || ' (Source: ' || url || ')' || {NL} || 'Content: '
        || CASE WHEN length(content) > 1500 THEN left(content, 1500) || '...' ELSE content END || {NL} || {NL}
        ELSE '[FAILED SOURCE] ' || title || ' (URL: ' || url || ')' || {NL} || 'Error: Unknown error' || {NL}
        || 'WARNING: This source could not be accessed and should not be cited or used as a reference.' || {NL} || {NL} END AS text
        FROM fetched)"""
DOC_TEXT = f"""doc_text AS (SELECT query_id, string_agg('- ' || text || ' (Source: ' || source || ')' || {NL} || {NL}, '' ORDER BY doc_id) AS text
    FROM (SELECT quality AS query_id, d.doc_id, text, CASE WHEN lang = 'en' THEN 'Unknown' ELSE source END AS source,
        row_number() OVER (PARTITION BY quality ORDER BY d.doc_id) AS n FROM labels l JOIN documents d USING (doc_id)) WHERE n <= 5 GROUP BY 1)"""


def results(spark, d):
    role, text = F.col("role"), F.col("text")
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.when(role != "user", F.upper(role)).alias("title"),
        F.when(F.length(text) >= 60, text).alias("snippet"), F.concat(F.lit("https://h/"), F.md5(text)).alias("url"),
    )


def fetched(spark, d):
    n = table(spark, d, "conversations").select("conv_id").distinct().count()
    read = p.parse_pages(table(spark, d, "pages"))
    return read.select(
        (F.col("page_id") % n).alias("query_id"), F.col("page_id").alias("position"), "title", "url", "content",
        F.col("url").startswith("https").alias("fetch_success"), F.lit(None).cast("string").alias("error"),
    )


def doc_hits(spark, d):
    joined = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return joined.select(
        F.col("quality").cast("bigint").alias("query_id"), F.col("doc_id").alias("rank"), F.col("text").alias("content"),
        F.when(F.col("lang") != "en", F.col("source")).alias("source"),
    )


@query("format_search_context", f"WITH {RESULTS}, {SEARCH_TEXT} SELECT query_id, text FROM search_text")
def format_search_context(spark, d):
    return c.format_search_context(results(spark, d))


@query("format_page_context", f"WITH {FETCHED} SELECT query_id, position, text FROM blocks")
def format_page_context(spark, d):
    return c.format_page_context(fetched(spark, d))


@query("format_doc_context", f"WITH {DOC_TEXT} SELECT query_id, text FROM doc_text")
def format_doc_context(spark, d):
    return c.format_doc_context(doc_hits(spark, d))


@query(
    "count_failures",
    "SELECT user_id AS query_id, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY 1",
)
def count_failures(spark, d):
    return c.count_failures(
        table(spark, d, "events").select(F.col("user_id").alias("query_id"), (F.col("event_type") != "error").alias("success"))
    )


@query(
    "build_context",
    f"""WITH {RESULTS}, {SEARCH_TEXT}, {FETCHED}, {DOC_TEXT},
        queries AS (SELECT DISTINCT conv_id AS query_id FROM conversations UNION SELECT DISTINCT conv_id + 1000000 FROM conversations),
        read AS (SELECT query_id, string_agg(text, '' ORDER BY position) AS text, count(*) FILTER (NOT ok) AS failures FROM blocks GROUP BY 1)
        SELECT query_id, CASE WHEN s.text IS NULL AND r.text IS NULL THEN 'No web results available.'
            ELSE coalesce(s.text, '') || coalesce(r.text, '') END AS web_context,
            coalesce(d.text, 'No document results available.') AS doc_context, coalesce(r.failures, 0) AS failures
        FROM queries LEFT JOIN search_text s USING (query_id) LEFT JOIN read r USING (query_id) LEFT JOIN doc_text d USING (query_id)""",
)
def build_context(spark, d):
    found = results(spark, d)
    asked = found.select("query_id").distinct()
    asked = asked.union(asked.select(F.col("query_id") + 1000000))
    return c.build_context(asked, found, fetched(spark, d), doc_hits(spark, d))


# All hosts are below an allowed domain, so the two best pages of a query are both read.
@query(
    "research_contexts",
    f"""WITH {PARTS}, {bm25(HTML_PAGES, 5)}, {DOC_TEXT},
        listed AS (SELECT query_id, string_agg('- ' || title || ': ' || snippet || ' (Source: ' || url || ')' || {NL} || {NL}, '' ORDER BY rank) AS text
            FROM ranked GROUP BY 1),
        visited AS (SELECT query_id, string_agg('Webpage: ' || r.title || ' (Source: ' || r.url || ')' || {NL} || 'Content: '
            || CASE WHEN length(content) > 1500 THEN left(content, 1500) || '...' ELSE content END || {NL} || {NL}, '' ORDER BY rank) AS text
            FROM ranked r JOIN read_pages USING (page_id) WHERE rank <= 2 GROUP BY 1)
        SELECT item_id AS query_id, coalesce(l.text || v.text, 'No web results available.') AS web_context,
            coalesce(d.text, 'No document results available.') AS doc_context, 0 AS failures
        FROM benchmark LEFT JOIN listed l ON l.query_id = item_id LEFT JOIN visited v ON v.query_id = item_id
            LEFT JOIN doc_text d ON d.query_id = item_id""",
)
def research_contexts_query(spark, d):
    asked = questions(spark, d)
    hits = doc_hits(spark, d)
    return research_contexts(asked, table(spark, d, "pages"), hits, DOMAINS + ["example.com", "example.net"])


# ---- plan steps: the kind of an event picks the action, its value the parameters -----------------

ACTIONS = ["search_web", "extract_text", "fly_away", "generate_summary", "get_document_summary"]
KINDS = ["click", "view", "error", "signup", "purchase"]
DUCK_ACTION = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{a}'" for k, a in zip(KINDS, ACTIONS)) + " END"
DUCK_STEPS = f"""s AS (SELECT event_id AS step_no, user_id AS plan_id, CASE WHEN value < 1 THEN '' ELSE {DUCK_ACTION} END AS action,
    value >= 20 AS has_query, value >= 30 AS has_url, value >= 40 AS has_selector, value >= 50 AS has_file FROM events),
    judged AS (SELECT *, CASE WHEN action = '' THEN 'empty action' WHEN action = 'fly_away' THEN 'unknown action ''fly_away'''
        WHEN action = 'search_web' AND NOT has_query THEN 'search_web requires ''query'''
        WHEN action = 'extract_text' AND NOT (has_url AND has_selector) THEN 'extract_text requires ''url'' and ''selector'''
        WHEN action = 'get_document_summary' AND NOT has_file THEN 'get_document_summary requires ''file_path''' END AS reason FROM s)"""


def step_rows(spark, d):
    kind, value = F.col("event_type"), F.col("value")
    action = F.lit(None).cast("string")
    for k, a in zip(KINDS, ACTIONS):
        action = F.when(kind == k, F.lit(a)).otherwise(action)
    pairs = [("query", 20), ("url", 30), ("selector", 40), ("file_path", 50)]
    parameters = F.map_filter(
        F.create_map(*[x for name, least in pairs for x in (F.lit(name), F.when(value >= least, F.col("props")))]),
        lambda _, v: v.isNotNull(),
    )
    return table(spark, d, "events").select(
        F.col("event_id").alias("step_no"), F.col("user_id").alias("plan_id"),
        F.when(value < 1, F.lit("")).otherwise(action).alias("action"), parameters.alias("parameters"),
        F.lit("why").alias("reasoning"),
    )


@query("validate_steps", f"WITH {DUCK_STEPS} SELECT step_no, plan_id, action, reason, reason IS NULL AS valid FROM judged")
def validate_steps(spark, d):
    return steps.validate_steps(step_rows(spark, d)).select("step_no", "plan_id", "action", "reason", "valid")


# The kind of an event says in which form the step was written; the last two forms are no steps.
@query(
    "coerce_steps",
    f"""SELECT event_id AS step_no, {DUCK_ACTION} AS action,
        CASE event_type WHEN 'click' THEN 'query=some words' WHEN 'view' THEN 'k=' || regexp_extract(props, '[0-9]+') ELSE '' END AS parameters,
        CASE event_type WHEN 'view' THEN 'because' ELSE '' END AS reasoning
        FROM events WHERE event_type IN ('click', 'view', 'error')""",
)
def coerce_steps(spark, d):
    kind, props, action = F.col("event_type"), F.col("props"), F.lit(None).cast("string")
    for k, a in zip(KINDS, ACTIONS):
        action = F.when(kind == k, F.lit(a)).otherwise(action)
    head = F.concat(F.lit('{"action": "'), action, F.lit('"'))
    raw = (
        F.when(kind == "click", F.concat(head, F.lit(', "parameters": "some words"}')))
        .when(kind == "view", F.concat(head, F.lit(', "parameters": '), props, F.lit(', "reasoning": "because"}')))
        .when(kind == "error", F.concat(head, F.lit(', "parameters": [1, 2]}')))
        .when(kind == "signup", F.concat(F.lit("["), props, F.lit("]")))
        .otherwise(props)
    )
    done = steps.coerce_steps(table(spark, d, "events").select(F.col("event_id").alias("step_no"), raw.alias("step")))
    pairs = F.transform(F.map_entries("parameters"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return done.select("step_no", "action", F.array_join(pairs, ",").alias("parameters"), "reasoning")


# A plan is one user's steps of one hour, a few at most.
@query(
    "refine_plans",
    f"""WITH {DUCK_STEPS}, plans AS (SELECT plan_id, strftime(ts, '%Y%m%d%H') AS slot, string_agg(action, ',' ORDER BY step_no)
            FILTER (reason IS NULL) AS kept FROM judged JOIN events ON event_id = step_no GROUP BY 1, 2)
        SELECT plan_id, slot, coalesce(kept, 'generate_summary') AS actions, kept IS NULL AS fallback FROM plans""",
)
def refine_plans(spark, d):
    slots = table(spark, d, "events").select(F.col("event_id").alias("step_no"), F.date_format("ts", "yyyyMMddHH").alias("slot"))
    plans = (
        step_rows(spark, d).join(slots, "step_no").groupBy("plan_id", "slot")
        .agg(F.sort_array(F.collect_list(F.struct("step_no", "action", F.to_json("parameters").alias("p"), "reasoning"))).alias("s"))
        .select("plan_id", "slot", F.transform("s", lambda x: F.struct(
            x["action"].alias("action"), F.from_json(x["p"], "map<string,string>").alias("parameters"), x["reasoning"].alias("reasoning")
        )).alias("steps"))
    )
    refined = steps.refine_plans(plans)
    return refined.select(
        "plan_id", "slot", F.array_join("steps.action", ",").alias("actions"),
        F.get(F.col("steps.reasoning"), F.lit(0)).startswith("No valid research steps").alias("fallback"),
    )


@query(
    "timing_stats",
    """SELECT event_type, round(avg(value), 6) AS avg_seconds, min(value) AS min_seconds, max(value) AS max_seconds, count(*) AS total,
        count(*) FILTER (value < 30) AS successful, round(avg(user_id), 6) AS avg_steps FROM events GROUP BY 1""",
)
def timing_stats(spark, d):
    runs = table(spark, d, "events").withColumn("ok", F.col("value") < 30)
    found = stats.timing_stats(runs, ["event_type"], "value", ok="ok", steps="user_id")
    return found.withColumn("avg_seconds", F.round("avg_seconds", 6)).withColumn("avg_steps", F.round("avg_steps", 6))


@query(
    "parse_agent_log",
    """SELECT event_id, CASE WHEN event_type <> 'view' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS logged_at,
        CASE WHEN event_type <> 'view' THEN 'agent.' || event_type END AS logger, CASE WHEN event_type <> 'view' THEN 'INFO' END AS level,
        CASE WHEN event_type <> 'view' THEN 'Done - in ' || value || 's' ELSE 'plain ' || user_id END AS message,
        CASE WHEN event_type <> 'view' THEN user_id::varchar END AS "user", CASE WHEN event_type <> 'view' THEN props END AS props FROM events""",
)
def parse_agent_log(spark, d):
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    line = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" - agent."), kind, F.lit(" - INFO - Done - in "), F.col("value").cast("string"),
        F.lit("s | user="), user, F.lit(" | props="), F.col("props"),
    )
    lines = table(spark, d, "events").select(
        "event_id", F.when(kind != "view", line).otherwise(F.concat(F.lit("plain "), user)).alias("value")
    )
    read = stats.parse_log_lines(lines)
    return read.select(
        "event_id", F.date_format("logged_at", "yyyy-MM-dd HH:mm:ss").alias("logged_at"), "logger", "level", "message",
        F.col("fields")["user"].alias("user"), F.col("fields")["props"].alias("props"),
    )


# A user's events are the steps of a reply: clicks search with a bare string, views ask, the others are no steps.
@query(
    "reply_steps",
    """WITH s AS (SELECT user_id AS plan_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step_no, event_type, event_id FROM events)
        SELECT plan_id, string_agg(CASE event_type WHEN 'click' THEN step_no || ' search_web ' || event_id || ' why' ELSE step_no || ' ask_user  ' END,
            '; ' ORDER BY step_no) AS steps FROM s WHERE event_type IN ('click', 'view') GROUP BY 1""",
)
def reply_steps(spark, d):
    kind, number = F.col("event_type"), F.col("event_id").cast("string")
    step = (
        F.when(kind == "click", F.concat(F.lit('{"action": "search_web", "parameters": "'), number, F.lit('", "reasoning": "why"}')))
        .when(kind == "view", F.lit('{"action": "ask_user", "parameters": [1]}'))
        .when(kind == "error", F.lit('{"parameters": {}}'))
        .otherwise(number)
    )
    listed = F.array_sort(F.collect_list(F.struct("event_id", step.alias("s"))))
    replies = table(spark, d, "events").groupBy(F.col("user_id").alias("plan_id")).agg(listed.alias("l"))
    text = F.concat(F.lit('```json\n{"steps": ['), F.array_join("l.s", ", "), F.lit(",]}\n```"))
    found = steps.reply_steps(replies.select("plan_id", text.alias("reply")))
    named = found.withColumn("action", F.concat(F.col("step_no").cast("string"), F.lit(" "), "action"))
    shown = F.transform("steps", lambda x: F.concat(x["action"], F.lit(" "), F.coalesce(x["parameters"]["query"], F.lit("")), F.lit(" "), x["reasoning"]))
    return steps.collect_plans(named).select("plan_id", F.array_join(shown, "; ").alias("steps"))
