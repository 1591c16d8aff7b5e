"""Rules over logged plan steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import repair_json

# The allowed actions and the parameters each must have.
REQUIRED = {
    "search_web": ["query"],
    "fetch_webpage": ["url"],
    "extract_links": ["url"],
    "extract_text": ["url", "selector"],
    "search_documents": ["query"],
    "analyze_webpage": ["url"],
    "get_document_summary": ["file_path"],
    "generate_summary": [],
    "ask_user": [],
}
# The step of a plan that has no valid one.
FALLBACK_ACTION = "generate_summary"
FALLBACK_REASON = (
    "No valid research steps could be executed. "
    "Providing a direct response based on available knowledge."
)

STEP = "struct<action:string,parameters:map<string,string>,reasoning:string>"


def _required(action: Column) -> Column:
    names = [
        part
        for name, keys in REQUIRED.items()
        for part in (F.lit(name), F.array(*[F.lit(k) for k in keys]).cast("array<string>"))
    ]
    return F.try_element_at(F.create_map(*names), action)


def problem(action: Column, parameters: Column) -> Column:
    """What is wrong with a step; NULL if nothing."""
    missing = F.filter(
        _required(action),
        lambda key: ~F.coalesce(F.map_contains_key(parameters, key), F.lit(False)),
    )
    needs = F.concat(
        action, F.lit(" requires "), F.array_join(F.transform(_required(action), lambda k: F.concat(F.lit("'"), k, F.lit("'"))), " and ")
    )
    return (
        F.when(F.coalesce(action, F.lit("")) == "", F.lit("empty action"))
        .when(_required(action).isNull(), F.concat(F.lit("unknown action '"), action, F.lit("'")))
        .when(F.size(missing) > 0, needs)
    )


def validate_steps(steps: DataFrame) -> DataFrame:
    """Add ``valid`` and ``reason``. Input: action, parameters map."""
    reason = problem(F.col("action"), F.col("parameters"))
    return steps.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def coerce_steps(steps: DataFrame, raw: str = "step") -> DataFrame:
    """Steps from their JSON text; what is no object, or has no action, is dropped.

    A bare string is the query of ``search_web``; other parameters that are no object
    become empty.
    """
    rest = [c for c in steps.columns if c != raw]
    read = steps.withColumn("_v", F.try_parse_json(F.col(raw)))
    read = read.filter(F.schema_of_variant("_v").startswith("OBJECT"))

    def member(name: str, kind: str) -> Column:
        return F.try_variant_get("_v", f"$.{name}", kind)

    def kind_of(name: str) -> Column:
        return F.schema_of_variant(member(name, "variant"))

    none = F.create_map().cast("map<string,string>")
    parameters = (
        F.when(kind_of("parameters").startswith("OBJECT"), member("parameters", "map<string,string>"))
        .when(
            (member("action", "string") == "search_web") & (kind_of("parameters") == "STRING"),
            F.create_map(F.lit("query"), member("parameters", "string")),
        )
        .otherwise(none)
    )
    # A reasoning that is there but is no text fails the step, as does such an action.
    reasoning_ok = kind_of("reasoning").isNull() | (kind_of("reasoning") == "STRING")
    return read.filter((kind_of("action") == "STRING") & reasoning_ok).select(
        *rest,
        member("action", "string").alias("action"),
        F.coalesce(parameters, none).alias("parameters"),
        F.coalesce(member("reasoning", "string"), F.lit("")).alias("reasoning"),
    )


def refine_plans(plans: DataFrame) -> DataFrame:
    """Keep the valid steps of each plan; a plan left with none gets one fallback step."""
    kept = F.filter("steps", lambda s: problem(s["action"], s["parameters"]).isNull())
    fallback = F.array(
        F.struct(
            F.lit(FALLBACK_ACTION).alias("action"),
            F.create_map().cast("map<string,string>").alias("parameters"),
            F.lit(FALLBACK_REASON).alias("reasoning"),
        )
    ).cast(f"array<{STEP}>")
    kept = kept.cast(f"array<{STEP}>")
    return plans.withColumn("steps", F.when(F.size(kept) > 0, kept).otherwise(fallback))


def reply_steps(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """The steps of plans from the replies that hold them, mended and coerced.

    Input: plan_id and the reply's text, an object with a list ``steps``; other replies give
    no step. ``step_no`` counts from 0 over all members of the list.
    """
    read = replies.withColumn("_v", repair_json(F.col(reply)))
    listed = F.try_variant_get("_v", "$.steps", "array<variant>")
    rest = [c for c in replies.columns if c != reply]
    return coerce_steps(read.select(*rest, F.posexplode(listed).alias("step_no", "_s")).select(*rest, "step_no", F.to_json("_s").alias("step")))


def collect_plans(steps: DataFrame, key: str = "plan_id") -> DataFrame:
    """One row per plan with its steps in order. Input: the key, step_no, action, parameters, reasoning."""
    parts = F.collect_list(F.struct("step_no", "action", "parameters", "reasoning"))
    placed = F.array_sort(parts, lambda a, b: F.signum(a["step_no"].cast("double") - b["step_no"]).cast("int"))
    step = F.transform(placed, lambda s: F.struct(s["action"].alias("action"), s["parameters"].alias("parameters"), s["reasoning"].alias("reasoning")))
    return steps.groupBy(key).agg(step.cast(f"array<{STEP}>").alias("steps"))
