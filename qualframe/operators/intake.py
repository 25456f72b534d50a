"""Checking raw replies of an outside recommender against the issues they answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qualframe import model as M
from qualframe.functions.values import strip

DEFAULT_CONFIDENCE = 0.8
REASON_LENGTH = 800


# Position given to the fault of leaving issues out, so that it comes last.
LAST = 2_147_483_647


def _array_text(replies: DataFrame) -> DataFrame:
    """(run_id, text): the JSON array inside a plain, fenced or wrapped reply; null if there is none."""
    raw, bare = F.col("reply"), F.col("bare")
    fences = F.regexp_replace(strip(raw), r"(?im)^```(?:json)?\s*|\s*```$", "")
    staged = replies.select("run_id", strip(fences).alias("bare")).withColumn(
        "whole", F.try_parse_json(bare).isNotNull()
    )
    wrapped = F.from_json(F.when(bare.startswith("{"), bare), "map<string,string>")
    first_list = F.get(F.filter(F.map_values(wrapped), lambda v: v.startswith("[")), 0)
    start, back = F.instr(bare, "["), F.instr(F.reverse(bare), "]")
    between = F.substring(bare, start, F.length(bare) - back - start + 2)
    return staged.select(
        "run_id",
        F.when(F.col("whole"), F.when(bare.startswith("["), bare).otherwise(first_list))
        .when((start > 0) & (back > 0), between)
        .alias("text"),
    )


def _items(replies: DataFrame) -> DataFrame:
    """One row per reply item with its fields; unreadable and empty replies keep one row without."""
    fields = ("id", "strategy", "reasoning", "confidence", "fill_value")
    parsed = F.try_parse_json("text")
    read = _array_text(replies).select(
        "run_id", F.try_variant_get(parsed, "$", "array<variant>").alias("items")
    )
    rows = read.select("run_id", F.col("items").isNull().alias("unreadable"), F.posexplode_outer("items"))
    got = {n: F.try_variant_get(F.col("col"), f"$.{n}", "variant") for n in fields}
    staged = rows.select("run_id", "unreadable", F.col("pos").alias("position"), *[c.alias(n) for n, c in got.items()])

    def typed(name: str) -> Column:
        """The text of a field; null when it is of another type."""
        return F.when(F.schema_of_variant(name) == "STRING", F.try_variant_get(F.col(name), "$", "string"))

    def absent(name: str) -> Column:
        return F.col(name).isNull()

    fill_type = F.schema_of_variant("fill_value")
    return staged.select(
        "run_id",
        "unreadable",
        "position",
        typed("id").alias("issue_id"),
        typed("strategy").alias("strategy"),
        F.when(absent("reasoning"), F.lit("")).otherwise(typed("reasoning")).alias("reasoning"),
        F.when(absent("confidence"), F.lit(DEFAULT_CONFIDENCE))
        .otherwise(F.try_variant_get(F.col("confidence"), "$", "double"))
        .alias("confidence"),
        F.when(fill_type == "STRING", F.try_variant_get(F.col("fill_value"), "$", "string")).alias("fill_value"),
        F.coalesce(fill_type, F.lit("VOID")).isin("STRING", "VOID").alias("fill_ok"),
    )


def _checked(replies: DataFrame, issues: DataFrame) -> DataFrame:
    """Items beside the issues they answer, with what is wrong with either."""
    strategy, kind = F.col("strategy"), F.col("issue_type")
    well_formed = (
        F.col("issue_id").isNotNull()
        & strategy.isNotNull()
        & F.col("reasoning").isNotNull()
        & F.coalesce(F.col("confidence").between(0, 1), F.lit(False))
        & F.col("fill_ok")
    )
    menu = F.create_map(
        *[x for name, allowed in M.MENU.items() for x in (F.lit(name), F.array(*map(F.lit, allowed)))]
    )
    message = (
        F.when(F.col("unreadable"), F.lit("The reply holds no JSON array."))
        .when(F.col("position").isNull(), F.lit(None))
        .when(~well_formed, F.lit("A reply item is malformed."))
        .when(kind.isNull(), F.concat(F.lit("Unknown issue id "), "issue_id"))
        .when(
            ~F.array_contains(menu[kind], strategy), F.concat(strategy, F.lit(" is not allowed for "), "issue_id")
        )
    )
    known = issues.select("run_id", "issue_id", "issue_type")
    joined = _items(replies).join(known, ["run_id", "issue_id"], "full_outer")
    of_issue = Window.partitionBy("run_id", "issue_id")
    # Rows of one run: the items one reply cell holds, and the issues of one scan.
    of_run = Window.partitionBy("run_id")
    answered = F.col("position").isNotNull() & F.col("message").isNull()
    return (
        joined.withColumn("message", message)
        .withColumn("answered", F.coalesce(F.max(answered).over(of_issue), F.lit(False)))
        .withColumn("nth_item", F.row_number().over(of_issue.orderBy(F.desc_nulls_last("position"))))
        .withColumn("left_out", kind.isNotNull() & ~F.col("answered") & (F.col("nth_item") == 1))
        .withColumn("replied", F.max(F.col("unreadable").isNotNull()).over(of_run))
        .where("replied")
        .withColumn("no_array", F.coalesce(F.max("unreadable").over(of_run), F.lit(False)))
        .withColumn(
            "turned_down",
            F.max(F.col("message").isNotNull() | F.col("left_out")).over(of_run),
        )
    )


def check_replies(replies: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(advice, errors) from ``replies(run_id, reply)`` and the ``issues`` of those runs.

    A reply counts only as a whole: with one unknown id, one strategy off the menu, one malformed item
    or one issue left out, all of it is turned down and ``errors(run_id, nth, message)`` says why.
    """
    checked = _checked(replies, issues)
    advice = checked.where("not turned_down and nth_item = 1 and position is not null").select(
        "run_id",
        "issue_id",
        "strategy",
        F.left(strip(F.col("reasoning")), F.lit(REASON_LENGTH)).alias("reasoning"),
        F.round("confidence", 3).alias("confidence"),
        "fill_value",
        F.lit("llm").alias("source"),
    )
    # The issues left out make one line per run; every other fault is a line of its own.
    missing = F.col("left_out") & ~F.col("no_array")
    of_run = Window.partitionBy("run_id")
    left_out = checked.withColumns(
        {
            "lost": F.count_if(missing).over(of_run),
            "first_lost": F.min(F.when(missing, F.col("issue_id"))).over(of_run),
        }
    ).where("turned_down")
    own = F.struct(F.coalesce("position", F.lit(-1)).alias("at"), F.col("message").alias("message"))
    summary = F.concat(F.lit("Missing "), F.col("lost").cast("string"), F.lit(" ids, first "), "first_lost")
    lines = F.array_compact(
        F.array(
            F.when(F.col("message").isNotNull(), own),
            F.when(
                missing & (F.col("issue_id") == F.col("first_lost")),
                F.struct(F.lit(LAST).alias("at"), summary.alias("message")),
            ),
        )
    )
    nth = F.row_number().over(Window.partitionBy("run_id").orderBy("line.at"))
    errors = (
        left_out.select("run_id", F.explode(lines).alias("line"))
        .withColumn("nth", nth)
        .select("run_id", "nth", "line.message")
    )
    return advice, errors
