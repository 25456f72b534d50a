"""Column profiles: one row per column, as a lazy DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualframe.functions import values as V
from qualframe.functions.numbers import number_of
from qualframe.operators.facts import HIDDEN, column_facts, data_columns
from qualframe.operators.frequencies import distinct_counts

SAMPLES = 5
SAMPLE_LENGTH = 60
EDGE_LENGTH = 40


def value_range(df: DataFrame) -> DataFrame:
    """(column, min_value, max_value, mean_value) of present values.

    Numbers compare as numbers, text by code point with the ends cut to 40 characters; only numeric
    columns have a mean.
    """
    aggregates, rows = [], []
    for i, f in enumerate(data_columns(df)):
        kind = V.kind_of(f.dataType)
        if kind == V.NESTED:
            continue
        c = V.quoted(f.name)
        present = F.when(~V.is_blank(c, f.dataType), c)
        aggregates += [F.min(present).alias(f"lo{i}"), F.max(present).alias(f"hi{i}")]
        mean = F.lit(None).cast("double")
        if kind == V.NUMBER:
            aggregates.append(F.avg(number_of(c, f.dataType)).alias(f"mean{i}"))
            mean = F.col(f"mean{i}")
        ends = [F.left(F.col(f"{e}{i}").cast("string"), F.lit(EDGE_LENGTH)) for e in ("lo", "hi")]
        rows.append(
            F.struct(
                F.lit(f.name).alias("column"),
                ends[0].alias("min_value"),
                ends[1].alias("max_value"),
                mean.alias("mean_value"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def sample_values(df: DataFrame) -> DataFrame:
    """(column, sample_values): the first present values in row order, the lowest where no order is known.

    Every row is looked at; each task sends on SAMPLES values per column.
    """
    named = [f for f in data_columns(df) if V.kind_of(f.dataType) != V.NESTED]
    found = _first_values(df, named, [HIDDEN] if HIDDEN in df.columns else [])
    # SAMPLES short texts per column.
    rows = [(f.name, found.get(f.name, [])) for f in named]
    return df.sparkSession.createDataFrame(rows, "column string, sample_values array<string>")


def _first_values(df: DataFrame, named: list[T.StructField], order: list[str]) -> dict[str, list[str]]:
    if not named:
        return {}
    cells = df.select(
        *order,
        *[
            F.when(
                ~V.is_blank(V.quoted(f.name), f.dataType),
                F.left(V.quoted(f.name).cast("string"), F.lit(SAMPLE_LENGTH)),
            ).alias(f.name)
            for f in named
        ],
    )
    cells = cells.unpivot(order, [V.quoted(f.name) for f in named], "column", "value").where("value is not null")
    nth = F.row_number().over(Window.partitionBy("column").orderBy(*order, *([] if order else ["value"])))
    few = cells.withColumn("nth", nth).where(F.col("nth") <= SAMPLES).select("column", "nth", "value")
    found: dict[str, list[tuple[int, str]]] = {}
    for row in few.collect():
        found.setdefault(row["column"], []).append((row["nth"], row["value"]))
    return {name: [value for _, value in sorted(cells)] for name, cells in found.items()}


def profile_columns(df: DataFrame, approx: bool = False, samples: bool = True) -> DataFrame:
    """The profile of every column in table order.

    Distinct counts are exact unless ``approx``; ``samples=False`` leaves out the example values.
    """
    fields = data_columns(df)
    order = df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(fields)],
        "position int, column string, dtype string",
    )
    present = F.col("rows") - F.col("blanks")

    def share(count: str):
        return F.when(present > 0, 100.0 * F.coalesce(F.col(count), F.lit(0)) / present).otherwise(0.0)

    # All of these hold one row per column of the table.
    parts = [order, column_facts(df), distinct_counts(df, approx), value_range(df)]
    if samples:
        parts.append(sample_values(df))
    joined = reduce(lambda a, b: a.join(F.broadcast(b), "column", "left"), parts)
    return joined.orderBy("position").select(
        "position",
        F.col("column").alias("name"),
        "dtype",
        present.alias("non_null"),
        F.col("blanks").alias("null_count"),
        F.when(F.col("rows") > 0, 100.0 * F.col("blanks") / F.col("rows")).otherwise(0.0).alias("null_pct"),
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
        share("numeric_like").alias("numeric_like_pct"),
        share("date_like").alias("date_like_pct"),
        "min_value",
        "max_value",
        "mean_value",
        F.coalesce("bytes", F.lit(0)).alias("bytes"),
        *([F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values")] if samples else []),
    )


def profile_table(df: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """One row for the whole table: rows, columns and the bytes its cells hold."""
    columns = profile_columns(df, samples=False) if columns is None else columns
    return columns.agg(
        F.max(F.col("non_null") + F.col("null_count")).alias("rows"),
        F.count(F.lit(1)).alias("columns"),
        F.sum("bytes").alias("bytes"),
    )


def context_line(columns: DataFrame, table_name: str, shown: int = 12) -> DataFrame:
    """One sentence naming the table, its size and its first columns with their types."""
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]
    )
    numbered = columns.select(
        "position",
        F.concat("name", F.lit(" ("), "dtype", F.lit(")")).alias("text"),
        (F.col("non_null") + F.col("null_count")).alias("rows"),
    )
    count = F.count(F.lit(1))
    more = F.when(count > shown, F.concat(F.lit(" and "), (count - shown).cast("string"), F.lit(" more"))).otherwise("")
    return numbered.agg(
        F.concat(
            F.lit(f"'{table_name}' with "),
            F.format_number(F.max("rows"), 0),
            F.lit(" rows and "),
            count.cast("string"),
            F.lit(" columns: "),
            F.array_join(F.slice(listed, 1, shown), ", "),
            more,
            F.lit("."),
        ).alias("context")
    )
