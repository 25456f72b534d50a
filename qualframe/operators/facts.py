"""Counts per column, from one scan of the text columns and one of the typed columns.

Text cells are unpivoted to (column, value) rows, so the regular expressions exist once in the
generated code however wide the table is, and a hash aggregate keyed by column name adds the flags
up before anything is exchanged: what crosses the network is one row per column and task.
Typed columns go through a plain global aggregate. The parts are joined by union into one job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualframe import registry
from qualframe.functions import values as V
from qualframe.functions.numbers import number_of, plain_spelling
from qualframe.model import EMAIL

# Typed columns per aggregate; keeps each generated method within what the JVM will compile.
GROUP_SIZE = 16

FACT_FIELDS = (
    ("column", "string"),
    ("kind", "string"),
    ("rows", "bigint"),
    ("blanks", "bigint"),
    ("placeholders", "bigint"),
    ("numeric_like", "bigint"),
    ("date_like", "bigint"),
    ("padded", "bigint"),
    ("invalid", "bigint"),
    ("strict_numbers", "bigint"),
    ("bytes", "bigint"),
    ("one_value", "boolean"),
    # of registered detectors: "kind name" -> value
    ("extra", "map<string,double>"),
)

# Name of the column that carries row order and belongs to no table.
HIDDEN = "__row_order"


def data_columns(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema.fields if f.name != HIDDEN]


def data_names(df: DataFrame) -> list[str]:
    return [f.name for f in data_columns(df)]


def text_cells(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, value) rows of the named text columns."""
    cells = df.select(*[V.quoted(n).cast("string").alias(n) for n in names])
    return cells.unpivot([], [V.quoted(n) for n in names], "column", "value")


def _shaped(known: dict[str, Column]) -> list[Column]:
    return [known.get(name, F.lit(None)).cast(dtype).alias(name) for name, dtype in FACT_FIELDS]


def _extra(values: dict[tuple[str, str], Column]) -> Column:
    """The aggregates of registered detectors as one map; null without any."""
    entries = [x for (kind, name), c in values.items() for x in (F.lit(f"{kind} {name}"), c.cast("double"))]
    return F.create_map(*entries) if entries else F.lit(None)


def _text_facts(df: DataFrame, names: list[str]) -> DataFrame:
    value, s, blank = F.col("value"), F.col("s"), F.col("blank")
    cells = V.with_stripped(text_cells(df, names)).withColumn(
        "blank", F.coalesce(V.stripped_is_placeholder(s), F.lit(True))
    )
    flagged = V.with_flags(cells)
    expected = {n: V.expected_format(n) for n in names}
    emails = [n for n in names if expected[n] == EMAIL]
    phones = [n for n in names if expected[n] and expected[n] != EMAIL]
    invalid = F.lit(False)
    if emails:
        invalid = invalid | (F.col("column").isin(*emails) & ~s.rlike(V.EMAIL_LAYOUT))
    if phones:
        invalid = invalid | (F.col("column").isin(*phones) & ~s.rlike(V.PHONE_LAYOUT))
    print_of = F.when(~blank, F.xxhash64(value))
    fields = [f for f in data_columns(df) if f.name in names]
    mine = {f.name: registry.aggregates_for(f, value, blank) for f in fields}
    own = {}
    for key in dict.fromkeys(key for found in mine.values() for key in found):
        # one aggregate for all columns the detector looks at
        looked_at = [name for name in names if key in mine[name]]
        of_these = F.col("column").isin(*looked_at)
        cell, empty = F.when(of_these, value), F.when(of_these, blank)
        field = next(f for f in fields if f.name == looked_at[0])
        own[key] = registry.aggregates_for(field, cell, empty)[key]
    totals = flagged.groupBy("column").agg(
        _extra(own).alias("extra"),
        F.count(F.lit(1)).alias("rows"),
        F.count_if(blank).alias("blanks"),
        F.count_if(blank & (s != "")).alias("placeholders"),
        F.count_if(~blank & F.col("number")).alias("numeric_like"),
        F.count_if(~blank & F.col("date")).alias("date_like"),
        F.count_if(~blank & (F.octet_length(value) != F.octet_length(s))).alias("padded"),
        F.count_if(~blank & invalid).alias("invalid"),
        F.count_if(~blank & F.col("parseable")).alias("strict_numbers"),
        F.sum(F.octet_length(value).cast("bigint")).alias("bytes"),
        (F.min(print_of) == F.max(print_of)).alias("one_value"),
    )
    have = {name: F.col(name) for name in totals.columns}
    return totals.select(*_shaped({**have, "kind": F.lit(V.TEXT)}))


def _typed_facts(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    cells, aggregates, rows = [], [F.count(F.lit(1)).alias("rows")], []
    for i, f in enumerate(fields):
        kind, blank = V.kind_of(f.dataType), F.col(f"b{i}")
        cells.append(V.is_blank(V.quoted(f.name), f.dataType).alias(f"b{i}"))
        facts = {"blanks": F.count_if(blank)}
        if kind == V.NUMBER:
            n = F.col(f"n{i}")
            cells.append(number_of(V.quoted(f.name), f.dataType).alias(f"n{i}"))
            spelt = F.count_if(plain_spelling(n)) if V.is_floating(f.dataType) else F.count(n)
            facts |= {
                "numeric_like": spelt,
                "strict_numbers": F.count(n),
                "bytes": F.count(n) * 8,
                "one_value": F.min(n) == F.max(n),
            }
        elif kind == V.OTHER:
            c = F.col(f"c{i}")
            cells.append(V.quoted(f.name).alias(f"c{i}"))
            facts |= {"one_value": F.min(c) == F.max(c), "bytes": F.count(c) * 8}
        extra = registry.aggregates_for(f, F.col(f"u{i}"), blank)
        if extra:
            cells.append(V.quoted(f.name).alias(f"u{i}"))
        facts["extra"] = _extra(extra)
        aggregates += [col.alias(f"{name}_{i}") for name, col in facts.items()]
        known = {name: F.col(f"{name}_{i}") for name in facts}
        known |= {"column": F.lit(f.name), "kind": F.lit(kind), "rows": F.col("rows")}
        rows.append(F.struct(*_shaped(known)))
    return df.select(*cells).agg(*aggregates).select(F.inline(F.array(*rows)))


def column_facts(df: DataFrame) -> DataFrame:
    """One row per column with the fields of ``FACT_FIELDS``; no rows for an empty text table."""
    texts = [f.name for f in data_columns(df) if V.kind_of(f.dataType) == V.TEXT]
    typed = [f for f in data_columns(df) if V.kind_of(f.dataType) != V.TEXT]
    parts = [_typed_facts(df, typed[i : i + GROUP_SIZE]) for i in range(0, len(typed), GROUP_SIZE)]
    if texts:
        parts.append(_text_facts(df, texts))
    return reduce(DataFrame.union, parts)
