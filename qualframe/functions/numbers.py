"""Two readings of a number from text, kept apart on purpose.

``strict_number`` takes plain decimal text and is what the outlier test uses, so "1,200" and "$3"
are no numbers to it. ``lenient_number`` first drops currency signs, commas, inner space and a
trailing percent sign, and is what coercion uses. Both give null where they cannot read.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qualframe.functions.values import (
    ASCII_SPACE,
    CURRENCY_SIGNS,
    NUMBER,
    PARSEABLE_NUMBER,
    SPACE_CHARS,
    TEXT,
    is_floating,
    kind_of,
)

def strict_number(c: Column) -> Column:
    """The guard comes first because a bare cast also reads '1d', '2f' and 'nan'."""
    return F.when(c.rlike(PARSEABLE_NUMBER), F.btrim(c, F.lit(ASCII_SPACE)).try_cast("double"))


def lenient_number(c: Column) -> Column:
    bare = F.translate(c, CURRENCY_SIGNS + "," + SPACE_CHARS, "")
    return strict_number(F.rtrim(bare, F.lit("%")))


def number_of(c: Column, dtype: T.DataType, lenient: bool = False) -> Column | None:
    """The column as double, NaN read as null; None for kinds that hold no numbers."""
    kind = kind_of(dtype)
    if kind == TEXT:
        return lenient_number(c) if lenient else strict_number(c)
    if kind == NUMBER:
        value = c.cast("double")
        return F.when(~F.isnan(value), value) if is_floating(dtype) else value
    return None


def plain_spelling(value: Column) -> Column:
    """True where a double is written without an exponent (and is finite)."""
    size = F.abs(value)
    return (value == 0) | ((size >= 1e-4) & (size < 1e16))
