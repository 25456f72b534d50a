"""Cell tests as native column expressions: Column in, Column out, no Python per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -------------------------------------------------------------------------

# Every character that counts as white space at the ends of a value.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# Written-out spellings of "no value", compared after strip and lower.
PLACEHOLDERS = (
    "",
    "na",
    "n/a",
    "n.a.",
    "n/a.",
    "nan",
    "null",
    "none",
    "nil",
    "-",
    "--",
    "?",
    "#n/a",
)
LONGEST_PLACEHOLDER = max(map(len, PLACEHOLDERS))

CURRENCY_SIGNS = "$€£"

# The layouts below describe which texts count as a date, a number, an email, a phone number.
# One leading ^ (not one per branch) lets the regex engine stop at the first position.
DATE_LAYOUT = (
    r"(?d)^(?:"
    r"\p{Nd}{4}-\p{Nd}{1,2}-\p{Nd}{1,2}$"
    r"|\p{Nd}{1,2}/\p{Nd}{1,2}/\p{Nd}{4}$"
    r"|\p{Nd}{1,2}-\p{Nd}{1,2}-\p{Nd}{4}$"
    r"|\p{Nd}{4}/\p{Nd}{1,2}/\p{Nd}{1,2}$"
    rf"|\p{{Nd}}{{1,2}}[{SPACE_CLASS}]+[A-Za-z]{{3,9}}[{SPACE_CLASS}]+\p{{Nd}}{{4}}$"
    rf"|[A-Za-z]{{3,9}}[{SPACE_CLASS}]+\p{{Nd}}{{1,2}},?[{SPACE_CLASS}]+\p{{Nd}}{{4}}$"
    r"|\p{Nd}{4}-\p{Nd}{1,2}-\p{Nd}{1,2}[ T]\p{Nd}{1,2}:\p{Nd}{2}"
    r")"
)
# Currency signs may stand anywhere, as if deleted first; what remains is an optional minus, digits
# and commas, an optional fraction and an optional percent sign.
_SIGN = f"[{CURRENCY_SIGNS}]*"
NUMBER_LAYOUT = (
    rf"(?d)^{_SIGN}-?[\p{{Nd}},{CURRENCY_SIGNS}]*"
    rf"(?:\p{{Nd}}|\.{_SIGN}\p{{Nd}}[\p{{Nd}}{CURRENCY_SIGNS}]*){_SIGN}%?{_SIGN}$"
)
EMAIL_LAYOUT = rf"(?d)^[^@{SPACE_CLASS}]+@[^@{SPACE_CLASS}]+\.[A-Za-z]{{2,}}$"
PHONE_LAYOUT = rf"(?d)^[+()\-.{SPACE_CLASS}\p{{Nd}}]{{7,20}}$"
# Length of the shortest date text, such as 1/1/2026.
SHORTEST_DATE = 8

# Plain decimal text as a number parser reads it; infinities are spelt out.
ASCII_SPACE = "\t\n\x0b\x0c\r "
PARSEABLE_NUMBER = (
    r"(?di)^[\t-\r ]*[+-]?"
    r"(?:[0-9]+\.?[0-9]*(?:e[+-]?[0-9]+)?|\.[0-9]+(?:e[+-]?[0-9]+)?|inf|infinity)[\t-\r ]*$"
)

EMAIL_NAME_PARTS = ("email", "e-mail")
PHONE_NAME_PARTS = ("phone", "mobile", "contact number")


# --- column kinds ---------------------------------------------------------------------------

TEXT, NUMBER, OTHER, NESTED = "text", "number", "other", "nested"


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return TEXT
    if isinstance(dtype, T.NumericType):
        return NUMBER
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)):
        return NESTED
    return OTHER


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def quoted(name: str) -> Column:
    """Column by exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


# --- text basics ----------------------------------------------------------------------------


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def as_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def title_case(c: Column) -> Column:
    """Capital after every non-letter, as in O'Neil or Mary-Jane or 3Rd."""
    cased = r"\p{Lu}\p{Ll}\p{Lt}"
    runs = F.regexp_extract_all(c, F.lit(f"([{cased}]+|[^{cased}]+)"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


# --- predicates -----------------------------------------------------------------------------


def is_placeholder(c: Column) -> Column:
    """True for '' and for the written-out spellings; null stays null."""
    return stripped_is_placeholder(strip(c))


def stripped_is_placeholder(s: Column) -> Column:
    """As above for text already stripped; the length test spares lower() on long texts."""
    return (F.length(s) <= LONGEST_PLACEHOLDER) & F.lower(s).isin(*PLACEHOLDERS)


def is_blank(c: Column, dtype: T.DataType) -> Column:
    kind = kind_of(dtype)
    if kind == TEXT:
        return F.coalesce(is_placeholder(c), F.lit(True))
    if is_floating(dtype):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def is_placeholder_text(c: Column) -> Column:
    """Blank, yet something is written in the cell."""
    s = strip(c)
    return F.coalesce(stripped_is_placeholder(s) & (s != ""), F.lit(False))


def is_numeric_like(c: Column) -> Column:
    """Shape of a number. Not the same as being parseable: see numbers.lenient_number."""
    return strip(c).rlike(NUMBER_LAYOUT)


def is_date_like(c: Column) -> Column:
    return strip(c).rlike(DATE_LAYOUT)


def is_email(c: Column) -> Column:
    return strip(c).rlike(EMAIL_LAYOUT)


def is_phone(c: Column) -> Column:
    return strip(c).rlike(PHONE_LAYOUT)


def expected_format(column_name: str) -> str | None:
    """Which format rule a column name calls for, if any."""
    from qualframe.model import EMAIL, PHONE

    name = column_name.lower()
    if any(part in name for part in EMAIL_NAME_PARTS):
        return EMAIL
    if any(part in name for part in PHONE_NAME_PARTS):
        return PHONE
    return None


def has_format(c: Column, expected: str) -> Column:
    from qualframe.model import EMAIL

    return is_email(c) if expected == EMAIL else is_phone(c)


def with_stripped(cells: DataFrame) -> DataFrame:
    """Add ``s``, the stripped ``value``, and its ``first`` and ``last`` character.

    Only cells with an end that is not ordinary ASCII are run through ``strip``. Each step is a
    projection of its own, so that no end is cut out twice.
    """
    value = F.col("value")
    ends = cells.withColumns({"first": F.left(value, F.lit(1)), "last": F.right(value, F.lit(1))})

    def ordinary(end: str) -> Column:
        return (F.col(end) > " ") & (F.col(end) < "\x7f")

    plain = ends.withColumn("plain", ordinary("first") & ordinary("last"))
    stripped = plain.withColumn("s", F.when(F.col("plain"), value).otherwise(strip(value)))
    first = F.when(F.col("plain"), F.col("first")).otherwise(F.left("s", F.lit(1)))
    last = F.when(F.col("plain"), F.col("last")).otherwise(F.right("s", F.lit(1)))
    return stripped.withColumns({"first": first, "last": last}).drop("plain")


def with_flags(cells: DataFrame) -> DataFrame:
    """Add ``number``, ``date`` and ``parseable`` to the cells of ``with_stripped``.

    The same answers as the three patterns, most of them without running a pattern: what starts with
    an ASCII letter is no number and, unless it ends in a digit, no date; a number is no date; a number
    written without signs, commas and percent is parseable.
    """
    value, s, first, last = (F.col(n) for n in ("value", "s", "first", "last"))
    letter = ((first >= "A") & (first <= "Z")) | ((first >= "a") & (first <= "z"))
    cells = cells.withColumn("letter", letter)
    letter, number, date = F.col("letter"), F.col("number"), F.col("date")
    no = F.lit(False)
    cells = cells.withColumn("number", F.when(~letter, s.rlike(NUMBER_LAYOUT)).otherwise(no))
    closing = ~letter | ((last >= "0") & ((last <= "9") | (last > "\x7f")))
    maybe_date = ~number & closing & (F.octet_length(s) >= SHORTEST_DATE)
    cells = cells.withColumn("date", F.when(maybe_date, s.rlike(DATE_LAYOUT)).otherwise(no))
    bare = (
        number
        & (value == s)
        & (F.octet_length(s) == F.length(s))
        & ~s.contains(",")
        & ~s.contains("%")
        & ~s.contains("$")
    )
    maybe = ~date & (~letter | first.isin("i", "I"))
    parseable = F.when(bare, F.lit(True)).when(maybe, value.rlike(PARSEABLE_NUMBER)).otherwise(no)
    return cells.withColumn("parseable", parseable).drop("letter")


def date_shape(c: Column) -> Column:
    """Layout of a date text: digit runs become #, letter runs become A."""
    return F.regexp_replace(F.regexp_replace(strip(c), r"\p{Nd}+", "#"), "[A-Za-z]+", "A")
