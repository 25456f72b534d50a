"""Reading dates written in mixed layouts, as native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from qualframe.functions.values import SPACE_CLASS, strip

_GAP = f"[{SPACE_CLASS}]+"
# A clock time after an ISO date; an offset may follow.
_CLOCK = (
    r"[ T]([01]?[0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\.[0-9]+)?)?"
    r"( ?[AaPp][Mm])?( ?(Z|[+-][0-9]{2}:?[0-9]{2}))?"
)
YEAR_FIRST = rf"^([0-9]{{4}})(?:/([0-9]{{1,2}})/([0-9]{{1,2}})|-([0-9]{{1,2}})-([0-9]{{1,2}})(?:{_CLOCK})?)$"
PAIR_FIRST = r"^([0-9]{1,2})([/-])([0-9]{1,2})\2([0-9]{4})$"
DAY_NAME_YEAR = rf"^([0-9]{{1,2}}){_GAP}([A-Za-z]+){_GAP}([0-9]{{4}})$"
NAME_DAY_YEAR = rf"^([A-Za-z]+){_GAP}([0-9]{{1,2}}),?{_GAP}([0-9]{{4}})$"

_OVER_12 = "(?:1[3-9]|[2-9][0-9])"
_PART = "[0-9]{1,2}"
FIRST_OVER_12 = rf"^{_OVER_12}[/-]{_PART}[/-][0-9]{{2,4}}$"
SECOND_OVER_12 = rf"^{_PART}[/-]{_OVER_12}[/-][0-9]{{2,4}}$"

# Month names, full.
MONTHS = (
    "january",
    "february",
    "march",
    "april",
    "may",
    "june",
    "july",
    "august",
    "september",
    "october",
    "november",
    "december",
)


def _month_number(name: Column) -> Column:
    lowered = F.lower(name)
    tests = [
        (lowered.isin(full, full[:3], *(["sept"] if full[:3] == "sep" else [])), number)
        for number, full in enumerate(MONTHS, 1)
    ]
    return reduce(lambda acc, t: acc.when(t[0], F.lit(t[1])), tests[1:], F.when(tests[0][0], F.lit(1)))


def day_first_votes(c: Column) -> tuple[Column, Column]:
    """(first part over 12, second part over 12) for slashed or dashed dates, as written."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return text.rlike(FIRST_OVER_12), text.rlike(SECOND_OVER_12)


def is_day_first(c: Column) -> Column:
    """Aggregate: the column must be day-first, since a first part exceeds 12 and no second does."""
    first, second = day_first_votes(c)
    return F.coalesce(F.bool_or(first) & ~F.bool_or(second), F.lit(False))


def iso_date(c: Column, day_first: bool) -> Column:
    """``stripped_iso_date`` of a cell as written."""
    return stripped_iso_date(strip(c), day_first)


def stripped_iso_date(s: Column, day_first: bool) -> Column:
    """Text ``YYYY-MM-DD`` for a readable date, else null.

    A part above 12 is always the day, whichever reading the column has; year-first layouts are
    never swapped. Impossible days such as 31 February read as null.
    """

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(s, pattern, group)

    def date_text(year: Column, month: Column, day: Column) -> Column:
        return F.concat_ws("-", year, month.cast("string"), day.cast("string"))

    slash_month = part(YEAR_FIRST, 2)
    by_slash = slash_month != ""
    year_first = date_text(
        part(YEAR_FIRST, 1),
        F.when(by_slash, slash_month).otherwise(part(YEAR_FIRST, 4)),
        F.when(by_slash, part(YEAR_FIRST, 3)).otherwise(part(YEAR_FIRST, 5)),
    )

    a, b = part(PAIR_FIRST, 1), part(PAIR_FIRST, 3)
    first_is_day = ~b.rlike(f"^{_OVER_12}$") if day_first else a.rlike(f"^{_OVER_12}$")
    pair = date_text(
        part(PAIR_FIRST, 4),
        F.when(first_is_day, b).otherwise(a),
        F.when(first_is_day, a).otherwise(b),
    )

    named = date_text(
        part(DAY_NAME_YEAR, 3), _month_number(part(DAY_NAME_YEAR, 2)), part(DAY_NAME_YEAR, 1)
    )
    leading = date_text(
        part(NAME_DAY_YEAR, 3), _month_number(part(NAME_DAY_YEAR, 1)), part(NAME_DAY_YEAR, 2)
    )
    rewritten = (
        F.when(s.rlike(YEAR_FIRST), year_first)
        .when(s.rlike(PAIR_FIRST), pair)
        .when(s.rlike(DAY_NAME_YEAR), named)
        .when(s.rlike(NAME_DAY_YEAR), leading)
    )
    return F.date_format(F.try_to_timestamp(rewritten, F.lit("yyyy-M-d")), "yyyy-MM-dd")
