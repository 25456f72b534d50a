"""Exact quantiles of many columns without gathering a column anywhere.

Small columns use the built-in exact ``percentile``, whose buffer grows with the number of distinct
values. Larger ones are narrowed scan by scan: each wanted rank has a bracket of values known to
hold it, and one aggregate gives, for all brackets at once, exact counts below and at both ends plus
a quantile sketch of the values inside. The sketch only proposes the next bracket; it is taken when
exact counts confirm it. A bracket that holds few values is read out and settled on the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import ROUND_FLOOR, Decimal, localcontext
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Up to this many values the built-in aggregate holds them all in one buffer.
SMALL_COLUMN = 500_000
# A bracket with no more values than this is read out.
READ_OUT = 4_096
SKETCH_POINTS = 1_024
SKETCH_ACCURACY = 20_000


@dataclass
class _Search:
    """The value of one rank (counted from 0) lies between ``floor`` and ``ceiling``, ends included
    at the start and excluded once counted. ``low`` and ``high`` are counted by the next scan."""

    name: str
    rank: int
    floor: float
    ceiling: float
    low: float
    high: float
    value: float | None = None
    before: int = 0
    inside: int | None = None


def exact_quantiles(
    df: DataFrame,
    numbers: dict[str, Column],
    fractions: list[float],
    small: int = SMALL_COLUMN,
    read_out: int = READ_OUT,
    counts: dict[str, int] | None = None,
) -> dict[str, tuple[int, list[float]]]:
    """{name: (count, quantiles)} with linear interpolation; columns without numbers are left out.

    ``counts`` are the numbers of non-null values, where they are known already.
    """
    if not numbers:
        return {}
    ids = {name: f"x{i}" for i, name in enumerate(numbers)}
    cells = df.select(*[numbers[name].alias(ids[name]) for name in numbers])
    first = None
    if counts is None or max(counts.values()) > small:
        first = cells.agg(
            *[F.count(x).alias(f"n_{x}") for x in ids.values()],
            *[F.min(x).alias(f"lo_{x}") for x in ids.values()],
            *[F.max(x).alias(f"hi_{x}") for x in ids.values()],
        ).first()
        counts = {name: first[f"n_{x}"] for name, x in ids.items()}
    counts = {name: n for name, n in counts.items() if n}
    out: dict[str, tuple[int, list[float]]] = {}

    light = [name for name, n in counts.items() if n <= small]
    if light:
        row = cells.agg(
            *[F.percentile(ids[n], F.array(*map(F.lit, fractions))).alias(ids[n]) for n in light]
        ).first()
        out |= {name: (counts[name], list(row[ids[name]])) for name in light}

    heavy = [name for name in counts if name not in out]
    searches: dict[tuple[str, int], _Search] = {}
    for name in heavy:
        for q in fractions:
            position = (counts[name] - 1) * q
            for rank in {math.floor(position), math.ceil(position)}:
                least, most = first[f"lo_{ids[name]}"], first[f"hi_{ids[name]}"]
                searches[name, rank] = _Search(name, rank, least, most, least, most)
    _narrow(cells, ids, list(searches.values()), read_out)
    for name in heavy:
        found = []
        for q in fractions:
            position = (counts[name] - 1) * q
            below, above = math.floor(position), math.ceil(position)
            low, high = searches[name, below].value, searches[name, above].value
            found.append(low if low == high else (above - position) * low + (position - below) * high)
        out[name] = (counts[name], found)
    return out


def exact_medians(df: DataFrame, columns: dict[str, Column], read_out: int = READ_OUT) -> dict[str, Decimal]:
    """{name: median} of columns of whole or decimal numbers, ranked and halved in their own digits.

    Nothing goes through a double, so neighbours above 2^53 stay apart; columns without values are left out.
    """
    if not columns:
        return {}
    ids = {name: f"x{i}" for i, name in enumerate(columns)}
    whole = {f.name for f in df.select(*columns.values()).schema.fields if isinstance(f.dataType, T.IntegralType)}
    wide = [c.cast("decimal(20,0)") if n in whole else c for n, c in columns.items()]
    cells = df.select(*[c.alias(x) for c, x in zip(wide, ids.values())])
    ends = cells.agg(
        *[f(x).alias(f"{n}_{x}") for x in ids.values() for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]
    ).first()
    searches: dict[tuple[str, int], _Search] = {}
    for name, x in ids.items():
        n, low, high = ends[f"n_{x}"], ends[f"lo_{x}"], ends[f"hi_{x}"]
        for rank in {(n - 1) // 2, n // 2} if n else ():
            searches[name, rank] = _Search(name, rank, low, high, low, high)
    out: dict[str, Decimal] = {}
    with localcontext(prec=60):
        _narrow(cells, ids, list(searches.values()), read_out, exact=True)
        for name in columns:
            found = [Decimal(s.value) for (owner, _), s in searches.items() if owner == name]
            if found:
                out[name] = sum(found) / len(found)
    return out


def _narrow(cells: DataFrame, ids: dict[str, str], searches: list[_Search], read_out: int, exact: bool = False) -> None:
    """Settle all searches. exact: the sketch, which counts in doubles, sees distances from the bracket's low end."""
    grid = F.array(*[F.lit(i / SKETCH_POINTS) for i in range(SKETCH_POINTS + 1)])
    open_ones = searches
    while open_ones:
        brackets = sorted({(s.name, s.low, s.high) for s in open_ones})
        aggregates = []
        for i, (name, low, high) in enumerate(brackets):
            x = F.col(ids[name])
            aggregates += [
                F.count_if(x < low).alias(f"below_{i}"),
                F.count_if(x <= low).alias(f"to_low_{i}"),
                F.count_if(x < high).alias(f"under_high_{i}"),
                F.count_if(x <= high).alias(f"to_high_{i}"),
                F.percentile_approx(
                    F.when((x > low) & (x < high), x - F.lit(low) if exact else x), grid, SKETCH_ACCURACY
                ).alias(f"grid_{i}"),
            ]
        row = cells.agg(*aggregates).first()
        for s in open_ones:
            i = brackets.index((s.name, s.low, s.high))
            points = row[f"grid_{i}"]
            if exact and points:
                points = [s.low + p for p in points]
            _settle(s, *[row[f"{k}_{i}"] for k in ("below", "to_low", "under_high", "to_high")], points)
        open_ones = [s for s in open_ones if s.value is None]
        short = [s for s in open_ones if s.inside is not None and s.inside <= read_out]
        if short:
            _read_out(cells, ids, short)
            open_ones = [s for s in open_ones if s.value is None]


def _settle(s: _Search, below: int, to_low: int, under_high: int, to_high: int, grid) -> None:
    """Fix the value, or shrink the bracket; exact counts decide, the grid only suggests."""
    s.inside = None
    if below <= s.rank < to_low:
        s.value = s.low
    elif under_high <= s.rank < to_high:
        s.value = s.high
    elif s.rank < below:
        s.ceiling = s.high = s.low
        s.low = s.floor
    elif s.rank >= to_high:
        s.floor = s.low = s.high
        s.high = s.ceiling
    else:
        s.floor, s.ceiling = s.low, s.high
        s.before, s.inside = to_low, under_high - to_low
        place = (s.rank - to_low) / s.inside * SKETCH_POINTS
        margin = 1 + SKETCH_POINTS * 2 / SKETCH_ACCURACY
        s.low = grid[max(0, math.floor(place - margin))]
        s.high = grid[min(SKETCH_POINTS, math.ceil(place + margin))]
        # a sketch of exact numbers may round out of the bracket, which would not narrow it
        low_in, high_in = s.floor < s.low < s.ceiling, s.floor < s.high < s.ceiling
        if not low_in and not high_in:
            s.low = s.high = _middle(s.floor, s.ceiling)
        elif not (low_in and high_in):
            s.low = s.high = s.low if low_in else s.high


def _middle(floor: Decimal | float, ceiling: Decimal | float) -> Decimal | float:
    """A number between two that have others between them, with no more digits than these."""
    middle = (floor + ceiling) / 2
    if isinstance(middle, Decimal):
        unit = Decimal(1).scaleb(min(floor.as_tuple().exponent, ceiling.as_tuple().exponent))
        middle = middle.quantize(unit, ROUND_FLOOR)
    return middle


def _read_out(cells: DataFrame, ids: dict[str, str], searches: list[_Search]) -> None:
    """Fetch the few values strictly inside each bracket, with their counts."""
    brackets = sorted({(s.name, s.floor, s.ceiling, s.before) for s in searches})
    parts = []
    for i, (name, floor, ceiling, _) in enumerate(brackets):
        x = F.col(ids[name])
        inside = cells.select(x.alias("x")).where((x > floor) & (x < ceiling))
        parts.append(inside.groupBy("x").agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("i"), "x", "n"))
    values: dict[int, list[tuple[float, int]]] = {}
    for row in reduce(DataFrame.union, parts).collect():
        values.setdefault(row["i"], []).append((row["x"], row["n"]))
    for s in searches:
        seen = s.before
        for x, n in sorted(values[brackets.index((s.name, s.floor, s.ceiling, s.before))]):
            if seen <= s.rank < seen + n:
                s.value = x
            seen += n
