"""Detectors and repairs of a user's own.

A detector names aggregates over the cells of a column and turns their values into a finding. The aggregates join the
one scan that gathers the facts of all columns, so a further detector costs no pass over the data. A repair gives the
new cells of a column and which of them count as changed; its rank places it among the others.

    short = Detector(
        kind="short_text", dimension="validity", menu=("none", "pad_text"), advice="pad_text",
        aggregates=lambda cell, blank: {"short": F.count_if(~blank & (F.length(cell) < 3))},
        finish=lambda name, n, rows, limits: n["short"] and dict(affected_rows=int(n["short"]), title=..., detail=...),
    )
    with registered(short, pad): detect_issues(df)
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import types as T

from qualframe import model as M
from qualframe.functions import values as V


def is_text(field: T.StructField) -> bool:
    return V.kind_of(field.dataType) == V.TEXT


@dataclass(frozen=True)
class Detector:
    """``aggregates(cell, blank)`` names aggregate expressions whose values fit a double; ``finish(column, values, rows,
    thresholds)`` gives the fields of an issue (affected_rows, title, detail; severity and evidence if it likes), or
    nothing where there is no finding."""

    kind: str
    dimension: str
    menu: tuple[str, ...]
    aggregates: Callable[[Column, Column], dict[str, Column]]
    finish: Callable[[str, dict[str, float], int, M.Thresholds], dict | None]
    applies: Callable[[T.StructField], bool] = is_text
    advice: str = "none"
    reason: str = "Recommended by the detector."


@dataclass(frozen=True)
class Strategy:
    """``rewrite(cell, blank, decision)`` gives the new cell and whether it counts as changed."""

    name: str
    rank: int
    help: str
    rewrite: Callable[[Column, Column, M.Decision], tuple[Column, Column]]
    detail: Callable[[str, int], str] = lambda column, n: f"Rewrote {n} values in '{column}'."


DETECTORS: dict[str, Detector] = {}
STRATEGIES: dict[str, Strategy] = {}


def register(*items: Detector | Strategy) -> None:
    """Make detectors and repairs known to every scan, menu and plan of this process. Repairs before the detectors whose
    menus name them."""
    for item in items:
        if isinstance(item, Strategy):
            if item.name in M.RUN_RANK:
                raise ValueError(f"there is a repair '{item.name}' already")
            STRATEGIES[item.name] = item
            M.RUN_RANK[item.name], M.HELP[item.name] = item.rank, item.help
            continue
        unknown = [s for s in (*item.menu, item.advice) if s not in M.RUN_RANK]
        if item.kind in M.MENU or item.dimension not in M.DIMENSIONS or unknown:
            raise ValueError(f"'{item.kind}' is known already, has no dimension of the score, or names unknown repairs {unknown}")
        DETECTORS[item.kind] = item
        M.MENU[item.kind], M.DIMENSION[item.kind] = tuple(dict.fromkeys(("none", *item.menu))), item.dimension


def unregister(*items: Detector | Strategy) -> None:
    for item in items:
        if isinstance(item, Strategy):
            for known in (STRATEGIES, M.RUN_RANK, M.HELP):
                known.pop(item.name, None)
        else:
            for known in (DETECTORS, M.MENU, M.DIMENSION):
                known.pop(item.kind, None)


@contextmanager
def registered(*items: Detector | Strategy) -> Iterator[None]:
    register(*items)
    try:
        yield
    finally:
        unregister(*items)


def aggregates_for(field: T.StructField, cell: Column, blank: Column) -> dict[tuple[str, str], Column]:
    """{(kind, name): aggregate} of the detectors that look at a column."""
    return {
        (d.kind, name): aggregate
        for d in DETECTORS.values()
        if d.applies(field)
        for name, aggregate in d.aggregates(cell, blank).items()
    }
