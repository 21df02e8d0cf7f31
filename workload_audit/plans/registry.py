"""Check registry: ``@check(category, name)`` registers a DataFrame builder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..config import AuditConfig
from ..sources.logs import LogTables

CheckFn = Callable[[LogTables, AuditConfig], DataFrame]


@dataclass(frozen=True)
class Bullet:
    """A check's line in the key findings.

    ``text`` is shown when rows were found, ``quiet`` (if any) when none were. ``{rows}`` stands for their number - of those with
    ``label`` in ``column``, where these are given -, ``{first.c}`` for column ``c`` of the first one, ``{cfg.p}`` for a parameter.
    """

    text: str
    quiet: str | None = None
    column: str | None = None
    label: str | None = None


@dataclass(frozen=True)
class CheckSpec:
    category: str
    name: str
    fn: CheckFn
    description: str
    # Input tables the check reads.
    needs: tuple[str, ...]
    # True when the check ranks or sums query patterns, which a rollup holds.
    uses_patterns: bool
    # Result columns that stand for the check in a one-line report.
    headline: tuple[str, ...] = ()
    # What a reader can do with the check's figures.
    advice: str = ""
    # The check's line in the key findings, if it has one.
    bullet: Bullet | None = None

    @property
    def key(self) -> str:
        return f"{self.category}/{self.name}"


REGISTRY: dict[tuple[str, str], CheckSpec] = {}


def check(
    category: str,
    name: str,
    *,
    needs: tuple[str, ...] = ("query_log",),
    uses_patterns: bool = True,
    headline: tuple[str, ...] = (),
    advice: str = "",
    bullet: Bullet | None = None,
):
    """Register ``fn(tables, cfg) -> DataFrame`` as check ``category/name``;
    its description is the first line of its docstring."""

    def deco(fn: CheckFn) -> CheckFn:
        REGISTRY[(category, name)] = CheckSpec(
            category=category,
            name=name,
            fn=fn,
            description=(fn.__doc__ or "").strip().split("\n")[0].rstrip("."),
            needs=needs,
            uses_patterns=uses_patterns,
            headline=headline,
            advice=advice,
            bullet=bullet,
        )
        return fn

    return deco


def load_checks() -> None:
    """Import the operator modules so their ``@check`` decorators run."""
    from ..operators import anomalies, anti_patterns, cluster_health, cost_attribution, top_n  # noqa: F401


def select_checks(only_categories: tuple[str, ...] | None = None) -> list[CheckSpec]:
    """Registered checks in (category, name) order, optionally filtered by
    category before any DataFrame is built (S8). Unknown categories select
    nothing."""
    load_checks()
    specs = [REGISTRY[k] for k in sorted(REGISTRY)]
    if only_categories is not None:
        wanted = set(only_categories)
        specs = [s for s in specs if s.category in wanted]
    return specs


def spec_of(category: str, name: str) -> CheckSpec | None:
    load_checks()
    return REGISTRY.get((category, name))


def catalogue() -> list[tuple[str, str, str]]:
    """(category, name, description) for every check, sorted."""
    return [(s.category, s.name, s.description) for s in select_checks()]
