"""Predicates as ranges and value sets, pruning of files by statistics, and plans told back."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Domain:
    """Allowed values of a column: ranges (low, high, low closed, high closed; None is open), single
    values, and whether null is allowed. No ranges and no values: anything but null."""

    ranges: tuple[tuple, ...] = ()
    values: tuple = ()
    null: bool = False

    def column(self, c: Column) -> Column:
        parts = []
        for low, high, with_low, with_high in self.ranges:
            p = F.lit(True)
            if low is not None:
                p = p & ((c >= F.lit(low)) if with_low else (c > F.lit(low)))
            if high is not None:
                p = p & ((c <= F.lit(high)) if with_high else (c < F.lit(high)))
            parts.append(p)
        if self.values:
            parts.append(c.isin(*self.values))
        if not parts:
            parts.append(c.isNotNull())
        if self.null:
            parts.append(c.isNull())
        return reduce(Column.__or__, parts)

    def bounds(self) -> list[tuple]:
        return [(a, b) for a, b, _, _ in self.ranges] + [(v, v) for v in self.values]


@dataclass(frozen=True)
class Request:
    """What an engine asks for: columns, domains by column, order (column, descending, nulls first), limit."""

    columns: tuple[str, ...] = ()
    domains: dict[str, Domain] = field(default_factory=dict)
    order: tuple[tuple[str, bool, bool], ...] = ()
    limit: int | None = None


def resolve(columns: list[str], name: str) -> str:
    """The column of that name, whatever its case; more than one is an error."""
    found = [c for c in columns if c.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"{'ambiguous' if found else 'no'} column {name!r}")
    return found[0]


def scan(df: DataFrame, request: Request) -> DataFrame:
    """The rows asked for. Catalyst pushes the filter and the columns into the Parquet scan."""
    out = df
    for name, domain in request.domains.items():
        out = out.where(domain.column(F.col(resolve(df.columns, name))))
    if request.order:
        keys = []
        for name, descending, first in request.order:
            c = F.col(resolve(df.columns, name))
            keys.append((c.desc_nulls_first() if first else c.desc_nulls_last()) if descending else (c.asc_nulls_first() if first else c.asc_nulls_last()))
        out = out.orderBy(*keys)
    if request.limit is not None:
        out = out.limit(request.limit)
    return out.select(*[resolve(df.columns, c) for c in request.columns]) if request.columns else out


def pruned(files: DataFrame, domains: dict[str, Domain]) -> DataFrame:
    """Files whose bounds allow a match.

    files has lower_{column}, upper_{column} and nulls_{column} where such statistics exist; a column
    without them prunes nothing, nor does a file whose bounds are null (they may be unstated)."""
    out = files
    for name, domain in domains.items():
        if f"lower_{name}" not in files.columns:
            continue
        low, high = F.col(f"lower_{name}"), F.col(f"upper_{name}")
        may = low.isNull() | high.isNull()
        for a, b, with_a, with_b in [*domain.ranges, *((v, v, True, True) for v in domain.values)]:
            p = F.lit(True)
            if a is not None:
                p = p & (high >= F.lit(a) if with_a else high > F.lit(a))
            if b is not None:
                p = p & (low <= F.lit(b) if with_b else low < F.lit(b))
            may = may | p
        if not domain.bounds():
            may = F.lit(True)
        if domain.null:
            may = may | (F.col(f"nulls_{name}") > 0) if f"nulls_{name}" in files.columns else F.lit(True)
        out = out.where(may)
    return out


SPLIT_BYTES, OPEN_COST, LOOKBACK = 128 << 20, 4 << 20, 10


def splits(files: list[tuple[str, int]], most: int = SPLIT_BYTES, open_cost: int = OPEN_COST, lookback: int = LOOKBACK) -> list[list[str]]:
    """Files (path, bytes), by path, packed into splits of up to most bytes; at most lookback stay open."""
    done, bins = [], []
    for path, size in sorted(files):
        weight = max(size, open_cost)
        place = next((b for b in bins if b[0] + weight <= most), None)
        if place is None:
            bins.append(place := [0, []])
            if len(bins) > lookback:
                full = max(bins, key=lambda b: b[0])
                bins.remove(full)
                done.append(full[1])
        place[0] += weight
        place[1].append(path)
    return done + [b[1] for b in bins if b[1]]


def profile(df: DataFrame) -> list[dict]:
    """For each Parquet scan of df's plan: pushed filters, columns read, and once it has run, files and rows."""
    df._jdf.queryExecution().toRdd().count()  # runs this very plan; no row reaches the driver
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if name == "FileSourceScanExec":
            metrics = node.metrics()
            value = lambda k: metrics.apply(k).value() if metrics.contains(k) else None  # noqa: E731, B023
            text = node.metadata().apply("PushedFilters")
            found.append({
                "columns": re.findall(r"(\w+):", node.metadata().apply("ReadSchema")), "pushed": text.strip("[]").split(", ") if text != "[]" else [],
                "files": value("numFiles"), "rows": value("numOutputRows"), "ms": value("scanTime"),
            })
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found
