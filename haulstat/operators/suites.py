"""Registry of scoring suites: a name and a pure function from tables to metric rows."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Suite = Callable[[object], DataFrame]
SUITES: dict[str, Suite] = {}
METRIC_COLUMNS = ["suite", "metric", "value", "ci_lo", "ci_hi", "n", "headline"]


def suite(name: str) -> Callable[[Suite], Suite]:
    """Register a suite; its frame has metric, value, ci_lo, ci_hi, n, headline."""
    def register(fn: Suite) -> Suite:
        SUITES[name] = fn
        return fn
    return register


def score(tables, names: list[str] | None = None) -> DataFrame:
    """One metrics table over the chosen suites. Scoring reads tables only, so a replay is a re-run."""
    out = None
    for name in names or sorted(SUITES):
        part = SUITES[name](tables).withColumn("suite", F.lit(name)).select(*METRIC_COLUMNS)
        out = part if out is None else out.unionByName(part)
    return out
