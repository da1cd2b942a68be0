"""Name -> query, and name -> the DuckDB statement it is compared with."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .standins import STANDINS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
RAW_TABLES = ("region nation customer supplier part orders lineitem events documents "
              "embeddings pages benchmark labels conversations").split()


class Tables:
    """Lazy access to the given tables and the domain tables derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in RAW_TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name not in STANDINS:
            raise AttributeError(name)
        sql = STANDINS[name]
        used = [t for t in [*RAW_TABLES, *STANDINS] if re.search(rf"\{{{t}\}}", sql)]
        return self.spark.sql(sql, **{t: getattr(self, t) for t in used})


def query(name: str, tables: str = "", oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame``; ``oracle`` may follow CTEs of ``tables``."""
    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if oracle is not None:
            ORACLES[name] = with_standins(tables.split(), oracle)
        return fn
    return register


def with_standins(tables: list[str], body: str) -> str:
    needed: list[str] = []

    def visit(name: str) -> None:
        for dep in STANDINS:
            if dep != name and f"{{{dep}}}" in STANDINS[name]:
                visit(dep)
        if name not in needed:
            needed.append(name)

    for t in tables:
        visit(t)
    ctes = [f"{t} AS ({re.sub(r'{(.*?)}', chr(92) + '1', STANDINS[t])})" for t in needed]
    body = body.strip()
    lead = "WITH "
    if body.startswith("WITH_RECURSIVE"):
        lead, body = "WITH RECURSIVE ", body[len("WITH_RECURSIVE"):].strip()
    plain = body.upper().startswith("SELECT")
    if not ctes:
        return body if plain else lead + body
    return lead + ", ".join(ctes) + (" " if plain else ", ") + body
