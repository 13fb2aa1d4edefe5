"""Registry of runnable queries, each with the SQL that states the same result independently."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.plans.fixtures import Tables

Build = Callable[[Tables], DataFrame]


@dataclass(frozen=True)
class Entry:
    build: Build
    sql: str | None


REGISTRY: dict[str, Entry] = {}
CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    if name in CTES:
        raise ValueError(f"CTE {name} is defined twice")
    CTES[name] = body


def with_ctes(body: str) -> str:
    """Prefix ``body`` with the shared CTEs it needs, in dependency order."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in ordered and re.search(rf"\b{name}\b", text):
                visit_cte(name)

    def visit_cte(name: str) -> None:
        visit(re.sub(rf"\b{name}\b", "", CTES[name]))
        if name not in ordered:
            ordered.append(name)

    visit(body)
    if not ordered:
        return body
    parts = ",\n".join(f"{name} AS MATERIALIZED (\n{CTES[name]}\n)" for name in ordered)
    head = body.lstrip()
    if head.upper().startswith("WITH "):
        return f"WITH {parts},\n{head[5:]}"
    return f"WITH {parts}\n{head}"


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def register(build: Build) -> Build:
        if name in REGISTRY:
            raise ValueError(f"query {name} is defined twice")
        REGISTRY[name] = Entry(build, sql)
        return build

    return register


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    entry = REGISTRY[name]
    return lambda spark, folder: entry.build(Tables(spark, folder))


# --- output helpers -----------------------------------------------------------


def r6(column: Column | str, name: str | None = None) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, 6).alias(name or column)


def big(column: Column | str, name: str | None = None) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c.cast("bigint").alias(name or column)


def stamp(column: Column | str, name: str | None = None) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name or column)


def q6(expr: str) -> str:
    return f"(round({expr}, 6) + 0.0)"


def qstamp(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


# Means of short decimals over few games often end exactly in a 5 at the seventh
# decimal, where a last-bit difference would flip the sixth. Both sides are nudged.


def off_tie(column: Column | str, name: str | None = None) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c + F.lit(1e-9), 6).alias(name or column)


def q_off_tie(expr: str) -> str:
    return f"(round(({expr}) + 1e-9::DOUBLE, 6) + 0.0)"
