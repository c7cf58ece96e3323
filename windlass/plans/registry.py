"""Registry of named queries: a Spark builder plus (where SQL can say it) an oracle SQL text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from windlass.sources.standins import with_views


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    operators: str


QUERIES: dict[str, Query] = {}


def query(name: str, operators: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its oracle SQL."""

    def deco(fn):
        QUERIES[name] = Query(name, fn, with_views(sql, *views) if sql is not None else None, operators)
        return fn

    return deco


# ---- SQL text helpers for the oracle side ------------------------------------------------------
DIGITS = 6


def R(expr: str, digits: int = DIGITS) -> str:
    """DuckDB spelling of ``round_half_even``: round_even(x * 10^d, 0) / 10^d -- the same
    double operations, so equal inputs give bit-equal results."""
    f = f"{float(10 ** digits)!r}e0" if "e" not in repr(float(10 ** digits)) else repr(float(10 ** digits))
    return f"(round_even(({expr}) * {f}, 0) / {f} + 0e0)"


def circ_sql(col: str) -> str:
    d = f"degrees(atan2(avg(sin(radians({col}))), avg(cos(radians({col})))))"
    return f"(CASE WHEN {d} < 0 THEN {d} + 360 ELSE {d} END)"


def pmod360_sql(x: str) -> str:
    """Spark ``pmod(x, 360)`` for doubles: the remainder, shifted only when negative."""
    r = f"(({x}) % 360e0)"
    return f"(CASE WHEN {r} < 0 THEN ({r} + 360e0) % 360e0 ELSE {r} END)"


def sector_sql(x: str) -> str:
    d = pmod360_sql(x)
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN {d} >= 315 OR {d} < 45 THEN 'N' WHEN {d} < 135 THEN 'E' "
            f"WHEN {d} < 225 THEN 'S' ELSE 'W' END)")


def blend_colour_sql(x: str) -> str:
    """DuckDB spelling of ``direction_blend_colour`` (same expression tree, same float order)."""
    from windlass.functions.scalar import CARDINAL_RGB
    d = pmod360_sql(x)
    dists = [f"least(abs({float(a)}e0 - {d}), 360e0 - abs({float(a)}e0 - {d}))" for a, _ in CARDINAL_RGB]
    m = f"least({', '.join(dists)})"
    w = f"(0.1e0 + (1e0 - {m} / 45e0) * 0.9e0)"
    chans = []
    for ch in range(3):
        case = "CASE " + " ".join(f"WHEN {dists[i]} = {m} THEN {CARDINAL_RGB[i][1][ch]}e0"
                                  for i in range(3)) + f" ELSE {CARDINAL_RGB[3][1][ch]}e0 END"
        chans.append(f"CAST(floor(({w} * ({case}) + (1e0 - {w})) * 255e0) AS INTEGER)")
    return (f"(CASE WHEN {x} IS NULL OR {m} = 45 THEN '#ffffff' "
            f"ELSE printf('#%02x%02x%02x', {', '.join(chans)}) END)")


def palette_sql(x: str, stops) -> str:
    """DuckDB spelling of ``palette_mix`` for a position ``x`` that is null or a number."""
    rgb = [[int(s[i:i + 2], 16) for i in (1, 3, 5)] for s in stops]
    p = f"(greatest(0e0, least(1e0, {x})) * {len(rgb) - 1}e0)"
    at = f"CAST(least(floor({p}), {len(rgb) - 2}) AS INTEGER)"
    chans = []
    for ch in range(3):
        arr = "[" + ", ".join(f"{c[ch]}e0" for c in rgb) + "]"
        low, high = f"({arr})[{at} + 1]", f"({arr})[{at} + 2]"
        chans.append(f"CAST(round_even({low} + ({p} - {at}) * ({high} - {low}), 0) AS INTEGER)")
    return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE printf('#%02x%02x%02x', {', '.join(chans)}) END)"


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str, radius: float = 6371.0) -> str:
    """DuckDB spelling of ``haversine_km`` (same expression order)."""
    a = (f"pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * "
         f"pow(sin((radians({lon2}) - radians({lon1})) / 2), 2)")
    return f"({2 * radius}e0 * asin(sqrt(least(1.0e0, {a}))))"


def hash_sql(key: str, seed: int = 42) -> str:
    return f"md5(concat(CAST({key} AS VARCHAR), ':{seed}'))"


def bucket_sql(key: str, seed: int = 42, buckets: int = 100) -> str:
    return f"(CAST(('0x' || substr({hash_sql(key, seed)}, 1, 6)) AS BIGINT) % {buckets})"
