"""The registry of queries and their DuckDB forms, and what both share.

Values are compared on a grid of 1e-6 (1e-4 for larger ones) by floor(x * s + 0.5) / s,
the same IEEE operations in both engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from numfold.sources.tables import HEIGHT, WIDTH

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def q(x: Column, digits: int = 6) -> Column:
    s = float(10**digits)
    return F.floor(x * s + 0.5) / s


def sq(x: str, digits: int = 6) -> str:
    return f"floor(({x})*1e{digits}+0.5)/1e{digits}"


V_SQL = "v AS (SELECT vec_id, t.i::INT AS pos, embedding[t.i+1]::DOUBLE AS a, embedding[64-t.i]::DOUBLE AS b FROM embeddings, range(64) t(i))"
M_SQL = "m AS (SELECT vec_id, (t.i % 8)::INT AS i, (t.i // 8)::INT AS j, embedding[t.i+1]::DOUBLE AS v FROM embeddings, range(64) t(i))"
S_SQL = "s AS (SELECT vec_id, " + ", ".join(f"embedding[{k + 1}]::DOUBLE AS e{k}" for k in range(9)) + " FROM embeddings)"
IMG_SQL = f"""img AS (SELECT g.img, g.r, g.c, coalesce(p.v, 0::DOUBLE) AS v FROM (SELECT DISTINCT event_type AS img, r.i::INT AS r, c.i::INT AS c FROM events, range({HEIGHT}) r(i), range({WIDTH}) c(i)) g
 LEFT JOIN (SELECT event_type AS img, (day(ts)-1)::INT AS r, hour(ts)::INT AS c, sum(floor(value))::DOUBLE AS v FROM events GROUP BY ALL) p USING (img, r, c))"""
