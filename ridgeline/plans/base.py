"""Query registration and the SQL that many oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

CY, CX = 30.722, 29.8


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


#: The fixture DEM and what is derived from it, as SQL for a `with` clause.
DEM = """
w as (select cast(floor(sqrt(count(*))) as bigint) as w from events),
dem as (select event_id // w as r, event_id % w as c,
    case when event_id % 499 = 7 then null
         else cast(2000 + floor((abs(2*(event_id % w) - w)//2) * (abs(2*(event_id % w) - w)//2) * 20.0 / w)
              + 3*abs((event_id // w) % 40 - 20) + floor(value/50) as double) end as z
  from events, w where event_id < w*w)"""

GRAD = DEM + f""",
near as (select r, c, z, w, lag(z) over v as zn, lead(z) over v as zs, lag(z) over h as zw, lead(z) over h as ze
  from dem, w window v as (partition by c order by r), h as (partition by r order by c)),
grad as (select r, c, z,
    case when r = 0 then (zs - z) / {CY} when r = w - 1 then (z - zn) / {CY} else (zs - zn) / (2 * {CY}) end as dzdy,
    case when c = 0 then (ze - z) / {CX} when c = w - 1 then (z - zw) / {CX} else (ze - zw) / (2 * {CX}) end as dzdx
  from near),
ground as (select r, c, z, dzdy, dzdx, degrees(atan(sqrt(dzdy*dzdy + dzdx*dzdx))) as slope,
    ((degrees(atan2(-dzdx, dzdy)) % 360) + 360) % 360 as aspect from grad)"""


def cand(stride: int = 5, tile: int = 32, lo: float = 12, hi: float = 60) -> str:
    return GRAD + f""",
cand as (select r, c, z as z0, aspect, r * w.w + c as cand_id from (
  select *, row_number() over (partition by r // {tile}, c // {tile} order by r, c) - 1 as k
  from ground where slope >= {lo} and slope <= {hi}), w where k % {stride} = 0)"""


CAND = cand()
