"""The register of queries and the SQL fragments they share."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Runner
    oracle: str | None


_ENTRIES: dict[str, Entry] = {}
_SECTIONS = ("reads", "files", "reports", "checks", "texts", "charts", "arrivals")


def query(name: str, oracle: str | None = None) -> Callable[[Runner], Runner]:
    def add(run: Runner) -> Runner:
        if name in _ENTRIES:
            raise ValueError(f"{name} is registered twice")
        _ENTRIES[name] = Entry(run, oracle)
        return run

    return add


def _load() -> dict[str, Entry]:
    for section in _SECTIONS:
        importlib.import_module(f"tillmark.registered.{section}")
    return _ENTRIES


def runners() -> dict[str, Runner]:
    return {name: entry.run for name, entry in _load().items()}


def oracles() -> dict[str, str]:
    return {name: entry.oracle for name, entry in _load().items() if entry.oracle is not None}


# --- shared SQL -------------------------------------------------------------------------------------

_RECORD_INDEX = (
    "cast(row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity,"
    " l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1 as int) source_record_index,"
)


def movement_cte(indexed: bool = False) -> str:
    """CTE ``mv``: lineitem as movements, as the test views define them."""
    return f"""
l as (select *, cast(cast(l_extendedprice as decimal(15,2))*100 as bigint) c, cast(l_quantity as bigint) q from lineitem),
mv as (select cast(l_suppkey as varchar) parse_attempt_id, l_suppkey attempt_key, {_RECORD_INDEX if indexed else ''}
 case when l_returnflag='R' then 'IN' when l_returnflag='A' and l_linestatus='F' then 'UNKNOWN' else 'OUT' end direction,
 cast(l_partkey as varchar) external_product_id, cast(l_orderkey as varchar) external_sale_id,
 l_orderkey sale_key, l_partkey product_key, l_linenumber line_number, o_orderdate occurred_at,
 cast(q as decimal(19,6)) quantity,
 cast(cast(((2*c+q)//(2*q)) as decimal(15,0))*cast(0.01 as decimal(3,2)) as decimal(19,2)) unit_price,
 cast(cast(l_discount as decimal(4,2))*100 as decimal(19,6)) discount_percentage,
 cast(round(cast(l_extendedprice as decimal(15,2))*(cast(1 as decimal(4,2))-cast(l_discount as decimal(4,2))),2) as decimal(19,2)) total,
 cast(1000-10*l_linenumber as decimal(19,6)) previous_stock,
 cast(1000-10*l_linenumber-q-case when l_linenumber=7 then 1 else 0 end as decimal(19,6)) resulting_stock
 from l join orders on l_orderkey=o_orderkey)"""


PUB = """
pub as (select 'raw-'||s_suppkey raw_artifact_id, cast(s_suppkey as varchar) parse_attempt_id from supplier where s_acctbal >= 0)"""

SALE = """
sale as (select cast(o_orderkey as varchar) id, cast(o_orderkey as varchar) external_sale_id,
 case when o_orderstatus <> 'P' then o_orderdate end occurred_at from orders)"""

PRODUCT = """
product as (select cast(p_partkey as varchar) id, cast(p_partkey as varchar) external_id, p_name as name from part)"""


def visible(indexed: bool = False) -> str:
    """CTEs ``mv``, ``pub``, ``sale``, ``product`` and ``vis``, the items of published attempts."""
    return f"""{movement_cte(indexed)},{PUB},{SALE},{PRODUCT},
vis as (select external_sale_id sale_id, external_product_id product_id, * from mv
 where direction='OUT' and parse_attempt_id in (select parse_attempt_id from pub))"""


def stripped(expression: str) -> str:
    text = f"cast({expression} as varchar)"
    return f"case when contains({text}, '.') then rtrim(rtrim({text}, '0'), '.') else {text} end"


def iso(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%dT%H:%M:%S')"
