"""Athlete views over the given tables, written once for Spark and once as SQL."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# metric header -> (column expression, same expression in SQL)
METRICS: dict[str, str] = {
    "Jump Height [cm]": "l_quantity",
    "Peak Power [W]": "l_extendedprice",
    "Mean Force [N]": "l_extendedprice / l_quantity",
    "Peak Velocity [m/s]": "l_tax * 100",
    "Contraction Time [ms]": "l_discount * 100",
    "Braking RFD [N/s]": "l_extendedprice * (1 - l_discount)",
    "Landing Impulse [N s]": "l_extendedprice * (1 + l_tax)",
    "Asymmetry Index [%]": "case when l_returnflag = 'R' then null else l_quantity - 25 end",
}
METRIC_NAMES = [header.rsplit(" [", 1)[0] for header in METRICS]

_SIDE = "case l_linestatus when 'F' then 'Left' else 'Right' end"

_SPRINTS = {
    "client": "l_suppkey",
    "session_date": "cast(date_trunc('month', l_shipdate) as date)",
    "rep_ts": "l_shipdate",
    "top_speed": "l_extendedprice / l_quantity",
    "max_accel": "l_tax * 100 + 1",
    "split_5": "l_quantity / 50 + 0.9",
    "load": "round(l_discount * 100)",
    "ecc_load": "case when l_returnflag = 'R' then null else l_quantity end",
    "weight": "cast(70 + l_suppkey % 30 + l_linenumber as double)",
    "side": _SIDE,
    "set_id": "l_orderkey",
    "set_no": "l_linenumber",
    "drill_id": "l_partkey",
}
REP_ORDER = ("rep_ts", "set_id", "set_no", "drill_id")

_MEASURE_IDS = {
    "entity": "l_suppkey",
    "test_type": "l_returnflag",
    "test_ts": "l_shipdate",
    "limb": _SIDE,
}
_ORDER_IDS = _MEASURE_IDS | {"entity": "l_orderkey"}


def _projection(columns: dict[str, str]) -> list[str]:
    return [f"{expression} as {name}" for name, expression in columns.items()]


class Tables:
    """Lazy readers of one table folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def sprints(self) -> DataFrame:
        return self.table("lineitem").selectExpr(*_projection(_SPRINTS))

    @cached_property
    def tests_wide(self) -> DataFrame:
        """One row per test with bracketed metric headers."""
        metrics = [f"{expression} as `{header}`" for header, expression in METRICS.items()]
        return self.table("lineitem").selectExpr(
            "l_suppkey as Name", "l_shipdate as Date", "l_returnflag as Type", f"{_SIDE} as Tags", *metrics
        )

    @cached_property
    def measures(self) -> DataFrame:
        """Eight measured values per test, as a long table."""
        return self._measures(_MEASURE_IDS)

    @cached_property
    def measures_orders(self) -> DataFrame:
        """The same values with the order as entity: many entities, some without a value for a metric."""
        return self._measures(_ORDER_IDS)

    def _measures(self, ids: dict[str, str]) -> DataFrame:
        parts = [
            f"struct('{header.rsplit(' [', 1)[0]}' as metric, cast({expression} as double) as value)"
            for header, expression in METRICS.items()
        ]
        return self.table("lineitem").selectExpr(*_projection(ids), f"inline(array({', '.join(parts)}))")

    @cached_property
    def events(self) -> DataFrame:
        """A naturally long table with several values per timestamp and day."""
        return self.table("events").select(
            F.col("user_id").alias("entity"),
            F.col("event_type").alias("metric"),
            F.col("value"),
            F.col("ts").alias("test_ts"),
        )


def _sql_measures(ids: dict[str, str]) -> str:
    ids = ", ".join(_projection(ids))
    parts = [
        f"select {ids}, '{header.rsplit(' [', 1)[0]}' as metric, cast({expression} as double) as value from lineitem"
        for header, expression in METRICS.items()
    ]
    return " union all ".join(parts)


SQL_VIEWS: dict[str, str] = {
    "sprints": f"select {', '.join(_projection(_SPRINTS))} from lineitem",
    "measures": _sql_measures(_MEASURE_IDS),
    "measures_orders": _sql_measures(_ORDER_IDS),
    "measures_events": "select user_id as entity, event_type as metric, value, ts as test_ts from events",
}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the views it mentions."""
    used = [name for name in SQL_VIEWS if re.search(rf"\b{name}\b", sql)]
    if not used:
        return sql
    views = ", ".join(f"{name} as ({SQL_VIEWS[name]})" for name in used)
    body = sql.strip()
    if body[:5].lower() == "with ":
        return f"with {views}, {body[5:]}"
    return f"with {views} {body}"
