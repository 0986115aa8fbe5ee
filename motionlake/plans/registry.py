"""Named queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import Tables, with_views

# Answers are compared on a grid of 10^-digits.  The grid's edges sit off the short decimals, where means of
# prices often fall and where the last bit of a sum would decide the rounding.
_PHASE = 0.3217


@dataclass
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None = None
    digits: dict[str, int] = field(default_factory=dict)

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.build(Tables(spark, folder))
        return df.withColumns(
            {c: F.floor(F.col(f"`{c}`") * 10.0**d + _PHASE).cast("double") / 10.0**d for c, d in self.digits.items()}
        )

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        if not self.digits:
            return with_views(self.sql)
        fixed = ", ".join(
            f'floor("{c}" * 1e{d} + {_PHASE}::double) / 1e{d} as "{c}"' for c, d in self.digits.items()
        )
        return f"select * replace ({fixed}) from ({with_views(self.sql)}) as answer"


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, **digits: int):
    """Register ``build(tables)``; ``digits`` gives the decimals on which both sides are compared."""

    def add(build: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, build, sql, digits)
        return build

    return add
