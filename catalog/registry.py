"""The list of queries: a Spark plan and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import sql
from catalog.views import Tables

Plan = Callable[[Tables], DataFrame]


@dataclass(frozen=True)
class Entry:
    plan: Plan
    select: str | None
    digits: dict[str, int]

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.plan(Tables(spark, folder))
        def rounded(column: str, digits: int):
            nudge = F.lit(float(f"{sql.NUDGE}e-{digits + 2}"))
            return F.round(F.col(f"`{column}`") + nudge, digits)

        return df.withColumns({c: rounded(c, digits) for c, digits in self.digits.items()})

    def check(self) -> str | None:
        if self.select is None:
            return None
        return sql.with_blocks(sql.rounded(self.select, self.digits))


ENTRIES: dict[str, Entry] = {}


def entry(
    name: str, select: str | None, doubles: Sequence[str] | str = (), digits: int = 6
) -> Callable[[Plan], Plan]:
    """Register the decorated plan; ``doubles`` are rounded on both sides, so that the comparison holds.

    ``name@12`` gives one column digits of its own: keys must not lose what tells them apart.
    """
    if isinstance(doubles, str):
        doubles = doubles.split()
    own = {c.partition("@")[0]: int(c.partition("@")[2] or digits) for c in doubles}

    def register(plan: Plan) -> Plan:
        if name in ENTRIES:
            raise ValueError(f"{name} is registered twice")
        ENTRIES[name] = Entry(plan, select, own)
        return plan

    return register
