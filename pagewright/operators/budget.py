"""Resource budgets as columns.

A charge to a dimension also charges the total; a charge that would pass a
limit is refused and changes nothing.  What an operation will cost is known in
closed form, so costs are laid out as rows in order and running sums say where a
limit is passed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Default limits.
LIMITS = {
    "input_bytes": 256 << 20,
    "single_read_bytes": 16 << 20,
    "total_read_bytes": 512 << 20,
    "allocation_bytes": 256 << 20,
    "decoded_value_bytes": 16 << 20,
    "decoded_bytes": 256 << 20,
    "encoded_bytes": 256 << 20,
    "items": 10_000_000,
    "page_visits": 10_000_000,
    "depth": 4096,
    "work": 1_000_000_000,
}


def running_totals(charges: DataFrame, *keys: str, order: str = "step", amount: str = "amount", limit: int | None = None) -> DataFrame:
    """charges with spent (the running total) and, given a limit, error_code from the first charge that passes it."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = charges.withColumn("spent", F.sum(amount).over(upto))
    return out if limit is None else out.withColumn("error_code", F.when(F.col("spent") > limit, "limit_exceeded"))


def scan_cost(page_count: Column, page_size: int) -> dict[str, Column]:
    """Exact cost of a whole scan: bytes, visits, and their sum as work."""
    return {"bytes": page_count * page_size, "page_visits": page_count, "work": page_count * page_size + page_count}


def preflight(images: DataFrame, costs: dict[str, Column], limits: dict[str, int]) -> DataFrame:
    """images with error_code: the first dimension whose cost passes its limit."""
    code = F.lit(None).cast("string")
    for name in reversed(list(costs)):
        if name in limits:
            code = F.when(costs[name] > limits[name], f"{name}_limit_exceeded").otherwise(code)
    return images.withColumn("error_code", code)


def enforced(df: DataFrame, code: str = "error_code") -> DataFrame:
    """df, failing the query at the first row that has a code: only for callers that ask for it."""
    return df.withColumn(code, F.when(F.col(code).isNotNull(), F.raise_error(F.col(code)).cast("string")))


def observed(df: DataFrame, name: str, **counters: Column) -> DataFrame:
    """df with counters that Spark reports when an action ends."""
    return df.observe(name, *[v.alias(k) for k, v in counters.items()])
