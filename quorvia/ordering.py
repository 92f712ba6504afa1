"""Running sums over a global order, without a window that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET_ROWS, MOST_BUCKETS, DRAWN = 100_000, 1_024, 32


def range_of(df: DataFrame, order_by: list[str], count: int, bucket_rows: int = BUCKET_ROWS) -> Column:
    """The number of a row's range, at bounds from a bounded sample; equal rows share one."""
    key = F.struct(*order_by)
    buckets = min(MOST_BUCKETS, -(-count // bucket_rows)) or 1
    bounds: list = []
    if buckets > 1:
        drawn = df.select(key.alias("k")).distinct().orderBy(F.xxhash64("k")).limit(DRAWN * buckets).orderBy("k").collect()
        step = max(1, len(drawn) // buckets)
        kinds = [df.schema[c].dataType for c in order_by]
        bounds = [F.struct(*(F.lit(v).cast(t).alias(c) for v, t, c in zip(r["k"], kinds, order_by))) for r in drawn[step::step]]

    def search(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < bounds[mid], search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(bounds))


def running_sum(df: DataFrame, order_by: list[str], value: str, out: str, *, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows up to each in ascending order (nulls
    first, equal rows together in the order they come).

    The order is cut into ranges of about ``bucket_rows`` rows at bounds drawn from a bounded sample, the
    rows of smallest hash; sums of the ranges, at most ``MOST_BUCKETS`` numbers, are broadcast, and each
    range is a window of its own.
    """
    rows = df.withColumn("_range", range_of(df, order_by, df.count(), bucket_rows))
    sums = rows.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = sums.select("_range", F.coalesce(F.sum("_sum").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.sum(value).over(W.partitionBy("_range").orderBy(*order_by).rowsBetween(W.unboundedPreceding, 0))
    joined = rows.withColumn(out, within).join(F.broadcast(before), "_range")
    return joined.withColumn(out, F.col(out) + F.col("_before")).drop("_range", "_before")
