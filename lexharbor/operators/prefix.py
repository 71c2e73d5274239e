"""Running sums over a whole table without one task that holds it."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .saved import saved

BUCKETS = 256


def running_sum(df: DataFrame, order: str, value: str, name: str, ties: tuple[str, ...] = (), keys: tuple[str, ...] = (), buckets: int = BUCKETS, descending: bool = False) -> DataFrame:
    """Adds `name`, the sum of `value` over all earlier rows of the same keys in the order of a numeric column (then the
    ties), the row itself left out.  Rows are cut into ranges by approximate quantiles; sums within a range come from a
    window over that range, and what stands before it from a window over one row per range.  A value that fills more
    than one range stands alone and is cut again by the quantiles of the first tie, if that is a number.  The rows are
    computed once and saved."""
    df = saved(df)
    numeric = bool(ties) and isinstance(df.schema[ties[0]].dataType, T.NumericType)
    cuts = [i / buckets for i in range(1, buckets)]
    found = df.approxQuantile([order, *ties[:1]] if numeric else [order], cuts, 0.25 / buckets) if cuts else [[]]
    times = Counter(found[0])
    heavy = sorted(b for b, n in times.items() if n > 1)
    above = lambda col, bounds, strict=False: F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col(col) if strict else b <= F.col(col))) if bounds else F.lit(0)
    place = above(order, sorted(times)) + above(order, heavy, True)
    inner = F.when(F.col(order).isin(heavy), above(ties[0], sorted(set(found[1])))).otherwise(0) if numeric and heavy else F.lit(0)
    cut = df.withColumn("_r", (-place if descending else place).cast("int")).withColumn("_q", inner.cast("int"))
    totals = cut.groupBy(*keys, "_r", "_q").agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_r", "_q").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    own = Window.partitionBy(*keys, "_r", "_q").orderBy(F.desc(order) if descending else F.asc(order), *ties).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.withColumn("_own", F.coalesce(F.sum(value).over(own), F.lit(0)))
    return out.join(totals, [*keys, "_r", "_q"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_r", "_q", "_before", "_own")
