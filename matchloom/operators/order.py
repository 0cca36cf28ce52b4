"""Running sums and ordinals in the order of a number, without putting all rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that the order is cut into; their totals are the only rows that one task orders alone.
RANGES = 64


def running(rows: DataFrame, by: str, *sums: str, descending: bool = False) -> DataFrame:
    """``rows`` with ``before_<c>`` for each of ``sums``: the sum of c over the rows that come earlier in the order of
    ``by`` (nulls last). Equal values of ``by`` are in the order of no one, so they should be aggregated first.

    Cut points come from an approximate quantile (literals, so every task agrees on them); each range is summed, the
    ranges' totals are added up, and only rows of one range are ordered together."""
    order = -F.col(by).cast("double") if descending else F.col(by).cast("double")
    cuts = sorted(set(rows.agg(F.percentile_approx(order, [k / RANGES for k in range(1, RANGES)], 1_000).alias("q")).first().q or []))
    place = F.lit(0) if not cuts else F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < order))
    dealt = rows.withColumns({"range_": F.when(order.isNull(), RANGES).otherwise(place), "order_": order})
    totals = dealt.groupBy("range_").agg(*[F.sum(c).alias(f"all_{c}") for c in sums])
    upto = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # RANGES + 1 rows at most
    starts = totals.select("range_", *[F.coalesce(F.sum(f"all_{c}").over(upto), F.lit(0)).alias(f"start_{c}") for c in sums])
    within = Window.partitionBy("range_").orderBy("order_").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumns({f"own_{c}": F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sums}).join(F.broadcast(starts), "range_")
    return placed.select(*rows.columns, *[(F.col(f"start_{c}") + F.col(f"own_{c}")).alias(f"before_{c}") for c in sums])


def with_ordinals(rows: DataFrame, by: str, name: str = "ordinal") -> DataFrame:
    """``rows`` numbered from 0 in the order of a stable numeric key: a fallback id that is the same in every run."""
    return running(rows.withColumn("one_", F.lit(1).cast("long")), by, "one_").withColumnRenamed("before_one_", name).drop("one_")
