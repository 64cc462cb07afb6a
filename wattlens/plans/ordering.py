"""Ranks and running totals over whole tables without a one-task window.

All start from a range-partitioned sort that is staged with a row position (partition number and
offset inside it). Only one small row per sort partition is then needed to turn local positions into global ones.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wattlens.plans.joins import lookup_join
from wattlens.plans.staging import stage

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the partition number above these bits


def _staged_in_order(df: DataFrame, order: list) -> DataFrame:
    position = F.monotonically_increasing_id()
    staged = stage(df.orderBy(*order).withColumn("_pos", position), "ordered")
    return staged.withColumn("_part", F.shiftright("_pos", _LOCAL_BITS))


def _before(per_part: DataFrame, columns: list[str]) -> DataFrame:
    """Totals of all earlier partitions; one row per sort partition, so the window is tiny."""
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select("_part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before_{c}")
                                      for c in columns])


def global_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Add 1..n over a total order. `order` must end in a unique key so that the result is repeatable."""
    staged = _staged_in_order(df, order)
    sizes = staged.groupBy("_part").agg(F.count("*").alias("n"))
    offsets = F.broadcast(_before(sizes, ["n"]))  # as many rows as shuffle partitions
    local = F.col("_pos") - F.shiftleft(F.col("_part"), _LOCAL_BITS)
    return (staged.join(offsets, "_part")
            .withColumn(name, (F.col("_before_n") + local + 1).cast("long"))
            .drop("_part", "_pos", "_before_n"))


def running_totals(df: DataFrame, order: list, totals: dict[str, str]) -> DataFrame:
    """Add inclusive running sums {new column: summed column} over a total order of the whole table."""
    staged = _staged_in_order(df, order)
    sums = staged.groupBy("_part").agg(*[F.sum(c).alias(f"{n}") for n, c in totals.items()])
    offsets = F.broadcast(_before(sums, list(totals)))
    inside = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    out = staged.join(offsets, "_part")
    for new, source in totals.items():
        out = out.withColumn(new, F.sum(source).over(inside) + F.col(f"_before_{new}"))
    return out.drop("_part", "_pos", *[f"_before_{n}" for n in totals])


def group_rank(df: DataFrame, groups: list[str], order: list, name: str = "rank") -> DataFrame:
    """Row number inside each group, safe when one group holds a large share of the rows."""
    ranked = global_rank(df, [*groups, *order], "_global")
    starts = ranked.groupBy(*groups).agg(F.min("_global").alias("_start"))
    joined = lookup_join(ranked, starts, groups, spread=["_global"], null_safe=True)
    return joined.withColumn(name, F.col("_global") - F.col("_start") + 1).drop("_global", "_start")
