"""Values at given ranks, exactly, without sorting the table.

A sketch of each group's values (built on the map side, a few kilobytes per group) brackets the wanted ranks. A second
pass counts what lies below a bracket and keeps only the values inside it, equal ones as one counted row: about
a thousandth of a large group. Their running counts then name the values at the ranks. Groups of up to `SMALL_GROUP` rows
are kept whole, because a bracket would save nothing. If a sketch ever missed a rank, all values are kept instead.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattlens.plans.joins import lookup_join
from wattlens.plans.ordering import running_totals
from wattlens.plans.staging import stage

ACCURACY = 10_000  # a sketch's ranks are right to a share of 1 / ACCURACY of its group
SLACK = 3 / ACCURACY
SMALL_GROUP = 20_000
WINDOW_ROWS = 1_000_000  # kept rows up to which one window task per group and bracket ranks them


def brackets(df: DataFrame, groups: list[str], value: str, shares: list[float]) -> DataFrame:
    """Stored: n, and the values `lo_j`, `hi_j` around each share, per group; null for small groups."""
    edges = [e for s in shares for e in (max(0.0, s - SLACK), min(1.0, s + SLACK))]
    found = df.groupBy(*groups).agg(F.count("*").alias("n"), F.percentile_approx(value, edges, ACCURACY).alias("at"))
    large = F.col("n") > SMALL_GROUP
    ends = [F.when(large, F.get("at", F.lit(i))).alias(f"{'hi' if i % 2 else 'lo'}_{i // 2}") for i in range(len(edges))]
    return stage(found.select(*groups, "n", *ends), "brackets")


def kept_counts(df: DataFrame, groups: list[str], value: str, bounds: DataFrame, shares: int, tie: str | None) -> DataFrame:
    """Stored: (groups, n, j, v, [tie], rows): values inside bracket j, and one row without a value for all below it."""
    names = ["n", *[f"{e}_{j}" for j in range(shares) for e in ("lo", "hi")]]
    narrow = df.select(*groups, F.col(value).alias("v"), *([F.col(tie).alias("tie")] if tie else []))
    if groups:
        placed = lookup_join(narrow, bounds, groups, spread=["v"], null_safe=True, stored=True)
    else:
        limits = bounds.select(F.struct(*names).alias("b")).scalar()
        placed = narrow.withColumns({c: limits[c] for c in names})
    v, by_tie = F.col("v"), ["tie"] if tie else []

    def cell(j: int) -> Column:
        lo, hi = F.col(f"lo_{j}"), F.col(f"hi_{j}")
        inside = lo.isNull() | (v >= lo)
        parts = [F.lit(j).alias("j"), F.when(inside, v).alias("v"), *[F.when(inside, F.col(t)).alias(t) for t in by_tie]]
        return F.when(hi.isNull() | (v <= hi), F.struct(*parts))

    cells = placed.select(*groups, "n", F.explode(F.array(*[cell(j) for j in range(shares)])).alias("c")).filter(F.col("c").isNotNull())
    return stage(cells.groupBy(*groups, "n", "c.j", "c.v", *[f"c.{t}" for t in by_tie]).agg(F.count("*").alias("rows")), "kept")


def through_counts(kept: DataFrame, groups: list[str], by_tie: list[str]) -> DataFrame:
    """Kept rows with the number of rows of their group up to them, `through`."""
    if kept.count() <= WINDOW_ROWS:  # of a stored table
        along = Window.partitionBy(*groups, "j").orderBy("v", *by_tie).rowsBetween(Window.unboundedPreceding, 0)
        return kept.withColumn("through", F.sum("rows").over(along))
    total = running_totals(kept, [*groups, "j", "v", *by_tie], {"_to": "rows"})
    starts = total.groupBy(*groups, "j").agg(F.min(F.col("_to") - F.col("rows")).alias("_start"))
    placed = lookup_join(total, starts, [*groups, "j"], spread=["v"], null_safe=True)
    return placed.withColumn("through", F.col("_to") - F.col("_start")).drop("_to", "_start")


def at_ranks(df: DataFrame, groups: list[str], value: str, shares: list[float], ranks: list[tuple[int, Column]],
             tie: str | None = None) -> DataFrame:
    """(groups, n, rank number r, v, [tie]): what stands at each rank of its group, from 1, by `value` and then `tie`.

    `ranks` are pairs of the share that a rank lies at and an expression of `n`, the group's rows with a value. Rows without a
    value don't count; groups without any give no rows. Without `tie`, equal values need no order.
    """
    df = df.filter(F.col(value).isNotNull())
    bounds, by_tie = brackets(df, groups, value, shares), ["tie"] if tie else []
    wanted = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(j).alias("of"), rank.cast("long").alias("rank"))
                                 for r, (j, rank) in enumerate(ranks)])).alias("w")
    here = (F.col("w.rank") > F.col("through") - F.col("rows")) & (F.col("w.rank") <= F.col("through")) & F.col("v").isNotNull()

    def pick(through: DataFrame, of: Column) -> DataFrame:
        """`of`: whether a row is in the bracket of a wanted rank."""
        return through.select("*", wanted).filter(here & of).select(*groups, "n", F.col("w.r").alias("r"), "v", *by_tie)

    if not bounds.filter(F.col("n") > SMALL_GROUP).limit(1).count():
        cells = df.select(*groups, F.col(value).alias("v"), *([F.col(tie).alias("tie")] if tie else []))
        whole = Window.partitionBy(*groups)  # groups of a bounded size
        along = whole.orderBy("v", *by_tie).rowsBetween(Window.unboundedPreceding, 0)
        counted = cells.groupBy(*groups, "v", *by_tie).agg(F.count("*").alias("rows"))
        return pick(counted.withColumns({"through": F.sum("rows").over(along), "n": F.sum("rows").over(whole)}), F.lit(True))
    for attempt in (bounds, None):
        if attempt is None:  # a rank was missed: every value is kept
            open_ends = {f"{e}_{j}": F.nullif(F.col(f"lo_{j}"), F.col(f"lo_{j}")) for j in range(len(shares)) for e in ("hi", "lo")}
            attempt = stage(bounds.withColumns(open_ends), "brackets")
        through = through_counts(kept_counts(df, groups, value, attempt, len(shares), tie), groups, by_tie)
        found = stage(pick(through, F.col("w.of") == F.col("j")), "ranks")
        due = bounds.select(F.lit(-len(ranks)).alias("x")).unionByName(found.select(F.lit(1).alias("x"))).agg(F.sum("x")).first()[0]
        if not due:
            break
    return found


def group_quantile(df: DataFrame, groups: list[str], value: str, q: float, name: str) -> DataFrame:
    """Exact interpolated quantile per group, or one row for the whole table when `groups` is empty."""
    at = F.lit(float(q)) * (F.col("n") - 1)
    found = at_ranks(df, groups, value, [q], [(0, F.floor(at) + 1), (0, F.ceil(at) + 1)])
    low, high = F.max(F.when(F.col("r") == 0, F.col("v"))), F.max(F.when(F.col("r") == 1, F.col("v")))
    share = F.max(at - F.floor(at))
    return found.groupBy(*groups).agg((low + (high - low) * share).alias(name))


def exact_quantile(df: DataFrame, value: str, q: float) -> Column:
    """Scalar column with the exact quantile of one column."""
    return group_quantile(df, [], value, q, "q").scalar()
