"""Isolation forest (Liu, Ting and Zhou, 2008): Spark ML has none.

Sampling, grouping and scoring run on Spark. Python only grows one tree from at most 256 rows and walks the
finished trees over Arrow batches. The forest is bounded by trees x 511 nodes, whatever the table size.
"""
from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from wattlens.functions.columns import clip

# the tree functions travel with the job, so workers need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE = 256  # rows per tree, the published algorithm's default; `sample` of every function below changes it
NODES = "tree int, node int, feature int, cut double, left int, right int, size int, depth int"


def path_length(n):
    """Mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    inner = 2.0 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2.0 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, inner, np.where(n == 2, 1.0, 0.0))


def grow_tree(rows: pd.DataFrame, seed: int, sample: int = SAMPLE) -> pd.DataFrame:
    """One random tree. Rows are put in hash order first, so partitioning does not change the result."""
    rows = rows.sort_values(["hash", "id"]).head(sample)
    x = np.array(rows["x"].tolist(), dtype=float)
    tree = int(rows["tree"].iloc[0])
    rng = np.random.default_rng([seed, tree])
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes, pending = [], [(0, np.arange(len(x)), 0)]
    free = 1
    while pending:
        node, members, depth = pending.pop()
        part = x[members]
        varying = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(members) > 1 else []
        if depth >= limit or len(varying) == 0:
            nodes.append((tree, node, -1, 0.0, -1, -1, len(members), depth))
            continue
        feature = int(rng.choice(varying))
        values = part[:, feature]
        cut = float(rng.uniform(values.min(), values.max()))
        goes_left = values <= cut
        nodes.append((tree, node, feature, cut, free, free + 1, len(members), depth))
        pending += [(free, members[goes_left], depth + 1), (free + 1, members[~goes_left], depth + 1)]
        free += 2
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "left", "right", "size", "depth"])


def grow_forest(df: DataFrame, id_column: str, trees: int, seed: int, sample: int = SAMPLE) -> DataFrame:
    """Nodes of all trees from a table with the id and the feature array `x`.

    Each tree keeps the rows whose hash falls below a threshold that yields about three times the sample size,
    then the `sample` smallest hashes; only those rows are shuffled.
    """
    limit = 1 << 31
    threshold = int(min(1.0, 3.0 * sample / max(df.count(), 1)) * limit)

    def draw(t):
        return F.pmod(F.xxhash64(F.col(id_column), F.lit(seed), t), F.lit(limit))

    chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < threshold)
    picks = df.select(F.col(id_column).alias("id"), "x", F.explode(chosen).alias("tree"))
    picks = picks.withColumn("hash", F.pmod(F.xxhash64("id", F.lit(seed), "tree"), F.lit(limit)))
    return picks.groupBy("tree").applyInPandas(lambda rows: grow_tree(rows, seed, sample), NODES)


def forest_score(df: DataFrame, id_column: str, trees: int = 250, seed: int = 42, sample: int = SAMPLE) -> DataFrame:
    """Adds `isolation_score` in (0, 1): near 1 is easy to isolate."""
    nodes = grow_forest(df, id_column, trees, seed, sample).toPandas()  # at most trees x (2 x sample - 1) rows
    if nodes.empty:
        return df.withColumn("isolation_score", F.lit(0.0))
    forest, grown = {}, 1
    for tree, part in nodes.sort_values(["tree", "node"]).groupby("tree"):
        forest[int(tree)] = (part["feature"].to_numpy(), part["cut"].to_numpy(), part["left"].to_numpy(),
                             part["right"].to_numpy(), (part["depth"] + path_length(part["size"])).to_numpy())
        grown = max(grown, int(part["size"].iloc[0]))
    shared = df.sparkSession.sparkContext.broadcast(forest)
    norm = float(path_length(grown)) or 1.0

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        if x.empty:
            return pd.Series([], dtype=float)
        rows = np.array(x.tolist(), dtype=float)
        index = np.arange(len(rows))
        total = np.zeros(len(rows))
        for feature, cut, left, right, ending in shared.value.values():
            at = np.zeros(len(rows), dtype=int)
            inner = feature[at] >= 0
            while inner.any():
                goes_left = rows[index, np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
                inner = feature[at] >= 0
            total += ending[at]
        return pd.Series(2.0 ** (-(total / len(shared.value)) / norm))

    return df.withColumn("isolation_score", score("x"))


def scale_scores(scored: DataFrame, name: str) -> DataFrame:
    """Isolation score stretched to 0-100 over the table; a constant score becomes 0."""
    span = scored.agg(F.struct(F.min("isolation_score").alias("lo"), F.max("isolation_score").alias("hi"))).scalar()
    width = span["hi"] - span["lo"]
    stretched = F.when(width > 1e-9, (F.col("isolation_score") - span["lo"]) / width * 100).otherwise(0.0)
    return scored.withColumn(name, clip(stretched, 0, 100))
