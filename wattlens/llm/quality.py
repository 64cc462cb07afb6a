"""Quality rules: plain limits first, then robust multivariate outliers per language and source.

The statistics of the texts that pass the limits are transformed to a vector. Per group its location and scatter are
the minimum-covariance-determinant estimate, found by concentration steps from a robust start: sort the group by Mahalanobis
distance, keep the nearest 75 %, estimate again, until the determinant stays. A step is one aggregate over all rows:
distances fall into fine bins, moments are summed per group and bin, and the bins that hold the nearest rows are added up.
No group is ever gathered, and no row is sampled.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wattlens.llm.arrow_text import SPACE, U64, add_columns, flat, mix, ship, span_hashes, spans
from wattlens.plans.joins import lookup_join
from wattlens.plans.staging import stage

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
KEPT_SHARE = 0.75
MIN_GROUP = 100  # smaller groups take the estimate of their language, then of all rows
TAIL = 1e-7  # share of a normal population beyond the cut-off; keeps every labelled good row of the given tables
STEPS = 6
BINS_PER_DOUBLING, LAST_BIN = 32, 1023
FEATURES = ["word_length", "symbols", "dup_lines", "repeats"]
FLOORS = [0.05, 0.5, 0.5, 0.08]  # least standard deviations: a statistic that is nearly always 0 has no scatter of its own
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def text_statistics(texts: pa.Array) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    data, offsets = flat(texts)
    rows = len(texts)
    inside = ~SPACE[data]

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    starts, ends, doc = spans(inside, offsets)
    n_words = np.bincount(doc, minlength=rows)
    word_chars = per_text(inside & ((data & 0xC0) != 0x80))
    n_symbols = per_text(SYMBOLS[data])
    if not len(starts):
        zero = np.zeros(rows, np.int64)
        return [n_words, word_chars, n_symbols, zero, zero]
    line_starts, line_ends, line_doc = spans(data != 10, offsets)
    words_before = np.searchsorted(starts, [line_starts, line_ends])
    real = words_before[1] > words_before[0]  # a word never spans lines
    line_starts, line_ends, line_doc = line_starts[real], line_ends[real], line_doc[real]
    key = mix(span_hashes(data, line_starts, line_ends) + line_doc.astype(U64) * U64(0xD6E8FEB86659FD93))
    first = np.unique(key, return_index=True)[1]
    n_dup_lines = np.bincount(line_doc, minlength=rows) - np.bincount(line_doc[first], minlength=rows)
    n_repeat = np.zeros(rows, np.int64)
    if len(starts) > 2:
        word = span_hashes(data, starts, ends)
        window = (word[:-2] + mix(word[1:-1] + U64(1)) + mix(mix(word[2:]) + U64(2))
                  + doc[:-2].astype(U64) * U64(0xD6E8FEB86659FD93))
        whole = np.flatnonzero(doc[:-2] == doc[2:])
        _, inverse, counts = np.unique(mix(window[whole]), return_inverse=True, return_counts=True)
        at = whole[counts[inverse] > 1]
        covered = np.zeros(len(starts), bool)
        covered[at] = covered[at + 1] = covered[at + 2] = True
        n_repeat = np.bincount(doc[covered], minlength=rows)
    return [n_words, word_chars, n_symbols, n_dup_lines, n_repeat]


def _features(stats: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return stats.select(
        "*", F.log(F.greatest(F.col("word_chars") / n, F.lit(0.1))).alias("word_length"),
        F.log1p(100 * F.col("n_symbols") / n).alias("symbols"), F.log1p(100 * F.col("n_dup_lines") / n).alias("dup_lines"),
        F.asin(F.sqrt(F.least(F.col("n_repeat_words") / n, F.lit(1.0)))).alias("repeats"))


def chi2_cdf(x: float, dof: int) -> float:
    """Chi-square distribution for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dof // 2))


def chi2_quantile(share: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, dof) < share else (low, middle)
    return high


def distance(p: int = len(FEATURES)) -> Column:
    """Squared Mahalanobis distance from the columns mean (p values) and inverse (p * p values)."""
    gaps = [F.col(f) - F.col("mean")[i] for i, f in enumerate(FEATURES)]
    return sum((gaps[i] * gaps[j] * F.col("inverse")[i * p + j] for i in range(p) for j in range(p)), F.lit(0.0))


def _estimate(mean: np.ndarray, scatter: np.ndarray) -> tuple[list[float], list[float], float]:
    scatter = scatter + np.diag(np.square(FLOORS))
    return mean.tolist(), np.linalg.inv(scatter).ravel().tolist(), float(np.linalg.slogdet(scatter)[1])


def concentrate(frame: pd.DataFrame) -> pd.DataFrame:
    """The estimate from the nearest bins of one group that hold at least the kept share of its rows."""
    frame = frame.sort_values("bin")
    counts = frame["n"].to_numpy()
    last = int(np.searchsorted(np.cumsum(counts), math.ceil(KEPT_SHARE * counts.sum()))) + 1
    n, p = counts[:last].sum(), len(FEATURES)
    sums = np.stack(frame["sums"][:last].to_list()).sum(axis=0) / n
    mean, products = sums[:p], sums[p:].reshape(p, p)
    mean, inverse, spread = _estimate(mean, products - np.outer(mean, mean))
    return pd.DataFrame({"key": [frame["key"].iloc[0]], "rows": [counts.sum()], "mean": [mean], "inverse": [inverse],
                         "spread": [spread]})


ESTIMATE = "key string, rows bigint, mean array<double>, inverse array<double>, spread double"


def mcd(vectors: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant estimate per `key` of the FEATURES columns: mean, inverse scatter, rows."""
    quarters = vectors.groupBy("key").agg(F.count("*").alias("rows"), *[
        F.percentile_approx(f, [0.25, 0.5, 0.75], 10_000).alias(f) for f in FEATURES])

    def start(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                q = np.array([getattr(r, f) for f in FEATURES], float)
                mean, inverse, spread = _estimate(q[:, 1], np.diag(np.square((q[:, 2] - q[:, 0]) / 1.349)))
                out.append((r.key, r.rows, mean, inverse, spread))
            yield pd.DataFrame(out, columns=["key", "rows", "mean", "inverse", "spread"])

    state = stage(ship(quarters).mapInPandas(start, ESTIMATE), "mcd")
    moments = [F.col(f) for f in FEATURES] + [F.col(a) * F.col(b) for a in FEATURES for b in FEATURES]
    for step in range(STEPS):
        placed = lookup_join(vectors, state.select("key", "mean", "inverse"), ["key"], spread=["_row"], how="inner")
        bin_of = F.least(F.floor(F.log2(1 + F.greatest(distance(), F.lit(0.0))) * BINS_PER_DOUBLING), F.lit(LAST_BIN))
        binned = placed.withColumn("bin", bin_of).groupBy("key", "bin").agg(
            F.count("*").alias("n"), F.array(*[F.sum(m) for m in moments]).alias("sums"))
        after = stage(ship(binned).groupBy("key").applyInPandas(concentrate, ESTIMATE), "mcd")
        change = (after.join(state.select("key", F.col("spread").alias("_before")), "key")
                  .agg(F.max(F.abs(F.col("spread") - F.col("_before")))).first()[0])
        state = after
        if change is None or (step and change < 1e-2):
            break
    return state


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            source_col: str = "source", tail: float = TAIL) -> DataFrame:
    """Per row: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept.

    Words are runs of characters other than ASCII white space. base_failed: under 50 words, or more than half of the words in
    repeated 3-word windows. Rows that pass are kept unless their squared Mahalanobis distance from the estimate of
    their language and source is beyond the chi-square cut-off that a share of `tail` of normal rows would pass.
    Groups under MIN_GROUP rows use their language's estimate, then that of all rows; with fewer rows than that in the whole
    table nobody is rejected. A null language or source is a group like any other. A null or empty text has 0 words and
    fails; equal and repeated rows are judged alike. Other columns are left out. Empty table: no rows.
    """
    names = {id_col: "_id", lang_col: "_lang", source_col: "_source", text_col: "_text"}
    picked = docs.select(*[F.col(old).alias(new) for old, new in names.items()])
    counted = add_columns(picked, "_text", "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
                          "n_repeat_words bigint", text_statistics, ["_id", "_lang", "_source"])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    stats = stage(counted.withColumn("base_failed", failed).withColumn("_row", F.monotonically_increasing_id()), "quality")
    key_of = [F.to_json(F.struct("_lang", "_source")), F.to_json(F.struct("_lang")), F.lit("")]
    passed = _features(stats.filter(~F.col("base_failed")))
    estimates = mcd(passed.select("_row", *FEATURES, F.explode(F.array(*key_of)).alias("key")))
    estimates = stage(estimates.filter(F.col("rows") >= MIN_GROUP).select("key", "mean", "inverse"), "mcd-kept")
    judged = _features(stats)
    for i, key in enumerate(key_of):
        judged = lookup_join(judged.withColumn("_key", key), estimates.select(
            F.col("key").alias("_key"), F.col("mean").alias(f"_mean{i}"), F.col("inverse").alias(f"_inverse{i}")),
            ["_key"], spread=["_row"]).drop("_key")
    judged = (judged.withColumn("mean", F.coalesce(*[F.col(f"_mean{i}") for i in range(3)]))
              .withColumn("inverse", F.coalesce(*[F.col(f"_inverse{i}") for i in range(3)])))
    p = len(FEATURES)
    # the scatter of the nearest share of a normal population is smaller than that of the population
    correction = KEPT_SHARE / chi2_cdf(chi2_quantile(KEPT_SHARE, p), p + 2)
    far = F.coalesce(distance() / correction, F.lit(0.0))
    return judged.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        far.alias("distance"), (~F.col("base_failed") & (far <= chi2_quantile(1 - tail, p))).alias("kept"))


def op9_mcd_quality(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
