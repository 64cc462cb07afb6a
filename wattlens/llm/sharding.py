"""Uniform shuffle into shards of exact size, with a communication matrix.

How many rows each input partition sends to each shard is drawn first, from the multivariate hypergeometric distribution
that a uniform shuffle gives those counts. A partition then permutes its rows locally (a sort by a random key, no shuffle),
deals them out by its row of the matrix, and a shard permutes what it gets. Texts move once. A shard of any size is
permuted in blocks: every row draws a block, blocks are permuted one by one, and the counts per block give the offsets.

All of it is DataFrame operations. The matrix is drawn in two levels: over groups of partitions in one row, then
over the partitions of each group, so that no task draws more than about shards * sqrt(partitions) numbers.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattlens.llm.arrow_text import apart
from wattlens.plans.staging import stage

SHARDS = 24
BLOCK_ROWS = 1_000
BROADCAST_BYTES = 32_000_000
POSITION_BITS = 33  # monotonically_increasing_id has the row's place in its partition in the low bits


def _let(value: Column, use) -> Column:
    """Evaluate `value` once and pass it on."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _uniform(*parts) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(2.0 ** -53)


def hypergeometric(u: Column, drawn: Column, marked: Column, total: Column) -> Column:
    """Number of marked among `drawn` of `total` items, from one uniform number.

    Inverse transform over the support outward from the mode, by the ratio of neighbouring probabilities; what is more than
    12 standard deviations away has less weight than the last bit of `u`.
    """
    def with_limits(v):
        n, k, big = v["n"], v["k"], v["big"]
        low, high = F.greatest(F.lit(0).cast("long"), n + k - big), F.least(n, k)
        mode = F.floor((n + 1).cast("double") * (k + 1) / (big + 2)).cast("long")
        share = k / F.greatest(big, F.lit(1))
        reach = (F.ceil(12 * F.sqrt(F.greatest(n * share * (1 - share) * (big - n) / F.greatest(big - 1, F.lit(1)),
                                               F.lit(0.0)))) + 12).cast("long")
        mode = F.least(F.greatest(mode, low), high)
        return F.struct(n.alias("n"), k.alias("k"), big.alias("big"), v["u"].alias("u"), mode.alias("mode"),
                        F.greatest(low, mode - reach).alias("a"), F.least(high, mode + reach).alias("b"))

    def up(v, x):  # P(x + 1) / P(x)
        return ((v["k"] - x).cast("double") * (v["n"] - x)) / ((x + 1).cast("double") * (v["big"] - v["k"] - v["n"] + x + 1))

    def down(v, x):  # P(x - 1) / P(x)
        return (x.cast("double") * (v["big"] - v["k"] - v["n"] + x)) / ((v["k"] - x + 1).cast("double") * (v["n"] - x + 1))

    none = F.array().cast("array<bigint>")
    ups = lambda v: F.when(v["b"] > v["mode"], F.sequence(v["mode"], v["b"] - 1)).otherwise(none)
    downs = lambda v: F.when(v["a"] < v["mode"], F.sequence(v["mode"], v["a"] + 1)).otherwise(none)

    def weight(v, steps, ratio):
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("t"))
        return F.aggregate(steps, start, lambda s, x: _let(
            s["w"] * ratio(v, x), lambda w: F.struct(w.alias("w"), (s["t"] + w).alias("t"))), lambda s: s["t"])

    def walk(v, steps, ratio, target, direction):
        start = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("t"), v["mode"].alias("x"))
        return F.aggregate(steps, start, lambda s, x: F.when(s["t"] > target, s).otherwise(_let(
            s["w"] * ratio(v, x), lambda w: F.struct(w.alias("w"), (s["t"] + w).alias("t"), (x + direction).alias("x")))),
            lambda s: s["x"])

    def pick(v):
        return _let(F.struct(weight(v, ups(v), up).alias("up"), weight(v, downs(v), down).alias("down")), lambda t: _let(
            v["u"] * (1 + t["up"] + t["down"]), lambda target: F.when(target < 1 + t["up"], walk(v, ups(v), up, target, 1))
            .otherwise(walk(v, downs(v), down, target - t["up"], -1))))

    whole = [c.cast("long").alias(a) for c, a in ((drawn, "n"), (marked, "k"), (total, "big"))]
    return _let(_let(F.struct(*whole, u.alias("u")), with_limits), pick)


def deal(sizes: Column, capacities: Column, seed: Column) -> Column:
    """Matrix (an array of rows) with the given row sums and column sums, as a uniform shuffle would give it."""
    longs, rows = "array<bigint>", "array<array<bigint>>"

    def one_row(size, index, left):
        start = F.struct(size.alias("rest"), F.aggregate(left, F.lit(0).cast("long"), lambda s, c: s + c).alias("total"),
                         F.array().cast(longs).alias("out"))
        return F.aggregate(left, start, lambda s, c: _let(
            hypergeometric(_uniform(seed, index, F.size(s["out"])), s["rest"], c, s["total"]),
            lambda x: F.struct((s["rest"] - x).alias("rest"), (s["total"] - c).alias("total"),
                               F.concat(s["out"], F.array(x)).alias("out"))), lambda s: s["out"])

    start = F.struct(capacities.cast(longs).alias("left"), F.array().cast(rows).alias("out"))
    return F.aggregate(sizes.cast(longs), start, lambda s, size: _let(
        one_row(size, F.size(s["out"]), s["left"]), lambda row: F.struct(
            F.zip_with(s["left"], row, lambda c, x: c - x).alias("left"), F.concat(s["out"], F.array(row)).alias("out"))),
        lambda s: s["out"])


def communication_matrix(parts: DataFrame, shards: int, seed: int) -> DataFrame:
    """`parts` (src, rows) with `bounds`: the places in the partition's order at which its shards begin and end."""
    total, last = parts.agg(F.sum("rows"), F.max("src")).first()
    width = max(1, math.isqrt(last + 1))
    groups = stage(parts.groupBy(F.floor(F.col("src") / width).cast("long").alias("grp")).agg(
        F.sum("rows").alias("rows"), F.sort_array(F.collect_list(F.struct("src", "rows"))).alias("members")), "shard-groups")
    size, more = divmod(total, shards)
    capacities = F.expr(f"transform(sequence(0, {shards - 1}), i -> {size}L + if(i < {more}, 1L, 0L))")
    level1 = groups.agg(F.sort_array(F.collect_list(F.struct("grp", "rows"))).alias("all")).select(
        "all", deal(F.col("all")["rows"], capacities, F.lit(seed)).alias("matrix"))
    shares = stage(level1.select(F.explode(F.arrays_zip("all", "matrix")).alias("z"))
                   .select(F.col("z.all.grp").alias("grp"), F.col("z.matrix").alias("left")), "shard-groups")
    level2 = groups.join(shares, "grp").select("members", deal(
        F.col("members")["rows"], F.col("left"), F.xxhash64(F.lit(seed), "grp")).alias("matrix"))
    rows = level2.select(F.explode(F.arrays_zip("members", "matrix")).alias("z"))
    begin = F.array(F.lit(0).cast("long"))
    return stage(rows.select(F.col("z.members.src").alias("src"), F.aggregate(
        F.col("z.matrix"), begin, lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x))).alias("bounds")), "matrix")


HELPERS = ["src", "bounds", "_src", "_key", "_pos", "_again", "_block", "_nth", "_before"]


def shuffle_to_shards(docs: DataFrame, shards: int = SHARDS, seed: int = 1, stored: bool = True) -> DataFrame:
    """Add `shard` (0 to shards - 1; their row counts differ by one at most) and `slot` (the place in the shard, from 0).

    Every arrangement is equally likely, up to 64-bit hashes as the source of chance; equal and repeated rows, nulls and
    long texts are rows like any other. `stored` says that `docs` reads stored files, so that every scan sees the same rows
    in the same partitions; otherwise pass False and the rows are written first. The same files, settings and seed give
    the same result. Columns named shard or slot are replaced, others kept whatever their names are; an empty table stays empty.
    """
    return apart(docs.drop("shard", "slot"), HELPERS, lambda rows, _: _shuffled(rows, shards, seed, stored))


def _shuffled(docs: DataFrame, shards: int, seed: int, stored: bool) -> DataFrame:
    docs = docs if stored else stage(docs, "shard-input")
    parts = stage(docs.select(F.spark_partition_id().alias("src")).groupBy("src").agg(F.count("*").alias("rows")), "parts")
    total = parts.agg(F.sum("rows"), F.count("*")).first()
    if not total[0]:
        return docs.withColumns({"shard": F.lit(None).cast("int"), "slot": F.lit(None).cast("long")})
    matrix = communication_matrix(parts, shards, seed)
    matrix = F.broadcast(matrix) if total[1] * shards * 8 <= BROADCAST_BYTES else matrix
    blocks = -(-total[0] // (shards * BLOCK_ROWS))

    def dealt(rows: DataFrame) -> DataFrame:
        local = (rows.withColumn("_src", F.spark_partition_id())
                 .withColumn("_key", F.xxhash64(F.lit(seed), F.lit("local"), F.monotonically_increasing_id()))
                 .sortWithinPartitions("_key")
                 .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << POSITION_BITS) - 1))))
        sent = local.join(matrix, local["_src"] == matrix["src"])
        sent = sent.withColumn("shard", F.size(F.filter("bounds", lambda b: b <= F.col("_pos"))) - 1)
        again = F.xxhash64(F.lit(seed), F.lit("again"), "_src", "_pos")
        return (sent.withColumn("_again", again).withColumn("_block", F.pmod(F.xxhash64("_again"), F.lit(blocks)))
                .drop("src", "bounds", "_key"))

    # a bound that equals the next one belongs to an empty share, so the last bound not above the place decides
    counts = dealt(docs.select()).groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"), "offsets")
    offsets = F.broadcast(offsets) if shards * blocks * 24 <= BROADCAST_BYTES else offsets
    order = Window.partitionBy("shard", "_block").orderBy("_again", "_src", "_pos")
    placed = dealt(docs).withColumn("_nth", F.row_number().over(order)).join(offsets, ["shard", "_block"])
    return placed.select(*docs.columns, "shard", (F.col("_before") + F.col("_nth") - 1).alias("slot"))


def op1_hypergeometric_shards(spark, sf_dir: str) -> DataFrame:
    """Law `rows`: shards differ by one row at most. Equal texts are dealt out as the single rows they are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    placed = shuffle_to_shards(docs)
    text = F.coalesce("text", F.lit(""))
    return placed.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
                         F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
