"""Similarity join of texts on word shingles by parity sketches.

A text's distinct shingles are thrown into the bits of a wide sketch; a bit is the parity of the shingles that hit it, so
the Hamming distance of two sketches never exceeds the size of their symmetric difference. Texts of a size band share one
sketch layout of `blocks` blocks. A pair within the threshold differs in at most k bits, hence in at most k
blocks, and shares all others (pigeonhole). A text takes its k + 1 + x fullest blocks, in one order that all texts
share; x is the same for a band, so that a pair has x + 1 or more of the taken ones in common. Each text may then leave out
x of them, if all go by one order: the blocks that most texts have go first, and the rarest one that a pair shares stays
with both. A passage that many documents quote fills a few blocks, which are left out; texts that are near as
a whole share more than may be left out. Sketches are kept as their set bits.

Texts that still share a block form candidate clusters. Inside a cluster every pair is compared once by a dense sketch, and
a pair that the bound can't exclude is verified on the full shingle sets unless verified links already connect it. So links
are exact (up to collisions of 64-bit hashes), though only a spanning set of them is ever written.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from wattlens.llm.arrow_text import LOWER, SLICE, SPACE, U64, begin_task, flat, mix, ship, span_hashes, spans, sub_batches
from wattlens.llm.components import components
from wattlens.plans.staging import stage

BLOCK_BITS = 1 << 32  # sketches are sparse, so width costs nothing
SPARE_BLOCKS = 1.2  # blocks of a layout per block that its largest texts must offer
TILE_ROWS, TILE_HASHES = 1024, 1_000_000
COUNTED_BITS = 1 << 20  # bits of sketches that are counted at once, in numbers of 8 bytes
BROADCAST_BYTES = 32_000_000
HASHED_ROW = 96  # bytes of a row of two numbers in a broadcast hash table
_POSITION = [U64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _salt(number: int, factor: int) -> np.uint64:
    return U64(number * int(_POSITION[factor]) % 2 ** 64)


def document_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text with fewer words has its whole sequence as one."""
    data, offsets = flat(texts)
    starts, ends, doc = spans(~SPACE[data], offsets)
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    if not len(starts):
        return [np.zeros(0, U64)] * len(texts)
    word = span_hashes(LOWER[data], starts, ends)
    chain = np.zeros(len(word), U64)
    for i in range(min(words, len(word))):
        chain[:len(word) - i] += mix(word[i:] + _salt(i + 1, 0))
    shingles, sets = mix(chain), []
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        n = high - low
        if n >= words:
            sets.append(np.unique(shingles[low:high - words + 1]))
        elif n:
            own = mix(word[low:high] + np.arange(1, n + 1, dtype=U64) * _POSITION[1]).sum(dtype=U64)
            sets.append(mix(np.array([own + U64(n)], U64)))
        else:
            sets.append(np.zeros(0, U64))
    return sets


def most_differences(total: int, percent: int) -> int:
    """Bound on the symmetric difference of two linked sets whose sizes add up to `total`."""
    return (100 - percent) * total // (100 + percent)


def band_blocks(band: int, percent: int) -> int:
    """Blocks of the sketches of a band, whose sets are smaller than 2 ** (band + 1)."""
    return math.ceil(SPARE_BLOCKS * (most_differences(2 * (2 ** (band + 1) - 1), percent) + 1))


def block_keys(hashes: np.ndarray, band: int, percent: int) -> tuple[np.ndarray, int]:
    """The fullest blocks of a set in a band's sketch layout, as keys, and how many of them may be left out."""
    size, last = len(hashes), 2 ** (band + 1) - 1
    k = most_differences(size + min(100 * size // percent, last), percent)
    if k == 0:
        return np.zeros(0, U64), 0  # a partner can only be an equal set, and equal sets are one node
    blocks = band_blocks(band, percent)
    mixed = mix(hashes + _salt(band + 1, 2))
    cells = np.sort((mixed >> U64(32)) % U64(blocks) * U64(BLOCK_BITS) + (mixed & U64(BLOCK_BITS - 1)))
    if (cells[1:] == cells[:-1]).any():
        cells, hits = np.unique(cells, return_counts=True)
        cells = cells[hits % 2 == 1]
    block = (cells // U64(BLOCK_BITS)).astype(np.int64)
    weight = np.bincount(block, minlength=blocks)
    content = mix(np.arange(1, blocks + 1, dtype=U64))
    filled = np.flatnonzero(weight)
    if len(filled):
        content[filled] += np.add.reduceat(mix(cells), np.searchsorted(block, filled))
    order = (weight.astype(U64) << U64(48)) | (mix(content) >> U64(16))
    spare = blocks - most_differences(2 * last, percent) - 1
    least = blocks - k - 1 - spare
    chosen = np.argpartition(order, least)[least:] if least > 0 else np.arange(blocks)
    return mix(content[chosen] + chosen.astype(U64) * _POSITION[3] + _salt(band + 1, 1)), spare


def signatures(hashes: np.ndarray, percent: int) -> list[tuple[np.ndarray, int]]:
    """Blocks and how many may be left out, in the band of the set's size, and in the next band where a larger partner may be."""
    size = len(hashes)
    if not size:
        return [(np.zeros(0, U64), 0)] * 2
    band = size.bit_length() - 1
    above = 100 * size >= percent * 2 ** (band + 1)
    return [block_keys(hashes, band, percent), block_keys(hashes, band + 1, percent) if above else (np.zeros(0, U64), 0)]


def digest(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, keep: list[str] | None = None) -> DataFrame:
    """Per row: id, the columns of `keep`, n_shingles, a 128-bit digest of the set (null if empty), blocks in two bands and how many may go."""
    keep = keep or []
    schema = StructType([*(docs.schema[c] for c in [id_col, *keep]), *StructType.fromDDL(
        "n_shingles bigint, n1 bigint, n2 bigint, keys array<bigint>, spare int, keys_above array<bigint>, "
        "spare_above int").fields])

    def listed(keys: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
        return pa.ListArray.from_arrays(ends, pa.array((np.concatenate(keys) if keys else np.zeros(0, U64)).view(np.int64)))

    def run(batches):
        begin_task()
        for batch in batches:
            for rows in sub_batches(batch, len(keep) + 1, SLICE):
                sets = document_sets(rows.column(len(keep) + 1), words)
                sizes = np.array([len(s) for s in sets], np.int64)
                n1 = np.array([s.sum(dtype=U64) for s in sets], U64).view(np.int64)
                n2 = np.array([mix(s ^ _POSITION[2]).sum(dtype=U64) for s in sets], U64).view(np.int64)
                layers = list(zip(*(signatures(s, percent) for s in sets))) or [(), ()]
                blocks = [a for layer in layers for a in (listed([keys for keys, _ in layer]),
                                                          pa.array([spare for _, spare in layer], pa.int32()))]
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[:len(keep) + 1], pa.array(sizes), pa.array(n1, mask=sizes == 0), pa.array(n2, mask=sizes == 0),
                     *blocks], names=schema.names)

    return ship(docs.select(id_col, *keep, text_col)).mapInArrow(run, schema)


def candidate_edges(nodes: DataFrame) -> DataFrame:
    """Edges (src, dst) that connect all texts sharing a block that they did not leave out.

    A key's holders are counted where its rows have been shuffled to, so blocks, the bulk of what moves, move once. Keys of one text
    alone go no further; of the others a text leaves out the most frequent ones, as many as it may. What stays links a text to the smallest of its keys' leads, and these leads to that one.
    """
    # one number, to keep rows short: how many may be left out, and the layer as its last bit
    layers = [nodes.select("node", (F.col(spare) * 2 + i).alias("spare_layer"), F.explode(keys).alias("key"))
              for i, (keys, spare) in enumerate((("keys", "spare"), ("keys_above", "spare_above")))]
    holders = Window.partitionBy("key")  # thin rows; a block in many texts spills
    held = layers[0].unionByName(layers[1]).withColumn("c", F.count("*").over(holders)).filter("c > 1")
    hottest = Window.partitionBy("node", "spare_layer").orderBy(F.desc("c"), "key")  # the blocks of one text
    kept = stage(held.withColumn("place", F.row_number().over(hottest)).filter("place > shiftright(spare_layer, 1)").select("node", "key"), "kept-blocks")
    leads = kept.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("c")).filter("c > 1").drop("c")
    named = kept.join(leads, "key").groupBy("node").agg(F.min("lead").alias("first"), F.collect_set("lead").alias("leads"))
    own = named.filter("node <> first").select(F.col("node").alias("src"), F.col("first").alias("dst"))
    between = named.select(F.explode("leads").alias("src"), F.col("first").alias("dst")).filter("src <> dst")
    return own.unionByName(between).distinct()


def dense_sketches(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """A row per set, a bit of it the parity of the hashes that hit it; some rows at a time, as counts take 64 times the bits."""
    sketch, step = np.empty((len(sets), bits // 64), U64), max(1, COUNTED_BITS // bits)
    for low in range(0, len(sets), step):
        some = sets[low:low + step]
        row = np.repeat(np.arange(len(some)), [len(s) for s in some])
        hit = (np.concatenate(some) & U64(bits - 1)).astype(np.int64)
        parity = np.bincount(row * bits + hit, minlength=len(some) * bits).astype(np.uint8) & 1
        sketch[low:low + step] = np.packbits(parity.reshape(len(some), bits), axis=1).view(U64)
    return sketch


def compare_block(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """A spanning set of the links between two lists of sets (of one list if `right` is None), as index pairs; indexes of
    `right` start at len(left)."""
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets], np.int64)
    bits = 1 << max(10, min(16, int(sizes.max()).bit_length() + 1))
    sketch = dense_sketches(sets, bits)
    label, found = np.arange(len(sets)), []
    for a in range(len(left)):
        others = np.arange(a + 1 if right is None else len(left), len(sets))
        total = sizes[others] + sizes[a]
        near = ((label[others] != label[a])
                & (100 * np.minimum(sizes[others], sizes[a]) >= percent * np.maximum(sizes[others], sizes[a])))
        others, total = others[near], total[near]
        if not len(others):
            continue
        distance = np.bitwise_count(sketch[others] ^ sketch[a]).sum(axis=1, dtype=np.int64)
        others = others[distance <= (100 - percent) * total // (100 + percent)]
        while len(others):
            b = others[0]
            common = np.intersect1d(sets[a], sets[b], assume_unique=True).size
            if 100 * common >= percent * (sizes[a] + sizes[b] - common):
                found.append((a, int(b)))
                label[label == label[b]] = label[a]
            others = others[1:]
            others = others[label[others] != label[a]]
    return found


def verified_links(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, words: int,
                   percent: int) -> DataFrame:
    """Links (src, dst) inside candidate clusters. `members`: first_doc, n1, n2, node, cluster, tiles, bin.

    A cluster of more than a tile is compared tile by tile: a row goes to as many cells as its cluster has tiles, and
    no task holds more than two tiles. Smaller clusters share cells, bounded by the number of hashes in them.
    """
    side = members.withColumnRenamed("first_doc", "_first")
    side = F.broadcast(side) if members.count() * 2 * HASHED_ROW <= BROADCAST_BYTES else side
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(
        side, F.col("_id").eqNullSafe(F.col("_first")), "inner")
    schema = StructType.fromDDL("node bigint, cluster bigint, tiles int, bin bigint, hashes binary")
    inputs = ["_text", "n1", "n2", "node", "cluster", "tiles", "bin"]

    def sets_of(batches):
        begin_task()
        seen: set[int] = set()  # rows that repeat an id and its text leave a task once
        for batch in batches:
            for part in sub_batches(batch, 0, SLICE):
                sets = document_sets(part.column(0), words)
                n1 = np.array([s.sum(dtype=U64) for s in sets], U64).view(np.int64)
                n2 = np.array([mix(s ^ _POSITION[2]).sum(dtype=U64) for s in sets], U64).view(np.int64)
                same = (n1 == part.column(1).to_numpy()) & (n2 == part.column(2).to_numpy())
                at = [i for i in np.flatnonzero(same) if not (n1[i] in seen or seen.add(n1[i]))]
                kept = part.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*(kept.column(c) for c in inputs[3:]), pa.array([sets[i].tobytes() for i in at], pa.binary())],
                    names=schema.names)

    found = ship(rows.select(*inputs)).mapInArrow(sets_of, schema)
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    other = F.explode(F.when(F.col("tiles") == 1, F.array(F.lit(0)))
                      .otherwise(F.sequence(F.lit(0), F.col("tiles") - 1))).alias("_other")
    cells = (found.withColumn("_tile", tile).select("*", other)
             .withColumn("_cell", F.when(F.col("tiles") == 1, -1 - F.col("bin")).otherwise(F.col("cluster")))
             .withColumn("_i", F.least("_tile", "_other")).withColumn("_j", F.greatest("_tile", "_other"))
             .select("_cell", "_i", "_j", "_tile", "cluster", "node", "hashes"))

    def compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        links = []
        for _, part in frame.drop_duplicates("node").groupby("cluster", sort=False):
            part = part.sort_values("_tile", kind="stable")
            nodes = part["node"].to_numpy()
            sets = [np.frombuffer(h, U64) for h in part["hashes"]]
            cut = int((part["_tile"] == key[1]).sum()) if key[1] != key[2] else len(sets)
            pairs = compare_block(sets[:cut], sets[cut:] if key[1] != key[2] else None, percent)
            links += [(nodes[a], nodes[b]) for a, b in pairs]
        return pd.DataFrame(links, columns=["src", "dst"], dtype="int64")

    return cells.groupBy("_cell", "_i", "_j").applyInPandas(compare, "src bigint, dst bigint")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                       percent: int = 80, keep: list[str] | None = None) -> DataFrame:
    """Per row: the id, the columns of `keep`, n_shingles (distinct shingles of `words` words of the text with A-Z lower-cased) and component_id,
    the smallest id that links reach. Two texts link when 100 * intersection >= percent * union of their sets.

    A text with fewer words has its whole sequence as its one shingle. A null, empty or blank text has no shingles,
    links with nothing, and is its own component. Equal texts and repeated rows are one node, however many they are.
    A null id never is a component's id unless all its rows have none. With `keep`, `component` numbers the components of
    more than one row (null: the row is alone), since an id may stand on several texts. Other columns are left out. Empty
    table: no rows.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    rows = stage(digest(docs, id_col, text_col, words, percent, keep), "shingle-digest")
    nodes = stage(rows.filter("n_shingles > 0").groupBy("n1", "n2")
                  .agg(F.min(id_col).alias("first_doc"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"),
                       *[F.first(c).alias(c) for c in ("keys", "spare", "keys_above", "spare_above")])
                  .withColumn("node", F.monotonically_increasing_id()), "shingle-nodes")
    clusters = components(candidate_edges(nodes)).withColumnRenamed("component", "cluster")
    inside = stage(clusters.join(nodes.select("node", "n1", "n2", "first_doc", "n"), "node"), "cluster-nodes")
    tiles = F.greatest(F.ceil(F.col("c") / TILE_ROWS), F.ceil(F.col("h") / TILE_HASHES)).cast("int").alias("tiles")
    sized = inside.groupBy("cluster").agg(F.count("*").alias("c"), F.sum("n").alias("h")).select("cluster", "h", tiles)
    bins = F.greatest(F.ceil(sized.agg(F.sum("h")).scalar() / TILE_HASHES) * 4, F.lit(1))
    members = stage(inside.join(sized.drop("h"), "cluster")
                    .withColumn("bin", F.pmod(F.xxhash64("cluster"), bins)), "cluster-members")
    links = stage(verified_links(docs, members, id_col, text_col, words, percent), "shingle-links")
    found = components(links)
    linked = nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = (linked.filter("component is not null").groupBy("component")
              .agg(F.min("first_doc").alias("component_id"), F.sum("copies").alias("_rows")))
    named = linked.join(lowest, "component").filter("_rows > 1").select("n1", "n2", "component_id", "component")
    result = rows.select(id_col, *(keep or []), "n_shingles", "n1", "n2").join(named, ["n1", "n2"], "left")
    return result.select(id_col, *(keep or []), "n_shingles", F.coalesce("component_id", F.col(id_col)).alias("component_id"),
                         *(["component"] if keep else []))


def op5_parity_sketch_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, percent=85)


OP5_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
placed AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM worded WHERE len(words) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 3), ' ') AS s FROM placed),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached(doc_id, other) AS (
  SELECT x, y FROM ways UNION SELECT r.doc_id, b.y FROM reached r JOIN ways b ON b.x = r.other),
lowest AS (SELECT doc_id, min(other) AS other FROM reached GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.other, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN lowest l ON l.doc_id = d.doc_id
"""
