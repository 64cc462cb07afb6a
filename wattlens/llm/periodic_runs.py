"""Periodic runs: all maximal stretches of words that repeat with a period, and the texts without the repetitions.

A stretch has period p where words p apart are equal. For the periods of an octave, [S, 2S), a text is cut into overlapping
tiles around the multiples c of S, from c - S to c + 4S. A run of at least three periods holds such a c early on, so that the
S words from c on come again at c + p: that is what a tile looks for, for all p of the octave at once, by hashes of
blocks of S words. For what is left, the values at p of the Z-functions at the boundary c (how far the words from c on equal
those from c + p on, and backwards) are taken from the words themselves, up to the tile's ends. Short periods share tiles of
8 words. Periods that a smaller one divides are dropped, because the smaller one's octave reports the run.

Fragments of neighbouring tiles that a task has solved are joined there; then they are shuffled by text and period and
stitched. A text of more than `LONG_WORDS` words is dealt out to many tasks, as pieces of its tiles; a shorter one is solved
where it is read. Hashes only choose tiles; lengths are counted on the words (64-bit hashes of them).
"""
from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from wattlens.llm.arrow_text import SPACE, U64, flat, mix, ship, span_hashes, spans, sub_batches
from wattlens.plans.staging import stage

LEAST_WORDS, LEAST_PERIODS = 24, 3
SMALL = 8  # boundaries of all periods below 16
LONG_WORDS = 1 << 20
PIECE_SPAN = 1 << 17  # words of a long text whose boundaries make one piece, or 8 times S if that is more
EXTEND_CELLS = 1 << 20
FRAGMENT = pa.struct([("period", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])
_LEFT, _RIGHT = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=4)
def least_factors(limit: int) -> np.ndarray:
    """The smallest prime factor of every number below `limit`."""
    factor = np.arange(limit)
    for p in range(2, int(limit ** 0.5) + 1):
        if factor[p] == p:
            multiples = factor[p * p::p]
            multiples[multiples == np.arange(p * p, limit, p)] = p
    return factor


class Blocks:
    """Hashes of the blocks of 2 ** level words from every place on, for the levels that an octave asks for."""

    def __init__(self, words: np.ndarray):
        self.levels = {0: words}

    def rise(self, level: int) -> None:
        """Make sure of `level`; forget what octaves beyond it don't need."""
        for up in range(max(self.levels) + 1, level + 1):
            half, below = 1 << (up - 1), self.levels[up - 1]
            self.levels[up] = mix(below[:-half] * _LEFT + below[half:]) if len(below) > half else below[:0]
        for old in [k for k in self.levels if 3 < k < level - 1]:
            del self.levels[old]

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether `length` words from a and from b on are the same; places outside never are."""
        level = np.frexp(np.maximum(length, 1).astype(np.float64))[1] - 1
        level = np.minimum(level, max(self.levels))
        out = (a >= 0) & (b >= 0) & (np.maximum(a, b) + length <= len(self.levels[0]))
        for k in np.unique(level[out]).tolist():
            hashes, block = self.levels[k], 1 << k
            rows = np.flatnonzero(out & (level == k))
            last = length[rows] - block
            for step in range(int(last.max()) // block + 2):
                at = np.minimum(step * block, last)
                rows_equal = hashes[a[rows] + at] == hashes[b[rows] + at]
                out[rows[~rows_equal]] = False
                rows, last = rows[rows_equal], last[rows_equal]
        return out


def needed(period: np.ndarray) -> np.ndarray:
    """Pairs of equal words, `period` apart, that a run has at least."""
    return np.maximum(LEAST_WORDS - period, (LEAST_PERIODS - 1) * period)


def extend(words: np.ndarray, c: np.ndarray, p: np.ndarray, spacing: int) -> tuple[np.ndarray, np.ndarray]:
    """Values at p of the Z-functions at c, backwards up to c - spacing and forwards up to c + 2 * spacing."""
    back, ahead = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
    for out, steps in ((back, -1 - np.arange(spacing)), (ahead, np.arange(2 * spacing))):
        rows = max(1, EXTEND_CELLS // len(steps))
        for low in range(0, len(c), rows):
            at = c[low:low + rows, None] + steps
            pair = at + p[low:low + rows, None]
            inside = (at >= 0) & (pair < len(words))
            wrong = ~inside
            wrong[inside] = words[at[inside]] != words[pair[inside]]
            stop = wrong.argmax(axis=1)
            out[low:low + rows] = np.where(wrong.any(axis=1), stop, len(steps))
    return back, ahead


def tile_fragments(words: np.ndarray, blocks: Blocks, spacing: int, first: int, last: int) -> np.ndarray:
    """Rows (period, low, high) from the tiles around the multiples c of `spacing` in [first, last): pairs of equal words
    `period` apart stand at low <= i < high. Periods are [spacing, 2 * spacing), for the smallest spacing [1, 2 * spacing)."""
    level = spacing.bit_length() - 1
    blocks.rise(level)
    hashes = blocks.levels[level]
    begin = -(-first // spacing)
    end = min(-(-last // spacing), -(-len(hashes) // spacing))
    none = np.zeros((0, 3), np.int64)
    if end - begin < 1:
        return none
    own = hashes[begin * spacing:end * spacing:spacing]
    later = hashes[(begin + 1) * spacing:(end + 1) * spacing]
    padded = np.zeros((end - begin) * spacing, U64)
    padded[:len(later)] = later
    rows, step = np.nonzero(padded.reshape(-1, spacing) == own[:, None])
    c, p = (rows + begin) * spacing, step + spacing
    if spacing == SMALL:
        shifted = [hashes[begin * spacing + d::spacing][:end - begin] for d in range(1, spacing)]
        short = [np.flatnonzero(h == own[:len(h)]) for h in shifted]
        c = np.concatenate([c, *[(s + begin) * spacing for s in short]])
        p = np.concatenate([p, np.repeat(np.arange(1, spacing), [len(s) for s in short])])
    here = c + p + spacing <= len(words)  # a padded place never is a match
    c, p = c[here], p[here]
    keep = blocks.equal(c, c + p, needed(p) - spacing + 1) | blocks.equal(c - spacing, c - spacing + p, np.full(len(c), spacing))
    c, p = c[keep], p[keep]
    factor, rest = least_factors(2 * spacing), p.copy()
    primitive = np.ones(len(c), bool)
    while len(c) and (rest > 1).any():
        prime = factor[rest]
        part = np.where(rest > 1, p // np.maximum(prime, 1), 0)
        primitive &= ~((rest > 1) & blocks.equal(c, c + part, p - part))
        rest = np.where(rest > 1, rest // np.maximum(prime, 1), 1)
    c, p = c[primitive], p[primitive]
    if not len(c):
        return none
    back, ahead = extend(words, c, p, spacing)
    return np.stack([p, c - back, c + ahead], axis=1)


def stitched(found: np.ndarray) -> np.ndarray:
    """Fragments (period, low, high) that overlap or touch become one."""
    if not len(found):
        return found
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    period, low, high = found.T
    shift = period * (int(high.max()) + 2)  # periods don't mix
    reach = np.maximum.accumulate(high + shift)
    new = np.concatenate([[True], low[1:] + shift[1:] > reach[:-1]])
    return np.stack([period[new], low[new], np.maximum.reduceat(high, np.flatnonzero(new))], axis=1)


def spacings(longest: int) -> list[int]:
    """Tile spacings of all octaves of periods that a text of `longest` words can repeat often enough."""
    out, spacing = [], SMALL
    while longest >= LEAST_WORDS and (spacing == SMALL or LEAST_PERIODS * spacing <= longest):
        out.append(spacing)
        spacing *= 2
    return out


def long_enough(found: np.ndarray) -> np.ndarray:
    return found[:, 2] - found[:, 1] >= needed(found[:, 0])


def fragments_of_texts(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, (period, low, high) within it) of whole texts, whose words follow each other; longest octaves last.

    The texts stand in one array, longest first, each with a word of its own behind it that equals no other, so that no
    fragment crosses texts; an octave only looks at the texts that are long enough for it.
    """
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    lengths = size[order]
    starts = np.cumsum(lengths + 1) - lengths - 1
    inner = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    line = np.empty(len(words) + len(size), U64)
    line[np.repeat(starts, lengths) + inner] = words[np.repeat(bounds[order], lengths) + inner]
    line[starts + lengths] = mix(np.arange(1, len(size) + 1, dtype=U64) * _RIGHT)
    found, blocks = [], Blocks(line)
    for spacing in spacings(int(size.max(initial=0))):
        least = LEAST_WORDS if spacing == SMALL else LEAST_PERIODS * spacing
        count = int(np.searchsorted(-lengths, -least, "right"))
        last = int(starts[count - 1] + lengths[count - 1] + 1)
        if last < len(line):  # texts that are too short from here on
            line, blocks.levels = line[:last], {k: h[:max(0, last - (1 << k) + 1)] for k, h in blocks.levels.items()}
        found.append(stitched(tile_fragments(line, blocks, spacing, 0, last)))
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    rows = rows[long_enough(rows)]
    text = np.searchsorted(starts, rows[:, 1], "right") - 1
    rows[:, 1:] -= starts[text, None]
    by = np.lexsort((rows[:, 0], rows[:, 1], order[text]))
    return order[text][by], rows[by]


def pieces_of_text(size: int) -> list[tuple[int, int, int, int]]:
    """(smallest spacing, largest spacing, first boundary place, end of the boundary places) of a long text's pieces."""
    every = spacings(size)
    shared = [s for s in every if 8 * s <= PIECE_SPAN] or every[:1]
    groups = [(shared[0], shared[-1], max(PIECE_SPAN, 8 * shared[-1]))]
    groups += [(s, s, 8 * s) for s in every if s > shared[-1]]
    return [(low, high, at, min(at + span, size)) for low, high, span in groups for at in range(0, size, span)]


def fragments_of_piece(words: np.ndarray, offset: int, low: int, high: int, first: int, last: int) -> np.ndarray:
    """(period, low, high) in the whole text, from the words of a piece that begins at word `offset`.

    A fragment that is too short is left out unless it reaches an end of the piece and may go on there.
    """
    blocks, found, spacing = Blocks(words), [], low
    while spacing <= high:
        rows = stitched(tile_fragments(words, blocks, spacing, first - offset, last - offset))
        rows[:, 1:] += offset
        found.append(rows[long_enough(rows) | (rows[:, 1] <= first) | (rows[:, 2] >= last)])
        spacing *= 2
    return np.concatenate(found)


def joined(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> list[bytes]:
    """The given words of every text, joined by one space."""
    marks = np.zeros(len(data) + 1, np.int8)
    np.add.at(marks, starts, 1)
    np.add.at(marks, ends, -1)
    keep = np.cumsum(marks[:-1], dtype=np.int8).astype(bool)
    gap = ends[ends < offsets[doc + 1]]  # the white space behind a word, unless the text ends there
    data = data.copy()
    data[gap] = 0x20
    keep[gap] = True
    ahead = np.concatenate([[0], np.cumsum(keep)])
    body = data[keep].tobytes()
    return [body[a:b].rstrip(b" ") for a, b in zip(ahead[offsets[:-1]].tolist(), ahead[offsets[1:]].tolist())]


def words_of(texts: pa.Array) -> tuple:
    """Bytes, offsets of the texts, starts, ends and text numbers of their words, bounds of each text among the words."""
    data, offsets = flat(texts)
    starts, ends, doc = spans(~SPACE[data], offsets)
    return data, offsets, starts, ends, doc, np.searchsorted(doc, np.arange(len(texts) + 1))


def solve(rows: DataFrame) -> DataFrame:
    """Per row of (row, id, text): n_words, and the fragments; `plain_sha256` of the words joined by one space and no text if
    there are no fragments, else the text. A long text's row says nothing about fragments (null); its pieces follow in
    rows of their own."""
    schema = StructType([*rows.schema.fields[:2], *StructType.fromDDL(
        "n_words bigint, plain_sha256 string, text string, fragments array<struct<period: bigint, low: bigint, "
        "high: bigint>>, piece struct<low: int, high: int, first: bigint, last: bigint, offset: bigint, words: binary>").fields])
    piece_type = pa.struct([("low", pa.int32()), ("high", pa.int32()), ("first", pa.int64()), ("last", pa.int64()),
                            ("offset", pa.int64()), ("words", pa.binary())])

    def run(batches):
        for batch in batches:
            for part in sub_batches(batch, 2):
                data, offsets, starts, ends, doc, bounds = words_of(part.column(2))
                size = np.diff(bounds)
                words = span_hashes(data, starts, ends) if len(starts) else np.zeros(0, U64)
                long = size > LONG_WORDS
                short = np.where(long, 0, size)
                here = ~long[doc] if len(doc) else np.zeros(0, bool)
                text, rows = fragments_of_texts(words[here], np.concatenate([[0], np.cumsum(short)]))
                spots = np.searchsorted(text, np.arange(len(size) + 1)).astype(np.int32)
                found = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(3)],
                                                   names=["period", "low", "high"])
                lists = pa.ListArray.from_arrays(spots, found)
                rest = (np.diff(spots) == 0) & ~long
                plain = joined(data, offsets, starts, ends, doc)
                sha = [hashlib.sha256(p).hexdigest() if r else None for p, r in zip(plain, rest)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(size, pa.int64()), pa.array(sha, pa.string()),
                     part.column(2).take(pa.array(np.arange(len(size)), mask=rest)),
                     pa.array(lists.to_pylist(), lists.type, mask=long) if long.any() else lists,
                     pa.nulls(len(size), piece_type)], names=schema.names)
                for i in np.flatnonzero(long):
                    own = words[bounds[i]:bounds[i + 1]]
                    for low, high, first, last in pieces_of_text(len(own)):
                        begin, end = max(0, first - high), min(len(own), last + 4 * high)
                        piece = {"low": low, "high": high, "first": first, "last": last, "offset": begin,
                                 "words": own[begin:end].tobytes()}
                        yield pa.RecordBatch.from_arrays(
                            [part.column(0).slice(i, 1), part.column(1).slice(i, 1), pa.nulls(1, pa.int64()),
                             pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(FRAGMENT)),
                             pa.array([piece], piece_type)],
                            names=schema.names)

    return ship(rows).mapInArrow(run, schema)


def solve_pieces(pieces: DataFrame) -> DataFrame:
    """Fragments (row, period, low, high) of the pieces of long texts, which are dealt out evenly first."""
    schema = StructType.fromDDL("row bigint, period bigint, low bigint, high bigint")

    def run(batches):
        for batch in batches:
            for row, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = fragments_of_piece(np.frombuffer(piece["words"], U64), piece["offset"], piece["low"],
                                           piece["high"], piece["first"], piece["last"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), row)), *[pa.array(np.ascontiguousarray(found[:, i])) for i in range(3)]],
                    names=schema.names)

    dealt = pieces.select("row", "piece").repartition(F.xxhash64("row", "piece.low", "piece.first"))
    return ship(dealt).mapInArrow(run, schema)


def stitch(fragments: DataFrame) -> DataFrame:
    """(row, runs): fragments of a text and period that overlap or touch are one; what is too short goes."""
    along = Window.partitionBy("row", "period").orderBy("low", "high")
    reach = F.max("high").over(along.rowsBetween(Window.unboundedPreceding, -1))
    islands = (fragments.withColumn("new", F.coalesce(F.col("low") > reach, F.lit(True)).cast("int"))
               .withColumn("island", F.sum("new").over(along)))
    runs = (islands.groupBy("row", "period", "island").agg(F.min("low").alias("start"), F.max("high").alias("high"))
            .withColumn("length", F.col("high") - F.col("start") + F.col("period"))
            .filter((F.col("length") >= LEAST_WORDS) & (F.col("length") >= LEAST_PERIODS * F.col("period"))))
    one = F.struct("start", "period", "length")
    return runs.groupBy("row").agg(F.sort_array(F.collect_list(one)).alias("runs"))  # fewer runs than the text has words


def collapse(rows: DataFrame) -> DataFrame:
    """(id, n_words, text, runs) with `collapsed` for the text: words of a run beyond its first period are left out."""
    schema = StructType([rows.schema["id"], rows.schema["n_words"], rows.schema["runs"],
                         *StructType.fromDDL("collapsed string").fields])

    def run(batches):
        for batch in batches:
            for part in sub_batches(batch, 3):
                data, offsets, starts, ends, doc, bounds = words_of(part.column(3))
                runs = part.column(2)
                counts, every = np.diff(runs.offsets.to_numpy()), runs.flatten()
                start, period, length = (every.field(i).to_numpy() for i in range(3))
                base = bounds[np.repeat(np.arange(len(runs)), counts)]
                marks = np.zeros(len(starts) + 1, np.int64)
                np.add.at(marks, base + start + period, 1)
                np.add.at(marks, base + start + length, -1)
                keep = np.cumsum(marks[:-1]) == 0
                texts = joined(data, offsets, starts[keep], ends[keep], doc[keep])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())],
                    names=schema.names)

    return ship(rows.select("id", "n_words", "runs", "text")).mapInArrow(run, schema)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_words, runs (start, period, length; by start, then period), collapsed, collapsed_sha256.

    Words are runs of characters other than ASCII white space, numbered from 0. A run is a stretch of words with smallest
    period q and at least max(24, 3 q) words that can't be made longer. `collapsed` is the text's words, joined by one
    space, without those that some run holds beyond its first q words; it is null where there is no run, because nothing is
    left out there, and `collapsed_sha256` is the digest of the joined words in either case. A null, empty or blank text
    has no words and no runs. Very long texts are searched whole, in pieces on several tasks. Repeated rows and rows with a
    null id each get their result. Other columns are left out, whatever their names are. Empty table: no rows.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"),
                       F.col(f"`{text_col}`").alias("text"))
    solved = stage(solve(rows), "run-fragments")  # a row's number is stored with its solution, so both stay together
    texts, pieces = solved.filter(F.col("piece").isNull()), solved.filter(F.col("piece").isNotNull())
    known = texts.filter(F.size("fragments") > 0).select("row", F.inline("fragments"))
    runs = stitch(known.unionByName(solve_pieces(pieces)))
    none = F.array().cast(runs.schema["runs"].dataType)
    searched = texts.filter(F.col("text").isNotNull()).join(runs, "row", "left").withColumn("runs", F.coalesce("runs", none))
    found = collapse(searched).select("id", "n_words", "runs", F.when(F.size("runs") > 0, F.col("collapsed")).alias("collapsed"),
                                      F.sha2("collapsed", 256).alias("collapsed_sha256"))
    rest = texts.filter(F.col("text").isNull()).select(
        "id", "n_words", none.alias("runs"), F.lit(None).cast("string").alias("collapsed"),
        F.col("plain_sha256").alias("collapsed_sha256"))
    return found.unionByName(rest).withColumnRenamed("id", id_col)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The contract's texts: where 10 divides the crc32 h of the id, words from a = g % n on repeat with period p."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[ \\x09-\\x0D]+"), lambda w: w != "")
    one = F.struct(words.alias("w"), F.floor(crc / 10).alias("g"))

    def planted(s):  # `s` binds the words, so that they are split once and not for every word
        n = F.size(s["w"]).cast("long")
        return F.struct(s["w"].alias("w"), (s["g"] % n).alias("a"),
                        (1 + F.floor((n - s["g"] % n) / (3 + s["g"] % 8))).alias("p"))

    def repeated(s):
        return F.array_join(F.transform(s["w"], lambda w, i: F.when(i < s["a"], w).otherwise(
            F.get(s["w"], (s["a"] + (i - s["a"]) % s["p"]).cast("int")))), " ")

    filled = F.filter(F.array(one), lambda s: F.size(s["w"]) > 0)
    text = F.get(F.transform(F.transform(filled, planted), repeated), F.lit(0))
    return docs.withColumn("text", F.when((crc % 10 == 0) & F.col("text").isNotNull(), F.coalesce(text, F.col("text")))
                           .otherwise(F.col("text")))


def op11_scale_tiled_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = periodic_runs(with_planted_runs(docs))
    more = lambda a, b: (b["length"] * a["period"] > a["length"] * b["period"])  # noqa: E731  exact; ties keep the earlier run
    first = F.get("runs", F.lit(0))
    best = F.reduce("runs", first, lambda a, b: F.when(more(a, b), b).otherwise(a))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"),
                                                  F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return (rows.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), "collapsed_sha256"))
