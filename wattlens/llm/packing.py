"""Best-fit packing with large-item matching, decided on the number of pieces of each length.

Lengths are integers up to the capacity, so a plan for any number of pieces is made from a table of at most
`capacity` counts. Pieces above one third of the capacity are matched in pairs (no bin holds three of them), longest
first with the longest that fits. Smaller ones go, longest first, into the tightest gap that takes them. The plan lists
which ranks of a length go where; a piece finds its place by its rank among the pieces of its length.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from wattlens.llm.arrow_text import SLICE, begin_task, ship, sub_batches
from wattlens.llm.tokens import OWNER, default_tokenizer, pieces
from wattlens.plans.joins import lookup_join
from wattlens.plans.staging import stage

CAPACITY = 2048
END_ID = 0


def plan_bins(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, end rank, first bin, times, offset): ranks first..end-1 of a length go, `times` to a bin,
    into the bins from the first one on, at the offset. Work and result depend on the capacity, not on the counts."""
    left = {int(k): int(v) for k, v in counts.items() if v}
    open_bins: list[list[tuple[int, tuple]]] = [[] for _ in range(capacity + 1)]  # by gap: (bins, contents)
    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for size in large:
        while left[size]:
            partner = next((p for p in large if p <= min(size, capacity - size) and left[p] - (p == size) > 0), None)
            if partner is None:
                open_bins[capacity - size].append((left[size], ((size, 1),)))
                left[size] = 0
            elif partner == size:
                n = left[size] // 2
                open_bins[capacity - 2 * size].append((n, ((size, 2),)))
                left[size] -= 2 * n
            else:
                n = min(left[size], left[partner])
                open_bins[capacity - size - partner].append((n, ((size, 1), (partner, 1))))
                left[size] -= n
                left[partner] -= n
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        todo, gap = left[size], size
        while todo:
            while gap < capacity and not open_bins[gap]:
                gap += 1
            bins, contents = open_bins[gap].pop() if open_bins[gap] else (-(-todo // (capacity // size)), ())
            each = gap // size
            full = min(bins, todo // each)
            rest = min(todo - full * each, each - 1) if full < bins else 0
            for n, times in ((full, each), (int(rest > 0), rest), (bins - full - (rest > 0), 0)):
                if n and (times or contents):
                    after = contents + (((size, times),) if times else ())
                    open_bins[gap - times * size].append((n, after))
            todo -= full * each + rest
    rows, rank, first_bin = [], dict.fromkeys(left, 0), 0
    for group in open_bins:
        for bins, contents in group:
            offset = 0
            for size, times in contents:
                rows.append((size, rank[size], rank[size] + bins * times, first_bin, times, offset))
                rank[size] += bins * times
                offset += size * times
            first_bin += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def cut_documents(docs: DataFrame, id_col: str, text_col: str, tokenizer: str | None, capacity: int, end_id: int,
                  with_ids: bool) -> DataFrame:
    """One row per piece of a document's ids (closed by `end_id`), with the piece's number among those of its length in
    its task (`_part`, `_nth`)."""
    path = tokenizer or default_tokenizer()
    schema = StructType([docs.schema[id_col], *StructType.fromDDL(
        "piece int, start bigint, length bigint, ids_crc32 bigint, _part int, _nth bigint"
        + (", ids array<int>" if with_ids else "")).fields])

    def run(batches):
        from pyspark import TaskContext
        begin_task(OWNER)
        part, own, seen = TaskContext.get().partitionId(), pieces(path), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for rows in sub_batches(batch, 1, SLICE):
                body, sizes = own.ids(rows.column(1))
                ends = np.cumsum(sizes)
                flat_ids = np.insert(body, ends, end_id).astype("<u4")
                sizes = sizes + 1
                n_pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), n_pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                start = piece * capacity
                length = np.minimum(sizes[row] - start, capacity)
                begin = (np.cumsum(sizes) - sizes)[row] + start
                crc = [zlib.crc32(flat_ids[a:a + n]) for a, n in zip(begin.tolist(), length.tolist())]
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                run_start = np.searchsorted(ordered, ordered, "left")
                nth = np.empty(len(length), np.int64)
                nth[order] = seen[ordered] + np.arange(len(ordered)) - run_start
                seen += np.bincount(length, minlength=capacity + 1)
                columns = [rows.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start),
                           pa.array(length), pa.array(np.array(crc, np.int64)),
                           pa.array(np.full(len(row), part, np.int32)), pa.array(nth)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(np.append(begin, len(flat_ids)).astype(np.int32),
                                                            pa.array(flat_ids.view(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return ship(docs.select(id_col, text_col)).mapInArrow(run, schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
         capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most `capacity` ids.

    A document's ids are those of its text followed by `end_id`; a null or empty text has that id alone. Documents longer
    than the capacity are cut into pieces of it, the last may be shorter. Returns per piece: the id column, piece, start
    (ids of the document before it), length, ids_crc32, sequence_id, offset, and with `with_ids` the ids. Rows that repeat
    an id are documents of their own; null ids stay null; other columns are left out. An empty table gives no rows.

    The counts by length (at most `capacity` rows) and the plan made from them are all that passes the driver.
    """
    cut = stage(cut_documents(docs, id_col, text_col, tokenizer, capacity, end_id, with_ids), "pieces")
    per_part = cut.groupBy("_part", "length").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(per_part.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "piece-counts")
    counts = {r["length"]: r["n"] for r in offsets.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    plan = plan_bins(counts, capacity)
    ranked = (lookup_join(cut, offsets.drop("_n"), ["_part", "length"], spread=["_nth"], how="inner")
              .withColumn("_rank", F.col("_before") + F.col("_nth")).drop("_before", "_nth", "_part"))
    keep = [c for c in ranked.columns if c != "_rank"]
    schema = StructType([ranked.schema[c] for c in keep]
                        + list(StructType.fromDDL("sequence_id bigint, offset bigint").fields))
    # a piece's interval: intervals are sorted by (length, first rank), so one search over length * big + rank finds it
    big = max(counts.values(), default=0) + 1
    keys = plan[:, 0] * big + plan[:, 1] if len(plan) else np.zeros(0, np.int64)

    def place(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            at = plan[np.searchsorted(keys, length * big + rank, "right") - 1]
            inside = rank - at[:, 1]
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(at[:, 3] + inside // at[:, 4]), pa.array(at[:, 5] + inside % at[:, 4] * length)],
                names=schema.names)

    return ranked.mapInArrow(place, schema)


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
