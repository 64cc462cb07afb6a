"""Texts of Arrow batches as flat byte arrays: words, their hashes, and a helper that adds columns to a table.

Nothing here makes one Python object per word or per document; all work is on NumPy arrays over the bytes of
about `CHUNK` characters at a time, so memory is bounded by that and by the longest single text.
"""
from __future__ import annotations

import gc
import os
import shutil
import tempfile
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

CHUNK = 2_000_000
SLICE = 500_000  # bytes of texts at once for operators whose arrays take many times that
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "2m"  # of texts on their way to Python; the JVM holds them too
U64 = np.uint64
ODD, ODD_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32  # A-Z only


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (splitmix64): near values become independent bits."""
    x = values.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03))


@lru_cache(maxsize=2)
def powers(length: int, base: int) -> np.ndarray:
    factors = np.full(length, base, U64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


def _powers(length: int, base: int) -> np.ndarray:
    return powers(1 << max(19, (length + 1).bit_length()), base)[: length + 1]


@lru_cache(maxsize=None)
def _send(application_id: str, package: str) -> None:
    folder, name = os.path.split(package)
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="code-"), name), "zip", folder, name)
    SparkSession.getActiveSession().sparkContext.addPyFile(archive)


def ship(df: DataFrame) -> DataFrame:
    """Make sure that Python workers can import this package: where the environment does not say so, Spark sends it.

    Texts go to Python in batches of a few megabytes, unless the session says otherwise, so that long ones don't add up.
    """
    if df.sparkSession.conf.get(BATCH_SETTING, None) is None:
        df.sparkSession.conf.set(BATCH_SETTING, BATCH_BYTES)
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [os.path.abspath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]]
    if os.path.dirname(package) not in paths:
        _send(df.sparkSession.sparkContext.applicationId, package)
    return df


REMEMBERED: dict[str, Callable[[], None]] = {}  # how to let go what an operator remembers in a worker from task to task


def begin_task(owner: str = "") -> None:
    """Workers serve one stage after the other: whatever operators other than `owner` have remembered is let go."""
    for name, forget in REMEMBERED.items():
        if name != owner:
            forget()
    gc.collect()
    pa.default_memory_pool().release_unused()


def apart(docs: DataFrame, helpers: list[str], run: Callable[[DataFrame, dict[str, str]], DataFrame]) -> DataFrame:
    """`run` on `docs` whose columns that are named like one of `helpers` have other names meanwhile; it gets these too."""
    moved = {c: f"{c}\u00b7kept" for c in docs.columns if c in helpers}
    return run(docs.withColumnsRenamed(moved), moved).withColumnsRenamed({new: old for old, new in moved.items()})


def sub_batches(batch: pa.RecordBatch, column: int, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The rows in slices whose texts have about `limit` bytes together; a longer text is a slice of its own."""
    offsets = flat(batch.column(column))[1]
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield batch.slice(low, high - low)
        low = high


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and the offsets of the texts; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    low, high = int(offsets[0]), int(offsets[-1])
    body = np.frombuffer(data, np.uint8)[low:high] if data is not None and high > low else np.zeros(0, np.uint8)
    return body, offsets - low


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of True that don't cross an offset: their starts, ends, and the index of the text they are in."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges = offsets[:-1][offsets[:-1] < len(inside)]
    before = np.empty(len(inside), bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(inside), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets[:-1], starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for the bytes of each span."""
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_CODES[data] * _powers(len(data), ODD)[:-1], out=sums[1:])
    shifted = (sums[ends] - sums[starts]) * _powers(len(data), ODD_INVERSE)[starts]
    return mix(shifted + (ends - starts).astype(U64) * U64(0xA24BAED4963EE407))


def add_columns(docs: DataFrame, text_col: str, added: str, compute: Callable[[pa.Array], list],
                keep: list[str] | None = None, setup: Callable[[], Callable] | None = None, owner: str = "") -> DataFrame:
    """`docs` with the columns of `added` (a DDL string) that `compute` makes from the texts of a slice of rows.

    `keep` names the input columns that stay (default: all). An input column whose name is also in `added` is
    replaced. `setup` runs once per task and returns the function to use in place of `compute`; what `owner` remembers stays.
    """
    new = StructType.fromDDL(added)
    stay = [c for c in (docs.columns if keep is None else keep) if c not in new.names]
    schema = StructType([docs.schema[c] for c in stay] + list(new.fields))
    inputs = stay if text_col in stay else [*stay, text_col]
    place, names = inputs.index(text_col), schema.names

    def run(batches):
        begin_task(owner)
        call = setup() if setup else compute
        for batch in batches:
            for part in sub_batches(batch, place):
                arrays = [pa.array(a) if isinstance(a, np.ndarray) else a for a in call(part.column(place))]
                yield pa.RecordBatch.from_arrays([*part.columns[:len(stay)], *arrays], names=names)

    return ship(docs.select(*inputs)).mapInArrow(run, schema)
