"""Language identification with string kernels.

A text is the set of its character n-grams of 1 to 3 characters (lower-cased; runs of other characters than letters count
as one blank). The blended-spectrum presence kernel of two texts is the number of n-grams they share, divided by the
geometric mean of their numbers of n-grams. Landmarks (Nystroem) stand for the whole kernel matrix: kernel ridge
regression, one language against the rest, is solved in their space on a bounded sample of labelled rows. Scoring a
batch is two matrix products: presence x landmark presence, then kernel values x weights.

N-grams are known by their hash in 2 ** 18 places (collisions merge n-grams, in training and prediction alike), so a text of
any length has a bounded number of them.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from wattlens.llm.arrow_text import add_columns, begin_task, ship, sub_batches

PLACES = 1 << 18
ORDERS = 3
TRAINING_ROWS = 1600  # bound of the labelled sample, shared by the languages
LANDMARKS = 128
RIDGE = 1e-2
BATCH_ROWS = 128
UNKNOWN = "und"


def _letter_table() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: its lower case, or a blank if it is no letter; and whether it is a letter."""
    points = np.arange(0x110000, dtype=np.uint32)
    letter = np.fromiter((chr(c).isalpha() for c in range(len(points))), bool, len(points))
    lower = np.where(letter, points, np.uint32(0x20))
    for c in np.flatnonzero(letter).tolist():
        small = chr(c).lower()
        if len(small) == 1:
            lower[c] = ord(small)
    return lower, letter


_TABLE: list[np.ndarray] = []


def grams_of(texts: pa.Array) -> list[np.ndarray]:
    """The n-gram places of each text; None where a text is null or has no letter."""
    if not _TABLE:
        _TABLE.extend(_letter_table())
    lower, letter = _TABLE
    out, flags = [], np.zeros(PLACES, bool)
    for text in texts.to_pylist():
        points = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
        if not len(points) or not letter[points].any():
            out.append(None)
            continue
        chars = lower[points]
        blank = chars == 0x20
        chars = np.concatenate([[0x20], chars[~(blank & np.concatenate([[True], blank[:-1]]))], [0x20]]).astype(np.uint32)
        code = np.zeros(len(chars), np.uint32)
        flags[:] = False
        for n in range(1, ORDERS + 1):
            code = (code[:len(chars) - n + 1] * np.uint32(0x01000193)) ^ (chars[n - 1:] * np.uint32(0x9E3779B1) + np.uint32(n))
            mixed = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            flags[mixed >> np.uint32(14)] = True
        out.append(np.flatnonzero(flags).astype(np.int32))
    return out


def training_sample(rows: DataFrame, id_col: str, text_col: str, lang_col: str, bound: int) -> pd.DataFrame:
    """n-gram places of at most `bound` labelled rows, about as many of each language, chosen by a hash of the id.

    Only the chosen rows' n-gram sets reach the driver: `bound` rows of at most 2 ** 18 small integers.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(bound).collect()}
    if not counts:
        return pd.DataFrame({"lang": [], "grams": []})
    each = max(1, bound // len(counts))
    shares = pd.DataFrame({"_lang": list(counts), "_share": [min(1.0, 1.2 * each / n + 8 / n) for n in counts.values()]})
    table = F.broadcast(rows.sparkSession.createDataFrame(shares))  # at most `bound` rows
    picked = (rows.withColumn("_u", F.pmod(F.xxhash64(id_col, F.lit(11)), F.lit(1 << 30)) / float(1 << 30))
              .join(table, rows[lang_col] == F.col("_lang")).filter("_u < _share").select(text_col, "_lang", "_u"))

    def run(batches):
        begin_task()
        for batch in batches:
            for part in sub_batches(batch, 0):
                grams = grams_of(part.column(0))
                at = [i for i, g in enumerate(grams) if g is not None]
                yield pa.RecordBatch.from_arrays(
                    [part.column(1).take(pa.array(at, pa.int64())), part.column(2).take(pa.array(at, pa.int64())),
                     pa.array([grams[i] for i in at], pa.list_(pa.int32()))], names=["lang", "u", "grams"])

    found = ship(picked).mapInArrow(run, "lang string, u double, grams array<int>")
    own = Window.partitionBy("lang").orderBy("u")  # over the few rows picked of a language
    frame = found.withColumn("place", F.row_number().over(own)).filter(F.col("place") <= each).drop("place").toPandas()
    return frame.sort_values(["lang", "u"]).reset_index(drop=True)  # at most `bound` rows, or one of each language


class KernelModel:
    """Landmark presence over the n-grams that landmarks have, and one weight per landmark and language."""

    def __init__(self, sample: pd.DataFrame):
        self.languages, self.weights = sorted(sample["lang"].unique()), None
        if not self.languages:
            return
        grams, label = sample["grams"].to_list(), sample["lang"].to_numpy()
        order = sample.groupby("lang").cumcount().to_numpy()
        chosen = np.argsort(order, kind="stable")[:LANDMARKS]  # in turn from each language
        self.place = np.full(PLACES, -1, np.int32)
        used = np.unique(np.concatenate([grams[i] for i in chosen]))
        self.place[used] = np.arange(len(used))
        self.landmarks = self.presence([grams[i] for i in chosen]).T.copy()
        self.norms = np.sqrt([len(grams[i]) for i in chosen]).astype(np.float32)
        kernel = np.concatenate([self.kernel(grams[i:i + BATCH_ROWS])
                                 for i in range(0, len(grams), BATCH_ROWS)]).astype(float)
        between = kernel[chosen]
        target = np.array([[1.0 if x == lang else 0.0 for lang in self.languages] for x in label])
        # ridge in the landmarks' space: min |K w - y|^2 + ridge * n * w' K_landmarks w
        left = kernel.T @ kernel + RIDGE * len(grams) * between + 1e-9 * len(grams) * np.eye(len(chosen))
        self.weights = np.linalg.solve(left, kernel.T @ target).astype(np.float32)

    def presence(self, grams: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(grams), int(self.place.max()) + 1), np.float32)
        for row, own in enumerate(grams):
            at = self.place[own]
            out[row, at[at >= 0]] = 1
        return out

    def kernel(self, grams: list[np.ndarray]) -> np.ndarray:
        own = np.sqrt([max(1, len(g)) for g in grams]).astype(np.float32)
        return self.presence(grams) @ self.landmarks / own[:, None] / self.norms

    def predict(self, texts: pa.Array) -> list:
        languages, scores = [], []
        for low in range(0, len(texts), BATCH_ROWS):
            grams = grams_of(texts.slice(low, BATCH_ROWS))
            known = [i for i, g in enumerate(grams) if g is not None]
            names, values = [UNKNOWN] * len(grams), [0.0] * len(grams)
            if known and self.weights is not None:
                result = self.kernel([grams[i] for i in known]) @ self.weights
                for i, best, value in zip(known, result.argmax(axis=1), result.max(axis=1)):
                    names[i], values[i] = self.languages[best], float(min(1.0, max(0.0, value)))
            languages += names
            scores += values
        return [pa.array(languages, pa.string()), pa.array(scores, pa.float64())]


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        bound: int = TRAINING_ROWS) -> KernelModel:
    """Learn from at most `bound` of the rows whose language is not null. Without any, every prediction is `und`."""
    return KernelModel(training_sample(rows.filter(F.col(lang_col).isNotNull()), id_col, text_col, lang_col, bound))


def identify(docs: DataFrame, model: KernelModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add lang_pred and score (0 to 1) of every whole text; `und` and 0 if it is null or has no letter.

    Columns named lang_pred or score are replaced. Equal texts get equal results, very long ones are read whole; languages
    with the same score go by name. An empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most LANDMARKS n-gram sets
    return add_columns(docs, text_col, "lang_pred string, score double", None, keep, lambda: sent.value.predict)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def learn_from_documents(docs: DataFrame) -> KernelModel:
    """The model of the rows that are not held out (a null id is not)."""
    return fit(docs.filter(~F.coalesce(held_out(), F.lit(False))))


def op3_string_kernel_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, learn_from_documents(docs), keep=["doc_id"])
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
