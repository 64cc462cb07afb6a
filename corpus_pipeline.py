"""From raw documents to packed training sequences, each stage written as Parquet and read again by the next.

A row is told from others by its content: two hashes of its id and text, under names that no column has. So a decision on one
row never touches another one that happens to share its id, and rows without an id are rows like all others.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from wattlens.llm import language, mixing, packing, pii, shingle_join
from wattlens.plans.staging import stage, staging_root

BROADCAST_ROWS = 300_000  # two hashes and a number: some 100 bytes each in a broadcast table
KEYS = ["_row_hash_1", "_row_hash_2"]


def _hint(table: DataFrame) -> DataFrame:
    """A stored table of rows' keys, broadcast if it is small; otherwise the join shuffles both sides."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({KEYS[0]: F.xxhash64(F.lit(1), "doc_id", "text"), KEYS[1]: F.xxhash64(F.lit(2), "text", "doc_id")})


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents of which no language can be told: no text, or no letter in it. Fill in languages that are missing.

    Where no document has a language to learn from, all with a letter stay, and `lang` stays null. Long texts are read
    whole; equal rows share their fate; a best score that several languages have goes to the first by name.
    """
    model = language.learn_from_documents(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    added = ["_lang_pred", "_lang_score"]
    texts = docs.withColumnsRenamed(dict(zip(("lang_pred", "score"), added)))  # names that the operator would replace
    found = language.identify(texts, model).filter(F.col("lang_pred") != language.UNKNOWN)
    filled = found.withColumn("lang", F.coalesce("lang", "lang_pred")).drop("lang_pred", "score")
    return filled.withColumnsRenamed(dict(zip(added, ("lang_pred", "score")))).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that links of five-word shingles with a similarity of 0.8 connect, one row stays: the one with the
    smallest id, rows without an id last, then by content; of rows that repeat an id and its text one.

    Texts without words link with nothing and stay, every row of them.
    """
    rows = stage(shingle_join.jaccard_components(_keyed(docs), keep=KEYS), "near-copies")
    grouped = rows.filter("component is not null")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), *KEYS)
    best = grouped.groupBy("component").agg(F.min(order).alias("_best")).select("_best.*")
    members = stage(grouped.groupBy(*KEYS).agg(F.count("*").alias("rows")), "near-copies")
    gone = stage(members.join(best, KEYS, "left_anti").select(KEYS), "near-copies")
    repeated = stage(members.filter("rows > 1").join(gone, KEYS, "left_anti").select(KEYS), "near-copies")
    kept = _keyed(docs).join(_hint(gone), KEYS, "left_anti")
    if repeated.limit(1).count():
        more = _hint(repeated)
        kept = kept.join(more, KEYS, "left_anti").unionByName(kept.join(more, KEYS, "left_semi").dropDuplicates(KEYS))
    return kept.select(docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates for all personal data and secrets; n_chars follows the text. No row goes; null texts stay null, repeated
    rows stay equal, and one entity has one surrogate in all documents."""
    done = pii.replace_entities(docs, pii.session_key(spark))
    chars = F.when(F.col("n_replaced") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", chars).select(docs.columns)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say; only rows that are not taken exactly once are joined. Every row is rated by its
    own text, with an id or without; repeated rows are rated alike."""
    rates = mixing.mix(_keyed(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=KEYS)
    other = stage(rates.groupBy(*KEYS).agg(F.min("copies").alias("_copies")).filter("_copies <> 1"), "copies")
    counted = _keyed(docs).join(_hint(other), KEYS, "left").withColumn("_copies", F.coalesce("_copies", F.lit(1)))
    taken = counted.filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
    return taken.select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in sequences of at most 2048 tokens. A null or empty text still has its
    closing token; repeated rows are packed each; ties between sequences don't change their number."""
    return packing.pack(docs)


STAGES = [("language", identify_language), ("near_copies", drop_near_copies), ("personal_data", replace_personal_data),
          ("mixing", mix_to_targets), ("best_fit_packing", pack_sequences)]
ORACLE_SQL = None  # models, graph search and packing are beyond SQL; tests compare with plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; what is between them goes to the folder that the cluster shares."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        path = f"{staging_root(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
