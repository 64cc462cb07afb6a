"""Intermediate tables in the shared folder of the cluster.

A staged table cuts the lineage, survives the loss of executors, keeps column pruning and gives the
optimizer real sizes for its broadcast decisions.
"""
from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

_FINISHED: dict[tuple[str, str], str] = {}  # finished tables of `stored` by application and key


@lru_cache(maxsize=None)
def local_folder(application_id: str) -> str:
    """Temporary folder of a local test run."""
    return tempfile.mkdtemp(prefix="wattlens-")


def staging_root(spark: SparkSession) -> str:
    """Folder for staged tables: the cluster's `spark.checkpoint.dir`; a temporary one only in local tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = local_folder(spark.sparkContext.applicationId)
    return configured.rstrip("/") + "/wattlens-" + spark.sparkContext.applicationId


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write once, read back. Use where two or more later steps need the same expensive result."""
    path = f"{staging_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def identity(spark: SparkSession, folder: str) -> str:
    """Digest of the names, sizes and times of a folder's files; only their listing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    one = F.xxhash64("path", "length", "modificationTime")
    return str(files.agg(F.count("*").alias("n"), F.bit_xor(one).alias("x")).first())


def stored(spark: SparkSession, key: str, build, inputs: str | None = None) -> DataFrame:
    """A staged table that later calls of the same application read again.

    Every attempt writes to a fresh path, which counts only once the write has ended, so an interrupted one is
    simply done again. The table is also built again if its files are gone, or if files below `inputs` have changed.
    """
    known = (spark.sparkContext.applicationId, key + (identity(spark, inputs) if inputs else ""))
    if known in _FINISHED:
        try:
            return spark.read.parquet(_FINISHED[known])
        except AnalysisException:
            del _FINISHED[known]
    path = f"{staging_root(spark)}/stored-{uuid.uuid4().hex}"
    build().write.parquet(path)
    _FINISHED[known] = path
    return spark.read.parquet(path)
