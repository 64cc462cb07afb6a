"""Stored tables in buckets of a key, so that later steps by that key need no shuffle and one key reads one bucket."""
from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from wattlens.plans.staging import staging_root

PARTITION_BYTES = 4_000_000  # of the files that a table is made from, for one of its partitions
UNKNOWN_BYTES = 1 << 60  # the optimizer's size of a source that tells none is larger
_KNOWN: dict[tuple[str, str], str] = {}  # finished tables of `stored_clustered` by application and key


def bucket_count(spark: SparkSession) -> int:
    """As many buckets as the session has shuffle partitions, which are sized for its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def enough_partitions(df: DataFrame) -> int:
    """The session's shuffle partitions, doubled until one stands for at most PARTITION_BYTES of the files that `df` reads.

    For steps that aren't stored as buckets: in a fixed number of partitions a task's windows, sorts and aggregates would need
    memory that grows with the table. Sources that tell no size, such as rows of the driver, don't count.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.length())]
    count, size = bucket_count(df.sparkSession), sum(s for s in sizes if s < UNKNOWN_BYTES)
    while count * PARTITION_BYTES < size:
        count *= 2
    return count


def dealt(df: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """Rows in the partitions that will be the buckets. Windows and aggregates by `key` on top of it keep them, so the whole
    way into a clustered table has one shuffle."""
    return df.repartition(buckets or bucket_count(df.sparkSession), key)


def clustered(df: DataFrame, key: str, order: list[str], label: str = "clustered", buckets: int | None = None) -> DataFrame:
    """Store `df`, whose partitions come from `dealt`, as one sorted file per bucket of `key`.

    Sorted files make the value ranges of row groups narrow, so a filter on the key reads few of them. Rows of one key share
    a bucket: use it where a key has a bounded number of rows, such as one a calendar day. The files lie below the cluster's
    shared folder; the table's name lives in the session's catalog.
    """
    return df.sparkSession.table(write_clustered(df, key, order, label, buckets))


def write_clustered(df: DataFrame, key: str, order: list[str], label: str, buckets: int | None = None) -> str:
    """The same; the table's name."""
    spark, count = df.sparkSession, buckets or bucket_count(df.sparkSession)
    name = f"{label}_{uuid.uuid4().hex}"
    (df.write.bucketBy(count, key).sortBy(key, *order).option("path", f"{staging_root(spark)}/{name}")
     .saveAsTable(name))
    return name


def stored_clustered(spark: SparkSession, known_as: str, build, key: str, order: list[str], label: str = "clustered") -> DataFrame:
    """A clustered table that later calls of the same application read again; counts only once its write has ended."""
    known = (spark.sparkContext.applicationId, known_as)
    if known in _KNOWN:
        try:
            return spark.table(_KNOWN[known])
        except AnalysisException:  # another session of the application has its own catalog
            pass
    _KNOWN[known] = write_clustered(build(), key, order, label)
    return spark.table(_KNOWN[known])
