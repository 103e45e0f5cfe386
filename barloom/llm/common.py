"""What the corpus operators share: table access, lineage cuts and row keys."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands in for a null doc_id where ids are compared: a null id is larger than every id.
NULL_ID = 2**63 - 1
#: Keys with more than one in so many rows are joined by broadcast: there are fewer of them than this.
HOT_KEYS = 1000
#: The contract's words: runs of anything but blanks and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset, a folder of our own in local runs and an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="barloom-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of our own, wherever its file system is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def hashes(*columns: Column | str) -> tuple[Column, Column]:
    """Two 64-bit hashes from different seeds: together a key that distinct values do not share by chance at any size."""
    return tuple(F.xxhash64(F.lit(seed), *columns) for seed in (1, 2))


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, k1, k2, text): the columns that text operators read; a null text is empty.

    (k1, k2) is the key of a row: rows that agree in id and text share it and get equal results.
    """
    k1, k2 = hashes(doc_id, text)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def unused(name: str, *frames: DataFrame) -> str:
    """``name`` with as many underscores before it as no column of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Distinct longs in a new column. The rows are checkpointed first, so every later read gives them the same numbers."""
    return cut(df).withColumn(name, F.monotonically_increasing_id())


def join_sized(left: DataFrame, right: DataFrame, keys: list[str], rows: str, total: int) -> DataFrame:
    """Inner join with a ``right`` of one row a key, whose column ``rows`` counts the key's rows in ``left`` (``total`` in all).

    Keys with over a thousandth of all rows are at most a thousand, so these are broadcast
    and their rows stay where they are; no other key can make a task large.
    """
    hot = F.col(rows) * HOT_KEYS > total
    few, rest = F.broadcast(right.where(hot)), right.where(~hot)
    return left.join(few, keys).unionByName(left.join(F.broadcast(right.where(hot).select(*keys)), keys, "left_anti").join(rest, keys))


def pieces(size: int, small: int, count: int, large: int, least: int = 16) -> int:
    """How many pieces ``size`` bytes make: of ``small`` bytes up to ``count`` pieces, of up to ``large`` bytes beyond."""
    return max(least, min(size // small, max(count, size // large)))


def source_partitions(df: DataFrame) -> int:
    """How many tasks read ``df``: follows the input's size without a pass over it."""
    return max(1, df.select(*df.columns[:1]).rdd.getNumPartitions())


def batches(rows: Iterator[pa.RecordBatch], text: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Split Arrow batches so that the text of each holds ``max_bytes`` at most, or is one row."""
    for batch in rows:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and held + n > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)
