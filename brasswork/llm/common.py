"""What the operators of this subpackage share: row keys, scratch tables, bounded label samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_texts(documents: DataFrame) -> DataFrame:
    """doc_id and text alone; a null text is an empty one. Other columns, whatever their names, are left out."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of doc_id as text leaves this remainder; a null doc_id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def row_key() -> Column:
    """Names a row by its doc_id and text. Repeated rows share it, and with it their results."""
    return F.xxhash64(F.col("doc_id"), F.col("text"), F.length("text"))


class Scratch:
    """Tables written in the folder that driver and executors share, which cut lineage and survive a lost executor.

    The folder is spark.checkpoint.dir of the session. Only where that is unset (a local session, as in tests)
    a temporary folder of this machine is used. Operators drop what their result doesn't read; what it reads stays
    until clear_scratch, or until whoever owns the folder empties it.
    """

    made: list[Scratch] = []  # those of this process whose tables may still be there

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.partition("[")[0] == "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="brasswork-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.base = f"{root}/{uuid.uuid4().hex}"
        Scratch.made.append(self)

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        frame.write.parquet(path)
        return self.read(name, frame.schema)

    def read(self, name: str, schema: StructType) -> DataFrame:
        """A kept table, read anew: a frame of its own, which can be joined with others of the same table."""
        return self.spark.read.schema(schema).parquet(f"{self.base}/{name}")

    def _delete(self, folder: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.base}/{name}")


def clear_scratch(since: int = 0) -> None:
    """Deletes the tables of all Scratch objects but the first `since`; to be called when their results are written elsewhere."""
    while len(Scratch.made) > since:
        old = Scratch.made.pop()
        old._delete(old.base)


def labelled_sample(spark: SparkSession, sf_dir: str, column: str, max_rows: int, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """Text and label of at most max_rows labelled rows outside the held-out fold, in the order of a hash of doc_id."""
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).alias("label"))
    labels = labels.where(~held_out(modulus, remainder) & F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    few = labels.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    # at most max_rows rows of two numbers: a bounded side
    return doc_texts(read_table(spark, sf_dir, "documents")).join(F.broadcast(few), "doc_id").select("text", "label")


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to a size that bounds what a worker holds at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
