"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.cluster import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that text operators read, whatever else the table holds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


#: Bytes of an Arrow batch at most: what a task holds of its input at a time, in the JVM and again in Python.
BATCH_BYTES = 16 << 20


@lru_cache(1)
def _allocator() -> ctypes.CDLL | None:
    """The C library, if its allocator can be told to return what is free."""
    library = ctypes.CDLL(None)
    return library if hasattr(library, "malloc_trim") else None


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks, and others need it meanwhile."""
    pa.default_memory_pool().release_unused()
    if library := _allocator():
        library.malloc_trim(0)


def begin(keeps: str | None) -> None:
    for name in [n for n in remembered if n != keeps]:
        del remembered[name]
    give_back()


#: What a worker process remembers from task to task, by name.
remembered: dict[str, object] = {}


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str, keeps: str | None = None) -> DataFrame:
    """mapInArrow with this package on the executors and batches of bounded size, which is a setting of the session.

    Of what a worker remembers only ``keeps`` outlives the start of this task, so that no
    operator's memory burdens the next one's tasks.
    """
    ship_package(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(keeps)
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def bytes_list(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def bucket5(doc_id: str = "doc_id"):
    """crc32 of the id's decimal text, mod 5; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def least_by_crc(rows: DataFrame, n: int) -> DataFrame:
    """The n rows with the smallest (crc32 of doc_id, doc_id).

    A histogram of the crc's leading 16 bits bounds them first, so that only about n rows are sorted.
    """
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    lead = F.shiftright(crc, 16)
    seen, bound = 0, -1
    for r in rows.groupBy(lead.alias("lead")).agg(F.count("*").alias("n")).orderBy("lead").collect():  # 65,536 rows at most
        if seen >= n:
            break
        seen, bound = seen + r["n"], r["lead"]
    return rows.where(lead <= bound).orderBy(crc, "doc_id").limit(n)


def release(spark: SparkSession) -> None:
    """Let Spark's context cleaner drop the shuffle files of jobs that are over and written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def quoted(name: str) -> str:
    """A column name as Spark reads it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def whole_rows(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text, th): each row packed into one column, so that no name of the table can clash, and what identifies it.

    ``th`` is the hash of the text, null counting as empty; rows of one doc_id and text are treated alike.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.struct(*(F.col(quoted(c)).alias(c) for c in docs.columns))
    return docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))


def join_documents(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on (doc_id, th), nulls equal; the right side's keys are dropped."""
    r = right.withColumnsRenamed({"doc_id": "_id", "th": "_th"})
    return left.join(r, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), how).drop("_id", "_th")


def unpacked(rows: DataFrame, columns: list[str], **changed):
    """The columns of packed rows, some of them replaced."""
    return rows.select(*(changed[c].alias(c) if c in changed else F.col("row")[c].alias(c) for c in columns))
