"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A lookup table of at most this many rows may be sent to every executor
#: (tens of MB); beyond it the operators join by shuffling.
BROADCAST_ROWS = 1_000_000


#: Copies of a lookup row that is joined by shuffling, for rows of one key to go to as many tasks.
SALT = 16


def small_enough(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``limit`` rows."""
    return df.limit(limit + 1).count() <= limit


def join_hot(rows: DataFrame, lookup: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` joined with ``lookup``, which has one row for each ``key``: sent to all tasks if few, else each row to SALT parts by the hash of ``by``."""
    if small_enough(lookup):
        return rows.join(F.broadcast(lookup), key)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int"))
    return salted.join(lookup.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), [key, "salt"]).drop("salt")


def give_back() -> None:
    """Return to the system what Arrow and the C library keep for later: a Python worker outlives its task, beside the executor's JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def packed(docs: DataFrame, *columns: str) -> DataFrame:
    """``row`` (all columns of ``docs``) beside the named ones, doc_id and text unless given, so that no column's name can clash with an operator's own."""
    return docs.select(F.struct("*").alias("row"), *(columns or ("doc_id", "text")))


def crc_of_id(doc_id: str = "doc_id") -> Column:
    """Unsigned crc32 of the id's decimal text; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0))


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text, empty for null."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def one_label(labels: DataFrame, name: str) -> DataFrame:
    """``doc_id, label`` with one row for each id; rows with a null id or label are ignored, of several labels the largest holds."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(name).isNotNull()).groupBy(
        "doc_id").agg(F.max(F.col(name).cast("int")).alias("label"))


def with_label(docs: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """Inner join of ``docs`` with one label for each id; labels are broadcast only if few."""
    own = one_label(labels, name)
    own = F.broadcast(own) if small_enough(own) else own
    return docs.join(own, "doc_id")
