"""Helpers shared by the corpus operators: the shared folder, written tables, free column names."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


try:
    LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library: nothing to trim with
    LIBC = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a temporary one in local mode and one in the warehouse on a cluster."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        alone = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master)
        found = tempfile.mkdtemp(prefix="creatorlake-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Spark's own settings: what a query has shuffled goes when it is done, not when the driver collects its garbage; a batch for Python has 4 MB, whatever its rows hold.
LIGHT = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


@contextmanager
def light(spark: SparkSession) -> Iterator[None]:
    """Queries in here leave no shuffle files and send small batches; for work that writes many tables one after the other, each read again from there."""
    before = {key: spark.conf.get(key, None) for key in LIGHT}
    for key, value in LIGHT.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def written(df: DataFrame, label: str, tidy: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: it is computed once, and a lost executor costs only what it was doing.

    tidy: its shuffle files go as soon as it is written.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    with light(df.sparkSession) if tidy else nullcontext():
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(df: DataFrame, *names: str) -> list[str]:
    """Column names starting with the given ones that df doesn't have, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def column_of(df: DataFrame, name: str) -> str:
    """The name as df writes it; case doesn't count."""
    return next((c for c in df.columns if c.lower() == name.lower()), name)


def looked_up(rows: DataFrame, table: DataFrame, key: str | list[str], times: str, total: int) -> DataFrame:
    """The inner join of rows with table, which has one row for each key and in `times` how often rows has it.

    Keys of more than a thousandth of the total (so fewer than a thousand of them) are sent to every task, so no task
    gets all rows of such a key; the others meet by their key. rows is read twice.
    """
    most = max(1_000, total // 1_000)
    often, seldom = F.broadcast(table.filter(F.col(times) > most).drop(times)), table.filter(F.col(times) <= most).drop(times)
    return rows.join(often, key).unionByName(rows.join(often.select(*([key] if isinstance(key, str) else key)), key, "left_anti").join(seldom, key))


def staying(df: DataFrame, ident: str, digest: Column, decided: DataFrame) -> DataFrame:
    """The rows of df that stay; of rows equal in ident and digest, one.

    decided: ident, t (the digest), times (how many such rows df has) and stays, true or null. Only what goes is joined with df.
    """
    mark, i, u = free(df, "__digest", "__ident", "__of")
    marked = df.withColumn(mark, digest)

    def only(x: DataFrame, which: DataFrame, how: str) -> DataFrame:
        which = which.select(F.col("ident").alias(i), F.col("t").alias(u))
        return x.join(which, x[ident].eqNullSafe(which[i]) & (x[mark] == which[u]), how)

    left = only(marked, decided.filter("stays is null"), "left_anti")
    again = decided.filter("stays and times > 1")
    if not again.isEmpty():
        left = only(left, again, "left_anti").unionByName(only(left, again, "left_semi").dropDuplicates([ident, mark]))
    return left.drop(mark)


def chunks(column: pa.Array, most: int = 1_000_000):
    """Index ranges (start, end) of a text column with about `most` bytes each, so that what is made of them stays small."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(column).fill_null(0).to_pylist()):
        size += n
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(column):
        yield start, len(column)


def _trim() -> None:
    """Give freed memory back, so that workers that stay alive between stages stay small."""
    pa.default_memory_pool().release_unused()
    if LIBC is not None:
        LIBC.malloc_trim(0)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so that what is made of one stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
        _trim()


def each_text(column: pa.Array, rows: int = 256):
    """The texts of a column one by one, few of them held as Python strings at a time."""
    for i in range(0, len(column), rows):
        yield from column.slice(i, rows).to_pylist()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
