"""Shared plumbing of the training-data operators.

Nothing outside this subpackage imports it. Tables are reached only through
Spark's readers, and intermediate tables go to the shared folder that the
session names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import functools
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of anything but space and the five ASCII controls 9-13.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch.
BATCH = 512
#: Keys that are broadcast to be joined at most, and the least rows that make one of them.
HOT_KEYS, HOT_ROWS = 10_000, 1000
#: Keys of 8 bytes up to which a list of rows is broadcast.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="tessera-")


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application in the one that driver and executors share.

    The shared folder is read from the session. Where it is unset a temporary
    folder stands in if there is one machine only; on a cluster executors would
    write where nobody reads, so that is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = _own_folder()
    return f"{shared.rstrip('/')}/tessera-{spark.sparkContext.applicationId}"


def durable(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage and survives the loss of executors; a later job
    rereads the files instead of recomputing what led to them. The files stay
    until ``clear``, since results may be read from them later.
    """
    spark = small_batches(df.sparkSession)
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def forget(*tables: DataFrame) -> None:
    """Delete results of ``durable`` that no later step reads: what was made of them is written itself.

    Spark deletes the shuffle files and broadcasts of the jobs before once the
    driver has collected their handles. In a long chain of steps that comes late,
    with a full heap, so it is asked for here.
    """
    for df in tables:
        _delete(df.sparkSession, df.written_at)
    gc.collect()
    tables[0].sparkSession.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> SparkSession:
    """The session, in which texts go to Python ``BATCH`` rows at a time, unless it has a number of its own.

    Spark's default of 10000 rows is meant for short rows; of whole texts that
    many take a large part of an executor's memory, in the JVM and in Python.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH))
    return spark


def clear(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; results that weren't written elsewhere go with them."""
    _delete(spark, shared_dir(spark))


def without_rows(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` whose ``_row`` isn't in ``gone``, which is written and counted first: up to ``BROADCAST_ROWS`` keys are broadcast."""
    gone = durable(gone.select("_row").distinct(), "gone")
    return rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, "_row", "left_anti")


def attached(rows: DataFrame, table: DataFrame, key: list[str], members: str, total: int) -> DataFrame:
    """``rows`` left joined with ``table``, which has one row a key and its number of ``members`` in ``rows``.

    Keys with a ``HOT_KEYS``-th of all rows or more are broadcast: there are
    ``HOT_KEYS`` of them at most, whatever the input. So no task gets the rows of
    a frequent key, and the others are joined by a shuffle.
    """
    bound = max(HOT_ROWS, total // HOT_KEYS)
    hot = F.broadcast(table.where(F.col(members) >= bound))
    rest = rows.join(F.broadcast(table.where(F.col(members) >= bound).select(*key)), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(table.where(F.col(members) < bound), key, "left"))


def ranked(rows: DataFrame, order: list[Column], rank: str, sums: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with ``rank`` from 0 in a total order, and sums over the rows before: ``sums`` has the column of each.

    Rows are cut into ranges of the order, which are sorted apart; only a row
    for each range is gathered to add up where it begins.
    """
    sums = sums or {}
    cut = rows.repartitionByRange(partitions(rows), *order).withColumn("_part", F.spark_partition_id())
    cut = durable(cut, "ranked")
    parts = cut.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ["_n", *(f"_{n}" for n in sums)]])
    inside = Window.partitionBy("_part").orderBy(*order)
    out = cut.withColumn(rank, (F.row_number().over(inside) - 1).cast("long"))
    for name, column in sums.items():
        out = out.withColumn(name, F.coalesce(F.sum(column).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = out.join(F.broadcast(parts), "_part").withColumn(rank, F.col(rank) + F.col("_n"))
    for name in sums:
        out = out.withColumn(name, F.col(name) + F.col(f"_{name}"))
    return out.drop("_part", "_n", *[f"_{n}" for n in sums])


def numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(``_row``, ``doc``): a key of each row's own in the order of doc_id, null last, and the row; and whether the key is another than doc_id.

    The key is the doc_id itself where each row has its own; otherwise the rows
    are sorted, numbered and written, so that the number stays. The row is one
    column, so that no name in it can clash.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("_row"), F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    twice = rows.groupBy("_row").agg(F.count("*").alias("n")).where("n > 1 or _row is null")
    if twice.isEmpty():
        return rows, False
    # rows of one key are dealt over tasks by where they stand
    order = [F.col("_row").asc_nulls_last(), F.monotonically_increasing_id()]
    return durable(rows.orderBy(*order).withColumn("_row", F.monotonically_increasing_id()), "keyed"), True


def keyed(docs: DataFrame) -> DataFrame:
    """The rows as ``_row`` and ``doc``, see ``numbered``."""
    return numbered(docs)[0]


def by_row(rows: DataFrame, *columns: str) -> DataFrame:
    """These columns of ``keyed`` rows, with their key for a doc_id."""
    return rows.select(F.col("_row").alias("doc_id"), *[F.col("doc")[c].alias(c) for c in columns])


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions, for explicit repartitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
