"""Continuous processing of a directory: each new file once, by the stream's checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def follow(
    spark: SparkSession,
    source: str,
    schema: str,
    work: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    forever: bool = False,
    pattern: str | None = None,
    at_once: int | None = None,
    again: Sequence[str] = (),
) -> StreamingQuery:
    """Parquet files of ``source`` through ``work`` into ``target``; stops after what is there unless ``forever``.

    Each file is processed once, as the checkpoint knows. ``pattern`` is a glob of
    file names, ``at_once`` the number of files a round takes. Files listed in
    ``again`` are read once more, as a table, after the stream's round.
    """
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if at_once:
        reader = reader.option("maxFilesPerTrigger", at_once)
    stream = work(reader.parquet(source)).writeStream.option("checkpointLocation", checkpoint)
    stream = stream.trigger(processingTime="15 seconds") if forever else stream.trigger(availableNow=True)
    query = stream.format("parquet").outputMode("append").start(target)
    if again:
        if not forever:
            query.awaitTermination()
        work(spark.read.schema(schema).parquet(*again)).write.mode("append").parquet(target)
    return query
