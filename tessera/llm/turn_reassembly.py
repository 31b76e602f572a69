"""Conversations put together again from turns that arrive late, twice and in any order.

Method: hash buckets with a timing wheel, as a stateful Structured Streaming
query. The grouping key of the stream is a bucket, a hash of the conversation,
and a bucket's state holds a record for each of its conversations and a wheel of
``idle + 1`` slots. An arrival raises the record's generation and files
(conversation, generation) in the slot of the batch in which it will have been
silent for ``idle`` batches; older entries stay where they are and are known by
their generation as void. Every batch brings a tick to every bucket, also an
empty one. A tick visits its due slot only; the last one, after all batches,
visits all of them.

Payloads pass neither through Python nor into the state: the stream reads the
numbers and roles of the turns, which are reduced before to one row a turn and
batch, and its events name the batch that a kept turn came in. The written
batches give the payload by a join. ``BUCKET`` conversations make a bucket, so
more input means more buckets, not larger ones. A conversation is the unit: what
its bucket holds of it are the numbers and roles of the turns that wait for an
earlier one, and of a closed one its name. Batches, checkpoint and result are in
the shared folder, a new one for each call, so lost executors and a restart
between batches lose and repeat nothing. The state store is the session's.

Defined results: rows without a turn are dropped; a null role or text is empty;
rows without conv_id are one conversation, with a null conv_id; of rows of one
turn in one batch the smallest payload in bytes arrives, of equal payloads the
one with the smaller role; a closed conversation never opens again; very long
texts are read whole; without a turn at all the result is empty; further
columns are not read.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import attached, durable, partitions, shared_dir, small_batches

#: Conversations of a bucket.
BUCKET = 1000
#: Events of a frame.
FRAME = 2000
ARRIVALS = "batch int, bucket long, tick boolean, conv string, first long, turn long, role string"
EVENTS = "event string, conv string, turn long, batch int, came int, unreleased string, n_missing long, n_breaks long"


class _Talk:
    """The record of an open conversation."""

    __slots__ = ("first", "next", "role", "breaks", "generation", "waiting")

    def __init__(self, first: int):
        self.first = self.next = first
        self.role, self.breaks, self.generation = "", 0, 0
        self.waiting: dict[int, tuple[str, int]] = {}  # role, and batch it came in

    def packed(self) -> tuple:
        return self.first, self.next, self.role, self.breaks, self.generation, self.waiting

    @classmethod
    def unpacked(cls, row: tuple) -> _Talk:
        talk = cls(row[0])
        _, talk.next, talk.role, talk.breaks, talk.generation, talk.waiting = row
        return talk

    def released(self) -> Iterator[tuple[int, int]]:
        """The turns that nothing is missing before, with the batch they came in."""
        while self.next in self.waiting:
            turn, (role, came) = self.next, self.waiting.pop(self.next)
            self.breaks += turn > self.first and role == self.role
            self.role, self.next = role, turn + 1
            yield turn, came

    def closing(self) -> tuple[str, int, int]:
        """Turns kept and not released, number of unkept ones up to the largest kept, and breaks of all."""
        turns = sorted(self.waiting)
        largest = turns[-1] if turns else self.next - 1
        breaks = sum(self.waiting.get(t - 1, ("",))[0] == self.waiting[t][0] for t in turns if t - 1 in self.waiting)
        return ",".join(map(str, turns)), largest + 1 - self.next - len(turns), self.breaks + breaks


class Bucket:
    """Records of conversations, None where one is closed, and the wheel of their closing batches."""

    def __init__(self, idle: int, packed: bytes | None = None):
        talks, self.wheel = pickle.loads(packed) if packed else ({}, [[] for _ in range(idle + 1)])
        self.talks = {conv: row and _Talk.unpacked(row) for conv, row in talks.items()}
        self.idle = idle

    def packed(self) -> bytes:
        return pickle.dumps(({conv: talk and talk.packed() for conv, talk in self.talks.items()}, self.wheel), 5)

    def arrive(self, batch: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        """The events of a batch's arrivals (conv, first, turn, role)."""
        touched = {}
        for conv, first, turn, role in rows:
            talk = self.talks.get(conv)
            if talk is None:
                if conv in self.talks:
                    yield "reject", conv, turn, batch, batch, None, None, None
                    continue
                talk = self.talks[conv] = _Talk(first)
            touched[conv] = talk
            if turn >= talk.next and turn not in talk.waiting:
                talk.waiting[turn] = (role, batch)
        due = self.wheel[(batch + self.idle) % len(self.wheel)]
        for conv, talk in touched.items():
            for turn, came in talk.released():
                yield "release", conv, turn, batch, came, None, None, None
            talk.generation += 1
            due.append((conv, talk.generation))

    def tick(self, batch: int, final: bool) -> Iterator[tuple]:
        """The events of conversations that close with this batch: those in its slot, or all."""
        for i in range(len(self.wheel)) if final else [batch % len(self.wheel)]:
            due, self.wheel[i] = self.wheel[i], []
            for conv, generation in due:
                talk = self.talks[conv]
                if talk and talk.generation == generation:
                    self.talks[conv] = None
                    yield "close", conv, -1, batch, None, *talk.closing()


def _frames(events: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    names, rows = [x.split()[0] for x in EVENTS.split(", ")], []
    for event in events:
        rows.append(event)
        if len(rows) >= FRAME:
            yield pd.DataFrame(rows, columns=names, dtype=object)
            rows = []
    yield pd.DataFrame(rows, columns=names, dtype=object)


def _step(last: int, idle: int):
    """A bucket's arrivals of one batch and its tick."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        bucket, batch = Bucket(idle, state.get[0] if state.exists else None), None

        def arrived() -> Iterator[tuple]:
            nonlocal batch
            for frame in frames:
                batch = int(frame["batch"].iloc[0])
                frame = frame[~frame["tick"]]
                yield from zip(*(frame[c].tolist() for c in ("conv", "first", "turn", "role")), strict=True)

        def events() -> Iterator[tuple]:
            rows = list(arrived())
            yield from bucket.arrive(batch, rows)
            yield from bucket.tick(batch, batch == last)

        yield from _frames(events())
        state.update((bucket.packed(),))

    return step


def _hash(conv: Column, turn: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat(conv, F.lit(":"), turn.cast("string")), 256), 1, 8), 16, 10).cast("long")


def arrivals(conversations: DataFrame, batches: int = 12) -> DataFrame:
    """(batch, conv, first, turn, role, payload): one row for each turn and batch in which it arrives."""
    conv, turn = F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.col("turn").cast("long")
    rows = conversations.where("turn is not null").select(
        conv.alias("conv"), turn.alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), _hash(conv, turn).alias("h")
    )
    once = F.struct((F.col("h") % batches).cast("int").alias("batch"), F.col("role"))
    again = F.struct(((F.col("h") + 3) % batches).cast("int").alias("batch"), F.lit("user").alias("role"))
    rows = rows.withColumn("at", F.explode(F.when(F.col("h") % 7 < 2, F.array(once, again)).otherwise(F.array(once))))
    rows = rows.groupBy("conv", "turn", F.col("at.batch").alias("batch")).agg(
        F.min(F.struct(F.concat("at.role", F.lit("|"), "text").alias("payload"), F.col("at.role").alias("role"))).alias("least")
    )
    rows = durable(rows.select("batch", "conv", "turn", "least.role", "least.payload"), "turns")
    firsts = durable(rows.groupBy("conv").agg(F.min("turn").alias("first"), F.count("*").alias("n_turns")), "first-turns")
    rows = attached(rows, firsts, ["conv"], "n_turns", rows.count())
    return rows.select("batch", "conv", "first", "turn", "role", "payload")


def _move(spark: SparkSession, source: str, target: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.rename(path(source), path(target)):
        raise OSError(f"{source} can't be moved to {target}")


def reassemble(rows: DataFrame, batches: int = 12, idle: int = 3, bucket: int = BUCKET) -> DataFrame:
    """The events of a stream of ``arrivals``: release and reject with the payload, close with the turns kept and not released.

    The batches are written to the shared folder, then moved one by one to where
    the stream reads, which is started anew for each on the same checkpoint.
    """
    spark, n = small_batches(rows.sparkSession), partitions(rows)
    folder = f"{shared_dir(spark)}/reassembly-{uuid.uuid4().hex}"
    buckets = max(n, rows.agg(F.approx_count_distinct("conv")).first()[0] // bucket)
    hashed = rows.withColumns({"bucket": F.pmod(F.xxhash64("conv"), F.lit(buckets)), "tick": F.lit(False)})
    ticks = spark.range(buckets).select(F.explode(F.sequence(F.lit(0), F.lit(batches))).alias("batch"), F.col("id").alias("bucket"))
    ticks = ticks.withColumns({"tick": F.lit(True), "first": F.lit(0).cast("long"), "turn": F.lit(0).cast("long")})
    out = hashed.unionByName(ticks, allowMissingColumns=True).withColumn("at", F.col("batch"))
    slices = F.pmod("bucket", F.lit(max(1, n // (batches + 1))))
    out.repartition(n, "at", slices).write.partitionBy("at").parquet(f"{folder}/batches")

    feed, result = f"{folder}/feed", f"{folder}/events"
    spark.createDataFrame([], ARRIVALS).write.parquet(feed)
    for batch in range(batches + 1):
        _move(spark, f"{folder}/batches/at={batch}", f"{feed}/batch-{batch:04}")
        stream = spark.readStream.schema(ARRIVALS).option("recursiveFileLookup", "true").parquet(feed).groupBy("bucket")
        events = stream.applyInPandasWithState(_step(batches, idle), EVENTS, "packed binary", "append", "NoTimeout")
        sink = events.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        sink.format("parquet").outputMode("append").start(result).awaitTermination()
    written = spark.read.schema(f"{ARRIVALS}, payload string").option("recursiveFileLookup", "true").parquet(feed).where("not tick")
    payloads = written.select("conv", "turn", F.col("batch").alias("came"), "payload")
    return spark.read.schema(EVENTS).parquet(result).join(payloads, ["conv", "turn", "came"], "left").drop("came")


def digests(events: DataFrame) -> DataFrame:
    """The events with a digest for what they carry."""
    said = F.when(F.col("event") == "close", F.col("unreleased")).otherwise(F.col("payload"))
    conv = F.when(F.col("conv") != "", F.col("conv")).cast("long")
    return events.select("event", F.sha2(said, 256).alias("sha256"), conv.alias("conv_id"), "turn", F.col("batch").cast("long"), "n_missing", "n_breaks")
