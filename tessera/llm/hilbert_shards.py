"""Sharding by Hilbert-curve order.

Several metadata dimensions are quantised to ``bits`` bits each, every row gets
the index of its cell on the Hilbert curve through that grid, rows are put in
curve order and the order is cut into runs of equal row counts. Rows of a run
are close in all dimensions at once, so the min/max statistics of its files
prune on any of them.

No task ever sorts a whole cell: a cell is split into slices by a hash of the
row's identifier, as many as keep a slice below ``SLICE_ROWS`` rows if one cell
had all rows; positions inside a slice come from a window over that slice, and
the start of each slice from prefix sums over the table of slice counts, by cell
(4096 cells at most). Only identifiers, sizes and codes are shuffled, never
texts.

Defined results: a null dimension takes code 0; a null or empty text has size 16
and checksum 0; a very long text is only measured; ties and repeated rows are
ordered by identifier, size and checksum, rows without doc_id before others,
dealt to slices by a hash of the text; rows equal in all three are
interchangeable; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slices of a cell at least, and rows of a slice at most, about.
SUBS, SLICE_ROWS = 64, 1 << 20
#: Bytes of a string, after the prefix common to all values, that form its code.
PREFIX_BYTES = 6


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """Position of a grid point on the Hilbert curve of ``len(point)`` dimensions.

    Gray-code construction: at each level the octant's bits are rotated and
    reflected into the current orientation, read as a Gray code, and the
    orientation is updated to the entry corner and direction of that octant.
    """
    dims = len(point)
    mask = (1 << dims) - 1
    rotate = lambda x, k: ((x >> (k % dims)) | (x << (dims - k % dims))) & mask if k % dims else x
    entry, direction, index = 0, 0, 0
    for level in reversed(range(bits)):
        octant = sum(((p >> level) & 1) << d for d, p in enumerate(point))
        gray = rotate(octant ^ entry, direction + 1)
        rank, shift = gray, gray >> 1
        while shift:
            rank ^= shift
            shift >>= 1
        index = (index << dims) | rank
        if rank:
            corner = 2 * ((rank - 1) // 2)
            corner ^= corner >> 1
            odd = rank if rank & 1 else rank - 1
            turn = ((odd ^ (odd + 1)).bit_length() - 1) % dims
        else:
            corner, turn = 0, 0
        entry ^= rotate(corner, dims - (direction + 1) % dims)
        direction = (direction + turn + 1) % dims
    return index


def curve_table(dims: int, bits: int) -> list[int]:
    """Curve index of every cell; the first dimension is the slowest in the cell number."""
    side = 1 << bits
    cells = []
    for cell in range(side**dims):
        point = tuple((cell >> (bits * (dims - 1 - d))) & (side - 1) for d in range(dims))
        cells.append(hilbert_index(point, bits))
    return cells


def _string_code(value: Column, skip: int) -> Column:
    """Order-keeping integer of the bytes after the first ``skip`` ones."""
    head = F.substring(F.encode(value, "UTF-8"), skip + 1, PREFIX_BYTES)
    return F.conv(F.rpad(F.hex(head), 2 * PREFIX_BYTES, "0"), 16, 10).cast("long")


def _number_code(value: Column) -> Column:
    """Bits of a count, in quarters: 4 codes for each doubling."""
    v = F.when(value.isNotNull(), F.greatest(value.cast("long"), F.lit(0)) + 4)
    high = F.length(F.bin(v)) - 1
    return high.cast("long") * 4 + F.floor(v / F.pow(F.lit(2.0), high - 2)).cast("long") % 4


def codes(df: DataFrame, dims: list[str], bits: int) -> list[Column]:
    """A quantised column of each dimension, 0 for null.

    Statistics come from all rows, in one pass that reads only the dimensions.
    Values are scaled linearly between the smallest and largest code.
    """
    kinds = dict(df.dtypes)
    lows = df.agg(*[f(F.col(d)).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]).first()
    top = (1 << bits) - 1
    out = []
    for d in dims:
        lo, hi = lows[f"lo_{d}"], lows[f"hi_{d}"]
        if lo is None or lo == hi:
            out.append(F.lit(0).cast("long"))
            continue
        if kinds[d] == "string":
            a, b = lo.encode(), hi.encode()
            skip = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            to_int = lambda raw: int.from_bytes(raw[skip : skip + PREFIX_BYTES].ljust(PREFIX_BYTES, b"\0"), "big")  # noqa: E731, B023
            code, low, high = _string_code(F.col(d), skip), to_int(a), to_int(b)
        else:
            number = lambda v: (v + 4).bit_length() - 1
            quarter = lambda v: number(v) * 4 + ((v + 4) >> (number(v) - 2)) % 4
            code, low, high = _number_code(F.col(d)), quarter(max(int(lo), 0)), quarter(max(int(hi), 0))
        if low == high:
            out.append(F.lit(0).cast("long"))
        else:
            out.append(F.coalesce(F.floor((code - low) * top / F.lit(high - low)).cast("long"), F.lit(0).cast("long")))
    return out


def assign(docs: DataFrame, dims: list[str] = ("source", "lang", "n_chars"), shards: int = 40, bits: int = 4) -> DataFrame:
    """(doc_id, size, text_crc32, cell, shard, slot) of every row.

    Row counts of two shards differ by one at most; ``slot`` numbers the rows of
    a shard from 0 in curve order.
    """
    dims = list(dims)
    quantised = codes(docs, dims, bits)
    cell = reduce(lambda acc, c: acc * (1 << bits) + c, quantised[1:], quantised[0])
    curve = F.split(F.lit(",".join(map(str, curve_table(len(dims), bits)))), ",").cast("array<int>")
    name = F.coalesce(F.md5(F.col("doc_id").cast("string")), F.md5("text"), F.lit("00"))
    sub = F.conv(F.substring(name, 1, 2), 16, 10).cast("int") % SUBS
    total, more = docs.count(), 0
    while total > SLICE_ROWS * SUBS * 16**more and more < 6:
        more += 1
    if more:  # further digits of the hash cut the slices
        sub = sub * 16**more + F.conv(F.substring(name, 3, more), 16, 10).cast("int")
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = docs.select(
        "doc_id",
        (F.length(raw) + 16).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.element_at(curve, (cell + 1).cast("int")).alias("cell"),
        sub.alias("sub"),
    )
    counts = (
        docs.select(F.element_at(curve, (cell + 1).cast("int")).alias("cell"), sub.alias("sub"))
        .groupBy("cell", "sub")
        .agg(F.count("*").alias("n"))
    )
    inner = Window.partitionBy("cell").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.groupBy("cell").agg(F.sum("n").alias("in_cell"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = cells.select(
        "cell",
        F.coalesce(F.sum("in_cell").over(before), F.lit(0)).alias("cell_start"),
        F.sum("in_cell").over(everything).alias("total"),
    )
    starts = counts.withColumn("sub_start", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(cells, "cell")
    in_slice = Window.partitionBy("cell", "sub").orderBy("doc_id", "size", "text_crc32")
    placed = (
        rows.withColumn("k", F.row_number().over(in_slice) - 1)
        .join(starts.select("cell", "sub", "sub_start", "cell_start", "total"), ["cell", "sub"])
        .withColumn("rank", F.col("cell_start") + F.col("sub_start") + F.col("k"))
    )
    shard = F.expr(f"(rank * {shards}) div total")
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id",
        "size",
        "text_crc32",
        "cell",
        "shard",
        # the first rank of shard s is ceil(s * total / shards)
        (F.col("rank") - F.expr(f"(shard * total + {shards - 1}) div {shards}")).cast("long").alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write the whole rows of ``docs`` to one folder a shard, each in curve order.

    A shard is written by as many tasks as it has slot ranges of 2^20 rows, so
    that no task holds a shard whose size grows with the input. Identifiers must
    be unique here, since whole rows are found again by them.
    """
    placed = assign(docs, **options).select("doc_id", "shard", "slot")
    (
        docs.join(placed, "doc_id")
        .repartition(F.col("shard"), F.shiftright(F.col("slot"), 20))
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
