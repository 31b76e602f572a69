"""Column algebra on tables: filters, recoding, binding, grouping, duplicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.lineage import settled



def match_all(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Rows in which every column has its value."""
    return df.where(reduce(Column.__and__, [F.col(c) == v for c, v in values.items()]))


def match_any(df: DataFrame, values: Mapping[str, object | Sequence]) -> DataFrame:
    """Rows in which any column has its value, or one of its values."""
    tests = [F.col(c).isin(list(v)) if isinstance(v, list | tuple) else F.col(c) == v for c, v in values.items()]
    return df.where(reduce(Column.__or__, tests))


def select_rows(df: DataFrame, conditions: Mapping[str, object], invert: bool = False) -> DataFrame:
    """A row once for every condition that it meets, or with ``invert`` for every one that it doesn't."""
    if invert:
        return reduce(DataFrame.union, [df.where(~F.col(c).eqNullSafe(F.lit(v))) for c, v in conditions.items()])
    return reduce(DataFrame.union, [df.where(F.col(c) == v) for c, v in conditions.items()])


def recode(df: DataFrame, column: str, pairs: Sequence[tuple], into: str | None = None) -> DataFrame:
    """Values replaced by a short list of (old, new) pairs; the first match wins, others stay."""
    cases = reduce(lambda acc, p: acc.when(F.col(column) == p[0], F.lit(p[1])), pairs, F)
    return df.withColumn(into or column, cases.otherwise(F.col(column)))


def collapse(df: DataFrame, keep: Sequence[str], aggregates: Mapping[str, Column]) -> DataFrame:
    """One row a group, with the named aggregates."""
    return df.groupBy(*keep).agg(*[c.alias(n) for n, c in aggregates.items()])


def standard_error(column: str) -> Column:
    return F.stddev_samp(column) / F.sqrt(F.count(column))


def duplicates(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows that occur again later: all but the last of each group of equal keys; keys and order tell a row."""
    last = df.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_last"))
    return df.join(last, list(keys)).where(F.struct(*order) < F.col("_last")).select(*df.columns)


def nonrepeats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur once."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each group of equal keys."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_x"))
    return first.select(*keys, "_x.*").select(*df.columns)


def running(df: DataFrame, by: str, weight: str, out: str) -> DataFrame:
    """``out``: sum of ``weight`` over the rows with a smaller ``by``; ``by`` must be unique.

    Rows are cut into as many ranges as the session has shuffle partitions, which
    are sorted apart; only the ranges' sums meet in one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = settled(df.repartitionByRange(n, by).withColumn("_part", F.spark_partition_id()))  # ranges must not move between uses
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("_part").agg(F.sum(weight).alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    rows = cut.withColumn(out, F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return rows.join(F.broadcast(sums), "_part").withColumn(out, F.col(out) + F.col("_start")).drop("_part", "_start")


def ranked(df: DataFrame, order: Sequence[str | Column], out: str) -> DataFrame:
    """``out``: place from 0 in a total order, by ranges that are sorted apart; only their sizes meet in one task."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = settled(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))  # ranges must not move between uses
    sizes = cut.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return cut.withColumn(out, place).join(F.broadcast(sizes), "_part").withColumn(out, F.col(out) + F.col("_start")).drop("_part", "_start")


def bind_columns(left: DataFrame, right: DataFrame, order_left: str, order_right: str) -> DataFrame:
    """Columns side by side by position; the shorter side is repeated to the longer one's length."""
    number = lambda df, by: running(df.withColumn("_one", F.lit(1).cast("long")), by, "_one", "_k").drop("_one")
    n, m = left.count(), right.count()
    longer = lambda df, mine: df.withColumn("_k", F.explode(F.sequence("_k", F.lit(max(n, m) - 1).cast("long"), F.lit(mine).cast("long"))))
    a, b = number(left, order_left), number(right, order_right)
    return (longer(a, n) if n < m else a).join(longer(b, m) if m < n else b, "_k").drop("_k")


def matching(df: DataFrame, criterion: str) -> DataFrame:
    """Rows for which an SQL expression is true."""
    return df.where(criterion)


def remap(df: DataFrame, expressions: Sequence[str]) -> DataFrame:
    """Every row through SQL expressions."""
    return df.selectExpr(*expressions)


def replace(df: DataFrame, values: Mapping[str, str], columns: Sequence[str] | None = None) -> DataFrame:
    """Equal cells replaced in all columns of the values' type, or in the named ones."""
    return df.replace(dict(values), subset=list(columns) if columns else None)


def round_floats(df: DataFrame, digits: int) -> DataFrame:
    """Floating columns rounded, others as they are."""
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def zip_columns(left: DataFrame, right: DataFrame, order_left: str, order_right: str) -> DataFrame:
    """Columns side by side by position, as long as the shorter side."""
    number = lambda df, by: running(df.withColumn("_one", F.lit(1).cast("long")), by, "_one", "_k").drop("_one")
    return number(left, order_left).join(number(right, order_right), "_k").drop("_k")


def flat(df: DataFrame, nested: str, out: str) -> DataFrame:
    """One row an element of an array column, with its place."""
    rest = [c for c in df.columns if c != nested]
    return df.select(*rest, F.posexplode(nested).alias("place", out)).withColumn("place", F.col("place").cast("long"))


def nest(df: DataFrame, keys: Sequence[str], place: str, value: str, out: str) -> DataFrame:
    """The inverse of ``flat``: the values of each key as an array in order of their places."""
    pairs = F.array_sort(F.collect_list(F.struct(place, value)))
    return df.groupBy(*keys).agg(F.transform(pairs, lambda x: x[value]).alias(out))


def kind_of(text: Column) -> Column:
    """What a text reads as: int, float or string; a float without a fraction is an int."""
    number = text.try_cast("double")
    return F.when(number.isNull(), "string").when(number == F.floor(number), "int").otherwise("float")


def delete(df: DataFrame, rules: Mapping[str, Sequence], reverse: bool = False) -> DataFrame:
    """Without the rows (``reverse``: only those) in which every column has one of its values."""
    hit = F.coalesce(reduce(Column.__and__, [F.col(c).isin(list(v)) for c, v in rules.items()]), F.lit(False))
    return df.where(hit if reverse else ~hit)


def map_prefix(df: DataFrame, column: str, rules: Mapping[str, str | None]) -> DataFrame:
    """A value replaced by the first rule whose pattern matches its beginning; None makes it null."""
    cases = reduce(lambda acc, r: acc.when(F.col(column).rlike(f"^(?:{r[0]})"), F.lit(r[1]).cast("string")), rules.items(), F)
    return df.withColumn(column, cases.otherwise(F.col(column)))


def codes(df: DataFrame, column: str, out: str) -> DataFrame:
    """Dense codes from 0 in the order of the values; only the distinct values are ranked."""
    values = ranked(df.select(column).distinct(), [column], out)
    return df.join(values, column)


def split_merged(df: DataFrame, column: str, mark: str = "---") -> DataFrame:
    """A row for each type of a merged type, with its place."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.posexplode(F.split(column, mark)).alias("place", column))


def without(df: DataFrame, skip: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys aren't in the skip list."""
    return df.join(skip.select(*keys), list(keys), "left_anti")


def contains_all(df: DataFrame, rules: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows whose columns contain every listed substring."""
    return df.where(reduce(Column.__and__, [F.contains(c, F.lit(v)) for c, vs in rules.items() for v in vs], F.lit(True)))


def odometer(spark: SparkSession, caps: Sequence[int]) -> DataFrame:
    """Every setting of digits d0, d1, ... from 0 to their caps, computed from one number each."""
    total = reduce(lambda a, c: a * (c + 1), caps, 1)
    step, out = total, []
    for i, c in enumerate(caps):
        step //= c + 1
        out.append(F.expr(f"(id div {step}) % {c + 1}").alias(f"d{i}"))
    return spark.range(total).select(*out)


def combinations(df: DataFrame, column: str, k: int) -> DataFrame:
    """Every k distinct values in ascending order, as columns x0, x1, ...; the output itself is that large."""
    values = df.select(column).distinct()
    found = values.select(F.col(column).alias("x0"))
    for i in range(1, k):
        found = found.join(values.select(F.col(column).alias(f"x{i}")), F.expr(f"x{i - 1} < x{i}"))
    return found


def aligned_lines(df: DataFrame, gap: int = 2) -> DataFrame:
    """(line): rows as text, each column as wide as its longest cell; widths are one aggregate row."""
    cells = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
    widths = cells.agg(*[F.max(F.length(c)).alias(f"_w{i}") for i, c in enumerate(df.columns)])
    padded = [F.rpad(F.col(c), F.col(f"_w{i}") + gap, F.lit(" ")) for i, c in enumerate(df.columns)]
    return cells.join(F.broadcast(widths)).select(F.rtrim(F.concat(*padded)).alias("line"))
