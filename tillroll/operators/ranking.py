"""Exact order statistics in two passes, without sorting a table.

`rows_at_ranks` finds the rows that stand at given ranks of each group. The first pass builds a
mergeable quantile sketch of each group, which brackets every wanted rank between two of its marks.
The second counts the rows below, between and above the brackets, and the few inside one by one,
so the rank within its bracket is exact. Values and ties are one position on a line, so a value
shared by most rows is bracketed like any other. Neither the number of passes nor what is moved
depends on how values are distributed.
"""

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tillroll.sources.staging import stage

#: Cells a sketch is cut into, and the reciprocal of the part of all rows by which a mark's rank may be off.
CELLS, ACCURACY = 2048, 10_000
_WHOLE = "_whole_table"


def position(df: DataFrame, value: str, tie: str | None) -> Column:
    """Where a row stands, as DOUBLE that never falls along the order of (value, tie).

    A tie moves an integer value by less than one. It counts by its logarithm, which tells
    small and large ids apart by the same ratio. Conversion, addition and the logarithm are
    monotonic, so rows out of order are impossible and equal positions merely share a bracket.
    """
    place = F.col(value).cast("double")
    if tie is None or not isinstance(df.schema[value].dataType, T.IntegralType):
        return place
    by = F.col(tie).cast("double")
    return place + (0.5 + F.signum(by) * F.log1p(F.abs(by)) / 128)


def sketch(place: Column, cells: int = CELLS) -> Column:
    """Aggregate: the marks of a mergeable sketch, ascending, at equal steps from the first to the last row."""
    steps = F.expr("array(" + ", ".join(f"{i / cells!r}D" for i in range(cells + 1)) + ")")
    return F.percentile_approx(place, steps, ACCURACY)


def _bracket(marks: list[float], rank: int, size: int) -> tuple[float, float]:
    """Positions between which the row at a rank lies for sure."""
    slack = size / ACCURACY + 1
    steps = len(marks) - 1
    low, high = math.floor((rank - 1 - slack) * steps / size), math.ceil((rank + slack) * steps / size)
    # NaN is the largest position.
    return marks[low] if low >= 0 else -math.inf, marks[high] if high <= steps else math.nan


def _disjoint(brackets: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Overlapping brackets joined, in order."""
    above = lambda x: math.inf if math.isnan(x) else x
    out: list[tuple[float, float]] = []
    for low, high in sorted(brackets, key=lambda b: above(b[0])):
        if out and above(low) <= above(out[-1][1]):
            out[-1] = (out[-1][0], max(out[-1][1], high, key=above))
        else:
            out.append((low, high))
    return out


def local_table(spark: SparkSession, records: list[dict], schema: T.StructType) -> DataFrame:
    columns = schema.fieldNames()
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in records], schema)


def _inside(bracket: tuple[float, float], outer: tuple[float, float]) -> bool:
    above = lambda x: math.inf if math.isnan(x) else x
    return above(outer[0]) <= above(bracket[0]) and above(bracket[1]) <= above(outer[1])


def _count_brackets(rows, keys, value, tie, ties_matter, targets):
    """The targets' rows, from one pass: numbers of rows between brackets, and the rows inside them."""
    spark, schema = rows.sparkSession, rows.schema
    groups: dict[tuple, list[dict]] = {}
    for target in targets:
        groups.setdefault(tuple(target[c] for c in keys), []).append(target)
    bounds = []
    for group, members in groups.items():
        ranges = _disjoint([t["bracket"] for t in members])
        bounds.append(dict(zip(keys, group)) | {"lows": [a for a, _ in ranges], "highs": [b for _, b in ranges]})
        for t in members:
            t["code"] = 2 * next(j for j, r in enumerate(ranges) if _inside(t["bracket"], r)) + 1
    key_fields = [schema[c] for c in keys]
    doubles = T.ArrayType(T.DoubleType())
    bound_table = local_table(spark, bounds, T.StructType(
        key_fields + [T.StructField("lows", doubles), T.StructField("highs", doubles)]))

    beside = rows.withColumn("_at", position(rows, value, tie if ties_matter else None)).join(F.broadcast(bound_table), keys)
    passed = F.size(F.filter("lows", lambda x: x <= F.col("_at"))) + F.size(F.filter("highs", lambda x: x < F.col("_at")))
    coded = beside.withColumn("code", passed).withColumn("_in", F.col("code") % 2 == 1)
    own_tie = F.when(F.col("_in"), F.col(tie)) if ties_matter else F.lit(None).cast(schema[tie].dataType)
    counted = stage(coded.groupBy(
        *keys, "code", F.when(F.col("_in"), F.col(value)).alias("_value"), own_tie.alias("_tie"),
    ).agg(F.count(F.lit(1)).alias("size"), F.min(tie).alias("_any_tie")), "bracket-counts")
    # One row per bracket and gap.
    stretches = counted.groupBy(*keys, "code").agg(F.sum("size").alias("held")).orderBy("code").collect()
    below, passed_by = {}, {}
    for row in stretches:
        group = tuple(row[c] for c in keys)
        below[group, row["code"]] = passed_by.get(group, 0)
        passed_by[group] = passed_by.get(group, 0) + row["held"]
    left = [t | {"rank": t["rank"] - below.get((tuple(t[c] for c in keys), t["code"]), 0)} for t in targets]
    wanted = local_table(spark, left, T.StructType(
        key_fields + [T.StructField("code", T.IntegerType()), T.StructField("k", T.IntegerType()), T.StructField("rank", T.LongType())]))
    through = Window.partitionBy(*keys, "code").orderBy("_value", "_tie")
    return (
        counted.filter(F.col("code") % 2 == 1).withColumn("through", F.sum("size").over(through))
        .join(F.broadcast(wanted), [*keys, "code"])
        .filter((F.col("rank") <= F.col("through")) & (F.col("rank") > F.col("through") - F.col("size")))
        .select(*keys, "k", F.col("_value").alias("value"), F.coalesce("_tie", "_any_tie").alias("tie")).collect()
    )


def rows_at_ranks(
    rows: DataFrame,
    by: list[str],
    value: str,
    tie: str,
    ranks: Callable[[Column], Column],
    ties_matter: bool = True,
    cells: int = CELLS,
) -> DataFrame:
    """The (value, tie) pair at each wanted rank of each group, ascending.

    `ranks` maps the group size to an array of 1-based ranks; the position in that
    array comes back as `k`. (`value`, `tie`) must be unique within a group. The
    number of groups must be small and fixed (segments, months, metrics): their sketches and the
    wanted ranks are kept on the driver. `rows` is read twice, so pass a staged table.
    With `ties_matter=False` only the value is wanted. NaN counts as the largest value.
    """
    keys = by or [_WHOLE]
    if not by:
        rows = rows.withColumn(_WHOLE, F.lit(1))
    rows = rows.select(*keys, value, tie).filter(F.col(value).isNotNull()).dropna(subset=by)
    place = position(rows, value, tie if ties_matter else None)
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), sketch(place, cells).alias("marks"))
    targets = []
    for group in groups.select(*keys, "size", "marks", ranks(F.col("size")).alias("ranks")).collect():
        targets += [
            {c: group[c] for c in keys} | {
                "k": k, "rank": rank, "group_size": group["size"], "bracket": _bracket(group["marks"], rank, group["size"])}
            for k, rank in enumerate(group["ranks"] or [])]
    found = {}
    pending = targets
    while pending:
        for row in _count_brackets(rows, keys, value, tie, ties_matter, pending):
            found[tuple(row[c] for c in keys), row["k"]] = {value: row["value"], tie: row["tie"]}
        # Should a sketch ever be less accurate than it promises, its ranks are looked for everywhere.
        missed = [t for t in pending if (tuple(t[c] for c in keys), t["k"]) not in found]
        if missed and all(t["bracket"][0] == -math.inf and math.isnan(t["bracket"][1]) for t in missed):
            raise ValueError(f"{value} has fewer rows than a wanted rank")
        pending = [t | {"bracket": (-math.inf, math.nan)} for t in missed]
    answers = [t | found[tuple(t[c] for c in keys), t["k"]] for t in targets]
    schema = rows.schema
    answer_schema = T.StructType(
        [schema[c] for c in by]
        + [T.StructField("k", T.IntegerType()), T.StructField("rank", T.LongType()), T.StructField("group_size", T.LongType())]
        + [T.StructField(value, schema[value].dataType), T.StructField(tie, schema[tie].dataType)])
    return local_table(rows.sparkSession, answers, answer_schema)


def exact_quantiles(
    rows: DataFrame, by: list[str], value: str, tie: str, percents: list[int],
) -> DataFrame:
    """Linear-interpolated quantiles, one row per group and whole percentage."""
    def neighbours(n: Column) -> Column:
        places = []
        for p in percents:
            below = ((n - 1) * p - F.pmod((n - 1) * p, F.lit(100))) / 100
            below = below.cast("bigint") + 1
            places += [below, F.least(below + 1, n)]
        return F.array(*places)

    pairs = rows_at_ranks(rows, by, value, tie, neighbours, ties_matter=False)
    which = F.element_at(F.array(*[F.lit(p) for p in percents]),
                         (F.floor(F.col("k") / 2) + 1).cast("int"))
    pairs = pairs.withColumn("percent", which).withColumn("exact", F.col(value).cast("double"))
    steps = F.pmod((F.col("group_size") - 1) * F.col("percent"), F.lit(100)) / 100.0
    return (
        pairs.withColumn("step", steps)
        .groupBy(*by, "percent", "step")
        .agg(F.min("exact").alias("low"), F.max("exact").alias("high"))
        .select(*by, "percent", (F.col("low") + (F.col("high") - F.col("low")) * F.col("step")).alias("quantile"))
    )
