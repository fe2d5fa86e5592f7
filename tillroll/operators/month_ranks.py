"""Ranks per month among standings that last from one month to another.

A standing holds from `from_month` to before `until_month` (NULL: to the end). Counting
it once where it begins and once, negatively, where it ends gives the number standing in
every month without a row per month. One table of (group, cell, month, entered minus left)
holds these counts for cells of the value range; the cell that holds a wanted rank of a month is
read off it for all months at once, and the rank is settled among the rows of that cell.
"""

from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tillroll.operators.ranking import local_table, position, sketch
from tillroll.sources.staging import stage

#: Cells of the value range: a power of two, so that a cell is found by halving.
CELLS = 4096


def entries_and_exits(standings: DataFrame, *keys: str) -> DataFrame:
    """(keys, month, delta): entered minus left, summed inside each task first."""
    both = F.array(
        F.struct(F.col("from_month").alias("month"), F.lit(1).alias("delta")),
        F.struct(F.col("until_month").alias("month"), F.lit(-1).alias("delta")))
    return (
        standings.select(*keys, F.inline(both)).filter(F.col("month").isNotNull())
        .groupBy(*keys, "month").agg(F.sum("delta").alias("delta"))
    )


def standing_by_month(events: DataFrame, *keys: str) -> DataFrame:
    """One row per key with `events`: an array of (month, delta)."""
    return events.groupBy(*keys).agg(F.collect_list(F.struct("month", "delta")).alias("events"))


def standing_in(month: Column) -> Column:
    """Number standing in a month, from `events`."""
    past = F.filter("events", lambda e: e["month"] <= month)
    return F.aggregate(past, F.lit(0).cast("bigint"), lambda n, e: n + e["delta"])


def _edges(marks: list[float]) -> list[float]:
    """Lower edges of the cells, as many as CELLS. NaN is never passed."""
    edges = [float("-inf"), *sorted(set(marks[1:-1]))]
    return edges + [float("nan")] * (CELLS - len(edges))


def _last_passed(rows: DataFrame, edges: str, place: str, name: str) -> DataFrame:
    """rows with the index of the last edge not above a place, by halving: compiled code that
    compares a place with one edge of each step."""
    rows, step = rows.withColumn(name, F.lit(0)), CELLS // 2
    while step:
        passed = F.get(edges, F.col(name) + step) <= F.col(place)
        rows = rows.withColumn(name, F.col(name) + F.when(passed, step).otherwise(0))
        step //= 2
    return rows


def with_cells(standings: DataFrame, group: str, value: str, tie: str, cells: int) -> tuple[DataFrame, set]:
    """`standings` with `cell`, and the (group, month) in which someone enters.

    Cells are cut at the marks of one sketch per group, so they hold about equally many standings.
    Order of cells is order of (value, tie).
    """
    spark = standings.sparkSession
    place = position(standings, value, tie)
    found = standings.groupBy(group).agg(
        sketch(place, cells).alias("marks"), F.collect_set("from_month").alias("months")).collect()
    schema = T.StructType([standings.schema[group], T.StructField("_edges", T.ArrayType(T.DoubleType()))])
    edges = local_table(spark, [{group: r[group], "_edges": _edges(r["marks"])} for r in found], schema)
    placed = standings.withColumn("_at", place).join(F.broadcast(edges), group)
    placed = _last_passed(placed, "_edges", "_at", "cell")
    return placed.select(*standings.columns, "cell"), {(r[group], m) for r in found for m in r["months"]}


def _wanted(events: DataFrame, group: str, entered: set, ranks: Callable[[int], list[int]]) -> list[tuple]:
    """(group, month, k, rank) for the months of the data: those in which someone of any group enters."""
    months = {m for _, m in entered}
    changes: dict = {}
    for r in events.groupBy(group, "month").agg(F.sum("delta").alias("delta")).collect():
        changes.setdefault(r[group], []).append((r["month"], r["delta"]))
    wanted = []
    for name, some in changes.items():
        some.sort()
        for month, n in zip((m for m, _ in some), accumulate(d for _, d in some)):
            if n and month in months:
                wanted += [(name, month, k, rank) for k, rank in enumerate(ranks(n))]
    return wanted


def rows_at_monthly_ranks(
    standings: DataFrame, group: str, value: str, tie: str, ranks: Callable[[int], list[int]], cells: int = CELLS,
) -> DataFrame:
    """(Month, group, k, value, tie): who stands at each wanted rank of each month, ascending.

    `ranks` maps the number standing to 1-based ranks, `k` is the place in that list.
    `value` and `tie` are integers, unique together in a month; months and groups are few. The
    standings are read three times, whatever their values: for the sketch, for the table of
    cells and for the rows of the cells that hold a wanted rank.
    """
    spark = standings.sparkSession
    placed, entered = with_cells(standings, group, value, tie, cells)
    events = stage(entries_and_exits(placed, group, "cell"), "cell-events")
    wanted = _wanted(events, group, entered, ranks)
    kinds = [standings.schema[group], T.StructField("Month", T.DateType()), T.StructField("k", T.IntegerType())]
    targets = F.broadcast(spark.createDataFrame(wanted, T.StructType([*kinds, T.StructField("rank", T.LongType())])))
    months = F.broadcast(targets.select(group, "Month").distinct())
    sizes = standing_by_month(events, group, "cell").join(months, group).select(
        group, "cell", "Month", standing_in(F.col("Month")).alias("size")).filter(F.col("size") > 0)
    through = F.sum("size").over(Window.partitionBy(group, "Month").orderBy("cell"))
    holding = (
        sizes.withColumn("through", through).join(targets, [group, "Month"])
        .filter((F.col("rank") <= F.col("through")) & (F.col("rank") > F.col("through") - F.col("size")))
        .select(group, "Month", "k", "cell", (F.col("rank") - F.col("through") + F.col("size")).alias("left")).collect()
    )
    if len(holding) != len(wanted):
        raise ValueError(f"some wanted ranks of {value} are in no cell")
    held = F.broadcast(spark.createDataFrame(holding, T.StructType(
        [*kinds, T.StructField("cell", T.IntegerType()), T.StructField("left", T.LongType())])))
    stands = (F.col("from_month") <= F.col("Month")) & (F.col("until_month").isNull() | (F.col("until_month") > F.col("Month")))
    inside = Window.partitionBy(group, "Month", "k").orderBy(value, tie)
    return F.broadcast(
        placed.join(held, [group, "cell"]).filter(stands)
        .withColumn("at", F.row_number().over(inside)).filter("at = left")
        .select("Month", group, "k", value, tie))
