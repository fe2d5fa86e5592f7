"""Running totals over sorted groups of any size, and joins that stand keys of any weight.

A window per group would put a group into one task. Here rows are dealt by ranges of their
sort key, totals are taken inside each range, and a range starts from the totals of those before it.
"""

from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tillroll.sources.staging import stage

#: A key is heavy if it holds more than this part of the rows; so there are at most as many of them.
HEAVY_PART = 1000
#: Tasks that the rows of a heavy key are dealt to.
SALTS = 64

_PART, _PLACE = "_part", "_place"


def running_totals(rows: DataFrame, by: list[str], order: list[Column], amounts: dict[str, str], label: str) -> DataFrame:
    """`rows` with, for each entry new: column of `amounts`, the sum of that column (BIGINT) over the
    rows of the same group that come before.

    `order` must give every row of a group its own place. A group may be of any size, the number of
    groups must be small: one row per range and group passes through the driver, so at most as many
    as there are partitions and groups. Ranges are drawn once; the sorted rows are staged.
    """
    ascending = [F.col(c) for c in by]
    dealt = (
        rows.repartitionByRange(*ascending, *order).sortWithinPartitions(*ascending, *order)
        .withColumns({_PART: F.spark_partition_id(), _PLACE: F.monotonically_increasing_id()}))
    placed = stage(dealt, label)
    keys = [*by, _PART]
    totals = placed.groupBy(*keys).agg(*[F.sum(c).cast("bigint").alias(new) for new, c in amounts.items()]).collect()
    group = lambda r: tuple(r[c] for c in by)
    ordered = sorted(totals, key=lambda r: (tuple((x is not None, x) for x in group(r)), r[_PART]))
    carried = []
    for _, parts in groupby(ordered, group):
        so_far = dict.fromkeys(amounts, 0)
        for part in parts:
            carried.append((*group(part), part[_PART], *so_far.values()))
            so_far = {new: total + (part[new] or 0) for new, total in so_far.items()}
    schema = T.StructType([placed.schema[c] for c in keys] + [T.StructField(f"_{new}", T.LongType()) for new in amounts])
    starts = rows.sparkSession.createDataFrame(carried, schema)
    same = [placed[c].eqNullSafe(starts[c]) for c in keys]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    inside = Window.partitionBy(*[placed[c] for c in keys]).orderBy(_PLACE).rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(F.broadcast(starts), condition).select(
        *[placed[c] for c in rows.columns],
        *[(F.col(f"_{new}") + F.coalesce(F.sum(placed[c]).over(inside), F.lit(0))).cast("bigint").alias(new)
          for new, c in amounts.items()])


def join_heavy(rows: DataFrame, lookup: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of staged `rows` with `lookup`, which has each key once.

    The rows of heavy keys are dealt to SALTS tasks, and only their rows of `lookup` are repeated.
    Heavy keys number HEAVY_PART at most, so they are broadcast; `on` must hold no NULLs.
    """
    sizes = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_size"))
    heavy = sizes.filter(F.col("_size") * HEAVY_PART > rows.count()).select(*on, F.lit(SALTS).alias("_salts"))
    heavy = F.broadcast(stage(heavy, "heavy-keys"))
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.coalesce("_salts", F.lit(1)))
    dealt = rows.join(heavy, on, "left").withColumn("_salt", spread.cast("int")).drop("_salts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    repeated = lookup.join(heavy, on, "left").withColumn("_salt", copies).drop("_salts")
    return dealt.join(repeated, [*on, "_salt"]).drop("_salt")
