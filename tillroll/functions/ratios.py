"""Division that yields NULL instead of raising."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent(part: Column, whole: Column, digits: int | None = None) -> Column:
    share = F.try_divide(part.cast("double") * 100.0, whole.cast("double"))
    return share if digits is None else F.round(share, digits)
