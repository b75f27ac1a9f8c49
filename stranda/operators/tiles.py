"""Running values along a contig without gathering a contig in one task.

Rows are dealt by (contig, tile), where a tile is a stretch of TILE positions; within a tile a window runs over the rows, and what
earlier tiles carry over comes from a table with one row for each tile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stranda import storage

TILE = 1 << 17


def with_tile(df: DataFrame, position: str = "start", tile: int = TILE) -> DataFrame:
    return df.withColumn("__tile", F.floor(F.col(position) / tile).cast("long"))


def _tiles_before() -> Window:
    return Window.partitionBy("contig").orderBy("__tile").rowsBetween(Window.unboundedPreceding, -1)


def carried(df: DataFrame, value: Column, order: list, kind: str, name: str, inclusive: bool = False, save: bool = True) -> DataFrame:
    """Appends the running maximum, minimum, sum or last non-null value of all earlier rows of a contig (with the row itself, if inclusive).

    ``df`` has a ``__tile`` whose order is that of the rows. It is used twice, for its rows and for its tiles, so it is saved first;
    ``save`` is false where it is no more than a scan.
    """
    if save:
        df = storage.saved(df, "tiles")
    window = Window.partitionBy("contig", "__tile").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    full = Window.partitionBy("contig", "__tile").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if kind == "last":
        by_tile = df.select("contig", "__tile", F.last(value, ignorenulls=True).over(full).alias("v")).groupBy("contig", "__tile").agg(F.first("v", ignorenulls=True).alias("v"))
        before = by_tile.select("contig", "__tile", F.last("v", ignorenulls=True).over(_tiles_before()).alias("__before"))
        mine = F.last(value, ignorenulls=True).over(window)
        both = lambda a, b: F.coalesce(b, a)
    else:
        fold = {"max": F.max, "min": F.min, "sum": F.sum}[kind]
        before = df.groupBy("contig", "__tile").agg(fold(value).alias("v")).select("contig", "__tile", fold("v").over(_tiles_before()).alias("__before"))
        mine = fold(value).over(window)
        both = {"max": F.greatest, "min": F.least, "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))}[kind]
    return df.withColumn("__mine", mine).join(before, ["contig", "__tile"]).withColumn(name, both(F.col("__before"), F.col("__mine"))).drop("__mine", "__before")
