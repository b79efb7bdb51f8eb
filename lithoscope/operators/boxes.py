"""Overlaps of rectangles: a two-dimensional interval join over a hierarchy of grids, without comparing all pairs.

A box has the level whose cells are just as large as it is, so it touches at most four cells there, however large it is. The
larger box of a pair is entered at its own level only, the smaller one at its own and every coarser level; so each pair
meets at the larger one's level, by an equality join on (page, level, cell). Of the cells in which they meet, the one that
holds the lower left corner of their overlap reports the pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlaps(boxes: DataFrame, page: str, key: str, sides: tuple[str, str, str, str] = ("x0", "y0", "x1", "y1"), coarsest: int = 40, finest: int = -20,
             least_share: float = 0.0) -> DataFrame:
    """(page, a, b, area): pairs of different keys a < b of a page whose boxes share an area; touching is none. The area must be
    more than ``least_share`` of the smaller box.

    Boxes with a null or non-finite side, without area, or with a null key or page overlap nothing. Levels are powers of two from
    2^``finest`` to 2^``coarsest`` in the boxes' units, of which only those that occur are used; a larger box is an error.
    """
    finite = lambda c: F.col(c).cast("double")
    rows = boxes.select(F.col(page).alias("page"), F.col(key).alias("key"), *(finite(c).alias(n) for c, n in zip(sides, ("x0", "y0", "x1", "y1"), strict=True)))
    good = F.lit(True)
    for c in ("x0", "y0", "x1", "y1"):
        good = good & (F.abs(c) < float("inf"))
    rows = rows.filter(good & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")) & F.col("page").isNotNull() & F.col("key").isNotNull())
    level = F.greatest(F.ceil(F.log2(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))), F.lit(finest)).cast("int")
    rows = rows.withColumn("level", F.when(level <= coarsest, level).otherwise(F.raise_error(F.lit(f"a box is larger than 2^{coarsest}")).cast("int")))
    used = sorted(r["level"] for r in rows.select("level").distinct().collect())  # at most a row a level
    at = lambda x, lv: F.floor(F.col(x) / F.pow(F.lit(2.0), lv))

    def entered(lv: Column, df: DataFrame) -> DataFrame:
        df = df.withColumn("l", lv)
        for c in "xy":
            df = df.withColumn(f"c{c}", F.explode(F.sequence(at(f"{c}0", F.col("l")), at(f"{c}1", F.col("l")))))
        return df

    large = entered(F.col("level"), rows).select("page", "l", "cx", "cy", *(F.col(c).alias(f"{c}_l") for c in ("key", "level", "x0", "y0", "x1", "y1")))
    coarser = F.explode(F.filter(F.lit(used).cast("array<int>"), lambda v: v >= F.col("level")))
    small = entered(coarser, rows).select("page", "l", "cx", "cy", *(F.col(c).alias(f"{c}_s") for c in ("key", "level", "x0", "y0", "x1", "y1")))
    left, bottom = F.greatest("x0_l", "x0_s"), F.greatest("y0_l", "y0_s")
    wide, high = F.least("x1_l", "x1_s") - left, F.least("y1_l", "y1_s") - bottom
    once = (F.col("level_s") < F.col("level_l")) | (F.col("key_s") < F.col("key_l"))
    corner = (F.floor(left / F.pow(F.lit(2.0), F.col("l"))) == F.col("cx")) & (F.floor(bottom / F.pow(F.lit(2.0), F.col("l"))) == F.col("cy"))
    own = lambda s: (F.col(f"x1_{s}") - F.col(f"x0_{s}")) * (F.col(f"y1_{s}") - F.col(f"y0_{s}"))
    enough = wide * high > least_share * F.least(own("l"), own("s"))
    # Spark sizes the entries by the boxes before they are exploded: it would send a side of millions through the driver
    met = large.hint("merge").join(small.hint("merge"), ["page", "l", "cx", "cy"]).filter(once & (F.col("key_s") != F.col("key_l")) & (wide > 0) & (high > 0) & enough & corner)
    return met.select("page", F.least("key_l", "key_s").alias("a"), F.greatest("key_l", "key_s").alias("b"), (wide * high).alias("area"))
