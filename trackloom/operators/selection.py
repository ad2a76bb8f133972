"""Exact quantiles of groups of any size, by narrowing down.

A group's wanted rank lies in one of ``CELLS`` cells between the least and the largest value left. Partial counts by cell, with each cell's
extremes, tell which; the next pass looks at that cell alone, until it holds one value. No group's values meet in a task: what is
exchanged is at most ``CELLS`` rows a group and task. Cells are even on a scale of logarithms to both sides of zero, and even on the plain one
once a range is narrow, so that a few passes do whatever the distribution.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import saved, small

CELLS = 1024


def _log(v: str) -> str:
    return f"sign({v}) * ln(1 + abs({v}) / greatest((high / 2 - low / 2) * 1e-9, 1e-300))"


def cell_of(value: str, cells: int = CELLS) -> str:
    """The cell of a value between low and high, which differ."""
    narrow = "(low > 0 AND high / 2 <= low) OR (high < 0 AND low / 2 >= high)"
    even = f"({value} / 2 - low / 2) / (high / 2 - low / 2)"
    return f"CAST(least({cells - 1}, floor({cells} * CASE WHEN {narrow} THEN {even} ELSE ({_log(value)} - {_log('low')}) / ({_log('high')} - {_log('low')}) END)) AS INT)"


def cells_of(values: np.ndarray, low: np.ndarray, high: np.ndarray, cells: int) -> np.ndarray:
    """The same for arrays."""
    with np.errstate(all="ignore"):
        unit = np.maximum((high / 2 - low / 2) * 1e-9, 1e-300)
        log = lambda v: np.sign(v) * np.log(1 + np.abs(v) / unit)
        narrow = ((low > 0) & (high / 2 <= low)) | ((high < 0) & (low / 2 >= high))
        share = np.where(narrow, (values / 2 - low / 2) / (high / 2 - low / 2), (log(values) - log(low)) / (log(high) - log(low)))
        return np.minimum(cells - 1, np.floor(cells * share)).astype(np.int64)


def narrowed(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, low, high, rank) of the cell that holds the rank, from (by, rank, cell, n, low, high) of all."""
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy("cell"))  # no more rows than there are cells
    return counts.withColumn("upto", upto).where("rank < upto AND rank >= upto - n").selectExpr(*by, "low", "high", "rank - (upto - n) AS rank")


def quantiles(rows: DataFrame, by: list[str], value: str, share: float, cells: int = CELLS) -> DataFrame:
    """(by, n, quantile): of each group the number of values and their quantile, between two of them by a straight line.

    Values that are null or NaN, and rows with a null in ``by``, don't count; a group of these only has no row. Infinite values are an error.
    """
    if not 0 <= share <= 1 or not by:
        raise ValueError("a share between 0 and 1, and columns to group by")
    there = " AND ".join(f"{c} IS NOT NULL" for c in (*by, value))
    kept = saved(rows.where(f"{there} AND NOT isnan({value})").select(*by, F.col(value).cast("double").alias("value__")))
    whole = kept.groupBy(*by).agg(F.min("value__").alias("low"), F.max("value__").alias("high"), F.count("*").alias("n"))
    whole = saved(whole.withColumn("at", F.lit(share) * (F.col("n") - 1)).withColumn("rank", F.floor("at")))
    state = whole.select(*by, "low", "high", "rank")
    found = [state.where("low = high")]
    for _ in range(64):
        open_ = saved(state.where("low < high"))
        if open_.isEmpty():
            break
        counts = kept.join(small(open_), by).where("value__ BETWEEN low AND high").groupBy(*by, "rank", F.expr(cell_of("value__", cells)).alias("cell"))
        counts = counts.agg(F.count("*").alias("n"), F.min("value__").alias("low"), F.max("value__").alias("high"))
        state = saved(narrowed(counts, by))
        found.append(state.where("low = high"))
    else:
        raise ValueError("values that can't be told apart")
    exact = found[0]
    for more in found[1:]:
        exact = exact.unionByName(more)
    exact = saved(whole.select(*by, "n", "at", F.floor("at").alias("first")).join(exact.select(*by, F.col("low").alias("v")), by))
    # The value after it, where the quantile lies between two.
    after = kept.join(small(exact.where("at > first")), by).groupBy(*by).agg(F.count_if(F.col("value__") <= F.col("v")).alias("upto"), F.min(F.when(F.col("value__") > F.col("v"), F.col("value__"))).alias("next"))
    out = exact.join(after, by, "left")
    following = F.when((F.col("upto") > F.col("first") + 1) | F.col("next").isNull(), F.col("v")).otherwise(F.col("next"))
    return out.select(*by, "n", (F.col("v") + (F.col("at") - F.col("first")) * (following - F.col("v"))).alias("quantile"))
