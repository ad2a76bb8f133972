"""Correlations of all pairs of many columns by one matrix product a batch."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def correlations(rows: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, n, r): the correlation of each pair of columns, a before b in ``names``, over the rows that have both; null where either doesn't vary.

    A first pass gives the columns' means, so that sums of products lose no digits; in the second a task multiplies each batch, less these, with itself
    and gives one matrix in the end. Rows are never multiplied by pairs.
    """
    m = len(names)
    given = rows.select(*(F.col(n).cast("double").alias(n) for n in names))
    means = given.agg(*(F.avg(n).alias(n) for n in names)).first()
    centre = np.array([v if v is not None else 0.0 for v in means])
    upper = np.triu_indices(m, 1)
    schema = "pair int, n double, sx double, sy double, sxx double, syy double, sxy double"

    def run(batches):
        total = np.zeros((6, m, m))
        for b in batches:
            x = b.to_numpy(dtype=float) - centre
            there = ~np.isnan(x)
            x, v = np.where(there, x, 0.0), there.astype(float)
            total += np.stack([v.T @ v, x.T @ v, v.T @ x, (x * x).T @ v, v.T @ (x * x), x.T @ x])
        yield pd.DataFrame({"pair": np.arange(len(upper[0]), dtype=np.int32), **{c: t[upper] for c, t in zip(("n", "sx", "sy", "sxx", "syy", "sxy"), total, strict=True)}})

    sums = given.mapInPandas(run, schema).groupBy("pair").agg(*(F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")))
    spread = lambda s, q: f"({q} - {s} * {s} / n)"
    vary = f"n > 1 AND {spread('sx', 'sxx')} > 1e-12 * sxx AND {spread('sy', 'syy')} > 1e-12 * syy"
    r = f"CASE WHEN {vary} THEN (sxy - sx * sy / n) / sqrt({spread('sx', 'sxx')} * {spread('sy', 'syy')}) END"
    name = lambda side: F.element_at(F.lit([names[i] for i in upper[side]]), F.col("pair") + 1)
    return sums.select(name(0).alias("a"), name(1).alias("b"), F.col("n").cast("long").alias("n"), F.expr(r).alias("r"))


def collinear(pairs: DataFrame, most: float = 0.7) -> DataFrame:
    """(feature, closest, dropped): of each column but the first, the largest absolute correlation with one before it, and whether that is over ``most``."""
    by = pairs.groupBy(F.col("b").alias("feature")).agg(F.max(F.abs("r")).alias("closest"))
    return by.select("feature", "closest", F.coalesce(F.col("closest") > most, F.lit(False)).alias("dropped"))
