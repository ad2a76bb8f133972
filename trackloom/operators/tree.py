"""A decision tree that chooses a model for each frame by what the choice costs.

A node's cost is the least, over the models, of the error summed over its rows. It is grown level by level: one
aggregate a level gives the summed errors by node, feature and bin; running sums over the bins give each cut's
cost. The driver holds the tree only, of at most 2 ** depth nodes.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.vec import angle, combine, minus, norm, vec
from .predict import KEYS, down_sampled, predictors, with_history

BINS = 32
#: Rows that are put in order together.
RANGE = 50_000


def training_rows(poses: DataFrame, models: list[str]) -> DataFrame:
    """(track_id, step, k, speed, acc, turn of the poses before, and an error for each model), in one window pass; k from 3."""
    rows = with_history(down_sampled(poses)).where("k >= 3")
    p, s, made = [vec(suffix=i) for i in "123"], F.col("step").cast("double"), predictors()
    v, u = minus(p[0], p[1]), minus(p[1], p[2])
    features = [(norm(v) / s).alias("speed"), (norm(combine([1, -2, 1], p)) / (s * s)).alias("acc"), angle(u, v).alias("turn")]
    return rows.select(*KEYS, "k", *features, *(norm(minus(vec(), made[m])).alias(m) for m in models))


def binned(rows: DataFrame, features: list[str], bins: int = BINS) -> DataFrame:
    """bin_<feature>: equal bins from the least to the largest value; -1 where a feature is missing."""
    ends = rows.agg(*(f(c).alias(f"{n}_{c}") for c in features for n, f in (("low", F.min), ("high", F.max)))).first()

    def place(c: str) -> Column:
        low, high = ends[f"low_{c}"], ends[f"high_{c}"]
        if low is None or low == high:
            return F.when(F.col(c).isNull(), -1).otherwise(0)
        at = F.least(F.lit(bins - 1), F.floor((F.col(c) - low) / (high - low) * bins).cast("int"))
        return F.coalesce(at, F.lit(-1))

    return rows.select("*", *(place(c).alias(f"bin_{c}") for c in features))


def sketched(rows: DataFrame, features: list[str], bins: int = BINS, accuracy: int = 10_000) -> DataFrame:
    """bin_<feature>: bins of about as many rows each, from one mergeable sketch of every feature; -1 where a feature is missing.

    A cut lies at a value that occurs, so an outlier takes no more than its own bin. A rank is off by a share of 1 / ``accuracy`` of the rows at most.
    """
    shares = [i / bins for i in range(1, bins)]
    found = rows.agg(*(F.percentile_approx(F.nanvl(F.col(c), F.lit(None).cast("double")), shares, accuracy).alias(c) for c in features)).first()
    edges = {c: np.unique(found[c] or []) for c in features}
    kept = [c for c in rows.columns if c not in features]
    names = [f"bin_{c}" for c in features]
    schema = StructType([rows.schema[c] for c in kept] + [StructField(n, IntegerType()) for n in names])

    def run(batches):
        for b in batches:
            columns = [b[c] for c in kept]
            for c in features:
                values = b[c].to_numpy(zero_copy_only=False).astype(float)
                columns.append(pa.array(np.where(np.isnan(values), -1, np.searchsorted(edges[c], values)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *names])

    return rows.mapInArrow(run, schema)


def sums_by_bin(rows: DataFrame, features: list[str], models: list[str], tree: dict[int, dict] | None = None, least: int = 1) -> DataFrame:
    """(node, place, bin, models): summed errors by node, number of the feature, and bin. With a ``tree`` a row's node is its leaf there, and those below ``least`` don't count.

    A task counts in one table for all its rows, of a cell for each node, feature and bin, and hands on the cells that have rows: what is exchanged doesn't
    grow with the rows.
    """
    schema = "node int, place int, bin int, " + ", ".join(f"{m} double" for m in models)
    names = [f"bin_{c}" for c in features]
    feature, cut, _ = _arrays(tree or {}, features, models)

    def run(batches):
        nodes, width = np.empty(0, np.int64), 1  # nodes by their places in the table
        sums, counts = np.zeros((0, len(names), width, len(models))), np.zeros((0, len(names), width), np.int64)
        for b in batches:
            bins = np.stack([b[n].to_numpy() for n in names])
            errors = np.stack([b[m].to_numpy() for m in models])
            if tree is None:
                node = b["node"].to_numpy()
            else:
                node = _leaves(bins, feature, cut, max(tree, default=0).bit_length())
                bins, errors, node = bins[:, node >= least], errors[:, node >= least], node[node >= least]
            if not len(node):
                continue
            bins = bins + 1  # -1, missing, comes first
            of = np.unique(node)
            new, wider = np.setdiff1d(of, nodes), max(width, int(bins.max()) + 1)
            if len(new) or wider > width:
                room = ((0, len(new)), (0, 0), (0, wider - width))
                nodes, width = np.append(nodes, new), wider
                sums, counts = np.pad(sums, (*room, (0, 0))), np.pad(counts, room)
            places = np.argsort(nodes)
            at = places[np.searchsorted(nodes, node, sorter=places)]
            cell = ((at * len(names) + np.arange(len(names))[:, None]) * width + bins).ravel()
            counts += np.bincount(cell, minlength=counts.size).reshape(counts.shape)
            for i, e in enumerate(errors):
                sums[..., i] += np.bincount(cell, np.tile(e, len(names)), counts.size).reshape(counts.shape)
        at, place, bin_ = np.nonzero(counts)
        for first in range(0, len(at), 10_000):
            n, p, c = (v[first : first + 10_000] for v in (at, place, bin_))
            arrays = [pa.array(v.astype(np.int32)) for v in (nodes[n], p, c - 1)] + [pa.array(v) for v in sums[n, p, c].T]
            yield pa.RecordBatch.from_arrays(arrays, names=["node", "place", "bin", *models])

    return rows.select(*(["node"] if tree is None else []), *names, *models).mapInArrow(run, schema).groupBy("node", "place", "bin").agg(*(F.sum(m).alias(m) for m in models))


def best_splits(rows: DataFrame, features: list[str], models: list[str], tree: dict[int, dict] | None = None, least: int = 1) -> DataFrame:
    """(node, feature, bin, cost, whole, left_model, right_model): the cut of each node with the least cost.

    Rows (node, bin_..., errors) with bins up to ``bin`` go left; nodes are given, or leaves of ``tree``, see ``sums_by_bin``. Costs are summed errors; whole is the node's without a cut.
    Ties go to the first feature given, then to the lowest bin. A node all of whose bins are alike has no row.
    """
    name = F.element_at(F.lit(features), F.col("place") + 1).alias("feature")
    sums = sums_by_bin(rows, features, models, tree, least).select("node", "place", name, "bin", *models)
    w = Window.partitionBy("node", "place")
    upto = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cut = sums.select("node", "place", "feature", "bin", F.max("bin").over(w).alias("last"), *(F.sum(m).over(upto).alias(f"l_{m}") for m in models), *(F.sum(m).over(w).alias(f"t_{m}") for m in models))

    def lowest(of: list[Column]) -> Column:
        return F.array_min(F.array(*(F.struct(c.alias("cost"), F.lit(i).alias("i"), F.lit(m).alias("model")) for i, (c, m) in enumerate(zip(of, models)))))

    left, right = [F.col(f"l_{m}") for m in models], [F.col(f"t_{m}") - F.col(f"l_{m}") for m in models]
    cut = cut.where("bin < last").select("node", "place", "feature", "bin", lowest(left).alias("l"), lowest(right).alias("r"), lowest([F.col(f"t_{m}") for m in models]).alias("t"))
    cost = F.round(F.col("l.cost") + F.col("r.cost"), 6)
    found = cut.select("node", F.struct(cost.alias("cost"), "place", "bin", "feature", F.col("t.cost").alias("whole"), F.col("l.model").alias("left_model"), F.col("r.model").alias("right_model")).alias("s"))
    return found.groupBy("node").agg(F.min("s").alias("s")).select("node", "s.feature", "s.bin", "s.cost", "s.whole", "s.left_model", "s.right_model")


def node_of(tree: dict[int, dict], features: list[str]) -> Column:
    """A row's leaf: the root is 1, a node's children are 2 n and 2 n + 1.

    One fold down the levels over the tree as arrays, so the expression doesn't grow with the nodes.
    """
    if not tree:
        return F.lit(1)
    size = max(tree) + 1
    feature = F.lit([features.index(tree[n]["feature"]) + 1 if n in tree else 0 for n in range(1, size)])
    cut = F.lit([tree[n]["bin"] if n in tree else 0 for n in range(1, size)])
    bins = F.array(*(F.col(f"bin_{f}") for f in features))

    def down(n: Column, _: Column) -> Column:
        right = F.when(F.element_at(bins, F.element_at(feature, n)) <= F.element_at(cut, n), 0).otherwise(1)
        return F.when(n >= size, n).when(F.element_at(feature, n) == 0, n).otherwise(2 * n + right)

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(tree).bit_length())), F.lit(1), down)


def fit(rows: DataFrame, features: list[str], models: list[str], depth: int = 8) -> dict[int, dict]:
    """Cuts by node of rows that ``binned`` made. A node that no cut makes cheaper is a leaf; no rows give no cuts."""
    tree: dict[int, dict] = {}
    for level in range(1, depth + 1):
        found = [r.asDict() for r in best_splits(rows, features, models, dict(tree), 1 << level - 1).collect()]  # at most 2 ** (level - 1)
        better = {r["node"]: r for r in found if r["cost"] < r["whole"] - 1e-6}
        if not better:
            break
        tree |= better
    return tree


def costs(node: Column, tree: dict[int, dict], models: list[str], depth: int = 30) -> Column:
    """What the choice of a row's leaf ``node``, or of the node above it at ``depth``, costs. A tree without cuts chooses the first model."""
    names = {2 * n + i: models.index(t[f"{side}_model"]) + 1 for n, t in tree.items() for i, side in enumerate(("left", "right"))}
    of = F.lit([names.get(n, 1) for n in range(1, max(names, default=1) + 1)])
    level = F.floor(F.log2(node.cast("double")) + 1e-9).cast("int")
    above = F.floor(node / F.pow(F.lit(2.0), F.greatest(level - depth, F.lit(0)))).cast("int")
    return F.element_at(F.array(*models), F.element_at(of, above))


def chosen(rows: DataFrame, tree: dict[int, dict], features: list[str], models: list[str]) -> DataFrame:
    """``rows`` with node, its leaf, and err, what the leaf's choice costs."""
    rows = rows.withColumn("node", node_of(tree, features))
    return rows.withColumn("err", costs(F.col("node"), tree, models))


def depth_scores(rows: DataFrame, tree: dict[int, dict], features: list[str], models: list[str], depth: int = 8) -> DataFrame:
    """(step or null for all, depth, mean_err): the tree cut at each depth; depth 0 is the best choice of each row, a bound."""
    rows = rows.withColumn("node", node_of(tree, features))
    each = [F.struct(F.lit(d).alias("depth"), costs(F.col("node"), tree, models, d).alias("err")) for d in range(1, depth + 1)]
    each.append(F.struct(F.lit(0).alias("depth"), F.least(*models).alias("err")))
    long = rows.select("step", F.inline(F.array(*each)))
    return long.groupBy("step", "depth").agg(F.sum("err").alias("s"), F.count("err").alias("n")).select(F.explode(F.array("step", F.lit(None))).alias("step"), "depth", "s", "n").groupBy("step", "depth").agg((F.sum("s") / F.sum("n")).alias("mean_err"))


def ranked(rows: DataFrame, seed: int, name: str) -> DataFrame:
    """``rows`` (track_id, step, k, ..) with ``name``: their number, from 0, in the order of a hash keyed by ``seed``.

    Rows are numbered within ranges of the hash, as many as there are ``RANGE`` rows, and those of the ranges before are added: no task orders them all.
    """
    bits = min(16, max(0, (rows.count() // RANGE).bit_length()))
    keyed = rows.withColumn("h__", F.xxhash64(F.lit(seed), *KEYS, "k")).withColumn("range__", F.shiftrightunsigned("h__", 64 - bits) if bits else F.lit(0).cast("long"))
    counts = sorted(keyed.groupBy("range__").count().collect())  # at most 65,536
    before = [(r, sum_) for (r, n), sum_ in zip(counts, [0, *accumulate(n for _, n in counts)], strict=False)]
    starts = F.broadcast(rows.sparkSession.createDataFrame(before, "range__ long, start__ long"))
    at = F.row_number().over(Window.partitionBy("range__").orderBy("h__", *KEYS, "k")) - 1
    return keyed.withColumn("at__", at).join(starts, "range__").withColumn(name, F.col("start__") + F.col("at__")).drop("h__", "range__", "at__", "start__")


def permuted(rows: DataFrame, columns: list[str], seed: int = 0) -> DataFrame:
    """``rows`` with dealt_<column> for ``columns``: their values in another row, each row's going to exactly one.

    Two copies are put in the orders of two hashes and meet by their numbers.
    """
    here = ranked(rows, 2 * seed, "number__")
    there = ranked(rows.select(*KEYS, "k", *columns), 2 * seed + 1, "number__").select("number__", *(F.col(c).alias(f"dealt_{c}") for c in columns))
    return here.join(there, "number__").drop("number__")


RISES = pa.schema([("step", pa.int64()), ("feature", pa.string()), ("s", pa.float64()), ("n", pa.int64())])


def _arrays(tree: dict[int, dict], features: list[str], models: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By node: the number of its feature, -1 for a leaf, its cut, and the number of the model that a row there takes."""
    size = 2 * max(tree, default=0) + 2
    feature, cut, model = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size, np.int64)
    for n, t in tree.items():
        feature[n], cut[n] = features.index(t["feature"]), t["bin"]
        model[2 * n], model[2 * n + 1] = models.index(t["left_model"]), models.index(t["right_model"])
    return feature, cut, model


def _leaves(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The leaves of rows, a column of ``bins`` each."""
    node, at = np.ones(bins.shape[1], np.int64), np.arange(bins.shape[1])
    for _ in range(levels):
        right = bins[np.maximum(feature[node], 0), at] > cut[node]
        node = np.where(feature[node] < 0, node, 2 * node + right)
    return node


def importance(rows: DataFrame, tree: dict[int, dict], features: list[str], models: list[str], seed: int = 0) -> DataFrame:
    """(step, feature, rise, place): how much the mean error rises when a feature's values are dealt out anew among the rows; 0 is the largest rise.

    All features are dealt by one permutation. Ties go by name. Rows need a (track_id, step, k) of their own.
    """
    names = [f"bin_{f}" for f in features]
    rows = permuted(rows, names, seed)
    feature, cut, model = _arrays(tree, features, models)

    def cost(bins: np.ndarray, errors: np.ndarray) -> np.ndarray:
        return errors[model[_leaves(bins, feature, cut, max(tree, default=0).bit_length())], np.arange(bins.shape[1])]

    def run(batches):
        for b in batches:
            step = b["step"].to_numpy()
            bins, dealt, errors = (np.stack([b[c].to_numpy() for c in columns]) for columns in (names, [f"dealt_{n}" for n in names], models))
            base, rises = cost(bins, errors), []
            for i in range(len(features)):
                kept = bins[i].copy()
                bins[i] = dealt[i]
                rises.append(cost(bins, errors) - base)
                bins[i] = kept
            for s in np.unique(step):
                of = [r[step == s].sum() for r in rises]
                yield pa.RecordBatch.from_pydict({"step": [int(s)] * len(of), "feature": features, "s": of, "n": [int((step == s).sum())] * len(of)}, RISES)

    sums = rows.select("step", *names, *(f"dealt_{n}" for n in names), *models).mapInArrow(run, "step long, feature string, s double, n long")
    long = sums.groupBy("step", "feature").agg((F.sum("s") / F.sum("n")).alias("rise"))
    return long.withColumn("place", F.row_number().over(Window.partitionBy("step").orderBy(F.desc("rise"), "feature")) - 1)
