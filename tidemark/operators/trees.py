"""Regression trees over histograms of binned features: boosted trees and forests.

Rows are binned once and cached as blocks of arrays, one byte a feature.  A level of a
tree is one Spark job: tasks sum counts and labels per node, feature and bin, and the
sums decide the splits.  Boosting, bootstrap, gain and stopping are those of Spark ML's
GBTRegressor and RandomForestRegressor (squared loss, the first tree with weight 1,
later ones fitted to twice the residual); bins are cut at all values of a feature, or
at quantiles of all rows where it has more than ``BINS``.  Features count as continuous.

Models of the same rows are fitted together (``fit_together``): rows are binned once, a
level of all of them that grow in step is one job, and a model whose trees are the first
rounds, first trees or upper levels of another's takes them from there.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasSeed, HasStepSize
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

BINS = 32
BLOCK_ROWS = 16_384
TASK_ROWS, LEAST_ROWS = 4_000_000, 250_000  # rows of a task, and that are worth one
CUT_ROUNDS = 25  # rounds after which the residuals are stored and their lineage cut
GROUP_BYTES, DRIVER_BYTES = 8 << 20, 16 << 20  # histograms of one task, and of all tasks that the driver may sum
GROUP_TREES = 25  # trees of a forest whose bootstrap, one byte a row, is kept at the same time
_QUANTILE_ERROR = 1e-3
_BLOCK = "number long, codes binary, y binary"

Tree = tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]  # feature and last bin to the left by place in each level; value of each leaf


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def thresholds(rows: DataFrame, features: int) -> list[np.ndarray]:
    """At most BINS - 1 ascending thresholds for each element of column x."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(0)] * features
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                seen = [s if s.size > BINS else np.unique(np.r_[s, x[:, j]])[: BINS + 1] for j, s in enumerate(seen)]
        yield pa.RecordBatch.from_arrays([pa.array(range(features), pa.int32()), pa.array([s.tolist() for s in seen], pa.list_(pa.float64()))], ["j", "seen"])

    few = F.array_sort(F.slice(F.array_distinct(F.flatten(F.collect_list("seen"))), 1, BINS + 1))
    seen = {r["j"]: np.array(r["seen"]) for r in rows.mapInArrow(values, "j int, seen array<double>").groupBy("j").agg(few.alias("seen")).collect()}  # one row a feature
    out = [(seen[j][1:] + seen[j][:-1]) / 2 for j in range(features)]
    many = [j for j in range(features) if seen[j].size > BINS]
    if many:
        wide = rows.select(*[F.col("x")[j].alias(f"x{j}") for j in many])
        cuts = wide.approxQuantile(wide.columns, [i / BINS for i in range(1, BINS)], _QUANTILE_ERROR)
        for j, found in zip(many, cuts, strict=True):
            out[j] = np.unique(found)
    return out


def _blocks(rows: DataFrame, cuts: list[np.ndarray], mean: float, n: int) -> RDD:
    """(number, bins of each row, label less the mean), dealt evenly to the cores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                held.append((np.stack([np.searchsorted(c, x[:, j]).astype(np.uint8) for j, c in enumerate(cuts)], 1), batch.column("y").to_numpy() - mean))
                size += batch.num_rows
            if size >= BLOCK_ROWS:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    def packed(held: list) -> pa.RecordBatch:
        codes, y = map(np.concatenate, zip(*held, strict=True))
        codes, y = codes.tobytes(), y.tobytes()
        # numbered by content, so that a block has the same bootstrap wherever it is made again
        number = zlib.crc32(y, zlib.crc32(codes))
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([codes], pa.binary()), pa.array([y], pa.binary())], ["number", "codes", "y"])

    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = min(cores * math.ceil(n / TASK_ROWS / cores), math.ceil(n / LEAST_ROWS))
    return _arrays(rows.mapInArrow(run, _BLOCK).repartition(parts), len(cuts))


def _arrays(blocks: DataFrame, features: int) -> RDD:
    """(number, codes, labels by series and row, no weights) of each block."""

    def run(r) -> tuple:
        codes = np.frombuffer(r["codes"], np.uint8).reshape(-1, features)
        return r["number"], codes, np.frombuffer(r["y"]).reshape(-1, codes.shape[0]), None

    return blocks.rdd.map(run)


def _places(codes: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Place of each row in the level below ``levels``."""
    flat, first = codes.ravel(), np.arange(codes.shape[0]) * codes.shape[1]
    at = np.zeros(codes.shape[0], np.int64)
    for feature, cut in levels:
        at = 2 * at + (flat[first + feature[at]] > cut[at])
    return at


def _histogram(at: np.ndarray, codes: np.ndarray, width: int, label: np.ndarray, weight: np.ndarray | None) -> np.ndarray:
    """Rows and sum of labels per place, feature and bin."""
    out, at = np.empty((width, codes.shape[1], BINS, 2)), at * BINS
    for j in range(codes.shape[1]):
        bins = at + codes[:, j]
        for k, w in enumerate((weight, label)):
            out[:, j, :, k] = np.bincount(bins, w, width * BINS).reshape(width, BINS)
    return out


def _best(sums: np.ndarray, least: int, allowed: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """feature, last bin to the left, mean on the left and on the right, is split: by place."""
    left, total = np.cumsum(sums, 2)[:, :, :-1], sums.sum(2)[:, :, None]
    right = total - left
    ok = (left[..., 0] >= max(least, 1)) & (right[..., 0] >= max(least, 1))
    if allowed is not None:
        ok &= allowed[:, :, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = left[..., 1] ** 2 / left[..., 0] + right[..., 1] ** 2 / right[..., 0]
        gain = np.where(ok, parts - total[..., 1] ** 2 / total[..., 0], -np.inf)
        gain = np.where(gain > 1e-12 * parts, gain, -np.inf).reshape(sums.shape[0], -1)
        best = gain.argmax(1)
        place = np.arange(best.size)
        ends = [x.reshape(best.size, -1, 2)[place, best] for x in (left, right)]
        means = [e[:, 1] / e[:, 0] for e in ends]
        own = np.nan_to_num(total[:, 0, 0, 1] / total[:, 0, 0, 0])
    split = gain[place, best] > -np.inf
    feature, cut = np.where(split, best // (BINS - 1), 0), np.where(split, best % (BINS - 1), BINS)
    return feature, cut, np.where(split, means[0], own), np.where(split, means[1], own), split


def _grown(state: RDD, depths: Mapping[int, int], least: int, features: int, subset: Callable | None = None) -> dict[int, tuple[list, list[np.ndarray]]]:
    """Levels of each tree of ``depths``, and the values of its places above, between and
    below them; a level of all trees is one job.

    A tree reads the labels of its number, or the only ones, and with weights those of its
    number.  ``subset(tree, level)`` are the features allowed by place."""
    levels: dict[int, list] = {t: [] for t in depths}
    values = {t: [np.zeros(1)] for t in depths}
    live = {t: np.ones(1, bool) for t in depths}
    parts, base = state.getNumPartitions(), min(depths)
    for level in range(max(depths.values())):
        grow = [t for t in depths if level < depths[t] and live[t].any()]
        if not grow:
            break
        width, known = 2**level, {t: levels[t] for t in grow}

        def sums(blocks: Iterator[tuple], grow=grow, width=width, known=known) -> Iterator[tuple[int, np.ndarray]]:
            out = {}
            for _, codes, labels, weights in blocks:
                for t in grow:
                    rows, label, weight = codes, labels[t if labels.shape[0] > 1 else 0], None
                    if weights is not None:
                        used = np.flatnonzero(weights[t - base])
                        rows, weight = codes[used], weights[t - base][used].astype(float)
                        label = label[used] * weight
                    h = _histogram(_places(rows, known[t]), rows, width, label, weight)
                    out[t] = out[t] + h if t in out else h
            yield from out.items()

        def best(t: int, h: np.ndarray, level=level) -> tuple[np.ndarray, ...]:
            return _best(h, least, None if subset is None else subset(t, level))

        per = state.mapPartitions(sums)
        if parts * len(grow) * width * features * BINS * 16 <= DRIVER_BYTES:
            added: dict[int, np.ndarray] = {}
            for t, h in per.collect():
                added[t] = added[t] + h if t in added else h
            found = [(t, best(t, h)) for t, h in added.items()]
        else:
            found = per.reduceByKey(np.add, min(parts, len(grow))).map(lambda x: (x[0], best(*x))).collect()  # splits only
        for t, (feature, cut, left, right, split) in found:
            split &= live[t]
            before = values[t][-1]
            levels[t] = [*levels[t], (np.where(split, feature, 0), np.where(split, cut, BINS))]
            values[t].append(np.stack([np.where(split, left, before), np.where(split, right, before)], 1).ravel())
            live[t] = np.repeat(split, 2)
    return {t: (levels[t], values[t]) for t in depths}


class _TreeParams(HasLabelCol, HasFeaturesCol, HasPredictionCol, HasSeed):
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "rows on each side of a split", TypeConverters.toInt)


class TreeEstimator(Estimator, _TreeParams, DefaultParamsReadable, DefaultParamsWritable):
    def _fit(self, dataset: DataFrame) -> TreesModel:
        return fit_together(dataset, [self])[0]

    def _kin(self) -> tuple:
        """What estimators must share to be fitted in the same jobs."""
        raise NotImplementedError

    @classmethod
    def _trees(cls, blocks: RDD, features: int, kin: Sequence[TreeEstimator]) -> list[list[Tree]]:
        """Trees of each of ``kin``."""
        raise NotImplementedError


def fit_together(dataset: DataFrame, estimators: Sequence[TreeEstimator]) -> list[TreesModel]:
    """A model of each estimator, the same as if it were fitted alone; features and label are those of the first."""
    first = estimators[0]
    x, y = vector_to_array(first.getFeaturesCol()), F.col(first.getLabelCol()).cast("double")
    if any((e.getFeaturesCol(), e.getLabelCol()) != (first.getFeaturesCol(), first.getLabelCol()) for e in estimators):
        raise ValueError("estimators fitted together must have the same features and label")
    rows = dataset.select(x.alias("x"), y.alias("y"))
    n, mean, bad, features = rows.agg(F.count(F.lit(1)), F.avg("y"), F.count_if(F.col("y").isNull() | F.isnan("y")), F.max(F.size("x"))).first()
    if not n or bad:
        raise ValueError("no rows to train on" if not n else "labels must not be null or NaN")
    cuts = thresholds(rows, features)
    families: dict[tuple, list[int]] = {}
    for i, e in enumerate(estimators):
        families.setdefault((type(e), *e._kin()), []).append(i)
    blocks = _blocks(rows, cuts, mean, n).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        with ThreadPool(len(families)) as pool:
            grow = inheritable_thread_target(dataset.sparkSession)(lambda own: type(estimators[own[0]])._trees(blocks, features, [estimators[i] for i in own]))
            found = pool.map(grow, families.values(), chunksize=1)
    finally:
        blocks.unpersist()
    trees = {i: t for own, each in zip(families.values(), found, strict=True) for i, t in zip(own, each, strict=True)}
    return [_model(e, trees[i], cuts, mean) for i, e in enumerate(estimators)]


def _model(estimator: TreeEstimator, trees: list[Tree], cuts: list[np.ndarray], mean: float) -> TreesModel:
    ends = [np.r_[c, np.full(BINS + 1 - c.size, np.inf)] for c in cuts]
    flat = [(f, ends[f][c]) for levels, _ in trees for feature, cut in levels for f, c in zip(feature.tolist(), cut.tolist(), strict=True)]
    model = TreesModel(uid=estimator.uid)
    model._set(depths=[len(levels) for levels, _ in trees], feature=[f for f, _ in flat], threshold=[float(c) for _, c in flat],
               value=[float(v) for _, value in trees for v in value], start=float(mean))
    return estimator._copyValues(model)


class BoostedTrees(TreeEstimator, HasMaxIter, HasStepSize):
    """Gradient boosting with squared loss."""

    @keyword_only
    def __init__(self, *, maxIter=20, maxDepth=5, minInstancesPerNode=1, stepSize=0.1, seed=42):
        super().__init__()
        self._setDefault(maxIter=20, maxDepth=5, minInstancesPerNode=1, stepSize=0.1, seed=42)
        self._set(**self._input_kwargs)

    def _kin(self) -> tuple:
        return self.getOrDefault("maxDepth"), self.getOrDefault("minInstancesPerNode")

    @classmethod
    def _trees(cls, blocks: RDD, features: int, kin: Sequence[BoostedTrees]) -> list[list[Tree]]:
        depth, least = kin[0]._kin()
        rounds = {step: max(e.getMaxIter() for e in kin if e.getStepSize() == step) for step in sorted({e.getStepSize() for e in kin})}
        out: dict[float, list[Tree]] = {step: [] for step in rounds}
        state, old, live = blocks, None, [step for step in rounds if rounds[step]]
        k = 0
        while live:
            # the first tree is the same for every step
            grown = _grown(state, dict.fromkeys(range(len(live) if k else 1), depth), least, features)
            if old is not None:
                old.unpersist()
            for i, step in enumerate(live):
                levels, values = grown[i if k else 0]
                out[step].append((levels, 2 * step * values[-1] if k else values[-1]))
            going = [i for i, step in enumerate(live) if k + 1 < rounds[step]]
            old = state if state is not blocks else None
            if going:
                state = _reduced(state, [(i if k else 0, *out[live[i]][-1]) for i in going])
                if (k + 1) % CUT_ROUNDS == 0:
                    state = _kept(state, features)
                state = state.persist(StorageLevel.MEMORY_AND_DISK)
            live, k = [live[i] for i in going], k + 1
        if old is not None:
            old.unpersist()
        return [out[e.getStepSize()][: e.getMaxIter()] for e in kin]


def _reduced(state: RDD, trees: list[tuple[int, list, np.ndarray]]) -> RDD:
    """Labels of each (series before, levels, values) less its tree's predictions."""
    return state.map(lambda b: (b[0], b[1], np.stack([b[2][i] - value[_places(b[1], levels)] for i, levels, value in trees]), None))


def _kept(state: RDD, features: int) -> RDD:
    frame = state.map(lambda b: (b[0], b[1].tobytes(), b[2].tobytes())).toDF(_BLOCK)
    return _arrays(materialize(frame, "residuals").repartition(state.getNumPartitions()), features)


class Forest(TreeEstimator):
    """Random forest: Poisson bootstrap, a third of the features at each node."""

    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, numTrees=20, maxDepth=5, minInstancesPerNode=1, seed=42):
        super().__init__()
        self._setDefault(numTrees=20, maxDepth=5, minInstancesPerNode=1, seed=42)
        self._set(**self._input_kwargs)

    def _kin(self) -> tuple:
        return self.getOrDefault("minInstancesPerNode"), self.getSeed(), self.getOrDefault("numTrees") > 1

    @classmethod
    def _trees(cls, blocks: RDD, features: int, kin: Sequence[Forest]) -> list[list[Tree]]:
        least, seed, many = kin[0]._kin()
        picked = max(math.ceil(features / 3), 1) if many else features
        sizes = [(e.getOrDefault("numTrees"), e.getOrDefault("maxDepth")) for e in kin]
        depths = {t: max(d for n, d in sizes if t < n) for t in range(max(n for n, _ in sizes))}

        def weighed(block: tuple, own: list[int]) -> tuple:
            number, codes, y, _ = block
            return number, codes, y, np.stack([np.random.default_rng([seed, t, number]).poisson(1.0, y.shape[1]).astype(np.uint8) for t in own])

        def subset(tree: int, level: int) -> np.ndarray:
            order = np.random.default_rng([seed, tree, level, 1]).random((2**level, features)).argsort(1)
            return order < picked

        group = min(GROUP_TREES, max(1, GROUP_BYTES // (2 ** max(max(depths.values()) - 1, 0) * features * BINS * 16)))
        grown: dict[int, tuple] = {}
        for lo in range(0, len(depths), group):
            own = {t: depths[t] for t in range(lo, min(lo + group, len(depths)))}
            state = blocks.map(lambda b, own=list(own): weighed(b, own)).persist(StorageLevel.MEMORY_AND_DISK) if many else blocks
            grown |= _grown(state, own, least, features, subset)
            if many:
                state.unpersist()
        # a tree of fewer levels is the upper part of the deeper one
        return [[(levels[:depth], values[min(depth, len(levels))] / n) for levels, values in (grown[t] for t in range(n))] for n, depth in sizes]


class TreesModel(Model, _TreeParams, DefaultParamsReadable, DefaultParamsWritable):
    """``start`` plus the sum of all trees.  A tree's levels lie behind each other, places
    of a level in order; a row goes right if its feature is above the threshold."""

    depths = Param(Params._dummy(), "depths", "levels of each tree", TypeConverters.toListInt)
    feature = Param(Params._dummy(), "feature", "feature by tree, level and place", TypeConverters.toListInt)
    threshold = Param(Params._dummy(), "threshold", "threshold by tree, level and place", TypeConverters.toListFloat)
    value = Param(Params._dummy(), "value", "value by tree and leaf", TypeConverters.toListFloat)
    start = Param(Params._dummy(), "start", "value before any tree", TypeConverters.toFloat)

    def __init__(self, uid: str | None = None):
        super().__init__()
        if uid:
            self._resetUid(uid)

    def trees(self) -> list[Tree]:
        feature, threshold, value = (np.array(self.getOrDefault(c)) for c in ("feature", "threshold", "value"))
        out, at, leaf = [], 0, 0
        for depth in self.getOrDefault("depths"):
            places = [slice(at + 2**k - 1, at + 2 ** (k + 1) - 1) for k in range(depth)]
            out.append(([(feature[p].astype(np.int64), threshold[p]) for p in places], value[leaf : leaf + 2**depth]))
            at, leaf = at + 2**depth - 1, leaf + 2**depth
        return out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        trees, start = self.trees(), self.getOrDefault("start")

        @F.arrow_udf("double")
        def predicted(x: pa.Array) -> pa.Array:
            if not len(x):
                return pa.array([], pa.float64())
            rows = _matrix(x)
            return pa.array(sum((value[_places(rows, levels)] for levels, value in trees), np.full(len(x), start)))

        return dataset.withColumn(self.getPredictionCol(), predicted(vector_to_array(self.getFeaturesCol())))
