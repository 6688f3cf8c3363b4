"""Gradient boosting (M6): one regression tree per class and round, by softmax loss or each class against the others.

Features are cut into at most ``maxBins`` bins, the rows written once in blocks of bytes
with their raw scores. A tree level is one Spark job: each task adds up gradient, hessian
and count per (class, open node, bin); sums of many tasks are added in groups, so that the
driver sees bins x open nodes x classes numbers of a few tasks, whatever the number of rows. Splits of a
node depend on its rows alone, so growing all open nodes of a level together and then
taking splits by falling gain gives the best-first tree of at most ``maxLeaves`` leaves.
Leaf values are Newton steps. Scores of the rounds so far are written into the table every
few rounds, in two places used in turn; between that, tasks add the newest trees themselves.
"""

from __future__ import annotations

import heapq
import math
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Rounds between two writings of the scores.
WRITE_EVERY = 4
_LEAST_HESSIAN = 1e-3
#: Codes of a bin: missing and at most 255 others.
_CODES = 256
#: Parts of the table up to which their sums go to the driver as they are; more are added up in groups first.
FEW_PARTS = 32


@dataclass
class Tree:
    """Nodes as parallel lists; ``feature`` -1 is a leaf. A row goes left where its bin is at most ``at``, or missing and ``missing_left``."""
    feature: list[int] = field(default_factory=lambda: [-1])
    at: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    missing_left: list[bool] = field(default_factory=lambda: [True])
    value: list[float] = field(default_factory=lambda: [0.0])

    def leaf(self) -> int:
        for part, empty in ((self.feature, -1), (self.at, 0), (self.left, -1), (self.right, -1), (self.missing_left, True), (self.value, 0.0)):
            part.append(empty)
        return len(self.feature) - 1

    def descend(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row of bins (0 is missing) ends in."""
        feature, at, left, right = (np.array(x) for x in (self.feature, self.at, self.left, self.right))
        inner = np.flatnonzero(feature >= 0)
        depth, level = 0, inner[:1] * 0
        while level.size:
            level, depth = np.concatenate([left[level], right[level]]), depth + 1
            level = level[feature[level] >= 0]
        # Where a row of each bin goes from each node; leaves lead to themselves.
        to, b = np.repeat(np.arange(len(feature)), _CODES).reshape(-1, _CODES), np.arange(_CODES)
        goes_left = np.where(b == 0, np.array(self.missing_left)[inner, None], b <= at[inner, None])
        to[inner] = np.where(goes_left, left[inner, None], right[inner, None])
        to, feature = to.ravel(), np.maximum(feature, 0)
        flat, start, node = np.ascontiguousarray(bins).ravel(), np.arange(len(bins)) * bins.shape[1], np.zeros(len(bins), np.int64)
        for _ in range(depth):
            node = to[node * _CODES + flat[start + feature[node]]]
        return node

    def add(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.descend(bins)]


def binned(values: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """Bin of each value: 0 if missing, else 1 + the number of edges below it."""
    out = np.zeros(values.shape, np.uint8)
    for j, e in enumerate(edges):
        known = ~np.isnan(values[:, j])
        out[known, j] = 1 + np.searchsorted(np.array(e), values[known, j], "left")
    return out


def _softmax(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _scores(raw: np.ndarray, bins: np.ndarray, rounds: list[list[Tree]]) -> np.ndarray:
    for trees in rounds:
        raw = raw + np.stack([t.add(bins) for t in trees], axis=1)
    return raw


def _unpack(block, width: int, classes: int):
    """(bins, raw, y, w) of a block of rows."""
    return (np.frombuffer(block["bins"], np.uint8).reshape(-1, width), np.frombuffer(block["raw"]).reshape(-1, classes), np.frombuffer(block["y"], np.int32),
            np.frombuffer(block["w"]))


def _softmax_sums(raw: np.ndarray, y: np.ndarray, w: np.ndarray, first: bool):
    """Gradients and hessians [row, class] of the multinomial loss, its sum and the sum of weights."""
    p, own = _softmax(raw), y[:, None] == np.arange(raw.shape[1])
    return w[:, None] * (p - own), w[:, None] * p * (1 - p), (-(w * np.log(np.maximum(p[own], 1e-300))).sum(), w.sum())


def _against_rest_sums(raw: np.ndarray, y: np.ndarray, w: np.ndarray, first: bool):
    """As Spark's boosting has it for two classes, for each class against the others: trees fit the labels -1 and 1 first, then 4y / (1 + exp(2yF))."""
    t = np.where(y[:, None] == np.arange(raw.shape[1]), 1.0, -1.0)
    residual = t if first else 4.0 * t / (1.0 + np.exp(np.minimum(2.0 * t * raw, 700.0)))
    return -w[:, None] * residual, np.repeat(w[:, None], raw.shape[1], axis=1), ((w[:, None] * 2.0 * np.logaddexp(0.0, -2.0 * t * raw)).sum(), w.sum())


def _histograms(gradients, first: bool, rounds: list[list[Tree]], growing: list[Tree], open_nodes: list[list[int]], offsets: np.ndarray, total: int):
    """Of a part of the table: for each class, sums [open node, bin, (gradient, hessian, rows)]; and the loss before this round with the weights."""
    classes, width = len(growing), len(offsets)

    def rows(blocks: Iterator) -> Iterator[list[np.ndarray]]:
        sums = [np.zeros((len(nodes), total, 3)) for nodes in open_nodes]
        loss = np.zeros(2)
        for block in blocks:
            bins, raw, y, w = _unpack(block, width, classes)
            g, h, own = gradients(_scores(raw, bins, rounds), y, w, first)
            loss += own
            for c, nodes in enumerate(open_nodes):
                if not nodes:
                    continue
                slot = np.full(len(growing[c].feature), -1)
                slot[nodes] = np.arange(len(nodes))
                at = slot[growing[c].descend(bins)]
                here = np.flatnonzero(at >= 0)
                cell = (at[here, None] * total + offsets + bins[here]).ravel()
                for k, weights in enumerate((np.repeat(g[here, c], width), np.repeat(h[here, c], width), None)):
                    sums[c][:, :, k] += np.bincount(cell, weights, len(nodes) * total).reshape(len(nodes), total)
        yield [*sums, loss]

    return rows


@dataclass(frozen=True)
class _Split:
    gain: float
    feature: int
    at: int
    missing_left: bool
    left: tuple[float, float, float]
    right: tuple[float, float, float]


def best_splits(sums: np.ndarray, offsets: np.ndarray, total: int, least_rows: int, l2: float) -> list[_Split | None]:
    """The split of most gain of each node of ``sums[node, bin, (gradient, hessian, rows)]``; missing values are tried on both sides.

    Of equal gains the first counts: by feature, missing values to the left before the right, and bin.
    """
    if not len(sums):
        return []
    ends = np.array([*offsets[1:], total])
    most = int((ends - offsets).max())
    place = offsets[:, None] + np.arange(most)
    real = place < ends[:, None]
    own = np.where(real[..., None], sums[:, np.minimum(place, total - 1)], 0.0)
    whole, missing = own.sum(axis=2), own[:, :, 0]
    below = np.cumsum(own[:, :, 1:], axis=2)[:, :, :-1]
    left = np.stack([below + missing[:, :, None], below], axis=2)
    if not left.shape[3]:
        return [None] * len(sums)
    right = whole[:, :, None, None] - left
    scored = lambda s: s[..., 0] ** 2 / (s[..., 1] + l2 + 1e-12)
    gain = scored(left) + scored(right) - scored(whole)[:, :, None, None]
    sound = (np.minimum(left[..., 2], right[..., 2]) >= least_rows) & (np.minimum(left[..., 1], right[..., 1]) >= _LEAST_HESSIAN)
    # The last bin has nothing above it, and without missing values both sides are the same.
    sound &= (place[:, 2:] < ends[:, None])[None, :, None]
    sound[:, :, 1] &= missing[:, :, None, 2] > 0
    gain = np.where(sound, gain, -np.inf).reshape(len(sums), -1)
    at = gain.argmax(axis=1)
    out: list[_Split | None] = []
    for k, best in enumerate(at):
        f, side, b = np.unravel_index(best, left.shape[1:4])
        out.append(_Split(float(gain[k, best]), int(f), int(b) + 1, bool(side == 0), tuple(left[k, f, side, b].tolist()), tuple(right[k, f, side, b].tolist())) if gain[k, best] > 1e-9 else None)
    return out


class _Growing:
    """One class's tree of a round. Splits are known for nodes whose level was summed; the leaves are chosen by falling gain."""

    def __init__(self, depth: int, leaves: int):
        self.depth, self.leaves = depth, leaves
        self.full = Tree()
        self.level = {0: 0}
        self.splits: dict[int, _Split] = {}
        self.sums: dict[int, tuple[float, float]] = {}
        self.open = [0]
        #: Of an open node: the sibling that is not summed, and their parent. Histograms of nodes that may yet be split.
        self.siblings: dict[int, tuple[int, int]] = {}
        self.held: dict[int, np.ndarray] = {}

    def _chosen(self) -> list[int]:
        """Nodes split when splits are taken by falling gain until there are enough leaves."""
        heap = [(-self.splits[0].gain, 0)] if 0 in self.splits else []
        out = []
        while heap and len(out) < self.leaves - 1:
            _, k = heapq.heappop(heap)
            out.append(k)
            for child in (self.full.left[k], self.full.right[k]):
                if child in self.splits:
                    heapq.heappush(heap, (-self.splits[child].gain, child))
        return out

    def take(self, sums: list[np.ndarray], offsets: np.ndarray, total: int, least_rows: int, l2: float) -> None:
        """The sums of the open nodes; opens the next level where its nodes could still be among the leaves.

        Of two children only the one of fewer rows is summed; the other is what it leaves of their parent.
        """
        known = dict(zip(self.open, sums, strict=True))
        if 0 in known:
            # Every row is in one bin of the first feature.
            self.sums[0] = tuple(known[0][:offsets[1] if len(offsets) > 1 else total, :2].sum(axis=0))
        known |= {other: self.held[parent] - known[k] for k, (other, parent) in self.siblings.items()}
        self.held |= known
        for k, split in zip(known, best_splits(np.array(list(known.values())), offsets, total, least_rows, l2), strict=True):
            if split:
                self.splits[k] = split
        self.open, self.siblings = [], {}
        for k in self._chosen():
            if self.full.feature[k] >= 0:
                continue
            s = self.splits[k]
            a, b = self.full.leaf(), self.full.leaf()
            self.full.feature[k], self.full.at[k], self.full.left[k], self.full.right[k], self.full.missing_left[k] = s.feature, s.at, a, b, s.missing_left
            self.sums[a], self.sums[b] = s.left[:2], s.right[:2]
            self.level[a] = self.level[b] = self.level[k] + 1
            if self.level[a] < self.depth:
                small, other = (a, b) if s.left[2] <= s.right[2] else (b, a)
                self.open.append(small)
                self.siblings[small] = (other, k)

    def done(self, step: float, l2: float) -> Tree:
        """The tree of the chosen splits alone, with Newton steps in its leaves."""
        chosen, out = set(self._chosen()), Tree()

        def put(k: int, at: int) -> None:
            if k in chosen:
                s = self.splits[k]
                a, b = out.leaf(), out.leaf()
                out.feature[at], out.at[at], out.left[at], out.right[at], out.missing_left[at] = s.feature, s.at, a, b, s.missing_left
                put(self.full.left[k], a)
                put(self.full.right[k], b)
            else:
                g, h = self.sums[k]
                out.value[at] = float(-step * g / (h + l2 + 1e-12))

        put(0, 0)
        return out


class _BoostingParams(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "vector of features; NaN is missing", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "class 0, 1, ...", TypeConverters.toString)
    weightCol = Param(Params._dummy(), "weightCol", "row weights; empty for none", TypeConverters.toString)
    maxIter = Param(Params._dummy(), "maxIter", "rounds", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of a tree", TypeConverters.toInt)
    maxLeaves = Param(Params._dummy(), "maxLeaves", "leaves of a tree", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "rows of a leaf", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "share of a Newton step", TypeConverters.toFloat)
    l2 = Param(Params._dummy(), "l2", "added to hessians", TypeConverters.toFloat)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature, at most 255", TypeConverters.toInt)

    def _defaults(self) -> None:
        self._setDefault(featuresCol="features", labelCol="label", weightCol="", maxIter=300, maxDepth=8, maxLeaves=31, minInstancesPerNode=20, stepSize=0.05,
                         l2=0.0, maxBins=255)


class SoftmaxBoosting(Estimator, _BoostingParams, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees for several classes at once."""

    gradients, first_step = staticmethod(_softmax_sums), None

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", weightCol="", maxIter=300, maxDepth=8, maxLeaves=31, minInstancesPerNode=20, stepSize=0.05,
                 l2=0.0, maxBins=255):
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> SoftmaxBoostingModel:
        g = self.getOrDefault
        weight = F.col(g("weightCol")).cast("double") if g("weightCol") else F.lit(1.0)
        rows = dataset.select(F.col(g("labelCol")).cast("int").alias("y"), weight.alias("w"), vector_to_array(g("featuresCol")).alias("x")).where(F.col("y").isNotNull())
        priors = {r["y"]: r["w"] for r in rows.groupBy("y").agg(F.sum("w").alias("w")).collect()}
        if not priors:
            raise ValueError("no labelled rows")
        classes = max(priors) + 1
        edges = bin_edges(rows, g("maxBins"))
        base = self._base(np.array([priors.get(c, 0.0) for c in range(classes)]))
        table = _Table(rows, edges, base, classes)
        offsets = np.cumsum([0, *[len(e) + 2 for e in edges]])[:-1]
        total = int(sum(len(e) + 2 for e in edges))
        rounds, losses = [], []
        for k in range(g("maxIter")):
            if k and k % WRITE_EVERY == 0:
                table.write(rounds[-WRITE_EVERY:])
            fresh = rounds[k - k % WRITE_EVERY:]
            growing = [_Growing(g("maxDepth"), g("maxLeaves")) for _ in range(classes)]
            while any(t.open for t in growing):
                *found, loss = table.sums(self.gradients, k == 0, fresh, [t.full for t in growing], [t.open for t in growing], offsets, total)
                if len(losses) == k:
                    losses.append(float(loss[0] / loss[1]))
                for t, sums in zip(growing, found, strict=True):
                    t.take(list(sums), offsets, total, g("minInstancesPerNode"), g("l2"))
            step = self.first_step if k == 0 and self.first_step else g("stepSize")
            rounds.append([t.done(step, g("l2")) for t in growing])
        return self._copyValues(self._model()._with(edges, base, rounds, losses))

    def _base(self, weights: np.ndarray) -> list[float]:
        share = np.log(np.maximum(weights / weights.sum(), 1e-9))
        return [float(v) for v in share - share.mean()]

    def _model(self) -> SoftmaxBoostingModel:
        return SoftmaxBoostingModel()


class AgainstRestBoosting(SoftmaxBoosting):
    """Spark's boosting of two classes for each class against the others, the trees of all classes of a round in the same passes.

    Trees fit residuals by variance and add the mean of a leaf; the first counts whole, the others ``stepSize``. The model gives the margins as ``rawPrediction``.
    """

    gradients, first_step = staticmethod(_against_rest_sums), 1.0

    def _base(self, weights: np.ndarray) -> list[float]:
        return [0.0] * len(weights)

    def _model(self) -> AgainstRestBoostingModel:
        return AgainstRestBoostingModel()


def bin_edges(rows: DataFrame, bins: int) -> list[list[float]]:
    """Rising edges of each feature of the array ``x``: distinct quantiles of its values, none of them the largest."""
    if not 2 <= bins <= 255:
        raise ValueError("bins must be 2 to 255")
    width = rows.select(F.size("x")).first()[0]
    at = [k / (bins - 1) for k in range(1, bins - 1)]
    cols = [F.when(~F.isnan(F.element_at("x", j + 1)), F.element_at("x", j + 1)) for j in range(width)]
    found = rows.agg(*[F.percentile_approx(c, at, 10_000).alias(f"q{j}") for j, c in enumerate(cols)], *[F.max(c).alias(f"m{j}") for j, c in enumerate(cols)]).first()
    return [sorted({float(v) for v in found[f"q{j}"] or [] if v < found[f"m{j}"]}) for j in range(width)]


def _block(y: np.ndarray, w: np.ndarray, bins: np.ndarray, raw: np.ndarray) -> pa.RecordBatch:
    columns = (y.astype(np.int32), w.astype(float), bins, raw.astype(float))
    return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], ["y", "w", "bins", "raw"])


class _Table:
    """Rows as blocks of (y, w, bins, raw scores), written in two places used in turn; a pass over them is one job of plain parts."""

    def __init__(self, rows: DataFrame, edges: list[list[float]], base: list[float], classes: int):
        self.spark, self.classes, self.width = rows.sparkSession, classes, len(edges)
        folder = os.path.join(ensure_checkpoint_dir(self.spark), "tables", f"boosting-{uuid.uuid4().hex}")
        self.places = [f"{folder}-a", f"{folder}-b"]
        self.schema = "y binary, w binary, bins binary, raw binary"

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    yield _block(batch.column("y").to_numpy(), batch.column("w").to_numpy(), binned(x, edges), np.tile(base, (batch.num_rows, 1)))

        self._put(rows.mapInArrow(first, self.schema))

    def _put(self, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self.places[0])
        self.table = self.spark.read.schema(self.schema).parquet(self.places[0])
        self.parts = self.table.rdd
        self.places.reverse()

    def write(self, rounds: list[list[Tree]]) -> None:
        width, classes = self.width, self.classes

        def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in batch.to_pylist():
                    bins, raw, y, w = _unpack(block, width, classes)
                    yield _block(y, w, bins, _scores(raw, bins, rounds))

        self._put(self.table.mapInArrow(later, self.schema))

    def sums(self, gradients, first: bool, rounds, growing, open_nodes, offsets, total) -> list[np.ndarray]:
        found = self.parts.mapPartitions(_histograms(gradients, first, rounds, growing, open_nodes, offsets, total))
        n = found.getNumPartitions()
        if n > FEW_PARTS:
            groups = math.isqrt(n)
            found = found.mapPartitionsWithIndex(lambda i, part: ((i % groups, x) for x in part)).reduceByKey(_added, groups).values()
        return reduce(_added, found.collect())


def _added(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    return [x + y for x, y in zip(a, b, strict=True)]


class SoftmaxBoostingModel(Model, _BoostingParams, MLReadable, MLWritable):
    """Adds probability and prediction. ``losses`` is the mean training loss before each round."""

    def __init__(self):
        super().__init__()
        self._defaults()

    def _with(self, edges, base, rounds, losses) -> SoftmaxBoostingModel:
        self.edges, self.base, self.rounds, self.losses = edges, base, rounds, losses
        return self

    def copy(self, extra=None):
        return super().copy(extra)._with(self.edges, self.base, self.rounds, self.losses)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        edges, base, rounds = self.edges, self.base, self.rounds

        @F.pandas_udf("array<double>")
        def scored(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            bins = binned(np.vstack(x.to_numpy()).astype(float), edges)
            return pd.Series(list(_softmax(_scores(np.tile(base, (len(x), 1)), bins, rounds))))

        rows = dataset.withColumn("probability", scored(vector_to_array(self.getOrDefault("featuresCol"))))
        best = (F.array_position("probability", F.array_max("probability")) - 1).cast("double")
        return rows.withColumns({"prediction": best, "probability": array_to_vector("probability")})

    def write(self) -> MLWriter:
        return _BoostingWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _BoostingReader(cls)


class AgainstRestBoostingModel(SoftmaxBoostingModel):
    """Adds the margin of each class against the others as rawPrediction, and prediction."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        edges, base, rounds = self.edges, self.base, self.rounds

        @F.pandas_udf("array<double>")
        def margins(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            bins = binned(np.vstack(x.to_numpy()).astype(float), edges)
            return pd.Series(list(_scores(np.tile(base, (len(x), 1)), bins, rounds)))

        rows = dataset.withColumn("rawPrediction", margins(vector_to_array(self.getOrDefault("featuresCol"))))
        best = (F.array_position("rawPrediction", F.array_max("rawPrediction")) - 1).cast("double")
        return rows.withColumns({"prediction": best, "rawPrediction": array_to_vector("rawPrediction")})


_NODES = "round int, cls int, node int, feature int, at int, left int, right int, missing_left boolean, value double"


class _BoostingWriter(MLWriter):
    def __init__(self, instance: SoftmaxBoostingModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        m = self.instance
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={"edges": m.edges, "base": m.base, "losses": m.losses})
        nodes = [(r, c, k, *x) for r, trees in enumerate(m.rounds) for c, t in enumerate(trees)
                 for k, x in enumerate(zip(t.feature, t.at, t.left, t.right, t.missing_left, t.value, strict=True))]
        self.sparkSession.createDataFrame(nodes, _NODES).write.parquet(os.path.join(path, "trees"))


class _BoostingReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> SoftmaxBoostingModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        classes = len(metadata["base"])
        rounds: list[list[Tree]] = []
        for r in self.sparkSession.read.schema(_NODES).parquet(os.path.join(path, "trees")).orderBy("round", "cls", "node").collect():
            if r["cls"] == 0 and r["node"] == 0:
                rounds.append([Tree([], [], [], [], [], []) for _ in range(classes)])
            t = rounds[r["round"]][r["cls"]]
            for part, v in zip((t.feature, t.at, t.left, t.right, t.missing_left, t.value), tuple(r)[3:], strict=True):
                part.append(v)
        return model._with(metadata["edges"], metadata["base"], rounds, metadata["losses"])
