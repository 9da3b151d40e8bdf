"""Boosted trees for quantiles, grown from histograms that Spark adds up.

A row's inputs become bin numbers once. A level of the trees of all quantiles is
one job: tasks count, for each node, input and bin, their rows and those that
lie below the present forecast, which gives the gradient of the pinball loss
exactly; one groupBy adds the counts up. Their number depends on the settings,
not on the rows, so the driver chooses the splits from them. A leaf adds the
quantile of what its rows lack.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.sinks import delete_path, shared_path

#: Exactness of the quantiles of inputs and leaves: their rank is off by one in so many rows.
ACCURACY = 10_000
#: Rounds after which forecasts are stored with the rows, so that no job runs through all trees.
STORED_EVERY = 8


@dataclass
class Tree:
    """A complete binary tree: node i has children 2 i + 1 and 2 i + 2.

    A row goes left if its bin of input ``feature[i]`` is at most ``cut[i]``;
    a negative input ends the way in a leaf. Missing inputs have bin 0.
    """

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        nodes = 2 ** (depth + 1) - 1
        return cls(np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes))

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        for _ in range(int(np.log2(len(self.feature) + 1)) - 1):
            feature = self.feature[at]
            right = bins[np.arange(len(bins)), np.maximum(feature, 0)] > self.cut[at]
            at = np.where(feature < 0, at, 2 * at + 1 + right)
        return at


def best_split(rows: np.ndarray, below: np.ndarray, level: float, least: int) -> tuple[int, int] | None:
    """(input, cut) that lowers the squared gradient most, from counts by input and bin.

    Neither side may have fewer than ``least`` rows; of equal ones the first
    input, then the lowest cut. None if nothing is gained.
    """
    n, b = np.cumsum(rows, axis=1), np.cumsum(below, axis=1)
    total, under = n[:, -1:], b[:, -1:]
    gradient = level * n - b
    whole = level * total - under
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gradient**2 / n + (whole - gradient) ** 2 / (total - n) - whole**2 / total
    gain = np.where((n >= least) & (total - n >= least), gain, -np.inf)
    at = int(gain.argmax())
    return divmod(at, gain.shape[1]) if gain.flat[at] > 1e-9 else None


class QuantileForest:
    """Quantile forecasts from boosted trees, one sequence for each level.

    Inputs may be null or not a number, which is a bin of its own. ``least`` is
    the fewest rows of a leaf. The result does not depend on partitions, but
    for the error of approximate quantiles (``ACCURACY``) on many rows.
    """

    def __init__(self, inputs: list[str], levels: tuple[float, ...] = (0.1, 0.5, 0.9), rounds: int = 16, depth: int = 3, bins: int = 32, rate: float = 0.3, least: int = 20) -> None:
        if not 2 <= bins <= 255 or depth < 1 or not all(0 < q < 1 for q in levels) or list(levels) != sorted(levels):
            raise ValueError("bins, depth or levels are out of range")
        self.inputs, self.levels, self.rounds, self.depth, self.bins, self.rate, self.least = list(inputs), tuple(levels), rounds, depth, bins, rate, least

    def _binned(self, columns: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(columns[0]) if columns else 0, len(columns)), np.uint8)
        for k, (x, edges) in enumerate(zip(columns, self.edges)):
            x = np.asarray(x, float)
            out[:, k] = np.where(np.isnan(x), 0, 1 + np.searchsorted(edges, x))
        return out

    def _forecast(self, bins: np.ndarray, stored: np.ndarray, since: int) -> np.ndarray:
        """Forecasts of all levels, from the stored ones and the trees of later rounds."""
        out = stored.copy()
        for k in range(len(self.levels)):
            for tree in self.trees[k][since:]:
                out[:, k] += tree.value[tree.leaves(bins)]
        return out

    def fit(self, rows: DataFrame, target: str = "y") -> QuantileForest:
        """Learn from rows whose target is there; without any, an error."""
        known = rows.where(F.col(target).isNotNull()).select(F.col(target).cast("double").alias("y"), *(F.nanvl(F.col(x).cast("double"), F.lit(None)).alias(x) for x in self.inputs))
        shares = [k / self.bins for k in range(1, self.bins)]
        found = known.agg(F.percentile_approx("y", list(self.levels), ACCURACY), *(F.percentile_approx(x, shares, ACCURACY).alias(x) for x in self.inputs)).first()
        if found[0] is None:
            raise ValueError("no row with a target to learn from")
        self.start = np.array(found[0])
        self.edges = [np.unique(np.array(e or [], float)) for e in found[1:]]
        self.trees: list[list[Tree]] = [[] for _ in self.levels]
        spark, since, path = rows.sparkSession, 0, shared_path(rows.sparkSession, "binned")
        # Every job reads these files: one for each core, not one for each partition of the input.
        self._stored(known.coalesce(spark.sparkContext.defaultParallelism)).write.parquet(path)
        try:
            for done in range(self.rounds):
                table = spark.read.parquet(path)
                trees = [Tree.empty(self.depth) for _ in self.levels]
                for depth in range(self.depth):
                    if not self._split_level(table, trees, since, depth):
                        break
                self._fill_leaves(table, trees, since)
                for mine, tree in zip(self.trees, trees):
                    mine.append(tree)
                if (done + 1) % STORED_EVERY == 0 and done + 1 < self.rounds:
                    old, path = path, shared_path(spark, "binned")
                    self._moved(table, since).write.parquet(path)
                    delete_path(spark, old)
                    since = done + 1
        finally:
            delete_path(spark, path)
        return self

    def _stored(self, known: DataFrame) -> DataFrame:
        start = self.start

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = self._binned([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
                yield self._batch(batch.column(0), bins, np.tile(start, (len(bins), 1)))

        return known.mapInArrow(run, "y double, bins binary, forecast array<double>")

    @staticmethod
    def _batch(y: pa.Array, bins: np.ndarray, forecast: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * forecast.shape[1], pa.int32()), pa.array(forecast.ravel()))
        return pa.RecordBatch.from_arrays([y, pa.array([b.tobytes() for b in bins], pa.binary()), lists], ["y", "bins", "forecast"])

    def _read(self, batch: pa.RecordBatch, since: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, len(self.inputs))
        stored = batch.column("forecast").flatten().to_numpy().reshape(batch.num_rows, len(self.levels))
        return batch.column("y").to_numpy(), bins, self._forecast(bins, stored, since)

    def _moved(self, table: DataFrame, since: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, bins, now = self._read(batch, since)
                yield self._batch(batch.column("y"), bins, now)

        return table.mapInArrow(run, "y double, bins binary, forecast array<double>")

    def _split_level(self, table: DataFrame, trees: list[Tree], since: int, depth: int) -> bool:
        """Split the nodes of one depth in the trees of all levels; false if none can be."""
        wide, first, nodes = self.bins + 1, 2**depth - 1, 2**depth

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros((len(trees), 2, nodes, len(self.inputs), wide), np.int64)
            for batch in batches:
                y, bins, now = self._read(batch, since)
                for k, tree in enumerate(trees):
                    at = tree.leaves(bins) - first
                    mine = at >= 0  # leaves that ended higher up have smaller numbers
                    for side, weight in enumerate((np.ones(len(y)), (y < now[:, k]).astype(float))):
                        for f in range(len(self.inputs)):
                            counts[k, side, :, f] += np.bincount(at[mine] * wide + bins[mine, f], weight[mine], nodes * wide).reshape(nodes, wide).astype(np.int64)
            level, node, f, b = np.nonzero(counts[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (level, node, f, b, counts[level, 0, node, f, b], counts[level, 1, node, f, b])], ["level", "node", "input", "bin", "rows", "below"])

        added = table.mapInArrow(run, "level long, node long, input long, bin long, rows long, below long").groupBy("level", "node", "input", "bin").agg(F.sum("rows").alias("rows"), F.sum("below").alias("below"))
        # As many rows as there are nodes, inputs and bins, whatever the data.
        got = added.toPandas().to_numpy(np.int64)
        counts = np.zeros((2, len(trees), nodes, len(self.inputs), wide), np.int64)
        for side in (0, 1):
            counts[(side, *got[:, :4].T)] = got[:, 4 + side]
        split = False
        for k, tree in enumerate(trees):
            for node in range(nodes):
                found = best_split(counts[0, k, node], counts[1, k, node], self.levels[k], self.least) if counts[0, k, node].any() else None
                if found:
                    tree.feature[first + node], tree.cut[first + node] = found
                    split = True
        return split

    def _fill_leaves(self, table: DataFrame, trees: list[Tree], since: int) -> None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                y, bins, now = self._read(batch, since)
                for k, tree in enumerate(trees):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), k)), pa.array(tree.leaves(bins)), pa.array(y - now[:, k])], ["level", "leaf", "lack"])

        lacks = table.mapInArrow(run, "level long, leaf long, lack double").groupBy("level", "leaf")
        for r in lacks.agg(F.percentile_approx("lack", list(self.levels), ACCURACY).alias("lack")).collect():
            trees[r["level"]].value[r["leaf"]] = self.rate * r["lack"][r["level"]]

    def predict(self, inputs: list[Column]) -> Column:
        """Array of the forecasts of all levels, in ascending order: they never cross."""

        @F.pandas_udf("array<double>")
        def forecast(*columns: pd.Series) -> pd.Series:
            bins = self._binned([c.to_numpy(float) for c in columns])
            now = np.sort(self._forecast(bins, np.tile(self.start, (len(bins), 1)), 0), axis=1)
            return pd.Series(list(now))

        return forecast(*(x.cast("double") for x in inputs))
