"""Quantile forests against a tree grown row by row, and against the baselines."""

import math
import os
import random

import numpy as np
import pytest
from compare import DATA
from pyspark.sql import functions as F

from tidemark.operators.boosting import QuantileForest
from tidemark.plans import catalog


def by_rank(values, q):
    """The smallest value with at least a share q of all at or below it."""
    return sorted(values)[max(1, math.ceil(q * len(values))) - 1]


def grown(rows, now, q, depth, least):
    """[(way, input, largest value on the left or None, leaf rows)] of one tree, depth first."""

    def loss_gain(part):
        return (q * len(part) - sum(rows[i][0] < now[i] for i in part)) ** 2 / len(part)

    def node(part, left, way):
        best = None
        if left:
            for f in range(1, len(rows[0])):
                for value in [None, *sorted({rows[i][f] for i in part} - {None})]:
                    low = [i for i in part if rows[i][f] is None or (value is not None and rows[i][f] <= value)]
                    high = [i for i in part if i not in set(low)]
                    if len(low) >= least and len(high) >= least:
                        gain = loss_gain(low) + loss_gain(high) - loss_gain(part)
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, f, value, low, high)
        if best is None:
            return [(way, None, None, part)]
        _, f, value, low, high = best
        return [(way, f - 1, value, None), *node(low, left - 1, 2 * way + 1), *node(high, left - 1, 2 * way + 2)]

    return node(list(range(len(rows))), depth, 0)


def test_trees_equal_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(500):
        x = [rng.randint(0, 9), rng.choice([None, 1.0, 2.0, 3.0, 4.0, 5.0]), rng.randint(0, 5)]
        rows.append((x[0] * 0.3 + (x[1] or 7) * rng.gauss(0, 0.4) + rng.gauss(0, 1), *x))
    levels, rate, least = (0.1, 0.5, 0.9), 0.3, 15
    df = spark.createDataFrame(rows, "y double, a int, b double, c int").repartition(7)
    forest = QuantileForest(["a", "b", "c"], levels, rounds=3, depth=3, rate=rate, least=least).fit(df)
    for k, q in enumerate(levels):
        now = [by_rank([r[0] for r in rows], q)] * len(rows)
        for tree in forest.trees[k]:
            want = grown(rows, now, q, 3, least)
            splits = {way: (f, value) for way, f, value, part in want if part is None}
            got = {}
            for way in np.flatnonzero(tree.feature >= 0).tolist():
                f, cut = int(tree.feature[way]), int(tree.cut[way])
                got[way] = (f, None if cut == 0 else forest.edges[f][cut - 1])
            assert got == splits
            for way, _, _, part in want:
                if part is not None:
                    value = rate * by_rank([rows[i][0] - now[i] for i in part], q)
                    assert tree.value[way] == pytest.approx(value, abs=1e-9)
                    for i in part:
                        now[i] += value
        shown = df.withColumn("p", forest.predict([F.col(x) for x in "abc"])).collect()
        assert all(sorted(r["p"]) == list(r["p"]) for r in shown)


def test_forest_does_not_depend_on_partitions_or_missing_inputs(spark):
    rng = random.Random(5)
    rows = [(rng.gauss(0, 1), rng.choice([None, float("nan"), rng.random()]), None) for _ in range(300)] + [(None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "y double, a double, b double")
    one, other = (QuantileForest(["a", "b"], (0.25, 0.75), rounds=10, depth=2).fit(df.repartition(n)) for n in (1, 6))
    for a, b in zip(sum(one.trees, []), sum(other.trees, [])):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and np.allclose(a.value, b.value)
    assert {len(r["p"]) for r in df.select(one.predict([F.col("a"), F.col("b")]).alias("p")).collect()} == {2}
    with pytest.raises(ValueError):
        QuantileForest(["a"]).fit(df.where("y is null"))


def test_tasks_of_a_level_follow_the_cores_not_the_partitions(spark, monkeypatch):
    seen, split = [], QuantileForest._split_level

    def watched(self, table, *args):
        seen.append(len(table.inputFiles()))
        return split(self, table, *args)

    monkeypatch.setattr(QuantileForest, "_split_level", watched)
    rng = random.Random(8)
    df = spark.createDataFrame([(rng.gauss(0, 1), rng.random()) for _ in range(200)], "y double, a double")
    QuantileForest(["a"], (0.5,), rounds=2, depth=1).fit(df.repartition(40))
    assert seen and max(seen) <= spark.sparkContext.defaultParallelism


def test_model_beats_both_baselines_in_every_tercile(spark):
    """On the larger tables where they are there: a few hundred rows say little of coverage."""
    data = "/root/testdata/sf0.01" if os.path.isdir("/root/testdata/sf0.01") else DATA
    queries = catalog.queries()
    bands = queries["fc_bands"](spark, data).collect()
    assert sorted(r["tercile"] for r in bands) == [1, 2, 3]
    for r in bands:
        assert abs(r["coverage"] - 0.8) <= 0.05 and r["pinball"] < r["still"]
    (whole,) = queries["fc_model"](spark, data).collect()
    for base in ("fc_persistence", "fc_scores"):
        assert whole["pinball"] < {r["split"]: r["pinball"] for r in queries[base](spark, data).collect()}["test"]
