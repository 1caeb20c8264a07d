"""Boosted trees against a search of all splits, and against the baseline."""

from __future__ import annotations

import numpy as np
import pytest

from tidemark.operators import boosting
from tidemark.plans import training
from tidemark.sources.domain import Domain


def table(n=300, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 1)
    x[rng.random((n, 3)) < 0.15] = np.nan
    y = np.where(np.isnan(x[:, 0]), 5.0, x[:, 0] * 2) + np.where(x[:, 1] > 0, 3.0, 0.0) + rng.normal(size=n) * 0.1
    return x, np.round(y, 6)


def frame(spark, x, y):
    rows = [(*[None if np.isnan(v) else float(v) for v in r], float(t)) for r, t in zip(x, y, strict=True)]
    return spark.createDataFrame([*rows, (1.0, 1.0, 1.0, None)], "a double, b double, c double, y double")


def exhaustive(x, y, how):
    """A tree grown best first, each split by trying every value and both sides for nulls."""

    def best(rows):
        found = None
        for side in (False, True):
            for f in range(x.shape[1]):
                v = x[rows, f]
                for cut in np.unique(v[~np.isnan(v)])[:-1]:
                    left = np.where(np.isnan(v), side, v <= cut)
                    a, b = y[rows][left], y[rows][~left]
                    if len(a) < how.least_rows or len(b) < how.least_rows:
                        continue
                    gain = a.sum() ** 2 / len(a) + b.sum() ** 2 / len(b) - y[rows].sum() ** 2 / len(rows)
                    if gain > 1e-9 and (found is None or gain > found[0] + 1e-9):
                        found = (gain, left)
        return found

    leaves = [np.arange(len(y))]
    while len(leaves) < how.leaves:
        tries = [(b[0], k, b[1]) for k, rows in enumerate(leaves) if (b := best(rows))]
        if not tries:
            break
        _, k, left = max(tries, key=lambda t: t[0])
        rows = leaves.pop(k)
        leaves += [rows[left], rows[~left]]
    out = np.zeros(len(y))
    for rows in leaves:
        out[rows] = how.rate * y[rows].mean()
    return out, len(leaves)


@pytest.mark.parametrize("leaves", [2, 8, 31])
def test_splits_equal_a_search_of_all(spark, leaves):
    x, y = table()
    how = boosting.Boosting(rounds=2, rate=0.3, leaves=leaves, least_rows=10)
    model = boosting.fit(frame(spark, x, y), ("a", "b", "c"), "y", how)
    left = y - y.mean()
    assert model.start == pytest.approx(y.mean())
    bins = model.binned(x)
    for tree in model.trees:
        want, n = exhaustive(x, left, how)
        assert len({tuple(r) for r in tree.node_of(bins)[:, None]}) == n <= leaves
        assert tree.predict(bins) == pytest.approx(want, abs=1e-5)
        left = left - tree.predict(bins)
    assert model.predict(x) == pytest.approx(y - left)


def test_the_same_rows_give_the_same_trees_in_any_order(spark, monkeypatch):
    monkeypatch.setattr(boosting, "STORED", 2)  # predictions are stored on the way
    x, y = table()
    how = boosting.Boosting(rounds=5, leaves=6)
    one, two = (boosting.fit(f, ("a", "b", "c"), "y", how) for f in (frame(spark, x, y), frame(spark, x[::-1], y[::-1]).repartition(3)))
    assert [vars(t) for t in one.trees] == [vars(t) for t in two.trees] and len(one.trees) == 5
    rows = one.transform(frame(spark, x, y), ["y"]).collect()
    assert sorted(r.prediction for r in rows)[:-1] != [] and len(rows) == 301


def test_nothing_to_split(spark):
    x, y = table()
    none = frame(spark, x, y).limit(0)
    assert boosting.fit(none, ("a",), "y", boosting.Boosting(rounds=3)).trees == []
    flat = boosting.fit(frame(spark, x, np.full(len(y), 2.0)).where("y IS NOT NULL"), ("a", "b"), "y", boosting.Boosting(rounds=3))
    assert flat.trees == [] and flat.predict(x[:, :2]) == pytest.approx(np.full(len(y), 2.0))


def test_trees_beat_the_baseline_on_the_holdout(spark, sf_dir):
    train, val = training.split(Domain(spark, sf_dir).mart, 7)
    errors = training.metrics(training.boosted(train, val, boosting.Boosting(rounds=40)), "actual", "prediction").first()
    assert errors.mae < 0.9 * training.metrics(training.naive(train, val), "total_demand", "prediction").first().mae


def test_few_rows_are_one_task_of_a_step_and_the_trees_do_not_depend_on_it(spark, monkeypatch):
    rows = spark.range(0, 400, 1, 12).selectExpr("cast(id % 37 as double) AS a", "cast(id * id % 101 as double) AS y")
    blocks, parts, trees = boosting._blocks, [], []
    monkeypatch.setattr(boosting, "_blocks", lambda *a: parts.append((held := blocks(*a)).getNumPartitions()) or held)
    for most in (boosting.TASK_ROWS, 100):
        monkeypatch.setattr(boosting, "TASK_ROWS", most)
        trees.append(boosting.fit(rows, ("a",), "y", boosting.Boosting(rounds=2, leaves=4)).trees)
    assert parts[0] == 1 < parts[1] and trees[0] == trees[1]
