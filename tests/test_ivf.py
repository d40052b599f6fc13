"""The inverted file against exact neighbours."""

from __future__ import annotations

import numpy as np
import pytest

from sparkseek.operators.ivf import IvfIndex, fit_centres
from sparkseek.operators.vector import knn


def _table(spark, points):
    return spark.createDataFrame([(f"k{i:04}", [float(x) for x in p]) for i, p in enumerate(points)] + [("none", None)], "doc_key string, vector array<double>")


def _unit(points):
    return points / np.linalg.norm(points, axis=1, keepdims=True)


@pytest.mark.parametrize("clustered", [True, False])
def test_recall(spark, tmp_path, clustered):
    r = np.random.default_rng(3)
    middle = r.normal(size=(16, 12))[np.arange(800) % 16] * (4 if clustered else 0)
    points = _unit(middle + r.normal(size=(800, 12)))
    table = _table(spark, points)
    index = IvfIndex.build(table, str(tmp_path / "ivf"), lists=16)
    assert index.rows.count() == 800 and (index.probes < 6) == clustered
    found = 0
    for q in points[::100]:
        exact = {x.doc_key for x in knn(table.where("vector is not null"), q, 10).collect()}
        found += len(exact & {x.doc_key for x in index.search(q, 10).collect()})
    assert found >= 0.9 * 80
    one = index.search(points[0], 1, probes=1)
    assert one.first().doc_key == "k0000"
    rows = index.rows.where("list in (1, 2)")
    assert "PartitionFilters: [list" in rows._jdf.queryExecution().toString()  # only probed lists are read
    with pytest.raises(ValueError):
        index.search([1.0], 1)


def test_empty_and_few(spark, tmp_path):
    empty = IvfIndex.build(_table(spark, np.zeros((0, 3))), str(tmp_path / "empty"))
    assert empty.search([1.0, 0.0, 0.0]).count() == 0
    few = IvfIndex.build(_table(spark, np.array([[1.0, 0, 0], [1.0, 0, 0], [0, 0, 0]])), str(tmp_path / "few"))
    assert [x.doc_key for x in few.search([1.0, 0, 0], 2, probes=3).collect()] == ["k0000", "k0001"]


def test_centres_keep_their_number():
    assert fit_centres(np.ones((5, 2)), 3).shape == (3, 2)
