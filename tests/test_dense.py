from __future__ import annotations

import numpy as np
import pytest

from nearprint.operators import dense


def clustered(n: int, width: int, seed: int) -> np.ndarray:
    """A third of the vectors lie in one tight bundle; some are equal, some are zero."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    out = centres[rng.integers(0, 6, n)] + 0.3 * rng.normal(size=(n, width))
    out[::3] = centres[0] + 0.05 * rng.normal(size=(len(out[::3]), width))
    out[1:12:2] = out[1]
    out[4] = 0
    return out


@pytest.mark.parametrize("threshold", [0.0, 0.4, 0.9])
@pytest.mark.parametrize("rows_per_slice", [1000, 12])
def test_equals_brute_force(spark, threshold, rows_per_slice):
    values = clustered(120, 8, seed=1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "id long, encoded array<double>")
    found = dense.similar_vectors(df, threshold, rows_per_slice).collect()
    norms = np.linalg.norm(values, axis=1, keepdims=True)
    unit = np.divide(values, norms, out=np.zeros_like(values), where=norms > 0)
    scores = unit @ unit.T
    expected = {(a, b) for a, b in zip(*np.nonzero(scores > threshold)) if a != b}
    assert len(found) == len(expected) and {(r.id, r.similar_id) for r in found} == expected
    for r in found:
        assert r.score == pytest.approx(scores[r.id, r.similar_id], abs=1e-9)


def test_cells_far_apart_are_not_visited(spark):
    """Two bundles at a right angle: no vector travels to the other's cell."""
    rng = np.random.default_rng(2)
    values = np.repeat(np.eye(2), 50, axis=0) + 0.01 * rng.random((100, 2))
    unit = values / np.linalg.norm(values, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit)], "id long, unit array<double>")
    assert dense._visits(df, 0.9, rows_per_slice=50).count() < 200


def test_no_vectors(spark):
    df = spark.createDataFrame([], "id long, encoded array<double>")
    assert dense.similar_vectors(df, 0.5).count() == 0


def test_groups_hold_about_as_many_and_cover_every_cell():
    first, slices = dense._groups(np.array([3, 4, 25, 0, 2, 9, 1]), 10)
    assert first.tolist() == [0, 0, 1, 4, 4, 5, 5] and slices.tolist() == [1, 1, 3, 1, 1, 1, 1]


def test_a_vector_travels_once_to_a_group(spark):
    """Many small cells, all visited: no row for each of them."""
    values = clustered(400, 8, seed=3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "id long, encoded array<double>")
    vectors = dense._unit(df).select("id", "unit")
    homes, _, residents, _ = dense._homes(vectors, 0.0, 4)
    assert dense._visits(vectors, 0.0, 4).count() > 20 * homes.count()
    most = int(residents.max())
    first, slices = dense._groups(residents, max(most, 200))
    assert int((first + slices).max()) <= 3
