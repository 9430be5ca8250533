"""Ball trees against comparison of every vector with every centroid."""

import hashlib
import random

import numpy as np
import pytest

from veinstone.llm import ball_tree
from veinstone.llm.ball_tree import BallTree, clusters
from veinstone.llm.vectors import exact, squared

COLUMNS = "vec_id long, embedding array<float>, label int, cluster string, distance string"


def plain(rows, centroids, rounds, scale, components, seed=2):
    """(vec_id, cluster, distance) in whole numbers of Python, and the last centroids."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == components and all(x is not None and np.isfinite(x) for x in v)]
    begin = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    places = [v for _, v in begin[:centroids]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((apart(v, c), k) for k, c in enumerate(places))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for k in set(own):
            members = [v for (_, v), o in zip(kept, own) if o == k]
            places[k] = [sum(column) // len(members) for column in zip(*members)]
    return sorted(((i, nearest(v)[1], nearest(v)[0]) for i, v in kept), key=str), places


def rows_of(seed, count, components, spread, groups=6):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(components)] for _ in range(groups)]
    rows = [(k, [float(np.float32(x + rng.gauss(0, spread))) for x in rng.choice(centres)]) for k in range(count)]
    rows += [(k + count, rows[0][1]) for k in range(60)]  # copies
    rows += [(None, rows[1][1]), (3, rows[2][1]), (3, rows[4][1]), (-5, [0.0] * components)]
    rows += [(900, None), (901, [0.0] * (components - 1)), (902, [float("nan")] * components), (903, [None] + [0.0] * (components - 1)), (904, [float("inf")] * components), (905, [])]
    return [(i, v, 1, "x", "y") for i, v in rows]


@pytest.mark.parametrize("seed, spread, components, scale", [(1, 0.02, 4, 256), (2, 0.5, 8, 256), (3, 0.3, 3, 4), (4, 0.1, 5, 1 << 20)])
def test_equals_plain(spark, monkeypatch, seed, spread, components, scale):
    monkeypatch.setattr(ball_tree, "TREE", 64)
    rows = rows_of(seed, 300, components, spread)
    found = clusters(spark.createDataFrame(rows, COLUMNS).repartition(3), 7, 4, scale, components)
    expected, places = plain(rows, 7, 4, scale, components)
    assert sorted(map(tuple, found.rows.select("vec_id", "cluster", "distance").collect()), key=str) == expected
    assert found.centroids.tolist() == places


def test_whole_balls_need_fewer_distances():
    rng = np.random.default_rng(5)
    centres = rng.integers(-20_000, 20_000, (12, 16))
    points = (centres[rng.integers(0, 12, 4000)] + rng.integers(-300, 300, (4000, 16))).astype("i4")
    tree = BallTree.plant(np.arange(4000), np.ones(4000, bool), points)
    _, _, at, _, compared = tree.owners(centres)
    assert compared < 4000 * 12 / 20 and not len(at)
    counts, sums = np.zeros(12, "i8"), np.zeros((12, 16), "i8")
    tree.add_to(counts, sums, centres)
    own = squared(tree.points.astype("i8"), centres).argmin(axis=1)
    assert (tree.assigned(centres) == own).all() and (counts == np.bincount(own, minlength=12)).all()
    assert all((sums[k] == tree.points[own == k].sum(axis=0)).all() for k in range(12))


def test_ties_go_to_the_smaller_number():
    points = np.array([[0, 0], [2, 0], [1, 0]] * 30, "i4")
    tree = BallTree.plant(np.arange(90), np.ones(90, bool), points)
    assert tree.assigned(np.array([[2, 0], [0, 0], [2, 0], [0, 0]])).tolist() == [0 if x else 1 for x in (tree.points[:, 0] > 0)]


def test_copies_are_one_ball():
    tree = BallTree.plant(np.arange(5000), np.ones(5000, bool), np.tile(np.array([[7, -3]], "i4"), (5000, 1)))
    assert len(tree.start) == 1 and tree.radius.tolist() == [0]
    assert tree.owners(np.array([[0, 0], [9, 9]]))[4] == 2


def test_exact_types():
    assert exact(64, 1 << 20) is np.float64 and exact(64, 1 << 24) is np.int64
    far = np.full((1, 64), (1 << 24) - 1)
    assert squared(far, -far)[0, 0] == 64 * (2 * ((1 << 24) - 1)) ** 2


def test_too_few_and_none(spark):
    rows = [(1, [1.0, 2.0]), (None, [1.0, 2.5]), (2, [3.0, 0.0])]
    found = clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 40, 2, 256, 2)
    assert len(found.centroids) == 2 and {r["vec_id"]: r["distance"] for r in found.rows.collect()}[2] == 0
    assert clusters(spark.createDataFrame([(None, [1.0, 2.0])], "vec_id long, embedding array<double>"), 40, 2, 256, 2) is None


def test_component_out_of_range_is_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        clusters(spark.createDataFrame([(1, [1e30, 2.0])], "vec_id long, embedding array<double>"), 4, 1, 256, 2)
