"""Exponion search and its codebooks against comparison with every entry."""

import random

import numpy as np
import pytest

from veinstone.llm.exponion import compressed, exponion
from veinstone.llm.vectors import squared

COLUMNS = "vec_id long, embedding array<float>, label int, code string, part string, sums string"


def plain(rows, parts, entries, rounds, scale, size):
    """(vec_id, code, error) in whole numbers of Python, and the last codebooks."""
    kept = [(i, None if v is None else [int(np.floor(scale * float(x))) for x in v]) for i, v, *_ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = size // parts
    fit = [(i, v) for i, v in kept if len(v) == size]
    first = sorted((i, v) for i, v in fit if i is not None)[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v in first] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v, p: min((apart(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        own = [[nearest(v, p)[1] for _, v in fit] for p in range(parts)]
        for p in range(parts):
            for k in set(own[p]):
                members = [cut(v, p) for (_, v), o in zip(fit, own[p]) if o == k]
                books[p][k] = [sum(column) // len(members) for column in zip(*members)]
    found = [(i, bytes(nearest(v, p)[1] for p in range(parts)), sum(nearest(v, p)[0] for p in range(parts))) for i, v in fit]
    return sorted(found + [(i, None, None) for i, v in kept if len(v) != size], key=str), books


def rows_of(seed, count, size, spread):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(size)] for _ in range(9)]
    rows = [(k, [float(np.float32(x + rng.gauss(0, spread))) for x in rng.choice(centres)]) for k in range(count)]
    rows += [(k + count, rows[0][1]) for k in range(50)] + [(None, rows[1][1]), (3, rows[2][1]), (3, rows[4][1]), (-5, [0.0] * size)]
    rows += [(900, None), (901, [0.5] * (size - 1)), (902, [float("nan")] * size), (903, [None] + [0.0] * (size - 1)), (904, [float("-inf")] * size), (905, [])]
    return [(i, v, None if k % 7 == 0 else k % 3, "x", "y", "z") for k, (i, v) in enumerate(rows)]


@pytest.mark.parametrize("seed, spread, size, entries, scale", [(1, 0.02, 8, 16, 1024), (2, 0.5, 8, 256, 1024), (3, 0.4, 4, 20, 3), (4, 0.1, 12, 9, 1 << 18)])
def test_equals_plain(spark, seed, spread, size, entries, scale):
    rows = rows_of(seed, 150, size, spread)
    found = compressed(spark.createDataFrame(rows, COLUMNS).repartition(3), 4, entries, 3, scale)
    expected, books = plain(rows, 4, entries, 3, scale, size)
    got = [(r["vec_id"], None if r["code"] is None else bytes(r["code"]), r["error"]) for r in found.rows.collect()]
    assert sorted(got, key=str) == expected
    assert found.codebooks.tolist() == books
    decoded = {r["vec_id"]: r["vector"] for r in found.decoded().where("vec_id = -5").collect()}
    code = next(c for i, c, _ in expected if i == -5)
    assert decoded[-5] == [x for p, k in enumerate(code) for x in books[p][k]]


@pytest.mark.parametrize("start", ["none", "random", "worst"])
def test_any_start_finds_the_nearest_with_the_smaller_index(start):
    rng = np.random.default_rng(3)
    points, entries = rng.integers(-3, 4, (3000, 3)), rng.integers(-3, 4, (70, 3))  # many ties, and entries that repeat
    away = squared(points, entries)
    previous = {"none": None, "random": rng.integers(0, 70, 3000), "worst": away.argmax(axis=1)}[start]
    code, error, _ = exponion(points, entries, previous)
    assert (code == away.argmin(axis=1)).all() and (error == away.min(axis=1)).all()


def test_near_starts_need_fewer_distances():
    rng = np.random.default_rng(4)
    entries = rng.integers(-10_000, 10_000, (256, 4))
    own = rng.integers(0, 256, 8000)
    points = entries[own] + rng.integers(-40, 40, (8000, 4))
    code, _, compared = exponion(points, entries, own)
    assert (code == squared(points, entries).argmin(axis=1)).all()
    assert compared < 8000 * 256 / 20


def test_longs_where_doubles_would_round():
    points = np.array([[2**24 - 1] * 16, [-(2**24) + 1] * 16])
    code, error, _ = exponion(points, np.array([[-(2**24) + 1] * 16, [-(2**24) + 2] * 16]))
    assert code.tolist() == [1, 0] and error.tolist() == [16 * (2**25 - 3) ** 2, 0]


@pytest.mark.parametrize("rows", [[], [(None, [1.0] * 4, 1)], [(1, [1.0] * 3, 1)], [(1, [], 1)]])
def test_nothing_to_start_from(spark, rows):
    found = compressed(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert found.codebooks is None and [r["code"] for r in found.rows.collect()] == [None] * len(rows)
