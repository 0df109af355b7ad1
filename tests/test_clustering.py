"""Points and centres as matrices, held against plain Python."""

from __future__ import annotations

import math
import random

from brindle.operators import clustering

_RNG = random.Random(7)
POINTS = {i: [_RNG.choice([0.0, 1.0, 2.0]) for _ in range(4)] for i in range(60)}


def _points(spark, rows=None):
    return spark.createDataFrame(list((rows or POINTS).items()), "id long, features array<double>").repartition(3)


def _brute(centres):
    return {i: min((math.dist(x, c), k) for k, c in centres.items()) for i, x in POINTS.items()}


def test_plans_do_not_grow_with_centres(spark):
    wide = spark.createDataFrame([(0, [0.0] * 64)], "id long, features array<double>")
    plans = [len(clustering.assigned(wide, {c: [1.25] * 64 for c in range(k)})._jdf.queryExecution().toString()) for k in (1, 10)]
    assert abs(plans[0] - plans[1]) < 100


def test_nearest_centres_ties_and_means(spark):
    centres = {2: POINTS[5], 7: POINTS[9], 9: POINTS[5]}
    want = _brute(centres)
    got = {r.id: (r.distance, r.cluster) for r in clustering.assigned(_points(spark), centres).collect()}
    assert got == want
    new, cost = clustering.moved(_points(spark), centres)
    assert math.isclose(cost, sum(d for d, _ in want.values())) and set(new) == {2, 7}
    for k, c in new.items():
        own = [POINTS[i] for i, (_, n) in want.items() if n == k]
        assert all(math.isclose(m, sum(v) / len(own)) for m, v in zip(c, zip(*own)))


def test_farthest_points_come_next_and_the_least_of_equal_ones(spark):
    centres = clustering.farthest_first(_points(spark), 5, 11)
    assert centres[0] == POINTS[11]
    for n in range(1, 5):
        far = _brute({k: centres[k] for k in range(n)})
        assert centres[n] == POINTS[min(far, key=lambda i: (-far[i][0], i))]


def test_points_without_numbers_are_at_no_distance(spark):
    rows = {0: [0.0, 0.0], 1: None, 2: [3.0, None], 3: [5.0, 5.0], 4: []}
    got = {r.id: (r.cluster, r.distance) for r in clustering.assigned(_points(spark, rows), {1: [0.0, 0.0], 2: [5.0, 5.0]}).collect()}
    assert got == {0: (1, 0.0), 1: (1, None), 2: (1, None), 3: (2, 0.0), 4: (1, None)}
    assert clustering.moved(_points(spark, rows), {1: [0.0, 0.0], 2: [5.0, 5.0]})[0] == {1: [0.0, 0.0], 2: [5.0, 5.0]}
