import math
import random

import brute
import numpy as np
import pytest
from quarry.llm import centroids as ct


def vectors(rnd, n, dim=64):
    mids = [[rnd.gauss(0, 0.2) for _ in range(dim)] for _ in range(9)]
    rows = [(i, [x + rnd.gauss(0, 0.05) for x in rnd.choice(mids)], i % 3) for i in range(n)]
    rows += [(5000 + i, list(rows[0][1]), 0) for i in range(n // 3)]            # a third is one vector
    bad = list(rows[0][1])
    rows += [(9000, None, 0), (9001, [], 0), (9002, [0.5] * (dim - 1), 0), (9003, [*bad[1:], None], 0),
             (9004, [*bad[1:], float("nan")], 0), (9005, [*bad[1:], float("-inf")], 0), (None, bad, 0), (0, rows[1][1], 0)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, own int")


@pytest.mark.parametrize("k,rounds", [(40, 5), (7, 9), (1, 2)])
def test_query_matches_brute_force(spark, k, rounds):
    rows = vectors(random.Random(k), 300)
    conf = ct.Clustering(k=k, rounds=rounds, history=3 if rounds == 9 else 16)
    got, log = ct.cluster(frame(spark, rows).repartition(5), conf)
    want = brute.kmeans(rows, k, rounds)
    seen = [(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid) for r in ct.with_inertia(got).collect()]
    assert sorted(seen, key=repr) == sorted(want, key=repr)
    if k == 40:
        assert log[-1]["measured"] < log[0]["measured"] / 2       # bounds spare most distances


def test_few_none_and_huge_vectors(spark):
    conf = ct.Clustering(k=5, dim=2, rounds=3)
    rows = [(1, [1e300, -1e300], 0), (2, [0.0, 0.0], 0), (3, [0.0, 0.0], 0)]
    got = {r.vec_id: (r.cluster, r.distance) for r in ct.cluster(frame(spark, rows), conf)[0].collect()}
    assert got[1][1] == 0 and got[2] == got[3] == (min(got[2][0], got[3][0]), 0)
    assert ct.with_inertia(ct.cluster(frame(spark, []), conf)[0]).collect() == []
    assert ct.cluster(frame(spark, [(1, None, 0)]), conf)[0].collect() == []
    with pytest.raises(ValueError):
        ct.cluster(frame(spark, rows), ct.Clustering(k=10 ** 6))


def test_bounds_hold_whatever_the_way_of_the_centroids():
    rnd = np.random.default_rng(4)
    for top in (50, 1 << 26):
        x = rnd.integers(-top, top, (200, 8)).astype(np.int32)
        past = [rnd.integers(-top, top, (12, 8))]
        past[0][3] = past[0][7]                                    # a tie goes to the smaller one
        s = ct.first_state(x, past[0])
        for r in range(12):
            past.append(past[-1] + rnd.integers(-top // 20, top // 20 + 1, (12, 8)))
            way = ct.displacements(past)
            s, n = ct.next_state(x, s, past, way)
            d2 = ((x[:, None].astype(object) - past[-1][None].astype(object)) ** 2).sum(2)
            assert s.own.tolist() == [min(range(12), key=lambda j: (d[j], j)) for d in d2]
            if r == 6:
                s, past = ct.rebased(s, way), [past[-1]]
                way = ct.displacements(past)
            low = s.low - way[s.low_at, np.arange(12)]
            for i in range(200):
                assert s.up[i] + way[s.up_at[i], s.own[i]] >= math.isqrt(d2[i][s.own[i]])
                assert all(low[i, j] <= math.isqrt(d2[i][j]) + 1 for j in range(12) if j != s.own[i])


def test_total_displacement_is_no_longer_than_the_drifts():
    past = [np.array([[0, 0]]), np.array([[30, 40]]), np.array([[0, 0]])]
    assert ct.displacements(past)[0, 0] < 1e-6 and ct.displacements(past)[1, 0] == pytest.approx(50)
