"""Pairs of the near-duplicate stage that can't have the overlap they need are left out before anything is joined for them."""

import numpy as np

from lodestar.llm import near_copies


def test_late_keys_make_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(1)

    def two(own, same):
        common = rng.integers(0, 1 << 63, same, np.uint64)
        return [np.sort(np.concatenate([common, rng.integers(0, 1 << 63, own, np.uint64)])) for _ in range(2)]

    sets = [*two(4, 16), *two(2, 18)]  # similarities 0.67 and 0.82; the first key that two share is the fifth, and the third
    nodes = spark.createDataFrame([(i, i, len(s), bytearray(s.tobytes())) for i, s in enumerate(sets)], "node bigint, fp bigint, n bigint, s binary")
    seen, old = [], near_copies.sharing
    monkeypatch.setattr(near_copies, "sharing", lambda pairs, *a: (seen.extend(r[:2] for r in pairs.collect()), old(pairs, *a))[1])
    got = near_copies.components(nodes, 0.8, spark.createDataFrame([], "a bigint, b bigint"))
    assert sorted(r[:] for r in got.collect()) == [(2, 2), (3, 2)] and seen == [(2, 3)]
