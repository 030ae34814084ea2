"""The tests that pairs pass before their full sets are compared."""
import numpy as np

from spreadlens.llm import near_dedup

LIVE = "bucket bigint, node bigint, n bigint, component bigint"
TRAITS = "node bigint, bands array<int>, sig array<tinyint>, items array<int>"


def test_signatures_of_long_unlike_texts_differ():
    rng = np.random.default_rng(3)
    x, y = (near_dedup.signature(near_dedup.minima(rng.integers(0, 2**63, 3000, dtype=np.uint64))) for _ in range(2))
    assert (x == y).sum() < 20


def later(spark, n, items, sigs):
    live = spark.createDataFrame([(1, 1, n, 1), (1, 2, n, 2)], LIVE)
    traits = spark.createDataFrame([(k + 1, [1], sigs[k].tolist(), items[k]) for k in range(2)], TRAITS)
    return [tuple(r) for r in near_dedup._later_pairs(live, live.filter("node = 1"), traits, 80).collect()]


def test_later_pairs_need_like_signatures(spark):
    same, items = np.zeros(200, int), list(range(100))
    assert later(spark, 100, [items, items], [same, same]) == [(1, 2)]
    assert later(spark, 100, [items, items], [same, same + 1]) == []


def test_later_pairs_allow_for_merges_of_large_sets(spark):
    """2,667 of 3,000 items are shared, just the threshold; the cut has merged five of them."""
    same, common = np.zeros(200, int), list(range(2662))
    a, b = ([*common, *range(k, k + 333)] for k in (10_000, 20_000))
    assert later(spark, 3000, [a, b], [same, same]) == [(1, 2)]


def test_allowance_follows_the_expected_merges(spark):
    got = {r["n"]: r["m"] for r in spark.createDataFrame([(100,), (2000,), (100_000,), (1_000_000,)], "n bigint").select("n", near_dedup._merged(near_dedup.F.col("n")).alias("m")).collect()}
    assert got[100] == got[2000] == 2
    rng = np.random.default_rng(8)
    for n in (100_000, 1_000_000):
        lost = n - len(np.unique(rng.integers(0, 2**31, n)))
        assert lost <= got[n] <= 4 * n * n / 2**32 + 25


def test_tiles_make_each_pair_once_in_whatever_blocks(spark, monkeypatch):
    """Forty members in forty components, all alike; every fourth is a pivot; sets too long for a tile go by signature."""
    monkeypatch.setattr(near_dedup, "TILE", 4)
    live = spark.createDataFrame([(1, k, 100, k) for k in range(40)], LIVE)
    for items in (list(range(100)), list(range(5000))):
        traits = spark.createDataFrame([(k, [1], [0] * 200, items) for k in range(40)], TRAITS)
        got = sorted(tuple(r) for r in near_dedup._later_pairs(live, live.filter("node % 4 = 0"), traits, 80).collect())
        assert got == [(a, b) for a in range(40) for b in range(a + 1, 40) if a % 4 == 0 or b % 4 == 0]
