import random

import pytest

from lectern.operators import batching as B


def plain_waste(lengths, budget):
    """Padding of batches filled one by one in the order given."""
    waste, now = 0, []
    for n in [*lengths, None]:
        if n is None or now and (len(now) + 1) * max(*now, n) > budget:
            waste += len(now) * max(now) - sum(now)
            now = []
        now.append(n)
    return waste


@pytest.mark.parametrize("group", [10**6, 50])
def test_no_batch_is_over_budget(spark, group):
    rng = random.Random(2)
    lengths = [int(rng.lognormvariate(4, 1.3)) for _ in range(3000)] + [0, 1, 60_000, 5001, None]
    items = spark.createDataFrame(list(enumerate(lengths)), "item_id long, n long")
    held = B.packed(items, 5000, group=group)
    out = B.batch_waste(held).collect()
    assert sum(r.n_items for r in out) == len(lengths)
    assert all(r.padded <= 5000 or r.n_items == 1 for r in out) and all(r.waste >= 0 for r in out)
    assert sum(r.waste for r in out) == sum(r.slots - (r.n or 0) for r in held.collect())
    assert sum(r.waste for r in out) * 5 < plain_waste([n or 0 for n in lengths], 5000)


def test_lengths_of_a_range_are_close():
    bounds = B.range_bounds(1.1, 10**6)
    assert bounds == sorted(set(bounds)) and all(b <= max(a + 1, a * 1.1) for a, b in zip(bounds, bounds[1:]))


def test_no_items(spark):
    assert B.packed(spark.createDataFrame([], "item_id long, n long"), 10).count() == 0
