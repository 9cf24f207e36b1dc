"""Plans of the driver against one item at a time."""

import random

import pytest

from factloom.llm import sharding


def plain_even(sizes, shards):
    """Best fit decreasing into even shards; each item on its own, no tree: (size, shard) in order."""
    sizes = sorted(sizes, reverse=True)
    rest, used, placed = sum(sizes), 0, []
    while sizes and shards - used > 1 and sizes[0] > rest / (shards - used):
        placed.append((sizes[0], used))
        rest, used, sizes = rest - sizes[0], used + 1, sizes[1:]
    left = {k: rest / max(1, shards - used) for k in range(used, shards)}
    for size in sizes:
        fits = [(r, k) for k, r in left.items() if r >= size]
        k = min(fits)[1] if fits else max((r, k) for k, r in left.items())[1]
        left[k] -= size
        placed.append((size, k))
    return sorted(placed)


@pytest.mark.parametrize("seed", range(12))
def test_even_shards_equal_the_plain_version(seed):
    r = random.Random(seed)
    sizes = [r.choice([r.randint(16, 60), r.randint(16, 4000)]) for _ in range(r.choice([1, 7, 300]))]
    if seed % 3 == 0:
        sizes += [sum(sizes) * 2] * (seed % 2 + 1)  # larger than an even share
    shards = r.choice([1, 5, 40])
    items = sorted(((s, sizes.count(s)) for s in set(sizes)), reverse=True)
    places, _ = sharding.best_fit(items, shards)
    found = sorted((size, shard) for (size, _), place in zip(items, places) for shard, n in place for _ in range(n))
    assert found == plain_even(sizes, shards)
