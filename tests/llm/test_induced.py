import random

import numpy as np
import pytest

from chunkvault.llm.induced import BucketQueue, suffix_order


@pytest.mark.parametrize("seed", range(60))
def test_suffix_order(seed):
    rng = random.Random(seed)
    data = bytes(rng.randrange(rng.choice([1, 2, 3, 26, 256])) for _ in range(rng.randint(1, 150))) * rng.choice([1, 1, 2, 4])
    depth, memory = rng.choice([3, 8, 100]), rng.choice([64, 1 << 20])
    order, prefixes = suffix_order(np.frombuffer(data, np.uint8).astype(np.int64), 256, depth, True, memory)
    assert sorted(order.tolist()) == list(range(len(data)))
    for j in range(1, len(order)):
        x, y = data[order[j - 1] :][:depth], data[order[j] :][:depth]
        assert x <= y
        assert prefixes[j] == next((k for k, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))


def test_recursion_on_long_text():
    rng = random.Random(1)
    data = "".join(rng.choice(["the ", "and ", "of ", "tion ", "er "]) for _ in range(20_000)).encode()
    order, prefixes = suffix_order(np.frombuffer(data, np.uint8).astype(np.int64), 256, 100, True)
    keys = [data[i : i + 100] for i in order.tolist()]
    assert keys == sorted(keys)


def test_queue_spills_and_keeps_order():
    queue = BucketQueue(4, memory=100)
    for i in range(50):
        queue.put(i % 4, np.array([i]), np.array([i], np.uint8))
    assert queue.files > 0
    for c in range(4):
        positions, prefixes = queue.take(c)
        assert positions.tolist() == list(range(c, 50, 4)) == prefixes.tolist()
        assert queue.take(c) is None
