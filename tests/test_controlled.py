"""Sequences with key frames against all sequences there are."""

from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepfold.model import GenerationConfig
from stepfold.plans import controlled


def everything(key, rooms, chars, length):
    """All sequences of states, by key frames."""
    to = controlled.moves(rooms, chars)
    out = {}
    for first, path in product(range(rooms**chars), product(range(to.shape[1]), repeat=length - 1)):
        states = [first]
        for m in path:
            states.append(int(to[states[-1], m]))
        out.setdefault(sum(bool(key[s]) for s in states), []).append(tuple(states))
    return out


@pytest.mark.parametrize("rooms,chars,length,key", [(3, 2, 3, lambda s: s // 3 == s % 3), (2, 2, 4, lambda s: s == 0), (3, 1, 4, lambda s: s == 1), (2, 3, 1, lambda s: s % 2 == 0)])
def test_every_sequence_is_equally_likely(rooms, chars, length, key):
    key = np.array([key(s) for s in range(rooms**chars)])
    found = everything(key, rooms, chars, length)
    ways = controlled.Ways.count(key, rooms, chars, length, length)
    counted = np.exp(ways.first()).sum(axis=1)
    assert np.allclose(counted, [len(found.get(k, [])) for k in range(length + 1)])
    for low, high in [(k, k) for k in found] + [(0, length)]:
        want = [s for k in range(low, high + 1) for s in found.get(k, [])]
        n = 400 * len(want)
        if n > 200_000:
            continue
        drawn = Counter(map(tuple, ways.draw(np.arange(n), np.full(n, low), np.full(n, high), 7).tolist()))
        assert set(drawn) == set(want)
        assert sum((c - 400) ** 2 / 400 for c in drawn.values()) < len(want) + 6 * (2 * len(want)) ** 0.5  # chi squared


def test_classes_are_few():
    to = controlled.moves(6, 5)
    s = np.arange(6**5)
    assert to.shape == (6**5, 25) and controlled.classes(s // 6 % 6 == s // 36 % 6, to).max() == 1


def test_each_request_is_met(spark):
    config = GenerationConfig()
    together = F.col("Mary") == F.col("John")
    requests = spark.createDataFrame([(i, k, k) for i, k in enumerate([0, 1, 5, 60, 100, 128] * 3)] + [(100, 3, 7)], "seq_id long, low long, high long").repartition(3)
    state = controlled.controlled_for(requests, 128, config, together)
    steps = state.groupBy("seq_id", "step_id").agg(F.max(F.when(F.col("ch") == "Mary", F.col("room"))).alias("m"), F.max(F.when(F.col("ch") == "John", F.col("room"))).alias("j"), F.count("*").alias("n"))
    got = steps.groupBy("seq_id").agg(F.count_if(F.col("m") == F.col("j")).alias("hits"), F.count("*").alias("steps"), F.max("n").alias("n")).join(requests, "seq_id").collect()
    assert len(got) == 19 and all(r.low <= r.hits <= r.high and r.steps == 128 and r.n == 5 for r in got)
    again = controlled.controlled_for(requests.repartition(1), 128, config, together)
    assert state.exceptAll(again).isEmpty()


def test_what_cannot_be_met(spark):
    config = GenerationConfig(rooms=["a", "b"], chars=["x"])
    for length, target in [(4, 3), (4, (3, 9)), (2, 0), (3, -1)]:  # in two rooms one character is in each every other step
        with pytest.raises(ValueError):
            controlled.controlled(spark, 3, length, config, F.col("x") == "a", target)
    assert controlled.controlled(spark, 5, 4, config, F.col("x") == "a", 2).count() == 20
    assert controlled.controlled(spark, 5, 1, config, F.col("x") == "a", (0, 1)).count() == 5
    with pytest.raises(ValueError):
        controlled.key_states(spark, GenerationConfig(chars=[f"c{i}" for i in range(9)]), F.lit(True))
