"""Sequences with a given number of key frames, drawn uniformly from all that have it, without rejection.

A sequence begins with each character in any room; then one character a step moves to another room. A key frame is a
step whose state meets a condition. States are first lumped: two are of one class if the condition says the same of
them and they have as many moves to each class. Going back from the last step, the ways to go on are counted by step,
class and key frames still to come. Going forward, each move is drawn in proportion to the ways that it leaves, so every
sequence that meets its request is equally likely, and none is made in vain. Whether a request can be met at all is
known before anything is drawn. Draws are hashes of the seed, the sequence and the step: any partitioning gives the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfold.model import GenerationConfig
from stepfold.plans.state import named

#: States (rooms to the power of characters), and counts, up to which tables are made; the latter go to every task.
STATES, COUNTS = 1 << 20, 1 << 23
#: Sequences that are drawn at once.
DRAWN = 2048


def moves(rooms: int, chars: int) -> np.ndarray:
    """The states that each state may move to; a state has each character's room as a digit, the first one's lowest."""
    n = rooms**chars
    at = np.arange(n)
    out = []
    for c in range(chars):
        unit = rooms**c
        room = at // unit % rooms
        out += [at + ((room + k) % rooms - room) * unit for k in range(1, rooms)]
    return np.stack(out, axis=1) if out else np.zeros((n, 0), np.int64)


def classes(key: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The class of each state: the coarsest partition in which states of a class agree in the condition and in their moves to each class."""
    of = key.astype(np.int64)
    while True:
        signature = np.concatenate([of[:, None], np.sort(of[to], axis=1)], axis=1)
        _, new = np.unique(signature, axis=0, return_inverse=True)
        if new.max() == of.max():
            return new
        of = new


@dataclass
class Ways:
    """log of the ways to go on after each step (axis 0, from step 1), with so many key frames to come (axis 1), from each class."""

    to: np.ndarray
    key: np.ndarray
    of: np.ndarray
    log: np.ndarray

    @classmethod
    def count(cls, key: np.ndarray, rooms: int, chars: int, length: int, most: int) -> Ways:
        to = moves(rooms, chars)
        of = classes(key, to)
        n = int(of.max()) + 1
        if length * (most + 1) * n > COUNTS:
            raise ValueError(f"{n} classes of states, {length} steps and {most} key frames are too many to count")
        _, one = np.unique(of, return_index=True)
        step = np.zeros((n, n))
        for c, s in enumerate(one):
            np.add.at(step[c], of[to[s]], 1)
        hit = key[one].astype(int)
        log = np.full((length, most + 1, n), -np.inf)
        log[-1, 0] = 0
        for t in range(length - 2, -1, -1):
            # what comes with the next step counts among what is to come
            ahead = np.full((most + 1, n), -np.inf)
            ahead[:, hit == 0] = log[t + 1][:, hit == 0]
            ahead[1:, hit == 1] = log[t + 1][:-1][:, hit == 1]
            top = ahead.max(axis=1, keepdims=True)
            top[~np.isfinite(top)] = 0
            with np.errstate(divide="ignore"):
                log[t] = top + np.log(np.exp(ahead - top) @ step.T)
        return cls(to, key, of, log)

    def first(self) -> np.ndarray:
        """log of the ways by key frames in all (axis 0) that begin in each state."""
        log = self.log[0][:, self.of]
        out = np.full(log.shape, -np.inf)
        out[:, ~self.key] = log[:, ~self.key]
        out[1:, self.key] = log[:-1, self.key]
        return out

    def draw(self, seq: np.ndarray, low: np.ndarray, high: np.ndarray, seed: int) -> np.ndarray:
        """A row of states for each sequence."""
        length, most = len(self.log), self.log.shape[1] - 1
        begin = self.first()
        out = np.empty((len(seq), length), np.int64)
        left = np.empty(len(seq), np.int64)
        u = uniform(seed, seq, 0)
        for a, b in {(int(a), int(b)) for a, b in zip(low, high, strict=True)}:
            rows = np.flatnonzero((low == a) & (high == b))
            part = begin[a : min(b, most) + 1]
            total = np.cumsum(np.exp(part - part.max()).ravel())
            k, out[rows, 0] = np.divmod(np.searchsorted(total, u[rows] * total[-1], side="right"), part.shape[1])
            left[rows] = a + k
        at = out[:, 0]
        left -= self.key[at]
        for t in range(1, length):
            to = self.to[at]
            rest = left[:, None] - self.key[to]
            log = np.where(rest >= 0, self.log[t][np.maximum(rest, 0), self.of[to]], -np.inf)
            total = np.cumsum(np.exp(log - log.max(axis=1, keepdims=True)), axis=1)
            chosen = (total <= (uniform(seed, seq, t) * total[:, -1])[:, None]).sum(axis=1)
            at = to[np.arange(len(to)), chosen]
            left = left - self.key[at]
            out[:, t] = at
        return out


def uniform(seed: int, seq: np.ndarray, t: int) -> np.ndarray:
    """Numbers from 0 to 1 by hash."""
    x = seq.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0xD1B54A32D192ED03 + t * 0x8CB92BA72F3D8DD7) % (1 << 64))
    for _ in range(2):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)) / float(1 << 53)


def key_states(spark: SparkSession, config: GenerationConfig, keyframe: Column) -> np.ndarray:
    """Whether the condition holds, for each state."""
    r, n = len(config.rooms), len(config.rooms) ** len(config.chars)
    if n > STATES:
        raise ValueError(f"{n} states are too many to count")
    at = [named(F.floor(F.col("id") / r**c) % r, config.rooms).alias(name) for c, name in enumerate(config.chars)]
    found = spark.range(n).select("id", *at).where(keyframe).select("id").toArrow()  # at most STATES numbers
    key = np.zeros(n, bool)
    key[found.column(0).to_numpy()] = True
    return key


def controlled_for(requests: DataFrame, length: int, config: GenerationConfig, keyframe: Column) -> DataFrame:
    """state (seq_id, step_id, ch_ord, ch, room) of a sequence for each request (seq_id, low, high), with low to high key frames.

    keyframe is a condition over a step's row of wide state (a column for each character); a step where it holds counts.
    Raises ValueError where no sequence of that length has as many key frames as a request asks for.
    """
    spark = requests.sparkSession
    rooms, chars, seed = len(config.rooms), len(config.chars), config.seed
    if length < 1:
        raise ValueError("length is below 1")
    asked = [tuple(r) for r in requests.select("low", "high").distinct().limit((length + 3) ** 2).collect()]  # pairs of numbers up to the length
    wrong = [x for x in asked if None in x or x[0] > x[1] or x[0] < 0]
    ways = Ways.count(key_states(spark, config, keyframe), rooms, chars, length, min(length, max((x[1] for x in asked if x not in wrong), default=0)))
    by_hits = ways.first().max(axis=1)
    wrong += [x for x in asked if x not in wrong and not np.isfinite(by_hits[x[0] : x[1] + 1]).any()]
    if wrong:
        raise ValueError(f"no sequence of {length} steps has key frames as asked for: {sorted(wrong, key=str)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, DRAWN):
                seq, low, high = (c.slice(a, DRAWN).to_numpy() for c in batch.columns)
                drawn = ways.draw(seq, low, high, seed)
                yield pa.RecordBatch.from_arrays([pa.array(seq), pa.FixedSizeListArray.from_arrays(pa.array(drawn.ravel()), length).cast(pa.list_(pa.int64()))], ["seq_id", "at"])

    drawn = requests.select(F.col("seq_id").cast("long"), F.col("low").cast("long"), F.col("high").cast("long")).mapInArrow(run, "seq_id long, at array<long>")
    steps = drawn.select("seq_id", F.posexplode("at").alias("t", "s")).select("seq_id", (F.col("t") + 1).alias("step_id"), "s", F.explode(F.sequence(F.lit(0), F.lit(chars - 1))).alias("ch_ord"))
    room = (F.floor(F.col("s") / F.pow(F.lit(rooms), F.col("ch_ord"))) % rooms).cast("int")
    return steps.select("seq_id", "step_id", "ch_ord", named(F.col("ch_ord"), config.chars).alias("ch"), named(room, config.rooms).alias("room"))


def controlled(spark: SparkSession, n: int, length: int, config: GenerationConfig, keyframe: Column, target: int | tuple[int, int]) -> DataFrame:
    """state of n sequences, numbered from 0, with as many key frames as asked for; see controlled_for()."""
    low, high = target if isinstance(target, tuple) else (target, target)
    return controlled_for(spark.range(n).select(F.col("id").alias("seq_id"), F.lit(low).alias("low"), F.lit(high).alias("high")), length, config, keyframe)
