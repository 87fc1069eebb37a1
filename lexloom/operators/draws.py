"""Draws in the order of rows, as one sequential Mersenne Twister gives them, made by many tasks.

A row draws one of n choices (a number of as many bits as n has, drawn again while it is not below n) and then a number in
[0, 1) from two outputs. How many outputs a row takes depends on the draws alone, not on the rows: a first, light walk over the
generator notes its state at every BLOCK rows, and tasks go on from there, each with its own block of rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

#: Rows of a block, and outputs that are made at once.
BLOCK, OUTPUTS = 1_000_000, 1 << 20
STATE_DDL, DRAW_DDL = "seed long, first long, rows long, state binary, pos int", "seed long, row long, choice int, draw double"


class Twister:
    """The outputs of random.Random(seed) from a state on."""

    def __init__(self, state: tuple[np.ndarray, int]):
        self.bits = np.random.MT19937()
        self.put(state)

    @staticmethod
    def start(seed: int) -> tuple[np.ndarray, int]:
        words = random.Random(seed).getstate()[1]
        return np.array(words[:-1], np.uint32), words[-1]

    def put(self, state: tuple[np.ndarray, int]) -> None:
        self.bits.state = {"bit_generator": "MT19937", "state": {"key": state[0], "pos": state[1]}}

    def get(self) -> tuple[np.ndarray, int]:
        own = self.bits.state["state"]
        return own["key"].copy(), int(own["pos"])

    def rows(self, choices: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Choices and numbers of up to `most` rows, as many as OUTPUTS outputs hold (fewer for few rows); the generator then stands behind the last of them."""
        before = self.get()
        raw = self.bits.random_raw(min(OUTPUTS, 4096 + 8 * most)).astype(np.uint64)
        drawn = raw >> np.uint64(32 - choices.bit_length())
        n = len(raw)
        # the next output, from each on, that is a choice
        at = np.where(drawn < choices, np.arange(n), n)
        at = np.minimum.accumulate(at[::-1])[::-1].tolist()
        took, i = [], 0
        while len(took) < most and i < n and at[i] + 2 < n:
            took.append(at[i])
            i = at[i] + 3
        self.put(before)
        self.bits.random_raw(i, output=False)
        own = np.array(took, np.int64)
        number = ((raw[own + 1] >> np.uint64(5)) * np.uint64(1 << 26) + (raw[own + 2] >> np.uint64(6))).astype(np.float64) / (1 << 53) if took else np.zeros(0)
        return drawn[own].astype(np.int32) if took else np.zeros(0, np.int32), number


def draws(spark: SparkSession, rows: int, seeds: list[int], choices: int, block: int = BLOCK) -> DataFrame:
    """(seed, row, choice, draw) of rows 0 to rows - 1 for each seed: what random.Random(seed) gives each row in turn by choice() and random()."""

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for seed in b.column(0).to_pylist():
                own, at = Twister(Twister.start(seed)), 0
                while at < rows:
                    n = min(block, rows - at)
                    key, pos = own.get()
                    yield pa.record_batch([[seed], [at], [n], [key.tobytes()], pa.array([pos], pa.int32())], names=["seed", "first", "rows", "state", "pos"])
                    done = 0
                    while done < n:
                        done += len(own.rows(choices, n - done)[0])
                    at += n

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                own, done = Twister((np.frombuffer(r["state"], np.uint32).copy(), r["pos"])), 0
                while done < r["rows"]:
                    choice, number = own.rows(choices, r["rows"] - done)
                    n = len(choice)
                    yield pa.record_batch([pa.array(np.full(n, r["seed"])), pa.array(np.arange(n) + r["first"] + done), pa.array(choice), pa.array(number)], names=["seed", "row", "choice", "draw"])
                    done += n

    walk = spark.createDataFrame([(s,) for s in seeds], "seed long").repartition(len(seeds), "seed").mapInArrow(states, STATE_DDL)
    blocks = len(seeds) * max(1, -(-rows // block))
    return walk.repartition(min(blocks, 100_000), F.col("seed"), F.col("first")).mapInArrow(each, DRAW_DDL)
