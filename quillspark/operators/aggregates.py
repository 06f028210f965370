"""Grouped aggregates of one's own over Arrow batches, with partial states combined where the rows are read.

An :class:`Aggregator` folds the rows of a batch into states, one a key, and
adds states up.  Each task holds the states of its keys, up to ``most`` entries
in all, and hands on what it has when they are more; states of a key meet in
``spread`` salted shares before they meet at last, so a key that every task has
costs a row for each task and no group of rows is ever held together.
"""

from __future__ import annotations

import pickle
from collections import Counter
from typing import Any, Generic, TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

S = TypeVar("S")


class Aggregator(Generic[S]):
    """What an aggregate is made of; states must be picklable, and ``merge`` associative and commutative."""

    #: DDL of a result row, without the key.
    result: str

    def zero(self) -> S:
        raise NotImplementedError

    def update(self, state: S, values: list[Any]) -> S:
        """Take in the values of one key's rows of a batch."""
        raise NotImplementedError

    def merge(self, a: S, b: S) -> S:
        raise NotImplementedError

    def finish(self, state: S) -> list[tuple]:
        """The result rows of a key."""
        raise NotImplementedError

    def size(self, state: S) -> int:
        """How much of the bound a state takes."""
        return 1


class WordCounts(Aggregator[Counter]):
    """The ``top`` most frequent words of a group with their counts, ties in the order of the words."""

    result = "rank int, word string, n bigint"

    def __init__(self, top: int = 10):
        self.top = top

    def zero(self) -> Counter:
        return Counter()

    def update(self, state: Counter, values: list[str | None]) -> Counter:
        for v in values:
            state.update((v or "").split())
        return state

    def merge(self, a: Counter, b: Counter) -> Counter:
        a, b = (a, b) if len(a) >= len(b) else (b, a)
        a.update(b)
        return a

    def finish(self, state: Counter) -> list[tuple]:
        best = sorted(state.items(), key=lambda x: (-x[1], x[0].encode()))[: self.top]
        return [(i, w, n) for i, (w, n) in enumerate(best, 1)]

    def size(self, state: Counter) -> int:
        return len(state)


def aggregate(rows: DataFrame, key: Column, value: Column, how: Aggregator, *, most: int = 200_000, spread: int = 16) -> DataFrame:
    """(key, result columns) of every key, null keys being one."""
    src = rows.select(key.alias("key"), value.alias("value"))
    kind = src.schema["key"].dataType.simpleString()
    partial = f"key {kind}, state binary"

    def batch_of(states: dict, like: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(states), like), pa.array([pickle.dumps(s) for s in states.values()], pa.binary())], names=["key", "state"])

    def fold(batches):
        states, size, like = {}, 0, None
        for b in batches:
            like = b.schema.field(0).type
            got: dict[Any, list] = {}
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got.setdefault(k, []).append(v)
            for k, values in got.items():
                old = states.get(k)
                size -= how.size(old) if old is not None else 0
                states[k] = how.update(how.zero() if old is None else old, values)
                size += how.size(states[k])
            if size > most:
                yield batch_of(states, like)
                states, size = {}, 0
        if states:
            yield batch_of(states, like)

    def combine(last: bool):
        def run(batches):
            at, state, like, seen = None, None, None, False
            for b in batches:
                like = b.schema.field(0).type
                for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if seen and k == at:
                        state = how.merge(state, pickle.loads(s))
                        continue
                    if seen:
                        yield out(at, state, like)
                    at, state, seen = k, pickle.loads(s), True
            if seen:
                yield out(at, state, like)

        def out(k, state, like):
            if not last:
                return batch_of({k: state}, like)
            found = how.finish(state)
            cols = list(zip(*found, strict=True)) or [[]] * len(types)
            return pa.RecordBatch.from_arrays([pa.array([k] * len(found), like), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["key", *names])

        return run

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    result = to_arrow_schema(StructType.fromDDL(how.result))
    names, types = result.names, [f.type for f in result]
    folded = src.mapInArrow(fold, partial).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(spread)))
    shared = folded.repartition("key", "salt").sortWithinPartitions("key", "salt").select("key", "state").mapInArrow(combine(False), partial)
    return shared.repartition("key").sortWithinPartitions("key").mapInArrow(combine(True), f"key {kind}, {how.result}")
