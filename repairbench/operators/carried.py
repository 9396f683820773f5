"""An ordered pass over the rows of each key, with a state that is carried from batch to batch; keys of very many rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from repairbench.sources.shared import written

#: Rows of a result batch.
BATCH_ROWS = 8192
#: Places that keys are counted by, before any key is counted.
PLACES = 1 << 16


def values(column: pa.Array) -> list:
    """As `to_pylist`, several times as fast for whole numbers, strings and columns of nulls."""
    kind = column.type
    if column.null_count == len(column):
        return [None] * len(column)
    if pa.types.is_string(kind) or (pa.types.is_integer(kind) and not column.null_count):
        return column.to_numpy(zero_copy_only=False).tolist()
    if pa.types.is_integer(kind):
        return column.to_pandas(integer_object_nulls=True).tolist()
    return column.to_pylist()


class State:
    """What is known of one key. `step` takes a row (without the key) and gives result rows; `end` gives the last ones."""

    def __init__(self, key: tuple):
        self.key = key

    def step(self, row: tuple) -> Iterable[tuple]:
        raise NotImplementedError

    def end(self) -> Iterable[tuple]:
        return ()


def carried(rows: DataFrame, keys: list[str], order: list, schema: str, start: Callable[[tuple], State], beside: tuple[str, ...] = ()) -> DataFrame:
    """Results of `start(key)` over each key's rows in order (nulls first); rows have the keys first, then other columns.

    Spark deals the keys and sorts within tasks, spilling where it must; a task holds one state and one batch, never a
    key's rows. Columns `beside` go by untouched: what a step gives has those of its row behind it, so that results needn't meet
    their rows again; `end` gives nothing then.
    """
    used = [c for c in rows.columns if c not in {*keys, *beside}]
    told = rows.select(*keys, *used, *beside)
    made, n, width = StructType.fromDDL(schema), len(keys), len(keys) + len(used)
    kinds = StructType(made.fields + [rows.schema[c] for c in beside])
    form = to_arrow_schema(made)

    def work(batches):
        key, state, out = None, None, []

        def flush(some: list[tuple], gone: pa.RecordBatch | None = None) -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*some, strict=True), form.types, strict=True)]
            more = gone.columns if gone else []
            return pa.RecordBatch.from_arrays(columns + more, names=kinds.names)

        for batch in batches:
            at: list[int] = []
            for i, row in enumerate(zip(*map(values, batch.columns[:width]), strict=True)):
                if state is None or row[:n] != key:
                    if state is not None:
                        out += state.end()
                    key = row[:n]
                    state = start(key)
                some = state.step(row[n:])
                out += some
                if beside:
                    at += [i] * len(some)
                elif len(out) >= BATCH_ROWS:
                    yield flush(out)
                    out = []
            if beside and out:
                yield flush(out, batch.select(list(beside)).take(pa.array(at)))
                out = []
        if state is not None:
            out += state.end()
        if out:
            yield flush(out)

    return told.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(work, kinds)


def hot_keys(rows: DataFrame, keys: list[str], most: int) -> DataFrame | None:
    """The keys of more than `most` rows, if there are any.

    Rows are counted by a hash of the key first; only keys in places of more than `most` rows are counted themselves.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(PLACES))
    full = written(rows.groupBy(place.alias("place")).agg(F.count("*").alias("n")).where(F.col("n") > most).select("place"), "places")
    if full.isEmpty():
        return None
    some = rows.select(*keys, place.alias("place")).join(F.broadcast(full), "place", "left_semi")
    hot = written(some.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*keys), "hot")
    return None if hot.isEmpty() else hot
