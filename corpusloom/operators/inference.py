"""Models over texts in batches: one model a worker, batches of like lengths, the next computed while the last is passed on.

A task takes super-batches of rows, sorts each by length, gives the model runs of at most batch texts, and puts the results back in
the rows' order. So a batch is padded little, no sort crosses tasks, and memory is bounded by the super-batch.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import ship

#: Texts that a model gets at once; rows that are sorted by length together.
BATCH, SUPER = 64, 4096

Model = Callable[[list[tuple]], list]


def _loaded(make: Callable[[], Model], key: str) -> Model:
    """The worker process's model: made once, whatever tasks it runs."""
    kept = sys.modules.setdefault("_corpusloom_models", types.ModuleType("_corpusloom_models")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def _sorted_runs(model: Model, rows: list[tuple], sizes: np.ndarray, batch: int) -> list:
    """model of all rows, the longest first in runs of batch, in the rows' order."""
    order = np.argsort(-sizes, kind="stable")
    made: list = [None] * len(rows)
    for a in range(0, len(order), batch):
        own = order[a : a + batch].tolist()
        found = model([rows[i] for i in own])
        if len(found) != len(own):
            raise ValueError("a model gives one result for each text")
        for i, x in zip(own, found, strict=True):
            made[i] = x
    return made


def _predict(make: Callable[[], Model], key: str, n_in: int, kind: pa.DataType, batch: int, rows_at_once: int):
    """From (row, the model's inputs) to (row, result)."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for b in batches:
            for a in range(0, len(b), rows_at_once):
                part = b.slice(a, rows_at_once)
                if count + len(part) > rows_at_once and held:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held, count = [], 0
                held.append(part)
                count += len(part)
        if count:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(make, key)

        def results(part: pa.RecordBatch) -> pa.RecordBatch:
            inputs = [part.column(1 + k).to_pylist() for k in range(n_in)]
            size = np.sum([np.asarray(pc.utf8_length(part.column(1 + k)).fill_null(0), np.int64) for k in range(n_in)], axis=0)
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(_sorted_runs(model, list(zip(*inputs, strict=True)), size, batch), kind)], ["row", "result"])

        with ThreadPoolExecutor(1) as pool:
            ahead = None
            for part in runs(batches):
                following = pool.submit(results, part)
                if ahead is not None:
                    yield ahead.result()
                ahead = following
            if ahead is not None:
                yield ahead.result()

    return apply


def predict(df: DataFrame, make: Callable[[], Model], inputs: list[str], out: str, kind: str, *, key: str, batch: int = BATCH, rows_at_once: int = SUPER) -> DataFrame:
    """df with out, the model's result for each row. make loads the model, once a worker process for each key; the model takes a
    list of tuples of the inputs (strings, or None) and gives a list of results (kind, a Spark type). Other columns go along."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    type_ = StructType.fromDDL(f"x {kind}")[0].dataType
    names = [c for c in df.columns if c != out]
    row = df.select(F.struct(*names).alias("row"), *(F.col(c).cast("string").alias(f"in{k}") for k, c in enumerate(inputs)))
    shape = StructType().add("row", row.schema["row"].dataType).add("result", type_)
    made = row.mapInArrow(_predict(make, key, len(inputs), to_arrow_type(type_), batch, rows_at_once), shape)
    return made.select("row.*", F.col("result").alias(out))


ship(__name__)
