"""Conversations as keyed state: a stream of log entries, the latest entry of each key in a store that can be read at any time.

State holds one entry for each key, however often it was written; a deletion clears it. What a micro-batch changes goes to the
store under the batch's number, so a batch that is replayed after a loss replaces itself.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructType

from ..sources import vector_store
from ..sources.scratch import ship

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Latest(StatefulProcessor):
    """Keeps the entry with the largest seq of each key and gives out what changes: the entry, or that it is deleted."""

    def __init__(self, names: list[str], shape: StructType, seq: str):
        self.names, self.shape, self.seq = names, shape, names.index(seq)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.shape)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timer) -> Iterator[Row]:  # noqa: N802
        kept = tuple(self.last.get()) if self.last.exists() else None
        now, gone, before = kept, False, kept
        for row in sorted((tuple(r) for r in rows), key=lambda r: r[self.seq]):
            if now is not None and row[self.seq] < now[self.seq]:
                continue
            gone = bool(row[-1])
            now, before = (None, row) if gone else (row[:-1], row)
        if gone:
            self.last.clear()
            yield self.row((*before[:-1], True))
        elif now is not None and now != kept:
            self.last.update(now)
            yield self.row((*now, False))

    def row(self, values: tuple) -> Row:
        return Row(**dict(zip((*self.names, "deleted"), values, strict=True)))

    def close(self) -> None:
        pass


def keep_latest(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, key: str, *, seq: str = "seq", files: int | None = None, batches: int | None = None, buckets: int = 64) -> None:
    """Takes the entries in source (parquet of schema and a boolean deleted) that earlier calls have not taken. Entries of a key
    come in the order of seq, but for those of one batch; a null in deleted is false. files: so many files a batch; batches: stop
    after so many, as a loss would."""
    shape = StructType.fromDDL(schema)
    names = shape.fieldNames()
    reader = spark.readStream.schema(StructType.fromDDL(f"{schema}, deleted boolean"))
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    out = StructType(list(shape.fields)).add("deleted", BooleanType())
    record = f"id string, {schema}, deleted boolean"

    def store(batch: DataFrame, number: int) -> None:
        if batches is not None and number >= batches:
            raise InterruptedError(f"stopped before batch {number}")
        vector_store.upsert(batch.withColumn("id", F.col(key).cast("string")), target, number, record, buckets)

    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)  # keyed state of this kind needs it; the query keeps what it was started with
    try:
        entries = reader.parquet(source).select(*names, "deleted")
        changed = entries.groupBy(key).transformWithState(statefulProcessor=Latest(names, shape, seq), outputStructType=out, outputMode="Update", timeMode="None")
        query = changed.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)


def latest(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """The latest entry of each key that is not deleted."""
    return vector_store.read(spark, target, f"id string, {schema}, deleted boolean").where("not deleted").select(*StructType.fromDDL(schema).fieldNames())


ship(__name__)
