"""Incremental ingestion: new documents become chunks and vectors once each, whatever is stopped in between."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import chunks_of
from ..operators.inference import Model, predict
from ..operators.retrieval import hash_embed
from ..sources import vector_store
from ..sources.files import vector_records


def record_id() -> Column:
    """An id that a replay gives again: a document's name and the chunk's place in it."""
    return F.concat_ws("#", "source_file", F.col("chunk_index").cast("string"))


def embedded(docs: DataFrame, embed: Callable[[Column], Column] = hash_embed, model: Callable[[], Model] | None = None, key: str = "embedding", **how) -> DataFrame:
    """The records of the documents' chunks, with embeddings by embed, a Column function, or by model: what loads a model, once
    a worker, that takes texts in batches of like lengths (inference.predict())."""
    chunks = chunks_of(docs, **how).withColumn("id", record_id())
    if model is None:
        return vector_records(chunks.withColumn("embedding", embed(F.col("content"))))
    return vector_records(predict(chunks, model, ["content"], "embedding", "array<float>", key=key))


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, *, embed: Callable[[Column], Column] = hash_embed, **how) -> None:
    """Takes all documents in source (parquet, schema) that earlier calls have not taken and stores their vectors in target.

    The checkpoint knows which files are done. A batch's number is its records' version, so one that is replayed after a loss
    replaces itself, and of a changed document the latest batch's records stay. Only the buckets of its documents are rewritten.
    """

    def store(batch: DataFrame, number: int) -> None:
        vector_store.upsert(embedded(batch, embed, **how), target, number)

    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def stored(spark: SparkSession, target: str) -> DataFrame:
    """The latest record of each id."""
    return vector_store.read(spark, target).drop("created_at", "updated_at", "version")
