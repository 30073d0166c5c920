"""A table of chunks in buckets by id, each with the ids of its neighbours: lookups, reranking and expansion leave it where it is.

What a search joins with chunks is small beside them. Where it is too large to be broadcast it is dealt as the buckets are, so chunks
are not shuffled; a neighbour is one more lookup by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Buckets of a table; each is a task's part of a join that is not broadcast, so there should be several for each core.
BUCKETS = 256


def with_neighbours(chunks: DataFrame) -> DataFrame:
    """chunks with prev_id and next_id: the chunks of the same document one place away in seq and in chunk_index, or null. A
    document without a name is one document. Tasks see one document's places at a time, never its texts in one row."""
    w = Window.partitionBy("source_file").orderBy("seq", "id")

    def at(step: int):
        near = lambda c: F.lead(c, step).over(w)
        return F.when((F.abs(near("seq") - F.col("seq")) == 1) & (F.abs(near("chunk_index") - F.col("chunk_index")) == 1), near("id"))

    places = chunks.select("id", "seq", "source_file", "chunk_index").withColumns({"prev_id": at(-1), "next_id": at(1)})
    return chunks.join(places.select("id", "prev_id", "next_id"), "id")


def write(chunks: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> None:
    """Writes chunks (ids unique, not null) as the table name of the session's catalog, its files at path. A table of that name goes."""
    chunks.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    # One file a bucket: rows are dealt as the buckets are.
    dealt = with_neighbours(chunks).repartition(buckets, "id").sortWithinPartitions("id")
    dealt.write.mode("overwrite").bucketBy(buckets, "id").sortBy("id").option("path", path).saveAsTable(name)


def read(spark: SparkSession, name: str) -> DataFrame:
    """The chunks; retrieval's functions take them as any others, and find neighbours by their ids."""
    return spark.table(name)
