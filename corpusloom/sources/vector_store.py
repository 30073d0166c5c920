"""A table of records by id in buckets, where an upsert rewrites only the buckets that it changes.

A record's bucket follows from its document, so what changes with a document lies together. An upsert reads the buckets of the new
records, writes what becomes of them beside the table, and puts that in their place by a dynamic partition overwrite; all other files
stay as they are. Of equal ids the record with the largest version stays, of equal versions the later upsert's, so upserts may be
repeated and may come late. Whenever one is stopped, settle() ends or undoes it: what lies beside the table is whole or not used.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from .files import VECTOR_SCHEMA
from .scratch import discard

#: Buckets of a new table: so many are listed when it is read, and collected when it is changed, at most.
BUCKETS = 1024
#: Columns that the table adds: when a record was first and last written, and what orders records of one id.
STAMPS = "created_at timestamp, updated_at timestamp, version long"
_PENDING = "__pending"


def document_of(id_: Column) -> Column:
    """What an id has before its last number sign: the document that a chunk is of."""
    return F.regexp_replace(id_, "#[^#]*$", "")


def schema_of(schema: str) -> StructType:
    return StructType.fromDDL(f"{schema}, {STAMPS}")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All records with bucket; none if there is no table yet."""
    full = schema_of(schema).add("bucket", IntegerType())
    return spark.read.schema(full).parquet(path) if _exists(spark, path) else spark.createDataFrame([], full)


def _apply(spark: SparkSession, path: str, schema: str) -> None:
    ready = spark.read.schema(schema_of(schema).add("bucket", IntegerType())).parquet(path + _PENDING)
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    discard(spark, path + _PENDING)


def settle(spark: SparkSession, path: str, schema: str = VECTOR_SCHEMA) -> None:
    """Ends an upsert that was stopped: what it had written wholly is put in place, else thrown away."""
    if _exists(spark, f"{path}{_PENDING}/_SUCCESS"):
        _apply(spark, path, schema)
    elif _exists(spark, path + _PENDING):
        discard(spark, path + _PENDING)


def read(spark: SparkSession, path: str, schema: str = VECTOR_SCHEMA) -> DataFrame:
    """The records, one of each id, with STAMPS. Nothing is shuffled."""
    settle(spark, path, schema)
    return _table(spark, path, schema).drop("bucket")


def lookup(spark: SparkSession, path: str, ids: list[str], schema: str = VECTOR_SCHEMA, buckets: int = BUCKETS) -> DataFrame:
    """The records of a few ids: only their buckets are opened."""
    own = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "id string").select(_bucket(F.col("id"), buckets)).distinct().collect()]
    settle(spark, path, schema)
    return _table(spark, path, schema).where(F.col("bucket").isin(own) & F.col("id").isin(ids)).drop("bucket")


def _bucket(id_: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(document_of(id_)), F.lit(buckets)).cast("int")


def upsert(new: DataFrame, path: str, version: Column | int = 0, schema: str = VECTOR_SCHEMA, buckets: int = BUCKETS, at: Column | None = None) -> None:
    """Puts the records of new (schema, ids not null) into the table at path, which is made if need be; buckets must be what it
    was made with. version orders records of one id: a number for all, or a Column of new. at: the time that is noted, now unless
    given. Of new records with one id and version, that with the largest document stays."""
    spark = new.sparkSession
    settle(spark, path, schema)
    names = StructType.fromDDL(schema).fieldNames()
    at = F.current_timestamp() if at is None else at
    stamped = new.select(*names, at.alias("created_at"), at.alias("updated_at"), F.lit(version).cast("long").alias("version"), _bucket(F.col("id"), buckets).alias("bucket"))
    stamped = stamped.persist(StorageLevel.MEMORY_AND_DISK)  # new may come of a model or of a stream's state: it is made once
    try:
        _upsert(spark, stamped, path, schema, names)
    finally:
        stamped.unpersist()


def _upsert(spark: SparkSession, stamped: DataFrame, path: str, schema: str, names: list[str]) -> None:
    changed = [r.bucket for r in stamped.select("bucket").distinct().collect()]  # buckets numbers at most
    if not changed:
        return
    old = _table(spark, path, schema).where(F.col("bucket").isin(changed))
    both = old.withColumn("__new", F.lit(False)).unionByName(stamped.withColumn("__new", F.lit(True)))
    row = F.struct(*names, "updated_at", "version")
    kept = both.groupBy("bucket", "id").agg(F.max_by(row, F.struct("version", "__new", F.col("document" if "document" in names else "id"))).alias("r"), F.min("created_at").alias("created_at"))
    ready = kept.select("bucket", *(F.col(f"r.{n}").alias(n) for n in (*names, "updated_at", "version")), "created_at")
    # Beside the table first: until this is whole, the table is as it was.
    ready.hint("rebalance", "bucket").write.mode("overwrite").parquet(path + _PENDING)
    _apply(spark, path, schema)


def delete(spark: SparkSession, path: str, documents: DataFrame, schema: str = VECTOR_SCHEMA, buckets: int = BUCKETS) -> None:
    """Removes all records of the documents (a column document). Buckets without any other record stay, empty."""
    settle(spark, path, schema)
    gone = documents.select(F.col("document").alias("__gone")).distinct()
    changed = [r[0] for r in gone.select(_bucket(F.col("__gone"), buckets)).distinct().collect()]
    if not changed:
        return
    old = _table(spark, path, schema).where(F.col("bucket").isin(changed))
    left = old.join(gone, document_of(F.col("id")) == F.col("__gone"), "left_anti")
    left.hint("rebalance", "bucket").write.mode("overwrite").parquet(path + _PENDING)
    # A bucket of which nothing is left is in no partition that is written, so it is emptied by itself.
    filled = {r.bucket for r in left.select("bucket").distinct().collect()}
    _apply(spark, path, schema)
    for b in set(changed) - filled:
        if _exists(spark, f"{path}/bucket={b}"):
            discard(spark, f"{path}/bucket={b}")
