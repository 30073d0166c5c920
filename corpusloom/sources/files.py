"""Files in and out: wiki pages, Markdown, JSON lines, vectors, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import numbered

_METADATA = (("source_file", "string"), ("page_title", "string"), ("section_heading", "string"), ("chunk_index", "long"), ("total_chunks", "long"), ("author", "string"), ("date", "string"), ("content_type", "string"), ("char_count", "long"), ("estimated_tokens", "long"))
CHUNK_SCHEMA = "content string, " + ", ".join(f"{name} {kind}" for name, kind in _METADATA)
VECTOR_SCHEMA = f"id string, embedding array<float>, document string, metadata struct<{', '.join(f'{name}:{kind}' for name, kind in _METADATA)}>"


def read_texts(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("txt", "twiki"), recursive: bool = False) -> DataFrame:
    """path, folder, name, stem, ext, size, text: a row for each file. Bytes that are not UTF-8 become U+FFFD. Spark does not see
    files without a byte. Rows have no
    order; page_order() gives the one of a listing."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
    files = (reader.option("recursiveFileLookup", "true") if recursive else reader).load(path)
    name = F.substring_index("path", "/", -1)
    ext = F.substring_index(name, ".", -1)
    return files.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), ext.alias("ext"), F.col("length").alias("size"), F.col("content").cast("string").alias("text"))


def page_order() -> list:
    """Sort keys of a flat listing: all .txt before all .twiki, then by name."""
    return [F.when(F.col("ext") == "txt", 0).otherwise(1), F.col("name")]


def name_order() -> list:
    """Sort keys of a recursive listing: names without regard to case."""
    return [F.lower("name"), F.col("path")]


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    return read_texts(spark, path, ("md",))


def write_texts(docs: DataFrame, path: str, key: str = "path", text_col: str = "markdown") -> None:
    """The texts as a table with their keys. A path keeps its folder, so equal names from two folders do not overwrite."""
    docs.select(key, text_col).write.mode("overwrite").parquet(path)


def _paths(spark: SparkSession, path: str):
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    here, new, old = (jvm(path.rstrip("/") + end) for end in ("", "__new", "__old"))
    return here.getFileSystem(spark._jsc.hadoopConfiguration()), jvm(path.rstrip("/") + "__new/_SUCCESS"), here, new, old


def settle(spark: SparkSession, path: str) -> None:
    """Ends a rewrite that was stopped: where the table is missing, the new one, complete, takes its place; leftovers go."""
    fs, done, here, new, old = _paths(spark, path)
    if not fs.exists(here) and fs.exists(done):
        fs.rename(new, here)
    if fs.exists(here) and fs.exists(old):
        fs.delete(old, True)


def read_jsonl(spark: SparkSession, path: str, schema: str = CHUNK_SCHEMA) -> DataFrame:
    """One object a line with a fixed schema, so nothing is read twice to infer it; blank lines are skipped."""
    settle(spark, path)
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, *, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def rewrite_jsonl(df: DataFrame, path: str) -> None:
    """Replaces a table that df itself may be read from: the new one is written beside it, the old one steps aside, the new one
    takes its place. Whenever this is stopped, a complete table is there; settle() finds it."""
    spark = df.sparkSession
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path.rstrip("/") + "__new")
    fs, _, here, new, old = _paths(spark, path)
    fs.delete(old, True)
    if fs.exists(here):
        fs.rename(here, old)
    fs.rename(new, here)
    fs.delete(old, True)


def length_batches(chunks: DataFrame, size: int = 64) -> DataFrame:
    """chunks with batch: texts of like lengths together, so that a model pads little. The longest come first; ties go by id."""
    placed = numbered(chunks.withColumn("__length", F.length("content")), [F.desc("__length"), "id"], "__at")
    return placed.withColumn("batch", F.floor(F.col("__at") / size)).drop("__length", "__at")


def vector_records(chunks: DataFrame, embedding: str = "embedding") -> DataFrame:
    """VECTOR_SCHEMA records of chunks with id and an embedding; missing text is empty, missing numbers 0."""
    fields = [F.coalesce(F.col(name), F.lit("" if kind == "string" else 0)).cast(kind).alias(name) for name, kind in _METADATA]
    return chunks.select("id", F.col(embedding).cast("array<float>").alias("embedding"), F.col("content").alias("document"), F.struct(*fields).alias("metadata"))


def pending(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """The chunks that have no vector stored yet: where a stopped run goes on."""
    return chunks.join(stored.select("id"), "id", "left_anti")


def upsert_vectors(stored: DataFrame, new: DataFrame) -> DataFrame:
    """stored with the records of new in place of those of equal ids, and the others added; of equal new ids one stays."""
    fresh = new.dropDuplicates(["id"])
    return stored.join(fresh.select("id"), "id", "left_anti").select(*stored.columns).unionByName(fresh.select(*stored.columns))
