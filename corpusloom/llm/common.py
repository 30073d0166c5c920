"""What the operators of this folder share: words and hashes of whole texts, and tables in the shared folder."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed: the pattern of a word in every contract here (ASCII white space parts words).
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are cut into runs of about so many bytes, so that a task's arrays stay small whatever a batch holds.
CHUNK_BYTES, HASH_BYTES = 2 << 20, 256 << 10
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(module: str) -> None:
    """Sends the module's functions to executors by value, so that they need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir; where that is unset, in local mode alone, one below
    the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_corpusloom"
    return base.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """The folder of this application's tables and archives."""
    return f"{shared_dir(spark)}/corpusloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def save(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as a table in the shared folder and reads it back. The write's own shuffle files go with it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables written by save() that nothing needs any more."""
    for df in tables:
        _delete(df.sparkSession, df._saved_at)


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has written to the shared folder, once its results are read."""
    _delete(spark, own_dir(spark))


def column(df: DataFrame, name: str) -> Column:
    """The column of exactly this name (a name may hold dots)."""
    return df["`" + name.replace("`", "``") + "`"]


# Hashing of words -------------------------------------------------------------------------------------------------

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTE[_SPACE] = 0
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """The words of a run of texts: byte spans in data, 64-bit hashes, and the span of words of each text."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.cast(pa.large_string()).fill_null("")
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        body = texts.buffers()[2]
        data = np.frombuffer(body, np.uint8)[off[0] : off[-1]] if body is not None and off[-1] > off[0] else np.empty(0, np.uint8)
        off = off - off[0]
        self.data, self.offsets, n = data, off, len(data)
        word = ~_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = word[:-1]
        self.starts = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = word[1:]
        self.ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, off)  # the words of text i are first[i] to first[i + 1]
        self.counts = np.diff(self.first)
        self._table = _LOWER if lower else _BYTE
        self._hashes: np.ndarray | None = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            n, starts = len(self.data), self.starts
            self._hashes = np.empty(len(starts), np.uint64)
            # Words of about HASH_BYTES at a time: what a long text needs besides its hashes stays small.
            cuts = np.unique(np.searchsorted(starts, np.arange(0, n, HASH_BYTES)).tolist() + [len(starts)])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                sizes, low = self.ends[a:b] - starts[a:b], starts[a]
                high = starts[b] if b < len(starts) else n
                pos = np.arange(low, high) - np.repeat(starts[a:b], np.diff(np.append(starts[a:b], high)))
                size = int(sizes.max())
                terms = self._table[self.data[low:high]] * powers(_P, size + 1)[np.minimum(pos, size)]
                self._hashes[a:b] = mix(np.add.reduceat(terms, starts[a:b] - low) + sizes.astype(np.uint64))
        return self._hashes

    def take(self, picks: np.ndarray) -> Words:
        """The words of some of the texts, in their order, without parting them anew."""
        if len(picks) == len(self.counts):
            return self
        out = Words.__new__(Words)

        def gather(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            sizes = bounds[picks + 1] - bounds[picks]
            ends = np.concatenate([[0], np.cumsum(sizes)])
            return np.arange(ends[-1]) + np.repeat(bounds[picks] - ends[:-1], sizes), ends, sizes

        at, out.offsets, _ = gather(self.offsets)
        words, out.first, out.counts = gather(self.first)
        move = np.repeat(out.offsets[:-1] - self.offsets[picks], out.counts)
        out.data, out.starts, out.ends = self.data[at], self.starts[words] + move, self.ends[words] + move
        out._table, out._hashes = self._table, None if self._hashes is None else self._hashes[words]
        return out

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on (the last k - 1 run over what follows: mask them)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, p in enumerate(powers(_Q, k)):
        out += hashes[j : j + n] * p
    return mix(out)


def runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Spans of texts of about CHUNK_BYTES; a longer text is alone in its span."""
    sizes = np.asarray(pa.compute.binary_length(texts).fill_null(0), np.int64)
    total = np.concatenate([[0], np.cumsum(sizes)])
    a, n = 0, len(texts)
    while a < n:
        b = max(a + 1, int(np.searchsorted(total, total[a] + CHUNK_BYTES, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def longs(x) -> pa.Array:
    return pa.array(np.asarray(x).astype(np.int64, copy=False), pa.int64())


def blobs(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary values: the parts of flat between offsets (counted in items)."""
    at = (np.asarray(offsets, np.int64) * flat.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(np.ascontiguousarray(flat).tobytes())]).cast(pa.binary())


def sha_spans(spans: Column) -> Column:
    """kind:start:end of an array of such structs, comma-joined in its order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


import pyarrow.compute  # noqa: E402, F401

ship(__name__)
