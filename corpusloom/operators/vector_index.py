"""A written index of vectors: cells around centroids, quantised residuals, and the vectors themselves for exact scores.

build() fits centroids on a bounded sample and writes every row to its centroid's partition: one byte for each number of what is
left of the vector at length one, a scale, and how far at most that is off. nearest() reads the codes of the cells that a query
probes, keeps what may still be among its k best by the bounds that the codes give, and scores that by the vectors themselves. So
a hit's score is exact, what is probed is searched without loss, and with all cells probed the result is dense()'s.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.scratch import ship, written
from .retrieval import K_DENSE, few, top_k
from .tiles import DIGITS, ROWS, by_length, matrix, tiled

#: Centroids are fitted on at most so many vectors, those with the smallest hashes of their ids, and at most so many bytes of them.
SAMPLE, SAMPLE_BYTES = 50_000, 64 << 20
#: Rounds of fitting; sampled vectors for each cell at least; cells at most.
ROUNDS, PER_CELL, MOST_CELLS = 12, 8, 4096
#: How much of the best a query should find, as measured with so many of the sampled vectors, at most, as queries.
RECALL, TRIED = 0.95, 256
CENTROIDS, CODES = "centroids", "codes"


def _fit(x: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of x by Lloyd's rounds from evenly spread rows; a cell that loses all its rows takes the worst-placed ones."""
    c = x[np.linspace(0, len(x) - 1, cells).astype(int)].copy()
    for _ in range(ROUNDS):
        near = _nearest_cells(x, c)
        n = np.bincount(near, minlength=cells)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        empty = np.flatnonzero(n == 0)
        c = total / np.maximum(n, 1)[:, None]
        if len(empty):
            c[empty] = x[np.argsort((x * c[near]).sum(1))[: len(empty)]]
    return c


def _nearest_cells(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmax(x[a : a + ROWS] @ c.T - half, axis=1) for a in range(0, len(x), ROWS)] or [np.empty(0, np.int64)])


def _first_cells(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cells in the order in which each query probes them."""
    return np.argsort((c * c).sum(1) / 2 - q @ c.T, axis=1, kind="stable")


def _probes(x: np.ndarray, c: np.ndarray, recall: float) -> int:
    """How many cells a query must probe to find this share of its K_DENSE nearest, by sampled vectors asked for the others."""
    if len(x) < 2:
        return 1
    asked = np.unique(np.linspace(0, len(x) - 1, min(TRIED, len(x))).astype(int))
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    k = min(K_DENSE, len(x) - 1)
    best = np.argpartition(-score, k - 1, axis=1)[:, :k]
    place = np.argsort(_first_cells(x[asked], c), axis=1)
    found = np.sort(np.take_along_axis(place, _nearest_cells(x, c)[best], axis=1).ravel())
    return int(found[min(len(found) - 1, int(np.ceil(recall * len(found))))]) + 1


def _coded(c: np.ndarray, n_extra: int):
    """From (embedding, id, seq, extras) to the row's cell, code, scale, error and digest of the vector, with what came in."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = by_length(batch.column(0)).get(c.shape[1])
            if own is None:
                continue
            x = matrix(batch.column(0).take(pa.array(own)))
            good = np.isfinite(x).all(1)
            x, some = x[good], batch.take(pa.array(own[good]))
            cell = _nearest_cells(x, c)
            rest = x - c[cell]
            scale = np.abs(rest).max(1, initial=0) / 127
            code = np.rint(rest / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
            # The error of a product with a vector of length one; a little more for rounding.
            error = np.sqrt(((rest - code * scale[:, None]) ** 2).sum(1)) + 1e-9
            codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(c.shape[1]), len(code), [None, pa.py_buffer(code.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), codes, pa.array(scale), pa.array(error), *some.columns], ["cell", "code", "scale", "error", "embedding", "id", "seq", *(f"x{i}" for i in range(n_extra))])

    return apply


def build(vectors: DataFrame, path: str, *, cells: int | None = None, keep: tuple[str, ...] = (), recall: float = RECALL) -> None:
    """Writes the index of vectors (id, seq, embedding; id and seq not null) to path. keep names further columns that nearest() may filter by.

    All vectors have one length, that of most sampled ones; others, and those that are zero or hold nulls, are in no ranking
    and are left out. Cells: the square root of the number of rows, unless given. recall: what share of the best a query should
    find; how many cells that takes is measured on the sample and kept."""
    spark = vectors.sparkSession
    rows = vectors.select("embedding", "id", "seq", *keep)
    (count,) = rows.agg(F.count(F.lit(1))).first()
    tried = rows.where("embedding is not null").select("embedding", F.xxhash64("id", "seq").alias("h")).orderBy("h").limit(SAMPLE).select("embedding").toArrow().column(0).combine_chunks()
    lengths = by_length(tried)
    dim = max(lengths, key=lambda n: (len(lengths[n]), n), default=1)
    x = matrix(tried.take(pa.array(lengths.get(dim, np.empty(0, np.int64))[: SAMPLE_BYTES // (8 * dim)]))) if lengths else np.empty((0, 1))
    x = x[np.isfinite(x).all(1)]
    cells = max(1, min(cells or int(count**0.5), MOST_CELLS, len(x) // PER_CELL))
    c = _fit(x, cells) if len(x) else np.zeros((1, dim))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    shape = f"cell int, code binary, scale double, error double, embedding {kinds['embedding']}, id {kinds['id']}, seq {kinds['seq']}" + "".join(f", x{i} {kinds[k]}" for i, k in enumerate(keep))
    coded = rows.mapInArrow(_coded(c, len(keep)), shape).withColumn("digest", F.xxhash64("embedding"))
    coded = coded.withColumnsRenamed({f"x{i}": k for i, k in enumerate(keep)})
    about = (_probes(x, c, recall), coded.schema.json())  # an index without rows has no file that tells its columns
    spark.createDataFrame([(i, v.tolist(), *about) for i, v in enumerate(c)], "cell int, centroid array<double>, probes int, schema string").coalesce(1).write.mode("overwrite").parquet(f"{path}/{CENTROIDS}")
    # Whole cells where they are small, several tasks where they are large.
    coded.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/{CODES}")


def centroids(spark: SparkSession, path: str) -> tuple[np.ndarray, int, StructType]:
    """The centroids, MOST_CELLS at most, how many cells a query probes unless told otherwise, and the columns of the codes."""
    found = spark.read.schema("cell int, centroid array<double>, probes int, schema string").parquet(f"{path}/{CENTROIDS}").toPandas().sort_values("cell")
    return np.array(found["centroid"].tolist()), int(found["probes"].iloc[0]), StructType.fromJson(json.loads(found["schema"].iloc[0]))


def _probed(c: np.ndarray, probes: int):
    """From (query_id, embedding) to (query_id, cell, vector, base): the probed cells, the query at length one, its product with the
    cell's centroid. Queries that have no direction or another length probe nothing."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = by_length(batch.column(1)).get(c.shape[1])
            if own is None:
                continue
            q = matrix(batch.column(1).take(pa.array(own)))
            good = np.isfinite(q).all(1)
            q, ids = q[good], batch.column(0).take(pa.array(own[good]))
            for a in range(0, len(q), ROWS):
                base = q[a : a + ROWS] @ c.T
                n = min(probes, len(c))
                first = _first_cells(q[a : a + ROWS], c)[:, :n]
                at = np.repeat(np.arange(len(base)), n)
                cell = first.ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * c.shape[1], pa.int32()), pa.array(q[a : a + ROWS][at].ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(a, len(base)).take(pa.array(at)), pa.array(cell, pa.int32()), lists, pa.array(base[at, cell])], ["query_id", "cell", "vector", "base"])

    return apply


def _possible(ids: pa.Array, q: np.ndarray, base: np.ndarray, rows: pa.RecordBatch | pa.Table, k: int) -> list[pa.RecordBatch]:
    """(query_id, id, seq, cell, low, high) of the rows of one cell that may be among a query's k best: their highest score is not
    below the k-th lowest. Of equal vectors the k first by seq are enough."""
    column = {n: rows.column(n).combine_chunks() if isinstance(rows, pa.Table) else rows.column(n) for n in ("id", "seq", "cell", "code", "scale", "error", "digest")}
    seq = np.asarray(column["seq"].fill_null(np.iinfo(np.int64).max), np.int64)
    digest = np.asarray(column["digest"], np.int64)
    order = np.lexsort((seq, digest))
    place = np.arange(len(order)) - np.searchsorted(digest[order], digest[order])
    picks, out = np.sort(order[place < k]), []
    for a in range(0, len(picks), ROWS):
        own = picks[a : a + ROWS]
        code = np.frombuffer(b"".join(column["code"].take(pa.array(own)).to_pylist()), np.int8).reshape(len(own), -1)
        score = base[:, None] + (q @ code.T.astype(np.float64)) * np.asarray(column["scale"])[own]
        error = np.asarray(column["error"])[own]
        low = score - error
        least = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(q), -np.inf)
        r, i = np.nonzero(score + error >= least[:, None])
        at = pa.array(own[i])
        out.append(pa.RecordBatch.from_arrays([ids.take(pa.array(r)), *(column[n].take(at) for n in ("id", "seq", "cell")), pa.array(low[r, i]), pa.array((score + error)[r, i])], ["query_id", "id", "seq", "cell", "low", "high"]))
    return out


def _scan(probes: pa.Table, k: int):
    """As a map over codes, for probes that are few: each batch meets the queries of its cells."""
    cell = np.asarray(probes.column("cell"))
    order = np.argsort(cell, kind="stable")
    probes, cell = probes.take(pa.array(order)).combine_chunks(), cell[order]
    ids, base = probes.column("query_id").combine_chunks(), np.asarray(probes.column("base"))
    vectors = probes.column("vector").combine_chunks()
    q = np.asarray(vectors.flatten()).reshape(len(cell), -1) if len(cell) else np.empty((0, 1))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.asarray(batch.column("cell"))
            for one in np.unique(own):
                a, b = np.searchsorted(cell, one), np.searchsorted(cell, one, "right")
                if a < b:
                    yield from _possible(ids.slice(a, b - a), q[a:b], base[a:b], batch.take(pa.array(np.flatnonzero(own == one))), k)

    return apply


def _tile(k: int):
    def apply(rows: pa.Table, queries: pa.Table) -> pa.Table:
        kind = lambda t, n: t.schema.field(n).type
        shape = pa.schema([("query_id", kind(queries, "query_id")), ("id", kind(rows, "id")), ("seq", kind(rows, "seq")), ("cell", pa.int32()), ("low", pa.float64()), ("high", pa.float64())])
        if not len(rows) or not len(queries):
            return shape.empty_table()
        q = np.asarray(queries.column("vector").combine_chunks().flatten()).reshape(len(queries), -1)
        found = _possible(queries.column("query_id").combine_chunks(), q, np.asarray(queries.column("base")), rows, k)
        return pa.Table.from_batches(found, shape) if found else shape.empty_table()

    return apply


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (query_id, id, seq, embedding, asked) to the exact score."""
    for batch in batches:
        score = (matrix(batch.column(3)) * matrix(batch.column(4))).sum(1) if len(batch) else np.empty(0)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.round(score, DIGITS))], ["query_id", "id", "seq", "score"])


def nearest(spark: SparkSession, path: str, queries: DataFrame, k: int = K_DENSE, *, probes: int | None = None, where: Column | None = None, is_few: bool | None = None) -> DataFrame:
    """query_id, id, seq, score, rank as of dense(), among the rows of the cells that each query (query_id, embedding) probes.

    Only the probed cells' files are read, of them the codes, and the vectors of what remains. where filters by columns that
    build() kept. is_few, as few() says it: the probed cells' codes stay where they are read; else codes and queries meet in
    tiles. Probed cells are collected, MOST_CELLS at most."""
    c, usual, columns = centroids(spark, path)
    n = probes or usual
    asked = queries.select("query_id", "embedding")
    kinds = {f.name: f.dataType.simpleString() for f in asked.schema.fields}
    # Written once: they are asked for the cells, the tiles and the scores.
    probed, _ = written(asked.mapInArrow(_probed(c, n), f"query_id {kinds['query_id']}, cell int, vector array<double>, base double"), "probes")
    cells = [r.cell for r in probed.select("cell").distinct().collect()]
    table = spark.read.schema(columns).parquet(f"{path}/{CODES}").where(F.col("cell").isin(cells))
    if where is not None:
        table = table.where(where)
    codes = table.select("id", "seq", "cell", "code", "scale", "error", "digest")
    kinds |= {f.name: f.dataType.simpleString() for f in codes.schema.fields}
    shape = f"query_id {kinds['query_id']}, id {kinds['id']}, seq {kinds['seq']}, cell int, low double, high double"
    if is_few is None:
        is_few = "query" in queries.columns and few(queries)
    possible = codes.mapInArrow(_scan(probed.toArrow(), k), shape) if is_few and cells else tiled(codes, probed, _tile(k), shape, c.shape[1] + 32, 8 * c.shape[1])
    # Over all cells: what cannot be below the k-th of the lowest scores.
    best_low = top_k(possible.select("query_id", "seq", "low"), "low", k, "seq").groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("low")).otherwise(F.lit(float("-inf"))).alias("least"))
    left = possible.join(best_low, "query_id").where("high >= least").select("query_id", "id", "seq", "cell").distinct()
    exact = left.join(table.select("id", "seq", "cell", "embedding"), ["id", "seq", "cell"]).join(asked.withColumnRenamed("embedding", "asked"), "query_id")
    scored = exact.select("query_id", "id", "seq", "embedding", "asked").mapInArrow(_cosines, f"query_id {kinds['query_id']}, id {kinds['id']}, seq {kinds['seq']}, score double")
    return top_k(scored, "score", k, "seq")


ship(__name__)
