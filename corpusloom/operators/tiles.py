"""Vectors against queries in tiles: matrix products of bounded size, as many as the data asks for.

Rows and queries of a cell are dealt into parts and blocks by a hash; each pair of a part and a block is one tile, which one call
sees whole. Numbers of parts and blocks come from counts, so a tile holds at most about TILE_BYTES of either side however large or
skewed the cells are, and there are several tiles for each core.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import ship

#: Bytes of vectors that a tile holds of either side, about, and rows that are multiplied at once.
TILE_BYTES, ROWS = 32 << 20, 4096
#: Decimals of scores, so that equal scores tie whatever the order in which their parts were added.
DIGITS = 10


def matrix(lists: pa.Array) -> np.ndarray:
    """Vectors of one length in double precision at length one; those that are zero or hold nulls are not numbers."""
    x = np.asarray(lists.flatten().cast(pa.float64()).fill_null(float("nan"))).reshape(len(lists), -1)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        return x / np.sqrt((x * x).sum(1, keepdims=True))


def by_length(lists: pa.Array) -> dict[int, np.ndarray]:
    """Places of the vectors of each length."""
    size = np.asarray(pc.list_value_length(lists).fill_null(0))
    return {int(n): np.flatnonzero(size == n) for n in np.unique(size[size > 0])}


def best(score: np.ndarray, seq: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best of each row by score, of equal scores by seq, without those that are -inf: never more than k."""
    if score.shape[1] > k:
        least = np.partition(score, -k, axis=1)[:, -k]
        r, c = np.nonzero((score >= least[:, None]) & (score > -np.inf))
    else:
        r, c = np.nonzero(score > -np.inf)
    order = np.lexsort((seq[c], -score[r, c], r))
    r, c = r[order], c[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    return r[place < k], c[place < k]


def exact_best(ids: pa.Array, asked: dict[int, tuple[np.ndarray, np.ndarray]], rows: pa.RecordBatch | pa.Table, k: int) -> list[pa.RecordBatch]:
    """(query_id, id, seq, score) of the k best of each query by cosine among rows (id, seq, embedding), ROWS at a time. asked:
    places in ids and matrices of the queries of each length."""
    out = []
    vectors = rows.column(2).combine_chunks() if isinstance(rows, pa.Table) else rows.column(2)
    for n, own in by_length(vectors).items():
        if n not in asked:
            continue
        at, q = asked[n]
        for a in range(0, len(own), ROWS):
            some = pa.array(own[a : a + ROWS])
            score = np.round(q @ matrix(vectors.take(some)).T, DIGITS)
            score[np.isnan(score)] = -np.inf
            part = rows.take(some)
            seq = np.asarray(part.column(1).fill_null(np.iinfo(np.int64).max), np.int64)
            r, c = best(score, seq, k)
            found = part.select([0, 1]).take(pa.array(c))
            flat = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in found.columns]
            out.append(pa.RecordBatch.from_arrays([ids.take(pa.array(at[r])), *flat, pa.array(score[r, c], pa.float64())], ["query_id", "id", "seq", "score"]))
    return out


def tiled(rows: DataFrame, queries: DataFrame, how: Callable[[pa.Table, pa.Table], pa.Table], schema: str, row_bytes: int, query_bytes: int) -> DataFrame:
    """how(rows, queries) for each tile of each cell. Both have cell (int) and what how reads; rows have id and seq too, queries
    query_id. Each row goes to all blocks of its cell's queries, each query to all parts of its cell's rows; cells that one side
    lacks vanish. row_bytes and query_bytes: what one of either takes in a task's memory."""
    spark = rows.sparkSession
    n = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).join(queries.groupBy("cell").agg(F.count(F.lit(1)).alias("m")), "cell")
    need = lambda c, each: F.ceil(F.col(c) * each / TILE_BYTES)
    sized = n.select("cell", F.greatest(need("n", row_bytes), F.lit(1)).alias("parts"), F.greatest(need("m", query_bytes), F.lit(1)).alias("blocks"), "n")
    tiles, rows_in = sized.agg(F.sum(F.col("parts") * F.col("blocks")), F.sum("n")).first()
    # Too few tiles for the cores: cells get more parts by their share of rows.
    wanted = 3 * spark.sparkContext.defaultParallelism
    if tiles and tiles < wanted:
        sized = sized.withColumn("parts", F.greatest("parts", F.ceil(F.col("n") * wanted / F.lit(max(rows_in, 1)) / F.col("blocks"))))
        tiles = 2 * wanted
    dealt = sized.select("cell", F.col("parts").cast("int").alias("parts"), F.col("blocks").cast("int").alias("blocks"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = rows.join(dealt, "cell").withColumns({"part": F.pmod(F.xxhash64("id", "seq"), F.col("parts")).cast("int")}).withColumn("block", every("blocks"))
    asked = queries.join(dealt, "cell").withColumns({"block": F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")}).withColumn("part", every("parts"))
    n_parts = int(min(max(tiles or 1, 1), 100_000))
    key = ["cell", "part", "block"]
    own, asked = (df.drop("parts", "blocks").repartition(n_parts, *key) for df in (own, asked))
    return own.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(how, schema)


ship(__name__)
