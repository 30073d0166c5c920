"""Scores of chunks where their postings are: a task has all postings of its chunks, so that only each query's best rows move."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import ship
from .tiles import DIGITS, best

#: Products of a posting and a query's weight that are held at once, about, and scores.
AT_ONCE = 2_000_000
#: Steps of a product that are added up as whole numbers, and of what is left below one; sums are exact up to 2^23 and 2^18 products.
STEPS, BELOW = 2.0**30, 2.0**36


def exact_sums(cell: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Sums of the values of n cells. Whole numbers are added, so equal values have equal sums in whatever order they come."""
    steps = value * STEPS
    whole = np.rint(steps)
    return (np.bincount(cell, whole, n) + np.bincount(cell, np.rint((steps - whole) * BELOW), n) / BELOW) / STEPS


@dataclass
class Asked:
    """What queries ask for: the weights of each term's queries stand together."""

    ids: pa.Array
    terms: pa.Array
    begin: np.ndarray
    query: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Asked:
        """From (query_id, term, weight)."""
        id_, term = (table.column(c).combine_chunks().dictionary_encode() for c in ("query_id", "term"))
        code = np.asarray(term.indices)
        order = np.argsort(code, kind="stable")
        begin = np.searchsorted(code[order], np.arange(len(term.dictionary) + 1))
        return cls(id_.dictionary, term.dictionary, begin, np.asarray(id_.indices)[order], np.asarray(table.column("weight"), np.float64)[order])

    def codes(self, terms: pa.Array) -> np.ndarray:
        """Places of terms, -1 for those that nothing asks for."""
        coded = terms.dictionary_encode()
        known = np.asarray(pc.index_in(coded.dictionary, self.terms).fill_null(-1), np.int64)
        return known[np.asarray(coded.indices)] if len(known) else np.zeros(0, np.int64)

    def sums(self, row: np.ndarray, code: np.ndarray, value: np.ndarray, n: int, least: float = -np.inf) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """First and last place of some of n rows, sums of weight * value, least at least, of each of them (rows, queries), and how many
        were added up. row is sorted; codes are not negative."""
        times, q = self.begin[code + 1] - self.begin[code], max(1, len(self.ids))
        total = np.concatenate([[0], np.cumsum(np.bincount(row, times, n).astype(np.int64))])
        a = 0
        while a < n:
            b = min(n, max(a + 1, min(int(np.searchsorted(total, total[a] + AT_ONCE, "right")) - 1, a + AT_ONCE // q)))
            lo, hi = np.searchsorted(row, [a, b])
            own = times[lo:hi]
            post = np.repeat(np.arange(lo, hi), own)
            at = np.arange(len(post)) + np.repeat(self.begin[code[lo:hi]] - (np.cumsum(own) - own), own)
            cell = (row[post] - a) * q + self.query[at]
            yield a, b, exact_sums(cell, np.maximum(self.weight[at] * value[post], least), (b - a) * q).reshape(b - a, q), np.bincount(cell, minlength=(b - a) * q).reshape(b - a, q)
            a = b

    def hits(self, ids: pa.Array, seqs: pa.Array, row: np.ndarray, code: np.ndarray, impact: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
        """(query_id, id, seq, score) of the k best of the rows for each query, of positive scores alone."""
        kept = code >= 0
        row, code, impact = row[kept], code[kept], impact[kept]
        place = np.asarray(seqs.fill_null(np.iinfo(np.int64).max), np.int64)
        for a, b, score, _ in self.sums(row, code, impact, len(ids)):
            score = np.round(np.ascontiguousarray(score.T), DIGITS)
            score[~(score > 0)] = -np.inf
            r, c = best(score, place[a:b], k)
            at = pa.array(c + a)
            yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(r)), ids.take(at), seqs.take(at), pa.array(score[r, c], pa.float64())], ["query_id", "id", "seq", "score"])


def met(rows: DataFrame, asked: DataFrame, how: Callable[[pa.Table, Asked], pa.Table], schema: str, *, most: int, is_few: bool) -> DataFrame:
    """how(rows, asked) of each tile of rows (tile, ..). asked is (query_id, term, weight): if few() says so, all of it goes to each
    tile, else blocks of queries do, with some `most` weights each, and rows (term, ..) go to the blocks that ask for them."""
    if is_few:
        known = Asked.of(asked.toArrow())
        return rows.groupBy("tile").applyInArrow(lambda table: how(table, known), schema)
    n = max(1, -(-asked.count() // most))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block")
    own = rows.join(dealt.select("term", "block").distinct(), "term") if "term" in rows.columns else rows.select("*", every)
    queries = rows.select(F.col("tile").alias("of")).distinct().select(F.col("of").alias("tile"), every).join(dealt, "block")
    return own.groupBy("tile", "block").cogroup(queries.groupBy("tile", "block")).applyInArrow(lambda table, q: how(table, Asked.of(q)), schema)


ship(__name__)
