"""A kept index for BM25: postings in blocks of neighbouring chunks, with each block's largest impact.

What a posting adds to a score, but for the term's weight, is its impact. A block holds a term's postings in one range of chunks,
RANGE places in seq long. build() deals texts by ranges and makes blocks where a range's texts are; blocks are written by buckets of
terms, and by slices of ranges, so that no task has a frequent term to itself. search() reads only the buckets of the terms asked for. For each query and range it adds up
the largest impacts of the query's terms there: more no chunk of the range can have. The ranges that promise most are scored
first, which gives the query a score that its k-th hit reaches at least; ranges that promise less to all queries are left unopened. What is left is
summed up, so hits and scores are those of bm25().
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import lexical_tokens
from ..sources.scratch import discard, ship, written
from .retrieval import BM25_B, BM25_EPSILON, BM25_K1, BROADCAST_ROWS, K_LEXICAL, TOKENS, counted, exact_mean, few, postings, small, top_k
from .scoring import Asked, met

#: Places in seq of a range, ranges of a query that are scored first.
RANGE, FIRST = 128, 8
#: Postings of a bucket, about, the most buckets and the fewest.
PER_BUCKET, MOST_BUCKETS, LEAST_BUCKETS = 500_000, 4096, 16
#: Bytes of text that a task makes blocks of, about; ranges of a slice, and of a tile that is scored at once.
TEXTS, SLICE, TILE = 16 << 20, 8192, 64
#: More than two ways of adding up a score can differ by.
MARGIN = 1e-9
ABOUT, TERMS, BLOCKS = "about", "terms", "blocks"


def _bucket(n: int):
    return F.pmod(F.xxhash64("term"), F.lit(n)).cast("int")


def _cut(avgdl: float, k1: float, b: float):
    """From (id, seq, range, tokens), sorted by range, to blocks: term, range, most, and lists of id, seq and impact. Some TOKENS tokens
    are taken at once, up to the end of a range if there is one; else the block ends too, and its range has one more."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pc.list_value_length(batch.column(3)).fill_null(0), np.int64)
            total, place = np.concatenate([[0], np.cumsum(sizes)]), np.asarray(batch.column(2))
            ends = np.append(np.flatnonzero(place[1:] != place[:-1]) + 1, len(batch))
            at = 0
            while at < len(sizes):
                to = max(at + 1, int(np.searchsorted(total, total[at] + TOKENS, "right")) - 1)
                whole = ends[(ends > at) & (ends <= to)]
                to = int(whole[-1]) if len(whole) else to
                part = batch.slice(at, to - at)
                row, code, words, tf = counted(part.column(3), sizes[at:to])
                own = place[at:to][row]
                order = np.lexsort((row, code, own))
                row, code, own = row[order], code[order], own[order]
                tf, length = tf[order].astype(float), sizes[at:to][row]
                begins = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (own[1:] != own[:-1]))) if len(row) else np.zeros(0, int)
                impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avgdl))
                most = np.maximum.reduceat(impact, begins) if len(row) else impact
                bounds, taken = pa.array(np.append(begins, len(row)), pa.int32()), pa.array(row)
                lists = [pa.ListArray.from_arrays(bounds, x) for x in (part.column(0).take(taken), part.column(1).take(taken), pa.array(impact))]
                yield pa.RecordBatch.from_arrays([words.take(pa.array(code[begins])), pa.array(own[begins], pa.int64()), pa.array(most), *lists], ["term", "range", "most", "ids", "seqs", "impacts"])
                at = to

    return apply


def build(chunks: DataFrame, path: str, *, k1: float = BM25_K1, b: float = BM25_B, epsilon: float = BM25_EPSILON) -> None:
    """Writes the index of chunks (id, seq, content) to path: what is said of the corpus, its terms, their blocks. A null content
    counts as a chunk without tokens.

    Texts are parted twice, once for what is said of terms, which the impacts need: no table of postings is written, and what moves
    are texts, dealt by ranges, and then blocks."""
    spark = chunks.sparkSession
    n, size = chunks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first()
    terms, terms_path = written(postings(chunks).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf")), "terms")
    n_post, tokens = terms.agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("tf"), F.lit(0))).first()
    buckets = max(LEAST_BUCKETS, min(MOST_BUCKETS, n_post // PER_BUCKET))
    raw = F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    rated = terms.select(_bucket(buckets).alias("bucket"), "term", "df", raw.alias("raw"))
    mean = rated.agg(exact_mean("raw")).first()[0] or 0.0
    shape = chunks.select("id", "seq").schema
    spark.createDataFrame([(buckets, n, epsilon * mean, shape.json())], "buckets int, n long, least_idf double, schema string").coalesce(1).write.mode("overwrite").parquet(f"{path}/{ABOUT}")
    known = rated.select("bucket", "term", "df", F.when(F.col("raw") < 0, F.lit(epsilon * mean)).otherwise(F.col("raw")).alias("idf"))
    known.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{TERMS}")
    least = spark.sparkContext.defaultParallelism if n_post > 100_000 else 1
    place = F.coalesce(F.floor(F.col("seq") / RANGE), F.lit(-1)).cast("long").alias("range")
    dealt = chunks.select("id", "seq", place, "content").repartition(max(least, -(-size // TEXTS)), "range").sortWithinPartitions("range", "seq")
    kinds = {f.name: f.dataType.simpleString() for f in shape.fields}
    lists = f"term string, range long, most double, ids array<{kinds['id']}>, seqs array<{kinds['seq']}>, impacts array<double>"
    blocks = dealt.select("id", "seq", "range", lexical_tokens(F.col("content")).alias("t")).mapInArrow(_cut(tokens / n if tokens else 1.0, k1, b), lists)
    # Slices of ranges part a frequent term's blocks.
    blocks = blocks.withColumns({"bucket": _bucket(buckets), "slice": F.floor(F.col("range") / SLICE)}).repartition(max(least, -(-n_post // PER_BUCKET)), "bucket", "slice")
    blocks = blocks.drop("slice").sortWithinPartitions("bucket", "term", "range").withColumn("block", F.monotonically_increasing_id())
    blocks.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{BLOCKS}")
    discard(spark, terms_path)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = K_LEXICAL, *, is_few: bool | None = None) -> DataFrame:
    """query_id, id, seq, score, rank, as bm25() gives them with the constants that the index was built with. Blocks of the terms asked
    for meet in tiles of ranges, so that a task has all that a chunk's score is made of."""
    about = spark.read.schema("buckets int, n long, least_idf double, schema string").parquet(f"{path}/{ABOUT}").first()
    is_few = few(queries) if is_few is None else is_few
    kinds = {f.name: f.dataType.simpleString() for f in StructType.fromJson(json.loads(about.schema)).fields}
    query = dict(queries.dtypes)["query_id"]
    asked = queries.select("query_id", F.explode(lexical_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    asked, _ = written(asked.withColumn("bucket", _bucket(about.buckets)), "asked")
    own = F.col("bucket").isin([r.bucket for r in asked.select("bucket").distinct().collect()])  # MOST_BUCKETS numbers at most
    terms = spark.read.schema("term string, df long, idf double, bucket int").parquet(f"{path}/{TERMS}").where(own)
    blocks = spark.read.schema(f"block long, term string, range long, most double, ids array<{kinds['id']}>, seqs array<{kinds['seq']}>, impacts array<double>, bucket int").parquet(f"{path}/{BLOCKS}").where(own)
    wanted, _ = written(terms.join(small(asked, is_few), ["bucket", "term"]).select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight")), "wanted")
    tile = F.floor(F.col("range") / TILE).alias("tile")
    blocks = blocks.join(small(wanted.select("term").distinct(), is_few), "term", "left_semi")
    # What each range can add to each query, without the blocks' lists.
    ranges, _ = written(met(blocks.select(tile, "range", "term", "most"), wanted, _promised, f"query_id {query}, range long, most double", most=BROADCAST_ROWS, is_few=is_few), "ranges")

    def scored(chosen: DataFrame) -> DataFrame:
        """The best among all chunks in the ranges that any query has chosen."""
        opened = blocks.join(chosen.select("range").distinct(), "range", "left_semi").select(tile, "term", "ids", "seqs", "impacts")
        return top_k(met(opened, wanted, _scored(k), f"query_id {query}, id {kinds['id']}, seq {kinds['seq']}, score double", most=BROADCAST_ROWS, is_few=is_few), "score", k, "seq")

    first = scored(top_k(ranges, "most", FIRST, "range").select("query_id", "range"))
    reach = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("reach"))
    return scored(worth(ranges, written(reach, "reach")[0]))


def _promised(blocks: pa.Table, asked: Asked) -> pa.Table:
    """(query_id, range, most): what the blocks of each range can add to each query at most."""
    places, row = np.unique(np.asarray(blocks.column("range")), return_inverse=True)
    code, value = asked.codes(blocks.column("term").combine_chunks()), np.asarray(blocks.column("most"))
    kept = np.flatnonzero(code >= 0)
    kept = kept[np.argsort(row[kept], kind="stable")]
    found = [pa.RecordBatch.from_arrays([asked.ids.slice(0, 0), pa.array([], pa.int64()), pa.array([], pa.float64())], ["query_id", "range", "most"])]
    for a, _, most, times in asked.sums(row[kept], code[kept], value[kept], len(places), least=0.0):
        r, q = np.nonzero(times)
        found.append(pa.RecordBatch.from_arrays([asked.ids.take(pa.array(q)), pa.array(places[r + a], pa.int64()), pa.array(most[r, q])], ["query_id", "range", "most"]))
    return pa.Table.from_batches(found)


def _scored(k: int):
    """(query_id, id, seq, score) of the k best chunks of a tile for each query."""

    def apply(blocks: pa.Table, asked: Asked) -> pa.Table:
        lists = {c: blocks.column(c).combine_chunks() for c in ("ids", "seqs", "impacts")}
        code = np.repeat(asked.codes(blocks.column("term").combine_chunks()), np.asarray(pc.list_value_length(lists["ids"])))
        ids, seqs, impact = (x.flatten() for x in lists.values())
        id_, seq = (np.asarray(x.dictionary_encode("encode").indices, np.int64) for x in (ids, seqs))
        _, at, row = np.unique(id_ * (seq.max(initial=0) + 1) + seq, return_index=True, return_inverse=True)
        order = np.argsort(row, kind="stable")
        at = pa.array(at)
        empty = pa.RecordBatch.from_arrays([asked.ids.slice(0, 0), ids.slice(0, 0), seqs.slice(0, 0), pa.array([], pa.float64())], ["query_id", "id", "seq", "score"])
        return pa.Table.from_batches([empty, *asked.hits(ids.take(at), seqs.take(at), row[order], code[order], np.asarray(impact)[order], k)])

    return apply


def worth(ranges: DataFrame, reach: DataFrame) -> DataFrame:
    """query_id, range of the ranges that may hold one of a query's hits: those that promise what the k-th reaches, all if it
    is not known."""
    return ranges.join(reach, "query_id", "left").where(F.col("reach").isNull() | (F.col("most") + MARGIN >= F.col("reach"))).select("query_id", "range")


ship(__name__)
