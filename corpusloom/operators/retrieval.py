"""Hybrid retrieval for many queries at once: BM25, dense search, rank fusion, reranking, neighbours, contexts and prompts.

Chunks have id, seq, source_file, chunk_index, page_title, section_heading, date, author and content. Queries are (query_id,
query). Rankings are (query_id, id, rank) with rank from 0. Ties go by seq everywhere, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.text import let, lexical_tokens, staged
from ..sources.scratch import ship, written
from .inference import BATCH, Model, predict
from .logs import contextual_query
from .scoring import Asked, met
from .tiles import DIGITS, by_length, exact_best, matrix, tiled

K_DENSE, K_LEXICAL, K_RERANK, K_FINAL = 30, 30, 40, 6
RRF_K = 60
CONTEXT_CHARS = 14_000
#: BM25 (Okapi): saturation, length normalisation, and the share of the mean idf that replaces a negative one.
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
#: What comes of the queries is broadcast only if it has at most so many rows; beyond that joins shuffle.
BROADCAST_ROWS = 100_000
#: Tokens that are counted at once, about.
TOKENS = 500_000
#: Where queries are not few, postings of a tile, about.
PART = 1_000_000
#: Fixed: what is put before a query, not before documents, when it is embedded; what stands between the blocks of a context.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
BLOCK_RULE = "\n\n---\n\n"


def few(queries: DataFrame) -> bool:
    """Whether queries, their tokens and their K_RERANK candidates each are at most BROADCAST_ROWS rows; what stems from them
    may then be broadcast. One small job over the queries alone."""
    q = queries.limit(BROADCAST_ROWS // K_RERANK + 1)
    n, tokens = q.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(lexical_tokens(F.col("query")))), F.lit(0))).first()
    return n * K_RERANK <= BROADCAST_ROWS and tokens <= BROADCAST_ROWS


def small(df: DataFrame, is_few: bool) -> DataFrame:
    """df, marked for broadcast if few() has found its size bounded; else the join shuffles, or is as AQE decides."""
    return F.broadcast(df) if is_few else df


# Lexical side -------------------------------------------------------------------------------------------------------


def postings(chunks: DataFrame) -> DataFrame:
    """id, seq, term, tf, len: a row for each term of each chunk. A chunk's tokens are counted where they are."""
    tokens = chunks.select("id", "seq", lexical_tokens(F.col("content")).alias("t"))
    kinds = dict(tokens.dtypes)
    return tokens.mapInArrow(_counted, f"id {kinds['id']}, seq {kinds['seq']}, term string, tf long, len long")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, seq, tokens) to the terms of each row with their counts."""
    for part, own in _pieces(batches):
        row, code, words, tf = counted(part.column(2), own)
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), words.take(pa.array(code)), pa.array(tf, pa.int64()), pa.array(own[row], pa.int64())], ["id", "seq", "term", "tf", "len"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(id, seq, tokens) in pieces of TOKENS tokens, and a row at least, with the rows' numbers of tokens."""
    for batch in batches:
        sizes = np.asarray(pc.list_value_length(batch.column(2)).fill_null(0), np.int64)
        total = np.concatenate([[0], np.cumsum(sizes)])
        a = 0
        while a < len(sizes):
            b = max(a + 1, int(np.searchsorted(total, total[a] + TOKENS, "right")) - 1)
            yield batch.slice(a, b - a), sizes[a:b]
            a = b


def counted(tokens: pa.ListArray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Rows, places of terms, all terms, and how often each term is in each row; rows in order."""
    coded = tokens.flatten().dictionary_encode()
    n = max(1, len(coded.dictionary))
    seen, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n + np.asarray(coded.indices, np.int64), return_counts=True)
    return seen // n, seen % n, coded.dictionary, tf


def lexical_index(chunks: DataFrame) -> DataFrame:
    """id, seq, len, terms, tfs: the terms of each chunk with their counts in its row, as a table of its own. A text is parted once,
    whatever is then asked. bm25() and search() take it as index."""
    tokens = chunks.select("id", "seq", lexical_tokens(F.col("content")).alias("t"))
    kinds = dict(tokens.dtypes)
    return written(tokens.mapInArrow(_listed, f"id {kinds['id']}, seq {kinds['seq']}, len long, terms array<string>, tfs array<long>"), "terms-of-chunks")[0]


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _counted, a row for each chunk."""
    for part, own in _pieces(batches):
        row, code, words, tf = counted(part.column(2), own)
        at = pa.array(np.searchsorted(row, np.arange(len(own) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(at, x) for x in (words.take(pa.array(code)), pa.array(tf, pa.int64()))]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own), *lists], ["id", "seq", "len", "terms", "tfs"])


def term_stats(index: DataFrame) -> DataFrame:
    """term, df: in how many chunks each term is."""
    return index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """One row: n chunks and avgdl, their mean number of tokens. No text is read: chunks are counted, tokens summed from index."""
    n = chunks.agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(index.agg(F.coalesce(F.sum("len"), F.lit(0)).alias("tokens"))).select("n", F.try_divide("tokens", "n").alias("avgdl"))  # two single rows


def exact_mean(c: str) -> Column:
    """The mean of a double column, null without rows. Decimals are added, so no order of rows changes it."""
    return F.try_divide(F.sum(F.col(c).cast("decimal(38, 18)")).cast("double"), F.count(c))


def idf(terms: DataFrame, stats: DataFrame, epsilon: float = BM25_EPSILON) -> DataFrame:
    """term, df, idf; a negative idf becomes epsilon times the mean of all."""
    raw = terms.crossJoin(F.broadcast(stats)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # stats is one row
    mean = raw.agg(exact_mean("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def top_k(scored: DataFrame, score: str, k: int, *ties: str) -> DataFrame:
    """The k best rows of each query with rank from 0; Spark cuts to k before it shuffles."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), *ties)
    return scored.withColumn("rank", (F.row_number().over(w) - 1).cast("long")).where(F.col("rank") < k)


def bm25(chunks: DataFrame, queries: DataFrame, k: int = K_LEXICAL, *, k1: float = BM25_K1, b: float = BM25_B, epsilon: float = BM25_EPSILON, index: DataFrame | None = None, is_few: bool = False) -> DataFrame:
    """query_id, id, seq, score, rank: the k best chunks of each query, those with a positive score. A term that a query
    repeats counts each time. index: lexical_index() of the chunks, to spare counting anew.

    A chunk is scored in its row, against all queries. If few() says so, each batch of chunks meets what all queries ask for and passes
    on a query's k best; else chunks and queries meet in tiles, as many as they ask for."""
    index = lexical_index(chunks) if index is None else index
    asked = queries.select("query_id", F.explode(lexical_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    stats = corpus_stats(chunks, index)
    weights = idf(term_stats(index), stats, epsilon)
    wanted, _ = written(asked.join(weights, "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight")), "wanted")
    kinds = dict([*queries.select("query_id").dtypes, *index.dtypes])
    shape = f"query_id {kinds['query_id']}, id {kinds['id']}, seq {kinds['seq']}, score double"
    n_post, avgdl = index.crossJoin(F.broadcast(stats)).agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)), F.max("avgdl")).first()
    how = _scored(k, avgdl or 1.0, k1, b)
    rows = index.select("id", "seq", "len", "terms", "tfs")
    if is_few:
        known = Asked.of(wanted.toArrow())
        scored = rows.mapInArrow(lambda batches: (found for batch in batches for found in how(batch, known)), shape)
    else:
        tiles = max(1, -(-n_post // PART))
        dealt = rows.withColumn("tile", F.pmod(F.xxhash64("id", "seq"), F.lit(tiles)))
        scored = met(dealt, wanted, lambda table, q: pa.Table.from_batches(x for batch in table.combine_chunks().to_batches() for x in how(batch, q)), shape, most=BROADCAST_ROWS, is_few=False)
    return top_k(scored, "score", k, "seq")


def _scored(k: int, avgdl: float, k1: float, b: float):
    """(query_id, id, seq, score) of the k best of some chunks for each query."""

    def apply(rows: pa.RecordBatch, asked: Asked) -> Iterator[pa.RecordBatch]:
        ids, seqs, length, terms, tfs = (rows.column(c) for c in ("id", "seq", "len", "terms", "tfs"))
        row = np.repeat(np.arange(len(rows)), np.asarray(pc.list_value_length(terms)))
        tf = np.asarray(tfs.flatten(), np.float64)
        impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * np.asarray(length)[row] / avgdl))
        return asked.hits(ids, seqs, row, asked.codes(terms.flatten()), impact, k)

    return apply


# Dense side ---------------------------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def dense(vectors: DataFrame, queries: DataFrame, k: int = K_DENSE, where: Column | None = None, is_few: bool = False) -> DataFrame:
    """query_id, id, seq, score, rank: the k vectors (id, seq, embedding) nearest to each query (query_id, embedding) by cosine.

    Every vector is scored, in matrix products. If few() says so, the queries are one matrix that each batch of vectors is
    multiplied with, and a batch passes on a query's k best. Else vectors and queries meet in tiles, as many as they ask for.
    """
    rows = (vectors if where is None else vectors.where(where)).select("id", "seq", "embedding")
    q = queries.select("query_id", "embedding")
    if is_few:
        shape = StructType([q.schema["query_id"], *(StructField(f.name, f.dataType) for f in rows.schema.fields[:2])]).add("score", "double")
        return top_k(rows.mapInArrow(_multiplied(q.toArrow(), k), shape), "score", k, "seq")
    # All rows and queries are one cell, whose tiles share the work out.
    (dim,) = rows.agg(F.max(F.size("embedding"))).first()
    kinds = {f.name: f.dataType.simpleString() for f in [*q.schema.fields, *rows.schema.fields]}
    one = F.lit(0).alias("cell")
    scored = tiled(rows.select(one, "*"), q.select(one, "*"), _tile(k), f"query_id {kinds['query_id']}, id {kinds['id']}, seq {kinds['seq']}, score double", 8 * (dim or 1), 8 * (dim or 1))
    return top_k(scored, "score", k, "seq")


def _asked(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    return {n: (at, matrix(vectors.take(pa.array(at)))) for n, at in by_length(vectors).items()}


def _multiplied(queries: pa.Table, k: int):
    """From batches of (id, seq, embedding): (query_id, id, seq, score) of the k best of each query in each batch."""
    ids, asked = queries.column(0).combine_chunks(), _asked(queries.column(1).combine_chunks())

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from exact_best(ids, asked, batch, k)

    return apply


def _tile(k: int):
    """The k best of each query of a tile."""

    def apply(rows: pa.Table, queries: pa.Table) -> pa.Table:
        shape = pa.schema([("query_id", queries.schema.field("query_id").type), ("id", rows.schema.field("id").type), ("seq", rows.schema.field("seq").type), ("score", pa.float64())])
        asked = _asked(queries.column("embedding").combine_chunks()) if len(queries) else {}
        found = exact_best(queries.column("query_id").combine_chunks(), asked, rows.select(["id", "seq", "embedding"]), k) if asked and len(rows) else []
        made = pa.Table.from_batches(found, shape) if found else shape.empty_table()
        if len(found) < 2:
            return made
        # Of several batches' best, those of the tile.
        order = pc.sort_indices(made, [("query_id", "ascending"), ("score", "descending"), ("seq", "ascending")])
        made = made.take(order)
        same = made.column("query_id").combine_chunks().dictionary_encode().indices.to_numpy()
        return made.filter(pa.array(np.arange(len(same)) - np.searchsorted(same, same) < k))

    return apply


def hash_embed(text: Column, dim: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: signed counts of hashed lexical tokens, at length one. The hash is the
    first eight digits of MD5; its lowest bit is the sign."""
    hashed = F.transform(lexical_tokens(text), lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"))
    signed = lambda h: F.when(F.pmod(h, F.lit(2)) == 0, 1.0).otherwise(-1.0)
    cell = lambda hs, i: F.aggregate(F.filter(hs, lambda h: F.pmod(F.shiftright(h, 1), F.lit(dim)) == i), F.lit(0.0), lambda acc, h: acc + signed(h))
    raw = let(hashed, lambda hs: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: cell(hs, i)))
    return let(raw, lambda v: let(F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12)), lambda n: F.transform(v, lambda x: x / n)))


# Fusion, reranking, neighbours --------------------------------------------------------------------------------------


def rrf(*rankings: DataFrame, k: int = RRF_K, top: int | None = None) -> DataFrame:
    """query_id, id, score, rank of rankings fused by reciprocal ranks; ties in the order in which the rankings, first to last,
    first name them."""
    named = [r.select("query_id", "id", (F.lit(1.0) / (F.lit(k) + F.col("rank") + 1)).alias("part"), F.struct(F.lit(i).alias("list"), F.col("rank").alias("at")).alias("first")) for i, r in enumerate(rankings)]
    # Rankings may each be dealt by query_id, and Spark 4.1 then takes their union as dealt so too, though AQE may have coalesced each
    # in its own way: a chunk that two rankings name would come out twice. An exchange by other keys, which is not taken for one that
    # is there already, keeps groups whole.
    fused = reduce(DataFrame.unionByName, named).repartition("id", "query_id").groupBy("query_id", "id").agg(F.round(F.sum("part"), DIGITS).alias("score"), F.min("first").alias("first"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "first")
    out = fused.withColumn("rank", (F.row_number().over(w) - 1).cast("long")).drop("first")
    return out if top is None else out.where(F.col("rank") < top)


def overlap_score(query: Column, content: Column) -> Column:
    """The default scorer: the share of a query's distinct tokens that a text has, plus a little for how dense they are."""
    q, d = F.array_distinct(lexical_tokens(query)), lexical_tokens(content)
    both = F.array_intersect(q, d)
    return F.size(both) / F.greatest(F.size(q), F.lit(1)) + F.size(both) / (F.size(d) + 1000.0)


def rerank(candidates: DataFrame, chunks: DataFrame, queries: DataFrame, k: int = K_FINAL, scorer: Callable[[Column, Column], Column] = overlap_score, is_few: bool = False) -> DataFrame:
    """query_id, id, score, rank: the k best candidates by scorer(query, content), a Column function or a pandas UDF; ties keep
    the candidates' order. Candidates that are no chunks fall out."""
    pairs = chunks.select("id", "content").join(small(candidates.select("query_id", "id", F.col("rank").alias("was")), is_few), "id").join(small(queries.select("query_id", "query"), is_few), "query_id")
    scored = pairs.select("query_id", "id", "was", scorer(F.col("query"), F.col("content")).cast("double").alias("score"))
    return top_k(scored, "score", k, "was").select("query_id", "id", "score", "rank")


def rerank_with(candidates: DataFrame, chunks: DataFrame, queries: DataFrame, make: Callable[[], Model], k: int = K_FINAL, *, key: str, is_few: bool = False, batch: int = BATCH) -> DataFrame:
    """rerank() by a model that scores (query, content) pairs in batches, loaded once a worker; see inference.predict()."""
    pairs = chunks.select("id", "content").join(small(candidates.select("query_id", "id", F.col("rank").alias("was")), is_few), "id").join(small(queries.select("query_id", "query"), is_few), "query_id")
    scored = predict(pairs, make, ["query", "content"], "score", "double", key=key, batch=batch).select("query_id", "id", "was", "score")
    return top_k(scored, "score", k, "was").select("query_id", "id", "score", "rank")


def neighbours(chunks: DataFrame, hits: DataFrame, is_few: bool = False) -> DataFrame:
    """query_id, rank, side (-1 or 1), id, content of the chunks next to each hit: one place away in seq and in chunk_index, in
    the same document."""
    if {"prev_id", "next_id"} <= {*chunks.columns}:  # kept with the chunks: two lookups by id
        own = chunks.select("id", "prev_id", "next_id").join(small(hits.select("query_id", "id", "rank"), is_few), "id")
        sides = own.select("query_id", "rank", F.explode(F.array(F.struct(F.lit(-1).alias("side"), F.col("prev_id").alias("id")), F.struct(F.lit(1).alias("side"), F.col("next_id").alias("id")))).alias("s"))
        wanted = sides.select("query_id", "rank", "s.side", "s.id").where("id is not null")
        return chunks.select("id", "content").join(small(wanted, is_few), "id").select("query_id", "rank", "side", "id", "content")
    meta = chunks.select("id", "seq", "source_file", "chunk_index")
    at = meta.join(small(hits.select("query_id", "id", "rank"), is_few), "id")
    sides = at.select("query_id", "rank", "source_file", "chunk_index", "seq", F.explode(F.array(F.lit(-1), F.lit(1))).alias("side"))
    wanted = sides.select("query_id", "rank", "side", (F.col("seq") + F.col("side")).alias("seq"), F.col("source_file").alias("own_file"), F.col("chunk_index").alias("own_index"))
    near = chunks.select("id", "seq", "source_file", "chunk_index", "content").join(small(wanted, is_few), "seq")
    near = near.where(F.col("source_file").eqNullSafe(F.col("own_file")) & (F.abs(F.col("chunk_index") - F.col("own_index")) == 1))
    return near.select("query_id", "rank", "side", "id", "content")


def expand(chunks: DataFrame, hits: DataFrame, is_few: bool = False) -> DataFrame:
    """query_id, rank, id, score, text and the chunk's page data: hits with their neighbours' texts.

    A neighbour is spliced in once a query, by the best hit that has it, and not if it is itself a better hit; a hit's own text
    is never left out. A lone next neighbour stands before the text: the first part that is there always does.
    """
    edges = neighbours(chunks, hits, is_few)
    first = Window.partitionBy("query_id", "id").orderBy("rank", "side")
    claimed = edges.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    better = hits.select(F.col("query_id").alias("hq"), F.col("id").alias("hid"), F.col("rank").alias("hrank"))
    claimed = claimed.join(better, (F.col("query_id") == F.col("hq")) & (F.col("id") == F.col("hid")) & (F.col("hrank") < F.col("rank")), "left_anti")
    parts = claimed.groupBy("query_id", "rank").agg(F.transform(F.sort_array(F.collect_list(F.struct("side", "content"))), lambda x: x["content"]).alias("parts"))  # two at most
    own = chunks.join(small(hits.select("query_id", "id", "rank", "score"), is_few), "id")
    both = own.join(parts, ["query_id", "rank"], "left")
    text = F.when(F.size("parts") == 2, F.concat_ws("\n", F.col("parts")[0], "content", F.col("parts")[1])).when(F.size("parts") == 1, F.concat_ws("\n", F.col("parts")[0], "content")).otherwise(F.col("content"))
    return both.select("query_id", "rank", "id", "score", text.alias("text"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("page_title", "section_heading", "source_file", "date", "author")))


def search(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = K_FINAL, *, where: Column | None = None, expanded: bool = True, scorer: Callable[[Column, Column], Column] = overlap_score, index: DataFrame | None = None, rankings: tuple[DataFrame, ...] = ()) -> DataFrame:
    """The hits of each query (query_id, query, embedding), best first by rank. where filters the dense side alone. rankings, if
    there are any, stand for those of dense() and bm25(): vector_index.nearest() and lexical_index.search() make them from what is
    kept."""
    if not 1 <= k <= 20:
        raise ValueError("k is from 1 to 20")
    is_few = few(queries)
    fused = rrf(*(rankings or (dense(vectors, queries, where=where, is_few=is_few), bm25(chunks, queries, index=index, is_few=is_few))), top=K_RERANK)
    hits = rerank(fused, chunks, queries, k, scorer, is_few)
    if expanded:
        return expand(chunks, hits, is_few)
    own = chunks.join(small(hits, is_few), "id")
    return own.select("query_id", "rank", "id", "score", F.col("content").alias("text"), *(F.coalesce(c, F.lit("")).alias(c) for c in ("page_title", "section_heading", "source_file", "date", "author")))


def with_history(queries: DataFrame, embed: Callable[[Column], Column] = hash_embed) -> DataFrame:
    """query_id, query, embedding from (query_id, query, history): what search() is asked in a conversation. The query follows the
    last messages of its history, and that text is embedded, after QUERY_PREFIX, and searched for."""
    asked = staged(queries.select("query_id", "query", "history"), query=contextual_query(F.col("query"), F.col("history")))
    return asked.select("query_id", "query", embed(F.concat(F.lit(QUERY_PREFIX), F.col("query"))).alias("embedding"))


# Contexts and prompts -----------------------------------------------------------------------------------------------


def block(n: Column) -> Column:
    """A hit's block in a context: a numbered header and the text."""
    heading = F.when(F.col("section_heading") != "", F.concat(F.lit(" - "), F.col("section_heading"))).otherwise("")
    date = F.when(F.col("date") != "", F.concat(F.lit(" (last modified "), F.col("date"), F.lit(")"))).otherwise("")
    return F.concat(F.lit("["), n.cast("string"), F.lit("] "), F.col("page_title"), heading, date, F.lit("\n"), F.col("text"))


def build_context(hits: DataFrame, budget: int = CONTEXT_CHARS) -> DataFrame:
    """query_id, context, sources: blocks of the best hits up to the first that would pass the budget, rules between them."""
    sized = hits.withColumn("block", block(F.col("rank") + 1))
    used = F.sum(F.length("block")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    source = F.struct("id", "page_title", "section_heading", "source_file", "date", "score")
    kept = F.when(F.col("used") <= budget, F.struct("rank", "block", source.alias("source")))
    every = F.sort_array(F.collect_list(kept))  # at most k of a query
    out = sized.withColumn("used", used).groupBy("query_id").agg(every.alias("b"))
    return out.select("query_id", F.array_join(F.transform("b", lambda x: x["block"]), BLOCK_RULE).alias("context"), F.transform("b", lambda x: x["source"]).alias("sources"))


def prompts(contexts: DataFrame, queries: DataFrame, system: str, *, temperature: float = 0.2, max_tokens: int = 1024, stream: bool = True) -> DataFrame:
    """query_id, messages, temperature, max_tokens, stream: what a chat model is asked for each query with a context. system is
    what the model is told first; it belongs to whoever runs the service."""
    if not (0 <= temperature <= 2 and 1 <= max_tokens <= 4096):
        raise ValueError("temperature is from 0 to 2, max_tokens from 1 to 4096")
    asked = F.concat(F.lit("Sources:\n\n"), F.col("context"), F.lit("\n\nQuestion: "), F.col("query"))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    rows = contexts.join(queries.select("query_id", "query"), "query_id")
    return rows.select("query_id", F.array(message("system", F.lit(system)), message("user", asked)).alias("messages"), F.lit(temperature).alias("temperature"), F.lit(max_tokens).alias("max_tokens"), F.lit(stream).alias("stream"))


def answer(prompted: DataFrame, model: Callable[[Column], Column]) -> DataFrame:
    """prompted with answer, from model(messages): a pandas UDF that calls a service, or any Column function."""
    return prompted.withColumn("answer", model(F.col("messages")))


def health(chunks: DataFrame, reachable: bool = False) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("chunks")).withColumn("llm_reachable", F.lit(reachable))


ship(__name__)
