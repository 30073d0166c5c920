"""The registered queries over the test tables; oracles.py has the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean, convert, split
from ..functions.text import estimate_tokens, lexical_tokens, n_words, staged
from ..operators import chunking, conversion, lexical_index, logs, retrieval, vector_index
from ..sources import chunk_table, files, vector_store
from ..sources.page_files import read_pages, write_pages
from ..sources.files import pending, upsert_vectors, vector_records
from ..sources.scratch import new_path
from ..streaming import conversations
from .oracles import ORACLES
from .tables import MIXED, QUERY, chunks, derived, markdown, questions, table, vectors, wiki

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def tok_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("n_chars"), n_words(F.col("text")).alias("n_words"), estimate_tokens(F.col("text")).alias("est_tokens"))


@query
def tok_lexical(spark, d):
    return table(spark, d, "documents").select(F.explode(lexical_tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query
def clean_pages(spark, d):
    return table(spark, d, "pages").select("page_id", clean.clean_text(F.col("html")).alias("cleaned"))


def mixed(spark, d) -> DataFrame:
    rows = staged(derived(spark, d, "documents", "doc_id", f"{MIXED} AS raw"), cleaned=clean.clean_text(F.col("raw")))
    return staged(rows, plain=clean.plain_text(F.col("cleaned")))


@query
def text_content(spark, d):
    return mixed(spark, d).select("doc_id", "plain", F.length("plain").cast("long").alias("n_chars"))


@query
def filter_docs(spark, d):
    return mixed(spark, d).select("doc_id", clean.filter_reason(F.col("raw"), F.col("plain")).alias("reason"))


@query
def filter_reasons(spark, d):
    return chunking.filter_reasons(filter_docs(spark, d))


@query
def content_type(spark, d):
    return chunking.content_types(mixed(spark, d).select(clean.content_type(F.col("cleaned"), F.col("plain")).alias("content_type")))


@query
def split_headings(spark, d):
    rows = markdown(spark, d).select("doc_id", F.posexplode(split.split_by_headings(F.col("text"))).alias("pos", "s"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "s.heading", "s.content")


def sized(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(estimate_tokens(F.col("text")).alias("estimated_tokens"))


@query
def size_stats(spark, d):
    return chunking.size_stats(sized(spark, d))


@query
def size_histogram(spark, d):
    return chunking.size_histogram(sized(spark, d))


@query
def largest_doc(spark, d):
    return chunking.largest_document(table(spark, d, "documents").select(F.col("source").alias("source_file")))


@query
def signature(spark, d):
    rows = markdown(spark, d).select("doc_id", clean.signature(F.col("text")).alias("s"), clean.without_signatures(F.col("text")).alias("rest"))
    return rows.select("doc_id", "s.author", "s.date", "rest")


def phase(how: Callable[[Column], Column]) -> Query:
    return lambda spark, d: wiki(spark, d).select("doc_id", how(F.col("text")).alias("text"))


QUERIES |= {f"convert_{name}": phase(how) for name, how in (convert.PHASES | {"rules": convert.rules, "cleanup": convert.cleanup, "extract_verbatim": convert.extract_verbatim}).items()}


@query
def convert_full(spark, d):
    return convert.convert(wiki(spark, d)).select("doc_id", "markdown")


@query
def validate_status(spark, d):
    return convert_full(spark, d).select("doc_id", convert.status(convert.validate(F.col("markdown"))).alias("status"))


@query
def status_counts(spark, d):
    return conversion.status_counts(validate_status(spark, d))


@query
def applied_rules(spark, d):
    return conversion.rule_counts(conversion.convert_all(wiki(spark, d)))


@query
def conversion_summary(spark, d):
    return conversion.summary(conversion.convert_all(wiki(spark, d)))


def prepared(spark, d) -> DataFrame:
    return chunking.prepare(markdown(spark, d))


@query
def chunk_documents(spark, d):
    return chunking.chunk(prepared(spark, d))


@query
def chunk_ids(spark, d):
    return chunking.with_ids(chunking.chunk(prepared(spark, d))).select("id", "seq", "source_file", "chunk_index")


@query
def chunk_issues(spark, d):
    p = chunking.held(prepared(spark, d))
    return chunking.issues(p, chunking.chunk(p))


@query
def file_summary(spark, d):
    p = chunking.held(prepared(spark, d))
    return chunking.file_summary(p, chunking.chunk(p))


@query
def corpus_counts(spark, d):
    p = chunking.held(prepared(spark, d))
    return chunking.corpus_counts(p, chunking.chunk(p))


@query
def split_qa(spark, d):
    rows = derived(spark, d, "documents", "doc_id", f"{MIXED} AS text").select("doc_id", F.posexplode(split.split_qa(F.col("text"))).alias("pos", "s"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "s.heading", "s.content")


@query
def split_paragraphs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(split.split_paragraphs(F.col("text"))).alias("pos", "content")).select("doc_id", F.col("pos").cast("long").alias("pos"), "content")


@query
def split_overlap(spark, d):
    """The lines of each document, each led by the last words of the one before."""
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.struct(F.lit("").alias("heading"), x.alias("content")))
    return table(spark, d, "documents").select("doc_id", F.posexplode(split.add_overlap(lines)).alias("pos", "s")).select("doc_id", F.col("pos").cast("long").alias("pos"), "s.content")


@query
def split_hard_cap(spark, d):
    whole = F.array(F.struct(F.col("source").alias("heading"), F.col("text").alias("content")))
    return table(spark, d, "documents").select("doc_id", F.posexplode(split.hard_cap(whole)).alias("pos", "s")).select("doc_id", F.col("pos").cast("long").alias("pos"), "s.heading", "s.content")


@query
def chunk_sizes(spark, d):
    return chunk_documents(spark, d).groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), F.min("estimated_tokens").alias("least"), F.max("estimated_tokens").alias("most"))


@query
def bm25_stats(spark, d):
    c = chunks(spark, d)
    post = retrieval.lexical_index(c)
    w = retrieval.idf(retrieval.term_stats(post), retrieval.corpus_stats(c, post))
    return w.select("term", "df", F.round("idf", 6).alias("idf"))


def ranking(rows: DataFrame, digits: int = 5) -> DataFrame:
    return rows.select("query_id", "id", "rank", F.round("score", digits).alias("score"))


@query
def bm25_topk(spark, d):
    q = questions(spark, d)
    return ranking(retrieval.bm25(chunks(spark, d), q, is_few=retrieval.few(q)))


@query
def bm25_blocks(spark, d):
    """By the kept index with block maxima."""
    path = new_path(spark, "lexical-index")
    lexical_index.build(chunks(spark, d), path)
    return ranking(lexical_index.search(spark, path, questions(spark, d)))


@query
def bm25_large(spark, d):
    """As for a set of queries that is not few: chunks and queries meet in tiles."""
    c = chunks(spark, d)
    return ranking(retrieval.bm25(c, questions(spark, d), index=retrieval.lexical_index(c)))


@query
def dense_topk(spark, d):
    q = questions(spark, d)
    return ranking(retrieval.dense(vectors(spark, d), q, is_few=retrieval.few(q)))


@query
def dense_large(spark, d):
    """As for a set of queries that is not few."""
    return ranking(retrieval.dense(vectors(spark, d), questions(spark, d)))


def indexed(spark, d, **how) -> str:
    """The path of an index of the vectors, in the shared folder."""
    path = new_path(spark, "vector-index")
    vector_index.build(vectors(spark, d), path, **how)
    return path


@query
def ann_topk(spark, d):
    """By the index, with as many cells probed as it says."""
    q = questions(spark, d)
    return ranking(vector_index.nearest(spark, indexed(spark, d), q, is_few=retrieval.few(q)))


@query
def ann_all_cells(spark, d):
    """By the index with all cells probed: what the bounds of the codes leave out is not among the best."""
    q = questions(spark, d)
    return ranking(vector_index.nearest(spark, indexed(spark, d), q, probes=vector_index.MOST_CELLS, is_few=retrieval.few(q)))


@query
def ann_filtered(spark, d):
    """As all cells, for queries that are not few, with a filter by a column that the index keeps."""
    path = indexed(spark, d, cells=5, keep=("label",))
    return ranking(vector_index.nearest(spark, path, questions(spark, d), probes=5, where=F.col("label") == 3, is_few=False))


@query
def dense_filtered(spark, d):
    q = questions(spark, d)
    return ranking(retrieval.dense(vectors(spark, d), q, where=F.col("label") == 3, is_few=retrieval.few(q)))


def fused(spark, d) -> DataFrame:
    q = questions(spark, d)
    is_few = retrieval.few(q)
    return retrieval.rrf(retrieval.dense(vectors(spark, d), q, is_few=is_few), retrieval.bm25(chunks(spark, d), q, is_few=is_few), top=retrieval.K_RERANK)


@query
def rrf(spark, d):
    return ranking(fused(spark, d), 8)


def reranked(spark, d) -> DataFrame:
    q = questions(spark, d)
    return retrieval.rerank(fused(spark, d), chunks(spark, d), q, is_few=retrieval.few(q))


@query
def rerank_topk(spark, d):
    return ranking(reranked(spark, d), 8)


@query
def neighbours(spark, d):
    return retrieval.neighbours(chunks(spark, d), reranked(spark, d)).select("query_id", "rank", F.col("side").cast("long").alias("side"), "id")


def kept_chunks(spark, d) -> DataFrame:
    """The chunks as a table in buckets."""
    path = new_path(spark, "chunks")
    name = "chunks_" + path.rpartition("-")[2]
    chunk_table.write(chunks(spark, d), name, path, 16)
    return chunk_table.read(spark, name)


@query
def neighbours_table(spark, d):
    """As neighbours, by the ids that the table keeps, for queries that are not few."""
    return retrieval.neighbours(kept_chunks(spark, d), reranked(spark, d)).select("query_id", "rank", F.col("side").cast("long").alias("side"), "id")


def hits(spark, d) -> DataFrame:
    return retrieval.search(chunks(spark, d), vectors(spark, d), questions(spark, d))


@query
def hybrid_search(spark, d):
    return hits(spark, d).withColumn("score", F.round("score", 8))


@query
def hybrid_indexed(spark, d):
    """The hybrid search by the two kept indexes, all cells probed."""
    path, q = new_path(spark, "lexical-index"), questions(spark, d)
    lexical_index.build(chunks(spark, d), path)
    is_few = retrieval.few(q)
    near = vector_index.nearest(spark, indexed(spark, d), q, probes=vector_index.MOST_CELLS, is_few=is_few)
    found = retrieval.search(chunks(spark, d), vectors(spark, d), q, rankings=(near, lexical_index.search(spark, path, q, is_few=is_few)))
    return found.withColumn("score", F.round("score", 8))


@query
def context(spark, d):
    return retrieval.build_context(hits(spark, d)).select("query_id", "context", F.size("sources").cast("long").alias("n_sources"))


@query
def prompt(spark, d):
    q = questions(spark, d)
    p = retrieval.prompts(retrieval.build_context(hits(spark, d)), q, "Answer from the sources.")
    return p.select("query_id", F.col("messages")[1]["content"].alias("prompt"))


@query
def hash_embedding(spark, d):
    return table(spark, d, "benchmark").select("item_id", retrieval.hash_embed(F.concat(F.lit(retrieval.QUERY_PREFIX), F.col("text"))).alias("embedding"))


@query
def contextual_query(spark, d):
    c = logs.conversations(table(spark, d, "conversations"))
    return c.select("conv_id", logs.contextual_query(F.lit("what now"), F.col("messages")).alias("query"))


@query
def search_with_history(spark, d):
    """The benchmark's items, asked after the conversations of equal numbers."""
    c = logs.conversations(table(spark, d, "conversations")).select(F.col("conv_id").alias("query_id"), F.col("messages").alias("history"))
    q = retrieval.with_history(derived(spark, d, "benchmark", *QUERY).join(c, "query_id", "left"))
    found = retrieval.search(chunks(spark, d), vectors(spark, d), q, expanded=False)
    return found.select("query_id", "rank", "id", F.round("score", 8).alias("score"))


@query
def last_messages(spark, d):
    """When the turns of a conversation were said, as a listing shows it; numbers stand in for seconds."""
    rows = derived(spark, d, "conversations", "conv_id", "turn", "timestamp_seconds(1700000000 - turn * turn * 700) AS then")
    return rows.select("conv_id", "turn", logs.relative_time(F.expr("timestamp_seconds(1700000000)"), F.col("then")).alias("shown"))


@query
def conv_order(spark, d):
    """Conversations by the time of their last change, newest first."""
    rows = derived(spark, d, "events", "user_id AS conversation_id", "ts AS updated_at").groupBy("conversation_id").agg(F.max("updated_at").alias("updated_at"))
    return logs.ranked_by_time(rows).select("conversation_id", "place")


@query
def conv_title(spark, d):
    return logs.conversations(table(spark, d, "conversations")).select("conv_id", "title", "message_count")


def log(spark, d) -> DataFrame:
    return derived(spark, d, "events", "event_id AS seq", "user_id AS conversation_id", "event_type AS title", "value")


@query
def conv_latest(spark, d):
    return logs.latest(log(spark, d), "conversation_id")


@query
def conv_first(spark, d):
    return logs.earliest(log(spark, d), "conversation_id")


@query
def conv_upsert(spark, d):
    rows = log(spark, d)
    return logs.upsert(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1"), "conversation_id")


@query
def conv_delete(spark, d):
    rows = log(spark, d)
    return logs.delete(rows, rows.where("title = 'error' and conversation_id % 3 = 0"), "conversation_id")


def rated(spark, d) -> DataFrame:
    return derived(spark, d, "events", "event_id AS seq", "CASE event_type WHEN 'purchase' THEN 'up' WHEN 'error' THEN 'down' ELSE '' END AS rating")


@query
def feedback_stats(spark, d):
    return logs.feedback_stats(rated(spark, d))


@query
def feedback_recent(spark, d):
    return logs.recent(rated(spark, d))


@query
def length_batches(spark, d):
    return files.length_batches(chunks(spark, d)).select("id", "batch")


@query
def embed_resume(spark, d):
    c = chunks(spark, d).withColumns({"embedding": F.array(F.lit(0.5)), "total_chunks": F.lit(4), "content_type": F.lit("technical"), "char_count": F.length("content"), "estimated_tokens": estimate_tokens(F.col("content"))})
    first = vector_records(c.where("seq % 3 = 0"))
    done = upsert_vectors(first, vector_records(pending(c, first)))
    return done.select("id", F.length("document").cast("long").alias("n_chars"), F.col("metadata.chunk_index").alias("chunk_index"))


@query
def vector_upserts(spark, d):
    """A store of the chunks after three upserts: some chunks, all with other texts, and, late, an older version of some."""
    c = chunks(spark, d).withColumns({"id": F.concat_ws("#", "source_file", F.col("chunk_index").cast("string")), "embedding": F.array(F.lit(0.5)), "total_chunks": F.lit(4), "content_type": F.lit("technical"), "char_count": F.length("content"), "estimated_tokens": estimate_tokens(F.col("content"))})
    path = new_path(spark, "vector-store")
    for some, version in (("seq % 3 = 0", 1), ("seq % 3 <> 1", 3), ("seq % 2 = 0", 2)):
        rows = c.where(some).withColumn("content", F.concat(F.lit(f"{version} "), F.col("content")))
        vector_store.upsert(vector_records(rows), path, version, buckets=64)
    return vector_store.read(spark, path).select("id", "version", F.length("document").cast("long").alias("n_chars"), F.col("metadata.chunk_index").alias("chunk_index"))


@query
def conv_streamed(spark, d):
    """The latest entries after a stream of the log in three batches, with deletions in the last: of every fifth conversation."""
    rows, source = log(spark, d), new_path(spark, "log")
    (top,) = rows.agg(F.max("seq")).first()
    no = F.lit(False)
    for part in range(3):
        some = rows.where(F.least(F.floor(F.col("seq") * 3 / (top + 1)), F.lit(2)) == part).withColumn("deleted", no)
        if part == 2:
            gone = rows.where("conversation_id % 5 = 0").groupBy("conversation_id").agg(F.first("title").alias("title"), F.first("value").alias("value"))
            some = some.unionByName(gone.withColumns({"seq": F.lit(top + 1).cast("long"), "deleted": F.lit(True)}))
        some.coalesce(1).write.mode("append").parquet(source)
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    target = new_path(spark, "conversations")
    conversations.keep_latest(spark, source, target, new_path(spark, "marks"), shape, "conversation_id", files=1)
    return conversations.latest(spark, target, shape)


@query
def conversion_observed(spark, d):
    """The summary of a conversion, from the job that writes it."""
    got = conversion.write_observed(wiki(spark, d), new_path(spark, "converted"))
    kinds = "total long, success long, warning long, error long, exception long, success_rate double"
    return spark.createDataFrame([tuple(got[k.split()[0]] for k in kinds.split(", "))], kinds)


@query
def page_files(spark, d):
    """Converted pages as text files in folders, read back."""
    path = new_path(spark, "pages")
    named = convert_full(spark, d).select(F.concat(F.lit("web"), (F.col("doc_id") % 7).cast("string"), F.lit("/page"), F.col("doc_id").cast("string"), F.lit(".md")).alias("name"), "markdown")
    write_pages(named, path)
    back = read_pages(spark, path)
    return back.select(F.regexp_extract("name", "^(web[0-9]+)/[^/]*$", 1).alias("folder"), F.regexp_extract("name", r"([^/]*)\.md$", 1).alias("stem"), F.col("text").alias("markdown"))


@query
def failed_documents(spark, d):
    return conversion.not_successful(validate_status(spark, d))


@query
def conversion_sheet(spark, d):
    return conversion.file_report(conversion.convert_all(wiki(spark, d))).select("doc_id", "status", "input_kb", "output_kb")


@query
def largest_file(spark, d):
    """The document with most chunks."""
    return chunking.largest_document(chunk_documents(spark, d))


@query
def chunk_previews(spark, d):
    return chunking.chunk_report(chunk_documents(spark, d)).select("source_file", "chunk_index", "preview")


@query
def service_health(spark, d):
    return retrieval.health(chunks(spark, d))


__all__ = ["ORACLES", "QUERIES"]
