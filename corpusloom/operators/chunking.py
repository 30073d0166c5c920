"""From Markdown documents to chunks, and the tables that report on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clean, split
from ..functions.text import estimate_tokens, staged, strip
from ..sources.scratch import numbered, written

#: Histogram buckets of chunk sizes: names and half-open bounds.
BUCKETS = ((0, 50), (50, 100), (100, 200), (200, 300), (300, 400), (400, 512), (512, None))
TINY, LARGE = 10, 450


def prepare(docs: DataFrame, id_col: str = "source_file", text_col: str = "text", *, min_chars: int = clean.MIN_CHARS, no_filter: bool = False) -> DataFrame:
    """source_file, page_title, size, reason, author, date, cleaned, content_type, checked for each row of docs.

    reason says why a document is left out, null if it is kept. cleaned comes of the text without signature lines; checked, of
    the text as it is, is what reports look at. A null text counts as empty.
    """
    title = F.col("page_title") if "page_title" in docs.columns else F.col(id_col)
    step = docs.select(F.col(id_col).cast("string").alias("source_file"), title.cast("string").alias("page_title"), F.coalesce(F.col(text_col), F.lit("")).alias("raw"))
    step = staged(step, sig=clean.signature(F.col("raw")), checked=clean.clean_text(F.col("raw")), bare=clean.without_signatures(F.col("raw")))
    # Only what signatures change is cleaned and made plain twice.
    # Of plain texts only short lengths are asked for.
    least = max(min_chars, clean.MINIMAL)
    step = staged(step, plain=clean.plain_start(F.col("checked"), least), cleaned=F.when(F.col("bare") == F.col("raw"), F.col("checked")).otherwise(clean.clean_text(F.col("bare"))))
    step = staged(step.drop("bare"), cleaned_plain=F.when(F.col("cleaned") == F.col("checked"), F.col("plain")).otherwise(clean.plain_start(F.col("cleaned"), least)))
    reason = F.lit(None).cast("string") if no_filter else clean.filter_reason(F.col("raw"), F.col("plain"), min_chars)
    step = staged(step, reason=F.coalesce(reason, F.when(F.col("cleaned") == "", F.lit(clean.EMPTY))), content_type=clean.content_type(F.col("cleaned"), F.col("cleaned_plain")))
    return step.select("source_file", "page_title", F.octet_length("raw").cast("long").alias("size"), "reason", F.col("sig.author").alias("author"), F.col("sig.date").alias("date"), "cleaned", "content_type", "checked")


def held(prepared: DataFrame) -> DataFrame:
    """prepared as a table of its own, for what reads documents and their chunks: no text is cleaned twice."""
    return written(prepared, "prepared")[0]


def chunk(prepared: DataFrame, *, max_tokens: int = split.MAX_TOKENS, overlap: int = split.OVERLAP_TOKENS) -> DataFrame:
    """The chunks of the documents that prepare() keeps: one row each, numbered from 0 within its document."""
    kept = prepared.where("reason is null")
    kind = F.when(F.col("content_type") == "qa", split.split_qa(F.col("cleaned"))).otherwise(split.split_by_headings(F.col("cleaned")))
    step = staged(kept.drop("checked", "reason", "size"), parts=kind)
    step = staged(step.drop("cleaned"), parts=split.split_sections(F.col("parts"), max_tokens))
    step = staged(step, parts=split.merge_tiny(F.col("parts"), max_tokens=max_tokens))
    step = staged(step, parts=split.add_overlap(F.col("parts"), overlap))
    step = staged(step, parts=split.hard_cap(F.col("parts")))
    rows = step.select("source_file", "page_title", "author", "date", "content_type", F.size("parts").cast("long").alias("total_chunks"), F.posexplode("parts").alias("pos", "part"))
    content = strip(F.col("part.content"))
    out = rows.select(content.alias("content"), "source_file", "page_title", F.col("part.heading").alias("section_heading"), F.col("pos").cast("long").alias("chunk_index"), "total_chunks", "author", "date", "content_type")
    return out.where("content <> ''").withColumns({"char_count": F.length("content").cast("long"), "estimated_tokens": estimate_tokens(F.col("content"))})


def chunks_of(docs: DataFrame, **how) -> DataFrame:
    """chunk(prepare(docs)): no row leaves its partition."""
    cut = {k: how.pop(k) for k in ("max_tokens", "overlap") if k in how}
    return chunk(prepare(docs, **how), **cut)


def with_ids(chunks: DataFrame) -> DataFrame:
    """chunks with seq, their place by source_file and chunk_index, and id, chunk_<seq>."""
    return numbered(chunks, ["source_file", "chunk_index"], "seq").withColumn("id", F.concat(F.lit("chunk_"), F.col("seq").cast("string")))


# Reports ------------------------------------------------------------------------------------------------------------


def filter_log(prepared: DataFrame) -> DataFrame:
    return prepared.where("reason is not null").select("source_file", "size", "reason")


def filter_reasons(prepared: DataFrame) -> DataFrame:
    return prepared.where("reason is not null").groupBy(clean.reason_category(F.col("reason")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def file_summary(prepared: DataFrame, chunks: DataFrame) -> DataFrame:
    """source_file, size, author, date, content_type, num_chunks of the kept documents."""
    n = chunks.groupBy("source_file").agg(F.count(F.lit(1)).alias("num_chunks"))
    return prepared.where("reason is null").select("source_file", "size", "author", "date", "content_type").join(n, "source_file")


#: Fixed: what the report of issues says.
NO_HEADINGS, TAGS_LEFT = "File has no markdown headings; chunked by paragraph/fallback", "%d HTML tags remain after cleaning"
TINY_CHUNK, LARGE_CHUNK = "Chunk %d/%d has only ~%d tokens", "Chunk %d/%d has ~%d tokens (close to 512 limit)"


def _issue(hit: Column, kind: str, details: Column) -> Column:
    return F.when(hit, F.struct(F.lit(kind).alias("issue_type"), details.alias("details")))


def issues(prepared: DataFrame, chunks: DataFrame) -> DataFrame:
    """source_file, issue_type, details: documents without headings, tags left, tiny and large chunks. Each input is read once."""
    tags = clean.residual_html(F.col("checked"))
    numbered = lambda said: F.format_string(said, F.col("chunk_index") + 1, F.col("total_chunks"), F.col("estimated_tokens"))
    of_documents = (
        _issue(~clean.has_heading(F.col("checked")), "no_headings", F.lit(NO_HEADINGS)),
        _issue(tags > 0, "residual_html", F.format_string(TAGS_LEFT, tags)),
    )
    of_chunks = (
        _issue(F.col("estimated_tokens") < TINY, "tiny_chunk", numbered(TINY_CHUNK)),
        _issue(F.col("estimated_tokens") > LARGE, "large_chunk", numbered(LARGE_CHUNK)),
    )
    listed = lambda df, found: df.select("source_file", F.inline(F.array_compact(F.array(*found))))
    return listed(prepared.where("reason is null"), of_documents).unionByName(listed(chunks, of_chunks))


def size_stats(chunks: DataFrame) -> DataFrame:
    """n, min, upper median, mean, max of the chunks' tokens, and how many are over the hard limit. The median is found by
    counts of each size, so no size list is gathered."""
    counts = chunks.groupBy(F.col("estimated_tokens").alias("t")).agg(F.count(F.lit(1)).alias("c"))
    upto = counts.withColumns({"cum": F.sum("c").over(Window.orderBy("t")), "n": F.sum("c").over(Window.partitionBy())})
    median = F.min(F.when(F.col("cum") > F.floor(F.col("n") / 2), F.col("t")))
    over = F.coalesce(F.sum(F.when(F.col("t") > split.HARD_TOKENS, F.col("c"))), F.lit(0))
    return upto.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.min("t").alias("min_tokens"), median.alias("median_tokens"), (F.sum(F.col("t") * F.col("c")) / F.sum("c")).alias("mean_tokens"), F.max("t").alias("max_tokens"), over.alias("over_limit"))


def bucket(tokens: Column) -> Column:
    out = F.lit(None).cast("string")
    for lo, hi in reversed(BUCKETS):
        hit = tokens >= lo if hi is None else (tokens >= lo) & (tokens < hi)
        out = F.when(hit, F.lit(f"{lo}-{hi}" if hi else f"{lo}+")).otherwise(out)
    return out


def size_histogram(chunks: DataFrame) -> DataFrame:
    """bucket, n for every bucket, empty ones too."""
    n = chunks.groupBy(bucket(F.col("estimated_tokens")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    names = F.explode(F.array(*(F.lit(f"{lo}-{hi}" if hi else f"{lo}+") for lo, hi in BUCKETS)))
    every = chunks.sparkSession.range(1).select(names.alias("bucket"))
    return every.join(n, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def content_types(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("content_type").agg(F.count(F.lit(1)).alias("n"))


def largest_document(chunks: DataFrame) -> DataFrame:
    """source_file, n of the document with most chunks; the first by name among equals."""
    return chunks.groupBy("source_file").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source_file").limit(1)


def corpus_counts(prepared: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, filtered, chunked, without headings, with tags left, of questions; chunks."""
    kept = F.col("reason").isNull()
    n = lambda hit: F.coalesce(F.sum(F.when(hit, 1)), F.lit(0)).cast("long")
    docs = prepared.agg(F.count(F.lit(1)).alias("n_files"), n(~kept).alias("n_filtered"), n(kept).alias("n_chunked"), n(kept & ~clean.has_heading(F.col("checked"))).alias("n_no_headings"), n(kept & (clean.residual_html(F.col("checked")) > 0)).alias("n_with_html"), n(kept & (F.col("content_type") == "qa")).alias("n_qa"))
    return docs.crossJoin(chunks.agg(F.count(F.lit(1)).alias("n_chunks")))  # two single rows


def preview(content: Column) -> Column:
    """The first 200 characters on one line, without control characters, as a report shows them."""
    return F.regexp_replace(F.regexp_replace(F.substring(content, 1, 200), "\n", " "), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "")


def chunk_report(chunks: DataFrame) -> DataFrame:
    return chunks.select("source_file", "chunk_index", "section_heading", "content_type", "char_count", "estimated_tokens", preview(F.col("content")).alias("preview"))
