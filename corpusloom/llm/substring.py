"""Substring dedup: words of passages that a document with a smaller id has too are removed.

The reference is the corpus itself, so what may repeat is found first: a window of words is filed under the anchor that its
content alone picks (the smallest hash of its short word runs), and only anchors that two documents share can hold a
repeated window. The windows of one anchor place form a piece; distinct pieces of shared anchors, each with the smallest id
that has it, are the reference, dealt into shards by anchor. A task builds a suffix automaton for some thousand words of
whole anchors at a time and streams their pieces through it (an anchor with one piece needs none): the matching statistics give, for every window, the smallest id
in whose text it starts. Pieces carry that back to all documents that hold them, and maximal removed spans follow.

Shards and documents meet by a shuffle on anchors. To broadcast every shard to all documents would cost shards x documents.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, blobs, column, drop, longs, mix, powers, runs, save, ship, windows

WINDOW = 13
#: Words of the runs that anchors are picked from.
RUN = 6
#: Anchors of at least so many pieces, in all documents together, are filed by their windows instead: no anchor gathers more pieces
#: than this, and a piece has at most WINDOW - RUN + 1 windows.
COMMON = 1000
#: Words of a shard; a shard ends at the first anchor beyond it.
SHARD_WORDS = 40_000
_NO_ID = np.int64(2**63 - 1)
_PIECE = np.uint64(0xC2B2AE3D27D4EB4F)


class Automaton:
    """A suffix automaton of many word sequences; each state keeps the smallest id among the sequences it occurs in."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.low = [-1], [0], [int(_NO_ID)]

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.low.append(int(_NO_ID))
        return len(self.length) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state that word leads to from p, by way of a copy of q where q also holds longer contexts."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.next[q].copy(), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[int], ident: int) -> None:
        moves, link, low, last = self.next, self.link, self.low, 0
        for word in words:
            q = moves[last].get(word)
            if q is not None:
                last = self._split(last, word, q)
            else:
                new = self._state(self.length[last] + 1, {}, 0)
                p = last
                while p >= 0 and word not in moves[p]:
                    moves[p][word] = new
                    p = link[p]
                if p >= 0:
                    link[new] = self._split(p, word, moves[p][word])
                last = new
            if ident < low[last]:
                low[last] = ident

    def close(self) -> None:
        """Hands each state's smallest id on to its suffixes."""
        low, link = self.low, self.link
        for s in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            if low[s] < low[link[s]]:
                low[link[s]] = low[s]

    def stream(self, words: list[int], size: int) -> list[int]:
        """For each window of size words, the smallest id that has it, or the largest long: the text is matched word by word,
        and where the match is size words long, the state of just these words knows."""
        moves, link, length, low = self.next, self.link, self.length, self.low
        state = matched = 0
        out = []
        for i, word in enumerate(words):
            while state and word not in moves[state]:
                state = link[state]
                matched = length[state]
            if word in moves[state]:
                state = moves[state][word]
                matched += 1
            if matched >= size:
                matched = size
                while length[link[state]] >= size:
                    state = link[state]
            if i + 1 >= size:
                out.append(low[state] if matched >= size else int(_NO_ID))
        return out


def pieces(w: Words, size: int = WINDOW, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and anchor of each piece, in order; pieces never pass a text's end."""
    n, none = len(w.starts), np.empty(0, np.int64)
    if n < size:
        return none, none, np.empty(0, np.uint64)
    grams, reach = windows(w.hashes, run), size - run + 1
    best, span = np.arange(len(grams)), 1
    while span < reach:
        step = min(span, reach - span)
        left, right = best[:-step], best[step:]
        best = np.where(grams[right] < grams[left], right, left)
        span += step
    first = np.flatnonzero(w.text_of[: n - size + 1] == w.text_of[size - 1 :])
    if not len(first):
        return none, none, np.empty(0, np.uint64)
    anchor = best[first]
    begins = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (first[1:] != first[:-1] + 1)]))
    return first[begins], np.diff(np.append(begins, len(first))), grams[anchor[begins]]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, id, pieces), once for each text and anchor."""
    for batch in batches:
        for a, b in runs(batch.column(1)):
            w = Words(batch.column(1).slice(a, b - a))
            first, _, anchor = pieces(w)
            of = w.text_of[first]
            order = np.lexsort((anchor, of))
            of, anchor = of[order], anchor[order]
            begins = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (anchor[1:] != anchor[:-1])])) if len(of) else np.empty(0, np.int64)
            ids = batch.column(0).slice(a, b - a).take(pa.array(of[begins]))
            yield pa.RecordBatch.from_arrays([pa.array(anchor[begins].view(np.int64)), ids, longs(np.diff(np.append(begins, len(of))))], ["anchor", "id", "pieces"])


def _among(values: np.ndarray, of: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether each value is in the list of its row."""
    at = np.asarray(lists.offsets, np.int64)
    listed = np.asarray(lists.values, np.int64).view(np.uint64)[at[0] : at[-1]]
    salt = lambda rows: mix(rows.astype(np.uint64) + np.uint64(1))
    return np.isin(values ^ salt(of), listed ^ salt(np.repeat(np.arange(len(at) - 1), np.diff(at))))


def _pieces(with_words: bool):
    """From (id, h, text, anchors, common): (key, piece, id, words), or (key, piece, id, h, start), for each piece of a listed
    anchor. A piece of a common anchor is parted into its windows, each its own key."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in runs(batch.column(2)):
                part = batch.slice(a, b - a)
                w = Words(part.column(2))
                first, count, anchor = pieces(w)
                of = w.text_of[first]
                keep = _among(anchor, of, part.column(3))
                first, count, anchor, of = first[keep], count[keep], anchor[keep], of[keep]
                common = _among(anchor, of, part.column(4))
                times = np.where(common, count, 1)
                inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                first, count, anchor, of, common = (np.repeat(x, times) for x in (first, count, anchor, of, common))
                first, count = first + inside, np.where(common, 1, count)
                sizes = count + WINDOW - 1
                ends = np.cumsum(sizes)
                at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)
                words = w.hashes[np.repeat(first, sizes) + at]
                piece = mix(np.add.reduceat(words * powers(_PIECE, 4 * WINDOW)[at], ends - sizes) + sizes.astype(np.uint64)) if len(ends) else np.empty(0, np.uint64)
                key = np.where(common, piece, anchor)
                ids = part.column(0).take(pa.array(of))
                out = [pa.array(key.view(np.int64)), pa.array(piece.view(np.int64)), ids]
                if with_words:
                    yield pa.RecordBatch.from_arrays([*out, blobs(words.astype(np.uint32), np.append(0, ends))], ["key", "piece", "id", "words"])
                else:
                    yield pa.RecordBatch.from_arrays([*out, part.column(1).take(pa.array(of)), longs(first - w.first[of])], ["key", "piece", "id", "h", "start"])

    return apply


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, piece, low, words), sorted by key: (key, piece, lows), the smallest id of each of the piece's windows."""

    def shard(rows: list[tuple]) -> pa.RecordBatch:
        m, times = Automaton(), Counter(r[0] for r in rows)
        # A key with one piece has nothing to be matched with: each window starts where the piece does first.
        texts = [np.frombuffer(r[3], np.uint32).tolist() if times[r[0]] > 1 else None for r in rows]
        for r, words in zip(rows, texts, strict=True):
            if words is not None:
                m.add(words, r[2])
        m.close()
        lows = pa.array([[r[2]] * (len(r[3]) // 4 - WINDOW + 1) if words is None else m.stream(words, WINDOW) for r, words in zip(rows, texts, strict=True)], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([longs([r[0] for r in rows]), longs([r[1] for r in rows]), lows], ["key", "piece", "lows"])

    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held > SHARD_WORDS and row[0] != rows[-1][0]:
                yield shard(rows)
                rows, held = [], 0
            rows.append(row)
            held += len(row[3]) // 4
    if rows:
        yield shard(rows)


def covered(w: Words, starts: pa.Array) -> np.ndarray:
    """Whether each word of the run of texts is in a window that starts at one of its text's starts."""
    at = np.asarray(starts.offsets, np.int64)
    first = np.asarray(starts.values, np.int64)[at[0] : at[-1]] + np.repeat(w.first[:-1], np.diff(at))
    step = np.zeros(len(w.starts) + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, first + WINDOW, -1)
    return np.cumsum(step)[:-1] > 0


def _kept(texts: pa.Array, starts: pa.Array) -> Iterator[tuple[int, int, bytes]]:
    """Number of words, of removed words, and the kept words joined by a space, for each text."""
    w = Words(texts)
    gone = covered(w, starts)
    for i, text in enumerate(texts.to_pylist()):
        words = (text or "").encode().split()
        out = gone[w.first[i] : w.first[i + 1]]
        removed = int(out.sum())
        yield len(words), removed, b" ".join([words[j] for j in np.flatnonzero(~out).tolist()] if removed else words)


def _result(digest: bool):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in runs(batch.column(2)):
                part = batch.slice(a, b - a)
                got = list(_kept(part.column(2), part.column(3)))
                kept = [hashlib.sha256(x[2]).hexdigest() if digest else x[2].decode() for x in got]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), longs([x[0] for x in got]), longs([x[1] for x in got]), pa.array(kept, pa.string())], ["id", "h", "n_words", "n_removed", "kept"])

    return apply


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, digest: bool = False) -> DataFrame:
    """id_col, n_words, n_removed, kept (the kept words joined by one space; with digest, their SHA-256) for each row of docs.

    A word goes if it is covered by WINDOW words in sequence that also start in a row with a smaller id, all judged on the
    input. Words are parted by ASCII white space and compared as they are. A null or empty text has no words; rows with one
    id never remove from each other; a row with a null id loses nothing and is no reference. Other columns are ignored. An
    empty table gives an empty result.
    """
    rows = docs.select(column(docs, id_col).cast("long").alias("id"), column(docs, text_col).cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    anchors = rows.where("id is not null").select("id", "text").mapInArrow(_anchors, "anchor long, id long, pieces long")
    shared = anchors.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.sum("pieces").alias("n")).where("lo < hi")
    shared = save(shared.select("anchor", (F.col("n") >= COMMON).alias("common")), "shared")
    listed = anchors.join(shared, "anchor").groupBy("id").agg(F.collect_set("anchor").alias("anchors"), F.collect_set(F.when(F.col("common"), F.col("anchor"))).alias("common"))
    suspects = save(rows.where("id is not null").join(listed, "id").select("id", "h", "text", "anchors", "common"), "suspects")
    reference = suspects.mapInArrow(_pieces(True), "key long, piece long, id long, words binary").groupBy("key", "piece").agg(F.min("id").alias("low"), F.first("words").alias("words"))
    lows = reference.repartition("key").sortWithinPartitions("key", "piece").mapInArrow(_match, "key long, piece long, lows array<long>")
    lows = save(lows, "lows")
    held = suspects.mapInArrow(_pieces(False), "key long, piece long, id long, h long, start long").join(lows, ["key", "piece"])
    starts = F.transform("lows", lambda low, i: F.when(low < F.col("id"), F.col("start") + i))
    hits = held.select("id", "h", F.array_compact(starts).alias("starts")).where(F.size("starts") > 0)
    hits = hits.groupBy("id", "h").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    shape = "id long, h long, n_words long, n_removed long, kept string"
    cut = suspects.join(hits, ["id", "h"]).select("id", "h", "text", "starts").mapInArrow(_result(digest), shape)
    # A repeated row of one id and text is cut each; its copies are alike, so one stands for all of them.
    cut = save(cut.groupBy("id", "h").agg(F.first("n_removed").alias("cut_n"), F.first("kept").alias("cut_kept")), "cut")
    drop(shared, suspects, lows)
    whole = rows.select("id", "h", "text", F.array().cast("array<long>").alias("starts")).mapInArrow(_result(digest), shape)
    c = cut.withColumnsRenamed({"id": "cid", "h": "ch"})
    out = whole.join(c, (F.col("id") == F.col("cid")) & (F.col("h") == F.col("ch")), "left")
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("cut_n", "n_removed").alias("n_removed"), F.coalesce("cut_kept", "kept").alias("kept"))


ship(__name__)
