"""Byte-level BPE with the files of public tokenizers: batched merge rounds in numpy.

A task splits its texts into pre-tokens, looks each up among those it has met, and encodes the new ones together: their
bytes lie in one flat array of symbols, every round finds each word's lowest-rank pair and merges all its occurrences in all
words at once. Ranks are found by binary search over the sorted keys of all mergeable pairs, and only where a merge has
changed a pair.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, runs, ship

#: Distinct pre-tokens that a task remembers; beyond that it starts anew.
REMEMBERED = 200_000
#: Fixed: how this family of tokenizers parts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = np.int64(1 << 40)


def byte_chars() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next free one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


def ragged(flat: np.ndarray, off: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[off[i]:off[i + 1]] for each i of picks, joined, and their lengths."""
    sizes = off[picks + 1] - off[picks]
    ends = np.cumsum(sizes)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(off[picks] - (ends - sizes), sizes)
    return flat[at], sizes


class Bpe:
    """A tokenizer file as arrays."""

    def __init__(self, file: bytes):
        import regex

        spec = json.loads(file)
        of = {c: b for b, c in enumerate(byte_chars())}
        vocab, added = spec["model"]["vocab"], spec["added_tokens"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.byte_ids = np.array([vocab[c] for c in byte_chars()], np.int64)
        pairs = (self.byte_ids[:, None] << 32 | self.byte_ids[None, :]).ravel()
        self.byte_pairs = self.rank_of(pairs)
        tokens = {i: bytes(of[c] for c in t) for t, i in vocab.items()} | {t["id"]: t["content"].encode() for t in added}
        sizes = [len(tokens.get(i, b"")) for i in range(max(tokens) + 1)]
        self.bytes = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(max(tokens) + 1)), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.split = regex.compile(PATTERN)
        self.special = regex.compile("(" + "|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"]))) + ")") if added else None
        self.special_ids = {t["content"]: t["id"] for t in added}
        self.forget()

    def forget(self) -> None:
        # The special tokens come first, under keys that no pre-token has.
        self.index: dict = {("special", s): k for k, s in enumerate(self.special_ids)}
        self.flat = np.array(list(self.special_ids.values()), np.int64)
        self.off = np.arange(len(self.special_ids) + 1, dtype=np.int64)

    def rank_of(self, pairs: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[at] == pairs, self.ranks[at], _NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, joined, and the number of ids of each."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        ids, word = self.byte_ids[data], np.repeat(np.arange(len(words)), sizes)
        inside = np.append(word[1:] == word[:-1], False)
        rank = np.full(len(ids), _NONE)
        at = np.flatnonzero(inside)
        rank[at] = self.byte_pairs[data[at] * 256 + data[at + 1]]
        done_ids, done_words = [], []
        while len(ids):
            begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.minimum.reduceat(rank, begins)
            lengths = np.diff(np.append(begins, len(ids)))
            open_ = np.repeat(low < _NONE, lengths)
            if not open_.all():
                done_ids.append(ids[~open_])
                done_words.append(word[~open_])
                low, lengths = low[low < _NONE], lengths[low < _NONE]
                ids, word, rank = ids[open_], word[open_], rank[open_]
                if not len(ids):
                    break
            hit = rank == np.repeat(low, lengths)
            if (hit[1:] & hit[:-1]).any():  # a pair of like symbols overlaps itself: take every other one of a run, from the left
                at = np.flatnonzero(hit)
                fresh = np.append(True, np.diff(at) > 1)
                run = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
                odd = (np.arange(len(at)) - run) % 2 == 1
                hit[at[odd]] = False
            at = np.flatnonzero(hit)
            ids[at] = self.made[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            now = np.cumsum(keep)[at] - 1
            ids, word = ids[keep], word[keep]
            rank = rank[keep]
            for near in (now, now[now > 0] - 1):
                last = len(ids) - 1
                inner = near < last
                rank[near[~inner]] = _NONE
                near = near[inner]
                same = word[near] == word[near + 1]
                rank[near[~same]] = _NONE
                near = near[same]
                rank[near] = self.rank_of(ids[near] << 32 | ids[near + 1])
        all_ids, all_words = np.concatenate(done_ids), np.concatenate(done_words)
        order = np.argsort(all_words, kind="stable")
        return all_ids[order], np.bincount(all_words, minlength=len(words))

    def pretokens(self, text: str) -> list:
        if self.special is None or not any(s in text for s in self.special_ids):
            return self.split.findall(text)
        out: list = []
        for part in self.special.split(text):
            out.extend([("special", part)] if part in self.special_ids else self.split.findall(part))
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, joined, and the number of ids of each."""
        if len(self.index) > REMEMBERED:
            self.forget()
        tokens: list = []
        counts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            found = self.pretokens(t)
            counts[i] = len(found)
            tokens += found
        picks = np.fromiter(map(self.index.get, tokens, repeat(-1)), np.int64, len(tokens))
        missed = np.flatnonzero(picks < 0)
        if len(missed):
            new = dict.fromkeys(map(tokens.__getitem__, missed.tolist()))
            flat, sizes = self.merge([w.encode() for w in new])
            base = len(self.off) - 1
            self.off = np.concatenate([self.off, self.off[-1] + np.cumsum(sizes)])
            self.flat = np.concatenate([self.flat, flat])
            self.index.update(zip(new, range(base, base + len(new)), strict=True))
            picks[missed] = np.fromiter((self.index[tokens[i]] for i in missed.tolist()), np.int64, len(missed))
        ids, sizes = ragged(self.flat, self.off, picks)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(ends)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The texts of runs of ids; ids that the file doesn't know stand for nothing, bytes that aren't UTF-8 for U+FFFD."""
        known = (ids >= 0) & (ids < len(self.offsets) - 1)
        data, lengths = ragged(self.bytes, self.offsets, np.where(known, ids, 0))
        if not known.all():
            data, lengths = data[np.repeat(known, lengths)], np.where(known, lengths, 0)
        at = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(sizes)])]
        raw = data.tobytes()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _ints(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids, pa.int32()))


def _file(path: str) -> bytes:
    """The tokenizer file, read where the job starts: it goes along with the tasks, so executors need no such path."""
    with open(path, "rb") as f:
        return f.read()


def _encode(file: bytes, bpe: Bpe | None = None):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe_ = bpe or Bpe(file)
        for batch in batches:
            for a, b in runs(batch.column(1)):
                ids, sizes = bpe_.encode([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _ints(ids, sizes)], ["id", "ids"])

    return apply


def _decode(file: bytes, bpe: Bpe | None = None):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe_ = bpe or Bpe(file)
        for batch in batches:
            lists = batch.column(1)
            sizes = np.asarray(pa.compute.list_value_length(lists).fill_null(0), np.int64)
            ids = np.asarray(lists.flatten().fill_null(-1), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bpe_.decode(ids, sizes), pa.string())], ["id", "text"])

    return apply


def _digest(bpe: Bpe):
    """From (id, ids) to the digests of the ids and of the decoded text."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off = np.asarray(batch.column(1).offsets, np.int64)
            raw = np.asarray(batch.column(1).values, np.int64).astype("<u4").tobytes()
            ids = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            texts = next(_decode(b"", bpe)(iter([batch]))).column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off), pa.int64()), pa.array(ids), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts])], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return apply


def _two(docs: DataFrame, id_col: str, value: str, kind: str) -> tuple[DataFrame, str]:
    return docs.select(column(docs, id_col).alias("id"), column(docs, value).cast(kind).alias("v")), dict(docs.dtypes).get(id_col, "bigint")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ids (array<int>) for each row of docs. A null or empty text has no ids; special tokens' strings in a text
    become their ids, as the file says. Repeated rows are encoded each, ids pass through, other columns are ignored."""
    df, kind = _two(docs, id_col, text_col, "string")
    return df.mapInArrow(_encode(_file(path)), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and text for each row of encoded. Null or empty ids give an empty text; unknown or null ids stand for nothing."""
    df, kind = _two(encoded, id_col, ids_col, "array<int>")
    return df.mapInArrow(_decode(_file(path)), f"id {kind}, text string").withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256: encode(), then decode(), in one pass that hands no ids to the JVM."""
    df, kind = _two(docs, id_col, text_col, "string")
    file = _file(path)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(file)
        return _digest(bpe)(_encode(file, bpe)(batches))

    return df.mapInArrow(both, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").select(F.col("id").alias(id_col), "n_tokens", "ids_sha256", "decoded_sha256")


import pyarrow.compute  # noqa: E402, F401

ship(__name__)
