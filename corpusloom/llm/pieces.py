"""SentencePiece encoding and decoding for merge-type vocabularies with byte fallback, checked against the library.

A text's spaces become U+2581, one more stands before it, and it is cut where no piece of the vocabulary can reach across: before
a run of U+2581, around control characters that no piece holds, and between letters and other characters. Each part that a task has not met is encoded by an agenda:
adjacent symbols whose union is a piece wait in a heap, the best score first, of equal scores the leftmost; a merge offers its new
neighbours. Symbols that are no piece become bytes. In the digests, the library encodes the new parts of each Arrow batch too, and
each text says whether it agreed on all of its parts.
"""

from __future__ import annotations

import codecs
import hashlib
import sys
import types
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _file, _ints, _two, ragged
from .common import runs, ship

#: Distinct parts that a task remembers, and their ids; beyond either it keeps those met more than once, if that is half at most.
REMEMBERED, REMEMBERED_IDS = 300_000, 4_000_000
#: Fixed: what stands for a space.
SPACE = "▁"


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, message[at : at + size]
            at += size


def _supported(file: bytes) -> None:
    """Raises ValueError unless the model merges, falls back to bytes, keeps texts as they are and puts a space before them."""
    top = dict(_fields(file))
    trainer, text = dict(_fields(top.get(2, b""))), dict(_fields(top.get(3, b"")))
    # Fixed numbers: type of model (2: merges), byte fallback, space as suffix; map of characters, dummy prefix, extra white space, escapes.
    if (trainer.get(3), trainer.get(35), trainer.get(24, 0)) != (2, 1, 0) or text.get(2) or (text.get(3, 1), text.get(4, 1), text.get(5, 1)) != (1, 0, 1):
        raise ValueError("the model must be of the merge type with byte fallback, without normalisation, and with a space before the text")


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


class Pieces:
    """A model file as tables."""

    def __init__(self, file: bytes):
        import re

        import sentencepiece

        _supported(file)
        codecs.register_error("each_byte", _each_byte)
        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=file)
        every = range(sp.get_piece_size())
        names = [sp.id_to_piece(i) for i in every]
        own = [i for i in every if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        if any(sp.is_unused(i) for i in own):
            raise ValueError("unused pieces are not supported")
        self.ids = {names[i]: i for i in own}
        # Symbols are ids; characters that are no piece, but part of one, get numbers after the ids, all others the last one.
        self.symbols = {c: i for c, i in self.ids.items() if len(c) == 1}
        for c in sorted({c for n in self.ids for c in n} - self.symbols.keys()):
            self.symbols[c] = len(names) + len(self.symbols)
        self.stranger = len(names) + len(self.symbols) + 1
        order = {x: k for k, x in enumerate(sorted({sp.get_score(i) for i in own}, reverse=True))}
        scored = set(own)
        #: The place of each piece's score among all, above 32 bits for a symbol's place in its part.
        self.place = [order[sp.get_score(i)] << 32 if i in scored else 0 for i in every]
        #: The union of each pair of symbols that has one.
        self.unions: dict[int, int] = {}
        symbol = lambda t: self.symbols.get(t) if len(t) == 1 else self.ids.get(t)
        for i in own:
            for cut in range(1, len(names[i])):
                left, right = symbol(names[i][:cut]), symbol(names[i][cut:])
                if left is not None and right is not None:
                    self.unions[left << 32 | right] = i
        self.byte_ids = {int(names[i][3:5], 16): i for i in every if sp.is_byte(i)}
        self.eos, self.decimal = sp.eos_id(), [str(i) for i in every]
        joined = "\n".join(names[i] for i in own)
        if re.search(f"[^{SPACE}\n]{SPACE}", joined):  # a piece that reaches over a space: texts stay whole
            alone, self.split = "", re.compile(".+", re.S)
        else:
            alone = "".join(c for c in "\t\n\v\f\r" if c not in self.symbols)
            # Nor across the border of letters and others, unless a piece does.
            odd = "".join(c for c in self.symbols if not c.isalpha() and re.match(r"[^\W\d_]", c))  # like a raised digit
            letter, other = rf"[^\W\d_{odd}]", rf"(?:(?![{SPACE}{alone}])[\W\d_{odd}])"
            crossing = re.search(f"{letter}{other}|{other}{letter}", joined) if alone else True
            rest = rf"{SPACE}*{letter}+|{SPACE}*{other}+|{SPACE}+" if not crossing else f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+"
            self.split = re.compile(f"[{alone}]|{rest}" if alone else rest)
        self.alone = alone
        texts = [bytes([int(n[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)]
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.silent = np.array([not t for t in texts], bool)
        self.spaced = np.array([n.startswith(SPACE) and not sp.is_byte(i) for i, n in enumerate(names)], bool)
        self.forget()

    def forget(self, keep: np.ndarray | None = None) -> None:
        """Keeps these of the remembered parts, by their numbers, or none."""
        keep = np.empty(0, np.int64) if keep is None else keep
        if len(keep):
            names = list(self.index)
            self.index = {names[i]: k for k, i in enumerate(keep.tolist())}
            self.flat, sizes = ragged(self.flat, self.off, keep)
            self.off, self.same = np.concatenate([[0], np.cumsum(sizes)]), self.same[keep]
        else:
            self.index = {}
            self.flat, self.off, self.same = np.empty(0, np.int64), np.zeros(1, np.int64), np.empty(0, bool)
        self.met = np.zeros(len(keep), np.int64)

    def merge(self, part: str) -> list[int]:
        """The ids of one part, by the agenda: numbers that hold a score's place above the left symbol's."""
        known, union, place, stranger = self.symbols.get, self.unions.get, self.place, self.stranger
        symbols = [known(c, stranger) for c in part]
        n = len(symbols)
        waits = [union(a << 32 | b, -1) for a, b in zip(symbols, symbols[1:])]  # noqa: B905
        agenda = [place[u] | a for a, u in enumerate(waits) if u >= 0]
        if agenda:
            waits.append(-1)
            before, after = list(range(-1, n - 1)), list(range(1, n + 1))
            heapify(agenda)
            while agenda:
                top = heappop(agenda)
                a = top & 0xFFFFFFFF
                u = waits[a]
                if u < 0 or place[u] | a != top:
                    continue  # the pair is no more
                b = after[a]
                q = after[a] = after[b]
                symbols[a], symbols[b], waits[b] = u, -1, -1
                if q < n:
                    before[q] = a
                    waits[a] = v = union(u << 32 | symbols[q], -1)
                    if v >= 0:
                        heappush(agenda, place[v] | a)
                else:
                    waits[a] = -1
                p = before[a]
                if p >= 0:
                    waits[p] = v = union(symbols[p] << 32 | u, -1)
                    if v >= 0:
                        heappush(agenda, place[v] | p)
        if max(symbols) < len(self.decimal):
            return [s for s in symbols if s >= 0]
        out: list[int] = []
        for s, c in zip(symbols, part, strict=True):
            if s >= len(self.decimal):
                out += [self.byte_ids[x] for x in c.encode()]
            elif s >= 0:
                out.append(s)
        return out

    def encode(self, texts: list[str], check: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the texts, joined, each text's with the end id after them; the number of ids of each; whether the library has
        the same ids for all parts of each, if that is checked."""
        if len(self.index) > REMEMBERED or self.off[-1] > REMEMBERED_IDS:
            often = np.flatnonzero(self.met > 1)
            self.forget(often if 2 * len(often) < REMEMBERED and 2 * int(np.diff(self.off)[often].sum()) < REMEMBERED_IDS else None)
        parts: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            found = self.split.findall(SPACE + t.replace(" ", SPACE)) if t else []
            counts[i] = len(found)
            parts += found
        picks = np.fromiter(map(self.index.get, parts, repeat(-1)), np.int64, len(parts))
        missed = np.flatnonzero(picks < 0).tolist()
        if missed:
            new = list(dict.fromkeys(map(parts.__getitem__, missed)))
            made = list(map(self.merge, new))
            base = len(self.off) - 1
            self.off = np.concatenate([self.off, self.off[-1] + np.cumsum(list(map(len, made)))])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(made), np.int64, int(self.off[-1]) - len(self.flat))])
            self.same = np.append(self.same, np.array(self.agree(new, made), bool) if check else np.ones(len(new), bool))
            self.met = np.append(self.met, np.zeros(len(new), np.int64))
            self.index.update(zip(new, range(base, base + len(new)), strict=True))
            picks[missed] = np.fromiter((self.index[parts[i]] for i in missed), np.int64, len(missed))
        self.met += np.bincount(picks, minlength=len(self.met))
        ids, sizes = ragged(self.flat, self.off, picks)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        ends = np.concatenate([[0], np.cumsum(sizes)])[bounds]
        odd = np.concatenate([[0], np.cumsum(~self.same[picks])])[bounds]
        return np.insert(ids, ends[1:], self.eos), np.diff(ends) + 1, np.diff(odd) == 0

    def agree(self, parts: list[str], made: list[list[int]]) -> list[bool]:
        """Whether the library has these ids for each part. A line break before it, where no piece holds one, keeps the part apart
        from the space that the library puts before a text."""
        lead = "\n" if "\n" in self.alone else ""
        theirs = self.library.encode([lead + p if lead else p.removeprefix(SPACE) for p in parts], add_bos=False, add_eos=False, num_threads=1)
        skip = len(self.library.encode(lead, add_bos=False, add_eos=False)) if lead else 0
        return [x[skip:] == y for x, y in zip(theirs, made, strict=True)]

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The texts of runs of ids. The space that begins a text's first piece goes; ids that the model doesn't know stand for
        nothing, bytes that are no UTF-8 for U+FFFD each."""
        known = (ids >= 0) & (ids < len(self.offsets) - 1)
        ids = np.where(known, ids, self.eos)
        data, lengths = ragged(self.bytes, self.offsets, ids)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        places = np.concatenate([[0], np.cumsum(lengths)])
        at = places[bounds]
        heard = np.append(np.flatnonzero(~self.silent[ids]), len(ids))
        first = heard[np.searchsorted(heard, bounds[:-1])]  # the first id of each run that is not silent, or one of a later run
        strip = (first < bounds[1:]) & self.spaced[np.append(ids, self.eos)[first]]
        raw = data.tobytes()
        quiet = np.flatnonzero(self.silent[ids])  # they part the bytes of a character
        low, high = np.searchsorted(quiet, bounds[:-1]).tolist(), np.searchsorted(quiet, bounds[1:] - 1).tolist()
        out = []
        for a, b, s, i, j in zip(at[:-1].tolist(), at[1:].tolist(), strip.tolist(), low, high, strict=True):
            cuts = [a + s, *np.maximum(places[quiet[i:j]], a + s).tolist(), b] if i < j else [a + s, b]
            out.append("".join(raw[x:y].decode("utf-8", "each_byte") for x, y in zip(cuts, cuts[1:], strict=False)))
        return out


def _model(file: bytes) -> Pieces:
    """The model of this worker process: it keeps what it remembers from task to task."""
    kept = sys.modules.setdefault("_corpusloom_pieces", types.ModuleType("_corpusloom_pieces")).__dict__
    key = hashlib.sha256(file).hexdigest()
    if key not in kept:
        kept.clear()
        kept[key] = Pieces(file)
    return kept[key]


def _encode(file: bytes):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(file)
        for batch in batches:
            for a, b in runs(batch.column(1)):
                ids, sizes, _ = model.encode([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _ints(ids, sizes)], ["id", "ids"])

    return apply


def _decode(file: bytes):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(file)
        for batch in batches:
            lists = batch.column(1)
            sizes = np.asarray(pa.compute.list_value_length(lists).fill_null(0), np.int64)
            ids = np.asarray(lists.flatten().fill_null(-1), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.decode(ids, sizes), pa.string())], ["id", "text"])

    return apply


def _digests(file: bytes):
    """From (id, text) to the number of ids, digests of the ids and of the decoded text, and whether the library agrees."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(file)
        hashed = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            for a, b in runs(batch.column(1)):
                texts = [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
                flat, sizes, same = model.encode(texts, check=True)
                decoded = model.decode(flat, sizes)
                shown, ends = list(map(model.decimal.__getitem__, flat.tolist())), np.cumsum(sizes).tolist()
                ids = [hashed(" ".join(shown[e - n : e])) for e, n in zip(ends, sizes.tolist(), strict=True)]
                agrees = [x and d == t.replace(SPACE, " ") for x, d, t in zip(same.tolist(), decoded, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(ids, pa.string()), pa.array([hashed(t) for t in decoded], pa.string()), pa.array(agrees, pa.bool_())], ["id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"])

    return apply


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ids (array<int>) for each row of docs, the end id last. A null or empty text has the end id alone; strings of
    special pieces in a text are ordinary text. Repeated rows are encoded each, ids pass through, other columns are ignored."""
    df, kind = _two(docs, id_col, text_col, "string")
    return df.mapInArrow(_encode(_file(path)), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and text for each row of encoded. Null or empty ids give an empty text; unknown or null ids stand for nothing."""
    df, kind = _two(encoded, id_col, ids_col, "array<int>")
    return df.mapInArrow(_decode(_file(path)), f"id {kind}, text string").withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256, agrees: encode(), then decode(), in one pass that hands no ids to the JVM.
    agrees: the library has the same ids for every part, and the decoded text is the text. Odd rows are as in encode()."""
    df, kind = _two(docs, id_col, text_col, "string")
    shape = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean"
    return df.mapInArrow(_digests(_file(path)), shape).select(F.col("id").alias(id_col), "n_tokens", "ids_sha256", "decoded_sha256", "agrees")


import pyarrow.compute  # noqa: E402, F401

ship(__name__)
