"""Fill-in-the-middle: texts are cut at two units, and the middle is moved to the end.

All texts of a batch lie in one array of bytes with an end mark after each. A table of states, by byte, is run over it once: its
states know the rest of a UTF-8 character, whether a unit is open, and how much of a sentinel has been read; its transitions emit
that a code point begins, that a unit ends before this byte, that a sentinel is complete. What each text emits is counted. Lanes of
the array are run side by side, each from four bytes before its start: whatever its first state, by then it is the right one.
A second pass takes the place of the cut's unit end from what was emitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, runs, ship

#: Shares, in hundredths, of texts that are transformed, and of those whose suffix comes first; the seed before an id.
RATE, SUFFIX_FIRST, SEED = 50, 80, 42
#: Fixed: what stands before a prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: What a transition emits.
CHAR, UNIT, SENTINEL = 1, 2, 4
#: No byte of UTF-8: it ends a text.
END = 0xFF
START, BLANK, WORD, OPEN, NAMED, MORE1, MORE2, MORE3 = range(8)
#: Bytes after which the state does not depend on that before them, and the longest lane.
WARM, LANE = 4, 2048


def _table() -> tuple[np.ndarray, np.ndarray]:
    """Next state, times 256, and what is emitted, by state and byte."""
    to, out = np.full((8, 256), WORD, np.uint16), np.full((8, 256), CHAR, np.uint8)
    blank = [32, *range(9, 14)]
    to[:, blank] = BLANK
    out[WORD:, blank] |= UNIT
    to[:, END], out[:, END] = START, UNIT
    out[START, END] = 0
    out[:, 0x80:0xC0] = 0
    to[MORE2, 0x80:0xC0], to[MORE3, 0x80:0xC0] = MORE1, MORE2
    to[:, 0xC0:0xE0], to[:, 0xE0:0xF0], to[:, 0xF0:0xF8] = MORE1, MORE2, MORE3
    to[:, ord("<")] = OPEN
    to[OPEN, list(b"PSM")] = NAMED
    out[NAMED, ord(">")] |= SENTINEL
    return (to << 8).ravel(), out.ravel()


NEXT, EMIT = _table()


def scan(data: np.ndarray) -> np.ndarray:
    """What each byte emits."""
    size = min(LANE, isqrt(len(data)) + 1)
    lanes = -(-len(data) // size)
    padded = np.full(WARM + lanes * size, END, np.uint8)
    padded[WARM : WARM + len(data)] = data
    steps = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (size + WARM, lanes), (1, size)))
    out, at = np.empty((size, lanes), np.uint8), np.zeros(lanes, np.uint16)
    for k, byte in enumerate(steps):
        at |= byte
        if k >= WARM:
            np.take(EMIT, at, out=out[k - WARM], mode="clip")
        at = NEXT[at]
    return np.ascontiguousarray(out.T).ravel()[: len(data)]


def _transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, text, two numbers for the cuts, form to take) to (id, n, form, prefix_chars, middle_chars, output)."""
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    for batch in batches:
        for low, high in runs(batch.column(1)):
            part = batch.slice(low, high - low)
            texts = [t.encode() for t in part.column(1).fill_null("").to_pylist()]
            ends = np.cumsum([len(t) + 1 for t in texts]) - 1  # where each text's end mark lies
            starts = np.concatenate([[0], ends[:-1] + 1])
            emitted = scan(np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8))
            units = np.flatnonzero(emitted & UNIT)
            first = np.searchsorted(units, starts)
            n = np.searchsorted(units, ends, "right") - first
            marked = np.zeros(len(texts), bool)
            marked[np.searchsorted(ends, np.flatnonzero(emitted & SENTINEL))] = True
            x, y = (np.asarray(part.column(k), np.int64) % (n + 1) for k in (2, 3))
            cut = lambda u: np.where(u > 0, units[np.maximum(first + u - 1, 0)] if len(units) else 0, starts)  # noqa: E731, B023
            a, b = (cut(u) for u in (np.minimum(x, y), np.maximum(x, y)))
            forms, rows = part.column(4).to_pylist(), []
            for i, text in enumerate(texts):
                if not text or marked[i] or forms[i] == "plain":
                    rows.append(("plain", None, None, text))
                    continue
                s, p, q = int(starts[i]), int(a[i]), int(b[i])
                chars = [int(np.count_nonzero(emitted[u:v] & CHAR)) for u, v in ((s, p), (p, q))]
                prefix, middle, suffix = text[: p - s], text[p - s : q - s], text[q - s :]
                order = [marks[0], prefix, marks[1], suffix] if forms[i] == "psm" else [marks[1], suffix, marks[0], prefix]
                rows.append((forms[i], *chars, b"".join([*order, marks[2], middle])))
            form, before, between, output = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(between, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """id_col, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain) and output.

    Draws hang on the seed and the id alone, so reruns agree and repeated ids are cut at the same numbers of units of their texts
    where these are as long. A null or empty text is plain and its output empty; a text with a sentinel is plain; a null id draws
    as an empty one. Other columns are ignored."""
    id_ = column(docs, id_col)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    rows = docs.select(id_.alias("id"), column(docs, text_col).cast("string").alias("text"), digest.alias("digest"))
    draw = [F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    form = F.when(draw[2] % 100 >= rate, "plain").when(draw[3] % 100 < suffix_first, "spm").otherwise("psm")
    shape = f"id {dict(docs.dtypes)[id_col]}, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.select("id", "text", draw[0].alias("x"), draw[1].alias("y"), form.alias("form")).mapInArrow(_transformed, shape).withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Texts with sentinels are plain, so each mark stands once in the others."""
    at = {m: F.locate(m, output) for m in (PREFIX, SUFFIX, MIDDLE)}
    between = lambda low, high: output.substr(at[low] + 3, at[high] - at[low] - 3)
    middle = output.substr(at[MIDDLE] + 3, F.length(output))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


ship(__name__)
