"""Near-duplicate documents by HyperMinHash.

Each document keeps 128 registers of 16 bits: the hashes of its shingles fall into 128 buckets, and a register holds the
leading-zero count and ten mantissa bits of its bucket's smallest hash. Empty registers borrow from another bucket in an
order that depends on the register alone. Four registers make a band; documents that share a band are candidates, an
estimate of the Jaccard similarity from equal registers, corrected for chance collisions, discards what is far below the
threshold, and full shingle sets decide the rest.

Equal sets are one class. Each class is first held against the smallest class that it shares a bucket with, which connects
most of what is near. The buckets that still hold several components are decided in full: their members are dealt into blocks
of bounded size, a task has two blocks in memory, counts all their intersections as products of incidence matrices and
returns a forest of links between components. No row is made for a pair, and no link is lost to a cap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, blobs, column, drop, longs, mix, powers, runs, save, ship, windows
from .components import components

SHINGLE = 5
REGISTERS, MANTISSA, BAND = 128, 10, 4
BANDS = REGISTERS // BAND
#: A pair passes the estimate if it lies within so many standard errors of the threshold.
SLACK = 5.0
#: Sets of a block, and hashes of its sets, about.
BLOCK, BLOCK_HASHES = 512, 1 << 19
#: Parts that the rows of one group of overlapping buckets are dealt into for a join.
SALTS = 16
#: Columns of an incidence matrix that are multiplied at once.
_COLUMNS = 4096
_BITS = REGISTERS.bit_length() - 1
_EMPTY = np.uint16(65535)
_PROBES = np.stack([np.random.Generator(np.random.PCG64(j)).permutation(REGISTERS) for j in range(REGISTERS)])


def shingles(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and the offsets of the texts."""
    w = Words(texts, lower=True)
    h, out, sizes = w.hashes, [], np.zeros(len(w.counts), np.int64)
    win = windows(h, k)
    for i, (a, n) in enumerate(zip(w.first[:-1].tolist(), w.counts.tolist(), strict=True)):
        if n == 0:
            continue
        if n < k:
            own = mix((h[a : a + n] * powers(np.uint64(0xA0761D6478BD642F), n)).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
        else:
            own = np.sort(win[a : a + n - k + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        out.append(own)
        sizes[i] = len(own)
    return np.concatenate(out) if out else np.empty(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def registers(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of registers for each set (of sorted distinct hashes); a row of an empty set is all _EMPTY."""
    n, of = len(offsets) - 1, np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out = np.full((n, REGISTERS), _EMPTY, np.uint16)
    bucket = (flat >> np.uint64(64 - _BITS)).astype(np.int64)
    cell = of * REGISTERS + bucket
    first = np.concatenate([[True], cell[1:] != cell[:-1]]) if len(cell) else np.empty(0, bool)
    low = (flat[first] << np.uint64(_BITS)) & np.uint64(0xFFFFFFFFFFFFF800)
    zeros = np.where(low == 0, 52, 64 - np.frexp(low.astype(np.float64))[1]).astype(np.uint64)
    bits = (low << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out.ravel()[cell[first]] = (zeros << np.uint64(MANTISSA) | bits).astype(np.uint16)
    own = out.copy()
    rows, cols = np.nonzero((out == _EMPTY) & (np.diff(offsets) > 0)[:, None])
    for k in range(REGISTERS):
        if not len(rows):
            break
        got = own[rows, _PROBES[cols, k]]
        out[rows, cols] = got
        left = got == _EMPTY
        rows, cols = rows[left], cols[left]
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in runs(batch.column(1)):
            flat, off = shingles(batch.column(1).slice(a, b - a))
            n, k1, k2 = np.diff(off), np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
            if len(flat):
                full = n > 0
                k1[full] = np.add.reduceat(mix(flat), off[:-1][full])
                k2[full] = np.bitwise_xor.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), off[:-1][full])
            bands = registers(flat, off).view(np.int64).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(bands) + 1, BANDS), pa.int32()), pa.array(bands, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), longs(n), longs(k1), longs(k2), lists], ["id", "n", "k1", "k2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in runs(batch.column(1)):
            flat, off = shingles(batch.column(1).slice(a, b - a))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), blobs(flat, off)], ["id", "hashes"])


def collision(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that registers of different shingles are equal, for sets of n and m shingles: both minima fall between the same
    powers of two, and within that range onto the same mantissa."""
    edge = 2.0 ** -np.arange(54)
    a, b = np.maximum(n, 1)[:, None] / REGISTERS, np.maximum(m, 1)[:, None] / REGISTERS
    a, b = np.maximum(a, 1.0), np.maximum(b, 1.0)  # borrowed registers hold the smallest of one hash at least
    la, lb = np.log1p(-np.minimum(edge, 1 - 1e-15)), np.log1p(-np.minimum(edge, 1 - 1e-15))
    pa_, pb = np.exp(a * la[1:]) - np.exp(a * la[:-1]), np.exp(b * lb[1:]) - np.exp(b * lb[:-1])
    return (pa_ * pb).sum(1) / 2**MANTISSA


def estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, less what collides by chance."""
    c = collision(n, m)
    return ((x == y).mean(1) - c) / (1 - c)


def _likely(share: float):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (np.asarray(batch.column(i), np.int64) for i in (2, 3))
            x, y = (np.asarray(batch.column(i).flatten()).view(np.uint16).reshape(-1, REGISTERS) for i in (4, 5))
            error = np.sqrt(share * (1 - share) / np.minimum(REGISTERS, np.minimum(n, m)))
            ok = estimate(x, y, n, m) >= share - SLACK * error
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(ok))

    return keep


def _verify(num: int, den: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([a, b]))
                common = int((both[1:] == both[:-1]).sum())
                ok.append(den * common >= num * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return keep


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets of distinct hashes."""
    m = len(sets)
    row = np.repeat(np.arange(m), [len(x) for x in sets])
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[col] > 1
    row, col = row[shared], col[shared]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    col = np.cumsum(np.append(True, col[1:] != col[:-1])) - 1 if len(col) else col
    out = np.zeros((m, m), np.float32)
    for a in range(0, int(col[-1]) + 1 if len(col) else 0, _COLUMNS):
        lo, hi = np.searchsorted(col, [a, a + _COLUMNS])
        x = np.zeros((m, _COLUMNS), np.float32)
        x[row[lo:hi], col[lo:hi] - a] = 1
        out += x @ x.T
    return out


def _decide(num: int, den: int):
    """From (key, i, j, cls, comp, hashes), sorted by the first three: links that connect different components of a group."""

    def forest(rows: list[tuple]) -> list[tuple[int, int]]:
        names, label = np.unique(np.array([r[1] for r in rows]), return_inverse=True)
        if len(names) < 2:
            return []
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        size = np.array([len(x) for x in sets], np.float64)
        common = intersections(sets).astype(np.float64)
        linked = den * common >= num * (size[:, None] + size[None, :] - common)
        a, b = np.nonzero(linked & (label[:, None] < label[None, :]))
        _, first = np.unique(label[a] * len(names) + label[b], return_index=True)
        up, out = list(range(len(names))), []

        def find(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for k in first.tolist():
            x, y = find(int(label[a[k]])), find(int(label[b[k]]))
            if x != y:
                up[max(x, y)] = min(x, y)
                out.append((rows[a[k]][0], rows[b[k]][0]))
        return out

    def links(rows: list[tuple]) -> pa.RecordBatch:
        found = forest(rows)
        return pa.RecordBatch.from_arrays([longs([x[0] for x in found]), longs([x[1] for x in found])], ["u", "v"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != now:
                    if rows:
                        yield links(rows)
                    now, rows = row[:3], []
                rows.append(row[3:])
        if rows:
            yield links(rows)

    return apply


def _parts(count: Column, hashes: Column) -> Column:
    return F.greatest(F.ceil(count / BLOCK), F.ceil(hashes / BLOCK_HASHES), F.lit(1)).cast("int")


def _blocks(undecided: DataFrame) -> DataFrame:
    """(key, i, j, cls, comp): what has to meet, from (bucket, cls, lo, comp, n). Buckets that overlap go together under the
    smallest of all their classes where that deals out fewer rows than the buckets do alone."""
    roots = components(undecided.select(F.col("cls").alias("u"), F.col("lo").alias("v")))
    rows = undecided.join(roots, undecided["cls"] == roots["node"], "left").select("bucket", "cls", "comp", "n", F.coalesce("component", "cls").alias("root"))
    once = rows.select("root", "cls", "comp", "n").distinct()
    whole = once.groupBy("root").agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("h")).withColumn("parts", _parts(F.col("g"), F.col("h")))
    whole = whole.join(rows.groupBy("root").agg(F.count(F.lit(1)).alias("m")), "root").select("root", "parts", (F.col("g") * F.col("parts") <= F.col("m")).alias("together"))
    # A root may have most of the rows, so both sides of its joins are salted.
    rows, once = (x.withColumn("salt", F.pmod(F.xxhash64("cls", F.lit("salt")), F.lit(SALTS)).cast("int")) for x in (rows, once))
    whole = whole.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    alone = rows.join(whole.where("not together").select("root", "salt"), ["root", "salt"], "left_semi")
    size = alone.groupBy("bucket").agg(_parts(F.count(F.lit(1)), F.sum("n")).alias("parts"))
    dealt = once.join(whole.where("together"), ["root", "salt"]).select(F.col("root").alias("key"), "cls", "comp", "parts")
    dealt = dealt.unionByName(alone.join(size, "bucket").select(F.col("bucket").alias("key"), "cls", "comp", "parts"))
    slot = F.pmod(F.xxhash64("cls", F.lit("slot")), F.col("parts")).cast("int")
    dealt = dealt.withColumn("slot", slot).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select("key", F.least("slot", "other").alias("i"), F.greatest("slot", "other").alias("j"), "cls", "comp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: tuple[int, int] = (3, 4)) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs; other columns of docs are ignored, whatever their names.

    Words are parted by ASCII white space and lower-cased in A-Z. Documents with Jaccard similarity of at least similarity
    (a fraction) are linked; component_id is the smallest id reachable. Null or empty texts have no shingles and link with
    nothing. Rows that repeat an id count as one document that has each of the texts. A null id links with nothing and
    gets a null component_id and kept = true. An empty table gives an empty result.
    """
    num, den = similarity
    docs = docs.select(column(docs, id_col).cast("long").alias("id"), column(docs, text_col).cast("string").alias("text"))
    signed = save(docs.mapInArrow(_sign, "id long, n long, k1 long, k2 long, bands array<long>"), "signed")
    classes = save(signed.where("n > 0 and id is not null").groupBy("k1", "k2", "n").agg(F.min("id").alias("cls"), F.first("bands").alias("bands")), "classes")
    # One or two shingles reach the threshold with an equal set only.
    banded = classes.where(F.col("n") >= 3).select("cls", F.posexplode("bands").alias("band", "regs")).select("cls", F.xxhash64("band", "regs").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").select("bucket", "lo")
    members = save(banded.join(shared, "bucket").select("bucket", "cls", "lo"), "members")
    needed = members.select("cls").distinct()
    sets = save(docs.join(needed, docs["id"] == needed["cls"], "left_semi").mapInArrow(_sets, "id long, hashes binary"), "sets")
    sketches = classes.select("cls", "n", "bands")

    def confirm(pairs: DataFrame) -> DataFrame:
        """The links among pairs(u, v)."""
        a, b = (sketches.select(F.col("cls").alias(k), F.col("n").alias(f"n_{k}"), F.col("bands").alias(f"bands_{k}")) for k in "uv")
        close = pairs.join(a, "u").join(b, "v").where(den * F.least("n_u", "n_v") >= num * F.greatest("n_u", "n_v"))
        close = close.select("u", "v", "n_u", "n_v", "bands_u", "bands_v").mapInArrow(_likely(num / den), "u long, v long")
        x, y = (sets.select(F.col("id").alias(k), F.col("hashes").alias(f"set_{k}")) for k in "uv")
        return close.join(x, "u").join(y, "v").select("u", "v", "set_u", "set_v").mapInArrow(_verify(num, den), "u long, v long")

    # First each class with the smallest class that it shares a bucket with: this settles most of what is linked at all.
    tried = save(members.where("cls > lo").groupBy(F.col("cls").alias("u")).agg(F.min("lo").alias("v")), "tried")
    links = save(confirm(tried), "links")
    labels = components(links)
    # What a bucket's members are not connected by yet is decided on full sets, block by block.
    now = members.join(labels, members["cls"] == labels["node"], "left").select("bucket", "cls", "lo", F.coalesce("component", "cls").alias("comp"))
    parted = now.groupBy("bucket").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 < c2").select("bucket")
    undecided = save(now.join(parted, "bucket"), "undecided")
    if not undecided.isEmpty():
        more = _blocks(undecided.join(classes.select("cls", "n"), "cls")).join(sets.select(F.col("id").alias("cls"), "hashes"), "cls")
        more = more.select("key", "i", "j", "cls", "comp", "hashes").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        more = save(more.mapInArrow(_decide(num, den), "u long, v long"), "links")
        labels = components(links.union(more))
        drop(more)
    drop(members, sets, tried, links, undecided)
    own = classes.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.col("n").alias("cn"), "cls")
    found = signed.join(own, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("n") == F.col("cn")) & F.col("id").isNotNull(), "left")
    found = found.select("id", "n", "cls").join(labels, F.col("cls") == F.col("node"), "left")
    component = F.coalesce("component", "cls", "id")
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


ship(__name__)
