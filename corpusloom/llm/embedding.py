"""Near-duplicate vectors by an exact metric range join.

On the unit sphere cosine >= c is a distance <= r. Pivots, about as many as the root of the number of vectors, part them: each
vector is at home in its nearest pivot's cell. By the triangle inequality a vector can have a partner in a cell only if its
distance to the cell's pivot lies within r of the cell's radii, and its distance to the plane between the two pivots is at most
r. Cells that lie near each other make up groups of bounded size (a cell that is larger is parted), and a vector is sent once
to each group with a cell that it has to visit. Groups join independently, and slices of a group's visitors too: the home
vectors stay in memory by cell, visitors stream past, and the same bounds pick the cells that each batch is multiplied with. Of
a link, each end counts the other at the other's home. A task yields a row for a visitor that has links, never its pairs, and a
spanning forest of its own vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, drop, longs, save, ship
from .components import components

#: Bytes of the pivots of one length, which every task has, and of the home vectors of a group.
PIVOT_BYTES, HOME_BYTES = 4 << 20, 32 << 20
#: Groups and slices of visitors at least, and visitors of a slice, about.
GROUPS, SLICES, VISITORS = 4, 4, 1_000_000
#: Vectors that are compared at once, with so many others at most.
ROWS, COLUMNS = 1024, 8192
#: Room for rounding in bounds; single precision screens with its own.
_SLACK, _SINGLE = 1e-6, 1e-4


def unit(lists: pa.Array) -> np.ndarray:
    """Vectors (of one length, without nulls) in double precision at length one."""
    flat = np.asarray(lists.flatten(), np.float64)
    x = flat.reshape(len(lists), -1) if len(lists) else np.empty((0, 0))
    x = x / np.abs(x).max(1, keepdims=True)  # else squares may overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _by_length(batches: Iterator[pa.RecordBatch], col: int) -> Iterator[pa.RecordBatch]:
    """Batches whose vectors have one length each, in order."""
    for batch in batches:
        n = np.asarray(pa.compute.list_value_length(batch.column(col)))
        cuts = np.concatenate([[0], np.flatnonzero(n[1:] != n[:-1]) + 1, [len(n)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * x @ pivots.T))


def _home(pivots: dict[int, np.ndarray]):
    """From (cls, copies, v): (cls, copies, v, dim, cell, far), the nearest pivot and the distance to it."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_length(batches, 2):
            x = unit(batch.column(2))
            p = pivots[x.shape[1]]
            step = max(64, (1 << 22) // len(p))
            d = [(part.argmin(1), part.min(1)) for part in (distances(x[a : a + step], p) for a in range(0, len(x), step))]
            cell, far = (np.concatenate(c) for c in zip(*d, strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns, longs(np.full(len(x), x.shape[1])), longs(cell), pa.array(far)], ["cls", "copies", "v", "dim", "cell", "far"])

    return apply


class Layout:
    """The pivots of one length, their cells' radii and sizes, and the groups that the cells are dealt into."""

    def __init__(self, pivots: np.ndarray, radii: dict[int, tuple[float, float, int]], first: int, r: float):
        p = self.pivots = pivots
        self.near, self.far, size = (np.array([radii.get(c, (9.0, -9.0, 0))[k] for c in range(len(p))]) for k in range(3))
        self.size, self.r, self.first = size.astype(np.int64), r, first
        total = int(self.size.sum())
        groups = max(GROUPS, -(-total * 8 * p.shape[1] // HOME_BYTES))
        room = max(1, -(-total // groups))
        self.slices = max(SLICES, -(-total // VISITORS))
        # Cells in the order of the pivots' main direction, each parted into units of at most room vectors; groups fill up with units.
        line = p @ np.linalg.svd(p - p.mean(0), full_matrices=False)[2][0]
        self.parts = np.maximum(1, -(-self.size // room))
        self.cells = np.repeat(np.argsort(line, kind="stable"), self.parts[np.argsort(line, kind="stable")])  # of each unit
        ends = np.cumsum(self.size[self.cells] / self.parts[self.cells])
        self.group = np.minimum((ends - 1e-9).clip(0) // room, groups - 1).astype(np.int64)  # of each unit
        self.starts = np.flatnonzero(np.append(True, self.group[1:] != self.group[:-1]))
        order = np.argsort(self.cells, kind="stable")
        self.units, self.unit_of = order, np.searchsorted(self.cells[order], np.arange(len(p)))
        self.blocks = (int(self.group[-1]) + 1) * self.slices

    def own_block(self, cell: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """The group that a vector is at home in."""
        return self.group[self.units[self.unit_of[cell] + salt % self.parts[cell]]]

    def visits(self, d: np.ndarray, own: np.ndarray, home: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Which of cells each vector may have partners in, by its distances d to their pivots and own to its home's."""
        apart = distances(self.pivots[cells], self.pivots[home]).T
        plane = d * d - own[:, None] ** 2 <= 2 * (self.r + _SLACK) * apart + _SLACK
        out = plane & (d <= self.far[cells] + self.r + _SLACK) & (d >= self.near[cells] - self.r - _SLACK) & (self.size[cells] > 0)
        return out | (cells[None, :] == home[:, None])


def _visit(layouts: dict[int, Layout]):
    """From homes: (block, visitor, cls, copies, v, cell, far), at home a row for each slice, and one for each group to visit."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_length(batches, 2):
            lay = layouts[int(batch.column(3)[0].as_py())] if batch.num_rows else None
            step = max(64, min(ROWS, (1 << 21) // len(lay.pivots))) if lay else 1
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                home, n = np.asarray(part.column(4), np.int64), part.num_rows
                salt = (np.asarray(part.column(0), np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                go = lay.visits(distances(unit(part.column(2)), lay.pivots), np.asarray(part.column(5)), home, np.arange(len(lay.pivots)))
                who, at = np.nonzero(np.logical_or.reduceat(go[:, lay.cells], lay.starts, axis=1))
                visited = lay.group[lay.starts][at] * lay.slices + salt[who] // 7919 % lay.slices
                own = np.repeat(lay.own_block(home, salt) * lay.slices, lay.slices) + np.tile(np.arange(lay.slices), n)
                whose = np.concatenate([np.repeat(np.arange(n), lay.slices), who])
                block = lay.first + np.concatenate([own, visited])
                role = np.repeat([0, 1], [len(own), len(visited)])
                for k in range(0, len(whose), 16 * ROWS):
                    taken = part.take(pa.array(whose[k : k + 16 * ROWS]))
                    yield pa.RecordBatch.from_arrays([longs(block[k : k + 16 * ROWS]), longs(role[k : k + 16 * ROWS]), *(taken.column(i) for i in (0, 1, 2, 4, 5))], ["block", "visitor", "cls", "copies", "v", "cell", "far"])

    return apply


class Block:
    """The home vectors of a group by cell, the labels of what is connected there, and the products with visitors."""

    def __init__(self, cos: float):
        self.cos, self.parts, self.ready = cos, [], False

    def add(self, ids: np.ndarray, copies: np.ndarray, x: np.ndarray, cell: np.ndarray) -> None:
        self.parts.append((cell, ids, copies, x))

    def close(self) -> None:
        cell, self.ids, self.copies, self.x = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((self.ids, cell))
        cell, self.ids, self.copies, self.x = cell[order], self.ids[order], self.copies[order], self.x[order]
        self.begin = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        self.cells, self.end = cell[self.begin], np.append(self.begin[1:], len(cell))
        self.single, self.label, self.parts, self.ready = self.x.astype(np.float32), np.arange(len(cell)), [], True

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        """Gives what is connected by (a, b) one label, the smallest place of them."""
        while True:
            la, lb = self.label[a], self.label[b]
            if (la == lb).all():
                return
            np.minimum.at(self.label, np.maximum(la, lb), np.minimum(la, lb))
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]

    def links(self, ids: np.ndarray, x: np.ndarray, cell: np.ndarray, far: np.ndarray, lay: Layout) -> Iterator[pa.RecordBatch]:
        """(visitor, linked vectors with copies, a linked class) for the visitors with a partner other than themselves."""
        if not self.ready:
            if not self.parts:  # a part of a cell that no vector fell into
                return
            self.close()
        go = lay.visits(distances(x, lay.pivots[self.cells]), far, cell, self.cells)
        single = x.astype(np.float32)
        if go.mean() > 0.5:
            for a in range(0, len(self.ids), COLUMNS):
                yield from self.meet(np.arange(len(ids)), a, min(a + COLUMNS, len(self.ids)), ids, x, single)
        else:
            for c in np.flatnonzero(go.any(0)).tolist():
                for a in range(self.begin[c], self.end[c], COLUMNS):
                    yield from self.meet(np.flatnonzero(go[:, c]), a, min(a + COLUMNS, self.end[c]), ids, x, single)

    def meet(self, who: np.ndarray, a: int, b: int, ids: np.ndarray, x: np.ndarray, single: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Single precision screens, with a margin wider than its error; double precision decides."""
        rows, cols = np.nonzero(single[who] @ self.single[a:b].T >= np.float32(self.cos - _SINGLE))
        rows, cols = who[rows], cols + a
        keep = ids[rows] != self.ids[cols]
        rows, cols = rows[keep], cols[keep]
        sure = [(x[rows[k : k + (1 << 16)]] * self.x[cols[k : k + (1 << 16)]]).sum(1) >= self.cos for k in range(0, len(rows), 1 << 16)]
        if not sure or not (keep := np.concatenate(sure)).any():
            return
        rows, cols = rows[keep], cols[keep]
        begins = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        self.unite(np.repeat(cols[begins], np.diff(np.append(begins, len(rows)))), cols)
        yield _edges(ids[rows[begins]], np.add.reduceat(self.copies[cols], begins), self.ids[cols[begins]])

    def forest(self) -> Iterator[pa.RecordBatch]:
        if self.ready:  # without visitors nothing is connected
            i = np.flatnonzero(self.label != np.arange(len(self.label)))
            yield _edges(self.ids[i], np.zeros(len(i), np.int64), self.ids[self.label[i]])


def _edges(u: np.ndarray, links: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([longs(u), longs(links), longs(v)], ["u", "links", "v"])


def _join(cos: float, layouts: dict[int, Layout]):
    """From dealt rows, sorted by block and visitor: (u, links, v), u linked (directly or through others) with v."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, Block(cos)
        for batch in _by_length(batches, 4):
            blocks, roles, ids, copies, cell = (np.asarray(batch.column(i), np.int64) for i in (0, 1, 2, 3, 5))
            x, far = unit(batch.column(4)), np.asarray(batch.column(6))
            cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (roles[1:] != roles[:-1])) + 1
            for a, b in zip(np.append(0, cuts).tolist(), np.append(cuts, len(blocks)).tolist(), strict=True):
                if a == b:
                    continue
                if blocks[a] != now:
                    yield from block.forest()
                    now, block = blocks[a], Block(cos)
                if roles[a] == 0:
                    block.add(ids[a:b], copies[a:b], x[a:b], cell[a:b])
                else:
                    for k in range(a, b, ROWS):
                        to = min(b, k + ROWS)
                        yield from block.links(ids[k:to], x[k:to], cell[k:to], far[k:to], layouts[x.shape[1]])
        yield from block.forest()

    return apply


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """id_col, n_links (other vectors with at least this cosine), component_id, kept for each row of vectors.

    component_id is the smallest id reachable by links. Vectors that are null, empty or zero, or hold null or non-finite
    components, link with nothing, and so do vectors of different lengths with each other. Rows with equal vectors are linked,
    rows that repeat an id too, each counted. A null id counts for others' n_links but leads nowhere: its own component is
    null and kept is true. Other columns are ignored. An empty table gives an empty result.
    """
    # Vectors move as they are stored; what is computed from them is double.
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = vectors.select(column(vectors, id_col).cast("long").alias("id"), column(vectors, vector_col).cast(kind).alias("v"))
    usable = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.select("id", "v", usable.alias("ok"), *(F.when(usable, F.xxhash64(F.lit(k), "v")).alias(f"k{k}") for k in (1, 2)))
    # A class of equal vectors is one; it goes by its smallest id, below all others by a hash where no row has an id.
    classes = rows.where("ok").groupBy("k1", "k2").agg(F.min("id").alias("lo"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    classes = save(classes.select("k1", "k2", "lo", "copies", "v", F.coalesce(F.col("lo"), F.col("k1")).alias("cls")), "classes")
    counts = {x["dim"]: x["n"] for x in classes.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    pivots = {}
    for dim, n in sorted(counts.items()):
        # About as many as the root of n, by a hash below a bound: no task gives more than its share. The least hash is always one.
        few = min(int(np.ceil(np.sqrt(n))), max(1, PIVOT_BYTES // (8 * dim)))
        own = classes.where(F.size("v") == dim).select(F.xxhash64(F.lit("pivot"), "k1", "k2").alias("h"), "v")
        bound = max(own.agg(F.min("h")).first()[0], -(2**63) + min(2**64 - 1, 2**64 * few // n))
        picked = own.where(F.col("h") <= bound).orderBy("h").select("v").toArrow().column(0)
        pivots[dim] = unit(pa.concat_arrays(picked.chunks))
    r = float(np.sqrt(2 - 2 * cosine))
    homes = save(classes.select("cls", "copies", "v").mapInArrow(_home(pivots), f"cls long, copies long, v {kind}, dim long, cell long, far double"), "homes")
    stats = homes.groupBy("dim", "cell").agg(F.min("far").alias("near"), F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect()
    layouts, blocks = {}, 0
    for dim, p in pivots.items():
        layouts[dim] = Layout(p, {x["cell"]: (x["near"], x["far"], x["n"]) for x in stats if x["dim"] == dim}, blocks, r)
        blocks += layouts[dim].blocks
    dealt = homes.mapInArrow(_visit(layouts), f"block long, visitor long, cls long, copies long, v {kind}, cell long, far double")
    dealt = dealt.repartitionById(max(1, blocks), F.col("block").cast("int"))
    edges = save(dealt.sortWithinPartitions("block", "visitor").mapInArrow(_join(cosine, layouts), "u long, links long, v long"), "edges")
    drop(homes)
    labels = components(edges.select("u", "v"))
    counted = edges.groupBy("u").agg(F.sum("links").alias("links"))
    named = classes.join(counted, F.col("cls") == F.col("u"), "left").join(labels, F.col("cls") == F.col("node"), "left")
    named = named.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "cls").alias("comp"))
    out = rows.drop("v").join(named, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("comp", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


import pyarrow.compute  # noqa: E402, F401

ship(__name__)
