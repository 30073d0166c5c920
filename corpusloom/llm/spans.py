"""Spans of pattern matches as native columns: what a pattern leaves between its matches gives their places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches whose places are summed together.
BLOCK = 128
SPANS = "array<struct<kind:string,start:long,end:long>>"


def let(value: Column, how: Callable[[Column], Column]) -> Column:
    """how(value) with value computed once."""
    return F.transform(F.array(value), how)[0]


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, m>>: the leftmost non-overlapping matches, places in code points, end exclusive."""
    shape = "array<struct<start:long,end:long,m:string>>"

    def add(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        return F.struct(end.cast("long").alias("pos"), F.concat(acc["out"], F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), x["m"].alias("m")))).alias("out"))

    # Appending copies an array, so places are summed within blocks, then over the blocks' lengths: linear in all but name.
    def local(block: Column) -> Column:
        return F.aggregate(block, F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast(shape).alias("out")), add)

    def blocks(cut: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(cut) - 1) / BLOCK).cast("int")), lambda b: local(F.slice(cut, b * BLOCK + 1, F.lit(BLOCK))))

    def bases(parts: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<long>").alias("out"))
        return F.aggregate(parts, start, lambda acc, p: F.struct((acc["pos"] + p["pos"]).alias("pos"), F.concat(acc["out"], F.array(acc["pos"])).alias("out")), lambda acc: acc["out"])

    def moved(p: Column, base: Column) -> Column:
        return F.transform(p["out"], lambda x: F.struct((x["start"] + base).alias("start"), (x["end"] + base).alias("end"), x["m"].alias("m")))

    cut = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    found = lambda c: F.when(F.size(c) == 0, F.array().cast(shape)).otherwise(let(blocks(c), lambda parts: F.flatten(F.zip_with(parts, bases(parts), moved)).cast(shape)))
    return let(F.filter(cut, lambda x: x["m"].isNotNull()), found)


def spans(text: Column, kind: str, pattern: str, valid: Callable[[Column], Column] | None = None, only_if: Column | None = None) -> Column:
    """SPANS of the matches that are valid; a failing match is dropped with all it covers. Where only_if is false there is none."""
    found = matches(text, pattern)
    if valid is not None:
        found = F.filter(found, lambda x: valid(x["m"]))
    out = F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).cast(SPANS)
    none = F.array().cast(SPANS)
    return out if only_if is None else F.when(only_if, out).otherwise(none)


def overlapping(a: Column, b: Column, how: Callable[[Column, Column], Column]) -> Column:
    """how(x, the spans of b that overlap x) for each span x of a, which goes by start. Blocks of a are held against b first, and
    their parts against what is left of it, so many spans in one text cost little more than their number."""
    return let(a, lambda a_: let(b, lambda b_: _overlapping(a_, b_, how, (BLOCK * 32, BLOCK))))


def _overlapping(a: Column, b: Column, how: Callable[[Column, Column], Column], sizes: tuple[int, ...]) -> Column:
    meets = lambda y, low, high: (y["start"] < high) & (y["end"] > low)
    if not sizes:
        return F.transform(a, lambda x: how(x, F.filter(b, lambda y: meets(y, x["start"], x["end"]))))
    n = sizes[0]

    def part(k: Column) -> Column:
        reach = lambda p: F.struct(p[0]["start"].alias("low"), F.array_max(F.transform(p, lambda x: x["end"])).alias("high"))
        near = lambda p: let(reach(p), lambda r: F.filter(b, lambda y: meets(y, r["low"], r["high"])))
        return let(F.slice(a, k * n + 1, F.lit(n)), lambda p: let(near(p), lambda rest: _overlapping(p, rest, how, sizes[1:])))

    return F.flatten(F.transform(_blocks(a, n), part))


def _blocks(a: Column, n: int = BLOCK) -> Column:
    """0, 1, ... for each n items of a."""
    return F.filter(F.sequence(F.lit(0), F.floor(F.size(a) / n).cast("int")), lambda k: k * n < F.size(a))


def highest_before(values: Column) -> Column:
    """For each of an array's longs the highest of those before it, or 0."""
    top = lambda x: F.coalesce(F.array_max(x), F.lit(0).cast("long"))

    def scan(parts: Column) -> Column:
        tops = F.transform(parts, F.array_max)
        within = lambda p, base: F.transform(p, lambda _, i: F.greatest(base, top(F.slice(p, F.lit(1), i))))
        return F.flatten(let(tops, lambda t: F.transform(parts, lambda p, k: let(top(F.slice(t, F.lit(1), k)), lambda base: within(p, base)))))

    return let(F.transform(_blocks(values), lambda k: F.slice(values, k * BLOCK + 1, F.lit(BLOCK))), scan)


def replaced(text: Column, all_spans: Column, mark: Callable[[Column], Column]) -> Column:
    """text with each group of overlapping spans replaced by mark(kind), the kind of its first span."""
    sorted_ = F.array_sort(F.transform(all_spans, lambda s: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), s["kind"].alias("k"))))

    def cut(spans_: Column, ends: Column) -> Column:
        both = F.arrays_zip(spans_.alias("s"), highest_before(ends).alias("from"))
        heads = F.transform(F.filter(both, lambda x: x["s"]["a"] >= x["from"]), lambda x: F.struct(x["from"].alias("from"), x["s"]["a"].alias("to"), x["s"]["k"].alias("k")))
        tail = F.substring(text, (F.array_max(ends) + 1).cast("int"), F.length(text))

        # A block's stretch of the text is cut out once, then its pieces from that.
        def pieces(p: Column) -> Column:
            base = p[0]["from"]
            stretch = F.substring(text, (base + 1).cast("int"), (F.element_at(p, -1)["to"] - base).cast("int"))
            piece = lambda t, h: F.concat(F.substring(t, (h["from"] - base + 1).cast("int"), (h["to"] - h["from"]).cast("int")), mark(h["k"]))
            return let(stretch, lambda t: F.array_join(F.transform(p, lambda h: piece(t, h)), ""))

        return let(heads, lambda hs: F.concat(F.array_join(F.transform(_blocks(hs), lambda k: let(F.slice(hs, k * BLOCK + 1, F.lit(BLOCK)), pieces)), ""), tail))

    done = let(sorted_, lambda s: let(F.transform(s, lambda x: -x["b"]), lambda ends: cut(s, ends)))
    return F.when(F.size(all_spans) > 0, done).otherwise(text)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def ordered(all_spans: Column, kinds: list[str], by_kind_first: bool) -> Column:
    """Spans by kind as listed (kinds not listed last), then start, or by start first."""
    place = lambda s: F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(k) for k in kinds)), s["kind"]), F.lit(0)), F.lit(len(kinds) + 1)).cast("long")
    keyed = F.transform(all_spans, lambda s: F.struct(*((place(s).alias("a"), s["start"].alias("b")) if by_kind_first else (s["start"].alias("a"), place(s).alias("b"))), s["end"].alias("c"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def count(all_spans: Column, kind: str) -> Column:
    return F.size(F.filter(all_spans, lambda s: s["kind"] == kind)).cast("long")
