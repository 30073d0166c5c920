"""Quality rules as a short-circuit cascade.

Every rule has a measure and a verdict. On a bounded sample the driver takes what each measure has to touch (bytes, words, and
words sorted: a count, so reruns agree) and each rule's share of rejections; rules are then applied in the order of rejections
per cost, and a later rule's measure is taken for the documents only that all earlier rules let pass. The order decides what a
run costs, never which documents it keeps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _SPACE, Words, column, mix, powers, runs, ship, windows

#: Documents, about, that costs and selectivities are estimated on, and the longest of them: they bound what the driver holds.
SAMPLE_DOCS, SAMPLE_CHARS = 400, 1 << 16
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_ANY = np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, 256, dtype=np.uint64)


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    at = offsets.tolist()
    return np.fromiter((np.count_nonzero(flags[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)), np.int64, len(at) - 1)


def n_words(w: Words) -> dict[str, np.ndarray]:
    return {"n_words": w.counts.astype(np.int64)}


def word_chars(w: Words) -> dict[str, np.ndarray]:
    return {"n_words": w.counts.astype(np.int64), "word_chars": _per_text(((w.data & 0xC0) != 0x80) & ~_SPACE[w.data], w.offsets)}


def n_symbols(w: Words) -> dict[str, np.ndarray]:
    return {"n_words": w.counts.astype(np.int64), "n_symbols": _per_text(_SYMBOL[w.data], w.offsets)}


def n_dup_lines(w: Words) -> dict[str, np.ndarray]:
    n, texts = len(w.data), len(w.counts)
    out, lines = np.zeros(texts, np.int64), np.zeros(texts, np.int64)
    if len(w.starts):
        # Only lines that hold a word matter: the line of each word, by the last line break or text start before it.
        breaks = np.union1d(np.flatnonzero(w.data == 10) + 1, w.offsets[:-1])
        line = np.searchsorted(breaks, w.starts, "right") - 1
        first = np.concatenate([[True], line[1:] != line[:-1]])
        begin, of = breaks[line[first]], w.text_of[first]
        stop = np.append(breaks, n + 1)[line[first] + 1] - 1
        last = np.searchsorted(w.offsets, begin, "right")
        stop = np.where((stop < n) & (w.data[np.minimum(stop, n - 1)] == 10), stop, w.offsets[np.minimum(last, texts)])
        stop = np.minimum(stop, w.offsets[of + 1])
        cut = np.stack([begin, np.maximum(stop, begin + 1)], 1).ravel()
        size = int((stop - begin).max())
        pos = np.arange(n) - np.repeat(np.append(0, begin), np.diff(np.concatenate([[0], begin, [n]])))
        terms = np.append(_ANY[w.data] * powers(np.uint64(0x9FB21C651E98DF25), size + 1)[np.minimum(pos, size)], np.uint64(0))
        keys = mix(mix(np.add.reduceat(terms, cut)[::2] + (stop - begin).astype(np.uint64)) ^ mix(of.astype(np.uint64)))
        order = np.argsort(keys, kind="stable")
        again = np.zeros(len(keys), bool)
        again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
        out, lines = np.bincount(of[again], minlength=texts), np.bincount(of, minlength=texts)
    return {"n_dup_lines": out.astype(np.int64), "n_lines": lines.astype(np.int64)}


def n_repeat_words(w: Words, k: int = 5) -> dict[str, np.ndarray]:
    words, of = len(w.starts), w.text_of
    covered = np.zeros(words, bool)
    if words >= k:
        keys = windows(w.hashes, k)
        at = np.flatnonzero(of[: words - k + 1] == of[k - 1 :])
        keys = mix(keys[at] ^ mix(of[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        step = np.zeros(words + 1, np.int64)
        np.add.at(step, at[twice], 1)
        np.add.at(step, at[twice] + k, -1)
        covered = np.cumsum(step)[:-1] > 0
    return {"n_words": w.counts.astype(np.int64), "n_repeat_words": _per_text(covered, w.first)}


def n_digits(w: Words) -> dict[str, np.ndarray]:
    return word_chars(w) | {"n_digits": _per_text((w.data >= 48) & (w.data <= 57), w.offsets)}


def n_top_word(w: Words) -> dict[str, np.ndarray]:
    """How often a text has its most frequent word."""
    out = np.zeros(len(w.counts), np.int64)
    if len(w.starts):
        of = w.text_of
        order = np.lexsort((w.hashes, of))
        key, of = w.hashes[order], of[order]
        begins = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (of[1:] != of[:-1])))
        np.maximum.at(out, of[begins], np.diff(np.append(begins, len(of))))
    return {"n_words": w.counts.astype(np.int64), "n_top_word": out}


def n_marked_lines(w: Words) -> dict[str, np.ndarray]:
    """Lines that hold a word, those whose first word starts with - or *, and those whose last word ends in three dots."""
    texts, of = len(w.counts), w.text_of
    if not len(w.starts):
        return dict.fromkeys(("n_worded_lines", "n_bullets", "n_ellipses"), np.zeros(texts, np.int64))
    line = np.concatenate([[0], np.cumsum(w.data == 10)])[w.starts]
    change = (line[1:] != line[:-1]) | (of[1:] != of[:-1])
    first, last = np.append(True, change), np.append(change, True)
    head = w.data[w.starts[first]]
    dots = np.ones(int(last.sum()), bool)
    for k in (1, 2, 3):
        dots &= w.data[np.maximum(w.ends[last] - k, w.starts[last])] == 46
    dots &= w.ends[last] - w.starts[last] >= 3
    count = lambda rows: np.bincount(rows, minlength=texts).astype(np.int64)
    return {"n_worded_lines": count(of[first]), "n_bullets": count(of[first][(head == 45) | (head == 42)]), "n_ellipses": count(of[last][dots])}


def _bytes(w: Words) -> float:
    return len(w.data)


def _texts(w: Words) -> float:
    return len(w.counts)


def _words(w: Words) -> float:
    return 4 * len(w.starts)


def _sorted_words(w: Words) -> float:
    return len(w.data) + len(w.starts) * (8 + np.log2(len(w.starts) + 2))


@dataclass(frozen=True)
class Rule:
    """A measure, what it touches in some texts, and which texts are rejected by it."""

    name: str
    measure: Callable[[Words], dict[str, np.ndarray]]
    cost: Callable[[Words], float]
    rejects: Callable[[dict[str, np.ndarray]], np.ndarray]


#: The contract's base rules, then those that only what passes has to be measured for.
RULES = (
    Rule("too_few_words", n_words, _texts, lambda m: m["n_words"] < 10),
    Rule("repeated_words", n_repeat_words, _sorted_words, lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    Rule("symbols", n_symbols, _bytes, lambda m: 4 * m["n_symbols"] > m["n_words"]),
    Rule("duplicate_lines", n_dup_lines, _bytes, lambda m: 2 * m["n_dup_lines"] > m["n_lines"]),
    Rule("word_length", word_chars, _bytes, lambda m: (2 * m["word_chars"] < 3 * m["n_words"]) | (m["word_chars"] > 40 * m["n_words"])),
    Rule("digits", n_digits, _bytes, lambda m: 10 * m["n_digits"] > 3 * m["word_chars"]),
    Rule("marked_lines", n_marked_lines, _words, lambda m: (m["n_worded_lines"] >= 5) & ((10 * m["n_bullets"] > 9 * m["n_worded_lines"]) | (10 * m["n_ellipses"] > 3 * m["n_worded_lines"]))),
    Rule("one_word", n_top_word, _sorted_words, lambda m: (m["n_words"] >= 20) & (10 * m["n_top_word"] > 4 * m["n_words"])),
)
#: The measures that may be asked for all documents, and what takes them.
TAKERS = (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")


def sample(docs: DataFrame, text_col: str) -> pa.Array:
    """About SAMPLE_DOCS texts of at most SAMPLE_CHARS. A hash of the whole row below a bound picks them, so a task gives no more
    than its share, however many tasks there are; copies under different ids fall apart; and a limit holds for copied rows."""
    names = [f for f in docs.schema.fields if not any(k in f.dataType.simpleString() for k in ("map", "variant"))]
    n = docs.count()
    bound = -(2**63) + min(2**64 - 1, 2**64 * SAMPLE_DOCS // max(n, 1))
    row = F.xxhash64(*(column(docs, f.name) for f in names))
    texts = docs.select(column(docs, text_col).cast("string").alias("t"), row.alias("h")).where((F.col("h") <= bound) & (F.length("t") <= SAMPLE_CHARS))
    got = texts.select("t").limit(2 * SAMPLE_DOCS).toArrow().column(0)
    return pa.concat_arrays(got.chunks) if got.num_chunks else pa.array([], pa.string())


def order_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, paid: tuple = ()) -> list[Rule]:
    """The rules by rejections per cost on sample(), most first; ties by place in rules. Measures in paid are taken anyhow and
    cost no more than a look. The sample sets the order alone: all documents are judged."""
    texts = sample(docs, text_col)
    spent, hits = dict.fromkeys((r.name for r in rules), 1.0), dict.fromkeys((r.name for r in rules), 0)
    for a, b in runs(texts):
        w = Words(texts.slice(a, b - a))
        for r in rules:
            hits[r.name] += int(r.rejects(r.measure(w)).sum())
            spent[r.name] += _texts(w) if r.measure in paid else r.cost(w)
    return sorted(rules, key=lambda r: -hits[r.name] / spent[r.name])


def _cascade(rules: list[Rule], complete: bool):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in runs(batch.column(1)):
                size, w = b - a, Words(batch.column(1).slice(a, b - a))
                got = {m: np.full(size, -1, np.int64) for m in MEASURES}
                failed, tried, alive = np.full(size, -1), np.zeros(size, np.int64), np.arange(size)
                held = alive  # the texts that w has
                for take in TAKERS if complete else ():
                    got |= take(w)
                for i, rule in enumerate(rules):
                    if not len(alive):
                        break
                    if complete and rule.measure in TAKERS:
                        m = {k: v[alive] for k, v in got.items()}
                    else:
                        w, held = w.take(np.searchsorted(held, alive)), alive
                        m = rule.measure(w)
                        for k in m.keys() & got.keys():
                            got[k][alive] = m[k]
                    bad = rule.rejects(m)
                    tried[alive] += 1
                    failed[alive[bad]] = i
                    alive = alive[~bad]
                names = pa.array([None if i < 0 else rules[i].name for i in failed], pa.string())
                cols = [pa.array(got[m], pa.int64(), mask=got[m] < 0) for m in MEASURES]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, size), *cols, names, pa.array(tried)], ["id", *MEASURES, "failed_rule", "n_rules"])

    return apply


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, rules: tuple[Rule, ...] = RULES, complete: bool = False) -> DataFrame:
    """id_col, the measures, failed_rule (null if none), n_rules (how many were tried), kept: one row for each row of docs; its
    other columns are ignored.

    A measure that the cascade had no need to take is null, unless complete asks for MEASURES of all rows; the rules beyond
    them are tried on what is left even so. failed_rule is the first rule, in the estimated order, that rejects the document.
    Null or empty texts have no words and so fail too_few_words. Repeated rows are judged each; ids, null or not, pass
    through. An empty table gives an empty result.
    """
    order = order_rules(docs, text_col, rules, TAKERS if complete else ())
    ids = dict(docs.dtypes).get(id_col, "bigint")
    judged = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).cast("string").alias("text")).mapInArrow(_cascade(order, complete), f"id {ids}, " + ", ".join(f"{m} long" for m in MEASURES) + ", failed_rule string, n_rules long")
    return judged.select(F.col("id").alias(id_col), *MEASURES, "failed_rule", "n_rules", F.col("failed_rule").isNull().alias("kept"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs, all columns, that no rule rejects."""
    order = order_rules(docs, text_col, rules)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _cascade(order, False)
        for batch in batches:
            for a, b in runs(batch.column(at)):
                part = batch.slice(a, b - a)
                texts = pa.RecordBatch.from_arrays([pa.nulls(b - a, pa.int64()), part.column(at)], ["id", "text"])
                failed = pa.concat_arrays([v.column("failed_rule") for v in judge(iter([texts]))])
                yield part.filter(pa.compute.is_null(failed))

    # Columns go by place, as their names may hold dots or clash.
    placed = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return placed.mapInArrow(keep, placed.schema).toDF(*docs.columns)


ship(__name__)
