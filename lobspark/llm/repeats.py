"""Strings of a fixed length that repeat in a corpus: what the byte and the word operator share.

A window is `size` consecutive elements (bytes or words) of one text. Each window names as its anchor the gram with the
smallest hash inside it, the leftmost of equals; equal windows name equal anchors at equal places. Consecutive windows
with one anchor are a run. Anchors are the shortest prefixes that suffixes are dealt by:

1. write the runs' anchors (a few hundredths of the elements) and keep those that occur more than once,
2. cut the kept runs' texts out of the documents, and reduce equal ones to one row with a count and the smallest id,
3. give all distinct runs of an anchor to one solver, which builds their order (suffix arrays, suffix trees) and reads from
   it for each window how often, and from which id on, it occurs,
4. send that back to the runs, and from these to their documents.

Dealing only narrows the search; which windows are equal is decided by the solvers on full contents.

Scale: steps 1 and 2 are hash aggregates with map-side combining and joins, so a passage that a third of all documents
hold doesn't gather in a task. An anchor with more than `group` distinct runs is split by longer strings around it: a
window that starts d elements before the anchor belongs to the part d // width, and the part's core (what all its windows
have in common) takes the anchor's place. Cores grow by narrower parts until groups fit; at last a core is a whole window,
whose group is a single string. Parts whose core occurs once go no further. A stretch of text that repeats itself (one
byte a million times) is one run with a number of times. Texts are written once and read three times; nothing depends on
rows staying in place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import shared

#: Elements of a segment; hashes and places share a 64-bit key, places take its low bits. Elements hashed at once.
SEGMENT = 1 << 16
AT_ONCE = 1 << 17
#: Distinct runs of one anchor that a solver takes at once.
GROUP = 64
#: Rows and bytes of text that are worked on at once (a longer text alone), and bytes of pieces sent on at once.
ROWS, TEXT_BYTES, PIECE_BYTES = 400, 1 << 22, 1 << 25
LAST = (1 << 63) - 1  # the order of rows without an id

MARK = pa.list_(pa.struct([("least", pa.int64()), ("s", pa.int32()), ("e", pa.int32())]))
MARK_SQL = "array<struct<least:bigint,s:int,e:int>>"


@dataclass
class Kind:
    """The elements: window and gram lengths, hashes of a slice of texts, and how to cut a run out of a text."""

    size: int
    gram: int
    #: texts -> hashes of all elements, one after another, and the number of elements of each text
    hashes: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
    #: text -> its elements as integers that are equal only for equal elements; None where the hashes are so
    numbered: Callable[[bytes], np.ndarray] | None
    #: text -> something to cut from; that, first element, number of elements -> bytes
    parts: Callable[[bytes], object]
    piece: Callable[[object, int, int], bytes]
    #: a condition on an anchor's `count`, `low` and `high` (ids)
    repeated: str
    #: widths of the parts that anchors with too many runs are split into, one after another; the last is 1
    widths: tuple[int, ...]
    #: distinct runs of complete groups, sorted by g -> (smallest id, first, end) of the marked windows of each run: what
    #: is marked for rows whose order is above that id, by growing ids and growing stretches
    solve: Callable[[dict[str, list | np.ndarray]], list[list[tuple[int, int, int]]]]


def gram_hashes(v: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all grams of consecutive elements, by doubling; entry i is for elements i to i + gram - 1."""
    out, length, rest, done = None, 1, gram, 0
    mult = 0x9E3779B97F4A7C15
    while rest:
        if rest & 1:
            part = v[done:] if out is not None else v
            out = v if out is None else out[: len(part)] * np.uint64(mult) ^ part[: len(out)]
            done += length
            mult = mult * 0xBF58476D1CE4E5B9 & (1 << 64) - 1 | 1
        rest >>= 1
        if rest:
            v = v[:-length] * np.uint64(0xD1342543DE82EF95 + 2 * length) + v[length:] if len(v) > length else v[:0]
            length *= 2
    out = (out ^ out >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ out >> np.uint64(29)


def _segments(sizes: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, first element, end) of stretches that hold each window once, some at a time."""
    step, held, many = SEGMENT - size + 1, [], 0
    for t, n in enumerate(sizes.tolist()):
        for s in range(0, n - size + 1, step):
            e = min(s + SEGMENT, n)
            held.append((t, s, e))
            many += e - s
            if many >= AT_ONCE:
                yield tuple(np.array(x) for x in zip(*held, strict=True))
                held, many = [], 0
    if held:
        yield tuple(np.array(x) for x in zip(*held, strict=True))


def _repeating(v: np.ndarray, at: np.ndarray, lag: np.ndarray, size: int) -> np.ndarray:
    """Whether the lag + size - 1 elements of v from each place at on equal those that begin lag places later."""
    out = np.zeros(len(at), dtype=bool)
    for k in np.unique(lag).tolist():
        same = np.cumsum(np.r_[0, v[k:] == v[:-k]])
        j = np.flatnonzero(lag == k)
        out[j] = same[at[j] + k + size - 1] - same[at[j]] == k + size - 1
    return out


def runs(hashes: np.ndarray, sizes: np.ndarray, size: int, gram: int, numbered: Callable[[int], np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """(anchor, text, first window, windows, anchor's place in the run, times) of all runs of texts with so many elements each.

    A run that occurs several times, each right after the one before, is one with a number of times. Where hashes of
    elements may collide, numbered gives a text's elements as integers that don't, and these decide.
    """
    begin, found = np.cumsum(sizes) - sizes, []
    for text, low, high in _segments(sizes, size):
        n = high - low
        at = np.cumsum(n) - n
        index = np.arange(n.sum()) - np.repeat(at, n)  # place within the segment
        v = hashes[np.repeat(begin[text] + low, n) + index]
        g = gram_hashes(v, gram)
        key = g & ~np.uint64(SEGMENT - 1) | index[: len(g)].astype(np.uint64)
        width, length = size - gram + 1, 1
        while length * 2 <= width:
            key = np.minimum(key[:-length], key[length:])
            length *= 2
        if length < width:
            key = np.minimum(key[: len(key) - (width - length)], key[width - length :])
        ok = np.flatnonzero(index[: len(key)] + size <= np.repeat(n, n)[: len(key)])
        place, own = (key[ok] & np.uint64(SEGMENT - 1)).astype(np.int64), np.repeat(np.arange(len(text)), n)[ok]
        first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (own[1:] != own[:-1])])
        own, place, start, many = own[first], place[first], index[ok[first]], np.diff(np.r_[first, len(ok)])
        anchor, a = g[at[own] + place], place - start
        again = np.r_[False, (anchor[1:] == anchor[:-1]) & (many[1:] == many[:-1]) & (a[1:] == a[:-1]) & (own[1:] == own[:-1])]
        j = np.flatnonzero(again)  # equal to the run before only if all elements are
        again[j] = _repeating(v, at[own[j]] + start[j] - many[j], many[j], size)
        if numbered and again.any():
            j = j[again[j]]
            for t in np.unique(text[own[j]]).tolist():
                mine = j[text[own[j]] == t]
                again[mine] = _repeating(numbered(t), low[own[mine]] + start[mine] - many[mine], many[mine], size)
        head = np.flatnonzero(~again)
        found.append((anchor[head].view(np.int64), text[own[head]], start[head] + low[own[head]], many[head], a[head], np.diff(np.r_[head, len(again)])))
    if not found:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _batches(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of batches with a bounded number of rows, and of bytes of a column but for longer single ones."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            end = min(at + ROWS, max(at + 1, int(np.searchsorted(ends, before + TEXT_BYTES, "right"))))
            yield b.slice(at, end - at)
            at = end


def _keys(piece: str | Column) -> list[Column]:
    return [F.xxhash64(piece).alias("k1"), F.xxhash64(F.lit(17), piece).alias("k2")]


def base(docs: DataFrame, id_col: str, text_col: str, row_col: str | None = None, ordered: bool = True) -> DataFrame:
    """The texts as bytes (null: empty) with a row number of their own (or row_col), written, so that the numbers stay.

    ord: a number in the order of the ids, whatever their type; null ids are last. Without ordered it is 0.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = docs.select(row.alias("row"), F.col(id_col).alias("id"), shared.text_or_empty(text_col).cast("binary").alias("text"))
    if not ordered:
        return shared.write_out(rows.withColumn("ord", F.lit(0).cast("long")), "texts")
    if isinstance(docs.schema[id_col].dataType, IntegralType):
        return shared.write_out(rows.withColumn("ord", F.coalesce(F.col("id").cast("long"), F.lit(LAST))), "texts")
    rows = shared.write_out(rows, "unordered")
    places = shared.write_out(rows.select("id").where("id IS NOT NULL").distinct().orderBy("id").withColumn("ord", F.monotonically_increasing_id()), "order")
    return shared.write_out(rows.join(places, "id", "left").select("row", "id", "text", F.coalesce("ord", F.lit(LAST)).alias("ord")), "texts")


def marks(texts: DataFrame, kind: Kind, group: int = GROUP) -> DataFrame:
    """(row, spans array<struct<first, last>>): the elements from first to before last that marked windows cover, for each text
    that has any. A run's marked windows are nearer to each other than a window's length, so each run gives one span."""
    found = _marked(texts.select("row", "ord", "text"), kind, group, 0)
    mark = F.try_element_at(F.filter("mark", lambda m: m["least"] < F.col("ord")), F.lit(-1))
    spans = found.withColumn("m", mark).where("m IS NOT NULL").select("row", F.struct((F.col("first") + F.col("m.s")).alias("first"), (F.col("first") + (F.col("times") - 1) * F.col("n") + F.col("m.e") + (kind.size - 1)).alias("last")).alias("span"))
    out = shared.write_out(spans.groupBy("row").agg(F.collect_list("span").alias("spans")), "back")  # of one text
    shared.drop(*found._lobspark_inputs)
    return out


def _anchors(kind: Kind, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _batches(batches):
        texts = b.column("text")
        numbered = lru_cache(maxsize=1)(lambda t, texts=texts: kind.numbered(texts[t].as_py())) if kind.numbered else None
        g, text, first, n, a, times = runs(*kind.hashes(texts), kind.size, kind.gram, numbered)
        at = pa.array(text)
        yield pa.RecordBatch.from_arrays([pa.array(g), b.column("row").take(at), b.column("ord").take(at), *(pa.array(x.astype(np.int32)) for x in (first, n, a, times))], names=["g", "row", "ord", "first", "n", "a", "times"])


def _cores(kind: Kind, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of runs: their windows by distance to the anchor, and hashes of what the windows of a part share."""
    most = kind.size - kind.gram
    for b in _batches(batches):
        g, own, first, n, a = [], [], [], [], []
        for k, (text, parent, n_, a_) in enumerate(zip(*(b.column(c).to_pylist() for c in ("text", "g", "n", "a")), strict=True)):
            cut = kind.parts(text)
            for part in range((a_ - n_ + 1) // width, a_ // width + 1):
                near, far = part * width, min(part * width + width - 1, most)  # the distances of the part
                d = min(a_, far)
                core = kind.piece(cut, a_ - near, kind.size - far + near)
                g.append(xxhash.xxh3_64_intdigest(core, (parent + part * 0x9E3779B97F4A7C15) & LAST) - (1 << 63))
                own.append(k)
                first.append(a_ - d)
                n.append(d - max(a_ - n_ + 1, near) + 1)
                a.append(d)
        at = pa.array(own, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), *(b.column(c).take(at) for c in ("row", "count", "low", "high")), *(pa.array(x, pa.int32()) for x in (first, n, a)), pa.array([1] * len(g), pa.int32())], names=["g", "row", "count", "low", "high", "first", "n", "a", "times"])


def _marked(texts: DataFrame, kind: Kind, group: int, level: int) -> DataFrame:
    """(row, ord, first, n, times, mark) of all runs with marked windows.

    texts: (row, ord, text) at level 0; below, distinct runs of anchors that had too many (row, count, low, high, g, n, a, text).
    """
    who = ["ord"] if level == 0 else ["count", "low", "high"]
    many = F.sum("times") if level == 0 else F.sum(F.col("times") * F.col("count"))
    totals = [many.alias("count"), F.min(who[-2 if level else 0]).alias("low"), F.max(who[-1]).alias("high")]
    who_sql = "".join(f"{w} bigint, " for w in who)
    anchors = (lambda x: _anchors(kind, x)) if level == 0 else (lambda x: _cores(kind, kind.widths[level - 1], x))
    all_runs = shared.write_out(texts.mapInArrow(anchors, f"g bigint, row bigint, {who_sql}first int, n int, a int, times int"), "runs")
    repeated = shared.write_out(all_runs.groupBy("g").agg(*totals).where(kind.repeated).select("g"), "anchors")
    kept = all_runs.join(repeated, "g").groupBy("row").agg(F.collect_list(F.struct("g", "first", "n", "a", "times")).alias("runs"))  # of one text
    kept = shared.write_out(kept, "kept")
    shared.drop(all_runs, repeated)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            lists = b.column("runs")
            fields = [lists.flatten().field(i) for i in range(5)]
            sizes = lists.value_lengths().to_numpy()
            at, first, n = np.repeat(np.arange(b.num_rows), sizes), fields[1].to_pylist(), fields[2].to_pylist()
            held, size, done, k = [], 0, 0, 0

            def part(low: int, pieces: list[bytes]) -> pa.RecordBatch:
                rows = pa.array(at[low : low + len(pieces)])
                return pa.RecordBatch.from_arrays([*(b.column(c).take(rows) for c in ("row", *who)), *(f.slice(low, len(pieces)) for f in fields), pa.array(pieces, pa.binary())], names=["row", *who, "g", "first", "n", "a", "times", "piece"])

            for text, many in zip(b.column("text").to_pylist(), sizes.tolist(), strict=True):
                parts = kind.parts(text)
                for k in range(k, k + many):
                    held.append(kind.piece(parts, first[k], n[k] + kind.size - 1))
                    size += len(held[-1])
                    if size > PIECE_BYTES:
                        yield part(done, held)
                        done, held, size = done + len(held), [], 0
                k += many > 0
            if held:
                yield part(done, held)

    copies = texts.join(kept, "row").select("row", *who, "text", "runs").mapInArrow(cut, f"row bigint, {who_sql}g bigint, first int, n int, a int, times int, piece binary")
    copies = shared.write_out(copies.select("*", *_keys("piece")), "copies")
    shared.drop(kept)
    distinct = copies.groupBy("g", "n", "a", "piece").agg(*totals)
    distinct = shared.write_out(distinct.select(F.monotonically_increasing_id().alias("row"), "*", *_keys("piece")), "distinct")
    large = shared.write_out(distinct.groupBy("g").agg(F.count("*").alias("runs")).where(F.col("runs") > group).select("g"), "large")
    out = f"g bigint, k1 bigint, k2 bigint, mark {MARK_SQL}"
    few, some = distinct, level < len(kind.widths) and not large.isEmpty()
    if some:
        few = distinct.join(large, "g", "left_anti")
    marked = few.select("g", "k1", "k2", "n", "a", "count", "low", "high", "piece").repartition(shared.many_parts(texts.sparkSession, 2), "g").sortWithinPartitions("g").mapInArrow(lambda x: _solved(kind, x), out)
    if some:
        hot = shared.write_out(distinct.join(large, "g").withColumnRenamed("piece", "text"), "hot")
        below = _marked(hot, kind, group, level + 1)
        each = below.select("row", "first", F.explode("mark").alias("m")).groupBy("row", F.col("m.least").alias("least")).agg(F.min(F.col("first") + F.col("m.s")).alias("s"), F.max(F.col("first") + F.col("m.e")).alias("e"))
        whole = each.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("least", "s", "e"))).alias("m"))  # of one run
        upto = lambda i, name: F.transform(F.slice("m", 1, i + 1), lambda x: x[name])
        growing = F.transform("m", lambda x, i: F.struct(x["least"].alias("least"), F.array_min(upto(i, "s")).alias("s"), F.array_max(upto(i, "e")).alias("e")))
        marked = marked.unionByName(whole.select("row", growing.alias("mark")).join(hot, "row").select("g", "k1", "k2", "mark"))
    marked = shared.write_out(marked, "marks")
    shared.drop(distinct, large)
    if some:
        shared.drop(hot, *below._lobspark_inputs)
    result = copies.select("row", *who, "first", "n", "times", "g", "k1", "k2").join(marked, ["g", "k1", "k2"]).select("row", *who[:1], "first", "n", "times", "mark")
    result._lobspark_inputs = (copies, marked)
    return result


def _solved(kind: Kind, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def solved(rows: pa.RecordBatch) -> pa.RecordBatch:
        data = {c: rows.column(c).to_pylist() if c == "piece" else rows.column(c).to_numpy() for c in rows.schema.names}
        found = kind.solve(data)
        at = pa.array([k for k, m in enumerate(found) if m], pa.int64())
        got = [m for m in found if m]
        flat = np.array([x for m in got for x in m], dtype=np.int64).reshape(-1, 3)
        ends = np.cumsum([0, *map(len, got)]).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1].astype(np.int32)), pa.array(flat[:, 2].astype(np.int32))], fields=list(MARK.value_type))
        return pa.RecordBatch.from_arrays([*(rows.column(c).take(at) for c in ("g", "k1", "k2")), pa.ListArray.from_arrays(pa.array(ends), values)], names=["g", "k1", "k2", "mark"])

    held = None
    for b in batches:
        b = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        g = b.column("g").to_numpy()
        k = int(np.searchsorted(g, g[-1])) if len(g) else 0  # the last group may go on in the next batch
        if k:
            yield solved(b.slice(0, k))
        held = b.slice(k)
    if held is not None and held.num_rows:
        yield solved(held)


def covered(spans: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, last) of the joined stretches that lists of spans of n texts cover, in order."""
    texts = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False))
    flat = spans.flatten()
    first, last = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    if not len(first):
        return texts, first, last
    far = int(last.max()) + 1
    order = np.lexsort((first, texts))
    texts, first, last = texts[order], first[order], last[order]
    reach = np.maximum.accumulate(texts * far + last) - texts * far
    opens = np.flatnonzero(np.r_[True, (texts[1:] != texts[:-1]) | (first[1:] > reach[:-1])])
    return texts[opens], first[opens], np.maximum.reduceat(last, opens)
