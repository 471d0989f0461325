"""Dedup of repeated byte strings by suffix arrays that are built by linear grouping.

The suffix array of a text is built in two passes without recursion and without renaming:

1. Suffixes are grouped by their Lyndon prefixes. Groups are processed in descending order; each member looks up the
   previous position whose group isn't higher, by pointers over positions that are already processed (previous-smaller
   pointers). Positions so reached have the group's prefix appended to theirs, so they move to new groups just above
   their old ones, those reached by more members in a row higher.
2. Groups are emitted in ascending order: each sorted suffix puts those whose Lyndon prefix ends where it begins, found
   along the same pointers, at the next place of their own groups.

suffix_array() does this for one text, suffix_arrays() for many at once: each step takes the highest group left of every
text, in arrays. repeats.py deals the corpus' windows to groups of runs that share an anchor. Each group is one text: its
distinct runs, those that occur once cut to what they share with any other around the anchor, with an end mark each. Its
suffix array brings equal windows next to each other; a window repeats if neighbours that agree in it count two or more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats, shared

WINDOW = 200
GRAM = 32


def byte_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, dtype=np.uint8)
    return data.astype(np.uint64) + np.uint64(1), np.diff(offsets)


def suffix_array(text: list[int]) -> list[int]:
    """Positions of text in the order of its suffixes; the last element must be smaller than all others."""
    n = len(text)
    if n < 2:
        return list(range(n))
    # groups are stretches of order; group[i] is where position i's begins
    order = sorted(range(n), key=text.__getitem__)
    place, group, size = [0] * n, [0] * n, [0] * n
    begin = 0
    for k, i in enumerate(order):
        if k and text[i] != text[order[k - 1]]:
            begin = k
        place[i], group[i] = k, begin
        size[begin] += 1
    previous = [-1] * n
    end = n
    while end > 0:  # pass 1
        start = group[order[end - 1]]
        reached: dict[int, int] = {}
        for i in order[start:end] if end - start == 1 else sorted(order[start:end]):
            p = i - 1
            while p >= 0 and group[p] > start:
                p = previous[p]
            if p >= 0 and group[p] == start:
                p = previous[p]  # a repetition of the same prefix: it counts for the position before both
            previous[i] = p
            if p >= 0:
                reached[p] = reached.get(p, 0) + 1
        if reached:
            for times in sorted(set(reached.values()), reverse=True):
                tails: dict[int, int] = {}
                moved = [p for p, c in reached.items() if c == times]
                for p in moved:  # to the end of its old group
                    g = group[p]
                    taken = tails.get(g, 0)
                    last = g + size[g] - 1 - taken
                    tails[g] = taken + 1
                    k, other = place[p], order[last]
                    order[k], order[last] = other, p
                    place[other], place[p] = k, last
                for g, taken in tails.items():
                    size[g] -= taken
                    new = g + size[g]
                    size[new] = taken
                    for k in range(new, new + taken):
                        group[order[k]] = new
        end = start
    free = list(range(n))  # pass 2: the next place in each group
    out, done = [-1] * n, [False] * n
    out[0] = n - 1
    done[n - 1] = True
    for k in range(n):
        p = out[k] - 1
        while p >= 0 and not done[p]:
            g = group[p]
            out[free[g]] = p
            free[g] += 1
            done[p] = True
            p = previous[p]
    return out


#: Texts that are sorted in step; longer ones than most, too few to share steps, are sorted one by one.
LANES = 32


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    at = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - at, size)


def suffix_arrays(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """suffix_array() of texts one after another: places in symbols, each text's in the order of its suffixes."""
    ends = np.cumsum(sizes)
    longest = np.argsort(-sizes, kind="stable")
    alone = longest[:LANES] if len(sizes) <= LANES else longest[: LANES - 1][sizes[longest[: LANES - 1]] > 2 * sizes[longest[LANES - 1]]]
    out = np.empty(len(symbols), dtype=np.int64)
    for t in alone.tolist():
        low = ends[t] - sizes[t]
        out[low : ends[t]] = np.array(suffix_array(symbols[low : ends[t]].tolist())) + low
    rest = np.sort(np.setdiff1d(np.arange(len(sizes)), alone, assume_unique=True))
    if len(rest):
        where = _ranges((ends - sizes)[rest], sizes[rest])
        out[where] = where[_in_step(symbols[where], sizes[rest])]
    return out


def _in_step(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    n, ends = len(symbols), np.cumsum(sizes)
    begin = ends - sizes
    key = np.repeat(np.arange(len(sizes)) * (int(symbols.max()) + 1), sizes) + symbols
    order = np.argsort(key, kind="stable")
    opens = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    place, group, size = np.empty(n + 1, dtype=np.int64), np.empty(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
    place[order] = np.arange(n)
    many = np.diff(np.r_[opens, n])
    group[order] = np.repeat(opens, many)
    group[n] = -1  # place n stands for none
    size[opens] = many
    before = np.arange(-1, n)
    before[begin] = n
    previous, mark = np.full(n + 1, n, dtype=np.int64), np.zeros(n + 1, dtype=bool)

    def smaller(i: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The previous places whose groups aren't higher than own."""
        p = before.take(i)
        open_ = (group.take(p) > own).nonzero()[0]
        while len(open_):
            q = previous.take(p.take(open_))
            p[open_] = q
            open_ = open_.compress(group.take(q) > own.take(open_))
        return p

    low, end = begin, ends
    while len(end):  # pass 1
        start = group.take(order.take(end - 1))
        single = end - start == 1
        own = start.compress(single)
        if len(own):  # a group of one reaches one place at most, which becomes a group of its own
            i = order.take(own)
            p = smaller(i, own)
            previous[i] = p
            reached = p.compress(p < n)
            g = group.take(reached)
            left = size.take(g) - 1
            tail = g + left
            other, at = order.take(tail), place.take(reached)
            order[at], place[other] = other, at
            order[tail], place[reached], group[reached] = reached, tail, tail
            size[g] = left
            size[tail] = 1
        if len(own) < len(start):
            own, many = start.compress(~single), (end - start).compress(~single)
            i, own = order.take(_ranges(own, many)), np.repeat(own, many)
            p = smaller(i, own)
            previous[i] = p
            same = (group.take(p) == own).nonzero()[0]
            while len(same):  # repetitions of the same prefix count for the place before them all
                q = previous.take(p.take(same))
                p[same] = q
                previous[i.take(same)] = q
                same = same.compress(group.take(q) == own.take(same))
            reached = np.sort(p.compress(p < n))
            if len(reached):
                head = np.flatnonzero(np.r_[True, reached[1:] != reached[:-1]])
                times, reached = np.diff(np.r_[head, len(reached)]), reached[head]
                g = group[reached]
                by = np.argsort(g * (int(times.max()) + 1) + times)
                reached, times, g = reached[by], times[by], g[by]
                first = np.r_[True, g[1:] != g[:-1]]
                top = g[first]
                many = np.diff(np.r_[np.flatnonzero(first), len(g)])
                slots = _ranges(top + size[top] - many, many)  # the ends of their old groups
                holders, places = order[slots], place[reached]
                mark[reached] = True
                moved = holders[~mark[holders]]
                mark[reached] = False
                mark[slots] = True
                free = places[~mark[places]]
                mark[slots] = False
                order[free], place[moved] = moved, free
                order[slots], place[reached] = reached, slots
                size[top] -= many
                new = np.flatnonzero(first | np.r_[True, times[1:] != times[:-1]])
                many = np.diff(np.r_[new, len(g)])
                group[reached] = np.repeat(slots[new], many)
                size[slots[new]] = many
        alive = start > low
        low, end = (low, start) if alive.all() else (low.compress(alive), start.compress(alive))
    out, done, free = np.empty(n, dtype=np.int64), np.zeros(n + 1, dtype=bool), np.arange(n)  # pass 2
    out[begin] = ends - 1
    done[ends - 1] = done[n] = True
    k, last, p = begin.copy(), ends - 1, before.take(ends - 1)
    while len(k):  # each text puts one place, and goes on to its next sorted suffix where a chain of pointers ends
        go = (~done.take(p)).nonzero()[0]
        q = p.take(go)
        g = group.take(q)
        at = free.take(g)
        out[at] = q
        free[g] = at + 1
        done[q] = True
        p[go] = previous.take(q)
        stop = done.take(p).nonzero()[0]
        k[stop] += 1
        at = k.take(stop)
        over = at > last.take(stop)
        p[stop] = before.take(out.take(np.where(over, last.take(stop), at)))
        if over.any():
            keep = k <= last
            k, last, p = k.compress(keep), last.compress(keep), p.compress(keep)
    return out


def _common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def _agreement(parts: list[bytes]) -> list[int]:
    """For each string, how long a prefix it shares with any other."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    shared_ = [_common(parts[a], parts[b]) for a, b in zip(order, order[1:], strict=False)]
    out = [0] * len(parts)
    for k, i in enumerate(order):
        out[i] = max(shared_[k - 1] if k else 0, shared_[k] if k < len(shared_) else 0)
    return out


def repeated_windows(groups: list[list[tuple[bytes, int]]], window: int) -> list[list[tuple[int, int]]]:
    """For each text of each group of (distinct text, count): where windows that occur twice or more in its group first and last start, or (0, -1)."""
    texts = [t for group in groups for t, _ in group]
    many = np.array([len(g) for g in groups], dtype=np.int64)
    length = np.array([len(t) for t in texts], dtype=np.int64)
    count = np.array([c for group in groups for _, c in group], dtype=np.int64)
    flat = np.frombuffer(b"\0".join(texts) + bytes(8), dtype=np.uint8)
    begin = np.cumsum(length + 1) - length - 1
    n = int(begin[-1] + length[-1] + 1)
    owner = np.repeat(np.arange(len(texts)), length + 1)
    of_group = np.repeat(many, many)
    symbols = flat[:n].astype(np.int64) + (of_group + 1)[owner]
    number = np.arange(len(texts)) - np.repeat(np.cumsum(many) - many, many)
    symbols[begin + length] = of_group - number  # ends differ and fall, so that suffixes don't go on into the next text
    sorted_ = suffix_arrays(symbols, np.add.reduceat(length + 1, np.cumsum(many) - many))
    inside = sorted_[sorted_ + window <= (begin + length)[owner[sorted_]]]  # other windows don't lie in one text
    group = np.repeat(np.arange(len(groups)), many)[owner[inside]]
    equal = np.r_[False, group[1:] == group[:-1]]
    eight = np.ndarray((n,), dtype=np.uint64, buffer=flat, strides=(1,)) if window >= 8 else flat
    step = 8 if window >= 8 else 1
    for k in [*range(0, window - step, step), window - step]:
        at = np.flatnonzero(equal)
        equal[at] = eight[inside[at] + k] == eight[inside[at - 1] + k]
    first = np.flatnonzero(~equal)
    total = np.add.reduceat(count[owner[inside]], first) if len(first) else np.zeros(0, dtype=np.int64)
    hit = inside[np.repeat(total > 1, np.diff(np.r_[first, len(inside)]))]
    low, high = np.full(len(texts), n), np.full(len(texts), -1)
    np.minimum.at(low, owner[hit], hit - begin[owner[hit]])
    np.maximum.at(high, owner[hit], hit - begin[owner[hit]])
    found = zip(np.where(high < 0, 0, low).tolist(), high.tolist(), strict=True)
    return [[next(found) for _ in g] for g in groups]


def _solve(window: int):
    def solve(rows: dict) -> list[list[tuple[int, int, int]]]:
        g, a, count, piece = rows["g"].tolist(), rows["a"].tolist(), rows["count"].tolist(), rows["piece"]
        groups: list[list[tuple[bytes, int]]] = []
        uses: list[list[tuple[int, int, int]]] = []  # (row, where its part begins, number of the text) of each group
        for s, e in zip(*_stretches(rows["g"]), strict=True):
            texts: dict[bytes, int] = {}
            own = []
            if e - s == 1:
                texts[piece[s]], own = count[s], [(s, 0, 0)]
            else:
                right = _agreement([piece[i][a[i] :] for i in range(s, e)])
                left = _agreement([piece[i][: a[i]][::-1] for i in range(s, e)])
                number: dict[bytes, int] = {}
                for i, x, y in zip(range(s, e), left, right, strict=True):
                    part, at = (piece[i], 0) if count[i] > 1 else (piece[i][a[i] - x : a[i] + y], a[i] - x)
                    if len(part) >= window:
                        texts[part] = texts.get(part, 0) + count[i]
                        own.append((i, at, number.setdefault(part, len(number))))
            if texts:
                groups.append(list(texts.items()))
                uses.append(own)
        out: list[list[tuple[int, int, int]]] = [[] for _ in g]
        for own, found in zip(uses, repeated_windows(groups, window) if groups else [], strict=True):
            for i, at, k in own:
                low, high = found[k]
                if high >= 0:
                    out[i].append((-1, low + at, high + at + 1))
        return out

    return solve


def _stretches(g: np.ndarray) -> tuple[list[int], list[int]]:
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    return first.tolist(), np.r_[first[1:], len(g)].tolist()


def kind(window: int = WINDOW) -> repeats.Kind:
    return repeats.Kind(size=window, gram=min(GRAM, window), hashes=byte_hashes, numbered=None, parts=bytes, piece=lambda text, first, n: text[first : first + n], repeated="count > 1", widths=(24, 4, 1), solve=_solve(window))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, group: int = repeats.GROUP) -> DataFrame:
    """Removes each byte that is covered by a string of `window` bytes that also starts anywhere else in the corpus.

    Per row: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the remaining bytes), spans. Null texts
    are empty; null and repeated ids, of any type, keep their own rows, and repeated texts remove each other. Other columns aren't read.
    """
    texts = repeats.base(docs, id_col, text_col, ordered=False)
    found = texts.join(repeats.marks(texts, kind(window), group), "row", "left")
    id_kind = texts.schema["id"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in repeats._batches(batches):
            texts = b.column("text").to_pylist()
            who, first, last = repeats.covered(b.column("spans"), len(texts))
            ends = np.cumsum(np.bincount(who, minlength=len(texts))).tolist()
            removed = np.bincount(who, weights=last - first, minlength=len(texts)).astype(np.int64)
            sha, at, low, high = [], 0, first.tolist(), last.tolist()
            for text, end in zip(texts, ends, strict=True):
                if at == end:
                    sha.append(hashlib.sha256(text).hexdigest())
                    continue
                kept, place = hashlib.sha256(), 0
                for k in range(at, end):
                    kept.update(text[place : low[k]])
                    place = high[k]
                kept.update(text[place:])
                sha.append(kept.hexdigest())
                at = end
            offsets = pa.array(np.r_[0, ends].astype(np.int32))
            spans = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(first), pa.array(last - first)], names=["first", "n"]))
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sizes), pa.array(removed), pa.array(np.diff(np.r_[0, ends])), pa.array(sha, pa.string()), spans], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    out = found.select("id", "text", "spans").mapInArrow(apply, f"id {id_kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<first:bigint,n:bigint>>")
    return out.withColumnRenamed("id", id_col)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(shared.table(spark, sf_dir, "documents")).drop("spans")


SQL = """
WITH b AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), n AS (
  SELECT doc_id, h, CAST(length(h) / 2 AS BIGINT) AS n FROM b
), s AS (
  SELECT doc_id, unnest(range(0, n - 199)) AS p, h FROM n
), k AS (
  SELECT doc_id, p, md5(substr(h, 2 * p + 1, 400)) AS key FROM s
), r AS (
  SELECT doc_id, p FROM k JOIN (SELECT key FROM k GROUP BY key HAVING count(*) > 1) USING (key)
), i AS (
  SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 200 THEN 0 ELSE 1 END AS opens FROM r
), j AS (
  SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS span FROM i
), spans AS (
  SELECT doc_id, span, min(p) AS a, max(p) + 200 AS z FROM j GROUP BY doc_id, span
), gaps AS (
  SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans
), kept AS (
  SELECT g.doc_id, sum(z - a) AS n_removed, count(*) AS n_spans,
         string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS h
  FROM gaps g JOIN n USING (doc_id) GROUP BY g.doc_id
)
SELECT n.doc_id, n.n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept.h, n.h))) AS kept_sha256
FROM n LEFT JOIN kept USING (doc_id)
"""
